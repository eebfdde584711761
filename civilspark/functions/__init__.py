"""Column functions: text normalisation, tokens, moderation semantics."""
