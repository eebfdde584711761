"""Regular-expression classes with one meaning in Python, Java and RE2.

``\\w`` and ``\\s`` differ between engines once text leaves ASCII.  The two
explicit classes below are the Unicode word and whitespace characters as Python
defines them; Spark (Java) and DuckDB (RE2) both accept this notation.
"""

WORD = r"[\p{L}\p{N}_]"
# Z holds the space, line and paragraph separators; the rest are controls.
SPACE = r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\p{Z}]"

BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def java_pattern(pattern: str) -> str:
    """Spell out ``\\b \\w \\s \\S`` for Java with the classes of this module."""
    for escape, spelled in (
        (r"\b", BOUNDARY),
        (r"\w", WORD),
        (r"\s", SPACE),
        (r"\S", NOT_SPACE),
    ):
        pattern = pattern.replace(escape, spelled)
    return pattern
