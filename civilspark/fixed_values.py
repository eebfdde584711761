"""Labels, patterns, tables and cut-offs that decide the results.

Everything here is data. Patterns are written in the usual regular-expression
notation; ``functions.regex`` turns them into the dialect Spark runs.
"""

# ---- text normalisation (fixed values) -------------------------------------

URL_PATTERN = r"https?://\S+|www\.\S+"
URL_PLACEHOLDER = "[URL]"
MENTION_PATTERN = r"@\w+"
MENTION_PLACEHOLDER = "[USER]"

# Characters that stand for letters inside obfuscated words.
LEET_LETTERS = {
    "@": "a",
    "4": "a",
    "8": "b",
    "3": "e",
    "1": "i",
    "!": "i",
    "0": "o",
    "5": "s",
    "$": "s",
    "7": "t",
    "+": "t",
    "*": "u",
}
# A word mixing letters with digits, or letters with symbols.
LEET_WORD_PATTERN = (
    r"\b(?=[a-z]*[0-9])(?=(?:[a-z][0-9]?){2})[a-z0-9]{3,}\b"
    r"|\b(?=[a-z]*[!@*$+])(?=(?:[a-z][!@*$+]?){3})[a-z!@*$+]{4,}\b"
)

REPEAT_PATTERN = r"([a-zA-Z])\1{2,}"

# ---- vocabulary (fixed values) ---------------------------------------------

PAD_TOKEN, PAD_INDEX = "<pad>", 0
UNK_TOKEN, UNK_INDEX = "<unk>", 1
VOCAB_MAX_SIZE = 25000
VOCAB_TRAINING_SIZE = 20000
VOCAB_MIN_FREQ = 2
ENCODE_LENGTH = 100

# ---- features and models (fixed values) ------------------------------------

TFIDF_MAX_FEATURES = 15000
TFIDF_NGRAM_RANGE = (1, 2)
LINEAR_C = 1.5
LINEAR_MAX_ITER = 1000
LINEAR_TOLERANCE = 1e-4
SEED = 42
EMBEDDING_SIZE = 128
HIDDEN_SIZE = 64

# Common English function words of two letters or more; the default stop list.
STOP_WORDS = (
    "about above after again against all am an and any are as at be because "
    "been before being below between both but by can did do does doing don "
    "down during each few for from further had has have having he her here "
    "hers herself him himself his how if in into is it its itself just me "
    "more most my myself no nor not now of off on once only or other our "
    "ours ourselves out over own same she should so some such than that the "
    "their theirs them themselves then there these they this those through "
    "to too under until up very was we were what when where which while who "
    "whom why will with would you your yours yourself yourselves"
).split()

# ---- labelled tables (fixed values) ----------------------------------------

LABELLED_TEXT_COLUMN = "tweet_text"
LABELLED_CLASS_COLUMN = "cyberbullying_type"
COMMENT_COLUMN_CANDIDATES = ("comment", "text", "message", "content", "tweet")
MIN_TEXT_LENGTH = 3

# ---- moderation (fixed values) ---------------------------------------------

LABELS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")

CATEGORIES = {
    "toxic": (
        "Toxicity",
        "General rude, disrespectful, or unreasonable speech",
    ),
    "severe_toxic": (
        "Severe Toxicity",
        "Extremely hateful, aggressive, or destructive remarks",
    ),
    "obscene": (
        "Obscenity / Profanity",
        "Vulgar, obscene language or swear words",
    ),
    "threat": (
        "Threat / Violence",
        "Statements expressing intention to inflict harm or violence",
    ),
    "insult": (
        "Insult / Harassment",
        "Disparaging, demeaning, or belittling a person",
    ),
    "identity_hate": (
        "Identity Hate Speech",
        "Attacks targeting race, religion, gender, sexual orientation, or identity",
    ),
}
CLEAN_CATEGORY = "Clean"

THRESHOLD = 0.50
THRESHOLD_SWEEP = tuple(round(0.10 + 0.05 * step, 2) for step in range(17))

SEVERITY_CLEAN = "Clean (Safe)"
SEVERITY_LOW = "Low / Borderline"
SEVERITY_MILD = "Mild / Elevated Concern"
SEVERITY_MODERATE = "Moderate Toxicity"
SEVERITY_HIGH = "High Toxicity"
SEVERITY_CRITICAL = "Critical Danger (Threat / Severe)"
CLEAN_BELOW = 0.15
CRITICAL_THREAT = 0.50
CRITICAL_SEVERE = 0.70
HIGH_ANY = 0.85
HIGH_IDENTITY = 0.65
MODERATE_ANY = 0.60

EXPLAIN_MIN_WORDS = 2
EXPLAIN_MAX_WORDS = 60
TRIGGER_IMPORTANCE = 0.15
TRIGGER_IMPORTANCE_CONFIDENT = 0.08
CONFIDENT_BASELINE = 0.70

STATUS_TOXIC = "🚨 Toxic"
STATUS_CLEAN = "✅ Clean"

# Flat report: label -> column heading.
REPORT_COLUMNS = {
    "toxic": "Toxicity",
    "severe_toxic": "Severe Toxic",
    "obscene": "Obscene",
    "threat": "Threat",
    "insult": "Insult",
    "identity_hate": "Identity Hate",
}

# ---- default lexicon for the linear scorer ---------------------------------
# Own values. All are multiples of 1/4, so sums are exact in any order.

LEXICON_BIAS = {
    "toxic": -3.0,
    "severe_toxic": -5.0,
    "obscene": -4.0,
    "threat": -6.0,
    "insult": -3.5,
    "identity_hate": -5.0,
}
# term -> weights in label order
LEXICON_WEIGHTS = {
    "trash": (2.5, 0.5, 1.0, 0.0, 2.0, 0.25),
    "scum": (3.0, 2.0, 1.5, 0.5, 3.0, 2.5),
    "idiot": (3.5, 0.5, 1.0, 0.0, 4.25, 0.25),
    "clown": (2.0, 0.25, 0.25, 0.0, 2.5, 0.0),
    "worthless": (3.0, 1.5, 0.5, 0.5, 3.0, 0.5),
    "moron": (3.5, 0.5, 1.25, 0.0, 4.0, 0.5),
    "pathetic": (2.75, 0.5, 0.25, 0.0, 2.75, 0.25),
    "loser": (2.5, 0.25, 0.5, 0.0, 3.0, 0.0),
    "stupid": (3.0, 0.5, 1.0, 0.0, 3.25, 0.25),
    "disgusting": (3.0, 1.5, 1.5, 0.25, 2.0, 1.75),
}
