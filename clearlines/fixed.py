"""Values whose exact content decides results: patterns, word lists, formats, thresholds.

Everything here is a fixed value of the task being reproduced. The logic that uses
the values lives in the other modules and takes each of them as a parameter.
"""

from __future__ import annotations

# --- fixed values: whitespace -------------------------------------------------
# The code points Python treats as whitespace, as a character class that means the
# same in Java and in RE2 (neither of whose own \s does).
WS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NOT_WS = "[^" + WS[1:]
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: text patterns ----------------------------------------------
SENTENCE_END = "[.!?]"
SENTENCE_START = "[A-Z]"
CLAUSE_MARKS = "[,;:]"
MIN_CLAUSE_WORDS = 6
NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?%?"
KEY_TERM = r"[A-Za-z][A-Za-z\-]{3,}"
LETTERS = "[A-Za-z]+"
LONG_WORD = 9
VOWELS = "[aeiouy]+"

# --- fixed values: words that do not count as key terms -------------------------
STOP_WORDS = (
    "this", "that", "with", "from", "into", "onto", "over", "under",
    "about", "after", "before", "while", "where", "which", "their",
    "there", "these", "those", "were", "have", "has", "had", "been",
    "being", "will", "would", "could", "should", "than", "then", "when",
    "what", "your", "they", "them", "also", "only", "just", "very",
    "more", "most", "some", "such", "each", "many", "much", "because",
    "through", "between", "other", "upon", "administration",
)

# --- fixed values: replacement lexicon --------------------------------------------
LEXICON = {
    "rapid": "fast",
    "proliferation": "growth",
    "artificial intelligence": "AI",
    "technologies": "tools",
    "multifarious": "many",
    "precipitated": "caused",
    "paradigm shift": "big change",
    "manner": "way",
    "processed": "handled",
    "analyzed": "studied",
    "leveraged": "used",
    "decision-making": "making decisions",
}

# --- fixed values: target languages -----------------------------------------------
SOURCE_TAG = "eng_Latn"
DEFAULT_TAG = "hin_Deva"
LANGUAGES = {
    "Hindi": "hin_Deva",
    "Bengali": "ben_Beng",
    "Gujarati": "guj_Gujr",
    "Kannada": "kan_Knda",
    "Malayalam": "mal_Mlym",
    "Marathi": "mar_Deva",
    "Odia": "ory_Orya",
    "Punjabi": "pan_Guru",
    "Tamil": "tam_Taml",
    "Telugu": "tel_Telu",
    "Urdu": "urd_Arab",
}

# --- fixed values: markers in model output ----------------------------------------
RESPONSE_MARKERS = ("### Response:", "Simplified:", "Simple:")
MERGED_MARKERS = ("### Response:",)
STOP_MARKERS = ("### Instruction:", "### Input:", "###", "\n\n")
QUANTISED_STOPS = ("###", "\n\n")

# --- fixed values: prompt templates ({text}, {normal}, {simple} are filled in) -------
STANDARD_PROMPT = """Below is an instruction with an input. Write a response that appropriately completes the request.

### Instruction:
Rewrite the following sentence in simpler English. Use shorter words and simpler grammar. Keep the same meaning. Output ONLY the simplified sentence. Do NOT explain. Do NOT add new information or facts.

### Input:
{text}

### Response:
"""
RETRY_PROMPT = """Below is an instruction with an input. Write a response that appropriately completes the request.

### Instruction:
Rewrite this sentence using easier words and shorter phrases. Do not copy the original. Do not add new facts or examples. Output strictly one simplified sentence.

### Input:
{text}

### Response:
"""
QUANTISED_PROMPT = """
Simplify the sentence for a 10-year-old child.

Rules:
- Use very simple words
- Break long sentences
- Remove difficult words
- Keep the same meaning
- DO NOT copy the original sentence

Example:
Input: The rapid proliferation of technology has transformed communication.
Output: Technology is growing fast and has changed how people talk.

Now simplify:

Input: {text}
Output:
"""
QUANTISED_RETRY_PROMPT = """
Simplify aggressively.

- Use basic English
- Max 12-15 words
- No complex words
- No copying

Sentence: {text}
Simple:
"""
QUANTISED_LAST_PROMPT = """
Rewrite this sentence in very plain English for a child.

Rules:
- Keep meaning
- Use common words only
- Keep it short
- Do not copy original wording

Sentence: {text}
Plain English:
"""
MERGED_PROMPT = """Below is an instruction with an input. Write a response that appropriately completes the request.

### Instruction:
Rewrite the sentence in simpler English with shorter words. Keep meaning unchanged. Output only one sentence.

### Input:
{text}

### Response:
"""
TRAINING_TEXT = """Simplify the following sentence into very simple English.
Make it easy for a 10-year-old to understand.
Use short sentences and very simple words.
Do NOT add extra information.

Sentence: {normal}
Simple: {simple}"""

# --- fixed values: generation limits ------------------------------------------------
MAX_LENGTH = 256
MIN_BUDGET = 24
MAX_BUDGET = 48
QUANTISED_BUDGET = 64
QUANTISED_LAST_BUDGET = 48
MERGED_BUDGET = 64
TRAINING_TOKENS = 256
TRAINING_ROWS = 50_000
PROMPT_TOKENS = 512

# --- fixed values: copy and surface thresholds -----------------------------------------
COPY_RATIO = 0.95
MOSTLY_COPY_RATIO = 0.985
SURFACE_WORDS = 1.05
SURFACE_SHORTER_BY = 0.25
SURFACE_FEWER_LONG = 1

# --- fixed values: readability formulas ---------------------------------------------------
FKGL = (0.39, 11.8, 15.59)
FRE = (206.835, 1.015, 84.6)

# --- fixed values: verdict thresholds -------------------------------------------------------
VERDICT_COPY = 0.4
VERDICT_LENGTH = 0.95
VERDICT_MEANING = 0.85

# --- fixed values: waiting-time estimate ------------------------------------------------------
HISTORY = 20
# stage -> (cap, start, per word), all in seconds
ETA_FALLBACK = {"simplify": (240.0, 25.0, 0.45), "translate": (180.0, 18.0, 0.30)}
ETA_FLOOR = 0.60
# (history smaller than, low factor, high factor); the last row is for all longer ones
ETA_BOUNDS = ((1, 0.75, 1.80), (3, 0.80, 1.50), (8, 0.85, 1.35), (None, 0.90, 1.20))
