"""Results are only right if these equal the published ones.

Word lists, lookup tables, constants, patterns, label texts and the prompt
wording. Everything else in the package is free to change; these are not.
"""

# --- statuses and directions -------------------------------------------------
FAILING_STATUSES = ["fail", "error", "timeout"]
CASE_STATUSES = ["error", "fail", "skip", "timeout"]
DIRECTIONS = ["higher_better", "lower_better"]

# --- numeric constants -------------------------------------------------------
BAR_MIN = 8
BAR_MAX = 20
DELTA_THRESHOLD = 2.0
HISTORY_LIMIT = 7
PERF_HISTORY_LIMIT = 8
FAILURE_TEXT_CAP = 8192
SAFE_NAME_CAP = 80
MAX_RELATED = 4
SEARCH_TERMS = 3
SEARCH_SLACK = 5
UPPER_SCAN_CHARS = 300
PROMPT_DETAILS_CAP = 2000
PROMPT_LOG_CAP = 3000
PROMPT_HISTORY_TAIL = 8
TEXT_FILE_CAP = 4000
RAW_RESPONSE_CAP = 500
CHIP_LABEL_CHARS = 14
SLOWEST_FILES = 5

# --- labels ------------------------------------------------------------------
EMPTY_MARK = "—"
NO_LINK = "#"
TRUNCATED_MARK = "\n… (truncated)"
STATUS_SYMBOL = {"pass": "✓", "fail": "✗", "error": "✗", "timeout": "⏱", "skip": "⚠", "na": "—"}
TREND_CHIP = {"good": "up", "bad": "down", "neu": "neu"}
CHIP_COLOUR = {"pos": "green", "neg": "red"}
TREND_LABEL = {"good": "▲ Improved", "bad": "▼ Regressed", "neu": "→ Neutral"}
NOTE_GOOD = "All metrics at best in recent window"
NOTE_BAD = "Performance regression — investigation recommended"
NOTE_NEUTRAL_PREFIX = "All metrics stable vs ref build #"
NOTE_FIRST = "first failure — consistent pass until current build"
NOTE_RECURRING = "recurring failure — flaky or persistent issue"
PROMPT_NOTE_FIRST = "first failure — was consistently passing before this build"

# --- character classes and patterns (Java syntax) ----------------------------
# A word character is any Unicode letter, any Unicode number, or "_".
WORD = r"\p{L}\p{N}_"
UNSAFE_CHAR = rf"[^{WORD}\-]"
# "Not inside a word" is looked up behind the first character or match, so that
# it is only tried where a match can start.
HTTP_CODE = rf"[45]\p{{Nd}}{{2}}(?<![{WORD}]...)(?![{WORD}])"
ISSUE_KEY = rf"([A-Z](?<![{WORD}].)[A-Z0-9]+-\p{{Nd}}+)(?![{WORD}])"
UPPER_ID = rf"[A-Z](?<![{WORD}].)[A-Z0-9_]{{2,}}(?![{WORD}])"
HINT_WORD = rf"(?<![{WORD}])[a-zA-Z]{{3,}}(?![{WORD}])"
LOWER_WORD = rf"(?<![{WORD}])[a-z]{{4,}}(?![{WORD}])"
# What a text strip removes on both ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
CODE_FENCE = rf"(?md)^```(?:json)?[{WHITESPACE}]*|[{WHITESPACE}]*```$"

# --- search-term stop words --------------------------------------------------
STOP_WORDS = [
    "test", "the", "a", "an", "at", "in", "on", "for", "of", "and", "or",
    "not", "is", "it", "to", "be", "as", "by", "via", "with", "after",
    "before", "when", "under", "over", "into", "from", "that", "this",
    "should", "does", "can", "will", "are", "was", "were", "has", "have",
    "had", "fault", "injection", "case", "using", "load",
]

# --- analysis ----------------------------------------------------------------
DEFAULT_TAG = "AI ANALYSIS"
ERROR_TAG = "ANALYSIS ERROR"
SYSTEM_PROMPT = (
    "You are a CI/CD failure analyst embedded in a build dashboard. "
    "Given structured information about a test failure, produce a concise "
    "diagnostic in JSON. "
    "Always respond with a single JSON object and nothing else — "
    "no markdown fences, no preamble, no trailing text."
)
INSTRUCTION = (
    "---\n"
    "Respond with ONLY this JSON object (no backticks, no extra text):\n"
    "{\n"
    '  "text":     "<2-3 sentence HTML diagnostic. Use <strong> for key values, '
    "<code> for identifiers/env vars/paths. State root cause + remediation.>\",\n"
    '  "tag":      "CATEGORY · SPECIFIC DETAIL (max 6 words, uppercase)",\n'
    '  "tag_type": "error"\n'
    "}\n"
    'tag_type must be exactly one of: "error" | "warn" | "ok"\n'
    "Be precise: name exact env vars, error codes, line numbers if available."
)
