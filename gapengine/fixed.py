"""Fixed values.

Every value here has to be exactly what it is for results to be right: word
lists, lookup tables, patterns, thresholds and codes.  They are data, kept in
one place and in natural order; the logic that uses them lives elsewhere.
"""

# ---------------------------------------------------------------- text tables

STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "if", "then", "than", "that", "this", "these", "those", "is", "are",
    "was", "were", "be", "been", "being", "to", "of", "in", "on", "at", "for", "with", "without", "from", "by",
    "as", "it", "its", "into", "during", "when", "while", "so", "such", "do", "does", "did", "done", "can",
    "could", "should", "would", "may", "might", "must", "will", "shall", "not", "no", "nor", "test", "tests",
    "testing", "case", "cases", "should_", "verify", "verifies", "check", "checks", "ensure", "ensures", "user",
    "users", "system", "app", "application", "service", "given", "expect", "expected", "actual", "result",
    "results",
]

SYNONYMS = {
    "checkout": ["cart", "order", "purchase", "basket"],
    "cart": ["checkout", "basket"],
    "order": ["checkout", "purchase", "orders"],
    "discount": ["coupon", "promo", "promotion", "voucher", "offer"],
    "coupon": ["discount", "promo", "voucher"],
    "payment": ["pay", "charge", "billing", "transaction", "card"],
    "refund": ["payment", "chargeback", "reversal"],
    "auth": ["authentication", "login", "signin", "session", "token"],
    "login": ["auth", "authentication", "signin", "session"],
    "logout": ["auth", "session", "signout"],
    "password": ["credential", "auth", "login"],
    "permission": ["authorization", "authorisation", "role", "access", "rbac", "privilege"],
    "role": ["permission", "authorization", "rbac"],
    "profile": ["account", "user", "settings"],
    "search": ["query", "filter", "lookup", "find"],
    "notification": ["email", "alert", "push", "sms", "message"],
    "timeout": ["timed", "expire", "expiry", "deadline", "latency"],
    "retry": ["retries", "reattempt", "resend", "backoff"],
    "concurrent": ["concurrency", "race", "parallel", "simultaneous", "lock"],
    "null": ["none", "nil", "missing", "undefined"],
    "empty": ["blank", "zero-length", "missing"],
    "unicode": ["utf8", "encoding", "emoji", "non-ascii", "charset"],
    "invalid": ["malformed", "bad", "illegal", "unsupported"],
    "boundary": ["limit", "max", "maximum", "min", "minimum", "edge"],
}

TOKEN_SPLIT = r"[^a-z0-9%.]+"
PERCENT_PATTERN = r"(-?\d+(?:\.\d+)?)\s*(?:%|percent|pct)\b"
NUMBER_PATTERN = r"(-?\d+(?:\.\d+)?)"

# Provenance words that never name a feature, and the longest derived name.
FEATURE_NOISE = [
    "test", "tests", "testing", "spec", "specs", "src", "app", "apps", "lib", "suite", "suites", "e2e", "it",
    "integration", "unit", "functional", "regression", "smoke", "acceptance", "automation", "qa", "cases", "case",
    "main", "root", "project", "code", "py", "js", "ts", "feature", "features", "init", "conftest", "helpers",
    "helper", "utils", "util", "common", "fixtures", "fixture", "support", "base", "sheet", "data",
]
FEATURE_WORDS = 3
UNKNOWN = "Unknown"

# --------------------------------------------------------- behavioural signals
# Rule order is result order.

SIGNAL_PATTERNS = {
    "null": r"\b(null|none|nil|undefined|nullable)\b",
    "empty": r"\b(empty|blank|zero[- ]?length|no value|whitespace only)\b",
    "missing_field": (
        r"\b(missing|absent|omitted|not provided|without)\s+(?:the\s+)?\w*\s*"
        r"(field|param|parameter|attribute|key|header|value)?\b"
    ),
    "invalid": r"\b(invalid|malformed|illegal|unsupported|corrupt|bad request|wrong format)\b",
    "boundary_max": (
        r"\b100\s*(?:%|percent|pct)|\b(?:maximum|max|upper limit|largest|exceeds?|exceeded|"
        r"exceeding|over the limit|too (?:large|long|many|big))\b"
    ),
    "boundary_min": (
        r"\b(?<!division by )zero\b|(?<![\d.])0\s*(?:%|percent|pct)|"
        r"\b(?:minimum|lower limit|smallest|negative)\b"
    ),
    "timeout": (
        r"\b(timeout|timed out|time[- ]out|deadline|took too long|latency|slow response|"
        r"unresponsive|hung|no response)\b"
    ),
    "retry": r"\b(retry|retries|retried|re[- ]?attempt|resend|resubmit|backoff|replay)\b",
    "concurrency": (
        r"\b(concurrent|concurrency|race condition|simultaneous|parallel|at the same time|deadlock|"
        r"lock contention|double[- ]?submit|in[- ]flight)\b"
    ),
    "permission": (
        r"\b(permission\w*|permit\w*|authoris\w*|authoriz\w*|role\w*|rbac|privilege\w*|forbidden|403|"
        r"access denied|401|scope\w*)\b"
    ),
    "error_handling": (
        r"\b(unhandled|uncaught|exception|stack trace|500|crash|traceback|"
        r"error (?:response|page|screen)|(?:server|internal) error|fails? gracefully|division by zero)\b"
    ),
    "unicode": (
        r"\b(unicode|utf-?8|emoji|non[- ]?ascii|accent|cyrillic|chinese|japanese|encoding|charset|"
        r"diacritic)\b"
    ),
    "data_format": (
        r"\b(format|json|xml|csv|date format|iso[- ]?8601|serial|parse|decimal|precision|currency)\b"
    ),
    "state_transition": (
        r"\b(transition|lifecycle|state machine|out of order|inconsistent state|followed by|"
        r"sequence|moved from|reverted|"
        r"already (?:cancelled|canceled|completed|shipped|paid|captured|refunded|expired|"
        r"unsubscribed|submitted|sent))\b"
        r"|\b(?:before|after)\s+(?:the\s+|it\s+|being\s+)?\w+\s+(?:was|were|had|is|are)\b"
        r"|\b(?:before|after)\s+(?:capture|cancellation|shipment|refund|settlement|payment|"
        r"confirmation|delivery|submission)\b"
        r"|\b(?:before|after)\s+\w+ing\b"
        r"|\b(?:before|after)\s+(?:the|a|an|its|their)\s+\w+\s+"
        r"(?:unsubscribed|subscribed|cancelled|canceled|completed|shipped|expired|captured|"
        r"paid|refunded|settled|closed|finished|delivered|confirmed|arrived|started)\b"
    ),
    "environment": (
        r"\b(staging|production only|only in production|environment|region|timezone|time zone|"
        r"locale|configuration|config|feature flag)\b"
    ),
    "large_input": r"\b(large|long|oversized|bulk|thousands|10000|100000|huge|payload size)\b",
}

# Signals a test has to exercise before it can count as coverage.
DECISIVE_SIGNALS = [
    "null", "empty", "missing_field", "invalid", "boundary_max", "boundary_min", "timeout", "retry", "concurrency",
    "permission", "unicode", "error_handling", "state_transition", "environment",
]

SEQUENCE_SIGNALS = ["retry", "timeout", "concurrency", "state_transition"]

# A production value that is itself a signal.
VALUE_SIGNALS = {
    "null": "null", "none": "null", "nil": "null", "undefined": "null",
    "empty": "empty", "blank": "empty",
    "missing": "missing_field", "absent": "missing_field",
    "invalid": "invalid", "malformed": "invalid",
}

# The same for a test's input value; it also knows the empty string and unicode.
TEST_VALUE_SIGNALS = {
    **VALUE_SIGNALS,
    "": "empty", "unicode": "unicode", "emoji": "unicode",
}

SIGNAL_PHRASES = {
    "null": "null values",
    "empty": "empty values",
    "missing_field": "absent fields",
    "invalid": "unreadable values",
    "boundary_max": "upper limit",
    "boundary_min": "lower limit",
    "timeout": "time limits",
    "retry": "repeated attempts",
    "concurrency": "parallel use",
    "permission": "access rights",
    "unicode": "text beyond ASCII",
    "error_handling": "reaction to errors",
    "state_transition": "change of state",
    "data_format": "form of the data",
    "environment": "influence of the environment",
}

# ------------------------------------------------------- condition extraction

CONDITION_NOUNS = [
    "discount", "coupon", "promo", "voucher", "tax", "shipping", "total", "subtotal", "amount", "price",
    "quantity", "payment", "card", "currency", "refund", "balance", "limit", "retry", "retries", "timeout",
    "attempts", "password", "email", "username", "name", "address", "phone", "token", "session", "role",
    "permission", "scope", "query", "filter", "page", "size", "offset", "results", "status", "state", "order",
    "item", "items", "notification", "message", "subject", "locale", "timezone", "encoding", "format", "field",
    "value", "input", "threshold", "percentage", "percent", "rate", "count", "length", "duration", "delay",
    "interval",
]

STOP_BEFORE_NOUN = [
    "a", "an", "the", "with", "of", "for", "to", "and", "or", "is", "was", "when", "applied", "using",
]
GENERIC_NOUNS = ["field", "value", "input", "parameter", "param", "attribute", "key"]
QUALIFIERS = [
    "null", "empty", "blank", "missing", "invalid", "negative", "duplicate", "expired", "unicode", "malformed",
    "declined", "unknown", "locked", "cancelled", "canceled", "disabled", "unverified", "valid",
]

_QUALIFIER = "|".join(QUALIFIERS)

# (pattern, which group is the noun, which is the value, kind of value), in
# priority order.
CONDITION_RULES = (
    (r"(-?\d+(?:\.\d+)?)\s*(?:%|percent|pct)\s+(?:off\s+)?(?:the\s+|a\s+|an\s+)?([a-z]+)", 2, 1, "percent"),
    (r"([a-z]+)\s*(?:=|:|of|at|to|was|is)?\s*(-?\d+(?:\.\d+)?)\s*(?:%|percent|pct)", 1, 2, "percent"),
    (r"([a-z]+(?:\s+[a-z]+)?)\s*(?:=|:|of|was|is|set to)\s*(-?\d+(?:\.\d+)?)\b", 1, 2, "number"),
    (r"\b([a-z]+)\s+(-?\d+(?:\.\d+)?)\b", 1, 2, "number"),
    (rf"\b({_QUALIFIER})\s+(?:the\s+)?([a-z]+(?:\s+[a-z]+)?)", 2, 1, "text"),
    (rf"\b([a-z]+(?:\s+[a-z]+)?)\s+(?:is|was|were|are|being)\s+({_QUALIFIER})", 1, 2, "text"),
    (r"([a-z_]+)\s*[=:]\s*[\"']([^\"']{1,60})[\"']", 1, 2, "text"),
)

TEST_NAME_PREFIXES = ["test", "should", "verify", "verifies", "check", "checks", "ensure", "ensures", "it"]

# ------------------------------------------------------------ incident fields

ROOT_CAUSE_PATTERN = (
    r"(?:root\s*cause|rca|caused\s+by|reason)\s*[:\-]\s*(.+?)(?:\n\n|\n(?=[A-Z][a-z]+\s*:)|$)"
)
FAILURE_PATTERN = (
    r"([^.\n]*\b(?:fail(?:s|ed|ure)?|error|crash(?:ed|es)?|exception|timeout|timed out|rejected|"
    r"returned\s+\d{3}|unable to|could not|cannot|broke|incorrect|wrong|denied|hangs?|stuck)\b[^.\n]*)"
)
SEVERITY_KEYWORDS = (
    ("CRITICAL", ("outage", "all customers", "data loss", "sev1", "sev-1", "p0", "critical", "revenue impact")),
    ("HIGH", ("sev2", "sev-2", "p1", "high", "many customers", "checkout failed", "payment failed", "cannot complete")),
    ("LOW", ("cosmetic", "minor", "sev4", "sev-4", "p3", "low", "single user", "typo")),
)

# ---------------------------------------------------------------------- codes

COVERAGES = ["COVERED", "PARTIAL", "NOT_COVERED", "INSUFFICIENT_EVIDENCE"]
COVERAGE_LABELS = {
    "COVERED": "Covered",
    "PARTIAL": "Partially Covered",
    "NOT_COVERED": "Not Covered",
    "INSUFFICIENT_EVIDENCE": "Insufficient Evidence",
}
EFFECTIVENESS = ["NO_COVERAGE", "INSUFFICIENT_COVERAGE", "POTENTIALLY_INEFFECTIVE", "ADEQUATE"]
RISKS = ["HIGH", "MEDIUM", "LOW"]
SOURCE_KINDS = ["REPOSITORY", "CSV", "EXCEL"]
RECOMMENDATION_STATUSES = ["PROPOSED", "ACCEPTED", "IGNORED", "ALREADY_COVERED"]

GAP_FAMILIES = {
    "BOUNDARY_CONDITIONS": ("Boundary Conditions", ["BOUNDARY_CONDITION"]),
    "NULL_EMPTY_INPUTS": ("Null / Empty Inputs", ["NULL_HANDLING", "EMPTY_INPUT", "MISSING_FIELD"]),
    "INVALID_INPUT_VALIDATION": ("Invalid Input & Validation", ["INVALID_INPUT", "DATA_FORMAT", "UNICODE_ENCODING"]),
    "PERMISSION_COMBINATIONS": ("Permission Combinations", ["PERMISSION"]),
    "ERROR_HANDLING": ("Error Handling", ["ERROR_HANDLING"]),
    "RESILIENCE_RETRY_TIMEOUT": ("Retry / Timeout Handling", ["RETRY_BEHAVIOR", "TIMEOUT_BEHAVIOR"]),
    "CONCURRENCY": ("Concurrency", ["CONCURRENCY"]),
    "STATE_TRANSITIONS": ("State & Sequence Transitions", ["STATE_TRANSITION", "INPUT_COMBINATION"]),
    "TEST_QUALITY": ("Weak / Missing Test Execution", ["WEAK_ASSERTION", "MISSING_EXECUTION", "TEST_DATA_MISMATCH"]),
    "ENVIRONMENT": ("Environment-Specific Behaviour", ["ENVIRONMENT_SPECIFIC"]),
    "UNCATEGORISED": ("Uncategorised Missing Coverage", ["MISSING_TEST", "NONE"]),
}

# Missing signal -> gap type, in priority order.
SIGNAL_GAP_TYPES = (
    ("concurrency", "CONCURRENCY"),
    ("retry", "RETRY_BEHAVIOR"),
    ("timeout", "TIMEOUT_BEHAVIOR"),
    ("permission", "PERMISSION"),
    ("unicode", "UNICODE_ENCODING"),
    ("null", "NULL_HANDLING"),
    ("empty", "EMPTY_INPUT"),
    ("missing_field", "MISSING_FIELD"),
    ("invalid", "INVALID_INPUT"),
    ("boundary_max", "BOUNDARY_CONDITION"),
    ("boundary_min", "BOUNDARY_CONDITION"),
    ("error_handling", "ERROR_HANDLING"),
    ("environment", "ENVIRONMENT_SPECIFIC"),
    ("state_transition", "STATE_TRANSITION"),
)

# ------------------------------------------------------------------- tunables

TOP_K = 15
VECTOR_OVERSAMPLE = 6
MIN_SCORE = 0.08
RELATIVE_FLOOR = 0.35
VECTOR_WEIGHT = 0.5
LEXICAL_WEIGHT = 0.5
FEATURE_BOOST = 1.30
CONDITION_BOOST = 1.15
SIGNAL_BOOST = 1.10
FALLBACK_KEEP = 3

BM25_K1 = 1.5
BM25_B = 0.75
SYNONYM_QUERY_WEIGHT = 0.5

VECTOR_DIMENSIONS = 512
UNIGRAM_WEIGHT = 1.0
BIGRAM_WEIGHT = 0.7
SYNONYM_WEIGHT = 0.4

DISTINCTIVE_SHARE = 0.02
RELEVANCE_FLOOR = 0.15
PARTIAL_STRENGTH = 0.35
TOPICAL_SCORE = 0.55
TOPICAL_OVERLAP = 0.45
TOPICAL_TERMS = 2

VOCABULARY_MIN_TESTS = 2
VOCABULARY_MAX_TERMS = 40
VOCABULARY_MIN_LIFT = 1.5

CONFIDENCE_WEIGHTS = {
    "retrieval_strength": 0.30, "evidence_richness": 0.30, "decisiveness": 0.25, "corpus_support": 0.15,
}
CONFIDENT_CORPUS = 200
CONFIDENCE_HIGH = 0.75
CONFIDENCE_MEDIUM = 0.50

SEVERITY_POINTS = {"CRITICAL": 3, "HIGH": 2, "MEDIUM": 1, "LOW": 0}
COVERAGE_POINTS = {"NOT_COVERED": 2, "PARTIAL": 1, "COVERED": 1, "INSUFFICIENT_EVIDENCE": 0}
FEATURE_POINTS = {
    "Payments": 2, "Checkout": 2, "Authentication": 2,
    "Orders": 1, "Profile": 1, "Notifications": 1, "Search": 0,
}
RISK_HIGH = 6
RISK_MEDIUM = 3
PATTERN_MIN_INCIDENTS = 3
PATTERN_RISK_HIGH = 7
PATTERN_RISK_MEDIUM = 4
PATTERN_EXAMPLES = 12
PATTERN_FEATURES = 4
MAX_RECOMMENDATIONS = 6

MIN_QUOTE_CHARS = 6
TEST_ID_PATTERN = r"\b(?:TC-\d+|[A-Za-z_][\w]*::[\w:]+)\b"

# -------------------------------------------------------------------- sources

COLUMN_ALIASES = {
    "id": ["id", "test id", "testid", "test case id", "testcaseid", "case id", "tc", "tc id", "tc no", "key",
           "identifier", "ref", "test key"],
    "name": ["name", "test name", "testname", "test case", "test case name", "title", "summary", "test title",
             "case name"],
    "scenario": ["scenario", "description", "test scenario", "test description", "details", "steps", "test steps",
                 "given", "precondition", "preconditions", "objective"],
    "expected": ["expected", "expected result", "expected results", "expected behavior", "expected behaviour",
                 "expected outcome", "expectation", "then", "result", "acceptance criteria"],
    "feature": ["feature", "module", "component", "area", "epic", "suite", "functionality", "category",
                "test suite"],
    "tags": ["tags", "labels", "markers", "marker", "type", "test type", "priority"],
    "inputs": ["inputs", "input", "test data", "data", "parameters", "params", "input data", "when"],
}
INPUT_PAIR_PATTERN = r"^\s*([A-Za-z_][\w .-]*?)\s*[=:]\s*(.+?)\s*$"
CSV_DELIMITERS = ",;\t|"

IGNORED_DIRECTORIES = [
    ".git", ".hg", ".svn", ".idea", ".vscode", ".vs", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    "node_modules", "bower_components", "vendor", "venv", ".venv", "env", ".env", "virtualenv", "site-packages",
    "dist", "build", "out", "target", "coverage", "htmlcov", ".tox", ".nox", ".next", ".nuxt", ".cache", ".gradle",
    "bin", "obj", "Debug", "Release", ".terraform",
]

EXPECTATION_PREFIXES = ["expected:", "expect:", "then:", "should ", "asserts "]
