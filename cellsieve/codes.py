"""Issue codes."""

# Codes found in the issues relation and among dataset issues.
REQUIRED_EMPTY = "REQUIRED_EMPTY"
TYPE_MISMATCH = "TYPE_MISMATCH"
DATE_PARSE_FAILED = "DATE_PARSE_FAILED"
REGEX_MISMATCH = "REGEX_MISMATCH"
MIN_LEN_VIOLATED = "MIN_LEN_VIOLATED"
MAX_LEN_VIOLATED = "MAX_LEN_VIOLATED"
MIN_VIOLATED = "MIN_VIOLATED"
MAX_VIOLATED = "MAX_VIOLATED"
ENUM_NOT_ALLOWED = "ENUM_NOT_ALLOWED"
NOT_IN_VIOLATED = "NOT_IN_VIOLATED"
UNIQUE_VIOLATED = "UNIQUE_VIOLATED"
UNIQUE_TOGETHER_VIOLATED = "UNIQUE_TOGETHER_VIOLATED"
MISSING_COLUMN = "MISSING_COLUMN"
EXTRA_COLUMN = "EXTRA_COLUMN"
PARSE_ERROR = "PARSE_ERROR"
