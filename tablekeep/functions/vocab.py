"""Words, patterns and labels that results are written in.

Everything in this file is a fixed value: results only match when these
agree, so they are stated plainly and in one place.
"""

# Text patterns a column can be checked against.
PATTERNS = {
    "email": r"^[\w\.-]+@[\w\.-]+\.\w+$",
    "phone": r"^\+?\d{8,15}$",
    "postal_code": r"^\d{5}$",
    "numeric": r"^\d+$",
    "alphanumeric": r"^[a-zA-Z0-9]+$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "ip": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
}

# Statuses used in every result.
PASSED = "passed"
FAILED = "failed"
SKIPPED = "skipped"
UNKNOWN = "unknown"

# Status words accepted on input when results are standardised.
STATUS_WORDS = {
    "réussi": PASSED,
    "pass": PASSED,
    "passed": PASSED,
    "échoué": FAILED,
    "fail": FAILED,
    "failed": FAILED,
    "ignoré": SKIPPED,
    "skipped": SKIPPED,
}

# Words counted as success or failure in a quality summary.
SUCCESS_WORDS = ["réussi", "réussie", "succès", "success", "pass", "passed"]
FAILURE_WORDS = ["échoué", "échouée", "échec", "failed", "fail"]

# Words behind the quality tag of one check.
TAG_SUCCESS_WORDS = ["réussi", "success", "pass", "succès", "passed"]
TAG_FAILURE_WORDS = ["échoué", "failed", "fail", "echec"]
DQ_SUCCESS = "DQ_SUCCESS"
DQ_FAILED = "DQ_FAILED"
DQ_WARNING = "DQ_WARNING"

# How a missing and a blank value are shown among examples.
NULL_EXAMPLE = "NULL"
BLANK_EXAMPLE = "VIDE"

# Entity types, classes and their default attributes.
DATASET = "DATASET"
COLUMN = "COLUMN"
DATASET_CLASSES = ["PUBLIC", "RESTRICTED"]
COLUMN_CLASSES = ["PII", "SENSITIVE"]
DEFAULT_DATASET_CLASS = "RESTRICTED"
RESTRICTED_SCOPE = "DEPARTMENT"
PUBLIC_SCOPE = "ENTERPRISE"
UNKNOWN_DEPARTMENT = "UNKNOWN"

# Weights and thresholds of dataset similarity and column matching.
WEIGHT_STRUCTURE = 0.60
WEIGHT_NAME_OVERLAP = 0.7
WEIGHT_TYPE_AGREEMENT = 0.3
WEIGHT_NAME = 0.30
WEIGHT_SAMPLE = 0.10
PARENT_THRESHOLD = 0.60
CLOSE_THRESHOLD = 0.55
CLOSE_OVERLAP = 0.8
EXTENSION_THRESHOLD = 0.45
COLUMN_NAME_PERCENT = 82
