"""Cell parsing rules (string -> typed value or reject reason), all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.names import _col

# Tokens read as missing when a CSV is loaded, matching the
# common pandas default NA set.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

# Accepted boolean spellings (after trim + lower-case).
TRUE_TOKENS = ["true", "1", "yes", "y"]
FALSE_TOKENS = ["false", "0", "no", "n"]
BOOLEAN_TOKENS = TRUE_TOKENS + FALSE_TOKENS

# A decimal number with an optional exponent; the same text in the SQL oracle.
NUMBER_PATTERN = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"

# Ordered date formats tried for mixed-format date columns (first hit wins).
# Spark pattern and the equivalent strptime pattern for the SQL oracle.
DATE_FORMATS = [
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
    ("dd-MM-yyyy", "%d-%m-%Y"),
    ("dd.MM.yyyy", "%d.%m.%Y"),
]


def na_to_null(c) -> Column:
    """Null when the raw cell is one of the NA tokens."""
    x = _col(c)
    return F.when(x.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(x)


def parse_date(c) -> Column:
    """Mixed-format text -> date; null when no format matches.

    Every accepted format starts with digit groups split by '-', '/' or '.',
    so a cheap pattern test skips the format attempts for all other text.
    """
    x = F.trim(_col(c).cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(x, F.lit(fmt)) for fmt, _ in DATE_FORMATS]).cast("date")
    return F.when(x.rlike(r"^[0-9]+[-/.][0-9]+[-/.][0-9]+"), parsed)


def parse_boolean(c) -> Column:
    """true/1/yes/y -> True, false/0/no/n -> False, anything else -> null."""
    x = F.lower(F.trim(_col(c).cast("string")))
    return F.when(x.isin(TRUE_TOKENS), F.lit(True)).when(x.isin(FALSE_TOKENS), F.lit(False))


def boolean_reject(c, field: str) -> Column:
    """Reject reason for a non-null cell that is not a boolean spelling."""
    x = F.lower(F.trim(_col(c).cast("string")))
    return F.when(_col(c).isNotNull() & ~x.isin(BOOLEAN_TOKENS), F.lit(f"{field}: Boolean value is invalid."))


def required_text(c) -> Column:
    """Stripped text, null when blank (the caller turns null into a reject)."""
    x = F.trim(_col(c).cast("string"))
    return F.when(F.length(x) > 0, x)


def to_number(c) -> Column:
    """Number of a text, null when the whole text is not one.

    The pattern comes first because a plain cast also takes type suffixes
    ("12d", "5f"), hexadecimal floats and names such as "Infinity".
    """
    x = F.trim(_col(c).cast("string"))
    return F.when(x.rlike(f"^{NUMBER_PATTERN}$"), x.try_cast("double"))


def parse_array(c) -> Column:
    """'[1 2, 3]' -> array<double>: split on commas/whitespace, drop empties."""
    body = F.regexp_replace(_col(c).cast("string"), "[\\[\\]]", "")
    parts = F.split(F.trim(body), "[,\\s]+")
    kept = F.filter(parts, lambda p: p != "")
    return F.when(_col(c).isNull(), F.array().cast("array<double>")).otherwise(
        F.transform(kept, to_number))


def json_safe_double(c) -> Column:
    """NaN -> null (JSON has no NaN)."""
    x = _col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def iso_date(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")
