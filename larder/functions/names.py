"""Name and token normalisation as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_name(c) -> Column:
    """trim, lower-case, runs of non-[a-zA-Z0-9] -> '_', squeeze, strip '_'."""
    x = F.regexp_replace(F.lower(F.trim(_col(c))), "[^a-zA-Z0-9]+", "_")
    x = F.regexp_replace(x, "_+", "_")
    return F.regexp_replace(x, "^_+|_+$", "")


def feature_token(c) -> Column:
    """Like ``normalize_name`` without the trim; lower-casing comes last."""
    x = F.regexp_replace(_col(c).cast("string"), "[^a-zA-Z0-9]+", "_")
    x = F.regexp_replace(x, "^_+|_+$", "")
    return F.lower(F.regexp_replace(x, "_+", "_"))


def category_token(c) -> Column:
    """Unicode letters/digits kept, other runs -> '_', case kept; blank -> 'EMPTY'."""
    x = F.regexp_replace(F.trim(_col(c).cast("string")), "[^\\p{L}\\p{N}]+", "_")
    x = F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_+|_+$", "")
    return F.when(_col(c).isNull() | (x == ""), F.lit("EMPTY")).otherwise(x)


def safe_stem(c) -> Column:
    """File-name stem rule: runs of [^a-zA-Z0-9._-] -> '_', strip '._', cut 120, default."""
    x = F.regexp_replace(_col(c), "[^a-zA-Z0-9._-]+", "_")
    x = F.regexp_replace(x, "^[._]+|[._]+$", "")
    x = F.substring(x, 1, 120)
    return F.when(x == "", F.lit("dataset")).otherwise(x)


def sanitize_filename(c) -> Column:
    """Upload file name -> safe '<stem>.csv', or null when rejected (no name,
    NUL character, or not a .csv file). Directory parts are dropped."""
    name = _col(c)
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    is_csv = F.lower(base).endswith(".csv") & (F.length(base) > 4)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    ok = name.isNotNull() & (F.length(name) > 0) & ~name.contains("\u0000") & is_csv
    return F.when(ok, F.concat(safe_stem(stem), F.lit(".csv")))
