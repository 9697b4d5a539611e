"""CSV sources and sinks: raw scan with file-position row numbers, landing
audit, writers.

Row numbers follow the file, not the partitioning: every row is tagged with
its file, the start of its input split and its position inside the task; a
small per-split count table (one row per split) gives each split's offset
inside its file. Nothing is read by a single task and no global sort runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larder.functions.parsing import na_to_null

_POS_BITS = 33


# ---------------------------------------------------------------------------
# Reasons for refused files and rows.
NO_COLUMNS = "The CSV contains no columns."
NO_ROWS = "The CSV contains no data rows."
SURPLUS_FIELDS = "The row has more fields than the header."
BAD_ENCODING = "The row is not valid UTF-8."
# ---------------------------------------------------------------------------

#: Files are parsed byte by byte (every byte is one character of this charset) and decoded afterwards, so that
#: broken text can be told from text; separators and quotes are the same bytes in either.
BYTES = "ISO-8859-1"
SURPLUS = "_surplus"


def _text(c: str) -> Column:
    """A field parsed byte by byte as the UTF-8 text it holds, unchecked."""
    return F.encode(F.col(f"`{c}`"), BYTES).cast("string")


def raw_schema(names: list[str]) -> StructType:
    """Columns as the parser sees them (names byte by byte) and one more that catches the first surplus field."""
    return StructType([StructField(c, StringType()) for c in [*(n.encode("utf-8").decode(BYTES) for n in names), SURPLUS]])


def checked_fields(df: DataFrame, names: list[str]) -> list[Column]:
    """Decoded columns (NA tokens null, broken bytes replaced) and ``reject_reason`` of rows parsed under ``raw_schema``."""
    raw = dict(zip(names, raw_schema(names).names))
    broken = F.lit(False)
    for c in raw.values():
        broken = broken | F.coalesce(~F.is_valid_utf8(_text(c)), F.lit(False))
    reason = F.when(broken, F.lit(BAD_ENCODING)).when(F.col(SURPLUS).isNotNull(), F.lit(SURPLUS_FIELDS))
    return [*[na_to_null(F.make_valid_utf8(_text(r))).alias(c) for c, r in raw.items()], reason.alias("reject_reason")]


def read_checked_csv(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Header CSV (or, with ``columns``, one without a header) as all-string columns and ``reject_reason``.

    A parser that pads short rows also cuts surplus fields without a sign, and
    replaces broken UTF-8; here such rows stay and carry a reason. Empty files
    are refused with an error.
    """
    reader = (spark.read.option("encoding", BYTES).option("mode", "PERMISSIVE").option("header", columns is None)
              .option("multiLine", multi_line))
    names = columns or [c.encode(BYTES).decode("utf-8", "replace") for c in reader.option("inferSchema", False).csv(path).columns]
    if not names:
        raise ValueError(NO_COLUMNS)
    df = reader.schema(raw_schema(names)).csv(path)
    if df.limit(1).count() == 0:
        raise ValueError(NO_ROWS)
    return df.select(*checked_fields(df, names))


def with_file_position(df: DataFrame, start: int = 2) -> DataFrame:
    """Add ``source_file`` and ``source_row_number`` = position in the file + start
    (header is line 1, so data rows start at 2)."""
    tagged = (df.select("*", F.col("_metadata.file_path").alias("source_file"),
                        F.col("_metadata.file_block_start").alias("_blk"),
                        F.monotonically_increasing_id().alias("_rid"))
              .withColumn("_pos", F.col("_rid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))))
    splits = tagged.groupBy("source_file", "_blk").agg(F.min("_pos").alias("_first"),
                                                       F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source_file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # One row per input split: broadcast, as a shuffle would deal the rows by split, a whole split to one task.
    j = tagged.join(F.broadcast(offsets), ["source_file", "_blk"])
    rn = F.col("_off") + F.col("_pos") - F.col("_first") + F.lit(start)
    return j.withColumn("source_row_number", rn.cast("bigint")).drop("_blk", "_rid", "_pos", "_first", "_off")


def scan_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every record of the files with its position and, where it is broken, ``reject_reason``.

    ``multi_line``: quoted fields may hold line breaks; a file is then one split and records are counted, not lines.
    """
    return with_file_position(read_checked_csv(spark, path, multi_line=multi_line))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, values written as they are (no whitespace trimming)."""
    (df.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_split_files(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One output folder per split value in a single pass (``split=<value>``)."""
    (df.write.mode("overwrite").option("header", True).partitionBy(split_col).csv(path))


# ---------------------------------------------------------------------------
# Upload size limit (MB) and reject texts of the source application.
MAX_UPLOAD_MB = 100
NO_NAME = "A filename is required."
BAD_NAME = "The filename contains invalid characters."
NOT_CSV = "Only .csv files are accepted."
EMPTY_FILE = "The uploaded CSV is empty."
TOO_LARGE = "CSV exceeds the configured {} MB limit."
# ---------------------------------------------------------------------------


def landing_audit(spark: SparkSession, folder: str, max_mb: int = MAX_UPLOAD_MB) -> DataFrame:
    """Accept / reject every file of a landing folder from its metadata only
    (the binary content column is never selected, so it is never read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
             .select("path", "length"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    reason = (F.when(name == "", F.lit(NO_NAME))
              .when(name.contains("\u0000"), F.lit(BAD_NAME))
              .when(~F.lower(name).endswith(".csv"), F.lit(NOT_CSV))
              .when(F.col("length") == 0, F.lit(EMPTY_FILE))
              .when(F.col("length") > max_mb * 1024 * 1024, F.lit(TOO_LARGE.format(max_mb))))
    return files.select("path", name.alias("file_name"), "length", reason.alias("reject_reason"),
                        reason.isNull().alias("accepted"))
