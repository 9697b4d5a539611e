"""A training corpus from ``documents``: five stages, each one operator.

Every stage reads all its predecessor kept, written as Parquet below the shared
checkpoint folder. Stages 1 to 4 return the columns of documents unchanged:

1. toxicity: documents predicted toxic go.
2. exact dedup: of equal texts the smallest doc_id stays, once.
3. n-gram Jaccard join: of each component the smallest doc_id stays.
4. decontamination: documents that hold a benchmark item go.
5. best-fit packing: one row per token piece with its place in a sequence.

Decisions are taken per row: operators see a key of doc_id and text as their id,
which sorts by doc_id, rows without one last. So rows without an id are judged
like all others, and of rows that repeat an id only those with a rejected text
go; rows equal in both are copies and share a decision. Rejections leave by an
anti join on the key, so kept rows are never rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity_kn
from larder.llm.common import read_table, shared_dir, stored


FLIP_SIGN = -1 << 63


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with the key of their rows, and its column's name, which no other column has."""
    names = {c.lower() for c in docs.columns}
    own = next(c for c in (f"_key{'_' * i}" for i in range(len(names) + 1)) if c not in names)
    number = F.lpad(F.hex(F.col("doc_id").cast("bigint").bitwiseXOR(F.lit(FLIP_SIGN))), 16, "0")
    return docs.withColumn(own, F.concat(F.coalesce(number, F.lit("none")), F.coalesce(F.md5("text"), F.lit("")))), own


def without(docs: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """Keyed documents whose key is not among the rejected ones."""
    names = docs.columns
    return docs.join(rejected.select(key).distinct(), key, "left_anti").select(*names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    scored = toxicity_kn.score_toxicity(rows, read_table(spark, sf_dir, "labels"), row_col=key)
    return without(rows, key, scored.filter("predicted = 1")).drop(key)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    judged = stored(exact_dedup.exact_dedup(rows, id_col=key).select(key, "kept"), shared_dir(spark, "judged"))
    left = without(rows, key, judged.filter("not kept"))
    if judged.filter("kept").groupBy(key).count().filter("count > 1").limit(1).count():  # equal rows are one document
        left = left.dropDuplicates([key])
    return left.drop(key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    return without(rows, key, ngram_join.ngram_jaccard(rows, id_col=key).filter(F.col(key) != F.col("component_id"))).drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    return without(rows, key, decontaminate.contaminated(rows, read_table(spark, sf_dir, "benchmark"), id_col=key)).drop(key)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

# The toxicity stage cannot be stated in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), shared_dir(spark, name))
    return docs
