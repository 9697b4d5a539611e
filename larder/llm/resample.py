"""Importance resampling towards a target distribution of hashed word n-grams.

A text is bytes from start to end: one 256-byte table lower-cases A-Z and blanks
every separator in the UTF-8, ``bytes.split`` yields the words (runs of digits,
letters a-z and everything beyond ASCII), and a chained ``zlib.crc32`` seed
extends the checksum of a word to those of the 2- and 3-grams that start there,
so no n-gram is ever joined. Counters of buckets (checksum modulo ``buckets``)
are kept per task and summed by an aggregation on the bucket, of at most
``buckets`` rows a task.

The gain of a bucket compares the smoothed shares of target and corpus; a
document's weight is the sum of its features' gains. Adding Gumbel noise from a
hash of the id and taking the highest scores draws without replacement in
proportion to exp(weight / 1000). Scores are ranked by range-partitioned row
numbers; only the number of eligible documents and the bucket counts reach the
driver.

Defined cases: a null, empty or wordless text has no feature and weight 0; it is
scored and, with fewer than ``min_words`` words, never drawn; a null id hashes
as empty text and loses ties; rows that repeat an id share its noise and are
scored one by one; an empty corpus or target counts 0 in every bucket; other
columns are not touched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_batches, shared_dir, small_batches, stored
from larder.operators.rownum import global_row_number

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
_PIECE_BYTES = 1 << 20  # bytes of a text that are split at once
#: Lower-cases A-Z, keeps digits, letters and bytes beyond ASCII, blanks the rest.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a translated text, a bounded stretch at a time."""
    at = 0
    while len(raw) - at > _PIECE_BYTES:
        cut = raw.rfind(b" ", at, at + _PIECE_BYTES)
        if cut < at:
            cut = raw.find(b" ", at + _PIECE_BYTES)
            if cut < 0:
                break
        yield raw[at:cut].split()
        at = cut + 1
    yield raw[at:].split()


def feature_hashes(text: bytes | None) -> Iterator[tuple[int, list[int]]]:
    """(words, checksums of the 1- to 3-grams that end in them), stretch by stretch."""
    if not text:
        return
    carried: list[bytes] = []  # the last two words before a stretch
    for words in _pieces(text.translate(TABLE)):
        if not words:
            continue
        run = carried + words
        skip = len(carried)
        spaced = [b" " + w for w in run]
        one = list(map(crc32, run))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        # two[i] ends at word i + 1, three[i] at word i + 2.
        yield len(words), one[skip:] + two[max(skip - 1, 0):] + three[max(skip - 2, 0):]
        carried = run[-2:]


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in _texts(batch.column(0)):
                for _, found in feature_hashes(text):
                    counts.update((np.array(found, dtype=np.uint32) % np.uint32(buckets)).tolist())
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int32()), pa.array(counts.values(), pa.int64())], names=["bucket", "n"])

    sums = (df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())  # at most ``buckets`` rows
    out = np.zeros(buckets, dtype=np.int64)
    out[sums["bucket"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, target over corpus."""
    s_all, t_all, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise in thousandths from a hash of the id."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(df: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) per row."""
    shared = df.sparkSession.sparkContext.broadcast(gains)
    buckets = np.uint32(len(gains))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = shared.value
        rows = np.zeros((3, batch.num_rows), dtype=np.int64)
        for i, text in enumerate(_texts(batch.column(1))):
            for n, found in feature_hashes(text):
                rows[:, i] += n, len(found), table[np.array(found, dtype=np.uint32) % buckets].sum()
        drawn = np.array([noise(x, seed) for x in batch.column(0).to_pylist()], dtype=np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows), pa.array(rows[2] + drawn)],
                                          names=["id", "n_words", "n_features", "weight", "score"])

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run,
                       f"id {id_type}, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (null if not drawn).

    ``percent`` of the rows with at least ``min_words`` words are drawn.
    """
    spark = df.sparkSession
    small_batches(spark)
    gains = bucket_gains(bucket_counts(df, text_col, buckets), bucket_counts(target, text_col, buckets))
    scored = stored(scores(df, gains, id_col, text_col, seed), shared_dir(spark, "scores"))
    eligible = F.col("n_words") >= min_words
    wanted = scored.filter(eligible).count() * percent // 100
    ranked = global_row_number(scored, [eligible.desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), "weight", "n_features"],
                               name="place")
    return ranked.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score",
                         F.when(eligible & (F.col("place") <= wanted), F.col("place")).alias("rank"))


def drawn_documents(df: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The drawn rows of a corpus with all their columns (rows that repeat a drawn id come with it)."""
    return df.join(ranked.filter("rank is not null").select(id_col), id_col, "left_semi")
