"""Exact dedup through a cuckoo-filter index of live digests.

Texts are equal when identical after replacing each run of space, tab, LF, VT,
FF and CR by one space (no trimming; null counts as empty). The normalised text
is digested with SHA-256 on the JVM. The thin table (id, digest) is stored once
and goes through the index twice:

* per input partition, so that a group holding a third of all rows shrinks to
  one row per task before anything is shuffled;
* per digest partition, where the tasks' partial groups meet.

The index is a cuckoo filter (16-bit fingerprints, four slots a bucket) beside
stored keys kept by primary bucket. A digest whose fingerprint is absent is new
without any look at the keys; a hit is verified against the bucket's stored
digests. A failed kick-out chain doubles the table and refills it from the
stored keys. Deleting the last live copy of a digest frees its fingerprint.

Defined cases: null ids never win over other ids and are returned with the
group's keep_id; rows that repeat one id are the same document and are flagged
alike; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import shared_dir, stored

_SLOTS = 4
_MAX_KICKS = 200
WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


class CuckooIndex:
    """Live digests with a payload each: cuckoo filter in front of bucketed keys."""

    def __init__(self, buckets: int = 1024):
        self.size = 0
        self._lay_out(1 << max(2, (buckets - 1).bit_length()))

    def _lay_out(self, buckets: int) -> None:
        self.buckets = buckets
        self.slots = array("H", bytes(2 * _SLOTS * buckets))
        self.keys: dict[int, dict[bytes, list]] = {}

    def _place(self, digest: bytes) -> tuple[int, int]:
        fp = (digest[0] | digest[1] << 8) or 1
        return fp, int.from_bytes(digest[2:10], "little") & (self.buckets - 1)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & (self.buckets - 1)

    def get(self, digest: bytes) -> list | None:
        """Payload of a live digest; a filter hit counts only if the stored key agrees."""
        fp, home = self._place(digest)
        for b in (home, self._other(home, fp)):
            if fp in self.slots[b * _SLOTS:(b + 1) * _SLOTS]:
                return self.keys.get(home, {}).get(digest)
        return None

    def insert(self, digest: bytes, payload: list) -> None:
        """Add a digest that is not live yet."""
        fp, home = self._place(digest)
        self.keys.setdefault(home, {})[digest] = payload
        self.size += 1
        if not self._put(fp, home):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest with one copy of its fingerprint."""
        if self.get(digest) is None:
            return False
        fp, home = self._place(digest)
        del self.keys[home][digest]
        self.size -= 1
        for b in (home, self._other(home, fp)):
            for s in range(b * _SLOTS, (b + 1) * _SLOTS):
                if self.slots[s] == fp:
                    self.slots[s] = 0
                    return True
        return True

    def _put(self, fp: int, bucket: int) -> bool:
        slots = self.slots
        for b in (bucket, self._other(bucket, fp)):
            for s in range(b * _SLOTS, (b + 1) * _SLOTS):
                if not slots[s]:
                    slots[s] = fp
                    return True
        b = self._other(bucket, fp)
        for kick in range(_MAX_KICKS):
            s = b * _SLOTS + kick % _SLOTS
            fp, slots[s] = slots[s], fp
            b = self._other(b, fp)
            for s in range(b * _SLOTS, (b + 1) * _SLOTS):
                if not slots[s]:
                    slots[s] = fp
                    return True
        return False

    def _grow(self) -> None:
        live = list(self.items())
        buckets = self.buckets
        while True:
            buckets *= 2
            self._lay_out(buckets)
            for digest, payload in live:
                fp, home = self._place(digest)
                self.keys.setdefault(home, {})[digest] = payload
                if not self._put(fp, home):
                    break
            else:
                return

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.keys.values():
            yield from bucket.items()


def _smaller(a, b):
    return b if a is None else a if b is None else min(a, b)


def _merge(id_type: pa.DataType):
    """One partition's groups: smallest id and number of rows per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                entry = index.get(digest)
                if entry is None:
                    index.insert(digest, [first, n])
                else:
                    entry[0] = _smaller(entry[0], first)
                    entry[1] += n
        rows = list(index.items())
        for at in range(0, len(rows), 50_000):
            part = rows[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in part], pa.binary()), pa.array([e[0] for _, e in part], id_type),
                 pa.array([e[1] for _, e in part], pa.int64())], names=["digest", "keep_id", "group_size"])

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    spark = df.sparkSession
    thin = stored(df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")),
                  shared_dir(spark, "digests"))
    simple = thin.schema["id"].dataType.simpleString()
    schema = f"digest binary, keep_id {simple}, group_size bigint"
    merge = _merge({"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[simple])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = thin.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size")).mapInArrow(merge, schema)
    groups = local.repartition(parts, "digest").mapInArrow(merge, schema)
    return thin.join(groups, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def live_digests(events: DataFrame) -> DataFrame:
    """Live digests after inserts and deletes.

    ``events``: digest binary, seq bigint, delta int (+1 adds a copy, -1 removes
    one; a removal without a live copy is ignored). Events of a digest are
    applied in seq order by the index of its partition. Returns digest, copies.
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, delta in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entry = index.get(digest)
                if delta > 0:
                    if entry is None:
                        index.insert(digest, [1])
                    else:
                        entry[0] += 1
                elif entry is not None:
                    entry[0] -= 1
                    if entry[0] == 0:
                        index.delete(digest)
        rows = list(index.items())
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()),
                                          pa.array([e[0] for _, e in rows], pa.int64())], names=["digest", "copies"])

    ordered = events.repartition(parts, "digest").sortWithinPartitions("digest", "seq").select("digest", "delta")
    return ordered.mapInArrow(run, "digest binary, copies bigint")
