"""Packing token pieces into sequences by bounded-space online best fit.

Every document's ids are cut into pieces of at most ``capacity`` ids (only a
document longer than that is cut). Pieces are dealt to tasks by a hash of their
key and stream through a packer that holds a fixed number of open bins. The
bins' free space is a bitset: bit f is set while some open bin has exactly f
free places, so the best fit for a piece of length n is the lowest set bit at
or above n. When no bin fits and all are open, the fullest closes first.

Pieces are grouped by hash into chunks of a fixed expected number of ids; a task
takes whole chunks, each longest piece first, so short pieces fill the gaps and
open bins carry over to the next chunk. The packer keeps ``open_bins`` numbers and nothing else, so memory does not
grow with the data, and placements follow from the sorted keys alone, so a
rerun after a lost executor gives the same ones.

Defined cases: a null or empty text is one piece holding the end id; an empty
table gives an empty result; rows that repeat an id are packed as pieces of
their own; other columns are not touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_batches, shared_dir, small_batches, stored
from larder.llm.tokens import coder, default_tokenizer

CAPACITY = 4096
OPEN_BINS = 2048
CHUNK_BINS = 512
END_ID = 1


class BestFitPacker:
    """Online best fit over at most ``open_bins`` open bins of ``capacity``."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bitset: bit f set while a bin with f free places is open
        self.by_free: dict[int, list[int]] = {}
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.free ^= 1 << free
        self.n_open -= 1
        return number

    def _open(self, number: int, free: int) -> None:
        bins = self.by_free.setdefault(free, [])
        if not bins:
            self.free |= 1 << free
        bins.append(number)
        self.n_open += 1

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset of a piece (1 <= length <= capacity)."""
        fitting = self.free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open >= self.open_bins:  # the fullest open bin closes
                self._take((self.free & -self.free).bit_length() - 1)
            number, free = self.n_bins, self.capacity
            self.n_bins += 1
        if free > length:
            self._open(number, free - length)
        return number, self.capacity - free


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32 (and the ids' bytes)."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()
    small_batches(df.sparkSession)

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = coder(path).encode
        ids, rows, blobs = batch.column(0), [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            blob = encode(text) + end
            step = 4 * capacity
            for at in range(0, len(blob), step):
                part = blob[at:at + step]
                rows.append((row, at // step, at // 4, len(part) // 4, zlib.crc32(part)))
                if with_ids:
                    blobs.append(part)
        row, piece, start, length, crc = (np.array(c, dtype=np.int64) for c in zip(*rows))
        cols = [ids.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            cols, names = [*cols, pa.array(blobs, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    simple = docs.schema["id"].dataType.simpleString()
    schema = f"id {simple}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return map_batches(docs, pieces, schema).withColumnRenamed("id", id_col)


def best_fit_pack(pieces: DataFrame, key_cols: list[str], length_col: str = "length", capacity: int = CAPACITY,
                  open_bins: int = OPEN_BINS, tasks: int | None = None) -> DataFrame:
    """Append sequence_id and offset to every piece (lengths 1 to ``capacity``)."""
    n = tasks or int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = pieces.agg(F.sum(length_col)).first()[0] or 0
    chunks = max(1, -(-total // (capacity * min(CHUNK_BINS, open_bins))))
    names = pieces.columns
    at = names.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = BestFitPacker(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.place(x) for x in batch.column(at).to_pylist()]
            seq = np.array([p[0] for p in placed], dtype=np.int64) + base
            off = np.array([p[1] for p in placed], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    dealt = (pieces.withColumn("_chunk", F.pmod(F.xxhash64(*key_cols), F.lit(chunks))).repartition(n, "_chunk")
             .sortWithinPartitions("_chunk", F.col(length_col).desc(), *key_cols).drop("_chunk"))
    return dealt.mapInArrow(run, schema)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   end_id: int = END_ID, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenise and pack every document: one row per piece with its place."""
    spark = df.sparkSession
    pieces = stored(token_pieces(df, id_col, text_col, tokenizer, end_id, capacity), shared_dir(spark, "pieces"))
    return best_fit_pack(pieces, [id_col, "piece", "start", "ids_crc32"], "length", capacity, open_bins)


def sequences(pieces_with_ids: DataFrame, placed: DataFrame, key_cols: list[str]) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (bytes, pieces in offset order).

    A sequence holds at most ``capacity`` ids, so its list of pieces is bounded.
    """
    joined = placed.select(*key_cols, "sequence_id", "offset", "length").join(pieces_with_ids.select(*key_cols, "ids"), key_cols)
    listed = joined.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined_ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return listed.select("sequence_id", "n_tokens", joined_ids.alias("ids"))
