"""Token ids as flat binary files with 64-bit document offsets.

Layout of a dataset folder (one set per partition, in ascending order of id):

    part-00007.ids    unsigned integers, little-endian; 16 bits if the tokenizer's
                      ids fit, else 32 (the width is in the part's row)
    part-00007.off    int64, documents + 1 places: where each document starts
    part-00007.key    int64, documents + 1 places: how many of the part's first
                      documents have no id, then the documents' ids (0 for none)

Documents are range-partitioned by id on the JVM; each task encodes its
sorted rows and appends to its files under a name of its own attempt, renamed
when complete, so a rerun or a second attempt leaves one whole set. The tasks
return one row each (documents, tokens); prefix sums over those rows, as many
as there are partitions, give every partition's base. Readers map the files
into memory and read only what they touch.

The folder must be a mounted path that all executors share: memory mapping
needs real files, so any other scheme is refused with an error.

Defined cases: a null or empty text is the end id alone; rows with a null id
come first of all, in order of their text (a null text before any other), and
are returned with a null id; rows that repeat an id follow each other in order of
their text; ids are integers, a text that is none ends the cast with Spark's
error; an empty table gives an empty dataset; other columns are not touched.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import shared_dir, small_batches
from larder.llm.tokens import coder, default_tokenizer

END_ID = 2
_NARROW = 1 << 16


def mounted(path: str) -> str:
    """The file-system path of a shared folder; other schemes cannot be memory-mapped."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"token files need a mounted shared folder, not {path}")
    return url.path


def write_token_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None, end_id: int = END_ID, tasks: int | None = None) -> list[dict]:
    """Write the dataset; returns one entry per part: part, name, width, n_docs, n_tokens, base."""
    spark = df.sparkSession
    path = tokenizer or default_tokenizer()
    width = 2 if max(coder(path).tokenizer.get_vocab_size(), end_id + 1) <= _NARROW else 4
    end = np.array([end_id], dtype="<u4").tobytes()
    root = mounted(folder)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        os.makedirs(root, exist_ok=True)
        own = os.path.join(root, f".{part:05d}-{uuid.uuid4().hex}")
        encode, keys, lengths, nulls = coder(path).encode, [], [], 0
        with open(own + ".ids", "wb") as out:
            for batch in batches:
                nulls += batch.column(0).null_count  # sorted first, so they are the part's first documents
                keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                for text in batch.column(1).to_pylist():
                    blob = encode(text) + end
                    if width == 2:
                        blob = np.frombuffer(blob, dtype="<u4").astype("<u2").tobytes()
                    lengths.append(len(blob) // width)
                    out.write(blob)
        offsets = np.zeros(len(lengths) + 1, dtype="<i8")
        np.cumsum(lengths, out=offsets[1:])
        offsets.tofile(own + ".off")
        np.concatenate([np.array([nulls], dtype="<i8"), *keys]).tofile(own + ".key")
        for end_of in (".ids", ".off", ".key"):
            os.replace(own + end_of, os.path.join(root, f"part-{part:05d}{end_of}"))
        total = int(offsets[-1])
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(lengths)]), pa.array([total])],
                                         names=["part", "n_docs", "n_tokens"])

    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = (docs.repartitionByRange(n, "id").sortWithinPartitions(F.asc_nulls_first("id"), F.asc_nulls_first("text"))
             .mapInArrow(run, "part bigint, n_docs bigint, n_tokens bigint"))
    rows = sorted(parts.collect(), key=lambda r: r["part"])  # one row per partition
    bases = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])]).astype(np.int64)
    return [{"part": int(r["part"]), "name": f"part-{r['part']:05d}", "width": width, "n_docs": int(r["n_docs"]),
             "n_tokens": int(r["n_tokens"]), "base": int(b)} for r, b in zip(rows, bases)]


class TokenPart:
    """One part's files, mapped into memory."""

    def __init__(self, folder: str, name: str, width: int):
        stem = os.path.join(mounted(folder), name)
        self.offsets = np.fromfile(stem + ".off", dtype="<i8")
        key = np.fromfile(stem + ".key", dtype="<i8")
        self.nulls, self.keys = int(key[0]), key[1:]
        self.ids = (np.memmap(stem + ".ids", dtype=f"<u{width}", mode="r") if self.offsets[-1]
                    else np.empty(0, dtype=f"<u{width}"))

    def __len__(self) -> int:
        return len(self.keys)

    def ids_of_documents(self) -> pa.Array:
        """The documents' ids; null for the part's first documents where they have none."""
        return pa.array(self.keys, mask=np.arange(len(self.keys)) < self.nulls)

    def document(self, row: int) -> np.ndarray:
        return self.ids[self.offsets[row]:self.offsets[row + 1]]


def read_token_files(spark: SparkSession, folder: str, parts: list[dict]) -> DataFrame:
    """Documents as the files hold them: doc_id, start, n_tokens, ids_crc32 (32-bit ids)."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    listed = spark.createDataFrame([(p["name"], p["width"], p["base"]) for p in parts] or [],
                                   "name string, width int, base bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, width, base in zip(*(c.to_pylist() for c in batch.columns)):
                part = TokenPart(folder, name, width)
                crc = np.fromiter((zlib.crc32(part.document(i).astype("<u4").tobytes()) for i in range(len(part))),
                                  dtype=np.int64, count=len(part))
                yield pa.RecordBatch.from_arrays(
                    [part.ids_of_documents(), pa.array(part.offsets[:-1] + base), pa.array(np.diff(part.offsets)), pa.array(crc)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(max(1, len(parts)), "name").mapInArrow(run, schema)


def token_file_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          tokenizer: str | None = None) -> DataFrame:
    """Write the dataset below the shared folder and return what its files hold."""
    spark = df.sparkSession
    folder = shared_dir(spark, "token-files")
    parts = write_token_files(df, folder, id_col, text_col, tokenizer)
    return read_token_files(spark, folder, parts)
