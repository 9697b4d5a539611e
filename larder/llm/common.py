"""Helpers shared by the training-data operators.

Words and shingles
    A text is lower-cased over A-Z only and cut into runs of characters that
    are not space, tab, LF, VT, FF or CR (``bytes.split`` on UTF-8 does exactly
    that). A shingle is five words in a row; a text of one to four words is one
    shingle as a whole; a text without words has none. Shingles are compared by
    a 64-bit hash of their words in order.

Scratch tables
    Everything that outlives a stage is written below ``spark.checkpoint.dir``,
    which all executors share, so a lost executor costs a re-read and no rerun.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import ensure_checkpoint_dir

SHINGLE_WORDS = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CACHE_LIMIT = 250_000
# Odd multipliers that give each of five places its own weight.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                   dtype=np.uint64)
# Word hashes are polynomials in _BASE over a 64-bit value per byte (from a fixed seed), modulo 2^64.
_BASE = 0x2545F4914F6CDD1D
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240521)).integers(1, 2 ** 64, 256, dtype=np.uint64)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_PIECE_BYTES = 1 << 20  # bytes hashed at once; a longer word makes a longer piece


class BoundedCache(dict):
    """Dictionary that computes missing values and holds two generations at most.

    A full dictionary becomes the old generation; values still in use move over
    from it without being computed again.
    """

    def __init__(self, compute: Callable, limit: int = _CACHE_LIMIT):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words of a text (null: none), lower-cased over A-Z, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, as far as needed."""

    up = _powers(_BASE, _PIECE_BYTES + 1)
    down = _powers(pow(_BASE, -1, 1 << 64), _PIECE_BYTES + 1)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(cls.up):
            return cls.up[:n], cls.down
        return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def _piece_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every white-space word of some bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    white = _WHITE[data].view(np.int8)
    turns = np.diff(white, prepend=1, append=1)
    starts, ends = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    up, down = _Powers.to(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at white space."""
    at = 0
    while len(raw) - at > _PIECE_BYTES:
        end = at + _PIECE_BYTES
        cut = max(raw.rfind(w, at, end) for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < at:
            found = [k for k in (raw.find(w, end) for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if k >= 0]
            cut = min(found, default=len(raw) - 1)
        yield raw[at:cut + 1]
        at = cut + 1
    yield raw[at:]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the texts' offsets."""
    lengths = np.zeros(len(texts), dtype=np.int64)
    parts: list[np.ndarray] = []
    group: list[bytes] = []
    first = size = 0

    def flush(upto: int) -> None:
        nonlocal group, first, size
        if group:
            begins = np.cumsum([0] + [len(r) + 1 for r in group[:-1]])
            h, starts = _piece_hashes(b" ".join(group))
            lengths[first:upto] = np.bincount(np.searchsorted(begins, starts, side="right") - 1, minlength=len(group))
            parts.append(h)
        group, first, size = [], upto, 0

    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass").translate(_LOWER) if text else b""
        if size + len(raw) >= _PIECE_BYTES:
            flush(i)
        if len(raw) >= _PIECE_BYTES:
            own = [_piece_hashes(p)[0] for p in _pieces(raw)]
            parts += own
            lengths[i] = sum(map(len, own))
            first = i + 1
        else:
            group.append(raw)
            size += len(raw) + 1
    flush(len(texts))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return (np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)), offsets


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, and the texts' offsets."""
    h, offsets = word_hashes(texts)
    width = SHINGLE_WORDS
    flat = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
    for j in range(width):
        flat += h[j:len(flat) + j] * _PLACES[j]
    flat = mix64(flat)
    sets, sizes = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        n = b - a
        if n >= width:
            s = np.sort(flat[a:b - width + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif n:  # a short sequence never equals the start of a longer one
            s = mix64((h[a:b] * _PLACES[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            continue
        sets.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)), np.cumsum(sizes)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    return shingle_sets([text])[0]


def ngram_hashes(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the 0- to ``order``-grams of letters that end at every letter.

    A word is preceded by order - 1 pads and closed by an end letter. Returns
    (hashes by order, positions of the letters and ends, the word of each).
    """
    text = "".join("\x02" * (order - 1) + w + "\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    n = len(codes)
    hashes = [np.zeros(n, dtype=np.uint64)]
    total = np.zeros(n, dtype=np.uint64)
    for j in range(order):
        total = total.copy()
        total[j:] += mix64(codes[:n - j] * _PLACES[j])
        hashes.append(mix64(total + np.uint64(j + 1)))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(word)) + (word + 1) * (order - 1)
    return hashes, at, word


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name for scratch tables below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table once and read it back: cuts the lineage on shared storage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that carry texts (a text may be very long)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function over single record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, modulus: int):
    """Remainder of crc32(doc_id as text), the split of labelled rows."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus
