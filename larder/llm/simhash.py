"""SimHash near-duplicates by bit-sliced comparison.

A text's words (as in ``common.words_of``) form 3-word shingles joined by one
space, repeats included; a text of one or two words is one shingle. A bit of the
fingerprint is set if it is set in over half of the shingles' 64-bit hashes.
Fingerprints link at ``RADIUS`` or fewer differing bits.

Documents of equal fingerprint are one class from the first scan on. Candidates
come from ``TABLES``: the 64 bits are cut into eight bytes, and two fingerprints
that differ in two bits agree on six of them, so each of the 28 ways to leave
out two bytes is one table keyed by the other six. A key therefore holds at most
2^16 distinct fingerprints however hot it is, which bounds a group by
construction and needs no cap.

Rows sorted by (table, key) are cut into blocks of whole groups and compared bit
sliced: the block's fingerprints are stored as 64 bit planes, a machine word
holds one bit of 64 lanes, and a carry-save counter of two bit vectors adds the
difference planes to 64 distances at once, saturating beyond the radius. A word
whose 64 lanes all exceed the radius is abandoned after a few planes. Every pair
of a block within the radius is a link, in whichever group it was met. A block
reports its links as one star per connected set, never as pairs; components of
all stars come from min-label rounds (``graph``).

Defined cases: a null, empty or blank text has fingerprint zero and links like
any other; a null id is carried with the component of its class; rows that
repeat an id are members of their texts' classes; an empty table gives an empty
result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from larder.llm.common import map_batches, shared_dir, small_batches, stored, words_of
from larder.llm.graph import components

RADIUS = 2  # the counters saturate at 3
SHINGLE = 3
SEED = 42
BLOCK = 1024     # fingerprints compared at once; a larger group makes a larger block
_HASHES = 1 << 16  # hashes whose bits are counted at once
_STEP = 8        # planes between two looks for words to abandon
#: For each of the 28 tables the bits of its key: all but two bytes.
TABLES = [((1 << 64) - 1) ^ (0xFF << 8 * a) ^ (0xFF << 8 * b) for a, b in combinations(range(8), 2)]


def shingle_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's shingles, repeats included."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), dtype=np.uint64, count=len(words) - SHINGLE + 1)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Fingerprints of texts as signed 64-bit integers."""
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        h = shingle_hashes(text)
        sizes[i] = len(h)
        for at in range(0, len(h), _HASHES):
            part = h[at:at + _HASHES]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[i] += np.add.reduce(bits, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.int64).reshape(-1)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows; bit i of a row's words is that bit of fingerprint i, unused lanes are 0."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((lanes, 64), dtype=np.uint8)
    bits[:len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near_words(planes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word, lanes): the lanes within the radius of each query, words without one left out."""
    words = planes.shape[1]
    query = np.repeat(np.arange(len(queries)), words)
    word = np.tile(np.arange(words), len(queries))
    ones = np.zeros(len(query), dtype=np.uint64)
    twos, over = ones.copy(), ones.copy()
    # All-ones where the query's bit is set: planes are compared by one exclusive or.
    flips = (np.uint64(0) - np.unpackbits(queries.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.uint64))
    for j in range(64):
        apart = planes[j, word] ^ flips[query, j]
        carry = ones & apart
        ones ^= apart
        twos |= carry
        over |= twos & ones  # a third difference
        if j % _STEP == _STEP - 1:
            alive = ~over != 0
            if not alive.all():
                query, word, ones, twos, over = query[alive], word[alive], ones[alive], twos[alive], over[alive]
                if not len(query):
                    break
    return query, word, ~over


def block_stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, centre) that connect what links of a block's fingerprints connect."""
    n = len(fps)
    planes = bit_planes(fps)
    label = np.arange(n)
    chunk = max(1, (1 << 18) // planes.shape[1])
    for at in range(0, n, chunk):
        query, word, lanes = near_words(planes, fps[at:at + chunk])
        found = np.bincount(query, np.bitwise_count(lanes), minlength=min(chunk, n - at))
        busy = found[query] > 1  # more than the query itself
        query, word, lanes = query[busy], word[busy], lanes[busy]
        cuts = np.flatnonzero(np.diff(query, prepend=-1, append=n))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            bits = np.unpackbits(lanes[a:b].view(np.uint8), bitorder="little").reshape(b - a, 64)
            k, lane = np.nonzero(bits)
            member = word[a:b][k] * 64 + lane
            member = member[member < n]
            met = label[member]
            least = met.min()
            if (met != least).any():
                label[np.isin(label, met)] = least
    away = np.flatnonzero(label != np.arange(n))
    return fps[away], fps[label[away]]


def _key(fp: Column, table: int) -> Column:
    mask = TABLES[table]
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the groups of sorted rows (t, key, fp); groups of one are passed over."""
    masks = np.array(TABLES, dtype=np.uint64).view(np.int64)
    rest_t, rest = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
    pool: list[np.ndarray] = []
    held = 0

    def compared() -> Iterator[pa.RecordBatch]:
        nonlocal pool, held
        if held:
            a, b = block_stars(np.unique(np.concatenate(pool)))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        pool, held = [], 0

    def groups(t: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal held
        key = fp & masks[t]
        heads = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]))
        sizes = np.diff(heads, append=len(fp))
        for head, size in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            pool.append(fp[head:head + size])
            held += size
            if held >= BLOCK:
                yield from compared()

    for batch in batches:
        t = np.concatenate([rest_t, batch.column(0).to_numpy()])
        fp = np.concatenate([rest, batch.column(1).to_numpy()])
        if not len(fp):
            continue
        key = fp & masks[t]
        other = np.flatnonzero((t != t[-1]) | (key != key[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
        if cut:
            yield from groups(t[:cut], fp[:cut])
        rest_t, rest = t[cut:], fp[cut:]
    if len(rest):
        yield from groups(rest_t, rest)
    yield from compared()


def near_links(classes: DataFrame, fp_col: str = "fp") -> DataFrame:
    """Stars (a, b) over distinct fingerprints whose components are those of all links."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fp = F.col(fp_col)
    rows = classes.select(F.posexplode(F.array(*[_key(fp, i) for i in range(len(TABLES))])).alias("t", "key"), fp.alias("fp"))
    dealt = rows.repartition(parts, "t", "key").sortWithinPartitions("t", "key")
    return dealt.select("t", "fp").mapInArrow(_stars, "a bigint, b bigint")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (bigint), component_id."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist()))], names=["id", "fp"])

    prints = stored(map_batches(docs, scan, f"id {id_type}, fp bigint"), shared_dir(spark, "prints"))
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("rep")), shared_dir(spark, "classes"))
    links = stored(near_links(classes).distinct(), shared_dir(spark, "links"))
    labelled = classes.join(components(links).withColumnRenamed("v", "fp"), "fp", "left")
    smallest = labelled.filter("label is not null").groupBy("label").agg(F.min("rep").alias("smallest"))
    named = labelled.join(smallest, "label", "left").select("fp", F.coalesce("smallest", "rep").alias("component_id"))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def hex_print(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
