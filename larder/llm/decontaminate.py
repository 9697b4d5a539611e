"""Benchmark decontamination: short test items inside long documents.

A document holds an item when at least 80 % of the item's distinct 5-word
shingles occur in it (100 * common >= 80 * item size). Candidates come from
size-partitioned MinHash containment search: items are partitioned by set size
(powers of two); an item's sketch is its smallest shingles under a min-wise
hash, as many as its size class needs, n - ceil(0.8 n) + 1. A document that
holds the item misses at most n - ceil(0.8 n) of its shingles, so it contains
one of the sketch for certain, however long it is. Documents with fewer
distinct shingles than a size class needs are not searched for it. Candidates
are verified on the words themselves.

Items are the query set; they are taken in blocks of at most ``BLOCK_SHINGLES``
shingles (a longer item is a block of its own), each block is broadcast and all
documents are scanned against it, so the broadcast has a fixed bound whatever
the number of items.

Defined cases: null, empty or blank items and documents match nothing; one to
four words are one shingle; rows that repeat an id are searched row by row and
repeated items are reported under each of their ids; empty tables give an empty
result; other columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import SHINGLE_WORDS, map_batches, mix64, shared_dir, shingle_set, shingle_sets, small_batches, stored, words_of

PERCENT = 80
BLOCK_SHINGLES = 500_000
_MINWISE = np.uint64(0xD1342543DE82EF95)


def needed(n: int) -> int:
    """Shingles that a document must share with an item of n shingles."""
    return -(-PERCENT * n // 100)


def sketch(s: np.ndarray) -> np.ndarray:
    """Smallest shingles of a set under the min-wise hash: any holder has one of them."""
    order = np.argsort(mix64(s ^ _MINWISE), kind="stable")
    return s[order[:len(s) - needed(len(s)) + 1]]


def word_shingles(text: str | None) -> list[bytes]:
    """Shingles as their words, joined by one space, in text order."""
    words = words_of(text)
    if not words:
        return []
    width = min(len(words), SHINGLE_WORDS)
    return [b" ".join(words[i:i + width]) + (b"" if width == SHINGLE_WORDS else b" ") for i in range(len(words) - width + 1)]


class ItemIndex:
    """Sketches of one block of items by size class, and the items' shingles."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.shingles, by_class = [], [], {}
        for item, text in zip(ids, texts):
            s = shingle_set(text)
            if not len(s):
                continue
            row = len(self.ids)
            self.ids.append(item)
            self.shingles.append(frozenset(word_shingles(text)))
            by_class.setdefault(len(s).bit_length(), []).append((row, len(s), sketch(s)))
        # Per size class: fewest shingles a holder has, sketch hashes (ascending) and the item of each.
        self.classes = []
        for members in by_class.values():
            hashes = np.concatenate([k for _, _, k in members])
            rows = np.concatenate([np.full(len(k), row) for row, _, k in members])
            order = np.argsort(hashes, kind="stable")
            self.classes.append((min(needed(n) for _, n, _ in members), hashes[order], rows[order]))
        hashes = np.concatenate([c[1] for c in self.classes]) if self.classes else np.empty(0, np.uint64)
        self.all_hashes = np.unique(hashes)

    def candidates(self, found: np.ndarray, size: int) -> list[int]:
        """Items one of whose sketch shingles is among a document's sketch hits ``found``."""
        rows: set[int] = set()
        for fewest, hashes, owners in self.classes:
            if size >= fewest:
                lo, hi = np.searchsorted(hashes, found), np.searchsorted(hashes, found, side="right")
                for a, b in zip(lo.tolist(), hi.tolist()):
                    rows.update(owners[a:b].tolist())
        return sorted(rows)


def search_block(docs: DataFrame, index: ItemIndex) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    id_type, item_type = docs.schema["id"].dataType.simpleString(), "bigint"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        index = shared.value
        if not len(index.all_hashes):
            return None
        texts = batch.column(1).to_pylist()
        flat, offsets = shingle_sets(texts)
        spot = np.searchsorted(index.all_hashes, flat)
        spot[spot == len(index.all_hashes)] = 0
        hits = np.flatnonzero(index.all_hashes[spot] == flat)
        owner = np.searchsorted(offsets, hits, side="right") - 1
        out = []
        for row in np.unique(owner).tolist():
            rows = index.candidates(flat[hits[owner == row]], int(offsets[row + 1] - offsets[row]))
            if rows:
                words = set(word_shingles(texts[row]))
                for k in rows:
                    item = index.shingles[k]
                    common = len(item & words)
                    if 100 * common >= PERCENT * len(item):
                        out.append((row, index.ids[k], len(item), common))
        if not out:
            return None
        row, item, n, common = zip(*out)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()),
                                           pa.array(n, pa.int64()), pa.array(common, pa.int64())],
                                          names=["id", "item", "n_item_shingles", "n_common"])

    return map_batches(docs, run, f"id {id_type}, item {item_type}, n_item_shingles bigint, n_common bigint")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs (document, item) found: ids, n_item_shingles, n_common, containment."""
    spark = docs.sparkSession
    small_batches(spark)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Blocks by the items' running size; a word has two bytes at least, so chars / 2 bounds the shingles.
    sized = items.select(F.col(item_id_col).cast("bigint").alias("item"), F.col(item_text_col).cast("string").alias("text")).withColumn(
        "weight", F.coalesce(F.length("text"), F.lit(0)) / 2 + 1)
    blocks = int((sized.agg(F.sum("weight")).first()[0] or 0) // BLOCK_SHINGLES) + 1
    found = None
    for k in range(blocks):
        block = sized if blocks == 1 else sized.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        rows = block.select("item", "text").collect()  # one bounded block of the query set
        part = search_block(thin, ItemIndex([r["item"] for r in rows], [r["text"] for r in rows]))
        if blocks > 1:  # cut the plan: one stored table per block
            part = stored(part, shared_dir(spark, "found"))
        found = part if found is None else found.union(part)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), "n_item_shingles", "n_common",
                        (F.col("n_common") / F.col("n_item_shingles")).alias("containment"))
