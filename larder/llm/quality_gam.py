"""Quality score by a generalised additive model with pairwise interactions.

Every document is described by measures of its whole text (characters, words,
lines). The model is a sum of lookup tables: one per measure and one per chosen
pair of measures. Tables are learned by cyclic boosting: round after round,
each measure in turn gets a shallow tree on its binned values (at most four
leaves) fitted to the current gradient, a fraction of which is added to its
table. Pairs are then ranked by how much of the remaining gradient a 2-d table
explains; the best ones are boosted the same way with quadrant trees. Scoring is
one bin look-up and addition per table, vectorised over Arrow batches.

Measures are computed by Spark over all documents and stored; the tables are
fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, by hash of the id).

Defined cases: null counts as empty text, whose measures are 0; without
learnable rows of both labels every score is the share of label 1 (0.5 if there
are no rows); rows that repeat an id are scored row by row; an empty table
gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import fold, map_batches, shared_dir, small_batches, stored

SAMPLE_ROWS = 40_000
BINS = 32
PAIR_BINS = 8
ROUNDS, PAIR_ROUNDS = 120, 40
PAIRS = 6
RATE = 0.1
MIN_LEAF = 5.0  # least hessian-weighted rows of a leaf, as rows / 4
MEASURES = ["log_chars", "log_words", "word_length", "upper", "digits", "stops", "shouts", "bars", "symbols", "white", "high_bytes",
            "distinct_words", "top_word", "same_as_last", "no_letter_words", "one_letter_words", "long_words",
            "repeated_lines", "words_per_line", "longest_line"]

_KINDS = {"upper": range(65, 91), "digits": range(48, 58), "stops": [44, 46, 58, 59], "shouts": [33, 63], "bars": [124],
          "symbols": [35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 126], "white": [9, 10, 11, 12, 13, 32],
          "high_bytes": range(128, 256)}
_BYTE_KINDS = np.zeros((256, len(_KINDS)))
for _k, _bytes in enumerate(_KINDS.values()):
    _BYTE_KINDS[list(_bytes), _k] = 1.0
_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))


def measure(text: str | None) -> list[float]:
    """MEASURES of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(MEASURES)
    kinds = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _BYTE_KINDS / len(raw)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    counts = Counter(words)
    plain = [len(w.translate(None, _LETTERS)) for w in words]
    return [float(np.log1p(len(raw))), float(np.log1p(len(words))), sum(plain) / n, *kinds.tolist(),
            len(counts) / n, max(counts.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
            plain.count(0) / n, plain.count(1) / n, sum(x > 15 for x in plain) / n,
            1.0 - len(set(lines)) / m, float(np.log1p(len(words) / m)), max(map(len, lines), default=0) / len(raw)]


def _best_cut(g: np.ndarray, h: np.ndarray, least: float, ridge: float = 1.0) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins (cut k: bins < k go left)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < least) | (hr < least)] = 0.0
    if not len(gain):
        return 0.0, 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Newton step per bin from a tree of two levels over binned gradient sums."""
    out = np.zeros(len(g))
    gain, cut = _best_cut(g, h, least)
    for lo, hi in ((0, cut), (cut, len(g))) if gain > 0 else ((0, len(g)),):
        inner, k = _best_cut(g[lo:hi], h[lo:hi], least) if hi - lo > 1 else (0.0, 0)
        for a, b in ((lo, lo + k), (lo + k, hi)) if inner > 0 else ((lo, hi),):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def quadrant_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Gain and Newton steps of the best 2 x 2 division of a 2-d table."""
    best, out = 0.0, np.zeros(g.shape)
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            quads = []
            for c in (cg, ch):
                a, row, col, full = c[i, j], c[i, -1], c[-1, j], c[-1, -1]
                quads.append(np.array([a, row - a, col - a, full - row - col + a]))
            qg, qh = quads
            gain = float((np.where(qh >= least, qg, 0) ** 2 / (qh + 1.0)).sum())
            if gain > best:
                step = np.where(qh >= least, qg / (qh + 1.0), 0.0)
                best = gain
                out = np.zeros(g.shape)
                out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = step
    return best, out


class AdditiveModel:
    """Lookup tables over binned measures and pairs of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
        share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self._fit(x, y)

    def _bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)]

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        bins, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
        total, least = np.full(len(y), self.base), MIN_LEAF / 4

        def gradient() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for b, table in zip(bins, self.tables):
                g, h = gradient()
                step = RATE * shallow_tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), least)
                table += step
                total += step[b]
        g, h = gradient()
        gains = []
        for i, j in combinations(range(x.shape[1]), 2):
            shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            at = coarse[i] * shape[1] + coarse[j]
            gain, _ = quadrant_tree(np.bincount(at, g, shape[0] * shape[1]).reshape(shape),
                                    np.bincount(at, h, shape[0] * shape[1]).reshape(shape), least)
            gains.append((gain, i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        self.pair_tables = [np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in zip(self.pairs, self.pair_tables):
                g, h = gradient()
                at = coarse[i] * table.shape[1] + coarse[j]
                _, step = quadrant_tree(np.bincount(at, g, table.size).reshape(table.shape),
                                        np.bincount(at, h, table.size).reshape(table.shape), least)
                table += RATE * step
                total += RATE * step.ravel()[at]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for b, table in zip(self._bins(x, self.edges), self.tables):
            total += table[b]
        coarse = self._bins(x, self.coarse)
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def measured(docs: DataFrame) -> DataFrame:
    """(id, MEASURES) of every row; ``docs``: id, text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in zip(*rows))], names=["id", *MEASURES])

    return map_batches(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, " + ", ".join(f"{m} double" for m in MEASURES))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row per document: id, held_out, score, predicted (labels of fold ``held_out`` are never read)."""
    spark = docs.sparkSession
    small_batches(spark)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
             .dropDuplicates(["id"]).filter(fold("id", folds) != held_out))
    table = stored(measured(thin), shared_dir(spark, "measures"))
    sample = table.join(known, "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select(*MEASURES, "label").toPandas()
    y = sample["label"].to_numpy(dtype=float)
    if len(y) and 0 < y.mean() < 1:
        model = spark.sparkContext.broadcast(AdditiveModel(sample[MEASURES].to_numpy(), y))
        constant = 0.5
    else:
        model, constant = None, float(y.mean()) if len(y) else 0.5

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
        score = model.value.scores(x) if model else np.full(len(x), constant)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    scored = map_batches(table, run, f"id {table.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold("id", folds) == held_out, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
