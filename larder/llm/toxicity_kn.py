"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary texts,
give each letter of a word its probability after the four letters before it
(word edges are letters too, so a stem with a new ending is still recognised).
Only the highest order counts by class; all lower orders are continuation
counts pooled over both classes, so a rare expression falls back on the same
shared model on either side and the two log-likelihoods stay comparable.

Learning counts n-grams of all learnable labelled rows and of no others: tasks
count words, expand each distinct word once, and Spark sums the distinct
n-grams. The tables are keyed by the full 64-bit hash of an n-gram or context
and grow with the corpus.

Scoring rests on three facts of the model. A letter whose context of four
letters occurs in no labelled word backs off to the shared orders on either
side: its difference is 0. Where the context occurs but the 5-gram does not, the
shared orders cancel, and the difference is one number per context. Only 5-grams
that labelled words hold need the lower orders, and these end in n-grams of
labelled words again. So the model is two tables, of seen 5-grams and of their
contexts, and no n-gram of the other words is ever counted or stored.

If both tables hold ``MODEL_ROWS`` rows at most (counted, not guessed), they are
broadcast as sorted arrays and documents are described in one pass. Beyond, the
letters of the corpus's distinct words are joined to them, words without a
labelled context falling out first, which gives a stored word table: its
commonest words (``COMMON_WORDS``, ``COMMON_LETTERS`` at most) are broadcast and
the others reach their documents by a shuffle join. Both ways give the same
figures. A document is described by the length-normalised difference, its
largest word differences and its length, and a logistic regression over a
held-back fold of the learnable rows (a bounded sample, ``CALIBRATION_ROWS``)
turns that into a score.

Defined cases: a null, empty or blank text has difference 0 everywhere and
gets the score of that; without learnable rows of both classes every score is
the share of toxic rows (0 if there are none) and nothing else is learned;
rows that repeat an id are scored row by row; an empty table gives an empty
result; other columns are not touched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import drop_path, fold, map_batches, ngram_hashes, shared_dir, small_batches, stored

ORDER = 5
DISCOUNT = 0.75
ALPHABET = 4096  # letters of the uniform model below the lowest order
CALIBRATION_ROWS = 20_000
MODEL_ROWS = 2_000_000  # rows of the model that are broadcast at most (16 bytes each)
COMMON_WORDS, COMMON_LETTERS = 200_000, 4_000_000  # what the broadcast part of the word table holds at most
_FLUSH_WORDS = 300_000
_CHUNK_LETTERS = 1_000_000
FEATURES = ["mean_diff", "top1", "top3", "strong_share", "mild_share", "log_words"]


def split_words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def count_batches(batches: Iterator[pa.RecordBatch], toxic: bool = True) -> Iterator[pa.RecordBatch]:
    """word, n, n_ord, n_tox over batches (text and, if ``toxic``, its class; else n_ord and n_tox are 0), in bounded stretches."""

    def rows(counts: list[Counter]) -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        by_class = [np.fromiter((c[w] for w in words), dtype=np.int64, count=len(words)) for c in counts]
        by_class = by_class if toxic else [np.zeros(len(words), dtype=np.int64)] * 2
        n = np.zeros(len(words), dtype=np.int64) if toxic else np.fromiter((counts[0][w] for w in words), dtype=np.int64, count=len(words))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n), *map(pa.array, by_class)], names=["word", "n", "n_ord", "n_tox"])

    counts = [Counter(), Counter()]
    for batch in batches:
        classes = batch.column(1).to_pylist() if toxic else [0] * batch.num_rows
        for text, c in zip(batch.column(0).to_pylist(), classes):
            counts[1 if c else 0].update(split_words(text))
        if len(counts[0]) + len(counts[1]) > _FLUSH_WORDS:
            yield rows(counts)
            counts = [Counter(), Counter()]
    if counts[0] or counts[1]:
        yield rows(counts)


def count_words(df: DataFrame) -> DataFrame:
    """word, n, n_ord, n_tox (these two 0) of tasks' rows; ``df``: text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_batches(batches, toxic=False)

    return df.select("text").mapInArrow(run, "word string, n bigint, n_ord bigint, n_tox bigint")


def dealt_words(words: DataFrame) -> DataFrame:
    """Distinct words with their counts and a chunk number; a chunk has about ``_CHUNK_LETTERS`` letters or one long word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, letters = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = np.empty(batch.num_rows, dtype=np.int64)
            for i, word in enumerate(batch.column(0).to_pylist()):
                if letters > _CHUNK_LETTERS:
                    chunk, letters = chunk + 1, 0
                letters += len(word) + ORDER
                numbers[i] = chunk
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=["word", "n", "n_ord", "n_tox", "chunk"])

    sums = words.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "n_ord", "n_tox")))
    return sums.mapInArrow(run, "word string, n bigint, n_ord bigint, n_tox bigint, chunk bigint")


def _expanded(words: list[str], counts: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct n-grams of counted words: o, h, ctx, suf, mid, n_ord, n_tox.

    ``ctx``, ``suf`` and ``mid`` are the hashes of the context, of the n-gram
    without its first letter, and of that one's context.
    """
    hashes, at, word = ngram_hashes(words, ORDER)
    by_class = [c.astype(np.float64)[word] for c in counts]
    cols: list[list[np.ndarray]] = [[] for _ in range(7)]
    for o in range(1, ORDER + 1):
        h, first, inverse = np.unique(hashes[o][at], return_index=True, return_inverse=True)
        spot = at[first]
        parts = [np.full(len(h), o, dtype=np.int32)]
        parts += [x.view(np.int64) for x in (h, hashes[o - 1][spot - 1], hashes[o - 1][spot], hashes[max(o - 2, 0)][spot - 1])]
        parts += [np.bincount(inverse, weights=w, minlength=len(h)).astype(np.int64) for w in by_class]
        for col, part in zip(cols, parts):
            col.append(part)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["o", "h", "ctx", "suf", "mid", "n_ord", "n_tox"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of (word, ...) put together to about ``_CHUNK_LETTERS`` letters."""
    held, letters = [], 0
    for batch in batches:
        held.append(batch)
        letters += batch.column(0).nbytes
        if letters > _CHUNK_LETTERS:
            yield pa.Table.from_batches(held)
            held, letters = [], 0
    if held:
        yield pa.Table.from_batches(held)


_GRAMS = "o int, h bigint, ctx bigint, suf bigint, mid bigint, n_ord bigint, n_tox bigint"


def expand_words(words: DataFrame) -> DataFrame:
    """Distinct n-grams of distinct words (word, n_ord, n_tox) with their counts by class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            yield _expanded(t.column(0).to_pylist(), [t.column(1).to_numpy(), t.column(2).to_numpy()])

    return _summed(words.select("word", "n_ord", "n_tox").mapInArrow(run, _GRAMS))


def _summed(found: DataFrame) -> DataFrame:
    return found.groupBy("o", "h").agg(*(F.first(c).alias(c) for c in ("ctx", "suf", "mid")),
                                       F.sum("n_ord").alias("n_ord"), F.sum("n_tox").alias("n_tox"))


def count_ngrams(rows: DataFrame) -> DataFrame:
    """Distinct n-grams with their counts by class; ``rows``: text, toxic. Tasks expand their own distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in count_batches(batches):
            yield _expanded(b.column("word").to_pylist(), [b.column("n_ord").to_numpy(), b.column("n_tox").to_numpy()])

    return _summed(rows.select("text", "toxic").mapInArrow(run, _GRAMS))


def model_tables(grams: DataFrame, scratch: str | None = None) -> dict[str, DataFrame]:
    """Kneser-Ney tables by full hash, stored: ``num`` (o, key, num_a, num_b) of n-grams, ``tot`` (o, key, tot_*, typ_*) of contexts.

    Side a is the ordinary class and b the toxic one at the top order; below it
    both are the same. N-grams without a count in either class are left out.
    """
    spark, one, o = grams.sparkSession, F.lit(1), F.col("o")
    scratch = scratch or shared_dir(spark, "kneser-ney")
    grams = grams.filter("n_ord + n_tox > 0")

    def entry(order, key, **values):
        return F.struct(order.cast("int").alias("o"), F.col(key).alias("key"), *(F.lit(v).cast("bigint").alias(k) for k, v in values.items()))

    def table(name: str, top, below, *lowest) -> DataFrame:
        none = F.slice(F.array(top), 1, 0)
        rows = grams.select(F.inline(F.concat(F.when(o == ORDER, F.array(top)).otherwise(none), F.when(o > 1, F.array(below)).otherwise(none),
                                              *(F.when(o < ORDER, F.array(x)).otherwise(none) for x in lowest))))
        sums = rows.groupBy("o", "key").agg(*(F.sum(c).cast("double").alias(c) for c in rows.columns[2:]))
        return stored(sums, f"{scratch}/{name}")

    return {"num": table("numbers", entry(o, "h", num_a=F.col("n_ord"), num_b=F.col("n_tox")), entry(o - 1, "suf", num_a=one, num_b=one)),
            "tot": table("contexts", entry(o, "ctx", tot_a=F.col("n_ord"), tot_b=F.col("n_tox"), typ_a=F.col("n_ord") > 0, typ_b=F.col("n_tox") > 0),
                         entry(o - 1, "mid", tot_a=one, tot_b=one, typ_a=0, typ_b=0),
                         entry(o, "ctx", tot_a=0, tot_b=0, typ_a=one, typ_b=one))}


def gram_differences(grams: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """h, diff: log-likelihood of the last letter of every top-order n-gram, toxic minus ordinary; ``grams``: o, h, ctx, suf."""
    below = None
    for o in range(1, ORDER + 1):
        level = grams.filter(F.col("o") == o).select("h", "ctx", "suf")
        num = tables["num"].filter(F.col("o") == o).select(F.col("key").alias("h"), "num_a", "num_b")
        tot = tables["tot"].filter(F.col("o") == o).select(F.col("key").alias("ctx"), "tot_a", "tot_b", "typ_a", "typ_b")
        level = level.join(num, "h", "left").join(F.broadcast(tot) if o == 1 else tot, "ctx", "left")  # one empty context
        level = level.join(below, "suf", "left") if o > 1 else level.withColumn("low", F.lit(1.0 / ALPHABET))

        def p(side: str):
            tot, num = F.col(f"tot_{side}"), F.coalesce(F.col(f"num_{side}"), F.lit(0.0))
            own = F.greatest(num - DISCOUNT, F.lit(0.0)) / tot + DISCOUNT * F.col(f"typ_{side}") / tot * F.col("low")
            # At the top order nothing is cut off: the shared orders must cancel for n-grams that were not seen.
            return F.when(tot > 0, own if o == ORDER else F.least(F.greatest(own, F.lit(1e-12)), F.lit(1.0))).otherwise(F.col("low"))

        below = level.select(F.col("h").alias("suf"), p("a").alias("low"))
    return level.select("h", (F.log(p("b")) - F.log(p("a"))).alias("diff"))


def letter_table(grams: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(seen, key, diff): differences of the last letter of seen 5-grams, and of contexts for 5-grams that were not seen."""
    tot = tables["tot"].filter(F.col("o") == ORDER)

    def left(side: str):  # what the context leaves to the lower orders
        return F.when(F.col(f"tot_{side}") > 0, DISCOUNT * F.col(f"typ_{side}") / F.col(f"tot_{side}")).otherwise(F.lit(1.0))

    contexts = tot.select(F.lit(False).alias("seen"), "key", (F.log(left("b")) - F.log(left("a"))).alias("diff"))
    return gram_differences(grams, tables).select(F.lit(True).alias("seen"), F.col("h").alias("key"), "diff").unionByName(contexts)


class LetterModel:
    """The letter table as sorted arrays; keeps the differences of words it has met."""

    LIMIT = 300_000

    def __init__(self, table: pa.Table):
        kind, key, diff = (table.column(c).combine_chunks() for c in ("seen", "key", "diff"))
        kind, key, diff = kind.to_numpy(zero_copy_only=False), key.to_numpy(), diff.to_numpy()
        self.parts = []
        for seen in (True, False):
            keys, diffs = key[kind == seen], diff[kind == seen]
            order = np.argsort(keys)
            self.parts.append((keys[order], diffs[order]))
        self.known: dict[str, float] = {}

    @staticmethod
    def _found(part: tuple[np.ndarray, np.ndarray], asked: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        keys, diffs = part
        if not len(keys):
            return otherwise
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, diffs[at], otherwise)

    def score(self, words: list[str]) -> np.ndarray:
        """Difference of each word."""
        hashes, at, word = ngram_hashes(words, ORDER)
        diff = self._found(self.parts[1], hashes[ORDER - 1][at - 1].view(np.int64), np.zeros(len(at)))
        diff = self._found(self.parts[0], hashes[ORDER][at].view(np.int64), diff)
        return np.bincount(word, weights=diff, minlength=len(words))

    def of(self, texts: list[list[str]]) -> list[list[float]]:
        new = {w for words in texts for w in words if w not in self.known}
        if len(self.known) + len(new) > self.LIMIT:
            self.known, new = {}, {w for words in texts for w in words}
        group, letters = [], 0
        for w in new:
            group.append(w)
            letters += len(w)
            if letters > _CHUNK_LETTERS:
                self.known.update(zip(group, self.score(group).tolist()))
                group, letters = [], 0
        if group:
            self.known.update(zip(group, self.score(group).tolist()))
        return [list(map(self.known.__getitem__, words)) for words in texts]


def word_table(words: DataFrame, grams: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """word, n, diff, stored; ``words``: dealt words, stored; ``grams``: the n-grams of the labelled words, stored."""
    return joined_words(words, letter_table(grams, tables))


def joined_words(words: DataFrame, letters: DataFrame) -> DataFrame:
    """word, n, diff, stored, by joining the words' letters to the letter table."""
    def asked_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            hashes, at, word = ngram_hashes(t.column(0).to_pylist(), ORDER)
            chunks, own, before = t.column(1).to_numpy()[word], hashes[ORDER][at].view(np.int64), hashes[ORDER - 1][at - 1].view(np.int64)
            for chunk in np.unique(chunks):
                h, first = np.unique(own[chunks == chunk], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk)), pa.array(h), pa.array(before[chunks == chunk][first])],
                                                 names=["chunk", "h", "ctx"])

    def add_up(chunk: pa.Table, known: pa.Table) -> pa.Table:
        hashes, at, word = ngram_hashes(chunk.column("word").to_pylist(), ORDER)
        keys, diffs = known.column("h").combine_chunks().to_numpy(), known.column("diff").combine_chunks().to_numpy()
        order = np.argsort(keys)
        found = LetterModel._found((keys[order], diffs[order]), hashes[ORDER][at].view(np.int64), np.zeros(len(at)))
        sums = np.bincount(word, weights=found, minlength=chunk.num_rows)
        return pa.table({"word": chunk.column("word"), "n": chunk.column("n"), "diff": pa.array(sums)})

    asked = words.select("word", "chunk").mapInArrow(asked_letters, "chunk bigint, h bigint, ctx bigint").dropDuplicates(["chunk", "h"])
    contexts = letters.filter("not seen").select(F.col("key").alias("ctx"), F.col("diff").alias("unseen"))
    seen = letters.filter("seen").select(F.col("key").alias("h"), "diff")
    answers = asked.join(contexts, "ctx").join(seen, "h", "left").select("chunk", "h", F.coalesce("diff", "unseen").alias("diff"))
    scored = words.select("chunk", "word", "n").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        add_up, "word string, n bigint, diff double")
    return stored(scored.filter("word is not null"), shared_dir(words.sparkSession, "word-table"))


def word_differences(words: list[str], tables: dict[str, DataFrame]) -> np.ndarray:
    """Log-likelihood of each word under the toxic model minus under the ordinary one."""
    spark = tables["num"].sparkSession
    asked = stored(dealt_words(spark.createDataFrame([(w, 1, 0, 0) for w in words], "word string, n bigint, n_ord bigint, n_tox bigint")),
                   shared_dir(spark, "words"))
    known = {r["word"]: r["diff"] for r in word_table(asked, expand_words(asked), tables).collect()}
    return np.array([known[w] for w in words])


def common_words(words: DataFrame, most: int, letters: int) -> tuple[dict[str, float], bool]:
    """The differences of the words met most often, as many as the limits allow, and whether these are all words."""
    step = F.floor(F.log2("n"))
    least, n, size, whole = 64, 0, 0, True
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("size")).orderBy(F.desc("step")).collect():
        n, size = n + r["n"], size + r["size"]
        if n > most or size > letters:
            whole = False
            break
        least = r["step"]
    found = words.filter(step >= least).select("word", "diff").toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist())), whole


_PARTS = ["n", "total", "tops", "strong", "mild"]


def _described(df: DataFrame, differences, rare_words: bool) -> DataFrame:
    """Sums of every row's word differences; ``differences``: lists of words to lists of differences, None where not known."""
    id_type = df.schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, rare = [], []
        texts = [split_words(text) for text in batch.column(1).to_pylist()]
        for own, found in zip(texts, differences(texts)):
            rare.append([w for w, d in zip(own, found) if d is None] if rare_words else [])
            diffs = np.array([d for d in found if d is not None], dtype=np.float64)
            tops = np.sort(diffs[np.argpartition(diffs, -3)[-3:]] if len(diffs) > 3 else diffs)[::-1]
            out.append((len(diffs), float(diffs.sum()), tops.tolist(), int((diffs > 3.0).sum()), int((diffs > 1.5).sum())))
        types = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types)), pa.array(rare, pa.list_(pa.string()))],
                                          names=["id", *_PARTS, "rare"])

    return map_batches(df, run, f"id {id_type}, n bigint, total double, tops array<double>, strong bigint, mild bigint, rare array<string>")


def _features(seen: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n"), F.lit(1))
    top3 = F.aggregate("tops", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("tops"), F.lit(1))
    return seen.select("id", (F.col("total") / n).alias("mean_diff"), F.coalesce(F.try_element_at("tops", F.lit(1)), F.lit(0.0)).alias("top1"),
                       top3.alias("top3"), (F.col("strong") / n).alias("strong_share"), (F.col("mild") / n).alias("mild_share"),
                       F.log1p(F.col("n").cast("double")).alias("log_words"))


def features_by_letters(df: DataFrame, model: LetterModel) -> DataFrame:
    """FEATURES of every row (with its id) under a broadcast model."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return _features(_described(df, lambda texts: shared.value.of(texts), False))


def document_features(df: DataFrame, words: DataFrame, most: int | None = None, letters: int | None = None) -> DataFrame:
    """FEATURES of every row (with its id), from its whole text; ``words``: the stored word table (word, n, diff)."""
    spark = df.sparkSession
    common, whole = common_words(words, COMMON_WORDS if most is None else most, COMMON_LETTERS if letters is None else letters)
    shared = spark.sparkContext.broadcast(common)
    seen = _described(df, lambda texts: [[shared.value.get(w) for w in own] for own in texts], not whole)
    if not whole:
        seen = stored(seen.withColumn("_row", F.monotonically_increasing_id()), shared_dir(spark, "seen"))
        more = (seen.filter(F.size("rare") > 0).select("_row", F.explode("rare").alias("word")).join(words.select("word", "diff"), "word")
                .groupBy("_row").agg(F.count("*").alias("n"), F.sum("diff").alias("total"), F.slice(F.sort_array(F.collect_list("diff"), False), 1, 3).alias("tops"),
                                     F.sum((F.col("diff") > 3.0).cast("bigint")).alias("strong"), F.sum((F.col("diff") > 1.5).cast("bigint")).alias("mild"))
                .select("_row", *(F.col(c).alias(f"r_{c}") for c in _PARTS)))
        seen = seen.join(more, "_row", "left").select("id", *(
            F.slice(F.sort_array(F.concat("tops", F.coalesce("r_tops", F.slice("tops", 1, 0))), False), 1, 3).alias(c) if c == "tops"
            else (F.col(c) + F.coalesce(F.col(f"r_{c}"), F.lit(0))).alias(c) for c in _PARTS))
    return _features(seen)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps; returns (weights with intercept, means, scales)."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * len(x))
    penalty[0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def logistic_column(w: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    linear = F.lit(float(w[0]))
    for name, a, m, s in zip(FEATURES, w[1:], mean, scale):
        linear = linear + F.lit(float(a)) * (F.col(name) - F.lit(float(m))) / F.lit(float(s))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", folds: int = 5, held_out: int = 0, calibration: int = 1,
                   row_col: str | None = None) -> DataFrame:
    """One row per document: id, held_out, score, predicted; ``row_col``: a column that tells rows apart, returned too.

    Labels of fold ``held_out`` are never read; fold ``calibration`` fits the
    logistic regression and the other folds the two language models.
    """
    spark = docs.sparkSession
    small_batches(spark)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().dropDuplicates(["id"])
             .filter(fold("id", folds) != held_out))
    share = known.agg(F.avg("toxic")).first()[0]
    # A merge join whatever the sizes: both sides grow with the corpus.
    train = thin.filter((fold("id", folds) != held_out) & (fold("id", folds) != calibration)).join(
        known.filter(fold("id", folds) != calibration).hint("merge"), "id")
    scratch = shared_dir(spark, "kneser-ney")
    grams = stored(count_ngrams(train), f"{scratch}/ngrams")
    letters = stored(letter_table(grams, model_tables(grams, scratch)), f"{scratch}/letters")
    asked = thin if row_col is None else docs.select(
        F.struct(F.col(id_col).alias("id"), F.col(row_col).alias("row")).alias("id"), F.col(text_col).cast("string").alias("text"))
    if letters.count() <= MODEL_ROWS:
        features = features_by_letters(asked, LetterModel(letters.toArrow()))
    else:
        features = document_features(asked, joined_words(stored(dealt_words(count_words(thin)), f"{scratch}/words"), letters))
    if row_col is not None:
        features = features.select("id.id", F.col("id.row").alias(row_col), *FEATURES)
    out = stored(features, shared_dir(spark, "toxicity"))
    drop_path(spark, scratch)
    sample = (out.join(known.filter(fold("id", folds) == calibration), "id")
              .orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_ROWS).select(*FEATURES, "toxic").toPandas())
    y = sample["toxic"].to_numpy(dtype=float)
    if len(y) and 0 < y.mean() < 1:
        score = logistic_column(*fit_logistic(sample[FEATURES].to_numpy(), y))
    else:
        score = F.lit(float(share or 0.0))
    rows = [] if row_col is None else [row_col]
    return out.select(F.col("id").alias(id_col), *rows, F.coalesce(fold("id", folds) == held_out, F.lit(False)).alias("held_out"),
                      score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
