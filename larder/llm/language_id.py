"""Language identification by spans: script ranges, word scores and Viterbi.

Words are runs of letters, lower-cased. A word's script (by Unicode range)
narrows the candidates to the languages that were learned in that script; each
candidate's score is the mean log-likelihood of the word's letter n-grams
(order 2 to 4, word edges included) times its letters. Along a text, Viterbi
picks the best label per word with a fixed penalty for a switch, which cuts a
mixed text into spans. A document's language is the one whose spans hold most
letters; its score is their share of all letters.

Learning counts n-grams of all learnable rows: tasks count words by language,
expand distinct words once and Spark sums by language and full 64-bit hash, so
the table grows with the n-grams that the rows hold and none shares a count.
Up to ``MODEL_ROWS`` rows of it are broadcast. Beyond that the distinct words of
the texts are joined to the table, and texts meet their words' scores in chunks
of bounded size; both ways give the same labels.

The recursion runs over a batch of texts at once, sorted by length: one array
step a word position for all texts that are that long.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
no span; without learnable rows every text is ``und``; ties go to the language
first in code order; rows that repeat an id are labelled row by row; an empty
table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import fold, map_batches, ngram_hashes, shared_dir, small_batches, stored

ORDER = 4
SMOOTH = 0.1
MODEL_ROWS = 2_000_000      # n-grams by language that a broadcast model may hold
CHUNK_LETTERS = 32_000_000  # of texts that meet their words' scores in one group, beyond that
SWITCH = 12.0   # log-likelihood that a switch of language costs
FAR = 50.0      # what a word costs a language that is not written in its script
SCRIPT_SHARE = 0.01  # least share of a language's letters for a script to be its own
UNKNOWN = "und"
_FLUSH_WORDS = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")

# First code points of Unicode script ranges, with the script that starts there.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1780, "khmer"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2D00, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


def words_of_letters(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def script_of(words: list[str]) -> np.ndarray:
    """Script number of each word, by its first letter."""
    first = np.fromiter((ord(w[0]) for w in words), dtype=np.int64, count=len(words))
    return _SCRIPT_OF[np.searchsorted(_STARTS, first, side="right") - 1]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each one's weights."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=weights, minlength=len(found)).astype(np.int64)


def _count_rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """(lang, o, h, n): n-grams of order o by hash; order 0 counts letters by script."""
    for lang, counter in counts.items():
        words = list(counter)
        weight = np.fromiter(counter.values(), dtype=np.float64, count=len(words))
        hashes, at, word = ngram_hashes(words, ORDER)
        letters = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
        sums = [(0, *_summed(script_of(words).astype(np.int64), weight * letters))]
        sums += [(o, *_summed(hashes[o][at].view(np.int64), weight[word])) for o in range(2, ORDER + 1)]
        for o, keys, n in sums:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), o, dtype=np.int32)),
                                              pa.array(keys), pa.array(n)], names=["lang", "o", "h", "n"])


def count_by_language(rows: DataFrame) -> DataFrame:
    """(lang, o, h, n) over all rows; ``rows``: text, lang."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of_letters(text)
                if words:
                    counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > _FLUSH_WORDS:
                yield from _count_rows(counts)
                counts = {}
        yield from _count_rows(counts)

    found = rows.select("text", "lang").mapInArrow(run, "lang string, o int, h bigint, n bigint")
    return found.groupBy("lang", "o", "h").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log-likelihoods of n-grams by language, and each language's scripts.

    An n-gram met n times in a language is worth ln((n + SMOOTH) / size), which is what any unseen one is worth there,
    ln(SMOOTH / size), and a gain of ln(n / SMOOTH + 1).
    """

    def __init__(self, letters: list, totals: list, kinds: dict[int, int], grams: pa.Table | None = None):
        """``letters``: rows (lang, h, n) of order 0; ``totals``: rows (lang, o, n); ``kinds``: distinct n-grams by order; ``grams``: lang, o, h, n."""
        self.langs = sorted({r["lang"] for r in letters})
        at = {lang: i for i, lang in enumerate(self.langs)}
        written = np.zeros((len(SCRIPT_NAMES), len(at)))
        for r in letters:
            written[r["h"], at[r["lang"]]] = r["n"]
        self.written = written >= SCRIPT_SHARE * np.maximum(written.sum(axis=0), 1)
        size = np.ones((ORDER - 1, len(at)))
        for r in totals:
            size[r["o"] - 2, at[r["lang"]]] = r["n"] + SMOOTH * (kinds[r["o"]] + 1)
        self.unseen = np.log(SMOOTH / size).mean(axis=0)
        self.parts = []
        if grams is not None:
            order, h, n = (grams.column(c).combine_chunks().to_numpy() for c in ("o", "h", "n"))
            lang = np.fromiter(map(at.__getitem__, grams.column("lang").to_pylist()), dtype=np.int64, count=len(h))
            for o in range(2, ORDER + 1):
                own = order == o
                keys, spot = np.unique(h[own], return_inverse=True)
                gains = np.zeros((len(keys), len(at)))
                gains[spot, lang[own]] = np.log(n[own] / SMOOTH + 1)
                self.parts.append((keys, gains))

    def gains(self, words: list[str]) -> np.ndarray:
        """Sum of the gains of every word's n-grams for every language (rows: words)."""
        hashes, at, word = ngram_hashes(words, ORDER)
        total = np.zeros((len(words), len(self.langs)))
        for o, (keys, gains) in enumerate(self.parts, 2):
            if not len(keys):
                continue
            asked = hashes[o][at].view(np.int64)
            spot = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            seen = np.flatnonzero(keys[spot] == asked)
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(word[seen], weights=gains[spot[seen], k], minlength=len(words))
        return total

    def scored(self, words: list[str], gains: np.ndarray) -> np.ndarray:
        """Score of every word for every language, from its gains."""
        letters = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
        total = (letters + 1)[:, None] * self.unseen + gains / (ORDER - 1)
        own = self.written[script_of(words)]
        total[~own & own.any(axis=1)[:, None]] -= FAR
        total[~own.any(axis=1)] = 0.0  # a script that no language was learned in tells nothing
        return total

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Score of every word for every language (rows: words)."""
        return self.scored(words, self.gains(words))


class StoredModel:
    """A model whose n-grams stay in a stored table: lang, o, h, n."""

    def __init__(self, frame: LanguageModel, grams: DataFrame):
        self.frame, self.grams = frame, grams


class AnsweredWords:
    """The scores of words whose gains came from a join; a word without any gain is not listed."""

    def __init__(self, frame: LanguageModel, answers: pa.Table):
        self.frame, self.langs = frame, frame.langs
        at = {lang: i for i, lang in enumerate(frame.langs)}
        names = answers.column("word").to_pylist()
        self.spot = {w: i for i, w in enumerate(dict.fromkeys(names))}
        self.found = np.zeros((len(self.spot) + 1, len(at)))  # the last row for all others
        for w, lang, gain in zip(names, answers.column("lang").to_pylist(), answers.column("gain").to_pylist()):
            self.found[self.spot[w], at[lang]] = gain

    def word_scores(self, words: list[str]) -> np.ndarray:
        return self.frame.scored(words, self.found[[self.spot.get(w, len(self.spot)) for w in words]])


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi labels of a text's words: score sums less ``switch`` per change of label."""
    return best_paths(scores, np.array([len(scores)]), switch)


def best_paths(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi labels of the words of several texts; ``scores`` holds their words one text after the other."""
    n, m = scores.shape
    path = np.zeros(n, dtype=np.int64)
    if m == 1 or not n:
        return path
    order = np.argsort(-lengths, kind="stable")
    starts, longest = (np.cumsum(lengths) - lengths)[order], int(lengths.max())
    live = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # texts longer than a position
    back = np.empty((n, m), dtype=np.int16)
    stay = np.arange(m, dtype=np.int16)
    best = scores[starts[:live[0]]]
    ends = np.empty(len(lengths), dtype=np.int64)
    for i in range(1, longest + 1):
        k = live[i] if i < longest else 0
        if k < len(best):
            ends[k:len(best)] = best[k:].argmax(axis=1)  # these texts end here
            best = best[:k]
        if not k:
            break
        top = best.argmax(axis=1)
        other = best[np.arange(k), top] - switch
        moved = other[:, None] > best
        at = starts[:k] + i
        back[at] = np.where(moved, top[:, None], stay)
        best = np.maximum(best, other[:, None]) + scores[at]
    label = ends[:0]
    for i in range(longest - 1, -1, -1):
        k = live[i]
        label = np.concatenate([label, ends[len(label):k]])
        at = starts[:k] + i
        path[at] = label
        label = back[at, label].astype(np.int64) if i else label
    return path


class SpanLabeller:
    """Labels texts with a model; keeps the scores of words it has met."""

    LIMIT = 300_000
    WORDS = 1_000_000  # words labelled at once; a longer text is taken alone

    def __init__(self, model: LanguageModel | AnsweredWords):
        self.model = model
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(model.langs)))
        self.letters = np.empty(0)

    def learn(self, texts: list[list[str]]) -> None:
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > self.LIMIT:
            self.known, self.rows, self.letters = {}, self.rows[:0], self.letters[:0]
            new = set().union(*texts)
        if new:
            new = sorted(new)
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, self.model.word_scores(new)])
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, new), dtype=np.float64, count=len(new))])

    def _at(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        words = map(self.known.__getitem__, chain.from_iterable(texts))
        return np.fromiter(words, dtype=np.int64, count=int(lengths.sum())), lengths

    def path(self, words: list[str]) -> np.ndarray:
        at, _ = self._at([words])
        return best_path(self.rows[at])

    def verdicts(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """(language, share of the letters) of each text; ``texts``: words that were learned."""
        out: list[tuple[str, float]] = []
        group: list[list[str]] = []
        size = 0
        for words in texts:
            if group and size + len(words) > self.WORDS:
                out += self._verdicts(group)
                group, size = [], 0
            group.append(words)
            size += len(words)
        return out + self._verdicts(group)

    def _verdicts(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        at, lengths = self._at(texts)
        m = len(self.model.langs)
        place = np.repeat(np.arange(len(texts)), lengths) * m + best_paths(self.rows[at], lengths)
        held = np.bincount(place, weights=self.letters[at], minlength=len(texts) * m).reshape(-1, m)
        total = held.sum(axis=1)
        first, share = held.argmax(axis=1).tolist(), (held.max(axis=1) / np.maximum(total, 1)).tolist()
        return [(self.model.langs[k], s) if n else (UNKNOWN, 0.0) for k, s, n in zip(first, share, lengths.tolist())]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of the spans of a text, in its lower-cased code points."""
        found = [(m.start(), m.end(), m.group()) for m in _LETTERS.finditer((text or "").lower())]
        if not found:
            return []
        path = self.path([w for _, _, w in found])
        cuts = np.flatnonzero(np.diff(path)) + 1
        return [(found[a][0], found[b - 1][1], self.model.langs[path[a]])
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(found)])]


def learn_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel | StoredModel | None:
    """Model from the given rows with a language; None if there are none."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null")
    counts = stored(count_by_language(rows), shared_dir(spark, "languages"))
    letters = counts.filter("o = 0").collect()  # scripts by language
    if not letters:
        return None
    grams = counts.filter("o > 0")
    totals = grams.groupBy("lang", "o").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    kinds = {r["o"]: r["kinds"] for r in grams.select("o", "h").distinct().groupBy("o").agg(F.count(F.lit(1)).alias("kinds")).collect()}
    if sum(r["rows"] for r in totals) <= MODEL_ROWS:
        return LanguageModel(letters, totals, kinds, grams.toArrow())
    return StoredModel(LanguageModel(letters, totals, kinds), grams)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
_VERDICT = "lang_pred string, score double"
_SPANS_DDL = "spans array<struct<start:bigint,end:bigint,lang:string>>"


def _verdict_columns(labeller: SpanLabeller | None, texts: list[str | None], with_spans: bool) -> dict[str, pa.Array]:
    if labeller is None:
        verdicts, spans = [(UNKNOWN, 0.0)] * len(texts), [[] for _ in texts]
    else:
        words = [words_of_letters(t) for t in texts]
        labeller.learn(words)
        verdicts = labeller.verdicts(words)
        spans = [[dict(zip(("start", "end", "lang"), s)) for s in labeller.spans(t)] for t in texts] if with_spans else []
    cols = {"lang_pred": pa.array([v[0] for v in verdicts], pa.string()), "score": pa.array([v[1] for v in verdicts], pa.float64())}
    return cols | ({"spans": pa.array(spans, _SPANS)} if with_spans else {})


def _label_by_broadcast(thin: DataFrame, model: LanguageModel | None, schema: str, with_spans: bool) -> DataFrame:
    shared = thin.sparkSession.sparkContext.broadcast(model)
    kept: list[SpanLabeller] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not kept and shared.value is not None:
            kept.append(SpanLabeller(shared.value))
        cols = _verdict_columns(kept[0] if kept else None, batch.column(1).to_pylist(), with_spans)
        return pa.RecordBatch.from_arrays([batch.column(0), *cols.values()], names=["id", *cols])

    return map_batches(thin, run, f"id {thin.schema['id'].dataType.simpleString()}, {schema}")


def _label_by_join(thin: DataFrame, model: StoredModel, schema: str, with_spans: bool) -> DataFrame:
    """Distinct texts are labelled in chunks that ask for each of their words once; rows find their text's verdict by digest."""
    spark, frame = thin.sparkSession, model.frame
    text = F.coalesce("text", F.lit(""))
    keyed = thin.select("id", F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    letters = keyed.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    texts = stored(keyed.groupBy("digest").agg(F.first("text").alias("text")).withColumn(
        "chunk", F.pmod(F.xxhash64("digest"), F.lit(letters // CHUNK_LETTERS + 1))), shared_dir(spark, "texts"))

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = list(dict.fromkeys((c, w) for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in words_of_letters(t)))
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in pairs], pa.int64()), pa.array([w for _, w in pairs], pa.string())],
                                          names=["chunk", "word"])

    def grams_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, at, word = ngram_hashes(batch.column(0).to_pylist(), ORDER)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.tile(word, ORDER - 1))),
                                           pa.array(np.repeat(np.arange(2, ORDER + 1, dtype=np.int32), len(at))),
                                           pa.array(np.concatenate([hashes[o][at] for o in range(2, ORDER + 1)]).view(np.int64))],
                                          names=["word", "o", "h"])

    def label(rows: pa.Table, answers: pa.Table) -> pa.Table:
        cols = _verdict_columns(SpanLabeller(AnsweredWords(frame, answers)), rows.column("text").to_pylist(), with_spans)
        return pa.table({"digest": rows.column("digest"), **cols})

    asked = stored(map_batches(texts.select("chunk", "text"), words, "chunk bigint, word string").distinct(), shared_dir(spark, "words"))
    pieces = map_batches(asked.select("word").distinct(), grams_of, "word string, o int, h bigint")
    gains = pieces.join(model.grams, ["o", "h"]).groupBy("word", "lang").agg(F.sum(F.log(F.col("n") / SMOOTH + 1)).alias("gain"))
    answers = asked.join(gains, "word").select("chunk", "word", "lang", "gain")
    verdicts = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(label, f"digest binary, {schema}")
    return keyed.select("id", "digest").join(verdicts, "digest").drop("digest")


def label_languages(docs: DataFrame, model: LanguageModel | StoredModel | None, id_col: str = "doc_id", text_col: str = "text",
                    with_spans: bool = False) -> DataFrame:
    """id, lang_pred, score (and the spans of the lower-cased text) of every row."""
    small_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"{_VERDICT}, {_SPANS_DDL}" if with_spans else _VERDICT
    label = _label_by_join if isinstance(model, StoredModel) else _label_by_broadcast
    return label(thin, model, schema, with_spans).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 5, held_out: int = 0) -> DataFrame:
    """id, held_out, lang_pred, score; learned from the rows outside fold ``held_out``."""
    model = learn_languages(docs.filter(fold(id_col, folds) != held_out), text_col, lang_col)
    return label_languages(docs, model, id_col, text_col).select(
        id_col, F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
