"""Personal data: fixed patterns, and spans that a linear-chain CRF adds.

Base spans come from four patterns (email, ip, card, phone), read so that each
costs time linear in the text. The conditional random field labels white-space
words with one of these kinds or none. Its features are word shapes: runs of
letters, digits and marks, lengths, ends, and whether the word is one of a few
cue words, for the word itself and its neighbours. It is trained by maximum
likelihood (forward-backward over padded batches, Adagrad) on a small labelled
table: the rows of ``LABELLED`` and a bounded number of lines of the given
documents, labelled by the base patterns.

Decoding is exact Viterbi. A word whose best label cannot beat "none" even with
the most favourable transitions on both sides is "none" on the best path;
between such words only short runs stay open, and runs of equal length are
decoded together as one numpy batch. A run's span is added if its path beats
the path without it by ``MARGIN`` and it overlaps no base span; base spans stay.

Defined cases: a null or empty text has no spans (the digest is that of the
empty string); rows that repeat an id are searched row by row; an empty table
gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_batches, small_batches

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
MARGIN = 4.0
TRAIN_LINES = 300     # most lines of the documents in the labelled table, half of them with base spans
LINE_WORDS = 60       # longest labelled line
EPOCHS = 120

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats: giving characters back could never lead to another match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and dotted domain."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            low = domain.end()
        else:
            low = at + 1
        at = text.find("@", low)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (2 if place % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, end exclusive; failing matches are dropped without a retry."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    out["email"] = emails(text)
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


# Hand-labelled lines. [kind text] marks a span.
LABELLED = [
    "Write to [email anna (at) example (dot) org] for details.",
    "Contact: [email j.smith at mail dot example dot com] or come by.",
    "my mail is [email paul [at] uni-nord [dot] de] thanks",
    "E-Mail: [email info(at)laden.example] und mehr",
    "reach me under [email maria.lopez(at)correo(dot)es] any time",
    "email [email bob_77 AT example DOT net] please",
    "Call [phone (555) 123-4567] before noon.",
    "Tel. [phone 0049 30 1234567] ab neun Uhr",
    "phone: [phone 555-867-5309] or at the desk",
    "fax [phone 030/9876543] Berlin",
    "tel [phone 01 44 55 66 77] le matin",
    "mobile [phone 07700 900123] after work",
    "Ring [phone (030) 555 1234] or write.",
    "card [card 4111.1111.1111.1111] expires soon",
    "credit card number [card 4012_8888_8888_1881] on file",
    "carte [card 5105.1051.0510.5100] valable",
    "host [ip 10[.]0[.]12[.]7] was down",
    "from [ip 192[.]168[.]3[.]44] at noon",
    "server [ip 172(.)16(.)9(.)1] answered",
    "We met at the station at nine.",
    "They looked at 12 houses and 340 trees in 2019.",
    "Version 2.10.3 of the file was saved on 12/04/2021.",
    "The order 4829104 has 17 parts at 12.50 each.",
    "at dot com was a word of the time",
    "Chapter 4 (at the end) has a dot in the line.",
    "In 1998 there were 1,204,331 people in 38 towns.",
    "page 12 of 30 | section 4.2.1 | row 88",
    "Room 101, floor 3, house 27 at the lake.",
    "From 10:30 to 12:45 on 2020-01-31.",
    "A phone call at night. The card game was long.",
    "ISBN 978-3-16-148410-0 is on the shelf.",
    "a total of 1234567890 points or 99.9 %",
    "token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" was set",
]
_CUES = frozenset("at dot mail email e-mail contact contacto kontakt tel telefon phone call mobile fax ring card carte tarjeta karte ip host server from".split())
_MARKED = re.compile(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[[^\[\]]*\])*)\]")


def labelled_line(line: str) -> tuple[list[str], list[int]]:
    """Words and labels of a marked line."""
    words, labels, at = [], [], 0
    for m in _MARKED.finditer(line):
        before, inside = line[at:m.start()].split(), m.group(2).split()
        words += before + inside
        labels += [0] * len(before) + [LABELS.index(m.group(1))] * len(inside)
        at = m.end()
    rest = line[at:].split()
    return words + rest, labels + [0] * len(rest)


def labelled_text(line: str) -> tuple[list[str], list[int]]:
    """Words and labels of a line by its base spans."""
    spans = base_spans(line)
    words, labels = [], []
    for m in re.finditer(r"\S+", line):
        kind = next((k for k, name in enumerate(KINDS, 1) if any(a < m.end() and m.start() < b for a, b in spans[name])), 0)
        words.append(m.group())
        labels.append(kind)
    return words, labels


def shape(word: str) -> str:
    """Runs of letters (a), digits (9) and other characters, each run once."""
    out = []
    for c in word[:40]:
        kind = "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:12])


def word_features(word: str) -> list[str]:
    """Shape features of a word."""
    bare = word.strip(".,;:!?\"'").lower()
    digits = sum(c.isdigit() for c in word)
    out = [f"s:{shape(bare)}", f"d:{min(digits, 8)}", f"l:{min(len(bare), 9)}"]
    if bare.strip("()[]") in _CUES:
        out.append(f"w:{bare}")
        out.append(f"c:{bare.strip('()[]')}")
    if "@" in word or "(at)" in bare or "[at]" in bare:
        out.append("at-sign")
    if digits and digits >= len(bare) - 4:
        out.append("mostly-digits")
    if not digits and bare.isalpha():
        out.append("letters")
    if word[:1] == "+":
        out.append("plus")
    return out


class ShapeCrf:
    """Linear-chain CRF over word shapes; unseen features weigh nothing."""

    def __init__(self, rows: list[tuple[list[str], list[int]]], epochs: int = EPOCHS):
        self.index: dict[str, int] = {}
        m = len(LABELS)
        coded = []
        for words, labels in rows:
            own = [word_features(w) for w in words]
            feats = []
            for i in range(len(words)):
                names = [f"0{f}" for f in own[i]]
                names += [f"-{f}" for f in (own[i - 1] if i else ["edge"])] + [f"+{f}" for f in (own[i + 1] if i + 1 < len(words) else ["edge"])]
                feats.append([self.index.setdefault(f, len(self.index)) for f in names])
            coded.append((feats, labels))
        self.weights = np.zeros((len(self.index) + 1, m))  # the last row is for padding
        self.moves = np.zeros((m, m))
        self._train(coded, epochs)

    def _train(self, coded: list, epochs: int) -> None:
        m, pad = len(LABELS), len(self.index)
        steps, width = max(len(l) for _, l in coded), max(len(f) for fs, _ in coded for f in fs)
        n = len(coded)
        feats = np.full((n, steps, width), pad)
        gold = np.zeros((n, steps), dtype=int)
        real = np.zeros((n, steps), dtype=bool)
        for i, (fs, labels) in enumerate(coded):
            for t, f in enumerate(fs):
                feats[i, t, :len(f)] = f
            gold[i, :len(labels)] = labels
            real[i, :len(labels)] = True
        eye, sum_w, sum_t = np.eye(m), np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)

        def lse(x, axis):
            top = x.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        for _ in range(epochs):
            emit = self.weights[feats].sum(axis=2)
            ahead = np.zeros((n, steps, m))
            ahead[:, 0] = emit[:, 0]
            for t in range(1, steps):
                step = lse(ahead[:, t - 1, :, None] + self.moves, 1) + emit[:, t]
                ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
            back = np.zeros((n, steps, m))
            for t in range(steps - 2, -1, -1):
                step = lse(self.moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(real[:, t + 1, None], step, 0.0)
            total = lse(ahead[:, -1], 1)
            mark = np.exp(ahead + back - total[:, None, None]) * real[:, :, None]
            diff = eye[gold] * real[:, :, None] - mark
            grad = np.zeros_like(self.weights)
            for k in range(width):
                np.add.at(grad, feats[:, :, k].ravel(), diff.reshape(-1, m))
            grad[pad] = 0.0
            grad -= 0.02 * self.weights
            grad_moves = np.zeros_like(self.moves)
            for t in range(1, steps):
                on = real[:, t]
                if on.any():
                    pair = np.exp(ahead[on, t - 1, :, None] + self.moves + (emit[on, t] + back[on, t])[:, None, :] - total[on, None, None])
                    grad_moves += np.einsum("ia,ib->ab", eye[gold[on, t - 1]], eye[gold[on, t]]) - pair.sum(axis=0)
            grad_moves -= 0.02 * self.moves
            sum_w += grad ** 2
            sum_t += grad_moves ** 2
            self.weights += 0.3 * grad / np.sqrt(sum_w)
            self.moves += 0.3 * grad_moves / np.sqrt(sum_t)
        self.weights[pad] = 0.0

    def parts(self, word: str | None) -> np.ndarray:
        """What a word adds to its own scores, to the next word's and to the previous one's."""
        names = word_features(word) if word is not None else ["edge"]
        return np.stack([sum((self.weights[self.index[s + f]] for f in names if s + f in self.index), np.zeros(len(LABELS)))
                         for s in "0-+"])

    def slack(self) -> float:
        """Most that transitions can add for a label in place of "none" between any neighbours."""
        t = self.moves
        return float((t[:, 1:].max(axis=0) + t[1:, :].max(axis=1)).max() - (t[:, 0].min() + t[0, :].min()))


def viterbi(emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best labels of equally long runs between "none" words, and their lead over "none" throughout.

    ``emit``: runs x steps x labels.
    """
    n, steps, m = emit.shape
    best = moves[0] + emit[:, 0]
    back = np.zeros((n, steps, m), dtype=np.int8)
    for t in range(1, steps):
        options = best[:, :, None] + moves
        back[:, t] = options.argmax(axis=1)
        best = options.max(axis=1) + emit[:, t]
    last = best + moves[:, 0]
    path = np.zeros((n, steps), dtype=np.int64)
    path[:, -1] = last.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = np.take_along_axis(back[:, t], path[:, t, None], axis=1)[:, 0]
    none = emit[:, :, 0].sum(axis=1) + (steps + 1) * moves[0, 0]
    return path, last.max(axis=1) - none


class SpanFinder:
    """Decodes batches of texts with a trained field."""

    LIMIT = 200_000

    def __init__(self, crf: ShapeCrf):
        self.crf, self.slack = crf, crf.slack()
        self.edge = crf.parts(None)
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, 3, len(LABELS)))

    def _emissions(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        part = self.rows[at]
        emit = part[:, 0].copy()
        emit[1:] += part[:-1, 1]
        emit[0] += self.edge[1]
        emit[:-1] += part[1:, 2]
        emit[-1] += self.edge[2]
        return emit

    def _learn(self, texts: list[list[str]]) -> None:
        new = {w for words in texts for w in words if w not in self.known}
        if len(self.known) + len(new) > self.LIMIT:
            self.known, self.rows = {}, self.rows[:0]
            new = {w for words in texts for w in words}
        if new:
            shapes: dict[tuple, np.ndarray] = {}
            rows = []
            for w in new:
                key = tuple(word_features(w))
                if key not in shapes:
                    shapes[key] = self.crf.parts(w)
                rows.append(shapes[key])
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, np.stack(rows)])

    def added(self, texts: list[str | None], taken: list[list[tuple[int, int]]]) -> list[dict[str, list[tuple[int, int]]]]:
        """Spans by kind that the field adds to each text beside the taken ones."""
        out = [{k: [] for k in KINDS} for _ in texts]
        split = [t.split() if t else [] for t in texts]
        self._learn(split)
        runs: dict[int, list[tuple[int, int, np.ndarray]]] = defaultdict(list)
        for row, words in enumerate(split):
            if not words:
                continue
            emit = self._emissions(words)
            open_words = (emit[:, 1:].max(axis=1) - emit[:, 0] + self.slack) > 0
            if open_words.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], open_words.view(np.int8), [0]])))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    runs[b - a].append((row, a, emit[a:b]))
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for length, members in runs.items():
            paths, leads = viterbi(np.stack([e for _, _, e in members]), self.crf.moves)
            for (row, a, _), path, lead in zip(members, paths, leads):
                if lead >= MARGIN:
                    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), length]
                    found[row] += [(a + x, a + y, int(path[x])) for x, y in zip(cuts, cuts[1:]) if path[x]]
        for row, spans in found.items():
            places = [m.span() for m in re.finditer(r"\S+", texts[row])]
            for a, b, label in spans:
                start, end = places[a][0], places[b - 1][1]
                text = texts[row][start:end]
                end -= len(text) - len(text.rstrip(".,;:!?\"'|"))
                start += len(text) - len(text.lstrip("\"'|"))
                if start < end and all(end <= x or y <= start for x, y in taken[row]):
                    out[row][KINDS[label - 1]].append((start, end))
        return out


def labelled_table(docs: DataFrame, lines: int = TRAIN_LINES) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: LABELLED and up to ``lines`` document lines (by hash) under the base patterns."""
    pieces = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter(
        (F.size(F.split("line", r"\s+")) <= LINE_WORDS) & (F.length("line") <= 20 * LINE_WORDS) & (F.trim("line") != ""))
    marked = pieces.filter(F.col("line").rlike(r"@|\d{3}"))
    plain = pieces.filter(~F.col("line").rlike(r"@|\d"))
    rows = [labelled_line(x) for x in LABELLED]
    for part in (marked, plain):
        rows += [labelled_text(r["line"]) for r in part.orderBy(F.xxhash64("line"), "line").limit(lines // 2).collect()]
    return rows


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crf: ShapeCrf | None = None) -> DataFrame:
    """id, base spans and added spans per kind (arrays of start, end), one row per document."""
    spark = df.sparkSession
    small_batches(spark)
    thin = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(crf or ShapeCrf(labelled_table(thin)))
    kept: list[SpanFinder] = []
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not kept:
            kept.append(SpanFinder(shared.value))
        texts = batch.column(1).to_pylist()
        base = [base_spans(t) for t in texts]
        more = kept[0].added(texts, [[s for k in KINDS for s in b[k]] for b in base])
        spans = [[{"kind": k, "start": a, "end": e, "base": own} for k in KINDS
                  for a, e, own in sorted([(*s, True) for s in b[k]] + [(*s, False) for s in x[k]])] for b, x in zip(base, more)]
        digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind)), pa.array(digests, pa.string())],
                                          names=["id", "found", "base_sha256"])

    schema = (f"id {thin.schema['id'].dataType.simpleString()}, "
              "found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>, base_sha256 string")
    return map_batches(thin, run, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_<kind> of base spans, base_sha256 and all spans as text."""
    def base_of(kind: str):
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    counts = [base_of(k) for k in KINDS]
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(id_col, *counts, "base_sha256", text.alias("spans"))
