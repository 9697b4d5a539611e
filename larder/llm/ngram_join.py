"""Exact Jaccard self-join of shingle sets, and its components.

Two documents link when 100 * |A & B| >= 80 * |A | B| over distinct 5-word
shingles. The join is a prefix-filter join with set-relation skipping:

1. One scan gives each document's set size, a 128-bit set signature and a parity
   bitmap. Documents with equal sets are one class from here on; its answers
   hold for every member.
2. A second scan counts all shingles. The frequent ones move to the end of the
   global order, by count (the order only decides how fast, any fixed order is
   exact), so that the variants of a text that many documents share meet in no
   list unless they are similar. A third scan sends every class's prefix, n - ceil(0.8 n) + 1 shingles, into index lists by shingle.
   Lists of one shingle longer than ``SPLIT`` are dealt to several tasks.
3. A list is cut into blocks by set size and position; entries whose block can
   meet no other block of the list are skipped, and lists of one set vanish.
4. Answers are derived along similar sets: every set is first compared with a
   few leaders of its lists only, the most central sets of their size (as many
   pairs as sets, whatever the size of a group). Sets found similar share a
   label; pairs inside a label are already connected and never compared.
   Where a list still holds several labels, every remaining pair across labels
   that passes the size, position and bitmap bounds is compared, so no link between
   different components is lost. Such a pair is made in the first of the lists that
   both sets share, not once in each.
5. Components come from the links by min-label rounds; a document's component
   is the smallest id among the members of its classes.

Candidates first meet a parity bitmap (about two bits a shingle): the bits in
which two bitmaps differ never outnumber the shingles in which the sets differ,
so a pair whose bitmaps differ too much is out, exactly. Pairs that remain are
verified on the full 64-bit shingle sets, gathered by another scan for the sets
that occur in such a pair.

Defined cases: a null, empty or blank text has an empty set, links with nothing
and is its own component; one to four words are one shingle; rows that repeat
an id are members of the same class; a null id is carried with the component of
its class; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import drop_path, map_batches, mix64, shared_dir, shingle_sets, small_batches, stored
from larder.llm.graph import components

PERCENT = 80
HEAVY = 16          # documents from which a shingle goes to the end of the order
MAX_HEAVY = 1 << 20  # most frequent such shingles that are told to the tasks (order only, results do not depend on it)
SPLIT = 8192        # entries of one shingle's list per task
PLACES = 1 << 20    # places of the bitmap of sets worth gathering
STAR_ROUNDS = 2
LEADERS = 2         # a set's leaders per round
RECALL = 4          # earlier entries by which a pair is known to meet in another list too
FOLD = 512          # places of the folded parity bitmaps that pairs of a list are compared by
WORDS = [f"f{i}" for i in range(FOLD // 64)]
_SALT = np.uint64(0x9FB21C651E98DF25)


def prefix_length(n):
    """Number of leading shingles of which similar sets share at least one."""
    return n - -(-PERCENT * n // 100) + 1


def signatures(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums over each of several sets."""
    sums = []
    for salt in (np.uint64(0), _SALT):
        total = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum(mix64(flat ^ salt), out=total[1:])
        sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return sums[0], sums[1]


def parity_bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of shingles at each of 2^k places, two places a shingle or more."""
    places = max(FOLD, 1 << int(2 * len(s) - 1).bit_length())
    at = (mix64(s + _SALT) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=places) & 1, bitorder="little").tobytes()


def folded(bitmap: bytes) -> list[int]:
    """A parity bitmap folded to FOLD places, as signed 64-bit integers."""
    bits = np.frombuffer(bitmap, dtype=np.uint8)
    while len(bits) > FOLD // 8:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return np.frombuffer(bits.tobytes(), dtype="<i8").tolist()


def may_be_similar(x: bytes, nx: int, y: bytes, ny: int) -> bool:
    """False only if the bitmaps prove that two sets miss the bound."""
    p, q = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    while len(p) > len(q):  # parities of places that share their lower bits add up
        p = p[:len(p) // 2] ^ p[len(p) // 2:]
    while len(q) > len(p):
        q = q[:len(q) // 2] ^ q[len(q) // 2:]
    apart = int(np.bitwise_count(p ^ q).sum())
    most = (nx + ny - apart) // 2  # shingles that both can share
    return (100 + PERCENT) * most >= PERCENT * (nx + ny)


def _slices(tokens: np.ndarray, n: int) -> np.ndarray:
    return (mix64(tokens ^ _SALT) % np.uint64(n)).astype(np.int32)


def _by_slice(slices: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(slices, kind="stable")
    cuts = np.searchsorted(slices[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), order[cuts[k]:cuts[k + 1]]


def _scan(docs: DataFrame) -> DataFrame:
    """(id, n, s1, s2, bitmap) per document."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, offsets = shingle_sets(batch.column(1).to_pylist())
        s1, s2 = signatures(flat, offsets)
        bitmaps = [parity_bitmap(flat[a:b]) if b > a else b"" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int32)), pa.array(s1), pa.array(s2),
                                           pa.array(bitmaps, pa.binary())], names=["id", "n", "s1", "s2", "bitmap"])

    return map_batches(docs, run, f"id {id_type}, n int, s1 bigint, s2 bigint, bitmap binary")


def _folded_words(classes: DataFrame) -> DataFrame:
    """(s1, folded words of the bitmap) per class."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = np.array([folded(b) for b in batch.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(WORDS))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in words.T)], names=["s1", *WORDS])

    return map_batches(classes.select("s1", "bitmap"), run, "s1 bigint, " + ", ".join(f"{w} bigint" for w in WORDS))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (upper 32 bits of the hash, ascending) that many documents hold, with counts.

    Tasks send the distinct shingles of a batch packed by slice, that is by their
    top bits: three bytes each, one byte place after the other, and apart from them
    the place and count of those that several documents of the batch hold. A line
    that all documents share so costs a few bytes a batch, not a document.
    """
    spark = docs.sparkSession
    bits = max(8, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())  # of a slice's number

    def send(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        flat, _ = shingle_sets(batch.column(1).to_pylist())
        if not len(flat):
            return None
        tokens, n = np.unique((flat >> np.uint64(32)).astype(np.uint32), return_counts=True)
        cuts = np.searchsorted(tokens, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32 - bits))
        places = (tokens & np.uint32((1 << (32 - bits)) - 1)).astype(">u4").view(np.uint8).reshape(-1, 4)
        slices = np.flatnonzero(np.diff(cuts))
        blobs = [places[cuts[k]:cuts[k + 1], 1:].T.tobytes() for k in slices]
        repeats = []
        for k in slices:
            own = n[cuts[k]:cuts[k + 1]]
            at = np.flatnonzero(own > 1)
            repeats.append(np.concatenate([at, own[at]]).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(repeats, pa.binary())],
                                          names=["slice", "tokens", "repeats"])

    def count(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, dtype=np.uint8).reshape(3, -1) for b in table.column("tokens").to_pylist()]
        high, mid, low = (np.concatenate([p[i] for p in parts]).astype(np.uint32) for i in range(3))
        held = np.ones(len(high), dtype=np.int64)
        first = 0
        for part, blob in zip(parts, table.column("repeats").to_pylist()):
            at, times = np.frombuffer(blob, dtype="<u4").reshape(2, -1)
            held[first + at.astype(np.int64)] = times
            first += part.shape[1]
        token = high << np.uint32(16) | mid << np.uint32(8) | low
        order = np.argsort(token, kind="stable")
        token, starts = np.unique(token[order], return_index=True)
        n = np.add.reduceat(held[order], starts)
        keep = n >= HEAVY
        base = np.uint32(table.column("slice")[0].as_py() << (32 - bits))
        return pa.table({"token": (token[keep] | base).astype(np.int64), "n": n[keep].astype(np.int64)})

    found = (map_batches(docs, send, "slice int, tokens binary, repeats binary").groupBy("slice").applyInArrow(count, "token bigint, n bigint")
             .orderBy(F.col("n").desc(), "token").limit(MAX_HEAVY).toPandas().sort_values("token"))
    return found["token"].to_numpy().astype(np.uint32), found["n"].to_numpy()


_ROW = np.dtype([("token", "<u8"), ("s1", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def _index_rows(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], n_slices: int) -> DataFrame:
    """(slice, rows): packed index entries (token, set, size, position)."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        token, count = shared.value
        flat, offsets = shingle_sets(batch.column(1).to_pylist())
        s1, s2 = signatures(flat, offsets)
        upper = (flat >> np.uint64(32)).astype(np.uint32)
        spot = np.searchsorted(token, upper)
        spot[spot == len(token)] = 0
        weight = np.where(token[spot] == upper, count[spot], 0) if len(token) else np.zeros(len(flat), dtype=np.int64)
        parts, seen = [], set()
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if a == b or s2[i] in seen:
                continue
            seen.add(s2[i])
            n, own = b - a, weight[a:b]
            p = prefix_length(n)
            if own[:p].any():
                order = np.argsort(own, kind="stable")[:p]  # by frequency, then by hash
                chosen, split = flat[a:b][order], own[order] // SPLIT + 1
            else:
                chosen, split = flat[a:a + p], np.ones(p, dtype=np.int64)
            rows = np.empty(p, dtype=_ROW)
            rows["token"], rows["s1"], rows["n"], rows["pos"] = chosen, s1[i], n, np.arange(p)
            parts.append((rows, np.uint64(int(s2[i]) & 0xFFFFFFFF) % split.astype(np.uint64)))
        if not parts:
            return None
        rows = np.concatenate([r for r, _ in parts])
        salt = np.concatenate([x for _, x in parts])
        slices = _slices(rows["token"] + salt * _SALT, n_slices)
        out = [(k, b"".join(np.ascontiguousarray(rows[at][f]).tobytes() for f in _ROW.names))
               for k, at in _by_slice(slices, n_slices)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())],
                                          names=["slice", "rows"])

    return map_batches(docs, run, "slice int, rows binary")


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    cols: dict[str, list[np.ndarray]] = {f: [] for f in _ROW.names}
    for blob in blobs:
        n, at = len(blob) // _ROW.itemsize, 0
        for f in _ROW.names:
            kind = _ROW[f]
            cols[f].append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
            at += n * kind.itemsize
    return {f: np.concatenate(c) for f, c in cols.items()}


def list_entries(rows: dict[str, np.ndarray], always: np.ndarray) -> dict[str, np.ndarray]:
    """Entries of lists in which another set of fitting size occurs.

    Lists are ordered by (token, size, set), so a list's sizes form blocks and
    an entry survives only if the neighbouring size is within the bound.
    ``always``: tokens (upper 32 bits) whose lists are dealt to several tasks; their
    entries stay.
    """
    order = np.lexsort((rows["s1"], rows["n"], rows["token"]))
    token, s1, n, pos = (rows[f][order] for f in ("token", "s1", "n", "pos"))
    first = np.ones(len(token), dtype=bool)
    first[1:] = (token[1:] != token[:-1]) | (n[1:] != n[:-1]) | (s1[1:] != s1[:-1])
    token, s1, n, pos = token[first], s1[first], n[first].astype(np.int64), pos[first].astype(np.int64)
    meets = np.zeros(len(token), dtype=bool)
    fits = (token[1:] == token[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])
    meets[1:] |= fits
    meets[:-1] |= fits
    if len(always):
        meets |= np.isin((token >> np.uint64(32)).astype(np.uint32), always)
    return {"token": token[meets].view(np.int64), "s1": s1[meets], "n": n[meets].astype(np.int32), "pos": pos[meets].astype(np.int32)}


def _entries(index: DataFrame, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    always = heavy[0][heavy[1] >= SPLIT]

    def run(table: pa.Table) -> pa.Table:
        return pa.table(list_entries(_unpack(table.column("rows").to_pylist()), always))

    return index.groupBy("slice").applyInArrow(run, "token bigint, s1 bigint, n int, pos int")


def _gather(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s1, s2, n, shingles) of the sets that occur in pairs (and a few more, by the bitmap of places)."""
    spark = docs.sparkSession
    places = (pairs.select(F.explode(F.array("a", "b")).alias("s1"))
              .select(F.col("s1").bitwiseAND(F.lit(PLACES - 1)).cast("int").alias("p")).distinct().toPandas()["p"].to_numpy())
    wanted = np.zeros(PLACES, dtype=bool)
    wanted[places] = True
    shared = spark.sparkContext.broadcast(np.packbits(wanted))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        flat, offsets = shingle_sets(batch.column(1).to_pylist())
        s1, s2 = signatures(flat, offsets)
        place = s1 & (PLACES - 1)
        hit = np.flatnonzero((shared.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool) & (np.diff(offsets) > 0))
        _, first = np.unique(s2[hit], return_index=True)
        hit = hit[first]
        if not len(hit):
            return None
        return pa.RecordBatch.from_arrays([pa.array(s1[hit]), pa.array(s2[hit]), pa.array(np.diff(offsets)[hit].astype(np.int32)),
                                           pa.array([flat[offsets[i]:offsets[i + 1]].tobytes() for i in hit], pa.binary())],
                                          names=["s1", "s2", "n", "shingles"])

    found = map_batches(docs, run, "s1 bigint, s2 bigint, n int, shingles binary")
    return found.dropDuplicates(["s1", "s2", "n"])


def _paired(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs with a column of both their sets: a, b, na, x, nb, y."""
    left = table.select(F.col("s1").alias("a"), F.col("n").alias("na"), F.col(column).alias("x"))
    right = table.select(F.col("s1").alias("b"), F.col("n").alias("nb"), F.col(column).alias("y"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "na", "x", "nb", "y")


def _kept(paired: DataFrame, test) -> DataFrame:
    """Pairs (a, b) that pass ``test(x, na, y, nb)``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        na, x, nb, y = (c.to_pylist() for c in batch.columns[2:])
        keep = [i for i in range(batch.num_rows) if test(x[i], na[i], y[i], nb[i])]
        return batch.select([0, 1]).take(pa.array(keep, pa.int64())) if keep else None

    return map_batches(paired, run, "a bigint, b bigint")


def _similar(x: bytes, nx: int, y: bytes, ny: int) -> bool:
    both = np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (nx + ny - common)


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose sets reach the bound."""
    spark = docs.sparkSession
    near = stored(_kept(_paired(pairs, classes, "bitmap"), may_be_similar), shared_dir(spark, "near"))
    if near.limit(1).count() == 0:
        return near
    sets_path = shared_dir(spark, "sets")
    sets = stored(_gather(docs, near), sets_path)
    links = stored(_kept(_paired(near, sets, "shingles"), _similar), shared_dir(spark, "links"))
    drop_path(spark, sets_path)
    return links


FITS = f"a <> b and 100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"


def _hub_pairs(named: DataFrame, round_no: int) -> DataFrame:
    """(a, b): every set with the leaders of its lists that promise most, ``LEADERS`` pairs a set at most.

    A set is the more central the longer the lists that its shingles lead to: a text that others were made
    from shares all of its shingles, its copies only those that they kept. Of the sets of one list and
    size class the most central one and one drawn by hash lead.
    """
    central = named.groupBy("s1").agg((F.sum("k") / F.max("n")).alias("central"))
    scored = named.join(central, "s1").withColumn("size_class", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))))
    own = F.struct("central", "s1", "n", "label")
    draw = F.xxhash64("s1", F.lit(round_no))
    leaders = scored.groupBy("token", "size_class").agg(F.max(own).alias("hub"), F.max_by(own, F.struct(draw, "s1")).alias("drawn"))
    met = scored.join(leaders, ["token", "size_class"])
    best = []
    for leader in ("hub", "drawn")[:LEADERS]:
        fits = f"label <> {leader}.label and 100 * least(n, {leader}.n) >= {PERCENT} * greatest(n, {leader}.n)"
        best.append(F.max(F.when(F.expr(fits), F.struct(f"{leader}.central", f"{leader}.s1"))).alias(leader))
    return met.groupBy("s1").agg(*best).select(F.col("s1").alias("a"), F.explode(F.array_distinct(F.array(
        *[F.col(f"{x}.s1") for x in ("hub", "drawn")[:LEADERS]]))).alias("b")).filter("b is not null")


def _mixed_pairs(mixed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): pairs across labels that size, position and folded bitmaps allow.

    A pair meets in every list that both sets share, and would come once from each. It is passed over where one of
    the ``RECALL`` entries before, on both sides, names the same shingle: that list holds both sets too, at earlier
    positions, so the pair comes from there or, by the same rule, from a list before it.
    """
    along = Window.partitionBy("s1").orderBy("pos")
    before = F.array_compact(F.array(*[F.lag("token", i).over(along) for i in range(1, RECALL + 1)]))
    sets = mixed.withColumn("before", before).join(_folded_words(classes.join(mixed.select("s1").distinct(), "s1", "left_semi")), "s1")
    left, right = (sets.select("token", F.col("s1").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("label").alias(f"l{x}"),
                               F.col("before").alias(f"{x}before"), *[F.col(w).alias(f"{x}{w}") for w in WORDS]) for x in "ab")
    apart = " + ".join(f"bit_count(a{w} ^ b{w})" for w in WORDS)
    return left.join(right, "token").filter(
        f"la < lb and {FITS} and {100 + PERCENT} * least(na - pa, nb - pb) >= {PERCENT} * (na + nb) and "
        f"{100 + PERCENT} * ((na + nb - ({apart})) div 2) >= {PERCENT} * (na + nb) and not arrays_overlap(abefore, bbefore)"
    ).select("a", "b").distinct()


def similar_sets(docs: DataFrame, classes: DataFrame, n_slices: int) -> DataFrame:
    """(s1, label): connected sets; sets without a partner do not occur."""
    spark = docs.sparkSession
    heavy = _frequent(docs)
    path = shared_dir(spark, "entries")
    thin = stored(_entries(_index_rows(docs, heavy, n_slices), heavy), path)
    links = labels = None
    for round_no in range(STAR_ROUNDS + 1):
        if labels is None:
            named = thin.withColumn("label", F.col("s1"))
        else:
            named = thin.join(labels.withColumnRenamed("v", "s1"), "s1", "left").withColumn("label", F.coalesce("label", "s1"))
        # Lists that hold several labels; labels only merge, so the others are done.
        lists_path, mixed_path = shared_dir(spark, "lists"), shared_dir(spark, "mixed")
        lists = stored(named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(
            F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.count(F.lit(1)).alias("labels")).filter("labels > 1"), lists_path)
        mixed = stored(named.join(lists.select("token", "k"), "token"), mixed_path)
        entries_left, across = lists.agg(F.sum("k"), F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2)).first()
        drop_path(spark, path)  # all that is still needed of the entries is in the mixed lists
        drop_path(spark, lists_path)
        path = mixed_path
        if not entries_left:
            break
        thin = mixed.select("token", "s1", "n", "pos")
        last = round_no == STAR_ROUNDS or (round_no > 0 and across <= 8 * entries_left)
        found = _mixed_pairs(mixed, classes) if last else _hub_pairs(mixed, round_no)
        more = _verified(docs, classes, stored(found, shared_dir(spark, "pairs")))
        links = more if links is None else links.union(more)
        labels = components(links)
        if last:
            break
    drop_path(spark, path)
    if labels is None:
        labels = spark.createDataFrame([], "v bigint, label bigint")
    return labels.withColumnRenamed("v", "s1")


def ngram_jaccard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    spark = df.sparkSession
    small_batches(spark)
    n_slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = stored(_scan(docs), shared_dir(spark, "scan"))
    classes = stored(sigs.filter("n > 0").groupBy("n", "s1", "s2").agg(
        F.min("id").alias("rep"), F.first("bitmap").alias("bitmap")), shared_dir(spark, "classes"))
    labels = similar_sets(docs, classes, n_slices)
    labelled = classes.join(labels, "s1", "left")  # no label: a class without a partner
    smallest = labelled.filter("label is not null").groupBy("label").agg(F.min("rep").alias("smallest"))
    named = labelled.join(smallest, "label", "left").select("n", "s1", "s2", F.coalesce("smallest", "rep").alias("component_id"))
    return sigs.select("id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left").select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
