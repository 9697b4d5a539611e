"""Exact dedup, the Jaccard join and decontamination against brute force."""
import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import decontaminate, exact_dedup, ngram_join
from larder.llm.common import words_of
from larder.llm.graph import components

EXTRA = ", digest string, label string, n int, s1 string, slice string, tokens string, keep_id string"


def table(spark, rows, key="doc_id"):
    return spark.createDataFrame([(i, t, "a", None, 7, "b", "c", "d", "e") for i, t in rows], f"{key} bigint, text string" + EXTRA).repartition(3)


def shingles(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.booleans()), max_size=300))
def test_cuckoo_index_is_a_map(steps):
    index, want = exact_dedup.CuckooIndex(4), {}
    for number, add in steps:
        key = hashlib.sha256(bytes([number])).digest()
        if add and key not in want:
            index.insert(key, [number])
            want[key] = [number]
        elif not add:
            assert index.delete(key) == (key in want)
            want.pop(key, None)
        assert index.get(key) == want.get(key)
    assert dict(index.items()) == want and index.size == len(want)


def test_cuckoo_index_grows_from_stored_keys():
    index = exact_dedup.CuckooIndex(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, [i])
    assert index.buckets > 4 and all(index.get(k) == [i] for i, k in enumerate(keys))
    same_print = keys[0][:2] + keys[0][2:10] + bytes(22)
    assert index.get(same_print) is None  # a filter hit that the stored keys refute


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (9, "a b"), (1, " a b"), (7, None), (3, ""), (8, "A b"), (None, "a b"), (4, " "),
            (6, "x" * 200_000), (11, "x" * 200_000)] + [(100 + i, "copy\n\ncopy") for i in range(200)]
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = min(i for i in ids if i is not None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup.exact_dedup(table(spark, rows).limit(0)).count() == 0


def test_live_digests(spark):
    d = [hashlib.sha256(bytes([i])).digest() for i in range(4)]
    events = [(d[0], 1, 1), (d[0], 2, 1), (d[0], 3, -1), (d[1], 1, 1), (d[1], 2, -1), (d[2], 1, -1), (d[2], 2, 1), (d[3], 5, -1)]
    df = spark.createDataFrame([(bytearray(a), b, c) for a, b, c in events], "digest binary, seq bigint, delta int")
    assert {(bytes(r.digest), r.copies) for r in exact_dedup.live_digests(df).collect()} == {(d[0], 1), (d[2], 1)}


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    flat = [(i, s) for i, ss in sets.items() for s in ss]
    parent = list(range(len(flat)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(flat)):
        for y in range(x):
            a, b = flat[x][1], flat[y][1]
            if a and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(flat):
        low[root(x)] = min(low.get(root(x), i), i)
    return sorted((i, len(s), low[root(x)]) for x, (i, s) in enumerate(flat))


def near_copies(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    line = "this common line stands in very many of the texts here"
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((i, (line + " " if rng.random() < .5 else "") + " ".join(copy)))
            i += 1
    base = [rng.choice(vocab) for _ in range(150)]
    for _ in range(60):  # a chain in which distant members are not similar
        rows.append((i, " ".join(base)))
        base[rng.randrange(150)] = rng.choice(vocab)
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t"), (i + 3, "two words"), (i + 4, "TWO\nwords"), (i + 5, line), (i + 5, line), (i + 6, line.upper())]
    return rows


def test_ngram_join_equals_brute_force(spark):
    rows = near_copies()
    got = sorted(map(tuple, ngram_join.ngram_jaccard(table(spark, rows)).collect()))
    assert got == brute_components(rows)


def test_ngram_join_with_split_and_mixed_lists(spark, monkeypatch):
    """Few occurrences already count as frequent, lists are split and the star rounds end early."""
    monkeypatch.setattr(ngram_join, "HEAVY", 3)
    monkeypatch.setattr(ngram_join, "SPLIT", 4)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 1)
    rows = near_copies(11)
    got = sorted(map(tuple, ngram_join.ngram_jaccard(table(spark, rows)).collect()))
    assert got == brute_components(rows)


def test_parity_bitmaps_never_reject_similar_sets():
    import numpy as np
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 130, 300, 1100, 5000):
        base = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        for change in (0, n // 30, n // 10, n // 4):
            other = np.concatenate([base[change:], rng.integers(0, 2 ** 63, change + n // 20).astype(np.uint64)])
            common, union = n - change, len(set(base.tolist()) | set(other.tolist()))
            x, y = ngram_join.parity_bitmap(base), ngram_join.parity_bitmap(other)
            apart = sum(((a ^ b) & (2 ** 64 - 1)).bit_count() for a, b in zip(ngram_join.folded(x), ngram_join.folded(y)))
            assert apart <= union - common
            if 100 * common >= 80 * union:
                assert ngram_join.may_be_similar(x, len(base), y, len(other))


def test_ngram_join_of_empty_and_unlinked_tables(spark):
    assert ngram_join.ngram_jaccard(table(spark, [(1, "x")]).limit(0)).count() == 0
    assert sorted(map(tuple, ngram_join.ngram_jaccard(table(spark, [(1, "one two"), (2, "three four five six seven eight")])).collect())) == [
        (1, 1, 1), (2, 2, 2)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r.v: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60)))) for k in range(30)]
    items += [(50, None), (51, ""), (52, "  "), (53, items[3][1].upper()), (53, items[3][1])]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 200)))) for i in range(40)]
    for i in range(60):
        words = words_of(rng.choice(items[:30])[1])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = b"zz"
        text = " ".join(w.decode() for w in words)
        docs.append((100 + i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 900))) + "\n" + text + " end of it"))
    docs += [(300, None), (301, ""), (302, items[0][1]), (302, items[0][1])]
    want = []
    for i, t in docs:
        s = shingles(t)
        for k, u in items:
            q = shingles(u)
            if q and 100 * len(q & s) >= 80 * len(q):
                want.append((i, k, len(q), len(q & s), len(q & s) / len(q)))
    d, b = table(spark, docs), table(spark, items, "item_id").withColumnRenamed("digest", "doc_id")
    assert sorted(map(tuple, decontaminate.contaminated(d, b).collect())) == sorted(want) and want
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 500)  # several blocks of items
    assert sorted(map(tuple, decontaminate.contaminated(d, b).collect())) == sorted(want)
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
