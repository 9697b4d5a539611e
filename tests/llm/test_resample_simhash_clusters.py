"""Importance resampling, SimHash components and zone-map clustering against brute force."""
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from larder.llm import resample, simhash, zone_clusters

EXTRA = ", fp string, label string, n int, rank string, score string, weight string, rep string, key string, place string"


def table(spark, rows, key="doc_id", kind="bigint"):
    return spark.createDataFrame([(i, t, "a", None, 7, "b", "c", "d", "e", "f", "g") for i, t in rows], f"{key} {kind}, text string" + EXTRA).repartition(3)


# --- importance resampling

def plain_features(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return len(words), [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, buckets, min_words, percent):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for texts, counts in ((docs, s), (target, t)):
        for _, text in texts:
            for f in plain_features(text)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        n, features = plain_features(text)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(able[:len(able) * percent // 100])}
    return sorted((tuple(r) + (rank.get(id(r)),) for r in rows), key=repr)


def test_resample_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(resample, "_PIECE_BYTES", 64)  # texts are cut into many stretches
    rng = random.Random(3)
    words = ["Über", "a1", "B", "zebra", "naïve", "日本", "x" * 90, "0", "É"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "--", "\n", "_", ".\x00"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    docs += [(None, docs[3][1]), (None, None), (7, docs[9][1]), (7, docs[9][1]), (200, None), (201, ""), (202, " .,- "), (203, "zebra " * 5000)]
    target = [(1, "zebra zebra Über a1"), (2, None), (3, "B a1 B a1")]
    got = resample.resample(table(spark, docs), table(spark, target, "item_id"), buckets=97, min_words=4, percent=30)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(docs, target, 97, 4, 30)
    drawn = resample.drawn_documents(table(spark, docs), got.filter("rank <= 3")).collect()
    assert {r["doc_id"] for r in drawn} == {r["doc_id"] for r in got.filter("rank <= 3").collect()} and drawn[0]["fp"] == "a"


def test_resample_of_empty_tables(spark):
    none = table(spark, [])
    assert resample.resample(none, none).count() == 0
    one = resample.resample(table(spark, [("k", "a b")], kind="string"), none).first()
    assert one["n_features"] == 3 and one["rank"] is None


# --- SimHash

def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", words) if w]
    grams = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxh64_intdigest(g, 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(grams))


def plain_components(prints):
    """Smallest index reachable over fingerprints at two or fewer differing bits."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def near_prints(rng, n):
    prints = [rng.getrandbits(64) for _ in range(n // 3 + 1)]
    while len(prints) < n:
        x = rng.choice(prints)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    return prints


def test_fingerprints_equal_plain_version(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_HASHES", 16)
    texts = [None, "", " \n ", "One", "one TWO", "a b c", "a b c d", "É É\x0bE", "x " * 333, "Ünïcode 　 wide", " ".join(str(i % 17) for i in range(400))]
    got = [x & (1 << 64) - 1 for x in simhash.fingerprints(texts).tolist()]
    assert got == [plain_fingerprint(t) for t in texts] and got[0] == got[1] == got[2] == 0


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300, 900])
def test_near_words_are_the_lanes_within_the_radius(n):
    rng = random.Random(n)
    prints = near_prints(rng, n)
    fps = np.array(prints, dtype=np.uint64).view(np.int64)
    query, word, lanes = simhash.near_words(simhash.bit_planes(fps), fps)
    got = {(q, w * 64 + k) for q, w, x in zip(query.tolist(), word.tolist(), lanes.tolist()) for k in range(64) if x >> k & 1}
    assert {(a, b) for a, b in got if b < n} == {(a, b) for a in range(n) for b in range(n) if (prints[a] ^ prints[b]).bit_count() <= 2}


def test_block_stars_connect_what_links_connect():
    rng = random.Random(5)
    for n in (40, 400, 1500):
        prints = sorted(set(near_prints(rng, n)))
        a, b = simhash.block_stars(np.array(prints, dtype=np.uint64).view(np.int64))
        assert len(a) < len(prints)  # one star a set, never pairs
        label = list(range(len(prints)))
        spot = {np.uint64(p).view(np.int64).item(): i for i, p in enumerate(prints)}
        for x, y in zip(a.tolist(), b.tolist()):
            i, j = sorted((label[spot[x]], label[spot[y]]))
            label = [i if k == j else k for k in label]
        assert label == plain_components(prints)


def test_links_of_a_dense_group_and_of_signed_prints(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64) | 1 << 63
    dense = [base ^ x for x in range(700)]  # one key of several tables holds all of them
    apart = near_prints(rng, 500)
    prints = sorted(set(dense + apart + [0, 1, 3, 7 << 60, (1 << 64) - 1]))
    signed = [(np.uint64(p).view(np.int64).item(),) for p in prints]
    stars = simhash.near_links(spark.createDataFrame(signed, "fp bigint").repartition(3)).collect()
    label = list(range(len(prints)))
    spot = {f: i for i, (f,) in enumerate(signed)}
    for r in stars:
        i, j = sorted((label[spot[r["a"]]], label[spot[r["b"]]]))
        label = [i if k == j else k for k in label]
    assert label == plain_components(prints)


def test_simhash_components(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([2, 30, 400]))]
        for _ in range(rng.choice([1, 2, 8])):
            copy = list(base)
            if rng.random() < .7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs) * 7 % 1009, " ".join(copy)))
    docs += [(5000, None), (4000, ""), (4100, "\t"), (None, docs[0][1]), (docs[3][0], docs[3][1]), (6000, "tail " * 30_000)]
    prints = [plain_fingerprint(t) for _, t in docs]
    label = plain_components(prints)
    least = {}
    for (i, _), k in zip(docs, label):
        least[k] = min(x for x in (i, least.get(k, i)) if x is not None) if i is not None or k in least else i
    want = sorted(((i, f"{p:016x}", least[k]) for (i, _), p, k in zip(docs, prints, label)), key=repr)
    got = simhash.simhash_components(table(spark, docs)).withColumn("fingerprint", simhash.hex_print(F.col("fingerprint")))
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect()), key=repr) == want
    assert simhash.simhash_components(table(spark, [])).count() == 0
    assert [tuple(r) for r in simhash.simhash_components(table(spark, [("b", "x"), ("a", "x")], kind="string")).select("component_id").distinct().collect()] == [("a",)]


# --- clustering

def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2)):
        points = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        keys = zone_clusters.hilbert_keys(points, bits)
        assert len(set(keys)) == len(points)
        path = points[np.argsort(np.array([int.from_bytes(k, "big") for k in keys]))]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_box_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(4)
    for spread in (2, 30, 400):
        centroids = rng.integers(-200, 200, (40, 64))
        blocks = [centroids[rng.integers(40)] + rng.integers(-spread, spread + 1, (16, 64)) for _ in range(20)]
        maybe = zone_clusters.box_candidates(np.stack([b.min(0) for b in blocks]), np.stack([b.max(0) for b in blocks]), centroids)
        for b, m in zip(blocks, maybe):
            apart = ((b[:, None] - centroids[None]) ** 2).sum(axis=2)
            number, distance = zone_clusters.nearest(b, centroids, np.flatnonzero(m))
            assert (number == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()
        if spread == 2:
            assert maybe.sum() == len(blocks)  # boxes of close vectors leave one centroid


def test_nearest_is_exact_on_large_integers():
    v = np.array([[(1 << 27) - 1] * 64, [-(1 << 27)] * 64])
    c = np.array([[-(1 << 27)] * 64, [(1 << 27)] * 64, [(1 << 27)] * 64])
    number, distance = zone_clusters.nearest(v, c, np.arange(3))
    assert number.tolist() == [1, 0] and distance.tolist() == [64, 0]


def plain_clusters(rows, count, rounds):
    kept = [(i, [math.floor(256 * struct.unpack("f", struct.pack("f", x))[0]) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) <= 1 << 19 for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(centres)):
            own = [v for (_, v), (_, j) in zip(kept, found) if j == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, sum(e for e, j in found if j == k), sum(e for e, _ in found), digest[k]) for (i, _), (d, k) in zip(kept, found)), key=repr)


def test_zone_clusters_equal_plain_version(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 64))
    rows = [(i, (centres[i % 6] + rng.normal(size=64) * .05).astype(np.float32).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[4][1]) for i in range(120)]  # one vector holds a good part of the rows
    rows += [(2000, None), (2001, [0.5] * 63), (2002, [None] + [0.5] * 63), (2003, [float("nan")] * 64), (2004, [float("inf")] * 64),
             (2005, [1e30] * 64), (None, rows[0][1]), (None, [0.25] * 64), (3, rows[3][1]), (2006, [-0.0] * 64), (2007, [])]
    df = spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], "vec_id bigint, embedding array<float>, n int, key string, data string, cluster string")
    got = zone_clusters.cluster_report(df.repartition(5), centroids=7, rounds=3, block=16)
    assert sorted(map(tuple, got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr) == plain_clusters(rows, 7, 3)


def test_zone_clusters_of_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 64)], "vec_id bigint, embedding array<float>")
    got = zone_clusters.cluster_report(df)
    assert sorted(r["distance"] for r in got.collect()) == [0, 0] and got.select("cluster").distinct().count() == 2
    assert zone_clusters.cluster_report(df.filter("vec_id > 2")).count() == 0
