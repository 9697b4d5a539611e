"""Centroid clustering over space-filling-curve zone maps.

Vectors become integers floor(scale * x). They are ordered along a Hilbert curve
through all their dimensions (``BITS`` bits each, on the grid between the
table's smallest and largest value) and cut into blocks of up to ``BLOCK``
vectors, each with the box of its smallest and largest components. The blocks
are written once; every round reads them.

In a round the box alone bounds the distance of each centroid to all vectors of
a block: centroids whose least possible distance exceeds the smallest greatest
possible one of any centroid are out, exactly and ties included. The rest are
compared with the block's vectors in one matrix product, in doubles where all
sums are exact integers and else in 64-bit integers. A task sums its
vectors by centroid; an aggregation adds the sums, at most one number per
centroid and dimension, from which the driver takes the next centroids.

The layout decides only how many centroids a block looks at, never a result.
Equal vectors, however many, are dealt by id within their place on the curve.

Defined cases: vectors with another number of components, or a null or
non-finite one, are left out, as are those with a component beyond 2^19 in size,
whose squared distances need not fit a 64-bit integer; a null id hashes as empty
text, and equal hashes are ordered by the vector itself; with fewer vectors than
centroids asked for, every vector starts one; an empty table gives an empty
result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_batches, shared_dir, small_batches, stored

DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
BLOCK = 128
BITS = 2
_LARGEST = 1 << 19   # size of a component, before scaling
_EXACT = 1 << 22     # below this, 64 products add up exactly in a double


def hilbert_keys(coords: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of points with ``bits``-bit coordinates, as byte strings in curve order."""
    x = coords.astype(np.int64).T.copy()  # one row a dimension
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the sub-cubes, from large to small
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # bit, dimension, point
    packed = np.packbits(planes.reshape(bits * n, -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def box_candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(blocks, centroids): whether a centroid may be nearest to some vector of the box."""
    below, above = lo[:, None, :] - centroids[None], centroids[None] - hi[:, None, :]
    nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
    farthest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
    # |c - lo| and |c - hi| are the distances to both faces; the farther one bounds the component.
    return nearest <= farthest.min(axis=1, keepdims=True)


def nearest(vectors: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of the given centroids; ties take the smaller number."""
    chosen = centroids[numbers]
    kind = np.float64 if max(np.abs(vectors).max(), np.abs(chosen).max()) < _EXACT else np.int64
    v, c = vectors.astype(kind), chosen.astype(kind)
    apart = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
    best = apart.argmin(axis=1)  # the first of equal ones; numbers ascend
    return numbers[best], apart[np.arange(len(v)), best].astype(np.int64)


def _vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """(id, v): the vectors that take part, as doubles."""
    v = F.col(vector_col)
    fits = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(float(_LARGEST)), F.lit(False)))
    return df.filter(v.isNotNull() & (F.size(v) == dimensions) & fits).select(
        F.col(id_col).alias("id"), v.cast("array<double>").alias("v"))


def _matrix(column: pa.ListArray, scale: int, dimensions: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return np.floor(scale * values).astype(np.int64)


def zone_blocks(vectors: DataFrame, scale: int, dimensions: int, block: int, bits: int) -> DataFrame:
    """(ids, n, data, lo, hi): blocks of vectors along the Hilbert curve with their boxes; integers as bytes."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = vectors.schema["id"].dataType.simpleString()
    ends = vectors.agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
    low, high = scale * (ends["lo"] or 0.0), scale * (ends["hi"] or 0.0)
    width = (high - low) / (1 << bits) or 1.0

    def key(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _matrix(batch.column(1), scale, dimensions)
        cells = np.clip((m - low) / width, 0, (1 << bits) - 1).astype(np.int64)
        rows = [r.tobytes() for r in m.astype("<i4")]
        return pa.RecordBatch.from_arrays([pa.array(hilbert_keys(cells, bits), pa.binary()), batch.column(0), pa.array(rows, pa.binary())],
                                          names=["key", "id", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                ids, data = batch.column(0).slice(at, block), b"".join(batch.column(1).slice(at, block).to_pylist())
                m = np.frombuffer(data, dtype="<i4").reshape(-1, dimensions)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([len(m)], pa.int32()), pa.array([data], pa.binary()),
                     pa.array([m.min(axis=0).tobytes()], pa.binary()), pa.array([m.max(axis=0).tobytes()], pa.binary())],
                    names=["ids", "n", "data", "lo", "hi"])

    keyed = map_batches(vectors, key, f"key binary, id {id_type}, data binary")
    # Range bounds on (key, id): a place that many vectors share spans several tasks.
    ordered = keyed.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").select("id", "data")
    return ordered.mapInArrow(cut, f"ids array<{id_type}>, n int, data binary, lo binary, hi binary")


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, vectors, cluster, distance) of each block of a batch (n, data, lo, hi)."""
    dimensions = centroids.shape[1]

    def ints(column: pa.Array) -> list[np.ndarray]:
        return [np.frombuffer(b, dtype="<i4").astype(np.int64) for b in column.to_pylist()]

    maybe = box_candidates(np.stack(ints(batch.column(2))), np.stack(ints(batch.column(3))), centroids)
    for i, flat in enumerate(ints(batch.column(1))):
        m = flat.reshape(-1, dimensions)
        yield i, m, *nearest(m, centroids, np.flatnonzero(maybe[i]))


def next_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floored mean of each centroid's vectors; centroids without vectors stay."""
    k, dimensions = centroids.shape
    shared = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                for _, m, cluster, _ in _assigned(batch, shared.value):
                    np.add.at(sums, cluster, m)
                    counts += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
                                             names=["cluster", "n", "sums"])

    parts = blocks.select("n", "data", "lo", "hi").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dimensions)])
    out = centroids.copy()
    for row in added.collect():  # one row a centroid
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dimensions)]
    return out


def assignments(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) per vector."""
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    shared = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(_assigned(batch.select([1, 2, 3, 4]), shared.value))
        return pa.RecordBatch.from_arrays([batch.column(0).flatten(), pa.array(np.concatenate([f[2] for f in found]).astype(np.int32)),
                                           pa.array(np.concatenate([f[3] for f in found]))], names=["id", "cluster", "distance"])

    return map_batches(blocks, run, f"id {id_type}, cluster int, distance bigint")


def first_centroids(vectors: DataFrame, count: int, scale: int, seed: int, dimensions: int) -> np.ndarray:
    """The vectors whose ids hash lowest, in hash order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("v", order.alias("h")).orderBy("h", "v").limit(count).collect()  # one row a centroid
    return np.floor(scale * np.array([r["v"] for r in rows], dtype=np.float64)).astype(np.int64).reshape(-1, dimensions)


def zone_clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE,
                  centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, block: int = BLOCK, bits: int = BITS) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) per vector, stored; the final centroids)."""
    spark = df.sparkSession
    small_batches(spark)
    vectors = _vectors(df, id_col, vector_col, dimensions)
    centres = first_centroids(vectors, centroids, scale, seed, dimensions)
    blocks = stored(zone_blocks(vectors, scale, dimensions, block, bits), shared_dir(spark, "zones"))
    if len(centres):
        for _ in range(rounds):
            centres = next_centroids(blocks, centres)
    out = stored(assignments(blocks, centres), shared_dir(spark, "clusters"))
    return out.withColumnRenamed("id", id_col), centres


def cluster_report(df: DataFrame, **options) -> DataFrame:
    """One row per vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = df.sparkSession
    assigned, centres = zone_clusters(df, **options)
    sums = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())  # one row a centroid
    rows = [(i, d, sum(sums.values()), sha256(",".join(map(str, centres[i].tolist())).encode()).hexdigest()) for i, d in sums.items()]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster")  # one row a centroid
