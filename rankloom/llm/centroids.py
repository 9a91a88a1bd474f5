"""Centroid clustering with zone maps along a space-filling curve.

Vectors of ``SIZE`` components are turned into whole numbers, so that sums, means and distances are exact and do not
depend on the order of the rows.

1. A few fixed random directions are laid through the vectors; the place of each projection between mean minus and plus
   two deviations, as a grid cell, gives a key on the Hilbert curve. Spark range partitions and sorts by that key, and
   every ``ROWS`` neighbours become a block: one row with ids, packed vectors, and the least and largest value of each
   component (the zone map). The blocks are written once.
2. A round reads the blocks. For a box and a centroid, the clipped differences give the least squared distance that any
   vector of the box can have, and the farthest corner the largest. Centroids whose least distance is above the smallest
   largest one cannot be nearest to any vector of the block; the others are its candidates. Equal bounds stay.
3. Only candidates are compared with the block's vectors, in one product; ties go to the smaller number. A task sums its
   vectors by centroid, Spark adds the sums of the tasks, and the driver gets centroids times components numbers.
4. After the rounds a last one assigns the vectors; its rows are written, summed by cluster and joined with these sums.

Where vectors have no structure, boxes are wide and every centroid stays a candidate: the work is then that of a plain
comparison, which is its bound. ``candidates`` gives the share that was compared.

Vectors that are null, of another length, or hold a null or a component that is not finite take no part, nor do rows
without id. Nor do vectors with a component whose whole number is beyond 2 ** 27, as their squared distances do not fit a
long. Rows that repeat an id are vectors of their own; among equal hashes of ids smaller components come first. Fewer
vectors than centroids make fewer centroids. An empty table gives no rows. Columns other than the id and the vector are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.neighbours import hilbert
from rankloom.session import stable

SIZE, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
DIMS, BITS, ROWS = 6, 6, 256
LIMIT = 1 << 27


def whole_numbers(vectors: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """id, vec (array of long): the rows that take part."""
    vec = F.col(vector).cast("array<double>")
    fits = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x * scale).cast("double")) <= LIMIT))
    rows = vectors.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    return rows.filter((F.size("vec") == size) & fits).select("id", F.transform("vec", lambda x: F.floor(x * scale).cast("long")).alias("vec"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def directions(size: int, seed: int = 3) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(DIMS, size))))[0]


def _projections(size: int):
    """Count, sum and sum of squares of each projection, for each task."""
    through = directions(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, through.shape[1]))
        for batch in batches:
            p = _matrix(batch.column(0), size) @ through
            held += [np.full(p.shape[1], len(p)), p.sum(axis=0), (p * p).sum(axis=0)]
        columns = [pa.array(np.arange(held.shape[1], dtype=np.int32)), *map(pa.array, held)]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "total", "squares"])

    return run


def _keys(size: int, middle: np.ndarray, spread: np.ndarray):
    through = directions(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1), size)
            place = (vectors @ through - middle) / np.where(spread > 0, 4 * spread, 1) + 0.5
            cells = (np.clip(place, 0, 1) * ((1 << BITS) - 1)).astype(np.int64)
            packed = pa.array([v.tobytes() for v in vectors.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert(cells, BITS)), packed], names=["id", "key", "vec"])

    return run


def _blocks(size: int, rows: int):
    """Neighbours along the curve as one row: ids, vectors, and the least and largest components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def block(part: pa.Table) -> pa.RecordBatch:
            packed = b"".join(part.column(1).to_pylist())
            vectors = np.frombuffer(packed, "<i4").reshape(-1, size)
            values = (part.column(0).to_numpy().astype("<i8").tobytes(), packed, vectors.min(axis=0).tobytes(), vectors.max(axis=0).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["ids", "vectors", "least", "largest"])

        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= rows:
                table = pa.Table.from_batches(held)
                for k in range(0, count - count % rows, rows):
                    yield block(table.slice(k, rows))
                held, count = table.slice(count - count % rows).to_batches(), count % rows
        if count:
            yield block(pa.Table.from_batches(held))

    return run


def zones(numbers: DataFrame, size: int = SIZE, rows: int = ROWS) -> DataFrame:
    """ids, vectors, least, largest: blocks along the Hilbert curve, written."""
    sums = numbers.select("vec").mapInArrow(_projections(size), "dim int, n double, total double, squares double")
    # a few numbers for each direction
    at = {r.dim: r for r in sums.groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]).collect()}
    n = np.maximum(1, [at[k].n for k in sorted(at)])
    middle = np.array([at[k].total for k in sorted(at)]) / n
    spread = np.sqrt(np.maximum(0, np.array([at[k].squares for k in sorted(at)]) / n - middle**2))
    if not len(middle):
        middle, spread = np.zeros(min(DIMS, size)), np.zeros(min(DIMS, size))
    keyed = numbers.mapInArrow(_keys(size, middle, spread), "id long, key long, vec binary")
    parts = int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id parts vectors of one key, which may be a large share of all
    sorted_rows = keyed.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").select("id", "vec")
    return stable(sorted_rows.mapInArrow(_blocks(size, rows), "ids binary, vectors binary, least binary, largest binary"))


def first_centroids(numbers: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = numbers.withColumn("rank", rank).orderBy("rank", "vec").limit(count).collect()
    return np.array([r.vec for r in chosen], np.int64)


def candidates(least: np.ndarray, largest: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be nearest to a vector of the box."""
    near = np.maximum(0, np.maximum(least - centroids, centroids - largest))
    far = np.maximum(np.abs(centroids - least), np.abs(centroids - largest))
    return np.flatnonzero((near * near).sum(axis=1) <= (far * far).sum(axis=1).min())


def assign(vectors: np.ndarray, least: np.ndarray, largest: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector of a block, its squared distance, and how many centroids were compared."""
    chosen = candidates(least, largest, centroids)
    c = centroids[chosen]
    bound = int(max(np.abs(vectors).max(), np.abs(c).max(), 1))
    if 4 * vectors.shape[1] * bound * bound < 1 << 53:  # doubles hold every step exactly
        v, d = vectors.astype(np.float64), c.astype(np.float64)
        squared = (d * d).sum(axis=1) - 2 * (v @ d.T)
        at = squared.argmin(axis=1)
        distance = (squared[np.arange(len(v)), at] + (v * v).sum(axis=1)).astype(np.int64)
    else:
        squared = np.column_stack([((vectors - x) ** 2).sum(axis=1) for x in c])
        at = squared.argmin(axis=1)
        distance = squared[np.arange(len(vectors)), at]
    return chosen[at], distance, len(chosen)


def _each_block(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    size = centroids.shape[1]
    for batch in batches:
        for ids, packed, least, largest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            vectors = np.frombuffer(packed, "<i4").reshape(-1, size).astype(np.int64)
            box = (np.frombuffer(x, "<i4").astype(np.int64) for x in (least, largest))
            yield np.frombuffer(ids, "<i8"), vectors, *assign(vectors, *box, centroids)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, vectors, at, _, _ in _each_block(batches, centroids):
            order = np.argsort(at, kind="stable")
            there, start = np.unique(at[order], return_index=True)
            total[there] += np.add.reduceat(vectors[order], start)
            count[there] += np.bincount(at, minlength=k)[there]
        cluster = np.repeat(np.flatnonzero(count), size)
        columns = [cluster.astype(np.int32), np.tile(np.arange(size, dtype=np.int32), len(cluster) // size), total[count > 0].ravel(), count[cluster]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "component", "total", "n"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, at, distance, compared in _each_block(batches, centroids):
            columns = [pa.array(ids), pa.array(at.astype(np.int32)), pa.array(distance), pa.array(np.full(len(ids), compared, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "compared"])

    return run


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of the vectors nearest to each centroid; one without vectors stays."""
    sums = blocks.mapInArrow(_sums(centroids), "cluster int, component int, total long, n long")
    exact = sums.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in exact.collect():  # centroids times components
        out[r.cluster, r.component] = int(r.total) // r.n
    return out


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared (centroids compared with its block)."""
    spark = vectors.sparkSession
    numbers = stable(whole_numbers(vectors, key, vector, size, scale))
    centroids = first_centroids(numbers, count)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared int")
    blocks = zones(numbers, size)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    rows = stable(blocks.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long, compared int"))
    inertia = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row for each centroid
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    whole = sum(inertia.values())
    about = spark.createDataFrame([(k, v, whole, digest[k]) for k, v in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")
