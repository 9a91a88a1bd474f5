"""Approximate nearest neighbours by shifted space-filling curves.

Random orthogonal directions are dealt out to ``CURVES`` groups of ``DIMS``. In each group a vector is projected, each
coordinate replaced by its place among those of a sample (moved by a random shift, so that curves have their seams in
different places), and the Hilbert curve through the grid of these places orders the vectors. The key range of each curve
is cut into ``BINS`` parts of equal share, the range partitions of the search: a vector is a candidate in its part on every
curve, and a query searches its own part and the ``SPREAD`` next to it on both sides. What the curves find is merged, and
reranked by the exact inner product in double precision.

The window is a share of the rows, not a number: vectors without structure have neighbours that are only slightly nearer
than the rest, so a fixed number would lose recall as tables grow. The work so grows with queries times rows; for data
with structure more BINS do.

A part is split by a hash of the ids, so that a task holds ``TILE`` candidates times BINS at most even if all vectors are
equal; queries stream past them. Directions, places and ranges come from a sample of ``SAMPLE`` vectors at most.

Vectors that are null or zero, hold a null or a component that is not finite, or are not of the most common length take no
part, nor do rows without id. A query never finds rows of its own id; equal scores go to the smaller id; rows that share
an id count once, with their best score, before any list is cut; rows alike in id and vector are dealt once. Columns other than the id and the vector are not looked at. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CURVES, DIMS, BINS, SPREAD = 16, 4, 32, 1
TILE, SAMPLE = 8192, 20_000
BITS = 8


class Curves(NamedTuple):
    size: int
    directions: list[np.ndarray]  # size x DIMS
    places: list[np.ndarray]  # DIMS x sample: sorted projections
    shifts: list[np.ndarray]
    ranges: list[np.ndarray]  # first keys of the parts after the first


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of grid cells (rows of coordinates below 2 ** bits) on the Hilbert curve, by undoing the curve's turns from
    the coarsest level to the finest and interleaving the bits."""
    x = cells.T.astype(np.int64)
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level & 1)
    return key


def keys(vectors: np.ndarray, curves: Curves, c: int) -> np.ndarray:
    projected = vectors @ curves.directions[c]
    place = np.column_stack([np.searchsorted(p, projected[:, k]) / max(1, len(p)) for k, p in enumerate(curves.places[c])])
    return hilbert(np.minimum((place + curves.shifts[c]) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64))


def fit(sample: np.ndarray, seed: int = 5) -> Curves:
    """Curves for the vectors of a sample; equal ones count once."""
    sample, rng = np.unique(sample, axis=0), np.random.default_rng(seed)
    size = sample.shape[1]
    dims = min(DIMS, size)
    curves = Curves(size, [], [], [], [])
    turned: list[np.ndarray] = []
    for c in range(CURVES):
        if len(turned) < dims:
            turned = [*np.linalg.qr(rng.normal(size=(size, size)))[0].T]
        curves.directions.append(np.column_stack(turned[:dims]))
        turned = turned[dims:]
        curves.places.append(np.sort((sample @ curves.directions[c]).T, axis=1))
        curves.shifts.append(rng.random(dims))
        order = np.sort(keys(sample, curves, c))
        curves.ranges.append(np.unique(order[[len(order) * k // BINS for k in range(1, BINS)]]))
    return curves


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vec (array of double): the rows that take part, of any length."""
    vec = F.col(vector).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(finite & F.exists("vec", lambda x: x != 0))


def _deal(curves: Curves, parts: int, stride: int):
    """Sends each vector to its part on every curve, and queries also to the parts near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1000):
                rows = batch.slice(k, 1000)
                ids = rows.column(0).to_numpy()
                vectors = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, curves.size)
                packed = np.array([v.tobytes() for v in vectors.astype("<f8")], dtype=object)
                query = np.flatnonzero(ids % stride == 0)
                for c in range(CURVES):
                    bins = np.searchsorted(curves.ranges[c], keys(vectors, curves, c), "right")
                    sent = [(bins, (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts, np.arange(len(ids)), 0)]
                    for near in range(-SPREAD, SPREAD + 1):
                        there = bins[query] + near
                        inside = query[(there >= 0) & (there <= len(curves.ranges[c]))]
                        sent += [(bins[inside] + near, np.full(len(inside), p), inside, 1) for p in range(parts)]
                    for tile, part, at, kind in sent:
                        columns = [pa.array(tile + c * BINS, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), pa.array(ids[at]), pa.array(packed[at], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["tile", "part", "kind", "id", "vec"])

    return run


def _best(query: np.ndarray, name: int, ids: np.ndarray, near: np.ndarray, approximate: np.ndarray, most: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest ids, each once, with exact scores: summed in one order whatever the matrix product did, so that equal
    vectors tie. starts: where each id begins, of sorted ids that repeat."""
    other = ids != name
    best = approximate[other] if starts is None else np.maximum.reduceat(approximate, starts)[other[starts]]
    if len(best) > most:
        least = np.partition(best, -most)[-most]
        other &= approximate >= least - 1e-9 * (1 + abs(least))
    at = np.flatnonzero(other)
    score = (near[at] * query).sum(axis=1)
    order = np.lexsort((ids[at], -score))
    if starts is not None:
        order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])]
    order = order[:most]
    return ids[at][order], score[order]


def _by_id(ids: np.ndarray, vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Both in the order of the ids, and where each id begins."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    return [ids], [vectors[order]], np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))


def _search(size: int, most: int):
    """Rows sorted by tile, part and kind: a part's candidates, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, vectors, starts = None, [], [], None
        for batch in batches:
            here = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((here[1:] != here[:-1]).any(axis=1)) + 1).tolist(), len(here)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                names = batch.column(3).slice(a, b - a).to_numpy()
                rows = np.frombuffer(b"".join(batch.column(4).slice(a, b - a).to_pylist()), "<f8").reshape(-1, size)
                if tile != tuple(here[a, :2]):
                    tile, ids, vectors, starts = tuple(here[a, :2]), [], [], None
                if here[a, 2] == 0:
                    ids.append(names)
                    vectors.append(rows)
                elif ids:
                    if len(ids) > 1 or starts is None:
                        ids, vectors, starts = _by_id(np.concatenate(ids), np.concatenate(vectors))
                    out: list[tuple] = []
                    for k in range(0, len(names), 256):
                        product = rows[k : k + 256] @ vectors[0].T
                        for q, name, approximate in zip(rows[k : k + 256], names[k : k + 256].tolist(), product, strict=True):
                            found, score = _best(q, name, ids[0], vectors[0], approximate, most, starts if len(starts) < len(ids[0]) else None)
                            out.append((np.full(len(found), name), found, score))
                    columns = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, most: int = 20, stride: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``most`` nearest rows found for each row whose id is divisible by ``stride``."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    lengths = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not lengths:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    size, total = lengths[0]["size"], lengths[0]["count"]
    rows = rows.filter(F.size("vec") == size).distinct()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()
    curves = fit(np.array([r.vec for r in sample], np.float64))
    dealt = rows.mapInArrow(_deal(curves, -(-total // (BINS * TILE)), stride), "tile int, part int, kind int, id long, vec binary")
    found = dealt.repartition("tile", "part").sortWithinPartitions("tile", "part", "kind").mapInArrow(_search(size, most), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true pairs that are found, both with query_id and vec_id."""
    return found.join(truth, ["query_id", "vec_id"], "left_semi").count() / max(1, truth.count())
