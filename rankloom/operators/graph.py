"""Correlation graph: return matrices, pairwise correlation, edges and snapshots.

All snapshots of a schedule are built in one plan keyed by ``valid_from``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.frames import by_entity
from rankloom.functions.groups import attach, calendar, day_numbers
from rankloom.functions.ranking import top_k
from rankloom.operators.clean import asof_dates
from rankloom.schema import safe_div
from rankloom.session import stable

BLOCK = 512  # entities per block: a task multiplies two BLOCK x lookback matrices at a time
PRUNED = 8  # blocks from which they are placed and pruned; chosen, not measured
GROUPS = 8  # groups of blocks that meet in pairs, so a vector is shuffled as often
RUN = 32  # cells that follow each other in one direction; 8 to 32 gave the smallest files
GROUP = 1 << 16  # entities of a group at most, about: a task holds one group; more entities make more groups


@dataclass(frozen=True)
class Selection:
    """Edge selection: ``top_k`` > 0 keeps the best per source, else ``corr > threshold``."""

    threshold: float = 0.8
    top_k: int = 0
    metric: str = "corr"

    def __post_init__(self) -> None:
        if self.metric not in ("corr", "abs_corr"):
            raise ValueError("metric must be corr or abs_corr")
        if self.top_k < 0:
            raise ValueError("top_k must not be negative")


# --- schedule --------------------------------------------------------------------------------


def snapshot_dates(spark: SparkSession, start: str, end: str, months: int) -> DataFrame:
    """E7. Snapshot dates every ``months`` months; 0 gives the start only.

    Each date is the one before moved on, so a start after day 28 keeps the day that its first short month left it.
    """
    one = spark.range(1)
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    if months == 0:
        return one.select(lo.alias("valid_from"))
    turns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.months_between(hi, lo) / int(months)).cast("int") + 1))
    moved = F.aggregate(turns, F.array(lo), lambda a, _: F.concat(a, F.array(F.add_months(F.element_at(a, -1), int(months)))))
    return one.select(F.explode(F.filter(moved, lambda d: d <= hi)).alias("valid_from"))


def snapshot_list(spark: SparkSession, dates: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(d,) for d in dates], "d string").select(F.col("d").cast("date").alias("valid_from"))


def snapshot_for_dates(df: DataFrame, snapshots: DataFrame) -> DataFrame:
    """E8, E9. Snapshot in force on each row's date (the first one before it starts) and its age."""
    s = snapshots.select(F.col("valid_from").alias("dt"), "valid_from").distinct()
    first = snapshots.agg(F.min("valid_from").alias("m")).scalar()
    out = asof_dates(df, s).withColumn("valid_from", F.coalesce("valid_from", first))
    return out.withColumn("age_days", F.datediff("dt", "valid_from"))


def months_elapsed(later: Column, earlier: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def update_due(current: Column, last_update: Column, months: int) -> Column:
    """E10. True when the graph has to be rebuilt; never for frequency 0, always without a graph."""
    if months == 0:
        return F.lit(False)
    return F.coalesce(months_elapsed(current, last_update) >= months, F.lit(True))


# --- returns ---------------------------------------------------------------------------------


def entity_returns(df: DataFrame) -> DataFrame:
    """(kdcode, dt, ret) from prev_close when the panel has it, else from the entity's last row."""
    prev = F.col("prev_close") if "prev_close" in df.columns else F.lag("close").over(by_entity())
    return df.select("kdcode", "dt", (safe_div(F.col("close"), prev) - 1).alias("ret"))


def return_rows(
    df: DataFrame, snapshots: DataFrame, lookback: int, members: DataFrame | None = None, inclusive: bool = False
) -> DataFrame:
    """E1. (valid_from, kdcode, pos, n, ret): returns of the last ``lookback`` market dates before a
    snapshot (up to it when ``inclusive``), numbered by date.

    Dates are matched to snapshots on the calendar; the panel is then joined by date equality.
    Missing cells stay out and count as the fill value later.
    """
    days = day_numbers(calendar(df)).withColumn("last_no", F.col("day_no"))
    edge = snapshots.select("valid_from", F.col("valid_from").alias("dt") if inclusive else F.date_sub("valid_from", 1).alias("dt"))
    spans = asof_dates(edge, days.select("dt", "last_no")).where(F.col("last_no").isNotNull())
    window_days = spans.select(
        "valid_from",
        F.explode(F.sequence(F.greatest(F.col("last_no") - lookback + 1, F.lit(0)), F.col("last_no"))).alias("day_no"),
    ).join(days.select("dt", "day_no"), "day_no")
    rets = entity_returns(df).where(F.col("ret").isNotNull())
    if members is not None:
        rets = rets.join(members.select("kdcode"), "kdcode", "left_semi")
    # Read for the dates that occur and for the rows. The windows have ``lookback`` rows a snapshot, whatever the entities.
    rows = stable(rets.join(F.broadcast(window_days.select("valid_from", "dt")), "dt"))
    w = Window.partitionBy("valid_from").orderBy("dt")  # one row per snapshot and date
    seen = rows.select("valid_from", "dt").distinct()
    seen = seen.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("valid_from")))
    return rows.join(seen, ["valid_from", "dt"]).select("valid_from", "kdcode", "pos", "n", "ret")


def entity_vectors(rows: DataFrame) -> DataFrame:
    """(valid_from, kdcode, n, idx, val): the filled cells of each entity, at most ``lookback`` of them."""
    cells = F.sort_array(F.collect_list(F.struct("pos", "ret")))
    return (
        rows.groupBy("valid_from", "kdcode", "n")
        .agg(cells.alias("c"))
        .select("valid_from", "kdcode", "n", F.col("c.pos").alias("idx"), F.col("c.ret").alias("val"))
    )


def dense(pdf: pd.DataFrame, fill: str) -> np.ndarray:
    """Rows of one snapshot as a matrix over its dates."""
    sizes = pdf["idx"].map(len).to_numpy()
    x = np.zeros((len(pdf), int(pdf["n"].iloc[0])))
    row, val = np.repeat(np.arange(len(pdf)), sizes), np.concatenate(pdf["val"].to_list())
    if fill == "mean":
        x += (np.bincount(row, val, len(pdf)) / sizes)[:, None]
    x[row, np.concatenate(pdf["idx"].to_list())] = val
    return x


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Centred rows of length 1; a constant row becomes NaN."""
    c = x - x.mean(axis=1, keepdims=True)
    norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
    constant = x.max(axis=1, keepdims=True) == x.min(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(constant, np.nan, c / norm)


# --- blocks ----------------------------------------------------------------------------------


def unit_vectors(rows: DataFrame, fill: str = "zero") -> DataFrame:
    """(valid_from, kdcode, vec): each entity's centred returns of length 1, packed; constant series have no correlation
    and drop out."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby("n"):
                units = unit_rows(dense(part, fill))
                ok = ~np.isnan(units).any(axis=1)
                yield part.loc[ok, ["valid_from", "kdcode"]].assign(vec=[v.tobytes() for v in units[ok]])

    return entity_vectors(rows).mapInPandas(pack, f"valid_from date, kdcode {_kind(rows)}, vec binary")


def _kind(rows: DataFrame) -> str:
    return rows.schema["kdcode"].dataType.simpleString()


def _unpack(vectors: Iterable[bytes]) -> np.ndarray:
    vectors = list(vectors)
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Neighbouring rows that agree in the first ``keys`` columns, as one table each."""
    held: list[pa.RecordBatch] = []
    name: tuple | None = None
    for batch in batches:
        codes = [np.unique(c.to_numpy(zero_copy_only=False), return_inverse=True)[1] for c in batch.columns[:keys]]
        change = np.zeros(max(0, len(batch) - 1), bool)
        for c in codes:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)] if len(batch) else []
        for i, j in zip(cuts, cuts[1:], strict=False):
            here = tuple(c[i].as_py() for c in batch.columns[:keys])
            if held and here != name:
                yield name, pa.Table.from_batches(held)
                held = []
            name = here
            held.append(batch.slice(i, j - i))
    if held:
        yield name, pa.Table.from_batches(held)


def place(units: DataFrame, n_blocks: int, block: int) -> DataFrame:
    """(valid_from, kdcode, vec, block): alike entities in blocks of about ``block``.

    Those whose hash is divisible by ``block`` are pivots, an entity goes to the cell of the pivot it correlates best with,
    and a cell above the size is split by a hash. Pivots are sent to each part of the entities, of which there are as many
    as groups, and stream past before them, so a task holds one part of the entities and one in ``block`` of all.
    """
    parts = _n_groups(n_blocks, block)
    own = F.array(F.struct(F.pmod(F.xxhash64("kdcode"), F.lit(parts)).alias("part"), F.lit(1).alias("kind")))
    to_all = F.transform(_numbers(parts), lambda p: F.struct(p.alias("part"), F.lit(0).alias("kind")))
    pivot = F.pmod(F.xxhash64(F.lit("pivot"), "kdcode"), F.lit(block)) == 0
    sent = units.select("valid_from", F.explode(F.when(pivot, F.concat(own, to_all)).otherwise(own)).alias("p"), "kdcode", "vec")
    sent = sent.select("valid_from", "p.part", "p.kind", "kdcode", "vec")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, of = None, None
        for (day, part, kind), rows in _runs(batches, 3):
            vectors = _unpack(rows["vec"].to_pylist())
            if kind == 0:
                pivots, of = vectors, (day, part)
                continue
            cell = np.argmax(vectors @ pivots.T, axis=1) if of == (day, part) else np.zeros(len(rows), np.int64)
            out = rows.select(["valid_from", "kdcode", "vec"]).append_column("cell", pa.array(cell, pa.int64()))
            yield from out.combine_chunks().to_batches()

    order = ["valid_from", "part", "kind", "kdcode"]
    celled = sent.repartition("valid_from", "part").sortWithinPartitions(*order).mapInArrow(assign, f"valid_from date, kdcode {_kind(units)}, vec binary, cell bigint")
    celled = attach(stable(celled), ["valid_from", "cell"], _n=F.count("*"))
    split = F.pmod(F.xxhash64(F.lit("block"), "kdcode"), F.ceil(F.col("_n") / F.lit(float(block))).cast("int"))
    return celled.select("valid_from", "kdcode", "vec", (F.col("cell") * (1 << 24) + split).alias("block"))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _score(corr: np.ndarray, sel: Selection) -> np.ndarray:
    return np.abs(corr) if sel.metric == "abs_corr" and sel.top_k else corr


def _cap(units: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius of a cap of the unit sphere that holds the vectors."""
    mean = units.mean(axis=0)
    length = np.sqrt(mean @ mean)
    centre = mean / length if length > 1e-12 else units[0]
    return centre, float(np.arccos(np.clip(units @ centre, -1, 1)).max())


def _floors(units: np.ndarray, sel: Selection) -> np.ndarray:
    """The score that an edge of each entity must reach: the threshold, or its k-th score inside its block."""
    if sel.top_k == 0:
        return np.full(len(units), sel.threshold)
    if len(units) <= sel.top_k:
        return np.full(len(units), -2.0)
    score = _score(units @ units.T, sel)
    np.fill_diagonal(score, -2.0)
    return np.partition(score, -sel.top_k, axis=1)[:, -sel.top_k]


def _bound(angle: np.ndarray, spare: np.ndarray, sel: Selection) -> np.ndarray:
    """The largest score between caps whose centres are ``angle`` apart and whose radii sum to ``spare``."""
    bound = np.cos(np.maximum(0, angle - spare))
    if sel.metric == "abs_corr" and sel.top_k:
        bound = np.maximum(bound, np.cos(np.maximum(0, np.pi - angle - spare)))
    return bound


def block_summaries(blocks: DataFrame, sel: Selection) -> DataFrame:
    """(valid_from, block, size, centre, radius, floor): the cap of the unit sphere that holds a block, and the score which
    an edge from it must reach: the threshold, or the weakest of its sources' k-th scores inside the block."""

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        units = _unpack(pdf["vec"])
        centre, radius = _cap(units)
        floor = float(_floors(units, sel).min())
        return pd.DataFrame({"valid_from": [key[0]], "block": [key[1]], "size": [len(units)], "centre": [centre.tobytes()], "radius": [radius], "floor": [floor]})

    return blocks.groupBy("valid_from", "block").applyInPandas(summary, "valid_from date, block bigint, size int, centre binary, radius double, floor double")


SLACK = 1e-7  # above the rounding of an angle near 0
NEAR = 1e-4  # above the rounding of a product of unit vectors in single precision
GATHER = 1 << 14  # pairs whose products are summed at a time


def block_pairs(summaries: DataFrame, sel: Selection) -> DataFrame:
    """(valid_from, a, b, bound, needed): pairs of blocks with the largest score an edge between them can have, to see what
    can be pruned; ``correlate`` finds the same bounds inside its tasks.

    Two caps whose centres are ``w`` apart hold no two points nearer than w less both radii. Pairs whose bound is below
    what block a needs hold no edge from it. A snapshot's summaries meet in one task: one vector in BLOCK. With a
    threshold a pair is named once (a <= b).
    """

    def bounds(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        centres, radius = _unpack(pdf["centre"]), pdf["radius"].to_numpy()
        bound = _bound(np.arccos(np.clip(centres @ centres.T, -1, 1)), radius[:, None] + radius[None, :], sel)
        np.fill_diagonal(bound, 2.0)  # a block meets itself first
        needed = bound >= pdf["floor"].to_numpy()[:, None] - SLACK
        i, j = np.nonzero(np.ones_like(needed) if sel.top_k else np.triu(np.ones_like(needed)))
        name = pdf["block"].to_numpy()
        return pd.DataFrame({"valid_from": key[0], "a": name[i], "b": name[j], "bound": bound[i, j], "needed": needed[i, j]})

    return summaries.groupBy("valid_from").applyInPandas(bounds, "valid_from date, a bigint, b bigint, bound double, needed boolean")


def _n_groups(n_blocks: int, block: int) -> int:
    return min(n_blocks, max(GROUPS, math.ceil(n_blocks * block / GROUP)))


def _by_hash(units: DataFrame, n_blocks: int) -> DataFrame:
    return units.withColumn("block", F.pmod(F.xxhash64("kdcode"), F.lit(n_blocks).cast("bigint")))


def _tiles(blocks: DataFrame, groups: int) -> DataFrame:
    """Rows for all pairs of groups of blocks (a <= b), those of group a (side 0) before those of b, block by block.

    The number of groups does not grow with the entities until a group would exceed ``GROUP``, and neither does the number
    of copies of a vector.
    """
    group = F.pmod(F.xxhash64("block"), F.lit(groups).cast("bigint"))
    rows = blocks.withColumn("g", group).select("valid_from", F.explode(_numbers(groups)).alias("o"), "g", "block", "kdcode", "vec")
    side = F.when(F.col("g") <= F.col("o"), 0).otherwise(1)
    rows = rows.select("valid_from", F.least("g", "o").alias("a"), F.greatest("g", "o").alias("b"), side.alias("side"), "block", "kdcode", "vec")
    tiles = groups * (groups + 1) // 2
    return rows.repartition(2 * tiles, "valid_from", "a", "b").sortWithinPartitions("valid_from", "a", "b", "side", "block", "kdcode")


class _Block:
    """Entities of a block and, with a selection, what is known of their edges."""

    def __init__(self, name: int, ids: pa.Array, units: np.ndarray, sel: Selection | None) -> None:
        self.name, self.ids, self.units, self.sel = name, ids, units, sel
        if sel is not None:
            self.near = units.astype(np.float32)
            self.centre, self.radius = _cap(units)
            self.least = _floors(units, sel)
            self.numbers = ids.to_numpy(zero_copy_only=False)
            self.found: list[tuple] = []  # source, corr, destination
            self.waiting = 0

    def add(self, src: np.ndarray, corr: np.ndarray, dst: np.ndarray) -> None:
        """Edges of the block; its k best are sorted out when enough have come. Equal scores go to the smaller name."""
        self.found.append((src, corr, dst))
        self.waiting += len(src)
        if self.waiting > 2 * self.sel.top_k * len(self.units):
            self.settle()

    def settle(self) -> None:
        k = self.sel.top_k
        src, corr, dst = (np.concatenate(c) for c in zip(*self.found, strict=True))
        score = _score(corr, self.sel)
        order = np.lexsort((np.unique(dst, return_inverse=True)[1], -score, src))
        first = np.searchsorted(src[order], np.arange(len(self.units)))
        place = np.arange(len(order)) - first[src[order]]
        keep = order[place < k]
        self.found, self.waiting = [(src[keep], corr[keep], dst[keep])], 0
        full = order[place == k - 1]
        self.least[src[full]] = np.maximum(self.least[src[full]], score[full])

    def edges(self, day) -> Iterator[pa.RecordBatch]:
        if self.found:
            self.settle()
            src, corr, dst = self.found[0]
            yield _edges(day, self.ids.take(pa.array(src)), pa.array(dst, self.ids.type), corr)


def _meetings(batches: Iterator[pa.RecordBatch], sel: Selection | None = None) -> Iterator[tuple]:
    """(day, block, blocks it meets) of sorted rows, each pair of blocks of a tile once, a block of a diagonal tile with
    itself last; at the end of a tile (day, None, the blocks of its first group). Holds a group and a block."""
    held: list[_Block] = []
    of = None
    for (day, a, b, side, name), rows in _runs(batches, 5):
        if of != (day, a, b):
            if held:
                yield of[0], None, held
            held, of = [], (day, a, b)
        block = _Block(name, rows["kdcode"].combine_chunks(), _unpack(rows["vec"].to_pylist()), sel)
        if a == b:
            yield day, block, [*held, block]
        elif side == 1:
            yield day, block, held
        if side == 0:
            held.append(block)
    if held:
        yield of[0], None, held


def _promising(block: _Block, others: list[_Block]) -> Iterator[_Block]:
    """Those that can hold an edge with the block: itself first, then by falling bounds."""
    if others and others[-1] is block:
        others = others[:-1]
        yield block
    if others:
        angle = np.arccos(np.clip(np.array([o.centre for o in others]) @ block.centre, -1, 1))
        bound = _bound(angle, np.array([o.radius for o in others]) + block.radius, block.sel)
        for k in np.argsort(-bound):
            if bound[k] >= min(block.least.min(), others[k].least.min()) - SLACK:
                yield others[k]


def _exact(a: _Block, i: np.ndarray, b: _Block, j: np.ndarray) -> np.ndarray:
    """Correlations of pairs, summed in one order, so that equal series tie."""
    out = np.empty(len(i))
    for k in range(0, len(i), GATHER):
        out[k : k + GATHER] = (a.units[i[k : k + GATHER]] * b.units[j[k : k + GATHER]]).sum(axis=1)
    return out


def _top_edges(sel: Selection):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for day, block, others in _meetings(batches, sel):
            if block is None:
                for o in others:
                    yield from o.edges(day)
                continue
            for o in _promising(block, others):
                score = _score(block.near @ o.near.T, sel)
                if o is block:
                    np.fill_diagonal(score, -4.0)
                i, j = np.nonzero((score >= block.least[:, None].astype(np.float32) - NEAR) | (score >= o.least[None, :].astype(np.float32) - NEAR))
                on = score[i, j] > -3.0
                i, j = i[on], j[on]
                corr = _exact(block, i, o, j)
                exact = _score(corr, sel)
                ours = exact >= block.least[i] - 1e-9
                block.add(i[ours], corr[ours], o.numbers[j[ours]])
                if o is not block:
                    theirs = exact >= o.least[j] - 1e-9
                    o.add(j[theirs], corr[theirs], block.numbers[i[theirs]])
            if not others or others[-1] is not block:
                yield from block.edges(day)

    return run


def _threshold_edges(sel: Selection):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for day, block, others in _meetings(batches, sel):
            for o in _promising(block, others) if block is not None else ():
                i, j = np.nonzero(block.near @ o.near.T > np.float32(sel.threshold - NEAR))
                corr = _exact(block, i, o, j)
                ok = (corr > sel.threshold) & ((i != j) if o is block else True)
                src, dst = block.ids.take(pa.array(i[ok])), o.ids.take(pa.array(j[ok]))
                yield _edges(day, src, dst, corr[ok])
                if o is not block:
                    yield _edges(day, dst, src, corr[ok])

    return run


def _edges(day, src: pa.Array, dst: pa.Array, corr: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([day] * len(src), pa.date32()), src, dst, pa.array(corr)]
    return pa.RecordBatch.from_arrays(columns, names=["valid_from", "src", "dst", "corr"])


def _n_blocks(units: DataFrame, block: int) -> int:
    return max(1, math.ceil(units.select("kdcode").distinct().count() / block))


def correlation_matrix(rows: DataFrame, fill: str = "zero", block: int = BLOCK) -> DataFrame:
    """E2, E13. (valid_from, a, b, src, dst, corr): the upper half of the matrix in packed blocks, one row for two blocks
    of about ``block`` entities. ``corr`` holds the cells row by row; ``cells`` and the functions after it read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for day, block, others in _meetings(batches):
            for o in others if block is not None else ():
                a, b = sorted((block, o), key=lambda x: x.name)
                cell = pa.array([(a.units @ b.units.T).ravel()], pa.list_(pa.float64()))
                columns = [pa.array([day], pa.date32()), pa.array([a.name]), pa.array([b.name]), _listed(a.ids), _listed(b.ids), cell]
                yield pa.RecordBatch.from_arrays(columns, names=["valid_from", "a", "b", "src", "dst", "corr"])

    kind = _kind(rows)
    units = stable(unit_vectors(rows, fill))
    n_blocks = _n_blocks(units, block)
    met = _tiles(_by_hash(units, n_blocks), _n_groups(n_blocks, block))
    return met.mapInArrow(run, f"valid_from date, a bigint, b bigint, src array<{kind}>, dst array<{kind}>, corr array<double>")


def _listed(ids: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)


def cells(matrix: DataFrame, keep: Column | None = None) -> DataFrame:
    """(valid_from, src, dst, corr) of all pairs of different entities, both directions, or of those for which ``keep``,
    an expression over src, dst and corr, holds; it sees each direction.

    ``RUN`` cells of an entity are followed by the same cells the other way, so that a file of them repeats itself at short
    distances: 4.4 bytes a row where alternating directions take 7.9.
    """
    width = F.size("dst")
    pieces = F.ceil(width / F.lit(RUN)).cast("int")
    numbered = F.explode(F.sequence(F.lit(0), F.size("src") * pieces - 1)).alias("_k")
    at = matrix.where((F.size("src") > 0) & (width > 0)).select("valid_from", "a", "b", "src", "dst", "corr", numbered)
    row, start = F.floor(F.col("_k") / pieces).cast("int"), F.col("_k") % pieces * RUN
    piece = F.slice("corr", row * width + start + 1, F.least(F.lit(RUN), width - start))
    run = at.select("valid_from", "a", "b", F.get("src", row).alias("_one"), "dst", start.alias("_start"), piece.alias("_c"))
    ways = F.when(F.col("a") < F.col("b"), F.concat("_c", "_c")).otherwise(F.col("_c"))
    flat = run.select("valid_from", "_one", "dst", "_start", F.size("_c").alias("_n"), F.posexplode(ways).alias("_at", "corr"))
    back = F.col("_at") >= F.col("_n")
    other = F.get("dst", F.col("_start") + F.col("_at") % F.col("_n"))
    both = flat.select("valid_from", F.when(back, other).otherwise(F.col("_one")).alias("src"), F.when(back, F.col("_one")).otherwise(other).alias("dst"), "corr")
    both = both.where(F.col("src") != F.col("dst"))
    return both if keep is None else both.where(keep)


def matrix_row(matrix: DataFrame, entity: object) -> DataFrame:
    """Correlations of one entity with all others: only its blocks are opened, and only its cells leave them."""
    e = F.lit(entity)
    i, j = F.array_position("src", e), F.array_position("dst", e)
    width = F.size("dst")
    along = F.when(i > 0, F.transform(F.col("dst"), lambda d, k: F.struct(d.alias("dst"), F.get("corr", ((i - 1) * width + k).cast("int")).alias("corr"))))
    down = F.when((j > 0) & (F.col("a") < F.col("b")), F.transform(F.col("src"), lambda s, k: F.struct(s.alias("dst"), F.get("corr", (k * width + j - 1).cast("int")).alias("corr"))))
    found = matrix.where((i > 0) | (j > 0)).select("valid_from", F.explode(F.coalesce(along, down)).alias("c"))
    return found.select("valid_from", e.alias("src"), "c.dst", "c.corr").where(F.col("dst") != e)


def matrix_cell(matrix: DataFrame, src: object, dst: object) -> DataFrame:
    """(valid_from, corr) of one pair."""
    return matrix_row(matrix, src).where(F.col("dst") == F.lit(dst)).select("valid_from", "corr")


def correlate(rows: DataFrame, sel: Selection | None, fill: str = "zero", block: int = BLOCK) -> DataFrame:
    """E2-E4, E13. (valid_from, src, dst, corr) of the kept pairs, both directions; all cells for ``sel=None``.

    A task takes two groups of blocks of about ``block`` entities, holds the first and streams the other past it, and keeps
    the k best of each source of both; the k best of all tasks are merged after them. Each pair is multiplied once, in single
    precision; what may be an edge then in double precision. From ``PRUNED`` blocks on alike entities share blocks, and
    pairs of blocks whose bound (``block_pairs``) holds no edge are left out.
    """
    if sel is None:
        return cells(correlation_matrix(rows, fill, block))
    units = stable(unit_vectors(rows, fill))  # counted and sent on
    n_blocks = _n_blocks(units, block)
    blocks = _by_hash(units, n_blocks) if n_blocks < PRUNED else place(units, n_blocks, block)
    kind = _kind(rows)
    found = _top_edges(sel) if sel.top_k else _threshold_edges(sel)
    edges = _tiles(blocks, _n_groups(n_blocks, block)).mapInArrow(found, f"valid_from date, src {kind}, dst {kind}, corr double")
    return _best_edges(edges, sel).drop("pos") if sel.top_k else edges


def _best_edges(edges: DataFrame, sel: Selection) -> DataFrame:
    score = F.abs("corr") if sel.metric == "abs_corr" else F.col("corr")
    return top_k(edges, ["valid_from", "src"], [score.desc(), F.col("dst").asc()], sel.top_k, "pos")


def rank_edges(edges: DataFrame, sel: Selection) -> DataFrame:
    """E4, E5. Final selection with attributes.

    Top-K: the best per source, destination ascending on ties; ``rank_pct`` uses the kept count.
    """
    c = F.col("corr")
    if sel.top_k > 0:
        edges = _best_edges(edges, sel)
        kept = F.max("pos").over(Window.partitionBy("valid_from", "src"))  # at most top_k rows
        edges = edges.withColumn("rank_pct", (kept - F.col("pos") + 1) / kept).drop("pos")
    else:
        edges = edges.withColumn("rank_pct", F.lit(0.0))
    return edges.select(
        "valid_from", "src", "dst", "corr", F.abs(c).alias("abs_corr"), (c * c).alias("corr_sq"), "rank_pct"
    )


def build_graph(
    df: DataFrame, snapshots: DataFrame, sel: Selection, lookback: int = 252, members: DataFrame | None = None
) -> DataFrame:
    """E1-E5, E7. Edges of every snapshot."""
    return rank_edges(correlate(return_rows(df, snapshots, lookback, members), sel), sel)


# --- lead-lag --------------------------------------------------------------------------------


def row_corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise correlation; NaN where a side has no spread or fewer than 5 dates are left."""
    if a.shape[1] < 5:
        return np.full(len(a), np.nan)
    flat = (a.std(axis=1) < 1e-12) | (b.std(axis=1) < 1e-12)
    ca, cb = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (ca * cb).sum(axis=1) / np.sqrt((ca * ca).sum(axis=1) * (cb * cb).sum(axis=1))
    return np.where(flat, np.nan, r)


def add_lead_lag(edges: DataFrame, rows: DataFrame, lags: Sequence[int] = (1, 2, 3, 5)) -> DataFrame:
    """E6. ``lag_norm`` and ``lag_corr``: the lag (0 first) with the strongest correlation of src
    with the later dst; 0 when none can be computed.
    """
    v = stable(entity_vectors(rows))  # joined once per end of an edge
    both = edges.join(
        v.select("valid_from", F.col("kdcode").alias("src"), "n", F.col("idx").alias("idx_a"), F.col("val").alias("val_a")),
        ["valid_from", "src"],
    ).join(
        v.select("valid_from", F.col("kdcode").alias("dst"), F.col("idx").alias("idx_b"), F.col("val").alias("val_b")),
        ["valid_from", "dst"],
    )
    tried = [0, *lags]
    top = max(lags) if lags else 1

    @F.pandas_udf("lag int, lag_corr double")
    def best_lag(n: pd.Series, ia: pd.Series, va: pd.Series, ib: pd.Series, vb: pd.Series) -> pd.DataFrame:
        lag = np.zeros(len(n), dtype="int32")
        corr = np.zeros(len(n))
        for size in n.unique():
            at = np.flatnonzero(n == size)
            a = dense(pd.DataFrame({"n": size, "idx": ia.iloc[at], "val": va.iloc[at]}), "zero")
            b = dense(pd.DataFrame({"n": size, "idx": ib.iloc[at], "val": vb.iloc[at]}), "zero")
            best = np.full(len(at), -1.0)
            for k in tried:
                if k >= size:
                    continue
                r = row_corr(a[:, : size - k], b[:, k:])
                better = np.abs(r) > best
                best = np.where(better, np.abs(r), best)
                lag[at] = np.where(better, k, lag[at])
                corr[at] = np.where(better, r, corr[at])
        return pd.DataFrame({"lag": lag, "lag_corr": corr})

    out = both.withColumn("_l", best_lag("n", "idx_a", "val_a", "idx_b", "val_b"))
    return out.select(
        *edges.columns, (F.col("_l.lag") / F.lit(float(top))).alias("lag_norm"), F.col("_l.lag_corr").alias("lag_corr")
    )


# --- sectors and statistics ------------------------------------------------------------------


def sector_edges(entities: DataFrame, sectors: DataFrame, k: int) -> DataFrame:
    """E11. Each entity to its first ``k`` same-sector peers in entity order, weight 1.

    Only the first k + 1 names of a sector can be peers, so a sector of any size is reduced to
    those before it is joined back.
    """
    s = entities.select("kdcode").distinct().join(sectors.select("kdcode", "sector"), "kdcode", "left")
    s = s.withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN")))
    first = (
        top_k(s, ["sector"], [F.col("kdcode").asc()], k + 1, "pos")
        .groupBy("sector")
        .agg(F.sort_array(F.collect_list("kdcode")).alias("peers"))
    )
    joined = s.join(first, "sector")
    peers = F.slice(F.array_remove(F.col("peers"), F.col("kdcode")), 1, k)
    return joined.select(F.col("kdcode").alias("src"), F.explode(peers).alias("dst"), F.lit(1.0).alias("weight"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """E12. Edge counts and weights per snapshot."""
    return edges.groupBy("valid_from").agg(
        F.count("*").alias("n_edges"),
        F.floor(F.count("*") / 2).alias("n_unique_edges"),
        F.avg("corr").alias("avg_weight"),
        F.min("corr").alias("min_weight"),
        F.max("corr").alias("max_weight"),
    )
