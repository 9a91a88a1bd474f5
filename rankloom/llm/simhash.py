"""SimHash fingerprints and all their links through Gray-ordered hierarchical indexes.

Fingerprint: words are runs without ASCII white space, A-Z lower-cased; XXH64 (seed 42) of every three-word shingle; a
bit is set if more than half of the hashes have it. A text of one or two words is one shingle, a text without words (or
null) has fingerprint zero and is linked like any other.

Links (at most three differing bits) are searched between distinct fingerprints, so copies cost nothing:

* Routing. Three differences leave at least one of four 16-bit blocks untouched, so each fingerprint goes to the four
  groups of its blocks. A group with more than ``group_limit`` members is split by the same argument on the bits that its
  key leaves open (four blocks of 12, then of 9 bits), which is exact; a hot block so becomes many small groups.
* Index. The members of a group are sorted by Gray rank, where neighbours share long runs of bits. A node is a range of
  the order; it holds the bits that all its members share, as a mask and their pattern, so what lies above two nodes is
  factored out of them. Pairs of nodes descend together from the group's root: their shared bits already differ in more
  than three places, and the whole pair is pruned, or all bits that vary anywhere in them are three or fewer, and all
  their members are linked at once; else the larger node is halved. The frontier is worked on in pieces of bounded size.
* A group reports a spanning forest of its links, not all pairs: components lose nothing by that.

Components come from alternating large-star and small-star rounds over these edges, each a written table, until nothing
changes. Nodes are fingerprints, so that texts which share a doc_id are not linked by that; a component is then named by
the smallest doc_id of its rows.

Rows without doc_id are linked like all others; their component is named by the smallest doc_id in it, or null if no row
of it has one. Repeated rows are answered each. Only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.text import slices
from rankloom.session import stable

MAX_BITS = 3
SHINGLE = 3
SEED = 42


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line, n = b" ".join(words), len(words) - min(SHINGLE, len(words)) + 1
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[len(words) - n :] - 1).tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        counts += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        prints = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["key", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, fp (a long with the fingerprint's bits), one row per document row."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(_fingerprints, f"key {kind}, fp long").withColumnRenamed("key", key)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the reflected Gray order."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class Ranges:
    """AND and OR of any range of an array, from tables of powers of two."""

    def __init__(self, values: np.ndarray):
        self.all, self.any = [values], [values]
        k = 1
        while 2 * k <= len(values):
            self.all.append(self.all[-1][:-k] & self.all[-1][k:])
            self.any.append(self.any[-1][:-k] | self.any[-1][k:])
            k *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level = np.log2(hi - lo).astype(np.int64)
        both, either = np.empty(len(lo), np.uint64), np.empty(len(lo), np.uint64)
        for k in np.unique(level):
            at = level == k
            a, b = lo[at], hi[at] - (1 << int(k))
            both[at], either[at] = self.all[k][a] & self.all[k][b], self.any[k][a] | self.any[k][b]
        return both, either


def linked_ranges(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, piece: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of ranges all of whose members are linked, found from the pairs of the given root ranges with themselves.

    ``values`` are distinct within a root and Gray-ordered; yields arrays (a_lo, a_hi, b_lo, b_hi)."""
    ranges = Ranges(values)
    stack = [(lo, hi, lo, hi)]
    while stack:
        a, b, c, d = stack.pop()
        if len(a) > piece:
            half = len(a) // 2
            stack += [(a[:half], b[:half], c[:half], d[:half]), (a[half:], b[half:], c[half:], d[half:])]
            continue
        (all1, any1), (all2, any2) = ranges(a, b), ranges(c, d)
        differ = (all1 & ~any2) | (all2 & ~any1)  # bits shared in each node, and not the same
        vary = (any1 | any2) ^ (all1 & all2)
        go = np.bitwise_count(differ) <= MAX_BITS
        full = go & (np.bitwise_count(vary) <= MAX_BITS)
        if full.any():
            yield a[full], b[full], c[full], d[full]
        a, b, c, d = (x[go & ~full] for x in (a, b, c, d))
        if not len(a):
            continue
        same, wide = a == c, (b - a) >= (d - c)
        mid1, mid2 = (a + b) // 2, (c + d) // 2
        left, right = ~same & wide, ~same & ~wide
        parts = [
            (a[same], mid1[same], a[same], mid1[same]), (a[same], mid1[same], mid1[same], b[same]), (mid1[same], b[same], mid1[same], b[same]),
            (a[left], mid1[left], c[left], d[left]), (mid1[left], b[left], c[left], d[left]),
            (a[right], b[right], c[right], mid2[right]), (a[right], b[right], mid2[right], d[right]),
        ]
        stack.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forest(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Positions (x, y) that span each component of the links within the root ranges."""
    parent, edges, whole = list(range(len(values))), [], set()

    def join(x: int, y: int) -> None:
        x, y = _find(parent, x), _find(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            edges.append((x, y))

    for found in linked_ranges(values, lo, hi):
        root = np.array(parent)
        while (root != (up := root[root])).any():
            root = up
        news = (root[found[0]] != root[found[2]]) | (found[1] - found[0] > 1) | (found[3] - found[2] > 1)
        for a, b, c, d in zip(*(x[news].tolist() for x in found), strict=True):
            join(a, c)
            for start, end in {(a, b), (c, d)} - whole:
                for x in range(start + 1, end):
                    join(start, x)
                if end - start > 1:
                    whole.add((start, end))
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions sorted by group; whole groups are searched together, about 64k members at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def search(table: pa.Table) -> pa.RecordBatch:
        group, fp = table["group"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((gray_rank(fp), group))
        group, fp = group[order], fp[order]
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        end = np.append(cut[1:], len(group))
        big = end - cut > 1
        edges = np.array(forest(fp, cut[big], end[big]), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fp[edges[:, k]].view(np.int64)) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= 1 << 16:
            table = pa.Table.from_batches(held).combine_chunks()
            group = table["group"].to_numpy()
            keep = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if keep:
                yield search(table.slice(0, keep))
            held, rows = table.slice(keep).to_batches(), len(table) - keep
    if rows:
        yield search(pa.Table.from_batches(held))


def _masks(level: int) -> list[int]:
    """The bits that make the key of each of the 4 ** level groups of a fingerprint: at each level one of four blocks of
    the bits still open (16 bits, then 12, then 9). Mask n at one level is refined by masks 4 n to 4 n + 3 of the next."""
    out = [0]
    for _ in range(level):
        finer = []
        for mask in out:
            free = [b for b in range(64) if not mask >> b & 1]
            size = len(free) // 4
            finer += [mask | sum(1 << b for b in free[k * size : (k + 1) * size]) for k in range(4)]
        out = finer
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _groups(level: int) -> Column:
    """The keys of a fingerprint's groups of a level, in the order of ``_masks``."""
    return F.array(*[F.xxhash64(F.lit(level), F.lit(n), F.col("fp").bitwiseAND(F.lit(m))) for n, m in enumerate(_masks(level))])


def routed(prints: DataFrame, group_limit: int = 1 << 14, levels: int = 3) -> DataFrame:
    """fp, group: any two fingerprints within three bits meet in a group. Groups above the limit are split by the
    next level's blocks, but for those of the last level, which share 37 bits."""
    at, parts = prints.select("fp", F.explode(_groups(1)).alias("group")), []
    for level in range(1, levels):
        large = stable(at.groupBy("group").count().filter(F.col("count") > group_limit).select("group"))
        if large.isEmpty():
            break
        parts.append(at.join(large, "group", "left_anti").select("fp", "group"))
        finer = F.arrays_zip(_groups(level + 1).alias("group"), F.flatten(F.transform(_groups(level), lambda g: F.array_repeat(g, 4))).alias("above"))
        at = (
            at.join(large, "group", "left_semi")
            .select("fp", F.explode(F.filter(finer, lambda x: x["above"] == F.col("group"))).alias("x"))
            .select("fp", "x.group")
        )
    for part in parts:
        at = at.unionByName(part)
    return at


def star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges u > v; keeps components, pulls nodes to smaller ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: for each node of the edges (u, v) that is not the smallest of its component, that smallest."""
    at = stable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while state != (state := tuple(at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())):
        at = stable(star_round(at))
    return at.select(F.col("u").alias("node"), F.col("v").alias("component"))


def link_forest(prints: DataFrame, group_limit: int = 1 << 14) -> DataFrame:
    """u, v: edges between fingerprints that span the components of the links. prints: fp (distinct)."""
    return routed(prints, group_limit).repartition("group").sortWithinPartitions("group").mapInArrow(_links, "u long, v long")


def rooted(prints: DataFrame, group_limit: int = 1 << 14) -> DataFrame:
    """prints (fp, distinct, and other columns) with root: the smallest fingerprint of the component."""
    found = components(link_forest(prints, group_limit)).withColumnRenamed("component", "root")
    return prints.join(found, F.col("fp") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", group_limit: int = 1 << 14) -> DataFrame:
    """key, fp, component: one row per document row; key must be a long."""
    marked = stable(fingerprints(docs, key))
    prints = stable(marked.groupBy("fp").agg(F.min(key).alias("rep")))
    roots = stable(rooted(prints, group_limit))
    least = stable(roots.groupBy("root").agg(F.min("rep").alias("component")))
    classes = roots.join(least, "root").select("fp", "component")
    return marked.join(classes, "fp", "left").select(key, "fp", "component")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, of its smallest doc_id, or of the rows without id if it has no other; with all columns.

    The row is chosen by id and text, which are named by 128 bits: an id may have several texts. Of rows alike in both one
    is left, by a limit of one that Spark applies before the shuffle too, so that many copies do not meet in a task."""
    none = F.col("doc_id").isNull()
    name = [F.xxhash64(F.lit(k), none, "doc_id", F.col("text").isNull(), "text").alias(f"near_{k}") for k in (0, 1)]
    key = F.struct(none.alias("none"), "doc_id", *name).alias("key")
    marked = fingerprints(docs.select(key, "text"), "key")
    prints = stable(marked.groupBy("fp").agg(F.min("key").alias("rep")))
    kept = rooted(prints).groupBy("root").agg(F.min("rep").alias("rep")).select("rep.near_0", "rep.near_1")
    names = ["near_0", "near_1"]
    same = Window.partitionBy(*names).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    once = docs.select("*", *name).withColumn("near_n", F.row_number().over(same)).filter("near_n <= 1")
    return once.join(kept, names, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
