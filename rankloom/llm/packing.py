"""Best-fit packing of documents into sequences by large-item matching.

A document is its token ids and an end id. Longer ones than a sequence are cut into pieces of the full length, of which
the first may be shorter. A piece above a third of the capacity shares its sequence with at most one other such piece:
these are matched greedily, the longest left with the longest that still fits. All smaller pieces then go, longest
first, to the smallest gap that takes them, or open a sequence.

Only lengths matter for that, and there are at most ``capacity`` of them. So the plan is made on the counts of the
lengths, for all pieces of a length at once: it is a list of patterns (lengths side by side) with how often each occurs,
bounded by the capacity and not by the data. Then the pieces of each length are numbered, in salted parts with the sum of
the parts before, and piece number k takes slot number k of its length.

A null or empty text is one piece with the end id alone. Repeated rows and rows without doc_id are packed like others.
An empty table gives no rows. Only doc_id and text are looked at, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.text import slices
from rankloom.llm.tokens import byte_bpe
from rankloom.session import stable

CAPACITY = 1024
END = 2


def _pieces(tokenizer: str, capacity: int, end: int, with_ids: bool):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        for batch, texts in slices(batches, 1 << 20):
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, doc in enumerate(encoder.encode([t.decode() for t in texts])):
                data = memoryview(doc + tail)
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k in range(len(cuts) - 1):
                    part = data[4 * cuts[k] : 4 * cuts[k + 1]]
                    of.append(row)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 and on demand ids; at least one row per document row."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pieces(tokenizer, capacity, end, with_ids), schema).withColumnRenamed("key", key)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how often each occurs; together they hold each length as often as ``counts`` says."""
    left = {n: c for n, c in counts.items() if c}
    open_bins: dict[int, list[list]] = {}  # gap: [pattern, times]
    gaps: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def add(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if not gap:
            done.append((pattern, times))
        elif gap in open_bins:
            open_bins[gap].append([pattern, times])
        else:
            open_bins[gap] = [[pattern, times]]
            insort(gaps, gap)

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        fits = [p for p in large if p <= capacity - n and (p != n or left[n] > 1)]
        if not fits:
            add((n,), left.pop(n))
            large.pop()
            continue
        p = fits[-1]
        times = left[n] // 2 if p == n else min(left[n], left[p])
        add((n, p), times)
        left[n] -= times
        left[p] -= times
        large = [x for x in large if left[x]]
    for n in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):  # no gap takes it
                each = capacity // n
                if times := left[n] // each:
                    add((n,) * each, times)
                    left[n] -= times * each
                if left[n]:
                    add((n,) * left[n], 1)
                    left[n] = 0
                break
            gap = gaps[at]
            pattern, there = open_bins[gap][-1]
            each = min(gap // n, left[n])  # best fit would choose the same bins again, as their gaps only shrink
            times = min(there, left[n] // each)
            if times == there:
                open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap]
                    gaps.pop(at)
            else:
                open_bins[gap][-1][1] -= times
            add(pattern + (n,) * each, times)
            left[n] -= each * times
    return done + [(p, t) for groups in open_bins.values() for p, t in groups]


def _placed(patterns: list[tuple[tuple[int, ...], int]]):
    """Gives piece number k of a length its sequence and offset."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            slots.setdefault(n, []).append((times, base, offset))
            offset += n
        base += times
    first, lengths, bases, offsets = [], [], [], []
    for n in sorted(slots):
        k = 0
        for times, sequence, offset in slots[n]:
            first.append(k)
            lengths.append(n)
            bases.append(sequence)
            offsets.append(offset)
            k += times
    start, bases, offsets = np.array(first, np.int64), np.array(bases, np.int64), np.array(offsets, np.int64)
    keys = np.array(lengths, np.int64) * (1 << 44) + start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(batch.schema.get_field_index("number")).to_numpy()
            at = np.searchsorted(keys, batch.column(batch.schema.get_field_index("length")).to_numpy() * (1 << 44) + k, "right") - 1
            kept = [i for i, name in enumerate(batch.schema.names) if name != "number"]
            columns = [batch.column(i) for i in kept] + [pa.array(bases[at] + (k - start[at])), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in kept] + ["sequence_id", "offset"])

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset."""
    names = parts.columns
    spread = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = stable(parts.withColumn("salt", F.pmod(F.xxhash64(*[c for c in names if c != "ids"]), F.lit(spread)).cast("int")))
    counted = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy(*[c for c in names if c != "ids"])
    numbered = (
        salted.withColumn("row", F.row_number().over(order))
        .join(offsets, ["length", "salt"])
        .select(*names, (F.col("before") + F.col("row") - 1).alias("number"))
    )
    lengths = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return numbered.mapInArrow(_placed(plan(lengths, capacity)), schema)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences; ``placed`` must have the pieces' ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
