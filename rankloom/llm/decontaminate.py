"""Benchmark decontamination by Wu-Manber search for many strings.

Words are lower-cased (A-Z) runs of bytes that are letters, digits or not ASCII. A pattern is a window of 13 consecutive
words of a benchmark item, or the whole item if it has fewer; it is searched as ``" w1 w2 ... "`` in documents written
the same way, so that only whole words match.

For patterns of at least m bytes, a table gives every hashed block of B bytes the distance from its last place in the
first m bytes of any pattern to their end. Where the distance is positive, the search skips ahead by it; where it is
zero, the hash of the m bytes selects the few patterns to compare directly. Patterns are grouped by length (short ones
would make all shifts short), and all documents of a batch advance together, one step of the search at a time.

The patterns of a block of items (``block_bytes`` of item text at most, or one item) go to the executors in a closure; a
larger benchmark is searched in several blocks, one after the other, each adding its hits to the rows.

Null texts and empty texts have no words: they are never hit, and empty items have no windows. Items with the same text
all count; items without item_id are searched if ``nameless`` says so (the query and the pipeline do), and are hit without
being named. A document row is answered for itself,
also if its doc_id repeats or is null. Only the key and text columns are looked at; other names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.text import key_and_text, slices, words_of

WINDOW_WORDS = 13
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Group(NamedTuple):
    """Patterns of similar length: ``m`` bytes are searched with blocks of ``width``; tables by hash."""

    m: int
    width: int
    bits: int
    shift: np.ndarray
    buckets: dict[int, list[int]]


class Patterns(NamedTuple):
    texts: list[bytes]
    words: list[int]
    items: list[list[str]]
    groups: list[Group]


def _grams(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes (at most 8) from each place, mixed."""
    word = np.zeros(len(at), np.uint64)
    for k in range(width):
        word = (word << np.uint64(8)) | data[at + k]
    return word * _MIX


def _suffix(data: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m bytes from each place."""
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, m, 8):
            width = min(8, m)
            total = (total ^ _grams(data, at + min(k, m - width), width)) * _MIX
            total ^= total >> np.uint64(29)
    return total


def compile_patterns(items: list[tuple[str | None, bytes]], window: int = WINDOW_WORDS) -> Patterns:
    """The windows of (item id, text) pairs with their search tables."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    counts: dict[bytes, int] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1)):
            if part := words[i : i + window]:
                key = b" " + b" ".join(part) + b" "
                owners[key].update([item] if item is not None else [])
                counts[key] = len(part)
    texts = sorted(owners, key=lambda t: (len(t), t))
    by_length: dict[int, list[int]] = defaultdict(list)
    for n, text in enumerate(texts):
        by_length[len(text).bit_length()].append(n)
    groups = []
    for members in by_length.values():
        m = min(len(texts[n]) for n in members)
        width = min(8, m)
        heads = np.frombuffer(b"".join(texts[n][:m] for n in members), np.uint8)
        starts = np.arange(len(members)) * m
        bits = max(12, min(24, int(np.log2(len(members) * m)) + 4))
        shift = np.full(1 << bits, m - width + 1, np.int32)
        for k in range(m - width + 1):
            np.minimum.at(shift, (_grams(heads, starts + k, width) >> np.uint64(64 - bits)).astype(np.int64), m - width - k)
        buckets: dict[int, list[int]] = defaultdict(list)
        for n, h in zip(members, _suffix(heads, starts, m).tolist(), strict=True):
            buckets[h].append(n)
        groups.append(Group(m, width, bits, shift, dict(buckets)))
    return Patterns(texts, [counts[t] for t in texts], [sorted(owners[t]) for t in texts], groups)


def occurrences(data: bytes, lanes: np.ndarray, ends: np.ndarray, g: Group, texts: list[bytes]) -> list[tuple[int, int]]:
    """(place, pattern) of every occurrence in ``data``; lane i searches places lanes[i] up to ends[i]."""
    array, found = np.frombuffer(data, np.uint8), []
    keys = np.array(sorted(g.buckets), np.uint64)
    at, last = lanes, np.minimum(ends, len(array)) - g.m
    while len(at := at[alive := at <= last]):
        last = last[alive]
        step = g.shift[(_grams(array, at + (g.m - g.width), g.width) >> np.uint64(64 - g.bits)).astype(np.int64)]
        if len(stop := at[step == 0]):
            h = _suffix(array, stop, g.m)
            known = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
            for place, key in zip(stop[known].tolist(), h[known].tolist(), strict=True):
                found += [(place, n) for n in g.buckets[key] if data.startswith(texts[n], place)]
        at = at + np.maximum(step, 1)
    return found


SPANS, ITEMS = pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())
LANE = 2048


def _search(patterns: Patterns, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            rows = [words_of(t) for t in texts]
            lines = [b" " + b" ".join(w) + b" " for w in rows]
            data = b"\n".join(lines)
            starts = np.cumsum([0, *(len(x) + 1 for x in lines)])
            spans, items = batch.column("spans").to_pylist(), [set(x) for x in batch.column("items").to_pylist()]
            lanes = np.arange(0, len(data), LANE)
            # an occurrence belongs to the lane where it begins, and may run on into the next
            found = [x for g in patterns.groups for x in occurrences(data, lanes, lanes + (LANE + g.m - 1), g, patterns.texts)]
            spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) if found else lanes
            for place, n in found:
                row = int(np.searchsorted(starts, place, "right")) - 1
                first = int(np.searchsorted(spaces, place) - np.searchsorted(spaces, starts[row]))
                spans[row].append([first, first + patterns.words[n]])
                items[row].update(patterns.items[n])
            columns = {"key": batch.column("key"), "n_words": pa.array([len(w) for w in rows], pa.int64()), "spans": pa.array([sorted(x) for x in spans], SPANS), "items": pa.array([sorted(x) for x in items], ITEMS)}
            if keep_text and "text" in batch.schema.names:
                columns["text"] = batch.column("text")
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    return run


def item_blocks(benchmark: DataFrame, block_bytes: int, nameless: bool = False) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of about ``block_bytes`` of text; the driver holds one block at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text <> ''").filter(F.lit(nameless) | F.col("item").isNotNull())
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for part in range(n):
        yield [(r.item, r.text.encode()) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == part).collect()]


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW_WORDS, block_bytes: int = 32 << 20, nameless: bool = False) -> DataFrame:
    """One row per document row: its key column, n_words, spans (word ranges of the occurring windows, sorted) and items
    (ids of the items that they belong to, sorted as strings)."""
    kind = docs.schema[key].dataType.simpleString()
    columns = key_and_text(docs, key)
    found = docs.select(*columns, F.expr("CAST(array() AS array<array<long>>)").alias("spans"), F.expr("CAST(array() AS array<string>)").alias("items"))
    compiled = (compile_patterns(block, window) for block in item_blocks(benchmark, block_bytes, nameless))
    ahead = next(compiled)
    while ahead is not None:
        patterns, ahead = ahead, next(compiled, None)
        found = found.mapInArrow(
            _search(patterns, keep_text=ahead is not None),
            f"key {kind}, n_words long, spans array<array<long>>, items array<string>" + (", text string" if ahead is not None and len(columns) > 1 else ""),
        )
    return found.withColumnRenamed("key", key)


def n_hit() -> Column:
    """Words covered by the sorted spans."""
    step = lambda a, s: F.struct(F.greatest(a["end"], s[1]).alias("end"), (a["n"] + F.greatest(F.lit(0), s[1] - F.greatest(a["end"], s[0]))).alias("n"))
    return F.aggregate("spans", F.expr("named_struct('end', 0L, 'n', 0L)"), step)["n"]


def verdicts(found: DataFrame, one_in: int = 20) -> DataFrame:
    """``search`` with n_hit and contaminated: whether at least one word, and one in so many, lies in windows."""
    return found.withColumn("n_hit", n_hit()).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns. Rows are told apart by position in a struct, so
    that neither repeated ids nor other columns matter."""
    row = docs.select(F.struct("*").alias("row"))
    judged = verdicts(search(row, benchmark, key="row", nameless=True))
    return judged.filter("NOT contaminated").select("row.*")
