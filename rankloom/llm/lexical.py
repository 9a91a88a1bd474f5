"""Ranked lexical search by dual-tree search: the highest-scoring documents of each item.

Terms are runs of letters, digits and bytes above 127, A-Z lower-cased. A score is a sum over an item's terms of a weight,
which falls with the number of documents that hold the term, times an impact, which rises with its count in the document
and falls with the document's length; see ``weights`` and ``impacts``. All of it is whole numbers.

1. One pass over the documents writes for each its number of terms and its counts of those terms that items have. The
   number of documents, their terms, and the documents of each item term are sums over that table.
2. The items make a tree: sorted by their heaviest terms, ``FAN`` neighbours to a node. Each node holds for each term the
   largest value (weight times repeats) of its items.
3. A task reads documents, in batches bounded by cells of a table of impacts, and makes a tree of each batch in the same
   way: sorted by heaviest terms, nodes of ``LEAVES`` documents and of ``LEAVES`` of those, each holding the largest
   impact of each term.
4. Item nodes meet document nodes from the roots down. The product of the maxima bounds every score below a pair of
   nodes; where it is less than the weakest kth score of the node's items, whole batches are left out. What is left at
   the leaves is scored exactly. The kth scores carry over from batch to batch, so they only rise.
5. Before that, the documents whose hash falls in one of ``SEED`` classes are searched alone. Their kth scores are less
   than or equal to the true ones, so they prune in all tasks from the start, and few rows leave a task. Nothing else
   follows from them: all documents are searched.

Items come in blocks of ``BLOCK`` bytes of text, each with its own pass; so what goes to the tasks (terms, weights, the
tree) is bounded. Equal scores go to the smaller doc_id.

A null text has no terms: such documents do not count, and such items find nothing. Documents with equal ids are ranked
each, those without an id come last among equal scores. Rows that repeat an item are one; other texts with its item_id
are items of their own with ranks of their own. Empty tables give no rows. Columns other than ids and texts are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.text import slices, words_of
from rankloom.session import stable

MOST = 20
FAN, LEAVES = 4, 32  # items to a node, documents to a node
CELLS = 1 << 22  # documents times terms of a batch
BLOCK = 2 << 20  # bytes of item text
SEED = 64
LAST = (1 << 63) - 1  # stands for no doc_id


class Level(NamedTuple):
    """The nodes of one level of the item tree: node k has the terms and values from start[k] to start[k + 1] and holds
    the nodes of the level below from child[k] to child[k + 1]."""

    start: np.ndarray
    terms: np.ndarray
    values: np.ndarray
    child: np.ndarray


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding], np.int64)


def impacts(count: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    m = 75 + 25 * length * documents // total
    return 1_000_000_000 * count // (1000 * count + 12 * m)


def _counted(vocabulary: dict[bytes, int]):
    """Key, number of terms, and the terms of the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        for batch, texts in slices(batches, 1 << 20):
            n, found, of = [], [], []
            for row, text in enumerate(texts):
                terms = words_of(text)
                n.append(len(terms))
                known = [t for t in map(vocabulary.get, terms) if t is not None]
                found.append(np.array(known, np.int64))
                of.append(np.full(len(known), row, np.int64))
            key, count = np.unique(np.concatenate(of) * size + np.concatenate(found), return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(len(texts) + 1) * size), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (key % size, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["key", "n", "terms", "counts"])

    return run


def _order(row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """The rows sorted by their two terms of largest value; rows without terms come first."""
    by = np.lexsort((term, -value, row))
    start = np.searchsorted(row[by], np.arange(rows))
    end = np.searchsorted(row[by], np.arange(rows), "right")
    sorted_terms = np.append(term[by], -1)
    first, second = (np.where(start + k < end, sorted_terms[np.minimum(start + k, len(by))], -1) for k in (0, 1))
    return np.lexsort((second, first))


def item_tree(row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, fan: int = FAN) -> tuple[np.ndarray, list[Level]]:
    """The items in the order of the tree, and its levels from the items to the root."""
    order = _order(row, term, value, rows)
    place = np.empty(rows, np.int64)
    place[order] = np.arange(rows)
    node, levels, n = place[row], [], rows
    while True:
        by = np.lexsort((term, node))
        node, term, value = node[by], term[by], value[by]
        new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (term[1:] != term[:-1])])) if len(node) else np.zeros(0, np.int64)
        value = np.maximum.reduceat(value, new) if len(new) else value
        node, term = node[new], term[new]
        child = np.minimum(np.arange(n + 1) * fan, len(levels[-1].child) - 1) if levels else np.arange(n + 1)
        levels.append(Level(np.searchsorted(node, np.arange(n + 1)), term, value, child))
        if n == 1:
            return order, levels
        node, n = node // fan, -(-n // fan)


class _Best:
    """The best scores of each item, with the least score that still counts."""

    def __init__(self, floor: np.ndarray, most: int):
        self.floor, self.most = np.maximum(floor, 1), most
        self.score = [np.zeros(0, np.int64)] * len(floor)
        self.doc = [np.zeros(0, np.int64)] * len(floor)

    def add(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        here = score >= self.floor[item]
        if not here.any():
            return
        score, doc = np.concatenate([self.score[item], score[here]]), np.concatenate([self.doc[item], doc[here]])
        by = np.lexsort((doc, -score))[: self.most]
        self.score[item], self.doc[item] = score[by], doc[by]
        if len(by) == self.most:
            self.floor[item] = score[by[-1]]


def _products(maxima: np.ndarray, level: Level, node: int, at: np.ndarray, exact: bool) -> np.ndarray:
    span = slice(level.start[node], level.start[node + 1])
    part = maxima[np.ix_(at, level.terms[span])]
    return part @ level.values[span].astype(maxima.dtype) if exact else (part.astype(np.int64) * level.values[span]).sum(axis=1)


def search_batch(table: np.ndarray, docs: np.ndarray, levels: list[Level], best: _Best, exact: bool) -> int:
    """Searches documents with their impacts by term, in the order of their tree; how many documents were scored for an
    item. exact: products of doubles are exact."""
    heights = [table]
    while len(heights) < 3 and len(heights[-1]) > 1:
        heights.append(np.maximum.reduceat(heights[-1], np.arange(0, len(heights[-1]), LEAVES)))
    scored, waiting = 0, [(len(levels) - 1, 0, len(heights) - 1, np.arange(len(heights[-1])))]
    weakest = [best.floor]
    for level in levels[1:]:
        weakest.append(np.minimum.reduceat(weakest[-1], level.child[:-1]))
    while waiting:
        level, node, height, at = waiting.pop()
        bound = _products(heights[height], levels[level], node, at, exact)
        # the kth scores may have risen since the batch began, which an item's own floor knows
        at, bound = (x[bound >= (best.floor[node] if level == 0 else weakest[level][node])] for x in (at, bound))
        if not len(at):
            continue
        if level == 0 and height == 0:
            scored += len(at)
            best.add(node, bound.astype(np.int64), docs[at])
            continue
        if height:
            below = len(heights[height - 1])
            at = (at[:, None] * LEAVES + np.arange(LEAVES)).ravel()
            at = at[at < below]
        if level:
            waiting += [(level - 1, child, max(0, height - 1), at) for child in range(levels[level].child[node], levels[level].child[node + 1])]
        else:
            waiting.append((0, node, height - 1, at))
    return scored


def _batches(batch: pa.RecordBatch, documents: int, total: int, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The terms at hand, the impacts of the documents for them, and the documents' ids, for parts of the batch."""
    size = len(batch)
    while size:
        for k in range(0, len(batch), size):
            part = batch.slice(k, size)
            terms = part.column(2).flatten().to_numpy()
            if len(np.unique(terms)) * len(part) > CELLS and size > LEAVES:
                break
        else:
            break
        size //= 2
    for k in range(0, len(batch), size or 1):
        part = batch.slice(k, size)
        at = part.column(2).value_lengths().to_numpy()
        row, terms, counts = np.repeat(np.arange(len(part)), at), part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
        here, local = np.unique(terms, return_inverse=True)
        gain = impacts(counts, part.column(1).to_numpy()[row], documents, max(1, total))
        order = _order(row, terms, gain * value[terms], len(part))
        order = order[at[order] > 0]
        place = np.full(len(part), -1)
        place[order] = np.arange(len(order))
        table = np.zeros((len(order), len(here)))
        table[place[row], local] = gain
        yield here, table, part.column(0).to_numpy()[order]


def _within(levels: list[Level], here: np.ndarray) -> list[Level]:
    """The tree with only the terms at hand, renumbered."""
    out = []
    for level in levels:
        at = np.searchsorted(here, level.terms)
        held = at < len(here)
        held[held] = here[at[held]] == level.terms[held]
        kept = np.concatenate([[0], np.cumsum(held)])
        out.append(Level(kept[level.start], at[held], level.values[held], level.child))
    return out


def _search(levels: list[Level], value: np.ndarray, documents: int, total: int, floor: np.ndarray, most: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(floor, most)
        for batch in batches:
            for here, table, docs in _batches(batch, documents, total, value) if len(batch) else ():
                if len(table):
                    search_batch(table, docs, _within(levels, here), best, exact)
        item = np.repeat(np.arange(len(floor)), [len(x) for x in best.score])
        columns = [pa.array(item.astype(np.int32))] + [pa.array(np.concatenate([*x, np.zeros(0, np.int64)])) for x in (best.doc, best.score)]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "doc", "score"])

    return run


def _blocks(items: DataFrame, block: int) -> Iterator[list]:
    """The items, each text once under its id, in lists of about ``block`` bytes."""
    held, size = [], 0
    for r in items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct().orderBy("item_id", "text").toLocalIterator(prefetchPartitions=True):
        held.append(r)
        size += len(r.text)
        if size >= block:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(docs: DataFrame, items: list, most: int) -> DataFrame | None:
    """place (of an item in ``items``), doc, score: the best documents of each item."""
    vocabulary: dict[bytes, int] = {}
    cells: dict[tuple[int, int], int] = {}
    for k, item in enumerate(items):
        for word in words_of(item.text.encode()):
            pair = (k, vocabulary.setdefault(word, len(vocabulary)))
            cells[pair] = cells.get(pair, 0) + 1
    if not cells:
        return None
    kind = "key long, n long, terms array<int>, counts array<int>"
    text = F.coalesce("text", F.lit("")).alias("text")
    table = stable(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), text).mapInArrow(_counted(vocabulary), kind).filter("n > 0"))
    whole = table.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    held = table.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each term of the block
    holding = np.zeros(len(vocabulary), np.int64)
    holding[[r.term for r in held]] = [r["count"] for r in held]
    weight = weights(whole.documents, holding)
    row, term, repeats = (np.array(x, np.int64) for x in zip(*[(k, t, c) for (k, t), c in cells.items()], strict=True))
    order, levels = item_tree(row, term, weight[term] * repeats, len(items))
    exact = 1_000_000 * max((int(np.add.reduceat(np.append(x.values, 0), x.start[:-1]).max()) for x in levels), default=0) < 1 << 53
    searched = "place int, doc long, score long"

    def best(rows: DataFrame, floor: np.ndarray) -> DataFrame:
        found = rows.select("key", "n", "terms", "counts").mapInArrow(_search(levels, weight, whole.documents, whole.total, floor, most, exact), searched)
        top = Window.partitionBy("place").orderBy(F.desc("score"), "doc")
        return found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= most)

    seed = best(table.filter(F.pmod(F.xxhash64("key", "n", "counts"), F.lit(SEED)) == 0), np.zeros(len(items), np.int64))
    floor = np.zeros(len(items), np.int64)
    for r in seed.filter(F.col("rank") == most).select("place", "score").collect():  # a row for each item of the block
        floor[r.place] = r.score
    names = table.sparkSession.createDataFrame([(p, int(k)) for p, k in enumerate(order)], "place int, item int")
    return best(table, floor).join(names, "place").select("item", "rank", F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "score")


def ranked(docs: DataFrame, items: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``most`` documents of highest score above zero for each item."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for held in _blocks(items, block):
        found = _found(docs, held, most)
        if found is not None:
            ids = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(held)], f"item int, item_id {kind.simpleString()}")
            out = out.unionByName(found.join(ids, "item").select("item_id", "rank", "doc_id", "score"))
    return out
