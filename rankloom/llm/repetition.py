"""Quality rules by the repetition that a suffix array of each text shows.

Words are runs of other bytes than ASCII white space, compared as they are. For the texts of a batch one suffix array
over words is made by rank doubling; words of different texts count as different, so the array is that of each text, side
by side. Positions whose rank is unique are left out of later rounds. The ranks of all rounds then give the longest
common prefix (LCP) of neighbouring suffixes, by binary descent.

* An LCP interval is a maximal run of neighbouring suffixes that share a prefix; it is a repeated string that cannot go on
  to the right. It is maximal if the words before its places differ. Intervals are found by descent in a table of minima.
* A suffix lies in its deepest interval with the longer LCP to its two neighbours. The union of these prefixes is the
  union of all maximal repeats: what can be extended to the left lies inside of a longer one.
* A document is dropped if repeats of at least ``REPEAT`` words cover more than ``COVERED`` of its words, or if its longest
  repeat has more than ``LONGEST`` words. Base rules come first: fewer than ``LEAST`` words, or more than half of the
  words in windows of three words that are found twice or more (places with an LCP of three or more).

The verdict of a text needs that text alone, so nothing is shuffled. A task holds the texts of about a MB, or one longer
text, at about 150 bytes for each of its words.

A null or empty text has no words and fails the base rules. Rows that repeat, or have no id, are answered each. An empty
table gives no rows. Only the id and the text are looked at, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.text import key_and_text, slices

LEAST, WINDOW = 50, 3  # base rules: words of a document, words of a window
REPEAT, COVERED, LONGEST = 8, 0.3, 100  # words of a repeat that counts; the two limits
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


class Suffixes(NamedTuple):
    order: np.ndarray  # starts of the suffixes, sorted
    lcp: np.ndarray  # words that each shares with the suffix before it


def suffixes(words: np.ndarray) -> Suffixes:
    """Suffix array and LCP of numbered words, of which some last one is unlike all others in each text."""
    n = len(words)
    order = np.argsort(words)
    named = words[order]
    new = np.concatenate([[True], named[1:] != named[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, width = [rank], 1
    places = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(places):
        # a place with a rank that is not unique holds no last word within the width, so the next width starts in its text
        at = order[places]
        pair = rank[at].astype(np.int64) * n + rank[at + width]
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[places] = at
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, places, 0))
        ranks.append(rank)
        width *= 2
        places = places[~(new & np.append(new[1:], True))]
    lcp = np.zeros(n, np.int64)
    pairs = 1 + np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]])
    a, b, shared = order[pairs - 1], order[pairs], np.zeros(len(pairs), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        shared += (ranks[level][a + shared] == ranks[level][b + shared]).astype(np.int64) << level
    lcp[pairs] = shared
    return Suffixes(order, lcp)


def deepest(s: Suffixes) -> np.ndarray:
    """By place of the text: the words that its suffix shares with another one."""
    reach = np.empty(len(s.order), np.int64)
    reach[s.order] = np.maximum(s.lcp, np.append(s.lcp[1:], 0))
    return reach


def covered(reach: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Which words lie in a repeat of at least ``least`` words; only the first ``most`` of each repeat count."""
    at = np.flatnonzero(reach >= least)
    length = reach[at] if most is None else np.minimum(reach[at], most)
    edge = np.bincount(at, minlength=len(reach) + 1) - np.bincount(at + length, minlength=len(reach) + 1)
    return np.cumsum(edge)[:-1] > 0


def _bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the nearest smaller ones before and after it; the first and the last value are the least."""
    minima, width, n = [values], 1, len(values)
    while 2 * width <= n:
        minima.append(np.minimum(minima[-1][:-width], minima[-1][width:]))
        width *= 2
    before, after = np.arange(n), np.arange(n) + 1
    for level in range(len(minima) - 1, -1, -1):
        width, least = 1 << level, minima[level]
        start = before - width
        before = np.where((start >= 0) & (least[np.maximum(start, 0)] >= values), start, before)
        fits = after + width <= n
        after = np.where(fits & (least[np.where(fits, after, 0)] >= values), after + width, after)
    return before - 1, after


def maximal_repeats(words: np.ndarray, s: Suffixes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and number of places of each maximal repeated string of at least ``least`` words."""
    held = np.flatnonzero(s.lcp >= least)
    if not len(held):
        return held, held, held
    gap = np.concatenate([[0], np.cumsum(np.diff(held) != 1)])
    spot = np.arange(len(held)) + gap + 1  # runs of neighbours, with a zero before, between and after them
    values, index = np.zeros(spot[-1] + 2, np.int64), np.zeros(spot[-1] + 2, np.int64)
    values[spot], index[spot] = s.lcp[held], held
    before, after = (x[spot] for x in _bounds(values))
    _, one = np.unique(before * len(values) + after, return_index=True)  # equal values of one interval
    first, last, length = index[before[one] + 1] - 1, index[after[one] - 1], s.lcp[held][one]
    left = np.where(s.order > 0, words[s.order - 1], -1)
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    kept = changes[last] > changes[first]
    first, last, length = first[kept], last[kept], length[kept]
    if not len(first):
        return first, first, first
    sizes = last - first + 1
    return np.minimum.reduceat(np.append(s.order, 0), np.column_stack([first, last + 1]).ravel())[::2], length, sizes


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers that differ between texts, each text with a last one of its own; their starts."""
    numbers = _Numbers()
    lengths = np.array([len(t) + 1 for t in texts])
    flat = np.fromiter((n for t in texts for n in (*map(numbers.__getitem__, t), -1)), np.int64, int(lengths.sum()))
    of = np.repeat(np.arange(len(texts)), lengths)
    return of * (len(numbers) + 1) + flat + 1, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _line_repeats(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def measures(texts: list[bytes], least: int) -> dict[str, np.ndarray]:
    """The figures of each text, by name."""
    words = [t.split() for t in texts]
    flat, start = numbered(words)
    s = suffixes(flat)
    reach = deepest(s)
    place, length, _ = maximal_repeats(flat, s, least)
    return {
        "n_words": np.array([len(w) for w in words]),
        "word_chars": np.array([len(t.translate(None, SPACE).decode()) for t in texts]),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts]),
        "n_dup_lines": np.array([_line_repeats(t) for t in texts]),
        "n_repeat_words": np.add.reduceat(covered(reach, WINDOW, WINDOW).astype(np.int64), start),
        "n_covered": np.add.reduceat(covered(reach, least).astype(np.int64), start),
        "longest_repeat": np.maximum.reduceat(reach, start),
        "n_repeats": np.bincount(np.searchsorted(start, place, "right") - 1, minlength=len(texts)),
    }


def _scan(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1 << 20):
            found = measures(texts, least)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in found.values())], names=["key", *found])

    return run


def _passages(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1 << 20):
            words = [t.split() for t in texts]
            flat, start = numbered(words)
            place, length, times = maximal_repeats(flat, suffixes(flat), least)
            of = np.searchsorted(start, place, "right") - 1
            first = place - start[of]
            text = [b" ".join(words[d][a : a + n]).decode() for d, a, n in zip(of.tolist(), first.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(of)), *(pa.array(x, pa.int64()) for x in (first, length, times)), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "first_word", "length", "times", "passage"])

    return run


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_repeats")


def verdicts(docs: DataFrame, key: str = "doc_id", least: int = REPEAT, most_covered: float = COVERED, longest: int = LONGEST) -> DataFrame:
    """The key, the figures of each row, base_failed and kept."""
    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(*key_and_text(docs, key)).mapInArrow(_scan(least), f"key {kind}, " + ", ".join(f"{x} long" for x in FIGURES))
    failed = (F.col("n_words") < LEAST) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    clean = (F.col("n_covered") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return found.withColumns({"base_failed": failed, "kept": ~failed & clean}).withColumnRenamed("key", key)


def passages(docs: DataFrame, key: str = "doc_id", least: int = REPEAT) -> DataFrame:
    """The key, first_word, length, times and passage (its words joined by blanks) of each maximal repeat of each row."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, first_word long, length long, times long, passage string"
    return docs.select(*key_and_text(docs, key)).mapInArrow(_passages(least), schema).withColumnRenamed("key", key)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return verdicts(row, "row").filter("kept").select("row.*")
