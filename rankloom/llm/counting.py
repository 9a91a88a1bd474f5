"""Token counts by a finite-state transducer compiled from a tokenizer file.

The tokenizer merges the symbols (bytes, the last one of a word marked as such) of each word by rank. For such merges,
the tokens of a word's prefix end in one last token, and what stands before it is tokenized like the prefix without it.
So after each symbol the last token is the one, among the tokens that end here, that can follow the last token of the
prefix before it: two tokens can follow each other if merging their joined symbols gives back the two. This reads
from left to right with finitely many states: the last tokens at those earlier places where a token may still begin that
the symbols since then lead up to. A transition emits the change of the number of tokens, one place behind the input
because a symbol is marked as its word's last only once the next one is known. States and transitions are compiled when
first met; a worker keeps a bounded number and starts over beyond it.

Texts are cut into chunks, and all chunks of a batch advance together, one symbol a step. Where a chunk begins, the state
is not known, but the start of a word leads to the same state from any: each chunk maps the state it enters with to the
state it is left with and a count, and after its first word start that map is constant. A prefix scan composes the maps
of the chunks (the last constant one before a chunk wins), which gives every chunk its true entering state, then the
symbols before its first word start are read from that state. Chunks inside one long word join the chunk where it began.
Texts above a MB are read in parts that begin at blanks.

Words are cut and normalised exactly as the tokenizer file says: NFC, lower case, and its pattern of contractions,
letters, single numbers and other signs. Special tokens written out in a text count as one token each.

A null or empty text has no tokens. Repeated rows, ties and rows without doc_id are counted each; an empty table gives no
rows. Only doc_id and text are looked at, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.text import slices

LIMIT = 2048
LAST = 256  # added to the last symbol of a word
CHUNK = 512
CELLS = 24 << 20  # transitions that a worker holds room for
PAIRS = 1_000_000


def _visible_bytes() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """The vocabulary as strings of symbols (characters below 512), and which tokens can follow each other."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, code = spec["model"], _visible_bytes()
        end = model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"] or not end:
            raise ValueError("a BPE vocabulary with marked word ends is needed")

        def symbols(token: str) -> str:
            marked = token.endswith(end) and len(token) > len(end)
            out = [code[c] for c in (token[: -len(end)] if marked else token)]
            return "".join(map(chr, out[:-1])) + chr(out[-1] + LAST * marked)

        self.special = [t["content"] for t in spec["added_tokens"]]
        self.rank: dict[tuple[str, str], int] = {}
        for n, pair in enumerate(model["merges"]):
            left, right = map(symbols, pair if isinstance(pair, list) else pair.split(" "))
            self.rank[left, right] = n
        self.tokens = {chr(s) for s in range(2 * LAST)} | {a + b for a, b in self.rank}
        self.heads = {t[:k] for t in self.tokens for k in range(1, len(t))}  # what may still become a token
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, symbols: str) -> list[str]:
        """Merge by rank until nothing merges."""
        parts, rank, none = list(symbols), self.rank, len(self.rank)
        while len(parts) > 1:
            order = [rank.get(p, none) for p in zip(parts, parts[1:], strict=False)]
            if (least := min(order)) == none:
                break
            k = order.index(least)  # the pairs it makes rank behind it, so one at a time gives the same as all at once
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follow(self, left: str, right: str) -> bool:
        """Whether ``right`` can be the token after ``left`` (after nothing, if left is empty)."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return known


class Transducer:
    """Deterministic, compiled on demand. A state has the symbols since the earliest place where a token may still begin,
    and for each place from there to the end the last token before it (none at the start of a word) and how many tokens
    there are more by now; of places where none may begin nothing. State 0 is the start of a word."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.reset()

    def reset(self) -> None:
        self.names: list[tuple] = [("", (("", 0),))]
        self.numbers = {self.names[0]: 0}
        self.columns = np.full(2 * LAST, -1, np.int64)  # dense numbers of the symbols met
        self.table = np.full((4096, 64), -1, np.int32)  # next state * 256 + change + 128

    def column(self, symbols: np.ndarray) -> np.ndarray:
        for s in np.flatnonzero(np.bincount(symbols, minlength=2 * LAST)).tolist():
            if self.columns[s] < 0:
                self.columns[s] = self.columns.max() + 1
        while self.columns.max() >= self.table.shape[1]:
            self.table = np.hstack([self.table, np.full_like(self.table, -1)])
        return self.columns[symbols]

    def step(self, name: tuple, symbol: int) -> tuple[tuple, int]:
        symbols, before = name
        symbols += chr(symbol)
        merges = self.merges
        k = next(k for k, at in enumerate(before) if at and symbols[k:] in merges.tokens and merges.follow(at[0], symbols[k:]))
        change = 1 - before[k][1]
        if symbol >= LAST:
            return self.names[0], change
        here = [(at[0], at[1] + change) if at and symbols[j:] in merges.heads else None for j, at in enumerate(before)]
        here.append((symbols[k:], 0))
        first = next(j for j, at in enumerate(here) if at)
        return (symbols[first:], tuple(here[first:])), change

    def compile(self, states: np.ndarray, columns: np.ndarray, symbols: np.ndarray) -> None:
        for state, column, symbol in set(zip(states.tolist(), columns.tolist(), symbols.tolist(), strict=True)):
            name, change = self.step(self.names[state], symbol)
            number = self.numbers.setdefault(name, len(self.names))
            if number == len(self.names):
                self.names.append(name)
                if number == len(self.table):
                    self.table = np.vstack([self.table, np.full_like(self.table, -1)])
            self.table[state, column] = number * 256 + change + 128

    def read(self, symbols: np.ndarray, columns: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, changes: np.ndarray) -> np.ndarray:
        """All lanes read symbols[start:end] from their states; writes the changes of each place and returns the states
        at the ends."""
        order = np.argsort(start - end, kind="stable")  # longest first, so that those at work are a prefix
        at, left, state = start[order], (end - start)[order], state[order]
        t, active = 0, int(np.count_nonzero(left > 0))
        while active:
            place = at[:active] + t
            column, here = columns[place], state[:active]
            packed = self.table[here, column]
            if (packed < 0).any():
                new = packed < 0
                self.compile(here[new], column[new], symbols[place[new]])
                packed = self.table[here, column]
            changes[place] = (packed & 255) - 128
            state[:active] = packed >> 8
            t += 1
            active = int(np.searchsorted(-left[:active], -t, "left"))
        out = np.empty_like(state)
        out[order] = state
        return out


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, by code point."""
    kinds = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        kinds[c] = {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3)
    kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return kinds


def word_symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of the words of all texts, where words start among them, and where each text starts (and the end)."""
    normal = [(t if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ")).lower() for t in texts]
    text = " ".join(normal)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _classes()[points]
    start = (kind != 0) & ((kind == 2) | np.concatenate([[True], kind[1:] != kind[:-1]]))
    quote = np.flatnonzero(start[:-1] & (points[:-1] == 39))
    if len(quote):
        after = np.concatenate([points, [0, 0]]).astype(np.uint32)
        one, two = after[quote + 1], after[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        rest = np.concatenate([quote[short] + 2, quote[long] + 3])
        rest = rest[rest < len(points)]
        start[rest[kind[rest] == 1]] = True
    wide = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
    kept = np.repeat(kind != 0, wide)
    first = np.zeros(len(kept), bool)
    places = np.concatenate([[0], np.cumsum(wide)])
    first[places[:-1][start]] = True
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    before = np.concatenate([[0], np.cumsum(kept)])
    ends = np.cumsum([len(t) + 1 for t in normal])  # in characters, with the blank after each
    bounds = before[places[np.minimum(np.concatenate([[0], ends]), len(points))]]
    symbols, first = data[kept].astype(np.int16), first[kept]
    symbols[:-1][first[1:]] += LAST
    if len(symbols):
        symbols[-1] += LAST
    return symbols, np.flatnonzero(first), bounds


class Counter:
    def __init__(self, path: str):
        self.machine = Transducer(Merges(path))
        self.special = re.compile("|".join(map(re.escape, self.machine.merges.special))) if self.machine.merges.special else None

    def count(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        if self.special:
            for i, t in enumerate(texts):
                if self.special.search(t):
                    texts[i], extra[i] = self.special.subn(" ", t)
        symbols, starts, bounds = word_symbols(texts)
        if not len(symbols):
            return extra
        machine = self.machine
        if len(machine.names) * machine.table.shape[1] > CELLS:
            machine.reset()
        columns = machine.column(symbols)
        changes = np.zeros(len(symbols), np.int32)
        edge = np.arange(0, len(symbols), CHUNK)
        close = np.minimum(edge + CHUNK, len(symbols))
        starts = np.append(starts, len(symbols))
        own = starts[np.searchsorted(starts, edge)]  # the first word start from the chunk's edge on
        constant = own < close
        left = machine.read(symbols, columns, own[constant], close[constant], np.zeros(int(constant.sum()), np.int64), changes)
        # the scan: what enters a chunk comes from the last constant map before it, and is read up to the next word start
        entering = np.maximum.accumulate(np.where(constant, np.cumsum(constant) - 1, -1))
        leads = np.flatnonzero(constant)
        until = starts[np.searchsorted(starts, close[leads])]
        machine.read(symbols, columns, close[leads], until, left[entering[leads]], changes)
        total = np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]] + extra


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def cut_at_blanks(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters that begin with a blank (where none is near, longer ones); as no word goes on
    over a blank and no sign after it joins it, their counts add up."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        while end >= 0 and end + 1 < len(text) and unicodedata.combining(text[end + 1]):
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _counts(tokenizer: str, size: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch, texts in slices(batches, 2 << 20):
            short = [t.decode() if len(t) <= size else "" for t in texts]
            tokens = count(short)
            for i, t in enumerate(texts):
                if len(t) > size:
                    tokens[i] = sum(int(count([part])[0]) for part in cut_at_blanks(t.decode(), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens)], names=["key", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit: one row per document row."""
    kind = docs.schema[key].dataType.simpleString()
    counted = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counts(tokenizer), f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
