"""Toxicity scores by a support vector machine on a gap-weighted subsequence string kernel with Nyström landmarks.

The kernel of two words sums, over all sequences of three letters, the product of how closely each word holds it: a
sequence spread over n letters counts ``decay`` to the n. An insult with letters put in or left out so stays near itself.
Landmarks are words and beginnings of words that tell the sentences of toxic training documents best from those of others.
A sentence is described by its nearest word to each landmark: the kernel over the landmark's own, from ``floor`` to 1. With
the inverse root of the landmarks' kernel matrix that is the Nyström map, on which a linear machine with hinge loss is
trained, sentence by sentence, with the label of the document. A document scores as its worst sentence, on a logistic scale fitted to training
documents.

Training reads ``sample`` labelled documents of each class at most, the first by a hash of doc_id of those that are there
and have a word, and of a text above 20,000 characters so many bytes of sentences from anywhere in it, the first by a hash
(documented bounds); further texts of an id are read after the first one of each. Sentences that copies share count once. Scoring reads all of every text. The kernel is computed
once for a word while a worker remembers it, and only with landmarks of which it has the letters: sequences that it can
hold must make up half of the landmark's own kernel.

Words are runs of letters with A-Z lower-cased, digits and signs that are written for letters read as these; three or more
letters standing alone in a row are one word. A null or empty text is a sentence without words. Labels that are null, or
of documents that are not there, teach nothing; a document with several labels is toxic if one says so. Without any
labelled row of both classes all scores are 0. Repeated rows and rows without doc_id are scored each. Columns other than
doc_id and text (and doc_id and toxic of the labels) are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.text import key_and_text, slices
from rankloom.session import stable

SAMPLE, LONG = 1500, 20_000
LANDMARKS = 64
DECAY, FLOOR, SHARE = 0.55, 0.4, 0.5
WIDE = 24  # longer words are read in windows of so many letters, half overlapping
REMEMBERED = 300_000

_READ = {**{c: c + 32 for c in range(65, 91)}, **{ord(a): ord(b) for a, b in zip("0134578@$", "oieastbas", strict=True)}}
# letters as they are read, sentence ends as line ends, all other ASCII as blanks
_LINES = bytes(_READ.get(c, c if c >= 128 or chr(c).isalnum() else 10 if chr(c) in ".!?\n" else 32) for c in range(256))
_INSIDE = b"*_~^'-"  # signs put between letters
_ALONE = re.compile(rb"(?<![^ ])[a-z](?: [a-z]){2,}(?![^ ])")


def sentences(text: bytes) -> list[list[bytes]]:
    """The words of each sentence that has any."""
    text = text.translate(_LINES, _INSIDE)
    if _ALONE.search(text):
        text = b"\n".join(_ALONE.sub(lambda m: m[0].replace(b" ", b""), b" ".join(line.split())) for line in text.split(b"\n"))
    return [words for line in text.split(b"\n") if (words := line.split())]


def _windows(word: bytes) -> list[bytes]:
    return [word] if len(word) <= WIDE else [word[k : k + WIDE] for k in range(0, len(word) - WIDE // 2, WIDE // 2)]


def _codes(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def kernel(s: np.ndarray, t: np.ndarray, decay: float) -> np.ndarray:
    """The subsequence kernel of order three of each row of ``s`` with that of ``t``; rows end in zero bytes."""
    n, wide = len(s), t.shape[1]
    one, two = np.zeros((wide + 1, n), np.float32), np.zeros((wide + 1, n), np.float32)
    total, square = np.zeros(n, np.float32), np.float32(decay * decay)
    for a in range(s.shape[1]):
        x = s[:, a]
        run1, run2 = np.zeros(n, np.float32), np.zeros(n, np.float32)
        add1, add2 = np.empty_like(one), np.empty_like(two)
        add1[0] = add2[0] = 0
        for b in range(wide):
            hit = ((x == t[:, b]) & (x > 0)) * square
            total += hit * two[b]
            run2 = run2 * np.float32(decay) + hit * one[b]
            run1 = run1 * np.float32(decay) + hit
            add1[b + 1], add2[b + 1] = run1, run2
        one = one * np.float32(decay) + add1
        two = two * np.float32(decay) + add2
    return total


class Landmarks:
    """Kernels of words with the landmarks over those of the landmarks, as rows; None for words below the floor everywhere."""

    def __init__(self, words: list[bytes], decay: float = DECAY, floor: float = FLOOR):
        self.words, self.decay, self.floor = [w[:WIDE] for w in words], decay, floor
        self.codes = _codes(self.words, max(map(len, self.words)))
        self.own = kernel(self.codes, self.codes, decay)
        self.known: dict[bytes, np.ndarray | None] = {}
        self.letters, self.reach = [], []
        for n, w in enumerate(self.words):
            letters = sorted(set(w))[:12]
            masks = np.arange(1 << len(letters))
            kept = [bytes(c if c not in letters or m >> letters.index(c) & 1 else 1 + k % 2 for k, c in enumerate(w)) for m in masks.tolist()]
            part = _codes([bytes(b if b > 2 else 0 for b in x) for x in kept], len(w))
            # zeros inside a row match nothing and keep the distances: the kernel on the letters kept
            self.letters.append(letters)
            self.reach.append(kernel(part, part, decay) / self.own[n])

    def features(self, words: list[bytes]) -> dict[bytes, np.ndarray | None]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if new := [w for w in set(words) if w not in known]:
            known.update(zip(new, self._compute(new), strict=True))
        return known

    def _compute(self, words: list[bytes]) -> list[np.ndarray | None]:
        cut = [(i, part) for i, w in enumerate(words) if len(w) > 2 for part in _windows(w)]
        out: list[np.ndarray | None] = [None] * len(words)
        if not cut:
            return out
        codes = _codes([p for _, p in cut], max(len(p) for _, p in cut))
        has = np.zeros((256, len(cut)), bool)
        has[codes.T, np.arange(len(cut))] = True
        pairs = []
        for letters, reach in zip(self.letters, self.reach, strict=True):
            index = np.zeros(len(cut), np.int64)
            for k, c in enumerate(letters):
                index += has[c].astype(np.int64) << k
            pairs.append(np.flatnonzero(reach[index] >= SHARE))
        of = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        row = np.concatenate(pairs)
        if not len(row):
            return out
        value = np.minimum(1, kernel(codes[row], self.codes[of], self.decay) / self.own[of])
        for i, n, v in zip(row.tolist(), of.tolist(), value.tolist(), strict=True):
            if v >= self.floor:
                word = cut[i][0]
                if out[word] is None:
                    out[word] = np.zeros(len(self.words), np.float32)
                out[word][n] = max(out[word][n], v)
        return out


class Model(NamedTuple):
    words: list[bytes]
    weights: np.ndarray  # of the kernels with the landmarks: the machine's weights times the inverse root
    bias: float
    slope: float
    shift: float


def margin(text: list[list[bytes]], landmarks: Landmarks, model: Model) -> float:
    """The largest margin of a sentence."""
    known = landmarks.features([w for words in text for w in words])
    worst = model.bias
    for words in text:
        held = [v for v in map(known.__getitem__, words) if v is not None]
        if held:
            worst = max(worst, float(np.max(held, axis=0) @ model.weights) + model.bias)
    return worst


def choose_landmarks(toxic: list[list[bytes]], clean: list[list[bytes]], most: int = LANDMARKS) -> list[bytes]:
    """Words, and beginnings of four to six letters, that mark toxic sentences, by the z value of their share among
    sentences; none that holds another one or is held by it."""
    heads = lambda words: {w[:k] for w in words for k in (4, 5, 6, len(w)) if len(w) >= k > 2}
    bad, good = (Counter(w for words in x for w in heads(words)) for x in (toxic, clean))
    n, m = max(1, len(toxic)), max(1, len(clean))
    score = {}
    for w, c in bad.items():
        p, q = (c + 0.5) / (n + 1), (good[w] + 0.5) / (m + 1)
        both = (c + good[w] + 1) / (n + m + 2)
        if c >= 5 and p > 8 * q:
            score[w] = (p - q) / np.sqrt(both * (1 - both) * (1 / n + 1 / m))
    chosen: list[bytes] = []
    least = 0.3 * max(score.values(), default=0)
    for w in sorted(score, key=lambda w: (-score[w], -len(w), w)):
        if score[w] >= least and len(chosen) < most and not any(w in x or x in w for x in chosen):
            chosen.append(w)
    return chosen


def train(toxic: list[bytes], clean: list[bytes], share: float = 0.5) -> Model | None:
    """A model from the texts of both classes; ``share`` of all documents are toxic."""
    distinct = [{tuple(words): None for text in texts for words in sentences(text)} for texts in (toxic, clean)]
    bad, good = ([list(w) for w in d] for d in distinct)
    marks = choose_landmarks(bad, good)
    if not marks or not good:
        return None
    landmarks = Landmarks(marks)
    size = len(marks)
    pair = np.repeat(np.arange(size), size), np.tile(np.arange(size), size)
    gram = kernel(landmarks.codes[pair[0]], landmarks.codes[pair[1]], DECAY) / np.sqrt(landmarks.own[pair[0]] * landmarks.own[pair[1]])
    value, vector = np.linalg.eigh(gram.reshape(size, size).astype(np.float64))
    root = (vector / np.sqrt(np.maximum(value, 1e-2))) @ vector.T

    def describe(all_words: list[list[bytes]]) -> np.ndarray:
        out = []
        for k in range(0, len(all_words), 2000):
            known = landmarks.features([w for words in all_words[k : k + 2000] for w in words])
            for words in all_words[k : k + 2000]:
                if held := [v for v in map(known.__getitem__, words) if v is not None]:
                    out.append(np.max(held, axis=0))
        return np.array(out, np.float64).reshape(-1, size)

    # sentences near no landmark are alike in both classes: together they are one example that is not toxic
    near = [describe(bad), describe(good)]
    x = np.vstack([*near, np.zeros((1, size))]) @ root
    y = np.concatenate([np.ones(len(near[0])), -np.ones(len(near[1]) + 1)])
    weight = np.where(y > 0, 0.5 / max(1, len(near[0])), 0.4 / max(1, len(near[1])))
    weight[-1] = 0.1
    w, bias = np.zeros(size), 0.0
    for step in range(600):  # sub-gradient steps on the hinge loss with a small ridge
        rate, inside = 4 / np.sqrt(1 + step), (y * (x @ w + bias) < 1) * weight * y
        w += rate * (inside @ x - 1e-4 * w)
        bias += rate * inside.sum()
    model = Model(marks, root @ w, bias, 1.0, 0.0)
    margins = np.array([margin(sentences(t), landmarks, model) for t in [*toxic, *clean]])
    target = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    weight = np.where(target > 0, share / max(1, len(toxic)), (1 - share) / max(1, len(clean)))
    slope, shift = 1.0, 0.0
    for _ in range(3000):  # logistic scale
        p = 1 / (1 + np.exp(-(slope * margins + shift)))
        slope -= float(((p - target) * margins) @ weight)
        shift -= float((p - target) @ weight)
    return model._replace(slope=slope, shift=shift)


def excerpt(text: bytes, most: int = LONG) -> bytes:
    """The text, or of one above ``most`` characters about ``most`` bytes of its sentences, by a hash of each. Very long
    sentences and words are taken in pieces."""
    if len(text) <= most or len(text.decode()) <= most:
        return text
    pieces = set()
    for words in sentences(text):
        words = [w[k : k + 500] for w in words for k in range(0, len(w), 500)]
        pieces.update(b" ".join(words[k : k + 100]) for k in range(0, len(words), 100))
    held, size = [], 0
    for piece in sorted(pieces, key=lambda x: (xxhash.xxh64_intdigest(x), x)):
        if held and size + len(piece) > most:
            break
        held.append(piece)
        size += len(piece) + 1
    return b"\n".join(held)


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        cut = pa.array([excerpt(t).decode(errors="ignore") for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cut], names=["doc_id", "toxic", "text"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model | None:
    """A model of labelled documents whose doc_id is ``usable``: ``sample`` of each class at most."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    readable = docs.select("doc_id", "text").filter(F.col("text").rlike(r"[0-9A-Za-z@$]|[^\x00-\x7F]"))
    marks = stable(marks.filter("toxic IN (0, 1)").join(readable.select("doc_id").distinct(), "doc_id", "left_semi"))
    counts = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    chosen = [marks.filter(F.col("toxic") == k).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (1, 0)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows at most
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = readable.join(picked, "doc_id").select("doc_id", F.col("toxic").cast("int"), "text").mapInArrow(_excerpts, f"doc_id {kind}, toxic int, text string").distinct()
    # the first text of every picked id, then the second ones; the limit of 1,000 for an id is applied before the shuffle
    turn = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    rows = rows.withColumn("turn", F.row_number().over(turn)).filter("turn <= 1000")
    texts: tuple[list[bytes], list[bytes]] = ([], [])
    for r in rows.orderBy("turn", F.xxhash64("doc_id"), "text").limit(2 * sample).collect():
        texts[r.toxic].append(r.text.encode())
    return train(texts[1], texts[0], counts.get(1, 0) / max(1, sum(counts.values())))


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = _landmarks(tuple(model.words)) if model else None
        for batch, texts in slices(batches, 1 << 20):
            scores = np.zeros(len(texts))
            if model:
                cut = [sentences(t) for t in texts]
                landmarks.features([w for text in cut for words in text for w in words])  # all at once
                scores = np.array([margin(text, landmarks, model) for text in cut])
                scores = 1 / (1 + np.exp(-(model.slope * scores + model.shift)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["key", "score"])

    return run


_HELD: dict[tuple, Landmarks] = {}


def _landmarks(words: tuple[bytes, ...]) -> Landmarks:
    if words not in _HELD:
        _HELD.clear()
        _HELD[words] = Landmarks(list(words))
    return _HELD[words]


def keep_clean(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The documents that score less than ``least``, with all their columns."""
    row = docs.select(F.struct("*").alias("row"))
    return scores(row, model, key="row").filter(F.col("score") < least).select("row.*")


def scores(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """key, score: one row per document row."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(*key_and_text(docs, key)).mapInArrow(_score(model), f"key {kind}, score double").withColumnRenamed("key", key)
