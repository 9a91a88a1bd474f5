"""Language of each document by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read the bytes of a segment, one forwards and one backwards; from both states a softmax labels
every position, and the probabilities of all positions of a document are averaged. The network is written in numpy and
trained by backpropagation through time on segments of training documents.

A text is read whole, in segments of ``SEGMENT`` bytes that start from empty states, so memory does not grow with its
length and all segments of a batch advance together.

Training reads ``sample`` texts of each language at most, those of the first ids by a hash and of each id one before the
second ones, and ``PER_DOC`` segments spread over the whole of each (documented bounds); rows without doc_id or with an
empty text are not among them. Languages come from the non-null values of lang there.

A text that is null or has no letter, or any text if there is nothing to learn from, is ``und`` with score 0. Repeated rows
and rows without doc_id are answered each; an empty table gives no rows. Columns other than doc_id, text and lang are not
looked at, and lang only for training.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.text import slices

SAMPLE, PER_DOC = 400, 12
SEGMENT, STATE = 64, 8
UNKNOWN = "und"


class Network(NamedTuple):
    names: list[str]
    inputs: list[np.ndarray]  # by direction: bytes to the three gates
    states: list[np.ndarray]  # by direction: state to the three gates
    outputs: np.ndarray  # both states to the languages
    bias: np.ndarray


def _bend(x: np.ndarray) -> np.ndarray:
    """From -1 to 1, like tanh; gates use its upper half. Its slope at the result y is (1 - abs(y)) squared."""
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    return np.square(1 - np.abs(y))


def _read(data: np.ndarray, inputs: np.ndarray, states: np.ndarray, backwards: bool, keep: list | None) -> np.ndarray:
    """The states (steps x state x segments) of one direction after each byte; data: a column for each segment. What
    training needs of the steps goes to ``keep``."""
    steps, n = data.shape
    k = states.shape[0]
    h, out = np.zeros((k, n), np.float32), np.empty((steps, k, n), np.float32)
    turned = np.ascontiguousarray(states.T)
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        x, u = np.ascontiguousarray(np.take(inputs, data[t], axis=0).T), turned @ h
        gates = _bend(x[: 2 * k] + u[: 2 * k])
        update, reset = 0.5 * gates[:k] + np.float32(0.5), 0.5 * gates[k:] + np.float32(0.5)
        new = _bend(x[2 * k :] + reset * u[2 * k :])
        if keep is not None:
            keep.append((t, h, update, reset, new, u[2 * k :], gates))
        h = new + update * (h - new)
        out[t] = h
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the languages; x: steps x languages x segments."""
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def label(data: np.ndarray, net: Network) -> np.ndarray:
    """Probabilities of the languages at every position: steps x languages x segments."""
    k = net.states[0].shape[0]
    w = np.ascontiguousarray(net.outputs.T)
    both = [_read(data, net.inputs[d], net.states[d], bool(d), None) for d in (0, 1)]
    return _softmax(w[:, :k] @ both[0] + w[:, k:] @ both[1] + net.bias[:, None])


def _gradients(data: np.ndarray, mask: np.ndarray, target: np.ndarray, net: Network) -> list[np.ndarray]:
    """Of the mean cross-entropy over positions, by backpropagation through time; in the order of ``_parts``."""
    k, w = net.states[0].shape[0], net.outputs.T
    kept: list[list] = [[], []]
    both = [_read(data, net.inputs[d], net.states[d], bool(d), kept[d]) for d in (0, 1)]
    error = _softmax(w[:, :k] @ both[0] + w[:, k:] @ both[1] + net.bias[:, None])
    error[:, target, np.arange(len(target))] -= 1
    error *= (mask / mask.sum())[:, None, :]
    out = [np.einsum("tkn,tcn->kc", both[d], error, optimize=True) for d in (0, 1)]
    d_inputs, d_states = [], []
    for d in (0, 1):
        from_output = net.outputs[d * k : (d + 1) * k] @ error
        g_in, g_state = np.zeros_like(net.inputs[d]), np.zeros_like(net.states[d])
        carry = np.zeros((k, data.shape[1]), np.float32)
        for t, h, update, reset, new, candidate, gates in reversed(kept[d]):
            g = carry + from_output[t]
            g_new = g * (1 - update) * _slope(new)
            g_gates = np.concatenate([g * (h - new), g_new * candidate]) * 0.5 * _slope(gates)
            g_x, g_u = np.concatenate([g_gates, g_new]), np.concatenate([g_gates, g_new * reset])
            np.add.at(g_in, data[t], g_x.T)
            g_state += h @ g_u.T
            carry = g * update + net.states[d] @ g_u
        d_inputs.append(g_in)
        d_states.append(g_state)
    return [*d_inputs, *d_states, np.concatenate(out), error.sum(axis=(0, 2))]


def _parts(net: Network) -> list[np.ndarray]:
    return [*net.inputs, *net.states, net.outputs, net.bias]


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All segments of the texts as columns of bytes, how many bytes each has, and the text of each."""
    counts = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
    data = np.frombuffer(b"".join(t.ljust(int(c) * SEGMENT, b" ") for t, c in zip(texts, counts, strict=True)), np.uint8).reshape(-1, SEGMENT)
    of = np.repeat(np.arange(len(texts)), counts)
    size = np.full(len(data), SEGMENT, np.int64)
    full = counts > 0
    size[np.cumsum(counts)[full] - 1] = np.array([len(t) for t in texts], np.int64)[full] - (counts[full] - 1) * SEGMENT
    return np.ascontiguousarray(data.T), size, of


def train(examples: list[tuple[bytes, str]], rounds: int = 240, batch: int = 256, seed: int = 7) -> Network | None:
    """A network from segments with their language."""
    names = sorted({lang for _, lang in examples})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = Network(names, [draw(256, 3 * STATE) for _ in (0, 1)], [draw(STATE, 3 * STATE) for _ in (0, 1)], draw(2 * STATE, len(names)), np.zeros(len(names), np.float32))
    texts = [t[:SEGMENT] for t, _ in examples if t]
    target = np.array([names.index(lang) for t, lang in examples if t], np.int64)
    if not texts:
        return None
    data, size, _ = segments(texts)
    mask = (np.arange(SEGMENT)[:, None] < size).astype(np.float32)
    by_lang = [np.flatnonzero(target == c) for c in range(len(names))]
    by_lang = [rows for rows in by_lang if len(rows)]
    first, second = [np.zeros_like(p) for p in _parts(net)], [np.zeros_like(p) for p in _parts(net)]
    for step in range(1, rounds + 1):
        rows = np.concatenate([rng.choice(rows, max(1, batch // len(by_lang))) for rows in by_lang])
        rate = 0.03 * (1 - step / (rounds + 1))
        for p, g, a, b in zip(_parts(net), _gradients(data[:, rows], mask[:, rows], target[rows], net), first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _segments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PER_DOC`` segments of each text, spread over its length."""
    for batch, texts in slices(batches):
        places = [np.unique(np.linspace(0, max(0, len(t) - SEGMENT), PER_DOC).astype(int)).tolist() for t in texts]
        cut = pa.array([[t[a : a + SEGMENT] for a in at] for t, at in zip(texts, places, strict=True)], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cut], names=["doc_id", "lang", "cut"])


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Network | None:
    """A network of documents that have a language and are ``usable``."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.col("text") != "") & usable)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # a share of each language by hash, about twice the sample, so that the window does not see a whole language
    count = F.broadcast(known.groupBy("lang").agg(F.greatest(F.approx_count_distinct("doc_id"), F.lit(1)).alias("ids")))  # one row for each language
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30) < 2.0 * sample / F.col("ids")
    few = known.select("doc_id", "lang").join(count, "lang").filter(share).select("doc_id", "lang").distinct()
    picked = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample).select("doc_id", "lang")
    picked = F.broadcast(picked)  # ``sample`` rows of each language at most
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = known.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"]).select("doc_id", "lang", "text")
    rows = rows.mapInArrow(_segments_of, f"doc_id {kind}, lang string, cut array<binary>").distinct()
    # the limit of 1,000 texts of an id is applied before the shuffle
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "lang").orderBy(F.xxhash64("cut"), "cut"))).filter("turn <= 1000")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("turn", F.xxhash64("doc_id"), "doc_id"))).filter(F.col("n") <= sample)
    return train([(bytes(t), r.lang) for r in rows.select("lang", "cut").orderBy("lang", "n").collect() for t in r.cut])


def probabilities(texts: list[bytes], net: Network) -> np.ndarray:
    """The mean over all positions of each text; zeros for empty ones."""
    data, size, of = segments(texts)
    total = np.zeros((len(texts), len(net.names)))
    for k in range(0, data.shape[1], 2048):
        part = slice(k, k + 2048)
        p = label(np.ascontiguousarray(data[:, part]), net)
        p *= (np.arange(SEGMENT)[:, None] < size[part])[:, None, :]
        np.add.at(total, of[part], p.sum(axis=0).T)
    return total / np.maximum([[len(t)] for t in texts], 1) if texts else total


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1 << 20):
            chosen, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if net:
                p = probabilities(texts, net)
                for i, text in enumerate(texts):
                    if any(map(str.isalpha, text.decode())):
                        best = int(p[i].argmax())
                        chosen[i], score[i] = net.names[best], min(1.0, float(p[i, best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen), pa.array(score)], names=["key", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network | None, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score: one row per document row."""
    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_predict(net), f"key {kind}, lang_pred string, score double")
    return found.withColumnRenamed("key", key)
