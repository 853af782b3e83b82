"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE bytes.  Each passage is encoded by
its own bytes alone: a histogram of hashed words, one of byte-class pairs, and
how varied its words are; then a learned layer.  Gated attention gives every
passage a weight, and the weighted representation gets a logistic score.  Only
documents carry labels; the attention learns which passages tell.

The model is trained on the driver with numpy from at most SAMPLE labelled
documents (those with the smallest hashes of their ids) and at most
TRAIN_PASSAGES of each, evenly spread, whatever the tables' sizes.  Every
document is scored by the executors over its whole text, SLICE bytes at a time:
the attention's sums are carried from slice to slice, so a text of any length
takes the memory of one slice, besides itself.

Defined results: null text is empty; an empty text is one empty passage and has
a score too; rows with a null id aren't held out and never train; labels of one
id that disagree count as the largest; equal texts score alike (to the six
places that are kept), whatever their neighbours, batch or partition; an empty
table gives no rows; columns other than those kept aren't read, and ``score``
and ``predicted`` among those kept are replaced.  With no labels, or one kind
only, the score is that kind's share (0.5 without labels).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import spare_name, table, text_of

PASSAGE = 800  # bytes
SLICE = PASSAGE * 1280
SAMPLE = 4000
TRAIN_PASSAGES = 32
THRESHOLD = 0.3
PLACES = 6
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 32, 16, 25, 64, 0.01, 0.01
_CLASSES = 16
_PAIRS = _CLASSES * _CLASSES
WORD_BUCKETS = 256
FEATURES = _PAIRS + WORD_BUCKETS + 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def byte_classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, kinds of space, each sort of punctuation, the rest."""
    out = np.full(256, 15, np.uint8)
    letters = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
    marks = [" \t", "\n\r", ".", ",", "!?", ";:", "'\"()[]", "-_/\\", "#*$%&", "|<>", "@+=~^`{}"]
    for i, chars in enumerate(letters + marks):
        out[[ord(c) for c in chars]] = i
    out[128:] = 14
    return out


_CLASS_OF = byte_classes()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64)


def _roots(bins: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Square roots of each row's shares; ``bins`` are row * width + column."""
    counts = np.bincount(bins, minlength=rows * width).reshape(rows, width)
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each row has."""
    _, first = np.unique((keys ^ (rows.astype(np.uint64) * _MIX)) * _BASE, return_index=True)
    return np.bincount(rows[first], minlength=n)


def encode(raw: bytes) -> np.ndarray:
    """The features of each passage of ``raw``: of one, if it is empty.  A passage's depend on its own bytes alone."""
    data = np.frombuffer(raw, np.uint8)
    n = max(1, -(-len(data) // PASSAGE))
    place = np.arange(len(data)) // PASSAGE
    x = np.zeros((n, FEATURES))
    classes = _CLASS_OF[data].astype(np.int64)
    inside = place[1:] == place[:-1]
    x[:, :_PAIRS] = _roots((place[:-1] * _PAIRS + classes[:-1] * _CLASSES + classes[1:])[inside], n, _PAIRS)
    at = np.nonzero(~_SPACE[data])[0]
    if len(at):
        start = np.ones(len(at), bool)
        start[1:] = (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]])
        begin = np.nonzero(start)[0]
        nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(nth.max()), _BASE)]))
        words = np.add.reduceat(_LOWER[data[at]] * power[nth], begin) * _MIX
        row = place[at[begin]]
        bucket = (words >> np.uint64(56)).astype(np.int64)
        x[:, _PAIRS : _PAIRS + WORD_BUCKETS] = _roots(row * WORD_BUCKETS + bucket, n, WORD_BUCKETS)
        held = np.bincount(row, minlength=n)
        three = row[2:] == row[:-2]
        triples = (words[:-2] * _BASE + words[1:-1]) * _MIX + words[2:]
        x[:, -3] = _distinct(words, row, n) / np.maximum(1, held)
        x[:, -2] = _distinct(triples[three], row[2:][three], n) / np.maximum(1, held - 2)
        x[:, -1] = np.log1p(held) / 5
    return x


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """Weights of the encoder (W, b), the gated attention (V, U, w) and the output (c, c0)."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 11) -> Attention:
        rng = np.random.default_rng(seed)
        mat = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
        return cls(
            {
                "W": mat(FEATURES, HIDDEN) * 2, "b": np.zeros(HIDDEN), "V": mat(HIDDEN, GATE), "U": mat(HIDDEN, GATE),
                "w": mat(GATE, 1)[:, 0], "c": mat(HIDDEN, 1)[:, 0], "c0": np.zeros(1),
            }
        )

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """All passages of some documents at once; ``counts`` says how many each has."""
        m, at = self.weights, np.concatenate([[0], np.cumsum(counts)[:-1]])
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.maximum(x @ m["W"] + m["b"], 0)
        t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
        e = (t * g) @ m["w"]
        a = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a /= np.add.reduceat(a, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at)
        return {"at": at, "bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["c0"])}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        m, f = self.weights, self.forward(x, counts)
        h, t, g, a, bag = f["h"], f["t"], f["g"], f["a"], f["bag"]
        ds = (f["p"] - y) / len(y)
        dz = (ds[:, None] * m["c"])[bag]
        da = (h * dz).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, f["at"])[bag])
        gate = de[:, None] * m["w"]
        dt, dg = gate * g * (1 - t * t), gate * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ m["V"].T + dg @ m["U"].T) * (h > 0)
        return {
            "W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de,
            "c": f["z"].T @ ds, "c0": ds.sum(keepdims=True),
        }

    def score(self, text: str) -> float:
        """The score of one text, a slice at a time."""
        m, raw = self.weights, _bytes(text)
        top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for k in range(0, max(1, len(raw)), SLICE):
            h = np.maximum(encode(raw[k : k + SLICE]) @ m["W"] + m["b"], 0)
            e = (np.tanh(h @ m["V"]) * _sigmoid(h @ m["U"])) @ m["w"]
            now = max(top, e.max())
            a, before = np.exp(e - now), np.exp(top - now)
            total, z, top = total * before + a.sum(), z * before + a @ h, now
        return round(float(_sigmoid(z / total @ m["c"] + m["c0"])[0]), PLACES)


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Attention:
    """Trains by Adam with weight decay on log loss; ``bags`` holds each document's passages."""
    model, rng = Attention.fresh(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second, step = {k: np.zeros_like(v) for k, v in model.weights.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            x, counts = np.concatenate([bags[i] for i in some]), np.array([len(bags[i]) for i in some])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            scale = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, grad in model.gradients(x, counts, labels[some]).items():
                first[name] += 0.1 * (grad - first[name])
                second[name] += 0.001 * (grad * grad - second[name])
                move = scale * first[name] / (np.sqrt(second[name]) + 1e-8) + DECAY * model.weights[name]
                model.weights[name] = model.weights[name] - rate * move
    return model


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5


def _spread(x: np.ndarray) -> np.ndarray:
    """At most TRAIN_PASSAGES rows, evenly spread."""
    if len(x) <= TRAIN_PASSAGES:
        return x
    return x[np.linspace(0, len(x) - 1, TRAIN_PASSAGES).astype(int)]


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    sample: int = SAMPLE,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> Attention | float:
    """A model from labelled documents outside fold 0; a constant score if there is one kind of label at most.

    ``prepare`` turns the sample's rows (doc_id, y, text) into what will be
    scored, for documents that are cleaned before they are scored.
    """
    hashed = F.xxhash64("doc_id", F.lit(3))
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    known = known.filter(F.col("y").isNotNull() & (fold() != 0))
    some = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(hashed, "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).join(F.broadcast(some), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    if prepare is not None:
        texts = prepare(texts).select("doc_id", "y", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = []
            for t in batch.column("text"):
                raw = _bytes(t.as_py())
                parts = [encode(raw[k : k + SLICE]) for k in range(0, max(1, len(raw)), SLICE)]
                x.append(zlib.compress(_spread(np.concatenate(parts)).astype(np.float32).tobytes(), 1))
            columns = [batch.column("doc_id"), batch.column("y"), pa.array(x, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "y", "x"])

    rows = sorted(texts.mapInArrow(run, "doc_id long, y int, x binary").collect())
    y = np.array([min(1, max(0, r[1])) for r in rows], float)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return fit([np.frombuffer(zlib.decompress(r[2]), np.float32).reshape(-1, FEATURES).astype(float) for r in rows], y)


def score_documents(
    docs: DataFrame, model: Attention | float, keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """The ``keep`` columns with score and predicted added."""
    keep = tuple(k for k in keep if k not in ("score", "predicted"))
    own_text = spare_name(keep)
    rows = docs.select(*keep, text_of(text).alias(own_text))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != own_text]
    score = model.score if isinstance(model, Attention) else lambda t: model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [score(t.as_py()) for t in batch.column(own_text)]
            own = [pa.array(p, pa.float64()), pa.array([int(x >= THRESHOLD) for x in p], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *own], names=[*keep, "score", "predicted"])

    return rows.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
