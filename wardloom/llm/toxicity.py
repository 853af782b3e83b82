"""Toxicity: a convolutional text classifier over hashed word embeddings, with a threshold for each language.

A word's embedding is the mean of learned vectors that its hash and those of its
beginnings and ends pick, so that inflected forms of a word share most of what is
known of it.  Filters of several widths run over the words; each filter's largest
value in the text (max pooling) goes to a logistic output.

The model is trained on the driver with numpy (Adam, log loss) from at most
SAMPLE labelled documents of at most TRAIN_WORDS words each (those with the
smallest hashes of their ids), whatever the tables' sizes.  A fifth of them isn't
trained on: there the threshold of each language is set, at the middle of the
place where fewest documents would be judged wrongly.  A language with under
LEAST_KNOWN toxic documents there takes the threshold of all.  The language is
guessed from the text's own function words.  A score is shifted so that its
language's threshold is at 0.5.

Every document is scored by the executors over its whole text, SLICE words at a
time, the filters' largest values being carried on; memory goes with one slice
besides the text.

Defined results: null text is empty; an empty text is one unknown word and has a
score too; rows with a null id aren't held out and never train; labels of one id
that disagree count as the largest; equal texts score alike, to the PLACES that
are kept; an empty table gives no rows; columns other than those kept aren't
read, kept ones named ``score`` and ``predicted`` are replaced.  With no labels,
or one kind only, the score is that kind's share (0.5 without labels).
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm.common import spare_name, table, text_of

SAMPLE = 8000
TRAIN_WORDS = 1500
SLICE = 320
THRESHOLD = 0.5
PLACES = 6
BUCKETS, WIDTH, FILTERS, WIDTHS = 1 << 18, 16, 24, (1, 2, 3)
BEGINNINGS, ENDS = (3, 4, 5, 7), (4,)
EPOCHS, BATCH, RATE, EMBED_RATE, DECAY, DROP = 12, 32, 0.004, 0.05, 1e-4, 0.2
LEAST_KNOWN = 12
#: Buckets of a word.
_PIECES = 1 + len(BEGINNINGS) + len(ENDS)
_PAD = max(WIDTHS) - 1
#: Word vectors that a task remembers before it starts anew.
REMEMBERED = 300_000

# Common function words, by language; any text may hold those of several.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for it with as on by this are be from or an not have".split(),
    "de": "der die und das ist nicht mit von den ein eine zu im auf für sich des dem als auch".split(),
    "fr": "le la les et des est dans une un que qui pour pas sur du au par avec ce sont".split(),
    "es": "el los las y del que en un una por con para su se es al lo como más no".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def pieces(word: str) -> list[int]:
    """The buckets of a word: of itself, then of its proper beginnings and ends (its own again where it is too short)."""
    own, n = crc32(word.encode("utf-8", "replace")) % BUCKETS, len(word)
    out = [own]
    for k in BEGINNINGS:
        out.append(crc32(word[:k].encode("utf-8", "replace"), k) % BUCKETS if n > k else own)
    for k in ENDS:
        out.append(crc32(word[-k:].encode("utf-8", "replace"), 64 + k) % BUCKETS if n > k else own)
    return out


_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class Words(dict):
    """Numbers words as they come, and keeps the buckets and the language of each (the last number: none)."""

    def __init__(self) -> None:
        super().__init__()
        self._buckets = array("i", pieces(""))
        self._language = array("b", [len(FUNCTION_WORDS)])
        self._bare: dict[str, int] = {"": 0}
        self._function = {w: k for k, own in enumerate(reversed(FUNCTION_WORDS.values())) for w in own}
        self._function = {w: len(FUNCTION_WORDS) - 1 - k for w, k in self._function.items()}

    def __missing__(self, word: str) -> int:
        bare = word.strip(_EDGES)
        n = self._bare.get(bare)
        if n is None:
            n = self._bare[bare] = len(self._language)
            self._buckets.extend(pieces(bare))
            self._language.append(self._function.get(bare, len(FUNCTION_WORDS)))
        self[word] = n
        return n

    def known(self) -> int:
        return len(self._language)

    def buckets(self, since: int = 0) -> np.ndarray:
        return np.array(self._buckets[since * _PIECES :]).reshape(-1, _PIECES)

    def languages(self, since: int = 0) -> np.ndarray:
        return np.array(self._language[since:], np.int64)


def split(text: str) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def guess(counts: np.ndarray) -> int:
    """The language with most function words in the text, by number; the last one where there are none."""
    best = int(np.argmax(counts[:-1]))
    return best if counts[best] else len(LANGUAGES) - 1


@dataclass
class Convolution:
    """Embeddings E, filters W<width> with biases b<width>, output c and c0; thresholds (as logits) by language."""

    weights: dict[str, np.ndarray]
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    @classmethod
    def fresh(cls, seed: int) -> Convolution:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        weights = {"E": draw(BUCKETS, WIDTH) * np.float32(0.1)}
        for w in WIDTHS:
            weights[f"W{w}"] = draw(w * WIDTH, FILTERS) / np.float32(np.sqrt(w * WIDTH))
            weights[f"b{w}"] = np.zeros(FILTERS, np.float32)
        weights["c"] = draw(len(WIDTHS) * FILTERS) / np.float32(np.sqrt(len(WIDTHS) * FILTERS))
        weights["c0"] = np.zeros(1, np.float32)
        return cls(weights)

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        return self.weights["E"][buckets].mean(axis=1)

    def filtered(self, x: np.ndarray, width: int) -> np.ndarray:
        """Each filter's value at each place of ``x`` that has ``width`` words."""
        m, n = self.weights[f"W{width}"], len(x) - width + 1
        out = x[:n] @ m[:WIDTH]
        for j in range(1, width):
            out += x[j : n + j] @ m[j * WIDTH : (j + 1) * WIDTH]
        return out

    def output(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.weights["c"] + self.weights["c0"]

    def bias(self) -> np.ndarray:
        return np.concatenate([self.weights[f"b{w}"] for w in WIDTHS])

    def score(self, text: str, memory: Memory) -> float:
        """The score of one text, a slice of words at a time."""
        words = split(text)
        top = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        known = np.zeros(len(LANGUAGES), np.int64)
        tail = np.zeros((_PAD, WIDTH), np.float32)
        for k in range(0, max(1, len(words)), SLICE):
            numbers, languages, vectors = memory.look(words[k : k + SLICE] or [""])
            known += np.bincount(languages[numbers], minlength=len(LANGUAGES))
            x = np.concatenate([tail, vectors[numbers]])
            for i, w in enumerate(WIDTHS):
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                y = self.filtered(x[_PAD - w + 1 :], w)
                top[part] = np.maximum(top[part], y.max(axis=0))
            tail = x[-_PAD:]
        logit = float(self.output(top + self.bias())[0]) - self.thresholds[guess(known)]
        return round(float(_sigmoid(np.array(logit))), PLACES)


class Memory:
    """The vectors of words that a task has met; it starts anew when it holds too many, so its size is bounded."""

    def __init__(self, model: Convolution) -> None:
        self.model = model
        self._start()

    def _start(self) -> None:
        self.words = Words()
        self.vectors = np.zeros((0, WIDTH), np.float32)
        self.languages = np.zeros(0, np.int64)
        self.held = 0

    def look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' numbers, and languages and vectors by number."""
        if len(self.words) > REMEMBERED:
            self._start()
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        have, now = self.held, self.words.known()
        if now > have:
            if now > len(self.vectors):
                room = max(4096, 2 * now)
                self.vectors = np.concatenate([self.vectors, np.zeros((room - len(self.vectors), WIDTH), np.float32)])
                self.languages = np.concatenate([self.languages, np.zeros(room - len(self.languages), np.int64)])
            self.vectors[have:now] = self.model.embed(self.words.buckets(have))
            self.languages[have:now] = self.words.languages(have)
            self.held = now
        return numbers, self.languages, self.vectors


def _step(model: Convolution, buckets: np.ndarray, texts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> tuple[dict, tuple]:
    """Gradients of the mean log loss over some texts (word numbers), with pooled values dropped out at random.

    Those of the embeddings come apart, as the rows that are touched and their gradients.
    """
    m = model.weights
    gap = np.full(_PAD, -1)
    joined = np.concatenate([part for t in texts for part in (t, gap)])
    own, at = np.unique(joined, return_inverse=True)
    pieces_of = buckets[np.maximum(own, 0)]
    table_ = model.embed(pieces_of)
    if own[0] < 0:
        table_[0] = 0
    x = table_[at]
    begins = np.cumsum([0, *(len(t) + _PAD for t in texts)])
    place = np.empty((len(texts), len(WIDTHS), FILTERS), np.int64)
    pooled = np.empty((len(texts), len(WIDTHS), FILTERS), np.float32)
    for i, w in enumerate(WIDTHS):
        # as in scoring, a window may begin up to width - 1 words before its text, in the gap before it
        lead = np.concatenate([np.zeros((w - 1, WIDTH), np.float32), x])
        f = model.filtered(lead, w)
        for k in range(len(texts)):
            some = f[begins[k] : begins[k + 1] - _PAD]
            place[k, i] = begins[k] + some.argmax(axis=0)
            pooled[k, i] = some.max(axis=0) + m[f"b{w}"]
    kept = (rng.random(pooled.shape) >= DROP) / np.float32(1 - DROP)
    h = np.maximum(pooled, 0) * kept
    c = m["c"].reshape(len(WIDTHS), FILTERS)
    ds = (_sigmoid((h * c).sum(axis=(1, 2)) + m["c0"]) - y).astype(np.float32) / np.float32(len(y))
    out = {"c": (ds[:, None, None] * h).sum(axis=0).ravel(), "c0": ds.sum(keepdims=True)}
    dh = ds[:, None, None] * c * kept * (pooled > 0)
    dx = np.zeros_like(x)
    for i, w in enumerate(WIDTHS):
        at_, g = place[:, i].ravel(), dh[:, i].astype(np.float32)
        out[f"b{w}"] = g.sum(axis=0)
        d = np.zeros_like(m[f"W{w}"])
        columns = np.tile(np.arange(FILTERS), len(texts))
        for j in range(w):
            where = at_ - (w - 1) + j
            inside = (where >= 0).astype(np.float32)
            rows = x[np.maximum(where, 0)] * inside[:, None]
            d[j * WIDTH : (j + 1) * WIDTH] = (rows * g.ravel()[:, None]).reshape(len(texts), FILTERS, WIDTH).sum(axis=0).T
            np.add.at(dx, np.maximum(where, 0), m[f"W{w}"][j * WIDTH : (j + 1) * WIDTH].T[columns] * (g.ravel() * inside)[:, None])
        out[f"W{w}"] = d
    dtable = np.zeros_like(table_)
    moved = np.nonzero(dx.any(axis=1))[0]
    np.add.at(dtable, at[moved], dx[moved])
    if own[0] < 0:
        dtable[0] = 0
    touched = np.nonzero(dtable.any(axis=1))[0]
    rows, to = np.unique(pieces_of[touched].ravel(), return_inverse=True)
    de = np.zeros((len(rows), WIDTH), np.float32)
    np.add.at(de, to, np.repeat(dtable[touched] / np.float32(_PIECES), _PIECES, axis=0))
    return out, (rows, de)


def fit(texts: list[list[str]], y: np.ndarray, seed: int = 13) -> Convolution:
    """Trains on log loss: filters and output by Adam, the embeddings that a step touches by Adagrad."""
    words, rng = Words(), np.random.default_rng(seed)
    numbers = [np.array([words[w] for w in t] or [0], np.int64) for t in texts]
    buckets = words.buckets()
    model = Convolution.fresh(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items() if k != "E"}
    second, step = {k: np.zeros_like(v) for k, v in first.items()}, 0
    squares = np.zeros(BUCKETS, np.float32)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            step += 1
            rate = np.float32(RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            dense, (rows, grads) = _step(model, buckets, [numbers[i] for i in some], y[some], rng)
            squares[rows] += (grads * grads).mean(axis=1)
            model.weights["E"][rows] -= np.float32(EMBED_RATE) * grads / (np.sqrt(squares[rows]) + np.float32(1e-8))[:, None]
            for name, grad in dense.items():
                first[name] += np.float32(0.1) * (grad - first[name])
                second[name] += np.float32(0.001) * (grad * grad - second[name])
                model.weights[name] -= rate * first[name] / (np.sqrt(second[name]) + np.float32(1e-8))
                if name.startswith("W") or name == "c":
                    model.weights[name] *= np.float32(1 - DECAY)
    return model


def threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest place between scores at which fewest documents would be judged wrongly."""
    order = np.argsort(logits, kind="stable")
    s, wrong = logits[order], np.concatenate([[0], np.cumsum(y[order])]) + np.concatenate([np.cumsum(1 - y[order][::-1])[::-1], [0]])
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    room = np.diff(edges)
    fewest = np.nonzero((wrong == wrong[room > 0].min()) & (room > 0))[0]
    k = fewest[np.argmax(room[fewest])]
    return float(edges[k] + edges[k + 1]) / 2


def calibrate(model: Convolution, texts: list[str], y: np.ndarray) -> None:
    """Sets the thresholds from texts that weren't trained on."""
    model.thresholds = np.zeros(len(LANGUAGES))
    memory = Memory(model)
    scores = np.clip([model.score(t, memory) for t in texts], 1e-6, 1 - 1e-6)
    logits = np.log(scores / (1 - scores))
    languages = np.array([language_of(t) for t in texts])
    if 0 < y.sum() < len(y):
        model.thresholds[:] = threshold(logits, y)
        for k in range(len(LANGUAGES)):
            own = languages == k
            if y[own].sum() >= LEAST_KNOWN and (1 - y[own]).sum() >= LEAST_KNOWN:
                model.thresholds[k] = threshold(logits[own], y[own])


def language_of(text: str) -> int:
    words = Words()
    numbers = [words[w] for w in split(text)]
    return guess(np.bincount(words.languages()[numbers], minlength=len(LANGUAGES)))


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Convolution | float:
    """A model from labelled documents outside fold 0; a constant score if there is one kind of label at most."""
    hashed = F.xxhash64("doc_id", F.lit(5))
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    known = known.filter(F.col("y").isNotNull() & (fold() != 0))
    some = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(hashed, "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).join(F.broadcast(some), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(split(t.as_py())) for t in batch.column("text")]
            ok = pa.array([t.count(" ") < TRAIN_WORDS for t in found], pa.bool_())
            packed = pa.array([zlib.compress(t.encode("utf-8", "replace"), 1) for t in found], pa.binary())
            columns = [c.filter(ok) for c in (batch.column("doc_id"), batch.column("y"), packed)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "y", "x"])

    rows = sorted(texts.mapInArrow(run, "doc_id long, y int, x binary").collect())
    y = np.array([min(1, max(0, r[1])) for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    held = [zlib.decompress(r[2]).decode("utf-8") for r in rows]
    aside = np.array([zlib.crc32(b"aside %d" % r[0]) % 5 == 0 for r in rows])
    if len(set(y[~aside].tolist())) < 2:
        aside[:] = False
    model = fit([split(held[i]) for i in np.nonzero(~aside)[0]], y[~aside])
    calibrate(model, [held[i] for i in np.nonzero(aside)[0]], y[aside])
    return model


def score_documents(docs: DataFrame, model: Convolution | float, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns with score and predicted added."""
    keep = tuple(k for k in keep if k not in ("score", "predicted"))
    own_text = spare_name(keep)
    rows = docs.select(*keep, text_of(text).alias(own_text))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != own_text]
    spread = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the tables' sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        memory = Memory(model) if isinstance(model, Convolution) else None
        for batch in batches:
            p = [model.score(t.as_py(), memory) if memory else model for t in batch.column(own_text)]
            own = [pa.array(p, pa.float64()), pa.array([int(x >= THRESHOLD) for x in p], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *own], names=[*keep, "score", "predicted"])

    return rows.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
