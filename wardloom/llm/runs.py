"""Periodic runs of words, by Kruskal over suffixes in descending order of their common prefixes.

A run is a stretch of words with smallest period q, at least LEAST words and two
periods long, that no neighbouring word extends.  A run's start and the place a
period later share a prefix of at least half its length, so only suffixes whose
first LEAST / 2 words occur again in their text can take part:

1. those suffixes are put in an order in which equal prefixes stand together
   (prefix doubling), with the common prefix of each two neighbours;
2. the neighbours' classes are united by falling common prefix, each class a
   union-find set with its positions in order.  Two positions of different
   classes that become adjacent in the united set have exactly the prefix of
   that step in common; if their distance is no more than that, they are one
   period of a run apart.  No position lies between that would make the period
   smaller, and a multiple of the period is never adjacent;
3. such a pair is a run's first one if the words before its two places differ.

Texts are dealt with in chunks of about CHUNK words, a longer text alone, so
memory goes with one chunk or one text.  Nothing is shuffled; a lost task is
done again from its input.

Defined results: null text is no words; words are runs of anything but the six
ASCII white-space characters; repeated rows are searched each; empty tables give
no rows; columns not kept aren't read, kept ones of the names added here are
replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm.common import let, spare_name, table, text_of, words_of

LEAST = 12
CHUNK = 400_000
RUNS = "array<struct<start:long,length:long,period:long>>"
ADDED = ("n_words", "runs", "collapsed")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers words by first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _repeated(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next ``k`` words occur again in their document, sorted by those words, and a group number for each."""
    at = np.arange(len(ids))
    at = at[ends[doc] - at >= k]
    h = doc[at].astype(np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(31))) * _ODD + ids[at + j].astype(np.uint64)
    order = np.sort(h)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return at[:0], at[:0]
    near = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    at = at[twice[near] == h]
    columns = [ids[at + j] for j in reversed(range(k))] + [doc[at]]  # the hash only chose; these decide
    order = np.lexsort(columns)
    new = np.ones(len(at), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    return at[order][many], group[many]


def neighbours(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbouring suffixes (places of both, common prefix), of those with ``k`` words in common at least."""
    at, group = _repeated(ids, doc, ends, k)
    m, none = len(at), np.empty(0, np.int64)
    if not m:
        return none, none, none
    index = np.full(len(ids), -1, np.int64)
    index[at] = np.arange(m)

    def later(place: np.ndarray, by: int) -> np.ndarray:
        """The suffix ``by`` words on, by index; -1 where its first words don't repeat or the document ends."""
        to = place + by
        inside = to < ends[doc[place]]
        return np.where(inside, index[np.minimum(to, len(ids) - 1)], -1)

    def word(place: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The word at ``place``, -1 after the document of suffix ``of``."""
        return np.where(place < ends[doc[at[of]]], ids[np.minimum(place, len(ids) - 1)], -1)

    first = np.nonzero(np.append(True, group[1:] != group[:-1]))[0]
    rank = np.repeat(first, np.diff(np.append(first, m)))  # of each group its first place in the order
    levels, length, order = [rank], k, np.arange(m)
    active = np.arange(m)
    while len(active):
        to = later(at[active], length)
        second = np.where(to >= 0, rank[to] + m, -1 - active)  # suffixes that repeat no more all differ
        moved = np.lexsort([second, *(word(at[active] + length + j, active) for j in reversed(range(k))), rank[active]])
        a, s = active[moved], second[moved]
        place = np.sort(_places(order, m)[active])
        order[place] = a
        new = np.ones(len(a), bool)
        new[1:] = (rank[a][1:] != rank[a][:-1]) | (s[1:] != s[:-1])
        begin = np.nonzero(new)[0]
        size = np.diff(np.append(begin, len(a)))
        rank = rank.copy()
        rank[a] = np.repeat(place[begin], size)
        levels.append(rank)
        active = a[np.repeat(size, size) > 1]
        length *= 2
    x, y = order[:-1], order[1:]
    same = levels[0][x] == levels[0][y]
    x, y = at[x[same]], at[y[same]]
    common = np.zeros(len(x), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step, r = k << level, levels[level]
        a, b = index[np.minimum(x + common, len(ids) - 1)], index[np.minimum(y + common, len(ids) - 1)]
        within = (np.maximum(x, y) + common < ends[doc[x]]) & (a >= 0) & (b >= 0)
        common += step * (within & (r[a] == r[b]))
    going = np.ones(len(x), bool)
    for _ in range(k - 1):
        a, b = x + common, y + common
        going &= np.maximum(a, b) < ends[doc[x]]
        going &= ids[np.minimum(a, len(ids) - 1)] == ids[np.minimum(b, len(ids) - 1)]
        common += going
    return x, y, common


def _places(order: np.ndarray, m: int) -> np.ndarray:
    out = np.empty(m, np.int64)
    out[order] = np.arange(m)
    return out


def _hopeless(x: np.ndarray, y: np.ndarray, common: np.ndarray, k: int) -> np.ndarray:
    """Pairs of groups (chains of neighbours) in which no two places are as near as the longest common prefix."""
    begin = np.append(True, x[1:] != y[:-1])
    chain = np.cumsum(begin) - 1
    of = np.concatenate([chain, chain[begin]])
    place = np.concatenate([y, x[begin]])
    order = np.lexsort([place, of])
    gap, inside = np.diff(place[order]), of[order][1:] == of[order][:-1]
    least = np.full(chain[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of[order][1:][inside], gap[inside])
    most = np.zeros(chain[-1] + 1, np.int64)
    np.maximum.at(most, chain, common)
    return (least > most)[chain]


def seeds(x: np.ndarray, y: np.ndarray, common: np.ndarray) -> np.ndarray:
    """(place, distance, common prefix) of positions that become adjacent no further apart than their common prefix."""
    order = np.argsort(-common, kind="stable")
    places, both = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = both[: len(x)][order].tolist(), both[len(x) :][order].tolist()
    held = [[p] for p in places.tolist()]
    up = list(range(len(held)))
    out: list[tuple[int, int, int]] = []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j, prefix in zip(a, b, common[order].tolist(), strict=True):
        i, j = root(i), root(j)
        big, small = held[i], held[j]
        if len(big) < len(small):
            i, j, big, small = j, i, small, big
        last = len(small) - 1
        for n, p in enumerate(small):
            at = bisect_left(big, p)
            if at and p - big[at - 1] <= prefix and (n == 0 or small[n - 1] < big[at - 1]):
                out.append((big[at - 1], p - big[at - 1], prefix))
            if at < len(big) and big[at] - p <= prefix and (n == last or small[n + 1] > big[at]):
                out.append((p, big[at] - p, prefix))
        if 8 * len(small) > len(big):
            big += small
            big.sort()  # two sorted runs: linear
        else:
            for p in small:
                insort(big, p)
        up[j], held[j] = i, None
    return np.array(out, np.int64).reshape(-1, 3)


def find_runs(ids: np.ndarray, counts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(document, start, length, period) of the runs in documents of ``counts`` words; ``ids`` are all their words' numbers."""
    ends = np.cumsum(counts)
    begins = ends - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    x, y, common = neighbours(ids, doc, ends, max(1, -(-least // 2)))
    if len(x):
        some = ~_hopeless(x, y, common, least)
        x, y, common = x[some], y[some], common[some]
    found = seeds(x, y, common)
    p, q, prefix = found[:, 0], found[:, 1], found[:, 2]
    starts = p == begins[doc[p]]
    starts |= ids[np.maximum(p - 1, 0)] != ids[np.maximum(p + q - 1, 0)]
    kept = starts & (q + prefix >= least)
    d = doc[p[kept]]
    out = np.stack([d, p[kept] - begins[d], (q + prefix)[kept], q[kept]], axis=1)
    return out[np.lexsort([out[:, 3], out[:, 1], out[:, 0]])]


def _chunk(texts: list[list[bytes]], numbers: _Numbers, least: int) -> tuple[list, list]:
    """The runs of each text (lists of words), and its words joined without those that only repeat."""
    counts = np.array([len(w) for w in texts], np.int64)
    ids = np.fromiter((numbers[w] for words in texts for w in words), np.int64, int(counts.sum()))
    found = find_runs(ids, counts, least)
    cut = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    runs, collapsed = [], []
    for k, words in enumerate(texts):
        mine = found[cut[k] : cut[k + 1], 1:]
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in mine.tolist()])
        if len(mine):
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, mine[:, 0] + mine[:, 2], 1)
            np.add.at(change, mine[:, 0] + mine[:, 1], -1)
            words = compress(words, (np.cumsum(change[:-1]) == 0).tolist())
        collapsed.append(b" ".join(words))
    return runs, collapsed


def detect_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", least: int = LEAST) -> DataFrame:
    """The ``keep`` columns with n_words, runs (by start, then period) and collapsed.

    ``collapsed`` has the words joined by one space, without those that lie in
    a run after its first period.
    """
    keep = tuple(k for k in keep if k not in ADDED)
    own_text = spare_name(keep)
    rows = docs.select(*keep, text_of(text).alias(own_text))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != own_text]
    own = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, size = 0, [], 0
            raw = batch.column(own_text).cast(pa.binary())
            for k in range(len(raw)):
                held.append(raw[k].as_py().split())  # of bytes: the six ASCII spaces
                size += len(held[-1])
                if size >= CHUNK or k + 1 == len(raw):
                    runs, collapsed = _chunk(held, _Numbers(), least)
                    part = batch.slice(begin, len(held))
                    columns = [
                        *(part.column(c) for c in keep),
                        pa.array([len(w) for w in held], pa.int64()),
                        pa.array(runs, own),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, *ADDED])
                    begin, held, size = k + 1, [], 0

    return rows.mapInArrow(run, ", ".join([*fields, "n_words long", f"runs {RUNS}", "collapsed string"]))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the documents, by a hash of their id, repeat a stretch to their end."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10).cast("long")

    def repeating(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        )
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(words, i)), " ")).otherwise("")

    return docs.select("doc_id", F.when(h % 10 == 0, let(words_of(text_of()), repeating)).otherwise(text_of()).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect_runs(planted(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    rows = rows.withColumn("top", longest).withColumn("length", F.col("top.length"))
    rows = rows.withColumn("start", -F.col("top").getField("col2")).withColumn("period", -F.col("top").getField("col3"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "start",
        "length",
        "period",
        F.floor(1000 * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"),
        digest(lines).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
