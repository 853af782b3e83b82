"""Packing by minimum bin slack.

Documents are cut into pieces of at most the window's length.  Which lengths
share a window depends on the lengths alone, so the plan is made on their
counts (at most ``capacity`` different lengths, however many documents): seed a
window with the longest length left, then a bitset subset-sum over the
remaining multiset finds the sum closest to the room left, and walking the
bitsets back gives how many of each length to take.  The same window is used as
often as the counts allow, so a plan has few entries.

Spark does the rest: pieces are ranked among those of their length, and a range
join with the plan turns a rank into a sequence and an offset.  A piece that
fills a window by itself needs no rank: it gets a sequence of its own at once.

Defined results: null text is empty and is a document of its end id alone; a
long text is encoded whole, in one call, and then cut; repeated rows are separate
documents; ties in length go by document id; sequence ids aren't gapless, offsets
are; an empty table gives no sequences; ``pack_documents`` reads the id and text
columns alone; ``pack`` replaces sequence_id, offset and columns that begin with
``__``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.llm.common import stored, table, text_of
from wardloom.llm.tokens import encoder, packed

CAPACITY = 2048
END_ID = 1
#: Pieces of one length are ranked in this many parts, so that a common length isn't one window.
PARTS = 32


def fill(counts: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """[(length, how many)] of the multiset ``counts`` (longest first) whose sum is closest to ``room``.

    Bit s of a bitset is set if some choice of the lengths so far sums to s.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, n in counts:
        if length > room:
            continue
        steps.append((length, min(n, room // length), reach))
        left, block = steps[-1][1], 1
        while left:  # 1, 2, 4, ... copies at once
            take = min(block, left)
            reach |= (reach << (length * take)) & full
            left, block = left - take, block * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, most, before in reversed(steps):
        took = 0
        while not before >> total & 1:
            total, took = total - length, took + 1
            if took > most:
                raise AssertionError("no way back through the bitsets")
        if took:
            chosen.append((length, took))
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, each, sequence, offset): pieces of that length with ranks [from, to) lie, ``each``
    to a sequence, in sequences from ``sequence`` on, at ``offset`` there and after one another."""
    left, used, out, sequence = dict(sorted(counts.items(), reverse=True)), dict.fromkeys(counts, 0), [], 0
    while left:
        seed = next(iter(left))
        rest = [(x, n - (x == seed)) for x, n in left.items() if n > (x == seed)]
        window: dict[int, int] = {seed: 1}
        for x, n in fill(rest, capacity - seed) if seed < capacity else []:
            window[x] = window.get(x, 0) + n
        times = min(left[x] // n for x, n in window.items())
        offset = 0
        for x, n in window.items():
            out.append((x, used[x], used[x] + times * n, n, sequence, offset))
            offset += x * n
            used[x] += times * n
            left[x] -= times * n
            if not left[x]:
                del left[x]
        sequence += times
    return out


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens (and the ids themselves if asked)."""
    rows = docs.select(F.col(id_col), text_of(text).alias("text"))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            at, start, length, crc, tokens, pieces = [], [], [], [], [], []
            for i, t in enumerate(batch.column("text")):
                found = encode(t.as_py())
                found.append(END_ID)
                raw, n = memoryview(packed(found)), len(found)
                for s in range(0, n, capacity):
                    e = min(n, s + capacity)
                    at.append(i)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                    tokens.append(n)
                    if ids:
                        pieces.append(found[s:e])
            columns = [batch.column(id_col).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if ids:
                columns, names = [*columns, pa.array(pieces, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``pieces`` with sequence_id and offset added; pieces must be at most ``capacity`` long.

    Ranks within a length come in two steps (within a part of it, then the
    parts' sizes summed), so a length that most pieces share is still dealt out.
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset") and not c.startswith("__")]
    every = stored(pieces.select(*kept).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    full = F.col(length) == capacity
    rows = every.filter(~full).withColumn("__part", F.pmod("__row", F.lit(PARTS)).cast("int"))
    sizes = [tuple(r) for r in rows.groupBy(length, "__part").count().orderBy(length, "__part").collect()]  # at most capacity * PARTS rows
    counts: dict[int, int] = {}
    before = []
    for x, part, n in sizes:
        before.append((x, part, counts.get(x, 0)))
        counts[x] = counts.get(x, 0) + n
    starts = F.broadcast(spark.createDataFrame(before, "__length long, __part int, __before long"))
    planned = plan(counts, capacity)
    following = max((s + (to - at) // each for _, at, to, each, s, _ in planned), default=0)
    ranges = F.broadcast(spark.createDataFrame(planned, "__l long, __from long, __to long, __each long, __sequence long, __offset long"))
    in_part = Window.partitionBy(length, "__part").orderBy(*order)
    ranked = (
        rows.withColumn("__rank", F.row_number().over(in_part).cast("long") - 1)
        .join(starts.withColumnRenamed("__part", "__p"), (F.col(length) == F.col("__length")) & (F.col("__part") == F.col("__p")))
        .withColumn("__rank", F.col("__rank") + F.col("__before"))
    )
    placed = ranked.join(ranges, (F.col(length) == F.col("__l")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    nth = F.col("__rank") - F.col("__from")
    alone = every.filter(full).select(*kept, (F.col("__row") + following).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.select(
        *kept,
        (F.col("__sequence") + F.floor(nth / F.col("__each")).cast("long")).alias("sequence_id"),
        (F.col("__offset") + nth % F.col("__each") * F.col(length)).alias("offset"),
    ).unionByName(alone)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    return pack(cut_documents(docs, path, capacity, ids=ids), capacity)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the pieces' ids joined in order; a sequence has at most ``capacity`` of them."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
