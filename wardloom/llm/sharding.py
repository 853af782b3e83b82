"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns several virtual nodes on a ring of arcs.  A row's key hashes to
an arc and belongs to the next virtual node clockwise; once that shard is full,
further rows go on clockwise to the next shard with room.  A shard's bound is
its equal part of all rows, so counts differ by one at most.

The ring is walked over counts per segment, never over rows.  A segment is an
arc; one that holds more than its even share, as a hot key's does, is cut into
so many parts by a hash of the whole row, so none is a large window.  Segments
are twice the arcs at most, whatever the data, so their counts are safe to
collect and the ranges that the walk hands out are safe to broadcast.  Each row then finds
its shard and its slot from its rank in its segment.  Ranks come from hashes of
the row's own values, so the same rows get the same shards however they are laid
out in files; rows that are equal in every column are interchangeable.

The bound costs some movement besides the new shard's part: rows that overflow
may find other room.  With VIRTUAL_NODES nodes a shard that is little.

Defined results: a null key counts as the empty text; a long key is hashed
whole; equal keys share an arc, and overflow clockwise if there are too many;
repeated rows are separate rows; an empty table gives no rows; other columns
pass through, but ``shard`` and ``slot`` are replaced and columns that begin
with ``__`` dropped (maps can't be hashed and are left out of ranks).
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.llm.common import stored, table, text_of

ARCS = 16384
#: An arc with more rows than this, and than its even share, is cut.
SEGMENT_ROWS = 10_000
VIRTUAL_NODES = 256


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES, arcs: int = ARCS) -> list[tuple[int, int]]:
    """(arc, shard) of each virtual node, clockwise.  A shard's nodes don't depend on the other shards."""
    at = lambda s, v: int.from_bytes(blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
    nodes = sorted((at(s, v), s) for s in range(n_shards) for v in range(virtual_nodes))
    return [(x * arcs >> 64, s) for x, s in nodes]


def walk(counts: dict[tuple[int, int], int], nodes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """(arc, part, from, to, shard, slot): ranks [from, to) of a segment take that shard's slots from ``slot`` on.

    First every shard takes its own segments' rows in ring order; then what
    is over goes on clockwise from where it was.
    """
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    arcs = [a for a, _ in nodes]
    out, over = [], []

    def take(segment: tuple[int, int], done: int, left: int, shard: int) -> int:
        n = min(left, room[shard] - used[shard])
        if n:
            out.append((*segment, done, done + n, shard, used[shard]))
            used[shard] += n
        return n

    for segment in sorted(counts):
        node = bisect_left(arcs, segment[0]) % len(nodes)
        n = take(segment, 0, counts[segment], nodes[node][1])
        if n < counts[segment]:
            over.append((segment, node, n))
    for segment, node, done in over:
        while done < counts[segment]:
            node = (node + 1) % len(nodes)
            done += take(segment, done, counts[segment] - done, nodes[node][1])
    return out


def shard_rows(df: DataFrame, key: str, n_shards: int) -> DataFrame:
    """``df`` with shard (int) and slot (long, gapless from 0 in each shard) added."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot") and not c.startswith("__")]
    own = [c for c in kept if "map<" not in df.schema[c].dataType.simpleString()]
    hashed = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = df.select(*kept, hashed.alias("__h"), F.xxhash64(F.lit(1), *own).alias("__row"))
    rows = stored(rows.withColumn("__arc", F.shiftrightunsigned("__h", 64 - (ARCS.bit_length() - 1)).cast("int")), "shard-rows")
    arcs = [tuple(r) for r in rows.groupBy("__arc").count().collect()]  # ARCS rows at most
    even = max(SEGMENT_ROWS, sum(n for _, n in arcs) // ARCS)
    cut = spark.createDataFrame([(a, 1 + n // even) for a, n in arcs], "__arc int, __parts long")
    rows = rows.join(F.broadcast(cut), "__arc").withColumn("__part", F.pmod("__row", F.col("__parts")).cast("int")).drop("__parts")
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("__arc", "__part").count().collect()}
    ranges = walk(counts, ring(n_shards), n_shards)
    schema = "__arc int, __part int, __lo long, __hi long, __shard int, __slot long"
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__arc", "__part").orderBy("__h", "__row")).cast("long") - 1)
    given = F.broadcast(spark.createDataFrame(ranges, schema))  # a range per segment, and one more for each shard that fills up
    found = ranked.join(given, ["__arc", "__part"]).filter("__rank >= __lo AND __rank < __hi")
    slot = F.col("__slot") + F.col("__rank") - F.col("__lo")
    return found.select(*kept, F.col("__shard").alias("shard"), slot.alias("slot"))


def query(spark, sf_dir: str, n_shards: int = 40) -> DataFrame:
    """All documents by the ``rows`` law, whose groups (equal texts) play no part: they are dealt like other rows."""
    text = text_of()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    return shard_rows(docs, "doc_id", n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
