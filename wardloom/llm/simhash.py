"""Document fingerprints: SimHash over a text's distinct words, and a block-table search.

Each distinct word hashes to 128 bits and votes on every bit, up or down, with
its length as the weight; the signs of the sums are the fingerprint.  Two votes
share a long, so 64 sums do for 128 bits and stay in generated code.  A replaced
word changes two votes here, but ten among five-word shingles.

The search finds all fingerprints within a Hamming radius of 17: of six blocks
of 21 or 22 bits at least one differs in two bits or fewer then, so the index
has a table for each block and a query asks each for all keys at most two bits
from its own.  A pair is reported only by the first block that is so near.
Equal fingerprints are one entry with a count, so copies are never expanded.

Defined results: null text is empty; an empty text has no words and the
fingerprint 0; a text of any length is split into words whole, and votes word by
word in a spilling aggregate; repeated rows are separate documents next to each
other; ids must be whole numbers or texts of such (they are cast to long); a null
id comes last in descending order; an empty table gives no rows; only doc_id and
text are read, so other columns can't clash and don't come along.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.llm.common import ascii_lower, let, stored, table, text_of, words_of

BITS = 128
BLOCKS = (22, 21, 21)  # bits of the blocks of each of the two words
RADIUS = 17
FLIPS = 2
#: Bytes of text for a task; ids in a range, and ranges at most (their bounds are literals of the plan).
TASK_BYTES = 32 << 20
RANGE_ROWS, MAX_RANGES = 50_000, 8192
_NO_ID = -(1 << 63)
_LOW = (1 << 32) - 1


def weighted_terms(text: Column) -> Column:
    """array<struct<h, w>>: hash and weight (characters) of each distinct word."""
    words = F.array_distinct(words_of(ascii_lower(text)))
    return F.transform(words, lambda s: F.struct(F.xxhash64(s).alias("h"), F.length(s).cast("long").alias("w")))


def fingerprints(terms: DataFrame, keys: list[str], term: str = "term") -> DataFrame:
    """hi and lo (64 bits each) for each ``keys``; ``terms`` has one row per key and term (null: none).

    Sum j holds the up-votes of bit j and, 32 bits higher, of bit j + 32.
    """
    votes = {"h0": F.col(f"{term}.h"), "h1": F.xxhash64(F.col(f"{term}.h"), F.lit(1)), "w": F.col(f"{term}.w")}
    rows = terms.select(*keys, *(c.alias(n) for n, c in votes.items()))
    pair = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftright(h, j).bitwiseAND(pair) * F.col("w")).alias(f"{h}_{j}") for h in ("h0", "h1") for j in range(32)]
    summed = rows.groupBy(*keys).agg(F.sum("w").alias("all"), *sums)

    def word(h: str) -> Column:
        bits = F.lit(0).cast("long")
        for j in range(32):
            low = F.col(f"{h}_{j}").bitwiseAND(F.lit(_LOW)) * 2 > F.col("all")
            high = F.shiftrightunsigned(f"{h}_{j}", 32) * 2 > F.col("all")
            for up, at in ((low, j), (high, j + 32)):
                value = (1 << at) - (1 << 64 if at == 63 else 0)
                bits = bits.bitwiseOR(F.when(up, F.lit(value)).otherwise(F.lit(0)).cast("long"))
        return bits

    return summed.select(*keys, word("h0").alias("hi"), word("h1").alias("lo"))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def _blocks(hi: str, lo: str) -> list[Column]:
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    return [F.shiftright(c, at).bitwiseAND(F.lit((1 << n) - 1)).cast("int") for c in (hi, lo) for at, n in zip(starts, BLOCKS, strict=True)]


def _key(block: Column, table: int) -> Column:
    return block.bitwiseOR(F.lit(table << max(BLOCKS)))


def _masks(bits: int) -> list[int]:
    """All numbers of so many bits with at most FLIPS ones."""
    return [sum(1 << i for i in ones) for k in range(FLIPS + 1) for ones in combinations(range(bits), k)]


def within_radius(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs (q_hi, q_lo, hi, lo, distance) of distinct fingerprints at most RADIUS apart.

    Both inputs hold distinct fingerprints (hi, lo).
    """
    assert sum(BLOCKS) * 2 == BITS and 2 * len(BLOCKS) * (FLIPS + 1) > RADIUS
    q_blocks, blocks = _blocks("q_hi", "q_lo"), _blocks("hi", "lo")
    around = lambda key, masks: F.transform(masks, lambda m: key.bitwiseXOR(m))
    asked = [around(_key(b, t), F.lit(_masks(n))) for t, (b, n) in enumerate(zip(q_blocks, BLOCKS * 2, strict=True))]
    q = queries.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"))
    q = q.select("q_hi", "q_lo", F.explode(F.flatten(F.array(*asked))).alias("q_key"))
    right = index.select("hi", "lo", F.explode(F.array(*(_key(b, t) for t, b in enumerate(blocks)))).alias("key"))
    first = F.when(F.lit(False), F.lit(-1))
    for t, (x, y) in enumerate(zip(q_blocks, blocks, strict=True)):
        first = first.when(F.bit_count(x.bitwiseXOR(y)) <= FLIPS, F.lit(t))
    d = distance(("q_hi", "q_lo"), ("hi", "lo"))
    pairs = q.join(right, (F.col("q_key") == F.col("key")) & (d <= RADIUS) & (first == F.shiftright("key", max(BLOCKS))))
    return pairs.select("q_hi", "q_lo", "hi", "lo", d.alias("distance"))


def _bucket(bounds: list[int]) -> Column:
    """How many of the ascending bounds lie above ``__id``: first by groups of them, then inside a group."""
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    longs = lambda x: F.array(*(F.lit(b).cast("long") for b in x)).cast("array<long>")
    above = lambda x: F.size(F.filter(x, lambda b: b > F.col("__id")))
    if not bounds:
        return F.lit(0)
    tops = longs([g[-1] for g in groups])
    whole = F.size(tops) - above(tops)  # groups that lie wholly at or below the id
    inside = above(F.coalesce(F.get(F.array(*(longs(g) for g in groups)), whole), longs([])))
    later = F.greatest(F.lit(0), F.lit(len(groups) - 1) - whole)
    rest = F.when(later == 0, F.lit(0)).otherwise(F.lit(len(groups[-1])) + (later - 1) * width)
    return (inside + rest).cast("int")


def next_keys(keys: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct (__id, __h, n) with ``next``: the key after it in descending order (after the last: the first).

    Keys fall into ranges of about equal count; the first key of each range,
    which follows the last one of the range before, is found by an aggregate.
    """
    parts = parts or max(1, min(MAX_RANGES, math.ceil(keys.count() / RANGE_ROWS)))
    at = [i / parts for i in range(1, parts)]
    bounds = sorted(set(keys.agg(F.percentile_approx("__id", at, max(10_000, 10 * parts))).first()[0] or [])) if at else []
    rows = keys.withColumn("bucket", _bucket(bounds))  # 0 holds the largest ids
    tops = sorted(rows.groupBy("bucket").agg(F.max(F.struct("__id", "__h")).alias("m")).collect())  # a row per range
    after = [(b, tuple(tops[(i + 1) % len(tops)]["m"])) for i, (b, _) in enumerate(tops)]
    known = keys.sparkSession.createDataFrame(after, "bucket int, __after struct<__id:bigint,__h:bigint>")
    order = Window.partitionBy("bucket").orderBy(F.desc("__id"), F.desc("__h"))
    rows = rows.withColumn("next", F.lead(F.struct("__id", "__h")).over(order)).join(F.broadcast(known), "bucket")
    return rows.select("__id", "__h", "n", F.coalesce("next", "__after").alias("next"))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each row with as much of the next one's text, in descending id order, as a third of its own.

    Returns __id, __h (hash of the text), nth (from 1, among rows alike), doc_id,
    text, next (key of the next row) and following.  Texts are dealt by key
    once; of the next text only the part that is wanted moves.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumns(
        {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "__h": F.xxhash64("text")}
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    keys = stored(rows.select("__id", "__h", F.length("text").alias("n")).distinct(), "document-keys")
    pairs = next_keys(keys, parts)
    alike = Window.partitionBy("__id", "__h").orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = rows.repartition(n, "__id", "__h").withColumn("nth", F.count("*").over(alike))
    wanted = pairs.select("next.*", F.struct("__id", "__h").alias("asks"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    first = dealt.filter("nth = 1").join(wanted, ["__id", "__h"])
    heads = first.select("asks.*", F.col("doc_id").alias("next_doc_id"), F.substring("text", F.lit(1), F.col("k")).alias("head"))
    both = dealt.join(pairs.select("__id", "__h", "next"), ["__id", "__h"]).join(heads, ["__id", "__h"])
    again = F.col("nth") > 1  # a row like the one before, which is its next
    return both.select(
        "__id",
        "__h",
        "nth",
        "doc_id",
        "text",
        F.when(again, F.struct("__id", "__h")).otherwise(F.col("next")).alias("next"),
        F.when(again, F.col("doc_id")).otherwise(F.col("next_doc_id")).alias("next_doc_id"),
        F.when(again, F.col("text")).otherwise(F.col("head")).alias("following"),
    )


def edited(text: Column, following: Column) -> Column:
    """The last third (rounded down) of the text's code points replaced by the next text's first as many."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(following, F.lit(1), k))


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and of the next document's text."""
    near = with_next(docs, parts).withColumn("edited", edited(F.col("text"), F.col("following")))
    keys = ["__id", "__h", "nth", "next", "doc_id", "next_doc_id", "n_chars", "edited_sha256"]
    texts = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in enumerate(("text", "edited"))))
    both = near.select(
        "__id", "__h", "nth", "next", "doc_id", "next_doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.explode(texts).alias("t"),
    )
    terms = both.select(*keys, "t.kind", F.explode_outer(weighted_terms(F.col("t.text"))).alias("term"))
    prints = fingerprints(terms, [*keys, "kind"])
    pick = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = prints.groupBy(*keys).agg(*(pick(c, k).alias(f"{p}{c}") for k, p in ((0, ""), (1, "e_")) for c in ("hi", "lo")))
    wide = stored(wide, "fingerprints")
    following = wide.filter("nth = 1").select(F.struct("__id", "__h").alias("next"), F.col("hi").alias("n_hi"), F.col("lo").alias("n_lo"))
    return wide.join(following, "next").drop("__id", "__h", "nth", "next")


def _hex(hi: str, lo: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (hi, lo))))


def query(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents; ids divisible by 50 also ask the block tables how many lie within RADIUS."""
    docs = fingerprint_documents(table(spark, sf_dir, "documents"))
    asks = F.coalesce(F.pmod("doc_id", F.lit(50)) == 0, F.lit(False))
    alike = docs.groupBy("hi", "lo").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.max(asks).alias("asks"))
    classes = stored(alike, "fingerprint-classes")
    met = within_radius(classes.filter("asks"), classes.select("hi", "lo"))
    around = (
        met.join(classes.select("hi", "lo", "copies"), ["hi", "lo"])
        .groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo"))
        .agg(F.sum("copies").alias("around"))
    )
    known = classes.select("hi", "lo", "class_id").join(around, ["hi", "lo"], "left")
    return docs.join(known, ["hi", "lo"]).select(
        "doc_id", "n_chars", "edited_sha256", _hex("hi", "lo").alias("fingerprint"), _hex("e_hi", "e_lo").alias("edited_fingerprint"),
        likeness(("hi", "lo"), ("e_hi", "e_lo")).alias("near_edited"), likeness(("hi", "lo"), ("n_hi", "n_lo")).alias("near_next"),
        "class_id", F.when(asks, F.col("around") - 1).alias("n_within"),
    )
