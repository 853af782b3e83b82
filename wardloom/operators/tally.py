"""Tallies: marks that count once per voter, and the text messages that carry them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.operators.ranking import numbered

VOTER = ("candidate", "ward", "serial")
# Fixed values of the message format.
PREFIX, MAX_CHARS, SUM_CHARS = "PT1", 160, 4
ID = "^[A-Za-z0-9_-]{1,16}$"


def first_marks(marks: DataFrame, keys: tuple[str, ...] = VOTER, order: str = "seq") -> DataFrame:
    """The first mark of each voter; later ones never replace it."""
    fields = [c for c in marks.columns if c not in keys]
    first = marks.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.col(order)).alias("m"))
    return first.select(*keys, *(F.col(f"m.{c}").alias(c) for c in fields))


def merge_marks(*parts: DataFrame) -> DataFrame:
    """Union of mark sets; order and repeats don't matter."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return first_marks(whole)


def ward_counts(marks: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Voters marked per candidate and ward, and per candidate (ward null), but those in ``skip``."""
    rows = marks.select(*VOTER).distinct()
    if skip is not None:
        rows = rows.join(skip.select("ward", "serial").distinct(), ["ward", "serial"], "left_anti")
    return rows.rollup("candidate", "ward").agg(F.count("serial").alias("voters")).filter("candidate IS NOT NULL")


def worker_counts(marks: DataFrame, roll: DataFrame) -> DataFrame:
    """Live voters that each worker marked first, per ward."""
    live = roll.filter(~F.col("struck")).select("ward", "serial")
    return first_marks(marks).join(live, ["ward", "serial"], "left_semi").groupBy("candidate", "ward", "worker").agg(F.count("*").alias("voters"))


def in_roll(marks: DataFrame, roll: DataFrame) -> DataFrame:
    """``marks`` with ``inside``: whether the live roll has that voter."""
    live = roll.filter(~F.col("struck")).select("ward", "serial").distinct().withColumn("inside", F.lit(True))
    return marks.join(live, ["ward", "serial"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def union_tally(applied: DataFrame, incoming: DataFrame) -> DataFrame:
    """Every serial once, 'applied', 'duplicate' (applied and sent again) or 'new'."""
    keys = list(VOTER)
    old = applied.select(*keys).distinct().withColumn("old", F.lit(True))
    new = incoming.select(*keys).distinct().withColumn("sent", F.lit(True))
    both = old.join(new, keys, "full_outer")
    return both.select(*keys, F.when(F.col("old").isNull(), "new").when(F.col("sent").isNotNull(), "duplicate").otherwise("applied").alias("state"))


def checksum(body: Column) -> Column:
    return F.substring(F.sha2(F.encode(body, "UTF-8"), 256), 1, SUM_CHARS)


#: Serials of a worker in a ward that are packed as one array; more are packed by ranges of so many.
SPAN = 20_000
SAFE = (1 << 53) - 1
_SENDER = ["candidate", "worker", "ward"]


def _checked(marks: DataFrame) -> DataFrame:
    """Distinct (candidate, worker, ward, serial, header, room); what decoding would reject raises."""
    header = F.concat_ws(" ", F.lit(PREFIX), "candidate", "worker")
    rows = marks.select(*_SENDER, "serial").distinct().withColumn("header", header)
    rows = rows.withColumn("room", F.lit(MAX_CHARS - 2 - SUM_CHARS) - F.length("header"))
    fine = {
        "invalid team": F.col("candidate").rlike(ID),
        "invalid worker": F.col("worker").rlike(ID),
        "invalid serial": F.col("serial").between(1, SAFE),
        "no room for a serial": F.length(_token(F.col("serial"))) <= F.col("room"),
    }
    wrong = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), None).otherwise(F.lit(w)) for w, c in fine.items()))
    return rows.filter(F.when(wrong.isNull(), True).otherwise(F.raise_error(wrong).cast("boolean")))


def _token(serial: Column) -> Column:
    return F.lower(F.conv(serial.cast("string"), 10, 36))


def _packed_at_once(rows: DataFrame) -> DataFrame:
    """(sender, header, part, tokens) of senders whose serials fit in one array."""
    each = rows.groupBy(*_SENDER, "header", "room").agg(F.sort_array(F.collect_set("serial")).alias("serials"))
    start = F.struct(F.array().cast("array<string>").alias("full"), F.lit("").alias("open"))

    def add(acc: Column, serial: Column) -> Column:
        token = _token(serial)
        longer = F.when(acc["open"] == "", token).otherwise(F.concat(acc["open"], F.lit("."), token))
        fits = F.length(longer) <= F.col("room")
        full = F.when(fits, acc["full"]).otherwise(F.concat(acc["full"], F.array(acc["open"])))
        return F.struct(full.alias("full"), F.when(fits, longer).otherwise(token).alias("open"))

    packed = F.aggregate("serials", start, add, lambda acc: F.concat(acc["full"], F.array(acc["open"])))
    return each.select(*_SENDER, "header", F.posexplode(packed).alias("part", "tokens"))


def _nexts(sizes: np.ndarray, room: int) -> np.ndarray:
    """For each token the place of the first one that no longer fits into a message which starts with it."""
    upto = np.cumsum(sizes + 1)
    return np.searchsorted(upto, upto - sizes + room, side="right")


def _packed_by_ranges(rows: DataFrame, span: int) -> DataFrame:
    """The same for senders with any number of serials, which no task holds together.

    Serials are numbered and cut into ranges of ``span``, each with the tokens
    of the next one that a message may reach.  A range's pointers, from each
    token to the start of the next message, say where a message that starts at
    any of its first tokens leads into the next range, and after how many
    messages.  Chaining those, a few per range, gives each range its real first
    start; then every range writes its own messages.
    """
    reach = MAX_CHARS // 2 + 1  # tokens of a message, at most; so are the places where a range may be entered
    span = max(span, reach)
    placed = numbered(rows.withColumn("token", _token(F.col("serial"))), _SENDER, "serial", "n").withColumn("n", (F.col("n") - 1).cast("long"))
    own = F.floor(F.col("n") / span).cast("long")
    ranges = F.when((F.col("n") % span < reach) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = placed.select(*_SENDER, "header", "room", "n", "token", F.explode(ranges).alias("range"))
    sender = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in _SENDER)

    def tokens_of(table: pa.Table) -> tuple[int, pa.Table, list[str], np.ndarray]:
        table = table.sort_by("n")
        tokens = table.column("token").to_pylist()
        size = int(np.sum(table.column("n").to_numpy() < (table.column("range")[0].as_py() + 1) * span))
        return size, table, tokens, _nexts(np.array([len(t) for t in tokens]), table.column("room")[0].as_py())

    def through(table: pa.Table) -> pa.Table:
        """(enter, leave, messages): for each place where a message may start, the place it leads to in the next range."""
        size, table, _, nexts = tokens_of(table)
        leave, messages = list(range(len(nexts) + 1)), [0] * (len(nexts) + 1)
        for i in range(size - 1, -1, -1):
            leave[i], messages[i] = leave[nexts[i]], messages[nexts[i]] + 1
        k = min(reach, size)
        head = {c: table.column(c).slice(0, 1).take(pa.array([0] * k, pa.int64())) for c in [*_SENDER, "range"]}
        return pa.table({**head, "enter": pa.array(range(k), pa.int64()), "leave": pa.array([x - size for x in leave[:k]], pa.int64()), "messages": pa.array(messages[:k], pa.int64())})

    def chain(table: pa.Table) -> pa.Table:
        """(range, enter, part): where each range's first message starts, and its number."""
        by_range: dict[int, dict[int, tuple[int, int]]] = {}
        for r, e, x, m in zip(*(table.column(c).to_pylist() for c in ("range", "enter", "leave", "messages")), strict=True):
            by_range.setdefault(r, {})[e] = (x, m)
        enter, part, out = 0, 0, []
        for r in sorted(by_range):
            out.append((r, enter, part))
            if enter in by_range[r]:
                leave, n = by_range[r][enter]
                enter, part = leave, part + n
            else:
                enter -= len(by_range[r])  # a message began before this short last range and covers it
        head = {c: table.column(c).slice(0, 1).take(pa.array([0] * len(out), pa.int64())) for c in _SENDER}
        return pa.table({**head, **{c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(("range", "enter", "part"))}})

    def write(table: pa.Table) -> pa.Table:
        size, table, tokens, nexts = tokens_of(table)
        i, part, out = table.column("enter")[0].as_py(), table.column("part")[0].as_py(), []
        while i < size:
            out.append((part, ".".join(tokens[i : nexts[i]])))
            i, part = int(nexts[i]), part + 1
        head = {c: table.column(c).slice(0, 1).take(pa.array([0] * len(out), pa.int64())) for c in [*_SENDER, "header"]}
        return pa.table({**head, "part": pa.array([p for p, _ in out], pa.int32()), "tokens": pa.array([t for _, t in out], pa.string())})

    ways = dealt.groupBy(*_SENDER, "range").applyInArrow(through, f"{sender}, range long, enter long, leave long, messages long")
    starts = ways.groupBy(*_SENDER).applyInArrow(chain, f"{sender}, range long, enter long, part long")
    whole = dealt.join(starts, [*_SENDER, "range"])
    return whole.groupBy(*_SENDER, "range").applyInArrow(write, f"{sender}, header string, part int, tokens string")


def encode_messages(marks: DataFrame, span: int = SPAN) -> DataFrame:
    """(candidate, worker, ward, part, text): sorted distinct serials packed greedily into messages.

    Ids and serials that decoding rejects raise.
    """
    rows = _checked(marks)
    many = rows.groupBy(*_SENDER).agg(F.count("*").alias("__n")).filter(F.col("__n") > span).select(*_SENDER)
    few = _packed_at_once(rows.join(many, _SENDER, "left_anti"))
    parts = few.unionByName(_packed_by_ranges(rows.join(many, _SENDER, "left_semi"), span))
    body = F.concat_ws(" ", "header", "tokens")
    return parts.select("candidate", "worker", "ward", "part", F.concat_ws(" ", body, checksum(body)).alias("text"))


def decode_messages(sms: DataFrame, team: str = "candidate") -> DataFrame:
    """``sms`` with reason (null if fine), worker and serials (null if not)."""
    t = F.split(F.regexp_replace("text", "^\\s+|\\s+$", ""), "\\s+")
    part = lambda i: F.get(t, i)
    parts = F.split(F.lower(part(3)), "\\.", -1)
    body = F.concat_ws(" ", F.lit(PREFIX), part(1), part(2), part(3))
    serials = F.transform(parts, lambda p: F.conv(p, 36, 10).try_cast("bigint"))
    shape = part(1).rlike(ID) & part(2).rlike(ID) & F.forall(parts, lambda p: p.rlike("^[0-9a-z]+$"))
    sound = F.forall(serials, lambda n: F.coalesce((n >= 1) & (n <= (1 << 53) - 1), F.lit(False)))
    reason = (
        F.when(F.coalesce(part(0) != PREFIX, F.lit(True)), "prefix")
        .when(F.size(t) != 5, "format")
        .when(~shape, "format")
        .when(F.lower(part(4)) != checksum(body), "checksum")
        .when(part(1) != F.col(team), "team")
        .when(~sound, "format")
    )
    rows = sms.withColumn("reason", reason)
    fine = F.col("reason").isNull()
    return rows.withColumns({"sender": F.when(fine, part(2)), "serials": F.when(fine, serials)})


def turnout_beside_counts(counts: DataFrame, official: DataFrame) -> DataFrame:
    """Official figure and each team's count (candidate, ward, voters) per ward; an absent side is null."""
    return counts.join(official, "ward", "full_outer").select("candidate", "ward", "voters", "official")


def sorted_marks(marks: DataFrame) -> DataFrame:
    return first_marks(marks).orderBy("candidate", "ward", "serial")


def numbered_batches(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Rows numbered into batches of ``size`` per key."""
    return numbered(df, keys, order, "__at").withColumn("batch", F.floor((F.col("__at") - 1) / size)).drop("__at")
