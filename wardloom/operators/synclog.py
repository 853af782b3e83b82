"""The sync log: validity, latest per id, sequence numbers, pages, dumps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions import text as X
from wardloom.operators.ranking import numbered, with_previous

ID = ("candidate", "id")
SAFE = (1 << 53) - 1
_DATE = "^[+-]?[0-9]{4,6}-[0-9]{2}"


def updated_ms(c: Column) -> Column:
    """Milliseconds since 1970 of a text that is a number (milliseconds already) or a time; else null."""
    number = F.when(c.rlike("^[0-9]+(\\.[0-9]+)?$"), c).try_cast("double").cast("bigint")
    at = F.try_to_timestamp(c)
    return F.coalesce(number, F.unix_millis(at))


def time_number(c: Column) -> Column:
    """The number that a VARIANT time is, else null."""
    number = F.try_variant_get(c, "$", "double")
    kind = F.schema_of_variant(c)
    usable = ~kind.isin("STRING", "BOOLEAN", "VOID") & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(usable, number)


def time_text(c: Column) -> Column:
    """The text that a VARIANT time is, else null."""
    return F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))


def _ms(number: Column, text: Column) -> Column:
    at = F.unix_millis(F.try_to_timestamp(F.when(text.rlike(_DATE), text)))
    return F.coalesce(number, at.cast("double"))


def time_ms(c: Column) -> Column:
    """Milliseconds since 1970 of a VARIANT time: a number is that already, a text is a date and time."""
    return _ms(time_number(c), time_text(c))


def valid_time(time: str = "updated_at") -> Column:
    """Whether a VARIANT time can be compared with every other: a finite number, or a text that is a date."""
    return time_ms(F.col(time)).isNotNull()


def is_newer(a: Column, b: Column) -> Column:
    """Whether time ``a`` is strictly later than ``b``; both are VARIANTs, numbers or texts as sent.

    Two numbers compare as numbers and two texts as texts; a number and a text
    compare in milliseconds.  What is no time is never newer.  Over mixed types
    this has circles, so it gives no maximum: fold in order of arrival.
    """
    numbers = time_number(a).isNotNull() & time_number(b).isNotNull()
    texts = time_text(a).isNotNull() & time_text(b).isNotNull()
    later = F.when(numbers, time_number(a) > time_number(b)).when(texts, time_text(a) > time_text(b)).otherwise(time_ms(a) > time_ms(b))
    return F.coalesce(later, F.lit(False))


def newer_time(a: tuple, b: tuple) -> bool:
    """``is_newer`` of (number, text, ms) triples, as ``typed_time`` gives them."""
    if a[0] is not None and b[0] is not None:
        return a[0] > b[0]
    if a[1] is not None and b[1] is not None:
        return a[1].encode() > b[1].encode()
    return a[2] > b[2]


def typed_time(df: DataFrame, time: str = "updated_at") -> DataFrame:
    """``df`` with the VARIANT time as number, time (the text) and ms, each worked out once a row: explodes keep them from what uses them."""
    c = F.col(time)
    typed = df.select("*", F.explode(F.array(F.struct(time_number(c).alias("number"), time_text(c).alias("time")))).alias("__typed"))
    number, text = F.col("__typed.number"), F.col("__typed.time")
    return typed.select(*df.columns, number, text, F.explode(F.array(_ms(number, text))).alias("ms"))


def untyped_time(df: DataFrame, time: str = "updated_at") -> DataFrame:
    """The reverse of ``typed_time``, for rows that have lost the VARIANT: numbers come back as doubles."""
    c = F.when(F.col("number").isNotNull(), F.col("number").cast("variant")).otherwise(F.col("time").cast("variant"))
    return df.withColumn(time, c).drop("number", "time", "ms")


def valid_record() -> Column:
    """A candidate, an id of 1 to 200 characters, a time, and a sealed payload (ciphertext and iv) that isn't empty."""
    full = lambda c: F.length(c) > 0
    sound = full("candidate") & F.length("id").between(1, 200) & F.col("updated_at").isNotNull() & full("ciphertext") & full("iv")
    return F.coalesce(sound, F.lit(False))


#: The fields of a record's JSON document.
_FIELDS = ("wardId", "serial", "workerId", "markedAt", "consentAt", "phone", "revoked")


def _payload(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` with the fields of its JSON ``data``: text fields null unless they are texts, serial unless it is a safe whole number.

    Only rows whose id begins as ``prefix`` says are kept, before anything is
    parsed.  A document is parsed and taken apart once, and so is each field:
    what stands under an explode isn't put again into each place that uses it,
    above all not into each condition of a filter.
    """
    own = df.filter(F.col("id").startswith(f"{prefix}:"))
    kinds = ", ".join(f"{name}: variant" for name in _FIELDS)
    parted = own.select("*", F.explode(F.array(F.try_variant_get(F.try_parse_json("data"), "$", f"struct<{kinds}>"))).alias("__doc"))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(f"__doc.{name}", "$", kind)

    def of_kind(name: str) -> Column:
        return F.schema_of_variant(F.col(f"__doc.{name}"))

    def text(name: str) -> Column:
        return F.when(of_kind(name) == "STRING", field(name, "string"))

    each = F.struct(
        text("wardId").alias("ward"),
        F.when(~of_kind("serial").isin("STRING", "BOOLEAN", "VOID"), field("serial", "decimal(38,6)")).alias("number"),
        text("workerId").alias("worker"),
        text("markedAt").alias("marked_at"),
        text("consentAt").alias("consent_at"),
        text("phone").alias("raw_phone"),
        of_kind("phone").alias("phone_kind"),
        F.coalesce(F.when(of_kind("revoked") == "BOOLEAN", field("revoked", "boolean")), F.lit(False)).alias("revoked"),
    )
    read = parted.select(*df.columns, F.explode(F.array(each)).alias("__each"))
    number = F.col("__each.number")
    serial = F.when((number == F.floor(number)) & number.between(0, SAFE), number.cast("bigint")).alias("serial")
    others = ("worker", "marked_at", "consent_at", "raw_phone", "phone_kind", "revoked")
    return read.select(*df.columns, F.col("__each.ward"), serial, *(F.col(f"__each.{c}") for c in others))


def _agrees(prefix: str) -> Column:
    """The id is the one that the payload's ward and serial make."""
    return F.coalesce(F.col("id") == F.concat(F.lit(f"{prefix}:"), "ward", F.lit(":"), F.col("serial").cast("string")), F.lit(False))


def mark_records(df: DataFrame) -> DataFrame:
    """Well-formed marks among sync records (id, and the opened JSON payload in ``data``), with ward, serial, worker and marked_at."""
    rows = _payload(df, "mark")
    ward = (F.length("ward") > 0) & ~F.col("ward").contains(":")
    sound = ward & F.length("worker").between(1, 100) & (F.length("marked_at") > 0)
    return rows.filter(_agrees("mark") & sound).select(*df.columns, "ward", "serial", "worker", "marked_at")


def contact_records(df: DataFrame) -> DataFrame:
    """Well-formed contacts among sync records, with ward, serial, phone, consent_at and revoked.

    A revoked contact carries neither phone nor time; a number that is none
    drops its record, a missing one doesn't.
    """
    rows = _payload(df, "contact").select("*", F.explode(F.array(X.phone(F.col("raw_phone")))).alias("phone"))
    unset = F.coalesce(F.col("phone_kind") == "VOID", F.lit(True))
    fine = F.col("revoked") | ((F.length("consent_at") > 0) & (unset | F.col("phone").isNotNull()))
    kept = lambda c: F.when(~F.col("revoked"), F.col(c)).alias(c)
    return rows.filter(_agrees("contact") & fine).select(*df.columns, "ward", "serial", kept("phone"), kept("consent_at"), "revoked")


def latest(df: DataFrame, keys: tuple[str, ...] = ID, time: str = "updated_at", order: str = "seq", later_wins: bool = False) -> DataFrame:
    """The newest record per id; of equal times the earlier arrival stands, or the later if asked.

    A partial aggregate, so that an id with many records is reduced before it moves.
    """
    fields = [c for c in df.columns if c not in keys]
    tie = F.col(order) if later_wins else -F.col(order)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(F.col(time), tie)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in fields))


def _fold(keys: list[str], out: list[str]):
    """For rows sorted by key and order: of each key the row that ``newer_time`` keeps, as ``out``, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = best = kept = None
        for batch in batches:
            batch = batch.select(out)
            times = zip(*(batch.column(c).to_pylist() for c in ("number", "time", "ms")), strict=True)
            own = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            for i, (key, time) in enumerate(zip(own, times, strict=True)):
                if key != now:
                    if kept is not None:
                        yield kept
                    now, best, kept = key, time, batch.slice(i, 1)
                elif newer_time(time, best):
                    best, kept = time, batch.slice(i, 1)
        if kept is not None:
            yield kept

    return run


def latest_mixed(df: DataFrame, keys: tuple[str, ...] = ID, time: str = "updated_at", order: str = "seq") -> DataFrame:
    """``latest`` over VARIANT times, which have no order of their own: each id's records are folded in order of arrival.

    Rows without a usable time are dropped.  Where all of an id's times are
    numbers, or all are texts, the fold is a maximum, so a partial aggregate
    reduces the id before it moves, hot or not.  The ids that mix the two are
    streamed in order through the task that they are dealt to, which holds two
    rows at a time.
    """
    typed = typed_time(df, time).filter("ms IS NOT NULL")
    fields = [c for c in df.columns if c not in (*keys, time)]
    whole = F.struct(*fields, "number", F.col("time").alias("time"), "ms")
    pick = lambda by: F.max_by(F.when(F.col(by).isNotNull(), whole), F.when(F.col(by).isNotNull(), F.struct(F.col(by), -F.col(order))))
    each = typed.drop(time).groupBy(*keys).agg(pick("number").alias("n"), pick("time").alias("t"))
    mixed = each.filter("n IS NOT NULL AND t IS NOT NULL").select(*keys)
    plain = each.filter("n IS NULL OR t IS NULL").select(*keys, F.coalesce("n", "t").alias("r")).select(*keys, "r.*")
    again = typed.drop(time).join(mixed, list(keys), "left_semi").select(*plain.columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in again.schema)
    # A window's plan demands whole ids in order.  After a repartition and a sort nothing does: Spark takes the
    # repartition for the join's own and may then turn that into a broadcast join, whose tasks hold parts of ids.
    in_order = again.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    folded = in_order.mapInArrow(_fold(list(keys), again.columns), kinds)
    return untyped_time(plain.unionByName(folded), time).select(*df.columns)


def newer_than(incoming: DataFrame, state: DataFrame, pending: DataFrame, time: str = "updated_at") -> DataFrame:
    """Incoming records (latest per id) strictly newer than what is known and what waits to be sent.

    Times are of one ordered type or VARIANTs; ``state`` and ``pending`` may
    hold several rows of an id, of which the latest counts.
    """
    mixed = incoming.schema[time].dataType.simpleString() == "variant"
    newest = (lambda df: latest_mixed(df, time=time)) if mixed else (lambda df: latest(df, time=time))
    later = is_newer if mixed else lambda a, b: a > b
    rows = newest(incoming)
    for name, known in (("__seen", state), ("__waits", pending)):
        rows = rows.join(newest(known.select(*ID, time, "seq")).select(*ID, F.col(time).alias(name)), list(ID), "left")
    newer = lambda c: F.col(c).isNull() | later(F.col(time), F.col(c))
    return rows.filter(newer("__seen") & newer("__waits")).drop("__seen", "__waits")


def after_push(outbox: DataFrame, delivered: DataFrame) -> DataFrame:
    """What stays in the outbox: records that were saved again since they were sent."""
    return outbox.join(delivered, [*ID, "updated_at"], "left_anti")


def assign_sequence(rows: DataFrame, counters: DataFrame, order: str) -> DataFrame:
    """Contiguous numbers per candidate, by a whole-number order column, that go on from its counter.

    ``counters`` has a row per candidate (a team), so it is small enough to broadcast.
    """
    rows = numbered(rows, ["candidate"], order, "__at")
    return rows.join(F.broadcast(counters), "candidate", "left").withColumn("new_seq", F.coalesce("counter", F.lit(0)) + F.col("__at")).drop("counter", "__at")


def merge_counters(a: DataFrame, b: DataFrame) -> DataFrame:
    """The higher mark per candidate."""
    both = a.unionByName(b)
    return both.groupBy("candidate").agg(F.max("counter").alias("counter"))


def gaps(log: DataFrame) -> DataFrame:
    """Places where a candidate's numbers aren't contiguous."""
    return with_previous(log, ["candidate"], "seq").filter("seq - before <> 1").select("candidate", "before", "seq")


def page(log: DataFrame, candidate: str, cursor: int, size: int = 1000) -> DataFrame:
    """The next page after a cursor, with ``more``: whether others follow (one row is read beyond it)."""
    rows = log.filter((F.col("candidate") == candidate) & (F.col("seq") > cursor)).orderBy("seq").limit(size + 1)
    whole = Window.partitionBy("candidate")  # of size + 1 rows at most
    rows = rows.withColumns({"more": F.count("*").over(whole) > size, "__nth": F.row_number().over(whole.orderBy("seq"))})
    return rows.filter(F.col("__nth") <= size).drop("__nth")


def collisions(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("candidate", "seq"), payload: tuple[str, ...] = ("id", "device")) -> DataFrame:
    """Keys that both have with different payloads."""
    both = a.select(*keys, *(F.col(p).alias(f"a_{p}") for p in payload)).join(b.select(*keys, *(F.col(p).alias(f"b_{p}") for p in payload)), list(keys))
    differ = [~F.col(f"a_{p}").eqNullSafe(F.col(f"b_{p}")) for p in payload]
    return both.filter(differ[0] | differ[1] if len(differ) > 1 else differ[0])


# Fixed value: the shapes of a dump's names.
DUMP_NAME = "^c/([^/]+)/(verifier|seq|r/([0-9]+)|m/(.+))$"


def route_dump(dump: DataFrame) -> DataFrame:
    """(name, value) entries to candidate, table, key and reason (null if it is sound)."""
    part = lambda k: F.regexp_extract("name", DUMP_NAME, k)
    kind = F.when(part(2) == "verifier", "verifiers").when(part(2) == "seq", "counters").when(part(3) != "", "records").when(part(4) != "", "marks")
    key = F.when(part(3) != "", part(3)).when(part(4) != "", part(4)).otherwise(part(2))
    reason = (
        F.when(kind.isNull(), "name")
        .when((kind == "counters") & ~F.col("value").rlike("^[0-9]+$"), "counter")
        .when((kind == "records") & F.get_json_object("value", "$.id").isNull(), "record")
    )
    candidate, key = F.nullif(part(1), F.lit("")), F.when(kind.isNotNull(), key)
    return dump.select("name", candidate.alias("candidate"), kind.alias("target"), key.alias("key"), reason.alias("reason"))


def dump_entries(dump: DataFrame, doc: str = "doc") -> DataFrame:
    """(name, value) of a dump document: a list of {name, value}, lists of them wrapped as {results}, or a map."""
    rows = "array<struct<name:string,value:string>>"
    text = F.trim(F.col(doc))
    wrapped = F.flatten(F.transform(F.from_json(doc, f"array<struct<results:{rows}>>"), lambda r: r["results"]))
    pairs = F.map_entries(F.from_json(doc, "map<string,string>"))
    mapped = F.transform(pairs, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    is_wrapped = text.rlike(r'^\[\s*\{\s*"(results|success|meta)"')
    entries = F.when(is_wrapped, wrapped).when(text.startswith("["), F.from_json(doc, rows)).otherwise(mapped)
    return dump.select(F.explode(entries).alias("e")).select("e.name", "e.value")


def explode_json(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """A row per field of a JSON object."""
    return df.select(*keep, F.explode(F.from_json(column, "map<string,string>")).alias("field", "value"))


def explode_array(df: DataFrame, column: str, paths: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """A row per element of a JSON array, numbered from 0 (``nth``), with fields by path: {name: (path, type)}."""
    doc = F.try_parse_json(column)
    each = df.select(*keep, F.posexplode(F.try_variant_get(doc, "$", "array<variant>")).alias("nth", "__e"))
    return each.select(*keep, "nth", *(F.try_variant_get("__e", path, kind).alias(name) for name, (path, kind) in paths.items()))


def team_isolation(log: DataFrame) -> DataFrame:
    """Ids that several candidates use, with how many: each keeps rows of its own."""
    return log.groupBy("id").agg(F.count_distinct("candidate").alias("candidates"), F.count("*").alias("records")).filter("candidates > 1")


def seal(df: DataFrame, column: str, secret: Column, key: Column) -> DataFrame:
    """``df`` with ``sealed``: AES-GCM under a secret, with the record's key as additional data.

    Spark draws a fresh random IV for every value (the empty one given asks for
    that) and writes it in front, so equal values seal differently.
    """
    return df.withColumn("sealed", F.aes_encrypt(F.col(column), secret, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), key))


def unseal(df: DataFrame, secret: Column, key: Column) -> DataFrame:
    """``df`` with ``opened``: null where the secret or the record's key doesn't fit."""
    return df.withColumn("opened", F.try_aes_decrypt("sealed", secret, F.lit("GCM"), F.lit("DEFAULT"), key).cast("string"))
