"""Ward rolls: stored shape, supplement merging, record segmentation, page de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions import text as X


# The tags that a supplement leaves on an entry.
TAGS = ("deletion", "addition")


def minimise(df: DataFrame) -> DataFrame:
    """The stored fields and the supplement's tag alone, coerced: missing text as '', unknown tags as none.

    Rows without a serial, or whose serial isn't whole, are dropped.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = F.col("serial").try_cast("decimal(38,6)")
    tag = F.col("supplement") if "supplement" in df.columns else F.lit(None).cast("string")
    rows = df.withColumns({"serial": F.when(number == F.floor(number), number).try_cast("bigint"), "supplement": F.when(tag.isin(*TAGS), tag)})
    return rows.filter("serial IS NOT NULL").select(
        "ward", "serial", blank("name").alias("name"), blank("relative").alias("relative"), F.col("age").try_cast("int").alias("age"),
        blank("gender").alias("gender"), blank("house").alias("house"), F.coalesce("struck", F.lit(False)).alias("struck"), "supplement",
    )


def apply_supplements(base: DataFrame, supplements: DataFrame, keys: tuple[str, ...] = ("ward", "serial")) -> DataFrame:
    """Rolls after their supplements, in publication order (pub, pos).

    ``base`` has the keys, pos, struck, any other columns, and the tag
    ``supplement`` if it was merged before; the result has the same columns, so
    it can be merged further, and merging in stages equals merging at once.  The
    first record of a serial gives its fields (columns that supplements lack are
    null for added serials), the last one whether it is struck.  The tag is the
    last change of that, 'deletion' or 'addition', else the base's own.  Of a
    base roll's repeats the last stands.
    """
    fields = [c for c in base.columns if c not in (*keys, "struck", "supplement")]
    tag = F.col("supplement") if "supplement" in base.columns else F.lit(None)
    whole = F.struct(*fields, "struck", tag.cast("string").alias("supplement"))
    own = base.groupBy(*keys).agg(F.max_by(whole, "pos").alias("r")).select(*keys, "r.*")
    own = own.withColumn("__at", F.struct(F.lit(0).alias("k"), F.lit(0).alias("pub"), F.col("pos").cast("bigint").alias("pos")))
    later = supplements.withColumns(
        {
            "supplement": F.lit(None).cast("string"),
            "__at": F.struct(F.lit(1).alias("k"), F.col("pub").cast("int").alias("pub"), F.col("pos").cast("bigint").alias("pos")),
        }
    ).drop("pub")
    every = own.unionByName(later, allowMissingColumns=True).select(*keys, *fields, "struck", "supplement", "__at")
    order = Window.partitionBy(*keys).orderBy("__at")
    new = F.row_number().over(order) == 1
    change = F.when(new, F.col("__at.k") == 1).otherwise(F.col("struck") != F.lag("struck").over(order))
    said = F.when(F.col("struck"), "deletion").otherwise("addition")
    merged = every.withColumn("__change", change).groupBy(*keys).agg(
        F.min_by(F.struct(*fields), "__at").alias("f"),
        F.max_by("struck", "__at").alias("struck"),
        F.coalesce(F.max_by(said, F.when(F.col("__change"), F.col("__at"))), F.min_by("supplement", "__at")).alias("supplement"),
    )
    return merged.select(*keys, "f.*", "struck", "supplement")


def hide_deletions(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("supplement", F.lit("")) != "deletion")


def roll_counts(df: DataFrame, *keys: str) -> DataFrame:
    deleted = F.coalesce(F.col("supplement") == "deletion", F.lit(False)) if "supplement" in df.columns else F.lit(False)
    return df.groupBy(*keys).agg(F.count_if(~F.col("struck")).alias("live"), F.count_if("struck").alias("struck"), F.count_if(deleted).alias("deletions"))


def loaded_supplements(files: DataFrame) -> DataFrame:
    """Listed files (ward, pub, ok) up to the first that failed, and whether one failed."""
    failed = files.groupBy("ward").agg(F.min(F.when(~F.col("ok"), F.col("pub"))).alias("__first"))
    rows = files.join(failed, "ward").filter("__first IS NULL OR pub < __first")
    return rows.select("ward", "pub", F.col("__first").isNotNull().alias("failed"))


def supplement_plan(df: DataFrame, merged: str = "merged", listed: str = "listed") -> DataFrame:
    """'current', 'resume' (the merged files begin the list) or 'rebuild' for each row's arrays of files."""
    begins = F.slice(listed, 1, F.size(merged)) == F.col(merged)
    return df.withColumn("plan", F.when(F.col(merged) == F.col(listed), "current").when(begins, "resume").otherwise("rebuild"))


# What a printed roll's lines look like.
EPIC = "^(?:UPY[0-9]+|RJ/[0-9]+/[0-9]+/[0-9]+|[A-Z]{3}[0-9]{6,7})$"
LABELS = {
    "name": "^नाम\\s*:?$",
    "relative": "^(?:पति|पिता|माता|पत्नी|अन्य)\\s+का\\s+नाम\\s*:?$",
    "house": "^मकान\\s+संख्या\\s*:?$",
    "age": "^आयु\\s*:?$",
}
SEX_LABEL = "^लिं?ग\\s*:?$"
GENDERS = ("स्त्री", "पुरूष", "पुरुष", "अन्य")
STRUCK_MARKS = ("O", "E", "S", "R")
NO_PHOTO = ("Photo is", "Available")


def segment_records(lines: DataFrame, same_row: float = 2.0, right: float = 1.0) -> DataFrame:
    """Lines (doc, pos, x, y, serial_font, text) of printed pages to whole records, one per serial line that closes one.

    A name label opens a record (one that is open is dropped), a number in the
    serial's font closes it, a letter in that font on the row of the last serial
    strikes its record off.  A value belongs to the first label (by where that
    kind of label first stands) on its row and left of it; of a label that
    repeats the last one counts.  Name and relative join their values, house,
    age and gender take the last; what has no place goes to ``extra``.

    Returns doc, record (from 1), serial, struck, name, relation, relative, age, gender, house, epic, extra.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("serial_font") & F.col("text").rlike("^[0-9]+$")
    kind = F.when(F.col("text").rlike(LABELS["name"]), "open").when(number, "number")
    rows = lines.withColumn("event", kind)
    rows = rows.withColumn("last_event", F.last("event", ignorenulls=True).over(before))
    rows = rows.withColumn("closes", F.coalesce((F.col("event") == "number") & (F.col("last_event") == "open"), F.lit(False)))
    rows = rows.withColumns(
        {
            "block": F.sum((F.col("event") == "open").cast("int")).over(order),
            "record": F.sum(F.col("closes").cast("int")).over(order),
            "serial_y": F.last(F.when(F.col("closes"), F.col("y")), ignorenulls=True).over(before),
        }
    )
    on_row = F.coalesce(F.abs(F.col("y") - F.col("serial_y")) < same_row, F.lit(False))
    rows = rows.withColumn("marks", F.col("serial_font") & F.col("text").isin(*STRUCK_MARKS) & on_row)
    rows = rows.withColumn("struck", F.max("marks").over(Window.partitionBy("doc", "record")))
    is_open = F.coalesce((F.col("event") == "open") | (F.col("event").isNull() & (F.col("last_event") == "open")), F.lit(False))
    held = F.when(is_open & ~F.col("marks"), F.struct("pos", "x", "y", "text"))
    closer = F.struct("record", F.col("text").cast("decimal(38,0)").cast("bigint").alias("serial"), "struck")
    blocks = rows.filter(is_open | F.col("closes")).groupBy("doc", "block").agg(F.sort_array(F.collect_list(held)).alias("held"), F.max(F.when(F.col("closes"), closer)).alias("end"))
    blocks = blocks.filter("end IS NOT NULL").select("doc", "end.*", "held")

    def matching(pattern: str) -> Column:
        return F.filter("held", lambda ln: ln["text"].rlike(pattern))

    found = {k: matching(p) for k, p in LABELS.items()}
    label = lambda k: F.when(F.size(found[k]) > 0, F.struct(F.get(found[k], F.lit(0))["pos"].alias("first"), F.lit(k).alias("key"), F.element_at(found[k], -1).alias("at")))
    blocks = blocks.withColumn("labels", F.sort_array(F.array_compact(F.array(*(label(k) for k in LABELS)))))
    is_label = lambda ln: F.exists("labels", lambda lab: lab["at"]["pos"] == ln["pos"])
    skipped = lambda ln: ln["text"].isin(*NO_PHOTO) | ln["text"].rlike(SEX_LABEL)
    rest = F.filter("held", lambda ln: ~is_label(ln) & ~skipped(ln))
    beside = lambda ln: F.filter("labels", lambda lab: (F.abs(ln["y"] - lab["at"]["y"]) < same_row) & (ln["x"] > lab["at"]["x"] + right))

    def place(ln: Column) -> Column:
        key = F.get(beside(ln), F.lit(0))["key"]
        digits = ln["text"].rlike("^[0-9]+$")
        of_age = F.when(digits, "age").when(ln["text"].isin(*GENDERS), "gender").otherwise("extra")
        return F.when(ln["text"].rlike(EPIC), "epic").when(key == "age", of_age).otherwise(F.coalesce(key, F.lit("extra")))

    blocks = blocks.withColumn("values", F.transform(rest, lambda ln: F.struct(place(ln).alias("key"), ln["text"].alias("text"))))
    texts = lambda k: F.transform(F.filter("values", lambda v: v["key"] == k), lambda v: v["text"])
    joined = lambda k: F.when(F.size(texts(k)) > 0, F.array_join(texts(k), " "))
    last = lambda k: F.when(F.size(texts(k)) > 0, F.element_at(texts(k), -1))
    relation = F.when(F.size(found["relative"]) > 0, F.get(F.split(F.element_at(found["relative"], -1)["text"], "\\s+"), F.lit(0)))
    out = blocks.select(
        "doc", "record", "serial", "struck", joined("name").alias("name"), relation.alias("relation"), joined("relative").alias("relative"),
        last("age").try_cast("int").alias("age"), last("gender").alias("gender"), last("house").alias("house"), last("epic").alias("epic"), texts("extra").alias("extra"),
    )
    return out.withColumns({c: X.nfc(F.col(c)) for c in ("name", "relation", "relative", "gender", "house")})


def struck_marks(lines: DataFrame, same_row: float = 2.0) -> DataFrame:
    """Serial lines (doc, pos) that a mark strikes off: the mark follows, on the serial's row.

    ``lines``: doc, pos, y, is_serial, is_mark.
    """
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("is_serial"), F.struct("pos", "y")), ignorenulls=True).over(before)
    marks = lines.withColumn("serial", last).filter(F.col("is_mark") & (F.abs(F.col("serial.y") - F.col("y")) < same_row))
    return marks.select("doc", F.col("serial.pos").alias("pos")).distinct()


def page_dedupe(entries: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """One record per key: the first in page order, struck if any repeat is."""
    at = F.struct(*order)
    return entries.groupBy(key).agg(*(F.min_by(f, at).alias(f) for f in fields), F.bool_or("struck").alias("struck"), F.count("*").alias("records"))


def cover_names(lines: DataFrame, label: str, same_row: float = 2.0) -> DataFrame:
    """Per document, the words right of the first label on its row, by x."""
    first = lines.filter(F.col("text").rlike(label)).groupBy("doc").agg(F.min_by(F.struct("pos", "x", "y"), "pos").alias("l"))
    near = lines.join(first, "doc").filter((F.col("pos") != F.col("l.pos")) & (F.abs(F.col("y") - F.col("l.y")) < same_row) & (F.col("x") > F.col("l.x")))
    words = near.select("doc", "x", "pos", F.regexp_replace("text", "^:\\s*", "").alias("text")).filter("text <> ''")
    inside = F.transform(F.sort_array(F.collect_list(F.struct("x", "pos", "text"))), lambda w: w["text"])
    return words.groupBy("doc").agg(X.squeeze(F.array_join(inside, " ")).alias("name"))


# What a name on a cover looks like, and the labels beside it.
COVER_NAME = "^[ऀ-ॿ॰]+(?:[ -][ऀ-ॿ॰]+)*$"
SAMITI_LABEL = "^पंचायत\\s*समिति\\s*का\\s*नाम\\s*:\\s*(.+)$"
ZILLA_LABEL = "^जिलापरिषद\\s*का\\s*नाम\\s*:\\s*(.+?)\\s*जि॰\\s*प॰"
DISTRICT_LABEL = "^जिला\\s*:?$"


def cover_readings(lines: DataFrame) -> DataFrame:
    """doc, district and samiti of every document's cover lines (doc, pos, x, y, text); null where unreadable.

    The samiti stands after its label in one line; the district on the row of
    its label, else after the label of its council.
    """
    clean = lambda c: F.when(X.squeeze(c).rlike(COVER_NAME), X.squeeze(c))
    label = lambda p: F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 1))
    first = lambda p: F.min_by(clean(label(p)), F.when(F.col("text").rlike(p), F.col("pos")))
    inline = lines.groupBy("doc").agg(first(SAMITI_LABEL).alias("samiti"), first(ZILLA_LABEL).alias("council"))
    beside = cover_names(lines, DISTRICT_LABEL).select("doc", clean(F.col("name")).alias("district"))
    return inline.join(beside, "doc", "left").select("doc", F.coalesce("district", "council").alias("district"), "samiti")


# Fixed value: a voter card's fields, in order.
CARD = ("name", "relation", "age", "gender", "house", "epic", "serial", "ward", "booth_name", "booth_address")
MISSING = "—"


def card_text(c: Column) -> Column:
    """A value as a card shows it: blank or missing ones as a dash."""
    return F.coalesce(F.nullif(X.strip_white(c.cast("string")), F.lit("")), F.lit(MISSING))


def voter_card(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ten fields of a voter's card; how they are related and to whom share one; columns that ``df`` lacks show a dash."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    shown = lambda c: F.nullif(X.strip_white(has(c).cast("string")), F.lit(""))
    relation = F.concat_ws(" ", shown("relation"), shown("relative"))
    return df.select(*keep, *(card_text(relation if f == "relation" else has(f)).alias(f) for f in CARD))


def share_text(card: DataFrame, labels: dict[str, str], footer: tuple[str, ...]) -> DataFrame:
    """``card`` with ``share``: a line 'label: value' per field, a blank line, the footer's lines."""
    lines = [F.concat(F.lit(f"{labels[f]}: "), F.col(f)) for f in CARD]
    return card.withColumn("share", F.concat_ws("\n", *lines, F.lit(""), *(F.lit(x) for x in footer)))


def to_voter(entries: DataFrame) -> DataFrame:
    """Stored entries in the shape that a name search takes."""
    return entries.select(
        "ward", F.col("serial").alias("id"), "serial", "name", F.col("relative").alias("relative_name"), F.col("house").alias("house_no"),
        F.coalesce("struck", F.lit(False)).alias("struck"),
    )
