"""The catalogue: districts, samitis, panchayats and wards, built from grids and checked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions import text as X


@dataclass(frozen=True)
class GridColumns:
    """How a grid's columns are named; the defaults are the portal's."""

    ward: str = "Ward No."
    name: str = "Grampanchayat"
    final: str = "Final PDF"
    supplement: str = r"(?i)^Final\s+With\s+Supp"


def grid_wards(cells: DataFrame, columns: GridColumns = GridColumns()) -> DataFrame:
    """(page, row, col, text, linked) cells of saved grids (see ``pages.grid_cells``) to a row per ward line.

    The first row with a ward column is the header; later rows of its width
    count.  Returns page, row, ward, name, final and supplement (whether the
    cells under those headers hold a link).
    """
    wide = cells.groupBy("page", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text", "linked"))).alias("cells"))
    named = wide.withColumn("head", F.exists("cells", lambda c: c["text"] == columns.ward))
    order = Window.partitionBy("page").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    names = F.when(F.col("head"), F.transform("cells", lambda c: c["text"]))
    body = named.withColumn("headers", F.first(names, ignorenulls=True).over(order))
    body = body.filter("headers IS NOT NULL AND size(headers) = size(cells)")
    zipped = F.arrays_zip("headers", "cells")
    under = lambda test: F.filter(zipped, lambda z: test(z["headers"]))
    text = lambda name: F.get(F.transform(under(lambda h: h == name), lambda z: z["cells"]["text"]), F.lit(0))
    linked = lambda test: F.exists(under(test), lambda z: z["cells"]["linked"])
    return body.select(
        "page",
        "row",
        text(columns.ward).alias("ward"),
        text(columns.name).alias("name"),
        linked(lambda h: h == columns.final).alias("final"),
        linked(lambda h: h.rlike(columns.supplement)).alias("supplement"),
    )


def read_catalogue(wards: DataFrame) -> DataFrame:
    """Usable panchayats with their wards once each, by number; a blank Hindi name falls back to the Latin one."""
    rows = wards.filter("final").dropDuplicates(["panchayat_id", "ward"])
    hindi = F.max(F.when(X.has_devanagari(F.col("panchayat")), F.col("panchayat")))
    listed = F.array_join(F.sort_array(F.collect_list("ward")), ",")
    return rows.groupBy("district_id", "panchayat_id").agg(F.coalesce(hindi, F.max("panchayat")).alias("name"), listed.alias("wards"))


def build_catalogue(districts: DataFrame, samitis: DataFrame, panchayats: DataFrame, grid: DataFrame) -> DataFrame:
    """Every district, rural samiti and panchayat with what lies below it and, where a child is missing, why.

    ``districts`` (district_id), ``samitis`` (district_id, samiti_id, samiti),
    ``panchayats`` (samiti_id, panchayat_id) and ``grid`` (panchayat_id, final,
    supplement) are what was saved of each level.  Returns level, id, children,
    with_final, with_supplement and error; only children of saved parents count.
    """
    rural = samitis.join(districts.select("district_id"), "district_id", "left_semi").filter(X.entry_kind(F.col("samiti")) == "rural")
    inside = panchayats.join(rural.select("samiti_id"), "samiti_id", "left_semi")

    def level(name: str, rows: DataFrame, key: str, below: DataFrame, missing: str) -> DataFrame:
        links = [F.count_if(c).alias(f"with_{c}") for c in ("final", "supplement")] if name == "panchayat" else []
        found = below.groupBy(key).agg(F.count("*").alias("children"), *links)
        out = rows.select(key).join(found, key, "left")
        zero = lambda c: F.coalesce(F.col(c) if c in found.columns else F.lit(0), F.lit(0)).cast("bigint")
        error = F.when(F.col("children").isNull(), missing)
        if links:
            error = error.when(F.col("with_final") < F.col("children"), "no link")
        counts = [zero(c).alias(c) for c in ("children", "with_final", "with_supplement")]
        return out.select(F.lit(name).alias("level"), F.col(key).alias("id"), *counts, error.alias("error"))

    parts = (
        level("district", districts, "district_id", samitis, "no samitis"),
        level("samiti", rural, "samiti_id", panchayats, "no panchayats"),
        level("panchayat", inside, "panchayat_id", grid, "no grid"),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def judged_grid(panchayats: DataFrame, grid: DataFrame, responses: DataFrame | None = None, grids: DataFrame | None = None) -> DataFrame:
    """Panchayats and their grid lines by the first rule that they break, in the portal's order.

    Of a panchayat: no saved response, no grid in it, several Hindi names in the
    grid (not one panchayat's), a grid without lines; each stops there.  Of a
    line: a ward that is no number, one that stands further up, no link.
    ``grid`` has panchayat_id, row_no, ward_text, name, final and supplement;
    ``responses`` and ``grids`` have the ids with a saved response (all, if not
    given) and those whose response has a grid (those with lines).

    Returns panchayat_id, row_no (null for a panchayat's own rule), ward, supplement, error (null: a
    usable line) and detail.
    """
    has = lambda df, c: df.select("panchayat_id").distinct().withColumn(c, F.lit(True))
    ids = panchayats.select("panchayat_id").distinct()
    known = ids.join(has(responses if responses is not None else ids, "__saved"), "panchayat_id", "left")
    known = known.join(has(grids if grids is not None else grid, "__grid"), "panchayat_id", "left").join(has(grid, "__lines"), "panchayat_id", "left")
    hindi = grid.filter(X.has_devanagari(F.col("name"))).groupBy("panchayat_id", "name").agg(F.min("row_no").alias("at"))
    hindi = hindi.withColumn("name", X.nfc(F.col("name"))).groupBy("panchayat_id", "name").agg(F.min("at").alias("at"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda n: n["name"])
    known = known.join(hindi.groupBy("panchayat_id").agg(names.alias("__names")), "panchayat_id", "left")
    error = (
        F.when(F.col("__saved").isNull(), "no response")
        .when(F.col("__grid").isNull(), "no grid")
        .when(F.size("__names") > 1, "names disagree")
        .when(F.col("__lines").isNull(), "zero wards")
    )
    detail = F.when(F.col("error") == "names disagree", F.array_join("__names", ", ")).otherwise("")
    known = known.withColumn("error", error)
    own = known.filter("error IS NOT NULL").select("panchayat_id", F.lit(None).cast("int").alias("row_no"), F.lit(None).cast("int").alias("ward"), F.lit(False).alias("supplement"), "error", detail.alias("detail"))
    digits = X.ascii_digits(F.col("ward_text"))
    lines = grid.join(known.filter("error IS NULL").select("panchayat_id"), "panchayat_id", "left_semi")
    lines = lines.withColumn("ward", F.when(digits.rlike("^[0-9]+$"), digits).try_cast("int"))
    above = F.row_number().over(Window.partitionBy("panchayat_id", "ward").orderBy("row_no")) > 1
    number = F.col("ward").cast("string")
    wrong = F.when(F.col("ward").isNull(), "bad ward number").when(above, "repeated ward").when(~F.col("final"), "no link")
    said = F.when(F.col("ward").isNull(), F.col("ward_text")).otherwise(number)
    lines = lines.withColumn("error", wrong).select("panchayat_id", F.col("row_no").cast("int").alias("row_no"), "ward", "supplement", "error", F.when(F.col("error").isNotNull(), said).alias("detail"))
    return own.unionByName(lines)


def assemble(
    districts: DataFrame, samitis: DataFrame, panchayats: DataFrame, grid: DataFrame, responses: DataFrame | None = None, grids: DataFrame | None = None
) -> DataFrame:
    """A row per usable ward (see ``judged_grid``), with its whole path, of saved rural parents alone."""
    judged = judged_grid(panchayats, grid, responses, grids)
    wards = judged.filter("error IS NULL").select("panchayat_id", "ward", "supplement")
    rural = samitis.filter(X.entry_kind(F.col("samiti")) == "rural")
    up = panchayats.join(rural, "samiti_id").join(districts, "district_id")
    return wards.join(up, "panchayat_id")


def in_order(df: DataFrame, within: list[str], name: str, latin: str, key: str) -> DataFrame:
    """``df`` with ``place`` (from 1): catalogue order within a parent, by name, Latin name and id, by code point."""
    order = Window.partitionBy(*within).orderBy(name, latin, F.col(key).cast("string"))
    return df.withColumn("place", F.row_number().over(order))


def cover_fallbacks(samitis: DataFrame, readings: DataFrame) -> DataFrame:
    """Each samiti's name from its cover readings, else its own, with the reason."""
    rows = samitis.join(readings, "samiti_id", "left")
    reason = F.when(F.col("readings").isNull(), "no cover").when(F.col("cover").isNull(), "unreadable")
    return rows.select("samiti_id", F.coalesce("cover", "samiti").alias("name"), reason.alias("reason"))


def majority_names(readings: DataFrame, key: str, name: str) -> DataFrame:
    """The commonest name per key, ties to the lower, and whether readings disagree."""
    counts = readings.groupBy(key, name).agg(F.count("*").alias("n"))
    commonest = F.min_by(name, F.struct(-F.col("n"), F.col(name)))
    return counts.groupBy(key).agg(
        commonest.alias("name"), (F.count("*") > 1).alias("disagree"), F.sum("n").alias("readings")
    )


def summary(wards: DataFrame) -> DataFrame:
    """Counts by kind of samiti: bodies per level, wards, those with a supplement, and samitis that a rural catalogue skips."""
    kind = X.entry_kind(F.col("samiti"))
    return wards.groupBy(kind.alias("kind")).agg(
        F.count_distinct(F.when(kind != "rural", F.col("samiti_id"))).alias("skipped"),
        F.count_distinct("district_id").alias("districts"),
        F.count_distinct("samiti_id").alias("samitis"),
        F.count_distinct("panchayat_id").alias("panchayats"),
        F.count("*").alias("wards"),
        F.count_if("supplement").alias("with_supplement"),
    )


def errors(panchayats: DataFrame, grid: DataFrame, responses: DataFrame | None = None, grids: DataFrame | None = None) -> DataFrame:
    """(panchayat_id, error, detail): what ``judged_grid`` finds wrong."""
    return judged_grid(panchayats, grid, responses, grids).filter("error IS NOT NULL").select("panchayat_id", "error", F.coalesce("detail", F.lit("")).alias("detail"))


def shard_names(districts: DataFrame, key: str, name: str) -> DataFrame:
    """File names: the slug, with the id where slugs repeat."""
    plain = F.concat(F.lit("district-"), F.col(key).cast("string"))
    rows = districts.withColumn("slug", F.coalesce(F.nullif(X.slug(F.col(name)), F.lit("")), plain))
    twice = (F.count("*").over(Window.partitionBy("slug")) > 1) | (F.col("slug") == "index")
    return rows.select(key, F.concat("slug", F.when(twice, F.concat(F.lit("-"), F.col(key).cast("string"))).otherwise(F.lit("")), F.lit(".json")).alias("file"))


def ward_collisions(wards: DataFrame) -> DataFrame:
    """Ward numbers that several panchayats use."""
    return wards.groupBy("ward").agg(F.count_distinct("panchayat_id").alias("panchayats")).filter("panchayats > 1")


def nested(wards: DataFrame) -> DataFrame:
    """One JSON document per samiti: its panchayats with their wards (a district's documents together are its tree)."""
    keys = ["district_id", "district", "samiti_id", "samiti"]
    p = wards.groupBy(*keys, "panchayat_id", "panchayat").agg(F.sort_array(F.collect_list("ward")).alias("wards"))
    rows = F.sort_array(F.collect_list(F.struct(F.col("panchayat_id").alias("id"), F.col("panchayat").alias("name"), "wards")))
    s = p.groupBy(*keys).agg(rows.alias("panchayats"))
    district = F.struct(F.col("district_id").alias("id"), F.col("district").alias("name"))
    document = F.struct(district.alias("district"), F.col("samiti_id").alias("id"), F.col("samiti").alias("name"), "panchayats")
    return s.select("district_id", "samiti_id", F.to_json(document).alias("document"))


_P = "struct<id:string,name:string>"
_S = f"struct<id:string,name:string,kind:string,panchayats:array<{_P}>>"
TREE = f"schemaVersion int, counts struct<districts:bigint,samitis:bigint,panchayats:bigint,urban:bigint,zillaParishad:bigint,other:bigint>, notes array<string>, districts array<struct<id:string,name:string,samitis:array<{_S}>>>"


def tree(districts: DataFrame, samitis: DataFrame, panchayats: DataFrame, notes: list[str]) -> DataFrame:
    """The whole catalogue as one JSON document (a state's, some ten thousand names), with notes and counts.

    ``districts`` has district_id and district, ``samitis`` district_id, samiti_id and samiti, ``panchayats``
    samiti_id, panchayat_id and panchayat.  Only rural samitis list panchayats; the others are counted by kind.
    """
    text = lambda c: F.col(c).cast("string")
    kinds = samitis.join(districts, "district_id").withColumn("entry", X.entry_kind(F.col("samiti")))
    kind = F.when(F.col("entry") == "rural", "rural").when(F.col("entry") == "urban", "urban").otherwise("unknown")
    inside = panchayats.join(kinds.filter("entry = 'rural'").select("samiti_id"), "samiti_id")
    leaf = F.struct(text("panchayat_id").alias("id"), F.col("panchayat").alias("name"))
    below = inside.groupBy("samiti_id").agg(F.sort_array(F.collect_list(F.struct("panchayat_id", leaf.alias("p")))).alias("ps"))
    listed = F.coalesce(F.transform("ps", lambda x: x["p"]), F.array().cast(f"array<{_P}>"))
    s = kinds.join(below, "samiti_id", "left").select("district_id", "samiti_id", F.struct(text("samiti_id").alias("id"), F.col("samiti").alias("name"), kind.alias("kind"), listed.alias("panchayats")).alias("s"))
    s = s.groupBy("district_id").agg(F.sort_array(F.collect_list(F.struct("samiti_id", "s"))).alias("ss"))
    ss = F.coalesce(F.transform("ss", lambda x: x["s"]), F.array().cast(f"array<{_S}>"))
    d = districts.join(s, "district_id", "left").select("district_id", F.struct(text("district_id").alias("id"), F.col("district").alias("name"), ss.alias("samitis")).alias("d"))
    whole = d.agg(F.sort_array(F.collect_list(F.struct("district_id", "d"))).alias("ds"), F.count("*").alias("n"))
    of = lambda k: F.count_if(F.col("entry") == k)
    counts = kinds.agg(of("rural").alias("samitis"), of("urban").alias("urban"), of("zillaParishad").alias("zillaParishad"), of("other").alias("other"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    row = one(whole).join(one(counts), "__one").join(one(inside.agg(F.count("*").alias("panchayats"))), "__one")
    counted = F.struct(F.col("n").alias("districts"), "samitis", "panchayats", "urban", "zillaParishad", "other")
    said = F.array(*(F.lit(n) for n in notes)).cast("array<string>")
    return row.select(F.to_json(F.struct(F.lit(VERSION).alias("schemaVersion"), counted.alias("counts"), said.alias("notes"), F.transform("ds", lambda x: x["d"]).alias("districts"))).alias("document"))


def merge_trees(earlier: DataFrame, built: DataFrame) -> DataFrame:
    """An earlier tree with the districts of a partial build in their places, new ones after them; the earlier notes stay.

    Both are (document) of one row; counts are those of the build.
    """
    parse = lambda df, name: df.select(F.from_json("document", TREE).alias(name), F.lit(1).alias("__one"))
    both = parse(earlier, "old").join(parse(built, "new"), "__one")
    by_id = lambda c: F.map_from_entries(F.transform(c, lambda d: F.struct(d["id"], d)))
    both = both.withColumns({"fresh": by_id(F.col("new.districts")), "known": F.transform("old.districts", lambda d: d["id"])})
    kept = F.transform("old.districts", lambda d: F.coalesce(F.element_at("fresh", d["id"]), d))
    added = F.filter("new.districts", lambda d: ~F.array_contains("known", d["id"]))
    notes = F.coalesce("old.notes", "new.notes")
    return both.select(F.to_json(F.struct("new.schemaVersion", "new.counts", notes.alias("notes"), F.concat(kept, added).alias("districts"))).alias("document"))


def allowed_urls(trees: DataFrame, column: str = "document") -> DataFrame:
    """The distinct https URLs of a config tree's wards, through its four levels: each ward's own and its supplements'."""
    ward = "struct<pdfUrl:string,supplementPdfUrls:array<string>>"
    kind = f"districts array<struct<samitis:array<struct<panchayats:array<struct<wards:array<{ward}>>>>>>>"
    level = trees.select(F.explode(F.from_json(column, kind)["districts"]).alias("x"))
    for below in ("samitis", "panchayats", "wards"):
        level = level.select(F.explode(f"x.{below}").alias("x"))
    urls = F.concat(F.array("x.pdfUrl"), F.coalesce("x.supplementPdfUrls", F.array().cast("array<string>")))
    return level.select(F.explode(urls).alias("url")).filter("url LIKE 'https://%'").distinct()


# The version of catalogue documents, and names that a document's file may have.
VERSION = 1
SHARD_FILE = "^[a-z0-9][a-z0-9-]*\\.json$"
_BODY = "id:string,name:string,nameLatin:string"
INDEX = f"schemaVersion int, districts array<struct<{_BODY},file:string>>"
SHARD = (
    "schemaVersion int, id string, name string, nameLatin string, "
    f"panchayats array<struct<{_BODY},block:struct<{_BODY}>,wards:array<struct<ward:int,pdfUrl:string>>>>"
)


def _gated(documents: DataFrame, schema: str, column: str) -> DataFrame:
    """Documents parsed; one of another version, or that is none, is an error."""
    rows = documents.withColumn("__d", F.from_json(column, schema))
    known = F.coalesce(F.col("__d.schemaVersion") == VERSION, F.lit(False))
    return rows.filter(F.when(known, True).otherwise(F.raise_error(F.lit("unknown catalogue version")).cast("boolean")))


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _body(c: str) -> list[Column]:
    """id, name (the Latin one where it is blank) and name_latin of a struct."""
    latin = F.when(_text(F.col(f"{c}.nameLatin")), F.col(f"{c}.nameLatin")).otherwise("")
    return [F.col(f"{c}.id").alias("id"), F.when(_text(F.col(f"{c}.name")), F.col(f"{c}.name")).otherwise(latin).alias("name"), latin.alias("name_latin")]


def _usable(c: str) -> Column:
    return _text(F.col(f"{c}.id")) & (_text(F.col(f"{c}.name")) | _text(F.col(f"{c}.nameLatin")))


def index_documents(districts: DataFrame, key: str) -> DataFrame:
    """A JSON document per ``key`` (a state) that lists its districts (id, name, name_latin, file), in catalogue order."""
    entry = F.struct("name", F.col("name_latin").alias("nameLatin"), F.col("id").cast("string").alias("id"), "file")
    listed = districts.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("districts"))
    return listed.select(key, F.to_json(F.struct(F.lit(VERSION).alias("schemaVersion"), "districts")).alias("document"))


def read_index(documents: DataFrame, column: str = "document") -> DataFrame:
    """id, name, name_latin and file of the usable districts of index documents; unsafe file names are dropped."""
    rows = _gated(documents, INDEX, column).select(F.explode("__d.districts").alias("d"))
    fine = _usable("d") & F.coalesce(F.col("d.file").rlike(SHARD_FILE), F.lit(False))
    return rows.filter(fine).select(*_body("d"), "d.file")


def read_shards(documents: DataFrame, column: str = "document") -> DataFrame:
    """A row per ward (district, id, name, name_latin, ward, url) of the usable panchayats of shard documents; of repeats the first stands."""
    rows = _gated(documents, SHARD, column).select(F.col("__d.id").alias("district"), F.explode("__d.panchayats").alias("p")).filter(_usable("p"))
    each = rows.select("district", *_body("p"), F.posexplode("p.wards").alias("at", "w"))
    fine = each.filter((F.col("w.ward") > 0) & _text(F.col("w.pdfUrl")))
    first = fine.groupBy("district", "id", "name", "name_latin", F.col("w.ward").alias("ward")).agg(F.min_by("w.pdfUrl", "at").alias("url"))
    return first


def partial_merge(old: DataFrame, rebuilt: DataFrame, key: str = "district_id") -> DataFrame:
    """Rows of keys that weren't rebuilt, and the rebuilt ones."""
    return old.join(rebuilt.select(key).distinct(), key, "left_anti").unionByName(rebuilt)


def stale(before: DataFrame, written: DataFrame) -> DataFrame:
    return before.subtract(written)


def panchayat_filter(df: DataFrame, query: str, name: str = "panchayat", block: str = "samiti") -> DataFrame:
    """Panchayats whose name or block holds the normalised query, or whose name holds it whatever the case."""
    q = X.normalise(F.lit(query))
    return df.filter(X.normalise(F.col(name)).contains(q) | X.normalise(F.col(block)).contains(q) | F.lower(name).contains(F.lower(q)))


def selection(wards: DataFrame, seat: str, panchayat_id: int, ward: int | None = None) -> DataFrame:
    """All wards of a panchayat for a 'sarpanch' seat, one for a 'ward-panch' seat; none for any other."""
    rows = wards.filter(F.col("panchayat_id") == panchayat_id)
    if seat == "sarpanch":
        return rows
    if seat != "ward-panch" or ward is None:
        return rows.limit(0)
    return rows.filter(F.col("ward") == ward)


def ward_key(district: Column, samiti: Column, panchayat: Column, ward: Column) -> Column:
    """'district/samiti/panchayat/ward'."""
    return F.concat_ws("/", *(c.cast("string") for c in (district, samiti, panchayat, ward)))


def ward_of_key(key: Column) -> Column:
    return F.element_at(F.split(key, "/", -1), -1)


def sibling_key(key: Column, ward: Column) -> Column:
    """The key of another ward of the same panchayat; null unless the key has four parts."""
    parts = F.split(key, "/", -1)
    return F.when(F.size(parts) == 4, F.concat_ws("/", F.slice(parts, 1, 3), ward.cast("string")))


def resolve(paths: DataFrame, wards: DataFrame) -> DataFrame:
    """'district/samiti/panchayat/ward' paths to their ward's row; ``found`` is false where a level is absent."""
    parts = F.split("path", "/", -1)
    part = lambda i: F.when(F.size(parts) == 4, F.get(parts, i).try_cast("bigint"))
    keys = ["district_id", "samiti_id", "panchayat_id", "ward"]
    rows = paths.withColumns({k: part(i) for i, k in enumerate(keys)})
    known = wards.select(*keys[:3], F.col("ward").cast("bigint").alias("ward"), F.lit(True).alias("found")).distinct()
    return rows.join(known, keys, "left").withColumn("found", F.coalesce("found", F.lit(False))).select("path", "found")


def panchayat_label(name: Column, block: Column) -> Column:
    """The name, with the block in brackets if there is one."""
    return F.when(F.coalesce(F.trim(block), F.lit("")) != "", F.concat(name, F.lit(" ("), block, F.lit(")"))).otherwise(name)


def seat_label(seat: Column, panchayat: Column, ward: Column) -> Column:
    """The line that names a seat: all wards for a sarpanch, one for a ward; null if the seat is not one."""
    where = F.concat(F.lit("पंचायत: "), F.trim(panchayat))
    named = F.coalesce(F.trim(panchayat), F.lit("")) != ""
    return F.when(named & (seat == "sarpanch"), F.concat(where, F.lit(" · सभी वार्ड"))).when(
        named & (seat == "ward-panch") & (F.coalesce(F.trim(ward), F.lit("")) != ""), F.concat(where, F.lit(" · वार्ड: "), F.trim(ward))
    )


def roll_selection(picks: DataFrame) -> DataFrame:
    """What opens a roll: the ids of a ward-panch pick of one ward; other picks give no row.

    ``picks``: seat, district_id, samiti_id, panchayat_id, wards (array of ward and url).
    """
    one = picks.filter((F.col("seat") == "ward-panch") & (F.size("wards") == 1)).withColumn("w", F.col("wards")[0])
    text = lambda c: F.col(c).cast("string")
    return one.filter("w.url IS NOT NULL").select(
        text("district_id").alias("district"),
        F.coalesce(text("samiti_id"), F.lit("")).alias("samiti"),
        text("panchayat_id").alias("panchayat"),
        text("w.ward").alias("ward"),
        "w.url",
    )


def seat_from_pick(picks: DataFrame) -> DataFrame:
    """seat_type, panchayat and ward (null for a sarpanch) of every pick that names a seat.

    ``picks``: seat, panchayat, wards (array of ward and url).
    """
    kind = F.when(F.col("seat") == "ward-panch", "ward").when(F.col("seat") == "sarpanch", "sarpanch")
    one = F.when(F.size("wards") == 1, F.col("wards")[0]["ward"])
    ward = F.when((kind == "ward") & (one > 0), one.cast("string"))
    named = _text(F.col("panchayat")) & (F.size("wards") > 0)
    rows = picks.select("*", kind.alias("seat_type"), ward.alias("ward")).filter(named & F.col("seat_type").isNotNull())
    return rows.filter((F.col("seat_type") == "sarpanch") | F.col("ward").isNotNull())
