"""Queries of the sync log, the catalogue, decoder quality and the streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from wardloom.operators import catalogue as C, quality, rolls, synclog, tally
from wardloom.plans.book import Book
from wardloom.plans.text_queries import BASE, _CONTACTS, _KIND, _MESSAGES, _PAYLOAD, _URL
from wardloom.functions import text as X
from wardloom.sources import pages as P
from wardloom.sources import rolls as rolls_store
from wardloom.sources.shared import own_path
from wardloom.streaming import jobs

book = Book()
query = book.query

# Times as they are sent: numbers, texts in UTC, texts with an offset.  A fold in order of arrival decides.
_SENT = """SELECT candidate, id, seq, device, ms, CASE WHEN event_id % 3 = 0 THEN ms END AS num,
    CASE event_id % 3 WHEN 1 THEN concat(strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g'), 'Z')
        WHEN 2 THEN concat(strftime(make_timestamp(ms * 1000 + 19800000000), '%Y-%m-%dT%H:%M:%S.%g'), '+05:30') END AS txt
    FROM (SELECT *, epoch_us(updated_at) // 1000 + 60000 * ({minutes}) AS ms FROM sync_log) l"""
_LATER = "CASE WHEN {a}.num IS NOT NULL AND {b}.num IS NOT NULL THEN {a}.num > {b}.num WHEN {a}.txt IS NOT NULL AND {b}.txt IS NOT NULL THEN {a}.txt > {b}.txt ELSE {a}.ms > {b}.ms END"
_FOLD = (
    "SELECT candidate, id, list_reduce(list({{'seq': seq, 'device': device, 'num': num, 'txt': txt, 'ms': ms}} ORDER BY seq), "
    f"lambda a, b: CASE WHEN {_LATER.format(a='b', b='a')} THEN b ELSE a END) AS r FROM ({_SENT}) s GROUP BY candidate, id"
)


def _sent(v, minutes: str = "0"):
    """The whole log with its times as they are sent, moved by so many minutes."""
    ms = F.unix_millis(F.col("updated_at").cast("timestamp")) + 60_000 * F.expr(f"CAST({minutes} AS BIGINT)")
    text = lambda m, end: F.concat(F.date_format(F.timestamp_millis(m), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(end)).cast("variant")
    kind = F.col("event_id") % 3
    time = F.when(kind == 0, ms.cast("variant")).when(kind == 1, text(ms, "Z")).otherwise(text(ms + 19_800_000, "+05:30"))
    return v.sync_log.select("candidate", "id", "seq", "device", time.alias("updated_at"))


@query(f"SELECT candidate, id, r.seq AS seq, r.device AS device FROM ({_FOLD.format(minutes='0')}) x")
def latest_per_id(v):
    return synclog.latest_mixed(_sent(v)).select("candidate", "id", "seq", "device")


@query("SELECT candidate, id, arg_max(seq, (t, seq)) AS seq FROM (SELECT *, date_trunc('day', updated_at) AS t FROM sync_log) x GROUP BY candidate, id")
def outbox_state(v):
    rows = v.sync_log.withColumn("t", F.date_trunc("day", "updated_at"))
    return synclog.latest(rows, time="t", later_wins=True).select("candidate", "id", "seq")


_OFF = "(SELECT candidate, id, seq, device, updated_at + to_minutes({}) AS updated_at FROM sync_log)"


def _off(v, minutes: str):
    """The whole log with its times moved by so many minutes."""
    log = v.sync_log.select("candidate", "id", "seq", "device", "updated_at")
    return log.withColumn("updated_at", F.expr(f"updated_at + make_interval(0, 0, 0, 0, 0, CAST({minutes} AS INT))"))


@query(f"""WITH l AS ({_FOLD.format(minutes='seq % 5 - 1')}), s AS ({_FOLD.format(minutes='0')}), p AS ({_FOLD.format(minutes='seq % 3 - 1')})
    SELECT l.candidate, l.id, l.r.seq AS seq FROM l LEFT JOIN s USING (candidate, id) LEFT JOIN p USING (candidate, id)
    WHERE (s.r IS NULL OR {_LATER.format(a='l.r', b='s.r')}) AND (p.r IS NULL OR {_LATER.format(a='l.r', b='p.r')})""")
def newer_than_state(v):
    """All records sent again some minutes earlier or later, against the log and against what waits."""
    return synclog.newer_than(_sent(v, "seq % 5 - 1"), _sent(v), _sent(v, "seq % 3 - 1")).select("candidate", "id", "seq")


@query("SELECT candidate, id, seq FROM sync_log o WHERE NOT EXISTS (SELECT 1 FROM sync_log d WHERE d.seq % 3 <> 0 AND d.candidate = o.candidate AND d.id = o.id AND d.updated_at = o.updated_at)")
def outbox_after_push(v):
    """Every third record was saved again, a minute later, since it was sent."""
    sent = _off(v, "CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END")
    return synclog.after_push(v.sync_log, sent.select("candidate", "id", "updated_at")).select("candidate", "id", "seq")


@query("SELECT event_id, candidate, 100 * (CAST(substr(candidate, 2) AS BIGINT) % 3) + row_number() OVER (PARTITION BY candidate ORDER BY event_id) AS new_seq FROM sync_log")
def assign_seq(v):
    number = F.expr("CAST(substr(candidate, 2) AS BIGINT)") % 3
    counters = v.sync_log.select("candidate").distinct().withColumn("counter", 100 * number).filter("counter > 0")
    return synclog.assign_sequence(v.sync_log.select("event_id", "candidate"), counters, "event_id").select("event_id", "candidate", F.col("new_seq").cast("bigint").alias("new_seq"))


@query("SELECT candidate, max(seq) AS counter FROM sync_log GROUP BY candidate")
def counter_merge(v):
    top = lambda part: v.sync_log.filter(part).groupBy("candidate").agg(F.max("seq").alias("counter"))
    return synclog.merge_counters(top("seq % 2 = 0"), top("seq % 2 = 1"))


@query("SELECT candidate, before, seq FROM (SELECT candidate, seq, lag(seq) OVER (PARTITION BY candidate ORDER BY seq) AS before FROM sync_log WHERE seq % 50 <> 0) g WHERE seq - before <> 1")
def seq_gaps(v):
    return synclog.gaps(v.sync_log.filter("seq % 50 <> 0"))


@query("SELECT seq, id, true AS more FROM sync_log WHERE candidate = 't1' AND seq > 20 ORDER BY seq LIMIT 100")
def sync_page(v):
    """A page of 100 after a cursor, and whether more follow."""
    return synclog.page(v.sync_log, "t1", 20, 100).select("seq", "id", "more")


@query("SELECT candidate, CAST(floor((row_number() OVER (PARTITION BY candidate ORDER BY seq) - 1) / 500) AS BIGINT) AS batch, seq FROM sync_log")
def batch_ids(v):
    return tally.numbered_batches(v.sync_log, ["candidate"], "seq", 500).select("candidate", "batch", "seq")


@query("SELECT candidate, seq, id AS a_id, concat(id, '!') AS b_id FROM sync_log WHERE seq % 4 = 0")
def collisions(v):
    """The log against itself with every fourth payload changed."""
    other = v.sync_log.withColumn("id", F.when(F.col("seq") % 4 == 0, F.concat("id", F.lit("!"))).otherwise(F.col("id")))
    return synclog.collisions(v.sync_log, other).select("candidate", "seq", "a_id", "b_id")


@query("SELECT id, count(DISTINCT candidate) AS candidates, count(*) AS records FROM sync_log GROUP BY id HAVING count(DISTINCT candidate) > 1")
def team_isolation(v):
    return synclog.team_isolation(v.sync_log)


_NAME = "CASE event_id % 5 WHEN 0 THEN concat('c/t', user_id % 5, '/r/', event_id) WHEN 1 THEN concat('c/t', user_id % 5, '/m/mark:', event_id) WHEN 2 THEN concat('c/t', user_id % 5, '/seq') WHEN 3 THEN concat('c/t', user_id % 5, '/verifier') ELSE concat('x/', event_id) END"
_VALUE = "CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN '{\"id\":\"a\"}' ELSE '{}' END WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '12' END ELSE 'v' END"


@query(f"""SELECT name, CASE WHEN k < 4 THEN split_part(name, '/', 2) END AS candidate, CASE k WHEN 0 THEN 'records' WHEN 1 THEN 'marks' WHEN 2 THEN 'counters' WHEN 3 THEN 'verifiers' END AS target,
    CASE k WHEN 0 THEN split_part(name, '/', 4) WHEN 1 THEN split_part(name, '/', 4) WHEN 2 THEN 'seq' WHEN 3 THEN 'verifier' END AS key,
    CASE WHEN k = 4 THEN 'name' WHEN k = 2 AND value = 'x' THEN 'counter' WHEN k = 0 AND value = '{{}}' THEN 'record' END AS reason FROM (SELECT event_id % 5 AS k, {_NAME} AS name, {_VALUE} AS value FROM events) d""")
def kv_route(v):
    """Events as a dump of one-entry documents: lists, lists wrapped as results, and maps."""
    e = v.events.select("event_id", F.expr(_NAME).alias("name"), F.expr(_VALUE).alias("value"))
    listed = F.to_json(F.array(F.struct("name", "value")))
    wrapped = F.to_json(F.array(F.struct(F.array(F.struct("name", "value")).alias("results"))))
    kind = F.col("event_id") % 3
    doc = F.when(kind == 0, listed).when(kind == 1, wrapped).otherwise(F.to_json(F.create_map("name", "value")))
    return synclog.route_dump(synclog.dump_entries(e.select(doc.alias("doc"))))


# catalogue


@query("SELECT panchayat_id, row_no, ward_text AS ward, name, final, supplement FROM cat_grid")
def grid_wards(v):
    """Saved search pages, one per panchayat, parsed to cells and links, then read by the portal's column names."""
    cell = lambda *parts: F.concat(F.lit("<td>"), *parts, F.lit("</td>"))
    back = F.lit("<a href=\"javascript:__doPostBack('grid$lnk','')\">View</a>")
    button = F.lit('<input type="image" name="b" src="pdf.png">')
    plain = F.lit('<a href="#top">-</a>')
    line = F.concat(
        F.lit("<tr>"), cell(F.col("name")), cell(F.lit(" "), F.col("ward_text"), F.lit("\n")),
        cell(F.when(F.col("final"), back).otherwise(plain)), cell(F.when(F.col("supplement"), button).otherwise(plain)), F.lit("</tr>"),
    )
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", line.alias("html")))), lambda x: x["html"]), "\n")
    names = C.GridColumns()
    head = f"<table><tr><th>{names.name}</th><th>{names.ward}</th><th>{names.final}</th><th>Final With Supp-2 PDF</th></tr>"
    form = f'<form><input type="hidden" name="__VIEWSTATE" value="x"><select name="d"><option value="0">--Select--</option><option value="7" selected>A</option></select>{head}'
    html = F.concat(F.lit(form), lines, F.lit("<tr><td colspan=4>1 2</td></tr></table></form>"))
    saved = v.cat_grid.groupBy(F.col("panchayat_id").alias("page_id")).agg(html.alias("html"))
    grid = C.grid_wards(P.grid_cells(P.page_rows(saved)))
    return grid.select(F.col("page").alias("panchayat_id"), F.col("row").alias("row_no"), "ward", "name", "final", "supplement")


@query("SELECT district_id, panchayat_id, min(panchayat) AS name, string_agg(CAST(ward AS VARCHAR), ',' ORDER BY ward) AS wards FROM cat_ward WHERE final GROUP BY district_id, panchayat_id")
def catalogue_read(v):
    return C.read_catalogue(v.cat_ward)


_RURAL = f"rural AS (SELECT * FROM cat_samiti WHERE {_KIND('samiti')} = 'rural')"


def _levels(v):
    return v.region.select(F.col("r_regionkey").cast("bigint").alias("district_id")), v.cat_samiti, v.cat_panchayat, v.cat_grid


@query(f"""WITH {_RURAL}, s AS (SELECT district_id, count(*) AS n FROM cat_samiti GROUP BY district_id), p AS (SELECT samiti_id, count(*) AS n FROM cat_panchayat GROUP BY samiti_id),
    g AS (SELECT panchayat_id, count(*) AS n, sum(CASE WHEN final THEN 1 ELSE 0 END) AS f, sum(CASE WHEN supplement THEN 1 ELSE 0 END) AS u FROM cat_grid GROUP BY panchayat_id)
    SELECT 'district' AS level, CAST(r_regionkey AS BIGINT) AS id, coalesce(n, 0) AS children, 0 AS with_final, 0 AS with_supplement, CASE WHEN n IS NULL THEN 'no samitis' END AS error FROM region LEFT JOIN s ON r_regionkey = district_id
    UNION ALL SELECT 'samiti', r.samiti_id, coalesce(n, 0), 0, 0, CASE WHEN n IS NULL THEN 'no panchayats' END FROM rural r LEFT JOIN p ON r.samiti_id = p.samiti_id
    UNION ALL SELECT 'panchayat', c.panchayat_id, coalesce(n, 0), coalesce(f, 0), coalesce(u, 0), CASE WHEN n IS NULL THEN 'no grid' WHEN f < n THEN 'no link' END FROM cat_panchayat c JOIN rural r ON c.samiti_id = r.samiti_id LEFT JOIN g ON c.panchayat_id = g.panchayat_id""")
def catalogue_build(v):
    """District, samiti, panchayat and ward, with what is missing at each level."""
    return C.build_catalogue(*_levels(v))


# The grids as the portal has them: Hindi and Latin names, numbers written in several ways, responses and grids that are missing, grids without lines.
_HINDI = "CASE WHEN panchayat_id % 2 = 0 THEN concat('ग्राम ', name) ELSE name END"
_WRITTEN = "CASE WHEN panchayat_id % 23 = 0 AND row_no = 4 THEN '02' WHEN panchayat_id % 7 = 0 AND row_no = 1 THEN translate(ward_text, '0123456789', '०१२३४५६७८९') ELSE ward_text END"
_GRID = f"grids AS (SELECT panchayat_id, row_no, {_WRITTEN} AS ward_text, {_HINDI} AS name, final, supplement FROM cat_grid WHERE panchayat_id % 37 <> 0 AND panchayat_id % 41 <> 0)"
_JUDGED = f"""{_GRID}, numbers AS (SELECT *, CASE WHEN regexp_full_match(translate(ward_text, '०१२३४५६७८९', '0123456789'), '[0-9]+') THEN CAST(translate(ward_text, '०१२३४५६७८९', '0123456789') AS INT) END AS ward FROM grids),
    hindi AS (SELECT panchayat_id, count(*) AS n, string_agg(name, ', ' ORDER BY place) AS names FROM (SELECT panchayat_id, name, min(row_no) AS place FROM grids WHERE panchayat_id % 2 = 0 GROUP BY ALL) x GROUP BY panchayat_id),
    own AS (SELECT p.panchayat_id, CASE WHEN p.panchayat_id % 41 = 0 THEN 'no response' WHEN p.panchayat_id % 31 = 0 THEN 'no grid' WHEN h.n > 1 THEN 'names disagree' WHEN p.panchayat_id NOT IN (SELECT panchayat_id FROM grids) THEN 'zero wards' END AS error,
        CASE WHEN h.n > 1 THEN h.names ELSE '' END AS detail FROM (SELECT DISTINCT panchayat_id FROM {{panchayats}}) p LEFT JOIN hindi h USING (panchayat_id)),
    judged AS (SELECT l.*, CASE WHEN ward IS NULL THEN 'bad ward number' WHEN row_number() OVER (PARTITION BY panchayat_id, ward ORDER BY row_no) > 1 THEN 'repeated ward' WHEN NOT final THEN 'no link' END AS error
        FROM numbers l WHERE panchayat_id IN (SELECT panchayat_id FROM own WHERE error IS NULL))"""


def _portal(v, panchayats):
    """Grid lines, ids with a saved response, ids whose response has a grid."""
    grid = v.cat_grid.filter("panchayat_id % 37 <> 0 AND panchayat_id % 41 <> 0")
    grid = grid.select("panchayat_id", "row_no", F.expr(_WRITTEN).alias("ward_text"), F.expr(_HINDI).alias("name"), "final", "supplement")
    ids = panchayats.select("panchayat_id").distinct()
    return grid, ids.filter("panchayat_id % 41 <> 0"), ids.filter("panchayat_id % 31 <> 0")


@query(f"""WITH {_RURAL}, {_JUDGED.format(panchayats='cat_panchayat')} SELECT district_id, r.samiti_id, samiti, c.panchayat_id, panchayat, ward, supplement
    FROM judged g JOIN cat_panchayat c ON g.panchayat_id = c.panchayat_id JOIN rural r ON c.samiti_id = r.samiti_id WHERE error IS NULL""")
def catalogue_assemble(v):
    districts, samitis, panchayats, _ = _levels(v)
    return C.assemble(districts, samitis, panchayats, *_portal(v, panchayats)).select("district_id", "samiti_id", "samiti", "panchayat_id", "panchayat", "ward", "supplement")


@query("""SELECT panchayat_id, CAST(row_number() OVER (PARTITION BY samiti_id ORDER BY left(panchayat, 17), panchayat, CAST(panchayat_id AS VARCHAR)) AS INT) AS place FROM cat_panchayat""")
def catalogue_order(v):
    rows = v.cat_panchayat.withColumn("name", F.substring("panchayat", 1, 17))
    return C.in_order(rows, ["samiti_id"], "name", "panchayat", "panchayat_id").select("panchayat_id", "place")


@query("""SELECT CAST(samiti_id AS VARCHAR) AS district, CAST(panchayat_id AS VARCHAR) AS id, CASE WHEN panchayat_id % 5 = 0 THEN panchayat ELSE concat('ग्राम ', panchayat) END AS name, panchayat AS name_latin, ward, concat('u', ward) AS url
    FROM cat_ward WHERE final AND panchayat_id % 7 <> 0""")
def catalogue_documents(v):
    """A document per samiti read back: blank names, repeated and unlinked wards, panchayats without an id."""
    url = F.when(F.col("final"), F.concat(F.lit("u"), "ward")).otherwise(F.lit(" "))
    again = F.struct("ward", F.lit("again").alias("pdfUrl"))
    ward = F.when(F.col("final"), F.array(F.struct("ward", url.alias("pdfUrl")), again)).otherwise(F.array(F.struct("ward", url.alias("pdfUrl"))))
    rows = v.cat_ward.groupBy("samiti_id", "samiti", "panchayat_id", "panchayat").agg(F.flatten(F.collect_list(ward)).alias("wards"))
    name = F.when(F.col("panchayat_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("ग्राम "), "panchayat"))
    key = F.when(F.col("panchayat_id") % 7 == 0, F.lit("")).otherwise(F.col("panchayat_id").cast("string"))
    p = F.struct(key.alias("id"), name.alias("name"), F.col("panchayat").alias("nameLatin"), "wards")
    doc = F.struct(F.lit(C.VERSION).alias("schemaVersion"), F.col("samiti_id").cast("string").alias("id"), F.col("samiti").alias("nameLatin"), "panchayats")
    shards = rows.groupBy("samiti_id", "samiti").agg(F.collect_list(p).alias("panchayats")).select(F.to_json(doc).alias("document"))
    return C.read_shards(shards)


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, n_name AS name_latin, concat(CASE WHEN n_nationkey % 3 = 1 THEN 'new-' ELSE 'd-' END, n_nationkey, '.json') AS file,
    CASE WHEN n_nationkey % 3 = 1 THEN 'new' ELSE 'old' END AS build FROM nation WHERE n_nationkey % 4 <> 0""")
def catalogue_index(v):
    """All districts built, then some of them once more under other names, then read: the index lists what is there; unsafe file names are dropped."""
    path = own_path(v.spark, "catalogue")

    def build(word: str, rows):
        file = F.when(F.col("n_nationkey") % 4 == 0, F.lit("../up.json")).otherwise(F.concat(F.lit(f"{word}-"), "n_nationkey", F.lit(".json")))
        build = "new" if word == "new" else "old"
        return rows.select(F.col("n_nationkey").cast("string").alias("district_id"), F.lit("").alias("name"), F.col("n_name").alias("name_latin"), file.alias("file"), F.lit(build).alias("document"))

    rolls_store.write_catalogue(build("d", v.nation), path)
    rolls_store.write_catalogue(build("new", v.nation.filter("n_nationkey % 3 = 1")), path, partial=True)
    listed = rolls_store.read_listing(v.spark, path).withColumn("state", F.lit(1))
    index = C.read_index(C.index_documents(listed, "state"))
    documents = rolls_store.read_documents(v.spark, path).select(F.col("district_id").alias("id"), F.col("document").alias("build"))
    return index.join(documents, "id")


_READINGS = "SELECT samiti_id, CASE WHEN panchayat_id % 6 = 0 THEN NULL WHEN panchayat_id % 4 = 1 THEN concat(samiti, ' B') ELSE samiti END AS cover FROM cat_ward WHERE samiti_id % 5 <> 0"


def _readings(v):
    cover = F.when(F.col("panchayat_id") % 6 == 0, F.lit(None).cast("string")).when(F.col("panchayat_id") % 4 == 1, F.concat("samiti", F.lit(" B"))).otherwise(F.col("samiti"))
    return v.cat_ward.filter("samiti_id % 5 <> 0").select("samiti_id", cover.alias("cover"))


_MAJORITY = f"""counted AS (SELECT samiti_id, cover, count(*) AS n FROM ({_READINGS}) r WHERE cover IS NOT NULL GROUP BY samiti_id, cover),
    major AS (SELECT samiti_id, arg_min(cover, (-n, cover)) AS name, count(*) > 1 AS disagree, CAST(sum(n) AS BIGINT) AS readings FROM counted GROUP BY samiti_id)"""


@query(f"WITH {_MAJORITY} SELECT * FROM major")
def majority_name(v):
    return C.majority_names(_readings(v).filter("cover IS NOT NULL"), "samiti_id", "cover")


@query(f"WITH {_MAJORITY} SELECT s.samiti_id, coalesce(m.name, s.samiti) AS name, CASE WHEN r.samiti_id IS NULL THEN 'no cover' WHEN m.name IS NULL THEN 'unreadable' END AS reason FROM (SELECT DISTINCT samiti_id, samiti FROM cat_ward) s LEFT JOIN (SELECT DISTINCT samiti_id FROM ({_READINGS}) x) r ON s.samiti_id = r.samiti_id LEFT JOIN major m ON s.samiti_id = m.samiti_id")
def catalogue_fallbacks(v):
    read = _readings(v)
    names = C.majority_names(read.filter("cover IS NOT NULL"), "samiti_id", "cover").select("samiti_id", F.col("name").alias("cover"))
    readings = read.groupBy("samiti_id").agg(F.count("*").alias("readings")).join(names, "samiti_id", "left")
    return C.cover_fallbacks(v.cat_ward.select("samiti_id", "samiti").distinct(), readings)


_KINDS = "concat(samiti, CASE WHEN samiti_id % 3 = 0 THEN ' Panchayat Samiti' WHEN samiti_id % 3 = 1 THEN ' Nagar Palika' ELSE '' END)"


@query(f"SELECT {_KIND(_KINDS)} AS kind, count(DISTINCT CASE WHEN samiti_id % 3 <> 0 THEN samiti_id END) AS skipped, count(DISTINCT district_id) AS districts, count(DISTINCT samiti_id) AS samitis, count(DISTINCT panchayat_id) AS panchayats, count(*) AS wards, sum(CASE WHEN supplement THEN 1 ELSE 0 END) AS with_supplement FROM cat_ward GROUP BY 1")
def catalogue_summary(v):
    return C.summary(v.cat_ward.withColumn("samiti", F.expr(_KINDS)))


@query(f"""WITH {_JUDGED.format(panchayats='cat_ward')} SELECT panchayat_id, error, detail FROM own WHERE error IS NOT NULL
    UNION ALL SELECT panchayat_id, error, CASE WHEN ward IS NULL THEN ward_text ELSE CAST(ward AS VARCHAR) END FROM judged WHERE error IS NOT NULL""")
def catalogue_errors(v):
    """By the first rule that a panchayat breaks, then by line."""
    return C.errors(v.cat_ward, *_portal(v, v.cat_ward))


_SLUG = "trim(regexp_replace(lower(left(s_name, 17)), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"SELECT s_suppkey, concat(slug, CASE WHEN count(*) OVER (PARTITION BY slug) > 1 THEN concat('-', CAST(s_suppkey AS VARCHAR)) ELSE '' END, '.json') AS file FROM (SELECT s_suppkey, {_SLUG} AS slug FROM supplier) s")
def shard_names(v):
    return C.shard_names(v.supplier.withColumn("s_name", F.substring("s_name", 1, 17)), "s_suppkey", "s_name")


@query("SELECT ward, count(DISTINCT panchayat_id) AS panchayats FROM cat_ward GROUP BY ward HAVING count(DISTINCT panchayat_id) > 1")
def ward_collisions(v):
    return C.ward_collisions(v.cat_ward)


@query("""SELECT DISTINCT concat(CAST(district_id AS VARCHAR), '/', CAST(samiti_id AS VARCHAR), '/', CAST(panchayat_id AS VARCHAR), '/', CAST(ward AS VARCHAR)) AS ward_key, CAST(ward AS VARCHAR) AS ward,
    concat(CAST(district_id AS VARCHAR), '/', CAST(samiti_id AS VARCHAR), '/', CAST(panchayat_id AS VARCHAR), '/', CAST(ward + 1 AS VARCHAR)) AS sibling FROM cat_ward""")
def ward_key(v):
    key = C.ward_key(*(F.col(c) for c in ("district_id", "samiti_id", "panchayat_id", "ward")))
    rows = v.cat_ward.select(key.alias("ward_key"), (F.col("ward") + 1).alias("other"))
    return rows.select("ward_key", C.ward_of_key(F.col("ward_key")).alias("ward"), C.sibling_key(F.col("ward_key"), F.col("other")).alias("sibling"))


@query("""WITH p AS (SELECT district_id, district, samiti_id, samiti, panchayat_id, panchayat, string_agg(CAST(ward AS VARCHAR), ',' ORDER BY ward) AS w FROM cat_ward GROUP BY ALL)
    SELECT district_id, samiti_id, concat('{"district":{"id":', district_id, ',"name":"', district, '"},"id":', samiti_id, ',"name":"', samiti, '","panchayats":[', string_agg(concat('{"id":', panchayat_id, ',"name":"', panchayat, '","wards":[', w, ']}'), ',' ORDER BY panchayat_id), ']}') AS document
    FROM p GROUP BY district_id, district, samiti_id, samiti""")
def catalogue_nested(v):
    return C.nested(v.cat_ward.select("district_id", "district", "samiti_id", "samiti", "panchayat_id", "panchayat", "ward"))


@query("SELECT district_id, panchayat_id, ward, CASE WHEN district_id = 2 THEN 'new' ELSE 'old' END AS build FROM cat_ward WHERE district_id <> 2 OR ward <= 3")
def catalogue_partial_merge(v):
    rows = v.cat_ward.select("district_id", "panchayat_id", "ward")
    old, new = rows.withColumn("build", F.lit("old")), rows.filter("district_id = 2 AND ward <= 3").withColumn("build", F.lit("new"))
    return C.partial_merge(old, new)


@query("SELECT DISTINCT panchayat_id FROM cat_ward WHERE panchayat_id NOT IN (SELECT panchayat_id FROM cat_grid)")
def stale_shards(v):
    return C.stale(v.cat_ward.select("panchayat_id"), v.cat_grid.select("panchayat_id"))


@query("SELECT DISTINCT panchayat_id FROM cat_ward WHERE contains(lower(panchayat), '#00000001') OR contains(lower(samiti), '#00000001')")
def filter_panchayats(v):
    return C.panchayat_filter(v.cat_ward, "#00000001").select("panchayat_id").distinct()


@query("SELECT panchayat_id, ward, 'sarpanch' AS seat FROM cat_ward WHERE panchayat_id = 3 UNION ALL SELECT panchayat_id, ward, 'ward-panch' FROM cat_ward WHERE panchayat_id = 3 AND ward = 2")
def build_selection(v):
    rows = v.cat_ward.select("panchayat_id", "ward")
    return C.selection(rows, "sarpanch", 3).withColumn("seat", F.lit("sarpanch")).unionByName(C.selection(rows, "ward-panch", 3, 2).withColumn("seat", F.lit("ward-panch")))


@query("""SELECT panchayat_id, ward, concat(panchayat, ' (', samiti, ')') AS label, CASE WHEN ward = 1 THEN concat('पंचायत: ', panchayat, ' · सभी वार्ड') ELSE concat('पंचायत: ', panchayat, ' · वार्ड: ', CAST(ward AS VARCHAR)) END AS seat FROM cat_ward""")
def seat_labels(v):
    kind = F.when(F.col("ward") == 1, "sarpanch").otherwise("ward-panch")
    label, seat = C.panchayat_label(F.col("panchayat"), F.col("samiti")), C.seat_label(kind, F.col("panchayat"), F.col("ward").cast("string"))
    return v.cat_ward.select("panchayat_id", "ward", label.alias("label"), seat.alias("seat"))


@query(f"SELECT CAST(district_id AS VARCHAR) AS district, CAST(samiti_id AS VARCHAR) AS samiti, CAST(panchayat_id AS VARCHAR) AS panchayat, CAST(ward AS VARCHAR) AS ward, {_URL} AS url FROM cat_ward WHERE ward % 2 = 0")
def roll_selections(v):
    """A pick for every ward, alternately for a ward seat and for a sarpanch."""
    url = X.ward_url(BASE, F.col("samiti_id"), F.col("panchayat"), F.col("ward"))
    seat = F.when(F.col("ward") % 2 == 0, "ward-panch").otherwise("sarpanch")
    return C.roll_selection(v.cat_ward.select(seat.alias("seat"), "district_id", "samiti_id", "panchayat_id", F.array(F.struct("ward", url.alias("url"))).alias("wards")))


@query("""SELECT panchayat_id, ward AS seat_ward, CASE WHEN ward % 2 = 0 THEN 'ward' ELSE 'sarpanch' END AS seat_type, panchayat, CASE WHEN ward % 2 = 0 THEN CAST(ward AS VARCHAR) END AS ward FROM cat_ward WHERE ward % 3 <> 0""")
def seats_from_picks(v):
    """A pick for every ward; every third has no seat of a known kind."""
    seat = F.when(F.col("ward") % 3 == 0, "other").when(F.col("ward") % 2 == 0, "ward-panch").otherwise("sarpanch")
    picks = v.cat_ward.select("panchayat_id", F.col("ward").alias("seat_ward"), seat.alias("seat"), "panchayat", F.array(F.struct("ward", F.lit("u").alias("url"))).alias("wards"))
    return C.seat_from_pick(picks).select("panchayat_id", "seat_ward", "seat_type", "panchayat", "ward")


@query("""WITH m AS (SELECT doc, pos, y, is_start AS is_serial, NOT is_start AND length(text) % 2 = 0 AS is_mark FROM lines), p AS (SELECT *, max(CASE WHEN is_serial THEN pos END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sp FROM m)
    SELECT DISTINCT p.doc, p.sp AS pos FROM p JOIN m s ON s.doc = p.doc AND s.pos = p.sp WHERE p.is_mark AND abs(s.y - p.y) < 2""")
def struck_marks(v):
    """Lines of even length taken as marks."""
    marked = v.lines.select("doc", "pos", "y", F.col("is_start").alias("is_serial"), (~F.col("is_start") & (F.length("text") % 2 == 0)).alias("is_mark"))
    return rolls.struck_marks(marked)


@query(f"SELECT DISTINCT url FROM (SELECT {_URL} AS url FROM cat_ward WHERE final UNION ALL SELECT concat({_URL}, '?s') FROM cat_ward WHERE supplement) u")
def allowed_urls(v):
    """URLs of a config tree of districts, samitis, panchayats and wards, supplements' too."""
    url = X.ward_url(BASE, F.col("samiti_id"), F.col("panchayat"), F.col("ward"))
    more = F.when(F.col("supplement"), F.array(F.concat(url, F.lit("?s")), F.lit("http://plain"))).otherwise(F.array().cast("array<string>"))
    leaf = v.cat_ward.withColumn("w", F.struct(F.when(F.col("final"), url).alias("pdfUrl"), more.alias("supplementPdfUrls")))
    p = leaf.groupBy("district_id", "samiti_id", "panchayat_id").agg(F.collect_list("w").alias("wards"))
    s = p.groupBy("district_id", "samiti_id").agg(F.collect_list(F.struct("wards")).alias("panchayats"))
    d = s.groupBy("district_id").agg(F.collect_list(F.struct("panchayats")).alias("samitis"))
    return C.allowed_urls(d.select(F.to_json(F.struct(F.array(F.struct("samitis")).alias("districts"))).alias("document")))


_TREE_P = """p AS (SELECT r.district_id, r.samiti_id, string_agg(concat('{{"id":"', c.panchayat_id, '","name":"', {name}, '"}}'), ',' ORDER BY c.panchayat_id) AS ps, count(*) AS n FROM rural r JOIN cat_panchayat c ON c.samiti_id = r.samiti_id GROUP BY ALL),
    s AS (SELECT district_id, string_agg(concat('{{"id":"', samiti_id, '","name":"', samiti, '","kind":"', CASE k WHEN 'rural' THEN 'rural' WHEN 'urban' THEN 'urban' ELSE 'unknown' END, '","panchayats":[', coalesce(ps, ''), ']}}'), ',' ORDER BY samiti_id) AS ss
        FROM (SELECT c.*, {kind} AS k FROM cat_samiti c) c LEFT JOIN p USING (district_id, samiti_id) GROUP BY district_id)"""


@query(f"""WITH {_RURAL}, {_TREE_P.format(name="CASE WHEN r.district_id = 2 THEN concat(c.panchayat, ' N') ELSE c.panchayat END", kind=_KIND('samiti'))},
    d AS (SELECT CASE WHEN r_regionkey = 3 THEN 1 ELSE 0 END AS late, r_regionkey, concat('{{"id":"', r_regionkey, '","name":"', r_name, '","samitis":[', coalesce(ss, ''), ']}}') AS doc FROM region LEFT JOIN s ON r_regionkey = s.district_id),
    k AS (SELECT samiti_id, {_KIND('samiti')} AS k FROM cat_samiti WHERE district_id IN (2, 3))
    SELECT concat('{{"schemaVersion":1,"counts":{{"districts":2,"samitis":', count(*) FILTER (k = 'rural'), ',"panchayats":', (SELECT count(*) FROM cat_panchayat c JOIN rural r ON c.samiti_id = r.samiti_id WHERE r.district_id IN (2, 3)),
        ',"urban":', count(*) FILTER (k = 'urban'), ',"zillaParishad":', count(*) FILTER (k = 'zillaParishad'), ',"other":', count(*) FILTER (k = 'other'), '}},"notes":["first"],"districts":[',
        (SELECT string_agg(doc, ',' ORDER BY late, r_regionkey) FROM d), ']}}') AS document FROM k""")
def catalogue_tree(v):
    """A tree of all districts but one, into which a partial build of two is merged: one in its place, the new one at the end."""
    districts = v.region.select(F.col("r_regionkey").cast("bigint").alias("district_id"), F.col("r_name").alias("district"))
    new = v.cat_panchayat.withColumn("samiti_name", F.lit(None)).join(v.cat_samiti.filter("district_id = 2").select("samiti_id", F.lit(True).alias("two")), "samiti_id", "left")
    new = new.withColumn("panchayat", F.when(F.col("two"), F.concat("panchayat", F.lit(" N"))).otherwise(F.col("panchayat")))
    earlier = C.tree(districts.filter("district_id <> 3"), v.cat_samiti, v.cat_panchayat, ["first"])
    built = C.tree(districts.filter("district_id IN (2, 3)"), v.cat_samiti, new, ["second"])
    return C.merge_trees(earlier, built)


@query("""SELECT DISTINCT path, found FROM (SELECT concat(CAST(district_id AS VARCHAR), '/', CAST(samiti_id AS VARCHAR), '/', CAST(panchayat_id AS VARCHAR), '/', CAST(ward AS VARCHAR)) AS path, true AS found FROM cat_ward
    UNION ALL SELECT concat(CAST(district_id AS VARCHAR), '/', CAST(samiti_id AS VARCHAR), '/', CAST(panchayat_id AS VARCHAR), '/', CAST(ward + 100 AS VARCHAR)), false FROM cat_ward UNION ALL SELECT concat(CAST(district_id AS VARCHAR), '/x'), false FROM cat_ward) p""")
def resolve_ward(v):
    s = lambda c: F.col(c).cast("string")
    head = [s("district_id"), s("samiti_id"), s("panchayat_id")]
    rows = v.cat_ward.select(F.explode(F.array(F.concat_ws("/", *head, s("ward")), F.concat_ws("/", *head, (F.col("ward") + 100).cast("string")), F.concat_ws("/", s("district_id"), F.lit("x")))).alias("path")).distinct()
    return C.resolve(rows, v.cat_ward)


@query("SELECT page_id, count(*) AS links, count(DISTINCT coalesce(href, '')) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) l GROUP BY page_id")
def page_links(v):
    """Links of every saved page; the oracle counts anchors as text, the pages have no other kind."""
    return P.page_rows(v.pages).filter("kind = 'link'").groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("value").alias("targets"))


# decoder quality

_DIFF = """both_ AS (SELECT coalesce(d.serial, e.serial) AS serial, d.serial AS ds, e.serial AS es, d.name AS dn, e.name AS en, d.house AS dh, e.house AS eh, CAST(d.age AS VARCHAR) AS da, CAST(e.age AS VARCHAR) AS ea, CAST(d.struck AS VARCHAR) AS dk, CAST(e.struck AS VARCHAR) AS ek FROM decoded d FULL JOIN expected e ON d.serial = e.serial),
    diff AS (SELECT serial, CASE WHEN ds IS NULL THEN 'missing' ELSE 'extra' END AS field, NULL AS decoded, NULL AS expected FROM both_ WHERE ds IS NULL OR es IS NULL
        UNION ALL SELECT serial, 'name', dn, en FROM both_ WHERE ds = es AND dn IS DISTINCT FROM en UNION ALL SELECT serial, 'house', dh, eh FROM both_ WHERE ds = es AND dh IS DISTINCT FROM eh
        UNION ALL SELECT serial, 'age', da, ea FROM both_ WHERE ds = es AND da IS DISTINCT FROM ea UNION ALL SELECT serial, 'struck', dk, ek FROM both_ WHERE ds = es AND dk IS DISTINCT FROM ek)"""


@query(f"WITH {_DIFF} SELECT * FROM diff")
def compare_entries(v):
    return quality.compare(v.decoded, v.expected)


@query(f"WITH {_DIFF}, w AS (SELECT DISTINCT serial FROM diff WHERE field <> 'extra') SELECT count(*) AS total, sum(CASE WHEN w.serial IS NULL THEN 1 ELSE 0 END) AS matched, sum(CASE WHEN struck THEN 1 ELSE 0 END) AS struck, round(100.0 * sum(CASE WHEN w.serial IS NULL THEN 1 ELSE 0 END) / count(*), 2) AS percent FROM expected e LEFT JOIN w ON e.serial = w.serial")
def score(v):
    return quality.score(v.decoded, v.expected)


@query("SELECT e.serial, coalesce((SELECT arg_max(page, d.serial) FROM decoded d WHERE d.serial <= e.serial), (SELECT arg_min(page, d.serial) FROM decoded d)) AS page FROM expected e WHERE e.serial NOT IN (SELECT serial FROM decoded)")
def asof_page(v):
    return quality.asof_page(v.expected.join(v.decoded, "serial", "left_anti"), v.decoded)


@query("SELECT o_orderpriority AS kind, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, max(o_totalprice) AS top, count(*) AS n FROM orders GROUP BY o_orderpriority")
def percentiles(v):
    return quality.percentiles(v.orders.select(F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("ms")), "kind", "ms")


@query("WITH m AS (SELECT page, serial, row_number() OVER (PARTITION BY page ORDER BY serial) = 1 AS first FROM decoded) SELECT page, serial FROM m ORDER BY first DESC, serial LIMIT (SELECT greatest(20, count(DISTINCT page)) FROM decoded)")
def sample_matched(v):
    return quality.sample_matched(v.decoded.select("page", "serial"), 20)


# streams

_SOUND = "event_id % 23 <> 0 AND event_id % 29 <> 0"


def _logged(v, name: str, batches: int = 6):
    """The log as a folder of files, in order of arrival, and a stream over it whose batches have a file for every core."""
    root, cores = own_path(v.spark, name), v.spark.sparkContext.defaultParallelism
    times = F.col("updated_at").cast("timestamp").alias("updated_at")
    rows = v.sync_log.select("candidate", "seq", "id", times, "device", "ciphertext", "iv", "data")
    rows.repartitionByRange(batches * cores, "updated_at").write.parquet(f"{root}/log")
    return root, jobs.log_stream(v.spark, f"{root}/log", cores)


@query(f"SELECT candidate, id, count(*) AS records FROM (SELECT DISTINCT candidate, id, CASE WHEN id LIKE 'mark:%' THEN 0 ELSE seq END AS k FROM sync_log WHERE {_SOUND}) x GROUP BY candidate, id")
def stream_append(v):
    """Mark ids once per candidate, all other valid records kept."""
    root, stream = _logged(v, "append")
    jobs.pull(jobs.append_once(stream), [jobs.table(f"{root}/table")], f"{root}/checkpoint")
    return jobs.stored(v.spark, f"{root}/table").groupBy("candidate", "id").agg(F.count("*").alias("records"))


@query(f"SELECT candidate, count(*) AS records, CAST(1 AS BIGINT) AS first, count(*) AS last, count(*) AS numbers FROM (SELECT DISTINCT candidate, id, CASE WHEN id LIKE 'mark:%' THEN 0 ELSE seq END AS k FROM sync_log WHERE {_SOUND}) x GROUP BY candidate")
def stream_push(v):
    """The same, numbered on from a stored counter: each candidate's numbers run from 1 without a hole."""
    root, stream = _logged(v, "push")
    jobs.pull(jobs.append_once(stream), [jobs.numbered_table(f"{root}/table")], f"{root}/checkpoint")
    rows = jobs.stored(v.spark, f"{root}/table")
    return rows.groupBy("candidate").agg(
        F.count("*").alias("records"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_distinct("seq").alias("numbers")
    )


_NEWEST = f"SELECT candidate, id, epoch_us(max(updated_at)) // 1000 AS ms FROM sync_log WHERE {_SOUND} GROUP BY candidate, id"


@query(_NEWEST)
def stream_latest(v):
    root, stream = _logged(v, "latest")
    jobs.pull(jobs.newest(stream), [jobs.table(f"{root}/table")], f"{root}/checkpoint")
    return synclog.latest(jobs.stored(v.spark, f"{root}/table")).select("candidate", "id", F.unix_millis("updated_at").alias("ms"))


@query(f"SELECT candidate, ward, count(DISTINCT serial) AS voters FROM {_PAYLOAD} WHERE {_SOUND} AND id = concat('mark:', ward, ':', serial) AND length(worker) BETWEEN 1 AND 100 GROUP BY candidate, ward")
def stream_ward_counts(v):
    """Counts that every batch brings up to date, for the wards it has."""
    root, stream = _logged(v, "counts")
    jobs.pull(jobs.ward_counts(stream), [jobs.keyed_table(f"{root}/table", "candidate", "ward")], f"{root}/checkpoint")
    return jobs.live_counts(v.spark, f"{root}/table")


@query(f"""WITH newest AS (SELECT candidate, ward, serial, arg_max(struct_pack(phone, revoked), (updated_at, -seq)) AS r FROM {_CONTACTS} WHERE {_SOUND} GROUP BY candidate, ward, serial)
    SELECT candidate, ward, serial, r.phone AS phone FROM newest WHERE NOT r.revoked""")
def stream_contacts(v):
    """Voters whose newest well-formed contact record isn't a revocation."""
    root, stream = _logged(v, "contacts")
    jobs.pull(jobs.newest_contacts(stream), [jobs.table(f"{root}/table")], f"{root}/checkpoint")
    return jobs.live_contacts(v.spark, f"{root}/table").select("candidate", "ward", "serial", "phone")


def _messages(v, root: str):
    """Every mark as messages, from files: packing reads the voters several times, and the log behind them is read once."""
    v.marks.select("candidate", "worker", "ward", "serial").distinct().write.parquet(f"{root}/marks")
    tally.encode_messages(v.spark.read.parquet(f"{root}/marks")).write.parquet(f"{root}/packed")
    return v.spark.read.parquet(f"{root}/packed")


@query(f"""WITH RECURSIVE {_MESSAGES}, sent AS (SELECT m.candidate, m.ward, m.serial, CASE WHEN m.worker IN ('w1', 'w2', 'w3') THEN 2 ELSE 1 END AS times FROM (SELECT DISTINCT candidate, worker, ward, serial FROM marks) m),
    live AS (SELECT DISTINCT ward, serial FROM roll WHERE NOT struck),
    synced AS (SELECT DISTINCT candidate, CAST(ward AS BIGINT) AS ward, serial FROM {_PAYLOAD} WHERE {_SOUND} AND seq % 2 = 0 AND id = concat('mark:', ward, ':', serial) AND length(worker) BETWEEN 1 AND 100),
    voters AS (SELECT candidate, ward, serial, CAST(sum(times) AS BIGINT) AS n FROM sent GROUP BY candidate, ward, serial),
    k AS (SELECT v.*, l.serial IS NOT NULL AS inside, y.serial IS NOT NULL AS known FROM voters v LEFT JOIN live l USING (ward, serial) LEFT JOIN synced y USING (candidate, ward, serial)),
    r AS (SELECT *, unnest(range(n)) AS i FROM k)
    SELECT candidate, ward, serial, CASE WHEN NOT inside THEN 'outside' WHEN i = 0 AND NOT known THEN 'new' ELSE 'duplicate' END AS state FROM r""")
def stream_sms(v):
    """Half the log synced, then every mark sent as messages, some workers' twice: each serial new, marked before, or outside the roll."""
    root, cores = own_path(v.spark, "sms"), v.spark.sparkContext.defaultParallelism
    half = v.sync_log.filter("seq % 2 = 0").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    half.select("candidate", "seq", "id", "updated_at", "device", "ciphertext", "iv", "data").repartition(cores).write.parquet(f"{root}/log")
    sms = _messages(v, root)
    again = sms.filter(F.col("worker").isin("w1", "w2", "w3"))
    sms = sms.unionByName(again).select("candidate", "ward", "text")
    sms.limit(0).write.parquet(f"{root}/sms")
    messages = v.spark.readStream.schema(sms.schema).option("maxFilesPerTrigger", cores).parquet(f"{root}/sms")
    reports = jobs.message_marks(messages, v.roll, jobs.log_stream(v.spark, f"{root}/log", cores))
    jobs.pull(reports, [jobs.table(f"{root}/table")], f"{root}/checkpoint")
    sms.repartition(2 * cores).write.mode("append").parquet(f"{root}/sms")
    jobs.pull(reports, [jobs.table(f"{root}/table")], f"{root}/checkpoint")
    return jobs.stored(v.spark, f"{root}/table", jobs.SMS_SCHEMA).select("candidate", "ward", "serial", "state")
