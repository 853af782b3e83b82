"""Queries of search, rolls, households, calls and tallies."""

from __future__ import annotations


from pyspark.sql import functions as F

from wardloom.functions import text as X
from wardloom.operators import calls, households as H, rolls, search, tally
from wardloom.plans.book import Book
from wardloom.plans.text_queries import _HOUSE, phonetic_sql
from wardloom.sources import rolls as store
from wardloom.sources.shared import own_path

book = Book()
query = book.query

_TIER = "CASE WHEN {k} = '{q}' THEN 0 WHEN starts_with({k}, '{q}') THEN 1 WHEN contains({k}, ' {q}') THEN 2 WHEN contains({k}, '{q}') THEN 3 END"


def search_sql(phonetic: str, code: str, where: str = "true", limit: int = 50) -> str:
    keys = [("name", phonetic_sql("name"), phonetic), ("relative", phonetic_sql("relative"), phonetic), ("house", phonetic_sql("house"), phonetic), ("serial", "CAST(serial AS VARCHAR)", code), ("epic", "lower(coalesce(epic, ''))", code)]
    cols = ", ".join(f"{k} AS k_{f}" for f, k, _ in keys)
    found = ", ".join(f"CASE WHEN {t} IS NOT NULL THEN {t} * 10 + {i} END" for i, (f, _, q) in enumerate(keys) if q for t in [_TIER.format(k=f"k_{f}", q=q)])
    return f"""SELECT ward, serial, CAST(best // 10 AS INT) AS tier, CAST(best % 10 AS INT) AS rank FROM (SELECT ward, serial, least({found}) AS best FROM (SELECT ward, serial, {cols} FROM roll WHERE {where}) k) b
        WHERE best IS NOT NULL ORDER BY tier, rank, ward, serial LIMIT {limit}"""


@query(search_sql("sml ring", "smallring", "lower(CAST(ward AS VARCHAR)) IN ('3', '4', '5', '6', '7', '8')"))
def voter_search(v):
    """A two-word name among some wards; the house and other fields could match too."""
    some = search.place_filter(search.with_keys(v.roll), "ward", [3, 4, 5, "06", 7, 8])
    return search.search_voters(some, "small ring").select("ward", "serial", "tier", "rank")


@query("""SELECT pos, CASE WHEN name = 'ring' THEN 0 WHEN starts_with(name, 'ring') THEN 1 WHEN contains(name, ' ring') THEN 2 ELSE 3 END AS tier FROM roll WHERE contains(name, 'ring') ORDER BY tier, serial, pos LIMIT 50""")
def name_search(v):
    return search.search_names(v.roll, "ring", order=("serial", "pos")).select("pos", "tier")


@query("SELECT ward, serial, name FROM roll ORDER BY name, ward, serial LIMIT 50")
def sort_name(v):
    return search.sorted_roll(v.roll, "name").limit(search.LIMIT).select("ward", "serial", "name")


@query("SELECT ward, serial, age FROM roll ORDER BY age NULLS LAST, ward, serial LIMIT 50")
def sort_age(v):
    return search.sorted_roll(v.roll, "age").limit(search.LIMIT).select("ward", "serial", "age")


@query("SELECT ward, serial FROM roll ORDER BY ward, serial LIMIT 50")
def sort_serial(v):
    return search.sorted_roll(v.roll).limit(search.LIMIT).select("ward", "serial")


@query("SELECT ward, serial, gender FROM roll WHERE ward IN (2, 3) AND lower(gender) = 'f'")
def filter_place_gender(v):
    return search.place_filter(search.place_filter(v.roll, "ward", ["02", 3]), "gender", "f").select("ward", "serial", "gender")


@query("SELECT ward, serial, age FROM roll WHERE age BETWEEN 30 AND 45")
def filter_age(v):
    return search.age_filter(v.roll, 30, 45).select("ward", "serial", "age")


_PHONE = "CASE WHEN regexp_full_match(regexp_replace(replace(phone, ' ', ''), '^(\\+91|0)', ''), '[0-9]{10}') THEN regexp_replace(replace(phone, ' ', ''), '^(\\+91|0)', '') END"
_CONSENT = f"""island AS (SELECT *, sum(CASE WHEN revoked THEN 1 ELSE 0 END) OVER (PARTITION BY candidate, ward, serial ORDER BY seq) AS n, {_PHONE} AS number FROM contacts),
    current AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY candidate, ward, serial) AS last FROM island) x WHERE n = last AND NOT revoked),
    consented AS (SELECT candidate, ward, serial, arg_min(consent_at, seq) AS consent_at, arg_max(number, seq) FILTER (WHERE number IS NOT NULL) AS phone FROM current GROUP BY candidate, ward, serial)"""


@query(f"WITH {_CONSENT} SELECT candidate, r.ward, r.serial FROM roll r JOIN consented c ON r.ward = c.ward AND r.serial = c.serial WHERE phone IS NOT NULL")
def semi_lookup(v):
    """For each team, the voters whose number it may use."""
    has = calls.consent_state(v.contacts).filter("phone IS NOT NULL")
    has = has.select("candidate", X.voter_key(F.col("ward"), F.col("serial")).alias("voter_key"))
    return search.team_lookup(v.roll, has).select("candidate", "ward", "serial")


@query("SELECT ward, serial FROM roll WHERE concat(ward, ':', serial) IN (SELECT voter_key FROM tags WHERE value = 'undecided')")
def tag_lookup(v):
    return search.lookup_filter(v.roll, v.tags, "undecided").select("ward", "serial")


@query("SELECT ward, serial FROM roll WHERE (ward, serial) NOT IN (SELECT (1 + serial % 25, serial) FROM assignments)")
def anti_lookup(v):
    called = v.assignments.select(X.voter_key(1 + F.col("serial") % 25, F.col("serial")).alias("voter_key"))
    return search.lookup_filter(v.roll, called, negate=True).select("ward", "serial")


@query("SELECT ward, serial, -1 AS tier FROM roll WHERE ward = 3 AND serial = 5")
def jump_lookup(v):
    return search.search_voters(search.with_keys(v.roll), " 3 / ५ ").filter(F.col("tier") == search.JUMP).select("ward", "serial", "tier")


@query(search_sql("sml ring", "smallring"))
def indexed_search(v):
    """The same search over all wards by a stored index, some of whose wards were replaced: only its grams' buckets are read."""
    keyed = search.with_keys(v.roll)
    path = own_path(v.spark, "roll-grams")
    other = F.when(F.col("ward").isin(3, 4, 5), F.reverse("name")).otherwise(F.col("name"))
    search.write_index(search.with_keys(v.roll.withColumn("name", other)), path)
    search.write_index(keyed.filter("ward IN (3, 4, 5)"), path)
    return search.search_voters(keyed, "small ring", index=search.read_index(v.spark, path)).select("ward", "serial", "tier", "rank")


@query("SELECT ward, serial, count(*) OVER () >= 50 AS capped FROM (SELECT ward, serial FROM roll WHERE contains(CAST(serial AS VARCHAR), '1') AND ward <= 2 ORDER BY CAST(serial AS VARCHAR) <> '1', NOT starts_with(CAST(serial AS VARCHAR), '1'), ward, serial LIMIT 50) x")
def capped_search(v):
    """A search by serial that finds more than it may show."""
    some = search.with_keys(search.place_filter(v.roll, "ward", ["1", "2"]).select("ward", "serial", *(F.lit("").alias(c) for c in ("name", "relative", "house", "epic"))))
    return search.with_capped(search.search_voters(some, "1")).select("ward", "serial", "capped")


@query(f"SELECT doc_id FROM (SELECT doc_id, {phonetic_sql('text')} AS key FROM documents) k WHERE contains(key, 'ton') AND contains(key, 'oni') AND contains(key, 'nin')")
def gram_candidates(v):
    index = search.grams(v.documents.select("doc_id", X.phonetic_key(F.col("text")).alias("key")), "doc_id", "key")
    return search.gram_candidates(index, "doc_id", "tonin")


_PASSAGES = f"""WITH q AS (SELECT item_id, {phonetic_sql('text')} AS q FROM benchmark), c AS (SELECT doc_id, {phonetic_sql('text')} AS key FROM documents),
    m AS (SELECT item_id, doc_id, CASE WHEN key = q THEN 0 WHEN starts_with(key, q) THEN 1 WHEN contains(key, concat(' ', q)) THEN 2 ELSE 3 END AS tier FROM q JOIN c ON contains(key, q) WHERE length(q) >= 3)
    SELECT item_id, CAST(place AS INT) AS place, doc_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY tier, doc_id) AS place FROM m) r WHERE place <= 10"""


def _passages(v, **how):
    """The documents' keys are stored once, as a corpus that is searched often would have them."""
    path = own_path(v.spark, "keys")
    v.documents.select("doc_id", X.phonetic_key(F.col("text")).alias("key")).write.parquet(path)
    corpus = v.spark.read.schema("doc_id bigint, key string").parquet(path)
    asked = v.benchmark.select("item_id", X.phonetic_key(F.col("text")).alias("key")).filter(F.length("key") >= search.GRAM)
    return search.batch_search(corpus, asked, 10, id_col="doc_id", query_col="item_id", **how)


@query(_PASSAGES)
def batch_search(v):
    """Every benchmark passage, whole, against all documents, ten best each."""
    return _passages(v)


@query(_PASSAGES)
def batch_search_passages(v):
    """The same by joins, as for more queries than tasks can hold."""
    return _passages(v, small=0)


@query("""WITH f AS (SELECT DISTINCT 'ward' AS facet, CAST(ward AS VARCHAR) AS value FROM roll UNION ALL SELECT DISTINCT 'booth', CAST(booth AS VARCHAR) FROM roll UNION ALL SELECT DISTINCT 'gender', gender FROM roll)
    SELECT facet, value, CAST(row_number() OVER (PARTITION BY facet ORDER BY try_cast(value AS BIGINT) NULLS LAST, value) AS INT) AS place FROM f""")
def facets(v):
    return search.facets(v.roll, ["ward", "booth", "gender"])


# rolls

_TAGGED = "CASE WHEN pos % 17 = 0 THEN 'deletion' WHEN pos % 13 = 0 THEN 'addition' WHEN pos % 7 = 0 THEN 'other' END"
_MINIMISED = f"""SELECT ward, serial, name, relative, age, gender, coalesce(house, '') AS house, struck,
    CASE WHEN pos % 17 = 0 THEN 'deletion' WHEN pos % 13 = 0 THEN 'addition' END AS supplement FROM roll WHERE pos % 19 <> 0"""


def _tagged(v):
    """The roll with supplements' tags, some of no known kind; some serials aren't whole."""
    serial = F.col("serial") + F.when(F.col("pos") % 19 == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return v.roll.withColumns({"supplement": F.expr(_TAGGED), "serial": serial})


@query(_MINIMISED)
def minimise(v):
    return rolls.minimise(_tagged(v))


@query(f"SELECT ward, serial, name, age FROM ({_MINIMISED}) m WHERE ward IN (2, 5) AND supplement IS DISTINCT FROM 'deletion'")
def roll_scan(v):
    """Written by ward and read back for two of them, without deleted entries."""
    path = own_path(v.spark, "rolls")
    store.write_rolls(rolls.minimise(_tagged(v)), path)
    return rolls.hide_deletions(store.read_rolls(v.spark, path, [2, 5])).select("ward", "serial", "name", "age")


@query(f"""SELECT ward, count(m.serial) AS entries, count(CASE WHEN supplement = 'deletion' THEN 1 END) AS deletions, CASE WHEN ward = 3 THEN 'merged' WHEN ward = 4 THEN 'failed' ELSE 'none' END AS state,
    CASE WHEN ward = 3 THEN 'a,b' ELSE '' END AS urls FROM (SELECT DISTINCT ward FROM roll) w LEFT JOIN (SELECT * FROM ({_MINIMISED}) x WHERE ward <> 4 AND (ward <> 3 OR serial <= 5)) m USING (ward) GROUP BY ward""")
def roll_overwrite(v):
    """All wards written, then two of them replaced with what their supplements came to, one by nothing."""
    path = own_path(v.spark, "rolls")
    entries = rolls.minimise(_tagged(v))
    store.write_rolls(entries, path)
    states = v.spark.createDataFrame([(3, "merged", ["a", "b"]), (4, "failed", [])], "ward bigint, state string, urls array<string>")
    store.write_rolls(entries.filter("ward = 3 AND serial <= 5"), path, states)
    found = store.read_rolls(v.spark, path).groupBy("ward").agg(F.count("*").alias("entries"), F.count_if(F.col("supplement") == "deletion").alias("deletions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return store.read_states(v.spark, path).join(found, "ward", "left").select("ward", zero("entries"), zero("deletions"), "state", F.array_join("urls", ",").alias("urls"))


_SUPP = """based AS (SELECT ward, serial, pos, name, age, struck, CASE WHEN pos % 17 = 0 THEN 'deletion' END AS tag FROM roll),
    every AS (SELECT ward, serial, 0 AS pub, pos, name, age, struck, tag FROM based UNION ALL SELECT ward, serial, pub, pos, name, NULL, struck, NULL FROM supp),
    ordered AS (SELECT *, lag(struck) OVER w AS before, row_number() OVER w AS n FROM every WINDOW w AS (PARTITION BY ward, serial ORDER BY pub, pos)),
    changes AS (SELECT *, CASE WHEN n = 1 THEN pub <> 0 ELSE struck <> before END AS change FROM ordered),
    merged AS (SELECT ward, serial, arg_min(pos, (pub, pos)) AS pos, arg_min(name, (pub, pos)) AS name, max(age) AS age, arg_max(struck, (pub, pos)) AS struck,
        coalesce(arg_max(CASE WHEN struck THEN 'deletion' ELSE 'addition' END, (pub, pos)) FILTER (WHERE change), max(tag)) AS supplement FROM changes GROUP BY ward, serial)"""


def _base(v):
    return v.roll.select("ward", "serial", "pos", "name", "age", "struck", F.when(F.col("pos") % 17 == 0, "deletion").alias("supplement"))


def _merged(v):
    return rolls.apply_supplements(_base(v), v.supp)


@query(f"WITH {_SUPP} SELECT * FROM merged")
def apply_supplements(v):
    return _merged(v)


@query(f"WITH {_SUPP} SELECT * FROM merged")
def apply_supplements_staged(v):
    """Each year's supplements merged into what came out before: equal to one merge."""
    out = rolls.apply_supplements(_base(v), v.supp.filter("pub <= 1994"))
    return rolls.apply_supplements(rolls.apply_supplements(out, v.supp.filter("pub = 1995")), v.supp.filter("pub > 1995"))


@query(f"WITH {_SUPP} SELECT ward, serial FROM merged WHERE coalesce(supplement, '') <> 'deletion'")
def hide_deletions(v):
    return rolls.hide_deletions(_merged(v)).select("ward", "serial")


@query("SELECT ward, serial FROM roll WHERE NOT struck")
def live_entries(v):
    return v.roll.filter(~F.col("struck")).select("ward", "serial")


@query(f"WITH {_SUPP} SELECT ward, sum(CASE WHEN struck THEN 0 ELSE 1 END) AS live, sum(CASE WHEN struck THEN 1 ELSE 0 END) AS struck, sum(CASE WHEN supplement = 'deletion' THEN 1 ELSE 0 END) AS deletions FROM merged GROUP BY ward")
def roll_counts(v):
    return rolls.roll_counts(_merged(v), "ward")


_FILES = "SELECT ward, pub, min(pos) % 7 <> 0 AS ok FROM supp GROUP BY ward, pub"


@query(f"WITH files AS ({_FILES}), first AS (SELECT ward, min(CASE WHEN NOT ok THEN pub END) AS f FROM files GROUP BY ward) SELECT ward, pub, f IS NOT NULL AS failed FROM files JOIN first USING (ward) WHERE f IS NULL OR pub < f")
def supp_prefix(v):
    return rolls.loaded_supplements(v.supp.groupBy("ward", "pub").agg((F.min("pos") % 7 != 0).alias("ok")))


@query("""WITH l AS (SELECT ward, list(DISTINCT pub ORDER BY pub) AS listed FROM supp GROUP BY ward), m AS (SELECT ward, listed, CASE WHEN ward % 3 = 0 THEN listed WHEN ward % 3 = 1 THEN listed[1:2] ELSE list_reverse(listed) END AS merged FROM l)
    SELECT ward, CASE WHEN merged = listed THEN 'current' WHEN listed[1:len(merged)] = merged THEN 'resume' ELSE 'rebuild' END AS plan FROM m""")
def supp_plan(v):
    listed = v.supp.groupBy("ward").agg(F.sort_array(F.collect_set("pub")).alias("listed"))
    merged = F.when(F.col("ward") % 3 == 0, F.col("listed")).when(F.col("ward") % 3 == 1, F.slice("listed", 1, 2)).otherwise(F.reverse("listed"))
    return rolls.supplement_plan(listed.withColumn("merged", merged)).select("ward", "plan")


_GIVEN = "split_part(name, ' ', 1)"
_PRINTED_SEX = "CASE WHEN gender = 'F' THEN 'स्त्री' ELSE 'पुरुष' END"
_PRINTED_EPIC = "CASE WHEN pos % 3 <> 0 THEN concat('RJA', lpad(CAST(pos % 1000000 AS STRING), 6, '0')) END"


@query(f"""SELECT ward AS doc, row_number() OVER (PARTITION BY ward ORDER BY serial) AS record, serial, struck, name, CASE WHEN pos % 2 = 0 THEN 'पति' ELSE 'पिता' END AS relation,
    relative, age, {_PRINTED_SEX} AS gender, house, {_PRINTED_EPIC.replace('STRING', 'VARCHAR')} AS epic, CASE WHEN pos % 5 = 0 THEN 'aside' ELSE '' END AS extra
    FROM (SELECT ward, serial, pos, name, relative, age, gender, struck, coalesce(CAST(pos % 90 AS VARCHAR), '') AS house FROM roll) r WHERE pos % 29 <> 0""")
def segment_records(v):
    """The roll printed as lines, a page to a ward, and read back; entries whose serial wasn't printed are lost."""
    line = lambda k, x, y, text, bold=False: F.struct(F.lit(k).alias("k"), F.lit(float(x)).alias("x"), (F.col("serial") * 100.0 + y).alias("y"), F.lit(bold).alias("serial_font"), text.alias("text"))
    t = F.lit
    printed = F.array(
        line(0, 0, 0, t("नाम :")), line(1, 5, 0.5, F.expr(_GIVEN)), line(2, 9, 0.3, F.expr(f"CASE WHEN name <> {_GIVEN} THEN substring(name, length({_GIVEN}) + 2) END")),
        line(3, 0, 10, F.when(F.col("pos") % 2 == 0, "पति का नाम :").otherwise("पिता का नाम")), line(4, 6, 10.5, F.col("relative")),
        line(5, 0, 20, t("मकान संख्या :")), line(6, 6, 19, (F.col("pos") % 90).cast("string")), line(7, 0, 30, t("आयु :")), line(8, 3, 30, F.col("age").cast("string")),
        line(9, 6, 30, t("लिंग :")), line(10, 9, 30, F.expr(_PRINTED_SEX)), line(11, 3, 40, F.expr(_PRINTED_EPIC)), line(12, 20, 20, t("Photo is")),
        line(13, 0, 50, F.when(F.col("pos") % 5 == 0, "aside")), line(14, 1, 60, F.when(F.col("pos") % 29 != 0, F.col("serial").cast("string")), True),
        line(15, 4, 61, F.when(F.col("struck"), "O"), True), line(16, 4, 70, t("E"), True),
    )
    lines = v.roll.select(F.col("ward").alias("doc"), "serial", F.explode(printed).alias("l")).filter("l.text IS NOT NULL")
    lines = lines.select("doc", (F.col("serial") * 20 + F.col("l.k")).alias("pos"), "l.x", "l.y", "l.serial_font", "l.text")
    return rolls.segment_records(lines).withColumn("extra", F.array_join("extra", ","))


@query("""SELECT l_partkey AS serial, arg_min(l_linenumber, (l_linenumber, l_orderkey, l_suppkey, l_quantity, l_extendedprice)) AS page, arg_min(l_suppkey, (l_linenumber, l_orderkey, l_suppkey, l_quantity, l_extendedprice)) AS name, bool_or(l_returnflag = 'R') AS struck, count(*) AS records
    FROM lineitem GROUP BY l_partkey""")
def page_dedupe(v):
    rows = v.lineitem.select(F.col("l_partkey").alias("serial"), F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("name"), (F.col("l_returnflag") == "R").alias("struck"), "l_orderkey", "l_quantity", "l_extendedprice")
    return rolls.page_dedupe(rows, "serial", ["page", "l_orderkey", "name", "l_quantity", "l_extendedprice"], ["page", "name"])


# households

_HOUSES = f"""SELECT ward, key, arg_min(trim(house), pos) AS house, count(*) AS size, string_agg(CAST(serial AS VARCHAR), ',' ORDER BY serial) AS members
    FROM (SELECT *, {_HOUSE('house')} AS key FROM roll WHERE NOT struck) h WHERE key <> '' GROUP BY ward, key"""


def _serials():
    return F.array_join(F.transform("members", lambda m: m["serial"]), ",").alias("members")


@query(_HOUSES)
def households(v):
    return H.households(v.roll).select("ward", "key", "house", "size", _serials())


@query(f"SELECT ward, key, members FROM ({_HOUSES}) h WHERE key = '1/2'")
def find_household(v):
    return H.find_household(H.households(v.roll), " १ / 2 ").select("ward", "key", _serials())


_VALUES = "(SELECT voter_key, string_agg(DISTINCT value, ', ' ORDER BY value) AS value FROM {} GROUP BY voter_key)"


@query(f"""WITH {_CONSENT} SELECT candidate, r.ward, r.key, r.serial, r.name, c.phone, t.value AS tag, s.value AS visit FROM (SELECT *, {_HOUSE('house')} AS key FROM roll WHERE NOT struck) r
    LEFT JOIN consented c ON r.ward = c.ward AND r.serial = c.serial LEFT JOIN {_VALUES.format('tags')} t ON t.voter_key = concat(r.ward, ':', r.serial)
    LEFT JOIN {_VALUES.format('visits')} s ON s.voter_key = concat(r.ward, ':', r.serial) WHERE r.key <> ''""")
def household_members(v):
    return H.household_members(H.households(v.roll), calls.consent_state(v.contacts), v.tags, v.visits)


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS members FROM conversations GROUP BY conv_id")
def ordered_members(v):
    return H.ordered_members(v.conversations, "conv_id", "turn", "text").select("conv_id", F.array_join("members", "\n").alias("members"))


# calls


@query(f"WITH {_CONSENT} SELECT candidate, ward, serial, phone, epoch_us(consent_at) // 1000 AS since FROM consented")
def consent_state(v):
    return calls.consent_state(v.contacts).select("candidate", "ward", "serial", "phone", F.unix_millis(F.col("consent_at").cast("timestamp")).alias("since"))


@query(f"WITH {_CONSENT} SELECT candidate, c.ward, c.serial, phone, worker_id, coalesce(r.name, '') AS name FROM consented c LEFT JOIN assignments a ON c.serial = a.serial LEFT JOIN roll r ON c.ward = r.ward AND c.serial = r.serial")
def call_list(v):
    return calls.call_list(calls.consent_state(v.contacts), v.assignments, v.roll).select("candidate", "ward", "serial", "phone", "worker_id", "name")


@query(f"WITH {_CONSENT} SELECT candidate, min(ward) AS ward, serial, concat(CAST(min(ward) AS VARCHAR), ':', CAST(serial AS VARCHAR)) AS voter_key FROM consented WHERE serial IN (SELECT serial FROM assignments) GROUP BY candidate, serial HAVING count(DISTINCT ward) = 1")
def called_lookup(v):
    """Every team's consented voters' serials against the assignments, which carry no ward."""
    return calls.called_lookup(calls.consent_state(v.contacts), v.assignments)


@query("""SELECT concat('w', CAST(n_nationkey AS VARCHAR)) AS worker_id, n_name AS worker_name FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT worker_id, min(worker_name) FROM assignments WHERE worker_id NOT IN (SELECT concat('w', CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_nationkey % 2 = 0) GROUP BY worker_id""")
def roster_union(v):
    roster = v.nation.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("w"), F.col("n_nationkey").cast("string")).alias("worker_id"), F.col("n_name").alias("worker_name"))
    return calls.roster_union(roster, v.assignments)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS worker_id, s_name AS worker_name FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT concat('new-', left(sha256(s_name), 8)), s_name FROM supplier WHERE s_suppkey % 2 = 1""")
def roster_add(v):
    roster = v.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("worker_id"), F.col("s_name").alias("worker_name"))
    return calls.add_workers(roster, v.supplier.select(F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("name")))


@query("""SELECT serial, worker_id FROM (SELECT user_id AS serial, arg_max(CASE WHEN event_type = 'error' THEN '' ELSE concat('w', CAST(event_id % 9 AS VARCHAR)) END, event_id) AS worker_id FROM events GROUP BY user_id) s WHERE worker_id <> ''""")
def assignment_state(v):
    log = v.events.select(F.col("user_id").alias("serial"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.concat(F.lit("w"), (F.col("event_id") % 9).cast("string"))).alias("worker_id"))
    return calls.assignment_state(log)


# tallies

_FIRST = "SELECT candidate, ward, serial, arg_min(worker, seq) AS worker, min(seq) AS seq FROM marks GROUP BY candidate, ward, serial"


@query(_FIRST)
def first_mark(v):
    return tally.first_marks(v.marks).select("candidate", "ward", "serial", "worker", "seq")


@query(_FIRST)
def mark_set_merge(v):
    """Two overlapping halves, the second first."""
    a, b = v.marks.filter("seq % 3 <> 0"), v.marks.filter("seq % 3 <> 1")
    return tally.merge_marks(b, a).select("candidate", "ward", "serial", "worker", "seq")


@query("SELECT candidate, ward, count(DISTINCT serial) AS voters FROM marks WHERE serial % 10 <> 0 GROUP BY candidate, ward UNION ALL SELECT candidate, NULL, count(DISTINCT (ward, serial)) FROM marks WHERE serial % 10 <> 0 GROUP BY candidate")
def ward_counts(v):
    return tally.ward_counts(v.marks, v.marks.filter("serial % 10 = 0"))


@query(f"SELECT candidate, ward, serial, worker, seq FROM ({_FIRST}) f ORDER BY candidate, ward, serial")
def sorted_marks(v):
    return tally.sorted_marks(v.marks.select("candidate", "ward", "serial", "worker", "seq")).select("candidate", "ward", "serial", "worker", "seq")


@query(f"SELECT candidate, ward, worker, count(*) AS voters FROM ({_FIRST}) f WHERE (ward, serial) IN (SELECT (ward, serial) FROM roll WHERE NOT struck) GROUP BY candidate, ward, worker")
def worker_counts(v):
    return tally.worker_counts(v.marks, v.roll)


@query(f"SELECT candidate, ward, serial, (ward, serial) IN (SELECT (ward, serial) FROM roll WHERE NOT struck) AS inside FROM ({_FIRST}) f")
def in_roll_split(v):
    return tally.in_roll(tally.first_marks(v.marks), v.roll).select("candidate", "ward", "serial", "inside")


@query("""WITH a AS (SELECT DISTINCT candidate, ward, serial FROM marks), b AS (SELECT DISTINCT candidate, ward, serial + seq % 3 AS serial FROM marks)
    SELECT coalesce(a.candidate, b.candidate) AS candidate, coalesce(a.ward, b.ward) AS ward, coalesce(a.serial, b.serial) AS serial, CASE WHEN a.serial IS NULL THEN 'new' WHEN b.serial IS NOT NULL THEN 'duplicate' ELSE 'applied' END AS state
    FROM a FULL JOIN b ON a.candidate = b.candidate AND a.ward = b.ward AND a.serial = b.serial""")
def tally_union(v):
    """All marks as applied, against the same with some serials shifted."""
    return tally.union_tally(v.marks, v.marks.withColumn("serial", F.col("serial") + F.col("seq") % 3))


@query("""SELECT candidate, coalesce(c.ward, o.ward) AS ward, voters, official FROM (SELECT candidate, ward, count(DISTINCT serial) AS voters FROM marks GROUP BY candidate, ward) c
    FULL JOIN (SELECT CAST(n_nationkey + 3 AS BIGINT) AS ward, CAST(n_nationkey * 10 AS BIGINT) AS official FROM nation) o ON c.ward = o.ward""")
def turnout_vs_count(v):
    """Every team's counts beside the official figures of their wards."""
    counts = tally.ward_counts(v.marks).filter("ward IS NOT NULL")
    official = v.nation.select((F.col("n_nationkey") + 3).cast("bigint").alias("ward"), (F.col("n_nationkey") * 10).cast("bigint").alias("official"))
    return tally.turnout_beside_counts(counts, official)
