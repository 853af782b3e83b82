"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardloom.functions import text as X
from wardloom.operators import rolls, search, synclog, tally
from wardloom.plans.book import Book

book = Book()
query = book.query

WS = f"[{X.WHITE}]"
_STRIP = lambda e: f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"
_DIGITS = lambda e: f"translate({e}, '{X.DEVANAGARI_DIGITS}', '{X.ASCII_DIGITS}')"
_PART = lambda e: f"CASE WHEN regexp_full_match({_STRIP(_DIGITS(e))}, '[0-9]+') THEN coalesce(nullif(ltrim({_STRIP(_DIGITS(e))}, '0'), ''), '0') ELSE {_STRIP(_DIGITS(e))} END"


def _swap(e: str, table: dict[str, str]) -> str:
    return f"translate({e}, '{''.join(table)}', '{''.join(table.values())}')"


def phonetic_sql(e: str) -> str:
    """The phonetic key in DuckDB's dialect, whose patterns have no back-references or lookahead."""
    s = _swap(f"lower(coalesce({e}, ''))", {**X.NUKTA_LETTERS, **{a: b for a, b in X.ACCENTED.items() if a == a.lower()}})
    s = f"regexp_replace({s}, '[{X.SILENT}]', '', 'g')"
    s = f"replace(replace({s}, 'ंह', 'ngह'), 'ँह', 'ngह')"
    for letter, sound in X.SYLLABLES.items():
        s = f"replace({s}, '{letter}', '{sound}')"
    s = _swap(s, {**X.LETTERS, **dict(zip(X.DEVANAGARI_DIGITS, X.ASCII_DIGITS, strict=True))})
    s = f"ltrim(regexp_replace(replace(regexp_replace({s}, '[^a-z0-9]', ' ', 'g'), 'a', ''), ' +', ' ', 'g'))"
    s = f"regexp_replace(replace(replace({s}, 'ee', 'i'), 'oo', 'u'), '([kgcjtdpbs])h+', '\\1', 'g')"
    s = f"regexp_replace(replace(replace({s}, 'mp', 'np'), 'mb', 'nb'), 'y( |$)', 'i\\1', 'g')"
    for c in "bcdefghijklmnopqrstuvwxyz":
        s = f"regexp_replace({s}, '{c}{c}+', '{c}', 'g')"
    return f"rtrim({s})"


NUMBERS = r"\+?[0-9][0-9 ().-]{8,16}[0-9]"


@query(f"""SELECT doc_id, trim(regexp_replace(translate(regexp_replace({_swap("coalesce(text, '')", X.NUKTA_LETTERS)}, '[‌‍़]', '', 'g'), 'ँ', 'ं'), '{WS}+', ' ', 'g')) AS norm FROM documents""")
def text_normalise(v):
    return v.documents.select("doc_id", X.normalise(F.col("text")).alias("norm"))


@query(f"SELECT pos, {_DIGITS('house')} AS house FROM roll")
def ascii_digits(v):
    return v.roll.select("pos", X.ascii_digits(F.col("house")).alias("house"))


@query(f"""SELECT doc_id AS id, 'document' AS kind, {phonetic_sql('text')} AS key FROM documents
    UNION ALL SELECT pos, 'name', {phonetic_sql('name')} FROM roll""")
def phonetic_key(v):
    key = X.phonetic_key
    return v.documents.select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), key(F.col("text")).alias("key")).unionByName(
        v.roll.select(F.col("pos").alias("id"), F.lit("name").alias("kind"), key(F.col("name")).alias("key"))
    )


@query(f"SELECT pos, regexp_replace(lower({_DIGITS("coalesce(epic, '')")}), '[^a-z0-9]', '', 'g') AS key FROM roll")
def code_key(v):
    return v.roll.select("pos", X.code_key(F.col("epic")).alias("key"))


@query(f"SELECT pos, concat({_PART('CAST(ward AS VARCHAR)')}, ':', {_PART('CAST(serial AS VARCHAR)')}) AS key FROM roll")
def voter_key(v):
    return v.roll.select("pos", X.voter_key(F.col("ward"), F.col("serial")).alias("key"))


@query(r"""SELECT page_id, CAST(nullif(regexp_extract(t, '^ *([0-9]+) */ *([0-9]+) *$', 1), '') AS BIGINT) AS ward, CAST(nullif(regexp_extract(t, '^ *([0-9]+) */ *([0-9]+) *$', 2), '') AS BIGINT) AS serial
    FROM (SELECT page_id, concat(' ', CAST(page_id % 40 AS VARCHAR), ' / ', regexp_extract(url, '/([0-9]+)', 1)) AS t FROM pages) x""")
def parse_ward_serial(v):
    t = F.concat(F.lit(" "), (F.col("page_id") % 40).cast("string"), F.lit(" / "), F.regexp_extract("url", "/([0-9]+)", 1))
    return v.pages.select("page_id", X.parse_ward_serial(t).alias("p")).select("page_id", "p.ward", "p.serial")


_HOUSE = lambda e: f"lower(regexp_replace({_STRIP(_DIGITS(f"coalesce({e}, '')"))}, '{WS}*([/-]){WS}*', '\\1', 'g'))"


@query(f"SELECT pos, {_HOUSE('house')} AS key FROM roll")
def house_key(v):
    return v.roll.select("pos", X.house_key(F.col("house")).alias("key"))


def _found(v):
    return v.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(NUMBERS), F.lit(0))).alias("nth", "raw"))


_FOUND = f"(SELECT doc_id, CAST(unnest(range(len(f))) AS INT) AS nth, unnest(f) AS raw FROM (SELECT doc_id, regexp_extract_all(text, '{NUMBERS}') AS f FROM documents) x) y"


@query(f"""SELECT doc_id, nth, CASE WHEN regexp_full_match(s, '[0-9]{{10}}') THEN s END AS phone FROM (SELECT doc_id, nth, regexp_replace(replace(raw, ' ', ''), '^(\\+91|0)', '') AS s FROM {_FOUND}) z""")
def normalise_phone(v):
    return _found(v).select("doc_id", "nth", X.phone(F.col("raw")).alias("phone"))


@query(f"""SELECT doc_id, nth, CASE WHEN regexp_full_match(s, '(0|91)?[6-9][0-9]{{9}}') THEN concat('+91', right(s, 10)) WHEN regexp_full_match(s, '\\+[1-9][0-9]{{7,14}}') THEN s END AS phone
    FROM (SELECT doc_id, nth, regexp_replace(regexp_replace(raw, '[ ().-]', '', 'g'), '^00', '+') AS s FROM {_FOUND}) z""")
def normalise_intl_phone(v):
    return _found(v).select("doc_id", "nth", X.international_phone(F.col("raw")).alias("phone"))


@query(f"SELECT pos, CASE WHEN regexp_full_match({_STRIP(_DIGITS('house'))}, '[0-9]+') THEN CAST({_STRIP(_DIGITS('house'))} AS BIGINT) END AS n FROM roll")
def parse_count(v):
    return v.roll.select("pos", X.whole_number(F.col("house")).alias("n"))


@query("SELECT c_custkey, CASE WHEN regexp_full_match(c_name, '[A-Za-z0-9_-]{1,16}') THEN c_name ELSE left(sha256(c_name), 16) END AS tag FROM customer")
def team_tag(v):
    return v.customer.select("c_custkey", X.team_tag(F.col("c_name")).alias("tag"))


_KIND = lambda e: f"CASE WHEN regexp_matches({e}, '{X.ZILLA}') THEN 'zillaParishad' WHEN regexp_matches({e}, '{X.URBAN}') THEN 'urban' WHEN regexp_matches({e}, '{X.RURAL}') THEN 'rural' ELSE 'other' END"
_BODY = "concat(n_name, CASE n_nationkey % 4 WHEN 0 THEN ' Panchayat Samiti' WHEN 1 THEN ' NAGAR PALIKA' WHEN 2 THEN ' Zilla Parishad' ELSE '' END)"


@query(f"SELECT n_nationkey, {_KIND(_BODY)} AS kind FROM nation")
def entry_kind(v):
    ends = F.when(F.col("n_nationkey") % 4 == 0, " Panchayat Samiti").when(F.col("n_nationkey") % 4 == 1, " NAGAR PALIKA").when(F.col("n_nationkey") % 4 == 2, " Zilla Parishad").otherwise("")
    return v.nation.select("n_nationkey", X.entry_kind(F.concat("n_name", ends)).alias("kind"))


BASE = f"https://{X.ROLL_HOST}/Publication_PDF_2026/PRI/Final"
_URL = f"concat('{BASE}/', CAST(samiti_id AS VARCHAR), '/', url_encode(upper(panchayat)), '-Ward%20No-', lpad(CAST(ward AS VARCHAR), 3, '0'), '.pdf')"


@query(f"SELECT panchayat_id, ward, {_URL} AS url FROM cat_ward")
def ward_url(v):
    return v.cat_ward.select("panchayat_id", "ward", X.ward_url(BASE, F.col("samiti_id"), F.col("panchayat"), F.col("ward")).alias("url"))


@query(f"SELECT page_id, false AS allowed, url FROM pages UNION ALL SELECT panchayat_id * 100 + ward, ward % 2 = 0, CASE WHEN ward % 2 = 0 THEN {_URL} ELSE concat({_URL}, '?x=1') END FROM cat_ward")
def url_allowed(v):
    url = X.ward_url(BASE, F.col("samiti_id"), F.col("panchayat"), F.col("ward"))
    made = v.cat_ward.select((F.col("panchayat_id") * 100 + F.col("ward")).alias("page_id"), F.when(F.col("ward") % 2 == 0, url).otherwise(F.concat(url, F.lit("?x=1"))).alias("url"))
    return v.pages.select("page_id", "url").unionByName(made).select("page_id", X.roll_url_allowed(F.col("url")).alias("allowed"), "url")


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier")
def slug(v):
    return v.supplier.select("s_suppkey", X.slug(F.col("s_name")).alias("slug"))


_SHOWN = lambda f: f"coalesce(nullif(trim(CAST({f} AS VARCHAR)), ''), '—')"
_SOURCES = dict.fromkeys(rolls.CARD) | {f: f for f in rolls.CARD if f not in ("relation", "booth_address")} | {
    "relation": "concat_ws(' ', CASE WHEN gender = 'F' THEN 'w/o' END, nullif(trim(relative), ''))", "booth_name": "concat('Booth ', booth)", "booth_address": "NULL",
}
_CARD = ", ".join(f"{_SHOWN(e)} AS {f}" for f, e in _SOURCES.items())


def _card(v):
    entries = v.roll.withColumn("relation", F.when(F.col("gender") == "F", "w/o")).withColumn("booth_name", F.concat(F.lit("Booth "), "booth"))
    return rolls.voter_card(entries, ("pos",))


@query(f"SELECT pos, {_CARD} FROM roll")
def voter_card(v):
    return _card(v)


LABELS = {f: f.replace("_", " ") for f in rolls.CARD}
FOOTER = ("From the ward roll", "of the election commission")


@query(f"""SELECT pos, concat({", chr(10), ".join(f"'{LABELS[f]}: ', {f}" for f in rolls.CARD)}, chr(10), chr(10), '{FOOTER[0]}', chr(10), '{FOOTER[1]}') AS share FROM (SELECT pos, {_CARD} FROM roll) c""")
def voter_share_text(v):
    return rolls.share_text(_card(v), LABELS, FOOTER).select("pos", "share")


@query("SELECT ward, serial AS id, serial, name, relative AS relative_name, house AS house_no, struck FROM roll")
def to_voter(v):
    return rolls.to_voter(v.roll)


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN 'Panchayat  SAMITI' ELSE n_name END AS name FROM nation""")
def samiti_name(v):
    full = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit("  PANCHAYAT samiti "))).when(F.col("n_nationkey") % 3 == 1, F.lit("Panchayat  SAMITI")).otherwise(F.col("n_name"))
    return v.nation.select("n_nationkey", X.samiti_name(full).alias("name"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN a > b WHEN event_id % 3 <> 0 AND event_id % 2 = 1 THEN sa > sb ELSE a > b END AS newer
    FROM (SELECT event_id, epoch_us(ts) // 1000 AS a, epoch_us(ts) // 1000 + event_id % 5 - 2 AS b, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS sa, strftime(ts + to_milliseconds(event_id % 5 - 2), '%Y-%m-%dT%H:%M:%S.%g') AS sb FROM events) t""")
def is_newer(v):
    """Times as they are sent, some as numbers and some as texts, against ones up to two milliseconds off."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    text = lambda m: F.date_format(F.timestamp_millis(m), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    other = ms + F.col("event_id") % 5 - 2
    a = F.when(F.col("event_id") % 3 == 0, ms.cast("variant")).otherwise(text(ms).cast("variant"))
    b = F.when(F.col("event_id") % 2 == 0, other.cast("variant")).otherwise(text(other).cast("variant"))
    return v.events.select("event_id", synclog.is_newer(a, b).alias("newer"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id * 1000 ELSE epoch_us(ts) // 1000 END AS ms FROM events""")
def updated_ms(v):
    raw = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") * 1000).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return v.events.select("event_id", synclog.updated_ms(raw).alias("ms"))


@query("SELECT event_id, length(id) BETWEEN 1 AND 200 AND updated_at IS NOT NULL AND event_id % 23 <> 0 AND event_id % 29 <> 0 AS valid FROM sync_log")
def record_valid(v):
    return v.sync_log.select("event_id", synclog.valid_record().alias("valid"))


_PAYLOAD = """(SELECT candidate, event_id, id, updated_at, seq, ciphertext, iv, json_extract_string(data, '$.wardId') AS ward, CAST(json_extract(data, '$.serial') AS BIGINT) AS serial, json_extract_string(data, '$.workerId') AS worker,
    json_extract_string(data, '$.markedAt') AS marked_at, json_extract_string(data, '$.phone') AS raw, json_extract_string(data, '$.consentAt') AS consent_at, coalesce(json_extract_string(data, '$.revoked') = 'true', false) AS revoked
    FROM sync_log WHERE data IS NOT NULL AND data <> '{}') p"""
_CONTACTS = f"""(SELECT candidate, event_id, id, updated_at, seq, ciphertext, iv, ward, serial, CASE WHEN NOT revoked THEN substr(raw, 2) END AS phone, CASE WHEN NOT revoked THEN consent_at END AS consent_at, revoked
    FROM {_PAYLOAD} WHERE id = concat('contact:', ward, ':', serial) AND (revoked OR (consent_at <> '' AND (raw IS NULL OR length(raw) = 11)))) c"""


@query(f"SELECT event_id, ward, serial, worker, marked_at FROM {_PAYLOAD} WHERE id = concat('mark:', ward, ':', serial) AND length(worker) BETWEEN 1 AND 100")
def mark_parse(v):
    """Marks read from their payload; ids that disagree with it, and payloads without a worker, are dropped."""
    return synclog.mark_records(v.sync_log).select("event_id", "ward", "serial", "worker", "marked_at")


@query(f"SELECT event_id, ward, serial, phone, consent_at, revoked FROM {_CONTACTS}")
def contact_parse(v):
    return synclog.contact_records(v.sync_log).select("event_id", "ward", "serial", "phone", "consent_at", "revoked")


@query("""SELECT page_id, CAST(page_id % 40 AS VARCHAR) AS ward, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS serial, concat('#/voter/', CAST(page_id % 40 AS VARCHAR), '/', CAST(CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS VARCHAR)) AS address
    FROM pages WHERE regexp_matches(url, '/[0-9]+')""")
def voter_route(v):
    hash_ = F.concat(F.lit("#/voter/"), F.lpad((F.col("page_id") % 40).cast("string"), 3, "0"), F.lit("/"), F.regexp_extract("url", "/([0-9]+)", 1))
    rows = v.pages.select("page_id", X.voter_route(hash_).alias("r")).filter("r IS NOT NULL").select("page_id", "r.ward", "r.serial")
    return rows.withColumn("address", X.voter_address(F.col("ward"), F.col("serial")))


@query("""WITH first AS (SELECT doc, min(pos) AS pos FROM lines WHERE regexp_matches(text, '^[A-Z]') GROUP BY doc), label AS (SELECT l.* FROM lines l JOIN first f ON l.doc = f.doc AND l.pos = f.pos)
    SELECT l.doc, trim(regexp_replace(string_agg(l.text, ' ' ORDER BY l.x, l.pos), '\\s+', ' ', 'g')) AS name FROM lines l JOIN label a ON l.doc = a.doc WHERE l.pos <> a.pos AND abs(l.y - a.y) < 2 AND l.x > a.x AND l.text <> '' GROUP BY l.doc""".replace("\\\\", "\\"))
def cover_names(v):
    return rolls.cover_names(v.lines, "^[A-Z]")


@query("""SELECT json_extract_string(props, '$.k') AS value, event_id, 'k' AS field FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_explode(v):
    return synclog.explode_json(v.events, "props", ["event_id"])


@query("""SELECT page_id, CAST(nth AS INT) AS nth, concat('m', page_id) AS id, CASE WHEN nth = 0 THEN CAST(page_id AS BIGINT) END AS at FROM pages, (SELECT unnest([0, 1]) AS nth) n""")
def json_array(v):
    """Arrays of records as a push carries them, exploded with fields by path."""
    doc = F.concat(F.lit('[{"id":"m'), "page_id", F.lit('","at":'), "page_id", F.lit('},{"id":"m'), "page_id", F.lit('"}]'))
    rows = v.pages.select("page_id", doc.alias("doc"))
    return synclog.explode_array(rows, "doc", {"id": ("$.id", "string"), "at": ("$.at", "bigint")}, ["page_id"])


@query()
def match_ranges(v):
    """Where 'ring' lies in the names of the voters that it finds; tested against a plain reading."""
    hits = search.search_voters(search.with_keys(v.roll), "ring")
    return search.match_ranges(hits.select("ward", "serial", "name"), "name", "ring")


@query("SELECT event_id, concat('9', lpad(CAST(event_id AS VARCHAR), 9, '0')) AS opened, true AS wrong_key_fails FROM events")
def seal_roundtrip(v):
    secret, key = F.lit(b"0123456789abcdef"), F.col("event_id").cast("string")
    rows = synclog.seal(v.events.select("event_id", F.concat(F.lit("9"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("phone")), "phone", secret, key)
    wrong = F.try_aes_decrypt("sealed", secret, F.lit("GCM"), F.lit("DEFAULT"), F.concat(key, F.lit("x"))).isNull()
    return synclog.unseal(rows, secret, key).select("event_id", "opened", wrong.alias("wrong_key_fails"))


_MESSAGES = f"""t AS (SELECT *, lower(to_base(serial, 36)) AS token, row_number() OVER (PARTITION BY candidate, worker, ward ORDER BY serial) AS i FROM (SELECT DISTINCT candidate, worker, ward, serial FROM marks) d),
    u AS (SELECT *, sum(length(token) + 1) OVER (PARTITION BY candidate, worker, ward ORDER BY i) AS upto, {tally.MAX_CHARS - 2 - tally.SUM_CHARS} - length(concat_ws(' ', '{tally.PREFIX}', candidate, worker)) AS room FROM t),
    nexts AS (SELECT a.candidate, a.worker, a.ward, a.i, min(CASE WHEN b.upto - a.upto + length(a.token) > a.room THEN b.i END) AS following
        FROM u a JOIN u b ON a.candidate = b.candidate AND a.worker = b.worker AND a.ward = b.ward AND b.i >= a.i GROUP BY ALL),
    starts AS (SELECT candidate, worker, ward, CAST(1 AS BIGINT) AS i, CAST(0 AS INT) AS part FROM t GROUP BY candidate, worker, ward
        UNION ALL SELECT s.candidate, s.worker, s.ward, n.following, s.part + 1 FROM starts s JOIN nexts n ON s.candidate = n.candidate AND s.worker = n.worker AND s.ward = n.ward AND s.i = n.i WHERE n.following IS NOT NULL),
    bodies AS (SELECT s.candidate, s.worker, s.ward, s.part, concat_ws(' ', '{tally.PREFIX}', s.candidate, s.worker, string_agg(t.token, '.' ORDER BY t.i)) AS body, count(*) AS n
        FROM starts s JOIN nexts x ON s.candidate = x.candidate AND s.worker = x.worker AND s.ward = x.ward AND s.i = x.i
        JOIN t ON s.candidate = t.candidate AND s.worker = t.worker AND s.ward = t.ward AND t.i >= s.i AND (x.following IS NULL OR t.i < x.following) GROUP BY s.candidate, s.worker, s.ward, s.part)"""


@query(f"WITH RECURSIVE {_MESSAGES} SELECT candidate, worker, ward, part, concat(body, ' ', left(sha256(body), {tally.SUM_CHARS})) AS text FROM bodies")
def sms_encode(v):
    return tally.encode_messages(v.marks)


@query(f"""WITH RECURSIVE {_MESSAGES} SELECT candidate, worker, CASE ward WHEN 1 THEN 'checksum' WHEN 2 THEN 'prefix' WHEN 3 THEN 'format' WHEN 4 THEN 'team' ELSE 'ok' END AS reason, count(*) AS messages,
    CAST(sum(CASE WHEN ward BETWEEN 1 AND 4 THEN 0 ELSE n END) AS BIGINT) AS serials FROM bodies GROUP BY ALL""")
def sms_decode(v):
    """Messages decoded after four wards' were damaged, each in its way."""
    ward, text = F.col("ward"), F.col("text")
    damaged = (
        F.when(ward == 1, F.expr("substring(text, 1, length(text) - 1)"))
        .when(ward == 2, F.replace(text, F.lit("PT1"), F.lit("PT2")))
        .when(ward == 3, F.concat(text, F.lit(" 1")))
        .otherwise(text)
    )
    team = F.when(ward == 4, F.concat(F.lit("x"), "candidate")).otherwise(F.col("candidate"))
    read = tally.decode_messages(tally.encode_messages(v.marks).withColumns({"text": damaged, "team": team}), "team")
    sent = F.coalesce(F.size("serials"), F.lit(0))
    sent = F.when(F.col("serials").isNull(), 0).otherwise(sent)
    return read.groupBy("candidate", "worker", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("messages"), F.sum(sent).alias("serials"))
