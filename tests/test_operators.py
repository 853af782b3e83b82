"""Operators: literal cases, and laws such as order not mattering."""

import hashlib
import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardloom.functions import spans, text
from wardloom.operators import calls, catalogue, households, quality, ranking, rolls, search, synclog, tally

ROLL = "ward string, serial string, name string, relative string, house string, epic string, age int, gender string"
VOTERS = [
    ("3", "1", "Ram Lal", "Mohan", "12/A", "RJ0000001", 40, "M"),
    ("3", "2", "Ramlal Meena", None, "12 / a", None, None, "M"),
    ("3", "10", "Sita Ram", "Ram Lal", "7", "RJ0000010", 30, "F"),
    ("04", "2", "सीता राम", None, None, None, 22, "F"),
    ("4", "x", "Gopal", None, "", None, 61, "M"),
]


@pytest.fixture(scope="module")
def keyed(spark):
    return search.with_keys(spark.createDataFrame(VOTERS, ROLL)).cache()


def found(df):
    return [(r["ward"], r["serial"], r["tier"]) for r in df.collect()]


def test_search_tiers_and_order(keyed):
    assert found(search.search_voters(keyed, "ram lal")) == [("3", "1", 0), ("3", "10", 0)]
    assert [t for *_, t in found(search.search_voters(keyed, "ram"))] == [1, 1, 1, 2]
    assert found(search.search_voters(keyed, "सीता")) == [("3", "10", 1), ("04", "2", 1)]


def test_jump_comes_first_and_blank_lists_all(keyed):
    assert found(search.search_voters(keyed, " 4 / २ "))[0] == ("04", "2", -1)
    assert len(found(search.search_voters(keyed, "  "))) == len(VOTERS)
    assert found(search.search_voters(keyed, "!?")) == []
    assert len(found(search.search_voters(keyed, None, limit=2.9))) == 2


def test_filters(spark, keyed):
    assert {r["serial"] for r in search.place_filter(keyed, "ward", ["4"]).collect()} == {"2", "x"}
    assert search.age_filter(keyed, 30).count() == 3
    with pytest.raises(ValueError):
        search.age_filter(keyed, 50, 20)
    tags = spark.createDataFrame([("3:1", ["vip", "old"]), ("4:2", ["old"])], "voter_key string, value array<string>")
    assert search.lookup_filter(keyed, tags, "vip").count() == 1
    assert search.lookup_filter(keyed, tags, negate=True).count() == 3
    own = F.when(F.col("age") > 30, "old")
    assert search.lookup_filter(keyed, own).count() == 2 and search.lookup_filter(keyed, own, "young").count() == 0
    assert search.lookup_filter(keyed, own, negate=True).count() == 3


def test_batch_search_equals_single_scans(spark):
    random.seed(3)
    keys = ["".join(random.choice("abc ") for _ in range(12)).strip() or "abc" for _ in range(120)]
    corpus = spark.createDataFrame(list(enumerate(keys)), "doc int, key string")
    asked = [(i, q) for i, q in enumerate({k[2:6] for k in keys if len(k[2:6]) > 3})]
    got = {(r["q_id"], r["doc"]) for r in search.batch_search(corpus, spark.createDataFrame(asked, "q_id int, key string"), 1000, id_col="doc", query_col="q_id").collect()}
    assert got == {(i, d) for i, q in asked for d, k in enumerate(keys) if q in k}
    queries = spark.createDataFrame([*asked, (900, "no such key"), (901, "abc" * 9)], "q_id int, key string")
    both = [sorted(map(tuple, search.batch_search(corpus, queries, 3, id_col="doc", query_col="q_id", small=n).collect())) for n in (0, 1 << 20)]
    assert both[0] == both[1] and both[0]
    tier = lambda k, q: 0 if k == q else 1 if k.startswith(q) else 2 if f" {q}" in k else 3
    for i, q in asked:
        want = sorted((tier(k, q), d) for d, k in enumerate(keys) if q in k)[:3]
        assert [(t, d) for n, _, d, t in both[0] if n == i] == want


def test_windows_are_held_a_piece_at_a_time(spark, monkeypatch):
    """What a batch of keys takes in memory is bounded by a piece, whatever the batch has; pieces change no match."""
    keys = ["ab cd " * 200] * 5000 + ["x" * (3 << 20), None, ""]  # 6 MB in short keys, 3 MB in one
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(keys))), pa.array(keys)], names=["id", "key"])
    tracemalloc.start()
    at, sizes = [], []
    for piece in search._pieces(batch.slice(1), 1):
        at += piece.column(0).to_pylist()
        sizes.append(sum(len(k or "") for k in piece.column(1).to_pylist()))
        if len(sizes) == 2:
            tracemalloc.reset_peak()
            search._codes(piece.column(1).to_pylist())
            peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == list(range(1, len(keys))) and sorted(sizes)[-2] <= search.PIECE < sizes[-2] + sizes[-1] and peak < 64 << 20
    docs = spark.createDataFrame([(i, f"river {i % 7} mill {i} road") for i in range(300)] + [(300, None), (301, "")], "doc long, key string").coalesce(1)
    asked = spark.createDataFrame([(1, "mill 2"), (2, "river 3"), (3, "none such")], "asked long, key string")
    want = None
    for size in (1 << 20, 64):
        monkeypatch.setattr(search, "PIECE", size)
        for small in (1 << 20, 0):
            got = sorted(map(tuple, search.batch_search(docs, asked, 5, id_col="doc", query_col="asked", small=small).collect()))
            assert got and got == (want := want or got)


def test_index_narrows_a_search_without_changing_it(spark, keyed):
    rows = keyed.withColumn("pos", F.monotonically_increasing_id()).cache()
    index = search.gram_index(rows, "pos").cache()
    for query in ("ram lal", "ram", "सीता", "12", "RJ00", "", "!?", "4 / २", "zzz"):
        assert found(search.search_voters(rows, query, index=index)) == found(search.search_voters(rows, query)), query
    assert search.gram_candidates(index, "pos", "rm", rows, "k_name").count() == 4
    assert [r["capped"] for r in search.with_capped(search.search_voters(keyed, "ram", limit=2), 2).collect()] == [True, True]


def test_match_ranges(spark):
    cases = [("रमेश", "ramesh", [(0, 4)]), ("रमेश", "रमेश", [(0, 4)]), ("रमेश", "rame", [(0, 3)]), ("रमेश चंद्र", "chandra", [(5, 10)]), ("रमेश", "esh", [(1, 4)]), ("राम राम", "ram", [(0, 3), (4, 7)]), ("Ram", "!", []), (None, "ram", [])]
    for text, query, want in cases:
        got = search.match_ranges(spark.createDataFrame([(text,)], "t string"), "t", query).first()["ranges"]
        assert [tuple(r) for r in got] == want, (text, query)
    assert [tuple(r) for r in search.match_ranges(spark.createDataFrame([("RJ/००१",)], "t string"), "t", "j0", "code").first()["ranges"]] == [(1, 4)]


def test_spans_build_the_same_key(spark):
    random.seed(9)
    texts = ["".join(random.choice("aaeohkmpbsyxtzg  -1éअआकखंँहिी्ऱज़ॐऋ०") for _ in range(random.randrange(25))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.phonetic_key(F.col("t")).alias("k")).collect()
    assert [(r["t"], r["k"], spans.phonetic(r["t"]).text) for r in rows if r["k"] != spans.phonetic(r["t"]).text] == []
    assert all(len(k.text) == len(k.spans) for k in map(spans.phonetic, texts))


def sequential(base, lists):
    """The merge rule read as a loop."""
    state = {}
    for _, _, serial, name, struck in sorted(base):
        state[serial] = [name, struck, None]
    for _, _, serial, name, struck in sorted(lists):
        if serial not in state:
            state[serial] = [name, struck, "deletion" if struck else "addition"]
        elif state[serial][1] != struck:
            state[serial][1:] = [struck, "deletion" if struck else "addition"]
    return {k: tuple(v) for k, v in state.items()}


def test_supplements_equal_the_loop_however_they_are_staged(spark):
    random.seed(5)
    base = [(0, i, random.randrange(30), f"b{i}", random.random() < 0.3) for i in range(40)]
    lists = [(random.randrange(1, 4), 100 + i, random.randrange(40), f"s{i}", random.random() < 0.5) for i in range(90)]
    schema = "pub int, pos int, serial int, name string, struck boolean"
    b, s = spark.createDataFrame(base, schema).withColumn("ward", F.lit(1)), spark.createDataFrame(lists, schema).withColumn("ward", F.lit(1))
    read = lambda df: {r["serial"]: (r["name"], r["struck"], r["supplement"]) for r in df.collect()}
    got = read(rolls.apply_supplements(b.drop("pub"), s))
    assert got == sequential(base, lists)
    assert read(rolls.apply_supplements(b.drop("pub"), s.orderBy(F.rand(1)))) == got
    staged = b.drop("pub")
    for pub in (1, 2, 3):
        staged = rolls.apply_supplements(staged, s.filter(F.col("pub") == pub))
        again = rolls.apply_supplements(staged, s.filter(F.col("pub") == pub).limit(0))
        assert read(again) == read(staged)
    assert read(staged) == got and staged.columns == ["ward", "serial", "pos", "name", "struck", "supplement"]


def test_supplements_keep_the_bases_columns_and_tags(spark):
    base = spark.createDataFrame([(1, 1, 5, "a", 40, "h", True, "deletion"), (1, 2, 6, "b", 41, None, False, None)], "ward int, serial int, pos int, name string, age int, house string, struck boolean, supplement string")
    supp = spark.createDataFrame([(1, 1, 1, 7, "x", True), (1, 9, 1, 8, "new", False)], "ward int, serial int, pub int, pos int, name string, struck boolean")
    out = {r["serial"]: r for r in rolls.apply_supplements(base, supp).collect()}
    assert tuple(out[1]) == (1, 1, 5, "a", 40, "h", True, "deletion")  # struck before and after: its own tag stays
    assert tuple(out[2]) == (1, 2, 6, "b", 41, None, False, None)
    assert (out[9]["name"], out[9]["age"], out[9]["supplement"]) == ("new", None, "addition")


def test_households_group_spellings(spark):
    rows = [(1, 1, 1, "A", "12/A", False), (1, 2, 2, "B", " १२ / a", False), (1, 3, 3, "C", "12A", False), (1, 4, 4, "D", "12/A", True), (1, 5, 5, "E", None, False)]
    got = {r["key"]: (r["house"], [m["serial"] for m in r["members"]]) for r in households.households(spark.createDataFrame(rows, "ward int, serial int, pos int, name string, house string, struck boolean")).collect()}
    assert got == {"12/a": ("12/A", [1, 2]), "12a": ("12A", [3])}


def test_household_cards_show_a_teams_own_numbers_alone(spark):
    roll = spark.createDataFrame([(1, s, s, f"n{s}", "7", False) for s in (1, 2, 3)], "ward int, serial int, pos int, name string, house string, struck boolean")
    log = [("t", 1, 1, 1, "9876543210", False), ("u", 1, 1, 2, "9876543211", False), ("t", 1, 2, 3, "9876543212", False), ("t", 1, 2, 4, None, True), ("t", 1, 3, 5, "12", False)]
    contacts = spark.createDataFrame([(*r, "at") for r in log], "candidate string, ward int, serial int, seq int, phone string, revoked boolean, consent_at string")
    tags = spark.createDataFrame([("1:1", "vip"), ("1:1", "old"), ("1:3", "new")], "voter_key string, value string")
    cards = households.household_members(households.households(roll), calls.consent_state(contacts), tags, tags.limit(0))
    got = sorted((r["serial"], r["candidate"] or "", r["phone"], r["tag"], r["visit"]) for r in cards.collect())
    assert got == [(1, "t", "9876543210", "old, vip", None), (1, "u", "9876543211", "old, vip", None), (2, "", None, None, None), (3, "t", None, "new", None)]


def test_seals_of_one_value_differ_and_open_with_their_key_alone(spark):
    secret, key = F.lit(b"0123456789abcdef"), F.col("k")
    rows = synclog.seal(spark.createDataFrame([(str(i), "9876543210") for i in range(20)] + [("n", None)], "k string, phone string"), "phone", secret, key).cache()
    sealed = [bytes(r["sealed"]) for r in rows.filter("phone IS NOT NULL").collect()]
    assert len({x[:12] for x in sealed}) == 20
    again = [bytes(r["sealed"]) for r in synclog.seal(rows.drop("sealed"), "phone", secret, key).filter("phone IS NOT NULL").collect()]
    assert not set(sealed) & set(again)
    assert {r["opened"] for r in synclog.unseal(rows, secret, key).collect()} == {"9876543210", None}
    assert {r["opened"] for r in synclog.unseal(rows, secret, F.concat(key, F.lit("x"))).collect()} == {None}


def test_records_are_read_from_their_payload(spark):
    mark = '{"wardId":"%s","serial":%s,"workerId":"%s","markedAt":"now"}'
    marks = [("mark:3:0", mark % (3, 0, "w")), ("mark:3:7", mark % (3, 8, "w")), ("mark:3:7", mark % (3, 7, "")), ("mark:3:7", mark % (3, 7, "w" * 101)), ("mark:3:9", mark % (3, '"9"', "w")), ("contact:3:7", mark % (3, 7, "w")), ("mark:3:4", None), ("mark:3:5", "[1"), ("mark:3:6", mark % (3, 6.5, "w"))]
    df = spark.createDataFrame(marks, "id string, data string")
    assert [(r["ward"], r["serial"], r["worker"]) for r in synclog.mark_records(df).collect()] == [("3", 0, "w")]
    body = '{"wardId":"3","serial":%d%s}'
    contacts = [(1, ',"consentAt":"a","phone":"+91 98765 43210"'), (2, ',"consentAt":"a"'), (3, ',"consentAt":"a","phone":null'), (4, ',"consentAt":"a","phone":"12"'), (5, ',"phone":"9876543210","consentAt":""'), (6, ',"revoked":true,"phone":"12"'), (7, ',"revoked":"true"')]
    df = spark.createDataFrame([(f"contact:3:{s}", body % (s, rest)) for s, rest in contacts], "id string, data string")
    got = {r["serial"]: (r["phone"], r["consent_at"], r["revoked"]) for r in synclog.contact_records(df).collect()}
    assert got == {1: ("9876543210", "a", False), 2: (None, "a", False), 3: (None, "a", False), 6: (None, None, True)}


@pytest.mark.parametrize("read", [synclog.mark_records, synclog.contact_records])
def test_a_payload_is_parsed_once(spark, read):
    """The plan that runs parses a record's document in one place, after rows of other kinds are gone."""
    rows = spark.createDataFrame([("mark:1:2", "{}"), ("contact:1:2", "{}"), ("other:1:2", None)], "id string, data string")
    plan = read(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson(") == 1 or plan.lower().count("parse_json(") == 1
    assert plan.index("Generate explode") < plan.index("StartsWith")


@pytest.mark.parametrize("read", [synclog.mark_records, synclog.contact_records])
def test_a_payload_s_fields_are_read_once(spark, read):
    """The plan that runs takes a field from its document in one place, whatever uses it; so with the number's form."""
    rows = spark.createDataFrame([("mark:1:2", "{}"), ("contact:1:2", "{}")], "id string, data string")
    plan = read(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(") <= 1 + 7  # the document, and each field of it
    assert plan.count("regexp_replace(") <= 2


def test_odd_payloads(spark):
    """Documents that are no objects, fields of other types, numbers written in several ways."""
    docs = ["[]", '"x"', "12", "null", "", '[{"wardId":"3","serial":1,"revoked":true}]', '{"wardId":3,"serial":1,"revoked":true}', '{"wardId":"3","serial":"1","revoked":true}']
    docs += ['{"wardId":"3","serial":1.0,"revoked":true}', '{"wardId":"3","serial":1e0,"consentAt":"c","revoked":1}', '{"wardId":"3","serial":1,"consentAt":{"a":1},"phone":null}', '{"wardId":"3","serial":1e40,"revoked":true}']
    df = spark.createDataFrame([(n, "contact:3:1", d) for n, d in enumerate(docs)], "n int, id string, data string")
    assert sorted(tuple(r) for r in synclog.contact_records(df).select("n", "serial", "consent_at", "revoked").collect()) == [(8, 1, None, True), (9, 1, "c", False)]


def test_validity_wants_a_sealed_payload(spark):
    rows = [("a", 1, "c", "i", True), ("", 1, "c", "i", False), ("a" * 201, 1, "c", "i", False), ("a", None, "c", "i", False), ("a", 1, "", "i", False), ("a", 1, "c", None, False), (None, 1, "c", "i", False)]
    rows = [("t", *r) for r in rows] + [(None, "a", 1, "c", "i", False), ("", "a", 1, "c", "i", False)]
    df = spark.createDataFrame(rows, "candidate string, id string, updated_at int, ciphertext string, iv string, want boolean")
    assert all(r["v"] == r["want"] for r in df.withColumn("v", synclog.valid_record()).collect())


def test_newer_among_mixed_times(spark):
    rows = [
        ("2", "10", False), ("10", "2", True), ('"b"', '"a"', True), ('"2"', '"10"', True), ('"2024-01-01T00:00:00Z"', "1704067199999", True),
        ("1704067200000", '"2024-01-01T00:00:00Z"', False), ('"x"', "5", False), (None, "5", False), ("1.5", "1", True), ("true", "1", False),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = df.withColumn("n", synclog.is_newer(F.parse_json("a"), F.parse_json("b"))).collect()
    assert all(r["n"] == r["want"] for r in got)


def test_mixed_times_are_folded_in_order_of_arrival(spark):
    """Over mixed types 'newer' runs in circles: a text beats a text that beats a number that beats the first text."""
    circle = ['"2024-01-01T05:30:00+05:30"', "1704067200500", '"2024-01-01T00:00:01Z"']  # 00:00:00, 00:00:00.5, 00:00:01; as texts the first is greatest
    rows = [("t", "a", n, t) for n, t in enumerate(circle)] + [("t", "b", n, t) for n, t in enumerate(reversed(circle))]
    rows += [("t", "c", n, t) for n, t in enumerate([circle[0], circle[2]])] + [("t", "n", n, str(t)) for n, t in enumerate([5, 9, 9, 7])]
    rows += [("t", "bad", 1, '"soon"'), ("t", "bad", 2, "true"), ("t", "half", 1, '"soon"'), ("t", "half", 2, "3")]
    df = spark.createDataFrame(rows, "candidate string, id string, seq long, t string").select("candidate", "id", "seq", F.parse_json("t").alias("updated_at"))
    got = {r["id"]: r["seq"] for r in synclog.latest_mixed(df.repartition(5)).collect()}
    assert got == {"a": 2, "b": 2, "c": 0, "n": 1, "half": 2}
    state = df.filter("id IN ('a', 'n')").filter("seq = 1")
    newer = {r["id"]: r["seq"] for r in synclog.newer_than(df, state, df.limit(0)).collect()}
    assert newer == {"a": 2, "b": 2, "c": 0, "half": 2}


def test_a_time_is_read_once(spark):
    """A VARIANT time is read as a date in one place, whatever uses it."""
    df = spark.createDataFrame([("5",)], "t string").select(F.parse_json("t").alias("updated_at"))
    rows = synclog.typed_time(df).filter("ms IS NOT NULL AND ms > 1").withColumn("more", F.col("ms") + F.col("number"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("rlike") == 1


def test_mixed_times_stay_together_after_a_broadcast(spark):
    """Ids are folded whole, also if the join that finds the mixed ones is a broadcast join once it runs."""
    rows = spark.range(4000).select(
        F.concat(F.lit("t"), F.col("id") % 5).alias("candidate"), F.concat(F.lit("i"), F.col("id") % 5).alias("id"), F.col("id").alias("seq"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("variant")).otherwise(F.lit("1970-01-01T00:00:00Z").cast("variant")).alias("updated_at"),
    )
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        last = synclog.latest_mixed(rows.repartition(4))
        got = sorted((r["id"], r["seq"]) for r in last.collect())
    finally:
        for k in held:
            spark.conf.unset(k)
    assert got == [(f"i{k}", max(n for n in range(0, 4000, 2) if n % 5 == k)) for k in range(5)]
    plan = last._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("MapInArrow") :]
    assert "Window [row_number()" in above[: above.index("Join")]  # what demands whole ids in order, whatever the join becomes


def test_pages_and_arrays(spark):
    log = spark.range(30).select(F.lit("t").alias("candidate"), F.col("id").alias("seq"))
    assert {(r["seq"], r["more"]) for r in synclog.page(log, "t", 24, 5).collect()} == {(s, False) for s in range(25, 30)}
    assert {(r["seq"], r["more"]) for r in synclog.page(log, "t", -1, 2).collect()} == {(0, True), (1, True)}
    assert synclog.page(log, "u", 0).count() == 0
    df = spark.createDataFrame([(1, '[{"id":"a","n":{"x":5}},{"id":7}]'), (2, "no"), (3, "[]")], "k int, doc string")
    got = synclog.explode_array(df, "doc", {"id": ("$.id", "string"), "x": ("$.n.x", "bigint")}, ["k"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, "a", 5), (1, 1, "7", None)]


def test_covers_are_read_by_label(spark):
    lines = [
        (1, 0, 0.0, 0.0, "जिलापरिषद का नाम : अजमेर जि॰ प॰ अजमेर"), (1, 1, 0.0, 5.0, "पंचायत समिति का नाम:  पीसांगन"), (1, 2, 0.0, 9.0, "जिला :"), (1, 3, 9.0, 9.5, "अजमेर"), (1, 4, 5.0, 9.0, ": नया"),
        (2, 0, 0.0, 0.0, "जिलापरिषद का नाम : कोटा जि॰ प॰"), (2, 1, 0.0, 5.0, "पंचायत समिति का नाम : x9"), (3, 0, 0.0, 0.0, "other"),
    ]
    got = {r["doc"]: (r["district"], r["samiti"]) for r in rolls.cover_readings(spark.createDataFrame(lines, "doc int, pos int, x double, y double, text string")).collect()}
    assert got == {1: ("नया अजमेर", "पीसांगन"), 2: ("कोटा", None), 3: (None, None)}


def test_catalogue_documents_are_gated(spark):
    doc = lambda v, file: '{"schemaVersion":%d,"districts":[{"id":"1","name":" ","nameLatin":"A","file":"%s"},{"id":"","name":"B","file":"b.json"}]}' % (v, file)
    read = lambda d: [tuple(r) for r in catalogue.read_index(spark.createDataFrame([(d,)], "document string")).collect()]
    assert read(doc(1, "a-1.json")) == [("1", "A", "A", "a-1.json")] and read(doc(1, "../a.json")) == []
    for bad in (doc(2, "a.json"), "nonsense"):
        with pytest.raises(Exception, match="unknown catalogue version"):
            read(bad)


def test_sibling_keys_and_seats(spark):
    df = spark.createDataFrame([("1/2/3/4", 9), ("1/2", 9)], "k string, w int")
    assert [r[0] for r in df.select(catalogue.sibling_key(F.col("k"), F.col("w"))).collect()] == ["1/2/3/9", None]
    picks = [("ward-panch", "P", [4]), ("ward-panch", "P", [4, 5]), ("sarpanch", "P", [4, 5]), ("sarpanch", " ", [4]), ("sarpanch", "P", []), ("x", "P", [4])]
    rows = spark.createDataFrame([(s, p, [(w, "u") for w in ws]) for s, p, ws in picks], "seat string, panchayat string, wards array<struct<ward:int,url:string>>")
    assert [(r["seat_type"], r["ward"]) for r in catalogue.seat_from_pick(rows).collect()] == [("ward", "4"), ("sarpanch", None)]


def test_samples_top_up_to_the_least(spark):
    rows = [(p, 10 * p + i) for p in range(4) for i in range(5)]
    df = spark.createDataFrame(rows, "page int, serial int")
    for least in (2, 4, 7, 50):
        want = sorted(rows, key=lambda r: (r[1] % 10 != 0, r[1]))[: max(least, 4)]
        assert sorted((r["page"], r["serial"]) for r in quality.sample_matched(df, least).collect()) == sorted(want)


MARK = "candidate string, ward bigint, serial bigint, worker string, seq bigint"


def test_mark_merge_is_a_set_union(spark):
    random.seed(2)
    rows = [("t" + str(random.randrange(2)), random.randrange(3), random.randrange(20), f"w{i}", i) for i in range(200)]
    df = lambda r: spark.createDataFrame(r, MARK)
    want = {tuple(r) for r in tally.first_marks(df(rows)).collect()}
    shuffled = random.sample(rows, len(rows))
    assert {tuple(r) for r in tally.merge_marks(df(shuffled[:120]), df(shuffled[80:]), df(rows[:10])).collect()} == want


def test_messages_round_trip_and_reject(spark):
    rows = [("team", 1, n, "w1", n) for n in range(1, 400)]
    sms = tally.encode_messages(spark.createDataFrame(rows, MARK))
    assert sms.filter(F.length("text") > 160).count() == 0
    back = tally.decode_messages(sms).select(F.explode("serials").alias("n")).distinct().count()
    assert back == 399 and sms.count() == tally.encode_messages(spark.createDataFrame(rows * 2, MARK)).count()
    text = sms.first()["text"]
    bad = [(text.upper().replace("TEAM", "team").replace("W1", "w1"), "team"), ("XX1 a b c d", "team"), ("PT1 a b", "team"), (text, "other"), (text[:-1] + ("0" if text[-1] != "0" else "1"), "team"), (f"  {text}\n", "team")]
    got = [r["reason"] for r in tally.decode_messages(spark.createDataFrame(bad, "text string, candidate string")).collect()]
    assert got == ["checksum", "prefix", "format", "team", "checksum", None]


def test_consent_after_revocation(spark):
    log = [(1, "9876543210", False, "a"), (2, None, False, "b"), (3, None, True, "c"), (4, "bad", False, "d"), (5, "+919876543211", False, "e"), (6, "x", False, "f")]
    df = spark.createDataFrame([("t", 1, 1, s, p, r, at) for s, p, r, at in log], "candidate string, ward int, serial int, seq int, phone string, revoked boolean, consent_at string")
    assert [tuple(r)[3:] for r in calls.consent_state(df).collect()] == [("d", "9876543211")]
    assert calls.consent_state(df.filter("seq <= 3")).count() == 0


def test_latest_ties(spark):
    df = spark.createDataFrame([("t", "a", 5, 1), ("t", "a", 5, 2), ("t", "a", 4, 3)], "candidate string, id string, updated_at int, seq int")
    assert synclog.latest(df).first()["seq"] == 1
    assert synclog.latest(df, later_wins=True).first()["seq"] == 2


def test_mixed_timestamps(spark):
    rows = [("1700000000000",), ("2023-11-14T22:13:20Z",), ("nonsense",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(synclog.updated_ms(F.col("s"))).collect()]
    assert got == [1700000000000, 1700000000000, None, None]


def test_asof_page_over_ranges(spark):
    decoded = spark.createDataFrame([(5, 1), (1500, 2), (5000, 3)], "serial int, page int")
    missing = spark.createDataFrame([(1,), (6,), (1400,), (4999,), (9000,)], "serial int")
    for ranges in (1000, 7):
        got = {r["serial"]: r["page"] for r in quality.asof_page(missing, decoded, ranges).collect()}
        assert got == {1: 1, 6: 1, 1400: 1, 4999: 2, 9000: 3}


def test_catalogue_rules_in_order(spark):
    """The first rule that a panchayat breaks stands; its lines are judged only if none is."""
    k = "क"
    grid = [
        (1, 1, "1", k, True), (1, 2, "2", "ख", False), (1, 3, "x", k, True), (2, 1, "x", "A", True), (2, 2, "3", "B", True), (2, 3, "०३", "A", True),
        (3, 2, "1", k, True), (3, 1, "01", k, False), (3, 3, "2", k, True), (4, 1, "9", "क\u093c", True), (4, 2, "8", "\u0958", True), (6, 1, "1", k, True), (7, 1, "1", k, True),
    ]
    df = spark.createDataFrame(grid, "panchayat_id int, row_no int, ward_text string, name string, final boolean").withColumn("supplement", F.col("ward_text") == "2")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "panchayat_id int")
    args = (ids(*range(8)), df, ids(0, 1, 2, 3, 4, 5, 7), ids(1, 2, 3, 4, 5, 6))
    got = sorted(tuple(r) for r in catalogue.errors(*args).collect())
    assert got == [
        (0, "no grid", ""), (1, "names disagree", "क, ख"), (2, "bad ward number", "x"), (2, "repeated ward", "3"),
        (3, "no link", "1"), (3, "repeated ward", "1"), (5, "zero wards", ""), (6, "no response", ""), (7, "no grid", ""),
    ]
    usable = catalogue.judged_grid(*args).filter("error IS NULL").select("panchayat_id", "ward", "supplement").collect()
    assert sorted(map(tuple, usable)) == [(2, 3, False), (3, 2, True), (4, 8, False), (4, 9, False)]


def test_minimise_keeps_the_tag_and_whole_serials(spark):
    rows = [(1, 1.0, "deletion"), (1, 2.0, "addition"), (1, 3.0, "odd"), (1, 1.5, None), (1, None, "deletion"), (1, 4.0, None)]
    df = spark.createDataFrame(rows, "ward int, serial double, supplement string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("name", "relative", "age", "gender", "house")}).withColumn("struck", F.lit(None).cast("boolean"))
    out = rolls.minimise(df)
    assert [(r["serial"], r["supplement"]) for r in out.orderBy("serial").collect()] == [(1, "deletion"), (2, "addition"), (3, None), (4, None)]
    assert rolls.minimise(out).collect() == out.collect() and rolls.minimise(df.drop("supplement")).filter("supplement IS NOT NULL").count() == 0


def test_records_are_read_from_lines(spark):
    lines = [
        (0, 50.0, 0, "12", True), (9, 0, 0, "lost", False),
        (0, 0, 10, "नाम", False), (5, 0, 9, "नाम :", False), (9, 9, 9, "open, dropped by the next", False),
        (0, 100, 0, "नाम :", False), (5, 101, 0, "अ", False), (9, 99, 0, "ब", False), (0.5, 100, 0, "left", False), (0, 110, 0, "पति का नाम :", False), (5, 110, 0, "क", False),
        (0, 120, 0, "पिता का नाम :", False), (6, 120, 0, "ख", False), (0, 130, 0, "मकान संख्या", False), (5, 130, 0, "1", False), (6, 131, 0, "2", False),
        (0, 140, 0, "आयु :", False), (3, 140, 0, "33", False), (4, 140, 0, "लिग", False), (5, 140, 0, "अन्य", False), (6, 140, 0, "?", False), (0, 150, 0, "ABC123456", False),
        (0, 160, 0, "Available", False), (0, 165, 0, "77", True), (3, 166, 0, "S", True), (3, 190, 0, "O", True), (1, 191, 0, "88", True),
        (0, 200, 0, "नाम :", False), (5, 200, 0, "क\u093c", False), (5, 201, 0, "E", True), (1, 210, 0, "5", False), (1, 220, 0, "2", True),
        (0, 300, 0, "नाम :", False), (5, 300, 0, "never closed", False),
    ]
    rows = [(1, n, float(x), float(y), bold, t) for n, (x, y, _, t, bold) in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc int, pos int, x double, y double, serial_font boolean, text string")
    got = [tuple(r) for r in rolls.segment_records(df).orderBy("record").collect()]
    assert got == [
        (1, 1, 77, True, "अ ब", "पिता", "ख", 33, "अन्य", "2", "ABC123456", ["left", "पति का नाम :", "क", "?"]),
        (1, 2, 2, False, "क\u093c E", None, None, None, None, None, None, ["5"]),
    ]


def loop_messages(team, worker, serials):
    """Messages by the plain loop."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"

    def token(n):
        return token(n // 36) + digits[n % 36] if n >= 36 else digits[n]

    header, out, part = f"PT1 {team} {worker}", [], []
    for t in map(token, sorted(set(serials))):
        if part and len(".".join([*part, t])) > 160 - len(header) - 6:
            out.append(part)
            part = []
        part.append(t)
    bodies = [f"{header} {'.'.join(p)}" for p in [*out, part] if p]
    return [f"{b} {hashlib.sha256(b.encode()).hexdigest()[:4]}" for b in bodies]


@pytest.mark.parametrize("span", [1, 83, 200, 20_000])
def test_messages_by_ranges_equal_the_loop(spark, span):
    r = random.Random(span)
    sets = {("t1", f"w{k}"): [r.randrange(1, 10 ** r.randrange(1, 15)) for _ in range(n)] for k, n in enumerate((0, 1, 80, 81, 82, 83, 84, 160, 250, 900))}
    sets["a-team-of-16-chr", "worker_of_16_chr"] = [2**53 - 1, *range(1, 300)]
    rows = [(c, w, 3, s) for (c, w), own in sets.items() for s in own]
    got = tally.encode_messages(spark.createDataFrame(rows, "candidate string, worker string, ward long, serial long").repartition(3), span).collect()
    mine = {k: [t for _, t in sorted((r["part"], r["text"]) for r in got if (r["candidate"], r["worker"]) == k)] for k in sets}
    assert mine == {k: loop_messages(*k, own) for k, own in sets.items()}
    assert max(len(r["text"]) for r in got) <= 160


def test_a_million_serials_of_one_worker(spark):
    marks = spark.range(1, 3_000_001, 3).select(F.lit("t").alias("candidate"), F.lit("w").alias("worker"), F.lit(1).cast("long").alias("ward"), F.col("id").alias("serial"))
    got = [r["text"] for r in tally.encode_messages(marks).orderBy("part").collect()]
    assert got == loop_messages("t", "w", range(1, 3_000_001, 3))


@pytest.mark.parametrize(("row", "why"), [(("a b", "w", 1, 5), "invalid team"), (("t", "", 1, 5), "invalid worker"), (("t", None, 1, 5), "invalid worker"), (("t", "w", 1, 0), "invalid serial"), (("t", "w", 1, 2**53), "invalid serial")])
def test_what_decoding_rejects_is_not_encoded(spark, row, why):
    df = spark.createDataFrame([("t", "w", 1, 4), row], "candidate string, worker string, ward long, serial long")
    with pytest.raises(Exception, match=why):
        tally.encode_messages(df).collect()


def test_numbers_and_neighbours_over_ranges(spark):
    random.seed(4)
    rows = [(k, x) for k in "ab" for x in random.sample(range(1000), 80)] + [("c", 5)]
    df = spark.createDataFrame(rows, "k string, x long")
    got = {(r["k"], r["x"]): (r["n"], r["before"]) for r in ranking.with_previous(ranking.numbered(df, ["k"], "x", width=37), ["k"], "x", width=41).collect()}
    for k in "abc":
        mine = sorted(x for key, x in rows if key == k)
        assert [got[k, x] for x in mine] == [(i + 1, mine[i - 1] if i else None) for i in range(len(mine))]


def test_a_stored_index_reads_its_grams_buckets(spark, tmp_path):
    rows = [(w, n, w * 1000 + n, f"{a} {b}", "", "", f"E{w}{n}") for w in (1, 2, 3) for n, (a, b) in enumerate([("golden", "ring"), ("silver", "spoon"), ("gold", "rings"), ("plain", "wood")])]
    schema = "ward long, serial long, pos long, name string, relative string, house string, epic string"
    old = spark.createDataFrame([(w, n, p, nm[::-1], r, h, e) for w, n, p, nm, r, h, e in rows], schema)
    keyed = search.with_keys(spark.createDataFrame(rows, schema))
    path = str(tmp_path / "index")
    search.write_index(search.with_keys(old), path)
    search.write_index(keyed.filter("ward < 3"), path)
    index = search.read_index(spark, path)
    ask = lambda i: sorted((r["ward"], r["serial"], r["tier"]) for r in search.search_voters(keyed, "gold ring", index=i).collect())
    assert ask(index) == [x for x in ask(None) if x[0] < 3] and len(ask(index)) == 2  # ward 3's postings are still the old names'
    search.write_index(keyed.filter("ward = 3"), path)
    index = search.read_index(spark, path)
    assert ask(index) == ask(None)
    plan = search.search_voters(keyed, "gold ring", index=index)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan[plan.index("PartitionFilters: [") :].split("]")[0]


def test_trees_are_merged_by_district(spark):
    d = lambda *x: spark.createDataFrame([(i, f"D{i}") for i in x], "district_id long, district string")
    s = spark.createDataFrame([(1, 11, "A PANCHAYAT SAMITI"), (1, 12, "B NAGAR PALIKA"), (2, 21, "C PANCHAYAT SAMITI"), (9, 91, "X PANCHAYAT SAMITI")], "district_id long, samiti_id long, samiti string")
    p = spark.createDataFrame([(11, 112, "p2"), (11, 111, "p1"), (12, 120, "no"), (91, 900, "far")], "samiti_id long, panchayat_id long, panchayat string")
    read = lambda df: json.loads(df.first()["document"])
    whole = catalogue.tree(d(1, 2, 3), s, p, ["n"])
    doc = read(whole)
    assert doc["counts"] == {"districts": 3, "samitis": 2, "panchayats": 2, "urban": 1, "zillaParishad": 0, "other": 0} and doc["notes"] == ["n"]
    assert doc["districts"][0]["samitis"] == [
        {"id": "11", "name": "A PANCHAYAT SAMITI", "kind": "rural", "panchayats": [{"id": "111", "name": "p1"}, {"id": "112", "name": "p2"}]},
        {"id": "12", "name": "B NAGAR PALIKA", "kind": "urban", "panchayats": []},
    ]
    assert doc["districts"][2] == {"id": "3", "name": "D3", "samitis": []}
    part = catalogue.tree(d(9, 1), s, p.filter("panchayat_id <> 112"), ["m"])
    merged = read(catalogue.merge_trees(whole, part))
    assert [x["id"] for x in merged["districts"]] == ["1", "2", "3", "9"] and merged["notes"] == ["n"] and merged["counts"]["districts"] == 2
    assert len(merged["districts"][0]["samitis"][0]["panchayats"]) == 1
    urls = spark.createDataFrame([('{"districts":[{"samitis":[{"panchayats":[{"wards":[{"pdfUrl":"https://a","supplementPdfUrls":["https://b","http://c",null]},{"pdfUrl":null},null]},{}]},{}]},{}]}',), ("{}",)], "document string")
    assert sorted(r["url"] for r in catalogue.allowed_urls(urls).collect()) == ["https://a", "https://b"]
