"""Sources and sinks."""

import pytest
from pyspark.sql import functions as F

from wardloom.sources import builds, pages, rolls

HTML = """<form><input type="hidden" name="v" value="1"><select name="d"><option value="0">--Select--<option value="7" selected>Jaipur</option></select>
<table><tr><th>Ward</th><th>Final</th></tr><tr><td> 1 </td><td><a href="a.pdf">View</a></td></tr></table></form>"""


def test_page_rows(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "<b")], "page_id long, html string")
    rows = pages.page_rows(df)
    got = {(r["kind"], r["row"], r["col"], r["name"], r["value"], r["text"]) for r in rows.filter("page_id = 1").collect()}
    assert ("hidden", None, None, "v", "1", "") in got and ("link", 1, 1, "", "a.pdf", "View") in got and ("cell", 1, 0, "", "", "1") in got
    assert [r["text"] for r in pages.real_options(rows).collect()] == ["Jaipur"]
    assert [tuple(r) for r in pages.selected(rows, "d").collect()] == [(1, "7", "Jaipur")] and pages.selected(rows, "x").count() == 0
    assert rows.filter("page_id = 2").count() == 0


def test_rolls_replace_one_ward_and_gate_versions(spark, tmp_path):
    path = str(tmp_path / "r")
    base = spark.createDataFrame([(w, s, "n") for w in (1, 2) for s in (1, 2, 3)], "ward bigint, serial bigint, name string")
    rolls.write_rolls(base, path)
    rolls.write_rolls(base.filter("ward = 1 AND serial = 1"), path)
    assert rolls.read_rolls(spark, path).groupBy("ward").count().orderBy("ward").collect() == [(1, 1), (2, 3)]
    assert rolls.read_rolls(spark, path, [2]).count() == 3
    for version, ok in ((2, True), (9, False)):
        other = str(tmp_path / f"v{version}")
        wards = base.select("ward").distinct()
        builds.commit(base.withColumn("schema_version", F.lit(version)), wards, other, ["ward"], ["serial"], partial=True)
        if ok:
            assert rolls.read_rolls(spark, other).count() == 0
        else:
            with pytest.raises(Exception, match="unknown schema version"):
                rolls.read_rolls(spark, other).collect()


def test_rolls_keep_state_urls_and_four_part_keys(spark, tmp_path):
    path, by = str(tmp_path / "r"), rolls.WARD
    rows = [("d", "s", "p/q", w, n, "deletion" if n == 1 else None) for w in ("1", "01") for n in (2, 1)]
    entries = spark.createDataFrame(rows, "district string, samiti string, panchayat string, ward string, serial long, supplement string")
    states = spark.createDataFrame([("d", "s", "p/q", "1", "merged", ["u1", "u2"]), ("d", "s", "p/q", "7", "failed", [])], f"{', '.join(c + ' string' for c in by)}, state string, urls array<string>")
    rolls.write_rolls(entries, path, states, by)
    got = {r["ward"]: (r["state"], r["urls"]) for r in rolls.read_states(spark, path, by).collect()}
    assert got == {"1": ("merged", ["u1", "u2"]), "01": ("none", []), "7": ("failed", [])}
    read = rolls.read_rolls(spark, path, by=by)
    assert sorted((r["panchayat"], r["ward"], r["serial"], r["supplement"]) for r in read.collect()) == sorted((p, w, n, t) for _, _, p, w, n, t in rows)
    assert "PartitionFilters: [" in read.filter("ward = '1'")._jdf.queryExecution().toString() and read.filter("ward = '1'").count() == 2
    with pytest.raises(Exception, match="unknown supplement state"):
        rolls.write_rolls(entries, path, states.withColumn("state", F.lit("odd")), by)
    assert rolls.read_rolls(spark, path, by=by).count() == 4  # what failed has changed nothing


def test_catalogue_builds(spark, tmp_path):
    path = str(tmp_path / "c")
    docs = lambda *rows: spark.createDataFrame([(d, f"n{d}", f"N{d}", f"{f}.json", t) for d, f, t in rows], "district_id string, name string, name_latin string, file string, document string")
    read = lambda n=None: sorted((r["district_id"], r["file"], r["document"]) for r in rolls.read_documents(spark, path, n).collect())
    listed = lambda: sorted((r["id"], r["file"]) for r in rolls.read_listing(spark, path).collect())
    assert rolls.read_listing(spark, path).count() == 0 and rolls.read_documents(spark, path).count() == 0
    assert rolls.write_catalogue(docs(("1", "a", "old"), ("2", "b", "old")), path) == 1
    before = rolls.read_documents(spark, path)
    assert rolls.write_catalogue(docs(("1", "a2", "new")), path, partial=True) == 2
    assert read() == [("1", "a2.json", "new"), ("2", "b.json", "old")] and listed() == [("1", "a2.json"), ("2", "b.json")]
    assert read(1) == sorted(map(tuple, before.select("district_id", "file", "document").collect())) == [("1", "a.json", "old"), ("2", "b.json", "old")]
    rolls.write_catalogue(docs(("2", "b", "last")), path)
    assert read() == [("2", "b.json", "last")] and listed() == [("2", "b.json")]
    assert len(builds.clean(spark, path, keep=1)) == 2 and read() == [("2", "b.json", "last")]


def test_a_build_that_fails_before_its_commit_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    rows = lambda v: spark.createDataFrame([(k, v) for k in (1, 2)], "k int, v string")
    put = lambda v: builds.commit(rows(v), rows(v).select("k"), path, ["k"], ["v"], partial=True)
    read = lambda: sorted(map(tuple, builds.read(spark, path, "v string, k int", ["k"]).collect()))
    put("old")
    monkeypatch.setattr(builds, "_numbers", lambda *_: [])  # a writer that began before the other's commit
    with pytest.raises(Exception, match="exists"):
        put("late")
    monkeypatch.undo()
    assert read() == [("old", 1), ("old", 2)]
    put("new")
    assert read() == [("new", 1), ("new", 2)]
    assert len(builds.clean(spark, path, keep=1)) == 2 and read() == [("new", 1), ("new", 2)]


PORTAL = """<table><tr><td>Search</td></tr></table><table><tr><th>Sr</th><th>Grampanchayat</th><th>Ward No.</th><th>Final PDF</th><th>Final With Supp-2 PDF</th></tr>
<tr><td>1</td><td>ग्राम</td><td> 1 </td><td><a href="javascript:__doPostBack('g$1','')">View</a></td><td><input type="image" src="p.png"></td></tr>
<tr><td>2</td><td>ग्राम</td><td>2</td><td><a href="x/y.PDF">View</a></td><td><a href="#">none</a></td></tr>
<tr><td>3</td><td>ग्राम</td><td>x</td><td><a href="#" onclick="go()">View</a></td><td><a name="n">-</a></td></tr><tr><td colspan="5">1 2 3</td></tr></table>"""


def test_a_portal_page_becomes_ward_rows(spark):
    from wardloom.operators import catalogue

    df = spark.createDataFrame([(1, PORTAL), (2, "<table><tr><td>error</td></tr></table>")], "page_id long, html string")
    rows = catalogue.grid_wards(pages.grid_cells(pages.page_rows(df))).orderBy("row").collect()
    assert [tuple(r)[2:] for r in rows] == [("1", "ग्राम", True, True), ("2", "ग्राम", True, False), ("x", "ग्राम", True, False)]


def test_messages_are_read_line_by_line(spark, tmp_path):
    (tmp_path / "sms.txt").write_text("PT1 a b c d\n\nx\n")
    assert [r["text"] for r in rolls.read_messages(spark, str(tmp_path / "sms.txt")).collect()] == ["PT1 a b c d", "", "x"]
