"""Every query against its SQL on the smallest tables, by DuckDB."""

import decimal
import os

import duckdb
import pytest

from wardloom.operators import tally
from wardloom.plans import registry
from wardloom.plans.adapters import TABLES
from wardloom.streaming import jobs

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def of(x):
        if isinstance(x, decimal.Decimal):
            x = int(x) if x == int(x) else float(x)
        return repr(round(x, 6)) if isinstance(x, float) else repr(x)

    return sorted(tuple(of(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


def test_queries_without_sql(spark):
    found = registry.queries()["match_ranges"](spark, DATA).collect()
    assert found and all(r["name"][a:b] == "ring" for r in found for a, b in r["ranges"])
    assert all(len(r["ranges"]) == r["name"].count("ring") for r in found)


def test_batch_search_asks_for_whole_passages(spark, tmp_path):
    """Twenty documents share a passage's start; the one that holds all of it is the only hit."""
    passage = "the the then river of Lorem goes by the old mill"
    docs = [(i, f"{passage[:12]} and other words {i}") for i in range(20)] + [(20, f"before. {passage} after")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(64, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["batch_search"](spark, str(tmp_path)).collect()
    assert [tuple(r[c] for c in ("item_id", "place", "doc_id", "tier")) for r in got] == [(64, 1, 20, 2)]


def test_stream_sms_uses_all_cores_and_reads_the_log_once_to_pack(spark, monkeypatch):
    """A batch of the log has a file for every core, and messages are packed from stored voters, not from the log's plan."""
    logs, plans = [], []
    log_stream, encode = jobs.log_stream, tally.encode_messages

    def logged(session, path, files=1, *rest):
        logs.append((len(session.read.parquet(path).inputFiles()), files))
        return log_stream(session, path, files, *rest)

    def encoded(marks):
        plans.append(marks._jdf.queryExecution().optimizedPlan().toString())
        return encode(marks)

    monkeypatch.setattr(jobs, "log_stream", logged)
    monkeypatch.setattr(tally, "encode_messages", encoded)
    assert registry.queries()["stream_sms"](spark, DATA).count() > 0
    cores = spark.sparkContext.defaultParallelism
    assert logs == [(cores, cores)]
    assert len(plans) == 1 and "Join" not in plans[0] and plans[0].startswith("Relation")
