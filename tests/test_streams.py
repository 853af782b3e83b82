"""Streams give the batch answer, also when a batch runs twice."""

import pytest
from pyspark.sql import functions as F

from wardloom.operators import synclog, tally
from wardloom.streaming import jobs


def log(spark, n=300):
    rows = spark.range(n).select(
        F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("candidate"), F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("mark:1:"), (F.col("id") % 17).cast("string"))).otherwise(F.concat(F.lit("contact:1:"), (F.col("id") % 11).cast("string"))).alias("id"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 7919 % 1000).alias("updated_at"), (F.col("id") % 5).alias("device"), F.lit("c").alias("ciphertext"), F.lit("i").alias("iv"),
    )
    part = F.split("id", ":")
    number = F.concat(F.lit(',"serial":'), part[2], F.lit(',"workerId":"w","markedAt":"n","consentAt":"n"'), F.when(F.col("seq") % 7 == 0, ',"revoked":true').otherwise(""), F.lit("}"))
    return rows.withColumn("data", F.concat(F.lit('{"wardId":"'), part[1], F.lit('"'), number))


def start(stream, handlers, checkpoint):
    jobs.run(stream, handlers, str(checkpoint)).awaitTermination()


def test_streams_equal_batch_and_survive_a_replay(spark, tmp_path):
    rows = log(spark).cache()
    rows.repartitionByRange(5, "seq").write.parquet(str(tmp_path / "log"))
    stream = lambda: jobs.log_stream(spark, str(tmp_path / "log"))
    path = lambda name: str(tmp_path / name)
    seen = {}
    made = {
        "append": (jobs.append_once, jobs.table(path("append"))),
        "latest": (jobs.newest, jobs.table(path("latest"))),
        "push": (jobs.append_once, jobs.numbered_table(path("push"))),
        "counts": (jobs.ward_counts, jobs.keyed_table(path("counts"), "candidate", "ward")),
    }
    for name, (job, sink) in made.items():
        keep = lambda df, b, name=name: seen.setdefault(name, []).append((b, df.schema, [tuple(r) for r in df.collect()]))
        start(job(stream()), [sink, keep], tmp_path / f"cp-{name}")
        assert len(seen[name]) == 5

    def answers():
        append = jobs.stored(spark, path("append")).groupBy("candidate", "id").count().collect()
        latest = synclog.latest(jobs.stored(spark, path("latest"))).select("candidate", "id", "updated_at").collect()
        numbers = sorted(map(tuple, jobs.stored(spark, path("push")).select("candidate", "seq", "id").collect()))
        voters = sorted(map(tuple, jobs.live_counts(spark, path("counts")).collect()))
        return sorted(map(tuple, append)), sorted(map(tuple, latest)), numbers, voters

    first = answers()
    marks = rows.filter("id LIKE 'mark:%'").select("candidate", "id").distinct().withColumn("count", F.lit(1))
    others = rows.filter("id NOT LIKE 'mark:%'").groupBy("candidate", "id").count()
    assert first[0] == sorted(map(tuple, marks.unionByName(others.withColumn("count", F.col("count").cast("int"))).collect()))
    assert first[1] == sorted(map(tuple, synclog.latest(rows).select("candidate", "id", "updated_at").collect()))
    for team in ("t0", "t1"):
        mine = [n for c, n, _ in first[2] if c == team]
        assert mine == list(range(1, len(mine) + 1))
    voters = synclog.mark_records(rows).select("candidate", "ward", "serial").distinct().groupBy("candidate", "ward").count()
    assert first[3] == sorted(map(tuple, voters.collect()))
    # each record is emitted once, and never one that isn't newer
    emitted = [(r[0], r[2], r[3]) for _, _, batch in seen["latest"] for r in batch]
    newest = {}
    for c, i, t in emitted:
        assert (c, i) not in newest or t > newest[c, i]
        newest[c, i] = t
    for name, (_, sink) in made.items():  # the last batch once more, as after a crash
        batch, schema, again = seen[name][-1]
        sink(spark.createDataFrame(again, schema), batch)
    assert answers() == first
    start(jobs.newest(stream()), [lambda df, b: seen.setdefault("more", []).append(b)], tmp_path / "cp-latest")
    assert "more" not in seen  # a run that resumes finds nothing


def test_a_query_s_batches_are_dealt_to_all_cores(spark, tmp_path):
    """Six batches, each with a file for every core; equal times stay in one file, so in one batch."""
    from types import SimpleNamespace

    from wardloom.plans import log_queries

    cores = spark.sparkContext.defaultParallelism
    rows = log(spark, 3000).withColumn("updated_at", F.timestamp_seconds(1_700_000_000 + F.col("seq") % 1000))
    _, stream = log_queries._logged(SimpleNamespace(spark=spark, sync_log=rows), "dealt")
    seen = []
    keep = lambda df, b: seen.extend((b, r["file"], r["updated_at"]) for r in df.collect())
    start(stream.select("updated_at", F.input_file_name().alias("file")), [keep], tmp_path / "cp")
    assert len(seen) == 3000 and len({b for b, _, _ in seen}) == 6
    assert all(len({f for b, f, _ in seen if b == n}) == cores for n in range(6))
    assert len({(f, t) for _, f, t in seen}) == 1000


def test_a_batch_writes_its_own_keys_alone(spark, tmp_path):
    """Equal batches of new ids: what the checkpoint's state and the table grow by doesn't grow with the ids that were there."""
    import os

    def size(folder, ends):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(ends))

    spark.range(24 * 400).repartitionByRange(24, "id").select(
        F.lit("t").alias("candidate"), F.col("id").alias("seq"), F.concat(F.lit("note:"), F.format_string("%09d", "id")).alias("id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("updated_at"), F.lit(1).cast("long").alias("device"), F.lit("c").alias("ciphertext"), F.lit("i").alias("iv"), F.lit(None).cast("string").alias("data"),
    ).write.parquet(str(tmp_path / "log"))
    grown, sizes = [], []
    stream = jobs.newest(jobs.log_stream(spark, str(tmp_path / "log")))

    def measure(df, batch):
        sizes.append(size(str(tmp_path / "cp" / "state"), ".changelog") + size(str(tmp_path / "table"), ".parquet"))

    assert jobs.pull(stream, [jobs.table(str(tmp_path / "table")), measure], str(tmp_path / "cp")) == 24
    grown = [b - a for a, b in zip(sizes, sizes[1:])]
    assert abs(grown[20] - grown[5]) < 0.2 * grown[5] and grown[5] > 0, grown


def test_counts_hold_a_row_for_each_ward(spark, tmp_path):
    log(spark, 600).repartitionByRange(6, "seq").write.parquet(str(tmp_path / "log"))
    jobs.pull(jobs.ward_counts(jobs.log_stream(spark, str(tmp_path / "log"))), [jobs.keyed_table(str(tmp_path / "c"), "candidate", "ward")], str(tmp_path / "cp"))
    raw = spark.read.parquet(str(tmp_path / "c"))
    assert raw.count() == raw.select("candidate", "ward").distinct().count() == 2


def test_state_stores_are_bounded_by_cores(spark, tmp_path):
    """A session with many partitions for a large input: a stateful step has no more stores than cores can use, and a resumed run keeps them."""
    name, most = "spark.sql.shuffle.partitions", jobs.STORES * spark.sparkContext.defaultParallelism
    rows = log(spark, 600).cache()
    before = spark.conf.get(name)

    def stores():
        return {len([s for s in step.iterdir() if s.name.isdigit()]) for step in (tmp_path / "cp" / "state").iterdir()}

    def run(part, asked):
        rows.filter(part).repartitionByRange(2, "seq").write.mode("append").parquet(str(tmp_path / "log"))
        spark.conf.set(name, asked)
        try:
            stream = jobs.ward_counts(jobs.log_stream(spark, str(tmp_path / "log")))
            jobs.pull(stream, [jobs.keyed_table(str(tmp_path / "c"), "candidate", "ward")], str(tmp_path / "cp"))
            assert spark.conf.get(name) == asked
        finally:
            spark.conf.set(name, before)

    run("seq < 300", str(8 * most))
    assert stores() == {most}
    run("seq >= 300", "3")
    assert stores() == {most}
    voters = synclog.mark_records(rows).select("candidate", "ward", "serial").distinct().groupBy("candidate", "ward").count()
    assert sorted(map(tuple, jobs.live_counts(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, voters.collect()))


def test_a_run_takes_so_many_pages(spark, tmp_path):
    log(spark, 70).repartitionByRange(7, "seq").write.parquet(str(tmp_path / "log"))
    table = str(tmp_path / "t")
    stream = jobs.append_once(jobs.log_stream(spark, str(tmp_path / "log")))
    assert [jobs.pull(stream, [jobs.table(table)], str(tmp_path / "cp"), pages=3) for _ in range(4)] == [3, 3, 1, 0]
    assert jobs.stored(spark, table).filter("id NOT LIKE 'mark:%'").count() == log(spark, 70).filter("id NOT LIKE 'mark:%'").count()


def test_counters_have_two_versions(spark, tmp_path):
    log(spark, 90).filter("id NOT LIKE 'mark:%'").repartitionByRange(6, "seq").write.parquet(str(tmp_path / "log"))
    start(jobs.append_once(jobs.log_stream(spark, str(tmp_path / "log"))), [jobs.numbered_table(str(tmp_path / "p"))], tmp_path / "cp")
    assert len(list((tmp_path / "p-counters").glob("batch=*"))) == 2
    assert jobs.stored(spark, str(tmp_path / "p")).groupBy("candidate").agg(F.max("seq") - F.count("*")).collect() == [("t0", 0), ("t1", 0)]


def test_one_failing_handler_leaves_the_others(spark, tmp_path):
    log(spark, 20).write.parquet(str(tmp_path / "log"))

    def fails(df, batch):
        raise RuntimeError("no")

    stream = jobs.append_once(jobs.log_stream(spark, str(tmp_path / "log")))
    q = jobs.run(stream, [fails, jobs.table(str(tmp_path / "t"))], str(tmp_path / "cp"))
    with pytest.raises(Exception, match="no"):
        q.awaitTermination()
    assert jobs.stored(spark, str(tmp_path / "t")).count() > 0


def test_malformed_records_are_kept_apart(spark, tmp_path):
    bad = [("t", 900, None, None, 1, "c", "i", None), ("t", 901, "mark:1:1", None, 1, "c", "i", None), ("t", 902, "x" * 201, None, 1, "c", "i", None), (None, 903, "mark:1:2", None, 1, "c", "i", None)]
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    odd = spark.createDataFrame(bad, jobs.LOG_SCHEMA).withColumn("updated_at", F.when(F.col("seq").isin(902, 903), at))
    log(spark, 20).unionByName(odd).repartition(1).write.parquet(str(tmp_path / "log"))
    stream = lambda: jobs.log_stream(spark, str(tmp_path / "log"))
    for job, name in ((jobs.append_once, "append"), (jobs.newest, "latest"), (jobs.malformed, "rejected")):
        start(job(stream()), [jobs.table(str(tmp_path / name))], tmp_path / f"cp-{name}")
    seqs = lambda name: {r["seq"] for r in jobs.stored(spark, str(tmp_path / name)).collect()}
    assert seqs("rejected") == {900, 901, 902, 903} and not (seqs("append") | seqs("latest")) & seqs("rejected")


def test_a_team_reads_its_own_records_from_the_start(spark, tmp_path):
    log(spark, 40).repartition(2).write.parquet(str(tmp_path / "log"))
    for team in ("t0", "t1"):
        stream = jobs.append_once(jobs.log_stream(spark, str(tmp_path / "log"), team=team))
        for _ in range(2):  # the second run resumes and finds nothing
            start(stream, [jobs.table(str(tmp_path / team))], jobs.checkpoint_of(str(tmp_path / "cp"), team))
        assert {r["candidate"] for r in jobs.stored(spark, str(tmp_path / team)).collect()} == {team}


def test_contacts_outlive_a_malformed_record(spark, tmp_path):
    at = "2024-01-01 00:00:0"
    record = lambda s, rest: '{"wardId":"3","serial":%d%s}' % (s, rest)
    good, bad, gone = ',"phone":"9876543210","consentAt":"a"', ',"phone":"12","consentAt":"b"', ',"revoked":true'
    rows = [(1, 1, good), (2, 1, bad), (3, 2, good), (4, 2, gone), (5, 3, bad), (6, 4, bad), (7, 4, good), (8, 5, gone), (9, 5, bad)]
    made = [("t", n, f"contact:3:{s}", f"{at}{n}", 1, "c", "i", record(s, rest)) for n, s, rest in rows]
    df = spark.createDataFrame(made, jobs.LOG_SCHEMA.replace("timestamp", "string")).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    for files in (1, 9):
        df.repartitionByRange(files, "seq").write.parquet(str(tmp_path / f"log{files}"))
        table = str(tmp_path / f"c{files}")
        jobs.pull(jobs.newest_contacts(jobs.log_stream(spark, str(tmp_path / f"log{files}"))), [jobs.table(table)], str(tmp_path / f"cp{files}"))
        got = sorted(tuple(r) for r in jobs.live_contacts(spark, table).collect())
        assert got == [("t", "3", 1, "9876543210", "a"), ("t", "3", 4, "9876543210", "a")]


def test_messages_join_the_marks(spark, tmp_path):
    """A serial marked over the log is a duplicate by message, whichever came in an earlier batch; outside serials aren't marked."""
    body = lambda s: '{"wardId":"1","serial":%d,"workerId":"w9","markedAt":"n"}' % s
    entry = lambda n, s: ("team", n, f"mark:1:{s}", "2024-01-01 00:00:00", 1, "c", "i", body(s))
    schema = jobs.LOG_SCHEMA.replace("timestamp", "string")
    put = lambda rows: spark.createDataFrame(rows, schema).withColumn("updated_at", F.col("updated_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    marks = spark.createDataFrame([("team", "w1", 1, n) for n in (1, 2, 3, 77)], "candidate string, worker string, ward bigint, serial bigint")
    sms = tally.encode_messages(marks).select("candidate", "ward", "text").coalesce(1)
    roll = spark.createDataFrame([(1, n, n == 40) for n in range(1, 41)], "ward bigint, serial bigint, struck boolean")
    put([entry(1, 1)])
    sms.limit(0).write.parquet(str(tmp_path / "sms"))
    messages = spark.readStream.schema(sms.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "sms"))
    reports = jobs.message_marks(messages, roll, jobs.log_stream(spark, str(tmp_path / "log")))
    seen = []

    def pull():
        seen.clear()
        jobs.pull(reports, [lambda df, b: seen.extend((r["serial"], r["state"]) for r in df.collect())], str(tmp_path / "cp"))
        return sorted(seen)

    assert pull() == []
    sms.write.mode("append").parquet(str(tmp_path / "sms"))
    assert pull() == [(1, "duplicate"), (2, "new"), (3, "new"), (77, "outside")]
    put([entry(2, 2), entry(3, 5)])
    bad = sms.withColumn("text", F.lit("PT1 x"))
    sms.unionByName(sms).unionByName(bad).coalesce(1).write.mode("append").parquet(str(tmp_path / "sms"))
    assert pull() == [(n, "duplicate") for n in (1, 1, 2, 2, 3, 3)] + [(77, "outside")] * 2
    tally.encode_messages(marks.withColumn("serial", F.col("serial") + 2).filter("serial < 9")).select("candidate", "ward", "text").coalesce(1).write.mode("append").parquet(str(tmp_path / "sms"))
    assert pull() == [(3, "duplicate"), (4, "new"), (5, "duplicate")]


def test_mixed_times_in_a_stream(spark, tmp_path):
    """Batches of an id's records are folded one after the other, as the batch operator folds them at once."""
    times = ['"2024-01-01T05:30:00+05:30"', "1704067200500", '"2024-01-01T00:00:01Z"', '"soon"', "1704067200999", "1704067201000", '"2024-01-01T00:00:02Z"', "5"]
    rows = [("t", "abc"[n % 3], n, t) for n, t in enumerate(times * 4)]
    df = spark.createDataFrame(rows, "candidate string, id string, seq bigint, t string")
    df = df.select("candidate", "id", "seq", F.parse_json("t").alias("updated_at"), F.lit("c").alias("ciphertext"), F.lit("i").alias("iv"))
    for k in range(0, 32, 8):
        df.filter(F.col("seq").between(k, k + 7)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    schema = "candidate string, id string, seq bigint, updated_at variant, ciphertext string, iv string"
    stream = jobs.newest_mixed(jobs.log_stream(spark, str(tmp_path / "log"), schema=schema))
    last = {}
    keep = lambda rows, b: last.update({r["id"]: r["seq"] for r in rows.orderBy("seq").collect()})
    jobs.pull(stream, [keep], str(tmp_path / "cp"))
    assert last == {r["id"]: r["seq"] for r in synclog.latest_mixed(df).collect()} and len(last) == 3


def test_messages_come_line_by_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    got = []
    jobs.run(jobs.message_stream(spark, str(tmp_path / "in")), [lambda df, b: got.extend(r["text"] for r in df.collect())], str(tmp_path / "cp")).awaitTermination()
    assert got == ["one", "two"]
