"""Structured Streaming jobs over the sync log.

State is Spark's own: one row per key in a state store (RocksDB with changelog
checkpoints, see ``keyed_state``), which a batch touches for its own keys only.
A transformation takes a stream and returns one; a sink writes its batches.  A
batch that runs again after a crash finds the state as it was before it and
overwrites what it wrote, by its number: delivery is at least once, the tables
are exactly once.  Every key carries the candidate.  Malformed records never
stop a batch: ``sound`` and ``malformed`` part them.

Which rows came with the batch at hand is told by the batch's time, which Spark
logs before it runs, so a batch that runs again has the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wardloom.operators import synclog, tally

Handler = Callable[[DataFrame, int], None]
LOG_SCHEMA = (
    "candidate string, seq bigint, id string, updated_at timestamp, device bigint, ciphertext string, iv string, data string"
)
COUNTS_SCHEMA = "candidate string, ward string, voters bigint"
SMS_SCHEMA = "candidate string, ward bigint, serial bigint, worker string, state string"
#: Batches (pages) of one run, at most.
PAGES = 50
#: State stores of a stateful step for each core, at most.  A store costs a commit in every batch, with or without rows.
STORES = 2
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keeps the state of streams that start from now on in RocksDB, whose commits write changes alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


# sources


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 1, team: str | None = None, schema: str = LOG_SCHEMA) -> DataFrame:
    """The log's files in order of arrival, of one team if asked."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows if team is None else rows.filter(F.col("candidate") == team)


def message_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """One message per line of text files as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "text")


def checkpoint_of(root: str, team: str) -> str:
    """A checkpoint for each team: another team starts from the beginning, the same one resumes."""
    return f"{root}/team={team.encode('utf-8').hex()}"


# transformations


def sound(rows: DataFrame) -> DataFrame:
    return rows.filter(synclog.valid_record())


def malformed(rows: DataFrame) -> DataFrame:
    return rows.filter(~synclog.valid_record())


def _one_per_key(rows: DataFrame, keys: tuple[str, ...], best: Callable[[Column], Column]) -> DataFrame:
    """The row that ``best`` picks of each key's, in the batches that change the pick.  ``best`` gets the batch's time, earlier first."""
    fields = [c for c in rows.columns if c not in keys]
    now = F.current_timestamp()
    kept = rows.withColumn("__came", now).groupBy(*keys).agg(best(F.struct(*fields, "__came")).alias("r"))
    return kept.filter(F.col("r.__came") == now).select(*keys, *(F.col(f"r.{c}").alias(c) for c in fields)).select(*rows.columns)


def append_once(rows: DataFrame) -> DataFrame:
    """The sound records; a mark id once per candidate, the first that came (of one batch's the first by seq)."""
    is_mark = F.col("id").startswith("mark:")
    rows = sound(rows)
    first = lambda r: F.min_by(r, F.struct("__came", "seq"))
    return _one_per_key(rows.filter(is_mark), synclog.ID, first).unionByName(rows.filter(~is_mark))


def newest(rows: DataFrame) -> DataFrame:
    """The records that are strictly newer than all before for their id; of one batch's the newest, of equal times the first."""
    last = lambda r: F.max_by(r, F.struct("updated_at", -F.unix_micros("__came"), -F.col("seq")))
    return _one_per_key(sound(rows), synclog.ID, last)


def newest_contacts(rows: DataFrame) -> DataFrame:
    """``newest`` over well-formed contact records alone: a malformed later one leaves what was there."""
    return newest(synclog.contact_records(sound(rows)))


def ward_counts(rows: DataFrame) -> DataFrame:
    """Voters marked per candidate and ward, for the wards that a batch changes."""
    marks = synclog.mark_records(sound(rows)).select(*tally.VOTER)
    return marks.dropDuplicates(list(tally.VOTER)).groupBy("candidate", "ward").agg(F.count("*").alias("voters"))


class _Newest(StatefulProcessor):
    """Folds an id's records in order of arrival over times that are numbers or texts; the state is the last one taken."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "number double, text string, ms double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = tuple(self.last.get()) if self.last.exists() else None
        best, taken = known, None
        for row in sorted(rows, key=lambda r: r.seq):
            time = (row.number, row.time, row.ms)
            if best is None or synclog.newer_time(time, best):
                best, taken = time, row
        if taken is not None:
            self.last.update(best)
            yield taken

    def close(self) -> None:
        pass


def newest_mixed(rows: DataFrame) -> DataFrame:
    """As ``newest``, for logs whose ``updated_at`` is a VARIANT: numbers, texts, or both under one id.

    Such times have no order of their own (see ``synclog.is_newer``), so each
    id's records are folded as they come: by batch, and by seq within one.
    """
    rows = synclog.typed_time(rows.filter(synclog.valid_record() & synclog.valid_time("updated_at")))
    flat = rows.drop("updated_at")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema)
    found = flat.groupBy(*synclog.ID).transformWithState(_Newest(), kinds, "Update", "none")
    return synclog.untyped_time(found)


class _FirstMark(StatefulProcessor):
    """A voter's first mark, by whichever way it came; reports each one that came by message."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "worker string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.mark.exists()
        for row in sorted(rows, key=lambda r: (r.by_message, r.seq)):
            if row.by_message:
                yield Row(candidate=key[0], ward=key[1], serial=key[2], worker=row.worker, state="duplicate" if known else "new")
            if not known:
                self.mark.update((row.worker,))
                known = True

    def close(self) -> None:
        pass


def message_marks(messages: DataFrame, roll: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Marks by message (candidate, ward, text) against those that came over the log, in one state: the first stands.

    Every message reports each of its serials once: 'new', 'duplicate' (marked
    before, over either way) or 'outside', which isn't marked: no unstruck entry
    of ``roll`` has it.  Within a batch the log comes first.  Messages that
    can't be read are left out; ``tally.decode_messages`` gives their reasons.
    """
    read = tally.decode_messages(messages).filter("reason IS NULL")
    sent = read.select("candidate", "ward", F.col("sender").alias("worker"), F.explode(F.array_distinct("serials")).alias("serial"))
    sent = tally.in_roll(sent, roll)
    outside = sent.filter("NOT inside").select("candidate", "ward", "serial", "worker", F.lit("outside").alias("state"))
    mark = ["candidate", "ward", "serial", "worker"]
    rows = sent.filter("inside").select(*mark, F.lit(True).alias("by_message"), F.lit(0).cast("bigint").alias("seq"))
    if log is not None:
        synced = synclog.mark_records(sound(log)).withColumn("ward", F.col("ward").try_cast("bigint")).filter("ward IS NOT NULL")
        rows = rows.unionByName(synced.select(*mark, F.lit(False).alias("by_message"), "seq"))
    inside = rows.groupBy("candidate", "ward", "serial").transformWithState(_FirstMark(), SMS_SCHEMA, "Update", "none")
    return inside.unionByName(outside)


# sinks


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _numbered(rows: DataFrame, batch: int) -> DataFrame:
    return rows.withColumn("batch", F.lit(batch).cast("bigint"))


def stored(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """All rows that ``table`` has written."""
    return _read(spark, path, f"{schema}, batch bigint").drop("batch")


def table(path: str) -> Handler:
    """Appends each batch's rows, under the batch's number."""
    return lambda rows, batch: _write(_numbered(rows, batch), path, "batch")


def keyed_table(path: str, *keys: str) -> Handler:
    """Keeps the newest rows of each key: a batch overwrites the keys that it has and no others."""
    return lambda rows, batch: _write(rows.repartition(*keys), path, *keys)


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The batches under ``path`` and their folders, by the folders' names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    return {int(s.getPath().getName().split("=")[1]): s.getPath().toString() for s in found}


def numbered_table(path: str) -> Handler:
    """As ``table``, and numbers the rows contiguously per candidate, on from the counters that the batch before left.

    ``<path>-counters`` holds a row per candidate (a team) and the two newest
    versions of it, whatever has been written.
    """
    counters, kind = f"{path}-counters", "candidate string, counter bigint"

    def handle(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        versions = _versions(spark, counters)
        last = max((v for v in versions if v < batch), default=None)
        known = spark.read.schema(kind).parquet(versions[last]) if last is not None else spark.createDataFrame([], kind)
        numbered = synclog.assign_sequence(rows, known, "seq")
        _write(_numbered(numbered.withColumn("seq", F.col("new_seq").cast("bigint")).drop("new_seq"), batch), path, "batch")
        mine = spark.read.schema(LOG_SCHEMA).parquet(f"{path}/batch={batch}") if batch in _versions(spark, path) else spark.createDataFrame([], LOG_SCHEMA)
        tops = mine.groupBy("candidate").agg(F.max("seq").alias("counter"))
        synclog.merge_counters(known, tops).coalesce(1).write.mode("overwrite").parquet(f"{counters}/batch={batch}")
        for v, folder in versions.items():
            if last is not None and v < last:
                old = spark._jvm.org.apache.hadoop.fs.Path(folder)
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return handle


def live_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts as ``keyed_table`` holds them: a row per candidate and ward."""
    return _read(spark, path, COUNTS_SCHEMA).select("candidate", "ward", "voters")


def live_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Voters with consent by what ``newest_contacts`` gave: the newest record each, but revoked ones."""
    schema = f"{LOG_SCHEMA}, ward string, phone string, consent_at string, revoked boolean, serial bigint"
    latest = synclog.latest(stored(spark, path, schema))
    return latest.filter(~F.col("revoked")).select("candidate", "ward", "serial", "phone", "consent_at")


# runs


class _Enough(Exception):
    """A run has taken all the batches that it may."""


def _each(handlers: list[Handler], pages: int | None, done: list[int]) -> Handler:
    def each(rows: DataFrame, batch: int) -> None:
        if pages is not None and len(done) >= pages:
            raise _Enough("the run's batches are used up")
        # Read twice, a batch would touch its state twice.  Coalescing to more partitions than there are moves
        # nothing, and hides the sorted order of a stateful plan, which a persisted batch can't carry.
        rows = rows.coalesce(1 << 20).persist()
        failed = []
        for handle in handlers:
            try:
                handle(rows, batch)
            except Exception as e:  # the batch fails in the end and is delivered again
                failed.append(e)
        rows.unpersist()
        if failed:
            raise failed[0]
        done.append(batch)

    return each


def _start(stream: DataFrame, each: Handler, checkpoint: str, every: str | None) -> StreamingQuery:
    """Starts with as many state stores as cores can use, however many partitions the session has for its input.

    A stream takes the session's settings as it starts; one that resumes keeps the stores of its checkpoint.
    """
    spark, name = stream.sparkSession, "spark.sql.shuffle.partitions"
    keyed_state(spark)
    asked = spark.conf.get(name)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    spark.conf.set(name, str(min(int(asked), STORES * spark.sparkContext.defaultParallelism)))
    try:
        return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**trigger).start()
    finally:
        spark.conf.set(name, asked)


def run(stream: DataFrame, handlers: list[Handler], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts a query whose batches go to every handler; a handler that fails doesn't keep the others from running.

    Runs on what is available now, or at an interval such as '60 seconds'.
    """
    return _start(stream, _each(handlers, None, []), checkpoint, every)


def pull(stream: DataFrame, handlers: list[Handler], checkpoint: str, pages: int = PAGES) -> int:
    """Runs what is available now, ``pages`` batches at most, and says how many they were; the next run goes on after them."""
    done: list[int] = []
    started = _start(stream, _each(handlers, pages, done), checkpoint, None)
    try:
        started.awaitTermination()
    except Exception as e:
        if _Enough.__name__ not in str(e):
            raise
    return len(done)
