"""Consent, call lists, and who calls whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.functions import text as X


def consent_state(log: DataFrame, keys: tuple[str, ...] = ("candidate", "ward", "serial")) -> DataFrame:
    """Who has consented, since when, and the last valid number since; a revocation deletes all before it.

    One aggregate finds the last revocation, another folds what came after it,
    so no window sorts a hot voter's entries.
    """
    revoked = log.groupBy(*keys).agg(F.max(F.when(F.col("revoked"), F.col("seq"))).alias("__last"))
    rows = log.filter(~F.col("revoked")).withColumn("number", X.phone(F.col("phone")))
    rows = rows.join(revoked, list(keys)).filter("__last IS NULL OR seq > __last")
    valid = F.when(F.col("number").isNotNull(), F.col("seq"))
    return rows.groupBy(*keys).agg(F.min_by("consent_at", "seq").alias("consent_at"), F.max_by("number", valid).alias("phone"))


def call_list(consented: DataFrame, assignments: DataFrame, roll: DataFrame) -> DataFrame:
    """Consented voters with their worker and their name ('' if the roll hasn't it)."""
    rows = consented.join(assignments, "serial", "left").join(roll.select("ward", "serial", "name"), ["ward", "serial"], "left")
    return rows.withColumn("name", F.coalesce("name", F.lit("")))


def called_lookup(consented: DataFrame, assignments: DataFrame) -> DataFrame:
    """For every team, assigned voters whose serial it has consent for in exactly one ward."""
    one = consented.groupBy("candidate", "serial").agg(F.min("ward").alias("ward"), F.max("ward").alias("__other")).filter("ward = __other")
    called = one.join(assignments.select("serial").distinct(), "serial", "left_semi")
    return called.select("candidate", "ward", "serial", X.voter_key(F.col("ward"), F.col("serial")).alias("voter_key"))


def roster_union(roster: DataFrame, assignments: DataFrame) -> DataFrame:
    """The roster, and assigned workers that it lacks."""
    extra = assignments.groupBy("worker_id").agg(F.min("worker_name").alias("worker_name")).join(roster, "worker_id", "left_anti")
    return roster.select("worker_id", "worker_name").unionByName(extra.select("worker_id", "worker_name"))


def add_workers(roster: DataFrame, names: DataFrame) -> DataFrame:
    """The roster after adding ``names`` (name): a name that it has already adds nobody."""
    new = names.select(X.strip_white(F.col("name")).alias("worker_name")).filter("worker_name <> ''").distinct()
    known = roster.select(X.strip_white(F.col("worker_name")).alias("worker_name"))
    key = F.concat(F.lit("new-"), F.substring(F.sha2("worker_name", 256), 1, 8))
    added = new.join(known, "worker_name", "left_anti").select(key.alias("worker_id"), "worker_name")
    return roster.select("worker_id", "worker_name").unionByName(added)


def assignment_state(log: DataFrame) -> DataFrame:
    """One assignee per voter: the last entry of (serial, seq, worker_id) stands, a null worker unassigns."""
    last = log.groupBy("serial").agg(F.max_by("worker_id", "seq").alias("worker_id"), F.max("seq").alias("seq"))
    return last.filter("worker_id IS NOT NULL").select("serial", "worker_id")
