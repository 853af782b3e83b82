"""Households: live voters of one house in a ward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.functions import text as X


def households(roll: DataFrame) -> DataFrame:
    """ward, key, house (its first spelling) and members (serial, name by serial) of live entries with a house."""
    rows = roll.filter(~F.col("struck")).withColumn("key", X.house_key(F.col("house"))).filter("key <> ''")
    members = F.sort_array(F.collect_list(F.struct("serial", "name")))
    return rows.groupBy("ward", "key").agg(F.min_by(F.trim("house"), "pos").alias("house"), members.alias("members"), F.count("*").alias("size"))


def find_household(index: DataFrame, query: str) -> DataFrame:
    return index.filter(F.col("key") == X.house_key(F.lit(query)))


def household_members(index: DataFrame, consented: DataFrame, tags: DataFrame, visits: DataFrame) -> DataFrame:
    """A row per member and team that has their consent (one with a null team, if none has), with phone, tag and visit.

    ``consented`` is what ``calls.consent_state`` gives, so a number that was
    revoked is gone and a team sees its own numbers alone.  ``tags`` and
    ``visits`` are (voter_key, value); several values of a voter are joined.
    """
    rows = index.select("ward", "key", F.explode("members").alias("m")).select("ward", "key", "m.serial", "m.name")
    rows = rows.join(consented.select("candidate", "ward", "serial", "phone"), ["ward", "serial"], "left")
    rows = rows.withColumn("voter_key", X.voter_key(F.col("ward"), F.col("serial")))
    for name, lookup in (("tag", tags), ("visit", visits)):
        values = F.array_join(F.sort_array(F.collect_set("value")), ", ")
        rows = rows.join(lookup.groupBy("voter_key").agg(values.alias(name)), "voter_key", "left")
    return rows.select("candidate", "ward", "key", "serial", "name", "phone", "tag", "visit")


def ordered_members(df: DataFrame, parent: str, order: str, value: str) -> DataFrame:
    """Children of each parent in order, in one array."""
    return df.groupBy(parent).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda m: m[value]).alias("members"))
