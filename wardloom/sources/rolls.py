"""Reading and writing stored tables: rolls by ward, the catalogue by district, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.sources import builds

_FIELDS = "schema_version int, serial bigint, name string, relative string, age int, gender string, house string, struck boolean, supplement string"
ROLL_SCHEMA = f"{_FIELDS}, ward bigint"
VERSION = 3
#: Versions that read as absent; any other but VERSION is an error.
STALE = (1, 2)
#: The parts of a ward's key, outermost first, where a roll has them all.
WARD = ("district", "samiti", "panchayat", "ward")
# What a stored ward's supplement state may be.
STATES = ("none", "merged", "failed")


def _known() -> Column:
    return F.when(F.col("schema_version") == VERSION, True).when(F.col("schema_version").isin(*STALE), False)


def _current(rows: DataFrame) -> DataFrame:
    """Rows of this version; stale ones are absent, others an error."""
    return rows.filter(F.coalesce(_known(), F.raise_error(F.lit("unknown schema version")).cast("boolean"))).drop("schema_version")


def _kinds(by: tuple[str, ...]) -> str:
    return ", ".join(f"{c} {'bigint' if by == ('ward',) else 'string'}" for c in by)


def write_rolls(rolls: DataFrame, path: str, states: DataFrame | None = None, by: tuple[str, ...] = ("ward",)) -> int:
    """Replaces, by one commit, the wards that ``rolls`` or ``states`` hold, and leaves the others.

    ``states`` (the columns ``by``, state, urls) says of each ward what its
    supplements came to and which of them are merged; wards that it lacks are
    'none' without any, wards that only it has are stored without entries.
    """
    by_ = list(by)
    wards = rolls.select(*by_).distinct()
    if states is not None:
        sound = F.when(F.col("state").isin(*STATES), F.col("state"))
        state = F.coalesce(sound, F.raise_error(F.lit("unknown supplement state")).cast("string"))
        wards = wards.join(states.select(*by_, state.alias("state"), "urls"), by_, "full_outer")
    else:
        wards = wards.withColumns({"state": F.lit(None).cast("string"), "urls": F.lit(None).cast("array<string>")})
    keys = wards.select(*by_, F.coalesce("state", F.lit("none")).alias("state"), F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))
    return builds.commit(rolls.withColumn("schema_version", F.lit(VERSION)), keys, path, by_, ["serial"], partial=True)


def read_rolls(spark: SparkSession, path: str, wards: list[int] | None = None, by: tuple[str, ...] = ("ward",)) -> DataFrame:
    """Stored entries of some wards or all; partitions of other wards aren't read, stale versions are absent."""
    rows = builds.read(spark, path, f"{_FIELDS}, {_kinds(by)}", list(by))
    if wards is not None:
        rows = rows.filter(F.col("ward").isin(wards))
    return _current(rows)


def read_states(spark: SparkSession, path: str, by: tuple[str, ...] = ("ward",)) -> DataFrame:
    """The columns ``by``, state and urls of every stored ward."""
    found = builds.manifest(spark, path)
    return spark.createDataFrame([], f"{_kinds(by)}, state string, urls array<string>") if found is None else found.drop("build")


CATALOGUE = "file string, document string"


def write_catalogue(documents: DataFrame, path: str, partial: bool = False) -> int:
    """District documents (district_id, name, name_latin, file, document) and their index, replaced by one commit.

    A full build removes the districts that it doesn't write, a partial one
    keeps them; a rebuilt district loses its old document, also under another
    name.  The index is read from the commit itself, so it lists what is there.
    """
    listed = documents.select("district_id", "name", "name_latin", "file")
    return builds.commit(documents.select("district_id", "file", "document"), listed, path, ["district_id"], ["file"], partial)


def read_documents(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """district_id, file and document of every district of a commit (the newest)."""
    return builds.read(spark, path, f"{CATALOGUE}, district_id string", ["district_id"], number)


def read_listing(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """id, name, name_latin and file of the districts that a commit (the newest) lists."""
    found = builds.manifest(spark, path, number)
    if found is None:
        return spark.createDataFrame([], "id string, name string, name_latin string, file string")
    return found.select(F.col("district_id").alias("id"), "name", "name_latin", "file")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """One message per line of text files."""
    return spark.read.text(path).withColumnRenamed("value", "text")
