"""How well decoded rolls agree with what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMPARED = ("name", "house", "age", "struck")


def compare(decoded: DataFrame, expected: DataFrame, fields: tuple[str, ...] = COMPARED) -> DataFrame:
    """(serial, field, decoded, expected) where they differ; 'missing' or 'extra' for a whole entry."""
    d = decoded.select("serial", F.lit(True).alias("__d"), *(F.col(f).cast("string").alias(f"d_{f}") for f in fields))
    e = expected.select("serial", F.lit(True).alias("__e"), *(F.col(f).cast("string").alias(f"e_{f}") for f in fields))
    both = d.join(e, "serial", "full_outer")
    one = F.when(F.col("__d").isNull(), "missing").when(F.col("__e").isNull(), "extra")
    none = F.lit(None).cast("string")
    whole = both.filter(one.isNotNull()).select("serial", one.alias("field"), none.alias("decoded"), none.alias("expected"))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"d_{f}").alias("decoded"), F.col(f"e_{f}").alias("expected")) for f in fields))
    wrong = F.filter(pairs, lambda p: ~p["decoded"].eqNullSafe(p["expected"]))
    differ = both.filter(one.isNull()).select("serial", F.explode(wrong).alias("p")).select("serial", "p.*")
    return whole.unionByName(differ)


def score(decoded: DataFrame, expected: DataFrame) -> DataFrame:
    """total, matched, percent (two places, 0 when empty) and struck of the expected entries."""
    wrong = compare(decoded, expected).filter("field <> 'extra'").select("serial").distinct().withColumn("wrong", F.lit(1))
    rows = expected.join(wrong, "serial", "left")
    percent = F.coalesce(F.round(100.0 * F.col("matched") / F.nullif(F.col("total"), F.lit(0)), 2), F.lit(0.0))
    counts = rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("wrong").isNull()).alias("matched"), F.count_if("struck").alias("struck")
    )
    return counts.withColumn("percent", percent)


def asof_page(missing: DataFrame, decoded: DataFrame, ranges: int = 1000) -> DataFrame:
    """For each missing serial the page of the nearest decoded serial at or before it, else the first page.

    Rows are dealt by ranges of serials.  What lies before a range comes from a
    row per range, dealt by ranges of ranges in turn, and before those from a
    row for each of them: one in ``ranges`` squared serials.
    """
    held = decoded.select("serial", "page", F.lit(False).alias("ask"))
    both = held.unionByName(missing.select("serial", F.lit(None).cast("int").alias("page"), F.lit(True).alias("ask")))
    both = both.withColumns({"b": F.floor(F.col("serial") / ranges), "c": F.floor(F.col("serial") / ranges**2)})
    past = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = both.groupBy("c", "b").agg(F.max_by("page", F.when(~F.col("ask"), F.col("serial"))).alias("top"))
    near = tops.withColumn("before", F.last("top", ignorenulls=True).over(past(["c"], "b"))).select("c", "b", "before")
    wide = tops.groupBy("c").agg(F.max_by("top", F.when(F.col("top").isNotNull(), F.col("b"))).alias("top")).withColumn("one", F.lit(1))
    wide = wide.withColumn("long_before", F.last("top", ignorenulls=True).over(past(["one"], "c"))).select("c", "long_before")
    order = Window.partitionBy("c", "b").orderBy("serial", "ask")
    found = both.withColumn("near", F.last("page", ignorenulls=True).over(order)).filter("ask").join(near, ["c", "b"]).join(wide, "c")
    first = decoded.agg(F.min_by("page", "serial")).scalar()
    return found.select("serial", F.coalesce("near", "before", "long_before", first).alias("page"))


def percentiles(samples: DataFrame, kind: str, value: str) -> DataFrame:
    """Nearest-rank p50 and p95, the maximum and the count by kind."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return samples.groupBy(kind).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.max(value).alias("top"), F.count("*").alias("n"))


def sample_matched(matched: DataFrame, least: int) -> DataFrame:
    """The first entry of each page, topped up in order to ``least`` entries.

    Pages are dealt out; only the top-up, of ``least`` rows at most, is in one place.
    """
    firsts = matched.groupBy("page").agg(F.min("serial").alias("serial"))
    rest = matched.join(firsts.select("page", F.col("serial").alias("__first")), "page").filter("serial > __first").select("page", "serial")
    short = F.lit(least) - firsts.agg(F.count("*")).scalar()
    nth = F.row_number().over(Window.partitionBy(F.lit(True)).orderBy("serial"))
    extra = rest.orderBy("serial").limit(least).withColumn("__nth", nth).filter(F.col("__nth") <= short).select("page", "serial")
    return firsts.unionByName(extra)
