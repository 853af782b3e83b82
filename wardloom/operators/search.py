"""Tiered voter search: filters, candidates by trigram, match tiers, ordering."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wardloom.functions import spans
from wardloom.functions import text as X
from wardloom.sources import builds
from wardloom.sources.shared import own_path

# The fields in rank order, how each is keyed, and the tiers.
FIELDS = (("name", X.phonetic_key), ("relative", X.phonetic_key), ("house", X.phonetic_key), ("serial", X.code_key), ("epic", X.code_key))
JUMP, EXACT, PREFIX, WORD_PREFIX, SUBSTRING = -1, 0, 1, 2, 3
LIMIT = 50
GRAM = 3


def limit_of(value: int | float | None) -> int:
    """A positive limit rounded down, else the default."""
    return int(value) if value and value >= 1 else LIMIT


def with_keys(roll: DataFrame) -> DataFrame:
    """``roll`` with a key column (k_<field>) for each searched field; worth storing once per roll."""
    return roll.withColumns({f"k_{f}": key(F.col(f).cast("string")) for f, key in FIELDS})


def tier(key: Column, query: str) -> Column:
    """How well a key matches a query key: 0 exact to 3 substring, null if it doesn't."""
    q = F.lit(query)
    return (
        F.when(key == q, EXACT).when(key.startswith(q), PREFIX).when(key.contains(F.lit(f" {query}")), WORD_PREFIX).when(key.contains(q), SUBSTRING)
    )


def place_filter(df: DataFrame, column: str, wanted) -> DataFrame:
    """Rows whose value is the wanted one, or one of a list, as key parts and whatever the case."""
    values = wanted if isinstance(wanted, (list, tuple)) else [wanted]
    keys = [F.lower(X.key_part(F.lit(str(v)))) for v in values]
    return df.filter(F.lower(X.key_part(F.col(column))).isin(*keys))


def age_filter(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Ages within bounds (inclusive); a missing age fails once a bound is set."""
    if low is not None and high is not None and low > high:
        raise ValueError("the lowest age is above the highest")
    for bound, test in ((low, lambda b: F.col("age") >= b), (high, lambda b: F.col("age") <= b)):
        df = df if bound is None else df.filter(test(bound))
    return df


def lookup_filter(df: DataFrame, lookup: DataFrame | Column, wanted: str | None = None, negate: bool = False) -> DataFrame:
    """Rows whose voter key is in ``lookup`` (voter_key, and value: a string or an array), with the wanted value if given.

    ``lookup`` may also be a column over ``df`` that is the row's value, null for
    none.  ``negate`` keeps the others.
    """
    if isinstance(lookup, Column):
        passes = F.coalesce(lookup.isNotNull() if wanted is None else lookup == wanted, F.lit(False))
        return df.filter(~passes if negate else passes)
    rows = lookup
    if wanted is not None:
        kind = lookup.schema["value"].dataType.typeName()
        rows = rows.filter(F.array_contains("value", wanted) if kind == "array" else F.col("value") == wanted)
    keyed = df.withColumn("__key", X.voter_key(F.col("ward"), F.col("serial")))
    return keyed.join(rows.select(F.col("voter_key").alias("__key")).distinct(), "__key", "left_anti" if negate else "left_semi").select(*df.columns)


def grams(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """(id, gram): the distinct three-letter windows of a key."""
    windows = F.regexp_extract_all(F.col(key), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return df.select(id_col, F.explode(F.array_distinct(windows)).alias("gram"))


def gram_candidates(index: DataFrame, id_col: str, query: str, corpus: DataFrame | None = None, key: str = "key") -> DataFrame:
    """Ids whose gram rows hold every gram of the query key; for a key of under three letters, a scan of ``corpus``."""
    if len(query) < GRAM:
        if corpus is None:
            raise ValueError("a key this short needs the corpus, for a full scan")
        return corpus.filter(F.col(key).contains(query)).select(id_col)
    wanted = sorted({query[i : i + GRAM] for i in range(len(query) - GRAM + 1)})
    if "bucket" in index.columns:
        index = index.filter(F.col("bucket").isin(sorted({bucket_of(g) for g in wanted})))
    return index.filter(F.col("gram").isin(wanted)).groupBy(id_col).agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select(id_col)


def _every_gram() -> Column:
    """``g``: (gram, code) of all searched fields' keys of a row, each once."""

    def of(field: str, code: bool) -> Column:
        windows = F.regexp_extract_all(F.coalesce(F.col(f"k_{field}"), F.lit("")), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
        return F.transform(windows, lambda g: F.struct(g.alias("gram"), F.lit(code).alias("code")))

    return F.explode(F.array_distinct(F.concat(*(of(field, key is X.code_key) for field, key in FIELDS)))).alias("g")


def gram_index(keyed: DataFrame, id_col: str) -> DataFrame:
    """(id, gram, code): grams of every searched field's key, and whether it is a code key; worth storing once per roll."""
    return keyed.select(id_col, _every_gram()).select(id_col, "g.gram", "g.code")


#: Buckets of grams in a stored index; within one, files are in order of grams, so statistics prune further.
GRAM_BUCKETS = 16


def bucket_of(gram: str) -> int:
    """The bucket of a gram: as ``crc32`` gives it in Spark."""
    return zlib.crc32(gram.encode("utf-8")) % GRAM_BUCKETS


def write_index(keyed: DataFrame, path: str, id_col: str = "pos", ward: str = "ward", partial: bool = True) -> int:
    """Stores the postings of the wards that ``keyed`` (see ``with_keys``) holds, in buckets of grams, by one commit.

    Postings that an earlier commit has of these wards are no longer read;
    those of other wards stay as they are.
    """
    rows = keyed.select(ward, id_col, _every_gram()).select(ward, id_col, "g.gram", "g.code")
    rows = rows.withColumn("bucket", (F.crc32(F.encode("gram", "UTF-8")) % GRAM_BUCKETS).cast("int"))
    return builds.commit(rows, keyed.select(ward).distinct(), path, [ward], ["gram", id_col], partial, ["bucket"])


def read_index(spark: SparkSession, path: str, id_col: str = "pos", ward: str = "ward") -> DataFrame:
    """(ward, id, gram, code, bucket): the current postings; a search reads its own grams' buckets alone."""
    return builds.read(spark, path, f"{ward} bigint, {id_col} bigint, gram string, code boolean, bucket int", [ward])


def likely(keyed: DataFrame, index: DataFrame, id_col: str, phonetic: str, code: str) -> DataFrame:
    """The rows of ``keyed`` that hold all grams of either key of a query; all rows, if a key is too short for grams."""
    if any(0 < len(q) < GRAM for q in (phonetic, code)):
        return keyed
    ids = [gram_candidates(index.filter(F.col("code") == is_code), id_col, q) for q, is_code in ((phonetic, False), (code, True)) if q]
    return keyed.join(reduce(DataFrame.unionByName, ids).distinct(), id_col, "left_semi") if ids else keyed


def best_match(keyed: DataFrame, phonetic: str, code: str) -> DataFrame:
    """Rows that match with their best tier and field (lowest tier, then field rank)."""
    found = []
    for rank, (field, key) in enumerate(FIELDS):
        q = phonetic if key is X.phonetic_key else code
        if q:
            t = tier(F.col(f"k_{field}"), q)
            found.append(F.when(t.isNotNull(), F.struct(t.alias("tier"), F.lit(rank).alias("rank"), F.lit(field).alias("field"))))
    if not found:
        return keyed.limit(0).withColumns({"tier": F.lit(0), "rank": F.lit(0), "field": F.lit("")})
    best = F.array_min(F.array_compact(F.array(*found)))
    return keyed.withColumn("__best", best).filter("__best IS NOT NULL").select("*", "__best.tier", "__best.rank", "__best.field").drop("__best")


def key_order(column: str) -> list[Column]:
    """Numbers before text, numbers by value."""
    part = X.key_part(F.col(column))
    number = F.when(part.rlike("^[0-9]+$"), part).try_cast("decimal(38,0)")
    return [number.asc_nulls_last(), part.asc()]


ORDERS = {
    "relevance": lambda: [F.col("tier"), F.col("rank")],
    "serial": list,
    "name": lambda: [F.collate(X.normalise(F.col("name")), "hi")],
    "age": lambda: [F.col("age").asc_nulls_last()],
}


def sorted_roll(df: DataFrame, order: str = "serial") -> DataFrame:
    return df.orderBy(*ORDERS[order](), *key_order("ward"), *key_order("serial"))


def search_voters(
    keyed: DataFrame,
    query: str,
    *,
    order: str = "relevance",
    limit: int | float | None = None,
    index: DataFrame | None = None,
    id_col: str = "pos",
) -> DataFrame:
    """The best matches of a query over ``keyed`` (see ``with_keys``; filter it first).

    A query 'ward/serial' puts that voter first (tier -1).  An empty query
    lists every row, one without letters or digits matches none.  With an
    ``index`` (see ``gram_index``) of the roll only likely rows are compared.
    """
    spark = keyed.sparkSession
    text = X.squeeze(F.coalesce(F.lit(query), F.lit("")))
    jump, phonetic, code, plain = spark.range(1).select(X.parse_ward_serial(F.lit(query)), X.phonetic_key(text), X.code_key(text), text).first()
    if not plain:
        rows = keyed.withColumns({"tier": F.lit(EXACT), "rank": F.lit(0), "field": F.lit("")})
    else:
        some = keyed if index is None else likely(keyed, index, id_col, phonetic, code)
        rows = best_match(some.select(*keyed.columns), phonetic, code)
    if jump is not None:
        here = X.voter_key(F.col("ward"), F.col("serial")) == f"{jump['ward']}:{jump['serial']}"
        rows = rows.filter(~here).unionByName(keyed.filter(here).withColumns({"tier": F.lit(JUMP), "rank": F.lit(-1), "field": F.lit("")}))
    first = [F.when(F.col("tier") == JUMP, 0).otherwise(1)]
    return rows.orderBy(*first, *ORDERS[order](), *key_order("ward"), *key_order("serial")).limit(limit_of(limit))


def with_capped(found: DataFrame, limit: int | float | None = None) -> DataFrame:
    """Rows of a search with ``capped``: whether they are as many as the limit that it was asked for, so others may be left out."""
    whole = Window.partitionBy(F.lit(True))  # of at most ``limit`` rows
    return found.withColumn("capped", F.count("*").over(whole) >= limit_of(limit))


def search_names(df: DataFrame, query: str, *, name: str = "name", order: tuple[str, ...] = ("serial",), limit: int | None = None) -> DataFrame:
    """Best matches over one normalised name; ties by serial; a blank query finds none."""
    wanted = df.sparkSession.range(1).select(X.normalise(F.lit(query))).first()[0]
    rows = df.withColumn("norm", X.normalise(F.col(name)))
    rows = rows.withColumn("tier", tier(F.col("norm"), wanted) if wanted else F.lit(None).cast("int"))
    return rows.filter("tier IS NOT NULL").orderBy("tier", *(F.col(c).asc_nulls_last() for c in order)).limit(limit_of(limit))


#: Query keys of up to so many bytes together are sent to every task; more are joined.
SMALL_BATCH = 16 << 20


#: Bytes of keys whose windows are held at once, about 40 times that in numbers; a longer key is taken alone.
PIECE = 1 << 20


def _pieces(batch: pa.RecordBatch, key: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices whose keys have ``PIECE`` bytes together at most."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(key)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(upto):
        before = upto[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(upto, before + PIECE, side="right")))
        yield batch.slice(first, end - first)
        first = end


def _codes(keys: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the key, code) of every window of three bytes in some keys."""
    raw = [(k or "").encode() for k in keys]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
    at = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
    inside = at[2:] == at[:-2]
    return at[2:][inside], (data[:-2] << 16 | data[1:-1] << 8 | data[2:])[inside]


def _gram_counts(corpus: DataFrame, key: str, wanted: np.ndarray) -> DataFrame:
    """(code, n): how many windows of the corpus are each of the wanted grams (a flag per possible gram: 2 ** 24 of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(wanted).view(bool)
        total: dict[int, int] = {}
        for batch in (piece for b in batches for piece in _pieces(b, 0)):
            _, codes = _codes(batch.column(0).to_pylist())
            for code, n in zip(*(x.tolist() for x in np.unique(codes[flags[codes]], return_counts=True)), strict=True):
                total[code] = total.get(code, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["code", "n"])

    return corpus.select(key).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _query_codes(queries: DataFrame, query_col: str, key: str) -> DataFrame:
    """(query, code) of the grams of every query key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in _pieces(b, 1)):
            at, codes = _codes(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(codes, pa.int32())], names=[query_col, "code"])

    kind = queries.schema[query_col].dataType.simpleString()
    return queries.select(query_col, key).mapInArrow(run, f"`{query_col}` {kind}, code int").distinct()


def _holders(corpus: DataFrame, id_col: str, key: str, wanted: np.ndarray) -> DataFrame:
    """(id, code): the wanted grams that each corpus row holds."""
    kind = corpus.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(wanted).view(bool)
        for batch in (piece for b in batches for piece in _pieces(b, 1)):
            at, codes = _codes(batch.column(1).to_pylist())
            keep = flags[codes]
            pairs = np.unique(at[keep].astype(np.int64) << 24 | codes[keep])
            ids = batch.column(0).take(pa.array(pairs >> 24, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array((pairs & 0xFFFFFF).astype(np.int32))], names=[id_col, "code"])

    return corpus.select(id_col, key).mapInArrow(run, f"`{id_col}` {kind}, code int")


def _tiers_here(corpus: DataFrame, id_col: str, key: str, queries: DataFrame, query_col: str, rows: list[tuple]) -> DataFrame:
    """(id, query, tier) of every match, compared where the corpus row lies; ``rows`` are (query, its key, its rarest gram)."""
    kind, query_kind = corpus.schema[id_col].dataType.simpleString(), queries.schema[query_col].dataType.simpleString()
    of_query = to_arrow_schema(queries.select(query_col).schema).field(0).type
    by_code: dict[int, list[tuple]] = {}
    for query, text, code in rows:
        by_code.setdefault(code, []).append((query, text))
    flags = np.zeros(1 << 24, bool)
    flags[list(by_code)] = True
    packed = np.packbits(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed).view(bool)
        for batch in (piece for b in batches for piece in _pieces(b, 1)):
            keys = batch.column(1).to_pylist()
            at, codes = _codes(keys)
            keep = wanted[codes]
            pairs = np.unique(at[keep].astype(np.int64) << 24 | codes[keep])
            row, query, tiers = [], [], []
            for p in pairs.tolist():
                text = keys[p >> 24]
                for q, t in by_code[p & 0xFFFFFF]:
                    if t in text:
                        row.append(p >> 24)
                        query.append(q)
                        tiers.append(EXACT if t == text else PREFIX if text.startswith(t) else WORD_PREFIX if f" {t}" in text else SUBSTRING)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(query, of_query), pa.array(tiers, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, query_col, "tier"])

    return corpus.select(id_col, key).mapInArrow(run, f"`{id_col}` {kind}, `{query_col}` {query_kind}, tier int")


#: Parts of the queries that a row of the corpus meets, in a large batch.
PARTS = 32


def _flags(rows: DataFrame) -> np.ndarray:
    """A bit for each of the 2 ** 24 possible grams: whether ``code`` has it (64 MB of numbers on the way, at most)."""
    flags = np.zeros(1 << 24, bool)
    flags[rows.select("code").distinct().toArrow().column(0).to_numpy()] = True
    return np.packbits(flags)


def batch_search(
    corpus: DataFrame, queries: DataFrame, k: int, *, id_col: str, query_col: str, key: str = "key", small: int = SMALL_BATCH
) -> DataFrame:
    """The ``k`` best rows of ``corpus`` for every query key (three bytes at least), by tier, then id.

    Candidates are rows that hold the query's rarest gram (three bytes; by its
    count in the corpus), so a frequent gram is never what a match starts from;
    the tier is then checked on the whole key.  Grams are counted and found in
    numpy, a megabyte of keys at a time, and no gram of the corpus is moved but the
    counts.  Query keys that are small together go to the corpus rows; others
    meet them in joins.  ``corpus`` is read twice, so its keys should be stored.
    """
    spark = corpus.sparkSession
    asked = _query_codes(queries, query_col, key)
    counts = _gram_counts(corpus, key, _flags(asked))
    order = F.struct(F.coalesce("n", F.lit(0)), "code")
    rarest = asked.join(counts, "code", "left").groupBy(query_col).agg(F.min_by("code", order).alias("code"))
    rarest = rarest.join(queries.select(query_col, F.col(key).alias("q")), query_col)
    path = own_path(spark, "rarest")
    rarest.select(query_col, "q", "code").write.parquet(path)
    rarest = spark.read.schema(rarest.select(query_col, "q", "code").schema).parquet(path)
    size = rarest.agg(F.sum(F.octet_length("q") + 64)).first()[0] or 0
    if size <= small:
        rows = [tuple(r) for r in rarest.collect()]
        found = _tiers_here(corpus, id_col, key, queries, query_col, rows)
    else:
        met = _holders(corpus, id_col, key, _flags(rarest)).join(rarest, "code")
        part = F.pmod(F.xxhash64(query_col), F.lit(PARTS))  # a row that many queries may match has them in parts
        by_row = met.groupBy(id_col, part.alias("__part")).agg(F.collect_list(F.struct(query_col, "q")).alias("__asked"))
        whole = by_row.join(corpus.select(id_col, key), id_col)  # so a key moves once for each part, not for each query
        c = F.col(key)

        def tier_of(a: Column) -> Column:
            q = a["q"]
            t = F.when(c == q, EXACT).when(c.startswith(q), PREFIX).when(c.contains(F.concat(F.lit(" "), q)), WORD_PREFIX).when(c.contains(q), SUBSTRING)
            return F.struct(a[query_col].alias(query_col), t.alias("tier"))

        hits = F.filter(F.transform("__asked", tier_of), lambda h: h["tier"].isNotNull())
        found = whole.select(id_col, F.explode(hits).alias("h")).select(id_col, f"h.{query_col}", "h.tier")
    best = Window.partitionBy(query_col).orderBy("tier", id_col)
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select(query_col, "place", id_col, "tier")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, place): the distinct values of each column, an array's one by one; numbers by value come first."""

    def values(c: str) -> DataFrame:
        listed = df.schema[c].dataType.typeName() == "array"
        return df.select(F.lit(c).alias("facet"), (F.explode(c) if listed else F.col(c)).cast("string").alias("value")).distinct()

    found = reduce(DataFrame.unionByName, [values(c) for c in columns]).filter("value IS NOT NULL")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(*key_order("value"))))


def team_lookup(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """(candidate, and the columns of ``df``): each team's rows whose voter key it has in ``lookup`` (candidate, voter_key)."""
    keyed = df.withColumn("voter_key", X.voter_key(F.col("ward"), F.col("serial")))
    return keyed.join(lookup.select("candidate", "voter_key").distinct(), "voter_key").select("candidate", *df.columns)


def match_ranges(df: DataFrame, text: str, query: str, kind: str = "phonetic") -> DataFrame:
    """``df`` with ``ranges``: where a query matches a text by its key, as merged (start, end) in code points.

    Meant for the few rows of a top-k; ``kind`` is 'phonetic' or 'code'.
    """
    key = getattr(spans, kind)
    wanted = key(query).text

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: spans.ranges(t or "", key(t or ""), wanted))

    return df.withColumn("ranges", found(F.col(text)))
