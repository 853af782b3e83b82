"""Line dedup by overlapping windows of three consecutive lines.

Blank lines don't count.  Every window of three lines is hashed; the first
place where a hash occurs in the corpus (smallest document id, then position)
stands, and each later place is removed: the positions that any later window
covers are merged per document and their lines dropped.  A document of one or
two lines is a single, shorter window.  Windows of one or two lines join in
where they hold more than ``passage_words`` words, so that a long passage goes
whatever its neighbour lines are (None: three-line windows alone).

Only hashes (two of 64 bits, so that different windows aren't taken for equal)
and positions are shuffled for the search.  The first place of a
window comes from a partial aggregate, so a window that a third of all
documents share is reduced before it moves; the join back is an ordinary
equi-join whose large keys Spark splits.  The texts move once, to meet their
removed positions.

Defined results: null text is empty and stays so; white space at a line's ends
is ignored in comparing; a long text's lines all count (they are one row's
array); ids must be whole numbers (they are cast to long), and a null id counts
as the largest; rows with the same id and text are one document seen twice and
come out alike; an empty table gives no rows; other columns pass through
(columns named like a result, or beginning with ``__``, are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import let, stored, text_of, words_of

WINDOW = 3
PASSAGE_WORDS = 50
_EDGES = " \t\x0b\x0c\r"


def _lines(text: str) -> Column:
    return F.split(text_of(text), "\n", -1)


def _filled(line: Column) -> Column:
    return F.btrim(line, F.lit(_EDGES)) != ""


def _windows(text: str, window: int, passage_words: int | None = None) -> Column:
    """array<struct<hash, check, width, pos, end>> of one text's windows; pos and end are line numbers from 0."""
    numbered = F.filter(
        F.transform(_lines(text), lambda x, i: F.struct(i.alias("no"), F.btrim(x, F.lit(_EDGES)).alias("line"))),
        lambda x: x["line"] != "",
    )
    words = lambda x: F.size(words_of(x)) if passage_words is not None else F.lit(0)
    hashed = F.transform(
        numbered,
        lambda x: F.struct(
            x["no"].alias("no"), F.xxhash64(x["line"]).alias("h"), F.xxhash64(F.lit(1), x["line"]).alias("c"), words(x["line"]).alias("words")
        ),
    )

    def at(s: Column, starts: Column, width: Column) -> Column:
        return F.transform(
            starts,
            lambda i: F.struct(
                F.xxhash64(F.slice(s["h"], i + 1, width)).alias("hash"),
                F.xxhash64(F.lit(1), F.slice(s["c"], i + 1, width)).alias("check"),
                width.alias("width"),
                F.get(s["no"], i).alias("pos"),
                F.get(s["no"], i + width - 1).alias("end"),
            ),
        )

    def long(s: Column, width: int) -> Column:
        """Where a window that is shorter than the document's others holds over ``passage_words``."""
        held = lambda i: sum((F.get(s["words"], i + j) for j in range(width)), F.lit(0))
        return F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - width, F.lit(0))), lambda i: (F.size(s) > width) & (held(i) > passage_words))

    def of(s: Column) -> Column:
        width = F.least(F.size(s), F.lit(window))
        usual = at(s, F.sequence(F.lit(0), F.size(s) - width), width)
        shorter = range(1, window) if passage_words is not None else ()
        return F.concat(usual, *(at(s, long(s, w), F.lit(w)) for w in shorter))

    return let(hashed, lambda s: F.when(F.size(s) > 0, of(s)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with ``text`` cleaned, and n_lines (non-blank, before) and n_removed (of those) added."""
    docs = docs.drop(*(c for c in docs.columns if c.startswith("__")))
    place = {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "__h": F.xxhash64(text_of(text))}
    found = docs.select(*(c.alias(n) for n, c in place.items()), F.explode(_windows(text, window, passage_words)).alias("w"))
    found = stored(found.select("__id", "__h", "w.*"), "line-windows")
    first = (
        found.groupBy("hash", "check", "width")
        .agg(F.count("*").alias("n"), F.min(F.struct("__id", "__h", "pos")).alias("first"))
        .filter("n > 1")
        .drop("n")
    )
    gone = (
        found.join(first, ["hash", "check", "width"])
        .filter(F.struct("__id", "__h", "pos") != F.col("first"))
        .groupBy("__id", "__h")
        .agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("pos", "end")))).alias("__gone"))
    )
    out = docs.withColumns(place).join(gone, ["__id", "__h"], "left")

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.transform(stay, lambda i: F.get(lines, i))

    cleaned = F.when(F.col("__gone").isNull(), text_of(text)).otherwise(F.array_join(let(_lines(text), kept), "\n"))
    return (
        out.withColumns({"n_lines": F.size(F.filter(_lines(text), _filled)).cast("long"), "__clean": cleaned})
        .withColumn("n_removed", F.col("n_lines") - F.size(F.filter(F.split("__clean", "\n", -1), _filled)))
        .withColumn(text, F.col("__clean"))
        .select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")
    )
