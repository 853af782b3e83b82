"""Quality rules: clean line by line, then reject documents that lost too much.

Every line is held against three kinds of rule: punctuation (no sentence end on
a short line, which takes a menu's lines too, or words decorated with runs of
symbols), navigation (link bars) and boilerplate (cookie notices and the like,
in four languages).  Failing lines go.  A document
is kept if it passes the base limits and its remaining lines hold enough of its
words' characters.

Everything is one projection of array functions: no shuffle, no Python.

Defined results: null text counts as empty; an empty text has no words, so it
fails the base limit; a text of any length is one row of arrays and takes the
same path; repeated rows are judged alike, each on its own; other columns pass
through untouched, but columns named like a result, ``__counts`` or ``__lines``
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import SPACES, let, text_of, words_of

_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; the defaults are the production parameters."""

    sentence_end: str = r"""[.!?:;…。！？।؟"'”’»)\]]\s*$"""
    unfinished_words: int = 8  # a line without a sentence end needs this many words
    decoration: str = r"[#*$%&|<>!?^~=_+]{2,}"
    decorated_share: float = 0.3
    separator: str = r"[|»›•·>]"
    separators: int = 3
    separator_share: float = 0.2
    boilerplate: str = (
        r"(?i)\b(cookie (policy|settings|preferences)|accept (all )?cookies|enable javascript|terms of (use|service)"
        r"|privacy policy|all rights reserved|skip to (main )?content|subscribe to our newsletter|click here"
        r"|lorem ipsum|sign (in|up) (now|here)|share (this|on) "
        r"|alle cookies (akzeptieren|zulassen)|cookie-einstellungen|alle rechte vorbehalten|datenschutz(erkl|hinweis|bestimmung)"
        r"|zum inhalt springen|newsletter (abonnieren|bestellen)|hier klicken|nutzungsbedingungen"
        r"|accepter (tous )?les cookies|gestion des cookies|tous droits r|politique de confidentialit"
        r"|aller au contenu|abonnez-vous|cliquez ici|mentions l.gales"
        r"|aceptar (todas las )?cookies|pol.tica de (cookies|privacidad)|todos los derechos reservados"
        r"|saltar al contenido|ir al contenido|suscr.bete|haga clic|haz clic"
        # notices of a licence: what is done under it, or its name
        r"|(licen[sc]ed|released|distributed|published) under (a|an|the|mit|apache|gnu|bsd|mozilla|cc|creative|[agl]+pl)\b"
        r"|(lizenziert|ver.ffentlicht) unter (der|einer|mit|apache|gnu|bsd|mozilla|cc|creative|[agl]+pl)\b"
        r"|sous (la )?licence (mit|apache|gnu|bsd|mozilla|cc|creative|libre|[agl]+pl)\b"
        r"|bajo (la |una )?licencia (mit|apache|gnu|bsd|mozilla|cc|creative|libre|[agl]+pl)\b"
        r"|spdx-license-identifier|creative commons (attribution|namensnennung|by)|gnu general public license)"
    )
    boilerplate_words: int = 30  # a longer line is prose that mentions such a thing
    min_words: int = 50
    max_repeat_percent: int = 50
    min_kept_share: float = 0.6


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more (the first included).

    Windows become 64-bit hashes.  Most texts have no two equal ones, which a
    hash set tells; in the others hashes are sorted with their positions, so
    that equal windows are neighbours, and the found positions are merged.
    """

    def starts(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def same(s: Column, a: Column, b: Column) -> Column:
            return F.coalesce(F.get(s, a)["x"] == F.get(s, b)["x"], F.lit(False))

        def repeated(s: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda k: F.when(same(s, k - 1, k) | same(s, k + 1, k), F.get(s, k)["i"]),
            )

        return let(pairs, lambda s: F.sort_array(F.array_compact(repeated(s))))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(F.slice(gaps, 1, F.size(at)), F.lit(0).cast("long"), lambda x, y: x + y)

    def of(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
        none = lambda h: F.size(F.array_distinct(h)) == F.size(h)
        return let(windows, lambda h: F.when(none(h), F.lit(0).cast("long")).otherwise(let(starts(h), covered)))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(of(words))


_WORDS = r"[^\x20\x09-\x0D]+"


def failing(line: Column, rules: LineRules) -> Column:
    """Why a line by itself goes: 'navigation', 'boilerplate', 'punctuation', or null if it stays."""

    def verdict(n: Column) -> Column:
        separators = F.regexp_count(line, F.lit(rules.separator))
        return (
            F.when(n == 0, F.lit(None))
            .when((separators >= rules.separators) & (separators >= n * rules.separator_share), F.lit("navigation"))
            .when((n < rules.boilerplate_words) & line.rlike(rules.boilerplate), F.lit("boilerplate"))
            .when(F.regexp_count(line, F.lit(rules.decoration)) > n * rules.decorated_share, F.lit("punctuation"))
            .when((n < rules.unfinished_words) & ~line.rlike(rules.sentence_end), F.lit("punctuation"))
        )

    return let(F.regexp_count(line, F.lit(_WORDS)), verdict)


def apply_quality_rules(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``docs`` with its counts, the cleaned text and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, clean_text, lost_share (of the words' characters) and kept.
    """
    body = text_of(text)

    def chars(t: Column) -> Column:
        return F.length(F.translate(t, SPACES, "")).cast("long")

    with_words = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        words_of(body),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    kept_lines = F.filter(F.split(body, "\n", -1), lambda x: failing(x, rules).isNull())
    own = ("__counts", "__lines")
    out = docs.withColumns({"__counts": counts, "clean_text": F.array_join(kept_lines, "\n")}).withColumns(
        {
            "n_words": F.col("__counts.n_words"),
            "word_chars": chars(body),
            "n_symbols": (F.length(body) - F.length(F.translate(body, _SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col("__counts.n_repeat_words"),
        }
    )
    out = out.withColumn(
        "base_failed",
        (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
    ).withColumn("lost_share", F.when(F.col("word_chars") == 0, F.lit(0.0)).otherwise(1 - chars(F.col("clean_text")) / F.col("word_chars")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= 1 - rules.min_kept_share)).drop(*own)
