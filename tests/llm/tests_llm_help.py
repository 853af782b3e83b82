"""The pipeline's first four stages in plain Python (the classifier scores with the trained model)."""

import re

from test_free import similar
from test_native import counts, dedup

from wardloom.llm import quality_mil
from wardloom.llm.quality_rules import LineRules

RULES = LineRules()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_fails(line):
    n = len(WORD.findall(line))
    if not n:
        return False
    bars = len(re.findall(RULES.separator, line))
    if bars >= RULES.separators and bars >= n * RULES.separator_share:
        return True
    if n < RULES.boilerplate_words and re.search(RULES.boilerplate, line):
        return True
    if len(re.findall(RULES.decoration, line)) > n * RULES.decorated_share:
        return True
    return n < RULES.unfinished_words and not re.search(RULES.sentence_end, line)


def brute_pipeline(spark, sf, docs):
    """The texts by id after each of the first four stages; the classifier is trained on kept texts as cleaned, rejected ones as they came."""
    now, out, rows = {}, [], docs.collect()
    for r in rows:
        n, chars, *_, repeats = counts(r["text"])
        clean = "\n".join(x for x in r["text"].split("\n") if not line_fails(x))
        lost = 1 - sum(map(len, WORD.findall(clean))) / chars if chars else 0
        if not (n < 50 or 100 * repeats > 50 * n) and lost <= 1 - RULES.min_kept_share:
            now[r["doc_id"]] = clean
    out.append(dict(now))
    cleaned = spark.createDataFrame([(r["doc_id"], now.get(r["doc_id"], r["text"])) for r in rows], "doc_id long, text string")
    model = quality_mil.train(cleaned, spark.read.parquet(f"{sf}/labels.parquet"))
    now = {d: t for d, t in now.items() if model.score(t) >= quality_mil.THRESHOLD}
    out.append(dict(now))
    clean = dedup(sorted(now.items()))
    now = {d: t for d, t in clean.items() if t == now[d] or re.search(r"[^\x20\x09-\x0D]", t)}
    out.append(dict(now))
    kept = {d for d, _, _, k in similar(sorted(now.items())) if k}
    out.append({d: t for d, t in now.items() if d in kept})
    return out
