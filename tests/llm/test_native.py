"""Quality rules, fingerprints, line dedup, chat, sharding: against plain readings of their definitions."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from wardloom.llm import chat, line_dedup, quality_rules, sharding, simhash

DOCS = "doc_id long, text string, kept string, n_lines string, extra map<string,int>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))


TEXTS = [
    None, "", "   \n ", "one", "a b c a b c", "x x x x x", f"{prose(80)}.", f"{prose(80)}.", "\n".join(f"{prose(20, i)}." for i in range(6)),
    " ".join(["tick"] * 400), prose(60, 3) + "\n" + "Home | About | Shop | Contact | Help\n" + prose(60, 4) + ".", "Ünïcode 𝒳 語 " * 30, prose(3000, 9), "a\n\n\na\nb\na\n",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", "n", None) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, {"a": 1})], DOCS).cache()


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_a_plain_reading(docs):
    out = quality_rules.apply_quality_rules(docs).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        n, *_, repeats = want = counts(TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_long_and_crowded_texts_count_right(spark):
    """Long texts, many interleaving repeats, and clashing columns."""
    r = random.Random(1)
    texts = [" ".join(r.choice("abc") for _ in range(200)), " ".join(str(r.randrange(60)) for _ in range(30_000)), f"{prose(150_000, 2)} one two three {prose(10, 3)} one two three"]
    rows = [(i, t, 7, True) for i, t in enumerate(texts)]
    got = quality_rules.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, __counts int, n_words boolean")).collect()
    assert len(texts[2]) > 700_000
    for x in got:
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == counts(texts[x["doc_id"]])


def test_boilerplate_in_four_languages(spark):
    good = "\n".join(f"{prose(20, i)}." for i in range(5))
    notices = ["Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "All rights reserved.", "Bitte alle Cookies akzeptieren, danke.", "Suscríbete hoy."]
    notices += [
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
        "Dieses Werk ist lizenziert unter der MIT-Lizenz.", "Ce texte est publié sous licence MIT.", "Publicado bajo la licencia Creative Commons.",
    ]
    prose_of_it = "The council released under pressure what it had long held back and said that no licence was ever given."
    good = f"{good}\n{prose_of_it}"
    rows = [(i, f"{good}\n{n}") for i, n in enumerate(notices)]
    got = quality_rules.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x["clean_text"] == good and x["kept"] for x in got)


def test_failing_lines_go_and_too_much_loss_rejects(spark):
    good = "\n".join(f"{prose(20, i)}." for i in range(5))
    menu = "Home | About | Shop | Contact\n"
    rows = [(1, good), (2, menu + good), (3, menu * 12 + f"{prose(25)}."), (4, " ".join(f"{w}***" for w in prose(100).split())), (5, good + "\nPlease accept all cookies here.")]
    got = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i in range(1, 6)] == [True, True, False, False, True]
    assert got[2]["clean_text"] == good == got[5]["clean_text"] and got[1]["clean_text"] == good


def test_rules_on_an_empty_table(spark):
    assert quality_rules.apply_quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# fingerprints


def test_edited_text_and_likeness(docs):
    got = {r["doc_id"]: r for r in simhash.fingerprint_documents(docs, parts=3).collect()}
    order = sorted(range(len(TEXTS)), reverse=True) + [None]
    text = {i: TEXTS[i] or "" for i in range(len(TEXTS))} | {None: "no id"}
    assert len(got) == len(order)
    for i, d in enumerate(order):
        t, following = text[d], text[order[(i + 1) % len(order)]]
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), d
        nxt = got[order[(i + 1) % len(order)]]
        assert (got[d]["n_hi"], got[d]["n_lo"]) == (nxt["hi"], nxt["lo"])
    assert (got[6]["hi"], got[6]["lo"]) == (got[7]["hi"], got[7]["lo"])
    assert (got[0]["hi"], got[0]["lo"]) == (0, 0)


def test_fingerprint_of_one_row_and_repeated_rows(spark):
    one = simhash.fingerprint_documents(spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string"), 4).collect()
    assert len(one) == 1 and (one[0]["n_hi"], one[0]["n_lo"]) == (one[0]["hi"], one[0]["lo"])
    many = simhash.fingerprint_documents(spark.createDataFrame([(5, "a b c")] * 4 + [(1, "d e f")], "doc_id long, text string"), 4).collect()
    assert len(many) == 5 and sum((r["n_hi"], r["n_lo"]) == (r["hi"], r["lo"]) for r in many) == 3
    assert simhash.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def plain_print(text):
    """The fingerprint by its definition, bit by bit."""
    import struct

    import xxhash

    words, votes = {w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text)}, [0] * 128
    for w in words:
        a = xxhash.xxh64_intdigest(w.encode(), 42)
        b = xxhash.xxh64_intdigest(struct.pack("<i", 1), xxhash.xxh64_intdigest(struct.pack("<q", a - (a >> 63 << 64)), 42))
        for i in range(128):
            votes[i] += len(w) if (a << 64 | b) >> i & 1 else -len(w)
    return sum(1 << i for i in range(128) if votes[i] > 0)


def test_fingerprint_query_equals_a_plain_reading(spark, tmp_path):
    """Every column, over odd, long and copied texts, ids divisible by 50 among them."""
    r = random.Random(12)
    base = prose(300, 5).split()
    near = [" ".join(prose(1, 900 + k) if r.random() < 0.03 else w for w in base) for k in range(12)]
    texts = [*TEXTS, *near, " ".join(base), " ".join(base), f"{prose(160_000, 6)}", "\n".join(prose(8, k) for k in range(40))]
    rows = [(25 * i, t, 1, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, bucket int, place string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in simhash.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    order = [25 * i for i in range(len(texts))][::-1]
    text = {25 * i: t or "" for i, t in enumerate(texts)}
    prints = {d: plain_print(t) for d, t in text.items()}
    like = lambda a, b: 1 - (a ^ b).bit_count() / 128
    for i, d in enumerate(order):
        t, after = text[d], order[(i + 1) % len(order)]
        edited = t[: len(t) - len(t) // 3] + text[after][: len(t) // 3]
        x, own = got[d], plain_print(edited)
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (int(x["fingerprint"], 16), int(x["edited_fingerprint"], 16)) == (prints[d], own), d
        assert (x["near_edited"], x["near_next"]) == (like(prints[d], own), like(prints[d], prints[after]))
        within = sum((prints[d] ^ prints[e]).bit_count() <= simhash.RADIUS for e in order) - 1
        assert x["n_within"] == (within if d % 50 == 0 else None)
        assert x["class_id"] == min(e for e in order if prints[e] == prints[d])


@pytest.mark.parametrize("bounds", [[], [5], [-3, 0, 4, 9, 20, 21, 50], list(range(0, 300, 7))])
def test_ranges_of_ids(spark, bounds):
    ids = list(range(-5, 310))
    got = spark.createDataFrame([(i,) for i in ids], "__id long").select("__id", simhash._bucket(bounds).alias("b")).collect()
    assert [x["b"] for x in sorted(got)] == [sum(b > i for b in bounds) for i in ids]


def test_block_tables_find_all_within_the_radius(spark):
    r = random.Random(4)
    base = [r.getrandbits(128) for _ in range(12)]
    prints = set(base)
    for b in base:
        for d in range(1, 10):
            x = b
            for bit in r.sample(range(128), d):
                x ^= 1 << bit
            prints.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    both = {(signed(p >> 64), signed(p & (1 << 64) - 1)): p for p in prints}
    df = spark.createDataFrame(list(both), "hi long, lo long")
    got = collections.Counter((both[x["q_hi"], x["q_lo"]], both[x["hi"], x["lo"]]) for x in simhash.within_radius(df, df).collect())
    assert set(got) == {(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= simhash.RADIUS} and set(got.values()) == {1}


def test_near_copies_lie_within_the_radius(spark):
    """Pairs that share at least 0.75 of their five-word shingles: nine in ten are found by the search."""
    r, texts, pairs = random.Random(8), [], 0
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for d in range(60):
        w = prose(200, 100 + d).split()
        near = list(w)
        for i in r.sample(range(200), 1 + d % 5):
            near[i] = prose(1, 1000 * d + i)
        a, b = shingles(w), shingles(near)
        if len(a & b) >= 0.75 * len(a | b):
            texts += [(2 * pairs, " ".join(w)), (2 * pairs + 1, " ".join(near))]
            pairs += 1
    prints = simhash.fingerprint_documents(spark.createDataFrame(texts, "doc_id long, text string"), 4).select("doc_id", "hi", "lo").collect()
    of = collections.defaultdict(set)
    for x in prints:
        of[x["hi"], x["lo"]].add(x["doc_id"])
    df = spark.createDataFrame(list(of), "hi long, lo long")
    met = {(a, b) for x in simhash.within_radius(df, df).collect() for a in of[x["q_hi"], x["q_lo"]] for b in of[x["hi"], x["lo"]]}
    found = sum((2 * i, 2 * i + 1) in met for i in range(pairs))
    assert pairs >= 50 and found >= 0.9 * pairs, (found, pairs)
    assert all(a // 2 == b // 2 for a, b in met)


# line dedup


def dedup(rows, passage_words=50):
    """The definition, line by line."""
    windows, texts = collections.defaultdict(list), {}
    for d, t in rows:
        lines = (t or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        for width in {1, 2, 3}:
            for k in range(len(full) - width + 1):
                held = [lines[i].strip(" \t\x0b\x0c\r") for i in full[k : k + width]]
                if width == min(3, len(full)) or sum(len(WORD.findall(x)) for x in held) > passage_words:
                    windows[tuple(held)].append((d, full[k], full[k + width - 1]))
        texts[d] = lines
    gone = {(d, i) for places in windows.values() for d, a, b in sorted(places)[1:] for i in range(a, b + 1)}
    return {d: "\n".join(x for i, x in enumerate(lines) if (d, i) not in gone) for d, lines in texts.items()}


def test_line_dedup_equals_the_definition(spark):
    r = random.Random(7)
    rows = [(i, "\n".join(r.choice(["a", "b", " a ", "c", "", "d"]) for _ in range(r.randrange(12)))) for i in range(60)] + [(100, None), (101, "only"), (102, "only"), (103, "x\ny\nz"), (104, "w\nx\n\ny\nz\nv")]
    long = [f"{prose(18, i)}." for i in range(9000)]
    rows += [(200, "\n".join(long)), (201, "\n".join(["first", *long[4000:4100], "last"])), (202, f"a\n{prose(60, 1)}\nb"), (203, f"c\n {prose(60, 1)}\nd")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_removed int, __gone string")
    out = line_dedup.dedup_lines(df).collect()
    assert {x["doc_id"]: x["text"] for x in out} == dedup(rows) and len(out) == len(rows)
    assert all((x["n_removed"] == 0) == (x["text"] == (dict(rows)[x["doc_id"]] or "")) for x in out)
    assert next(x["text"] for x in out if x["doc_id"] == 104) == "w\nv"


def test_line_dedup_keeps_rows_seen_twice(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")] * 3 + [(None, "a\nb\nc")], "doc_id long, text string")
    got = sorted((x["doc_id"] or 0, x["text"]) for x in line_dedup.dedup_lines(df).collect())
    assert got == [(0, "")] + [(1, "a\nb\nc")] * 3
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_long_passages_go_whatever_their_neighbours(spark):
    one, a, b = prose(51, 1), prose(30, 2), prose(21, 3)
    rows = [(1, f"x\n{one}\ny\n{a}\n\n{b}\nz"), (2, f"p\n {one}\nq\nr"), (3, f"s\nt\n{a}\n{b}\nu"), (4, one), (5, f"{a}\nv\nw\nx"), (6, f"{prose(50, 4)}\n1\n2\n3"), (7, f"{prose(50, 4)}\n4\n5\n6")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(df, passage_words=50).collect()}
    assert got == dict(rows) | {2: "p\nq\nr", 3: "s\nt\nu", 4: ""}


# sharding


def check_shards(out, n, shards):
    load = collections.Counter(r["shard"] for r in out)
    assert len(out) == n and sum(load.values()) == n and max(load.values(), default=0) - min((load.get(s, 0) for s in range(shards)), default=0) <= 1
    for s, c in load.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(c))


@pytest.mark.parametrize("keys", [list(range(1000)), ["hot"] * 300 + list(range(100)), [None] * 7, []])
def test_shards_are_even_and_slots_gapless(spark, keys):
    df = spark.createDataFrame([(None if k is None else str(k), 1) for k in keys], "k string, shard int")
    check_shards(sharding.shard_rows(df, "k", 7).collect(), len(keys), 7)


def test_growth_moves_few_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(4000)], "k long")
    a = {r["k"]: r["shard"] for r in sharding.shard_rows(df, "k", 20).collect()}
    b = {r["k"]: r["shard"] for r in sharding.shard_rows(df, "k", 21).collect()}
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert moved < 0.1, moved  # the least is 0.048; a modulus would move 0.95
    other = {r["k"]: r["shard"] for r in sharding.shard_rows(df.repartition(7), "k", 20).collect()}
    assert other == a  # the layout of the rows plays no part


def plain_ring(keys, shards):
    """Keys one by one around the ring: first to their own shard while it has room, then on clockwise."""
    import xxhash

    nodes = sharding.ring(shards)
    arc = lambda k: xxhash.xxh64_intdigest(str(k).encode(), 42) >> (64 - sharding.ARCS.bit_length() + 1)
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    counts, out = collections.Counter(map(arc, keys)), collections.Counter()
    over = []
    for a in sorted(counts):
        node = next((i for i, (x, _) in enumerate(nodes) if x >= a), 0)
        for _ in range(counts[a]):
            if room[nodes[node][1]]:
                room[nodes[node][1]] -= 1
                out[a, nodes[node][1]] += 1
            else:
                over.append((a, node))
    at = {}
    for a, node in over:
        node = at.get(a, node)
        while not room[nodes[node][1]]:
            node = (node + 1) % len(nodes)
        at[a] = node
        room[nodes[node][1]] -= 1
        out[a, nodes[node][1]] += 1
    return out, arc


@pytest.mark.parametrize("segment", [10_000, 20])
def test_shards_equal_a_walk_around_the_ring(spark, monkeypatch, segment):
    monkeypatch.setattr(sharding, "SEGMENT_ROWS", segment)
    keys = [*range(700), *[5] * 400]
    rows = [(k, i, {"a": 1}, "x") for i, k in enumerate(keys)]
    out = sharding.shard_rows(spark.createDataFrame(rows, "k long, i int, m map<string,int>, __arc string"), "k", 9).collect()
    want, arc = plain_ring(keys, 9)
    assert collections.Counter((arc(r["k"]), r["shard"]) for r in out) == want
    check_shards(out, len(keys), 9)


def test_walk_overflows_clockwise():
    nodes = [(1, 0), (3, 1), (5, 2)]
    out = sharding.walk({(0, 0): 5, (2, 0): 1}, nodes, 3)
    assert out == [(0, 0, 0, 2, 0, 0), (2, 0, 0, 1, 1, 0), (0, 0, 2, 3, 1, 1), (0, 0, 3, 5, 2, 0)]


def test_sharding_query_columns(spark):
    row = sharding.query(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first()["text"]
    assert row["size"] == len(text.encode()) + 16 and row["text_crc32"] == zlib.crc32(text.encode()) and row["grown_shard"] is None


# chat


def conversations():
    r = random.Random(8)
    rows = []
    for c in range(12):
        n = r.randrange(1, 25)
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            text = r.choice(["", "</s>[INST]\\0 <s>[x]\n", "é" * r.randrange(300), prose(r.randrange(500), t), None])
            rows.append((c, t, role, text))
    rows += [(20, 0, "user", "a"), (20, 0, "user", "a"), (20, None, None, "b"), (None, 1, "assistant", "c"), (21, 1, "assistant", prose(6000)), (22, 0, "we]\nird[", "x")]
    return rows


def plain_spans(said):
    """[(start, repeated history)] of a conversation's turns (chapter, role, text), one turn after another."""
    import regex

    escaped = lambda t: t.replace("\\", "\\0").replace("<", "\\1").replace("[", "\\2").replace("]", "\\3")
    parts = [f"<s>[{escaped(role)}]\n{escaped(text)}</s>" for _, role, text in said]
    n = [len(regex.findall(chat.TOKEN, p)) + len(p.encode()) - len(p) for p in parts]
    system = n[0] if said[0][1] == "system" else None
    spans, total = [], 0
    for i, (chapter, _, _) in enumerate(said):
        if spans and said[spans[-1][0]][0] == chapter and total + n[i] <= chat.WINDOW:
            total += n[i]
            continue
        kept, hist = (system or 0) if i else 0, 0
        for h in range(1, chat.HISTORY + 1):
            before = range(i - h, i)
            fine = i >= h and all(said[j][0] == chapter and not (j == 0 and system) for j in before)
            if fine and sum(n[j] for j in before) <= chat.HISTORY_TOKENS and kept + sum(n[j] for j in before) + n[i] <= chat.WINDOW:
                hist = h
        spans.append((i, hist))
        total = kept + sum(n[i - hist : i + 1])
    return spans, n


@pytest.mark.parametrize("chapter", [256, 4])
def test_windows_read_back_and_budgets_hold(spark, monkeypatch, chapter):
    monkeypatch.setattr(chat, "CHAPTER", chapter)
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, span string, c_id int")
    windows = chat.format_conversations(df).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    by = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((-1 if t is None else t // chapter, role or "", text or ""))
    assert any(w["over"] for w in windows)
    for c, said in by.items():
        mine = sorted((w for w in windows if w["conv_id"] == c), key=lambda w: w["span"])
        assert [w["span"] for w in mine] == list(range(len(mine)))
        spans, n = plain_spans(said)
        ends = [s for s, _ in spans[1:]] + [len(said)]
        lost = []
        for w, (start, hist), end in zip(mine, spans, ends, strict=True):
            system = [0] if start and said[0][1] == "system" else []
            places = [*system, *range(start - hist, end)]
            assert [(t["role"], t["text"]) for t in w["turns"]] == [said[i][1:] for i in places]
            assert w["repeated"] == len(system) + hist and w["tokens"] == sum(n[i] for i in places)
            assert w["over"] == (w["tokens"] > chat.WINDOW) and (not w["over"] or (end == start + 1 and not hist))
            for s in w["loss"]:
                part = w["formatted"][s["start"] : s["start"] + s["length"]]
                for plain, code in reversed(chat._ESCAPES):
                    part = part.replace(code, plain)
                lost.append(part)
        assert lost == [text for _, role, text in said if role == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_windows_hold_no_more_ids_than_tokens(spark):
    """The budget's tokens bound the ids of two public vocabularies, window by window."""
    import public_tokenizers

    from wardloom.llm import bpe

    windows = chat.format_conversations(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).collect()
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        enc = bpe.encoding(public_tokenizers.path(name), public_tokenizers.PATTERN)
        assert all(len(enc.encode_ordinary(w["formatted"])) <= w["tokens"] for w in windows)


def test_planted_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.query(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-7]["loss_chars"] == len(said) and got[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["n_turns"] == 1 and got[1]["loss_chars"] == 0


def test_queries_equal_their_sql(spark):
    import duckdb

    from wardloom.llm import registry

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df, want = registry.queries()[name](spark, sf), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns), name
        plain = lambda rows, names: sorted(repr([r[names.index(c)] for c in columns]) for r in rows)
        assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns), name
