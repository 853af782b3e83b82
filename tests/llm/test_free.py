"""Near-dedup, packing, token files, BPE, classifier and the pipeline."""

import collections
import functools
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardloom.llm import bpe, near_dedup, packing, quality_mil, token_store, tokens

DOCS = "doc_id long, text string, length string, cid string, score string"
ODD = [None, "", " \n", "x", "<|endoftext|> it's", "naïve café 語語 𝒳 ́e ٣ ½ ﬁ", "a b c  d\n\n e", "ΣΑΣ İstanbul ǅ", "word " * 3000, "'s't 'RE 12three4.5--!! \x01\x02 \x85 x"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "l", "c", "s") for i, t in rows], DOCS)


# near-dedup


def similar(rows):
    """(size, component, kept) by comparing all pairs."""

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(d, shingles(t)) for d, t in rows]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        groups[top(i)].append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(s), low[top(i)], d == low[top(i)]) for i, (d, s) in enumerate(sets)), key=str)


def copies(seed=1, groups=12, size=14, words=90):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows, n = [], 0
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(6)):
                w[r.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("low", [False, True])
def test_components_equal_all_pairs(spark, monkeypatch, low):
    rows = copies() + [(900, "A b C d E f"), (901, "a B c D e F"), (902, "a b"), (903, "A B"), (904, ""), (905, None), (906, "  "), (None, "a b"), (None, None), (902, "a b")]
    if low:  # branch all but the smallest nodes, compare what stays large in chunks
        for k, v in (("WORK", 3), ("PIVOTS", 1), ("MAX_DEPTH", 2), ("BLOCK_BYTES", 2000), ("AT_ONCE", 2)):
            monkeypatch.setattr(near_dedup, k, v)
    out = near_dedup.near_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, out), key=str) == similar(rows)


@pytest.mark.parametrize("dense", [0, 4, 10**6])
def test_nodes_with_many_alike_pairs(spark, monkeypatch, dense):
    """Groups whose members are alike without all being linked, by pair or on full sets, as DENSE says."""
    rows, r = [], random.Random(8)
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(120)]
        for i in range(40):
            w = list(base)
            for k in r.sample(range(120), 4 + i % 5):
                w[k] = f"new{r.randrange(10**9)}"
            rows.append((1000 * g + i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    out = near_dedup.near_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, out), key=str) == similar(rows)


def test_very_long_near_copies_meet(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(170_000)]
    other = list(words)
    for i in r.sample(range(len(words)), 4000):
        other[i] = "changed"
    rows = [(7, " ".join(words)), (3, " ".join(other)), (9, " ".join(words[: len(words) // 2]))]
    out = near_dedup.near_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, out)) == sorted(similar(rows))


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e"), (2, "A B C D E"), (3, "other words are here now"), (3, "other words are here now"), (4, ""), (5, None)]
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(frame(spark, rows)).collect()) == [1, 3, 4, 5]
    assert near_dedup.near_components(frame(spark, [])).count() == 0


def test_one_stays_where_ids_repeat_or_are_null(spark):
    """Rows are told apart by id and text: a null id or a repeated one lets no near copy through."""
    a, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59))
    b, c, d = "other words are here now", "some more words are here", "the last words of all"
    rows = [(3, a), (5, a), (5, near), (5, b), (None, a), (None, c), (None, c), (None, c + " now"), (7, d), (7, d), (None, ""), (None, None), (8, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in near_dedup.keep_one(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (None, c), (None, c + " now"), (7, d), (8, ""), next((x, t) for x, t in got if x is None and not t)], key=str)
    twice = [(1, a), (1, near), (2, a), (None, b), (None, b.upper())]
    got = [(r["doc_id"], r["text"]) for r in near_dedup.keep_one(frame(spark, twice)).collect()]
    assert sorted(x is None for x, _ in got) == [False, True] and {x for x, _ in got} == {1, None}
    kept = near_dedup.near_components(frame(spark, rows)).filter("doc_id = 5 OR doc_id IS NULL").select("doc_id", "component_id", "kept").collect()
    assert sum(r["kept"] for r in kept) == 6 and (5, 3, False) in {tuple(r) for r in kept}


def test_components_of_a_long_chain(spark):
    n = 200
    links = [(i, i + 1) for i in range(n)]
    random.Random(2).shuffle(links)
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["comp"] for r in got} == {0} and len(got) == n


# tokens


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def some_texts(spark):
    return [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(spark, name):
    lib, mine = library(name), tokens.encoder(public_tokenizers.path(name))
    r = random.Random(3)
    noise = ["".join(r.choice("abCD 's.,!12\n\t éßΣ语́ '`-_½²") for _ in range(60)) for _ in range(400)]
    for t in [x or "" for x in ODD] + noise + some_texts(spark):
        assert mine(t) == lib(t), repr(t[:80])


def test_other_kinds_of_files_go_to_the_library(tmp_path, monkeypatch):
    import json

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        file = json.load(f)
    assert tokens._short_way(file) is not None
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**file["model"], "fuse_unk": True}}):
        assert tokens._short_way({**file, **change}) is None
    with pytest.raises(ValueError, match="merges"):
        tokens._short_way({**file, "model": {**file["model"], "merges": file["model"]["merges"][::-1]}})
    plain = tmp_path / "plain.json"
    plain.write_text(json.dumps({**file, "normalizer": None}), encoding="utf-8")
    assert tokens.encoder(str(plain))("Some Words, Here") == tokens.library(str(plain))("Some Words, Here")
    monkeypatch.setattr(tokens, "_short_way", lambda file: lambda text: [1, 2])
    tokens.encoder.cache_clear()
    with pytest.raises(ValueError, match="differ"):
        tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))("hello")
    tokens.encoder.cache_clear()


# packing


def check_packing(out, texts, encode):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = [*encode(texts[d] or ""), 1], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    return {s: sum(r["length"] for r in p) for s, p in by_seq.items()}


def test_packing_places_every_id_once_with_little_padding(spark):
    texts = {i: t for i, t in enumerate(ODD + some_texts(spark)[:300])}
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack_documents(frame(spark, texts.items()), path, ids=True).cache()
    fill = check_packing(out.collect(), texts, library("byte_bpe_50k.json"))
    assert sum(fill.values()) / (len(fill) * packing.CAPACITY) > 0.97
    got = {r["sequence_id"]: r["ids"] for r in packing.sequences(out).collect()}
    assert {k: len(v) for k, v in got.items()} == fill
    assert any(r["length"] == packing.CAPACITY for r in out.collect())
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_fill_is_the_best_subset():
    r = random.Random(6)
    for _ in range(200):
        items = sorted(((r.randrange(1, 40), r.randrange(1, 4)) for _ in range(r.randrange(1, 7))), reverse=True)
        items = list(dict(items).items())
        room = r.randrange(1, 90)
        sums = {0}
        for x, n in items:
            sums = {s + x * k for s in sums for k in range(n + 1)}
        chosen = packing.fill(items, room)
        assert sum(x * n for x, n in chosen) == max(s for s in sums if s <= room)
        assert all(n <= dict(items)[x] for x, n in chosen)


def test_plan_uses_every_piece_once():
    counts = {2048: 3, 1500: 7, 548: 2, 100: 50, 1: 5}
    used = collections.Counter()
    for x, a, b, *_ in packing.plan(counts):
        assert a == used[x]
        used[x] = b
    assert dict(used) == counts and packing.plan({}) == []


def test_one_length_that_most_pieces_share(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(1000).cast("long").alias("length"))
    out = packing.pack(rows)
    assert out.select("sequence_id", "offset").distinct().count() == 5000 and out.select("sequence_id").distinct().count() == 2500


# token files


def test_store_round_trip(spark, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(ODD + some_texts(spark)[:150])] + [(None, "first"), (6, "again")]
    folder, path = f"file://{tmp_path}/store", public_tokenizers.path("word_bpe_49k.json")
    manifest = token_store.write_store(frame(spark, rows), folder, path)
    got = sorted(((r["start"], r["doc_id"], list(np.frombuffer(r["ids"], "<u4"))) for r in token_store.read_store(spark, folder, manifest).collect()))
    lib = library("word_bpe_49k.json")
    want = collections.Counter((d, tuple([*lib(t), 1])) for d, t in rows)
    assert collections.Counter((d, tuple(ids)) for _, d, ids in got) == want
    keys, at = [-1 if d is None else d for _, d, _ in got], 0
    assert keys == sorted(keys)
    for start, _, ids in got:
        assert start == at
        at += len(ids)
    file = manifest.first()["file"]
    assert token_store.read_document(folder, file, 1) == got[1][2]
    assert any(f.endswith(".zdict") and os.path.getsize(tmp_path / "store" / f) > 0 for f in os.listdir(tmp_path / "store"))
    digests = {(r["doc_id"], r["ids_crc32"]) for r in token_store.read_digests(spark, folder, manifest).collect()}
    assert digests == {(d, zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in want}


def test_store_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    manifest = token_store.write_store(frame(spark, []), folder, public_tokenizers.path("word_bpe_49k.json"))
    assert token_store.read_store(spark, folder, manifest).count() == 0


# BPE


def test_bpe_encodes_and_decodes(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = list(enumerate(ODD))
    df = bpe.encode_documents(frame(spark, rows), path, public_tokenizers.PATTERN, digests=True)
    out = bpe.decode_ids(df, path, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in out} == {i: t or "" for i, t in rows}
    for r in out:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((rows[r["doc_id"]][1] or "").encode()).hexdigest()


def plain_bpe(ranks, text):
    """Regex split, then the lowest-ranked neighbours joined until none is left."""
    import regex

    @functools.cache
    def merged(piece):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[at] + parts[at + 1] not in ranks:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    return [i for piece in regex.findall(public_tokenizers.PATTERN, text) for i in merged(piece)]


def test_bpe_query_equals_a_plain_reading(spark, tmp_path):
    """Ids and digests against a regex split with rank merges; a long text without white space, and long prose."""
    import base64

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    texts = [*ODD, *some_texts(spark)[:40], "".join(f"key{i}=value{i * i};" for i in range(70_000)), " ".join(f"word{i % 999} é{i % 7}" for i in range(90_000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in bpe.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and max(len(t or "") for t in texts) > 1_000_000
    for i, t in enumerate(texts):
        ids = plain_bpe(ranks, t or "")
        raw = np.array(ids, "<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest()), i
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_with_another_pattern_and_clashing_names(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc, text = bpe.encoding(path, r"\S+|\s+"), "ab12 " * 30
    assert bpe.encode(enc, text, 5) == enc.encode_ordinary(text)
    with pytest.raises(ValueError, match="ids"):
        bpe.encode_documents(spark.createDataFrame([(1, "a")], "ids long, text string"), path, public_tokenizers.PATTERN, id_col="ids")


def test_safe_parts_encode_alike():
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(5)
    for _ in range(200):
        t = "".join(r.choice("ab'sé 12  \n\t.,! \x1c语") for _ in range(300))
        parts = list(bpe.safe_parts(t, r.randrange(1, 30)))
        assert "".join(parts) == t and [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    assert list(bpe.safe_parts("x" * 100, 10)) == ["x" * 100]


# classifier


def test_gradients_are_right():
    r = np.random.default_rng(1)
    model = quality_mil.Attention.fresh(2)
    model.weights = {k: v + 0.01 for k, v in model.weights.items()}
    counts, y = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x = r.random((6, quality_mil.FEATURES))
    loss = lambda: -np.mean(y * np.log(model.forward(x, counts)["p"]) + (1 - y) * np.log(1 - model.forward(x, counts)["p"]))
    grads = model.gradients(x, counts, y)
    for name, w in model.weights.items():
        for _ in range(4):
            i = tuple(r.integers(0, n) for n in w.shape)
            old = w[i]
            w[i] = old + 1e-5
            up = loss()
            w[i] = old - 1e-5
            down = loss()
            w[i] = old
            assert abs((up - down) / 2e-5 - grads[name][i]) < 1e-6, name


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_mil.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(out) > 50 and sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.9
    rank = [(a["score"] > b["score"]) for a in out if a["quality"] == 1 for b in out if b["quality"] == 0]
    assert sum(rank) / len(rank) > 0.95


def test_scores_of_odd_rows_and_labels(spark):
    docs = frame(spark, [*enumerate(ODD), (3, "twice"), (None, "no id")])
    one = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert quality_mil.train(docs, one) == 1.0 and quality_mil.train(docs, one.limit(0)) == 0.5
    model = quality_mil.Attention.fresh()
    out = quality_mil.score_documents(docs, model).collect()
    assert len(out) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in out)
    assert quality_mil.score_documents(docs.limit(0), model).count() == 0


def plain_features(piece):
    """The features of one passage, by loops."""
    out = np.zeros(quality_mil.FEATURES)
    kinds = quality_mil.byte_classes()[list(piece)].tolist() if piece else []
    pairs = collections.Counter(zip(kinds, kinds[1:]))
    for (a, b), n in pairs.items():
        out[a * 16 + b] = np.sqrt(n / (len(piece) - 1))
    words = [w.lower() for w in piece.split()]  # of bytes: A-Z and the six ASCII spaces alone
    mask, hashes = (1 << 64) - 1, []
    for w in words:
        h, power = 0, 1
        for c in w:
            h, power = (h + c * power) & mask, power * 0x100000001B3 & mask
        hashes.append(h * 0x9E3779B97F4A7C15 & mask)
    for bucket, n in collections.Counter(h >> 56 for h in hashes).items():
        out[256 + bucket] = np.sqrt(n / len(words))
    if words:
        triples = list(zip(words, words[1:], words[2:]))
        out[-3:] = len(set(words)) / len(words), len(set(triples)) / max(1, len(words) - 2), np.log1p(len(words)) / 5
    return out


def plain_score(model, text):
    """Forward pass over all passages, one after another."""
    m, raw = model.weights, (text or "").encode()
    x = [plain_features(raw[k : k + quality_mil.PASSAGE]) for k in range(0, max(1, len(raw)), quality_mil.PASSAGE)]
    hidden = [np.maximum(v @ m["W"] + m["b"], 0) for v in x]
    e = np.array([(np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["U"])))) @ m["w"] for h in hidden])
    a = np.exp(e - e.max())
    z = sum(w * h for w, h in zip(a / a.sum(), hidden))
    return float(1 / (1 + np.exp(-(z @ m["c"] + m["c0"][0]))))


def test_scores_equal_a_plain_forward_pass_however_rows_are_dealt(spark, monkeypatch):
    """Encoder, attention, slices; one table under three partitionings and with other neighbours."""
    monkeypatch.setattr(quality_mil, "SLICE", quality_mil.PASSAGE * 3)
    model = quality_mil.Attention.fresh(4)
    texts = [*ODD, *some_texts(spark)[:60], "é" * 5000, "Long words " * 3000]
    one = spark.createDataFrame([(i, t, "a", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, __text string, score double")
    read = lambda df: {r["doc_id"]: r["score"] for r in quality_mil.score_documents(df, model, keep=("doc_id", "score")).collect()}
    got = read(one.coalesce(1))
    assert all(abs(got[i] - plain_score(model, t)) < 1e-6 for i, t in enumerate(texts))
    assert read(one.repartition(3)) == got and read(one.repartition(16, "doc_id")) == got
    assert read(one.orderBy(F.desc("text")).coalesce(1)) == got


def test_a_megabyte_is_scored(spark):
    model, text = quality_mil.Attention.fresh(1), "some Words, here. " * 70_000
    got = quality_mil.score_documents(frame(spark, [(1, text)]), model).first()["score"]
    assert len(text) > 1_200_000 and abs(got - model.forward(quality_mil.encode(text.encode()), np.array([-(-len(text) // 800)]))["p"][0]) < 2e-6


def test_fold_zero_never_trains(spark):
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 0][:50]
    docs = spark.createDataFrame([(i, "text") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    assert quality_mil.train(docs, labels) == 0.5


# pipeline

GOOD = "the quiet river bends past old mills where people mend nets and talk of rain until evening comes over fields".split()


def test_pipeline_equals_its_stages_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from tests_llm_help import brute_pipeline

    want, columns = brute_pipeline(spark, sf, docs), ["doc_id", "text", "lang", "source", "n_chars"]
    df = docs
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:4], want, strict=True):
        df = stage(spark, df, sf)
        assert df.columns == columns
        df = df.cache()
        assert {r["doc_id"]: r["text"] for r in df.collect()} == expected, name
    out = corpus_pipeline.run(spark, sf).collect()
    check_packing(out, want[-1], library("byte_bpe_50k.json"))


def test_classifier_drops_what_the_rules_let_pass(spark, tmp_path):
    """Planted rows that pass every rule and read like the rows labelled low: the classifier drops them and no clean one."""
    r = random.Random(4)
    good = lambda: ". ".join(" ".join(r.choice(GOOD) for _ in range(12)).capitalize() for _ in range(9)) + "."
    bad = lambda: ". ".join(" ".join("".join(r.choice("zxqkvj") for _ in range(5)) for _ in range(12)).capitalize() for _ in range(9)) + "."
    rows = [(i, bad() if i % 3 == 0 else good(), "en", "s", 0) for i in range(300)] + [(900, None, "en", None, 0), (None, good(), None, "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 3 != 0), 0) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    passed = corpus_pipeline.quality_rules_stage(spark, docs, str(tmp_path)).cache()
    assert {r["doc_id"] for r in passed.collect()} == {None, *range(300)}
    kept = {r["doc_id"] for r in corpus_pipeline.classifier_stage(spark, passed, str(tmp_path)).collect()}
    assert kept == {None, *(i for i in range(300) if i % 3)}
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not out & {i for i in range(300) if i % 3 == 0} and len(out) > 150


def test_pipeline_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
