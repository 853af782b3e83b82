"""Rows that ought not to be there, texts of a megabyte, and empty tables, for the operators whose own tests lack them."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
from test_free import GOOD, frame, library
from tests_llm_help import WORD

import corpus_pipeline
from wardloom.llm import bpe, chat, packing, token_store

LONG = "Some Words, here and there. Ünïcode 語 too!\n" * 24_000


def test_packing_of_null_ids_repeated_rows_and_a_megabyte(spark):
    rows = [(None, "a b c"), (None, "a b c"), (None, None), (7, "same row"), (7, "same row"), (7, "another text"), (8, LONG)]
    out = packing.pack_documents(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()
    encode = library("byte_bpe_50k.json")
    want = collections.Counter((d, len(encode(t)) + 1) for d, t in rows)
    assert len(LONG) > 1_000_000 and collections.Counter((r["doc_id"], r["doc_tokens"]) for r in out if r["start"] == 0) == want
    assert sum(r["length"] for r in out) == sum(n * k for (_, n), k in want.items())
    by_seq = collections.defaultdict(list)
    for r in out:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    ids = [*encode(LONG), 1]
    for r in (r for r in out if r["doc_id"] == 8):
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_bpe_of_nothing_null_ids_and_repeated_rows(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert bpe.query(spark, str(tmp_path / "none")).count() == 0
    rows = [(None, "x y"), (None, "x y"), (None, None), (3, "x y"), (3, "x y"), (3, "z"), (4, "\x00 ퟿")]
    frame(spark, rows).write.parquet(str(tmp_path / "some/documents.parquet"))
    got = collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in bpe.query(spark, str(tmp_path / "some")).collect())
    assert got == collections.Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)


def test_a_megabyte_in_a_token_file(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    manifest = token_store.write_store(frame(spark, [(1, "one"), (2, LONG), (3, None)]), folder, public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: list(np.frombuffer(r["ids"], "<u4")) for r in token_store.read_store(spark, folder, manifest).collect()}
    encode = library("word_bpe_49k.json")
    assert got == {1: [*encode("one"), 1], 2: [*encode(LONG), 1], 3: [1]}


def test_a_megabyte_in_a_turn(spark, tmp_path):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG), (2, 0, "user", None), (2, 1, "assistant", "ok")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.query(spark, str(tmp_path)).collect()}
    assert got[1]["loss_chars"] == len(LONG) and got[1]["loss_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    turns = "".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and got[2]["loss_chars"] == 2


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Rows repeated whole, repeated and null ids, columns with clashing names, a long text: each stage's rule holds."""
    def text(k, n=70):
        return " ".join(f"{GOOD[(i * 7 + k) % len(GOOD)]}{k * 1000 + i}" for i in range(n)) + "."

    long_text = "\n".join(text(100 + k, 60) for k in range(2200))
    rows = [(1, text(1)), (1, text(1)), (1, text(2)), (None, text(3)), (None, text(3)), (None, text(4)), (2, text(1)), (5, long_text), (6, None), (7, "short")]
    made = [(d, t, "en", "s", 0, "x", 1, "y") for d, t in rows]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, kept string, predicted int, __id string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        df = stage(spark, df, str(tmp_path)).cache()
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    got = collections.Counter((r["doc_id"], len(WORD.findall(r["text"]))) for r in df.collect())
    assert len(long_text) > 1_000_000
    assert got == {(1, 70): 2, (None, 70): 2, (5, 132_000): 1}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {1, None, 5}
