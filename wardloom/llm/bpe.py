"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Each task loads the ranks once.  Long texts are cut where the split pattern
always has a boundary (before white space that follows another character, or
after the last of some letters or digits), so no regular-expression match spans
a cut.  A run of letters, digits or other marks is one piece by the pattern
itself and is never cut, however long.  Cuts are known for PATTERN alone: with
any other pattern a text is encoded whole.  Ids decode to raw bytes; a code
point split over tokens is no matter.

Defined results: null text is empty and has no ids; control strings are
ordinary text; repeated rows come out alike; only the id and text columns are
read, so other columns can't clash (an id column named like a result is
refused); an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import table, text_of
from wardloom.llm.tokens import packed

#: A text longer than this is cut into parts of about this many code points.
LONG = 50_000
# Fixed value: the split pattern of the rank file, for which the cuts below hold.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])|(?<=[A-Za-z])(?=[\x00-\x7f])(?![A-Za-z])|(?<=[0-9])(?=[\x00-\x7f])(?![0-9])")


@functools.cache
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, long: int = LONG) -> Iterator[str]:
    """The text in parts that encode to the same ids as the whole."""
    start = 0
    while len(text) - start > long:
        cut = _CUT.search(text, start + long)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc, text: str, long: int = LONG) -> list[int]:
    if len(text) <= long or enc._pat_str != PATTERN:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text, long) for i in enc.encode_ordinary(part)]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", ids: bool = True, digests: bool = False
) -> DataFrame:
    """Per row: the id column, n_tokens, and ``ids`` (array<int>) and/or digests of the ids and of their decoded bytes."""
    if id_col in ("text", "n_tokens", "ids", "ids_sha256", "decoded_sha256"):
        raise ValueError(f"the id column can't be named {id_col}")
    rows = docs.select(F.col(id_col), text_of(text).alias("text"))
    kind = {"n_tokens": "long"} | ({"ids": "array<int>"} if ids else {}) | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {})
    schema = ", ".join([f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}", *(f"{k} {v}" for k, v in kind.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kind}
            for t in batch.column("text"):
                found = encode(enc, t.as_py())
                out["n_tokens"].append(len(found))
                if ids:
                    out["ids"].append(found)
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(packed(found)).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(enc.decode_bytes(found)).hexdigest())
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(v, types[k]) for k, v in out.items())], names=[id_col, *out])

    return rows.mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the ids' raw bytes added; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            raw = [None if x is None else enc.decode_bytes(x) for x in batch.column(ids).to_pylist()]
            kept = [(n, batch.column(n)) for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(raw, pa.binary())], names=[*(n for n, _ in kept), out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out]
    return df.mapInArrow(run, ", ".join([*fields, f"`{out}` binary"]))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True
    )
