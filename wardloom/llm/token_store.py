"""Token-ID files: documents compressed one by one with a shared zstandard dictionary.

A store is a folder: ``dictionary-<hash>.zdict``, and for each range of
documents a data file (``<no>.bin``: one zstandard frame per document) and its
index (``<no>.idx``: dictionary hash, then per document its id, the offset of
its frame, and how many ids come before it in the file).  A document is read
with one seek and one short frame.  The dictionary is trained on serialized id
arrays of a bounded sample: SAMPLE documents at most (by hash of their ids), and
of each SAMPLE_CHARS characters at most, from a place that its hash picks.
Every document is then written whole.  There are as many files as FILE_BYTES of
text ask for, MAX_FILES at most.

Tasks write under a name of their own and rename at the end, so a task that
runs twice (a lost executor, speculation) leaves one complete file.

Defined results: null text is empty and is a document of its end id alone; a
long text is one frame, encoded in one call; ids must be whole numbers (they are
cast to long), a null id is written first; repeated rows are separate documents;
an empty table makes a store without documents; only the id and text columns are
read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm.common import own_path, table, text_of
from wardloom.llm.tokens import encoder, packed

END_ID = 1
SAMPLE = 1000
SAMPLE_CHARS = 8000  # of a document of the sample
FILE_BYTES, MAX_FILES = 128 << 20, 100_000
DICTIONARY_BYTES = 32 << 10
LEVEL = 1
_MAGIC = b"WLTS0001"
_ENTRY = "<?qQQ"  # id is null, id, offset in the data file, ids before it there


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A shared dictionary; empty if there is too little to learn from."""
    import zstandard

    if sum(map(len, samples)) < 20 * 1024 or len(samples) < 20:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 10), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def _serialized(ids: list[int]) -> bytes:
    """Ids below 65,536 take two bytes; a leading byte says which width follows."""
    if max(ids, default=0) < 1 << 16:
        return b"\x02" + array("H", ids).tobytes()
    return b"\x04" + packed(ids)


def _ids(raw: bytes) -> array:
    out = array("H" if raw[:1] == b"\x02" else "I")
    out.frombytes(raw[1:])
    return out


def write_store(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` in ascending id order; returns the manifest: (file, first_start, n_docs, n_ids) by file."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text"))
    raw = _trained(rows, path)
    digest = hashlib.sha256(raw).hexdigest()
    files, root = _at(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/dictionary-{digest[:16]}.zdict") as f:
        f.write(raw)
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        encode, coder = encoder(path), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value), write_content_size=True)
        no, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, root = _at(folder)
        data, index, offset, before, n = None, [], 0, 0, 0
        for batch in batches:
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(t.as_py())
                ids.append(END_ID)
                frame = coder.compress(_serialized(ids))
                data = data or files.open_output_stream(f"{root}/_{own}.bin")
                data.write(frame)
                index.append(struct.pack(_ENTRY, key is None, key or 0, offset, before))
                offset, before, n = offset + len(frame), before + len(ids), n + 1
        if data is None:
            return
        data.close()
        with files.open_output_stream(f"{root}/_{own}.idx") as f:
            f.write(_MAGIC + bytes.fromhex(digest) + struct.pack("<QQQ", n, offset, before))
            f.write(b"".join(index))
        for end in ("bin", "idx"):
            files.move(f"{root}/_{own}.{end}", f"{root}/{no:06d}.{end}")
        names = ["no", "n_docs", "n_ids"]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (no, n, before)], names=names)

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MAX_FILES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES)))
    order = F.asc_nulls_first("doc_id")
    dealt = rows.repartitionByRange(n, order, F.xxhash64("text")).sortWithinPartitions(order, F.xxhash64("text"))
    written = sorted(tuple(r) for r in dealt.mapInArrow(run, "no long, n_docs long, n_ids long").collect())  # a row per file
    manifest, start = [], 0
    for no, n_docs, n_ids in written:
        manifest.append((f"{no:06d}", start, n_docs, n_ids))
        start += n_ids
    return spark.createDataFrame(manifest, "file string, first_start long, n_docs long, n_ids long")


def _trained(rows: DataFrame, path: str) -> bytes:
    """The dictionary from about SAMPLE documents: those with the smallest hashes of their ids."""
    hashed = F.xxhash64("doc_id", F.lit(7))
    n = rows.count()
    if not n:
        return b""
    near = F.lit(min((1 << 63) - 1, int(-(1 << 63) + 2 * SAMPLE / n * (1 << 64))))  # about twice the sample
    spare = F.greatest(F.lit(0), F.length("text") - SAMPLE_CHARS)
    place = F.pmod(F.xxhash64("doc_id", F.lit(8)), spare + 1).cast("int") + 1
    part = F.substring("text", place, F.lit(SAMPLE_CHARS))
    some = rows.filter(hashed <= near).orderBy(hashed, "doc_id").limit(SAMPLE).select(part).collect()
    encode = encoder(path)
    return train([_serialized([*encode(t), END_ID]) for (t,) in some])


def _by_file(manifest: DataFrame) -> DataFrame:
    """A task per file or so; the manifest has a row per file."""
    return manifest.repartition(max(1, manifest.count()), "file")


def read_store(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian unsigned 32-bit): every document, from the files."""
    return _by_file(manifest).mapInArrow(_reader(folder, digest=False), "doc_id long, start long, n_tokens long, ids binary")


def read_digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """As read_store, with the ids' crc32 in their place."""
    return _by_file(manifest).mapInArrow(_reader(folder, digest=True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _open(files: pafs.FileSystem, root: str, file: str) -> tuple[list[tuple], int, bytes]:
    """The index's entries, the data's size, the dictionary."""
    with files.open_input_file(f"{root}/{file}.idx") as f:
        raw = f.read()
    if raw[:8] != _MAGIC:
        raise ValueError(f"{file}.idx isn't a token index")
    digest, (n, size, _) = raw[8:40].hex(), struct.unpack_from("<QQQ", raw, 40)
    with files.open_input_file(f"{root}/dictionary-{digest[:16]}.zdict") as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"{file}.idx names another dictionary")
    return list(struct.iter_unpack(_ENTRY, raw[64 : 64 + n * struct.calcsize(_ENTRY)])), size, dictionary


def read_document(folder: str, file: str, place: int) -> list[int]:
    """The ids of one document (the place-th of a file), by one seek."""
    import zstandard

    files, root = _at(folder)
    entries, size, dictionary = _open(files, root, file)
    start, end = entries[place][2], entries[place + 1][2] if place + 1 < len(entries) else size
    with files.open_input_file(f"{root}/{file}.bin") as f:
        frame = f.read_at(end - start, start)
    return list(_ids(zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(frame)))


def _reader(folder: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, root = _at(folder)
        kind = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()} | ({"ids_crc32": pa.int64()} if digest else {"ids": pa.binary()}))
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first_start").to_pylist(), strict=True):
                entries, size, dictionary = _open(files, root, file)
                reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
                ends = [e[2] for e in entries[1:]] + [size]
                with files.open_input_stream(f"{root}/{file}.bin") as f:
                    for k in range(0, len(entries), 500):
                        out: list[list] = [[], [], [], []]
                        for (none, key, offset, before), end in zip(entries[k : k + 500], ends[k : k + 500], strict=True):
                            ids = _ids(reader.decompress(f.read(end - offset)))
                            raw = array("I", ids).tobytes()
                            for column, x in zip(out, (None if none else key, first + before, len(ids), zlib.crc32(raw) if digest else raw), strict=True):
                                column.append(x)
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kind.types, strict=True)], schema=kind)

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = own_path(spark, "token-store")
    manifest = write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, folder, manifest)
