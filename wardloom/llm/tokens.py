"""Encoding with local vocabulary files, inside Spark tasks.

Tokenizers are loaded once per Python worker from a path that is a parameter.
Ids are those of the tokenizers library.  For files of two known kinds, texts of
common scripts take tiktoken's merge loop with ranks read from the same file,
which gives the same ids several times faster (see ``encoder``); every other
text, and every other kind of file, goes to the library itself.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable

#: Latin, Greek (but the capital sigma, whose lower case depends on its place) and Cyrillic letters, general punctuation:
#: one meaning in every Unicode version in use.
_COMMON = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa0-\\u02af\\u0391-\\u03a1\\u03a4-\\u03a9\\u03b1-\\u03c1\\u03c3-\\u03c9\\u0410-\\u044f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*").fullmatch
_GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_END = "\x01"
_WORD_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+").findall


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# What a file's JSON says of its splitting, where the short ways below hold.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False,
    "byte_fallback": False, "ignore_merges": False,
}
_BYTE_FILE = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
}
_WORD_FILE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Of so many texts, the first of at most PROBE_CHARS is encoded both ways and compared.
PROBE_EVERY, PROBE_CHARS = 64, 4000


def library(path: str) -> Callable[[str], list[int]]:
    """Text to ids by the tokenizers library and nothing else."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def _ranks(file: dict, end: str) -> dict[bytes, int]:
    """Each token's bytes (with a byte 1 for a word's end) and id; the merges must make the tokens in the order of their ids."""
    letters = byte_letters()

    def raw(token: str) -> bytes:
        word = token.removesuffix(end) if end and len(token) > len(end) else token
        return bytes(letters[c] for c in word) + (b"\x01" if word != token else b"")

    special = {t["content"] for t in file["added_tokens"]}
    ids = {token: i for token, i in file["model"]["vocab"].items() if token not in special}
    pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in file["model"]["merges"]]
    made = [ids["".join(p)] for p in pairs]
    if made != sorted(made) or len(set(made)) != len(made):
        raise ValueError("the merges don't follow the ids")
    return {raw(token): i for token, i in ids.items()}


def _short_way(file: dict) -> Callable[[str], list[int]] | None:
    """Encodes texts of ``_COMMON`` characters as a file like this one says; None for any other kind of file."""
    import tiktoken

    end = file["model"].get("end_of_word_suffix")
    settings = {k: file.get(k) for k in ("normalizer", "pre_tokenizer")}
    if any(file["model"].get(k) != v for k, v in _PLAIN_MODEL.items()) or file.get("post_processor") is not None:
        return None
    if settings == _BYTE_FILE and end is None:
        return tiktoken.Encoding("byte", pat_str=_GPT_PATTERN, mergeable_ranks=_ranks(file, ""), special_tokens={}).encode_ordinary
    if settings != _WORD_FILE or end != "</w>":
        return None
    # the end of a word is one more byte: "b</w>" is the pair (b, end), whose rank comes before every merge of letters
    fast = tiktoken.Encoding("word", pat_str=r"[^\x01]+\x01", mergeable_ranks=_ranks(file, end), special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        chunks = text.lower().split()
        for i, word in enumerate(map(str.isalpha, chunks)):
            if not word:
                chunk = chunks[i]
                if chunk[-1] in ".,!?" and chunk[:-1].isalpha():
                    chunks[i] = f"{chunk[:-1]}{_WORD_END}{chunk[-1]}"
                else:
                    chunks[i] = _WORD_END.join(_WORD_PARTS(chunk))
        return fast(_WORD_END.join(chunks) + _WORD_END) if chunks else []

    return encode


@functools.cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to the ids that the tokenizers library gives with this file, several times faster for common scripts.

    The short way is taken only for files whose model, normalizer and
    pre-tokenizer are the ones it was made for, and only for texts of
    ``_COMMON`` characters; some texts are encoded by the library as well, and a
    difference raises.  Everything else goes to the library.
    """
    with open(path, encoding="utf-8") as f:
        short = _short_way(json.load(f))
    whole = functools.cache(lambda: library(path))
    seen = 0

    def encode(text: str) -> list[int]:
        nonlocal seen
        if short is None or not _COMMON(text):
            return whole()(text)
        ids = short(text)
        seen += 1
        if seen % PROBE_EVERY == 1 and len(text) <= PROBE_CHARS and ids != whole()(text):
            raise ValueError(f"{path}: the short way's ids differ from the library's")
        return ids

    return encode


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    out = array("I", ids)
    if out.itemsize != 4:
        raise RuntimeError("array('I') isn't 32 bits wide here")
    if os.sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()
