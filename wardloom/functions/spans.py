"""Where a phonetic match lies in the text as it is written.

The key of a text is built by rewriting rules here, each of which carries the
source span of what it rewrites.  It is for the few rows of a top-k; whole
columns take ``text.phonetic_key``, which gives the same keys.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from wardloom.functions import text as X

_SOUNDS = {**X.SOUNDS, **dict(zip(X.DEVANAGARI_DIGITS, X.ASCII_DIGITS, strict=True))}
_SILENT = re.compile(f"[{X.SILENT}]")
_NASAL = re.compile(f"[ंँ](?=[{X.SILENT}]*ह)")
# Fixed value: marks that belong to the letter before them.
_MARKS = re.compile("[ऀ-ःऺ-ॏ॑-ॗॢॣ‌‍]")
#: What the skeleton makes of letters, in order; a rule's source goes to what it leaves.
_RULES = [
    (r"([^ a])a+", r"\1"), (r"(?<![^ ])a+([^ a])", r"\1"), (r"a+", ""), (r"  +", " "), (r"^ ", ""),
    (r"ee", "i"), (r"oo", "u"), (r"([kgcjtdpbs])h+", r"\1"), (r"m(?=[pb])", "n"), (r"y(?= |$)", "i"), (r"([a-z])\1+", r"\1"), (r" +$", ""),
]


class Key(NamedTuple):
    text: str
    spans: list[tuple[int, int]]


def _rewrite(key: Key, pattern: str, by: str) -> Key:
    out, spans, at = [], [], 0
    for m in re.finditer(pattern, key.text):
        new, source = m.expand(by), key.spans[m.start() : m.end()]
        out += [key.text[at : m.start()], new]
        spans += key.spans[at : m.start()] + [(min(s for s, _ in source), max(e for _, e in source))] * len(new)
        at = m.end()
    return Key("".join([*out, key.text[at:]]), spans + key.spans[at:])


def phonetic(text: str) -> Key:
    """The phonetic key, with the source span of each of its characters."""
    nasal = {m.start() for m in _NASAL.finditer(text)}
    letters, spans = [], []
    for i, written in enumerate(text):
        for c in unicodedata.normalize("NFD", written).lower():
            sound = "ng" if i in nasal else _SOUNDS.get(c, c if re.fullmatch("[a-z0-9]", c) else "" if _SILENT.match(c) else " ")
            letters.append(sound)
            spans += [(i, i + 1)] * len(sound)
    key = Key("".join(letters), spans)
    for pattern, by in _RULES:
        key = _rewrite(key, pattern, by)
    return key


def code(text: str) -> Key:
    """Letters and digits alone, with their places."""
    found = [(c, i) for i, w in enumerate(text) if re.fullmatch("[a-z0-9]", c := _SOUNDS.get(w, w) if w in X.DEVANAGARI_DIGITS else w.lower() if w.isascii() else w)]
    return Key("".join(c for c, _ in found), [(i, i + 1) for _, i in found])


def ranges(text: str, key: Key, query: str) -> list[tuple[int, int]]:
    """Merged source ranges of all places (not overlapping) where ``query`` lies in the key, widened over marks."""
    found, at = [], key.text.find(query) if query else -1
    while at >= 0:
        part = key.spans[at : at + len(query)]
        start, end = min(s for s, _ in part), max(e for _, e in part)
        while start > 0 and _MARKS.match(text[start]):
            start -= 1
        while end < len(text) and _MARKS.match(text[end]):
            end += 1
        found.append((start, end))
        at = key.text.find(query, at + len(query))
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged
