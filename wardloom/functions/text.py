"""Script-aware text functions as column expressions.

Every function takes and returns a Column; none is a Python function per row
but ``nfc``, which Spark lacks.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of both scripts and the skeleton letters each one sounds as.
SOUNDS = {
    "अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ऋ": "ri", "ॠ": "ri", "ऌ": "li", "ऍ": "e", "ऎ": "e", "ए": "e", "ऐ": "i",
    "ऑ": "o", "ऒ": "o", "ओ": "o", "औ": "u", "ॐ": "om",
    "ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "ृ": "ri", "ॄ": "ri", "ॅ": "e", "ॆ": "e", "े": "e", "ै": "i", "ॉ": "o", "ॊ": "o", "ो": "o", "ौ": "u",
    "क": "k", "ख": "k", "ग": "g", "घ": "g", "ङ": "n", "च": "c", "छ": "c", "ज": "j", "झ": "j", "ञ": "n", "ट": "t", "ठ": "t", "ड": "d", "ढ": "d", "ण": "n",
    "त": "t", "थ": "t", "द": "d", "ध": "d", "न": "n", "प": "p", "फ": "p", "ब": "b", "भ": "b", "म": "m", "य": "y", "र": "r", "ल": "l", "ळ": "l", "व": "v",
    "श": "s", "ष": "s", "स": "s", "ह": "h", "ं": "n", "ँ": "n", "ः": "h",
    "w": "v", "z": "j", "q": "k", "f": "p", "x": "ks",
}
#: Letters that sound as several; the others map one to one.
SYLLABLES = {letter: sound for letter, sound in SOUNDS.items() if len(sound) > 1}
LETTERS = {letter: sound for letter, sound in SOUNDS.items() if len(sound) == 1}
# Fixed value: marks that sound as nothing and don't split a word.
SILENT = "़्ऽ॑-॔‌‍̀-ͯ"
_SILENT_MARKS = [chr(c) for c in range(0x300, 0xA00) if re.match(f"[{SILENT}]", chr(c))] + ["\u200c", "\u200d"]
# Fixed value: white space as browsers define it.
WHITE = "\t-\r    -     　﻿"

DEVANAGARI_DIGITS = "०१२३४५६७८९"
ASCII_DIGITS = "0123456789"


def _composed(low: int, high: int, keep) -> dict[str, str]:
    """Characters of a range that decompose, with their base, where ``keep(parts)`` says so."""
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(low, high)}
    return {c: p[0] for c, p in parts.items() if len(p) > 1 and keep(p)}


#: Devanagari letters that hold a nukta, and accented Latin letters, with the bare letter.
NUKTA_LETTERS = _composed(0x900, 0x980, lambda p: "़" in p)
ACCENTED = _composed(0xC0, 0x250, lambda p: p[0].isascii() and p[0].isalpha())


def _swap(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, DEVANAGARI_DIGITS, ASCII_DIGITS)


def squeeze(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WHITE}]+", " "))


def strip_white(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def nfc(c: Column) -> Column:
    """Unicode NFC for any script; Spark has no function for it."""
    @F.pandas_udf("string")
    def normalised(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return normalised(c)


def normalise(c: Column) -> Column:
    """Joiners and nukta dropped, chandrabindu as anusvara, white space squeezed; null as ''.

    Takes NFC text (see ``nfc``); letters composed with a nukta lose it too.
    """
    bare = F.regexp_replace(_swap(F.coalesce(c, F.lit("")), NUKTA_LETTERS), "[‌‍़]", "")
    return squeeze(F.translate(bare, "ँ", "ं"))


def _heard() -> dict[str, str]:
    """What becomes of each character once syllables are written out: its sound, or nothing ('a' is never heard)."""
    bare = {a: b for a, b in {**NUKTA_LETTERS, **ACCENTED}.items() if a == a.lower()}
    digits = dict(zip(DEVANAGARI_DIGITS, ASCII_DIGITS, strict=True))
    sounds = {**LETTERS, **digits, "a": "a"}
    found = {**sounds, **{a: sounds.get(b, b) for a, b in bare.items()}, **dict.fromkeys(_SILENT_MARKS, "")}
    return {a: b.replace("a", "") for a, b in found.items()}


def phonetic_key(c: Column) -> Column:
    """The skeleton by which spellings of one name agree across scripts.

    Texts without Devanagari skip its own rules, ASCII ones the letter map too.
    """
    s = F.lower(F.coalesce(c, F.lit("")))
    marks = {**NUKTA_LETTERS, **dict.fromkeys(_SILENT_MARKS, "")}
    devanagari = _swap(s, dict(sorted(marks.items(), key=lambda m: not m[1])))
    devanagari = F.regexp_replace(devanagari, "[ंँ](?=ह)", "ng")
    for letter, sound in SYLLABLES.items():
        if not letter.isascii():
            devanagari = F.replace(devanagari, F.lit(letter), F.lit(sound))
    heard = _heard()
    letters = F.replace(F.when(has_devanagari(s), devanagari).otherwise(s), F.lit("x"), F.lit("ks"))
    letters = _swap(letters, dict(sorted(heard.items(), key=lambda m: not m[1])))
    plain = F.replace(s, F.lit("x"), F.lit("ks"))
    for letter, sound in heard.items():
        if letter.isascii():
            plain = F.replace(plain, F.lit(letter), F.lit(sound))
    s = F.when(F.length(s) == F.octet_length(s), plain).otherwise(letters)
    s = F.ltrim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    s = F.replace(F.replace(s, F.lit("ee"), F.lit("i")), F.lit("oo"), F.lit("u"))
    s = F.regexp_replace(s, "(?<=[kgcjtdpbs])h+", "")
    s = F.replace(F.replace(s, F.lit("mp"), F.lit("np")), F.lit("mb"), F.lit("nb"))
    s = F.regexp_replace(s, "y(?= |$)", "i")
    return F.rtrim(F.regexp_replace(s, "([a-z])(?=\\1)", ""))


def code_key(c: Column) -> Column:
    """Letters a-z and digits alone; A-Z lower-cased, Devanagari digits folded."""
    lower = F.translate(ascii_digits(F.coalesce(c.cast("string"), F.lit(""))), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(lower, "[^a-z0-9]", "")


def key_part(c: Column) -> Column:
    """Digits without leading zeros, other text trimmed, null as ''."""
    s = strip_white(ascii_digits(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(s.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.ltrim(s, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(s)


def voter_key(ward: Column, serial: Column) -> Column:
    return F.concat_ws(":", key_part(ward), key_part(serial))


def parse_ward_serial(c: Column) -> Column:
    """struct<ward, serial> of text like ' 3 / 145 ', else null."""
    pattern = f"^[{WHITE}]*([0-9]+)[{WHITE}]*/[{WHITE}]*([0-9]+)[{WHITE}]*$"
    s = ascii_digits(c)
    part = lambda k: F.regexp_extract(s, pattern, k).try_cast("bigint")
    return F.when(s.rlike(pattern), F.struct(part(1).alias("ward"), part(2).alias("serial")))


def house_key(c: Column) -> Column:
    """House numbers that are spelt differently but are one house agree."""
    s = strip_white(ascii_digits(F.coalesce(c, F.lit(""))))
    return F.lower(F.regexp_replace(s, f"[{WHITE}]*([/-])[{WHITE}]*", "$1"))


def phone(c: Column) -> Column:
    """Ten digits after spaces and one leading +91 or 0, else null."""
    s = F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), "^(\\+91|0)", "")
    return F.when(s.rlike("^[0-9]{10}$"), s)


def international_phone(c: Column) -> Column:
    """'+' and the digits of a number that can be dialled from abroad, else null."""
    s = F.regexp_replace(ascii_digits(c), f"[{WHITE}().-]", "")
    s = F.regexp_replace(s, "^00", "+")
    mobile = F.regexp_extract(s, "^(?:0|91)?([6-9][0-9]{9})$", 1)
    return F.when(mobile != "", F.concat(F.lit("+91"), mobile)).when(s.rlike("^\\+[1-9][0-9]{7,14}$"), s)


def whole_number(c: Column) -> Column:
    """A count in ASCII or Devanagari digits up to 2**53 - 1, else null."""
    s = strip_white(ascii_digits(c))
    n = F.when(s.rlike("^[0-9]+$"), s).try_cast("bigint")
    return F.when(n <= (1 << 53) - 1, n)


def team_tag(c: Column) -> Column:
    """The id itself if it fits a message, else 16 hex digits of its hash; '' without one."""
    s = strip_white(F.coalesce(c, F.lit("")))
    return F.when(s.rlike("^[A-Za-z0-9_-]{1,16}$") | (s == ""), s).otherwise(F.substring(F.sha2(F.encode(s, "UTF-8"), 256), 1, 16))


# What names of each kind of body contain.
ZILLA = r"(?i)\bZILLA\s*PARISHAD\b"
URBAN = r"(?i)\bNAGAR\s*(PALIKA|PARISHAD|NIGAM)\b|\bNAGARPALIKA\b|\bMUNICIPAL\b|\bCORPORATION\b|\bMUNICIPALITY\b"
RURAL = r"(?i)\bPANCHAYAT\s*SAMIT"


def entry_kind(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    return F.when(s.rlike(ZILLA), "zillaParishad").when(s.rlike(URBAN), "urban").when(s.rlike(RURAL), "rural").otherwise("other")


def samiti_name(c: Column) -> Column:
    """The name without 'Panchayat Samiti' at its end; the whole name if nothing else is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(c, r"(?i)\s*PANCHAYAT\s*SAMITI\s*$", "")), F.lit("")), c)


def quoted(c: Column) -> Column:
    """Percent-encoding of all but A-Z, a-z, 0-9 and ``-._~``."""
    s = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def ward_url(base: str, samiti: Column, name: Column, ward: Column) -> Column:
    return F.concat(F.lit(base), F.lit("/"), samiti.cast("string"), F.lit("/"), quoted(F.upper(name)), F.lit("-Ward%20No-"), F.lpad(ward.cast("string"), 3, "0"), F.lit(".pdf"))


# Where ward rolls are published.
ROLL_HOST = "esuchiroll.rajasthan.gov.in"
ROLL_PATH = "/Publication_PDF_2026/PRI/(?:Final|Supplement)/[0-9]+/((?:[A-Z0-9._~-]|%[0-9A-F]{2})+)-Ward%20No-[0-9]{3}\\.pdf"


def roll_url_allowed(c: Column, host: str = ROLL_HOST, path: str = ROLL_PATH) -> Column:
    """Exactly an https URL of a ward roll, its name in canonical encoding, with no port, user, query or fragment."""
    pattern = f"^https://{host.replace('.', chr(92) + '.')}{path}$"
    encoded = F.regexp_extract(c, pattern, 1)
    name = F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    fine = name.rlike("^[\\x20-\\x7e]+$") & ~name.rlike("[a-z/\\\\]") & (quoted(name) == encoded)
    return F.coalesce(c.rlike(pattern) & ~encoded.isin(".", "..") & fine, F.lit(False))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def has_devanagari(c: Column) -> Column:
    return c.rlike("[ऀ-ॿ]")


ROUTE = "#/voter/"


def voter_route(c: Column) -> Column:
    """struct<ward, serial> of an address '#/voter/<ward>/<serial>', else null."""
    pattern = "^#/voter/([^/]+)/([0-9]+)/?$"
    ward = strip_white(F.try_url_decode(F.replace(F.regexp_extract(c, pattern, 1), F.lit("+"), F.lit("%2B"))))
    serial = F.regexp_extract(c, pattern, 2).try_cast("bigint")
    return F.when(c.rlike(pattern) & (ward != "") & ~ward.contains("/"), F.struct(key_part(ward).alias("ward"), serial.alias("serial")))


def voter_address(ward: Column, serial: Column) -> Column:
    return F.concat(F.lit(ROUTE), quoted(key_part(ward)), F.lit("/"), serial.cast("bigint").cast("string"))
