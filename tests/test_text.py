"""Text functions against literal cases."""

from pyspark.sql import functions as F

from wardloom.functions import text as X


def values(spark, f, cases):
    """f over the cases' inputs, in order."""
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("s"))).collect()]


def test_spellings_of_one_name_share_a_key(spark):
    pairs = [("रामलाल", "Ramlal"), ("सिंह", "Singh"), ("चौधरी", "Chaudhary"), ("चंपा", "Champa"), ("भगवान", "Bhagwan"), ("शर्मा", "Sharma"), ("कृष्ण", "Krishn"), ("लक्ष्मी", "Laxmi"), ("ज़ाकिर", "Zakir"), ("É cole", "e cole"), ("पूजा", "pooja"), ("पूजा", "puja"), ("लक्ष्मी", "lakshmi"), ("अभिषेक", "abhishek"), ("कमला", "kamla"), ("गीता", "geeta"), ("श्याम", "shyam"), ("संजय", "sanjay"), ("अमित", "amit")]
    left, right = values(spark, X.phonetic_key, [a for a, _ in pairs]), values(spark, X.phonetic_key, [b for _, b in pairs])
    assert [(a, b) for (a, b), x, y in zip(pairs, left, right) if x != y] == []


def test_every_letter_sounds_as_it_should(spark):
    """Literal keys for every group of letters, so that a wrong letter in the table shows."""
    cases = {"अआइईउऊ": "iu", "ए ऐ ऍ ऎ": "e i e e", "ओ औ ऑ ऒ": "o u o o", "ऋ ॠ ऌ ॐ": "ri ri li om", "कखगघङ": "kgn", "चछजझञ": "cjn", "टठडढण": "tdn", "तथदधन": "tdn", "पफबभम": "pbm", "यरलळव": "yrlv", "शषसह": "s", "कंहक": "kngk", "नः": "nh", "कृ कॄ": "kri kri", "wzqfx": "vjkpks"}
    got = values(spark, X.phonetic_key, list(cases))
    assert dict(zip(cases, got)) == cases


def test_phonetic_key_edges(spark):
    assert values(spark, X.phonetic_key, [None, "", "aaa", "  --  ", "Meena  Devi", "geeta", "mp mb may", "x1"]) == ["", "", "", "", "min devi".replace("devi", "devi"), "git", "np nb mi", "ks1"]


def test_normalise(spark):
    assert values(spark, X.normalise, [None, " a \t b ", "ज़", "ज़", "क‍ष", "चाँद", "a b"]) == ["", "a b", "ज", "ज", "कष", "चांद", "a b"]


def test_keys(spark):
    assert values(spark, X.code_key, ["RJ/०१२-ab", None, "É9"]) == ["rj012ab", "", "9"]
    assert values(spark, X.key_part, ["007", " ०३ ", "A1 ", None, "000"]) == ["7", "3", "A1", "", "0"]
    assert values(spark, X.house_key, ["12 / A", "१२/a", " 12A ", "12 A", None, "3 - 4"]) == ["12/a", "12/a", "12a", "12 a", "", "3-4"]
    assert values(spark, lambda c: X.parse_ward_serial(c), [" 3 / 145 ", "३/१४५", "3/", "abc", "145", None]) == [(3, 145), (3, 145), None, None, None, None]


def test_phones_and_counts(spark):
    assert values(spark, X.phone, ["98765 43210", "+919876543210", "09876543210", "123", "98765432101", None]) == ["9876543210", "9876543210", "9876543210", None, None, None]
    assert values(spark, X.international_phone, ["98765 43210", "0091-9876543210", "919876543210", "+1 (415) 555-0100", "12345", None]) == ["+919876543210", "+919876543210", "+919876543210", "+14155550100", None, None]
    assert values(spark, X.whole_number, ["५", " 12 ", "-1", "1.5", "9007199254740992", "99999999999999999999", ""]) == [5, 12, None, None, None, None, None]


def test_tags_slugs_kinds(spark):
    import hashlib

    long = "a name with spaces"
    assert values(spark, X.team_tag, ["team-1", long, "", None]) == ["team-1", hashlib.sha256(long.encode()).hexdigest()[:16], "", ""]
    assert values(spark, X.slug, ["Sawai Madhopur!", "--A--"]) == ["sawai-madhopur", "a"]
    assert values(spark, X.entry_kind, ["Zilla Parishad X", "NAGAR PALIKA Y", "Panchayat Samiti Z", "", None]) == ["zillaParishad", "urban", "rural", "other", "other"]


def test_roll_urls(spark):
    good = f"https://{X.ROLL_HOST}/Publication_PDF_2026/PRI/Final/12/A%20B-Ward%20No-003.pdf"
    bad = [good + "?x", good.replace("https", "http"), good.replace("A%20B", "a%20b"), good.replace("A%20B", "A%41B"), good.replace("-003", "-03"), None, good.replace("/12/", "/../")]
    assert values(spark, X.roll_url_allowed, [good, *bad]) == [True] + [False] * len(bad)


def test_routes(spark):
    assert values(spark, X.voter_route, ["#/voter/03/145", "#/voter/A%20b/7/", "#/voter/3", "#/voter/%2F/1", "#/other"]) == [("3", 145), ("A b", 7), None, None, None]
    assert spark.range(1).select(X.voter_address(F.lit("03"), F.lit(5))).first()[0] == "#/voter/3/5"


def test_nfc(spark):
    assert values(spark, X.nfc, ["é", None]) == ["é", None]
