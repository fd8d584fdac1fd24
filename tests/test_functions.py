"""Goldens of the text, address and string functions."""

import pytest
from pyspark.sql import functions as F

from erlink.functions import address, strsim, text
from erlink.operators.prepare import prepare


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, want",
    [("  Orelee's   Barbershop!! ", "orelee s barbershop"), ("राम मार्केटिंग", "राम मार्केटिंग"), (None, ""), ("a\tb", "ab"), ("Straße", "strasse"), ("ﬁne Ｃo", "fine co"), ("x​y", "xy")],
)
def test_normalized(raw, want):
    assert text.normalized(raw) == want


def test_normalize_name_udf(spark):
    assert one(spark, "  Orelee's   Barbershop!! ", text.normalize_name) == "orelee s barbershop"
    forms = one(spark, "École primaire", text.name_forms)
    assert (forms["norm"], forms["fold"]) == ("école primaire", "ecole primaire")


def test_folded():
    assert text.folded("École primaire") == "ecole primaire"


@pytest.mark.parametrize("raw, want", [("Best Bakery", "latin"), ("राम", "indic"), ("राम Best", "mixed"), ("123", "none"), ("Привет", "mixed"), ("", "none"), (None, "none")])
def test_script(spark, raw, want):
    assert one(spark, raw, text.script_of) == want


@pytest.mark.parametrize(
    "raw, rest, kind",
    [("b retail inc", "b retail", "inc"), ("international south consultants private ltd", "international south consultants", "ltd"), ("beque", "beque", ""), ("pvt ltd", "", "ltd"), ("incapable", "incapable", "")],
)
def test_suffix(spark, raw, rest, kind):
    assert one(spark, raw, text.strip_suffix) == rest and one(spark, raw, text.suffix_class) == kind


def test_tokens(spark):
    assert one(spark, "the best bakery and cafe a", text.name_tokens) == ["best", "bakery", "cafe"]
    assert one(spark, "b a b  the", text.idf_tokens) == ["a", "b", "the"]


def test_romanized():
    assert text.romanized("Plain Name") == "plain name" and text.romanized("") == ""
    assert text.romanized("राम") == "rAma" and text.romanized("मार्केट").isascii()
    assert text.romanized("sun राम").startswith("sun ") and text.romanized("ராம்").isascii()


def parsed(spark, raw, country):
    df = spark.createDataFrame([(raw, text.normalized(raw), country)], "a string, n string, c string")
    return df.select(address.parse_address(F.col("a"), F.col("n"), F.col("c")).alias("p")).first()["p"]


def test_addresses(spark):
    p = parsed(spark, "1795 Main St, Raleigh, NC 27601-1234", "US")
    assert (p["house_no"], p["state_key"], p["postal"]) == ("1795", "north carolina", "27601") and "st" not in p["street_tokens"] and "1795" not in p["street_tokens"]
    p = parsed(spark, "Near Lake, Bhopal, Madhya Pradesh 462033", "India")
    assert (p["postal"], p["state_key"], p["landmark_flag"], p["house_no"]) == ("462033", "madhya pradesh", True, "")
    assert parsed(spark, "12 rue X, Bordeaux 33000", "France")["postal"] == "33000"
    p = parsed(spark, "  ", "US")
    assert p["addr_missing"] and p["street_tokens"] == [] and p["state_key"] == ""
    assert parsed(spark, None, None)["addr_missing"]
    assert parsed(spark, "1 rue de la paix", "France")["state_key"] == "delaware"
    assert parsed(spark, "a b c d e f g h", "US")["city_tokens"] == list("cdefgh")


def test_scorers():
    assert strsim.ratio("", "") == 100 and strsim.ratio("abc", "abd") == pytest.approx(200 * 2 / 6) and strsim.qratio("", "") == 0
    assert strsim.lcs_length("abcbdab", "bdcaba") == 4
    assert strsim.partial_ratio("abc", "xxabcxx") == 100 and strsim.partial_ratio("abcd", "xxxab") == pytest.approx(200 * 2 / 6)
    assert strsim.token_sort_ratio("b a", "a b") == 100 and strsim.token_set_ratio("a b", "a b c") == 100 and strsim.token_set_ratio("", "a") == 0
    assert strsim.wratio("a b", "b a") == 95 and strsim.wratio("", "a") == 0
    assert strsim.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611111) and strsim.jaro_winkler("", "") == 1 and strsim.jaro_winkler("a", "b") == 0


def test_prepare(spark):
    raw = spark.createDataFrame([("S1-1", "The Best Bakery Inc", "10 Main St, Austin, TX", " US "), ("S2-1", "", "", "")], "entity_id string, business_name string, business_address string, country string")
    rows = {r["entity_id"]: r for r in prepare(raw).collect()}
    r = rows["S1-1"]
    assert (r["name_norm"], r["name_tokens"], r["suffix_class"], r["name_stripped"], r["house_no"], r["state_key"], r["country"]) == ("the best bakery inc", ["best", "bakery", "inc"], "inc", "the best bakery", "10", "texas", "us")
    assert rows["S2-1"]["addr_raw_missing"] and rows["S2-1"]["name_idf_tokens"] == []
