import hashlib
import json
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from selvedge.functions import arrays, text


def one(spark, expr, schema, *values):
    return spark.createDataFrame([values], schema).select(expr.alias("x")).first().x


def test_normal_forms(spark):
    samples = ["Ünï-CODE  Straße", "ＦＵＬＬ ﬁne", "a_b ²", "", None, "ΣΑΣ"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = df.select(text.norm_fast(F.col("t")).alias("fast"), text.norm_exact("t").alias("exact")).collect()
    for s, r in zip(samples, got, strict=True):
        assert r.exact == (None if s is None else re.sub(r"\W+", "", unicodedata.normalize("NFKC", s).casefold()))
    assert got[0].fast == got[0].exact == "ünïcodestrasse"
    assert got[3].fast == "" and got[4].fast is None


def test_split_key_uses_lower_case_and_not_folding(spark):
    assert one(spark, text.norm_lower(F.col("t")), "t string", "Straße!") == "straße"


def test_hashes_and_keys(spark):
    assert one(spark, text.content_hash(F.col("t")), "t string", "  --- ") == ""
    assert one(spark, text.content_hash(F.col("t")), "t string", None) == ""
    want = hashlib.sha256(b"questiona").hexdigest()
    assert one(spark, text.content_hash(F.col("t")), "t string", "Question A?") == want
    assert one(spark, text.stable_key("42", F.col("n")), "n bigint", 7) == hashlib.sha256(b"42:7").hexdigest()
    assert one(spark, text.digest_int(F.lit("000000ff" + "0" * 56)), "n int", 1) == 255
    got = one(spark, text.canonical_json({"b": F.col("b"), "a": F.col("a")}), "a string, b string", None, "é")
    assert got == json.dumps({"a": None, "b": "é"}, ensure_ascii=False, separators=(",", ":"))


def test_patterns_count_like_python(spark):
    t = "call 415-555-0100 or (212) 555-0199, not 12345; me@x.example.org and A.B+c@y-z.example"
    assert one(spark, text.email_count(F.col("t")), "t string", t) == 2
    assert one(spark, text.phone_count(F.col("t")), "t string", t) == len(re.findall(text.PHONE, t)) == 2
    assert one(spark, text.placeholder_count(F.col("t")), "t string", "[NAME] of [CITY]") == 1


def test_truncation(spark):
    cut, flag = text.truncated(F.col("t"), 5)
    r = spark.createDataFrame([("abcd   xyz",), ("abc",), (None,)], "t string").select(cut.alias("c"), flag.alias("f")).collect()
    assert [(x.c, x.f) for x in r] == [("abcd", True), ("abc", False), (None, False)]


def test_malformed(spark):
    six = "one two three four five six "
    cases = {"&#x41; x": ["html_entity"], "see <PERSON>": ["placeholder"], six * 2: ["repeated_phrase"], "word " * 40 + "end": ["repeated_phrase", "likely_truncated"], "fine.": [], None: []}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.malformed_reasons(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases


def test_ascii_words_and_url(spark):
    assert one(spark, text.ascii_words("t"), "t string", " Élève\tœ  ﬁn ") == "eleve fin"
    assert one(spark, text.host_url(F.col("t"), "tunnel.example"), "t string", "at https://a-1.tunnel.example/x now") == "https://a-1.tunnel.example"


def grams(ids, n):
    g = [tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)]
    return (len(g) - len(set(g))) / max(1, len(g))


def test_ngram_repetition(spark):
    for ids in ([1, 2, 3, 4, 1, 2, 3, 4, 1], [1, 2], [], [5] * 9):
        assert abs(one(spark, arrays.repeated_ngram_fraction(F.col("a"), 4), "a array<int>", ids) - grams(ids, 4)) < 1e-12


def test_first_difference(spark):
    for a, b, want in (([1, 2], [1, 2], None), ([1, 2], [1, 3], 1), ([1, 2], [1, 2, 3], 2), ([], [1], 0), ([], [], None)):
        assert one(spark, arrays.first_difference(F.col("a"), F.col("b")), "a array<int>, b array<int>", a, b) == want


def test_maps(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": None}, {"a": 2.0, "c": None})], "m map<string,double>, n map<string,double>")
    r = df.select(arrays.any_value(F.col("m")).alias("v"), arrays.only_keys(F.col("m"), ["a"]).alias("k"), arrays.map_difference(F.col("m"), F.col("n")).alias("d")).first()
    assert r.v is True and r.k is False and r.d == ["a", "b", "c"]


def test_first_json_object():
    assert arrays.first_json_object('x {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}'
    assert arrays.first_json_object('{"a": "\\"}"}') == '{"a": "\\"}"}'
    assert arrays.first_json_object("{ open") is None and arrays.first_json_object(None) is None



def test_picks_and_suffixes(spark):
    df = spark.createDataFrame([(k,) for k in range(200)], "k bigint")
    got = df.select(text.pick_by_digest(F.col("k").cast("string"), ["a", "b", "c"]).alias("x"), text.pick_by_digest(F.col("k").cast("string"), ["a", "b", "c"], 8).alias("y")).collect()
    assert {r.x for r in got} == {"a", "b", "c"} and any(r.x != r.y for r in got)
    assert got[7].x == "abc"[int(hashlib.sha256(b"7").hexdigest()[:8], 16) % 3]
    assert one(spark, text.emails_with_suffix(F.col("t"), ["org"]), "t string", "a@b.org, c@d.local") == ["a@b.org"]
