import json
import os

import pytest
from pyspark.sql import functions as F

from selvedge.llm.formatting_copies import Ledger, canonical_json, canonical_object, canonical_text, copies_of, delivery_ledger, keyed, merge_ledgers, run_deliveries
from selvedge.session import materialize


def test_objects():
    a = {"x": "Hello, World!", "s": {"b": 1, "a": "u-v"}}
    b = {"s": {"a": "U V", "b": 1}, "x": "hello world"}
    assert canonical_object(a) == canonical_object(b)
    for other in ({"x": "Hello, World!"}, a | {"s": {"b": "1", "a": "u-v"}}, a | {"y": ""}, {"x": "HelloWorld s", "s": {"b": 1, "a": "u-v"}}):
        assert canonical_object(other) != canonical_object(a)
    assert canonical_object({"a": "bc"}) != canonical_object({"ab": "c"})


def table_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("key", F.lit("clash"))
    return materialize(keyed(df, "t", "id", canonical_text(F.col("text"))))


def test_copies(spark):
    texts = ["Straße A", "STRASSE a!", None, "...", "", "other", " \n", None, "strasse-a", "x" * 300_000, "X" * 300_000 + "."]
    rows = table_of(spark, texts)
    got = {(r.keep_id, r.copy_id) for r in copies_of(rows, run_deliveries([rows]), rows.count()).collect()}
    assert got == {(0, 1), (0, 8), (3, 4), (3, 6), (9, 10)}


def test_ledger_is_incremental(spark):
    rows = table_of(spark, [f"t{k % 7}" for k in range(60)])
    parts = [rows.where("id >= 40"), rows.where("id < 5"), rows.where("id between 5 and 39")]
    plain = lambda df: {(bytes(r.key), r.copies, r.keep_id, r.bucket) for r in df.collect()}
    assert plain(run_deliveries(parts)) == plain(delivery_ledger(rows))
    empty = rows.limit(0)
    assert plain(merge_ledgers(delivery_ledger(empty), delivery_ledger(rows))) == plain(delivery_ledger(rows))
    assert run_deliveries([empty]).count() == 0


def test_hot_keys_lose_nothing(spark):
    rows = table_of(spark, ["hot"] * 4000 + [f"c{k // 2}" for k in range(100)])
    got = copies_of(rows, run_deliveries([rows]), rows.count()).groupBy("keep_id").count().collect()
    assert {(r.keep_id, r["count"]) for r in got} == {(0, 3999)} | {(4000 + 2 * k, 1) for k in range(50)}


def test_payloads(spark):
    payloads = ['{"a": "X y", "b": [1, 2]}', ' {"b":[1,2] , "a":"x-Y"}', '{"a": "X y", "b": [2, 1]}', '{"a": "X y"', "[1]", None, '{"a": NaN}', '"s"']
    df = spark.createDataFrame([(p,) for p in payloads], "p string").select(canonical_json("p").alias("c"))
    got = [r.c for r in df.collect()]
    assert got[0] == got[1] != got[2] and got[3:] == [None] * 5
    assert json.loads(payloads[0])


def files_of(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_a_delivery_touches_only_its_buckets(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.read().count() == 0 and ledger.manifest()["version"] == 0
    rows = table_of(spark, [f"t{k % 150}" for k in range(400)])
    first = ledger.merge(rows.where("id < 300"), "monday")
    before, folders = files_of(tmp_path), ledger.manifest()["buckets"]
    later = rows.where("id >= 300 and pmod(xxhash64(key), 64) < 9")
    touched = ledger.merge(later, "tuesday")
    assert first == sorted(map(int, folders)) and 0 < len(touched) < len(first)
    assert {p: t for p, t in files_of(tmp_path).items() if p in before} == before  # nothing is rewritten in place
    now = ledger.manifest()["buckets"]
    assert {int(k) for k in now if now[k] != folders.get(k)} == set(touched)
    plain = lambda df: {(bytes(r.key), r.copies, r.keep_id, r.bucket) for r in df.collect()}
    assert plain(ledger.read()) == plain(delivery_ledger(rows.where("id < 300").unionAll(later)))
    assert {r.bucket for r in ledger.read(touched).collect()} == set(touched)


def test_a_delivery_counts_once_and_a_lost_race_changes_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = table_of(spark, ["a", "A.", "b"])
    ledger.merge(rows, "monday")
    assert ledger.merge(rows, "monday") == [] and ledger.manifest()["version"] == 1
    with pytest.raises(RuntimeError):
        ledger._publish(1, "{}")
    assert sorted((r.copies, r.keep_id) for r in ledger.read().collect()) == [(1, 2), (2, 0)]
    assert ledger.merge(rows.limit(0), "empty") == [] and ledger.read().count() == 2


def test_objects_keep_accents_as_texts_do():
    assert canonical_object({"a": "é x"}) != canonical_object({"a": "e x"})
