import json

import pytest
from pyspark.sql import functions as F

from selvedge.functions.text import multiset_digest
from selvedge.operators.keyed import look_up
from selvedge.operators.privacy import anonymized, findings
from selvedge.session import ContractViolation, materialize, shared_dir
from selvedge.sources import readers


def test_bad_lines_are_named_across_blocks(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    lines = [f'{{"n": {k}, "text": "{"x" * 200}"}}' for k in range(2000)]
    for k in (0, 700, 1999):
        lines[k] = "{broken"
    lines[5] = "  "
    (folder / "a.jsonl").write_text("\n".join(lines))
    (folder / "b.jsonl").write_text('{"n": 1}\n[1]\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        got = {(r.file.rsplit("/", 1)[-1], r.line) for r in readers.bad_json_lines(spark, str(folder)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.jsonl", 1), ("a.jsonl", 701), ("a.jsonl", 2000), ("b.jsonl", 2)}
    with pytest.raises(ContractViolation, match="b.jsonl"):
        readers.require_json_lines(spark, str(folder / "b.jsonl"))


def test_a_detector_stands_beside_the_patterns(spark):
    places = lambda t: [(t.index("Lyon"), t.index("Lyon") + 4, "LOCATION")] if "Lyon" in t else []
    df = spark.createDataFrame([(1, "From Lyon, write a@b.org"), (2, "<PERSON> wrote a@b.org"), (3, ""), (4, None)], "id bigint, t string")
    got = {r.id: r for r in anonymized(df, "id", ["t"], ["EMAIL_ADDRESS", "LOCATION"], places).collect()}
    assert got[1].text == "From <LOCATION>, write <EMAIL_ADDRESS>" and (got[1].found, got[1].left, got[1].status) == (2, 0, "passed")
    assert got[2].text == "<PERSON> wrote <EMAIL_ADDRESS>" and got[3].status == got[4].status == "empty" and got[4].text is None
    assert {(r.id, r.entity) for r in findings(df, "id", ["t"], detector=places).collect()} == {(1, "LOCATION"), (1, "EMAIL_ADDRESS"), (2, "EMAIL_ADDRESS")}
    only_own = lambda t: [(k, k + 8, "PERSON") for k in range(len(t)) if t.startswith("<PERSON>", k)]
    looked = {r.id: (r.found, r.left) for r in anonymized(df, "id", ["t"], ["PERSON"], only_own).collect()}
    assert looked[2] == (1, 0)  # its own placeholder is left alone


def test_patient_names_and_references_in_both_languages(spark):
    texts = ["my name is Anna Smith-Jones.", "Je m'appelle Hélène Dupont.", "dossier n° AB-1234 ouvert", "no name"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = {(r.id, r.entity): r.span for r in findings(df, "id", ["t"]).collect()}
    assert got[0, "PATIENT_NAME"] == "my name is Anna Smith-Jones" and got[1, "PATIENT_NAME"] == "Je m'appelle Hélène Dupont" and got[2, "PATIENT_REFERENCE"] == "dossier n° AB-1234" and len(got) == 3


def test_set_digest_ignores_order_but_not_repeats(spark):
    digest = lambda *xs: spark.createDataFrame([(x,) for x in xs], "t string").select(F.sha2("t", 256).alias("d")).agg(multiset_digest(F.col("d")).alias("x")).first().x
    assert digest("a", "b", "c") == digest("c", "a", "b") != digest("a", "b", "b") and digest("a") != digest("a", "a")


def test_lookup_of_hot_keys_is_an_inner_join(spark):
    rows = materialize(spark.range(3000).select(F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id"))
    facts = spark.createDataFrame([("hot", 1), ("k1500", 2), ("k9999", 3)], "k string, v int")
    assert sorted((r.k, r.v) for r in look_up(rows, facts, ["k"]).groupBy("k", "v").count().collect()) == [("hot", 1), ("k1500", 2)]
    assert look_up(rows, facts, ["k"]).count() == 1001 and look_up(materialize(rows.limit(0)), facts, ["k"]).count() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


@pytest.mark.parametrize("chunk", [5, 64, 1 << 20])
def test_json_arrays_are_streamed_into_lines(spark, tmp_path, chunk):
    rows = [{"a": k, "t": "é[{]}\\\" ,\n" * (k % 4)} for k in range(40)]
    (tmp_path / "x.json").write_text(json.dumps(rows, ensure_ascii=chunk > 5, indent=None if chunk == 64 else 1), encoding="utf-8")
    out = tmp_path / f"out{chunk}.txt"
    assert readers.json_array_lines(spark, str(tmp_path / "x.json"), str(out), chunk) == 40
    got = [line.split("\t", 1) for line in out.read_text(encoding="utf-8").splitlines()]
    assert [int(n) for n, _ in got] == list(range(40)) and [json.loads(t) for _, t in got] == rows
    (tmp_path / "empty.json").write_text("[]")
    assert readers.json_array_lines(spark, str(tmp_path / "empty.json"), str(tmp_path / f"e{chunk}"), chunk) == 0
    for k, bad in enumerate(('{"a": 1}', '[{"a": 1}, {"a"')):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            readers.json_array_lines(spark, str(tmp_path / "bad.json"), str(tmp_path / f"b{chunk}{k}"), chunk)
