import pytest
from pyspark.sql import functions as F

from selvedge.operators import artifacts, rendering

RECORDS = "record_id string, split string, task_type string, instruction string, response string"
ROWS = [("a", "train", "qa", "Q1", "A1"), ("b", "validation", "qa", "Q2", "A2"), ("c", "test", "qa", "Q3", "A3"), ("d", "train", "other", "Q", "A")]


def rendered(df):
    return rendering.render_qa(df, "qa", "S")


def test_test_records_stay_apart(spark):
    df = spark.createDataFrame(ROWS, RECORDS)
    assert {r.record_id for r in rendered(df).collect()} == {"a", "b"}
    assert [r.record_id for r in rendering.render_qa(df, "qa", "S", held_out=True).collect()] == ["c"]


def test_chat_text_and_end_token(spark):
    df = rendered(spark.createDataFrame(ROWS[:1], RECORDS)).select(rendering.chat_text(F.col("messages")).alias("t"))
    want = "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nQ1<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\nA1<|im_end|>\n"
    r = df.select("t", rendering.with_end_token(F.col("t"), "<E>").alias("e"), rendering.with_end_token(F.concat(F.lit("<E>"), "t"), "<E>").alias("bad")).first()
    assert r.t == want and r.e == want[: -len("<|im_end|>\n")] + "<E>" and r.bad is None
    p, c = rendering.prompt_and_completion(F.lit("abcde"), F.lit("abc"))
    _, none = rendering.prompt_and_completion(F.lit("abcde"), F.lit("x"))
    r = df.select(p.alias("p"), c.alias("c"), none.alias("n")).first()
    assert (r.p, r.c, r.n) == ("abc", "de", None)


def test_labels(spark):
    df = spark.createDataFrame([([1, 2, 3], 2), ([1, 2], 2)], "ids array<int>, n int")
    labels = rendering.completion_labels(F.col("ids"), F.col("n"))
    got = df.select(labels.alias("l"), rendering.labels_are_valid(F.col("ids"), labels, F.col("n")).alias("v")).collect()
    assert [(r.l, r.v) for r in got] == [([-100, -100, 3], True), ([-100, -100], False)]


def test_canonical_records_and_json_turns(spark):
    anchors = spark.createDataFrame([("s", "1", "loc", "en", "q", "a")], "source string, source_record_id string, source_locator string, language string, question string, answer string")
    r = rendering.canonical_records(anchors, "sft-source-", {"task_type": "qa"}, ["dedup"]).first()
    assert r.record_id.startswith("sft-source-") and len(r.record_id) == 35 and r.source.source_locator == "loc" and r.task_type == "qa"
    m = rendering.render_json_turns(spark.createDataFrame([("1", "x", None)], "record_id string, b string, a string"), "S", ["b", "a"], ["a"]).first().messages
    assert [x.content for x in m] == ["S", '{"a":null,"b":"x"}', '{"a":null}']


def test_rendered_violations(spark):
    good = rendered(spark.createDataFrame(ROWS, RECORDS))
    assert artifacts.rendered_violations(good).count() == 0
    bad = good.unionByName(good.where("record_id = 'a'")).unionByName(rendered(spark.createDataFrame([("e", "train", "qa", " ", None)], RECORDS)))
    assert {(r.record_id, r.reason) for r in artifacts.rendered_violations(bad).collect()} == {("a", "repeated_id"), ("e", "contents")}


def test_tampered_artifacts(spark):
    canonical = spark.createDataFrame(ROWS, RECORDS)
    good = rendered(canonical)
    assert artifacts.artifact_violations(canonical, good, rendered).count() == 0
    changed = rendered(spark.createDataFrame([("a", "train", "qa", "Q1", "other"), ("b", "train", "qa", "Q2", "A2"), ("z", "train", "qa", "Q", "A")], RECORDS))
    assert {(r.record_id, r.reason) for r in artifacts.artifact_violations(canonical, changed, rendered).collect()} == {("a", "content_drift"), ("b", "other_split"), ("z", "unexpected")}
    leaked = good.unionByName(rendering.render_qa(canonical, "qa", "S", held_out=True))
    assert {(r.record_id, r.reason) for r in artifacts.artifact_violations(canonical, leaked, rendered).collect()} == {("c", "unexpected")}
    assert [r.reason for r in artifacts.artifact_violations(canonical, good.where("record_id = 'a'"), rendered).collect()] == ["missing"]


def test_preference_sets(spark):
    rows = [("1", "validation", "P one", "x", "y"), ("2", "train", "p ONE", "x", "y"), ("3", "train", "Q", "Same.", "same"), ("4", "train", "held", "x", "y"), ("5", "train", " ", "x", "y"), ("6", "other", "R", "x", "y"), ("7", "train", "fine", "x", "y")]
    df = spark.createDataFrame(rows, "record_id string, split string, prompt string, chosen string, rejected string")
    from selvedge.functions.text import content_hash

    protected = spark.createDataFrame([("Held!",)], "t string").select(content_hash(F.col("t")).alias("h"))
    got = {(r.record_id, r.reason) for r in artifacts.preference_violations(df, protected, ["validation", "train"]).collect()}
    assert got == {("2", "repeated_prompt"), ("3", "identical_answers"), ("4", "protected_prompt"), ("5", "blank"), ("6", "split")}


def test_lists_pairs_and_digests(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, v bigint")
    assert [r.place for r in artifacts.listed_rows(df, "id", ["a"]).collect()] == [0]
    for ids in (["a", "a"], ["z"], ["b"]):
        with pytest.raises(ValueError):
            artifacts.listed_rows(df, "id", ids)
    pairs = artifacts.positional_pairs(df.select("v"), df.select(F.col("v").alias("w")), ["v"], [F.desc("w")]).collect()
    assert {(r.v, r.w) for r in pairs} == {(1, 3), (2, 2), (3, 1)}
    with pytest.raises(ValueError):
        artifacts.positional_pairs(df.select("v"), df.select(F.col("v").alias("w")).limit(1), ["v"], ["w"])
    digest = lambda d: artifacts.selection_digest(d, "id", ["v"]).first().selection_sha256
    assert digest(df) == digest(df.orderBy(F.desc("v"))) != digest(df.limit(2))


def test_gates_recomputation_and_reconciliation(spark):
    m = spark.createDataFrame([("x", "a", 0.5), ("x", "b", None), ("y", "a", 2.0)], "variant string, metric string, value double")
    got = {(r.variant, r.metric): r.passed for r in artifacts.threshold_checks(m, {"a": ("max", 1.0), "b": ("min", 0.0)}).collect()}
    assert got == {("x", "a"): True, ("x", "b"): False, ("y", "a"): False, ("y", "b"): False}
    new = spark.createDataFrame([("x", "a", 0.5), ("y", "a", 2.5), ("z", "a", 1.0)], "variant string, metric string, value double")
    got = {(r.variant, r.metric): r.changed for r in artifacts.recomputed(m, new, ["variant", "metric"], ["value"]).collect()}
    assert got == {("x", "b"): ["not_computed"], ("y", "a"): ["value"], ("z", "a"): ["unrecorded"]}
    log = spark.createDataFrame([("1", True), ("2", True), ("2", True), ("3", None)], "id string, ok boolean")
    expected = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("4",)], "id string")
    got = {r.id: r.reasons for r in artifacts.reconcile(expected, log, "id", {"privacy": F.col("ok")}).collect()}
    assert got == {"1": [], "2": ["repeated_entry"], "3": ["privacy"], "4": ["repeated_expected", "missing_entry"]}


def test_small_helpers(spark):
    log = spark.createDataFrame([("r", 1, 0.5, None), ("r", 2, None, 1.0), ("r", 3, 0.4, None)], "run string, step int, eval_loss double, lr double")
    assert artifacts.last_with(log, ["run"], "step", "eval_loss").first().step == 3
    df = spark.createDataFrame([("take 5 mg NEVER", ["b"]), (None, None)], "t string, done array<string>")
    got = df.select(artifacts.lexical_flags(F.col("t"), {"dose": [r"\d mg"], "never": ["(?i)never"]}).alias("f"), artifacts.pending_fields(F.col("done"), ["a", "b", "c", "d"], 2).alias("p")).collect()
    assert [(r.f, r.p) for r in got] == [(["dose", "never"], ["a", "c"]), ([], ["a", "b"])]
