import hashlib
import random

import pytest
from pyspark.sql import functions as F

from selvedge.operators import metrics, privacy, ranking, review, selection, splits, validation
from selvedge.operators.components import connected_components
from selvedge.operators.keyed import cross_group_overlap, spanning_keys, with_group_facts
from selvedge.session import ContractViolation, discard, materialize, require_empty


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == union_find(edges)


def test_components_of_nothing_loops_and_nulls(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    got = connected_components(spark.createDataFrame([(1, 1), (None, 2), (3, 4), (3, 4)], "a bigint, b bigint")).collect()
    assert {(x.node, x.component) for x in got} == {(1, 1), (3, 3), (4, 3)}


def test_group_facts_with_hot_and_null_keys(spark):
    rows = [("hot", i) for i in range(3000)] + [("a", 1), ("a", 2), (None, 7), (None, 9)]
    df = materialize(spark.createDataFrame(rows, "k string, v bigint"))
    got = with_group_facts(df, ["k"], {"first": F.min("v"), "n": F.count(F.lit(1))}).collect()
    assert len(got) == len(rows)
    assert {(r.k, r["first"], r.n) for r in got} == {("hot", 0, 3000), ("a", 1, 2), (None, 7, 2)}
    discard(df)


def test_tables_are_materialised_and_discarded(spark):
    import os

    from selvedge.session import _made, discard_all

    df = materialize(spark.range(5))
    path = _made[-1]
    assert df.count() == 5 and os.path.isdir(path)
    assert discard_all(spark) >= 1 and not os.path.isdir(path) and not _made


def test_overlap_and_spanning_keys(spark):
    df = spark.createDataFrame([("train", "x"), ("test", "x"), ("dev", "x"), ("dev", "y"), ("train", "y"), ("test", ""), ("train", "")], "g string, k string")
    assert {(r.left_group, r.right_group, r.shared) for r in cross_group_overlap(df, "g", "k").collect()} == {("dev", "test", 1), ("dev", "train", 2), ("test", "train", 1)}
    assert {(r.k, r.groups) for r in spanning_keys(df, "k", "g").collect()} == {("x", 3), ("y", 2), ("", 2)}


def test_global_and_group_rank(spark):
    r = random.Random(4)
    rows = [(r.choice("abc"), r.random(), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, id bigint")
    got = {x.id: x["rank"] for x in ranking.global_rank(df, ["v", "id"]).collect()}
    assert got == {row[2]: k for k, row in enumerate(sorted(rows, key=lambda x: (x[1], x[2])))}
    within = {x.id: x["rank"] for x in ranking.rank_within(df, "g", ["v", "id"]).collect()}
    for g in "abc":
        for k, row in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2]))):
            assert within[row[2]] == k
    assert ranking.global_rank(df.limit(0), ["v"]).count() == 0


def test_samples(spark):
    df = spark.createDataFrame([("b", 2), ("a", 9), ("a", 1), ("c", 5), ("a", 3)], "g string, v bigint")
    assert [r.v for r in ranking.smallest(df, ["v"], 2).collect()] == [1, 2]
    assert {(r.g, r.v, r["rank"]) for r in ranking.smallest_per_group(df, ["g"], ["v"], 2).collect()} == {("a", 1, 1), ("a", 3, 2), ("b", 2, 1), ("c", 5, 1)}
    assert [(r.turn, r.g) for r in ranking.round_robin(df, "g", ["v"], 4).orderBy("turn", "g").collect()] == [(1, "a"), (1, "b"), (1, "c"), (2, "a")]


def test_largest_remainder():
    assert ranking.largest_remainder([("a", 50), ("b", 30), ("c", 20)], 7) == {"a": 4, "b": 2, "c": 1}
    assert ranking.largest_remainder([("a", 1), ("b", 1)], 1) == {"a": 1, "b": 0}
    with pytest.raises(ValueError):
        ranking.largest_remainder([("a", 1)], 2)


def test_stratified_takes_whole_quota(spark):
    df = spark.createDataFrame([(g, k) for g, n in (("x", 60), ("y", 30), (None, 5), ("z", 10)) for k in range(n)], "g string, v bigint")
    got = ranking.stratified(df, "g", ["v"], 20).groupBy("g").count().collect()
    assert {(r.g, r["count"]) for r in got} == {("x", 12), ("y", 6), ("z", 2)}


def sequential(rows, seen1=frozenset(), seen2=frozenset(), quota=None):
    seen1, seen2, out = set(seen1), set(seen2), []
    for o, i, a, b in sorted(rows):
        if a in seen1 or b in seen2:
            continue
        seen1.add(a)
        seen2.add(b)
        out.append((o, i, a, b))
        if quota and len(out) == quota:
            break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_is_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    rows = [(f"{r.randint(0, 30):02d}", k, f"q{r.randint(0, 12)}", f"m{r.randint(0, 12)}") for k in range(40)]
    df = spark.createDataFrame(rows, "ord string, id bigint, k1 string, k2 string")
    assert sorted(map(tuple, selection.greedy_by_two_keys(df).collect())) == sequential(rows)


def test_sources_in_order_with_quotas(spark):
    r = random.Random(9)
    rows = [(s, f"{r.randint(0, 99):02d}", k, f"q{r.randint(0, 25)}", f"m{r.randint(0, 25)}") for k, s in enumerate("ab" * 30)]
    df = spark.createDataFrame(rows, "source string, ord string, id bigint, k1 string, k2 string")
    first = sequential([x[1:] for x in rows if x[0] == "a"], quota=6)
    second = sequential([x[1:] for x in rows if x[0] == "b"], {x[2] for x in first}, {x[3] for x in first}, quota=6)
    got = selection.select_sources(df, [("a", 6), ("b", 6)]).collect()
    assert sorted(tuple(x)[1:] for x in got if x.source == "a") == first
    assert sorted(tuple(x)[1:] for x in got if x.source == "b") == second
    with pytest.raises(ValueError):
        selection.select_sources(df, [("a", 600)])


M = "array<struct<role:string,content:string>>"
TRIPLES = f"split string, row_index bigint, prompt string, chosen {M}, rejected {M}"


def triple(split, k, prompt, chosen="c"):
    said = lambda t: [("user", prompt), ("assistant", t)]
    return split, k, prompt, said(chosen), said("r")


def test_decisions_by_precedence(spark):
    rows = [triple("train", 0, "Test overlap"), triple("train", 1, "Dev overlap"), triple("train", 2, "Training only"), triple("dev", 0, "TEST—OVERLAP"), triple("dev", 1, "Dev overlap"), triple("test", 0, "test overlap")]
    got = {r.decision: r.n_rows for r in splits.decision_counts(splits.decision_index(spark.createDataFrame(rows, TRIPLES))).collect()}
    assert got == {"candidate_training": 1, "candidate_validation": 1, "excluded_dev_overlap": 1, "excluded_test_overlap": 2, "reserved_evaluation": 1}


def test_decisions_on_repeats_and_gaps(spark):
    rows = [triple("train", 0, "A"), triple("train", 1, "A"), triple("train", 2, "A", "other"), ("train", 3, None, None, None), ("train", 4, " ", None, [("assistant", None)])]
    index = splits.decision_index(spark.createDataFrame(rows, TRIPLES))
    got = {r.decision: (r.n_rows, r.prompt_groups) for r in splits.decision_counts(index).collect()}
    assert got == {"candidate_training": (2, 1), "excluded_exact_duplicate": (1, 1), "excluded_empty_prompt": (2, 1)}
    assert splits.decision_index(spark.createDataFrame([], TRIPLES)).count() == 0


def test_isolation_is_transitive(spark):
    records = spark.createDataFrame([("a", "train"), ("b", "validation"), ("c", "test"), ("d", "train"), ("e", "train")], "record_id string, split string")
    keys = spark.createDataFrame([("a", "doc1"), ("b", "doc1"), ("b", "answer2"), ("c", "answer2"), ("d", "doc4")], "record_id string, key string")
    assert {r.record_id for r in splits.isolate_groups(records, keys).where("kept").collect()} == {"c", "d", "e"}


def test_equal_questions_share_a_split(spark):
    df = spark.createDataFrame([("Question : A?",), ("question a",), ("other",)], "t string").select(splits.hash_split(F.col("t")).alias("s")).collect()
    digest = int(hashlib.sha256(b"questiona").hexdigest()[:8], 16) % 100
    assert df[0].s == df[1].s == ("train" if digest < 70 else "validation" if digest < 85 else "test")


def test_quota_fill_keeps_previous_splits(spark):
    rows = [("s", k, "test" if k < 2 else None) for k in range(10)]
    df = spark.createDataFrame(rows, "source string, id bigint, previous string")
    got = splits.fill_split_quotas(df, "source", "previous", ["id"], {"s": {"train": 5, "validation": 2, "test": 3}}).collect()
    assert {r.id: r.assigned_split for r in got} == {0: "test", 1: "test", 2: "train", 3: "train", 4: "train", 5: "train", 6: "train", 7: "validation", 8: "validation", 9: "test"}
    with pytest.raises(ValueError):
        splits.fill_split_quotas(df, "source", "previous", ["id"], {"s": {"train": 9, "test": 1}})


def test_spans_are_checked_and_masked(spark):
    texts = spark.createDataFrame([(1, "f", "Ann saw Bob."), (2, "f", "none")], "id bigint, field string, text string")
    schema = "id bigint, field string, start int, end int, span string"
    good = spark.createDataFrame([(1, "f", 0, 3, "Ann"), (1, "f", 8, 11, "Bob"), (1, "f", 8, 11, "Bob")], schema)
    assert privacy.span_violations(texts, good).count() == 0
    got = {r.id: (r.text, r.masked) for r in privacy.mask_spans(texts, good, "<N>").collect()}
    assert got == {1: ("<N> saw <N>.", 2), 2: ("none", 0)}
    bad = spark.createDataFrame([(1, "f", 0, 3, "Bob"), (9, "f", 0, 1, "x"), (1, "f", 8, 11, "Bob"), (1, "f", 9, 12, "ob.")], schema)
    assert {r.reason for r in privacy.span_violations(texts, bad).collect()} == {"span_mismatch", "orphan", "overlap"}
    with pytest.raises(ContractViolation):
        require_empty(privacy.span_violations(texts, bad), "findings")


def test_identifiers_are_masked_once(spark):
    t = "Write a@b.example.org or 415-555-0100, IBAN FR76 3000 6000 0112 3456 7890 189. My name is Ann Lee."
    df = spark.createDataFrame([(t,), ("",), (None,)], "t string").select(privacy.masked(F.col("t")).alias("m")).select("m", privacy.privacy_status(F.col("m")).alias("s")).collect()
    assert df[0].s == "passed" and all(f"<{k}>" in df[0].m for k in ("EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "PATIENT_NAME"))
    assert [r.s for r in df[1:]] == ["empty", "empty"]
    found = privacy.findings(spark.createDataFrame([(1, t, None)], "id bigint, a string, b string"), "id", ["a", "b"]).collect()
    assert all(t[r.start : r.end] == r.span for r in found) and len(found) == 4


def test_metrics_golden(spark):
    pairs = spark.createDataFrame([("maximum", "maximum"), ("maximum", "moderate"), ("moderate", "deferred"), ("deferred", "moderate")], "expected string, predicted string")
    r = metrics.level_metrics(pairs).first()
    assert (r.exact_rate, r.top_recall, r.too_low, r.too_high, r.invalid) == (0.25, 0.5, 2, 1, 0)
    assert metrics.level_metrics(pairs.where("expected = 'deferred'")).first().top_recall is None
    assert sum(x.n for x in metrics.confusion(pairs).collect()) == 4 and metrics.confusion(pairs).count() == 9


LOSS = "variant string, record_id string, language string, source string, completion_nll_sum double, completion_tokens int, sequence_nll_sum double, sequence_tokens int, input_sha256 string"


def test_losses_are_weighted_by_tokens(spark):
    rows = [("base", "1", "fr", "x", 4.0, 2, 5.0, 5, "h"), ("base", "2", "en", "x", 9.0, 3, 9.0, 5, "h"), ("base", "3", "en", "x", float("nan"), 3, 1.0, 5, "h"), ("base", "4", "en", "x", None, 3, 1.0, 5, "h")]
    r = metrics.loss_summary(spark.createDataFrame(rows, LOSS), [["variant"]], ["variant", "language", "source"]).first()
    assert (r.records, r.completion_tokens, r.completion_nll, r.sequence_nll) == (2, 5, 2.6, 1.4)


def test_pairs_and_selection(spark):
    rows = [("base", "1", "fr", "x", 4.0, 2, 5.0, 5, "h"), ("sft", "1", "fr", "x", 3.0, 2, 5.0, 5, "h"), ("sft", "2", "fr", "x", 3.0, 2, 5.0, 5, "h")]
    got = {r.variant: (r.paired, r.lower_than_base, r.input_differs) for r in metrics.paired_wins(spark.createDataFrame(rows, LOSS), "base").collect()}
    assert got == {"base": (1, 0, 0), "sft": (1, 1, 0)}
    m = spark.createDataFrame([("base", "a", 1.0, True), ("base", "b", 1.0, False), ("x", "a", 0.5, True), ("x", "b", 1.0, False), ("y", "a", 0.5, True), ("y", "b", 0.5, False)], "variant string, metric string, value double, lower_is_better boolean")
    assert {r.variant: r.selected for r in metrics.pareto(m, "base").collect()} == {"x": True, "y": False}
    assert {r.record_id for r in metrics.in_every_variant(spark.createDataFrame(rows, LOSS), "record_id", "variant", F.lit(True), 2).collect()} == {"1"}


def test_percentiles(spark):
    df = spark.createDataFrame([("g", float(v), k) for k, v in enumerate([5, 1, 4, 2])] + [("g", None, 9), ("g", float("nan"), 10), ("h", 7.0, 11)], "g string, v double, id bigint")
    got = {r.g: (r.n, r.p50, r.p95, r.upper_median) for r in metrics.nearest_rank(df, "g", "v", "id", [50, 95]).collect()}
    assert got == {"g": (4, 2.0, 5.0, 4.0), "h": (1, 7.0, 7.0, 7.0)}
    values = [3, 1, 2, 9, 9, 4]
    r = metrics.length_summary(spark.createDataFrame([(v,) for v in values], "v int"), "v", 8, [50, 90]).first()
    ordered = sorted(values)
    assert (r.p50, r.p90, r.maximum, r.over_limit, r.n) == (ordered[round(5 * 0.5)], ordered[round(5 * 0.9)], 9, 2, 6)


def test_generations(spark):
    rows = [("x", [2, 151643], " The Answer! ", "the answer"), ("y", [1, 2, 3], "", "z")]
    df = spark.createDataFrame(rows, "source string, ids array<int>, output string, reference string")
    got = {r.source: r for r in metrics.generation_summary(df, ["source"], "ids", "output", "reference", [151643], 3).collect()}
    assert (got[None].records, got[None].ended, got[None].reached_cap, got[None].exact_matches, got[None].empty_outputs) == (2, 1, 1, 1, 1)


def test_validation_tables(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id bigint, t string")
    got = validation.violations(df, ["id"], {"filled": F.col("t") != "", "small": F.col("id") < 2}).collect()
    assert [(r.id, r.reasons) for r in got] == [(2, ["filled", "small"])]
    assert validation.coverage(df, spark.createDataFrame([(1,), (3,)], "id bigint"), "id").count() == 2
    assert [r.changed for r in validation.drift(df, spark.createDataFrame([(1, "y"), (2, None)], "id bigint, t string"), "id", ["t"]).collect()] == [["t"]]
    new = spark.createDataFrame([(1, "x"), (3, "n")], "id bigint, t string")
    assert {r.id: r.change for r in validation.revision_diff(df, new, "id", "t").collect()} == {1: "retained", 2: "removed", 3: "added"}
    assert validation.repeated_keys(df.unionAll(df.limit(1)), "id").count() == 1


def test_blinded_review(spark):
    rows = [(s, v, f"{s}{v}") for s in range(5) for v in ("base", "sft")]
    df = spark.createDataFrame(rows, "scenario_id bigint, variant string, response string")
    queue, key = review.blinded_queue(df, 1)
    again, _ = review.blinded_queue(df.orderBy(F.desc("scenario_id")), 1)
    order = lambda q: [r.review_id for r in q.orderBy("place").collect()]
    assert "variant" not in queue.columns and order(queue) == order(again) and key.count() == 10
    ids = order(queue)
    clear = spark.createDataFrame([(i,) for i in ids[2:]], "review_id string")
    flagged = spark.createDataFrame([(ids[0], ["bad"], "why")], "review_id string, flags array<string>, rationale string")
    assert {(r.review_id, r.reason) for r in review.decision_violations(queue, clear, flagged, ["bad"]).collect()} == {(ids[1], "not_reviewed")}
    assert sum(r.flagged for r in review.flag_counts(key, flagged, ["bad"]).collect()) == 1


def test_quotas_and_decisions(spark):
    df = spark.createDataFrame([("fr", "x"), ("fr", "x"), ("en", "x"), ("en", "x"), ("en", "y")], "lang string, cat string")
    assert {(r.lang, r.cat, r.n) for r in validation.quota_violations(df, ["lang", "cat"], 2).collect()} == {("en", "y", 1)}
    every = validation.quota_violations(df, ["lang", "cat"], 2, {"lang": ["fr", "en"], "cat": ["x", "y"]})
    assert {(r.lang, r.cat, r.n) for r in every.collect()} == {("en", "y", 1), ("fr", "y", 0)}
    texts = spark.createDataFrame([(1, "a@b.example.org"), (2, "My name is Ann Lee."), (3, "none"), (4, None)], "id bigint, t string")
    private, public = privacy.record_decisions(texts, privacy.findings(texts, "id", ["t"]), "id", ["EMAIL_ADDRESS"])
    assert {(r.id, r.status, r.findings) for r in public.collect()} == {(1, "direct", 1), (2, "contextual", 1), (3, "clear", 0), (4, "clear", 0)}
    assert "span" in private.columns and "span" not in public.columns
