"""Queries over preference triples and raw payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.functions.arrays import extract_json_object
from selvedge.functions.text import content_hash, norm_fast, or_empty, strip
from selvedge.operators.keyed import cross_group_overlap
from selvedge.operators.review import blinded_queue, flag_counts
from selvedge.operators.splits import conversation_roles, conversation_text, decision_counts, decision_index
from selvedge.operators.validation import contents_filled, first_reason, reason_counts, roles_are, violations
from selvedge.plans.corpus import NORM, STRIP, _hash
from selvedge.session import table

MAX_TEXT = 6000


def _pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "preference_triples")


def split_decision_index(spark, sf_dir):
    return decision_index(_pref(spark, sf_dir)).select("split", "row_index", "prompt_group_sha256", "is_duplicate", "decision")


def split_decision_counts(spark, sf_dir):
    return decision_counts(decision_index(_pref(spark, sf_dir)))


def preference_audit(spark, sf_dir):
    """Structural defects per split."""
    p = _pref(spark, sf_dir)
    number = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    first = lambda c: F.coalesce(F.try_element_at(F.col(c), F.lit(1))["content"], F.lit(""))
    return p.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        number(F.col("chosen").isNull() | F.col("rejected").isNull() | F.col("metadata").isNull() | F.col("label_type").isNull()).alias("missing_fields"),
        number(conversation_roles(F.col("chosen")) != "user,assistant").alias("invalid_chosen_roles"),
        number(conversation_roles(F.col("rejected")) != "user,assistant").alias("invalid_rejected_roles"),
        number(conversation_text(F.col("chosen")) == conversation_text(F.col("rejected"))).alias("identical_answers"),
        number((or_empty("prompt") != first("chosen")) & (or_empty("prompt") != first("rejected"))).alias("prompt_mismatch"),
        number(F.col("metadata.golden_answer").isNotNull()).alias("golden_answers"),
    )


def preference_histograms(spark, sf_dir):
    """Label types, prompt sources and models per split, in long form."""
    p = _pref(spark, sf_dir)
    source = F.coalesce(F.nullif(F.substring_index("prompt_id", ",", 1), F.lit("")), F.lit("unknown"))
    named = {"label_type": F.coalesce("label_type", F.lit("unknown")), "source": source, "chosen_model": F.coalesce("metadata.chosen.model", F.lit("unknown")), "rejected_model": F.coalesce("metadata.rejected.model", F.lit("unknown"))}
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), c.alias("value")) for k, c in named.items()]))
    return p.select("split", long.alias("x")).groupBy("split", "x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n_rows"))


def preference_duplicates(spark, sf_dir):
    """Repeated prompt ids and repeated normalised prompts per split."""
    p = _pref(spark, sf_dir).select("split", or_empty("prompt_id").alias("i"), content_hash(F.col("prompt")).alias("k"))
    long = p.select("split", F.explode(F.array(F.struct(F.lit("prompt_id").alias("kind"), F.col("i").alias("key")), F.struct(F.lit("prompt").alias("kind"), F.col("k").alias("key")))).alias("x")).select("split", "x.*").where("key <> ''")
    keys = long.groupBy("split", "kind", "key").agg(F.count(F.lit(1)).alias("c"))
    return keys.groupBy("split", "kind").agg(F.sum(F.col("c") - 1).alias("duplicates"))


def preference_overlap(spark, sf_dir):
    return cross_group_overlap(_pref(spark, sf_dir).select("split", content_hash(F.col("prompt")).alias("k")), "split", "k")


def preference_eligibility(spark, sf_dir):
    """The first reason why a training or dev triple is left out, or eligible."""
    p = _pref(spark, sf_dir)
    protected = p.where("split = 'test'").select(content_hash(F.col("prompt")).alias("k")).where("k <> ''").distinct().withColumn("protected", F.lit(True))
    rows = p.where("split <> 'test'").withColumn("k", content_hash(F.col("prompt"))).join(protected, "k", "left")
    user, said = (lambda c: F.try_element_at(F.col(c), F.lit(1))["content"]), (lambda c: F.try_element_at(F.col(c), F.lit(2))["content"])
    bad_roles = ~roles_are(F.col("chosen"), ["user", "assistant"]) | ~roles_are(F.col("rejected"), ["user", "assistant"])
    differs = lambda c: norm_fast(or_empty(user(c))) != norm_fast(or_empty("prompt"))
    texts = [or_empty("prompt"), or_empty(said("chosen")), or_empty(said("rejected"))]
    too_long = F.greatest(*[F.length(t) for t in texts]) > MAX_TEXT
    empty = F.least(*[F.length(strip(t)) for t in texts]) == 0
    reason = first_reason(
        [("protected_prompt", F.col("protected")), ("unsupported_conversation", bad_roles), ("prompt_mismatch", differs("chosen") | differs("rejected")), ("length_or_empty", too_long | empty), ("identical_answers", norm_fast(texts[1]) == norm_fast(texts[2]))],
        "eligible",
    )
    return rows.groupBy("split", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def conversation_violations(spark, sf_dir):
    """Message lists that are not [system,] user, assistant with filled contents, by side and rule."""
    p = _pref(spark, sf_dir)
    long = p.select("row_index", "split", F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("m")) for c in ("chosen", "rejected")])).alias("x")).select("row_index", "split", "x.*")
    rules = {
        "present": F.col("m").isNotNull() & (F.size("m") > 0),
        "roles": roles_are(F.col("m"), ["user", "assistant"], "system"),
        "filled": contents_filled(F.col("m")),
    }
    return reason_counts(violations(long, ["side"], rules), ["side"])


def blinded_review(spark, sf_dir):
    """A blinded queue of both answers of each triple, in seeded order."""
    p = _pref(spark, sf_dir)
    long = p.select("row_index", F.explode(F.array(*[F.struct(F.lit(c).alias("variant"), conversation_text(F.col(c)).alias("response")) for c in ("chosen", "rejected")])).alias("x"))
    queue, _ = blinded_queue(long.select(F.col("row_index").alias("scenario_id"), "x.variant", "x.response"), 42)
    return queue.select("place", "review_id", "scenario_id")


def review_flags(spark, sf_dir):
    """Unblinded flag counts of a lexical review: very short answers and answers without an end."""
    p = _pref(spark, sf_dir)
    long = p.select("row_index", F.explode(F.array(*[F.struct(F.lit(c).alias("variant"), conversation_text(F.col(c)).alias("response")) for c in ("chosen", "rejected")])).alias("x"))
    responses = long.select(F.col("row_index").alias("scenario_id"), "x.variant", "x.response")
    queue, key = blinded_queue(responses, 42)
    flags = F.array_compact(F.array(F.when(F.length("response") < 450, "short"), F.when(~F.col("response").rlike(r"[.!?]\s*$"), "no_end")))
    return flag_counts(key, queue.select("review_id", flags.alias("flags")).where(F.size("flags") > 0), ["short", "no_end"])


def payload_validity(spark, sf_dir):
    """Payloads with a complete JSON object per file."""
    r = table(spark, sf_dir, "raw_payloads")
    return r.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(extract_json_object("payload").isNotNull().cast("bigint")).alias("n_valid"))


def payload_fields(spark, sf_dir):
    """Top-level fields of valid payloads and in how many they are found."""
    r = table(spark, sf_dir, "raw_payloads").select(F.explode(F.json_object_keys("payload")).alias("field_name"))
    return r.groupBy("field_name").agg(F.count(F.lit(1)).alias("n_rows"))


def payload_contract(spark, sf_dir):
    """Payload objects whose fields are neither those of a record nor those of a prompt, by reason."""
    kinds = {"record": ["instruction", "language", "record_id", "response", "source"], "prompt": ["golden_answer", "label_type", "prompt", "prompt_id"]}
    keys = F.json_object_keys("payload")
    rows = table(spark, sf_dir, "raw_payloads").select("raw_id", F.sort_array(keys).alias("k"))
    is_record, is_prompt = F.array_contains("k", "instruction"), F.array_contains("k", "prompt")
    allowed = F.when(is_record, F.array(*map(F.lit, kinds["record"]))).otherwise(F.array(*map(F.lit, kinds["prompt"])))
    reason = first_reason(
        [("invalid_json", F.col("k").isNull()), ("no_kind", ~is_record & ~is_prompt), ("both_kinds", is_record & is_prompt), ("unknown_field", F.size(F.array_except("k", allowed)) > 0), ("missing_field", F.size(F.array_except(allowed, "k")) > 0)], "complete"
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {f.__name__: f for f in (split_decision_index, split_decision_counts, preference_audit, preference_histograms, preference_duplicates, preference_overlap, preference_eligibility, conversation_violations, blinded_review, review_flags, payload_validity, payload_fields, payload_contract)}

_TEXT = "coalesce(array_to_string(list_transform({0}, lambda m: coalesce(m.content, '')), chr(10)), '')"
_ROLES = "coalesce(array_to_string(list_transform({0}, lambda m: coalesce(m.role, '?')), ','), '')"
_INDEX = f"""p AS (SELECT split, row_index, {_hash('prompt')} AS h, [coalesce(prompt, ''), {_TEXT.format('chosen')}, {_TEXT.format('rejected')}] AS texts FROM preference_triples),
t AS (SELECT DISTINCT h FROM p WHERE split = 'test' AND h <> ''), d AS (SELECT DISTINCT h FROM p WHERE split = 'dev' AND h <> ''),
i AS (SELECT split, row_index, h AS prompt_group_sha256, row_number() OVER (PARTITION BY split, texts ORDER BY row_index) > 1 AS is_duplicate, h IN (FROM t) AS in_test, h IN (FROM d) AS in_dev FROM p),
x AS (SELECT split, row_index, prompt_group_sha256, is_duplicate, CASE WHEN prompt_group_sha256 = '' THEN 'excluded_empty_prompt' WHEN split = 'test' THEN 'reserved_evaluation' WHEN in_test THEN 'excluded_test_overlap'
WHEN split = 'dev' THEN CASE WHEN is_duplicate THEN 'excluded_exact_duplicate' ELSE 'candidate_validation' END WHEN in_dev THEN 'excluded_dev_overlap'
WHEN is_duplicate THEN 'excluded_exact_duplicate' ELSE 'candidate_training' END AS decision FROM i)"""
_SIDES = f"s AS (SELECT row_index AS scenario_id, 'chosen' AS variant, {_TEXT.format('chosen')} AS response FROM preference_triples UNION ALL SELECT row_index, 'rejected', {_TEXT.format('rejected')} FROM preference_triples), r AS (SELECT DISTINCT *, substr(sha256(variant || chr(0) || scenario_id || chr(0) || sha256(response)), 1, 24) AS review_id FROM s)"
_FIRST = "coalesce({0}[1].content, '')"
SQL = {
    "split_decision_index": f"WITH {_INDEX} SELECT * FROM x",
    "split_decision_counts": f"WITH {_INDEX} SELECT decision, count(*) AS n_rows, count(DISTINCT prompt_group_sha256) AS prompt_groups FROM x GROUP BY decision",
    "preference_audit": f"""SELECT split, count(*) AS n_rows, sum((chosen IS NULL OR rejected IS NULL OR metadata IS NULL OR label_type IS NULL)::INT)::BIGINT AS missing_fields,
sum(({_ROLES.format('chosen')} <> 'user,assistant')::INT)::BIGINT AS invalid_chosen_roles, sum(({_ROLES.format('rejected')} <> 'user,assistant')::INT)::BIGINT AS invalid_rejected_roles,
sum(({_TEXT.format('chosen')} = {_TEXT.format('rejected')})::INT)::BIGINT AS identical_answers,
sum((coalesce(prompt, '') <> {_FIRST.format('chosen')} AND coalesce(prompt, '') <> {_FIRST.format('rejected')})::INT)::BIGINT AS prompt_mismatch,
sum((metadata.golden_answer IS NOT NULL)::INT)::BIGINT AS golden_answers FROM preference_triples GROUP BY split""",
    "preference_histograms": """WITH l AS (SELECT split, unnest([{'d': 'label_type', 'v': coalesce(label_type, 'unknown')}, {'d': 'source', 'v': coalesce(nullif(split_part(prompt_id, ',', 1), ''), 'unknown')},
{'d': 'chosen_model', 'v': coalesce(metadata.chosen.model, 'unknown')}, {'d': 'rejected_model', 'v': coalesce(metadata.rejected.model, 'unknown')}]) AS x FROM preference_triples)
SELECT split, x.d AS dimension, x.v AS value, count(*) AS n_rows FROM l GROUP BY 1, 2, 3""",
    "preference_duplicates": f"""WITH l AS (SELECT split, 'prompt_id' AS kind, coalesce(prompt_id, '') AS key FROM preference_triples UNION ALL SELECT split, 'prompt', {_hash('prompt')} FROM preference_triples)
SELECT split, kind, count(*) - count(DISTINCT key) AS duplicates FROM l WHERE key <> '' GROUP BY split, kind""",
    "preference_overlap": f"""WITH s AS (SELECT DISTINCT split AS g, {_hash('prompt')} AS k FROM preference_triples)
SELECT a.g AS left_group, b.g AS right_group, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.g < b.g WHERE a.k <> '' GROUP BY 1, 2""",
    "preference_eligibility": f"""WITH t AS (SELECT DISTINCT {_hash('prompt')} AS k FROM preference_triples WHERE split = 'test'),
p AS (SELECT *, {_hash('prompt')} AS k, {NORM.format('prompt')} AS np, coalesce(prompt, '') AS t0, coalesce(chosen[2].content, '') AS t1, coalesce(rejected[2].content, '') AS t2 FROM preference_triples WHERE split <> 'test'),
r AS (SELECT split, CASE WHEN k <> '' AND k IN (FROM t) THEN 'protected_prompt'
WHEN NOT coalesce(list_transform(chosen, lambda m: m.role) = ['user', 'assistant'] AND list_transform(rejected, lambda m: m.role) = ['user', 'assistant'], false) THEN 'unsupported_conversation'
WHEN {NORM.format('chosen[1].content')} <> np OR {NORM.format('rejected[1].content')} <> np THEN 'prompt_mismatch'
WHEN greatest(length(t0), length(t1), length(t2)) > {MAX_TEXT} OR {STRIP.format('t0')} = '' OR {STRIP.format('t1')} = '' OR {STRIP.format('t2')} = '' THEN 'length_or_empty'
WHEN {NORM.format('t1')} = {NORM.format('t2')} THEN 'identical_answers' ELSE 'eligible' END AS reason FROM p)
SELECT split, reason, count(*) AS n_rows FROM r GROUP BY split, reason""",
    "conversation_violations": f"""WITH l AS (SELECT 'chosen' AS side, chosen AS m FROM preference_triples UNION ALL SELECT 'rejected', rejected FROM preference_triples),
v AS (SELECT side, unnest([CASE WHEN m IS NULL OR len(m) = 0 THEN 'present' END,
CASE WHEN NOT coalesce(list_transform(m, lambda x: x.role) IN (['user', 'assistant'], ['system', 'user', 'assistant']), false) THEN 'roles' END,
CASE WHEN m IS NULL OR len(list_filter(m, lambda x: {STRIP.format('x.content')} = '')) > 0 THEN 'filled' END]) AS reason FROM l)
SELECT side, reason, count(*) AS n_rows FROM v WHERE reason IS NOT NULL GROUP BY side, reason""",
    "blinded_review": f"WITH {_SIDES} SELECT row_number() OVER (ORDER BY sha256('42:' || review_id), review_id) - 1 AS place, review_id, scenario_id FROM r",
    "review_flags": rf"""WITH {_SIDES}, f AS (SELECT variant, length(response) < 450 AS s, NOT regexp_matches(response, '[.!?]\s*$') AS e FROM r)
SELECT variant, count(*) AS entries, sum(s::INT)::BIGINT AS short, sum(e::INT)::BIGINT AS no_end, sum((s OR e)::INT)::BIGINT AS flagged FROM f GROUP BY variant""",
    "payload_validity": "SELECT file_name, count(*) AS n_rows, sum(json_valid(payload)::INT)::BIGINT AS n_valid FROM raw_payloads GROUP BY file_name",
    "payload_fields": "SELECT k AS field_name, count(*) AS n_rows FROM (SELECT unnest(json_keys(payload)) AS k FROM raw_payloads WHERE json_valid(payload)) GROUP BY k",
    "payload_contract": """WITH k AS (SELECT CASE WHEN json_valid(payload) THEN json_keys(CASE WHEN json_valid(payload) THEN payload END) END AS k FROM raw_payloads),
a AS (SELECT k, CASE WHEN list_contains(k, 'instruction') THEN ['instruction', 'language', 'record_id', 'response', 'source'] ELSE ['golden_answer', 'label_type', 'prompt', 'prompt_id'] END AS a FROM k)
SELECT CASE WHEN k IS NULL THEN 'invalid_json' WHEN NOT list_contains(k, 'instruction') AND NOT list_contains(k, 'prompt') THEN 'no_kind' WHEN list_contains(k, 'instruction') AND list_contains(k, 'prompt') THEN 'both_kinds'
WHEN len(list_filter(k, lambda x: NOT list_contains(a, x))) > 0 THEN 'unknown_field' WHEN len(list_filter(a, lambda x: NOT list_contains(k, x))) > 0 THEN 'missing_field' ELSE 'complete' END AS reason, count(*) AS n_rows FROM a GROUP BY 1""",
}
