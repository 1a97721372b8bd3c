"""Queries that check rendered sets, preference sets and recorded results."""

from __future__ import annotations

from pyspark.sql import functions as F

from selvedge.functions.text import content_hash, norm_fast, or_empty, stable_key
from selvedge.operators.artifacts import artifact_violations, lexical_flags, positional_pairs, preference_violations, reconcile, rendered_violations, selection_digest, threshold_checks
from selvedge.operators.metrics import in_every_variant, finite
from selvedge.operators.ranking import smallest, smallest_per_group
from selvedge.operators.rendering import chat_text, completion_labels, labels_are_valid, render_qa, with_end_token
from selvedge.operators.splits import conversation_text
from selvedge.operators.validation import reason_counts
from selvedge.plans.corpus import NORM, STRIP, SYSTEM, _hash, _sft
from selvedge.plans.evaluation import _latest, _loss
from selvedge.session import table

TASK = "medical_qa_sft"
#: Lexical review of answers: wording that a reviewer should see.
REVIEW = {"dose": [r"\b\d+ ?mg\b"], "urgent": [r"(?i)\bsame day\b", r"(?i)\ble jour même\b"], "certainty": [r"(?i)\b(?:never|always|jamais|toujours)\b"]}


def rendered_contract(spark, sf_dir):
    """Rendered conversations that break the contract, by split and reason."""
    sft = _sft(spark, sf_dir)
    return rendered_violations(render_qa(sft, TASK, SYSTEM).unionByName(render_qa(sft, TASK, SYSTEM, held_out=True))).groupBy("split", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def rendered_drift(spark, sf_dir):
    """The first delivery of every record, rendered, against the last one."""
    sft = _sft(spark, sf_dir).where("split <> 'test'")
    kept = ["record_id", "split", "instruction", "response", "task_type"]
    pick = lambda f: sft.groupBy("record_id").agg(f(F.struct("ingested_at", "row_index", *kept[1:])).alias("r")).select("record_id", *[f"r.{c}" for c in kept[1:]])
    render = lambda df: render_qa(df, TASK, SYSTEM)
    return artifact_violations(pick(F.max), render(pick(F.min)), render).groupBy("reason").agg(F.count(F.lit(1)).alias("n_records"))


def native_end_tokens(spark, sf_dir):
    """Training texts per split: how many end in the end token, and their characters."""
    text = with_end_token(chat_text(F.col("messages")), "<|endoftext|>")
    rows = render_qa(_sft(spark, sf_dir), TASK, SYSTEM).select("split", text.alias("t"))
    return rows.groupBy("split").agg(F.count("t").alias("ended"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("t").cast("bigint")).alias("n_characters"))


def label_masks(spark, sf_dir):
    """Completion labels over word tokens: valid rows and tokens that count."""
    words = lambda c: F.filter(F.split(or_empty(c), r"\s+"), lambda w: w != "")
    rows = _sft(spark, sf_dir).select("split", F.transform(F.concat(words("instruction"), words("response")), lambda w: F.xxhash64(w)).alias("ids"), F.size(words("instruction")).alias("n"))
    labels = rows.withColumn("labels", completion_labels(F.col("ids"), F.col("n")))
    return labels.groupBy("split").agg(
        F.sum(labels_are_valid(F.col("ids"), F.col("labels"), F.col("n")).cast("bigint")).alias("valid"), F.count(F.lit(1)).alias("n_rows"), F.sum((F.size("ids") - F.col("n")).cast("bigint")).alias("counted")
    )


def preference_set_violations(spark, sf_dir):
    """Training and dev triples against the contract of a preference set, protected by the test prompts."""
    p = table(spark, sf_dir, "preference_triples")
    rows = p.where("split <> 'test'").select(F.col("row_index").cast("string").alias("record_id"), "split", "prompt", conversation_text(F.col("chosen")).alias("chosen"), conversation_text(F.col("rejected")).alias("rejected"))
    protected = p.where("split = 'test'").select(content_hash(F.col("prompt")).alias("h")).where("h <> ''")
    return preference_violations(rows, protected, ["dev", "train"]).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def lexical_review(spark, sf_dir):
    """Answers per dataset and review flag."""
    return _sft(spark, sf_dir).select("dataset", F.explode(lexical_flags(F.col("response"), REVIEW)).alias("flag")).groupBy("dataset", "flag").agg(F.count(F.lit(1)).alias("n_rows"))


def paired_families(spark, sf_dir):
    """Distinct locators and eval items by digest, row beside row: the first of each by place."""
    items = table(spark, sf_dir, "eval_items").select("item_id", stable_key("7", F.col("item_id")).alias("item_digest"))
    n = items.count()
    locators = _sft(spark, sf_dir).select(F.col("source.source_locator").alias("locator")).where("locator is not null").distinct().withColumn("locator_digest", stable_key("7", F.col("locator")))
    n = min(n, locators.count())
    return positional_pairs(smallest(locators, ["locator_digest", "locator"], n), smallest(items, ["item_digest", "item_id"], n), ["locator_digest", "locator"], ["item_digest", "item_id"]).select("place", "locator", "item_id")


def sample_digest(spark, sf_dir):
    """One digest of the per-dataset samples of instructions."""
    rows = _sft(spark, sf_dir).select("dataset", "row_index", stable_key(F.col("dataset"), F.col("row_index")).alias("digest"))
    return selection_digest(smallest_per_group(rows, ["dataset"], ["digest", "row_index"], 5), "digest", ["dataset", "digest"])


def variant_gates(spark, sf_dir):
    """Measures of each variant against fixed limits."""
    rows = _latest(spark, sf_dir)
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double")
    per = rows.groupBy("variant").agg((exact("completion_nll_sum") / F.sum("completion_tokens")).alias("completion_nll"), F.count(F.lit(1)).cast("double").alias("records"))
    long = per.unpivot(["variant"], ["completion_nll", "records"], "metric", "value")
    checked = threshold_checks(long, {"completion_nll": ("max", 1.5), "records": ("min", 100.0)})
    return checked.select("variant", "metric", F.round("value", 6).alias("value"), "passed")


def audit_log_reconciliation(spark, sf_dir):
    """Interactions that were received against entries with an output, by reason; complete ones as matched."""
    log = table(spark, sf_dir, "audit_log")
    expected = log.select("interaction_id").distinct()
    found = reconcile(expected, log.where("output is not null"), "interaction_id", {"privacy": F.col("privacy_status") == "passed", "version": F.col("prompt_version").isNotNull()})
    return reason_counts(found.select(F.when(F.size("reasons") == 0, F.array(F.lit("matched"))).otherwise(F.col("reasons")).alias("reasons")))


def exact_answer_matches(spark, sf_dir):
    """Golden answers that are, normalised, the chosen or rejected assistant answer, per split."""
    p = table(spark, sf_dir, "preference_triples").where("metadata.golden_answer is not null")
    same = lambda c: F.sum(F.coalesce(norm_fast(F.try_element_at(F.col(c), F.lit(-1))["content"]) == norm_fast("metadata.golden_answer"), F.lit(False)).cast("bigint"))
    return p.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), same("chosen").alias("chosen"), same("rejected").alias("rejected"))


def commonly_measured_by_source(spark, sf_dir):
    """Records measured without a gap in all variants, per source."""
    rows = _loss(spark, sf_dir)
    n = rows.select("variant").distinct().count()
    good = in_every_variant(rows, "record_id", "variant", finite("completion_nll_sum", "sequence_nll_sum"), n)
    return rows.select("record_id", "source").distinct().join(good, "record_id").groupBy("source").agg(F.count(F.lit(1)).alias("records"))


QUERIES = {f.__name__: f for f in (rendered_contract, rendered_drift, native_end_tokens, label_masks, preference_set_violations, lexical_review, paired_families, sample_digest, variant_gates, audit_log_reconciliation, exact_answer_matches, commonly_measured_by_source)}

_DS = "coalesce(source.source_dataset, 'unknown')"
_PT = "coalesce(array_to_string(list_transform({0}, lambda m: coalesce(m.content, '')), chr(10)), '')"
_FIN = "(completion_nll_sum IS NOT NULL AND sequence_nll_sum IS NOT NULL AND isfinite(completion_nll_sum) AND isfinite(sequence_nll_sum))"
_CHAT = f"'<|im_start|>system' || chr(10) || '{SYSTEM}<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(instruction, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || coalesce(response, '')"
SQL = {
    "rendered_contract": f"""SELECT split, 'contents' AS reason, count(*) AS n_rows FROM sft_records WHERE task_type = '{TASK}' AND ({STRIP.format('instruction')} = '' OR {STRIP.format('response')} = '') GROUP BY split
UNION ALL SELECT split, 'repeated_id', count(*) FROM (SELECT record_id, min(split) AS split FROM sft_records WHERE task_type = '{TASK}' GROUP BY record_id HAVING count(*) > 1) GROUP BY split""",
    "rendered_drift": """WITH f AS (SELECT record_id, arg_min(struct_pack(s := split, i := coalesce(instruction, ''), r := coalesce(response, '')), (ingested_at, row_index)) AS a, arg_max(struct_pack(s := split, i := coalesce(instruction, ''), r := coalesce(response, '')), (ingested_at, row_index)) AS b FROM sft_records WHERE split <> 'test' GROUP BY record_id)
SELECT CASE WHEN a.s <> b.s THEN 'other_split' ELSE 'content_drift' END AS reason, count(*) AS n_records FROM f WHERE a <> b GROUP BY 1""",
    "native_end_tokens": f"""WITH t AS (SELECT split, {_CHAT} || '<|endoftext|>' AS t, contains(coalesce(instruction, '') || coalesce(response, ''), '<|endoftext|>') AS bad FROM sft_records WHERE task_type = '{TASK}' AND split <> 'test')
SELECT split, sum((NOT bad)::INT)::BIGINT AS ended, count(*) AS n_rows, sum(CASE WHEN NOT bad THEN length(t) END)::BIGINT AS n_characters FROM t GROUP BY split""",
    "label_masks": r"""WITH w AS (SELECT split, len(list_filter(string_split_regex(coalesce(response, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS r FROM sft_records)
SELECT split, sum((r > 0)::INT)::BIGINT AS valid, count(*) AS n_rows, sum(r)::BIGINT AS counted FROM w GROUP BY split""",
    "preference_set_violations": f"""WITH p AS (SELECT row_index::VARCHAR AS id, split, CASE split WHEN 'dev' THEN 1 WHEN 'train' THEN 2 ELSE 0 END AS place, {_hash('prompt')} AS h, coalesce(prompt, '') AS prompt, {_PT.format('chosen')} AS c, {_PT.format('rejected')} AS r FROM preference_triples),
t AS (SELECT DISTINCT h FROM p WHERE split = 'test' AND h <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY place, id) AS k FROM p WHERE split <> 'test'),
v AS (SELECT unnest([CASE WHEN place = 0 THEN 'split' END, CASE WHEN {STRIP.format('prompt')} = '' OR {STRIP.format('c')} = '' OR {STRIP.format('r')} = '' THEN 'blank' END,
CASE WHEN {NORM.format('c')} = {NORM.format('r')} THEN 'identical_answers' END, CASE WHEN h IN (FROM t) THEN 'protected_prompt' END, CASE WHEN k > 1 THEN 'repeated_prompt' END]) AS reason FROM n)
SELECT reason, count(*) AS n_rows FROM v WHERE reason IS NOT NULL GROUP BY reason""",
    "lexical_review": rf"""WITH f AS (SELECT {_DS} AS dataset, unnest([CASE WHEN regexp_matches(coalesce(response, ''), '\b\d+ ?mg\b') THEN 'dose' END, CASE WHEN regexp_matches(coalesce(response, ''), '(?i)\bsame day\b|\ble jour même\b') THEN 'urgent' END,
CASE WHEN regexp_matches(coalesce(response, ''), '(?i)\b(?:never|always|jamais|toujours)\b') THEN 'certainty' END]) AS flag FROM sft_records) SELECT dataset, flag, count(*) AS n_rows FROM f WHERE flag IS NOT NULL GROUP BY 1, 2""",
    "paired_families": """WITH l AS (SELECT locator, row_number() OVER (ORDER BY sha256('7:' || locator), locator) - 1 AS place FROM (SELECT DISTINCT source.source_locator AS locator FROM sft_records WHERE source.source_locator IS NOT NULL)),
i AS (SELECT item_id, row_number() OVER (ORDER BY sha256('7:' || item_id), item_id) - 1 AS place FROM eval_items) SELECT place, locator, item_id FROM l JOIN i USING (place)""",
    "sample_digest": f"""WITH r AS (SELECT {_DS} AS dataset, row_index, sha256({_DS} || ':' || row_index) AS digest FROM sft_records QUALIFY row_number() OVER (PARTITION BY {_DS} ORDER BY sha256({_DS} || ':' || row_index), row_index) <= 5)
SELECT sha256(string_agg(digest, '' ORDER BY dataset, digest)) AS selection_sha256, count(*) AS n_rows FROM r""",
    "variant_gates": f"""WITH b AS (SELECT variant, record_id, arg_max(struct_pack(c := completion_nll_sum, t := completion_tokens), (measured_at, obs_id)) AS v FROM loss_rows WHERE {_FIN} GROUP BY variant, record_id),
m AS (SELECT variant, sum(v.c::DECIMAL(28,6))::DOUBLE / sum(v.t) AS a, count(*)::DOUBLE AS r FROM b GROUP BY variant)
SELECT variant, 'completion_nll' AS metric, round(a, 6) AS value, a <= 1.5 AS passed FROM m UNION ALL SELECT variant, 'records', r, r >= 100 FROM m""",
    "audit_log_reconciliation": """WITH e AS (SELECT DISTINCT interaction_id FROM audit_log), f AS (SELECT interaction_id, count(*) AS n, bool_and(coalesce(privacy_status = 'passed', false)) AS p, bool_and(prompt_version IS NOT NULL) AS v FROM audit_log WHERE output IS NOT NULL GROUP BY 1),
r AS (SELECT list_filter([CASE WHEN n IS NULL THEN 'missing_entry' END, CASE WHEN n > 1 THEN 'repeated_entry' END, CASE WHEN n = 1 AND NOT p THEN 'privacy' END, CASE WHEN n = 1 AND NOT v THEN 'version' END], lambda x: x IS NOT NULL) AS r FROM e LEFT JOIN f USING (interaction_id))
SELECT reason, count(*) AS n_rows FROM (SELECT unnest(CASE WHEN len(r) = 0 THEN ['matched'] ELSE r END) AS reason FROM r) GROUP BY reason""",
    "exact_answer_matches": f"""SELECT split, count(*) AS n_rows, sum(coalesce(chosen[-1].content IS NOT NULL AND {NORM.format('chosen[-1].content')} = {NORM.format('metadata.golden_answer')}, false)::INT)::BIGINT AS chosen,
sum(coalesce(rejected[-1].content IS NOT NULL AND {NORM.format('rejected[-1].content')} = {NORM.format('metadata.golden_answer')}, false)::INT)::BIGINT AS rejected FROM preference_triples WHERE metadata.golden_answer IS NOT NULL GROUP BY split""",
    "commonly_measured_by_source": f"""WITH g AS (SELECT record_id FROM loss_rows GROUP BY record_id HAVING count(DISTINCT variant) = (SELECT count(DISTINCT variant) FROM loss_rows) AND bool_and({_FIN}))
SELECT source, count(*) AS records FROM (SELECT DISTINCT record_id, source FROM loss_rows) JOIN g USING (record_id) GROUP BY source""",
}
