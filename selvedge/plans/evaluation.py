"""Queries over loss observations and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.functions.text import or_empty
from selvedge.operators.metrics import LEVELS, confusion, finite, in_every_variant, latest, length_summary, level_metrics, loss_summary, nearest_rank, paired_wins, pareto
from selvedge.operators.validation import first_reason, reason_counts
from selvedge.session import table
from selvedge.streaming.audit import stream_audit_counts

BASE = "base"
LIMIT = 256
LEVEL = r'"priority_level"\s*:\s*"(\w+)"'


def _loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "loss_rows").withColumn("language", F.coalesce("language", F.lit("none")))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["completion_nll_sum", "completion_tokens", "sequence_nll_sum", "sequence_tokens", "input_sha256", "language", "source"]
    good = _loss(spark, sf_dir).where(finite("completion_nll_sum", "sequence_nll_sum"))
    return latest(good, ["variant", "record_id"], ["measured_at", "obs_id"], values)


def loss_by_group(spark, sf_dir):
    """Token-weighted loss of each variant: in all, by language, by source."""
    return loss_summary(_loss(spark, sf_dir), [["variant"], ["variant", "language"], ["variant", "source"]], ["variant", "language", "source"])


def loss_quality(spark, sf_dir):
    """Observations that cannot be used, per variant and reason."""
    bad = first_reason(
        [("null_sum", F.col("completion_nll_sum").isNull() | F.col("sequence_nll_sum").isNull()), ("not_finite", ~finite("completion_nll_sum", "sequence_nll_sum")), ("no_tokens", (F.coalesce("completion_tokens", F.lit(0)) <= 0) | (F.coalesce("sequence_tokens", F.lit(0)) <= 0))],
        "usable",
    )
    return _loss(spark, sf_dir).groupBy("variant", bad.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def latest_observations(spark, sf_dir):
    """The last usable observation of every variant and record."""
    return _latest(spark, sf_dir).select("variant", "record_id", "completion_nll_sum", "completion_tokens", "input_sha256")


def paired_lower_loss(spark, sf_dir):
    return paired_wins(_latest(spark, sf_dir), BASE)


def measured_in_every_variant(spark, sf_dir):
    """Records whose every observation is usable in all variants, per number of observations."""
    rows = _loss(spark, sf_dir)
    n = rows.select("variant").distinct().count()
    return in_every_variant(rows, "record_id", "variant", finite("completion_nll_sum", "sequence_nll_sum"), n)


def sequence_lengths(spark, sf_dir):
    return length_summary(_loss(spark, sf_dir), "sequence_tokens", LIMIT, [50, 90, 95, 99])


def candidate_selection(spark, sf_dir):
    """Variants against the base on three measures: worse, better, and whether one is chosen."""
    rows = _latest(spark, sf_dir)
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double")
    per = rows.groupBy("variant").agg((exact("completion_nll_sum") / F.sum("completion_tokens")).alias("completion_nll"), (exact("sequence_nll_sum") / F.sum("sequence_tokens")).alias("sequence_nll"), F.count(F.lit(1)).cast("double").alias("records"))
    long = per.unpivot(["variant"], ["completion_nll", "sequence_nll", "records"], "metric", "value").withColumn("lower_is_better", F.col("metric") != "records")
    return pareto(long, BASE)


def run_progress(spark, sf_dir):
    """First and last observation, records and observations per run and variant."""
    return _loss(spark, sf_dir).groupBy("run_id", "variant").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("record_id").alias("records"), F.min("measured_at").alias("first_at"), F.max("measured_at").alias("last_at"))


def observation_orphans(spark, sf_dir):
    """Observations whose record is unknown, or known in another language, per variant."""
    known = table(spark, sf_dir, "sft_records").groupBy("record_id").agg(F.min(F.substring(F.lower("language"), 1, 2)).alias("lo"), F.max(F.substring(F.lower("language"), 1, 2)).alias("hi"))
    seen = _loss(spark, sf_dir).groupBy("variant", "record_id", "language").agg(F.count(F.lit(1)).alias("k"))
    joined = seen.join(known, "record_id", "left")
    other = (F.col("language") != "none") & ~F.substring(F.lower("language"), 1, 2).between(F.col("lo"), F.col("hi"))
    number = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    return joined.groupBy("variant").agg(number(F.col("lo").isNull() & F.col("hi").isNull()).alias("orphans"), number(other).alias("other_language"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audit_log")


def audit_status_counts(spark, sf_dir):
    return _audit(spark, sf_dir).groupBy("status", F.coalesce("privacy_status", F.lit("none")).alias("privacy_status"), F.coalesce("language", F.lit("none")).alias("language")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("output").isNull().cast("bigint")).alias("no_output"))


def audit_reconciliation(spark, sf_dir):
    """Interactions that ended well against the log: matched, or the reasons why not."""
    rows = _audit(spark, sf_dir)
    facts = rows.groupBy("interaction_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max((F.col("status") == "ok").cast("int")).alias("succeeded"),
        F.min((F.coalesce("privacy_status", F.lit("")) == "passed").cast("int") * (or_empty("anonymized_input") != "").cast("int")).alias("privacy"),
        F.min(((or_empty("prompt_version") != "") & (or_empty("controls_version") != "")).cast("int")).alias("versions"),
        F.min(F.col("output").isNotNull().cast("int")).alias("output"),
    ).where("succeeded = 1")
    single = F.col("n") == 1
    reasons = F.array_compact(F.array(F.when(~single, F.lit("duplicate_audit_entry")), F.when(single & (F.col("output") == 0), F.lit("missing_output")), F.when(single & (F.col("privacy") == 0), F.lit("missing_privacy_evidence")), F.when(single & (F.col("versions") == 0), F.lit("missing_version_evidence"))))
    listed = facts.select(F.when(F.size(reasons) == 0, F.array(F.lit("matched"))).otherwise(reasons).alias("reasons"))
    return reason_counts(listed)


def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles and upper median of the latency per model version."""
    return nearest_rank(_audit(spark, sf_dir), "model_version", "latency_ms", "log_id", [50, 95, 99])


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First logged level of an interaction as expected, last as predicted, of interactions logged more than once."""
    rows = _audit(spark, sf_dir).select("interaction_id", "logged_at", "log_id", F.nullif(F.regexp_extract(or_empty("output"), LEVEL, 1), F.lit("")).alias("level"))
    pair = rows.groupBy("interaction_id").agg(F.min(F.struct("logged_at", "log_id", "level")).alias("a"), F.max(F.struct("logged_at", "log_id", "level")).alias("b"), F.count(F.lit(1)).alias("n"))
    return pair.where("n > 1").select(F.col("a.level").alias("expected"), F.col("b.level").alias("predicted"))


def level_confusion(spark, sf_dir):
    return confusion(_levels(spark, sf_dir))


def level_agreement(spark, sf_dir):
    return level_metrics(_levels(spark, sf_dir))


def late_arrivals(spark, sf_dir):
    """Log rows received more than a day after they were logged, per day logged."""
    rows = _audit(spark, sf_dir).where("received_at > logged_at + interval 1 day")
    return rows.groupBy(F.to_date("logged_at").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))


def audit_stream(spark, sf_dir):
    """Audit rows appended by a stream, each log_id once, counted per hour logged."""
    return stream_audit_counts(spark, sf_dir)


QUERIES = {f.__name__: f for f in (loss_by_group, loss_quality, latest_observations, paired_lower_loss, measured_in_every_variant, sequence_lengths, candidate_selection, run_progress, observation_orphans, audit_status_counts, audit_reconciliation, latency_percentiles, level_confusion, level_agreement, late_arrivals, audit_stream)}

_FIN = "(completion_nll_sum IS NOT NULL AND sequence_nll_sum IS NOT NULL AND isfinite(completion_nll_sum) AND isfinite(sequence_nll_sum))"
_L = "l AS (SELECT * REPLACE (coalesce(language, 'none') AS language) FROM loss_rows)"
_LATEST = f"{_L}, b AS (SELECT variant, record_id, arg_max(struct_pack(c := completion_nll_sum, t := completion_tokens, s := sequence_nll_sum, u := sequence_tokens, i := input_sha256), (measured_at, obs_id)) AS v FROM l WHERE {_FIN} GROUP BY variant, record_id)"
_DEC = "sum({}::DECIMAL(28,6))::DOUBLE"
_PAIRS = rf"""a AS (SELECT interaction_id, arg_min(struct_pack(l := nullif(regexp_extract(coalesce(output, ''), '{LEVEL}', 1), '')), (logged_at, log_id)) AS a, arg_max(struct_pack(l := nullif(regexp_extract(coalesce(output, ''), '{LEVEL}', 1), '')), (logged_at, log_id)) AS b
FROM audit_log GROUP BY interaction_id HAVING count(*) > 1), p AS (SELECT a.l AS expected, b.l AS predicted FROM a), v AS (SELECT * FROM (VALUES ('deferred', 0), ('moderate', 1), ('maximum', 2)) AS x(l, k))"""
SQL = {
    "loss_by_group": f"""WITH {_L}, g AS (SELECT variant, language, source, grouping(variant, language, source) AS grouping, count(*) AS records, sum(completion_tokens)::BIGINT AS completion_tokens, {_DEC.format('completion_nll_sum')} / sum(completion_tokens) AS nll,
round({_DEC.format('sequence_nll_sum')} / sum(sequence_tokens), 6) AS sequence_nll FROM l WHERE {_FIN} AND completion_tokens > 0 AND sequence_tokens > 0 GROUP BY GROUPING SETS ((variant), (variant, language), (variant, source)))
SELECT variant, language, source, grouping, records, completion_tokens, round(nll, 6) AS completion_nll, round(exp(least(nll, 700.0)), 6) AS completion_perplexity, sequence_nll FROM g""",
    "loss_quality": f"""SELECT variant, CASE WHEN completion_nll_sum IS NULL OR sequence_nll_sum IS NULL THEN 'null_sum' WHEN NOT {_FIN} THEN 'not_finite' WHEN coalesce(completion_tokens, 0) <= 0 OR coalesce(sequence_tokens, 0) <= 0 THEN 'no_tokens' ELSE 'usable' END AS reason, count(*) AS n_rows FROM loss_rows GROUP BY 1, 2""",
    "latest_observations": f"WITH {_LATEST} SELECT variant, record_id, v.c AS completion_nll_sum, v.t AS completion_tokens, v.i AS input_sha256 FROM b",
    "paired_lower_loss": f"""WITH {_LATEST} SELECT x.variant, count(*) AS paired, sum((x.v.c < y.v.c)::INT)::BIGINT AS lower_than_base, sum((x.v.i IS DISTINCT FROM y.v.i)::INT)::BIGINT AS input_differs
FROM b x JOIN b y ON x.record_id = y.record_id AND y.variant = '{BASE}' GROUP BY x.variant""",
    "measured_in_every_variant": f"SELECT record_id FROM loss_rows GROUP BY record_id HAVING count(DISTINCT variant) = (SELECT count(DISTINCT variant) FROM loss_rows) AND bool_and({_FIN})",
    "sequence_lengths": f"""WITH s AS (SELECT list_sort(list(sequence_tokens)) AS v FROM loss_rows WHERE sequence_tokens IS NOT NULL)
SELECT len(v) AS n, v[round_even((len(v) - 1) * 50 / 100.0, 0)::INT + 1] AS p50, v[round_even((len(v) - 1) * 90 / 100.0, 0)::INT + 1] AS p90, v[round_even((len(v) - 1) * 95 / 100.0, 0)::INT + 1] AS p95, v[round_even((len(v) - 1) * 99 / 100.0, 0)::INT + 1] AS p99,
v[len(v)] AS maximum, len(list_filter(v, lambda x: x > {LIMIT})) AS over_limit FROM s""",
    "candidate_selection": f"""WITH {_LATEST}, m AS (SELECT variant, {_DEC.format('v.c')} / sum(v.t) AS a, {_DEC.format('v.s')} / sum(v.u) AS s, count(*)::DOUBLE AS r FROM b GROUP BY variant),
d AS (SELECT x.variant, [y.a - x.a, y.s - x.s, x.r - y.r] AS g FROM m x JOIN m y ON y.variant = '{BASE}' WHERE x.variant <> '{BASE}')
SELECT variant, len(list_filter(g, lambda z: z < 0)) AS worse, len(list_filter(g, lambda z: z > 0)) AS better, len(list_filter(g, lambda z: z < 0)) = 0 AND len(list_filter(g, lambda z: z > 0)) > 0 AS selected FROM d""",
    "run_progress": "SELECT run_id, variant, count(*) AS n_rows, count(DISTINCT record_id) AS records, min(measured_at) AS first_at, max(measured_at) AS last_at FROM loss_rows GROUP BY run_id, variant",
    "observation_orphans": """WITH k AS (SELECT record_id, min(substr(lower(language), 1, 2)) AS lo, max(substr(lower(language), 1, 2)) AS hi FROM sft_records GROUP BY record_id)
SELECT variant, sum((lo IS NULL AND hi IS NULL)::INT)::BIGINT AS orphans, sum(coalesce(l.language IS NOT NULL AND NOT substr(lower(l.language), 1, 2) BETWEEN lo AND hi, false)::INT)::BIGINT AS other_language FROM loss_rows l LEFT JOIN k USING (record_id) GROUP BY variant""",
    "audit_status_counts": "SELECT status, coalesce(privacy_status, 'none') AS privacy_status, coalesce(language, 'none') AS language, count(*) AS n_rows, sum((output IS NULL)::INT)::BIGINT AS no_output FROM audit_log GROUP BY 1, 2, 3",
    "audit_reconciliation": """WITH f AS (SELECT count(*) = 1 AS single, bool_and(coalesce(privacy_status, '') = 'passed' AND coalesce(anonymized_input, '') <> '') AS privacy, bool_and(coalesce(prompt_version, '') <> '' AND coalesce(controls_version, '') <> '') AS versions, bool_and(output IS NOT NULL) AS output
FROM audit_log GROUP BY interaction_id HAVING bool_or(status = 'ok')),
r AS (SELECT list_filter([CASE WHEN NOT single THEN 'duplicate_audit_entry' END, CASE WHEN single AND NOT output THEN 'missing_output' END, CASE WHEN single AND NOT privacy THEN 'missing_privacy_evidence' END, CASE WHEN single AND NOT versions THEN 'missing_version_evidence' END], lambda x: x IS NOT NULL) AS r FROM f)
SELECT reason, count(*) AS n_rows FROM (SELECT unnest(CASE WHEN len(r) = 0 THEN ['matched'] ELSE r END) AS reason FROM r) GROUP BY reason""",
    "latency_percentiles": """WITH s AS (SELECT model_version, list_sort(list(latency_ms)) AS v FROM audit_log WHERE latency_ms IS NOT NULL AND isfinite(latency_ms) GROUP BY model_version)
SELECT model_version, len(v) AS n, v[ceil(len(v) * 50 / 100)::INT] AS p50, v[ceil(len(v) * 95 / 100)::INT] AS p95, v[ceil(len(v) * 99 / 100)::INT] AS p99, v[len(v) // 2 + 1] AS upper_median FROM s""",
    "level_confusion": f"WITH {_PAIRS} SELECT e.l AS expected, q.l AS predicted, (SELECT count(*) FROM p WHERE p.expected = e.l AND p.predicted = q.l) AS n FROM v e, v q",
    "level_agreement": f"""WITH {_PAIRS}, r AS (SELECT e.k AS e, q.k AS q FROM p LEFT JOIN v e ON p.expected = e.l LEFT JOIN v q ON p.predicted = q.l)
SELECT count(*) AS total, sum(coalesce(e = q, false)::INT) / count(*) AS exact_rate, sum(coalesce(e = 2 AND q = 2, false)::INT) / nullif(sum(coalesce(e = 2, false)::INT), 0) AS top_recall, sum(coalesce(q < e, false)::INT)::BIGINT AS too_low, sum(coalesce(q > e, false)::INT)::BIGINT AS too_high, sum((e IS NULL OR q IS NULL)::INT)::BIGINT AS invalid FROM r""",
    "late_arrivals": "SELECT logged_at::DATE AS day, count(*) AS n_rows FROM audit_log WHERE received_at > logged_at + INTERVAL 1 DAY GROUP BY 1",
    "audit_stream": "SELECT date_trunc('hour', logged_at) AS hour, status, count(*) AS n_rows FROM (SELECT DISTINCT ON (log_id) * FROM audit_log) GROUP BY 1, 2",
}
