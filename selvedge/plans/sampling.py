"""Queries that draw deterministic samples, batches and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from selvedge.functions.text import content_hash, or_empty, record_key, sha, stable_key
from selvedge.operators.privacy import masked
from selvedge.operators.ranking import batches, global_rank, quota_label, round_robin, smallest, smallest_per_group, stratified
from selvedge.operators.selection import first_of_key, select_sources
from selvedge.operators.splits import fill_split_quotas, group_splits
from selvedge.plans.corpus import _SFT, masked_sql, _hash, _sft
from selvedge.session import materialize, table

SEED = "42"
SAMPLE, PER_SOURCE, QUEUE, STRATIFIED, BATCH = 200, 5, 150, 300, 100
#: Parts of 100 that quota splits and group splits give away.
SHARES = {"train": 80, "validation": 10}


def seeded_sample(spark, sf_dir):
    rows = _sft(spark, sf_dir).select("row_index", "record_id", stable_key(SEED, F.col("record_id")).alias("digest"))
    return smallest(rows, ["digest", "row_index"], SAMPLE)


def per_source_sample(spark, sf_dir):
    rows = _sft(spark, sf_dir).select("dataset", "row_index", sha(F.concat_ws(":", "source.source_locator", "row_index")).alias("digest"))
    return smallest_per_group(rows, ["dataset"], ["digest", "row_index"], PER_SOURCE)


def per_split_preference_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "preference_triples").select("split", "row_index", sha(F.concat_ws(":", "split", "row_index", F.coalesce("prompt_id", F.lit("")))).alias("digest"))
    return smallest_per_group(rows, ["split"], ["digest", "row_index"], PER_SOURCE)


def round_robin_queue(spark, sf_dir):
    """First-seen instructions, datasets taking turns."""
    rows = _sft(spark, sf_dir).select(content_hash(F.col("instruction")).alias("k"), "row_index", "dataset", sha(F.col("record_id")).alias("digest"))
    first = first_of_key(rows, "k", ["row_index"])
    return round_robin(first.select("dataset", "row_index", "digest"), "dataset", ["digest", "row_index"], QUEUE).select("turn", "dataset", "row_index")


def stratified_sample(spark, sf_dir):
    """Documents spread over the domains by largest remainder."""
    rows = table(spark, sf_dir, "documents").select("domain", "doc_id", stable_key(SEED, F.col("doc_id")).alias("digest"))
    n = min(STRATIFIED, rows.where("domain is not null").count())
    return stratified(rows, "domain", ["digest", "doc_id"], n).select("domain", "doc_id", "place")


def _selectable(spark, sf_dir):
    return _sft(spark, sf_dir).select("dataset", content_hash(F.col("instruction")).alias("k1"), content_hash(masked(or_empty("instruction"))).alias("k2"), stable_key(F.col("dataset"), F.col("record_id")).alias("ord"), F.col("row_index").alias("id"))


def single_key_selection(spark, sf_dir):
    """The first record of each instruction in digest order, of these the first by quota."""
    return first_of_key(_selectable(spark, sf_dir).select("k1", "ord", "id"), "k1", ["ord", "id"], SAMPLE).select("ord", "id")


def greedy_quota_selection(spark, sf_dir):
    """Records of each dataset in name order until a fifth of its rows are taken, no question or masked question twice."""
    rows = materialize(_selectable(spark, sf_dir).where("k1 <> '' and k2 <> ''").withColumnRenamed("dataset", "source"))
    quotas = [(r[0], r[1] // 5) for r in sorted(rows.groupBy("source").agg(F.countDistinct("k1")).collect())]
    return select_sources(rows, quotas).select("source", "ord", "id")


def quota_split_fill(spark, sf_dir):
    """Test rows keep their split; the others refill train and validation quotas of their dataset in digest order."""
    rows = _sft(spark, sf_dir).select("dataset", "row_index", F.when(F.col("split") == "test", "test").alias("previous"), stable_key(F.col("dataset"), F.col("row_index")).alias("digest"))
    quotas = {}
    for r in rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("previous").alias("t")).collect():
        validation = r.n * SHARES["validation"] // 100
        quotas[r.dataset] = {"train": r.n - r.t - validation, "validation": validation, "test": r.t}
    return fill_split_quotas(rows, "dataset", "previous", ["digest", "row_index"], quotas).select("row_index", "dataset", "assigned_split")


def group_split_assignment(spark, sf_dir):
    """Source locators cut into splits in digest order, so that one locator is in one split."""
    rows = _sft(spark, sf_dir).select(F.col("source.source_locator").alias("locator"))
    n = rows.where("locator is not null").distinct().count()
    train, validation = n * SHARES["train"] // 100, n * SHARES["validation"] // 100
    return group_splits(rows, "locator", "protocol-1", [("train", train), ("validation", validation), ("test", n - train - validation)])


def cumulative_quotas(spark, sf_dir):
    """The first records in digest order, labelled by cumulative quotas."""
    quotas = [("respiratory", 40), ("cardiac", 60), ("neurological", 50), ("other", 50)]
    rows = _sft(spark, sf_dir).select("row_index", stable_key(SEED, F.col("row_index")).alias("digest"))
    first = smallest(rows, ["digest"], sum(n for _, n in quotas))
    return global_rank(first, ["digest"], "place").select("row_index", "place", quota_label(F.col("place"), quotas).alias("family"))


def review_batches(spark, sf_dir):
    """Distinct records in digest order, cut into batches; one row a batch."""
    rows = _sft(spark, sf_dir).select("record_id").distinct().withColumn("digest", stable_key(SEED, F.col("record_id")))
    return batches(rows, ["digest", "record_id"], BATCH).groupBy("batch").agg(F.count(F.lit(1)).alias("n_records"), F.min("digest").alias("first_digest"), F.max("digest").alias("last_digest"))


def review_items(spark, sf_dir):
    """One item per source locator with its languages and splits."""
    rows = _sft(spark, sf_dir).select(F.col("source.source_locator").alias("locator"), F.coalesce("language", F.lit("none")).alias("language"), "split")
    return rows.groupBy("locator").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"))


def authoring_candidates(spark, sf_dir):
    """Selected records times the two languages, each with its own id."""
    first = single_key_selection(spark, sf_dir)
    return first.select("id", F.explode(F.array(F.lit("fr"), F.lit("en"))).alias("requested_language")).select("id", "requested_language", record_key("candidate-", F.col("id"), F.col("requested_language")).alias("candidate_id"))


QUERIES = {f.__name__: f for f in (seeded_sample, per_source_sample, per_split_preference_sample, round_robin_queue, stratified_sample, single_key_selection, greedy_quota_selection, quota_split_fill, group_split_assignment, cumulative_quotas, review_batches, review_items, authoring_candidates)}

_DS = "coalesce(source.source_dataset, 'unknown')"
_SINGLE = f"""f AS (SELECT ord, id FROM (SELECT {_hash('instruction')} AS k, sha256({_DS} || ':' || record_id) AS ord, row_index AS id FROM sft_records) WHERE k <> ''
QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord, id) = 1 ORDER BY ord, id LIMIT {SAMPLE})"""
SQL = {
    "seeded_sample": f"SELECT row_index, record_id, sha256('{SEED}:' || record_id) AS digest FROM sft_records ORDER BY 3, 1 LIMIT {SAMPLE}",
    "per_source_sample": f"""SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY digest, row_index)::INT AS rank FROM (SELECT {_DS} AS dataset, row_index, sha256(concat_ws(':', source.source_locator, row_index)) AS digest FROM sft_records)
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY digest, row_index) <= {PER_SOURCE}""",
    "per_split_preference_sample": f"""SELECT *, row_number() OVER (PARTITION BY split ORDER BY digest, row_index)::INT AS rank FROM (SELECT split, row_index, sha256(concat_ws(':', split, row_index, coalesce(prompt_id, ''))) AS digest FROM preference_triples)
QUALIFY row_number() OVER (PARTITION BY split ORDER BY digest, row_index) <= {PER_SOURCE}""",
    "round_robin_queue": f"""WITH f AS (SELECT dataset, row_index, digest FROM (SELECT {_hash('instruction')} AS k, row_index, {_DS} AS dataset, sha256(record_id) AS digest FROM sft_records) WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY row_index) = 1)
SELECT row_number() OVER (PARTITION BY dataset ORDER BY digest, row_index)::INT AS turn, dataset, row_index FROM f ORDER BY 1, 2 LIMIT {QUEUE}""",
    "stratified_sample": f"""WITH d AS (SELECT domain, doc_id, sha256('{SEED}:' || doc_id) AS digest FROM documents WHERE domain IS NOT NULL), t AS (SELECT count(*) AS total, least({STRATIFIED}, count(*)) AS n FROM d),
s AS (SELECT domain, count(*) * any_value(n) // any_value(total) AS q, count(*) * any_value(n) % any_value(total) AS r FROM d, t GROUP BY domain),
a AS (SELECT domain, q + (row_number() OVER (ORDER BY r DESC, domain) <= (SELECT any_value(n) FROM t) - (SELECT sum(q) FROM s))::INT AS quota FROM s)
SELECT domain, doc_id, place FROM (SELECT domain, doc_id, row_number() OVER (PARTITION BY domain ORDER BY digest, doc_id)::INT AS place FROM d) JOIN a USING (domain) WHERE place <= quota""",
    "single_key_selection": f"WITH {_SINGLE} SELECT * FROM f",
    "quota_split_fill": f"""WITH r AS (SELECT {_DS} AS dataset, row_index, split = 'test' AS kept, sha256({_DS} || ':' || row_index) AS digest FROM sft_records),
c AS (SELECT dataset, count(*) AS n, sum(kept::INT) AS t FROM r GROUP BY dataset),
p AS (SELECT *, row_number() OVER (PARTITION BY dataset, kept ORDER BY digest, row_index) - 1 AS place FROM r)
SELECT row_index, dataset, CASE WHEN kept THEN 'test' WHEN place < n - t - n * {SHARES['validation']} // 100 THEN 'train' ELSE 'validation' END AS assigned_split FROM p JOIN c USING (dataset)""",
    "group_split_assignment": f"""WITH g AS (SELECT DISTINCT source.source_locator AS locator FROM sft_records WHERE source.source_locator IS NOT NULL), n AS (SELECT count(*) AS n FROM g),
p AS (SELECT locator, row_number() OVER (ORDER BY sha256('protocol-1:' || locator), locator) - 1 AS place FROM g)
SELECT locator, CASE WHEN place < n * {SHARES['train']} // 100 THEN 'train' WHEN place < n * {SHARES['train']} // 100 + n * {SHARES['validation']} // 100 THEN 'validation' ELSE 'test' END AS split FROM p, n""",
    "cumulative_quotas": f"""WITH f AS (SELECT row_index, row_number() OVER (ORDER BY sha256('{SEED}:' || row_index)) - 1 AS place FROM sft_records QUALIFY place < 200)
SELECT row_index, place, CASE WHEN place < 40 THEN 'respiratory' WHEN place < 100 THEN 'cardiac' WHEN place < 150 THEN 'neurological' ELSE 'other' END AS family FROM f""",
    "review_batches": f"""WITH p AS (SELECT digest, (row_number() OVER (ORDER BY digest, record_id) - 1) // {BATCH} AS batch FROM (SELECT DISTINCT record_id, sha256('{SEED}:' || record_id) AS digest FROM sft_records))
SELECT batch, count(*) AS n_records, min(digest) AS first_digest, max(digest) AS last_digest FROM p GROUP BY batch""",
    "review_items": "SELECT source.source_locator AS locator, count(*) AS members, string_agg(DISTINCT coalesce(language, 'none'), ',' ORDER BY coalesce(language, 'none')) AS languages, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM sft_records GROUP BY 1",
    "authoring_candidates": f"WITH {_SINGLE} SELECT id, l AS requested_language, 'candidate-' || substr(sha256(id || ':' || l), 1, 24) AS candidate_id FROM f, (VALUES ('fr'), ('en')) AS v(l)",
    "greedy_quota_selection": f"""WITH RECURSIVE {_SFT}, r AS (SELECT dataset AS source, {_hash('instruction')} AS k1, {_hash(masked_sql("coalesce(instruction, '')"))} AS k2, sha256(dataset || ':' || record_id) AS ord, row_index AS id FROM sft),
c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source, ord, id) AS i, (SELECT count(DISTINCT q.k1) // 5 FROM r q WHERE q.source = r.source AND q.k1 <> '' AND q.k2 <> '') AS quota FROM r WHERE k1 <> '' AND k2 <> ''),
g(i, source, ord, id, n, one, two, take) AS (SELECT 0::BIGINT, ''::VARCHAR, ''::VARCHAR, 0::BIGINT, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false
UNION ALL SELECT i, source, ord, id, CASE WHEN take THEN had + 1 ELSE had END, CASE WHEN take THEN list_append(one, k1) ELSE one END, CASE WHEN take THEN list_append(two, k2) ELSE two END, take
FROM (SELECT c.i, c.source, c.ord, c.id, c.k1, c.k2, g.one, g.two, CASE WHEN g.source = c.source THEN g.n ELSE 0 END AS had,
NOT list_contains(g.one, c.k1) AND NOT list_contains(g.two, c.k2) AND CASE WHEN g.source = c.source THEN g.n ELSE 0 END < c.quota AS take FROM g JOIN c ON c.i = g.i + 1))
SELECT source, ord, id FROM g WHERE take""",
}
