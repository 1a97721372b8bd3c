"""Queries over the record corpus: counts, audits, duplicates, splits, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.functions.arrays import first_difference, repeated_ngrams
from selvedge.functions.text import HTML_ENTITY, MASK_LEFT, REPEATED_WIDTH, TRUNCATED_FROM, content_hash, email_count, malformed_reasons, multiset_digest, norm_fast, or_empty, phone_count, plain_words, sha, strip
from selvedge.operators.keyed import cross_group_overlap, spanning_keys
from selvedge.operators.metrics import latest
from selvedge.operators.privacy import ENTITIES, NAME_EN, NAME_FR, findings, mask_spans, masked, privacy_status, span_violations
from selvedge.operators.splits import hash_split, isolate_groups
from selvedge.operators.validation import drift, reason_counts, revision_diff, violations
from selvedge.session import table

#: The system message of rendered training records.
SYSTEM = "You answer questions on medicine for a teaching project. Your answers are no diagnosis and no prescription."
OVER_LENGTH = 700


def _sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sft_records").withColumn("dataset", F.coalesce("source.source_dataset", F.lit("unknown")))


def corpus_counts(spark, sf_dir):
    """Rows by split, language and dataset, each alone and all together."""
    rows = _sft(spark, sf_dir).select("split", F.coalesce("language", F.lit("none")).alias("language"), "dataset")
    sets = [["split"], ["language"], ["dataset"], ["split", "language", "dataset"], []]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], "split", "language", "dataset").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n_rows"))


def source_profile(spark, sf_dir):
    """Per dataset and in total: filled and empty answers, over-long records, addresses of mail."""
    answer, both = strip(or_empty("response")), F.concat_ws("\n", or_empty("instruction"), or_empty("response"))
    longest = F.greatest(F.length(or_empty("instruction")), F.length(or_empty("response")))
    return _sft(spark, sf_dir).rollup("dataset").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum((answer != "").cast("bigint")).alias("filled"),
        F.sum((answer == "").cast("bigint")).alias("empty"),
        F.sum((longest > OVER_LENGTH).cast("bigint")).alias("over_length"),
        F.sum(email_count(both).cast("bigint")).alias("emails"),
    )


def duplicate_audit(spark, sf_dir):
    """Repeated normalised instructions per split, empty keys aside."""
    rows = _sft(spark, sf_dir).select("split", content_hash(F.col("instruction")).alias("k")).where("k <> ''")
    # counted per key first, so that no split's keys gather in one task
    keys = rows.groupBy("split", "k").agg(F.count(F.lit(1)).alias("c"))
    return keys.groupBy("split").agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("distinct_keys"), F.sum(F.col("c") - 1).alias("duplicates"))


def cross_split_overlap(spark, sf_dir):
    rows = _sft(spark, sf_dir).select("split", content_hash(F.col("instruction")).alias("k"))
    return cross_group_overlap(rows, "split", "k")


def cross_dataset_overlap(spark, sf_dir):
    rows = _sft(spark, sf_dir).select("dataset", content_hash(F.col("instruction")).alias("k"))
    return cross_group_overlap(rows, "dataset", "k")


def cross_split_groups(spark, sf_dir):
    """How many question and answer keys span two and three splits."""
    sft = _sft(spark, sf_dir)
    keys = sft.select("split", F.explode(F.array(F.concat(F.lit("q:"), content_hash(F.col("instruction"))), F.concat(F.lit("a:"), content_hash(F.col("response"))))).alias("k"))
    return spanning_keys(keys.where("length(k) > 2"), "k", "split").groupBy(F.substring("k", 1, 1).alias("kind"), "groups").agg(F.count(F.lit(1)).alias("n_keys"))


def hash_split_assignment(spark, sf_dir):
    return _sft(spark, sf_dir).select("row_index", hash_split(F.col("instruction")).alias("assigned_split"))


def content_group_isolation(spark, sf_dir):
    """Rows kept and removed per split when question, answer and record groups are isolated."""
    rows = _sft(spark, sf_dir).select(F.col("row_index").cast("string").alias("record_id"), "split", content_hash(F.col("instruction")).alias("q"), F.concat_ws(":", "dataset", F.nullif(content_hash(F.col("response")), F.lit(""))).alias("a"), F.col("record_id").alias("r"))
    keys = rows.select("record_id", F.explode(F.array_compact(F.array(F.when(F.col("q") != "", F.concat(F.lit("q:"), "q")), F.when(F.length("a") > 64, F.concat(F.lit("a:"), "a")), F.concat(F.lit("r:"), "r")))).alias("key"))
    return isolate_groups(rows.select("record_id", "split"), keys).groupBy("split", "kept").agg(F.count(F.lit(1)).alias("n_rows"))


def manifest_coverage(spark, sf_dir):
    """Records per admission status of their manifest, and how many differ from it in licence or language."""
    m = table(spark, sf_dir, "source_manifests").select("source_manifest_id", "admission_status", "source_license", "source_language")
    sft = _sft(spark, sf_dir).select(F.col("source.source_manifest_id").alias("mid"), F.col("source.source_license").alias("license"), F.substring(F.lower("language"), 1, 2).alias("lang"))
    # rows of a manifest are counted before the join
    rows = sft.groupBy("mid", "license", "lang").agg(F.count(F.lit(1)).alias("k"))
    joined = rows.join(m, rows.mid == m.source_manifest_id, "left")
    number = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    return joined.groupBy(F.coalesce("admission_status", F.lit("no_manifest")).alias("admission_status")).agg(
        F.sum("k").alias("n_rows"), number(~F.col("license").eqNullSafe(F.col("source_license"))).alias("license_differs"), number(F.col("lang") != F.col("source_language")).alias("language_differs")
    )


def record_contract_violations(spark, sf_dir):
    """Records that break the canonical schema, by rule."""
    rules = {
        "record_id": F.col("record_id").rlike("^sft-source-[a-f0-9]{24}$"),
        "language": F.col("language").isin("fr", "en"),
        "instruction": strip(or_empty("instruction")) != "",
        "response": strip(or_empty("response")) != "",
        "dataset": F.col("source.source_dataset").isNotNull(),
        "license": F.length(or_empty("source.source_license")) > 0,
        "operations": F.size("transformation.operations") == F.size(F.array_distinct("transformation.operations")),
        "not_truncated": ~F.col("transformation.content_truncated"),
        "split": F.col("split").isin("train", "validation", "test"),
        "no_triage_label": F.col("triage_label").isNull(),
    }
    return reason_counts(violations(_sft(spark, sf_dir), ["row_index"], rules))


_HALF = "2025-07-01"


def revision_changes(spark, sf_dir):
    """Record ids of the deliveries before July 2025 against those from then on."""
    sft = _sft(spark, sf_dir).select("record_id", "ingested_at", "row_index", sha(F.concat_ws("\n", or_empty("instruction"), or_empty("response"))).alias("content"))
    old = latest(sft.where(F.col("ingested_at") < F.lit(_HALF).cast("timestamp")), ["record_id"], ["ingested_at", "row_index"], ["content"])
    new = latest(sft.where(F.col("ingested_at") >= F.lit(_HALF).cast("timestamp")), ["record_id"], ["ingested_at", "row_index"], ["content"])
    return revision_diff(old, new, "record_id", "content").groupBy("change").agg(F.count(F.lit(1)).alias("n_records"))


def redelivery_drift(spark, sf_dir):
    """Of the records delivered more than once, how many changed in which fields between first and last delivery."""
    sft = _sft(spark, sf_dir).select("record_id", "ingested_at", "row_index", "instruction", "response", "split", "language")
    fields = ["instruction", "response", "split", "language"]
    last = latest(sft, ["record_id"], ["ingested_at", "row_index"], fields)
    first = sft.groupBy("record_id").agg(F.min(F.struct("ingested_at", "row_index", *fields)).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1").select("record_id", *[f"r.{f}" for f in fields])
    return drift(first, last, "record_id", fields).select(F.array_join("changed", ",").alias("changed")).groupBy("changed").agg(F.count(F.lit(1)).alias("n_records"))


def redelivery_first_difference(spark, sf_dir):
    """Where the words of first and last delivery of a record part."""
    sft = _sft(spark, sf_dir).select("record_id", "ingested_at", "row_index", "response")
    pair = sft.groupBy("record_id").agg(F.min(F.struct("ingested_at", "row_index", "response")).alias("a"), F.max(F.struct("ingested_at", "row_index", "response")).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pair.select("record_id", first_difference(plain_words(F.col("a.response")), plain_words(F.col("b.response"))).alias("first_difference"))


def rendered_records(spark, sf_dir):
    """Chat text of training and validation records: digest, length and where the completion starts; test stays out."""
    rows = _sft(spark, sf_dir).where("task_type = 'medical_qa_sft' and split <> 'test'")
    prompt = F.concat(F.lit(f"<|im_start|>system\n{SYSTEM}<|im_end|>\n<|im_start|>user\n"), or_empty("instruction"), F.lit("<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"))
    text = F.concat(prompt, or_empty("response"), F.lit("<|im_end|>\n"))
    return rows.select("row_index", sha(text).alias("rendered_sha256"), F.length(text).alias("n_characters"), F.length(prompt).alias("completion_start"))


def dataset_digest(spark, sf_dir):
    """One digest per split that depends on the set of its rows and not on their order or files."""
    row = sha(F.concat_ws("|", "row_index", "record_id", or_empty("instruction"), or_empty("response")))
    rows = _sft(spark, sf_dir).select("split", row.alias("d"))
    return rows.groupBy("split").agg(multiset_digest(F.col("d")).alias("digest"), F.count(F.lit(1)).alias("n_rows"))


def ngram_repetition(spark, sf_dir):
    """4-grams of responses and how many repeat an earlier one of the same response, per dataset."""
    rows = _sft(spark, sf_dir).select("dataset", repeated_ngrams(plain_words(F.col("response")), 4).alias("c"))
    return rows.groupBy("dataset").agg(F.sum("c.grams").alias("grams"), F.sum("c.repeated").alias("repeated"))


def malformed_outputs(spark, sf_dir):
    return _sft(spark, sf_dir).select("split", F.explode(malformed_reasons(F.col("response"))).alias("reason")).groupBy("split", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def email_counts(spark, sf_dir):
    return _sft(spark, sf_dir).groupBy("split").agg(F.sum(email_count(or_empty("instruction")).cast("bigint")).alias("in_instruction"), F.sum(email_count(or_empty("response")).cast("bigint")).alias("in_response"))


def phone_counts(spark, sf_dir):
    return _sft(spark, sf_dir).groupBy("split").agg(F.sum(phone_count(or_empty("instruction")).cast("bigint")).alias("in_instruction"), F.sum(phone_count(or_empty("response")).cast("bigint")).alias("in_response"))


def identifier_audit(spark, sf_dir):
    """Direct identifiers by pattern per split, and the privacy status after masking."""
    both = F.concat_ws("\n", or_empty("instruction"), or_empty("response"))
    rows = _sft(spark, sf_dir).select("split", both.alias("both")).select("split", "both", masked(F.col("both")).alias("masked"))
    # the placeholders say what was found, so the patterns run once
    number = {k: F.sum(F.regexp_count("masked", F.lit(f"<{k}>")).cast("bigint")).alias(k.lower()) for k in ENTITIES}
    return rows.groupBy("split", privacy_status(F.col("masked")).alias("status")).agg(F.count(F.lit(1)).alias("n_rows"), *number.values())


def masked_records(spark, sf_dir):
    """Records with their direct identifiers masked, where there are any."""
    both = {f: masked(or_empty(f)) for f in ("instruction", "response")}
    return _sft(spark, sf_dir).select("row_index", *[c.alias(f) for f, c in both.items()], (both["instruction"] != or_empty("instruction")).alias("instruction_changed"), (both["response"] != or_empty("response")).alias("response_changed")).where("instruction_changed or response_changed")


def masked_spans(spark, sf_dir):
    """E-mail findings masked by their spans, after a check that every span is the text at its place."""
    sft = _sft(spark, sf_dir)
    found = findings(sft, "row_index", ["instruction", "response"], {"EMAIL_ADDRESS": ENTITIES["EMAIL_ADDRESS"]})
    texts = sft.select(F.col("row_index").alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("instruction", "response")])).alias("p")).select("id", "p.field", "p.text")
    bad = span_violations(texts, found).select("id", "field").distinct()
    good = texts.join(bad, ["id", "field"], "left_anti")
    return mask_spans(good, found, "<EMAIL_ADDRESS>").where("masked > 0").select("id", "field", sha("text").alias("text_sha256"), F.col("masked").cast("bigint").alias("masked"))


def document_profile(spark, sf_dir):
    """Documents, characters, blank texts and wrong n_chars per source and domain."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", F.coalesce("domain", F.lit("none")).alias("domain")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.length(or_empty("text")).cast("bigint")).alias("n_characters"), F.sum((strip(or_empty("text")) == "").cast("bigint")).alias("blank"), F.sum((~F.col("n_chars").eqNullSafe(F.length("text").cast("bigint"))).cast("bigint")).alias("wrong_n_chars")
    )


def document_duplicates(spark, sf_dir):
    """Documents with equal normalised text: how many sets of which size."""
    d = table(spark, sf_dir, "documents").select(content_hash(F.col("text")).alias("k")).where("k <> ''")
    return d.groupBy("k").agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("n_sets"))


def protected_anti_join(spark, sf_dir):
    """Training records whose instruction is in no held-out split of either table, per dataset."""
    sft = _sft(spark, sf_dir).select("dataset", "split", content_hash(F.col("instruction")).alias("k"))
    pref = table(spark, sf_dir, "preference_triples").where("split <> 'train'").select(content_hash(F.col("prompt")).alias("k"))
    protected = sft.where("split <> 'train'").select("k").unionByName(pref).where("k <> ''").distinct()
    train = sft.where("split = 'train' and k <> ''")
    return train.join(protected, "k", "left_anti").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("k").alias("distinct_keys"))


QUERIES = {f.__name__: f for f in (corpus_counts, source_profile, duplicate_audit, cross_split_overlap, cross_dataset_overlap, cross_split_groups, hash_split_assignment, content_group_isolation, manifest_coverage, record_contract_violations, revision_changes, redelivery_drift, redelivery_first_difference, rendered_records, dataset_digest, ngram_repetition, malformed_outputs, email_counts, phone_counts, identifier_audit, masked_records, masked_spans, document_profile, document_duplicates, protected_anti_join)}

NORM = r"regexp_replace(replace(lower(coalesce({}, '')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
STRIP = r"regexp_replace(coalesce({}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
MAIL = r"len(regexp_extract_all({}, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b'))"
#: A mark after every character that is no digit lets a pattern see what stands before and after a number without taking it.
MARK = "chr(1)"
PHONE_MARKED = r"(^|\x01)(?:(?:\+\x01)?1(?:[ .-]\x01)?)?(?:(?:\(\x01)?\d{3}(?:\)\x01)?(?:[ .-]\x01)?)\d{3}[ .-]\x01\d{4}($|[^\d])"
MARKED = r"regexp_replace({}, '([^\d])', '\1' || chr(1), 'g')"
PHONES = lambda c: rf"len(regexp_extract_all({MARKED.format(c)}, '{PHONE_MARKED}'))"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def masked_sql(c: str) -> str:
    """masked() in SQL: the last boundary of a name takes the next character and puts it back."""
    for k, p in ENTITIES.items():
        if k == "PHONE_NUMBER":
            c = rf"replace(regexp_replace({MARKED.format(c)}, '{PHONE_MARKED}', '\1<PHONE_NUMBER>\2', 'g'), chr(1), '')"
        elif k == "PATIENT_NAME":
            names = "|".join(n.removesuffix(r"\b") for n in (NAME_FR, NAME_EN))
            c = rf"regexp_replace({c}, '(?i)(?:{_quoted(names)})($|[^\p{{L}}\p{{N}}_])', '<{k}>\1', 'g')"
        else:
            c = rf"regexp_replace({c}, '{_quoted(p.replace('(?iu)', '(?i)'))}', '<{k}>', 'g')"
    return c


def left_over(c: str) -> str:
    """Whether a masked text still matches outside its placeholders."""
    bare = f"regexp_replace({c}, '<(?:{'|'.join(ENTITIES)})>', ' ', 'g')"
    return f"{masked_sql(bare)} <> {bare}"


#: The digest of a set of row digests d.
MULTISET = "sha256(concat_ws(',', " + ", ".join(f"sum(('0x' || substr(d, {1 + 16 * k}, 16))::UBIGINT::HUGEINT)::VARCHAR" for k in range(4)) + ", count(d)::VARCHAR))"
_SFT = "sft AS (SELECT *, coalesce(source.source_dataset, 'unknown') AS dataset FROM sft_records)"


def _hash(c: str) -> str:
    n = NORM.format(c)
    return f"CASE WHEN {n} = '' THEN '' ELSE sha256({n}) END"


def _overlap(group: str) -> str:
    return f"""WITH {_SFT}, s AS (SELECT DISTINCT {group} AS g, {_hash('instruction')} AS k FROM sft)
SELECT a.g AS left_group, b.g AS right_group, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.g < b.g WHERE a.k <> '' GROUP BY 1, 2"""


_FIRST_LAST = "SELECT record_id, count(*) AS n, {} FROM sft_records GROUP BY record_id HAVING count(*) > 1"
SQL = {
    "corpus_counts": f"""WITH {_SFT}, s AS (SELECT split, coalesce(language, 'none') AS language, dataset FROM sft)
SELECT split, language, dataset, grouping(split, language, dataset) AS gid, count(*) AS n_rows FROM s
GROUP BY GROUPING SETS ((split), (language), (dataset), (split, language, dataset), ())""",
    "source_profile": f"""WITH {_SFT} SELECT dataset, count(*) AS pairs, sum(({STRIP.format('response')} <> '')::INT)::BIGINT AS filled, sum(({STRIP.format('response')} = '')::INT)::BIGINT AS empty,
sum((greatest(length(coalesce(instruction, '')), length(coalesce(response, ''))) > {OVER_LENGTH})::INT)::BIGINT AS over_length,
sum({MAIL.format("coalesce(instruction, '') || chr(10) || coalesce(response, '')")})::BIGINT AS emails FROM sft GROUP BY ROLLUP (dataset)""",
    "duplicate_audit": f"SELECT split, count(*) AS n_rows, count(DISTINCT k) AS distinct_keys, count(*) - count(DISTINCT k) AS duplicates FROM (SELECT split, {_hash('instruction')} AS k FROM sft_records) WHERE k <> '' GROUP BY split",
    "cross_split_overlap": _overlap("split"),
    "cross_dataset_overlap": _overlap("dataset"),
    "cross_split_groups": f"""WITH k AS (SELECT split, 'q' AS kind, {_hash('instruction')} AS k FROM sft_records UNION ALL SELECT split, 'a', {_hash('response')} FROM sft_records)
SELECT kind, groups, count(*) AS n_keys FROM (SELECT kind, k, count(DISTINCT split) AS groups FROM k WHERE k <> '' GROUP BY kind, k HAVING count(DISTINCT split) > 1) GROUP BY kind, groups""",
    "hash_split_assignment": r"""SELECT row_index, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END AS assigned_split
FROM (SELECT row_index, ('0x' || substr(sha256(regexp_replace(lower(coalesce(instruction, '')), '[^\p{L}\p{N}_]+', '', 'g')), 1, 8))::BIGINT % 100 AS b FROM sft_records)""",
    "manifest_coverage": """SELECT coalesce(m.admission_status, 'no_manifest') AS admission_status, count(*) AS n_rows, sum((s.source.source_license IS DISTINCT FROM m.source_license)::INT)::BIGINT AS license_differs,
sum(coalesce(substr(lower(s.language), 1, 2) <> m.source_language, false)::INT)::BIGINT AS language_differs
FROM sft_records s LEFT JOIN source_manifests m ON s.source.source_manifest_id = m.source_manifest_id GROUP BY 1""",
    "record_contract_violations": f"""WITH r AS (SELECT unnest([CASE WHEN NOT coalesce(regexp_matches(record_id, '^sft-source-[a-f0-9]{{24}}$'), false) THEN 'record_id' END,
CASE WHEN NOT coalesce(language IN ('fr', 'en'), false) THEN 'language' END, CASE WHEN {STRIP.format('instruction')} = '' THEN 'instruction' END, CASE WHEN {STRIP.format('response')} = '' THEN 'response' END,
CASE WHEN source.source_dataset IS NULL THEN 'dataset' END, CASE WHEN coalesce(source.source_license, '') = '' THEN 'license' END,
CASE WHEN NOT coalesce(len(transformation.operations) = len(list_distinct(transformation.operations)), false) THEN 'operations' END,
CASE WHEN NOT coalesce(NOT transformation.content_truncated, false) THEN 'not_truncated' END,
CASE WHEN NOT coalesce(split IN ('train', 'validation', 'test'), false) THEN 'split' END, CASE WHEN triage_label IS NOT NULL THEN 'no_triage_label' END]) AS reason FROM sft_records)
SELECT reason, count(*) AS n_rows FROM r WHERE reason IS NOT NULL GROUP BY reason""",
    "revision_changes": f"""WITH s AS (SELECT record_id, ingested_at, row_index, sha256(coalesce(instruction, '') || chr(10) || coalesce(response, '')) AS content FROM sft_records),
o AS (SELECT record_id, arg_max(content, (ingested_at, row_index)) AS content FROM s WHERE ingested_at < TIMESTAMP '{_HALF}' GROUP BY record_id),
n AS (SELECT record_id, arg_max(content, (ingested_at, row_index)) AS content FROM s WHERE ingested_at >= TIMESTAMP '{_HALF}' GROUP BY record_id)
SELECT CASE WHEN n.record_id IS NULL THEN 'removed' WHEN o.record_id IS NULL THEN 'added' WHEN o.content = n.content THEN 'retained' ELSE 'changed' END AS change, count(*) AS n_records
FROM o FULL OUTER JOIN n ON o.record_id = n.record_id GROUP BY 1""",
    "redelivery_drift": f"""WITH d AS ({_FIRST_LAST.format("arg_min(struct_pack(i := instruction, r := response, s := split, l := language), (ingested_at, row_index)) AS a, arg_max(struct_pack(i := instruction, r := response, s := split, l := language), (ingested_at, row_index)) AS b")}),
c AS (SELECT concat_ws(',', CASE WHEN a.i IS DISTINCT FROM b.i THEN 'instruction' END, CASE WHEN a.r IS DISTINCT FROM b.r THEN 'response' END, CASE WHEN a.s IS DISTINCT FROM b.s THEN 'split' END, CASE WHEN a.l IS DISTINCT FROM b.l THEN 'language' END) AS changed FROM d)
SELECT changed, count(*) AS n_records FROM c WHERE changed <> '' GROUP BY changed""",
    "rendered_records": f"""WITH p AS (SELECT row_index, '<|im_start|>system' || chr(10) || '{SYSTEM}<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(instruction, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) AS prompt, coalesce(response, '') AS response
FROM sft_records WHERE task_type = 'medical_qa_sft' AND split <> 'test')
SELECT row_index, sha256(prompt || response || '<|im_end|>' || chr(10)) AS rendered_sha256, length(prompt || response || '<|im_end|>' || chr(10))::INT AS n_characters, length(prompt)::INT AS completion_start FROM p""",
    "dataset_digest": f"""WITH r AS (SELECT split, sha256(concat_ws('|', row_index, record_id, coalesce(instruction, ''), coalesce(response, ''))) AS d FROM sft_records)
SELECT split, {MULTISET} AS digest, count(*) AS n_rows FROM r GROUP BY split""",
    "ngram_repetition": rf"""WITH {_SFT}, w AS (SELECT dataset, list_filter(string_split_regex(lower(coalesce(response, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS w FROM sft),
g AS (SELECT dataset, list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i+3], ' ')) AS g FROM w)
SELECT dataset, sum(len(g))::BIGINT AS grams, sum(len(g) - len(list_distinct(g)))::BIGINT AS repeated FROM g GROUP BY dataset""",
    "email_counts": f"SELECT split, sum({MAIL.format("coalesce(instruction, '')")})::BIGINT AS in_instruction, sum({MAIL.format("coalesce(response, '')")})::BIGINT AS in_response FROM sft_records GROUP BY split",
    "masked_spans": r"""WITH t AS (SELECT row_index AS id, 'instruction' AS field, coalesce(instruction, '') AS t FROM sft_records UNION ALL SELECT row_index, 'response', coalesce(response, '') FROM sft_records),
m AS (SELECT id, field, t, len(regexp_extract_all(t, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS n FROM t)
SELECT id, field, sha256(regexp_replace(t, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '<EMAIL_ADDRESS>', 'g')) AS text_sha256, n AS masked FROM m WHERE n > 0""",
    "document_profile": f"SELECT source, coalesce(domain, 'none') AS domain, count(*) AS n_docs, sum(length(coalesce(text, '')))::BIGINT AS n_characters, sum(({STRIP.format('text')} = '')::INT)::BIGINT AS blank, sum((n_chars IS DISTINCT FROM length(text))::INT)::BIGINT AS wrong_n_chars FROM documents GROUP BY 1, 2",
    "document_duplicates": f"SELECT copies, count(*) AS n_sets FROM (SELECT k, count(*) AS copies FROM (SELECT {_hash('text')} AS k FROM documents) WHERE k <> '' GROUP BY k) GROUP BY copies",
    "protected_anti_join": f"""WITH {_SFT}, s AS (SELECT dataset, split, {_hash('instruction')} AS k FROM sft), p AS (SELECT k FROM s WHERE split <> 'train' UNION SELECT {_hash('prompt')} FROM preference_triples WHERE split <> 'train')
SELECT dataset, count(*) AS n_rows, count(DISTINCT k) AS distinct_keys FROM s WHERE split = 'train' AND k <> '' AND k NOT IN (SELECT k FROM p) GROUP BY dataset""",
    "phone_counts": f"SELECT split, sum({PHONES("coalesce(instruction, '')")})::BIGINT AS in_instruction, sum({PHONES("coalesce(response, '')")})::BIGINT AS in_response FROM sft_records GROUP BY split",
    "malformed_outputs": rf"""WITH w AS (SELECT split, coalesce(response, '') AS t, list_filter(string_split_regex(lower(coalesce(response, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS w FROM sft_records),
r AS (SELECT split, unnest([CASE WHEN regexp_matches(t, '{HTML_ENTITY}') THEN 'html_entity' END, CASE WHEN regexp_matches(t, '{MASK_LEFT}') THEN 'placeholder' END,
CASE WHEN len(list_filter(range(1, greatest(len(w) - {2 * REPEATED_WIDTH - 2}, 1)), lambda i: w[i:i + {REPEATED_WIDTH - 1}] = w[i + {REPEATED_WIDTH}:i + {2 * REPEATED_WIDTH - 1}])) > 0 THEN 'repeated_phrase' END,
CASE WHEN length(t) >= {TRUNCATED_FROM} AND regexp_matches(t, '[\p{{L}}\p{{N}}]$') THEN 'likely_truncated' END]) AS reason FROM w)
SELECT split, reason, count(*) AS n_rows FROM r WHERE reason IS NOT NULL GROUP BY split, reason""",
    "redelivery_first_difference": r"""WITH w AS (SELECT record_id, ingested_at, row_index, list_filter(string_split_regex(lower(coalesce(response, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM sft_records),
p AS (SELECT record_id, arg_min(w, (ingested_at, row_index)) AS a, arg_max(w, (ingested_at, row_index)) AS b FROM w GROUP BY record_id HAVING count(*) > 1),
d AS (SELECT *, list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])[1] AS place FROM p)
SELECT record_id, coalesce(place - 1, CASE WHEN len(a) <> len(b) THEN least(len(a), len(b)) END) AS first_difference FROM d""",
    "masked_records": f"""WITH m AS (SELECT row_index, coalesce(instruction, '') AS i, coalesce(response, '') AS r, {masked_sql("coalesce(instruction, '')")} AS mi, {masked_sql("coalesce(response, '')")} AS mr FROM sft_records)
SELECT row_index, mi AS instruction, mr AS response, mi <> i AS instruction_changed, mr <> r AS response_changed FROM m WHERE mi <> i OR mr <> r""",
    "identifier_audit": f"""WITH m AS (SELECT split, {masked_sql("coalesce(instruction, '') || chr(10) || coalesce(response, '')")} AS m FROM sft_records),
s AS (SELECT split, m, CASE WHEN trim(m) = '' THEN 'empty' WHEN {left_over('m')} THEN 'manual_review_required' ELSE 'passed' END AS status FROM m)
SELECT split, status, count(*) AS n_rows, {', '.join(f"sum(len(regexp_extract_all(m, '<{k}>')))::BIGINT AS {k.lower()}" for k in ENTITIES)} FROM s GROUP BY split, status""",
    "content_group_isolation": f"""WITH RECURSIVE {_SFT}, h AS (SELECT row_index AS id, split, record_id, {_hash('instruction')} AS q, dataset, {_hash('response')} AS a FROM sft),
k AS (SELECT id, 'q:' || q AS k FROM h WHERE q <> '' UNION ALL SELECT id, 'a:' || dataset || ':' || a FROM h WHERE a <> '' UNION ALL SELECT id, 'r:' || record_id FROM h),
f AS (SELECT k, min(id) AS f FROM k GROUP BY k), e AS (SELECT DISTINCT id AS a, f AS b FROM k JOIN f USING (k) WHERE id <> f), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, c) AS (SELECT id, id FROM h UNION SELECT w.b, r.c FROM r JOIN both_ways w ON r.id = w.a WHERE r.c < w.b), g AS (SELECT id, min(c) AS c FROM r GROUP BY id),
x AS (SELECT h.split, g.c, CASE h.split WHEN 'test' THEN 2 WHEN 'validation' THEN 1 ELSE 0 END AS rank FROM h JOIN g USING (id))
SELECT split, rank = top AS kept, count(*) AS n_rows FROM (SELECT *, max(rank) OVER (PARTITION BY c) AS top FROM x) GROUP BY 1, 2""",
}
