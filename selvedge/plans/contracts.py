"""Queries over contracts of records, renderings, answers and recorded results."""

from __future__ import annotations

from pyspark.sql import functions as F

from selvedge.functions.arrays import any_value, map_difference, only_keys
from selvedge.functions.text import canonical_json, content_hash, emails_with_suffix, has_repeated_phrase, host_url, or_empty, placeholder_count, plain_words, sha, stable_key, strip, truncated
from selvedge.operators.artifacts import last_with, listed_rows, pending_fields, recomputed
from selvedge.operators.metrics import generation_summary
from selvedge.operators.privacy import ENTITIES, SERVING_ENTITIES, anonymized, findings, record_decisions
from selvedge.operators.ranking import smallest
from selvedge.operators.rendering import canonical_records, chat_text, messages, prompt_and_completion, render_json_turns
from selvedge.operators.splits import conversation_text
from selvedge.operators.validation import coverage, quota_violations, repeated_keys, revision_diff
from selvedge.plans.corpus import MAIL, masked_sql, STRIP, SYSTEM, _hash, _sft, left_over
from selvedge.session import materialize, table

LIMIT = 120
HOST = "example"
#: Fields of an exported payload, in the order they are asked for.
ASKED = ["record_id", "instruction", "response", "prompt", "golden_answer", "label_type", "language"]
SUFFIXES = ["com", "org"]
ENDS = ["day", "week", "weeks", "days", "jours", "semaines", "jour"]


def truncated_answers(spark, sf_dir):
    """Answers cut at LIMIT characters: how many were cut and the characters left, per split."""
    text, cut = truncated(or_empty("response"), LIMIT)
    return _sft(spark, sf_dir).select("split", text.alias("t"), cut.alias("c")).groupBy("split").agg(F.sum(F.col("c").cast("bigint")).alias("cut"), F.sum(F.length("t").cast("bigint")).alias("characters"))


def placeholder_counts(spark, sf_dir):
    """Bracketed placeholders in the texts after names of months are bracketed so, per split."""
    named = F.regexp_replace(or_empty("response"), r"\b(?:Dr|Nurse|Docteur)\b", "[NAME]")
    return _sft(spark, sf_dir).groupBy("split").agg(F.sum(placeholder_count(named).cast("bigint")).alias("placeholders"))


def document_hosts(spark, sf_dir):
    """Addresses below the example domain and how many documents each holds."""
    d = table(spark, sf_dir, "documents").select(host_url(F.concat(F.lit("fetched "), or_empty("url"), F.lit(" ok")), HOST).alias("host"))
    return d.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))


def payload_maps(spark, sf_dir):
    """Payloads with only known fields, with any value that is not null, and which fields differ between a payload and one without its label."""
    m = F.from_json("payload", "map<string,string>")
    rows = table(spark, sf_dir, "raw_payloads").where(F.json_object_keys("payload").isNotNull()).select("raw_id", m.alias("m"))
    differ = map_difference(F.col("m"), F.map_filter("m", lambda k, v: ~k.isin("label_type", "source")))
    return rows.select("raw_id", only_keys(F.col("m"), ASKED).alias("known_only"), any_value(F.col("m")).alias("has_value"), F.array_join(differ, ",").alias("differ"))


def pending_questions(spark, sf_dir):
    """The first two fields of each payload that are still to be asked for."""
    rows = table(spark, sf_dir, "raw_payloads").where(F.json_object_keys("payload").isNotNull())
    return rows.select("raw_id", F.array_join(pending_fields(F.json_object_keys("payload"), ASKED, 2), ",").alias("next_fields"))


def canonical_anchors(spark, sf_dir):
    """Records built anew from their anchors: id, digests of the texts and the operations they carry."""
    s = _sft(spark, sf_dir)
    anchors = s.select(F.col("dataset").alias("source"), F.col("row_index").cast("string").alias("source_record_id"), F.col("source.source_locator").alias("source_locator"), "language", F.col("instruction").alias("question"), F.col("response").alias("answer"))
    built = canonical_records(anchors, "anchor-", {"schema_version": "1", "intended_use": "training"}, ["selected", "normalised"])
    return built.select("record_id", "language", "schema_version", "intended_use", F.array_join("transformation.operations", ",").alias("operations"), "source.source_record_id", sha(or_empty("instruction")).alias("instruction_sha256"), sha(or_empty("response")).alias("response_sha256"))


def json_turns(spark, sf_dir):
    """Chat text with the context as JSON in the user turn and the target as JSON in the assistant turn."""
    rendered = render_json_turns(_sft(spark, sf_dir).select(F.col("row_index").cast("string").alias("record_id"), "language", "instruction", "response", "task_type"), SYSTEM, ["language", "instruction"], ["response", "task_type"])
    return rendered.select(F.col("record_id").cast("bigint").alias("row_index"), sha(chat_text(F.col("messages"))).alias("text_sha256"))


def prompt_completions(spark, sf_dir):
    """Texts parted into prompt and completion: rows that part, and characters of both, per split; a text without an answer has no completion."""
    prompt = chat_text(messages(("user", or_empty("instruction"))))
    whole = F.concat(prompt, or_empty("response"))
    left, right = prompt_and_completion(whole, prompt)
    rows = _sft(spark, sf_dir).select("split", left.alias("p"), right.alias("c"))
    return rows.groupBy("split").agg(F.count("c").alias("parted"), F.sum(F.length("p").cast("bigint")).alias("prompt_characters"), F.sum(F.length("c").cast("bigint")).alias("completion_characters"))


def request_digests(spark, sf_dir):
    """Digest of the canonical JSON of each request: fields in name order, nulls kept."""
    fields = {"prompt": F.lower("prompt"), "split": F.col("split"), "label_type": F.col("label_type")}
    return table(spark, sf_dir, "preference_triples").select("row_index", sha(canonical_json(fields)).alias("request_sha256"))


def listed_records(spark, sf_dir):
    """The records of a short list of row numbers, in its order."""
    sft = _sft(spark, sf_dir).select(F.col("row_index").cast("string").alias("id"), "record_id")
    ids = [r.id for r in smallest(sft.select("id", stable_key("list", F.col("id")).alias("k")), ["k", "id"], 25).orderBy("k", "id").collect()]  # a list of 25
    return listed_rows(sft, "id", ids).select("place", F.col("id").cast("bigint").alias("row_index"), "record_id")


def last_answered_delivery(spark, sf_dir):
    """The last delivery of each record that has an answer."""
    rows = _sft(spark, sf_dir).select("record_id", "row_index", F.nullif(strip(or_empty("response")), F.lit("")).alias("answer"))
    return last_with(rows, ["record_id"], "row_index", "answer").select("record_id", "row_index", sha("answer").alias("answer_sha256"))


def recorded_results(spark, sf_dir):
    """Per variant and source: counts of the losses recorded up to a day against those computed over all."""
    loss = table(spark, sf_dir, "loss_rows").select("variant", F.coalesce("source", F.lit("none")).alias("source"), "measured_at", "completion_tokens")
    count = lambda df: df.groupBy("variant", "source").agg(F.count(F.lit(1)).alias("observations"), F.sum("completion_tokens").alias("tokens"))
    middle = F.expr("timestamp_seconds((unix_seconds(min(cast(measured_at as timestamp))) + unix_seconds(max(cast(measured_at as timestamp)))) div 2)")
    day = loss.agg(F.date_format(middle, "yyyy-MM-dd").alias("d")).first().d
    early = loss.where(F.col("measured_at") < F.lit(day).cast("timestamp_ntz")) if day else loss
    return recomputed(count(early), count(loss), ["variant", "source"], ["observations", "tokens"]).select("variant", "source", F.array_join("changed", ",").alias("changed"))


def generation_groups(spark, sf_dir):
    """Chosen answers as outputs against the golden answers, by split and label and rolled up."""
    t = table(spark, sf_dir, "preference_triples")
    rows = t.select("split", F.coalesce("label_type", F.lit("none")).alias("label"), conversation_text(F.col("chosen")).alias("output"), F.col("metadata.golden_answer").alias("reference"))
    return generation_summary(rows.withColumn("tokens", plain_words(F.col("output"))), ["split", "label"], "tokens", "output", "reference", ENDS, 40).drop("repetition")


def record_coverage(spark, sf_dir):
    """Record ids that only the training split or only the others have, and ids delivered more than once."""
    s = _sft(spark, sf_dir)
    sides = coverage(s.where("split = 'train'"), s.where("split <> 'train'"), "record_id").groupBy("side").agg(F.count(F.lit(1)).alias("n_records"))
    again = repeated_keys(s, "record_id").agg(F.lit("repeated").alias("side"), F.count(F.lit(1)).alias("n_records"))
    return sides.unionByName(again)


def reserve_quotas(spark, sf_dir):
    """Splits and languages that do not hold the planned number of records, those without any included."""
    s = _sft(spark, sf_dir).select("split", F.substring(F.lower(F.coalesce("language", F.lit("none"))), 1, 2).alias("lang"))
    return quota_violations(s.where(F.col("lang").isin("fr", "en", "de")), ["split", "lang"], 100, {"split": ["train", "validation", "test"], "lang": ["fr", "en", "de"]})


def frozen_reserve(spark, sf_dir):
    """The test records frozen from the early deliveries against those found in all: what is kept, changed, new or gone."""
    s = _sft(spark, sf_dir).where("split = 'test'").select("record_id", "row_index", sha(F.concat_ws("\n", or_empty("instruction"), or_empty("response"))).alias("content"))
    half = F.col("row_index") % 2 == 0
    one = lambda df: df.groupBy("record_id").agg(F.min(F.struct("row_index", "content")).alias("r")).select("record_id", "r.content")
    return revision_diff(one(s.where(half)), one(s), "record_id", "content").groupBy("change").agg(F.count(F.lit(1)).alias("n_records"))


def ordered_words(spark, sf_dir):
    """Different words of each instruction in the order of their first use."""
    return _sft(spark, sf_dir).select("row_index", sha(F.array_join(F.array_distinct(plain_words(F.col("instruction"))), " ")).alias("words_sha256"))


def excluded_after_review(spark, sf_dir):
    """Records per split whose instruction a review took out: every record that shares its key goes too."""
    s = _sft(spark, sf_dir).select("row_index", "split", content_hash(F.col("instruction")).alias("k"))
    reviewed = s.where("row_index % 50 = 0 and k <> ''").select("k").distinct()
    kept = s.join(reviewed, "k", "left_anti")
    return kept.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.nullif("k", F.lit(""))).alias("n_keys"))


def mail_decisions(spark, sf_dir):
    """Public index of a mail audit: records with a direct identifier and without, and how many findings they have."""
    sft = materialize(_sft(spark, sf_dir).select("row_index", "instruction", "response"))
    _, public = record_decisions(sft, findings(sft, "row_index", ["instruction", "response"], {"EMAIL_ADDRESS": ENTITIES["EMAIL_ADDRESS"]}), "row_index", ["EMAIL_ADDRESS"])
    return public.select(F.col("id").alias("row_index"), "status", F.col("findings").cast("bigint").alias("findings"))


def anonymized_mail(spark, sf_dir):
    """Texts with their addresses of mail replaced, after a second look at the result."""
    found = anonymized(_sft(spark, sf_dir), "row_index", ["instruction", "response"], ["EMAIL_ADDRESS"])
    return found.select(F.col("id").alias("row_index"), "field", sha(or_empty("text")).alias("text_sha256"), "found", "left", "status")


def repeated_phrases(spark, sf_dir):
    """Answers in which a phrase of three to six words follows itself, per split."""
    rows = _sft(spark, sf_dir).select("split", has_repeated_phrase(plain_words(F.col("response"))).alias("r"))
    return rows.groupBy("split").agg(F.sum(F.col("r").cast("bigint")).alias("repeating"), F.count(F.lit(1)).alias("n_rows"))


def mail_suffixes(spark, sf_dir):
    """Addresses of mail below the listed suffixes, per split."""
    number = lambda c: F.sum(F.size(emails_with_suffix(c, SUFFIXES)).cast("bigint"))
    return _sft(spark, sf_dir).groupBy("split").agg(number("instruction").alias("in_instruction"), number("response").alias("in_response"))


def served_texts(spark, sf_dir):
    """How many texts per field and status hold entities of the serving policy."""
    found = anonymized(_sft(spark, sf_dir), "row_index", ["instruction", "response"], SERVING_ENTITIES)
    return found.groupBy("field", "status").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("found").alias("found"))


QUERIES = {
    f.__name__: f
    for f in (
        truncated_answers, placeholder_counts, document_hosts, payload_maps, pending_questions, canonical_anchors, json_turns, prompt_completions, request_digests, listed_records, last_answered_delivery, recorded_results,
        generation_groups, record_coverage, reserve_quotas, frozen_reserve, ordered_words, excluded_after_review, mail_decisions, anonymized_mail, repeated_phrases, mail_suffixes, served_texts,
    )
}

_WORDS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
_VALID = "SELECT raw_id, payload, json_keys(payload) AS keys FROM (SELECT raw_id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM raw_payloads) WHERE payload IS NOT NULL AND json_type(payload) = 'OBJECT'"
_ASKED = "[" + ", ".join(f"'{f}'" for f in ASKED) + "]"
_TEXTS = "t AS (SELECT row_index, 'instruction' AS field, instruction AS t FROM sft_records UNION ALL SELECT row_index, 'response', response FROM sft_records)"
_MAIL_PATTERN = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
_TURN = lambda role, c: f"'<|im_start|>{role}' || chr(10) || {c} || '<|im_end|>' || chr(10)"
_CHOSEN = "array_to_string(list_transform(chosen, lambda m: coalesce(m.content, '')), chr(10))"
SQL = {
    "truncated_answers": rf"""SELECT split, sum((length(coalesce(response, '')) > {LIMIT})::INT)::BIGINT AS cut,
sum(length(CASE WHEN length(coalesce(response, '')) > {LIMIT} THEN regexp_replace(substr(response, 1, {LIMIT}), '[\s\p{{Z}}]+$', '') ELSE coalesce(response, '') END))::BIGINT AS characters FROM sft_records GROUP BY split""",
    "placeholder_counts": r"SELECT split, sum(len(regexp_extract_all(regexp_replace(coalesce(response, ''), '\b(?:Dr|Nurse|Docteur)\b', '[NAME]', 'g'), '\[(?:NAME|LOCATION|CONTACT)\]')))::BIGINT AS placeholders FROM sft_records GROUP BY split",
    "document_hosts": rf"SELECT nullif(regexp_extract('fetched ' || coalesce(url, '') || ' ok', 'https://[a-z0-9-]+\.{HOST}'), '') AS host, count(*) AS n_docs FROM documents GROUP BY 1",
    "payload_maps": f"""WITH v AS ({_VALID}) SELECT raw_id, list_has_all({_ASKED}, keys) AS known_only, len(list_filter(keys, lambda k: json_type(payload, '$.' || k) <> 'NULL')) > 0 AS has_value,
array_to_string(list_sort(list_filter(list_distinct(keys), lambda k: k IN ('label_type', 'source'))), ',') AS differ FROM v""",
    "pending_questions": f"WITH v AS ({_VALID}) SELECT raw_id, array_to_string(list_filter({_ASKED}, lambda f: NOT list_contains(keys, f))[1:2], ',') AS next_fields FROM v",
    "canonical_anchors": """SELECT 'anchor-' || substr(sha256(coalesce(source.source_dataset, 'unknown') || ':' || row_index), 1, 24) AS record_id, language, '1' AS schema_version, 'training' AS intended_use, 'selected,normalised' AS operations, row_index::VARCHAR AS source_record_id,
sha256(coalesce(instruction, '')) AS instruction_sha256, sha256(coalesce(response, '')) AS response_sha256 FROM sft_records""",
    "json_turns": f"""SELECT row_index, sha256({_TURN('system', f"'{SYSTEM}'")} || {_TURN('user', "json_object('instruction', instruction, 'language', language)::VARCHAR")} ||
'<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || json_object('response', response, 'task_type', task_type)::VARCHAR || '<|im_end|>' || chr(10)) AS text_sha256 FROM sft_records""",
    "prompt_completions": f"""WITH p AS (SELECT split, {_TURN('user', "coalesce(instruction, '')")} AS p, coalesce(response, '') AS c FROM sft_records)
SELECT split, sum((c <> '')::INT)::BIGINT AS parted, sum(length(p))::BIGINT AS prompt_characters, sum(length(c))::BIGINT AS completion_characters FROM p GROUP BY split""",
    "request_digests": "SELECT row_index, sha256(json_object('label_type', label_type, 'prompt', lower(prompt), 'split', split)::VARCHAR) AS request_sha256 FROM preference_triples",
    "listed_records": "SELECT row_number() OVER (ORDER BY k, id) - 1 AS place, id::BIGINT AS row_index, record_id FROM (SELECT row_index::VARCHAR AS id, record_id, sha256('list:' || row_index) AS k FROM sft_records ORDER BY k, id LIMIT 25)",
    "last_answered_delivery": f"WITH a AS (SELECT record_id, row_index, nullif({STRIP.format('response')}, '') AS answer FROM sft_records) SELECT record_id, max(row_index) AS row_index, sha256(arg_max(answer, row_index)) AS answer_sha256 FROM a WHERE answer IS NOT NULL GROUP BY record_id",
    "recorded_results": """WITH l AS (SELECT variant, coalesce(source, 'none') AS source, measured_at, completion_tokens FROM loss_rows), d AS (SELECT date_trunc('day', make_timestamp(((epoch(min(measured_at))::BIGINT + epoch(max(measured_at))::BIGINT) // 2) * 1000000)) AS d FROM l),
c AS (SELECT variant, source, count(*) AS n, sum(completion_tokens) AS k FROM l GROUP BY 1, 2), r AS (SELECT variant, source, count(*) AS n, sum(completion_tokens) AS k FROM l, d WHERE measured_at < d.d GROUP BY 1, 2)
SELECT * FROM (SELECT variant, source, CASE WHEN r.n IS NULL THEN 'unrecorded' ELSE concat_ws(',', CASE WHEN r.n <> c.n THEN 'observations' END, CASE WHEN r.k IS DISTINCT FROM c.k THEN 'tokens' END) END AS changed FROM c LEFT JOIN r USING (variant, source)) WHERE changed <> ''""",
    "generation_groups": rf"""WITH g AS (SELECT split, coalesce(label_type, 'none') AS label, coalesce({_CHOSEN}, '') AS o, metadata.golden_answer AS r FROM preference_triples), w AS (SELECT *, {_WORDS.format('o')} AS w FROM g)
SELECT split, label, count(*) AS records, sum(({STRIP.format('o')} = '')::INT)::BIGINT AS empty_outputs, sum(coalesce(list_contains([{", ".join(f"'{e}'" for e in ENDS)}], w[-1]), false)::INT)::BIGINT AS ended, sum((len(w) = 40)::INT)::BIGINT AS reached_cap,
sum((regexp_replace(replace(lower(o), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', '', 'g') = regexp_replace(replace(lower(coalesce(r, '')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', '', 'g'))::INT)::BIGINT AS exact_matches FROM w GROUP BY ROLLUP (split, label)""",
    "record_coverage": """WITH k AS (SELECT record_id, bool_or(split = 'train') AS t, bool_or(split <> 'train') AS o, count(*) AS n FROM sft_records GROUP BY record_id)
SELECT CASE WHEN t THEN 'only_left' ELSE 'only_right' END AS side, count(*) AS n_records FROM k WHERE NOT (t AND o) GROUP BY 1 UNION ALL SELECT 'repeated', count(*) FROM k WHERE n > 1""",
    "reserve_quotas": """WITH e AS (SELECT * FROM (VALUES ('train'), ('validation'), ('test')) s(split), (VALUES ('fr'), ('en'), ('de')) l(lang)), c AS (SELECT split, substr(lower(coalesce(language, 'none')), 1, 2) AS lang, count(*) AS n FROM sft_records GROUP BY 1, 2)
SELECT split, lang, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (split, lang) WHERE coalesce(n, 0) <> 100""",
    "frozen_reserve": """WITH s AS (SELECT record_id, row_index, sha256(coalesce(instruction, '') || chr(10) || coalesce(response, '')) AS c FROM sft_records WHERE split = 'test'),
o AS (SELECT record_id, arg_min(c, row_index) AS c FROM s WHERE row_index % 2 = 0 GROUP BY 1), n AS (SELECT record_id, arg_min(c, row_index) AS c FROM s GROUP BY 1)
SELECT CASE WHEN o.c IS NULL THEN 'added' WHEN o.c = n.c THEN 'retained' ELSE 'changed' END AS change, count(*) AS n_records FROM n LEFT JOIN o USING (record_id) GROUP BY 1""",
    "ordered_words": f"""WITH w AS (SELECT row_index, {_WORDS.format('instruction')} AS w FROM sft_records)
SELECT row_index, sha256(array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ')) AS words_sha256 FROM w""",
    "excluded_after_review": f"""WITH s AS (SELECT row_index, split, {_hash('instruction')} AS k FROM sft_records)
SELECT split, count(*) AS n_rows, count(DISTINCT nullif(k, '')) AS n_keys FROM s WHERE k NOT IN (SELECT k FROM s WHERE row_index % 50 = 0 AND k <> '') GROUP BY split""",
    "mail_decisions": f"""WITH n AS (SELECT row_index, ({MAIL.format("coalesce(instruction, '')")} + {MAIL.format("coalesce(response, '')")})::BIGINT AS n FROM sft_records) SELECT row_index, CASE WHEN n > 0 THEN 'direct' ELSE 'clear' END AS status, n AS findings FROM n""",
    "anonymized_mail": f"""WITH {_TEXTS} SELECT row_index, field, sha256(coalesce(regexp_replace(t, '{_MAIL_PATTERN}', '<EMAIL_ADDRESS>', 'g'), '')) AS text_sha256, len(regexp_extract_all(coalesce(t, ''), '{_MAIL_PATTERN}'))::BIGINT AS found, 0::BIGINT AS "left",
CASE WHEN {STRIP.format('t')} = '' THEN 'empty' ELSE 'passed' END AS status FROM t""",
    "served_texts": f"""WITH {_TEXTS}, m AS (SELECT field, coalesce(t, '') AS t, {masked_sql("coalesce(t, '')")} AS m FROM t),
s AS (SELECT field, CASE WHEN {STRIP.format('t')} = '' THEN 'empty' WHEN {left_over('m')} THEN 'manual_review_required' ELSE 'passed' END AS status, len(regexp_extract_all(m, '<(?:{'|'.join(SERVING_ENTITIES)})>')) AS n FROM m)
SELECT field, status, count(*) AS n_texts, sum(n)::BIGINT AS found FROM s GROUP BY field, status""",
    "repeated_phrases": rf"""WITH w AS (SELECT split, {_WORDS.format('response')} AS w FROM sft_records)
SELECT split, sum(({' OR '.join(f"len(list_filter(range(1, greatest(len(w) - {2 * n - 2}, 1)), lambda i: w[i:i + {n - 1}] = w[i + {n}:i + {2 * n - 1}])) > 0" for n in (3, 4, 5, 6))})::INT)::BIGINT AS repeating, count(*) AS n_rows FROM w GROUP BY split""",
    "mail_suffixes": f"""SELECT split, {', '.join(f"sum(len(list_filter(regexp_extract_all(coalesce({c}, ''), '{_MAIL_PATTERN}'), lambda m: list_contains(['com', 'org'], lower(string_split(m, '.')[-1])))))::BIGINT AS in_{c}" for c in ('instruction', 'response'))} FROM sft_records GROUP BY split""",
}
