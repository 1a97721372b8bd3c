"""Queries that write tables in the exchange formats to the shared folder and read them again."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from selvedge.functions.text import content_hash, or_empty
from selvedge.plans.corpus import MULTISET, NORM, STRIP, _hash, _sft
from selvedge.session import materialize, shared_dir, table, track
from selvedge.sources import readers, writers

#: Records of one written XML document.
PER_DOCUMENT = 40
#: Folders of the splits below the root of the XML documents.
SUBSETS = {"train": "1_train", "validation": "2_validation", "test": "3_test"}
#: Characters that XML 1.0 does not allow, for both regular expression engines.
NO_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"


def _folder(spark, name):
    path = f"{shared_dir(spark).rstrip('/')}/selvedge-files-{uuid.uuid4().hex}"
    track(path)
    return f"{path}/{name}"


def _xml(c):
    text = F.regexp_replace(or_empty(c), NO_XML, "")
    for raw, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def jsonl_artifact(spark, sf_dir):
    """Rows, bytes and set digest of the records written as JSON lines."""
    rows = table(spark, sf_dir, "sft_records").select("row_index", "record_id", "language", "instruction", "response", "split")
    found = writers.write_jsonl(rows, _folder(spark, "records"))
    return spark.range(1).select(F.lit(found["record_count"]).cast("bigint").alias("record_count"), F.lit(found["byte_size"]).cast("bigint").alias("byte_size"), F.lit(found["sha256"]).alias("sha256"))


def csv_export(spark, sf_dir):
    """Records flattened to CSV and read again."""
    path = _folder(spark, "csv")
    writers.write_flat_csv(table(spark, sf_dir, "sft_records").select("row_index", F.struct("source.source_dataset", "source.source_license").alias("source"), F.col("transformation.operations").alias("operations")), path)
    return spark.read.option("header", True).schema("row_index bigint, source_source_dataset string, source_source_license string, operations string").csv(path)


def text_free_records(spark, sf_dir):
    """Ids with a digest of the texts, which stay behind."""
    return writers.text_free_index(table(spark, sf_dir, "sft_records"), ["row_index", "record_id", "split"], ["instruction", "response"])


def payload_lines(spark, sf_dir):
    """Lines of the exported payloads: all, blank or bad ones by the line reader, and objects by the tolerant reader."""
    path = _folder(spark, "payloads")
    table(spark, sf_dir, "raw_payloads").select(F.regexp_replace(or_empty("payload"), r"[\r\n]+", " ").alias("value")).write.text(path)
    lines = readers.numbered_lines(spark, path)
    bad = readers.bad_json_lines(spark, path)
    good = readers.read_jsonl(spark, path, "record_id string, prompt_id string, _corrupt_record string", strict=False)
    counts = [
        lines.agg(F.count(F.lit(1)).alias("n_lines")),
        bad.agg(F.count(F.lit(1)).alias("bad"), F.countDistinct("file", "line").alias("places")),
        good.where("_corrupt_record is null").agg(F.count("record_id").alias("records"), F.count("prompt_id").alias("prompts")),
    ]
    return reduce(lambda x, y: x.unionByName(y, True), counts).agg(*[F.max(c).alias(c) for x in counts for c in x.columns])  # one row each


def _choice_files(spark, sf_dir):
    """Choice questions made of records, by split: three options and a list of correct letters."""
    path = _folder(spark, "choice")
    sft = _sft(spark, sf_dir)
    correct = F.element_at(F.array(*map(F.lit, ["a", "B, c", "d", "x,a"])), (F.col("row_index") % 4 + 1).cast("int"))
    rows = sft.select(
        "split", F.col("row_index").cast("string").alias("id"), F.when(F.col("row_index") % 3 == 0, F.col("language")).alias("clinical_case"), "instruction", F.col("dataset").alias("answer_a"), F.substring("response", 1, 30).alias("answer_b"), F.col("task_type").alias("answer_c"), correct.alias("correct_answers")
    ).withColumnRenamed("instruction", "question")
    for split in SUBSETS:
        rows.where(F.col("split") == split).drop("split").write.json(f"{path}/{split}", ignoreNullFields=False)
    return path


def choice_questions(spark, sf_dir):
    """Choice questions with their correct answers, without those of the protected test part."""
    path = _choice_files(spark, sf_dir)
    found = readers.read_choice_questions(spark, [f"{path}/train", f"{path}/validation"], [f"{path}/test"])
    return found.select(F.element_at(F.split("locator", ":"), -1).cast("bigint").alias("row_index"), F.sha2("question", 256).alias("question_sha256"), "answer")


def choice_audit(spark, sf_dir):
    """Counts of the choice question files per part."""
    path = _choice_files(spark, sf_dir)
    out = None
    for split in SUBSETS:
        rows = readers.read_jsonl(spark, f"{path}/{split}", "id string, clinical_case string, question string, correct_answers string").withColumn("part", F.lit(split))
        out = rows if out is None else out.unionByName(rows)
    return readers.audit_choice_questions(out, ["part"])


def option_maps(spark, sf_dir):
    """Evaluation items as one JSON array of questions with an option map, read again; the table is fixed in size."""
    path = _folder(spark, "options")
    items = table(spark, sf_dir, "eval_items")
    options = F.create_map(F.lit("A"), F.col("suite"), F.lit("B"), F.col("lang"))
    correct = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).when(F.col("item_id") % 3 == 1, F.array(F.lit("B"))).otherwise(F.array(F.lit("Z")))
    rows = items.select(F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), options.alias("answers"), correct.alias("correct_answers"))).alias("o"))
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list("o"), ","), F.lit("]")).alias("value")).write.text(path)
    found = readers.read_option_maps(spark, path)
    return found.select(F.col("locator").cast("bigint").alias("item_id"), F.sha2("question", 256).alias("question_sha256"), "answer")


def _xml_documents(spark, sf_dir):
    """Question and answer documents of PER_DOCUMENT records each, one file a document, in a folder a split."""
    path = _folder(spark, "xml")
    pair = F.concat(F.lit('<QAPair pid="'), F.col("row_index").cast("string"), F.lit('"><Question qtype="'), _xml(F.col("task_type")), F.lit('">'), _xml(F.col("instruction")), F.lit("</Question><Answer>"), _xml(F.col("response")), F.lit("</Answer></QAPair>"))
    docs = _sft(spark, sf_dir).select("split", F.expr(f"row_index div {PER_DOCUMENT}").alias("doc"), pair.alias("pair")).groupBy("split", "doc").agg(F.array_join(F.collect_list("pair"), "").alias("pairs"))
    docs = materialize(docs.select("split", F.concat(F.lit("<Document><QAPairs>"), "pairs", F.lit("</QAPairs></Document>")).alias("value")))
    for split, folder in SUBSETS.items():
        docs.where(F.col("split") == split).select(F.regexp_replace("value", r"[\r\n]+", " ").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/{folder}")
    return path


def qa_documents(spark, sf_dir):
    """Filled question and answer pairs of the XML documents."""
    found = readers.read_qa_documents(spark, _xml_documents(spark, sf_dir), glob="*.txt")
    return found.select("subset", F.element_at(F.split("locator", ":"), -1).cast("bigint").alias("row_index"), "question_type", content_hash(F.col("question")).alias("question_key"), content_hash(F.col("answer")).alias("answer_key"))


def qa_documents_audit(spark, sf_dir):
    return readers.audit_qa_documents(spark, _xml_documents(spark, sf_dir), glob="*.txt").drop("files")


def scored_pairs(spark, sf_dir):
    """Labelled pairs of the triples as XML, read again and counted by label."""
    path = _folder(spark, "pairs")
    pair = F.concat(F.lit('<pair pid="'), F.col("row_index").cast("string"), F.lit('" value="'), _xml(F.col("label_type")), F.lit('"><chq>'), _xml(F.col("prompt")), F.lit("</chq><faq>"), _xml(F.col("metadata.golden_answer")), F.lit("</faq></pair>"))
    docs = table(spark, sf_dir, "preference_triples").select(F.expr(f"row_index div {PER_DOCUMENT}").alias("doc"), pair.alias("pair")).groupBy("doc").agg(F.array_join(F.collect_list("pair"), "").alias("pairs"))
    docs.select(F.regexp_replace(F.concat(F.lit("<root>"), "pairs", F.lit("</root>")), r"[\r\n]+", " ").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.audit_scored_questions(readers.read_scored_questions(spark, path, glob="*.txt"))


def variant_reports(spark, sf_dir):
    """One JSON report per variant of the losses, read again with its tag."""
    rows = table(spark, sf_dir, "loss_rows").groupBy("variant").agg(F.count(F.lit(1)).alias("observations"), F.sum("completion_tokens").alias("tokens"), F.countDistinct("record_id").alias("records"))
    reports = []
    for r in rows.collect():  # a handful of variants
        path = _folder(spark, "report")
        spark.range(1).select(F.lit(r.observations).alias("observations"), F.lit(r.tokens).alias("tokens"), F.lit(r.records).alias("records")).write.json(path)
        reports.append((r.variant, path))
    return readers.read_reports(spark, reports, "observations bigint, tokens bigint, records bigint")


def source_index(spark, sf_dir):
    """Records of two datasets keyed by source and locator, the first by text where a locator is found twice."""
    sft = _sft(spark, sf_dir).select("dataset", F.col("source.source_locator").alias("locator"), or_empty("instruction").alias("question"), or_empty("response").alias("answer")).where("locator is not null")
    names = [r.dataset for r in sft.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dataset").limit(2).collect()]
    index = readers.index_sources({n: sft.where(F.col("dataset") == n).drop("dataset") for n in names})
    return index.select("source", "locator", F.sha2("question", 256).alias("question_sha256"), F.sha2("answer", 256).alias("answer_sha256"))


def canonical_file_choice(spark, sf_dir):
    """Which of the payload files count: an unlabelled file gives way to its labelled twin."""
    files = table(spark, sf_dir, "raw_payloads").select(F.explode(F.array(F.concat("file_name", F.lit(".xml")), F.when(F.col("line_no") % 2 == 0, F.concat("file_name", F.lit("-wLabels.xml"))))).alias("file")).where("file is not null").distinct()
    return readers.canonical_files(files)


QUERIES = {f.__name__: f for f in (jsonl_artifact, csv_export, text_free_records, payload_lines, choice_questions, choice_audit, option_maps, qa_documents, qa_documents_audit, scored_pairs, variant_reports, source_index, canonical_file_choice)}

_LETTERS = "['a', 'B, c', 'd', 'x,a'][row_index % 4 + 1]"
_CHOICE = f"""c AS (SELECT row_index, split, CASE WHEN row_index % 3 = 0 THEN language END AS clinical_case, instruction AS question, {_hash('instruction')} AS k, coalesce(source.source_dataset, 'unknown') AS a, substr(response, 1, 30) AS b, task_type AS c,
list_transform(string_split(lower({_LETTERS}), ','), lambda x: trim(x)) AS letters FROM sft_records)"""
_BLANK = lambda c: f"{STRIP.format(c)} = ''"
_PURE = lambda c: NORM.format(rf"regexp_replace({c}, '{NO_XML}', '', 'g')")
_KEY = lambda c: f"CASE WHEN {_PURE(c)} = '' THEN '' ELSE sha256({_PURE(c)}) END"
_XML_ROWS = f"""d AS (SELECT row_index, CASE split WHEN 'train' THEN '1_train' WHEN 'validation' THEN '2_validation' ELSE '3_test' END AS subset, task_type, regexp_replace(coalesce(instruction, ''), '{NO_XML}', '', 'g') AS q, regexp_replace(coalesce(response, ''), '{NO_XML}', '', 'g') AS a FROM sft_records)"""
SQL = {
    "jsonl_artifact": f"""WITH r AS (SELECT json_object('instruction', instruction, 'language', language, 'record_id', record_id, 'response', response, 'row_index', row_index, 'split', split)::VARCHAR AS v FROM sft_records), h AS (SELECT v, sha256(v) AS d FROM r)
SELECT count(*) AS record_count, sum(strlen(v) + 1)::BIGINT AS byte_size, {MULTISET} AS sha256 FROM h""",
    "csv_export": "SELECT row_index, source.source_dataset AS source_source_dataset, source.source_license AS source_source_license, array_to_string(transformation.operations, '|') AS operations FROM sft_records",
    "text_free_records": "SELECT row_index, record_id, split, sha256(json_object('instruction', instruction, 'response', response)::VARCHAR) AS content_sha256 FROM sft_records",
    "payload_lines": """WITH v AS (SELECT payload, CASE WHEN json_valid(payload) THEN payload END AS j FROM raw_payloads)
SELECT count(*) AS n_lines, sum((trim(coalesce(payload, '')) <> '' AND (j IS NULL OR json_type(j) <> 'OBJECT'))::INT)::BIGINT AS bad, sum((trim(coalesce(payload, '')) <> '' AND (j IS NULL OR json_type(j) <> 'OBJECT'))::INT)::BIGINT AS places,
count(j ->> 'record_id') AS records, count(j ->> 'prompt_id') AS prompts FROM v""",
    "choice_questions": f"""WITH {_CHOICE}, x AS (SELECT *, list_filter(list_transform(letters, lambda l: trim(CASE l WHEN 'a' THEN a WHEN 'b' THEN coalesce(b, '') WHEN 'c' THEN c ELSE '' END)), lambda t: t <> '') AS answers FROM c)
SELECT row_index, sha256(concat_ws(chr(10) || chr(10), nullif({STRIP.format('clinical_case')}, ''), {STRIP.format('question')})) AS question_sha256, array_to_string(answers, chr(10)) AS answer
FROM x WHERE split <> 'test' AND NOT ({_BLANK('question')}) AND len(answers) > 0 AND (k = '' OR k NOT IN (SELECT k FROM c WHERE split = 'test' AND k <> ''))""",
    "choice_audit": f"""WITH {_CHOICE} SELECT split AS part, count(*) AS n_rows, sum((NOT ({_BLANK('clinical_case')}))::INT)::BIGINT AS with_case, sum((len(letters) = 1)::INT)::BIGINT AS single, sum((len(letters) > 1)::INT)::BIGINT AS multiple, 0::BIGINT AS unanswered,
(count(*) FILTER (k <> '') - count(DISTINCT k) FILTER (k <> ''))::BIGINT AS duplicates FROM c GROUP BY split""",
    "option_maps": f"SELECT item_id, sha256({STRIP.format('text')}) AS question_sha256, CASE item_id % 3 WHEN 0 THEN concat_ws(chr(10), suite, lang) ELSE lang END AS answer FROM eval_items WHERE item_id % 3 < 2",
    "qa_documents": f"""WITH {_XML_ROWS} SELECT subset, row_index, task_type AS question_type, {_hash('q')} AS question_key, {_hash('a')} AS answer_key FROM d WHERE NOT ({_BLANK('q')}) AND NOT ({_BLANK('a')})""",
    "qa_documents_audit": f"""WITH {_XML_ROWS}, k AS (SELECT subset, {_hash('q')} AS k FROM d)
SELECT subset, 0::BIGINT AS malformed, count(*) AS pairs, sum((NOT ({_BLANK('a')}))::INT)::BIGINT AS filled, sum(({_BLANK('a')})::INT)::BIGINT AS empty, (SELECT count(*) - count(DISTINCT k) FROM k WHERE k.subset = d.subset AND k.k <> '')::BIGINT AS duplicates FROM d GROUP BY subset""",
    "scored_pairs": f"SELECT coalesce(label_type, '') AS label, NULL::INT AS score, count(*) AS n_rows, sum(({_BLANK('prompt')} OR {_BLANK('metadata.golden_answer')})::INT)::BIGINT AS blank FROM preference_triples GROUP BY 1",
    "variant_reports": "SELECT variant, count(*) AS observations, sum(completion_tokens)::BIGINT AS tokens, count(DISTINCT record_id) AS records FROM loss_rows GROUP BY variant",
    "source_index": """WITH s AS (SELECT coalesce(source.source_dataset, 'unknown') AS source, source.source_locator AS locator, coalesce(instruction, '') AS q, coalesce(response, '') AS a FROM sft_records s WHERE s.source.source_locator IS NOT NULL),
n AS (SELECT source FROM s GROUP BY source ORDER BY count(*) DESC, source LIMIT 2), f AS (SELECT source, locator, min(struct_pack(q := q, a := a)) AS r FROM s WHERE source IN (SELECT source FROM n) GROUP BY source, locator)
SELECT source, locator, sha256(r.q) AS question_sha256, sha256(r.a) AS answer_sha256 FROM f""",
    "canonical_file_choice": """WITH f AS (SELECT DISTINCT file_name || '.xml' AS file, file_name AS stem, false AS labelled FROM raw_payloads UNION SELECT DISTINCT file_name || '-wLabels.xml', file_name, true FROM raw_payloads WHERE line_no % 2 = 0)
SELECT file, CASE WHEN lower(file) LIKE '%rqe%' THEN 'rqe' ELSE 'qa' END AS task, labelled OR stem NOT IN (SELECT stem FROM f WHERE labelled) AS canonical FROM f""",
}
