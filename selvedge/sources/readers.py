"""Readers for the raw corpora: markup, choice questions, preferences, reports."""

from __future__ import annotations

import codecs
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from selvedge.functions.text import content_hash, or_empty, strip
from selvedge.session import require_empty, shared_dir, track

QA_PAIR = "QAPairs STRUCT<QAPair: ARRAY<STRUCT<_pid: STRING, Question: STRUCT<_VALUE: STRING, _qtype: STRING>, Answer: STRING>>>, _corrupt_record STRING"
QUESTION_PAIR = "pair ARRAY<STRUCT<_pid: STRING, _value: STRING, chq: STRING, faq: STRING>>, Question ARRAY<STRUCT<_QID: STRING, QuestionText: STRING, AnswerList: STRUCT<Answer: ARRAY<STRUCT<_ReferenceScore: STRING, AnswerText: STRING>>>>>, _corrupt_record STRING"
LETTERS = "abcde"


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines; strict reading fails on the first line that is no object of the schema, blank lines aside."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, text): the lines of text files, with their 0-based place in the block that one task reads."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for b in batches:
            places = []
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                places.append(seen.get(key, 0))
                seen[key] = places[-1] + 1
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(places, pa.int64()), b.column(2)], names=["file", "block", "place", "text"])

    return lines.mapInArrow(number, "file string, block bigint, place bigint, text string")


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of the lines that are neither blank nor a JSON object; line counts from 1.

    Files are read in blocks by many tasks; the lines of the blocks before are
    added to those of the bad lines only.
    """
    lines = numbered_lines(spark, path)
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    bad = lines.where((strip(F.col("text")) != "") & F.json_object_keys("text").isNull())
    return bad.join(offsets, ["file", "block"]).select("file", (F.col("offset") + F.col("place") + 1).alias("line"))


def require_json_lines(spark: SparkSession, path: str) -> None:
    """Raise ContractViolation, naming file and line, when a line is neither blank nor a JSON object."""
    require_empty(bad_json_lines(spark, path), f"{path}: lines that are no JSON object")


def audit_choice_questions(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, clinical_case, question, correct_answers) to counts per group: rows, with a case, with one and with several correct letters, without any, repeated questions."""
    letters = F.filter(F.transform(F.split(or_empty("correct_answers"), ","), lambda x: F.trim(x)), lambda x: x != "")
    number = lambda c: F.sum(c.cast("bigint"))
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), number(strip(or_empty("clinical_case")) != "").alias("with_case"), number(F.size(letters) == 1).alias("single"), number(F.size(letters) > 1).alias("multiple"), number(F.size(letters) == 0).alias("unanswered")
    )
    keys = rows.select(*by, content_hash(F.col("question")).alias("k")).where("k <> ''").groupBy(*by, "k").agg(F.count(F.lit(1)).alias("c"))
    repeated = keys.groupBy(*by).agg(F.sum(F.col("c") - 1).alias("duplicates"))
    return counts.join(repeated, by, "left").na.fill(0, ["duplicates"])


def audit_scored_questions(rows: DataFrame) -> DataFrame:
    """rows of read_scored_questions() to counts per label and score: rows and blank texts."""
    blank = (strip(or_empty("text_a")) == "") | (strip(or_empty("text_b")) == "")
    return rows.groupBy("label", "score").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(blank.cast("bigint")).alias("blank"))


def read_qa_documents(spark: SparkSession, path: str, removed: tuple[str, ...] = (), glob: str = "*.xml") -> DataFrame:
    """Question and answer pairs of XML documents below numbered folders: (subset, locator, question_type, question, answer).

    Malformed documents and pairs without question or answer are left out; the
    locator is the file with the pair's id, or its 1-based place without one.
    """
    files = spark.read.text(f"{path.rstrip('/')}/[0-9]*", wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    parsed = files.select(F.col("_metadata.file_path").alias("file"), F.from_xml("value", QA_PAIR, {"rowTag": "Document"}).alias("d"))
    relative = F.regexp_extract("file", r"([^/]+/[^/]+)$", 1)
    pairs = parsed.where("d._corrupt_record is null").select(relative.alias("file"), F.posexplode("d.QAPairs.QAPair").alias("k", "p"))
    locator = F.concat_ws(":", "file", F.coalesce("p._pid", (F.col("k") + 1).cast("string")))
    out = pairs.select(F.substring_index("file", "/", 1).alias("subset"), locator.alias("locator"), F.col("p.Question._qtype").alias("question_type"), strip(or_empty("p.Question._VALUE")).alias("question"), strip(or_empty("p.Answer")).alias("answer"))
    return out.where((F.col("question") != "") & (F.col("answer") != "") & ~F.col("subset").isin(list(removed)))


def audit_qa_documents(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """Per subset: files, malformed files, pairs, filled and empty answers, repeated questions."""
    files = spark.read.text(f"{path.rstrip('/')}/[0-9]*", wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    parsed = files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("subset"), F.from_xml("value", QA_PAIR, {"rowTag": "Document"}).alias("d"))
    per_file = parsed.groupBy("subset").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("d._corrupt_record").isNotNull().cast("bigint")).alias("malformed"))
    pairs = parsed.where("d._corrupt_record is null").select("subset", F.explode("d.QAPairs.QAPair").alias("p"))
    filled = strip(or_empty("p.Answer")) != ""
    counts = pairs.groupBy("subset").agg(F.count(F.lit(1)).alias("pairs"), F.sum(filled.cast("bigint")).alias("filled"), F.sum((~filled).cast("bigint")).alias("empty"))
    keys = pairs.select("subset", content_hash(F.col("p.Question._VALUE")).alias("k")).where("k <> ''").groupBy("subset", "k").count()
    repeated = keys.groupBy("subset").agg(F.sum(F.col("count") - 1).alias("duplicates"))
    return per_file.join(counts, "subset", "left").join(repeated, "subset", "left").na.fill(0)


def read_scored_questions(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """Question pairs and scored answers of XML files: (file, record_id, label, score, text_a, text_b), one row a pair or answer."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    parsed = files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), F.from_xml("value", QUESTION_PAIR).alias("d"))
    pairs = parsed.select("file", F.explode("d.pair").alias("p")).select("file", F.col("p._pid").alias("record_id"), F.col("p._value").alias("label"), F.lit(None).cast("int").alias("score"), F.col("p.chq").alias("text_a"), F.col("p.faq").alias("text_b"))
    questions = parsed.select("file", F.explode("d.Question").alias("q"))
    answers = questions.select("file", F.col("q._QID").alias("record_id"), F.col("q.QuestionText").alias("text_a"), F.explode("q.AnswerList.Answer").alias("a"))
    scored = answers.select("file", "record_id", F.lit(None).cast("string").alias("label"), F.col("a._ReferenceScore").cast("int").alias("score"), "text_a", F.col("a.AnswerText").alias("text_b"))
    return pairs.unionByName(scored)


def canonical_files(files: DataFrame) -> DataFrame:
    """files (file) with task and canonical: an unlabelled file gives way to its twin with labels."""
    stem = F.regexp_replace("file", r"(-wLabels)?\.xml$", "")
    named = files.withColumn("stem", stem).withColumn("labelled", F.col("file").rlike(r"-wLabels\.xml$")).withColumn("task", F.when(F.lower("file").contains("rqe"), "rqe").otherwise("qa"))
    twins = named.where("labelled").select("stem", F.lit(True).alias("twin")).distinct()
    return named.join(twins, "stem", "left").select("file", "task", (F.col("labelled") | F.col("twin").isNull()).alias("canonical"))


def correct_answers(row: dict[str, Column], correct: Column) -> Column:
    """The answer texts that a letter list such as "A,C" names, empty ones left out; row maps letters to columns."""
    by_letter = F.create_map(*[x for k, c in row.items() for x in (F.lit(k), c)])
    letters = F.transform(F.split(F.lower(F.coalesce(correct, F.lit(""))), ","), lambda x: F.trim(x))
    return F.filter(F.transform(letters, lambda x: F.trim(F.coalesce(F.try_element_at(by_letter, x), F.lit("")))), lambda a: a != "")


def read_choice_questions(spark: SparkSession, paths: list[str], protected: list[str], options: bool = False) -> DataFrame:
    """Choice questions in JSON lines, without those that are also in the protected files: (locator, question, answer)."""
    fields = {k: f"answer_{k}" for k in LETTERS}
    schema = "id STRING, clinical_case STRING, question STRING, correct_answers STRING, " + ", ".join(f"{f} STRING" for f in fields.values())
    keys = read_jsonl(spark, protected, schema).select(content_hash(F.col("question")).alias("k")).where("k <> ''").distinct()
    rows = read_jsonl(spark, paths, schema).select("*", F.regexp_extract("_metadata.file_path", r"([^/]+)\.\w+$", 1).alias("part")).where(strip(or_empty("question")) != "")
    answers = correct_answers({k: F.col(f) for k, f in fields.items()}, F.col("correct_answers"))
    listed = F.concat_ws("\n", *[F.when(strip(or_empty(f)) != "", F.concat(F.lit(f"{k.upper()}. "), F.trim(f))) for k, f in fields.items()])
    question = F.concat_ws("\n\n", F.nullif(strip(or_empty("clinical_case")), F.lit("")), strip(F.col("question")), F.when(F.lit(options), F.concat(F.lit("Options:\n"), listed)))
    kept = rows.withColumn("k", content_hash(F.col("question"))).join(keys, "k", "left_anti")
    return kept.where(F.size(answers) > 0).select(F.concat_ws(":", "part", "id").alias("locator"), question.alias("question"), F.array_join(answers, "\n").alias("answer"))


def read_option_maps(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions with an answers map and a list of correct keys: (locator, question, answer)."""
    rows = spark.read.schema("id STRING, question STRING, answers MAP<STRING, STRING>, correct_answers ARRAY<STRING>").json(path, multiLine=True)
    answers = F.filter(F.transform("correct_answers", lambda k: F.try_element_at(F.col("answers"), k)), lambda a: a.isNotNull())
    return rows.where(F.size(answers) > 0).select(F.col("id").alias("locator"), strip(or_empty("question")).alias("question"), F.array_join(answers, "\n").alias("answer"))


MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"
TRIPLE = f"prompt_id STRING, label_type STRING, prompt STRING, chosen {MESSAGES}, rejected {MESSAGES}, metadata STRUCT<golden_answer: STRING, chosen: STRUCT<model: STRING>, rejected: STRUCT<model: STRING>>"


def json_array_lines(spark: SparkSession, path: str, out: str, chunk: int = 1 << 20) -> int:
    """Write the elements of one JSON array file as lines (place, tab, element) to a fresh file; returns their number.

    An array in one line cannot be split between tasks, so it is read once as a
    stream that holds a chunk and the element at hand, whatever its size.
    """
    target, source = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (out, path))
    conf = spark._jsc.hadoopConfiguration()
    decoder, characters = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8-sig")()
    text, place, ended = "", 0, False
    reading = source.getFileSystem(conf).open(source)
    writing = target.getFileSystem(conf).create(target, False)
    try:
        lines: list[str] = []
        opened = False
        while not ended:
            data = bytes(reading.readNBytes(chunk))
            ended = len(data) < chunk
            text += characters.decode(data, ended)
            at = 0
            while True:
                while at < len(text) and text[at] in " \t\r\n," + "["[opened:]:
                    opened = opened or text[at] == "["
                    at += 1
                if at == len(text) or text[at] == "]":
                    break
                if not opened:
                    raise ValueError(f"{path} holds no JSON array")
                try:
                    element, end = decoder.raw_decode(text, at)
                except ValueError:
                    if ended:
                        raise
                    break
                if end == len(text) and not ended:  # a number may go on
                    break
                lines.append(f"{place}\t{json.dumps(element, ensure_ascii=False)}\n")
                place, at = place + 1, end
            text = text[at:]
            if lines:
                writing.write(bytearray("".join(lines).encode()))
                lines = []
    finally:
        writing.close()
        reading.close()
    return place


def read_preferences(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """Preference triples of one JSON array a split, numbered in file order: (split, row_index, ...).

    Each array is first turned into lines in the shared folder, which all tasks read.
    """
    out = None
    lines = f"{shared_dir(spark).rstrip('/')}/selvedge-lines-{uuid.uuid4().hex}"
    track(lines)
    for split in splits:
        json_array_lines(spark, f"{folder.rstrip('/')}/{split}.json", f"{lines}/{split}.txt")
        parts = F.split("value", "\t", 2)
        rows = spark.read.text(f"{lines}/{split}.txt").select(parts[0].cast("bigint").alias("row_index"), F.from_json(parts[1], f"STRUCT<{TRIPLE}>").alias("t")).select(F.lit(split).alias("split"), "row_index", "t.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def read_reports(spark: SparkSession, reports: list[tuple[str, str]], schema: str) -> DataFrame:
    """Tagged JSON reports as one table with a variant column; a variant given twice raises."""
    names = [v for v, _ in reports]
    if len(set(names)) < len(names):
        raise ValueError("a variant is given twice")
    out = None
    for variant, path in reports:
        rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("variant", F.lit(variant))
        out = rows if out is None else out.unionByName(rows)
    return out


def index_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Several sources (locator, question, answer) as one table keyed by source and locator; a locator found twice in a source stays one row, the first by text."""
    out = None
    for name, rows in sources.items():
        one = rows.groupBy("locator").agg(F.min(F.struct("question", "answer")).alias("r")).select(F.lit(name).alias("source"), "locator", "r.*")
        out = one if out is None else out.unionByName(one)
    return out
