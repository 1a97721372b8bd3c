import json

import pytest
from pyspark.sql import functions as F

from selvedge.sources import readers, writers
from selvedge.streaming.audit import append_audit, hourly_counts


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


QA = '<Document><QAPairs><QAPair pid="1"><Question qtype="cause">What is flu?</Question><Answer>A virus.</Answer></QAPair><QAPair><Question>WHAT IS FLU</Question><Answer> </Answer></QAPair></QAPairs></Document>'


def test_markup_documents(spark, tmp_path):
    write(tmp_path / "1_A" / "a.xml", QA)
    write(tmp_path / "1_A" / "bad.xml", "<Document><QAPairs>")
    write(tmp_path / "2_B" / "b.xml", QA)
    rows = readers.read_qa_documents(spark, str(tmp_path), removed=("2_B",)).collect()
    assert [(r.subset, r.locator, r.question_type, r.answer) for r in rows] == [("1_A", "1_A/a.xml:1", "cause", "A virus.")]
    audit = {r.subset: r for r in readers.audit_qa_documents(spark, str(tmp_path)).collect()}
    a = audit["1_A"]
    assert (a.files, a.malformed, a.pairs, a.filled, a["empty"], a.duplicates) == (2, 1, 2, 1, 1, 1)


def test_scored_questions_and_canonical_files(spark, tmp_path):
    write(tmp_path / "rqe.xml", '<Root><pair pid="1" value="true"><chq>Call me</chq><faq>f</faq></pair></Root>')
    write(tmp_path / "qa.xml", '<Root><Question QID="7"><QuestionText>What is flu?</QuestionText><AnswerList><Answer ReferenceScore="4"><AnswerText>t</AnswerText></Answer></AnswerList></Question></Root>')
    rows = {r.file: r for r in readers.read_scored_questions(spark, str(tmp_path)).collect()}
    assert rows["rqe.xml"].label == "true" and (rows["qa.xml"].record_id, rows["qa.xml"].score) == ("7", 4)
    files = spark.createDataFrame([("RQE_test.xml",), ("RQE_test-wLabels.xml",), ("QA.xml",)], "file string")
    assert {r.file for r in readers.canonical_files(files).where("canonical").collect()} == {"RQE_test-wLabels.xml", "QA.xml"}


def test_choice_questions(spark, tmp_path):
    q = {"id": "1", "clinical_case": "Case.", "question": "Which?", "answer_a": "First answer", "answer_b": "Second", "answer_c": "Third answer", "correct_answers": "A,C"}
    write(tmp_path / "train.json", "\n".join(map(json.dumps, [q, q | {"id": "2", "question": "Held out"}, q | {"id": "3", "correct_answers": None}])))
    write(tmp_path / "test.json", json.dumps(q | {"question": "HELD-OUT"}))
    rows = readers.read_choice_questions(spark, [str(tmp_path / "train.json")], [str(tmp_path / "test.json")], options=True).collect()
    assert [(r.locator, r.answer) for r in rows] == [("train:1", "First answer\nThird answer")]
    assert rows[0].question == "Case.\n\nWhich?\n\nOptions:\nA. First answer\nB. Second\nC. Third answer"
    write(tmp_path / "map.json", json.dumps([{"id": "9", "question": "Q", "answers": {"a": "yes", "b": "no"}, "correct_answers": ["a", "z"]}, {"id": "8", "question": "Q", "answers": {}, "correct_answers": []}]))
    assert [(r.locator, r.answer) for r in readers.read_option_maps(spark, str(tmp_path / "map.json")).collect()] == [("9", "yes")]


def test_preferences_keep_file_order(spark, tmp_path):
    for split, n in (("train", 3), ("dev", 1), ("test", 0)):
        write(tmp_path / f"{split}.json", json.dumps([{"prompt": f"{split}{k}", "chosen": [{"role": "user", "content": "c"}]} for k in range(n)]))
    rows = readers.read_preferences(spark, str(tmp_path)).orderBy("split", "row_index").collect()
    assert [(r.split, r.row_index, r.prompt) for r in rows] == [("dev", 0, "dev0"), ("train", 0, "train0"), ("train", 1, "train1"), ("train", 2, "train2")]


def test_json_lines(spark, tmp_path):
    write(tmp_path / "x.jsonl", '{"a": 1}\n\nnot json\n[1]\n')
    assert [r.line for r in readers.bad_json_lines(spark, str(tmp_path / "x.jsonl")).orderBy("line").collect()] == [3, 4]
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def test_reports(spark, tmp_path):
    write(tmp_path / "r.json", '{"n": 1}')
    path = str(tmp_path / "r.json")
    assert {r.variant for r in readers.read_reports(spark, [("a", path), ("b", path)], "n int").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        readers.read_reports(spark, [("a", path), ("a", path)], "n int")


def test_written_lines_have_an_order_free_digest(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "id bigint, text string")
    a = writers.write_jsonl(df, str(tmp_path / "a"))
    b = writers.write_jsonl(df.orderBy(F.desc("id")).repartition(3), str(tmp_path / "b"))
    assert a["sha256"] == b["sha256"] and a["record_count"] == 50 and a["byte_size"] == b["byte_size"]
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_jsonl(df, str(tmp_path / "a"))
    assert writers.write_jsonl(df.limit(0), str(tmp_path / "c"))["record_count"] == 0


def test_batches_exports_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(k, ["a", "b"], (k,)) for k in range(25)], "id bigint, tags array<string>, s struct<n: bigint>")
    cut = {r.batch: r.n_rows for r in writers.write_batches(df, str(tmp_path / "batches"), ["id"], 10).collect()}
    assert cut == {0: 10, 1: 10, 2: 5}
    writers.write_flat_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("id = '3'").first().asDict() == {"id": "3", "tags": "a|b", "s_n": "3"}
    assert writers.text_free_index(df, ["id"], ["tags"]).columns == ["id", "content_sha256"]
    write(tmp_path / "f" / "x.bin", "x")
    expected = spark.createDataFrame([("x.bin", "0"), ("y.bin", "1")], "file string, sha256 string")
    assert {r.file: r.state for r in writers.file_digests(spark, str(tmp_path / "f"), expected).collect()} == {"x.bin": "changed", "y.bin": "missing"}


def test_stream_appends_once_and_goes_on(spark, tmp_path):
    schema = "log_id bigint, logged_at timestamp, status string"
    def deliver(name, ids):
        spark.createDataFrame([(i,) for i in ids], "log_id bigint").select("log_id", F.lit("2025-01-01 10:00:00").cast("timestamp").alias("logged_at"), F.lit("ok").alias("status")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        append_audit(source, str(tmp_path / "out"), str(tmp_path / "ck"), "log_id", "logged_at", "10 days")
        return sorted(r.log_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    deliver("a", [1, 2, 2])
    assert run() == [1, 2]
    deliver("b", [2, 3])
    assert run() == [1, 2, 3]
    counts = hourly_counts(spark.read.parquet(str(tmp_path / "out")), "logged_at", "1 day").collect()
    assert [r.n_rows for r in counts] == [3]


def test_sources_are_indexed(spark):
    a = spark.createDataFrame([("1", "q", "x"), ("1", "q", "a"), ("2", "q", "b")], "locator string, question string, answer string")
    got = readers.index_sources({"m": a, "n": a.where("locator = '2'")}).collect()
    assert {(r.source, r.locator, r.answer) for r in got} == {("m", "1", "a"), ("m", "2", "b"), ("n", "2", "b")}
