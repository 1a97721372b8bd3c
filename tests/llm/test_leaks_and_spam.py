import pytest
from pyspark.sql import functions as F

from selvedge.llm.eval_leaks import EDITED_SCORE, RUN, align, item_blocks, leak_alignments, word_hashes
from selvedge.llm.spam_pages import page_shapes, spam_pages

ITEM = "During the évening round an unlucky painter aged seventy was found with wheezing and a recurrent swelling beside the elbow so the team asked for a scan."
WORDS = ITEM.split()


def found(spark, texts, items=((7, ITEM), (8, "Completely different words are listed in this other item for nobody to copy at all.")), **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    return {(r.doc_id, r.item_id): (r.score, r.longest_run) for r in leak_alignments(docs, spark.createDataFrame(list(items), "item_id bigint, text string")).collect()}


def test_verbatim_edited_and_short_passages(spark):
    edited = " ".join(w for k, w in enumerate(WORDS) if k % 9 != 8)
    texts = [
        "Start. " + " ".join(WORDS[3:16]).upper().replace("É", "E") + " end.",
        " ".join(WORDS[3:15]) + " other",
        edited,
        "> " + ",\n> ".join(WORDS) + " and " + ITEM,
        None, "", "nothing of the kind", "x " * 30_000 + ITEM + " y" * 30_000,
    ]
    got = found(spark, texts)
    runs = {d: r for (d, i), (_, r) in got.items() if i == 7}
    assert runs[0] == 13 and runs.get(1, 0) == 12 and runs[3] == len(WORDS) and runs[7] == len(WORDS)
    assert runs.get(2, 0) < RUN and got[2, 7][0] >= EDITED_SCORE
    assert not {k for k in got if k[1] == 8} and not {k for k in got if k[0] in (4, 5, 6)}


def test_an_edited_copy_is_found_without_a_verbatim_one(spark):
    edited = " ".join("changed" if k in (6, 13, 20) else w for k, w in enumerate(WORDS))
    got = found(spark, ["Before it. " + edited + " After it.", "nothing of the kind"])
    assert set(got) == {(0, 7)} and got[0, 7][0] >= EDITED_SCORE and got[0, 7][1] < RUN


def test_no_items_or_documents(spark):
    assert found(spark, ["a"], items=((1, None), (2, ""))) == {}
    assert found(spark, [], items=((1, ITEM),)) == {}
    assert leak_alignments(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_repeated_documents_and_items(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM), (2, ITEM)], "item_id bigint, text string")
    assert leak_alignments(docs, items).groupBy("doc_id", "item_id").count().select("item_id", "count").sort("item_id").collect() == [(1, 2), (2, 2)]


def test_alignment_score():
    import pyarrow as pa

    words, off = word_hashes(pa.array(["a b c d", "x a b q c d"], pa.large_string()))
    a, b = words[: off[1]], words[off[1] :]
    assert align(a, b) == (7, 4, 2)
    assert [len(x) for x in item_blocks([(k, "x" * 5_000_000) for k in range(3)])] == [1, 1, 1]


PROSE = "The ointment is spread thinly every evening over the elbow. Most cases settle within two weeks if you rest. A nurse may teach you how to do it.\n"
SPAM = {
    "links": "\n".join(f"- https://shop{k}.example/item?id={k}" for k in range(20)),
    "markdown": " ".join(f"[cheap pill{k}](https://shop{k}.example/{k})" for k in range(20)),
    "anchors": "\n".join(f'<a href="//shop{k}.example/x">pill{k} order</a>' for k in range(20)),
    "tags": "\n".join(f"#pill{k % 4}cheap" for k in range(40)),
    "keywords": " ".join(f"pill{k % 5}" for k in range(200)),
    "lines": "\n".join(f"pill cheap Town{k}" for k in range(30)),
    "table": "\n".join(f"Pill{k} 25 mg | 60 pcs | SKU {10000 + k} | 59.84 € | order" for k in range(20)),
    "crumbs": " > ".join(f"Item{k}" for k in range(60)),
    "mixed": PROSE + "\n".join(f"https://shop{k}.example/item?id={k}" for k in range(20)),
}
FINE = {
    "prose": PROSE * 5,
    "check list": PROSE + "\n".join(["- Measure the temperature twice.", "- Chew slowly.", "- Call the clinic."] * 4),
    "glossary": "\n".join(f"Term{k}: A swelling near the elbow without fever suggests a mild strain." for k in range(10)),
    "dialogue": "\n".join(f"{w}: When a rash follows a change of diet, mention it at the visit." for w in ("Caller", "Operator") * 5),
    "few links": PROSE * 4 + "Sources\nhttps://a.example/x\nhttps://b.example/y",
    "few tags": PROSE * 3 + "Tags\n#one\n#two",
    "blank": " \n\n ", "empty": "", "null": None,
}


@pytest.fixture(scope="module")
def flagged(spark):
    texts = list(SPAM.items()) + list(FINE.items()) + [("long prose", PROSE * 3000), ("long links", SPAM["links"] * 500)]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id bigint, text string").withColumn("share", F.lit("clash"))
    return {texts[r.doc_id][0] for r in spam_pages(df).collect()}


def test_flagged_pages(flagged):
    assert flagged == set(SPAM) | {"long links"}


def test_shapes_hold_every_character(spark):
    df = spark.createDataFrame([(1, SPAM["mixed"]), (1, SPAM["mixed"]), (2, None)], "doc_id bigint, text string")
    shapes = page_shapes(df).collect()
    assert sum(r.chars for r in shapes) == 2 * sum(len(x.strip()) for x in SPAM["mixed"].split("\n"))
    assert spam_pages(df.limit(0)).count() == 0


def plain_alignment(item, text):
    """Smith-Waterman cell by cell: (score, longest common run)."""
    best = longest = 0
    score = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    run = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            run[i][j] = run[i - 1][j - 1] + 1 if a == b else 0
            score[i][j] = max(0, score[i - 1][j - 1] + (2 if a == b else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            best, longest = max(best, score[i][j]), max(longest, run[i][j])
    return best, longest


def test_stacked_alignments_and_their_bound_against_single_cells():
    import random

    import numpy as np
    import pyarrow as pa

    from selvedge.llm.eval_leaks import ItemIndex, Windows

    r = random.Random(3)
    items = [(k, " ".join(r.choices("abcdefghijkl", k=r.randint(1, 30)))) for k in range(12)]
    texts = [" ".join(r.choices("abcdefghijklmnopqrs", k=r.randint(1, 60))) for _ in range(20)]
    index = ItemIndex(items)
    words, off = word_hashes(pa.array(texts, pa.large_string()))
    row, item = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(items)), indexing="ij"))
    windows = Windows(index, index.coded(words), row, item, off[row], off[row + 1])
    scores, bounds = windows.align(), windows.bounds()
    for n, (t, k) in enumerate(zip(row, item, strict=True)):
        assert (scores[n, 0], scores[n, 2]) == plain_alignment(items[k][1].split(), texts[t].split())
        assert scores[n, 0] <= bounds[n]


def test_keywords_after_the_last_sentence_of_a_line(spark):
    prose = "The ointment is spread thinly every evening over the elbow. "
    spam = "cheap quinmipril online buy quinmipril price cheap quinmipril coupon quinmipril sale cheap quinmipril shipping buy quinmipril deal cheap quinmipril review"
    again = "Cheap pills. Pills price. Cheap pills online. Pills sale. Buy cheap pills. Pills coupon. Cheap price pills. Buy pills sale."
    rows = [(1, prose + spam), (2, prose * 4 + "and the rest of this line is cut off in the middle of what it was going to say about"), (3, again), (4, prose * 10 + spam[:60])]
    assert {r.doc_id for r in spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {1, 3}
