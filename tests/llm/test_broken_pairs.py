import pytest

from selvedge.llm.broken_pairs import defective_pairs, inspect, is_truncated, language

Q = "I have had numb fingers for a week and I take one tablet every morning. Is it safe to stop the tablets now?"
A = "You should not stop the tablets without asking the doctor. Most cases settle within two weeks."
FR = "La plupart des cas cèdent en deux semaines et les médicaments ne sont pas arrêtés sans avis."


@pytest.mark.parametrize(
    "answer, defect",
    [
        (A, None), (None, "empty"), ("  \n", "empty"), ("...", "empty"), ("N/A", "empty"), ("[]", "empty"),
        (Q, "copied_question"), ("You asked: " + Q.upper(), "copied_question"), (Q + " " + Q, "copied_question"), ("Is it safe to stop the tablets now? " + A, None),
        (FR, "wrong_language"), (A + " The label said « l'eau est dans la main » in full.", None),
        (A[:-7], "truncated"), (A + " (especially", "truncated"), ("Do this:\n- drink water\n- call the clinic", None), ("Yes", None), ("200 mg twice daily", None), (A.replace(".", "…"), None),
    ],
)
def test_defects_of_a_pair(answer, defect):
    assert inspect(Q, answer)[0] == defect


def test_languages():
    assert language("ich darf ihnen die tabletten nicht geben und der arzt ist nicht da".split()) == "de"
    assert language("los niños no deben tomar el jarabe sin consultar con su médico".split()) == "es"
    assert language(["quinzole"]) is None
    assert is_truncated("a list\n1) one thing\n2)", ["x"] * 20) and not is_truncated("short answer", ["x"] * 3)


SCHEMA = "tbl string, row_index bigint, field string, question string, answer string"


def test_refusals_are_templates_across_prompts(spark):
    openers = ["Sorry, I can't help with that request.", "Unfortunately, I can't help with that request at this time.", "As a model, I can't help with that request; my role does not allow it."]
    closing = " Please see a professional."
    rows = [("t", k, "response", f"What is number {k}?", openers[k % 3] + closing * (k % 2)) for k in range(12)]
    rows += [("t", 100 + k, "response", f"How about {k}?", f"I cannot see the skin from here, but it is useful. Keep the wound {k} dry and call the clinic.") for k in range(12)]
    rows += [("t", 200, "response", "Why?", None), ("t", 200, "response", "Why?", None), ("t", 300, "response", None, A)]
    got = [(r.row_index, r.defect) for r in defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [(k, "refusal") for k in range(12)] + [(200, "empty")] * 2


def test_openings_are_compared_within_whole_bands(spark):
    import random

    import pyarrow as pa

    from selvedge.llm.broken_pairs import _bands, opening_clusters

    r = random.Random(4)
    share = lambda a, b: len(a & b) / len(a | b)
    sets = []
    for _ in range(4000):  # crowded bands: sets that share a good part but less than half of their words, and one edit of each
        one = frozenset(r.sample([f"w{k}" for k in range(16)], 6))
        if all(share(one, o) < 0.5 for o in sets):
            sets += [one, one - {min(one)} | {f"x{len(sets)}"}]
    ids = list(range(len(sets)))
    r.shuffle(ids)
    texts = {k: " ".join(sorted(s)) for k, s in zip(ids, sets, strict=True)}
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()))], names=["id", "opening"])
    bands = {}
    for out in _bands(iter([batch])):
        for k, band in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            bands.setdefault(band, set()).add(k)
    group = {k: k for k in texts}
    for inside in bands.values():
        for a in inside:
            for b in inside:
                if group[a] != group[b] and share(set(texts[a].split()), set(texts[b].split())) >= 0.5:
                    low, high = sorted((group[a], group[b]))
                    group = {k: low if v == high else v for k, v in group.items()}
    got = opening_clusters(spark.createDataFrame(list(texts.items()), "id bigint, opening string"))
    assert {x.id: x.cluster for x in got.collect()} == group


def test_lists_and_short_answers_that_break_off(spark):
    whole = "Keep the wound dry and call the clinic within one minute."
    answers = [
        (whole, None), ("Do this:\n- drink water\n- call the cli", "truncated"), ("Do this:\n- drink water\n- call the clinic", None), ("Do this:\n- drink water\n- call the", "truncated"),
        ("Do this:\n- Drink water.\n- Rest.\n- Call", "truncated"), ("Call the cli", "truncated"), ("Within the", "truncated"), ("Call the clinic", None), ("Drink quinzole", None), ("- chew\n- wait some minutes", None),
    ]
    rows = [("t", k, "response", f"What is number {k}?", a) for k, (a, _) in enumerate(answers)]
    got = {(r.row_index, r.defect) for r in defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(k, d) for k, (_, d) in enumerate(answers) if d}


def test_a_refusal_after_several_lead_ins(spark):
    lead = "Hello.\nThank you for your question.\nI understand.\n"
    rows = [("t", k, "response", f"What is number {k}?", lead + "I can't help with that request.") for k in range(12)]
    rows += [("t", 100 + k, "response", f"How about {k}?", f"Keep wound {k} dry. Call the clinic on day {k}. It heals within {k} weeks. I cannot see the skin from here.") for k in range(12)]
    got = [(r.row_index, r.defect) for r in defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [(k, "refusal") for k in range(12)]


def test_empty_table(spark):
    assert defective_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_template_without_a_known_turn_is_revealed_by_recurrence(spark):
    topics = ["knee", "elbow", "fever", "cough", "rash", "diet", "sleep", "asthma", "migraine", "wound"]
    ask = lambda k: f"Why does my {topics[k % 10]} number {k} bother me since the {topics[k // 10 % 10]} began?"
    rows = [("t", k, "response", ask(k), "That topic is simply off the table for me." + " Other pages cover it well." * (k % 3 == 0)) for k in range(200)]
    rows += [("t", 1000 + k, "response", ask(k), f"Keep {k} days of rest and drink water for that.") for k in range(100)]  # varied answers
    rows += [("t", 2000 + k, "response", ask(k), "Yes.") for k in range(100)]  # short answers recur
    rows += [("t", 3000 + k, "response", f"Does paracetamol lower fever {k}?", "Paracetamol lowers fever in most adults.") for k in range(60)]  # the prompts speak of it
    got = [(r.row_index, r.defect) for r in defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [(k, "refusal") for k in range(200)]


def test_revealed_templates_beside_empty_and_copied_answers(spark):
    ask = lambda k: f"Why does my knee number {k} bother me since the fever began?"
    rows = [("t", k, "response", ask(k), "That topic is simply off the table for me.") for k in range(40)]
    rows += [("t", 100, "response", ask(0), None), ("t", 101, "chosen", ask(0), ""), ("t", 102, "response", None, "..."), ("t", 103, "response", ask(0), ask(0))]
    got = [(r.row_index, r.defect) for r in defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [(k, "refusal") for k in range(40)] + [(100, "empty"), (101, "empty"), (102, "empty"), (103, "copied_question")]


def test_a_general_sentence_that_also_opens_other_answers_is_no_template(spark):
    ask = lambda k: f"Why does my knee number {k} bother me since the fever began?"
    general = "Hydration matters more for shift workers than for others."
    rows = [("t", k, "response", ask(k), general) for k in range(60)]
    rows += [("t", 1000 + k, "response", ask(k), f"{general} Take {k} drops of the syrup before you sleep.") for k in range(500)]
    rows += [("t", 2000 + k, "response", ask(k), "That topic is simply off the table for me." + " Other pages cover it well." * (k % 2)) for k in range(80)]
    rows += [("t", 3000, "response", ask(0), None), ("t", 3001, "response", ask(0), f"The old label said so in full - {general}")]  # the same words in one sentence
    rows += [("t", 4000 + k, "response", ask(k), "The old label said so in full. " + (general if k < 40 else f"Take {k} drops of the syrup before you sleep.")) for k in range(300)]
    got = [(r.row_index, r.defect) for r in defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [(2000 + k, "refusal") for k in range(80)] + [(3000, "empty")]
