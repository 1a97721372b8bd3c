"""Problem 2: prompts and responses that do not belong together, with the defect.

Method: refusals are found by clustering. Openings with a declining turn are
clustered by MinHash with verified likeness; a cluster that recurs across
unrelated prompts is a refusal template, and a response is a refusal when it has
such an opening and nothing else that answers: every other sentence either
declines too or is a stock closing, one that recurs across unrelated prompts and
is found almost only beside declining openings. So "I cannot see the skin, but
..." followed by an answer is none. Templates without any known turn are revealed
by recurrence alone: an answer of at least BARE_WORDS words that is the whole
answer, word for word, to BARE_PROMPTS different prompts and shares no telling
word with most of them is a refusal where its first sentence hardly opens anything
else, whatever the size of the table; and so is an answer that opens with this
sentence and has nothing beyond stock closings. A general sentence that other
answers open with too, and that stands alone now and then, is none. Checks of the pair itself label the other defects: nothing but stand-ins (empty), the words of the
question (copied), function words of another language (wrong_language), no end
(truncated).

One scan of the texts emits a short row per pair; only hashes of sentences and
the distinct declining openings are shuffled. A pair has one defect, the first
of empty, copied_question, refusal, wrong_language, truncated.

Defined results: a null response, a null or empty message list and a list
without assistant content are empty; a null question copies nothing and has no
language; the last assistant message is the answer; repeated rows give repeated
rows; texts are read whole; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.llm.tokens import coded, distinct_sorted, flat, rows_of
from selvedge.llm.tokens import words as split_words
from selvedge.llm.lookalikes import LOOKALIKES
from selvedge.operators.components import connected_components
from selvedge.operators.keyed import look_up
from selvedge.session import materialize, table

#: A template is a cluster of openings that answers so many different prompts.
MIN_PROMPTS = 3
#: So many different prompts, most of them without a telling word of the answer, reveal a template without a known turn, of so many words at least.
BARE_PROMPTS, BARE_WORDS, UNRELATED_SHARE = 30, 5, 0.7
#: Such answers are at least this share of all that open with their first sentence.
WHOLE_SHARE = 1 / 3
#: A word is telling from so many letters on.
TELLING_LETTERS = 5
#: Openings are alike from this share of common words on.
OPENING_LIKENESS = 0.5
#: A stock closing is found beside declining openings in this share of its rows.
CLOSING_SHARE = 0.7
BANDS, ROWS_PER_BAND = 16, 2
#: Answers without an end are complete when they are this short.
SHORT_ANSWER = 6

#: Stand-ins for a missing value, as letters and digits in lower case.
STAND_INS = frozenset(
    "none null na nan nil nd nr so tbd todo undefined missing empty blank unknown noanswer noresponse notavailable notapplicable vide néant aucun aucune rien inconnu "
    "sansréponse pasderéponse nonrenseigné nondisponible nonapplicable keine leer ninguno vacío sinrespuesta".split()
)
#: Turns by which an answer declines, in lower case with apostrophes as spaces.
DECLINING = re.compile(
    r"\b(?:can ?not|can t|could not|won t|will not|unable to|not able to|not allowed to|rather not|prefer not to|not in a position to) (?:help|assist|answer|provide|give|offer|recommend|advise|comment|discuss|respond|share|say|tell|do|see|support)\b"
    r"|\b(?:must|have to|need to) (?:decline|refuse|pass)\b|\bagainst my (?:guidelines|policy|policies|rules|instructions)\b|\bdon t feel comfortable\b|\bnot comfortable\b"
    r"|\bnot something i\b|\birresponsible of me\b|\bno answer can be given\b|\bmy role does not allow\b|\bi (?:decline|refuse)\b|\boutside (?:of )?(?:my|what i)\b|\bbeyond (?:my|what i)\b"
    r"|\bne (?:peux|puis|saurais|suis) pas\b|\bne saurais\b|\bdois (?:décliner|refuser|m abstenir)\b|\bpréfère (?:ne pas|m abstenir)\b|\bje (?:refuse|décline|m abstiens)\b|\bm est impossible\b"
    r"|\bimprudent que je\b|\bsort de ce que\b|\bne relèvent? pas de\b|\baucune réponse ne peut\b|\bmon rôle ne\b|\bcontraire à mes\b|\bpas autorisée? à\b"
    r"|\bkann (?:ich )?(?:ihnen )?(?:dazu |dabei |leider )?(?:nicht|keine)\b|\bich darf (?:ihnen )?(?:nicht|keine)\b|\bno puedo (?:ayudar|responder|dar|ofrecer|recomendar)\b|\bno me es posible\b"
)
#: Frequent words of each language that the others do not use.
FUNCTION_WORDS = {
    "en": "the of and to is are in for with may when not by or that this it you they was were be been have has had from at as if your only than more after before during while which who what how should can could would will rarely usually often most some people need into about there their",
    "fr": "le les des du une et est sont à au aux pour avec qui en par sur ne pas se sa son ses ou où dans plus si quand après avant pendant très vous nous il elle ils cette ces ce être avoir peut doit faut que chez lorsque puis mais sans sous ma mon mes je j ai votre leur comme ont été",
    "de": "der die das und ist sind nicht ein eine einen zu von mit bei wird werden wenn sie den dem im auf für oder nach sich auch noch nur als aus vor über ohne kann bitte manche besonders dass ihr ihre durch zur zum haben hat nie immer",
    "es": "el los las y son para por su sus lo más si sin con muy pero debe deben cuando después antes también mucha gente conviene sobre todo hay del al como está están puede pueden una es nota pida niños usted esta este ha han",
}
_SETS = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}
EXCLUSIVE = {w: k for k, v in _SETS.items() for w in v if sum(w in o for o in _SETS.values()) == 1}
_LOOKS = str.maketrans({o: latin for latin, others in LOOKALIKES.items() for o in others})
_FORMAT = regex.compile(r"\p{Cf}+")
_POSING = re.compile("[Ͱ-֏ɐ-ʯı]")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_CLAUSE = re.compile(r"[,;:]")
_ENDED = re.compile(r"[.!?…。！？।][\s\"'»”’)\]}*_]*$")
_ITEM = re.compile(r"^\s*(?:[-*•–·▪◦]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S")

_UNFINISHED = re.compile(r"[,:(\[{&+]$|\w-$")
#: Words that no list item or short answer ends with.
DANGLING = frozenset(
    "the a an and or of with from your their its my our le la les l un une des du de d et ou au aux pour dans sur que qui votre vos son sa ses leur der die das den dem ein eine einen einem einer und oder von für ihr ihre "
    "el los las una y o del con por para su sus".split()
)
#: Endings by which a longer word is another form of a whole one.
INFLECTIONS = "s|e|es|x|d|ed|n|en|er|r|ing|ly|ment|al|t|nt|ent"

SCHEMA = "tbl string, row_index bigint, field string, defect string, prompt bigint, opening string, sentences array<bigint>, answers array<boolean>, tail string, whole bigint, related boolean"


def fold(text: str) -> str:
    """The text in plain lower-case characters, for comparison only."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("’", "'")
        text = _FORMAT.sub("", text)
        if _POSING.search(text):
            text = text.translate(_LOOKS)
    return text.lower()


def plain_words(text: str) -> str:
    return " ".join(_WORD.findall(text))


def language(words: list[str]) -> str | None:
    """The language with clearly the most function words, or None."""
    n = dict.fromkeys(_SETS, 0)
    for w in words:
        k = EXCLUSIVE.get(w)
        if k:
            n[k] += 1
    first, second = sorted(n, key=n.get, reverse=True)[:2]
    return first if n[first] >= 2 and n[first] >= 2 * n[second] else None


def is_copy(question: list[str], answer: list[str]) -> bool:
    """Whether the answer is the question, perhaps with a lead-in, and nothing else."""
    if len(answer) < 4 or not question:
        return False
    asked = set(question)
    new = sum(w not in asked for w in answer)
    covered = len(asked & set(answer)) / len(asked)
    return new <= 0.2 * len(answer) and (covered >= 0.5 or new == 0 and " ".join(answer) in " ".join(question))


def is_truncated(folded: str, words: list[str]) -> bool | None:
    """Whether the text stops without an end; None for a list or short answer whose last word decides (see cut_words)."""
    text = folded.rstrip()
    if _ENDED.search(text):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    in_list = len(lines) > 1 and _ITEM.match(lines[-1]) and (len(lines) == 2 or _ITEM.match(lines[-2]))
    if not in_list and len(words) > SHORT_ANSWER:
        return True
    others = [x for x in lines[:-1] if _ITEM.match(x)] if in_list else []
    if others and all(map(_ENDED.search, others)):
        return True
    if len(words) > 1 and (words[-1] in DANGLING or _UNFINISHED.search(text)):
        return True
    return None if len(words) > 1 and text[-1].isalpha() else False


def _hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def inspect(question: str | None, answer: str | None) -> tuple:
    """What one pair shows.

    (defect of the pair itself, declining clause of the opening, sentence hashes,
    whether each sentence may answer, last word if it decides; and of answers that
    may be a template without a known turn: hash of all words, whether a telling
    word is in the question).
    """
    folded = fold(answer or "")
    words = _WORD.findall(folded)
    if not words or "".join(words) in STAND_INS:
        return "empty", None, [], [], None, None, None
    asked = _WORD.findall(fold(question or ""))
    if is_copy(asked, words):
        return "copied_question", None, [], [], None, None, None
    pieces = _SENTENCE.split(folded)
    sentences = [s for s in map(plain_words, pieces) if s]
    declines = [bool(DECLINING.search(s)) for s in sentences]
    opening = None
    if any(declines):
        opening = next((clause for s in pieces for clause in map(plain_words, _CLAUSE.split(s)) if DECLINING.search(clause)), None)
    spoken = language(words)
    cut = is_truncated(folded, words)
    defect = "wrong_language" if spoken and (language(asked) or spoken) != spoken else "truncated" if cut else None
    hashes = [_hashed(s) for s in sentences]
    whole = related = None
    if opening is None and defect is None and len(words) >= BARE_WORDS:
        whole = _hashed(" ".join(words))
        related = not {w for w in words if len(w) >= TELLING_LETTERS}.isdisjoint(asked)
    return defect, opening, hashes, [not d for d in declines], words[-1] if defect is None and cut is None else None, whole, related


def _inspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        questions = b.column(3).to_pylist()
        found = [inspect(q, a) for q, a in zip(questions, b.column(4).to_pylist(), strict=True)]
        columns = list(zip(*found, strict=True)) or [()] * 7
        prompt = [_hashed(q or "") for q in questions]
        kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.string(), pa.int64(), pa.bool_()]
        defect, *others = map(pa.array, columns, kinds)
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], defect, pa.array(prompt, pa.int64()), *others],
            names=["tbl", "row_index", "field", "defect", "prompt", "opening", "sentences", "answers", "tail", "whole", "related"],
        )


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[str, int] = {}
    for b in batches:
        for column in b.columns:
            values, off = split_words(flat(column))
            codes, distinct = coded(values)
            width = max(1, len(distinct))
            code = distinct_sorted(rows_of(off) * width + codes) % width
            for w, n in zip(distinct.to_pylist(), np.bincount(code, minlength=len(distinct)).tolist(), strict=True):
                count[w] = count.get(w, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])


def cut_words(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """(tail): last words found in no text but as a last word that decides, and that begin a longer word which is not just another form."""
    found = materialize(pairs.select("question", "answer").mapInArrow(_vocabulary, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    tails = seen.where("tail is not null").groupBy("tail").agg(F.count(F.lit(1)).alias("last"))
    unknown = materialize(tails.join(found, F.col("tail") == F.col("word"), "left").where("n is null or n <= last").select("tail"))  # its own size is known, so it is broadcast if anything, not all beginnings
    begun = found.select("word", F.explode(F.expr("transform(sequence(1, greatest(1, length(word) - 1)), k -> left(word, k))")).alias("tail"))
    return begun.join(unknown, "tail").where(f"length(word) > length(tail) and not substring(word, length(tail) + 1) rlike '^({INFLECTIONS})$'").select("tail").distinct()


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 62, BANDS * ROWS_PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for b in batches:
        ids, bands, sets = [], [], []
        for k, text in enumerate(b.column(1).to_pylist()):
            words = sorted({xxhash.xxh3_64_intdigest(w) for w in text.split()})
            with np.errstate(over="ignore"):
                h = np.array(words, np.uint64)[:, None] * a[None, :]
                h ^= h >> np.uint64(32)
                low = (h * np.uint64(0x9E3779B97F4A7C15)).min(0).reshape(BANDS, ROWS_PER_BAND)
                band = (low * np.uint64(0xD6E8FEB86659FD93)).sum(1) * np.uint64(2 * BANDS + 1) + np.arange(BANDS, dtype=np.uint64)
            ids += [b.column(0)[k].as_py()] * BANDS
            bands += band.view(np.int64).tolist()
            sets += [[w - (1 << 63) for w in words]] * BANDS
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bands, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "band", "words"])


def opening_clusters(openings: DataFrame) -> DataFrame:
    """openings (id, opening) to (id, cluster) of every opening: alike openings that share a MinHash band are in one cluster.

    First each opening is verified against the first of its band; then, in
    bands that hold more than one of the clusters so found, every pair of
    openings of different clusters is.
    """
    banded = materialize(openings.mapInArrow(_bands, "id bigint, band bigint, words array<bigint>"))

    def alike(a: str, b: str):
        shared = F.size(F.array_intersect(a, b))
        return shared >= OPENING_LIKENESS * (F.size(a) + F.size(b) - shared)

    def clusters(links: DataFrame) -> DataFrame:
        return connected_components(links, "id", "other").select(F.col("node").alias("id"), F.col("component").alias("cluster"))

    first = banded.groupBy("band").agg(F.min(F.struct("id", "words")).alias("first"))
    links = banded.join(first, "band").where(alike("words", "first.words")).select("id", F.col("first.id").alias("other"))
    links = materialize(links.unionAll(banded.select("id", F.col("id").alias("other"))).distinct())
    placed = banded.join(materialize(clusters(links)), "id")
    mixed = placed.groupBy("band").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("band")
    rest = materialize(placed.join(mixed, "band"))
    a = rest.select("band", "id", "words", "cluster")
    b = rest.select("band", F.col("id").alias("other"), F.col("words").alias("others"), F.col("cluster").alias("apart"))
    more = a.join(b, "band").where((F.col("id") < F.col("other")) & (F.col("cluster") != F.col("apart")) & alike("words", "others")).select("id", "other")
    return clusters(links.unionAll(more.distinct()))


def revealed_templates(seen: DataFrame) -> DataFrame:
    """(id): first sentences of whole answers to many prompts that most of these have nothing to do with, and that are a good part of what opens so."""
    # the same words may be cut into sentences in several ways, each of which is counted for itself
    asked = seen.where("whole is not null").groupBy("whole", F.get("sentences", F.lit(0)).alias("id"), "prompt").agg(F.avg((~F.col("related")).cast("double")).alias("unrelated"))
    whole = asked.groupBy("whole", "id").agg(F.count(F.lit(1)).alias("prompts"), F.avg("unrelated").alias("unrelated"))
    recurs = (F.col("prompts") >= BARE_PROMPTS) & (F.col("unrelated") >= UNRELATED_SHARE)
    opening = whole.groupBy("id").agg(F.sum("prompts").alias("all"), F.sum(F.when(recurs, F.col("prompts"))).alias("recurring"))
    return opening.where(F.col("recurring") >= WHOLE_SHARE * F.col("all")).select("id")


def refused(declining: DataFrame, clusters: DataFrame, revealed: DataFrame, stock: DataFrame, key: list[str]) -> DataFrame:
    """(key): the rows of declining that open with a template and answer nothing beside it."""
    # distinct prompts of an opening before the join, so that the rows of a hot template do not meet in it
    asked = declining.select("id", "prompt").distinct().join(clusters, "id")
    refusing = asked.groupBy("cluster").agg(F.countDistinct("prompt").alias("prompts")).where(F.col("prompts") >= MIN_PROMPTS)
    templates = clusters.join(refusing, "cluster").select("id").unionAll(revealed).distinct()
    answering = materialize(declining.select(*key, F.explode(F.arrays_zip("sentences", "answers")).alias("s")).where("s.answers").select(*key, F.col("s.sentences").alias("sentence")))
    closed = look_up(answering, stock, ["sentence"]).select(*key, F.lit(1).alias("closed"), F.lit(0).alias("said"))
    ends = answering.select(*key, F.lit(0).alias("closed"), F.lit(1).alias("said")).unionAll(closed).groupBy(*key).agg(F.sum("closed").alias("closed"), F.sum("said").alias("said"))
    return look_up(declining.select(*key, "id"), templates, ["id"]).select(*key).join(ends.where("said > closed"), key, "left_anti").distinct()


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (tbl, row_index, field, question, answer) to (tbl, row_index, field, defect) of the defective ones."""
    key = ["tbl", "row_index", "field"]
    seen = materialize(pairs.select(*key, "question", "answer").mapInArrow(_inspected, SCHEMA))
    revealed = materialize(revealed_templates(seen))
    turned = F.when(F.col("opening").isNotNull(), F.xxhash64("opening")).otherwise(F.col("known"))
    opened = seen.join(revealed.withColumnRenamed("id", "known"), F.get("sentences", F.lit(0)) == F.col("known"), "left").withColumn("id", turned)  # empty answers have no sentence
    own = F.expr("if(opening is null, transform(answers, (a, k) -> a and k > 0), answers)")  # the first sentence of a revealed template answers nothing
    declining = materialize(opened.where("id is not null").select(*key, "prompt", "opening", "id", "sentences", own.alias("answers")))
    clusters = materialize(opening_clusters(declining.where("opening is not null").groupBy("id").agg(F.min("opening").alias("opening"))))
    spoken = opened.select("prompt", F.col("id").isNotNull().alias("beside"), F.explode("sentences").alias("sentence"))
    stock = spoken.groupBy("sentence").agg(F.avg(F.col("beside").cast("double")).alias("share"), F.approx_count_distinct("prompt").alias("prompts"))
    stock = stock.where((F.col("share") >= CLOSING_SHARE) & (F.col("prompts") >= MIN_PROMPTS)).select("sentence")
    refusals = refused(declining, clusters, revealed, stock, key).withColumn("refused", F.lit(True))
    kind = F.when(F.col("refused"), "refusal").otherwise(F.col("defect"))
    cut = cut_words(pairs, seen).withColumn("cut", F.lit("truncated"))
    judging = opened.where("tail is not null").select(*key, "tail", "id").join(cut, "tail", "left").select(*key, F.col("cut").alias("defect"), "id")
    rows = opened.where("tail is null").select(*key, "defect", "id").unionAll(judging)
    plain = rows.where("id is null and defect is not null").select(*key, "defect")
    judged = rows.where("id is not null").join(refusals, key, "left").select(*key, kind.alias("defect")).where("defect is not null")
    return plain.unionByName(judged)


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question and answer of both tables."""
    sft = table(spark, sf_dir, "sft_records").select(
        F.lit("sft_records").alias("tbl"), F.col("row_index").cast("bigint").alias("row_index"), F.lit("response").alias("field"), F.col("instruction").alias("question"), F.col("response").alias("answer")
    )
    pref = table(spark, sf_dir, "preference_triples")
    said = lambda c: F.try_element_at(F.filter(c, lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), said(c).alias("answer")) for c in ("chosen", "rejected")]))
    pairs = pref.select(F.lit("preference_triples").alias("tbl"), F.col("row_index").cast("bigint").alias("row_index"), F.col("prompt").alias("question"), sides.alias("s"))
    return reduce(DataFrame.unionByName, [sft, pairs.select("tbl", "row_index", "s.field", "question", "s.answer")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(answer_pairs(spark, sf_dir))


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
