"""Direct identifiers: counts, masks, findings and span masking.

The pattern tier finds addresses of mail and network, card, account and phone
numbers, patient references and names after an explicit cue. Names, places and
dates in running text need a model: a detector, any function from a text to
(start, end, entity) spans, can be given to findings() and anonymized() and is
used beside the patterns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvedge.functions.text import EMAIL, PHONE, or_empty

#: The entities, and those that are masked while serving.
ALL_ENTITIES = ["PERSON", "PATIENT_NAME", "PHONE_NUMBER", "EMAIL_ADDRESS", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "LOCATION", "DATE_TIME", "PATIENT_REFERENCE"]
SERVING_ENTITIES = ["PATIENT_NAME", "PHONE_NUMBER", "EMAIL_ADDRESS", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "PATIENT_REFERENCE"]
#: Patient references and names after a cue, one pattern a language, matched without regard to case.
REFERENCE_FR = r"\b(?:patient|dossier)\s*(?:id|n°|numero|numéro)\s*[:#-]?\s*[A-Z0-9][A-Z0-9-]{3,}\b"
NAME_FR = r"\b(?:je m['’]appelle|nom du patient\s*(?:est|:)|M(?:me|lle)?\.?|Monsieur|Madame)\s+[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]+(?:[-'][A-ZÀ-ÖØ-Ý]?[a-zà-öø-ÿ]+)?(?:\s+[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]+(?:[-'][A-ZÀ-ÖØ-Ý]?[a-zà-öø-ÿ]+)?){0,2}\b"
NAME_EN = r"\b(?:my name is|patient(?:'s)? name\s*(?:is|:)|Mr\.?|Mrs\.?|Ms\.?)\s+[A-Z][a-z]+(?:[-'][A-Z]?[a-z]+)?(?:\s+[A-Z][a-z]+(?:[-'][A-Z]?[a-z]+)?){0,2}\b"
#: Patterns in the order of their use; an earlier entity's placeholder is never matched by a later pattern.
ENTITIES: dict[str, str] = {
    "EMAIL_ADDRESS": EMAIL,
    "IBAN_CODE": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "CREDIT_CARD": r"\b(?:\d{4}[ -]?){3}\d{4}\b",
    "PHONE_NUMBER": PHONE,
    "PATIENT_REFERENCE": f"(?iu){REFERENCE_FR}",
    "PATIENT_NAME": f"(?iu)(?:{NAME_FR}|{NAME_EN})",
}
#: Finds spans (start, end, entity) in a text.
Detector = Callable[[str], Iterable[tuple[int, int, str]]]


def entity_counts(text: Column, entities: dict[str, str] = ENTITIES) -> dict[str, Column]:
    return {k: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for k, p in entities.items()}


def masked(text: Column, entities: dict[str, str] = ENTITIES) -> Column:
    """The text with each match replaced by its entity in angle brackets."""
    for k, p in entities.items():
        text = F.regexp_replace(text, p, f"<{k}>")
    return text


def privacy_status(masked_text: Column, entities: dict[str, str] = ENTITIES) -> Column:
    """passed, or manual_review_required when a masked text still matches outside its own placeholders; empty for blank."""
    bare = F.regexp_replace(masked_text, "<(?:" + "|".join(entities) + ")>", " ")
    left = reduce(lambda a, b: a | b, [bare.rlike(p) for p in entities.values()])
    return F.when(F.trim(or_empty(masked_text)) == "", "empty").when(left, "manual_review_required").otherwise("passed")


FINDING = "id bigint, field string, entity string, start int, end int, span string"


def findings(rows: DataFrame, id_col: str, fields: list[str], entities: dict[str, str] = ENTITIES, detector: Detector | None = None) -> DataFrame:
    """One row per match: (id, field, entity, start, end, span), positions in characters.

    Earlier entities come first where matches overlap, and the detector's spans
    last. An error of the detector fails the task: no text passes unread.
    """
    import regex

    compiled = {k: regex.compile(p) for k, p in entities.items()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            ids, names, texts = (b.column(k).to_pylist() for k in range(3))
            for i, f, t in zip(ids, names, texts, strict=True):
                taken: list[tuple[int, int]] = []
                for k, p in compiled.items():
                    new = [m for m in p.finditer(t or "") if all(m.end() <= a or b <= m.start() for a, b in taken)]
                    taken += [m.span() for m in new]
                    out += [(i, f, k, m.start(), m.end(), m[0]) for m in new]
                for start, end, k in sorted(detector(t)) if detector and t else ():
                    if all(end <= a or b <= start for a, b in taken):
                        taken.append((start, end))
                        out.append((i, f, k, start, end, t[start:end]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "field", "entity", "start", "end", "span"])

    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), long.alias("p")).select("id", "p.field", "p.text").mapInArrow(find, FINDING)


def span_violations(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Findings that cannot be masked: no such text (orphan), a span that is not the text at its place, or an overlap.

    texts (id, field, text), found (id, field, start, end, span).
    """
    spans = found.select("id", "field", "start", "end", "span").distinct()
    joined = spans.join(texts, ["id", "field"], "left")
    at = F.expr("substring(text, start + 1, end - start)")
    bad = F.when(F.col("text").isNull(), "orphan").when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | ~at.eqNullSafe(F.col("span")), "span_mismatch")
    alone = joined.select("id", "field", "start", "end", bad.alias("reason")).where("reason is not null")
    a, b = spans.alias("a"), spans.alias("b")
    near = F.expr("a.id = b.id and a.field = b.field and a.start <= b.start and b.start < a.end and (a.start < b.start or a.end < b.end)")
    overlaps = a.join(b, near).select("a.id", "a.field", "a.start", "a.end", F.lit("overlap").alias("reason"))
    return alone.unionByName(overlaps)


def mask_spans(texts: DataFrame, found: DataFrame, placeholder: str) -> DataFrame:
    """texts (id, field, text) with the found spans replaced, from right to left; and how many."""
    spans = found.groupBy("id", "field").agg(F.sort_array(F.collect_set(F.struct("start", "end")), asc=False).alias("spans"))
    cut = F.expr(f"aggregate(spans, text, (t, s) -> concat(substring(t, 1, s.start), '{placeholder}', substring(t, s.end + 1)))")
    joined = texts.join(spans, ["id", "field"], "left")
    return joined.select("id", "field", F.coalesce(cut, F.col("text")).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("masked"))


def anonymized(rows: DataFrame, id_col: str, fields: list[str], policy: list[str] = SERVING_ENTITIES, detector: Detector | None = None) -> DataFrame:
    """(id, field, text, found, left, status): texts with the entities of a policy replaced by <ENTITY>, and a second look at the result.

    left counts what the second look finds outside the placeholders that the first
    put in; with any of it the status is manual_review_required, of a blank text
    empty, else passed. A placeholder that the text brought along is looked into.
    """
    patterns = {k: p for k, p in ENTITIES.items() if k in policy}
    kept = lambda t: [x for x in (detector(t) if detector else ()) if x[2] in policy]
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    texts = rows.select(F.col(id_col).cast("bigint").alias("id"), long.alias("p")).select("id", "p.field", "p.text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = {k: regex.compile(p) for k, p in patterns.items()}

        def spans(t: str) -> list[tuple[int, int, str]]:
            taken: list[tuple[int, int, str]] = []
            for k, p in compiled.items():
                taken += [(*m.span(), k) for m in p.finditer(t) if all(m.end() <= a or b <= m.start() for a, b, _ in taken)]
            taken += [x for x in kept(t) if all(x[1] <= a or b <= x[0] for a, b, _ in taken)]
            return sorted(taken)

        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                parts, own, at, size = [], [], 0, 0
                for start, end, k in spans(t) if t else ():
                    parts += [t[at:start], f"<{k}>"]
                    size += start - at
                    own.append((size, size + len(k) + 2))
                    size, at = size + len(k) + 2, end
                new = None if t is None else "".join(parts) + t[at:]
                left = sum(all(e <= a or b2 <= s for a, b2 in own) for s, e, _ in spans(new)) if new else 0
                status = "empty" if not (t or "").strip() else "manual_review_required" if left else "passed"
                out.append((new, len(own), left, status))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(c, ty) for c, ty in zip(cols, [pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True))], names=["id", "field", "text", "found", "left", "status"])

    return texts.mapInArrow(replace, "id bigint, field string, text string, found bigint, left bigint, status string")


def record_decisions(records: DataFrame, found: DataFrame, id_col: str, direct: list[str]) -> tuple[DataFrame, DataFrame]:
    """(private, public): findings with their text, and one text-free row per record with its status and counts.

    A record with a direct identifier is direct, one with other findings only is
    contextual, one without any is clear.
    """
    counts = found.groupBy("id").agg(F.count(F.lit(1)).alias("findings"), F.max(F.col("entity").isin(direct).cast("int")).alias("is_direct"))
    status = F.when(F.col("is_direct") == 1, "direct").when(F.col("findings") > 0, "contextual").otherwise("clear")
    ids = records.select(F.col(id_col).cast("bigint").alias("id")).distinct()
    return found, ids.join(counts, "id", "left").select("id", status.alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"))
