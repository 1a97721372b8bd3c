"""Problem 4: one consistent form for text that only looks the same.

Method: the code points and letter-plus-accent pairs of all texts are counted.
Union-find joins every string with its looks: full-width and presentation forms,
joined letters, accents written apart, spaces and invisible characters through
their Unicode decompositions, and letters of other alphabets through a table of
look-alikes and the Unicode names of small capitals; classes are transitive. The
most frequent stable member of a class (one that normalisation leaves alone)
represents it. A multi-pattern automaton then rewrites each text greedily,
longest match first; a letter with several accents is composed before, whatever
their number. Only texts with a character that some rule begins with, or with an
accent apart, are rewritten; both are read off the rules themselves.

Look-alike letters are only rewritten inside a Latin word: a run of letters
with an ordinary Latin letter in it, or one made of nothing but look-alikes in
a text that has such mixed words. Whole foreign words, Greek symbols and units,
superscripts, fractions and typographic marks stay.

Counting is one aggregate of at most as many rows as there are code points and
pairs of a letter and an accent; rewriting is a scan without a shuffle. Defined
results: null stays null and is never reported; empty texts stay; a Latin letter
with an accent apart that no character combines with it is reported and stays;
repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.llm.tokens import flat
from selvedge.session import table

#: Letters of other alphabets and special letter forms that look like a Latin letter.
LOOKALIKES = {
    "a": "аɑα", "b": "Ьᖯ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "f": "ƒ", "g": "ɡ", "h": "һ", "i": "іıιɩ", "j": "јϳ", "k": "κк", "l": "ӏ",
    "n": "ո", "o": "оοօσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "τт", "u": "υսʋ", "v": "νѵ", "w": "ԝѡω", "x": "хχ", "y": "уγү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
#: Decompositions that are another look of the same character; superscripts, fractions, circles and squares are not.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")

COUNTS = "part string, n bigint"
_ACCENTED = regex.compile(r"(\p{L}\p{M})\p{M}*")
_ACCENTS = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}]\p{M}{2,}")
_SMALL_CAPITAL = re.compile(r"LATIN LETTER SMALL CAPITAL ([A-Z])$")
#: A Latin letter with an accent of its own; those that a character holds with its letter are rewritten before they are looked for.
APART = r"\p{Latin}\p{Mn}"
_WORD = regex.compile(r"[\p{L}\p{M}]+")


def is_invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef"


def other_look(part: str) -> str | None:
    """What one counted string looks like, by Unicode's own tables; None when it is its own usual form."""
    if len(part) > 1:
        composed = unicodedata.normalize("NFC", part)
        return composed if composed != part else None
    if is_invisible(part):
        return ""
    if unicodedata.category(part) == "Zs":
        return " " if part != " " else None
    kind, _, _ = unicodedata.decomposition(part).partition(" ")
    plain = unicodedata.normalize("NFKC", part)
    joined = kind == "<compat>" and len(plain) > 1 and plain.isalpha() and part.isalpha()
    return plain if plain != part and (kind in SAME_LOOK or joined) else None


def posed_letter(ch: str) -> str | None:
    """The Latin letter that a small capital or a compatibility form of one letter poses as inside a word."""
    found = _SMALL_CAPITAL.match(unicodedata.name(ch, ""))
    if found:
        return found[1].lower()
    plain = unicodedata.normalize("NFKC", ch)
    single = unicodedata.decomposition(ch).startswith("<compat>") and len(plain) == 1 and plain.isascii() and plain.isalpha()
    return plain if single else None


class Classes:
    """Union-find over strings."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        self.parent.setdefault(s, s)
        while self.parent[s] != s:
            self.parent[s] = self.parent[self.parent[s]]
            s = self.parent[s]
        return s

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for s in list(self.parent):
            out.setdefault(self.find(s), []).append(s)
        return out


def rewrite_rules(counts: dict[str, int]) -> tuple[dict[str, str], dict[str, str]]:
    """(string to representative everywhere, letter to representative inside Latin words)."""
    same, look = Classes(), Classes()
    for part in counts:
        plain = other_look(part)
        if plain is not None:
            same.union(part, plain)
            look.union(part, plain)
    posing = {o: latin for latin, others in LOOKALIKES.items() for o in others}
    posing |= {p: posed_letter(p) for p in counts if len(p) == 1 and posed_letter(p)}
    for o, latin in posing.items():
        look.union(o, latin)
    stable = lambda s: unicodedata.is_normalized("NFKC", s) and (s in ("", " ") or other_look(s) is None)

    def representatives(classes: Classes) -> dict[str, str]:
        out = {}
        for members in classes.members().values():
            # the empty string and the plain space are always there; ties go to the smaller string
            rep = min((m for m in members if stable(m)), key=lambda m: (m not in ("", " "), -counts.get(m, 0), m), default=None)
            out |= {m: rep for m in members if rep is not None and m != rep}
        return out

    letters = set(posing) | set(LOOKALIKES)
    in_words = {m: r for m, r in representatives(look).items() if m in letters and r.isascii()}
    return {m: r for m, r in representatives(same).items() if m}, {m: r for m, r in in_words.items() if not m.isascii()}


class Rewriter:
    """Greedy leftmost-longest rewriting of texts."""

    def __init__(self, everywhere: dict[str, str], in_words: dict[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for s, r in everywhere.items():
            self.automaton.add_word(s, (len(s), r))
        self.some = bool(everywhere)
        if self.some:
            self.automaton.make_automaton()
        self.letters = str.maketrans(in_words)
        self.posing = frozenset(in_words)
        begins = sorted({s for s in everywhere if len(s) == 1} | self.posing)  # longer ones have an accent
        #: Found in every text that may be rewritten or reported.
        listed = "".join(rf"\x{{{ord(ch):x}}}" for ch in begins)
        self.may_change = rf"\p{{M}}|[{listed}]" if begins else r"\p{M}"

    def ordinary(self, ch: str) -> bool:
        return ch.isalpha() and ch not in self.posing and unicodedata.name(ch, "").startswith("LATIN ")

    def __call__(self, text: str) -> str:
        text = _ACCENTS.sub(lambda m: unicodedata.normalize("NFC", m[0]), text)
        if self.some:
            out, at = [], 0
            for end, (n, r) in self.automaton.iter_long(text):
                out += (text[at : end + 1 - n], r)
                at = end + 1
            text = "".join(out) + text[at:] if out else text
        if self.posing.isdisjoint(text):
            return text
        mixed = any(self.is_mixed(m[0]) for m in _WORD.finditer(text))
        return _WORD.sub(lambda m: self.word(m[0], mixed), text) if mixed else text

    def is_mixed(self, word: str) -> bool:
        return not self.posing.isdisjoint(word) and any(map(self.ordinary, word))

    def word(self, word: str, mixed: bool) -> str:
        all_posing = all(ch in self.posing for ch in word)
        return word.translate(self.letters) if self.is_mixed(word) or mixed and all_posing and len(word) > 1 else word


def _part_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    points: dict[int, int] = {}
    strings: dict[str, int] = {}
    marks: dict[int, bool] = {}
    for b in batches:
        for column in b.columns:
            text = "\n".join(flat(column).to_pylist())
            codes, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            accented = False
            for c, k in zip(codes.tolist(), n.tolist(), strict=True):
                points[c] = points.get(c, 0) + k
                if c not in marks:
                    marks[c] = unicodedata.category(chr(c))[0] == "M"
                accented |= marks[c]
            if accented:
                for m in _ACCENTED.finditer(text):
                    strings[m[1]] = strings.get(m[1], 0) + 1
    parts = {chr(c): n for c, n in points.items() if not 0xD800 <= c < 0xE000} | strings
    yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.string()), pa.array(list(parts.values()), pa.int64())], names=["part", "n"])


def rewriter_for(texts: DataFrame) -> Rewriter:
    """The rewriter that the counts over all columns of texts give."""
    counted = texts.mapInArrow(_part_counts, COUNTS).groupBy("part").agg(F.sum("n").alias("n"))
    return Rewriter(*rewrite_rules({r.part: r.n for r in counted.collect()}))


FIELDS = [("sft_records", "instruction"), ("sft_records", "response"), ("preference_triples", "prompt")]


def _sources(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, list[str]]]:
    tables = list(dict.fromkeys(t for t, _ in FIELDS))
    return [(t, table(spark, sf_dir, t), [f for tbl, f in FIELDS if tbl == t]) for t in tables]


def _rewriter(spark: SparkSession, sf_dir: str) -> Rewriter:
    columns = [df.select(F.col(f).alias("text")) for _, df, fields in _sources(spark, sf_dir) for f in fields]
    return rewriter_for(reduce(DataFrame.unionAll, columns))


def consistent_texts(df: DataFrame, tbl: str, id_col: str, fields: list[str], rewriter: Rewriter, changed_only: bool) -> DataFrame:
    """(tbl, row_index, field, text, changed, found): one row per text in its consistent form, whether that is another one, and whether it held odd characters."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    rows = df.select(F.lit(tbl).alias("tbl"), F.col(id_col).cast("bigint").alias("row_index"), pairs.alias("p")).select("tbl", "row_index", "p.field", "p.text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odd = np.flatnonzero(np.asarray(pc.match_substring_regex(flat(b.column(3)), rewriter.may_change)))
            before = b.column(3).take(pa.array(odd)).to_pylist()
            after = [rewriter(t) for t in before]
            changed, found = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, bool)
            changed[odd] = [x != y for x, y in zip(before, after, strict=True)]
            found[odd] = np.asarray(pc.match_substring_regex(pa.array(after, pa.large_string()), APART)) | changed[odd]
            texts = b.column(3)
            if changed.any():
                place = np.zeros(b.num_rows, np.int64)
                place[odd] = np.arange(len(odd))
                texts = pc.if_else(pa.array(changed), pa.array(after, pa.string()).take(pa.array(place)), texts)
            out = pa.RecordBatch.from_arrays([*b.columns[:3], texts, pa.array(changed), pa.array(found)], names=["tbl", "row_index", "field", "text", "changed", "found"])
            yield out.filter(out.column(5)) if changed_only else out

    return rows.mapInArrow(rewrite, "tbl string, row_index bigint, field string, text string, changed boolean, found boolean")


def _all(spark: SparkSession, sf_dir: str, changed_only: bool) -> DataFrame:
    rewriter = _rewriter(spark, sf_dir)
    parts = [consistent_texts(df, t, "row_index", fields, rewriter, changed_only) for t, df, fields in _sources(spark, sf_dir)]
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, True).select("tbl", "row_index", "field")


def p4_consistent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, False).drop("found")


_POSE = "".join(sorted({o for others in LOOKALIKES.values() for o in others}))
_LATIN = r"A-Za-zÀ-ÖØ-öø-İĲ-ňŊ-ſ"
_ODD = (
    r"[\x{FF01}-\x{FF5E}\x{FB00}-\x{FB06}\p{Cf}\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}\x{FE00}-\x{FE0F}]|[A-Za-zÀ-ɏ]\p{M}"
    rf"|[{_LATIN}][\p{{L}}\p{{M}}]*[{_POSE}]|[{_POSE}][\p{{L}}\p{{M}}]*[{_LATIN}]"
)
SQL = {
    "p4_found": " UNION ALL ".join(f"SELECT '{t}' AS tbl, row_index, '{f}' AS field FROM {t} WHERE regexp_matches({f}, '{_ODD}')" for t, f in FIELDS)
}
QUERIES = {"p4_found": p4_found, "p4_consistent_texts": p4_consistent_texts}
