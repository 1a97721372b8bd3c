"""Text normalisation, digests and lexical checks as column expressions.

Two normal forms exist for every comparison key. The fast one runs inside
whole-stage code generation; the exact one is an Arrow UDF with full NFKC and
case folding. They agree except for compatibility characters and the scripts
whose case folding is more than lower case.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvedge.functions.arrays import let

NOT_WORD = r"[^\p{L}\p{N}_]+"
#: Patterns whose counts must agree with published audits.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<!\d)(?:\+?1[ .-]?)?(?:\(?\d{3}\)?[ .-]?)\d{3}[ .-]\d{4}(?!\d)"
PLACEHOLDER = r"\[(?:NAME|LOCATION|CONTACT)\]"


def or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """White space of any kind cut from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_fast(c: Column) -> Column:
    """Letters, digits and underscores in folded case."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), NOT_WORD, "")


def norm_lower(c: Column) -> Column:
    """As norm_fast but with plain lower case, the key of the hash split."""
    return F.regexp_replace(F.lower(c), NOT_WORD, "")


_NON_WORD = re.compile(r"\W+")


@F.pandas_udf(T.StringType())
def norm_exact(texts: pd.Series) -> pd.Series:
    """NFKC, full case folding, then only word characters."""
    return texts.map(lambda t: None if t is None else _NON_WORD.sub("", unicodedata.normalize("NFKC", t).casefold()))


@F.pandas_udf(T.StringType())
def ascii_words(texts: pd.Series) -> pd.Series:
    """NFKD without anything beyond ASCII, lower case, single blanks."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower().split()))


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def content_hash(c: Column) -> Column:
    """Digest of the normal form; empty for a text without word characters."""
    n = norm_fast(or_empty(c))
    return F.when(n == "", F.lit("")).otherwise(sha(n))


def stable_key(*parts: Column | str) -> Column:
    """Digest of the parts joined by colons; strings are literals."""
    return sha(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def record_key(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 24 hex digits of the stable key."""
    return F.concat(F.lit(prefix), F.substring(stable_key(*parts), 1, 24))


def digest_int(digest: Column, offset: int = 0) -> Column:
    """Eight hex digits of a digest, from offset on, as a number."""
    return F.conv(F.substring(digest, offset + 1, 8), 16, 10).cast("bigint")


def pick_by_digest(key: Column, values: list[str], offset: int = 0) -> Column:
    """One of the values by the digest of a key; other offsets give other picks of the same key."""
    return F.element_at(F.array(*map(F.lit, values)), (digest_int(sha(key), offset) % len(values) + 1).cast("int"))


def emails_with_suffix(c: Column, suffixes: list[str]) -> Column:
    """The addresses of mail in a text whose last domain label is in the list."""
    found = F.regexp_extract_all(or_empty(c), F.lit(EMAIL), F.lit(0))
    return F.filter(found, lambda m: F.lower(F.substring_index(m, ".", -1)).isin(suffixes))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with fields in name order and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def email_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(EMAIL)), F.lit(0))


def phone_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(PHONE)), F.lit(0))


def placeholder_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(PLACEHOLDER)), F.lit(0))


def truncated(c: Column, limit: int) -> tuple[Column, Column]:
    """(text cut at limit characters without trailing white space, whether it was cut)."""
    cut = F.when(F.length(c) > limit, F.regexp_replace(F.substring(c, 1, limit), r"(?U)\s+$", "")).otherwise(c)
    return cut, F.coalesce(F.length(c) > limit, F.lit(False))


def plain_words(c: Column) -> Column:
    """Array of words in folded case."""
    return F.filter(F.split(F.lower(or_empty(c)), NOT_WORD), lambda w: w != "")


def has_repeated_phrase(words: Column, widths: tuple[int, ...] = (3, 4, 5, 6)) -> Column:
    """Whether a phrase of one of the widths is followed at once by itself."""

    def repeats(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= 2 * n, F.sequence(F.lit(1), F.size(w) - 2 * n + 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda i: F.slice(w, i, n) == F.slice(w, i + n, n))

    return let(words, lambda w: reduce(lambda a, b: a | b, [repeats(w, n) for n in widths]))


#: Signs of a damaged output with the names they are reported by, and the widths and lengths they are judged at.
HTML_ENTITY = r"(?i)&#(?:[0-9]+|x[0-9a-f]+);"
MASK_LEFT = r"<(?:PERSON|LOCATION|DATE_TIME)>"
REPEATED_WIDTH, TRUNCATED_FROM = 6, 150


def malformed_reasons(c: Column) -> Column:
    """Signs of a damaged output, in a fixed order."""
    text = or_empty(c)
    checks = [
        ("html_entity", text.rlike(HTML_ENTITY)),
        ("placeholder", text.rlike(MASK_LEFT)),
        ("repeated_phrase", has_repeated_phrase(plain_words(c), (REPEATED_WIDTH,))),
        ("likely_truncated", (F.length(text) >= TRUNCATED_FROM) & text.rlike(r"[\p{L}\p{N}]$")),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))


def host_url(c: Column, domain: str) -> Column:
    """The first https address below a domain in a log line, without its path; null without one."""
    return F.nullif(F.regexp_extract(or_empty(c), r"https://[a-z0-9-]+\." + domain.replace(".", r"\."), 0), F.lit(""))


def multiset_digest(digest: Column) -> Column:
    """One digest of a set of SHA-256 row digests, whatever their order: an aggregate of four sums and a count, so no task holds the rows."""
    part = lambda k: F.sum(F.conv(F.substring(digest, 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)"))
    return sha(F.concat_ws(",", *[part(k).cast("string") for k in range(4)], F.count(digest).cast("string")))
