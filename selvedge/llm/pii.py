"""Problem 1: personal data inside free text.

Method: a semi-Markov conditional random field. Patterns propose bounded
segments (an e-mail address, a run of digits, a house number with its street,
one to three words around a title or given name), features of whole spans score
each segment under each type, and dynamic programming over the segments of a
text chooses boundaries and types together; neighbours in one block of contact
data are scored as a pair. The weights are trained by exact log-likelihood
(forward-backward over the same segments) on the made texts of pii_training.py.

What the model knows of the corpus is counted over all its texts: the ordinary
words (found in more than COMMON of the texts, so at most words per text /
COMMON of them) and given names (first words of names in unmistakable places
with MIN_SURNAMES different surnames, of which there are at most 1 / NAME_SHARE).

Finding is a scan without a shuffle. Defined results: null and empty texts hold
nothing; texts are read whole; positions count characters of the original text;
message lists or messages that are null are skipped but keep their place;
repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.llm.tokens import coded, distinct_sorted, flat, hash64, rows_of, words
from selvedge.llm.lookalikes import LOOKALIKES, is_invisible
from selvedge.llm.pii_training import BLOCKS, CARRIERS, DECOYS, GIVEN_NAMES, training_texts
from selvedge.session import materialize, table

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
COMMON = 0.0005
COMMON_LEAST = 10
MIN_SURNAMES = 2
#: A learned given name is in more than this share of the unmistakable places.
NAME_SHARE = 0.00001
#: A word in more than this share of the texts is no given name.
NO_NAME = 0.005
#: Passes over the training texts and step size of AdaGrad.
EPOCHS, STEP = 4, 0.3
#: Characters between two segments of a block at most.
LINKED = 24

#: Word classes for the features, in lower case.
TITLES = "dr dr. mr mr. mrs mrs. ms ms. miss prof prof. pr pr. nurse doctor professor m. mme mlle madame mademoiselle monsieur docteur professeur sir".split()
STREETS_FR = "rue avenue boulevard place quai impasse allée chemin route cours square passage sentier ruelle faubourg esplanade promenade voie bd av".split()
STREETS_EN = "street st road rd avenue ave lane ln terrace drive close crescent court row way place square gardens grove hill walk mews park boulevard blvd parade".split()
NAME_CUES = "name is|called|signed by|seen by|according to|regards,|sincerely,|patient:|patient :|m'appelle|m’appelle|selon|signé|cordialement,|reçue par|reçu par|vu par|vue par|nommé|nommée|mr|mrs".split("|")
LABELS = {
    "phone": "tel tél telephone téléphone phone mobile portable cell call fax appel appelez rappelez rappeler joindre reached reach number numéro dial ligne".split(),
    "id": "passport passeport insurance assurance member id mrn ipp nir ssn nss nhs security sécurité sociale social dossier file patient identity identité carte card assuré adhérent mutuelle immatriculation record chart".split(),
    "other": "lot batch article ref référence reference result résultat interval intervalle valeurs usuelles norme isbn issn order commande serial série volume page pages version score pressure tension model modèle device produit product doi code invoice facture mg kg".split(),
}
NOT_AFTER_NAME = "hospital road street score scale sign syndrome disease test clinic avenue lane centre center hôpital clinique index classification method méthode manoeuvre foundation fondation university institute institut".split()
NOT_BEFORE_NAME = "rue avenue boulevard place quai impasse allée chemin route syndrome maladie score échelle signe test hôpital clinique disease in at near à de la le the".split()

_LOCAL = r"(?<![\w.+-])\w[\w.+-]*"
_BRACKETED, _BARE = r"(?:at|arobase|chez)", r"(?:at|arobase)"
_AT = rf"(?:[^\S\n]?@[^\S\n]?|[^\S\n]?[\[({{<][^\S\n]?{_BRACKETED}[^\S\n]?[\])}}>][^\S\n]?|[^\S\n]{_BARE}[^\S\n])"
#: Found in every text that _AT is found in: its words with the characters that may stand next to them.
MAY_BE_EMAIL = re.compile(rf"@|[\s\[({{<](?:{_BRACKETED}|{_BARE})[\s\])}}>]", re.I)
_DOT = r"(?:\.|[^\S\n]?[\[({<][^\S\n]?(?:dot|point)[^\S\n]?[\])}>][^\S\n]?|[^\S\n](?:dot|point)[^\S\n])"
EMAIL = re.compile(rf"({_LOCAL})({_AT})((?:\w[\w-]*({_DOT}))+[^\W\d_]{{2,}})(?![\w-])", re.I)
RUN = re.compile(r"(?<![\w@])(?:\+[^\S\n]?)?\(?\d(?:(?:[^\S\n]|[.\-/]|[^\S\n]?\(|\)[^\S\n]?)?\d){4,}")
#: Digits of a number; runs of up to ONE_NUMBER digits, as many as a phone or social security number may have, hold one.
LEAST_DIGITS, ONE_NUMBER, MOST_DIGITS = 5, 15, 20
_DIGITS = re.compile(r"\d+")
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]\d\d[-/.]\d\d|\d\d[-/.]\d\d[-/.](?:19|20)\d\d)$")
LETTERED = re.compile(r"(?<![\w@])[A-Z]{1,3}-?\d[\d/-]{3,}\d[A-Z]{0,2}(?!\w)", re.I)
_TOWN = r"[^\W\d_][\w'’-]*(?:[^\S\n][^\W\d_][\w'’-]*)?"
_TAIL = rf"(?:\s*,?\s*\d{{4,5}}[^\S\n]+{_TOWN}|[^\S\n]*[,\n]\s*{_TOWN}(?:[^\S\n]+(?:\d{{4,6}}|[A-Z]{{1,2}}\d\w?[^\S\n]?\d[A-Z]{{2}}))?)?"
ADDRESS_FR = re.compile(rf"(?<![\w/.,-])\d{{1,4}}(?:[^\S\n]?(?:bis|ter|quater|[a-d]))?,?[^\S\n]+(?:{'|'.join(STREETS_FR)})\.?[^\S\n]+(?:[\w'’-]+[^\S\n]*){{1,5}}?(?=[,;\n()/.]|\s-\s|\s\d|$){_TAIL}", re.I)
ADDRESS_EN = re.compile(rf"(?<![\w/.,-])\d{{1,4}}[^\S\n]?[a-d]?[^\S\n]+(?:[^\W\d_][\w'’-]*[^\S\n]+){{1,4}}(?:{'|'.join(STREETS_EN)})\b\.?(?:,?[^\S\n]+(?:apt|flat|unit|suite)\.?[^\S\n]+\d+)?{_TAIL}", re.I)
_NAME_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
AFTER_TITLE = re.compile(rf"\s{{0,2}}((?:[^\W\d_]\.[^\S\n]?){{0,2}})({_NAME_WORD})(?:[^\S\n]({_NAME_WORD}))?")
NEXT_WORD = re.compile(rf"[^\S\n]{{1,2}}({_NAME_WORD})")
TWO_WORDS = re.compile(rf"\s{{0,2}}({_NAME_WORD})[^\S\n]({_NAME_WORD})")
PREVIOUS_WORD = re.compile(rf"({_NAME_WORD})[^\S\n]{{1,2}}$")
_ANY_WORD = re.compile(r"[^\W\d_]+°?")
_BLOCK = re.compile(r"^\s*[;/,\-–|(\n]+[^\S\n]*(?:[^\W\d_]+[.:°]?[^\S\n]*){0,3}$")
_SEP_BEFORE, _SEP_AFTER = re.compile(r"(?:^|[;/,(:\n]|\s[-–])\s*$"), re.compile(r"^\s*(?:$|[;/,)\n.]|[-–]\s)")
_LOOKS = {o: latin for latin, others in LOOKALIKES.items() for o in others}

Segment = tuple[int, int, str, list[str]]


def plain_with_positions(text: str) -> tuple[str, list[int] | None]:
    """The text with one usual character for each odd one, and the original position of each when any moved."""
    if text.isascii() or not any(ch > "ÿ" or ch in "\xa0\xad" for ch in text):
        return text, None
    out: list[str] = []
    at: list[int] = []
    for k, ch in enumerate(text):
        if is_invisible(ch):
            continue
        if unicodedata.combining(ch) and out:
            whole = unicodedata.normalize("NFC", out[-1] + ch)
            if len(whole) == 1:
                out[-1] = whole
            continue
        ch = " " if unicodedata.category(ch) == "Zs" else _LOOKS.get(ch, ch)
        for c in unicodedata.normalize("NFKC", ch) if ch > "ÿ" and ch not in "œŒ½…" else ch:
            out.append(c)
            at.append(k)
    return "".join(out), at


class Knowledge:
    """Given names and ordinary words, and the automaton that finds where a name or street may be."""

    def __init__(self, given: set[str], common: Callable[[str], bool]):
        import ahocorasick

        self.given = given
        self.common = common
        self.automaton = ahocorasick.Automaton()
        found: dict[str, str] = {}
        for kind, entries in (("cue", NAME_CUES), ("given", given), ("street", STREETS_EN + STREETS_FR), ("title", TITLES)):
            found |= dict.fromkeys(entries, kind)
        for w, kind in found.items():
            self.automaton.add_word(w, (w, kind))
        self.automaton.make_automaton()

    def anchors(self, lower: str) -> Iterator[tuple[int, int, str]]:
        for end, (w, kind) in self.automaton.iter(lower):
            start, end = end - len(w) + 1, end + 1
            if (start == 0 or not lower[start - 1].isalnum()) and (end == len(lower) or not lower[end - 1].isalnum() or not lower[end].isalnum()):
                yield start, end, kind


def _case(word: str) -> str:
    return "aa" if word.islower() else "AA" if word.isupper() and len(word) > 1 else "Aa" if word[:1].isupper() else "aA"


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to four words before (nearest first) and two after, in lower case, of the same line."""
    before = text[max(0, start - 48) : start].rpartition("\n")[2]
    before = re.split(r"(?<![Nn]o)(?<!n°)[.;!?](?=\s|$)", before)[-1]
    return [w.lower() for w in reversed(_ANY_WORD.findall(before)[-4:])], [w.lower() for w in _ANY_WORD.findall(text[end : end + 30])[:2]]


def _shared(text: str, start: int, end: int, before: list[str]) -> list[str]:
    out = ["bias", f"sb={bool(_SEP_BEFORE.search(text[max(0, start - 4) : start]))}", f"sa={bool(_SEP_AFTER.match(text[end : end + 3]))}"]
    return out + [f"p1={before[0] if before else '-'}"]


def _parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The run itself, or where it has more digits than one number, all spans of LEAST_DIGITS to MOST_DIGITS digits between its separators."""
    groups = [m.span() for m in _DIGITS.finditer(text, start, end)]
    if sum(b - a for a, b in groups) <= ONE_NUMBER:
        yield start, end
        return
    for i, (a, _) in enumerate(groups):
        begin = start if i == 0 else a - (text[a - 1] == "(")
        digits = 0
        for j in range(i, len(groups)):
            digits += groups[j][1] - groups[j][0]
            if digits > MOST_DIGITS:
                break
            if digits >= LEAST_DIGITS:
                yield begin, end if j == len(groups) - 1 else groups[j][1]


def number_segments(text: str) -> Iterator[Segment]:
    spans = {s for m in RUN.finditer(text) for s in _parts(text, *m.span())} | {s for m in LETTERED.finditer(text) for s in _parts(text, *m.span()) if s[0] == m.start()}
    for start, end in spans:
        start += text[start] == "(" and ")" not in text[start:end]
        value = text[start:end]
        before, after = _around(text, start, end)
        digits = sum(c.isdigit() for c in value)
        groups = "-".join(str(len(g)) for g in re.findall(r"\d+", value))
        feats = _shared(text, start, end, before)
        feats += [f"n={digits}", f"g={groups}", f"first={value[0] if not value[0].isalpha() else 'A'}", f"letters={value[0].isalpha()}"]
        feats += [f"seps={''.join(sorted(set(re.findall(r'[./()+-]', value))))}", f"date={bool(_DATE.match(value))}"]
        known = []
        for name, label in LABELS.items():
            near = next((k for k, w in enumerate(before) if w.rstrip("°") in label), None)
            if near is not None:
                feats += [f"label={name}", f"label={name}{near}"]
                known.append(name)
        feats += [f"label={bool(known)}", f"g,label={groups},{'+'.join(known)}"] + [f"a1={w}" for w in after[:1]] + ([f"after={k}" for k, label in LABELS.items() if after and after[0] in label])
        yield start, end, "PHONE", feats
        yield start, end, "ID_NUMBER", feats


def email_segments(text: str) -> Iterator[Segment]:
    for m in EMAIL.finditer(text):
        at, dot = m[2].strip().lower(), (m[4] or "").strip().lower()
        feats = ["bias", f"at={at}", f"dot={dot}", f"at,dot={at == '@'},{dot == '.'}", f"odd={bool(re.search(r'[\d._+-]', m[1]))}", f"tight={m[2] == '@'}"]
        yield m.start(), m.end(), "EMAIL", feats


def address_segments(text: str) -> Iterator[Segment]:
    for form, pattern in (("fr", ADDRESS_FR), ("en", ADDRESS_EN)):
        for m in pattern.finditer(text):
            before, _ = _around(text, m.start(), m.end())
            value = m[0]
            tail = bool(re.search(r"[,\n]\s*[^\W\d_]|\d{4,}", value))
            feats = _shared(text, m.start(), m.end(), before) + [f"form={form}", f"tail={tail}", f"form,tail={form}{tail}", f"words={min(len(value.split()), 8)}", f"post={bool(re.search(r'\d{4,}', value))}"]
            yield m.start(), m.end(), "ADDRESS", feats


def _name(text: str, start: int, parts: list[str], end: int, know: Knowledge, case: str, title: bool, initial: bool, cue: bool) -> Segment:
    before, after = _around(text, start, end)
    low = [p.lower() for p in parts]
    kinds = ["G" if w in know.given else "c" if know.common(w) else "o" for w in low]
    shape = ",".join(map(_case, parts))
    feats = _shared(text, start, end, before)[:3]
    feats += [f"kinds={','.join(kinds)}", f"title={title}", f"initial={initial}", f"cue={cue}", f"t,kinds={title},{','.join(kinds)}", f"cue,kinds={cue},{','.join(kinds)}", f"shape={case}:{shape}", f"s,kinds={case}:{shape}:{','.join(kinds)}", f"n={len(parts)}", f"len={min(len(parts[-1]), 12)}"]
    feats += [f"next={bool(after) and after[0] in NOT_AFTER_NAME or len(after) > 1 and after[1] in NOT_AFTER_NAME}", f"prev={bool(before) and before[0] in NOT_BEFORE_NAME and not title}"]
    return start, end, "NAME", feats


def name_segments(text: str, anchors: list[tuple[int, int, str]], know: Knowledge) -> Iterator[Segment]:
    letters = [c for c in text if c.isalpha()]
    upper = sum(map(str.isupper, letters)) / max(1, len(letters))
    case = "upper" if upper > 0.6 else "lower" if not upper else "title" if upper > 0.12 else "usual"
    cues = {end for _, end, kind in anchors if kind == "cue"}
    follows = lambda start: any(text[c:start].strip() == "" for c in cues if 0 <= start - c <= 2)
    for start, end, kind in anchors:
        if kind == "title":
            m = AFTER_TITLE.match(text, end)
            if m and m.start(2) > end:
                at = m.start(1) if m[1] else m.start(2)
                yield _name(text, at, [m[2]], m.end(2), know, case, True, bool(m[1]), follows(start))
                if m[3]:
                    yield _name(text, at, [m[2], m[3]], m.end(3), know, case, True, bool(m[1]), follows(start))
        elif kind == "given":
            if end < len(text) and (text[end].isalpha() or text[end] in "-@_."and end + 1 < len(text) and text[end + 1].isalnum()) or start and text[start - 1] in "-@_.+'’":
                continue
            m = NEXT_WORD.match(text, end)
            if m:
                yield _name(text, start, [text[start:end], m[1]], m.end(), know, case, False, False, follows(start))
            m = PREVIOUS_WORD.search(text, max(0, start - 40), start)
            if m:
                yield _name(text, m.start(1), [m[1], text[start:end]], end, know, case, False, False, follows(m.start(1)))
        elif kind == "cue":
            m = TWO_WORDS.match(text, end)
            if m and m.start(1) > end and m[1].lower() not in TITLES and f"{m[1].lower()}." not in TITLES and not know.common(m[1].lower()) and not know.common(m[2].lower()):
                yield _name(text, m.start(1), [m[1], m[2]], m.end(), know, case, False, False, True)


def segments(text: str, know: Knowledge) -> list[Segment]:
    """All proposed segments of a text, by start."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    anchors = list(know.anchors(lower))
    found = list(name_segments(text, anchors, know)) if any(k != "street" for _, _, k in anchors) else []
    if any(k == "street" for _, _, k in anchors):
        found += address_segments(text)
    if MAY_BE_EMAIL.search(text):
        found += email_segments(text)
    found += number_segments(text)
    return sorted(found, key=lambda s: (s[0], s[1], s[2]))


class SemiMarkovCrf:
    """Weights of span features and of neighbouring segments, and the dynamic programs over segments."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = weights if weights is not None else {}

    def score(self, s: Segment) -> float:
        get, kind = self.w.get, s[2]
        return sum(get(f"{kind}|{f}", 0.0) for f in s[3])

    @staticmethod
    def link(text: str, a: Segment, b: Segment) -> str | None:
        """The feature of two neighbouring segments, None where they are no block."""
        return f"block|{a[2]}|{b[2]}" if b[0] - a[1] <= LINKED and _BLOCK.match(text[a[1] : b[0]]) else None

    def best(self, text: str, segs: list[Segment]) -> list[Segment]:
        """The segmentation with the highest score."""
        order = sorted(range(len(segs)), key=lambda k: (segs[k][1], segs[k][0]))
        ends = [segs[k][1] for k in order]
        total: list[float] = []
        back: list[int | None] = []
        led: list[tuple[float, int | None]] = [(0.0, None)]  # the best of the first segments, by their number
        for n, k in enumerate(order):
            far, near = bisect_left(ends, segs[k][0] - LINKED), bisect_right(ends, segs[k][0])
            top, frm = led[far]  # too far away for a link
            for j in range(far, near):
                f = self.link(text, segs[order[j]], segs[k])
                v = total[j] + (self.w.get(f, 0.0) if f else 0.0)
                if v > top:
                    top, frm = v, j
            total.append(top + self.score(segs[k]))
            back.append(frm)
            led.append((total[n], n) if total[n] > led[n][0] else led[n])
        if not total or max(total) <= 0:
            return []
        n: int | None = max(range(len(total)), key=total.__getitem__)
        out = []
        while n is not None:
            out.append(segs[order[n]])
            n = back[n]
        return out[::-1]

    def marginals(self, text: str, segs: list[Segment]) -> tuple[list[float], dict[str, float]]:
        """Probability of each segment, and expected count of each link feature."""
        n = len(segs)
        order = sorted(range(n), key=lambda k: (segs[k][1], segs[k][0]))
        s = [segs[k] for k in order]
        sc = [self.score(x) for x in s]
        links = {(i, j): self.link(text, s[i], s[j]) for j in range(n) for i in range(n) if s[i][1] <= s[j][0]}
        logsum = lambda v: (m := max(v)) + math.log(sum(math.exp(x - m) for x in v))
        alpha, beta = [0.0] * n, [0.0] * n
        for j in range(n):
            alpha[j] = sc[j] + logsum([0.0] + [alpha[i] + self.w.get(links[i, j] or "", 0.0) for i in range(j) if (i, j) in links])
        for i in reversed(range(n)):
            beta[i] = logsum([0.0] + [sc[j] + beta[j] + self.w.get(links[i, j] or "", 0.0) for j in range(i + 1, n) if (i, j) in links])
        z = logsum([0.0, *alpha])
        p = [0.0] * n
        for k, i in enumerate(order):
            p[i] = math.exp(alpha[k] + beta[k] - z)
        expected: dict[str, float] = {}
        for (i, j), f in links.items():
            if f:
                expected[f] = expected.get(f, 0.0) + math.exp(alpha[i] + self.w.get(f, 0.0) + sc[j] + beta[j] - z)
        return p, expected

    @classmethod
    def trained(cls, know: Knowledge, texts: list[tuple[str, list[tuple[int, int, str]]]]) -> SemiMarkovCrf:
        """Maximum likelihood with AdaGrad steps."""
        model, square = cls(), {}
        prepared = []
        for text, gold in texts:
            segs = segments(text, know)
            chosen = []
            for start, end, kind in gold:
                same = [k for k, s in enumerate(segs) if s[0] == start and s[2] == kind]
                if same:
                    chosen.append(min(same, key=lambda k: abs(segs[k][1] - end)))
            chosen.sort(key=lambda k: segs[k][0])
            if all(segs[a][1] <= segs[b][0] for a, b in zip(chosen, chosen[1:], strict=False)):
                prepared.append((text, segs, chosen))
        for _ in range(EPOCHS):
            for text, segs, chosen in prepared:
                p, expected = model.marginals(text, segs) if segs else ([], {})
                grad: dict[str, float] = {f: -v for f, v in expected.items()}
                for a, b in zip(chosen, chosen[1:], strict=False):
                    f = cls.link(text, segs[a], segs[b])
                    if f:
                        grad[f] = grad.get(f, 0.0) + 1
                for k, s in enumerate(segs):
                    d = (k in chosen) - p[k]
                    if abs(d) > 1e-4:
                        for f in s[3]:
                            name = f"{s[2]}|{f}"
                            grad[name] = grad.get(name, 0.0) + d
                for f, g in grad.items():
                    square[f] = square.get(f, 1e-6) + g * g
                    model.w[f] = model.w.get(f, 0.0) + STEP * g / math.sqrt(square[f])
        return model


def training_vocabulary() -> frozenset[str]:
    """The ordinary words of the made texts."""
    templates = [t for ts in CARRIERS.values() for t in ts] + [b for b, _ in BLOCKS] + DECOYS
    return frozenset(w for t in templates for w in re.findall(r"[^\W\d_]+", t.lower())) | frozenset(w for ws in (STREETS_EN, STREETS_FR, NOT_AFTER_NAME, *LABELS.values()) for w in ws)


class Finder:
    """Finds personal data in texts: knowledge of the corpus and trained weights."""

    def __init__(self, given: set[str], common: frozenset[int]):
        self.given, self.hashes = given, common
        known = training_vocabulary()
        self.weights = SemiMarkovCrf.trained(Knowledge(set(GIVEN_NAMES), known.__contains__), training_texts()).w
        self.ready: tuple[Knowledge, SemiMarkovCrf] | None = None

    def __getstate__(self):
        return {"given": self.given, "hashes": self.hashes, "weights": self.weights, "ready": None}

    def prepared(self) -> tuple[Knowledge, SemiMarkovCrf]:
        if self.ready is None:
            import xxhash

            common = self.hashes
            remembered: dict[str, bool] = {}

            def is_common(w: str) -> bool:
                if w not in remembered:
                    h = xxhash.xxh3_64_intdigest(w)
                    remembered[w] = (h - (1 << 64) if h >> 63 else h) in common
                return remembered[w]

            self.ready = Knowledge(self.given, is_common), SemiMarkovCrf(self.weights)
        return self.ready

    def __call__(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of each piece of personal data, in order."""
        if not text:
            return []
        know, model = self.prepared()
        plain, at = plain_with_positions(text)
        found = [(s[0], s[1], s[2]) for s in model.best(plain, segments(plain, know))]
        return found if at is None else [(at[a], at[b - 1] + 1, k) for a, b, k in found]


_SURE_NAME = re.compile(rf"(?:[Mm]y name is|[Ss]igned by|[Aa]ccording to|m['’]appelle|signé|Selon|[Rr]egards,|Cordialement,)\s+(?:(?:{'|'.join(re.escape(t) for t in TITLES)})\s+)?({_NAME_WORD})[^\S\n]({_NAME_WORD})")
LEARNED = "name boolean, word string, hash bigint, n bigint"


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[str, int] = {}
    names: dict[tuple[str, str], int] = {}
    texts = 0
    for b in batches:
        column = flat(b.column(0))
        texts += len(column)
        values, off = words(column)
        codes, distinct = coded(values)
        import numpy as np

        pairs = distinct_sorted(rows_of(off) * max(1, len(distinct)) + codes) % max(1, len(distinct))
        for w, n in zip(distinct.to_pylist(), np.bincount(pairs, minlength=len(distinct)).tolist(), strict=True):
            count[w] = count.get(w, 0) + n
        for t in column.to_pylist():
            for m in _SURE_NAME.finditer(t):
                if _case(m[1]) == _case(m[2]) == "Aa":  # a surname in capitals may come first
                    key = (m[1].lower(), m[2].lower())
                    names[key] = names.get(key, 0) + 1
    h = hash64(pa.array(list(count), pa.large_string())).tolist()
    s = hash64(pa.array([k[1] for k in names], pa.large_string())).tolist()
    yield pa.RecordBatch.from_arrays(
        [pa.array([False] * (len(h) + 1) + [True] * len(s)), pa.array([None] * (len(h) + 1) + [k[0] for k in names], pa.string()), pa.array([*h, None, *s], pa.int64()), pa.array([*count.values(), texts, *names.values()], pa.int64())],
        names=["name", "word", "hash", "n"],
    )


def finder_for(texts: DataFrame) -> Finder:
    """A finder that knows the words and given names of texts (text)."""
    learned = materialize(texts.select("text").where("text is not null").mapInArrow(_learn, LEARNED).groupBy("name", "word", "hash").agg(F.sum("n").alias("n")))
    total = learned.where("not name and hash is null").agg(F.sum("n")).first()[0] or 0
    common = learned.where(F.expr("not name and hash is not null") & (F.col("n") > max(COMMON_LEAST, COMMON * total))).select("hash", "n").collect()
    places = learned.where("name").agg(F.sum("n")).first()[0] or 0
    surnames = learned.where("name").groupBy("word").agg(F.countDistinct("hash").alias("surnames"), F.sum("n").alias("n"))
    surnames = surnames.where((F.col("surnames") >= MIN_SURNAMES) & (F.col("n") > NAME_SHARE * places)).collect()
    hashes = frozenset(r[0] for r in common)
    ordinary = {r.hash for r in common if r.n > NO_NAME * total}
    learned_names = {r.word for r, h in zip(surnames, hash64(pa.array([r.word for r in surnames], pa.large_string())).tolist(), strict=True) if len(r.word) > 2 and h not in ordinary and r.word not in TITLES}
    return Finder(set(GIVEN_NAMES) | learned_names, hashes)


def free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_index, field, msg, text) of every text that is searched."""
    sft = table(spark, sf_dir, "sft_records")
    plain = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("instruction", "response")]))
    a = sft.select(F.lit("sft_records").alias("tbl"), F.col("row_index").cast("bigint").alias("row_index"), plain.alias("p")).select("tbl", "row_index", "p.field", F.lit(0).cast("bigint").alias("msg"), "p.text")
    parts = [a.where("text is not null")]
    for f in ("chosen", "rejected"):
        said = table(spark, sf_dir, "preference_triples").select(F.lit("preference_triples").alias("tbl"), F.col("row_index").cast("bigint").alias("row_index"), F.lit(f).alias("field"), F.posexplode(f).alias("msg", "m"))
        parts.append(said.where("m.role = 'assistant' and m.content is not null").select("tbl", "row_index", "field", F.col("msg").cast("bigint").alias("msg"), F.col("m.content").alias("text")))
    return reduce(DataFrame.unionByName, parts)


FOUND = "tbl string, row_index bigint, field string, msg bigint, kind string, start_pos bigint, end_pos bigint"


def find_personal_data(texts: DataFrame, finder: Finder) -> DataFrame:
    """One row per piece of personal data."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, starts, ends = [], [], [], []
            for k, text in enumerate(b.column(4).to_pylist()):
                for start, end, kind in finder(text):
                    rows.append(k)
                    kinds.append(kind)
                    starts.append(start)
                    ends.append(end)
            taken = [c.take(pa.array(rows, pa.int64())) for c in b.columns[:4]]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["tbl", "row_index", "field", "msg", "kind", "start_pos", "end_pos"])

    return texts.mapInArrow(find, FOUND)


def replace_personal_data(texts: DataFrame, finder: Finder) -> DataFrame:
    """The texts with each piece replaced by its kind in angle brackets, and how many there were."""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n = [], []
            for text in b.column(4).to_pylist():
                found = finder(text)
                for start, end, kind in reversed(found):
                    text = f"{text[:start]}<{kind}>{text[end:]}"
                out.append(text)
                n.append(len(found))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["tbl", "row_index", "field", "msg", "text", "replaced"])

    return texts.mapInArrow(replace, "tbl string, row_index bigint, field string, msg bigint, text string, replaced int")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = free_texts(spark, sf_dir)
    return find_personal_data(texts, finder_for(texts)).drop("end_pos")


def p1_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = free_texts(spark, sf_dir)
    return replace_personal_data(texts, finder_for(texts))


QUERIES = {"p1_found": p1_found, "p1_replaced": p1_replaced}
SQL: dict[str, str] = {}
