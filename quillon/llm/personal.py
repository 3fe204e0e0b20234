"""Problem 8: personal details inside free text, by a skip-chain conditional random field.

Texts become units: words, numbers, punctuation, and candidates of the closed forms (addresses for e-mail, in
plain or evasive writing; telephone and identity numbers; street addresses), each one unit with its shape.  A
chain field over the units labels them from their words, shapes, name hints and neighbours; skip edges join
each repeated or similar unit of a document (words that differ in case or accents only, numbers of the same digits,
addresses for e-mail of the same letters) to its first mention, so that what one place shows clearly carries over to
the others, by loopy message passing: the chains are solved exactly, the skip messages pass between rounds.  Units away from any candidate
have no evidence for a label and are left out of the chains, which changes no result.

There are no labelled texts.  The weights are fitted on a bounded sample of documents (FIT_DOCUMENTS, by a hash
of the id) labelled by clear evidence: hinted given and family names side by side, cue words before numbers,
unmistakable formats.  Names of ordinary words are labelled as their context is with other names, and left out
of the fit where no context tells.  Hints are hidden at random while fitting, so that context is learned.

Names that stand often enough beside hinted ones in the whole corpus join the hints (a lexicon counted over all
different texts, in the same pass as the ordinary words).  Up to NAMES_SENT of them are sent to every task; more are
joined to the texts that hold them, with the same result.

Defined cases: null and empty texts have no mentions and stay as they are; repeated mentions of a document give
one row; rows with the same doc_id count as one document; long texts are read whole; further columns are not
read.
"""

from __future__ import annotations

import json
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, join_hot, spread, table

LABELS = ("O", "name", "name+", "email", "phone", "id_number", "address")
TYPES = ("name", "email", "phone", "id_number", "address")
FIT_DOCUMENTS = 12_000
HINTS_MOST = 100_000
#: So many names found in the corpus are sent to every task; more are joined to the texts that hold them.
NAMES_SENT = 100_000
LEXICON_LEAST = 3
ROUNDS = 3
#: Weights of the skip edges that are tried, in the order they are preferred where they do equally well.
SKIP_WEIGHTS = (1.5, 1.0, 2.0, 0.5, 2.5, 3.0, 0.0)
REACH = 3

# Words of the closed forms.
_STREET = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Court|Ct|Way|Blvd|Boulevard|Terrace|Drive|Dr|Place|Square|Crescent|Grove|Hill|Row|Walk|Gardens|Mews|Parade"
_RUE = "rue|avenue|impasse|allée|boulevard|place|chemin|quai|cours|sentier"
_CALLE = r"calle|c/|avenida|avda\.?|plaza|paseo|camino|ronda|travesía"
_STRASSE = r"straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer|damm"
_FILES = {"png", "jpg", "jpeg", "gif", "py", "js", "css", "svg", "json", "txt", "csv", "webp", "t"}
ID_CUES = {
    "passport", "patient", "mrn", "ssn", "insurance", "record", "staff", "national", "dossier", "dni", "nif", "versichertennummer",
    "social", "security", "nhs", "reisepass", "ausweis", "pasaporte", "passeport", "personalausweis", "patientennummer", "employee", "identity",
}
TITLES = {"ms", "mr", "mrs", "dr", "prof", "frau", "herr", "mme", "mlle", "sra", "sr", "señora", "señor", "madame", "monsieur", "doctor"}

_C = r"[^\W\d_]"
_LETTERS = r"(?:[^\W\d_][̀-ͯ]*)+"
_WORD = rf"{_LETTERS}(?:(?!['’][sS]\b)['’\-]{_LETTERS})*"
_TOWN = rf"[^\W\d_a-zà-ÿ](?:{_C}|['’\-])+(?:\ [^\W\d_a-zà-ÿ](?:{_C}|['’\-])+)?"
_CAP = rf"[^\W\d_a-zà-ÿ](?:{_C}|['’\-])*"
_EMAIL = (
    r"[A-Za-z0-9_][\w.+\-]*"
    r"(?:(?:\ ?[@＠]\ ?|&\#64;|%40|\ ?[\(\[\{<]\ ?(?i:at|arroba|@)\ ?[\)\]\}>]\ ?)[A-Za-z0-9][A-Za-z0-9\-]*(?:(?:\.|\ ?[\(\[\{]\ ?(?i:dot|punto|point|punkt|\.)\ ?[\)\]\}]\ ?|\ (?i:dot)\ )[A-Za-z0-9\-]+)*(?:\.|\ ?[\(\[\{]\ ?(?i:dot|punto|point|punkt|\.)\ ?[\)\]\}]\ ?|\ (?i:dot)\ )[A-Za-z]{2,}"
    r"|\ (?i:at|arroba)\ [A-Za-z0-9\-]+(?:\ (?i:dot|punto)\ [A-Za-z0-9\-]+)*\ (?i:dot|punto)\ [A-Za-z]{2,})"
)
_ADDRESS = (
    rf"(?:(?i:apt|flat|unit|suite|apartment)\.?\ \d+[A-Za-z]?,\ )?\d+[A-Za-z]?\ (?:{_CAP}\ ){{1,3}}(?i:{_STREET})\b(?:\.(?=,))?(?:,\ {_TOWN}(?:\ \d{{4,5}}\b)?|,\ \d{{4,5}}\ {_TOWN})?"
    rf"|\d+[A-Za-z]?(?:\ (?i:bis|ter|quater))?,?\ (?i:{_RUE})\ {_WORD}(?:\ {_WORD}){{0,4}}?(?:,\ \d{{4,5}}\ {_TOWN}|(?=[.,;:|)\n\"]|\ [|/]|\ [^\W\d_A-ZÀ-Þ]|\s*$))"
    rf"|(?i:{_CALLE})\ {_WORD}(?:\ {_WORD}){{0,4}}?,?\ \d+[A-Za-z]?\b(?:,\ \d{{4,5}}\ {_TOWN})?"
    rf"|(?:{_WORD}(?i:{_STRASSE})|{_CAP}\ (?i:straße|strasse|str\.|weg|platz|gasse|allee))\ \d+\ ?[A-Za-z]?\b(?:,\ \d{{5}}\ {_TOWN})?"
    rf"|(?:Am|An\ der|An\ den|Im|In\ der|Auf\ dem|Auf\ der|Zum|Zur|Unter\ den|AM|IM|ZUM|ZUR)\ (?:{_WORD}\ ){{1,2}}\d+[A-Za-z]?\b(?:,\ \d{{5}}\ {_TOWN})?"
)
_NUMBER = (
    r"[A-Z]{2}\ \d\d\ \d\d\ \d\d\ [A-Z]\b|[A-Z]{1,2}-?\d{5,10}\b|\d{7,9}-?[A-Z]\b"
    r"|(?:\+\ ?\d|\(\d|\d)(?:\d|[ ./\-]?\(\d+\)[ \-]?(?=\d)|\)[ \-]?(?=\d)|[ ./\-](?=\d))*(?:\ ?,?(?:ext\.?|Ext\.?|x|extension|Durchwahl|poste|int\.?)\ ?\d+)?(?!\w|:\d)"
)
def _unit(email: bool, address: bool) -> re.Pattern:
    parts = [rf"(?P<email>{_EMAIL})"] * email + [rf"(?P<address>(?<!\w)(?:{_ADDRESS}))"] * address
    return re.compile("|".join([*parts, rf"(?P<number>(?<![\w.\-])(?:{_NUMBER}))", rf"(?P<word>{_WORD})", r"(?P<digits>\d+)", r"(?P<break>\n)", r"(?P<mark>[^\w\s])"]))


UNITS = {(e, a): _unit(e, a) for e in (False, True) for a in (False, True)}

_DIGIT = re.compile(r"\d")
# what a text must hold anywhere for an address of either kind to be possible in it
_MAY_MAIL = re.compile(r"[@＠]|&#64;|%40|[\(\[\{<] ?(?:at|arroba) ?[\)\]\}>]| (?:dot|punto) ")
_MAY_STREET = re.compile(rf"\d[A-Za-z]?\ (?:{_CAP}\ ){{1,3}}(?i:{_STREET})\b")
_MAY_RUE = re.compile(rf"\d[a-z]?(?: (?:bis|ter|quater))?,? (?:{_RUE}) |(?:{_CALLE}) |(?:{_STRASSE}) \d")
_MAY_PLACE = re.compile(rf"(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den|AM|IM|ZUM|ZUR) (?:{_WORD} ){{1,2}}\d")


def cutter(text: str) -> re.Pattern:
    """The pattern that cuts a text into units, without the alternatives that cannot occur in it."""
    low = text.lower()
    address = _DIGIT.search(text) is not None and bool(_MAY_STREET.search(text) or _MAY_RUE.search(low) or _MAY_PLACE.search(text))
    return UNITS[bool(_MAY_MAIL.search(low)), address]


# How telephone numbers begin or are grouped; plain digits of other groupings are no clear case.
_PHONE_FORMS = re.compile(
    r"\+\ ?\d|00[1-9]\d{0,2}\ \(?\d|\(0?\d{2,4}\)\ ?\d{3}|0\d{2,4}/\d{3,}|0\d{2,4}\ \d{3,}|\d{3}([.\-])\d{3}\1\d{4}(?!\d)"
    r"|0\d(?:[. ]\d\d){4}$|0[1-9]\d{8,9}$|1[2-9]\d{9}$|00[1-9]\d{9,12}$"
)


_INITIAL = r"[^\W\d_](?=\.)"
#: Units other than addresses, by (word, number, initial, any other), for texts and lines without addresses.  Words of
#: three letters or more begin no number and are tried first.
_PLAIN = re.compile(rf"([^\W\d_]{{3,}}+(?![̀-ͯ'’\-]))|((?<![\w.\-])(?:{_NUMBER}))|({_INITIAL})|({_WORD}|\d+|\n|[^\w\s])")
_KNOWN: dict[str, tuple[str, str, str]] = {}
_KNOWN_MOST = 400_000


def _number(said: str) -> tuple[str, str, str]:
    digits = len(_DIGIT.findall(said))
    plain = re.fullmatch(r"\d+\.\d+|\d{4}[-/.]\d\d[-/.]\d\d", said)
    if digits < 5 or plain or (digits < 6 and not re.fullmatch(r"[A-Z]{1,2}-?\d{5}|\d\d-\d{4,}", said)):
        return "digits", "0", ""
    shape = re.sub(r"[A-Za-z]{2,}", "a", re.sub(r"[A-Z]\b|[A-Z](?=\d)", "A", re.sub(r"\d", "0", said)))
    return "number", shape, "tel" if digits <= 18 and _PHONE_FORMS.match(said) else "num"


def _lower(said: str) -> str:
    return (said if said.isascii() else unicodedata.normalize("NFKC", said)).lower()


def _other(said: str) -> tuple[str, str, str]:
    """Kind, word and case of a word, a run of digits, a break or a mark; the same for all places it stands in."""
    first = said[0]
    if first.isdecimal():
        out = ("digits", "0", "")
    elif first == "\n":
        out = ("break", "\n", "")
    elif not (first.isalnum() or first == "_"):
        out = ("mark", said, "")
    elif len(said) == 1:
        out = ("word", _lower(said), "c" if said.isupper() else "a")
    else:
        out = ("word", _lower(said), "A" if said.isupper() else "c" if first.isupper() else "a")
    if len(_KNOWN) >= _KNOWN_MOST:
        _KNOWN.clear()
    _KNOWN[said] = out
    return out


def _mail(said: str) -> tuple[str, str, str]:
    last = re.split(r"\W+", said)[-1].lower()
    return "email", "file" if last in _FILES else "plain" if re.fullmatch(r"\S+@\S+", said) else "evasive", ""


class Units:
    """The units of one text: kinds, lower-case words (shapes for candidates) and cases; spans on demand.

    Lines in which an address of either kind may stand are cut by the pattern that knows them, all others by one that
    leaves the loop over their units to the pattern engine.  No unit reaches over a line.
    """

    __slots__ = ("text", "said", "kind", "word", "case", "_start")

    def __init__(self, text: str):
        said, made = [], []
        for part, pattern in _stretches(text):
            if pattern is None:
                known = _KNOWN.get
                found = _PLAIN.findall(part)
                said += [w or o or n or i for w, n, i, o in found]
                made += [(known(w) or _other(w)) if w else (known(o) or _other(o)) if o else _number(n) if n else ("word", _lower(i), "1") for w, n, i, o in found]
                continue
            start, end = part
            for match in pattern.finditer(text, start):
                if match.start() >= end:
                    break
                kind, one = match.lastgroup, match.group()
                said.append(one)
                if kind == "number":
                    made.append(_number(one))
                elif kind == "email":
                    made.append(_mail(one))
                elif kind == "address":
                    made.append(("address", "address", ""))
                elif kind == "word" and len(one) == 1 and text[match.end() : match.end() + 1] == ".":
                    made.append(("word", _lower(one), "1"))
                else:
                    made.append(_KNOWN.get(one) or _other(one))
        self.text, self.said, self._start = text, said, None
        self.kind, self.word, self.case = zip(*made) if made else ((), (), ())

    @property
    def start(self) -> list[int]:
        """Between two units there is nothing but white space and underscores, so each begins where it is found next."""
        if self._start is None:
            at, out, find = 0, [], self.text.find
            for one in self.said:
                at = find(one, at)
                out.append(at)
                at += len(one)
            self._start = out
        return self._start

    def end_of(self, i: int) -> int:
        return self.start[i] + len(self.said[i])

    def __len__(self):
        return len(self.kind)


_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def _stretches(text: str):
    """Runs of lines to be cut alike: (text, None) for plain ones, ((start, end), pattern) for those that may hold addresses."""
    whole = cutter(text)
    if whole is UNITS[False, False]:
        return [(text, None)]
    out, plain, at = [], 0, 0
    for line in _LINE.findall(text):
        pattern = cutter(line)
        if pattern is not UNITS[False, False]:
            if plain < at:
                out.append((text[plain:at], None))
            out.append(((at, at + len(line)), whole))
            plain = at + len(line)
        at += len(line)
    if plain < at:
        out.append((text[plain:at], None))
    return out


def plain_word(word: str) -> str:
    return unicodedata.normalize("NFC", word)


class Hints:
    """Which names are hinted: bit 1 given, bit 2 family; and the ordinary words.

    ``fixed`` are those of them that may be names for all that: candidates, of which the field decides.
    """

    def __init__(self, given, family, common=(), fixed=()):
        self.kind: dict[str, int] = defaultdict(int)
        for names, bit in ((given, 1), (family, 2)):
            for name in names:
                self.kind[plain_word(name.lower())] |= bit
        self.kind = dict(self.kind)
        self.common = set(common)
        self.fixed = set(fixed)

    def of(self, word: str) -> int:
        return self.kind.get(word, 0)


def active_runs(u: Units, hints: Hints) -> list[range]:
    """Stretches of units around candidates; the rest of a text has no evidence for any label."""
    kind, word, case, known, common = u.kind, u.word, u.case, hints.kind, hints.common
    runs: list[range] = []
    n = len(kind)
    for i in range(n):
        k = kind[i]
        if k == "word":
            c, w = case[i], word[i]
            if c == "a":
                if w not in known or w in common:
                    continue
            elif c == "1":
                if not (i + 2 < n and kind[i + 2] == "word" and (case[i + 2] in ("c", "A", "1") or word[i + 2] in known)):
                    continue
            elif w in common and w not in hints.fixed:
                # an ordinary word in capitals counts beside another name, an initial or a rare word in capitals
                if w not in known or not any(0 <= j < n and kind[j] == "word" and (case[j] == "1" or (case[j] in "cA" and (word[j] in known or word[j] not in common))) for j in (i - 2, i - 1, i + 1, i + 2)):
                    continue
        elif k in ("mark", "digits", "break"):
            continue
        a, b = max(0, i - REACH), min(n, i + REACH + 1)
        if runs and a <= runs[-1].stop:
            runs[-1] = range(runs[-1].start, b)
        else:
            runs.append(range(a, b))
    return runs


def features(u: Units, i: int, hints: Hints, hidden: bool = False, fixed: bool = False) -> list[str]:
    """Observations at one unit.  ``hidden`` drops the hints, as for names that nobody listed; ``fixed`` makes
    hinted names look like those that are always written together."""
    n = len(u)

    def at(j):
        if not 0 <= j < n:
            return "^", "", 0, ""
        w, k = u.word[j], u.kind[j]
        known = 0 if hidden or k != "word" else hints.of(plain_word(w))
        tag = u.case[j] or k
        if k != "word":
            seen = ""
        elif w in hints.fixed or (fixed and w not in hints.common and hints.of(plain_word(w))):
            seen = "p"
        else:
            seen = "c" if w in hints.common else "r"
        return (w if k in ("word", "mark", "break") else f"<{k}>"), tag, known, seen

    (w0, t0, g0, c0), (p1, pt, pg, pc), (n1, nt, ng, nc) = at(i), at(i - 1), at(i + 1)
    (p2, pt2, pg2, _), (n2, nt2, ng2, nc2) = at(i - 2), at(i + 2)
    p3 = at(i - 3)[0]
    me = f"{t0}{g0}{c0}"
    out = [
        f"0 {me}", f"- {me} {pt}{pg}{pc}", f"+ {me} {nt}{ng}{nc}", f"-+ {me} {pt}{pg}{pc} {nt}{ng}{nc}",
        f"+2 {me} {nt}{ng}{nc} {nt2}{ng2}{nc2}", f"-2 {me} {pt}{pg} {pt2}{pg2}",
        f"p1 {t0} {p1}", f"p2 {t0} {p2} {p1}", f"n1 {t0} {n1}", f"n2 {t0} {n1} {n2}", f"p3 {t0} {p3} {p2}",
        f"pn {t0}{g0} {pt}{pg} {n1}", f"n2w {t0} {nt} {n2}", f"p2w {t0} {pt} {p2}",
    ]
    if c0 == "c" or u.kind[i] == "mark":
        out.append(f"w {t0} {w0}")
    if u.kind[i] in ("number", "email"):
        shape = u.word[i]
        out += [f"s {shape}", f"sp {shape} {p1}", f"form {u.case[i]} {len(shape)}", f"form {u.case[i]}", f"formp {u.case[i]} {p1}"]
        for j in range(max(0, i - 4), i):
            if u.kind[j] == "word":
                out.append(f"cue {u.kind[i]} {u.word[j]}")
    return out


# ---- labels from clear evidence


def clear_labels(u: Units, hints: Hints, seen: Counter, doubtful: Counter, decide: bool) -> dict[int, int] | None:
    """Labels by position, or None where a run is not clear enough to learn from.

    ``seen`` counts the words after clear names, ``doubtful`` those after pairs of ordinary words.
    """
    n, labels = len(u), {}
    i = 0
    while i < n:
        k = u.kind[i]
        if k == "email":
            labels[i] = 0 if u.word[i] == "file" else 3
        elif k == "address":
            labels[i] = 6
        elif k == "number":
            cued = any(u.word[j] in ID_CUES for j in range(max(0, i - 4), i) if u.kind[j] == "word")
            labels[i] = 5 if cued else 4 if u.case[i] == "tel" else 0
        elif k == "word":
            name = name_here(u, i, hints)
            if name:
                end, sure = name
                after = u.word[end] if end < n else "^"
                before = u.word[i - 1] if i else "^"
                if sure:
                    seen[after] += 1
                else:
                    doubtful[after] += 1
                    if decide:
                        if seen[after] < 2 and doubtful[after] >= 3 and before not in TITLES:
                            sure = None
                        elif not seen[after]:
                            return None
                        else:
                            sure = True
                if sure is not None:
                    labels[i] = 1
                    for j in range(i + 1, end):
                        labels[j] = 2
                i = end
                continue
        i += 1
    return labels


def name_parts(u: Units, i: int, hints: Hints) -> tuple[int, tuple[str, ...], bool] | None:
    """End of the name of hinted parts that begins at ``i``, the words that tell whether it is one, and whether all must."""
    n = len(u)
    part = lambda j: hints.of(plain_word(u.word[j])) if j < n and u.kind[j] == "word" else 0
    initial = lambda j: j + 1 < n and u.case[j] == "1" and u.word[j + 1] == "."
    if u.case[i] != "1" and not part(i):
        return None
    if initial(i):
        j = i + 2
        if initial(j):
            j += 2
        return (j + 1, (u.word[j],), True) if part(j) & 2 and u.case[j] != "a" else None
    first, case = part(i), u.case[i]
    same = lambda j: j < n and u.case[j] == case
    if first & 1:
        j = i + 1
        if initial(j):
            j += 2
        elif part(j) & 1 and part(j + 1) & 2 and same(j):
            j += 1
        if part(j) & 2 and same(j):
            return j + 1, (u.word[i], u.word[j]), False
    if first & 2:
        j = i + 1
        if j < n and u.word[j] == "," and part(j + 1) & 1 and same(j + 1):
            return j + 2, (u.word[i], u.word[j + 1]), False
        if part(j) & 1 and same(j) and case != "a" and not part(j + 1) & 2:
            return j + 1, (u.word[i], u.word[j]), True
    return None


def name_here(u: Units, i: int, hints: Hints) -> tuple[int, bool] | None:
    """End of the name of hinted parts that begins at ``i``, and whether it is more than ordinary words."""
    found = name_parts(u, i, hints)
    if found is None:
        return None
    end, own, every = found
    sure = (all if every else any)(w not in hints.common for w in own)
    return None if not sure and u.case[i] == "a" and u.word[end - 2] != "," else (end, sure)


def unclear(u: Units, run: range, labels: dict[int, int], hints: Hints) -> bool:
    """A run that may hold a name of which a part is not hinted: a rare or hinted word beside another in capitals."""
    n, capital = len(u), ("c", "A", "1")
    for i in run:
        if labels.get(i) or u.kind[i] != "word":
            continue
        known, rare = hints.of(plain_word(u.word[i])), u.word[i] not in hints.common
        if u.case[i] == "a":
            if known and rare and any(0 <= j < n and u.kind[j] == "word" and u.word[j] not in hints.common for j in (i - 1, i + 1)):
                return True
            continue
        if not rare or u.case[i] == "1":
            continue
        for j in (i - 1, i + 1, i - 2, i + 2):
            if not 0 <= j < n or u.kind[j] != "word" or u.case[j] not in capital or labels.get(j):
                continue
            if abs(i - j) == 2 and u.word[(i + j) // 2] not in ",." and not (u.kind[(i + j) // 2] == "word" and u.case[(i + j) // 2] == "1"):
                continue
            if known or u.word[j] not in hints.common or u.case[j] == "1":
                return True
    return False


def outside(u: Units, start: int, end: int) -> tuple[str, str]:
    """The words before and after a name; the ends of a text are as those of a line."""
    return u.word[start - 1] if start else "\n", u.word[end] if end < len(u) else "\n"


def perhaps_named(u: Units, run: range, labels: dict[int, int], hints: Hints, around: set[tuple[str, str]]) -> bool:
    """A run with a phrase of words that may be names, in a place where clear names stand."""
    i = run.start
    while i < run.stop:
        j = i
        while j < run.stop and u.kind[j] == "word" and u.word[j] in hints.fixed and not labels.get(j):
            j += 1
        if j - i >= 2 and outside(u, i, j) in around:
            return True
        i = max(j, i + 1)
    return False


# ---- the field


def _lse(x, axis):
    import numpy as np

    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Chains:
    """Chains of different lengths, longest first; position t of all chains that reach it is worked on at once."""

    def __init__(self, lengths):
        import numpy as np

        self.lengths = np.asarray(lengths)
        self.order = np.argsort(-self.lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if len(self.lengths) else np.zeros(0, int)
        self.first = starts[self.order]
        ordered = self.lengths[self.order]
        self.steps = [self.first[: int((ordered > t).sum())] + t for t in range(int(ordered[0]) if len(ordered) else 0)]

    def beliefs(self, emission, transition):
        """Node log-marginals, edge marginals summed over all chains, and the log partition sum."""
        import numpy as np

        forward, backward = emission.copy(), np.zeros_like(emission)
        for before, now in zip(self.steps, self.steps[1:]):
            forward[now] += _lse(forward[before[: len(now)]][:, :, None] + transition[None], 1)
        for t in range(len(self.steps) - 1, 0, -1):
            now, before = self.steps[t], self.steps[t - 1][: len(self.steps[t])]
            backward[before] = _lse(transition[None] + (emission[now] + backward[now])[:, None, :], 2)
        node = forward + backward
        total = _lse(node, 1)
        edges = np.zeros_like(transition)
        for before, now in zip(self.steps, self.steps[1:]):
            b = before[: len(now)]
            joint = forward[b][:, :, None] + transition[None] + (emission[now] + backward[now])[:, None, :]
            edges += np.exp(joint - total[b][:, None, None]).sum(axis=0)
        return node - total[:, None], edges, float(total[self.first].sum())

    def best(self, emission, transition):
        import numpy as np

        score, came = emission.copy(), np.zeros(emission.shape, "int8")
        for before, now in zip(self.steps, self.steps[1:]):
            ways = score[before[: len(now)]][:, :, None] + transition[None]
            came[now] = ways.argmax(axis=1)
            score[now] += ways.max(axis=1)
        label = score.argmax(axis=1)
        for t in range(len(self.steps) - 1, 0, -1):
            now = self.steps[t]
            label[self.steps[t - 1][: len(now)]] = came[now, label[now]]
        return label


#: Labels that count as the same across a skip edge.
_GROUP = (0, 1, 1, 3, 4, 5, 6)


def skip_potential(weight: float):
    import numpy as np

    group = np.array(_GROUP)
    return np.where(group[:, None] == group[None, :], weight, 0.0)


def infer(chains: Chains, emission, transition, skips, weight: float = SKIP_WEIGHTS[0]):
    """Labels by loopy message passing: exact chains, and messages over the skip edges between rounds."""
    import numpy as np

    if not len(emission):
        return np.zeros(0, int)
    a, b = skips
    if len(a):
        psi = skip_potential(weight)
        to_b = np.zeros((len(a), len(LABELS)))
        to_a = np.zeros((len(a), len(LABELS)))
        for _ in range(ROUNDS):
            own = emission.copy()
            np.add.at(own, b, to_b)
            np.add.at(own, a, to_a)
            node, _, _ = chains.beliefs(own, transition)
            new_b = _lse((node[a] - to_a)[:, :, None] + psi[None], 1)
            new_a = _lse((node[b] - to_b)[:, :, None] + psi[None], 1)
            to_b, to_a = new_b - _lse(new_b, 1)[:, None], new_a - _lse(new_a, 1)[:, None]
        emission = emission.copy()
        np.add.at(emission, b, to_b)
        np.add.at(emission, a, to_a)
    return chains.best(emission, transition)


class Field:
    """Feature indices, weights of features and transitions, and the weight of the skip edges."""

    def __init__(self, index: dict[str, int], weights, transition, skip: float = SKIP_WEIGHTS[0]):
        self.index, self.weights, self.transition, self.skip = index, weights, transition, skip

    def emission(self, rows: list[list[int]]):
        import numpy as np

        return self.summed(np.fromiter((x for r in rows for x in r), "int64"), np.array([len(r) for r in rows], "int64"))

    def summed(self, flat, sizes):
        """Sums of the weights of each unit's features, ``flat`` being all of them in a row."""
        import numpy as np

        sums = np.concatenate([np.zeros((1, len(LABELS))), np.cumsum(self.weights[flat], axis=0)])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def fit_field(sequences, numbers: dict[str, int], steps: int = 80, rate: float = 0.4, penalty: float = 2e-6) -> Field:
    """Maximum likelihood of the chains by AdaGrad over the whole sample.

    ``sequences``: lists of feature numbers and the labels; ``numbers``: the number of each feature.
    """
    import numpy as np

    counts = Counter(f for rows, _ in sequences for row in rows for f in row)
    kept = {old: new for new, old in enumerate(sorted(f for f, n in counts.items() if n >= 2))}
    index = {name: kept[old] for name, old in numbers.items() if old in kept}
    rows = [[kept[f] for f in row if f in kept] for seq, _ in sequences for row in seq]
    gold = np.array([y for _, labels in sequences for y in labels], "int64")
    chains = Chains([len(labels) for _, labels in sequences])
    size = len(LABELS)
    weights, transition = np.zeros((len(index), size)), np.zeros((size, size))
    if not len(gold):
        transition[0] = [0, 0, -50, 0, 0, 0, 0]
        return Field(index, weights, transition)
    flat = np.array([x for r in rows for x in r], "int64")
    sizes = np.array([len(r) for r in rows], "int64")
    owner = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(flat, kind="stable")
    sorted_rows, cuts = owner[order], np.searchsorted(flat[order], np.arange(len(index)))
    empirical = np.zeros((size, size))
    for before, now in zip(chains.steps, chains.steps[1:]):
        np.add.at(empirical, (gold[before[: len(now)]], gold[now]), 1)
    field = Field(index, weights, transition)
    total_w, total_t = np.full(weights.shape, 1e-8), np.full(transition.shape, 1e-8)
    hot = np.eye(size)[gold]
    for _ in range(steps):
        node, edges, _ = chains.beliefs(field.summed(flat, sizes), transition)
        diff = (hot - np.exp(node)) / len(gold)
        grad = np.add.reduceat(diff[sorted_rows], cuts, axis=0) if len(index) else weights
        grad = grad - penalty * weights
        total_w += grad**2
        weights += rate * grad / np.sqrt(total_w)
        grad = (empirical - edges) / len(gold) - penalty * transition
        total_t += grad**2
        transition += rate * grad / np.sqrt(total_t)
    transition[[0, 3, 4, 5, 6], 2] = -50  # a name goes on only after it has begun
    return field


def word_counts(text: str, hints: Hints) -> Counter:
    """What a text adds to the counts of words, by (word, what, other).

    0: the text holds it; 1: in small letters; 2: occurrences in capitals; 3, 4: of these, after and before a neighbour.
    5, 6: beside a hinted name, so as given or family name, which counts where ``other`` is no ordinary word; 7: before a
    whole name, which counts where all or any (by its first letter) of the words of ``other`` are none.
    """
    u, out = Units(text), Counter()
    kind, case, word, n = u.kind, u.case, u.word, len(u)
    for w, c in {(w, c == "a") for w, k, c in zip(word, kind, case) if k == "word"}:
        out[w, 0, ""] = 1
        if c:
            out[w, 1, ""] = 1
    named = any(plain_word(w) in hints.kind for w in set(word))
    known = lambda i: hints.of(plain_word(word[i])) if kind[i] == "word" and case[i] in ("c", "A") else 0
    for i in [i for i, c in enumerate(case) if c == "c" or c == "A"]:
        w = word[i]
        out[w, 2, ""] += 1
        if i and kind[i - 1] == "word":
            out[w, 3, word[i - 1]] += 1
        if i + 1 < n and kind[i + 1] == "word":
            out[w, 4, word[i + 1]] += 1
        if not named:
            continue
        own, j, turned = known(i), i + 1, False
        if j < n and word[j] in (".", ",") and not own:
            j += 1
        if j < n and not own and kind[j] == "word" and (name := name_parts(u, j, hints)):
            out[w, 7, "\x1f".join(("all" if name[2] else "any", *name[1]))] += 1
        j = i + 1
        if j + 2 < n and case[j] == "1" and word[j + 1] == ".":
            j += 2
        elif j + 1 < n and word[j] == ",":
            j, turned = j + 1, True
        if j >= n or kind[j] != "word" or case[j] != case[i]:
            continue
        g, f = (j, i) if turned else (i, j)
        if known(g) & 1 and not known(f) and word[f] not in TITLES:
            out[word[f], 6, word[g]] += 1
        if known(f) & 2 and not known(g) and word[g] not in TITLES:
            out[word[g], 5, word[f]] += 1
    return out


def often(texts: int) -> tuple[int, int, int]:
    """From how many texts in small letters, occurrences in capitals and texts in any case a word may be ordinary."""
    return max(3, texts // 4000), max(4, texts // 3000), max(20, texts // 150)


def common_words(counts: dict[str, tuple], texts: int, hinted: Hints) -> tuple[set[str], set[str]]:
    """(ordinary words, those of them that may be names) of the counts over ``texts`` different texts.

    ``counts``: texts with the word, with it in small letters, its occurrences in capitals, the most of these after
    one and the same neighbour, that neighbour, the most before one, and it.  A word is ordinary by its small
    letters, where it is in many texts, or in a fixed phrase: one neighbour in four of five.  Hinted names are so only
    by their small letters.  A word never in small letters, beside another such word, may as well be of a name
    that is written often.
    """
    small, capital, many = often(texts)
    counts = {w: c for w, c in counts.items() if c[1] >= small or c[2] >= capital or c[0] >= many}
    plain = {w for w, (held, low, *_) in counts.items() if low >= small and low >= 0.2 * held}
    found = {w for w, (held, low, total, b, _, a, _) in counts.items() if held >= many or (total >= capital and max(b, a) >= 0.8 * total)}
    found = {w for w in found if w in plain or not hinted.of(plain_word(w))}
    proper = lambda w: w and len(w) > 1 and w not in plain and w not in TITLES and not counts.get(w, (0, 0))[1]
    fixed = {w for w in found if proper(w) and (proper(counts[w][4]) or proper(counts[w][6]))}
    return found | plain, fixed


def prepare(texts: list[str], given, family) -> Hints:
    """Hints with the ordinary words of the texts; copies of a text count once."""
    texts, sums, counts, plain = set(texts), Counter(), {}, Hints(given, family)
    for text in texts:
        sums.update(word_counts(text, plain))
    for (w, what, other), n in sorted(sums.items()):
        if what > 4:
            continue
        own = counts.setdefault(w, [0, 0, 0, 0, "", 0, ""])
        if what < 3:
            own[what] = n
        elif (n, other) > tuple(own[2 * what - 3 : 2 * what - 1]):
            own[2 * what - 3 : 2 * what - 1] = [n, other]
    return hints_of(counts, len(texts), given, family)


def hints_of(counts, texts: int, given, family) -> Hints:
    common, fixed = common_words(counts, texts, Hints(given, family))
    return Hints(given, family, common | TITLES, fixed)


def accepted(word: str, counts, hints: Hints, least: int = LEXICON_LEAST) -> int:
    """What the votes of the whole corpus make of a word: bits as in Hints, 4 for a word that introduces names, 0 for neither."""
    total, given, family, leading = counts
    if leading >= 4 and leading >= 0.3 * total:
        return 4
    share = 0.05 if word in hints.common else 0.2
    most = max(given, family)
    if most < least or most < share * total:
        return 0
    return (given >= least and given >= 0.3 * most) * 1 | (family >= least and family >= 0.3 * most) * 2


def join_lexicon(hints: Hints, found: dict[str, int]) -> Hints:
    """The hints and the names found, in a copy."""
    if not found:
        return hints
    joined = Hints((), (), hints.common, hints.fixed)
    joined.kind = dict(hints.kind)
    hints = joined
    for word, bits in found.items():
        if bits & 4:
            hints.common.add(word)
        else:
            hints.kind[word] = hints.kind.get(word, 0) | bits
    return hints


def train(texts: list[str], hints: Hints, seed: int = 5) -> Field:
    """The field fitted on the clear places of the sample."""
    seen, doubtful = Counter(), Counter()
    around: set[tuple[str, str]] = set()
    cut = [Units(text) for text in texts]
    for u in cut:
        for i, label in (clear_labels(u, hints, seen, doubtful, decide=False) or {}).items():
            if label == 1:
                around.add(outside(u, i, name_here(u, i, hints)[0]))
    rng = random.Random(seed)
    sequences, index, repeated = [], {}, []

    def writings():
        for u in cut:
            yield u
            if len(u.text) < 2_000 and rng.random() < 0.25 and any(name_here(u, i, hints) for i in range(len(u)) if u.kind[i] == "word"):
                yield Units(u.text.lower() if rng.random() < 0.5 else u.text.upper())  # names in any case

    for u in writings():
        runs = active_runs(u, hints)
        labels = clear_labels(u, hints, seen.copy(), doubtful.copy(), decide=True) if runs else None
        if labels is None:
            continue
        if runs and zlib.crc32(u.text.encode()) % 4 == 0:  # a quarter of the texts tells the weight of the skip edges
            repeated.append((u, [run for run in runs if not unclear(u, run, labels, hints)], labels))
        for run in runs:
            gold = [labels.get(i, 0) for i in run]
            if unclear(u, run, labels, hints) or perhaps_named(u, run, labels, hints, around) or (not any(gold) and rng.random() < 0.3):
                continue
            hide = rng.random() < 0.3
            fixed = bool(hints.fixed) and rng.random() < 0.4
            rows = [[index.setdefault(f, len(index)) for f in features(u, i, hints, fixed or (hide and rng.random() < 0.7), fixed)] for i in run]
            sequences.append((rows, gold))
    field = fit_field(sequences, index)
    field.skip = skip_weight(repeated, hints, field, rng)
    return field


def skip_weight(texts, hints: Hints, field: Field, rng: random.Random) -> float:
    """The weight of the skip edges that labels best the clear texts (units, runs, labels) of a part of the sample.

    Of the mentions of a name half are looked at without their hints, as of names nobody listed, so that what the others
    say of it counts.  Best is most labels right of those given or due; texts without repeats say nothing.
    """
    import numpy as np

    rows, gold, lengths, left, right = [], [], [], [], []
    for u, runs, labels in texts:
        keys = [skip_key(u, i, hints) for run in runs for i in run]
        if len(set(keys) - {None}) == sum(k is not None for k in keys):
            continue
        first: dict[str, int] = {}
        for key, i in zip(keys, (i for run in runs for i in run)):
            if key is not None and first.setdefault(key, len(rows)) != len(rows):
                left.append(first[key])
                right.append(len(rows))
            rows.append([field.index[f] for f in features(u, i, hints, key is not None and rng.random() < 0.5) if f in field.index])
            gold.append(labels.get(i, 0))
        lengths += [len(run) for run in runs]
    if not left:
        return SKIP_WEIGHTS[0]
    chains, emission, gold = Chains(lengths), field.emission(rows), np.array(gold)
    skips, best = (np.array(left, int), np.array(right, int)), (-1.0, SKIP_WEIGHTS[0])
    for weight in SKIP_WEIGHTS:
        said = infer(chains, emission, field.transition, skips, weight)
        named = (said > 0) | (gold > 0)
        share = round(float((said == gold)[named].mean()), 6) if named.any() else 1.0
        if share > best[0]:
            best = (share, weight)
    return best[1]


# ---- mentions


def alike(word: str) -> str:
    """What similar words have in common: their letters without accents and other marks."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def skip_key(u: Units, i: int, hints: Hints) -> str | None:
    """What a unit has in common with those it is joined to: the letters of a name, the digits of a number, an address for e-mail."""
    kind, word = u.kind[i], u.word[i]
    if kind == "word" and len(word) > 2 and (u.case[i] in "cA" or word in hints.kind) and (word not in hints.common or word in hints.fixed):
        return alike(word)
    return re.sub(r"\W", "", u.said[i]) if kind == "number" else u.said[i].lower() if kind == "email" else None


def mentions(texts: list[str], hints: Hints, field: Field) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) spans of each text, in order."""
    import numpy as np

    index = field.index
    per_text, rows, lengths, left, right, base = [], [], [], [], [], 0
    for text in texts:
        u = Units(text) if text else None
        runs = active_runs(u, hints) if u else []
        per_text.append((u, runs))
        first: dict[str, int] = {}  # the hub of all repeats
        for run in runs:
            for i in run:
                rows.append([index[f] for f in features(u, i, hints) if f in index])
                key = skip_key(u, i, hints)
                if key is not None:
                    if key in first:
                        left.append(first[key])
                        right.append(base)
                    first.setdefault(key, base)
                base += 1
            lengths.append(len(run))
    chains = Chains(lengths)
    labels = infer(chains, field.emission(rows), field.transition, (np.array(left, int), np.array(right, int)), field.skip) if rows else []
    out, at = [], 0
    for text, (u, runs) in zip(texts, per_text):
        spans = []
        for run in runs:
            own = labels[at : at + len(run)]
            at += len(run)
            i = 0
            while i < len(run):
                y, place = int(own[i]), run[i]
                if y in (1, 2):
                    j = i + 1
                    while j < len(run) and own[j] == 2:
                        j += 1
                    span = whole_name(u, list(run)[i:j], hints)
                    if span:
                        spans.append((*span, "name"))
                    i = j
                    continue
                if y and u.kind[place] in ("email", "number", "address"):
                    kind = LABELS[y]
                    if (kind == "email") == (u.kind[place] == "email") and (kind == "address") == (u.kind[place] == "address"):
                        spans.append((u.start[place], u.end_of(place), kind))
                i += 1
        out.append(spans)
    return out


def whole_name(u: Units, places: list[int], hints: Hints) -> tuple[int, int] | None:
    """Span of a name without title and outer marks; None for a lone word.  An initial at the end takes the word after it."""
    while places and (u.kind[places[0]] != "word" or u.word[places[0]] in TITLES):
        places = places[1:]
    for k, i in enumerate(places):
        if u.word[i] == "." and u.case[places[k - 1]] != "1":
            places = places[:k]  # the sentence ends here
            break
    while places and u.kind[places[-1]] != "word":
        places = places[:-1]
    if places and u.case[places[-1]] == "1" and not any(u.word[i] == "," for i in places):
        i = places[-1]
        if i + 2 < len(u) and u.kind[i + 2] == "word" and (u.case[i + 2] in ("c", "A") or hints.of(plain_word(u.word[i + 2])) & 2):
            places = [*places, i + 1, i + 2]
        else:
            return None
    words = [i for i in places if u.kind[i] == "word"]
    if len(words) < 2 or all(u.case[i] == "1" for i in words) or any(u.kind[i] not in ("word", "mark") for i in places):
        return None
    return u.start[places[0]], u.end_of(places[-1])


def names_of(batch) -> dict[str, int]:
    """The names of a batch of texts, where they come with the texts."""
    return {x["word"]: x["bits"] for x in batch.column(2).flatten().to_pylist()} if batch.column(2).null_count < batch.num_rows else {}


def redact(text: str, spans) -> str:
    """The text with each span replaced by the placeholder of its type and otherwise unchanged."""
    parts, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join(parts) + text[at:]


# ---- over tables


class Detector:
    """Field fitted on a bounded sample; ordinary words and the lexicon of names are counted over the whole corpus."""

    def __init__(self, documents: DataFrame, hints: DataFrame | None = None, saved: str | None = None):
        """Fitted on ``documents`` and ``hints``, or read from where ``save`` wrote another one."""
        self.spark = documents.sparkSession
        self.documents = documents
        self.texts = spread(documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"))
        if saved is None:
            self._fit(documents, hints)
        else:
            self._load(saved)

    def save(self, path: str) -> None:
        """Write the fitted field, the ordinary words and the names found to tables below ``path``."""
        hints, field = self.model.value
        parts = {"kind": hints.kind, "common": sorted(hints.common), "fixed": sorted(hints.fixed), "index": field.index, "weights": field.weights.tolist(), "transition": field.transition.tolist(), "skip": field.skip}
        rows = [(name, json.dumps(value)) for name, value in parts.items()]
        self.spark.createDataFrame(rows, "part string, value string").write.mode("overwrite").parquet(f"{path}/model")
        self.names.write.mode("overwrite").parquet(f"{path}/names")

    def _load(self, path: str) -> None:
        import numpy as np

        parts = {r.part: json.loads(r.value) for r in self.spark.read.parquet(f"{path}/model").collect()}
        self.names = self.spark.read.parquet(f"{path}/names")
        self.sent = len(self.names.take(NAMES_SENT + 1)) <= NAMES_SENT
        self.hints = Hints((), (), parts["common"], parts["fixed"])
        self.hints.kind = parts["kind"]
        field = Field(parts["index"], np.array(parts["weights"]).reshape(-1, len(LABELS)), np.array(parts["transition"]), parts["skip"])
        self.model = self.spark.sparkContext.broadcast((self.hints, field))

    def _fit(self, documents: DataFrame, hints: DataFrame) -> None:
        listed = hints.filter("name IS NOT NULL").select("name", "kind").distinct().take(HINTS_MOST + 1)  # a fixed table
        if len(listed) > HINTS_MOST:
            raise ValueError(f"more than {HINTS_MOST} name hints; they are sent to every task, so their number is bounded")
        given = [r.name for r in listed if r.kind == "given"]
        family = [r.name for r in listed if r.kind == "family"]
        rows = documents.count()
        share = min(1.0, FIT_DOCUMENTS / max(rows, 1))
        chosen = self.texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("doc_id").select("text").limit(2 * FIT_DOCUMENTS)
        sampled = [r.text for r in chosen.collect()]
        self.hints = self._counted(given, family)
        found = self.names.take(NAMES_SENT + 1)
        self.sent = len(found) <= NAMES_SENT
        if not self.sent:
            words = sorted({plain_word(w) for t in sampled for w in Units(t).word})  # of the bounded sample
            found = self.names.join(F.broadcast(self.spark.createDataFrame([(w,) for w in words], "word string")), "word", "left_semi").collect()
        known = join_lexicon(self.hints, {r.word: r.bits for r in found})
        field = train(sampled, known)
        self.model = self.spark.sparkContext.broadcast((known if self.sent else self.hints, field))

    def _counted(self, given, family) -> Hints:
        """Hints with the ordinary words of the whole corpus, and ``self.names``, the names found beside hinted ones in it.

        One pass over all different texts; what is collected of it is bounded by the shares in ``often``.
        """
        listed = self.spark.sparkContext.broadcast(Hints(given, family))

        def count(batches):
            import pyarrow as pa

            for batch in batches:
                found = Counter({("", 0, ""): batch.num_rows})
                for text in batch.column(0).to_pylist():
                    found.update(word_counts(text, listed.value))
                words, what, other = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(what, pa.int32()), pa.array(other, pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "what", "other", "n"])

        parts = self.texts.select("text").distinct().mapInArrow(count, "word string, what int, other string, n bigint")
        of = lambda what, value: F.max(F.when(F.col("what") == what, value))
        n = lambda what: F.coalesce(of(what, F.col("n")), F.lit(0))
        beside = F.struct("n", "other")
        said = F.collect_list(F.when(F.col("what") > 4, F.struct("what", "other", "n")))  # by hinted names, a fixed list
        words = parts.groupBy("word", "what", "other").agg(F.sum("n").alias("n")).groupBy("word")
        words = checkpointed(words.agg(n(0).alias("held"), n(1).alias("low"), n(2).alias("total"), of(3, beside).alias("b"), of(4, beside).alias("a"), said.alias("said")))
        texts = words.filter("word = ''").first()
        texts = texts.held if texts else 0
        small, capital, many = often(texts)
        kept = words.filter((F.col("word") != "") & ((F.col("low") >= small) | (F.col("total") >= capital) | (F.col("held") >= many))).drop("said")
        counts = {r.word: (r.held, r.low, r.total, *(r.b or (0, "")), *(r.a or (0, ""))) for r in kept.toLocalIterator()}
        hints = hints_of(counts, texts, given, family)
        shared = self.spark.sparkContext.broadcast(hints)

        def accept(batches):
            import pyarrow as pa

            for batch in batches:
                names, bits = [], []
                for word, total, said in zip(*(c.to_pylist() for c in batch.columns)):
                    votes = [0, 0, 0]
                    for what, other, n in ((x["what"], x["other"], x["n"]) for x in said):
                        how, *own = other.split("\x1f") if what == 7 else ("any", other)
                        votes[what - 5] += n * (all if how == "all" else any)(w not in shared.value.common for w in own)
                    if found := accepted(plain_word(word), (total, *votes), shared.value):
                        names.append(plain_word(word))
                        bits.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bits, pa.int32())], names=["word", "bits"])

        names = words.filter((F.col("word") != "") & (F.size("said") > 0)).select("word", "total", "said").mapInArrow(accept, "word string, bits int")
        self.names = checkpointed(names.groupBy("word").agg(F.bit_or("bits").alias("bits")))
        return hints

    def _named(self, texts: DataFrame) -> DataFrame:
        """Texts with ``names``, those of ``self.names`` that each holds: the way for more names than may be broadcast."""

        def cut(batches):
            import pyarrow as pa

            for batch in batches:
                rows = []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    u = Units(text)
                    rows += [(i, w) for w in {plain_word(w) for w, k in zip(u.word, u.kind) if k == "word"}]
                at = pa.array([i for i, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([w for _, w in rows], pa.string())], names=["t0", "t1", "word"])

        marks = [F.xxhash64(F.lit(i), F.coalesce("text", F.lit(""))).alias(f"t{i}") for i in (0, 1)]
        keyed = texts.select("*", *marks)
        words = keyed.filter("text IS NOT NULL").select("t0", "t1", "text").mapInArrow(cut, "t0 bigint, t1 bigint, word string").distinct()
        held = join_hot(words, self.names, ["word"]).groupBy("t0", "t1").agg(F.collect_list(F.struct("word", "bits")).alias("names"))
        return join_hot(keyed, held, ["t0", "t1"], "left").drop("t0", "t1")

    def _with_names(self, texts: DataFrame) -> DataFrame:
        return texts.withColumn("names", F.lit(None).cast("array<struct<word:string,bits:int>>")) if self.sent else self._named(texts)

    def found(self) -> DataFrame:
        """(doc_id, pii_type, mention), distinct."""
        model = self.model

        def cut(batches):
            import pyarrow as pa

            listed, field = model.value
            for batch in batches:
                for piece in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                    hints = join_lexicon(listed, names_of(piece))
                    texts, ids = piece.column(1).to_pylist(), piece.column(0).to_pylist()
                    out = {(doc, k, t[s:e]) for doc, t, spans in zip(ids, texts, mentions(texts, hints, field)) for s, e, k in spans}
                    doc, kind, said = zip(*sorted(out)) if out else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(kind, pa.string()), pa.array(said, pa.string())], names=["doc_id", "pii_type", "mention"])

        return self._with_names(self.texts).mapInArrow(cut, "doc_id bigint, pii_type string, mention string").distinct()

    def redacted(self) -> DataFrame:
        """(doc_id, text) with typed placeholders of all rows; null and empty texts stay as they are."""
        model = self.model

        def replace(batches):
            import pyarrow as pa

            listed, field = model.value
            for batch in batches:
                for piece in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                    hints = join_lexicon(listed, names_of(piece))
                    texts = piece.column(1).to_pylist()
                    new = [redact(t, s) if t else t for t, s in zip(texts, mentions(texts, hints, field))]
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(new, pa.string())], names=["doc_id", "text"])

        return self._with_names(spread(self.documents.select("doc_id", "text"))).mapInArrow(replace, "doc_id bigint, text string")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Detector(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_hint")).found()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Detector(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_hint")).redacted()


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted}
