"""Personal information in free text, by a skip-chain conditional random field.

The field labels tokens: words, numbers and marks. Every kind of piece has labels of its own: given names, initials and family
names with the hyphens and commas between them, and the first and further tokens of addresses of mail and street, of phone
and of identity numbers. A token's evidence is its own spelling, the class of the three tokens before and after it and the
spaces between them; neighbours in a line share transition weights, and tokens of a document with the same form (case,
accents, possessive and plural endings and doubled letters folded) are linked by a skip potential for equal labels, so
that a label is carried across the document. Messages pass along the chains exactly and along the links until they settle
(loopy belief propagation), for many lines at once in numpy.

Some words can only be O by the field's own hard constraints: plain words of the corpus away from any number or at-sign. A chain
is cut at such tokens, which changes nothing: given its label, the two sides are independent.

There are no given labels. A logistic model over character n-grams of the known family names tells which words look like
family names, words that stand beside those become likely given names (counted over all documents), and patterns of written forms
label pieces of a bounded sample of documents (FIT_DOCS, by smallest hash). All weights of the field, the skip potentials too, are
fitted to those labels by likelihood. On texts the field's pieces are found first; an exact check of the written form then sets the
bounds of mails, numbers and streets.

Defined results: null, empty and blank texts have no pieces and stay as they are; each distinct (doc_id, type, text) comes
once; whole texts are read, however long; empty name lists or tables give no names; extra columns are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import spread, write_table

#: Documents the weights of the field are fitted on at most.
FIT_DOCS = 2500
#: Tokens of these documents in the fit at most: those near labels first, the others by position hash.
FIT_TOKENS = 24_000
GRAMS = 2048
#: Known names of a kind the character model is fitted to at most, by smallest hash; all are looked up.
FIT_NAMES = 20_000
#: Known names that one model holds at most (8 bytes each); more are refused.
MOST_NAMES = 20_000_000
#: Words of other kinds that the character model is fitted to: so many of the most frequent and so many by smallest hash, of fewer than
#: 4 letters and of more each.
OTHER_WORDS = 2500
#: Buckets of words whose corpus counts are kept together; the table that is broadcast has this size at every corpus.
BUCKETS = 1 << 20
#: Score of a known family name at least.
LISTED = 1.0
#: Rounds of messages over the links at most; they end once no message moves by more than SETTLED.
ROUNDS, SETTLED = 30, 1e-3
#: Runs of glued tokens on either side of a number or at-sign that may belong to its piece; of plain words that no street is named by, so many.
NEAR, BESIDE = 4, 2

LABELS = ["O", "given", "initial", "family", "hyphen", "comma", "email", "email+", "phone", "phone+", "id_number", "id_number+", "address", "address+"]
O, G, I, N, H, C = range(6)
K = len(LABELS)
#: A token whose belief in a written form is at least this share of that in its best label is checked for the form.
FORM_SHARE = 0.1
#: Types of written forms and the labels of their first tokens; the next label is that of further ones.
FORMS = {"email": 6, "phone": 8, "id_number": 10, "address": 12}

_AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?|\s(?:AT|at)\s)"
_EMAIL = regex.compile(
    r"(?<![\w.+\-%/@])[\p{L}\p{N}](?:[\w.+\-%]*[\p{L}\p{N}_])?(?:@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}(?![\w@]|\.\w|:[\w/~])"
    r"|\s?[\[(]\s?at\s?[\])]\s?[\p{L}\p{N}\-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[\p{L}\p{N}\-]+)+(?!\w)"
    r"|\s(?:AT|at)\s[\p{L}\p{N}\-]+(?:\s(?:DOT|dot)\s[\p{L}\p{N}\-]+)+(?!\w))",
    regex.I,
)
_S = r"[^\S\r\n]"  # a space of any kind within a line
_PHONE = regex.compile(
    rf"(?<![\w.\-+/@:#])(?:\+\d{{1,3}}(?:{_S}|[.\-])?(?:\(0?\d{{0,4}}\)(?:{_S}|[.\-])?)?\d(?:(?:{_S}|[.\-])?\d){{6,12}}"
    rf"|\(\d{{3}}\){_S}?\d{{3}}(?:{_S}|[.\-])\d{{4}}|\d{{3}}(?P<sep>[.\-]|{_S})\d{{3}}(?P=sep)\d{{4}}"
    rf"|0\d{{1,4}}(?:{_S}\d{{2,4}}){{2,4}}|0\d{{2,4}}[ \-/]\d{{5,8}})(?![\w]|[.\-/]\w|{_S}\d)|(?<=(?i:tel:))\+?[\d(](?:{_S}?[.\-()]?{_S}?\d){{6,13}}(?!\w)"
)
_ID = regex.compile(rf"(?<![\w.\-/+#])(?:\d{{3}}-\d{{2}}-\d{{4}}|\d{{3}}{_S}\d{{2}}{_S}\d{{4}}|\p{{Lu}}{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}[A-D]|\p{{Lu}}{{2}}\d{{6}}[A-D]|\p{{Lu}}{{2}}\d{{7}}|\d{{8}}-\p{{Lu}})(?![\w]|[\-/.]\w)")
#: Words that end or begin a street's name (fixed values).
_STREET = "Street St Road Rd Lane Ln Avenue Ave Drive Dr Court Ct Close Boulevard Blvd Terrace Row Way Place Square Crescent Quay Mews Parade Walk Alley Gardens Hill"
_ENDS = "|".join([*_STREET.split(), *_STREET.upper().split()])
_PLAIN = "street|road|lane|terrace"
_W = r"\p{Lu}[\p{L}'’\-]*"
_NO = r"(?<![\w.\-/:#@])\d{1,5}"  # a house number
_END_NO = rf"{_S}\d{{1,5}}(?:{_S}?\p{{Ll}}(?!\w))?(?!\w)"
_ADDRESS = regex.compile(
    rf"{_NO}(?:\p{{L}}|{_S}(?:bis|ter))?,?{_S}(?i:rue|avenue|quai|boulevard|place|impasse|chemin|allée|cours){_S}(?:(?i:de|du|des|la|le|les){_S}|[dl]['’])*{_W}(?:{_S}{_W})*"
    rf"|{_NO}\p{{L}}?{_S}(?:(?:[NSEW]|St|ST)\.{_S})?(?!The{_S}){_W}{_S}(?:{_W}{_S}){{0,2}}?(?:{_ENDS})(?!\w)"
    rf"|{_NO}\p{{L}}?{_S}(?:St|ST)\.{_S}{_W}{_S}(?:{_ENDS})(?!\w)"
    rf"|{_NO}\p{{L}}?{_S}(?:Lower|Upper|Great|Little|Old|LOWER|UPPER){_S}{_W}(?!\w)"
    rf"|{_NO}\p{{L}}?{_S}(?:\p{{Ll}}+{_S}){{1,2}}(?:{_PLAIN})(?!\w)"
    rf"|(?<!\w)(?:Avenida|Calle|Plaza|Paseo|Camino|Carrera|Ronda|AVENIDA|CALLE|PLAZA){_S}(?:(?i:de|del|la|las|los|el){_S})*{_W}(?:{_S}{_W})*,?{_END_NO}"
    rf"|(?<!\w)(?:(?:Alte|Alter|Neue|Neuer|Große|Kleine){_S})?\p{{Lu}}[\p{{L}}\-]*(?i:straße|strasse|str\.|gasse|weg|platz|allee|damm|ring){_END_NO}"
    rf"|(?<!\w){_W}{_S}(?:Straße|Strasse|STRASSE|Str\.|Weg|Platz|Allee|Gasse){_END_NO}"
    rf"|(?<!\w)(?:Am|Im|Zum|Zur|An{_S}der|Auf{_S}der|Auf{_S}dem|AM|IM){_S}{_W}{_END_NO}"
)
_TOKEN = regex.compile(r" ?[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*| ?\d+|[\r\n\v\f\x1c-\x1e\x85  ]+|[^\S\r\n\v\f\x1c-\x1e\x85  ]{2,}| ?[^\w\s]| ?_|.", regex.S)
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
#: The same over texts of ASCII only, for which the standard library is faster.
_ASCII_TOKEN = re.compile(r" ?[A-Za-z]+(?:'[A-Za-z]+)*| ?[0-9]+|[\r\n\v\f\x1c-\x1e]+|[ \t]{2,}| ?[^\w\s]| ?_|.", re.S | re.A)
_ASCII_WORD = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)*")
_BREAKS = set("\r\n\v\f\x1c\x1d\x1e\x85  ")


def _fold(word: str) -> str:
    return unicodedata.normalize("NFC", word).casefold()


def _similar(folded: str) -> str:
    """The form by which tokens are linked: without accents, possessive and plural endings, doubled letters."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", folded) if not unicodedata.combining(c))
    bare = regex.sub(r"['’]s?$", "", bare)
    bare = bare[:-1] if len(bare) > 4 and bare.endswith("s") and not bare.endswith("ss") else bare
    return regex.sub(r"(.)\1+", r"\1", bare)


def _key(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def forms(text: str) -> list[tuple[int, int, str]]:
    """Spans (begin, end, type) with a written form of their own; where two meet, the one listed first stays. Labels for the fit."""
    found: list[tuple[int, int, str]] = []
    for kind in ("email", "id_number", "phone", "address"):
        for begin, end in _matches(kind, text, 0, len(text)):
            if not any(b < end and begin < e for b, e, _ in found):
                found.append((begin, end, kind))
    return sorted(found)


def _matches(kind: str, text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Written forms of a type within a stretch of the text."""
    out = []
    if kind == "email":
        if text.find("@", begin, end) >= 0 or _SPELLED.search(text, begin, end):
            # The user of a remote (user@host:path, scheme://user@host) is no mail address.
            out = [m.span() for m in _PATTERNS[kind].finditer(text, begin, end) if text[max(0, m.start() - 3) : m.start()] != "://"]
    elif _DIGIT.search(text, begin, end):
        for m in _PATTERNS[kind].finditer(text, begin, end):
            if kind != "phone" or 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(m.span())
    return out


_DIGIT = regex.compile(r"\d")
_SPELLED = regex.compile(r"(?i)[\[(]\s?at\s?[\])]|\bat\s[\p{L}\p{N}\-]+\sdot\b")
_PATTERNS = {"email": _EMAIL, "id_number": _ID, "phone": _PHONE, "address": _ADDRESS}


# --- what is known of a token's spelling ---------------------------------------------------------------------------------


def _gram_ids(word: str) -> list[int]:
    w = f"^{_fold(word)}$".encode()
    return [crc32(w[i : i + n]) % GRAMS for n in (2, 3, 4, 5, 6) for i in range(len(w) - n + 1)]


class Names:
    """Known parts of names as sorted 64-bit hashes of their case-folded forms."""

    def __init__(self, family: np.ndarray, given: np.ndarray) -> None:
        self.keys = {"family": np.sort(family.astype(np.int64)), "given": np.sort(given.astype(np.int64))}

    @classmethod
    def of(cls, family: Iterable[str], given: Iterable[str]) -> Names:
        return cls(*(np.array([_key(w) for w in ws], np.int64) for ws in (family, given)))

    def has(self, kind: str, folded: str) -> bool:
        keys, k = self.keys[kind], _key(folded)
        at = int(np.searchsorted(keys, k))
        return at < len(keys) and int(keys[at]) == k


def bucket(folded: str) -> int:
    return crc32(folded.encode()) % BUCKETS


class Words:
    """Corpus counts by bucket of words: log odds of standing beside a family name (nan: unknown), and plain words."""

    def __init__(self, odds: np.ndarray, plain: np.ndarray) -> None:
        self.odds, self.plain = odds.astype(np.float32), plain.astype(bool)

    @classmethod
    def of(cls, buckets: np.ndarray, beside: np.ndarray, total: np.ndarray, n: np.ndarray, small: np.ndarray) -> Words:
        odds, plain = np.full(BUCKETS, np.nan, np.float32), np.zeros(BUCKETS, bool)
        met = (total >= 3) | ((total > 0) & (beside > 0))
        odds[buckets[met]] = np.log((beside[met] + 0.3) / (total[met] - beside[met] + 1.0))
        plain[buckets] = (n >= 5) & (small >= 0.6 * n)
        return cls(odds, plain)

    @classmethod
    def none(cls) -> Words:
        return cls(np.full(BUCKETS, np.nan, np.float32), np.zeros(BUCKETS, bool))


# Lexical classes (fixed values, compared case folded).
_LEXICAL = {
    "at": ["at"], "dot": ["dot"],
    "street": _STREET.casefold().split(),
    "head": ["rue", "avenue", "quai", "boulevard", "place", "impasse", "chemin", "allée", "cours", "avenida", "calle", "plaza", "paseo", "camino", "carrera", "ronda", "am", "im", "zum", "zur"],
    "small": ["de", "du", "des", "la", "le", "les", "del", "las", "los", "el", "d", "l", "der", "dem", "an", "auf", "alte", "alter", "neue", "neuer", "große", "kleine", "bis", "ter", "lower", "upper", "great", "little", "old", "the"],
    "tel": ["tel", "phone", "fax", "mobile", "mobil", "telefon", "téléphone", "teléfono", "call", "ext", "cell"],
}
_WORD_CLASS = {w: k for k in reversed(_LEXICAL) for w in _LEXICAL[k]}
_STRASSE = regex.compile(r"(?:straße|strasse|str|gasse|weg|platz|allee|damm|ring)$")
_MARKS = "@.-_+()[]/:,#%'\"&*<>=;!?’"
_SHAPES = ["Cap", "UPPER", "lower", "Mixed"]
_KINDS = ["", "plain", "family", "given", *_LEXICAL, "strasse"]
CLASSES = ["", *[f"d{n}" for n in range(1, 10)], *[f"z{n}" for n in range(1, 10)], "One", "one", *[f"{s} {k}" for s in _SHAPES for k in _KINDS], *_MARKS, "other mark", "other"]
_CLASS = {c: i for i, c in enumerate(CLASSES)}
_AT_WORDS = [_CLASS[f"{s} at"] for s in _SHAPES]
NONE = 2 * len(CLASSES)  # no token there: beyond the line
FEATURES = ["bias", "Cap", "UPPER", "lower", "family+", "family-", "given+", "given-", "new Cap", "short", "listed family", "listed given"]
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)


@dataclass
class Model:
    grams: np.ndarray
    bias: float
    names: Names
    words: Words
    own: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURES), K)))
    around: np.ndarray = field(default_factory=lambda: np.zeros((len(OFFSETS), NONE + 1, K)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, K, K)))  # without and with a space between
    skip: np.ndarray = field(default_factory=lambda: np.zeros(K))

    def family(self, word: str) -> float:
        """Log odds that the word looks like a family name, at least LISTED for a known one."""
        ids = _gram_ids(word)
        s = float(self.grams[ids].sum() / np.sqrt(len(ids)) + self.bias)
        return max(LISTED, s) if self.names.has("family", _fold(word)) else s

    def given(self, folded: str) -> float | None:
        """Log odds of a given name; None for a word met once or twice and never beside a family name."""
        odds = float(self.words.odds[bucket(folded)])
        if self.names.has("given", folded):
            return max(3.0, 0.0 if np.isnan(odds) else odds)
        return None if np.isnan(odds) else odds


class Vocabulary(dict):
    """Ids of token spellings; what is known of each is worked out once."""

    def __init__(self, model: Model, blind: bool = False) -> None:
        super().__init__()
        self.model, self.blind = model, blind
        self.rows: list[tuple] = []
        self.features: list[np.ndarray] = []
        self.links: dict[str, int] = {}
        self.words: dict[str, tuple] = {}
        self.table: list[np.ndarray] | None = None

    def __missing__(self, token: str) -> int:
        i = self[token] = len(self.rows)
        lead = len(token) > 1 and token[0] == " "
        row, x = self._word(token[1:] if lead else token)
        self.rows.append((len(token), lead, *row))
        self.features.append(x)
        return i

    def _word(self, bare: str) -> tuple:
        if bare not in self.words:
            self.words[bare] = self._typed(bare)
        return self.words[bare]

    def _typed(self, t: str) -> tuple:
        """((kind: 0 token, 1 space, 2 break; class; certainly O unless near a number; number or at-sign; link; plain small word), features)."""
        x = np.zeros(len(FEATURES), np.float32)
        x[0] = 1
        c = t[0]
        if c in _BREAKS:
            return (2, 0, True, False, -1, False), x
        if c.isspace():
            return (1, 0, True, False, -1, False), x
        if c.isdigit():
            return (0, _CLASS[("z" if c == "0" and len(t) > 1 else "d") + str(min(len(t), 9))], False, True, -1, False), x
        if not (c.isalpha() or unicodedata.category(c)[0] == "M"):
            return (0, _CLASS.get(c, _CLASS["other mark"]), True, c == "@", -1, False), x
        f, m = _fold(t), self.model
        fam, giv = (0.0 if self.blind else m.family(t)), m.given(f)
        listed = m.names.has("family", f) and not self.blind, m.names.has("given", f)
        plain = bool(m.words.plain[bucket(f)]) and not any(listed) and fam <= 0 and not (giv or -1) > 0
        upper = t.isupper() and len(t) > 1
        lower = t.islower()
        x[1], x[2], x[3] = c.isupper() and not upper, upper, lower
        x[4] = min(max(fam, 0), 6) / 3
        if plain or giv is not None:  # letters alone tell nothing against a word that the corpus does not know
            x[5] = min(max(-fam, 0), 6) / 3
        if giv is None:  # a capital leaves it open, a small word is taken for none
            x[8], x[7] = c.isupper() and len(t) > 1 and not plain, c.islower()
        else:
            x[6], x[7] = min(max(giv, 0), 3) / 1.5, min(max(-giv, 0), 3) / 1.5
        x[9], x[10], x[11] = len(t) < 4, *listed
        if len(t) == 1:
            klass = _CLASS["One" if c.isupper() else "one"] if f not in _WORD_CLASS else _CLASS[f"{'Cap' if c.isupper() else 'lower'} {_WORD_CLASS[f]}"]
        else:
            kind = _WORD_CLASS.get(f) or ("family" if fam > 0 else "given" if (giv or 0) > 0 else "strasse" if _STRASSE.search(f) else "plain" if plain else "")
            klass = _CLASS[f"{'UPPER' if upper else 'lower' if lower else 'Cap' if c.isupper() and t[1:].islower() else 'Mixed'} {kind}"]
        link = -1
        if len(t) > 2 and not plain:
            link = self.links.setdefault(_similar(f), len(self.links))
        return (0, klass, plain and len(t) > 1, f == "dot", link, plain and f not in _WORD_CLASS and lower), x

    def arrays(self) -> list[np.ndarray]:
        """Columns of rows (length, lead, kind, class, sure, trigger, link, common), then features."""
        have = 0 if self.table is None else len(self.table[0])
        if have < len(self.rows):
            new = [np.array(c) for c in zip(*self.rows[have:], strict=True)] + [np.array(self.features[have:])]
            self.table = new if self.table is None else [np.concatenate(p) for p in zip(self.table, new, strict=True)]
        return self.table or []


#: Spellings of which one task keeps what is known.
_KEPT = 500_000


# --- tokens ----------------------------------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """Tokens of several documents in order, without spaces: spelling, document, span in it, line, run of glued tokens."""

    ids: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    line: np.ndarray
    gap: np.ndarray  # a space before it, or the begin of a line
    near: np.ndarray  # at most NEAR runs from a number or at-sign of its line
    wide: np.ndarray  # more than two characters between it and the token before


def tokenise(texts: list[str | None], vocabulary: Vocabulary) -> Tokens:
    ids: list[int] = []
    counts = []
    known = vocabulary.__getitem__
    for t in texts:
        n = len(ids)
        if t:
            ids.extend(map(known, (_ASCII_TOKEN if t.isascii() else _TOKEN).findall(t)))
        counts.append(len(ids) - n)
    raw = np.array(ids, np.int64)
    if not len(raw):
        e = np.zeros(0, np.int64)
        return Tokens(e, e, e, e, e, *([e.astype(bool)] * 3))
    length, lead, kind, klass, _, trigger, _, common, _ = vocabulary.arrays()
    size = length[raw]
    end = np.cumsum(size)
    doc = np.repeat(np.arange(len(texts)), counts)
    start_of = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)[:-1]])]
    breaks = np.cumsum(kind[raw] == 2)
    keep = np.flatnonzero(kind[raw] == 0)
    ids_, doc_ = raw[keep], doc[keep]
    end_ = end[keep] - start_of[doc_]
    begin_ = end_ - size[keep] + lead[ids_]
    new_line = np.ones(len(keep), bool)
    new_line[1:] = (doc_[1:] != doc_[:-1]) | (breaks[keep][1:] != breaks[keep][:-1])
    between = np.zeros(len(keep), np.int64)
    between[1:] = begin_[1:] - end_[:-1]
    gap = new_line | (between > 0)
    line = np.cumsum(new_line)
    run = np.cumsum(gap) - 1
    hot = np.zeros(int(run[-1]) + 1 if len(run) else 0, bool)
    bracketed = np.zeros(len(keep), bool)  # "[at]"
    bracketed[1:] = np.isin(klass[ids_[1:]], _AT_WORDS) & np.isin(klass[ids_[:-1]], [_CLASS["["], _CLASS["("]]) & ~new_line[1:]
    hot[run[trigger[ids_].astype(bool) | bracketed]] = True
    run_line = np.zeros(len(hot), np.int64)
    run_line[run] = line
    near = hot.copy()
    for k in range(1, NEAR + 1):
        same = run_line[k:] == run_line[:-k]
        near[k:] |= hot[:-k] & same
        near[:-k] |= hot[k:] & same
        if k == BESIDE:
            beside = near.copy()
    alone = gap & np.append(gap[1:], True)  # glued to nothing
    far = alone & common[ids_].astype(bool)
    return Tokens(ids_, doc_, begin_, end_, line, gap, np.where(far, beside[run], near[run]), ~new_line & (between > 2))


def _windows(tokens: Tokens, klass: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Class and space of the token at each of OFFSETS from those at ``at``; NONE beyond the line."""
    both = klass * 2 + tokens.gap
    out = []
    for o in OFFSETS:
        src = np.clip(at + o, 0, len(both) - 1)
        inside = (at + o >= 0) & (at + o < len(both)) & (tokens.line[src] == tokens.line[at])
        out.append(np.where(inside, both[src], NONE))
    return out


#: Log weight of a label that a token of a kind cannot have.
_NEVER = -30.0


def _allowed() -> np.ndarray:
    """classes x labels: 0, or _NEVER: numbers and marks are no parts of names but for the dot of an initial, hyphens and commas."""
    out = np.zeros((len(CLASSES), K), np.float32)
    for i, c in enumerate(CLASSES):
        word = c in ("One", "one") or c.split(" ")[0] in _SHAPES
        may = {G, I, N} if word else {".": {I}, "-": {H}, ",": {C}}.get(c, set())
        out[i, sorted({G, I, N, H, C} - may)] = _NEVER
    return out


ALLOWED = _allowed()
_LETTERS = ALLOWED[:, G] == 0
#: Further tokens only follow those of their own type.
_FOLLOWS = np.zeros((K, K), np.float32)
for _first in FORMS.values():
    _FOLLOWS[:, _first + 1] = _NEVER
    _FOLLOWS[[_first, _first + 1], _first + 1] = 0


# --- the field ---------------------------------------------------------------------------------------------------------------


def _passes(u: np.ndarray, gap: np.ndarray, on: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary factors and normed forward and backward messages of chains, all tokens x chains x labels."""
    a = np.exp(move.astype(u.dtype))
    both, back = np.hstack([a[0], a[1]]), np.hstack([a[0].T, a[1].T])
    p = np.exp(np.clip(u, -60, 60))
    fwd, bwd = np.ones_like(p), np.ones_like(p)
    k = u.shape[2]
    one = np.ones((k, 1), u.dtype)  # sums by product, which is faster over short rows
    spaced = gap[:, :, None]
    for t in range(1, len(u)):
        m = (fwd[t - 1] * p[t - 1]) @ both
        m = np.where(spaced[t], m[:, k:], m[:, :k])
        np.divide(m, m @ one, out=fwd[t])
    for t in range(len(u) - 2, -1, -1):
        m = (bwd[t + 1] * p[t + 1]) @ back
        m = np.where(spaced[t + 1], m[:, k:], m[:, :k])
        np.divide(m, m @ one, out=bwd[t], where=on[t + 1, :, None])
    return p, fwd, bwd


def _groups(chains: list[tuple[int, int]] | np.ndarray, cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chains (begin, end) of about one length: token numbers (tokens x chains, -1 where a chain has ended) and the mask."""
    chains = np.asarray(chains, np.int64).reshape(-1, 2)
    size = chains[:, 1] - chains[:, 0]
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        least = int(size[order[i]])
        j = int(np.searchsorted(size[order], least + least // 4 + 1, "right"))
        j = min(j, i + max(1, cells // (least + least // 4 + 1)))
        part = chains[order[i:j]]
        steps = np.arange(int((part[:, 1] - part[:, 0]).max()))[:, None]
        at = part[:, 0] + steps
        on = at < part[:, 1]
        yield np.where(on, at, -1), on
        i = j


def beliefs(unary: np.ndarray, gap: np.ndarray, chains: np.ndarray, links: np.ndarray, move: np.ndarray, skip: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Labels' log beliefs of every token. unary: tokens x labels; chains: (begin, end); links: pairs of tokens that share a potential."""
    out = unary.copy()
    groups = list(_groups(chains))

    def along(u: np.ndarray, touched: np.ndarray | None) -> None:
        for at, on in groups:
            if touched is not None:
                reached = (touched[at] & on).any(axis=0)
                if not reached.any():
                    continue
                at, on = at[:, reached], on[:, reached]
            x = np.where(on[:, :, None], u[at], 0)
            p, fwd, bwd = _passes(x, gap[at], on, move)
            out[at[on]] = np.log(np.maximum(fwd * p * bwd, 1e-37))[on]

    along(unary, None)
    share = np.expm1(skip).astype(unary.dtype)
    if not len(links) or not share.any():
        return out
    # A link sends nothing while neither end may have a label that links share.
    mass = np.exp(out[:, share != 0] - out.max(axis=1, keepdims=True)).sum(axis=1)
    links = links[(mass[links] > 1e-4).any(axis=1)]
    left = np.zeros((len(links), unary.shape[1]), unary.dtype)  # messages to the first and the second end of each link
    right = left.copy()
    for _ in range(rounds):
        if not len(links):
            break
        new = []
        for end, message in ((0, left), (1, right)):
            cavity = out[links[:, end]] - message
            e = np.exp(cavity - cavity.max(axis=1, keepdims=True))
            m = np.log(np.maximum(e.sum(axis=1, keepdims=True) + share * e, 1e-37))
            new.append(m - m.max(axis=1, keepdims=True))
        moved = np.maximum(np.abs(new[1] - left).max(axis=1), np.abs(new[0] - right).max(axis=1))
        if moved.max() < SETTLED:
            break
        left, right = new[1], new[0]
        touched = np.zeros(len(unary), bool)
        touched[links[moved >= SETTLED].reshape(-1)] = True
        u = unary.copy()
        np.add.at(u, links[:, 0], left)
        np.add.at(u, links[:, 1], right)
        along(u, touched)
    return out


@dataclass
class Field:
    """The tokens of some texts that may have a label, their evidence, chains and links."""

    at: np.ndarray  # numbers of these among all tokens
    unary: np.ndarray
    gap: np.ndarray
    chains: np.ndarray
    links: np.ndarray


def evidence(tokens: Tokens, vocabulary: Vocabulary, whole: bool = False) -> Field:
    """The field over texts; ``whole`` keeps the tokens that can only be O, which changes no belief."""
    model = vocabulary.model
    _, _, _, klass, sure, _, link, _, x = vocabulary.arrays() or [np.zeros(0, int)] * 8 + [np.zeros((0, len(FEATURES)))]
    n = len(tokens.ids)
    certain = sure[tokens.ids].astype(bool) & ~tokens.near
    glued = np.zeros(n, bool)  # marks beside a token that may be part of a name stay open
    same = tokens.line[1:] == tokens.line[:-1] if n else np.zeros(0, bool)
    glued[1:] |= ~certain[:-1] & same
    glued[:-1] |= ~certain[1:] & same
    mark = ALLOWED[klass[tokens.ids], H] * ALLOWED[klass[tokens.ids], C] * ALLOWED[klass[tokens.ids], I] == 0
    certain &= ~(mark & glued)
    need = ~certain
    need[1:] |= ~certain[:-1] & same
    need[:-1] |= ~certain[1:] & same
    if whole:
        need[:] = True
    at = np.flatnonzero(need)
    kl = klass[tokens.ids]
    unary = (x @ model.own).astype(np.float32)[tokens.ids[at]] + ALLOWED[kl[at]]
    for o, w in enumerate(_windows(tokens, kl, at)):
        unary += model.around[o].astype(np.float32)[w]
    only = certain[at]
    unary[only] = _NEVER * 2
    unary[only, O] = 0
    cut = np.ones(len(at), bool)
    cut[1:] = (np.diff(at) != 1) | (tokens.line[at[1:]] != tokens.line[at[:-1]])
    begin = np.flatnonzero(cut)
    chains = np.stack([begin, np.append(begin[1:], len(at))], axis=1) if len(at) else np.zeros((0, 2), np.int64)
    linked = np.flatnonzero((link[tokens.ids[at]] >= 0) & ~only)
    key = np.stack([tokens.doc[at[linked]], link[tokens.ids[at[linked]]]])
    order = np.lexsort((linked, key[1], key[0]))
    twin = (key[:, order[1:]] == key[:, order[:-1]]).all(axis=0)
    links = np.stack([linked[order[:-1]][twin], linked[order[1:]][twin]], axis=1)
    return Field(at, unary, tokens.gap[at], chains, links)


def labels_of(tokens: Tokens, vocabulary: Vocabulary, skip: bool = True) -> tuple[Field, np.ndarray, np.ndarray]:
    """The field, the best label of each of its tokens, and its share of the belief."""
    f = evidence(tokens, vocabulary)
    b = beliefs(f.unary, f.gap, f.chains, f.links if skip else f.links[:0], vocabulary.model.move + _FOLLOWS, vocabulary.model.skip)
    best = b.argmax(axis=1)
    if len(b):  # forms are checked, so a fair share of the belief is enough for them
        form = 6 + b[:, 6:].argmax(axis=1)
        best = np.where((best < 6) & (b[np.arange(len(b)), form] > b.max(axis=1) + np.log(FORM_SHARE)), form, best)
    return f, best, b


# --- reading pieces off the labels -----------------------------------------------------------------------------------------------

#: Over one letter per token: given, initial, its dot, family, hyphen, comma.
_NAME = regex.compile(r"(?:G+(?:hG)?|Id?)(?:Id?|G)*N+(?:hN)*|N(?:hN)*c(?:G(?:hG)?|Id?)(?:Id?)*|N(?:hN)*(?:G(?:hG)?)(?:Id?)*(?!d|N|hN)")
_CODE = np.array(list("OGINhc" + "O" * (K - 6)))


def _names(texts: list[str | None], tokens: Tokens, f: Field, best: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, begin, end) of full names; neighbours in a chain with at most a space or two between parts."""
    chain_of = np.zeros(len(best), np.int64)
    chain_of[f.chains[1:, 0]] = 1
    chain_of = np.cumsum(chain_of)
    for c in np.unique(chain_of[best == N]):
        lo, hi = f.chains[c]
        part, ls = f.at[lo:hi], best[lo:hi].copy()
        doc, begin, end = int(tokens.doc[part[0]]), tokens.begin[part], tokens.end[part]
        text = texts[doc]
        for p in np.flatnonzero(ls == N):  # a hyphen without spaces between family names belongs to them
            if p + 2 < len(ls) and ls[p + 2] == N and text[begin[p + 1] : end[p + 1]] == "-" and end[p] == begin[p + 1] and end[p + 1] == begin[p + 2]:
                ls[p + 1] = H
        code = "".join("d" if v == I and text[begin[i] : end[i]] == "." else _CODE[v] for i, v in enumerate(ls))
        for m in _NAME.finditer(code):
            a, b = m.span()
            if not tokens.wide[part[a + 1 : b]].any():
                yield doc, int(begin[a]), int(end[b - 1])


def _written(texts: list[str | None], tokens: Tokens, f: Field, best: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """(document, begin, end, type) of written forms: the field's spans, with the bounds of the form that the exact check finds there."""
    at = np.flatnonzero(best >= 6)
    if not len(at):
        return
    first = (best[at] - 6) % 2 == 0
    joined = np.zeros(len(at), bool)
    joined[1:] = (np.diff(at) == 1) & ~first[1:] & ((best[at[1:]] - 6) // 2 == (best[at[:-1]] - 6) // 2) & (tokens.line[f.at[at[1:]]] == tokens.line[f.at[at[:-1]]])
    heads = np.flatnonzero(~joined)
    tails = np.append(heads[1:], len(at)) - 1
    kinds = list(FORMS)
    lines: dict[tuple[int, int, str], list[tuple[int, int]]] = {}
    for h, t in zip(heads, tails, strict=True):
        a, b = f.at[at[h]], f.at[at[t]]
        doc, kind, line = int(tokens.doc[a]), kinds[(best[at[h]] - 6) // 2], int(tokens.line[a])
        begin, end = int(tokens.begin[a]), int(tokens.end[b])
        if (doc, line, kind) not in lines:
            lo, hi = np.searchsorted(tokens.line, [line, line + 1])
            lines[doc, line, kind] = _matches(kind, texts[doc], int(tokens.begin[lo]), int(tokens.end[hi - 1]))
        for x, y in lines[doc, line, kind]:
            if x < end and begin < y:
                yield doc, x, y, kind


def pieces(texts: list[str | None], vocabulary: Vocabulary, skip: bool = True) -> list[list[tuple[int, int, str]]]:
    """Spans (begin, end, type) of each text, in order and apart."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    tokens = tokenise(texts, vocabulary)
    if not len(tokens.ids):
        return out
    f, best, _ = labels_of(tokens, vocabulary, skip)
    for d, b, e, kind in _written(texts, tokens, f, best):
        if not any(x < e and b < y for x, y, _ in out[d]):
            out[d].append((b, e, kind))
    for d, b, e in _names(texts, tokens, f, best):
        if not any(x < e and b < y for x, y, _ in out[d]):
            out[d].append((b, e, "name"))
    for spans in out:
        spans.sort()
    return out


# --- fitting -----------------------------------------------------------------------------------------------------------------


def _fit_grams(positive: list[str], negative: list[str]) -> tuple[np.ndarray, float]:
    words = positive + negative
    x = np.zeros((len(words), GRAMS), np.float32)
    for i, w in enumerate(words):
        ids = _gram_ids(w)
        np.add.at(x[i], ids, 1 / np.sqrt(max(1, len(ids))))
    y = np.array([1.0] * len(positive) + [0.0] * len(negative), np.float32)
    weight = np.where(y > 0, len(negative) / max(1, len(positive)), 1.0)
    weight = np.minimum(weight, 8) / len(words)
    w, b = np.zeros(GRAMS, np.float32), 0.0
    v, c = w.copy(), b
    for k in range(90):
        g = (weight * (1 / (1 + np.exp(-(x @ v + c))) - y)).astype(np.float32)
        nw, nb = v - 4.0 * (x.T @ g + 2e-4 * v), c - 4.0 * float(g.sum())
        v, c = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, float(b)


def _pseudo(texts: list[str], tokens: Tokens, vocabulary: Vocabulary) -> np.ndarray:
    """Labels from written forms, likely family names and likely given names beside them."""
    model = vocabulary.model
    y = np.zeros(len(tokens.ids), int)
    spelt = {i: t.strip() or t for t, i in vocabulary.items()}
    known: dict[int, tuple[bool, bool]] = {}

    def parts(i: int) -> tuple[bool, bool]:
        """May be a family name, may be a given name."""
        k = int(tokens.ids[i])
        if k not in known:
            t = spelt[k]
            word = t[0].isalpha()
            known[k] = (word and model.family(t) > 0, word and (model.given(_fold(t)) or 0.0) > 0)
        return known[k]

    bounds = np.concatenate([[0], np.flatnonzero(np.diff(tokens.line)) + 1, [len(y)]]) if len(y) else np.zeros(1, int)
    for lo, hi in zip(bounds, bounds[1:]):
        lo, hi = int(lo), int(hi)
        i = lo
        while i < hi:
            if not parts(i)[0]:
                i += 1
                continue
            j = i
            while j + 2 < hi and spelt[tokens.ids[j + 1]] == "-" and parts(j + 2)[0]:
                j += 2
            lab = {}
            a = i - 1
            while a >= lo + 1 and spelt[tokens.ids[a]] == "." and len(spelt[tokens.ids[a - 1]]) == 1 and spelt[tokens.ids[a - 1]].isalpha():
                lab[a], lab[a - 1] = I, I
                a -= 2
            if a >= lo and parts(a)[1] and not parts(a)[0]:
                lab[a] = G
            elif j + 2 < hi and spelt[tokens.ids[j + 1]] == "," and parts(j + 2)[1] and not lab:
                lab |= {j + 1: C, j + 2: G}
            if lab and not tokens.wide[i : j + 1].any():
                for p in range(i, j + 1):
                    y[p] = H if spelt[tokens.ids[p]] == "-" else N
                for p, v in lab.items():
                    y[p] = v
            i = j + 1
    # A family name that stands alone later in a text that has the full name keeps its label.
    link = vocabulary.arrays()[6][tokens.ids]
    full = {(int(tokens.doc[p]), int(link[p])) for p in np.flatnonzero(y == N)}
    for p in np.flatnonzero((y == O) & (link >= 0)):
        if (int(tokens.doc[p]), int(link[p])) in full and spelt[tokens.ids[p]][0].isupper():
            y[p] = N
    begin_of = np.searchsorted(tokens.doc, np.arange(len(texts)))
    end_of = np.searchsorted(tokens.doc, np.arange(len(texts)), "right")
    for d, t in enumerate(texts):
        for b, e, kind in forms(t):
            lo, hi = begin_of[d], end_of[d]
            a, z = lo + np.searchsorted(tokens.end[lo:hi], b, "right"), lo + np.searchsorted(tokens.begin[lo:hi], e)
            y[a:z] = FORMS[kind] + 1
            if a < z:
                y[a] = FORMS[kind]
    return y


def _likelihood(model: Model, tokens: Tokens, windows: np.ndarray, y: np.ndarray, sight: list[tuple[np.ndarray, np.ndarray]], blind: np.ndarray, steps: int, rate: float) -> None:
    """Weights by maximum likelihood of the windows (Adam, L2). sight: class and features by spelling, in full and without family names."""
    at = np.concatenate([np.arange(a, b) for a, b in windows])
    unseen = np.repeat(blind, windows[:, 1] - windows[:, 0])
    kl = np.where(unseen, sight[1][0][tokens.ids[at]], sight[0][0][tokens.ids[at]])
    x = np.where(unseen[:, None], sight[1][1][tokens.ids[at]], sight[0][1][tokens.ids[at]]).astype(np.float32)
    views = [np.where(unseen, b, a) for a, b in zip(_windows(tokens, sight[0][0][tokens.ids], at), _windows(tokens, sight[1][0][tokens.ids], at), strict=True)]
    orders = [np.argsort(v, kind="stable") for v in views]
    starts = [np.flatnonzero(np.concatenate([[True], np.diff(v[o]) != 0])) for v, o in zip(views, orders, strict=True)]
    gap, want = tokens.gap[at], np.eye(K, dtype=np.float32)[y[at]]
    size = windows[:, 1] - windows[:, 0]
    ends = np.cumsum(size)
    groups = list(_groups(np.stack([ends - size, ends], axis=1)))
    own, around, move = (p.astype(np.float32) for p in (model.own, model.around, model.move))
    params = [own, around, move]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = len(at)
    want_move = np.zeros((2, K, K), np.float32)
    follows = np.ones(n, bool)
    follows[ends[:-1]] = False
    follows[0] = False
    nxt = np.flatnonzero(follows)
    one = np.ones((K, 1), np.float32)
    np.add.at(want_move, (gap[nxt].astype(int), y[at[nxt - 1]], y[at[nxt]]), 1)
    for s in range(1, steps + 1):
        u = x @ own + ALLOWED[kl]
        for o, v in enumerate(views):
            u += around[o][v]
        moves = move + _FOLLOWS
        a = np.exp(moves)
        post = np.zeros((n, K), np.float32)
        pair = np.zeros_like(move)
        for g, on in groups:
            m = np.where(on[:, :, None], u[g], 0)
            p, fwd, bwd = _passes(m, gap[g], on, moves)
            q = fwd * p * bwd
            post[g[on]] = (q / (q @ one))[on]
            for k in (0, 1):
                i, j = np.nonzero(on[1:] & (gap[g[1:]] == k))
                left, right = fwd[i, j] * p[i, j], p[i + 1, j] * bwd[i + 1, j]
                z = ((left @ a[k]) * right) @ one
                pair[k] += ((left / np.maximum(z, 1e-30)).T @ right) * a[k]
        rest = (post - want) / n
        grads = [x.T @ rest + 1e-5 * own, 3e-6 * around, (pair - want_move) / n + 1e-5 * move]
        for o, (order, start) in enumerate(zip(orders, starts, strict=True)):
            grads[1][o][views[o][order[start]]] += np.add.reduceat(rest[order], start)
        for p, g, m1, m2 in zip(params, grads, first, second, strict=True):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            p -= rate * (1.1 - s / steps) * (m1 / (1 - 0.9**s)) / (np.sqrt(m2 / (1 - 0.99**s)) + 1e-8)
    model.own, model.around, model.move = own, around, move


def _fit_skip(model: Model, f: Field, y: np.ndarray, steps: int = 60) -> None:
    """Skip potentials of given and family names by the likelihood of linked pairs, given the beliefs of their chains."""
    if not len(f.links):
        return
    b = beliefs(f.unary, f.gap, f.chains, f.links[:0], model.move + _FOLLOWS, model.skip)
    p = np.exp(b - b.max(axis=1, keepdims=True)).astype(float)
    p /= p.sum(axis=1, keepdims=True)
    one, two = f.links[:, 0], f.links[:, 1]
    equal = p[one] * p[two]
    shared = np.zeros(K)
    shared[[G, N]] = 1
    have = np.array([((y[one] == v) & (y[two] == v)).sum() for v in range(K)]) * shared
    for _ in range(steps):
        w = equal * np.exp(model.skip)
        z = 1 + (w - equal).sum(axis=1, keepdims=True)
        model.skip = np.clip(model.skip + (have - (w / z).sum(axis=0) * shared - 0.5 * model.skip) / np.maximum(have, 10) * shared, -3, 6)


def _recased(texts: list[str], model: Model, most: int = 200) -> list[str]:
    """Lines with words like family names in capitals and in small letters: names in every case take part in the fit."""
    lines = []
    family: dict[str, bool] = {}
    for t in texts:
        for line in t.splitlines():
            words = _WORD.findall(line)
            for w in words:
                if w not in family:
                    family[w] = model.family(w) > 0
            if any(family[w] for w in words):
                lines.append(line)
        if len(lines) >= most:
            break
    return [c for line in lines[:most] for c in (line.upper(), line.lower())]


def _fit_weights(model: Model, texts: list[str]) -> Vocabulary:
    """The weights of the field, from the labels that the other parts of the model give to the texts."""
    vocabulary, unsighted = Vocabulary(model), Vocabulary(model, blind=True)
    texts = [*texts, *_recased(texts, model)]
    tokens = tokenise(texts, vocabulary)
    if not len(tokens.ids):
        return vocabulary
    for t in vocabulary:  # the same numbers in both
        unsighted[t]
    y = _pseudo(texts, tokens, vocabulary)
    sight = [(v.arrays()[3], v.arrays()[8]) for v in (vocabulary, unsighted)]
    f = evidence(tokens, vocabulary)
    in_field = np.zeros(len(y), bool)
    in_field[f.at] = True
    y[~in_field] = O
    chosen = np.zeros(len(y), bool)
    goals = y != O

    def windows(marked: np.ndarray, around: int = 3) -> np.ndarray:
        near = marked.copy()
        for k in range(1, around + 1):
            same = tokens.line[k:] == tokens.line[:-k]
            near[k:] |= marked[:-k] & same
            near[:-k] |= marked[k:] & same
        near &= in_field
        number = np.flatnonzero(near)
        cut = np.concatenate([[True], (np.diff(number) != 1) | (tokens.line[number[1:]] != tokens.line[number[:-1]])])
        begin = np.flatnonzero(cut)
        return np.stack([number[begin], number[np.append(begin[1:], len(number)) - 1] + 1], axis=1)

    order = np.random.default_rng(0).permutation(len(y))
    # Labelled tokens first, then others by hash; then twice those that the field gets wrong.
    budget = FIT_TOKENS
    pos = order[goals[order]]
    chosen[pos[: budget // 6]] = True
    neg = order[(in_field & ~goals)[order]]
    chosen[neg[: budget // 30]] = True
    for r, (steps, rate) in enumerate(((45, 0.25), (35, 0.12), (35, 0.08))):
        w = windows(chosen)
        if not len(w):
            break
        # Family names are hidden from some windows, so that given names and capitals beside them are learnt too.
        named = np.add.reduceat(np.append(np.isin(y, (G, N)), False).astype(int), w.reshape(-1))[::2] > 0
        blind = w[:, 0] * 2654435761 % (1 << 32) < np.where(named, 0.35, 0.15) * (1 << 32)
        _likelihood(model, tokens, w, y, sight, blind, steps, rate)
        if r < 2:
            f = evidence(tokens, vocabulary)
            best = beliefs(f.unary, f.gap, f.chains, f.links[:0], model.move + _FOLLOWS, model.skip).argmax(axis=1)
            wrong = f.at[best != y[f.at]]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            chosen[wrong[np.argsort(rank[wrong])][: budget // 24]] = True
    _fit_skip(model, f := evidence(tokens, vocabulary), y[f.at])
    return Vocabulary(model)


#: Patterns that show every type of written form, and what only looks like one, to fits on texts that may lack them: %3 stands for
#: three digits, %w and %W for words, %U for a capital, %n for a house number.
_SHOWN = {
    "email": ["%w@%w.example", "a.%w+b@%w.example", "%w.c@%w.org", "d.e+f@%w.test", "%w.%w@%w-%w.org", "%w-%w+%w@%w.%w.test", "%w%2@%w.com", "%w_%w@%w.example", "%w [at] %w [dot] example", "%w-%w (at) %w.example", "%w AT %w DOT org", "%w at %w-%w-%w dot example", "%w [at] %w.%w.test"],
    "phone": ["+%2 %2 %4 %4", "(%3) %3-%4", "%3-%3-%4", "%3.%3.%4", "%3 %3 %4", "0%3 %3 %3", "0%2 %4 %4", "+%1-%3-%3-%4", "+%2 (0)%2 %5 %3", "0%3/%7", "+%11", "+%2 %1 %2 %2 %2 %2", "(%3) %3 %4"],
    "id_number": ["%3-%2-%4", "%3 %2 %4", "%U%U %2 %2 %2 A", "%U%U%6B", "%U%U%7", "%8-%U"],
    "address": ["%n %W Street", "%n%U %W %W Lane", "%n St. %W's Close", "%n Lower %W", "%n Great %W", "%n bis rue des %W", "%n, rue de la %W", "%n quai des %W %W", "Calle %W %n", "Avenida de los %W %n", "Plaza del %W %n", "%Wstraße %n", "Alte %Wstr. %nb", "Am %W %n", "Zum %W %n", "%n %W ROAD", "%n %W %W Boulevard", "%n old %w road"],
    "": ["version %1.%1.%2", "%4-%2-%2T%2:%2:%2Z", "build %2.%2.%3.%2 took %2 s", "git@%w.example:%w/%w.git", "ssh://git@%w.example/%w", "#%4", "%w@%1.%1.%2", "run %6-%2-%3", "REF-%2-%2-%3", "%3 rows in %1 %W Rows", "host 192.0.2.%2:%4", "commit %2a%3b", "%2 of %4 %W", "%3-%2-%5", "at %2:%2 on %1 %W %4"],
}
_FRAMES = ["{}", "Call {} now", "mail {}.", "to {}, then %2 %w", "({})", "no. {};%w", "at {}, %W %4", "%w: {}", "%w %w {} %w %w", "Unit %1, {}, %W %4", "%W %w {} - %w", "{} %W %w %w", "|{}|%4|", "fax {};ext=%2"]


def examples(each: int = 12) -> list[str]:
    """Lines after _SHOWN, the same ones at every call."""
    rng = np.random.default_rng(11)

    def word() -> str:
        return "".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(int(rng.integers(2, 5))))

    def fill(m: re.Match) -> str:
        other = {"w": word, "W": lambda: word().title(), "U": lambda: str(rng.choice(list("ABCDXY"))), "n": lambda: str(int(rng.integers(1, 2000)))}
        return other[m[1]]() if m[1] in other else "".join(map(str, rng.integers(0, 10, int(m[1]))))

    return [re.sub(r"%(\d+|[wWUn])", fill, str(f).format(p)) for patterns in _SHOWN.values() for p in patterns for f in rng.choice(_FRAMES, each)]


def _beside(texts: list[str | None], vocabulary: Vocabulary) -> tuple[Counter, Counter]:
    """How often each case-folded word stands beside a word like a family name, and its occurrences, over the texts."""
    tokens = tokenise(texts, vocabulary)
    if not len(tokens.ids):
        return Counter(), Counter()
    length, lead, _, klass, *_, x = vocabulary.arrays()
    long, fam = (length - lead)[tokens.ids] > 1, (x[:, 4] > 0)[tokens.ids]
    word = (x[:, 1:4].any(axis=1) | _LETTERS[klass])[tokens.ids] & long & ~fam
    upper = (x[:, 1:3].any(axis=1))[tokens.ids]
    comma, dot = klass[tokens.ids] == _CLASS[","], klass[tokens.ids] == _CLASS["."]
    n = len(tokens.ids)

    def at(flags: np.ndarray, o: int) -> np.ndarray:
        """The flag of the token ``o`` further in the same line."""
        out = np.zeros(n, bool)
        if o > 0:
            out[:-o] = flags[o:] & (tokens.line[o:] == tokens.line[:-o])
        else:
            out[-o:] = flags[:o] & (tokens.line[:o] == tokens.line[-o:])
        return out

    three = at(np.ones(n, bool), 3)
    # The name may as well begin with the next token: such words count neither way.
    open_ = word & three & ((at(fam, 1) & at(comma, 2)) | (at(~long, 1) & at(dot, 2) & at(fam, 3)))
    beside = word & ~open_ & (at(fam, 1) | (at(comma, -1) & at(fam, -2) & np.where(upper, at(upper, -2), at(~upper, -2))))
    size = len(vocabulary)
    near, total = (np.bincount(tokens.ids[f], minlength=size) for f in (beside, word & ~open_))
    counts = Counter(), Counter()
    for t, i in vocabulary.items():
        for c, k in zip(counts, (near[i], total[i]), strict=True):
            if k:
                c[_fold(t.lstrip(" "))] += int(k)
    return counts


def _other_words(types: list[str]) -> list[str]:
    """Evenly from all of the sorted words, short and longer ones apart."""
    return [w for group in ([w for w in types if len(w) >= 4], [w for w in types if len(w) < 4]) for w in group[:: max(1, len(group) // OTHER_WORDS)]]


def _character_model(names: Names, fam: list[str], words_else: list[str], plain: frozenset[str] = frozenset()) -> Model:
    """A model that knows words like family names only. plain: words that are none, whatever they look like."""
    model = Model(np.zeros(GRAMS, np.float32), -9.0, names, Words.none())
    if not fam:
        return model
    # Words that look like names although no list has them are no examples of other words: each half of the words is
    # judged by a model that has not seen it.
    keep = []
    for half in (0, 1):
        model.grams, model.bias = _fit_grams(fam, words_else[1 - half :: 2])
        keep += [w for w in words_else[half::2] if model.family(w) < 0 or names.has("given", w) or w in plain]
    model.grams, model.bias = _fit_grams(fam, keep or words_else)
    return model


class _Folds(dict):
    def __missing__(self, word: str) -> str:
        self[word] = f = _fold(word)
        return f


def _counted(texts: Iterable[str | None]) -> tuple[Counter, Counter]:
    """In how many texts each case-folded word stands, and stands in small letters."""
    n, small, folds = Counter(), Counter(), _Folds()
    for t in texts:
        written = set((_ASCII_WORD if t.isascii() else _WORD).findall(t)) if t else ()
        n.update({folds[w] for w in written})
        small.update({folds[w] for w in written if w.islower()})
    return n, small


def fit(texts: list[str], family: list[str], given: list[str]) -> Vocabulary:
    """The model from texts at hand and known parts of names, with what it knows of spellings."""
    fam, giv = sorted({_fold(w) for w in family if w}), {_fold(w) for w in given if w}
    n, small = _counted(texts)
    model = _character_model(Names.of(fam, giv), fam, _other_words(sorted(set(n) - set(fam))))
    beside, total = _beside(texts, Vocabulary(model))
    words = sorted(n.keys() | total.keys())
    sums = np.zeros((4, BUCKETS))
    at = np.array([bucket(w) for w in words], np.int64)
    for i, c in enumerate((beside, total, n, small)):
        np.add.at(sums[i], at, [c[w] for w in words])
    at = np.unique(at)
    model.words = Words.of(at, *sums[:, at])
    return _fit_weights(model, [*examples(), *(t for t in texts if t)])


def word_counts(documents: DataFrame, known: Names) -> DataFrame:
    """word (case-folded), bucket, family (a known family name), n, small: in how many texts each word stands, and stands in small letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, small = _counted(b.column("text").to_pylist())
            columns = [pa.array(list(n), pa.string()), pa.array([bucket(w) for w in n], pa.int32()), pa.array([known.has("family", w) for w in n], pa.bool_()), *(pa.array([c[w] for w in n], pa.int64()) for c in (n, small))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "bucket", "family", "n", "small"])

    counts = spread(documents.select("text")).mapInArrow(run, "word string, bucket int, family boolean, n long, small long")
    return counts.groupBy("word", "bucket", "family").agg(F.sum("n").alias("n"), F.sum("small").alias("small"))


def given_counts(documents: DataFrame, model: Model) -> DataFrame:
    """bucket (of words), beside, total over all texts, as _beside counts them."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for whole in batches:
            beside, total = Counter(), Counter()
            for b in _blocks(whole):
                if len(vocabulary) > _KEPT:
                    vocabulary = Vocabulary(shared.value)
                for c, more in zip((beside, total), _beside(b.column("text").to_pylist(), vocabulary), strict=True):
                    c.update(more)
            columns = [[bucket(w) for w in total], [beside[w] for w in total], list(total.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bucket", "beside", "total"])

    counts = spread(documents.select("text")).mapInArrow(run, "bucket long, beside long, total long")
    return counts.groupBy("bucket").agg(F.sum("beside").alias("beside"), F.sum("total").alias("total"))


def _known_names(known_names: DataFrame) -> tuple[Names, list[str]]:
    """All known parts of names as hashes, and the family names for the character model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folded = [_fold(w) for w in b.column("w").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_key(w) for w in folded], pa.int64()), pa.array(folded, pa.string()), b.column("t")], names=["key", "w", "t"])

    names = known_names.select(F.trim("name_part").alias("w"), F.lower(F.trim("part_type")).alias("t")).filter("w is not null and w <> '' and t in ('family', 'given')")
    names = names.mapInArrow(run, "key long, w string, t string").distinct()
    if names.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} known names")
    got = names.select("key", (F.col("t") == "family").alias("family")).toArrow()
    keys, is_family = got.column("key").to_numpy(), got.column("family").to_numpy(zero_copy_only=False).astype(bool)
    fam = [r["w"] for r in names.filter("t = 'family'").select("w").distinct().orderBy(F.xxhash64("w"), "w").limit(FIT_NAMES).collect()]
    return Names(keys[is_family], keys[~is_family]), sorted(fam)


def fitted(documents: DataFrame, known_names: DataFrame) -> Model:
    """Words and their neighbours are counted over all documents; only the weights are fitted on samples."""
    names, fam = _known_names(known_names)
    words = write_table(word_counts(documents, names), "words")
    by_hash = [F.xxhash64("word"), F.col("word")]
    others: dict[str, bool] = {}
    if fam:
        for c in (F.length("word") >= 4, F.length("word") < 4):
            for o in ([F.desc("n"), *by_hash], by_hash):
                part = words.filter(c & ~F.col("family")).orderBy(*o).limit(OTHER_WORDS).select("word", (F.expr("n >= 20 and small >= 0.9 * n")).alias("plain"))
                others |= {r["word"]: r["plain"] for r in part.collect()}
    model = _character_model(names, fam, sorted(others, key=lambda w: (len(w) < 4, w)), frozenset(w for w, plain in others.items() if plain))
    counts = words.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("small").alias("small"))
    if fam:
        counts = counts.join(given_counts(documents, model), "bucket", "left")
    else:
        counts = counts.withColumns({"beside": F.lit(0), "total": F.lit(0)})
    got = counts.fillna(0, ["beside", "total"]).select("bucket", *[F.col(c).cast("double").alias(c) for c in ("beside", "total", "n", "small")]).toArrow()  # at most BUCKETS rows
    model.words = Words.of(*(got.column(c).to_numpy() for c in ("bucket", "beside", "total", "n", "small")))
    sample = documents.filter(F.length("text") > 0).select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    _fit_weights(model, [*examples(), *sample.toArrow().column("text").to_pylist()])
    return model


# --- on tables -----------------------------------------------------------------------------------------------------------------


def _blocks(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    from graphloom.llm.bpe import _slices

    yield from _slices(batch, "text", most)


def _each(documents: DataFrame, known_names: DataFrame, row, schema: str) -> DataFrame:
    """row(block, spans by text) over all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(fitted(documents, known_names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for whole in batches:
            for b in _blocks(whole):
                if len(vocabulary) > _KEPT:
                    vocabulary = Vocabulary(shared.value)
                yield row(b, pieces(b.column("text").to_pylist(), vocabulary))

    return spread(documents.select("doc_id", "text")).mapInArrow(run, schema)


def found(documents: DataFrame, known_names: DataFrame) -> DataFrame:
    """doc_id, pii_type, pii_text: each distinct piece of each document."""

    def rows(b: pa.RecordBatch, spans: list[list[tuple[int, int, str]]]) -> pa.RecordBatch:
        got = dict.fromkeys((d, kind, t[x:y]) for d, t, ss in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), spans, strict=True) for x, y, kind in ss)
        d, k, t = zip(*got, strict=True) if got else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.string()), pa.array(t, pa.string())], names=["doc_id", "pii_type", "pii_text"])

    return _each(documents, known_names, rows, "doc_id long, pii_type string, pii_text string").distinct()


def masked(documents: DataFrame, known_names: DataFrame) -> DataFrame:
    """doc_id, text with every piece replaced by its type in brackets; n_pieces."""

    def rows(b: pa.RecordBatch, spans: list[list[tuple[int, int, str]]]) -> pa.RecordBatch:
        out = []
        for t, ss in zip(b.column("text").to_pylist(), spans, strict=True):
            parts, at = [], 0
            for x, y, kind in ss:
                if x >= at:
                    parts += [t[at:x], f"[{kind.upper()}]"]
                    at = y
            out.append(t if t is None else "".join([*parts, t[at:]]))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), pa.array([len(s) for s in spans], pa.int32())], names=["doc_id", "text", "n_pieces"])

    return _each(documents, known_names, rows, "doc_id long, text string, n_pieces int")
