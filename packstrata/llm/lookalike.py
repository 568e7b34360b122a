"""One consistent form of texts that look the same but differ in characters."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packstrata.functions.arrow import slices
from packstrata.operators.skew import hot_keys, skew_join
from packstrata.session import Scratch, ship

# Letters that fonts draw alike. Each line lists a shape in Latin, Cyrillic, Greek and Armenian; '-'
# where the script has no such letter. Case is a visible difference, so capital and small shapes are apart.
# Unicode's own list of look-alikes (``unicode_shapes``) is wider, but does not tell these from mere resemblance.
SCRIPTS = ("latin", "cyrillic", "greek", "armenian")
SHAPES = """
A А Α -
B В Β -
C С Ϲ -
E Е Ε -
F - Ϝ -
G Ԍ - -
H Н Η -
I І Ι -
J Ј Ϳ -
K К Κ -
M М Μ -
N - Ν -
O О Ο Օ
P Р Ρ -
Q Ԛ - -
S Ѕ - Տ
T Т Τ -
U - - Ս
V Ѵ - -
W Ԝ - -
X Х Χ -
Y Ү Υ -
Z - Ζ -
a а - -
c с ϲ -
d ԁ - -
e е - -
g - - ց
h һ - հ
i і - -
j ј ϳ -
l ӏ - -
n - - ո
o о ο օ
p р ρ -
q ԛ - զ
s ѕ - -
u - - ս
v ѵ ν -
w ԝ - -
x х - -
y у - -
- Г Γ -
- П Π -
- Ф Φ -
"""
#: Second letters of a shape within a script, and a letter that belongs to none.
TWINS = {"ɡ": "g", "Ӏ": "I", "µ": "μ"}

# Blanks of any width or breaking kind, and code points that show nothing (Default_Ignorable_Code_Point).
BLANKS = (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
UNSEEN = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
    (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


def _fold_table() -> dict[int, int | str | None]:
    """Full- and half-width forms to ordinary ones, blanks to the blank, ignorable characters to nothing."""
    table: dict[int, int | str | None] = {}
    for cp in range(0x3000, 0x10000):
        kind, _, rest = unicodedata.decomposition(chr(cp)).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            table[cp] = "".join(chr(int(x, 16)) for x in rest.split())
    for a, b in UNSEEN:
        table.update(dict.fromkeys(range(a, b + 1)))
    return table | dict.fromkeys(BLANKS, " ")


_ROWS = [line.split() for line in SHAPES.strip().splitlines()]
#: shape, named by its first letter: letter by script
LATTICE: dict[str, dict[str, str]] = {}
for _row in _ROWS:
    _own = {s: c for s, c in zip(SCRIPTS, _row, strict=True) if c != "-"}
    LATTICE[next(iter(_own.values()))] = _own
_FOLD = _fold_table()
_SHAPE = {ord(c): name for name, own in LATTICE.items() for c in own.values() if c != name} | {ord(a): b for a, b in TWINS.items()}
# a search for the few characters that change is far cheaper than a translation of them all
_FOLDS = {chr(k): v or "" for k, v in _FOLD.items() if k != 0x20}
_SHAPES = {chr(k): v for k, v in _SHAPE.items()}
_FOLDED = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in UNSEEN) + "".join(re.escape(c) for c in _FOLDS if not any(a <= ord(c) <= b for a, b in UNSEEN)) + "]")
_SHAPED = re.compile("[" + "".join(_SHAPES) + "]")
_MARK = "\u0300-\u036f"
_TOKEN = re.compile(f"(?:[^\\W\\d_]|[{_MARK}])+")
#: letters of the rows above in any script: they say nothing about the script of a text
_SHARED = frozenset(c for own in LATTICE.values() for c in own.values()) | set(TWINS)

#: What a change of script inside a token costs, in nats; and a letter that only resembles the one written.
SWITCH = AWAY = 12.0


@lru_cache(maxsize=1 << 16)
def script_of(c: str) -> str:
    """The script in a letter's Unicode name ('LATIN SMALL LETTER A'), lower case; 'other' of what is not so named."""
    first, letter, _ = unicodedata.name(c, "").partition(" LETTER ")
    return first.split()[0].lower() if letter else "other"


def _case(c: str) -> str:
    """'u' or 'l'; '' of a letter without case, which may look like either."""
    return {"Lu": "u", "Lt": "u", "Ll": "l"}.get(unicodedata.category(c), "")


Options = dict[str, tuple[tuple[str, str, float], ...]]


def lattice_of(skeletons: dict[str, str]) -> Options:
    """How each letter may be read: (script, letter, cost) by the letter written, itself first.

    ``skeletons`` maps letters to Unicode's prototype of their look. Letters of
    other scripts with that prototype are readings at AWAY nats, unless both
    have a case and it differs; those that share a row of SHAPES cost nothing.
    Letters of one script are never read as one another, so this relation is
    no equivalence: two Cyrillic letters may both resemble one Latin letter,
    and which of them is meant there is for the search to say.
    """
    alike: dict[str, list[str]] = {}
    for c, bone in skeletons.items():
        if len(bone) == 1 and script_of(c) != "other" and unicodedata.category(c) in ("Lu", "Lt", "Ll", "Lo") and not unicodedata.decomposition(c):
            alike.setdefault(bone, []).append(c)
    out: dict[str, dict[str, float]] = {}
    for letters in alike.values():
        for c in letters:
            for x in letters:
                if script_of(x) != script_of(c) and (_case(c) == _case(x) or not _case(c) or not _case(x)):
                    out.setdefault(c, {})[x] = AWAY
    for own in LATTICE.values():
        for c in own.values():
            out.setdefault(c, {}).update({x: 0.0 for x in own.values() if x != c})
    for c, x in TWINS.items():
        out[c] = {k: 0.0 for k in (x, *(LATTICE[x].values() if x in LATTICE else ()))} | {k: v for k, v in out.get(c, {}).items() if v}
    order = lambda kv: (kv[1], kv[0])
    return {c: (*([] if c in TWINS else [(script_of(c), c, 0.0)]), *((script_of(x), x, w) for x, w in sorted(near.items(), key=order))) for c, near in out.items()}


def unicode_shapes(spark: SparkSession) -> dict[str, str]:
    """Every letter's prototype in Unicode's list of confusable characters, from the ICU library that Spark brings along; one call."""
    letters = [chr(c) for c in range(0x41, 0x20000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lo") and script_of(chr(c)) != "other"]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    bones = checker.getSkeleton("\n".join(letters)).split("\n")
    if len(bones) != len(letters):
        raise ValueError("the skeleton of a list of letters must have an entry for each")
    return dict(zip(letters, bones, strict=True))


def folded(text: str) -> str:
    """Width forms and blanks made ordinary, unseen characters dropped, accents decomposed."""
    return text if text.isascii() else unicodedata.normalize("NFD", _FOLDED.sub(lambda m: _FOLDS[m.group()], text))


def skeleton(text: str) -> str:
    """``folded`` with each letter named by its row of SHAPES: what a comparison without a search would compare."""
    return _SHAPED.sub(lambda m: _SHAPES[m.group()], folded(text))


class Ngrams:
    """Smoothed log probabilities of a letter after another, from corpus counts of (first, second, n); 0 is a token's start."""

    def __init__(self, counts: list[tuple[int, int, int]]):
        self.pair = {(a, b): n for a, b, n in counts}
        self.after: Counter[int] = Counter()
        for a, _, n in counts:
            self.after[a] += n
        self.letters = max(1, len({b for _, b, _ in counts}))

    def cost(self, a: int, b: int) -> float:
        return -math.log((self.pair.get((a, b), 0) + 0.1) / (self.after.get(a, 0) + 0.1 * self.letters))


class Former:
    """Brings texts to one form: every token as its likeliest reading.

    A token's lattice has the readings of each of its letters. A token that
    can be read wholly in the script of the text, by letters drawn alike, is
    read in it, so its lattice has that script's letters only; else all
    scripts take part. A lattice with one path needs no search.
    """

    def __init__(self, ngrams: Ngrams, options: Options | None = None):
        self.ngrams, self.options = ngrams, lattice_of({}) if options is None else options
        self.known: dict[tuple[str, str], str] = {}
        self.odd = frozenset(c for c in self.options if script_of(c) != "latin" or c in TWINS)
        self.latin = re.compile(f"[{''.join(chr(c) for c in range(0x41, 0x250) if script_of(chr(c)) == 'latin' and chr(c) not in _SHARED)}]")

    def form(self, text: str) -> str:
        bones = folded(text)
        # in a Latin text without letters of other scripts every lattice is one path
        if not ((text.isascii() or self.odd.isdisjoint(set(bones))) and self.latin.search(bones)):
            script = self._script(bones)
            bones = _TOKEN.sub(lambda m: self._token(m.group(), script), bones)
        return bones if bones.isascii() else unicodedata.normalize("NFC", bones)

    @staticmethod
    def _script(bones: str) -> str:
        """The script of most letters that no other script draws alike; '' if there are none."""
        n: Counter[str] = Counter()
        for c, k in Counter(bones).items():
            if c.isalpha() and c not in _SHARED and (s := script_of(c)) != "other":
                n[s] += k
        return min(n, key=lambda s: (-n[s], s)) if n else ""

    def _token(self, token: str, script: str) -> str:
        key = (token, script)
        if key not in self.known:
            if len(self.known) > 1 << 18:
                self.known.clear()
            self.known[key] = self._search(token, script)
        return self.known[key]

    def _search(self, token: str, script: str) -> str:
        """Viterbi over the token's lattice.

        A path costs what its letters cost to be read so, their n-gram costs
        within a script, and SWITCH for each change of script; a path that
        begins in the script of the text costs a nat less. Ties go to the
        script, then the letter, that comes first.
        """
        letters = [c for c in token if not "\u0300" <= c <= "\u036f"]
        lattice = [self.options.get(c) or ((script_of(c), c, 0.0),) for c in letters]
        if script and all(any(s == script and w == 0 for s, _, w in row) for row in lattice):
            lattice = [tuple(x for x in row if x[0] == script) for row in lattice]
        if all(len(row) == 1 for row in lattice):
            chosen = [row[0][1] for row in lattice]
        else:
            states: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for row in lattice:
                now: dict[tuple[str, str], tuple[float, tuple | None]] = {}
                for s, letter, away in row:
                    start = self.ngrams.cost(0, ord(letter))
                    if not states:
                        now[s, letter] = (start + away - (1.0 if s == script else 0.0), (letter, None))
                        continue
                    cost, was = min((cost + (self.ngrams.cost(ord(a), ord(letter)) if t == s else SWITCH + start), (t, a)) for (t, a), (cost, _) in states.items())
                    now[s, letter] = (cost + away, (letter, states[was][1]))
                states = now
            back = min((cost, at) for at, (cost, _) in states.items())
            chain, chosen = states[back[1]][1], []
            while chain:
                chosen.append(chain[0])
                chain = chain[1]
            chosen.reverse()
        read = iter(chosen)
        return "".join(c if "\u0300" <= c <= "\u036f" else next(read) for c in token)


# each letter as its base letter, a number below _LETTERS; 0 is whatever is no letter of a named script
_BASE = np.zeros(0x20000, np.int32)
for _cp in range(0x41, 0x20000):
    _first = unicodedata.normalize("NFD", chr(_cp))[0]
    if unicodedata.category(_first)[0] == "L" and script_of(_first) != "other":
        _BASE[_cp] = ord(_first)
_CODES, _BASE = np.unique(_BASE, return_inverse=True)
_BASE = np.append(_BASE, 0)  # what lies beyond
_LETTERS = len(_CODES)
#: Pairs are held up to this number before they are added up: a bound on what a task holds.
_PENDING = 1 << 22
#: Letters below this place, those of ASCII among them, are counted in a table of their own.
_COMMON = 64


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, second, n) of letter pairs, added up over several batches at a time."""
    common, pending, size = np.zeros(_COMMON * _COMMON, np.int64), [], 0

    def told(pair: np.ndarray, n: np.ndarray, width: int) -> pa.RecordBatch:
        keep = (pair % width > 0) & (n > 0)
        a, b = _CODES[pair[keep] // width], _CODES[pair[keep] % width]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n[keep])], names=["a", "b", "n"])

    for batch in slices(batches, 0):
        text = "\n".join(t for t in batch.column(0).to_pylist() if t)
        codes = _BASE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x20000)].astype(np.int32)
        if not len(codes):
            continue
        before = np.concatenate([np.zeros(1, np.int32), codes[:-1]])
        rare = (before >= _COMMON) | (codes >= _COMMON)
        common += np.bincount((before * _COMMON + codes)[~rare], minlength=_COMMON * _COMMON)
        pending.append(before[rare] * np.int32(_LETTERS) + codes[rare])
        size += len(pending[-1])
        if size > _PENDING:
            yield told(*np.unique(np.concatenate(pending), return_counts=True), _LETTERS)
            pending, size = [], 0
    if size:
        yield told(*np.unique(np.concatenate(pending), return_counts=True), _LETTERS)
    if common.any():
        yield told(np.arange(len(common)), common, _COMMON)


def ngram_counts(documents: DataFrame, text: str = "text") -> Ngrams:
    """Letter pairs of all texts. Collected: pairs of letters of alphabets and syllabaries, a number that Unicode bounds, not the corpus."""
    ship(documents.sparkSession)
    pairs = documents.select(F.col(text).cast("string").alias("t")).mapInArrow(_count, "a long, b long, n long")
    return Ngrams([tuple(r) for r in pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()])


def _digest(x: str) -> bytes:
    return blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _formed(batches: Iterator[pa.RecordBatch], ngrams: Ngrams, options: Options, digests: bool) -> Iterator[pa.RecordBatch]:
    former = Former(ngrams, options)
    for batch in slices(batches, 1):
        texts = batch.column(1).to_pylist()
        if digests:
            rows = [(i, *_digests(t, former.form(t))) for i, t in enumerate(texts) if t is not None]
            at, form, own = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(form, pa.binary()), pa.array(own, pa.binary())], names=["doc", "form", "own"])
        else:
            forms = [None if t is None else former.form(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=[batch.schema.names[0], "form"])


def _digests(text: str, form: str) -> tuple[bytes, bytes]:
    own = _digest(text)
    return own if form == text else _digest(form), own


def consistent_forms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``form``, the one consistent form of each text; null of a null text.

    Full- and half-width forms become ordinary ones, accents are composed,
    characters that show nothing are dropped, blanks of any kind become the
    blank, and each token is written as the likeliest reading of its letters.
    Compatibility forms that can be told apart by the eye (superscripts,
    fractions, ligatures, circled digits) stay as they are.
    """
    kind = documents.schema[key].dataType.simpleString()
    return _form_all(documents, F.col(key), text, False, f"{key} {kind}, form string")


def form_digests(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, form and own: 128-bit digests of a text's form and of its code points; null texts are left out."""
    return _form_all(documents, F.col(key).cast("long").alias("doc"), text, True, "doc long, form binary, own binary")


def _form_all(documents: DataFrame, key: Column, text: str, digests: bool, schema: str) -> DataFrame:
    ngrams, options = ngram_counts(documents, text), lattice_of(unicode_shapes(documents.sparkSession))
    return documents.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(lambda b: _formed(b, ngrams, options, digests), schema)


SALTS = 32
#: Texts of a form that one task pairs with the others of that form.
STRIPE = 1024


def _classes(documents: DataFrame, key: str, text: str, floor: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts (form, own, n documents) and documents (form, own, doc), each once, of the forms that several texts have."""
    scratch = Scratch(documents.sparkSession)
    digests, n = scratch.keep_counted(form_digests(documents, key, text), F.lit(1))  # 40 bytes a document, formed once
    several = digests.groupBy("form").agg((F.min("own") < F.max("own")).alias("_several")).where("_several").select("form")
    members = scratch.keep(skew_join(digests, several, ["form"], "left_semi", floor, n).distinct())
    return members.groupBy("form", "own").agg(F.count(F.lit(1)).alias("n")), members


def lookalike_classes(documents: DataFrame, key: str = "doc_id", text: str = "text", floor: int | None = None) -> DataFrame:
    """doc, class (its least document) and links (documents of other texts of that form) of every document that looks like another text."""
    texts, members = _classes(documents, key, text, floor)
    classes = members.groupBy("form").agg(F.count(F.lit(1)).alias("_all"), F.min("doc").alias("class"))
    told = texts.join(classes, "form").select("form", "own", "class", (F.col("_all") - F.col("n")).alias("links"))
    return skew_join(members, told, ["form", "own"], "inner", floor).select("doc", "class", "links")


def lookalike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text", floor: int | None = None) -> DataFrame:
    """doc_a, doc_b (doc_a < doc_b): documents whose texts differ but have one form.

    Texts, not documents, are paired within a form: a text's exact copies
    count once until the result is written out. So work follows the number of
    pairs returned, and a form that very many copies of one text share costs
    nothing. A form of very many texts is paired in stripes, each by its own
    task; copies of a text held by very many documents are salted.
    """
    texts, members = _classes(documents, key, text, floor)
    # big: the text of more copies
    texts = texts.join(texts.groupBy("form").agg(F.count(F.lit(1)).alias("k")), "form")
    stripes = F.ceil(F.col("k") / STRIPE).cast("long")
    a = texts.select("form", F.struct("n", "own").alias("x"), F.pmod(F.xxhash64("own"), stripes).alias("_stripe"))
    b = texts.select("form", F.struct("n", "own").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), stripes - 1)).alias("_stripe"))
    pairs = a.join(b, ["form", "_stripe"]).where("x > y").select("form", F.col("x.own").alias("big"), F.col("y.own").alias("small"))
    hot = hot_keys(members, ["own"], floor)
    wide = pairs.join(members.select(F.col("own").alias("small"), "form", F.col("doc").alias("d")), ["form", "small"]).select("form", "big", "d")
    if hot is None:
        wide = wide.join(members.select(F.col("own").alias("big"), "form", F.col("doc").alias("e")), ["form", "big"])
    else:
        flag = F.broadcast(hot.select(F.col("own").alias("big"), F.lit(True).alias("_hot")))
        all_salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        own_salt = F.when(F.col("_hot"), F.pmod("e", F.lit(SALTS)).cast("int")).otherwise(0)
        held = members.select(F.col("own").alias("big"), "form", F.col("doc").alias("e")).join(flag, "big", "left").withColumn("_salt", own_salt).drop("_hot")
        wide = wide.join(flag, "big", "left").withColumn("_salt", F.explode(all_salts)).drop("_hot").join(held, ["form", "big", "_salt"])
    return wide.where("d <> e").select(F.least("d", "e").alias("doc_a"), F.greatest("d", "e").alias("doc_b"))
