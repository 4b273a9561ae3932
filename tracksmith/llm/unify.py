"""Problem 10: texts that look the same, brought to one written form."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.storage import materialize

# Letters of other scripts that look like a Latin one. Latin, Cyrillic, Greek; "-" where a script has none.
LOOK_ALIKES = """
a а α
c с ϲ
d ԁ -
e е -
h һ -
i і ι
j ј ϳ
k к κ
o о ο
p р ρ
q ԛ -
s ѕ -
u - υ
v ѵ ν
w ԝ -
x х χ
y у γ
A А Α
B В Β
C С Ϲ
E Е Ε
H Н Η
I І Ι
J Ј Ϳ
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
Q Ԛ -
S Ѕ -
T Т Τ
V Ѵ -
W Ԝ -
X Х Χ
Y Ү Υ
Z - Ζ
"""
# Other letters that look like a Latin one, and that one.
VARIANTS = {"ɑ": "a", "ɡ": "g", "ı": "i", "У": "Y"}
# Characters that are not seen, beside those of the Unicode category "format" (Cf).
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))

LATIN, CYRILLIC, GREEK = 0, 1, 2
_SETS = [line.split() for line in LOOK_ALIKES.split("\n") if line]
#: For each script, what every look-alike letter becomes in a token of that script.
TO_SCRIPT: list[dict[str, str]] = [
    {c: (row[script] if row[script] != "-" else row[LATIN]) for row in _SETS for c in row if c != "-"} | {v: next((r[script] for r in _SETS if r[LATIN] == to and r[script] != "-"), to) for v, to in VARIANTS.items()}
    for script in (LATIN, CYRILLIC, GREEK)
]
_ALIKE = set(TO_SCRIPT[LATIN])
_FOLD = {ord(c): to for c, to in TO_SCRIPT[LATIN].items() if c != to}

_PLAIN: dict[int, str | None] = {}
# the planes that hold format characters and spaces
for _i in [*range(0xD800), *range(0xE000, 0x14000), *range(0x1B000, 0x1D200), *range(0xE0000, 0xE0080)]:
    _k = unicodedata.category(chr(_i))
    if _k == "Cf":
        _PLAIN[_i] = None
    elif _k == "Zs" and _i != 32:
        _PLAIN[_i] = " "
for _c in INVISIBLE:
    _PLAIN[ord(_c)] = None
for _i in range(0xFF01, 0xFFEF):
    if _i not in _PLAIN and (_form := unicodedata.normalize("NFKC", chr(_i))) != chr(_i):
        _PLAIN[_i] = _form

_TOKEN = re.compile("(?:[^\\W\\d_]|[̀-ͯ])+")
_ASCII_TOKEN = re.compile("[A-Za-z]+")


_SPECIAL = re.compile("[" + re.escape("".join(map(chr, _PLAIN))) + "]")
_FOLDED = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_ASCII_ALIKE = re.compile("[" + "".join(sorted(c for c in _ALIKE if c.isascii())) + "]")
_ASCII_TELLS = re.compile("[" + "".join(c for c in map(chr, range(128)) if c.isalpha() and c not in _ALIKE) + "]")
# where the letters of the other two scripts lie; Ω may be written as the sign of the unit
_NOT_LATIN = re.compile("[Ͱ-Ͽἀ-\u1fffЀ-ԯ\u2126]")


def _by_line(text: str, form) -> str:
    """A form of the lines that are not ASCII; no form reaches over the end of a line."""
    return "\n".join([line if line.isascii() else form(line) for line in text.split("\n")])


def _plain_line(line: str) -> str:
    return unicodedata.normalize("NFC", _SPECIAL.sub(lambda m: _PLAIN[ord(m[0])] or "", line))


def _folded_line(line: str) -> str:
    nfd = unicodedata.normalize("NFD", _SPECIAL.sub(lambda m: _PLAIN[ord(m[0])] or "", line))
    return unicodedata.normalize("NFC", _FOLDED.sub(lambda m: _FOLD[ord(m[0])], nfd))


def plain(text: str) -> str:
    """One width, one kind of space, nothing invisible, accents composed (NFC)."""
    return text if text.isascii() else _by_line(text, _plain_line)


def folded(text: str) -> str:
    """``plain`` with every look-alike letter as the Latin one, whatever its token: for comparisons, not for reading."""
    return text if text.isascii() else _by_line(text, _folded_line)


@lru_cache(maxsize=None)
def script_of(c: str) -> int | None:
    """Script of a letter that has no look-alike, of the three scripts in question; else nothing."""
    if c in _ALIKE:
        return None
    o = ord(c)
    if o < 0x250:
        return LATIN if c.isalpha() else None
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return GREEK if c.isalpha() else None
    if 0x400 <= o < 0x530:
        return CYRILLIC
    return LATIN if 0x1E00 <= o < 0x1F00 else None


def dominant(nfd: str) -> int | None:
    """The script of most letters without look-alike (a tie: Latin, Cyrillic, Greek); nothing without such letters.

    Exchanging look-alikes does not change these letters, so all spellings of a text agree on it.
    """
    count = Counter(s for c in nfd if (s := script_of(c)) is not None)
    return min(count, key=lambda s: (-count[s], s)) if count else None


@lru_cache(maxsize=200_000)
def repaired(token: str, otherwise: int) -> str:
    """The token with its look-alikes in its dominant script, or in ``otherwise`` if no letter tells that."""
    nfd = unicodedata.normalize("NFD", token)
    script = dominant(nfd)
    table = TO_SCRIPT[otherwise if script is None else script]
    return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in nfd))


def repairs(text: str):
    """``(start, end, token, result)`` of the tokens of a plain text that repair would change.

    A line in ASCII is in question too where none of its letters tells a script and its text is not Latin: it may be
    the other spelling of a line that is not ASCII.
    """
    whole = None
    start = 0
    for line in text.split("\n"):
        ascii_line = line.isascii()
        if not ascii_line or (_ASCII_ALIKE.search(line) and not _ASCII_TELLS.search(line)):
            here = None if ascii_line else dominant(unicodedata.normalize("NFD", line))
            if here is None:
                if whole is None:
                    whole = (dominant(unicodedata.normalize("NFD", text)) or LATIN) if _NOT_LATIN.search(text) else LATIN
                here = whole
            if ascii_line and here == LATIN:
                start += len(line) + 1
                continue
            for m in _TOKEN.finditer(line):
                token = m[0]
                if token.isascii() and here == LATIN:
                    continue
                if (result := repaired(token, here)) != token:
                    yield start + m.start(), start + m.end(), token, result
        start += len(line) + 1


def repair(text: str, accepted) -> str:
    """The text with the repairs whose result is accepted."""
    out, at = [], 0
    for a, b, _, result in repairs(text):
        if result in accepted:
            out += [text[at:a], result]
            at = b
    return "".join(out) + text[at:] if out else text


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


_STAGE = pa.schema([
    ("id", pa.int64()), ("raw", pa.binary()), ("form", pa.binary()), ("blank", pa.bool_()), ("text", pa.string()),
    ("results", pa.list_(pa.string())), ("words", pa.list_(pa.struct([("form", pa.string()), ("raw", pa.string())]))),
])
_STAGE_DDL = "id long, raw binary, form binary, blank boolean, text string, results array<string>, words array<struct<form:string,raw:string>>"


def _scan(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            words: set[tuple[str, str]] = set()
            seen: set[str] = set()
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None:
                    rows.append((i, None, None, True, None, None, None))
                    continue
                form = plain(text)
                if form.isascii():
                    seen.update(_ASCII_TOKEN.findall(form))
                    results = None
                else:
                    found = [(t, r) for _, _, t, r in repairs(form)]
                    results = sorted({r for _, r in found}) or None
                    words.update((r, t) for t, r in found)
                    lines = form.split("\n")
                    seen.update(_ASCII_TOKEN.findall("\n".join([line for line in lines if line.isascii()])))
                    seen.update(_TOKEN.findall("\n".join([line for line in lines if not line.isascii()])))
                raw = _digest(text)
                rows.append((i, raw, raw if form is text else _digest(form), not form.strip(), form if keep_text or results else None, results, None))
            words.update((t, t) for t in seen)
            rows.append((None, None, None, None, None, None, [{"form": f, "raw": r} for f, r in words]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _STAGE.types)], schema=_STAGE)

    return run


def _apply(keep_text: bool):
    names = ["id", "raw", "form", "blank", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws, texts, accepted = (batch.column(c).to_pylist() for c in ("id", "raw", "text", "accepted"))
            forms = [repair(t, set(a)) for t, a in zip(texts, accepted)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(raws, pa.binary()), pa.array([_digest(f) for f in forms], pa.binary()),
                pa.array([not f.strip() for f in forms], pa.bool_()), pa.array(forms if keep_text else [None] * len(forms), pa.string()),
            ], names=names)

    return run


def unified_forms(df: DataFrame, doc_id: str, text: str, keep_text: bool = False) -> DataFrame:
    """One consistent written form of every text: ``doc_id, raw, form, blank, text``.

    ``raw`` and ``form`` are MD5 digests of the text as it stands and of its form (null for a null text), ``blank`` tells
    that nothing but space is left of it, ``text`` is the form itself with ``keep_text``, else null. Empty texts are blank.
    Repeated rows stay; an empty table gives no rows. Other columns are ignored, whatever their names.

    The form has one width, one kind of space, no invisible characters and composed accents; case, accents, digits and
    line breaks stay. Look-alike letters are then repaired by token: the letters without look-alike tell its script,
    those of its line and text where it has none, and look-alikes of other scripts are exchanged for that script's. An
    exchange is made only if its result is in the vocabulary of the corpus: written so in some text, or reached from
    at least two different spellings. A spelling without such company is left alone; no other text can equal it there.

    One pass writes digests, texts that repair would change, and the distinct tokens of each batch, from which the
    accepted results are counted; only the few texts to repair are joined with them.
    """
    scanned = materialize(df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(_scan(keep_text), _STAGE_DDL), "forms")
    texts, vocabulary = scanned.where(F.col("words").isNull()), scanned.where(F.col("words").isNotNull())
    spelled = vocabulary.select(F.explode("words").alias("w")).select("w.form", "w.raw").groupBy("form").agg(F.min("raw").alias("a"), F.max("raw").alias("z"))
    attested = spelled.where(F.col("a") != F.col("z")).select(F.col("form").alias("result"))
    wanted = texts.where(F.col("results").isNotNull()).select("id", "raw", F.explode("results").alias("result")).distinct().join(attested, "result", "left_semi")
    wanted = wanted.groupBy("id", "raw").agg(F.collect_set("result").alias("accepted"))
    to_repair = texts.where(F.col("results").isNotNull()).select("id", "raw", "form", "blank", "text").join(wanted, ["id", "raw"], "left")
    changed = to_repair.where(F.col("accepted").isNotNull()).select("id", "raw", "text", "accepted").mapInArrow(_apply(keep_text), "id long, raw binary, form binary, blank boolean, text string")
    as_is = texts.where(F.col("results").isNull()).select("id", "raw", "form", "blank", "text")
    left = to_repair.where(F.col("accepted").isNull()).select("id", "raw", "form", "blank", F.col("text") if keep_text else F.lit(None).cast("string").alias("text"))
    return as_is.unionByName(left).unionByName(changed).withColumnRenamed("id", doc_id)


def same_looking_pairs(forms: DataFrame, doc_id: str) -> DataFrame:
    """Pairs of texts that differ but have one form: ``doc_id_a, doc_id_b``, smaller id first.

    Blank and null texts, and texts without id, are never in a pair. Works on classes of equal texts: forms written in more than one way are
    found by their least and greatest spelling, spellings are paired, and only then the documents of each are put in,
    so equal texts are never compared with each other.
    """
    there = materialize(forms.where(~F.col("blank") & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), "raw", "form"), "digests")
    several = there.groupBy("form").agg(F.min("raw").alias("a"), F.max("raw").alias("z")).where(F.col("a") != F.col("z")).select("form")
    members = materialize(there.join(several, "form", "left_semi").dropDuplicates(["id", "raw"]), "alike")
    spellings = members.select("form", "raw").distinct()
    a, b = spellings.select("form", F.col("raw").alias("ra")), spellings.select("form", F.col("raw").alias("rb"))
    pairs = a.join(b, "form").where(F.col("ra") < F.col("rb"))
    left = members.select("form", F.col("raw").alias("ra"), F.col("id").alias("ia"))
    right = members.select("form", F.col("raw").alias("rb"), F.col("id").alias("ib"))
    out = pairs.join(left, ["form", "ra"]).join(right, ["form", "rb"])
    return out.select(F.least("ia", "ib").alias(f"{doc_id}_a"), F.greatest("ia", "ib").alias(f"{doc_id}_b")).distinct()


def same_looking_classes(forms: DataFrame, doc_id: str) -> DataFrame:
    """The same without pairs: ``doc_id, class_id, n_docs, n_links``, a row for each text that is in a pair.

    ``class_id`` is the smallest id of the texts of one form, ``n_docs`` their number, and ``n_links`` how many of them are
    spelled otherwise than this one. The pairs follow from it, but it grows with the texts and not with their pairs.
    """
    there = forms.where(~F.col("blank") & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), "raw", "form").dropDuplicates(["id", "raw"])
    spelled = there.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("own"), F.min("id").alias("least"))
    classes = spelled.groupBy("form").agg(F.count(F.lit(1)).alias("spellings"), F.sum("own").alias("n_docs"), F.min("least").alias("class_id")).where(F.col("spellings") > 1)
    rows = there.join(classes, "form").join(spelled.select("form", "raw", "own"), ["form", "raw"])
    return rows.select(F.col("id").alias(doc_id), "class_id", "n_docs", (F.col("n_docs") - F.col("own")).alias("n_links"))
