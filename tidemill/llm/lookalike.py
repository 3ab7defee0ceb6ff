"""Visually identical text with different characters.

The consistent form of a text is its compatibility-composed form (NFKC) with full case folding, white space mapped to
plain spaces, default-ignorable characters removed and look-alike letters mapped to Latin. Texts with the same form
are candidates. Case, superscripts and line breaks can be seen, so an exact check compares the candidates' visual
forms, which undo only what can't be seen. Both are made from the text itself, neither from the other.

The letters come by rule from the Unicode confusables table of the library that Spark's collations use: a letter of
another script than Latin, written left to right, whose prototype is that of one Latin letter. A letter without a dot
is no i or j. Of Latin letters only the small capitals are mapped, since others can be told apart in usual fonts.

Each distinct text of a batch is worked on once, and within the texts of a slice each distinct run of other characters
than ASCII, together with the ASCII character before it, to which its marks may belong: normalisation never reaches
beyond such a run. ASCII between the runs goes through whole-text calls. Only digests of forms and texts are shuffled.

Defined results: null and empty texts have no form and match nothing; line ends CR LF, CR and LF are one; a
joiner between pictographs stays in the visual form, since it changes the picture; byte-identical copies are no pair; a
text of ignorable characters alone has an empty form, which is compared like others.
"""

from __future__ import annotations

import hashlib
import re
import string
import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.encode import slices
from tidemill.session import materialize

# Ranges of default-ignorable code points.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A),
    (0xE0000, 0xE0FFF),
)
#: Kinds of compatibility forms that look like what they stand for.
ALIKE = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
# Letters of other scripts with the dot of i and j; a small letter that the table takes for a dotless i.
DOTTED, BAR = "іјϳ", {"ӏ": "l"}
# Hyphens that are drawn like the ASCII one.
HYPHENS = "\u2010\u2011"
_ASCII_BLANKS, _OTHER_BLANKS = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f", "\x85\u2028\u2029"
#: The consistent form of ASCII, but for line ends: a table that is applied in one pass.
_ASCII_FORM = str.maketrans(_ASCII_BLANKS + string.ascii_uppercase, " " * len(_ASCII_BLANKS) + string.ascii_lowercase)
_RUN = re.compile("[^\\x00-\\x7f]+")
#: Code points that stand for no character: the first one that a run lacks marks joiners that stay.
_NONCHARACTERS = [chr(c) for c in range(0xFDD0, 0xFDF0)] + [chr(p << 16 | c) for p in range(1, 17) for c in (0xFFFE, 0xFFFF)]
#: Bytes of text worked on at once.
SLICE = 4 << 20


@dataclass(frozen=True)
class Alphabet:
    """What characters are replaced by, in the visual form and in the consistent form; "" removes one."""

    seen: dict[str, str]
    letters: dict[str, str]
    blank: frozenset[str]
    ignorable: frozenset[str]


_MADE: dict[str, Alphabet] = {}


def letters(spark: SparkSession) -> dict[str, str]:
    """Letters that look like a Latin one, by rule from the confusables table."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()

    def prototypes(chars: Sequence[str]) -> list[str]:
        return checker.getSkeleton("\n".join(chars)).split("\n")

    of: dict[str, list[str]] = {}
    for letter, prototype in zip(string.ascii_letters, prototypes(string.ascii_letters), strict=True):
        of.setdefault(prototype, []).append(letter)

    def may(char: str) -> bool:
        if unicodedata.category(char) not in ("Lu", "Ll", "Lo", "Nl") or unicodedata.bidirectional(char) != "L":
            return False
        name, form = unicodedata.name(char, ""), unicodedata.decomposition(char)
        latin = name.startswith("LATIN ") and not name.startswith("LATIN LETTER SMALL CAPITAL")
        return not latin and (not form or form.startswith("<compat>"))

    chars = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if may(c)]
    out = {}
    for char, prototype in zip(chars, prototypes(chars), strict=True):
        if unicodedata.category(char) == "Nl":
            plain = unicodedata.normalize("NFKD", char)
            if len(plain) == 1 and plain.isascii() and plain.isalpha():
                out[char] = plain  # a numeral drawn as one letter
        elif prototype in of:
            among = of[prototype]
            cased = [x for x in among if x.islower() == (unicodedata.category(char) == "Ll")]
            target = among[0] if len(among) == 1 else cased[0]
            if target not in "ij" or char in DOTTED:
                out[char] = target
    return out | BAR


def alphabet(spark: SparkSession) -> Alphabet:
    """The tables, made once per application on the driver; tasks get them with their function."""
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        like = letters(spark) | dict.fromkeys(HYPHENS, "-")
        to, spaces = {}, set(_OTHER_BLANKS)
        for code in range(0x80, sys.maxunicode + 1):
            char = chr(code)
            form = unicodedata.decomposition(char)
            if form.startswith("<") and form.split(" ", 1)[0] in ALIKE or 0xFB00 <= code <= 0xFB06:
                to[char] = "".join(like.get(x, x) for x in unicodedata.normalize("NFKD", char))
            if unicodedata.category(char) == "Zs":
                to[char] = " "
                spaces.add(char)
        gone = frozenset(chr(c) for a, b in IGNORABLE for c in range(a, b + 1))
        _MADE[app] = Alphabet(to | like | dict.fromkeys(gone, ""), like, frozenset(spaces), gone)
    return _MADE[app]


def _swap(text: str, to: dict[str, str]) -> str:
    return "".join([to.get(c, c) for c in text])


def _by_runs(text: str, work: Callable[[str], str], known: dict[str, str]) -> str:
    """``work`` on every run of other characters than ASCII with the ASCII character before it. ``known`` remembers runs."""
    if text.isascii():
        return text
    out, at = [], 0
    for run in _RUN.finditer(text):
        begin = max(run.start() - 1, at)
        key = text[begin : run.end()]
        made = known.get(key)
        if made is None:
            made = known[key] = work(key)
        out += (text[at:begin], made)
        at = run.end()
    return "".join(out) + text[at:]


def _is_picture(char: str) -> bool:
    return unicodedata.category(char) == "So" or char == "\ufe0f" or 0x1F3FB <= ord(char) <= 0x1F3FF


def visual_forms(texts: Sequence[str], abc: Alphabet) -> list[str]:
    """What a reader sees: characters that can't be told apart become one; case, accents and digits stay."""

    def work(text: str) -> str:
        text = unicodedata.normalize("NFD", text)
        mark = next((c for c in _NONCHARACTERS if c not in text), "") if "\u200d" in text else ""
        if mark:
            kept = lambda m: mark if m.start() and m.end() < len(text) and _is_picture(text[m.start() - 1]) and _is_picture(text[m.end()]) else ""
            text = re.sub("\u200d", kept, text)
        text = unicodedata.normalize("NFC", _swap(text, abc.seen))
        return text.replace(mark, "\u200d") if mark else text

    known: dict[str, str] = {}
    return [_by_runs(t.replace("\r\n", "\n").replace("\r", "\n"), work, known) for t in texts]


def consistent_forms(texts: Sequence[str], abc: Alphabet) -> list[str]:
    """One form for comparison: compatibility-composed, fully case-folded, blanks mapped, ignorables removed."""
    after = abc.letters | dict.fromkeys(abc.ignorable, "") | dict.fromkeys(abc.blank, " ")

    def fold(text: str) -> str:
        return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())

    def work(text: str) -> str:
        # letters first, since some have a compatibility form of another look; and again for those that had one
        text = _swap(unicodedata.normalize("NFD", text), abc.letters)
        text = _swap(unicodedata.normalize("NFKD", text), after)
        # folding may bring up a letter of the table, such as a capital's small form
        return fold(_swap(unicodedata.normalize("NFD", fold(text)), abc.letters))

    known: dict[str, str] = {}
    out = []
    for text in texts:
        text = _by_runs(text.replace("\r\n", "\n"), work, known)
        if text.isascii():
            out.append(text.translate(_ASCII_FORM))
            continue
        for blank in _ASCII_BLANKS:
            text = text.replace(blank, " ")
        out.append(text.casefold())
    return out


def _digests(texts: Sequence[str]) -> list[bytes]:
    return [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]


def _per_distinct(batch: pa.RecordBatch, work: Callable[[list[str]], list[list]], kinds: Sequence[pa.DataType]) -> Iterator[list[pa.Array]]:
    """Columns of ``work`` for every row of a batch (key, text), slice by slice; each distinct text is worked on once."""
    for part in slices(batch, SLICE):
        coded = part.column(1).dictionary_encode()
        made = work(coded.dictionary.to_pylist())
        yield [part.column(0), *(pa.array(c, k).take(coded.indices) for c, k in zip(made, kinds, strict=True))]


def digests(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, form, seen, content: 16-byte digests of the consistent form, the visual form and the text."""
    abc = alphabet(documents.sparkSession)

    def work(texts: list[str]) -> list[list[bytes]]:
        content = _digests(texts)
        seen = list(content)
        # a text of ASCII without carriage returns is seen as it is
        odd = [i for i, t in enumerate(texts) if not t.isascii() or "\r" in t]
        for i, d in zip(odd, _digests(visual_forms([texts[i] for i in odd], abc)), strict=True):
            seen[i] = d
        return [_digests(consistent_forms(texts, abc)), seen, content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in _per_distinct(batch, work, [pa.binary()] * 3):
                yield pa.RecordBatch.from_arrays(columns, [key, "form", "seen", "content"])

    kind = documents.schema[key].dataType.simpleString()
    full = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, text)
    return full.mapInArrow(run, f"`{key}` {kind}, form binary, seen binary, content binary")


def forms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, form, changed: every text in its consistent form (null stays null, empty stays empty)."""
    abc = alphabet(documents.sparkSession)

    def work(texts: list[str]) -> list[list]:
        made = consistent_forms(texts, abc)
        return [made, [a != b for a, b in zip(made, texts, strict=True)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in _per_distinct(batch, work, [pa.string(), pa.bool_()]):
                yield pa.RecordBatch.from_arrays(columns, [key, "form", "changed"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, form string, changed boolean")


def classes(marks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: key, class_id (smallest key that looks the same), n_documents, n_contents of the class."""
    by = ["form", "seen"]
    copies = marks.groupBy(*by, "content").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    groups = copies.groupBy(*by).agg(F.min("first").alias("class_id"), F.sum("n").alias("n_documents"), F.count(F.lit(1)).alias("n_contents"))
    return marks.join(groups, by).select(key, "class_id", "n_documents", "n_contents")


def candidates(marks: DataFrame) -> DataFrame:
    """Digests of the documents whose consistent form occurs with two or more contents."""
    contents = marks.select("form", "content").distinct()
    return marks.join(contents.groupBy("form").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= 2).select("form"), "form", "left_semi")


def pairs(marks: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id_a < doc_id_b of documents that look the same and differ in bytes.

    Candidates share the consistent form; the exact check is the visual form. Different contents of a class are paired
    first, then each side is filled with its documents, so copies of one text are never paired with each other.
    """
    involved = materialize(candidates(marks))
    kinds = involved.select("form", "seen", "content").distinct()
    a = kinds.select("form", F.col("seen").alias("seen_a"), F.col("content").alias("content_a"))
    b = kinds.select("form", F.col("seen").alias("seen_b"), F.col("content").alias("content_b"))
    met = a.join(b, "form").where(F.col("content_a") < F.col("content_b")).where(F.col("seen_a") == F.col("seen_b")).select("content_a", "content_b")
    left = involved.select(F.col("content").alias("content_a"), F.col(key).alias("x"))
    right = involved.select(F.col("content").alias("content_b"), F.col(key).alias("y"))
    full = met.join(left, "content_a").join(right, "content_b")
    return full.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
