"""Visually identical text with different characters.

Every text is brought to one form in which two texts are equal exactly when
they look the same.  A token (a run of letters and marks) is resolved by the
scripts that can spell it: each letter contributes the set of scripts that
have a letter of the same look, the sets are intersected over the token, and
the token is spelled in the first script of ``SCRIPTS`` left over, else in the
first by name.  A token with letters of several scripts is *mixed*; one in a
single script that another script could spell as well is a *whole-script
confusable*.  Where no script can spell the whole token, each letter takes the
first spelling of its look.  The choice never depends on neighbouring text, so
a passage has the same form wherever it stands.

Which letters look alike comes from the public confusables data, as the ICU
library that Spark ships carries it, by a rule (``confusable_letters``), with
``LOOKS`` ahead of it.  The rest is normalised by rule too: invisible
characters are dropped, every space separator becomes a plain space,
full-width, no-break and upright sans-serif variants take their plain letters,
ligatures are taken apart, and marks are composed.  Superscripts, accents,
digits, letter case and letter styles (long s, symbol variants, bold, script,
double-struck) stay, since they can be seen.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.session import cut

# Letters of the same look in Latin, Cyrillic and Greek.  A dot
# stands where a script has no such letter.
LOOKS = """
a а .   c с ϲ   d ԁ .   e е .   h һ .   i і .   j ј ϳ   l ӏ .   o о ο   p р .
q ԛ .   s ѕ .   v ѵ ν   w ԝ .   x х .   y у .
A А Α   B В Β   C С Ϲ   E Е Ε   F . Ϝ   H Н Η   I І Ι   J Ј Ϳ   K К Κ   M М Μ
N . Ν   O О Ο   P Р Ρ   Q Ԛ .   S Ѕ .   T Т Τ   V Ѵ .   W Ԝ .   X Х Χ   Y Ү Υ
Z . Ζ   . Г Γ   . П Π   . Ф Φ   . Л Λ
"""
SCRIPTS = ("Latin", "Cyrillic", "Greek")

# Letters that the public data joins with a plain letter of
# another shape in upright type.
UNLIKE = "α ɑ σ γ ɣ υ ʋ ᴜ ι ɩ ɪ ı ꙇ г ᴦ ⲅ ꭇ ꭈ ꮁ ſ ẝ ƽ ƍ ᶃ ɯ ѡ ա ϱ ϒ Ɩ ǀ ʏ ᶌ ỿ ꭚ ყ ҽ ꬲ ք ꞙ ꬵ ᴑ ꬽ Ꭵ ꭵ ꞟ ꭎ ꭒ Ʝ Ʀ".split()

_CELLS = LOOKS.split()
_ROWS = [_CELLS[i : i + 3] for i in range(0, len(_CELLS), 3)]
Spellings = dict[str, dict[str, str]]
#: By letter, how each script spells its look.
BASE: Spellings = {}
for _row in _ROWS:
    _spell = {s: ch for s, ch in zip(SCRIPTS, _row) if ch != "."}
    for _ch in _spell.values():
        BASE[_ch] = _spell


def script_of(ch: str) -> str:
    """The script of a letter, by its name."""
    return unicodedata.name(ch, "?").partition(" ")[0].capitalize()


def confusable_letters(spark: SparkSession) -> Spellings:
    """``BASE`` with the letters of all scripts that the public data gives the look of a plain letter.

    A letter counts if its skeleton is one letter of the same case (a letter
    without case fits either), if it is written from left to right and no
    variant of another character, and if it isn't in ``UNLIKE``.  Skeletons
    that several plain letters share (l, I) are told apart by case.  Letters
    that look like no plain one count among themselves where they are capitals.
    """
    jvm = spark._jvm.com.ibm.icu.text
    letters = [ch for ch in map(chr, range(0x80, 0x20000)) if unicodedata.category(ch) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(ch)]
    letters = [ch for ch in letters if ch not in BASE and ch not in UNLIKE and unicodedata.bidirectional(ch) == "L"]
    skeletons = jvm.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    out: Spellings = {ch: dict(spell) for ch, spell in BASE.items()}
    looks: dict[str, dict[str, str]] = {next(iter(x.values())): x for x in out.values()}
    for ch, to in zip(letters, skeletons):
        case = unicodedata.category(ch)
        if len(to) != 1 or to == ch:
            continue
        if to == "l" and case == "Lu":
            to = "I"
        if not (to.isalpha() if to.isascii() else case == "Lu") or case != "Lo" and case != unicodedata.category(to):
            continue
        look = looks.setdefault(to, {script_of(to): to})
        look.setdefault(script_of(ch), ch)
    # All letters of a look share one table of spellings.
    for ch, to in zip(letters, skeletons):
        to = "I" if to == "l" and unicodedata.category(ch) == "Lu" else to
        look = looks.get(to)
        if look is not None and (look.get(script_of(ch)) == ch or (script_of(ch) in look and to.isascii() and unicodedata.category(ch) in ("Lo", unicodedata.category(to)))):
            out[ch] = look
    for look in looks.values():
        for ch in look.values():
            out[ch] = look
    return {ch: dict(sorted(look.items(), key=lambda x: (SCRIPTS.index(x[0]) if x[0] in SCRIPTS else len(SCRIPTS), x[0]))) for ch, look in out.items()}


def shared_letters(spark: SparkSession) -> Broadcast:
    """``confusable_letters``, a few hundred letters, sent to the executors once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_quillgraph_letters", None) is None:
        sc._quillgraph_letters = sc.broadcast(confusable_letters(spark))
    return sc._quillgraph_letters


#: Compatibility kinds whose members look like their plain letters.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>"}
#: Joiners and marks that show in these scripts, and so stay there.
_JOINING = (
    r"\p{Arabic}\p{Syriac}\p{Nko}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}"
    r"\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}\p{Extended_Pictographic}\ufe0f"
)
_JOINER = r"\u200c\u200d"
_VARIANT = r"\ufe00-\ufe0f\U000E0100-\U000E01EF"

_INVISIBLE = regex.compile(rf"(?<![{_JOINING}])[{_JOINER}]|[^\P{{Default_Ignorable_Code_Point}}{_JOINER}{_VARIANT}]")
_SELECTOR = regex.compile(rf"(?<!\p{{Extended_Pictographic}})[{_VARIANT}]")
_NOT_ASCII = regex.compile(r"[^\x00-\x7f]")
#: Scripts whose tokens may hold letters of others.
_SCRIPTS = r"\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Coptic}\p{Lisu}\p{Georgian}\p{Deseret}"


class Looks:
    """Forms of texts by a table of spellings."""

    def __init__(self, spellings: Spellings = BASE) -> None:
        self.spellings = spellings
        self.scripts = {s for spell in spellings.values() for s in spell} | set(SCRIPTS)
        known = "".join(ch for ch in spellings if ch > "\x7f")
        self.other = regex.compile(f"[{_SCRIPTS}{known}]")
        self.token = regex.compile(rf"[\p{{L}}\p{{M}}]*[{_SCRIPTS}{known}][\p{{L}}\p{{M}}]*")
        self.plain = lru_cache(maxsize=4096)(self._plain)
        self.inert = lru_cache(maxsize=65536)(self._inert)
        self.resolve = lru_cache(maxsize=65536)(self._resolve)

    def _plain(self, ch: str) -> str:
        """The plain spelling of one character that isn't ASCII."""
        if ch in self.spellings:
            return ch
        category = unicodedata.category(ch)
        if category == "Zs":
            return " "
        if ch in "\u2028\u2029\x85":
            return "\n"
        if ch == "\u2010":
            return "-"
        kind, _, points = unicodedata.decomposition(ch).partition(" ")
        upright = kind == "<font>" and regex.search(r"SANS-SERIF|MONOSPACE", name := unicodedata.name(ch, "")) and not regex.search(r"BOLD|ITALIC", name)
        # Letters of several parts, as ligatures are, and Roman numbers.
        parts = kind == "<compat>" and (category == "Nl" or (category[0] == "L" and " " in points))
        if kind in _SAME_LOOK or upright or parts:
            plain = "".join(chr(int(p, 16)) for p in points.split())
            if plain.strip():
                return "".join(x if x < "\x80" else self.plain(x) for x in plain)
        return ch

    def _resolve(self, token: str) -> tuple[str, str]:
        """Spelling of a token and its kind: '', 'mixed', 'whole' or 'unresolved'."""
        letters = unicodedata.normalize("NFD", token)
        possible, own = set(self.scripts), set()
        for ch in letters:
            if unicodedata.combining(ch) or unicodedata.category(ch) == "Mn":
                continue
            script = script_of(ch)
            own.add(script)
            possible &= self.spellings.get(ch, {script: ch}).keys()
        chosen = next((s for s in SCRIPTS if s in possible), min(possible, default=None))
        if chosen is None:
            out = "".join(next(iter(self.spellings[ch].values())) if ch in self.spellings else ch for ch in letters)
            kind = "unresolved" if len(own) > 1 else ""
        else:
            out = "".join(self.spellings[ch][chosen] if ch in self.spellings else ch for ch in letters)
            kind = "mixed" if len(own) > 1 else "whole" if len(possible) > 1 else ""
        return unicodedata.normalize("NFC", out), kind

    def _inert(self, ch: str) -> bool:
        """Whether a character stays as it is beside whatever else a text holds."""
        return ch.isascii() or not (
            self.plain(ch) != ch
            or unicodedata.combining(ch)
            or not unicodedata.is_normalized("NFC", ch)
            or _INVISIBLE.search(ch)
            or _SELECTOR.search(ch)
            or self.other.search(ch)
            or "\u1100" <= ch <= "\u11ff"
        )

    def composed(self, text: str) -> str:
        text = _NOT_ASCII.sub(lambda m: self.plain(m.group()), text)
        return unicodedata.normalize("NFC", _SELECTOR.sub("", _INVISIBLE.sub("", text)))

    def form(self, text: str) -> str:
        """The form in which ``text`` is equal to every text that looks the same.

        An ASCII text is its own form.  The empty text stays empty.
        """
        if text.isascii() or all(map(self.inert, set(text))):
            return text
        text = self.composed(text)
        if self.other.search(text):
            text = self.token.sub(lambda m: self.resolve(m.group())[0], text)
        return text

    def counts(self, text: str) -> tuple[int, int]:
        """Tokens that are mixed or unresolved, and whole-script confusables."""
        if text.isascii() or not self.other.search(text):
            return 0, 0
        kinds = [self.resolve(t)[1] for t in self.token.findall(self.composed(text))]
        return kinds.count("mixed") + kinds.count("unresolved"), kinds.count("whole")


_REPORT = T.StructType(
    [T.StructField("form", T.StringType()), T.StructField("n_mixed", T.IntegerType()), T.StructField("n_whole_script", T.IntegerType())]
)


def _forms(shared: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        looks = Looks(shared.value)
        for batch in batches:
            yield batch.map(looks.form, na_action="ignore")

    return forms


def _reports(shared: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf(_REPORT)
    def reports(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        looks = Looks(shared.value)
        for batch in batches:
            rows = [(None, 0, 0) if t is None else (looks.form(t), *looks.counts(t)) for t in batch]
            yield pd.DataFrame(rows, columns=["form", "n_mixed", "n_whole_script"])

    return reports


def _beyond_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7f]")


def form_column(spark: SparkSession, text: Column) -> Column:
    """The form of a text column.  ASCII texts don't leave the JVM."""
    return F.when(~_beyond_ascii(text), text).otherwise(_forms(shared_letters(spark))(F.when(_beyond_ascii(text), text)))


def consistent_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form, changed, n_mixed, n_whole_script) of every document.

    A null text has a null form and ``changed`` false; the empty text is its
    own form.  Repeated rows give repeated rows.  Other columns are ignored.
    """
    text = F.col(text_col)
    report = documents.select(
        F.col(id_col), text.alias("_text"), _reports(shared_letters(documents.sparkSession))(F.when(_beyond_ascii(text), text)).alias("_r")
    )
    form = F.when(F.col("_r.form").isNull(), F.col("_text")).otherwise(F.col("_r.form"))
    return report.select(
        id_col,
        form.alias("form"),
        F.coalesce(form != F.col("_text"), F.lit(False)).alias("changed"),
        F.coalesce(F.col("_r.n_mixed"), F.lit(0)).alias("n_mixed"),
        F.coalesce(F.col("_r.n_whole_script"), F.lit(0)).alias("n_whole_script"),
    )


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stored, look) of non-empty texts: 128-bit digests of the text and of its form."""
    text = F.col(text_col)
    rows = documents.where(F.length(text_col) > 0)
    return rows.select(F.col(id_col).alias("id"), F.md5(text).alias("stored"), F.md5(form_column(documents.sparkSession, text)).alias("look")).distinct()


def lookalike_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, look, documents, spellings) of documents in a class of several stored spellings of one look.

    ``look`` is the least id of the class.  One row a document, however many
    are alike; null and empty texts are in no class.
    """
    keyed = cut(_keyed(documents, id_col, text_col))
    spelled = keyed.groupBy("look", "stored").agg(F.min("id").alias("least"), F.count("id").alias("n"))
    several = spelled.groupBy("look").agg(F.min("least").alias("least"), F.sum("n").alias("documents"), F.count("*").alias("spellings")).where("spellings > 1")
    rows = keyed.where(F.col("id").isNotNull()).join(several, "look").select(F.col("id").alias(id_col), F.col("least").alias("look"), "documents", "spellings")
    return rows.distinct()


def lookalike_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b: documents that look the same and differ as stored.

    Null and empty texts have no partner.  Only 128-bit digests are shuffled.
    Documents are grouped by (form, stored text) first and pairs are formed
    between the differing stored texts of one form, so many exact copies of a
    text cost no more than the pairs they are part of.
    """
    # Read three times below: written once.
    keyed = cut(_keyed(documents, id_col, text_col))
    spellings = keyed.select("look", "stored").distinct()
    several = spellings.groupBy("look").count().where("count > 1").select("look")
    spellings = spellings.join(several, "look", "left_semi")
    other = spellings.withColumnRenamed("stored", "stored_b")
    variants = spellings.join(other, "look").where(F.col("stored") < F.col("stored_b"))
    rows = keyed.select("id", "stored")
    pairs = variants.join(rows, "stored").withColumnRenamed("id", "x")
    right = rows.select(F.col("id").alias("y"), F.col("stored").alias("stored_b"))
    return (
        pairs.join(right, "stored_b")
        .where(F.col("x") != F.col("y"))
        .select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))
        .distinct()
    )
