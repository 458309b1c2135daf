import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm.lookalike import Looks, confusable_letters, consistent_texts, lookalike_classes, lookalike_pairs

SCHEMA = "doc_id long, text string, form string, look string"
LOOKS = Looks()
visual_form, resolve_token = LOOKS.form, LOOKS.resolve


def test_forms():
    assert visual_form("plain") == "plain"
    assert visual_form("ｌｏｏｍ-８００") == "loom-800"
    assert visual_form("Cafe\u0301") == "Caf\u00e9"
    assert visual_form("so\u200bft\u00adly\ufeff a\u00a0b\u2007c") == "softly a b c"
    assert visual_form("\ufb01le") == "file"
    assert visual_form("n²") == "n²" and visual_form("naïve") != visual_form("naive")
    assert visual_form("A") != visual_form("a") and visual_form("١") != visual_form("1")


def test_scripts():
    assert resolve_token("mutеx") == ("mutex", "mixed")
    assert resolve_token("сор") == ("cop", "whole")
    assert resolve_token("Журнал") == ("Журнал", "")
    # A Latin letter in a Russian word takes the word's script.
    assert visual_form("Журнaл") == "Журнал"
    assert visual_form("Τhе") == "The"
    # No script can spell the whole token: each letter takes the first spelling of its look.
    assert resolve_token("Яzж")[1] == "unresolved"
    assert visual_form("Яzож") == visual_form("Яzoж") != visual_form("Яzж")


def test_visible_styles_stay():
    for a, b in (("ſun", "sun"), ("ϕ", "φ"), ("ϐ", "β"), ("ℝ", "R"), ("𝐀", "A"), ("ℓ", "l"), ("ª", "a"), ("σ", "o"), ("α", "a"), ("г", "r")):
        assert visual_form(a) != visual_form(b)
    assert visual_form("ϲat") == "cat" and visual_form("ϹAT") == "CAT" and visual_form("\U0001d5b7y") == "Xy" and visual_form("Ⅳ") == "IV"


def test_letters_of_all_scripts(spark):
    table = confusable_letters(spark)
    looks = Looks(table)
    assert len(table) > 250
    for a, b in (("օk", "ok"), ("Ꭺ", "A"), ("ɡo", "go"), ("ꓮ", "A"), ("Ⲕ", "K"), ("Тhе", "The"), ("Іn", "In"), ("ӏamp", "lamp"), ("ΡΑΥ", "PAY")):
        assert looks.form(a) == b, (a, looks.form(a))
    for a, b in (("ſun", "sun"), ("ϕ", "φ"), ("ℝ", "R"), ("σ", "o"), ("0", "O"), ("1", "l"), ("Ь", "b"), ("б", "6"), ("m", "rn"), ("I", "l"), ("ا", "l"), ("ס", "o")):
        assert looks.form(a) != looks.form(b), (a, b)
    for word in ("Журнал", "համար", "ᏣᎳᎩ", "λόγος", "über", "naïve"):
        assert looks.form(word) == word or looks.resolve(word)[1] == "whole"
    for ch in table:
        assert looks.form(looks.form(ch)) == looks.form(ch)


def test_joiners_stay_where_they_show():
    persian = "\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645"
    assert visual_form(persian) == persian


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcoepxyАаеорсухіο é\u0301\u200b\u00a0ｅ²ﬁЖ1", max_size=30))
def test_form_is_stable_and_composed(text):
    form = visual_form(text)
    assert visual_form(form) == form
    assert unicodedata.is_normalized("NFC", form)


def test_pairs_and_edge_cases(spark, collect):
    data = [
        (1, "the mutex", "x", "y"), (2, "the mutеx", None, None), (3, "the mutex", None, None), (4, "the  mutex", None, None),
        (5, None, None, None), (6, "", None, None), (7, "", None, None), (None, "lone", None, None), (2, "the mutеx", None, None),
        (8, "é" * 200_000, None, None), (9, "e\u0301" * 200_000, None, None),
    ]
    docs = spark.createDataFrame(data, SCHEMA)
    assert collect(lookalike_pairs(docs)) == [(1, 2), (2, 3), (8, 9)]
    out = {r["doc_id"]: r for r in consistent_texts(docs).collect()}
    assert out[2]["form"] == "the mutex" and out[2]["changed"] and out[2]["n_mixed"] == 1
    assert out[5]["form"] is None and not out[5]["changed"] and out[6]["form"] == ""
    assert consistent_texts(docs).count() == len(data)
    classes = {r["doc_id"]: (r["look"], r["documents"], r["spellings"]) for r in lookalike_classes(docs).collect()}
    assert classes == {1: (1, 3, 2), 2: (1, 3, 2), 3: (1, 3, 2), 8: (8, 2, 2), 9: (8, 2, 2)}
    none = spark.createDataFrame([], SCHEMA)
    assert lookalike_pairs(none).count() == 0 and consistent_texts(none).count() == 0 and lookalike_classes(none).count() == 0
