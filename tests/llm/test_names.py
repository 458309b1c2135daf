import pytest

from quillgraph.llm import names
from quillgraph.llm.names import components, family_links, lcs, lcs_ratio, name_entities, profile, same_entity_pairs

SCHEMA = "author string, email string, entity string, identity string, given string"


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    for a, b in (("", "x"), ("abcde", "ace"), ("bjorn", "born"), ("banana", "ananab"), ("x" * 80 + "abc", "abc" + "x" * 70)):
        assert lcs(a, b) == slow(a, b)
    assert lcs_ratio("abc", "abc") == 1.0 and lcs_ratio("", "") == 0.0


@pytest.mark.parametrize(
    ("author", "email", "given", "family"),
    [
        ("Björn Lorkadaul", "blorkadaul@x.example", "bjorn", "lorkadaul"),
        ("Lorkadaul, Björn", "", "bjorn", "lorkadaul"),
        ("LORKADAUL Björn", "", "bjorn", "lorkadaul"),
        ("B. Lorkadaul", "", "b", "lorkadaul"),
        ("BjörnLorkadaul", "", "bjorn", "lorkadaul"),
        ("lorkadaul-b", "", "b", "lorkadaul"),
        ("blorkadaul", "bjorn@lorkadaul-laptop.local.test", "bjorn", "lorkadaul"),
        ("Maggie", "margaret.elwaskopor@x.example", "margaret", "elwaskopor"),
        ("Dr. Zofia M. Korish (contractor)", "", "zofia", "korish"),
    ],
)
def test_profile(author, email, given, family):
    kind, first, last, _ = profile(author, email, {"bjorn": "bjorn"})
    assert kind == "person" and first == given and family in last


def test_entities(spark, collect):
    people = [
        ("Katherine Porvatorhel", "kporvatorhel@a.example"), ("Kate Povatorhel", "katherine@porvatorhel-laptop.local.test"), ("porvatorhel-k", "kporvatorhel@a.example"),
        ("Porvatorhel, Katherine", None), (" Katherine  Porvatorhel", "1234+kporvatorhel@noreply.host.example"), ("Kathy", "kporvatorhel@a.example"),
        ("Umar Porvatorhel", "family@a.example"), ("build-bot-1", "b1@ci.invalid"), ("build-bot-2", "b2@ci.invalid"),
        ("Marinrinwel Research Inc.", "code@marinrinwel.example"), ("MARINRINWEL RESEARCH", None), ("Marinrinwel Res.", None), ("The Marinrinwel Research Authors", "oss@marinrinwel.example"),
        (None, "x@y"), ("", None), ("???", None), ("李", None), ("x" * 5000, "y" * 3000),
    ]
    data = [(a, e, "x", "y", "z") for a, e in people] * 2
    out = name_entities(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(out) == len({r["identity"] for r in out}) == 17
    by = {r["identity"].split(" <")[0]: r["entity"] for r in out}
    kate = {by[n] for n in ("Katherine Porvatorhel", "Kate Povatorhel", "porvatorhel-k", "Porvatorhel, Katherine", " Katherine  Porvatorhel", "Kathy")}
    assert len(kate) == 1 and by["Umar Porvatorhel"] not in kate
    assert by["build-bot-1"] != by["build-bot-2"]
    assert len({by[n] for n in ("Marinrinwel Research Inc.", "MARINRINWEL RESEARCH", "Marinrinwel Res.", "The Marinrinwel Research Authors")}) == 1
    pairs = collect(same_entity_pairs(spark.createDataFrame(data, SCHEMA)))
    assert len(pairs) == 6 * 5 // 2 + 4 * 3 // 2 and all(a < b for a, b in pairs)
    assert name_entities(spark.createDataFrame([], SCHEMA)).count() == 0


def test_initial_between_relatives_links_to_none(spark):
    people = [("Esra Lemlinwen", None), ("Ekaterina Lemlinwen", None), ("E. Lemlinwen", None)]
    out = name_entities(spark.createDataFrame([(a, e, "", "", "") for a, e in people], SCHEMA)).collect()
    assert len({r["entity"] for r in out}) == 3


def test_family_names_of_two_letters(spark):
    people = [("Wei Li", "a@x.example"), ("wei li", "b@y.example"), ("Wei Lu", "c@x.example"), ("Sara Li", "d@x.example"), ("wli", "e@x.example")]
    by = {r["identity"].split(" <")[0]: r["entity"] for r in name_entities(spark.createDataFrame([(*p, "", "", "") for p in people], SCHEMA)).collect()}
    assert by["Wei Li"] == by["wei li"] and len(set(by.values())) == 4


def test_all_readings_of_an_identity_belong_together(spark):
    people = [("Ted Smyth", "ted.smith@x.example")] + [(f"{g} {f}", None) for g in ("Edward", "Theodore") for f in ("Smith", "Smyth")]
    out = name_entities(spark.createDataFrame([(*p, "", "", "") for p in people], SCHEMA)).collect()
    assert len(out) == 5 and len({r["entity"] for r in out}) == 1


def test_common_suffixes_are_refined(spark, monkeypatch):
    rows = [(i, "person", g, s) for i, (g, s) in enumerate([("anna", "harbourson"), ("anna", "harborson"), ("albert", "harbourson"), ("alan", "baxterson"), ("amy", "dickerson")])]
    table = spark.createDataFrame([(*r, False) for r in rows], "name_id long, kind string, given string, spelling string, known boolean")
    want = {(0, 1)}
    assert {(r["a"], r["b"]) for r in family_links(table).collect()} == want
    monkeypatch.setattr(names, "COMMON", 2)
    assert {(r["a"], r["b"]) for r in family_links(table).collect()} == want


def test_no_key_is_given_up(spark, monkeypatch):
    """However common a suffix is, the links are the same; also of an initial with the whole name."""
    rows = [("j" if i % 7 == 0 else "john", f"{a}{b}arbourson") for i, (a, b) in enumerate((a, b) for a in "bcdfgh" for b in "aeiou")]
    rows += [("john", "harbourson"), ("john", "harboursen"), ("j", "harbourson"), ("jane", "harbourson")]
    data = [(i, "person", g, s, g in ("john", "jane")) for i, (g, s) in enumerate(dict.fromkeys(rows))]
    table = spark.createDataFrame(data, "name_id long, kind string, given string, spelling string, known boolean")
    want = {(r["a"], r["b"]) for r in family_links(table).collect()}
    assert len(want) > 50
    monkeypatch.setattr(names, "COMMON", 3)
    refined = {(r["a"], r["b"]) for r in family_links(table).collect()}
    # Refining by the given name parts initials from names they aren't spelled like.
    assert {(a, b) for a, b in want if data[a][2] == data[b][2] or data[a][3] == data[b][3]} <= refined <= want


def test_orders_and_names_off_the_lists(spark):
    people = [("Mokoena Thandiwe", "a@x.example"), ("Thandiwe Mokoena", "b@y.example"), ("Zhao Lin", None), ("Lin Zhao", "z@q.example"), ("Thandiwe Dube", "c@x.example"), ("Sipho Mokoena", "d@x.example")]
    by = {r["identity"].split(" <")[0]: r["entity"] for r in name_entities(spark.createDataFrame([(*p, "", "", "") for p in people], SCHEMA)).collect()}
    assert by["Mokoena Thandiwe"] == by["Thandiwe Mokoena"] and by["Zhao Lin"] == by["Lin Zhao"] and len(set(by.values())) == 4


def test_given_names_are_learned(spark):
    families = ["Adeyemi", "Bhattacharya", "Castellanos", "Drummond", "Eriksen"]
    people = [(f"{g} {f}", "") for f in families for g in ("Chidinma", "Oluwaseun")] + [("Bhattacharya Chidinma", ""), ("Chidimna Drummond", ""), ("Oluwaseum Eriksen", "")]
    typed = [(None, None, [], [], *a.lower().split()) for a, _ in people]
    learned = {r["word"]: r["given"] for r in names.given_names(spark.createDataFrame(typed, names._WORDS)).collect()}
    assert learned == {"chidinma": "chidinma", "oluwaseun": "oluwaseun", "chidimna": "chidinma", "oluwaseum": "oluwaseun"}
    by = {r["identity"].split(" <")[0]: r["entity"] for r in name_entities(spark.createDataFrame([(*p, "", "", "") for p in people], SCHEMA)).collect()}
    assert by["Bhattacharya Chidinma"] == by["Chidinma Bhattacharya"] and by["Chidimna Drummond"] == by["Chidinma Drummond"] and len(set(by.values())) == 10


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    out = {r["member"]: r["component"] for r in components(links).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[103] == out[100] == 100
