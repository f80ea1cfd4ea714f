import itertools
import random
import re

import pytest

from sievector.llm import licenses
from sievector.llm.queries import op4_license_scan

SF = "/root/testdata/sf0.001"


def test_base_places(spark):
    got = {r["doc_id"]: r for r in op4_license_scan(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), r["text"]))
        hits = [(i, name) for p, name in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        row = got[r["doc_id"]]
        assert (row["n_words"], row["n_base"]) == (len(words), len(hits))
        assert (row["first_word"], row["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert row["base_labels"] == ",".join(sorted({n for _, n in hits}))
        assert {*filter(None, row["base_labels"].split(","))} <= {*filter(None, row["labels"].split(","))} and 0 <= row["score"] <= 1


def test_adjacent_phrases():
    joined = b" " + b" ".join(licenses.words_of("CC BY-NC cc by nc; cc by")) + b" "
    assert licenses.phrase_places(joined, b" cc by nc ") == [0, 3]


@pytest.mark.parametrize("label,text,keys", licenses.TEMPLATES)
def test_templates_find_themselves(label, text, keys):
    index = licenses.Index(licenses.rare_words(0, dict.fromkeys(licenses.licence_words(), 0)))
    around = "some words before " * 20 + text + " and after" * 20
    assert label in {x[0] for x in index.scan(licenses.words_of(around))}


def test_edits_and_missing_phrases():
    index = licenses.Index(licenses.rare_words(0, dict.fromkeys(licenses.licence_words(), 0)))
    label, text, _ = licenses.TEMPLATES[0]
    words = licenses.words_of(text)
    edited = words[:9] + [b"extra"] + words[9:20] + words[21:]
    assert label in {x[0] for x in index.scan(edited)}
    without = [w for w in words if w not in (b"restriction",)]
    assert label not in {x[0] for x in index.scan(without)}
    assert index.scan(licenses.words_of("license software permission copy the " * 50)) == []


def test_several_licences_in_a_file():
    index = licenses.Index(licenses.rare_words(0, dict.fromkeys(licenses.licence_words(), 0)))
    for group in [*itertools.combinations(licenses.TEMPLATES, 2), licenses.TEMPLATES]:
        text = "some words before " * 20 + (" and between" * 20 + " ").join(t for _, t, _ in group) + " and after" * 20
        assert {label for label, _, _ in group} <= {x[0] for x in index.scan(licenses.words_of(text))}


@pytest.mark.parametrize("label,text,keys", licenses.TEMPLATES)
def test_common_licence(label, text, keys):
    own = set(licenses.words_of(text))
    index = licenses.Index(licenses.rare_words(900, {w: 300 if w in own else 0 for w in licenses.licence_words()}))
    assert label in {x[0] for x in index.scan(licenses.words_of("some words before " * 20 + text + " and after" * 20))}


def test_against_every_place():
    """Files with edited licences: the index finds what trying every template at every third place finds."""
    rng = random.Random(11)
    index = licenses.Index(licenses.rare_words(0, dict.fromkeys(licenses.licence_words(), 0)))
    wanted = found = extra = 0
    for _ in range(40):
        words: list[bytes] = []
        for t in rng.sample(range(len(index.words)), rng.randint(0, 3)):
            words += [b"filler"] * rng.randint(0, 30)
            for w in index.words[t]:
                drawn = rng.random()
                words += [] if drawn < 0.02 else [b"edited"] if drawn < 0.05 else [w, b"more"] if drawn < 0.07 else [w]
        joined = b" " + b" ".join(words) + b" "
        able = [t for t in range(len(index.words)) if all(k in joined for k in index.keys[t])]
        every = {index.labels[t] for t in able if any(index._verify(t, at, words) for at in range(-3, len(words), 3))}
        got = {x[0] for x in index.scan(words)}
        wanted, found, extra = wanted + len(every), found + len(every & got), extra + len(got - every)
    assert wanted > 30 and found >= 0.99 * wanted and extra <= 0.02 * wanted


def test_table_of_copies(spark):
    """A whole licence in every row, and one that a third of the rows has."""
    whole = dict((label, text) for label, text, _ in licenses._WHOLE)
    for label, other in itertools.permutations(("mit", "isc", "bsd-3-clause"), 2):
        rows = [(i, whole[label] + (" " + whole[other] if i % 3 == 0 else "")) for i in range(30)]
        for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
            assert {label, other} if r["doc_id"] % 3 == 0 else {label} <= {s["label"] for s in r["spans"]}


def test_hot_group_and_one_row(spark):
    label, text, _ = licenses.TEMPLATES[0]
    other, another, _ = licenses.TEMPLATES[20]
    rows = [(i, "some words " * 9 + (text if i % 3 == 0 else another if i == 1 else "and nothing of the kind")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: {s["label"] for s in r["spans"] if not s["base"]} for r in licenses.scan(docs).collect()}
    assert found == {i: {label} if i % 3 == 0 else {other} if i == 1 else set() for i in range(30)}
    assert [s["label"] for s in licenses.scan(docs.where("doc_id = 0")).first()["spans"]] == [label]


def test_operator(odd, none, clashing):
    rows = {repr(r["doc_id"]): r for r in licenses.scan(odd).collect()}
    assert [s["label"] for s in rows["10"]["spans"] if s["base"]] == ["mit"] and rows["3"]["n_words"] == 0
    assert licenses.scan(clashing).count() == clashing.count() and licenses.scan(none).count() == 0
