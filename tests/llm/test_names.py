import random

import pytest

from knotwork.llm.names import edit_join, parse, resolve


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_join_loses_no_pair(spark):
    rng = random.Random(4)
    vocab = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(5, 14))) for _ in range(60)})
    tokens = set(vocab[:5])
    for w in vocab:
        for _ in range(6):
            x = list(w)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(x))
                x[i : i + 1] = rng.choice([[], [rng.choice("abcde")], [x[i], rng.choice("abcde")]]) or []
                x = x or ["a"]
            tokens.add("".join(x))
    tokens |= {"ab", "abc"}
    limit = lambda t: 2 if len(t) >= 8 else 1 if len(t) >= 5 else 0
    want = {(t, w) for t in tokens for w in vocab if (t == w or (t not in vocab and len(t) >= 5 and lev(t, w) <= limit(t)))}
    got = edit_join(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in vocab], "word string"))
    assert {(r["token"], r["word"]) for r in got.collect()} == want


ENTRIES = [
    ("T:1", "Zoritrarnia"), ("T:2", "Zoritrarnia reglouzholus"), ("T:2", "Podoukisia zhotebrourus"), ("T:3", "Zoritrarnia glapaezalus"), ("T:4", "Doutrinogaeraceae"),
    ("T:5", "Bafistavibrio fedricustilmus"), ("T:6", "Bugistavia fedricustilmus"), (None, "Nothing here"), ("T:7", None),
]
NAMES = {
    "Zoritrarnia reglouzholus": "T:2", "UNMAPPED:zoritrarnia_reglouzholus_TRW 61661": "T:2", "VMH:<i>Podoukisia zhotebrourus</i>": "T:2", "Z. glapaezalus": "T:3", "z.glapaezalus": "T:3",
    "ZORITRARNIA GLAPAEZALUS": "T:3", "reglouzholus, Zoritrarnia": "T:2", "Zoritrarnia sp. KX-51748": "T:1", "uncultured Zoritrania sp.": "T:1", "[Zoritrarnia]": "T:1",
    "k__Bacteria;p__;g__Zoritrarnia;s__Zoritrarnia_reglouzholus": "T:2", "g__Zoritrarnia;s__glapaezalus": "T:3", "f__Doutrinogaeraceae": "T:4", "Doutrinogaeraceae bacterium": "T:4",
    "Zoritrarnia reglou  zholus": "T:2", "ZoritrarniaReglouzholus": "T:2", "Zоritrаrniа rеglоuzhоlus": "T:2", "Zoritrárnia reglouzhölus (Momon and Stoubras 1927)": "T:2",
    "Zoritrarnia cf. reglouzolus [closest hit 97%]": "T:2", "B. fedricustilmus": "none", "Bugistavia fedricustilmus": "T:6", "Fustevubacter reglouzholus": "none", "Fustevubacter sp.": "none",
    "OTU-77207": "none", "mixed culture": "none", "bacterium": "none", "x" * 50_000: "none",
}


def test_names_of_all_kinds(spark):
    rows = [(n, 1) for n in NAMES] + [(None, 1), ("  ", 2), ("nan", 3), ("Zoritrarnia reglouzholus", 9)]
    df = spark.createDataFrame(rows, "typed string, score int").selectExpr("*", "1 as name", "2 as id", "3 as word")
    taxa = spark.createDataFrame(ENTRIES, "tid string, label string").selectExpr("*", "1 as first")
    got = {r["name"]: r["id"] for r in resolve(df, "typed", taxa, "tid", "label").collect()}
    assert got == NAMES
    assert resolve(df.limit(0), "typed", taxa, "tid", "label").count() == 0
    assert {r["id"] for r in resolve(df, "typed", taxa.limit(0), "tid", "label").collect()} == {"none"}


@pytest.mark.parametrize("name,words", [("UNMAPPED:[Nimiglivibrio] trorofosiomus", ["nimiglivibrio", "trorofosiomus"]), ("Quaw-_itisia", ["quaw", "itisia"]), ("", [])])
def test_parse(name, words):
    assert parse(name)[0] == words
