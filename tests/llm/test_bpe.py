import random

import pytest
from pyspark.sql import functions as F

from knotwork.llm import bpe
from knotwork.llm.encode import BYTE_BPE_50K, PIECES, decode, encode

ODD = ["", " ", "\n\n \t", "<|endoftext|>", "it's 'RE  don't", "漢字かな", "é̂", "👩‍🔬🧫", "a" * 3000, "=" * 999 + " x", "0123456789" * 30, "\x00\x01\x7f", "naïve café — “quoted”"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(BYTE_BPE_50K)
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_reference_library_and_exact_round_trip(reference):
    coder = bpe.load(BYTE_BPE_50K, PIECES)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aabcdeehilnorst TH.,'é漢\n") for _ in range(rng.randrange(1, 300))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x1F300, 0x1F900)])) for _ in range(200)) for _ in range(40)]
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [coder.encode(t) for t in texts] == want
    assert [coder.decode(i) for i in want] == texts


def test_operator(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (100, "again"), (None, "x")]
    df = spark.createDataFrame(rows, "k bigint, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    out = encode(df, "k", "text")
    assert out.columns == ["k", "ids"] and out.count() == len(rows)
    got = {r["k"]: r["ids"] for r in out.filter("k < 100").collect()}
    assert got[0] == [] and got[1] and [r["ids"] for r in out.filter("size(ids) = 0").collect()] == [[], []]
    back = {r["k"]: r["text"] for r in decode(out.filter("k < 100"), "k").collect()}
    assert [back[i] for i in range(len(ODD))] == ODD
    counts = encode(df, "k", "text", ids=False)
    assert counts.agg(F.sum("n_tokens")).first()[0] == out.agg(F.sum(F.size("ids"))).first()[0]
    assert encode(df.limit(0), "k", "text").count() == 0
