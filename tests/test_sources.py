import datetime
import gzip

import pytest

from knotwork.sources import delimited as D
from knotwork.streaming import edge_stream, merged_counts


def test_tsv_keeps_blanks_and_reads_gzip(spark, tmp_path):
    df = spark.createDataFrame([("a", ""), ("b\tc", 'say "x"')], "p string, q string")
    D.write_tsv(df, f"file://{tmp_path}/t")
    assert sorted(tuple(r) for r in D.read_tsv(spark, f"file://{tmp_path}/t").collect()) == [("a", ""), ("b\tc", 'say "x"')]
    with gzip.open(tmp_path / "z.tsv.gz", "wt") as f:
        f.write("# note\n1\tx\n2\t\n")
    assert [tuple(r) for r in D.read_tsv(spark, f"file://{tmp_path}/z.tsv.gz", ["i", "v"], header=False, comment="#").collect()] == [("1", "x"), ("2", "")]
    assert D.read_optional(spark, f"file://{tmp_path}/none.tsv", ["i", "v"]).columns == ["i", "v"]
    assert D.exists(spark, f"file://{tmp_path}/t") and not D.exists(spark, f"file://{tmp_path}/u")


def test_other_sources_and_sinks(spark, tmp_path):
    for name in ("one", "two", "skip"):
        (tmp_path / f"{name}.tsv").write_text(f"a\tb\n{name}\t1\n")
    got = D.read_all_but(spark, f"file://{tmp_path}/*.tsv", "skip.tsv", ["a", "b"]).filter("a <> 'a'")
    assert sorted(r["a"] for r in got.collect()) == ["one", "two"]
    (tmp_path / "r.json").write_text('{"model": "RA", "ranking": {"mrr": 0.5}}')
    r = D.read_results(spark, f"file://{tmp_path}/r.json").first()
    assert (r["ranking"]["mrr"], r["file_name"]) == (0.5, "r.json")
    lines = spark.createDataFrame([("a|b|c",), ("#x|y|z",), ("a|b",), (None,)], "line string")
    assert [r["fields"] for r in D.parse_lines(lines, "line", "|", 3).collect()] == [["a", "b", "c"]]
    D.write_ids(lines.filter("line IS NOT NULL"), "line", f"file://{tmp_path}/ids")
    D.write_csv(spark.createDataFrame([(1, 2)], "x int, y int"), f"file://{tmp_path}/c", ["y", "x"])
    assert D.read_csv(spark, f"file://{tmp_path}/c").columns == ["y", "x"]
    D.write_results(spark.createDataFrame([(1,)], "x int"), f"file://{tmp_path}/j")
    assert D.markdown(spark.createDataFrame([(1, None)], "x int, y string")).endswith("| 1 | - |")
    assert D.report({"s": {"k": 1}}) == "[s]\nk\t1\n"
    (tmp_path / "x.xml").write_text("<l><s id='1'><n>a</n></s><s id='2'><n>b</n></s></l>")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("n", T.StringType())])
    assert D.read_xml(spark, f"file://{tmp_path}/x.xml", "s", schema).count() == 2


def test_stream_gives_the_batch_counts(spark, tmp_path):
    t = datetime.datetime(2024, 1, 5)
    rows = [(i, f"NCBI_TAXON:{i + 1}", "microbe", "isA" if i % 2 else "produces", "D900000001", "disease", t) for i in range(10)] + [(3, "NCBI_TAXON:4", "microbe", "isA", "D900000001", "disease", t), (99, "x", None, "produces", None, None, t), (98, "NCBI_TAXON:1", "microbe", "produces", "D900000001", "disease", None)]
    raw = spark.createDataFrame(rows, "edge_id bigint, head_id string, head_type string, relation string, tail_id string, tail_type string, observed_at timestamp")
    raw.write.parquet(f"file://{tmp_path}/in")
    q = merged_counts(edge_stream(spark, f"file://{tmp_path}/in")).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.awaitTermination(120)
    want = sorted((r["relation"], r["n"]) for r in merged_counts(raw).collect())
    assert sorted((r["relation"], r["n"]) for r in spark.table("counts").collect()) == want == [("is_a", 5), ("produces", 5)]


def test_raw_rows_and_small_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", None)], "pair string, scores double")
    D.write_raw(df, f"file://{tmp_path}/raw")
    got = D.read_raw(spark, f"file://{tmp_path}/raw", {"score": ["score", "scores"], "pair": ["pair"], "label": ["y", "label"]})
    assert got.columns == ["score", "pair"] and [tuple(r) for r in got.collect()] == [(1.0, "a")]
    assert "| b |" in D.markdown(df.select("pair"))
    with pytest.raises(ValueError):
        D.markdown(df, 2)
