import pytest
from pyspark.sql import functions as F

from knotwork.functions import scalars as S
from knotwork.functions.ids import fact_columns, normal_id, normal_relation
from knotwork.functions.missing import is_missing, plain

IDS = {
    "NCBI_TAXON:7000001": "NCBI_TAXON:7000001", "ncbi taxon:007000001": "NCBI_TAXON:7000001", "NCBITaxon_7000001": "NCBI_TAXON:7000001", "NCBI_TAXON|7000001": "NCBI_TAXON:7000001", "taxid:7000001.0": "NCBI_TAXON:7000001",
    "NCBI_TAXON:７０００００１": "NCBI_TAXON:7000001", "NCB​I_TAXON:7000001;": "NCBI_TAXON:7000001", "[NCBI_TAXON:7000001]": "NCBI_TAXON:7000001", "NCBI_TAXON：7000001 ": "NCBI_TAXON:7000001",
    "hmdb:hmdb1019812": "HMDB:HMDB1019812", "HMDB1019812": "HMDB:HMDB1019812", "HMDB:HMDB:HMDB1019812": "HMDB:HMDB1019812", "chebi:CHEBI:700076254": "CHEBI:700076254", "CHEBI_700": "CHEBI:700", "CHEBI:0": "CHEBI:0",
    "PUBCHEM:CID:0800": "PUBCHEM:800", "CID:12.0": "PUBCHEM:12", "KEGG:cpd:C80195673": "KEGG:C80195673", "kegg c80195673": "KEGG:C80195673", "mesh C500055469": "MESH:C500055469", "MESH:MESH:D900063115": "D900063115",
    "d 900007450": "D900007450", "c900116320": "C900116320", "MIM:900096655": "OMIM:900096655", "hgnc:bdbn00": "HGNC:BDBN00", "﻿HGNC:BIZD00": "HGNC:BIZD00", "vmh_met:deNi00x4": "VMH_MET:deNi00x4", "INTERVENTION:010": "INTERVENTION:10",
    "UNMAPPED:Baecadontia sp. Z00-258": "UNMAPPED:Baecadontia sp. Z00-258", "": None, "  ": None, "NaN": None, "n/a": None, "-": None, None: None, "odd thing": "odd thing",
}


def test_normal_ids(spark):
    df = spark.createDataFrame([(k,) for k in IDS], "x string")
    assert {r["x"]: r["n"] for r in df.select("x", normal_id(F.col("x")).alias("n")).collect()} == IDS
    # the prefix says compound unless the node is a disease
    both = spark.createDataFrame([("MESH:C900044060", True), ("MESH:C900044060", False), ("mesh:mesh:c900044060", True), ("MeSH D900117330", True)], "x string, d boolean")
    assert [r[0] for r in both.select(normal_id(F.col("x"), F.col("d"))).collect()] == ["C900044060", "MESH:C900044060", "C900044060", "D900117330"]


@pytest.mark.parametrize("raw,want", [("canUtilize", "can_utilize"), ("CAN_UTILIZE", "can_utilize"), (" Can Utilize", "can_utilize"), ("can__utilize", "can_utilize"), ("biolink:is_a", "is_a"), ("is-a ", "is_a"), ("isA", "is_a"), ("none", None), (None, None)])
def test_relations(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(normal_relation(F.col("x"))).first()[0] == want


def test_facts_leave_out_missing_parts(spark):
    rows = [("D900000001", None, "is_a", "MESH:C900000002", "disease"), ("D900000001", "disease", "is_a", "nan", "disease"), (None, None, "is_a", "D900000002", None), ("D900000001", None, "", "D900000002", None)]
    df = spark.createDataFrame(rows, "head_id string, head_type string, relation string, tail_id string, tail_type string")
    assert [(r["head_n"], r["relation_n"], r["tail_n"]) for r in fact_columns(df).collect()] == [("D900000001", "is_a", "C900000002")]
    assert fact_columns(df.limit(0)).count() == 0


def test_missing_and_plain(spark):
    df = spark.createDataFrame([("ＡＢ​ ",), (" N/A ",), ("na",), ("nan x",)], "x string")
    assert [tuple(r) for r in df.select(plain(F.col("x")), is_missing(F.col("x"))).collect()] == [("AB", False), ("N/A", True), ("na", True), ("nan x", False)]


def test_scalar_normalizers(spark):
    df = spark.createDataFrame([("CHEBI:CHEBI:00123", "CID:12.0", "hmdb:hmdb0000001", "NaN", "abc")], "a string, b string, c string, d string, e string")
    got = df.select(S.chebi(F.col("a")), S.pubchem(F.col("b")), S.hmdb(F.col("c")), S.chebi(F.col("d")), S.hmdb(F.col("e")), S.hmdb_padded(F.lit("HMDB12")), S.hmdb_padded(F.lit("123456789")), S.percent(F.lit(1), F.lit(0))).first()
    assert list(got) == ["CHEBI:123", "PUBCHEM:12", "HMDB:HMDB0000001", "", "", "HMDB:HMDB0000012", "HMDB:HMDB123456789", "-"]
