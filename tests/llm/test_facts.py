import pytest
from pyspark.sql import functions as F

from knotwork.llm import facts
from knotwork.session import Scratch

ROWS = [
    (1, "CHEBI:1", "metabolite", "treats_disease", "D900000001", "disease"), (2, "hmdb:hmdb0000001", None, "treats disease", "MESH:D900000001", "disease"), (3, "NCBI_TAXON:5", "microbe", "co_occurs_with", "NCBI_TAXON:4", "microbe"),
    (4, "CHEBI:1", "metabolite", "co_occurs_with", "PUBCHEM:7", "metabolite"), (5, "NCBI_TAXON:5", "microbe", "produces", "KEGG:C00000009", "metabolite"), (6, None, None, "produces", "CHEBI:1", "metabolite"),
]


@pytest.mark.parametrize("small", [True, False])
def test_compounds_go_by_their_group(spark, monkeypatch, small):
    monkeypatch.setattr(facts, "SPREAD", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m" if small else "-1")
    edges = spark.createDataFrame(ROWS, "edge_id bigint, head_id string, head_type string, relation string, tail_id string, tail_type string")
    scratch = Scratch(spark, "t")
    groups = scratch.put(spark.createDataFrame([("HMDB:HMDB0000001", "CHEBI:1"), ("PUBCHEM:7", "CHEBI:0")], "id string, group_id string"))
    got = facts.canonical_facts(edges, groups, {"edge_id": F.col("edge_id")}).collect()
    assert {r["edge_id"]: (r["head_n"], r["relation_n"], r["tail_n"]) for r in got} == {
        1: ("CHEBI:1", "treats_disease", "D900000001"), 2: ("CHEBI:1", "treats_disease", "D900000001"), 3: ("NCBI_TAXON:4", "co_occurs_with", "NCBI_TAXON:5"),
        4: ("CHEBI:0", "co_occurs_with", "CHEBI:1"), 5: ("NCBI_TAXON:5", "produces", "KEGG:C00000009"),
    }
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert facts.canonical_facts(edges.limit(0), groups, {"edge_id": F.col("edge_id")}).count() == 0


def test_one_lookup_gives_the_same_facts(spark, monkeypatch):
    """No, one and two compound ends, ends without a group, the same compound at both ends."""
    monkeypatch.setattr(facts, "SPREAD", 2)
    more = [(7, "PUBCHEM:7", "metabolite", "is_a", "hmdb:hmdb0000001", "metabolite"), (8, "PUBCHEM:7", "metabolite", "is_a", "PUBCHEM:7", "metabolite"), (9, "CHEBI:5", "metabolite", "co_occurs_with", "NCBI_TAXON:4", "microbe"), (10, "PUBCHEM:7", "metabolite", "co_occurs_with", "CHEBI:9", "metabolite")]
    edges = spark.createDataFrame(ROWS + more, "edge_id bigint, head_id string, head_type string, relation string, tail_id string, tail_type string")
    groups = Scratch(spark, "t").put(spark.createDataFrame([("HMDB:HMDB0000001", "CHEBI:1"), ("PUBCHEM:7", "CHEBI:0")], "id string, group_id string"))
    columns = ["edge_id", "relation_n", "head_n", "tail_n"]
    want = sorted(map(tuple, facts.canonical_facts(edges, groups, {"edge_id": F.col("edge_id")}).select(columns).collect()))
    assert sorted(map(tuple, facts.facts_looked_up_once(edges, groups, {"edge_id": F.col("edge_id")}).select(columns).collect())) == want
    assert [r[2:] for r in want if r[0] in (7, 8)] == [("CHEBI:0", "CHEBI:1"), ("CHEBI:0", "CHEBI:0")]
