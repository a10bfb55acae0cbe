"""Normal forms of node ids and relation names, as column expressions.

A node id is ``NS:value`` or a bare disease id.  Most ids arrive in normal
form, so one anchored match lets them pass; the chain of clean-up expressions
runs only for the rest.  Everything stays in generated JVM code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.missing import is_missing, plain

_SEP = r"\s*[:|_ ]\s*"
_INT = r"0*([0-9]+?)(?:\.0+)?$"
# Spellings of the name spaces and the shape of the values, with the normal form each is turned into.
RULES = [
    (rf"^(?i:(?:NCBI[_ ]?TAXON|TAXID){_SEP})+{_INT}", "NCBI_TAXON:$1"),
    (rf"^(?i:CHEBI{_SEP})+{_INT}", "CHEBI:$1"),
    (rf"^(?i:(?:PUBCHEM|CID){_SEP})+{_INT}", "PUBCHEM:$1"),
    (rf"^(?i:O?MIM{_SEP})+{_INT}", "OMIM:$1"),
    (rf"^(?i:INTERVENTION{_SEP})+{_INT}", "INTERVENTION:$1"),
    (rf"^(?i:(?:HMDB{_SEP})*HMDB)([0-9]{{7}})$", "HMDB:HMDB$1"),
    (rf"^(?i:(?:(?:KEGG|CPD){_SEP})*C)\s*([0-9]{{8}})$", "KEGG:C$1"),
    (rf"^(?i:(?:MESH{_SEP})*D)\s*([0-9]{{9}})$", "D$1"),
    (r"^[Cc]\s*([0-9]{9})$", "C$1"),
    (rf"^(?i:MESH{_SEP})+[Cc]\s*([0-9]{{9}})$", "MESH:C$1"),
    (rf"^(?i:VMH_MET{_SEP})+(.+)$", "VMH_MET:$1"),
    (rf"^(?i:HGNC{_SEP})+(.+)$", "HGNC:$1"),
    (rf"^(?i:UNMAPPED{_SEP})+(.+)$", "UNMAPPED:$1"),
]
_HGNC = r"^(?i)[^A-Z]*H[^A-Z]*G[^A-Z]*N[^A-Z]*C[^A-Z]"
_MESH = r"^(?i)(?:[^A-Z]*M[^A-Z]*E[^A-Z]*S[^A-Z]*H[^A-Z]*)+(?=[CD])"
_MESH_C = (rf"^(?i:MESH{_SEP})+[Cc]\s*([0-9]{{9}})$", "C$1")
JUNK = r"^[\s\"'\[(]+|[\s\"'\]);,]+$"
#: ids already in normal form whatever the node type
NORMAL = (
    r"^(?:NCBI_TAXON:[1-9][0-9]*|[DC][0-9]{9}|OMIM:[1-9][0-9]*|HMDB:HMDB[0-9]{7}|(?:CHEBI|PUBCHEM):[1-9][0-9]*"
    r"|KEGG:C[0-9]{8}|VMH_MET:[A-Za-z0-9]+|HGNC:[A-Z0-9]+|INTERVENTION:[1-9][0-9]*)$"
)
COMPOUND = r"^(?:HMDB|CHEBI|PUBCHEM|KEGG|MESH|VMH_MET):"

# The relations of the graph, in normal form.
RELATIONS = [
    "associated_with_disease", "associated_with_metabolite", "belongs_to_class", "belongs_to_family", "belongs_to_genus",
    "belongs_to_order", "belongs_to_phylum", "can_utilize", "co_occurs_with", "depleted_in", "does_not_produce",
    "does_not_utilize", "downregulates_gene", "enriched_in", "inconsistent_association", "intervention_decreases",
    "intervention_increases", "is_a", "is_strain_of", "produces", "therapeutic_target_for", "treats_disease",
    "upregulates_gene", "utilizes",
]


def normal_id(col: Column, disease: Column | None = None) -> Column:
    """Normal form of a node id; null where it is missing.

    ``disease`` tells whether ``MESH:C...`` names a disease (else a compound).
    An id of no known shape keeps its cleaned text.  Each step refers to the
    one before it once, so that the generated code stays small.
    """
    raw = F.when(col.rlike(_HGNC), F.upper(col))
    if disease is not None:
        # without its prefix, a C id is a disease's
        raw = raw.when(col.rlike(_MESH) & disease, F.regexp_replace(col, _MESH, ""))

    def clean(x: Column) -> Column:
        out = F.regexp_replace(plain(x), JUNK, "")
        for pattern, form in RULES:
            out = F.regexp_replace(out, pattern, form)
        return out

    # the chain stands in a lambda: it is rarely needed, and unrolled into the
    # generated code it would make methods too large for the JVM to compile
    slow = F.transform(F.array(raw.otherwise(col)), clean)[0]
    return F.when(col.rlike(NORMAL), col).when(is_missing(col), F.lit(None)).otherwise(slow)


def normal_relation(col: Column) -> Column:
    """Relation name in lower case with underscores; null where missing."""
    text = plain(col)
    snake = F.lower(F.regexp_replace(F.regexp_replace(text, r"^(?i:biolink)\s*:\s*", ""), r"([a-z0-9])([A-Z])", "$1_$2"))
    joined = F.regexp_replace(F.regexp_replace(snake, r"[\s\-_]+", "_"), "^_+|_+$", "")
    return F.when(col.isin(RELATIONS), col).when(is_missing(col), F.lit(None)).otherwise(joined)


def is_compound(normal: Column) -> Column:
    return normal.rlike(COMPOUND)


def fact_columns(edges: DataFrame) -> DataFrame:
    """Edges that state a fact, with ``relation_n``, ``head_n`` and ``tail_n`` in normal form.

    Rows whose head, relation or tail is missing state no fact and are left out.
    """
    stated = edges.filter(~is_missing(F.col("head_id")) & ~is_missing(F.col("relation")) & ~is_missing(F.col("tail_id")))
    named = stated.withColumn("relation_n", normal_relation(F.col("relation")))
    disease = lambda kind: F.coalesce((F.lower(F.col(kind)) == "disease") | F.col("relation").rlike(r"^(?i)(?:biolink:)?\s*is[\s_-]*a\s*$"), F.lit(False))
    return named.withColumns({"head_n": normal_id(F.col("head_id"), disease("head_type")), "tail_n": normal_id(F.col("tail_id"), disease("tail_type"))})
