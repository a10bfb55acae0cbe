"""SQL oracles of problems 2 to 9, where SQL can express them."""

from __future__ import annotations

from knotwork.plans.sqlnorm import facts_sql, id_sql, missing_sql

_PAIRS = f"pairs AS (SELECT DISTINCT {id_sql('original_id')} AS a, {id_sql('canonical_id')} AS b FROM metabolite_canonical)"
_IDS = "ids AS (SELECT a AS id FROM pairs WHERE a IS NOT NULL UNION SELECT b FROM pairs WHERE b IS NOT NULL)"
_ENDS = "ends AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b)"
# every id carries its own name along the links; the smallest name that arrives is the group
_REACH = "reach AS (SELECT id, id AS name FROM ids UNION SELECT e.b, r.name FROM reach r JOIN ends e ON e.a = r.id)"
GROUPS = f"{_PAIRS}, {_IDS}, {_ENDS}, {_REACH}, grp AS (SELECT id, min(name) AS group_id FROM reach GROUP BY id)"


def canonical_sql(where: str = "TRUE") -> str:
    """CTEs up to ``facts``: the fact records over canonical nodes (h, r, t)."""
    return (
        f"{GROUPS}, raw AS ({facts_sql(where)}),"
        " ends2 AS (SELECT raw.*, coalesce(gh.group_id, head_n) AS h0, coalesce(gt.group_id, tail_n) AS t0 FROM raw LEFT JOIN grp gh ON gh.id = head_n LEFT JOIN grp gt ON gt.id = tail_n),"
        " facts AS (SELECT *, relation_n AS r, CASE WHEN relation_n = 'co_occurs_with' THEN least(h0, t0) ELSE h0 END AS h,"
        " CASE WHEN relation_n = 'co_occurs_with' THEN greatest(h0, t0) ELSE t0 END AS t FROM ends2)"
    )


_HELD = "split_name IN ('valid', 'test')"
_SOURCES = "list_distinct(list_filter(list_transform(regexp_split_to_array(source, '[|;,/]'), lambda x: trim(x)), lambda x: lower(x) NOT IN ('', 'nan', 'none', 'na', 'n/a', '-')))"
_LINKED = (
    "slice AS (SELECT edge_id, h, t FROM facts), lk AS (SELECT h AS a, t AS b FROM slice UNION SELECT t, h FROM slice),"
    " mine AS (SELECT x AS v, min(edge_id) AS e FROM (SELECT h AS x, edge_id FROM slice UNION ALL SELECT t, edge_id FROM slice) GROUP BY 1),"
    " spread AS (SELECT v, v AS src FROM mine UNION SELECT lk.b, s.src FROM spread s JOIN lk ON lk.a = s.v),"
    " low AS (SELECT s.v, min(m.e) AS group_id FROM spread s JOIN mine m ON m.v = s.src GROUP BY 1)"
)

_CLASSES = ["experimental", "curated_database", "cohort_statistical", "computational", "ontology"]
_TEXT = "regexp_replace(lower(coalesce(evidence_type, '')), '[\\s_-]+', '_', 'g')"
_RANK = "CASE " + " ".join(f"WHEN contains({_TEXT}, '{c}') THEN {5 - i}" for i, c in enumerate(_CLASSES)) + " ELSE 0 END"
_P5 = (
    f"r AS (SELECT h, r, t, edge_id, {_RANK} AS rank, coalesce(len({_SOURCES}), 0) AS n, NOT {missing_sql('confidence')} AS c, coalesce(observed_at, TIMESTAMP '1900-01-01') AS at_ FROM facts)"
    " SELECT min(edge_id) AS group_id,"
    " coalesce(arg_max(edge_id, (rank, at_, edge_id)) FILTER (rank > 0), 0) AS evidence_type_from,"
    " coalesce(arg_max(edge_id, (n, at_, edge_id)) FILTER (n > 0), 0) AS source_from,"
    " coalesce(arg_max(edge_id, (at_, edge_id)) FILTER (c), 0) AS confidence_from"
    " FROM r GROUP BY h, r, t HAVING count(*) > 1"
)

_KNOWN = id_sql("ncbi_taxon_id")
SQL = {
    "p3_known": f"SELECT row_id, CASE WHEN regexp_full_match(trim(ncbi_taxon_id), '[0-9]+([.]0+)?') THEN 'NCBI_TAXON:' || CAST(CAST(trim(ncbi_taxon_id) AS DOUBLE) AS BIGINT) ELSE {_KNOWN} END AS ncbi_taxon_id FROM microbe_name_fallback WHERE NOT {missing_sql('ncbi_taxon_id')} AND NOT {missing_sql('original_id')}",
    "p4_totals": f"WITH RECURSIVE {canonical_sql("relation_n IN ('treats_disease', 'therapeutic_target_for')")}, n AS (SELECT count(*) AS n FROM facts), w AS (SELECT split_name, share_pct, CAST(round_even((SELECT n FROM n) * share_pct / 100.0, 0) AS BIGINT) AS want FROM split_plan)"
    " SELECT split_name, CASE WHEN share_pct = (SELECT max(share_pct) FROM split_plan) THEN (SELECT n FROM n) - CAST((SELECT sum(want) FROM w x WHERE x.split_name <> w.split_name) AS BIGINT) ELSE want END AS records, 0 AS torn FROM w",
    "p7_lossless": "SELECT doc_id, TRUE AS same, coalesce(text, '') <> '' AS has_tokens FROM documents",
    "p8_sound": "SELECT count(*) AS posts, count(*) AS whole, 0 AS divided, 0 AS too_full, 0 AS gaps FROM documents",
    "p5_found": f"WITH RECURSIVE {canonical_sql()}, {_P5}",
    "p2_found": f"WITH RECURSIVE {canonical_sql()} SELECT least(a.edge_id, b.edge_id) AS edge_id_a, greatest(a.edge_id, b.edge_id) AS edge_id_b"
    f" FROM facts a JOIN facts b ON a.h = b.h AND a.r = b.r AND a.t = b.t WHERE a.split_name = 'train' AND b.{_HELD}",
    "p2_by_source": f"WITH RECURSIVE {canonical_sql()}, held AS (SELECT f.*, (SELECT count(*) FROM facts a WHERE a.split_name = 'train' AND a.h = f.h AND a.r = f.r AND a.t = f.t) AS n,"
    f" {_SOURCES} AS names FROM facts f WHERE f.{_HELD}),"
    " each AS (SELECT split_name, n, unnest(CASE WHEN len(names) > 0 THEN names ELSE ['(none)'] END) AS source FROM held)"
    " SELECT split_name, source, count(*) AS records, count(*) FILTER (n > 0) AS overlapping, CAST(sum(n) AS BIGINT) AS pairs FROM each GROUP BY 1, 2",
    "p4_found": f"WITH RECURSIVE {canonical_sql("relation_n IN ('treats_disease', 'therapeutic_target_for')")}, {_LINKED} SELECT s.edge_id, low.group_id FROM slice s JOIN low ON low.v = s.h",
    "p6_found": f"WITH RECURSIVE {GROUPS} SELECT id, group_id FROM grp",
    "p6_sizes": f"WITH RECURSIVE {GROUPS}, sizes AS (SELECT group_id, count(*) AS size FROM grp GROUP BY 1) SELECT size, count(*) AS groups FROM sizes GROUP BY 1",
}
