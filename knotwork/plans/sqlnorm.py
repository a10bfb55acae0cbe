"""The normal forms of ``functions.ids`` as ANSI SQL text, for the oracles."""

from __future__ import annotations

from knotwork.functions import ids, missing


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """Java pattern -> RE2 (the few constructs used here)."""
    return pattern.replace("^(?i)", "(?i)^").replace("[^A-Z]*", "[^A-Za-z]*").replace("[^A-Z]", "[^A-Za-z]") if "(?i)" in pattern else pattern


def missing_sql(col: str) -> str:
    return f"({col} IS NULL OR regexp_full_match({col}, {_q('(?i)' + missing.MISSING.replace('(?i)', '').lstrip('^').rstrip('$'))}))"


def plain_sql(col: str) -> str:
    return f"trim(translate({col}, {_q(missing.TRANSLATE_FROM)}, {_q(missing.TRANSLATE_TO)}))"


def id_sql(col: str, disease: str | None = None) -> str:
    base = f"CASE WHEN regexp_matches({col}, {_q(_re2(ids._HGNC))}) THEN upper({col}) ELSE {col} END"
    out = f"regexp_replace({plain_sql(base)}, {_q(ids.JUNK)}, '', 'g')"
    if disease:
        out = f"CASE WHEN {disease} THEN regexp_replace({out}, {_q(ids._MESH_C[0])}, 'C\\1') ELSE {out} END"
    for pattern, form in ids.RULES:
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(form.replace('$1', chr(92) + '1'))})"
    return f"CASE WHEN {missing_sql(col)} THEN NULL ELSE {out} END"


def relation_sql(col: str) -> str:
    text = plain_sql(col)
    snake = f"lower(regexp_replace(regexp_replace({text}, '(?i)^biolink\\s*:\\s*', ''), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
    return f"CASE WHEN {missing_sql(col)} THEN NULL ELSE regexp_replace(regexp_replace({snake}, '[\\s\\-_]+', '_', 'g'), '^_+|_+$', '', 'g') END"


def facts_sql(where: str = "TRUE") -> str:
    """A query: the columns of final_kg_edges with relation_n, head_n, tail_n; facts only."""
    head = id_sql("head_id", "(relation_n = 'is_a' OR lower(coalesce(head_type, '')) = 'disease')")
    tail = id_sql("tail_id", "(relation_n = 'is_a' OR lower(coalesce(tail_type, '')) = 'disease')")
    return (
        f"SELECT * FROM (SELECT *, {head} AS head_n, {tail} AS tail_n FROM (SELECT *, {relation_sql('relation')} AS relation_n FROM final_kg_edges)"
        f" WHERE relation_n IS NOT NULL AND ({where})) WHERE head_n IS NOT NULL AND tail_n IS NOT NULL"
    )
