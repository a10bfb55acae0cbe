"""Queries of problems 2 to 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.missing import is_missing, or_null, plain
from knotwork.llm import sql
from knotwork.llm.assignment import assign, linked_groups
from knotwork.llm.facts import canonical_facts, facts_looked_up_once
from knotwork.llm.grouping import compound_groups, write_groups
from knotwork.llm.encode import decode, encode
from knotwork.llm.names import NONE, resolve
from knotwork.llm.overlap import contained, gram_hash, record_hits
from knotwork.llm.packing import pack
from knotwork.llm.residue import residue
from knotwork.llm.survivor import Field, fuse, preferred, preference
from knotwork.session import Scratch, shared_table
from knotwork.sources import table, version

# The relations of the slice that problem 4 asks for.
SLICE = ["treats_disease", "therapeutic_target_for"]
# The splits that are held out.
HELD_OUT = ["valid", "test"]
_ENDS = ["head_id", "head_type", "relation", "tail_id", "tail_type"]


def _fact_words() -> list:
    return [F.col("head_n"), F.col("relation_n"), F.col("tail_n")]


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """The compound groups, once per session and state of its files: problems 2, 4 and 5 share the table."""
    return shared_table(spark, f"groups:{version(spark, d, 'metabolite_canonical')}", lambda scratch: write_groups(scratch, table(spark, d, "metabolite_canonical")))


def _split_facts(spark: SparkSession, d: str, more: list[str] = []) -> tuple[Scratch, DataFrame]:  # noqa: B006
    scratch = Scratch(spark, "p2")
    edges = table(spark, d, "final_kg_edges").select("edge_id", "split_name", *_ENDS, *more).filter(F.col("split_name").isin("train", *HELD_OUT))
    return scratch, canonical_facts(edges, _groups(spark, d), {"edge_id": F.col("edge_id"), "split_name": F.col("split_name")} | {c: F.col(c) for c in more})


def _keyed_facts(spark: SparkSession, d: str, more: list[str] = []) -> DataFrame:  # noqa: B006
    """Split records with the 128-bit key of their fact, written once: the evaluation and the training side both read it."""
    scratch, facts = _split_facts(spark, d, more)
    # a fact is three words, fewer than a five-word gram: its one gram is the whole fact
    gram = gram_hash(F.array(*_fact_words()))
    return scratch.put(facts.select("edge_id", "split_name", *more, gram["x"].alias("x"), gram["y"].alias("y")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train record and a held-out record that state the same fact."""
    keyed = _keyed_facts(spark, d)
    held = keyed.filter(F.col("split_name").isin(HELD_OUT)).select("x", "y", F.col("edge_id").alias("held_id"))
    train = keyed.filter(F.col("split_name") == "train").select("x", "y", F.col("edge_id").alias("train_id"))
    return record_hits(held, train, ["x", "y"]).select(F.least("train_id", "held_id").alias("edge_id_a"), F.greatest("train_id", "held_id").alias("edge_id_b"))


def p2_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Per held-out split and source: records, records that train states too, and pairs.

    A record counts once for each distinct source it names; `(none)` where it
    names none.  Train records are counted per fact, so no pair is made.
    """
    keyed = _keyed_facts(spark, d, ["source"])
    names = F.array_distinct(F.filter(F.transform(F.split("source", r"[|;,/]"), lambda x: F.trim(x)), lambda x: ~F.lower(x).isin("", "nan", "none", "na", "n/a", "-")))
    held = keyed.filter(F.col("split_name").isin(HELD_OUT)).select("x", "y", "split_name", F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("(none)"))).alias("names"))
    stated = keyed.filter(F.col("split_name") == "train").groupBy("x", "y").agg(F.count("*").alias("pairs"))
    each = held.join(stated, ["x", "y"], "left").select("split_name", F.explode("names").alias("source"), "pairs")
    return each.groupBy("split_name", "source").agg(F.count("*").alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def p2_contained(spark: SparkSession, d: str) -> DataFrame:
    """Every held-out record that train contains: its class of equal facts and the train records of the class."""
    _, facts = _split_facts(spark, d)
    links, members = contained(facts.select("edge_id", "split_name", F.array(*_fact_words()).alias("words")), "edge_id", "words", "split_name")
    per = members.groupBy("class_x", "class_y").agg(F.count_if(F.col("split") == "train").alias("n"))
    hits = links.join(per.select(F.col("class_x").alias("train_x"), F.col("class_y").alias("train_y"), "n"), ["train_x", "train_y"]).groupBy("eval_x", "eval_y").agg(F.max("containment").alias("containment"), F.sum("n").alias("train_records"))
    held = members.filter(F.col("split").isin(HELD_OUT)).select(F.col("record_id").alias("edge_id"), F.col("class_x").alias("eval_x"), F.col("class_y").alias("eval_y"))
    return held.join(hits, ["eval_x", "eval_y"]).select("edge_id", F.hex("eval_x").alias("class_id"), "containment", "train_records")


#: one post in so many is held out
POSTS_HELD = 50


def p2_posts(spark: SparkSession, d: str) -> DataFrame:
    """Held-out posts (every 50th doc_id) that another post contains by five-word grams to 0.8 or more: class, best containment, posts that contain it."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    posts = table(spark, d, "documents").select("doc_id", words.alias("words"), F.when(F.col("doc_id") % POSTS_HELD == 0, "test").otherwise("train").alias("split"))
    scratch = Scratch(spark, "posts")
    links, members = contained(posts, "doc_id", "words", "split", scratch=scratch)
    per = members.filter("split = 'train'").groupBy("class_x", "class_y").agg(F.count("*").alias("n"))
    hits = links.join(per.select(F.col("class_x").alias("train_x"), F.col("class_y").alias("train_y"), "n"), ["train_x", "train_y"]).groupBy("eval_x", "eval_y").agg(F.max("containment").alias("containment"), F.sum("n").alias("train_posts"))
    held = members.filter("split = 'test'").select(F.col("record_id").alias("doc_id"), F.col("class_x").alias("eval_x"), F.col("class_y").alias("eval_y"))
    return held.join(hits, ["eval_x", "eval_y"]).select("doc_id", F.hex("eval_x").alias("class_id"), F.round("containment", 6).alias("containment"), "train_posts")


def _p4(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "p4")
    edges = table(spark, d, "final_kg_edges").select("edge_id", *_ENDS)
    facts = canonical_facts(edges, _groups(spark, d), {"edge_id": F.col("edge_id")}, SLICE)
    return scratch.put(linked_groups(scratch, facts, "edge_id", "head_n", "tail_n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Group of every record of the slice: the records that must share its split."""
    return _p4(spark, d).select(F.col("record_id").alias("edge_id"), "group_id")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every record of the slice, in the proportions of split_plan."""
    return assign(_p4(spark, d), table(spark, d, "split_plan")).select(F.col("record_id").alias("edge_id"), "group_id", "split_name")


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Records of every split, and groups that are torn apart (none)."""
    out = p4_splits(spark, d)
    torn = out.groupBy("group_id").agg(F.min("split_name").alias("a"), F.max("split_name").alias("b"))
    per = out.groupBy("split_name").agg(F.count("*").alias("records"))
    cut = torn.filter("a <> b").select(F.col("a").alias("split_name")).groupBy("split_name").agg(F.count("*").alias("torn"))
    return per.join(cut, "split_name", "left").select("split_name", "records", F.coalesce("torn", F.lit(0)).alias("torn"))


# Evidence classes, the strongest first.
EVIDENCE_CLASSES = ["experimental", "curated_database", "cohort_statistical", "computational", "ontology"]
# Confidences given as words.
CONFIDENCE_WORDS = {"high": 0.9, "medium": 0.6, "low": 0.3}


def _strongest(col):
    """Rank (5 is the strongest) of the strongest evidence class that a list names; null if it names none."""
    text = F.translate(F.lower(plain(col)), " -", "__")
    out = F.when(F.contains(text, F.lit(EVIDENCE_CLASSES[0])), F.lit(5))
    for i, name in enumerate(EVIDENCE_CLASSES[1:], 1):
        out = out.when(F.contains(text, F.lit(name)), F.lit(5 - i))
    return out


def _source_names(col):
    """Distinct source names of a list in any notation, without words for "no value"."""
    parts = F.transform(F.split(F.lower(plain(col)), r"[|;,/]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: ~x.isin("", "nan", "none", "na", "n/a", "-", "null")))


def confidence_value(col):
    """A confidence in [0, 1] from any notation: 0.71, 0,71, 85%, 4/5, 1e-3, high; null if it is none."""
    text = F.regexp_replace(F.lower(plain(col)), r"\s+", "")
    number = F.regexp_replace(text, ",", ".")
    ratio = F.split(number, "/")
    words = F.create_map(*[F.lit(x) for kv in CONFIDENCE_WORDS.items() for x in kv])
    return (
        F.when(number.rlike(r"^[0-9.]+%$"), F.regexp_replace(number, "%", "").try_cast("double") / 100)
        .when(number.rlike(r"^[0-9.]+/[0-9.]+$"), F.try_divide(ratio[0].try_cast("double"), F.get(ratio, F.lit(1)).try_cast("double")))
        .otherwise(F.coalesce(number.try_cast("double"), F.element_at(words, text)))
    )


def _repeated(spark: SparkSession, d: str) -> tuple[Scratch, DataFrame]:
    """Records of facts stated more than once, with the fact's smallest edge_id.

    Only keys travel until the repeated facts are known; then their records'
    attributes are fetched.
    """
    scratch = Scratch(spark, "p5")
    edges = table(spark, d, "final_kg_edges")
    facts = facts_looked_up_once(edges.select("edge_id", *_ENDS), _groups(spark, d), {"edge_id": F.col("edge_id")})
    gram = gram_hash(F.array(*_fact_words()))
    keyed = scratch.put(facts.select(gram["x"].alias("x"), gram["y"].alias("y"), "edge_id"))
    twice = keyed.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("edge_id").alias("group_id")).filter("n > 1").drop("n")
    ids = scratch.put(keyed.join(scratch.put(twice), ["x", "y"]).select("edge_id", "group_id"))
    attributes = edges.select("edge_id", "evidence_type", "source", "confidence", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at"))
    rows = attributes.join(ids, "edge_id").select("edge_id", "group_id", "evidence_type", _source_names(F.col("source")).alias("names"), or_null(F.col("confidence")).alias("confidence"), "at")
    # every field is computed once, as it is written
    value = F.coalesce(F.format_string("%.3f", confidence_value(F.col("confidence"))), F.lower("confidence"))
    return scratch, scratch.put(rows.select("edge_id", "group_id", _strongest(F.col("evidence_type")).cast("int").alias("rank"), F.sort_array("names").alias("names"), F.when(F.col("confidence").isNotNull(), value).alias("value"), "at"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Of each repeated fact, the records that evidence_type, source and confidence are taken from.

    The rule orders the values of all three fields without ties, so no vote
    can decide and only numbers travel: rank, size of the list, whether there
    is a confidence, and time.
    """
    edges = table(spark, d, "final_kg_edges")
    n = F.size(F.coalesce(_source_names(F.col("source")), F.array().cast("array<string>")))
    keep = {"edge_id": F.col("edge_id"), "rank": _strongest(F.col("evidence_type")).cast("tinyint"), "n": F.when(n > 0, n), "told": F.when(~is_missing(F.col("confidence")), True), "at": F.unix_micros(F.col("observed_at").cast("timestamp"))}
    facts = facts_looked_up_once(edges, _groups(spark, d), keep)
    gram = gram_hash(F.array(*_fact_words()))
    rows = facts.select(gram["x"].alias("x"), gram["y"].alias("y"), *keep)
    # a confidence is taken from the newest record: time and edge_id are its whole preference
    fields = [Field("evidence_type", F.col("rank"), F.col("rank")), Field("source", F.col("n"), F.col("n")), Field("confidence", F.col("told"), F.col("told"))]
    best = preferred(rows, ["x", "y"], "edge_id", F.col("at"), fields, stated=F.count("*"), group_id=F.min("edge_id")).filter("stated > 1")
    return best.select("group_id", *[F.coalesce(f"{f.name}_from", F.lit(0)).cast("bigint").alias(f"{f.name}_from") for f in fields])


def p5_fused(spark: SparkSession, d: str) -> DataFrame:
    """Of each repeated fact, the evidence class, sources and confidence of largest posterior, by votes alone."""
    scratch, rows = _repeated(spark, d)
    classes = F.element_at(F.array(*[F.lit(c) for c in reversed(EVIDENCE_CLASSES)]), F.col("rank"))
    fields = [
        Field("evidence_type", F.when(F.col("rank").isNotNull(), classes), preference()),
        Field("source", F.when(F.size(F.coalesce("names", F.array().cast("array<string>"))) > 0, F.array_join("names", "|")), preference()),
        Field("confidence", F.col("value"), preference()),
    ]
    best, _ = fuse(scratch, rows, ["group_id"], "edge_id", F.col("at"), F.col("names"), fields)
    return best.select("group_id", "field", "value", "record_id", F.round("posterior", 6).alias("posterior"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every compound id."""
    return compound_groups(table(spark, d, "metabolite_canonical"))


def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p6_found(spark, d).groupBy("group_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The taxon that each typed name without one means, or none."""
    rows = table(spark, d, "microbe_name_fallback").filter(is_missing(F.col("ncbi_taxon_id"))).select("row_id", "original_id")
    meant = resolve(rows, "original_id", table(spark, d, "taxon_names"), "ncbi_taxon_id", "name_txt")
    return rows.join(meant, F.col("original_id") == F.col("name"), "left").select("row_id", F.coalesce("id", F.lit(NONE)).alias("ncbi_taxon_id"))


def p3_known(spark: SparkSession, d: str) -> DataFrame:
    """The taxon found for the names that come with one, which the operator does not see: a check against labels."""
    rows = table(spark, d, "microbe_name_fallback").filter(~is_missing(F.col("ncbi_taxon_id")) & ~is_missing(F.col("original_id"))).select("row_id", "original_id")
    meant = resolve(rows, "original_id", table(spark, d, "taxon_names"), "ncbi_taxon_id", "name_txt")
    return rows.join(meant, F.col("original_id") == F.col("name"), "left").select("row_id", F.coalesce("id", F.lit(NONE)).alias("ncbi_taxon_id"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The typed names that mean no entry, with the number of rows."""
    rows = table(spark, d, "microbe_name_fallback").filter(is_missing(F.col("ncbi_taxon_id")))
    return p3_found(spark, d).filter(F.col("ncbi_taxon_id") == NONE).join(rows.select("row_id", "original_id"), "row_id").groupBy("original_id").agg(F.count("*").alias("rows"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every post."""
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every post and whether decoding gives its text back."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("was"))
    coded = encode(table(spark, d, "documents"), "doc_id", "text")
    back = decode(coded, "doc_id")
    return docs.join(back, "doc_id").join(coded.select("doc_id", F.size("ids").alias("n_tokens")), "doc_id").select("doc_id", "n_tokens", (F.col("was") == F.col("text")).alias("same"))


def p7_lossless(spark: SparkSession, d: str) -> DataFrame:
    """Whether every post comes back from its token ids, and whether it has any."""
    return p7_roundtrip(spark, d).select("doc_id", "same", (F.col("n_tokens") > 0).alias("has_tokens"))


#: tokens of a training sequence
SEQUENCE = 2_048


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """The sequence and place of every post; only posts longer than a sequence are divided."""
    sizes = encode(table(spark, d, "documents"), "doc_id", "text", ids=False)
    return pack(sizes, "doc_id", "n_tokens", SEQUENCE).select(
        F.col("item").alias("doc_id"), "piece", "first_token", F.col("size").alias("n_tokens"), F.col("window").alias("sequence_id"), F.col("offset").alias("position")
    )


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Sequences, tokens, share of room used, and share of the pieces that sum of squares placed (the rest by falling size)."""
    sizes = encode(table(spark, d, "documents"), "doc_id", "text", ids=False)
    put = pack(sizes, "doc_id", "n_tokens", SEQUENCE).filter("window IS NOT NULL")
    used = put.groupBy("window").agg(F.sum("size").alias("n"), F.count("*").alias("pieces"), F.count_if("again").alias("again"))
    return used.agg(
        F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.round(F.sum("n") / (F.count("*") * SEQUENCE), 4).alias("fill"), F.round(1 - F.sum("again") / F.sum("pieces"), 4).alias("by_squares")
    )


def p8_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the sequences: posts, posts whose pieces are all there, sequences too full, posts divided without need, gaps or overlaps."""
    put = p8_packed(spark, d)
    docs = put.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    full = put.filter("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("position") + F.col("n_tokens")).alias("end"), F.count("*").alias("k"), F.countDistinct("position").alias("at"))
    a = docs.agg(F.count("*").alias("posts"), F.count_if(F.col("n") == F.col("end")).alias("whole"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= SEQUENCE)).alias("divided"))
    b = full.agg(F.count_if(F.col("n") > SEQUENCE).alias("too_full"), F.count_if((F.col("n") != F.col("end")) | (F.col("k") != F.col("at"))).alias("gaps"))
    return a.select("posts", "whole", "divided", b.select("too_full").scalar().alias("too_full"), b.select("gaps").scalar().alias("gaps"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold template residue, filler or an error page in place of a post."""
    return residue(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents left after the exclusion, by board."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"))
    bad = p9_found(spark, d).withColumn("bad", F.lit(1))
    return docs.join(bad, "doc_id", "left").groupBy("source").agg(F.count("*").alias("docs"), F.count("bad").alias("excluded"))


QUERIES = {
    f.__name__: f
    for f in [
        p2_found, p2_by_source, p2_contained, p2_posts, p3_found, p3_known, p3_unmatched, p4_found, p4_splits, p4_totals, p5_found, p5_fused, p6_found, p6_sizes,
        p7_ids, p7_lossless, p7_roundtrip, p8_packed, p8_fill, p8_sound, p9_found, p9_kept,
    ]
}
SQL = sql.SQL
