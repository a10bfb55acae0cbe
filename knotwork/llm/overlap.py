"""Same or near-same records across splits (problem 2).

A record is a list of words; its fingerprint is the set of the hashes of its
word n-grams (a record of fewer than n words has one gram, the whole record).
The evaluation grams are partitioned by hash, the training grams are scanned
against them, and the containment of an evaluation record in a training record
is the share of its grams that the training record has.

* Records of fewer than n words have one gram and are contained wholly or not at
  all: a hit is the answer.
* For the others, equal fingerprints are one class, so copies never multiply.
  A class of k grams that is contained to ``threshold`` misses at most
  ``k - ceil(threshold * k)`` grams of the other, so one of that many plus one
  of its rarest grams must hit; only those are probed and every candidate is
  then verified on the whole fingerprints.

Whole records and classes are compared by 128 bits (two 64-bit hashes with
different seeds), so a chance collision is out of reach at any real size; the
grams inside a fingerprint by 64 bits, where several would have to collide in
the same pair.  Hot grams (a third of all
rows may share one) are split by AQE's skew join on both sides: the joins are
plain equi-joins and no group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.session import Scratch


def gram_hash(words: Column) -> Column:
    """128-bit key of a list of words."""
    joined = F.array_join(words, "\x1f")
    return F.struct(F.xxhash64(joined).alias("x"), F.xxhash64(F.lit("second"), joined).alias("y"))


def grams(words: Column, n: int) -> Column:
    """Distinct n-gram hashes (64 bits) of a word list; one for a list shorter than n, none for an empty or null one."""
    size = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), "\x1f")))
    return F.when(size > 0, F.array_distinct(windows)).otherwise(F.array().cast("array<bigint>"))


def record_hits(evaluation: DataFrame, training: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of an evaluation and a training record whose single gram (columns ``on``) is the same.

    Both sides keep their other columns; their names must differ.
    """
    return evaluation.join(training, on, "inner")


#: records that a gram is in, per salt: beyond that it is dealt to so many more tasks
GRAM_ROWS = 50_000


def contained(
    records: DataFrame, record_id: str, words: str, split: str, train: str = "train", n: int = 5, threshold: float = 0.8, scratch: Scratch | None = None
) -> tuple[DataFrame, DataFrame]:
    """(links, members) of all evaluation records contained in training records.

    ``members``: ``record_id, split, class_x, class_y``, one row per record with
    words; records with equal fingerprints have equal classes.
    ``links``: ``eval_x, eval_y, train_x, train_y, containment``, one row per
    pair of classes with an evaluation record in the first and a training
    record in the second and a containment of at least ``threshold``.

    Rows with a null id, split or word list, or with an empty one, are in no
    class.  Repeated rows count once per row.  Empty tables give empty results.
    """
    scratch = scratch or Scratch(records.sparkSession, "overlap")
    some = records.filter(F.col(record_id).isNotNull() & F.col(split).isNotNull() & (F.size(words) > 0))
    # words, then grams are written before they are referred to more than once: inlined, each reference would make them anew
    tokens = scratch.put(some.select(F.col(record_id).alias("record_id"), F.col(split).alias("split"), F.col(words).alias("w")))
    one = F.size("w") <= n
    sized = scratch.put(tokens.select("record_id", "split", F.when(one, F.array_join("w", "\x1f")).alias("whole"), F.when(F.size("w") >= n, F.sort_array(grams(F.col("w"), n))).alias("grams")))
    text = F.coalesce("whole", F.array_join("grams", ","))
    members = scratch.put(sized.select("record_id", "split", F.xxhash64(text).alias("class_x"), F.xxhash64(F.lit("second"), text).alias("class_y"), "grams"))
    side = members.select("class_x", "class_y", "grams", (F.col("split") == train).alias("t"))
    classes = scratch.put(side.groupBy("class_x", "class_y").agg(F.first("grams").alias("grams"), F.max("t").alias("in_train"), F.min("t").alias("only_train")))
    same = classes.filter("in_train AND NOT only_train").select(F.col("class_x").alias("eval_x"), F.col("class_y").alias("eval_y"), F.col("class_x").alias("train_x"), F.col("class_y").alias("train_y"), F.lit(1.0).alias("containment"))
    ask = classes.filter("grams IS NOT NULL AND NOT only_train").select(F.col("class_x").alias("eval_x"), F.col("class_y").alias("eval_y"), "grams")
    # only grams that some evaluation record has are carried on from the training side
    asked = scratch.put(ask.select("eval_x", "eval_y", F.size("grams").alias("k"), F.explode("grams").alias("gram")))
    train_grams = classes.filter("grams IS NOT NULL AND in_train").select(F.col("class_x").alias("train_x"), F.col("class_y").alias("train_y"), F.explode("grams").alias("gram"))
    hits = scratch.put(train_grams.join(asked.select("gram").distinct(), "gram", "left_semi"))
    rarity = hits.groupBy("gram").agg(F.count("*").alias("df"))
    place = Window.partitionBy("eval_x", "eval_y").orderBy(F.coalesce("df", F.lit(0)), "gram")
    # a pair that shares ceil(threshold k) of k grams shares one of the k - ceil(threshold k) + 1 rarest
    probes = F.col("k") - F.ceil(F.col("k") * threshold - 1e-9).cast("int") + 1
    ranked = asked.join(rarity, "gram", "left").withColumn("i", F.row_number().over(place)).filter(F.col("i") <= probes).select("eval_x", "eval_y", "gram", F.coalesce("df", F.lit(0)).alias("df"))
    # a hot gram is dealt to several tasks by a salt: its training rows are split, its evaluation rows repeated
    salts = F.greatest(F.lit(1), F.ceil(F.col("df") / GRAM_ROWS)).cast("int")
    probe = ranked.filter("df > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    salted = hits.join(rarity, "gram").withColumn("salt", F.pmod(F.xxhash64("train_x"), salts).cast("int")).drop("df")
    candidates = scratch.put(probe.drop("df").join(salted, ["gram", "salt"]).filter("eval_x <> train_x OR eval_y <> train_y").select("eval_x", "eval_y", "train_x", "train_y").distinct())
    of = lambda e: classes.select(F.col("class_x").alias(f"{e}_x"), F.col("class_y").alias(f"{e}_y"), F.col("grams").alias(f"{e}_g"))
    near = (
        candidates.join(of("eval"), ["eval_x", "eval_y"])
        .join(of("train"), ["train_x", "train_y"])
        .select("eval_x", "eval_y", "train_x", "train_y", (F.size(F.array_intersect("eval_g", "train_g")) / F.size("eval_g")).alias("containment"))
        .filter(F.col("containment") >= threshold)
    )
    return same.unionByName(near), members.drop("grams")
