"""Free-entered names to a canonical list (problem 3).

1. Every distinct typed name is parsed once: prefixes, markup, qualifiers and
   strain codes go, look-alike letters are folded, and what is left is cut into
   words.  Runs of up to three neighbouring words are tokens too, so a name
   that was broken apart is whole in one of them.
2. Each distinct token is repaired against the vocabulary of the list: exact
   matches first, the others by an edit-distance join (at most 2).  The join is
   blocked by segments: a vocabulary word is cut into three, and two edits
   leave one of the pieces untouched, so only tokens that hold a piece at a
   fitting place are compared.  No pair is lost and nothing is cross-joined.
3. Complete entries are ranked by soft TF-IDF: the idf-weighted similarities of
   their repaired words.  Two-word entries (species) are reached through their
   second word, which few of them share, and need their first word too, written
   out or as its initial; one-word entries need their word.  A two-word entry
   goes before a one-word entry.  If different taxa tie, the name is ambiguous
   and means none.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions.missing import is_missing
from knotwork.session import Scratch

NONE = "none"
#: edits allowed in a word of at least so many letters
EDITS = [(8, 2), (5, 1), (0, 0)]
MAX_EDITS = 2
#: weight of a first word given by its initial
INITIAL = 0.5

# Words that qualify a name and are no part of it.
QUALIFIERS = set(
    """candidatus uncultured unclassified unidentified unknown sp spp cf aff nr str strain isolate subsp subspecies ssp var serovar biovar genome draft complete
    comb nov gen emend corrig ex sensu lato stricto genus family order class phylum species bacterium bacteria archaeon organism environmental sample clone group cluster
    human faeces feces gut stool closest hit and et al type mixed culture incertae sedis no the of from""".split()
)
# Letters of other scripts that look like Latin ones.
_LOOKALIKE = str.maketrans(
    "абвгдезикмнорстухьіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαβεικνοορτυχγηω",
    "a6brdeeukmhopctyxbijshdqwABEKMHOPCTYXIJSaBeikvooptuxynw",
)
_PREFIX = re.compile(r"^\s*(?:unmapped|vmh|ncbi|name|taxon)\s*[:|]\s*", re.I)
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_RANKS = re.compile(r"(?:^|[;|,\s])([a-z])__", re.I)


def _fold(s: str) -> str:
    s = _INVISIBLE.sub("", html.unescape(html.unescape(s)))
    s = re.sub(r"</?[a-z][^<>]*>", "", s, flags=re.I)
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if not unicodedata.combining(c)).translate(_LOOKALIKE)
    return s.replace("ß", "ss").replace("æ", "ae").replace("ø", "o").replace("đ", "d").replace("ł", "l").replace("ı", "i")


def parse(name: str) -> tuple[list[str], str]:
    """(words in lower case, initial that stands for a first word or "")."""
    s = _fold(name)
    while _PREFIX.match(s):
        s = _PREFIX.sub("", s)
    if _RANKS.search(s):  # a lineage: from the genus down; a higher rank only where nothing follows
        parts = {}
        for piece in re.split(r"[;|]", s):
            m = re.match(r"\s*([a-z])__(.*)", piece, re.I)
            if m and m[2].strip():
                parts[m[1].lower()] = m[2].strip()
        low = [parts[r] for r in "gs" if r in parts]
        if len(low) == 2 and low[1].lower().replace("_", " ").startswith(low[0].lower().replace("_", " ")):
            low = low[1:]
        high = [parts[r] for r in "focpkd" if r in parts]
        s = " ".join(low) if low else (high[0] if high else "")
    s = re.sub(r"\([^()]*\)", " ", s)
    s = re.sub(r"\[[^\[\]]*[\s_\d%][^\[\]]*\]", " ", s) if not re.match(r"\s*\[[^\]]*\]\s*$", s) else s
    s = re.sub(r"(?<=[a-z]{3})(?=[A-Z][a-z]{3})", " ", s)
    raw = [w for w in re.split(r"[^A-Za-z0-9]+", s) if w]
    words: list[str] = []
    initial = ""
    for i, w in enumerate(raw):
        low = w.lower()
        if low in QUALIFIERS or any(c.isdigit() for c in w):
            if low in ("str", "strain", "isolate", "subsp", "ssp", "var", "serovar", "emend", "comb") and len(words) >= 2:
                break
            continue
        if len(w) == 1:
            if not words and not initial and i < 2:
                initial = low
            elif words:
                words.append(low)
            continue
        if len(w) <= 4 and w.isupper() and words and not all(x.isupper() for x in raw if x.isalpha()):
            continue  # a collection code
        words.append(low)
    return words, initial


_PARSED = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("initial", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("words", T.IntegerType()),
        T.StructField("total", T.IntegerType()),
    ]
)


def _parse_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for name in p["name"]:
            words, initial = parse(name)
            for i in range(len(words)):
                for k in (1, 2, 3):
                    if i + k <= len(words) and (k == 1 or len("".join(words[i : i + k])) <= 40):
                        rows.append((name, initial, "".join(words[i : i + k]), i, k, len(words)))
        yield pd.DataFrame(rows, columns=_PARSED.names)


def _cuts(n: int) -> list[tuple[int, int]]:
    """Three nearly equal segments of a word of n letters: (start, end)."""
    k = MAX_EDITS + 1
    edges = [n * i // k for i in range(k + 1)]
    return list(zip(edges, edges[1:]))


def segments(word: str) -> list[tuple[int, int, str]]:
    """(length, segment number, text) of a vocabulary word."""
    return [(len(word), i, word[a:b]) for i, (a, b) in enumerate(_cuts(len(word)))]


def probes(word: str) -> set[tuple[int, int, str]]:
    """The segments that a vocabulary word within MAX_EDITS of this one may share with it."""
    n, t, out = len(word), MAX_EDITS, set()
    for length in range(max(1, n - t), n + t + 1):
        shift = n - length
        for i, (a, b) in enumerate(_cuts(length)):
            for at in range(max(a - i, a + shift - (t - i), 0), min(a + i, a + shift + (t - i)) + 1):
                if at + (b - a) <= n:
                    out.add((length, i, word[at : at + b - a]))
    return out


_KEY = T.StructType([T.StructField("token", T.StringType()), T.StructField("key", T.StringType())])


def _keys(of, column: str):
    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(w, f"{n}:{i}:{s}") for w in p[column] for n, i, s in of(w)]
            yield pd.DataFrame(rows, columns=_KEY.names)

    return make


def edit_join(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``token, word, edits`` for all pairs within the edits allowed for the token's length.

    Both inputs have one column of distinct strings (``token``, ``word``).
    """
    exact = tokens.join(vocabulary, F.col("token") == F.col("word")).select("token", "word", F.lit(0).alias("edits"))
    rest = tokens.join(vocabulary, F.col("token") == F.col("word"), "left_anti").filter(F.length("token") >= EDITS[-2][0])
    ask = rest.mapInPandas(_keys(probes, "token"), _KEY)
    have = vocabulary.mapInPandas(_keys(segments, "word"), _KEY).select(F.col("token").alias("word"), "key")
    allowed = F.when(F.length("token") >= EDITS[0][0], EDITS[0][1]).otherwise(EDITS[1][1])
    near = ask.join(have, "key").select("token", "word").distinct().withColumn("edits", F.levenshtein("token", "word", MAX_EDITS)).filter((F.col("edits") >= 0) & (F.col("edits") <= allowed))
    return exact.unionByName(near.select("token", "word", "edits"))


def resolve(names: DataFrame, name: str, entries: DataFrame, entry_id: str, entry_name: str) -> DataFrame:
    """``name, id`` for every distinct non-missing name: the entry it means, else ``none``.

    ``entries``: id and name, several names per id allowed; a name has one or
    two words (further words are ignored).  Null ids or names are left out.
    An empty list or table gives ``none`` or nothing.  Texts of any length are
    parsed whole.
    """
    scratch = Scratch(names.sparkSession, "names")
    distinct = names.select(F.col(name).alias("name")).filter(~is_missing(F.col("name"))).distinct()
    parts = F.split(F.trim(F.lower(F.col(entry_name))), r"\s+")
    listed = entries.filter(F.col(entry_id).isNotNull() & F.col(entry_name).isNotNull()).select(F.col(entry_id).alias("id"), parts[0].alias("first"), F.get(parts, F.lit(1)).alias("second")).distinct()
    n = max(1, listed.count())
    uses = listed.select(F.explode(F.array_compact(F.array("first", "second"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = scratch.put(uses.select("word", (F.log(F.lit(float(n)) / F.col("df")) + 1).alias("idf")))
    parsed = scratch.put(distinct.mapInPandas(_parse_all, _PARSED))
    repaired = scratch.put(edit_join(parsed.select("token").distinct(), idf.select("word")).join(idf, "word"))
    weight = (1 - F.col("edits") / F.length("token")) * F.col("idf")
    found = scratch.put(parsed.join(repaired, "token").select("name", "initial", "word", "at", "words", "total", "edits", weight.alias("w")))
    second = found.join(listed.filter("second IS NOT NULL"), F.col("word") == F.col("second")).select("name", "initial", "id", "first", "at", "words", F.col("w").alias("w2"), F.col("edits").alias("e2"))
    first = found.select("name", F.col("word").alias("first"), F.col("at").alias("at1"), F.col("words").alias("words1"), F.col("w").alias("w1"), F.col("edits").alias("e1"))
    apart = (F.col("at1") + F.col("words1") <= F.col("at")) | (F.col("at") + F.col("words") <= F.col("at1"))
    full = second.join(first, ["name", "first"]).filter(apart).select("name", "id", F.lit(3).alias("level"), (F.col("w1") + F.col("w2")).alias("score"))
    short = (
        second.filter((F.col("initial") != "") & (F.col("initial") == F.substring("first", 1, 1)) & (F.col("at") == 0))
        .join(idf.select(F.col("word").alias("first"), F.col("idf").alias("i1")), "first")
        .select("name", "id", F.lit(2).alias("level"), (F.col("w2") + INITIAL * F.col("i1")).alias("score"))
    )
    # a one-word entry may only leave qualifiers and codes beside its word
    alone = found.filter("initial = '' AND words = total").join(listed.filter("second IS NULL"), F.col("word") == F.col("first")).select("name", "id", F.lit(1).alias("level"), F.col("w").alias("score"))
    ranked = full.unionByName(short).unionByName(alone).groupBy("name", "id").agg(F.max(F.struct("level", F.round("score", 6).alias("score"))).alias("s"))
    best = ranked.groupBy("name").agg(F.max("s").alias("s"))
    top = ranked.join(best, ["name", "s"]).groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("ties"))
    return distinct.join(top, "name", "left").select("name", F.when(F.col("ties") == 1, F.col("id")).otherwise(F.lit(NONE)).alias("id"))
