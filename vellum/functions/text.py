"""Text search: tokens, two stemmers, all-words matching, and ranked search by tf-idf.

``suffix_stem`` is a list of suffix rules of which the first that fits is applied: plain expressions. ``porter_stem`` is a
variant of the Porter stemmer that Spark has no function for; it runs as a vectorised function, over distinct words where
a table of them can be made.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import SpecError
from vellum.shipping import ship

STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or over such that the their then there these they this to was will with".split())
#: suffix -> (replacement, the word is longer than this), tried in this order.
SUFFIX_RULES = (
    ("ational", "ate", 7), ("tional", "tion", 6), ("enci", "ence", 4), ("anci", "ance", 4), ("izer", "ize", 4), ("abli", "able", 4),
    ("alli", "al", 4), ("entli", "ent", 5), ("eli", "e", 3), ("ousli", "ous", 5), ("ization", "ize", 7), ("ation", "ate", 5),
    ("ator", "ate", 4), ("alism", "al", 5), ("iveness", "ive", 7), ("fulness", "ful", 7), ("ousness", "ous", 7), ("aliti", "al", 5),
    ("iviti", "ive", 5), ("biliti", "ble", 6), ("ing", "", 3), ("ed", "", 2), ("s", "", 1),
)


def suffix_stem(word: Column) -> Column:
    """The first suffix rule that fits, applied to a lower-case word (lengths in UTF-8 bytes)."""
    out = None
    for suffix, replacement, longer in SUFFIX_RULES:
        fits = (F.octet_length(word) > longer) & F.endswith(word, F.lit(suffix))
        new = F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(replacement))
        out = F.when(fits, new) if out is None else out.when(fits, new)
    return out.otherwise(word)


def tokens(text: Column, unicode: bool = True) -> Column:
    """Lower-case words of a text, in order."""
    pattern = r"[^\p{L}\p{N}]+" if unicode else "[^a-z0-9]+"
    return F.filter(F.split(F.lower(text), pattern), lambda t: t != "")


def index_tokens(text: Column, unicode: bool = False) -> Column:
    """Words without stop words and those of a single byte."""
    return F.filter(tokens(text, unicode), lambda t: (F.octet_length(t) > 1) & ~t.isin(*STOP_WORDS))


# --- Porter ---------------------------------------------------------------------------------------------------------

_VOWELS = frozenset("aeiou")
_STEP2 = SUFFIX_RULES[:20]
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _measure(w: str) -> int:
    """How often a vowel run is followed by something else."""
    kinds = ["v" if c in _VOWELS else "c" if c.isalpha() else "x" for c in w]
    i = m = 0
    while i < len(w) and kinds[i] == "c":
        i += 1
    while i < len(w):
        while i < len(w) and kinds[i] == "v":
            i += 1
        if i >= len(w):
            break
        if kinds[i] == "x":
            return m + 1
        while i < len(w) and kinds[i] == "c":
            i += 1
        m += 1
    return m


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False
    a, b, c = w[-3:]
    return a not in _VOWELS and a.isalpha() and b in _VOWELS and c not in _VOWELS and c.isalpha() and c not in "wxy"


def _repair(w: str) -> str:
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) >= 2 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
        return w[:-1]
    return w + "e" if _measure(w) == 1 and _cvc(w) else w


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a word; y is never a vowel, words in -us keep their s."""
    if len(word.encode()) <= 2:
        return word
    w = word.lower()
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith(("us", "ss")):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and any(c in _VOWELS for c in w[:-2]):
        w = _repair(w[:-2])
    elif w.endswith("ing") and any(c in _VOWELS for c in w[:-3]):
        w = _repair(w[:-3])
    if w.endswith("y") and any(c in _VOWELS for c in w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for suffix, replacement, *_ in rules:
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                if _measure(stem) > 0:
                    w = stem + replacement
                break
    for suffix in _STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.arrow_udf(T.ArrayType(T.StringType()))
def _porter_all(words: pa.Array) -> pa.Array:
    """Each distinct word of a batch is stemmed once; the rest stays in Arrow, for which no Python text is made."""
    flat = words.flatten().dictionary_encode()
    stems = pa.array([None if w is None else porter(w) for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
    sizes = pc.fill_null(pc.list_value_length(words), 0)
    ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
    return pa.ListArray.from_arrays(ends, stems, mask=words.is_null() if words.null_count else None)


def porter_stems(words: Column) -> Column:
    """The stems of an array of words."""
    return _porter_all(words)


def query_tokens(query: str) -> list[str]:
    """Distinct stemmed words of a query, as the matcher sees them."""
    import re

    words = [w for w in re.split("[^a-z0-9]+", query.lower()) if len(w) > 1 and w not in STOP_WORDS]
    return list(dict.fromkeys(porter(w) for w in words))


def _beginning(stem: str) -> str:
    """What all words of a stem begin with; a final i may have been a y."""
    return stem[:1] if len(stem) == 2 and stem[1] == "i" else stem[: max(2, min(len(stem) - 2, 4))]


def _begins(word: Column, stems: list[str]) -> Column:
    """Whether a word can have one of these stems, or one that begins with them, by its beginning: the others needn't be stemmed."""
    return reduce(lambda a, b: a | b, (F.startswith(word, F.lit(_beginning(w))) for w in stems))


def match_all(fields: Iterable[Column], query: str) -> Column:
    """Whether every word of the query is, stemmed, in the fields together; a query without words matches all."""
    wanted, fields = query_tokens(query), list(fields)
    if not wanted:
        return F.lit(True)
    if not fields:
        return F.lit(False)
    from pyspark.sql import SparkSession

    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    whole = F.concat_ws(" ", *fields)
    # A stem's beginning that no rule changes must stand in the text: a cheap test before the words are stemmed.
    lower = F.lower(whole)
    bound = reduce(lambda a, b: a & b, (F.contains(lower, F.lit(_beginning(w))) for w in wanted))
    stems = porter_stems(F.array_distinct(F.filter(index_tokens(whole), lambda t: _begins(t, wanted))))
    return bound & reduce(lambda a, b: a & b, (F.array_contains(stems, w) for w in wanted))


# --- ranked search --------------------------------------------------------------------------------------------------


def postings(df: DataFrame, key: str, field: str, stem=suffix_stem) -> DataFrame:
    """(key, term, tf, positions) of a text field: an inverted index."""
    words = df.select(F.col(key).alias("key"), F.posexplode(tokens(F.col(field))).alias("pos", "word"))
    return words.groupBy("key", stem(F.col("word")).alias("term")).agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def stem_word(word: str) -> str:
    """``suffix_stem`` of a plain word."""
    for suffix, replacement, longer in SUFFIX_RULES:
        if len(word.encode()) > longer and word.endswith(suffix):
            return word[: -len(suffix)] + replacement
    return word


def words_of_stem(stem: str) -> list[str]:
    """All words whose stem this is: one for each rule at most, and the stem itself."""
    made = [stem, *(stem[: len(stem) - len(r)] + suffix for suffix, r, _ in SUFFIX_RULES if stem.endswith(r))]
    return [w for w in dict.fromkeys(made) if stem_word(w) == stem]


def search(df: DataFrame, key: str, field: str, query: str, limit: int | None = None) -> DataFrame:
    """(key, score) by falling score: the sum of tf (ln(N / df) + 1) over the query's words, each as often as it is there."""
    import re

    wanted: dict[str, int] = {}
    for w in re.findall(r"[^\W_]+", query.lower()):
        wanted[stem_word(w)] = wanted.get(stem_word(w), 0) + 1
    words = {w: words_of_stem(w) for w in wanted if words_of_stem(w)}
    if not words:
        return df.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    # A stem comes from few words: of a text's words only these are kept, and none is stemmed. The exchange below them is
    # used twice, for the documents' counts and for the stems', so that the texts are read and cut into words once.
    lower = F.lower(F.col(field))
    some = reduce(lambda a, b: a | b, (F.contains(lower, F.lit(os.path.commonprefix(ws))) for ws in words.values()))
    found = df.filter(some).select(F.col(key), F.explode(F.split(lower, r"[^\p{L}\p{N}]+")).alias("w")).filter(F.col("w").isin(*(w for ws in words.values() for w in ws)))
    counts = found.groupBy(key).agg(*(F.count_if(F.col("w").isin(*ws)).alias(f"tf{i}") for i, ws in enumerate(words.values())))
    totals = counts.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words)))).crossJoin(df.agg(F.count(F.lit(1)).alias("n")))
    joined = counts.crossJoin(F.broadcast(totals))  # one row
    parts = [F.when(F.col(f"tf{i}") > 0, F.col(f"tf{i}") * (F.log(F.col("n") / F.col(f"df{i}")) + 1) * wanted[w]).otherwise(0.0) for i, w in enumerate(words)]
    out = joined.select(key, reduce(lambda a, b: a + b, parts).alias("score")).orderBy(F.desc("score"), key)
    return out if limit is None else out.limit(limit)


@dataclass(frozen=True)
class TextQuery:
    """What ``$text`` asks for; words are compared in lower case and as they are spelt, whatever the flags say."""

    search: str
    language: str | None = None
    case_sensitive: bool = False
    diacritic_sensitive: bool = False


def parse_text_query(spec: dict) -> TextQuery:
    if not isinstance(spec, dict) or not isinstance(spec.get("$search"), str) or not spec["$search"]:
        raise SpecError("$text needs {$search: words}")
    if unknown := spec.keys() - {"$search", "$language", "$caseSensitive", "$diacriticSensitive"}:
        raise SpecError(f"unknown in $text: {sorted(unknown)}")
    flags = {"case_sensitive": spec.get("$caseSensitive", False), "diacritic_sensitive": spec.get("$diacriticSensitive", False)}
    if not all(isinstance(v, bool) for v in flags.values()):
        raise SpecError("the flags of $text are true or false")
    return TextQuery(spec["$search"], spec.get("$language"), **flags)


class SearchCollection:
    """Ranked search in one field of a table; numbers are searched as they are written, other kinds hold no words."""

    def __init__(self, df: DataFrame, key: str, field: str):
        if not isinstance(df.schema[field].dataType, (T.StringType, T.IntegralType, T.DoubleType, T.FloatType)):
            df = df.withColumn(field, F.lit(""))
        self.df, self.key, self.field = df.withColumn(field, F.coalesce(F.col(field).cast("string"), F.lit(""))), key, field

    def search(self, query: str | dict, limit: int | None = None, offset: int = 0, least: float = 0.0, snippets: bool = False) -> DataFrame:
        """(key, score, and with ``snippets`` the text around the first word) by falling score, those of at least ``least``."""
        words = parse_text_query(query).search if isinstance(query, dict) else query
        out = search(self.df, self.key, self.field, words).filter(F.col("score") >= least)
        out = out.orderBy(F.desc("score"), self.key)
        out = out.offset(offset) if offset else out
        out = out if limit is None else out.limit(limit)
        if snippets:
            texts = self.df.select(F.col(self.key).alias("__key"), snippet(F.col(self.field), words).alias("snippet"))
            out = out.join(texts, out[self.key] == F.col("__key")).drop("__key").orderBy(F.desc("score"), self.key)
        return out


def snippet(text: Column, query: str, before: int = 50, after: int = 100) -> Column:
    """The text around the first query word that is in it; its beginning where none is."""
    import re

    size, out = F.length(text), None
    for w in re.findall(r"[^\W_]+", query.lower()):
        at = F.instr(F.lower(text), w) - 1
        lo, hi = F.greatest(at - before, F.lit(0)), F.least(at + after, size)
        cut = F.concat(F.when(lo > 0, "...").otherwise(""), F.substring(text, lo + 1, hi - lo), F.when(hi < size, "...").otherwise(""))
        out = F.when(at >= 0, cut) if out is None else out.when(at >= 0, cut)
    head = F.when(size > 150, F.concat(F.substring(text, 1, 150), F.lit("..."))).otherwise(text)
    return head if out is None else out.otherwise(head)


def prefix_tfidf(df: DataFrame, key: str, fields: list[str], query: str, n_docs: int = 1000, limit: int | None = None) -> DataFrame:
    """(key, score) by relative term frequency times ln(n_docs / (df + 1)), over stemmed words equal to the query's.

    df counts every posting whose term begins with the query's word, so that "cat" is as frequent as "category" makes it.
    """
    wanted = query_tokens(query)
    ship(df.sparkSession)
    words = df.select(F.col(key), index_tokens(F.concat_ws(" ", *fields), unicode=True).alias("w")).filter(F.size("w") > 0)
    begins = reduce(lambda a, b: a | b, (F.startswith("term", F.lit(w)) for w in wanted)) if wanted else F.lit(False)
    some = porter_stems(F.filter("w", lambda t: _begins(t, wanted) if wanted else F.lit(False)))
    hits = words.select(key, F.size("w").alias("n"), F.explode(some).alias("term")).filter(begins)
    tf = hits.groupBy(key, "term", "n").agg(F.count(F.lit(1)).alias("c"))
    freq = tf.agg(F.count(F.lit(1)).alias("__all"), *(F.count_if(F.startswith("term", F.lit(w))).alias(f"__df{i}") for i, w in enumerate(wanted)))
    df_of = F.lit(None).cast("long")
    for i, w in enumerate(wanted):
        df_of = F.when(F.col("term") == w, F.col(f"__df{i}")).otherwise(df_of)
    exact = tf.filter(F.col("term").isin(*wanted) if wanted else F.lit(False)).crossJoin(F.broadcast(freq))  # one row
    out = exact.groupBy(key).agg(F.sum(F.col("c") / F.col("n") * F.log(F.lit(float(n_docs)) / (df_of + 1))).alias("score"))
    out = out.orderBy(F.desc("score"), key)
    return out if limit is None else out.limit(limit)
