"""Mapping freely typed values to a reference list: token repair and soft TF-IDF.

Values and entries are split into words (``names``, with a vocabulary of generic words
learned from the entries and the values); generic words are repaired to that vocabulary.
Each distinct other word of a value, and all of them written as one, is joined to the words
of the reference list by edit distance: both sides are spread over their deletion
neighbourhoods (long words over their thirds), equal keys meet, and ``levenshtein`` decides.
A word keeps all words it meets, not only the nearest: which of them belong to one entry is
known only when the whole names are compared. An entry all of whose rare words meet a
value's is a candidate. Its score is soft TF-IDF, the cosine of the two word vectors in which
a repaired word counts by its similarity. Of the candidates whose score is high enough and
whose qualifiers (line of business, model number, edition) are the value's, that with the
fewest edits is taken, and among those the best score.

Work follows the distinct values; the reference side is joined, never sent around unchecked
(its size decides whether the optimizer broadcasts it). Rows are joined back to their value.

Defined results: rows without a value get no row here (see ``typed_values``); values
without a candidate or under the threshold get -1; ties go to the least entry id; null
titles are no entries; empty tables give -1 for all values or an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import is_blank
from factloom.llm.names import learn_vocabularies
from factloom.llm.spellings import read_names
from factloom.plans.session import cut

#: Words are spread over their deletion neighbourhoods up to this length and over their thirds from it on; it changes no row.
LONG = 64


def typed_values(df: DataFrame, key: str, label: str, name: str, fallback: str, labels: list[str]) -> DataFrame:
    """key, label, value: the name, or failing that the fallback before its ``::``; rows with neither are left out."""
    spare = F.regexp_replace(F.regexp_extract(F.col(fallback), r"(?s)^(.*?)(::|$)", 1), "-", " ")
    value = F.when(~is_blank(F.col(name)), F.col(name)).when(~is_blank(F.col(fallback)), spare)
    return df.filter(F.col(label).isin(labels)).select(F.col(key).alias("key"), F.col(label).alias("label"), value.alias("value")).filter("value is not null")


def _without(text: Column, k: Column) -> Column:
    return F.concat(F.substr(text, F.lit(1), k - 1), F.substr(text, k + 1))


def deletions(token: Column) -> Column:
    """The token and all that is left of it without one or two letters (one under seven letters)."""
    places = lambda t: F.sequence(F.lit(1), F.length(t))
    one = F.transform(places(token), lambda k: _without(token, k))
    two = F.flatten(F.transform(one, lambda t: F.transform(places(t), lambda k: _without(t, k))))
    return F.array_distinct(F.concat(F.array(token), one, F.when(F.length(token) >= 7, two).otherwise(F.array().cast("array<string>"))))


def thirds(text: Column, off: int) -> Column:
    """The thirds of a word as they would stand in ``text``, if its length and their places differ by up to ``off``.

    Two edits leave one of a word's thirds whole. It is shifted by one letter at most if the
    lengths are equal or there is one edit only.
    """
    shifts = range(-off, off + 1)
    start = lambda size, k: (size * k / 3).cast("int")
    third = lambda size, k, shift: F.substr(text, start(size, k) + 1 + shift, start(size, k + 1) - start(size, k))
    sizes = [F.length(text) + more for more in shifts]
    return F.array(*[F.concat_ws("|", size, F.lit(k), third(size, k, shift)) for size in sizes for k in range(3) for shift in shifts])


def repair_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """label, token, word, edits, sim: all vocabulary words as near to a token as the length allows.

    Words of any length meet their equal. With three letters or more in the longer of the two
    also those within one edit (of two letters it would leave one), from 7 letters on also
    those of equal length within two edits, such as two swapped letters.

    Both sides are distinct (label, token).
    """
    none = F.array().cast("array<string>")

    def spread(df: DataFrame, name: str, off: int) -> DataFrame:
        token, size = F.col("token"), F.length("token")
        keys = F.concat(F.when(size <= LONG, deletions(token)).otherwise(none), F.when(size >= LONG, thirds(token, off)).otherwise(none))
        return df.filter("token != ''").withColumn("key", F.explode(keys)).withColumnRenamed("token", name)

    met = spread(tokens, "token", 1).join(spread(vocabulary, "word", 0), ["label", "key"]).select("label", "token", "word").distinct()
    size = F.greatest(F.length("token"), F.length("word"))
    edits = F.levenshtein("token", "word", 2)  # -1 when over two
    two = (size >= 7) & (F.length("token") == F.length("word"))
    near = met.withColumn("edits", edits).filter((F.col("edits") == 0) | ((F.col("edits") == 1) & (size >= 3)) | ((F.col("edits") == 2) & two))
    return near.withColumn("sim", F.lit(1.0) - F.col("edits") / size)


def _versions(read: DataFrame) -> DataFrame:
    """A row per way to write the rare words (``version`` 0: as one, 1: one by one) with ``rare`` and ``generic`` words."""
    generic = F.array_distinct(F.filter(F.split(F.concat_ws(" ", "guard", "extra"), r"[ |]+"), lambda t: t != ""))
    ways = F.array(F.array("stem"), F.array_distinct("words"))
    out = read.filter("stem != ''").withColumn("generic", generic).select("*", F.posexplode(ways).alias("version", "rare"))
    return out.filter("version = 0 or size(rare) > 1").drop("words", "extra", "stem")


def _weigh(rows: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``g``: the generic words with their squared weights."""
    weighed = rows.select(*keys, F.explode("generic").alias("word")).join(idf, ["label", "word"], "left").withColumn("q", F.coalesce("q", F.lit(1.0)))
    weighed = weighed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "q"))).alias("g"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return rows.join(weighed, keys, "left").withColumn("g", F.coalesce("g", none))


def ground_values(values: DataFrame, entries: DataFrame, entry_id: str, title: str, entry_label: str, threshold: float = 0.5) -> DataFrame:
    """label, value, entry (-1 if none), score, for the distinct label and value of ``values``."""
    distinct = cut(values.select("label", "value").distinct())
    listed = entries.filter(F.col(title).isNotNull() & F.col(entry_id).isNotNull()).select(F.col(entry_label).alias("label"), F.col(title).alias("value"), F.col(entry_id).cast("long").alias("entry"))
    vocabularies = learn_vocabularies(distinct.withColumnRenamed("value", "name"), listed.select("label", F.col("value").alias("name")))
    typed = cut(_versions(read_names(distinct, "label", "value", vocabularies)))
    pages = cut(_versions(read_names(listed, "label", "value", vocabularies, "entry")))

    words = typed.select("label", F.explode("rare").alias("token")).distinct()
    vocabulary = pages.select("label", F.explode("rare").alias("token")).distinct()
    repaired = repair_tokens(words, vocabulary)

    # squared inverse document frequencies of the entries' words; an unknown word is as rare as can be
    size = pages.filter("version = 0").groupBy("label").agg(F.count("*").alias("n"))
    df = pages.select("label", "entry", F.explode(F.concat("generic", "rare")).alias("word")).groupBy("label", "word").agg(F.count_distinct("entry").alias("df"))
    squared = lambda x: F.log1p(F.col("n") / x) * F.log1p(F.col("n") / x)
    idf = cut(df.join(size, "label").select("label", "word", squared(F.col("df")).alias("q")))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)

    side = _weigh(pages, idf, ["label", "entry", "value", "version"])
    rare = side.select("label", "guard", "entry", F.col("value").alias("title"), F.col("version").alias("v"), F.explode("rare").alias("word")).join(idf, ["label", "word"])
    value_words = typed.select("label", "guard", "value", "version", F.size("rare").alias("n_rare"), F.explode("rare").alias("token"))
    met = value_words.join(repaired, ["label", "token"]).join(rare, ["label", "guard", "word"])
    pair = F.struct("token", "word", "edits", "sim", "q")
    met = met.groupBy("label", "value", "version", "n_rare", "entry", "title", "v").agg(F.array_sort(F.collect_set(pair)).alias("pairs"))
    several = lambda side: F.size(F.array_distinct(F.col(f"pairs.{side}")))
    met = met.withColumn("words", several("word")).filter(several("token") == F.col("n_rare"))  # a rare word without its counterpart means another thing
    nearer = lambda p, side: F.exists("pairs", lambda o: (o[side] == p[side]) & (o["edits"] < p["edits"]))
    met = met.withColumn("pairs", F.filter("pairs", lambda p: ~nearer(p, "token") | ~nearer(p, "word")))  # the nearest of a word within this entry or value
    added = lambda f: F.aggregate("pairs", F.lit(0.0), lambda s, p: s + f(p))
    met = met.withColumns({"dot": added(lambda p: p["q"] * p["sim"]), "own": added(lambda p: p["q"]), "edits": added(lambda p: p["edits"])}).drop("pairs")
    ours = _weigh(typed, idf, ["label", "value", "version"]).select("label", "value", "version", "g")
    theirs = side.select("label", "entry", F.col("value").alias("title"), F.col("version").alias("v"), F.size("rare").alias("n_words"), F.col("g").alias("g_p"))
    scored = met.join(ours, ["label", "value", "version"]).join(theirs, ["label", "entry", "title", "v"]).filter("words = n_words")
    common = total(F.map_filter("g", lambda k, x: F.array_contains(F.map_keys("g_p"), k)))
    score = (F.col("dot") + common) / F.sqrt((F.col("own") + total("g")) * (F.col("own") + total("g_p")))
    right = scored.withColumn("score", score).filter(F.col("score") >= threshold)
    best = right.groupBy("label", "value").agg(F.max(F.struct((-F.col("edits")).alias("near"), "score", (-F.col("entry")).alias("less"))).alias("m"))
    best = best.select("label", "value", (-F.col("m.less")).alias("entry"), F.col("m.score").alias("score"))
    return distinct.join(best, ["label", "value"], "left").select("label", "value", F.coalesce("entry", F.lit(-1).cast("long")).alias("entry"), "score")
