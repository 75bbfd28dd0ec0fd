"""Variant spellings of names: n-gram vectors, a sparse cosine join, average linkage.

Distinct spellings are read (``names``, with a vocabulary learned from the spellings) into a
stem and a guard of qualifiers that must agree; spellings read alike are one form, weighted
by its mentions. Forms under one guard are compared by the cosine of their stems' character
n-grams (two and three letters), weighted by inverse document frequency over all forms of
the label. The join is sparse: a form is posted under its rarest n-grams only, as many as any
partner above ``cosine`` must share one of (prefix filter), long postings are dealt to
several tasks, and candidates are compared by their whole vectors. Of a form's partners the
best ``top_n`` are kept; the default keeps all above the threshold, so hot entities lose
none. An edit check then drops stems that are more than two edits apart or differ by a whole
ending, and marks forms with different given names as never to be joined. Average linkage
groups what is left.

Defined results: null and blank names are no spellings; null labels form a label of their
own; repeated rows only add weight; spellings without a stem stay alone unless read alike
in full; empty tables give empty results; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from factloom.functions.text import is_blank
from factloom.llm.linkage import average_linkage
from factloom.llm.names import Vocabulary, edits, learn_vocabularies, read_name, same_given
from factloom.plans.session import cut

APART = -1000.0


def read_names(df: DataFrame, label: str, text: str, vocabularies: dict[str, Vocabulary], keep: str = "") -> DataFrame:
    """Columns label, text, the long columns in ``keep``, and the reading: stem, guard, extra, words."""
    kept = [c for c in keep.split() if c]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [read_name(lab, t, vocabularies) for lab, t in zip(batch.iloc[:, 0], batch.iloc[:, 1])]
            yield batch.assign(stem=[n.stem for n in names], guard=[n.guard for n in names], extra=[n.extra for n in names], words=[list(n.words) for n in names])

    schema = f"{label} string, {text} string, " + "".join(f"{c} long, " for c in kept) + "stem string, guard string, extra string, words array<string>"
    return df.select(label, text, *kept).mapInPandas(run, schema)


def _ngrams(stem: Column) -> Column:
    padded = F.concat(F.lit("^"), stem, F.lit("$"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda k: F.substr(padded, k, F.lit(n)))
    return F.concat(runs(2), runs(3))


def _vectors(forms: DataFrame) -> DataFrame:
    """form, label, guard, size (letters), gram, w (unit length), tail: the norm from this gram on, rarest first."""
    grams = forms.filter("length(stem) > 0").select("form", "label", "guard", F.length("stem").alias("size"), F.explode(_ngrams(F.col("stem"))).alias("gram"))
    tf = grams.groupBy("form", "label", "guard", "size", "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("label", "gram").agg(F.count("*").alias("df"))
    n = forms.groupBy("label").agg(F.count("*").alias("n"))
    weighed = tf.join(df, ["label", "gram"]).join(n, "label").withColumn("w", F.col("tf") * F.sqrt(F.log1p(F.col("n") / F.col("df"))))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("form")))
    unit = weighed.withColumn("w", F.col("w") / norm)
    rest = Window.partitionBy("form").orderBy("df", "gram").rowsBetween(0, Window.unboundedFollowing)
    return unit.withColumn("tail", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest))).select("form", "label", "guard", "size", "gram", "w", "tail")


def similar_forms(forms: DataFrame, cosine: float, top_n: int | None, posting: int = 2000, gap: int = 2) -> DataFrame:
    """a, b (a < b) and their cosine for forms of one label and guard above the threshold.

    Stems whose lengths differ by more than ``gap`` letters are not compared: no edit check
    would pass them. A guard is an array; forms with one element in common may meet. A posting of more than
    ``posting`` forms is dealt to several tasks on one side and repeated on the other.
    """
    vectors = cut(_vectors(forms))
    posted = vectors.filter(F.col("tail") >= cosine).select("label", F.explode("guard").alias("guard"), "gram", "form", "size")
    shares = posted.groupBy("label", "guard", "gram").agg(F.ceil(F.count("*") / posting).cast("int").alias("parts"), F.count("*").alias("n")).filter("n > 1")
    posted = cut(posted.join(shares, ["label", "guard", "gram"]))
    left = posted.select("label", "guard", "gram", F.pmod(F.xxhash64("form"), F.col("parts")).cast("int").alias("part"), F.col("form").alias("a"), F.col("size").alias("size_a"))
    right = posted.select("label", "guard", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("form").alias("b"), F.col("size").alias("size_b"))
    met = left.join(right, ["label", "guard", "gram", "part"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("size_a") - F.col("size_b")) <= gap)).select("a", "b").distinct()
    whole = vectors.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("v"))
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.try_element_at(F.col("vb"), x["key"]), F.lit(0.0)))
    pairs = met.join(whole.select(F.col("form").alias("a"), F.col("v").alias("va")), "a").join(whole.select(F.col("form").alias("b"), F.col("v").alias("vb")), "b")
    pairs = pairs.select("a", "b", dot.alias("sim")).filter(F.col("sim") >= cosine)
    if top_n is None:
        return pairs
    both = pairs.union(pairs.select("b", "a", "sim"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    return ranked.filter(F.col("rank") <= top_n).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").distinct()


def _same_typed(a: str, b: str) -> bool:
    """Could one stem be the other misspelt: one edit, or two unless only an ending was added."""
    d = edits(a, b, 2)
    short, long = sorted((a, b), key=len)
    return d <= 1 or (d == 2 and len(short) >= 6 and not (len(long) - len(short) == 2 and long.startswith(short[:-1])))


def spelling_clusters(
    df: DataFrame, label: str = "label", name: str = "name", cosine: float = 0.4, threshold: float = 0.2, top_n: int | None = None, reference: DataFrame | None = None
) -> DataFrame:
    """One row per label and spelling: label, name, n_mentions, cluster.

    ``reference`` (label, name) are clean names, where there are any, from which the generic
    words are learned beside the spellings themselves.
    """
    spelled = df.filter(~is_blank(F.col(name))).groupBy(F.col(label).alias("label"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    spelled = cut(spelled)
    vocabularies = learn_vocabularies(spelled, reference)
    read = read_names(spelled, "label", "name", vocabularies, "n")
    key = F.when(F.col("stem") == "", F.col("name")).otherwise(F.lit(""))
    given = F.when(F.col("label") == "Person", F.col("extra")).otherwise(F.lit(""))
    guard = F.when((F.col("label") == "Person") & (F.col("guard") != ""), F.split("guard", "")).otherwise(F.array("guard"))
    read = read.withColumn("given", given).withColumn("form", F.xxhash64("label", "guard", "stem", "given", key)).withColumn("guard", guard)
    read = cut(read.select("label", "name", "n", "guard", "stem", "given", "form"))
    forms = cut(read.groupBy("form", "label", "guard", "stem", "given").agg(F.sum("n").alias("w")))

    side = lambda s: forms.select(F.col("form").alias(s), F.col("stem").alias(f"stem_{s}"), F.col("given").alias(f"given_{s}"), F.col("w").alias(f"w{s}"))

    @F.pandas_udf("boolean")
    def same_typed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_same_typed(x, y) for x, y in zip(a, b)])

    @F.pandas_udf("boolean")
    def compatible(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_given(x, y) for x, y in zip(a, b)])

    pairs = similar_forms(forms, cosine, top_n).join(side("a"), "a").join(side("b"), "b")
    close = pairs.filter(F.levenshtein("stem_a", "stem_b", 4) >= 0).filter(same_typed("stem_a", "stem_b"))
    edges = cut(close.select("a", "b", "wa", "wb", F.when(compatible("given_a", "given_b"), F.col("sim")).otherwise(F.lit(APART)).alias("sim")))
    clusters = average_linkage(edges, threshold)
    return read.join(clusters, F.col("form") == F.col("node"), "left").select("label", "name", F.col("n").alias("n_mentions"), F.coalesce("cluster", "form").alias("cluster"))


def spelling_pairs(clusters: DataFrame) -> DataFrame:
    """All pairs of different spellings of one cluster: label, name_a, name_b (byte order)."""
    one = clusters.select("cluster", "label", F.col("name").alias("name_a"))
    two = clusters.select("cluster", F.col("label").alias("other"), F.col("name").alias("name_b"))
    return one.join(two, "cluster").filter(F.col("label").eqNullSafe(F.col("other")) & (F.col("name_a") < F.col("name_b"))).select("label", "name_a", "name_b")
