"""Repetition inside single documents: a learned decision list first, the exact measure where it is undecided.

``cheap_statistics`` are column expressions over a document's text: how various its words
and its pairs of neighbouring words are, and the shares of its characters that stand in
repeated lines, sentences and paragraphs. None of them is the exact measure, which is the
share of words that stand in a run of five that began earlier in the document.

``learn_decision_list`` grows threshold conjunctions on one part of labelled statistics by
sequential covering (each rule takes the condition with the best gain until it is pure, later
conditions are pruned on the other part), removes what the rule covers and goes on, for
either class in turn. A rule may decide only if it is pure on all labelled rows; its
thresholds are then moved away from the other class by ``margin``. The list becomes one
ordered ``CASE WHEN`` column expression, evaluated in the JVM: 'repetitive', 'clean', or, if
no rule holds, 'undecided'. Only undecided documents are measured exactly.

Learning uses a bounded, documented sample of labelled rows (``sample_rows``, chosen by a
hash of the id, so the same at every run); statistics and judging cover all rows.

Defined results: rows with a null id are left out; null and empty texts and those under five
words are clean and have shares of 0; empty tables give empty results; repeated rows are
judged once per row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factloom.functions.text import NOT_WORD
from factloom.llm.words import WORD, gram_hashes

FEATURES = ("word_variety", "pair_variety", "line_share", "sentence_share", "paragraph_share")
ROUND = tuple(sorted({float(Fraction(a, b)) for b in range(1, 13) for a in range(0, b + 1)}))
#: What lies between two lines, sentences and paragraphs.
UNITS = {"line_share": r"\r\n|\r|\n", "sentence_share": r"[.!?]+\s+|[\r\n]+", "paragraph_share": r"(?:\r?\n[ \t]*){2,}"}


def repeated_word_counts(ids: np.ndarray, doc: np.ndarray, n_docs: int, n: int = 5) -> np.ndarray:
    """Per document the words in an ``n``-run that already began earlier in the document.

    ``ids`` holds the words of all documents one after the other, ``doc`` each one's document.
    """
    runs = gram_hashes(ids, n)
    if not len(runs):
        return np.zeros(n_docs, np.int64)
    inside = doc[: len(runs)] == doc[n - 1 :]
    at = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        key = runs[at] ^ (doc[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(at), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at[same], 1)
    np.add.at(edge, at[same] + n, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def _repeated_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words, and words that are repeated, of every text."""
    vocabulary: dict[str, int] = {}
    add, flat, counts = vocabulary.setdefault, [], []
    for text in texts:
        found = [add(w, len(vocabulary)) for w in WORD.findall(text.lower())] if text else []
        flat.append(np.array(found, np.int64))
        counts.append(len(found))
    counts = np.array(counts, np.int64)
    ids = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    return counts, repeated_word_counts(ids, np.repeat(np.arange(len(texts)), counts), len(texts))


@F.pandas_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("repeated_words", T.LongType())]))
def exact_measure(texts: pd.Series) -> pd.DataFrame:
    """The words of a text and those of them that are repeated."""
    parts = [_repeated_counts(texts.iloc[k : k + 1000].tolist()) for k in range(0, len(texts), 1000)] or [_repeated_counts([])]
    return pd.DataFrame({"n_words": np.concatenate([p[0] for p in parts]), "repeated_words": np.concatenate([p[1] for p in parts])})


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _unit_share(text: Column, between: str) -> Column:
    """Share of the characters of non-blank units that stand in units that stood earlier already."""
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, u: s + F.length(u))
    trimmed = F.filter(F.transform(F.split(text, between), lambda u: F.regexp_replace(u, r"^\s+|\s+$", "")), lambda u: u != "")
    share = lambda units: F.when(F.size(units) > 1, 1 - length(F.array_distinct(units)) / length(units)).otherwise(F.lit(0.0))
    return F.when(text.rlike(between), _let(trimmed, share)).otherwise(F.lit(0.0))  # most texts are one line


def unit_shares(text: Column) -> list[Column]:
    """line_share, sentence_share, paragraph_share; case is ignored."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return [_unit_share(lowered, between).alias(name) for name, between in UNITS.items()]


def varieties(text: Column) -> Column:
    """word_variety and pair_variety: different words, and pairs of neighbouring words, over all of them; 1 where there are none."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")
    variety = lambda a: F.when(F.size(a) > 0, F.size(F.array_distinct(a)) / F.size(a)).otherwise(1.0)
    pairs = lambda ws: F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return _let(split, lambda ws: F.struct(variety(ws).alias("word_variety"), _let(pairs(ws), variety).alias("pair_variety")))


def cheap_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and FEATURES of every row with an id; column expressions only."""
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).alias("text"))
    both = varieties(F.col("text"))
    return rows.select(id_col, "text", both.alias("v"), *unit_shares(F.col("text"))).select(id_col, "text", "v.word_variety", "v.pair_variety", *UNITS)


def repetition_shares(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, repeated_words, word_share, line_share, sentence_share, paragraph_share of every document, all exact; narrow."""
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).alias("text"))
    measured = rows.select(id_col, exact_measure("text").alias("m"), *unit_shares(F.col("text")))
    share = F.when(F.col("m.n_words") > 0, F.col("m.repeated_words") / F.col("m.n_words")).otherwise(0.0)
    return measured.select(id_col, "m.n_words", "m.repeated_words", share.alias("word_share"), *UNITS)


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for feature, op, t in rule:
        hit &= (x[feature] >= t).to_numpy() if op == ">=" else (x[feature] < t).to_numpy()
    return hit


def _precision(rule: Rule, x: pd.DataFrame, y: np.ndarray) -> tuple[float, int]:
    hit = _covers(rule, x)
    n = int(hit.sum())
    return (float(y[hit].mean()) if n else 0.0, n)


def _thresholds(values: np.ndarray) -> list[float]:
    """Quantiles of the values and the round fractions between their extremes, round ones first."""
    low, high = float(values.min()), float(values.max())
    return [r for r in ROUND if low < r <= high] + [float(q) for q in np.unique(np.quantile(values, np.linspace(0, 1, 33)))]


def _grow(x: pd.DataFrame, y: np.ndarray, max_conditions: int) -> Rule:
    rule: Rule = []
    hit = np.ones(len(x), bool)
    while len(rule) < max_conditions and y[hit].mean() < 1:
        base, best = float(np.log(max(y[hit].mean(), 1e-9))), (1e-9, None)
        for feature in FEATURES:
            values = x[feature].to_numpy()
            for t in _thresholds(values[hit]):
                for op, side in ((">=", values >= t), ("<", values < t)):
                    both = hit & side
                    p = float(y[both].sum())
                    if p:
                        gain = p * (float(np.log(p / both.sum())) - base)
                        if gain > best[0] + 1e-9 or best[1] and gain > best[0] - 1e-9 and (feature, op) == best[1][:2] and t in ROUND and t < best[1][2] and best[1][2] in ROUND:
                            best = (max(gain, best[0]), (feature, op, t))
        if best[1] is None:
            break
        rule.append(best[1])
        hit = _covers(rule, x)
    return rule


def _covering(x: pd.DataFrame, y: np.ndarray, max_rules: int, max_conditions: int, margin: float) -> list[Rule]:
    """Pure rules for the rows where ``y`` holds, by sequential covering."""
    part = np.arange(len(x)) % 3 == 2
    grow, prune, rules = ~part, part, []
    while y[grow].any() and len(rules) < max_rules:
        rule = _grow(x[grow].reset_index(drop=True), y[grow].astype(float), max_conditions)
        if not rule:
            break
        while len(rule) > 1 and _precision(rule[:-1], x[prune], y[prune].astype(float))[0] >= _precision(rule, x[prune], y[prune].astype(float))[0]:
            rule = rule[:-1]
        hit = _covers(rule, x)
        if not (hit & grow).any():
            break
        firm = [(f, op, t + margin if op == ">=" else t - margin) for f, op, t in rule]
        if y[_covers(rule, x)].all() and _covers(firm, x).any():
            rules.append(firm)
        grow, prune = grow & ~hit, prune & ~hit
    return rules


def learn_decision_list(labelled: pd.DataFrame, label: str = "label", max_rules: int = 8, max_conditions: int = 3, margin: float = 0.03) -> list[tuple[Rule, str]]:
    """Ordered (rule, verdict). ``labelled`` holds FEATURES and a boolean label.

    With rows of one class only there is nothing to learn from: the list is empty, and every
    document gets the exact check.
    """
    x, y = labelled[list(FEATURES)].reset_index(drop=True), labelled[label].to_numpy(bool)
    if y.all() or not y.any():
        return []
    return [(rule, verdict) for own, verdict in ((~y, "clean"), (y, "repetitive")) for rule in _covering(x, own, max_rules, max_conditions, margin)]


def decision_column(rules: list[tuple[Rule, str]]) -> Column:
    """The list as one ``CASE WHEN``: 'repetitive', 'clean', or 'undecided' where no rule holds."""
    out = None
    for rule, verdict in rules:
        test = F.lit(True)
        for feature, op, t in rule:
            test = test & (F.col(feature) >= F.lit(t) if op == ">=" else F.col(feature) < F.lit(t))
        out = F.when(test, verdict) if out is None else out.when(test, verdict)
    return (out.otherwise("undecided") if out is not None else F.lit("undecided")).alias("verdict")


def learned_rules(df: DataFrame, id_col: str, text_col: str, share: tuple[int, int], sample_rows: int) -> list[tuple[Rule, str]]:
    """A decision list from at most ``sample_rows`` documents, labelled by the exact measure.

    The sample is the rows with the smallest hashes of the id among about three times as many.
    """
    a, b = share
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).alias("text"))
    part = min(1.0, 3 * sample_rows / max(rows.select(id_col).count(), 1))  # so that the tasks together send a bounded number of rows
    some = rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) < int(part * (1 << 30)))
    some = some.orderBy(*[F.xxhash64(F.col(id_col), F.lit(salt)) for salt in (9, 10)]).limit(sample_rows).repartition(32)
    sample = cheap_statistics(some, id_col, "text").select(exact_measure("text").alias("m"), *FEATURES).select("m.*", *FEATURES).toPandas()
    sample["label"] = (sample["repeated_words"] > 0) & (sample["repeated_words"] * b >= sample["n_words"] * a)
    return learn_decision_list(sample)


def repetitive_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = (1, 3), sample_rows: int = 6000, rules: list[tuple[Rule, str]] | None = None
) -> DataFrame:
    """id, FEATURES, verdict, n_words, repeated_words (null unless undecided) and ``repetitive`` for every row with an id.

    ``rules`` are learned from the documents unless given. What is undecided is repetitive if
    ``share`` of its words are repeated.
    """
    a, b = share
    statistics = cheap_statistics(df, id_col, text_col)
    if rules is None:
        rules = learned_rules(df, id_col, text_col, share, sample_rows)
    judged = statistics.withColumn("verdict", decision_column(rules))
    open_ = F.col("verdict") == "undecided"
    measured = judged.withColumn("m", exact_measure(F.when(open_, F.col("text"))))
    n, r = F.when(open_, F.col("m.n_words")), F.when(open_, F.col("m.repeated_words"))
    exact = F.coalesce((r > 0) & (r * b >= n * a), F.lit(False))
    return measured.select(id_col, *FEATURES, "verdict", n.alias("n_words"), r.alias("repeated_words"), ((F.col("verdict") == "repetitive") | exact).alias("repetitive"))
