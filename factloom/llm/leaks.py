"""Evaluation texts leaking into training text: rare n-gram seeds, then local alignment.

The items are a stated query set. How many items hold each of their words and n-grams is
counted over all of them. First pass over the documents: how many hold each n-gram of the
items. Seeds are the n-grams that few documents hold and, so that a passage that leaked into
very many documents still has seeds, the ``per_window`` rarest of every window of ``passage``
words of an item (None: all of them). Second pass: the seeds that a document shares with an
item fall into clusters that are near each other in both texts; around each cluster the two
are aligned (Smith-Waterman over words, words with a few changed letters count almost in
full) if enough of some stretch of the item is there in unchanged words. Every alignment that
is long enough is judged, not only the best: it must cover a passage and its words, weighted
by their rarity among the items, must mostly agree, so a document that only has the form of
an item in common is not reported, and such a form does not hide a passage beside it.

Both passes are narrow over whole documents: no text is shuffled, no document is gathered, no
matrix is larger than a segment of either text. A task holds at most ``block_chars`` characters
of items; more items take further passes with the same counts, so the rows do not depend on it.

Defined results: null and empty documents and items leak nothing; items under ``least``
words have no passage; repeated ids give one row; empty tables give an empty result; only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factloom.llm.words import WORD, words_of
from factloom.plans.session import cut

LEAKS = "{doc} long, {item} long, matched_words int, item_words int, weight_share double"
GAP, MISMATCH, NEAR = 0.5, -0.5, 0.8
#: Words between seeds of one cluster, words aligned around a cluster, and the longest side of an alignment.
LINK, MARGIN, SEGMENT = 32, 48, 512


@dataclass
class ItemBlock:
    """A block of items with its vocabulary; small enough to send to every task.

    ``word_df`` and ``held`` say, word by word and n-gram by n-gram, how many of all
    ``n_items`` items hold it, whatever the block.
    """

    ids: list[int]
    words: list[list[str]]
    word_df: list[np.ndarray]
    held: list[np.ndarray]
    n_items: int
    rarest: float
    n: int = 3
    vocabulary: dict[str, int] = field(default_factory=dict)
    matrices: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for words in self.words:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.coded = [np.array([self.vocabulary[w] for w in words], np.int64) for words in self.words]
        df = np.ones(len(self.vocabulary))
        for c, d in zip(self.coded, self.word_df):
            df[c] = d
        idf = np.log((1 + self.n_items) / np.maximum(df, 1))
        self.weight = np.maximum(idf / max(self.rarest, 1e-9), 0.02) if self.n_items > 1 else np.ones(len(df))
        self.grams = [self.codes(c) for c in self.coded]
        self.all_grams = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, np.int64)

    def pairs(self, item: int) -> np.ndarray:
        """The letter pairs of the item's words, made once in every worker."""
        if item not in self.matrices:
            if len(self.matrices) > 2000:
                self.matrices.clear()
            self.matrices[item] = pair_matrix(self.words[item])
        return self.matrices[item]

    def present(self, item: int, low: int, high: int, ids: np.ndarray, span: int) -> float:
        """The greatest share of weight, over stretches of ``span`` of the item's words low..high, that is in ``ids``."""
        coded = self.coded[item][low:high]
        weight = self.weight[coded]
        there = np.zeros(len(self.vocabulary) + 1, bool)
        there[ids] = True  # unknown words fall on the last place
        has = np.cumsum(np.concatenate([[0.0], weight * there[coded]]))
        all_ = np.cumsum(np.concatenate([[0.0], weight]))
        span = min(span, len(coded))
        return float(((has[span:] - has[: len(has) - span]) / (all_[span:] - all_[: len(all_) - span])).max())

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """One number per n-gram, -1 where a word is not of the vocabulary."""
        m = len(ids) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        size, out, known = len(self.vocabulary) + 1, np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(self.n):
            part = ids[k : k + m]
            out = out * size + part
            known &= part >= 0
        return np.where(known, out, -1)

    def encode(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of every text, all their ids one after the other (a -1 after each text), starts."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        get, flat = self.vocabulary.get, []
        starts = np.zeros(len(words) + 1, np.int64)
        for k, w in enumerate(words):
            flat.extend([get(x, -1) for x in w])
            flat.append(-1)
            starts[k + 1] = len(flat)
        return words, np.array(flat, np.int64), starts


def item_statistics(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, words, and how many items hold each word (``word_df``) and each n-gram (``held``), in the order of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [words_of(t) for t in batch.iloc[:, 1]]
            yield pd.DataFrame({"id": batch.iloc[:, 0], "words": found, "grams": [["\0".join(w[k : k + n]) for k in range(len(w) - n + 1)] for w in found]})

    rows = items.select(F.col(id_col).cast("long"), text_col).filter(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).dropDuplicates()
    split = cut(rows.mapInPandas(run, "id long, words array<string>, grams array<string>").withColumn("key", F.xxhash64("id", "words")))

    def counted(column: str, name: str) -> DataFrame:
        each = split.select("key", F.posexplode(column).alias("k", "x"))
        df = each.groupBy("x").agg(F.count_distinct("key").alias("df"))
        return each.join(df, "x").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "df"))), lambda e: e["df"]).alias(name))

    none = F.array().cast("array<long>")
    both = split.drop("grams").join(counted("words", "word_df"), "key", "left").join(counted("grams", "held"), "key", "left")
    return cut(both.select("id", "words", F.coalesce("word_df", none).alias("word_df"), F.coalesce("held", none).alias("held")))


def item_blocks(items: DataFrame, id_col: str, text_col: str, n: int, block_chars: int) -> Iterator[ItemBlock]:
    """The items in blocks of at most ``block_chars`` characters of words (one item at least)."""
    rows = item_statistics(items, id_col, text_col, n)
    whole = rows.agg(F.count("*").alias("n"), F.min(F.array_min("word_df")).alias("least")).first()
    rarest = float(np.log((1 + whole["n"]) / whole["least"])) if whole["least"] else 0.0
    ids, words, dfs, held, size = [], [], [], [], 0
    for r in rows.orderBy("id", "words").toLocalIterator():
        length = sum(map(len, r["words"])) + len(r["words"])
        if ids and size + length > block_chars:
            yield ItemBlock(ids, words, dfs, held, whole["n"], rarest, n)
            ids, words, dfs, held, size = [], [], [], [], 0
        ids.append(r["id"])
        words.append(r["words"])
        dfs.append(np.array(r["word_df"], np.int64))
        held.append(np.array(r["held"], np.int64))
        size += length
    if ids:
        yield ItemBlock(ids, words, dfs, held, whole["n"], rarest, n)


def gram_document_counts(docs: DataFrame, text_col: str, block: ItemBlock) -> tuple[np.ndarray, int]:
    """For each of the block's n-grams, in the order of ``all_grams``, the documents that hold it; all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(block.all_grams), np.int64), 0
        for batch in batches:
            n += len(batch)
            texts = batch.iloc[:, 0].tolist()
            for k in range(0, len(texts), 1000):
                _, flat, starts = block.encode(texts[k : k + 1000])
                code = block.codes(flat)
                at = np.flatnonzero(code >= 0)
                place = np.searchsorted(block.all_grams, code[at])
                hit = (place < len(block.all_grams)) & (block.all_grams[np.minimum(place, len(block.all_grams) - 1)] == code[at])
                doc = np.searchsorted(starts, at[hit], side="right")
                pairs = np.unique(doc * np.int64(len(block.all_grams)) + place[hit])
                total += np.bincount(pairs % len(block.all_grams), minlength=len(total))
        there = np.flatnonzero(total)
        yield pd.DataFrame({"gram": np.append(there, -1), "df": np.append(total[there], n)})

    counts = np.zeros(len(block.all_grams) + 1, np.int64)  # the last place is the number of documents
    if len(block.all_grams):
        for r in docs.select(text_col).mapInPandas(run, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect():
            counts[r["gram"]] = r["df"]
    return counts[:-1], int(counts[-1])


def rare_seeds(block: ItemBlock, counts: np.ndarray, n_docs: int, rare_share: float, passage: int, per_window: int | None) -> dict[int, list[tuple[int, int]]]:
    """Seed n-gram -> the (item, position) that have it.

    An n-gram is as common as the greater of its shares of the documents and of the items,
    so neither words of the trade nor the items' own forms make seeds. Ties go by position.
    """
    seeds: dict[int, list[tuple[int, int]]] = {}
    for item, grams in enumerate(block.grams):
        if not len(grams):
            continue
        df, held = counts[np.searchsorted(block.all_grams, grams)], block.held[item]
        of_items = held / max(block.n_items, 1)
        common = np.maximum(df / max(n_docs, 1), of_items)
        chosen = (df <= rare_share * n_docs) & (held == 1)
        width = min(passage - block.n + 1, len(grams))
        rank = np.empty(len(grams))
        rank[np.lexsort((np.arange(len(grams)), of_items, common))] = np.arange(len(grams))
        for s in range(len(grams) - width + 1):
            chosen[s + np.argsort(rank[s : s + width])[:per_window]] = True
        for k in np.flatnonzero(chosen):
            seeds.setdefault(int(grams[k]), []).append((item, int(k)))
    return seeds


@lru_cache(200_000)
def letter_pairs(word: str) -> tuple[int, ...]:
    padded = f"^{word}$"
    return tuple({(ord(a) * 31 + ord(b)) & 1023 for a, b in zip(padded, padded[1:])})


def pair_matrix(words: list[str]) -> np.ndarray:
    """Which letter pairs each word has; words of up to three letters have none here."""
    m = np.zeros((len(words), 1024), np.float32)
    for k, w in enumerate(words):
        if len(w) > 3:
            m[k, list(letter_pairs(w))] = 1
    return m


def near_words(a: np.ndarray, b: np.ndarray, dice: float = 0.55) -> np.ndarray:
    """Which words, given by their letter pairs, differ in a few letters only."""
    return 2 * (a @ b.T) >= dice * np.maximum(a.sum(1)[:, None] + b.sum(1)[None, :], 1)


def align(score: np.ndarray) -> tuple[list[tuple[int, int]], int, int]:
    """Best local alignment of a word score matrix: aligned cells, first and last row of it."""
    rows, cols = score.shape
    h = np.zeros((rows + 1, cols + 1), np.float32)
    slope = GAP * np.arange(cols, dtype=np.float32)
    for i in range(rows):
        best = np.maximum(np.maximum(h[i, :-1] + score[i], h[i, 1:] - GAP), 0)
        h[i + 1, 1:] = np.maximum.accumulate(best + slope) - slope
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    last, cells = int(i) - 1, []
    while i > 0 and j > 0 and h[i, j] > 1e-4:
        if abs(h[i, j] - (h[i - 1, j - 1] + score[i - 1, j - 1])) < 1e-3:
            i, j = i - 1, j - 1
            cells.append((int(i), int(j)))
        elif abs(h[i, j] - (h[i - 1, j] - GAP)) < 1e-3:
            i -= 1
        else:
            j -= 1
    return cells, int(i), last


@dataclass(frozen=True)
class Limits:
    """What a leak must reach: a passage of ``span`` item words of which ``matched`` agree, or
    ``alone`` words that agree; ``share`` of its words and ``weight`` of their weight."""

    span: int = 11
    matched: int = 9
    alone: int = 10
    share: float = 0.65
    weight: float = 0.78
    present: float = 0.55


def seed_clusters(hits: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """(document, item) positions of seeds in groups whose members are linked by neighbours within ``LINK`` words in both.

    Groups that span more than ``SEGMENT`` words are divided, with ``MARGIN`` words of either side in common.
    """
    hits = sorted(set(hits))
    group = list(range(len(hits)))

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    recent = 0
    for k, (d, i) in enumerate(hits):
        while hits[recent][0] < d - LINK:
            recent += 1
        for other in range(k - 1, recent - 1, -1):
            if abs(hits[other][1] - i) <= LINK:
                group[root(k)] = root(other)
                if hits[other][1] == i - (d - hits[other][0]):
                    break  # the diagonal neighbour is linked to all before it
    found: dict[int, list[tuple[int, int]]] = {}
    for k, h in enumerate(hits):
        found.setdefault(root(k), []).append(h)
    return [part for g in found.values() for part in _divided(g)]


def _divided(hits: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    for side in (0, 1):
        low, high = min(h[side] for h in hits), max(h[side] for h in hits)
        if high - low > SEGMENT:
            middle = (low + high) // 2
            one, two = [h for h in hits if h[side] <= middle + MARGIN], [h for h in hits if h[side] >= middle - MARGIN]
            return _divided(one) + _divided(two)
    return [hits]


def judge_window(block: ItemBlock, item: int, rows: tuple[int, int], words: list[str], ids: np.ndarray, limits: Limits) -> tuple[int, int, float] | None:
    """(matched words, words of the passage, weight share) of the best alignment that is a leak.

    An alignment that is none is struck out, and the next best is judged, until none is left
    that could be long enough.
    """
    coded = block.coded[item][rows[0] : rows[1]]
    score = np.where(coded[:, None] == ids[None, :], np.float32(1), np.float32(MISMATCH))
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        kinds, back = np.unique([words[k] for k in unknown], return_inverse=True)
        close = near_words(block.pairs(item)[rows[0] : rows[1]], pair_matrix(kinds.tolist()))[:, back]
        score[:, unknown] = np.where(close, np.float32(NEAR), np.float32(MISMATCH))
    weight = block.weight[coded]
    while (score > 0).any(1).sum() >= min(limits.matched, limits.alone):
        cells, first, last = align(score)
        agree = [i for i, j in cells if score[i, j] > 0]
        if len(agree) < min(limits.matched, limits.alone):
            return None
        span = last - first + 1
        share = float(weight[agree].sum() / max(weight[first : last + 1].sum(), 1e-9))
        long_enough = len(agree) >= limits.alone or (span >= limits.span and len(agree) >= limits.matched)
        if long_enough and len(agree) >= limits.share * span and share >= limits.weight:
            return len(agree), span, share
        for i, j in cells:
            score[i, j] = MISMATCH
    return None


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    n: int = 3,
    passage: int = 12,
    least: int = 10,
    per_window: int | None = 6,
    rare_share: float = 0.002,
    block_chars: int = 16_000_000,
    limits: Limits = Limits(),
) -> DataFrame:
    """One row per document and item it leaks: doc_id, item_id, matched_words, item_words, weight_share."""
    schema = LEAKS.format(doc=doc_id, item=item_id)
    docs = docs.filter(F.col(doc_id).isNotNull() & (F.length(text_col) > 0)).select(F.col(doc_id).cast("long"), text_col)
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items, item_id, text_col, n, block_chars):
        counts, n_docs = gram_document_counts(docs, text_col, block)
        seeds = rare_seeds(block, counts, n_docs, rare_share, passage, per_window)
        out = out.unionByName(_aligned(docs, doc_id, text_col, block, seeds, schema, passage, least, limits))
    return out.groupBy(doc_id, item_id).agg(F.max_by(F.struct("matched_words", "item_words", "weight_share"), F.struct("weight_share", "matched_words", "item_words")).alias("m")).select(doc_id, item_id, "m.*")


def _aligned(docs: DataFrame, doc_id: str, text_col: str, block: ItemBlock, seeds: dict, schema: str, passage: int, least: int, limits: Limits) -> DataFrame:
    seed_codes = np.array(sorted(seeds), np.int64)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k in range(0, len(batch), 500):
                part = batch.iloc[k : k + 500]
                doc_ids = part.iloc[:, 0].to_numpy()
                words, flat, starts = block.encode(part.iloc[:, 1].tolist())
                code = block.codes(flat)
                at = np.flatnonzero(code >= 0)
                if not len(seed_codes) or not len(at):
                    continue
                place = np.minimum(np.searchsorted(seed_codes, code[at]), len(seed_codes) - 1)
                at = at[seed_codes[place] == code[at]]
                met: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for position, d in zip(at, np.searchsorted(starts, at, side="right") - 1):
                    for item, k in seeds[int(code[position])]:
                        met.setdefault((int(d), item), []).append((int(position - starts[d]), k))
                for (d, item), hits in met.items():
                    size = len(block.coded[item])
                    if size < least:
                        continue
                    whole, best = flat[starts[d] : starts[d + 1] - 1], None
                    for cluster in seed_clusters(hits):
                        low, high = max(0, min(h[0] for h in cluster) - MARGIN), max(h[0] for h in cluster) + MARGIN
                        side = max(0, min(h[1] for h in cluster) - MARGIN), min(size, max(h[1] for h in cluster) + MARGIN)
                        ids = whole[low:high]
                        if block.present(item, *side, ids, limits.span) < limits.present:
                            continue
                        found = judge_window(block, item, side, words[d][low:high], ids, limits)
                        if found and (best is None or found[::-1] > best[::-1]):
                            best = found
                    if best:
                        rows.append((int(doc_ids[d]), block.ids[item], *best))
            yield pd.DataFrame(rows, columns=names)

    return docs.mapInPandas(run, schema)
