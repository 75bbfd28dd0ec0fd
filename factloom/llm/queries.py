"""Queries of this subpackage's operators over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from factloom.llm import copies, cutoff, ground, leaks, mixture, repeats, spellings, split, versions
from factloom.plans.session import cut, read_table


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    raw, chunks = read_table(spark, d, "raw_texts"), read_table(spark, d, "doc_chunks")
    return split.split_oversized(raw, "raw_texts", "text_id", "text", F.lit(4096), F.lit(400)).unionByName(
        split.split_oversized(chunks, "doc_chunks", "chunk_id", "page_content", F.col("chunk_size_tokens") * 4, F.col("chunk_overlap_tokens") * 4)
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that were cut: those with a first piece."""
    return _pieces(spark, d).filter("piece_index = 0").select("item_table", "item_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p1_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per item: its pieces stay in the limit, begin and end where the item does, follow each other with the wanted overlap, and are its bytes."""
    raw, chunks = read_table(spark, d, "raw_texts"), read_table(spark, d, "doc_chunks")
    items = raw.select(F.lit("raw_texts").alias("item_table"), F.col("text_id").alias("item_id"), "text", F.lit(4096).alias("most"), F.lit(400).alias("overlap")).unionByName(
        chunks.select(F.lit("doc_chunks").alias("item_table"), F.col("chunk_id").alias("item_id"), F.col("page_content").alias("text"), (F.col("chunk_size_tokens") * 4).alias("most"), (F.col("chunk_overlap_tokens") * 4).alias("overlap"))
    )
    before = F.lag("end_byte").over(Window.partitionBy("item_table", "item_id").orderBy("piece_index"))
    pieces = _pieces(spark, d).withColumn("before", before).join(items, ["item_table", "item_id"])
    data = F.encode("text", "UTF-8")
    cut_out = F.substring(data, F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int"))
    shared = F.col("before") - F.col("start_byte")
    return pieces.groupBy("item_table", "item_id").agg(
        F.max(F.octet_length("text")).cast("long").alias("n_bytes"),
        F.bool_and(F.octet_length("piece") <= F.col("most")).alias("within"),
        ((F.min("start_byte") == 0) & (F.max("end_byte") == F.max(F.octet_length("text")))).alias("whole"),
        F.bool_and(F.col("before").isNull() | shared.between(F.col("overlap"), F.col("overlap") + 3)).alias("overlapping"),
        F.bool_and(cut_out == F.encode("piece", "UTF-8")).alias("exact"),
    )


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return versions.similar_texts(read_table(spark, d, "raw_texts"), "text_id", "text", words=3, similarity=0.5, min_words=20)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return versions.similar_pairs(*_versions(spark, d)).select(F.col("a").alias("text_id_a"), F.col("b").alias("text_id_b"))


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    return versions.version_classes(*_versions(spark, d)).withColumnRenamed("id", "text_id")


def _kept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cutoff.keep_by_target(read_table(spark, d, "judge_results"), read_table(spark, d, "keep_targets"), "result_id", ["type", "name"], "score", "keep_permille")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d)[1].select("result_id")


def p3_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d)[0].select(F.col("key_0").alias("type_key"), F.col("key_1").alias("name_key"), "n", "cutoff", "n_kept")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    titles = read_table(spark, d, "wiki_pages").select("label", F.col("title").alias("name"))
    return spellings.spelling_clusters(read_table(spark, d, "entity_mentions"), reference=titles)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spellings.spelling_pairs(_clusters(spark, d))


def p4_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with its entity, named by the entity's most frequent spelling."""
    found = cut(_clusters(spark, d))
    best = found.groupBy("cluster", "label").agg(F.max_by("name", F.struct("n_mentions", "name")).alias("entity"), F.count("*").alias("n_spellings"))
    best = best.withColumnsRenamed({"cluster": "c", "label": "l"})
    return found.join(best, (F.col("cluster") == F.col("c")) & F.col("label").eqNullSafe(F.col("l"))).select("label", "name", "n_mentions", "entity", "n_spellings")


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = copies.parse_json_records(read_table(spark, d, "judge_raw"), "payload", ["name", "fact"], ["result_id"])
    return copies.copy_groups(read_table(spark, d, "judge_results").select("result_id", "name", "fact").unionByName(raw), "result_id", ["name", "fact"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)[1]


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)[0]


def _grounded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    values = ground.typed_values(read_table(spark, d, "graph_nodes"), "node_key", "type", "name", "id", ["Organization", "Product"])
    return values, ground.ground_values(values, read_table(spark, d, "wiki_pages"), "pageid", "title", "label")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    values, found = _grounded(spark, d)
    return values.join(found, ["label", "value"]).select(F.col("key").alias("node_key"), F.col("entry").alias("pageid"))


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    values, found = _grounded(spark, d)
    rows = values.groupBy("label", "value").agg(F.count("*").alias("n_rows"))
    return rows.join(found.filter("entry = -1").select("label", "value"), ["label", "value"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Quality: how much of a text does not repeat itself (see ``repeats``), 0.05 at least."""
    docs = read_table(spark, d, "documents")
    wanted = read_table(spark, d, "mix_targets").select("source").distinct()
    judged = docs.join(wanted, "source", "left_semi").withColumn("quality", F.greatest(repeats.varieties(F.col("text"))["pair_variety"], F.lit(0.05)))
    return mixture.mix_sources(judged, read_table(spark, d, "mix_targets"), quality_col="quality")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per source: distinct texts to choose from, and whether share, repeats and the sums of the report hold."""
    found, shares = _mixed(spark, d)
    sums = found.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("summed"), F.max("copies").alias("most"), F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))
    share = F.abs(F.col("actual_share") - F.col("target_share")) <= 0.01
    return shares.join(sums, "source", "left").select(
        "source", "n_texts", "max_repeats", F.round("target_share", 6).alias("target_share"), share.alias("share_kept"),
        (F.col("most") <= F.col("max_repeats")).alias("repeats_kept"), (F.col("summed") == F.col("tokens")).alias("sums_agree"), (F.col("rows") == F.col("ids")).alias("rows_differ"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repetitive_documents(read_table(spark, d, "documents")).filter("repetitive").select("doc_id")


def p9_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What the learned list says of every document."""
    return repeats.repetitive_documents(read_table(spark, d, "documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of repeated content of every document, all measured."""
    shares = ("word_share", "line_share", "sentence_share", "paragraph_share")
    found = repeats.repetition_shares(read_table(spark, d, "documents"))
    return found.select("doc_id", "n_words", "repeated_words", *[F.round(c, 9).alias(c) for c in shares])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_pieces, p1_invariants, p2_found, p2_versions, p3_found, p3_cutoffs, p4_found, p4_spellings, p5_found, p5_groups,
            p6_found, p6_unmatched, p7_found, p7_leaks, p8_mixture, p8_shares, p8_invariants, p9_found, p9_decisions, p9_shares,
        )
    }


_KEY = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"

_P2 = r"""
with w as (
  select text_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as words from raw_texts where text is not null
), s as (
  select distinct text_id, words[p] || ' ' || words[p+1] || ' ' || words[p+2] as gram
  from (select text_id, words, unnest(range(1, len(words) - 1)) as p from w where len(words) >= 20)
), n as (select text_id, count(*) as n from s group by 1),
b as (select x.text_id as a, y.text_id as b, count(*) as shared from s x join s y on x.gram = y.gram and x.text_id < y.text_id group by 1, 2)
"""

_P3 = f"""
with t as (
  select {_KEY.format("type")} as type_key, {_KEY.format("name")} as name_key, max(keep_permille) as permille from keep_targets group by 1, 2
), r as (
  select result_id, {_KEY.format("type")} as type_key, {_KEY.format("name")} as name_key, score
  from judge_results where score is not null and not isnan(score) and score between -1 and 1
), n as (
  select t.type_key, t.name_key, t.permille, r.result_id, r.score,
    count(*) over (partition by t.type_key, t.name_key) as n,
    count(*) over (partition by t.type_key, t.name_key order by r.score desc range between unbounded preceding and current row) as above
  from t join r using (type_key, name_key)
), c as (
  select type_key, name_key, max(n) as n, max(score) filter (where above * 1000 >= n * permille) as cutoff from n group by 1, 2
)
"""

_P5 = f"""
with recs as (
  select result_id, name, fact from judge_results
  union all
  select result_id, payload::json->>'$.name', payload::json->>'$.fact' from judge_raw where json_valid(payload)
), k as (
  select result_id, {_KEY.format("name")} as n, {_KEY.format("fact")} as f from recs
), g as (
  select result_id, min(result_id) over (partition by n, f) as first_id, count(*) over (partition by n, f) as n_copies
  from k where n <> '' and f <> ''
)
"""

_P9 = r"""
with w as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as words from documents
), runs as (
  select doc_id, p, words[p] || ' ' || words[p+1] || ' ' || words[p+2] || ' ' || words[p+3] || ' ' || words[p+4] as run
  from (select doc_id, words, unnest(range(1, len(words) - 3)) as p from w where len(words) >= 5)
), again as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by doc_id, run order by p) as k from runs) where k > 1
), hit as (
  select doc_id, count(distinct p + o) as repeated_words from again, (select unnest(range(0, 5)) as o) group by 1
)
"""


def _unit_share(between: str) -> str:
    split = f"string_split_regex(lower(coalesce(text, '')), '{between}')"
    units = rf"[u for u in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in {split}] if u <> '']"
    chars = lambda u: f"coalesce(list_sum([length(y) for y in {u}]), 0)"
    return f"round(case when len({units}) > 1 then 1 - {chars(f'list_distinct({units})')} / {chars(units)} else 0.0 end, 9)"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
select 'raw_texts' as item_table, text_id as item_id from raw_texts where octet_length(encode(text)) > 4096
union all
select 'doc_chunks', chunk_id from doc_chunks where octet_length(encode(page_content)) > 4 * chunk_size_tokens""",
        "p1_invariants": """
select 'raw_texts' as item_table, text_id as item_id, octet_length(encode(text)) as n_bytes, true as within, true as whole, true as overlapping, true as exact from raw_texts where octet_length(encode(text)) > 4096
union all
select 'doc_chunks', chunk_id, octet_length(encode(page_content)), true, true, true, true from doc_chunks where octet_length(encode(page_content)) > 4 * chunk_size_tokens""",
        "p2_found": _P2
        + """select b.a as text_id_a, b.b as text_id_b from b join n na on na.text_id = b.a join n nb on nb.text_id = b.b
where 2 * shared >= na.n + nb.n - shared""",
        "p2_versions": _P2.replace("with w as", "with recursive w as")
        + """, k as (select text_id, list_sort(list(gram)) as grams from s group by 1),
m as (select text_id, min(text_id) over (partition by grams) as rep, count(*) over (partition by grams) as n_copies from k),
l as (select b.a, b.b from b join n na on na.text_id = b.a join n nb on nb.text_id = b.b join m x on x.text_id = b.a and x.rep = b.a join m y on y.text_id = b.b and y.rep = b.b
  where 2 * shared >= na.n + nb.n - shared),
e as (select a, b from l union all select b, a from l),
reach as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a),
c as (select a as rep, least(a, min(b)) as class_id from reach group by 1),
d as (select a as rep, count(*) as n_links from e group by 1)
select m.text_id, coalesce(c.class_id, m.rep) as class_id, m.n_copies, coalesce(d.n_links, 0)::bigint as n_links from m left join c using (rep) left join d using (rep)""",
        "p3_found": _P3 + "select result_id from n join c using (type_key, name_key) where score >= cutoff",
        "p3_cutoffs": _P3
        + """select t.type_key, t.name_key, coalesce(c.n, 0) as n, c.cutoff, count(n.score) filter (where n.score >= c.cutoff) as n_kept
from t left join c using (type_key, name_key) left join n using (type_key, name_key) group by 1, 2, 3, 4""",
        "p5_found": _P5 + "select first_id, result_id as copy_id from g where result_id <> first_id",
        "p5_groups": _P5 + "select distinct first_id, n_copies from g where n_copies > 1",
        "p8_invariants": """
with t as (select source, sum(greatest(coalesce(target_share, 0), 0)) as share, greatest(max(coalesce(max_repeats, 1)), 1)::bigint as max_repeats from mix_targets where source is not null group by 1),
x as (select source, count(*) as n_texts from (select text, arg_min(source, doc_id) as source from documents where text <> '' and source in (select source from t) group by text) group by 1)
select source, n_texts, max_repeats, round(share / (select sum(share) from t), 6) as target_share, true as share_kept, true as repeats_kept, true as sums_agree, true as rows_differ from t join x using (source)""",
        "p9_shares": _P9
        + "select w.doc_id, len(words)::bigint as n_words, coalesce(repeated_words, 0)::bigint as repeated_words, round(case when len(words) > 0 then coalesce(repeated_words, 0) / len(words) else 0.0 end, 9) as word_share, "
        + ", ".join(f"{_unit_share(between)} as {name}" for name, between in repeats.UNITS.items())
        + " from documents d join w using (doc_id) left join hit using (doc_id)",
        "p9_found": _P9 + "select doc_id from hit join w using (doc_id) where repeated_words * 3 >= len(words)",
    }
