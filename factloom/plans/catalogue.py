"""All core queries over the test tables, with their SQL counterparts.

Every query runs over its whole tables. Doubles are rounded on both sides where sums of
floating-point numbers depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from factloom.functions.scores import agreement_zone, score_band, softmax, truth_score
from factloom.functions.text import context_snippet, html_unescape, is_blank, normalized_id, slugify
from factloom.functions.tokens import token_length
from factloom.operators import extract, graph, grounding, judge, resolve, stats, texts
from factloom.plans.session import cut, read_table
from factloom.providers import HashedNgramEmbedder, LexicalJudge, SuffixExtractor
from factloom.schemas import CATEGORY_HINTS, ENTITY_TEMPLATES, LABELS, RELATION_PHRASES, endpoint_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYWORDS = ["Holdings", "central bank", "100%"]
RULES = [("Person", "WORKS_FOR", "Organization"), ("Product", "MADE_BY", "Organization"), ("Organization", "COMPETES_WITH", "Organization"), ("Organization", "SUPPLIES", "Product")]


def query(sql: str | None = None):
    """Register a query, and its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- SQL building blocks ---------------------------------------------------------------

_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _words(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+'))"


def _lexical(evidence: str, fact: str) -> str:
    w = _words(fact)
    return f"(2 * case when len({w}) = 0 then 0.0 else len(list_intersect({w}, {_words(evidence)}))::double / len({w}) end - 1)"


def _case(x: str, pairs: dict[str, str]) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs.items()) + " end"


_NOTBLANK = f"{_strip('text')} <> ''"

# --- texts -----------------------------------------------------------------------------


@query(
    f"""
select text_id, md5(text) as text_md5, length(text) as n_chars from (
  select text_id, {_strip(r"regexp_replace(text, '(?is)\bTo contact the reporters?\b.*', '')")} as text from raw_texts where {_NOTBLANK}
) where """
    + " or ".join(f"contains(lower(text), '{k.lower()}')" for k in KEYWORDS)
)
def doc_clean_keyword(spark: SparkSession, d: str) -> DataFrame:
    cfg = texts.LoaderConfig(clean_regex=texts.BOILERPLATE, keywords=KEYWORDS)
    out = texts.load_texts(read_table(spark, d, "raw_texts"), "text_id", cfg)
    return out.select("text_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query(f"select min(text_id) as text_id, (row_number() over (order by min(text_id)) - 1)::int as idx, md5(text) as text_md5 from raw_texts where {_NOTBLANK} group by text")
def doc_dedup_index(spark: SparkSession, d: str) -> DataFrame:
    found = texts.build_documents(texts.load_texts(read_table(spark, d, "raw_texts"), "text_id"), "text_id")
    return found.select("text_id", "idx", F.md5("text").alias("text_md5"))


@query(f"select text_id, md5(text) as text_md5 from raw_texts where {_NOTBLANK} order by md5('42' || text), text_id limit 10")
def doc_sample(spark: SparkSession, d: str) -> DataFrame:
    found = texts.load_texts(read_table(spark, d, "raw_texts"), "text_id", texts.LoaderConfig(max_texts=10))
    return found.select("text_id", F.md5("text").alias("text_md5"))


@query(
    rf"""
with w as (select text_id, regexp_split_to_array({_strip("text")}, '{_WS}+') as w from raw_texts where {_NOTBLANK}),
c as (select text_id, w, unnest(range(0, greatest(1, ceil((len(w) - 25) / 175.0))::int))::int as chunk_index from w)
select text_id, chunk_index, len(w[chunk_index * 175 + 1 : chunk_index * 175 + 200])::int as n_words,
  md5(array_to_string(w[chunk_index * 175 + 1 : chunk_index * 175 + 200], ' ')) as chunk_md5 from c"""
)
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    found = texts.word_windows(read_table(spark, d, "raw_texts"), "text_id", "text", 200, 25)
    return found.select("text_id", "chunk_index", "n_words", F.md5("chunk").alias("chunk_md5"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    size, overlap = texts.chunk_budget()
    docs = texts.build_documents(texts.load_texts(read_table(spark, d, "raw_texts"), "text_id"), "text_id")
    return texts.chunk_documents(docs, size, overlap)


@query(
    f"""
select (row_number() over (order by min(text_id)) - 1)::int as idx, length(text)::int as parent_len, true as whole, true as within, true as overlapping, true as exact, length(text) > 1024 as several
from raw_texts where {_NOTBLANK} group by text"""
)
def chunk_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per text: its chunks cover it without a gap, stay in the limit, overlap, are its characters, and are several if it is longer than one."""
    size, overlap = texts.chunk_budget()
    docs = cut(texts.build_documents(texts.load_texts(read_table(spark, d, "raw_texts"), "text_id"), "text_id"))
    chunks = texts.chunk_documents(docs, size, overlap).join(docs.select("idx", "text"), "idx")
    before = F.lag("chunk_end").over(Window.partitionBy("idx").orderBy("chunk_index"))
    at = F.substring(F.col("text"), F.col("chunk_start") + 1, F.col("chunk_end") - F.col("chunk_start"))
    each = chunks.withColumn("before", before)
    meets = F.col("chunk_start") == 0
    return each.groupBy("idx", "parent_len").agg(
        (F.bool_and(F.when(F.col("before").isNull(), meets).otherwise(F.col("chunk_start") <= F.col("before"))) & (F.max("chunk_end") == F.col("parent_len"))).alias("whole"),
        F.bool_and(F.col("chunk_end") - F.col("chunk_start") <= 4 * size).alias("within"),
        F.bool_and(F.col("before").isNull() | ((F.col("before") - F.col("chunk_start")).between(1, 4 * overlap))).alias("overlapping"),
        F.bool_and(F.col("page_content") == at).alias("exact"),
        (F.count("*") > 1).alias("several"),
    )


@query()
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every chunk by a public tokenizer, which SQL does not have."""
    return read_table(spark, d, "doc_chunks").select("chunk_id", token_length(F.col("page_content")).alias("n_tokens"))


@query(
    """
select c.idx, count(*) as n_chunks, count(*) filter (where c.page_content = substring(r.text, c.chunk_start + 1, c.chunk_end - c.chunk_start)) as n_exact,
  max(c.chunk_end) as reach, max(length(r.text)) as parent_chars
from doc_chunks c join raw_texts r on r.text_id = c.idx group by 1"""
)
def chunk_audit(spark: SparkSession, d: str) -> DataFrame:
    return texts.audit_chunks(read_table(spark, d, "doc_chunks"), read_table(spark, d, "raw_texts"), "text_id")


@query("select chunk_id, greatest(1, length(page_content) // 4)::int as n_tokens, greatest(1, length(page_content) // 4) > chunk_size_tokens as over_budget from doc_chunks where page_content is not null")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    n = texts.estimated_tokens(F.col("page_content"))
    return read_table(spark, d, "doc_chunks").filter("page_content is not null").select("chunk_id", n.alias("n_tokens"), (n > F.col("chunk_size_tokens")).alias("over_budget"))


@query(f"select node_key, {_slug('name')} as slug, {_slug('name')} || '::' || type as norm_id, coalesce({_slug('name')} || '::' || type = id, false) as same from graph_nodes")
def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    made = normalized_id(F.col("name"), F.col("type"))
    return read_table(spark, d, "graph_nodes").select("node_key", slugify(F.col("name")).alias("slug"), made.alias("norm_id"), F.coalesce(made == F.col("id"), F.lit(False)).alias("same"))


@query(
    """
select doc_id, md5(replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) as text_md5
from documents where text is not null"""
)
def html_unescaped(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(html_unescape(F.col("text"))).alias("text_md5"))


@query(
    """
with h as (
  select m.mention_id, m.name, c.page_content as t, instr(lower(c.page_content), lower(m.name)) as p
  from entity_mentions m join doc_chunks c using (chunk_id) where m.name is not null
)
select mention_id, case when coalesce(length(t), 0) = 0 then '' when p > 0 then substring(t, greatest(p - 1 - 50, 0) + 1, p - 1 + length(name) + 50 - greatest(p - 1 - 50, 0)) else substring(t, 1, 100) end as snippet from h"""
)
def context_snippets(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "doc_chunks").select("chunk_id", "page_content")
    found = read_table(spark, d, "entity_mentions").filter("name is not null").select("mention_id", "name", "chunk_id").join(chunks, "chunk_id")
    return found.select("mention_id", context_snippet(F.col("page_content"), F.col("name"), 100).alias("snippet"))


# --- extraction ------------------------------------------------------------------------


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_mentions(read_table(spark, d, "doc_chunks").filter("page_content is not null"), SuffixExtractor())


_EXTRACTED = r"""
with f as (
  select chunk_id, regexp_extract_all(page_content, '\b((?:[A-Z][\p{L}\p{N}_]+|&)(?: (?:[A-Z][\p{L}\p{N}_]+|&))* (?:Company|Corporation|Group|Holdings|Industries|International|Limited|Partners))\b', 1) as found
  from doc_chunks where page_content is not null
), m as (select chunk_id, generate_subscripts(found, 1) - 1 as pos, unnest(found) as name from f)
"""


@query(_EXTRACTED + f"select chunk_id, pos::bigint as pos, {_slug('name')} || '::Organization' as id, 'Organization' as label, name, false as failed from m")
def extracted_mentions(spark: SparkSession, d: str) -> DataFrame:
    return extract.allowed_mentions(_extracted(spark, d))


@query(_EXTRACTED + "select count(distinct chunk_id) as n_chunks, count(*) as n_mentions, 0::bigint as n_failed_chunks from m")
def extraction_summary(spark: SparkSession, d: str) -> DataFrame:
    return extract.extraction_summary(_extracted(spark, d))


# --- judging ---------------------------------------------------------------------------


@query(f"select result_id, case when fact is not null then round({_lexical('evidence', 'fact')}, 9) end as claim_score from judge_results")
def judge_claims(spark: SparkSession, d: str) -> DataFrame:
    found = judge.score_facts(read_table(spark, d, "judge_results").select("result_id", "evidence", "fact"), LexicalJudge(), name="claim_score")
    return found.select("result_id", F.round("claim_score", 9).alias("claim_score"))


@query(
    rf"""
select result_id, md5('premise: ' || array_to_string(regexp_extract_all(coalesce(evidence, ''), '[\p{{L}}\p{{N}}]+')[1:332], ' ') || chr(10) || 'hypothesis: '
  || array_to_string(regexp_extract_all(coalesce(fact, ''), '[\p{{L}}\p{{N}}]+')[1:84], ' ') || chr(10)
  || 'Does the premise entail the hypothesis? Answer with one of: entailment, contradiction, neutral.' || chr(10) || 'answer:') as prompt_md5 from judge_results"""
)
def claim_prompts(spark: SparkSession, d: str) -> DataFrame:
    prompt = judge.build_prompt(F.col("evidence"), F.col("fact"), ["entailment", "contradiction", "neutral"], judge.prompt_budget())
    return read_table(spark, d, "judge_results").select("result_id", F.md5(prompt).alias("prompt_md5"))


_SOLVED = """premise: Paris is the capital of France.
hypothesis: Paris is a city.
Does the premise entail the hypothesis? Answer with one of: entailment, contradiction, neutral.
answer: entailment

premise: The Nile is the longest river in the world.
hypothesis: The Nile is an organization.
Does the premise entail the hypothesis? Answer with one of: entailment, contradiction, neutral.
answer: contradiction

premise: The shop was doing a promotion on Apple.
hypothesis: Apple is a product.
Does the premise entail the hypothesis? Answer with one of: entailment, contradiction, neutral.
answer: neutral

"""


@query(SQL["claim_prompts"].replace("md5('premise: '", f"md5('{_SOLVED}premise: '"))
def few_shot_prompts(spark: SparkSession, d: str) -> DataFrame:
    prompt = judge.build_prompt(F.col("evidence"), F.col("fact"), ["entailment", "contradiction", "neutral"], judge.prompt_budget(), examples=judge.EXAMPLES)
    return read_table(spark, d, "judge_results").select("result_id", F.md5(prompt).alias("prompt_md5"))


@query("select node_key, id as end_id from graph_nodes where id is not null")
def endpoint_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ends given as objects (every second row) and as bare ids come out alike."""
    rows = read_table(spark, d, "graph_nodes").filter("id is not null")
    ends = rows.select("node_key", F.when(F.col("node_key") % 2 == 0, F.to_json(F.struct("id", F.col("type").alias("label")))).otherwise(F.col("id")).alias("tgt"))
    return ends.select("node_key", endpoint_id(ends, "tgt").alias("end_id"))


@query(
    """
with p as (select result_id, exp(score - greatest(score, -score, 0)) as e, exp(-score - greatest(score, -score, 0)) as c, exp(0 - greatest(score, -score, 0)) as u
  from judge_results where score is not null and not isnan(score) and abs(score) <= 1)
select result_id, round((e - c) / (e + c + u), 9) as truth from p"""
)
def truth_scores(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    entailed, contradicted, _ = softmax([s, -s, F.lit(0.0)])
    rows = read_table(spark, d, "judge_results").filter(s.isNotNull() & ~F.isnan(s) & (F.abs(s) <= 1))
    return rows.select("result_id", F.round(truth_score(entailed, contradicted), 9).alias("truth"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = read_table(spark, d, "doc_chunks").select("chunk_id", "page_content")
    m = read_table(spark, d, "entity_mentions")
    nodes = m.select("chunk_id", F.col("mention_id").alias("pos"), normalized_id(F.col("name"), F.col("label")).alias("id"), "label", "name")
    return nodes, judge.mention_relations(nodes, RULES), chunks


def _validated(spark: SparkSession, d: str, action: str) -> tuple[DataFrame, DataFrame]:
    nodes, rels, chunks = _graph(spark, d)
    return judge.validate_graph(nodes, rels, chunks, LexicalJudge(), judge.JudgeConfig(action, 0.9, 0.5))


_RTYPE = "case " + " ".join(f"when label = '{a}' and tgt_label = '{c}' then '{b}'" for a, b, c in RULES) + " end"


def _validate_sql(action: str) -> str:
    keep = "true" if action == "annotate" else "case state when 'incomplete' then false when 'scored' then accepted else true end"
    dangling = "false" if action == "annotate" else "(s.shown is null or t.shown is null)"
    return f"""
with nodes as (
  select chunk_id, mention_id as pos, {_slug("name")} || '::' || label as id, label, name from entity_mentions
), rels as (
  select chunk_id, pos, id as src_id, {_RTYPE} as rtype, tgt_id from (
    select *, lead(id) over w as tgt_id, lead(label) over w as tgt_label from nodes window w as (partition by chunk_id order by pos)
  ) where tgt_id is not null
), n1 as (
  select n.*, coalesce(nullif(name, ''), id) as shown, c.page_content as evidence, {_case("label", ENTITY_TEMPLATES)} as template
  from nodes n join doc_chunks c using (chunk_id)
), n2 as (
  select *, case when not coalesce(label <> '' and shown <> '', false) then 'incomplete' when template is null then 'untemplated' else 'scored' end as state from n1
), n3 as (
  select *, case when state = 'scored' then shown || ' ' || template end as fact from n2
), n4 as (
  select *, case when state = 'scored' then {_lexical("evidence", "fact")} else 0.0 end as judge_score from n3
), n5 as (select *, state = 'scored' and judge_score >= 0.9 as accepted from n4),
jn as (select *, {keep} as kept from n5),
first as (
  select chunk_id, id, arg_min(shown, pos) as shown from jn where kept and id is not null group by 1, 2
), r1 as (
  select r.*, s.shown as src_name, t.shown as tgt_name, c.page_content as evidence, {_case("rtype", RELATION_PHRASES)} as phrase,
    case when not coalesce(rtype <> '' and src_id <> '' and tgt_id <> '', false) then 'incomplete' when {dangling} then 'dangling'
      when {_case("rtype", RELATION_PHRASES)} is null then 'untemplated' else 'scored' end as state
  from rels r join doc_chunks c using (chunk_id)
  left join first s on s.chunk_id = r.chunk_id and s.id = r.src_id left join first t on t.chunk_id = r.chunk_id and t.id = r.tgt_id
), r2 as (
  select *, case when state = 'scored' then coalesce(src_name, src_id) || ' ' || phrase || ' ' || coalesce(tgt_name, tgt_id) || '.' end as fact from r1
), r3 as (
  select *, case when state = 'scored' then {_lexical("evidence", "fact")} else 0.0 end as judge_score from r2
), r4 as (select *, state = 'scored' and judge_score >= 0.5 as accepted from r3),
jr as (select *, ({keep}) and state <> 'dangling' as kept from r4)
"""


_NODE_OUT = "select pos, state as disposition, fact, round(judge_score, 9) as judge_score, accepted, kept from jn"
_REL_OUT = "select pos, rtype, state as disposition, fact, round(judge_score, 9) as judge_score, accepted, kept from jr"
_REPORT = """select kind, state as disposition, count(*) as n, count(*) filter (where kept) as n_kept, count(*) filter (where accepted) as n_accepted
from (select 'node' as kind, state, kept, accepted from jn union all select 'relation', state, kept, accepted from jr) group by 1, 2"""


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("judge_score", 9).alias("judge_score"), "accepted", "kept")


@query(_validate_sql("filter") + _NODE_OUT)
def validate_filter_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_validated(spark, d, "filter")[0], "pos", "disposition", "fact")


@query(_validate_sql("filter") + _REL_OUT)
def validate_filter_rels(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_validated(spark, d, "filter")[1], "pos", "rtype", "disposition", "fact")


@query(_validate_sql("annotate") + _NODE_OUT)
def validate_annotate_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_validated(spark, d, "annotate")[0], "pos", "disposition", "fact")


@query(_validate_sql("annotate") + _REL_OUT)
def validate_annotate_rels(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_validated(spark, d, "annotate")[1], "pos", "rtype", "disposition", "fact")


@query(_validate_sql("filter") + _REPORT)
def judge_stats(spark: SparkSession, d: str) -> DataFrame:
    return judge.judge_report(*_validated(spark, d, "filter"))


@query(
    f"""
with nodes as (select chunk_id, mention_id as pos, {_slug("name")} || '::' || label as id, label, name from entity_mentions),
rels as (select chunk_id, pos, id as src_id, {_RTYPE} as rtype, tgt_id from (
  select *, lead(id) over w as tgt_id, lead(label) over w as tgt_label from nodes window w as (partition by chunk_id order by pos)) where tgt_id is not null)
select r.pos, r.src_id, r.rtype, r.tgt_id from rels r where rtype in ('WORKS_FOR', 'MADE_BY', 'COMPETES_WITH')"""
)
def strict_relations(spark: SparkSession, d: str) -> DataFrame:
    nodes, rels, _ = _graph(spark, d)
    return graph.strict_relations(rels, nodes).select("pos", "src_id", "rtype", "tgt_id")


# --- disambiguation --------------------------------------------------------------------


@query(
    """
with e as (select vec_id, label, embedding::double[] as v from embeddings where embedding is not null and label is not null)
select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.v, b.v), 6) as sim from e a join e b on a.label = b.label and a.vec_id <> b.vec_id
where a.vec_id % 100 = 0 and list_dot_product(a.v, b.v) >= 0.3"""
)
def embedding_search(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of every vector whose id is divisible by 100, among all vectors."""
    e = read_table(spark, d, "embeddings")
    return resolve.neighbours_of(e.filter("vec_id % 100 = 0"), e, "vec_id", "label", "embedding", 0.3).select("a", "b", F.round("sim", 6).alias("sim"))


@query(
    """
with e as (select vec_id, label, embedding::double[] as v from embeddings where embedding is not null and label is not null),
near as (select a.vec_id as k, b.vec_id as c from e a join e b on a.label = b.label where a.vec_id = b.vec_id or list_dot_product(a.v, b.v) >= 0.3),
size as (select c, count(*) as n from near group by 1)
select e.vec_id, e.label, f.cluster from e join (
  select k, arg_max(c, (n, -c)) as cluster from near join size using (c) group by 1
) f on f.k = e.vec_id"""
)
def community_detect(spark: SparkSession, d: str) -> DataFrame:
    return resolve.greedy_communities(read_table(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.3)


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "entity_mentions").filter(~is_blank(F.col("name")) & F.col("label").isNotNull())
    return resolve.cluster_mentions(m.select("chunk_id", F.col("mention_id").alias("pos"), "label", "name"), HashedNgramEmbedder())


# greedy communities of the trigram vectors that HashedNgramEmbedder makes of '[label] name'
_VOTES = f"""
with m as (select mention_id as pos, label, name from entity_mentions where {_strip("name")} <> '' and label is not null),
t as (select label, name, min(pos) as first, count(*) as n, ' ' || lower('[' || label || '] ' || name) || ' ' as padded from m group by label, name),
g as (select label, first, unnest(list_transform(range(1, length(padded) - 1), lambda k: ('0x' || substring(md5(substring(padded, k, 3)), 1, 8))::bigint % 256)) as place from t),
b as (select label, first, place, count(*) as x from g group by all),
size as (select label, first, sqrt(sum(x * x)) as norm from b group by all),
near as (
  select p.label, p.first as k, q.first as c from b p join b q on p.label = q.label and p.place = q.place
  join size s on s.label = p.label and s.first = p.first join size z on z.label = q.label and z.first = q.first
  group by p.label, p.first, q.first having sum(p.x * q.x) / (any_value(s.norm) * any_value(z.norm)) >= 0.85 - 1e-6
),
weight as (select near.label, near.c, sum(t.n) as size from near join t on t.label = near.label and t.first = near.k group by all),
f as (select near.label, near.k, arg_max(near.c, (weight.size, -near.c)) as cluster from near join weight using (label, c) group by all),
d as (select m.pos, m.label, m.name, f.cluster from m join t using (label, name) join f on f.label = m.label and f.k = t.first),
c as (select label, cluster, arg_max(name, (length(name), -pos)) as canonical from d group by 1, 2),
v as (select label, name, canonical, count(*) as votes, min(pos) as first from d join c using (label, cluster) group by 1, 2, 3),
canon as (select label, name, arg_max(canonical, (votes, length(canonical), -first)) as canonical, arg_max(votes, (votes, length(canonical), -first)) as votes from v group by 1, 2)
"""


@query(_VOTES + "select label, count(distinct cluster) as n_clusters, count(*) as n_mentions from d group by 1")
def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    return resolve.cluster_counts(_clustered(spark, d))


@query(_VOTES + "select * from canon")
def canonical_vote(spark: SparkSession, d: str) -> DataFrame:
    """Canonical names of the clusters of embedded mentions."""
    return resolve.canonical_names(_clustered(spark, d))


@query(_VOTES + "select label, count(*) as n_names, count(distinct canonical) as n_canonical from canon group by 1")
def canonical_report(spark: SparkSession, d: str) -> DataFrame:
    return resolve.canonical_names(_clustered(spark, d)).groupBy("label").agg(F.count("*").alias("n_names"), F.count_distinct("canonical").alias("n_canonical"))


def _remapped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, rels, _ = _graph(spark, d)
    nodes = nodes.filter(~is_blank(F.col("name")) & F.col("label").isNotNull())
    _, renamed, moved = resolve.disambiguate(nodes, rels, _clustered(spark, d))
    return renamed, moved


_REMAP = (
    _VOTES
    + f""", nodes as (select chunk_id, mention_id as pos, {_slug("name")} || '::' || label as id, label, name from entity_mentions),
rels as (select chunk_id, pos, id as src_id, {_RTYPE} as rtype, tgt_id from (
  select *, lead(id) over w as tgt_id, lead(label) over w as tgt_label from nodes window w as (partition by chunk_id order by pos)) where tgt_id is not null),
renamed as (select n.*, coalesce(c.canonical, n.name) as new_name, {_slug("coalesce(c.canonical, n.name)")} || '::' || n.label as new_id
  from nodes n left join canon c using (label, name) where {_strip("n.name")} <> '' and n.label is not null),
moves as (select chunk_id, id as old_id, arg_max(new_id, pos) as new_id from renamed group by 1, 2),
moved as (select r.pos, coalesce(s.new_id, src_id) as src_id, rtype, coalesce(t.new_id, tgt_id) as tgt_id, s.new_id is not null as src_mapped, t.new_id is not null as tgt_mapped
  from rels r left join moves s on s.chunk_id = r.chunk_id and s.old_id = r.src_id left join moves t on t.chunk_id = r.chunk_id and t.old_id = r.tgt_id)
"""
)


@query(_REMAP + "select * from moved")
def remap_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return _remapped(spark, d)[1].select("pos", "src_id", "rtype", "tgt_id", "src_mapped", "tgt_mapped")


@query(
    _REMAP
    + """select 'name_changes' as counter, count(*) filter (where name <> new_name)::bigint as n from renamed
union all select 'id_changes', count(*) filter (where id <> new_id) from renamed
union all select 'src_updates', count(*) filter (where src_mapped) from moved union all select 'tgt_updates', count(*) filter (where tgt_mapped) from moved"""
)
def remap_counters(spark: SparkSession, d: str) -> DataFrame:
    renamed, moved = _remapped(spark, d)
    return graph.remap_counters(renamed, moved)


# --- grounding -------------------------------------------------------------------------


def _named(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "graph_nodes").filter(F.col("type").isin("Organization", "Product") & ~is_blank(F.col("name")))
    return n.select("node_key", F.col("type").alias("label"), "name")


@query(
    rf"""
select node_key, 'intitle:"' || regexp_replace({_strip("replace(name, '\"', '')")}, '{_WS}+', ' ', 'g') || '"' || coalesce(' ' || {_case("type", CATEGORY_HINTS)}, '') as search_query
from graph_nodes where name is not null"""
)
def search_queries(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "graph_nodes").filter("name is not null")
    return n.select("node_key", grounding.search_query(F.col("name"), grounding.category_hint(F.col("type"))).alias("search_query"))


@query(
    f"""
with p as (select label, {_slug("title")} as slug, min(pageid) as pageid from wiki_pages group by 1, 2),
n as (select node_key, type as label, name, {_slug("name")} as slug from graph_nodes where type in ('Organization', 'Product') and {_strip("name")} <> '')
select n.node_key, w.pageid as wiki_pageid, w.title as wiki_title, coalesce(w.fullurl, 'https://en.wikipedia.org/wiki/' || replace(w.title, ' ', '_')) as wiki_url,
  w.description as wiki_description, w.wikidata_id
from n left join p on p.label = n.label and p.slug = n.slug and p.slug <> '' left join wiki_pages w on w.pageid = p.pageid"""
)
def ground_exact(spark: SparkSession, d: str) -> DataFrame:
    nodes, pages = _named(spark, d), read_table(spark, d, "wiki_pages")
    matches = grounding.exact_matches(nodes.select("label", F.col("name").alias("query")).distinct(), pages)
    return grounding.enrich(nodes, matches, pages).select("node_key", "wiki_pageid", "wiki_title", "wiki_url", "wiki_description", "wikidata_id")


@query()
def ground_best(spark: SparkSession, d: str) -> DataFrame:
    """Exact and fuzzy stages; difflib's ratio has no SQL counterpart."""
    return cut(grounding.best_matches(_named(spark, d).select("label", F.col("name").alias("query")), read_table(spark, d, "wiki_pages")))


# --- graph tables ----------------------------------------------------------------------


@query(
    """
select type as label, id, arg_max(name, node_key) filter (where name is not null) as name, arg_max(judge_score, node_key) filter (where judge_score is not null and not isnan(judge_score)) as judge_score,
  arg_max(text_id, node_key) filter (where text_id is not null) as text_id, count(*) as n_rows from graph_nodes where type is not null and id is not null group by 1, 2"""
)
def graph_upsert(spark: SparkSession, d: str) -> DataFrame:
    nodes = read_table(spark, d, "graph_nodes").withColumnRenamed("type", "label")
    return graph.upsert_nodes(nodes, "node_key", ["name", "judge_score", "text_id"])


@query("select text_id as doc, type as label, id, count(*) as n_mentions from graph_nodes where text_id is not null and type is not null and id is not null group by 1, 2, 3")
def graph_mentions(spark: SparkSession, d: str) -> DataFrame:
    return graph.mention_edges(read_table(spark, d, "graph_nodes").withColumnRenamed("type", "label"), "text_id")


@query(_REMAP + "select src_id, rtype, tgt_id, count(*) as n_rows from moved where rtype is not null group by 1, 2, 3")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.upsert_relations(_remapped(spark, d)[1])


@query("select type as label, id, count(*) as n from graph_nodes group by 1, 2 having count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph.repeated_ids(read_table(spark, d, "graph_nodes").withColumnRenamed("type", "label"))


# --- analytics -------------------------------------------------------------------------


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "judge_results")


@query("select r.t as type, r.n as name, count(*) as n from (select arg_min(struct_pack(t := type, n := name), result_id) as r from judge_results group by fact) group by 1, 2")
def facts_count(spark: SparkSession, d: str) -> DataFrame:
    return stats.facts_by_name(_facts(spark, d), "result_id")


def _curve_sql(group: str, where: str) -> str:
    return f"""
with t as (select i::int as threshold_no, i * (1.0::double / 99) as threshold from range(0, 100) r(i))
select f.{group}, t.threshold_no, round(t.threshold, 9) as threshold,
  round(avg(case when not isnan(f.score) and f.score >= t.threshold then 1.0::double else 0.0::double end), 9) as accept_rate
from judge_results f cross join t where f.{group} is not null and {where} group by 1, 2, 3"""


def _curve(df: DataFrame, group: str) -> DataFrame:
    return stats.acceptance_curve(df, group).select(group, "threshold_no", F.round("threshold", 9).alias("threshold"), F.round("accept_rate", 9).alias("accept_rate"))


@query(_curve_sql("type", "true"))
def acceptance_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _curve(_facts(spark, d), "type")


@query(_curve_sql("name", "type = 'node'"))
def acceptance_by_node_label(spark: SparkSession, d: str) -> DataFrame:
    return _curve(_facts(spark, d).filter("type = 'node'"), "name")


@query(_curve_sql("name", "type = 'relation'"))
def acceptance_by_relation(spark: SparkSession, d: str) -> DataFrame:
    return _curve(_facts(spark, d).filter("type = 'relation'"), "name")


@query(
    """
select type, name, case when score is null or isnan(score) or score < -1 or score > 1 then null when score <= -0.5 then 'Very Low' when score <= -0.25 then 'Low'
  when score <= 0 then 'Uncertain (−)' when score <= 0.25 then 'Uncertain (+)' when score <= 0.5 then 'Moderate High' else 'Very High' end as score_band, count(*) as n
from judge_results group by 1, 2, 3"""
)
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    return stats.count_by(_facts(spark, d), "type", "name", score_band(F.col("score")).alias("score_band"))


@query(
    """
select type, case when score is null or isnan(score) or score < -1 or score > 1 then null when score >= 0.5 then 'agree' when score <= -0.5 then 'disagree' else 'uncertain' end as zone,
  count(*) as n from judge_results group by 1, 2"""
)
def agreement_zones(spark: SparkSession, d: str) -> DataFrame:
    return stats.count_by(_facts(spark, d), "type", agreement_zone(F.col("score")).alias("zone"))


@query(
    """
select type, name, count(*) as n, min(score) as low, round(quantile_cont(score, 0.25), 9) as q1, round(quantile_cont(score, 0.5), 9) as median, round(quantile_cont(score, 0.75), 9) as q3,
  max(score) as high, round(avg(score), 9) as mean_score from judge_results where score is not null and not isnan(score) group by 1, 2"""
)
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    found = stats.score_distribution(_facts(spark, d), "type", "name")
    return found.select("type", "name", "n", "low", "high", *[F.round(c, 9).alias(c) for c in ("q1", "median", "q3", "mean_score")])


def _density_sql(group: str, where: str) -> str:
    return f"""
with s as (select {group}, score from judge_results where {group} is not null and score is not null and not isnan(score) and {where}),
g as (select {group}, count(*) as n, 0.8 * pow(count(*), -0.2) * stddev_samp(score) as bw, min(score) as low, max(score) as high from s group by 1 having count(*) > 1 and min(score) < max(score)),
x as (select {group}, n, bw, i::int as point, low - 3 * bw + i * ((high - low + 6 * bw) / 199) as x from g, range(0, 200) r(i)),
f as (select {group}, score, count(*) as c from s group by 1, 2)
select x.{group}, point, round(x, 6) as x, round(sum(f.c * exp(-0.5 * pow((x.x - f.score) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) as density
from x join f using ({group}) group by x.{group}, point, x, n, bw"""


def _density(df: DataFrame, group: str) -> DataFrame:
    return stats.score_density(df, group).select(group, "point", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@query(_density_sql("type", "true"))
def density_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _density(_facts(spark, d), "type")


@query(_density_sql("name", "type = 'node'"))
def density_by_node_label(spark: SparkSession, d: str) -> DataFrame:
    return _density(_facts(spark, d).filter("type = 'node'"), "name")


@query(_density_sql("name", "type = 'relation'"))
def density_by_relation(spark: SparkSession, d: str) -> DataFrame:
    return _density(_facts(spark, d).filter("type = 'relation'"), "name")


@query("select name, count(*) as n, round(avg(score), 9) as mean_score from judge_results where name is not null and score is not null and not isnan(score) group by 1")
def mean_by_name(spark: SparkSession, d: str) -> DataFrame:
    return stats.mean_by_name(_facts(spark, d)).select("name", "n", F.round("mean_score", 9).alias("mean_score"))


_PAIRS = """
with e as (select distinct chunk_id, name from judge_results where chunk_id is not null and name <> ''),
pairs as (select x.name as a, y.name as b, count(*) as w from e x join e y on x.chunk_id = y.chunk_id and x.name < y.name group by 1, 2),
sym as (select a, b, w from pairs union all select b, a, w from pairs),
deg as (select name, sum(w)::bigint as degree from (select a as name, w from sym union all select b, w from sym) group by 1),
top as (select name, degree from deg order by degree desc, name limit 30)
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return stats.cooccurrence_pairs(_facts(spark, d), "chunk_id")


@query(_PAIRS + "select * from pairs")
def cooccurrence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query(_PAIRS + "select * from sym")
def cooccurrence_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return stats.symmetric_weights(_pairs(spark, d))


# by evidence text, the unit of the operator's definition
_BY_EVIDENCE = _PAIRS.replace("distinct chunk_id, name from judge_results where chunk_id is not null", "distinct evidence, name from judge_results where evidence <> ''").replace("x.chunk_id = y.chunk_id", "x.evidence = y.evidence")


@query(_BY_EVIDENCE + "select * from pairs")
def cooccurrence_pairs_by_evidence(spark: SparkSession, d: str) -> DataFrame:
    return stats.cooccurrence_pairs(_facts(spark, d))


@query(_BY_EVIDENCE + "select * from top")
def degree_top30_by_evidence(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_names(stats.weighted_degrees(stats.symmetric_weights(stats.cooccurrence_pairs(_facts(spark, d)))))


@query(_BY_EVIDENCE + "select x.name as a, y.name as b, coalesce(s.w, 0)::bigint as w from top x cross join top y left join sym s on s.a = x.name and s.b = y.name")
def cooccurrence_matrix_by_evidence(spark: SparkSession, d: str) -> DataFrame:
    sym = cut(stats.symmetric_weights(stats.cooccurrence_pairs(_facts(spark, d))))
    return stats.dense_matrix(sym, stats.top_names(stats.weighted_degrees(sym)))


@query("select name, min(result_id) as first from judge_results group by name")
def distinct_names(spark: SparkSession, d: str) -> DataFrame:
    return stats.distinct_in_order(_facts(spark, d), "name", "result_id")


@query("select result_id, type, name, fact from judge_results order by result_id limit 5")
def preview_facts(spark: SparkSession, d: str) -> DataFrame:
    return stats.preview(_facts(spark, d), "result_id").select("result_id", "type", "name", "fact")


@query(_PAIRS + "select * from top")
def degree_top30(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_names(stats.weighted_degrees(stats.symmetric_weights(_pairs(spark, d))))


@query(_PAIRS + "select x.name as a, y.name as b, coalesce(s.w, 0)::bigint as w from top x cross join top y left join sym s on s.a = x.name and s.b = y.name")
def cooccurrence_matrix(spark: SparkSession, d: str) -> DataFrame:
    sym = cut(stats.symmetric_weights(_pairs(spark, d)))
    return stats.dense_matrix(sym, stats.top_names(stats.weighted_degrees(sym)))


@query("select result_id, score from judge_results where score is not null and not isnan(score) order by abs(score), result_id limit 100")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return stats.review_queue(_facts(spark, d), "result_id", 100).select("result_id", "score")


assert set(LABELS) == set(ENTITY_TEMPLATES)
