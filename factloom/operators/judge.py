"""Scoring facts against their evidence and filtering or annotating graph tables by score.

The judge is a provider (``providers``): any function from columns evidence and fact to a
score column. The default measures shared words in the JVM; it is a lexical stand-in and no
entailment model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from factloom.functions.text import NOT_WORD
from factloom.plans.session import cut
from factloom.providers import Judge, LexicalJudge
from factloom.schemas import entity_templates, relation_templates


@dataclass(frozen=True)
class JudgeConfig:
    action: str = "annotate"
    node_threshold: float = 0.5
    rel_threshold: float = 0.5

    def __post_init__(self) -> None:
        if self.action not in ("annotate", "filter"):
            raise ValueError(f"unknown action {self.action!r}")


def node_name(name: Column, node_id: Column) -> Column:
    """The name, or the id where the name is null or empty."""
    return F.coalesce(F.nullif(name, F.lit("")), node_id)


def score_facts(df: DataFrame, judge: Judge, evidence: str = "evidence", fact: str = "fact", name: str = "score") -> DataFrame:
    """``df`` with a score column."""
    return judge.score(df, evidence, fact, name)


def judge_claim(spark: SparkSession, judge: Judge, evidence: str, fact: str) -> float | None:
    """The score of one claim."""
    return score_facts(spark.createDataFrame([(evidence, fact)], "evidence string, fact string"), judge).first()["score"]


def judge_nodes(nodes: DataFrame, chunks: DataFrame, judge: Judge, cfg: JudgeConfig) -> DataFrame:
    """Every node with its fact, score and disposition.

    disposition: 'scored', 'incomplete' (no label or name; annotate keeps it with 0.0, filter
    drops it) or 'untemplated' (kept with 0.0 in both modes). kept and accepted follow.
    """
    templates = F.broadcast(entity_templates(nodes.sparkSession))
    named = nodes.withColumn("shown", node_name(F.col("name"), F.col("id")))
    whole = F.coalesce((F.col("label") != "") & (F.col("shown") != ""), F.lit(False))
    out = named.join(templates, "label", "left").join(chunks.select("chunk_id", F.col("page_content").alias("evidence")), "chunk_id")
    state = F.when(~whole, "incomplete").when(F.col("template").isNull(), "untemplated").otherwise("scored")
    out = out.withColumn("disposition", state).withColumn("fact", F.when(state == "scored", F.concat_ws(" ", "shown", "template")))
    return _decide(score_facts(out, judge), cfg.node_threshold, cfg.action).drop("template", "evidence", "shown")


def _decide(df: DataFrame, threshold: float, action: str) -> DataFrame:
    scored = F.col("disposition") == "scored"
    score = F.when(scored, F.col("score")).otherwise(0.0)
    passed = scored & (score >= threshold) & ~F.isnan(score)
    incomplete = F.col("disposition") == "incomplete"
    kept = F.lit(True) if action == "annotate" else F.when(incomplete, False).when(scored, passed).otherwise(True)
    return df.withColumn("judge_score", score).withColumn("accepted", passed).withColumn("kept", kept).drop("score")


def judge_relations(rels: DataFrame, judged: DataFrame, chunks: DataFrame, judge: Judge, cfg: JudgeConfig) -> DataFrame:
    """Every relation with its fact, score and disposition, after its chunk's nodes were judged.

    An endpoint's name is that of the first kept node (least pos) with its id in the chunk,
    else the id itself. In filter mode a relation whose endpoint was not kept has the
    disposition 'dangling' and is dropped.
    """
    spark = rels.sparkSession
    alive = judged.filter("kept and id is not null")
    first = alive.groupBy("chunk_id", "id").agg(F.min_by(node_name(F.col("name"), F.col("id")), "pos").alias("shown"))
    ends = rels
    for end in ("src", "tgt"):
        ends = ends.join(first.select("chunk_id", F.col("id").alias(f"{end}_id"), F.col("shown").alias(f"{end}_name")), ["chunk_id", f"{end}_id"], "left")
    templates = F.broadcast(relation_templates(spark))
    out = ends.join(templates, "rtype", "left").join(chunks.select("chunk_id", F.col("page_content").alias("evidence")), "chunk_id")
    whole = F.coalesce((F.col("rtype") != "") & (F.col("src_id") != "") & (F.col("tgt_id") != ""), F.lit(False))
    dangling = F.lit(False) if cfg.action == "annotate" else F.col("src_name").isNull() | F.col("tgt_name").isNull()
    state = F.when(~whole, "incomplete").when(dangling, "dangling").when(F.col("infix").isNull(), "untemplated").otherwise("scored")
    text = F.concat("prefix", F.coalesce("src_name", "src_id"), "infix", F.coalesce("tgt_name", "tgt_id"), "suffix")
    out = out.withColumn("disposition", state).withColumn("fact", F.when(state == "scored", text))
    out = _decide(score_facts(out, judge), cfg.rel_threshold, cfg.action)
    out = out.withColumn("kept", F.col("kept") & (F.col("disposition") != "dangling"))
    return out.drop("prefix", "infix", "suffix", "evidence", "src_name", "tgt_name")


def validate_graph(nodes: DataFrame, rels: DataFrame, chunks: DataFrame, judge: Judge | None = None, cfg: JudgeConfig = JudgeConfig()) -> tuple[DataFrame, DataFrame]:
    """(judged nodes, judged relations): two scoring passes, as relations depend on kept nodes.

    The first pass is written once, as three branches read it and scoring may be costly.
    """
    judge = judge or LexicalJudge()
    judged = cut(judge_nodes(nodes, chunks, judge, cfg))
    return judged, judge_relations(rels, judged, chunks, judge, cfg)


def judge_report(judged_nodes: DataFrame, judged_rels: DataFrame) -> DataFrame:
    """kind, disposition, n, n_kept, n_accepted."""
    both = judged_nodes.select(F.lit("node").alias("kind"), "disposition", "kept", "accepted").unionByName(
        judged_rels.select(F.lit("relation").alias("kind"), "disposition", "kept", "accepted")
    )
    return both.groupBy("kind", "disposition").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"), F.count_if("accepted").alias("n_accepted"))


def prompt_budget(max_len: int = 512, overhead: int = 96) -> int:
    """Words left for evidence and fact beside a prompt's fixed part; 512 where a model's maximum is unknown."""
    return max_len - overhead


#: Solved claims (premise, hypothesis, answer) that may go before the question.
EXAMPLES = (
    ("Paris is the capital of France.", "Paris is a city.", "entailment"),
    ("The Nile is the longest river in the world.", "The Nile is an organization.", "contradiction"),
    ("The shop was doing a promotion on Apple.", "Apple is a product.", "neutral"),
)


def question(labels: list[str]) -> str:
    return f"Does the premise entail the hypothesis? Answer with one of: {', '.join(labels)}."


def solved(examples=EXAMPLES) -> str:
    """Solved claims as the beginning of a prompt; nothing for no examples."""
    answers = [answer for *_, answer in EXAMPLES]
    return "".join(f"premise: {p}\nhypothesis: {h}\n{question(answers)}\nanswer: {a}\n\n" for p, h, a in examples)


def build_prompt(evidence: Column, fact: Column, labels: list[str], budget: int, evidence_ratio: float = 0.8, examples=()) -> Column:
    """A question about one claim, evidence and fact cut to their shares of a word budget, after the solved ``examples``."""
    if len(labels) != 3:
        raise ValueError(f"expected 3 labels, got {len(labels)}")
    room = int(budget * evidence_ratio)

    def head(text: Column, n: int) -> Column:
        return F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != ""), 1, n), " ") if n > 0 else F.lit("")

    ask = f"{question(labels)}\nanswer:"
    return F.concat(F.lit(solved(examples) + "premise: "), head(evidence, room), F.lit("\nhypothesis: "), head(fact, budget - room), F.lit("\n" + ask))


def mention_relations(nodes: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rule-based relations: neighbouring mentions of a chunk whose labels a rule joins.

    rules: (source label, relation type, target label); neighbours without a rule have a null type.
    """
    w = Window.partitionBy("chunk_id").orderBy("pos")
    near = nodes.withColumn("tgt_id", F.lead("id").over(w)).withColumn("tgt_label", F.lead("label").over(w)).filter("tgt_id is not null")
    rtype = F.lit(None).cast("string")
    for src, r, tgt in rules:
        rtype = F.when((F.col("label") == src) & (F.col("tgt_label") == tgt), r).otherwise(rtype)
    return near.select("chunk_id", "pos", F.col("id").alias("src_id"), rtype.alias("rtype"), "tgt_id")
