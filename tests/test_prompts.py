"""Prompts keep whole texts up to the model's budget and cut longer ones to their shares."""

import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.operators import judge
from factloom.plans import catalogue

LABELS = ["entailment", "contradiction", "neutral"]
ASK = "Does the premise entail the hypothesis? Answer with one of: entailment, contradiction, neutral.\nanswer:"


def words(n, mark):
    return [f"{mark}{k}" for k in range(n)]


def prompt(evidence, fact):
    return f"premise: {' '.join(evidence)}\nhypothesis: {' '.join(fact)}\n{ASK}"


def test_claim_prompts_cut_over_long_texts_only(spark, tmp_path):
    sizes = {1: (40, 12), 2: (332, 84), 3: (500, 100)}
    rows = [(k, ", ".join(words(e, "e")), " ".join(words(f, "f"))) for k, (e, f) in sizes.items()] + [(4, None, None)]
    spark.createDataFrame(rows, "result_id long, evidence string, fact string").write.parquet(str(tmp_path / "judge_results.parquet"))
    got = {r.result_id: r.prompt_md5 for r in catalogue.queries()["claim_prompts"](spark, str(tmp_path)).collect()}
    wanted = {k: prompt(words(min(e, 332), "e"), words(min(f, 84), "f")) for k, (e, f) in (sizes | {4: (0, 0)}).items()}
    assert got == {k: hashlib.md5(p.encode()).hexdigest() for k, p in wanted.items()}


@pytest.mark.parametrize("budget, evidence, fact", [(12, 9, 3), (10, 8, 2), (1, 0, 1), (0, 0, 0)])
def test_small_budgets(spark, budget, evidence, fact):
    df = spark.createDataFrame([(" ".join(words(20, "e")), " ".join(words(20, "f")))], "e string, f string")
    assert df.select(judge.build_prompt(F.col("e"), F.col("f"), LABELS, budget)).first()[0] == prompt(words(evidence, "e"), words(fact, "f"))
