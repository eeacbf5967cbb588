"""Tree models as text, documents, rules and expressions; the best first split."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators import splits
from seqlab.operators.encode import assemble, vector_values
from seqlab.operators.models import loss_gradient, save_model, train
from seqlab.operators.rules import (document_nodes, node_differences, rule_expression, rules_met, score_rules, text_nodes,
                                    tree_documents, tree_nodes, tree_rules)
from seqlab.sources.logs import read_lines_ordered

NODES = ("tree int, id int, prediction double, left int, right int, feature int, values array<double>, num_categories int")
GOLDEN = [(1, 0, None, 1, 2, 0, [0.5], -1), (1, 1, 0.0, -1, -1, -1, [], -1), (1, 2, None, 3, 4, 6, [1.0, 2.0], 3),
          (1, 3, 1.0, -1, -1, -1, [], -1), (1, 4, 2.0, -1, -1, -1, [], -1)]
TEXT = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5, numClasses=3, numFeatures=7
  If (feature 0 <= 0.5)
   Predict: 0.0
  Else (feature 0 > 0.5)
   If (feature 6 in {1.0,2.0})
    Predict: 1.0
   Else (feature 6 not in {1.0,2.0})
    Predict: 2.0
"""


def lines(spark, text):
    return spark.createDataFrame([("m", 0, i, s) for i, s in enumerate(text.split("\n"))], "file_path string, block long, pos long, line string")


def test_printed_tree_gives_the_nodes(spark):
    nodes = text_nodes(lines(spark, TEXT))
    assert node_differences(nodes, spark.createDataFrame(GOLDEN, NODES)).collect()[0]["differences"] == 0
    changed = [r if r[1] != 3 else (*r[:2], 5.0, *r[3:]) for r in GOLDEN]
    assert node_differences(nodes, spark.createDataFrame(changed, NODES)).collect()[0]["differences"] == 1
    assert node_differences(nodes, spark.createDataFrame(GOLDEN[:4], NODES)).collect()[0]["differences"] == 1


def test_printed_leaf_forest_and_two_files(spark):
    forest = "Forest: numTrees=2\n  Tree 0 (weight 1.0):\n    Predict: 3.0\n  Tree 1 (weight 1.0):\n    If (feature 2 in {})\n     Predict: 1.0\n    Else (feature 2 not in {})\n     Predict: 1.0E-4\n"
    both = lines(spark, forest).union(lines(spark, TEXT).withColumn("file_path", F.lit("n")))
    rows = text_nodes(both).orderBy("file_path", "tree", "id").collect()
    assert [(r["tree"], r["id"], r["prediction"], r["left"], r["right"]) for r in rows if r["file_path"] == "m"] == [
        (1, 0, 3.0, -1, -1), (2, 0, None, 1, 2), (2, 1, 1.0, -1, -1), (2, 2, 1e-4, -1, -1)]
    assert [r["values"] for r in rows if r["file_path"] == "m" and r["left"] > 0] == [[]]
    assert sum(r["file_path"] == "n" for r in rows) == 5
    assert text_nodes(lines(spark, "")).collect() == []


def test_document_of_a_tree_and_back(spark):
    nodes = spark.createDataFrame(GOLDEN + [(2, 0, 7.0, -1, -1, -1, [], -1)], NODES)
    docs = {r["tree"]: json.loads(r["json"]) for r in tree_documents(nodes).collect()}
    assert docs == {
        1: {"name": "Root", "children": [
            {"name": "feature 0 <= 0.5", "children": [{"name": "Predict: 0.0"}]},
            {"name": "feature 0 > 0.5", "children": [
                {"name": "feature 6 in {1.0,2.0}", "children": [{"name": "Predict: 1.0"}]},
                {"name": "feature 6 not in {1.0,2.0}", "children": [{"name": "Predict: 2.0"}]}]}]},
        2: {"name": "Root", "children": [{"name": "Predict: 7.0"}]}}
    back = document_nodes(tree_documents(nodes))
    assert {r["tree"]: r["differences"] for r in node_differences(back, nodes).collect()} == {1: 0, 2: 0}
    empty = spark.createDataFrame([], NODES)
    assert tree_documents(empty).collect() == []


def _rows(spark, n=400):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, float(rng.randint(0, 6)), float(rng.randint(0, 2)), rng.random(), float(rng.randint(0, 3))) for i in range(n)],
                               "id long, a double, cat double, b double, label double")
    return assemble(df, ["a", "cat", "b"], nominal={"cat": 3})


@pytest.mark.parametrize("algorithm", ["tree", "forest"])
def test_model_text_documents_and_rules_agree(spark, tmp_dir, algorithm):
    df = _rows(spark)
    model = train(algorithm, df, num_trees=3, max_depth=6, max_bins=16)
    save_model(model, f"{tmp_dir}/m")
    nodes = tree_nodes(spark, f"{tmp_dir}/m")
    spark.createDataFrame([(model.toDebugString,)], "value string").write.text(f"{tmp_dir}/text")
    parsed = text_nodes(read_lines_ordered(spark, f"{tmp_dir}/text"))
    n = 3 if algorithm == "forest" else 1
    for other in (parsed, document_nodes(tree_documents(nodes))):
        assert [r["differences"] for r in node_differences(other, nodes).collect()] == [0] * n
    x = df.select("id", vector_values("features").alias("x"))
    met = rules_met(x, tree_rules(spark, parsed)).collect()
    assert len(met) == 400 * n and {r["n_met"] for r in met} == {1}
    plan = score_rules(x, tree_rules(spark, nodes))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_expression_takes_the_unmet_branch_for_missing_values(spark):
    cond = lambda f, op, v: {"feature": f, "op": op, "vals": v}
    for first, second in ((1, 2), (2, 1)):       # <= 0.5 or > 0.5 first
        rules = [{"conds": [cond(0, first, [0.5])], "prediction": float(first)}, {"conds": [cond(0, second, [0.5])], "prediction": float(second)}]
        df = spark.createDataFrame([([0.5],), ([0.6],), ([None],), ([math.nan],)], "x array<double>")
        assert [r[0] for r in df.select(F.expr(rule_expression(rules))).collect()] == [1.0, 2.0, 2.0, 2.0]
    rules = [{"conds": [cond(0, 5, [1.0])], "prediction": 0.0}, {"conds": [cond(0, 4, [1.0])], "prediction": 1.0}]
    assert [r[0] for r in spark.createDataFrame([([1.0],), ([2.0],)], "x array<double>").select(F.expr(rule_expression(rules))).collect()] == [1.0, 0.0]
    assert rule_expression([{"conds": [], "prediction": 4.0}]) == "4.0D"


def test_rules_met_tries_every_rule_without_carrying_them(spark):
    """All conditions, NULL, NaN, rules that overlap and none; no row carries a tree's rules."""
    rng = random.Random(4)
    of = {0: lambda v, t: v >= t[0], 1: lambda v, t: v <= t[0], 2: lambda v, t: v > t[0], 3: lambda v, t: v < t[0],
          4: lambda v, t: v in t, 5: lambda v, t: v not in t}
    rules = [(rng.randint(1, 3), i, [(rng.randint(0, 2), op, [float(rng.randint(0, 4)) for _ in range(rng.randint(0, 3) if op >= 4 else 1)])
                                    for op in rng.choices(range(6), k=rng.randint(0, 3))], float(i)) for i in range(60)]
    value = lambda: rng.choice([None, math.nan, *map(float, range(5))])
    rows = [(i, None if i == 7 else [value(), value(), value()]) for i in range(300)]
    table = spark.createDataFrame(rules, "tree int, leaf int, conds array<struct<feature:int,op:int,vals:array<double>>>, prediction double")
    met = rules_met(spark.createDataFrame(rows, "id long, x array<double>").repartition(3), table)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and met.columns == ["id", "x", "tree", "n_met", "prediction"]
    big = lambda v: math.inf if v != v else v   # noqa: E731     NaN is above all numbers
    got = {(r["id"], r["tree"]): (r["n_met"], r["prediction"]) for r in met.collect()}
    assert len(got) == 900
    for i, x in rows:
        for tree in (1, 2, 3):
            hits = [p for t, _, conds, p in rules if t == tree and all(
                x is not None and x[f] is not None and of[op](big(x[f]), vals) for f, op, vals in conds)]
            assert got[i, tree][0] == len(hits) and (got[i, tree][1] in hits if hits else got[i, tree][1] is None)


def test_rules_met_of_no_rules_and_no_rows(spark):
    table = spark.createDataFrame([], "tree int, leaf int, conds array<struct<feature:int,op:int,vals:array<double>>>, prediction double")
    rows = spark.createDataFrame([(1, [0.5])], "id long, x array<double>")
    assert rules_met(rows, table).collect() == []
    leaf = spark.createDataFrame([(1, 0, [], 3.0)], table.schema)
    assert rules_met(rows.limit(0), leaf).collect() == []
    assert [tuple(r) for r in rules_met(rows, leaf).select("tree", "n_met", "prediction").collect()] == [(1, 1, 3.0)]


def _gini(counts):
    n = sum(counts.values())
    return 1 - sum(c * c for c in counts.values()) / n / n


def _plain_gains(rows):
    out = {}
    for f in range(len(rows[0]) - 1):
        own = [(r[f], r[-1]) for r in rows if r[f] is not None and r[-1] is not None]
        values = sorted({v for v, _ in own})
        count = lambda part: {y: sum(1 for _, u in part if u == y) for y in {u for _, u in part}}
        for a, b in zip(values, values[1:]):
            left, right = [r for r in own if r[0] <= a], [r for r in own if r[0] > a]
            out[f, (a + b) / 2] = (len(left), len(right), _gini(count(own)) - len(left) / len(own) * _gini(count(left)) - len(right) / len(own) * _gini(count(right)))
    return out


@pytest.mark.parametrize("block", [3, 1_000_000])
def test_split_gains_equal_plain_gini(spark, monkeypatch, block):
    monkeypatch.setattr(splits, "BLOCK_VALUES", block)
    rng = random.Random(6)
    rows = [(float(rng.randint(0, 4)), round(rng.gauss(0, 1), 1), None if rng.random() < 0.1 else float(rng.randint(-2, 2)), 1.0, rng.choice([0.0, 1.0, 2.0]))
            for _ in range(150)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double").repartition(4)
    got = {(r["f"], r["threshold"]): (r["n_left"], r["n_right"], r["gain"]) for r in splits.split_gains(splits.feature_counts(df, ["a", "b", "c", "d"], "y")).collect()}
    want = _plain_gains(rows)
    assert got.keys() == want.keys() and not any(f == 3 for f, _ in got)        # one value: no threshold
    for k, (nl, nr, gain) in want.items():
        assert got[k][:2] == (nl, nr) and abs(got[k][2] - gain) < 1e-9
    best = splits.best_split(df, ["a", "b", "c", "d"], "y").first()
    assert abs(best["gain"] - max(g for *_, g in want.values())) < 1e-9
    assert splits.best_split(df.limit(0), ["a", "b"], "y").collect() == []


def test_gradient_equals_numpy_and_vanishes_at_the_optimum(spark):
    df = _rows(spark, 300)
    model = train("logistic", df, max_iter=300)
    scored = model.transform(df)
    rows = scored.select(vector_values("features").alias("x"), "label", vector_values("probability").alias("p")).collect()
    x, p = np.array([r["x"] for r in rows]), np.array([r["p"] for r in rows])
    want = (p - np.eye(p.shape[1])[[int(r["label"]) for r in rows]]).T @ x / len(rows)
    got = np.zeros_like(want)
    for r in loss_gradient(scored).collect():
        got[r["k"], r["j"]] = r["g"]
    assert np.allclose(got, want) and np.abs(got).max() < 1e-3
    flat = scored.drop("probability", "rawPrediction", "prediction")
    early = train("logistic", flat, max_iter=300).transform(flat.withColumn("label", 3 - F.col("label")))
    assert max(abs(r["g"]) for r in loss_gradient(early).collect()) > 1e-2
