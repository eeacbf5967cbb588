"""Rule tables from saved trees, rule scoring, training dispatch."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from seqlab.operators.encode import assemble, vector_values
from seqlab.operators.models import load_model, make_estimator, predict, save_model, train
from seqlab.operators.rules import rule_lines, rule_text, score_rules, tree_nodes, tree_rules


def test_golden_rules(spark):
    nodes = spark.createDataFrame(
        [(1, 0, None, 1, 2, 0, [0.5], -1), (1, 1, 0.0, -1, -1, None, None, None),
         (1, 2, None, 3, 4, 6, [1.0, 2.0], 3), (1, 3, 1.0, -1, -1, None, None, None),
         (1, 4, 2.0, -1, -1, None, None, None)],
        "tree int, id int, prediction double, left int, right int, feature int, values array<double>, "
        "num_categories int")
    rules = rule_lines(tree_rules(spark, nodes))
    assert sorted(r.line for r in rules.collect()) == sorted(
        ["0|1|0.5:#0", "0|2|0.5:6|4|{1,2}:#1", "0|2|0.5:6|5|{1,2}:#2"])
    text = sorted(r.text for r in rule_text(rules).collect())
    assert text[0] == "feature 0 <= 0.5 -> Predict: 0"
    from seqlab.operators.rules import nodes_json
    import json
    docs = {r.id: json.loads(r.json) for r in nodes_json(nodes).collect()}
    assert docs[2]["values"] == [1.0, 2.0] and docs[1]["prediction"] == 0.0


def _data(spark, n=600):
    df = spark.range(n).select(
        F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).alias("cat"),
        ((F.col("id") * 13) % 11).cast("double").alias("b"))
    df = df.withColumn("label", ((F.col("a") + F.col("cat") * 2 + F.col("b")) % 4).cast("double"))
    return assemble(df, ["a", "cat", "b"], nominal={"cat": 3})


def test_rules_score_like_the_trees(spark, tmp_dir):
    df = _data(spark)
    model = train("forest", df, num_trees=3, max_depth=4, max_bins=16)
    save_model(model, f"{tmp_dir}/forest")
    rules = tree_rules(spark, tree_nodes(spark, f"{tmp_dir}/forest"))
    ops = {c["op"] for r in rules.collect() for c in r.conds}
    assert 4 in ops or 5 in ops, "the nominal feature must give category splits"
    scored = score_rules(df.withColumn("x", vector_values("features")), rules, "x")
    assert scored.where(F.col("n_trees") != 3).count() == 0
    majority = predict(model, df, forest_vote="majority").select("id", F.col("prediction").alias("m"))
    cmp = scored.join(majority, "id")
    assert cmp.where(F.col("prediction") != F.col("m")).count() == 0
    loaded = load_model("forest", f"{tmp_dir}/forest")
    p1 = predict(loaded, df, forest_vote="probability").select("id", F.col("prediction").alias("p"))
    p2 = model.transform(df).select("id", "prediction")
    assert p1.join(p2, "id").where(F.col("p") != F.col("prediction")).count() == 0


def test_single_tree_rules_match_tree(spark, tmp_dir):
    df = _data(spark)
    model = train("tree", df, max_depth=5, max_bins=16)
    save_model(model, f"{tmp_dir}/tree")
    rules = tree_rules(spark, tree_nodes(spark, f"{tmp_dir}/tree"))
    scored = score_rules(df.withColumn("x", vector_values("features")), rules, "x")
    own = model.transform(df).select("id", F.col("prediction").alias("t"))
    assert scored.join(own, "id").where(F.col("prediction") != F.col("t")).count() == 0


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError):
        make_estimator("svm")


@pytest.mark.parametrize("algorithm", ["tree", "logistic", "gbt"])
def test_algorithms_train(spark, algorithm):
    df = _data(spark, 200).withColumn("label", (F.col("label") % 2).cast("double"))
    model = train(algorithm, df, max_iter=5, max_depth=3, max_bins=16)
    assert predict(model, df).where(F.col("prediction").isNull()).count() == 0


def test_libsvm_round_trip(spark, tmp_dir):
    from seqlab.sinks.text import write_libsvm
    from seqlab.sources.logs import read_libsvm
    df = spark.createDataFrame([(1.0, Vectors.dense([1.0, 0.0, 3.0])), (0.0, Vectors.dense([0.0, 2.0, 0.0]))],
                               ["label", "features"])
    write_libsvm(df, f"{tmp_dir}/svm")
    back = read_libsvm(spark, f"{tmp_dir}/svm", 3)
    assert sorted((r.label, tuple(r.features.toArray())) for r in back.collect()) == \
        [(0.0, (0.0, 2.0, 0.0)), (1.0, (1.0, 0.0, 3.0))]


def test_each_row_meets_one_rule_per_tree(spark, tmp_dir):
    df = _data(spark, 300)
    model = train("forest", df, num_trees=3, max_depth=4, max_bins=16)
    save_model(model, f"{tmp_dir}/f")
    rules = tree_rules(spark, tree_nodes(spark, f"{tmp_dir}/f")).collect()
    ops = {0: lambda v, t: v >= t[0], 1: lambda v, t: v <= t[0], 2: lambda v, t: v > t[0], 3: lambda v, t: v < t[0],
           4: lambda v, t: v in t, 5: lambda v, t: v not in t}
    for row in df.select(vector_values("features").alias("x")).limit(50).collect():
        hits = {}
        for r in rules:
            if all(ops[c.op](row.x[c.feature], list(c.vals)) for c in r.conds):
                hits[r.tree] = hits.get(r.tree, 0) + 1
        assert hits == {1: 1, 2: 1, 3: 1}


def test_one_hot_rows_have_one_one_per_column(spark):
    import __spark_entry__ as e
    rows = e.queries()["one_hot_dataset"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(sum(r["values"][:-4]) == 13 for r in rows)
