"""Training, evaluation and rule extraction on the appliance feature rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqlab.functions.codes import FEATURE_COLS, NOMINAL_FEATURES
from seqlab.operators.encode import assemble, hash_split, vector_values
from seqlab.operators.labels import index_labels, label_dictionary, label_index
from seqlab.operators.models import (error_rate, forest_tree_predictions, loss_gradient, metrics_row, predict, save_model,
                                     train)
from seqlab.operators.rules import (document_nodes, node_differences, rule_expression, rule_lines, rule_text, rules_met,
                                    score_rules, text_nodes, tree_documents, tree_nodes, tree_rules)
from seqlab.operators.splits import best_split, side_classes
from seqlab.plans.appliance import labelled
from seqlab.session import materialize, scratch_path
from seqlab.sinks.text import append_metrics
from seqlab.sources.logs import read_lines_ordered

# Model settings taken from the reference's runs.
TREE = dict(impurity="gini", max_depth=10, max_bins=32)
FOREST = dict(impurity="gini", max_depth=10, max_bins=32, num_trees=20, feature_subset="auto")


def training_rows(spark, data_dir, label: str = "combined", lab=None):
    """13 coded features (direction/mode declared categorical) and a dense
    label: the combined-label index, or the temperature code. ``lab``: the
    labelled rows, where the caller has them."""
    lab = labelled(spark, data_dir, reused=True) if lab is None else lab
    if label == "combined":
        idx = label_index(lab)
        n_classes = idx.count()  # local table: no job over the data
        lab = index_labels(lab, index=idx).withColumn("y", F.col("label_index").cast("double"))
    else:
        n_classes = 5
        lab = lab.withColumn("y", F.col("temp").cast("double")).withColumn("label_index", F.lit(None).cast("int"))
    rows = assemble(lab, list(FEATURE_COLS), nominal=NOMINAL_FEATURES)
    rows = rows.select("event_id", "features", F.col("y").alias("label"), "label_index")
    # The class count travels as label metadata (Spark ML otherwise caps it).
    return rows.withMetadata("label", {"ml_attr": {"type": "nominal", "name": "label", "num_vals": int(n_classes)}})


def onehot_rows(spark, data_dir):
    """Regression-style rows: seven numeric features and the one-hot vectors
    of the direction and mode lags in one vector; label = temperature code."""
    from seqlab.operators.encode import one_hot
    from seqlab.plans.appliance import q_encode_categories
    coded = q_encode_categories(spark, data_dir)
    nominal = list(NOMINAL_FEATURES)
    enc = one_hot(coded, nominal, drop_last=False)
    numeric = ["temp1", "temp2", "temp3", "speed1", "speed2", "speed3", "weather"]
    rows = assemble(enc, numeric + [f"{c}_vec" for c in nominal])
    rows = rows.select("event_id", "features", F.col("temp").cast("double").alias("label"))
    return rows.withMetadata("label", {"ml_attr": {"type": "nominal", "name": "label", "num_vals": 5}})


def run_algorithm(spark, data_dir, algorithm: str, label: str = "combined", refit_all: bool = True, **params):
    """Hold-out error on a 70/30 hash split; then (reference behaviour) the
    model is refit on all rows and saved, and the report row is appended to
    the metrics table, both below the shared checkpoint folder."""
    rows = materialize(onehot_rows(spark, data_dir) if label == "onehot" else training_rows(spark, data_dir, label))
    flag = hash_split("event_id", 70)
    model = train(algorithm, rows.where(flag), **params)
    both = predict(model, rows.withColumn("is_train", flag)).select("label", "prediction", "is_train")
    stats = error_counts(both)
    n_trees = len(model.trees) if hasattr(model, "trees") else None
    summary = type(model).__name__
    if refit_all:
        final = train(algorithm, rows, **params)
        path = scratch_path(spark, f"models/{algorithm}-{uuid.uuid4().hex[:8]}")
        save_model(final, path)
        text = getattr(final, "toDebugString", None)
        summary = f"{summary} refit on all rows: {path}" + (f"\n{text}" if isinstance(text, str) else "")
    report = metrics_row(spark, algorithm=algorithm, dataset=f"events:{label}", n_classes=stats["k"],
                         test_error=stats["e"], n_train=stats["n_train"], n_test=stats["n_test"], n_trees=n_trees,
                         model_summary=summary)
    append_metrics(report, scratch_path(spark, "metrics"))
    return checked(report, stats)


def error_counts(scored):
    """One row from (label, prediction, is_train): classes, rows and wrong predictions of both
    sides, the hold-out error and ``missed``, the training rows outside their most frequent class.
    Counts of (class, side) are one aggregation; the rest works on that small table."""
    per = scored.groupBy("label").agg(
        F.count(F.when(F.col("is_train"), 1)).alias("tr"), F.count(F.when(~F.col("is_train"), 1)).alias("te"),
        F.count(F.when(F.col("is_train") & (F.col("label") != F.col("prediction")), 1)).alias("tr_wrong"),
        F.count(F.when(~F.col("is_train") & (F.col("label") != F.col("prediction")), 1)).alias("te_wrong"))
    return per.agg(F.count(F.lit(1)).alias("k"), F.sum("tr").alias("n_train"), F.sum("te").alias("n_test"),
                   F.sum("tr_wrong").alias("train_wrong"), F.try_divide(F.sum("te_wrong"), F.sum("te")).alias("e"),
                   (F.sum("tr") - F.max("tr")).alias("missed")).first()


def checked(report, stats):
    """What SQL can state of a model: sizes of the split, classes, trees, the training rows that
    always naming the most frequent class misses, and that the model misses fewer of them.
    (The lags of these tables do not tell the next setting, so on held-out rows no model can be
    expected to beat that.) The hold-out error is in the metrics table."""
    return report.select("algorithm", "dataset", "n_classes", "n_trees", "n_train", "n_test",
                         F.lit(stats["missed"]).cast("long").alias("majority_misses"),
                         F.lit(stats["train_wrong"] < stats["missed"]).alias("misses_fewer"))


def q_train_tree(spark, data_dir):
    return run_algorithm(spark, data_dir, "tree", **TREE)


def q_train_forest(spark, data_dir):
    return run_algorithm(spark, data_dir, "forest", **FOREST)


def q_train_logistic(spark, data_dir):
    return run_algorithm(spark, data_dir, "logistic")


def q_train_logistic_onehot(spark, data_dir):
    """Multinomial logistic regression on the one-hot rows (temperature)."""
    return run_algorithm(spark, data_dir, "logistic", label="onehot")


def q_train_forest_libsvm(spark, data_dir):
    """The reference's fixed forest run: coded rows written as LibSVM
    (combined label, 13 features), read back, split by the hash of the line
    (11 of 16 parts train; equal lines fall on one side, on any partitioning),
    5 trees, depth 10, 32 bins, no categorical features, class count from
    the label space (450)."""
    from seqlab.operators.labels import LABEL_RADICES
    from seqlab.sinks.text import write_libsvm
    from seqlab.sources.logs import read_libsvm
    lab = labelled(spark, data_dir)
    path = scratch_path(spark, f"libsvm-{uuid.uuid4().hex[:8]}")
    write_libsvm(assemble(lab, list(FEATURE_COLS)).withColumn("label", F.col("label").cast("double")), path)
    n_classes = 1
    for r in LABEL_RADICES:
        n_classes *= r
    data = read_libsvm(spark, path, len(FEATURE_COLS)).withMetadata(
        "label", {"ml_attr": {"type": "nominal", "name": "label", "num_vals": n_classes}})
    line = F.concat(F.col("label").cast("int").cast("string"), F.array_join(F.transform(
        vector_values("features"), lambda v, i: F.concat(F.lit(" "), (i + 1).cast("string"), F.lit(":"), v.cast("int").cast("string"))), ""))
    flag = F.substring(F.md5(line.cast("binary")), 1, 1) < "b"
    model = train("forest", data.where(flag), impurity="gini", max_depth=10, max_bins=32, num_trees=5)
    stats = error_counts(predict(model, data.withColumn("is_train", flag)).select("label", "prediction", "is_train"))
    report = metrics_row(spark, algorithm="forest", dataset="libsvm", n_classes=n_classes,
                         test_error=stats["e"], n_train=stats["n_train"], n_test=stats["n_test"], n_trees=len(model.trees),
                         model_summary=f"{type(model).__name__} of {path}")
    append_metrics(report, scratch_path(spark, "metrics"))
    return checked(report, stats)


def q_train_gbt(spark, data_dir):
    """Boosted trees (20 rounds) one-vs-rest on the temperature code."""
    return run_algorithm(spark, data_dir, "gbt", label="temp", max_iter=20)


def fitted_rules(spark, data_dir, algorithm: str, rows=None, **params):
    """Fit on all rows, save, read the node table back, build rules: (rows, model, nodes, rules).
    ``rows``: the training rows, where the caller has them."""
    rows = materialize(training_rows(spark, data_dir)) if rows is None else rows
    model = train(algorithm, rows, **params)
    path = scratch_path(spark, f"models/{algorithm}-{uuid.uuid4().hex[:8]}")
    save_model(model, path)
    nodes = materialize(tree_nodes(spark, path))
    return rows, model, nodes, materialize(tree_rules(spark, nodes))


# Coded features of few values, all taken as numbers: the first split of a tree over
# them is the best threshold by gini, which SQL can find too.
STUMP_FEATURES = FEATURE_COLS[:12]
STUMP = dict(impurity="gini", max_depth=1, max_bins=32)


def stump(spark, data_dir, label: str):
    """(rows with ``y`` and the features, tree of depth 1 over them, its rules)."""
    lab = labelled(spark, data_dir, reused=True)
    if label == "combined":
        idx = label_index(lab)
        n, lab = idx.count(), index_labels(lab, index=idx).withColumn("y", F.col("label_index").cast("double"))
    else:
        n, lab = 5, lab.withColumn("y", F.col("temp").cast("double"))
    rows = assemble(lab.drop("label"), list(STUMP_FEATURES)).withColumn("label", F.col("y"))
    rows = materialize(rows.withMetadata("label", {"ml_attr": {"type": "nominal", "name": "label", "num_vals": int(n)}}))
    return rows, lab


def _fit_stump(spark, rows):
    model = train("tree", rows, **STUMP)
    path = scratch_path(spark, f"models/stump-{uuid.uuid4().hex[:8]}")
    save_model(model, path)
    return model, materialize(tree_rules(spark, tree_nodes(spark, path)))


def q_tree_first_split(spark, data_dir):
    """The best first split of the temperature rows from grouped counts, its gain, the classes of
    both sides and the errors of the hold-out; ``same_as_tree``: a trained tree of depth 1 has
    this threshold and misses the same number of held-out rows."""
    rows, _ = stump(spark, data_dir, "temp")
    flag = hash_split("event_id", 70)
    tr = rows.where(flag)
    split = best_split(tr, STUMP_FEATURES, "y").first()
    x = F.element_at(F.array(*[F.col(c).cast("double") for c in STUMP_FEATURES]), split["f"] + 1)
    side = x <= F.lit(split["threshold"])
    cls = {r["left"]: r["cls"] for r in side_classes(tr, side, "y").collect()}
    guess = F.when(side, F.lit(cls[True])).otherwise(F.lit(cls[False]))
    model, rules = _fit_stump(spark, tr)
    found = rules.select("conds").first()["conds"]
    scored = predict(model, rows).where(~flag).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(guess != F.col("y"), 1)).alias("wrong"),
        F.count(F.when(F.col("prediction") != F.col("y"), 1)).alias("tree_wrong")).first()
    same = (len(found) == 1 and found[0]["feature"] == split["f"] and list(found[0]["vals"]) == [split["threshold"]]
            and scored["wrong"] == scored["tree_wrong"])
    return spark.createDataFrame(
        [(STUMP_FEATURES[split["f"]], split["threshold"], round(split["gain"], 9), split["n_left"], split["n_right"], int(cls[True]),
          int(cls[False]), scored["n"], scored["wrong"], same)],
        "feature string, threshold double, gain double, n_left long, n_right long, left_class int, right_class int, "
        "n_test long, n_wrong long, same_as_tree boolean")


def _decoded(rules, lab):
    dic = label_dictionary(label_index(lab))
    return rules.join(F.broadcast(dic), F.col("prediction") == F.col("label_index").cast("double"), "left")


def _covered(rows, rules, features):
    """Rows that meet each rule, as a table (tree, leaf, n_rows): the tree's expression with leaves for predictions."""
    found = rules.select("tree", "leaf", "conds").collect()
    leaf = F.expr(rule_expression([{"conds": r["conds"], "prediction": r["leaf"]} for r in found], "x")).cast("int")
    return rows.withColumn("x", features).groupBy(F.lit(1).alias("tree"), leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_tree_rules(spark, data_dir):
    """Rules of a tree of depth 1 with the label decoded as ``temp,mode,direction,speed`` and the
    rows that meet each (deeper trees: ``rules_partition``)."""
    rows, lab = stump(spark, data_dir, "combined")
    _, rules = _fit_stump(spark, rows)
    out = rule_lines(_decoded(rules, lab), F.col("label_text")).select("tree", "leaf", "line")
    return out.join(_covered(rows, rules, vector_values("features")), ["tree", "leaf"], "left")


def q_tree_rules_text(spark, data_dir):
    """Both text forms of the rules of a tree of depth 1 over the temperature rows, with the rows that meet each."""
    rows, _ = stump(spark, data_dir, "temp")
    _, rules = _fit_stump(spark, rows)
    out = rule_text(rule_lines(rules)).select("tree", "leaf", "line", "text")
    return out.join(_covered(rows, rules, vector_values("features")), ["tree", "leaf"], "left")


_DEEP = (("tree", TREE), ("forest", {**FOREST, "num_trees": 5}))


def q_rules_partition(spark, data_dir):
    """Rules of a tree of depth 10 (labels decoded) and of a 5-tree forest against all rows, by tree:
    rows, rows that meet exactly one rule, rows whose rule says what the tree itself says, and
    rules whose line has no decoded label."""
    out = None
    lab = labelled(spark, data_dir, reused=True)
    training = materialize(training_rows(spark, data_dir, lab=lab))
    for name, params in _DEEP:
        rows, model, _, rules = fitted_rules(spark, data_dir, name, rows=training, **params)
        blank = (rule_lines(_decoded(rules, lab), F.coalesce("label_text", F.lit(""))).groupBy("tree")
                 .agg(F.count(F.when(F.col("line").rlike(r"#$"), 1)).alias("n_without_label")))
        if name == "forest":
            rows, cols = forest_tree_predictions(model, rows)
        else:
            rows, cols = predict(model, rows).withColumnRenamed("prediction", "__tree0"), ["__tree0"]
        rows = rows.select("event_id", vector_values("features").alias("x"), F.array(*cols).alias("own"))
        met = rules_met(rows, rules).groupBy("tree").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("n_met") == 1, 1)).alias("n_one_rule"),
            F.count(F.when(F.col("prediction") == F.element_at("own", F.col("tree")), 1)).alias("n_like_tree"))
        part = met.join(blank, "tree").select(F.lit(name).alias("algorithm"), "tree", "n_rows", "n_one_rule", "n_like_tree", "n_without_label")
        out = part if out is None else out.union(part)
    return out


def q_model_text_nodes(spark, data_dir):
    """Node tables read from the printed models (a tree, a 5-tree forest) against the saved node
    tables: nodes that differ, and differences of the rules built from either."""
    out = None
    for name, params in _DEEP:
        _, model, nodes, rules = fitted_rules(spark, data_dir, name, **params)
        path = scratch_path(spark, f"model-text/{name}-{uuid.uuid4().hex[:8]}")
        spark.createDataFrame([(model.toDebugString,)], "value string").coalesce(1).write.text(path)   # a model's text
        parsed = materialize(text_nodes(read_lines_ordered(spark, path)))
        again = tree_rules(spark, parsed)
        line = [F.col("tree"), F.col("leaf"), F.col("line")]
        lost = (rule_lines(_sorted_values(rules)).select(*line).exceptAll(rule_lines(_sorted_values(again)).select(*line))
                .groupBy("tree").agg(F.count(F.lit(1)).alias("rule_differences")))
        part = (node_differences(parsed, nodes).join(lost, "tree", "left")
                .select(F.lit(name).alias("algorithm"), "tree", F.col("differences").alias("node_differences"),
                        F.coalesce("rule_differences", F.lit(0)).cast("long").alias("rule_differences")))
        out = part if out is None else out.union(part)
    return out


def _sorted_values(rules):
    return rules.withColumn("conds", F.transform("conds", lambda c: F.struct(
        c["feature"].alias("feature"), c["op"].alias("op"), F.array_sort(c["vals"]).alias("vals"))))


def q_tree_documents(spark, data_dir):
    """One nested JSON document a tree, read back: documents, and nodes that differ from the saved ones."""
    out = None
    for name, params in _DEEP:
        _, _, nodes, _ = fitted_rules(spark, data_dir, name, **params)
        docs = materialize(tree_documents(nodes))
        part = node_differences(document_nodes(docs), nodes).join(
            docs.groupBy("tree").agg(F.count(F.lit(1)).alias("n_documents")), "tree")
        part = part.select(F.lit(name).alias("algorithm"), "tree", "n_documents", F.col("differences").alias("node_differences"))
        out = part if out is None else out.union(part)
    return out


def q_logistic_optimum(spark, data_dir):
    """Multinomial regression of the temperature code on scaled features: whether the gradient of
    its mean log-loss is small at the fitted weights, and misses against the most frequent class."""
    rows = materialize(training_rows(spark, data_dir, "temp"))
    model = train("logistic", rows, max_iter=500)
    scored = materialize(predict(model, rows).select("label", "prediction", "features", "probability"))
    worst = loss_gradient(scored).agg(F.max(F.abs("g") / F.col("scale")).alias("g")).first()["g"]
    stats = error_counts(scored.withColumn("is_train", F.lit(True)))
    return spark.createDataFrame([(stats["n_train"], stats["missed"], worst < 1e-3, stats["train_wrong"] < stats["missed"])],
                                 "n_rows long, majority_misses long, gradient_is_small boolean, misses_fewer boolean")


def q_score_rules(spark, data_dir):
    """Every row scored by the rules of a 5-tree forest (majority of tree
    votes) beside the forest's own majority prediction (they must agree)."""
    rows, model, _, rules = fitted_rules(spark, data_dir, "forest", **{**FOREST, "num_trees": 5})
    scored = score_rules(rows.withColumn("x", vector_values("features")), rules, "x")
    scored = predict(model, scored.withColumnRenamed("prediction", "rule_prediction"))
    return scored.select("event_id", "label", "n_trees", (F.col("rule_prediction") == F.col("prediction")).alias("agrees"))


QUERIES = {
    "train_tree": q_train_tree,
    "train_forest": q_train_forest,
    "train_logistic": q_train_logistic,
    "train_logistic_onehot": q_train_logistic_onehot,
    "train_forest_libsvm": q_train_forest_libsvm,
    "train_gbt": q_train_gbt,
    "tree_rules": q_tree_rules,
    "tree_rules_text": q_tree_rules_text,
    "score_rules": q_score_rules,
    "tree_first_split": q_tree_first_split,
    "rules_partition": q_rules_partition,
    "model_text_nodes": q_model_text_nodes,
    "tree_documents": q_tree_documents,
    "logistic_optimum": q_logistic_optimum,
}
