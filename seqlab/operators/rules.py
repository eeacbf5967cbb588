"""Tree models as node tables, rule tables, nested documents and expressions.

A saved tree (``<model>/data`` Parquet) is a node table: ``id, prediction,
leftChild, rightChild, split{featureIndex, leftCategoriesOrThreshold,
numCategories}`` (a forest adds ``treeID`` around ``nodeData``). The printed
form of a model gives the same table (``text_nodes``). A rule is the list of
conditions on the path from the root to one leaf, built with a recursive CTE
over the node table; rules become one SQL expression a tree (``rule_expression``).

Condition codes (fixed values of the rule text format): ``>=`` 0, ``<=`` 1,
``>`` 2, ``<`` 3, ``in`` 4, ``not in`` 5. Continuous splits send
``feature <= threshold`` left; categorical splits send ``feature in {left
categories}`` left.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlab.operators.models import majority_vote
from seqlab.session import materialize

# Operator codes and texts of the rule format.
OP_CODES = {">=": 0, "<=": 1, ">": 2, "<": 3, "in": 4, "not in": 5}
OP_TEXT = {v: k for k, v in OP_CODES.items()}


def tree_nodes(spark: SparkSession, model_path: str) -> DataFrame:
    """Node table of a saved tree or forest: ``tree`` (1-based), ``id``,
    ``prediction``, ``left``, ``right``, ``feature``, ``values``,
    ``num_categories`` (-1 = continuous)."""
    raw = spark.read.parquet(f"{model_path.rstrip('/')}/data")
    if "treeID" in raw.columns:
        raw = raw.select((F.col("treeID") + 1).alias("tree"), "nodeData.*")
    else:
        raw = raw.select(F.lit(1).alias("tree"), "*")
    return raw.select(
        F.col("tree").cast("int").alias("tree"), F.col("id").cast("int").alias("id"),
        F.col("prediction").cast("double").alias("prediction"),
        F.col("leftChild").cast("int").alias("left"), F.col("rightChild").cast("int").alias("right"),
        F.col("split.featureIndex").cast("int").alias("feature"),
        F.col("split.leftCategoriesOrThreshold").alias("values"),
        F.col("split.numCategories").cast("int").alias("num_categories"))


NODE_LINE = r"^(If|Else|Predict)\b"


def text_nodes(lines: DataFrame) -> DataFrame:
    """Node table (as ``tree_nodes``, without internal predictions) of printed models.

    ``lines`` has ``file_path, block, pos, line`` (``read_lines_ordered``), a model a file.
    A line ``If (...)`` is a node, the line after it its left child, the line after
    the matching ``Else`` (the last earlier ``If`` of the same indent is its node) its
    right one; ``Predict`` lines are leaves. Lines stand in the order of the node ids.
    ``num_categories`` is 0 for a categorical split, since the text does not name it.
    All steps are windows and joins over the lines of a tree; forests part by tree.
    """
    in_file = Window.partitionBy("file_path").orderBy("block", "pos")
    body = F.ltrim("line")
    all_lines = lines.select("file_path", "block", "pos", body.alias("body"), (F.length("line") - F.length(body)).alias("indent"),
                             F.greatest(F.lit(1), F.sum(body.rlike(r"^Tree \d+").cast("int")).over(in_file)).cast("int").alias("tree"))
    in_tree = Window.partitionBy("file_path", "tree").orderBy("block", "pos")
    rows = (all_lines.where(body_kind(F.col("body")) != "").withColumn("kind", body_kind(F.col("body")))
            .withColumn("n", F.row_number().over(in_tree)))
    same_indent = Window.partitionBy("file_path", "tree", "indent").orderBy("n")
    owner = F.when(F.col("kind") != "Predict", F.last(F.when(F.col("kind") == "If", F.col("n")), ignorenulls=True).over(same_indent))
    by_n = Window.partitionBy("file_path", "tree").orderBy("n")
    rows = (rows.withColumn("owner", owner)
            .select("*", F.lag("owner").over(by_n).alias("parent"), F.lag("kind").over(by_n).alias("side"))
            .where("kind <> 'Else'").withColumn("id", F.row_number().over(by_n) - 1))
    children = (rows.where("parent IS NOT NULL").groupBy("file_path", "tree", F.col("parent").alias("n"))
                .agg(F.max(F.when(F.col("side") == "If", F.col("id"))).alias("left"),
                     F.max(F.when(F.col("side") == "Else", F.col("id"))).alias("right")))
    cond = F.regexp_extract("body", r"feature (\d+) (<=|in) \{?([^{}]*?)\}?\)$", 2)
    part = lambda i: F.regexp_extract("body", r"feature (\d+) (<=|in) \{?([^{}]*?)\}?\)$", i)
    inner = F.col("kind") == "If"
    return rows.join(children, ["file_path", "tree", "n"], "left").select(
        "file_path", "tree", F.col("id").cast("int").alias("id"),
        F.when(~inner, F.regexp_extract("body", r"Predict: (.*)$", 1).cast("double")).alias("prediction"),
        F.coalesce("left", F.lit(-1)).cast("int").alias("left"), F.coalesce("right", F.lit(-1)).cast("int").alias("right"),
        F.when(inner, part(1).cast("int")).otherwise(-1).alias("feature"),
        F.when(inner, F.filter(F.split(part(3), ","), lambda v: v != "").cast("array<double>")).otherwise(F.array().cast("array<double>")).alias("values"),
        F.when(inner & (cond == "in"), 0).otherwise(-1).alias("num_categories"))


def body_kind(body: Column) -> Column:
    """``If``, ``Else`` or ``Predict`` of a node line, else empty."""
    return F.regexp_extract(body, NODE_LINE, 1)


def node_differences(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("tree",)) -> DataFrame:
    """Per tree the number of nodes that one table lacks or that differ: children, feature,
    kind of split, threshold or categories (in any order), prediction of leaves."""
    def told(df):
        leaf = F.col("left") < 0
        return df.select(*keys, "id", F.struct(
            "left", "right", F.when(~leaf, F.col("feature")).alias("feature"),
            F.when(~leaf, F.col("num_categories") >= 0).alias("categorical"),
            F.when(~leaf, F.array_sort("values")).alias("values"), F.when(leaf, F.col("prediction")).alias("prediction")).alias("node"))
    on = [*keys, "id"]
    both = told(a).join(told(b).withColumnRenamed("node", "other"), on, "full_outer")
    return both.groupBy(*keys).agg(F.sum((~F.col("node").eqNullSafe(F.col("other"))).cast("long")).alias("differences"))


_COND = "struct<feature:int,op:int,vals:array<double>>"


def tree_rules(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """One row per leaf: ``tree, leaf, conds array<struct<feature, op,
    vals>>, prediction`` (the root-to-leaf path, in order)."""
    tag = uuid.uuid4().hex[:8]
    split = F.col("num_categories") >= 0

    def edge(child, op_cat, op_num):
        cond = F.struct(F.col("feature").alias("feature"),
                        F.when(split, F.lit(OP_CODES[op_cat])).otherwise(F.lit(OP_CODES[op_num])).alias("op"),
                        F.col("values").alias("vals"))
        return F.struct(F.col(child).alias("child"), cond.alias("cond"))

    edges = (nodes.where(F.col("left") >= 0)
             .select("tree", F.col("id").alias("parent"),
                     F.explode(F.array(edge("left", "in", "<="), edge("right", "not in", ">"))).alias("e"))
             .select("tree", "parent", "e.child", "e.cond"))
    edges.createOrReplaceTempView(f"rule_edges_{tag}")
    nodes.createOrReplaceTempView(f"rule_nodes_{tag}")
    paths = spark.sql(f"""
        WITH RECURSIVE paths(tree, id, conds) AS (
          SELECT tree, id, CAST(array() AS array<{_COND}>) FROM rule_nodes_{tag} WHERE id = 0
          UNION ALL
          SELECT e.tree, e.child, concat(p.conds, array(e.cond))
          FROM paths p JOIN rule_edges_{tag} e ON p.tree = e.tree AND p.id = e.parent)
        SELECT p.tree, p.id AS leaf, p.conds, n.prediction
        FROM paths p JOIN rule_nodes_{tag} n ON p.tree = n.tree AND p.id = n.id
        WHERE n.left < 0""")
    return paths


def _num_text(v: Column) -> Column:
    """Integral values without ``.0``; others as Spark prints doubles."""
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def cond_text(c: Column) -> Column:
    vals = F.when(c["op"] >= 4, F.concat(F.lit("{"), F.array_join(F.transform(c["vals"], _num_text), ","), F.lit("}"))
                  ).otherwise(_num_text(F.element_at(c["vals"], 1)))
    return F.concat_ws("|", c["feature"].cast("string"), c["op"].cast("string"), vals)


def rule_lines(rules: DataFrame, label: Column | None = None) -> DataFrame:
    """``cond:cond:...:#label`` per rule; ``label`` defaults to the leaf
    prediction (use a decoded label column to write readable classes)."""
    lab = label if label is not None else _num_text(F.col("prediction"))
    line = F.concat(F.array_join(F.transform("conds", cond_text), ":"), F.lit(":#"), lab)
    return rules.select("*", line.alias("line"))


def rule_text(rules: DataFrame) -> DataFrame:
    """Readable form: ``feature 0 <= 0.5 -> feature 6 in {1,2} -> Predict: 1``."""
    op = F.create_map(*[x for k, v in OP_CODES.items() for x in (F.lit(v), F.lit(k))])

    def one(c):
        vals = F.when(c["op"] >= 4, F.concat(F.lit("{"), F.array_join(F.transform(c["vals"], _num_text), ","),
                                            F.lit("}"))).otherwise(_num_text(F.element_at(c["vals"], 1)))
        return F.concat_ws(" ", F.lit("feature"), c["feature"].cast("string"), F.element_at(op, c["op"]), vals)

    parts = F.concat(F.transform("conds", one), F.array(F.concat(F.lit("Predict: "), _num_text(F.col("prediction")))))
    return rules.select("*", F.array_join(parts, " -> ").alias("text"))


# A condition and its complement; the expression tests the first one.
_COMPLEMENT = {">": "<=", "not in": "in", ">=": "<"}


def _condition_sql(features: str, cond) -> tuple[str, bool]:
    """SQL of a condition (or of its complement) and whether it is the condition itself."""
    op = OP_TEXT[cond["op"]]
    base = _COMPLEMENT.get(op, op)
    x = f"{features}[{int(cond['feature'])}]"
    vals = [f"{float(v)!r}D" for v in cond["vals"]]
    if base == "in":
        sql = f"{x} IN ({', '.join(vals)})" if vals else "false"
    else:
        sql = f"{x} {base} {vals[0]}"
    return sql, base == op


def rule_expression(rules: list, features: str = "x", depth: int = 0) -> str:
    """SQL expression (nested CASE) of one tree's rules over the array column ``features``.

    At every level the rules that share the first one's condition form one branch, the rest
    its complement. A missing or NaN value takes the branch of the unmet condition."""
    if len(rules) == 1 and len(rules[0]["conds"]) <= depth:
        return f"{float(rules[0]['prediction'])!r}D"
    pivot = rules[0]["conds"][depth]
    told = (pivot["op"], pivot["feature"], tuple(pivot["vals"]))
    same = [r for r in rules if (r["conds"][depth]["op"], r["conds"][depth]["feature"], tuple(r["conds"][depth]["vals"])) == told]
    other = [r for r in rules if not any(r is s for s in same)] if len(same) < len(rules) else []
    if not other:  # a condition every rule here shares
        return rule_expression(same, features, depth + 1)
    sql, direct = _condition_sql(features, pivot)
    yes, no = (same, other) if direct else (other, same)
    return (f"CASE WHEN {sql} THEN {rule_expression(yes, features, depth + 1)} "
            f"ELSE {rule_expression(no, features, depth + 1)} END")


def tree_expressions(rules: DataFrame, features: str = "x") -> list[str]:
    """One SQL expression a tree, in the order of the trees. Rules are a model: as many as
    the trees have leaves, whatever the number of rows they score."""
    by_tree: dict[int, list] = {}
    for r in rules.select("tree", "conds", "prediction").toLocalIterator():
        by_tree.setdefault(r["tree"], []).append(r)
    return [rule_expression(rs, features) for _, rs in sorted(by_tree.items())]


def score_rules(df: DataFrame, rules: DataFrame, features: str = "x") -> DataFrame:
    """Prediction of every row by a rule table: per tree the rule whose
    conditions hold, then the majority of the trees (ties to the smaller
    class). ``features`` is an ``array<double>`` column.

    Every tree is one SQL expression, so rows are scored in the JVM where they
    are: no join, no shuffle, no Python worker.
    """
    trees = tree_expressions(rules, features)
    names = [f"__tree{i}" for i in range(len(trees))]
    voted = df.select("*", *[F.expr(t).alias(n) for t, n in zip(trees, names)])
    return voted.select(*[F.col(f"`{c}`") for c in df.columns], F.lit(len(trees)).alias("n_trees"),
                        majority_vote([F.col(n) for n in names]).alias("prediction"))


def rules_met(df: DataFrame, rules: DataFrame, features: str = "x") -> DataFrame:
    """Every row with every tree: ``tree, n_met`` (rules whose conditions all hold) and the
    prediction of the first one. ``features`` is an ``array<double>`` column.

    Every rule is tried on every row, by itself: a condition is tested once a batch of rows
    and kept as bits, a rule is the AND of its conditions' bits. The rules (a model: as many
    as the trees have leaves) travel with the function, no row carries them. As in SQL a NULL
    meets no condition, and NaN equals itself and is above all numbers.
    """
    by_tree: dict[int, list] = {}
    places: dict[tuple, int] = {}
    for r in rules.select("tree", "conds", "prediction").toLocalIterator():
        own = [places.setdefault((c["feature"], OP_TEXT[c["op"]], tuple(c["vals"])), len(places)) for c in r["conds"]]
        by_tree.setdefault(r["tree"], []).append((np.array(own, np.int64), r["prediction"]))
    trees, conds = sorted(by_tree.items()), list(places)
    width = 1 + max((f for f, _, _ in conds), default=-1)

    def holds(x, known, op, vals):
        nan = np.isnan(x)
        if op in ("in", "not in"):
            met = np.isin(x, vals) | (nan & any(v != v for v in vals))
            return known & (met if op == "in" else ~met)
        t = vals[0]
        above, below = (x > t) | (nan & (t == t)), (x < t) | (~nan & (t != t))
        return known & {">=": ~below, "<=": ~above, ">": above, "<": below}[op]

    def run(x: pa.Array) -> pa.Array:
        n = len(x)
        sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        there = pc.is_valid(x).to_numpy(zero_copy_only=False)
        if (sizes[there] < width).any():
            raise ValueError(f"a row has fewer than {width} features")
        flat = x.flatten()
        start = np.cumsum(sizes) - sizes
        value, known = np.full((width, n), np.nan), np.zeros((width, n), bool)
        at = start[there] + np.arange(width)[:, None]
        value[:, there] = flat.to_numpy(zero_copy_only=False)[at]
        known[:, there] = pc.is_valid(flat).to_numpy(zero_copy_only=False)[at]
        bits = np.zeros((len(conds), -(-n // 8)), np.uint8)
        for i, (f, op, vals) in enumerate(conds):
            bits[i] = np.packbits(holds(value[f], known[f], op, vals))
        n_met, said = np.zeros((n, len(trees)), np.int32), np.zeros((n, len(trees)))
        for k, (_, own) in enumerate(trees):
            for of, prediction in own:
                hit = np.flatnonzero(np.unpackbits(np.bitwise_and.reduce(bits[of], axis=0), count=n)) if len(of) else np.arange(n)
                said[hit[n_met[hit, k] == 0], k] = prediction
                n_met[hit, k] += 1
        n_met, said = n_met.reshape(-1), said.reshape(-1)
        each = pa.StructArray.from_arrays(
            [pa.array(np.tile(np.array([t for t, _ in trees], np.int32), n)), pa.array(n_met), pa.array(said, mask=n_met == 0)],
            ["tree", "n_met", "prediction"])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(trees)), each)

    met = F.arrow_udf(run, "array<struct<tree:int,n_met:int,prediction:double>>")
    rows = df.withColumn("__met", met(F.col(features))).select("*", F.explode("__met").alias("__t"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], "__t.tree", "__t.n_met", "__t.prediction")


# ---------------------------------------------------------------- nested documents

def node_condition(left: bool) -> Column:
    """Text of the branch of a node: ``feature 0 <= 0.5``, ``feature 6 not in {1.0,2.0}``."""
    categories = F.concat(F.lit("{"), F.array_join(F.col("values").cast("array<string>"), ","), F.lit("}"))
    split = F.when(F.col("num_categories") >= 0, F.concat(F.lit("in " if left else "not in "), categories)).otherwise(
        F.concat(F.lit("<= " if left else "> "), F.element_at("values", 1).cast("string")))
    return F.concat(F.lit("feature "), F.col("feature").cast("string"), F.lit(" "), split)


def _with_depth(nodes: DataFrame) -> DataFrame:
    tag = uuid.uuid4().hex[:8]
    nodes.createOrReplaceTempView(f"depth_nodes_{tag}")
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE at(tree, id, depth) AS (
          SELECT tree, id, 0 FROM depth_nodes_{tag} WHERE id = 0
          UNION ALL
          SELECT n.tree, c.id, a.depth + 1 FROM at a
          JOIN depth_nodes_{tag} n ON n.tree = a.tree AND n.id = a.id AND n.left >= 0
          JOIN depth_nodes_{tag} c ON c.tree = n.tree AND (c.id = n.left OR c.id = n.right))
        SELECT n.*, a.depth FROM depth_nodes_{tag} n JOIN at a ON a.tree = n.tree AND a.id = n.id""")


def tree_documents(nodes: DataFrame) -> DataFrame:
    """One nested JSON document a tree, ``{"name": "Root", "children": [...]}``: a node's two
    branches are objects with the branch's condition and its children, a leaf is
    ``{"name": "Predict: 1.0"}``. Documents are folded level by level from the deepest
    one, one join a level; whole trees meet in one row only at the root."""
    nodes = materialize(_with_depth(nodes))
    deepest = nodes.agg(F.max("depth")).first()[0]
    leaf = F.to_json(F.array(F.struct(F.concat(F.lit("Predict: "), F.col("prediction").cast("string")).alias("name"))))
    below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        own = nodes.where(F.col("depth") == depth)
        done = own.where("left < 0").select("tree", "id", leaf.alias("doc"))
        if below is not None:
            def child(side):
                return below.select("tree", F.col("id").alias(side), F.col("doc").alias(f"{side}_doc"))

            def branch(side):
                name = F.to_json(F.struct(node_condition(side == "left").alias("name")))
                return F.concat(F.substring(name, F.lit(1), F.length(name) - 1), F.lit(',"children":'), F.col(f"{side}_doc"), F.lit("}"))
            inner = own.where("left >= 0").join(child("left"), ["tree", "left"]).join(child("right"), ["tree", "right"])
            done = done.union(inner.select("tree", "id", F.concat(F.lit("["), branch("left"), F.lit(","), branch("right"), F.lit("]"))))
        below = materialize(done)
    if below is None:
        return nodes.select("tree", F.lit("").alias("json"))
    return below.select("tree", F.concat(F.lit('{"name":"Root","children":'), F.col("doc"), F.lit("}")).alias("json"))


def document_nodes(documents: DataFrame) -> DataFrame:
    """The node table back from ``tree_documents``; ids are given in the order in which a
    document names its nodes. Documents are opened level by level."""
    kids = "array<string>"
    level = documents.select("tree", F.array().cast("array<int>").alias("path"), F.get_json_object("json", "$.children").alias("doc"))
    found = None
    while True:
        level = materialize(level)
        node = F.from_json("doc", kids)
        opened = level.select("tree", "path", node.alias("b")).withColumn("name", F.get_json_object(F.col("b")[0], "$.name"))
        own = opened.select("tree", "path", "name", (F.size("b") == 2).alias("inner"))
        found = own if found is None else found.union(own)
        level = opened.where(F.size("b") == 2).select("tree", "path", F.posexplode("b").alias("side", "c")).select(
            "tree", F.concat("path", F.array("side")).alias("path"), F.get_json_object("c", "$.children").alias("doc"))
        if level.isEmpty():
            break
    # a path is before all longer ones that begin with it: the order of the ids
    found = materialize(found.withColumn("id", F.row_number().over(Window.partitionBy("tree").orderBy("path")) - 1))
    up = found.where(F.size("path") > 0).select("tree", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"),
                                                F.element_at("path", -1).alias("side"), F.col("id").alias("child"))
    up = up.groupBy("tree", "path").agg(F.max(F.when(F.col("side") == 0, F.col("child"))).alias("left"),
                                        F.max(F.when(F.col("side") == 1, F.col("child"))).alias("right"))
    part = lambda i: F.regexp_extract("name", r"feature (\d+) (<=|in) \{?([^{}]*)\}?$", i)
    return found.join(up, ["tree", "path"], "left").select(
        "tree", F.col("id").cast("int").alias("id"),
        F.when(~F.col("inner"), F.regexp_extract("name", r"Predict: (.*)$", 1).cast("double")).alias("prediction"),
        F.coalesce("left", F.lit(-1)).cast("int").alias("left"), F.coalesce("right", F.lit(-1)).cast("int").alias("right"),
        F.when(F.col("inner"), part(1).cast("int")).otherwise(-1).alias("feature"),
        F.when(F.col("inner"), F.filter(F.split(part(3), ","), lambda v: v != "").cast("array<double>"))
        .otherwise(F.array().cast("array<double>")).alias("values"),
        F.when(F.col("inner") & (part(2) == "in"), 0).otherwise(-1).alias("num_categories"))


def nodes_json(nodes: DataFrame) -> DataFrame:
    """One JSON object per node (``tree, id, prediction, left, right, feature, values,
    num_categories``), so a forest of any size is written by the executors."""
    return nodes.select("tree", "id", F.to_json(F.struct(*nodes.columns)).alias("json"))
