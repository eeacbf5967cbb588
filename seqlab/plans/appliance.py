"""The reference's feature/label stage on appliance settings derived from
``events``.

Every event carries deterministic settings computed from its columns:
temperature ``22 + event_id mod 8`` (so some fall outside 24..28), fan speed,
direction and mode picked from the reference's category names by
``event_id``, and a weather reading ``floor(value)`` that is blank for
``click`` events. Per user, in ``(ts, event_id)`` order, four consecutive
events make one feature row (three lags of temperature/speed/direction/mode;
the fourth gives weather and the targets), exactly as four consecutive
sessions do in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.functions.codes import (DIRECTION_CODES, FEATURE_COLS, MODE_CODES, NOMINAL_FEATURES,
                                    SPEED_CODES, TARGET_COLS, TEMP_OFFSET, TEMP_RANGE)
from seqlab.plans.events import with_event_blocks
from seqlab.operators.encode import assemble, category_table, hash_split, one_hot, one_hot_dataset, vector_values
from seqlab.operators.features import encode_categories, filter_range, sliding_features
from seqlab.operators.labels import class_count, combine_labels, index_labels, label_dictionary, label_index, \
    split_label
from seqlab.session import materialize
from seqlab.sinks.text import dataset_line, dictionary_line, libsvm_line
from seqlab.sources.tables import table


def _pick(names, idx):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (idx + 1).cast("int"))


def appliance_events(events: DataFrame) -> DataFrame:
    """Settings of every event, with the blocks of the per-user scans."""
    return appliance_settings(with_event_blocks(events), "blk")


def appliance_settings(events: DataFrame, *more: str) -> DataFrame:
    eid = F.col("event_id")
    return events.select(
        "user_id", "ts", "event_id", "event_type",
        (F.lit(22) + F.pmod(eid, F.lit(8))).cast("int").alias("temp"),
        _pick(list(SPEED_CODES), F.pmod(eid, F.lit(6))).alias("speed"),
        _pick(list(DIRECTION_CODES), F.pmod(F.floor(eid / 6), F.lit(3))).alias("direction"),
        _pick(list(MODE_CODES), F.pmod(F.floor(eid / 18), F.lit(5))).alias("mode"),
        F.when(F.col("event_type") != "click", F.floor("value").cast("int")).alias("weather"),
        *more,
    )


def appliance_windows(spark: SparkSession, data_dir: str) -> DataFrame:
    ev = appliance_events(table(spark, data_dir, "events"))
    return sliding_features(ev, "user_id", ["ts", "event_id"], width=4,
                            feature_cols=["temp", "speed", "direction", "mode"],
                            target_cols={"weather": "weather", "speed": "speed", "direction": "direction",
                                         "mode": "mode", "temp": "temp"},
                            start_cols={"event_id": "event_id"}, block="blk")


CODE_SPEC = {**{f"temp{i}": TEMP_OFFSET for i in (1, 2, 3)}, "temp": TEMP_OFFSET,
             **{f"speed{i}": SPEED_CODES for i in (1, 2, 3)}, "speed": SPEED_CODES,
             **{f"direction{i}": DIRECTION_CODES for i in (1, 2, 3)}, "direction": DIRECTION_CODES,
             **{f"mode{i}": MODE_CODES for i in (1, 2, 3)}, "mode": MODE_CODES}


def q_range_filter(spark, data_dir):
    return filter_range(appliance_windows(spark, data_dir), ["temp1", "temp2", "temp3", "temp"],
                        *TEMP_RANGE, required=["weather"])


def q_encode_categories(spark, data_dir):
    return encode_categories(q_range_filter(spark, data_dir), CODE_SPEC)


def labelled(spark, data_dir, reused: bool = False):
    """Coded rows with the combined label; ``reused=True`` checkpoints them
    for plans that read them twice (label index, then the rows)."""
    coded = q_encode_categories(spark, data_dir)
    out = coded.withColumn("label", combine_labels(["temp", "speed", "direction", "mode"]))
    return materialize(out) if reused else out


def q_combine_labels(spark, data_dir):
    lab = labelled(spark, data_dir)
    back = [c.alias(f"{n}_back") for c, n in zip(split_label("label"), ["temp", "speed", "direction", "mode"])]
    return lab.select("event_id", "temp", "speed", "direction", "mode", "label", *back)


def q_split_label(spark, data_dir):
    """Combined labels back to their four codes."""
    lab = labelled(spark, data_dir)
    return lab.select("event_id", "label", *split_label("label"))


def q_target_label(spark, data_dir):
    """Single-target form: the 13 features, label = temperature code."""
    coded = q_encode_categories(spark, data_dir)
    return coded.select("user_id", "event_id", *FEATURE_COLS, F.col("temp").alias("label"))


def q_index_labels(spark, data_dir):
    return label_index(labelled(spark, data_dir))


def q_label_dictionary(spark, data_dir):
    idx = label_index(labelled(spark, data_dir))
    d = label_dictionary(idx)
    return d.select("label_index", "label", "label_text", dictionary_line("label_index", "label_text").alias("line"))


def q_class_count(spark, data_dir):
    return class_count(labelled(spark, data_dir))


def q_format_dataset(spark, data_dir):
    lab = index_labels(labelled(spark, data_dir, reused=True))
    return lab.select("event_id", dataset_line(list(FEATURE_COLS), "label_index").alias("line"))


def q_format_libsvm(spark, data_dir):
    lab = labelled(spark, data_dir)
    return lab.select("event_id", libsvm_line(list(FEATURE_COLS), "label").alias("line"))


def q_category_index(spark, data_dir):
    ev = table(spark, data_dir, "events").select("event_type")
    counts = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    index = category_table(ev, ["event_type"]).select(F.col("value").alias("event_type"), F.col("idx").alias("event_type_idx"))
    return index.join(counts, "event_type")


def q_one_hot(spark, data_dir):
    ev = table(spark, data_dir, "events").select("event_id", "event_type")
    return one_hot(ev, ["event_type"], drop_last=False).select(
        "event_id", "event_type", vector_values("event_type_vec").alias("onehot"))


def q_one_hot_drop_last(spark, data_dir):
    ev = table(spark, data_dir, "events").select("event_id", "event_type")
    return one_hot(ev, ["event_type"], drop_last=True).select(
        "event_id", "event_type", vector_values("event_type_vec").alias("onehot"))


def q_one_hot_dataset(spark, data_dir):
    """Every coded feature one-hot (categories by frequency), then the four
    target codes (``speed, direction, mode, temp``)."""
    coded = materialize(q_encode_categories(spark, data_dir))
    enc = one_hot(coded, list(FEATURE_COLS), drop_last=False)
    return one_hot_dataset(enc, [f"{c}_vec" for c in FEATURE_COLS], list(TARGET_COLS)).select("event_id", "values")


def q_assemble_row(spark, data_dir):
    """Seven numeric features and six one-hot vectors (direction and mode
    lags) in one vector, label = temperature code."""
    coded = materialize(q_encode_categories(spark, data_dir))
    nominal = [c for c in NOMINAL_FEATURES]
    enc = one_hot(coded, nominal, drop_last=False)
    numeric = ["temp1", "temp2", "temp3", "speed1", "speed2", "speed3", "weather"]
    out = assemble(enc, numeric + [f"{c}_vec" for c in nominal])
    return out.select("event_id", vector_values("features").alias("features"), F.col("temp").alias("label"))


def q_split_hash(spark, data_dir):
    ev = table(spark, data_dir, "events").select("event_id")
    return ev.select("event_id", hash_split("event_id", 70).alias("is_train"))


def q_parse_address(spark, data_dir):
    """Header-style records from customers: the user is the name without its
    first three characters; the address is ``CN`` + nation + segment, cut into
    province (three characters for nations starting with AL or AR, else two)
    and city."""
    from seqlab.functions.address import header_user, parse_address
    cust = table(spark, data_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, data_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rec = cust.join(nation, "c_nationkey", "left").select(
        "c_custkey", F.col("c_name"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("None"))
         .otherwise(F.concat(F.lit("CN"), F.col("n_name"), F.col("c_mktsegment"))).alias("address"))
    prov, city = parse_address("address", long_prefixes=("AL", "AR"))
    return rec.select("c_custkey", header_user("c_name").alias("user"), "address",
                      prov.alias("province"), city.alias("city"))
