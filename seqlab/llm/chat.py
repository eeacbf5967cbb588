r"""Chat formatting in budgeted windows (operator 9).

Native: only DataFrame functions. A turn is rendered as
``<|turn|>role<|text|>text</s>``. Control strings inside roles and texts are
escaped reversibly: where ``<`` or ``[`` is followed by any number of ``~`` and
one of ``| / s I``, one more ``~`` is put in, so no rendered text holds
``<|``, ``</``, ``<s``, ``[I`` or ``[/``, and taking one ``~`` out restores it.

Prefix sums of the turns' tokens (words of the rendered turn) cut a conversation
into turn-aligned windows: a window starts where the sum passes a multiple of
the stride, which is half of what the system turn and the history leave of the
budget, so a window is within the budget unless one turn alone exceeds the
stride (``oversize``). A leading system turn is repeated at the start of every
window, followed by at most ``HISTORY_TURNS`` turns before the window's first
new one, within ``HISTORY_TOKENS``. The loss mask covers the texts of new
assistant turns; repeated turns are masked out, so each target is learned once.

Defined cases: null roles and texts are empty; turns follow by (turn, role,
text), null turns last; a null conv_id is a conversation of its own; repeated
rows are turns of their own; only a first turn of role ``system`` is the system
turn, later ones are ordinary; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlab.llm.common import WORD, table

BUDGET = 512
HISTORY_TURNS = 2
HISTORY_TOKENS = 96
TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(~*[|/sI])", r"$1~$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])~(~*[|/sI])", r"$1$2")


def windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS,
            history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, formatted, loss, repeated, tokens, oversize) from rows
    (conv_id, turn, role, text): ``loss`` has the code-point spans (start from 0,
    length) under the loss mask, ``repeated`` the number of leading turns that
    stand in an earlier window already."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_last(), "role", "text"]
    conv = Window.partitionBy("conv_id").orderBy(*order)
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    t = (t.withColumn("body", escape(F.col("text"))).withColumn("head", F.length(head).cast("long"))
         .withColumn("rendered", F.concat(head, F.col("body"), F.lit(END)))
         .withColumn("tokens", F.regexp_count("rendered", F.lit(WORD)).cast("long"))
         .withColumn("pos", F.row_number().over(conv).cast("long")))
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    t = t.withColumn("system", system).withColumn("own", F.when(system, F.lit(0)).otherwise(F.col("tokens")))
    upto = conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (t.withColumn("after", F.sum("own").over(upto)).withColumn("before", F.col("after") - F.col("own"))
         .withColumn("system_tokens", F.first(F.when(F.col("system"), F.col("tokens")).otherwise(F.lit(0))).over(upto))
         .withColumn("system_turn", F.first(F.when(F.col("system"), F.col("rendered"))).over(upto)))
    stride = F.greatest(F.lit(1), F.floor((budget - F.col("system_tokens") - history_tokens) / 2))
    t = t.withColumn("stride", stride)
    t = t.withColumn("window", F.floor(F.greatest(F.lit(0), F.col("after") - 1) / F.col("stride")))
    # a system turn opens the window of the turn that follows it
    t = t.withColumn("window", F.when(F.col("system"), F.coalesce(F.lead("window").over(conv), F.lit(0)))
                     .otherwise(F.col("window")))
    t = t.withColumn("opens", ~F.coalesce(F.lag("window").over(conv) == F.col("window"), F.lit(False)))

    def place(window, kind, at, text, new):
        """kind orders system, history and new turns inside a window."""
        return F.struct(window.alias("window"), F.lit(kind).alias("kind"), at.alias("pos"), text.alias("rendered"),
                        F.lit(new).alias("new"))

    own = place(F.col("window"), 2, F.col("pos"), F.col("rendered"), True)
    again = F.when(F.col("opens") & ~F.col("system") & F.col("system_turn").isNotNull() & (F.lag("system").over(conv) != F.lit(True)),
                   place(F.col("window"), 0, F.lit(0).cast("long"), F.col("system_turn"), False))
    places = [own, again]
    for j in range(1, history_turns + 1):
        later = F.lead("window", j).over(conv)
        fits = F.lead("before", j).over(conv) - F.col("before") <= history_tokens
        places.append(F.when(~F.col("system") & F.lead("opens", j).over(conv) & fits & (later != F.col("window")),
                             place(later, 1, F.col("pos"), F.col("rendered"), False)))
    t = t.withColumn("target", F.col("role") == "assistant").withColumn("places", F.array_compact(F.array(*places)))
    p = t.select("conv_id", "target", "head", F.length("body").cast("long").alias("body_chars"), "stride", "own",
                 F.explode("places").alias("p"))
    p = p.select("conv_id", "target", "head", "body_chars", "stride", "own", "p.*")
    inside = Window.partitionBy("conv_id", "window").orderBy("kind", "pos")
    p = p.withColumn("at", F.coalesce(F.sum(F.length("rendered")).over(
        inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    loss = F.when(F.col("new") & F.col("target"), F.struct((F.col("at") + F.col("head")).alias("start"),
                                                           F.col("body_chars").alias("length")))
    return p.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "pos", "rendered"))), lambda x: x["rendered"]),
                     "").alias("formatted"),
        F.sort_array(F.collect_list(loss)).alias("loss"),
        F.sum(F.when(~F.col("new"), 1).otherwise(0)).alias("repeated"),
        F.sum(F.regexp_count("rendered", F.lit(WORD))).cast("long").alias("tokens"),
        F.max(F.col("new") & (F.col("own") > F.col("stride"))).alias("oversize"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns array<role, text>, targets array<text>): the new
    turns of a window and its texts under the loss mask, unescaped."""
    parts = F.slice(F.split("formatted", END, -1), F.col("repeated").cast("int") + 1,
                    F.greatest(F.lit(0), F.size(F.split("formatted", END, -1)) - 1 - F.col("repeated").cast("int")))

    def turn(part):
        head = F.substring_index(part, TEXT, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(TURN) + 1))).alias("role"),
                        unescape(F.substr(part, F.length(head) + len(TEXT) + 1)).alias("text"))

    texts = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"),
                                                            s["length"].cast("int"))))
    return formatted.select("conv_id", "window", F.transform(parts, turn).alias("turns"), texts.alias("targets"),
                            F.length("formatted").cast("long").alias("chars"))


def op9_chat_windows(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(said).alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(said).alias("text")))).alias("t"))
    rows = read_back(windows(conv.unionByName(probe.select("conv_id", "t.*"))))
    own = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = rows.select("conv_id", "window", F.size("turns").alias("n"), own.alias("own"),
                      F.array_join("targets", "").alias("loss"), "chars")
    g = per.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "own", "loss"))).alias("w"),
                                   F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                   F.count(F.lit(1)).alias("n_windows"))
    g = g.withColumn("own", F.array_join("w.own", "")).withColumn("loss", F.array_join("w.loss", ""))
    return g.select("conv_id", "n_turns", F.sha2(F.col("own").cast("binary"), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows")


OP9_SQL = rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
a AS (
  SELECT *, row_number() OVER c AS pos,
    '{TURN}' || regexp_replace(role, '([<\[])(~*[|/sI])', '\1~\2', 'g') || '{TEXT}' ||
    regexp_replace(text, '([<\[])(~*[|/sI])', '\1~\2', 'g') || '{END}' AS rendered
  FROM raw WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
b AS (SELECT *, len(regexp_extract_all(rendered, '[^\x20\x09-\x0D]+')) AS tokens, pos = 1 AND role = 'system' AS sys FROM a),
c AS (SELECT *, CASE WHEN sys THEN 0 ELSE tokens END AS own, first_value(CASE WHEN sys THEN tokens ELSE 0 END) OVER p AS sys_tokens,
        first_value(CASE WHEN sys THEN length(rendered) END) OVER p AS sys_chars
      FROM b WINDOW p AS (PARTITION BY conv_id ORDER BY pos)),
d AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY pos) AS after,
        greatest(1, CAST(floor(({BUDGET} - sys_tokens - {HISTORY_TOKENS}) / 2.0) AS BIGINT)) AS stride FROM c),
e AS (SELECT *, CAST(floor(greatest(0, after - 1) / CAST(stride AS DOUBLE)) AS BIGINT) AS w0 FROM d),
f AS (SELECT *, CASE WHEN sys THEN coalesce(lead(w0) OVER p, 0) ELSE w0 END AS win FROM e
      WINDOW p AS (PARTITION BY conv_id ORDER BY pos)),
g AS (SELECT *, coalesce(lag(win) OVER p <> win, true) AS opens, coalesce(lag(sys) OVER p, false) AS after_sys FROM f
      WINDOW p AS (PARTITION BY conv_id ORDER BY pos)),
h AS (SELECT *,
        length(rendered) + CASE WHEN opens AND NOT sys AND sys_chars IS NOT NULL AND NOT after_sys THEN sys_chars ELSE 0 END
        {"".join(f''' + CASE WHEN NOT sys AND coalesce(lead(opens, {j}) OVER p, false) AND lead(win, {j}) OVER p <> win
          AND lead(after - own, {j}) OVER p - (after - own) <= {HISTORY_TOKENS} THEN length(rendered) ELSE 0 END''' for j in range(1, HISTORY_TURNS + 1))} AS chars
      FROM g WINDOW p AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, count(DISTINCT win) AS n_windows
FROM h GROUP BY conv_id
"""
