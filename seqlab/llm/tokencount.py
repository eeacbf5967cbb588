"""Token counts by a separator scan over flat token files (operator 4).

A flat token file is nothing but token ids (unsigned 16 bits) of texts, each
closed by the end-of-document id; there is no index. It is read in blocks cut at
any place. Every block is searched for the separator at once (vectorised); a
prefix scan over the blocks of a file (tokens so far, separators so far, place
of the last one) then stitches the texts that run across blocks.

``write_flat`` makes such files from texts with a public byte-pair vocabulary
(its path is a parameter; executors need it at that place), and beside them a
manifest of the ids in order, which the scan does not see.

Defined cases: null and empty texts have 0 tokens; a text that says the
separator's name is ordinary text; tokens after a file's last separator are
counted as a text that is not ``closed``; files without a token, empty blocks
and an empty table give no rows; repeated rows and null ids are counted each.
"""

from __future__ import annotations

import base64
import re
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlab.llm.common import checkpointed, shuffle_partitions, slices, small_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how the vocabulary's public tokenizer splits a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 16
SPAN_BLOCKS = 4096      # blocks whose summaries one task scans
TASK_BYTES = 128 << 20  # of flat files read by one task


# The tokenizer's matcher keeps a state for each blank of a run, and ends the process at about
# a million. Unicode white space, as the pattern's \\s.
LONG_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


def encoder(path: str):
    """A function from a text to its token ids.

    A long run of blanks is cut out first: by the pattern all of it but its last blank is one
    piece (all of it at the text's end), and the last blank goes with what follows, so the
    ids are those of the whole text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    flat = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for run in LONG_BLANKS.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += flat.encode_ordinary(text[at:run.start()])
            out += flat._encode_single_piece(text[run.start():end])
            at = end
        return out + flat.encode_ordinary(text[at:]) if at else flat.encode_ordinary(text)

    return encode


def write_flat(docs: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(blocks, manifest): (file, block, data) with ``block_tokens`` ids each but a
    file's last, one file per task; (file, ordinal, doc_id) in the order of a file."""

    def flat(batches):
        encode, file = encoder(vocabulary), TaskContext.get().partitionId()
        rest, block, ordinal = np.zeros(0, np.uint16), 0, 0

        def rows(blocks, ids, first):
            n = len(blocks)
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * (n + 1), pa.int64()), pa.array([*(b for b, _ in blocks), None], pa.int64()),
                 pa.array([*(d for _, d in blocks), None], pa.binary()),
                 pa.array([None] * n + [first], pa.int64()), pa.array([None] * n + [ids], pa.list_(pa.int64()))],
                ["file", "block", "data", "first", "ids"])

        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.array([*encode(t or ""), SEPARATOR], np.uint16) for t in part.column("text").to_pylist()]
                rest = np.concatenate((rest, *ids))
                whole = len(rest) // block_tokens
                cut = [(block + i, rest[i * block_tokens:(i + 1) * block_tokens].tobytes()) for i in range(whole)]
                rest, block = rest[whole * block_tokens:].copy(), block + whole
                yield rows(cut, part.column("doc_id").cast(pa.int64()).to_pylist(), ordinal)
                ordinal += part.num_rows
        if len(rest):
            yield rows([(block, rest.tobytes())], [], ordinal)

    all_ = checkpointed(docs.select("doc_id", "text").mapInArrow(
        flat, "file long, block long, data binary, first long, ids array<long>"))
    manifest = all_.filter("block is null").select("file", "first", F.posexplode("ids").alias("at", "doc_id"))
    return (all_.filter("block is not null").select("file", "block", "data"),
            manifest.select("file", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id"))


def flat_files(spark, path: str, block_bytes: int = 2 * BLOCK_TOKENS, opener=None) -> DataFrame:
    """Blocks (file, block, data) of existing flat files in a folder; the path of a
    file is its key. Only names and lengths are listed; a task seeks to the byte
    ranges it was dealt, so a file of any length is read by many tasks.

    ``opener(path)`` gives a file object with ``seek`` and ``read``; files of the
    scheme ``file`` (every executor has the folder mounted) need none. In another
    store without an opener, Spark reads each file whole, which fails beyond 2 GiB."""
    small_batches(spark)
    listed = spark.read.format("binaryFile").load(path).filter("length > 0")
    first = listed.select("path").first()
    ranges = listed.select(F.col("path").alias("file"), F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))).alias("block"))
    if opener is None and first and urlsplit(first["path"]).scheme not in ("", "file"):
        whole = listed.select(F.col("path").alias("file"), "content").join(ranges, "file")
        return whole.select("file", "block", F.expr(f"substring(content, cast(block * {block_bytes} + 1 as int), {block_bytes})").alias("data"))
    n = ranges.count() * block_bytes // TASK_BYTES

    def read(batches):
        for batch in batches:
            for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                with (opener or _local)(file) as f:
                    f.seek(block * block_bytes)
                    data = f.read(block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary())],
                                                 ["file", "block", "data"])

    return ranges.repartition(max(n, shuffle_partitions(spark))).mapInArrow(read, "file string, block long, data binary")


def _local(path: str):
    return open(unquote(urlsplit(path).path) if path.startswith("file:") else path, "rb")


def scan(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every text in the files."""
    kind = dict(blocks.dtypes)["file"]

    def find(batches):
        for batch in batches:
            seps, size = [], []
            for data in batch.column("data"):
                tokens = np.frombuffer(data.as_buffer() if data.is_valid else b"", np.uint16)
                seps.append(np.flatnonzero(tokens == separator).astype(np.int64))
                size.append(len(tokens))
            at = np.concatenate(([0], np.cumsum([len(s) for s in seps]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(seps) if seps else np.zeros(0, np.int64)))],
                ["file", "block", "size", "seps"])

    found = checkpointed(blocks.mapInArrow(find, f"file {kind}, block long, size long, seps array<long>"))
    # The scan's state is tokens and separators so far and the place after the last
    # separator. It runs over summaries without the separators: inside spans of
    # blocks, then over a row per span, so no task holds a file.
    blocks_ = found.select("file", "block", "size", F.size("seps").alias("n"), F.try_element_at("seps", F.lit(-1)).alias("last"),
                           F.floor(F.col("block") / SPAN_BLOCKS).alias("span"))
    inside = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = blocks_.withColumn("base", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    own = (own.withColumn("after", F.col("base") + F.col("last") + 1)
           .withColumn("ordinal", F.coalesce(F.sum("n").over(inside), F.lit(0)))
           .withColumn("open", F.max("after").over(inside)))
    spans = own.groupBy("file", "span").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.max("after").alias("after"))
    earlier = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = checkpointed(spans.withColumn("base0", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
                         .withColumn("after", F.col("base0") + F.col("after"))
                         .withColumn("ordinal0", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
                         .withColumn("open0", F.coalesce(F.max("after").over(earlier), F.lit(0))))
    state = own.join(spans.select("file", "span", "base0", "ordinal0", "open0"), ["file", "span"]).select(
        "file", "block", (F.col("base0") + F.col("base")).alias("base"), (F.col("ordinal0") + F.col("ordinal")).alias("ordinal"),
        F.coalesce(F.col("base0") + F.col("open"), "open0").alias("open"))
    closed = found.filter(F.size("seps") > 0).select("file", "block", "seps").join(state, ["file", "block"])
    closed = closed.select("file", "ordinal", "base", "open", "seps", F.posexplode("seps").alias("i", "at"))
    before = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("seps", F.col("i") - 1) + 1)
    closed = closed.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"),
                           (F.col("base") + F.col("at") - before).alias("n_tokens"), F.lit(True).alias("closed"))
    ends = spans.groupBy("file").agg(F.sum("n").alias("ordinal"),
                                     (F.sum("size") - F.coalesce(F.max("after"), F.lit(0))).alias("n_tokens"))
    return closed.union(ends.filter("n_tokens > 0").select("file", "ordinal", "n_tokens", F.lit(False)))


def op4_token_counts(spark, sf_dir):
    blocks, manifest = write_flat(table(spark, sf_dir, "documents"))
    return (scan(blocks).join(manifest, ["file", "ordinal"], "left")
            .select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "closed"))
