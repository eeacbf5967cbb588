"""Block tables and request/reply messages.

Operators that look up every n-gram or anchor of a corpus cut the documents into
blocks of a few MB. A block asks for its distinct 64-bit keys: the sorted keys
are cut into hash ranges (buckets) and sent as one packed array per bucket. A
bucket's task joins the arrays of all blocks and answers each block with an
array in the order of its keys, so replies need no keys. A hot key is one entry
per block, and no task holds more than its bucket's share of distinct keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import checkpointed, shuffle_partitions, slices, small_batches, text_bytes, tidy

BLOCK_BYTES = 4 << 20
BLOCKS_A_BUCKET = 8
BLOCK = "block long, ids array<long>, lens array<int>, raw long, payload binary, extra binary, flags array<boolean>"


def blocked(docs: DataFrame, extra: bool = False, flag: str | None = None, size: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, ids, lens, raw, payload, extra, flags): consecutive documents of
    a partition, their ids, byte lengths and zstandard-packed texts (null: empty);
    ``extra``, if asked for, has all other columns as an Arrow stream; ``flags`` has
    the boolean column ``flag``."""
    small_batches(docs.sparkSession)
    docs = docs if extra else docs.select("doc_id", "text", *[flag] * bool(flag))

    def cut(batches):
        seq = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", size):
                raw, offs = text_bytes(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seq]), pa.array([part.column("doc_id").cast(pa.int64()).to_pylist()], pa.list_(pa.int64())),
                     pa.array([np.diff(offs).astype(np.int32)], pa.list_(pa.int32())), pa.array([len(raw)]),
                     pa.array([zs.ZstdCompressor(level=3).compress(raw.tobytes())], pa.binary()),
                     pa.array([_stream(part.drop_columns(["text", *[flag] * bool(flag)])) if extra else None], pa.binary()),
                     pa.array([part.column(flag).to_pylist() if flag else None], pa.list_(pa.bool_()))],
                    ["block", "ids", "lens", "raw", "payload", "extra", "flags"])
                seq += 1

    return checkpointed(docs.mapInArrow(cut, BLOCK))


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zs.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def extra_of(row: dict) -> pa.RecordBatch:
    return pa.ipc.open_stream(zs.ZstdDecompressor().decompress(row["extra"])).read_next_batch()


def opened(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """(ids, bytes, row offsets) of a block row."""
    data = np.frombuffer(zs.ZstdDecompressor().decompress(row["payload"], max_output_size=max(1, row["raw"])), np.uint8)
    return row["ids"], data, np.concatenate(([0], np.cumsum(np.asarray(row["lens"], np.int64)))).astype(np.int64)


def rows_of(batches):
    """Block rows one at a time, so that only one is unpacked at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            tidy()


def n_buckets(blocks: DataFrame, size: int | None = None) -> int:
    """Hash ranges: one for the keys of ``BLOCKS_A_BUCKET`` blocks (or of ``size``
    bytes of text), so that a range holds a few million keys whatever the number of blocks."""
    n, raw = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("raw"), F.lit(0))).first()
    n = -(-raw // size) if size else -(-n // BLOCKS_A_BUCKET)
    return max(n, 2 * shuffle_partitions(blocks.sparkSession))


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where sorted keys pass from one of n equal hash ranges to the next (n + 1 places)."""
    bounds = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)])).astype(np.int64)


def pack(a: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed (most high bytes are 0)."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return zs.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zs.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1) if len(raw) else np.zeros(0, dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)
