"""Token ids in a binary format: patched frame-of-reference blocks.

The ids of all documents, in ascending document order, form one stream. It is stored as segments, the
rows of a Parquet table: a segment holds the ids of consecutive whole documents in blocks of 128. Of
a block the minimum is subtracted, the differences are packed at the width that fits nine in ten of
them, and the rest go to an exception list (position and high bits). Each segment indexes where its
blocks start, so a document is read without the blocks before it.

Null texts count as empty; an empty document has the end id alone; a very long one is a segment of its own.
Rows with equal ids are ordered by text. Columns other than the id and the text are not looked at. An empty
table gives an empty folder and an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from savanto.llm import vocabulary
from savanto.llm.common import slices, whole_text

BLOCK = 128
#: Share of a block's differences that the packed width must hold.
PACKED_SHARE = 0.9
#: Ids after which a segment ends (at the end of a document).
SEGMENT_IDS = 1 << 18
#: Bytes of text that are encoded together: each distinct piece of them is looked up once.
SLICE = 1 << 23

SEGMENT = """part int, segment int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>,
 minima binary, widths binary, starts binary, payload binary, patch_counts binary, patch_places binary, patch_values binary"""


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def _lanes(width: int):
    """Values whose bits lie alike in their 64-bit lane: (value, step between such values, lane, shift, step of lanes)."""
    period = 64 // math.gcd(width, 64)
    for k in range(min(period, BLOCK)):
        yield k, period, k * width // 64, k * width % 64, period * width // 64


def _pack_lanes(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values, each below ``2**width``, as rows of 64-bit lanes, lowest bits first."""
    wide = values.astype(np.uint64)
    out = np.zeros((len(values), BLOCK * width // 64), np.uint64)
    for k, step, lane, shift, lanes in _lanes(width):
        out[:, lane::lanes] |= wide[:, k::step] << np.uint64(shift)
        if shift + width > 64:
            out[:, lane + 1 :: lanes] |= wide[:, k::step] >> np.uint64(64 - shift)
    return out.astype("<u8", copy=False)


def _unpack_lanes(packed: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(packed), BLOCK), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k, step, lane, shift, lanes in _lanes(width):
        part = packed[:, lane::lanes] >> np.uint64(shift)
        if shift + width > 64:
            part = part | (packed[:, lane + 1 :: lanes] << np.uint64(64 - shift))
        out[:, k::step] = part & mask
    return out


def pack(ids: np.ndarray) -> dict[str, bytes]:
    """The blocks of a segment as named byte strings."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.empty(n_blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids) :] = ids[-1]
    blocks = padded.reshape(n_blocks, BLOCK)
    minima = blocks.min(axis=1) if n_blocks else np.empty(0, np.uint32)
    rest = blocks - minima[:, None]
    at = int(np.ceil(BLOCK * PACKED_SHARE)) - 1
    widths = bit_widths(np.partition(rest, at, axis=1)[:, at]) if n_blocks else np.empty(0, np.uint8)
    # uint64: a width of 32 must not overflow the shift
    high = rest.astype(np.uint64) >> widths.astype(np.uint64)[:, None]
    where, place = np.nonzero(high)
    sizes = widths.astype(np.int64) * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32)
    payload = np.zeros(int(starts[-1]), np.uint8)
    for width in np.unique(widths).tolist():
        if width:
            rows = np.flatnonzero(widths == width)
            packed = _pack_lanes(rest[rows] & np.uint32((1 << width) - 1), width).view(np.uint8)
            payload[starts[rows][:, None] + np.arange(packed.shape[1])] = packed
    return {
        "minima": minima.astype("<u4").tobytes(),
        "widths": widths.tobytes(),
        "starts": starts.astype("<u4").tobytes(),
        "payload": payload.tobytes(),
        "patch_counts": np.bincount(where, minlength=n_blocks).astype("<u2").tobytes(),
        "patch_places": place.astype(np.uint8).tobytes(),
        "patch_values": high[where, place].astype("<u4").tobytes(),
    }


def unpack(segment: dict[str, bytes], n_ids: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a segment; only their blocks are read."""
    last = n_ids if last is None else last
    low, high = first // BLOCK, -(-last // BLOCK)
    widths = np.frombuffer(segment["widths"], np.uint8)[low:high]
    starts = np.frombuffer(segment["starts"], "<u4")[low:high].astype(np.int64)
    payload = np.frombuffer(segment["payload"], np.uint8)
    out = np.zeros((len(widths), BLOCK), np.uint32)
    for width in np.unique(widths).tolist():
        if width:
            rows = np.flatnonzero(widths == width)
            packed = payload[starts[rows][:, None] + np.arange(width * (BLOCK // 8))]
            out[rows] = _unpack_lanes(packed.view("<u8"), width)
    counts = np.frombuffer(segment["patch_counts"], "<u2").astype(np.int64)
    before = int(counts[:low].sum())
    counts = counts[low:high]
    n = int(counts.sum())
    block = np.repeat(np.arange(len(widths)), counts)
    place = np.frombuffer(segment["patch_places"], np.uint8)[before : before + n]
    values = np.frombuffer(segment["patch_values"], "<u4")[before : before + n].astype(np.uint64)
    out[block, place] |= (values << widths[block].astype(np.uint64)).astype(np.uint32)
    out += np.frombuffer(segment["minima"], "<u4")[low:high][:, None]
    return out.reshape(-1)[first - low * BLOCK : last - low * BLOCK]


BYTES = ("minima", "widths", "starts", "payload", "patch_counts", "patch_places", "patch_values")


def _writer(path: str, end: np.ndarray):
    fields = pa.schema(
        [("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
        + [(name, pa.binary()) for name in BYTES]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = vocabulary.library_encoder(path), TaskContext.get().partitionId()
        doc_ids: list[int] = []
        pieces: list[np.ndarray] = []
        segment = first = held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(pieces)
            packed = pack(ids)
            whole = pa.array([0, len(doc_ids)], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, pa.array(x, pa.int64())) for x in (doc_ids, [len(p) for p in pieces])]
            row = [pa.array([x], f.type) for x, f in zip((part, segment, first, len(ids)), fields, strict=False)]
            return pa.RecordBatch.from_arrays([*row, *lists, *[pa.array([packed[name]], pa.binary()) for name in BYTES]], schema=fields)

        for batch in batches:
            for rows in slices(batch, size=SLICE):
                ids, ends = encoder.flat(rows.column("text"))
                for doc_id, a, b in zip(rows.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True):
                    doc_ids.append(doc_id)
                    pieces.append(np.concatenate([ids[a:b], end]))
                    held += len(pieces[-1])
                    if held >= SEGMENT_IDS:
                        yield flush()
                        segment, first, held, doc_ids, pieces = segment + 1, first + held, 0, [], []
        if doc_ids:
            yield flush()

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the stream, ascending by ``doc_id``, to ``folder``."""
    end = np.array([] if end_id is None else [end_id], "<u4")
    ordered = (
        docs.select(docs[doc_id].alias("doc_id"), whole_text(docs[text]).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(_writer(tokenizer, end), SEGMENT).write.parquet(folder)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row, row["n_ids"]).astype("<u4")
            ends = np.cumsum(row["lengths"])
            starts = ends - np.asarray(row["lengths"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["offset"] + row["first"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([ids[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()),
                ],
                ["doc_id", "start", "n_tokens", "ids"],
            )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """The stored segments with ``offset``, the ids of all parts before theirs."""
    stored = spark.read.schema(SEGMENT).parquet(folder)
    # one row for each part, of which the write made as many as it had range partitions
    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return stored.join(F.broadcast(offsets), "part")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document; ids are little-endian unsigned 32-bit."""
    return segments(spark, folder).mapInArrow(_reader, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
