"""Packed training rows: best-fit-decreasing bin packing of token ids with a segment tree over free capacities.

A document longer than a row is split into full rows and a rest; nothing is cut off. Rests are packed by decreasing length, each
into the row with the least free space that still holds it. A task packs its documents in windows of about ``WINDOW`` ids, so its
memory is bounded; rows of a window that are far from full hand their pieces on to the next window. No shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec
from .common import ship_package

#: Ids that a task gathers before it packs them.
WINDOW = 8_000_000
#: A row with more than this share free hands its pieces on while more documents come.
LOOSE = 0.02
#: Rows of one output batch.
ROWS_OUT = 256
PAD = 0
#: The ids of bytes start here; 0 pads, 1 and 2 are left for a model's own marks.
FIRST_BYTE = 3


def byte_ids(text: str) -> np.ndarray:
    """A text as ids of its UTF-8 bytes: small, lossless, and the same for every language."""
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint16) + np.uint16(FIRST_BYTE)


def bpe_ids(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """An encoder of texts as ids of the byte-level BPE in the rank file ``path``."""

    def encode(text: str) -> np.ndarray:
        return np.frombuffer(codec(path, pattern).encode(text), dtype="<u4")

    return encode


class CapacityTree:
    """Counts of rows by free capacity; finds the smallest capacity of at least ``n`` in logarithmic time."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def least(self, n: int) -> int | None:
        k = n + self.leaves
        if self.count[k]:
            return n
        while k > 1:
            if not k & 1 and self.count[k + 1]:  # the sibling to the right has one
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def best_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """Rows as lists of positions in ``sizes``, each of 1 to ``row``; ties by position."""
    tree = CapacityTree(row)
    by_capacity: dict[int, list[int]] = {}
    rows: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        capacity = tree.least(sizes[k])
        if capacity is None:
            at, capacity = len(rows), row
            rows.append([])
        else:
            at = by_capacity[capacity].pop()
            tree.add(capacity, -1)
        rows[at].append(k)
        left = capacity - sizes[k]
        if left:
            by_capacity.setdefault(left, []).append(at)
            tree.add(left, 1)
    return rows


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions of a row: from 0 again at each segment."""
    return np.concatenate([np.arange(b - a) for a, b in zip(cu_seqlens, cu_seqlens[1:])]) if len(cu_seqlens) > 1 else np.array([], dtype=np.int64)


_SCHEMA = "pack_id long, n_tokens int, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


def _batch(first: int, packs: list[list[tuple]], row: int, kind: str) -> pa.RecordBatch:
    ids, docs, offsets, ends, resets, data = [], [], [], [], [], []
    for k, pieces in enumerate(packs):
        lengths = [len(p[2]) for p in pieces]
        cu = [0, *np.cumsum(lengths).tolist()]
        matrix = np.full(row, PAD, dtype=kind)
        matrix[: cu[-1]] = np.concatenate([p[2] for p in pieces])
        ids.append(first + k)
        docs.append([p[0] for p in pieces])
        offsets.append([p[1] for p in pieces])
        ends.append(cu)
        resets.append(cu[:-1])
        data.append(matrix.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([c[-1] for c in ends], pa.int32()), pa.array(docs, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), pa.array(data, pa.binary())], ["pack_id", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", "position_resets", "input_ids"])


def pack_documents(docs: DataFrame, row: int = 2048, id_col: str = "doc_id", text_col: str = "text", encode: Callable[[str], np.ndarray] = byte_ids, window: int = WINDOW, id_bytes: int = 2) -> DataFrame:
    """One row per packed row of ``row`` ids: ``pack_id, n_tokens, doc_ids, doc_offsets, cu_seqlens, position_resets, input_ids``.

    ``doc_ids`` and ``doc_offsets`` tell which document and which of its ids each segment starts with; ``cu_seqlens`` are cumulative
    segment lengths from 0; positions start from 0 at ``position_resets``; ``input_ids`` are ``row`` little-endian unsigned ids of
    ``id_bytes`` (2 or 4, in every row), padded with 0 after the first ``n_tokens``; an id that doesn't fit is an error. Null and empty texts have no ids and are in no row. A null
    identifier is null in ``doc_ids``; repeated rows are packed each; an empty table gives an empty table. Other columns are
    ignored. ``pack_id`` holds the number of the task and of its row: the same input files give the same rows.
    """
    ship_package(docs.sparkSession)
    kind = {2: "<u2", 4: "<u4"}[id_bytes]

    def encoded(text: str) -> np.ndarray:
        ids = np.asarray(encode(text))
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 8 * id_bytes:
            raise ValueError(f"ids from {ids.min()} to {ids.max()} don't fit into {id_bytes} bytes")
        return ids.astype(kind, copy=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        full: list[list[tuple]] = []
        rests: list[tuple] = []
        held = 0

        def packed(last: bool) -> list[list[tuple]]:
            nonlocal rests, held
            out, rows = full[:], best_fit_decreasing([len(p[2]) for p in rests], row)
            left: list[tuple] = []
            for members in rows:
                pieces = [rests[k] for k in members]
                if last or sum(len(p[2]) for p in pieces) >= (1 - LOOSE) * row:
                    out.append(pieces)
                else:
                    left += pieces
            full.clear()
            rests, held = left, sum(len(p[2]) for p in left)
            if held > window // 2:  # pieces that fit together badly don't pile up
                out += [[left[k] for k in members] for members in best_fit_decreasing([len(p[2]) for p in left], row)]
                rests, held = [], 0
            return out

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            packs = packed(last)
            for k in range(0, len(packs), ROWS_OUT):
                yield _batch(made, packs[k : k + ROWS_OUT], row, kind)
                made += len(packs[k : k + ROWS_OUT])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoded(text.as_py() or "")
                whole = len(ids) // row * row
                full += [[(doc, k, ids[k : k + row])] for k in range(0, whole, row)]
                if whole < len(ids):
                    rests.append((doc, whole, ids[whole:].copy()))
                held += len(ids)
                if held >= window:
                    yield from flush(last=False)
        yield from flush(last=True)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, _SCHEMA)


def write_packs(packs: DataFrame, root: str) -> None:
    """Write packed rows under ``root``: id matrices, with cumulative lengths, position resets and the documents of the segments."""
    packs.write.parquet(f"{root}/packs")


def read_packs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(f"{root}/packs")
