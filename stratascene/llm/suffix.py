"""Repeated substrings: a Burrows-Wheeler transform and threshold-bounded interval expansion, dealt out by anchors.

*Dealing.* Every window of ``WINDOW`` bytes has an anchor, the ``ANCHOR`` bytes inside it with the smallest hash, so equal windows have
equal anchors at equal places. The successive windows of one anchor form a *cell*. A cell whose anchor occurs once
holds no repeated window. Cells with equal bytes collapse to one with a count; a count of two or more means that all
its windows are repeated. What is left are cells that share an anchor and differ, at the edges of repeats: they go, grouped by
anchor, through the transform. An anchor with very many different cells is split: each cell is cut into halves, which are
regrouped by the bytes that all windows of a half have in common.

*Expansion.* Over the cells of some groups, backward extension runs breadth first from the empty string: each interval of the
transform is extended by every symbol before it, and an extension whose right border is still open fixes the common prefix
there to the length reached. Prefixes are found by increasing length, and the search stops at ``WINDOW``: borders
that are open then separate suffixes that share at least so much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, ship_package, stage_table
from .filters import filter_of, may_have, passes

WINDOW = 400
ANCHOR = 200
#: Window starts that are anchored at once; bounds the memory for very long texts.
BLOCK = 1 << 18
#: Different cells of one group that a task puts through the transform; larger groups are split.
GROUP_CELLS = 400
#: Bytes that go through the transform at once.
BATCH_BYTES = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POS_BITS = 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(14, n.bit_length())
    if size not in _powers:
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def anchor_cells(data: bytes, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a text: first window start, number of windows, place of the anchor in the first window, anchor hash; they cover each window start once."""
    starts, counts, offsets, hashes = [], [], [], []
    last = len(data) - window
    for lo in range(0, last + 1, BLOCK):
        windows = min(BLOCK, last + 1 - lo)
        part = np.frombuffer(data, dtype=np.uint8, count=windows + window - 1, offset=lo).astype(np.uint64) + np.uint64(1)
        up, down = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        grams = len(part) - anchor + 1
        h = (sums[anchor:] - sums[:grams]) * down[:grams]
        h = (h ^ (h >> np.uint64(33))) * _M1
        h = (h ^ (h >> np.uint64(33))) * _M2
        h ^= h >> np.uint64(33)
        key = (h >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS)) | np.arange(grams, dtype=np.uint64)
        w = window - anchor + 1
        rows = -(-grams // w)
        padded = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:grams] = key
        grid = padded.reshape(rows, w)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[:windows], before[w - 1 : w - 1 + windows])
        at = (least & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        starts.append(first + lo)
        counts.append(np.diff(np.append(first, windows)))
        offsets.append(at[first] - first)
        hashes.append(h[at[first]])
    if not starts:
        none = np.array([], dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(offsets), np.concatenate(hashes)


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    k = key[order]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (k[1:] != k[:-1]).astype(np.int64))))
    return rank


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by doubling; the first sort takes as many symbols as fit in 63 bits."""
    n = len(symbols)
    bits = int(symbols.max() + 1).bit_length()
    h = 63 // bits
    padded = np.concatenate((symbols + 1, np.zeros(h, dtype=np.int64)))
    key = np.zeros(n, dtype=np.int64)
    for k in range(h):
        key = key << bits | padded[k : n + k]
    order = np.argsort(key)
    rank = _ranks(key, order)
    while h < depth and int(rank.max()) < n - 1:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = order[np.argsort(key[order], kind="stable")]  # nearly in order
        rank = _ranks(key, order)
        h *= 2
    return order


def open_borders(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each border of the suffix array (0 to n), whether the suffixes at its sides share ``least`` symbols or more.

    Works on the transform alone: ``before`` holds the symbol before each suffix, ``step`` maps it to the place of the longer suffix.
    Runs of equal symbols in the transform step together, so an interval is extended run by run.
    """
    n = len(symbols)
    before = symbols[order - 1]  # the first suffix is preceded by the last symbol, as in a rotation
    step = np.empty(n, dtype=np.int64)
    step[np.argsort(before * n + np.arange(n))] = np.arange(n)
    starts = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
    stops = np.append(starts[1:], n)
    run = np.repeat(np.arange(len(starts)), stops - starts)
    head = symbols[order]
    closed = np.zeros(n + 1, dtype=bool)
    closed[0] = closed[n] = True
    lb, rb = np.array([0]), np.array([n])
    for _ in range(least):
        first_run = run[lb]
        runs = run[rb - 1] - first_run + 1
        ends = np.cumsum(runs)
        interval = np.repeat(np.arange(len(lb)), runs)
        which = np.arange(ends[-1]) + np.repeat(first_run - ends + runs, runs)
        lo = np.maximum(starts[which], lb[interval])
        longer, size = step[lo], np.minimum(stops[which], rb[interval]) - lo
        by = np.argsort(longer)
        longer, size, interval = longer[by], size[by], interval[by]
        new = np.concatenate(([True], (interval[1:] != interval[:-1]) | (head[longer[1:]] != head[longer[:-1]])))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(longer)) - 1
        lb, rb = longer[first], longer[last] + size[last]
        fresh = ~closed[rb]
        lb, rb = lb[fresh], rb[fresh]
        closed[rb] = True
        if not len(lb):
            break
    return ~closed


def repeated_starts(cells: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each of some texts, for each window start, whether the window also starts elsewhere in them."""
    marks = len(cells)
    symbols = np.concatenate([x for k, c in enumerate(cells) for x in (np.frombuffer(c, dtype=np.uint8).astype(np.int64) + marks, np.array([k]))])
    order = suffix_array(symbols, window)
    share = open_borders(symbols, order, window)
    flags = np.zeros(len(symbols), dtype=bool)
    flags[order] = share[:-1] | share[1:]
    out, at = [], 0
    for c in cells:
        out.append(flags[at : at + len(c) - window + 1])
        at += len(c) + 1
    return out


def _body(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [h for h in (anchor_cells(_body(x))[3] for x in batch.column(0)) if len(h)]
        if found:
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["anchor", "n"])


def _cells_of(words_of_filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of_filter.value
        for batch in batches:
            out: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = _body(value)
                starts, counts, offsets, hashes = anchor_cells(data)
                if not len(starts):
                    continue
                keep = np.flatnonzero(passes(hashes, words))
                if not len(keep):
                    continue
                text = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                for s, n, off, h in zip(starts[keep].tolist(), counts[keep].tolist(), offsets[keep].tolist(), hashes[keep].view(np.int64).tolist()):
                    u = xxhash.xxh3_128_intdigest(data[s : s + n + WINDOW - 1])
                    out.append((doc, text, s, n, off, h, (u >> 64) - (1 << 63), (u & ((1 << 64) - 1)) - (1 << 63)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "text", "start", "n", "off", "anchor", "u1", "u2"])

    return run


def _cell_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the listed cells of each text, of the text that they were found in only."""
    for batch in batches:
        out: list[tuple] = []
        for value, cells in zip(batch.column(0), batch.column(1).to_pylist()):
            data = _body(value)
            text = xxhash.xxh3_64_intdigest(data) - (1 << 63)
            out += [(c["anchor"], c["u1"], c["u2"], 0, c["n"], c["off"], 0, WINDOW - ANCHOR + 1, data[c["start"] : c["start"] + c["n"] + WINDOW - 1]) for c in cells if c["text"] == text]
        if out:
            yield _cell_batch(out)


#: A cell or part of one: its group, the whole cell's bytes (u1, u2), the part's first window in it, windows, the anchor's place in
#: the first of them, the range of such places that the group is for, and the part's bytes.
_CELL_COLUMNS = ["grp", "u1", "u2", "skip", "n", "off", "low", "high", "body"]
_CELL = ", ".join(f"{c} long" for c in _CELL_COLUMNS[:-1]) + ", body binary"


def _cell_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 8 else pa.int64()) for k, c in enumerate(zip(*rows))], _CELL_COLUMNS)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each cell in two at the same place relative to the anchor, grouped by the bytes that every window of a half has."""
    for batch in batches:
        out: list[tuple] = []
        for _, u1, u2, skip, n, off, low, high, body in zip(*(c.to_pylist() for c in batch.columns)):
            middle = (low + high) // 2
            for x, y in ((low, middle), (middle, high)):  # windows with the anchor at places x to y - 1
                a, b = max(0, off - y + 1), min(n, off - x + 1)
                if b > a:
                    shared = body[off - x : off - y + 1 + WINDOW]
                    out.append((xxhash.xxh3_64_intdigest(shared, x) - (1 << 63), u1, u2, skip + a, b - a, off - a, x, y, body[a : b + WINDOW - 1]))
        if out:
            yield _cell_batch(out)


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of cells, relative to the whole cell; rows come sorted by group, and groups go through the transform some at a time."""

    def solved(rows: list[tuple]) -> pa.RecordBatch | None:
        where: dict[tuple[int, bytes], int] = {}
        twice: set[int] = set()
        for row in rows:
            grp, body = row[0], row[-1]
            k = where.setdefault((grp, body), len(where))
            if (grp, body) in seen:
                twice.add(k)
            seen.add((grp, body))
        flags = repeated_starts([b for _, b in where])
        out: list[tuple] = []
        for grp, u1, u2, skip, n, *_, body in rows:
            k = where[grp, body]
            f = np.ones(n, dtype=bool) if k in twice else flags[k]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], f.view(np.int8), [0]))))
            out += [(u1, u2, skip + a, skip + b + WINDOW - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        seen.clear()
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u1", "u2", "lo", "hi"])

    seen: set[tuple[int, bytes]] = set()
    held: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size > BATCH_BYTES and row[0] != last:
                if (got := solved(held)) is not None:
                    yield got
                held, size = [], 0
            held.append(row)
            size += len(row[-1])
            last = row[0]
    if held and (got := solved(held)) is not None:
        yield got


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out: list[tuple] = []
        for doc, value, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = _body(value)
            merged: list[list[int]] = []
            if spans:
                text = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                for s, e in sorted((x["lo"], x["hi"]) for x in spans if x["text"] == text):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
            kept, at = hashlib.sha256(), 0
            for s, e in merged:
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            out.append((doc, len(data), sum(e - s for s, e in merged), len(merged), kept.hexdigest(), [{"start": s, "end": e} for s, e in merged]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind))], names)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    ``spans`` are the maximal runs of bytes covered by a string of ``WINDOW`` bytes that also starts anywhere else, in the same document
    or another, in UTF-8; ``kept_sha256`` is of the other bytes, concatenated. Matches never cross documents. A null text is
    empty; a text of fewer than ``WINDOW`` bytes has no span; repeated rows repeat each other. A null identifier is handled like any
    other. An empty table gives an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    anchors = slim.select("body").mapInArrow(_anchor_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    words = filter_of(anchors.select("anchor"))
    cells = stage_table(slim.mapInArrow(_cells_of(words), "doc long, text long, start long, n long, off long, anchor long, u1 long, u2 long"), "cells")
    kinds = stage_table(cells.groupBy("anchor", "u1", "u2").agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("doc", "text", "start", "n", "off"))), "kinds")
    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    differing = kinds.join(groups.select("anchor"), "anchor")
    listed = differing.groupBy("doc").agg(F.collect_list(F.struct("anchor", "u1", "u2", "text", "start", "n", "off")).alias("cells"))
    key = F.coalesce("id", F.lit(0))
    some = slim.where(may_have(key, filter_of(listed.select(F.coalesce("doc", F.lit(0)).alias("doc")))))  # other texts needn't travel
    bodies = some.join(listed, slim["id"].eqNullSafe(listed["doc"])).select("body", "cells").mapInArrow(_cell_bytes, _CELL)
    found = []
    while True:
        bodies = stage_table(bodies, "bodies")
        sizes = bodies.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
        small = bodies.join(sizes.where(f"members BETWEEN 2 AND {GROUP_CELLS}").select("grp"), "grp").select(*_CELL_COLUMNS)
        found.append(stage_table(dealt(small, "grp").sortWithinPartitions("grp").mapInArrow(_transform, "u1 long, u2 long, lo long, hi long"), "found"))
        large = sizes.where(f"members > {GROUP_CELLS}").select("grp")
        if large.isEmpty():
            break
        # of very many cells, those of equal bytes are done and leave one for the others to meet; the rest are split and regrouped
        wide = bodies.join(large, "grp").withColumn("key", F.md5("body"))
        wide = wide.join(wide.groupBy("grp", "key").agg(F.count(F.lit(1)).alias("copies")), ["grp", "key"])
        found.append(stage_table(wide.where("copies > 1").select("u1", "u2", F.col("skip").alias("lo"), (F.col("skip") + F.col("n") + WINDOW - 1).alias("hi")), "found"))
        rest = wide.where("copies = 1").unionByName(wide.where("copies > 1").dropDuplicates(["grp", "key"]))
        bodies = rest.where("high - low > 1").select(*_CELL_COLUMNS).mapInArrow(_halves, _CELL)
    whole = kinds.where("copies > 1").select("u1", "u2", F.lit(0).cast("long").alias("lo"), (F.col("n") + WINDOW - 1).alias("hi"))
    for part in found:
        whole = whole.unionByName(part)
    spans = cells.join(whole, ["u1", "u2"]).groupBy("doc").agg(F.collect_list(F.struct("text", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))).alias("spans"))
    spans = stage_table(spans, "spans")
    marked = may_have(key, filter_of(spans.select(F.coalesce("doc", F.lit(0)).alias("doc"))))
    cut = slim.where(marked).join(spans, slim["id"].eqNullSafe(spans["doc"]), "left").select("id", "body", "spans")
    whole = slim.where(~marked).select("id", "body", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return cut.unionByName(whole).mapInArrow(_removed, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
