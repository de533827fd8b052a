"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document's sketch has ``BINS`` coordinates. In round ``i`` every element of the set is hashed to one bin, with a value in
[i, i + 1); a bin keeps its smallest value. After ``BINS`` rounds the bins are visited one after another, so each coordinate is
filled after twice as many rounds at the latest; usually a few do. A coordinate agrees with probability equal to the Jaccard
similarity, concentrated as if the coordinates were independent.

Rows of equal sets are one class. ``BANDS`` bands of ``ROWS`` coordinates deal classes into buckets, and what shares a bucket is
compared in *blocks*: a task holds the texts of a block or two, numbers their shingles, and one matrix product gives all
intersections of the full sets. First every class meets, in a block, others with the same hub (the class with the most neighbours in its
buckets) and that hub. Buckets that then hold more than one component are open: classes outside a bucket's largest component meet all
its blocks. Only links that join components leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, give_back, new_name, ship_package, stage_table
from .components import connected_components
from .filters import filter_of, may_have, passes

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 2.5e-7, one of 0.85 with 5e-11.
ROWS, BANDS = 6, 50
BINS = ROWS * BANDS
#: Classes, and shingles of these, in a block, on average at most; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 256, 200_000
#: Columns of the matrix that is multiplied at once.
COLUMNS = 1 << 13
#: A bucket of more classes names whole blocks for comparison, a smaller one its own classes.
SMALL = 64
#: Shingles that are sketched at once.
CHUNK = 150_000
#: Words whose hash a worker remembers.
MEMORY = 150_000

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, parted by space and the ASCII controls from tab to return, which is how ``bytes.split`` parts."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """Distinct ``n``-word shingles; a shorter sequence is one shingle, and no word is none."""
    return set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else ({tuple(words)} if words else set())


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a document's shingles."""
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < n:
        return np.array([int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little")], dtype=np.uint64) if len(h) else h
    x = h[: len(h) - n + 1]
    for k in range(1, n):
        x = mix(x + _M3) + h[k : len(h) - n + 1 + k]
    return np.unique(mix(x))


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` coordinates (64-bit hashes of round and value) for each set, none of which may be empty."""
    out = np.zeros((len(sets), bins), dtype=np.uint64)
    filled = np.zeros((len(sets), bins), dtype=bool)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets)
    seeds = np.arange(1, 2 * bins + 1, dtype=np.uint64) * _M3
    for i in range(2 * bins):
        h = mix(x + seeds[i])
        at = (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64) if i < bins else np.full(len(x), i - bins)
        best = np.full(len(sets) * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(best, doc * bins + at, h)
        best = best.reshape(len(sets), bins)
        new = ~filled & (best != np.iinfo(np.uint64).max)
        out[new] = best[new] + np.uint64(i)
        filled |= new
        left = ~filled.all(axis=1)
        if not left.any():
            break
        stay = left[doc]
        doc, x = doc[stay], x[stay]
    return out


def band_hashes(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash for each band of each sketch; bands of different places differ."""
    parts = sketch.reshape(len(sketch), -1, rows)
    h = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _M3, parts.shape[:2]).copy()
    for k in range(rows):
        h = mix(h * _M3 + parts[:, :, k])
    return h


def _chunks(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, s in enumerate(sets):
        if size and size + len(s) > CHUNK:
            yield start, k
            start, size = k, 0
        size += len(s)
    if start < len(sets):
        yield start, len(sets)


def _sketch_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 300):
                part = batch.slice(lo, 300)
                if len(_hashes) > MEMORY:
                    _hashes.clear()
                sets = [shingle_hashes(words_of(x.as_py()), n) for x in part.column(1)]
                full = [k for k, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                for a, b in _chunks([sets[k] for k in full]):
                    for row, k in zip(band_hashes(sketches([sets[k] for k in full[a:b]])).view(np.int64), full[a:b]):
                        bands[k] = row
                keys = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist() if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*keys)), pa.array(bands, pa.list_(pa.int64()))], ["id", "hash", "n", "k1", "k2", "bands"])
        _hashes.clear()
        give_back()

    return run


def _shared_entries(bits):
    """``h, row, n, k1, k2`` for the bands of each row that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            h = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(passes(h, words))
            row = pa.array(keep // BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), *(batch.column(k).take(row) for k in range(4))], ["h", "row", "n", "k1", "k2"])

    return run


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def shingle_numbers(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some texts as sorted distinct pairs (text, shingle); equal shingles of ``n`` words have equal numbers, no hash is taken.

    Texts of fewer words have no pair: they are linked with equal sequences only.
    """
    known = _Numbers()
    words = [words_of(t) for t in texts]
    size = np.array([len(w) for w in words])
    x = np.fromiter((known[w] for ws in words for w in ws), dtype=np.int64, count=int(size.sum()))
    code, m = x, len(x)
    for k in range(1, n):
        m = max(0, len(x) - k)
        code = np.unique(code[:m] * len(known) + x[k:], return_inverse=True)[1].astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.maximum(size - n + 1, 0))
    ends = np.cumsum(size)
    starts = ends - size
    count = np.maximum(size - n + 1, 0)
    at = np.arange(count.sum()) + np.repeat(starts - (np.cumsum(count) - count), count)
    most = int(code.max()) + 1 if len(code) else 1
    pairs = np.unique(text * most + code[at])
    return pairs // most, pairs % most


def links(texts: list[str | None], roots: list[int], n: int, percent: int) -> list[tuple[int, int]]:
    """Places of linked texts that join different roots, as a spanning forest over the roots."""
    text, code = shingle_numbers(texts, n)
    sizes = np.bincount(text, minlength=len(texts)).astype(np.int64)
    shared = np.bincount(code)[code] > 1 if len(code) else np.zeros(0, dtype=bool)
    text, code = text[shared], code[shared]
    code = np.unique(code, return_inverse=True)[1]
    both = np.zeros((len(texts), len(texts)), dtype=np.float32)
    by = np.argsort(code, kind="stable")
    text, code = text[by], code[by]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [lo, lo + COLUMNS])
        m = np.zeros((len(texts), COLUMNS), dtype=np.float32)
        m[text[a:b], code[a:b] - lo] = 1
        both += m @ m.T
    inter = both.astype(np.int64)
    root = np.unique(np.array(roots), return_inverse=True)[1]
    u, v = np.nonzero((inter > 0) & (inter * 100 >= percent * (sizes[:, None] + sizes[None, :] - inter)) & (root[:, None] != root[None, :]))
    first = np.unique(root[u] * len(texts) + root[v], return_index=True)[1]
    edges: dict[int, list[tuple[int, int]]] = {}
    for x, y in zip(u[first].tolist(), v[first].tolist()):
        edges.setdefault(int(root[x]), []).append((x, y))
    found, seen = [], set()
    for start in edges:
        todo = [] if start in seen else [start]
        seen.add(start)
        while todo:
            for x, y in edges[todo.pop()]:
                if (r := int(root[y])) not in seen:
                    seen.add(r)
                    todo.append(r)
                    found.append((x, y))
    return found


def _block_links(n: int, percent: int):
    """Links ``u, v`` within each block comparison; rows ``a, b, node, root, body`` come sorted by the two block names; of a class's repeated rows one counts."""

    def solved(group: dict[int, tuple]) -> list[tuple[int, int]]:
        nodes, roots, texts = group, *zip(*group.values())
        nodes = list(nodes)
        return [(max(nodes[x], nodes[y]), min(nodes[x], nodes[y])) for x, y in links(list(texts), list(roots), n, percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, found = None, {}, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                for a, b, node, root, body in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns)):
                    if (a, b) != key:
                        if len(group) > 1:
                            found += solved(group)
                        key, group = (a, b), {}
                    group.setdefault(node, (root, body))
            yield _pair_batch(found)
            found = []
        yield _pair_batch(solved(group) if len(group) > 1 else [])
        group.clear()
        give_back()

    return run


def _pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])


def _compared(plan: DataFrame, rows: DataFrame, slim: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """Links ``u, v`` among the classes (``node, root``) of each block comparison (``a, b``) of ``plan``; only texts that it names leave the scan.

    A class's text is found again by the identifier and hash of its first row, so that rows of one identifier may have different texts.
    """
    plan = stage_table(plan.join(rows.select(F.col("row").alias("node"), F.col("id").alias("name"), F.col("hash").alias("text_hash")), "node"), name)
    texts = slim.where(may_have(F.xxhash64("id", "hash"), filter_of(plan.select(F.xxhash64("name", "text_hash")).distinct())))
    rows = texts.join(plan, texts["id"].eqNullSafe(plan["name"]) & (texts["hash"] == plan["text_hash"])).select("a", "b", "node", "root", "body")
    found = dealt(rows, "a", "b").sortWithinPartitions("a", "b").mapInArrow(_block_links(n, percent), "u long, v long")
    return stage_table(found, f"{name}-links")


def _salted(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` (``node, n``, keys) with ``block``, a hash of the keys and of one of so many parts that blocks are small enough."""
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("parts")
    cut = rows.join(rows.groupBy(*keys).agg(parts), list(keys))
    return cut.withColumn("block", F.xxhash64(*keys, F.pmod(F.xxhash64("node"), F.col("parts")))).drop("parts")


def _open_blocks(members: DataFrame, blocks: DataFrame, comp: DataFrame) -> DataFrame:
    """What the first comparison left: ``a, b, node, root`` for blocks of buckets with more than one component.

    The classes of a bucket's largest component needn't meet each other; all others meet every block of the bucket.
    """
    rest = members.join(comp, "node", "left").select("h", "m", "node", F.coalesce("root", "node").alias("root"))
    open_ = rest.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("h")
    rest = stage_table(rest.join(open_, "h"), "open")
    main = rest.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max(F.struct("c", "root")).alias("main")).select("h", F.col("main.root").alias("main"))
    outside = rest.join(main, "h").groupBy("node").agg(F.max(F.col("root") != F.col("main")).alias("out"))
    kinds = stage_table(_salted(outside.join(blocks, "node"), "hub", "out").select("node", "out", "block"), "open-blocks")
    rest = stage_table(rest.join(kinds, "node").select("h", "m", "node", "root", "out", "block"), "open-members")
    low, high = F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")
    per = rest.groupBy("h", "m", "block", "out").agg(F.count(F.lit(1)).alias("c"))
    other = per.select("h", F.col("block").alias("other"), F.col("out").alias("other_out"))
    small = rest.where(f"m <= {SMALL}").join(other, "h").where("out OR other_out").select(low, high, "node", "root")
    pairs = per.where(f"m > {SMALL}").join(other, "h").where("out OR other_out").select(low, high).distinct()
    pairs = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    large = pairs.join(rest.select("node", "root", "block").distinct(), "block").select("a", "b", "node", "root")
    return small.unionByName(large).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """One row per input row: ``id, hash`` (of its text), ``n`` (its set's size) and ``first`` (identifier and hash of the first row of its component; null without a set or any identifier).

    A class is named by the number of one of its rows, which are numbered as they are written.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).withColumn("hash", F.xxhash64("body"))
    sketched = slim.mapInArrow(_sketch_rows(n), "id long, hash long, n long, k1 long, k2 long, bands array<long>")
    rows = stage_table(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches")
    full = rows.where("k1 IS NOT NULL")
    shared = full.select("k1", F.explode("bands").alias("anchor")).groupBy("anchor").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).where("x != y")  # buckets of different sets
    bits = filter_of(shared.select("anchor"))
    entries = full.select("row", "n", "k1", "k2", "bands").mapInArrow(_shared_entries(bits), "h long, row long, n long, k1 long, k2 long")
    names = stage_table(full.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "hash"))).alias("first")), "classes")
    entries = stage_table(entries.groupBy("h", "k1", "k2").agg(F.min("row").alias("node"), F.max("n").alias("n")).drop("k1", "k2"), "entries")
    members = stage_table(entries.join(entries.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "h"), "buckets")
    degree = members.groupBy("node").agg(F.sum("m").alias("degree"))
    hubs = members.join(degree, "node").groupBy("h").agg(F.max(F.struct("degree", "node")).alias("hub"))
    best = members.join(hubs, "h").groupBy("node").agg(F.max("hub").alias("hub"), F.max("n").alias("n")).select("node", "n", F.col("hub.node").alias("hub"))
    blocks = stage_table(_salted(best, "hub"), "blocks")
    plan = blocks.select("node", "block").unionByName(blocks.select(F.col("hub").alias("node"), "block")).distinct()
    found = _compared(plan.select(F.col("block").alias("a"), F.col("block").alias("b"), "node", F.col("node").alias("root")), rows, slim, n, percent, "hub-blocks")
    comp = stage_table(connected_components(found), "components")
    more = _compared(_open_blocks(members, blocks.select("node", "n", "hub"), comp), rows, slim, n, percent, "open-pairs")
    if not more.isEmpty():
        comp = stage_table(connected_components(comp.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "components")
    rooted = stage_table(names.join(comp, "node", "left").select("k1", "k2", "first", F.coalesce("root", "node").alias("root")), "roots")
    firsts = stage_table(rooted.groupBy("root").agg(F.min("first").alias("first")), "firsts")  # written, so that a component of very many classes can be split in the join
    named = rooted.drop("first").join(firsts, "root")
    return rows.select("id", "hash", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select("id", "hash", "n", "first")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct ``n``-word shingles; a component is
    what links reach, named by its smallest identifier. A null or empty text has an empty set, is linked with nothing and is its
    own component; equal sets are always linked. Repeated rows are rows of one class; rows of one identifier and different texts
    are linked through their own texts only. A null identifier names no component: its row takes that of its links, or null. An empty table gives an empty table. Other columns are ignored.
    """
    out = _classes(docs, id_col, text_col, n, percent).select("id", F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose text is the first of its component (by identifier), all columns unchanged; a null identifier stays.

    Rows are known by identifier and text: of one identifier's texts, those that are near another's first text go and the others stay; equal
    rows stay or go together. Null and empty texts stay; extra columns may have any name; an empty table gives an empty table.
    """
    rows = _classes(docs, id_col, text_col, n, percent).where((F.col("id") != F.col("first.id")) | (F.col("hash") != F.col("first.hash")))
    name, text = new_name(docs, "gone"), new_name(docs, "gone_hash")
    gone = rows.select(F.col("id").alias(name), F.col("hash").alias(text)).distinct()
    return docs.join(gone, (docs[id_col].cast("long") == F.col(name)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(text)), "left_anti")
