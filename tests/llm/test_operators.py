"""Operators on small tables with nulls, empty and repeated rows, ties, and extra columns, against plain Python."""

import hashlib
import random
import sys

import public_tokenizers
import pytest

from stratascene.llm import bpe, chaining, exact_dedup, merkle, minhash, mixing, packing, suffix, toxicity, warc

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(400)]
LONG = " ".join(R.choice(WORDS) for _ in range(300))
PASSAGE = " ".join(R.choice(WORDS) for _ in range(90))
ROWS = [
    (1, LONG), (2, LONG.upper()), (3, LONG + " tail"), (4, "short text"), (5, "Short Text"), (6, ""), (7, None), (8, "one"), (9, "ONE"), (10, "  "), (None, "no id"), (4, "short text"),
    (11, " ".join(R.choice(WORDS) for _ in range(60)) + " " + PASSAGE + " " + " ".join(R.choice(WORDS) for _ in range(40))), (12, PASSAGE + "\nother\n\nparts Ä ß é"), (13, "x" * 3000),
]
SCHEMA = "doc_id long, text string, source string, id string, body string, node string, n int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if k % 4 == 3 else f"s{k % 3}", "clash", "clash", "clash", k) for k, (i, t) in enumerate(ROWS)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("bits", [256, 4])
def test_exact(docs, none, bits):
    got = sorted((r.id or 0, r.keep_id or 0, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, digest_bits=bits).collect())
    groups = {}
    for i, t in ROWS:
        groups.setdefault(low(t), []).append(i)
    want = sorted((i or 0, max((x or 0) for x in groups[low(t)]), len(groups[low(t)]), (i or 0) == max((x or 0) for x in groups[low(t)]), hashlib.sha256(low(t)).hexdigest()) for i, t in ROWS)
    assert [g[:2] + g[2:3] + g[4:] for g in got] == [w[:2] + w[2:3] + w[4:] for w in want]
    assert [g[3] for g in got if g[0]] == [w[3] for w in want if w[0]]
    assert exact_dedup.exact_groups(none).count() == 0


def test_drop_copies(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(low(r.text) for r in kept.collect()) == sorted({low(t) for _, t in ROWS})


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS) and mixing.mix_sources(none).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(r.size for r in rows)
    assert abs(sum(rs[0].target for rs in by.values()) - total) < 1e-6
    for rs in by.values():
        assert sum(r.taken for r in rs) == round(rs[0].target) or abs(sum(r.taken for r in rs) - rs[0].target) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(2)).collect()))
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in ROWS)
    assert bpe.token_digests(none, path, public_tokenizers.PATTERN).count() == 0


def _sets(n):
    return [(i, minhash.shingles(minhash.words_of(t), n)) for i, t in ROWS if i is not None]


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, none, n):
    sets = _sets(n)
    root = {i: i for i, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = minhash.near_duplicate_groups(docs, n=n).collect()
    assert sorted((r.id, r.component_id) for r in got if r.id is not None) == sorted((i, root[i]) for i, _ in sets)
    assert sorted(r.n_shingles for r in got) == sorted(len(minhash.shingles(minhash.words_of(t), n)) for _, t in ROWS)
    assert minhash.near_duplicate_groups(none).count() == 0


def test_near_group_without_a_centre(spark):
    """A chain of versions: each is close to the next only, and all are one component."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[25 * k : 25 * k + 300]) for k in range(5)]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicate_groups(df, n=2).collect()} == {1}


@pytest.mark.parametrize("cells", [400, 1])
def test_repeats(docs, none, cells, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP_CELLS", cells)
    texts = [(t or "").encode() for _, t in ROWS]
    n = {}
    for t in texts:
        for k in range(len(t) - 399):
            n[t[k : k + 400]] = n.get(t[k : k + 400], 0) + 1
    want = []
    for t in texts:
        cover = bytearray(len(t))
        for k in range(len(t) - 399):
            if n[t[k : k + 400]] > 1:
                cover[k : k + 400] = b"\x01" * 400
        spans = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        want.append((len(t), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(t, cover) if not c)).hexdigest()))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_spans(docs).collect()) == sorted(want)
    if cells == 400:
        assert suffix.repeated_spans(none).count() == 0


def test_passages(docs, none):
    got = {r.id: r for r in chaining.document_passages(docs).collect()}
    assert {i for i, r in got.items() if r.n_passages} >= {1, 2, 3, 11, 12} and got[4].n_passages == got[6].n_passages == 0
    assert got[12].class_id == 11 and got[3].class_id == 1 and got[12].n_words >= 85
    assert chaining.document_passages(none).count() == 0


def _text(r, n, vocabulary=3000):
    return [f"v{r.randrange(vocabulary)}" for _ in range(n)]


def _spans(spark, texts):
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = {x.id: x for x in chaining.document_passages(df).collect()}
    return rows, {k: {w for s in x.spans or () for w in range(s.lo, s.hi)} for k, x in rows.items()}


def test_passage_of_lines_that_also_occur_alone(spark):
    """Each line of the passage is alone in many documents, so every seed in it has a reference elsewhere, at both ends of the order."""
    r = random.Random(5)
    lines = [_text(r, 6) for _ in range(10)]
    texts = [sum(lines, []), sum(lines, [])]
    for k in range(9):  # each seam of two lines, too, is in other documents
        texts += [_text(r, 30) + lines[k] + lines[k + 1] + _text(r, 30) for _ in range(12)]
    rows, _ = _spans(spark, texts)
    assert rows[0].n_words == rows[1].n_words == 60 and rows[0].class_id == rows[1].class_id == 0
    assert all(rows[k].n_passages == 0 for k in rows if k > 1)


def test_passages_around_an_insertion(spark):
    r = random.Random(6)
    a, b = _text(r, 200), _text(r, 200)
    rows, spans = _spans(spark, [a + b, a + _text(r, 150) + b])
    assert rows[0].n_words >= 398 and spans[1] >= {*range(200), *range(350, 550)}
    assert chaining._common([b"a"] * 300, [b"a", b"b"] * 200) == 200


def test_passages_whose_seeds_all_refer_elsewhere(spark):
    """A line that very many say: of all that say it, two say what is around it alike, but for every fifth word, so that they share no other seed."""
    line = " ".join(f"line{k}" for k in range(25))

    def text(doc: int, alike: bool) -> str:
        said = lambda side, own: " ".join(f"{side}{k}" if alike and k % 5 != own else f"own{doc}{side}{k}" for k in range(15))
        return f"{' '.join(f'start{doc}x{k}' for k in range(30))} {said('left', 4)} {line} {said('right', 0)} {' '.join(f'end{doc}x{k}' for k in range(30))}"

    rows = [(d, text(d, d in (7, 31))) for d in range(60)]
    got = {r.id: r for r in chaining.document_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[d].class_id, got[d].n_links) for d in (7, 31)] == [(7, 1), (7, 1)] and sum(r.n_links for r in got.values()) == 2


@pytest.mark.parametrize("every", [6, 8, 10, 15])
def test_fuzzy_passages(spark, every):
    """Passages of 60 to 100 words with every n-th word changed."""
    r = random.Random(every)
    texts = []
    for _ in range(30):
        p = _text(r, r.randint(60, 100))
        texts += [_text(r, 40) + p + _text(r, 40), _text(r, 20) + [f"changed{r.random()}" if k % every == every - 1 else w for k, w in enumerate(p)] + _text(r, 20)]
    rows, _ = _spans(spark, texts)
    assert all(rows[k].class_id == k - k % 2 and rows[k].n_words >= 50 for k in rows)


def test_second_copy_in_a_document(spark):
    r = random.Random(7)
    p = _text(r, 60)
    for texts in ([p + _text(r, 60) + p, p], [p, p[:5] + _text(r, 60) + p + _text(r, 60) + p]):
        rows, spans = _spans(spark, texts)
        long = max(rows, key=lambda k: len(texts[k]))
        assert spans[long] >= {w for w in range(len(texts[long])) if any(texts[long][s : s + 60] == p for s in range(max(0, w - 59), w + 1))}


def test_packing_gives_every_id_back(docs, none):
    rows = packing.pack_documents(docs, row=64).collect()
    pieces = {}
    for r in rows:
        data = __import__("numpy").frombuffer(r.input_ids, dtype="<u2")
        assert len(data) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.position_resets == r.cu_seqlens[:-1]
        for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces.setdefault(d, []).append((o, (data[a:b] - packing.FIRST_BYTE).astype("uint8").tobytes()))
    for i, t in ROWS:
        if i not in (4, None) and t:
            assert b"".join(x for _, x in sorted(pieces[i])) == t.encode()
    assert packing.pack_documents(none).count() == 0


def test_packed_query_writes_token_ids(spark, docs, tmp_path):
    from stratascene.llm.queries import op5_token_packing

    np = __import__("numpy")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.ByteBpe(path, public_tokenizers.PATTERN)
    packing.write_packs(packing.pack_documents(docs, row=64, encode=packing.bpe_ids(path, public_tokenizers.PATTERN)), str(tmp_path / "out"))
    pieces = {}
    for r in packing.read_packs(spark, str(tmp_path / "out")).collect():
        data = np.frombuffer(r.input_ids, dtype="<u2")
        assert len(data) == 64 and r.position_resets == r.cu_seqlens[:-1] and not data[r.n_tokens :].any()
        for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces.setdefault(d, []).append((o, data[a:b].astype("<u4").tobytes()))
    for i, t in ROWS:
        if i not in (4, None) and t:
            assert b"".join(x for _, x in sorted(pieces[i])) == own.encode(t)
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = op5_token_packing(spark, str(tmp_path)).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(own.encode(t or "")) // 4 for _, t in ROWS)
    assert all(r.position_resets == r.cu_seqlens[:-1] for r in rows)


def test_warc(spark, tmp_path):
    """Every record comes back byte for byte, with line ends in and at the ends of payloads, nulls, repeated rows and a very long one."""
    long = "".join(chr(97 + k % 26) + "\r\n" * (k % 5) for k in range(300_000))
    pages = [(1, "http://a", LONG), (2, "http://b\r\nX: y", LONG), (3, None, "tiny\r\n\r\n"), (4, "u", "tiny\r\n\r\n"), (5, "u", None), (6, "u", ""), (7, "é", "ä" * 600), (8, "u", "abc\r\n"), (9, "u", "\r\n\r\r\n\r\n\r"), (9, "u", long), (9, "u", long), (10, "u", "\n" + long), (None, "u", LONG), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (2, "http://b\r\nX: y", LONG)]
    df = spark.createDataFrame([(*p, "clash", "clash", "clash") for p in pages], "page_id long, url string, html string, digest string, payload string, keeper string")
    got = warc.archive_digests(df).collect()
    assert len(got) == len(pages)
    keeper = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 1000:
            keeper[h] = max(i, keeper.get(h, 0))
    want = [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *(("response", None) if keeper.get(h, i) == i else ("revisit", keeper[h]))) for i, _, h in pages]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    warc.write_archive(df.repartition(2), str(tmp_path))
    headers, payloads = warc.store(warc.read_archive(spark, str(tmp_path)), str(tmp_path))
    again = [(r.page_id, bytes(r.payload).decode()) for r in warc.reconstruct(headers, payloads).collect()]
    assert sorted(map(str, again)) == sorted(str((i, h or "")) for i, _, h in pages)
    assert payloads.count() == len({h or "" for _, _, h in pages})
    assert all(bytes(r.header).startswith(b"WARC/1.1\r\nWARC-Type: ") for r in headers.collect())
    assert warc.archive_digests(df.where("false")).count() == 0


def test_warc_compares_bytes_of_equal_digests(spark, tmp_path, monkeypatch):
    F = __import__("pyspark.sql.functions", fromlist=["x"])
    df = spark.createDataFrame([(1, "u", "a" * 2000), (2, "u", "b" * 2000)], "page_id long, url string, html string")
    monkeypatch.setattr(F, "sha2", lambda *_: F.lit("same"))  # as if the two collided
    with pytest.raises(ValueError, match="different payloads"):
        warc.write_archive(df, str(tmp_path))


def test_merkle(docs, none):
    got = merkle.fingerprints(docs).collect()
    assert len(got) == len(ROWS) and merkle.fingerprints(none).count() == 0
    prints = {}
    for r in got:
        prints.setdefault(r.fingerprint, set()).add(r.n_chars)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(prints) == len({t or "" for _, t in ROWS})
    order = sorted((t for t in ROWS if t[0] is not None), key=lambda x: (x[0], x[1] or ""), reverse=True) + [x for x in ROWS if x[0] is None]
    want = []
    for k, (_, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        want.append(hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in got) == sorted(want)


def test_slices_of_a_long_order(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SLICE_ROWS", 7)
    df = spark.range(100).select((__import__("pyspark.sql.functions", fromlist=["x"]).col("id") * 3).alias("id")).selectExpr("id", "concat('t', id) AS body")
    got = {r.id: r.next_body for r in merkle.with_next(df, ["body"]).collect()}
    assert got == {3 * k: f"t{3 * ((k - 1) % 100)}" for k in range(100)}


def test_toxicity(spark, docs, none):
    r = random.Random(13)
    texts = [(k, " ".join(r.choice(WORDS) for _ in range(60)) + (" vile nasty rot" if k % 4 == 0 else "")) for k in range(400)]
    df = spark.createDataFrame([*texts, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, labels)
    rows = toxicity.score_toxicity(df, model).collect()
    assert len(rows) == 402 and all(0 <= x.score <= 1 for x in rows)
    assert sum(x.predicted == int(x.id % 4 == 0) for x in rows if x.id < 400) >= 392
    assert toxicity.score_toxicity(none, model).count() == 0
    empty = toxicity.fit_toxicity(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, empty).count() == len(ROWS)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, gone string, __id string, __size int, __n int, key string, copies string, sha string, id string, body string"


def _clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "g", "i", 1, 2, "k", "c", "s", "x", "b") for i, t, s in rows], CLASH)


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty and repeated rows, ties, an empty table, and columns whose names clash with those of the operators."""
    rows = [(1, LONG, "a"), (1, LONG, "a"), (2, LONG + " x", None), (3, None, "b"), (4, "", None), (None, "no id here", "b"), (None, None, None), (5, "short", "a"), (6, "SHORT", "a")]
    docs = _clashing(spark, rows)
    none = docs.where("false")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int"))
    stages = [lambda d: toxicity.drop_toxic(d, model), exact_dedup.drop_copies, minhash.drop_near_duplicates, mixing.mixed_documents]
    for stage in stages:
        got = stage(docs)
        assert got.columns == docs.columns and got.schema == docs.schema
        assert {r.text for r in got.collect()} <= {t for _, t, _ in rows}
        assert stage(none).count() == 0
    assert sorted(map(str, ((r.doc_id, r.text) for r in stages[0](docs).collect()))) == sorted(map(str, ((i, t) for i, t, _ in rows)))
    assert sorted(map(str, ((r.doc_id, low(r.text)) for r in stages[1](docs).collect()))) == sorted(map(str, [(1, low(LONG)), (2, low(LONG + " x")), (4, b""), (None, b"no id here"), (6, b"short")]))
    assert sorted(map(str, (r.doc_id for r in stages[2](docs).collect()))) == sorted(map(str, [1, 1, 3, 4, None, None, 5]))


def _mixed_by_hand(rows, weights=(1, 2, 3)):
    """How often each (id, source, size) is in the mix."""
    import re
    from fractions import Fraction

    sized = [(i, s, len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))) for i, t, s in rows]
    total = {}
    for _, s, n in sized:
        total[s] = total.get(s, 0) + n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        level = Fraction(rest, sum(w[s] for s in names if s not in full)) if len(full) < len(names) else 0
        over = {s for s in names if s not in full and level * w[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    for s in names:
        target[s] = 3 * total[s] if s in full else level * w[s]
    out = {}
    for s in names:
        at, budget = 0, round(float(target[s]))
        epochs, left = divmod(budget, total[s]) if total[s] else (0, 0)
        for i, _, n in sorted((x for x in sized if x[1] == s), key=lambda x: (hashlib.md5(f"mix:{x[0]}".encode()).hexdigest(), x[0], x[2])):
            taken = epochs * n + min(max(left - at, 0), n)
            at += n
            if n:
                out[i] = (2 * taken + n) // (2 * n)
    return {i: c for i, c in out.items() if c}


def test_pipeline_by_hand(spark, tmp_path):
    """All stages against plain Python: planted toxic documents, exact and near copies, and the mix."""
    import corpus_pipeline

    r = random.Random(23)
    texts = [" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(400)]
    rows = [(k, t + (" vile nasty rot foul vile nasty rot" if k % 5 == 0 else ""), None if k % 7 == 0 else f"s{k % 4}") for k, t in enumerate(texts)]
    rows += [(400 + k, rows[k][1].upper(), "s1") for k in range(1, 30, 3)] + [(500 + k, rows[k][1] + " extra", "s2") for k in range(31, 60, 3)] + [(600, None, "s0"), (601, "", None)]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    bad = {i for i, t, _ in rows if "vile" in (t or "").lower()}
    spark.createDataFrame([(i, int(i in bad)) for i, _, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [x for x in rows if x[0] not in bad]
    last = {}
    for i, t, _ in kept:
        last[low(t)] = max(i, last.get(low(t), -1))
    kept = [x for x in kept if last[low(x[1])] == x[0]]
    sets = [(i, minhash.shingles(minhash.words_of(t), 5)) for i, t, _ in kept]
    root = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    want = _mixed_by_hand([x for x in kept if root[x[0]] == x[0]])
    got = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + 1
        assert x.ids_sha256 and x.decoded_sha256 == hashlib.sha256((dict((i, t) for i, t, _ in rows)[x.doc_id] or "").encode()).hexdigest()
    assert got == want and len(corpus_pipeline.STAGES) == 5


def test_very_long_texts(spark):
    """Longer than the blocks that texts are worked through in."""
    r = random.Random(29)
    long = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(60_000))
    assert len(long) > suffix.BLOCK + 1000 and len(long) > bpe.SPAN + 1000
    rows = [(1, long), (2, "head " + long[suffix.BLOCK - 700 : suffix.BLOCK + 700] + " tail"), (3, long + " more"), (4, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.id: x for x in suffix.repeated_spans(df).collect()}
    assert got[1].n_removed == len(long) and got[3].n_removed == len(long) and got[3].n_spans == 1 and got[4].n_removed == 0
    assert [(s.start, s.end) for s in got[2].spans] == [(5 - (long[suffix.BLOCK - 701] == " "), 1405 + (long[suffix.BLOCK + 700] == " "))]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = __import__("tiktoken").Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    n = {x.id: x for x in bpe.token_digests(df, path, public_tokenizers.PATTERN).collect()}
    assert n[1].n_tokens == len(own.encode_ordinary(long)) and n[1].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    near = {x.id: x.component_id for x in minhash.near_duplicate_groups(df, n=2).collect()}
    assert near == {1: 1, 2: 2, 3: 1, 4: 4}
    fp = {x.id: x for x in merkle.fingerprints(df).collect()}
    assert len({x.fingerprint for x in fp.values()}) == 4


def test_packing_hands_pieces_on(docs):
    """Windows of a few ids: rows that are far from full go on to the next window, and no id is lost."""
    rows = packing.pack_documents(docs.coalesce(1), row=64, window=200).collect()
    assert sum(x.n_tokens for x in rows) == sum(len((t or "").encode()) for _, t in ROWS)
    assert sum(x.n_tokens < 40 for x in rows) <= 3


def test_differing_branches(spark):
    F = __import__("pyspark.sql.functions", fromlist=["x"])
    text = "one\ntwo\n\nthree\nfour\nfive"
    pairs = [(text, text, []), (text, text.replace("four", "4"), [(1, 1)]), (text, text + "\n\nsix", [(2, 0)]), (text, "one\n" + text.partition("\n\n")[2], [(0, 1), (0, 2), (0, 0), (1, 0), (1, 1), (1, 2)]), ("", "a", [(0, 0)]), (text, text.replace("two", "two" + "x" * 5000), [(0, 1)])]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "k int, a string, b string").select("k", merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    got = {x.k: [(d.section, d.paragraph) for d in x.d] for x in df.select("k", merkle.differing_branches(F.col("a"), F.col("b")).alias("d")).collect()}
    for k, (_, _, want) in enumerate(pairs):
        assert sorted(got[k]) == sorted(want) or k == 3 and got[k], (k, got[k])


def test_one_identifier_several_texts(spark):
    one = " ".join(R.choice(WORDS) for _ in range(200))
    other = " ".join(R.choice(WORDS) for _ in range(200))
    rows = [(1, one), (2, one + " more"), (2, other), (3, "x y z x y z q"), (None, one + " and"), (None, other[:-1] + "q"), (5, other + " more"), (6, ""), (6, other + " too")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.id, r.component_id) for r in minhash.near_duplicate_groups(table).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 2), (3, 3), (None, 1), (None, 2), (5, 2), (6, 6), (6, 2)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in minhash.drop_near_duplicates(table).collect()), key=str)
    assert kept == sorted([rows[k] for k in (0, 2, 3, 4, 5, 7)], key=str)


def test_packed_ids_of_any_width(spark):
    table = spark.createDataFrame([(1, "aaaa"), (2, "b")], "doc_id long, text string").coalesce(1)

    def mixed(text):
        import numpy as np

        return np.array([1, 2, 3, 4], dtype="<u2") if text == "aaaa" else np.array([70000], dtype="<u4")

    rows = packing.pack_documents(table, row=8, encode=mixed, id_bytes=4).collect()
    import numpy as np

    assert [np.frombuffer(r.input_ids, dtype="<u4").tolist() for r in rows] == [[1, 2, 3, 4, 70000, 0, 0, 0]]
    with pytest.raises(Exception, match="don't fit"):
        packing.pack_documents(table, row=8, encode=mixed).collect()
