"""Single-machine kernels against plain Python."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from stratascene.llm import bpe, chaining, minhash, packing, suffix, toxicity


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_equals_tiktoken(codec):
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(1)
    texts = ["", " ", "don't\n\n  stop", "a" * 3000, "日本語" * 50, "<|endoftext|>", "\x00\x1c a\x85b\xa0", *sorted(codec.newer)[:50]]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x3000), r.randrange(0x4E00, 0xA000), r.randrange(0x10000, 0x40000)])) for _ in range(30)) for _ in range(500)]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, dtype="<u4").tolist() == other.encode_ordinary(t), t
        assert codec.decode(ids) == t.encode()


def test_repeated_starts_against_counting():
    r = random.Random(3)
    for _ in range(150):
        w = r.choice([3, 5, 8])
        base = bytes(r.choice(b"ab") for _ in range(12))
        cells = [c for _ in range(r.randint(1, 5)) if len(c := bytes(r.choice(b"abc") for _ in range(r.randint(0, 6))) + base[r.randint(0, 4) :]) >= w]
        if cells:
            n = Counter(c[i : i + w] for c in cells for i in range(len(c) - w + 1))
            assert [x.tolist() for x in suffix.repeated_starts(cells, w)] == [[n[c[i : i + w]] > 1 for i in range(len(c) - w + 1)] for c in cells]


def test_cells_cover_every_window_once():
    r = random.Random(4)
    data = bytes(r.choice(b"abcd ") for _ in range(3000)) + b"x" * 900
    starts, counts, offsets, _ = suffix.anchor_cells(data)
    assert np.concatenate([np.arange(s, s + n) for s, n in zip(starts, counts)]).tolist() == list(range(len(data) - suffix.WINDOW + 1))
    assert (offsets >= 0).all() and (offsets <= suffix.WINDOW - suffix.ANCHOR).all()


def test_best_fit_decreasing_against_search():
    r = random.Random(2)
    for _ in range(200):
        row = r.choice([1, 2, 7, 16, 33])
        sizes = [r.randint(1, row) for _ in range(r.randint(0, 60))]
        free: list[int] = []
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fits = [f for f in free if f >= sizes[k]]
            if fits:
                free.remove(min(fits))
            free.append((min(fits) if fits else row) - sizes[k])
        got = packing.best_fit_decreasing(sizes, row)
        assert sorted(row - sum(sizes[k] for k in g) for g in got) == sorted(free)
        assert sorted(k for g in got for k in g) == list(range(len(sizes)))


def test_maximal_segments_against_definition():
    r = random.Random(5)

    def brute(s):
        if not any(x > 0 for x in s):
            return []
        total = np.concatenate(([0], np.cumsum(s)))
        best = max((round(total[j] - total[i], 9), -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
        i, j = best[3:]
        return sorted([*brute(s[:i]), (i, j), *((a + j, b + j) for a, b in brute(s[j:]))])

    for _ in range(200):
        s = np.array([r.randint(-30, 20) + r.random() for _ in range(r.randint(0, 14))])
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == brute(s)


def test_sketches_fill_and_agree_as_often_as_sets_do():
    r = np.random.default_rng(6)
    for size in (1, 3, 40, 2000):
        common = r.integers(0, 1 << 63, size=size, dtype=np.int64).astype(np.uint64)
        extra = r.integers(0, 1 << 63, size=max(1, size // 4), dtype=np.int64).astype(np.uint64)
        a, b = minhash.sketches([np.unique(common), np.unique(np.concatenate([common, extra]))])
        assert (a != 0).all() and (b != 0).all()
        assert abs((a == b).mean() - size / (size + len(extra))) < 0.15
    same = minhash.sketches([np.arange(1, 9, dtype=np.uint64)] * 2)
    assert (same[0] == same[1]).all()


def test_chains_against_search():
    r = random.Random(7)
    for _ in range(100):
        pairs = sorted({(r.randint(0, 30), r.randint(0, 30)) for _ in range(r.randint(1, 9))})

        def best(k, memo={}):  # noqa: B006
            d, x = pairs[k]
            return chaining.SEED + max([0.0, *(best(j) - chaining.GAP * (d - pairs[j][0] + x - pairs[j][1]) for j in range(len(pairs)) if pairs[j][0] < d and pairs[j][1] < x)])

        def score(chain):
            return chaining.SEED * len(chain) - sum(chaining.GAP * (c[0] - a[0] + c[1] - a[1]) for a, c in zip(chain, chain[1:]))

        got = chaining.chains(pairs)
        assert abs(score(got[0]) - max(best(k) for k in range(len(pairs)))) < 1e-9
        assert sorted(p for c in got for p in c) == pairs


def test_extreme_value_rate():
    """No end was in sight where every positive score belonged to tokens without weight."""
    assert toxicity.extreme_value_rate([(2.0, 0), (-0.5, 10)]) == 1.0
    assert toxicity.extreme_value_rate([]) == toxicity.extreme_value_rate([(1.0, 5)]) == 1.0
    for hist in ([(2.0, 1), (-0.5, 10)], [(0.01, 1), (-0.5, 10_000_000)], [(30.0, 3), (1.0, 5), (-5.0, 900)]):
        rate = toxicity.extreme_value_rate(hist)
        n = sum(c for _, c in hist)
        assert abs(sum(c * np.exp(rate * s) for s, c in hist) / n - 1) < 1e-6


@pytest.mark.parametrize("n", [1, 2, 5])
def test_links_against_sets(n, monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    r = random.Random(n)
    base = [f"w{r.randrange(40)}" for _ in range(30)]
    texts = [" ".join(w if r.random() > 0.06 else "changed" for w in base[: r.choice([30, 29, 12, 3, 0])]) for _ in range(40)] + [None, ""]
    sets = [minhash.shingles(minhash.words_of(t), n) for t in texts]
    sets = [s if len(minhash.words_of(t)) >= n else set() for s, t in zip(sets, texts)]  # shorter texts are linked as equal sequences before
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                root = [root[i] if x == root[j] else x for x in root]
    found = list(range(len(texts)))
    for i, j in minhash.links(texts, list(range(len(texts))), n, 80):
        found = [found[i] if x == found[j] else x for x in found]
    same = lambda g: {frozenset(k for k, x in enumerate(g) if x == y) for y in g}
    assert same(found) == same(root)


def test_ascii_pretokens():
    import public_tokenizers

    codec = bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert codec.ascii is not codec.split
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice(" \t\n\r\x0b\x0c\x1c\x1f\x00ab'stvel12.,!_") for _ in range(r.randrange(30)))
        assert codec.ascii.findall(text) == codec.split.findall(text)
    words = [f"w{r.random()}" for _ in range(50)]
    for text in (" ".join(r.choices(words, k=300)), "x" * 500 + " " + "x" * 500, "a  b\n\n c"):  # new, known and long pre-tokens
        assert codec.decode(codec.encode(text)) == text.encode() == codec.decode(codec.encode(text))
    assert all(len(w) <= bpe.REMEMBERED for w in codec.known)


def test_fingerprints_hash_each_piece_once(spark):
    """A part that several others are made of is written once in the expression, so that it isn't computed for each of them."""
    from stratascene.llm import merkle

    plan = spark.createDataFrame([(1, "a\n\nb")], "id long, body string").select(merkle.fingerprint(F.col("body")).alias("made"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_codec_gives_back_what_building_it_took(monkeypatch):
    import public_tokenizers

    from stratascene.llm import bpe

    calls = []
    monkeypatch.setattr(bpe, "give_back", lambda: calls.append(1))
    bpe.codec.cache_clear()
    bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert calls
