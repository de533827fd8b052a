"""Toxicity by hand, and the pipeline's stages on odd tables."""

import hashlib
import math
import random
import string
import zlib

import numpy as np

from stratascene.llm import toxicity

R = random.Random(31)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 6))) for _ in range(120)]
VILE = ["vile", "nasty", "foul", "rot"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, gone_hash string, label string"


def _tokens(text):
    return [w.strip(string.punctuation.encode()) for w in (text or "").encode().lower().split()]


def _segments(s):
    """All maximal scoring segments by their definition: the best, then those to its left and right."""
    def best(lo, hi):
        found = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += s[b]
                if total > 1e-12 and (found is None or total > found[0] + 1e-12):
                    found = total, a, b + 1
        return [] if found is None else [*best(lo, found[1]), found, *best(found[2], hi)]

    return best(0, len(s))


def _by_hand(rows, labels):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    train = {i: x for i, x in labels if i is not None and not held(i)}
    counts = {}
    for i, t, _ in rows:
        for w in {*_tokens(t)}:
            c = counts.setdefault(w, [0, 0, 0])
            c[0] += 1
            if i in train:
                c[1 + train[i]] += 1
    counts = {w: c for w, c in counts.items() if c[1] + c[2]}
    whole, clean, toxic = (sum(c[k] for c in counts.values()) for k in range(3))
    score = {}
    for w, (n, c, t) in counts.items():
        a = toxicity.PRIOR / whole * n + toxicity.EACH
        yt, yc = t + a, c + a
        delta = math.log(yt / (toxic + toxicity.PRIOR - yt)) - math.log(yc / (clean + toxicity.PRIOR - yc))
        score[w] = math.copysign(max(abs(delta) - toxicity.SHRINK * math.sqrt(1 / yt + 1 / yc), 0.0), delta)
    spread = {}
    for w, c in counts.items():
        x = round(score[w] - toxicity.DRIFT, 2)
        spread[x] = spread.get(x, 0) + c[1]
    rate = toxicity.extreme_value_rate([*spread.items()])

    def scan(text):
        ws = _tokens(text)
        s = [(score.get(w, 0.0) if k == 0 or ws[k - 1] != w else 0.0) - toxicity.DRIFT for k, w in enumerate(ws)]
        return len(s), _segments(s)

    scans = [scan(t) for _, t, _ in rows]
    seen = [rate * max((x for x, _, _ in segs), default=0.0) - math.log(n) for (i, _, _), (n, segs) in zip(rows, scans) if train.get(i) == 0 and n]
    log_k = sum(seen) / len(seen) - float(np.euler_gamma)
    features = []
    for n, segs in scans:
        over = [(rate * x - log_k - math.log(n), b - a) for x, a, b in segs if rate * x > log_k + math.log(n)]
        features.append([1.0, math.log1p(max((e for e, _ in over), default=0.0)), math.log1p(sum(e for e, _ in over)), sum(m for _, m in over) / max(n, 1)])
    own = [k for k, (i, _, _) in enumerate(rows) if i in train]
    w = toxicity.logistic_fit(np.array([features[k] for k in own]), np.array([float(train[rows[k][0]]) for k in own]))
    return [(i, 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(f, w)))))), sum(x > 0 for x in f[1:2])) for (i, _, _), f in zip(rows, features)]


def test_toxicity_by_hand(spark):
    rows = []
    for k in range(160):
        ws = [R.choice(WORDS) for _ in range(R.randint(5, 40))]
        if k % 4 == 0:
            at = R.randrange(len(ws))
            ws[at:at] = R.choices(VILE, k=R.randint(3, 8))
        elif k % 9 == 0:
            ws.append(R.choice(VILE))
        rows.append((k, " ".join(w.upper() if R.random() < 0.1 else f"({w})," if R.random() < 0.1 else w for w in ws), "s"))
    rows += [(None, "vile nasty foul rot vile nasty", "s"), (200, None, "s"), (201, "", None), (3, rows[3][1], "s"), (202, "rot " * 300 + "end", "s")]
    labels = [(k, int(k % 4 == 0)) for k in range(0, 150)] + [(None, 1)]
    table = spark.createDataFrame([(i, t, "en", s, 0, "g", "h", "l") for i, t, s in rows], SCHEMA).repartition(4)
    model = toxicity.fit_toxicity(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = sorted(((r.id, r.score, r.predicted) for r in toxicity.score_toxicity(table, model).collect()), key=str)
    want = sorted(((i, p, int(p >= 0.5)) for i, p, _ in _by_hand(rows, labels)), key=str)
    assert [(i, c) for i, _, c in got] == [(i, c) for i, _, c in want] and any(c for *_, c in got)
    assert all(abs(a[1] - b[1]) < 1e-6 for a, b in zip(got, want))


def test_pipeline_without_documents(spark, tmp_path):
    import corpus_pipeline

    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, str(tmp_path))
        assert got.count() == 0 and (name == "byte_bpe" or got.columns == none.columns)


def test_tokens_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "no id", None), (2, None, "s"), (3, "", "s"), (4, "x" * 300_000 + " é", "s")]
    docs = spark.createDataFrame([(i, t, None, s, None, "g", None, "l") for i, t, s in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect())
    assert [(i, d) for i, _, d in got] == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert all(n == 0 for i, n, _ in got if i in "23") and min(n for i, n, _ in got if i not in "23") > 0
