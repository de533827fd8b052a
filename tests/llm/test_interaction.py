"""The audit of filters against every order applied by hand."""

import itertools
import random

from pyspark.sql import functions as F

from stratascene.llm import interaction

R = random.Random(5)
SCHEMA = "doc_id long, text string, lang string, mask int, n int, words string, part string, good string, ID string"
LABELS = "doc_id long, quality int, toxic int, part string, good string"
WHITE = " \t\n\v\f\r"


def _text(k):
    if k % 7 == 0:
        return None if k % 2 else ""
    words = ["".join(R.choice("abcdeXYZ") for _ in range(R.randint(1, 6))) if R.random() < 0.7 else "same" for _ in range(R.choice([3, 99, 100, 130]))]
    if k % 5:
        words = [w.lower() for w in words]
    return R.choice([" ", "\n", "\x0b ", "\xa0 "]).join(words) + R.choice(["", "", "#", " a|b"])


def _rows():
    texts = [_text(k) for k in range(60)] + ["  ", "x" * 500_000, "É" * 50]
    rows = [(k if k % 11 else None, t, [None, "", "en", "de"][k % 4]) for k, t in enumerate(texts)]
    rows += [(900 + k, texts[R.randrange(12)], R.choice(["en", "de"])) for k in range(40)]  # copies
    return rows + rows[3:6] + [(-1, texts[2], "en"), (None, texts[2], "en")]


def _words(t):
    return [w for w in "".join(" " if c in WHITE else c for c in t).split(" ") if w]


def _fails(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = _words(t)
        tests = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), i is not None and least[t] < i]
        out.append({f for f, x in zip("ABCDE", tests) if x})
    return out


def _by_hand(rows, labels):
    quality, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    fails, out = _fails(rows), {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(f, i in quality and i is not None, i in toxic and i is not None) for f, (i, _, p) in zip(fails, rows) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(range(len(mine)))
            for k, c in enumerate(order):
                gone = [x for x in left if c in mine[x][0]]
                redundant = sum(c in f for f, _, _ in mine) - len(gone)
                left = [x for x in left if c not in mine[x][0]]
                shapley[c] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(f == {c} for f, _, _ in mine), sum(mine[x][1] for x in gone), sum(mine[x][2] for x in gone)]
        for (p, o, k), v in out.items():
            if p == part:
                v.append(shapley[o[k - 1]])
    return out


def test_audit(spark):
    rows = _rows()
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 70, 2)] + [(4, 1, None), (None, 1, 1), (905, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "w", "p", "g", "clash") for r in rows], SCHEMA.replace("ID", "other")).repartition(5)
    known = spark.createDataFrame([(*r, "p", "g") for r in labels], LABELS)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in interaction.audit_filters(docs, known).collect()}
    assert got == _by_hand(rows, labels)


def test_sums_give_cells_back(spark):
    docs = spark.createDataFrame([(*r, 1, 2, "w", "p", "g", "clash") for r in _rows()], SCHEMA.replace("ID", "other"))
    known = spark.createDataFrame([(900, 1, 1, "p", "g")], LABELS)
    failed = interaction.failed_filters(docs, known, interaction.failing_conditions())
    back = {(r.part, m): n for r in interaction.cell_counts(interaction.parity_sums(failed, 5)).collect() for m, n in enumerate(r["all"]) if n}
    assert back == {(r.part, r["mask"]): r.n for r in failed.groupBy("part", "mask").agg(F.sum("n").alias("n")).collect() if r.n}


def test_other_filters_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", "en"), (3, "a a a", "en")], "doc_id long, text string, lang string")
    none, labels = docs.limit(0), spark.createDataFrame([], LABELS)
    own = {"X": F.size("words") > 1, "Y": F.col("body").startswith("a")}
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in interaction.audit_filters(docs, labels, own).collect()} == {("XY", 1): (2, 1, 0, 0, 1), ("XY", 2): (1, 1, 1, 1, 3), ("YX", 1): (1, 2, 0, 1, 3), ("YX", 2): (1, 0, 1, 0, 1)}
    assert interaction.audit_filters(none, labels).count() == 0
