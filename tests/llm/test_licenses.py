"""License scans against every block held against every template."""

import random
import re

import pytest

from stratascene.llm import licenses
from stratascene.llm.licenses import Template

R = random.Random(9)
SCHEMA = "doc_id long, text string, id string, label string, row string, blocks string, words string"
MIT = licenses.TEMPLATES[3].text


def _words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def _by_hand(rows, templates, percent=80):
    stride = max(32, *(len(_words(t.text)) for t in templates))
    out = []
    for i, text in rows:
        w = _words(text)
        places, base, every, share = [], set(), set(), 0.0
        for t in templates:
            tw = _words(t.text)
            if t.exact:
                at = [k for k in range(len(w)) if w[k : k + len(tw)] == tw]
                places += at
                if at:
                    base.add(t.label)
                    every.add(t.label)
            else:
                for k in range(0, len(w), stride):
                    common = len({*w[k : k + 2 * stride]} & {*tw})
                    if 100 * common >= percent * len({*tw}):
                        every.add(t.label)
                        share = max(share, common / len({*tw}))
        out.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(every)), 1.0 if places else share))
    return sorted(out, key=str)


def _found(table, **more):
    return sorted((tuple(r)[:8] for r in licenses.scan_licenses(table, **more).collect()), key=str)


def _table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA).repartition(3)


def test_scan(spark):
    fill = lambda n: " ".join(R.choice(["mit", "license", "the", "of", "general", "Public", "software", "zeit", "ça", "x"]) for _ in range(n))
    worn = [" ".join(w if R.random() > lost else "gone" for w in MIT.split()) for lost in (0.05, 0.15, 0.3) for _ in range(4)]
    rows = [(k, f"{fill(R.randrange(90))} {x}\n{fill(R.randrange(90))}") for k, x in enumerate(worn)]
    rows += [(100 + k, f"{'pad ' * k}the MIT\tLicense, or GNU General\nPublic -- License {'pad ' * (70 - k)} apache license") for k in range(50, 70)]  # over the ends of blocks
    rows += [(None, "MIT license"), (None, None), (7, ""), (7, "MIT license MIT license"), (7, "MIT license MIT license"), (8, "permit license mit licenses mit-license"), (9, "É MIT LICENSÉ mit license\x00é"), (10, f"{fill(60_000)} {MIT} {fill(60_000)}")]
    got = _found(_table(spark, rows))
    assert got == _by_hand(rows, licenses.TEMPLATES)
    assert {r[6] for r in got} >= {"mit", "", "apache,gpl,mit"}


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_filters_lose_nothing(spark, percent):
    vocabulary = [f"w{k}" for k in range(40)]
    rare = [R.random() ** 3 for _ in vocabulary]
    text = lambda n: " ".join(R.choices(vocabulary, rare, k=n))
    rows = [(k, text(R.choice([0, 3, 20, 64, 65, 300]))) for k in range(80)]
    templates = [Template(f"t{k}", text(R.randint(1, 45)), k % 3 == 0 and k < 6) for k in range(14)] + [Template("two", "w1 w2", True), Template("absent", "nowhere w1 w2 w3")]
    got = _found(_table(spark, rows), templates=templates, percent=percent)
    assert got == _by_hand(rows, templates, percent) and any(r[6] for r in got)


def test_matches_and_odd_tables(spark):
    none = _table(spark, [])
    assert licenses.scan_licenses(none).count() == 0
    row = licenses.scan_licenses(_table(spark, [(1, "a " * 40 + "mit license " + MIT)])).first()
    assert [(m.start, m.label, m.places) for m in row.matches if m.exact] == [(32, "mit", [40])]
    assert {(m.start, m.label) for m in row.matches if not m.exact} >= {(32, "mit")}
    assert all(m.containment >= 0.8 for m in row.matches) and row.n_base == 1
    with pytest.raises(ValueError):
        licenses.scan_licenses(none, [Template("empty", "--")])
