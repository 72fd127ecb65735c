import math
import random
import re
from collections import Counter

import pytest

from panelwright.llm import lm_score as L


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute(rows, targets, mu=L.MU):
    """The same models in plain dictionaries: of each row (id, text), the losses under models of all other rows."""
    docs = [(i, words(t)) for i, t in rows]
    vocabulary = len({w for _, d in docs for w in d})
    pairs, single = [Counter(), Counter()], [Counter(), Counter()]
    for i, d in docs:
        for j in (0, 1) if i in targets else (1,):
            pairs[j].update(zip([None, *d], d))
            single[j].update([None, *d] if d else [])
    total = [sum(n for w, n in c.items() if w is not None) for c in single]
    out = []
    for i, d in docs:
        own, mine = Counter(zip([None, *d], d)), Counter([None, *d])
        losses = []
        for j, k in enumerate((1.0, total[0] / max(total[1], 1))):
            off = j == 1 or i in targets
            def prob(a, b, j=j, k=k, off=off):
                share = (k * (single[j][b] - off * mine[b]) + 1) / (k * (total[j] - off * len(d)) + vocabulary)
                return (k * (pairs[j][a, b] - off * own[a, b]) + mu * share) / (k * (single[j][a] - off * mine[a]) + mu)
            losses.append(-sum(math.log(prob(*p)) for p in zip([None, *d], d)) / len(d) if d else None)
        out.append((i, len(d), *losses, losses[1] - losses[0] if d else None))
    return out


def rows_of(n=60):
    r = random.Random(n)
    good, other = ["the", "Cat", "sat", "on", "mats", "élan"], ["buy", "now", "the", "cheap", "on", "x1"]
    rows = [(i, r.choice([" ", ", ", ".\n"]).join(r.choice(good if i % 3 else other) for _ in range(r.randrange(30)))) for i in range(n)]
    return [*rows, (100, None), (101, ""), (102, "?!"), (103, "the cat " * 4000), (7, "the cat sat twice"), (7, "the cat sat twice"), (None, "no id sat")]


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert len(got) == len(want)
    key = lambda x: (str(x[0]), x[1], x[2] is None, round(x[2] or 0, 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9), (a, b)


@pytest.mark.parametrize(("group", "most", "flush", "kind"), [(4096, 1 << 26, 10**6, "long"), (8, 300, 50, "long"), (8, 300, 50, "string")])
def test_matches_brute_force(spark, monkeypatch, group, most, flush, kind):
    """In one group, in many that are split and sent piece by piece, and with ids that are no numbers."""
    for name, value in (("GROUP", group), ("GROUP_BYTES", most), ("FLUSH", flush)):
        monkeypatch.setattr(L, name, value)
    rows = rows_of()
    name = (lambda i: i if i is None or kind == "long" else f"n{i}")
    rows = [(name(i), t) for i, t in rows]
    targets = {name(i) for i in range(60) if i % 3 and i % 2} | {name(100), name(999)}
    docs = spark.createDataFrame([(*x, "w", 1.0, 5) for x in rows], f"doc_id {kind}, text string, part string, score double, target int").repartition(3)
    marks = spark.createDataFrame([(i,) for i in [*targets, *targets, None]], f"doc_id {kind}")
    got = [tuple(x) for x in L.cross_entropy_difference(docs, marks).collect()]
    same(got, brute(rows, targets))
    if kind == "long":
        mean = lambda k: sum(x[4] for x in got if x[0] is not None and x[0] < 60 and x[0] != 7 and bool(x[0] % 3) == k and x[1]) / 20
        assert mean(True) > 0 > mean(False)


def test_no_pair_is_left_out(spark):
    """200,000 distinct pairs, most of them in one document only: every one counts, however rare."""
    rows = [(i, " ".join(f"w{(i * 7919 + j * j) % 50021}" for j in range(200))) for i in range(1000)] + [(5000 + i, " ".join(f"w{(i * 7919 + j * j) % 50021}" for j in range(200))) for i in range(0, 1000, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    targets = set(range(0, 1000, 3))
    got = [tuple(x) for x in L.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in targets], "doc_id long")).collect()]
    want = brute(rows, targets)
    same(got, want)
    assert len({p for _, t in rows for p in zip(t.split(), t.split()[1:])}) > 150_000


def test_without_targets_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b a"), (None, "a b"), (1, "a b a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert [round(r["score"], 9) for r in L.cross_entropy_difference(docs, none).collect()] == [0, 0, 0]
    assert L.cross_entropy_difference(docs.limit(0), none).count() == 0
    a = sorted(map(str, L.cross_entropy_difference(docs.repartition(1), docs).collect()))
    assert a == sorted(map(str, L.cross_entropy_difference(docs.repartition(3), docs).collect()))
