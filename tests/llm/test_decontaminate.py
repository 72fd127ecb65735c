import hashlib
import random
import re

import pytest

from panelwright.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            q = words(t)
            k = min(len(q), window)
            for piece in {tuple(q[i : i + k]) for i in range(max(1, len(q) - window + 1))} if q else ():
                for i in range(len(w) - k + 1):
                    if tuple(w[i : i + k]) == piece:
                        hit |= set(range(i, i + k))
                        found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    r = random.Random(seed)
    make = lambda n: [r.choice(["the", "Of", "and", "Été", "x9", "ΑΣ", "ΑΣ'α", "İ", "K", "to"]) for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate([10, 11, 30, 9, 3, 1, 10, 25])] + [(8, None), (9, "--"), (10, ""), (None, "nul item of four"), (11, "Qq one two three four five six seven eight nine ten")]
    docs = []
    for i in range(60):
        w = make(r.randrange(0, 80))
        q = (items[r.choice([0, 1, 2, 3, 4, 6, 7, 12])][1] or "").split()
        a = r.randrange(len(q) + 1)
        at = r.randrange(len(w) + 1)
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w[:at] + q[a : a + r.choice([5, 10, 12, 40])] + w[at:]).swapcase()))
    docs += [(100, None), (101, ""), (102, "!!"), (None, items[12][1]), (103, items[2][1]), (103, items[2][1]), (103, "other text"), (104, "nul item OF four"), (105, " ".join(make(3000)))]
    d = spark.createDataFrame([(*x, "th", 1) for x in docs], "doc_id long, text string, th string, n int").repartition(4)
    b = spark.createDataFrame([(*x, "w") for x in items], "item_id long, text string, w string")
    got = sorted(map(tuple, contamination(d, b).collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in contamination(d, b).collect()] == [(1, 3, 0, 0)]
    assert contamination(d.limit(0), d.toDF("item_id", "text")).count() == 0
