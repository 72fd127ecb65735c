import hashlib
import random

import pytest

from panelwright.llm import suffix_dedup as S


def brute(rows, span=50):
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        if i is not None:
            for p in range(len(b) - span + 1):
                w = b[p : p + span]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - span + 1):
                if first[b[p : p + span]] < i:
                    gone[p : p + span] = b"\x01" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdeé ßxyz日") for _ in range(k))
    shared = [text(r.choice([30, 49, 50, 51, 70, 200, 900])) for _ in range(8)] + ["ab" * 100, "=" * 300, "abc " * 40]
    rows = []
    for i in range(n):
        parts = [text(r.randrange(0, 150)) for _ in range(3)]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            a = r.randrange(0, 20)
            parts.insert(r.randrange(4), s[a : a + r.choice([40, 60, 1000])])
        rows.append((i * 7 % n, "".join(parts)))
        if r.random() < 0.1:
            rows.append((1000 + i, rows[-1][1]))
    return [*rows, (2000, None), (2001, ""), (2002, "x" * 49), (2003, "x" * 50), (2004, "x" * 50), (None, rows[0][1]), (5, "again " + rows[3][1]), (5, "again " + rows[3][1]), (2005, "lorem " * 5000 + "e"), (2006, "lorem " * 3000)]


@pytest.mark.parametrize(("seed", "hot", "bucket_bytes"), [(1, 20_000, S.BUCKET_BYTES), (2, 3, 1000), (3, 20_000, 300), (4, 1, S.BUCKET_BYTES)])
def test_matches_brute_force(spark, seed, hot, bucket_bytes):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*x, "t", 1) for x in rows], "doc_id long, text string, th string, kind int").repartition(5)
    got = sorted(map(tuple, S.repeated_passages(docs, hot_docs=hot, bucket_bytes=bucket_bytes).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_kept_text(spark):
    docs = spark.createDataFrame([(1, "a" * 20 + "0123456789" * 6), (2, "b" * 20 + "0123456789" * 6 + "c")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in S.repeated_passages(docs, keep_text=True).collect()}
    assert got == {1: b"a" * 20 + b"0123456789" * 6, 2: b"b" * 20 + b"c"}
    assert S.repeated_passages(docs.limit(0)).count() == 0


def test_hash_collisions_are_settled_by_bytes(monkeypatch):
    import numpy as np

    monkeypatch.setattr(S, "_window_hashes", lambda rows, span: np.zeros((len(rows), span - S.GRAM + 1), np.uint64))
    around = np.array([np.arange(80), np.arange(80) + 1, np.arange(80), np.arange(80) + 1], np.uint8)
    assert S._compare(around, np.array([[0, 2]] * 4, np.uint8), np.array([4, 5, 6, 7]), 50).tolist() == [0, 0, 7, 7]


def test_results_do_not_depend_on_the_bounds(spark, monkeypatch):
    """Small flushes, pieces and samples, and few hot anchors named."""
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, bound in (("FLUSH", 500), ("HELD", 100), ("COMPARED", 50), ("HOTTEST", 3), ("SAMPLES", 4)):
        monkeypatch.setattr(S, name, bound)
    assert sorted(map(tuple, S.repeated_passages(docs, hot_docs=2, bucket_bytes=2000).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("short", [1, 7, 1024])
def test_multikey_quicksort(short):
    import numpy as np

    r = np.random.default_rng(short)
    for n in (0, 1, 2, 50, 3000):
        keys = [r.integers(0, most, n).astype(np.uint64) for most in (3, 5, 1 << 40)]
        order = S.multikey_quicksort(keys, short)
        assert sorted(order.tolist()) == list(range(n))
        rows = [tuple(int(k[i]) for k in keys) for i in order]
        assert rows == sorted(rows)
