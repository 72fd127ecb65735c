import random

import pytest

from panelwright.llm.graph import components
from panelwright.llm.near_dedup import drop_near_duplicates, near_duplicates


def shingles(text, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent=80):
    sets = [(i, shingles(t, size)) for i, t, *_ in rows]
    comp = {i: i for i, _ in sets}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                comp[q] = p
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def corpus(seed, n=150):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(60))
    rows = []
    for i in range(n):
        if i and r.random() < 0.7:
            w = r.choice(rows[-20:])[1].split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, len(w) // 30, len(w) // 18])):
                if w:
                    w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w).swapcase()))
        else:
            rows.append((i, " ".join(word() for _ in range(r.choice([1, 2, 3, 4, 5, 8, 20, 60, 200, 400])))))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5), (3, 4)])
def test_matches_brute_force(spark, seed, size):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*x, "n", 1) for x in rows], "doc_id long, text string, node string, key int").repartition(4)
    got = sorted(map(tuple, near_duplicates(docs, size=size).collect()))
    assert got == brute(rows, size)


def test_pairs_in_a_family_just_below_the_bound(spark):
    """2,000 documents share 300 of 350 shingles (similarity 0.75); 200 pairs among them share 12 to 15 more (0.804 to 0.818)."""
    r = random.Random(5)
    template = " ".join(f"t{i}" for i in range(303))
    order = r.sample(range(2000), 2000)
    pairs = [tuple(sorted(order[2 * i : 2 * i + 2])) for i in range(200)]
    same = {i: (k, 12 + k % 4) for k, p in enumerate(pairs) for i in p}
    rows = []
    for i in range(2000):
        k, n = same.get(i, (0, 0))
        rows.append((i, " ".join([template, *(f"p{k}x{j}" for j in range(n)), *(f"u{i}x{j}" for j in range(50 - n))])))
    for (_, s), (_, t) in ((rows[a], rows[b]) for a, b in pairs[:8]):
        a, b = shingles(s, 4), shingles(t, 4)
        assert 0.80 <= len(a & b) / len(a | b) <= 0.82
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), size=4).collect()}
    want = {i: i for i in range(2000)} | {b: a for a, b in pairs}
    assert got == want


def test_odd_rows(spark):
    long = "x y z " * 30_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (None, "one two"), (None, "alone here"), (7, long), (8, long.upper()), (8, long.upper()), (9, "a b")]
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, set string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, size=4).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, 4, False), (None, 1, None, True), (7, 3, 7, True), (8, 3, 7, False), (9, 1, 9, True)}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 7, 9]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(399, 3), (50, 50)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys([3, 7, *range(200, 400)], 3)}


def test_a_family_of_pairs_loses_none(spark):
    """1,500 pairs of similarity 0.84 share boilerplate: 0.77 across pairs. The exact join tests few of the 4,500,000 pairs."""
    template = " ".join(f"t{i}" for i in range(203))
    rows = []
    for i in range(3000):
        k = i % 1500
        rows.append((i, " ".join([template, *(f"p{k}x{j}" for j in range(10)), *(f"u{i}x{j}" for j in range(20))])))
    a, b, c = (shingles(rows[i][1], 4) for i in (0, 1500, 1))
    assert len(a & b) / len(a | b) > 0.83 and 0.75 < len(a & c) / len(a | c) < 0.79
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), size=4).collect()}
    assert got == {i: i % 1500 for i in range(3000)}


def test_copies_of_an_original_that_are_unlike_each_other(spark):
    """400 copies of one text, each 0.85 like it and 0.73 like each other; the original has neither the least nor the greatest id."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = [(500, " ".join(base))]
    for i in [*range(300, 500), *range(501, 701)]:
        w = list(base)
        for k, at in enumerate(r.sample(range(0, 400, 10), 8)):
            w[at + r.randrange(7)] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    got = {tuple(x) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=4).select("doc_id", "component_id").collect()}
    assert got == {(i, c) for i, _, c, _ in brute(rows, 4)}
    assert len({c for _, c in got}) == 1


def test_repeated_ids_are_judged_by_their_texts(spark):
    long = [" ".join(f"{x}{i}" for i in range(60)) for x in "ab"]
    near = [t + " more" for t in long]
    rows = [(1, long[0]), (5, near[0]), (5, long[1]), (9, near[1])] + [(20, long[0] + " x y")] * 150 + [(21, long[0] + " x z")] * 150
    docs = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, th string, uid int").repartition(5)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, size=4).collect()}
    assert got == {(1, 57, 1, True), (5, 58, 1, False), (5, 57, 5, True), (9, 58, 5, False), (20, 59, 1, False), (21, 59, 1, False)}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, long[0]), (5, long[1])]
