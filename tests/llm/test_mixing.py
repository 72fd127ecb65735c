import random

from panelwright.llm.mixing import mix, mixture, source_targets


def level(sizes, weights=(3, 1, 2)):
    """Targets by repeated resharing."""
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    w = {x: weights[i % 3] for i, x in enumerate(names)}
    total, capped, target = 1.5 * sum(sizes.values()), {}, {}
    while True:
        left = [x for x in names if x not in capped]
        target = {x: (total - sum(capped.values())) * w[x] / sum(w[y] for y in left) for x in left}
        above = [x for x in left if target[x] > 2 * sizes[x]]
        if not above:
            return {**target, **capped}
        capped |= {x: 2 * sizes[x] for x in above}


def docs_of(spark, n, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * min(2000, int(r.paretovariate(1) * 20))), r.choice(["a", "a", "a", "b", "é", "z", None]), "x") for i in range(n)]
    rows += [(n, None, "b", "x"), (n + 1, "", "q", "x"), (None, "one two", "a", "x"), (None, "three", "a", "x"), (5, rows[5][1], rows[5][2], "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string"), rows


def test_targets_and_nearness(spark):
    docs, rows = docs_of(spark, 3000, 1)
    got = mixture(docs.repartition(5)).collect()
    assert len(got) == len(rows)
    by = {}
    source = {(i, len((t or "").split())): s for i, t, s, _ in rows}
    for r in got:
        s = by.setdefault(source[(r["doc_id"], r["size"])], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    want = level({s: v[0] for s, v in by.items()})
    for s, (size, taken, target, source_size) in by.items():
        assert size == source_size and abs(target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken - target) <= 25 + target / 100, (s, taken, target)  # sizes have a heavy tail: nothing may fit what is left
    again = mixture(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_has_the_rows(spark):
    docs, rows = docs_of(spark, 400, 2)
    plan = {(r["doc_id"], r["size"]): r["taken"] for r in mixture(docs).collect()}
    out = mix(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        k = (r["doc_id"], len((r["text"] or "").split()))
        words[k] = words.get(k, 0) + k[1]
    twice = (5, len(rows[5][1].split()))
    assert words.get(twice, 0) == 2 * plan[twice]
    assert all(words.get(k, 0) == v for k, v in plan.items() if k != twice)


def test_empty_and_wordless(spark):
    docs, _ = docs_of(spark, 20, 3)
    assert mixture(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {tuple(r)[1:] for r in mixture(none).collect()} == {(0, 0, 0.0, 0)}
    assert mix(none).count() <= 4
    one = spark.createDataFrame([("a", 10), ("a", 5)], "source string, size long")
    assert source_targets(one).first()["target"] == 22.5


def test_inclusion_follows_size(spark):
    """300 sources of the same 120 sizes are 300 draws: whole copies for all, certain ones for the largest, and frequencies near p = rate * size."""
    r = random.Random(7)
    sizes = sorted(int(r.paretovariate(1.2) * 20) for _ in range(120))
    rows = [(s * 200 + i, " ".join(["w"] * n), f"s{s:03}") for s in range(300) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {x["doc_id"]: x["taken"] // x["size"] for x in mixture(docs, weights=(1,)).collect()}
    rest, certain = 0.5 * sum(sizes), []
    left = list(sizes)
    while left:
        rate = (rest - sum(certain)) / sum(x * x for x in left)
        sure = [x for x in left if rate * x >= 1]
        if not sure:
            break
        certain += sure
        left = [x for x in left if rate * x < 1]
    assert certain and left
    n = sum(rate * x for x in left)
    taken = [sum(got[s * 200 + i] for s in range(300)) / 300 for i in range(120)]
    assert all(t == 2 for t, x in zip(taken, sizes, strict=True) if x in certain)
    some = [(t - 1, rate * x) for t, x in zip(taken, sizes, strict=True) if x not in certain]
    assert abs(sum(t for t, _ in some) - n) < 0.25 * n  # the correction of the total adds and takes away a few
    assert all(abs(t - p) < 0.2 for t, p in some)
    low, high = some[: len(some) // 3], some[-(len(some) // 3) :]
    assert sum(t for t, _ in high) > 1.3 * sum(t for t, _ in low) * (sum(p for _, p in high) / sum(p for _, p in low)) ** 0.5


def test_one_document_with_half_of_the_words(spark):
    """A document larger than what is left to sample is passed over, and the many small ones fill the target."""
    rows = [(0, "w " * 100_000, "a")] + [(i, "w " * (50 + i % 101), "a") for i in range(1, 1001)]
    rows += [(2000 + i, "v " * (100 + i % 7), "b") for i in range(3000)]
    for weights in ((1, 9), (1, 4), (2, 3), (9, 1)):
        out = mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=weights).collect()
        for keep in (lambda i: i < 2000, lambda i: i >= 2000):
            mine = [x for x in out if keep(x["doc_id"])]
            assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 3 + mine[0]["target"] / 1000, weights


def test_a_very_long_text_and_clashing_columns(spark):
    rows = [(1, "word " * 300_000, "a", 1.0, "x"), (2, "two words", "a", 2.0, "y"), (3, "three", None, 3.0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double, gap string")
    out = mix(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} <= {1, 2, 3}
    assert {r["doc_id"]: r["size"] for r in mixture(docs).collect()} == {1: 300_000, 2: 2, 3: 1}
