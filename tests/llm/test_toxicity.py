import itertools
import math
import random
import zlib

import pytest

from panelwright.llm import toxicity as T


def brute_marginals(model, words):
    """By summing over all label sequences."""
    emit = [sum(model.weights.get(f, 0.0) for f in T.features(w.strip(T.STRIP))) + model.bias for w in words]
    mass = [0.0] * len(words)
    total = 0.0
    for labels in itertools.product((0, 1), repeat=len(words)):
        z = math.exp(sum(e for e, y in zip(emit, labels) if y) + sum(model.pairs[a][b] for a, b in zip(labels, labels[1:])))
        total += z
        for i, y in enumerate(labels):
            mass[i] += z * y
    return [m / total for m in mass]


@pytest.mark.parametrize("seed", range(6))
def test_marginals_match_all_sequences(seed):
    r = random.Random(seed)
    model = T.Model({"bad": 2.5, "bad-": 1.0, "vile": -0.7, "grim-": 3.0}, -1.3, [[r.uniform(-2, 2) for _ in range(2)] for _ in range(2)], [0, 1, 1])
    for n in (1, 2, 5, 9, 11):
        words = [r.choice(["ok", "so", "fine", "Bad,".lower(), "vile", "grimly", "--"]) for _ in range(n)]
        want = brute_marginals(model, words)
        got = T.Tagger(model).marginals(words)
        with_features = [i for i, w in enumerate(words) if any(f in model.weights for f in T.features(w.strip(T.STRIP)))]
        assert [i for i, _ in got] == with_features
        assert all(abs(p - want[i]) < 1e-9 for i, p in got)


def corpus(n, seed):
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 8))) for _ in range(900)]
    ends = ["um", "eth", "or", "ix", "an"]
    rows = []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(15, 80))]
        y = int(r.random() < 0.2)
        for _ in range(3 * y):
            words.insert(r.randrange(len(words)), r.choice(["Nasty!", "vörst" + r.choice(ends)]))
        rows.append((i, " ".join(words), y))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus(1500, 4)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, score string, y int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return rows, docs, T.fit(docs, labels), labels


def test_held_out_documents(spark, trained):
    rows, docs, model, _ = trained
    got = {r["doc_id"]: r for r in T.toxicity(docs.repartition(3), model).collect()}
    assert len(got) == len(rows)
    out = [(y, got[i]["predicted"]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert sum(p for y, p in out if y) >= 0.95 * sum(y for y, _ in out)
    assert sum(p for y, p in out if not y) == 0
    i, text, _ = next(x for x in rows if x[2] and got[x[0]]["spans"])
    for s in got[i]["spans"]:
        assert any(x in text[s["start"] : s["end"]].lower() for x in ("nasty", "vörst"))
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_training_sees_no_held_out_labels(spark, trained):
    rows, docs, _, labels = trained
    texts = {t: i for i, t, _ in rows}
    assert all(zlib.crc32(str(texts[t]).encode()) % 3 != 1 for t, _ in T.training_sample(docs, labels))


def test_odd_rows(spark, trained):
    _, docs, model, labels = trained
    odd = spark.createDataFrame([(None, "nasty"), (1, None), (2, ""), (3, " \x1c  "), (4, "İ nasty, " + "word " * 60_000 + "nasty"), (4, "x")], "doc_id long, text string")
    got = T.toxicity(odd, model).collect()
    assert len(got) == 6 and len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert not next(r for r in got if r["doc_id"] is None)["held_out"]
    assert [(s["start"], s["end"]) for s in next(r for r in got if r["doc_id"] == 4 and r["spans"])["spans"]] == [(2, 8), (300_009, 300_014)]
    assert T.toxicity(odd.limit(0), model).count() == 0
    for sample in ([], [("a b", 1)], [("a b", 0)]):
        plain = T.train(sample)
        assert all(0 < r["score"] < 1 for r in T.toxicity(odd, plain).collect())
    assert T.training_sample(docs, labels.limit(0)) == []


def test_short_texts_train_too(spark):
    """400 texts of 10 and 11 words, half of them with a toxic word: shorter than any training sequence."""
    r = random.Random(2)
    plain = [f"{a}{b}" for a in "klmnoprst" for b in "aeiou"]
    rows = [(i, [r.choice(plain) for _ in range(10)]) for i in range(400)]
    for i, w in rows[::2]:
        w.insert(r.randrange(10), "vile" if i % 4 else "grim")
    model = T.train([(" ".join(w), int(i % 2 == 0)) for i, w in rows[:300]])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows[300:]], "doc_id long, text string")
    assert all(x["predicted"] == int(x["doc_id"] % 2 == 0) for x in T.toxicity(docs, model).collect())


def test_a_labelled_id_in_very_many_rows(spark):
    docs = spark.range(60_000).selectExpr("7 as doc_id", "concat('row ', id % 50) as text").unionByName(spark.createDataFrame([(6, "vile"), (8, "x y")], "doc_id int, text string"))
    labels = spark.createDataFrame([(7, 0), (6, 1), (8, 0), (8, 1)], "doc_id long, toxic int")
    assert T.labelled(docs, labels).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in (6, 7, 8))


def test_tokens_are_labelled_by_what_documents_say():
    """A word that stands in toxic documents only together with others that explain them gains less than those."""
    r = random.Random(3)
    plain = [f"{a}{b}" for a in "klmnoprst" for b in "aeiou"]
    rows = []
    for i in range(1200):
        w = [r.choice(plain) for _ in range(40)]
        if i % 3 == 0:
            w[r.randrange(40)] = r.choice(["vile", "grim"])
            if i % 2:
                w[r.randrange(40)] = "also"
        elif i % 20 == 1:
            w[r.randrange(40)] = "also"
        rows.append((" ".join(w), int(i % 3 == 0)))
    model = T.train(rows)
    assert min(model.weights["vile"], model.weights["grim"]) > model.weights.get("also", 0.0) + 1
