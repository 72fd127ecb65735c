import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from panelwright.llm import toxicity
from panelwright.llm.mixing import mixture
from panelwright.llm.tokens import tokenizer, vocabulary_path

from .test_decontaminate import brute as brute_contamination
from .test_near_dedup import brute as brute_near


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    plain = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 7))) for _ in range(600)]
    text = lambda n: [r.choice(plain) for _ in range(n)]
    items = [(i, " ".join(text(20))) for i in range(6)]
    docs, labels = [], []
    for i in range(900):
        w = text(r.randrange(20, 90))
        y = int(r.random() < 0.15)
        for _ in range(4 * y):
            w.insert(r.randrange(len(w)), r.choice(["Nasty!", "Vile"]))
        if r.random() < 0.05:
            w[5:5] = r.choice(items)[1].split()[3 : 3 + r.choice([9, 10, 17])]
        if docs and r.random() < 0.1:
            w = r.choice(docs)[1].split()
            w[r.randrange(len(w))] = "zz"
            y = int(any(x in ("Nasty!", "Vile") for x in w))
        docs.append((i, " ".join(w), "en", r.choice(["a", "a", "b", "c"]), 0))
        labels.append((i, 1, y))
    docs += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (None, "no id here at all", "en", "b", 0)]
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_each_stage_on_its_own_input(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, path)
        assert out.columns == columns
        out.cache()
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
            want = {r["doc_id"] for r in toxicity.toxicity(docs, model).where("predicted = 0").collect()}
            assert all(("Nasty" in (t or "") or "Vile" in (t or "")) != (i in want) for i, t in rows)
            want = [x for x in rows if x[0] in want]
        elif name == "near-dedup":
            ids = {i for i, _, c, k in brute_near([x for x in rows if x[0] is not None], 5) if k}
            want = [x for x in rows if x[0] in ids or x[0] is None]
        elif name == "decontamination":
            bad = {x[0] for x in brute_contamination(rows, items) if x[-1]}
            assert bad
            want = [x for x in rows if x[0] not in bad]
        else:
            taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixture(docs).where("size > 0").collect()}
            want = [x for x in rows for _ in range(taken.get(x[0], 0))]
            got = [x for x in got if x[1]]
        assert got == sorted(want, key=str), name
        kept[name] = len(got)
        docs = out
    assert kept["toxicity"] > kept["near-dedup"] > kept["decontamination"]
    encode = tokenizer(vocabulary_path())
    crcs = {}
    for r in docs.collect():
        ids = [*encode.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        crcs.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    packed = P.STAGES[-1][1](spark, docs, path).collect()
    assert len(packed) == sum(map(len, crcs.values()))
    assert all((r["n_tokens"], r["ids_crc32"]) in crcs[r["doc_id"]] for r in packed)
    assert sorted(map(tuple, P.run(spark, path).collect()), key=str) == sorted(map(tuple, packed), key=str)
