"""Nulls, repeats, very long texts, clashing names and empty tables, where an operator's own tests have none of them."""

import hashlib

import corpus_pipeline as P
from panelwright.llm import suffix_dedup as S
from panelwright.llm.decontaminate import contamination, drop_contaminated
from panelwright.llm.secrets import fitted, redact, secrets

from .test_suffix_dedup import brute as brute_passages


def test_the_pipeline_over_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    for name, columns in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{path}/{name}.parquet")
    assert P.run(spark, path).count() == 0


def test_passages_of_a_very_long_text_of_one_byte(spark):
    """Each place of a run is an anchor; the second document loses it all, the third what the first has."""
    rows = [(1, "a" * 300_000), (2, "a" * 200_000), (3, "b" * 60 + "a" * 1000 + "b" * 60), (4, None)]
    got = {r["doc_id"]: r for r in S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 200_000, 1000, 0]
    assert got[3]["kept_sha256"] == hashlib.sha256(b"b" * 120).hexdigest() and got[3]["n_spans"] == 1


def test_passages_at_the_ends_of_the_byte_order(spark):
    """Suffixes that agree on far more than eight leading bytes, of the least and the largest bytes, in many small buckets."""
    least, most = "\x00" * 70, "\U0010ffff" * 30
    texts = [least + "x", "y" + least, most, "z" * 3 + most, "same start " * 9 + "1", "same start " * 9 + "2", "same start " * 4 + "3"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, S.repeated_passages(docs, bucket_bytes=20, hot_docs=1).collect()), key=str) == brute_passages(rows)
    assert sorted(map(tuple, S.repeated_passages(docs, bucket_bytes=20).collect()), key=str) == brute_passages(rows)


def test_contamination_in_a_very_long_text_with_clashing_columns(spark):
    """250,000 words with one passage at the end; columns named as those the operator makes; a repeated row; the same item twice."""
    item = " ".join(f"q{i}" for i in range(14))
    docs = spark.createDataFrame([(1, "Word " * 250_000 + item.upper(), 5, "a", True), (2, "short", 6, "b", None), (2, "short", 6, "b", None), (3, None, None, None, None)], "doc_id long, text string, n_words int, item_id string, contaminated boolean")
    items = spark.createDataFrame([(7, item, "x"), (7, item, "x"), (8, None, "y"), (9, "", "z")], "item_id long, text string, doc_id string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in contamination(docs, items).collect()))
    assert got == [(1, 250_014, 14, 1, True), (2, 1, 0, 0, False), (2, 1, 0, 0, False), (3, 0, 0, 0, False)]
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 2, 3]


def test_secrets_of_repeated_rows_and_clashing_columns(spark):
    text = "password = hunter22 and AKIA" + "Q7" * 10
    docs = spark.createDataFrame([(1, text, "a", 1), (1, text, "a", 1), (1, None, "b", 2), (None, "", "c", 3)], "doc_id long, text string, spans string, n int")
    model = fitted(docs)
    found = [(r["doc_id"], len([s for s in r["spans"] if s[0] != "markov"])) for r in secrets(docs, *model).collect()]
    assert sorted(found, key=str) == [(1, 0), (1, 2), (1, 2), (None, 0)]
    out = redact(docs, *model)
    assert out.columns == docs.columns and sorted((r["text"] or "").count("[secret]") for r in out.collect()) == [0, 0, 2, 2]
