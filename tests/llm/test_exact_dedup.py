import hashlib

from pyspark.sql import functions as F

from panelwright.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

SCHEMA = "doc_id long, text string, keep_id string, digest int"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(fold(t), []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[fold(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rows = [(1, "Abc", "x", 1), (2, "aBC", "x", 2), (3, "ÀBC", "y", 3), (4, "àbc", None, 4), (5, None, None, 5), (6, "", "z", None), (7, "abc ", "z", 0), (None, "abc", "q", 1), (None, "only null", "q", 1), (9, "long" * 50_000, "", 1), (10, "LONG" * 50_000, "", 1), (10, "LONG" * 50_000, "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, exact_duplicates(docs, salts=2).collect()), key=str)
    assert got == brute(rows)
    assert {r["doc_id"] for r in drop_exact_duplicates(docs).collect()} == {2, 3, 4, 6, 7, 10, None}
    assert drop_exact_duplicates(docs).columns == docs.columns


def test_large_group_and_empty(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Same")).otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_duplicates(docs.repartition(16))
    assert out.where("kept").count() == 5000 - 1667 + 1
    assert out.where("group_size = 1667 and keep_id = 4998").count() == 1667
    assert exact_duplicates(docs.limit(0)).count() == 0
