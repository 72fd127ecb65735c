"""Benchmark decontamination by winnowing.

Of each run of WINDOW - GRAM + 1 consecutive GRAM-word hashes the least is kept, so two texts that share WINDOW words
share a kept hash. Document fingerprints are joined to the benchmark's; every hit is extended to the windows around
it, which are then compared word for word. Hashes only propose; only equal words decide. Benchmark items shorter than
a window have their whole word sequence as fingerprint, which documents meet with all their runs of that many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, LOWER, maybe_broadcast, read_table, stored

WINDOW, GRAM = 10, 4
#: Runs of these separate words: all of ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in their own case; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, SEPARATORS, -1), ""), F.array().cast("array<string>"))


def _hashes(words: Column) -> Column:
    """lower() may merge a few words that differ beyond A-Z; that only proposes more."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _run(array: Column, i: Column, n: int) -> list[Column]:
    """The n elements from index i on. get() takes constant time where slice() would copy the array."""
    return [F.get(array, i + j) for j in range(n)]


def _grams(hashes: Column, n: int, *more: Column) -> Column:
    """Hashes of all runs of n words by their first word; the last ones, cut short, are their own."""
    return F.transform(hashes, lambda _, i: F.xxhash64(*more, *_run(hashes, i, n)))


def _winnowed(grams: Column, gram: int, window: int) -> Column:
    return F.transform(grams, lambda _, i: F.least(*_run(grams, i, window - gram + 1)) if window > gram else F.get(grams, i))


def _fingerprints(rows: DataFrame, text: Column, keys: list[str], short: list[int], window: int, gram: int) -> DataFrame:
    """keys, n and prints for each row. Each step is a projection of its own, so that no array is made anew for each word. What
    explodes the prints must do so with explode_outer: explode has Catalyst push a test of their number below these projections."""
    hashed = rows.select(*keys, _hashes(words_of(text)).alias("h")).withColumn("n", F.size("h"))
    grams = hashed.withColumn("g", _grams(F.col("h"), gram)).withColumn("m", _winnowed(F.col("g"), gram, window))
    none = F.array().cast("array<bigint>")
    prints = [F.when(F.col("n") >= window, F.col("m")).otherwise(none), *[F.when(F.col("n") >= k, _grams(F.col("h"), k, F.lit(k))).otherwise(none) for k in short]]
    return grams.select(*keys, "n", F.array_distinct(F.concat(*prints)).alias("prints"))


def _spans(k: int | None, window: int, gram: int) -> Column:
    """1-based starts, lengths and words of the windows that a row's hits stand for; k: of the items with k words, fewer than a window."""
    n, size, none = F.col("n"), k or window, F.array().cast("array<int>")
    if k is None:
        hit = F.filter(F.sequence(F.lit(1), F.size("g")), lambda i: F.array_contains(F.col("hits"), F.get(F.col("g"), i - 1)))
        around = F.transform(hit, lambda p: F.when(p <= n - gram + 1, F.sequence(F.greatest(F.lit(1), p - (window - gram)), F.least(p, n - window + 1))).otherwise(none))
        starts = F.array_distinct(F.flatten(around))
    else:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_contains(F.col("hits"), F.xxhash64(F.lit(k), *_run(F.col("h"), i - 1, k))))
    spans = F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(size).alias("len"), F.concat_ws(" ", *_run(F.col("w"), i - 1, size)).alias("words")))
    return F.when(n >= size, spans).otherwise(F.array().cast("array<struct<start:int,len:int,words:string>>"))


def _short_prints(lengths: list[int]) -> Column:
    """What documents must show for an item of fewer words than a window: its one run of all its words."""
    hashes = _hashes(F.col("w"))
    return F.array(*[F.when(F.col("n") == k, F.xxhash64(F.lit(k), *[F.get(hashes, j) for j in range(k)])) for k in lengths] or [F.lit(None).cast("bigint")])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    A document word is hit if it lies in an occurrence of one of an item's windows. Null and empty texts have no words
    and are clean; items without words match nothing; an item without an id counts in n_hit but not in n_items.
    Repeated rows each get their own, equal, result; rows that share an id but not the text are kept apart. Null ids
    are kept. An empty benchmark leaves every document clean. Only the named columns are read.
    """
    return _contamination(docs, benchmark, id_col, text_col, item_col, item_text, window, gram).drop("th")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of docs, with all their columns, in which contamination() finds nothing."""
    bad = _contamination(docs, benchmark, id_col, text_col, item_col, item_text, window, gram).where("contaminated")
    bad = stored(bad.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct(), "bench-bad")
    return docs.join(maybe_broadcast(bad, 32), docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["__th"]), "left_anti")


def _contamination(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, gram: int) -> DataFrame:
    """contamination() and the hash of each row's text."""
    if gram > window:
        raise ValueError("gram must not exceed window")
    items = stored(benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.translate(F.col(item_text).cast("string"), UPPER, LOWER)).alias("w"), F.col(item_text).cast("string").alias("t")).withColumn("n", F.size("w")).where("n > 0"), "bench-items")
    short = sorted(r[0] for r in items.where(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 lengths
    whole = F.array(F.array_join("w", " "))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0))), lambda i: F.concat_ws(" ", *_run(F.col("w"), i, window)))
    windows = stored(items.select("item", F.explode_outer(F.when(F.col("n") < window, whole).otherwise(pieces)).alias("words")).distinct(), "bench-windows")
    prints = stored(
        _fingerprints(items.where(F.col("n") >= window), F.col("t"), [], [], window, gram).select(F.explode_outer("prints").alias("print"))
        .unionByName(items.where(F.col("n") < window).select(F.explode_outer(_short_prints(short)).alias("print")).where("print is not null")).distinct(),
        "bench-prints",
    )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.withColumn("th", F.xxhash64("text"))
    found = _fingerprints(keyed, F.col("text"), ["doc_id", "th"], short, window, gram).select("doc_id", "th", F.explode_outer("prints").alias("print"))
    hits = stored(found.join(maybe_broadcast(prints, 16), "print", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("print").alias("hits")), "bench-hits")
    weight = hits.agg(F.sum(F.size("hits") * 8 + 64)).first()[0] or 0

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    mark = maybe_broadcast(hits, 1, weight).alias("b")
    near = keyed.alias("a").join(mark, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))).select("a.doc_id", "a.th", "a.text", "b.hits").dropDuplicates(["doc_id", "th"])
    near = near.withColumn("w", words_of(F.translate("text", UPPER, LOWER))).withColumn("n", F.size("w")).withColumn("h", _hashes(words_of(F.col("text")))).withColumn("g", _grams(F.col("h"), gram))
    spans = near.select("doc_id", "th", F.explode_outer(F.concat(*[_spans(k, window, gram) for k in (None, *short)])).alias("s")).select("doc_id", "th", "s.*")
    known = windows.select("words").distinct()
    equal = stored(spans.join(maybe_broadcast(known, 400), "words", "left_semi"), "bench-equal")
    covered = equal.groupBy("doc_id", "th").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(start, start + len - 1)"))))).cast("long").alias("n_hit"))
    held = equal.select("doc_id", "th", "words").distinct().join(maybe_broadcast(windows, 400), "words").select("doc_id", "th", "item").where("item is not null").distinct()
    held = held.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = stored(covered.alias("c").join(held.alias("i"), same(covered, held), "left").select(covered["doc_id"], covered["th"], "n_hit", "items"), "bench-found")

    every = rows.select("doc_id", F.xxhash64("text").alias("th"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = every.join(maybe_broadcast(found, 4096), same(every, found), "left").select(every["doc_id"], every["th"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select("doc_id", "th", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination() of documents by benchmark; nulls, repeats and empty tables as there."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bl)),
ks AS (SELECT DISTINCT k FROM bl),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, ks)),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
