"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Its documents first get the whole copies that all of them are certain of. What is left, the rest, is a
sample with unequal probabilities: a document's inclusion probability p is proportional to its size, the factor being the one with which
the sample is expected to have as many words as the rest. Documents whose probability would be one or more get a certain copy; those
larger than the rest have none. The others are ranked by their random odds u / (1 - u) divided by their inclusion odds p / (1 - p), and the first
n of that ranking are taken, n being the sum of the probabilities. Then the total is corrected: documents at the end of the sample whose
words are too many are left out, the gap is filled from further down the ranking in ROUNDS turns, each passing over what does not fit, and the one
document that comes nearest to the last gap is added if it brings the total closer.

Where a turn ends is found from sums by source and bucket of the ranking; only the one bucket of each source where it ends is ranked row by
row. Buckets are as many as the counted rows call for, so no task sees a whole source. Sources are numbered by a range-partitioned sort, and
the excess of those at their cap is reshared in turns, so there may be millions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blank_word_count, maybe_broadcast, read_table, stored

WEIGHTS = (3, 1, 2)
#: The mix has SHARE halves of all words: 3 halves are 150 %.
SHARE, COPIES, SEED, ROUNDS = 3, 2, "mix", 5
#: Rows that a bucket of the ranking should have at most, on average.
BUCKET_ROWS = 1 << 14
_KEY = "struct<q:double,id:string>"


def _random(id_col: Column, text: Column, seed: str) -> Column:
    """52 random bits of a row's id, or of its text where it has no id."""
    return F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))), "UTF-8")), 1, 13), 16, 10).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0 by code point, null last: ranges are sorted by themselves and counted."""
    at = F.monotonically_increasing_id()
    placed = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("at", at), "mix-sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, total = {}, 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # one row a range
        before[r["part"]], total = total, total + r["n"]
    starts = sources.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part long, before long")
    return placed.join(F.broadcast(starts), part == starts["part"]).withColumn("rank", F.col("before") + place).drop("at", "part", "before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target for each source of (source, size): shares of SHARE / 2 of all words by weight, none above COPIES
    times its source: the excess of those above is reshared among the others until none is. The weights go round by the sources' code points, null
    last. All comparisons are of whole numbers."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    s = _numbered(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    s = stored(s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")), "mix-weights")
    words, open_weight = (x or 0 for x in s.agg(F.sum("source_size"), F.sum("w")).first())
    given, full = 0, F.lit(False)
    while open_weight:
        # a source is full if its share w * (SHARE / 2 * words - COPIES * given) / open_weight is above COPIES times its size
        whole = lambda x: F.lit(x).cast("decimal(38,0)")
        full = big("w") * whole(SHARE * words - 2 * COPIES * given) > whole(2 * COPIES * open_weight) * big("source_size")
        now = tuple(x or 0 for x in s.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("w")))).first())
        if now == (given, open_weight):
            break
        given, open_weight = now
    share = (F.col("w") * (SHARE * words - 2 * COPIES * given)).cast("double") / F.lit(float(2 * max(open_weight, 1)))
    return s.select("source", "source_size", F.when(full, (COPIES * F.col("source_size")).cast("double")).when(F.lit(words == 0), F.lit(0.0)).otherwise(share).alias("target"))


def _by_source(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    key = right.withColumnRenamed("source", "__source")
    for c in set(left.columns) & set(key.columns):
        key = key.drop(c)
    return left.join(key, left["source"].eqNullSafe(key["__source"]), how).drop("__source")


def _rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source: whole copies, rest, certain (the least size with a certain copy, null if none), rate (a document's probability is rate * size),
    n (documents of the sample), gap (the words left to the sample)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    t = stored(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    kinds = _by_source(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("docs")), t, "inner").where("size <= rest")
    exact = lambda *c: math.prod((F.col(x).cast("decimal(38,0)") for x in c[1:]), start=F.col(c[0]).cast("decimal(38,0)")).cast("decimal(38,0)")
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    words, squares = exact("docs", "size"), exact("docs", "size", "size")
    kinds = kinds.withColumn("before", F.coalesce(F.sum(words).over(larger), F.lit(0)).cast("double")).withColumn("below", F.sum(squares).over(smaller).cast("double"))
    sure = (F.col("rest") - F.col("before")) * F.col("size") >= F.col("below")
    kinds = kinds.withColumn("sure", sure)
    of = lambda c, kept: F.coalesce(F.sum(F.when(kept, c)), F.lit(0)).cast("double")
    sums = kinds.groupBy("source").agg(F.min(F.when(F.col("sure"), F.col("size"))).alias("certain"), of(words, F.col("sure")).alias("given"), of(words, ~F.col("sure")).alias("words"), of(squares, ~F.col("sure")).alias("squares"))
    out = _by_source(t, sums, "left").withColumn("gap", F.col("rest") - F.coalesce("given", F.lit(0.0)))
    out = out.withColumn("rate", F.when(F.col("squares") > 0, F.col("gap") / F.col("squares")).otherwise(0.0))
    return out.withColumn("n", F.floor(F.col("rate") * F.coalesce("words", F.lit(0.0)) + 0.5)).select("source", "source_size", "target", "whole", "rest", "certain", "rate", "n", "gap")


def _certain() -> Column:
    return F.coalesce((F.col("size") >= F.col("certain")) & (F.col("size") <= F.col("rest")), F.lit(False))


def _odds() -> Column:
    """Random odds over inclusion odds; null without a chance. u is taken at the middle of its 2 ** -52."""
    u, p = (F.col("u").cast("double") + 0.5) / float(1 << 52), F.col("rate") * F.col("size")
    return F.when((F.col("size") > 0) & (F.col("size") <= F.col("rest")) & ~_certain(), (u * (1 - p)) / ((1 - u) * p))


def _cut_off() -> Column:
    """Whether a row is in one of the turns' heads: it fitted the turn's gap and does not come after its last document."""
    key = F.struct(F.col("q").alias("q"), F.col("id").alias("id"))
    return F.coalesce(F.exists("turns", lambda t: (F.col("size") <= t["gap"]) & (key <= t["last"])), F.lit(False))


def _plan(sized: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """For each source what decides about its documents: whole, rest, certain, rate, turns (gap, last) and fill (u, id, size)."""
    buckets = float(1 << max(4, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS + 1)) + 2))
    plan = stored(_rates(sized, targets).withColumn("turns", F.array().cast(f"array<struct<gap:double,last:{_KEY}>>")), "mix-rates")
    sources = plan.count()
    for turn in range(ROUNDS):
        free = _by_source(sized, maybe_broadcast(plan, 512, sources), "inner").withColumn("q", _odds()).where(F.col("q").isNotNull() & (F.col("size") <= F.col("gap"))).where(~_cut_off())
        free = free.withColumn("b", F.floor((1 - 1 / (1 + F.col("q"))) * buckets)).select("source", "size", "q", "id", "b", "gap", "n")
        every = Window.partitionBy("source")
        run = every.orderBy("b")
        sums = free.groupBy("source", "b").agg(F.sum("size").alias("words"), F.count("*").alias("docs"), F.max(F.struct("q", "id")).alias("top"), F.first("gap").alias("gap"), F.first("n").alias("n"))
        sums = sums.withColumn("words_before", F.sum("words").over(run) - F.col("words")).withColumn("docs_before", F.sum("docs").over(run) - F.col("docs")).withColumn("last_before", F.lag("top").over(run))
        over = (F.col("words_before") + F.col("words") > F.col("gap")) | (F.lit(turn == 0) & (F.col("docs_before") + F.col("docs") > F.col("n")))
        # the bucket where the head ends, else the last one
        sums = sums.withColumn("end", F.coalesce(F.min(F.when(over, F.col("b"))).over(every), F.max("b").over(every)))
        ends = stored(sums.where("b = end").select("source", "end", "words_before", "docs_before", "last_before"), "mix-ends")
        by = every.orderBy("q", "id")
        at_end = _by_source(free, maybe_broadcast(ends, 256, sources), "inner").where("b = end")
        at_end = at_end.withColumn("words", F.col("words_before") + F.sum("size").over(by)).withColumn("docs", F.col("docs_before") + F.count("*").over(by))
        fits = F.col("words") <= F.col("gap")
        if turn == 0:
            fits = fits & (F.col("docs") <= F.col("n"))
        last = at_end.where(fits).groupBy("source").agg(F.max(F.struct("q", "id")).alias("last"), F.max("words").alias("taken"))
        # where no document of that bucket fits, the head is what stands before the bucket
        step = _by_source(ends, last, "left").select("source", F.coalesce("last", "last_before").alias("last"), F.coalesce("taken", "words_before").alias("taken")).where("last is not null")
        after = _by_source(plan, step, "left")
        turns = F.when(F.col("last").isNotNull(), F.concat("turns", F.array(F.struct("gap", F.col("last").cast(_KEY).alias("last"))))).otherwise(F.col("turns"))
        plan = stored(after.withColumn("turns", turns).withColumn("gap", F.col("gap") - F.coalesce("taken", F.lit(0))).drop("last", "taken"), "mix-rates")
    out = _by_source(sized, maybe_broadcast(plan, 512, sources), "inner").withColumn("q", _odds()).where("size > 0").where(~_certain() & ~_cut_off() & (F.abs(F.col("gap") - F.col("size")) < F.col("gap")))
    fill = out.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "u", "id", "size")).alias("fill"))
    return stored(_by_source(plan, fill, "left").select("source", "source_size", "target", "whole", "rest", "certain", "rate", "turns", "fill"), "mix-plan")


def _copies() -> Column:
    fill = F.coalesce((F.col("u") == F.col("fill.u")) & F.col("id").eqNullSafe(F.col("fill.id")) & (F.col("size") == F.col("fill.size")), F.lit(False))
    return F.col("whole") + F.when(_certain() | _cut_off() | fill, 1).otherwise(0)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    text = F.col(text_col).cast("string")
    # ids are compared as texts padded by their length, so that numbers stand in their order
    name = F.col(id_col).cast("string")
    return [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), blank_word_count(text).alias("size"), _random(F.col(id_col), text, seed).alias("u"), F.coalesce(F.concat(F.lpad(F.char_length(name).cast("string"), 4, "0"), F.lit(":"), name), F.lit("")).alias("id")]


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    taken is size times the copies the mix has of the row, 0 to COPIES. Rows without a source are one source, the last.
    Null and empty texts have size 0 and take nothing. Rows that repeat an id within a source and are of one size are taken or left together;
    rows without an id are told apart by their texts. The same rows give the same mix in any order or partitioning.
    An empty table gives an empty result. Only the named columns are read.
    """
    sized = stored(docs.select(*_sized(docs, id_col, text_col, source_col, seed)), "mix-sized")
    plan = _plan(sized, source_targets(sized, weights), sized.count())
    return _by_source(sized, maybe_broadcast(plan, 512), "inner").withColumn("q", _odds()).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs, with all their columns, each as often as mixture() takes it. Rows of size 0 have no words to
    take and are there as often as their source has whole copies. Nulls, repeats and empty tables as in mixture()."""
    columns = _sized(docs, id_col, text_col, source_col, seed)
    sized = stored(docs.select(*columns), "mix-sized")
    plan = _plan(sized, source_targets(sized, weights), sized.count())
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)
    chosen = _by_source(keyed, maybe_broadcast(plan, 512), "inner").withColumn("q", _odds()).select("row", _copies().alias("copies")).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixture() of documents; nulls, repeats and empty tables as there."""
    return mixture(read_table(spark, sf_dir, "documents"))


def _turns() -> str:
    """The turns of the sample in SQL, from the formula: m0 are the documents with a chance, each turn takes a head of those not yet taken."""
    out, taken = [], "false"
    for k in range(ROUNDS):
        taken_before = f"(SELECT source, CAST(sum(CASE WHEN x THEN size ELSE 0 END) AS DOUBLE) AS w FROM m{k} GROUP BY source)"
        out.append(f"""g{k} AS (SELECT m.*, l.gap - coalesce(s.w, 0) AS gp, l.n FROM m{k} m JOIN l ON m.source IS NOT DISTINCT FROM l.source LEFT JOIN {taken_before} s ON m.source IS NOT DISTINCT FROM s.source),
h{k} AS (SELECT source, doc_id, size, u, q, sum(size) OVER o AS words, count(*) OVER o AS docs, gp, n FROM g{k} WHERE NOT x AND size <= gp WINDOW o AS (PARTITION BY source ORDER BY q, doc_id)),
m{k + 1} AS (SELECT g.source, g.doc_id, g.size, g.u, g.q, g.x OR (g.size <= g.gp AND coalesce((g.q, g.doc_id) <= (c.cq, c.cd), false)) AS x FROM g{k} g LEFT JOIN
  (SELECT source, max((q, doc_id)) AS c, max(q) AS cq, arg_max(doc_id, (q, doc_id)) AS cd FROM h{k} WHERE words <= gp{" AND docs <= n" if k == 0 else ""} GROUP BY source) c ON g.source IS NOT DISTINCT FROM c.source)""")
    return ",\n".join(out)


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, sum(z) OVER () AS a FROM s),
o AS (SELECT *, coalesce(sum(z) OVER (ORDER BY z * (6 // w), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY z * (6 // w), rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft FROM w),
f AS (SELECT *, (3 * a - 4 * before) * w > 4 * z * lft AS fl FROM o),
g AS (SELECT *, coalesce(sum(CASE WHEN fl THEN z END) OVER (), 0) AS given, sum(CASE WHEN NOT fl THEN w END) OVER () AS op FROM f),
t AS (SELECT source, z, CASE WHEN fl THEN CAST(2 * z AS DOUBLE) WHEN a = 0 THEN 0.0 ELSE CAST(w * (3 * a - 4 * given) AS DOUBLE) / CAST(2 * op AS DOUBLE) END AS target FROM g),
r AS (SELECT *, target - whole * z AS rest FROM (SELECT *, CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END AS whole FROM t)),
k AS (SELECT source, size, rest, docs, coalesce(sum(docs * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(docs * size * size) OVER (PARTITION BY source ORDER BY size) AS below
  FROM (SELECT d.source, d.size, r.rest, count(*) AS docs FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source WHERE size > 0 AND size <= rest GROUP BY ALL)),
v AS (SELECT source, min(size) FILTER (sure) AS certain, CAST(coalesce(sum(docs * size) FILTER (sure), 0) AS DOUBLE) AS given, CAST(coalesce(sum(docs * size) FILTER (NOT sure), 0) AS DOUBLE) AS words,
  CAST(coalesce(sum(docs * size * size) FILTER (NOT sure), 0) AS DOUBLE) AS squares FROM (SELECT *, (rest - CAST(before AS DOUBLE)) * size >= CAST(below AS DOUBLE) AS sure FROM k) GROUP BY source),
l AS (SELECT *, floor(rate * words + 0.5) AS n FROM (SELECT r.*, v.certain, coalesce(words, 0) AS words, rest - coalesce(given, 0) AS gap, CASE WHEN squares > 0 THEN (rest - given) / squares ELSE 0 END AS rate
  FROM r LEFT JOIN v ON r.source IS NOT DISTINCT FROM v.source)),
j AS (SELECT d.*, l.z, l.target, l.whole, l.rest, l.gap, l.rate, coalesce(size >= certain AND size <= rest, false) AS sure, (CAST(u AS DOUBLE) + 0.5) / 4503599627370496.0 AS uu FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
m0 AS (SELECT source, doc_id, size, u, (uu * (1 - rate * size)) / ((1 - uu) * (rate * size)) AS q, false AS x FROM j WHERE size > 0 AND size <= rest AND NOT sure),
{_turns()},
y AS (SELECT j.*, coalesce(m.x, false) AS x FROM j LEFT JOIN m{ROUNDS} m ON j.source IS NOT DISTINCT FROM m.source AND j.doc_id = m.doc_id AND j.size = m.size),
e AS (SELECT *, gap - sum(CASE WHEN x THEN size ELSE 0 END) OVER (PARTITION BY source) AS last_gap FROM y),
b AS (SELECT source, arg_min(doc_id, (abs(last_gap - size), u, doc_id)) AS fill, arg_min(size, (abs(last_gap - size), u, doc_id)) AS fill_size FROM e
  WHERE size > 0 AND NOT sure AND NOT x AND abs(last_gap - size) < last_gap GROUP BY source)
SELECT e.doc_id, e.size, e.z AS source_size, e.target,
  CAST(e.size * (e.whole + CASE WHEN e.sure OR e.x OR coalesce(e.doc_id = b.fill AND e.size = b.fill_size, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e LEFT JOIN b ON e.source IS NOT DISTINCT FROM b.source
"""
