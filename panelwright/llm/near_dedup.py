"""Near-duplicate documents by MinHash with one permutation.

One hash of each word shingle serves for all of a signature: its high bits name a bin, and a bin keeps the least hash.
Empty bins borrow from bins that a fixed sequence of random bins names (optimal densification), so sets that share 80 %
of their shingles agree in about 80 % of the bins, whatever their size. Bands of bins are hashed to buckets. A bucket's
centre is the member whose buckets are the fullest, as that of an original among its copies; a document is compared with the centre that most of its
buckets have, so candidate edges form stars and there are no more of them than documents. Edges are confirmed on the whole shingle sets.
Buckets that then still hold several components are settled exactly: their members are joined on the rarest of their shingles, of
which two sets this alike must share one early in the order. Documents with equal sets are one node from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, read_table, small_batches, stored
from .graph import components, roots
from .tokens import text_rows

BINS_LOG2, ROWS = 7, 4
U64 = np.uint64
#: Multipliers of a shingle's words and of a band's bins.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)
WORDS_KEPT = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Words(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < WORDS_KEPT and len(word) <= 64:
            self[word] = h
        return h


def shingle_set(text: bytes, hashes: _Words, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `size` words of the text, A-Z lower-cased; of all words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(hashes.__getitem__, words), U64, len(words))
    k = min(size, len(words))
    out = np.full(len(h) - k + 1, k, U64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * ODD[i]
    return np.unique(_mixed(out))


def signature(shingles: np.ndarray, log2: int = BINS_LOG2) -> np.ndarray:
    """The least hash of each bin; empty bins have that of the first bin in their own sequence that is not empty."""
    bins = 1 << log2
    at = np.searchsorted(shingles, np.arange(bins, dtype=U64) << U64(64 - log2))
    full = np.diff(np.append(at, len(shingles))) > 0
    out = np.zeros(bins, U64)
    out[full] = shingles[at[full]]
    left, j = np.flatnonzero(~full), 0
    while len(left):
        j += 1
        source = (_mixed((left.astype(U64) + U64(1)) * ODD[0] + U64(j * int(ODD[1]) % (1 << 64))) >> U64(64 - log2)).astype(np.int64)
        hit = full[source]
        out[left[hit]] = out[source[hit]]
        left = left[~hit]
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket for each band of `rows` bins; buckets of different bands differ."""
    bands = sig.reshape(-1, rows)
    key = np.arange(len(bands), dtype=U64) * ODD[7]
    for i in range(rows):
        key = _mixed(key + bands[:, i] * ODD[i])
    return key.view(np.int64)


def _signed(rows: DataFrame, size: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for part, texts in text_rows(batches):
            sets = [shingle_set(t, hashes, size) for t in texts]
            keys = [band_keys(signature(s)) if len(s) else None for s in sets]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "n_shingles", "digest", "keys"])

    return rows.mapInArrow(sign, "doc_id long, th long, n_shingles long, digest binary, keys array<long>")


def _texts_of(nodes: DataFrame, named: DataFrame, rows: DataFrame) -> DataFrame:
    """nodes (node, ...) with the text of each: once, or as often as its row is repeated."""
    who = stored(nodes.join(named.where("uid = node").select("node", F.col("doc_id").alias("__id"), F.col("th").alias("__th")), "node"), "near-nodes")
    return rows.join(maybe_broadcast(who, 128), (rows["th"] == F.col("__th")) & rows["doc_id"].eqNullSafe(F.col("__id"))).select(*nodes.columns, "text")


def _linked(edges: DataFrame, named: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The edges (a, b) of nodes whose texts share at least `percent` of their joint shingles."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for part, found in text_rows(batches):
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingle_set(t, hashes, size).tobytes() for t in found], pa.binary())], names=["node", "set"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
            keep = []
            for p, q in zip(x, y, strict=True):
                m, n = len(p) // 8, len(q) // 8
                both = len(np.intersect1d(np.frombuffer(p, U64), np.frombuffer(q, U64), assume_unique=True)) if 100 * min(m, n) >= percent * max(m, n) else 0
                keep.append(both > 0 and 100 * both >= percent * (m + n - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    whole = stored(_texts_of(nodes, named, rows).mapInArrow(sets, "node long, set binary"), "near-sets")
    if whole.count() > whole.select("node").distinct().count():  # rows that repeat an id and a text
        whole = stored(whole.dropDuplicates(["node"]), "near-sets")
    of = lambda side: whole.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}"))
    return edges.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(confirm, "a long, b long")


def _stars(members: DataFrame) -> DataFrame:
    """One edge (a, b) for each node of members (key, node, n: the bucket's members) that is not the centre of all its buckets.

    Centres are greatest by (score, -node), the score being the sum of n over a node's buckets; so edges lead upwards in that order and
    never round in a circle.
    """
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    scored = stored(members.select("key", "node").join(score, "node"), "near-scored")
    centres = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("of"))).alias("top")).select("key", F.col("top.score").alias("of_score"), (-F.col("top.of")).alias("centre"))
    met = scored.select("key", "node").join(centres, "key").where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("n"), F.first("of_score").alias("of_score"))
    return met.groupBy("node").agg(F.max(F.struct("n", "of_score", (-F.col("centre")).alias("of"))).alias("best")).select(F.col("node").alias("a"), (-F.col("best.of")).alias("b"))


def _least(n: Column, m: Column, percent: int) -> Column:
    """How many elements sets of n and m elements have in common at least, if they share `percent` of their union."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100.0 + percent) - 1e-9)


def _rarest_shared(left: DataFrame, named: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of left (node, component) in different components that may share `percent` of their joint shingles; no such pair is missed.

    All shingles stand in one order, from rare to frequent, so that text that a whole family shares comes last. Sets of m <= n shingles this
    alike share at least c = percent * (m + n) / (100 + percent). Everything they share stands from their first shared shingle on, so in neither
    set are there fewer than c from there to its end. The smaller set needs looking at for its first 11 % (at 80), the larger for its
    first 20 %. Shingles of one set only have their place in the order but need no row; those of one component make no pair. Of each
    shingle's rows, those of its largest component are not joined with one another.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for part, found in text_rows(batches):
            for node, component, t in zip(part.column("node").to_pylist(), part.column("component").to_pylist(), found, strict=True):
                s = shingle_set(t, hashes, size)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(s), x, np.int64)) for x in (node, component, len(s))), pa.array(s.view(np.int64))], names=["node", "component", "n", "shingle"])

    texts = _texts_of(left, named, rows).dropDuplicates(["node"])
    all_of = stored(texts.mapInArrow(spread, "node long, component long, n long, shingle long"), "near-shingles")
    common = stored(all_of.groupBy("shingle").agg(F.count("*").alias("df"), (F.min("component") < F.max("component")).alias("mixed")).where("df > 1"), "near-common")
    met = all_of.join(maybe_broadcast(common, 96), "shingle")
    by = Window.partitionBy("node")
    met = met.withColumn("at", F.col("n") - F.count("*").over(by) + F.row_number().over(by.orderBy("df", "shingle")))
    n = F.col("n")
    first = stored(met.where(F.col("mixed") & (F.col("at") <= n - F.ceil(n * percent / F.lit(100.0) - 1e-9) + 1)).select("shingle", "node", "n", "at", "component"), "near-first")
    sizes = first.groupBy("shingle", "component").agg(F.count("*").alias("rows")).groupBy("shingle").agg(F.max(F.struct("rows", "component")).alias("top"), F.count("*").alias("components")).where("components > 1")
    first = stored(first.join(maybe_broadcast(stored(sizes.select("shingle", F.col("top.component").alias("main")), "near-mains"), 96), "shingle").withColumn("other", F.col("component") != F.col("main")).drop("main"), "near-first")
    small, large = (first.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "at", "component", "other")]) for side in "xy")
    small = small.where(F.col("at_x") <= F.col("n_x") - _least(F.col("n_x"), F.col("n_x"), percent) + 1)
    m, n = F.col("n_x"), F.col("n_y")
    near = ((m < n) | ((m == n) & (F.col("node_x") < F.col("node_y")))) & (F.col("component_x") != F.col("component_y")) & (100 * m >= percent * n)
    near = near & (1 + F.least(m - F.col("at_x"), n - F.col("at_y")) >= _least(m, n, percent))
    pairs = small.where("other_x").join(large, "shingle").where(near).select("node_x", "node_y").unionByName(small.where("not other_x").join(large.where("other_y"), "shingle").where(near).select("node_x", "node_y"))
    return pairs.distinct().toDF("a", "b")


def _judged(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, component_id, kept. A node is a distinct shingle set, named by the uid of its first row."""
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    signed = stored(_signed(rows, size).withColumn("uid", F.monotonically_increasing_id()), "near-signed")
    equal = stored(signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("uid").alias("same"), F.count("*").alias("n")).where("n > 1").select("digest", "least", "same"), "near-equal")
    named = signed.join(maybe_broadcast(equal, 128), "digest", "left").withColumn("node", F.when(F.col("digest").isNotNull(), F.coalesce("same", "uid"))).withColumn("least", F.coalesce("least", "doc_id")).drop("same")

    keyed = named.where("uid = node").select("node", F.explode_outer("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-buckets")
    members = stored(keyed.join(maybe_broadcast(shared, 96), "key"), "near-members")
    stars = stored(_stars(members), "near-pairs")
    labels = roots(stored(_linked(stars, named, rows, size, percent), "near-links").toDF("node", "parent"))

    here = stored(members.join(maybe_broadcast(labels, 96), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "near-here")
    mixed = here.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = stored(here.join(maybe_broadcast(stored(mixed, "near-mixed"), 96), "key", "left_semi").select("node", "component").distinct(), "near-left")
    if not left.isEmpty():
        tested = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = stored(_rarest_shared(left, named, rows, size, percent).join(tested, ["a", "b"], "left_anti"), "near-pairs")
        found = stored(_linked(pairs, named, rows, size, percent), "near-links")
        of = lambda side: left.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        joined = components(found.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct())
        labels = labels.unionByName(joined.select("node", F.col("node").alias("component"))).distinct().withColumnRenamed("component", "old")
        labels = stored(labels.join(joined.select(F.col("node").alias("old"), "component"), "old", "left").select("node", F.coalesce("component", "old").alias("component")), "near-labels")
    whose = labels.join(named.where("uid = node").select("node", "least"), "node")
    names = whose.groupBy("component").agg(F.min("least").alias("component_id"))
    names = stored(whose.select("node", "component").join(names, "component").select("node", "component_id", F.lit(True).alias("linked")), "near-names")
    out = named.join(maybe_broadcast(names, 96), "node", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).when(F.col("linked"), F.col("component_id")).otherwise(F.col("least"))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents whose sets of distinct `size`-word shingles have at least `percent` of their union in common are linked;
    component_id is the least doc_id that links reach. Null, empty and blank texts have no shingles and stay alone. Fewer
    words than `size` are one shingle. Rows that repeat an id with the same text share their component and are kept
    alike; with other texts each row has the component of its text, and links of one are not the other's. Rows without an id never give a
    component its name: they have that of the texts with an id that links reach, else null, and are kept then. Ids are cast to long. Empty
    tables give empty results. Only the named columns are read.

    A link is missed only if both ends share none of the 32 buckets: (1 - 0.8 ** 4) ** 32, or 5e-8, at a similarity of 0.8.
    """
    return _judged(docs, id_col, text_col, size, percent).drop("th")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns: one document of each component. Rows without an id stay. Of
    rows that repeat an id with other texts each is judged by its own text; with the same text they stay or go together."""
    lost = stored(_judged(docs, id_col, text_col, size, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__lost"), F.col("th").alias("__lost_text")).distinct(), "near-lost")
    return docs.join(maybe_broadcast(lost, 96), (docs[id_col].cast("long") == lost["__lost"]) & (F.xxhash64(docs[text_col].cast("string")) == lost["__lost_text"]), "left_anti")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of documents, on four-word shingles; nulls, repeats and empty tables as there."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=4)
