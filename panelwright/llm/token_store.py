"""A content-addressed store of token ids.

A document's ids end with an end id and are cut where a rolling hash of the last 32 ids says so, so equal passages give
equal chunks wherever they stand. A store is three tables in one folder:

    chunks    digest (SHA-256 of payload), n, payload: the ids as little-endian integers of 2 or 4 bytes; each chunk once
    recipes   part, pos, doc_id, start, n_tokens, digests, lens, root: documents in ascending doc_id order, null first.
              part is the range of doc_ids, pos the place within it; start counts the ids of all documents before
    manifest  part, docs, ids, root: Merkle roots of each part's documents; the row with part -1 is that of all parts

Readers check payloads against digests, digests against roots, and roots against the manifest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, read_table, shared_path, small_batches, stored
from .tokens import pretokens, split_texts, text_parts, tokenizer, vocabulary_path

END_ID = 1
#: Least and most ids of a chunk but a document's last, and bits that the rolling hash must have zero: 512 ids on average.
LEAST, MOST, BITS = 128, 2048, 9
#: Pre-tokens that a worker remembers in each of two generations, some 200 bytes each, beside other stages and where it does nothing else. It decides
#: the speed only.
KNOWN, KNOWN_ALONE = 100_000, 600_000
#: Bytes of text that a worker handles at once, beside other stages and where it does nothing else: it takes some 25 times as many meanwhile.
SLICE, SLICE_ALONE = 1 << 20, 4 << 20
#: Digests of sent chunks that a task remembers: some 25 MB.
SENT = 200_000
#: A chunk that a task has not sent before, with a number that no other chunk row has.
NEW = pa.list_(pa.struct([("cid", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())]))


def _gear(n: int) -> np.ndarray:
    x = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def cut_points(ids: np.ndarray, ends: np.ndarray, gear: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document; the documents' ids stand one after another and end at `ends`."""
    h = gear[ids]
    for s in (1, 2, 4, 8, 16):  # h then covers 2 * s ids, each shifted by its distance
        h[s:] += h[:-s] << np.uint32(s)
    marks = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    out, at, begin = [], 0, 0
    for end in ends.tolist():
        cuts, last = [], begin
        while at < len(marks) and marks[at] < end:
            m = int(marks[at])
            at += 1
            if m - last >= LEAST:
                while m - last > MOST:
                    last += MOST
                    cuts.append(last)
                if m - last >= LEAST:
                    cuts.append(last := m)
        while end - last > MOST:
            last += MOST
            cuts.append(last)
        out.append([*cuts, end] if end > last else cuts)
        begin = end
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node goes up alone; the root of nothing is the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\x01" + leaves[i] + leaves[i + 1]).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def _width(path: str) -> str:
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def _chunked(batches: Iterator[pa.RecordBatch], path: str, end_id: int, known_words: int = KNOWN, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches and the chunks of each of their documents."""
    width = _width(path)
    size, end = int(width[2]), np.array([end_id], width).tobytes()

    def packed(ids: np.ndarray, stops: np.ndarray) -> list[bytes]:
        data, stops = ids.astype(width).tobytes(), (stops * size).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    known = pretokens(path, width, packed, size=known_words)
    gear = _gear(max(tokenizer(path).get_vocab_size(), end_id + 1))
    for part, texts in text_parts(batches, most=most):
        words, at, n = split_texts(texts)
        values = [*known.values_of(words), end]
        at = np.insert(at, np.cumsum(n), len(words))  # the end id is a word after each text's last
        lens = np.array(list(map(len, values)), np.int64) // size
        begins, each = np.cumsum(lens) - lens, lens[at]
        upto = np.cumsum(each)
        ids = np.frombuffer(b"".join(values), width)[np.arange(int(upto[-1])) + np.repeat(begins[at] - upto + each, each)]
        data, begin, found = ids.tobytes(), 0, []
        for cuts in cut_points(ids, upto[np.cumsum(n + 1) - 1], gear):
            pieces = []
            for c in cuts:
                pieces.append(data[begin * size : c * size])
                begin = c
            found.append(pieces)
        yield part, found


def write_store(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, known_words: int = KNOWN, most: int = SLICE) -> None:
    """Encodes every row of docs into a new store at path.

    Null texts are empty: their only id is the end id. Rows that share an id stand in the order of their ids' digests; equal
    rows are both stored. An empty table gives a store without documents. Only the named columns are read.
    """
    spark = docs.sparkSession
    small_batches(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = int(_width(tokenizer_path)[2])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # bounded; whatever this or another task sends again is dropped below
        at = TaskContext.get().partitionId() << 40
        for part, found in _chunked(batches, tokenizer_path, end_id, known_words, most):
            digests, lens, new = [], [], []
            for pieces in found:
                digests.append([hashlib.sha256(p).digest() for p in pieces])
                lens.append([len(p) // size for p in pieces])
                new.append([])
                for d, p in zip(digests[-1], pieces, strict=True):
                    if d not in sent:
                        sent.add(d)
                        new[-1].append({"cid": at, "digest": d, "n": len(p) // size, "payload": p})
                        at += 1
            if len(sent) > SENT:
                sent.clear()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(sum, lens), pa.int64()), pa.array(digests, pa.list_(pa.binary())), pa.array(lens, pa.list_(pa.int32())), pa.array(map(merkle, digests), pa.binary()), pa.array(new, NEW)], names=["doc_id", "n_tokens", "digests", "lens", "root", "new"])

    # texts are encoded once; what the tables below read from here are columns of files
    encoded = stored(rows.mapInArrow(encode, f"doc_id {kind}, n_tokens long, digests array<binary>, lens array<int>, root binary, new array<struct<cid:long,digest:binary,n:int,payload:binary>>"), "encoded")
    names = encoded.select(F.explode_outer(F.arrays_zip("new.cid", "new.digest")).alias("c")).select("c.*").toDF("cid", "digest").where("cid is not null")
    again = stored(names.groupBy("digest").agg(F.min("cid").alias("first"), F.count("*").alias("n")).where("n > 1"), "again")
    spare = stored(names.join(maybe_broadcast(again, 64), "digest").where("cid <> first").select("cid"), "spare")
    chunks = encoded.select(F.explode_outer("new").alias("c")).select("c.*").where("cid is not null")
    chunks.join(maybe_broadcast(spare, 16), "cid", "left_anti").drop("cid").write.option("compression", "zstd").parquet(f"{path}/chunks")
    loose = encoded.drop("new")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # all columns of the order but the wide ones are in the ranges: equal doc_ids may be split between two parts, in order
    ranged = stored(loose.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("root")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root").withColumn("part", F.spark_partition_id()).mapInArrow(_placed, f"part int, pos long, doc_id {kind}, begin long, n_tokens long, digests array<binary>, lens array<int>, root binary"), "ranged")
    totals = sorted(ranged.groupBy("part").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("docs")).collect())  # one row a part
    starts = spark.createDataFrame([(t["part"], sum(x["ids"] for x in totals[:i])) for i, t in enumerate(totals)], "part int, before long")
    placed = ranged.join(F.broadcast(starts), "part").withColumn("start", F.col("begin") + F.col("before")).select("part", "pos", "doc_id", "start", "n_tokens", "digests", "lens", "root")
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    _roots(spark, path).write.parquet(f"{path}/manifest")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place and the ids before it within its part."""
    pos = ids = 0
    for b in batches:
        n = b.column("n_tokens").to_numpy()
        upto = np.cumsum(n)
        yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(np.arange(pos, pos + len(n))), b.column("doc_id"), pa.array(upto - n + ids), *(b.column(c) for c in ("n_tokens", "digests", "lens", "root"))], names=["part", "pos", "doc_id", "begin", "n_tokens", "digests", "lens", "root"])
        pos, ids = pos + len(n), ids + int(upto[-1]) if len(n) else ids


class _Tree:
    """merkle() of leaves that come one by one: memory of the tree's height. At level i waits at most one node."""

    def __init__(self):
        self.waiting: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for i, w in enumerate(self.waiting):
            if w is None:
                self.waiting[i] = node
                return
            node, self.waiting[i] = hashlib.sha256(b"\x01" + w + node).digest(), None
        self.waiting.append(node)

    def root(self) -> bytes:
        node = None
        for w in self.waiting:
            if w is not None:
                node = w if node is None else hashlib.sha256(b"\x01" + w + node).digest()
        return hashlib.sha256(b"").digest() if node is None else node


def _roots(spark: SparkSession, path: str) -> DataFrame:
    """The manifest that the recipes call for."""
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "pos", "n_tokens", "digests", "root")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for part, n, digests, root in zip(*(b.column(c).to_pylist() for c in ("part", "n_tokens", "digests", "root")), strict=True):
                t = found.setdefault(part, [_Tree(), 0, 0])
                if merkle(digests) != root:
                    raise ValueError(f"part {part} has a recipe that differs from its root")
                t[0].add(root)
                t[1] += 1
                t[2] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([t[1] for t in found.values()], pa.int64()), pa.array([t[2] for t in found.values()], pa.int64()), pa.array([t[0].root() for t in found.values()], pa.binary())], names=["part", "docs", "ids", "root"])

    each = sorted(recipes.repartition(parts, "part").sortWithinPartitions("part", "pos").mapInArrow(trees, "part int, docs long, ids long, root binary").collect())
    every = (-1, sum(r["docs"] for r in each), sum(r["ids"] for r in each), merkle([bytes(r["root"]) for r in each]))
    return spark.createDataFrame([every, *map(tuple, each)], "part int, docs long, ids long, root binary").coalesce(1)


#: CRC-32 polynomial in reflected order, as zlib has it.
POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC polynomial; the highest bit is the constant term."""
    out, b = np.zeros_like(a), b.copy()
    for i in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(i) & np.uint32(1), b, np.uint32(0))
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return out


def _powers(counts: np.ndarray) -> np.ndarray:
    """x to the power 8 * count."""
    out, base = np.full(len(counts), 1 << 31, np.uint32), np.array([1 << 23], np.uint32)
    left = counts.astype(np.int64).copy()
    while left.any():
        odd = left & 1 == 1
        out[odd] = _times(out[odd], np.broadcast_to(base, odd.sum()).copy())
        base, left = _times(base, base), left >> 1
    return out


@cache
def _shifts() -> np.ndarray:
    """x to the power 8 * 4 * n for chunks of n ids."""
    return _powers(4 * np.arange(MOST + 1))


def combined_crc32(crcs: np.ndarray, lens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32 of each document's chunks joined, from the chunks' CRCs and numbers of ids; offsets say where documents begin, and the end.

    Neighbours are joined in pairs until a document has one part left, all documents at once.
    """
    crc, shift, size = crcs.astype(np.uint32), _shifts()[lens], np.diff(offsets)
    while size.max(initial=0) > 1:
        doc = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(crc)) - np.repeat(np.cumsum(size) - size, size)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < size[doc]))
        crc[left] = _times(crc[left], shift[left + 1]) ^ crc[left + 1]
        shift[left] = _times(shift[left], shift[left + 1])
        stay = place % 2 == 0
        crc, shift, size = crc[stay], shift[stay], (size + 1) // 2
    out = np.zeros(len(size), np.uint32)
    out[size == 1] = crc
    return out


def read_store(spark: SparkSession, path: str, width: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files. CRCs are of the ids as little-endian 4-byte integers.

    Each chunk is read once and checked against its digest; documents follow from the chunks their recipes name, by combining
    CRCs, so payloads are not moved. Raises if the manifest, a root, a digest, a length or a chunk does not fit.
    """
    kept = {r["part"]: bytes(r["root"]) for r in spark.read.parquet(f"{path}/manifest").collect()}
    if kept != {r["part"]: bytes(r["root"]) for r in _roots(spark, path).collect()}:
        raise ValueError(f"the manifest of {path} differs from its recipes")
    size = int(width[2])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, digests = b.column("payload").to_pylist(), b.column("digest").to_pylist()
            if any(hashlib.sha256(p).digest() != d for p, d in zip(payloads, digests, strict=True)):
                raise ValueError("a chunk differs from its digest")
            crcs = [zlib.crc32(np.frombuffer(p, width).astype("<u4").tobytes()) for p in payloads]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([len(p) // size for p in payloads], pa.int32()), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])

    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "payload").mapInArrow(sums, "digest binary, n int, crc long")
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "pos", "doc_id", "start", "n_tokens", "digests", "lens")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    named = recipes.select("part", "pos", F.posexplode(F.arrays_zip("digests", "lens")).alias("seq", "c")).select("part", "pos", "seq", F.col("c.digests").alias("digest"), F.col("c.lens").alias("planned"))
    lists = named.join(chunks, "digest", "left").groupBy("part", "pos").agg(F.array_sort(F.collect_list(F.struct("seq", "planned", "n", "crc"))).alias("chunks"))
    whole = recipes.drop("digests", "lens").join(lists, ["part", "pos"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("chunks")
            parts = lists.flatten()
            offsets = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            lens, crcs = parts.field("n"), parts.field("crc")
            ok = not lens.null_count and lens.to_pylist() == parts.field("planned").to_pylist()
            n = np.diff(np.append(0, np.cumsum(lens.to_numpy(zero_copy_only=False)))[offsets]) if ok else None
            if not ok or n.tolist() != b.column("n_tokens").to_pylist():
                raise ValueError("a recipe names a chunk that is missing or of another length")
            crc = combined_crc32(crcs.to_numpy(zero_copy_only=False), lens.to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(n.astype(np.int64)), pa.array(crc.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.select("doc_id", "start", "n_tokens", "chunks").mapInArrow(documents, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, width: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id and ids (array of int) of the documents that doc_ids names, put together from their chunks. A null id names the documents
    without one; an id that several rows have gives each of them."""
    recipes, names = spark.read.parquet(f"{path}/recipes"), doc_ids.select(F.col("doc_id").alias("__id")).distinct()
    wanted = recipes.join(names, recipes["doc_id"].eqNullSafe(names["__id"]), "left_semi")
    named = wanted.select("part", "pos", "doc_id", F.posexplode("digests").alias("seq", "digest")).join(spark.read.parquet(f"{path}/chunks"), "digest")
    lists = named.groupBy("part", "pos", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("chunks")).select("doc_id", F.col("chunks.payload").alias("payloads"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x), width).astype(np.int32) for x in b.column("payloads").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return lists.mapInArrow(joined, f"doc_id {wanted.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def token_store(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, known_words: int = KNOWN, most: int = SLICE) -> DataFrame:
    """Writes docs to a new store in the shared folder and returns what read_store() finds there; nulls, repeats and empty tables as in
    write_store()."""
    path = shared_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer_path, id_col, text_col, end_id, known_words, most)
    return read_store(docs.sparkSession, path, _width(tokenizer_path))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_store() of documents; nulls, repeats and empty tables as there."""
    return token_store(read_table(spark, sf_dir, "documents"), vocabulary_path(), known_words=KNOWN_ALONE, most=SLICE_ALONE)
