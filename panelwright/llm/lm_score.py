"""Cross-entropy difference of two matched word bigram models.

The target model is counted from the target documents, the background model from all. Both have the same vocabulary (every word of any
document), the same order and the same smoothing: a word's probability after another is (k c(a, b) + MU share(b)) / (k c(a) + MU), share(b) being
(k c(b) + 1) / (k N + V). k is 1 for the target and, for the background, the target's words over all words, so that both models rest on as
many words and the prior weighs alike. A document is scored by models that have not counted it: its own counts are taken
off first. Its score is the mean over its words of the difference of the models' log probabilities: how much better the target model foresees it.

Nothing is left out and no table of the corpus is held in one place, so what is counted grows with the input. Words and pairs are 64-bit keys, and each
key has its place in one of many blocks:

    1  Documents are dealt into groups. For each group and block, tasks send the distinct keys and their counts, packed and sorted.
    2  Blocks add up what all groups sent and answer each group with the totals of its keys, in the order of the keys.
    3  The texts of a group meet the answers of all blocks; the group finds its keys again, in order, and scores its documents.

Sums of words and the size of the vocabulary, one row a block, are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import maybe_broadcast, read_table, small_batches, stored
from .tokens import split_runs, text_parts

#: Words' worth of the share of all words in what follows a word.
MU = 20.0
#: Documents of a group, and bytes of text from which it is split.
GROUP, GROUP_BYTES = 2048, 32 << 20
#: Keys that a task holds before it sends them, and least number of blocks.
FLUSH, BLOCKS = 2_000_000, 64
U64 = np.uint64
#: ASCII marks and white space separate words; A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: The key of a text's beginning; as those of pairs it is odd, while keys of words are even.
START = U64(0x5851F42D4C957F2D)


def keys_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the distinct words of the texts, the number among them of each word in turn, the key of each word with the one before it, and how many
    words each text has. A text's first word follows START."""
    folded = pa.array([t.translate(FOLD) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
    words, at, n = split_runs(folded)
    key = _mixed(pd.util.hash_array(np.array([*words, b""], object), categorize=False)[:-1]) & ~U64(1)
    mine = key[at]
    before = np.empty_like(mine)
    before[1:] = mine[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = START
    return key, at, _mixed(before * U64(0x9E3779B97F4A7C15) + mine * U64(0xC2B2AE3D27D4EB4F)) | U64(1), n


def _counted(keys: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, how many there are with target, and how many in all."""
    out, total = np.unique(keys, return_counts=True)
    some, n = np.unique(keys[target], return_counts=True)
    mine = np.zeros(len(out), np.int64)
    mine[np.searchsorted(out, some)] = n
    return out, mine, total


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32 if a.max(initial=0) < 1 << 32 else np.uint64)


def _message(group: list[int], block: list[int], width: list[int], body: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(block, pa.int32()), pa.array(width, pa.int32()), pa.array(body, pa.binary())], names=["part", "block", "width", "body"])


def _spread_keys(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys by place of the byte, so that like bytes stand together."""
    return np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.copy()


def _keys_back(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(U64)[:, 0], dtype=U64)


def _requests(marked: DataFrame, bits: int) -> DataFrame:
    """part, block, width, body: keys and counts (8 bytes of each key, width of each count) that the documents of a group have in a block."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        n_held = 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal n_held
            for part, found in held.items():
                keys, mine, total = _added(*(np.concatenate([x[i] for x in found]) for i in range(3)))
                edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits))
                ends = [0, *edges.tolist(), len(keys)]
                rows = []
                for b, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
                    if j > i:
                        t, a = _narrow(mine[i:j]), _narrow(total[i:j])
                        wide = max(t.itemsize, a.itemsize)
                        rows.append((b, wide, _packed(_spread_keys(keys[i:j]), t.astype(f"u{wide}"), a.astype(f"u{wide}"))))
                yield _message([part] * len(rows), *([r[i] for r in rows] for i in range(3)))
            held.clear()
            n_held = 0

        for batch, texts in text_parts(batches):
            parts, target = batch.column("part").to_numpy(), np.array(batch.column("target").to_pylist(), bool)
            key, at, pairs, n = keys_of(texts)
            some = n > 0
            of = np.concatenate([np.repeat(parts, n)] * 2 + [parts[some]])
            marks = np.concatenate([np.repeat(target, n)] * 2 + [target[some]])
            keys = np.concatenate([key[at], pairs, np.full(int(some.sum()), START)])
            for part in np.unique(of).tolist():
                m = of == part
                found = _counted(keys[m], marks[m]) if not m.all() else _counted(keys, marks)
                held.setdefault(part, []).append(found)
                n_held += len(found[0])
            if n_held > FLUSH:
                yield from send()
        yield from send()

    return marked.mapInArrow(ask, "part long, block int, width int, body binary")


def _added(keys: np.ndarray, mine: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    if not len(first):
        return keys, mine, total
    return keys[first], np.add.reduceat(mine[order], first), np.add.reduceat(total[order], first)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each group's keys, in order; and per block the words of the target, all words and the distinct ones."""
    held: dict[int, list] = {}
    for b in batches:
        for part, block, wide, body in zip(*(b.column(c).to_pylist() for c in ("part", "block", "width", "body")), strict=True):
            held.setdefault(block, []).append((part, wide, body))
    for block, rows in held.items():
        asked: dict[int, list] = {}
        for part, wide, body in rows:
            data = zstandard.decompress(body)
            n = len(data) // (8 + 2 * wide)
            mine, total = np.frombuffer(data, f"u{wide}", 2 * n, 8 * n).reshape(2, n).astype(np.int64)
            asked.setdefault(part, []).append((_keys_back(data[: 8 * n]), mine, total))
        rows.clear()
        keys, mine, total = _added(*(np.concatenate([x[i] for found in asked.values() for x in found]) for i in range(3)))
        words = keys & U64(1) == 0
        yield _answer(-1, block, 8, b"", int(mine[words].sum()), int(total[words].sum()), int(words.sum()))
        for part, found in asked.items():
            own = found[0][0] if len(found) == 1 else np.unique(np.concatenate([x[0] for x in found]))
            at = np.searchsorted(keys, own)
            t, a = _narrow(mine[at]), _narrow(total[at])
            wide = max(t.itemsize, a.itemsize)
            yield _answer(part, block, wide, _packed(t.astype(f"u{wide}"), a.astype(f"u{wide}")), 0, 0, 0)


_ANSWER = "part long, block int, width int, body binary, target_words long, words long, distinct_words long"


def _answer(part: int, block: int, wide: int, body: bytes, *sums: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*_message([part], [block], [wide], [body]).columns, *(pa.array([x], pa.int64()) for x in sums)], names=["part", "block", "width", "body", "target_words", "words", "distinct_words"])


def _own(doc: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """How often each item's document has it."""
    _, back, n = np.unique(doc * most + at, return_inverse=True, return_counts=True)
    return n[back]


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, U64)


def _losses(texts: pa.Table, answers: pa.Table, sums: tuple[int, int, int], mu: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a group's texts, the words of each text and its mean losses (columns target, background)."""
    slices = [(batch, *keys_of(text)) for batch, text in text_parts(texts.to_batches(), most=1 << 20)]
    every = _distinct([_distinct([key, pairs, np.full(int(n.any()), START)]) for _, key, _, pairs, n in slices])
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("block", "width", "body")), strict=True))
    counts = [np.frombuffer(zstandard.decompress(body), f"u{wide}").reshape(2, -1) for _, wide, body in rows]
    counts = np.concatenate(counts, axis=1) if counts else np.empty((2, 0), np.uint32)
    if counts.shape[1] != len(every):
        raise ValueError(f"{len(every)} keys were asked for and {counts.shape[1]} answered: the documents changed between two reads")
    for batch, key, at, pairs, n in slices:
        yield batch, n, _slice_losses(key, at, pairs, n, np.array(batch.column("target").to_pylist(), bool), every, counts, sums, mu)


def _slice_losses(key: np.ndarray, at: np.ndarray, pairs: np.ndarray, n: np.ndarray, target: np.ndarray, every: np.ndarray, counts: np.ndarray, sums: tuple[int, int, int], mu: float) -> np.ndarray:
    out = np.zeros((len(n), 2))
    if not len(at):
        return out
    pair, pair_at = np.unique(pairs, return_inverse=True)
    doc = np.repeat(np.arange(len(n)), n)
    of_pair, of_word = (counts[:, np.searchsorted(every, x)].astype(float) for x in (pair, key))
    own_pair, own_word = _own(doc, pair_at, len(pair)), _own(doc, at, len(key))
    first = (np.cumsum(n) - n)[n > 0]
    context, own_context = np.empty((2, len(at))), np.empty(len(at))
    context[:, 1:], own_context[1:] = of_word[:, at[:-1]], own_word[:-1]
    context[:, first], own_context[first] = counts[:, [np.searchsorted(every, START)]], 1
    target_words, words, vocabulary = sums
    for j, (k, total, off) in enumerate(((1.0, target_words, target[doc].astype(float)), (target_words / max(words, 1), words, np.ones(len(at))))):
        share = (k * (of_word[j, at] - off * own_word) + 1) / (k * (total - off * n[doc]) + vocabulary)
        logs = np.log((k * (of_pair[j, pair_at] - off * own_pair) + mu * share) / (k * (context[j] - off * own_context) + mu))
        out[n > 0, j] = -np.add.reduceat(logs, first) / n[n > 0]
    return out


def _grouped(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, target) with part, the group. Groups are ranges of ids, or of their hashes where ids are no whole numbers or too far apart; those with
    very much text are split by hashes of id and text. Sizes are counted first."""
    by_hash = lambda n: F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n)))
    of: Column | None = F.coalesce(F.floor(F.col("doc_id") / GROUP), F.lit(-1)) if isinstance(docs.schema["doc_id"].dataType, IntegralType) else None
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    count = lambda of: stored(docs.groupBy(of.cast("long").alias("part")).agg(F.sum(length).alias("bytes"), F.count("*").alias("docs")), "lm-groups")
    sizes = count(of) if of is not None else None
    total = sizes.agg(F.count("*"), F.sum("docs")).first() if sizes is not None else (0, docs.count())
    if sizes is None or total[0] > 16 + 2 * (total[1] or 0) // GROUP:
        of = by_hash((total[1] or 0) // GROUP)
        sizes = count(of)
    large = stored(sizes.where(F.col("bytes") > GROUP_BYTES).select(F.col("part").alias("large"), F.ceil(F.col("bytes") / GROUP_BYTES).cast("long").alias("pieces")), "lm-large")
    out = docs.withColumn("part", of.cast("long"))
    if large.isEmpty():
        return out
    out = out.join(maybe_broadcast(large, 24), F.col("part") == F.col("large"), "left")
    piece = F.pmod(F.xxhash64("doc_id", "text"), F.coalesce("pieces", F.lit(1)))
    return out.withColumn("part", F.when(F.col("pieces").isNull(), F.col("part")).otherwise(F.xxhash64("part", piece))).drop("large", "pieces")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "doc_id", mu: float = MU) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score for every row of docs; targets names the target documents by id.

    Losses are mean negative log probabilities of a word under models that have not counted the row itself; score is background_loss -
    target_loss. Texts without words, null ones too, have null losses and score. Without target documents both models are flat and scores
    are 0. Repeated rows each count and each give a row; a copy is not the row itself. Null ids are never targets.
    An empty table gives an empty result. Only the named columns are read.
    """
    small_batches(docs)
    ids = targets.select(F.col(target_id).alias("__target")).where("__target is not null").distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    grouped = _grouped(rows)
    marked = grouped.join(maybe_broadcast(ids, 24), F.col("doc_id") == F.col("__target"), "left").select("part", "doc_id", "text", F.col("__target").isNotNull().alias("target"))
    blocks = max(BLOCKS, 2 * rows.rdd.getNumPartitions())
    bits = min(16, (blocks - 1).bit_length())
    answers = stored(_requests(marked, bits).repartitionById(1 << bits, F.col("block")).mapInArrow(_answers, _ANSWER), "lm-answers")
    sums = tuple(int(x or 0) for x in answers.agg(F.sum("target_words"), F.sum("words"), F.sum("distinct_words")).first())

    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "target_loss", "background_loss", "score"]

    def score(texts: pa.Table, answered: pa.Table) -> pa.Table:
        done = []
        for batch, n, loss in _losses(texts, answered, sums, mu):
            columns = [pa.array(x, pa.float64(), mask=n == 0) for x in (loss[:, 0], loss[:, 1], loss[:, 1] - loss[:, 0])]
            done.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *columns], names=names))
        if not done:  # answers without texts there are none
            return pa.Table.from_arrays([texts.column("doc_id"), *(pa.array([], t) for t in (pa.int64(), *[pa.float64()] * 3))], names=names)
        return pa.Table.from_batches(done)

    replies = answers.where("part is not null and body <> X''").select(F.col("part"), "block", "width", "body")
    return marked.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(score, f"doc_id {kind}, n_words long, target_loss double, background_loss double, score double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that labels call of quality 1 are the target; nulls, repeats and empty tables as in cross_entropy_difference()."""
    return cross_entropy_difference(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").where("quality = 1"))
