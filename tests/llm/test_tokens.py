import subprocess
import sys
import zlib

import numpy as np
import pytest

from panelwright.llm import token_store, tokens
from panelwright.llm.tokens import token_counts, tokenizer, vocabulary_path

TEXTS = ["Hello, World's  end\tit's", None, "", " \n", "a\x1cb\x1d c\x85d e f", "<|endoftext|>x <|startoftext|> y<|END", "ΑΣ ΑΣ' Straße É é ́x", "tea" * 5000, "word " * 4000 + "last", "日本語 テキスト 123 4½ ²", "İ ı ſ K", "hello, world's", "word " * 3000, "'super ('tis \"quoted\", 's' don't' (it's) ##x## <|startoftext|> <|x <|startoftext|>. -a- ÿ- $ª", "word, ###word ### " * 40]


@pytest.fixture
def docs(spark):
    rows = [(i * 3 - 5, t, i, "y") for i, t in enumerate(TEXTS)] + [(None, "no id", 0, "y"), (1, "repeated", 0, "y"), (1, "repeated", 0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, start string").repartition(3), rows


def test_counts_match_the_library(docs):
    path = vocabulary_path()
    frame, rows = docs
    t = tokenizer(path)
    want = sorted([(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x, *_ in rows], key=str)
    assert sorted(map(tuple, token_counts(frame, path).collect()), key=str) == want
    assert sorted(map(tuple, token_counts(frame, path, frequent=3).collect()), key=str) == want
    assert token_counts(frame.limit(0), path).count() == 0


def test_store_round_trip(spark, docs, tmp_path):
    path = vocabulary_path()
    frame, rows = docs
    t = tokenizer(path)
    store = f"file://{tmp_path}/store"
    token_store.write_store(frame, store, path)
    got = sorted(map(tuple, token_store.read_store(spark, store, "<u2").collect()), key=lambda r: r[1])
    ids = {}
    for i, x, *_ in rows:
        ids.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    start, order = 0, [r[0] for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x)) and len(got) == len(rows)
    for i, at, n, crc in got:
        assert at == start
        assert (n, crc) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[i]]
        start += n
    back = {r["doc_id"]: r["ids"] for r in token_store.read_ids(spark, store, "<u2", spark.createDataFrame([(19,), (-5,)], "doc_id long")).collect()}
    assert back == {i: ids[i][0] for i in (19, -5)}
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert chunks.agg({"n": "sum"}).first()[0] < start - 2000  # the long repeated texts share a chunk
    whole = spark.read.parquet(f"{store}/chunks").collect()
    spark.createDataFrame([(r["digest"], r["n"], bytes(r["payload"])[:-1] + b"\x07") for r in whole], chunks.schema).write.mode("overwrite").parquet(f"{store}/chunks2")
    spark.read.parquet(f"{store}/chunks2").write.mode("overwrite").parquet(f"{store}/chunks")
    with pytest.raises(Exception, match="differs from its digest"):
        token_store.read_store(spark, store, "<u2").collect()


def test_empty_store(spark, docs, tmp_path):
    frame, _ = docs
    token_store.write_store(frame.limit(0), f"file://{tmp_path}/none", vocabulary_path())
    assert token_store.read_store(spark, f"file://{tmp_path}/none", "<u2").count() == 0


def test_cuts_follow_content():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 49000, 9000), r.integers(0, 49000, 700)
    gear = token_store._gear(49408)
    both = np.concatenate([a, b, a])
    cuts = token_store.cut_points(both, np.array([len(a), len(both)]), gear)
    sizes = [np.diff([begin, *c]) for begin, c in zip((0, len(a)), cuts, strict=True)]
    assert all(s[:-1].min() >= token_store.LEAST and s.max() <= token_store.MOST for s in sizes)
    ends = {len(a) + len(b) + c for c in cuts[0]}
    assert len(ends & set(cuts[1])) >= len(ends) - 3
    leaves = [bytes([i]) for i in range(11)]
    for n in range(12):
        tree = token_store._Tree()
        for x in leaves[:n]:
            tree.add(x)
        assert tree.root() == token_store.merkle(leaves[:n])


def test_combined_crcs():
    r = np.random.default_rng(2)
    sizes = [1, 2, 3, 7, 1, 120, 0, 64]
    lens = r.integers(1, token_store.MOST + 1, sum(sizes))
    parts = [r.integers(0, 49000, n).astype("<u4").tobytes() for n in lens]
    offsets = np.append(0, np.cumsum(sizes))
    got = token_store.combined_crc32(np.array([zlib.crc32(p) for p in parts]), lens, offsets)
    assert got.tolist() == [zlib.crc32(b"".join(parts[a:b])) for a, b in zip(offsets, offsets[1:])]


def test_calls_of_the_library_are_bounded():
    path, most = vocabulary_path(), []

    class Watched:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **how):
            most.append(sum(len(x.split()) for x in texts))
            return self.library.encode_batch_fast(texts, **how)

    words = [w for i in range(20_000) for w in (f"{i}é日".encode(), "".join(chr(97 + int(c)) for c in str(i)).encode())]
    known = tokens.PreTokens(path, tokens.piece_lengths)
    known.library, known.fast = Watched(known.library), Watched(known.fast)
    assert known.values_of(words) == [len(x) for x in tokenizer(path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
    assert sum(most) >= len(words) and max(most) <= 1 << 13


#: How many MB more than before a process takes at most while it makes chunks of 4,000 texts, and the digest of the chunks.
WORKER = """
import hashlib, random, resource
import pyarrow as pa
from panelwright.llm import token_store, tokens
r = random.Random(3)
texts = [" ".join("".join(r.choices("abcdefghijklmnopé1", k=r.randrange(2, 8))) for _ in range(500)) for _ in range(4000)]
batches = [pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts[i : i + 1000])], names=["doc_id", "text"]) for i in range(0, 4000, 1000)]
top = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
before, digest = top(), hashlib.sha256()
for part, found in token_store._chunked(iter(batches), tokens.vocabulary_path(), 1):
    for pieces in found:
        digest.update(b"".join(pieces) + b".")
print(top() - before, digest.hexdigest())
"""


def test_memory_of_a_worker_beside_other_stages():
    mb, digest = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True).stdout.split()
    assert int(mb) < 150
    assert digest == "e5bafa384c8938968897f34e3c109c5daf6a52ace8d2a6db2e40673887ab20fb"  # the chunks that slices of 4 MB gave
