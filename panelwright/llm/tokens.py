"""Token counts by a two-tier lookup on the map side.

The tokenizer (word BPE, which drops white space) never joins text across ASCII white space, so a text's tokens are
those of its white-space runs (pre-tokens) in turn. The first tier is a table of the corpus's frequent pre-tokens and their lengths, of fixed size,
broadcast once. What it lacks is encoded by the library and kept in a bounded cache of the Python worker. Pre-tokens
are never shuffled: to find the frequent ones each task makes one row of its FREQUENT_PER_TASK most frequent, and such rows are merged,
MERGED at a time, until few are left for the driver. The table decides how fast a pre-token is counted, never its count.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches

FREQUENT, FREQUENT_PER_TASK, MERGED = 1 << 16, 1 << 13, 64
#: Entries of a generation of a worker's cache; longer pre-tokens than LONG bytes are not kept.
CACHE, LONG = 250_000, 64
#: Rows, and bytes of text, that a worker handles at once.
ROWS, BYTES = 256, 4 << 20


@cache
def tokenizer(path: str):
    """The library's tokenizer of a JSON file; one a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_rows(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the UTF-8 of their texts, empty for null."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]


#: ASCII marks, a run of Latin letters, ASCII marks. Each of the three runs is a pre-token whatever stands around the whole; an
#: apostrophe before letters may join them, so it does not count as a mark there.
WORD = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-/:-@\[-`{-~]*)").fullmatch
#: How special strings begin, which the library takes as they are.
SPECIAL = b"<|"
#: Words in one string for the library, and words in one call: what it returns of a word takes some hundred times the word's bytes.
JOINED, BATCH = 128, 1 << 13


def piece_lengths(ids: np.ndarray, stops: np.ndarray) -> list[int]:
    return np.diff(stops, prepend=0).tolist()


def text_parts(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their texts, empty for null: about `most` bytes of text, or one row."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        turn = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        begin = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(begin, begin[1:], strict=False):
            yield batch.slice(a, b - a), texts.slice(a, b - a)


def split_texts(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of the texts, the number among them of each pre-token in turn, and how many each text has.

    The tokenizer lower-cases; doing so for A-Z beforehand makes fewer of them, but could make special strings.
    """
    return split_runs(pc.if_else(pc.match_substring(texts, SPECIAL.decode()), texts, pc.ascii_lower(texts)))


def split_runs(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct runs of the texts between ASCII white space, the number among them of each run in turn, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    flat, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty string there
    if not some.all():
        n = np.bincount(np.repeat(np.arange(len(n)), n)[some], minlength=len(n))
        flat = flat.filter(pa.array(some))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False), n


class PreTokens(dict):
    """What `of` makes of the token ids of a pre-token: a fixed tier and a bounded one of two generations.

    of(ids, stops) gives the values of the pieces of the array ids that end at stops; values add up as their ids are joined.
    Words of letters are encoded many at a time, by word_tokenizer().
    """

    def __init__(self, path: str, of, fixed: dict | None = None, size: int = CACHE):
        super().__init__(fixed or {})
        self.size = size
        self.library, self.of, self.fixed, self.marks, self.old = tokenizer(path), of, fixed or {}, {}, {}
        self.fast, self.ends = word_tokenizer(path)

    def values_of(self, words: list[bytes]) -> list:
        """The values of distinct pre-tokens; unknown ones are encoded together."""
        found = list(map(self.get, words))
        holes = [i for i, v in enumerate(found) if v is None]
        if len(self) + len(holes) > len(self.fixed) + self.size:
            self.old = {w: v for w, v in self.items() if w not in self.fixed} if self.fixed else dict(self)
            self.clear()
            self.update(self.fixed)
        new = [words[i] for i in holes]
        if self.old:  # words of the generation before come along as they are met
            self.update((w, v) for w in new if (v := self.old.get(w)) is not None)
            new = [w for w in new if w not in self]
        self._learn(new)
        for i in holes:
            found[i] = self[words[i]]
        for w in new:
            if len(w) > LONG:
                del self[w]
        return found

    def _learn(self, new: list[bytes]) -> None:
        words, marked, rest = [], [], []
        if self.fast is None:
            rest = new
        else:
            for w in new:
                if w.isalpha():
                    words.append(w)
                elif SPECIAL not in w and (m := WORD(w.decode())):
                    marked.append((w, m[1], m[2].encode(), m[3]))
                else:
                    rest.append(w)
            words += {core for _, _, core, _ in marked if core not in self}.difference(words)
        for i in range(0, len(words), BATCH):
            self._words(words[i : i + BATCH])
        for w, before, core, after in marked:
            value = self[core]
            if before:
                value = self._mark(before) + value
            self[w] = value + self._mark(after) if after else value
        self.update(zip(rest, self._each([w.decode() for w in rest]), strict=True))

    def _each(self, words: list[str]):
        values = []
        for i in range(0, len(words), BATCH):
            found = [e.ids for e in self.library.encode_batch_fast(words[i : i + BATCH], add_special_tokens=False)]
            values += self.of(np.array([i for x in found for i in x], np.int64), np.cumsum([len(x) for x in found], dtype=np.int64))
        return values

    def _mark(self, mark: str):
        if mark not in self.marks:
            if len(self.marks) > 1 << 16:
                self.marks.clear()
            self.marks[mark] = self._each([mark])[0]
        return self.marks[mark]

    def _words(self, words: list[bytes]) -> None:
        lines = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for line, e in zip(lines, self.fast.encode_batch_fast([b" ".join(x).decode().lower() for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids)
            stops = np.flatnonzero(self.ends[ids]) + 1
            self.update(zip(line, self.of(ids, stops) if len(stops) == len(line) else self._each([w.decode() for w in line]), strict=True))


#: Of this worker, by tokenizer and kind of value: tasks that follow one another in a worker go on with what it knows.
_KNOWN: dict[tuple[str, str], PreTokens] = {}


def pretokens(path: str, kind: str, of, fixed: dict | None = None, size: int = CACHE) -> PreTokens:
    if (path, kind) not in _KNOWN:
        _KNOWN[path, kind] = PreTokens(path, of)
    known = _KNOWN[path, kind]
    known.size = size
    if fixed is not None and known.fixed.keys() != fixed.keys():
        known.fixed = fixed
        known.update(fixed)
    return known


@cache
def word_tokenizer(path: str) -> tuple:
    """For lower-case words of letters: the tokenizer without the steps that change nothing in them, and whether each id ends a word. Both
    tokenizers have one model in memory.

    (None, None) unless the tokenizer normalises by NFC, white space and lower case, splits by a pattern and into bytes, and marks word ends.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    suffix = spec["model"].get("end_of_word_suffix")
    kinds = lambda part, name: [x["type"] for x in (spec.get(part) or {}).get(name, [])]
    if not suffix or kinds("normalizer", "normalizers") != ["NFC", "Replace", "Lowercase"] or kinds("pre_tokenizer", "pretokenizers") != ["Split", "ByteLevel"]:
        return None, None
    if not all(t["content"].startswith(SPECIAL.decode()) for t in spec.get("added_tokens", [])):
        return None, None
    from tokenizers import Tokenizer, pre_tokenizers

    to_bytes = spec["pre_tokenizer"]["pretokenizers"][1]
    fast = Tokenizer(tokenizer(path).model)
    fast.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=to_bytes["add_prefix_space"], use_regex=to_bytes.get("use_regex", True))])
    vocabulary = fast.get_vocab()
    ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    for token, i in vocabulary.items():
        ends[i] = token.endswith(suffix)
    return fast, ends


def frequent_pretokens(docs: DataFrame, text_col: str = "text", most: int = FREQUENT, per_task: int = FREQUENT_PER_TASK) -> list[bytes]:
    """The pre-tokens that the tasks' counts name most often, at most `most`. Every row is counted; a task keeps a bounded number of counters."""

    def sent(seen: Counter, n: int) -> pa.RecordBatch:
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:n]
        return pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]], pa.list_(pa.binary())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["words", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for _, texts in text_parts(batches):
            words, at, _ = split_texts(texts)
            for w, n in zip(words, np.bincount(at, minlength=len(words)).tolist(), strict=True):
                if len(w) <= LONG:
                    seen[w] += n
            if len(seen) > 16 * per_task:
                seen = Counter(dict(seen.most_common(4 * per_task)))
        yield sent(seen, per_task)

    def merged(rows) -> Counter:
        seen: Counter[bytes] = Counter()
        for words, counts in rows:
            for w, n in zip(words, counts, strict=True):
                seen[bytes(w)] += n
            if len(seen) > 4 * most:
                seen = Counter(dict(seen.most_common(2 * most)))
        return seen

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield sent(merged(x for b in batches for x in zip(b.column("words").to_pylist(), b.column("counts").to_pylist(), strict=True)), most)

    kind = "words array<binary>, counts array<long>"
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, kind)
    tasks = found.rdd.getNumPartitions()
    while tasks > MERGED:
        tasks = -(-tasks // MERGED)
        found = found.repartition(tasks).mapInArrow(merge, kind)
    return [w for w, _ in sorted(merged(found.collect()).items(), key=lambda x: (-x[1], x[0]))[:most]]  # at most MERGED rows


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs, over the whole text.

    Counts equal those of the library for the text as one string, without added special tokens; special strings inside a text
    count as the library takes them. Null counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids each give a row; an
    empty table gives none. Only the named columns are read.
    """
    small_batches(docs)
    words = frequent_pretokens(docs, text_col, most=frequent)
    lengths = [len(x) for x in tokenizer(tokenizer_path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
    table = docs.sparkSession.sparkContext.broadcast((b" ".join(words), lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pretokens(tokenizer_path, "lengths", piece_lengths, dict(zip(table.value[0].split(), table.value[1], strict=True)))
        for part, texts in text_parts(batches):
            words, at, n = split_texts(texts)
            upto = np.append(0, np.cumsum(np.array(known.values_of(words), np.int64)[at]))
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(upto[ends] - upto[ends - n])], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > max_tokens)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts() of documents; nulls, repeats and empty tables as there."""
    return token_counts(read_table(spark, sf_dir, "documents"), vocabulary_path())
