"""Removal of long passages that an earlier document has, by a sparse suffix array.

A byte goes if a string of `span` bytes that covers it also starts in a document with a smaller id. Sorting every suffix would move
some sixty bytes for each byte of text, so suffixes are sorted at anchors only: the places where a hash of the next `GRAM` bytes is
the least of its window. Equal windows have their anchor at the same place, so each window is looked for at its anchor.

    1  Tasks send the anchors' hashes; those in one document only go no further.
    2  The others' surroundings are range-partitioned by the GRAM leading bytes of the suffix at the anchor, between sampled splitters.
       A bucket is sorted by multikey quicksort, eight bytes a symbol; suffixes that agree on GRAM bytes stand together, and within them
       windows that are equal byte for byte get the least document that has them. Splitters are as long as what is sorted, so equal
       suffixes never lie on two sides of a boundary and no comparison across it is left over.
    3  Documents collect the windows found in earlier ones.

Whole copies of an earlier text are settled beforehand by their digests. Tasks combine equal entries before they send them: an anchor
or a surrounding is sent once a task, however many of its documents have it. Anchors that very many documents share are sent
window by window, each with its bytes, to buckets by the windows' hashes, so the many different surroundings of one passage do not meet.

There is a bucket for every BUCKET_BYTES of text. A partition has many of them, in order, and a worker holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, read_table, small_batches, stored, text_or_empty
from .tokens import text_rows

SPAN, GRAM = 50, 20
#: An anchor in more documents is sent window by window. Of such anchors the HOTTEST are, 8 MB; any other is in fewer entries than all
#: entries divided by HOTTEST, and is sorted with the rest: which way an anchor goes changes no result.
HOT, HOTTEST = 20_000, 1 << 20
#: Bytes of text a bucket, and most buckets a partition.
BUCKET_BYTES, PER_PARTITION = 32 << 20, 32
#: Segments of a sort that are no longer are finished by numpy, all at once.
SHORT = 1024
#: Anchors a task holds before it sends them, surroundings before it sends them, those compared at once, and splitter samples of a task.
FLUSH, HELD, COMPARED, SAMPLES = 1_000_000, 200_000, 20_000, 256
U64, HASH_BITS = np.uint64, 48
M1, M2, M3, M4 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_ROWS = "kind int, bucket int, body binary"
ANCHORS, SAMPLE, SUFFIXES, WINDOWS, DONE = range(5)


def _words(data: bytes) -> np.ndarray:
    """The 8 bytes from each place of data on, as integers; zeros follow the end."""
    return np.ndarray((len(data),), U64, data + bytes(8), 0, (1,))


def _grams(data: bytes, size: int) -> np.ndarray:
    """Hashes of the runs of `size` bytes, 8 or more, from each place on."""
    x, n = _words(data), len(data) - size + 1
    h = x[:n] * M1
    for at in [*range(8, size - 8, 8), size - 8]:
        h ^= h >> U64(29)
        h *= M3
        h += x[at : at + n] * M2
    h ^= h >> U64(32)
    h *= M4
    return h ^ (h >> U64(29))


def _sliding(a: np.ndarray, width: int, least) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        a = least(a[: len(a) - step], a[step:])
        done += step
    return a


def anchors(data: bytes, span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose hash is the least of a window of `span` bytes, their hashes, and the least hash of each window."""
    h, width = _grams(data, gram), span - gram + 1
    least = _sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, U64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    return at, h[at], least


def _packed(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a.tobytes()) for a in arrays], np.int64)
    return zstandard.compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def _unpacked(body: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.decompress(body)
    sizes = np.frombuffer(data, np.int64, len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [np.frombuffer(data[e - s : e], k) for e, s, k in zip(ends.tolist(), sizes.tolist(), kinds, strict=True)]


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "bucket", "body"])


class _Documents:
    """Ids and text hashes of the documents that a task's entries name by number."""

    def __init__(self):
        self.ids: list[int] = []
        self.texts: list[int] = []

    def add(self, doc_id: int, text: int) -> int:
        self.ids.append(doc_id)
        self.texts.append(text)
        return len(self.ids) - 1

    def used(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers among the documents used, and the ids and text hashes of those."""
        which, back = np.unique(numbers, return_inverse=True)
        return back.astype(np.int32), np.array(self.ids, np.int64)[which], np.array(self.texts, np.int64)[which]


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal keys begin."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, np.int64)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Iterator[bytes]]]:
    """Kind, bucket and bodies of the runs of rows of one bucket; rows come in that order."""
    rows = ((kind, bucket, body.as_py()) for batch in batches for kind, bucket, body in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("body"), strict=True))
    for (kind, bucket), run in groupby(rows, lambda r: r[:2]):
        yield kind, bucket, (r[2] for r in run)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, and the places that have it."""
    order = np.argsort(bucket, kind="stable")
    ends = [*_groups(bucket[order]).tolist(), len(order)]
    for a, b in zip(ends, ends[1:], strict=False):
        yield int(bucket[order[a]]), order[a:b]


def multikey_quicksort(keys: list[np.ndarray], short: int = SHORT) -> np.ndarray:
    """The order of rows by their symbols, keys[0] first.

    A segment longer than `short` is divided by a pivot, the median of some of its symbols at its depth, into rows below, equal and above;
    the equal ones go on with their next symbol, and are done after the last. Short segments are finished together.
    """
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)] if len(order) else []
    rest = []
    while todo:
        begin, end, depth = todo.pop()
        if end - begin <= short:
            rest.append((begin, end))
            continue
        rows = order[begin:end]
        symbols = keys[depth][rows]
        pivot = np.sort(symbols[:: max(1, len(symbols) // 63)])
        pivot = pivot[len(pivot) // 2]
        below, above = symbols < pivot, symbols > pivot
        parts = [rows[below], rows[~below & ~above], rows[above]]
        order[begin:end] = np.concatenate(parts)
        first = begin + len(parts[0])
        second = first + len(parts[1])
        todo += [(x, y, d) for x, y, d in ((begin, first, depth), (first, second, depth + 1), (second, end, depth)) if y > x and d < len(keys)]
    if rest:
        ends = np.array(rest)
        size = ends[:, 1] - ends[:, 0]
        at = np.repeat(ends[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())
        rows = order[at]
        segment = np.repeat(np.arange(len(ends)), size)
        order[at] = rows[np.lexsort([*(k[rows] for k in reversed(keys)), segment])]
    return order


def _symbols(content: np.ndarray, begin: int, size: int) -> list[np.ndarray]:
    """`size` bytes of each row from `begin` on as big-endian integers of 8 bytes, the last of which may overlap."""
    return [np.ascontiguousarray(content[:, begin + c : begin + c + 8]).view(">u8")[:, 0].astype(U64) for c in (*range(0, size - 8, 8), size - 8)]


def _begins(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Where groups of rows that agree in all keys begin, in order."""
    differs = np.zeros(max(len(order) - 1, 0), bool)
    for k in keys:
        differs |= k[order][1:] != k[order][:-1]
    return np.append(0, np.flatnonzero(differs) + 1) if len(order) else np.empty(0, np.int64)


class _Owned:
    """Values of documents, gathered in a task and sent in one row to each of the owners that documents are dealt to."""

    def __init__(self, owners: int):
        self.owners, self.parts, self.held = owners, [], 0

    def add(self, number: np.ndarray, ids: np.ndarray, texts: np.ndarray, values: np.ndarray) -> None:
        self.parts.append((values, ids[number], texts[number]))
        self.held += len(number)

    def full(self) -> bool:
        return self.held > FLUSH

    def rows(self) -> pa.RecordBatch:
        rows = []
        if self.parts:
            values, ids, texts = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
            owner = (((ids ^ texts).view(U64) * M1) >> U64(33)).astype(np.int64) % self.owners
            order = np.lexsort((texts, ids, owner))
            values, ids, texts, owner = values[order], ids[order], texts[order], owner[order]
            ends = [*_groups(owner).tolist(), len(owner)]
            rows = [(DONE, int(owner[a]), _packed(values[a:b], ids[a:b], texts[a:b])) for a, b in zip(ends, ends[1:], strict=False)]
        self.parts, self.held = [], 0
        return _sent(rows)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All values of each document, in one row."""
    for _, _, bodies in _buckets(batches):
        parts = [_unpacked(body, "u8", "i8", "i8") for body in bodies]
        values, ids, texts = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((texts, ids))
        values, ids, texts = values[order], ids[order], texts[order]
        begin = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])))
        ends = [*begin.tolist(), len(ids)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[begin]), pa.array(texts[begin]), pa.array([values[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], pa.binary())], names=["doc_id", "th", "body"])


def _send_anchors(base: DataFrame, span: int, buckets: int) -> DataFrame:
    """Phase 1, map side: rows of ANCHORS by bucket, rows DONE of anchors already known to be in two documents, rows SAMPLE."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, n = _Documents(), [], 0
        rank, leads = np.empty(0, U64), np.empty(0, f"S{GRAM}")

        def flush() -> pa.RecordBatch:
            nonlocal docs, held, n
            h, d = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
            h, d = h[once], d[once]
            begin = _groups(h)
            size = np.diff(np.append(begin, len(h)))
            rows = []
            many = np.repeat(size > 1, size)
            if many.any():
                number, ids, texts = docs.used(d[many])
                rows.append((DONE, int(h[0] % U64(buckets)), _packed(h[many], number, ids, texts)))
            key, doc = h[begin], np.where(size > 1, -size, d[begin])
            for b, m in _split((key >> U64(16)).astype(np.int64) % buckets):
                one = doc[m] >= 0
                number = doc[m].astype(np.int32)
                number[one], ids, texts = docs.used(doc[m][one])
                rows.append((ANCHORS, b, _packed(key[m], number, ids, texts)))
            docs, held, n = _Documents(), [], 0
            return _sent(rows)

        for part, texts in text_rows(batches):
            for data, doc_id, th in zip(texts, part.column("doc_id").to_pylist(), part.column("th").to_pylist(), strict=True):
                at, h, _ = anchors(data, span)
                h = h >> U64(64 - HASH_BITS)
                held.append((h, np.full(len(h), docs.add(doc_id, th), np.int64)))
                n += len(h)
                # the sample of a task: the suffixes of least rank among all of its anchors
                mine = (at.astype(U64) * M1 ^ U64(th & (1 << 64) - 1)) * M2
                least = np.flatnonzero(mine < rank[-1]) if len(rank) == SAMPLES else np.arange(len(at))
                if len(least):
                    least = least[np.argsort(mine[least], kind="stable")[:SAMPLES]]
                    rank, leads = np.append(rank, mine[least]), np.append(leads, _leads(_surroundings(data, at[least], span), span))
                    order = np.argsort(rank, kind="stable")[:SAMPLES]
                    rank, leads = rank[order], leads[order]
                if n > FLUSH:
                    yield flush()
        if held:
            yield flush()
        if len(leads):
            yield _sent([(SAMPLE, 0, leads.tobytes())])

    return base.mapInArrow(send, _ROWS)


def _shared_anchors(batches: Iterator[pa.RecordBatch], most: int, owners: int) -> Iterator[pa.RecordBatch]:
    """Phase 1, where hashes meet: the anchors that others have too, to their documents' owners; rows ANCHORS of each that is in more than
    `most` documents, with that number in the place of a bucket."""
    out = _Owned(owners)
    for kind, _, bodies in _buckets(batches):
        if kind == DONE:
            for body in bodies:
                h, number, ids, texts = _unpacked(body, "u8", "i4", "i8", "i8")
                out.add(number, ids, texts, h)
                if out.full():
                    yield out.rows()
            continue
        found = [_unpacked(body, "u8", "i4", "i8", "i8") for body in bodies]
        offsets = np.cumsum([0, *(len(x[2]) for x in found)])
        h = np.concatenate([x[0] for x in found])
        number = np.concatenate([np.where(x[1] >= 0, x[1] + o, x[1]) for x, o in zip(found, offsets[:-1].tolist(), strict=True)])
        ids, texts = np.concatenate([x[2] for x in found]), np.concatenate([x[3] for x in found])
        order = np.argsort(h, kind="stable")
        h, number = h[order], number[order]
        begin = _groups(h)
        weight = np.add.reduceat(np.where(number >= 0, 1, -number), begin)
        size = np.diff(np.append(begin, len(h)))
        m = np.repeat(weight > 1, size) & (number >= 0)
        if m.any():
            out.add(number[m], ids, texts, h[m])
        hot = weight > most
        if hot.any():
            yield _sent([(ANCHORS, min(w, (1 << 31) - 1), k.tobytes()) for w, k in zip(weight[hot].tolist(), h[begin[hot]], strict=True)])
        if out.full():
            yield out.rows()
    yield out.rows()


def _surroundings(data: bytes, at: np.ndarray, span: int) -> np.ndarray:
    """A row for each place: the bytes from span - GRAM before it to span after it, zeros beyond the text."""
    before = span - GRAM
    padded = np.frombuffer(bytes(before) + data + bytes(span), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, before + span)[at]


def _leads(around: np.ndarray, span: int) -> np.ndarray:
    """The GRAM bytes from the anchor on, which compare as bytes."""
    return np.ascontiguousarray(around[:, span - GRAM : span]).view(f"S{GRAM}")[:, 0]


def _window_hashes(rows: np.ndarray, span: int) -> np.ndarray:
    """Polynomial hashes of the window that starts j before the anchor, for each j (columns)."""
    steps, base = rows.shape[1], U64(0x9E3779B97F4A7C15)
    prefix = np.zeros((steps + 1, len(rows)), U64)
    for c in range(steps):
        prefix[c + 1] = prefix[c] * base + (rows[:, c].astype(U64) + U64(1))
    power = U64(pow(int(base), span, 1 << 64))
    before = span - GRAM
    return np.stack([prefix[before - j + span] - prefix[before - j] * power for j in range(before + 1)], 1)


def _send_suffixes(marked: DataFrame, span: int, splitters: np.ndarray, hot: np.ndarray, buckets: int) -> DataFrame:
    """Phase 2, map side: SUFFIXES by range, WINDOWS by hash, and DONE for windows that an earlier document of the task has."""
    before = span - GRAM

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, n = _Documents(), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, held, n
            around, span_of, number, at, is_hot = (np.concatenate([x[i] for x in held]) for i in range(5))
            ids = np.array(docs.ids, np.int64)[number]
            rows = []

            def done(numbers: np.ndarray, places: np.ndarray, masks: np.ndarray) -> None:
                if len(numbers):
                    names = docs.used(numbers)
                    rows.append((DONE, int(numbers[0]) % buckets, _packed(names[0], places.astype(np.uint32), masks.astype(np.uint32), *names[1:])))

            def mask(spans: np.ndarray) -> np.ndarray:
                lo, hi = spans[:, 0].astype(np.int64), spans[:, 1].astype(np.int64)
                return (1 << (hi + 1)) - (1 << lo)

            whole = np.ascontiguousarray(np.hstack([around, span_of])).view(f"V{around.shape[1] + 2}")[:, 0]
            _, first_of = np.unique(whole, return_inverse=True)
            order = np.lexsort((ids, first_of))
            begin = _groups(first_of[order])
            least = np.repeat(ids[order][begin], np.diff(np.append(begin, len(order))))
            later = order[ids[order] > least]
            done(number[later], at[later], mask(span_of[later]))
            keep = order[ids[order] == least]  # with all places that its document has it in
            cold, warm = keep[~is_hot[keep]], keep[is_hot[keep]]
            if len(cold):
                for b, m in _split(np.searchsorted(splitters, _leads(around[cold], span), side="right")):
                    k = cold[m]
                    names = docs.used(number[k])
                    rows.append((SUFFIXES, b, _packed(around[k], span_of[k], names[0], at[k].astype(np.uint32), *names[1:])))
            for begin in range(0, len(warm), COMPARED):
                row, j, content = _windows(around[warm[begin : begin + COMPARED]], span_of[warm[begin : begin + COMPARED]], span)
                row = warm[begin + row]
                keys = _symbols(content, 0, span)
                order = np.lexsort([ids[row], *keys])
                starts = _begins(keys, order)
                least = np.repeat(ids[row[order]][starts], np.diff(np.append(starts, len(order))))
                m = ids[row[order]] > least
                done(number[row[order[m]]], at[row[order[m]]], 1 << j[order[m]])
                left = order[~m]
                bucket = (_mixed([k[left] for k in keys]) >> U64(20)).astype(np.int64) % buckets
                for b, m in _split(bucket):
                    k = left[m]
                    names = docs.used(number[row[k]])
                    rows.append((WINDOWS, b, _packed(content[k], names[0], at[row[k]].astype(np.uint32), j[k].astype(np.uint8), *names[1:])))
            docs, held, n = _Documents(), [], 0
            return _sent(rows)

        for part, texts in text_rows(batches):
            for data, doc_id, th, shared in zip(texts, *(part.column(c).to_pylist() for c in ("doc_id", "th", "shared")), strict=True):
                at, h, least = anchors(data, span)
                short = h >> U64(64 - HASH_BITS)
                m = np.isin(short, np.frombuffer(shared, U64))
                at, h, short = at[m], h[m], short[m]
                # the windows of an anchor: those with its hash as their least that contain it; they are consecutive
                place = at[:, None] - np.arange(before + 1)
                mine = (place >= 0) & (place < len(least))
                mine &= least[np.clip(place, 0, len(least) - 1)] == h[:, None]
                lo, hi = mine.argmax(1), before - mine[:, ::-1].argmax(1)
                known = np.searchsorted(hot, short)
                is_hot = hot[np.minimum(known, len(hot) - 1)] == short if len(hot) else np.zeros(len(at), bool)
                for a in range(0, len(at), HELD):
                    p = slice(a, a + HELD)
                    held.append((_surroundings(data, at[p], span), np.column_stack([lo[p], hi[p]]).astype(np.uint8), np.full(len(at[p]), docs.add(doc_id, th), np.int64), at[p], is_hot[p]))
                    n += len(at[p])
                    if n > HELD:
                        yield flush()
        if n:
            yield flush()

    return marked.mapInArrow(send, _ROWS)


def _windows(around: np.ndarray, span_of: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, distance before the anchor and bytes of each window of the surroundings."""
    before = span - GRAM
    j = np.arange(before + 1)
    row, j = np.nonzero((j >= span_of[:, :1]) & (j <= span_of[:, 1:]))
    return row, j, np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(around, span, axis=1)[row, before - j])


def _mixed(keys: list[np.ndarray]) -> np.ndarray:
    """A hash of each row's symbols."""
    h = np.zeros(len(keys[0]), U64)
    for k in keys:
        h = (h ^ k) * M1
        h ^= h >> U64(29)
    return h


def _earlier_windows(span: int, owners: int):
    before = span - GRAM

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 2, where suffixes meet: anchors' places and bit masks of the windows that an earlier document has, to the owners."""
        out = _Owned(owners)
        for kind, _, bodies in _buckets(batches):
            if kind == DONE:
                for body in bodies:
                    number, at, masks, ids, texts = _unpacked(body, "i4", "u4", "u4", "i8", "i8")
                    out.add(number, ids, texts, np.column_stack([at, masks]).view(U64)[:, 0])
                    if out.full():
                        yield out.rows()
                continue
            if kind == WINDOWS:
                parts = [_unpacked(b, "u1", "i4", "u4", "u1", "i8", "i8") for b in bodies]
                parts = [(p[0], p[3], *p[1:3], *p[4:]) for p in parts]
            else:
                parts = [_unpacked(b, "u1", "u1", "i4", "u4", "i8", "i8") for b in bodies]
            offsets = np.cumsum([0, *(len(p[-2]) for p in parts)])
            ids, texts = np.concatenate([p[-2] for p in parts]), np.concatenate([p[-1] for p in parts])
            number = np.concatenate([p[2] + o for p, o in zip(parts, offsets[:-1].tolist(), strict=True)])
            at = np.concatenate([p[3] for p in parts])
            doc = ids[number]
            if kind == WINDOWS:
                content, j = np.concatenate([p[0] for p in parts]).reshape(-1, span), np.concatenate([p[1] for p in parts])
                keys = _symbols(content, 0, span)
                order = np.lexsort([doc, *keys])
                begin = _begins(keys, order)
                later = order[doc[order] > np.repeat(doc[order][begin], np.diff(np.append(begin, len(order))))]
                masks = np.zeros(len(doc), np.uint32)
                masks[later] = np.uint32(1) << j[later].astype(np.uint32)
            else:
                around = np.concatenate([p[0] for p in parts]).reshape(-1, before + span)
                span_of = np.concatenate([p[1] for p in parts]).reshape(-1, 2)
                keys = _symbols(around, before, GRAM)
                order = multikey_quicksort(keys)
                begin = _begins(keys, order)
                size = np.diff(np.append(begin, len(order)))
                masks = np.zeros(len(order), np.uint32)
                # whole groups at a time, about COMPARED rows; a suffix alone has nothing to share
                turn = (np.cumsum(size) - 1) // COMPARED
                for t in np.unique(turn).tolist():
                    some = order[np.repeat((turn == t) & (size > 1), size)]
                    if len(some):
                        masks[some] = _compare(around[some], span_of[some], doc[some], span)
            m = masks > 0
            if m.any():
                out.add(number[m], ids, texts, np.column_stack([at[m], masks[m]]).view(U64)[:, 0])
            if out.full():
                yield out.rows()
        yield out.rows()

    return find


def _compare(around: np.ndarray, span_of: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """For each surrounding a bit for each of its windows that a smaller document's surrounding has too. Hashes bring windows together,
    bytes decide."""
    before = span - GRAM
    masks = np.zeros(len(doc), np.uint32)
    hashes = _window_hashes(around, span)
    for j in range(before + 1):
        rows = np.flatnonzero((span_of[:, 0] <= j) & (j <= span_of[:, 1]))
        h = hashes[rows, j]
        order = np.lexsort((doc[rows], h))
        rows, h = rows[order], h[order]
        begin = _groups(h)
        first = np.repeat(rows[begin], np.diff(np.append(begin, len(h))))
        later = doc[rows] > doc[first]
        rows, first = rows[later], first[later]
        part = slice(before - j, before - j + span)
        same = (around[rows, part] == around[first, part]).all(1)
        masks[rows[same]] |= np.uint32(1 << j)
        for r in rows[~same].tolist():  # equal hashes of different bytes: look at all that have the hash
            of = np.flatnonzero((hashes[:, j] == hashes[r, j]) & (span_of[:, 0] <= j) & (j <= span_of[:, 1]) & (doc < doc[r]))
            if (around[of, part] == around[r, part]).all(1).any():
                masks[r] |= np.uint32(1 << j)
    return masks


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, keep_text: bool = False, hot_docs: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay, if keep_text) for every row of docs.

    Texts are their UTF-8 bytes, null is empty; texts shorter than span keep everything. Strings are judged on the input, not on what is
    left. Rows that share an id never remove each other's bytes; each gets its own result. Rows without an id have
    no place in the order: they lose nothing and cause no loss. Ids are cast to long. An empty table gives an empty result. Only the
    named columns are read.
    """
    if not GRAM + 8 <= span <= GRAM + 31:
        raise ValueError(f"span must be from {GRAM + 8} to {GRAM + 31}")
    spark = small_batches(docs).sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    named = rows.where("doc_id is not null").where(F.octet_length("text") >= span)
    digests = named.select("doc_id", "th", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))
    equal = stored(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "span-equal")
    copies = stored(digests.join(maybe_broadcast(equal, 100), "digest").where("doc_id > first").select("doc_id", "th").distinct(), "span-copies")
    base = named.join(maybe_broadcast(copies, 32), ["doc_id", "th"], "left_anti").select("doc_id", "th", "text")

    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // (PER_PARTITION * bucket_bytes))
    buckets = max(partitions, n_bytes // bucket_bytes)
    by_bucket = lambda rows: rows.repartitionById(partitions, F.col("bucket")).sortWithinPartitions("kind", "bucket")
    sent = stored(_send_anchors(base, span, buckets), "span-anchors")
    # a random 2,000 of the tasks' samples, of SAMPLES suffixes each
    tasks = sent.where(f"kind = {SAMPLE}").orderBy(F.xxhash64("body")).limit(2000).collect()
    samples = np.sort(np.frombuffer(b"".join(bytes(r["body"]) for r in tasks), f"S{GRAM}"))
    splitters = np.unique(samples[np.linspace(0, len(samples) - 1, buckets + 1).astype(int)[1:-1]]) if len(samples) else samples
    shared = stored(by_bucket(sent.where(f"kind <> {SAMPLE}")).mapInArrow(lambda batches: _shared_anchors(batches, hot_docs, buckets), _ROWS), "span-shared")
    hottest = shared.where(f"kind = {ANCHORS}").orderBy(F.desc("bucket"), "body").limit(HOTTEST).select("body").toArrow()
    hot = np.sort(np.frombuffer(b"".join(hottest.column("body").to_pylist()), U64))
    per_document = lambda rows: by_bucket(rows).mapInArrow(_gathered, "doc_id long, th long, body binary")
    lists = per_document(shared.where(f"kind = {DONE}")).withColumnRenamed("body", "shared")
    marked = base.join(lists.hint("merge"), ["doc_id", "th"]).select("doc_id", "th", "text", "shared")
    found = by_bucket(_send_suffixes(marked, span, splitters, hot, buckets)).mapInArrow(_earlier_windows(span, buckets), _ROWS)
    windows = per_document(stored(found, "span-found")).withColumnRenamed("body", "windows")
    copy = maybe_broadcast(copies.select(F.col("doc_id").alias("copy_id"), F.col("th").alias("copy_th")), 32)
    whole = rows.join(windows.hint("merge"), ["doc_id", "th"], "left").join(copy, (F.col("doc_id") == F.col("copy_id")) & (F.col("th") == F.col("copy_th")), "left").select("doc_id", "text", "windows", F.col("copy_id").isNotNull().alias("copy"))
    bits = np.arange(span - GRAM + 1, dtype=np.uint32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_rows(batches):
            out = []
            for data, mine, copy in zip(texts, part.column("windows").to_pylist(), part.column("copy").to_pylist(), strict=True):
                if copy:
                    out.append((len(data), len(data), 1, b""))
                elif not mine:
                    out.append((len(data), 0, 0, data))
                else:
                    found = np.frombuffer(mine, np.uint32).reshape(-1, 2)
                    row, j = np.nonzero(found[:, 1:] >> bits & np.uint32(1))
                    starts = np.bincount(found[row, 0].astype(np.int64) - j, minlength=len(data) + 1)
                    ends = np.concatenate([np.zeros(span, starts.dtype), starts[:-span]])
                    gone = np.cumsum(starts - ends)[: len(data)] > 0
                    out.append((len(data), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()))
            columns = [part.column("doc_id"), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), pa.array([hashlib.sha256(x[3]).hexdigest() for x in out]), *([pa.array([x[3] for x in out], pa.binary())] if keep_text else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    return whole.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeated_passages() of documents; nulls, repeats and empty tables as there."""
    return repeated_passages(read_table(spark, sf_dir, "documents"))
