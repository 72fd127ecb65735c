"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Documents have labels, tokens do not, so the field is trained by expectation maximisation: no word of a clean document is toxic, and of a toxic
document at least one is. Words with features that mark toxic documents very significantly begin as its toxic ones; then the field's own marginals, given
that there is a toxic word, are the token labels that it is fitted to again. At scoring, words without features are all alike, so the chain between two words with features
is a power of one matrix and forward-backward visits only words with features, exactly. The expected number of toxic
words and the chance of any, from the marginals, give the document's score.

Training takes at most MAX_TOXIC and MAX_CLEAN labelled documents of up to MAX_CHARS characters and MAX_FEATURES features, all their words, short texts
and the ends of long ones too, and runs in one task. Everything else is over all rows and whole texts.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches
from .tokens import text_rows

MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 2000, 6000, 40_000
#: Word beginnings that are features, by length, beside whole words.
BEGINNINGS = (4, 5, 6)
#: Log-likelihood ratio statistic and share of toxic documents from which a feature is one of the model, and marks toxic words at first; most
#: features of a model.
FEATURE, SIGNIFICANT, MAX_FEATURES = (12.0, 0.8), (24.0, 0.9), 20_000
#: Words of a training sequence, sequences at once, and steps of each fit.
SEGMENT, AT_ONCE, FITS = 32, 1024, (60, 30)
HELD_OUT_OF, HELD_OUT = 3, 1
STRIP = "".join(map(chr, range(48))) + ":;<=>?@[\\]^_`{|}~ «»“”„‘’…¿¡"


@dataclass
class Model:
    """Weights of features for the toxic label; bias of that label; log potentials of label pairs; the document score's coefficients."""

    weights: dict[str, float]
    bias: float
    pairs: list[list[float]]
    score: list[float]


def features(word: str) -> list[str]:
    """A word's features; word is lower-case and stripped. Beginnings are marked, so that they differ from words."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)] if word else []


def words_of(text: str) -> list[str]:
    return text.lower().split()


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves HELD_OUT; a null id, having no text, does not."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """h, doc, text, y of the training documents: only ids that are not held out, one row an id. Bounded, as the module says. An id with both
    labels is toxic; of rows that repeat an id the least text is taken."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    known = known.withColumn("h", F.xxhash64(F.col("id").cast("string")))
    picked = known.where("y = 1").orderBy("h", "id").limit(MAX_TOXIC).unionByName(known.where("y = 0").orderBy("h", "id").limit(MAX_CLEAN))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull() & (F.char_length("text") <= MAX_CHARS))
    return texts.join(F.broadcast(picked), F.col("doc") == F.col("id")).groupBy("doc").agg(F.first("h").alias("h"), F.min("text").alias("text"), F.first("y").alias("y")).select("h", F.col("doc").cast("string").alias("doc"), "text", "y")


def _ordered(rows: list[tuple]) -> list[tuple[str, int]]:
    return _unlike([(text, y) for _, _, text, y in sorted(rows)])


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """Texts and labels of the training documents, in the order of their ids' hashes."""
    return _ordered([tuple(r) for r in labelled(docs, labels, id_col, text_col, label_col).collect()])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """train() on the training sample, in a task: the driver sees the model only."""
    small_batches(docs)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("h", "doc", "text", "y")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(_ordered(rows)))], pa.binary())], names=["model"])

    found = labelled(docs, labels, id_col, text_col, label_col).repartition(1).mapInArrow(learn, "model binary").first()
    return train([]) if found is None else pickle.loads(found["model"])


def _unlike(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without copies: a text most of whose least shingle hashes were seen in earlier ones would lend its words undue weight."""
    seen: set[int] = set()
    out = []
    for text, y in rows:
        w = words_of(text)
        sketch = sorted({zlib.crc32(" ".join(w[i : i + 4]).encode()) for i in range(max(1, len(w) - 3))})[:24]
        if sum(h in seen for h in sketch) * 4 <= len(sketch):
            out.append((text, y))
        seen.update(sketch)
    return out


def _marks(rows: list[tuple[list[str], int]]) -> dict[str, bool]:
    """The model's features: those that mark toxic documents, and whether they do so very significantly."""
    n = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    if not all(n):
        return {}
    p = n[1] / (n[0] + n[1])
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for words, y in rows:
        if y:
            counts[1].update({f for w in set(words) for f in features(w)})
    # even in no clean document, a feature in fewer toxic ones is not significant
    hopeful = {f for f, t in counts[1].items() if 2 * t * math.log(1 / p) >= FEATURE[0]}
    for words, y in rows:
        if not y:
            counts[0].update({f for w in set(words) for f in features(w) if f in hopeful})
    found = {}
    for f in hopeful:
        t, c = counts[1][f], counts[0][f]
        g = 2 * (t * math.log(t / (p * (t + c))) + (c * math.log(c / ((1 - p) * (t + c))) if c else 0))
        found[f] = g, t / n[1] / (t / n[1] + c / n[0])
    passed = {f: x for f, x in found.items() if x[0] >= FEATURE[0] and x[1] >= FEATURE[1]}
    best = sorted(passed, key=lambda f: (-passed[f][0], f))[:MAX_FEATURES]
    return {f: passed[f][0] >= SIGNIFICANT[0] and passed[f][1] >= SIGNIFICANT[1] for f in best}


def _logadd(a: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over the last axis."""
    m = a.max(-1, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(-1, keepdims=True)))[..., 0]


@dataclass
class _Sequences:
    """Training sequences: features of each word (0 for none), which places are words, how many alike sequences each stands for, and its document."""

    ids: np.ndarray
    used: np.ndarray
    weight: np.ndarray
    doc: np.ndarray

    def part(self, a: int, b: int) -> _Sequences:
        return _Sequences(self.ids[a:b], self.used[a:b], self.weight[a:b], self.doc[a:b])


def _expected(theta: np.ndarray, x: _Sequences, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic label at each word, and what the field expects of each of its statistics over all sequences."""
    w = theta[: n_features + 1].copy()
    w[0] = 0
    pair, length = theta[-4:].reshape(2, 2), x.used.shape[1]
    emit = np.zeros((*x.used.shape, 2))
    emit[..., 1] = w[x.ids].sum(-1) + theta[-5]
    a, b = np.zeros_like(emit), np.zeros_like(emit)
    a[:, 0] = emit[:, 0]
    for t in range(1, length):
        a[:, t] = np.where(x.used[:, t, None], emit[:, t] + _logadd(a[:, t - 1][:, None, :] + pair.T[None]), a[:, t - 1])
    for t in range(length - 2, -1, -1):
        b[:, t] = np.where(x.used[:, t + 1, None], _logadd((emit[:, t + 1] + b[:, t + 1])[:, None, :] + pair[None]), b[:, t + 1])
    z = _logadd(a[:, -1])
    p = np.exp(a + b - z[:, None, None])[..., 1] * x.used
    both = np.exp(a[:, :-1, :, None] + pair[None, None] + (emit + b)[:, 1:, None, :] - z[:, None, None, None]) * x.used[:, 1:, None, None]
    return p, _statistics(p, both, x, n_features)


def _statistics(p: np.ndarray, both: np.ndarray, x: _Sequences, n_features: int) -> np.ndarray:
    """Sums over all words of toxic labels by feature (0 unused), of toxic labels, and of label pairs."""
    out = np.zeros(n_features + 6)
    heavy = p * x.weight[:, None]
    out[: n_features + 1] = np.bincount(x.ids.ravel(), weights=np.repeat(heavy.ravel(), x.ids.shape[-1]), minlength=n_features + 1)
    out[0], out[-5] = 0, heavy.sum()
    out[-4:] = (both * x.weight[:, None, None, None]).sum((0, 1)).ravel()
    return out


def _parts(x: _Sequences) -> Iterator[tuple[int, _Sequences]]:
    return ((i, x.part(i, i + AT_ONCE)) for i in range(0, len(x.weight), AT_ONCE))


def _fit_field(x: _Sequences, y: np.ndarray, n_features: int, steps: int, theta: np.ndarray) -> np.ndarray:
    """Maximum likelihood with a small ridge, by Adam, from theta on: weights (0 unused), bias, label pairs. y: chances of the toxic label."""
    seen, n = np.zeros_like(theta), x.weight.sum()
    for i, part in _parts(x):
        q = np.stack([(1 - y[i : i + AT_ONCE]) * part.used, y[i : i + AT_ONCE]], -1)
        seen += _statistics(q[..., 1], q[:, :-1, :, None] * q[:, 1:, None, :], part, n_features)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = (seen - sum(_expected(theta, part, n_features)[1] for _, part in _parts(x))) / n - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def _posterior(theta: np.ndarray, x: _Sequences, toxic: np.ndarray, n_features: int) -> np.ndarray:
    """Chances of the toxic label given the documents' labels: none in clean documents; in toxic ones, of words with features, given that there is one."""
    p = np.concatenate([_expected(theta, part, n_features)[0] for _, part in _parts(x)]) * x.ids.any(-1)
    p[~toxic[x.doc]] = 0
    none = np.ones(len(toxic))
    np.multiply.at(none, x.doc, (1 - p).prod(1))
    return np.minimum(p / np.maximum(1 - none, 1e-9)[x.doc][:, None], 1.0)


class Tagger:
    """Marginals of a model's toxic label at the words that have features."""

    def __init__(self, model: Model, room: int = 500_000):
        self.model, self.room, self.known = model, room, {}
        t = np.exp(np.array(model.pairs))
        self.emit0 = math.exp(model.bias)
        step = t * np.array([1.0, self.emit0])  # from a label over a word without features to a label
        values, left = np.linalg.eig(step.T)
        k = int(np.argmax(values.real))
        self.ratio = float((values[1 - k] / values[k]).real)
        right = np.linalg.inv(left).real.T
        left = left.real
        # step ** g = (largest value) ** g * (main + ratio ** g * rest); the first factor is the same for all labels
        self.main = (np.outer(right[:, k], left[:, k])).tolist()
        self.rest = (np.outer(right[:, 1 - k], left[:, 1 - k])).tolist()
        self.t = t.tolist()
        # of words, for both labels: the smaller one is 1 at the main value
        self.scale = float(values[k].real)

    def emission(self, word: str) -> float | None:
        """exp of a word's weights, or None without features."""
        try:
            return self.known[word]
        except KeyError:
            found = [w for f in features(word.strip(STRIP)) if (w := self.model.weights.get(f)) is not None]
            out = math.exp(min(50.0, sum(found) + self.model.bias)) if found else None
            if len(self.known) < self.room and len(word) <= 64:
                self.known[word] = out
            return out

    def _gap(self, n: int) -> tuple[float, float, float, float]:
        r = self.ratio**n
        (a, b), (c, d) = self.main, self.rest
        return a[0] + r * c[0], a[1] + r * c[1], b[0] + r * d[0], b[1] + r * d[1]

    def marginals(self, words: list[str]) -> list[tuple[int, float]]:
        """(index, chance of the toxic label) of the words that have features."""
        emission, known = self.emission, self.known
        at = [(i, e) for i, w in enumerate(words) if (e := known[w] if w in known else emission(w)) is not None]
        if not at:
            return []
        t = self.t
        forward, (x, y), last = [], (1.0, 1.0), -1
        for i, e in at:
            gap = i - last - 1
            if last < 0 and gap:  # the first word has no word before it
                y *= self.emit0
                gap -= 1
            a, b, c, d = self._gap(gap)
            x, y = x * a + y * c, x * b + y * d
            if last >= 0 or i > 0:
                x, y = x * t[0][0] + y * t[1][0], x * t[0][1] + y * t[1][1]
            y *= e
            s = x + y
            x, y = x / s, y / s
            forward.append((x, y))
            last = i
        out = []
        a, b, c, d = self._gap(len(words) - 1 - last)
        p, q = a + b, c + d
        for k in range(len(at) - 1, -1, -1):
            x, y = forward[k]
            out.append((at[k][0], y * q / (x * p + y * q)))
            if k:
                i, e = at[k]
                q *= e
                p, q = t[0][0] * p + t[0][1] * q, t[1][0] * p + t[1][1] * q
                a, b, c, d = self._gap(i - at[k - 1][0] - 1)
                p, q = a * p + b * q, c * p + d * q
                s = p + q
                p, q = p / s, q / s
        return out[::-1]


def _evidence(found: list[tuple[int, float]]) -> tuple[float, float]:
    none = 1.0
    for _, p in found:
        none *= 1 - p
    return math.log1p(sum(p for _, p in found)), 1 - none


def _score(model: Model, found: list[tuple[int, float]]) -> float:
    a, b = _evidence(found)
    z = model.score[0] + model.score[1] * a + model.score[2] * b
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit_score(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression with a ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.05, 0.05])
        w += np.linalg.solve(h, x.T @ (y - p) - np.array([1e-3, 0.05, 0.05]) * w)
    return w.tolist()


def train(sample: list[tuple[str, int]]) -> Model:
    """A model of (text, label) rows. Without rows of both labels, or marks of toxic ones, all texts score the share of label 1."""
    one: dict[str, str] = {}  # each word once in memory
    rows = [([one.setdefault(w, w) for w in (x.strip(STRIP) for x in words_of(text))], y) for text, y in sample]
    del one
    marks = _marks(rows)
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    base = [math.log(share / (1 - share)), 0.0, 0.0]
    if not marks:
        return Model({}, -5.0, [[0.0, 0.0], [0.0, 0.0]], base)
    number = {f: i for i, f in enumerate(sorted(marks), 1)}
    strong = np.array([False, *(marks[f] for f in sorted(marks))])
    wide = 1 + len(BEGINNINGS)
    found: list[np.ndarray] = []
    lengths, weight, doc = [], [], []
    alike: Counter[int] = Counter()
    for k, (words, _) in enumerate(rows):
        ids = np.zeros((-(-len(words) // SEGMENT) * SEGMENT, wide), np.int32)
        for i, w in enumerate(words):
            for j, f in enumerate(features(w)):
                if f in number:
                    ids[i, j] = number[f]
        for i in range(0, len(words), SEGMENT):
            part, n = ids[i : i + SEGMENT], min(SEGMENT, len(words) - i)
            if part.any():
                found.append(part.copy())
                lengths.append(n)
                weight.append(1)
                doc.append(k)
            else:  # sequences without features are all alike but for their length
                alike[n] += 1
    del rows
    toxic = np.array([y == 1 for _, y in sample] + [False])
    plain = sorted(alike)
    ids = np.stack([*found, *(np.zeros((SEGMENT, wide), np.int32) for _ in plain)])
    used = np.arange(SEGMENT) < np.array([*lengths, *plain])[:, None]
    x = _Sequences(ids, used, np.array([*weight, *(alike[n] for n in plain)], float), np.array([*doc, *([len(sample)] * len(plain))]))
    theta = np.zeros(len(number) + 6)
    y = (strong[ids].any(-1) & toxic[x.doc][:, None]).astype(float)
    for steps in FITS:
        theta = _fit_field(x, y, len(number), steps, theta)
        y = _posterior(theta, x, toxic, len(number))
    model = Model({f: float(theta[i]) for f, i in number.items()}, float(theta[-5]), theta[-4:].reshape(2, 2).tolist(), base)
    tagger = Tagger(model)
    x = np.array([_evidence(tagger.marginals(words_of(text))) for text, _ in sample])
    model.score = _fit_score(x, np.array([y for _, y in sample], float))
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start, end, chance; code points, end exclusive) for every row of docs.

    spans are the runs of words whose chance of being toxic is over a half. Scores see the text alone. Null, empty and
    blank texts have the score of a text without toxic words. Repeated rows and null ids each give a row; an empty table gives none.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for part, texts in text_rows(batches):
            scores, spans = [], []
            for raw in texts:
                text = raw.decode()
                found = tagger.marginals(words_of(text))
                scores.append(_score(shared.value, found))
                spans.append(_spans(text, [(i, p) for i, p in found if p > 0.5]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())])))], names=["doc_id", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(tag, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,chance:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def _spans(text: str, found: list[tuple[int, float]]) -> list[dict]:
    """Offsets of runs of words, by their indexes."""
    out, at, word = [], 0, -1
    if not found:
        return out
    pieces = text.split()  # as lower().split(): lower-casing neither makes nor takes white space
    for i, p in found:
        while word < i:
            word += 1
            begin = text.index(pieces[word], at)
            at = begin + len(pieces[word])
        if out and out[-1]["last"] == i - 1:
            out[-1] |= {"end": at, "last": i, "chance": max(p, out[-1]["chance"])}
        else:
            out.append({"start": begin, "end": at, "last": i, "chance": p})
    return [{k: s[k] for k in ("start", "end", "chance")} for s in out]


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that the model does not call toxic. Texts are judged row by row, so repeated rows and rows without an
    id each by their own; null and empty texts have the score of a text without toxic words. An empty table gives none."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for part, texts in text_rows(batches, text_col):
            keep = [_score(shared.value, tagger.marginals(words_of(t.decode()))) < threshold for t in texts]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxicity() of documents by a model of their labels; nulls, repeats and empty tables as there."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))
