import random
import re
import string

import pytest

from panelwright.llm.secrets import default_samples, fitted, redact, secrets, train

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(5)
    words = ["".join(r.choice(["the", "tion", "er", "an", "ou", "heit", "mente", "ing", "_", "Id"]) for _ in range(r.randrange(1, 6))) for _ in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(200)], "doc_id long, text string")
    return fitted(docs)


def test_base_spans_match_regular_expressions(spark, model):
    r = random.Random(3)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", ":", "=", " ", "  ", '"', "'", "\n", "abc", "abcdef", "hunter2", "a" * 30, "0123456789abcdef" * 2, "AKIA", "AKIA" + "Z9" * 8, "AKIAAKIA" + "Q" * 12, "ſecret", "toKen", "é", "日本", "🙂", "x.y-z/w+", "deadbeef"]
    texts = [None, "", "token: token: abcdefgh", "token=token:abcdef", "apikey='" + "x" * 3000, "🙂token=abcdefg " * 300] + ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, "secret=abcdef", "n", 2)], "doc_id long, text string, base string, more int").repartition(4)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets(docs, *model).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] != "markov"] == base(t), t
        assert got[i] == sorted(got[i], key=lambda s: (s[1], ["assign", "access", "hex", "markov"].index(s[0])))
    assert got[None] == [("assign", 0, 13)]


def test_models_tell_random_strings_from_words(spark, model):
    r = random.Random(9)
    make = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    random_strings = [make(string.ascii_letters + string.digits + "+/", r.randrange(24, 50)) for _ in range(200)]
    names = ["".join(r.choice(["the", "tion", "er", "an", "ou", "heit", "mente", "ing"]) for _ in range(r.randrange(6, 12))) for _ in range(200)]
    docs = spark.createDataFrame([(i, f"see {x} there") for i, x in enumerate(random_strings + names)], "doc_id long, text string")
    out = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "markov"] for r in secrets(docs, *model).collect()}
    hits = [bool(out[i]) for i in range(400)]
    assert sum(hits[:200]) >= 195 and sum(hits[200:]) == 0
    assert (out[0][0]["start"], out[0][0]["end"]) == (4, 4 + len(random_strings[0]))
    clean = {r["doc_id"]: r["text"] for r in redact(docs, *model).collect()}
    assert clean[0] == "see [secret] there" and clean[250] == f"see {names[50]} there"


def test_empty(spark, model):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert secrets(docs, *model).count() == 0
    assert len(train(default_samples(docs))) == len(model[0]) and fitted(docs)[1] == 8.0


@pytest.mark.parametrize("length", [16, 18, 20, 22, 24])
def test_recall_of_short_random_strings(spark, model, length):
    r = random.Random(length)
    texts = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(length)) for _ in range(300)]
    out = secrets(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string"), *model).collect()
    assert sum(any(s["kind"] == "markov" for s in x["spans"]) for x in out) >= (285 if length >= 20 else 255)


def test_very_many_matches_in_a_text(spark, model):
    """60,000 identifiers and assignments in one text of over a million characters, and rows that repeat."""
    parts = [f"identifier_of_row_{i:06d}" if i % 3 else f"token=abcdef{i:06d}" for i in range(60_000)]
    text = "\n".join(parts)
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, None, "c")], "doc_id long, text string, spans string")
    out = secrets(docs, *model).collect()
    assert len(out) == 3
    for row in out:
        spans = [tuple(s) for s in row["spans"] if s["kind"] != "markov"]
        assert spans == (base(text) if row["doc_id"] == 1 else [])
    assert redact(docs, *model).columns == docs.columns
