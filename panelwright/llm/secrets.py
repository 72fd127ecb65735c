"""Secret scans: fixed patterns, and strings whose characters follow one another as in random strings.

Two Markov models of characters, one of random strings and one of ordinary identifiers, are counted from labelled samples: generated strings, and all
words of the corpus that no pattern takes for a secret. A run of token characters is a secret if the random model explains it better by a
number of nats that is chosen on samples that were held out. Everything is an SQL expression over the row; only counts of character pairs, at
most RANGE * RANGE of each label, and of ratios come to the driver.

Spark's regexp functions give matches without places, so places come from running sums of the lengths of matches and of what lies between. Running sums
are made by doubling, so a text with n matches takes n log n steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored, text_or_empty

#: Fixed patterns by kind, in order, and the least length: of the value for assign, of the match for the others. The latter
#: two match whole runs, so asking for the length in the pattern finds the same runs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: Runs that the models judge, and the range of their characters, + to z.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
FIRST, RANGE = ord("+"), ord("z") - ord("+") + 1
#: Generated random strings, and nats of log-likelihood ratio that make a secret where no held-out samples say otherwise.
SAMPLE_STRINGS, THRESHOLD = 8000, 8.0
#: One sample in so many is held out; a false find counts as so many missed ones; the threshold is between these, in nats.
HELD_OUT_OF, FALSE_FIND, LEAST, MOST = 4, 20, 2, 16
#: Running sums reach over 2 ** DOUBLINGS matches of a text, more than a string of 2 GB can have.
DOUBLINGS = 28
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _named(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(a: Column) -> Column:
    """Sums of an array's elements up to each."""
    def doubled(step: int):
        return lambda v: F.when(F.size(v) <= step, v).otherwise(F.transform(v, lambda x, i: F.when(i >= step, x + F.get(v, i - step)).otherwise(x)))

    for k in range(DOUBLINGS):
        a = _named(a, doubled(1 << k))
    return a


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """The matches of pattern in text as (start, kind, end) in code points; keep says from the index which stay."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.struct(matches.alias("m"), between.alias("b"))

    def place(x: Column) -> Column:
        m = F.transform(x["m"], lambda y: F.char_length(y))
        steps = F.transform(x["m"], lambda _, i: F.char_length(F.get(x["b"], i)) + F.when(i > 0, F.char_length(F.get(x["m"], i - 1))).otherwise(0))
        at = F.zip_with(_running(steps), m, lambda start, n: F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + n).alias("end")))
        return at if keep is None else F.filter(at, lambda _, i: keep(text, x["m"], i))

    # transform over a single struct evaluates matches and between once
    placed = F.flatten(F.transform(F.array(both), place))
    return F.when(F.rlike(text, F.lit(pattern)), placed).otherwise(F.array().cast(_SPANS))


def _assigned(text: Column) -> Column:
    """Each pattern's second group is looked at by itself: its match, matched again, is the same match."""
    def keep(_, matches: Column, i: Column) -> Column:
        return F.char_length(F.regexp_extract(F.get(matches, i), ASSIGN, 2)) >= ASSIGN_LEAST

    return _spans(text, ASSIGN, 0, keep)


def default_samples(docs: DataFrame, text_col: str = "text", strings: int = SAMPLE_STRINGS) -> DataFrame:
    """Labelled samples (sample, secret, n): random strings of 16 to 40 characters made of digests, and every word of docs outside the fixed patterns'
    matches, with the number of times it is there."""
    random = docs.sparkSession.range(strings, numPartitions=1).select(F.sha2(F.encode(F.concat(F.lit("sample"), F.col("id").cast("string")), "UTF-8"), 512).alias("x"), "id")
    plain = F.regexp_replace(F.base64(F.unhex("x")), "[+/=]", "")
    forms = [F.base64(F.unhex("x")), F.col("x"), plain, F.upper(plain)]
    length = (16 + F.floor(F.col("id") / len(forms)) % 25).cast("int")
    made = random.select(F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int")).alias("form"), length.alias("length")).select(F.substring("form", F.lit(1), F.col("length")).alias("sample"), F.lit(True).alias("secret"), F.lit(1).cast("long").alias("n"))
    text = F.col("text")
    plain_text = F.when(F.rlike(text, F.lit(ASSIGN)), F.regexp_replace(text, ASSIGN, " ")).otherwise(text)
    found = docs.select(text_or_empty(text_col).alias("text")).select(F.explode_outer(F.regexp_extract_all(plain_text, F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("sample")).where("sample is not null")
    words = found.groupBy("sample").agg(F.count("*").alias("n")).where(~F.rlike("sample", F.lit(f"{ACCESS}|{HEX}")))
    return made.unionByName(words.select("sample", F.lit(False).alias("secret"), "n"))


def _is_held_out() -> Column:
    return F.crc32(F.encode("sample", "UTF-8")) % HELD_OUT_OF == 0


def fitted(docs: DataFrame, text_col: str = "text") -> tuple[list[float], float]:
    """Models of default_samples() without those held out, and the threshold that those call for."""
    samples = stored(default_samples(docs, text_col), "secret-samples")
    model = train(samples.where(~_is_held_out()))
    return model, fitted_threshold(samples.where(_is_held_out()), model)


def fitted_threshold(samples: DataFrame, model: list[float]) -> float:
    """The ratio from LEAST to MOST, in half nats, that has the least cost on samples (sample, secret) of a run's length: a share of missed secrets,
    and FALSE_FIND times the share of false finds; of equal ones the middle. Without samples of both labels THRESHOLD."""
    ratio = F.floor(2 * _ratio(F.col("sample"), _table(model)))
    rows = samples.where(F.rlike("sample", F.lit(f"^{RUN}$"))).groupBy("secret", ratio.alias("half")).agg(F.count("*").alias("n")).collect()  # half nats of runs: few
    of = {label: sorted((r["half"], r["n"]) for r in rows if r["secret"] == label) for label in (True, False)}
    if not of[True] or not of[False]:
        return THRESHOLD
    share = lambda label, keep: sum(n for h, n in of[label] if keep(h)) / sum(n for _, n in of[label])
    cost = {h: share(True, lambda x, h=h: x < h) + FALSE_FIND * share(False, lambda x, h=h: x >= h) for h in range(2 * LEAST, 2 * MOST + 1)}
    best = [h for h in cost if cost[h] == min(cost.values())]
    return best[len(best) // 2] / 2


def _table(model: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, by (first - FIRST) * RANGE + second - FIRST, of samples (sample, secret, n). Null samples and characters
    outside the range count for nothing; without samples of a label all its pairs are equally likely."""
    chars = samples.where("sample is not null").select("secret", "n", F.split("sample", "").alias("c"))
    pairs = chars.select("secret", "n", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("c")), lambda i: F.struct(F.ascii(F.get("c", i - 1)).alias("a"), F.ascii(F.get("c", i)).alias("b")))).alias("p")).select("secret", "n", "p.a", "p.b")
    inside = pairs.where(F.col("a").between(FIRST, FIRST + RANGE - 1) & F.col("b").between(FIRST, FIRST + RANGE - 1))
    counts = {(r["secret"], r["a"] - FIRST, r["b"] - FIRST): r["n"] for r in inside.groupBy("secret", "a", "b").agg(F.sum("n").alias("n")).collect()}
    used = [i for i in range(RANGE) if chr(FIRST + i).isalnum() or chr(FIRST + i) in "+/_=-"]
    table = [0.0] * (RANGE * RANGE)
    for label, sign in ((True, 1), (False, -1)):
        single = {b: 0.5 + sum(counts.get((label, a, b), 0) for a in used) for b in used}
        every = sum(single.values())
        for a in used:
            row = sum(counts.get((label, a, b), 0) for b in used)
            for b in used:
                # pairs back off to single characters with the weight of five observations
                table[a * RANGE + b] += sign * math.log((counts.get((label, a, b), 0) + 5 * single[b] / every) / (row + 5))
    return table


def _ratio(run: Column, table: Column) -> Column:
    """Log-likelihood ratio of a run, from the codes of its characters."""
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - FIRST)
    # the accumulator holds the last code and the sum
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(codes, start, lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.when((s["last"] >= 0) & (c >= 0), F.get(table, s["last"] * RANGE + c)).otherwise(0.0)).alias("sum")), lambda s: s["sum"])


def secrets(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive) of every row of docs, by start and then kind.

    Patterns are matched from left to right without overlap, each kind for itself; runs that the models call secret are
    further spans of the kind markov unless one of the patterns has that very span. Null and empty texts have no spans.
    Repeated rows and null ids each give a row. Only the named columns are read.
    """
    table = _table(model)
    t = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = rows.select("doc_id", F.concat(_assigned(t), _spans(t, ACCESS, 1), _spans(t, HEX, 2)).alias("base"), _spans(t, RUN, 3, lambda _, m, i: _ratio(F.get(m, i), table) >= threshold).alias("more"))
    # places as one number each, for array_except() looks those up by hash
    place = lambda spans: F.transform(spans, lambda s: F.shiftleft(s["start"].cast("long"), 31).bitwiseOR(s["end"].cast("long")))
    rest = F.array_except(place("more"), place("base"))
    more = F.transform(rest, lambda c: F.struct(F.shiftright(c, 31).cast("int").alias("start"), F.lit(KINDS.index("markov")).alias("kind"), c.bitwiseAND((1 << 31) - 1).cast("int").alias("end")))
    spans = F.array_sort(F.concat("base", more))
    names = F.array(*map(F.lit, KINDS))
    return found.select("doc_id", F.transform(spans, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def redact(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every run or pattern match that holds a secret replaced by mark. Null texts stay null; repeated rows are treated alike, other columns are as
    they were, and an empty table gives none."""
    table = _table(model)
    text = F.col(text_col)
    for pattern in (ACCESS, HEX, ASSIGN.replace("+)", "{%d,})" % ASSIGN_LEAST)):
        text = F.regexp_replace(text, pattern, mark)
    parts = F.struct(F.split(text, RUN, -1).alias("b"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("m"))
    kept = F.transform(F.array(parts), lambda x: F.array_join(F.transform(x["b"], lambda b, i: F.concat(b, F.when(F.get(x["m"], i).isNull(), "").when(_ratio(F.get(x["m"], i), table) >= threshold, mark).otherwise(F.get(x["m"], i)))), ""))
    return docs.withColumn(text_col, F.when(F.rlike(text, F.lit(RUN)), F.get(kept, F.lit(0))).otherwise(text))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents under models fitted to them; nulls, repeats and empty tables as in secrets()."""
    docs = read_table(spark, sf_dir, "documents")
    found = secrets(docs, *fitted(docs))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.encode(line(base), "UTF-8"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
