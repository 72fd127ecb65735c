"""Aliases of companies, and news rows mapped to companies by code or by alias."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import text
from panelwright.sources.tables import stored

from .joins import dimension

#: Corporate suffixes, lower case; a parameter of the functions below.
SUFFIXES = ["co", "company", "corp", "corporation", "group", "holding", "holdings", "inc", "incorporated", "llc", "ltd", "limited", "nv", "plc", "sa", "the"]
#: Characters of the words in one automaton: 117 MB in a worker for names of four words, measured. Up to so many go to every task; more are dealt to
#: several automata.
AUTOMATON_CHARS = 4_000_000
#: Characters of the texts that meet an automaton in one task, if there are several.
BLOCK_CHARS = 16_000_000
#: Characters of a word's beginning, by which the words are dealt: 37^3 beginnings at most.
START = 3


def alias_table(universe: DataFrame, suffixes: list[str] | None = None, include_ticker: bool = True) -> DataFrame:
    """Aliases of each company: its name (primary), the name without suffixes, without punctuation, with & spelled out, and its ticker.
    Of those that normalise alike within a ticker the first in that order stays. Sorted by ticker, type and alias."""
    name = text.strip(text.or_empty("company_name"))
    bare, plain, spelled = text.without_suffixes(name, SUFFIXES if suffixes is None else suffixes), text.without_punctuation(name), F.replace(name, F.lit("&"), F.lit("and"))
    one = lambda alias, kind, primary=False: F.struct(alias.alias("alias"), F.lit(kind).alias("alias_type"), F.lit(primary).alias("is_primary"))
    other = lambda alias, kind: one(F.when(alias != name, alias), kind)
    made = [one(name, "company_name", True), other(bare, "company_name_no_suffix"), other(plain, "company_name_no_punctuation"), other(spelled, "company_name_ampersand")]
    if include_ticker:
        made.append(one(text.key("ticker"), "ticker"))
    rows = universe.select("ticker", text.or_empty("price_ticker").alias("price_ticker"), "company_name", text.or_empty("cik").alias("cik"), F.posexplode(F.array(*made)).alias("pos", "a")).select("*", "a.*").drop("a")
    rows = rows.withColumn("alias_normalized", text.normalized_alias("alias")).where("alias_normalized <> ''")
    w = Window.partitionBy("ticker", "alias_normalized").orderBy("pos", "company_name")
    kept = rows.withColumn("n", F.row_number().over(w)).where("n = 1")
    return kept.select("ticker", "price_ticker", "company_name", "cik", "alias", "alias_normalized", "alias_type", "is_primary")


def alias_metadata(aliases: DataFrame) -> DataFrame:
    return aliases.agg(F.count("*").alias("row_count"), F.count_distinct("ticker").alias("ticker_count"))


#: The order in which aliases that a text contains are preferred: longer first, then primary ones, then by ticker, type and alias.
ORDER = ["shorter", "lesser", "ticker", "alias_type", "alias"]


def probe_list(aliases: DataFrame, min_length: int = 4, whole_words: bool = False) -> DataFrame:
    """The words to look for in normalised texts, each once, with the first alias, by ORDER, that has this form. Normalised texts hold a-z, 0-9
    and blanks only, so an alias with anything else is in none of them."""
    form, pad = F.col("alias_normalized"), F.lit(" " if whole_words else "")
    lesser = F.when(F.col("is_primary"), 0).when(~F.col("is_primary"), 1).otherwise(2)
    first = F.min(F.struct((-F.char_length(form)).alias("shorter"), lesser.alias("lesser"), *ORDER[2:]))
    kept = aliases.where((F.char_length(form) >= min_length) & form.rlike("^[a-z0-9 ]+$"))
    return kept.groupBy(F.concat(pad, form, pad).alias("word")).agg(first.alias("a")).select("word", "a.*")


@dataclass(frozen=True)
class MappingConfig:
    text_columns: list[str] = field(default_factory=lambda: ["title", "body"])
    alias_min_length: int = 4
    legacy: dict[str, str] = field(default_factory=dict)
    whole_words: bool = False
    version: str = "v1"
    #: Most rows without a code whose text is looked at, in order of scan_order, in each of scan_by's groups; None: all rows.
    scan_limit: int | None = None
    scan_by: list[str] = field(default_factory=list)
    scan_order: list[str] = field(default_factory=lambda: ["news_id"])


def mapped_by_code(news: DataFrame, universe: DataFrame, legacy: dict[str, str]) -> DataFrame:
    """Adds source_ticker and mapping_method from the row's code: a ticker, else a price ticker, else a former ticker. Empty codes map to
    nothing. Of universe rows with the same key the last ticker wins. The tables are no larger than the universe and are broadcast if that is
    small, so that rows without a code, often very many, do not meet in one task."""
    spark = news.sparkSession
    pick = lambda key: universe.select(text.key(key).alias("k"), F.col("ticker")).where("k <> ''").groupBy("k").agg(F.max("ticker").alias("ticker"))
    former = spark.createDataFrame([(k.strip().upper(), v) for k, v in legacy.items() if k.strip()], "k string, ticker string")
    out = news.withColumn("__key", text.key("ticker_raw"))
    for name, table in (("t", pick("ticker")), ("p", pick("price_ticker")), ("l", former)):
        side = table.select(F.col("k").alias(f"__{name}k"), F.col("ticker").alias(f"__{name}"))
        out = out.join(F.broadcast(side) if name == "l" else dimension(side), F.col("__key") == F.col(f"__{name}k"), "left").drop(f"__{name}k")
    method = F.when(F.col("__t").isNotNull(), "ticker_raw").when(F.col("__p").isNotNull(), "price_ticker").when(F.col("__l").isNotNull(), "legacy_ticker")
    return out.withColumn("source_ticker", F.coalesce("__t", "__p", "__l")).withColumn("mapping_method", method).drop("__key", "__t", "__p", "__l")


def in_order(words: pa.Table) -> pa.Table:
    return words.take(pc.sort_indices(words, sort_keys=[(c, "ascending") for c in ORDER], null_placement="at_start"))


def automaton_of(words: list[str]) -> Any:
    """Finds words in a text, each with its place in the list; None without any."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for place, word in enumerate(words):
        made.add_word(word, place)
    made.make_automaton()
    return made if len(made) else None


def least_place(automaton: Any, t: str | None) -> int | None:
    return min((place for _, place in automaton.iter(t)), default=None) if t and automaton else None


#: The automaton and the tickers a worker made last, by the name of its aliases.
_BUILT: dict[str, Any] = {}


def sent_automaton(name: str, sent: Broadcast) -> Any:
    if name not in _BUILT:
        words, tickers = sent.value
        _BUILT.clear()
        _BUILT[name] = automaton_of(words.to_pylist()), tickers.to_pylist()
    return _BUILT[name]


def first_alias(c: Column, probes: DataFrame) -> Column:
    """The ticker of the first alias, by ORDER, whose word the text c contains, or null. All aliases are looked for in one pass over the text. They
    are read once, sent as one broadcast variable, and each worker builds its automaton once."""
    listed = in_order(probes.toArrow())
    sent, name = probes.sparkSession.sparkContext.broadcast((listed["word"].combine_chunks(), listed["ticker"].combine_chunks())), uuid.uuid4().hex

    @F.pandas_udf("string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, tickers = sent_automaton(name, sent)
        for texts in batches:
            places = [least_place(automaton, t) for t in texts]
            yield pd.Series([None if i is None else tickers[i] for i in places], dtype=object)

    return find(c)


def dealt(chars: dict[str, int]) -> tuple[dict[str, tuple[int, int]], int]:
    """For each beginning of a word the first of its automata and how many it has, and the number of all automata, of AUTOMATON_CHARS at most
    (about so, where one beginning needs several). chars: those of the words that begin so."""
    out, n, filled = {}, 0, 0
    for start in sorted(chars):
        if chars[start] > AUTOMATON_CHARS:
            need = -(-chars[start] // AUTOMATON_CHARS)
            n, filled = n + (filled > 0), 0
            out[start], n = (n, need), n + need
        else:
            if filled + chars[start] > AUTOMATON_CHARS:
                n, filled = n + 1, 0
            out[start], filled = (n, 1), filled + chars[start]
    return out, n + (filled > 0)


def first_aliases(texts: DataFrame, probes: DataFrame, chars: dict[str, int]) -> DataFrame:
    """key and ticker of those texts (key, text) that contain a word: what first_alias says, for any number of aliases. The words are dealt to
    automata by how they begin, and a text goes to those automata of which it contains a beginning, in blocks; one task holds one of them at a time."""
    spark = texts.sparkSession
    places, _ = dealt(chars)
    wide, sent = max(map(len, places)), spark.sparkContext.broadcast(places)
    blocks = -(-(texts.agg(F.sum(F.char_length("text"))).first()[0] or 1) // BLOCK_CHARS)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value
        for batch in batches:
            found = []
            for t in batch.column("text").to_pylist():
                met = places.keys() & {t[i : i + wide] for i in range(len(t) - wide + 1)}
                found.append(sorted({first + i for first, n in map(places.get, met) for i in range(n)}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=["key", "text", "automata"])

    def answered(texts: pa.Table, words: pa.Table) -> pa.Table:
        words = in_order(words)
        automaton = automaton_of(words["word"].to_pylist()) if len(texts) else None
        found = [least_place(automaton, t.as_py()) for t in texts["text"]]
        hits = pa.array([i is not None for i in found], pa.bool_())
        out = words.select(ORDER).take(pa.array([i for i in found if i is not None], pa.int64()))
        return out.add_column(0, "key", texts["key"].filter(hits))

    starts = spark.createDataFrame([(s, first, n) for s, (first, n) in places.items()], "start string, first int, n int")
    word = probes.withColumn("start", F.substring("word", 1, wide)).join(F.broadcast(starts), "start")
    word = word.select("word", *ORDER, (F.col("first") + F.pmod(F.xxhash64("word"), F.col("n"))).cast("int").alias("automaton"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sides = texts.mapInArrow(routed, "key string, text string, automata array<int>").select("key", "text", F.explode("automata").alias("automaton"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))
    one = sides.groupBy("automaton", "block").cogroup(word.groupBy("automaton", "block")).applyInArrow(answered, "key string, shorter int, lesser int, ticker string, alias_type string, alias string")
    return one.groupBy("key").agg(F.min(F.struct(*ORDER)).alias("a")).select("key", "a.ticker")


def mapped_by_text(news: DataFrame, aliases: DataFrame, config: MappingConfig) -> DataFrame:
    """Maps the rows without a source_ticker to the first alias, by ORDER, that their text contains. Aliases of the kind ticker take part
    like any other that is long enough. Every such row is looked at, unless config.scan_limit says less. Aliases are stored once in the shared folder;
    too many for one automaton are dealt to several, each different text is looked up once, and what is found is joined to the rows."""
    probes = stored(probe_list(aliases, config.alias_min_length, config.whole_words), "aliases")
    size = F.char_length("word")
    starts = probes.groupBy(F.substring("word", 1, START).alias("start")).agg(F.sum(size).alias("chars"), F.min(size).alias("least")).collect()
    body = text.normalized_alias(text.joined(config.text_columns))
    if config.whole_words:
        body = F.concat(F.lit(" "), body, F.lit(" "))
    looked_at = F.col("source_ticker").isNull()
    if config.scan_limit is not None:
        # rows with a code, often most of a group, have no place in it: they are spread by hash
        apart = F.when(~looked_at, F.pmod(F.xxhash64(*config.scan_order), F.lit(1024)))
        place = F.row_number().over(Window.partitionBy(*config.scan_by, apart).orderBy(*config.scan_order))
        news = news.withColumn("__scan", place <= config.scan_limit)
        looked_at = looked_at & F.col("__scan")
    if sum(r["chars"] for r in starts) <= AUTOMATON_CHARS:
        out = news.withColumn("__ticker", F.when(looked_at, first_alias(F.when(looked_at, body), probes)))
    else:
        chars, wide = Counter(), min(START, *(r["least"] for r in starts))
        for r in starts:
            chars[r["start"][:wide]] += r["chars"]
        texts = news.where(looked_at).select(body.alias("text")).where("text <> ''").distinct().select(text.digest("text").alias("key"), "text")
        found = stored(first_aliases(stored(texts, "texts"), probes, chars), "found").select(F.col("key").alias("__found"), F.col("ticker").alias("__ticker"))
        # rows that are not looked at, often most, match nothing: they are spread by hash
        key = F.when(looked_at, text.digest(body)).otherwise(F.xxhash64("source_ticker", *config.text_columns).cast("string"))
        out = news.withColumn("__key", key).join(dimension(found), F.col("__key") == F.col("__found"), "left").drop("__key", "__found")
    return out.withColumn("mapping_method", F.when(F.col("__ticker").isNotNull() & F.col("source_ticker").isNull(), "alias_text").otherwise(F.col("mapping_method"))).withColumn("source_ticker", F.coalesce("source_ticker", "__ticker")).drop("__ticker", "__scan")


def finished(news: DataFrame, universe: DataFrame, version: str) -> DataFrame:
    """Adds the company's attributes (empty if it is not in the universe), confidence and is_mapped."""
    company = universe.groupBy(F.col("ticker").alias("__t")).agg(F.max("price_ticker").alias("source_price_ticker"), F.max("company_name").alias("source_company_name"))
    out = news.join(dimension(company), F.col("source_ticker") == F.col("__t"), "left").drop("__t")
    mapped = F.col("source_ticker").isNotNull() & (F.col("source_ticker") != "")
    method = F.coalesce("mapping_method", F.lit("none"))
    return out.withColumns(
        {
            "source_ticker": text.or_empty("source_ticker"),
            "source_price_ticker": text.or_empty("source_price_ticker"),
            "source_company_name": text.or_empty("source_company_name"),
            "mapping_method": method,
            "mapping_confidence": F.when(~mapped, "none").when(method == "alias_text", "medium").otherwise("high"),
            "is_mapped": mapped,
            "version": F.lit(version),
        }
    )


def map_news(news: DataFrame, universe: DataFrame, aliases: DataFrame, config: MappingConfig | None = None) -> DataFrame:
    """News rows with source_ticker, mapping_method, source_price_ticker, source_company_name, mapping_confidence and is_mapped."""
    config = config or MappingConfig()
    return finished(mapped_by_text(mapped_by_code(news, universe, config.legacy), aliases, config), universe, config.version)


def mapping_stats(mapped: DataFrame) -> DataFrame:
    return mapped.agg(F.count("*").alias("rows_written"), F.count_if("is_mapped").alias("rows_mapped"))
