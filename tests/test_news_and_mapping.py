import json
import os
import re

import pytest
from pyspark.sql import functions as F

from panelwright.functions import protocol, text
from panelwright.operators import aliases, normalize, resolve, sampling
from panelwright.sources import tables
from panelwright.streaming import ingest

RAW = list(normalize.RAW_COLUMNS)


def raw(spark, *rows):
    """Rows of Date, title, symbol, url, body; the rest is empty."""
    full = [(d, t, s, u, "", "", b, "", "", "", "", i + 1) for i, (d, t, s, u, b) in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in RAW) + ", line long")


def test_two_sources_collapse(spark):
    w = protocol.Window()
    first = normalize.standardized(raw(spark, ("2015-09-01 10:00:00 UTC", "t", "AAPL", "http://u", ""), ("2024-01-01", "late", "MSFT", "http://v", "x"), ("2010-01-01", "old", "M", "http://w", "x"), ("junk", "none", "M", "http://z", "x")), "All_external.csv", 2, w, "line")
    second = normalize.standardized(raw(spark, ("2015-09-01 11:00:00 UTC", "t", "AAPL", "http://u", "Body wins"), ("2016-03-01", "T" * 60, "IBM", " ", ""), ("2016-03-01", "T" * 55 + "other", "IBM", "", "b")), "nasdaq_exteral_data.csv", 1, w, "line")
    rows = {r["title"][:4]: r for r in normalize.news([first, second]).collect()}
    assert len(rows) == 3
    assert rows["t"]["body"] == "Body wins" and rows["t"]["source_file"] == "nasdaq_exteral_data.csv" and rows["t"]["is_warmup"]
    assert rows["late"]["has_content"] and not rows["late"]["is_warmup"] and not rows["late"]["in_evaluation_window"]
    assert rows["TTTT"]["body"] == "b" and rows["TTTT"]["in_evaluation_window"]
    tie = normalize.news([first, first.withColumn("source_file", first.source_file.substr(1, 3))]).where("title = 'late'").collect()
    assert [r["source_file"] for r in tie] == ["All"]


def test_csv_reads_as_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Unnamed: 0,x,y\n0,"say ""hi""\nthere",NA\n1,,007\n')
    got = [tuple(r) for r in tables.strings(spark, f"file://{tmp_path}/a.csv").collect()]
    assert got == [("0", 'say "hi"\nthere', ""), ("1", "", "007")]


def test_text_functions(spark):
    df = spark.createDataFrame([("AT&T Inc",), ("Amazon.com, Inc.",), ("Inc Corp",), (" A & B\t\x1f",), (None,)], "n string")
    rows = df.select(text.normalized_alias("n"), text.without_suffixes("n", aliases.SUFFIXES), text.without_punctuation("n"), text.key("n")).collect()
    assert tuple(rows[0]) == ("at and t inc", "AT&T", "AT&T Inc", "AT&T INC")
    assert rows[1][1] == "Amazon com" and rows[2][1] == "" and rows[3][3] == "A & B" and tuple(rows[4]) == (None, None, None, "")
    d = spark.createDataFrame([([" a", "b", "a ", "", None],), (None,)], "x array<string>").select(text.distinct_texts("x")).collect()
    assert [r[0] for r in d] == [["a", "b"], []]


UNIVERSE = [("AAPL", "AAPL", "Apple Inc.", ""), ("MSFT", "", "Microsoft Corporation", ""), ("T", "T.N", "AT&T Inc", ""), ("X1", "X1", "Twin Co", ""), ("X2", "X2", "Twin Inc", "")]


@pytest.fixture
def universe(spark):
    return spark.createDataFrame(UNIVERSE, "ticker string, price_ticker string, company_name string, cik string")


def test_aliases(universe):
    rows = {(r["ticker"], r["alias_normalized"]): r for r in aliases.alias_table(universe).collect()}
    assert rows["AAPL", "apple inc"]["is_primary"] and rows["AAPL", "apple"]["alias_type"] == "company_name_no_suffix"
    assert ("AAPL", "apple inc") in rows and rows["T", "atandt inc"]["alias_type"] == "company_name_ampersand" and rows["AAPL", "aapl"]["alias_type"] == "ticker"
    assert not any(r["alias_type"] == "company_name_no_punctuation" for r in rows.values())


def test_mapping_by_code_then_alias(spark, universe):
    news = spark.createDataFrame([("1", " aapl ", "x", ""), ("2", "t.n", "x", ""), ("3", "FB", "x", ""), ("4", "", "why Microsoft Corporation and apple rise", ""), ("5", None, None, "pineapple"), ("6", "ZZ", "nothing", ""), ("7", "", "", "")], "news_id string, ticker_raw string, title string, body string")
    out = {r["news_id"]: r for r in aliases.map_news(news, universe, aliases.alias_table(universe), aliases.MappingConfig(legacy={"fb": "META"})).collect()}
    want = {"1": ("AAPL", "ticker_raw", "high"), "2": ("T", "price_ticker", "high"), "3": ("META", "legacy_ticker", "high"), "4": ("MSFT", "alias_text", "medium"), "5": ("AAPL", "alias_text", "medium"), "6": ("", "none", "none"), "7": ("", "none", "none")}
    assert {k: (r["source_ticker"], r["mapping_method"], r["mapping_confidence"]) for k, r in out.items()} == want
    assert out["3"]["is_mapped"] and out["3"]["source_company_name"] == "" and not out["7"]["is_mapped"]
    words = aliases.map_news(news, universe, aliases.alias_table(universe), aliases.MappingConfig(whole_words=True))
    assert words.where("news_id = '5'").first()["mapping_method"] == "none"


@pytest.mark.parametrize("whole_words", [False, True])
@pytest.mark.parametrize("one_holds", [12, 60, 10**6])
def test_any_number_of_aliases(spark, monkeypatch, whole_words, one_holds):
    """More aliases than one automaton holds give what a search for each alias gives."""
    monkeypatch.setattr(aliases, "MAX_ALIASES", 5, raising=False)
    monkeypatch.setattr(aliases, "AUTOMATON_CHARS", one_holds, raising=False)
    monkeypatch.setattr(aliases, "BLOCK_CHARS", 100, raising=False)
    names = ["red bolt", "red bolt", "red", "red ring", "bolt", "ed", "ring x9", "r\u00e9d", None, "b", "bolt a", "bolt b", "bolt c"]
    rows = [(f"T{i % 7}", n, n, ("company_name", "ticker")[i % 2], (True, False, None)[i % 3]) for i, n in enumerate(names)] + [(f"P{i}", f"P{i}", f"p{i}", "ticker", False) for i in range(100, 140)]
    table = spark.createDataFrame(rows, "ticker string, alias string, alias_normalized string, alias_type string, is_primary boolean")
    titles = ["Red bolt", "a red  ring", "cured", "P117 and p1390", "bolt", "", None, "none", "ring-x9 bolt b", "b", "p10 p100p", "RED BOLT", "bolt c bolt a"] * 3
    news = spark.createDataFrame([(i, t, "Z" if i % 9 == 8 else None) for i, t in enumerate(titles)], "i int, title string, source_ticker string").withColumn("mapping_method", F.when(F.col("source_ticker").isNotNull(), "ticker_raw"))

    def first(t):
        t = " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
        found = [r for r in rows if r[2] and len(r[2]) >= 2 and (f" {r[2]} " in f" {t} " if whole_words else r[2] in t)]
        return min(((-len(r[2]), {True: 0, False: 1, None: 2}[r[4]], r[0], r[3], r[1]) for r in found), default=(0, 0, None))[2]

    out = aliases.mapped_by_text(news, table, aliases.MappingConfig(text_columns=["title"], alias_min_length=2, whole_words=whole_words))
    want = {i: ("Z", "ticker_raw") if i % 9 == 8 else (first(t), "alias_text" if first(t) else None) for i, t in enumerate(titles)}
    assert {r["i"]: (r["source_ticker"], r["mapping_method"]) for r in out.collect()} == want and out.columns == news.columns
    none = aliases.mapped_by_text(news, table.limit(0), aliases.MappingConfig(text_columns=["title"]))
    assert none.count() == len(titles) and none.where("mapping_method = 'alias_text'").count() == 0


def test_scan_limit_with_many_aliases(spark, monkeypatch):
    """Of each file the first rows without a code are looked at, also where the aliases are dealt to several automata."""
    monkeypatch.setattr(aliases, "MAX_ALIASES", 5, raising=False)
    monkeypatch.setattr(aliases, "AUTOMATON_CHARS", 50, raising=False)
    table = spark.createDataFrame([(f"P{i}", f"P{i}", f"p{i}", "ticker", False) for i in range(1000, 1040)], "ticker string, alias string, alias_normalized string, alias_type string, is_primary boolean")
    news = spark.createDataFrame([(f"n{i:02d}", "ab"[i % 2], f"of p{1000 + i % 7}", "Z" if i % 3 == 0 else None) for i in range(40)], "news_id string, source_file string, title string, source_ticker string").withColumn("mapping_method", F.lit(None).cast("string"))
    out = aliases.mapped_by_text(news, table, aliases.MappingConfig(text_columns=["title"], scan_limit=3, scan_by=["source_file"]))
    looked_at = {i for f in (0, 1) for i in [i for i in range(40) if i % 2 == f and i % 3][:3]}
    assert {r["news_id"]: r["source_ticker"] for r in out.collect()} == {f"n{i:02d}": "Z" if i % 3 == 0 else f"P{1000 + i % 7}" if i in looked_at else None for i in range(40)}


def test_resolver(spark, universe):
    a = aliases.alias_table(universe)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["Apple", "msft", "Twin", " ", None, "--", "Acme", "AT&T"])], "i int, target string")
    got = {r["i"]: (r["status"], r["resolved_ticker"], r["match_type"]) for r in resolve.resolved(rows, a).collect()}
    assert got == {0: ("resolved", "AAPL", "exact_alias"), 1: ("resolved", "MSFT", "exact_ticker"), 2: ("ambiguous", "", "ambiguous_alias"), 3: ("empty", "", ""), 4: ("empty", "", ""), 5: ("empty", "", ""), 6: ("unresolved", "", "no_match"), 7: ("resolved", "T", "exact_alias")}
    parsed = spark.createDataFrame([("n", "AAPL", ["Apple", "msft", "Microsoft", "Acme", "Twin"]), ("m", "T", None)], "news_id string, source_ticker string, extracted_targets array<string>")
    out = {r["news_id"]: r for r in resolve.resolved_lists(parsed, a).collect()}
    assert (out["n"]["resolved_target_tickers"], out["n"]["unresolved_targets"], out["n"]["self_loop_targets_dropped"]) == (["MSFT"], ["Acme", "Twin"], 1)
    assert out["m"]["resolved_target_tickers"] == [] and out["m"]["target_resolution_json"] == "[]"
    whole = resolve.resolved_lists(parsed, a).selectExpr("*", "'2016-01-01' published_date", "'2016-01-01' cutoff_date", "false is_warmup", "true in_evaluation_window", "'other' extracted_event_type", "'2016-01' shard_id", "0 batch_id", "'mock' run_mode")
    assert [r["target_ticker"] for r in resolve.edges(whole).collect()] == ["MSFT"]


def test_gate_and_sampling(spark):
    m = spark.createDataFrame([(0.80, 0.25, 1.0, "sufficient"), (0.99, 0.99, 9.0, "insufficient"), (None, 0.9, 2.0, "sufficient")], "source_mapping_ratio double, valid_target_ratio double, monthly_avg_out_degree double, coverage_conclusion string")
    assert [r["can_enter"] for r in sampling.gate(m).collect()] == [True, False, False]
    news = spark.createDataFrame([(f"n{i}", f"2016-01-{i % 28 + 1:02d}", "t", "f", i % 2 == 0) for i in range(50)], "news_id string, published_date string, title string, source_file string, is_mapped boolean")
    a = [r["news_id"] for r in sampling.bottom_k(news.repartition(5), 10, 7).collect()]
    assert a == [r["news_id"] for r in sampling.bottom_k(news.coalesce(1), 10, 7).collect()] and len(a) == 10
    assert sampling.bottom_k(news, 100, 7).count() == 50
    row = sampling.lineage(sampling.bottom_k(news, 10, 7), news).first()
    assert (row["sample_rows"], row["match_ratio"], row["date_match_ratio"], row["title_match_ratio"]) == (10, 1.0, 1.0, 1.0)
    assert sampling.lineage(news.limit(0), news).first()["match_ratio"] == 0.0
    assert [r["row_seed"] for r in sampling.head_with_seeds(news, 3, 7, 5).collect()] == [12, 13, 14]


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "id % 2 as k")
    path = f"file://{tmp_path}/t"
    tables.write(df, path)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        tables.write(df, path)
    tables.overwrite_partitions(df, f"{path}p", ["k"])
    tables.overwrite_partitions(df.where("k = 1").selectExpr("id + 10 as id", "k"), f"{path}p", ["k"])
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}p").collect()) == [0, 2, 4, 11, 13]
    assert tables.consolidated(spark, f"{path}none", df.schema, f"{path}c") == {"file_count": 0, "row_count": 0}
    assert tables.manifest(spark, path)["rows"] == 5 and not tables.manifest(spark, f"{path}x")["available"]
    tables.write_json(f"{tmp_path}/a/b.json", {"s": {2, 1}})
    assert json.load(open(f"{tmp_path}/a/b.json")) == {"s": [1, 2]} and tables.config(f"{tmp_path}/a/b.json") == {"s": [1, 2]}
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(TypeError):
        tables.config(str(tmp_path / "l.json"))
    assert tables.rooted("a/b", "/r") == "/r/a/b" and tables.rooted("/x") == "/x"


def test_stream_takes_files_once(spark, tmp_path):
    inp, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    os.makedirs(inp)
    df = spark.range(4).selectExpr("id")
    df.coalesce(1).write.mode("append").parquet(inp)
    assert ingest.take_up(spark, inp, df.schema, lambda b: b.where("id > 0"), out, state) == 1
    df.coalesce(1).write.mode("append").parquet(inp)
    assert ingest.take_up(spark, inp, df.schema, lambda b: b, out, state) == 1
    assert spark.read.parquet(out).count() == 7 and ingest.take_up(spark, inp, df.schema, lambda b: b, out, state) == 0
