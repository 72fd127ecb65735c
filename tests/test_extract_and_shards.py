import json

import pytest

from panelwright.functions import protocol
from panelwright.operators import aliases, evaluate, extract, graphs, shards


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"source": "", "targets": ["AAPL", "", "AAPL", "MSFT"], "event_type": ""}', (None, ["AAPL", "MSFT"], None)),
        ('{"source": " Apple Inc. ", "targets": ["", "Microsoft", null, "NVIDIA"], "event_type": "partnership"}', ("Apple Inc.", ["Microsoft", "NVIDIA"], "partnership")),
        ('```json\n{"source": "a", "targets": "b"}\n```', ("a", ["b"], None)),
        ('so: {"source": "br{ce \\" }", "targets": []} and {"x": 1}', ('br{ce " }', [], None)),
        ('{"source": 5, "targets": [true, 1.5], "source": "last"}', ("last", ["True", "1.5"], None)),
        ('{"source": NaN}', ("nan", [], None)),
    ],
)
def test_repair_and_decode(answer, want):
    assert tuple(extract.decode(extract.repaired(answer)).values()) == want


@pytest.mark.parametrize("answer", ["", None, "no", "[1]", "{'source': 1}", '{"source": "a", "x": 1}', '{"targets": {"a": 1}}', '{"targets": 5}', '{"source": "a"', "```\n{}```"])
def test_decode_refuses(answer):
    if answer == "```\n{}```":
        assert extract.decode(extract.repaired(answer))["targets"] == []  # two lines are no fence, but the object is found
    else:
        with pytest.raises(extract.DecodeError):
            extract.decode(extract.repaired(answer))


def test_schema_rules():
    assert extract.schema_errors(extract.answer_schema()) == []
    bad = extract.answer_schema()
    bad["properties"]["confidence"] = {"type": "number"}
    bad["properties"]["source"]["nullable"] = True
    assert len(extract.schema_errors(bad)) == 2
    with pytest.raises(extract.SchemaError):
        extract.checked_schema({"type": "array", "properties": {"event_type": {"type": "null"}}})


def test_http_client_falls_back():
    calls = []

    def send(url, body):
        calls.append((url, body))
        if body is None:
            return {"data": [{"id": "m"}, {}]}
        if "guided_json" not in body:
            raise extract.ClientError("no")
        return {"choices": [{"message": {"content": [{"text": '{"source": '}, {"text": '""}'}]}}]}

    c = extract.HttpClient("http://h:1/", "m", send=send)
    assert c.answer([], {"type": "object"}, 3) == '{"source": ""}' and [x[1].get("seed") for x in calls] == [3, 3] and calls[0][0] == "http://h:1/v1/chat/completions"
    assert c.preflight()["ready"] and not extract.HttpClient("http://h/v1", "other", send=send).preflight()["ready"]
    assert c.preflight({"type": "object"}) == {"server_reachable": True, "model_resolved": True, "hosted_models": ["m"], "structured_output": True, "error": None, "ready": True}
    mute = extract.HttpClient("http://h", "m", send=lambda u, b: {"data": [{"id": "m"}], "choices": [{"message": {"content": "no"}}]}).preflight({})
    assert not mute["ready"] and mute["structured_output"] is False
    assert c.asked([], {}, 3) == ('{"source": ""}', "guided_json")
    assert c.payload([], {"a": 1}, None, "structured_outputs")["response_format"]["json_schema"]["strict"]
    with pytest.raises(ValueError):
        c.payload([], {}, 1, "other")
    with pytest.raises(extract.ClientError):
        extract.HttpClient("http://h", "m", send=lambda u, b: {"choices": []}).answer([], {}, 1)


NEWS = [("n1", "2015-09-02", "AAPL"), ("n2", "2015-09-21", "MSFT"), ("n3", "2016-01-05", "NVDA"), ("n4", "2016-01-06", "AMZN"), ("n5", "2016-01-07", "")]
NAMES = {"AAPL": "Apple Inc.", "MSFT": "Microsoft Corp", "NVDA": "NVIDIA Corp", "AMZN": "Amazon.com, Inc."}


@pytest.fixture
def world(spark):
    columns = "news_id string, published_date string, title string, body string, summary_lsa string, summary_luhn string, summary_textrank string, summary_lexrank string, source_ticker string, source_company_name string, is_mapped boolean"
    news = spark.createDataFrame([(i, d, "T", None, None, None, "sum", None, t, NAMES.get(t), True) for i, d, t in NEWS], columns)
    universe = spark.createDataFrame([(t, t, n, "") for t, n in NAMES.items()], "ticker string, price_ticker string, company_name string, cik string")
    return news, aliases.alias_table(universe)


CONFIG = shards.RunConfig(start="2015-09-01", end="2016-01-31", seed=7, batch_size=2, mock_targets=("Apple", "Microsoft", "NVIDIA"), failing=["n4"])


def test_run_and_resume(spark, world, tmp_path):
    news, alias = world
    folder = f"file://{tmp_path}/run"
    first = shards.run(spark, news, alias, folder, CONFIG)
    assert (first["shards"], first["processed"], first["success"], first["failure"]) == (5, 4, 3, 1) and first["edges"] > 0
    assert shards.table(spark, folder, "edges").where("source_ticker = target_ticker").count() == 0
    assert shards.run(spark, news, alias, folder, CONFIG) == first
    assert {r["error_message"] for r in shards.table(spark, folder, "failures").collect()} == {"mock failure of n4"}
    state = {r["shard_id"]: r["state"] for r in spark.read.parquet(f"{folder}/checkpoint").collect()}
    assert set(state.values()) == {"completed"} and sorted(state) == ["2015-09", "2015-10", "2015-11", "2015-12", "2016-01"]
    half = f"file://{tmp_path}/half"
    limited = shards.RunConfig(**{**CONFIG.__dict__, "max_shards": 1})
    assert shards.run(spark, news, alias, half, limited)["processed"] == 2
    assert shards.run(spark, news, alias, half, CONFIG) == first


def test_modes_and_gate(spark, world, tmp_path):
    news, alias = world
    dry = shards.run(spark, news, alias, "unused", shards.RunConfig(**{**CONFIG.__dict__, "mode": "dry_run"}))
    assert dry == {"shards": 5, "rows": 4, "batches": 2}
    with pytest.raises(RuntimeError):
        shards.run(spark, news, alias, "unused", CONFIG, gate=lambda: False)
    with pytest.raises(ValueError):
        shards.run(spark, news, alias, "unused", shards.RunConfig(mode="other"))
    real = shards.run(spark, news, alias, f"file://{tmp_path}/real", shards.RunConfig(**{**CONFIG.__dict__, "mode": "real"}), client=extract.EmptyClient())
    assert (real["success"], real["edges"]) == (4, 0)
    allfail = shards.run(spark, news, alias, f"file://{tmp_path}/fail", shards.RunConfig(**{**CONFIG.__dict__, "failing": ["n1", "n2", "n3", "n4"]}))
    assert (allfail["failure"], allfail["edges"]) == (4, 0) and shards.table(spark, f"file://{tmp_path}/fail", "extractions").count() == 0


class Dying(extract.EmptyClient):
    """Answers all rows but those of one day, where the process ends as a killed one does: no row of its job is committed."""

    def asked(self, messages, schema, seed):
        if "2016-01-06" in messages[1]["content"]:
            raise KeyboardInterrupt
        return super().asked(messages, schema, seed)


class NotReady(extract.EmptyClient):
    def preflight(self, schema=None):
        return {"ready": False, "error": "no server"}


def test_a_run_that_dies_keeps_what_it_committed(spark, world, tmp_path):
    news, alias = world
    folder = f"file://{tmp_path}/dies"
    real = shards.RunConfig(**{**CONFIG.__dict__, "mode": "real", "batch_size": 1, "batches_per_commit": 1})
    with pytest.raises(RuntimeError, match="not ready"):
        shards.run(spark, news, alias, folder, real, client=NotReady())
    with pytest.raises(Exception, match="KeyboardInterrupt"):
        shards.run(spark, news, alias, folder, real, client=Dying())
    kept = {r["news_id"]: r["processed_at_utc"] for r in spark.read.parquet(f"{folder}/results").collect()}
    assert set(kept) == {"n1", "n2", "n3"}
    done = shards.run(spark, news, alias, folder, real, client=extract.EmptyClient())
    assert (done["processed"], done["success"], done["completed_shards"]) == (4, 4, 5)
    raw = shards.table(spark, folder, "raw")
    assert raw.columns == [c.split(" ")[0] for c in extract.RAW.split(", ")] and len(raw.columns) == 18
    assert {r["news_id"]: r["processed_at_utc"] for r in raw.collect() if r["news_id"] in kept} == kept
    assert [len(shards.table(spark, folder, t).columns) for t in shards.TABLES] == [18, 25, 13, 11]
    last = {r["shard_id"]: (r["last_batch"], r["resolved_edge_count"]) for r in spark.read.parquet(f"{folder}/checkpoint").collect()}
    assert last["2015-09"] == (1, 0) and last["2015-10"] == (None, 0)


def test_rows_of_one_id_keep_their_own_answers(spark, world, tmp_path):
    news, alias = world
    twice = news.where("news_id = 'n3'").unionByName(news.where("news_id = 'n5'").selectExpr("'n3' as news_id", "published_date", "title", "body", "summary_lsa", "summary_luhn", "summary_textrank", "summary_lexrank", "'AAPL' as source_ticker", "'Apple Inc.' as source_company_name", "is_mapped")).unionByName(news.where("news_id = 'n4'").selectExpr("cast(null as string) as news_id", "published_date", "title", "body", "summary_lsa", "summary_luhn", "summary_textrank", "summary_lexrank", "source_ticker", "source_company_name", "is_mapped"))
    folder = f"file://{tmp_path}/twice"
    got = shards.run(spark, twice, alias, folder, CONFIG)
    assert got["processed"] == got["success"] == 3
    rows = {(r["news_id"], r["source_ticker"]): r for r in shards.table(spark, folder, "extractions").collect()}
    assert set(rows) == {("n3", "NVDA"), ("n3", "AAPL"), (None, "AMZN")}
    for r in rows.values():
        told = json.loads(r["target_resolution_json"])
        assert [x["input_target"] for x in told] == r["extracted_targets"] and len(r["extracted_targets"]) == 2
        assert r["resolved_target_tickers"] == [x["resolved_ticker"] for x in told if x["resolved_ticker"] != r["source_ticker"]]
        assert r["self_loop_targets_dropped"] == 2 - len(r["resolved_target_tickers"])


def test_mock_equals_its_rule(spark, world):
    news, _ = world
    rows = extract.with_mock_answers(extract.with_prompt(shards.planned(news, CONFIG)), CONFIG.mock_targets, CONFIG.mock_events).collect()
    for r in rows:
        d = json.loads(r["raw_content"])
        assert d["targets"] == [CONFIG.mock_targets[(r["row_seed"] + i) % 3] for i in (0, 1)] and d["event_type"] == CONFIG.mock_events[r["row_seed"] % 3]
        assert "Summary: sum" in r["prompt"][1]["content"]


def test_graphs_and_evaluation(spark):
    days = spark.createDataFrame([(f"2016-01-{d:02d}",) for d in (4, 5, 6)], "date string")
    e = spark.createDataFrame([("2016-01-03", "a", "b"), ("2016-01-05", "a", "b"), ("2016-01-06", "a", "c"), ("2016-01-09", "a", "d")], "published_date string, source_ticker string, target_ticker string")
    got = {(r["target_ticker"], r["weight"], r["rank"]) for r in graphs.semantic(e, days, span=2, k=5).collect()}
    assert got == {("b", 1.0, 1), ("c", 1.0, 2)}
    r = spark.createDataFrame([(f"2016-01-{d:02d}", t, float(v)) for d in range(1, 9) for t, v in (("x", d), ("y", -d), ("z", 1.0))], "as_of_date string, ticker string, ret_1 double")
    assert {(x["source_ticker"], x["target_ticker"], x["weight"]) for x in graphs.price(r, span=8, k=3).collect()} == {("x", "y", 1.0), ("y", "x", 1.0)}
    at = graphs.as_of(spark.createDataFrame([("2016-01-01",), ("2016-01-31",), ("2016-02-15",)], "as_of_date string"), spark.createDataFrame([("2016-01-31",), ("2016-02-20",)], "graph_date string"))
    assert {tuple(x) for x in at.collect()} == {("2016-01-01", None), ("2016-01-31", "2016-01-31"), ("2016-02-15", "2016-01-31")}
    s = spark.createDataFrame([("d", str(i), float(i), float(i * i)) for i in range(6)] + [("e", str(i), 1.0, float(i)) for i in range(4)], "date string, ticker string, score double, label double")
    rows = {x["date"]: x for x in evaluate.information(s).collect()}
    assert rows["d"]["rank_ic"] == 1.0 and rows["e"]["rank_ic"] is None
    p = evaluate.portfolio(s, 2).where("date = 'd'").first()
    assert (p["top"], p["bottom"], p["long_short"]) == (20.5, 0.5, 20.0)
    perf = evaluate.performance(spark.createDataFrame([("1", 1.0), ("2", -3.0), ("3", 1.0)], "date string, long_short double")).first()
    assert perf["max_drawdown"] == 3.0 and perf["days"] == 3
    assert [r["shard_id"] for r in protocol.months(spark, "2015-12-31", "2016-01-01").collect()] == ["2015-12", "2016-01"]
