import json

import pandas as pd
import pytest

from panelwright.functions import protocol
from panelwright.operators import extract, normalize, shards
from panelwright.plans import jobs, reports

from .test_extract_and_shards import CONFIG, world  # noqa: F401
from .test_guards_and_panel import prices


def test_sample_index_job(spark, tmp_path):
    at = lambda x: f"file://{tmp_path}/{x}"
    prices(spark, 56).write.parquet(at("prices"))
    prices(spark, 56).write.parquet(at("index"))
    w = protocol.Window("2015-01-01", "2015-12-31", "2016-01-01", "2020-12-31")
    got = jobs.build_sample_index(spark, at("prices"), at("index"), at("f"), at("y"), at("none"), at("out"), w)
    assert got["splits"] == {"S1/train": got["rows"]} and got["rows"] > 0
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        jobs.build_sample_index(spark, at("prices"), at("index"), at("f"), at("y"), None, at("out"), w)
    assert jobs.build_sample_index(spark, at("prices"), at("index"), at("f"), at("y"), None, at("out"), w, splits="s9", overwrite=True)["rows"] == 0


def test_alias_map_feasibility_and_extract_jobs(spark, tmp_path, world):  # noqa: F811
    at = lambda x: f"file://{tmp_path}/{x}"
    news, _ = world
    (tmp_path / "u.csv").write_text("ticker,price_ticker,company_name,cik\nAAPL,AAPL,Apple Inc.,1\nMSFT,,Microsoft Corp,2\nNVDA,,NVIDIA Corp,3\nAMZN,,\"Amazon.com, Inc.\",4\n")
    made = jobs.build_aliases(spark, at("u.csv"), at("alias"))
    assert made["ticker_count"] == 4 and jobs.build_aliases(spark, at("u.csv"), at("alias"))["skipped"]
    news.withColumn("ticker_raw", news.source_ticker).drop("source_ticker", "source_company_name", "is_mapped").write.parquet(at("news"))
    assert jobs.map_news(spark, at("news"), at("u.csv"), at("alias"), at("mapped")) == {"rows_read": 5, "rows_written": 5, "rows_mapped": 4}
    report = jobs.feasibility(spark, at("mapped"), at("feas"), official=("2016-01-01", "2016-12-31"), client=extract.EmptyClient(), mode="formal")
    assert report["metrics"]["processed_rows"] == 2 and report["metrics"]["parse_ratio"] == 1.0 and not report["stage_gate"]["can_enter"] and report["stage_gate"]["complete"]
    assert jobs.feasibility(spark, at("mapped"), at("feas2"))["metrics"]["valid_target_ratio"] == 1.0
    totals = jobs.full_extract(spark, at("mapped"), at("alias"), at("run"), CONFIG)
    assert totals["success"] == 3 and json.load(open(tmp_path / "run/summary.json"))["totals"] == totals
    assert "| shard_id |" in (tmp_path / "run/summary.md").read_text()
    with pytest.raises(RuntimeError):
        jobs.full_extract(spark, at("mapped"), at("alias"), at("run2"), CONFIG, report=f"{tmp_path}/feas/feasibility.json")
    with pytest.raises(FileNotFoundError):
        jobs.full_extract(spark, at("mapped"), at("alias"), at("run2"), CONFIG, report=f"{tmp_path}/missing.json")
    assert jobs.small(shards.RunConfig()).rows_per_shard == 8 and jobs.preflight(None)["server"] is None


def test_gate_is_recomputed(tmp_path):
    good = {"source_mapping_ratio": 0.8, "valid_target_ratio": 0.25, "monthly_avg_out_degree": 1, "coverage_conclusion": " Sufficient"}
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"metrics": good, "execution": {"complete": True}}))
    jobs.main(["gate", str(path)])
    assert json.loads(path.read_text())["stage_gate"] == {"complete": True, "can_enter": True}
    assert not reports.can_enter(good | {"valid_target_ratio": "x"}) and not reports.can_enter(None) and not reports.can_enter(good | {"monthly_avg_out_degree": None})
    assert not reports.with_gate({"metrics": good})["stage_gate"]["can_enter"]


def test_two_raw_files_are_ingested(spark, tmp_path):
    columns = list(normalize.RAW_COLUMNS)
    line = lambda **x: {c: x.get(c, "") for c in columns}
    first = [line(Date="2015-09-01 10:00:00 UTC", Article_title="t", Url="http://u"), line(Date="2014-01-01", Article_title="old"), line(Date="2016-02-01", Article_title='two\nlines, "quoted"', Article="b")]
    second = [line(Date="2015-09-01 11:00:00 UTC", Article_title="t", Url="http://u", Article="body wins"), line(Date="2024-01-05", Article_title="late")]
    pd.DataFrame(first).to_csv(tmp_path / "a.csv", index=False)
    pd.DataFrame(second).drop(columns=["Publisher"]).to_csv(tmp_path / "b.csv")  # a column more, and one less
    sources = [(str(tmp_path / "a.csv"), "a.csv", 2), (str(tmp_path / "b.csv"), "b.csv", 1)]
    got = jobs.ingest(spark, sources, str(tmp_path / "news"))
    assert got == {"rows_in_period": 4, "rows_written": 3, "duplicates_removed": 1, "by_file": {"a.csv": {"in_period": 2, "written": 1}, "b.csv": {"in_period": 2, "written": 2}}}
    rows = {r["title"]: r for r in spark.read.parquet(str(tmp_path / "news")).collect()}
    assert set(rows) == {"t", 'two\nlines, "quoted"', "late"} and rows["t"]["body"] == "body wins" and rows["t"]["is_warmup"]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        jobs.ingest(spark, sources, str(tmp_path / "news"))
    assert jobs.ingest(spark, sources, str(tmp_path / "news"), rows_per_file=1, overwrite=True)["rows_written"] == 1
    assert jobs.ingest(spark, sources, str(tmp_path / "none"), rows_per_file=0)["rows_written"] == 0
    (tmp_path / "many").mkdir()
    for x in "ab":
        (tmp_path / "many" / f"{x}.csv").write_text((tmp_path / f"{x}.csv").read_text())
    with pytest.raises(ValueError, match="one file"):
        jobs.ingest(spark, [(str(tmp_path / "many"), "x", 1)], str(tmp_path / "other"))


def test_report_is_rewritten(spark, tmp_path):
    schema = "news_id string, published_date string, title string, source_file string"
    spark.createDataFrame([("1", "2016-01-01", "a", "f"), ("2", "2016-01-02", "b", "g")], schema).write.parquet(str(tmp_path / "up"))
    spark.createDataFrame([("1", "2016-01-01", "a", "f"), ("3", "2016-01-02", "b", "g")], schema).write.parquet(str(tmp_path / "sample"))
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"metrics": {}, "lineage": {"match_ratio": 1.0}, "stage_gate": {"complete": True, "can_enter": True}}))
    got = jobs.rewrite_report(spark, str(path), str(tmp_path / "sample"), str(tmp_path / "up"))
    assert got["lineage"]["match_ratio"] == 0.5 and not got["stage_gate"]["can_enter"] and json.loads(path.read_text())["lineage"] == got["lineage"]
    assert "match_ratio: 0.5" in (tmp_path / "r.md").read_text()
    jobs.rewrite_report(spark, str(path), str(tmp_path / "up"), str(tmp_path / "up"), str(tmp_path / "new.json"))
    assert json.loads((tmp_path / "new.json").read_text())["lineage"]["match_ratio"] == 1.0 and json.loads(path.read_text())["lineage"]["match_ratio"] == 0.5
