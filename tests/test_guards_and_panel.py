import math
import random

import pandas as pd
import pytest

from panelwright.functions import protocol
from panelwright.operators import graphs, guards, panel
from panelwright.operators.guards import LeakageError


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_protocol_splits():
    w = protocol.Window()
    splits = protocol.walk_forward(w)
    assert splits[0] == ("S1", "train", "2016-01-01", "2018-12-31") and splits[-1] == ("S4", "test", "2023-01-01", "2023-12-31") and len(splits) == 12
    assert protocol.window_from({"warmup": {"start": "2015-09-01", "end": "2015-12-31"}, "evaluation": {"start": "2016-01-01", "end": "2023-12-31"}}) == w
    with pytest.raises(TypeError):
        protocol.window_from([])
    with pytest.raises(ValueError):
        protocol.Window("2016-01-01", "2015-01-01")
    with pytest.raises(ValueError):
        protocol.compare(None, None, "<>")
    assert protocol.names(" aapl, ,msft") == {"AAPL", "MSFT"} and protocol.names(" ") is None and protocol.cutoff_of(None, w) == "2023-12-31"


def test_flags_at_the_bounds(spark):
    w = protocol.Window()
    rows = frame(spark, "d string", ("2015-08-31",), ("2015-09-01",), ("2015-12-31",), ("2016-01-01",), ("2023-12-31",), ("2024-01-01",), (None,), ("junk",))
    got = [tuple(r) for r in rows.select(protocol.is_warmup("d", w), protocol.in_evaluation("d", w), protocol.in_protocol("d", w)).collect()]
    assert got == [(False, False, False), (True, False, True), (True, False, True), (False, True, True), (False, True, True), *[(False, False, False)] * 3]
    times = frame(spark, "t string", ("2015-09-01 10:00:00 UTC",), ("x",), (None,)).select(protocol.iso_date(protocol.timestamp_utc("t")))
    assert [r[0] for r in times.collect()] == ["2015-09-01", None, None]


LABELS = "as_of_date string, label_start_date string, label_end_date string"


def test_each_leak_raises(spark):
    f = frame(spark, "as_of_date string, feature_window_end_date string", ("2016-01-04", "2016-01-05"))
    y = frame(spark, LABELS, ("2016-01-04",) * 3)
    s = frame(spark, f"{LABELS}, cutoff_date string", ("2015-12-31", "2016-01-04", "2016-01-04", "2015-12-31"))
    for table, rules in ((f, guards.feature_rules("2016-01-04")), (y, guards.label_rules("2016-01-04")), (s, guards.sample_rules("2016-01-04", "2016-01-01"))):
        with pytest.raises(LeakageError):
            guards.check(table, rules)
        with pytest.raises(Exception, match="table: "):
            guards.guarded(table, rules, "table", "as_of_date").collect()
        assert guards.check(table.limit(0), rules).count() == 0
    with pytest.raises(LeakageError):
        guards.check(frame(spark, LABELS, ("2016-01-04", None, "junk")), guards.label_rules("2020-01-01"))
    with pytest.raises(LeakageError):
        guards.up_to(y.withColumn("as_of_date", y.as_of_date.substr(1, 3)), "as_of_date", "2020-01-01")
    assert guards.up_to(y, "as_of_date", "2016-01-04").count() == 1 and guards.up_to(y, "as_of_date", "2016-01-04", allow_equal=False).count() == 0


def prices(spark, n=30, ticker="A", volume=lambda i: 100 + i % 7):
    rows = [(f"2016-{1 + i // 28:02d}-{1 + i % 28:02d}", ticker, 10.0 + i, 12.0 + i, 9.0 + i, 10.5 + i, 10.5 + i, volume(i)) for i in range(n)]
    return frame(spark, "date string, ticker string, open double, high double, low double, close double, adj_close double, volume long", *rows)


def test_feature_windows_must_be_full(spark):
    daily = prices(spark).unionByName(prices(spark, 3, "B")).unionByName(prices(spark, 25, "C", lambda i: 5))
    rows = {(r["ticker"], r["as_of_date"]): r for r in panel.features(daily, prices(spark)).collect()}
    a = sorted(k for k in rows if k[0] == "A")
    assert rows[a[0]]["ret_1"] is None and math.isclose(rows[a[1]]["ret_1"], math.log(11.5 / 10.5))
    assert rows[a[4]]["vol_5"] is None and rows[a[5]]["vol_5"] is not None
    assert rows[a[19]]["vol_20"] is None and rows[a[20]]["vol_20"] is not None and rows[a[20]]["feature_complete"] and not rows[a[19]]["feature_complete"]
    assert all(rows[k]["volume_zscore"] is None for k in rows if k[0] in "BC")
    labels = panel.forward_returns(daily).collect()
    assert all(r["label_start_date"] > r["as_of_date"] and r["label_end_date"] == r["label_start_date"] for r in labels)
    assert sum(r["ticker"] == "B" for r in labels) == 2


def test_news_counts_and_samples(spark):
    news = frame(spark, "published_date string, source_ticker string, is_mapped boolean", ("2016-01-04", "AAPL", True), ("2016-01-04", " aapl", True), ("2019-03-01", "ABBV", True), ("2019-03-01", "", False), ("2019-03-01", " ", True), ("2019-03-01", "X", None))
    assert {tuple(r) for r in panel.news_counts(news).collect()} == {("2016-01-04", "AAPL", 2, True), ("2019-03-01", "ABBV", 1, True)}
    daily = prices(spark, 56)
    w = protocol.Window()
    splits = protocol.splits_frame(spark, [("S1", "train", "2016-01-01", "2016-02-10"), ("S2", "train", "2016-02-05", "2016-12-31")])
    out = panel.sample_index(panel.features(daily, daily), panel.forward_returns(daily), None, splits, w, cutoff="2016-02-20")
    rows = out.collect()
    assert max(r["label_end_date"] for r in rows) == "2016-02-20"
    assert {r["split"] for r in rows if r["as_of_date"] == "2016-02-07"} == {"S1", "S2"}
    assert panel.sample_index(panel.features(daily, daily), panel.forward_returns(daily), None, splits, w, tickers={"Z"}).count() == 0


def test_price_graph_does_not_depend_on_blocks(spark):
    r = random.Random(3)
    days = [f"2020-0{m}-{d:02d}" for m in (1, 2) for d in range(1, 29)]
    rows = [(d, f"T{i:02d}", None if r.random() < 0.2 else 0.01 if i == 3 else r.choice([0.0, 0.01, -0.02])) for d in days for i in range(23)]
    rows = [(d, t, 0.5 * x if t == "T01" and x is not None else x) for d, t, x in rows] + [("2020-02-28", "NEW", 0.1)]
    returns = spark.createDataFrame(rows, "as_of_date string, ticker string, ret_1 double")
    got = [sorted(map(tuple, graphs.price(returns, span=40, k=4, block=n).collect())) for n in (1024, 5)]
    assert got[0] == got[1]
    by = {(t, d): x for d, t, x in rows if x is not None}
    last = {"2020-01-28": days[:28], "2020-02-28": days[16:56]}
    want = []
    for at, window in last.items():
        for a in sorted({t for t, _ in by}):
            found = []
            for b in sorted({t for t, _ in by} - {a}):
                both = [(by[a, d], by[b, d]) for d in window if (a, d) in by and (b, d) in by]
                x, y = (pd.Series([p[i] for p in both], dtype=float) for i in (0, 1))
                if len(both) >= 20 and x.nunique() > 1 and y.nunique() > 1:
                    found.append((-round(abs(x.corr(y)), 6), b))
            want += [(at, a, b, -w, n + 1) for n, (w, b) in enumerate(sorted(found)[:4])]
    want.sort()
    assert [(*x[:3], x[4]) for x in got[0]] == [(*x[:3], x[4]) for x in want] and len(want) > 80
    assert [x[3] for x in got[0]] == pytest.approx([x[3] for x in want], abs=2e-6)
    assert graphs.price(returns.limit(0)).count() == 0
