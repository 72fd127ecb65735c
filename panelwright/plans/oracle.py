"""DuckDB SQL with the meaning of the catalog's queries, written from the definitions and not from the plans."""

from __future__ import annotations

from panelwright.operators.aliases import SUFFIXES

from .testdata import SPLITS

_SUFFIXES = "[" + ", ".join(f"'{s}'" for s in SUFFIXES) + "]"
_NORM = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_SPLITS = "splits(split, partition, split_start, split_end) AS (VALUES " + ", ".join(str(s) for s in SPLITS) + ")"
_W = "{0} BETWEEN '1995-01-01' AND '1995-12-31'"
_E = "{0} BETWEEN '1996-01-01' AND '2001-12-31'"


def _norm(c: str) -> str:
    return _NORM.format(c)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


TICKS = """ticks AS (SELECT upper(p_brand) AS ticker, strftime(l_shipdate, '%Y-%m-%d') AS date, l_extendedprice / l_quantity AS price, l_quantity,
  row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS o FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_OHLC = "arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close, sum(l_quantity) AS volume"
PX = f"px AS (SELECT date, ticker, {_OHLC} FROM ticks GROUP BY date, ticker)"
IX = f"ix AS (SELECT date, 'ALL' AS ticker, {_OHLC} FROM ticks GROUP BY date)"
MKT = "mkt AS (SELECT date, ln(close / lag(close) OVER (ORDER BY date)) AS r FROM ix)"
RET = """ret AS (SELECT *, ln(close / lag(close, 1) OVER w) AS ret_1, ln(close / lag(close, 5) OVER w) AS ret_5, ln(close / lag(close, 20) OVER w) AS ret_20
  FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
FEAT = """feat AS (SELECT ret.date AS as_of_date, ret.ticker, ret_1, ret_5, ret_20,
  CASE WHEN count(ret_1) OVER w5 = 5 THEN stddev_samp(ret_1) OVER w5 END AS vol_5, CASE WHEN count(ret_1) OVER w20 = 20 THEN stddev_samp(ret_1) OVER w20 END AS vol_20,
  CASE WHEN count(volume) OVER w20 = 20 AND stddev_samp(volume) OVER w20 > 0 THEN (volume - avg(volume) OVER w20) / stddev_samp(volume) OVER w20 END AS volume_zscore,
  (high - low) / close AS hl_spread, ln(close / open) AS oc_return, mkt.r AS feat_mkt_ret_1d
  FROM ret LEFT JOIN mkt ON ret.date = mkt.date
  WINDOW w5 AS (PARTITION BY ret.ticker ORDER BY ret.date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY ret.ticker ORDER BY ret.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
full_feat AS (SELECT *, ret_1 IS NOT NULL AND ret_5 IS NOT NULL AND ret_20 IS NOT NULL AND vol_5 IS NOT NULL AND vol_20 IS NOT NULL AND volume_zscore IS NOT NULL
  AND hl_spread IS NOT NULL AND oc_return IS NOT NULL AND feat_mkt_ret_1d IS NOT NULL AS feature_complete FROM feat)"""
LAB = """lab AS (SELECT * FROM (SELECT date AS as_of_date, ticker, ln(lead(close) OVER w / close) AS label_ret_1d, lead(date) OVER w AS label_start_date
  FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE label_start_date IS NOT NULL)"""
BN = """bn AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS as_of_date, 'BRAND#' || (o_orderkey % 25 + 1) AS ticker, count(*) AS n
  FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL)"""
SAMPLES = f"""{_SPLITS},
samples AS (SELECT split, partition, f.as_of_date, f.ticker, f.as_of_date AS cutoff_date, 'label_ret_1d' AS label_name, label_ret_1d AS label, label_start_date, label_start_date AS label_end_date,
  coalesce(n, 0) AS mapped_news_count_1d, coalesce(n, 0) > 0 AS has_mapped_news
  FROM full_feat f JOIN lab USING (as_of_date, ticker) LEFT JOIN bn USING (as_of_date, ticker) JOIN splits ON as_of_date BETWEEN split_start AND split_end
  WHERE feature_complete AND label_start_date <= '2001-12-31')"""
UNI = """uni AS (
  SELECT 'P' || p_partkey AS ticker, p_brand || '.' || p_partkey AS price_ticker, p_name || CASE p_size % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' & Co' ELSE ' Group, Ltd.' END AS company_name, '' AS cik FROM part
  UNION ALL SELECT 'S' || s_suppkey, '', s_name || ' Corp', CAST(s_nationkey AS VARCHAR) FROM supplier)"""
NEWS = """news AS (SELECT 'n' || o_orderkey AS news_id, strftime(o_orderdate, '%Y-%m-%d') AS published_date,
  CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 11 = 1 THEN ' p' || ((o_orderkey * 7) % np) || ' ' WHEN o_orderkey % 11 = 2 THEN 'OLD1' WHEN o_orderkey % 11 = 3 THEN 'nothing' ELSE 'P' || ((o_orderkey * 7) % np) END AS ticker_raw,
  o_orderpriority || ' order by Supplier#' || lpad(CAST(o_orderkey % 130 AS VARCHAR), 9, '0') || ' & others' AS title,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'Status ' || o_orderstatus END AS body, o_orderstatus AS source_file FROM orders, (SELECT count(*) AS np FROM part))"""
MAPPED = """tiers AS (SELECT n.*, coalesce(t.ticker, p.ticker, CASE WHEN upper(trim(ticker_raw)) = 'OLD1' THEN 'P1' END) AS st,
  CASE WHEN t.ticker IS NOT NULL THEN 'ticker_raw' WHEN p.ticker IS NOT NULL THEN 'price_ticker' WHEN upper(trim(ticker_raw)) = 'OLD1' THEN 'legacy_ticker' END AS mm
  FROM news n LEFT JOIN (SELECT upper(trim(ticker)) AS k, max(ticker) AS ticker FROM uni GROUP BY 1) t ON t.k = upper(trim(ticker_raw)) AND t.k <> ''
  LEFT JOIN (SELECT upper(trim(price_ticker)) AS k, max(ticker) AS ticker FROM uni GROUP BY 1) p ON p.k = upper(trim(ticker_raw)) AND p.k <> ''),
mapped AS (SELECT news_id, published_date, ticker_raw, title, body, source_file, coalesce(st, '') AS source_ticker, coalesce(mm, 'none') AS mapping_method, CASE WHEN st IS NULL THEN 'none' ELSE 'high' END AS mapping_confidence,
  coalesce(company_name, '') AS source_company_name, st IS NOT NULL AS is_mapped FROM tiers LEFT JOIN uni ON st = uni.ticker)"""
ALIASES = f"""words AS (SELECT *, trim(company_name) AS nm, regexp_extract_all(trim(company_name), '[A-Za-z0-9&]+') AS ws FROM uni),
kept AS (SELECT *, coalesce(list_max([CASE WHEN list_contains({_SUFFIXES}, lower(ws[i])) THEN 0 ELSE i END FOR i IN range(1, len(ws) + 1)]), 0) AS k FROM words),
variants AS (SELECT *, array_to_string(ws[1:k], ' ') AS bare, trim(regexp_replace(regexp_replace(nm, '[^A-Za-z0-9& ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS plain, replace(nm, '&', 'and') AS spelled FROM kept),
made AS (
  SELECT ticker, price_ticker, company_name, cik, 0 AS pos, nm AS alias, 'company_name' AS alias_type, true AS is_primary FROM variants
  UNION ALL SELECT ticker, price_ticker, company_name, cik, 1, bare, 'company_name_no_suffix', false FROM variants WHERE bare <> nm
  UNION ALL SELECT ticker, price_ticker, company_name, cik, 2, plain, 'company_name_no_punctuation', false FROM variants WHERE plain <> nm
  UNION ALL SELECT ticker, price_ticker, company_name, cik, 3, spelled, 'company_name_ampersand', false FROM variants WHERE spelled <> nm
  UNION ALL SELECT ticker, price_ticker, company_name, cik, 4, upper(trim(ticker)), 'ticker', false FROM variants),
aliases AS (SELECT ticker, price_ticker, company_name, cik, alias, alias_normalized, alias_type, is_primary FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, alias_normalized ORDER BY pos, company_name) AS rn FROM (SELECT *, {_norm('alias')} AS alias_normalized FROM made) WHERE alias_normalized <> '') WHERE rn = 1)"""
PLAN = """planned AS (SELECT *, rn // 16 AS batch_id, 7 + rn AS row_seed FROM (
  SELECT *, substr(published_date, 1, 7) AS shard_id, row_number() OVER (PARTITION BY substr(published_date, 1, 7) ORDER BY published_date, news_id) - 1 AS rn
  FROM mapped WHERE is_mapped AND source_ticker <> '' AND published_date BETWEEN '1995-01-01' AND '2001-12-31'))"""
#: Both mock targets of each row, and what the aliases say of them: a known ticker goes before a name that one company has.
MOCK = f"""mock AS (SELECT *, ['Supplier#000000001', 's2', 'Supplier#000000003', 'nobody'][row_seed % 4 + 1] AS t1, ['Supplier#000000001', 's2', 'Supplier#000000003', 'nobody'][(row_seed + 1) % 4 + 1] AS t2,
  ['partnership', 'other', 'product_launch'][row_seed % 3 + 1] AS event_type, news_id IN ('n17', 'n33', 'n400') AS failed, {_W.format("published_date")} AS is_warmup, {_E.format("published_date")} AS in_evaluation_window FROM planned),
one_of AS (SELECT alias_normalized AS a, min(ticker) AS ticker FROM aliases WHERE alias_type <> 'ticker' AND length(alias_normalized) >= 4 GROUP BY 1 HAVING count(DISTINCT ticker) = 1),
names AS (SELECT n.t, coalesce(max(u.ticker), max(o.ticker), '') AS r FROM (SELECT t1 AS t FROM mock UNION SELECT t2 FROM mock) n LEFT JOIN uni u ON upper(u.ticker) = upper(n.t) LEFT JOIN one_of o ON o.a = {_norm("n.t")} GROUP BY n.t),
found AS (SELECT m.*, a.r AS r1, b.r AS r2, list_distinct([x FOR x IN [a.r, b.r] IF x <> '']) AS rs, coalesce(nullif(source_company_name, ''), source_ticker) AS src FROM mock m JOIN names a ON a.t = t1 JOIN names b ON b.t = t2)"""
_M = _with(UNI, NEWS, MAPPED)
_F = _with(TICKS, PX, IX, MKT, RET, FEAT)
_CHECK = """results AS (SELECT *, len([x FOR x IN rs IF x <> source_ticker]) AS k FROM found WHERE shard_id <> '1996-03' AND NOT (shard_id = '1996-01' AND batch_id > 1)),
months AS (SELECT strftime(m, '%Y-%m') AS shard_id FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS m)),
state AS (SELECT m.shard_id, coalesce(p.n, 0) AS rows, coalesce(p.b, 0) AS batches, coalesce(r.n, 0) AS processed, coalesce(r.s, 0) AS success, coalesce(r.f, 0) AS failure, coalesce(r.b, 0) AS batches_done, coalesce(r.e, 0) AS resolved_edge_count, r.l AS last_batch
  FROM months m LEFT JOIN (SELECT shard_id, count(*) AS n, count(DISTINCT batch_id) AS b FROM planned GROUP BY 1) p USING (shard_id)
  LEFT JOIN (SELECT shard_id, count(*) AS n, count(*) FILTER (NOT failed) AS s, count(*) FILTER (failed) AS f, count(DISTINCT batch_id) AS b, CAST(sum(CASE WHEN failed THEN 0 ELSE k END) AS BIGINT) AS e, max(batch_id) AS l FROM results GROUP BY 1) r USING (shard_id)),
checked AS (SELECT *, CASE WHEN rows = processed THEN 'completed' WHEN processed > 0 THEN 'partial' ELSE 'pending' END AS state FROM state)"""
EV = """ev AS (SELECT strftime(ts, '%Y-%m-%d') AS published_date, 'U' || (user_id % 20) AS s, 'U' || ((user_id * 7 + event_id) % 40) AS t FROM events),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT published_date AS date FROM ev) WHERE substr(date, 9, 2) NOT IN ('06', '07', '13', '14')),
snap AS (SELECT max(date) AS graph_date, max(day) AS graph_day FROM cal GROUP BY substr(date, 1, 7)),
placed AS (SELECT ev.s, ev.t, (SELECT min(day) FROM cal WHERE cal.date >= ev.published_date) AS day FROM ev)"""


def _graph(weight: str, k: int) -> str:
    return f"""weights AS (SELECT graph_date, s AS source_ticker, t AS target_ticker, round({weight}, 6) AS weight FROM placed JOIN snap ON day <= graph_day AND day > graph_day - 10 GROUP BY ALL),
graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_date, source_ticker ORDER BY weight DESC, target_ticker) AS rank FROM weights) WHERE rank <= {k})"""


def _feasible(*targets: str) -> str:
    values = "[" + ", ".join(f"'{t}'" for t in targets) + "]"
    return f"""cand AS (SELECT * FROM mapped WHERE is_mapped AND published_date BETWEEN '1996-01-01' AND '1996-12-31'),
smp AS (SELECT *, 7 + row_number() OVER (ORDER BY published_date, news_id) - 1 AS row_seed FROM (SELECT * FROM cand ORDER BY sha256('7:' || news_id), news_id LIMIT 100)),
res AS (SELECT substr(published_date, 1, 7) AS m, trim(coalesce(nullif(source_company_name, ''), source_ticker, '')) AS source,
  list_distinct([x FOR x IN [trim({values}[row_seed % {len(targets)} + 1]), trim({values}[(row_seed + 1) % {len(targets)} + 1])] IF x <> '']) AS ts FROM smp),
deg AS (SELECT m, source, count(DISTINCT x) AS d FROM (SELECT m, source, unnest(ts) AS x FROM res WHERE source <> '') GROUP BY ALL),
feas AS (SELECT count(*) AS processed_rows, round(avg(CASE WHEN source <> '' THEN 1 ELSE 0 END), 6) AS source_mapping_ratio, round(avg(CASE WHEN len(ts) > 0 THEN 1 ELSE 0 END), 6) AS valid_target_ratio, round(avg(len(ts)), 6) AS avg_valid_target_count,
  round((SELECT coalesce(avg(d), 0) FROM deg), 6) AS monthly_avg_out_degree, round((SELECT count(*) FROM cand) / 12, 6) AS news_density, count(DISTINCT CASE WHEN source <> '' AND len(ts) > 0 THEN source END) AS active_source_nodes,
  CASE WHEN bool_or(len(ts) > 0) THEN 'sufficient' ELSE 'insufficient' END AS coverage_conclusion FROM res)"""


def _gate(*targets: str) -> str:
    return _with(UNI, NEWS, MAPPED, _feasible(*targets)) + "SELECT source_mapping_ratio, valid_target_ratio, source_mapping_ratio >= 0.8 AND valid_target_ratio >= 0.25 AND monthly_avg_out_degree >= 1.0 AND coverage_conclusion = 'sufficient' AS can_enter FROM feas"


#: Mock targets of the feasibility queries: with the second ones too few rows have targets.
MOCKED = (("Supplier#000000001", "s2", "Supplier#000000003", "nobody"), ("", " ", "", " ", "s2", "", " ", "", " ", ""))
SCORES = "scores AS (SELECT as_of_date AS date, ticker, ret_5 AS s, label_ret_1d AS y FROM full_feat JOIN lab USING (as_of_date, ticker) WHERE feature_complete)"
IC = """ranked AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY s) + (count(*) OVER (PARTITION BY date, s) - 1) / 2 AS rs, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2 AS ry FROM scores),
ics AS (SELECT date, count(*) AS n, round(CASE WHEN stddev_samp(s) * stddev_samp(y) > 0 THEN covar_samp(s, y) / (stddev_samp(s) * stddev_samp(y)) END, 6) AS ic,
  round(CASE WHEN stddev_samp(rs) * stddev_samp(ry) > 0 THEN covar_samp(rs, ry) / (stddev_samp(rs) * stddev_samp(ry)) END, 6) AS rank_ic FROM ranked GROUP BY date HAVING count(*) >= 3)"""
PORTFOLIO = """placed AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC, ticker) AS hi, row_number() OVER (PARTITION BY date ORDER BY s, ticker) AS lo FROM scores),
ports AS (SELECT date, count(*) AS n, round(avg(y) FILTER (hi <= 5), 9) AS top, round(avg(y) FILTER (lo <= 5), 9) AS bottom, round(avg(y) FILTER (hi <= 5) - avg(y) FILTER (lo <= 5), 9) AS long_short FROM placed GROUP BY date HAVING count(*) >= 10)"""

SQL = {
    "alias_table": _with(UNI, ALIASES) + "SELECT * FROM aliases",
    "alias_metadata": _with(UNI, ALIASES) + "SELECT count(*) AS row_count, count(DISTINCT ticker) AS ticker_count FROM aliases",
    "text_normalize": f"SELECT doc_id, {_norm('text')} AS normalized, sha256(text) AS digest FROM documents",
    "suffix_strip": _with(UNI, ALIASES) + "SELECT ticker, bare, plain FROM variants",
    "source_map_tiers": _M + "SELECT news_id, source_ticker, mapping_method, mapping_confidence, source_company_name, is_mapped FROM mapped",
    "source_map_alias_contains": f"""WITH b AS (SELECT item_id, a, row_number() OVER (ORDER BY length(a) DESC, 'B' || item_id, text) AS rank FROM (SELECT item_id, text, {_norm('text')} AS a FROM benchmark) WHERE length(a) >= 4),
d AS (SELECT doc_id, {_norm("text || ' '")} AS t FROM documents),
m AS (SELECT doc_id, arg_min(item_id, rank) AS item FROM d JOIN b ON contains(t, a) WHERE doc_id % 10 <> 0 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'P1' WHEN item IS NOT NULL THEN 'B' || item END AS source_ticker, CASE WHEN d.doc_id % 10 = 0 THEN 'ticker_raw' WHEN item IS NOT NULL THEN 'alias_text' END AS mapping_method FROM d LEFT JOIN m ON d.doc_id = m.doc_id""",
    "map_news": _with(UNI, NEWS, MAPPED, ALIASES, f"""probes AS (SELECT *, row_number() OVER (ORDER BY length(alias_normalized) DESC, CAST(is_primary AS VARCHAR) DESC, ticker, alias_type, alias) AS rank FROM aliases WHERE length(alias_normalized) >= 4),
open AS (SELECT news_id, {_norm("title || ' ' || coalesce(body, '')")} AS t FROM mapped WHERE NOT is_mapped),
hit AS (SELECT news_id, arg_min(ticker, rank) AS ticker FROM open JOIN probes ON contains(t, alias_normalized) GROUP BY news_id),
final AS (SELECT m.news_id, coalesce(nullif(m.source_ticker, ''), hit.ticker) AS st, CASE WHEN hit.ticker IS NOT NULL THEN 'alias_text' ELSE mapping_method END AS mm FROM mapped m LEFT JOIN hit USING (news_id))""")
    + "SELECT news_id, coalesce(st, '') AS source_ticker, mm AS mapping_method, coalesce(price_ticker, '') AS source_price_ticker, coalesce(company_name, '') AS source_company_name, CASE WHEN st IS NULL THEN 'none' WHEN mm = 'alias_text' THEN 'medium' ELSE 'high' END AS mapping_confidence, st IS NOT NULL AS is_mapped FROM final LEFT JOIN uni ON st = uni.ticker",
    "mapping_stats": _M + "SELECT count(*) AS rows_written, count(*) FILTER (is_mapped) AS rows_mapped FROM mapped",
    "resolve_targets": _with(UNI, ALIASES, f"""tg AS (SELECT c_custkey, trim(coalesce(CASE c_custkey % 8 WHEN 0 THEN ' s' || (c_custkey % 140) WHEN 1 THEN 'Supplier#' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0') WHEN 2 THEN 'SUPPLIER ' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0') || ' corp'
  WHEN 3 THEN 'red widget' WHEN 4 THEN 'nobody ' || c_custkey WHEN 5 THEN ' ' WHEN 6 THEN '--' END, '')) AS x FROM customer),
al AS (SELECT alias_normalized AS a, count(DISTINCT ticker) AS n, min(ticker) AS ticker FROM aliases WHERE alias_type <> 'ticker' AND length(alias_normalized) >= 4 GROUP BY 1),
rs AS (SELECT c_custkey, x, {_norm('x')} AS nx, u.ticker AS t, al.n, al.ticker AS alt FROM tg LEFT JOIN uni u ON upper(x) = upper(u.ticker) AND x <> '' LEFT JOIN al ON al.a = {_norm('x')}),
st AS (SELECT *, x = '' OR (nx = '' AND t IS NULL) AS e FROM rs),
fin AS (SELECT c_custkey, x AS input_target, CASE WHEN e THEN '' ELSE nx END AS normalized_target, CASE WHEN e THEN 'empty' WHEN t IS NOT NULL OR n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status,
  CASE WHEN e THEN '' WHEN t IS NOT NULL THEN 'exact_ticker' WHEN n = 1 THEN 'exact_alias' WHEN n > 1 THEN 'ambiguous_alias' ELSE 'no_match' END AS match_type, CASE WHEN e THEN NULL WHEN t IS NOT NULL THEN t WHEN n = 1 THEN alt END AS rt FROM st)""")
    + "SELECT c_custkey, input_target, normalized_target, status, status = 'resolved' AS is_resolved, coalesce(rt, '') AS resolved_ticker, coalesce(company_name, '') AS resolved_company_name, match_type FROM fin LEFT JOIN uni ON rt = uni.ticker",
    "dedupe_documents": """WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'u:http://x/' || (doc_id % 50) ELSE 'k:|2016-01-0' || (doc_id % 3 + 1) || '|' || source || '|' || substr(substr(text, 1, 80), 1, 50) END AS k,
  CASE WHEN doc_id % 4 = 0 OR trim(text) = '' THEN 1 ELSE 0 END AS nobody, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS p, lang FROM documents)
SELECT sha256(k) AS news_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY nobody, p DESC, lang, doc_id) AS rn FROM n) WHERE rn = 1""",
    "dedupe_pages_url_key": "SELECT page_id, key FROM (SELECT page_id, key, row_number() OVER (PARTITION BY key ORDER BY n DESC, page_id) AS rn FROM (SELECT page_id, regexp_extract(url, '^[^?]*') AS key, length(html) AS n FROM pages)) WHERE rn = 1",
    "protocol_flags": f"SELECT o_orderkey, {_W.format('d')} AS is_warmup, {_E.format('d')} AS in_evaluation_window, d BETWEEN '1995-01-01' AND '2001-12-31' AS in_protocol FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)",
    "month_calendar": "SELECT * FROM (VALUES ('1995-11', '1995-11-01', '1995-11-30'), ('1995-12', '1995-12-01', '1995-12-31'), ('1996-01', '1996-01-01', '1996-01-31'), ('1996-02', '1996-02-01', '1996-02-29'), ('1996-03', '1996-03-01', '1996-03-20')) AS t(shard_id, start, \"end\")",
    "daily_prices": _with(TICKS, PX, IX) + f"SELECT date, ticker, kind AS instrument_type, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume, {_W.format('date')} AS is_warmup, {_E.format('date')} AS in_evaluation_window FROM (SELECT *, 'equity' AS kind FROM px UNION ALL SELECT *, 'index' FROM ix)",
    "universe_daily": _with(TICKS, PX) + f"SELECT d.date, t.ticker, px.close IS NOT NULL AS has_price_data, {_W.format('d.date')} AS is_warmup, {_E.format('d.date')} AS in_evaluation_window FROM (SELECT DISTINCT date FROM px) d CROSS JOIN (SELECT DISTINCT ticker FROM px) t LEFT JOIN px ON px.date = d.date AND px.ticker = t.ticker",
    "market_return": _with(TICKS, IX, MKT) + "SELECT date, round(r, 6) AS feat_mkt_ret_1d FROM mkt",
    "feature_panel": _F + "SELECT as_of_date, ticker, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("ret_1", "ret_5", "ret_20", "vol_5", "vol_20", "volume_zscore", "hl_spread", "oc_return", "feat_mkt_ret_1d")) + ", feature_complete FROM full_feat",
    "forward_returns": _with(TICKS, PX, LAB) + "SELECT as_of_date, ticker, round(label_ret_1d, 6) AS label_ret_1d, label_start_date, label_start_date AS label_end_date FROM lab",
    "news_counts_daily": _with(BN) + "SELECT as_of_date, ticker, n AS mapped_news_count_1d, true AS has_mapped_news FROM bn",
    "sample_index": _with(TICKS, PX, IX, MKT, RET, FEAT, LAB, BN, SAMPLES) + "SELECT * REPLACE (round(label, 6) AS label) FROM samples",
    "split_counts": _with(TICKS, PX, IX, MKT, RET, FEAT, LAB, BN, SAMPLES) + "SELECT split, partition, count(*) AS n, count(DISTINCT ticker) AS tickers, min(as_of_date) AS first_date, max(as_of_date) AS last_date FROM samples GROUP BY ALL",
    "leakage_violations": """WITH r AS (SELECT CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 - 1 AS INTEGER) AS s, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS e FROM orders)
SELECT count(*) FILTER (a > DATE '2000-12-31') AS r0, count(*) FILTER (e IS NULL OR e > DATE '2000-12-31') AS r1, count(*) FILTER (NOT a < s) AS r2, count(*) FILTER (e IS NULL OR NOT s <= e) AS r3 FROM r""",
    "sample_bottom_k": _M + "SELECT news_id, published_date FROM mapped WHERE is_mapped AND published_date BETWEEN '1996-01-01' AND '1996-12-31' ORDER BY sha256('7:' || news_id), news_id LIMIT 100",
    "monthly_histogram": _M + "SELECT substr(published_date, 1, 7) AS month, count(*) AS n FROM mapped WHERE is_mapped AND published_date BETWEEN '1995-01-01' AND '1996-12-31' GROUP BY 1",
    "warmup_official_counts": _M + "SELECT count(*) FILTER (is_mapped AND published_date BETWEEN '1995-01-01' AND '1995-12-31') AS warmup_candidates, count(*) FILTER (is_mapped AND published_date BETWEEN '1996-01-01' AND '1996-12-31') AS official_candidates FROM mapped",
    "feasibility_metrics": " UNION ALL ".join(f"SELECT * FROM ({_with(UNI, NEWS, MAPPED, _feasible(*x))}SELECT * FROM feas)" for x in MOCKED),
    "stage_gate": " UNION ALL ".join(f"SELECT * FROM ({_gate(*x)})" for x in MOCKED),
    "lineage_check": _with(NEWS, """s AS (SELECT * FROM news ORDER BY sha256('7:' || news_id), news_id LIMIT 200),
t AS (SELECT CASE WHEN news_id LIKE '%17' THEN NULL ELSE source_file END AS f, CASE WHEN news_id LIKE '%17' THEN 0 ELSE 1 END AS hit, CASE WHEN news_id LIKE '%17' OR news_id LIKE '%3' THEN 0 ELSE 1 END AS same FROM s)""") + "SELECT count(*) AS sample_rows, round(avg(hit), 6) AS match_ratio, round(avg(hit), 6) AS date_match_ratio, round(avg(same), 6) AS title_match_ratio, count(DISTINCT f) AS source_files FROM t",
    "coverage_ratios": _M + "SELECT source_file, count(*) AS n, count(*) FILTER (is_mapped) AS mapped, round(avg(CAST(is_mapped AS INT)), 6) AS mapped_ratio, round(avg(CASE WHEN trim(ticker_raw) <> '' THEN 1 ELSE 0 END), 6) AS ticker_ratio, round(avg(CASE WHEN trim(coalesce(body, '')) <> '' THEN 1 ELSE 0 END), 6) AS body_ratio FROM mapped GROUP BY 1",
    "yearly_counts": _M + "SELECT substr(published_date, 1, 4) AS year, source_file, count(*) AS n, count(*) FILTER (is_mapped) AS mapped FROM mapped GROUP BY ALL",
    "news_share": _with(TICKS, PX, IX, MKT, RET, FEAT, LAB, BN, SAMPLES) + "SELECT split, count(*) AS n, round(avg(CAST(has_mapped_news AS INT)), 6) AS news_ratio, CAST(sum(mapped_news_count_1d) AS BIGINT) AS news, max(mapped_news_count_1d) AS most FROM samples GROUP BY 1",
    "news_count_distribution": _with(TICKS, PX, IX, MKT, RET, FEAT, LAB, BN, SAMPLES) + "SELECT mapped_news_count_1d, count(*) AS n FROM samples GROUP BY 1",
    "prompt_text": _with(NEWS) + "SELECT news_id, substr('Title: ' || title || CASE WHEN body IS NOT NULL THEN chr(10) || 'Body: ' || body WHEN news_id LIKE '%5' THEN chr(10) || 'Summary: summary_textrank' ELSE '' END, 1, 4000) AS article FROM news",
    "json_decode": """WITH b AS (SELECT event_id, '{"source": " ' || event_type || '", "targets": ["A' || event_id || '", "", "B", "A' || event_id || '"], "event_type": ""}' AS body FROM events),
a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || body || ' as asked.' WHEN 3 THEN 'no object' WHEN 4 THEN '{"source": "x", "extra": 1}' ELSE '[1]' END AS answer FROM b),
o AS (SELECT event_id, regexp_extract(answer, '[{].*[}]', 0, 's') AS j FROM a),
k AS (SELECT event_id, CASE WHEN j <> '' THEN CASE WHEN len([x FOR x IN json_keys(j) IF x NOT IN ('source', 'targets', 'event_type')]) = 0 THEN j END END AS j FROM o),
v AS (SELECT *, [trim(x) FOR x IN CAST(json_extract(j, '$.targets') AS VARCHAR[]) IF trim(x) <> ''] AS ts FROM k)
SELECT event_id, nullif(trim(json_extract_string(j, '$.source')), '') AS source, array_to_string(list_filter(ts, lambda x, i: list_position(ts, x) = i), '|') AS targets, nullif(trim(json_extract_string(j, '$.event_type')), '') AS event_type, CASE WHEN j IS NULL THEN 'StructuredDecodeError' END AS error_type FROM v""",
    "shard_batches": _with(UNI, NEWS, MAPPED, PLAN) + "SELECT news_id, shard_id, rn AS row_number, batch_id, row_seed FROM planned",
    "shard_plan": _with(UNI, NEWS, MAPPED, PLAN, "months AS (SELECT strftime(m, '%Y-%m') AS shard_id FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS m))") + "SELECT shard_id, count(news_id) AS rows, count(DISTINCT batch_id) AS batches FROM months LEFT JOIN planned USING (shard_id) GROUP BY 1",
    "mock_extract": _with(UNI, NEWS, MAPPED, PLAN, ALIASES, MOCK, "kept_targets AS (SELECT *, [x FOR x IN CASE WHEN r1 = '' THEN [r2] WHEN r2 = '' OR r1 = r2 THEN [r1] ELSE [r1, r2] END IF x <> '' AND x <> source_ticker] AS k FROM found)") + """SELECT news_id, CASE WHEN failed THEN 'failed' ELSE 'success' END AS status, CASE WHEN NOT failed THEN src END AS extracted_source, CASE WHEN failed THEN '' ELSE t1 || '|' || t2 END AS extracted_targets, CASE WHEN NOT failed THEN event_type END AS event_type,
  CASE WHEN failed THEN '' ELSE array_to_string(k, '|') END AS resolved_target_tickers, CASE WHEN failed THEN '' ELSE array_to_string([x FOR x IN [CASE WHEN r1 = '' THEN t1 END, CASE WHEN r2 = '' THEN t2 END] IF x IS NOT NULL], '|') END AS unresolved_targets, row_seed AS seed, CASE WHEN failed THEN '' ELSE 'mock' END AS request_mode,
  CASE WHEN failed THEN '' ELSE sha256('{"source":"' || src || '","targets":["' || t1 || '","' || t2 || '"],"event_type":"' || event_type || '"}') END AS raw_content_sha256, false AS response_repaired, CAST(CASE WHEN failed THEN 0 ELSE len(k) END AS BIGINT) AS resolved_target_count,
  NOT failed AND len(k) > 0 AS has_resolved_targets, CAST(CASE WHEN failed THEN 0 ELSE len(rs) - len(k) END AS BIGINT) AS self_loop_targets_dropped FROM kept_targets""",
    "mock_failures": _with(UNI, NEWS, MAPPED, PLAN, ALIASES, MOCK) + "SELECT news_id, shard_id, batch_id, published_date, published_date AS cutoff_date, source_ticker, source_company_name, '' AS request_mode, '' AS raw_content_sha256, 'ClientError' AS error_type, 'mock failure of ' || news_id AS error_message, row_seed AS seed, 'mock' AS run_mode FROM found WHERE failed",
    "edges": _with(UNI, NEWS, MAPPED, PLAN, ALIASES, MOCK) + "SELECT news_id, published_date, published_date AS cutoff_date, is_warmup, in_evaluation_window, source_ticker, target_ticker, event_type, shard_id, batch_id, 'mock' AS run_mode FROM (SELECT *, unnest(rs) AS target_ticker FROM found WHERE NOT failed) WHERE target_ticker <> source_ticker",
    "self_loop_drop": _with(UNI, NEWS, MAPPED, PLAN) + """SELECT news_id, array_to_string([x FOR x IN CASE WHEN rn % 2 = 0 AND source_ticker <> 'P5' THEN ['S1', 'P5'] WHEN rn % 2 = 0 THEN ['S1'] ELSE ['P5'] END IF x <> source_ticker], '|') AS resolved_target_tickers,
  CASE WHEN rn % 2 = 0 OR source_ticker = 'P5' THEN 1 ELSE 0 END AS self_loops_dropped FROM planned""",
    "checkpoint_shards": _with(UNI, NEWS, MAPPED, PLAN, ALIASES, MOCK, _CHECK) + "SELECT * FROM checked",
    "checkpoint_totals": _with(UNI, NEWS, MAPPED, PLAN, ALIASES, MOCK, _CHECK) + "SELECT count(*) AS shards, count(*) FILTER (state = 'completed') AS completed_shards, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(success) AS BIGINT) AS success, CAST(sum(failure) AS BIGINT) AS failure, CAST(sum(resolved_edge_count) AS BIGINT) AS edges FROM checked",
    "resume_anti_join": _with(UNI, NEWS, MAPPED, PLAN) + "SELECT news_id, shard_id, batch_id FROM planned WHERE batch_id % 2 <> 0",
    "semantic_graph_topk": _with(EV, _graph("CAST(count(*) AS DOUBLE)", 5)) + "SELECT graph_date, source_ticker, target_ticker, weight, rank FROM graph",
    "semantic_graph_decayed": _with(EV, _graph("sum(exp(-0.1 * (graph_day - day)))", 3)) + "SELECT graph_date, source_ticker, target_ticker, weight, rank FROM graph",
    "static_graph": _with(_SPLITS) + "SELECT DISTINCT split, CAST(o_custkey % 30 AS VARCHAR) AS source_ticker, o_orderpriority AS target_ticker FROM orders JOIN splits ON strftime(o_orderdate, '%Y-%m-%d') BETWEEN split_start AND split_end WHERE partition = 'train'",
    "graph_stats": _with(EV, _graph("CAST(count(*) AS DOUBLE)", 5), "g AS (SELECT graph_date, count(*) AS edges, count(DISTINCT source_ticker) AS sources FROM graph GROUP BY 1), v AS (SELECT graph_date, count(DISTINCT x) AS nodes FROM (SELECT graph_date, source_ticker AS x FROM graph UNION ALL SELECT graph_date, target_ticker FROM graph) GROUP BY 1)")
    + "SELECT graph_date, nodes, edges, sources, round(edges / sources, 6) AS avg_out_degree, round(edges / (nodes * (nodes - 1)), 6) AS density FROM g JOIN v USING (graph_date)",
    "price_graph_topk": _with(TICKS, PX, IX, MKT, RET, """r AS (SELECT date, ticker, ret_1 FROM ret),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM r)),
snap AS (SELECT max(date) AS graph_date, max(day) AS graph_day FROM cal GROUP BY substr(date, 1, 7)),
w AS (SELECT graph_date, day, ticker, ret_1 FROM r JOIN cal USING (date) JOIN snap ON day <= graph_day AND day > graph_day - 60 WHERE ret_1 IS NOT NULL),
c AS (SELECT a.graph_date, a.ticker AS source_ticker, b.ticker AS target_ticker, round(abs(CASE WHEN stddev_samp(a.ret_1) * stddev_samp(b.ret_1) > 0 THEN covar_samp(a.ret_1, b.ret_1) / (stddev_samp(a.ret_1) * stddev_samp(b.ret_1)) END), 6) AS weight
  FROM w a JOIN w b ON a.graph_date = b.graph_date AND a.day = b.day AND a.ticker <> b.ticker GROUP BY ALL HAVING count(*) >= 30)""") + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_date, source_ticker ORDER BY weight DESC, target_ticker) AS rank FROM c WHERE weight IS NOT NULL) WHERE rank <= 10",
    "snapshot_asof": _with(TICKS, PX, "g AS (SELECT max(date) AS graph_date FROM px GROUP BY substr(date, 1, 7))") + "SELECT d.date AS as_of_date, max(graph_date) AS graph_date FROM (SELECT DISTINCT date FROM px) d LEFT JOIN g ON graph_date <= d.date GROUP BY 1",
    "rank_ic": _with(TICKS, PX, IX, MKT, RET, FEAT, LAB, SCORES, IC) + "SELECT * FROM ics",
    "rank_ic_summary": _with(TICKS, PX, IX, MKT, RET, FEAT, LAB, SCORES, IC) + "SELECT substr(date, 1, 4) AS year, count(*) AS days, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir, round(avg(rank_ic), 6) AS rank_ic_mean, round(stddev_samp(rank_ic), 6) AS rank_ic_std, round(avg(rank_ic) / stddev_samp(rank_ic), 6) AS rank_ic_ir FROM ics GROUP BY 1",
    "topk_portfolio": _with(TICKS, PX, IX, MKT, RET, FEAT, LAB, SCORES, PORTFOLIO) + "SELECT * FROM ports",
    "portfolio_performance": _with(TICKS, PX, IX, MKT, RET, FEAT, LAB, SCORES, PORTFOLIO, "p AS (SELECT *, sum(long_short) OVER (ORDER BY date) AS level FROM ports), q AS (SELECT *, greatest(max(level) OVER (ORDER BY date), 0) AS peak FROM p)")
    + "SELECT count(*) AS days, round(avg(long_short) * 252, 6) AS annual_return, round(stddev_samp(long_short) * sqrt(252.0), 6) AS annual_volatility, round(avg(long_short) / stddev_samp(long_short) * sqrt(252.0), 6) AS sharpe, round(max(peak - level), 6) AS max_drawdown FROM q",
    "news_standardized": f"""WITH r AS (SELECT *, CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
SELECT o_orderkey AS source_row_number, d AS published_date, 'T ' || o_orderpriority AS title, o_orderkey % 5 <> 0 OR o_orderkey % 7 = 0 AS has_content, {_W.format("d")} AS is_warmup, {_E.format("d")} AS in_evaluation_window, 'a.csv' AS source_file, 2 AS source_priority, 'v1' AS version FROM r WHERE d >= '1995-01-01'""",
    "universe_listed": "SELECT p_partkey AS member FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 7 = 0 OR DATE '1990-01-01' + CAST(p_partkey * 17 % 4000 AS INTEGER) <= DATE '1998-06-30'",
    "guard_bounds": "SELECT count(*) FILTER (NOT d < '1998-01-01') AS r0, count(*) FILTER (d < '1993-06-01') AS r1, count(*) FILTER (d IS NULL OR NOT d >= '1994-01-01') AS r2 FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)",
    "cutoff_filter": "SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-06-30' AS before_the_day FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-06-30'",
    "guard_features": _with(TICKS, PX) + "SELECT count(*) FILTER (date > '1999-12-31') AS r0, 0 AS r1 FROM px",
    "guard_samples": _with(TICKS, PX, IX, MKT, RET, FEAT, LAB, BN, SAMPLES) + "SELECT count(*) FILTER (as_of_date < '1997-01-01') AS r0, count(*) FILTER (as_of_date > '2000-06-30') AS r1, count(*) FILTER (as_of_date <> cutoff_date) AS r2, count(*) FILTER (NOT as_of_date < label_start_date) AS r3, count(*) FILTER (NOT label_start_date <= label_end_date) AS r4 FROM samples",
    "feature_window_ends": _with(TICKS, PX) + "SELECT date AS as_of_date, ticker, date AS feature_window_end_date FROM px",
    "sample_seeds": _M + "SELECT news_id, 7 + 1000 + row_number() OVER (ORDER BY published_date, news_id) - 1 AS row_seed FROM (SELECT * FROM mapped WHERE is_mapped AND published_date BETWEEN '1996-01-01' AND '1996-12-31' ORDER BY published_date, news_id LIMIT 50)",
    "prompt_messages": _with(UNI, NEWS, MAPPED) + "SELECT news_id, 'system|user' AS roles, 'Date: ' || published_date || chr(10) || 'Possible source, to be checked against the article: ' || coalesce(nullif(source_company_name, ''), nullif(source_ticker, ''), 'unknown') AS begins, 'Title: ' || title || coalesce(chr(10) || 'Body: ' || body, '') AS ends FROM mapped",
    "empty_answers": _with(UNI, NEWS, MAPPED, PLAN) + "SELECT news_id, 'success' AS status, CAST(NULL AS VARCHAR) AS extracted_source, false AS has_valid_targets, 'mock' AS request_mode, sha256('{\"source\": \"\", \"targets\": [], \"event_type\": \"\"}') AS raw_content_sha256 FROM planned",
    "ordered_names": "SELECT o_custkey, array_to_string([x FOR x IN ['b' || o_custkey % 3, 'a' || o_custkey % 2] IF x <> 'a0'], '|') AS names FROM (SELECT DISTINCT o_custkey FROM orders)",
    "alias_scan_limit": _with(UNI, NEWS, MAPPED, ALIASES, f"""probes AS (SELECT *, row_number() OVER (ORDER BY length(alias_normalized) DESC, CAST(is_primary AS VARCHAR) DESC, ticker, alias_type, alias) AS rank FROM aliases WHERE length(alias_normalized) >= 4),
open AS (SELECT news_id, {_norm("title || ' ' || coalesce(body, '')")} AS t FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY news_id) AS place FROM mapped WHERE NOT is_mapped) WHERE place <= 40),
hit AS (SELECT news_id, arg_min(ticker, rank) AS ticker FROM open JOIN probes ON contains(t, alias_normalized) GROUP BY news_id),
final AS (SELECT m.news_id, coalesce(nullif(m.source_ticker, ''), hit.ticker) AS st, CASE WHEN hit.ticker IS NOT NULL THEN 'alias_text' ELSE mapping_method END AS mm FROM mapped m LEFT JOIN hit USING (news_id))""")
    + "SELECT news_id, coalesce(st, '') AS source_ticker, mm AS mapping_method FROM final",
    "rank_ic_decay": _with(TICKS, PX, IX, MKT, RET, FEAT, LAB, SCORES, """ahead AS (SELECT date, ticker, h AS horizon, ln(later.close / px.close) AS y FROM
  (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM px) px CROSS JOIN (VALUES (1), (2), (5), (10), (20)) hs(h)
  JOIN (SELECT ticker AS lt, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS li FROM px) later ON lt = px.ticker AND li = px.i + h),
all_h AS (SELECT date, horizon, s, ahead.y FROM (SELECT date, ticker, s FROM scores) JOIN ahead USING (date, ticker)),
ranked AS (SELECT *, rank() OVER (PARTITION BY horizon, date ORDER BY s) + (count(*) OVER (PARTITION BY horizon, date, s) - 1) / 2 AS rs, rank() OVER (PARTITION BY horizon, date ORDER BY y) + (count(*) OVER (PARTITION BY horizon, date, y) - 1) / 2 AS ry FROM all_h),
ics AS (SELECT horizon, date, round(CASE WHEN stddev_samp(s) * stddev_samp(y) > 0 THEN covar_samp(s, y) / (stddev_samp(s) * stddev_samp(y)) END, 6) AS ic,
  round(CASE WHEN stddev_samp(rs) * stddev_samp(ry) > 0 THEN covar_samp(rs, ry) / (stddev_samp(rs) * stddev_samp(ry)) END, 6) AS rank_ic FROM ranked GROUP BY horizon, date HAVING count(*) >= 3)""")
    + "SELECT horizon, count(*) AS days, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir, round(avg(rank_ic), 6) AS rank_ic_mean, round(stddev_samp(rank_ic), 6) AS rank_ic_std, round(avg(rank_ic) / stddev_samp(rank_ic), 6) AS rank_ic_ir FROM ics GROUP BY 1",
    "gap_fill": _with(NEWS) + "SELECT substr(published_date, 1, 4) AS year, count(*) FILTER (source_file = 'F') AS base_rows, count(*) FILTER (source_file = 'O') AS filler_rows, count(*) FILTER (source_file = 'O' AND published_date > (SELECT max(published_date) FROM news WHERE source_file = 'F')) AS filled FROM news WHERE source_file IN ('F', 'O') GROUP BY 1",
    "news_gaps": "SELECT count(*) AS rows, count(*) AS without_url, count(*) AS without_ticker_raw, count(*) FILTER (o_orderkey % 5 = 0) AS without_body, count(*) FILTER (o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0) AS without_content FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderdate >= DATE '1995-01-01'",
}
