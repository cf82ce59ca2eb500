"""The registered queries of the surveillance operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evwatch.config import DAY, SMALL
from evwatch.functions import scalars, timecal
from evwatch.operators import alertlog, contract, detectors, features, joins, labels, merge, metrics, ranks, sampling, text, universe
from evwatch.plans import frames
from evwatch.plans.views_sql import HIGH, LOW, with_views
from evwatch.sources import adapters, ingest, sinks
from evwatch.tables import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Sources and merges


@query("SELECT * FROM bars")
def hourly_bars(spark, sf_dir):
    return adapters.hourly_bars(spark, sf_dir)


@query("""SELECT l_suppkey::VARCHAR AS ticker, (floor(epoch(l_shipdate) / 86400) * 86400)::BIGINT AS ts_utc,
  arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_quantity)) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_quantity)) AS close, sum(l_quantity) AS volume
FROM lineitem GROUP BY 1, 2""")
def daily_bars(spark, sf_dir):
    return adapters.daily_bars(spark, sf_dir)


@query("SELECT accession_no, ticker, form, items, acceptance_utc FROM filings WHERE form IN ('8-K')")
def ingest_filings(spark, sf_dir):
    raw = adapters.filings(spark, sf_dir).withColumn("acceptance", F.date_format(F.timestamp_seconds("acceptance_utc"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("filing_date", F.lit("")).drop("acceptance_utc")
    good, _ = ingest.filing_rows(raw.withColumn("items", F.regexp_replace("items", ",", " , ")), ("8-K",))
    return good.select("accession_no", "ticker", "form", "items", "acceptance_utc")


@query("""SELECT user_id::VARCHAR AS ticker, (floor(epoch(ts) / 86400) * 86400)::BIGINT AS ts_utc, value AS open, value AS high, value AS low, value AS close, 0.0::DOUBLE AS volume, '1d' AS interval
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY event_id DESC) = 1""")
def ingest_bars(spark, sf_dir):
    raw = adapters.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("ticker"), (F.floor(adapters.epoch("ts") / DAY) * DAY).alias("ts_utc"), F.col("event_id").alias("pos"), *(F.col("value").alias(c) for c in ("open", "high", "low", "close")), F.lit(float("nan")).alias("volume"))
    return ingest.bar_rows(raw, "1d")


@query("SELECT url, ticker, title, source_domain, published_utc, NULL::BIGINT AS seen_utc, 'feed' AS api FROM news")
def ingest_published_news(spark, sf_dir):
    raw = adapters.news(spark, sf_dir).select("url", "ticker", F.col("title").alias("headline"), F.col("publisher").alias("source"), F.col("published_utc").cast("string").alias("datetime"))
    return ingest.published_news(raw, "feed").drop("source_name")


@query("SELECT url, ticker, title, source_domain, published_utc AS seen_utc, 'crawl' AS api FROM news")
def ingest_crawled_news(spark, sf_dir):
    stamp = timecal.epoch_to_compact(F.col("published_utc"))
    raw = adapters.news(spark, sf_dir).select("url", "ticker", "title", F.lit("").alias("domain"), F.concat(F.substring(stamp, 1, 8), F.lit("T"), F.substring(stamp, 9, 6), F.lit("Z")).alias("seendate"))
    return ingest.crawled_news(raw, "crawl").drop("published_utc", "source_name")


@query("""SELECT lpad(s_nationkey::VARCHAR, 10, '0') AS cik, arg_min(s_name, (contains(s_name, '-'), s_suppkey)) AS ticker, arg_min(s_name, s_suppkey) AS name, 'NYSE' AS exchange
FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY s_nationkey""")
def company_map(spark, sf_dir):
    s = adapters.read(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_suppkey").alias("pos"), F.col("s_nationkey").cast("string").alias("cik"), F.col("s_name").alias("name"), F.col("s_name").alias("ticker"), F.when(F.col("s_suppkey") % 3 == 0, "OTC").otherwise("NYSE").alias("exchange"))
    return ingest.company_rows(rows, ("NYSE", "Nasdaq"), 0).select("cik", "ticker", "name", "exchange")


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE coalesce(o.total, c_acctbal) END AS value FROM customer
LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey
UNION ALL SELECT o_custkey + 1000000000, round(max(o_totalprice), 2) FROM orders WHERE o_custkey % 50 = 0 GROUP BY 1""")
def merge_new_else_old(spark, sf_dir):
    target = adapters.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    source = adapters.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.round(F.max("o_totalprice"), 2).alias("value"))
    fresh = source.where("key % 50 = 0").select((F.col("key") + 1000000000).alias("key"), "value")
    source = source.join(target.select("key"), "key", "left_semi").withColumn("value", F.when(F.col("key") % 3 != 0, F.col("value")))
    return merge.merge(target, source.unionByName(fresh), ["key"])


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 7.0 END AS kept, 7.0::DOUBLE AS owned FROM customer")
def merge_by_column(spark, sf_dir):
    target = adapters.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("kept"), F.lit(1.0).alias("owned"))
    source = target.select("key", F.lit(7.0).alias("kept"), F.lit(7.0).alias("owned"))
    return merge.merge(target, source, ["key"], {"kept": merge.OLD, "owned": merge.OVERWRITE})


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'stored' ELSE 'new' END AS src FROM orders")
def insert_or_ignore(spark, sf_dir):
    orders = adapters.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return merge.insert_new(orders.where("key % 4 = 0").withColumn("src", F.lit("stored")), orders.withColumn("src", F.lit("new")), ["key"])


@query("SELECT o_custkey AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def last_row_wins(spark, sf_dir):
    rows = adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("last_order"), "o_orderdate")
    return merge.last_of(rows, ["key"], ["o_orderdate", "last_order"]).select("key", "last_order")


@query("SELECT cik, min(accession_no) AS accession_no FROM filings GROUP BY cik")
def first_row_wins(spark, sf_dir):
    return merge.first_of(adapters.filings(spark, sf_dir).select("cik", "accession_no"), ["cik"], ["accession_no"])


@query("""SELECT accession_no AS event_id, CASE WHEN k = 0 THEN NULL ELSE 1 END AS usable, CASE WHEN k = 0 THEN NULL ELSE 'kept' END AS note
FROM (SELECT accession_no, acceptance_utc % 3 AS k FROM filings)""")
def carry_forward(spark, sf_dir):
    rebuilt = adapters.filings(spark, sf_dir).select(F.col("accession_no").alias("event_id"), F.col("acceptance_utc"))
    stored = rebuilt.where("acceptance_utc % 3 <> 0").select("event_id", F.lit(1).alias("usable"), F.lit("kept").alias("note"))
    return merge.carry_forward(rebuilt.select("event_id"), stored, ["event_id"], {"usable": F.lit(None).cast("int"), "note": F.lit(None).cast("string")})


@query("SELECT url, source_tier AS tier_before, CASE WHEN source_domain IN ('pub0.com', 'pub1.com') THEN 1 WHEN source_domain = 'pub2.com' THEN 2 END AS tier_after FROM news WHERE source_tier IS DISTINCT FROM CASE WHEN source_domain IN ('pub0.com', 'pub1.com') THEN 1 WHEN source_domain = 'pub2.com' THEN 2 END")
def retiered_news(spark, sf_dir):
    rows = adapters.news(spark, sf_dir).withColumn("source_name", F.lit(None).cast("string"))
    out = merge.changed(rows, ingest.retier(rows, ("pub0", "pub1"), ("pub2",)), ["url"], "source_tier")
    return out.select("url", F.col("source_tier").alias("tier_before"), F.col("source_tier_after").alias("tier_after"))


@query(f"SELECT DISTINCT ticker, (floor((e - {LOW}) / 259200))::BIGINT AS no FROM (SELECT ticker, unnest([acceptance_utc, acceptance_utc - 86400]) AS e FROM filings) WHERE e >= {LOW} AND e < {HIGH}")
def needed_windows(spark, sf_dir):
    return ingest.needed_windows(adapters.filings(spark, sf_dir), LOW, HIGH, 3, DAY)


@query("SELECT ticker, no, low, high FROM companies CROSS JOIN (SELECT i AS no, %d + i * 604800 AS low, least(%d + (i + 1) * 604800, %d) AS high FROM range(4) t(i)) WHERE exchange <> 'OTC'" % (LOW, LOW, HIGH))
def full_coverage(spark, sf_dir):
    grid = ingest.window_grid(spark, LOW, HIGH, 7)  # as many rows as the study has weeks
    return adapters.companies(spark, sf_dir).where("exchange <> 'OTC'").select("ticker").join(F.broadcast(grid))


@query("SELECT ticker, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts, count(*) AS n FROM bars GROUP BY 1")
def bar_coverage(spark, sf_dir):
    return adapters.hourly_bars(spark, sf_dir).groupBy("ticker").agg(F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"), F.count("*").alias("n"))


@query(f"SELECT ticker, CASE WHEN {LOW} BETWEEN min(ts_utc) AND max(ts_utc) THEN max(ts_utc) + 1 ELSE {LOW} END AS start_utc FROM bars GROUP BY 1 HAVING CASE WHEN {LOW} BETWEEN min(ts_utc) AND max(ts_utc) THEN max(ts_utc) + 1 ELSE {LOW} END < {HIGH}")
def incremental_ranges(spark, sf_dir):
    bars = adapters.hourly_bars(spark, sf_dir)
    wanted = bars.select("ticker").distinct().withColumn("start_utc", F.lit(LOW).cast("long")).withColumn("end_utc", F.lit(HIGH).cast("long"))
    return ingest.high_water(bars, wanted).select("ticker", "start_utc")


@query("SELECT 'bars' AS dataset, count(*) AS rows FROM bars UNION ALL SELECT 'filings', count(*) FROM filings UNION ALL SELECT 'news', count(*) FROM news")
def inventory(spark, sf_dir):
    return sinks.inventory({"bars": adapters.hourly_bars(spark, sf_dir), "filings": adapters.filings(spark, sf_dir), "news": adapters.news(spark, sf_dir)})


@query("SELECT accession_no, strftime(to_timestamp(acceptance_utc) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%SZ') AS acceptance_utc FROM filings WHERE form = '8-K/A' ORDER BY accession_no, acceptance_utc LIMIT 20 OFFSET 10")
def browse_page(spark, sf_dir):
    return sinks.browse(adapters.filings(spark, sf_dir), "form = '8-K/A'", ["accession_no", "acceptance_utc"], 20, 10)


@query("""SELECT ticker, ts_utc, close FROM bars JOIN (SELECT DISTINCT ticker FROM companies WHERE exchange = 'NYSE') USING (ticker)
WHERE ts_utc >= (SELECT max(ts_utc) FROM bars) - 5 * 86400""")
def snapshot_bars(spark, sf_dir):
    keep = adapters.companies(spark, sf_dir).where("exchange = 'NYSE'")
    parts = sinks.snapshot(adapters.hourly_bars(spark, sf_dir), adapters.filings(spark, sf_dir), keep, 5, 2)
    return parts["bars"].select("ticker", "ts_utc", "close")


# Calendar and scalars

@query("""SELECT f.accession_no, bool_or(acceptance_utc >= open_utc AND acceptance_utc < close_utc) AS open, min(CASE WHEN open_utc > acceptance_utc THEN open_utc END) AS next_open,
  min(CASE WHEN close_utc > acceptance_utc THEN close_utc END) AS next_close,
  (CASE WHEN bool_or(acceptance_utc >= open_utc AND acceptance_utc < close_utc) THEN min(CASE WHEN close_utc > acceptance_utc THEN close_utc END) - min(acceptance_utc)
    ELSE min(CASE WHEN close_utc > acceptance_utc THEN close_utc END) - min(CASE WHEN open_utc > acceptance_utc THEN open_utc END) END / 3600.0)::DOUBLE AS hours_to_close
FROM filings f CROSS JOIN sessions GROUP BY 1""")
def market_clock(spark, sf_dir):
    days = frames.clock(spark)
    rows = timecal.read_clock(adapters.filings(spark, sf_dir), days, "acceptance_utc", "m")
    out = timecal.hours_to_close(rows, days, "acceptance_utc", "hours_to_close")
    return out.select("accession_no", F.col("m_open").alias("open"), F.col("m_next_open").alias("next_open"), F.col("m_next_close").alias("next_close"), "hours_to_close")


@query("""SELECT accession_no, sum(greatest(0, least(acceptance_utc + 200000 + 7 * (acceptance_utc % 1000), close_utc) - greatest(acceptance_utc, open_utc)))::BIGINT / 3600.0::DOUBLE AS hours
FROM filings CROSS JOIN sessions GROUP BY 1""")
def trading_hours(spark, sf_dir):
    rows = adapters.filings(spark, sf_dir).withColumn("until", F.col("acceptance_utc") + 200000 + 7 * (F.col("acceptance_utc") % 1000))
    return timecal.trading_hours(rows, frames.clock(spark), "acceptance_utc", "until", "hours").select("accession_no", "hours")


@query(f"""SELECT accession_no, CASE WHEN items = '9.01' THEN 'only_excluded_items' END AS item_reason, CASE WHEN items <> '9.01' THEN contains(items, '2.02') END AS is_scheduled,
  CASE WHEN acceptance_utc < {LOW} OR acceptance_utc >= {HIGH} THEN 'outside_study_window' WHEN c.ticker IS NULL THEN 'not_in_universe' WHEN items = '9.01' THEN 'only_excluded_items' END AS reason
FROM filings f LEFT JOIN (SELECT ticker FROM companies WHERE exchange <> 'OTC') c ON c.ticker = f.ticker""")
def classify_events(spark, sf_dir):
    members = adapters.companies(spark, sf_dir).where("exchange <> 'OTC'").select("ticker", F.lit(True).alias("member"))
    rows = adapters.filings(spark, sf_dir).join(members, "ticker", "left")
    item = scalars.item_reason(F.col("items"), SMALL.excluded_items)
    scope = scalars.scope_reason(F.col("acceptance_utc"), LOW, HIGH - 1, F.coalesce("member", F.lit(False)))
    return rows.select("accession_no", item.alias("item_reason"), scalars.is_scheduled(F.col("items"), SMALL.excluded_items, SMALL.scheduled_items).alias("is_scheduled"), F.coalesce(scope, item).alias("reason"))


@query(f"""SELECT CASE WHEN acceptance_utc < {LOW} + ({HIGH} - {LOW}) * 0.70 THEN 'train' WHEN acceptance_utc < {LOW} + ({HIGH} - {LOW}) * 0.85 THEN 'val' WHEN acceptance_utc < {HIGH} THEN 'test' ELSE 'live' END AS split,
  count(*) AS n FROM filings GROUP BY 1""")
def split_counts(spark, sf_dir):
    return adapters.filings(spark, sf_dir).groupBy(timecal.split_of(F.col("acceptance_utc"), LOW, HIGH, SMALL.split).alias("split")).agg(F.count("*").alias("n"))


@query("SELECT ticker, regexp_replace(regexp_replace(lower(name), '\\b(inc|corp|company)\\b', '', 'g'), '[^a-z0-9]', '', 'g') AS stem FROM companies")
def name_stems(spark, sf_dir):
    return adapters.companies(spark, sf_dir).select("ticker", scalars.name_stem(F.col("name")).alias("stem"))


STEMS = "SELECT ps_cik AS cik, ps_stem AS stem FROM (SELECT lpad(p_partkey::VARCHAR, 10, '0') AS ps_cik, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS ps_stem FROM part)"


def part_stems(spark, sf_dir):
    parts = adapters.read(spark, sf_dir, "part")
    return parts.select(F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("cik"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "").alias("stem"))


@query(f"""WITH c AS ({STEMS}), t AS (SELECT c.cik, r.stem AS r_stem, r.cik AS r_cik FROM c JOIN c r ON starts_with(c.stem, r.stem) AND r.cik <> c.cik AND (length(r.stem) >= 5 OR r.stem = c.stem)),
b AS (SELECT * FROM t QUALIFY length(r_stem) = max(length(r_stem)) OVER (PARTITION BY cik)),
g AS (SELECT cik, any_value(r_stem) AS r_stem, count(*) AS n, string_agg(r_cik, ',' ORDER BY r_cik) AS ids FROM b GROUP BY 1)
SELECT c.cik, r_stem, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'none' WHEN n > 20 THEN 'unresolved' ELSE 'proposed' END AS status, CASE WHEN n <= 20 THEN ids END AS candidates FROM c LEFT JOIN g USING (cik)""")
def predecessors(spark, sf_dir):
    names = part_stems(spark, sf_dir)
    return joins.propose(names, names).withColumn("candidates", F.array_join("candidates", ","))


# Joins and labels


@query("""WITH hit AS (SELECT accession_no, min(published_utc) AS t0_news_utc FROM filings f JOIN news n ON n.ticker = f.ticker AND published_utc BETWEEN acceptance_utc - 86400 AND acceptance_utc AND source_tier <= 2 GROUP BY 1)
SELECT f.accession_no, t0_news_utc, least(acceptance_utc, coalesce(t0_news_utc, acceptance_utc)) AS t0_utc, CASE WHEN t0_news_utc IS NULL THEN 'filing' ELSE 'news' END AS t0_source,
  CASE WHEN t0_news_utc IS NOT NULL THEN NULL WHEN f.ticker IN (SELECT ticker FROM news) THEN 'no_news_in_lookback' ELSE 'no_news_for_ticker' END AS fallback_reason
FROM filings f LEFT JOIN hit USING (accession_no)""")
def t0_correction(spark, sf_dir):
    out = labels.correct_t0(adapters.filings(spark, sf_dir), adapters.news(spark, sf_dir), SMALL.t0_lookback_s, SMALL.news_tier)
    return out.select("accession_no", "t0_news_utc", "t0_utc", "t0_source", "fallback_reason")


@query("""WITH hit AS (SELECT accession_no, f.ticker, min(published_utc) AS at_utc FROM filings f JOIN news n ON n.ticker = f.ticker AND published_utc BETWEEN acceptance_utc - 86400 AND acceptance_utc AND source_tier <= 2 GROUP BY 1, 2)
SELECT accession_no, arg_min(title, (source_tier IS NULL, source_tier, url)) AS title FROM hit JOIN news n ON n.ticker = hit.ticker AND n.published_utc = at_utc GROUP BY 1""")
def matched_headlines(spark, sf_dir):
    news = adapters.news(spark, sf_dir)
    matched = labels.correct_t0(adapters.filings(spark, sf_dir), news, SMALL.t0_lookback_s, SMALL.news_tier)
    return labels.headline(matched, news).select("accession_no", "title")


@query("""WITH gap AS (SELECT acceptance_utc - min(published_utc) AS g FROM filings f JOIN news n ON n.ticker = f.ticker AND published_utc BETWEEN acceptance_utc - 86400 AND acceptance_utc AND source_tier <= 2 GROUP BY accession_no, acceptance_utc),
r AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM gap)
SELECT max(CASE WHEN i = least(floor(n * 0.1)::BIGINT, n - 1) THEN g END) AS p10, max(CASE WHEN i = least(floor(n * 0.5)::BIGINT, n - 1) THEN g END) AS p50, max(CASE WHEN i = least(floor(n * 0.9)::BIGINT, n - 1) THEN g END) AS p90 FROM r""")
def gap_percentiles(spark, sf_dir):
    matched = labels.correct_t0(adapters.filings(spark, sf_dir), adapters.news(spark, sf_dir), SMALL.t0_lookback_s, SMALL.news_tier)
    return ranks.nearest_rank(matched.select((F.col("acceptance_utc") - F.col("t0_news_utc")).alias("gap")), "gap", [0.1, 0.5, 0.9])


@query("""WITH p AS (SELECT event_id, l.ticker, t0_utc,
  (SELECT CASE WHEN b.ts_utc + 3600 <= t0_utc THEN close ELSE open END FROM bars b WHERE b.ticker = l.ticker AND b.ts_utc <= t0_utc ORDER BY ts_utc DESC LIMIT 1) AS s,
  (SELECT close FROM bars b WHERE b.ticker = l.ticker AND b.ts_utc >= t0_utc + 86400 ORDER BY ts_utc LIMIT 1) AS e,
  (SELECT CASE WHEN m.ts_utc + 3600 <= t0_utc THEN close ELSE open END FROM market m WHERE m.ts_utc <= t0_utc ORDER BY ts_utc DESC LIMIT 1) AS bs,
  (SELECT close FROM market m WHERE m.ts_utc >= t0_utc + 86400 ORDER BY ts_utc LIMIT 1) AS be FROM labelled l),
m AS (SELECT event_id, CASE WHEN s > 0 AND e > 0 THEN CASE WHEN bs > 0 AND be > 0 THEN (e / s - 1) - (be / bs - 1) ELSE e / s - 1 END END AS move,
  CASE WHEN ticker NOT IN (SELECT ticker FROM bars) THEN 'no_bars' WHEN NOT coalesce(s > 0, false) THEN 'no_pre_t0_bar' WHEN NOT coalesce(e > 0, false) THEN 'no_post_t0_bar' END AS why FROM p)
SELECT event_id, round(move, 6) AS move, coalesce(why, CASE WHEN abs(move) < 0.03 THEN 'immaterial' END) AS exclude_reason, (coalesce(why, CASE WHEN abs(move) < 0.03 THEN 'immaterial' END) IS NULL)::INT AS usable FROM m""")
def materiality(spark, sf_dir):
    moved = labels.event_move(frames.labelled(spark, sf_dir), adapters.hourly_bars(spark, sf_dir), frames.market(spark, sf_dir), SMALL.materiality_h)
    return rounded(labels.material(moved, SMALL.min_abs_return).select("event_id", "move", "exclude_reason", "usable"), "move")


@query("""SELECT ticker, sum(CASE WHEN prev IS NULL OR t0_utc - prev > 21600 THEN 1 ELSE 0 END)::BIGINT AS announcements, count(*) AS events
FROM (SELECT ticker, t0_utc, lag(t0_utc) OVER (PARTITION BY ticker ORDER BY t0_utc) AS prev FROM labelled) GROUP BY 1""")
def announcements(spark, sf_dir):
    return labels.announcements(frames.labelled(spark, sf_dir), SMALL.census_gaps_h[0] * 3600)


@query(f"""WITH s AS (SELECT accession_no, ticker, greatest(acceptance_utc - 432000, {LOW}) AS a, acceptance_utc + 172800 AS b FROM filings),
x AS (SELECT s.*, count(DISTINCT se.date) AS n_sessions, count(DISTINCT d.day) AS n_present FROM s
  LEFT JOIN sessions se ON se.date BETWEEN to_timestamp(a)::TIMESTAMP::DATE AND to_timestamp(b)::TIMESTAMP::DATE
  LEFT JOIN (SELECT DISTINCT ticker, to_timestamp(ts_utc)::TIMESTAMP::DATE AS day FROM bars) d ON d.ticker = s.ticker AND d.day = se.date GROUP BY ALL),
e AS (SELECT ticker, min(ts_utc) AS f, max(ts_utc) AS l FROM bars GROUP BY 1)
SELECT accession_no, n_sessions, n_present, CASE WHEN n_sessions = 0 THEN 'no_sessions' WHEN f IS NULL THEN 'no_bars' WHEN f > a + 259200 THEN 'starts_late' WHEN l < b - 259200 THEN 'ends_early'
  WHEN n_present < 0.5 * n_sessions THEN 'gaps' ELSE 'ok' END AS outcome FROM x LEFT JOIN e USING (ticker)""")
def coverage_audit(spark, sf_dir):
    out = labels.coverage(adapters.filings(spark, sf_dir), adapters.hourly_bars(spark, sf_dir), adapters.sessions(spark), SMALL.pad_before_days * DAY, SMALL.pad_after_days * DAY, SMALL.coverage_tolerance_days * DAY, SMALL.min_session_coverage, LOW)
    return out.select("accession_no", "n_sessions", "n_present", "outcome")


@query("""WITH f AS (SELECT ts_utc FROM bars GROUP BY 1 HAVING count(DISTINCT ticker) >= 0.1 * (SELECT count(DISTINCT ticker) FROM bars)),
h AS (SELECT date, unnest(range((open_utc // 3600) * 3600, close_utc - 3600 + 1, 3600)) AS ts_utc FROM sessions)
SELECT date, count(*) AS n_missing, min(ts_utc) AS first_missing FROM h WHERE ts_utc NOT IN (SELECT ts_utc FROM f) GROUP BY 1""")
def thin_sessions(spark, sf_dir):
    bars = adapters.hourly_bars(spark, sf_dir)
    return labels.thin_sessions(bars, adapters.sessions(spark), bars.select("ticker").distinct().count(), 0.1)


@query(f"""WITH s AS (SELECT ticker, min(ts_utc) AS first_ts, avg(CASE WHEN ts_utc >= {HIGH} - 864000 THEN close * volume END) AS adv, count(CASE WHEN ts_utc >= {HIGH} - 864000 THEN 1 END) AS n, max(ts_utc) AS last_ts, arg_max(close, ts_utc) AS px
  FROM bars WHERE ts_utc <= {HIGH} GROUP BY 1), c AS (
SELECT t.ticker, round(adv, 6) AS adv_usd, CASE WHEN t.ticker NOT IN (SELECT ticker FROM filings WHERE acceptance_utc >= {HIGH} - 60 * 86400 AND acceptance_utc < {HIGH}) THEN 'no_prior_8k' WHEN first_ts IS NULL THEN 'no_bars'
  WHEN first_ts > {HIGH} - 864000 THEN 'short_history' WHEN last_ts < {HIGH} - 432000 THEN 'not_trading_at_as_of' WHEN n < 5 THEN 'too_few_bars' WHEN adv IS NULL OR px IS NULL THEN 'no_usable_bars' WHEN px < 0.5 THEN 'below_min_price' WHEN adv < 20 THEN 'below_min_adv' END AS reason
FROM (SELECT DISTINCT ticker FROM companies) t LEFT JOIN s USING (ticker)) SELECT * FROM c""")
def universe_reasons(spark, sf_dir):
    rows = universe.candidates(adapters.companies(spark, sf_dir), adapters.hourly_bars(spark, sf_dir), adapters.filings(spark, sf_dir), HIGH, SMALL)
    return rounded(universe.classify(rows, HIGH, SMALL).select("ticker", "adv_usd", "reason"), "adv_usd")


@query("""SELECT ticker, 1 AS in_computed, 0 AS in_stored FROM companies WHERE exchange <> 'OTC' AND ticker NOT IN (SELECT ticker FROM companies WHERE exchange <> 'NYSE')
UNION ALL SELECT ticker, 0, 1 FROM companies WHERE exchange <> 'NYSE' AND ticker NOT IN (SELECT ticker FROM companies WHERE exchange <> 'OTC')""")
def universe_drift(spark, sf_dir):
    rows = adapters.companies(spark, sf_dir)
    return universe.drift(rows.where("exchange <> 'OTC'"), rows.where("exchange <> 'NYSE'"))


@query(f"""SELECT reason, count(*) AS total, count(*) FILTER (scheduled) AS scheduled, count(*) FILTER (NOT scheduled) AS unscheduled FROM (
  SELECT CASE WHEN acceptance_utc < {LOW} OR acceptance_utc >= {HIGH} THEN 'outside_study_window' WHEN items = '9.01' THEN 'only_excluded_items' ELSE 'usable' END AS reason, contains(items, '2.02') AS scheduled FROM filings) GROUP BY 1""")
def reason_split(spark, sf_dir):
    rows = adapters.filings(spark, sf_dir)
    reason = F.coalesce(scalars.scope_reason(F.col("acceptance_utc"), LOW, HIGH - 1, F.lit(True)), scalars.item_reason(F.col("items"), SMALL.excluded_items), F.lit("usable"))
    scheduled = scalars.among(scalars.parse_items(F.col("items")), SMALL.scheduled_items)
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("total"), F.count_if(scheduled).alias("scheduled"), F.count_if(~scheduled).alias("unscheduled"))


# Aggregations over filings


@query("SELECT hour, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (SELECT (acceptance_utc // 3600) % 24 AS hour FROM filings) GROUP BY hour")
def acceptance_hours(spark, sf_dir):
    rows = adapters.filings(spark, sf_dir)
    by = rows.groupBy(F.hour(F.timestamp_seconds("acceptance_utc")).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("hour", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))  # 24 rows and one


@query("SELECT code, count(*) AS n, code = '2.02' AS scheduled, code = '9.01' AS excluded FROM (SELECT unnest(string_split(items, ',')) AS code FROM filings) GROUP BY 1")
def item_counts(spark, sf_dir):
    rows = adapters.filings(spark, sf_dir).select(F.explode(scalars.parse_items(F.col("items"))).alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("n")).withColumn("scheduled", F.col("code").isin(*SMALL.scheduled_items)).withColumn("excluded", F.col("code").isin(*SMALL.excluded_items))


@query("SELECT count(*) AS companies, min(n) AS least, (list(n ORDER BY n))[len(list(n)) // 2 + 1] AS median, max(n) AS most, round(avg(n), 1) AS mean FROM (SELECT cik, count(*) AS n FROM filings GROUP BY 1)")
def filings_per_company(spark, sf_dir):
    by = adapters.filings(spark, sf_dir).groupBy("cik").agg(F.count("*").alias("n"))
    by = stored(by)
    middle = ranks.nearest_rank(by, "n", [0.5]).scalar()
    return by.agg(F.count("*").alias("companies"), F.min("n").alias("least"), middle.alias("median"), F.max("n").alias("most"), F.round(F.avg("n"), 1).alias("mean"))


@query(f"SELECT cik, count(*) AS n FROM filings GROUP BY 1 HAVING min(acceptance_utc) > {LOW}")
def no_early_history(spark, sf_dir):
    return adapters.filings(spark, sf_dir).groupBy("cik").agg(F.count("*").alias("n"), F.min("acceptance_utc").alias("first")).where(F.col("first") > LOW).select("cik", "n")


@query(f"""SELECT count(*) AS total, count(*) FILTER (acceptance_utc >= {LOW} AND acceptance_utc < {HIGH}) AS inside, count(*) FILTER (acceptance_utc < {LOW} OR acceptance_utc >= {HIGH}) AS outside,
  count(*) FILTER (form = '8-K/A') AS amended, count(DISTINCT ticker) AS tickers, round(({HIGH} - {LOW}) / (365.25 / 12 * 86400), 6) AS months FROM filings""")
def filings_report(spark, sf_dir):
    inside = (F.col("acceptance_utc") >= LOW) & (F.col("acceptance_utc") < HIGH)
    return adapters.filings(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"), F.count_if(F.col("form") == "8-K/A").alias("amended"), F.count_distinct("ticker").alias("tickers"), F.lit(round((HIGH - LOW) / (365.25 / 12 * DAY), 6)).alias("months"))


# Windows


@query("""SELECT ticker, ts_utc, round(CASE WHEN lag(close, 1) OVER w > 0 THEN close / lag(close, 1) OVER w - 1 END, 6) AS ret_1h, round(CASE WHEN lag(close, 4) OVER w > 0 THEN close / lag(close, 4) OVER w - 1 END, 6) AS ret_4h
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts_utc)""")
def trailing_returns(spark, sf_dir):
    out = adapters.hourly_bars(spark, sf_dir).withColumns(features.returns(SMALL.horizons))
    return rounded(out.select("ticker", "ts_utc", "ret_1h", "ret_4h"), "ret_1h", "ret_4h")


@query("SELECT ticker, ts_utc, round(volume_z, 6) AS volume_z FROM z")
def volume_z(spark, sf_dir):
    return rounded(frames.with_z(spark, sf_dir).select("ticker", "ts_utc", "volume_z"), "volume_z")


@query("""SELECT ticker, ts_utc, round(CASE WHEN count(r) OVER w = 8 THEN stddev_samp(r) OVER w END, 6) AS volatility FROM (
  SELECT ticker, ts_utc, CASE WHEN lag(close) OVER d > 0 THEN close / lag(close) OVER d - 1 END AS r FROM bars WINDOW d AS (PARTITION BY ticker ORDER BY ts_utc))
WINDOW w AS (PARTITION BY ticker ORDER BY ts_utc ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def volatility(spark, sf_dir):
    return rounded(features.with_volatility(adapters.hourly_bars(spark, sf_dir), SMALL.vol_window).select("ticker", "ts_utc", "volatility"), "volatility")


@query("""SELECT ticker, ts_utc, round(CASE WHEN lag(c) OVER w > 0 AND lag(b) OVER w > 0 THEN (c / lag(c) OVER w - 1) - (b / lag(b) OVER w - 1) END, 6) AS ret_rel_1h
FROM (SELECT ticker, bars.ts_utc, bars.close AS c, market.close AS b FROM bars LEFT JOIN market ON market.ts_utc = bars.ts_utc) WINDOW w AS (PARTITION BY ticker ORDER BY ts_utc)""")
def relative_returns(spark, sf_dir):
    benchmark = frames.market(spark, sf_dir).select("ts_utc", F.col("close").alias("b_close"))
    return rounded(features.with_benchmark(adapters.hourly_bars(spark, sf_dir), benchmark, (1,)).select("ticker", "ts_utc", "ret_rel_1h"), "ret_rel_1h")


@query("""SELECT b.ticker, b.ts_utc, (b.ts_utc - max(published_utc)) / 3600.0::DOUBLE AS hours_since_news, count(CASE WHEN published_utc > b.ts_utc - 86400 THEN 1 END) AS news_count_24h,
  count(DISTINCT CASE WHEN published_utc > b.ts_utc - 86400 THEN publisher END) AS news_breadth_24h, count(CASE WHEN published_utc > b.ts_utc - 259200 THEN 1 END) AS news_count_72h,
  count(DISTINCT CASE WHEN published_utc > b.ts_utc - 259200 THEN publisher END) AS news_breadth_72h
FROM bars b LEFT JOIN news n ON n.ticker = b.ticker AND published_utc <= b.ts_utc GROUP BY 1, 2""")
def news_features(spark, sf_dir):
    out = features.news_features(adapters.hourly_bars(spark, sf_dir).select("ticker", "ts_utc"), adapters.news(spark, sf_dir), SMALL.news_windows_h)
    return out


@query("""SELECT b.ticker, b.ts_utc, (b.ts_utc - max(acceptance_utc)) / 86400.0::DOUBLE AS days_since_last_8k, (b.ts_utc - max(CASE WHEN contains(items, '2.02') THEN acceptance_utc END)) / 86400.0::DOUBLE AS days_since_last_earnings
FROM bars b LEFT JOIN filings f ON f.ticker = b.ticker AND acceptance_utc <= b.ts_utc GROUP BY 1, 2""")
def days_since_filings(spark, sf_dir):
    filed = adapters.filings(spark, sf_dir).select("ticker", "items", F.col("acceptance_utc").alias("at"))
    out = features.days_since(adapters.hourly_bars(spark, sf_dir).select("ticker", "ts_utc"), filed, "days_since_last_8k")
    out = features.days_since(out, filed.where(F.col("items").contains("2.02")), "days_since_last_earnings")
    return out


@query("""SELECT accession_no, z.ts_utc, round(z.volume_z, 6) AS volume_z FROM filings f JOIN z ON z.ticker = f.ticker AND z.ts_utc < acceptance_utc QUALIFY row_number() OVER (PARTITION BY accession_no ORDER BY z.ts_utc DESC) <= 8""")
def bars_before_filings(spark, sf_dir):
    anchors = adapters.filings(spark, sf_dir).select("accession_no", "ticker", F.col("acceptance_utc").alias("anchor_utc"))
    return rounded(joins.bars_before(frames.with_z(spark, sf_dir), anchors, SMALL.horizon_bars).select("accession_no", "ts_utc", "volume_z"), "volume_z")


QUIET = """SELECT b.ticker, b.ts_utc, NOT EXISTS (SELECT 1 FROM filings f WHERE f.ticker = b.ticker AND abs(f.acceptance_utc - b.ts_utc) <= 43200) AS quiet FROM bars b"""


def quiet_frame(spark, sf_dir):
    filed = adapters.filings(spark, sf_dir).select("ticker", F.col("acceptance_utc").alias("at"))
    return sampling.mark_quiet(adapters.hourly_bars(spark, sf_dir).select("ticker", "ts_utc"), filed, SMALL.quiet_gap_h * 3600)


@query(QUIET)
def quiet_bars(spark, sf_dir):
    return quiet_frame(spark, sf_dir)


TILES = f"""WITH RECURSIVE q AS ({QUIET}), n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts_utc) - 1 AS i FROM q),
walk AS (SELECT ticker, ts_utc, i, CASE WHEN quiet THEN 1 ELSE 0 END AS run, false AS anchor FROM n WHERE i = 0
  UNION ALL SELECT n.ticker, n.ts_utc, n.i, CASE WHEN NOT n.quiet THEN 0 WHEN (CASE WHEN w.anchor THEN 0 ELSE w.run END) + 1 > 3 AND n.i - 3 >= 5 THEN 0 ELSE (CASE WHEN w.anchor THEN 0 ELSE w.run END) + 1 END,
    n.quiet AND (CASE WHEN w.anchor THEN 0 ELSE w.run END) + 1 > 3 AND n.i - 3 >= 5 FROM walk w JOIN n ON n.ticker = w.ticker AND n.i = w.i + 1)
SELECT ticker, ts_utc AS anchor_utc FROM walk WHERE anchor"""


@query(TILES)
def quiet_anchors(spark, sf_dir):
    return sampling.anchors(quiet_frame(spark, sf_dir), 3, 5)


@query(f"SELECT ticker, anchor_utc FROM ({TILES}) ORDER BY md5(ticker || '|' || anchor_utc || '|42'), ticker, anchor_utc LIMIT 100")
def quiet_draw(spark, sf_dir):
    return sampling.draw(sampling.anchors(quiet_frame(spark, sf_dir), 3, 5), 100, SMALL.seed)


# Evaluation


@query("SELECT window_id, ticker, ts_utc, t0_utc, is_scheduled, item_code, round(volume_z, 6) AS volume_z FROM frame")
def evaluation_frame(spark, sf_dir):
    return rounded(frames.frame(spark, sf_dir), "volume_z")


@query("SELECT window_id, ticker, ts_utc, t0_utc, round(score, 6) AS score, round((t0_utc - ts_utc) / 3600.0, 6) AS lead_wall_h FROM pred WHERE action = 'FLAG'")
def first_crossings(spark, sf_dir):
    flags = frames.predictions(spark, sf_dir).where("action = 'FLAG'")
    return rounded(flags.select("window_id", "ticker", "ts_utc", "t0_utc", "score", ((F.col("t0_utc") - F.col("ts_utc")) / 3600.0).alias("lead_wall_h")), "score", "lead_wall_h")


@query("SELECT 'x' AS window_id, 'x' AS rule WHERE false")
def contract_violations(spark, sf_dir):
    return contract.violations(frames.predictions(spark, sf_dir))


@query("SELECT window_id, ticker, is_positive, round(peak, 6) AS peak, is_scheduled, item_code FROM summary")
def window_summaries(spark, sf_dir):
    return rounded(metrics.window_summary(frames.predictions(spark, sf_dir)), "peak")


BUDGET = """WITH b AS (SELECT floor(count(DISTINCT (ticker, date_trunc('month', to_timestamp(ts_utc)::TIMESTAMP))) * 2.0 + 0.5) AS budget FROM pred),
thr AS (SELECT min(peak) AS threshold FROM (SELECT peak, row_number() OVER (ORDER BY peak DESC) AS r FROM summary) WHERE r <= (SELECT budget FROM b)),
s AS (SELECT *, peak >= (SELECT threshold FROM thr) AS alert FROM summary),
quiet AS (SELECT count(*) AS n_quiet, count(*) FILTER (alert) AS fp FROM s WHERE NOT is_positive),
p AS (SELECT alert, unnest(list_distinct(['all', CASE WHEN is_scheduled THEN 'scheduled' ELSE 'unscheduled' END] || list_transform(list_filter(string_split(item_code, ','), lambda c: c <> '9.01'), lambda c: 'item ' || c))) AS slice FROM s WHERE is_positive)"""


@query(BUDGET + """ SELECT slice, count(*) + any_value(n_quiet) AS windows, count(*) AS n_positive, count(*) FILTER (alert) + any_value(fp) AS alerts, count(*) FILTER (alert) AS true_positives,
  round(count(*) FILTER (alert) / (count(*) FILTER (alert) + any_value(fp)), 6) AS precision, round(least(count(*), count(*) FILTER (alert) + any_value(fp)) / (count(*) FILTER (alert) + any_value(fp)), 6) AS ceiling,
  round(count(*) FILTER (alert) / count(*), 6) AS recall, round(count(*) / (count(*) + any_value(n_quiet)), 6) AS base_rate FROM p CROSS JOIN quiet GROUP BY slice""")
def budget_report(spark, sf_dir):
    rows = stored(frames.predictions(spark, sf_dir))  # read for the budget, the threshold and the report
    _, threshold = metrics.budgeted(rows, SMALL.budget_per_month)
    return rounded(metrics.report(rows, threshold, SMALL.excluded_items), "precision", "ceiling", "recall", "base_rate")


@query("""WITH lead AS (SELECT window_id, ts_utc, t0_utc, sum(greatest(0, least(t0_utc, close_utc) - greatest(ts_utc, open_utc))) / 3600.0 AS h FROM pred CROSS JOIN sessions WHERE action = 'FLAG' AND t0_utc IS NOT NULL GROUP BY ALL)
SELECT count(*) AS detections, (SELECT count(DISTINCT window_id) FROM pred WHERE t0_utc IS NOT NULL) AS positives, (SELECT count(DISTINCT window_id) FROM pred WHERE t0_utc IS NOT NULL) - count(*) AS missed,
  round(quantile_cont(h, 0.25), 6) AS p25, round(quantile_cont(h, 0.5), 6) AS p50, round(quantile_cont(h, 0.75), 6) AS p75, round(min(h), 6) AS least, round(max(h), 6) AS most FROM lead""")
def detection_delays(spark, sf_dir):
    return rounded(metrics.delay_summary(frames.predictions(spark, sf_dir), frames.clock(spark)), "p25", "p50", "p75", "least", "most")


NOISE_SQL = "(('0x' || md5(window_id || '|' || ts_utc || '|42')[1:12])::BIGINT / 281474976710656.0)"


@query(f"""WITH n AS (SELECT {NOISE_SQL} AS p, (t0_utc IS NOT NULL)::INT AS y FROM frame) SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(y) * (1 - avg(y)), 6) AS baseline,
round(1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y))), 6) AS skill FROM n""")
def brier_of_noise(spark, sf_dir):
    return rounded(metrics.brier(frames.predictions(spark, sf_dir, detectors.Noise(SMALL.seed))), "brier", "baseline", "skill")


@query(f"""SELECT least(floor({NOISE_SQL} * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg({NOISE_SQL}), 6) AS predicted, round(avg((t0_utc IS NOT NULL)::INT), 6) AS actual FROM frame GROUP BY 1""")
def reliability_of_noise(spark, sf_dir):
    return rounded(metrics.reliability(frames.predictions(spark, sf_dir, detectors.Noise(SMALL.seed)), SMALL.calibration_bins), "predicted", "actual")


@query("""SELECT count(*) FILTER (action = 'WAIT') AS wait_hours, count(*) FILTER (action = 'FLAG') AS flag_hours, round(avg((action = 'FLAG')::INT), 6) AS share_flagged,
round(count(DISTINCT CASE WHEN action = 'FLAG' THEN window_id END) / count(DISTINCT window_id), 6) AS share_alerted FROM pred""")
def action_distribution(spark, sf_dir):
    return rounded(metrics.action_counts(frames.predictions(spark, sf_dir)), "share_flagged", "share_alerted")


@query("""WITH w AS (SELECT window_id, count(*) AS n, bool_or(t0_utc IS NOT NULL) AS pos FROM frame GROUP BY 1)
SELECT sum(n)::BIGINT AS rows, count(*) AS windows, count(*) FILTER (pos) AS positive_windows, sum(('0x' || md5(window_id)[1:12])::BIGINT)::BIGINT AS digest FROM w""")
def data_fingerprint(spark, sf_dir):
    return metrics.fingerprint(frames.frame(spark, sf_dir))


@query("""SELECT (SELECT count(*) FROM z) AS rows, 'volume_z' AS column, count(*) FILTER (volume_z IS NULL) AS nulls, 0::BIGINT AS not_finite FROM z
UNION ALL SELECT count(*), 'close', count(*) FILTER (close IS NULL), 0 FROM z""")
def matrix_audit(spark, sf_dir):
    return metrics.null_audit(frames.with_z(spark, sf_dir), ["volume_z", "close"])


@query("""WITH s AS (SELECT window_id, action, t0_utc, row_number() OVER (PARTITION BY window_id ORDER BY ts_utc) - 1 AS i FROM pred),
w AS (SELECT window_id, count(*) AS n, min(CASE WHEN action = 'FLAG' THEN i END) AS s, bool_or(t0_utc IS NOT NULL) AS pos FROM s GROUP BY 1)
SELECT window_id, n, round(CASE WHEN s IS NULL THEN (n - 1) * -0.005 + CASE WHEN pos THEN -0.5 ELSE 0 END ELSE s * -0.005 + CASE WHEN pos THEN 1.0 + 0.5 * (n - 1 - s) / greatest(n - 1, 1) ELSE -2.0 END END, 6) AS payoff FROM w""")
def stopping_payoffs(spark, sf_dir):
    c = SMALL
    return rounded(contract.payoffs(frames.predictions(spark, sf_dir), c.reward_wait, c.reward_correct, c.reward_early, c.reward_false, c.reward_missed), "payoff")


@query("""WITH RECURSIVE n AS (SELECT ticker, ts_utc, volume_z AS x, row_number() OVER (PARTITION BY ticker ORDER BY ts_utc) AS i FROM z),
w AS (SELECT ticker, ts_utc, i, CASE WHEN x IS NULL THEN 0.0 ELSE greatest(0.0, x - 0.5) END::DOUBLE AS s, x FROM n WHERE i = 1
  UNION ALL SELECT n.ticker, n.ts_utc, n.i, CASE WHEN n.x IS NULL THEN CASE WHEN w.x IS NOT NULL AND w.s >= 2.0 THEN 0.0 ELSE w.s END ELSE greatest(0.0, CASE WHEN w.x IS NOT NULL AND w.s >= 2.0 THEN 0.0 ELSE w.s END + n.x - 0.5) END, n.x FROM w JOIN n ON n.ticker = w.ticker AND n.i = w.i + 1)
SELECT ticker, ts_utc, round(CASE WHEN x IS NOT NULL THEN s END, 6) AS cusum FROM w""")
def cusum(spark, sf_dir):
    return rounded(detectors.cusum(frames.with_z(spark, sf_dir), SMALL.cusum_k, SMALL.cusum_h), "cusum")


@query("""WITH c AS (SELECT ticker, ts_utc, volume_z, sum(volume_z - 0.5) OVER (PARTITION BY ticker ORDER BY ts_utc) AS c FROM z)
SELECT ticker, ts_utc, round(CASE WHEN volume_z IS NOT NULL THEN c - least(0.0, min(c) OVER (PARTITION BY ticker ORDER BY ts_utc)) END, 6) AS cusum FROM c""")
def cusum_without_reset(spark, sf_dir):
    out = detectors.cusum_no_reset(frames.with_z(spark, sf_dir), SMALL.cusum_k)
    return rounded(out.select("ticker", "ts_utc", "cusum"), "cusum")


@query()
def trees_scores(spark, sf_dir):
    """Few small trees, fitted on the frame's earlier part: a fit has no SQL."""
    rows = stored(frames.frame(spark, sf_dir).withColumn("hour", F.hour(F.timestamp_seconds("ts_utc")).cast("double")))  # each pass of the fit reads them
    cut = LOW + int((HIGH - LOW) * SMALL.split[0])
    model = detectors.Trees(["volume_z", "hour"], trees=3, depth=3, seed=SMALL.seed).fit(rows.where(F.col("ts_utc") < cut))
    return model.predict(rows.where(F.col("ts_utc") >= cut)).select("window_id", "ts_utc", "score", "action")


@query("""WITH RECURSIVE pair AS (SELECT k::DOUBLE AS k, h::DOUBLE AS h FROM (VALUES (0.25), (0.5), (1.0)) a(k), (VALUES (0.5), (1.0), (2.0), (4.0)) b(h) WHERE h >= k),
n AS (SELECT ticker, ts_utc, x, row_number() OVER (PARTITION BY ticker ORDER BY ts_utc) AS i FROM (SELECT DISTINCT ticker, ts_utc, round(volume_z, 6) AS x FROM frame)),
w AS (SELECT k, h, ticker, ts_utc, i, CASE WHEN x IS NULL THEN 0.0 ELSE greatest(0.0, x - k) END::DOUBLE AS s, x FROM n, pair WHERE i = 1
  UNION ALL SELECT k, h, n.ticker, n.ts_utc, n.i, CASE WHEN n.x IS NULL THEN CASE WHEN w.x IS NOT NULL AND w.s >= h THEN 0.0 ELSE w.s END ELSE greatest(0.0, CASE WHEN w.x IS NOT NULL AND w.s >= h THEN 0.0 ELSE w.s END + n.x - k) END, n.x FROM w JOIN n ON n.ticker = w.ticker AND n.i = w.i + 1),
r AS (SELECT k, h, window_id, f.ts_utc, t0_utc, CASE WHEN x IS NOT NULL THEN s END AS s FROM frame f JOIN w ON w.ticker = f.ticker AND w.ts_utc = f.ts_utc),
peak AS (SELECT * FROM (SELECT k, h, window_id, bool_or(t0_utc IS NOT NULL) AS positive, CASE WHEN bool_or(t0_utc IS NOT NULL) THEN (list(s ORDER BY ts_utc DESC))[1] ELSE max(s) END AS peak FROM r GROUP BY 1, 2, 3) WHERE peak IS NOT NULL),
cut AS (SELECT k, h, min(peak) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY k, h ORDER BY peak DESC) AS no FROM peak) WHERE no <= 200 GROUP BY 1, 2),
flag AS (SELECT r.k, r.h, window_id, min(ts_utc) AS ts_utc, max(t0_utc) AS t0_utc FROM r JOIN cut ON cut.k = r.k AND cut.h = r.h AND s >= threshold WHERE t0_utc IS NOT NULL GROUP BY 1, 2, 3),
lead AS (SELECT k, h, window_id, sum(greatest(0, least(t0_utc, close_utc) - greatest(ts_utc, open_utc))) / 3600.0 AS lead FROM flag, sessions GROUP BY 1, 2, 3),
middle AS (SELECT k, h, quantile_cont(lead, 0.5) AS lead FROM lead GROUP BY 1, 2)
SELECT cut.k, cut.h, round(threshold, 6) AS threshold, count(*) AS alerts, round(avg(positive::INT), 6) AS precision, round(any_value(lead), 6) AS median_lead_h
FROM peak JOIN cut ON cut.k = peak.k AND cut.h = peak.h AND peak >= threshold LEFT JOIN middle ON middle.k = cut.k AND middle.h = cut.h GROUP BY 1, 2, 3""")
def cusum_tuning(spark, sf_dir):
    """Eleven pairs of which each is folded, ranked and cut on its own."""
    rows = rounded(frames.frame(spark, sf_dir), "volume_z")
    out = detectors.tune_cusum(rows, [(k, h) for k in (0.25, 0.5, 1.0) for h in (0.5, 1.0, 2.0, 4.0)], 200, frames.clock(spark))
    return rounded(out, "threshold", "precision", "median_lead_h")


@query(BUDGET + """ SELECT slice, round((count(*) FILTER (alert) / (count(*) FILTER (alert) + any_value(fp))) / (count(*) / (count(*) + any_value(n_quiet))), 6) AS lift FROM p CROSS JOIN quiet GROUP BY slice""")
def lift_over_constant(spark, sf_dir):
    """A constant detector's tie admits every window, so its precision is the base rate."""
    frame = stored(frames.frame(spark, sf_dir))  # of both detectors
    rows = stored(detectors.VolumeZ(SMALL.z_threshold).predict(frame))  # read for the budget, the threshold and the report
    summary = stored(metrics.window_summary(rows))
    _, threshold = metrics.budgeted(rows, SMALL.budget_per_month, summary=summary)
    floor = metrics.report(detectors.Constant().score(frame), 0.0, SMALL.excluded_items)
    return rounded(metrics.with_lift(metrics.summary_report(summary, threshold, SMALL.excluded_items), floor).select("slice", "lift"), "lift")


# The alert log


@query("SELECT alert_id, detector, ticker, ts_utc, score, threshold FROM alerts")
def alerts_scanned(spark, sf_dir):
    return frames.alerts(spark, sf_dir).select("alert_id", "detector", "ticker", "ts_utc", "score", "threshold")


@query("""WITH RECURSIVE n AS (SELECT *, row_number() OVER (ORDER BY ts_utc, ticker) AS seq, alert_id || '|' || ts_utc || '|' || ticker || '|' || detector || '|' || printf('%.6f', score) || '|' || printf('%.6f', threshold) AS txt FROM alerts),
c AS (SELECT alert_id, seq, '' AS prev_sha, sha256('|' || txt) AS row_sha FROM n WHERE seq = 1 UNION ALL SELECT n.alert_id, n.seq, c.row_sha, sha256(c.row_sha || '|' || n.txt) FROM c JOIN n ON n.seq = c.seq + 1)
SELECT alert_id, seq, prev_sha, row_sha FROM c""")
def alert_chain(spark, sf_dir):
    return alertlog.append(None, frames.alerts(spark, sf_dir)).select("alert_id", "seq", "prev_sha", "row_sha")


@query("SELECT 'x' AS detector, 1::BIGINT AS seq, 'x' AS kind WHERE false")
def chain_breaks(spark, sf_dir):
    return alertlog.chain_breaks(alertlog.append(None, frames.alerts(spark, sf_dir)))


@query("""SELECT o.alert_id, filed, accession_no, item_code, t0_utc, CASE WHEN t0_utc IS NOT NULL THEN (SELECT sum(greatest(0, least(o.t0_utc, close_utc) - greatest(a.ts_utc, open_utc)))::BIGINT FROM sessions) / 3600.0::DOUBLE END AS lead_trading_h
FROM outcome o JOIN alerts a ON a.alert_id = o.alert_id""")
def alert_outcomes(spark, sf_dir):
    return frames.outcomes(spark, sf_dir)


@query("""SELECT detector, count(filed) AS scored, count(*) FILTER (filed = 1) AS n_filed, count(*) FILTER (filed = 0) AS missed, count(*) FILTER (filed IS NULL) AS pending, round(avg(filed), 6) AS rate
FROM alerts a LEFT JOIN outcome o ON o.alert_id = a.alert_id GROUP BY 1""")
def hit_rates(spark, sf_dir):
    return rounded(alertlog.hit_rates(frames.alerts(spark, sf_dir), frames.outcomes(spark, sf_dir)).drop("mean_lead_h"), "rate")


@query("""SELECT detector, count(*) AS resolved, count(*) FILTER (filed = 1 AND contains(item_code, '2.02')) AS scheduled, count(*) FILTER (filed = 1 AND NOT contains(item_code, '2.02')) AS unscheduled
FROM alerts a JOIN outcome o ON o.alert_id = a.alert_id GROUP BY 1""")
def split_hit_rates(spark, sf_dir):
    return alertlog.split_rates(frames.alerts(spark, sf_dir), frames.outcomes(spark, sf_dir), SMALL.scheduled_items)


@query("""SELECT a.alert_id, CASE WHEN filed = 1 THEN 'filed' WHEN filed = 0 THEN 'none' WHEN ts_utc + 172800 > edge THEN 'open' ELSE 'unscored' END AS state
FROM alerts a CROSS JOIN edge LEFT JOIN outcome o ON o.alert_id = a.alert_id""")
def alert_states(spark, sf_dir):
    return alertlog.states(frames.alerts(spark, sf_dir), frames.outcomes(spark, sf_dir), SMALL.outcome_h, frames.edge(spark, sf_dir)).select("alert_id", "state")


@query("SELECT item_code, count(*) AS n FROM outcome WHERE filed = 1 GROUP BY 1")
def filed_items(spark, sf_dir):
    return alertlog.item_breakdown(frames.outcomes(spark, sf_dir))


@query("SELECT ts_utc // 86400 AS day, count(*) AS n, round(max(score / threshold), 6) AS strongest FROM alerts GROUP BY 1")
def alerts_per_day(spark, sf_dir):
    return rounded(alertlog.per_day(frames.alerts(spark, sf_dir)), "strongest")


@query("SELECT strftime(to_timestamp(ts_utc)::TIMESTAMP, '%Y-%m') AS month, count(*) AS n, (2 * (SELECT count(DISTINCT ticker) FROM companies))::BIGINT AS allowance FROM alerts GROUP BY 1 ORDER BY 1 DESC LIMIT 1")
def budget_line(spark, sf_dir):
    return alertlog.budget_line(frames.alerts(spark, sf_dir), adapters.companies(spark, sf_dir).count(), SMALL.budget_per_month)


@query("SELECT alert_id, CASE WHEN score / threshold >= 10 THEN 'extreme' WHEN score / threshold >= 4 THEN 'strong' WHEN score / threshold >= 2 THEN 'elevated' ELSE 'marginal' END AS strength FROM alerts")
def alert_strengths(spark, sf_dir):
    return frames.alerts(spark, sf_dir).select("alert_id", scalars.strength(F.col("score"), F.col("threshold")).alias("strength"))


@query("""SELECT a.ticker, a.ts_utc, round(quantile_cont(b.volume, 0.05), 6) AS p05, round(quantile_cont(b.volume, 0.5), 6) AS median, round(quantile_cont(b.volume, 0.95), 6) AS p95, round(avg((b.volume < a.volume)::INT), 6) AS share_below, count(*) AS n
FROM (SELECT al.ticker, al.ts_utc, volume FROM alerts al JOIN bars ON bars.ticker = al.ticker AND bars.ts_utc = al.ts_utc) a JOIN bars b ON b.ticker = a.ticker AND b.ts_utc < a.ts_utc AND b.ts_utc >= a.ts_utc - 2592000 GROUP BY 1, 2""")
def trailing_normal(spark, sf_dir):
    bars = adapters.hourly_bars(spark, sf_dir)
    flagged = frames.alerts(spark, sf_dir).select("ticker", "ts_utc").join(bars.select("ticker", "ts_utc", F.col("volume").alias("value")), ["ticker", "ts_utc"])
    out = features.moving_average_normal(bars, flagged, "volume")
    return rounded(out.drop("value"), "p05", "median", "p95", "share_below")


# Texts as posts


@query(r"""WITH u AS (SELECT upper(s_name[1:2]) || chr((65 + s_suppkey % 26)::INT) AS ticker FROM supplier), w AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '\$([A-Z]{1,5})\b', 1)) AS ticker FROM documents
  UNION SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b([A-Z]{2,5})\b', 1)) AS t FROM documents) WHERE t IN (SELECT ticker FROM u) OR t IN ('AKIA', 'II'))
SELECT id, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers FROM w GROUP BY 1 HAVING count(DISTINCT ticker) <= 5""")
def ticker_mentions(spark, sf_dir):
    s = adapters.read(spark, sf_dir, "supplier")
    names = s.select(F.concat(F.upper(F.substring("s_name", 1, 2)), F.chr((65 + F.col("s_suppkey") % 26).cast("long"))).alias("ticker"))
    more = spark.range(1).select(F.explode(F.array(F.lit("AKIA"), F.lit("II"))).alias("ticker"))
    known = names.unionByName(more).withColumn("name", F.lit(None).cast("string"))
    found = text.mentions(adapters.read(spark, sf_dir, "documents"), known, "doc_id", "text")
    return found.select("id", F.array_join("tickers", ",").alias("tickers"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'password') THEN 'password' WHEN contains(lower(text), 'token') THEN 'token' END AS keyword FROM documents")
def keyword_classes(spark, sf_dir):
    return adapters.read(spark, sf_dir, "documents").select("doc_id", scalars.keyword_class(F.col("text"), ["license", "password", "token"]).alias("keyword"))


@query("""WITH s AS (SELECT event_id AS id, i AS hour, CASE WHEN l.t0_utc % 2 = 0 THEN 'down' ELSE 'up' END AS claim, (l.t0_utc * i) % 101 / 1000.0 - 0.05 AS ret, (l.t0_utc * i) % 37 / 10.0 AS z FROM labelled l CROSS JOIN range(1, 13) t(i)),
d AS (SELECT id, hour, CASE WHEN hour < 3 THEN 'WAIT' WHEN (claim = 'down' AND ret <= -0.04) OR (claim <> 'down' AND ret >= 0.04) OR z >= 3.5 THEN 'TRUE' WHEN hour >= 12 THEN 'FALSE' ELSE 'WAIT' END AS decision FROM s)
SELECT id, min(hour)::INT AS hour, arg_min(decision, hour) AS decision FROM d WHERE decision <> 'WAIT' GROUP BY 1""")
def hourly_decisions(spark, sf_dir):
    steps = frames.labelled(spark, sf_dir).select(F.col("event_id").alias("id"), "t0_utc", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("hour"))
    mixed = F.col("t0_utc") * F.col("hour")
    steps = steps.select("id", "hour", F.when(F.col("t0_utc") % 2 == 0, "down").otherwise("up").alias("claim"), ((mixed % 101) / 1000.0 - 0.05).alias("ret"), ((mixed % 37) / 10.0).alias("z"))
    return text.decide(steps, 3, 12, 0.04, 0.04, 3.5)


POSTS = "SELECT user_id::VARCHAR AS ticker, tm AS ts, event_id AS id, 'post ' || event_id AS title, value AS score, event_type AS kind FROM events JOIN ev USING (event_id, user_id, event_type)"


def posts(spark, sf_dir):
    return adapters.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("ticker"), adapters.epoch("ts").alias("ts"), F.col("event_id").alias("id"), F.concat(F.lit("post "), "event_id").alias("title"), F.col("value").alias("score"), F.col("event_type").alias("kind"))


@query(f"""WITH p AS ({POSTS}), g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > 21600 THEN 1 ELSE 0 END AS fresh FROM p WINDOW w AS (PARTITION BY ticker ORDER BY ts, id)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker ORDER BY ts, id) AS no FROM g)
SELECT ticker, min(ts) AS t0, count(*) AS n, arg_min(score, (ts, id)) AS first_score, arg_min(title, (ts, id))[1:280] AS summary, arg_min(kind, (ts, id)) AS kind, string_agg(id::VARCHAR, ',' ORDER BY ts, id) AS ids
FROM c GROUP BY ticker, no HAVING count(*) >= 3 OR arg_min(score, (ts, id)) >= 60""")
def post_clusters(spark, sf_dir):
    return text.clusters(posts(spark, sf_dir), 21600, 3, 60.0)


@query("""WITH b AS (SELECT event_id AS id, count(*) AS n, avg(b.volume) AS mean, stddev_pop(b.volume) AS sd, arg_max(b.close, b.ts_utc) AS before FROM (
    SELECT event_id, b.ts_utc, b.volume, b.close FROM labelled l JOIN bars b ON b.ticker = l.ticker AND b.ts_utc < t0_utc QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY b.ts_utc DESC) <= 24) b GROUP BY 1),
a AS (SELECT event_id AS id, arg_max(close, ts_utc) AS last, avg(volume) AS volume FROM labelled l JOIN bars b ON b.ticker = l.ticker AND ts_utc BETWEEN t0_utc AND t0_utc + 86400 GROUP BY 1),
r AS (SELECT event_id AS id, CASE WHEN n >= 8 AND last IS NOT NULL AND before > 0 THEN last / before - 1 END AS ret, CASE WHEN n >= 8 AND last IS NOT NULL AND before > 0 THEN (a.volume - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END END AS z
  FROM labelled l LEFT JOIN b ON b.id = event_id LEFT JOIN a ON a.id = event_id)
SELECT id, round(ret, 6) AS ret, round(z, 6) AS z, abs(ret) >= 0.04 OR z >= 2 AS abnormal FROM r""")
def abnormal_moves(spark, sf_dir):
    events = frames.labelled(spark, sf_dir).select(F.col("event_id").alias("id"), "ticker", F.col("t0_utc").alias("t0"))
    return rounded(text.abnormal_moves(events, adapters.hourly_bars(spark, sf_dir), DAY, 24, 8), "ret", "z")


@query("""SELECT l.event_id AS id, CASE WHEN min(published_utc) IS NOT NULL THEN 1 WHEN l.t0_utc % 2 = 0 THEN 0 END AS label, CASE WHEN min(published_utc) IS NOT NULL THEN min(published_utc) WHEN l.t0_utc % 2 = 0 THEN l.t0_utc + 86400 END AS label_ts
FROM labelled l LEFT JOIN news n ON n.ticker = l.ticker AND published_utc BETWEEN l.t0_utc AND l.t0_utc + 86400 AND source_tier = 1 GROUP BY l.event_id, l.t0_utc""")
def confirmed_labels(spark, sf_dir):
    events = frames.labelled(spark, sf_dir).select(F.col("event_id").alias("id"), "ticker", F.col("t0_utc").alias("t0"))
    articles = adapters.news(spark, sf_dir).where("source_tier = 1").select("ticker", F.col("published_utc").alias("at"))
    moves = events.select("id", (F.col("t0") % 2 != 0).alias("abnormal"))
    return text.confirmed(events, articles, DAY, moves).select("id", "label", "label_ts")
