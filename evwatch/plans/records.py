"""Registered queries of what is kept beside the data: counts of ingests, guards, snapshots, the seal, frames to
train on, and of features that look ahead."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evwatch.config import DAY, SMALL
from evwatch.operators import evaluation, features, reports, sampling, seal, universe
from evwatch.plans import frames
from evwatch.plans.queries import TILES, query, quiet_frame, rounded
from evwatch.plans.study import TRAIN_END, audited, matrix
from evwatch.plans.views_sql import HIGH, LOW
from evwatch.sources import adapters, ingest, scans, sinks
from evwatch.tables import shared_dir, stored


@query("""SELECT 'bars' AS dataset, count(*) AS read, count(*) FILTER (event_id % 11 <> 0 AND event_id % 13 <> 0) - count(DISTINCT CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN (user_id, floor(epoch(ts) / 3600)) END) AS repeated,
  count(*) FILTER (event_id % 11 = 0 OR event_id % 13 = 0) AS rejected, count(DISTINCT CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN (user_id, floor(epoch(ts) / 3600)) END) AS kept FROM events
UNION ALL SELECT 'filings', count(*), 0, count(*) FILTER (form <> '8-K' OR acceptance_utc % 5 = 0 OR acceptance_utc % 7 = 0), count(*) FILTER (form = '8-K' AND acceptance_utc % 5 <> 0 AND acceptance_utc % 7 <> 0) FROM filings""")
def ingest_counts(spark, sf_dir):
    """Landed rows of which some lack a key, a zone or a price; counts come from the writes themselves."""
    at = F.col("acceptance_utc")
    stamp = F.date_format(F.timestamp_seconds("acceptance_utc"), "yyyy-MM-dd'T'HH:mm:ss")
    raw = adapters.filings(spark, sf_dir).withColumn("acceptance", F.when(at % 5 == 0, stamp).otherwise(F.concat(stamp, F.lit("Z"))))
    raw = raw.withColumn("accession_no", F.when(at % 7 == 0, F.lit("")).otherwise(F.col("accession_no"))).withColumn("filing_date", F.lit("")).drop("acceptance_utc")
    good, told = ingest.counted_filings(raw, ("8-K",))
    stored(good)
    price = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 != 0, F.col("value"))
    ticks = adapters.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("ticker"), (F.floor(adapters.epoch("ts") / 3600) * 3600).alias("ts_utc"), F.col("event_id").alias("pos"), *(price.alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume"))
    bars, before, after = ingest.counted_bars(ticks, "1h")
    stored(bars)
    f, b, kept = told.get, before.get, after.get["kept"]
    rows = [("filings", f["read"], 0, f["other_form"] + f["no_key"] + f["no_time"], f["kept"]), ("bars", b["read"], b["read"] - b["no_price"] - kept, b["no_price"], kept)]
    return spark.createDataFrame(rows, "dataset string, read long, repeated long, rejected long, kept long")


@query(f"""WITH a AS (SELECT c.exchange, c.ticker, count(f.accession_no) AS n FROM companies c LEFT JOIN filings f ON f.ticker = c.ticker AND acceptance_utc < {LOW} GROUP BY 1, 2)
SELECT exchange AS run, count(*) AS attempted, count(*) FILTER (ticker::INT % 2 = 0 AND n = 0) AS known_empty, count(*) FILTER (n > 0) AS with_records,
  count(*) > count(*) FILTER (ticker::INT % 2 = 0 AND n = 0) AND count(*) FILTER (n > 0) = 0 AS failed FROM a GROUP BY 1""")
def run_guards(spark, sf_dir):
    """A run for each exchange that asks for early filings; even tickers are known to have none."""
    companies = adapters.companies(spark, sf_dir)
    early = adapters.filings(spark, sf_dir).where(F.col("acceptance_utc") < LOW).groupBy("ticker").agg(F.count("*").alias("records"))
    attempts = stored(companies.join(early, "ticker", "left").select("exchange", F.col("ticker").alias("key"), "records"))
    out = None
    for exchange in ("Nasdaq", "NYSE", "OTC"):
        of = attempts.where(F.col("exchange") == exchange)
        told = sinks.run_guard(of, of.where(F.col("key").cast("int") % 2 == 0)).withColumn("run", F.lit(exchange))
        out = told if out is None else out.unionByName(told)
    return out


@query(f"""WITH keep AS (SELECT DISTINCT ticker FROM companies WHERE exchange = 'NYSE'), newest AS (SELECT max(ts_utc) AS tm FROM bars),
t AS (SELECT 'bars' AS "table", ts_utc AS tm FROM bars SEMI JOIN keep USING (ticker) WHERE ts_utc >= (SELECT tm FROM newest) - 5 * 86400
  UNION ALL SELECT 'filings', acceptance_utc FROM filings SEMI JOIN keep USING (ticker) WHERE acceptance_utc >= (SELECT tm FROM newest) - 7 * 86400
  UNION ALL SELECT 'news', published_utc FROM news SEMI JOIN keep USING (ticker) WHERE published_utc >= (SELECT tm FROM newest) - 5 * 86400
  UNION ALL SELECT 'events', t0_utc FROM labelled SEMI JOIN keep USING (ticker) WHERE t0_utc >= (SELECT tm FROM newest) - 7 * 86400
  UNION ALL SELECT 'companies', NULL FROM companies SEMI JOIN keep USING (ticker)
  UNION ALL SELECT 'sessions', NULL FROM sessions)
SELECT "table", count(*) AS rows, min(tm) AS first_utc, max(tm) AS last_utc FROM t GROUP BY 1""")
def snapshot_manifest(spark, sf_dir):
    keep = adapters.companies(spark, sf_dir).where("exchange = 'NYSE'").select("ticker")
    bars = adapters.hourly_bars(spark, sf_dir)
    tables = {"bars": bars, "filings": adapters.filings(spark, sf_dir), "news": adapters.news(spark, sf_dir), "events": frames.labelled(spark, sf_dir), "companies": adapters.companies(spark, sf_dir), "sessions": adapters.sessions(spark)}
    newest = bars.agg(F.max("ts_utc")).first()[0]
    days = {"bars": 5, "filings": 7, "news": 5, "events": 7}
    ts = {"bars": "ts_utc", "filings": "acceptance_utc", "news": "published_utc", "events": "t0_utc"}
    return sinks.write_snapshot(tables, keep, newest, days, f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}", ts)


@query(f"""WITH h AS (SELECT tm AS at_utc, bool_or(k % 2 = 0) AS sealed FROM ev WHERE event_type = 'error' AND user_id % 5 = 0 GROUP BY 1)
SELECT accession_no, coalesce((SELECT arg_max(sealed, at_utc) FROM h WHERE at_utc <= acceptance_utc), true) AS sealed,
  coalesce((SELECT arg_max(sealed, at_utc) FROM h WHERE at_utc <= acceptance_utc), true) AND acceptance_utc >= {TRAIN_END} AND acceptance_utc < {HIGH} AS refused FROM filings""")
def seal_states(spark, sf_dir):
    """The seal is put on and taken off by some events; for each filing, whether it was on and refuses it."""
    turns = adapters.read(spark, sf_dir, "events").where("event_type = 'error' AND user_id % 5 = 0")
    even = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    history = turns.select(adapters.epoch("ts").alias("at_utc"), even.alias("sealed"), F.concat(F.lit("event "), "event_id").alias("reason"))
    told = seal.states(adapters.filings(spark, sf_dir), "acceptance_utc", history)
    inside = (F.col("acceptance_utc") >= TRAIN_END) & (F.col("acceptance_utc") < HIGH)
    return told.select("accession_no", "sealed", (F.col("sealed") & inside).alias("refused"))


FEATURES = ["volume_z", "volatility", "ret_1h", "days_since_last_8k", "hours_to_close", "news_count_24h"]


@query(TILES.rsplit("SELECT ticker, ts_utc AS anchor_utc FROM walk", 1)[0] + f""", tile AS (SELECT ticker, ts_utc AS anchor_utc FROM walk WHERE anchor AND ts_utc >= {LOW} AND ts_utc < {TRAIN_END}), p AS (SELECT * FROM labelled WHERE t0_utc < {TRAIN_END}),
a AS (SELECT 'event:' || event_id AS window_id, ticker, t0_utc AS anchor_utc, t0_utc, is_scheduled, items AS item_code, 1 AS label, 0 AS depth FROM p
  UNION ALL SELECT 'quiet:' || ticker || ':' || anchor_utc, ticker, anchor_utc, NULL, NULL, NULL, 0, 1 + (r - 1) // (SELECT count(*) FROM p) FROM (
  SELECT *, row_number() OVER (ORDER BY md5(ticker || '|' || anchor_utc || '|42'), ticker, anchor_utc) AS r FROM tile) WHERE r <= 3 * (SELECT count(*) FROM p))
SELECT window_id, a.ticker, m.ts_utc, t0_utc, is_scheduled, item_code, label, depth::BIGINT AS depth, {", ".join(FEATURES)}
FROM a JOIN matrix m ON m.ticker = a.ticker AND m.ts_utc < a.anchor_utc QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY m.ts_utc DESC) <= 8""")
def training_matrix(spark, sf_dir):
    """Windows before events and three quiet ones for each, with features; ``depth`` tells the ratio at which a
    quiet one is drawn."""
    quiet = sampling.anchors(quiet_frame(spark, sf_dir), 3, 5)
    anchors, _ = evaluation.training_anchors(frames.labelled(spark, sf_dir), quiet, LOW, TRAIN_END, SMALL.sample_ratio, SMALL.seed)
    out = evaluation.training_matrix(stored(matrix(spark, sf_dir)), anchors, FEATURES, SMALL.horizon_bars)
    return rounded(out, "volume_z", "volatility", "ret_1h")


@query(TILES.rsplit("SELECT ticker, ts_utc AS anchor_utc FROM walk", 1)[0] + f""", tile AS (SELECT ticker, ts_utc FROM walk WHERE anchor AND ts_utc >= {LOW} AND ts_utc < {TRAIN_END})
SELECT ratio, ratio * n AS wanted, greatest(0, ratio * n - have) AS lacking FROM (SELECT count(*) AS n FROM labelled WHERE t0_utc < {TRAIN_END}), (SELECT count(*) AS have FROM tile), (VALUES (1), (3), (50)) v(ratio)""")
def training_shortfall(spark, sf_dir):
    """What three ratios want of quiet windows and how many lack."""
    events, quiet = stored(frames.labelled(spark, sf_dir)), stored(sampling.anchors(quiet_frame(spark, sf_dir), 3, 5))
    out = None
    for ratio in (1, 3, 50):
        _, short = evaluation.training_anchors(events, quiet, LOW, TRAIN_END, ratio, SMALL.seed)
        short = short.withColumn("ratio", F.lit(ratio))
        out = short if out is None else out.unionByName(short)
    return out


CUTS = [LOW + k * 4 * DAY for k in range(1, 6)]


@query(f"""WITH n AS (SELECT ticker, ts_utc, lead(ts_utc) OVER (PARTITION BY ticker ORDER BY ts_utc) AS next_ts, lead(close) OVER (PARTITION BY ticker ORDER BY ts_utc) AS next_close FROM bars)
SELECT cut::BIGINT AS cut, 'ahead' AS feature, count(*) AS n FROM n, (VALUES {", ".join(f"({c})" for c in CUTS)}) v(cut) WHERE ts_utc <= cut AND next_ts > cut AND next_close <> 0 GROUP BY 1""")
def lookahead_found(spark, sf_dir):
    """Five cuts in one plan, over the price features and one that was planted to look a bar ahead."""

    def made(bars):
        by_ticker = features.of_ticker()
        return features.price_features(bars, SMALL).withColumn("ahead", F.lead("close").over(by_ticker))

    return features.lookaheads(made, adapters.hourly_bars(spark, sf_dir), CUTS, ["ret_1h", "ret_4h", "volume_z", "volatility", "ahead"])


@query(f"""WITH m AS (SELECT DISTINCT ticker FROM companies WHERE exchange <> 'OTC'), c AS (SELECT accession_no, 'no_price_coverage:' || outcome AS outcome FROM audit WHERE outcome <> 'ok')
SELECT accession_no, CASE WHEN items <> '9.01' THEN contains(items, '2.02') END AS is_scheduled, CASE WHEN acceptance_utc < {LOW} OR acceptance_utc >= {HIGH} THEN 'outside_study_window' WHEN m.ticker IS NULL THEN 'not_in_universe'
  WHEN items = '9.01' THEN 'only_excluded_items' WHEN c.outcome IS NOT NULL THEN c.outcome END AS exclude_reason FROM filings f LEFT JOIN m ON m.ticker = f.ticker LEFT JOIN c USING (accession_no)""")
def filter_cascade(spark, sf_dir):
    """Scope, items, then coverage; that some are left is checked."""
    bad = reports.coverage_exclusions(audited(spark, sf_dir))
    members = adapters.companies(spark, sf_dir).where("exchange <> 'OTC'")
    out = reports.cascade(adapters.filings(spark, sf_dir), members, bad, LOW, HIGH - 1, SMALL.excluded_items, SMALL.scheduled_items)
    return reports.surviving(stored(out.select("accession_no", "is_scheduled", "exclude_reason")))


@query("""WITH r AS (SELECT ticker, adv_usd FROM reasons WHERE reason IS NULL ORDER BY adv_usd DESC, ticker LIMIT 60)
SELECT c.cik, c.ticker, (r.ticker IS NOT NULL)::INT AS in_universe, round(r.adv_usd, 6) AS adv_usd FROM companies c LEFT JOIN r ON r.ticker = c.ticker""")
def universe_applied(spark, sf_dir):
    """The choice written back to all companies."""
    companies = adapters.companies(spark, sf_dir)
    rows = universe.candidates(companies, adapters.hourly_bars(spark, sf_dir), adapters.filings(spark, sf_dir), HIGH, SMALL)
    out = universe.applied(companies, rounded(universe.classify(rows, HIGH, SMALL), "adv_usd"), HIGH, SMALL)
    return rounded(out.select("cik", "ticker", "in_universe", "adv_usd"), "adv_usd")


@query(f"SELECT ticker, greatest(CASE WHEN ticker::INT % 2 = 0 THEN {LOW} ELSE 1640995200 END, {HIGH} - 729 * 86400)::BIGINT AS start_utc FROM companies")
def clamped_ranges(spark, sf_dir):
    """Hourly bars are kept for 729 days: starts before that are moved, absent ones get the default."""
    even = F.col("ticker").cast("int") % 2 == 0
    wanted = adapters.companies(spark, sf_dir).select("ticker", F.when(~even, F.lit(1_640_995_200)).cast("long").alias("start_utc"))
    return ingest.clamped(wanted, HIGH, "1h", LOW)


@query("""SELECT stem, count(DISTINCT cik) AS ciks, count(DISTINCT name) AS names FROM (
  SELECT cik, name, regexp_replace(regexp_replace(lower(name), '(company|inc|corp)', '', 'g'), '[^a-z0-9]', '', 'g') AS stem FROM companies) GROUP BY 1""")
def register_groups(spark, sf_dir):
    """The register as a text file in latin-1, read back and grouped by stem."""
    path = f"{shared_dir(spark)}/register-{uuid.uuid4().hex}"
    lines = adapters.companies(spark, sf_dir).select(F.concat(F.upper("name"), F.lit(":"), "cik", F.lit(":")).alias("value"))
    lines.write.option("encoding", "ISO-8859-1").text(path)
    rows = ingest.register_rows(scans.register_lines(spark, path))
    return rows.groupBy("stem").agg(F.count_distinct("cik").alias("ciks"), F.count_distinct("name").alias("names"))
