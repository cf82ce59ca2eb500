"""Schemas of the tables, without inference."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "companies": "cik string, ticker string, name string, exchange string, sic string, in_universe int, adv_usd double, last_price double, universe_as_of long, successor_cik string",
    "filings": "accession_no string, cik string, ticker string, form string, items string, acceptance_utc long, filing_date_utc long, report_date_utc long, primary_doc string, fetched_utc long",
    "events": "event_id string, accession_no string, ticker string, items string, t0_filing_utc long, t0_news_utc long, t0_utc long, t0_source string, is_scheduled int, abs_return double, is_material int, usable int, exclude_reason string",
    "bars": "ticker string, ts_utc long, open double, high double, low double, close double, volume double, interval string",
    "news": "url string, ticker string, title string, source_domain string, source_name string, source_tier int, published_utc long, seen_utc long, fetched_utc long, api string",
    "meta": "key string, value string, updated_utc long",
    "fetch_state": "source string, key string, status string, records long, rows_written long, error string, updated_utc long",
    "alerts": "alert_id string, ts_utc long, raised_utc long, ticker string, detector string, score double, threshold double, features string, seq long, prev_sha string, row_sha string",
    "outcomes": "alert_id string, checked_utc long, filed int, accession_no string, item_code string, t0_utc long, lead_trading_h double",
    "predictions": "window_id string, ticker string, ts_utc long, t0_utc long, score double, action string, is_scheduled boolean, item_code string",
    "sessions": "date date, open_utc long, close_utc long",
    "posts": "id string, subreddit string, title string, selftext string, author string, created_utc long, score int, upvote_ratio double, num_comments int, flair string, url string, source string, fetched_utc long, score_6h int, score_24h int",
}
