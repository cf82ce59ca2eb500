"""The adapter views, and frames built on them, as SQL for DuckDB: the other half of each check.

Parameters are those of ``config.SMALL``.
"""

from __future__ import annotations

import re

LOW, HIGH = 1704240000, 1706486400  # 2024-01-03 and 2024-01-29

VIEWS: dict[str, str] = {
    "ev": "SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS tm, (props->>'$.k')::INT AS k FROM events",
    "bars": """SELECT user_id::VARCHAR AS ticker, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS ts_utc, arg_min(value, ts) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 2) AS volume FROM events GROUP BY 1, 2""",
    "market": "SELECT ts_utc, sum(round(open * 100)::BIGINT) / (100.0::DOUBLE * count(*)) AS open, sum(round(close * 100)::BIGINT) / (100.0::DOUBLE * count(*)) AS close FROM bars GROUP BY 1",
    "filings": """SELECT printf('%010d-24-%06d', user_id, event_id) AS accession_no, lpad(user_id::VARCHAR, 10, '0') AS cik, user_id::VARCHAR AS ticker,
  CASE WHEN k % 5 = 0 THEN '8-K/A' ELSE '8-K' END AS form, CASE k % 4 WHEN 0 THEN '2.02,9.01' WHEN 1 THEN '8.01' WHEN 2 THEN '9.01' ELSE '1.01,8.01' END AS items,
  tm AS acceptance_utc FROM ev WHERE event_type = 'purchase'""",
    "news": """SELECT 'https://www.pub' || (k % 7) || '.com/' || event_id AS url, user_id::VARCHAR AS ticker, 'story ' || event_id AS title, 'pub' || (k % 7) || '.com' AS source_domain,
  'pub' || (k % 7) AS publisher, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS source_tier, tm AS published_utc FROM ev WHERE event_type IN ('click', 'view')""",
    "companies": """SELECT DISTINCT lpad(user_id::VARCHAR, 10, '0') AS cik, user_id::VARCHAR AS ticker, 'Company ' || user_id || CASE WHEN user_id % 2 = 0 THEN ' Inc.' ELSE ' Corp' END AS name,
  CASE user_id % 3 WHEN 0 THEN 'Nasdaq' WHEN 1 THEN 'NYSE' ELSE 'OTC' END AS exchange, (user_id % 10)::VARCHAR AS sic FROM events""",
    "sessions": """SELECT d::DATE AS date, epoch(d)::BIGINT + 52200 AS open_utc, epoch(d)::BIGINT + CASE WHEN d::DATE = DATE '2024-01-24' THEN 64800 ELSE 75600 END AS close_utc
  FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-29', INTERVAL 1 DAY)) AS d)
  WHERE isodow(d) < 6 AND d::DATE NOT IN (DATE '2024-01-01', DATE '2024-01-15')""",
    "z": """SELECT ticker, ts_utc, open, close, volume, CASE WHEN n >= 8 AND sd > 0 THEN (volume - m) / sd END AS volume_z FROM (
  SELECT *, avg(volume) OVER w AS m, stddev_samp(volume) OVER w AS sd, count(volume) OVER w AS n FROM bars
  WINDOW w AS (PARTITION BY ticker ORDER BY ts_utc ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))""",
    "labelled": f"""SELECT replace(accession_no, '-', '') AS event_id, accession_no, ticker, items, acceptance_utc AS t0_utc, contains(items, '2.02') AS is_scheduled
  FROM filings WHERE items <> '9.01' AND acceptance_utc >= {LOW} AND acceptance_utc < {HIGH}""",
    "pos": """SELECT 'event:' || event_id AS window_id, z.ticker, z.ts_utc, t0_utc, is_scheduled, items AS item_code, volume_z
  FROM labelled l JOIN z ON l.ticker = z.ticker AND z.ts_utc < t0_utc QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY z.ts_utc DESC) <= 8""",
    "frame": f"""SELECT * FROM pos UNION ALL SELECT 'bar:' || ticker || ':' || ts_utc, ticker, ts_utc, NULL, NULL, NULL, volume_z FROM z
  WHERE ts_utc >= {LOW} AND ts_utc < {HIGH} AND NOT EXISTS (SELECT 1 FROM pos p WHERE p.ticker = z.ticker AND p.ts_utc = z.ts_utc)""",
    "scored": "SELECT * EXCLUDE (volume_z), coalesce(volume_z, min(volume_z) OVER () - 1) AS score FROM frame",
    "pred": """SELECT *, CASE WHEN ts_utc = min(CASE WHEN score >= 1.5 THEN ts_utc END) OVER (PARTITION BY window_id) THEN 'FLAG' ELSE 'WAIT' END AS action FROM scored""",
    "summary": """SELECT window_id, min(ticker) AS ticker, bool_or(t0_utc IS NOT NULL) AS is_positive, CASE WHEN bool_or(t0_utc IS NOT NULL) THEN arg_max(score, ts_utc) ELSE max(score) END AS peak,
  bool_or(is_scheduled) AS is_scheduled, max(item_code) AS item_code FROM pred GROUP BY 1""",
    "alerts": """SELECT sha256('volume_z|' || ticker || '|' || ts_utc)[1:24] AS alert_id, 'volume_z' AS detector, ticker, ts_utc, max(round(score, 6)) AS score, 1.5::DOUBLE AS threshold
  FROM pred WHERE action = 'FLAG' GROUP BY ticker, ts_utc""",
    "edge": "SELECT max(acceptance_utc) - 86400 AS edge FROM filings",
    "outcome": """SELECT a.alert_id, (f.accession_no IS NOT NULL)::INT AS filed, f.accession_no, f.items AS item_code, f.acceptance_utc AS t0_utc
  FROM alerts a CROSS JOIN edge LEFT JOIN filings f ON f.ticker = a.ticker AND f.acceptance_utc > a.ts_utc AND f.acceptance_utc <= a.ts_utc + 172800
  WHERE a.ts_utc + 172800 <= edge QUALIFY row_number() OVER (PARTITION BY a.alert_id ORDER BY f.acceptance_utc, f.accession_no) = 1""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views that it and they read, in order."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                add(body)
                needed.append(name)

    add(sql)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in dict.fromkeys(needed))
    if not views:
        return sql
    body = sql.strip()
    recursive = body.startswith("WITH RECURSIVE ")
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.startswith(head):
        return f"{head}{views},\n{body[len(head):]}"
    return f"WITH {views}\n{body}"
