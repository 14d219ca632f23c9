"""Pieces of DuckDB SQL that several oracles share: the bars of the table events, their features and labels."""

from __future__ import annotations

SECONDS = 3600

TICKS = """
steps AS (
  SELECT ts, event_id, CAST(CASE WHEN event_type IN ('signup', 'purchase') THEN value WHEN event_type IN ('view', 'error') THEN -value ELSE 0 END AS DECIMAL(12,2)) AS step FROM events),
ticks AS (SELECT ts, event_id, time_bucket(INTERVAL '1 hour', ts) AS opened_at, 20000.00 + sum(step) OVER (ORDER BY ts, event_id) AS px FROM steps)"""

BARS = f"""{TICKS},
grouped AS (
  SELECT opened_at, arg_min(px, (ts, event_id)) AS o, max(px) AS h, min(px) AS l, arg_max(px, (ts, event_id)) AS c, count(*) AS v FROM ticks GROUP BY opened_at),
bars AS (
  SELECT opened_at, opened_at + INTERVAL '1 hour' AS closed_at, CAST(o AS DOUBLE) AS open, CAST(h AS DOUBLE) AS high, CAST(l AS DOUBLE) AS low, CAST(c AS DOUBLE) AS close, CAST(v AS DOUBLE) AS volume, row_number() OVER (ORDER BY opened_at) - 1 AS idx FROM grouped)"""

STAMP = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def stamp(column: str) -> str:
    return STAMP.format(column)


def rounded(expression: str, digits: int = 6) -> str:
    """As in the queries: rounded, and no negative zero."""
    return f"round({expression}, {digits}) + 0.0"


def _ema(n: int) -> str:
    """Weights of the last n closes: (1-a)^(n-1) for the first, a(1-a)^k for the one k bars back."""
    a = 2 / (n + 1)
    terms = [f"{a * (1 - a) ** k!r} * lag(close, {k}) OVER w" for k in range(n - 1)]
    return " + ".join([*terms, f"{(1 - a) ** (n - 1)!r} * lag(close, {n - 1}) OVER w"])


FEATURE_SQL = {
    **{f"return_{k}": f"close / lag(close, {k}) OVER w - 1" for k in (1, 3, 12, 24, 48)},
    **{f"volatility_{n}": f"stddev_pop(change) OVER (ORDER BY idx ROWS {n - 1} PRECEDING)" for n in (12, 48)},
    "range_1": "(high - low) / close",
    "relative_volume_24": "volume / avg(volume) OVER (ORDER BY idx ROWS 23 PRECEDING)",
    **{f"ema_distance_{n}": f"close / ({_ema(n)}) - 1" for n in (12, 48)},
    "rsi_14": "CASE WHEN sum(abs(delta)) OVER r > 0 THEN sum(greatest(delta, 0)) OVER r / sum(abs(delta)) OVER r ELSE 0.5 END",
    "hour_sin": "sin(2 * pi() * (hour(closed_at) + minute(closed_at) / 60.0) / 24)",
    "hour_cos": "cos(2 * pi() * (hour(closed_at) + minute(closed_at) / 60.0) / 24)",
    "weekday_sin": "sin(2 * pi() * (isodow(closed_at) - 1) / 7)",
    "weekday_cos": "cos(2 * pi() * (isodow(closed_at) - 1) / 7)",
}

FEATURES = f"""{BARS},
moved AS (SELECT *, close - lag(close) OVER (ORDER BY idx) AS delta, close / lag(close) OVER (ORDER BY idx) - 1 AS change FROM bars),
looked AS (
  SELECT idx, opened_at, closed_at, close, {", ".join(f"{e} AS {n}" for n, e in FEATURE_SQL.items())}
  FROM moved WINDOW w AS (ORDER BY idx), r AS (ORDER BY idx ROWS 13 PRECEDING)),
features AS (SELECT * FROM looked WHERE idx >= 48)"""

LABEL_PARTS = """
touched AS (
  SELECT e.idx, b.idx - e.idx AS step, b.close / e.close - 1 AS at_close,
    CASE WHEN b.low <= e.close * (1 - 0.015) THEN -0.015 WHEN b.high >= e.close * (1 + 0.025) THEN 0.025 END AS touch
  FROM bars e JOIN bars b ON b.idx BETWEEN e.idx + 1 AND e.idx + 12 WHERE e.idx >= 48),
bracket AS (
  SELECT idx, CAST(coalesce(arg_min(touch, step) FILTER (touch IS NOT NULL), arg_max(at_close, step)) AS DOUBLE) AS forward_return FROM touched GROUP BY idx HAVING count(*) = 12),
labels AS (SELECT b.idx, b.opened_at, b.closed_at, b.close, k.forward_return, CAST(k.forward_return > 0.0024 AS INTEGER) AS label FROM bracket k JOIN bars b USING (idx))"""

LABELS = f"{BARS},{LABEL_PARTS}"

#: One fixed model as numbers that both sides read: score from three features.
MODEL_COLUMNS = ("return_12", "rsi_14", "ema_distance_48")
MODELS = (
    {"model_id": "m1", "means": (0.0, 0.5, 0.0), "scales": (0.02, 0.2, 0.02), "weights": (0.8, -0.5, 0.6), "intercept": -0.1, "buy_from": 0.52, "sell_to": 0.40},
    {"model_id": "m2", "means": (0.001, 0.45, 0.001), "scales": (0.03, 0.15, 0.03), "weights": (-0.4, 0.9, -0.3), "intercept": 0.05, "buy_from": 0.60, "sell_to": 0.38},
)


def _score(m: dict) -> str:
    z = " + ".join(f"(f.{c} - {a!r}) / {s!r} * {w!r}" for c, a, s, w in zip(MODEL_COLUMNS, m["means"], m["scales"], m["weights"], strict=True))
    return f"1 / (1 + exp(-({m['intercept']!r} + {z})))"


SCORED = f"""{FEATURES},
scores AS ({" UNION ALL ".join(f"SELECT '{m['model_id']}' AS model_id, f.*, {_score(m)} AS score, {m['buy_from']} AS buy_from, {m['sell_to']} AS sell_to FROM features f" for m in MODELS)}),
scored AS (SELECT *, CASE WHEN score >= buy_from THEN 'buy' WHEN score <= sell_to THEN 'sell' ELSE 'hold' END AS action FROM scores)"""


def greedy(source: str, tail: int, hold: int = 12) -> str:
    """CTE visited(model_id, idx, entered): a run over source(model_id, idx, action) that skips `hold` rows after a buy.

    Between two buys all rows are looked at, so the run needs only the next buy after each one.
    """
    return f"""
ends AS (SELECT model_id, max(idx) - {tail} AS stop, min(idx) AS start FROM {source} GROUP BY model_id),
buys AS (SELECT s.model_id, s.idx FROM {source} s JOIN ends e USING (model_id) WHERE s.action = 'buy' AND s.idx <= e.stop),
following AS (SELECT b.model_id, b.idx, (SELECT min(n.idx) FROM buys n WHERE n.model_id = b.model_id AND n.idx >= b.idx + {hold}) AS next FROM buys b),
chain AS (
  SELECT model_id, min(idx) AS idx FROM buys GROUP BY model_id
  UNION ALL SELECT f.model_id, f.next FROM chain c JOIN following f ON f.model_id = c.model_id AND f.idx = c.idx WHERE f.next IS NOT NULL),
visited AS (
  SELECT s.model_id, s.idx, EXISTS (SELECT 1 FROM chain c WHERE c.model_id = s.model_id AND c.idx = s.idx) AS entered
  FROM {source} s JOIN ends e USING (model_id)
  WHERE s.idx <= e.stop AND NOT EXISTS (SELECT 1 FROM chain c WHERE c.model_id = s.model_id AND s.idx > c.idx AND s.idx < c.idx + {hold}))"""
