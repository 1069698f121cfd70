"""DuckDB SQL that states what the queries compute, by direct definition."""

from __future__ import annotations

W, B, K, CAP, COOLDOWN, FRACTION, HOUR = 3, 48, 1.5, 4, 6, 0.8, 3600
GATE, RETAINED = int(B * FRACTION), W + B

TEXT = "concat(CASE WHEN event_type = 'error' THEN '!' ELSE '' END, event_type)"
MESSAGES = f"m AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms, {TEXT} AS text FROM events)"

COUNTS = f"""
c AS (SELECT event_type AS key, floor((epoch_us(ts) // 1000) / {HOUR * 1000}.0)::BIGINT AS second, count(*) AS n FROM events GROUP BY ALL),
l AS (SELECT *, lead(second) OVER (PARTITION BY key ORDER BY second) AS nx FROM c),
g AS (SELECT key, unnest(generate_series(second, least(coalesce(nx - 1, second + {RETAINED}), second + {RETAINED}))) AS tick, second, n FROM l),
grid AS (SELECT key, tick AS second, CASE WHEN tick = second THEN n ELSE 0 END AS n FROM g),
sums AS (SELECT key, second,
  (sum(n) OVER near)::BIGINT AS wc,
  coalesce(sum(n) OVER far, 0)::BIGINT AS s1,
  coalesce(sum(n * n) OVER far, 0)::BIGINT AS s2,
  coalesce(second - {W - 1} - min(CASE WHEN n > 0 THEN second END) OVER far, 0)::BIGINT AS observed
  FROM grid WINDOW near AS (PARTITION BY key ORDER BY second RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW), far AS (PARTITION BY key ORDER BY
second RANGE BETWEEN {W + B - 1} PRECEDING AND {W} PRECEDING)),
judged AS (SELECT *, CASE WHEN observed < {GATE} THEN 'warmup' WHEN {B} * s2 - s1 * s1 <= 0 THEN 'flat' ELSE 'ok' END AS status FROM sums),
measured AS (SELECT key, second, observed, status, CASE WHEN status = 'ok' THEN wc END AS window_count, CASE WHEN status = 'ok' THEN s1 /
{B}.0::DOUBLE END AS mean, CASE WHEN status = 'ok' THEN sqrt(({B} * s2 - s1 * s1) / {B * (B - 1)}.0::DOUBLE) END AS std FROM judged),
readings AS (SELECT *, (window_count / {W}.0::DOUBLE - mean) / std AS intensity FROM measured)"""


def settings(k=(K,), cap=(CAP,), cooldown=(COOLDOWN,), gate=(0,)) -> str:
    rows = ", ".join(f"({a}::DOUBLE, {b}, {c}, {d})" for a in k for b in cap for c in cooldown for d in gate)
    return f"settings(k, cap, cooldown, gate) AS (VALUES {rows})"


def episodes(**lists) -> str:
    """CTEs up to `episodes`, one step of the recursion for each edge row of a key and setting."""
    return f"""{COUNTS},
{settings(**lists)},
marked AS (SELECT k, cap, cooldown, gate, r.*, r.intensity >= k AS high FROM readings r, settings WHERE r.intensity IS NOT NULL AND r.observed >= gate),
was AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY k, cap, cooldown, gate, key ORDER BY second), false) AS before FROM marked),
edges AS (SELECT *, row_number() OVER (PARTITION BY k, cap, cooldown, gate, key ORDER BY second) AS rn FROM was WHERE high OR before),
st(k, cap, cooldown, gate, key, rn, alive, h_start, h_smean, h_sstd, h_at, h_x, h_n, h_mean, h_std, last_fire, fired, fired_at, capped) AS (
  SELECT DISTINCT k, cap, cooldown, gate, key, 0::BIGINT, false, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::DOUBLE, NULL::BIGINT,
NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, false, NULL::BIGINT, false FROM edges
  UNION ALL
  SELECT k, cap, cooldown, gate, key, rn, holding AND NOT on_cap, start2, smean2, sstd2, at2, x2, n2, mean2, std2, CASE WHEN on_cap OR on_low THEN
second ELSE last_fire END, on_cap OR on_low, second, on_cap
  FROM (SELECT *, holding AND second - start2 >= cap AS on_cap, live AND NOT high AS on_low FROM (
    SELECT *, high AND (live OR opens) AS holding,
      CASE WHEN live THEN h_start WHEN opens THEN second END AS start2, CASE WHEN live THEN h_smean WHEN opens THEN mean END AS smean2, CASE WHEN live
THEN h_sstd WHEN opens THEN std END AS sstd2,
      CASE WHEN live AND NOT (high AND intensity > h_x) THEN h_at ELSE second END AS at2, CASE WHEN live AND NOT (high AND intensity > h_x) THEN h_x ELSE intensity END AS x2,
      CASE WHEN live AND NOT (high AND intensity > h_x) THEN h_n ELSE window_count END AS n2, CASE WHEN live AND NOT (high AND intensity > h_x) THEN
h_mean ELSE mean END AS mean2, CASE WHEN live AND NOT (high AND intensity > h_x) THEN h_std ELSE std END AS std2
    FROM (SELECT *, NOT live AND high AND (last_fire IS NULL OR second - last_fire > cooldown) AS opens FROM (
      SELECT e.*, s.h_start, s.h_smean, s.h_sstd, s.h_at, s.h_x, s.h_n, s.h_mean, s.h_std, s.last_fire, s.alive AND e.second - s.h_at <= e.cap AS live
      FROM st s JOIN edges e ON e.k = s.k AND e.cap = s.cap AND e.cooldown = s.cooldown AND e.gate = s.gate AND e.key = s.key AND e.rn = s.rn + 1)))) AS z),
episodes AS (SELECT k, cap, cooldown, gate, key, h_start AS started_at, fired_at, h_at AS peak_at, h_x AS peak_intensity, h_n AS peak_count, h_mean AS
peak_mean, h_std AS peak_std, h_smean AS start_mean, h_sstd AS start_std, capped FROM st WHERE fired)"""


RUNS = f"""
runs AS (SELECT key, min(second) AS start, max(second) AS "end", max(intensity) AS peak FROM (SELECT *, second - row_number() OVER (PARTITION BY key
ORDER BY second) AS run FROM readings WHERE intensity >= {K}) GROUP BY key, run)"""
