"""DuckDB SQL for the thirteen looming variants and their parts."""

from __future__ import annotations

from ..sources.driver import TRACKS_SQL

_QUANTILES = "quantile_cont(ttc, 0.10) AS q10, quantile_cont(ttc, 0.25) AS q25, quantile_cont(ttc, 0.50) AS q50, quantile_cont(ttc, 0.75) AS q75, quantile_cont(ttc, 0.90) AS q90"

SAMPLES = """samples AS (SELECT seq, label_id AS start, ts AS query_t,
  CASE WHEN count(*) OVER (PARTITION BY seq) > 1 THEN (row_number() OVER (PARTITION BY seq ORDER BY label_id) - 1)::DOUBLE / (count(*) OVER (PARTITION BY seq) - 1) END AS frac FROM tracks)"""

COLLAPSED = """collapsed AS (SELECT seq, label_id AS start, count(area) OVER b >= 3 AND coalesce(area / quantile_cont(area, 0.5) OVER b < 0.2, false) AS cur
  FROM tracks WINDOW b AS (PARTITION BY seq ORDER BY label_id RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


def histories(back: int, current_guard: bool) -> str:
    guard = "c.cur" if current_guard else "false"
    return f"""{TRACKS_SQL}, {SAMPLES}, {COLLAPSED},
band AS (SELECT s.seq, s.start, s.query_t, {guard} AS cur_guard, t.label_id, t.ts, t.w, t.h, t.area FROM samples s JOIN collapsed c ON c.seq = s.seq AND c.start = s.start
  JOIN tracks t ON t.seq = s.seq AND t.label_id BETWEEN s.start - {back} AND s.start AND (NOT {guard} OR t.label_id < s.start)),
hist AS (SELECT *, coalesce(len(l) > 0 AND len(r) > 0 AND area / list_aggregate(list_concat(l, r), 'median') < 0.2, false) AS dropped,
    area / quantile_cont(area, 0.5) OVER (PARTITION BY seq, start ORDER BY label_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ratio FROM (
  SELECT *, coalesce(list(area) OVER (PARTITION BY seq, start ORDER BY label_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS l,
    coalesce(list(area) OVER (PARTITION BY seq, start ORDER BY label_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS r FROM band))"""


def candidates(v, sources: tuple[int, ...]) -> str:
    cues = ["w", "h", "sqrt(w * w + h * h)", "sqrt(greatest(area, 1e-6))", "h / 2"]
    used = [0, 1, 2, 3, 4] if v.bottom else [0, 1, 2, 3]
    backs = f"unnest(range(2, {v.back} + 1))" if v.mode == "multi" else str(v.back)
    fits = ", ".join(f"regr_slope({cues[i]}, ts) AS s{i}, regr_intercept({cues[i]}, ts) AS i{i}" for i in used)
    src = "CASE WHEN dropped THEN [0] ELSE [0, 1] END" if 1 in sources else "[0]"
    rows = f"(SELECT h.*, {backs} AS back FROM hist h)"
    one = " UNION ALL ".join(f"SELECT seq, start, src, back, fit_points, {i} AS ord, s{i} AS slope, s{i} * query_t + i{i} AS ref FROM fits" for i in used)
    return f"""fits AS (SELECT seq, start, query_t, src, back, count(*) AS fit_points, {fits} FROM (
  SELECT *, unnest({src}) AS src FROM {rows} WHERE label_id >= start - back) GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2),
cands AS (SELECT *, ref / slope AS ttc FROM ({one}) WHERE slope > 1 AND ref > 3 AND ref / slope BETWEEN 0.05 AND {v.max_ttc})"""


STATS = f"""stats AS (SELECT *, (q75 - q25) / greatest(abs(q50), 1e-6) AS iqr, (q90 - q10) / greatest(abs(q50), 1e-6) AS spread FROM (
  SELECT seq, start, src, count(*) AS n, max(fit_points) AS max_fit, min(ttc) AS low, {_QUANTILES} FROM cands GROUP BY 1, 2, 3))"""


def selected(v, selector: str) -> str:
    """WITH ... selected: status, ttc and the selected fit of every sample."""
    cues = "[w, h, sqrt(w * w + h * h), sqrt(greatest(area, 1e-6)), h / 2]"
    rank = {"width": "0", "lowest_residual": "round(residual, 12)", "highest_rel_slope": "round(-rel_slope, 12)", "score_rel_slope_over_resid": "round(-rel_slope / greatest(residual, 1e-4), 6)"}[selector]
    only, none = ("WHERE ord = 0", "BBOX_WIDTH_UNAVAILABLE") if selector == "width" else ("", "BBOX_FIT_FAIL")
    return f"""WITH {histories(v.back, False)}, {candidates(v, (0,))},
base AS (SELECT seq, start, count(*) AS n_rows FROM hist GROUP BY 1, 2),
judged AS (SELECT c.seq, c.start, ord, any_value(fit_points) AS fit_points, any_value(slope) AS slope, any_value(ref) AS ref, any_value(ttc) AS ttc, any_value(slope) / greatest(abs(any_value(ref)), 1e-6) AS rel_slope,
  sqrt(avg(({cues}[ord + 1] - ref - slope * (ts - query_t)) ** 2)) / greatest(abs(any_value(ref)), 1e-6) AS residual FROM cands c JOIN hist h ON h.seq = c.seq AND h.start = c.start GROUP BY 1, 2, 3),
had AS (SELECT DISTINCT seq, start FROM cands),
best AS (SELECT * FROM judged {only} QUALIFY row_number() OVER (PARTITION BY seq, start ORDER BY {rank}, ord) = 1),
selected AS (SELECT s.seq, s.start, CASE WHEN coalesce(n_rows, 0) < 2 THEN 'BBOX_HISTORY_TOO_SHORT' WHEN had.seq IS NULL THEN 'BBOX_FIT_FAIL' WHEN ttc IS NULL THEN '{none}'
  ELSE 'OK_BBOX_' || upper(['width', 'height', 'diag', 'sqrt_area', 'bottom_offset'][ord + 1]) END AS status, ttc, fit_points, slope, ref, residual, rel_slope
FROM samples s LEFT JOIN base b ON b.seq = s.seq AND b.start = s.start LEFT JOIN had ON had.seq = s.seq AND had.start = s.start LEFT JOIN best x ON x.seq = s.seq AND x.start = s.start)"""


def estimate(v, extra: tuple[str, ...] = ()) -> str:
    """seq, start, status, ttc of a variant, and extra columns that its gates read (not rounded)."""
    if v.mode != "multi":
        return f"""{selected(v, "width" if v.mode == "width" else "highest_rel_slope")} SELECT seq, start, status, round(ttc, 5) AS ttc FROM selected"""
    guard = v.history_guard
    used = "false"
    if guard == "always":
        used = "n_kept < n_rows"
    elif guard:
        used = "coalesce((a.n < 30 OR a.max_fit < 6 OR a.iqr > 0.7) AND n_kept < n_rows AND g.n IS NOT NULL, false)"
    names = "n max_fit low q10 q25 q50 q75 q90 iqr spread".split()
    picked = ", ".join(f"CASE WHEN {used} THEN g.{c} ELSE a.{c} END AS {c}" for c in names)
    near = "q25 / low"
    if not v.gate:
        gate = "NULL"
    elif v.gate == "adaptive_v2":
        gate = f"""CASE WHEN n < 30 AND low <= 0.5 AND {near} <= 3 THEN 'CANDIDATES|_LOWCANDSPIKE|75' WHEN n < 30 THEN 'CANDIDATES|_LOWCAND|25' WHEN max_fit < 6 THEN 'FIT_POINTS|_LOWFIT|50'
      WHEN iqr > 0.7 AND low <= 0.4 AND {near} >= 5 THEN 'DISPERSION|_DISPSHORT|25' WHEN iqr > 0.7 THEN 'DISPERSION|_DISP|50' END"""
    else:
        gate = "CASE WHEN n < 30 THEN 'CANDIDATES|_LOWCAND|25' WHEN max_fit < 6 THEN 'FIT_POINTS|_LOWFIT|50' WHEN iqr > 0.7 THEN 'DISPERSION|_DISP|50' END"
    phase = "NULL"
    if v.phases:
        more = "WHEN frac <= 0.5 AND ratio >= 1.1 AND iqr >= 0.3 THEN '_PHASEGROWTH|50' WHEN frac >= 0.2 AND ratio <= 1.05 AND iqr <= 0.55 THEN '_PHASESTABLE|10'" if v.phases > 1 else ""
        phase = f"CASE WHEN gate IS NOT NULL OR cur_guard OR hist_guard THEN NULL WHEN frac <= 0.35 AND iqr >= 0.4 AND spread >= 0.8 THEN '_PHASEEARLY|50' {more} WHEN frac >= 0.5 AND ratio IS NOT NULL AND iqr <= 0.35 THEN '_PHASELATE|10' END"
    always = "WHEN n_kept < 2 THEN 'BBOX_HISTORY_COLLAPSE_GUARD_NO_HISTORY'" if guard == "always" else ""
    rejected = f"WHEN gate IS NOT NULL THEN 'BBOX_LOW_QUALITY_' || split_part(gate, '|', 1) || '{'_REJECTED' if v.reject else ''}'" if v.reject or v.gate == "reject" else ""
    return f"""WITH {histories(v.back, v.current_guard)}, {candidates(v, (0, 1) if guard else (0,))}, {STATS},
base AS (SELECT seq, start, bool_or(cur_guard) AS cur_guard, count(*) AS n_rows, count(*) FILTER (NOT dropped) AS n_kept, max(CASE WHEN label_id = start THEN ratio END) AS ratio FROM hist GROUP BY 1, 2),
picked AS (SELECT s.seq, s.start, s.frac, coalesce(b.cur_guard, false) AS cur_guard, coalesce(n_rows, 0) AS n_rows, coalesce(n_kept, 0) AS n_kept, ratio, {used} AS hist_guard, {picked}
  FROM samples s LEFT JOIN base b ON b.seq = s.seq AND b.start = s.start LEFT JOIN stats a ON a.seq = s.seq AND a.start = s.start AND a.src = 0 LEFT JOIN stats g ON g.seq = s.seq AND g.start = s.start AND g.src = 1),
gated AS (SELECT *, {gate} AS gate FROM picked), phased AS (SELECT *, {phase} AS phase FROM gated),
chosen AS (SELECT *, coalesce(CAST(split_part(gate, '|', 3) AS INTEGER), CAST(split_part(phase, '|', 2) AS INTEGER), 25) AS pick,
  coalesce(split_part(gate, '|', 2), split_part(phase, '|', 1), '') || CASE WHEN cur_guard THEN '_CURGUARD' ELSE '' END || CASE WHEN hist_guard THEN '_HISTGUARD' ELSE '' END AS suffix FROM phased),
named AS (SELECT *, CASE WHEN n_rows < 2 THEN CASE WHEN cur_guard THEN 'BBOX_CURRENT_COLLAPSE_GUARD_NO_HISTORY' ELSE 'BBOX_HISTORY_TOO_SHORT' END {always} WHEN n IS NULL THEN 'BBOX_FIT_FAIL' {rejected}
  ELSE 'OK_BBOX_MULTI_Q' || pick || suffix END AS status FROM chosen)
SELECT seq, start, status, CASE WHEN status LIKE 'OK%' THEN round(CASE pick WHEN 10 THEN q10 WHEN 25 THEN q25 WHEN 50 THEN q50 ELSE q75 END, 5) END AS ttc{"".join(f", {c}" for c in extra)} FROM named"""


def nearest(v) -> str:
    """seq, start, status, ttc (not rounded), n_rows and, of the candidate nearest to ttc, fit_points, slope and ref."""
    sql = estimate(v, ("hist_guard", "n_rows")).replace("round(CASE pick", "(CASE pick").replace("ELSE q75 END, 5)", "ELSE q75 END)")
    head, tail = sql.rsplit("SELECT seq, start, status,", 1)
    return f"""{head.rstrip()}, est AS (SELECT seq, start, status,{tail})
SELECT e.seq, e.start, status, ttc, n_rows, fit_points, slope, ref FROM est e LEFT JOIN (
  SELECT e.seq, e.start, fit_points, slope, ref FROM est e JOIN cands c ON c.seq = e.seq AND c.start = e.start AND c.src = CASE WHEN hist_guard THEN 1 ELSE 0 END WHERE e.ttc IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY e.seq, e.start ORDER BY round(abs(c.ttc - e.ttc), 9), back, ord) = 1) f ON f.seq = e.seq AND f.start = e.start"""
