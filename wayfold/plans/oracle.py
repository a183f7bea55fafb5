"""DuckDB SQL, built from named common table expressions."""

from __future__ import annotations

from ..sources.bindings import SAMPLES_SQL

PI = "3.141592653589793"

#: name -> (the names it needs, its text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "samples": ((), SAMPLES_SQL),
    "valid": (("samples",), """flagged AS (SELECT *, CASE WHEN is_valid AND NOT coalesce(lag(is_valid) OVER (PARTITION BY trajectory_id ORDER BY sample_index), false) THEN 1 ELSE 0 END AS st FROM samples),
valid AS (SELECT * FROM (SELECT *, CAST(sum(st) OVER (PARTITION BY trajectory_id ORDER BY sample_index) - 1 AS INTEGER) AS run_index FROM flagged) WHERE is_valid)"""),
    "cut": (("valid",), """cut AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY trajectory_id, run_index ORDER BY sample_index) - 1 AS INTEGER) AS chunk_index FROM
 (SELECT *, CASE WHEN coalesce((z_m IS NULL) <> lag(z_m IS NULL) OVER (PARTITION BY trajectory_id, run_index ORDER BY sample_index), true) THEN 1 ELSE 0 END AS ch FROM valid))"""),
    "runs": (("valid",), """runs AS (SELECT scenario_id, trajectory_id, run_index, min(sample_index) AS start_index, max(sample_index) AS end_index, min(timestamp_ns) AS start_time_ns, max(timestamp_ns) AS end_time_ns, count(*) AS samples FROM valid GROUP BY ALL)"""),
    "keys": (("cut",), """keys AS (SELECT * FROM (SELECT *, row_number() OVER w - 1 AS place, lead(sample_index) OVER w IS NULL AS is_last,
  coalesce((z_m IS NULL) <> lag(z_m IS NULL) OVER w, false) OR coalesce((z_m IS NULL) <> lead(z_m IS NULL) OVER w, false) AS edge
  FROM cut WINDOW w AS (PARTITION BY trajectory_id, run_index ORDER BY sample_index)) WHERE place % 5 = 0 OR is_last OR edge)"""),
    "segs": (("keys",), """ended AS (SELECT *, count(*) OVER (PARTITION BY trajectory_id, run_index, chunk_index) = 1 AS alone,
  lead(sample_index) OVER w AS e_i, lead(timestamp_ns) OVER w AS e_t, lead(x_m) OVER w AS e_x, lead(y_m) OVER w AS e_y, lead(z_m) OVER w AS e_z, lead(velocity_x_mps) OVER w AS e_vx, lead(velocity_y_mps) OVER w AS e_vy, lead(heading_rad) OVER w AS e_h
  FROM keys WINDOW w AS (PARTITION BY trajectory_id, run_index, chunk_index ORDER BY sample_index)),
segs AS (SELECT scenario_id, trajectory_id, run_index, chunk_index, CASE WHEN alone THEN 'hold' ELSE 'linear' END AS primitive_type, sample_index AS s_i, coalesce(e_i, sample_index) AS e_i, timestamp_ns AS s_t, coalesce(e_t, timestamp_ns) AS e_t,
  x_m AS s_x, coalesce(e_x, x_m) AS e_x, y_m AS s_y, coalesce(e_y, y_m) AS e_y, z_m AS s_z, CASE WHEN alone THEN z_m ELSE e_z END AS e_z, velocity_x_mps AS s_vx, CASE WHEN alone THEN velocity_x_mps ELSE e_vx END AS e_vx,
  velocity_y_mps AS s_vy, CASE WHEN alone THEN velocity_y_mps ELSE e_vy END AS e_vy, heading_rad AS s_h, CASE WHEN alone THEN heading_rad ELSE e_h END AS e_h,
  CAST(row_number() OVER (PARTITION BY trajectory_id, run_index ORDER BY sample_index, coalesce(e_i, sample_index)) - 1 AS INTEGER) AS segment_index FROM ended WHERE alone OR e_i IS NOT NULL)"""),
    "replayed": (("segs",), """hit AS (SELECT v.*, s.* EXCLUDE (scenario_id, trajectory_id, run_index), s.run_index AS seg_run, row_number() OVER (PARTITION BY v.trajectory_id, v.timestamp_ns ORDER BY s.run_index, s.segment_index) AS pick
  FROM valid v JOIN segs s ON v.trajectory_id = s.trajectory_id AND v.timestamp_ns BETWEEN s.s_t AND s.e_t),
lerped AS (SELECT *, CAST(timestamp_ns - s_t AS DOUBLE) / CAST(nullif(e_t - s_t, 0) AS DOUBLE) AS u FROM hit WHERE pick = 1),
replayed AS (SELECT *, CASE WHEN timestamp_ns = s_t THEN s_x WHEN timestamp_ns = e_t THEN e_x ELSE s_x + (e_x - s_x) * u END AS r_x, CASE WHEN timestamp_ns = s_t THEN s_y WHEN timestamp_ns = e_t THEN e_y ELSE s_y + (e_y - s_y) * u END AS r_y,
  CASE WHEN timestamp_ns = s_t THEN s_z WHEN timestamp_ns = e_t THEN e_z ELSE s_z + (e_z - s_z) * u END AS r_z,
  CASE WHEN timestamp_ns = s_t THEN s_vx WHEN timestamp_ns = e_t THEN e_vx ELSE s_vx + (e_vx - s_vx) * u END AS r_vx, CASE WHEN timestamp_ns = s_t THEN s_vy WHEN timestamp_ns = e_t THEN e_vy ELSE s_vy + (e_vy - s_vy) * u END AS r_vy FROM lerped)"""),
    "errs": (("replayed", "runs"), """errs AS (SELECT r.scenario_id, r.trajectory_id, r.run_index, r.sample_index, r.timestamp_ns,
  sqrt(CASE WHEN z_m IS NOT NULL THEN (x_m - r_x) * (x_m - r_x) + (y_m - r_y) * (y_m - r_y) + (z_m - r_z) * (z_m - r_z) ELSE (x_m - r_x) * (x_m - r_x) + (y_m - r_y) * (y_m - r_y) END) AS pe,
  sqrt((velocity_x_mps - r_vx) * (velocity_x_mps - r_vx) + (velocity_y_mps - r_vy) * (velocity_y_mps - r_vy)) AS ve,
  CAST(r.sample_index = n.start_index AS INTEGER) + CAST(r.sample_index = n.end_index AS INTEGER) AS run_ends FROM replayed r JOIN runs n ON r.trajectory_id = n.trajectory_id AND r.run_index = n.run_index)"""),
    "feat": (("valid",), """diffs AS (SELECT *, CAST(coalesce(lead(timestamp_ns) OVER w, timestamp_ns) - coalesce(lag(timestamp_ns) OVER w, timestamp_ns) AS DOUBLE) / 1e9 AS sec,
  coalesce(lead(x_m) OVER w, x_m) - coalesce(lag(x_m) OVER w, x_m) AS dx, coalesce(lead(y_m) OVER w, y_m) - coalesce(lag(y_m) OVER w, y_m) AS dy FROM valid WINDOW w AS (PARTITION BY trajectory_id, run_index ORDER BY sample_index)),
speeds AS (SELECT *, sqrt(velocity_x_mps * velocity_x_mps + velocity_y_mps * velocity_y_mps) AS v, CASE WHEN sec > 0 THEN dx / sec END AS fx, CASE WHEN sec > 0 THEN dy / sec END AS fy FROM diffs),
feat AS (SELECT *, coalesce(speed_mps, v, sqrt(fx * fx + fy * fy), 0.0) AS speed, CASE WHEN speed_mps IS NOT NULL THEN 'stored' WHEN v IS NOT NULL THEN 'velocity' WHEN fx IS NOT NULL THEN 'finite_difference' ELSE 'none' END AS speed_source,
  CASE WHEN heading_rad IS NOT NULL THEN heading_rad WHEN coalesce(v > 0.5, false) THEN atan2(velocity_y_mps, velocity_x_mps) WHEN coalesce(sqrt(fx * fx + fy * fy) > 1e-12, false) THEN atan2(fy, fx) END AS heading,
  CASE WHEN heading_rad IS NOT NULL THEN 'stored' WHEN coalesce(v > 0.5, false) THEN 'velocity' WHEN coalesce(sqrt(fx * fx + fy * fy) > 1e-12, false) THEN 'finite_difference' ELSE 'none' END AS heading_source FROM speeds)"""),
    "stops": (("feat",), """slow AS (SELECT *, lag(speed) OVER w AS before, lead(speed) OVER w AS after FROM feat WINDOW w AS (PARTITION BY trajectory_id, run_index ORDER BY sample_index)),
slows AS (SELECT * EXCLUDE (st), CASE WHEN speed <= 40 AND coalesce(before > 40, true) THEN 1 ELSE 0 END AS begins FROM slow),
slowg AS (SELECT *, sum(begins) OVER (PARTITION BY trajectory_id, run_index ORDER BY sample_index) - 1 AS ordinal FROM slows),
stops AS (SELECT scenario_id, trajectory_id, run_index, 'stop' AS event_type, min(sample_index) AS start_index, arg_min(sample_index, (speed, sample_index)) AS anchor_index, max(sample_index) AS end_index, min(timestamp_ns) AS start_time_ns,
  arg_min(timestamp_ns, (speed, sample_index)) AS anchor_time_ns, max(timestamp_ns) AS end_time_ns, max(speed) AS magnitude, CAST(ordinal AS INTEGER) AS ordinal, min(speed) AS minimum_speed, max(speed) AS maximum_speed,
  coalesce(arg_min(before, sample_index) > 40, false) AS motion_before, coalesce(arg_max(after, sample_index) > 40, false) AS motion_after FROM slowg WHERE speed <= 40 GROUP BY scenario_id, trajectory_id, run_index, ordinal HAVING max(timestamp_ns) - min(timestamp_ns) >= 500000000)"""),
    "turns": (("feat",), f"""tsteps AS (SELECT scenario_id, trajectory_id, run_index, sample_index, timestamp_ns, lead(sample_index) OVER w AS ni, lead(timestamp_ns) OVER w AS nt, lead(heading) OVER w - heading + {PI} AS raw0 FROM feat WINDOW w AS (PARTITION BY trajectory_id, run_index ORDER BY sample_index)),
tstep AS (SELECT *, CASE WHEN coalesce(abs(raw) < 0.01, true) THEN 0.0 ELSE raw END AS step FROM (SELECT *, ((raw0 % (2 * {PI})) + 2 * {PI}) % (2 * {PI}) - {PI} AS raw FROM tsteps WHERE ni IS NOT NULL)),
tgrp AS (SELECT *, sum(ch) OVER (PARTITION BY trajectory_id, run_index ORDER BY sample_index) - 1 AS grp FROM (SELECT *, sign(step) AS sg, CASE WHEN coalesce(sign(step) <> lag(sign(step)) OVER (PARTITION BY trajectory_id, run_index ORDER BY sample_index), true) THEN 1 ELSE 0 END AS ch FROM tstep)),
tcum AS (SELECT *, abs(sum(step) OVER (PARTITION BY trajectory_id, run_index, grp ORDER BY sample_index)) AS turned FROM tgrp WHERE sg <> 0),
turns0 AS (SELECT scenario_id, trajectory_id, run_index, CASE WHEN sg > 0 THEN 'left_turn' ELSE 'right_turn' END AS event_type, min(sample_index) AS start_index, arg_max(ni, (turned, -ni)) AS anchor_index, max(ni) AS end_index, min(timestamp_ns) AS start_time_ns, arg_max(nt, (turned, -ni)) AS anchor_time_ns, max(nt) AS end_time_ns, sum(step) AS magnitude FROM tcum GROUP BY scenario_id, trajectory_id, run_index, grp, sg HAVING abs(sum(step)) >= 0.35 AND max(nt) - min(timestamp_ns) >= 300000000),
turns AS (SELECT *, CAST(row_number() OVER (PARTITION BY trajectory_id, run_index, event_type ORDER BY start_index) - 1 AS INTEGER) AS ordinal FROM turns0)"""),
    "accs": (("feat",), """asteps AS (SELECT scenario_id, trajectory_id, run_index, sample_index, timestamp_ns, speed, lead(speed) OVER w AS ns, lead(sample_index) OVER w AS ni, lead(timestamp_ns) OVER w AS nt FROM feat WINDOW w AS (PARTITION BY trajectory_id, run_index ORDER BY sample_index)),
astep AS (SELECT *, CASE WHEN coalesce(abs(raw) < 0.2, true) THEN 0.0 ELSE raw END AS step FROM (SELECT *, (ns - speed) / nullif(CAST(nt - timestamp_ns AS DOUBLE) / 1e9, 0) AS raw FROM asteps WHERE ni IS NOT NULL)),
agrp AS (SELECT *, sum(ch) OVER (PARTITION BY trajectory_id, run_index ORDER BY sample_index) - 1 AS grp FROM (SELECT *, sign(step) AS sg, CASE WHEN coalesce(sign(step) <> lag(sign(step)) OVER (PARTITION BY trajectory_id, run_index ORDER BY sample_index), true) THEN 1 ELSE 0 END AS ch FROM astep)),
accs0 AS (SELECT scenario_id, trajectory_id, run_index, CASE WHEN sg > 0 THEN 'acceleration' ELSE 'braking' END AS event_type, min(sample_index) AS start_index, arg_max(sample_index, (abs(step), -sample_index)) AS anchor_index, max(ni) AS end_index, min(timestamp_ns) AS start_time_ns, arg_max(timestamp_ns, (abs(step), -sample_index)) AS anchor_time_ns, max(nt) AS end_time_ns, arg_max(ns, sample_index) - arg_min(speed, sample_index) AS magnitude, arg_max(step, (abs(step), -sample_index)) AS peak FROM agrp WHERE sg <> 0 GROUP BY scenario_id, trajectory_id, run_index, grp, sg HAVING abs(arg_max(ns, sample_index) - arg_min(speed, sample_index)) >= 1 AND max(nt) - min(timestamp_ns) >= 300000000),
accs AS (SELECT *, CAST(row_number() OVER (PARTITION BY trajectory_id, run_index, event_type ORDER BY start_index) - 1 AS INTEGER) AS ordinal FROM accs0)"""),
    "gaps": (("runs", "samples"), """gaps AS (SELECT r.scenario_id, r.trajectory_id, r.run_index, 'gap' AS event_type, a AS start_index, a AS anchor_index, b AS end_index, at_ AS start_time_ns, at_ AS anchor_time_ns, bt AS end_time_ns, CAST(NULL AS DOUBLE) AS magnitude, r.run_index AS ordinal, count(*) AS invalid_samples, min(s.timestamp_ns) AS first_invalid_ns, max(s.timestamp_ns) AS last_invalid_ns
  FROM (SELECT *, end_index AS a, end_time_ns AS at_, lead(start_index) OVER w AS b, lead(start_time_ns) OVER w AS bt FROM runs WINDOW w AS (PARTITION BY trajectory_id ORDER BY run_index)) r JOIN samples s ON s.trajectory_id = r.trajectory_id AND NOT s.is_valid AND s.sample_index > a AND s.sample_index < b GROUP BY ALL)"""),
    "found": (("stops", "turns", "accs", "gaps"), """found0 AS (SELECT scenario_id, trajectory_id, run_index, event_type, start_index, anchor_index, end_index, start_time_ns, anchor_time_ns, end_time_ns, magnitude, ordinal FROM stops UNION ALL SELECT scenario_id, trajectory_id, run_index, event_type, start_index, anchor_index, end_index, start_time_ns, anchor_time_ns, end_time_ns, magnitude, ordinal FROM turns UNION ALL SELECT scenario_id, trajectory_id, run_index, event_type, start_index, anchor_index, end_index, start_time_ns, anchor_time_ns, end_time_ns, magnitude, ordinal FROM accs UNION ALL SELECT scenario_id, trajectory_id, run_index, event_type, start_index, anchor_index, end_index, start_time_ns, anchor_time_ns, end_time_ns, magnitude, ordinal FROM gaps),
found AS (SELECT *, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY start_time_ns, end_time_ns, list_position(['stop','left_turn','right_turn','acceleration','braking','gap'], event_type), event_id) - 1 AS INTEGER) AS event_index FROM
  (SELECT *, 'event-' || substr(sha256(scenario_id || '|' || trajectory_id || '|' || run_index || '|' || event_type || '|' || ordinal), 1, 32) AS event_id FROM found0))"""),
    "lengths": (("valid",), """stepped AS (SELECT *, sqrt((x_m - x0) * (x_m - x0) + (y_m - y0) * (y_m - y0)) AS d FROM (SELECT *, lag(x_m) OVER w AS x0, lag(y_m) OVER w AS y0 FROM valid WINDOW w AS (PARTITION BY trajectory_id, run_index ORDER BY sample_index))),
alongs AS (SELECT *, sum(coalesce(d, 0.0)) OVER (PARTITION BY trajectory_id, run_index ORDER BY sample_index) AS along_m FROM stepped),
lengths AS (SELECT scenario_id, trajectory_id, run_index, max(along_m) AS length_m, max(timestamp_ns) - min(timestamp_ns) AS duration_ns FROM alongs GROUP BY ALL)"""),
    "metrics": ((), """metrics AS (SELECT l_returnflag || l_linestatus AS method, l_suppkey AS unit, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS value FROM lineitem GROUP BY ALL)"""),
    "diffs2": (("metrics",), """methods AS (SELECT method, row_number() OVER (ORDER BY method) AS place FROM (SELECT DISTINCT method FROM metrics)),
diffs2 AS (SELECT a.method AS method_a, b.method AS method_b, x.unit, x.value - y.value AS difference FROM methods a JOIN methods b ON a.place < b.place JOIN metrics x ON x.method = a.method JOIN metrics y ON y.method = b.method AND y.unit = x.unit)"""),
    "pieces": (("valid",), """pieces AS (SELECT * FROM (SELECT scenario_id, trajectory_id, run_index, sample_index, x_m AS x0, y_m AS y0, lead(x_m) OVER w AS x1, lead(y_m) OVER w AS y1 FROM valid WINDOW w AS (PARTITION BY trajectory_id, run_index ORDER BY sample_index)) WHERE x1 IS NOT NULL)"""),
    "tiled": (("pieces",), """cand AS (SELECT *, unnest(range(CAST(ceil(least(x0, x1) / 10.0) AS BIGINT) - 1, CAST(floor(greatest(x0, x1) / 10.0) AS BIGINT) + 1)) AS grid_x FROM pieces),
cand2 AS (SELECT *, unnest(range(CAST(ceil(least(y0, y1) / 10.0) AS BIGINT) - 1, CAST(floor(greatest(y0, y1) / 10.0) AS BIGINT) + 1)) AS grid_y FROM cand),
box AS (SELECT *, grid_x * CAST(10.0 AS DOUBLE) AS min_x, grid_x * CAST(10.0 AS DOUBLE) + 10 AS max_x, grid_y * CAST(10.0 AS DOUBLE) AS min_y, grid_y * CAST(10.0 AS DOUBLE) + 10 AS max_y FROM cand2),
par AS (SELECT *, (min_x - x0) / nullif(x1 - x0, 0) AS px, (max_x - x0) / nullif(x1 - x0, 0) AS qx, (min_y - y0) / nullif(y1 - y0, 0) AS py, (max_y - y0) / nullif(y1 - y0, 0) AS qy FROM box),
clipped AS (SELECT *, greatest(0.0, coalesce(least(px, qx), 0.0), coalesce(least(py, qy), 0.0)) AS u0, least(1.0, coalesce(greatest(px, qx), 1.0), coalesce(greatest(py, qy), 1.0)) AS u1 FROM par
  WHERE NOT ((x1 = x0 AND (x0 < min_x OR x0 > max_x)) OR (y1 = y0 AND (y0 < min_y OR y0 > max_y)))),
tiled AS (SELECT scenario_id, trajectory_id, grid_x, grid_y, CAST(sum(CAST(round(m * 1e6) AS BIGINT)) AS BIGINT) AS length_um FROM (SELECT *, (u1 - u0) * sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS m FROM clipped WHERE u1 > u0) WHERE m > 0 GROUP BY ALL)"""),
}


def sql(select: str, *needs: str, recursive: str = "") -> str:
    """select with the expressions it needs, each after those it needs itself."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for n in CTES[name][0]:
                add(n)
            done.append(name)

    for n in needs:
        add(n)
    parts = [CTES[n][1] for n in done] + ([recursive] if recursive else [])
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n" if parts else "") + select


def stats(x: str) -> str:
    """The oracle's twin of functions.motion.describe, rounded."""
    total = lambda e: f"CAST(sum(CAST(round(({e}) * 1e6) AS BIGINT)) AS DOUBLE) / 1e6"
    return f'count({x}) AS "count", round({total(x)} / nullif(count({x}), 0), 6) AS mean, round(quantile_cont({x}, 0.5), 6) AS median, round(quantile_cont({x}, 0.95), 6) AS p95, round(max({x}), 6) AS maximum, round(coalesce({total(x)}, 0), 4) AS "sum", round(coalesce({total(f"({x}) * ({x})")}, 0), 2) AS sum_of_squares'
