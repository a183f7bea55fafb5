"""Queries of campaign analysis, selection, validation and waypoints, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, events, metrics, replay, selection, sequence, spatial, validate
from ..operators.sequence import TRACK
from ..sources import providers
from .oracle import PI, sql
from .registry import _events, _segments, _valid, query, read, rounded

# --- scenario summaries ------------------------------------------------------------------------------------------

_TYPES = {1: "stop", 2: "left_turn", 3: "right_turn", 4: "acceleration", 5: "braking"}
_BASE = (
    "base AS (SELECT CASE l_linestatus WHEN 'F' THEN 'pilot' ELSE 'test' END AS cohort_role, l_returnflag AS parameter_identity, CASE l_returnflag WHEN 'A' THEN 'position_bounded_linear' WHEN 'N' THEN 'position_velocity_hybrid' ELSE 'uniform_linear' END AS family, l_suppkey AS scenario, "
    "max(l_quantity) AS q1, min(l_quantity) AS q0, max(l_tax) AS t1, max(l_discount) + 0.01 AS d1, max(l_quantity) / 40 AS v1, count(*) AS o_s, count(*) FILTER (l_discount > 0.02) AS o_r, count(*) FILTER (l_discount > 0.05) AS o_m"
    + "".join(f", count(*) FILTER (l_linenumber = {k} AND l_quantity < 30) AS s{k}, count(*) FILTER (l_linenumber = {k} AND l_discount > 0.03) AS r{k}, count(*) FILTER (l_linenumber = {k} AND l_quantity < 30 AND l_discount > 0.03) AS m{k}" for k in _TYPES)
    + " FROM lineitem GROUP BY ALL)"
)


def _raw(spark, d):
    """Summaries of suppliers as JSON, as a campaign stores them."""
    n = lambda c: F.count_if(c)
    li, q, disc = read(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_discount")
    counts = lambda s, r, m: F.struct(s.alias("source_event_count"), r.alias("replay_event_count"), m.alias("matched_event_count"))
    family = F.when(F.col("l_returnflag") == "A", "position_bounded_linear").when(F.col("l_returnflag") == "N", "position_velocity_hybrid").otherwise("uniform_linear")
    by = [F.when(F.col("l_linestatus") == "F", "pilot").otherwise("test").alias("cohort_role"), F.col("l_returnflag").alias("parameter_identity"), family.alias("family"), F.col("l_suppkey").alias("scenario")]
    stats = lambda mean, median, p95, most: F.struct(mean.alias("mean"), median.alias("median"), p95.alias("p95"), most.alias("maximum"))
    hi, lo, tax, far, fast = F.max(q), F.min(q), F.max("l_tax"), F.max(disc) + 0.01, F.max(q) / 40
    motion = F.struct(stats(hi, lo, tax, far).alias("position"), stats(tax, lo, far, hi).alias("heading"), stats(tax, lo, far, fast).alias("velocity"), stats(lo, lo, tax, hi).alias("endpoint_position"))
    types = F.struct(*[counts(n((F.col("l_linenumber") == k) & (q < 30)), n((F.col("l_linenumber") == k) & (disc > 0.03)), n((F.col("l_linenumber") == k) & (q < 30) & (disc > 0.03))).alias(t) for k, t in _TYPES.items()])
    semantic = F.struct(counts(F.count("*"), n(disc > 0.02), n(disc > 0.05)).alias("overall"), types.alias("by_type"))
    return li.groupBy(*by).agg(F.to_json(motion).alias("motion_summary_json"), F.to_json(semantic).alias("semantic_summary_json"))


def _scores(name: str, s: str, r: str, m: str) -> str:
    p, c = f"CAST({m} AS DOUBLE) / nullif({r}, 0)", f"CAST({m} AS DOUBLE) / nullif({s}, 0)"
    return f"{s} AS semantic_{name}_source_count, {r} AS semantic_{name}_replay_count, {m} AS semantic_{name}_matched_count, round({p}, 9) AS semantic_{name}_precision, round({c}, 9) AS semantic_{name}_recall, round(2 * ({p}) * ({c}) / nullif(({p}) + ({c}), 0), 9) AS semantic_{name}_f1"


_GROUPS = {"overall": ("o_s", "o_r", "o_m"), "stop": ("s1", "r1", "m1"), "turn": ("(s2 + s3)", "(r2 + r3)", "(m2 + m3)"), "acceleration": ("s4", "r4", "m4"), "braking": ("s5", "r5", "m5")}
_VIOLATIONS = "CASE WHEN family IN ('position_bounded_linear', 'position_velocity_hybrid') AND d1 > 0.1 + 1e-9 THEN 1 ELSE 0 END + CASE WHEN family = 'position_velocity_hybrid' AND v1 > 1.0 + 1e-9 THEN 1 ELSE 0 END"
_WIDE = (
    "SELECT cohort_role, parameter_identity, family, scenario, q1 AS position_mean_m, q0 AS position_median_m, t1 AS position_p95_m, round(d1, 9) AS position_maximum_m, t1 AS heading_mean_rad, round(d1, 9) AS heading_p95_rad, t1 AS velocity_mean_mps, round(d1, 9) AS velocity_p95_mps, "
    "round(v1, 9) AS velocity_maximum_mps, q0 AS endpoint_position_mean_m, t1 AS endpoint_position_p95_m, q1 AS endpoint_position_maximum_m, " + ", ".join(_scores(n, *x) for n, x in _GROUPS.items()) + f", {_VIOLATIONS} AS constraint_violation_count FROM base"
)


@query(f"WITH {_BASE} {_WIDE}")
def scenario_rows(spark, d):
    return rounded(analysis.scenario_rows(_raw(spark, d)), 9)


_EVENT_LONG = " UNION ALL ".join(f"SELECT cohort_role, parameter_identity, '{n}' AS event_type, {s} AS s, {r} AS r, {m} AS m FROM base" for n, (s, r, m) in _GROUPS.items() if n != "overall")
_SUM = lambda x: f"CAST(sum(CAST(round(({x}) * 1e6) AS BIGINT)) AS DOUBLE) / 1e6"
_AWARE = "CASE WHEN s = 0 THEN CASE WHEN r = 0 THEN 1.0 ELSE 0.0 END ELSE 2.0 * m / (s + r) END"


@query(
    f"WITH {_BASE}, long AS (SELECT *, 2 * p * c / nullif(p + c, 0) AS f FROM (SELECT *, CAST(m AS DOUBLE) / nullif(r, 0) AS p, CAST(m AS DOUBLE) / nullif(s, 0) AS c FROM ({_EVENT_LONG}))) "
    f"SELECT cohort_role, parameter_identity, event_type, count(*) AS scenarios, round({_SUM('f')} / nullif(count(f), 0), 6) AS macro_f1, count(*) FILTER (f IS NULL) AS undefined, count(*) FILTER (s = 0) AS source_absent, count(*) FILTER (s > 0 AND f IS NULL) AS source_present_undefined, count(*) FILTER (s = 0 AND r > 0) AS false_positive, round({_SUM(_AWARE)} / count(*), 6) AS presence_aware FROM long GROUP BY ALL"
)
def event_analysis(spark, d):
    return rounded(analysis.event_analysis(analysis.scenario_rows(_raw(spark, d))))


def _sizes(spark, d):
    li = read(spark, d, "lineitem").where("l_returnflag in ('A', 'R')")
    kind = F.when(F.col("l_returnflag") == "A", "raw").otherwise("exact")
    return li.groupBy(F.col("l_linestatus").alias("role"), kind.alias("representation"), F.col("l_partkey").alias("scenario")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("bytes"))


@query(
    "WITH sizes AS (SELECT l_linestatus AS role, l_returnflag AS rep, l_partkey AS scenario, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS bytes FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL), both_ AS (SELECT coalesce(a.role, b.role) AS role, a.bytes AS raw, b.bytes AS exact, CAST(b.bytes AS DOUBLE) / a.bytes AS ratio FROM (SELECT * FROM sizes WHERE rep = 'A') a FULL JOIN (SELECT * FROM sizes WHERE rep = 'R') b ON a.role = b.role AND a.scenario = b.scenario) "
    f"SELECT role, count(ratio) AS scenarios, count(*) - count(ratio) AS unpaired, CAST(sum(raw) AS BIGINT) AS raw_bytes, CAST(sum(exact) AS BIGINT) AS exact_bytes, round({_SUM('ratio')} / nullif(count(ratio), 0), 6) AS mean_ratio, round(min(ratio), 6) AS least_ratio, round(max(ratio), 6) AS greatest_ratio, max(exact - raw) AS greatest_increase FROM both_ GROUP BY role"
)
def serialization_overhead(spark, d):
    return rounded(analysis.serialization_overhead(_sizes(spark, d)))


@query("SELECT l_linestatus AS role, 'raw' AS representation, 'part-' || l_returnflag AS name, CAST(sum(b) AS BIGINT) AS size_bytes, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS files FROM (SELECT l_linestatus, l_returnflag, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS b, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL")
def file_components(spark, d):
    files = read(spark, d, "lineitem").groupBy("l_linestatus", "l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("size_bytes"), F.count("*").alias("row_count"))
    listed = F.collect_list(F.struct(F.concat(F.lit("part-"), "l_returnflag").alias("name"), "size_bytes", "row_count"))  # three files a scenario
    rows = files.groupBy(F.col("l_linestatus").alias("role"), "l_suppkey").agg(F.to_json(F.struct(F.array(F.struct(listed.alias("files"))).alias("runs"))).alias("artifact_summary_json"))
    return analysis.file_components(rows.withColumn("representation", F.lit("raw")))


@query(f"SELECT l_returnflag, round(a - b, 6) AS difference FROM (SELECT l_returnflag, {_SUM('l_discount')} / nullif(count(l_discount), 0) AS v, l_linestatus AS s FROM lineitem GROUP BY ALL) PIVOT (max(v) FOR s IN ('F' AS a, 'O' AS b))")
def descriptive_difference(spark, d):
    return rounded(analysis.descriptive_difference(read(spark, d, "lineitem"), F.col("l_linestatus") == "F", "l_discount", ("l_returnflag",)))


# --- contrasts ---------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in f) + ")" for f in analysis.FAMILIES) + ") t(family, context, method_a, method_b, identical_keyframes)")
def ablation_families(spark, d):
    return analysis.families(spark)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{m}', {len(ps)})" for m, ps in analysis.GRID.items()) + ") t(method, points)")
def frozen_grid(spark, d):
    return analysis.parameter_grid(spark).groupBy("method").agg(F.count("*").alias("points"))


def _p_values() -> str:
    """A p-value for each contrast of the plan and each customer segment, from customers' balances."""
    return "SELECT context, metric, method_a, method_b, (sum_ * 7919 + len(method_a) * 104729 + len(method_b) * 1299709 + len(coalesce(context, '')) * 15485863) % 1000 / 1e4 AS p_value FROM plan, (SELECT c_mktsegment AS metric, CAST(sum(c_custkey) AS BIGINT) AS sum_ FROM customer GROUP BY ALL)"


_PLAN = "plan AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("CAST(NULL AS VARCHAR)" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in f) + ")" for f in analysis.FAMILIES) + ") t(family, context, method_a, method_b, identical_keyframes))"


@query(
    f"WITH {_PLAN}, effects AS (SELECT DISTINCT * FROM ({_p_values()})), j AS (SELECT p.family, e.* FROM effects e JOIN plan p ON e.method_a = p.method_a AND e.method_b = p.method_b AND e.context IS NOT DISTINCT FROM p.context), "
    "steps AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family, metric) - row_number() OVER w + 1) * p_value) AS st, method_a || ' - ' || method_b AS c FROM j WINDOW w AS (PARTITION BY family, metric ORDER BY p_value, method_a || ' - ' || method_b)) "
    "SELECT family, context, metric, method_a, method_b, p_value, round(adj, 9) AS adjusted, CASE WHEN metric = 'MACHINERY' THEN 'invariant_guarantee' WHEN adj <= 0.05 THEN 'significant_result' ELSE 'descriptive_tendency' END AS claim FROM (SELECT *, max(st) OVER (PARTITION BY family, metric ORDER BY p_value, c ROWS UNBOUNDED PRECEDING) AS adj FROM steps)"
)
def ablation_contrasts(spark, d):
    plan = analysis.families(spark)
    seg = read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("metric")).agg(F.sum("c_custkey").alias("sum_"))
    own = plan.select("context", "method_a", "method_b").distinct().join(F.broadcast(seg))  # contrasts by segments
    p = (F.col("sum_") * 7919 + F.length("method_a") * 104729 + F.length("method_b") * 1299709 + F.length(F.coalesce("context", F.lit(""))) * 15485863) % 1000 / 1e4
    out = analysis.ablation(own.select("context", "metric", "method_a", "method_b", p.alias("p_value")), plan, ("MACHINERY",))
    return rounded(out.select("family", "context", "metric", "method_a", "method_b", "p_value", "adjusted", "claim"), 9, p_value=12)


# --- cohorts -----------------------------------------------------------------------------------------------------


def _units(spark, d):
    return read(spark, d, "supplier").select(F.concat(F.lit("r"), (F.col("s_nationkey") % 3).cast("string")).alias("role"), (F.col("s_acctbal") > 0).alias("included"), "s_acctbal", F.col("s_nationkey").cast("double").alias("nation"))


_FIVE = lambda c, n: f"round(min({c}), 6) AS {n}_minimum, round(quantile_cont({c}, 0.25), 6) AS {n}_q25, round(quantile_cont({c}, 0.5), 6) AS {n}_q50, round(quantile_cont({c}, 0.75), 6) AS {n}_q75, round(max({c}), 6) AS {n}_maximum"


@query("SELECT CASE WHEN grouping(role) = 1 THEN 'overall' ELSE role END AS role, count(*) AS units, count(*) FILTER (included) AS included_units, " + _FIVE("a", "s_acctbal") + ", " + _FIVE("n", "nation") + " FROM (SELECT *, CASE WHEN included THEN s_acctbal END AS a, CASE WHEN included THEN nation END AS n FROM (SELECT 'r' || (s_nationkey % 3) AS role, s_acctbal > 0 AS included, s_acctbal, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier)) GROUP BY ROLLUP (role)")
def cohort_summaries(spark, d):
    return rounded(analysis.cohort_summaries(_units(spark, d), ("s_acctbal", "nation")))


@query("SELECT CASE WHEN grouping(role) = 1 THEN 'overall' ELSE role END AS role, c_mktsegment, count(*) AS units FROM (SELECT 'n' || (c_nationkey % 4) AS role, c_mktsegment FROM customer) GROUP BY GROUPING SETS ((role, c_mktsegment), (c_mktsegment))")
def cohort_histogram(spark, d):
    return analysis.histogram(read(spark, d, "customer").select(F.concat(F.lit("n"), (F.col("c_nationkey") % 4).cast("string")).alias("role"), "c_mktsegment"), "c_mktsegment")


@query("SELECT c_name AS source_id, s.k IS NULL AS included, CASE WHEN s.k IS NULL THEN NULL ELSE coalesce(reason, 'other_documented_reason') END AS reason FROM customer LEFT JOIN (SELECT o_custkey AS k, min(CASE WHEN o_orderstatus <> 'P' THEN 'status_' || o_orderstatus END) AS reason FROM orders WHERE o_totalprice > 400000 GROUP BY ALL) s ON s.k = c_custkey")
def validation_status(spark, d):
    scenarios = read(spark, d, "customer").select(F.col("c_custkey").alias("scenario_id"), F.col("c_name").alias("source_id"))
    bad = read(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("scenario_id"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("status_"), "o_orderstatus")).alias("reason"))
    return analysis.validation_status(scenarios, bad)


@query("SELECT c_name AS unit, 'n1' AS role, c_custkey + 1 AS rank FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 = 1 AND c_custkey + 1 <= 60 ORDER BY rank LIMIT 60")
def cohort_role(spark, d):
    units = read(spark, d, "customer").select(F.col("c_name").alias("unit"), F.concat(F.lit("n"), (F.col("c_custkey") % 3).cast("string")).alias("role"), (F.col("c_custkey") + 1).alias("rank"), (F.col("c_acctbal") > 0).alias("included"))
    return selection.cohort_role(units, "n1", 60).select("unit", "role", "rank")


# --- choosing ----------------------------------------------------------------------------------------------------

_TARGETS = [("price", 950.0, ["Brand#1", "Brand#2", "Brand#99"], 20.0, "primary"), ("size", 25.0, ["Brand#1", "Brand#3"], 2.0, "diagnostic"), ("price", 10.0, ["Brand#4"], 100.0, "diagnostic")]


@query(
    "WITH t AS (SELECT dimension, target, maximum_mismatch, priority, unnest(families) AS family FROM (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c}, {e}::DOUBLE, '{p}')" for a, b, c, e, p in _TARGETS) + ") v(dimension, target, families, maximum_mismatch, priority)), "
    "c AS (SELECT p_brand AS family, p_partkey AS configuration, unnest(['price', 'size']) AS dimension, unnest([p_retailprice, CAST(p_size AS DOUBLE)]) AS budget FROM part), "
    "best AS (SELECT t.*, c.configuration, c.budget, row_number() OVER (PARTITION BY t.dimension, t.target, t.priority, t.family ORDER BY c.budget > t.target, CASE WHEN c.budget <= t.target THEN -c.budget ELSE c.budget END, c.configuration) AS r FROM t LEFT JOIN c ON c.family = t.family AND c.dimension = t.dimension) "
    "SELECT dimension, target, priority, family, maximum_mismatch, configuration, budget, CASE WHEN budget = target THEN 'equal' WHEN budget < target THEN 'below' WHEN budget IS NOT NULL THEN 'above' END AS relation, round(abs(budget - target), 6) AS mismatch, coalesce(abs(budget - target) <= maximum_mismatch, false) AS accepted FROM best WHERE r = 1"
)
def budget_selections(spark, d):
    configs = read(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("configuration"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    targets = spark.createDataFrame(_TARGETS, "dimension string, target double, families array<string>, maximum_mismatch double, priority string")
    return rounded(selection.budget_selections(configs, targets))


_RULES = [("largest_balance", "s_acctbal", "largest"), ("typical_balance", "s_acctbal", "median"), ("smallest_balance", "s_acctbal", "smallest"), ("typical_nation", "s_nation", "median"), ("largest_nation", "s_nation", "largest")]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS category, '{m}' AS metric, s_suppkey, v AS value FROM (SELECT s_suppkey, v, row_number() OVER (ORDER BY v {'DESC' if r == 'largest' else 'ASC'}, s_suppkey) AS k, count(*) OVER () AS n FROM (SELECT s_suppkey, {'s_acctbal' if m == 's_acctbal' else 'CAST(s_nationkey AS DOUBLE)'} AS v FROM supplier) WHERE v IS NOT NULL) WHERE k = {'(n - 1) // 2 + 1' if r == 'median' else '1'}"
        for c, m, r in _RULES
    )
)
def picked_examples(spark, d):
    return selection.pick_examples(read(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nation")), _RULES, "s_suppkey")


_EFFECTS = "SELECT DISTINCT l_returnflag AS family, l_linestatus AS metric, l_suppkey % 7 AS stratum, l_suppkey AS unit, ((l_suppkey * 7919 + ascii(l_returnflag)) % 200 - 100) / 100.0::DOUBLE AS effect, 0.5::DOUBLE AS overall FROM lineitem"


@query(
    f"WITH e AS ({_EFFECTS}), s AS (SELECT *, row_number() OVER (PARTITION BY family, metric ORDER BY abs(effect) DESC, stratum, unit) AS place FROM e WHERE effect * overall < 0), low AS (SELECT family, metric, stratum, unit AS least_unit, effect AS least_effect FROM (SELECT *, row_number() OVER (PARTITION BY family, metric, stratum ORDER BY abs(effect), unit) AS r FROM e) WHERE r = 1) "
    "SELECT s.family, s.metric, s.stratum, CAST(place AS INTEGER) AS place, unit, effect, least_unit, least_effect FROM s JOIN low ON low.family = s.family AND low.metric = s.metric AND low.stratum = s.stratum WHERE place <= 2"
)
def disagreement_examples(spark, d):
    e = ((F.col("l_suppkey") * 7919 + F.ascii("l_returnflag")) % 200 - 100) / F.lit(100.0)
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("metric"), (F.col("l_suppkey") % 7).alias("stratum"), F.col("l_suppkey").alias("unit"), e.alias("effect"), F.lit(0.5).alias("overall")).distinct()
    return selection.disagreement_examples(rows)


@query("SELECT l_suppkey, id, l_extendedprice, kind, CASE WHEN kind LIKE 'loss%' THEN 'returned' WHEN kind LIKE 'l%' THEN 'late' END AS explanation FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'loss_of_' || l_linestatus WHEN 'A' THEN 'lag' ELSE 'none' END AS kind, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, id) AS r FROM (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM lineitem)) WHERE r = 1")
def worst_tracks(spark, d):
    """With explanations by category prefix."""
    kind = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("loss_of_"), "l_linestatus")).when(F.col("l_returnflag") == "A", "lag").otherwise("none")
    li = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_extendedprice", kind.alias("category"))
    return selection.explained(selection.worst_track(li, ("l_suppkey",), "l_extendedprice", "id"), {"loss": "returned", "l": "late"}).withColumnRenamed("category", "kind")


# --- candidates --------------------------------------------------------------------------------------------------

_PATH = f"""moves AS (SELECT *, x_m - lag(x_m) OVER w AS dx, y_m - lag(y_m) OVER w AS dy FROM valid WINDOW w AS (PARTITION BY trajectory_id ORDER BY sample_index)),
heads AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, CASE WHEN sqrt(dx * dx + dy * dy) >= 0.1 THEN atan2(dy, dx) END AS h FROM moves),
turned AS (SELECT *, abs(((h - last_value(h IGNORE NULLS) OVER (PARTITION BY trajectory_id ORDER BY sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {PI}) % (2 * {PI}) + 2 * {PI}) % (2 * {PI}) - {PI}) AS turn FROM heads),
paths AS (SELECT scenario_id, trajectory_id, count(*) AS sample_count, coalesce({_SUM('d')}, 0.0) AS path_length_m, (max(timestamp_ns) - min(timestamp_ns)) / 1e9 AS duration_s, coalesce({_SUM('turn')}, 0.0) AS heading_change_rad,
 max(coalesce(speed_mps, 0.0)) - min(coalesce(speed_mps, 0.0)) AS speed_range_mps, max(x_m) - min(x_m) AS extent_x_m, max(y_m) - min(y_m) AS extent_y_m FROM turned GROUP BY ALL)"""


@query(sql("SELECT scenario_id, trajectory_id, sample_count, round(path_length_m, 4) AS path_length_m, round(duration_s, 4) AS duration_s, round(heading_change_rad, 4) AS heading_change_rad, round(speed_range_mps, 6) AS speed_range_mps, round(extent_x_m, 4) AS extent_x_m, round(extent_y_m, 4) AS extent_y_m FROM paths", "valid", recursive=_PATH))
def path_features(spark, d):
    return rounded(analysis.path_features(_valid(spark, d), TRACK, "sample_index"), 4, speed_range_mps=6)


_CANDIDATE = """ex AS (SELECT trajectory_id, count(*) AS exact_segments FROM (SELECT trajectory_id, lead(sample_index) OVER w AS ni, count(*) OVER (PARTITION BY trajectory_id, run_index) AS n FROM valid WINDOW w AS (PARTITION BY trajectory_id, run_index ORDER BY sample_index)) WHERE ni IS NOT NULL OR n = 1 GROUP BY ALL),
hy AS (SELECT trajectory_id, count(*) AS hybrid_segments, max(abs(s_x)) / 1000 AS pm, max(abs(s_y)) / 100 AS vm FROM segs GROUP BY ALL),
ev2 AS (SELECT trajectory_id, count(*) AS s, count(*) FILTER (event_index % 2 = 1) AS r, count(*) FILTER (event_index % 4 = 1) AS m, count(DISTINCT event_type) AS k FROM found GROUP BY ALL),
cand0 AS (SELECT p.*, exact_segments, hybrid_segments, pm AS position_maximum_m, vm AS velocity_maximum_mps, coalesce(s, 0) AS source_events, coalesce(r, 0) AS replay_events, coalesce(m, 0) AS matched_events, coalesce(k, 0) AS event_types FROM paths p JOIN ex USING (trajectory_id) JOIN hy USING (trajectory_id) LEFT JOIN ev2 USING (trajectory_id)),
candf AS (SELECT *, CAST(exact_segments - hybrid_segments AS DOUBLE) / exact_segments AS segment_reduction_ratio, CASE WHEN source_events + replay_events > 0 THEN 2.0 * matched_events / (source_events + replay_events) ELSE 1.0 END AS preservation_f1, sqrt(extent_x_m * extent_x_m + extent_y_m * extent_y_m) AS extent_m, source_events / greatest(path_length_m, 1.0) AS annotation_density FROM cand0)"""
_FAILED = ", ".join(f"CASE WHEN NOT coalesce({t}, false) THEN '{n}' END" for t, n in analysis.CLAUSES)


@query(
    sql(
        f"SELECT scenario_id, trajectory_id, exact_segments, hybrid_segments, source_events, replay_events, matched_events, event_types, round(segment_reduction_ratio, 6) AS segment_reduction_ratio, round(preservation_f1, 6) AS preservation_f1, round(extent_m, 4) AS extent_m, round(annotation_density, 5) AS annotation_density, list_filter([{_FAILED}], lambda x: x IS NOT NULL) AS failures FROM candf",
        "segs", "found", "valid", recursive=_PATH + ",\n" + _CANDIDATE,
    )
)
def candidate_features(spark, d):
    v, segs, found = _valid(spark, d), _segments(spark, d), _events(spark, d)
    exact = sequence.exact_segments(v).groupBy(*TRACK).agg(F.count("*").alias("exact_segments"))
    hybrid = segs.groupBy(*TRACK).agg(F.count("*").alias("hybrid_segments"), (F.max(F.abs("start_x_m")) / 1000).alias("position_maximum_m"), (F.max(F.abs("start_y_m")) / 100).alias("velocity_maximum_mps"))
    counts = found.groupBy(*TRACK, "event_type").agg(F.count("*").alias("source"), F.count_if(F.col("event_index") % 2 == 1).alias("replay"), F.count_if(F.col("event_index") % 4 == 1).alias("matched"))
    c = analysis.eligibility_failures(analysis.candidate_features(analysis.path_features(v, TRACK, "sample_index"), exact, hybrid, counts, TRACK))
    return rounded(c.select(*TRACK, "exact_segments", "hybrid_segments", "source_events", "replay_events", "matched_events", "event_types", "segment_reduction_ratio", "preservation_f1", "extent_m", "annotation_density", "failures"), extent_m=4, annotation_density=5)


# --- waypoints and states ----------------------------------------------------------------------------------------

_WAYS = f"""ways0 AS (SELECT scenario_id, trajectory_id, 'run_start' AS waypoint_role, start_index AS sample_index, start_time_ns AS timestamp_ns, CAST(NULL AS VARCHAR) AS event_id FROM runs UNION ALL SELECT scenario_id, trajectory_id, 'run_end', end_index, end_time_ns, NULL FROM runs
 UNION ALL SELECT scenario_id, trajectory_id, 'track_start', min(start_index), min(start_time_ns), NULL FROM runs GROUP BY ALL UNION ALL SELECT scenario_id, trajectory_id, 'track_end', max(end_index), max(end_time_ns), NULL FROM runs GROUP BY ALL)"""


@query(sql("SELECT w.scenario_id, w.trajectory_id, count(*) AS waypoints, count(*) FILTER (l.trajectory_id IS NULL) AS unresolved, round(max(sqrt((r_x - x_m) * (r_x - x_m) + (r_y - y_m) * (r_y - y_m) + (coalesce(r_z, 0) - coalesce(z_m, 0)) * (coalesce(r_z, 0) - coalesce(z_m, 0)))), 6) AS maximum_position_error_m, round(coalesce(max(sqrt((r_vx - velocity_x_mps) * (r_vx - velocity_x_mps) + (r_vy - velocity_y_mps) * (r_vy - velocity_y_mps))), 0.0), 6) AS maximum_velocity_error_mps FROM ways0 w LEFT JOIN replayed l ON l.trajectory_id = w.trajectory_id AND l.sample_index = w.sample_index GROUP BY ALL", "replayed", "runs", recursive=_WAYS))
def waypoint_replay(spark, d):
    """Of the ends of tracks and runs."""
    v = _valid(spark, d)
    ends = events.waypoints(v, _events(spark, d)).where("event_id is null")
    return rounded(events.waypoint_replay(ends, v, _segments(spark, d)).drop("position_errors_m", "velocity_errors_mps"))


@query(sql("SELECT scenario_id, trajectory_id, waypoint_role, sample_index, CAST(row_number() OVER (PARTITION BY trajectory_id, waypoint_role ORDER BY timestamp_ns, sample_index) - 1 AS INTEGER) AS role_ordinal, 'semantic-waypoint:' || sha256('tape|' || scenario_id || '|' || trajectory_id || '|' || waypoint_role || '|' || sample_index || '||' || (row_number() OVER (PARTITION BY trajectory_id, waypoint_role ORDER BY timestamp_ns, sample_index) - 1)) AS waypoint_id FROM ways0", "runs", recursive=_WAYS))
def waypoint_ids(spark, d):
    ends = events.waypoints(_valid(spark, d), _events(spark, d)).where("event_id is null")
    return events.waypoint_ids(ends, "tape").select(*TRACK, "waypoint_role", "sample_index", "role_ordinal", "waypoint_id")


@query(sql("SELECT scenario_id, trajectory_id, i AS sample_index, round(min(x), 6) AS x_m, round(min(y), 6) AS y_m, count(DISTINCT (x, y)) > 1 AS conflict FROM (SELECT scenario_id, trajectory_id, s_i AS i, s_x AS x, s_y AS y FROM segs UNION ALL SELECT scenario_id, trajectory_id, e_i, e_x, e_y FROM segs) GROUP BY ALL", "segs"))
def endpoint_states(spark, d):
    return rounded(replay.endpoint_states(_segments(spark, d)).select(*TRACK, "sample_index", "x_m", "y_m", "conflict"))


# --- problems that are planted -----------------------------------------------------------------------------------

_BROKEN = """broken AS (SELECT *, CASE WHEN (segment_index + run_index) % 11 = 5 THEN e_i + 1 ELSE e_i END AS b_i, CASE WHEN (segment_index + run_index) % 13 = 7 THEN s_t - 1 ELSE e_t END AS b_t FROM segs),
chained AS (SELECT *, row_number() OVER w - 1 AS place, lag(b_i) OVER w AS before, lag(e_z) OVER w AS bz FROM broken WINDOW w AS (PARTITION BY trajectory_id, run_index ORDER BY segment_index))"""


@query(sql("SELECT scenario_id, trajectory_id, run_index, segment_index, problem FROM (SELECT *, CASE WHEN segment_index <> place THEN 'number' WHEN NOT (s_i = before OR (s_i = before + 1 AND (s_z IS NULL) <> (bz IS NULL))) THEN 'break' WHEN b_t < s_t THEN 'time' WHEN (s_z IS NULL) <> (e_z IS NULL) THEN 'elevation' END AS problem FROM chained) WHERE problem IS NOT NULL", "segs", recursive=_BROKEN))
def broken_chains(spark, d):
    """Segments whose ends and times were moved here and there."""
    k = F.col("segment_index") + F.col("run_index")
    segs = _segments(spark, d).withColumns({"end_sample_index": F.when(k % 11 == 5, F.col("end_sample_index") + 1).otherwise(F.col("end_sample_index")), "end_time_ns": F.when(k % 13 == 7, F.col("start_time_ns") - 1).otherwise(F.col("end_time_ns"))})
    return validate.segment_chain_problems(segs)


@query(sql("SELECT scenario_id, trajectory_id, sample_index, round(pe, 6) AS position_error_m FROM errs WHERE pe > 30 + 1e-9 OR coalesce(ve > 40 + 1e-9, false)", "errs"))
def bounds_exceeded(spark, d):
    """Stride-5 keyframes promise no bound; samples beyond one are found."""
    e = metrics.errors(_valid(spark, d), _segments(spark, d))
    return rounded(validate.bound_problems(e, 30.0, 40.0).select(*TRACK, "sample_index", "position_error_m"))


@query("SELECT c_custkey AS scenario_id, CASE WHEN c_nationkey % 2 IS DISTINCT FROM nullif(c_custkey % 3, 2) THEN 'kind' WHEN c_mktsegment IS DISTINCT FROM CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END THEN 'segment' END AS field FROM customer WHERE c_nationkey % 2 IS DISTINCT FROM nullif(c_custkey % 3, 2) OR c_custkey % 5 = 0")
def frame_mismatches(spark, d):
    c = read(spark, d, "customer")
    a = c.select(F.col("c_custkey").alias("scenario_id"), (F.col("c_nationkey") % 2).cast("long").alias("kind"), F.col("c_mktsegment").alias("segment"))
    b = c.select(F.col("c_custkey").alias("scenario_id"), F.nullif(F.col("c_custkey") % 3, F.lit(2)).cast("long").alias("kind"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"))
    return validate.frame_mismatches(a, b, ("kind", "segment"))


@query("SELECT p_partkey AS map_element_id, CASE WHEN p_partkey % 7 = 3 THEN 'element_type' WHEN p_partkey % 6 = 1 THEN 'own_neighbour' WHEN p_size % 5 = 0 THEN 'repeated_neighbour' WHEN p_partkey % 4 = 2 THEN 'geometry_type' END AS problem FROM part WHERE p_partkey % 7 = 3 OR p_partkey % 6 = 1 OR p_size % 5 = 0 OR p_partkey % 4 = 2")
def map_element_problems(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    name = k.cast("string")
    point = F.struct(k.cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(None).cast("double").alias("z"))
    e = read(spark, d, "part").select(
        F.lit("s").alias("scenario_id"), name.alias("map_element_id"), F.when(k % 7 == 3, "river").otherwise("lane_centerline").alias("element_type"), F.when(k % 4 == 2, "polygon").otherwise("linestring").alias("geometry_type"),
        F.when(size % 5 == 0, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x"))).alias("successor_ids"), F.array().cast("array<string>").alias("predecessor_ids"),
        F.when(k % 6 == 1, name).otherwise(F.lit("y")).alias("left_neighbor_id"), F.lit(None).cast("string").alias("right_neighbor_id"), providers.wkb_linestring(F.array(point, point)).alias("geometry_wkb"),
    )
    return validate.map_element_problems(e).select(F.col("map_element_id").cast("long").alias("map_element_id"), "problem")


@query("SELECT s_suppkey AS member_id, CASE WHEN s_suppkey % 5 = 0 THEN 'unknown_template' WHEN s_suppkey % 9 = 4 THEN 'index' END AS problem FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 9 = 4")
def membership_problems(spark, d):
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey")
    one = s.select(F.concat(F.lit("t"), k.cast("string")).alias("template_id"), k.alias("member_id"), F.when(k % 9 == 4, 3).otherwise(0).alias("member_index"))
    known = s.where("s_suppkey % 5 <> 0").select(F.concat(F.lit("t"), k.cast("string")).alias("template_id"), F.lit(1).cast("long").alias("member_count"))
    return validate.membership_problems(known, one).select("member_id", "problem")


# --- tiles and lines ---------------------------------------------------------------------------------------------


@query(sql("SELECT scenario_id, trajectory_id, run_index, points, round(length_m, 5) AS length_m, round(first_x, 6) AS first_x, elevated FROM (SELECT l.scenario_id, l.trajectory_id, l.run_index, l.length_m, count(*) AS points, arg_min(v.x_m, v.sample_index) + 1000 AS first_x, count(v.z_m) = count(*) AS elevated FROM lengths l JOIN valid v ON v.trajectory_id = l.trajectory_id AND v.run_index = l.run_index GROUP BY ALL HAVING count(*) > 1)", "lengths", "valid"))
def source_lines(spark, d):
    g = spatial.source_lines(_valid(spark, d), F.lit(1000.0), F.lit(0.0))
    step = lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
    length = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: step(F.col("line")[i - 1], F.col("line")[i])), F.lit(0.0), lambda s, x: s + x)
    return rounded(g.select(*TRACK, "run_index", F.size("line").cast("long").alias("points"), length.alias("length_m"), F.col("line")[0]["x"].alias("first_x"), F.col("line")[0]["z"].isNotNull().alias("elevated")), 6, length_m=5)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS utc FROM orders")
def utc_times(spark, d):
    from ..functions.identity import utc_text

    return read(spark, d, "orders").select("o_orderkey", utc_text(F.col("o_orderdate")).alias("utc"))
