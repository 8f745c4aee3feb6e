"""Queries over analogue retrieval. The SQL twins pair every item with every candidate; the Spark side does not."""

from pyspark.sql import functions as F

from scorefold.functions import columns as C
from scorefold.operators import panel as P
from scorefold.operators import retrieve as R
from scorefold.operators import scores as S
from scorefold.plans.audit import FEAT_SQL
from scorefold.plans.cohort import md5_int
from scorefold.plans.panel import KEY_SQL, PICKS, band_sql, runs
from scorefold.plans.registry import query
from scorefold.plans.resample import draws_sql
from scorefold.session import checkpointed
from scorefold.sources import standins as V

SEED = 7


def with_classes(df, today="today"):
    return R.change_components(df.withColumns({"band": C.band_key("acres", "pct", today), "pers_band": C.band(today, C.PERS_EDGES)}), today)


def pool(spark, sf, panel=None):
    return with_classes(P.day_pairs(runs(spark, sf) if panel is None else panel))


def items(spark, sf, panel=None):
    it = P.group_mean_scale(P.build_items(runs(spark, sf) if panel is None else panel), "incident_id", "target")
    n = F.size("personnel_last_days")
    it = it.withColumns({"today": F.col("persistence"), "prev": F.get("personnel_last_days", n - 2), "prev2": F.get("personnel_last_days", n - 3), "acres_prev": F.get("acres_last_days", n - 2)})
    return with_classes(it)


def sides(spark, sf):
    """(items, pool) over one panel: the runs and the items are written once, however often a query reads them."""
    panel = checkpointed(runs(spark, sf))
    return checkpointed(items(spark, sf, panel)), pool(spark, sf, panel)


def drawable(pool, *keys):
    """What draws need of the pool."""
    return pool.select("analogue_id", "incident_id", "report_date", "today", "next", *keys)


ITEMS_P = V.PAIRS + ", " + PICKS + f""",
pool AS (SELECT *, {KEY_SQL} || '|' || {band_sql('today', C.PERS_EDGES)} AS band, {band_sql('today', C.PERS_EDGES)} AS pers_band, next / greatest(today, 1) AS x FROM (SELECT * FROM (SELECT *, 0 AS z FROM pairs))),
it0 AS (SELECT 'alloc-' || incident_id || '-' || CAST(report_date AS VARCHAR) AS item_id, incident_id, report_date, round_even(nxt, 0) AS target, round_even(personnel, 0) AS persistence, round_even(personnel, 0) AS today,
 round_even(prv, 0) AS prev, round_even(prv2, 0) AS prev2, day_of_run, acres, acres_prv AS acres_prev, pct, new_acres, aerial FROM picks),
it AS (SELECT *, {KEY_SQL} || '|' || {band_sql('today', C.PERS_EDGES)} AS band, {band_sql('today', C.PERS_EDGES)} AS pers_band, avg(target) OVER (PARTITION BY incident_id) AS scale FROM it0)"""
c3 = lambda r: f"CASE WHEN {r} IS NULL THEN 'u' WHEN {r} < 1 - 0.1::DOUBLE THEN 'f' WHEN {r} > 1 + 0.1::DOUBLE THEN 'r' ELSE 'h' END"
c5 = lambda r: f"CASE WHEN {r} IS NULL THEN 'u' WHEN {r} < 0.75 THEN 'F' WHEN {r} < 1 - 0.1::DOUBLE THEN 'f' WHEN {r} > 1.25 THEN 'R' WHEN {r} > 1 + 0.1::DOUBLE THEN 'r' ELSE 'h' END"
RT = lambda p: f"(CASE WHEN {p} IS NOT NULL THEN today / greatest({p}, 1) END)"
ELIG = ITEMS_P + """,
el AS (SELECT it.item_id, it.band AS iband, p.* FROM it JOIN pool p ON p.incident_id <> it.incident_id AND p.report_date + 1 < it.report_date)"""


def floyd_sql(src, key_cols, size, k, ident, seed, out):
    """CTEs that unroll the seeded draw of up to k positions (k a column, at most six)."""
    base = f"{out}0 AS (SELECT {key_cols}, {size} AS m, least({k}, {size}) AS kk, CAST([] AS BIGINT[]) AS s FROM {src})"
    steps = [base]
    for i in range(6):
        h = f"({md5_int(chr(39) + str(seed) + chr(39), ident, chr(39) + str(i) + chr(39))} % (m - kk + {i} + 1))"
        steps.append(f"{out}{i + 1} AS (SELECT {key_cols}, m, kk, CASE WHEN {i} < kk THEN list_append(s, CASE WHEN list_contains(s, {h}) THEN m - kk + {i} ELSE {h} END) ELSE s END AS s FROM {out}{i})")
    return ",\n".join(steps) + f",\n{out} AS (SELECT {key_cols}, m, kk, s FROM {out}6)"


@query("eligible_pairs", f"WITH {ELIG} SELECT it.item_id, count(el.analogue_id) AS eligible FROM it LEFT JOIN el ON it.item_id = el.item_id AND el.band = it.band GROUP BY it.item_id")
def _(spark, sf):
    return R.eligible_counts(items(spark, sf).select("item_id", "incident_id", "report_date", "band"), pool(spark, sf), "band").select("item_id", "eligible")


BAND_DRAW = ELIG + """, eb AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY report_date, analogue_id) - 1 AS idx FROM el WHERE band = iband),
cnt AS (SELECT item_id, count(*) AS m0 FROM eb GROUP BY item_id), """ + floyd_sql("cnt", "item_id", "m0", "6", "item_id", SEED, "fl") + """,
dr AS (SELECT eb.item_id, eb.analogue_id, eb.incident_id AS analogue_incident, eb.today, eb.next, eb.x, eb.band FROM eb JOIN fl ON eb.item_id = fl.item_id AND list_contains(fl.s, eb.idx))"""


def band_draws(spark, sf, both=None):
    it, p = sides(spark, sf) if both is None else both
    return checkpointed(R.draw_by_key(it, drawable(p, "band"), "band", 6, SEED))


@query("retrieve_band", f"WITH {BAND_DRAW} SELECT item_id, analogue_id, today, next FROM dr")
def _(spark, sf):
    return band_draws(spark, sf).select("item_id", "analogue_id", "today", "next")


PRED = BAND_DRAW + """, pr0 AS (SELECT it.*, coalesce(g.drawn, 0) AS drawn, coalesce(g.med, 1.0) AS median_ratio, g.sm AS share_moved FROM it LEFT JOIN (SELECT item_id, count(*) AS drawn, median(x) AS med, avg(CAST(abs(x - 1) > 0.1 AS INTEGER)) AS sm FROM dr GROUP BY item_id) g ON it.item_id = g.item_id),
pr AS (SELECT *, persistence * median_ratio AS prediction FROM pr0)"""


def predicted(spark, sf, both=None):
    both = sides(spark, sf) if both is None else both
    return checkpointed(R.analogue_prediction(both[0], band_draws(spark, sf, both)))


@query("analogue_prediction", f"WITH {PRED} SELECT item_id, drawn, round(median_ratio, 6) AS median_ratio, round(share_moved, 6) AS share_moved, round(prediction, 6) AS prediction, round_even(persistence * CAST(printf('%.2f', median_ratio) AS DOUBLE), 0) AS prediction_displayed, floor(persistence * median_ratio + 0.5) AS prediction_half_up FROM pr")
def _(spark, sf):
    return S.rounded(predicted(spark, sf).select("item_id", "drawn", "median_ratio", "share_moved", "prediction", "prediction_displayed", "prediction_half_up"))


@query("evaluate_rule", f"""WITH {PRED}, m AS (SELECT *, abs(target - persistence) / greatest(persistence, 1) > 0.1 AS t, abs(prediction - persistence) / greatest(persistence, 1) > 0.1 AS p, abs(target - prediction) / scale AS e, 'band' AS rule FROM pr),
u AS (SELECT sum(r) - count(*) * (count(*) + 1) / 2.0 AS u, count(*) AS n1 FROM (SELECT t, rank() OVER (ORDER BY share_moved) + (count(*) OVER (PARTITION BY share_moved) - 1) / 2.0 AS r FROM m WHERE share_moved IS NOT NULL) WHERE t), z AS (SELECT count(*) AS n0 FROM m WHERE share_moved IS NOT NULL AND NOT t)
SELECT rule, count(*) AS items, round(avg(CAST(drawn >= 1 AS INTEGER)), 6) AS coverage_1, round(avg(CAST(drawn >= 3 AS INTEGER)), 6) AS coverage_3, round(avg(drawn), 6) AS mean_drawn, round(avg((share_moved - CAST(t AS INTEGER)) ** 2), 6) AS move_brier, round(avg(e), 6) AS scaled_error,
round(avg(e) FILTER (NOT t), 6) AS stable_error, round(avg(e) FILTER (t), 6) AS moving_error, round(avg(CAST(p AS INTEGER)) FILTER (NOT t), 6) AS false_move, round(avg(CAST(NOT p AS INTEGER)) FILTER (t), 6) AS missed_move,
round(avg(CAST(sign(target - persistence) = sign(prediction - persistence) AS INTEGER)) FILTER (t), 6) AS direction_right, round(avg(CAST(e < abs(target - persistence) / scale AS INTEGER)), 6) AS beats_persistence_scaled,
round(quantile_cont(median_ratio, 0.25), 6) AS ratio_q25, round(quantile_cont(median_ratio, 0.75), 6) AS ratio_q75, round((SELECT u / (n1 * n0) FROM u, z), 6)::DOUBLE AS move_auc FROM m GROUP BY rule""")
def _(spark, sf):
    return S.rounded(R.evaluate_rule(predicted(spark, sf).withColumn("rule", F.lit("band")), ["rule"]))


@query("attach_analogue_values", f"WITH {BAND_DRAW} SELECT item_id, count(*) AS recorded, count(*) AS resolved, round(sum(x), 6) AS ratio_sum FROM dr GROUP BY item_id")
def _(spark, sf):
    from scorefold.operators.joins import attach_analogue_values

    log = band_draws(spark, sf).groupBy("item_id").agg(F.collect_list("analogue_id").alias("analogue_ids"))
    v = attach_analogue_values(log, pool(spark, sf).select("analogue_id", "today", "next"))
    return v.groupBy("item_id").agg(F.count(F.lit(1)).alias("recorded"), F.count("today").alias("resolved"), F.round(F.sum(R.outcome_ratio()), 6).alias("ratio_sum"))


# --- ladder -----------------------------------------------------------------------------------------------------------
def ladder_levels(second, third):
    """Depth to which pool rows match an item on the band, a second and a third component."""
    return ITEMS_P + f""",
lp AS (SELECT *, {second} AS k2, {third} AS k3 FROM pool), li AS (SELECT *, {second} AS k2, {third} AS k3 FROM it),
le AS (SELECT i.item_id, p.analogue_id, p.report_date, 1 + CAST(p.k2 = i.k2 AS INTEGER) + CAST(p.k2 = i.k2 AND p.k3 = i.k3 AS INTEGER) AS depth FROM li i JOIN lp p ON p.band = i.band AND p.incident_id <> i.incident_id AND p.report_date + 1 < i.report_date),
lc AS (SELECT item_id, count(*) AS n1, count(*) FILTER (depth >= 2) AS n2, count(*) FILTER (depth >= 3) AS n3 FROM le GROUP BY item_id)"""


LAD = ladder_levels(c3(RT("prev2")), c5(RT("prev")))
SERVED = """, ll AS (SELECT item_id, CASE WHEN n3 >= 3 THEN 3 WHEN n2 >= 3 THEN 2 ELSE 1 END AS lvl FROM lc),
lx AS (SELECT le.*, row_number() OVER (PARTITION BY le.item_id ORDER BY report_date, analogue_id) - 1 AS idx FROM le JOIN ll ON le.item_id = ll.item_id WHERE depth >= lvl),
lm AS (SELECT item_id, count(*) AS m0 FROM lx GROUP BY item_id), """ + floyd_sql("lm", "item_id", "m0", "6", "item_id", SEED, "fl")
LADDER = LAD + SERVED
STREAK = ladder_levels(
    f"CASE WHEN prev IS NULL THEN 'u' WHEN today = prev THEN CASE WHEN prev2 = today THEN 'ee' ELSE 'e' END WHEN {c3(RT('prev'))} = 'h' THEN 's' ELSE {c3(RT('prev'))} END",
    "CASE WHEN acres IS NOT NULL AND acres_prev IS NOT NULL THEN CASE WHEN acres > acres_prev THEN 'y' ELSE 'n' END WHEN new_acres IS NOT NULL THEN CASE WHEN new_acres > 0 THEN 'y' ELSE 'n' END ELSE 'u' END") + SERVED


@query("retrieve_ladder", f"WITH {LADDER} SELECT lx.item_id, analogue_id FROM lx JOIN fl ON lx.item_id = fl.item_id AND list_contains(s, idx)")
def _(spark, sf):
    return R.LADDERS["ladder"].draw(items(spark, sf), pool(spark, sf), 6, SEED).select("item_id", "analogue_id")


FILL = LAD + """, lb AS (SELECT item_id, CASE WHEN n3 >= 6 THEN 3 WHEN n2 >= 6 THEN 2 ELSE 1 END AS base FROM lc),
inner_ AS (SELECT le.item_id, analogue_id FROM le JOIN lb ON le.item_id = lb.item_id WHERE depth > base),
ic AS (SELECT item_id, count(*) AS c FROM inner_ GROUP BY item_id),
ox AS (SELECT le.*, row_number() OVER (PARTITION BY le.item_id ORDER BY report_date, analogue_id) - 1 AS idx FROM le JOIN lb ON le.item_id = lb.item_id WHERE depth = base),
om AS (SELECT ox.item_id, count(*) AS m0, 6 - coalesce(max(c), 0) AS need FROM ox LEFT JOIN ic ON ox.item_id = ic.item_id GROUP BY ox.item_id), """ + floyd_sql("om", "item_id", "m0", "need", "item_id", SEED + 1, "fl")


@query("retrieve_ladder_fill", f"WITH {FILL} SELECT ox.item_id, analogue_id FROM ox JOIN fl ON ox.item_id = fl.item_id AND list_contains(s, idx) UNION ALL SELECT item_id, analogue_id FROM inner_")
def _(spark, sf):
    return R.LADDERS["ladder_fill"].draw(items(spark, sf), pool(spark, sf), 6, SEED).select("item_id", "analogue_id")


@query("retrieve_ladder_streak", f"WITH {STREAK} SELECT lx.item_id, analogue_id FROM lx JOIN fl ON lx.item_id = fl.item_id AND list_contains(s, idx)")
def _(spark, sf):
    return R.LADDERS["ladder_streak"].draw(items(spark, sf), pool(spark, sf), 6, SEED).select("item_id", "analogue_id")


# --- nearest ----------------------------------------------------------------------------------------------------------
Z = [f.replace("f_", "") for f in R.FEATURES]
NEAR = ITEMS_P + f""",
pf AS (SELECT *, {FEAT_SQL} FROM pool), itf AS (SELECT *, {FEAT_SQL} FROM it),
sc AS (SELECT """ + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}, count({f}) AS n_{f}" for f in R.FEATURES) + """ FROM pf WHERE report_date < DATE '2024-01-20'),
pz AS (SELECT pf.*, """ + ", ".join(f"coalesce((pf.{f} - m_{f}) / s_{f}, 0) AS z_{f}" for f in R.FEATURES) + """ FROM pf, sc),
iz AS (SELECT itf.*, """ + ", ".join(f"(itf.{f} - m_{f}) / s_{f} AS z_{f}" for f in R.FEATURES) + " FROM itf, sc)"


def near_sql(weights, scope, cap=None):
    d = " + ".join(f"CASE WHEN i.z_{f} IS NULL THEN 0 ELSE {w}::DOUBLE * (p.z_{f} - i.z_{f}) ** 2 END" for f, w in zip(R.FEATURES, weights))
    on = f"p.{scope} = i.{scope} AND " if scope else ""
    src = "nd"
    cte = f"{NEAR}, nd AS (SELECT i.item_id, p.analogue_id, p.incident_id, {d} AS distance FROM iz i JOIN pz p ON {on}p.incident_id <> i.incident_id AND p.report_date + 1 < i.report_date)"
    if cap:
        cte += f", nc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, incident_id ORDER BY distance, analogue_id) AS c FROM nd) WHERE c <= {cap})"
        src = "nc"
    return f"WITH {cte} SELECT item_id, analogue_id, round(distance, 6) AS distance, CAST(draw AS INTEGER) AS draw FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, analogue_id) AS draw FROM {src}) WHERE draw <= 6"


def nearest(name):
    rule = R.NEAREST[name]

    def run(spark, sf):
        it, p = sides(spark, sf)
        d = R.retrieve_nearest(it, p, R.fit_scales(p, "2024-01-20"), rule.scope, rule.weights, 6, rule.cap, [])
        return d.select("item_id", "analogue_id", F.round("distance", 6).alias("distance"), "draw")

    return run


for _name, _rule in R.NEAREST.items():
    query(f"retrieve_{_name}", near_sql(_rule.weights, _rule.scope, _rule.cap))(nearest(_name))


@query("fit_scales", f"WITH {NEAR} SELECT " + ", ".join(f"round(m_{f}, 6) AS mean_{f}, round(s_{f}, 6) AS sd_{f}, n_{f}" for f in R.FEATURES) + " FROM sc")
def _(spark, sf):
    return S.rounded(R.fit_scales(pool(spark, sf), "2024-01-20"))


# --- a rule against another -------------------------------------------------------------------------------------------
def predicted_sql(draws):
    """Scaled error per item of draws (item_id, x)."""
    return f"""dq AS ({draws}), pr0 AS (SELECT it.*, coalesce(g.med, 1.0) AS median_ratio FROM it LEFT JOIN (SELECT item_id, median(x) AS med FROM dq GROUP BY item_id) g ON it.item_id = g.item_id)
SELECT item_id, incident_id, report_date, abs(target - persistence * median_ratio) / scale AS e FROM pr0"""


AGAINST = f"""ra AS (WITH {LADDER}, {predicted_sql('SELECT lx.item_id, pool.x FROM lx JOIN fl ON lx.item_id = fl.item_id AND list_contains(s, idx) JOIN pool ON pool.analogue_id = lx.analogue_id')}),
rb AS (WITH {BAND_DRAW}, {predicted_sql('SELECT item_id, x FROM dr')}), ab AS (SELECT ra.item_id, ra.incident_id, ra.report_date, ra.e, rb.e AS r, 1 AS one FROM ra JOIN rb ON ra.item_id = rb.item_id)"""


def ladder_draws(spark, sf, both):
    rule = R.LADDERS["ladder"]
    return checkpointed(rule.draw(both[0], drawable(both[1], *rule.components), 6, SEED))


def against(spark, sf):
    both = sides(spark, sf)
    ladder = R.analogue_prediction(both[0], ladder_draws(spark, sf, both))
    return checkpointed(R.against_reference(ladder, predicted(spark, sf, both)))


@query("rule_difference", f"""WITH {AGAINST}, {draws_sql('ab', ['one'], 'incident_id', 11, 2000)}, c AS (SELECT one, incident_id, sum(e) AS se, sum(r) AS sr, count(*) AS n FROM ab GROUP BY ALL),
bv AS (SELECT rep, (sum(w * se) - sum(w * sr)) / sum(w * n) AS v FROM c JOIN w ON w.incident_id = c.incident_id GROUP BY rep), iv AS (SELECT quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM bv)
SELECT count(*) AS items, round(avg(e), 6) AS error, round(avg(r), 6) AS reference_error, round(avg(e) - avg(r), 6) AS difference, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, CAST(any_value(hi) < 0 OR any_value(lo) > 0 AS INTEGER) AS excludes_zero FROM ab, iv""")
def _(spark, sf):
    return S.rounded(R.rule_difference(against(spark, sf), 2_000, 11)).drop("one")


@query("error_by_period", f"WITH {AGAINST} SELECT CASE WHEN report_date < DATE '2024-01-20' THEN 'before' ELSE 'from' END AS period, count(*) AS items, round(avg(e), 6) AS error, round(avg(r), 6) AS reference_error, round(avg(e - r), 6) AS difference FROM ab GROUP BY ALL")
def _(spark, sf):
    return S.rounded(R.error_by_period(against(spark, sf), "2024-01-20"))


@query("served_levels", f"WITH {LADDER}, n AS (SELECT lx.item_id, any_value(lvl) AS level, count(*) AS drawn FROM lx JOIN fl ON lx.item_id = fl.item_id AND list_contains(s, idx) JOIN ll ON ll.item_id = lx.item_id GROUP BY lx.item_id) SELECT coalesce(level, 0) AS level, count(*) AS items, round(avg(coalesce(drawn, 0)), 6) AS mean_drawn FROM it LEFT JOIN n ON n.item_id = it.item_id GROUP BY 1")
def _(spark, sf):
    both = sides(spark, sf)
    return S.rounded(R.served_levels(both[0], ladder_draws(spark, sf, both)))


NN = R.NEAREST["nn_pers_chg"]


@query("draw_diagnostics", f"WITH nn AS ({near_sql(NN.weights, NN.scope, NN.cap)}), {ITEMS_P} SELECT nn.item_id, count(*) AS drawn, count(DISTINCT p.incident_id) AS incidents, round(avg(CAST(p.band = it.band AS INTEGER)), 6) AS in_band, CAST(max(p.report_date) AS VARCHAR) AS newest FROM nn JOIN pool p ON p.analogue_id = nn.analogue_id JOIN it ON it.item_id = nn.item_id GROUP BY nn.item_id")
def _(spark, sf):
    it, p = sides(spark, sf)
    drawn = R.retrieve_nearest(it, p, R.fit_scales(p, "2024-01-20"), NN.scope, NN.weights, 6, NN.cap, ["band"])
    d = R.draw_diagnostics(it, drawn, "band")
    return S.rounded(d.withColumn("newest", F.col("newest").cast("string")))


# --- quota ------------------------------------------------------------------------------------------------------------
def day_band(c):
    return C.band(c, R.DOR_EDGES)


PH = ITEMS_P + f""", tr AS (SELECT *, {band_sql('day_of_run', R.DOR_EDGES)} AS day_band, {band_sql('pct', C.PCT_EDGES)} AS pct_band, abs(x - 1) > 0.1 AS moved FROM pool WHERE prev IS NOT NULL AND report_date < DATE '2024-01-20' AND run_length >= 5),
gr AS (SELECT avg(CAST(moved AS INTEGER)) AS g FROM tr), ph AS (SELECT day_band, pct_band, count(*) AS n, sum(CAST(moved AS INTEGER)) AS moved_n, (sum(CAST(moved AS INTEGER)) + 20 * max(g)) / (count(*) + 20) AS p_move FROM tr, gr GROUP BY ALL)"""


def training(spark, sf, p=None):
    t = R.training_rows(pool(spark, sf) if p is None else p, "2024-01-20", 5)
    return t.withColumns({"day_band": day_band("day_of_run"), "pct_band": C.band("pct", C.PCT_EDGES), "moved": F.abs(R.outcome_ratio() - 1) > R.MOVE})


def phase(spark, sf):
    return R.phase_table(training(spark, sf), "day_band", "pct_band", F.col("moved"))


@query("training_rows", f"WITH {PH} SELECT day_band, pct_band, count(*) AS n, round(avg(x), 6) AS mean_ratio FROM tr GROUP BY ALL")
def _(spark, sf):
    return training(spark, sf).groupBy("day_band", "pct_band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(R.outcome_ratio()), 6).alias("mean_ratio"))


@query("phase_table", f"WITH {PH} SELECT day_band, pct_band, n, CAST(moved_n AS BIGINT) AS moved_n, round(p_move, 6) AS p_move FROM ph")
def _(spark, sf):
    return S.rounded(phase(spark, sf).select("day_band", "pct_band", "n", "moved_n", "p_move"))


QUOTA = PH + f""", qi AS (SELECT it.*, coalesce(ph.p_move, (SELECT g FROM gr)) AS p_move, CASE WHEN prev IS NULL THEN 0 ELSE sign(today - prev) END AS trend FROM it LEFT JOIN ph ON ph.day_band = {band_sql('it.day_of_run', R.DOR_EDGES)} AND ph.pct_band = {band_sql('it.pct', C.PCT_EDGES)}),
qn AS (SELECT *, CAST(greatest(0, least(6, floor(6 * p_move + 0.5))) AS BIGINT) AS n_move FROM qi),
qg AS (SELECT item_id, 'held' AS grp, 6 - n_move AS quota FROM qn UNION ALL SELECT item_id, CASE WHEN trend > 0 THEN 'up' WHEN trend < 0 THEN 'down' ELSE 'any' END, n_move FROM qn),
ps AS (SELECT *, CASE WHEN abs(x - 1) <= 0.1 THEN 'held' WHEN x > 1 THEN 'up' ELSE 'down' END AS stratum FROM pool),
qe AS (SELECT i.item_id, g.grp, g.quota, p.analogue_id, p.stratum, p.report_date, p.band || '#' || p.stratum AS seg, CASE WHEN p.band = i.band THEN 'p' ELSE 's' END AS side
 FROM qn i JOIN qg g ON g.item_id = i.item_id AND g.quota > 0 JOIN ps p ON p.pers_band = i.pers_band AND p.incident_id <> i.incident_id AND p.report_date + 1 < i.report_date AND (g.grp = p.stratum OR (g.grp = 'any' AND p.stratum IN ('up', 'down')))),
qx AS (SELECT *, row_number() OVER (PARTITION BY item_id, grp, side ORDER BY seg, report_date, analogue_id) - 1 AS idx FROM qe),
qc AS (SELECT item_id, grp, side, max(quota) AS quota, count(*) AS m0 FROM qx GROUP BY ALL),
qw AS (SELECT c.*, CASE WHEN side = 'p' THEN quota ELSE greatest(quota - coalesce((SELECT m0 FROM qc z WHERE z.item_id = c.item_id AND z.grp = c.grp AND z.side = 'p'), 0), 0) END AS need, item_id || '#' || grp || '#' || side AS sid FROM qc c),
""" + floyd_sql("qw", "item_id, grp, side, sid", "m0", "need", "sid", SEED, "fl")


def quota_items(it, rows):
    """Items with the move rate of their phase, fitted on the training rows."""
    it = it.withColumns({"day_band": day_band("day_of_run"), "pct_band": C.band("pct", C.PCT_EDGES), "trend": F.coalesce(F.signum(F.col("today") - F.col("prev")), F.lit(0.0))})
    ph = R.phase_table(rows, "day_band", "pct_band", F.col("moved"))
    rate = rows.agg(F.avg(F.col("moved").cast("double")).alias("__g"))
    return it.join(ph.select("day_band", "pct_band", "p_move"), ["day_band", "pct_band"], "left").crossJoin(F.broadcast(rate)).withColumn("p_move", F.coalesce("p_move", "__g"))


@query("retrieve_quota", f"WITH {QUOTA} SELECT qx.item_id, qx.grp, analogue_id FROM qx JOIN fl ON qx.item_id = fl.item_id AND qx.grp = fl.grp AND qx.side = fl.side AND list_contains(s, idx)")
def _(spark, sf):
    it, p = sides(spark, sf)
    it = quota_items(it, training(spark, sf, p))
    return R.retrieve_quota(it, drawable(p, "band", "pers_band"), "band", "pers_band", 6, SEED, "trend").select("item_id", "grp", "analogue_id")


@query("same_draws", f"WITH {BAND_DRAW} SELECT DISTINCT item_id, 1 AS same FROM dr")
def _(spark, sf):
    both = sides(spark, sf)
    return R.same_draws(band_draws(spark, sf, both), band_draws(spark, sf, both))


@query("select_rule", """WITH r AS (SELECT p_brand AS rule, avg(p_retailprice) AS scaled_error, avg(p_size) AS move_auc, count(*) AS parameters, max(p_size) AS false_move FROM part GROUP BY ALL),
ok AS (SELECT r.* FROM r, (SELECT * FROM r WHERE rule = 'Brand#1') ref WHERE r.move_auc >= ref.move_auc AND r.false_move <= ref.false_move)
SELECT rule, parameters, round(scaled_error, 6) AS scaled_error FROM ok WHERE scaled_error <= (SELECT min(scaled_error) FROM ok) + 20 ORDER BY parameters, scaled_error, rule LIMIT 1""")
def _(spark, sf):
    p = V.table(spark, sf, "part")
    r = p.groupBy(F.col("p_brand").alias("rule")).agg(F.avg("p_retailprice").alias("scaled_error"), F.avg("p_size").alias("move_auc"), F.count(F.lit(1)).alias("parameters"), F.max("p_size").alias("false_move"))
    return S.rounded(R.select_rule(r, "Brand#1", 20).select("rule", "parameters", "scaled_error"))
