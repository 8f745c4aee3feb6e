"""Queries over bootstrap intervals and tests. Draws are md5-based, so the SQL twins resample the very same clusters."""

from pyspark.sql import functions as F

from scorefold.operators import audit as A
from scorefold.operators import draws as D
from scorefold.operators import inference as I
from scorefold.operators import resample as R
from scorefold.operators import scores as S
from scorefold.operators import task as K
from scorefold.plans.audit import RESP, marked
from scorefold.plans.cohort import md5_int, paired, scored
from scorefold.plans.registry import query
from scorefold.plans.scores import B, FR, frame_calls, small_scores
from scorefold.sources import standins as V

REPS, SEED = 200, 17
FULL = 20_000  # replicates and draws of the reference
M = ["model"]


def draws_sql(src, by, cluster, seed=SEED, reps=REPS, out="w"):
    """CTEs: numbered clusters, draws and multiplicities w(by, rep, cluster, w)."""
    b = ", ".join(by)
    p = f"PARTITION BY {b} " if by else ""
    bc = f"{b}, " if by else ""
    jn = " AND ".join([f"d.{c} = k.{c}" for c in by] + ["d.idx = k.idx"])
    return f"""{out}_k AS (SELECT *, row_number() OVER ({p}ORDER BY {cluster}) - 1 AS idx, count(*) OVER ({p.strip()}) AS g FROM (SELECT DISTINCT {bc}{cluster} FROM {src})),
{out}_g AS (SELECT {bc}max(g) AS g FROM {out}_k {'GROUP BY ' + b if by else ''}),
{out}_d AS (SELECT {bc}rep, {md5_int(f"'{seed}'", *by, 'rep', 'j')} % g AS idx FROM (SELECT {bc}g, CAST(r.rep AS INTEGER) AS rep, unnest(range(g)) AS j FROM {out}_g CROSS JOIN range({reps}) r(rep))),
{out} AS (SELECT {', '.join('d.' + c for c in by) + ', ' if by else ''}d.rep, k.{cluster}, count(*) AS w FROM {out}_d d JOIN {out}_k k ON {jn} GROUP BY ALL)"""


LOHI = "quantile_cont({v}, 0.025) AS lo, quantile_cont({v}, 0.975) AS hi, count(*) - count({v}) AS dropped"


@query("cluster_draws", f"WITH {V.PAIRED}, {draws_sql('items', ['stratum'], 'cluster')} SELECT stratum, rep, cluster, w FROM w")
def _(spark, sf):
    return R.cluster_draws(V.paired_items(spark, sf), ["stratum"], "cluster", REPS, SEED)


PD = f"{V.PAIRED}, pd AS (SELECT *, CAST(a_said = label AS INTEGER) AS ca, CAST(b_said = label AS INTEGER) AS cb FROM paired)"


def correct_pairs(spark, sf):
    p = paired(spark, sf)
    return p.withColumns({"ca": (F.col("a_said") == F.col("label")).cast("int"), "cb": (F.col("b_said") == F.col("label")).cast("int")})


def boot_sql(expr_num, expr_den, point, by=("model",), cluster="cluster", src="pd", seed=SEED, reps=REPS):
    b = ", ".join(by)
    on = " AND ".join([f"c.{x} = w.{x}" for x in by] + [f"c.{cluster} = w.{cluster}"])
    return f"""{draws_sql(src, list(by), cluster, seed, reps)}, c AS (SELECT {b}, {cluster}, {expr_num} AS sn, {expr_den} AS sd FROM {src} GROUP BY ALL),
r AS (SELECT {', '.join('w.' + x for x in by)}, rep, sum(w * sn) / nullif(sum(w * sd), 0)::DOUBLE AS v FROM c JOIN w ON {on} GROUP BY ALL),
pt AS (SELECT {b}, {point} AS point FROM {src} GROUP BY ALL), iv AS (SELECT {b}, {LOHI.format(v='v')} FROM r GROUP BY ALL)"""


JOINED = "SELECT pt.model, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, dropped FROM pt JOIN iv ON pt.model = iv.model"
PAIRED_BOOT = f"WITH {PD}, {boot_sql('sum(cb) - sum(ca)', 'count(*)', 'avg(cb) - avg(ca)')}"


def paired_interval(spark, sf):
    return R.bootstrap(correct_pairs(spark, sf), M, "cluster", R.paired_difference(F.col("ca"), F.col("cb")), REPS, SEED)


@query("bootstrap_mean", f"{PAIRED_BOOT} {JOINED}")
def _(spark, sf):
    return S.rounded(paired_interval(spark, sf).select("model", "point", "lo", "hi", "dropped"))


@query("bootstrap_mean_full", f"WITH {PD}, {boot_sql('sum(cb) - sum(ca)', 'count(*)', 'avg(cb) - avg(ca)', reps=FULL)} {JOINED}")
def _(spark, sf):
    b = R.bootstrap(correct_pairs(spark, sf), M, "cluster", R.paired_difference(F.col("ca"), F.col("cb")), FULL, SEED)
    return S.rounded(b.select("model", "point", "lo", "hi", "dropped"))


@query("bootstrap_ratio", f"WITH {V.PAIRED}, {boot_sql('sum(b_score)', 'sum(a_score)', 'sum(b_score) / sum(a_score)', src='paired')} {JOINED}")
def _(spark, sf):
    b = R.bootstrap(paired(spark, sf), M, "cluster", R.ratio(F.col("b_score"), F.col("a_score")), REPS, SEED)
    return S.rounded(b.select("model", "point", "lo", "hi", "dropped"))


@query("bootstrap_rate_on_subset", f"WITH {PD}, fp AS (SELECT * FROM pd), {boot_sql('sum(b_said - a_said) FILTER (label = 0 AND stratum = ' + chr(39) + 'de' + chr(39) + ')', 'coalesce(count(*) FILTER (label = 0 AND stratum = ' + chr(39) + 'de' + chr(39) + '), 0)', 'avg(b_said - a_said) FILTER (label = 0 AND stratum = ' + chr(39) + 'de' + chr(39) + ')')} {JOINED}")
def _(spark, sf):
    stat = R.paired_difference(F.col("a_said"), F.col("b_said"), (F.col("label") == 0) & (F.col("stratum") == "de"))
    return S.rounded(R.bootstrap(correct_pairs(spark, sf), M, "cluster", stat, REPS, SEED).select("model", "point", "lo", "hi", "dropped"))


AP_REP = """{x}h AS (SELECT w.model, rep, p.{x} AS s, sum(w * p.n * label) AS pos, sum(w * p.n) AS n FROM (SELECT model, cluster, {x}, label, count(*) AS n FROM paired GROUP BY ALL) p JOIN w ON p.model = w.model AND p.cluster = w.cluster GROUP BY ALL),
{x}r AS (SELECT *, sum(pos) OVER v AS tp, sum(n) OVER v AS seen, sum(pos) OVER (PARTITION BY model, rep) AS np FROM {x}h WINDOW v AS (PARTITION BY model, rep ORDER BY s DESC)), {x}a AS (SELECT model, rep, sum(pos / nullif(np, 0)::DOUBLE * tp / seen::DOUBLE) AS ap FROM {x}r GROUP BY ALL),
{x}ph AS (SELECT model, {x} AS s, sum(label) AS pos, count(*) AS n FROM paired GROUP BY ALL), {x}pr AS (SELECT *, sum(pos) OVER v AS tp, sum(n) OVER v AS seen, sum(pos) OVER (PARTITION BY model) AS np FROM {x}ph WINDOW v AS (PARTITION BY model ORDER BY s DESC)),
{x}p AS (SELECT model, sum(pos / np::DOUBLE * tp / seen::DOUBLE) AS ap FROM {x}pr GROUP BY ALL)"""


@query("bootstrap_ap", f"""WITH {V.PAIRED}, {draws_sql('paired', M, 'cluster')}, {AP_REP.format(x='a_score')}, {AP_REP.format(x='b_score')},
v AS (SELECT a.model, a.rep, a.ap AS a, b.ap AS b, b.ap - a.ap AS d FROM a_scorea a JOIN b_scorea b ON a.model = b.model AND a.rep = b.rep), pt AS (SELECT a.model, a.ap AS a, b.ap AS b, b.ap - a.ap AS d FROM a_scorep a JOIN b_scorep b ON a.model = b.model)
SELECT pt.model, 'difference' AS statistic, round(max(pt.d), 6) AS point, round(quantile_cont(v.d, 0.025), 6) AS lo, round(quantile_cont(v.d, 0.975), 6) AS hi, count(*) - count(v.d) AS dropped FROM v JOIN pt ON v.model = pt.model GROUP BY pt.model
UNION ALL SELECT pt.model, 'ap_a_score', round(max(pt.a), 6), round(quantile_cont(v.a, 0.025), 6), round(quantile_cont(v.a, 0.975), 6), count(*) - count(v.a) FROM v JOIN pt ON v.model = pt.model GROUP BY pt.model
UNION ALL SELECT pt.model, 'ap_b_score', round(max(pt.b), 6), round(quantile_cont(v.b, 0.025), 6), round(quantile_cont(v.b, 0.975), 6), count(*) - count(v.b) FROM v JOIN pt ON v.model = pt.model GROUP BY pt.model""")
def _(spark, sf):
    return S.rounded(R.bootstrap_ap(paired(spark, sf), M, "cluster", ["a_score", "b_score"], "label", REPS, SEED))


@query("bootstrap_slope", f"""WITH {V.PAIRED}, {draws_sql('paired', M, 'cluster')}, c AS (SELECT model, cluster, count(*) AS n, sum(a_score) AS sx, sum(b_score) AS sv, sum(a_score * a_score) AS sxx, sum(a_score * b_score) AS sxv FROM paired WHERE label = 1 GROUP BY ALL),
q AS (SELECT w.model, rep, sum(w * n) AS n, sum(w * sx) AS sx, sum(w * sv) AS sv, sum(w * sxx) AS sxx, sum(w * sxv) AS sxv FROM c JOIN w ON c.model = w.model AND c.cluster = w.cluster GROUP BY ALL),
r AS (SELECT model, rep, (n * sxv - sx * sv) / (n * sxx - sx * sx) AS v FROM q), iv AS (SELECT model, {LOHI.format(v='v')} FROM r GROUP BY model), pt AS (SELECT model, regr_slope(b_score, a_score) AS point FROM paired WHERE label = 1 GROUP BY model) {JOINED}""")
def _(spark, sf):
    stat = R.slope_stat(F.col("a_score"), F.col("b_score"), F.col("label") == 1)
    return S.rounded(R.bootstrap(paired(spark, sf), M, "cluster", stat, REPS, SEED).select("model", "point", "lo", "hi", "dropped"))


VEC = ["bare_rate", "grounded_rate", "balanced_change"]


def vector_stat():
    y, a, b = F.col("label") == 1, F.col("a_said"), F.col("b_said")
    sums = {"n": F.lit(1), "sa": a, "sb": b, "n1": y.cast("int"), "a1": F.when(y, a), "b1": F.when(y, b), "a0": F.when(~y, a), "b0": F.when(~y, b)}
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    formulas = {"bare_rate": F.col("sa") / F.col("n"), "grounded_rate": F.col("sb") / F.col("n"),
                "balanced_change": F.when((n1 > 0) & (n0 > 0), 0.5 * ((F.col("b1") - F.col("a1")) / n1 - (F.col("b0") - F.col("a0")) / n0))}
    return R.ClusterStat(sums, formulas)


@query("bootstrap_stats_vector", f"""WITH {V.PAIRED}, {draws_sql('paired', M, 'cluster')}, c AS (SELECT model, cluster, count(*) AS n, sum(a_said) AS sa, sum(b_said) AS sb, sum(label) AS n1, coalesce(sum(b_said - a_said) FILTER (label = 1), 0) AS d1, coalesce(sum(b_said - a_said) FILTER (label = 0), 0) AS d0 FROM paired GROUP BY ALL),
q AS (SELECT w.model, rep, sum(w * n) AS n, sum(w * sa) AS sa, sum(w * sb) AS sb, sum(w * n1) AS n1, sum(w * d1) AS d1, sum(w * d0) AS d0 FROM c JOIN w ON c.model = w.model AND c.cluster = w.cluster GROUP BY ALL
 UNION ALL SELECT model, -1, sum(n), sum(sa), sum(sb), sum(n1), sum(d1), sum(d0) FROM c GROUP BY model),
s AS (SELECT model, rep, unnest(['bare_rate', 'grounded_rate', 'balanced_change']) AS statistic, unnest([sa / n::DOUBLE, sb / n::DOUBLE, 0.5 * (d1 / n1::DOUBLE - d0 / (n - n1)::DOUBLE)]) AS v FROM q)
SELECT model, statistic, round(max(v) FILTER (rep = -1), 6) AS point, round(quantile_cont(v, 0.025) FILTER (rep >= 0), 6) AS lo, round(quantile_cont(v, 0.975) FILTER (rep >= 0), 6) AS hi, 0::BIGINT AS dropped FROM s GROUP BY ALL""")
def _(spark, sf):
    return S.rounded(R.bootstrap(paired(spark, sf), M, "cluster", vector_stat(), REPS, SEED))


TWO = f"""WITH {PD}, {draws_sql('pd', M, 'cluster', SEED, REPS, 'wa')}, {draws_sql('pd', M, 'stratum', SEED + 1, REPS, 'wb')}, c AS (SELECT model, cluster, stratum, sum(cb - ca)::DOUBLE AS s, count(*) AS n FROM pd GROUP BY ALL),
r0 AS (SELECT c.model, wa.rep, sum(wa.w * wb.w * s) / sum(wa.w * wb.w * n) AS v FROM c JOIN wa ON c.model = wa.model AND c.cluster = wa.cluster JOIN wb ON c.model = wb.model AND c.stratum = wb.stratum AND wa.rep = wb.rep GROUP BY ALL),
r AS (SELECT g.model, g.rep, coalesce(v, 0) AS v FROM (SELECT DISTINCT model, rep FROM wa) g LEFT JOIN r0 ON r0.model = g.model AND r0.rep = g.rep), iv AS (SELECT model, {LOHI.format(v='v')} FROM r GROUP BY model), pt AS (SELECT model, avg(cb - ca) AS point FROM pd GROUP BY model)"""


@query("bootstrap_twoway", f"{TWO} {JOINED}")
def _(spark, sf):
    return S.rounded(R.bootstrap_twoway(correct_pairs(spark, sf), M, "cluster", "stratum", F.col("cb") - F.col("ca"), REPS, SEED))


def width_sql(unit, seed):
    o = f"u{seed}"
    return f"""{draws_sql('pd', M, unit, seed, REPS, o)}, {o}c AS (SELECT model, {unit}, sum(cb - ca) AS sn, count(*) AS sd FROM pd GROUP BY ALL),
{o}r AS (SELECT {o}.model, rep, sum(w * sn) / sum(w * sd)::DOUBLE AS v FROM {o}c JOIN {o} ON {o}c.model = {o}.model AND {o}c.{unit} = {o}.{unit} GROUP BY ALL), {o}i AS (SELECT model, quantile_cont(v, 0.975) - quantile_cont(v, 0.025) AS width FROM {o}r GROUP BY model)"""


@query("naive_vs_cluster_width", f"""WITH {PD}, {width_sql('item_id', SEED)}, {width_sql('cluster', SEED + 1)}, {width_sql('stratum', SEED + 2)}, pt AS (SELECT model, avg(cb - ca) AS point FROM pd GROUP BY model)
SELECT pt.model, 'difference' AS statistic, round(point, 6) AS point, round(a.width, 6) AS width_item, round(b.width, 6) AS width_cluster, round(c.width, 6) AS width_coarse, round(b.width / a.width, 6) AS cluster_over_item, round(c.width / a.width, 6) AS coarse_over_item
FROM pt JOIN u{SEED}i a ON a.model = pt.model JOIN u{SEED + 1}i b ON b.model = pt.model JOIN u{SEED + 2}i c ON c.model = pt.model""")
def _(spark, sf):
    stat = R.paired_difference(F.col("ca"), F.col("cb"))
    return S.rounded(R.naive_vs_cluster_width(correct_pairs(spark, sf), M, stat, "item_id", "cluster", "stratum", REPS, SEED))


# Student's t at 0.975 with 19 degrees of freedom (20 clusters), and the normal quantile
FACTOR = "(2.0930240544082634::DOUBLE / 1.959963984540054::DOUBLE * sqrt(20 / 19.0::DOUBLE))"


@query("widen_small_g", f"""{PAIRED_BOOT}, z AS (SELECT pt.model, point, lo, hi, (lo + hi) / 2 AS mid, (hi - lo) / 2 AS half, {FACTOR} AS factor FROM pt JOIN iv ON pt.model = iv.model)
SELECT model, round(factor, 6) AS factor, round(mid - half * factor, 6) AS lo_mid, round(mid + half * factor, 6) AS hi_mid, round(point - half * factor, 6) AS lo_point, round(point + half * factor, 6) AS hi_point, round(point - (point - lo) * factor, 6) AS lo_asym, round(point + (hi - point) * factor, 6) AS hi_asym,
CASE WHEN lo > 0 OR hi < 0 THEN 1 ELSE 0 END AS excludes_zero, CASE WHEN mid - half * factor > 0 OR mid + half * factor < 0 THEN 1 ELSE 0 END AS excludes_zero_mid FROM z""")
def _(spark, sf):
    iv = paired_interval(spark, sf).join(R.cluster_structure(correct_pairs(spark, sf), M, "cluster").select("model", "clusters"), "model")
    return S.rounded(R.widen_small_g(iv, "clusters").drop("statistic", "point", "lo", "hi", "dropped", "clusters"))


@query("cluster_structure", f"WITH {V.PAIRED}, n AS (SELECT stratum, cluster, count(*) AS n FROM items GROUP BY ALL) SELECT stratum, count(*) AS clusters, max(n) AS max_size, round(avg(n), 6) AS mean_size, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS share_in_multi FROM n GROUP BY stratum")
def _(spark, sf):
    return S.rounded(R.cluster_structure(V.paired_items(spark, sf), ["stratum"], "cluster"))


@query("verdict", f"{PAIRED_BOOT} SELECT pt.model, CASE WHEN lo > 0 THEN 'above' WHEN hi < 0 THEN 'below' ELSE 'spans' END AS verdict FROM pt JOIN iv ON pt.model = iv.model")
def _(spark, sf):
    return paired_interval(spark, sf).select("model", R.verdict(F.col("lo"), F.col("hi")).alias("verdict"))


@query("bootstrap_iid_spearman", f"""WITH {V.PAIRED}, {draws_sql('paired', M, 'item_id', SEED, 50)}, c AS (SELECT w.model, rep, a_score, b_score, sum(w) AS w FROM paired p JOIN w ON p.model = w.model AND p.item_id = w.item_id GROUP BY ALL),
ra AS (SELECT model, rep, a_score, sum(n) OVER (PARTITION BY model, rep ORDER BY a_score) - (n - 1) / 2.0 AS r FROM (SELECT model, rep, a_score, sum(w) AS n FROM c GROUP BY ALL)), rb AS (SELECT model, rep, b_score, sum(n) OVER (PARTITION BY model, rep ORDER BY b_score) - (n - 1) / 2.0 AS r FROM (SELECT model, rep, b_score, sum(w) AS n FROM c GROUP BY ALL)),
j AS (SELECT c.model, c.rep, w::DOUBLE AS w, ra.r::DOUBLE AS x, rb.r::DOUBLE AS y FROM c JOIN ra ON c.model = ra.model AND c.rep = ra.rep AND c.a_score = ra.a_score JOIN rb ON c.model = rb.model AND c.rep = rb.rep AND c.b_score = rb.b_score),
q AS (SELECT model, rep, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / sqrt((sum(w) * sum(w * x * x) - sum(w * x) ** 2) * (sum(w) * sum(w * y * y) - sum(w * y) ** 2)) AS v FROM j GROUP BY ALL)
SELECT model, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, count(*) - count(v) AS dropped FROM q GROUP BY model""")
def _(spark, sf):
    return S.rounded(R.bootstrap_iid_spearman(paired(spark, sf), M, "item_id", "a_score", "b_score", 50, SEED))


@query("bootstrap_median_difference", f"""WITH {V.PAIRED}, it AS (SELECT stratum, label AS grp, item_id, n_chars::DOUBLE AS v FROM items), {draws_sql('it', ['stratum', 'grp'], 'item_id', SEED, 50)},
x AS (SELECT w.stratum, w.rep, w.grp, it.v, unnest(range(w.w)) AS k FROM it JOIN w ON it.stratum = w.stratum AND it.grp = w.grp AND it.item_id = w.item_id), m AS (SELECT stratum, rep, grp, median(v) AS m FROM x GROUP BY ALL),
d AS (SELECT stratum, rep, max(m) FILTER (grp = 1) - max(m) FILTER (grp = 0) AS v FROM m GROUP BY ALL) SELECT stratum, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, count(*) - count(v) AS dropped FROM d GROUP BY stratum""")
def _(spark, sf):
    it = V.paired_items(spark, sf).withColumn("v", F.col("n_chars").cast("double"))
    return S.rounded(R.bootstrap_median_difference(it, ["stratum"], "item_id", "v", F.col("label"), 50, SEED))


@query("bootstrap_median_difference_full")
def _(spark, sf):
    it = V.paired_items(spark, sf).withColumn("v", F.col("n_chars").cast("double"))
    return S.rounded(D.median_difference(it, ["stratum"], "item_id", "v", F.col("label"), FULL, SEED))


# --- tests ------------------------------------------------------------------------------------------------------------
BIN_P = "CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) FOR i IN range(CAST(least(b_only, a_only) AS BIGINT) + 1)])) END"
MC = "mc AS (SELECT {k}, count(*) FILTER (cb = 1 AND ca = 0) AS b_only, count(*) FILTER (cb = 0 AND ca = 1) AS a_only, count(*) FILTER (ca <> cb) AS n FROM {src} GROUP BY ALL)"


@query("mcnemar_exact", f"WITH {PD}, {MC.format(k='model, stratum', src='pd')} SELECT model, stratum, b_only, a_only, round({BIN_P}, 6) AS p FROM mc")
def _(spark, sf):
    return S.rounded(I.mcnemar_exact(correct_pairs(spark, sf), ["model", "stratum"], F.col("ca") == 1, F.col("cb") == 1))


@query("holm", f"WITH {PD}, {MC.format(k='model, stratum', src='pd')}, p AS (SELECT model, stratum, {BIN_P} AS p FROM mc), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, stratum) AS r, count(*) OVER (PARTITION BY model) AS m FROM p) SELECT model, stratum, round(p, 6) AS p, round(max(least(1.0, (m - r + 1) * p)) OVER (PARTITION BY model ORDER BY r ROWS UNBOUNDED PRECEDING), 6)::DOUBLE AS p_holm FROM r")
def _(spark, sf):
    m = I.mcnemar_exact(correct_pairs(spark, sf), ["model", "stratum"], F.col("ca") == 1, F.col("cb") == 1)
    return S.rounded(I.holm(m.select("model", "stratum", "p"), ["model"], "p", ["stratum"]))


FC = RESP + ", fe AS (SELECT *, state <> 'answered' AS ev, CASE WHEN stratum = 'en' THEN 'en' ELSE 'other' END AS two FROM marked), fc AS (SELECT model, arm, two, count(*) FILTER (ev) AS failed, count(*) FILTER (NOT ev) AS ok FROM fe GROUP BY ALL), fw AS (SELECT model, arm, max(failed) FILTER (two = 'en') AS a, max(ok) FILTER (two = 'en') AS b, max(failed) FILTER (two = 'other') AS c, max(ok) FILTER (two = 'other') AS d FROM fc GROUP BY ALL)"
LP = "(lgamma(r1 + 1) + lgamma(n - r1 + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) - lgamma(n + 1) - lgamma({k} + 1) - lgamma(r1 - {k} + 1) - lgamma(c1 - {k} + 1) - lgamma(n - r1 - c1 + {k} + 1))"


@query("fisher_2x2", f"WITH {FC}, ft AS (SELECT *, a + b AS r1, a + c AS c1, a + b + c + d AS n FROM fw), fk AS (SELECT *, unnest(range(greatest(0, r1 + c1 - n), least(r1, c1) + 1)) AS k FROM ft) SELECT model, arm, round(max(a * d) / max(b * c)::DOUBLE, 6) AS odds_ratio, round(least(1.0, sum(CASE WHEN {LP.format(k='k')} <= {LP.format(k='a')} + 1e-7 THEN exp({LP.format(k='k')}) ELSE 0 END)), 6)::DOUBLE AS p FROM fk GROUP BY ALL")
def _(spark, sf):
    m = marked(spark, sf).withColumn("two", F.when(F.col("stratum") == "en", "en").otherwise("other"))
    return S.rounded(I.fisher_2x2(I.failure_counts(m, ["model", "arm"], "two", F.col("state") != "answered"), ["model", "arm"], "two"))


CHI = RESP + """, ct AS (SELECT model, arm, stratum, count(*) FILTER (state <> 'answered') AS f, count(*) FILTER (state = 'answered') AS k FROM marked GROUP BY ALL), cx AS (SELECT *, sum(f) OVER q AS tf, sum(k) OVER q AS tk FROM ct WINDOW q AS (PARTITION BY model, arm)),
ce AS (SELECT *, (f + k) * tf / (tf + tk)::DOUBLE AS ef, (f + k) * tk / (tf + tk)::DOUBLE AS ek FROM cx), cs AS (SELECT model, arm, sum((f - ef) ** 2 / ef + (k - ek) ** 2 / ek) AS stat, count(*) - 1 AS dof, min(least(ef, ek)) AS min_expected, CAST(sum(f + k) AS BIGINT) AS n FROM ce GROUP BY ALL)"""
# upper tail with three degrees of freedom by Simpson's rule on the density
CHI_P = "(1 - list_sum([CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * sqrt(2 / pi()) * (i * sqrt(stat) / 4000) ** 2 * exp(-((i * sqrt(stat) / 4000) ** 2) / 2) FOR i IN range(4001)]) * sqrt(stat) / 4000 / 3)"


@query("chi2_rx2", f"WITH {CHI} SELECT model, arm, round(stat, 6) AS stat, dof, round(min_expected, 6) AS min_expected, n, round({CHI_P}, 5)::DOUBLE AS p FROM cs")
def _(spark, sf):
    c = I.failure_counts(marked(spark, sf), ["model", "arm"], "stratum", F.col("state") != "answered")
    return S.rounded(I.chi2_rx2(c, ["model", "arm"])).withColumn("p", F.round("p", 5))


@query("failures_by_stratum", f"WITH {CHI}, cp AS (SELECT model, arm, 'chi-square' AS test, n, stat, {CHI_P} AS p FROM cs), r AS (SELECT *, row_number() OVER (ORDER BY p, model, arm) AS r, count(*) OVER () AS m FROM cp) SELECT model, arm, test, n, round(stat, 6) AS stat, round(p, 5)::DOUBLE AS p, round(max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING), 5)::DOUBLE AS p_holm FROM r")
def _(spark, sf):
    f = I.failures_by_stratum(marked(spark, sf), ["model", "arm"], "stratum", F.col("state") != "answered")
    return S.rounded(f.select("model", "arm", "test", "n", "stat", "p", "p_holm")).withColumns({"p": F.round("p", 5), "p_holm": F.round("p_holm", 5)})


@query("chi2_permutation", f"""WITH {CHI}, pr AS (SELECT m.model, m.arm, m.item_id, stratum, CAST(rep AS INTEGER) AS rep, row_number() OVER (PARTITION BY m.model, m.arm, rep ORDER BY {md5_int("'9'", 'rep', 'm.item_id')}, m.item_id) AS rk FROM marked m CROSS JOIN range(30) t(rep)),
nf AS (SELECT model, arm, sum(f) AS tf, sum(k) AS tk FROM ct GROUP BY ALL), pc AS (SELECT pr.model, pr.arm, rep, stratum, max(tf) AS tf, max(tk) AS tk, count(*) FILTER (rk <= tf) AS f, count(*) FILTER (rk > tf) AS k FROM pr JOIN nf ON pr.model = nf.model AND pr.arm = nf.arm GROUP BY ALL),
pe AS (SELECT *, (f + k) * tf / (tf + tk)::DOUBLE AS ef, (f + k) * tk / (tf + tk)::DOUBLE AS ek FROM pc), ps AS (SELECT model, arm, rep, sum((f - ef) ** 2 / ef + (k - ek) ** 2 / ek) AS s FROM pe GROUP BY ALL)
SELECT ps.model, ps.arm, round(max(stat), 6) AS observed, count(*) FILTER (s >= stat - 1e-12) AS hits, count(*) AS draws, round((count(*) FILTER (s >= stat - 1e-12) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM ps JOIN cs ON ps.model = cs.model AND ps.arm = cs.arm GROUP BY ALL""")
def _(spark, sf):
    return S.rounded(I.chi2_permutation(marked(spark, sf), ["model", "arm"], "item_id", "stratum", F.col("state") != "answered", 30, 9))


@query("chi2_permutation_full")
def _(spark, sf):
    c = I.failure_counts(marked(spark, sf), ["model", "arm"], "stratum", F.col("state") != "answered")
    return S.rounded(I.permutation_by_counts(c, ["model", "arm"], "stratum", FULL, 9))


@query("shared_baseline_null", f"""WITH {V.PAIRED}, mm AS (SELECT cluster, round(avg(a_score), 6) AS a, round(avg(b_score), 6) AS b FROM paired GROUP BY cluster), ix AS (SELECT *, row_number() OVER (ORDER BY cluster) AS i FROM mm),
sh AS (SELECT rep, b, row_number() OVER (PARTITION BY rep ORDER BY {md5_int("'4'", 'rep', 'cluster')}, cluster) AS i FROM ix CROSS JOIN range(100) t(rep)), j AS (SELECT sh.rep, a, round(sh.b - a, 12) AS d FROM sh JOIN ix ON ix.i = sh.i UNION ALL SELECT -1, a, round(b - a, 12) FROM mm),
k AS (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY a) + (count(*) OVER (PARTITION BY rep, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY rep ORDER BY d) + (count(*) OVER (PARTITION BY rep, d) - 1) / 2.0::DOUBLE AS rd FROM j), c AS (SELECT rep, corr(ra, rd) AS rho FROM k GROUP BY rep)
SELECT round(quantile_cont(rho, 0.025) FILTER (rep >= 0), 6) AS lo, round(quantile_cont(rho, 0.5) FILTER (rep >= 0), 6) AS median, round(quantile_cont(rho, 0.975) FILTER (rep >= 0), 6) AS hi, count(*) FILTER (rep >= 0) AS draws, round(max(rho) FILTER (rep = -1), 6) AS observed,
CAST(max(rho) FILTER (rep = -1) BETWEEN quantile_cont(rho, 0.025) FILTER (rep >= 0) AND quantile_cont(rho, 0.975) FILTER (rep >= 0) AS INTEGER) AS inside FROM c""")
def _(spark, sf):
    m = paired(spark, sf).groupBy("cluster").agg(F.round(F.avg("a_score"), 6).alias("a"), F.round(F.avg("b_score"), 6).alias("b"))
    return S.rounded(I.shared_baseline_null(m, "cluster", "a", "b", 100, 4))


@query("shared_baseline_null_full")
def _(spark, sf):
    m = paired(spark, sf).groupBy("cluster").agg(F.round(F.avg("a_score"), 6).alias("a"), F.round(F.avg("b_score"), 6).alias("b"))
    return S.rounded(D.shared_baseline_null(m, "cluster", "a", "b", FULL, 4))


@query("halfwidth", "WITH g AS (SELECT l_shipdate::DATE AS d, count(*) AS n, avg(CAST(l_returnflag = 'A' AS INTEGER)) AS p FROM lineitem GROUP BY ALL) SELECT CAST(d AS VARCHAR) AS d, round(1.96::DOUBLE * sqrt(p * (1 - p) / n), 6) AS half, CASE WHEN list_contains([round(k / n::DOUBLE, 2) FOR k IN range(n + 1)], round(round(p, 2) + 0.01, 2)) THEN 1 ELSE 0 END AS reachable FROM g")
def _(spark, sf):
    l = V.table(spark, sf, "lineitem")
    g = l.groupBy(F.to_date("l_shipdate").cast("string").alias("d")).agg(F.count(F.lit(1)).alias("n"), S.share(F.col("l_returnflag") == "A").alias("p"))
    return g.select("d", F.round(I.halfwidth(F.col("p"), F.col("n")), 6).alias("half"), I.reachable(F.round("p", 2) + 0.01, F.col("n"), 2).cast("int").alias("reachable"))


@query("mann_whitney", f"""WITH {V.PAIRED}, r AS (SELECT stratum, label, n_chars, (rank() OVER q + (count(*) OVER (PARTITION BY stratum, n_chars) - 1) / 2.0)::DOUBLE AS r, count(*) OVER (PARTITION BY stratum, n_chars) AS t FROM items WINDOW q AS (PARTITION BY stratum ORDER BY n_chars)),
g AS (SELECT stratum, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0, sum(r) FILTER (label = 1) AS s, sum(t * t - 1)::DOUBLE AS tt, median(n_chars) FILTER (label = 1) - median(n_chars) FILTER (label = 0) AS md FROM r GROUP BY stratum),
u AS (SELECT *, s - n1 * (n1 + 1) / 2.0 AS u, n1 + n0 AS n FROM g), z AS (SELECT *, greatest(abs(u - n1 * n0 / 2.0) - 0.5, 0) / sqrt(n1 * n0 / 12.0 * ((n + 1) - tt / (n * (n - 1)))) AS z FROM u)
SELECT stratum, n1, n0, round(u, 4)::DOUBLE AS u, round(least(1.0, 1 - 2 * list_sum([CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-((i * z / 2000) ** 2) / 2) / sqrt(2 * pi()) FOR i IN range(2001)]) * z / 2000 / 3), 5)::DOUBLE AS p, round(1 - 2 * u / (n1 * n0), 6)::DOUBLE AS rank_biserial, md::DOUBLE AS median_difference FROM z WHERE n1 > 0 AND n0 > 0""")
def _(spark, sf):
    it = V.paired_items(spark, sf).withColumn("n_chars", F.col("n_chars").cast("double"))
    m = I.mann_whitney(it, ["stratum"], "n_chars", "label")
    return S.rounded(m).withColumns({"p": F.round("p", 5), "u": F.round("u", 4)})


# --- contrasts per mask -----------------------------------------------------------------------------------------------
MASKED = PD + ", mk AS (SELECT *, 'all' AS mask FROM pd UNION ALL SELECT *, 'positive' FROM pd WHERE label = 1 UNION ALL SELECT *, 'english' FROM pd WHERE stratum = 'en')"
MKBOOT = boot_sql('sum(cb) - sum(ca)', 'count(*)', 'avg(cb) - avg(ca)', ('mask', 'model'), 'cluster', 'mk')
CONTRAST = f"WITH {MASKED}, {MKBOOT}, {MC.format(k='mask, model', src='mk')}, pp AS (SELECT *, {BIN_P} AS p FROM mc), ph AS (SELECT *, max(least(1.0, (m - r + 1) * p)) OVER (PARTITION BY mask ORDER BY r ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY p, model) AS r, count(*) OVER (PARTITION BY mask) AS m FROM pp)), ca AS (SELECT pt.mask, pt.model, point, lo, hi, b_only, a_only, p, p_holm, CASE WHEN lo > 0 THEN 'above' WHEN hi < 0 THEN 'below' ELSE 'spans' END AS verdict FROM pt JOIN iv ON pt.mask = iv.mask AND pt.model = iv.model JOIN ph ON ph.mask = pt.mask AND ph.model = pt.model)"


def contrasts(spark, sf):
    p = correct_pairs(spark, sf)
    masks = F.array_compact(F.array(F.lit("all"), F.when(F.col("label") == 1, "positive"), F.when(F.col("stratum") == "en", "english")))
    return R_contrasts(p.withColumn("mask", F.explode(masks)))


def R_contrasts(masked):
    iv = R.bootstrap(masked, ["mask", "model"], "cluster", R.paired_difference(F.col("ca"), F.col("cb")), REPS, SEED)
    mc = I.holm(I.mcnemar_exact(masked, ["mask", "model"], F.col("ca") == 1, F.col("cb") == 1), ["mask"], "p", ["model"])
    j = iv.join(mc, ["mask", "model"])
    return j.withColumn("verdict", R.verdict(F.col("lo"), F.col("hi")))


@query("stratified_contrasts", f"{CONTRAST} SELECT mask, model, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, b_only, a_only, round(p, 6) AS p, round(p_holm, 6)::DOUBLE AS p_holm, verdict FROM ca")
def _(spark, sf):
    return S.rounded(contrasts(spark, sf).select("mask", "model", "point", "lo", "hi", "b_only", "a_only", "p", "p_holm", "verdict"))


@query("partial_verdict_summary", f"{CONTRAST} SELECT mask, count(*) AS members, count(*) FILTER (verdict = 'above') AS above, count(*) FILTER (verdict = 'below') AS below, count(*) FILTER (verdict = 'spans') AS spans, round(min(point), 6) AS min_difference, round(max(point), 6) AS max_difference, round(min(p_holm), 6)::DOUBLE AS min_p, arg_min(model, p_holm * 1000 + model * 1e-7) AS min_p_member, CAST(bool_and(point < 0) AS INTEGER) AS all_trail, CAST(bool_and(point > 0) AS INTEGER) AS all_lead FROM ca GROUP BY mask")
def _(spark, sf):
    c = contrasts(spark, sf).select("mask", "model", F.col("point").alias("difference"), "verdict", F.col("p_holm").alias("p_adjusted"))
    return S.rounded(R.partial_verdict_summary(c, ["mask"], "model"))


@query("sensitivity_to_clustering", f"""{TWO}, one AS (SELECT model, lo > 0 OR hi < 0 AS ex FROM iv), {draws_sql('pd', M, 'cluster', 99, REPS, 'wc')}, cc AS (SELECT model, cluster, sum(cb - ca) AS sn, count(*) AS sd FROM pd GROUP BY ALL), rr AS (SELECT wc.model, rep, sum(w * sn) / sum(w * sd)::DOUBLE AS v FROM cc JOIN wc ON cc.model = wc.model AND cc.cluster = wc.cluster GROUP BY ALL),
two AS (SELECT model, quantile_cont(v, 0.025) > 0 OR quantile_cont(v, 0.975) < 0 AS ex FROM rr GROUP BY model) SELECT two.model, CAST(two.ex AS INTEGER) AS excludes_base, CAST(one.ex AS INTEGER) AS excludes_other, CASE WHEN one.ex <> two.ex THEN 1 ELSE 0 END AS sensitive FROM one JOIN two ON one.model = two.model""")
def _(spark, sf):
    p = correct_pairs(spark, sf)
    a = R.bootstrap(p, M, "cluster", R.paired_difference(F.col("ca"), F.col("cb")), REPS, 99).select("model", F.lit("cluster").alias("unit"), "lo", "hi")
    b = R.bootstrap_twoway(p, M, "cluster", "stratum", F.col("cb") - F.col("ca"), REPS, SEED).select("model", F.lit("twoway").alias("unit"), "lo", "hi")
    both = a.unionByName(b)
    hit = A.sensitivity_to_clustering(both, ["model"], "unit", "cluster", "twoway").select("model", F.lit(1).alias("sensitive"))
    out = (F.col("lo") > 0) | (F.col("hi") < 0)
    flags = both.groupBy("model").agg(F.max(F.when(F.col("unit") == "cluster", out.cast("int"))).alias("excludes_base"), F.max(F.when(F.col("unit") == "twoway", out.cast("int"))).alias("excludes_other"))
    return flags.join(hit, "model", "left").withColumn("sensitive", F.coalesce("sensitive", F.lit(0)))


@query("poisson_weights", f"""WITH RECURSIVE {V.PAIRED}, c AS (SELECT DISTINCT cluster FROM items),
pk(k, term, total) AS (SELECT 0, exp(-1.0::DOUBLE), exp(-1.0::DOUBLE) UNION ALL SELECT k + 1, term / (k + 1), total + term / (k + 1) FROM pk WHERE k < 25),
u AS (SELECT cluster, rep, {md5_int(f"'{SEED}'", 'rep', 'cluster')} / 1152921504606846976.0::DOUBLE AS u FROM c, range({REPS}) t(rep)),
w AS (SELECT cluster, rep, (SELECT count(*) FROM pk WHERE total <= u.u) AS w FROM u)
SELECT cluster, CAST(sum(w) AS BIGINT) AS w, count(*) AS reps FROM w WHERE w > 0 GROUP BY cluster""")
def _(spark, sf):
    w = R.poisson_weights(V.paired_items(spark, sf), [], "cluster", REPS, SEED)
    return w.groupBy("cluster").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("reps"))


# --- tasks as column expressions --------------------------------------------------------------------------------------
TASKS_SQL = f"""WITH {V.PAIRED}, {V.NUMERIC}, tk AS (
 SELECT 'calls' AS task, model || '/' || arm AS run, cluster, stratum, CAST(said = label AS INTEGER)::DOUBLE AS score, CAST(said IS NULL AS INTEGER) AS failed FROM scored
 UNION ALL SELECT 'amounts', run || '/' || arm, CAST(group_id AS VARCHAR), CAST(year(day) AS VARCHAR), CAST(abs(target - prediction) / greatest(target, 1) <= 0.25 AS INTEGER)::DOUBLE, CAST(prediction IS NULL AS INTEGER) FROM nlog)"""


def tasks(spark, sf):
    calls = K.Task("calls", ["model", "arm"], (F.col("said") == F.col("label")).cast("int"), F.col("said").isNull(), F.col("cluster"), F.col("stratum"))
    near = (F.abs(F.col("target") - F.col("prediction")) / F.greatest("target", F.lit(1.0)) <= 0.25).cast("int")
    amounts = K.Task("amounts", ["run", "arm"], near, F.col("prediction").isNull(), F.col("group_id"), F.year("day"))
    return K.together([(calls, scored(spark, sf)), (amounts, V.numeric_log(spark, sf))])


@query("task_scores", TASKS_SQL + " SELECT task, run, stratum, count(*) AS n, count(score) AS scored, sum(failed)::BIGINT AS failures, round(avg(score), 6) AS mean_score FROM tk GROUP BY ALL")
def _(spark, sf):
    return S.rounded(K.score_table(tasks(spark, sf), strata=True))


TK = TASKS_SQL + ", ts AS (SELECT * FROM tk WHERE score IS NOT NULL), " + boot_sql("sum(score)", "count(*)", "avg(score)", by=("task", "run"), src="ts", reps=50)


@query("task_intervals", f"{TK} SELECT pt.task, pt.run, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, dropped FROM pt JOIN iv ON pt.task = iv.task AND pt.run = iv.run")
def _(spark, sf):
    return S.rounded(K.score_intervals(tasks(spark, sf), 50, SEED))


@query("task_failures", TASKS_SQL + """, c AS (SELECT task, run, stratum, sum(failed) AS f, count(*) AS n FROM tk GROUP BY ALL), t AS (SELECT task, run, sum(f) AS tf, sum(n) AS tn FROM c GROUP BY ALL)
SELECT task, run, max(tn)::BIGINT AS n, round(sum((f - n * tf / tn::DOUBLE) ** 2 / (n * tf / tn::DOUBLE) + (n - f - n * (tn - tf) / tn::DOUBLE) ** 2 / (n * (tn - tf) / tn::DOUBLE)), 6) AS stat FROM c JOIN t USING (task, run) WHERE tf > 0 AND tf < tn GROUP BY task, run""")
def _(spark, sf):
    return S.rounded(K.failure_independence(tasks(spark, sf)).select("task", "run", "n", "stat")).where("stat IS NOT NULL")
