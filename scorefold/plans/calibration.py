"""Queries over calibration, recalibration and thresholds."""

from pyspark.sql import functions as F

from scorefold.functions import arrays as AR
from scorefold.operators import calibration as Q
from scorefold.operators import draws as D
from scorefold.operators import joins as J
from scorefold.operators import panel as P
from scorefold.operators import refit as RF
from scorefold.operators import scores as S
from scorefold.plans.cohort import md5_int, scored
from scorefold.plans.registry import query
from scorefold.plans.resample import draws_sql
from scorefold.plans.scores import B, BOTH, FR, answered, frame_calls
from scorefold.session import checkpointed
from scorefold.sources import standins as V

EDGE = " + ".join(f"CAST(score > {i} * 0.1::DOUBLE AS INTEGER)" for i in range(1, 10))
RW = f"{B}, rw0 AS (SELECT *, {EDGE} AS bin FROM s), rw AS (SELECT model, arm, bin, count(*) AS n, avg(score) AS mean_p, avg(label) AS rate FROM rw0 GROUP BY ALL)"
RC = "rc0 AS (SELECT *, ntile(10) OVER (PARTITION BY model, arm ORDER BY score, item_id) - 1 AS bin FROM s), rc AS (SELECT model, arm, bin, count(*) AS n, min(score) AS min_p, max(score) AS max_p, avg(score) AS mean_p, avg(label) AS rate FROM rc0 GROUP BY ALL)"


@query("reliability_width", f"WITH {RW} SELECT model, arm, bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM rw")
def _(spark, sf):
    return S.rounded(Q.reliability_width(scored(spark, sf), BOTH))


@query("reliability_count", f"WITH {B}, {RC} SELECT model, arm, CAST(bin AS INTEGER) AS bin, n, min_p, max_p, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM rc")
def _(spark, sf):
    return S.rounded(Q.reliability_count(scored(spark, sf), BOTH, "item_id"))


@query("calibration", f"""WITH {RW}, {RC}, b AS (SELECT model, arm, count(*) AS n, avg(label) AS base_rate, avg(score) AS mean_p, avg((score - label) ** 2) AS brier FROM s GROUP BY ALL),
w AS (SELECT rw.model, rw.arm, sum(rw.n / b.n::DOUBLE * abs(rw.mean_p - rate)) AS ece_width, sum(rw.n / b.n::DOUBLE * (rw.mean_p - rate) ** 2) AS reliability, sum(rw.n / b.n::DOUBLE * rate * (1 - rate)) AS refinement, sum(rw.n / b.n::DOUBLE * (rate - base_rate) ** 2) AS resolution FROM rw JOIN b ON rw.model = b.model AND rw.arm = b.arm GROUP BY ALL),
c AS (SELECT model, arm, sum(n * abs(mean_p - rate)) / sum(n) AS ece_count FROM rc GROUP BY ALL)
SELECT b.model, b.arm, b.n, round(base_rate, 6) AS base_rate, round(mean_p, 6) AS mean_p, round(brier, 6) AS brier, round(ece_width, 6) AS ece_width, round(reliability, 6) AS reliability, round(refinement, 6) AS refinement, round(resolution, 6) AS resolution, round(ece_count, 6) AS ece_count, round(base_rate * (1 - base_rate), 6) AS uncertainty
FROM b JOIN w ON b.model = w.model AND b.arm = w.arm JOIN c ON b.model = c.model AND b.arm = c.arm""")
def _(spark, sf):
    return S.rounded(Q.calibration(scored(spark, sf), BOTH, "item_id"))


SHIFT = lambda p, d: f"CASE WHEN {p} > 0 AND {p} < 1 THEN 1 / (1 + exp(-(ln({p} / (1 - {p})) + {d}))) ELSE {p} END"


@query("odds_shift", f"WITH {B} SELECT model, arm, round(avg({SHIFT('score', '0.75::DOUBLE')}), 6) AS shifted_mean, round(avg(score), 6) AS mean FROM s GROUP BY ALL")
def _(spark, sf):
    return S.rounded(answered(spark, sf).groupBy(*BOTH).agg(F.avg(Q.odds_shift(F.col("score"), F.lit(0.75))).alias("shifted_mean"), F.avg("score").alias("mean")))


@query("delta_to_mean", f"""WITH RECURSIVE {B}, h AS (SELECT model, arm, score AS p, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT model, arm, avg(label) AS target FROM s GROUP BY ALL),
bis AS (SELECT model, arm, target, -40.0::DOUBLE AS lo, 40.0::DOUBLE AS hi, 0 AS i FROM t UNION ALL
 SELECT b.model, b.arm, b.target, CASE WHEN (SELECT sum(n * ({SHIFT('p', '(b.lo + b.hi) / 2')})) / sum(n) FROM h WHERE h.model = b.model AND h.arm = b.arm) <= b.target THEN (b.lo + b.hi) / 2 ELSE b.lo END,
 CASE WHEN (SELECT sum(n * ({SHIFT('p', '(b.lo + b.hi) / 2')})) / sum(n) FROM h WHERE h.model = b.model AND h.arm = b.arm) <= b.target THEN b.hi ELSE (b.lo + b.hi) / 2 END, b.i + 1 FROM bis b WHERE b.i < 50)
SELECT model, arm, round((lo + hi) / 2, 6) AS delta FROM bis WHERE i = 50""")
def _(spark, sf):
    s = answered(spark, sf)
    t = s.groupBy(*BOTH).agg(F.avg(F.col("label").cast("double")).alias("target"))
    return S.rounded(Q.delta_to_mean(s, BOTH, "score", t))


@query("prior_em")
def _(spark, sf):
    return S.rounded(Q.prior_em(scored(spark, sf), BOTH, "score", 0.5))


@query("group_folds", f"""WITH {V.PAIRED}, c AS (SELECT DISTINCT cluster, {md5_int("'5'", 'cluster')} AS h FROM items), f AS (SELECT cluster, ntile(5) OVER (ORDER BY h, cluster) - 1 AS fold FROM c)
SELECT item_id, items.cluster, CAST(fold AS INTEGER) AS fold FROM items JOIN f ON items.cluster = f.cluster""")
def _(spark, sf):
    return Q.group_folds(V.paired_items(spark, sf), "cluster", 5, 5).select("item_id", "cluster", "fold")


def iso_sql(src, by, x, n, s):
    """max-min form of the isotonic fit over distinct values: iso(i) = max over j <= i of min over k >= i of the mean of j..k."""
    b = ", ".join(by)
    on = " AND ".join(f"u.{c} = v.{c}" for c in by)
    return f"""ih AS (SELECT {b}, {x} AS x, sum({n}) AS n, sum({s}) AS s FROM {src} GROUP BY ALL),
ic AS (SELECT *, row_number() OVER (PARTITION BY {b} ORDER BY x) AS i, sum(n) OVER (PARTITION BY {b} ORDER BY x) AS cn, sum(s) OVER (PARTITION BY {b} ORDER BY x) AS cs FROM ih),
ia AS (SELECT {', '.join('u.' + c for c in by)}, u.i AS j, v.i AS k, (v.cs - u.cs + u.s) / (v.cn - u.cn + u.n)::DOUBLE AS a FROM ic u JOIN ic v ON {on} AND v.i >= u.i),
im AS (SELECT *, min(a) OVER (PARTITION BY {b}, j ORDER BY k DESC) AS m FROM ia),
iso AS (SELECT {', '.join('u.' + c for c in by)}, u.x, u.n, u.s, max(m) AS fitted FROM ic u JOIN im v ON {on} AND v.k = u.i GROUP BY ALL)"""


@query("isotonic", f"WITH {B}, {iso_sql('s', BOTH, 'score', '1', 'label')} SELECT model, arm, x AS score, round(fitted, 6) AS fitted FROM iso")
def _(spark, sf):
    return S.rounded(Q.isotonic(scored(spark, sf), BOTH, "score", "label"))


@query("corp_decomposition", f"""WITH {B}, {iso_sql('s', BOTH, 'score', '1', 'label')}, c AS (SELECT model, arm, CAST(sum(n) AS BIGINT) AS n, sum(n * x * x - 2 * x * s + s) / sum(n) AS brier, sum(n * fitted * fitted - 2 * fitted * s + s) / sum(n) AS bf, sum(s) / sum(n)::DOUBLE AS r FROM iso GROUP BY ALL)
SELECT model, arm, n, round(brier, 6) AS brier, round(bf, 6) AS brier_fitted, round(r * (1 - r), 6) AS uncertainty, round(brier - bf, 6) AS miscalibration, round(r * (1 - r) - bf, 6) AS discrimination FROM c""")
def _(spark, sf):
    return S.rounded(Q.corp_decomposition(scored(spark, sf), BOTH))


FOLDS = f"""fc AS (SELECT DISTINCT cluster, {md5_int("'5'", 'cluster')} AS h FROM items), ff AS (SELECT cluster, ntile(5) OVER (ORDER BY h, cluster) - 1 AS fold FROM fc),
sf AS (SELECT s.*, fold FROM s JOIN ff ON s.cluster = ff.cluster), tr AS (SELECT model, arm, g.fold, score, label FROM sf JOIN (SELECT DISTINCT fold FROM ff) g ON g.fold <> sf.fold)"""


@query("crossfit_isotonic", f"""WITH {B}, {FOLDS}, {iso_sql('tr', ['model', 'arm', 'fold'], 'score', '1', 'label')}, pb AS (SELECT DISTINCT model, arm, fold, score FROM sf),
nb AS (SELECT pb.model, pb.arm, pb.fold, pb.score, max(x) FILTER (x <= score) AS x0, arg_max(fitted, x) FILTER (x <= score) AS v0, min(x) FILTER (x >= score) AS x1, arg_min(fitted, x) FILTER (x >= score) AS v1 FROM pb JOIN iso ON pb.model = iso.model AND pb.arm = iso.arm AND pb.fold = iso.fold GROUP BY ALL)
SELECT model, arm, CAST(fold AS INTEGER) AS fold, score, round(CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL OR x0 = score OR x1 = x0 THEN v0 ELSE v0 + (v1 - v0) * (score - x0) / (x1 - x0) END, 6) AS recalibrated FROM nb""")
def _(spark, sf):
    s = Q.group_folds(answered(spark, sf), "cluster", 5, 5)
    return S.rounded(Q.crossfit_isotonic(s, BOTH, "score", "label", "fold", 5))


REFIT_REPS = 20
FOLD_SEEDS = range(20)
ISO_AT = "CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL OR x0 = score OR x1 = x0 THEN v0 ELSE v0 + (v1 - v0) * (score - x0) / (x1 - x0) END"


def refit_losses(spark, sf, reps):
    s = Q.group_folds(answered(spark, sf), "cluster", 5, 5)
    return RF.replicate_losses(s, ["model"], ["arm"], "cluster", "score", "label", "fold", 5, reps, 17)


def fitted_sql(hist, key, probe):
    """Cross-fitted value `fitted` of each (key, fold, score) of `hist` (n, s): read off the isotonic fit to the other folds."""
    k = ", ".join(key)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in key)
    return f"""tq AS (SELECT {', '.join('h.' + c for c in key)}, g.fold, score, sum(n) AS n, sum(s) AS s FROM {hist} h JOIN (SELECT unnest(range(5)) AS fold) g ON g.fold <> h.fold GROUP BY ALL),
{iso_sql('tq', [*key, 'fold'], 'score', 'n', 's')},
nb AS (SELECT {', '.join('h.' + c for c in key)}, h.fold, h.score, h.n, h.s, max(x) FILTER (x <= score) AS x0, arg_max(fitted, x) FILTER (x <= score) AS v0, min(x) FILTER (x >= score) AS x1, arg_min(fitted, x) FILTER (x >= score) AS v1 FROM {hist} h JOIN iso ON {on('h', 'iso')} AND h.fold = iso.fold GROUP BY ALL),
{probe} AS (SELECT {k}, fold, n, s, {ISO_AT} AS q FROM nb)"""


@query("refit_loss", f"""WITH {B}, {FOLDS}, {draws_sql('sf', ['model'], 'cluster', 17, REFIT_REPS)}, w1 AS (SELECT * FROM w UNION ALL SELECT DISTINCT model, -1, cluster, 1 FROM sf),
rh AS (SELECT sf.model, arm, rep, fold, score, sum(w) AS n, sum(w * label) AS s FROM sf JOIN w1 ON w1.model = sf.model AND w1.cluster = sf.cluster GROUP BY ALL), {fitted_sql('rh', ['model', 'arm', 'rep'], 'fq')}
SELECT model, arm, CAST(rep AS INTEGER) AS rep, round(sum(s * (1 - q) ** 2 + (n - s) * q ** 2), 6) AS loss, sum(n)::DOUBLE AS weight FROM fq GROUP BY ALL""")
def _(spark, sf):
    return S.rounded(refit_losses(spark, sf, REFIT_REPS))


@query("refit_loss_full")
def _(spark, sf):
    return S.rounded(RF.loss_difference(refit_losses(spark, sf, 20_000), ["model"], "arm", "bare", "grounded"))


SWEEP = f"""{B}, fc AS (SELECT cluster, fs, {md5_int('fs', 'cluster')} AS h FROM (SELECT DISTINCT cluster FROM s), range(20) t(fs)), ff AS (SELECT cluster, fs, ntile(5) OVER (PARTITION BY fs ORDER BY h, cluster) - 1 AS fold FROM fc),
fh AS (SELECT model, arm, fs, fold, score, count(*) AS n, sum(label) AS s FROM s JOIN ff ON s.cluster = ff.cluster GROUP BY ALL), {fitted_sql('fh', ['model', 'arm', 'fs'], 'fq')},
eb AS (SELECT model, arm, fs, {EDGE.replace('score', 'q')} AS bin, abs(sum(n * q) - sum(s)) AS d, sum(n) AS n FROM fq GROUP BY ALL), ee AS (SELECT model, arm, fs, sum(d) / sum(n) AS ece FROM eb GROUP BY ALL),
er AS (SELECT e.*, r.ece AS ref FROM ee e JOIN ee r ON r.model = e.model AND r.fs = e.fs AND r.arm = 'bare')"""


def sweep_errors(spark, sf):
    return RF.fold_sweep_errors(answered(spark, sf), BOTH, "cluster", "score", "label", 5, FOLD_SEEDS)


@query("fold_sweep", f"WITH {SWEEP} SELECT model, arm, count(*) AS draws, round(min(ece), 6) AS ece_min, round(median(ece), 6) AS ece_median, round(max(ece), 6) AS ece_max, round(avg(CAST(ece < ref AS INTEGER)), 6) AS below FROM er GROUP BY ALL")
def _(spark, sf):
    return S.rounded(RF.fold_sweep(sweep_errors(spark, sf), ["model"], "arm", "bare"))


@query("fold_sweep_runs_below", f"WITH {SWEEP}, p AS (SELECT fs, sum(CAST(ece < ref AS INTEGER))::BIGINT AS runs_below FROM er WHERE arm <> 'bare' GROUP BY fs) SELECT runs_below, count(*) AS draws FROM p GROUP BY ALL")
def _(spark, sf):
    return RF.runs_below(sweep_errors(spark, sf), ["model"], "arm", "bare")


@query("chance_band", f"""WITH {RW}, ob AS (SELECT model, arm, sum(n * abs(mean_p - rate)) / sum(n) AS ece FROM rw GROUP BY ALL),
u AS (SELECT rw0.*, r.rep, CAST({md5_int("'3'", 'r.rep', 'model', 'arm', 'item_id')} / 1152921504606846976.0::DOUBLE < score AS INTEGER) AS hit FROM rw0 CROSS JOIN range(100) r(rep)),
d AS (SELECT model, arm, rep, bin, sum(score - hit) AS d, count(*) AS n FROM u GROUP BY ALL), e AS (SELECT model, arm, rep, sum(abs(d)) / sum(n) AS ece_draw FROM d GROUP BY ALL)
SELECT e.model, e.arm, round(max(ece), 6) AS observed, round(quantile_cont(ece_draw, 0.95), 6) AS p95, round(avg(CAST(ece_draw >= ece - 1e-12 AS INTEGER)), 6) AS tail_share FROM e JOIN ob ON e.model = ob.model AND e.arm = ob.arm GROUP BY ALL""")
def _(spark, sf):
    s = scored(spark, sf)
    w = Q.reliability_width(s, BOTH)
    ob = w.groupBy(*BOTH).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    return S.rounded(Q.chance_band(s, BOTH, "item_id", "score", ob, 100, 3))


@query("chance_band_full")
def _(spark, sf):
    s = checkpointed(scored(spark, sf))
    w = Q.reliability_width(s, BOTH)
    ob = w.groupBy(*BOTH).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    return S.rounded(D.chance_band(s, BOTH, "score", ob, 20_000, 3))


# --- thresholds -------------------------------------------------------------------------------------------------------
FS = FR + ", fs AS (SELECT sequence, CAST(pixels[1] AS DOUBLE) AS score, label FROM fl)"


def finite(df):
    """Infinite cuts shown as a million, so that every engine prints them alike."""
    return S.rounded(df.withColumn("cut", F.greatest(F.least("cut", F.lit(1e6)), F.lit(-1e6))))


def frame_scores(spark, sf):
    return frame_calls(spark, sf).withColumn("score", F.get("pixels", F.lit(0)).cast("double"))


CUTS = """cs AS (SELECT {k} s, sum(label) AS pos, count(*) AS n FROM {src} GROUP BY ALL),
cr AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY {g}) AS tp, sum(n) OVER (PARTITION BY {g}) AS tn, lead(s) OVER w AS nxt, row_number() OVER w AS idx FROM cs WINDOW w AS (PARTITION BY {g} ORDER BY s)),
cu AS (SELECT {k} idx, coalesce((s + nxt) / 2, 'inf'::DOUBLE) AS cut, tp - cp + cn - cp AS "right", tn FROM cr UNION ALL SELECT {k} 0, '-inf'::DOUBLE, max(tp), max(tn) FROM cr GROUP BY ALL),
ct AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY {g}) AS ties FROM cu u WHERE "right" = (SELECT max("right") FROM cu z WHERE {m}))"""


@query("best_threshold", f"WITH {FS}, {CUTS.format(k='sequence, ', src='(SELECT *, score AS s FROM fs)', g='sequence', m='z.sequence = u.sequence')} SELECT sequence, round(greatest(least(cut, 1e6), -1e6), 6)::DOUBLE AS cut, round(\"right\" / tn::DOUBLE, 6)::DOUBLE AS accuracy, ties FROM ct WHERE pos = (ties - 1) // 2")
def _(spark, sf):
    return finite(Q.best_threshold(frame_scores(spark, sf), ["sequence"], "score", "label"))


@query("best_threshold_median", f"WITH {FS}, {CUTS.format(k='sequence, ', src='(SELECT *, score AS s FROM fs)', g='sequence', m='z.sequence = u.sequence')} SELECT sequence, round(greatest(least(avg(cut), 1e6), -1e6), 6)::DOUBLE AS cut, max(ties) AS ties FROM ct WHERE pos IN ((ties - 1) // 2, ties // 2) GROUP BY sequence")
def _(spark, sf):
    return finite(Q.best_threshold(frame_scores(spark, sf), ["sequence"], "score", "label", "median").select("sequence", "cut", "ties"))


LOGO = FS + ", ho AS (SELECT g.sequence AS grp, round(fs.score, 2) AS s, label FROM fs JOIN (SELECT DISTINCT sequence FROM fs) g ON g.sequence <> fs.sequence), " + CUTS.format(k="grp, ", src="ho", g="grp", m="z.grp = u.grp")


@query("leave_group_out_threshold", f"WITH {LOGO} SELECT grp AS sequence, round(greatest(least(cut, 1e6), -1e6), 6)::DOUBLE AS cut, round(\"right\" / tn::DOUBLE, 6)::DOUBLE AS train_accuracy FROM ct WHERE pos = (ties - 1) // 2")
def _(spark, sf):
    f = frame_scores(spark, sf).withColumn("score", F.round("score", 2))
    return finite(Q.leave_group_out_threshold(f, "sequence", "score", "label"))


@query("leave_group_out_calls", f"""WITH {LOGO}, c AS (SELECT grp, cut FROM ct WHERE pos = (ties - 1) // 2) SELECT sequence, count(*) AS n, CAST(sum(CASE WHEN round(score, 2) >= cut THEN 1 ELSE 0 END) AS BIGINT) AS called,
CAST(sum(CASE WHEN (round(score, 2) >= cut) = (label = 1) THEN 1 ELSE 0 END) AS BIGINT) AS right_n FROM fs JOIN c ON c.grp = fs.sequence GROUP BY sequence""")
def _(spark, sf):
    f = frame_scores(spark, sf).withColumn("score", F.round("score", 2)).drop("said")
    called = Q.apply_threshold(f, Q.leave_group_out_threshold(f, "sequence", "score", "label"), ["sequence"], "score")
    return called.groupBy("sequence").agg(F.count(F.lit(1)).alias("n"), F.sum("said").alias("called"), S.count_if(F.col("said") == F.col("label")).alias("right_n"))


# --- driver windows ---------------------------------------------------------------------------------------------------
DD = V.DRIVER_DAYS + ", dl AS (SELECT *, CAST(sample % 3 = 0 AS INTEGER) AS label, CAST(dayofweek(day) AS INTEGER) AS month, day < DATE '2024-01-20' AS train FROM ddays)"


def labelled_days(spark, sf):
    d = V.driver_days(spark, sf)
    return d.withColumns({"label": (F.col("sample") % 3 == 0).cast("int"), "month": F.dayofweek("day") - 1, "train": F.col("day") < "2024-01-20"})


@query("month_prior", f"WITH {DD}, m AS (SELECT month, avg(label) AS r FROM dl WHERE train AND month <> 3 GROUP BY month), a AS (SELECT avg(label) AS r FROM dl WHERE train AND month <> 3) SELECT dl.month, count(*) AS n, round(avg(coalesce(m.r, a.r)), 6) AS prior FROM dl LEFT JOIN m ON dl.month = m.month, a WHERE NOT train GROUP BY ALL")
def _(spark, sf):
    d = labelled_days(spark, sf)
    p = Q.month_prior(d.where("train and month <> 3"), d.where("not train"), "month", "label")
    return S.rounded(p.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.avg("prior").alias("prior")))


#: All training rows are fitted on; the fallback is met by an added evaluation row of a month (7) that no day has.
MONTH_PRIOR_FULL = f"WITH {DD}, m AS (SELECT month, avg(label) AS r FROM dl WHERE train GROUP BY month), a AS (SELECT avg(label) AS r FROM dl WHERE train), ev AS (SELECT month FROM dl WHERE NOT train UNION ALL SELECT 7) SELECT ev.month, count(*) AS n, round(avg(coalesce(m.r, a.r)), 6) AS prior FROM ev LEFT JOIN m ON ev.month = m.month, a GROUP BY ALL"


@query("month_prior_full", MONTH_PRIOR_FULL)
def _(spark, sf):
    d = labelled_days(spark, sf)
    unseen = spark.range(1).select(F.lit(7).alias("month"))
    p = Q.month_prior(d.where("train"), d.where("not train").select("month").unionByName(unseen), "month", "label")
    return S.rounded(p.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.avg("prior").alias("prior")))


CL = DD + ", cl AS (" + " UNION ALL ".join(f"SELECT month, '{d}' AS driver, avg({d}) AS mean, stddev_pop({d}) AS sd, count({d}) AS n FROM dl WHERE train GROUP BY month" for d in V.DRIVERS) + ")"


@query("climatology", f"WITH {CL} SELECT month, driver, round(mean, 6) AS mean, round(sd, 6) AS sd, n FROM cl")
def _(spark, sf):
    return S.rounded(Q.climatology(labelled_days(spark, sf).where("train"), V.DRIVERS, "month"))


Z = CL + ", zz AS (" + " UNION ALL ".join(f"SELECT sample, day, label, train, '{d}' AS driver, CASE WHEN sd > 0 THEN ({d} - mean) / sd END AS z FROM dl JOIN cl ON cl.month = dl.month AND cl.driver = '{d}'" for d in V.DRIVERS) + ")"


def zscores(spark, sf):
    d = labelled_days(spark, sf)
    clim = Q.climatology(d.where("train"), V.DRIVERS, "month")
    long = Q.long_drivers(d, ["sample", "day", "label", "train", "month"], {x: F.col(x) for x in V.DRIVERS}).withColumnRenamed("z", "v")
    j = J.join_climatology(long.withColumnRenamed("month", "m0"), clim.withColumnRenamed("driver", "__d"), F.col("m0")).where(F.col("driver") == F.col("__d"))
    return j.withColumn("z", AR.anomaly("v", "mean", "sd")).select("sample", "day", "label", "train", "driver", "z")


@query("anomaly", f"WITH {Z} SELECT driver, train, count(z) AS n, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS sd FROM zz GROUP BY ALL".replace("driver, train,", "driver, CAST(train AS INTEGER) AS train,"))
def _(spark, sf):
    z = zscores(spark, sf).withColumn("train", F.col("train").cast("int"))
    return S.rounded(z.groupBy("driver", "train").agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("sd")))


SCAN = """sg AS (SELECT driver, g.sign, z * g.sign AS v, label FROM {src} CROSS JOIN (SELECT unnest([1, -1]) AS sign) g WHERE z IS NOT NULL),
sh AS (SELECT driver, sign, v, sum(label) AS pos, count(*) AS n FROM sg GROUP BY ALL), sr AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY driver, sign) AS np FROM sh WINDOW w AS (PARTITION BY driver, sign ORDER BY v DESC)),
sa AS (SELECT driver, sign, sum(pos / np::DOUBLE * tp / seen::DOUBLE) AS ap, CAST(sum(n) AS BIGINT) AS n FROM sr GROUP BY ALL)"""


@query("single_driver_scan", f"WITH {Z}, {SCAN.format(src='zz')} SELECT driver, round(max(ap) FILTER (sign = 1), 6) AS ap_plus, round(max(ap) FILTER (sign = -1), 6) AS ap_minus, max(n) AS n FROM sa GROUP BY driver")
def _(spark, sf):
    return S.rounded(Q.single_driver_scan(zscores(spark, sf), "label"))


@query("signed_rank_score", f"WITH {Z}, {SCAN.format(src='(SELECT * FROM zz WHERE train)')}, g AS (SELECT driver, CASE WHEN max(ap) FILTER (sign = 1) >= max(ap) FILTER (sign = -1) THEN 1 ELSE -1 END AS sign FROM sa GROUP BY driver) SELECT zz.driver, CAST(max(g.sign) AS INTEGER) AS sign, count(*) AS n, round(avg(z * g.sign), 6) AS mean_signed FROM zz JOIN g ON g.driver = zz.driver WHERE NOT train GROUP BY zz.driver")
def _(spark, sf):
    z = zscores(spark, sf)
    t = Q.signed_rank_score(z.where("train"), z.where("not train"), "label")
    return S.rounded(t.groupBy("driver").agg(F.max("sign").alias("sign"), F.count(F.lit(1)).alias("n"), F.avg("signed").alias("mean_signed")))


@query("constant_and_naive", f"""WITH {B}, h AS (SELECT model, arm, score, sum(label) AS p, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER (PARTITION BY model, arm) AS np, sum(n) OVER (PARTITION BY model, arm) AS tot FROM h WINDOW w AS (PARTITION BY model, arm ORDER BY score DESC))
SELECT model, arm, CAST(max(tot) AS BIGINT) AS n, CAST(max(np) AS BIGINT) AS positives, round(max(2.0 * tp / (seen + np)), 6)::DOUBLE AS best_f1, round(max(np) / max(tot)::DOUBLE, 6)::DOUBLE AS yes_accuracy, round(2.0 * max(np) / (max(tot) + max(np)), 6)::DOUBLE AS yes_f1, round((max(tot) - max(np)) / max(tot)::DOUBLE, 6)::DOUBLE AS no_accuracy, round(max(np) / max(tot)::DOUBLE, 6)::DOUBLE AS no_skill_ap FROM r GROUP BY ALL""")
def _(spark, sf):
    return S.rounded(Q.constant_and_naive(scored(spark, sf), BOTH, "score", "label"))
