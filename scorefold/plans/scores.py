"""Queries over score tables, ranking metrics and calibration-free agreement."""

from pyspark.sql import functions as F

from scorefold.functions import arrays as AR
from scorefold.operators import cohort as K
from scorefold.operators import ordered as O
from scorefold.operators import panel as P
from scorefold.operators import scores as S
from scorefold.plans.audit import CLS
from scorefold.plans.cohort import paired, scored, three_variants, NWAY
from scorefold.plans.panel import pairs
from scorefold.plans.registry import query
from scorefold.sources import standins as V

N = V.NUMERIC
BOTH = ["model", "arm"]
B = V.PAIRED + ", s AS (SELECT * FROM scored WHERE score IS NOT NULL)"


def answered(spark, sf):
    return scored(spark, sf).where(F.col("score").isNotNull())


@query("regression_scores", f"""WITH {N} SELECT run, arm, count(*) AS items, count(prediction) AS parsed, round(avg(abs(target - prediction)), 4) AS mae, round(avg(abs(target - prediction) / scale), 6) AS mae_scaled,
round(avg(CAST(abs(target - prediction) / greatest(target, 1) <= 0.25 AS INTEGER)), 6) AS within_25, round(median(abs(ln((prediction + 1) / (target + 1)))), 6) AS median_abs_log_ratio,
round(avg(abs(target - prediction) / scale) FILTER (abs(target - persistence) / greatest(persistence, 1) > 0.1), 6) AS mae_scaled_moving, round(avg(CAST(abs(target - prediction) < abs(target - persistence) AS INTEGER)), 6) AS beats_persistence FROM nlog GROUP BY ALL""")
def _(spark, sf):
    return S.rounded(S.regression_scores(V.numeric_log(spark, sf), ["run", "arm"])).withColumn("mae", F.round("mae", 4))


@query("movement_scores", f"""WITH {N}, m AS (SELECT *, abs(target - persistence) / greatest(persistence, 1) > 0.1 AS t, abs(prediction - persistence) / greatest(persistence, 1) > 0.1 AS p, abs(target - prediction) / scale AS e FROM nlog WHERE prediction IS NOT NULL)
SELECT run, count(*) AS parsed, round(avg(e) FILTER (NOT t), 6) AS stable_error, round(avg(e) FILTER (t), 6) AS moving_error, round(avg(CAST(p AS INTEGER)) FILTER (NOT t), 6) AS false_move, round(avg(CAST(NOT p AS INTEGER)) FILTER (t), 6) AS missed_move,
round(avg(CAST(sign(target - persistence) = sign(prediction - persistence) AS INTEGER)) FILTER (t), 6) AS direction_right, round(avg(CAST(e < abs(target - persistence) / scale AS INTEGER)), 6) AS beats_persistence_scaled FROM m GROUP BY run""")
def _(spark, sf):
    return S.rounded(S.movement_scores(V.numeric_log(spark, sf), ["run"]))


@query("sweep_allocation", f"""WITH {N}, m AS (SELECT *, abs(target - prediction) / scale AS e, abs(target - persistence) / scale AS b FROM nlog)
SELECT run, count(*) AS items, count(prediction) AS parsed, round(avg(abs(target - prediction)), 4) AS mae, round(avg(e), 6) AS mae_scaled, round(avg(b) FILTER (prediction IS NOT NULL), 6) AS persistence_mae_scaled, round(avg(CAST(e < b AS INTEGER)), 6) AS beats_persistence,
round(avg(CAST(abs(prediction - target) <= 0.25 * target AS INTEGER)), 6) AS within_25_of_target, count(*) FILTER (prediction = persistence) AS persistence_copies, round((sum(e) - max(e)) / (count(e) - 1), 6) AS mae_scaled_without_worst FROM m GROUP BY run""")
def _(spark, sf):
    return S.rounded(S.sweep_scores(V.numeric_log(spark, sf), ["run"])).withColumn("mae", F.round("mae", 4))


@query("numeric_error_summary", f"WITH {N} SELECT arm, count(*) AS n, round(avg(CAST(abs(prediction - target) / abs(target) <= 0.1 AS INTEGER)), 6) AS within_10, round(median(abs(prediction - target) / abs(target)), 6) AS median_rel_error FROM nlog WHERE prediction IS NOT NULL GROUP BY arm")
def _(spark, sf):
    return S.rounded(S.numeric_error_summary(V.numeric_log(spark, sf), ["arm"]))


CONF = "count(*) AS items, count(said) AS parsed, count(*) FILTER (label = 1 AND said = 1) AS tp, count(*) FILTER (label = 0 AND said = 1) AS fp, count(*) FILTER (label = 1 AND said = 0) AS fn, count(*) FILTER (label = 0 AND said = 0) AS tn"


@query("binary_scores", f"""WITH {B}, c AS (SELECT model, arm, {CONF} FROM scored GROUP BY ALL)
SELECT *, round((tp + tn) / parsed::DOUBLE, 6) AS accuracy, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(fp / (fp + tn)::DOUBLE, 6) AS false_positive_rate, round(0.5 * (tp / (tp + fn)::DOUBLE + 1 - fp / (fp + tn)::DOUBLE), 6) AS balanced_accuracy,
round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1_positive, round(2 * tn / (2 * tn + fn + fp)::DOUBLE, 6) AS f1_negative, round((tp + fp) / parsed::DOUBLE, 6) AS call_rate FROM c""")
def _(spark, sf):
    return S.rounded(S.binary_scores(scored(spark, sf), BOTH))


@query("accuracy_by", f"""WITH {B}, c AS (SELECT model, arm, stratum, cluster, CAST(coalesce(said = label, false) AS INTEGER) AS correct FROM scored)
SELECT model, arm, 'stratum' AS dimension, stratum AS value, count(*) AS n, round(avg(correct), 6) AS accuracy FROM c GROUP BY ALL UNION ALL SELECT model, arm, 'cluster', cluster, count(*), round(avg(correct), 6) FROM c GROUP BY ALL
UNION ALL SELECT model, arm, 'all', 'all', count(*), round(avg(correct), 6) FROM c GROUP BY ALL""")
def _(spark, sf):
    s = scored(spark, sf).withColumn("correct", F.coalesce((F.col("said") == F.col("label")).cast("int"), F.lit(0)))
    return S.rounded(S.accuracy_by(s, BOTH, ["stratum", "cluster"]))


FR = V.FRAMES + ", fl AS (SELECT *, CASE WHEN pixels[1] > 0.05 THEN 1 ELSE 0 END AS said, CAST(offset_seconds > 0 AS INTEGER) AS label FROM frames)"


def frame_calls(spark, sf):
    f = V.frames(spark, sf)
    return f.withColumn("said", F.when(F.get("pixels", F.lit(0)).cast("double") > 0.05, 1).otherwise(0)).withColumn("label", (F.col("offset_seconds") > 0).cast("int")).withColumn("run", F.lit("a"))


@query("time_to_detection", f"""WITH {FR}, f AS (SELECT sequence, min(offset_seconds) FILTER (said = 1) AS hit FROM fl WHERE offset_seconds > 0 GROUP BY sequence)
SELECT 'a' AS run, count(*) AS sequences, count(hit) AS detected, median(hit)::DOUBLE AS median_offset FROM f""")
def _(spark, sf):
    return S.time_to_detection(frame_calls(spark, sf), ["run"])


@query("call_detail", f"""WITH {B} SELECT model, arm, count(*) AS n, count(*) FILTER (call IS NULL) AS omitted, count(*) FILTER (call = 1) AS stated_yes, count(*) FILTER (call IS NULL AND said = 1) AS imputed_yes, round(avg(CAST(said = 1 AS INTEGER)), 6) AS call_rate,
round(2.0 * count(*) FILTER (label = 1 AND said = 1) / greatest(2 * count(*) FILTER (label = 1 AND said = 1) + count(*) FILTER (label = 0 AND said = 1) + count(*) FILTER (label = 1 AND said = 0), 1), 6)::DOUBLE AS f1,
round(avg(CAST(score >= 1 / (1 + exp(0.4 * model - 0.5)) AS INTEGER)), 6) AS shifted_call_rate, round(2.0 * count(*) FILTER (label = 1 AND score >= 1 / (1 + exp(0.4 * model - 0.5))) / greatest(2 * count(*) FILTER (label = 1 AND score >= 1 / (1 + exp(0.4 * model - 0.5))) + count(*) FILTER ((label = 1) <> (score >= 1 / (1 + exp(0.4 * model - 0.5)))), 1), 6)::DOUBLE AS shifted_f1,
round(max(1 / (1 + exp(0.4 * model - 0.5))), 6) AS equivalent_threshold FROM s GROUP BY ALL""")
def _(spark, sf):
    return S.rounded(S.call_detail(scored(spark, sf), BOTH, delta=0.4 * F.col("model") - 0.5))


AP = """h AS (SELECT model, arm, score, sum(label) AS pos, count(*) AS n FROM s GROUP BY ALL),
hr AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY model, arm) AS np, sum(n) OVER (PARTITION BY model, arm) AS tot FROM h WINDOW w AS (PARTITION BY model, arm ORDER BY score DESC))"""


@query("average_precision", f"WITH {B}, {AP} SELECT model, arm, CAST(max(tot) AS BIGINT) AS n, CAST(max(np) AS BIGINT) AS positives, round(sum(pos / np::DOUBLE * tp / seen::DOUBLE), 6) AS ap FROM hr GROUP BY ALL")
def _(spark, sf):
    return S.rounded(S.average_precision(scored(spark, sf), BOTH))


@query("average_precision_weighted", f"""WITH {B}, h AS (SELECT model, arm, score, sum(label * n_chars)::DOUBLE AS pos, sum(n_chars)::DOUBLE AS n FROM s GROUP BY ALL),
hr AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY model, arm) AS np FROM h WINDOW w AS (PARTITION BY model, arm ORDER BY score DESC)) SELECT model, arm, round(sum(pos / np * tp / seen), 6) AS ap FROM hr GROUP BY ALL""")
def _(spark, sf):
    return S.rounded(S.average_precision(scored(spark, sf), BOTH, weight=F.col("n_chars"))).select(*BOTH, "ap")


@query("average_precision_untied", f"""WITH {B}, r AS (SELECT *, row_number() OVER w AS k, sum(label) OVER (PARTITION BY model, arm ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING) AS tp FROM s WINDOW w AS (PARTITION BY model, arm ORDER BY score DESC, item_id))
SELECT model, arm, count(*) AS n, round(sum(CASE WHEN label = 1 THEN tp / k::DOUBLE END) / sum(label), 6) AS ap_untied FROM r GROUP BY ALL""")
def _(spark, sf):
    return S.rounded(S.average_precision_untied(scored(spark, sf), BOTH, "score", "label", "item_id"))


@query("auroc", f"""WITH {B}, {AP} SELECT model, arm, CAST(max(np) AS BIGINT) AS positives, CAST(max(tot - np) AS BIGINT) AS negatives, round(sum(pos * ((tot - np) - (seen - tp) + (n - pos) / 2.0)) / (max(np) * max(tot - np)), 6)::DOUBLE AS auroc FROM hr GROUP BY ALL""")
def _(spark, sf):
    return S.rounded(S.auroc(scored(spark, sf), BOTH))


@query("cumulative_confusion", f"WITH {B}, {AP} SELECT model, arm, score, CAST(tp AS BIGINT) AS tp, CAST(seen - tp AS BIGINT) AS fp FROM hr")
def _(spark, sf):
    return S.cumulative_confusion(scored(spark, sf), BOTH)


RK = V.PAIRED + ", rk AS (SELECT model, (rank() OVER (PARTITION BY model ORDER BY a_score) + (count(*) OVER (PARTITION BY model, a_score) - 1) / 2.0)::DOUBLE AS ra, (rank() OVER (PARTITION BY model ORDER BY b_score) + (count(*) OVER (PARTITION BY model, b_score) - 1) / 2.0)::DOUBLE AS rb, label, a_score, b_score FROM paired)"


@query("spearman", f"WITH {RK} SELECT model, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM rk GROUP BY model")
def _(spark, sf):
    return S.rounded(S.spearman(paired(spark, sf), ["model"], "a_score", "b_score"))


@query("rank_sums", f"WITH {RK} SELECT model, CAST(sum(label) AS BIGINT) AS positives, count(*) AS n, round(sum(ra) FILTER (label = 1), 4) AS rank_sum FROM rk GROUP BY model")
def _(spark, sf):
    return S.rank_sums(paired(spark, sf), ["model"], "a_score", "label").withColumn("rank_sum", F.round("rank_sum", 4))


@query("average_ranks", f"WITH {RK} SELECT DISTINCT model, a_score, ra AS avg_rank FROM rk")
def _(spark, sf):
    return O.average_ranks(paired(spark, sf), ["model"], "a_score").select("model", "a_score", "avg_rank")


@query("granularity", f"""WITH {B}, h AS (SELECT model, arm, probability, count(*) AS n FROM scored WHERE probability IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model, arm ORDER BY n DESC, probability) AS rk, count(*) OVER (PARTITION BY model, arm) AS distinct_values, sum(n) OVER (PARTITION BY model, arm) AS total FROM h)
SELECT model, arm, distinct_values, CAST(rk AS INTEGER) AS rk, probability, n, round(n / total::DOUBLE, 6) AS share FROM r WHERE rk <= 10""")
def _(spark, sf):
    return S.rounded(S.granularity(scored(spark, sf), BOTH, "probability"))


@query("decision_consistency", f"""WITH {B}, d AS (SELECT *, CAST(probability >= 0.5 AS INTEGER) AS over FROM scored WHERE probability IS NOT NULL), e AS (SELECT *, call = 1 AND "over" = 0 AS low FROM d)
SELECT model, arm, count(*) AS n, count(*) FILTER (call = "over") AS consistent, count(*) FILTER (call <> "over") AS inconsistent, count(*) FILTER (call IS NULL) AS omitted, round(count(*) FILTER (call = "over") / count(*)::DOUBLE, 6) AS consistent_rate, count(*) FILTER (low) AS yes_below_half,
count(*) FILTER (call = 0 AND "over" = 1) AS no_above_half, min(probability) FILTER (low) AS yes_min, max(probability) FILTER (low) AS yes_max, round(quantile_cont(probability, 0.25) FILTER (low), 6) AS yes_p25, round(quantile_cont(probability, 0.5) FILTER (low), 6) AS yes_median, round(quantile_cont(probability, 0.75) FILTER (low), 6) AS yes_p75 FROM e GROUP BY ALL""".replace(" AS over FROM", ' AS "over" FROM'))
def _(spark, sf):
    return S.rounded(S.decision_consistency(scored(spark, sf), BOTH))


@query("discordance", f"""WITH {V.PAIRED} SELECT model, stratum, count(*) AS pairs, count(*) FILTER (label = 1 AND a_said = 0 AND b_said = 1) AS gained, count(*) FILTER (label = 1 AND a_said = 1 AND b_said = 0) AS lost,
count(*) FILTER (label = 1 AND a_said = 0 AND b_said = 1) - count(*) FILTER (label = 1 AND a_said = 1 AND b_said = 0) AS net, count(*) FILTER (label = 0 AND a_said = 0 AND b_said = 1) AS new_false_positives, count(*) FILTER (label = 0 AND a_said = 1 AND b_said = 0) AS removed_false_positives,
count(*) FILTER (label = 1 AND a_said = 0) AS missed_before, round(count(*) FILTER (label = 1 AND a_said = 0 AND b_said = 1) / nullif(count(*) FILTER (label = 1 AND a_said = 0), 0)::DOUBLE, 6) AS rescue_rate FROM paired GROUP BY ALL""")
def _(spark, sf):
    return S.rounded(S.discordance(paired(spark, sf), ["model", "stratum"]))


@query("position_rates", f"WITH {V.PAIRED} SELECT coalesce(stratum, 'all') AS position, count(*) AS pairs, round(avg(a_said), 6) AS bare_rate, round(avg(b_said), 6) AS grounded_rate, round(avg(b_said) - avg(a_said), 6) AS change FROM paired GROUP BY ROLLUP (stratum)")
def _(spark, sf):
    return S.rounded(S.position_rates(paired(spark, sf), "stratum"))


@query("ols_slope", "SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY ALL")
def _(spark, sf):
    s = S.ols_slope(V.table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return s.withColumn("slope", F.round("slope", 4))


@query("repeat_stability", f"""WITH {B}, a AS (SELECT model, item_id, label, said AS s1, score AS p1 FROM scored WHERE arm = 'bare'), b AS (SELECT model, item_id, said AS s2, score AS p2 FROM scored WHERE arm = 'grounded')
SELECT a.model, count(*) AS pairs, count(*) FILTER (s1 <> s2) AS flips, round(avg(abs(p1 - p2)), 6) AS mean_abs_change, count(*) FILTER (p1 <> p2) AS changed, round(avg(CAST(s1 = label AS INTEGER)), 6) AS accuracy_1, round(avg(CAST(s2 = label AS INTEGER)), 6) AS accuracy_2
FROM a JOIN b ON a.model = b.model AND a.item_id = b.item_id WHERE s1 IS NOT NULL AND s2 IS NOT NULL GROUP BY a.model""")
def _(spark, sf):
    s = scored(spark, sf)
    return S.rounded(S.repeat_stability(s.where("arm = 'bare'"), s.where("arm = 'grounded'"), ["model"], ["item_id"]))


@query("joint_value_counts", f"""WITH {NWAY}, w AS (SELECT item_id, model, max(label) AS label, max(score) FILTER (variant = 'bare') AS a, max(score) FILTER (variant = 'third') AS b FROM three WHERE score IS NOT NULL GROUP BY item_id, model HAVING count(DISTINCT variant) = 3)
SELECT a, b, label, count(*) AS n FROM w GROUP BY ALL""")
def _(spark, sf):
    w = K.n_way_aligned(three_variants(spark, sf), "variant", ["item_id", "model"], "score", ["bare", "grounded", "third"], ["label"])
    return S.joint_value_counts(w, "bare", "third", "label")


BS = f"bs AS (SELECT model, arm, count(*) FILTER (label = 1 AND said = 1) / count(*) FILTER (label = 1)::DOUBLE AS recall, avg(CAST(said = label AS INTEGER)) AS accuracy FROM s GROUP BY ALL)"


def small_scores(spark, sf):
    s = answered(spark, sf)
    return s.groupBy(*BOTH).agg(S.share(F.when(F.col("label") == 1, F.col("said") == 1)).alias("recall"), S.share(F.col("said") == F.col("label")).alias("accuracy"))


WIDE = "wide AS (SELECT model, 'recall' AS metric, max(recall) FILTER (arm = 'bare') AS bare, max(recall) FILTER (arm = 'grounded') AS grounded FROM bs GROUP BY model UNION ALL SELECT model, 'accuracy', max(accuracy) FILTER (arm = 'bare'), max(accuracy) FILTER (arm = 'grounded') FROM bs GROUP BY model)"


@query("sweep_tallies", f"""WITH {B}, {BS}, {WIDE} SELECT metric, count(*) FILTER (grounded > bare) AS raised, count(*) FILTER (grounded < bare) AS lowered, count(*) FILTER (grounded = bare) AS equal, round(min(bare), 6) AS base_min, round(max(bare), 6) AS base_max,
round(min(grounded), 6) AS other_min, round(max(grounded), 6) AS other_max, round(min(grounded - bare), 6) AS change_min, round(max(grounded - bare), 6) AS change_max FROM wide GROUP BY metric""")
def _(spark, sf):
    return S.rounded(S.sweep_tallies(small_scores(spark, sf), "model", "arm", ["recall", "accuracy"], "bare", "grounded"))


@query("contrast_table", f"""WITH {B}, {BS}, {WIDE} SELECT CAST(model AS VARCHAR) AS model, metric, round(bare, 6) AS bare, round(grounded, 6) AS grounded, round(grounded - bare, 6) AS change FROM wide UNION ALL SELECT 'all', metric, round(avg(bare), 6), round(avg(grounded), 6), round(avg(grounded - bare), 6) FROM wide GROUP BY metric""")
def _(spark, sf):
    return S.rounded(S.contrast_table(small_scores(spark, sf), ["model"], "arm", "bare", "grounded", ["recall", "accuracy"]))


@query("monotone_in_order", f"WITH {B}, {BS}, m AS (SELECT *, lag(accuracy) OVER (PARTITION BY arm ORDER BY model) AS prv FROM bs) SELECT arm, count(*) AS members, 1 - max(CASE WHEN accuracy > prv THEN 1 ELSE 0 END) AS monotone FROM m GROUP BY arm")
def _(spark, sf):
    return S.monotone_in_order(small_scores(spark, sf), "arm", "model", "accuracy")


@query("cv_metrics", f"WITH {N}, f AS (SELECT run, item_id % 5 AS fold, avg(abs(target - prediction)) AS mae, avg(abs(target - prediction) / scale) AS mae_scaled FROM nlog GROUP BY ALL) SELECT run, count(*) AS folds, round(avg(mae), 4) AS cv_mae, round(avg(mae_scaled), 6) AS cv_mae_scaled FROM f GROUP BY run")
def _(spark, sf):
    l = V.numeric_log(spark, sf).withColumn("fold", F.col("item_id") % 5)
    return S.rounded(S.cv_metrics(l, "run", "fold")).withColumn("cv_mae", F.round("cv_mae", 4))


@query("run_listing", f"WITH {B} SELECT model, arm, stratum, count(*) AS rows, count(score) AS parsed, count(*) - count(score) AS missing, count(*) FILTER (probability IS NOT NULL AND call IS NULL) AS omitted_call FROM scored GROUP BY ALL HAVING count(*) >= 60")
def _(spark, sf):
    return S.run_listing(scored(spark, sf), ["model", "arm", "stratum"], 60)


# --- agreement with displayed analogues: an order's analogues are the ratios of its lines -----------------------------
CP = V.NUMERIC + """, rt AS (SELECT l_orderkey, list(l_quantity / 25.0::DOUBLE) AS ratios, list(l_extendedprice) AS outcomes FROM lineitem GROUP BY l_orderkey),
cp0 AS (SELECT item_id, run, round_even(persistence / 1000, 0) AS persistence, CASE WHEN item_id % 3 = 0 THEN round_even(persistence / 1000, 0) ELSE NULL END AS keep, ratios, outcomes, target FROM nlog JOIN rt ON l_orderkey = item_id),
cp1 AS (SELECT *, CAST(printf('%.2f', list_median(ratios)) AS DOUBLE) AS shown FROM cp0),
cp AS (SELECT *, round_even(persistence * shown, 0) AS rule, CASE item_id % 3 WHEN 0 THEN persistence WHEN 1 THEN round_even(persistence * shown, 0) ELSE round_even(target / 1000, 0) END AS prediction FROM cp1)""".replace("list_median(ratios)", "list_aggregate(ratios, 'median')")


def copy_log(spark, sf):
    lines = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_list(F.col("l_quantity") / 25.0).alias("ratios"), F.collect_list("l_extendedprice").alias("outcomes"))  # a handful of lines per order
    l = V.numeric_log(spark, sf).drop("prediction").join(lines, "item_id").withColumn("persistence", F.bround(F.col("persistence") / 1000, 0))
    n = F.size("ratios")
    srt = F.array_sort("ratios")
    med = (F.get(srt, F.floor((n - 1) / 2).cast("int")) + F.get(srt, F.floor(n / 2).cast("int"))) / 2
    rule = F.bround(F.col("persistence") * F.format_string("%.2f", med).cast("double"), 0)
    return l.withColumn("prediction", F.when(F.col("item_id") % 3 == 0, F.col("persistence")).when(F.col("item_id") % 3 == 1, rule).otherwise(F.bround(F.col("target") / 1000, 0)))


@query("copy_agreement", f"""WITH {CP} SELECT run, count(*) AS n, count(*) FILTER (prediction = rule) AS equal_rule, round(avg(CAST(prediction = rule AS INTEGER)), 6) AS equal_rule_share, round(avg(CAST(prediction = persistence AS INTEGER)), 6) AS equal_persistence_share,
round(avg(abs(prediction - rule)), 6) AS mean_dev, median(abs(prediction - rule)) AS median_dev FROM cp GROUP BY run""")
def _(spark, sf):
    return S.rounded(S.copy_agreement(copy_log(spark, sf), ["run"]))


@query("extreme_copies", f"WITH {CP} SELECT run, count(*) AS n, count(*) FILTER (persistence <= 400 AND list_contains(list_transform(outcomes, lambda o: round_even(o / 1000, 0)), prediction) AND prediction >= 40) AS extreme FROM cp GROUP BY run")
def _(spark, sf):
    l = copy_log(spark, sf).withColumn("outcomes", F.transform("outcomes", lambda o: F.bround(o / 1000, 0)))
    return S.extreme_copies(l, ["run"], "outcomes", 40, 400)


# --- comparators ------------------------------------------------------------------------------------------------------
@query("majority_class", """WITH h AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rk, lead(n) OVER w AS second, sum(n) OVER (PARTITION BY source) AS total FROM h WINDOW w AS (PARTITION BY source ORDER BY n DESC, lang))
SELECT source, lang, n, round(n / total::DOUBLE, 6) AS share, n - coalesce(second, 0) AS margin FROM r WHERE rk = 1""")
def _(spark, sf):
    return S.rounded(S.majority_class(V.table(spark, sf, "documents"), ["source"], "lang"))


@query("hybrid_reference", """WITH h AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT source, arg_max(lang, n * 1000 - ascii(lang) * 1.0) AS maj FROM h GROUP BY source),
i AS (SELECT d.source, d.lang, CASE WHEN n_chars > 1000 THEN 'en' END AS rule, maj FROM documents d JOIN m ON d.source = m.source)
SELECT source, count(*) AS n, round(avg(CAST(coalesce(rule, maj) = lang AS INTEGER)), 6) AS hybrid, round(avg(CAST(maj = lang AS INTEGER)), 6) AS majority, 0.25::DOUBLE AS random_floor FROM i GROUP BY source""")
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    m = S.majority_class(d, ["source"], "lang").select("source", F.col("lang").alias("maj"))
    i = d.join(m, "source").withColumn("rule", F.when(F.col("n_chars") > 1000, "en")).withColumn("options", F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]))
    return S.rounded(S.hybrid_reference(i, ["source"], "rule", "maj", "lang", "options"))


@query("matched_comparator", f"""WITH {B}, c AS (SELECT model, item_id, label, 'length' AS comparator, n_chars::DOUBLE AS v FROM s WHERE arm = 'bare' UNION ALL SELECT model, item_id, label, 'toxic', toxic::DOUBLE FROM s WHERE arm = 'bare'),
h AS (SELECT model, comparator, v, sum(label) AS pos, count(*) AS n FROM c GROUP BY ALL), hr AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY model, comparator) AS np, sum(n) OVER (PARTITION BY model, comparator) AS tot FROM h WINDOW w AS (PARTITION BY model, comparator ORDER BY v DESC))
SELECT model, comparator, CAST(max(tot) AS BIGINT) AS n, CAST(max(np) AS BIGINT) AS positives, round(sum(pos / np::DOUBLE * tp / seen::DOUBLE), 6) AS ap FROM hr GROUP BY ALL""")
def _(spark, sf):
    ans = answered(spark, sf).where("arm = 'bare'").select("model", "item_id")
    return S.rounded(S.matched_comparator(ans, V.paired_items(spark, sf), ["model"], "item_id", {"length": F.col("n_chars"), "toxic": F.col("toxic")}, "label"))


@query("modal_answer", "WITH n AS (SELECT o_orderstatus, o_orderpriority AS modal_answer, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, modal_answer) AS k, sum(n) OVER (PARTITION BY o_orderstatus) AS t FROM n) SELECT o_orderstatus, modal_answer, CAST(t AS BIGINT) AS n, round(n / t::DOUBLE, 6) AS modal FROM r WHERE k = 1")
def _(spark, sf):
    return S.rounded(S.modal_answer(V.table(spark, sf, "orders"), ["o_orderstatus"], F.col("o_orderpriority")))


@query("combined_baseline", """WITH c AS (SELECT o_orderkey AS pair, o_orderpriority AS answer, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'x' END AS head FROM orders),
t AS (SELECT l_orderkey AS pair, CASE WHEN l_orderkey % 5 = 0 THEN o_orderpriority ELSE l_returnflag END AS answer FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1),
m AS (SELECT max(n) AS modal_hits, CAST(sum(n) AS BIGINT) AS n_text FROM (SELECT answer, count(*) AS n FROM t GROUP BY answer)), f AS (SELECT count(*) AS n_choice, count(*) FILTER (head = answer) AS first_hits FROM c),
p AS (SELECT count(*) FILTER (c.answer = t.answer) AS copied FROM c JOIN t USING (pair))
SELECT n_choice, n_text, first_hits, modal_hits, copied, round((first_hits + modal_hits) / (n_choice + n_text)::DOUBLE, 6) AS combined, round(copied / n_text::DOUBLE, 6) AS copy_across FROM f, m, p""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair"), F.col("o_orderpriority").alias("answer"))
    choices = o.withColumn("options", F.array(F.when(F.col("pair") % 3 == 0, F.col("answer")).otherwise("x")))
    l = V.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("pair"), "l_returnflag").join(o, "pair")
    texts = l.select("pair", F.when(F.col("pair") % 5 == 0, F.col("answer")).otherwise(F.col("l_returnflag")).alias("answer"))
    return S.rounded(S.combined_baseline(choices, texts, "pair"))


@query("option_position_baselines", """WITH g AS (SELECT o_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS o FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) * CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 100 END AS VARCHAR) AS l_returnflag FROM lineitem) GROUP BY o_orderkey),
b AS (SELECT o_orderpriority, o, list_extract(o, 1 + CAST(g.o_orderkey % len(o) AS BIGINT)) AS ans, list_sort([{'l': length(o[CAST(i AS BIGINT)]), 'i': i} FOR i IN range(1, len(o) + 1)]) AS up, list_sort([{'l': -length(o[CAST(i AS BIGINT)]), 'i': i} FOR i IN range(1, len(o) + 1)]) AS dn FROM g JOIN orders ON g.o_orderkey = orders.o_orderkey),
s AS (SELECT o_orderpriority, count(*) AS n, avg(CAST(o[1] = ans AS INTEGER)) AS first, avg(CAST(o[-1] = ans AS INTEGER)) AS last, avg(CAST(o[CAST(up[1].i AS BIGINT)] = ans AS INTEGER)) AS shortest, avg(CAST(o[CAST(dn[1].i AS BIGINT)] = ans AS INTEGER)) AS longest FROM b GROUP BY ALL)
SELECT o_orderpriority, n, round(first, 6) AS "first", round(last, 6) AS "last", round(shortest, 6) AS shortest, round(longest, 6) AS longest, round(1.96::DOUBLE * sqrt(first * (1 - first) / n), 6) AS first_halfwidth FROM s""")
def _(spark, sf):
    l = V.table(spark, sf, "lineitem")
    opt = (F.col("l_quantity").cast("bigint") * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(100)).cast("string")
    g = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", opt.alias("v")))), lambda s: s["v"]).alias("options"))
    i = g.join(V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").withColumn("answer", F.get("options", F.pmod("o_orderkey", F.size("options")).cast("int")))
    return S.rounded(S.option_position_baselines(i, ["o_orderpriority"]))


@query("difficulty_runs", """WITH p AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders), c AS (SELECT *, CASE WHEN lag(o_orderstatus) OVER (ORDER BY pos) IS DISTINCT FROM o_orderstatus THEN 1 ELSE 0 END AS ch FROM p),
r AS (SELECT *, sum(ch) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT CAST(run AS BIGINT) AS run, min(pos) AS start, min(o_orderstatus) AS o_orderstatus, count(*) AS length FROM r GROUP BY run""")
def _(spark, sf):
    return S.difficulty_runs(V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), [], ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query("last_valid", f"WITH {V.DRIVER_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY day DESC) - 1 AS back FROM ddays) SELECT sample, round(arg_min(signup, back) FILTER (signup IS NOT NULL), 6) AS value, min(back) FILTER (signup IS NOT NULL) AS days_back FROM r GROUP BY sample")
def _(spark, sf):
    w = P.window_arrays(V.driver_days(spark, sf), V.DRIVERS)
    return w.select("sample", F.round(S.last_valid("signup")["value"], 6).alias("value"), S.last_valid("signup")["days_back"].alias("days_back"))


@query("dynamics_profile", f"""WITH {V.PAIRS}, {CLS}, d AS (SELECT p5, a, next / greatest(today, 1) AS x FROM cx)
SELECT coalesce(p5, '*') AS change, coalesce(a, '*') AS growth, count(*) AS n, round(avg(CAST(abs(x - 1) > 0.1::DOUBLE AS INTEGER)), 6) AS p_move, round(avg(CAST(x > 1 + 0.1::DOUBLE AS INTEGER)), 6) AS p_up, round(avg(CAST(x < 1 - 0.1::DOUBLE AS INTEGER)), 6) AS p_down, round(avg(x), 6) AS mean_ratio,
round(median(x), 6) AS median_ratio, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.75), 6) AS q75 FROM d GROUP BY GROUPING SETS ((p5), (a), (p5, a), ())""")
def _(spark, sf):
    from scorefold.operators.retrieve import dynamics_profile

    p = pairs(spark, sf).withColumn("change", AR.change_class(AR.ratio("today", "prev"), 5)).withColumn("growth", AR.grew("acres", "acres_prev", "new_acres"))
    return S.rounded(dynamics_profile(p, ["change", "growth"]))
