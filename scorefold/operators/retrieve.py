"""Analogue retrieval: draws and nearest rows from a large dated pool without pairing every item with every candidate.

*Draws by position.* Inside a key (band, band and change class, ...) the pool is ordered by date, so the rows an item may use
(outcome day before its report day) are a prefix. The size of that prefix comes from one running sum; k positions are drawn
from it with a seeded hash; the item's own rows are stepped over; and the drawn positions are looked up with an equi-join.
Cost: the pool once, plus k rows per item.

*Nearest rows* come from a tree of boxes, see ``nearest.py``: exact, no candidate cap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scorefold.functions import arrays as A
from scorefold.functions.arrays import report_features
from scorefold.functions.columns import hash_int, shown
from scorefold.operators import nearest as N
from scorefold.operators.ordered import asof_sum, percentiles, positions, top_rows
from scorefold.session import checkpointed

K = 6  # fixed value: analogues per item
MOVE = 0.1  # fixed value: a ratio moves beyond a tenth
PHASE_SHRINK = 20.0  # fixed value: pseudo-count toward the global rate
DOR_EDGES = (2, 3, 4, 6, 8, 11, 15, 21, 31)  # fixed values: day-of-run bands
# Distance weights, in the order of FEATURES.
FEATURES = ("f_pers", "f_acres", "f_pct", "f_day", "f_change", "f_new", "f_aerial")
WEIGHTS = {
    "eq": (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
    "chg": (1.0, 1.0, 1.0, 1.0, 4.0, 3.0, 1.0),
    "dyn": (1.0, 1.0, 1.0, 3.0, 4.0, 3.0, 1.0),
    "sta": (3.0, 2.0, 2.0, 1.0, 1.0, 1.0, 1.0),
    "nochg": (1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0),
    "band3": (1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0),
}


def outcome_ratio() -> Column:
    return F.col("next") / F.greatest(F.col("today"), F.lit(1.0))


# --- draws by position ------------------------------------------------------------------------------------------------
def eligible_counts(items: DataFrame, pool: DataFrame, key: str, out: str = "eligible") -> DataFrame:
    """Per item the pool rows in its key whose outcome day (date + 1) precedes the report day, own incident left out."""
    probe = items.withColumn("__cut", F.date_sub("report_date", 1))
    hist = pool.groupBy(key, "report_date").agg(F.count(F.lit(1)).alias("__n"))
    summed = asof_sum(probe, hist, [key], "__cut", "report_date", "__n", "__all", ["item_id"])
    own = _own_rows(items, pool, key).groupBy("item_id", key).agg(F.count(F.lit(1)).alias("__own"))
    out_df = summed.join(own, ["item_id", key], "left")
    return out_df.withColumn(out, F.col("__all") - F.coalesce("__own", F.lit(0))).drop("__cut", "__all", "__own")


def _own_rows(items: DataFrame, pool: DataFrame, key: str, extra: Sequence[str] = ()) -> DataFrame:
    """The item's own incident's earlier rows inside its key: bounded by the days of one incident."""
    p = pool.select(F.col("incident_id").alias("__pi"), F.col("report_date").alias("__pd"), F.col(key).alias("__pk"), *extra)
    i = items.select("item_id", "incident_id", "report_date", key).distinct()
    return i.join(p, (F.col("incident_id") == F.col("__pi")) & (F.col(key) == F.col("__pk")) & (F.col("__pd") < F.date_sub("report_date", 1)))


def draw_from(size: Column, k: Column, seed: int, ident: str) -> Column:
    """k distinct positions of 0 .. size-1, every k-subset equally likely (Floyd's sampling driven by a seeded hash)."""
    take = F.least(k.cast("bigint"), size)
    steps = F.when(take > 0, F.sequence(F.lit(0).cast("bigint"), take - 1)).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, i: Column) -> Column:
        top = size - take + i
        t = F.pmod(hash_int(seed, ident, i), top + 1)
        return F.concat(acc, F.array(F.when(F.array_contains(acc, t), top).otherwise(t)))

    return F.aggregate(steps, F.array().cast("array<bigint>"), step)


def step_over(pos: Column, taken: Column) -> Column:
    """Position in the full order of the pos-th row once the (sorted) ``taken`` positions are left out."""
    shifted = F.transform(taken, lambda x, i: x - i)
    return pos + F.size(F.filter(shifted, lambda y: y <= pos))


def draw_by_key(items: DataFrame, pool: DataFrame, key: str, k: int = K, seed: int = 1, ordered: DataFrame | None = None) -> DataFrame:
    """(item_id, pool row) for up to k seeded-random eligible rows of the item's key.

    The ordered pool is read by the counting, the stepping-over and the look-up, so it is written once.
    """
    ordered = ordered_pool(pool, key) if ordered is None else ordered
    want = draw_positions(items, key, k, seed, ordered)
    return want.join(ordered.withColumnRenamed("incident_id", "analogue_incident").withColumnRenamed("report_date", "analogue_date"), [key, "pos"]).drop("pos")


def ordered_pool(pool: DataFrame, key: str) -> DataFrame:
    """The pool with each row's position in its key by (date, id), written to the checkpoint folder."""
    return checkpointed(positions(checkpointed(pool), [key], ["report_date", "analogue_id"], "pos"))


def draw_positions(items: DataFrame, key: str, k: int, seed: int, ordered: DataFrame) -> DataFrame:
    items = checkpointed(items.select("item_id", "incident_id", "report_date", key))
    counted = eligible_counts(items, ordered, key)
    own = _own_rows(items, ordered, key, ["pos"]).groupBy("item_id").agg(F.sort_array(F.collect_list("pos")).alias("__taken"))
    d = counted.where(F.col("eligible") > 0).join(own, "item_id", "left").withColumn("__taken", F.coalesce("__taken", F.array().cast("array<bigint>")))
    d = d.select("item_id", key, "__taken", F.explode(draw_from(F.col("eligible"), F.lit(k), seed, "item_id")).alias("__r"))
    return d.select("item_id", key, step_over(F.col("__r"), F.col("__taken")).alias("pos"))


# --- ladders ----------------------------------------------------------------------------------------------------------
def change_components(df: DataFrame, today: str = "today") -> DataFrame:
    """The change classes a ladder may be built from: one-day (p3 p5, exact holds p4x p6x, two-day holds p5s p7s), two-day
    trend (t3 t5) and area growth (a). Needs prev, prev2, acres, acres_prev and new_acres."""
    one, two = A.ratio(today, "prev"), A.ratio(today, "prev2")
    return df.withColumns({
        "p3": A.change_class(one), "p5": A.change_class(one, 5), "p4x": A.exact_class(today, "prev"), "p6x": A.exact_class(today, "prev", 5),
        "p5s": A.streak_class(today, "prev", "prev2"), "p7s": A.streak_class(today, "prev", "prev2", 5),
        "t3": A.change_class(two), "t5": A.change_class(two, 5), "a": A.grew("acres", "acres_prev", "new_acres")})


def ladder_keys(df: DataFrame, components: Sequence[str], out: str = "lkey") -> DataFrame:
    """One row per ladder level: level n keys on the first n components."""
    levels = [F.struct(F.lit(n).alias("level"), F.concat_ws("|", F.lit(str(n)), *components[:n]).alias("key")) for n in range(1, len(components) + 1)]
    return df.withColumn("__l", F.explode(F.array(*levels))).withColumn("level", F.col("__l.level")).withColumn(out, F.col("__l.key")).drop("__l")


def retrieve_ladder(items: DataFrame, pool: DataFrame, components: Sequence[str], min_rows: int = 3, k: int = K, seed: int = 1) -> DataFrame:
    """k rows from the most specific level that holds at least ``min_rows`` eligible rows, else from the broadest."""
    p = ordered_pool(ladder_keys(pool, components), "lkey")
    i = ladder_keys(checkpointed(items.select("item_id", "incident_id", "report_date", *components)), components)
    n = eligible_counts(i, p, "lkey")
    fits = F.when(F.col("eligible") >= min_rows, F.col("level")).otherwise(0 - F.col("level"))
    best = n.groupBy("item_id").agg(F.max_by(F.struct("incident_id", "report_date", "level", "lkey"), fits).alias("b"))
    return draw_by_key(best.select("item_id", "b.*"), p, "lkey", k, seed, ordered=p.drop("level"))


def retrieve_ladder_fill(items: DataFrame, pool: DataFrame, components: Sequence[str], k: int = K, seed: int = 1) -> DataFrame:
    """Top up level by level. Levels are nested, so this is: every row of the level below the first level holding k, and the
    missing rows drawn from that level without them."""
    ordered = ordered_pool(ladder_keys(pool, components), "lkey")
    i = ladder_keys(checkpointed(items.select("item_id", "incident_id", "report_date", *components)), components)
    n = checkpointed(eligible_counts(i, ordered, "lkey"))
    full = F.when(F.col("eligible") >= k, F.col("level")).otherwise(0 - F.col("level"))
    base = n.groupBy("item_id").agg(F.max_by("level", full).alias("base"))
    lv = n.join(base, "item_id").where(F.col("level").isin(F.col("base")) | (F.col("level") == F.col("base") + 1))
    inner = lv.where(F.col("level") == F.col("base") + 1).select("item_id", "incident_id", "report_date", "lkey", "base")
    taken = checkpointed(draw_positions(inner, "lkey", k, seed, ordered).join(ordered.select("lkey", "pos", "analogue_id"), ["lkey", "pos"]).select("item_id", "analogue_id"))
    outer = lv.where(F.col("level") == F.col("base")).select("item_id", "incident_id", "report_date", "lkey", "eligible")
    at = ordered.select("lkey", "pos", "analogue_id")
    inside = taken.join(outer.select("item_id", "lkey"), "item_id").join(at, ["lkey", "analogue_id"]).select("item_id", "pos", F.lit(1).alias("__in"))
    own = _own_rows(outer, ordered, "lkey", ["pos"]).select("item_id", "pos", F.lit(0).alias("__in"))
    skip = inside.unionByName(own).groupBy("item_id").agg(F.sort_array(F.collect_list("pos")).alias("__taken"), F.sum("__in").alias("__c"))
    d = outer.join(skip, "item_id", "left").withColumns({"__taken": F.coalesce("__taken", F.array().cast("array<bigint>")), "__c": F.coalesce("__c", F.lit(0))})
    left = F.col("eligible") - F.col("__c")
    d = d.where(left > 0).select("item_id", "lkey", "__taken", F.explode(draw_from(left, F.lit(k) - F.col("__c"), seed + 1, "item_id")).alias("__r"))
    extra = d.select("item_id", "lkey", step_over(F.col("__r"), F.col("__taken")).alias("pos")).join(at, ["lkey", "pos"]).select("item_id", "analogue_id")
    draws = taken.unionByName(extra)
    return draws.join(pool.withColumnRenamed("incident_id", "analogue_incident").withColumnRenamed("report_date", "analogue_date"), "analogue_id")


# --- quota draws ------------------------------------------------------------------------------------------------------
def stratum() -> Column:
    x = outcome_ratio()
    return F.when(F.abs(x - 1) <= MOVE, "held").when(x > 1, "up").otherwise("down")


def retrieve_quota(items: DataFrame, pool: DataFrame, band: str, wide: str, k: int = K, seed: int = 1, direction: str = "mixed") -> DataFrame:
    """floor(k * p_move + 0.5) moved rows and the rest held rows; the band first, other bands of the same ``wide`` key to top
    up. Directions: ``mixed`` draws moved rows of both kinds, ``trend`` follows the item's ``trend`` sign, ``model`` splits
    by ``p_up``. A group's segments (bands of the wide key) are concatenated by their eligible counts, and positions are
    drawn from the concatenation, so a segment's rows are never gathered.
    """
    ordered = ordered_pool(pool.withColumn("seg", F.concat_ws("#", band, stratum())), "seg")
    segs = ordered.groupBy(wide, band, stratum().alias("stratum"), "seg").agg(F.lit(1)).select(F.col(wide).alias("__w"), F.col(band).alias("__b"), "stratum", "seg")

    n_move = F.greatest(F.lit(0), F.least(F.lit(k), F.floor(k * F.col("p_move") + 0.5)))
    it = checkpointed(items).withColumn("n_move", n_move).withColumn("n_held", k - F.col("n_move"))
    if direction == "model":
        up = F.greatest(F.lit(0), F.least(F.col("n_move"), F.floor(F.col("n_move") * F.col("p_up") + 0.5)))
        quotas = [("held", F.col("n_held")), ("up", up), ("down", F.col("n_move") - up)]
    elif direction == "trend":
        t = F.col("trend")
        quotas = [("held", F.col("n_held")), ("up", F.when(t > 0, F.col("n_move")).otherwise(0)), ("down", F.when(t < 0, F.col("n_move")).otherwise(0)),
                  ("any", F.when(t == 0, F.col("n_move")).otherwise(0))]
    else:
        quotas = [("held", F.col("n_held")), ("any", F.col("n_move"))]
    q = it.select("item_id", "incident_id", "report_date", F.col(band).alias("__ib"), F.col(wide).alias("__iw"),
                  F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), c.cast("bigint").alias("quota")) for g, c in quotas])).alias("q"))
    q = q.select("item_id", "incident_id", "report_date", "__ib", "__iw", "q.grp", "q.quota").where("quota > 0")
    member = (F.col("grp") == F.col("stratum")) | ((F.col("grp") == "any") & F.col("stratum").isin("up", "down"))
    # bands x strata of one wide key: a fixed domain of a few dozen segments
    cells = q.join(segs, (q["__iw"] == segs["__w"]) & member).select("item_id", "incident_id", "report_date", "grp", "quota", "seg", (F.col("__ib") == F.col("__b")).alias("first"))
    keyed = cells.withColumn("cid", F.concat_ws("#", F.col("item_id"), "grp"))
    counted = eligible_counts(keyed.withColumnRenamed("item_id", "base_item").withColumnRenamed("cid", "item_id"), ordered, "seg")
    side = W.partitionBy("item_id", "first")
    c = counted.withColumn("before", F.coalesce(F.sum("eligible").over(side.orderBy("seg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("total", F.sum("eligible").over(side))
    prim = F.max(F.when(F.col("first"), F.col("total")).otherwise(0)).over(W.partitionBy("item_id"))
    want = F.when(F.col("first"), F.least("quota", "total")).otherwise(F.least(F.greatest(F.col("quota") - prim, F.lit(0)), "total"))
    c = c.withColumn("__side", F.when(F.col("first"), "p").otherwise("s")).withColumn("want", want).where("want > 0")
    c = checkpointed(c.withColumn("sid", F.concat_ws("#", "item_id", "__side")))
    own = _own_rows(c, ordered, "seg", ["pos"]).groupBy("item_id", "seg").agg(F.sort_array(F.collect_list("pos")).alias("__taken"))
    d = c.withColumn("__rs", draw_from(F.col("total"), F.col("want"), seed, "sid")).join(own, ["item_id", "seg"], "left")
    d = d.withColumn("__taken", F.coalesce("__taken", F.array().cast("array<bigint>")))
    mine = F.filter("__rs", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("eligible")))
    d = d.select(F.col("base_item").alias("item_id"), "grp", "seg", "__taken", F.col("before").alias("__before"), F.explode(mine).alias("__r"))
    d = d.select("item_id", "grp", "seg", step_over(F.col("__r") - F.col("__before"), F.col("__taken")).alias("pos"))
    return d.join(ordered.withColumnRenamed("incident_id", "analogue_incident").withColumnRenamed("report_date", "analogue_date"), ["seg", "pos"]).drop("pos", "seg")


def phase_table(rows: DataFrame, day_band: str, pct_band: str, moved: Column, shrink: float = PHASE_SHRINK) -> DataFrame:
    """Move rate per (day band, containment band), shrunken toward the global rate."""
    g = rows.agg(F.avg(moved.cast("double")).alias("global_rate"))
    cells = rows.groupBy(day_band, pct_band).agg(F.count(F.lit(1)).alias("n"), F.sum(moved.cast("int")).alias("moved_n"))
    return cells.crossJoin(F.broadcast(g)).withColumn("p_move", (F.col("moved_n") + shrink * F.col("global_rate")) / (F.col("n") + shrink))


def training_rows(pool: DataFrame, before: str, min_run: int | None = None) -> DataFrame:
    """Rows with a previous day before the cutoff, optionally only in runs of a minimum length."""
    rows = pool.where((F.col("report_date") < F.lit(before).cast("date")) & F.col("prev").isNotNull())
    return rows if min_run is None else rows.where(F.col("run_length") >= min_run)


# --- nearest rows -----------------------------------------------------------------------------------------------------
def fit_scales(pool: DataFrame, before: str) -> DataFrame:
    """One row: mean, population deviation and present count of each feature over pool rows before a date."""
    f = pool.where(F.col("report_date") < F.lit(before).cast("date")).select(*[c.alias(n) for n, c in report_features().items()])
    return f.agg(*[x for n in FEATURES for x in (F.avg(n).alias(f"mean_{n}"), F.stddev_pop(n).alias(f"sd_{n}"), F.count(n).alias(f"n_{n}"))])


def standardized(df: DataFrame, scales: DataFrame) -> DataFrame:
    """z-scores of the seven features, NULL where the feature is missing."""
    raw = df.withColumns({f"__{n}": c for n, c in report_features().items()}).crossJoin(F.broadcast(scales))  # scales is one row
    return raw.withColumns({f"z_{n}": (F.col(f"__{n}") - F.col(f"mean_{n}")) / F.col(f"sd_{n}") for n in FEATURES}).drop(
        *[f"__{n}" for n in FEATURES], *[f"{p}_{n}" for n in FEATURES for p in ("mean", "sd", "n")])


def nearest_sides(items: DataFrame, pool: DataFrame, scales: DataFrame, scope: str | None, weights: Sequence[float] = WEIGHTS["chg"], payload: Sequence[str] = ("today", "next")) -> tuple[DataFrame, N.Index, dict[str, float]]:
    """(items, index of the pool, weights by feature) as `nearest.nearest` takes them. A pool row missing a feature sits at the mean; an item missing one
    ignores it."""
    by = {f"z_{n}": float(w) for n, w in zip(FEATURES, weights)}
    scope_col = F.lit("all") if scope is None else F.col(scope)
    index = N.build(standardized(pool, scales).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in by}), scope_col, by, payload)
    return standardized(items, scales).withColumns({"__scope": scope_col, "__cut": F.date_sub("report_date", 1)}), index, by


def retrieve_nearest(items: DataFrame, pool: DataFrame, scales: DataFrame, scope: str | None, weights: Sequence[float] = WEIGHTS["chg"], k: int = K, cap: int | None = None,
                     payload: Sequence[str] = ("today", "next")) -> DataFrame:
    """The k eligible rows nearest in weighted squared distance over the standardised features, ties by id; with ``cap``, at
    most that many from one incident. ``payload``: the columns of the pool that its rows bring along."""
    it, index, by = nearest_sides(items, pool, scales, scope, weights, payload)
    return N.nearest(it, index, by, k, cap)


# --- what the draws say -----------------------------------------------------------------------------------------------
def analogue_prediction(items: DataFrame, draws: DataFrame) -> DataFrame:
    """Per item: drawn rows, median ratio, its two-decimal display, share that moved, and the three predictions (exact,
    displayed, half-up). Items without a draw predict persistence."""
    x = outcome_ratio()
    g = draws.groupBy("item_id").agg(F.count(F.lit(1)).alias("drawn"), F.median(x).alias("median_ratio"), F.avg((F.abs(x - 1) > MOVE).cast("double")).alias("share_moved"))
    j = items.join(g, "item_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).withColumn("median_ratio", F.coalesce("median_ratio", F.lit(1.0)))
    return j.withColumns({
        "prediction": F.col("persistence") * F.col("median_ratio"), "prediction_displayed": F.bround(F.col("persistence") * shown("median_ratio"), 0),
        "prediction_half_up": F.floor(F.col("persistence") * F.col("median_ratio") + 0.5).cast("double"),
    })


def evaluate_rule(predicted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coverage, mean drawn, movement metrics, and Brier score and AUC of the share that moved against the real move."""
    from scorefold.operators.scores import auroc, movement_scores, rounded, share

    y, b = F.col("target"), F.col("persistence")
    really = (F.abs(y - b) / F.greatest(b, F.lit(1.0)) > MOVE).cast("int")
    p = predicted.withColumn("__moved", really)
    agg = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), share(F.col("drawn") >= 1).alias("coverage_1"), share(F.col("drawn") >= 3).alias("coverage_3"), F.avg("drawn").alias("mean_drawn"),
        F.avg((F.col("share_moved") - F.col("__moved")) ** 2).alias("move_brier"), F.avg(F.abs(y - F.col("prediction")) / F.col("scale")).alias("scaled_error"))
    iqr = percentiles(p, by, "median_ratio", {"ratio_q25": 0.25, "ratio_q75": 0.75})
    auc = auroc(p, by, "share_moved", "__moved").select(*by, F.col("auroc").alias("move_auc"))
    return agg.join(movement_scores(predicted, by).drop("parsed"), list(by)).join(iqr, list(by)).join(auc, list(by), "left")


def rule_errors(predicted: DataFrame) -> DataFrame:
    """item_id, incident_id, report_date and the scaled error of a rule's predictions."""
    return predicted.select("item_id", "incident_id", "report_date", (F.abs(F.col("target") - F.col("prediction")) / F.col("scale")).alias("error"))


def against_reference(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """The items of a rule's predictions with the scaled errors of the rule and of a reference rule (items of both)."""
    ref = rule_errors(reference).select("item_id", F.col("error").alias("reference_error"))
    return rule_errors(predicted).join(ref, "item_id")


def rule_difference(paired: DataFrame, reps: int = 2_000, seed: int = 1) -> DataFrame:
    """One row: items, mean errors of rule and reference, their difference, and its interval when whole incidents are drawn again."""
    from scorefold.operators.resample import bootstrap, paired_difference

    rows = paired.withColumn("__all", F.lit(1))
    b = bootstrap(rows, ["__all"], "incident_id", paired_difference(F.col("reference_error"), F.col("error")), reps, seed)
    means = rows.groupBy("__all").agg(F.count(F.lit(1)).alias("items"), F.avg("error").alias("error"), F.avg("reference_error").alias("reference_error"))
    return means.join(b, "__all").select("items", "error", "reference_error", F.col("point").alias("difference"), "lo", "hi", ((F.col("hi") < 0) | (F.col("lo") > 0)).cast("int").alias("excludes_zero"))


def error_by_period(paired: DataFrame, cut: str) -> DataFrame:
    """Errors of rule and reference on items reported before a date and from it on."""
    period = F.when(F.col("report_date") < F.lit(cut).cast("date"), "before").otherwise("from").alias("period")
    return paired.groupBy(period).agg(F.count(F.lit(1)).alias("items"), F.avg("error").alias("error"), F.avg("reference_error").alias("reference_error"), F.avg(F.col("error") - F.col("reference_error")).alias("difference"))


def served_levels(items: DataFrame, draws: DataFrame) -> DataFrame:
    """level, items, mean_drawn of a ladder's draws: which level served how many items; level 0: no level had a row."""
    level = F.split("lkey", r"\|")[0].cast("int")  # a ladder key begins with its level
    per = draws.groupBy("item_id").agg(F.max(level).alias("level"), F.count(F.lit(1)).alias("drawn"))
    j = items.select("item_id").join(per, "item_id", "left")
    return j.groupBy(F.coalesce("level", F.lit(0)).alias("level")).agg(F.count(F.lit(1)).alias("items"), F.avg(F.coalesce("drawn", F.lit(0))).alias("mean_drawn"))


def select_rule(results: DataFrame, reference: str, tie: float = 0.002) -> DataFrame:
    """The rule that clears the reference's AUC and false-move bars with the lowest error; within ``tie`` the fewest
    parameters win. ``results``: one row per rule (rule, scaled_error, move_auc, false_move, parameters)."""
    ref = results.where(F.col("rule") == reference).select(F.col("move_auc").alias("__auc"), F.col("false_move").alias("__fm"))
    ok = results.crossJoin(F.broadcast(ref)).where((F.col("move_auc") >= F.col("__auc")) & (F.col("false_move") <= F.col("__fm")))
    best = ok.agg(F.min("scaled_error").alias("__best"))
    near = ok.crossJoin(F.broadcast(best)).where(F.col("scaled_error") <= F.col("__best") + tie)
    return top_rows(near, [], [F.col("parameters"), F.col("scaled_error"), F.col("rule")], 1).drop("rk", "__auc", "__fm", "__best")


def draw_diagnostics(items: DataFrame, draws: DataFrame, band: str) -> DataFrame:
    """Per item: drawn rows, distinct incidents, share inside the item's band, and the newest analogue."""
    j = draws.join(items.select("item_id", F.col(band).alias("__ib")), "item_id")
    return j.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("drawn"), F.count_distinct("analogue_incident").alias("incidents"),
        F.avg((F.col(band) == F.col("__ib")).cast("double")).alias("in_band"), F.max("analogue_date").alias("newest"))


def same_draws(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per item whether two draws hold the same rows."""
    one = lambda d, n: d.groupBy("item_id").agg(F.sort_array(F.collect_set("analogue_id")).alias(n))
    return one(a, "__a").join(one(b, "__b"), "item_id", "full_outer").select("item_id", F.col("__a").eqNullSafe(F.col("__b")).cast("int").alias("same"))


def dynamics_profile(pool: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Move rates and outcome-ratio quartiles per class, per pair of classes and overall (``*`` marks a summed-out class)."""
    x = outcome_ratio()
    levels = [[], *[[c] for c in classes], list(classes)] if len(classes) > 1 else [[], list(classes)]
    variants = F.array(*[F.struct(*[(F.col(c) if c in lv else F.lit("*")).alias(c) for c in classes]) for lv in levels])
    long = pool.withColumn("__x", x).select("__x", F.explode(variants).alias("v")).select("__x", "v.*")
    agg = long.groupBy(*classes).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.abs(F.col("__x") - 1) > MOVE).cast("double")).alias("p_move"), F.avg((F.col("__x") > 1 + MOVE).cast("double")).alias("p_up"),
        F.avg((F.col("__x") < 1 - MOVE).cast("double")).alias("p_down"), F.avg("__x").alias("mean_ratio"))
    return agg.join(percentiles(long, classes, "__x", {"median_ratio": 0.5, "q25": 0.25, "q75": 0.75}), list(classes))


# --- rules as parameters ------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Nearest:
    """A nearest-row rule: key column that both sides share (None: the whole pool), feature weights, rows per analogue incident."""

    scope: str | None
    weights: Sequence[float]
    cap: int | None = None


@dataclass(frozen=True)
class Ladder:
    """A ladder rule: key components from broad to narrow, rows that make a level serve, or filling level by level."""

    components: Sequence[str]
    min_rows: int = 3
    fill: bool = False

    def draw(self, items: DataFrame, pool: DataFrame, k: int = K, seed: int = 1) -> DataFrame:
        if self.fill:
            return retrieve_ladder_fill(items, pool, self.components, k, seed)
        return retrieve_ladder(items, pool, self.components, self.min_rows, k, seed)


# The rules that the registered queries run.
NEAREST = {"nn_pers_chg": Nearest("pers_band", WEIGHTS["chg"]), "nn_band_eq": Nearest("band", WEIGHTS["eq"]), "nn_all_dyn_cap2": Nearest(None, WEIGHTS["dyn"], 2)}
LADDERS = {"ladder": Ladder(("band", "t3", "p5")), "ladder_fill": Ladder(("band", "t3", "p5"), fill=True), "ladder_streak": Ladder(("band", "p5s", "a"))}
