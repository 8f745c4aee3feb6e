"""Sampling, de-duplication and set operations over items and response logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scorefold.functions.columns import hash_int
from scorefold.operators.ordered import positions, table_positions, top_rows


# --- sampling ---------------------------------------------------------------------------------------------------------
def stratified_sample(items: DataFrame, stratum: str, group: str, key: str, per_stratum: int, per_group: int, seed: int) -> DataFrame:
    """At most ``per_group`` items per group and ``per_stratum`` per stratum, in a seeded hash order.

    Equal to walking a shuffled list and skipping full groups; both ranks are literal limits, trimmed before the shuffle.
    """
    h = items.withColumn("__h", hash_int(seed, key))
    a = top_rows(h, [stratum, group], [F.col("__h"), F.col(key)], per_group, "__g")
    return top_rows(a, [stratum], [F.col("__h"), F.col(key)], per_stratum, "sample_rank").drop("__h", "__g")


def proportional_sample(items: DataFrame, stratum: str, group: str, key: str, n: int, per_group: int, seed: int) -> DataFrame:
    """Per-stratum quota max(1, round(n * share of the items)), at most ``per_group`` per group."""
    sizes = items.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    total = items.agg(F.count(F.lit(1)).alias("__t"))
    quota = sizes.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.bround(n * F.col("__n") / F.col("__t"), 0)).alias("quota"))
    h = items.withColumn("__h", hash_int(seed, key)).join(quota, stratum)
    a = top_rows(h, [stratum, group], [F.col("__h"), F.col(key)], per_group, "__g")
    return top_rows(a, [stratum], [F.col("__h"), F.col(key)], F.col("quota"), "sample_rank", keep=n).drop("__h", "__g")


def hash_sample(cands: DataFrame, item: str, cand: str, k: int, seed: int) -> DataFrame:
    """Up to k candidates per item in a hash order that depends on the item, the candidate and the seed."""
    h = cands.withColumn("__h", hash_int(seed, item, cand))
    return top_rows(h, [item], [F.col("__h"), F.col(cand)], k, "draw").drop("__h")


def matched_false_positives(scores: DataFrame, k: DataFrame, by: Sequence[str], score: str, label: str, ident: str) -> DataFrame:
    """Flag each group's k highest-scoring negatives, k joined per group (``k`` has columns *by, k)."""
    neg = scores.where(F.col(label) == 0)
    p = positions(neg, by, [F.lit(0.0) - F.col(score), ident], "__p")
    return p.join(k, list(by), "left").withColumn("flag", (F.col("__p") < F.coalesce("k", F.lit(0))).cast("int")).drop("__p", "k")


def fold_filter(df: DataFrame, folds: Sequence[int], fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold).isin(*folds))


# --- de-duplication ---------------------------------------------------------------------------------------------------
def dedupe_last(log: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Last row per key. ``max_by`` keeps one row per key and task before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    g = log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return g.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def dedupe_success(log: DataFrame, key: Sequence[str], order: str, failed: Column) -> DataFrame:
    """The first success per key, else the last failure."""
    rest = [c for c in log.columns if c not in key]
    rank = F.struct(failed.cast("int").alias("f"), F.when(failed, 0 - F.col(order)).otherwise(F.col(order)).alias("o"))
    g = log.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("__r"))
    return g.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


# --- sets over runs ---------------------------------------------------------------------------------------------------
def complete_runs(log: DataFrame, run: Sequence[str], arm: str, arm_bar: float = 0.9, task_bar: float = 0.5) -> DataFrame:
    """Attempted items per run, its share of the best run in the arm and in the task, and whether it passes both bars."""
    n = log.groupBy(*run, arm).agg(F.count(F.lit(1)).alias("attempted"))
    best_arm = n.groupBy(arm).agg(F.max("attempted").alias("__a"))
    best = n.agg(F.max("attempted").alias("__b"))
    out = n.join(best_arm, arm).crossJoin(F.broadcast(best))
    out = out.withColumns({"coverage": F.col("attempted") / F.col("__a"), "task_coverage": F.col("attempted") / F.col("__b")})
    return out.withColumn("complete", ((F.col("coverage") >= arm_bar) & (F.col("task_coverage") >= task_bar)).cast("int")).drop("__a", "__b")


def common_set(log: DataFrame, run: str, item: str, state: str) -> DataFrame:
    """Sizes of the item sets attempted by any and every run, answered by every run (strict, or allowing partial), and
    the split of the loss. One count per item instead of an intersection of runs. ``state``: answered / partial / failed."""
    runs = log.agg(F.count_distinct(run).alias("runs"))
    per = log.groupBy(item).agg(
        F.count(F.lit(1)).alias("a"), F.count(F.when(F.col(state) == "answered", 1)).alias("s"),
        F.count(F.when(F.col(state).isin("answered", "partial"), 1)).alias("l"),
    )
    c = lambda k: F.count(F.when(F.col(k) == F.col("runs"), 1))
    out = per.crossJoin(F.broadcast(runs)).agg(
        F.count(F.lit(1)).alias("attempted_any"), c("a").alias("attempted_all"), c("s").alias("answered_all"), c("l").alias("answered_or_partial_all")
    )
    return out.select(
        "*", (F.col("attempted_any") - F.col("attempted_all")).alias("lost_to_design"),
        (F.col("attempted_all") - F.col("answered_or_partial_all")).alias("lost_to_failure"),
        (F.col("answered_or_partial_all") - F.col("answered_all")).alias("lost_to_imputation"),
    )


def multi_failed(log: DataFrame, item: str, failed: Column, n: int = 2) -> DataFrame:
    """Items failed by at least n runs."""
    return log.where(failed).groupBy(item).agg(F.count(F.lit(1)).alias("failed_runs")).where(F.col("failed_runs") >= n)


def coverage(expected: DataFrame, observed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected keys without any row."""
    return expected.join(observed.select(*key).distinct(), list(key), "left_anti")


def id_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) for ids present on one side only, duplicates counted."""
    left, right = a.select(key), b.select(key)
    return left.exceptAll(right).withColumn("side", F.lit("a_only")).unionByName(right.exceptAll(left).withColumn("side", F.lit("b_only")))


def same_order(a: DataFrame, b: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Positions compared, and at how many the two lists hold a different id."""
    pa = table_positions(a.select(key, *[c for c in order if c != key]), list(order)).select("pos", F.col(key).alias("__a"))
    pb = table_positions(b.select(key, *[c for c in order if c != key]), list(order)).select("pos", F.col(key).alias("__b"))
    j = pa.join(pb, "pos", "full_outer")
    return j.agg(F.count(F.lit(1)).alias("positions"), F.count(F.when(~F.col("__a").eqNullSafe(F.col("__b")), 1)).alias("different"))


def union_arms(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# --- upserts ----------------------------------------------------------------------------------------------------------
def upsert_runs(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every old row whose key is not refreshed, and the new rows."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def apply_replacements(log: DataFrame, patch: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(log with the patch's rows put in, rows replaced). Rows already equal to the patch are not reported, so the
    operation can be repeated; a patch row without a counterpart is added."""
    rest = [c for c in log.columns if c not in key]
    a = log.select(*key, F.struct(*rest).alias("__old"), F.lit(1).alias("__in"))
    b = patch.select(*key, F.struct(*rest).alias("__new"), F.lit(1).alias("__p"))
    j = a.join(b, list(key), "full_outer")
    pick = F.when(F.col("__p") == 1, F.col("__new")).otherwise(F.col("__old"))
    merged = j.select(*key, pick.alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])
    changed = j.where((F.col("__in") == 1) & (F.col("__p") == 1) & ~F.col("__old").eqNullSafe(F.col("__new")))
    return merged, changed.select(*key, *[F.col(f"__old.{c}").alias(c) for c in rest])


# --- pairing ----------------------------------------------------------------------------------------------------------
def pair_arms(log: DataFrame, a: str, b: str, key: Sequence[str], carry: Sequence[str], values: Sequence[str], answered: Column) -> DataFrame:
    """Items answered in both arms: carried attributes, and each value once per arm with an ``a_`` / ``b_`` prefix.

    One aggregate over the key instead of a self join: the log is read and shuffled once.
    """
    rows = log.where(answered & F.col("arm").isin(a, b))
    in_a = F.col("arm") == a
    g = rows.groupBy(*key).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in carry],
        *[F.max(F.when(in_a, F.col(v))).alias(f"a_{v}") for v in values],
        *[F.max(F.when(~in_a, F.col(v))).alias(f"b_{v}") for v in values],
        F.count(F.when(in_a, 1)).alias("__na"), F.count(F.when(~in_a, 1)).alias("__nb"),
    )
    return g.where((F.col("__na") > 0) & (F.col("__nb") > 0)).drop("__na", "__nb")


def target_conflicts(log: DataFrame, key: Sequence[str], target: str) -> DataFrame:
    """Keys whose rows disagree on the target."""
    return log.groupBy(*key).agg(F.min(target).alias("lo"), F.max(target).alias("hi")).where(F.col("lo") != F.col("hi"))


def attach_items(log: DataFrame, items: DataFrame, key: str, cluster: str) -> DataFrame:
    """Item attributes onto responses; where the item is unknown the key itself is the cluster and the row is marked."""
    marked = items.withColumn("__found", F.lit(1))
    out = log.join(marked, key, "left")
    missing = F.col("__found").isNull()
    return out.withColumn(cluster, F.coalesce(F.col(cluster), F.col(key).cast("string"))).withColumn("item_missing", missing.cast("int")).drop("__found")


def paired_split(a: DataFrame, b: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Relation of two answered sets per group: same, covered (one inside the other) or split, with the overlap."""
    j = a.select(*key).distinct().withColumn("__a", F.lit(1)).join(b.select(*key).distinct().withColumn("__b", F.lit(1)), list(key), "full_outer")
    g = j.groupBy(*by).agg(
        F.count("__a").alias("a_n"), F.count("__b").alias("b_n"), F.count(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), 1)).alias("overlap"),
    )
    rel = F.when((F.col("overlap") == F.col("a_n")) & (F.col("overlap") == F.col("b_n")), "same").when(
        (F.col("overlap") == F.col("a_n")) | (F.col("overlap") == F.col("b_n")), "covered").otherwise("split")
    return g.withColumn("relation", rel)


def n_way_aligned(log: DataFrame, variant: str, item: Sequence[str], value: str, variants: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Items answered in every variant, one value column per variant."""
    g = log.where(F.col(value).isNotNull() & F.col(variant).isin(*variants)).groupBy(*item).agg(
        F.count_distinct(variant).alias("__n"), *[F.first(c, ignorenulls=True).alias(c) for c in carry],
        *[F.max(F.when(F.col(variant) == v, F.col(value))).alias(v) for v in variants],
    )
    return g.where(F.col("__n") == len(variants)).drop("__n")


def held_out(pool: DataFrame, evaluation: DataFrame, key: Sequence[str]) -> DataFrame:
    return pool.join(evaluation.select(*key).distinct(), list(key), "left_anti")


def pairs_by_position(a: DataFrame, b: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """The k-th row of one list with the k-th of the other, per group, flagging equal values."""
    pa = positions(a, by, [order], "pos").select(*by, "pos", F.col(value).alias("a_value"))
    pb = positions(b, by, [order], "pos").select(*by, "pos", F.col(value).alias("b_value"))
    return pa.join(pb, [*by, "pos"]).withColumn("same", (F.col("a_value") == F.col("b_value")).cast("int"))


def select_models(registry: DataFrame, log: DataFrame, tier: str, arms: Sequence[str]) -> DataFrame:
    """Models of a tier that have rows in every required arm, in display order."""
    have = log.where(F.col("arm").isin(*arms)).groupBy("model").agg(F.count_distinct("arm").alias("__n")).where(F.col("__n") == len(arms))
    return registry.where(F.col("tier") == tier).join(have.select("model"), "model", "left_semi")


def pending_jobs(expected: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    return expected.join(stored.select(*key), list(key), "left_anti")
