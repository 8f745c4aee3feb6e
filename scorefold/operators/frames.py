"""Frame tables: gap design, shared maxima, label sources, clipped frames and misses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.functions.columns import at_ceiling
from scorefold.operators.ordered import percentiles, top_rows
from scorefold.operators.scores import count_if


def gap_design(targets: DataFrame, by: Sequence[str], gap: str) -> DataFrame:
    """Smallest, median and largest reference-target gap per group, with frames and sequences."""
    agg = targets.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("sequence").alias("sequences"), F.min(gap).alias("gap_min"), F.max(gap).alias("gap_max"))
    return agg.join(percentiles(targets, by, gap, {"gap_median": 0.5}), list(by))


def separating_thresholds(targets: DataFrame, gap: str, label: str) -> DataFrame:
    """Margin between the largest negative and the smallest positive gap, and the whole minutes that separate them."""
    g = targets.agg(F.max(F.when(F.col(label) == 0, F.col(gap))).alias("max_clear"), F.min(F.when(F.col(label) == 1, F.col(gap))).alias("min_event"))
    minutes = F.filter(F.sequence(F.lit(0), F.greatest(F.floor(F.col("min_event") / 60), F.lit(0)).cast("int")), lambda m: (m * 60 > F.col("max_clear")) & (m * 60 < F.col("min_event")))
    return g.select("max_clear", "min_event", (F.col("min_event") - F.col("max_clear")).alias("margin"), F.size(minutes).cast("bigint").alias("minutes"),
                    F.coalesce(F.array_min(minutes), F.lit(-1)).alias("first_minute"), F.coalesce(F.array_max(minutes), F.lit(-1)).alias("last_minute"))


def shared_maximum_audit(frames: DataFrame, value: str, by: Sequence[str], k: int, digits: int = 3) -> DataFrame:
    """Most repeated rounded values per group."""
    h = frames.groupBy(*by, F.round(value, digits).alias("value")).agg(F.count(F.lit(1)).alias("frames"))
    return top_rows(h, by, [F.desc("frames"), F.asc("value")], k)


def ceiling_labels(frames: DataFrame, value: str, ceiling: float, label: str) -> DataFrame:
    """Label distribution of frames at the ceiling and of frames below it."""
    side = F.when(at_ceiling(value, ceiling), "at").when(F.col(value) < ceiling, "below").otherwise("above")
    return frames.groupBy(side.alias("side"), label).agg(F.count(F.lit(1)).alias("frames"))


def share_consistency(frames: DataFrame, count: Column, total: Column, stated: Column) -> DataFrame:
    """Rows whose stated percentage equals 100 * count / total."""
    ok = F.abs(100.0 * count / total - stated) < 1e-9
    return frames.where(total > 0).agg(F.count(F.lit(1)).alias("checked"), count_if(ok).alias("consistent"))


def label_source_structure(items: DataFrame, kind: str, source: str, applicability: str) -> DataFrame:
    """Per question type: items, label sources, whether sources mix, and items on both sides of full applicability."""
    return items.groupBy(kind).agg(
        F.count(F.lit(1)).alias("items"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"),
        (F.count_distinct(source) > 1).cast("int").alias("mixed"), count_if(F.col(applicability) >= 1.0).alias("full"), count_if(F.col(applicability) < 1.0).alias("below"))


def shared_frames(items: DataFrame, frame: str, group: Column) -> DataFrame:
    """Frames that carry items of both groups."""
    g = items.groupBy(frame).agg(F.max(group.cast("int")).alias("a"), F.max((~group).cast("int")).alias("b"))
    return g.agg(F.count(F.lit(1)).alias("frames"), count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared"))


def suspect_reference(items: DataFrame, kind: str, answer: str, high: str, nothing: dict[str, str], hot: float = 200.0) -> DataFrame:
    """Marks items whose reference is its type's nothing-burning option although the frame maximum is hot."""
    table = F.create_map(*[F.lit(x) for kv in nothing.items() for x in kv])
    flag = (F.col(answer) == F.try_element_at(table, F.col(kind))) & (F.col(high) >= hot)
    return items.withColumn("suspect", F.coalesce(flag.cast("int"), F.lit(0)))


def threshold_floor_audit(pool: DataFrame, kind: str, hotspots: str, radius: str, high: str, answer: str, nothing: str, hot: float) -> DataFrame:
    """Per type: records, smallest listed radius, hot frames, and hot frames whose reference reads nothing."""
    smallest = F.array_min(F.transform(hotspots, lambda h: h[radius]))
    is_hot = F.col(high) >= hot
    return pool.groupBy(kind).agg(
        F.count(F.lit(1)).alias("records"), F.min(smallest).alias("smallest_radius"), count_if(is_hot).alias("hot_frames"),
        count_if(is_hot & (F.col(answer) == nothing)).alias("hot_but_nothing"), count_if(is_hot & (F.col(answer) == nothing) & (F.size(hotspots) == 0)).alias("nothing_listed"))


def miss_class(clipped: Column, checks: Sequence[tuple[str, Column]]) -> Column:
    """First-fit class of a wrong answer: clipped frame, then the named checks, else other."""
    out = F.when(F.coalesce(clipped, F.lit(False)), "clipped_frame")
    for name, cond in checks:
        out = out.when(F.coalesce(cond, F.lit(False)), name)
    return out.otherwise("other")


def miss_breakdown(pairs: DataFrame, by: Sequence[str], kind: str, bare_right: Column, right: Column, same: Column) -> DataFrame:
    """Misses by class and effect (bare was right / same wrong answer / another wrong answer), with totals (``all``)."""
    effect = F.when(bare_right, "bare_correct").when(same, "same_as_bare").otherwise("other_wrong_bare")
    misses = pairs.where(~right).withColumn("effect", effect)
    both = misses.select(*by, "effect", F.explode(F.array(F.col(kind), F.lit("all"))).alias("class"))
    cube = both.groupBy(*by, "class", "effect").agg(F.count(F.lit(1)).alias("n"))
    total = cube.groupBy(*by, "class").agg(F.sum("n").alias("n")).withColumn("effect", F.lit("all"))
    return cube.unionByName(total)
