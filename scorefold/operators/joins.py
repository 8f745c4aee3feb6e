"""Nearest, as-of, fingerprint and tracing joins over sequences, files and driver windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.operators.ordered import neighbours_both
from scorefold.session import checkpointed


def reference_row(frames: DataFrame, seq: str, offset: str, ident: str, payload: Sequence[str]) -> DataFrame:
    """Each frame with its sequence's earliest frame (ties by id) as ``ref_*`` columns; the reference itself is dropped."""
    first = frames.groupBy(seq).agg(F.min_by(F.struct(ident, offset, *payload), F.struct(offset, ident)).alias("__r"))
    j = frames.join(first, seq)
    j = j.withColumns({f"ref_{c}": F.col(f"__r.{c}") for c in (ident, offset, *payload)}).drop("__r")
    return j.where(F.col(ident) != F.col(f"ref_{ident}"))


def nearest_to_ladder(frames: DataFrame, seq: str, offset: str, ident: str, ladder: Sequence[int], tol: int) -> DataFrame:
    """Per sequence and ladder target the nearest frame within ``tol`` (first on ties); a frame nearest to several targets
    serves the first of them and the others stay empty. A frame meets only the targets within ``tol`` of it."""
    rungs = F.array(*[F.struct(F.lit(i).alias("rung"), F.lit(t).alias("target")) for i, t in enumerate(ladder)])
    near = F.filter(rungs, lambda r: F.abs(F.col(offset) - r["target"]) <= tol)
    e = frames.select(seq, offset, ident, F.explode(near).alias("r")).select(seq, offset, ident, "r.rung", "r.target")
    best = e.groupBy(seq, "rung", "target").agg(F.min_by(F.struct(ident, offset), F.struct(F.abs(F.col(offset) - F.col("target")), ident)).alias("f"))
    best = best.select(seq, "rung", "target", F.col(f"f.{ident}").alias(ident), F.col(f"f.{offset}").alias(offset))
    return best.groupBy(seq, ident).agg(F.min_by(F.struct("rung", "target", offset), "rung").alias("b")).select(seq, ident, "b.rung", "b.target", F.col(f"b.{offset}").alias(offset))


def asof_matched_gap(targets: DataFrame, frames: DataFrame, seq: str, offset: str, ident: str, gap: Column, latest: int, limit: int) -> DataFrame:
    """Reference frame nearest to offset - gap among frames at or before ``latest``; ties to the smaller offset; deviations
    beyond ``limit`` are flagged. Both sides are stacked in time order and the neighbours carried over - no pairs."""
    f = frames.where(F.col(offset) <= latest).select(seq, F.col(offset).alias("at"), F.lit(0).alias("side"), F.col(ident).alias("id"), F.struct(F.col(offset).alias("o"), F.col(ident).alias("i")).alias("ref"))
    t = targets.select(seq, (F.col(offset) - gap).alias("at"), F.lit(1).alias("side"), F.col(ident).alias("id"), F.col(offset).alias("target_offset"))
    both = f.unionByName(t, allowMissingColumns=True)
    both_ways = neighbours_both(checkpointed(both), [seq], ["at", "side", "id"], F.col("ref"), "prev_ref", "next_ref")
    d0, d1 = F.col("at") - F.col("prev_ref.o"), F.col("next_ref.o") - F.col("at")
    pick = F.when(d1.isNull() | (d0 <= d1), F.col("prev_ref")).otherwise(F.col("next_ref"))
    out = both_ways.where(F.col("side") == 1).withColumn("__p", pick)
    out = out.select(seq, F.col("id").alias(ident), "target_offset", F.col("__p.i").alias("ref_id"), F.col("__p.o").alias("ref_offset"), F.abs(F.col("at") - F.col("__p.o")).alias("deviation"))
    return out.withColumn("flagged", (F.col("deviation") > limit).cast("int"))


def fingerprint_match(items: DataFrame, files: DataFrame, ident: str, tol: float = 0.0015) -> DataFrame:
    """Match items (low, high, mean, sd) to files (low, high, mean, sd_pop, sd_sample): first on values rounded to three
    decimals, then, for the rest, on exact extremes with mean and deviation within ``tol``. Classed by match count.

    Both sides are reduced to distinct fingerprints with file counts before they meet, so a large group of copies is one row;
    the tolerant join carries a bucket of the mean, so equal extremes alone never pair everything.
    """
    r3 = lambda c: F.round(c, 3)
    stats, keys = ["low", "high", "mean", "sd"], ["k0", "k1", "k2", "k3"]
    distinct_files = files.groupBy("low", "high", "mean", "sd_pop", "sd_sample").agg(F.count(F.lit(1)).alias("__n"), F.min("file_id").alias("__f"))
    prints = items.select(*stats).distinct()

    fx = distinct_files.select(r3("low").alias("k0"), r3("high").alias("k1"), r3("mean").alias("k2"), F.explode(F.array_distinct(F.array(r3("sd_pop"), r3("sd_sample")))).alias("k3"), "__n", "__f")
    fx = fx.groupBy(*keys).agg(F.sum("__n").alias("matches"), F.min("__f").alias("file_id"))
    ix = prints.withColumns({k: r3(c) for k, c in zip(keys, stats)})
    first = ix.join(fx, keys).select(*stats, "matches", "file_id")

    rest = ix.join(fx, keys, "left_anti").select(*stats)
    bucket = F.floor(F.col("mean") / tol)
    left = rest.withColumn("__b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    right = distinct_files.withColumn("__b", bucket).withColumnRenamed("mean", "__m")
    near = (F.abs(F.col("mean") - F.col("__m")) <= tol) & ((F.abs(F.col("sd") - F.col("sd_pop")) <= tol) | (F.abs(F.col("sd") - F.col("sd_sample")) <= tol))
    second = left.join(right, ["low", "high", "__b"]).where(near).groupBy(*stats).agg(F.sum("__n").alias("matches"), F.min("__f").alias("file_id"))

    out = items.select(ident, *stats).join(first.unionByName(second), stats, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    kind = F.when(F.col("matches") == 0, "unmatched").when(F.col("matches") == 1, "matched").otherwise("ambiguous")
    return out.select(ident, "matches", kind.alias("class"), F.when(F.col("matches") == 1, F.col("file_id")).alias("file_id"))


def trace_to_source(stored: DataFrame, source: DataFrame, key: Sequence[str], value: str, rtol: float = 1e-5) -> DataFrame:
    """Stored values that differ from their source row by more than ``rtol`` relative, or miss it; NULL matches NULL."""
    a = stored.select(*key, F.col(value).alias("stored"))
    b = source.select(*key, F.col(value).alias("source"), F.lit(1).alias("__in"))
    j = a.join(b, list(key), "left")
    near = F.abs(F.col("stored") - F.col("source")) <= rtol * F.greatest(F.abs("source"), F.lit(1e-300))
    same = (F.col("stored").isNull() & F.col("source").isNull()) | F.coalesce(near, F.lit(False))
    return j.where(F.col("__in").isNull() | ~same).drop("__in")


def attach_analogue_values(log: DataFrame, pool: DataFrame, ids: str = "analogue_ids") -> DataFrame:
    """One row per recorded analogue with its values; unresolved ids keep NULLs."""
    return log.withColumn("analogue_id", F.explode(ids)).join(pool, "analogue_id", "left")


def join_climatology(items: DataFrame, clim: DataFrame, month: Column) -> DataFrame:
    """Month means and deviations onto windows; the table has at most twelve months per driver."""
    return items.withColumn("month", month).join(F.broadcast(clim), "month", "left")


def arm_freshness(files: DataFrame, key: Sequence[str], arm: str, modified: str, a: str, b: str, limit_minutes: float, overrides: DataFrame | None = None) -> DataFrame:
    """Minutes between the two files of an arm pair; stale beyond the limit unless the pair is listed as accepted."""
    g = files.groupBy(*key).agg(F.max(F.when(F.col(arm) == a, F.col(modified))).alias("ta"), F.max(F.when(F.col(arm) == b, F.col(modified))).alias("tb"))
    minutes = F.abs(F.unix_micros(F.col("ta").cast("timestamp")) - F.unix_micros(F.col("tb").cast("timestamp"))) / 60e6
    out = g.select(*key, minutes.alias("minutes"), (minutes > limit_minutes).cast("int").alias("stale"))
    if overrides is not None:
        ok = overrides.select(*key).distinct().withColumn("__ok", F.lit(1))
        out = out.join(ok, list(key), "left").withColumn("stale", F.when(F.col("__ok") == 1, 0).otherwise(F.col("stale"))).drop("__ok")
    return out
