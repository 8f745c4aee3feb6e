"""Nearest rows of a dated pool over a tree of boxes.

The index cuts every feature (and the date) at quantiles of the whole pool. The bits of a row's bin numbers, most significant first and heaviest
features first, are its path; three bits make one level, so a node has at most eight children, and every node knows the bounding box of its rows, their
first date, and how many of them precede each date cut. The depth follows from the size of a scope: a leaf holds some `LEAF` rows, and one of more than
`FULL_LEAF` (rows that are equal in all features share a leaf, however many they are) is dealt out in pieces.

Items come down the tree twice, each level an equi-join of the surviving parents with their children:

1. of the children that face it, an item keeps the nearest ones, just enough to hold k eligible rows for certain. The rows of the leaves it ends in are
   measured; the k-th distance among them bounds the answer;
2. from the root again, it keeps every child whose box lies within the bound and measures the rows of those leaves.

Exact, without a candidate cap, and no item meets a box whose parent it has dropped. Upper levels are broadcast after a count; deeper ones are shuffled.

A leaf's rows meet its items in one task, in arrays of `CELLS` distances at a time, and of an item and a leaf at most k rows leave it. So what is shuffled is
an item for each leaf it reaches, the pool, and k rows for each item and leaf with rows within the bound, but no row that was only measured.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scorefold.operators.ordered import slice_count, top_rows
from scorefold.session import checkpointed

#: Rows that a leaf should hold, children of a node (as bits), bits of a feature's bin number.
LEAF, FAN, BIN_BITS = 8_192, 3, 4
#: A level of at most so many nodes (some 200 bytes each) is broadcast.
SMALL_LEVEL = 50_000
#: So many items (some 150 bytes each) are broadcast; rows of one piece of a leaf.
SMALL_ITEMS, FULL_LEAF = 400_000, 32_768
#: Distances that a task holds at once.
CELLS = 1 << 18

_NODE, _SCOPE, _ITEM, _PIECE = "__node", "__scope", "__item", "__piece"


class Index(NamedTuple):
    rows: DataFrame  # __scope, __node (leaf), __piece, analogue_id, analogue_incident, analogue_date, the payload, p_<feature>
    levels: list[DataFrame]  # root's children first: __scope, __parent, __node, __d0, __n1 .. (rows before each date cut), lo_<feature>, hi_<feature>
    dates: list[int]  # the date cuts, as days
    features: list[str]  # those with a weight, as z_<name>
    own: DataFrame  # incident_id, __own: rows of an incident
    largest: DataFrame  # one row: the most rows of one incident
    pieces: DataFrame  # __scope, __node, __pieces: leaves that are dealt out in more than one piece


def _bins(p: DataFrame, columns: Sequence[str]) -> list[tuple[str, Column, int, list]]:
    """(column, bin number, bits, cuts) of each column that quantiles can cut."""
    at = [i / (1 << BIN_BITS) for i in range(1, 1 << BIN_BITS)]
    row = p.agg(*[F.percentile_approx(c, at, 1000).alias(c) for c in columns], *[F.min(c).alias(f"__min_{c}") for c in columns]).first()
    out = []
    for c in columns:
        cuts = sorted({x for x in row[c] or [] if x > row[f"__min_{c}"]})
        if cuts:
            number = sum((F.when(F.col(c) >= F.lit(x), 1).otherwise(0) for x in cuts[1:]), F.when(F.col(c) >= F.lit(cuts[0]), 1).otherwise(0))
            out.append((c, number, len(cuts).bit_length(), cuts))
    return out


def _splits(bins: list[tuple[str, Column, int, list]], date: str) -> list[Column]:
    """Bits of the bin numbers in the order in which the tree splits: two of the date, a bit of every feature in turn, the rest of the date."""
    bit = lambda number, bits, j: F.shiftright(number, bits - 1 - j).bitwiseAND(F.lit(1))
    dated = [bit(n, bits, j) for c, n, bits, _ in bins if c == date for j in range(bits)]
    turns = [bit(n, bits, j) for j in range(BIN_BITS) for c, n, bits, _ in bins if c != date and j < bits]
    return dated[:2] + turns + dated[2:]


def build(pool: DataFrame, scope: Column, weights: dict[str, float], payload: Sequence[str]) -> Index:
    """pool: analogue_id, incident_id, report_date, the payload and standardised features (present everywhere); weights by feature."""
    features = [c for c, w in sorted(weights.items(), key=lambda x: -x[1]) if w]
    p = pool.withColumns({_SCOPE: scope, "__day": F.datediff("report_date", F.lit("1990-01-01").cast("date"))})
    p = checkpointed(p.select(_SCOPE, "__day", "analogue_id", "incident_id", "report_date", *payload, *features))
    bins = _bins(p, [*features, "__day"])
    splits, dates = _splits(bins, "__day"), [x for c, _, _, cuts in bins if c == "__day" for x in cuts]
    sizes = p.groupBy(_SCOPE).agg(F.count(F.lit(1)).alias("__rows"))
    sizes = checkpointed(sizes.select(_SCOPE, F.least(F.greatest(F.ceil(F.log2(F.col("__rows") / LEAF)), F.lit(0)), F.lit(len(splits))).cast("int").alias("__bits")))
    bits = sizes.agg(F.max("__bits")).first()[0] or 0
    path = F.lit(0).cast("bigint")
    for bit in splits[:bits]:
        path = F.shiftleft(path, 1).bitwiseOR(bit.cast("bigint"))
    p = p.join(_small(sizes, SMALL_LEVEL), _SCOPE).withColumn(_NODE, F.call_function("shiftright", path, bits - F.col("__bits"))).drop("__bits")
    early = [F.sum((F.col("__day") < x).cast("bigint")).alias(f"__n{k}") for k, x in enumerate(dates, 1)]
    box = [F.min("report_date").alias("__d0"), *early, *(x for c in features for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")))]
    leaves = checkpointed(p.groupBy(_SCOPE, _NODE).agg(*box, F.count(F.lit(1)).alias("__rows")))
    pieces = checkpointed(leaves.where(F.col("__rows") > FULL_LEAF).select(_SCOPE, _NODE, F.ceil(F.col("__rows") / max(FULL_LEAF, 1)).alias("__pieces")))
    leaves = leaves.drop("__rows")
    over = [F.min("__d0").alias("__d0"), *(F.sum(f"__n{k}").alias(f"__n{k}") for k in range(1, len(dates) + 1)), *(x for c in features for x in (F.min(f"lo_{c}").alias(f"lo_{c}"), F.max(f"hi_{c}").alias(f"hi_{c}")))]
    levels = [leaves]
    for _ in range(math.ceil(bits / FAN) - 1):
        up = levels[0].withColumn(_NODE, F.shiftright(_NODE, FAN))
        levels.insert(0, checkpointed(up.groupBy(_SCOPE, _NODE).agg(*over)))
    levels = [n.withColumn("__parent", F.shiftright(_NODE, FAN)) for n in levels]
    own = p.groupBy("incident_id").agg(F.count(F.lit(1)).alias("__own"))
    rows = p.join(_small(pieces, SMALL_LEVEL), [_SCOPE, _NODE], "left").withColumn(_PIECE, F.coalesce(F.pmod(F.xxhash64("analogue_id"), F.col("__pieces")), F.lit(0).cast("bigint")))
    rows = rows.select(_SCOPE, _NODE, _PIECE, "analogue_id", F.col("incident_id").alias("analogue_incident"), F.col("report_date").alias("analogue_date"), *payload, *[F.col(c).alias(f"p_{c}") for c in features])
    return Index(rows, levels, dates, features, own, own.agg(F.max("__own").alias("__max")), pieces)


def _small(df: DataFrame, most: int) -> DataFrame:
    """df, broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def _sum(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _looked_up(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of an item's number and a box with the item's columns."""
    return pairs.join(_small(items.drop(_SCOPE), SMALL_ITEMS), _ITEM)


def descend(index: Index, items: DataFrame, weights: dict[str, float], kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The leaves (__node) that items end in, with the items' columns; `kept` says which of the children that face an item stay.

    items: __item (a number), __cut (rows before it are eligible), __scope, the features (NULL: ignored)."""
    gap = {c: F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0)) for c in index.features}
    near = _sum([F.when(F.col(c).isNull(), 0.0).otherwise(weights[c] * gap[c] ** 2) for c in index.features])
    own = items.columns
    at = items.withColumn(_NODE, F.lit(0).cast("bigint"))
    for nodes in index.levels:
        at = at.withColumnRenamed(_NODE, "__parent")
        if nodes.count() <= SMALL_LEVEL:
            at = at.join(F.broadcast(nodes), [_SCOPE, "__parent"])
        else:
            at = _looked_up(at.select(_ITEM, _SCOPE, "__parent").join(nodes.hint("shuffle_hash"), [_SCOPE, "__parent"]), items)  # a parent has at most eight children
        at = kept(at.where(F.col("__d0") < F.col("__cut")).withColumn("__near", near)).select(*own, _NODE)
    return at


def nearest(items: DataFrame, index: Index, weights: dict[str, float], k: int, cap: int | None = None) -> DataFrame:
    """item_id, the rows' ids, dates and payload, distance and draw (1 ..) of the k eligible rows nearest to each item, ties by id; with `cap`, at most that
    many from one incident."""
    parts = slice_count(items)  # a given number: few bytes, much work
    it = items.join(index.own, "incident_id", "left").crossJoin(F.broadcast(index.largest))  # one row
    need = (F.lit(k) if cap is None else k * F.col("__max")) + F.coalesce("__own", F.lit(0))
    it = it.withColumn("__need", need).select("item_id", "incident_id", "__cut", _SCOPE, "__need", *index.features).repartition(parts, "item_id")
    it = checkpointed(it.withColumn(_ITEM, F.monotonically_increasing_id()))
    seeking = it.drop("item_id").repartition(parts, _ITEM)  # so that an item's children stay in its part
    first = _measured(index, seeking, descend(index, seeking, weights, lambda at: _enough(at, index.dates)).drop("__need"), weights, [], cap, k)
    found = _first(first, parts, [], k, cap).groupBy(_ITEM).agg(F.count(F.lit(1)).alias("__found"), F.max("distance").alias("__tau"))
    bound = found.select(_ITEM, F.when(F.col("__found") >= k, F.col("__tau")).alias("__tau"))
    it = checkpointed(it.drop("__need").join(bound, _ITEM, "left"))
    seeking = it.drop("item_id")
    c = _measured(index, seeking, within(index, seeking, weights, seeking.columns), weights, [x for x in index.rows.columns if x not in (_SCOPE, _NODE, _PIECE) and not x.startswith("p_z_")], cap, k)
    return _first(c, parts, ["item_id"], k, cap, it.select(_ITEM, "item_id")).drop(_ITEM)


def _first(c: DataFrame, parts: int, names: Sequence[str], k: int, cap: int | None, items: DataFrame | None = None) -> DataFrame:
    """The k nearest rows of each item in order of distance and id (draw), of an incident at most `cap`, with the items' names."""
    out, by = c.repartition(parts, _ITEM), [F.col("distance"), F.col("analogue_id")]
    if cap is not None:
        out = top_rows(out, [_ITEM, "analogue_incident"], by, cap, "__c").drop("__c")
    out = top_rows(out, [_ITEM], by, k, "draw")
    return out if items is None else out.join(items.repartition(parts, _ITEM), _ITEM).select(*names, *out.columns)


def _enough(at: DataFrame, dates: list[int]) -> DataFrame:
    """Of an item's children the nearest that surely hold as many rows as it needs: those before the last date cut that its own cut has reached."""
    day, sure = F.datediff("__cut", F.lit("1990-01-01").cast("date")), F.lit(0).cast("bigint")
    for k, x in enumerate(dates, 1):
        sure = F.when(day >= x, F.col(f"__n{k}")).otherwise(sure)
    before = F.sum(sure).over(W.partitionBy(_ITEM).orderBy("__near", _NODE).rowsBetween(W.unboundedPreceding, -1))
    return at.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < F.col("__need"))


def _inside(distance: Column) -> Column:
    """Whether a distance is not beyond the item's bound __tau (NULL: no bound)."""
    return F.col("__tau").isNull() | (distance <= F.col("__tau") * (1 + 1e-9) + 1e-12)


def within(index: Index, items: DataFrame, weights: dict[str, float], columns: Sequence[str] = (_ITEM, _SCOPE)) -> DataFrame:
    """The leaves whose boxes lie within an item's bound, with these columns of the items."""
    return descend(index, items, weights, lambda at: at.where(_inside(F.col("__near")))).select(*columns, _NODE)


def _measured(index: Index, items: DataFrame, leaves: DataFrame, weights: dict[str, float], payload: Sequence[str], cap: int | None, k: int | None = None) -> DataFrame:
    """__item, analogue_id, analogue_incident, the payload and distance of the eligible rows in the items' leaves, within the bound if the items have one; of an
    item and a piece of a leaf the k nearest rows (None: all), of an incident at most `cap`."""
    order = [c for c in weights if c in index.features]
    keys, parts = [_SCOPE, _NODE, _PIECE], slice_count(leaves)
    pairs = leaves if "__cut" in leaves.columns else _looked_up(leaves, items)
    if "__tau" not in pairs.columns:
        pairs = pairs.withColumn("__tau", F.lit(None).cast("double"))
    pairs = pairs.join(_small(index.pieces, SMALL_LEVEL), [_SCOPE, _NODE], "left").select(
        _SCOPE, _NODE, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__pieces", F.lit(1)) - 1)).alias(_PIECE), _ITEM, "incident_id", F.unix_date("__cut").alias("__cut"), "__tau", *order)
    kept = ["analogue_id", "analogue_incident", *[c for c in payload if c not in ("analogue_id", "analogue_incident")]]
    rows = index.rows.where(F.col("analogue_incident").isNotNull()).select(*keys, *kept, F.unix_date("analogue_date").alias("__day"), *[f"p_{c}" for c in order])
    dates = [c for c, t in rows.dtypes if t == "date"]
    rows = rows.withColumns({c: F.unix_date(c) for c in dates})  # a number is cheaper than a date in pandas
    w = [weights[c] for c in order]

    def met(items: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        i, j, d = _search(rows, items, order, w, k, cap)
        out = rows[kept].iloc[j].reset_index(drop=True)
        out.insert(0, _ITEM, items[_ITEM].to_numpy()[i])
        out["distance"] = d
        return out

    types = dict(rows.dtypes)
    schema = ", ".join([f"{_ITEM} bigint", *[f"`{c}` {types[c]}" for c in kept], "distance double"])
    out = pairs.where(F.col("incident_id").isNotNull()).repartition(parts, *keys).groupBy(*keys).cogroup(rows.repartition(parts, *keys).groupBy(*keys)).applyInPandas(met, schema)
    return out.withColumns({c: F.date_from_unix_date(c) for c in dates})


_SLACK = 1e-12  # what a product of matrices may lose, as a share of the squares
_SETS = 16  # rows of a set of which only the least figure is looked at for a first bound


def _search(rows: pd.DataFrame, items: pd.DataFrame, features: Sequence[str], weights: Sequence[float], k: int | None, cap: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the item, place of the row, distance) of each item's k nearest eligible rows (None: all) within its bound, of an incident at most `cap`.

    One product of matrices gives a little less than every distance; only rows whose figure does not exceed an item's bound are measured exactly. An item
    without a bound takes the figure of a few nearest rows for one, and of more while rows beyond it might be nearer."""
    none = np.zeros(0, np.intp), np.zeros(0, np.intp), np.zeros(0)
    if not len(rows) or not len(items):
        return none
    back = np.argsort(rows["__day"].to_numpy(), kind="stable")
    day, ids, incident = (rows[c].to_numpy()[back] for c in ("__day", "analogue_id", "analogue_incident"))
    p = rows[[f"p_{c}" for c in features]].to_numpy(float)[back].T
    right = np.concatenate([p * p * (1 - _SLACK), p, np.ones((1, len(day)))])
    rank = np.empty(len(ids), np.intp)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    code = None if cap is None else np.unique(incident, return_inverse=True)[1]
    upto = np.searchsorted(day, items["__cut"].to_numpy(), "left")  # rows of earlier days
    turn = np.argsort(upto, kind="stable")
    turn = turn[np.searchsorted(upto[turn], 1) :]
    upto, mine, tau = upto[turn], items["incident_id"].to_numpy()[turn], items["__tau"].to_numpy(float)[turn]
    z = items[list(features)].to_numpy(float)[turn]
    has = ~np.isnan(z)
    v, w, free = np.where(has, z, 0.0), np.where(has, weights, 0.0), np.isnan(tau)
    left = np.hstack([w, -2 * w * v, (w * v * v).sum(1)[:, None] * (1 - _SLACK)])
    bound = np.where(free, np.finfo(float).max, tau * (1 + 1e-9) + 1e-12)
    free = free & (k is not None)
    found, step = [none], max(1, CELLS // len(day))
    for a in range(0, len(turn), step):
        at = np.arange(a, min(a + step, len(turn)))
        n, sure = upto[at[-1]], upto[a]
        low = left[at] @ right[:, :n]
        if sure < n:
            low[:, sure:][np.arange(sure, n) >= upto[at][:, None]] = np.inf
        q = 4 * (k or 1)
        while len(at):
            reach, cut = bound[at], np.flatnonzero(free[at])
            if q <= n // _SETS and len(cut):  # q sets have a row that reaches no further than the q-th of their least figures
                least = low[cut, : n // _SETS]
                for c in range(1, _SETS):
                    np.minimum(least, low[cut, c * (n // _SETS) : (c + 1) * (n // _SETS)], out=least)
                reach[cut] = np.minimum(reach[cut], np.partition(least, q - 1, 1)[:, q - 1])
            i, j = np.divmod(np.flatnonzero(low <= reach[:, None]), n)
            d = _exact(weights, p[:, j], v[at[i]].T, has[at[i]].T)
            i, j, d = _taken((incident[j] != mine[at[i]]) & (d <= bound[at[i]]), i, j, d)
            i, j, d = _taken(np.lexsort((rank[j], d, i)), i, j, d)
            if cap is not None:
                i, j, d = _taken(_place(i, code[j]) < cap, i, j, d)
            again = np.zeros(len(at), bool)
            if k is not None:
                place = _place(i)
                last = np.full(len(at), np.inf)
                last[i[place == k - 1]] = d[place == k - 1]
                again = free[at] & (last > reach) & (q <= n // _SETS)
                i, j, d = _taken((place < k) & ~again[i], i, j, d)
            found.append((turn[at[i]], back[j], d))
            at, low, q = at[again], low[again], q * 4
    return tuple(np.concatenate(x) for x in zip(*found))


def _taken(which: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(x[which] for x in arrays)


def _place(*keys: np.ndarray) -> np.ndarray:
    """Number of earlier entries with the same keys."""
    order = np.lexsort(keys[::-1])  # stable
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    at = np.arange(len(order))
    out = np.empty(len(order), np.intp)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def _exact(weights: Sequence[float], p: np.ndarray, v: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Weighted squared distances, feature by feature as in SQL, so that equal ones are equal."""
    out = np.zeros(p.shape[1])
    for w, a, b, h in zip(weights, p, v, has):
        out += np.where(h, w * (a - b) ** 2, 0.0)
    return out
