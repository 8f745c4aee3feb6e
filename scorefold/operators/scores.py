"""Score tables: regression, movement, binary, ranking and agreement metrics per group of a long response log.

Means and counts are map-side aggregates. What needs an order (medians, ranks, average precision) works on distinct values
with counts and sliced running sums, so one very large run does not meet one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scorefold.functions.columns import MOVED, moved, shown
from scorefold.operators.ordered import SLICES, percentiles, positions, running, top_rows, value_counts
from scorefold.session import checkpointed


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that sums in another order give the same table."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def share(cond: Column) -> Column:
    """Share of rows where the condition holds; rows where it is NULL are left out."""
    return F.avg(cond.cast("double"))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _with_medians(agg: DataFrame, med: DataFrame, by: Sequence[str]) -> DataFrame:
    return agg.join(med, list(by), "left") if by else agg.crossJoin(F.broadcast(med))


# --- numeric predictions ----------------------------------------------------------------------------------------------
def regression_scores(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, parsed rows, absolute errors, share within 25 % (of at least one), log-ratio median, moving-day error,
    share with a smaller raw error than persistence."""
    y, p, b, s = (F.col(x) for x in ("target", "prediction", "persistence", "scale"))
    ok = log.where(p.isNotNull())
    err = F.abs(y - p)
    agg = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.count("prediction").alias("parsed"),
        F.avg(err).alias("mae"),
        F.avg(err / s).alias("mae_scaled"),
        share(err / F.greatest(y, F.lit(1.0)) <= 0.25).alias("within_25"),
        F.avg(F.when(moved(y, b), err / s)).alias("mae_scaled_moving"),
        share(err < F.abs(y - b)).alias("beats_persistence"),
    )
    med = percentiles(ok.withColumn("__lr", F.abs(F.log((p + 1) / (y + 1)))), by, "__lr", {"median_abs_log_ratio": 0.5})
    return _with_medians(agg, med, by)


def movement_scores(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Error on stable and moving rows, false and missed moves, direction, scaled-error wins over persistence."""
    y, p, b, s = (F.col(x) for x in ("target", "prediction", "persistence", "scale"))
    ok = log.where(p.isNotNull())
    truth, said = moved(y, b), moved(p, b)
    err = F.abs(y - p) / s
    return ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("parsed"),
        F.avg(F.when(~truth, err)).alias("stable_error"),
        F.avg(F.when(truth, err)).alias("moving_error"),
        share(F.when(~truth, said)).alias("false_move"),
        share(F.when(truth, ~said)).alias("missed_move"),
        share(F.when(truth, F.signum(y - b) == F.signum(p - b))).alias("direction_right"),
        share(err < F.abs(y - b) / s).alias("beats_persistence_scaled"),
    )


def sweep_scores(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sweep table: persistence error and copies, error without the worst row; ``within_25`` here is abs(p-y) <= y/4."""
    y, p, b, s = (F.col(x) for x in ("target", "prediction", "persistence", "scale"))
    err, berr = F.abs(y - p) / s, F.abs(y - b) / s
    seen = F.when(p.isNotNull(), berr)
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.count("prediction").alias("parsed"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg(err).alias("mae_scaled"),
        F.avg(seen).alias("persistence_mae_scaled"),
        share(err < berr).alias("beats_persistence"),
        share(F.abs(p - y) <= 0.25 * y).alias("within_25_of_target"),
        count_if(p == b).alias("persistence_copies"),
        F.when(F.count(err) > 1, (F.sum(err) - F.max(err)) / (F.count(err) - 1)).alias("mae_scaled_without_worst"),
    )


def numeric_error_summary(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Relative error of numeric answers: count, median, share within 10 %."""
    rel = F.abs(F.col("prediction") - F.col("target")) / F.abs("target")
    ok = log.where(F.col("prediction").isNotNull() & (F.col("target") != 0)).withColumn("__rel", rel)
    agg = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(F.col("__rel") <= 0.1).alias("within_10"))
    return _with_medians(agg, percentiles(ok, by, "__rel", {"median_rel_error": 0.5}), by)


# --- binary calls -----------------------------------------------------------------------------------------------------
def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    den = 2 * tp + fp + fn
    return F.when(den > 0, 2.0 * tp / den).otherwise(0.0)


def binary_scores(log: DataFrame, by: Sequence[str], label: str = "label", said: str = "said") -> DataFrame:
    """Accuracy, recall, false-positive rate, balanced accuracy, F1 of both classes, call rate, over answered rows."""
    y, p = F.col(label) == 1, F.col(said) == 1
    g = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.count(said).alias("parsed"),
        count_if(y & p).alias("tp"), count_if(~y & p).alias("fp"), count_if(y & ~p).alias("fn"), count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    recall = F.when(tp + fn > 0, tp / (tp + fn))
    fpr = F.when(fp + tn > 0, fp / (fp + tn))
    return g.select(
        *by, "items", "parsed", "tp", "fp", "fn", "tn",
        F.when(F.col("parsed") > 0, (tp + tn) / F.col("parsed")).alias("accuracy"),
        recall.alias("recall"), fpr.alias("false_positive_rate"),
        (0.5 * (recall + 1.0 - fpr)).alias("balanced_accuracy"),
        _f1(tp, fp, fn).alias("f1_positive"), _f1(tn, fn, fp).alias("f1_negative"),
        F.when(F.col("parsed") > 0, (tp + fp) / F.col("parsed")).alias("call_rate"),
    )


def accuracy_by(log: DataFrame, run: Sequence[str], dims: Sequence[str], correct: str = "correct") -> DataFrame:
    """Accuracy per run and per value of each dimension, in one pass over grouping sets (long form)."""
    run, dims = list(run), list(dims)
    base = log.select(*run, *dims, F.col(correct).cast("double").alias("__c"))
    sets = [[F.col(r) for r in run] + [F.col(d)] for d in dims] + [[F.col(r) for r in run]]
    g = base.groupingSets(sets, *[F.col(c) for c in run + dims]).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__c").alias("accuracy"),
        *[F.grouping(d).alias(f"__g_{d}") for d in dims],
    )
    name, val = F.lit("all"), F.lit("all")
    for d in dims:
        name = F.when(F.col(f"__g_{d}") == 0, F.lit(d)).otherwise(name)
        val = F.when(F.col(f"__g_{d}") == 0, F.coalesce(F.col(d).cast("string"), F.lit("none"))).otherwise(val)
    return g.select(*run, name.alias("dimension"), val.alias("value"), "n", "accuracy")


def time_to_detection(log: DataFrame, run: Sequence[str], seq: str = "sequence", offset: str = "offset_seconds", said: str = "said") -> DataFrame:
    """Per run: sequences with a positive-offset frame, how many were called, and the median first positive call."""
    after = log.where(F.col(offset) > 0)
    first = after.groupBy(*run, seq).agg(F.min(F.when(F.col(said) == 1, F.col(offset))).cast("double").alias("first_hit"))
    agg = first.groupBy(*run).agg(F.count(F.lit(1)).alias("sequences"), F.count("first_hit").alias("detected"))
    return _with_medians(agg, percentiles(first, run, "first_hit", {"median_offset": 0.5}), run)


def call_detail(log: DataFrame, by: Sequence[str], label: str = "label", delta: Column | None = None) -> DataFrame:
    """Omitted and stated calls, calls imputed from the probability, scored call rate and F1. With ``delta``, a shift of the log odds that
    is the same in all rows of a group, also the rate and F1 of calls at one half after the shift, and the stated probability that the
    shift moves to one half."""
    stated = F.col("call")
    said = F.coalesce(stated, (F.col("score") >= 0.5).cast("int"))
    y = F.col(label) == 1
    tp, fp, fn = count_if(y & (said == 1)), count_if(~y & (said == 1)), count_if(y & (said == 0))
    return log.where(F.col("score").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(stated.isNull()).alias("omitted"),
        count_if(stated == 1).alias("stated_yes"),
        count_if(stated.isNull() & (said == 1)).alias("imputed_yes"),
        share(said == 1).alias("call_rate"),
        (2.0 * tp / F.greatest(2 * tp + fp + fn, F.lit(1))).alias("f1"),
        *_shifted_calls(y, delta),
    )


def _shifted_calls(y: Column, delta: Column | None) -> list[Column]:
    if delta is None:
        return []
    even = 1 / (1 + F.exp(delta))
    yes = F.col("score") >= even
    tp, wrong = count_if(y & yes), count_if(y != yes)
    return [share(yes).alias("shifted_call_rate"), (2.0 * tp / F.greatest(2 * tp + wrong, F.lit(1))).alias("shifted_f1"), F.max(even).alias("equivalent_threshold")]


def answer_counts(log: DataFrame, by: Sequence[str], prediction: str, error: str, stop: str, calls: str | None = None) -> DataFrame:
    """Rows, errors, unparsed rows without an error and rows cut by the provider per group; with ``calls``, mean tool calls and rows
    without any."""
    bad = F.coalesce(F.col(error) != "", F.lit(False))
    more = [] if calls is None else [F.avg(F.coalesce(F.col(calls), F.lit(0)).cast("double")).alias("mean_calls"), count_if(F.coalesce(F.col(calls), F.lit(0)) == 0).alias("no_call_items")]
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), count_if(bad).alias("errors"), count_if(F.col(prediction).isNull() & ~bad).alias("unparsed"),
        count_if(F.col(stop).isin("max_tokens", "length")).alias("truncated"), *more)


def modal_answer(items: DataFrame, by: Sequence[str], answer: Column, share_name: str = "modal") -> DataFrame:
    """The commonest answer of each group (of equal ones the smallest) and its share: the score of repeating it."""
    n = items.groupBy(*by, answer.alias("modal_answer")).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("k"), "modal_answer"))["modal_answer"]
    return n.groupBy(*by).agg(best.alias("modal_answer"), F.sum("__n").alias("n"), (F.max("__n") / F.sum("__n")).alias(share_name))


def combined_baseline(choices: DataFrame, texts: DataFrame, pair: str, options: str = "options", gold: str = "answer", fold: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """One row: first option on the choice items, commonest answer on the text items, both together over all items, and how often copying
    a pair's choice answer answers its text item."""
    first = choices.agg(F.count(F.lit(1)).alias("n_choice"), count_if(F.get(F.col(options), F.lit(0)) == F.col(gold)).alias("first_hits"))
    modal = modal_answer(texts, [], fold(F.col(gold))).select(F.col("n").alias("n_text"), F.round(F.col("modal") * F.col("n")).cast("bigint").alias("modal_hits"))
    both = choices.select(pair, fold(F.col(gold)).alias("__a")).join(texts.select(pair, fold(F.col(gold)).alias("__b")), pair)
    copied = both.agg(count_if(F.col("__a") == F.col("__b")).alias("copied"))
    one = first.crossJoin(modal).crossJoin(copied)  # three one-row tables
    return one.select("n_choice", "n_text", "first_hits", "modal_hits", "copied", ((F.col("first_hits") + F.col("modal_hits")) / (F.col("n_choice") + F.col("n_text"))).alias("combined"),
                      (F.col("copied") / F.col("n_text")).alias("copy_across"))


# --- ranking ----------------------------------------------------------------------------------------------------------
def _score_counts(df: DataFrame, by: Sequence[str], score: str, label: str, weight: Column | None, slices: int | None) -> DataFrame:
    """Distinct scores, descending, with (weighted) positives and rows and their inclusive running sums."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    hist = df.groupBy(*by, (F.lit(0.0) - F.col(score)).alias("__neg")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("__pos"), F.sum(w).alias("__all")
    )
    hist = hist if slices == 1 else checkpointed(hist)
    return running(hist, by, ["__neg"], {"__tp": F.col("__pos"), "__seen": F.col("__all")}, slices, totals=True)


def average_precision(
    df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", weight: Column | None = None, slices: int | None = SLICES,
    out: str = "ap",
) -> DataFrame:
    """Step-wise average precision with ties grouped at distinct scores; NULL without a positive."""
    h = _score_counts(df.where(F.col(score).isNotNull()), by, score, label, weight, slices)
    step = F.when(F.col("__seen") > 0, F.col("__pos") * F.col("__tp") / F.col("__seen"))
    return h.groupBy(*by).agg(
        F.max("__seen_total").cast("bigint").alias("n"), F.max("__tp_total").cast("bigint").alias("positives"),
        F.when(F.max("__tp_total") > 0, F.sum(step) / F.max("__tp_total")).alias(out),
    )


def average_precision_untied(df: DataFrame, by: Sequence[str], score: str, label: str, order: str) -> DataFrame:
    """Average precision stepping every row in (score desc, ordinal) order: no tie grouping, a different number on ties."""
    rows = df.where(F.col(score).isNotNull()).withColumn("__y", (F.col(label) == 1).cast("bigint"))
    r = running(rows, by, [F.lit(0.0) - F.col(score), order], {"__tp": F.col("__y"), "__k": F.lit(1).cast("bigint")})
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.sum("__y") > 0, F.sum(F.when(F.col("__y") == 1, F.col("__tp") / F.col("__k"))) / F.sum("__y")).alias("ap_untied"),
    )


def auroc(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", slices: int | None = SLICES) -> DataFrame:
    """P(positive scores above negative) plus half the ties, from running counts over distinct scores."""
    h = _score_counts(df.where(F.col(score).isNotNull()), by, score, label, None, slices)
    neg = F.col("__all") - F.col("__pos")
    neg_below = (F.col("__seen_total") - F.col("__tp_total")) - (F.col("__seen") - F.col("__tp"))
    n1, n0 = F.max("__tp_total"), F.max("__seen_total") - F.max("__tp_total")
    return h.groupBy(*by).agg(
        n1.alias("positives"), n0.alias("negatives"),
        F.when((n1 > 0) & (n0 > 0), F.sum(F.col("__pos") * (neg_below + neg / 2.0)) / (n1 * n0)).alias("auroc"),
    )


def cumulative_confusion(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """True and false positives at every distinct score taken as a cut, from the highest down."""
    h = _score_counts(df.where(F.col(score).isNotNull()), by, score, label, None, SLICES)
    return h.select(*by, (F.lit(0.0) - F.col("__neg")).alias(score), F.col("__tp").alias("tp"), (F.col("__seen") - F.col("__tp")).alias("fp"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, out: str = "rho", slices: int | None = SLICES) -> DataFrame:
    """Rank correlation with averaged ties. Equal (x, y) rows are merged first, so the rank joins see distinct pairs."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("__c"))
    return weighted_spearman(cells, by, x, y, "__c", out, slices)


def weighted_spearman(cells: DataFrame, by: Sequence[str], x: str, y: str, weight: str, out: str = "rho", slices: int | None = SLICES) -> DataFrame:
    """Rank correlation over distinct (x, y) cells with whole-number weights."""
    by, cells = list(by), checkpointed(cells)

    def ranks(col: str, name: str) -> DataFrame:
        h = cells.groupBy(*by, col).agg(F.sum(weight).alias("__n"))
        r = running(h, by, [col], {"__cum": F.col("__n")}, slices)
        return r.select(*by, col, (F.col("__cum") - (F.col("__n") - 1) / 2.0).alias(name))

    j = cells.join(ranks(x, "__rx"), by + [x]).join(ranks(y, "__ry"), by + [y])
    w, a, b = F.col(weight), F.col("__rx"), F.col("__ry")
    m = j.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"),
        F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"),
    )
    n = F.col("n")
    cov, va, vb = (n * F.col("sab") - F.col("sa") * F.col("sb"), n * F.col("saa") - F.col("sa") ** 2, n * F.col("sbb") - F.col("sb") ** 2)
    return m.select(*by, n.alias("n"), F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias(out))


def rank_sums(df: DataFrame, by: Sequence[str], value: str, label: str) -> DataFrame:
    """Sum of average ranks of the positive class, per group."""
    h = value_counts(df.where(F.col(value).isNotNull()), by, value, pos=(F.col(label) == 1).cast("bigint"))
    rank = F.col("cum") - (F.col("n") - 1) / 2.0
    return h.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("n").alias("n"), F.sum(F.col("pos") * rank).alias("rank_sum"))


# --- stated probabilities ---------------------------------------------------------------------------------------------
def granularity(df: DataFrame, by: Sequence[str], value: str, k: int = 10) -> DataFrame:
    """Distinct stated values and the k most frequent ones with their share."""
    h = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    tot = h.groupBy(*by).agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("total"))
    top = top_rows(h, by, [F.desc("n"), F.asc(value)], k)
    return top.join(tot, list(by)).select(*by, "distinct_values", "rk", value, "n", (F.col("n") / F.col("total")).alias("share"))


def decision_consistency(df: DataFrame, by: Sequence[str], prob: str = "probability", call: str = "call") -> DataFrame:
    """Whether the call agrees with the probability at one half, with the spread of p where a yes comes with p < 0.5."""
    rows = df.where(F.col(prob).isNotNull())
    c, over = F.col(call), (F.col(prob) >= 0.5).cast("int")
    n = F.count(F.lit(1))
    agg = rows.groupBy(*by).agg(
        n.alias("n"), count_if(c == over).alias("consistent"), count_if(c != over).alias("inconsistent"), count_if(c.isNull()).alias("omitted"),
        (count_if(c == over) / n).alias("consistent_rate"),
        count_if((c == 1) & (over == 0)).alias("yes_below_half"), count_if((c == 0) & (over == 1)).alias("no_above_half"),
        F.min(F.when((c == 1) & (over == 0), F.col(prob))).alias("yes_min"), F.max(F.when((c == 1) & (over == 0), F.col(prob))).alias("yes_max"),
    )
    low = percentiles(rows.where((c == 1) & (over == 0)), by, prob, {"yes_p25": 0.25, "yes_median": 0.5, "yes_p75": 0.75})
    return _with_medians(agg, low, by)


# --- tokens -----------------------------------------------------------------------------------------------------------
def token_stats(log: DataFrame, by: Sequence[str], reasoning: str, completion: str, cap: str, margin: int) -> DataFrame:
    """Median and lower-90th reasoning tokens, median completion tokens, counts near the output cap, and the table cell,
    which reads ``n/r`` unless every row reports reasoning tokens."""
    near = F.col(completion) >= F.col(cap) - margin
    agg = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(reasoning).alias("n_reasoning"), count_if(near).alias("near_cap"),
        count_if(near & F.col("answered")).alias("near_cap_answered"),
    )
    h = value_counts(log.where(F.col(reasoning).isNotNull()), by, reasoning)
    at = F.floor(0.9 * (F.col("cum_total") - 1))
    p90 = h.groupBy(*by).agg(F.min(F.when(F.col("cum") > at, F.col(reasoning))).cast("double").alias("p90_reasoning"))
    med_r = percentiles(log, by, reasoning, {"median_reasoning": 0.5})
    med_c = percentiles(log, by, completion, {"median_completion": 0.5})
    out = _with_medians(_with_medians(_with_medians(agg, p90, by), med_r, by), med_c, by)
    cell = F.when(F.col("n") == F.col("n_reasoning"), F.floor(F.col("median_reasoning") + 0.5).cast("string")).otherwise("n/r")
    return out.withColumn("table_cell", cell)


def model_token_summary(stats: DataFrame, model: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """Second-level roll-up: range of the printed cells, cells not reported, cells with rows near the cap."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in cell])
    value = F.when(F.col("table_cell") != "n/r", F.floor(F.col("median_reasoning") + 0.5))
    return stats.groupBy(*model).agg(
        F.min(value).alias("cell_min"), F.max(value).alias("cell_max"),
        count_if(F.col("table_cell") == "n/r").alias("cells_not_reported"),
        F.sum("n").alias("responses"), F.sum("n_reasoning").alias("responses_with_reasoning"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("near_cap") > 0, F.struct(name, "near_cap"))))).alias("near_cap"),
    )


# --- paired arms ------------------------------------------------------------------------------------------------------
def discordance(pairs: DataFrame, by: Sequence[str], a: str = "a_said", b: str = "b_said", label: str = "label") -> DataFrame:
    """Positives gained and lost, false positives added and removed, net, and the rescue rate of missed positives."""
    y, x, z = F.col(label) == 1, F.col(a) == 1, F.col(b) == 1
    missed = count_if(y & ~x)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), count_if(y & ~x & z).alias("gained"), count_if(y & x & ~z).alias("lost"),
        (count_if(y & ~x & z) - count_if(y & x & ~z)).alias("net"),
        count_if(~y & ~x & z).alias("new_false_positives"), count_if(~y & x & ~z).alias("removed_false_positives"),
        missed.alias("missed_before"), F.when(missed > 0, count_if(y & ~x & z) / missed).alias("rescue_rate"),
    )


def position_rates(pairs: DataFrame, position: str, a: str = "a_said", b: str = "b_said") -> DataFrame:
    """Call rates of both arms and their change per ladder position, with a pooled row."""
    g = pairs.rollup(position).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(F.col(a).cast("double")).alias("bare_rate"), F.avg(F.col(b).cast("double")).alias("grounded_rate"),
        F.grouping(position).alias("__g"),
    )
    label = F.when(F.col("__g") == 1, "all").otherwise(F.col(position).cast("string"))
    return g.select(label.alias("position"), "pairs", "bare_rate", "grounded_rate", (F.col("grounded_rate") - F.col("bare_rate")).alias("change"))


def ols_slope(df: DataFrame, by: Sequence[str], x: str, v: str) -> DataFrame:
    """Least-squares slope per group from moments; NULL below two points or without spread in x."""
    a, b = F.col(x).cast("double"), F.col(v).cast("double")
    both = df.where(a.isNotNull() & b.isNotNull())
    n, den = F.count(F.lit(1)), F.count(F.lit(1)) * F.sum(a * a) - F.sum(a) ** 2
    return both.groupBy(*by).agg(n.alias("n"), F.when((n >= 2) & (F.var_pop(a) > 0), (n * F.sum(a * b) - F.sum(a) * F.sum(b)) / den).alias("slope"))


def repeat_stability(first: DataFrame, second: DataFrame, by: Sequence[str], key: Sequence[str], label: str = "label") -> DataFrame:
    """Two runs of the same requests: flips, mean absolute change, changed rows and both accuracies."""
    keys = list(by) + list(key)
    a = first.select(*keys, label, F.col("said").alias("__s1"), F.col("score").alias("__p1"))
    b = second.select(*keys, F.col("said").alias("__s2"), F.col("score").alias("__p2"))
    j = a.join(b, keys).where(F.col("__s1").isNotNull() & F.col("__s2").isNotNull())
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), count_if(F.col("__s1") != F.col("__s2")).alias("flips"),
        F.avg(F.abs(F.col("__p1") - F.col("__p2"))).alias("mean_abs_change"), count_if(F.col("__p1") != F.col("__p2")).alias("changed"),
        share(F.col("__s1") == F.col(label)).alias("accuracy_1"), share(F.col("__s2") == F.col(label)).alias("accuracy_2"),
    )


def joint_value_counts(wide: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """How often each (value in variant a, value in variant b, label) occurs."""
    return wide.groupBy(F.col(a).alias("a"), F.col(b).alias("b"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# --- tables over runs -------------------------------------------------------------------------------------------------
def sweep_tallies(scores: DataFrame, model: str, arm: str, metrics: Sequence[str], base: str, other: str) -> DataFrame:
    """Per metric: models where the other arm is higher / lower / equal, ranges of both arms and of the change."""
    long = scores.select(model, arm, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    wide = long.groupBy(model, "metric").pivot(arm, [base, other]).agg(F.first("value"))
    d = F.col(other) - F.col(base)
    return wide.groupBy("metric").agg(
        count_if(d > 0).alias("raised"), count_if(d < 0).alias("lowered"), count_if(d == 0).alias("equal"),
        F.min(base).alias("base_min"), F.max(base).alias("base_max"), F.min(other).alias("other_min"), F.max(other).alias("other_max"),
        F.min(d).alias("change_min"), F.max(d).alias("change_max"),
    )


def monotone_in_order(scores: DataFrame, family: str, rank: str, metric: str, falling: bool = True) -> DataFrame:
    """Whether a metric moves one way along the given order of a family's members (a family is a handful of models)."""
    w = W.partitionBy(family).orderBy(rank)
    prev = F.lag(metric).over(w)
    broken = (F.col(metric) > prev) if falling else (F.col(metric) < prev)
    marked = scores.withColumn("__bad", F.coalesce(broken, F.lit(False)))
    return marked.groupBy(family).agg(F.count(F.lit(1)).alias("members"), (~F.bool_or("__bad")).cast("int").alias("monotone"))


def contrast_table(scores: DataFrame, keys: Sequence[str], arm: str, base: str, other: str, metrics: Sequence[str]) -> DataFrame:
    """One row per key and metric with both arms' values and their difference, plus a pooled mean over all keys."""
    pairs = [x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]
    long = scores.select(*keys, arm, F.explode(F.create_map(*pairs)).alias("metric", "value"))
    wide = long.groupBy(*keys, "metric").pivot(arm, [base, other]).agg(F.first("value"))
    wide = wide.withColumn("change", F.col(other) - F.col(base))
    pooled = wide.groupBy("metric").agg(F.avg(base).alias(base), F.avg(other).alias(other), F.avg("change").alias("change"))
    named = wide.withColumns({k: F.col(k).cast("string") for k in keys})
    return named.unionByName(pooled.withColumns({k: F.lit("all") for k in keys}))


def cv_metrics(preds: DataFrame, model: str, fold: str) -> DataFrame:
    """Mean over folds of each fold's absolute and scaled error."""
    err = F.abs(F.col("target") - F.col("prediction"))
    per = preds.groupBy(model, fold).agg(F.avg(err).alias("mae"), F.avg(err / F.col("scale")).alias("mae_scaled"))
    return per.groupBy(model).agg(F.count(F.lit(1)).alias("folds"), F.avg("mae").alias("cv_mae"), F.avg("mae_scaled").alias("cv_mae_scaled"))


def run_listing(log: DataFrame, by: Sequence[str], min_rows: int) -> DataFrame:
    """One row per run with parsed and missing counts; short runs are left out."""
    g = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count("score").alias("parsed"), count_if(F.col("score").isNull()).alias("missing"),
        count_if(F.col("probability").isNotNull() & F.col("call").isNull()).alias("omitted_call"),
    )
    return g.where(F.col("rows") >= min_rows)


# --- agreement with displayed analogues -------------------------------------------------------------------------------
def copy_agreement(log: DataFrame, by: Sequence[str], ratios: str = "ratios") -> DataFrame:
    """Share of predictions equal to the displayed rule (persistence times the two-decimal median ratio, half-even) and to
    persistence, with the mean and median deviation. ``ratios`` is the short list of ratios an item displayed."""
    med = F.when(
        F.size(ratios) % 2 == 1, F.get(F.array_sort(ratios), (F.size(ratios) / 2).cast("int"))
    ).otherwise((F.get(F.array_sort(ratios), (F.size(ratios) / 2).cast("int")) + F.get(F.array_sort(ratios), (F.size(ratios) / 2).cast("int") - 1)) / 2.0)
    rows = log.where(F.col("prediction").isNotNull() & (F.size(ratios) > 0)).withColumn("__shown", shown(med))
    rows = rows.withColumn("__rule", F.bround(F.col("persistence") * F.col("__shown"), 0))
    rows = rows.withColumn("__dev", F.abs(F.col("prediction") - F.col("__rule")))
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("__dev") == 0).alias("equal_rule"), share(F.col("__dev") == 0).alias("equal_rule_share"),
        share(F.col("prediction") == F.col("persistence")).alias("equal_persistence_share"), F.avg("__dev").alias("mean_dev"),
    )
    return _with_medians(agg, percentiles(rows, by, "__dev", {"median_dev": 0.5}), by)


def extreme_copies(log: DataFrame, by: Sequence[str], outcomes: str, high: float = 100, low: float = 5) -> DataFrame:
    """Predictions of low-count items that equal a displayed outcome of a high-count analogue."""
    hit = F.exists(outcomes, lambda o: (o == F.col("prediction")) & (o >= high)) & (F.col("persistence") <= low)
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count_if(hit).alias("extreme"))


def analogue_record(items: DataFrame, by: str, *draws: tuple[str, DataFrame]) -> DataFrame:
    """One record per item: the actual ratio and, per rule, the analogue prediction joined by item."""
    out = items.withColumn("actual_ratio", F.col("target") / F.greatest("persistence", F.lit(1.0)))
    for name, d in draws:
        out = out.join(d.select(by, *[F.col(c).alias(f"{name}_{c}") for c in d.columns if c != by]), by, "left")
    return out


# --- comparators ------------------------------------------------------------------------------------------------------
def majority_class(df: DataFrame, key: Sequence[str], answer: str) -> DataFrame:
    """Modal answer per key with its count, share and margin over the second."""
    h = df.groupBy(*key, answer).agg(F.count(F.lit(1)).alias("n"))
    tot = h.groupBy(*key).agg(F.sum("n").alias("total"))
    two = top_rows(h, key, [F.desc("n"), F.asc(answer)], 2)
    best = two.groupBy(*key).agg(
        F.max(F.when(F.col("rk") == 1, F.col(answer))).alias(answer), F.max(F.when(F.col("rk") == 1, F.col("n"))).alias("n"),
        F.max(F.when(F.col("rk") == 2, F.col("n"))).alias("second"),
    )
    return best.join(tot, list(key)).select(*key, answer, "n", (F.col("n") / F.col("total")).alias("share"), (F.col("n") - F.coalesce("second", F.lit(0))).alias("margin"))


def hybrid_reference(items: DataFrame, by: Sequence[str], rule: str, majority: str, gold: str, options: str) -> DataFrame:
    """Rule answer where there is one, majority elsewhere, beside the uniform-random floor."""
    pick = F.coalesce(F.col(rule), F.col(majority))
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(pick == F.col(gold)).alias("hybrid"), share(F.col(majority) == F.col(gold)).alias("majority"),
        F.avg(1.0 / F.size(options)).alias("random_floor"),
    )


def matched_comparator(answered: DataFrame, items: DataFrame, by: Sequence[str], key: str, comparator: Mapping[str, Column], label: str) -> DataFrame:
    """Comparators re-scored (AP) on exactly the items each run answered."""
    mine = answered.select(*by, key).distinct().join(items, key)
    long = mine.select(*by, label, F.explode(F.create_map(*[x for n, c in comparator.items() for x in (F.lit(n), c.cast("double"))])).alias("comparator", "__v"))
    return average_precision(long, [*by, "comparator"], "__v", label)


def option_position_baselines(items: DataFrame, by: Sequence[str], options: str = "options", gold: str = "answer") -> DataFrame:
    """Accuracy of always taking the first, last, shortest or longest option, with the normal half-width of the first."""
    o = F.col(options)
    by_len = F.array_sort(F.transform(o, lambda x, i: F.struct(F.length(x).alias("l"), i.alias("i"), x.alias("v"))))
    by_len_desc = F.array_sort(F.transform(o, lambda x, i: F.struct((-F.length(x)).alias("l"), i.alias("i"), x.alias("v"))))
    hit = lambda x: x == F.col(gold)
    g = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(hit(F.element_at(o, 1))).alias("first"), share(hit(F.element_at(o, -1))).alias("last"),
        share(hit(F.element_at(by_len, 1)["v"])).alias("shortest"), share(hit(F.element_at(by_len_desc, 1)["v"])).alias("longest"),
    )
    return g.withColumn("first_halfwidth", 1.96 * F.sqrt(F.col("first") * (1 - F.col("first")) / F.col("n")))


def difficulty_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Run-length encoding of a label in list order: start position, label and length of each run."""
    from scorefold.operators.ordered import neighbour

    p = positions(df, by, order, "__p")
    p = neighbour(p, by, ["__p"], {"__before": F.struct(F.col(label).alias("v"))})
    change = (F.col("__before").isNull() | ~F.col("__before.v").eqNullSafe(F.col(label))).cast("bigint")
    r = running(p.withColumn("__c", change), by, ["__p"], {"run": F.col("__c")})
    return r.groupBy(*by, "run").agg(F.min("__p").alias("start"), F.first(label).alias(label), F.count(F.lit(1)).alias("length"))


def last_valid(arr: Column | str) -> Column:
    """Struct (value, days_back) of the last non-null element of an array."""
    a = F.col(arr) if isinstance(arr, str) else arr
    seen = F.filter(F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i"))), lambda s: s["v"].isNotNull())
    last = F.try_element_at(seen, F.lit(-1))
    return F.struct(last["v"].alias("value"), (F.size(a) - 1 - last["i"]).cast("bigint").alias("days_back"))
