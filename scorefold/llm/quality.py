"""Quality rules as a short-circuit cascade.

Every rule is a rejecting predicate over text metrics. On a sample, each rule is run alone from the raw text, which gives its cost (seconds a row, less
those of a rule that looks at nothing) and its selectivity (share rejected); rules are then put in the order of rejection per cost. One CASE expression
evaluates them in that order, and a metric is an expression inside the branch that needs it, so a document pays for no metric of a rule behind the
first that rejects it. The order changes the work and the rule named, never the verdict.

Defined results: a null or blank text has no words and is rejected by the word-count rule; repeated rows are judged alike, each for itself;
an empty table gives no rows; columns named `rejected_by` and `kept` are replaced, all others pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.llm import query
from scorefold.llm.common import SPACES, let, stored, table, words

#: Rows on which costs and selectivities are estimated, in the mean.
SAMPLE_ROWS = 2_000


# ---- metrics: longs of the whole text, null as empty ----------------------------------------------------------------------------------------------


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _lines(text: str) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(_text(text), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def _count(text: str, pattern: str) -> Column:
    return (F.size(F.split(_text(text), pattern)) - 1).cast("bigint")


def repeat_words(text: str) -> Column:
    """Words in three-word windows that occur twice or more.

    Repeats are found without leaving the row: window hashes are packed with their position into one long and sorted; neighbours with equal hash bits are
    candidates, whose words are then compared as text. The packed positions get as many bits as the text needs, so no length is left out.
    """
    left = lambda h, b: F.call_function("shiftleft", h, b)
    right = lambda h, b: F.call_function("shiftright", h, b)
    beside = lambda xs, i, same: F.coalesce(same(F.get(xs, i - 1)), F.lit(False)) | F.coalesce(same(F.get(xs, i + 1)), F.lit(False))

    def of(w: Column, b: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(3))))
        at = lambda x: (x - left(right(x, b), b)).cast("int")

        def from_packed(s: Column) -> Column:
            near = F.filter(s, lambda x, i: beside(s, i, lambda y: right(y, b) == right(x, b)))
            grams = F.sort_array(F.transform(near, lambda x: F.struct(F.concat_ws(" ", F.slice(w, at(x) + 1, 3)).alias("g"), at(x).alias("p"))))
            return let(grams, from_grams)

        return let(F.sort_array(F.transform(hashes, lambda h, i: left(right(h, b), b).bitwiseOR(i.cast("bigint")))), from_packed)

    def from_grams(g: Column) -> Column:
        starts = F.sort_array(F.transform(F.filter(g, lambda x, i: beside(g, i, lambda y: y["g"] == x["g"])), lambda x: x["p"]))
        covered = lambda s: F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3))).cast("bigint"))
        return let(starts, lambda s: F.aggregate(covered(s), F.lit(0).cast("bigint"), lambda a, x: a + x))

    found = let(words(F.col(text)), lambda w: F.when(F.size(w) >= 3, let(F.length(F.bin(F.size(w))), lambda b: of(w, b))))
    return F.coalesce(found, F.lit(0).cast("bigint"))


METRICS: dict[str, Callable[[str], Column]] = {
    "n_words": lambda t: F.size(words(F.col(t))).cast("bigint"),
    "word_chars": lambda t: F.length(_text(t)).cast("bigint") - _count(t, r"[\x20\x09-\x0D]"),
    "n_symbols": lambda t: _count(t, r"[#*$%&|<>]"),
    "n_lines": lambda t: F.size(_lines(t)).cast("bigint"),
    "n_dup_lines": lambda t: let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    "n_letters": lambda t: _count(t, r"\p{L}"),
    "n_repeat_words": repeat_words,
}


# ---- rules ----------------------------------------------------------------------------------------------------------------------------------------


class Rule(NamedTuple):
    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]  # of the metrics it needs

    def on(self, text: str, given: Mapping[str, Column]) -> Column:
        """Whether the rule rejects a text; `given` has metrics that are columns already."""
        return self.rejects(*(given[m] if m in given else METRICS[m](text) for m in self.needs))


#: Base rules first: these two alone decide `base_failed`.
BASE = [Rule("few_words", ("n_words",), lambda n: n < 50), Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n)]
RULES = [
    *BASE,
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 15 * n)),
    Rule("letters", ("n_letters", "word_chars"), lambda x, c: 10 * x < 6 * c),
]


def profile(docs: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected) of each rule alone, from the raw text over a seeded sample of about `rows` documents. Each rule runs twice; the
    second run counts, less that of a rule without a metric."""
    sample = stored(docs.select(text).sample(fraction=min(1.0, rows / max(docs.count(), 1)), seed=42), "quality-sample")

    def timed(rejects: Column) -> tuple[float, float, int]:
        for _ in range(2):
            began = time.perf_counter()
            share, n = sample.agg(F.avg(rejects.cast("int")), F.count("*")).first()
        return time.perf_counter() - began, share or 0.0, n

    idle = timed(F.col(text).isNull())[0]
    found = []
    for r in rules:
        seconds, share, n = timed(r.on(text, {}))
        found.append((r, max(seconds - idle, 0.0) / max(n, 1), share))
    return found


def by_rejection_per_cost(found: list[tuple[Rule, float, float]]) -> list[Rule]:
    return [r for r, cost, share in sorted(found, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0].name))]


def first_rejection(rules: list[Rule], text: str = "text", given: Mapping[str, Column] = {}) -> Column:
    """The name of the first rule in the given order that rejects; null if none does. Later rules, and metrics not given, are not evaluated."""
    chain = F
    for r in rules:
        chain = chain.when(r.on(text, given), F.lit(r.name))
    return chain.otherwise(F.lit(None).cast("string"))


def cascade(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS, given: Mapping[str, Column] = {}) -> DataFrame:
    """docs with `rejected_by` (first rejecting rule in the estimated best order) and `kept`; `given` names metrics that are columns of docs."""
    order = by_rejection_per_cost(profile(docs, rules, text, rows))
    return docs.withColumn("rejected_by", first_rejection(order, text, given)).withColumn("kept", F.col("rejected_by").isNull())


#: What the registered query returns of every document, rejected or not.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), p AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS BIGINT) AS n_letters,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_letters < 6 * word_chars) AS kept
FROM m
"""


@query("op6_quality_rules", SQL)
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("*", *(METRICS[m]("text").alias(m) for m in REPORTED))
    given = {m: F.col(m) for m in REPORTED}
    base = BASE[0].on("text", given) | BASE[1].on("text", given)
    return cascade(docs, given=given).select("doc_id", *REPORTED, base.alias("base_failed"), "kept")
