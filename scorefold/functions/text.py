"""Text columns: parsing answers, scoring them under typed tolerances, flags on logged text. Built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorefold.functions.columns import c, shown

# Answer line, numbers with thousands commas, characters trimmed around a stated answer.
ANSWER_LINE = r"(?im)^\s*ANSWER\s*:\s*(.+)$"
ANSWER_ANY = r"(?i)ANSWER\s*:\s*(.+)"
NUMBER = r"[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[-+]?\d+(?:\.\d+)?"
TRIM_CHARS = " \t\n\r'\"`.:;,*()[]{}"
# Statement keywords a logged query must not contain.
FORBIDDEN_SQL = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "ATTACH", "DETACH", "PRAGMA", "VACUUM", "REPLACE", "REINDEX")
# Comments and quoted literals of a logged query, in scan order.
SQL_NOISE = r"""--[^\r\n]*|/\*[\s\S]*?(?:\*/|$)|'(?:[^']|'')*'?|"(?:[^"]|"")*"?"""
# Words that name a time of day or elapsed time.
TIME_OF_DAY = r"(?i)\b(dawn|morning|noon|afternoon|evening|dusk)\b"
# Words that name elapsed time or a clock, a clock reading, a date and an epoch; local hours [from, to) of a time-of-day word.
ELAPSED = (
    r"(?i)\b(?:minutes?|mins?|hours?|hrs?|seconds?|timestamps?|clock|o'clock|elapsed|time|times|date|dated|epoch|a\.?m\.?|p\.?m\.?|utc|pst|pdt|overlay)\b"
)
CLOCK_OR_DATE = r"\b\d{1,2}:\d{2}\b|\b20\d\d-\d\d-\d\d\b|\b1[67]\d{8}\b"
HOURS = {"dawn": (0, 12), "morning": (0, 12), "noon": (11, 13), "afternoon": (12, 24), "evening": (12, 24), "dusk": (12, 24)}


def nonempty(x: Column) -> Column:
    return F.when(x != "", x)


def strip_chars(x: Column, chars: str = TRIM_CHARS) -> Column:
    return F.trim(x, F.lit(chars))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def numbers(text: Column) -> Column:
    """All numbers of a text, thousands commas removed, as doubles in reading order."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").cast("double"))


def last_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.try_element_at(lines, F.lit(-1))


def parse_number_answer(raw: Column | str, field: str = "personnel") -> Column:
    """Value of the JSON field, else the first integer once commas are removed."""
    t = c(raw)
    named = nonempty(F.regexp_extract(t, f'"{field}"\\s*:\\s*(-?[\\d.]+)', 1))
    loose = nonempty(F.regexp_extract(F.regexp_replace(t, ",", ""), r"(-?\d+)", 1))
    return F.coalesce(named, loose).try_cast("double")


def parse_bool_answer(raw: Column | str, field: str = "smoke") -> Column:
    """JSON boolean, else a leading no or ``no <field>`` is false, else a mention of the field is true."""
    t = F.lower(F.trim(c(raw)))
    named = nonempty(F.regexp_extract(t, f'"{field}"\\s*:\\s*(true|false)', 1))
    loose = F.when(t.rlike(rf"no {field}") | t.rlike(r"^no\b"), 0).when(t.rlike(field), 1)
    return F.coalesce((named == "true").cast("int"), loose)


def parse_prob_call(raw: Column | str) -> Column:
    """Struct (probability, call) from two independent patterns."""
    t = c(raw)
    p = nonempty(F.regexp_extract(t, r'"probability"\s*:\s*([0-9]*\.?[0-9]+)', 1)).try_cast("double")
    f = nonempty(F.lower(F.regexp_extract(t, r'(?i)"fire"\s*:\s*(true|false)', 1)))
    return F.struct(p.alias("probability"), (f == "true").cast("int").alias("call"))


def norm_text(x: Column | str, keep: str = "A-Z0-9", upper: bool = True) -> Column:
    """Fold case, turn every other character into a space, collapse spaces."""
    folded = F.upper(c(x)) if upper else F.lower(c(x))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, f"[^{keep}]", " "), r"\s+", " "))


def parse_typed_answer(raw: Column | str, kind: Column | str, options: Column | str) -> Column:
    """Struct (num, txt, abstained, failure) of a stated answer of type integer / acres / percent / categorical / string.

    The last ``ANSWER:`` line wins. Numbers: first of that line, or last of free text. Categories: exact option, then the
    longest option named as a word, else the cleaned text. ``unknown`` abstains.
    """
    t, k, opts = F.trim(c(raw)), c(kind), c(options)
    cand = F.trim(F.coalesce(last_match(t, ANSWER_LINE), last_match(t, ANSWER_ANY)))
    blank = t.isNull() | (t == "")
    says_unknown = F.lower(F.regexp_replace(F.coalesce(cand, F.when(F.lower(t) == "unknown", t)), r"[^\p{L}\p{N}_]", "")) == "unknown"
    source = F.coalesce(cand, t)
    nums = numbers(F.when(k == "percent", F.regexp_replace(source, "%", " ")).otherwise(source))
    num = F.when(cand.isNotNull(), F.get(nums, F.lit(0))).otherwise(F.try_element_at(nums, F.lit(-1)))
    num = F.when(k == "integer", F.bround(num, 0)).otherwise(num)
    target = F.coalesce(cand, last_line(t))
    cleaned = strip_chars(target)
    exact = F.filter(opts, lambda o: F.lower(o) == F.lower(cleaned))
    pattern = lambda o: F.concat(F.lit(r"(?i)(?<!\w)\Q"), o, F.lit(r"\E(?!\w)"))
    named = F.filter(opts, lambda o: F.rlike(target, pattern(o)))
    longest = F.array_sort(F.transform(named, lambda o, i: F.struct((0 - F.length(o)).alias("l"), i.alias("i"), o.alias("o"))))
    category = F.coalesce(F.get(exact, F.lit(0)), F.get(longest, F.lit(0))["o"], cleaned)
    numeric = k.isin("integer", "acres", "percent")
    txt = F.when(k == "categorical", category).otherwise(cleaned)
    empty = F.when(numeric, num.isNull()).otherwise(cleaned.isNull() | (cleaned == ""))
    says_unknown = F.coalesce(says_unknown, F.lit(False)) | F.coalesce(~numeric & (F.lower(cleaned) == "unknown"), F.lit(False))
    ok = ~blank & ~says_unknown
    return F.struct(
        F.when(ok & numeric, num).alias("num"),
        F.when(~blank & says_unknown, "unknown").when(ok & ~numeric & ~empty, txt).alias("txt"),
        (~blank & says_unknown).cast("int").alias("abstained"),
        F.when(blank, "parse").when(~says_unknown & empty, "parse").alias("failure"),
    )


CHOICE_KEEP = r"a-z0-9%<>.\- "


def parse_choice(raw: Column | str, options: Column | str) -> Column:
    """Struct (choice, score, failure) from a JSON answer with an applicability score clamped to [0, 1].

    Exact normalised option, else the unique longest option contained in the answer; with no answer field at all, the only
    option the free text names.
    """
    t, opts = c(raw), c(options)
    body = nonempty(F.regexp_extract(t, r"(?s)(\{.*\})", 1))
    answer = F.coalesce(F.get_json_object(body, "$.answer"), nonempty(F.regexp_extract(t, r'"answer"\s*:\s*"([^"]*)"', 1)))
    score = F.coalesce(F.get_json_object(body, "$.applicability_score"), nonempty(F.regexp_extract(t, r'"applicability_score"\s*:\s*([0-9.]+)', 1)))
    value = score.try_cast("double")
    score = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    n = lambda x: norm_text(x, CHOICE_KEEP, upper=False)
    na, low = n(answer), n(t)
    exact = F.filter(opts, lambda o: n(o) == na)
    inside = F.filter(opts, lambda o: (n(o) != "") & F.contains(na, n(o)))
    ordered = F.array_sort(F.transform(inside, lambda o, i: F.struct((0 - F.length(o)).alias("l"), i.alias("i"), o.alias("o"))))
    unique = F.when((F.size(ordered) == 1) | (F.get(ordered, F.lit(0))["l"] < F.get(ordered, F.lit(1))["l"]), F.get(ordered, F.lit(0))["o"])
    named = F.filter(opts, lambda o: (n(o) != "") & F.rlike(low, F.concat(F.lit(r"(?<![a-z0-9])\Q"), n(o), F.lit(r"\E(?![a-z0-9])"))))
    free = F.when(F.size(named) == 1, F.get(named, F.lit(0)))
    choice = F.when(answer.isNotNull(), F.coalesce(F.get(exact, F.lit(0)), unique)).otherwise(free)
    failure = F.when(t.isNull() | (t == ""), "empty").when(choice.isNull(), F.when(answer.isNotNull(), "no_option").otherwise("no_json"))
    return F.struct(choice.alias("choice"), score.alias("score"), failure.alias("failure"))


def score_answer(rule: Column | str, gold_num: Column | str, gold_txt: Column | str, num: Column | str, txt: Column | str,
                 rel_tol: Column | str, abs_floor: Column | str, abs_tol: Column | str) -> Column:
    """1 when the prediction meets the item's tolerance rule, else 0 (a missing prediction is wrong)."""
    r, g, p = c(rule), c(gold_num), c(num)
    gt, pt = c(gold_txt), c(txt)
    hit = (
        F.when(r == "exact_int", F.bround(p, 0) == g)
        .when(r == "relative", F.abs(p - g) <= F.greatest(c(rel_tol) * F.abs(g), c(abs_floor)))
        .when(r == "absolute", F.abs(p - g) <= c(abs_tol))
        .when(r == "categorical_exact", F.lower(F.trim(pt)) == F.lower(F.trim(gt)))
        .when(r == "string_normalized", norm_text(pt) == norm_text(gt))
    )
    return F.coalesce(hit.cast("int"), F.lit(0))


def perturb(rule: Column | str, gold: Column | str, rel_tol: Column | str, abs_floor: Column | str, abs_tol: Column | str) -> Column:
    """The answer moved outside its own tolerance: a negative control."""
    r, g = c(rule), c(gold)
    return (
        F.when(r == "exact_int", F.bround(g, 0) + 2)
        .when(r == "relative", g + 2.5 * F.greatest(c(rel_tol) * F.abs(g), c(abs_floor)))
        .when(r == "absolute", g + 2.5 * c(abs_tol))
        .otherwise(g)
    )


# --- flags on logged text ---------------------------------------------------------------------------------------------
def sql_log_flags(sql: Column | str) -> Column:
    """Struct (empty, first_word, forbidden, several) of a logged query after comments and literals are removed."""
    bare = F.regexp_replace(F.coalesce(c(sql), F.lit("")), SQL_NOISE, " ")
    tokens = F.regexp_extract_all(F.upper(bare), F.lit(r"\w+"), F.lit(0))
    return F.struct(
        (F.size(tokens) == 0).cast("int").alias("empty"),
        F.coalesce(F.get(tokens, F.lit(0)), F.lit("")).alias("first_word"),
        F.array_join(F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(x) for x in FORBIDDEN_SQL]))), ",").alias("forbidden"),
        bare.rlike(r";[\s;]*[^\s;]").cast("int").alias("several"),
    )


def used_column(sqls: Column | str, name: str) -> Column:
    """Whether any of the logged queries mentions the column as a word."""
    return F.exists(c(sqls), lambda s: s.rlike(rf"(?i)\b{name}\b"))


def code_like(raw: Column | str) -> Column:
    return F.coalesce(c(raw).rlike(r"(?i)```|\bselect\b.+\bfrom\b|\bdef \w+\(|\bimport \w+"), F.lit(False))


def body_complete(raw: Column | str) -> Column:
    """Does the text look finished: balanced braces and brackets without the code fence, and a closing character."""
    s = F.trim(F.regexp_replace(c(raw), r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    count = lambda ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    ok = (s != "") & (count("{") == count("}")) & (count("[") == count("]")) & s.rlike(r'[}\]".]$')
    return F.coalesce(ok, F.lit(False))


def reached_format(raw: Column | str, patterns: Sequence[str]) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & F.coalesce(c(raw).rlike("(?i)" + p), F.lit(False))
    return out


def tokens(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def jaccard_tokens(a: Column | str, b: Column | str) -> Column:
    """Struct (jaccard, recall): overlap of the two token sets, and the share of a's tokens found in b."""
    ta, tb = tokens(a), tokens(b)
    both, any_ = F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb))
    return F.struct(F.when(any_ > 0, both / any_).alias("jaccard"), F.when(F.size(ta) > 0, both / F.size(ta)).alias("recall"))


def entity_hits(text: Column | str, names: Sequence[str]) -> Column:
    """Identifier names that occur as words (case-sensitive)."""
    words = F.regexp_extract_all(c(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_intersect(F.array(*[F.lit(n) for n in names]), words)


def probe_counts(text: Column | str, words: Sequence[str]) -> dict[str, Column]:
    """Number of occurrences of each literal word in the text."""
    t = c(text)
    return {w: ((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w)).cast("bigint") for w in words}


def time_words(raw: Column | str, taken: Column | str, tz: str = "America/Los_Angeles") -> Column:
    """Struct (elapsed, words, fits): whether elapsed time, a clock, a date or an epoch is named, the time-of-day words, and whether each
    fits the local capture hour."""
    t = F.coalesce(c(raw), F.lit(""))
    words = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(TIME_OF_DAY), F.lit(1)), lambda w: F.lower(w))))
    h = F.hour(F.from_utc_timestamp(c(taken), tz))
    bound = lambda w, i: F.element_at(F.create_map(*[F.lit(v) for k, b in HOURS.items() for v in (k, b[i])]), w)
    ok = lambda w: (h >= bound(w, 0)) & (h < bound(w, 1))
    return F.struct(
        (t.rlike(ELAPSED) | t.rlike(CLOCK_OR_DATE)).cast("int").alias("elapsed"), F.array_join(words, ",").alias("words"),
        F.when(F.size(words) > 0, F.forall(words, ok).cast("int")).alias("fits"),
    )


# --- prompts and redaction --------------------------------------------------------------------------------------------
def render_lines(pairs: Sequence[tuple[str, Column]], title: Column, question: Column, layout: str = "list") -> Column:
    """A prompt from labelled values. Layouts: ``list`` (one per line), ``table`` (label | value), ``prose`` (one line)."""
    shown = [(k, F.coalesce(v.cast("string"), F.lit("none recorded"))) for k, v in pairs]
    if layout == "list":
        body = [F.concat(F.lit(f"- {k}: "), v) for k, v in shown]
        return F.concat_ws("\n", title, *body, question)
    if layout == "table":
        return F.concat_ws("\n", title, *[F.concat(F.lit(f"{k} | "), v) for k, v in shown], question)
    return F.concat_ws(" ", title, F.concat_ws("; ", *[F.concat(F.lit(f"{k} is "), v) for k, v in shown]), question)


def grounding_lines(draws: Column | str) -> Column:
    """Text block of displayed analogues (array of structs today, next): one line each with the two-decimal ratio."""
    d = c(draws)
    line = lambda r: F.format_string("- %.0f -> %.0f (ratio %.2f)", shown(r["today"], 0), shown(r["next"], 0), shown(r["next"] / F.greatest(r["today"], F.lit(1.0))))
    return F.when(F.size(d) > 0, F.array_join(F.transform(d, line), "\n")).otherwise(F.lit("none matched"))


def redact(text: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered literal replacements."""
    out = c(text)
    for old, new in rules:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out
