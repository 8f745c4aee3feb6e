"""Column builders: bands, keys, hashing, rounding, calibration-safe arithmetic. All of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Band edges of burned area (acres), containment (percent) and staffing (people).
ACRE_EDGES = (100, 1000, 5000, 20000, 100000)
PCT_EDGES = (10, 30, 60, 90)
PERS_EDGES = (25, 75, 200, 500)
# Movement threshold and recall-risk sizes (acres).
MOVED = 0.1
RISK_HIGH, RISK_MODERATE = 100_000, 10_000


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing at the source; Spark would sort and average it, so it becomes NULL at ingest."""
    fix = {n: F.when(~F.isnan(n), F.col(n)) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df


def band(x: Column | str, edges: Sequence[float]) -> Column:
    """Right-open band number as text, ``unknown`` for a missing value."""
    x = c(x)
    out = F.when(x.isNull() | F.isnan(x), "unknown")
    for i, e in enumerate(edges):
        out = out.when(x < e, str(i))
    return out.otherwise(str(len(edges)))


def band_key(acres: Column | str, pct: Column | str, pers: Column | str) -> Column:
    """Composite three-band key, written ``area|containment|staffing``."""
    return F.concat_ws("|", band(acres, ACRE_EDGES), band(pct, PCT_EDGES), band(pers, PERS_EDGES))


def offset_bucket(seconds: Column | str) -> Column:
    """Six labels: before / after x up to 10 minutes, up to 25 minutes, more."""
    s = c(seconds)
    size = F.when(F.abs(s) <= 600, "0 to 10 min").when(F.abs(s) <= 1500, "10 to 25 min").otherwise("25 min or more")
    return F.concat_ws(" ", F.when(s > 0, "after").otherwise("before"), size)


def recall_risk(acres: Column | str) -> Column:
    a = c(acres)
    return F.when(a >= RISK_HIGH, "high").when(a >= RISK_MODERATE, "moderate").otherwise("low")


def canon_option(answer: Column | str, options: Column | str) -> Column:
    """The exact option, else the last option that matches after trimming and case folding, else NULL."""
    a, o = c(answer), c(options)
    folded = F.filter(o, lambda x: F.lower(F.trim(x)) == F.lower(F.trim(a)))
    return F.when(F.array_contains(o, a), a).when(F.size(folded) > 0, F.element_at(folded, -1))


def path_parts(path: Column | str) -> Column:
    """Struct (site, unit, burn_state, file) of a slash-separated archive path."""
    p = F.split(F.translate(c(path), "\\", "/"), "/")
    return F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("site", "unit", "burn_state"))], F.element_at(p, -1).alias("file"))


def event_key(sequence: Column | str) -> Column:
    """Text between the first and the last ``_`` field of a dated name (``20200101_Name_camera``), else the whole name."""
    s = c(sequence)
    inner = F.regexp_extract(s, r"^\d{8}_(.+)_[^_]+$", 1)
    return F.when(inner != "", inner).otherwise(s)


def incident_from_id(item_id: Column | str) -> Column:
    """Incident part of ``<prefix>-<incident>-<yyyy-mm-dd>``; NULL when the id does not end in a date."""
    v = F.regexp_extract(c(item_id), r"^[^-]+-(.+)-\d{4}-\d{2}-\d{2}$", 1)
    return F.when(v != "", v)


def block_key(lon: Column | str, lat: Column | str, day: Column | str, deg: float, unit: str = "month") -> Column:
    """Spatial cell and calendar unit, ``<cell x>/<cell y>@<period>``; NULL if any part is missing."""
    d = c(day)
    period = {
        "month": F.date_format(d, "yyyy-MM"),
        "quarter": F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")),
        "year": F.year(d).cast("string"),
    }[unit]
    cell = lambda x: F.floor(c(x) / F.lit(float(deg))).cast("string")
    return F.concat(cell(lon), F.lit("/"), cell(lat), F.lit("@"), period)


def sig_round(x: Column | str, digits: int) -> Column:
    """Round to significant figures through the decimal text form."""
    return F.format_string(f"%.{digits - 1}e", c(x)).cast("double")


def stable_fold(item_id: Column | str, k: int = 10) -> Column:
    """sha256(id) mod 10, exact without big integers: every power of 16 above the last digit is 6 modulo 10."""
    if k != 10:
        raise ValueError("the digit-sum identity holds for ten folds")
    h = F.sha2(c(item_id).cast("string"), 256)
    digits = F.transform(F.split(F.substring(h, 1, 63), ""), lambda x: F.conv(x, 16, 10).cast("int"))
    total = F.aggregate(digits, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return F.pmod(6 * total + F.conv(F.substring(h, 64, 1), 16, 10).cast("int"), F.lit(10)).cast("int")


def stable_seed(base: int, *parts: Column | str) -> Column:
    """(base + crc32('a|b|c')) modulo 2^32."""
    text = F.concat_ws("|", *[c(p).cast("string") for p in parts])
    return F.pmod(F.lit(base).cast("bigint") + F.crc32(text.cast("binary")), F.lit(4294967296))


HASH_DIGITS = 15
HASH_RANGE = float(16**HASH_DIGITS)


def hash_int(*parts: Column | str | int) -> Column:
    """First fifteen hex digits of md5('a|b|c') as a BIGINT below HASH_RANGE: the seeded uniform integer used for every draw."""
    cols = [F.lit(str(p)) if isinstance(p, int) else c(p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, HASH_DIGITS), 16, 10).cast("bigint")


def impute_score(prob: Column | str, call: Column | str) -> Column:
    """Probability, else the call as 1 / 0."""
    return F.coalesce(c(prob), c(call).cast("double"))


def impute_call(prob: Column | str, call: Column | str) -> Column:
    """Call as 1 / 0, else whether the probability reaches one half; NULL when both are missing."""
    return F.coalesce(c(call).cast("int"), (c(prob) >= 0.5).cast("int"))


def moved(y: Column | str, base: Column | str, thr: float = MOVED) -> Column:
    return F.abs(c(y) - c(base)) / F.greatest(c(base), F.lit(1.0)) > thr


def at_ceiling(value: Column | str, ceiling: float) -> Column:
    return F.abs(c(value) - ceiling) < 5e-4


def rule_table(qid: Column | str, rules: Mapping[str, Column]) -> Column:
    """Answer by question id from a table of column rules; NULL for an id without a rule."""
    items = list(rules.items())
    out = F.when(c(qid) == items[0][0], items[0][1])
    for k, v in items[1:]:
        out = out.when(c(qid) == k, v)
    return out


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first failing check in order; NULL when all hold. A check is true when the row is bad."""
    out = F.when(checks[0][1], checks[0][0])
    for name, bad in checks[1:]:
        out = out.when(bad, name)
    return out


def round_half_up(x: Column | str) -> Column:
    return F.floor(c(x) + 0.5)


def round_half_even(x: Column | str, digits: int = 0) -> Column:
    return F.bround(c(x), digits)


def shown(x: Column | str, digits: int = 2) -> Column:
    """The value a reader sees in a fixed-decimal display: half-even on the exact binary value, as C and Python print it.

    The JVM's formatter rounds the shortest decimal text instead (1.005 shows as 1.01). Here the value splits into a
    single-precision part and the rest, whose products with the scale are both exact, so the comparison with one half is too.
    """
    v, scale = c(x), 10.0**digits
    high = v.cast("float").cast("double")
    a, b = high * scale, (v - high) * scale
    base = F.floor(a + b).cast("double")
    over, under = a - base - 0.5, 0 - b
    k = F.when(over > under, base + 1).when(over < under, base).otherwise(F.when(F.pmod(base, F.lit(2.0)) == 0, base).otherwise(base + 1))
    return k / scale


def all_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)
