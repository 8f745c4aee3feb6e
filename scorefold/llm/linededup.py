r"""Line deduplication by winnowing over line hashes.

Units are the lines (split at \n, trimmed) that hold a word. A window is the shortest run of consecutive units that has `min_lines` lines or
`min_words` words, so a long line is a window by itself. Each window selects its smallest line hash (the rightmost on ties) as fingerprint:
two texts that share a window share that fingerprint, which is the guarantee of winnowing. Fingerprints met once in the corpus are dropped;
around the others, all windows that selected them are compared by content. The first occurrence of a window, by (doc_id, text, line), stays; the
lines of every later one are deleted, and overlapping windows add up to runs.

Matches are then extended both ways to their ends, so that what is deleted does not depend on the hashes: a line goes if and only if it lies in any
run of at least `min_lines` lines or `min_words` words that occurs earlier. To the left the windows themselves reach the start of the run; to the
right what they miss begins less than `min_lines` lines before the end, so windows prolonged up to `min_lines` lines reach it. A prolonged window
repeats only where its window does, so only windows that met are prolonged.

Defined results: null, blank and short texts (no full window) stay as they are; blank lines stay; rows with the same doc_id and text are one
document, all kept alike; a document of which no word is left goes; an empty table gives no rows; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.llm import query
from scorefold.llm.common import GAPS, SPACES, let, stored, table

MIN_LINES = 3
MIN_WORDS = 50


def windows(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per window: doc_id, text_key, start, lines, the fingerprint it selects (anchor position and hash), and
    `runs`: lines and 128 bits of the content of the window and of its prolongations, line by line, up to min_lines lines."""
    trimmed = lambda x: F.btrim(x, F.lit(SPACES))
    units = F.filter(F.transform(F.split("text", "\n"), trimmed), lambda x: x != "")
    df = docs.select("doc_id", F.xxhash64("text").alias("text_key"), units.alias("u"))
    df = df.select(
        "doc_id",
        "text_key",
        F.transform("u", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("u", lambda x: F.xxhash64(F.lit("b"), x)).alias("b"),
        F.transform("u", lambda x: F.size(F.split(x, GAPS))).alias("c"),
    )
    rows = df.select("*", F.posexplode_outer("c").alias("start", "_n"))  # outer: no filter that would split the text once more
    # the window ends at the first line that brings it to min_lines lines or min_words words
    total, reached = F.col("_n"), F.lit(None).cast("int")
    sizes = []
    for k in range(min_lines):
        sizes.append(F.when(F.lit(k + 1 == min_lines) | (total >= min_words), F.lit(k + 1)))
        total = total + F.coalesce(F.get("c", F.col("start") + k + 1), F.lit(0))
    reached = F.coalesce(*sizes)
    rows = rows.withColumn("lines", reached).where(F.col("start") + F.col("lines") <= F.size("c"))
    part = lambda c: F.slice(c, F.col("start") + 1, F.col("lines"))
    low = F.array_min(part("a"))
    back = F.array_position(F.reverse(part("a")), low).cast("int")  # 1: the last line of the window
    key = lambda c, n: F.xxhash64(F.slice(c, F.col("start") + 1, F.lit(n)))
    fits = lambda n: (F.col("lines") < n) & (F.col("start") + n <= F.size("c"))
    own = F.struct(F.col("lines"), F.xxhash64(part("a")).alias("k1"), F.xxhash64(part("b")).alias("k2"))
    longer = [F.when(fits(n), F.struct(F.lit(n).alias("lines"), key("a", n).alias("k1"), key("b", n).alias("k2"))) for n in range(2, min_lines + 1)]
    return rows.select(
        "doc_id",
        "text_key",
        "start",
        "lines",
        (F.col("start") + F.col("lines") - back).alias("anchor_at"),
        low.alias("anchor"),
        F.array_compact(F.array(own, *longer)).alias("runs"),
    )


def repeated_windows(found: DataFrame) -> DataFrame:
    """The windows and prolonged windows (doc_id, text_key, start, lines) whose content occurs earlier in the corpus."""
    place = ["doc_id", "text_key", "start"]
    fingerprints = found.select("anchor", "doc_id", "text_key", "anchor_at").groupBy("anchor", "doc_id", "text_key", "anchor_at").agg(F.lit(1).alias("one"))
    shared = fingerprints.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    met = stored(found.join(stored(shared, "line-shared"), "anchor", "left_semi"), "line-met")  # stored, so that hot keys of the joins can be split
    met = stored(met.select(*place, F.explode("runs").alias("w")).select(*place, "w.*"), "line-runs")
    firsts = met.groupBy("k1", "k2").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", "first")
    return met.join(stored(firsts, "line-firsts"), ["k1", "k2"]).where(F.struct(*place) > F.col("first")).select("doc_id", "text_key", "start", "lines")


def _has_word(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES)) != ""


def _without(lines: Column, gone: Column) -> Column:
    """The lines joined, less the units of the given numbers: the stretches between deleted lines. Each array is made once per row."""
    units = F.filter(F.transform(lines, lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull())
    dead = let(units, lambda u: F.sort_array(F.transform(gone, lambda g: F.get(u, g))))
    ends = F.concat(F.array(F.lit(-1)), dead, F.array(F.size(lines)))
    stretches = lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: F.slice(lines, F.get(e, k) + 2, F.get(e, k + 1) - F.get(e, k) - 1))
    return F.array_join(F.flatten(let(ends, stretches)), "\n")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `text` less its later repeated runs and `_deleted_lines`, their number; documents left without a word are gone."""
    found = stored(windows(docs, min_lines, min_words), "line-windows")
    gone = repeated_windows(found).groupBy(F.col("doc_id").alias("_l_id"), F.col("text_key").alias("_l_key")).agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("lines") - 1)))).alias("_l_gone"))
    df = docs.withColumn("_l_at", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("_l_id")) & (F.col("_l_at") == F.col("_l_key")), "left")
    kept = F.when(F.col("_l_gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), lambda lines: _without(lines, F.col("_l_gone"))))
    out = df.withColumn("_l_text", kept).where(F.col("_l_gone").isNull() | _has_word(F.col("_l_text")))
    names = [F.col("_l_text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names, F.coalesce(F.size("_l_gone"), F.lit(0)).alias("_deleted_lines"))


#: Of a window and its prolongations the twin keeps each run of one to three lines that has three lines or 50 words.
SQL = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d
), u AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, len(regexp_split_to_array(line, '[\x20\x09-\x0D]+')) AS c FROM u
), x AS (
  SELECT doc_id, k, c, line, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3, lead(c, 1) OVER w AS c2 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), runs AS (
  SELECT doc_id, k, 1 AS lines, line AS content FROM x WHERE c >= 50
  UNION ALL SELECT doc_id, k, 2, line || chr(10) || line2 FROM x WHERE c + c2 >= 50
  UNION ALL SELECT doc_id, k, 3, line || chr(10) || line2 || chr(10) || line3 FROM x WHERE line3 IS NOT NULL
), later AS (
  SELECT doc_id, k, lines FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, k) AS r FROM runs) WHERE r > 1
), dead AS (
  SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(k, k + lines)) AS k FROM later)
), live AS (
  SELECT l.doc_id, l.pos, l.line FROM l LEFT JOIN n USING (doc_id, pos) LEFT JOIN dead ON dead.doc_id = n.doc_id AND dead.k = n.k WHERE dead.k IS NULL
), t AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM live GROUP BY doc_id
), cut AS (
  SELECT doc_id, count(*) AS n FROM dead GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN cut.n IS NULL THEN d.text ELSE t.text END AS text, CAST(coalesce(cut.n, 0) AS INTEGER) AS deleted_lines
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN cut USING (doc_id)
WHERE cut.n IS NULL OR regexp_matches(t.text, '[^\x20\x09-\x0D]')
"""


@query("op10_line_dedup", SQL)
def op10(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_deleted_lines").alias("deleted_lines"))
