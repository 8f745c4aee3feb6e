r"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits, lower-cased. A fixed mask over consecutive tokens hashes the positions marked 1 and ignores those
marked 0. `SEEDS` is lossless for `WINDOW` tokens with `SUBSTITUTIONS` differing ones: wherever these fall, some mask fits between them, so
every overlap that counts has a common seed. Seeds of documents and benchmark items are joined on (mask, hash); around each hit, the windows
that hold the seed are compared token by token on the hit's diagonal, and a document is contaminated where a window has at most
`SUBSTITUTIONS` substituted tokens. Items shorter than a window must occur whole and unchanged (a solid mask of their own length); items of
fewer than `MIN_TOKENS` tokens are no evidence.

Defined results: null and empty texts match nothing; repeated documents are reported once per doc_id; repeated items once per item_id; a null
doc_id or item_id is a value like any other; an empty table on either side gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.llm import query
from scorefold.llm.common import small, stored, table

#: Any 13 tokens of which 2 differ hold a clean placement of one of these masks (tests/llm checks it by enumeration).
SEEDS = ["111111", "11001010011"]
WINDOW = 13
SUBSTITUTIONS = 2
MIN_TOKENS = 6
STRETCH = 256
#: Distinct seeds of the benchmark that may be broadcast: one long each, some 100 MB as a hash table.
SEED_ROWS = 2_500_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def stretches(texts: DataFrame, key: str, prefix: str) -> DataFrame:
    """Texts cut into stretches of `STRETCH` positions: id, k1 and k2 (hashes that name id and text), stretch (its number), n (tokens of the text), h (the
    token hashes of the stretch and of what a window may need on both sides), offset, from and to (its positions in h).

    A row carries a bounded number of tokens however long its text is."""
    c = lambda name: f"{prefix}_{name}"
    rows = texts.select(F.col(key).alias(f"{prefix}_id"), F.xxhash64("text").alias(c("k1")), F.xxhash64(F.lit(prefix), key, "text").alias(c("k2")), token_hashes(F.col("text")).alias("_d_h"))
    last = F.size("_d_h") - MIN_TOKENS

    def stretch(first):
        offset = F.greatest(F.lit(0), first - WINDOW + 1)
        end = F.least(F.size("_d_h"), first + STRETCH + 2 * WINDOW)
        stop = F.least(last, first + STRETCH - 1)
        return F.struct(offset.alias("offset"), (first - offset).alias("from"), (stop - offset).alias("to"), F.slice("_d_h", offset + 1, end - offset).alias("h"))

    cut = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(STRETCH)), stretch))
    rows = rows.select(c("id"), c("k1"), c("k2"), F.size("_d_h").alias(c("n")), F.posexplode(cut).alias(c("stretch"), "s"))
    return rows.select(*(c(x) for x in ("id", "k1", "k2", "stretch", "n")), F.col("s.h").alias(c("h")), F.col("s.offset").alias(c("offset")), F.col("s.from").alias(c("from")), F.col("s.to").alias(c("to")))


def seeded(rows: DataFrame, masks: list[str], prefix: str, *kept: str) -> DataFrame:
    """A narrow row per position and mask of the stretches: k1, k2, stretch, at (in the stretch), seed (of mask and tokens), mask (its number), and `kept`."""
    c = lambda name: f"{prefix}_{name}"
    h, at = F.col(c("h")), F.col(c("at"))
    each = [F.struct(F.lit(k).alias("mask"), F.when(at + len(m) <= F.size(h), F.xxhash64(F.lit(m), *(F.get(h, at + j) for j, bit in enumerate(m) if bit == "1"))).alias("seed")) for k, m in enumerate(masks)]
    out = rows.select(c("k1"), c("k2"), c("stretch"), *kept, h, F.explode(F.sequence(c("from"), c("to"))).alias(c("at")))
    out = out.select("*", F.explode(F.array(*each)).alias("s"))  # the stretch goes no further than the task that makes the seeds
    return out.select(c("k1"), c("k2"), c("stretch"), *kept, c("at"), "s.mask", "s.seed").where(F.col("seed").isNotNull())


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_token, last_token (of the document, over all matching windows), matching and share (equal tokens of the best
    window), windows (matching ones, counted once for each seed in them).

    What is joined at first are seeds alone, one long each; the tokens around a seed are fetched for hits only."""
    docs, items = docs.select("doc_id", "text"), benchmark.select("item_id", "text").distinct()
    lengths = items.select(F.size(tokens(F.col("text"))).alias("n")).where(F.col("n").between(MIN_TOKENS, WINDOW - 1)).distinct()
    solid = ["1" * n for (n,) in sorted(lengths.collect())]  # at most WINDOW - MIN_TOKENS rows
    masks = SEEDS + [m for m in solid if m not in SEEDS]
    spans = F.array(*(F.lit(len(m)) for m in masks))
    short = F.col("item_n") < WINDOW
    of_item = F.when(short, (F.get(spans, F.col("mask")) == F.col("item_n")) & ~F.col("mask").isin([k for k, m in enumerate(masks) if "0" in m])).otherwise(F.col("mask") < len(SEEDS))
    item_rows = stored(stretches(items, "item_id", "item"), "benchmark-stretches")
    item_seeds = stored(seeded(item_rows, masks, "item", "item_n").where(of_item), "benchmark-seeds")
    wanted = stored(item_seeds.select("seed").distinct(), "benchmark-seed-set")
    met = stored(seeded(stretches(docs, "doc_id", "doc"), masks, "doc").drop("mask").join(small(wanted, SEED_ROWS), "seed", "left_semi").distinct(), "decontamination-met")
    pairs = met.join(small(item_seeds.drop("item_n")), "seed")
    # the tokens of documents and items around the hits
    touched = stored(met.select("doc_k1", "doc_k2").distinct(), "decontamination-touched")
    named = docs.withColumns({"_d_k1": F.xxhash64("text"), "_d_k2": F.xxhash64(F.lit("doc"), "doc_id", "text")})
    own = named.join(small(touched), (F.col("_d_k1") == F.col("doc_k1")) & (F.col("_d_k2") == F.col("doc_k2")), "left_semi").select("doc_id", "text")
    doc_rows = stretches(own, "doc_id", "doc").dropDuplicates(["doc_k1", "doc_k2", "doc_stretch"])
    hits = pairs.join(stored(doc_rows, "decontamination-stretches"), ["doc_k1", "doc_k2", "doc_stretch"]).join(item_rows, ["item_k1", "item_k2", "item_stretch"])
    hits = hits.withColumn("span", F.get(spans, F.col("mask")))
    # a number for each hit keeps the verification above the joins, which then run compiled and hand on hits only
    hits = hits.withColumn("_d_hit", F.monotonically_increasing_id())
    # windows that hold the seed start, counted in the item's stretch, from item_at - (width - span) to item_at, and stay inside both texts
    hits = hits.withColumns({"_d_width": F.least(F.lit(WINDOW), F.col("item_n")), "_d_diagonal": F.col("doc_at") - F.col("item_at")})
    allowed = F.when(short, F.lit(0)).otherwise(F.lit(SUBSTITUTIONS))
    low = F.greatest(F.lit(0), F.col("item_at") + F.col("span") - F.col("_d_width"), -F.col("_d_diagonal"))
    high = F.least(F.col("item_at"), F.size("item_h") - F.col("_d_width"), F.size("doc_h") - F.col("_d_width") - F.col("_d_diagonal"))
    equal = lambda s: F.size(F.filter(F.sequence(F.lit(0), F.col("_d_width") - 1), lambda k: F.get("item_h", s + k) == F.get("doc_h", s + k + F.col("_d_diagonal"))))
    found = F.when(low <= high, F.transform(F.sequence(low, high), lambda s: F.struct(equal(s).alias("n"), (s + F.col("_d_diagonal") + F.col("doc_offset")).alias("at"))))
    hits = hits.select("doc_id", "item_id", "_d_hit", "_d_width", F.filter(found, lambda x: x["n"] >= F.col("_d_width") - allowed).alias("_d_found")).where(F.size("_d_found") > 0)
    rows = hits.select("doc_id", "item_id", "_d_hit", "_d_width", F.explode("_d_found").alias("_d_w"))
    return rows.groupBy("doc_id", "item_id").agg(
        F.min("_d_w.at").alias("first_token"),
        F.max(F.col("_d_w.at") + F.col("_d_width") - 1).alias("last_token"),
        F.max("_d_w.n").alias("matching"),
        F.max(F.col("_d_w.n") / F.col("_d_width")).alias("share"),
        F.sum((F.col("_d_hit") >= 0).cast("bigint")).alias("windows"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id has an overlap with the benchmark."""
    bad = stored(overlaps(docs, benchmark).select(F.col("doc_id").alias("_d_bad")).distinct(), "contaminated")
    return docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col("_d_bad")), "left_anti")


@query("op4_benchmark_decontamination")
def op4(spark, sf_dir):
    return overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
