r"""Near-duplicate documents by SimHash and pivot distance tables.

A document's fingerprint has 64 bits; a bit is 1 where more than half of the XXH64 hashes of its three-word shingles have it set. Documents
whose fingerprints differ in at most `MAX_BITS` bits are linked, and components of links are near-duplicate groups.

Links are found on distinct fingerprints only. The 64 bits are cut into six blocks, and for each block the Hamming distances to `PIVOTS`
reference fingerprints are tabled. A distance to a pivot changes by no more than the bits that change, so the largest coordinate differences
of the blocks add up to no more than the distance of two fingerprints: at `MAX_BITS` = 3 differing bits, three blocks at least have equal
coordinates. For each choice of three blocks (20), fingerprints meet on those coordinates; a pair is discarded when the largest coordinate
differences of all blocks add up to over `MAX_BITS`, and the rest are verified bit by bit. Nothing is lost and nothing is capped.

Large meetings: the smallest fingerprint of each meeting is one more pivot. What lies within `MAX_BITS` of it is linked to it by one row;
only fingerprints farther from it are paired with the others, again only where their distances to it differ by `MAX_BITS` or less.

Defined results: null and wordless texts have fingerprint zero and are linked like others; texts of one or two words are one shingle;
repeated rows stay, each with its result; a null doc_id counts only where a component has no other id; an empty table gives no rows;
further columns are not looked at by `near_duplicates` and pass through `drop_near_duplicates`.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import query
from scorefold.llm.common import ship, small, stored, table

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: (first bit, bits) of the six blocks.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Reference fingerprints, and the bits that one coordinate takes (a block distance is at most 11).
PIVOTS = 12
COORDINATE_BITS = 4
CHUNK = 1 << 16

ship(__name__)


def fingerprint(text: str | None) -> int:
    """The 64 bits as a signed long."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: lowers A-Z, splits at space and U+0009-U+000D
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    line = b" ".join(words)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    lo, hi = starts[:n].tolist(), (starts[size : size + n] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for c in range(0, n, CHUNK):
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(lo[c : c + CHUNK], hi[c : c + CHUNK])), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp."""

    @F.pandas_udf("bigint")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(fingerprint, text), np.int64, len(text)))

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), of("text").alias("fp"))


def pivots() -> list[int]:
    """Reference fingerprints from a fixed generator, as signed longs; the first is zero."""
    drawn = np.random.default_rng(64).integers(-(2**63), 2**63 - 1, PIVOTS - 1, dtype=np.int64)
    return [0, *map(int, drawn)]


def _block(i: int) -> int:
    at, bits = BLOCKS[i]
    mask = ((1 << bits) - 1) << at
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def pivot_table(rows: DataFrame) -> DataFrame:
    """The rows with the packed distances of each block of `fp` to all pivots (b0 to b5)."""
    refs = pivots()

    def packed(i):
        out = F.lit(0).cast("bigint")
        for k, p in enumerate(refs):
            far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(p).cast("bigint")).bitwiseAND(F.lit(_block(i)).cast("bigint"))).cast("bigint")
            out = out.bitwiseOR(F.shiftleft(far, COORDINATE_BITS * k))
        return out

    return rows.withColumns({f"b{i}": packed(i) for i in range(len(BLOCKS))})


def _largest_difference(x, y):
    """The largest coordinate difference of two packed rows of the table."""
    mask = (1 << COORDINATE_BITS) - 1
    part = lambda c, k: F.shiftright(c, COORDINATE_BITS * k).bitwiseAND(F.lit(mask).cast("bigint"))
    return F.greatest(*(F.abs(part(x, k) - part(y, k)) for k in range(PIVOTS)))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: enough of the pairs of fingerprints within MAX_BITS to connect all that such pairs connect."""
    coordinates = [f"b{i}" for i in range(len(BLOCKS))]
    far = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    choices = [F.struct(F.lit(n).alias("choice"), F.xxhash64(*(coordinates[i] for i in c)).alias("key")) for n, c in enumerate(itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS))]
    keyed = pivot_table(distinct.select("fp")).select("fp", F.explode(F.array(*choices)).alias("m")).select("m.choice", "m.key", "fp")
    met = stored(keyed.groupBy("choice", "key").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"), "pivot-met")
    rows = stored(keyed.join(small(met), ["choice", "key"]).withColumn("from_low", far("fp", "low")), "pivot-rows")
    rows = pivot_table(rows)  # coordinates are made anew from a fingerprint where two have met: cheaper than to shuffle them
    near = rows.where((F.col("fp") != F.col("low")) & (F.col("from_low") <= MAX_BITS)).select(F.col("low").alias("a"), F.col("fp").alias("b"))
    away = rows.where(F.col("from_low") > MAX_BITS)
    other = rows.where(F.col("fp") != F.col("low")).select("choice", "key", F.col("fp").alias("fp2"), F.col("from_low").alias("from_low2"), *(F.col(c).alias(f"{c}_2") for c in coordinates))
    # each pair once: two far ones by order, a far and a near one from the far side
    once = (F.col("fp") != F.col("fp2")) & ((F.col("fp") < F.col("fp2")) | (F.col("from_low2") <= MAX_BITS))
    pairs = away.join(other, ["choice", "key"]).where(once & (F.abs(F.col("from_low") - F.col("from_low2")) <= MAX_BITS))
    total = _largest_difference(F.col("b0"), F.col("b0_2"))
    for c in coordinates[1:]:
        total = total + _largest_difference(F.col(c), F.col(f"{c}_2"))
    pairs = pairs.where((total <= MAX_BITS) & (far("fp", "fp2") <= MAX_BITS))
    found = near.unionByName(pairs.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its component.

    Rounds of neighbour minima and pointer halving over written tables, until no label changes; the number of rounds grows with the logarithm
    of a component's diameter.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        # the smallest label among a node's neighbours goes to the node and to the node's present root
        seen = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("offered")), "b").join(label.select(F.col("node").alias("a"), F.col("root").alias("present")), "a")
        better = seen.where("offered < present")
        offers = better.select(F.col("a").alias("node"), "offered").unionByName(better.select(F.col("present").alias("node"), "offered"))
        best = offers.groupBy("node").agg(F.min("offered").alias("offered"))
        moved = stored(label.join(best, "node", "left").select("node", F.least("root", F.coalesce("offered", F.col("root"))).alias("root"), F.col("offered").isNotNull().alias("changed")), "labels")
        up = moved.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        label = stored(moved.join(up, "root", "left").select("node", F.least("root", F.coalesce("higher", F.col("root"))).alias("root")), "labels")
        if not moved.where("changed").limit(1).count():
            return label


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp, root (a fingerprint that names the component), component_id (its smallest doc_id) for every row of docs."""
    prints = stored(fingerprints(docs), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "distinct-fingerprints")
    roots = components(links(distinct))
    of_fp = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    of_fp = stored(of_fp, "roots")
    ids = of_fp.groupBy("root").agg(F.min("smallest").alias("component_id"))
    answer = stored(of_fp.join(ids, "root").select("fp", "root", "component_id"), "fp-components")
    return prints.join(answer, "fp")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id (null last), then the smallest text hash; of repeated rows, one.

    Columns stay as they are."""
    found = stored(near_duplicates(docs.select("doc_id", "text")), "near-duplicates")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("k"))
    keep = stored(first.select(F.col("k.doc_id").alias("_s_id"), F.col("k.text_key").alias("_s_key")), "kept-documents")
    rows = docs.withColumn("_s_at", F.xxhash64("text"))
    one = rows.join(small(keep), F.col("doc_id").eqNullSafe(F.col("_s_id")) & (F.col("_s_at") == F.col("_s_key")), "left_semi")
    again = found.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    return (one.dropDuplicates(["doc_id", "_s_at"]) if again else one).drop("_s_at")


@query("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
