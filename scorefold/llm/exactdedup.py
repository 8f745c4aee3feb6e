r"""Exact duplicates by content sort.

Texts are compared without their whitespace. Rows are range-partitioned by content with sampled splitters, sorted externally inside each partition,
and every row is compared with its neighbour above over the whole normalised text; neighbours that are equal form a run.

*Splitters* are the first `HEAD` bytes of the normalised text, its digest and the row's number, so the sample that Spark takes for them stays small
however long texts are. The digest splits texts that begin alike, the number splits copies of one text: neither a common beginning nor a third of all
rows being one text makes a partition large. Equal texts have equal digests, so they stand side by side.

*Runs over a partition's end.* Each partition also hands out its first and last text. The last text of one and the first of the next are compared in
full, and runs that continue are chained; this is one or two rows for each partition. A run inside a partition is bounded by the partition.

Of equal texts the row with the most code points in the original text stays, then the smallest doc_id (null last), then one of the repeated rows.

Defined results: null texts are empty; empty and blank texts are equal to each other; rows with the same doc_id are rows each, of which one stays;
an empty table gives no rows; texts of any length are compared whole; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from scorefold.llm import query
from scorefold.llm.common import SPACES, ship, small, stored, table

#: Bytes of the normalised text in a splitter.
HEAD = 32

ship(__name__)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (nth, doc_id, points, mark, body) -> rows with their partition and run; the first and the last row also bring their text."""
    part, run, last, held = TaskContext.get().partitionId(), 0, None, None
    for b in batches:
        if not b.num_rows:
            continue
        body = b.column("body")
        fresh = [last is None or body[0] != last]
        starts = pc.invert(pc.equal(body.slice(1), body.slice(0, len(body) - 1))) if len(body) > 1 else pa.array([], pa.bool_())
        starts = pa.concat_arrays([pa.array(fresh, pa.bool_()), starts])
        runs = pc.add(pc.cumulative_sum(starts.cast(pa.int64())), run)
        if held is not None:
            yield _rows(held, False, None)
        first, run = last is None, runs[-1].as_py()
        last = body[len(body) - 1]
        held = (b.select(["nth", "doc_id", "points", "mark"]), part, runs, body[0] if first else None)
    if held is not None:
        yield _rows(held, True, last)


def _rows(held, ends: bool, last) -> pa.RecordBatch:
    kept, part, runs, first = held
    n = kept.num_rows

    def text(at: int, s) -> pa.Array:
        return pa.nulls(n, pa.binary()) if s is None else pa.array([s.as_py() if i == at else None for i in range(n)], pa.binary())

    columns = {**{c: kept.column(c) for c in kept.schema.names}, "part": pa.array([part] * n, pa.int32()), "run": runs, "first": text(0, first), "last": text(n - 1, last if ends else None)}
    return pa.RecordBatch.from_pydict(columns)


def runs(docs: DataFrame) -> DataFrame:
    """nth (a number of the row), doc_id, points, mark (digest), part, run, first, last (texts at a partition's ends, else null) of every row of docs."""
    body = F.translate(F.coalesce("text", F.lit("")), SPACES, "").cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("nth"), "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("points"), body.alias("body"))
    rows = rows.select("*", F.substring("body", 1, HEAD).alias("head"), F.unhex(F.sha2("body", 256)).alias("mark"))
    order = ["head", "mark", "nth"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("nth", "doc_id", "points", "mark", "body")
    more = [T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("first", T.BinaryType()), T.StructField("last", T.BinaryType())]
    return stored(ordered.mapInArrow(_compared, T.StructType([*ordered.schema.fields[:-1], *more])), "content-runs")


def chained(rows: DataFrame) -> DataFrame:
    """(part, run, chain) of the runs at partitions' ends: runs of one text over several partitions have one chain."""
    ends = stored(rows.where(F.col("first").isNotNull() | F.col("last").isNotNull()).select("part", "run", "first", "last"), "content-ends")
    places = ends.where("first IS NOT NULL").select("part", F.lag("part").over(W.orderBy("part")).alias("before"))  # one row for each partition
    above = ends.where("last IS NOT NULL").select(F.col("part").alias("before"), F.col("last").alias("above"))
    opens = ends.where("first IS NOT NULL").select("part", "first").join(places, "part").join(above, "before", "left").select("part", (F.coalesce(F.col("first") == F.col("above"), F.lit(False))).alias("goes_on"))
    edges = ends.groupBy("part", "run").agg(F.max(F.col("first").isNotNull()).alias("opens")).join(opens, "part")
    fresh = (~(F.col("opens") & F.col("goes_on"))).cast("bigint")
    return edges.select("part", "run", F.sum(fresh).over(W.orderBy("part", "run")).alias("chain"))


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs."""
    rows = runs(docs)
    best = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "nth").alias("best")
    narrow = rows.select("nth", "doc_id", "mark", "part", "run", best)
    edges = stored(chained(rows), "content-chains")
    inside = W.partitionBy("part", "run")
    found = narrow.withColumns({"n": F.count("*").over(inside), "top": F.min("best").over(inside)})
    ends = narrow.join(small(edges), ["part", "run"]).groupBy("chain").agg(F.count("*").alias("n_all"), F.min("best").alias("top_all"))
    ends = stored(edges.join(ends, "chain").select("part", "run", "n_all", "top_all"), "content-chain-sums")
    found = found.join(small(ends), ["part", "run"], "left").withColumns({"n": F.coalesce("n_all", "n"), "top": F.coalesce("top_all", "top")})
    return found.select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("top.nth") == F.col("nth")).alias("kept"), F.lower(F.hex("mark")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id)
"""


@query("op13_exact_dedup", SQL)
def op13(spark, sf_dir):
    return duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
