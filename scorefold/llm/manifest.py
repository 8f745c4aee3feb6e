r"""Merkle manifest of a dataset: one root over all documents, and for each document the proof that leads from its digest to the root.

A leaf is the SHA-256 of a row's fields. Per group (language) leaves stand in the order of doc_id; every `FAN` consecutive nodes (the last run: fewer)
become the digest of their concatenated digests until one is left. The groups' roots, ordered by group, are the leaves of the top tree.

*Ranks.* Rows are range-partitioned by (group, doc_id), sorted and written with their place; a place minus the first place of its (group, partition)
plus the rows of the group in earlier partitions is the rank. Only one row per group and partition is summed across partitions.

*Rollup.* The base-`FAN` digits of the rank are columns. Inside blocks of `FAN`^`DEPTH` consecutive nodes, which one shuffle brings together, the
digits are grouped away one by one, last first, and each step nests the child structs below the new node. A block is one row of bounded size; blocks
are the nodes of the next stage, until a stage has one block per group.

*Proofs.* From the top stage down, a block row meets the path above it (one grouping of both row kinds by block) and transforms and explodes its
nested children level by level; each level puts the digests left and right of the node in front of the path. Documents take part in no join.

Defined results: null fields are `-`; a null doc_id comes first in its group; rows with the same doc_id are ordered by leaf, and equal rows are
leaves each; a null group comes before all others; an empty table gives no rows; a table of one row is its own root; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scorefold.llm import query
from scorefold.llm.common import small, stored, table

#: Children of a node, and levels of the tree inside one block (8^3 = 512 nodes).
FAN = 8
BITS = 3
DEPTH = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
GROUP = ["named", "grp"]
TOP = ["top"]
PATH = "array<struct<left:string,right:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Tree(NamedTuple):
    stages: list[DataFrame]  # of the groups, lowest first: group, block, size, hash, children
    tops: list[DataFrame]  # of the tree over the groups' roots


def digest(fields: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of the fields, each as its UTF-8 length, a colon and its value; `-` where null."""

    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*map(part, fields)), 256)


def _ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with rank (from 0) and size of their group; (by, order) is unique."""
    at = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = stored(at.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "merkle-places")
    runs = placed.groupBy(*by, "part").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    before = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition that has the group
    runs = runs.select(*by, "part", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy(*by)).alias("size"))
    out = placed.join(small(stored(runs, "merkle-runs")), [*by, "part"])
    return out.withColumn("rank", F.col("place") - F.col("start") + F.col("before")).drop("part", "place", "start", "before")


def _nodes_at(level: int) -> Column:
    """Nodes that a group of `size` has `level` levels above the stage's own."""
    return F.ceil(F.col("size") / F.lit(FAN**level))


def _rolled(nodes: DataFrame, by: list[str], carry: list[str]) -> DataFrame:
    """(by, block, size, hash, children): nodes of by, rank, size, hash and carried columns, grouped into blocks."""
    digit = lambda k: F.shiftright("rank", BITS * k).bitwiseAND(F.lit(FAN - 1)).cast("int").alias(f"d{k}")
    node = F.struct(digit(0), "hash", *carry)
    rows = nodes.select(*by, "size", F.shiftright("rank", BITS * DEPTH).alias("block"), *(digit(k) for k in range(1, DEPTH)), node.alias("node"))
    rows = rows.repartition(*by, "block")
    for level in range(DEPTH):
        digits = [f"d{k}" for k in range(level + 1, DEPTH)]
        rows = rows.groupBy(*by, "block", *digits).agg(F.max("size").alias("size"), F.sort_array(F.collect_list("node")).alias("children"))
        lone = F.get(F.col("children.hash"), F.lit(0))  # a level of one node is the end: no digest of it alone is taken
        rows = rows.withColumn("hash", F.when(_nodes_at(level) > 1, F.sha2(F.array_join("children.hash", ""), 256)).otherwise(lone))
        if digits:
            rows = rows.withColumn("node", F.struct(digits[0], "hash", "children"))
    return rows.select(*by, "block", "size", "hash", "children")


def _stages(nodes: DataFrame, by: list[str], carry: list[str]) -> list[DataFrame]:
    out = []
    while True:
        out.append(stored(_rolled(nodes, by, carry if not out else []), "merkle-blocks"))
        if not out[-1].where("block > 0").limit(1).count():
            return out
        nodes = out[-1].select(*by, F.col("block").alias("rank"), _nodes_at(DEPTH).alias("size"), "hash")


def build(docs: DataFrame, fields: list[str] = FIELDS, group: str = "lang", order: str = "doc_id", carry: Mapping[str, Column] = {}) -> Tree:
    """The tree over docs; `carry` adds columns of a document that `proofs` hands out with it."""
    grp = F.col(group).cast("string")
    kept = {order: F.col(order), **carry}
    doc = F.struct(*(c.alias(k) for k, c in kept.items()))
    # a false flag sorts first: null groups have it
    keys = [grp.isNotNull().alias("named"), F.coalesce(grp, F.lit("")).alias("grp"), F.col(order).alias("at")]
    leaves = docs.select(*keys, digest([F.col(c) for c in fields]).alias("hash"), F.monotonically_increasing_id().alias("nth"), doc.alias("doc"))
    leaves = stored(leaves, "merkle-leaves")  # texts are read once
    stages = _stages(_ranked(leaves, GROUP, ["at", "hash", "nth"]), GROUP, ["doc"])
    roots = stages[-1].select(F.lit(0).alias("top"), *GROUP, "hash")
    return Tree(stages, _stages(_ranked(roots, TOP, GROUP), TOP, GROUP))


def _with_path(level: int):
    """A child of `children` and its place -> the child and the path from it."""

    def step(c: Column, i: Column) -> Column:
        digests = F.col("children.hash")
        sides = F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("left"), F.array_join(F.slice(digests, i + 2, F.lit(FAN)), "").alias("right"))
        return F.struct(c.alias("node"), F.when(_nodes_at(level) > 1, F.concat(F.array(sides), F.col("path"))).otherwise(F.col("path")).alias("path"))

    return step


def _emitted(blocks: DataFrame, by: list[str], above: DataFrame, shared: list[str], carry: list[str]) -> DataFrame:
    """(by, rank, hash, path, shared, carry) of every node of the blocks; above: by, block, path, shared."""
    keys = [*by, "block"]
    both = blocks.select(*keys, "size", "children").unionByName(above.select(*keys, "path", *shared), allowMissingColumns=True)
    rest = ["size", "children", "path", *shared]
    rows = both.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in rest))  # one row of each kind
    rows = rows.withColumn("rank", F.col("block"))
    for level in reversed(range(DEPTH)):
        rows = rows.select(*by, "rank", "size", *shared, F.explode(F.transform("children", _with_path(level))).alias("c"))
        below = [F.col("c.node.children").alias("children")] if level else [F.col("c.node.hash").alias("hash"), *(F.col(f"c.node.{x}").alias(x) for x in carry)]
        rank = F.shiftleft("rank", BITS) + F.col(f"c.node.d{level}")
        rows = rows.select(*by, rank.alias("rank"), "size", *shared, F.col("c.path").alias("path"), *below)
    return rows


def proofs(tree: Tree) -> DataFrame:
    """The carried columns of every document with leaf, path (digests left and right of its node at each level, lowest first), subroot and root."""
    above = tree.tops[-1].select(*TOP, "block", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    for k, blocks in reversed(list(enumerate(tree.tops))):
        nodes = _emitted(blocks, TOP, above, ["root"], GROUP if k == 0 else [])
        above = nodes.withColumnRenamed("rank", "block")
    above = nodes.select(*GROUP, F.lit(0).cast("bigint").alias("block"), "path", "root", F.col("hash").alias("subroot"))
    for k, blocks in reversed(list(enumerate(tree.stages))):
        nodes = _emitted(blocks, GROUP, above, ["root", "subroot"], ["doc"] if k == 0 else [])
        above = nodes.withColumnRenamed("rank", "block")
    return nodes.select("doc.*", F.col("hash").alias("leaf"), "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, crc, text,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS front
  FROM (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
      list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) AS crc
    FROM documents
  )
), leaf AS (
  SELECT doc_id, lang, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS h,
    CASE WHEN crc % 3 = 0 THEN sha256(front || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM d
), ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf
), lv(lang, l, pos, n, h) AS (
  SELECT lang, 0, pos, n, h FROM ranked
  UNION ALL
  SELECT lang, l + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY lang, l, pos // 8
), sub AS MATERIALIZED (
  SELECT lang, h AS subroot, l AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1
), top(l, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM sub
  UNION ALL
  SELECT l + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY l, pos // 8
), side AS MATERIALIZED (
  SELECT lang, l, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM lv WHERE n > 1 WINDOW w AS (PARTITION BY lang, l, pos // 8 ORDER BY pos)
), topside AS MATERIALIZED (
  SELECT l, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM top WHERE n > 1 WINDOW w AS (PARTITION BY l, pos // 8 ORDER BY pos)
), climb(doc_id, leaf, lang, l, pos, h, proof) AS (
  SELECT doc_id, h, lang, 0, pos, coalesce(other, h), '' FROM ranked
  UNION ALL
  SELECT c.doc_id, c.leaf, c.lang, c.l + 1, c.pos // 8, sha256(s.a || c.h || s.b), c.proof || s.a || s.b
  FROM climb c JOIN side s ON s.lang IS NOT DISTINCT FROM c.lang AND s.l = c.l AND s.pos = c.pos
), rise(doc_id, leaf, subroot, l, pos, h, proof) AS (
  SELECT c.doc_id, c.leaf, s.subroot, 0, s.pos, c.h, c.proof FROM climb c JOIN sub s ON s.lang IS NOT DISTINCT FROM c.lang AND s.height = c.l
  UNION ALL
  SELECT r.doc_id, r.leaf, r.subroot, r.l + 1, r.pos // 8, sha256(s.a || r.h || s.b), r.proof || s.a || s.b FROM rise r JOIN topside s ON s.l = r.l AND s.pos = r.pos
), root AS (
  SELECT h AS root, l AS height FROM top WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM rise JOIN root ON rise.l = root.height
"""


@query("op12_merkle_manifest", SQL)
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    lowered = digest([F.col(c) if c != "text" else F.translate("text", UPPER, LOWER) for c in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered)
    found = proofs(build(docs, carry={"tampered": tampered}))
    out = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
