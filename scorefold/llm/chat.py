r"""Chat formatting of reply trees.

A tree is a set of rows (conv_id, node, parent, role, text, score). Branches are enumerated by self-joins that double their reach: after step
k every node knows its ancestor 2^k above, so all root-to-leaf paths are known after log2(depth) joins, and the chosen paths are spelled out
by as many more (every distance from the leaf is one sum of powers of two, so no row is made twice). A branch's score is the mean of its
nodes' scores; the best `branches` of each tree are formatted, ties by leaf. A linear conversation is a tree with one branch.

Template (fixed values): `<s>` opens a conversation; a user turn is `[INST] TEXT [/INST]`, an assistant turn ` TEXT </s>`, any other
`[ROLE] NAME [TEXT] TEXT [/ROLE]`. Inside names and texts, every `[` and `<` is followed by an inserted `\`; markers never hold `[\` or
`<\`, so no text can look like a marker, and removing that `\` gives the text back.

Defined results: null text and null role are empty; a null conv_id is a conversation of its own; rows of the same turn come in the order of
role and text, repeated rows stay; a parent that is not there makes its child a root; nodes on or below a cycle have no path and are left out;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorefold.llm import query
from scorefold.llm.common import stored, table

OPEN, USER, USER_END, REPLY, REPLY_END = "<s>", "[INST] ", " [/INST]", " ", " </s>"
OTHER, OTHER_TEXT, OTHER_END = "[ROLE] ", " [TEXT] ", " [/ROLE]"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("["), F.lit("[\\")), F.lit("<"), F.lit("<\\"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<"))


def turn_markup(role: Column, text: Column) -> Column:
    """struct(head, body, tail) of one turn."""
    name = escaped(role)
    return F.struct(
        F.when(role == "user", F.lit(USER)).when(role == "assistant", F.lit(REPLY)).otherwise(F.concat(F.lit(OTHER), name, F.lit(OTHER_TEXT))).alias("head"),
        escaped(text).alias("body"),
        F.when(role == "user", F.lit(USER_END)).when(role == "assistant", F.lit(REPLY_END)).otherwise(F.lit(OTHER_END)).alias("tail"),
        (role == "assistant").alias("loss"),
    )


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(jumps, rooted). jumps[k]: (conv_id, node, up, total, reach), the ancestor 2^k above each node that has one, with the sum and number
    of the scores on the way. rooted: (conv_id, node, total, reach), those sums from each node to its root.

    A node leaves the rounds as soon as its root is reached, so the rows of all rounds add up to a small multiple of the nodes.
    """
    known = nodes.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n")).distinct()
    linked = nodes.join(known, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("parent") == F.col("_n")), "left")
    step = stored(linked.select("conv_id", "node", F.col("_n").alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("bigint").alias("reach")), "tree-jump")
    all_nodes, rooted, jumps = step.count(), step.where("up IS NULL"), [step.where("up IS NOT NULL")]
    while 2 ** len(jumps) <= all_nodes and jumps[-1].limit(1).count():
        above = jumps[-1].unionByName(rooted).select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("total").alias("_t"), F.col("reach").alias("_r"))
        both = jumps[-1].join(above, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("up") == F.col("_n")))
        step = stored(both.select("conv_id", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_t")).alias("total"), (F.col("reach") + F.col("_r")).alias("reach")), "tree-jump")
        rooted = rooted.unionByName(step.where("up IS NULL"))
        jumps.append(step.where("up IS NOT NULL"))
    return jumps, rooted.drop("up")


def chosen_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(conv_id, leaf, up_from_leaf, node) of the best `branches` root-to-leaf paths of each tree; None: of all."""
    jumps, rooted = ancestors(nodes)
    inner = jumps[0].select(F.col("conv_id").alias("_c"), F.col("up").alias("_n")).distinct()
    leaves = rooted.join(inner, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n")), "left_anti")
    leaves = leaves.withColumn("mean", F.col("total") / F.col("reach"))
    if branches is not None:
        best = Window.partitionBy("conv_id").orderBy(F.col("mean").desc(), F.col("node"))
        leaves = leaves.withColumn("_c_rank", F.row_number().over(best)).where(F.col("_c_rank") <= branches)
    path = leaves.select("conv_id", F.col("node").alias("leaf"), F.lit(0).cast("bigint").alias("up_from_leaf"), "node")
    for k in range(len(jumps) - 1, -1, -1):
        up = jumps[k].select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        higher = path.join(up, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n")))
        path = stored(path.unionByName(higher.select("conv_id", "leaf", (F.col("up_from_leaf") + 2**k).alias("up_from_leaf"), F.col("_up").alias("node"))), "tree-path")
    return path


def format_trees(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """conv_id, leaf, formatted, loss_spans (code points, end exclusive): one row per chosen path of each tree."""
    path = chosen_paths(nodes.select("conv_id", "node", "parent", "score"), branches)
    said = nodes.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), F.coalesce("role", F.lit("")).alias("role"), "text")
    rows = path.join(said, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n")))
    turns = rows.groupBy("conv_id", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("up_from_leaf")).alias("at"), "role", "text"))).alias("_c_turns"))
    turns = turns.select("conv_id", "leaf", F.transform("_c_turns", lambda x: turn_markup(x["role"], x["text"])).alias("_c_marks"))
    start = F.struct(F.lit(len(OPEN)).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def mark(acc, x):
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        spans = F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + F.length(x["tail"])).alias("at"), spans.alias("spans"))

    text = F.concat(F.lit(OPEN), F.array_join(F.transform("_c_marks", lambda x: F.concat(x["head"], x["body"], x["tail"])), ""))
    return turns.select("conv_id", "leaf", text.alias("formatted"), F.aggregate("_c_marks", start, mark)["spans"].alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns, array<struct<role,text>>, read back from a formatted conversation."""
    pieces = F.split(F.substring(formatted, len(OPEN) + 1, 2**31 - 1), r" \[/INST\]| </s>| \[/ROLE\]")

    def turn(p):
        rest = F.substring(p, len(OTHER) + 1, 2**31 - 1)
        user = F.struct(F.lit("user").alias("role"), unescaped(F.substring(p, len(USER) + 1, 2**31 - 1)).alias("text"))
        cut = F.locate(OTHER_TEXT, rest)
        other = F.struct(unescaped(F.substring(rest, F.lit(1), cut - 1)).alias("role"), unescaped(F.substring(rest, cut + len(OTHER_TEXT), F.length(rest))).alias("text"))
        reply = F.struct(F.lit("assistant").alias("role"), unescaped(F.substring(p, len(REPLY) + 1, 2**31 - 1)).alias("text"))
        return F.when(p.startswith(USER), user).when(p.startswith(OTHER), other).otherwise(reply)

    return F.transform(F.slice(pieces, F.lit(1), F.greatest(F.lit(0), F.size(pieces) - 1)), turn)


def from_turns(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees: each row answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(order).cast("bigint")
    return rows.select("conv_id", "role", "text", node.alias("node")).select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(text, '[', '[\'), '<', '<\') AS body, replace(replace(role, '[', '[\'), '<', '<\') AS name FROM c
), t AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    CAST(3 + sum(length(body) + CASE WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 6 ELSE 23 + length(name) END) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT * FROM t
"""


@query("op3_chat_formatting", SQL)
def op3(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    trees = stored(from_turns(rows.unionByName(more)), "conversation-trees")  # numbered once: a rerun must not number anew
    out = format_trees(trees)
    out = out.select("conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("turns"))
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    out = out.withColumn("_c_learnt", learnt)
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_c_learnt").cast("bigint").alias("loss_chars"),
        F.sha2("_c_learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
