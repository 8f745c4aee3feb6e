"""Readers: line-JSON logs with bad-line counting, reports with coerced fields, event tables, labelled unions, question pools."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorefold.functions.columns import nan_to_null
from scorefold.operators.ordered import positions
from scorefold.session import checkpointed

PIECE = 4 << 20  # bytes of a file that are read at once
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy H:mm", "M/d/yyyy", "yyyy/MM/dd")


def parse_json_lines(lines: DataFrame, schema: T.StructType, text: str = "value") -> DataFrame:
    """Parsed columns plus ``_bad``: 1 for a line that is not a JSON object of the schema. Blank lines are dropped.

    A bare number or string is valid JSON but no record, so the line has to open with a brace as well as parse.
    """
    rows = lines.where(F.trim(text) != "")
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = rows.withColumn("__j", F.from_json(text, with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("__j").isNull() | F.col("__j._corrupt").isNotNull() | ~F.ltrim(text).startswith("{")
    keep = [c for c in lines.columns if c != text]
    return parsed.select(*keep, *[F.col(f"__j.{f.name}").alias(f.name) for f in schema.fields], bad.cast("int").alias("_bad"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad counts per file) of line-JSON files; every row carries its file."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    parsed = parse_json_lines(lines, schema)
    bad = parsed.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum("_bad").alias("bad"))
    return parsed.where("_bad = 0").drop("_bad"), bad


RUN_NAME = r"responses-(.+?)-(bare|grounded|tool|retrieved)(?:-([A-Za-z0-9_.]+))?\.jsonl"  # fixed value: the log file name


def arm_columns(file: Column | str = "file") -> dict[str, Column]:
    """Model, arm and variant out of a response file's name."""
    f = F.col(file) if isinstance(file, str) else file
    part = lambda i: F.regexp_extract(f, RUN_NAME, i)
    return {"model": F.when(part(1) != "", part(1)), "arm": F.when(part(2) != "", part(2)), "variant": F.when(part(3) != "", part(3)).otherwise("main")}


def read_arms(spark: SparkSession, glob: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    rows, bad = read_jsonl(spark, glob, schema)
    return rows.withColumns(arm_columns()), bad


def mixed_date(text: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date of a text in any of the formats, NULL when none fits."""
    t = F.col(text) if isinstance(text, str) else text
    return F.to_date(F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]))


def coerce_reports(raw: DataFrame, dates: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Dates and numbers coerced to NULL where they do not parse; NaN becomes NULL."""
    out = raw.withColumns({**{d: mixed_date(d) for d in dates}, **{n: F.col(n).try_cast("double") for n in numbers}})
    return nan_to_null(out)


def read_reports(spark: SparkSession, path: str, columns: Sequence[str], dates: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    raw = spark.read.option("header", True).csv(path).select(*columns)
    return coerce_reports(raw, dates, numbers)


def read_records(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Column-pruned scan of the event table."""
    return spark.read.parquet(path).select(*columns)


def labelled_union(positive: DataFrame, negative: DataFrame, label: str = "label") -> DataFrame:
    one = lambda d, v: d.withColumn(label, F.lit(v))
    return one(positive, 1).unionByName(one(negative, 0), allowMissingColumns=True)


def question_records(raw: DataFrame) -> DataFrame:
    """Records of a question pool; a file's header record has no question id."""
    return raw.where(F.col("question_id").isNotNull())


def read_qa_pool(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    return question_records(spark.read.schema(schema).option("multiLine", True).json(glob))


# --- file inventories -------------------------------------------------------------------------------------------------
def file_inventory(spark: SparkSession, glob: str) -> DataFrame:
    """Name, size, modification time, sha256 and the sha256 with CRLF line ends of every file that is not empty (Spark's readers pass over empty ones).

    A file's bytes form one chain, so one task reads them all. Local files are read as a stream of `PIECE` bytes, so neither a row nor a task holds a file,
    whatever its size. Files of a store that only Spark reads are rows with their contents, which end at 2 GB each."""
    b = spark.read.format("binaryFile").load(glob)
    listed = b.select("path", "length", "modificationTime")  # without contents
    if listed.where(~F.col("path").startswith("file:")).limit(1).count():
        crlf = F.regexp_replace(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n"), "\n", "\r\n")
        h = b.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"), F.sha2(F.encode(crlf, "ISO-8859-1"), 256).alias("sha256_crlf"))
    else:
        h = listed.mapInPandas(_hashed, "path string, length bigint, modificationTime timestamp, sha256 string, sha256_crlf string")
    return h.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "sha256", "sha256_crlf")


def _hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        both = [_digests("/" + x.removeprefix("file:").lstrip("/")) for x in p["path"]]
        yield p.assign(sha256=[a for a, _ in both], sha256_crlf=[b for _, b in both])


def _digests(path: str) -> tuple[str, str]:
    """SHA-256 of a file as it is and with CRLF line ends; a CR at the end of a piece waits for what follows it."""
    plain, crlf, held = hashlib.sha256(), hashlib.sha256(), b""
    with open(path, "rb") as f:
        while piece := f.read(PIECE):
            plain.update(piece)
            piece = held + piece
            held = b"\r" if piece.endswith(b"\r") else b""
            crlf.update(piece[: len(piece) - len(held)].replace(b"\r\n", b"\n").replace(b"\n", b"\r\n"))
    crlf.update(held)
    return plain.hexdigest(), crlf.hexdigest()


def line_inventory(spark: SparkSession, glob: str, served: str = "model", fan: int = 4096, name: Column | None = None) -> DataFrame:
    """One row per line file: file (or ``name``, out of its metadata), bytes, modified, rows (lines that are not blank), bad (of them, those that are no JSON object), served (the distinct
    values of a JSON field, comma-joined in order), digest and digest_lf (the latter without carriage returns at line ends).

    Files are read as splittable text, so neither a task nor a row ever holds a whole file. A digest is a tree over the file's lines: SHA-256 of each
    line, then of every ``fan`` consecutive digests joined, until one is left (one level at least; an empty file has none).
    """
    raw = spark.read.option("lineSep", "\n").text(glob).select(
        (F.element_at(F.split("_metadata.file_path", "/"), -1) if name is None else name).alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    lf = F.rtrim(F.col("value"), F.lit("\r"))
    text = F.trim(lf)
    lines = checkpointed(raw.select(
        "file", "bytes", "modified", "block", "row", F.sha2("value", 256).alias("a"), F.sha2(lf, 256).alias("b"), (text != "").cast("bigint").alias("full"),
        ((text != "") & (~text.startswith("{") | F.get_json_object("value", "$").isNull())).cast("bigint").alias("bad"), F.get_json_object("value", f"$.{served}").alias("name")))
    facts = lines.groupBy("file").agg(F.max("bytes").alias("bytes"), F.max("modified").alias("modified"), F.sum("full").alias("rows"), F.sum("bad").alias("bad"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("served"))
    nodes = positions(lines.select("file", "block", "row", "a", "b"), ["file"], ["block", "row"], "pos").select("file", "pos", "a", "b")
    whole = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), ""), 256).alias(c)
    roots = None
    while True:  # at most `fan` digests meet in a row; files of one node leave the rounds
        nodes = nodes.groupBy("file", F.floor(F.col("pos") / fan).alias("up")).agg(whole("a"), whole("b")).withColumnRenamed("up", "pos")
        top = nodes.groupBy("file").agg((F.max("pos") == 0).alias("lone"))
        nodes = checkpointed(nodes.join(top, "file"))
        done = nodes.where("lone").select("file", F.col("a").alias("digest"), F.col("b").alias("digest_lf"))
        roots = done if roots is None else roots.unionByName(done)
        nodes = nodes.where("NOT lone").select("file", "pos", "a", "b")
        if not nodes.limit(1).count():
            return facts.join(roots, "file")


def inventory_drift(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Status per file against a recorded inventory (file, sha256): same, same_crlf, changed, added, removed."""
    j = now.select("file", "sha256", "sha256_crlf").join(recorded.select("file", F.col("sha256").alias("__old")), "file", "full_outer")
    status = (
        F.when(F.col("__old").isNull(), "added").when(F.col("sha256").isNull(), "removed").when(F.col("sha256") == F.col("__old"), "same")
        .when(F.col("sha256_crlf") == F.col("__old"), "same_crlf").otherwise("changed"))
    return j.select("file", status.alias("status"))


def variant_sections(inventory: DataFrame, file: str, rows: Column, patterns: Mapping[str, str]) -> DataFrame:
    """Files and rows per named section; the first matching pattern names a file's section."""
    sec = None
    for name, p in patterns.items():
        sec = F.when(F.col(file).rlike(p), name) if sec is None else sec.when(F.col(file).rlike(p), name)
    return inventory.groupBy(sec.otherwise("other").alias("section")).agg(F.count_distinct(file).alias("files"), F.sum(rows).alias("rows"))
