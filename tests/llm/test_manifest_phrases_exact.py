"""Merkle manifest, exact dedup and phrase mining against plain Python on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorefold.llm import exactdedup, manifest, phrases
from tests.llm.conftest import DOCS

SPACE = " \t\n\x0b\x0c\r"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- manifest -------------------------------------------------------------------------------------------------------------------------------------


def leaf_of(r):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def fold_up(nodes):
    """(root, path of (left, right) per node) of a list of digests."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for j, k in enumerate(at):
            run = runs[k // 8]
            paths[j].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        at = [k // 8 for k in at]
        nodes = [sha("".join(r)) for r in runs]
    return (nodes[0] if nodes else None), paths


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r["doc_id"]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in langs:
        by[lang].sort()
        subs[lang] = fold_up([x[2] for x in by[lang]])
    root, tops = fold_up([subs[x][0] for x in langs])
    out = []
    for lang, top in zip(langs, tops):
        for x, path in zip(by[lang], subs[lang][1]):
            out.append((x[3], x[2], subs[lang][0], root, sha("".join(a + b for a, b in path + top))))
    return sorted(out, key=repr)


def got_manifest(docs):
    found = manifest.proofs(manifest.build(docs))
    found = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof"), manifest.folded(F.col("leaf"), F.col("path")).alias("up"))
    rows = found.collect()
    assert all(r["up"] == r["root"] for r in rows)
    return sorted([tuple(r)[:5] for r in rows], key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 9}, {"en": 513, "de": 64, "": 1, None: 65}, {f"l{i:02}": 1 + i % 3 for i in range(70)}])
def test_manifest_equals_plain_tree(spark, sizes):
    rows = [(1000 * j + i * 7 % 1009, f"text {i} {lang}", lang, "s", i) for j, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    assert got_manifest(docs) == plain_manifest(docs.collect())


def test_manifest_of_odd_rows_and_none(spark, odd):
    assert got_manifest(odd) == plain_manifest(odd.collect())
    assert got_manifest(odd.limit(0)) == []


def test_manifest_finds_what_was_changed(spark):
    docs = spark.createDataFrame([(i, f"Text {i}", "en", "s", i) for i in range(100)], DOCS)
    changed = manifest.digest([F.col(c) if c != "text" else F.translate("text", manifest.UPPER, manifest.LOWER) for c in manifest.FIELDS])
    found = manifest.proofs(manifest.build(docs, carry={"other": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed)}))
    up = manifest.folded(F.coalesce("other", "leaf"), F.col("path"))
    for r in found.select("doc_id", (up == F.col("root")).alias("ok")).collect():
        assert r["ok"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0)


# ---- exact dedup ----------------------------------------------------------------------------------------------------------------------------------


def plain_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        text = r["text"] or ""
        groups[re.sub("[\x20\x09-\x0d]", "", text)].append((-len(text), r["doc_id"] is None, r["doc_id"] or 0, r["doc_id"]))
    out = []
    for body, members in groups.items():
        members.sort()
        for i, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), i == 0, sha(body)))
    return sorted(out, key=repr)


def got_groups(docs):
    return sorted([tuple(r) for r in exactdedup.duplicates(docs).collect()], key=repr)


def test_exact_duplicates_of_odd_rows_and_none(spark, odd):
    assert got_groups(odd) == plain_groups(odd.collect())
    assert got_groups(odd.limit(0)) == []


def test_exact_duplicates_over_partition_ends(spark):
    """One text fills most partitions, others begin alike; groups still have all their rows."""
    common = "the same beginning of many texts " * 3
    texts = ["hot  text"] * 700 + ["hot text "] * 300 + [common + str(i // 2) for i in range(600)] + [f"own {i}" for i in range(200)] + ["", None, " \n"] * 20
    rows = [(i * 31 % 2003, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "37"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert exactdedup.runs(docs).select("part").distinct().count() > 8
        assert got_groups(docs) == plain_groups(docs.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


# ---- phrases --------------------------------------------------------------------------------------------------------------------------------------


def test_sums_are_finished_by_the_python_that_made_them(spark):
    shards = [phrases._shard(np.arange(20_000, dtype=np.int64) % 7), phrases._shard(np.arange(20_000, dtype=np.int64) % 5)]
    df = spark.createDataFrame(pa.Table.from_batches(shards))
    finish = lambda block, n: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([int(n.sum())], pa.int64())], names=["block", "total"])
    out = phrases._summed(df, finish, "block int, total bigint")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # a second one keeps a second Python beside each task
    i = np.arange(20_000)
    assert {r["block"]: r["total"] for r in out.collect()} == {k: int((i % 7 + i % 5)[k * phrases.BLOCK : (k + 1) * phrases.BLOCK].sum()) for k in range(3)}


def plain_phrases(rows, least, top=2000, longest=5):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang, text = r["lang"] if r["lang"] is not None else "und", r["text"] or ""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = tuple(w for w in re.split("[\x20\x09]+", piece) if w)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang][ws[i : i + k]] += 1
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if a >= least}
        report = []
        for p, a in many.items():
            if len(p) < 2 or any(100 * b >= 100 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in many.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            report.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(report)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got_phrases(docs, least, **more):
    return sorted(tuple(r) for r in phrases.phrases(docs, min_count=least, **more).collect())


def made_texts(seed, docs=150):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(12)] + ["New", "YORK", "é", "x" * 300, "straße"]
    rows = []
    for i in range(docs):
        ws = rng.choice(words, rng.integers(0, 40))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " new york city hall "]) for w in ws)
        rows.append((i, None if i % 37 == 5 else text, ["en", "de", None, "und"][i % 4], "s", 0))
    return rows


@pytest.mark.parametrize("trie_rows", [phrases.TRIE_ROWS, 40])
def test_phrases_equal_plain_counts(spark, monkeypatch, trie_rows):
    """Also with small arrays: several blocks, tries, and flushes of the word counts."""
    for name, value in (("BUCKETS", (1 << 14, 1 << 14)), ("SPAN", 50), ("CHUNK", 400), ("VOCABULARY", 30), ("ROWS", 3)):
        monkeypatch.setattr(phrases, name, value)
    docs = spark.createDataFrame(made_texts(3), DOCS).repartition(5)
    want = plain_phrases(docs.collect(), 6)
    assert len(want) > 30
    assert got_phrases(docs, 6, trie_rows=trie_rows) == want
    assert got_phrases(docs, 6, top=3) == plain_phrases(docs.collect(), 6, top=3)


def test_phrases_of_odd_rows_and_none(spark, odd):
    assert got_phrases(odd, 3) == plain_phrases(odd.collect(), 3)
    assert got_phrases(odd.limit(0), 3) == []
    assert got_phrases(odd, 10**6) == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**12
    known = spark.createDataFrame([([1, 2], 3 * big)], "codes array<bigint>, a bigint")
    words = spark.createDataFrame([("en", 1, "a", 7 * big), ("en", 2, "b", 9 * big + 1)], "lang string, code bigint, word string, n bigint")
    sizes = spark.createDataFrame([("en", 10**6 * big)], "lang string, n bigint")
    r = phrases._report(known, words, sizes, 5, 10).first()
    assert r["score"] == 1000 * 3 * big * 10**6 * big // (7 * big * (9 * big + 1))


def test_trie_equals_counting():
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 600):
        alphabet = rng.integers(1, 2**63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        text = alphabet[rng.integers(0, size, 4000)]
        text[rng.random(4000) < 0.1] = 0
        wanted = {tuple(map(int, g)) + (0,) * (5 - len(g)) for i in range(0, 3000, 3) if (g := text[i : i + 2 + i % 4]).all()}
        trie = phrases.Trie(np.array(sorted(wanted), np.uint64))
        found = trie.count(text)
        seen = Counter(tuple(map(int, g)) + (0,) * (5 - k) for k in range(2, 6) for i in range(4001 - k) if (g := text[i : i + k]).all())
        assert [seen[tuple(map(int, p))] for p in trie.phrases] == found.tolist()
        assert len(trie.phrases) == len(wanted)
