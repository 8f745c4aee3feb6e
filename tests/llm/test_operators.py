"""Operators of the text subpackage: brute force, round trips, held-out accuracy, and the odd inputs that each has a defined result for."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scorefold import llm
from scorefold.llm import chat, decontaminate, grams, langid, linededup, mixing, quality, secrets, simhash, toxicity, urls
from tests.compare import compare, duck
from tests.llm.conftest import DOCS, SF


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_registry():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", x)[0] for x in names if re.match(r"op\d+_", x)}
    assert "pipeline" in names and set(llm.ORACLES) <= set(names)


@pytest.mark.parametrize("name", ["op3_chat_formatting", "op6_quality_rules", "op7_url_filter", "op8_secret_scan", "op9_source_mixing", "op10_line_dedup", "op11_phrase_collocations", "op12_merkle_manifest", "op13_exact_dedup"])
def test_matches_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]) is None


# --- toxicity and language -------------------------------------------------------------------------------------------------------


def naive_buckets(text, sizes, bits):
    words = (text or "").lower().split()
    s = f" {' '.join(words)} " if words else ""
    out = []
    for n in sizes:
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i : i + n]:
                h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
            out.append((((h ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - bits))
    return sorted(out)


def test_buckets_are_those_of_a_plain_loop(monkeypatch):
    for text in ("Ein schöner Tag", "", None, "x", "  a\nb  ", "né" * 50):
        assert sorted(np.concatenate([*grams.buckets(text, range(2, 5), 12), np.zeros(0, np.uint32)]).tolist()) == naive_buckets(text, range(2, 5), 12)
    monkeypatch.setattr(grams, "PIECE", 7)  # pieces neither lose nor repeat a gram
    assert sorted(np.concatenate(list(grams.buckets("né" * 50, range(2, 5), 12))).tolist()) == naive_buckets("né" * 50, range(2, 5), 12)


def test_toxicity_on_held_out_rows_and_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").toPandas()
    held = got[got.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 5 == 0)]
    hit, miss = held[held.toxic == 1].score, held[held.toxic == 0].score
    assert np.mean([[a > b for b in miss] for a in hit]) > 0.85
    for r in got.head(20).itertuples():
        z = model.intercept + sum(float(model.weights[b]) for b in set(naive_buckets(r.text, toxicity.SIZES, toxicity.BITS)))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-5


def held_out_scores(spark, sf):
    docs, labels = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").toPandas()
    return got, got[got.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 5 == 0)]


def test_toxicity_on_the_smallest_table(spark):
    got, held = held_out_scores(spark, "sf0.001")
    hit, miss = held[held.toxic == 1].score, held[held.toxic == 0].score
    assert got.score.nunique() > 10 and np.mean([[a > b for b in miss] for a in hit]) > 0.8
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() > 0.85


def test_toxicity_with_few_labels_says_the_share(spark):
    docs = spark.createDataFrame([(i, f"text {i} of a few") for i in range(4)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(4)], "doc_id bigint, toxic int")
    kept = [i for i in range(4) if __import__("zlib").crc32(str(i).encode()) % 5]
    model = toxicity.fit(docs, labels)
    assert not model.weights.any() and {1 in kept, len(kept) < toxicity.MIN_TEXTS} == {True}
    assert all(abs(r["score"] - 2 / (len(kept) + 2)) < 1e-9 for r in toxicity.score(docs, model).collect())


def test_toxicity_packs_buckets_and_counts_repeated_ids_once(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 20, n)).astype(np.uint32) for n in (0, 1, 500, 0, 3, 40_000, 0)] + [np.array([0, 254, 255, 509, 510, 765], np.uint32)]
    for some in (sets, sets[:1], sets[3:4] + sets[:2]):
        assert np.array_equal(toxicity.unpack([toxicity.pack(s) for s in some], np.array([len(s) for s in some])), np.concatenate(some))
    rows = [(i, f"alpha beta gamma {i % 3}", int(i % 4 == 0)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    one, many = toxicity.fit(docs, labels), toxicity.fit(docs.unionByName(docs.where("doc_id < 30")), labels.unionByName(labels))
    assert np.array_equal(one.weights, many.weights) and one.intercept == many.intercept


def test_toxicity_odd_inputs(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, 0), (None, 1), (8, None)], "doc_id bigint, toxic int")
    scores = rows(toxicity.score(odd, toxicity.fit(odd, labels)), "doc_id", "score")
    assert len(scores) == odd.count() and all(0 <= s <= 1 for _, s in scores)
    none = toxicity.fit(odd, labels.limit(0))
    assert {s for _, s in rows(toxicity.score(odd, none), "doc_id", "score")} == {0.0}
    assert toxicity.score(odd.limit(0), none).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 5 == 0)]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.rejected.mean() < 0.01 and got.score.between(0, 1).all()


def test_language_odd_inputs(spark, odd):
    model = langid.fit(odd)
    got = rows(langid.identify(odd, model), "doc_id", "lang_pred", "score", "rejected")
    assert len(got) == odd.count()
    assert {(i, p, s) for i, p, s, r in got if i in (1, 2, 3, 9)} == {(i, "und", 0.0) for i in (1, 2, 3, 9)}
    assert {i for i, p, s, r in got if p == "und"} == {1, 2, 3, 9}
    assert langid.drop_unidentified(odd).columns == odd.columns
    nothing = langid.fit(odd.limit(0))
    assert {p for _, p in rows(langid.identify(odd, nothing), "doc_id", "lang_pred")} == {"und"}
    assert langid.drop_unidentified(odd.limit(0)).count() == 0


# --- SimHash ---------------------------------------------------------------------------------------------------------------------


def naive_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return v - (1 << 64) if v >> 63 else v


def brute_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.MAX_BITS and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_fingerprint(monkeypatch):
    texts = [None, "", " \n", "One", "one Two", "Äpfel und ÄPFEL und\x0bäpfel", "a b c d e " * 40]
    assert [simhash.fingerprint(t) for t in texts] == [naive_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "CHUNK", 3)
    assert [simhash.fingerprint(t) for t in texts] == [naive_fingerprint(t) for t in texts]


def test_components_equal_all_pairs(spark):
    rng = random.Random(4)
    prints = {0, -1, 1, 3, 7, 15}
    flip = lambda x, n: (lambda v: v - (1 << 64) if v >> 63 else v)((x & (2**64 - 1)) ^ sum(1 << b for b in rng.sample(range(64), n)))
    for _ in range(60):
        x = rng.randrange(-(2**63), 2**63)
        prints |= {x, *(flip(x, rng.randrange(1, 6)) for _ in range(6))}
    x = rng.randrange(-(2**63), 2**63)  # a dense group, and a chain
    prints |= {flip(x, rng.randrange(1, 4)) for _ in range(150)}
    for _ in range(40):
        prints.add(x := flip(x, 3))
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    edges = [tuple(r) for r in simhash.links(df).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in edges)
    want = brute_components(prints)
    got = dict(prints_root := [(p, p) for p in prints]) | {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    assert got == want and prints_root


def test_simhash_odd_inputs(spark, odd):
    got = rows(simhash.near_duplicates(odd), "doc_id", "fp", "component_id")
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(got) == odd.count() and all(f == naive_fingerprint(texts[i]) for i, f, _ in got if i is not None)
    assert {(i, c) for i, f, c in got if i in (1, 2, 3, 6, 7)} == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    roots = brute_components({f for _, f, _ in got})
    smallest = {r: min(i for i, f, _ in got if i is not None and roots[f] == r) for r in {roots[f] for i, f, _ in got if i is not None}}
    assert sorted(i for i in ids if i is not None) == sorted(smallest.values()) and ids.count(None) == 2
    assert simhash.drop_near_duplicates(odd.limit(0)).count() == 0
    same = odd.where("doc_id = 7")  # repeated rows: one stays
    assert simhash.drop_near_duplicates(same).count() == 1


# --- chat ------------------------------------------------------------------------------------------------------------------------


def test_trees_are_enumerated_and_ranked(spark):
    nodes = [
        ("t", 1, None, "user", "root", 0.0),
        ("t", 2, 1, "assistant", "bad", 0.1),
        ("t", 3, 1, "assistant", "good", 0.9),
        ("t", 4, 3, "user", "more </s>", 0.5),
        ("t", 5, 4, "assistant", "deep [INST]", 0.7),
        ("t", 6, 99, "user", "orphan", 0.2),
        ("loop", 1, 2, "user", "x", 1.0),
        ("loop", 2, 1, "assistant", "y", 1.0),
        (None, 1, None, None, None, None),
    ]
    df = spark.createDataFrame(nodes, "conv_id string, node bigint, parent bigint, role string, text string, score double")
    every = rows(chat.chosen_paths(df, None), "conv_id", "leaf", "up_from_leaf", "node")
    assert every == sorted([("t", 2, 0, 2), ("t", 2, 1, 1), ("t", 5, 0, 5), ("t", 5, 1, 4), ("t", 5, 2, 3), ("t", 5, 3, 1), ("t", 6, 0, 6), (None, 1, 0, 1)], key=repr)
    best = {r["conv_id"]: r for r in chat.format_trees(df).collect()}
    assert set(best) == {"t", None} and best["t"]["leaf"] == 5 and best[None]["formatted"] == "<s>[ROLE]  [TEXT]  [/ROLE]"
    f = best["t"]["formatted"]
    assert f == "<s>[INST] root [/INST] good </s>[INST] more <\\/s> [/INST] deep [\\INST] </s>"
    assert [f[a:b] for a, b in best["t"]["loss_spans"]] == ["good", "deep [\\INST]"]
    assert chat.format_trees(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["[INST] ", " [/INST]", "</s>", "<s>", "[ROLE] ", " [TEXT] ", "\\", "[", "<", " ", "\n", "é", "😀", "x"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "[x] [TEXT] ", None, ""]), "".join(rng.choices(bits, k=rng.randrange(12))) if rng.random() < 0.9 else None) for c in range(12) for t in range(rng.randrange(1, 9))]
    turns += [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (3, None, "user", "no turn")]
    turns += [(77, t, "assistant", "long " * 3000) for t in range(40)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_trees(chat.from_turns(df)).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    for r in out:
        key = lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, (t[2] or "").encode(), t[3] is not None, (t[3] or "").encode())
        want = [(t[2] or "", t[3] or "") for t in sorted((t for t in turns if t[0] == r["conv_id"]), key=key)]
        assert [tuple(t) for t in r["turns"]] == want
        plain = "".join(r["formatted"][a:b] for a, b in r["loss_spans"]).replace("[\\", "[").replace("<\\", "<")
        assert plain == "".join(t for role, t in want if role == "assistant")


# --- decontamination -------------------------------------------------------------------------------------------------------------


def test_seeds_are_lossless():
    d = decontaminate
    clean = [{o + k for k, bit in enumerate(m) if bit == "1"} for m in d.SEEDS for o in range(d.WINDOW - len(m) + 1)]
    assert all(any(not c & set(bad) for c in clean) for bad in itertools.combinations(range(d.WINDOW), d.SUBSTITUTIONS))


def naive_overlap(doc, item):
    d, i = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (doc, item))
    n, bad = (13, 2) if len(i) >= 13 else (len(i), 0)
    return len(i) >= 6 and any(sum(x != y for x, y in zip(d[a : a + n], i[b : b + n])) <= bad for a in range(len(d) - n + 1) for b in range(len(i) - n + 1))


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 6, 8, 12, 13, 14, 25, 40])))) for k in range(25)] + [(100, None), (101, ""), (0, "again the same item id with another text of more than thirteen tokens in it")]
    docs = [(None, None), (None, items[0][1]), (1, ""), (2, "W1, w2")]
    for k in range(80):
        text = rng.choices(words, k=rng.randrange(1, 40))
        piece = items[rng.randrange(25)][1].split()
        at = rng.randrange(len(piece))
        piece = piece[at : at + rng.randrange(5, 30)] if k % 2 else piece
        for _ in range(rng.randrange(4)):
            piece[rng.randrange(len(piece)) if piece else 0 : 0] = []
            if piece:
                piece[rng.randrange(len(piece))] = "changed"
        docs.append((10 + k, " ".join([*text, *piece, *rng.choices(words, k=5)]).upper()))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(d, b).collect()}
    want = {(i, k) for i, t in docs for k, s in items if naive_overlap(t, s)}
    assert got == want and len(want) > 20
    kept = decontaminate.decontaminate(d, b)
    bad = {i for i, _ in want}
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(i or -1 for i, _ in docs if i not in bad)
    assert decontaminate.overlaps(d, b.limit(0)).count() == 0 and decontaminate.overlaps(d.limit(0), b).count() == 0


def test_decontamination_odd_inputs(spark, odd):
    bench = spark.createDataFrame([(1, "of a passage that is shared by several documents of this table line number"), (None, "a second document without id which is quite another one")], "item_id bigint, text string")
    out = decontaminate.decontaminate(odd, bench)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} == {1, 2, 3, 4, 5, 9}  # both rows without id share the id null


# --- quality ---------------------------------------------------------------------------------------------------------------------


def naive_metrics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(g) if g.count(x) > 1 for k in range(3)} if len(g) < 3000 else None
    lines = [x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n")]
    raw = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(raw) - len(set(raw)), len(covered) if covered is not None else None, len(lines)


def test_metrics_equal_plain_loops(spark, odd):
    more = spark.createDataFrame([(50, "a b c a b c a b c d"), (51, "x x x x"), (52, "a b c " * 70), (53, "é# b\n\n é# b\n\té# b\né# b"), (54, "a\u00a0b c\x85d")], "doc_id bigint, text string")
    df = odd.unionByName(more, allowMissingColumns=True)
    for r in df.select("doc_id", "text", *(m("text").alias(k) for k, m in quality.METRICS.items())).collect():
        n, chars, symbols, dup, rep, _ = naive_metrics(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, chars, symbols, dup), r["doc_id"]
        assert rep is None or r["n_repeat_words"] == rep, r["doc_id"]
    judged = quality.cascade(df)
    assert {r["doc_id"] for r in judged.collect() if r["rejected_by"] == "few_words"} >= {1, 2, 3, 5}
    assert quality.cascade(df.limit(0)).count() == 0


def test_order_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = docs
    orders = [quality.RULES, quality.RULES[::-1]]
    a, b = (rows(m.select("doc_id", quality.first_rejection(o).isNull().alias("kept")), "doc_id", "kept") for o in orders)
    assert a == b and len({k for _, k in a}) == 2
    found = [(r, c, s) for r, c, s in zip(quality.RULES, (1.0, 2.0, 1.0, 1.0, 1.0, 1.0), (0.1, 0.4, 0.0, 0.3, 0.0, 0.0))]
    assert [r.name for r in quality.by_rejection_per_cost(found)][:3] == ["dup_lines", "repeats", "few_words"]


def test_metrics_of_later_rules_are_made_in_their_branch_only(spark, odd):
    plan = entry.queries()["op6_quality_rules"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    places = [line.index("CASE WHEN") < line.index("p{L}") for line in plan.splitlines() if "p{L}" in line]
    assert places and all(places) and plan.count("p{L}") == len(places)
    rest = quality.cascade(odd)._jdf.queryExecution().optimizedPlan().toString()  # no metric at all below the decision
    assert all("xxhash64" not in line or line.index("CASE WHEN") < line.index("xxhash64") for line in rest.splitlines())
    out = quality.cascade(odd.withColumns({"kept": F.lit("x"), "n_letters": F.lit("y")}))
    assert dict(out.dtypes)["kept"] == "boolean" and {(r["n_words"], r["n_letters"]) for r in out.collect()} == {("x", "y")}


# --- urls ------------------------------------------------------------------------------------------------------------------------


def test_cascade_is_exact_on_its_universe(spark):
    keys = [f"k{i}" for i in range(4000)]
    for share in (0, 1, 40, 4000):
        cascade = urls.build(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(k,) for k in keys[:share] + ["elsewhere"]], "key string"))
        assert [urls.listed(k, cascade) for k in keys] == [i < share for i in range(4000)]
    assert len(cascade) == 1


def test_url_odd_inputs(spark):
    made = [None, "", "no scheme", "http://NET", "http://net/", "x://a.NET?q#/en/", "http://example.net/en/x", "http://sub.example.net/enx", "http://notexample.com/de/", "http://example.com/de/a?b", "http://a.org/fr/", "http://aorg/fr/", "http://a.org/fr", "http://://x", "a\nb://c.net/x\ny?z", "http://net:80/", "http://net."]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(made)] + [(0, None, "mine")], "page_id bigint, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, urls.rule_table(spark)).collect()}
    assert [got[i][2] for i in range(len(made))] == [None, None, None, None, "net/", None, "example.net/en/", "net/", None, "example.com/de/", "org/fr/", None, None, None, "net/", None, None]
    assert got[5][:2] == ("a.net", "") and got[14][:2] == ("c.net", "/x\ny") and got[13][:2] == (":", "//x")
    assert urls.judge(df.limit(0), urls.rule_table(spark)).count() == 0
    assert {r["verdict"] for r in urls.judge(df, urls.rule_table(spark).limit(0)).collect()} == {"allow"}


# --- secrets ---------------------------------------------------------------------------------------------------------------------


def test_spans_are_those_of_the_literal_patterns():
    rng = random.Random(3)
    bits = ["password", "Token", "api_key", "APIKEY", " : ", "=", '"', "'", "abcdefgh1", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "deadbeef", "\n", "é", " ", "secret=", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "ſecret=abcdefghijk"]
    for _ in range(600):
        t = "".join(rng.choices(bits, k=rng.randrange(14)))
        assert secrets.find(t, secrets.RULES[2]) == [m.span() for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        assert secrets.find(t, secrets.RULES[1]) == [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want = [m.span() for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 8]
        assert secrets.find(t, secrets.RULES[0]) == want


def test_ledger_scans_unseen_pairs_only(spark, odd, tmp_path):
    ledger = str(tmp_path / "ledger")
    leak = spark.createDataFrame([(60, "password = hunter2hunter2"), (61, "password = hunter2hunter2"), (61, None)], "doc_id bigint, text string")
    docs = odd.unionByName(leak, allowMissingColumns=True)
    blobs = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert secrets.update(docs, ledger) == blobs and secrets.update(docs, ledger) == 0
    new = docs.unionByName(spark.createDataFrame([(62, "brand new")], "doc_id bigint, text string"), allowMissingColumns=True)
    assert secrets.update(new, ledger) == 1
    changed = [*secrets.RULES[:-1], secrets.RULES[-1]._replace(pattern="-----BEGIN [A-Z ]*KEY-----")]
    before = spark.read.parquet(ledger).count()
    assert secrets.update(new, ledger, changed) == blobs + 1 and spark.read.parquet(ledger).count() == before + blobs + 1
    got = secrets.findings(new, ledger, changed)
    assert got.count() == new.count()
    assert rows(got.where("size(spans) > 0"), "doc_id", "spans") == [(60, [(0, 0, 25)]), (61, [(0, 0, 25)])] or [(i, [tuple(s) for s in x]) for i, x in rows(got.where("size(spans) > 0"), "doc_id", "spans")] == [(60, [(0, 0, 25)]), (61, [(0, 0, 25)])]
    assert secrets.update(docs.limit(0), ledger) == 0 and secrets.findings(docs.limit(0), ledger).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------------------


def test_poisson_table():
    for mean in (0.001, 0.7, 3.0, 120.0, 500.0):
        cdf = mixing.poisson_cdf(mean)
        term, total = np.exp(-mean), 0.0
        for k, c in enumerate(cdf[:400]):
            total += term
            assert abs(c - total) < 1e-9
            term *= mean / (k + 1)
        assert abs(cdf[-1] - 1) < 1e-9


def test_mixing_hits_its_targets(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 20_000, "hot").when(F.col("id") < 29_990, "warm").otherwise(None).alias("source"))
    n = {r["source"]: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()}
    assert all(abs(n[s] - 10_000) < 6 * np.sqrt(10_000) for s in ("hot", "warm", None))  # mean 1,000 per row without a source: two parts each
    weights = spark.createDataFrame([("hot", 1.0), ("warm", 3.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in mixing.mix(docs, weights, 8_000).groupBy("source").count().collect()}
    assert set(n) == {"hot", "warm"} and abs(n["hot"] - 2_000) < 300 and abs(n["warm"] - 6_000) < 500
    again = mixing.mix(docs.repartition(7)).select("doc_id", "copy").exceptAll(mixing.mix(docs).select("doc_id", "copy"))
    assert again.count() == 0


def test_mixing_beyond_the_broadcast_bound(spark, odd, monkeypatch):
    want = rows(mixing.mix(odd), "doc_id", "copy", "text", "shuffle_key")
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    out = mixing.mix(odd)
    assert rows(out, "doc_id", "copy", "text", "shuffle_key") == want
    assert out.columns == [c for c in odd.columns if c != "copy"] + ["copy", "shuffle_key"]
    assert mixing.mix(odd.limit(0)).count() == 0


# --- line dedup ------------------------------------------------------------------------------------------------------------------


def naive_line_dedup(docs, least=3, mass=50):
    """Texts less every later run of at least `least` lines or `mass` words, however long. docs: distinct (doc_id, text) in order of doc_id."""
    strip = " \t\n\x0b\x0c\r"
    seen, dead, out = set(), {i: set() for i, _ in docs}, {}
    for i, t in docs:
        u = [(k, x.strip(strip)) for k, x in enumerate((t or "").split("\n")) if x.strip(strip)]
        for a in range(len(u)):
            for b in range(a + 1, len(u) + 1):
                part = tuple(x for _, x in u[a:b])
                if len(part) >= least or sum(len(x.split()) for x in part) >= mass:
                    if part in seen:
                        dead[i] |= {k for k, _ in u[a:b]}
                    seen.add(part)
    for i, t in docs:
        left = [x for k, x in enumerate((t or "").split("\n")) if k not in dead[i]]
        if not dead[i]:
            out[i] = t
        elif any(x.strip(strip) for x in left):
            out[i] = "\n".join(left)
    return out


def test_line_dedup_equals_a_plain_loop(spark):
    rng = random.Random(11)
    pool = [f"line {k} " + " ".join("abcdefghij"[: rng.randrange(1, 10)]) for k in range(12)] + ["w " * 60 + "end", "", "   "]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 14)))) for i in range(60)] + [(60, None), (61, ""), (62, "same\n" * 9)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()} == naive_line_dedup(docs)


def test_line_dedup_extends_a_match_to_its_end(spark):
    n = lambda k, name: " ".join([name] * k)
    short_tail, word_tail = [n(60, "a"), n(5, "b"), n(5, "c")], [n(7, "d"), n(25, "e"), n(25, "f"), n(3, "g")]
    docs = [(k, "\n".join([f"start {k}", *run, f"end {k}"])) for k, run in enumerate([short_tail, short_tail, word_tail, word_tail])]
    docs += [(4, "\n".join([n(60, "h"), "tail of an exact copy"])), (5, "\n".join([n(60, "h"), "tail of an exact copy"]))]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1] == "start 1\nend 1" and got[3] == "start 3\nend 3" and 5 not in got and got == naive_line_dedup(docs)

    rng = random.Random(12)
    pool = [f"line {k} " + n(rng.randrange(1, 30), "x") for k in range(8)] + [n(60, "w")]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 12)))) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()}
    assert got == naive_line_dedup(docs)


def test_line_dedup_odd_inputs(spark, odd):
    out = linededup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "_deleted_lines"]
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(i or 0 for i, _ in got) == [0, 0, 1, 2, 3, 4, 5, 6, 8, 9] and dict(got)[8] == "own start\nown end"
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


