"""The corpus pipeline: each stage on its own input against brute force, and the chain as a whole."""

import corpus_pipeline as pipeline
from scorefold.llm import langid, simhash
from tests.llm.conftest import SF
from tests.llm.test_operators import brute_components, naive_fingerprint, naive_line_dedup, naive_overlap


def test_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]

    model = langid.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    judged = {i: langid.predict(t, model) for i, t in texts.items()}
    first = stages["language_id"](spark, docs, SF)
    assert first.columns == names
    assert {r["doc_id"] for r in first.collect()} == {i for i, (x, s) in judged.items() if x != "und" and s >= model.threshold}

    second = stages["line_dedup"](spark, docs, SF)
    assert second.columns == names
    got = {r["doc_id"]: r for r in second.collect()}
    assert {i: r["text"] for i, r in got.items()} == naive_line_dedup(sorted(texts.items()))
    assert all(r["n_chars"] == len(r["text"]) for i, r in got.items() if r["text"] != texts[i])

    third = stages["simhash_near_dedup"](spark, docs, SF)
    prints = {i: naive_fingerprint(t) for i, t in texts.items()}
    roots = brute_components(set(prints.values()))
    smallest = {}
    for i, p in prints.items():
        smallest[roots[p]] = min(i, smallest.get(roots[p], i))
    assert third.columns == names and sorted(r["doc_id"] for r in third.collect()) == sorted(smallest.values())

    fourth = stages["benchmark_decontamination"](spark, docs, SF)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert fourth.columns == names
    assert {r["doc_id"] for r in fourth.collect()} == {i for i, t in texts.items() if not any(naive_overlap(t, s) for s in items)}

    fifth = stages["source_mixing"](spark, docs, SF)
    assert fifth.columns == [*names, "copy", "shuffle_key"]


def test_run_and_odd_inputs(spark, odd):
    assert pipeline.run(spark, SF).count() > 0
    docs = odd
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "source_mixing":
            assert out.columns == odd.columns, name
            docs = out
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert simhash.MAX_BITS == 3
