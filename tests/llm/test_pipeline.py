import hashlib

import awkward
import corpus_pipeline
from fieldloom.llm import mixing, perplexity
from fieldloom.session import stage
from test_jaccard import brute
from test_native import brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Every stage on what its predecessor kept, each against a plain version of its rule."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r.doc_id: r for r in perplexity.judge(docs).collect()}
    first = stage(corpus_pipeline.quality_rules(spark, docs, SF), "t1")
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {d for d, r in judged.items() if r.kept}
    assert all(r.n_words >= 50 and 2 * r.n_repeat_words <= r.n_words for r in judged.values() if r.kept)

    second = stage(corpus_pipeline.drop_repeated_lines(spark, first, SF), "t2")
    want = {d: t for d, _, _, t in brute_lines([(r.doc_id, r.text) for r in first.collect()], 10)}
    assert second.schema.names == docs.columns and {r.doc_id: r.text or "" for r in second.collect()} == want
    assert all(r.n_chars == len(r.text) for r in second.collect() if r.text is not None)

    third = stage(corpus_pipeline.drop_near_copies(spark, second, SF), "t3")
    groups = brute([(r.doc_id, r.text) for r in second.collect()])
    assert {r.doc_id for r in third.collect()} == {d for d, n, c in groups if c == d or not n}

    fourth = stage(corpus_pipeline.drop_benchmark_leaks(spark, third, SF), "t4")
    plain = lambda t: " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, whole = {r.doc_id for r in fourth.collect()}, {r.doc_id: plain(r.text) for r in third.collect()}
    assert all(not any(i in t for i in items) for d, t in whole.items() if d in kept)
    dropped = [d for d in whole if d not in kept]
    assert all(any(len(set(i.split()) & set(whole[d].split())) > 5 for i in items) for d in dropped)

    last = corpus_pipeline.mix_sources(spark, fourth, SF).collect()
    assert {r.doc_id for r in last} <= kept and len({r.source for r in last}) > 3
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: hashlib.sha256(repr(sorted((r.doc_id, r["pass"], r.mix_pos) for r in rows)).encode()).hexdigest()
    assert key(again) == key(last)


def test_stages_take_awkward_documents(spark):
    for docs in (awkward.frame(spark), awkward.empty(spark)):
        for _, function in corpus_pipeline.STAGES[:-1]:
            docs = function(spark, docs, SF)
            assert docs.columns == awkward.frame(spark).columns
        assert mixing.mix(docs).count() >= 0
