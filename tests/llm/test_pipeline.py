import corpus_pipeline
from parley.llm.common import read
from parley.llm.kneser_ney import judge
from tests.conftest import SF001
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute as brute_groups


def test_stages_on_the_smallest_tables(spark):
    """Each stage against a brute-force version on what it was given."""
    docs = read(spark, SF001, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs.collect(), None)
        docs = stage(spark, docs, SF001).cache()
        if name != "mixing":
            assert docs.columns == columns
        seen[name] = (seen[name][0], docs.collect())
    kept = {r.doc_id for r in judge(read(spark, SF001, "documents"), read(spark, SF001, "labels")).where("kn_keep").collect()}
    assert {r.doc_id for r in seen["quality_classifier"][1]} == kept
    before, after = seen["simhash_near_dedup"]
    groups = brute_groups([(r.doc_id, r.text) for r in before], 2)
    assert {r.doc_id for r in after} == {d for d, _, c in groups if d == c}
    before, after = seen["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in read(spark, SF001, "benchmark").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in before], items)
    again = brute_hits([(r.doc_id, r.text) for r in after], items)
    out = {r.doc_id: r for r in after}
    for r in before:
        words, hit = hits[r.doc_id][:2]
        assert (r.doc_id in out) == (hit <= 0.8 * words)
        if r.doc_id in out:
            assert again[r.doc_id][0] == words - hit and (hit or out[r.doc_id].text == r.text)
            assert out[r.doc_id].n_chars == len(out[r.doc_id].text)
    before, after = seen["mixing"]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    want = brute_targets(sizes)
    for s, target in want.items():
        taken = sum(r.mix_size * r.mix_copies for r in after if r.source == s)
        assert abs(taken - target) <= max(len(r.text.encode().split()) for r in before if r.source == s)


def test_run_returns_the_mix(spark):
    out = corpus_pipeline.run(spark, SF001)
    assert out.count() > 0 and {"doc_id", "text", "mix_copies"} <= set(out.columns)
