import corpus_pipeline
from siftwell.llm import piece_sampling
from siftwell.llm.queries import QUERIES

from .test_operators import kept_by_cosine


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_against_the_operators(spark, sf):
    """Each stage's survivors are those that its operator's own verdicts on the stage's input name."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        seen[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
        if name != "sentencepiece":
            assert docs.columns == names
    assert set(seen["language_id"][1]) == {k for k, r in seen["language_id"][0].items() if any(c.isalpha() for c in r.text or "")}
    before, after = seen["exact_dedup"]
    best = {}
    for k, r in before.items():
        group = "".join((r.text or "").split())
        best[group] = min(best.get(group, (1, 0)), (-len(r.text or ""), k))
    assert set(after) == {k for _, k in best.values()}
    before, after = seen["near_dedup"]
    texts = [(k, " ".join((r.text or "").split())) for k, r in before.items()]
    stay = kept_by_cosine(texts)
    assert stay <= set(after) and len(before) - len(after) >= 0.9 * (len(before) - len(stay))
    before, after = seen["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    shared = {s for t in items for s in shingles(t)}
    assert not any(i in r.text for r in after.values() for i in items)
    assert {k for k, r in before.items() if not shared & shingles(r.text)} <= set(after)
    before, after = seen["sentencepiece"]
    assert set(before) == set(after) and all(r.lossless and piece_sampling.decode(r.ids) == before[k].text for k, r in after.items())


def test_run_is_registered_and_repeatable(spark, sf):
    assert len(QUERIES) == 13
    a, b = (sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()) for _ in range(2))
    assert a == b and a
