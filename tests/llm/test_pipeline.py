"""The pipeline's stages against brute force, over one small folder of tables."""

import pytest

import corpus_pipeline
from tallyforge.llm import bytebpe, quality

from .test_operators import near_brute, squeeze, words

SF = "/root/testdata/sf0.001"


def windows(items):
    out = set()
    for _, t in items:
        w = words(t)
        k = min(13, len(w))
        out |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1) if k}
    return out


def contaminated(text, grams):
    """Whether words inside any window make a twentieth; each position is tried with each window size."""
    own, hit = words(text), set()
    for k in {len(g) for g in grams}:
        for i in range(len(own) - k + 1):
            if tuple(own[i : i + k]) in grams:
                hit.update(range(i, i + k))
    return bool(hit) and 20 * len(hit) >= len(own)


def test_odd_tables(spark, tmp_path):
    """Null and empty texts, repeated ids and rows, null ids; and no documents at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = docs.schema
    some = docs.limit(40).collect()
    rows = [tuple(r) for r in some] + [tuple(some[0])] * 2 + [tuple({**some[1].asDict(), "text": some[2].text + " more"}.values()), tuple({**some[3].asDict(), "text": None}.values()), (None, some[4].text, None, None, None), (900_001, None, None, None, None), (900_002, "", "xx", None, 0), (900_003, "word " * 50_000, "en", "s", 1)]
    for name, table in (("odd", rows), ("none", [])):
        d = tmp_path / name
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
        spark.createDataFrame(table, kinds).write.parquet(f"{d}/documents.parquet")
        kept = corpus_pipeline.run(spark, str(d)).collect()
        assert len({r.doc_id for r in kept if r.doc_id is not None} - {r[0] for r in table}) == 0 and all(r.n_tokens == len(r.ids) for r in kept)
        assert (name == "none") == (not kept)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, before, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, before.collect(), docs.collect(), before.columns, docs.columns))
    return out


def test_columns(stages):
    assert 4 <= len(stages) <= 5
    assert all(before == after for *_, before, after in stages[:-1])


def test_each_stage(spark, stages):
    by = {name: (before, after) for name, before, after, *_ in stages}
    before, after = by["quality"]
    trees = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    scores = trees.score(quality.document_statistics(pa.array([r.text for r in before])))
    assert {r.doc_id for r in after} == {r.doc_id for r, s in zip(before, scores, strict=True) if s >= 0.3}
    before, after = by["exact_dedup"]
    groups = {}
    for r in before:
        groups.setdefault(squeeze(r.text), []).append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(min(g)[1] for g in groups.values())
    before, after = by["near_dedup"]
    classes = near_brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if classes.get(r.doc_id, (r.doc_id, 0))[0] == r.doc_id)
    before, after = by["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not contaminated(r.text, windows(items)))
    before, after = by["byte_bpe"]
    bpe = bytebpe.load(*bytebpe.vocabulary())
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} == set(texts) and all(bpe.decode(r.ids) == texts[r.doc_id].encode() and r.n_tokens == len(r.ids) for r in after)


def test_run(spark, stages):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in stages[-1][2])
