"""The pipeline's stages against plain loops over the smallest test tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import best_fit_plainly, ignored, shingles
from tidemark.llm import common, packing, secrets, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    # Toxicity: each text scored by itself.
    model = toxicity.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    lexicon = toxicity.Lexicon(model.words, model.stems)
    clean = {r.doc_id for r in first.collect() if toxicity.score(toxicity.features(toxicity.matches(r.text or "", lexicon))[None, :], model)[0] < corpus_pipeline.TOXIC}
    assert {r.doc_id for r in kept["toxicity"]} == clean
    texts = [ignored(r.text) for r in kept["exact_dedup"]]
    assert len(texts) == len(set(texts)) and set(texts) == {ignored(r.text) for r in kept["toxicity"]}
    sets = {r.doc_id: shingles(r.text) for r in kept["exact_dedup"]}
    stays = [r.doc_id for r in kept["ngram_join"]]
    near = lambda a, b: bool(a) and len(a & b) >= 0.8 * len(a | b)
    assert not any(near(sets[a], sets[b]) for k, a in enumerate(stays) for b in stays[:k])
    assert all(d in stays or any(near(sets[d], sets[o]) for o in sets if o != d) for d in sets)
    assert sorted(r.doc_id for r in kept["secrets"]) == sorted(stays)
    texts, plain = {r.doc_id: r.text for r in kept["ngram_join"]}, {r.doc_id: r for r in kept["secrets"]}
    before = docs.sparkSession.createDataFrame(kept["ngram_join"], first.schema)
    for r in secrets.scan(before, secrets.fit(before)).collect():
        want = texts[r.doc_id] or ""
        for f in sorted(r.findings, key=lambda f: -f.start):
            want = want[: f.start] + "[SECRET]" + want[f.end :] if f.secret else want
        assert (plain[r.doc_id].text or "") == want
        assert plain[r.doc_id].n_chars == (len(want) if want != (texts[r.doc_id] or "") else r.n_chars)
    held = sum(len((r.text or "").encode()) for r in kept["secrets"])
    assert sum(r.size for r in kept["packing"]) == held


def test_packing_rows_against_a_plain_version(spark):
    """One block: the lines that the plain loop gives for the documents in order of falling rest."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, capacity = docs.collect(), packing.CAPACITY
    sized = sorted(((len((r.text or "").encode()), r.doc_id, r.source, ignored(r.text)) for r in rows), key=lambda x: (-x[0], x[1]))
    rest = sorted(sized, key=lambda x: -(x[0] % capacity))
    packed = [x for x in rest if x[0] % capacity or not x[0]]
    plain = best_fit_plainly([(x[0] % capacity, x[2], x[3]) for x in packed], capacity)
    lines = packing.pack(docs, block=len(rows)).collect()
    tails = {(r.doc_id, r.size, r.offset) for r in lines if r.start == max(o.start for o in lines if o.doc_id == r.doc_id) and (r.size % capacity or not r.size)}
    assert tails == {(x[1], x[0] % capacity, at) for x, (_, at) in zip(packed, plain)}
    assert len({r.bin for r in lines}) == sum(x[0] // capacity for x in sized) + len({b for b, _ in plain})


def test_columns_of_any_name_pass_through(spark):
    names = ["toxicity", "clauses", "findings", "own", "__source", "__id", "__digest", "length", "start", "name", "n_chars"]
    draw, rows = random.Random(4), []
    for k in range(60):
        text = " ".join(draw.choice(["river", "stone", "paper", "garden"]) for _ in range(30)) + (" password=aB3dE6gH9jK2mN5p" if k % 7 == 0 else "")
        rows.append((k if k % 9 else None, None if k == 5 else text, "en", "s", *[f"{n}-{k}" for n in names[:-1]], 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names[:-1]) + ", n_chars int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        for r in out.collect():
            k = int(r.own.split("-")[1])
            assert [r[n] for n in names[:-1]] == [f"{n}-{k}" for n in names[:-1]] and r.doc_id == rows[k][0], name
    assert stage(spark, docs.drop("n_chars"), SF).columns == docs.columns[:-1]
    assert all(stage(spark, docs.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    lines = corpus_pipeline.run(spark, SF)
    assert lines.columns == ["bin", "doc_id", "piece", "start", "size", "offset"]
    assert lines.groupBy("bin").agg(F.sum("size").alias("n")).where(F.col("n") > packing.CAPACITY).isEmpty() and lines.count() > 0
    assert len(list(tmp_path.glob("tidemark-*/*"))) == 1  # the last stage's input, which its lines are still made from
