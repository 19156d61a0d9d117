"""Every registered corpus query on the smallest tables: columns, types, laws, and SQL or plain versions."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from tests.llm.test_operators import ignored, shingles
from tidemark.llm import queries as q
from tidemark.llm import sharding

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op3_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op4_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_packing": "bin bigint, doc_id bigint, piece bigint, start bigint, size bigint, offset bigint",
    "op7_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_ngram_join": "doc_id bigint, class_id bigint, n_links bigint",
    "op9_secrets": "doc_id bigint, start int, end int, score double, predicted int",
    "op10_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op13_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
}


@pytest.fixture(scope="module")
def results(spark):
    held = {}

    def get(name):
        if name not in held:
            table = q.QUERIES[name](spark, SF)
            held[name] = ", ".join(f"{c} {t}" for c, t in table.dtypes), table.collect()
        return held[name]

    return get


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(results, name):
    assert set(q.QUERIES) == set(COLUMNS) and results(name)[0] == COLUMNS[name] and results(name)[1]


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(results, name):
    base = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    names = [c.split()[0] for c in COLUMNS[name].split(", ")]
    want = base.execute(f"SELECT {', '.join(names)} FROM ({q.SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in results(name)[1])


def test_bpe(results, docs):
    tiktoken = pytest.importorskip("tiktoken")
    from tidemark.llm import bpe

    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.Coder(bpe.read_ranks(q._ranks())).ranks, special_tokens={})
    for r in results("op1_byte_bpe")[1]:
        text = docs[r.doc_id].text or ""
        ids = own.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_ann(spark, results):
    rows = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hit = total = 0
    for own, v in rows:
        if own % 100:
            continue
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        d[ids == own] = np.inf
        best = ids[np.lexsort((ids, d))[:10]].tolist()
        got = sorted((r.rank, r.vec_id, r.score) for r in results("op2_ann")[1] if r.query_id == own)
        assert [k for k, *_ in got] == list(range(1, 11)) and all(abs(s - d[np.flatnonzero(ids == i)[0]]) < 1e-9 for _, i, s in got)
        hit, total = hit + len({i for _, i, _ in got} & set(best)), total + 10
    assert hit >= 0.9 * total


@pytest.mark.parametrize("name, modulus, rest", [("op5_toxicity", 3, 1), ("op7_language_id", 4, 2)])
def test_held_out_rows_and_scores(spark, results, docs, name, modulus, rest):
    found = results(name)[1]
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1 for r in found)
    if name == "op5_toxicity":
        assert all(r.predicted == int(r.score >= 0.7) for r in found)
        marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
        held = [(r.predicted, marks[r.doc_id]) for r in found if r.held_out and r.doc_id in marks]
        assert sum(p == t for p, t in held) >= 0.9 * len(held)  # from a hundred labels
    else:
        held = [(r.lang_pred, docs[r.doc_id].lang) for r in found if r.held_out and docs[r.doc_id].lang and any(c.isalpha() for c in docs[r.doc_id].text or "")]
        assert sum(p == t for p, t in held) >= 0.9 * len(held)
        assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or "")) for r in found)


def test_packing(results, docs):
    bins, pieces = {}, {}
    for r in results("op6_packing")[1]:
        bins.setdefault(r.bin, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for held in bins.values():
        assert sum(r.size for r in held) <= 8192
        for mark in (lambda d: d.source, lambda d: ignored(d.text)):
            marks = [mark(docs[r.doc_id]) for r in held if mark(docs[r.doc_id]) is not None]
            assert len(marks) == len(set(marks))
    for i, d in docs.items():
        spans, end = sorted((r.start, r.size) for r in pieces[i]), 0
        for start, size in spans:
            assert start == end
            end += size
        assert end == len((d.text or "").encode())


def test_join(results, docs):
    sets = {i: shingles(d.text) for i, d in docs.items()}
    links = {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    label = {i: i for i in sets}
    while (after := {i: min([label[i], *(label[j] for j in links[i])]) for i in sets}) != label:
        label = after
    assert sorted(tuple(r) for r in results("op8_ngram_join")[1]) == sorted((i, label[i], len(links[i])) for i in sets)


def test_secrets(results, docs):
    assert all(docs[r.doc_id].text[r.start : r.end].strip() and r.predicted == int(r.score >= 0.5) for r in results("op9_secrets")[1])


def test_sharding(spark, results, docs):
    """The shards of a plain loop: texts in the order of their digests, cut where the least capacity and even shares say."""
    found = results("op10_sharding")[1]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found) == sorted((i, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for i, d in docs.items())
    assert {r.law for r in found} == {"bytes"} and all(r.grown_shard is None for r in found)
    for shard in range(16):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    of_text, sizes = {}, {}
    for r in found:
        of_text.setdefault(docs[r.doc_id].text or "", set()).add(r.shard)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in of_text.values())
    groups = {}
    for d in docs.values():
        groups[d.text or ""] = groups.get(d.text or "", 0) + len((d.text or "").encode()) + 1
    digests = {r.text: r.digest for r in spark.createDataFrame([(t,) for t in groups], "text string").selectExpr("text", "xxhash64(text) AS digest").collect()}
    order = sorted(groups, key=digests.get)
    weights = np.array([groups[t] for t in order])
    assert max(sizes.values()) == sharding.smallest_capacity(weights, 16)  # the least for whole groups in this order
    assert [s for t in order for s in of_text[t]] == sorted(s for t in order for s in of_text[t])
