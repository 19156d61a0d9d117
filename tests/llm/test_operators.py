"""Operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, exact_dedup, language_id, ngram_join, packing, secrets, sharding, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, row long, ids string, cluster int, __source string, __id string, __digest string"


def documents(spark, rows):
    """(doc_id, text, lang, source) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "own", 7, "mine", 1, "a", "b", "c") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def mixed(spark):
    words = random.Random(5)
    long = " ".join(words.choice(["alpha", "beta", "gamma", "delta", "épsilon"]) for _ in range(30_000))
    rows = [
        (0, "The cat sat on the mat today.", "en", "a"), (1, "The  cat sat\ton the mat today.", "en", "a"), (2, None, None, None), (3, "", "de", "b"), (None, "nobody", "en", "b"),
        (4, long, "en", "c"), (5, long + " end", "en", "c"), (6, "  \n", "fr", "a"), (7, "don't stop 12 ٣ 日本 😀 's!!", "en", "a"), (7, "don't stop 12 ٣ 日本 😀 's!!", "en", "a"), (8, long, "en", None),
    ]
    return documents(spark, rows).cache()


def ranks_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")


def test_boundaries_are_those_of_the_pattern():
    regex, coder = pytest.importorskip("regex"), None
    draw = random.Random(1)
    table = bpe.class_table()
    for _ in range(3000):
        text = "".join(draw.choice("ab s'tre'lvmd  \n\t é12٣!?.-_ S日😀") for _ in range(draw.randrange(1, 40)))
        points = np.frombuffer((text + "\n").encode("utf-32-le"), dtype=np.uint32)
        starts = bpe.boundaries(bpe.symbols(points, np.array([len(text)]), table)).tolist()
        assert [text[a:b] for a, b in zip(starts, starts[1:])] == regex.findall(bpe.PATTERN, text), text
    assert coder is None


def test_boundaries_do_not_depend_on_segments(monkeypatch):
    text = "I'll  say 'tis 12 o'clock, they've  \n gone!! " * 40
    points = np.frombuffer((text + "\n").encode("utf-32-le"), dtype=np.uint32)
    symbol = bpe.symbols(points, np.array([len(text)]), bpe.class_table())
    whole = bpe.boundaries(symbol).tolist()
    for width in (1, 3, 17):
        monkeypatch.setattr(bpe, "SEGMENT", width)
        assert bpe.boundaries(symbol).tolist() == whole


def test_bpe_matches_the_library_and_round_trips(spark, mixed):
    tiktoken = pytest.importorskip("tiktoken")
    coder = bpe.Coder(bpe.read_ranks(ranks_path()))
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    coded = bpe.decode(bpe.encode(mixed, ranks_path()), ranks_path())
    for r in coded.collect():
        assert r.ids == own.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.offsets[-1:] in ([], [len((r.text or "").encode()) - len(coder.pieces[r.ids[-1]])] if r.ids else [])
        assert r.name == "own"
    assert bpe.encode(mixed.limit(0), ranks_path()).count() == 0


def test_tokens_are_decoded_at_their_offsets():
    coder = bpe.Coder(bpe.read_ranks(ranks_path()))
    one, two = coder.encode(["low tide", "a b"])
    at = [coder.offsets(x) for x in (one, two)]
    both = lambda xs: np.concatenate(xs).astype(np.int64)
    assert coder.decode(both([one, two]), both(at), np.array([len(one), 0, len(two)])) == [b"low tide", b"", b"a b"]
    assert coder.decode(both([one[1:]]), both([at[0][1:] - at[0][1]]), np.array([len(one) - 1])) == [b"low tide"[at[0][1] :]]
    assert coder.decode(both([one]), both([at[0] + 3]), np.array([len(one)])) == [b"\0\0\0low tide"]  # offsets decide, not the order


@pytest.mark.parametrize("piece", [b"x" * 500, "é日".encode() * 200, b"abcabc" * 90])
def test_long_pieces_merge_alike(piece):
    coder = bpe.Coder(bpe.read_ranks(ranks_path()))
    short = coder.merge(piece[:90])
    assert coder._merge_long(piece[:90]) == short
    assert b"".join(coder.pieces[i] for i in coder.merge(piece)) == piece


def test_ann_reaches_its_recall_and_leaves_odd_vectors_out(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32))
    rows = [(k, [float(v) for v in r], "c") for k, r in enumerate(x)]
    rows += [(3000, None, "c"), (3100, [0.0] * 32, "c"), (3200, [float("nan")] * 32, "c"), (3300, [1.0] * 31 + [None], "c"), (None, [1.0] * 32, "c"), (3400, [1.0, 2.0], "c"), (0, rows[0][1], "c")]
    rows += [(4000 + k, rows[5][1], "c") for k in range(12)]  # copies: ties by id
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket string")
    found = ann.search(table, table.where("vec_id % 100 = 0 OR vec_id = 5")).collect()
    ids, full = np.array([*range(3000), *range(4000, 4012)]), np.vstack([x, np.repeat(x[5:6], 12, axis=0)])
    hit = total = 0
    for q in [*range(0, 3000, 100), 5]:
        d = np.sqrt(((full - x[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        own = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        hit += len({int(ids[k]) for k in best} & {v for _, v, _ in own})
        total += 10
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(abs(s - d[np.flatnonzero(ids == v)[0]]) < 1e-9 for _, v, s in own)
    assert hit / total >= 0.9
    assert [r.vec_id for r in sorted((r for r in found if r.query_id == 5), key=lambda r: r["rank"])] == list(range(4000, 4010))
    assert not {r.query_id for r in found} & {3000, 3100, 3200, 3300}
    assert ann.search(table.limit(0), table.limit(0)).count() == 0


def test_ann_gives_all_candidates_if_they_are_few(spark):
    table = spark.createDataFrame([(k, [float(k + 1), 1.0, -float(k)]) for k in range(6)], "vec_id long, embedding array<double>")
    assert ann.search(table, table.where("vec_id = 0")).count() == 5


@pytest.mark.parametrize("size", [64, 256, 768])
def test_ann_recall_is_that_of_the_rule(spark, monkeypatch, size):
    monkeypatch.setattr(ann, "SHELF_BYTES", 1 << 18)  # several shelves and parts
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, size))
    x = np.vstack([rng.normal(size=(1500, size)), centres[rng.integers(0, 40, 1500)] + 0.5 * rng.normal(size=(1500, size))]).astype(np.float32)
    table = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    found, hit = ann.search(table, table.where("vec_id % 50 = 0")).collect(), 0
    x = x.astype(np.float64)
    for q in range(0, 3000, 50):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len({*np.argsort(d)[:10].tolist()} & {r.vec_id for r in found if r.query_id == q})
    print("recall", hit / 600)
    assert hit / 600 >= 0.9


def test_ann_ranks_buckets_as_it_probes_them():
    rng = np.random.default_rng(6)
    for rotations in (1, 2, 3):
        near = rng.normal(size=(rotations, 8))
        sums = {sum(8**k * a for k, a in enumerate(axes)): sum(near[k, a] for k, a in enumerate(axes)) for axes in np.ndindex(*[8] * rotations)}
        order = sorted(sums, key=lambda b: -sums[b])
        assert ann.rank_of(near, np.array(order)).tolist() == list(range(len(order)))
        assert set(ann.best_buckets(near, 5).tolist()) == set(order[:5])
    assert ann.rotations_for(1000, 64) == 2 and ann.rotations_for(10**11, 64) == 3


def test_ann_counts_a_repeated_candidate_once(spark):
    x = np.random.default_rng(5).normal(size=(40, 8))
    rows = [(k, row.tolist()) for k, row in enumerate(x)]
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    order = np.argsort(d)[1:]  # the query itself is the first
    first = int(order[0])
    again = [(first, (2 * x[0] - x[first]).tolist()), (first, (x[first] * 3).tolist())]  # the same id elsewhere: as far off, and farther
    table = spark.createDataFrame(rows + rows[first : first + 1] * 12 + again, "vec_id long, embedding array<double>")
    query = table.where("vec_id = 0")
    for tables in (8, 1):
        found = sorted((r["rank"], r.vec_id, r.score) for r in ann.search(table, query, tables=tables, recall=1.0).collect())
        assert [v for _, v, _ in found] == order[:10].tolist()
        assert np.allclose([s for *_, s in found], d[order[:10]])


def test_url_rules(spark):
    urls = ["https://www.example.org/es/1", "http://EXAMPLE.org/en/12?x", "http://a.b.org/x", "http://org", "x.com/fr/", None, "", "http://x.com/fr/1", "http://x.com/de/?q", "http://cheap-pills.net/1", "ftp://fxorg/", "http://x.net/a#://y.org/", "http://notexample.org/es/1"]
    pages = spark.createDataFrame([(k % 7, u, "h", "t") for k, u in enumerate(urls)] + [(0, urls[0], "h", "t")], "page_id long, url string, html string, token string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert url_filter.judge(pages).count() == len(urls) + 1
    assert got[0, "www.example.org", "/es/1"] == ("example.org/es/", "block")
    assert got[1, "example.org", "/en/12"] == ("example.org/en/1", "block")
    assert got[2, "a.b.org", "/x"] == ("org/", "allow")
    assert got[3, "org", ""] == (None, "allow")
    assert got[5, "", ""] == (None, "allow")
    assert got[0, "x.com", "/fr/1"] == ("com/fr/", "allow")
    assert got[1, "x.com", "/de/"] == ("com/de/", "block")
    assert got[2, "cheap-pills.net", "/1"] == (None, "block")
    assert got[3, "fxorg", "/"] == (None, "allow")
    assert got[4, "x.net", "/a"] == (None, "allow")
    assert got[5, "notexample.org", "/es/1"] == ("org/", "allow")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_every_rule_has_a_literal():
    assert all(r.tokens for r in url_filter.SITE_RULES + url_filter.PATTERNS)


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([("http://a.org/es/1",), ("http://b.org/x",), ("http://example.org/es/2",)], "url string")
    keys = {r.rule: r.token for r in url_filter.index(pages, "url", url_filter.SITE_RULES).collect()}
    assert keys["example.org/es/"] == "example" and keys["org/"] == "org" and keys["example.org/en/1"] == "en"


def ignored(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_dedup_against_brute_force(spark, mixed):
    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(ignored(t), []).append((-len(t or ""), math.inf if i is None else i))
    found = exact_dedup.mark(mixed).collect()
    assert len(found) == len(rows)
    for r in found:
        group = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(group)
        assert (math.inf if r.keep_id is None else r.keep_id) == min(group)[1]
    assert sum(r.kept for r in found) == len(groups)
    assert len({(r.text_sha256, r.identity) for r in found}) == len({r.text_sha256 for r in found}) == len({r.identity for r in found})
    assert exact_dedup.mark(mixed.limit(0)).count() == 0
    kept = exact_dedup.keep_first(mixed)
    assert kept.columns == mixed.columns and {ignored(r.text) for r in kept.collect()} == set(groups) and kept.count() == len(groups)


def test_block_names_tell_texts_apart(spark):
    base = "ab" * 40
    texts = [base, base, base + "c", base[:-1] + "x", "x" + base[1:], "", "a", base * 2, base * 2]
    table = spark.createDataFrame(list(enumerate(texts)), "row long, norm string")
    names = {r.row: (r.blocks, r.name) for r in exact_dedup.identities(exact_dedup.Scratch(spark), table, block=8).collect()}
    assert all((names[i] == names[j]) == (texts[i] == texts[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_toxicity_learns_from_labels_and_reads_clauses(spark):
    draw = random.Random(3)
    calm = ["river", "stone", "paper", "window", "garden", "yellow", "music", "north"]
    rows, labels = [], []
    for k in range(900):
        words = [draw.choice(calm) for _ in range(40)]
        toxic = k % 9 == 0
        if toxic:
            for _ in range(3):
                words[draw.randrange(40)] = draw.choice(["zorkel", "zorkling", "zorkish", "moron"])
        rows.append((k, " ".join(words) + ".", "en", "s"))
        labels.append((k, 1, int(toxic)))
    docs, marks = documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs.where(toxicity.fold("doc_id", 3) != 1), marks)
    scored = toxicity.assess(docs, model).select("doc_id", "toxicity").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all((r.toxicity >= 0.7) == (r.doc_id % 9 == 0) for r in held)
    odd = toxicity.assess(documents(spark, [(1, None, None, None), (2, "", None, None), (2, "", None, None)]), model).collect()
    assert len({r.toxicity for r in odd}) == 1 and odd[0].toxicity < 0.5
    assert toxicity.assess(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, marks.limit(0)).words.keys() == set(toxicity.INSULTS)


def test_grammar_marks_negation_target_and_reports():
    lexicon = toxicity.Lexicon({"idiot": 2.0}, {})
    kinds = lambda text: [(k, text[a:b]) for a, b, k, _ in toxicity.matches(text, lexicon)]
    threat = toxicity.KINDS // 2
    assert kinds("what an idiot") == [(0, "idiot")]
    assert kinds("you are an idiot") == [(toxicity.AIMED | toxicity.TOLD, "idiot")]
    assert kinds("you met an idiot") == [(toxicity.AIMED, "idiot")]
    assert kinds("such an idiot") == kinds("a complete idiot") == [(toxicity.TOLD, "idiot")]
    assert kinds("no idiot here") == [(toxicity.NEGATED, "idiot")]
    assert kinds("she said idiot") == [(toxicity.AIMED | toxicity.REPORTED, "idiot")]
    assert kinds("she said. an idiot") == [(0, "idiot")]
    assert kinds("kill time") == [] and kinds("kill you") == [(threat + toxicity.AIMED, "kill")]
    assert kinds("i will kill you") == [(threat + toxicity.AIMED + toxicity.TOLD, "kill")]
    assert kinds("you will not regret it") == [(threat + toxicity.AIMED + toxicity.TOLD + toxicity.NEGATED, "regret")]
    assert kinds("you pay rent") == [] and kinds("he is going to pay") == [(threat + toxicity.AIMED + toxicity.TOLD, "pay")]


def plain_matches(words, lexicon):
    """What the grammar should find in one clause, each condition looked up by itself."""
    cls = [lexicon[w][0] for w in words]
    base, has = [c & 7 for c in cls], lambda k, flag: bool(cls[k] & flag)
    out = []
    for k, kind in enumerate(base):
        announced = any(has(j, toxicity.ANNOUNCEMENT) for j in range(max(0, k - toxicity.REACH), k))
        aimed = any(c & toxicity.TARGET for c in cls)
        if kind not in (toxicity.INSULT, toxicity.THREAT, toxicity.VEIL) or kind != toxicity.INSULT and not aimed or kind == toxicity.VEIL and not announced:
            continue
        heightened = any(has(j, toxicity.HEIGHTENER) for j in range(max(0, k - toxicity.APART - 1), k))
        called = any(has(j, toxicity.COPULA) and (has(j, toxicity.TARGET) or j and has(j - 1, toxicity.TARGET)) for j in range(max(0, k - toxicity.BETWEEN - 1), k))
        marks = toxicity.AIMED * aimed
        marks |= toxicity.NEGATED * any(base[j] == toxicity.NEGATION for j in range(max(0, k - toxicity.REACH), k))
        marks |= toxicity.REPORTED * any(base[j] == toxicity.REPORT for j in range(k))
        marks |= toxicity.TOLD * (heightened or called if kind == toxicity.INSULT else announced)
        out.append((k, marks if kind == toxicity.INSULT else toxicity.KINDS // 2 + marks))
    return out


def test_grammar_against_plain_conditions():
    draw, lexicon = random.Random(11), toxicity.Lexicon({"idiot": 2.0, "stupid": 1.0}, {"zork": 1.5})
    words = ["idiot", "stupid", "zorkel", "kill", "regret", "will", "you'll", "you", "you're", "are", "such", "not", "said", "river", "stone", "an"]
    for _ in range(3000):
        clauses = [[draw.choice(words) for _ in range(draw.randrange(0, 9))] for _ in range(draw.randrange(1, 4))]
        text, places, want = "", [], []
        for clause in clauses:
            places = []
            for w in clause:
                places.append(len(text))
                text += w + " "
            text += ". "
            want += [(places[k], kind) for k, kind in plain_matches(clause, lexicon)]
        assert [(a, kind) for a, _, kind, _ in toxicity.matches(text, lexicon)] == want, text


def best_fit_plainly(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and cluster not in b["clusters"] and (source is None or source not in b["sources"])]
        if fits:
            k = min(fits)[1]
        else:
            bins.append({"left": capacity, "clusters": set(), "sources": set()})
            k = len(bins) - 1
        out.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= size
        bins[k]["clusters"].add(cluster)
        bins[k]["sources"].add(source)
    return out


def test_packing_is_the_tightest_compatible_bin():
    draw = random.Random(2)
    for _ in range(60):
        items = sorted(((draw.randrange(0, 60), draw.choice([None, "a", "b", "c", "d"]), draw.randrange(12)) for _ in range(80)), key=lambda x: -x[0])
        assert packing.best_fit(items, 100) == best_fit_plainly(items, 100)


def test_packing_keeps_every_byte_and_every_rule(spark, mixed):
    lines = packing.pack(mixed, capacity=512, block=4).collect()
    rows = mixed.collect()
    assert sum(r.size for r in lines) == sum(len((r.text or "").encode()) for r in rows)
    bins = {}
    for r in lines:
        bins.setdefault(r.bin, []).append(r)
    for held in bins.values():
        assert sum(r.size for r in held) <= 512
        spans = sorted((r.offset, r.offset + r.size) for r in held)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    source = {r.doc_id: r.source for r in rows}
    for held in bins.values():
        named = [source[r.doc_id] for r in held if source[r.doc_id] is not None and r.doc_id is not None]
        assert len(named) == len(set(named))
    assert packing.pack(mixed.limit(0)).count() == 0


def test_packing_splits_a_block_of_repeated_rows(spark):
    docs = spark.range(20_000).repartition(4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("s").alias("source"))
    lines = packing.pack(docs)
    blocks = lines.groupBy(F.shiftright("bin", 32).alias("block")).count().collect()
    assert sum(r["count"] for r in blocks) == 20_000 and max(r["count"] for r in blocks) < 2 * packing.BLOCK
    assert lines.select("bin").distinct().count() == 20_000  # one cluster: never two in a bin


@pytest.mark.parametrize("combined", [1 << 22, 0])
def test_ann_buckets_are_the_best(monkeypatch, combined):
    monkeypatch.setattr(ann, "COMBINED", combined)
    rng = np.random.default_rng(3)
    for wide, rotations, probes in ((40, 2, 100), (40, 2, 1_600), (40, 2, 5_000), (12, 3, 300), (60, 1, 7)):
        near = np.round(rng.normal(size=(rotations, wide)), 1)  # ties
        got = ann.best_buckets(near, probes)
        total = np.zeros(1)
        for axes in near[::-1]:
            total = (total[:, None] + axes[None, :]).ravel()  # the last rotation counts most, as in a bucket's number
        sums = sum(near[k][got // wide**k % wide] for k in range(rotations))
        want = np.sort(total)[::-1][:probes]
        assert len(set(got.tolist())) == len(got) == min(probes, wide**rotations) and np.allclose(np.sort(sums)[::-1], want)


def test_language_sample(spark):
    draw = random.Random(2)
    text = {lang: [" ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(8)) for _ in range(1200)] for lang, letters in (("en", "abcde"), ("de", "vwxyz"))}
    rows = [(None, t, lang, "s") for lang in text for t in text[lang]]
    docs = documents(spark, rows + [(1, "ñ" * 30_000 + str(k), "es", "s") for k in range(3)] + [(2, "same", "fr", "s")] * 900 + [(3, "x", None, "s"), (4, None, "it", "s")])
    got = language_id.sample(docs).collect()
    count = {lang: sum(r.lang == lang for r in got) for lang in ("en", "de", "es", "fr", "it")}
    assert count == {"en": 400, "de": 400, "es": 3, "fr": 1, "it": 1} and len(got) == 805 and max(len(r.text) for r in got) == language_id.LONGEST
    assert sorted(map(tuple, got)) == sorted(map(tuple, language_id.sample(docs.repartition(7)).collect()))
    assert len(language_id.sample(docs, total=10).collect()) == 8 and language_id.sample(docs.limit(0)).count() == 0
    field = language_id.fit(docs)
    assert field.languages == ["de", "en", "es", "fr", "it"]
    named = language_id.identify(documents(spark, [(1, "abcde edcba", None, None), (2, "vwxyz zyxwv wwxyz", None, None)]), field).orderBy("doc_id").collect()
    assert [r.lang_pred for r in named] == ["en", "de"]
    # Bounds at sizes that no test can hold: never 0, and somewhat over four times the share.
    for n in (400, 1_600, 419_430_401, 500_000_000, 10**13):
        assert language_id.bound(400, n) == min(1 << 62, 1664 * (1 << 62) // n) > 0


def test_language_id_held_out_and_und(spark):
    draw, parts = random.Random(4), {"en": ["the", "ing", "tion", "wh"], "de": ["der", "ung", "sch", "keit"], "fr": ["le", "eau", "ment", "oi"]}
    rows = []
    for k in range(600):
        lang = ["en", "de", "fr"][k % 3]
        rows.append((k, " ".join("".join(draw.choice(parts[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(30)), lang, "s"))
    docs = documents(spark, rows)
    field = language_id.fit(docs.where(toxicity.fold("doc_id", 4) != 2))
    named = language_id.identify(docs, field).collect()
    held = [r for r in named if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    switched = "thetion whing thewh derung schkeit keitsch leeau mentoi eaument"
    odd = documents(spark, [(1, None, None, None), (2, "12 !!", None, None), (3, "", None, None), (4, switched, None, None)])
    got = {r.doc_id: r for r in language_id.identify(odd, field).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3
    assert [(r["word"], r["words"], r["lang"]) for r in got[4].lang_runs] == [(0, 3, "en"), (3, 3, "de"), (6, 3, "fr")]
    signs = documents(spark, [(1, "½ ² ①", None, None), (2, "ⅷ ②", None, None), (3, "the½ing", None, None)])
    assert [r.lang_pred for r in language_id.identify(signs, field).orderBy("doc_id").collect()] == ["und", "und", "en"]
    assert language_id.words_of("a²b ½ Ⅷc") == ["a", "b", "c"]
    empty = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}


def test_forward_backward_over_segments_is_exact():
    rng = np.random.default_rng(1)
    field = language_id.Field(["a", "b", "c"], rng.normal(size=(language_id.WIDTH, 3)) * 0.3, rng.normal(size=(3, 3)))
    labeller, draw = language_id.Labeller(field), random.Random(1)
    texts = [[f"w{draw.randrange(50)}".replace("1", "x") for _ in range(n)] for n in (0, 1, 63, 64, 65, 200)]
    got, at = labeller.marginals(np.array([len(t) for t in texts]), [w for t in texts for w in t]), 0
    for t in texts:
        if t:
            whole = language_id._messages(labeller._emissions(t)[:, None, :], labeller.step)[2][:, 0]
            assert np.allclose(got[at : at + len(t)], whole)
        at += len(t)


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_ngram_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)  # so that groups span several blocks
    monkeypatch.setattr(ngram_join, "TILE", 5)
    draw, vocabulary = random.Random(6), [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([6, 60, 150]))]
        for _ in range(60 if g == 0 else draw.randrange(1, 5)):
            words = list(base)
            for _ in range(draw.randrange(0, 3)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(words), "en", "s"))
    rows += [(900, None, None, None), (901, "", None, None), (902, "one two", None, None), (903, "One  two", None, None), (None, rows[0][1], None, None), (3, rows[3][1], "en", "s")]
    docs = documents(spark, rows)
    sets = [shingles(t) for _, t, *_ in rows]
    linked = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(len(rows))] for i in range(len(rows))]
    label = list(range(len(rows)))
    while (after := [min([label[i], *(label[j] for j in range(len(rows)) if linked[i][j])]) for i in range(len(rows))]) != label:
        label = after
    key = lambda i: (rows[i][0], zlib.crc32((rows[i][1] or "").encode()))
    want = sorted(((key(i), sum(linked[i])) for i in range(len(rows))), key=str)
    table = ngram_join.classes(docs).collect()
    ids = {i: min(rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None) for i in range(len(rows)) if sets[i]}
    assert sorted((r.n_links for r in table)) == sorted(n for _, n in want)
    assert sorted(str((r.doc_id, r.class_id)) for r in table) == sorted(str((rows[i][0], ids.get(i, rows[i][0]))) for i in range(len(rows)))
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len({label[i] for i in range(len(rows))})
    assert ngram_join.classes(docs.limit(0)).count() == 0


def test_near_copy_classes_with_the_same_smallest_id_stay_apart(spark):
    draw, rows = random.Random(12), []
    for ids in [(None, None), (None, None, None), (7, 8), (7, 9)]:
        base = [f"w{draw.randrange(3000)}" for _ in range(80)]
        rows += [(i, " ".join([*base, f"end{k}"]), "en", "s") for k, i in enumerate(ids)]
    kept = [r.text for r in ngram_join.keep_first(documents(spark, rows)).collect()]
    assert sorted(t.split()[0] for t in kept) == sorted({t.split()[0] for _, t, *_ in rows})


def test_prefixes_are_shortened_until_the_recall_is_met():
    assert ngram_join.floor_depth(0.8) == 4 and ngram_join.floor_depth(0.95) > 4 and ngram_join.floor_depth(0.5) < 4
    assert ngram_join.next_depth({99: 10**6}, 6, 4, 0.8) == 6  # nearly equal sets all meet in whole paths
    assert ngram_join.next_depth({80: 1000, 99: 1000}, 6, 4, 0.8) == 4
    assert ngram_join.next_depth({}, 6, 4, 0.8) < 6  # what has not been met at all says nothing
    assert ngram_join.next_depth({85: 1000}, 6, 4, 0.8) == 6 and 4 <= ngram_join.next_depth({82: 1000}, 6, 4, 0.8) <= 5


def test_pairs_count_once_at_whatever_depth_they_meet():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 120, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(96, 121)], rng.integers(0, 1 << 63, rng.integers(0, 12), dtype=np.uint64)])) for _ in range(40)]
    own = ngram_join.paths(sets, 20)
    rows = [(k, 0, 1, own[k].tobytes(), sets[k].tobytes()) for k in range(40)]
    near = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-6
    shared = lambda a, b, t, depth: own[a, t, : 2 * depth].tobytes() == own[b, t, : 2 * depth].tobytes()
    links = np.zeros((40, 40), dtype=int)
    for depth, before in ((6, None), (4, 6), (3, 4)):
        for tree in range(20):
            for node in {own[k, tree, : 2 * depth].tobytes() for k in range(40)}:
                held = [k for k in range(40) if own[k, tree, : 2 * depth].tobytes() == node]
                found, bins = ngram_join.verify([rows[k] for k in held], tree, depth, before, 0.8)
                fresh = [(a, b) for a in held for b in held if a != b and near(sets[a], sets[b]) and not any(shared(a, b, t, depth) for t in range(tree)) and not (before and any(shared(a, b, t, before) for t in range(20)))]
                assert sum(n for _, n, _ in found) == len(fresh) and sum(bins.values()) >= len(fresh) // 2
                for a, b in fresh:
                    links[a, b] += 1
    assert links.max() == 1 and (links == 1).sum() == sum(near(sets[a], sets[b]) for a in range(40) for b in range(40) if a != b)


def test_secrets_are_found_and_plain_values_left(spark):
    draw, rows, planted = random.Random(8), [], set()
    token = lambda n, letters: "".join(draw.choice(letters) for _ in range(n))
    for k in range(400):
        words = " ".join(draw.choice(["river", "stone", "paper", "of", "the", "and"]) for _ in range(30))
        kind = k % 8
        value = {0: f"password={token(18, '0123456789abcdef')}", 1: f'token = "{token(40, "0123456789abcdef")}"', 2: "AKIA" + token(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 3: token(16, "0123456789"), 4: f"mail{k}.stone-paper.example.com", 5: "10.20.30.140"}.get(kind, "river")
        rows.append((k, f"{words} {value} {words}", "en", "s"))
        if kind < 3:
            planted.add(k)
    docs = documents(spark, rows)
    model = secrets.fit(docs.where("doc_id % 3 <> 1"))
    found = secrets.scan(docs, model, redact="[SECRET]").collect()
    flagged = {r.doc_id for r in found if any(f.secret for f in r.findings)}
    held = {k for k in range(400) if k % 3 == 1}
    assert flagged & held == planted & held
    assert all(("[SECRET]" in r.text) == (r.doc_id in flagged) for r in found)
    odd = secrets.scan(documents(spark, [(1, None, None, None), (2, "", None, None)]), model).collect()
    assert [r.findings for r in odd] == [[], []]
    assert secrets.scan(docs.limit(0), secrets.fit(docs.limit(0))).count() == 0


@pytest.mark.parametrize("text, value", [
    ("password=Sunflowerfields", "Sunflowerfields"), ("my token: qWxZkRtPvLmN.", "qWxZkRtPvLmN"), ("secret='aB@c#d!e' x", "aB@c#d!e"), ('"password": "Tr0ub@dor&3 plus"', "Tr0ub@dor&3 plus"),
    ("password=hu#r2! next", "hu#r2!"), ("(api_key=zPqRsTvWxYbC)", "zPqRsTvWxYbC"), ("auth: https://x.org?token=a$Bc%D", "a$Bc%D"), ("passwd = a(b)c", "a(b)c"), ("password is 'qq", "qq"),
])
def test_every_assigned_value_is_a_candidate(text, value):
    assert value in [text[a:b] for a, b in secrets.candidates(text)]


def test_secrets_without_digits_and_with_symbols_are_redacted(spark):
    draw, rows, values = random.Random(18), [], {}
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for k in range(300):
        words = " ".join(draw.choice(["river", "stone", "paper", "garden", "window", "yellow", "of", "the", "and"]) for _ in range(30))
        value = "".join(draw.choice(letters + "@#!$%" * (k % 3 == 1)) for _ in range(16)) if k % 3 < 2 else draw.choice(["river", "stonepaper", "garden", "window"])
        values[k] = value
        rows.append((k, f"{words} {draw.choice(['password=', 'token: ', 'secret='])}{value} {words}", "en", "s"))
    docs = documents(spark, rows)
    found = {r.doc_id: r.text for r in secrets.scan(docs, secrets.fit(docs), redact="[SECRET]").collect()}
    hidden = {k for k, v in values.items() if v not in found[k]}
    keys, plain = {k for k in values if k % 3 < 2}, {k for k in values if k % 3 == 2}
    print("hidden", len(hidden & keys), len(keys), "wrong", sum("[SECRET]" in found[k] for k in plain))
    assert len(hidden & keys) >= 0.97 * len(keys) and sum("[SECRET]" in found[k] for k in plain) <= 3


def test_sharding_keeps_its_law(spark, mixed):
    lines = sharding.assign(mixed, shards=4).collect()
    rows = mixed.collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in lines) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    for shard in range(4):
        assert sorted(r.slot for r in lines if r.shard == shard) == list(range(sum(r.shard == shard for r in lines)))
    by_text = {}
    for r in lines:
        by_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.assign(mixed.limit(0)).count() == 0


def test_cuts_are_minimax():
    draw = random.Random(9)

    def least(sizes, shards):
        ends = np.concatenate([[0], np.cumsum(sizes)])
        best = {(len(sizes), 0): 0}
        for k in range(len(sizes), -1, -1):
            for s in range(shards + 1):
                if k < len(sizes) and s:
                    best[k, s] = min(max(ends[j] - ends[k], best.get((j, s - 1), math.inf)) for j in range(k + 1, len(sizes) + 1))
                elif k == len(sizes):
                    best[k, s] = 0
        return best[0, shards]

    for _ in range(60):
        sizes, shards = np.array([draw.choice([1, 3, 9, 40]) for _ in range(draw.randrange(1, 14))]), draw.randrange(1, 5)
        capacity = sharding.smallest_capacity(sizes, shards)
        bounds = [0, *sharding.cuts(sizes, shards), len(sizes)]
        assert capacity == least(sizes, shards)
        assert max(sizes[a:b].sum() for a, b in zip(bounds, bounds[1:])) == capacity


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_that_of_single_groups(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "ATOM_BITS", 2)
    monkeypatch.setattr(sharding, "STEP", 3)
    draw = random.Random(seed)
    rows = [(draw.randrange(-(1 << 63), 1 << 63) if k % 3 else 7, draw.choice([1, 5, 20, 300 if seed == 3 else 30])) for k in range(120)]
    groups = {}
    for digest, size in rows:
        groups[digest] = groups.get(digest, 0) + size
    sizes = np.array([groups[d] for d in sorted(groups)])
    firsts, found = sharding.atoms(spark.createDataFrame(rows, "digest long, size long"), 5)
    assert sharding.smallest_capacity(found, 5) == sharding.smallest_capacity(sizes, 5) and found.sum() == sizes.sum() and firsts == sorted(firsts)
    assert sharding.atoms(spark.createDataFrame([], "digest long, size long"), 5)[0] == []
