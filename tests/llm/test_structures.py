"""Collocations, repeated strings and conversation repair against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import documents
from tidemark.llm import collocations, repair, repeats
from tidemark.llm.common import Scratch

NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}


def plain_phrases(rows, least=10, cover=50):
    found, totals = Counter(), Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            totals["und" if lang is None else lang] += len(words)
            for k in range(1, 4):
                found.update(("und" if lang is None else lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    frequent = {g: a for g, a in found.items() if len(g) > 2 and a >= least}
    out = []
    for (lang, *g), a in frequent.items():
        over = [frequent[h] for h in frequent if h[0] == lang and len(h) == 4 > len(g) + 1 and (list(h[1:3]) == g or list(h[2:4]) == g)]
        if over and 100 * max(over) >= cover * a:
            continue
        cuts = [(10**6 * a * a // (found[(lang, *g[:k])] * found[(lang, *g[k:])]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.append((lang, " ".join(g), a, found[(lang, *g[:k])], found[(lang, *g[k:])], totals[lang], score))
    return sorted(out)


@pytest.mark.parametrize("budget", [1_500_000, 40, 7])
def test_phrases_for_any_budget(spark, budget):
    draw = random.Random(3)
    words = ["a", "b", "A", "ch", "é", "İ", "x\xa0y"]
    texts = ["".join(draw.choice(words) + draw.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "\x0b "]) for _ in range(draw.randrange(0, 60))) for _ in range(150)]
    rows = [(i, t, draw.choice(["en", None, "und", "de"]), "s") for i, t in enumerate(texts)] + [(None, None, "en", None), (5, "", None, None)]
    got = collocations.phrases(documents(spark, rows), budget=budget)
    assert sorted(map(tuple, got.collect())) == plain_phrases([(t, lang) for _, t, lang, _ in rows])
    ranked = collocations.best(got, most=3).collect()
    assert all(sum(r.lang == lang for r in ranked) == 3 for lang in ("en", "de", "und"))


def test_scores_beyond_64_bits(spark):
    a, left, right = 3 * 10**12, 10**13 + 7, 3 * 10**12 + 1
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations.score("a", "l", "r").alias("s")).first().s
    assert got == 10**6 * a * a // (left * right)


def test_no_phrases(spark, tmp_path):
    assert collocations.best(collocations.phrases(documents(spark, []))).collect() == []
    assert collocations.phrases(documents(spark, [(1, "one two three", "en", "s"), (2, None, None, None)])).collect() == []


def plain_removal(rows, length=400):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[p : p + length] for _, x in texts for p in range(len(x) - length + 1))
    out = []
    for d, x in texts:
        gone = np.zeros(len(x), dtype=bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(x, dtype=np.uint8)[~gone].tobytes()
        out.append((d, len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def repetitive():
    draw = random.Random(8)

    def text(n):
        return "".join("".join(draw.choice("abcdeé ") for _ in range(draw.randrange(1, 9))) + " " for _ in range(n // 5))

    base, rows = [text(draw.randrange(300, 2500)) for _ in range(20)], [(None, None), (1, ""), (2, "a" * 3000), (3, "ab" * 900), (4, "a" * 399), (5, "a" * 400), (6, "ñ" * 250)]
    for i in range(80):
        x, other = draw.choice(base), draw.choice(base)
        for _ in range(draw.randrange(0, 3)):
            k, j = draw.randrange(len(x)), draw.randrange(len(other))
            x = x[:k] + draw.choice(["", text(20), other[j : j + draw.randrange(300, 900)]]) + x[k:]
        rows.append((10 + i, x))
    rows += [(500 + i, text(draw.randrange(200)) + base[0][:500] + text(draw.randrange(200))) for i in range(40)]
    return rows + [(900, base[3])] * 3


@pytest.mark.parametrize("stretch, entries", [(1 << 20, 50_000), (700, 40)])
def test_repeated_strings(spark, repetitive, monkeypatch, stretch, entries):
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    monkeypatch.setattr(repeats, "ENTRIES", entries)
    docs = documents(spark, [(d, t, "en", "s") for d, t in repetitive]).repartition(5)
    got = repeats.cleaned(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == plain_removal(repetitive)


#: So that the rows of one key are split among tasks in small tables too.
SKEW = {"skewJoin.skewedPartitionThresholdInBytes": "20k", "skewJoin.skewedPartitionFactor": "2", "advisoryPartitionSizeInBytes": "10k"}


def test_rows_of_a_common_passage_are_split_among_tasks(spark):
    """Both joins by bucket: of triggers with repeated buckets, of entries with buckets of several entries."""
    plans = []

    class Told(Scratch):
        def table(self, df):
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
            return super().table(df)

    draw = random.Random(3)
    rows = [(i, "".join(draw.choice("bcde ") for _ in range(600)) + "a" * 1000 + "".join(draw.choice("bcde ") for _ in range(600)), "en", "s") for i in range(60)]
    texts = documents(spark, rows).repartition(8).select(F.unhex(F.sha2("text", 256)).alias("key"), "text")
    before = {k: spark.conf.get(f"spark.sql.adaptive.{k}") for k in SKEW}
    try:
        for k, v in SKEW.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
        assert repeats.spans(texts, Told(spark)).count() == 60
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
    by_bucket = [p for p in plans if "LeftSemi" in p]
    assert len(by_bucket) == 2 and all("Aggregate" not in p for p in by_bucket)
    assert "SortMergeJoin(skew=true)" in by_bucket[0]


def exchanged(node):
    """Rows that each exchange of a plan that has run wrote."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return exchanged(node.executedPlan())
    if "QueryStage" in node.nodeName():
        return exchanged(node.plan())
    below = [n for k in range(node.children().size()) for n in exchanged(node.children().apply(k))]
    return below + ([node.longMetric("shuffleRecordsWritten").value()] if node.nodeName() == "Exchange" else [])


def test_copies_of_a_text_do_not_meet_in_one_task(spark):
    rows = [(i, "x" * 500 if i % 10 else f"{i:05d}" * 100, "en", "s") for i in range(2000)]
    texts = documents(spark, rows).repartition(4).select(F.unhex(F.sha2("text", 256)).alias("key"), "text")
    keys = texts.where(F.col("text").startswith("x")).select("key").distinct()
    entries = keys.select(F.explode(F.array(F.lit(7), F.lit(8))).alias("entry"), F.lit(0).cast("long").alias("bucket"), "key", F.lit(100).alias("at"), F.lit(40).alias("far"), F.lit(0).alias("near"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = repeats.contexts(texts, spark.createDataFrame(entries.collect(), entries.schema))
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(e, 0, 40, 0, b"x" * 40, b"x" * (repeats.LENGTH - repeats.BEHIND)) for e in (7, 8)]
    # But for the 2,000 rows that the test itself deals out.
    written = exchanged(found._jdf.queryExecution().executedPlan())
    assert sorted(written)[-1] == 2000 and all(n <= 200 + 4 for n in sorted(written)[:-1])


def test_no_repeats(spark):
    assert repeats.cleaned(documents(spark, [])).collect() == []
    assert repeats.cleaned(documents(spark, [(1, None, "en", "s"), (1, "x", "en", "s")])).select("n_removed").collect() == [(0,), (0,)]


def test_trigger_of_a_string_is_its_own_matter():
    draw = np.random.default_rng(2)
    data = draw.integers(97, 100, 5000).astype(np.uint8)
    at, far, near, bucket, name = repeats.triggers(data, np.array([5000]))
    assert (far <= repeats.REACH).all() and (near >= repeats.TRIGGER).all() and int((far - near + 1).sum()) == 5000 - repeats.LENGTH + 1
    for start in (0, 777, 4600):
        own = repeats.triggers(data[start : start + repeats.LENGTH].copy(), np.array([repeats.LENGTH]))
        k = int(np.flatnonzero((at - far <= start) & (start <= at - near))[0])
        assert own[0][0] + start == at[k] and own[3][0] == bucket[k]


def plain_repair(rows):
    spaced = lambda x: " " if x is None else str(x)
    held, out = {}, {}
    for c, t, r, x in rows:
        held.setdefault(c, []).append((t, spaced(r), spaced(x)))
    for c, turns in held.items():
        damaged = []
        for t, r, x in sorted(turns, key=lambda v: (v[0] is not None, v[0] or 0)):
            k = zlib.crc32(f"{spaced(c)}:{spaced(t)}".encode()) % 20
            r, x = "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            damaged += [(t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
        seen, faults = set(), []
        for _, r, x in damaged:
            core = x.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not core else 2 if (r, x) in seen else 3 if core[-1] not in ".!?" else 0)
            seen.add((r, x))
        known = [t for t, _, _ in damaged if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(damaged, damaged[1:]))

        def put(to, q, cost, letters, lines):
            if q not in to or (cost, letters) < to[q][:2]:
                to[q] = cost, letters, lines

        best = {0: (0, "", ())}
        for k in range(len(damaged) + 1):
            for _ in range(3):
                for q, (cost, letters, lines) in list(best.items()):
                    put(best, NEXT[q][0], cost + 5, letters + "I", (*lines, NEXT[q][1] + ":"))
            if k == len(damaged):
                break
            (_, r, x), fault, after = damaged[k], faults[k], {}
            for q, (cost, letters, lines) in best.items():
                put(after, q, cost + 2, letters + "D", lines)
                if fault in (0, 3):
                    to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((r[:1], q))
                    cost += 5 * (fault == 3)
                    if to is not None:
                        put(after, to, cost, letters + "K", (*lines, f"{r}:{x}"))
                    put(after, NEXT[q][0], cost + 1, letters + "R", (*lines, f"{NEXT[q][1]}:{x}"))
            best = after
        cost, letters, lines = min((best[q] for q in (0, 3) if q in best), key=lambda v: v[:2])
        counts = [faults.count(k) for k in (1, 2, 3)]
        out[c] = (gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks(spark):
    draw, rows = random.Random(5), {}
    for c in [None, 1, 2, 3, 4, 5]:
        for t in range({1: 300, None: 90}.get(c, 12)):
            turn = t if c == 1 else draw.choice([None, t, t, t, t * 2])
            role = draw.choice(["user", "assistant", "system", "tool", "", None, "usr"])
            rows.setdefault((c, turn), (c, turn, role, draw.choice([None, "", " \n", "a.", "b", "c! ", "d?\t", "e. x"]), "x", 1))
    rows = list(rows.values()) + [(6, t, draw.choice(["user", "assistant"]), f"hi {t}.", "y", 2) for t in range(40)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, letter string, pos int")


@pytest.mark.parametrize("piece, fan", [(4096, 1024), (5, 2), (7, 3)])
def test_conversations(monkeypatch, talks, piece, fan):
    rows, table = talks
    monkeypatch.setattr(repair, "FAN", fan)
    got = {r[0]: tuple(r[1:]) for r in repair.audit(table, piece).collect()}
    assert got == plain_repair([r[:4] for r in rows])


def test_conversations_without_damage(spark):
    rows = [(1, 1, "user", "Hello there.", "x"), (1, 2, "assistant", "Good day.", "x"), (2, None, "assistant", "Hm", "x"), (2, None, "assistant", "Hm", "x")]
    got = repair.repair(repair.plain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, was string"))).collect()
    found = {r.conv_id: (r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in got}
    assert found == {1: (0, 0, 0, 0, "KK"), 2: (1, 1, 1, 4, "DD")}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.audit(empty).collect() == []


def test_blocks_say_what_single_steps_do():
    held, draw = repair.Tables(), np.random.default_rng(4)
    for n in (0, 1, 4, 7, 50):
        symbols, costs = draw.integers(0, repair.SYMBOLS, n), repair.END
        for s in symbols[::-1].tolist():
            costs = repair.before(costs, s)
        assert held.costs(symbols, 0) == costs
        letters, spent, state = held.trace(symbols, 0, 0, True)
        assert spent == costs[0] and state in (0, 3) and math.isclose(sum(x not in "Ii" for x in letters), n)
