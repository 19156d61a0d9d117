"""Phrase collocations from depth-truncated suffix subtrees, built group by group.

Texts are cut into pieces and words; the suffix of a word is that word and the
(at most two) next ones of its piece.  Vertical partitioning: each suffix goes
to the group of its prefix, a hash of its first word, with so many groups that
one holds about ``BUDGET`` suffixes.  First words that alone would fill a
quarter of a group (at most four for each group) are told apart by their
second word too, and where that is such a word as well, by all three: then the
pair's own count goes to the group of the pair.  Equal suffixes are counted
once for each slice of texts before they are sent, so a prefix of full length
needs no splitting.

A group gets its suffixes in blocks, one for each slice of texts: words once,
suffixes as numbers with counts.  Its subtrees are built on their own, by
sorting: leaves are equal suffixes, and the count of a phrase is the total of
the leaves below its node.  Single words were counted first, for the grouping.
Only phrases with ``least`` occurrences leave a group;
their parts are as frequent, so scores need nothing else.

Scores are exact: decimals of 38 digits hold 1,000,000 * a * a up to a = 10^16.

Defined results: null texts have no words; a null language is ``und``; of
equally scored cuts the first counts, ties of whole scores go by count and
phrase; repeated rows count each; an empty table, or one without frequent
phrases, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, slices, text_of

#: Suffixes in a group, bytes of text in a slice, entries that a task counts before it sends them on.
BUDGET, SLICE, HELD = 1_500_000, 8_000_000, 400_000
#: A-Z in lower case, tabs as spaces, all ends of pieces as newlines.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def tokens(texts: list[str]) -> list[bytes]:
    """All words, and a newline wherever a piece ends; empty items mean nothing."""
    return "\n".join(texts).encode().translate(PLAIN).replace(b"\n", b" \n ").split(b" ")


def words_of(texts: list[str]) -> list[bytes]:
    return [t for t in tokens(texts) if t]


def by_lang(batch):
    """The texts of each language in bounded slices of a record batch."""
    for part in slices(batch, "text", SLICE):
        held = defaultdict(list)
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            held[lang].append(text)
        yield from held.items()


def counted(texts: DataFrame, count, names: list[str]) -> DataFrame:
    """Sums over all texts of what ``count`` (lang and texts to a Counter of tuples of words) finds: lang, ``names``, f."""

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def sent():
            rows = list(held.items())
            columns = [pa.array([k[j] for k, _ in rows], type=pa.binary() if j else pa.string()) for j in range(len(names) + 1)]
            columns = [c.cast(pa.string()) for c in columns] + [pa.array([n for _, n in rows], type=pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["lang", *names, "f"])

        for batch in batches:
            for lang, some in by_lang(batch):
                for key, n in count(lang, some).items():
                    held[lang, *key] += n
                if len(held) > HELD:
                    yield sent()
        if held:
            yield sent()

    rows = texts.mapInArrow(run, "lang string, " + "".join(f"{c} string, " for c in names) + "f bigint")
    return rows.groupBy("lang", *names).agg(F.sum("f").alias("f"))


def count_words(lang: str, texts: list[str]) -> dict:
    found = Counter(tokens(texts))
    return {(w,): n for w, n in found.items() if w not in (b"", b"\n")}


def suffixes(words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The vocabulary, distinct suffixes of two or three words as its numbers (-1: none), and their counts."""
    ids: dict = defaultdict()
    ids.default_factory = ids.__len__
    ids[b"\n"]
    row = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words)) - 1  # -1: a piece ends
    row = np.concatenate([row, [-1, -1]])
    one, two, three = row[:-2], row[1:-1], row[2:]
    there = (one >= 0) & (two >= 0)
    one, two, three = one[there], two[there], three[there]
    return list(ids)[1:], *combined(np.stack([one, two, three], axis=1), np.ones(len(one), dtype=np.int64))


def combined(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``rows`` of three numbers and their total counts."""
    if not len(rows):
        return rows.reshape(0, 3), counts
    wide = int(rows.max()) + 2
    _, pair = np.unique(rows[:, 0] * wide + rows[:, 1], return_inverse=True)
    order = np.argsort(pair * wide + rows[:, 2] + 1, kind="stable")
    rows, counts = rows[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[starts], np.add.reduceat(counts, starts)


def subtree(rows: np.ndarray, counts: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes of depth 2 and 3 with ``least`` occurrences: their words and the totals of the leaves below them."""
    leaves, totals = combined(rows, counts)
    found = []
    for depth in (2, 3):
        if depth == 3:
            whole = leaves[:, 2] >= 0
            leaves, totals = leaves[whole], totals[whole]
        if not len(leaves):
            found.append((leaves[:, :depth], totals))
            continue
        starts = np.flatnonzero(np.concatenate([[True], (leaves[1:, :depth] != leaves[:-1, :depth]).any(axis=1)]))
        sums = np.add.reduceat(totals, starts)
        found.append((leaves[starts][:, :depth][sums >= least], sums[sums >= least]))
    return found


def grouped(texts: DataFrame, groups: int, often: set) -> DataFrame:
    """Blocks of suffixes by ``grp``: lang, words, rows and counts, compressed; ``deep`` blocks tell of three words only."""

    def blocks(lang: str, some: list[str]):
        vocabulary, rows, counts = suffixes(words_of(some))
        salt = crc32(lang.encode() + b"\n")
        hashes = np.array([crc32(w, salt) for w in vocabulary] + [0], dtype=np.int64)  # the last: no word
        frequent = np.array([(lang, w) in often for w in vocabulary] + [False])
        one, two = frequent[rows[:, 0]], frequent[rows[:, 0]] & frequent[rows[:, 1]]
        deep = rows[two], counts[two]
        pairs = combined(np.column_stack([rows[two][:, :2], np.full(int(two.sum()), -1)]), counts[two])
        key = lambda held, depth: sum(hashes[held[:, j]] * (2 * j * 40503 + 1) for j in range(depth))
        parts = [(rows[~one], counts[~one], 1, False), (rows[one & ~two], counts[one & ~two], 2, False), (*pairs, 2, False), (*deep, 3, True)]
        for held, n, depth, below in parts:
            if below:
                held, n = held[held[:, 2] >= 0], n[held[:, 2] >= 0]
            group = key(held, depth) % groups
            order = np.argsort(group, kind="stable")
            group, held, n = group[order], held[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist() if len(group) else []
            for start, stop in zip(starts, [*starts[1:], len(group)]):
                used, local = np.unique(held[start:stop], return_inverse=True)
                words = b" ".join(b"" if u < 0 else vocabulary[u] for u in used.tolist())  # no word: the empty one
                body = np.column_stack([local.reshape(-1, 3), n[start:stop]]).astype(np.int32).T.tobytes()
                yield int(group[start]), below, lang, words, body

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        for batch in batches:
            for lang, some in by_lang(batch):
                rows = [(g, d, lang, len(w), pa.compress(w, codec="zstd", asbytes=True), len(b), pa.compress(b, codec="zstd", asbytes=True)) for g, d, lang, w, b in blocks(lang, some)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], ["grp", "deep", "lang", "n_words", "words", "n_body", "body"])

    return texts.mapInArrow(run, "grp bigint, deep boolean, lang string, n_words bigint, words binary, n_body bigint, body binary")


def counted_groups(blocks: DataFrame, least: int) -> DataFrame:
    """Phrases of two and three words with ``least`` occurrences in their group: lang, x, y, z (null for two), f."""

    def run(batches):
        import pyarrow as pa

        key, ids, held = None, None, []

        def built():
            rows = np.concatenate([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            words = [w.decode() for w in ids]
            for nodes, totals in subtree(rows, counts, least):
                if not len(nodes) or (key[2] and nodes.shape[1] == 2):
                    continue
                columns = [[words[k] for k in nodes[:, j].tolist()] for j in range(nodes.shape[1])] + [[None] * len(nodes)] * (3 - nodes.shape[1])
                arrays = [pa.array([key[1]] * len(nodes)), *[pa.array(c, type=pa.string()) for c in columns], pa.array(totals)]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "x", "y", "z", "f"])

        for batch in batches:
            for group, lang, deep, n_words, words, n_body, body in zip(*[batch.column(c).to_pylist() for c in ("grp", "lang", "deep", "n_words", "words", "n_body", "body")]):
                if key != (group, lang, deep):
                    if held:
                        yield from built()
                    key, held, ids = (group, lang, deep), [], defaultdict()
                    ids.default_factory = ids.__len__
                words = pa.decompress(words, n_words, codec="zstd", asbytes=True)
                numbers = np.array([ids[w] if w else -1 for w in words.split(b" ")], dtype=np.int64)
                body = np.frombuffer(pa.decompress(body, n_body, codec="zstd", asbytes=True), dtype=np.int32).reshape(4, -1)
                held.append((numbers[body[:3]].T, body[3].astype(np.int64)))
                if len(held) > 64:  # equal suffixes of many small blocks are one
                    held = [combined(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
        if held:
            yield from built()

    placed = blocks.repartition("grp").sortWithinPartitions("grp", "lang", "deep")
    return placed.mapInArrow(run, "lang string, x string, y string, z string, f bigint")


def score(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 * a * a / (left * right)), exactly."""
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(38,0)) * {a} * {a}) div (CAST({left} AS DECIMAL(38,0)) * {right}) AS BIGINT)")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, cover: int = 50, budget: int = BUDGET) -> DataFrame:
    """All phrases of two or three words that occur ``least`` times and are not covered: lang, phrase, a, l, r, n, score."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    words = scratch.table(counted(texts, count_words, ["x"]))
    totals = scratch.table(words.groupBy("lang").agg(F.sum("f").alias("n")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // budget))
    often = {(r.lang, r.x.encode()) for r in words.where(F.col("f") > max(1, budget // 4)).collect()}  # four for each group at most
    nodes = scratch.table(counted_groups(grouped(texts, groups, often), least))

    one = words.where(F.col("f") >= least)
    two = nodes.where("z IS NULL").drop("z")
    three = nodes.where("z IS NOT NULL").withColumnRenamed("f", "a")
    part = lambda table, count, **names: table.select("lang", *[F.col(c).alias(n) for c, n in names.items()], F.col("f").alias(count))
    three = three.join(part(one, "fx", x="x"), ["lang", "x"]).join(part(one, "fz", x="z"), ["lang", "z"])
    three = three.join(part(two, "fxy", x="x", y="y"), ["lang", "x", "y"]).join(part(two, "fyz", x="y", y="z"), ["lang", "y", "z"])
    cuts = F.array_min(F.array(F.struct(score("a", "fx", "fyz").alias("score"), F.lit(1).alias("k"), F.col("fx").alias("l"), F.col("fyz").alias("r")),
                               F.struct(score("a", "fxy", "fz").alias("score"), F.lit(2).alias("k"), F.col("fxy").alias("l"), F.col("fz").alias("r"))))
    long = scratch.table(three.withColumn("cut", cuts).select("lang", "x", "y", "z", "a", "cut.l", "cut.r", "cut.score"))
    over = long.select("lang", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("z").alias("y")))).alias("p"), "a")
    over = over.groupBy("lang", "p.x", "p.y").agg(F.max("a").alias("longest"))
    short = two.withColumnRenamed("f", "a").join(over, ["lang", "x", "y"], "left").where(f"longest IS NULL OR 100 * longest < {cover} * a")
    short = short.join(part(one, "l", x="x"), ["lang", "x"]).join(part(one, "r", x="y"), ["lang", "y"])
    short = short.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", "l", "r", score("a", "l", "r").alias("score"))
    both = short.unionByName(long.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", "l", "r", "score"))
    return both.join(F.broadcast(totals), "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best(found: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language, with their ``rank``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
