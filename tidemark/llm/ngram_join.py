"""N-gram Jaccard join through a MinHash LSH forest, with exact verification.

Two documents are linked if their sets of word shingles (five words in lower
case, by white space) have a Jaccard similarity of the threshold or more.

Each distinct shingle set has a path in every tree: ``LONGEST`` minimum hashes,
one after another.  Paths that have company at the shortest prefix of all are
written sorted, which makes them prefix tries: sets below a node stand side by
side.  Matching begins with whole paths.  Sets below one node are verified exactly; the similarities of the
links found so far say how many links prefixes of each length should still miss
(a link of similarity ``s`` meets at depth ``k`` in some tree with probability
``1 - (1 - s**k)**trees``, so each one found stands for its inverse), and the
prefixes are shortened to the longest for which the expected share found is the
target recall, and on, a level at a time if need be, until what has been found
confirms it or the depth is reached at which even a pair at the threshold
is met with that probability.  A pair is verified in the first tree and at
the first depth at which it meets, once.

Nodes whose sets have all met below one node before are left out.  A node of
many sets is verified in pairs of blocks, so a set is sent once for each block
of its node and there are n / BLOCK of those: linear up to some thousand sets
and beyond that n * n / BLOCK rows, each worth BLOCK exact comparisons.  What
leaves a block is one line per set (its number of links and a smallest
connected set), never the pairs.

Classes are the connected components of the links, found by passing on
smallest labels along links and label chains.

Defined results: a document without words has no shingles, no links and a
class of its own; one with fewer words than a shingle has all its words as
its one shingle.  Documents with the same set are copies: they are linked to
each other and to all that any of them is linked to, and are never expanded
into pairs.  Null ids are allowed; a class is named by its smallest id.
Repeated rows count as copies.  Shingles are compared by 64-bit digests.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, add_columns, small, text_of

SHINGLE, SIMILARITY = 5, 0.8
TREES, LONGEST, RECALL = 20, 6, 0.9999
#: Bytes of one hash in a path.
LABEL = 2
#: Sets, and bytes of shingles, in a block of verification, about; sets and shingles that it compares at a time.
BLOCK, BLOCK_BYTES, TILE, COLUMNS = 2048, 16 << 20, 512, 8192
#: Similarities are counted in bins of this width.
BIN = 0.01
CACHE = 400_000
#: Rows of a table of two or three numbers that is broadcast; about 50 MB at most.
BROADCAST_ROWS = 1_000_000


def met(similarity, depth: int, trees: int = TREES):
    """The probability that a pair meets at ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def floor_depth(similarity: float, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with probability ``recall``."""
    return next((depth for depth in range(longest, 1, -1) if met(similarity, depth, trees) >= recall), 1)


def next_depth(bins: dict[int, int], depth: int, floor: int, similarity: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The depth to shorten to after ``depth``, which is itself if that has the recall; ``bins``: similarity bin -> links found.

    A link at the threshold is assumed beside those found, so that what has
    not been met at all counts as well.
    """
    counts = {**bins, int(similarity / BIN): bins.get(int(similarity / BIN), 0) + 1}
    whole = {b: n / met(min(1.0, max(b * BIN, similarity)), depth, trees) for b, n in counts.items()}
    share = lambda k: sum(x * met(min(1.0, max(b * BIN, similarity)), k, trees) for b, x in whole.items()) / sum(whole.values())
    return next((k for k in range(depth, floor, -1) if share(k) >= recall), floor)


def _odd(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    """Word -> 64-bit digest."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return found


def shingle_sets(texts: list[str], words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle digests of each text."""
    split = [t.lower().split() for t in texts]
    digests = np.fromiter((words[w] for s in split for w in s), dtype=np.uint64, count=sum(map(len, split)))
    powers, ends = _odd(size, 5), np.cumsum([len(s) for s in split])
    mixed = np.zeros(max(0, len(digests) - size + 1), dtype=np.uint64)
    for k in range(size):
        mixed += (digests[k : k + len(mixed)] ^ (digests[k : k + len(mixed)] >> np.uint64(29))) * powers[k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = []
    for s, end in zip(split, ends.tolist()):
        if len(s) >= size:
            out.append(np.unique(mixed[end - len(s) : end - size + 1]))
        elif s:
            out.append(np.array([int.from_bytes(hashlib.blake2b(" ".join(s).encode(), digest_size=8).digest(), "little")], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def paths(sets: list[np.ndarray], trees: int, depth: int = LONGEST) -> np.ndarray:
    """(set, tree, bytes): the minimum hashes of each tree, ``LABEL`` bytes each; sets are not empty."""
    if not sets:
        return np.empty((0, trees, LABEL * depth), dtype=np.uint8)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    factor, flip = _odd(trees * depth, 11), _odd(trees * depth, 13)
    out, place = np.empty((len(sets), trees * depth), dtype=np.uint16), np.empty_like(flat)
    for k in range(trees * depth):
        np.bitwise_xor(flat, flip[k], out=place)
        np.multiply(place, factor[k], out=place)
        least = np.minimum.reduceat(place, starts)
        out[:, k] = ((least ^ (least >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
    return out.astype(">u2").view(np.uint8).reshape(len(sets), trees, LABEL * depth)


def _small(table: DataFrame) -> DataFrame:
    return small(table, BROADCAST_ROWS)


def _name(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sets(df: DataFrame, size: int, trees: int, full: bool) -> DataFrame:
    """``df`` with the set's name and its paths, one tree's after another; ``full``: with the shingles too."""
    added = "name binary, paths binary, " + ("shingles binary" if full else "weight int")

    def make():
        words = Words()

        def work(texts):
            sets = shingle_sets([t or "" for t in texts.to_pylist()], words, size)
            held = [k for k, s in enumerate(sets) if len(s)]
            own: list = [None] * len(sets)
            for k, row in zip(held, paths([sets[k] for k in held], trees)):
                own[k] = row.tobytes()
            names = [_name(s) for s in sets]
            return names, own, [s.tobytes() if full else len(s) for s in sets]

        return work

    return add_columns(df, "text", added, make, [c for c in df.columns if c != "text"])


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) sizes of intersections."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), dtype=np.float32)

    def places(sets):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.searchsorted(shared, flat)
        fine = shared[np.minimum(column, len(shared) - 1)] == flat
        order = np.argsort(column[fine], kind="stable")
        return column[fine][order], owner[fine][order]

    if len(shared):
        sides = [(places(x), len(x)) for x in ((left,) if left is right else (left, right))]
        for a in range(0, len(shared), COLUMNS):
            held = []
            for (column, owner), n in sides:
                low, high = np.searchsorted(column, [a, a + COLUMNS])
                one = np.zeros((n, min(COLUMNS, len(shared) - a)), dtype=np.float32)
                one[owner[low:high], column[low:high] - a] = 1
                held.append(one)
            out += held[0] @ held[-1].T
    return out


def _prefixes(raw: list[bytes], depth: int) -> np.ndarray:
    """(set, tree) -> a number for the path's prefix of ``depth``, equal where those are."""
    labels = np.array([np.frombuffer(x, dtype=">u2") for x in raw]).astype(np.uint64).reshape(len(raw), -1, LONGEST)
    out = np.zeros(labels.shape[:2], dtype=np.uint64)
    for k in range(depth):
        # Four labels fill the number; further ones are mixed in.
        out = (out << np.uint64(16) | labels[:, :, k]) if k < 4 else (out ^ labels[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
    return out


def verify(rows: list[tuple], tree: int, depth: int, before: int | None, similarity: float) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """(set, links, smallest connected set) of a node's block pair, and its links by similarity.

    rows: set, block, copies, paths, shingles.  A pair counts only if it meets
    in no earlier tree at ``depth`` and in no tree at the depth ``before``.
    """
    rows = sorted(rows, key=lambda r: r[1])
    ids = np.array([r[0] for r in rows])
    copies = np.array([r[2] for r in rows], dtype=np.int64)
    sets = [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    raw = [r[3] for r in rows]
    known = [_prefixes(raw, depth)[:, :tree]] if tree else []
    known += [_prefixes(raw, before)] if before else []
    blocks = np.array([r[1] for r in rows])
    halves = [np.arange(len(rows))] if blocks[0] == blocks[-1] else [np.flatnonzero(blocks == b) for b in (blocks[0], blocks[-1])]
    tiles = [[h[a : a + TILE] for a in range(0, len(h), TILE)] for h in halves]
    linked, bins = np.zeros((len(rows), len(rows)), dtype=bool), {}
    for k, a in enumerate(tiles[0]):
        for b in tiles[0][k:] if len(tiles) == 1 else tiles[1]:
            left = [sets[i] for i in a]
            common = common_counts(left, left if a is b else [sets[i] for i in b])
            union = sizes[a][:, None] + sizes[b][None, :] - common
            near = common >= similarity * union - 1e-6
            for keys in known:
                for t in range(keys.shape[1]):
                    near &= keys[a, t][:, None] != keys[b, t][None, :]
            if a is b:
                np.fill_diagonal(near, False)
            where, count = np.unique(np.floor(common[near] / union[near] / BIN + 1e-6).astype(int), return_counts=True)
            for x, n in zip(where.tolist(), count.tolist()):
                bins[x] = bins.get(x, 0) + n
            linked[np.ix_(a, b)] = near
            linked[np.ix_(b, a)] = near.T
    links = np.array([copies[row].sum() for row in linked])
    label, last = ids.copy(), None
    while last is None or (label != last).any():
        last = label
        label = np.array([min(own, label[row].min(initial=own)) for own, row in zip(label, linked)])
    return [(int(ids[k]), int(links[k]), int(label[k])) for k in np.flatnonzero(links)], bins


def _verified(dealt: DataFrame, depth: int, before: int | None, similarity: float) -> DataFrame:
    """Runs ``verify`` over rows that come sorted by group; links by similarity are lines without a set."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("tree", "node", "low", "high", "set", "block", "copies", "paths", "shingles")))

        out, bins = [], {}
        for (tree, *_), group in groupby(rows(), key=lambda r: r[:4]):
            members = [r[4:] for r in group]
            if len(members) > 1:
                found, seen = verify(members, tree, depth, before, similarity)
                out += found
                for b, n in seen.items():
                    bins[b] = bins.get(b, 0) + n
            if len(out) > 10_000:
                yield table(out)
                out = []
        out += [(None, n, b) for b, n in bins.items()]
        if out:
            yield table(out)

    def table(out):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["set", "links", "least"])

    return dealt.mapInArrow(run, "set long, links long, least long")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label): the smallest node that each node is connected with."""
    both = scratch.table(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        # The smallest label among neighbours, and the label of one's label.
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        chain = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = labels.join(near, "node").join(chain, "label", "left")
        after = scratch.table(moved.select("node", F.least("label", "near", "further").alias("label"), F.col("label").alias("old")))
        if after.where("label <> old").isEmpty():
            return labels
        labels = after.select("node", "label")


def _members(scratch: Scratch, trie: DataFrame, held: DataFrame, depth: int, before: int | None, trees: int) -> DataFrame:
    """(tree, node, set, blocks): the sets below each node at ``depth`` that has pairs to verify.

    A node whose sets are all below one node of an earlier tree, or were all
    below one at the depth ``before``, has none; where nodes of several trees
    hold the same sets, the first tree's is left.
    """
    filed = trie.select("set", "weight", "tree", F.substring("path", 1, LABEL * depth).alias("node"))
    depths = [depth, before] if before else [depth]
    digest = lambda t, k: F.xxhash64(F.substring("paths", t * LABEL * LONGEST + 1, LABEL * k))
    marks = held.select("set", *[digest(t, k).alias(f"d{k}_{t}") for k in depths for t in range(trees)])
    same = [F.min(f"d{k}_{t}").eqNullSafe(F.max(f"d{k}_{t}")).alias(f"e{k}_{t}") for k in depths for t in range(trees)]
    nodes = filed.join(marks, "set").groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), *same).where("n > 1")
    first = F.array_position(F.array(*[F.col(f"e{depth}_{t}") for t in range(trees)]), True) - 1
    nodes = nodes.where(first == F.col("tree"))
    if before:
        nodes = nodes.where(~F.array_contains(F.array(*[F.col(f"e{before}_{t}") for t in range(trees)]), True))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, 8 * F.col("weight") / BLOCK_BYTES)).cast("int")
    nodes = scratch.table(nodes.select("tree", "node", blocks.alias("blocks")))
    return filed.drop("weight").join(_small(nodes), ["tree", "node"])


def _matched(scratch: Scratch, trie: DataFrame, held: DataFrame, depth: int, before: int | None, similarity: float, trees: int) -> DataFrame:
    """What ``verify`` says of all pairs that meet at ``depth`` and not at ``before``."""
    own = F.pmod(F.xxhash64("set", F.lit(3)), F.col("blocks")).cast("int")
    dealt = _members(scratch, trie, held, depth, before, trees).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tree", "node", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "set", "block").join(held, "set")
    group = ["tree", "node", "low", "high"]
    return scratch.table(_verified(dealt.repartition(*group).sortWithinPartitions(*group), depth, before, similarity))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE, trees: int = TREES) -> DataFrame:
    """One line per row: doc_id, digest (of the text), class_id, n_links (other documents linked to it)."""
    return _lines(docs, doc_id, text, similarity, size, trees).drop("label")


def _lines(docs: DataFrame, doc_id: str, text: str, similarity: float, size: int = SHINGLE, trees: int = TREES) -> DataFrame:
    """``classes`` with ``label``, the class itself: ids are no names of classes, they can be null or stand on several texts."""
    scratch, longest = Scratch(docs.sparkSession), LABEL * LONGEST
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    slim = scratch.table(_sets(rows, size, trees, full=False))
    sets = slim.where("name IS NOT NULL").groupBy("name").agg(
        F.min("doc_id").alias("least_id"), F.min("digest").alias("digest"), F.count(F.lit(1)).alias("copies"), F.first("paths").alias("paths"), F.first("weight").alias("weight")
    )
    sets = scratch.table(sets.withColumn("set", F.monotonically_increasing_id()))
    own_path = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("paths", t * longest + 1, F.lit(longest)))
    floor = floor_depth(similarity, trees)
    trie = sets.select("set", "weight", F.posexplode(own_path).alias("tree", "path")).withColumn("node", F.substring("path", 1, LABEL * floor))
    nodes = scratch.table(trie.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tree", "node"))
    trie = trie.join(_small(nodes), ["tree", "node"], "left_semi").drop("node")
    trie = scratch.table(trie.repartitionByRange("tree", "path", "set").sortWithinPartitions("tree", "path", "set"))
    # Shingles of candidates are made again from their texts: kept for all documents they would outweigh the corpus.
    several = scratch.table(trie.select("set").distinct())
    wanted = scratch.table(sets.join(_small(several), "set", "left_semi").select("set", "digest", F.col("name").alias("known"), "copies"))
    texts = rows.select("digest", "text").join(_small(scratch.table(wanted.select("digest").distinct())), "digest", "left_semi")
    # One text for each digest; it stays where that puts it for the join with what is known of it.
    held = _sets(texts.dropDuplicates(["digest"]).join(wanted, "digest"), size, trees, full=True).where("name = known")
    held = scratch.table(held.select("set", "copies", "paths", "shingles"))
    depth, before, lines, bins = LONGEST, None, [], {}
    while True:
        lines.append(_matched(scratch, trie, held, depth, before, similarity, trees))
        for r in lines[-1].where("set IS NULL").groupBy("least").agg(F.sum("links").alias("n")).collect():  # 1 / BIN rows
            bins[r.least] = bins.get(r.least, 0) + r.n
        shorter = next_depth(bins, depth, floor, similarity, trees)
        if shorter == depth:
            break
        depth, before = shorter, depth
    found = lines[0]
    for more in lines[1:]:
        found = found.unionByName(more)
    found = found.where("set IS NOT NULL")
    labels = components(scratch, found.select(F.col("set").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    named = sets.select("set", "name", "least_id", "copies").join(links, "set", "left").join(labels.withColumnRenamed("node", "set"), "set", "left")
    named = scratch.table(named.withColumn("label", F.coalesce("label", "set")))
    heads = scratch.table(named.groupBy("label").agg(F.min("least_id").alias("class_id")))
    named = named.join(heads, "label").select("name", "label", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = scratch.table(named)
    lines = slim.select("doc_id", "digest", "name").join(named, "name", "left").select(
        "doc_id", "digest", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "label"
    )
    return scratch.last(lines)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class (of its smallest id, then text digest), every column as it was."""
    scratch = Scratch(docs.sparkSession)
    lines = _lines(docs, doc_id, text, similarity)
    linked = lines.where("n_links > 0")
    best = linked.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("best"))
    stay = scratch.table(best.select(F.col("best.doc_id").alias("__id"), F.col("best.digest").alias("__digest")))
    gone = scratch.table(linked.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct())
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(doc_id).cast("long").alias("__id"), F.xxhash64(text_of(text)).alias("__digest"))
    same = lambda other: (own["__digest"] == other["__digest"]) & own["__id"].eqNullSafe(other["__id"])
    alone = own.join(gone, same(gone), "left_anti")
    first = own.join(stay, same(stay), "left_semi").dropDuplicates(["__id", "__digest"])
    return alone.unionByName(first).select("own.*")
