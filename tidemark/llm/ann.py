"""Approximate nearest neighbours by cross-polytope hashing.

A rotation turns the unit vector pseudo-randomly (three rounds of random signs
and a fast Hadamard transform) and takes the nearest signed axis; the axes of
several rotations together name a bucket.  ``tables`` independent hashes file
every vector once each.  A query probes, in every table, the buckets whose axes
are nearest to its own rotations by the sum of their coordinates.  What it
meets there is reranked by the exact distance on the original vectors.

One rule sets rotations and probes at every size.  Rotations: the fewest, two
at least, with which a bucket would hold ``BUCKET_ROWS`` vectors or fewer if
all were even.  Probes: a bounded sample of the queries (``SAMPLE``, those of
least digest) is compared with every vector, and the probes are as many as
find the share ``recall`` of their true neighbours.  Where that many probes
would look at every bucket or more, as with unrelated vectors of many
components, the queries look through one table whole, which is exact.

Vectors are shuffled once for each table, into shelves: buckets grouped by
their number so that a shelf fits in a task.  A shelf with more, such as one
with a bucket of copies, is dealt to parts by id, and its queries to parts as
well; no task holds more than a bounded number of either.  A task returns each
query's best few only.  Queries that have met fewer than ``count`` vectors
look through one table whole.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, as query or candidate; nor do rows with a null id.
Vectors of different lengths are no neighbours of each other.  Rows with the
query's id are its own.  An id counts once, however often it is repeated, with
its nearest vector; a query id that stands on several vectors is one query for
all of them.  Ties go to the smaller id.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, add_columns

TABLES, RECALL = 4, 0.95
#: Queries that the probes are measured on at most.
SAMPLE = 128
#: Vectors in an even bucket at most; bytes of vectors (as doubles) in a shelf, and of queries in a part.
BUCKET_ROWS, SHELF_BYTES = 1 << 16, 8 << 20
#: Combinations of axes that are ranked directly; beyond it a bound is found first.
COMBINED = 1 << 22


def width_of(size: int) -> int:
    """Signed axes of vectors with ``size`` components, which are padded to a power of two."""
    return 2 << max(0, size - 1).bit_length()


def rotated(unit: np.ndarray, seed: int) -> np.ndarray:
    """Rows rotated by three rounds of random signs and Hadamard transforms, padded to a power of two."""
    n, d = unit.shape
    wide = width_of(d) // 2
    x = np.zeros((n, wide), dtype=np.float32)
    x[:, :d] = unit
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, wide)).astype(np.float32)
    for k in range(3):
        x *= signs[k]
        half = 1
        while half < wide:
            x = x.reshape(n, wide // (2 * half), 2, half)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
            half *= 2
        x = x.reshape(n, wide) / np.float32(np.sqrt(wide))
    return x


def unit_of(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def buckets(unit: np.ndarray, tables: int, rotations: int) -> np.ndarray:
    """(row, table) -> number of the bucket: axis ``k`` is ``2k``, its opposite ``2k + 1``, the rotations' axes are its digits."""
    wide, out = width_of(unit.shape[1]), np.zeros((len(unit), tables), dtype=np.int64)
    for table in range(tables):
        for k in range(rotations):
            x = rotated(unit, table * 16 + k)
            axis = np.abs(x).argmax(axis=1)
            out[:, table] += (2 * axis + (x[np.arange(len(x)), axis] < 0)) * wide**k
    return out


def nearness(unit: np.ndarray, table: int, rotations: int) -> np.ndarray:
    """(row, rotation, axis) -> coordinate on the signed axis."""
    turned = [rotated(unit, table * 16 + k) for k in range(rotations)]
    return np.stack([np.stack([x, -x], axis=2).reshape(len(x), -1) for x in turned], axis=1)


def best_buckets(near: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` buckets with the largest sums of coordinates, of one row's (rotation, axis)."""
    sums, keys = np.zeros(1), np.zeros(1, dtype=np.int64)
    for k, axes in enumerate(near):
        one, two = largest_sums(sums, axes, probes)
        sums, keys = sums[one] + axes[two], keys[one] + two * len(axes) ** k
    return keys


def largest_sums(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``a``, in ``b``) of the ``most`` largest sums of one of each, or of all.

    Few combinations are ranked directly.  Of many, a bound is found that just
    ``most`` sums reach, by halving; only those are ever laid out.
    """
    if len(a) * len(b) <= max(most, COMBINED):
        total = (a[:, None] + b[None, :]).ravel()
        best = np.argpartition(-total, most - 1)[:most] if most < len(total) else np.arange(len(total))
        return best // len(b), best % len(b)
    order = np.argsort(-b, kind="stable")
    falling = b[order]
    reached = lambda bound: np.searchsorted(-falling, -(bound - a), "right")  # noqa: E731 - for each of ``a``, how many of ``b`` are enough
    low, high = float(a.min() + b.min()), float(a.max() + b.max())
    for _ in range(64):
        middle = (low + high) / 2
        low, high = (middle, high) if int(reached(middle).sum()) >= most else (low, middle)
    counts = np.minimum(reached(low - 1e-9 * max(1.0, abs(low))), len(b))
    one = np.repeat(np.arange(len(a)), counts)
    two = order[np.arange(len(one)) - np.repeat(np.cumsum(counts) - counts, counts)]
    best = np.argpartition(-(a[one] + b[two]), most - 1)[:most] if most < len(one) else np.arange(len(one))
    return one[best], two[best]


def rank_of(near: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """How many buckets a row's probes reach before each of ``bucket``, by (rotation, axis) coordinates."""
    wide, own, rest = near.shape[1], np.zeros(len(bucket)), np.asarray(bucket)
    for axes in near:
        own, rest = own + axes[rest % wide], rest // wide
    sums = np.zeros(1)
    for axes in near[:-1]:
        sums = (sums[:, None] + axes[None, :]).ravel()
    last = np.sort(near[-1])
    return np.array([int((len(last) - np.searchsorted(last, o - sums + 1e-6)).sum()) for o in own])


def _vectors(arrays) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> positions and rows, of the vectors that take part."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
    starts, out = np.cumsum(lengths) - lengths, {}
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        x = flat[starts[at][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if fine.any():
            out[d] = at[fine], x[fine]
    return out


@dataclass(frozen=True)
class Plan:
    """How vectors of one length are filed and looked for; ``probes`` None: everywhere."""

    rotations: int
    shelves: int
    probes: int | None = None


def rotations_for(rows: int, size: int) -> int:
    count = 2
    while rows > BUCKET_ROWS * width_of(size) ** count:
        count += 1
    return count


def shelf_rows(size: int) -> int:
    return max(1, SHELF_BYTES // (8 * size))


def plan_for(rows: int, size: int) -> Plan:
    """Rotations and shelves; an odd number of shelves, so that buckets spread over them by their remainder."""
    return Plan(rotations_for(rows, size), (-(-rows // shelf_rows(size))) | 1)


def _hashed(df: DataFrame, plans: dict[int, Plan], tables: int, kind: str) -> DataFrame:
    """(id) with size, the vector as bytes of ``kind`` and its bucket in each table; invalid vectors go."""

    def make():
        def work(arrays):
            n = len(arrays)
            size, packed, found = [None] * n, [None] * n, [None] * n
            for d, (at, x) in _vectors(arrays).items():
                own = x.astype(kind)
                for k, row, b in zip(at.tolist(), own, buckets(unit_of(x), tables, plans[d].rotations).tolist()):
                    size[k], packed[k], found[k] = d, row.tobytes(), b
            return size, packed, found

        return work

    return add_columns(df, "vector", "size int, packed binary, buckets array<bigint>", make, keep=["id"]).where("size IS NOT NULL")


def _wanted(hashed: DataFrame, plans: dict[int, Plan], tables: int, kind: str) -> DataFrame:
    """(id, size, packed, looks): for each shelf of each table the buckets that a query probes there, as bytes; none for lengths that look everywhere."""

    def make():
        def work(arrays):
            raw = arrays.to_pylist()
            out: list = [[] for _ in raw]
            by: dict[int, list[int]] = {}
            for k, x in enumerate(raw):
                by.setdefault(len(x) // np.dtype(kind).itemsize, []).append(k)
            for d, at in by.items():
                plan = plans[d]
                unit = unit_of(np.array([np.frombuffer(raw[k], dtype=kind) for k in at], dtype=np.float64))
                for table in range(tables if plan.probes else 0):
                    for k, near in zip(at, nearness(unit, table, plan.rotations)):
                        keys = best_buckets(near, plan.probes)
                        shelf = keys % plan.shelves
                        order = np.argsort(shelf, kind="stable")
                        own, first = np.unique(shelf[order], return_index=True)
                        for s, part in zip(own.tolist(), np.split(keys[order], first[1:])):
                            out[k].append({"table": table, "shelf": s, "bucket": part.tobytes()})
            return (out,)

        return work

    return add_columns(hashed, "packed", "looks array<struct<table:int,shelf:bigint,bucket:binary>>", make, keep=["id", "size", "packed"])


def _nearest(queries, near, count: int, kind: str):
    """Each query's best ``count`` ids of the vectors in the buckets that it probes, by exact distance, ties to the smaller id."""
    import pandas as pd

    nothing = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    if queries.empty or near.empty:
        return nothing
    near = near.sort_values(["bucket", "id"], kind="stable")
    q, v = (np.frombuffer(b"".join(x.packed), dtype=kind).reshape(len(x), -1).astype(np.float64) for x in (queries, near))
    ids, held = near.id.to_numpy(), near.bucket.to_numpy()
    norms, most = (v * v).sum(axis=1), len(v)
    out = []
    for row, own, raw in zip(q, queries.id.tolist(), queries.bucket):
        if raw is None:
            at = np.arange(most)
        else:
            probed = np.frombuffer(raw, dtype=np.int64)
            low, high = np.searchsorted(held, probed), np.searchsorted(held, probed, "right")
            low, n = low[high > low], (high - low)[high > low]
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = at[ids[at] != own]
        if not len(at):
            continue
        square = row @ row
        rough = norms[at] + square - 2 * (v[at] @ row)
        # An id may be repeated: enough places for ``count`` ids are looked for before the cut.
        places = count
        while places < len(at):
            kth = np.partition(rough, places - 1)[places - 1]
            inside = at[rough <= kth + 1e-9 * (norms[at].max() + square)]
            if len(np.unique(ids[inside])) >= count:
                at = inside
                break
            places *= 4
        exact = np.sqrt(((v[at] - row) ** 2).sum(axis=1))
        best = np.lexsort((ids[at], exact))
        best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])][:count]
        out.append((np.full(len(best), own), ids[at][best], exact[best]))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out))))) if out else nothing


def _meet(scratch: Scratch, filed: DataFrame, asked: DataFrame, count: int, kind: str) -> DataFrame:
    """Nearest of each shelf; ``filed``: id, size, packed, table, shelf, bucket; ``asked``: the same with the probed buckets, null for all."""
    shelf = ["size", "table", "shelf"]
    room = F.greatest(F.lit(1), F.floor(F.lit(SHELF_BYTES) / (8 * F.col("size"))))
    rows = filed.groupBy(*shelf).agg(F.count(F.lit(1)).alias("rows"))
    asks = asked.groupBy(*shelf).agg(F.count(F.lit(1)).alias("asks"))
    parts = scratch.table(rows.join(asks, shelf).select(*shelf, F.ceil(F.col("rows") / (2 * room)).alias("parts"), F.ceil(F.col("asks") / (2 * room)).alias("turns")))
    both = lambda own, other: (F.pmod(F.xxhash64("id"), F.col(own)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
    part, turn = both("parts", "turns")
    dealt = filed.join(parts, shelf).select(*shelf, part.alias("part"), turn.alias("turn"), "id", "packed", "bucket")
    turn, part = both("turns", "parts")
    sent = asked.join(parts, shelf).select(*shelf, turn.alias("turn"), part.alias("part"), "id", "packed", "bucket")
    keys = [*shelf, "part", "turn"]
    return sent.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(lambda q, v: _nearest(q, v, count, kind), "query_id long, vec_id long, score double")


def _true_neighbours(hashed: DataFrame, asked: list, count: int, kind: str) -> list:
    """(query's place, id, score, buckets) of the nearest ``count`` of all vectors to each of ``asked``, a bounded list of (id, size, packed)."""
    by: dict[int, list[int]] = {}
    for k, r in enumerate(asked):
        by.setdefault(r.size, []).append(k)
    held = {d: (np.array(at), np.array([asked[k].id for k in at]), np.array([np.frombuffer(asked[k].packed, dtype=kind) for k in at], dtype=np.float64)) for d, at in by.items()}

    def scan(frames):
        import pandas as pd

        for frame in frames:
            for d, part in frame.groupby("size"):
                if d not in held:
                    continue
                at, own, q = held[d]
                v, ids = np.frombuffer(b"".join(part.packed), dtype=kind).reshape(len(part), -1).astype(np.float64), part.id.to_numpy()
                apart = np.maximum((q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * q @ v.T, 0)
                apart[own[:, None] == ids] = np.inf
                places = min(count, len(ids))
                best = np.argpartition(apart, places - 1, axis=1)[:, :places]
                place, row = np.repeat(np.arange(len(at)), places), best.ravel()
                fine = np.isfinite(apart[place, row])
                place, row = place[fine], row[fine]
                yield pd.DataFrame({"place": at[place], "id": ids[row], "score": apart[place, row], "buckets": part.buckets.to_numpy()[row]})

    lines = hashed.mapInPandas(scan, "place int, id long, score double, buckets array<bigint>")
    once = lines.groupBy("place", "id").agg(F.min_by(F.struct("score", "buckets"), "score").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("x.score", "id", "x.buckets")))
    return once.groupBy("place").agg(F.slice(ordered, 1, count).alias("best")).collect()  # SAMPLE rows at most


def tuned(hashed: DataFrame, wanted: DataFrame, plans: dict[int, Plan], tables: int, count: int, recall: float, kind: str) -> dict[int, Plan]:
    """``plans`` with as many probes as find ``recall`` of the true neighbours of a sample of the queries."""
    asked = wanted.select("id", "size", "packed").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    ranks: dict[int, list[int]] = {}
    for r in _true_neighbours(hashed, asked, count, kind):
        query = asked[r.place]
        unit = unit_of(np.frombuffer(query.packed, dtype=kind).astype(np.float64)[None, :])
        found = np.array([x.buckets for x in r.best])
        least = [rank_of(nearness(unit, t, plans[query.size].rotations)[0], found[:, t]) for t in range(tables)]
        ranks.setdefault(query.size, []).extend(np.min(least, axis=0).tolist())
    out = {}
    for size, plan in plans.items():
        probes = None
        if size in ranks:
            own = sorted(ranks[size])
            probes = own[max(0, int(np.ceil(recall * len(own))) - 1)] + 1
            if probes * tables >= width_of(size) ** plan.rotations:
                probes = None
        out[size] = Plan(plan.rotations, plan.shelves, probes)
    return out


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", count: int = 10, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``count`` nearest of ``vectors`` that each row of ``queries`` has found."""
    scratch = Scratch(vectors.sparkSession)
    single = all(df.schema[vector].dataType.elementType.typeName() == "float" for df in (vectors, queries))
    kind, column = ("float32", "array<float>") if single else ("float64", "array<double>")
    rows = lambda df: df.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(column).alias("vector"))
    counted = rows(vectors).groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("rows")).union(rows(queries).groupBy(F.size("vector")).agg(F.lit(1).cast("long")))
    plans = {r["size"]: plan_for(r["rows"], r["size"]) for r in counted.groupBy("size").agg(F.max("rows").alias("rows")).where("size > 0").collect()}  # lengths of vectors
    hashed = scratch.table(_hashed(rows(vectors), plans, tables, kind))
    own = scratch.table(_hashed(rows(queries), plans, 0, kind).select("id", "size", "packed").distinct())
    plans = tuned(hashed, own, plans, tables, count, recall, kind)
    wanted = scratch.table(_wanted(own, plans, tables, kind))
    shelves = F.create_map(*[F.lit(x).cast("bigint") for d, p in plans.items() for x in (d, p.shelves)]) if plans else F.create_map(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))
    filed = hashed.select("id", "size", "packed", F.posexplode("buckets").alias("table", "bucket")).withColumn("shelf", F.pmod("bucket", shelves[F.col("size").cast("bigint")]))
    asked = wanted.select("id", "size", "packed", F.explode("looks").alias("look")).select("id", "size", "packed", "look.table", "look.shelf", "look.bucket")
    found = scratch.table(_best(_meet(scratch, filed, asked, count, kind), count))
    # One table whole for queries with too few, and for those of lengths that look everywhere.
    enough = found.where(F.size("best") >= count).select(F.col("query_id").alias("id"))
    whole = [d for d, p in plans.items() if p.probes is None]
    few = own.join(enough, "id", "left_anti").unionByName(own.where(F.col("size").isin(whole)).join(enough, "id", "left_semi"))
    few = scratch.table(few)
    if not few.isEmpty():
        first = filed.where("table = 0")
        everywhere = few.join(scratch.table(first.select("size", "table", "shelf").distinct()), "size").withColumn("bucket", F.lit(None).cast("binary"))
        rest = _meet(scratch, first, everywhere, count, kind)
        found = _best(found.select("query_id", F.explode("best").alias("x")).select("query_id", "x.vec_id", "x.score").unionByName(rest), count)
    lines = found.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
    return scratch.last(lines)


def _best(lines: DataFrame, count: int) -> DataFrame:
    """A query's best ids of all its parts; each has sent ``count`` rows at most."""
    once = lines.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ordered = F.array_sort(F.collect_list(F.struct("score", "vec_id")))
    return once.groupBy("query_id").agg(F.slice(ordered, 1, count).alias("best"))
