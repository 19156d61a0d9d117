"""Removal of repeated byte strings by prefix-free parsing.

A byte goes if some ``LENGTH`` bytes that cover it start anywhere else too.
Rolling hashes of ``TRIGGER`` bytes cut texts into phrases: each string of
``LENGTH`` bytes belongs to the trigger with the least hash (the first, if
several) that ends within its first ``REACH`` bytes.  Its own bytes decide
which that is, so equal strings are cut alike, and every one meets a trigger.
Behind the trigger stands the parse (at least ``LENGTH - REACH`` bytes, whose
digest is the ``bucket``), in front of it a suffix of the phrase.

* Parse: a trigger with phrase and ``LENGTH`` bytes that occur more than once
  settles all of its strings: most of a repetitive text ends here, by names
  only.  Buckets with a single phrase and context need nothing more.
* What is left, the edges of repeats, goes to the dictionary: each distinct
  phrase with context once.  It is sorted by what follows the trigger (the
  suffix array of the parse) and by the phrase read backward (the suffix array
  of the dictionary's phrases); neighbours tell how far each matches any
  other, behind and in front.  Only strings inside both reaches can occur
  again: the two orders combine to those, and names of (suffix, context) tell
  which do.

Both sorts are range sorts by bucket and bytes and at last by entry, so a
passage in a third of all texts fills many partitions; an entry at the end of
a partition has one neighbour unknown and is not narrowed down.  Everything
else is counting by key and joins in which one side has each key once.
Texts are known by 16 bytes of their SHA-256, phrases and strings by 128 bits
or more of polynomial hashes.

Defined results: null texts are empty; texts under ``LENGTH`` bytes stay
whole; of repeated rows every byte goes (if long enough); long texts are cut
in stretches of ``STRETCH`` strings, which changes nothing in the result; an
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, slices, text_of

LENGTH, TRIGGER, REACH = 400, 16, 256
BEHIND = LENGTH - REACH
STRETCH = 1 << 20
#: Entries of the dictionary that one partition sorts.
ENTRIES = 50_000
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bits of a trigger's place; the bits above hold its hash.
PLACE = 31


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: Numbers that a task has made already.
_MADE: dict[tuple, np.ndarray] = {}


def codes(which: int) -> np.ndarray:
    """A 64-bit number for each byte."""
    if (which,) not in _MADE:
        _MADE[(which,)] = mix(mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASES[which])))
    return _MADE[(which,)]


def powers(which: int, inverse: bool, size: int) -> np.ndarray:
    """Powers of a base, or of its inverse modulo 2^64: ``size`` and one more."""
    if (which, inverse, size) not in _MADE:
        base = pow(BASES[which], -1, 1 << 64) if inverse else BASES[which]
        _MADE[which, inverse, size] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, base, dtype=np.uint64))])
    return _MADE[which, inverse, size]


class Sums:
    """Digests of any substring of ``data``, from sums of its bytes' numbers times powers of a base."""

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << max(10, len(data).bit_length())
        self.powers = powers(which, False, size)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes(which)[data] * powers(which, True, size)[: len(data)], dtype=np.uint64)])

    def __call__(self, start, stop) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.powers[stop])


def prefixes(data: bytes, which: int) -> np.ndarray:
    """Digests of all prefixes of ``data``."""
    held = codes(which)[np.frombuffer(data, dtype=np.uint8)]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(held * powers(which, False, 1024)[: len(held)], dtype=np.uint64)])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    held = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    held[: len(values)] = values
    blocks = held.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def triggers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Triggers of texts that end at ``ends``: place, farthest and nearest string that is theirs, bucket, name."""
    starts = np.concatenate([[0], ends[:-1]])
    # Strings never cross the end of a text.
    own = np.concatenate([np.arange(s, max(s, e - LENGTH + 1)) for s, e in zip(starts.tolist(), ends.tolist())]) if len(ends) else np.zeros(0, np.int64)
    if not len(own):
        return (np.zeros(0, np.int64),) * 5
    one = Sums(data, 0)
    places = np.arange(TRIGGER, len(data) + 1)
    keys = ((one(places - TRIGGER, places) >> np.uint64(PLACE)) << np.uint64(PLACE)) | places.astype(np.uint64)
    at = (sliding_least(keys, REACH - TRIGGER + 1)[own] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    at, far, near = at[first], at[first] - own[first], at[last] - own[last]
    name = Sums(data, 1)(at - far, at + LENGTH - near)
    return at, far, near, one(at, at + BEHIND).view(np.int64), name.view(np.int64)


def stretches(texts: list[bytes]):
    """Texts as bounded arrays: (numbers of the texts, where their stretches begin, all bytes, ends)."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for start in range(0, max(1, len(text) - LENGTH + 1), STRETCH):
            part = text[start : start + STRETCH + LENGTH - 1]
            if held and size + len(part) > 2 * STRETCH:
                yield held
                held, size = [], 0
            held.append((k, start, part))
            size += len(part)
    if held:
        yield held


def parse(texts: DataFrame) -> DataFrame:
    """All triggers of ``texts`` (key, text): key, at, far, near, bucket, name."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                keys, whole = part.column("key").to_pylist(), [t.encode() for t in part.column("text").to_pylist()]
                for held in stretches(whole):
                    ends = np.cumsum([len(h[2]) for h in held])
                    data = np.frombuffer(b"".join(h[2] for h in held), dtype=np.uint8)
                    at, far, near, bucket, name = triggers(data, ends)
                    text = np.searchsorted(ends, at - far, "right")
                    shift = np.array([h[1] for h in held]) - (ends - np.array([len(h[2]) for h in held]))
                    columns = [pa.array([keys[held[t][0]] for t in text.tolist()], type=pa.binary()), pa.array(at + shift[text] if len(at) else at)]
                    columns += [pa.array(far.astype(np.int16)), pa.array(near.astype(np.int16)), pa.array(bucket), pa.array(name)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "at", "far", "near", "bucket", "name"])

    return texts.mapInArrow(run, "key binary, at bigint, far smallint, near smallint, bucket bigint, name bigint")


def contexts(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """Bytes around the triggers of ``entries`` (entry, key, at, far, near): ``front`` read backward, ``back`` behind the bucket's bytes."""
    wanted = entries.groupBy("key").agg(F.collect_list(F.struct("entry", "bucket", "at", "far", "near")).alias("wanted"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                    data = text.encode()
                    for w in wanted:
                        at, far, near = w["at"], w["far"], w["near"]
                        out.append((w["entry"], w["bucket"], far, near, data[at - far : at][::-1], data[at + BEHIND : at + LENGTH - near]))
                columns = list(zip(*out)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], ["entry", "bucket", "far", "near", "front", "back"])

    # Copies of a text give the same: most go before they meet in one task.
    found = texts.dropDuplicates(["key"]).join(wanted, "key").select("text", "wanted")
    return found.mapInArrow(run, "entry bigint, bucket bigint, far smallint, near smallint, front binary, back binary")


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return int((np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)).argmax())


def matches(batches, column: str, unknown: int):
    """Record batches in sorted order, each with how far every row's ``column`` matches a neighbour in its bucket.

    At the ends of a partition a neighbour is unknown: ``unknown`` is given.
    """
    waiting, before = None, None

    def done(batch, after):
        rows = list(zip(batch.column("bucket").to_pylist(), batch.column(column).to_pylist()))
        around = [before, *rows, after]
        between = [unknown if x is None or y is None else common(x[1], y[1]) if x[0] == y[0] else 0 for x, y in zip(around, around[1:])]
        return rows[-1], np.maximum(between[:-1], between[1:])

    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting is not None:
            held, (before, reach) = waiting, done(waiting, (batch.column("bucket")[0].as_py(), batch.column(column)[0].as_py()))
            yield held, reach
        waiting = batch
    if waiting is not None:
        yield waiting, done(waiting, None)[1]


def in_order(entries: DataFrame, column: str, parts: int) -> DataFrame:
    order = ["bucket", column, "entry"]
    return entries.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def again(entries: DataFrame, parts: int) -> DataFrame:
    """Strings that may occur with several entries: entry, ``before`` (bytes in front of the trigger), and two halves of a name."""

    def behind(batches):
        import pyarrow as pa

        for batch, reach in matches(batches, "back", LENGTH):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.minimum(BEHIND + reach, LENGTH).astype(np.int16))], [*batch.schema.names, "reach"])

    def in_front(batches):
        import pyarrow as pa

        for batch, reach in matches(batches, "front", LENGTH):
            out = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("entry", "bucket", "far", "near", "front", "back", "reach")], reach.tolist())
            for entry, bucket, far, near, front, back, right, left in rows:
                low, high = max(near, LENGTH - right), min(far, left)
                if low <= high:
                    before = np.arange(low, high + 1)
                    seed = np.uint64(bucket & (2**64 - 1))
                    one = mix(prefixes(front, 0)[before] + mix(np.array([seed]) + before.astype(np.uint64)))
                    two = mix(prefixes(back, 1)[LENGTH - before - BEHIND] + mix(one))
                    out.append((np.full(len(before), entry), before, one, two))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 4
            arrays = [pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int16)), *[pa.array(c.astype(np.uint64).view(np.int64)) for c in columns[2:]]]
            yield pa.RecordBatch.from_arrays(arrays, ["entry", "before", "one", "two"])

    kinds = "entry bigint, bucket bigint, far smallint, near smallint, front binary, back binary"
    narrowed = in_order(entries, "back", parts).mapInArrow(behind, kinds + ", reach smallint").where(f"reach >= {LENGTH} - far")
    return in_order(narrowed, "front", parts).mapInArrow(in_front, "entry bigint, before smallint, one bigint, two bigint")


def spans(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``key`` and ``spans`` (start, stop; they may overlap) of all repeated strings of ``texts`` (key, text)."""
    found = scratch.table(parse(texts))
    # Written first: rows of a common bucket are split among tasks only if no aggregate stands between exchange and join.
    often = scratch.table(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"))
    live = scratch.table(found.join(often.hint("merge"), "bucket", "left_semi"))
    scratch.drop(found, often)
    kinds = ["bucket", "name", "far", "near"]
    # One line for each distinct phrase with context.
    entries = scratch.table(live.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("place")).withColumn("entry", F.monotonically_increasing_id()))
    settled = live.join(entries.where("n > 1").select(*kinds), kinds, "left_semi").groupBy("key", "at", "far", "near").agg(F.lit(1).alias("x"))
    settled = settled.select("key", (F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + LENGTH).alias("stop"))
    mixed = scratch.table(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket"))
    edges = scratch.table(entries.join(mixed.hint("merge"), "bucket", "left_semi").select("entry", "bucket", "far", "near", "n", "place.key", "place.at"))
    scratch.drop(mixed)
    held = scratch.table(contexts(texts, edges))
    strings = scratch.table(again(held, 1 + edges.count() // ENTRIES))
    scratch.drop(held)
    several = strings.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
    once = edges.where("n = 1").select("entry", "key", "at")
    partly = strings.join(several, ["one", "two"], "left_semi").join(once, "entry")
    partly = partly.select("key", (F.col("at") - F.col("before")).alias("start"), (F.col("at") - F.col("before") + LENGTH).alias("stop"))
    return settled.unionByName(partly).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(some: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or adjoining spans."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in some):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One line per row: doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    texts = texts.withColumn("key", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    found = scratch.last(spans(texts.where(F.octet_length("text") >= LENGTH).select("key", "text"), scratch))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                kept, counts = [], []
                for whole, some in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    data, runs = whole.encode(), merged(some or [])
                    edges = [0, *[x for run in runs for x in run], len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    counts.append((len(data), len(data) - len(kept[-1]), len(runs)))
                numbers = [pa.array([c[k] for c in counts], type=pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, type=pa.binary()), *numbers], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = texts.join(found, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
