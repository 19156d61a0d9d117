"""Repair of conversation structure by Four-Russians block tables.

A conversation is right if its roles' initials read ``(s?(ua)+)?``: four
states (nothing yet, after the system turn, after a user, after an assistant).
Each row is a symbol: its initial (system, user, assistant or another), and
whether it must go (blank or duplicate) or is truncated.  The costs of
finishing from the four states, less their minimum, form one of a few vectors,
so what a block of ``BLOCK`` symbols makes of a vector is a table: blocks are
looked up from the end of the conversation to its start, and only the vectors
between blocks are kept.  Then the cheapest edits are read forward: each block
is expanded backward from the vector at its end, and at every row the
ASCII-least edit that loses nothing is taken.  The edits so far decide state
and row, so that gives the least of all cheapest edit strings.

Rows are range-sorted by conversation, turn, role, digest of the text and
place, so a conversation that holds a third of all rows lies in many
partitions.  It is worked on in pieces of ``PIECE`` rows: what a piece does to
the costs is a 4 x 4 matrix, and what its edits do to the state is a map of
four; both compose, ``FAN`` pieces at a time, over as many levels as needed.
Rows known before are found by the least place of equal (conversation, role,
text), joined by place, which is unique.  Two things of a conversation meet in
one task, because the result asks for them as one value: its edit string (a
byte a row) and the hash of its repaired text, which streams in order with
bounded memory.

Defined results: nulls in role and text are one space, as they are in the
conversation and turn that the damage is drawn by; null turns come first; ties
in turn go by role and digest of text; a null conversation is one of its own;
repeated rows are duplicates of each other; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Symbols in a block, rows in a piece, pieces that are composed in one call.
BLOCK, PIECE, FAN = 4, 4096, 1024
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
BLANKS = " \t\n\x0b\f\r"

#: States: 0 nothing yet, 1 after a system turn, 2 after a user, 3 after an assistant.
NEXT = (2, 2, 3, 2)  # where the one role that an edit may write there leads
NEVER = 1 << 40
END = (0, 2 * INSERT, INSERT, 0)
#: Symbol 0 must go; 1 + 2 * initial + truncated otherwise, the fourth initial being any other.
SYMBOLS = 9


def kept_to(state: int, initial: int) -> int | None:
    """The state after keeping a row with that initial, if that is legal."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def edits(state: int, symbol: int):
    """The edits that use up a row, ASCII-least first: letter, cost, state after."""
    yield "D", DELETE, state
    if symbol:
        initial, truncated = divmod(symbol - 1, 2)
        to = kept_to(state, initial)
        if to is not None:
            yield "K", truncated * CUT_OFF, to
        yield "R", REROLE + truncated * CUT_OFF, NEXT[state]


def written(letter: str, state: int) -> str:
    """The edit's letter, in lower case where it writes an assistant."""
    return letter.lower() if letter in "IR" and state == 2 else letter


def before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs of finishing from each state in front of a row, given those behind it."""
    costs = [min(cost + after[to] for _, cost, to in edits(q, symbol)) for q in range(4)]
    two, three = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return tuple(min(c, NEVER) for c in (min(costs[0], INSERT + two), min(costs[1], INSERT + two), two, three))


def normal(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(NEVER if c >= NEVER else c - least for c in costs), least


class Tables:
    """All cost vectors that can occur, and what single symbols and blocks make of them."""

    def __init__(self):
        # The end of a conversation, and each single state, from which the matrix of a piece is read.
        self.vectors = [END] + [tuple(0 if q == k else NEVER for q in range(4)) for k in range(4)]
        self.ids, single, lost = {v: k for k, v in enumerate(self.vectors)}, [], []
        for vector in self.vectors:  # grows while it is walked
            steps = [normal(before(vector, s)) for s in range(SYMBOLS)]
            for v, _ in steps:
                if v not in self.ids:
                    self.ids[v] = len(self.vectors)
                    self.vectors.append(v)
            single.append([self.ids[v] for v, _ in steps])
            lost.append([least for _, least in steps])
        to, cost = np.array(single, dtype=np.int32), np.array(lost, dtype=np.int64)
        self.single, self.lost, self.to, self.cost = single, lost, to, cost
        for _ in range(BLOCK - 1):  # one more symbol in front
            self.cost = (self.cost[:, None, :] + cost[self.to].transpose(0, 2, 1)).reshape(len(to), -1)
            self.to = to[self.to].transpose(0, 2, 1).reshape(len(to), -1)
        self.walked: dict = {}

    def codes(self, symbols: np.ndarray) -> tuple[int, np.ndarray]:
        """How many symbols stand in front of the whole blocks, and the blocks' numbers."""
        head = len(symbols) % BLOCK
        return head, symbols[head:].reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def costs(self, symbols: np.ndarray, vector: int) -> tuple[int, ...]:
        """Costs in front of ``symbols``, given the vector behind them."""
        (head, codes), total, to, cost = self.codes(symbols), 0, self.to, self.cost
        for code in codes[::-1].tolist():
            total += int(cost[vector, code])
            vector = int(to[vector, code])
        for s in symbols[:head][::-1].tolist():
            total += self.lost[vector][s]
            vector = self.single[vector][s]
        return tuple(min(NEVER, c + total) for c in self.vectors[vector])

    def walk(self, symbols: tuple[int, ...], vector: int, state: int) -> tuple[str, int, int]:
        """Edits of one block from ``state``, their cost and the state after, by the vectors inside the block."""
        key = symbols, vector, state
        if key not in self.walked:
            inside = [(self.vectors[vector], 0)]
            for s in reversed(symbols):
                costs, least = normal(before(inside[-1][0], s))
                inside.append((costs, inside[-1][1] + least))
            letters, spent = [], 0
            for k, s in enumerate(symbols):
                (here, base), (after, past) = inside[len(symbols) - k], inside[len(symbols) - k - 1]
                while True:
                    now = here[state] + base
                    found = [(e, c, to) for e, c, to in edits(state, s) if c + after[to] + past == now]
                    if found and (found[0][0] == "D" or INSERT + here[NEXT[state]] + base != now):
                        break
                    letters.append(written("I", state))
                    spent, state = spent + INSERT, NEXT[state]
                letters.append(written(found[0][0], state))
                spent, state = spent + found[0][1], found[0][2]
            self.walked[key] = "".join(letters), spent, state
        return self.walked[key]

    def trace(self, symbols: np.ndarray, vector: int, state: int, last: bool) -> tuple[str, int, int]:
        """Edits of a piece from ``state``, their cost and the state after; ``last``: the conversation ends here."""
        (head, codes), behind = self.codes(symbols), [vector]
        for code in codes[::-1].tolist():
            behind.append(int(self.to[behind[-1], code]))
        parts, spent, row = [], 0, symbols.tolist()
        blocks = [tuple(row[:head])] * (head > 0) + [tuple(row[k : k + BLOCK]) for k in range(head, len(row), BLOCK)]
        for block, after in zip(blocks, reversed(behind) if head else reversed(behind[:-1])):
            letters, cost, state = self.walk(block, after, state)
            parts.append(letters)
            spent += cost
        while last and END[state]:
            parts.append(written("I", state))
            spent, state = spent + INSERT, NEXT[state]
        return "".join(parts), spent, state


#: The tables, once a task has made them.
_MADE: list[Tables] = []


def tables() -> Tables:
    if not _MADE:
        _MADE.append(Tables())
    return _MADE[0]


def symbols_of(text: str) -> np.ndarray:
    """Symbols of a piece from its letters: ``A`` + 3 * initial + (0 right, 1 truncated, 2 must go)."""
    letters = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.int64) - 65
    initial, kind = letters // 3, letters % 3
    return np.where(kind == 2, 0, 1 + 2 * initial + kind)


def matrix(text: str) -> list[int]:
    """What a piece does to the costs behind it: ``[4 * q + r]`` is the cost from ``q`` in front to ``r`` behind."""
    held = tables()
    columns = [held.costs(symbols_of(text), 1 + r) for r in range(4)]
    return [columns[r][q] for q in range(4) for r in range(4)]


def matrix_apply(m: list[int], costs: list[int]) -> list[int]:
    return [min(NEVER, min(m[4 * q + r] + costs[r] for r in range(4))) for q in range(4)]


def matrix_compose(first: list[int], then: list[int]) -> list[int]:
    columns = [matrix_apply(first, [then[4 * q + r] for q in range(4)]) for r in range(4)]
    return [columns[r][q] for q in range(4) for r in range(4)]


def scan(scratch: Scratch, pieces: DataFrame, value: str, compose, apply, start: list[int], backward: bool) -> DataFrame:
    """``conv_id``, ``piece`` and ``met``: what arrives at each piece when ``start`` passes through those in front of it (behind it).

    Pieces are composed ``FAN`` at a time until each conversation is one; then
    what arrives goes down again.  No call sees more than ``FAN`` pieces.
    """

    @F.udf("array<bigint>")
    def merged(values):
        out = values[0]
        for v in values[1:]:
            out = compose(out, v)
        return out

    @F.udf("array<array<bigint>>")
    def arrivals(values, met):
        out = []
        for v in reversed(values) if backward else values:
            out.append(met)
            met = apply(v, met)
        return out[::-1] if backward else out

    levels = [pieces.select("conv_id", F.col("piece").alias("at"), F.col(value).alias("value"))]
    while True:
        grouped = levels[-1].groupBy("conv_id", F.expr(f"at div {FAN}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("held"))
        grouped = scratch.table(grouped)
        levels[-1] = grouped
        above = grouped.select("conv_id", F.col("up").alias("at"), merged(F.col("held.value")).alias("value"))
        if grouped.groupBy("conv_id").count().where("count > 1").isEmpty():
            break
        levels.append(above)
    met = grouped.select(F.col("conv_id").alias("c"), F.col("up").alias("u"), F.array(*[F.lit(x).cast("long") for x in start]).alias("met"))
    for grouped in reversed(levels):
        joined = grouped.join(met, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("u")))
        each = joined.select("conv_id", F.explode(F.arrays_zip(F.col("held.at").alias("at"), arrivals(F.col("held.value"), "met").alias("met"))).alias("x"))
        met = each.select(F.col("conv_id").alias("c"), F.col("x.at").alias("u"), F.col("x.met").alias("met"))
    return met.select(F.col("c").alias("conv_id"), F.col("u").alias("piece"), "met")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage drawn by conversation and turn: dropped, emptied, without full stops, repeated or given to the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20).alias("draw"))
    drawn = drawn.where("draw <> 0").withColumns({"was": F.col("role"), "tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return drawn.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "was", "tie", "place", copies)


def plain(rows: DataFrame) -> DataFrame:
    """The rows as they are, in the form that ``repair`` takes."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    held = rows.select("conv_id", "turn", spaced("role"), spaced("text"))
    return held.withColumns({"was": F.col("role"), "tie": F.xxhash64("text"), "place": F.monotonically_increasing_id(), "copy": F.lit(0)})


def ordered(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, their number in the order of conversation and turn, as a written table."""
    order = ["conv_id", "turn", "was", "tie", "place", "copy"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = scratch.table(rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33).alias("part")
    sizes = held.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # a row for each partition
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", (base - F.col("first")).alias("shift"))
    return held.withColumn("part", part).join(F.broadcast(starts), "part").select("conv_id", "turn", "role", "text", (F.col("at") + F.col("shift")).alias("pos"))


def marked(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``pos``, ``blank``, ``duplicate``, ``truncated`` and the row's ``letter``."""
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = rows.select(
        "conv_id", "turn", "pos", "role", (stripped == "").alias("blank"), (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.sha2("text", 256).alias("name"),
    )
    firsts = slim.groupBy("conv_id", "role", "name").agg(F.min("pos").alias("first")).select("first", F.lit(True).alias("new"))
    slim = slim.join(firsts, F.col("pos") == F.col("first"), "left")
    duplicate = ~F.col("blank") & F.col("new").isNull()
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    truncated = ~F.col("blank") & ~duplicate & F.col("open")
    kind = F.when(F.col("blank") | duplicate, 2).when(truncated, 1).otherwise(0)
    return slim.select("conv_id", "turn", "pos", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"), F.char(F.lit(65) + 3 * number + kind).alias("letter"))


def _illegal_inside(letters: str | Column) -> Column:
    """Neighbours in a string of letters whose initials are not su, ua or au."""
    number = lambda k: F.floor((F.ascii(F.substring(letters, k, 1)) - 65) / 3)
    places = F.sequence(F.lit(2), F.greatest(F.length(letters), F.lit(2)))
    bad = F.filter(places, lambda k: (k <= F.length(letters)) & ~_legal(number(k - F.lit(1)), number(k)))
    return F.size(bad).cast("long")


def _legal(left: Column, right: Column) -> Column:
    return ((left == 0) & (right == 1)) | ((left == 1) & (right == 2)) | ((left == 2) & (right == 1))


def _traced(pieces: DataFrame) -> DataFrame:
    """``runs``: edits of each piece from each of its ``starts``, given the costs ``behind`` it."""

    def run(batches):
        import pyarrow as pa

        held = tables()
        for batch in batches:
            runs = []
            for letters, behind, last, starts in zip(*[batch.column(c).to_pylist() for c in ("letters", "behind", "last", "starts")]):
                symbols, vector = symbols_of(letters), held.ids[normal(tuple(behind))[0]]
                traced = [(s, held.trace(symbols, vector, s, last)) for s in starts]
                runs.append([{"start": s, "edits": e, "cost": c, "state": q} for s, (e, c, q) in traced])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("edits", pa.string()), ("cost", pa.int64()), ("state", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), batch.column("first"), pa.array(runs, type=kind)], ["conv_id", "piece", "first", "runs"])

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return pieces.select("conv_id", "piece", "first", "letters", "behind", "last", "starts").mapInArrow(
        run, f"conv_id {kind}, piece bigint, first bigint, runs array<struct<start:bigint,edits:string,cost:bigint,state:bigint>>"
    )


def _actions(traced: DataFrame) -> DataFrame:
    """``pos``, lines inserted before (``pre``) and behind (``post``), the ``new`` role, and whether the row is ``gone``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for first, letters in zip(batch.column("first").to_pylist(), batch.column("edits").to_pylist()):
                pre, rows = [], []
                for letter in letters:
                    role = "user" if letter.isupper() else "assistant"
                    if letter in "Ii":
                        pre.append(f"\n{role}:")
                        continue
                    rows.append([first + len(rows), "".join(pre), "", role if letter in "Rr" else None, letter == "D"])
                    pre = []
                rows[-1][2] = "".join(pre)
                out += rows
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], ["pos", "pre", "post", "new", "gone"])

    return traced.select("first", "edits").mapInArrow(run, "pos bigint, pre string, post string, new string, gone boolean")


def hashes(lines: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``line`` values in order of ``pos``, less the first character; streams, so of any length."""
    kind = lines.schema["conv_id"].dataType

    def run(batches):
        import pyarrow as pa

        key = digest = None
        for batch in batches:
            done = []
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if digest is None or conv != key:
                    if digest is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest, line = conv, hashlib.sha256(), line[1:]
                digest.update(line.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=batch.schema.field("conv_id").type), pa.array([d[1] for d in done])], ["conv_id", "sha"])
            last = batch.schema.field("conv_id").type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], type=last), pa.array([digest.hexdigest()])], ["conv_id", "sha"])

    return lines.select("conv_id", "pos", "line").repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, f"conv_id {kind.simpleString()}, sha string")


def repair(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One line per conversation: gaps, counts of faults, illegal neighbours, cost, audit and the repaired text's hash.

    ``conversations``: conv_id, turn, role, text and the tie-breaks that ``damaged`` adds (``plain`` adds them without damage).
    """
    scratch = Scratch(conversations.sparkSession)
    rows = ordered(scratch, conversations)
    marks = scratch.table(marked(rows))
    counts = marks.groupBy("conv_id").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    turns = marks.where("turn IS NOT NULL").groupBy("conv_id", "turn").count().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))

    held = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    pieces = marks.groupBy("conv_id", F.expr(f"pos div {piece}").alias("piece")).agg(held.alias("held"))
    pieces = pieces.select("conv_id", "piece", F.col("held")[0]["pos"].alias("first"), F.array_join(F.col("held.letter"), "").alias("letters"))
    extent = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("piece").alias("final"))
    pieces = scratch.table(_with(pieces, extent).withColumn("last", F.col("piece") == F.col("final")).drop("final"))
    few = pieces.where("n = 1").withColumns({"behind": F.array(*[F.lit(c).cast("long") for c in END]), "starts": F.array(F.lit(0).cast("long"))})
    traced = _traced(few).select("conv_id", "piece", "first", F.col("runs")[0].alias("run"))
    illegal = pieces.select("conv_id", _illegal_inside("letters").alias("illegal"))
    many = pieces.where("n > 1")
    if not many.isEmpty():
        weigh = F.udf(matrix, "array<bigint>")
        behind = scan(scratch, many.select("conv_id", "piece", weigh("letters").alias("m")), "m", matrix_compose, matrix_apply, list(END), backward=True)
        many = _with(many, behind.withColumnRenamed("met", "behind"), "piece").withColumn("starts", F.array(*[F.lit(q).cast("long") for q in range(4)]))
        parts = scratch.table(_traced(many))
        chain = parts.select("conv_id", "piece", F.col("runs.state").alias("to"))
        state = scan(scratch, chain, "to", lambda f, g: [g[q] for q in f], lambda f, q: [f[q[0]]], [0], backward=False)
        parts = _with(parts, state, "piece").select("conv_id", "piece", "first", F.element_at("runs", F.col("met")[0].cast("int") + 1).alias("run"))
        traced = traced.unionByName(parts)
        ends = many.select("conv_id", "piece", F.substring("letters", 1, 1).alias("head"), F.substring("letters", -1, 1).alias("tail"))
        heads = ends.select("conv_id", (F.col("piece") - 1).alias("piece"), "head")
        number = lambda c: F.floor((F.ascii(c) - 65) / 3)
        met = ends.drop("head").alias("x").join(heads.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.piece") == F.col("y.piece")))
        illegal = illegal.unionByName(met.where(~_legal(number("x.tail"), number("y.head"))).select(F.col("x.conv_id").alias("conv_id"), F.lit(1).cast("long").alias("illegal")))
    traced = scratch.table(traced.select("conv_id", "piece", "first", F.col("run.edits").alias("edits"), F.col("run.cost").alias("cost")))

    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "edits"))), lambda x: x.edits), "")
    repairs = traced.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.upper(joined).alias("audit"))
    wrong = illegal.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    own = F.when(F.col("gone"), "").otherwise(F.concat(F.lit("\n"), F.coalesce("new", "role"), F.lit(":"), F.col("text")))
    lines = rows.join(_actions(traced), "pos").select("conv_id", "pos", F.concat("pre", own, "post").alias("line")).where("line <> ''")
    found = counts
    for other in (turns, repairs, wrong, hashes(lines)):
        found = _with(found, other)
    return found.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        "audit", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _with(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """``left`` with the columns of ``right`` for the same conversation (null is one) and ``on``."""
    keys = ["conv_id", *on]
    right = right.select(*[F.col(c).alias(f"{c}_there" if c in keys else c) for c in right.columns])
    met = [F.col(c).eqNullSafe(F.col(f"{c}_there")) for c in keys]
    return left.join(right, met, "left").drop(*[f"{c}_there" for c in keys])


def audit(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """``repair`` of the damaged rows, and a line of zeros for each conversation that the damage left without rows."""
    found = repair(damaged(conversations), piece)
    every = conversations.groupBy("conv_id").agg(F.lit(1).alias("there")).select(F.col("conv_id").alias("original"))
    whole = every.join(found, F.col("original").eqNullSafe(F.col("conv_id")), "left")
    return whole.select(
        F.col("original").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
