"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised and runs no regular expression.  A table maps
each code point to its class (letter, number, white space, other).  Class and
a look at the next characters make one of nine symbols; each symbol is a
function on the eight states of the transducer that splits text as
``PATTERN`` does.  Such functions compose associatively: the characters of a
slice are laid out as thousands of segments, the functions of all segments
are composed side by side, the composed functions carry the state from
segment to segment, and a last pass gives the state before each character and
so every boundary.  The slices between boundaries go through pair merging by
rank, with a bounded cache.  Byte offsets of the tokens are kept; decoding
puts the bytes of each token there.

Defined results: a null text is the empty text, with no ids; empty ids decode
to no bytes; null ids decode to null.  Repeated rows are encoded each on its
own; an empty table gives no rows; other columns pass through, but for those
with the names of new ones.  A text is encoded whole, with some 60 bytes of
memory a character.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import add_columns, free_name

#: The pattern that the transducer stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode's White_Space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers that Unicode 16 added; older tables of the standard library lack them.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Pieces that a task remembers; beyond that it starts anew.
CACHE = 400_000
#: Tokens that are decoded at a time, but for a single longer text.
SLICE_TOKENS = 100_000

LETTER, NUMBER, OTHER, JOINING, LAST_SPACE, SPACE, SHORT, LONG, END = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_JOINING, IN_SPACES, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8
SEGMENT = 512


def class_table() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(k))[0], OTHER) for k in range(0x110000)], dtype=np.uint8)
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[SPACES] = SPACE
    return table


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """For each symbol and state: the next state, and whether a piece begins here."""
    after = np.zeros((9, STATES), dtype=np.uint8)
    begins = np.ones((9, STATES), dtype=bool)
    for symbol, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        after[symbol] = inside
        begins[symbol, [inside, AFTER_JOINING]] = False
    after[LETTER, ONE_LEFT], after[LETTER, TWO_LEFT] = FRESH, ONE_LEFT
    begins[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    after[JOINING], after[LAST_SPACE], after[END] = AFTER_JOINING, FRESH, FRESH
    after[SPACE] = IN_SPACES
    begins[SPACE, IN_SPACES] = False
    for symbol, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):  # an apostrophe with its ending, unless a run of others holds it
        after[symbol] = left
        after[symbol, [IN_OTHERS, AFTER_JOINING]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, AFTER_JOINING]] = False
    return after, begins


AFTER, BEGINS = transitions()


def symbols(points: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``ends``: positions that end a text."""
    kind = table[points]
    kind[ends] = END
    following = np.concatenate([kind[1:], [END]])
    out = kind.copy()
    before_text = (kind == SPACE) & (following <= OTHER)
    out[before_text] = np.where(points[before_text] == 0x20, JOINING, LAST_SPACE)
    at = np.flatnonzero((points == ord("'")) & (following == LETTER))
    if len(at):
        padded = np.concatenate([points, [0, 0]])
        one, two = padded[at + 1], padded[at + 2]
        is_end = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        out[at[is_end(one, "stmd")]] = SHORT
        out[at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = LONG
    return out


def boundaries(symbol: np.ndarray) -> np.ndarray:
    """Where pieces begin, by a scan over the composed transition functions."""
    n = len(symbol)
    width = max(1, min(SEGMENT, n))
    count = -(-n // width)
    laid = np.full(count * width, END, dtype=np.uint8)
    laid[:n] = symbol
    base = np.ascontiguousarray(laid.reshape(count, width).T).astype(np.intp) * STATES
    after = AFTER.ravel().astype(np.intp)
    whole = np.tile(np.arange(STATES, dtype=np.intp), (count, 1))
    for row in base:  # every segment's function, composed one character further
        whole = after.take(row[:, None] + whole)
    start, state = np.empty(count, dtype=np.intp), FRESH
    for k, function in enumerate(whole.tolist()):
        start[k] = state
        state = function[state]
    begins, flat = np.empty((width, count), dtype=bool), BEGINS.ravel()
    for j, row in enumerate(base):
        start += row
        begins[j] = flat.take(start)
        start = after.take(start)
    return np.flatnonzero(begins.T.reshape(-1)[:n])


class Coder:
    """Encodes and decodes with one table of ranks."""

    def __init__(self, rank_lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_lines.splitlines() if x)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.lengths = np.array([len(x) for x in self.pieces], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)
        self.table: np.ndarray | None = None
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Pairs of least rank first, leftmost first."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > 100:
            return self._merge_long(piece)
        none, n = 1 << 30, len(piece)
        cut = list(range(n + 1))  # where the parts begin
        pair = [ranks.get(piece[k : k + 2], none) for k in range(n - 1)]  # rank of each part with the next
        while pair:
            best = min(pair)
            if best == none:
                break
            at = pair.index(best)
            del cut[at + 1], pair[at]
            if at < len(pair):
                pair[at] = ranks.get(piece[cut[at] : cut[at + 2]], none)
            if at:
                pair[at - 1] = ranks.get(piece[cut[at - 1] : cut[at + 1]], none)
        return tuple([ranks[piece[a:b]] for a, b in zip(cut, cut[1:])])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list, for pieces where the search for the least would dominate."""
        ranks, n = self.ranks, len(piece)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            middle = stop[at]
            if middle < 0 or middle >= n or stop[middle] != end:
                continue  # one of the two parts has merged meanwhile
            stop[at], stop[middle] = end, -1
            if end < n:
                before[end] = at
                if (r := ranks.get(piece[at : stop[end]])) is not None:
                    heapq.heappush(heap, (r, at, stop[end]))
            if at > 0 and (r := ranks.get(piece[before[at] : end])) is not None:
                heapq.heappush(heap, (r, before[at], end))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : stop[at]]])
            at = stop[at]
        return tuple(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        if self.table is None:
            self.table = class_table()
        starts = boundaries(symbols(points, ends, self.table))
        # The position of every text's end begins a piece of its own, which belongs to no text.
        last = np.searchsorted(starts, ends)
        out, first, cache = [], 0, self.cache
        cuts = starts.tolist()
        for stop in last.tolist():
            pieces = [joined[a:b] for a, b in zip(cuts[first:stop], cuts[first + 1 : stop + 1])]
            got = list(map(cache.get, pieces))
            if None in got:
                if len(cache) > CACHE:
                    cache.clear()
                for k, ids in enumerate(got):
                    if ids is None:
                        ids = cache.get(pieces[k])
                        if ids is None:
                            ids = self.merge(pieces[k].encode())
                            if len(pieces[k]) <= 64:
                                cache[pieces[k]] = ids
                        got[k] = ids
            out.append(np.fromiter(chain.from_iterable(got), dtype=np.int32))
            first = stop + 1
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id's piece begins in its text."""
        ends = np.cumsum(self.lengths[ids])
        return ends - self.lengths[ids]

    def decode(self, ids: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text, those of each id at its offset; ``counts``: ids of each text."""
        sizes, last = self.lengths[ids], np.cumsum(counts) - 1
        width = np.zeros(len(counts), dtype=np.int64)
        held = counts > 0
        width[held] = (offsets + sizes)[last[held]]
        ends = np.cumsum(width)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = np.zeros(int(width.sum()), dtype=np.uint8)
        out[np.repeat(np.repeat(ends - width, counts) + offsets, sizes) + inside] = self.flat[np.repeat(self.starts[ids], sizes) + inside]
        whole = out.tobytes()
        return [whole[b - n : b] for b, n in zip(ends.tolist(), width.tolist())]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(arrays: list[np.ndarray], dtype):
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).astype(dtype) if arrays else np.array([], dtype=dtype)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def encode(df: DataFrame, rank_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``) with ``ids`` and ``offsets``, the byte where each id begins."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))  # a vocabulary: under 2 MB

    def make():
        coder = Coder(ranks.value)

        def work(texts):
            ids = coder.encode([x or "" for x in texts.to_pylist()])
            return _lists(ids, np.int32), _lists([coder.offsets(x) for x in ids], np.int32)

        return work

    return add_columns(df, text, "ids array<int>, offsets array<int>", make, keep)


def decode(df: DataFrame, rank_path: str, ids: str = "ids", offsets: str = "offsets", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``) with ``decoded``, the bytes that the ids stand for, each at its offset."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    names, zipped = df.columns if keep is None else keep, free_name(df, "__tokens")
    tokens = df.select(*[F.col(f"`{c}`") for c in names], F.arrays_zip(F.col(ids).alias("id"), F.col(offsets).alias("at")).alias(zipped))

    def make():
        coder = Coder(ranks.value)

        def work(lists):
            import pyarrow as pa
            import pyarrow.compute as pc

            flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            found, places = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("id", "at"))
            made = coder.decode(found, places, sizes.astype(np.int64))
            return (pa.array([x if fine else None for x, fine in zip(made, lists.is_valid().to_pylist())], pa.binary()),)

        return work

    return add_columns(tokens, zipped, "decoded binary", make, [c for c in names if c != "decoded"], SLICE_TOKENS)
