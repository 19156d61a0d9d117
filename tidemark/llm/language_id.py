"""Language ID of words in code-switched text by a linear-chain conditional random field.

A word's features are its beginnings and endings of one to three letters, its
letter trigrams and the word itself (the lexicon), hashed to a fixed width.
Emission weights and transitions are learned together, by gradient steps on
the likelihood, from sequences spliced out of sampled documents of different
languages, so that switches occur in them.  Forward-backward gives each
word's distribution over languages; a text's language is the one with the
largest share of all its words, and runs of words with one label are kept.

Forward-backward runs over segments of fixed width side by side: the segments'
products of transition matrices, which compose associatively, carry the
messages from segment to segment, so a very long text costs no more a word
than short ones.

Training reads ``SAMPLE`` documents of each language, chosen by a digest of id
and text, ``LONGEST`` characters of each at most, and ``WORDS`` words in all.

Defined results: ``und`` with score 0 for null texts and texts without
letters, and wherever nothing could be learned; repeated rows get the same
answer, whatever their id, null or not; texts are read whole, and take memory
in proportion to their words; of languages that share the most the first by
name is given; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import add_columns

SAMPLE, LONGEST, WORDS = 400, 20_000, 400_000
#: Documents of all languages together, where there are so many that ``SAMPLE`` of each were more.
TOTAL = 40_000
WIDTH = 1 << 17
SEGMENT = 64
WORD = re.compile(r"[^\W\d_]+")
#: Words whose emissions a task remembers.
CACHE = 200_000


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode's category L, so neither fractions nor circled numbers), in lower case."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


class _Hashes(dict):
    """Hashed places of one kind of feature; letters in short strings repeat, so few are ever hashed."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def __missing__(self, part: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[part] = found = zlib.crc32((self.kind + part).encode()) % WIDTH
        return found


class Features:
    """Word -> places of its affixes, trigrams and itself."""

    def __init__(self):
        self.starts, self.ends, self.trigrams = _Hashes("p"), _Hashes("s"), _Hashes("t")

    def __call__(self, word: str) -> list[int]:
        p, s, t, held = self.starts, self.ends, self.trigrams, f"^{word}$"
        own = zlib.crc32(held.encode()) % WIDTH
        return [own, p[word[:1]], p[word[:2]], p[word[:3]], s[word[-1:]], s[word[-2:]], s[word[-3:]], *[t[held[k : k + 3]] for k in range(len(word))]]


@dataclass
class Field:
    languages: list[str]
    emission: np.ndarray  # (WIDTH, languages)
    transition: np.ndarray  # (from, to), log


def _messages(weights: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages and word marginals of (time, sequence, label) potentials."""
    t, n, k = weights.shape
    forward, backward = np.empty_like(weights), np.empty_like(weights)
    forward[0] = weights[0] / weights[0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = (forward[i - 1] @ step) * weights[i]
        forward[i] = x / x.sum(axis=1, keepdims=True)
    backward[-1] = 1
    for i in range(t - 2, -1, -1):
        x = (weights[i + 1] * backward[i + 1]) @ step.T
        backward[i] = x / x.sum(axis=1, keepdims=True)
    both = forward * backward
    return forward, backward, both / both.sum(axis=2, keepdims=True)


def learn(texts: list[tuple[str, str]], seed: int = 0, epochs: int = 6, rate: float = 0.3) -> Field:
    """The field that (language, text) pairs give."""
    rng = np.random.default_rng(seed)
    names = sorted({lang for lang, _ in texts})
    words = {lang: [] for lang in names}
    for lang, text in texts:
        words[lang].append(words_of(text))
    pieces = []
    share = WORDS // max(1, len(names))
    for at, lang in enumerate(names):
        cut = [doc[k : k + 16] for doc in words[lang] for k in range(0, len(doc), 16)]
        order = rng.permutation(len(cut))[: share // 16 + 1]
        pieces += [(at, cut[k]) for k in order]
    order, labels, stream = rng.permutation(len(pieces)), [], []
    for k in order:  # neighbours in this order are spliced: most sequences hold a switch
        at, piece = pieces[k]
        stream += piece
        labels += [at] * len(piece)
    k, wide = len(names), 64
    field = Field(names, np.zeros((WIDTH, k)), np.zeros((k, k)))
    count = len(stream) // wide
    if count == 0 and stream:
        wide, count = len(stream), 1
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in stream[: count * wide]], dtype=np.int64)
    gold = np.array(labels[: count * wide], dtype=np.int64).reshape(count, wide)
    ids = ids.reshape(count, wide)
    lists = list(map(Features(), known))
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    flat = np.array([f for x in lists for f in x], dtype=np.int64)
    seen_e, seen_t = np.full((WIDTH, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs if count else 0):
        shuffled = rng.permutation(count)
        for a in range(0, count, 128):
            rows = shuffled[a : a + 128]
            own, place = np.unique(ids[rows], return_inverse=True)
            place = place.reshape(len(rows), wide)
            spans = [flat[first[w] : first[w + 1]] for w in own]
            which, owner = np.concatenate(spans), np.repeat(np.arange(len(own)), [len(x) for x in spans])
            raw = np.zeros((len(own), k))
            np.add.at(raw, owner, field.emission[which])
            logs = raw[place].transpose(1, 0, 2)
            weights, step = np.exp(logs - logs.max(axis=2, keepdims=True)), np.exp(field.transition - field.transition.max())
            forward, backward, marginal = _messages(weights, step)
            truth = np.eye(k)[gold[rows].T]
            slope = np.zeros((len(own), k))
            np.add.at(slope, place.T, truth - marginal)
            pairs = forward[:-1, :, :, None] * step[None, None] * (weights[1:] * backward[1:])[:, :, None, :]
            pairs /= pairs.sum(axis=(2, 3), keepdims=True)
            turn = np.einsum("tni,tnj->ij", truth[:-1], truth[1:]) - pairs.sum(axis=(0, 1)) - 0.01 * field.transition
            down = np.zeros_like(field.emission[:1])  # per feature, only those of the batch
            touched, back = np.unique(which, return_inverse=True)
            down = np.zeros((len(touched), k))
            np.add.at(down, back, slope[owner])
            down -= 0.01 * field.emission[touched]
            seen_e[touched] += down**2
            field.emission[touched] += rate * down / np.sqrt(seen_e[touched])
            seen_t += turn**2
            field.transition += rate * turn / np.sqrt(seen_t)
    return field


class Labeller:
    """Runs a field over texts."""

    def __init__(self, field: Field):
        self.field = field
        self.features = Features()
        self.step = np.exp(field.transition - field.transition.max()) if field.languages else None
        self._reset()

    def _reset(self):
        self.rows: dict[str, int] = {}
        self.table = np.empty((1024, max(1, len(self.field.languages))))

    def _emissions(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE:
            self._reset()
        known = self.rows
        fresh = list(set(words).difference(known))
        if fresh:
            lists = list(map(self.features, fresh))
            sizes = np.array(list(map(len, lists)))
            logs = np.add.reduceat(self.field.emission[np.fromiter(chain.from_iterable(lists), np.int64, sizes.sum())], np.cumsum(sizes) - sizes)
            rows = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -20))
            first = len(known)
            while len(self.table) < first + len(fresh):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[first : first + len(fresh)] = rows
            known.update(zip(fresh, range(first, first + len(fresh))))
        return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def marginals(self, lengths: np.ndarray, words: list[str]) -> np.ndarray:
        """(word, label) distributions; ``words`` are those of all texts, one after the other."""
        k, step = len(self.field.languages), self.step
        own = self._emissions(words)
        segments = -(-lengths // SEGMENT)
        first = np.concatenate([[0], np.cumsum(segments)])
        total = int(first[-1])
        text = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        segment, at = first[text] + inside // SEGMENT, inside % SEGMENT
        laid = np.ones((SEGMENT, total, k))
        laid[at, segment] = own
        real = np.zeros((SEGMENT, total), dtype=bool)
        real[at, segment] = True
        # Products over each segment, without the transition into its first word.
        product = np.zeros((total, k, k))
        product[:] = np.eye(k)
        for i in range(SEGMENT):
            grown = ((product.reshape(-1, k) @ step).reshape(-1, k, k) if i else product) * laid[i][:, None, :]
            if i % 8 == 7:  # often enough against underflow
                grown /= grown.max(axis=(1, 2), keepdims=True)
            if real[i].all():
                product = grown
            else:
                product[real[i]] = grown[real[i]]
        # Messages into each segment from its text's other segments, all texts at once.
        before, behind = np.ones((total, k)), np.ones((total, k))
        number = np.arange(total) - np.repeat(first[:-1], segments)
        left = np.repeat(segments, segments) - 1 - number
        order, back = np.argsort(number, kind="stable"), np.argsort(left, kind="stable")
        for rows in np.split(order, np.cumsum(np.bincount(number)))[1:-1] if total else []:
            x = np.einsum("si,sij->sj", before[rows - 1], product[rows - 1]) @ step
            before[rows] = x / x.max(axis=1, keepdims=True)
        for rows in np.split(back, np.cumsum(np.bincount(left)))[1:-1] if total else []:
            x = np.einsum("sij,sj->si", product[rows + 1], behind[rows + 1]) @ step.T
            behind[rows] = x / x.max(axis=1, keepdims=True)
        ahead = np.empty_like(laid)
        x = before
        for i in range(SEGMENT):
            x = ((x @ step) if i else x) * laid[i]
            if i % 8 == 7:
                x = x / x.max(axis=1, keepdims=True)
            ahead[i] = x
        x = behind
        for i in range(SEGMENT - 1, -1, -1):
            ahead[i] *= x
            y = (laid[i] * x) @ step.T
            if i % 8 == 0:
                y /= y.max(axis=1, keepdims=True)
            x = y if real[i].all() else np.where(real[i][:, None], y, x)
        out = ahead[at, segment]
        return out / out.sum(axis=1, keepdims=True)

    def label(self, texts: list[str], runs: bool):
        """Language, its share of the text's words, and runs of equally labelled words."""
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        names, n = self.field.languages, len(texts)
        langs, shares, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
        if not names or not lengths.sum():
            return langs, shares, spans
        chances = self.marginals(lengths, [w for ws in words for w in ws])
        ends = np.cumsum(lengths)
        for k in np.flatnonzero(lengths).tolist():
            own = chances[ends[k] - lengths[k] : ends[k]]
            mass = own.mean(axis=0)
            best = int(mass.argmax())
            langs[k], shares[k] = names[best], float(min(1.0, mass[best]))
            if runs:
                labels = own.argmax(axis=1)
                cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
                spans[k] = [{"word": a, "words": b - a, "lang": names[labels[a]]} for a, b in zip(cuts, cuts[1:])]
        return langs, shares, spans


def bound(wanted: int, n: int) -> int:
    """A bound on 62-bit digests below which some four times ``wanted`` of ``n`` rows lie, and a few more, however many those are."""
    return min(1 << 62, (4 * wanted + 64) * (1 << 62) // n)


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE, total: int = TOTAL) -> DataFrame:
    """(lang, text): exactly ``most`` documents of each language, or all it has, as they come in the order of a digest of id and text.

    Repeated rows are one document.  With very many languages each has fewer, so that all have ``total``
    together (one at least).  Texts are cut at ``LONGEST`` characters.  Only
    rows below a 62-bit bound of the digest, some four times as many as are
    wanted, are ranked at all.
    """
    named = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.substring(F.coalesce(text, F.lit("")), 1, LONGEST).alias("text"), F.xxhash64(doc_id, text, F.lit(29)).alias("digest"))
    counts = {r[0]: r[1] for r in named.select("lang", "digest").distinct().groupBy("lang").count().collect()}
    own = max(1, min(most, total // max(1, len(counts))))
    bounds = docs.sparkSession.createDataFrame([(k, bound(own, n)) for k, n in counts.items()], f"lang {docs.schema[lang].dataType.simpleString()}, bound long")
    low = named.join(F.broadcast(bounds), "lang").where(F.pmod("digest", F.lit(1 << 62)) < F.col("bound")).dropDuplicates(["lang", "digest"])  # bounds: a row for each language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("digest", F.lit(1 << 62)), "text"))
    return low.withColumn("rank", rank).where(F.col("rank") <= own).select("lang", "text")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> Field:
    """A field from ``most`` documents of each language that ``docs`` name (``sample``)."""
    rows = sorted((r[0], r[1]) for r in sample(docs, doc_id, text, lang, most).collect())
    return learn(rows) if rows else Field([], np.zeros((WIDTH, 0)), np.zeros((0, 0)))


def identify(df: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None, runs: bool = True) -> DataFrame:
    """``df`` (its columns ``keep``) with ``lang_pred``, ``lang_score`` and ``lang_runs`` (word, words, lang)."""
    used = np.flatnonzero((field.emission != 0).any(axis=1))  # what training has not met weighs nothing
    shared = df.sparkSession.sparkContext.broadcast((field.languages, used, field.emission[used].astype(np.float32), field.transition))

    def make():
        names, rows, values, transition = shared.value
        emission = np.zeros((WIDTH, len(names)))
        emission[rows] = values
        labeller = Labeller(Field(names, emission, transition))

        def work(texts):
            return labeller.label([t or "" for t in texts.to_pylist()], runs)

        return work

    return add_columns(df, text, "lang_pred string, lang_score double, lang_runs array<struct<word:int,words:int,lang:string>>", make, keep)
