"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as one of ten classes (insult with a weight, threat, veiled
threat, announcement, heightener, target, negation, reporting verb, copula,
other).  Five small transducers read the classes of a clause, one each for

* insults: an insult, told apart if a heightener stands in the two words
  before it ("such an idiot", "piece of trash") or a target and a copula, with
  up to two words between ("you are a real idiot");
* threats: a threat, told apart if announced in the words before it ("will
  hurt", "going to kill"); a veiled threat ("regret", "suffer") only so;
* targets: whether a person is addressed anywhere in the clause;
* negation: the few words after a negation;
* reported speech: what follows a reporting verb up to the clause's end.

They are composed into one table of states, which runs over each clause that
holds an insult or a threat and lets insults and aimed threats through, with
what the others say of them.  What each kind of match is worth is learned
from labels, by logistic regression on the weights of a document's matched
clauses; so is the insult lexicon, which adds to a short fixed one the words
and word beginnings that occur almost only in documents labelled toxic.

Labels are used from a sample of about ``SAMPLE`` labelled rows, chosen by a
digest of the id; of near copies in it (same smallest word triples) one counts.

Defined results: a null or empty text has no clause and gets the base score;
rows without id are scored like others; repeated rows get the same score; an
empty table gives no rows; other columns pass through.  Of labels that differ
for one id the higher holds.  Texts are read whole.  With no label at all the fixed lexicon and the prior
weights hold.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, add_columns, drawn

#: Labelled rows that a fit reads, about.
SAMPLE = 12_000
#: A learned stem occurs in so many toxic documents at least, and in so few others.
SUPPORT, PRECISION = 4, 0.9
#: Lengths of word beginnings that may be learned, and words that a lexicon holds at most.
STEMS, MOST_WORDS = (4, 5, 6), 20_000
#: Words after a negation that it covers.
REACH = 3

# Fixed word lists of the grammar, in lower case; a word may be on several.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumb idiota estúpido imbécil basura idiotin dumm abschaum stupide crétin ordure".split()
THREATS = "kill hurt destroy beat crush murder matar töten tuer".split()
VEILED = "regret suffer pay bereuen büßen regretter payer pagar lamentar".split()
ANNOUNCEMENTS = "will going gonna shall i'll we'll they'll you'll werde werden vais allons voy vamos".split()
HEIGHTENERS = "such total complete absolute utter real fucking stupid piece bunch pile so solch total absolut stück tel quel vraie absolu pedazo tan".split()
COPULAS = "are is was were you're he's she's they're bist ist seid es eres est êtes son".split()
TARGETS = "you your you're you'll he she they him her them tu vous toi du dich dir ihr sie tú usted vosotros eres".split()
NEGATIONS = "not no never none isn't aren't don't doesn't nicht kein keine nie pas non jamais nunca".split()
REPORTS = "said says say wrote writes called quoted claims claimed reported sagte schrieb dit écrit dijo escribió".split()

# A word's class: a base class, with flags for what a word may be beside it.
OTHER, INSULT, THREAT, VEIL, REPORT, NEGATION = range(6)
TARGET, COPULA, HEIGHTENER, ANNOUNCEMENT = 8, 16, 32, 64
CLASSES = [base + flags for base in range(6) for flags in range(0, 128, 8)]
#: What a match may be beside an insult or a threat.
NEGATED, AIMED, REPORTED, TOLD = 1, 2, 4, 8
IS_INSULT, IS_THREAT = 16, 32
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]")
CLAUSE_ENDS = ".!?;:\n"
#: Words between a target's copula and an insult, and between a heightener and an insult, at most.
BETWEEN, APART = 2, 1


def _insult(state: tuple[int, int, int], word: int) -> tuple[tuple[int, int, int], int]:
    """State: whether the word before was a target; words that a copula after a target, and that a heightener, still reaches."""
    target, copula, heightener = state
    marks = 0
    if word & 7 == INSULT:
        marks = IS_INSULT | (TOLD if copula or heightener else 0)
    copula = BETWEEN + 1 if word & COPULA and (target or word & TARGET) else max(0, copula - 1)
    heightener = APART + 1 if word & HEIGHTENER else max(0, heightener - 1)
    return (int(bool(word & TARGET)), copula, heightener), marks


def _threat(state: int, word: int) -> tuple[int, int]:
    """State: words that an announcement still reaches."""
    marks = 0
    if word & 7 == THREAT or word & 7 == VEIL and state:
        marks = IS_THREAT | (TOLD if state else 0)
    return (REACH if word & ANNOUNCEMENT else max(0, state - 1)), marks


def _negation(state: int, word: int) -> tuple[int, int]:
    return (REACH, 0) if word & 7 == NEGATION else (max(0, state - 1), NEGATED if state else 0)


def _target(state: int, word: int) -> tuple[int, int]:
    state = 1 if word & TARGET else state
    return state, AIMED if state else 0


def _report(state: int, word: int) -> tuple[int, int]:
    return (1, 0) if word & 7 == REPORT else (state, REPORTED if state else 0)


def compose(parts, start: tuple) -> tuple[dict[tuple[int, int], tuple[int, int]], dict[tuple, int]]:
    """One transducer of several: (state, word) -> (state, marks), reachable states only; and the numbers of their states."""
    numbers, todo, table = {start: 0}, [start], {}
    while todo:
        states = todo.pop()
        for word in CLASSES:
            steps = [step(s, word) for step, s in zip(parts, states)]
            after, marks = tuple(s for s, _ in steps), sum(m for _, m in steps)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            table[numbers[states], word] = numbers[after], marks
    return table, numbers


START = ((0, 0, 0), 0, 0, 0, 0)
PARTS = (_insult, _threat, _negation, _target, _report)
GRAMMAR, _NUMBERS = compose(PARTS, START)
#: The same with a person addressed from the start: a target counts wherever in its clause it stands.
ADDRESSED = _NUMBERS[(0, 0, 0), 0, 0, 1, 0]
#: Kinds of matches that have a weight of their own: marks 0 to 15 for insults, then for threats.
KINDS = 32


class Lexicon(dict):
    """Token -> (class, weight); beginnings of words are looked up once for each word and remembered."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], most: int = 300_000):
        super().__init__()
        self.words, self.stems, self.most = words, stems, most
        self._fill()

    def _fill(self):
        self.clear()
        base = {w: (kind, 1.0) for kind, listed in ((VEIL, VEILED), (THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in listed}
        base |= {w: (INSULT, x) for w, x in self.words.items()}
        flags: dict[str, int] = {}
        for flag, listed in ((TARGET, TARGETS), (COPULA, COPULAS), (HEIGHTENER, HEIGHTENERS), (ANNOUNCEMENT, ANNOUNCEMENTS)):
            for w in set(listed):
                flags[w] = flags.get(w, 0) | flag
        for w in base.keys() | flags.keys():
            kind, weight = base.get(w, (OTHER, 0.0))
            self[w] = kind | flags.get(w, 0), weight

    def __missing__(self, token: str):
        if len(self) > self.most:
            self._fill()
        weight = max((self.stems[token[:k]] for k in STEMS if len(token) > k and token[:k] in self.stems), default=0.0)
        self[token] = found = (INSULT, weight) if weight else (OTHER, 0.0)
        return found


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 2.0))
    stems: dict[str, float] = field(default_factory=dict)
    #: Intercept, then a coefficient for each of ``features``.
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, *([0.8] * KINDS), 1.5]))


def matches(text: str, lexicon: Lexicon) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, weight) of every match in its clause; places are those of the lower case, which seldom differ."""
    low = text.lower()
    classes = [lexicon[t] for t in TOKEN.findall(low)]
    if not any(1 <= c & 7 <= VEIL for c, _ in classes):
        return []
    out, clause = [], []

    def run():
        if not any(1 <= c & 7 <= VEIL for c, *_ in clause):
            return
        # A target counts wherever in the clause it stands.
        state = ADDRESSED if any(c & TARGET for c, *_ in clause) else 0
        for c, weight, start, end in clause:
            state, marks = GRAMMAR[state, c]
            if marks & IS_INSULT:
                out.append((start, end, marks & 15, weight))
            elif marks & IS_THREAT and marks & AIMED:
                out.append((start, end, KINDS // 2 + (marks & 15), weight))

    for m, (c, weight) in zip(TOKEN.finditer(low), classes):
        if m.group() in CLAUSE_ENDS:
            run()
            clause.clear()
        else:
            clause.append((c, weight, m.start(), m.end()))
    run()
    return out


def features(found: list[tuple[int, int, int, float]]) -> np.ndarray:
    """Damped sums of match weights by kind, and of all."""
    sums = np.zeros(KINDS + 1)
    for _, _, kind, weight in found:
        sums[kind] += weight
        sums[KINDS] += weight
    return np.log1p(sums)


def score(x: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, penalty: float = 1.0, steps: int = 40) -> np.ndarray:
    """Newton's method; coefficients are drawn to ``prior``, the intercept freely."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = prior.copy(), np.diag([1e-3, *[penalty] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ (w - prior))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _twin_keys(tokens: list[str]) -> tuple[int, int]:
    """Two keys that near copies share almost always."""
    triples = [" ".join(tokens[k : k + 3]).encode() for k in range(max(1, len(tokens) - 2))]
    return min(map(zlib.crc32, triples)), min(zlib.crc32(x, 7) for x in triples)


def sample(docs: DataFrame, labels: DataFrame, target: str, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y): about ``most`` labelled rows, chosen by a digest of the id; 0/1 labels only."""
    named = labels.where(F.col(doc_id).isNotNull() & F.col(target).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.max(target).cast("int").alias("y"))
    share = min(1.0, most / max(1, named.count()))
    chosen = named.where(drawn(F.xxhash64("id", F.lit(17)), share))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "id").select("text", "y")  # bounded by ``most``


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The lexicon and weights that labelled rows of ``docs`` give; ``labels``: doc_id, toxic."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(sample(docs, labels, "toxic", most))

    def read(batches):
        """Keys that near copies share, the label, and the distinct words of each document."""
        import pandas as pd

        for batch in batches:
            tokens = [TOKEN.findall(t.lower()) for t in batch.text]
            keys = [_twin_keys(t) for t in tokens]
            yield pd.DataFrame({"a": [a for a, _ in keys], "b": [b for _, b in keys], "y": batch.y, "words": [sorted({w for w in t if w not in CLAUSE_ENDS}) for t in tokens]})

    read_rows = rows.mapInPandas(read, "a long, b long, y int, words array<string>")
    # One of each set of near copies; the groups are sets of words, pre-aggregated on the map side.
    once = read_rows.groupBy("a").agg(F.min_by(F.struct("b", "y", "words"), "b").alias("x")).select("x.*")
    once = once.groupBy("b").agg(F.min_by(F.struct("y", "words"), F.size("words")).alias("x")).select("x.*")
    stems = F.flatten(F.transform("words", lambda w: F.array(F.concat(F.lit("="), w), *[F.when(F.length(w) > k, F.substring(w, 1, k)) for k in STEMS])))
    counts = once.select("y", F.explode(F.array_distinct(stems)).alias("stem")).where("stem IS NOT NULL").groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic"))
    good = counts.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * F.col("n"))).orderBy(F.desc("toxic"), "stem").limit(MOST_WORDS).collect()
    model = Model()
    for r in good:
        weight = float(np.log((r.toxic + 0.5) / (r.n - r.toxic + 0.5)))
        (model.words if r.stem[0] == "=" else model.stems)[r.stem.lstrip("=")] = weight
    words, stems_found = model.words, model.stems

    def measure(batches):
        import pandas as pd

        lexicon = Lexicon(words, stems_found)
        for batch in batches:
            found = Counter((tuple(features(matches(t, lexicon))), int(y)) for t, y in zip(batch.text, batch.y))
            yield pd.DataFrame([(list(x), y, n) for (x, y), n in found.items()], columns=["x", "y", "n"])

    seen = rows.mapInPandas(measure, "x array<double>, y int, n long").collect()  # of a bounded sample
    scratch.drop(rows)
    if any(r.y for r in seen):
        x, y, n = np.array([r.x for r in seen]), np.array([r.y for r in seen], dtype=float), np.array([r.n for r in seen])
        x, y = np.repeat(x, n, axis=0), np.repeat(y, n)
        model.weights = logistic(x, y, Model().weights)
    return model


def assess(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``) with ``toxicity`` (0 to 1) and ``clauses``, the matches with their marks."""
    shared = df.sparkSession.sparkContext.broadcast((model.words, model.stems, model.weights))  # MOST_WORDS words at most

    def make():
        known = Model(*shared.value)
        lexicon = Lexicon(known.words, known.stems)

        def work(texts):
            found = [matches(t or "", lexicon) for t in texts.to_pylist()]
            scores = score(np.array([features(m) for m in found]).reshape(-1, KINDS + 1), known)
            names = ("start", "end", "kind", "weight")
            return scores, [[dict(zip(names, m)) for m in ms] for ms in found]

        return work

    return add_columns(df, text, "toxicity double, clauses array<struct<start:int,end:int,kind:int,weight:double>>", make, keep)


def fold(doc_id: str, modulus: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % modulus
