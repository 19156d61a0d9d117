"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is any value assigned to a naming word (``password=``, ``token:``,
also in German, Spanish and French), or between user and host in an address,
whatever its length and characters: up to the closing quote, or else to white
space or the next such assignment.  Elsewhere it is a run of letters, digits
and ``_ - + / .``, 16 characters or longer, or 8 if a naming word stands
shortly before; letters alone are one there only if all are capitals, as in
some issued keys.  A candidate within a secret is not reported on its own.
The forest sees its length, its character transitions (how usual they are in
the corpus, and how often the kind of character changes), how much of it words
of the corpus cover, how much it looks like a path, host or number, and its
neighbours: the signs beside it and the words before it, each by how much more
often findings labelled secret have it there than others.

Words and transitions are counted over all documents: tasks pass on counts of
every word, which are summed, and what makes up ``USUAL`` of the whole is the
dictionary, so its size has a bound.

The forest is trained from labelled findings.  Those of the corpus come from
about ``SAMPLE`` documents, chosen by a digest of id and text, and are labelled
by the known formats of issuers, and by entropy beside a naming word.  Format,
entropy and the naming pattern are no features, though the odds of words before
a value see the same context.  To each secret among them come twins
with the same neighbours whose values are made of dictionary words, labelled
as none, and one of random letters, labelled as secret.  Assigned values
without a digit tell by themselves neither, so those of the corpus have no
label.  A few generated findings of each kind, whose labels are known because
they were drawn so, see to it that both labels occur in any corpus.

Defined results: null and empty texts have no findings; repeated rows have the
same findings each; texts are read whole; ids, null or not, and other columns
pass through; an empty table gives no rows, and a model fitted on one knows
the generated findings only.  Where a candidate ends does not depend on ties:
of two with one start the longer counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, add_columns, drawn
from tidemark.llm.forest import Forest, Tree

SAMPLE, FINDINGS, USUAL, THRESHOLD = 20_000, 6_000, 1e-5, 0.5
#: Dictionary words that twins and generated findings are made of; findings that a neighbouring word needs to count.
TWIN_WORDS, SUPPORT = 2_000, 5
RUN = re.compile(r"[A-Za-z0-9_\-+/.]{8,}={0,2}")
#: Words that name a secret, in English, German, Spanish and French.
NAMES = (
    r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key"
    r"|passwort|kennwort|zugangs(?:code|schl(?:ü|ue)ssel)|contrase(?:ñ|n)a|clave[_ -](?:secreta|privada|api|de[_ -]acceso)|mot[_ -]?de[_ -]?passe|cl(?:é|e)[_ -](?:api|secr(?:è|e)te|priv(?:é|e)e|d'acc(?:è|e)s)"
)
NAMING = re.compile(rf"(?i)({NAMES})[\"']?\s*(?:=|:|=>|is|ist|es|est)?\s*[\"']?$")
ASSIGNED = re.compile(rf"(?i)(?:{NAMES})[\"']?(?:\s*(?:={{1,3}}>?|:{{1,2}}=?)\s*|\s+(?:is|ist|es|est)\s+)([\"']?)")
#: The same for texts in lower case, in which the search is some eight times as fast.
LOWER = re.compile(ASSIGNED.pattern.replace("(?i)", "", 1))
#: What stands between user and host in an address, and how a text before it ends.
CREDENTIAL, AUTHORITY = re.compile(r"://[^\s/@:]{0,64}:([^\s/@]{1,256})@"), re.compile(r"://[^\s/@:]*:$")
SPACE, LINE_END = re.compile(r"\s"), re.compile(r"[\r\n]")
#: What may close a sentence or bracket around a value without quotes, with what opens it.
ENDS = {")": "(", "]": "[", "}": "{", ">": "<", '"': '"', "'": "'"}
WORDS, SPOKEN = re.compile(r"[A-Za-z]+"), re.compile(r"[^\W\d_]+")
ALPHABET = 39  # letters, digits, anything else; 38 opens and closes a word

# Formats of issued keys, and shapes that are none.
ISSUED = [
    r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"gh[pousr]_[A-Za-z0-9]{36,}", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"sk_(?:live|test)_[A-Za-z0-9]{16,}", r"AIza[A-Za-z0-9_-]{35}",
    r"glpat-[A-Za-z0-9_-]{20}", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", r"npm_[A-Za-z0-9]{36}",
]
PLAIN = [
    r"\d{1,3}(?:\.\d{1,3}){3}", r"[\d\-+./]+", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", r"(?:[a-z0-9-]+\.)+[a-z]{2,6}(?:/.*)?", r".*/.*\.[a-z]{2,4}", r"[a-z]+://\S+", r"[^@\s]+@(?:[a-z0-9-]+\.)+[a-z]{2,6}", r"v?\d+(?:\.\d+)+\S*",
]
_ISSUED, _PLAIN = (re.compile("(?:" + "|".join(xs) + r")\Z") for xs in (ISSUED, PLAIN))


def assigned(text: str) -> list[tuple[int, int]]:
    """Where values assigned to naming words stand in a text, and what addresses have between user and host, whatever their characters."""
    low = text.lower()  # never shorter; of equal length, places are the same
    names = list(LOWER.finditer(low) if len(low) == len(text) else ASSIGNED.finditer(text))
    out = [m.span(1) for m in CREDENTIAL.finditer(text)]
    for m, following in zip(names, [*[m.start() for m in names[1:]], len(text)]):
        start, quote = m.end(), m.group(1)
        stop = SPACE.search(text, start, following)
        end = stop.start() if stop else following
        if quote:
            line = LINE_END.search(text, start, following)
            closing = text.find(quote, start, line.start() if line else following)
            end = closing if closing >= 0 else end
        else:
            while end > start and (text[end - 1] in ".,;:" or text[end - 1] in ENDS and ENDS[text[end - 1]] not in text[start : end - 1]):
                end -= 1
        if end > start:
            out.append((start, end))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Where candidates stand in a text; of two with the same start the longer is first."""
    out = set(assigned(text))
    for m in RUN.finditer(text):
        run = m.group().rstrip(".-/")
        if len(run) < 8 or run.isalpha() and not (len(run) >= 16 and run.isupper()):
            continue
        start = m.start()
        if len(run) >= 16 or NAMING.search(text, max(0, start - 32), start):
            out.add((start, start + len(run)))
    return sorted(out, key=lambda s: (s[0], -s[1]))


def entropy(value: str) -> float:
    counts = Counter(value).values()
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts) if value else 0.0


def looks_secret(value: str, before: str, after: str = "") -> bool | None:
    """The label of a finding: an issuer's format, or an assignment of something that is no plain value; None if that does not tell."""
    if _ISSUED.match(value):
        return True
    if AUTHORITY.search(before) and after.startswith("@"):
        return True if any(c.isdigit() for c in value) else None
    if _PLAIN.match(value) or before.endswith("@") or after.startswith("@"):
        return False
    if not NAMING.search(before) or entropy(value) < 2.8:
        return False
    return True if any(c.isdigit() for c in value) else None


def _place(c: str) -> int:
    c = c.lower()
    return ord(c) - 97 if "a" <= c <= "z" else 26 + int(c) if c in "0123456789" else 36


def neighbours(before: str) -> list[str]:
    """The last words before a value, in lower case."""
    return [w.lower() for w in SPOKEN.findall(before)[-3:]]


def word_odds(rows: list[tuple[str, str, str, int]]) -> dict[str, float]:
    """Word before findings -> logarithm of how much more often it stands before secrets than before others."""
    seen = {label: Counter(w for r in rows if r[3] == label for w in set(neighbours(r[1]))) for label in (0, 1)}
    total = {label: sum(r[3] == label for r in rows) for label in (0, 1)}
    words = {w for c in seen.values() for w, n in c.items() if seen[0][w] + seen[1][w] >= SUPPORT}
    return {w: math.log((seen[1][w] + 1) / (total[1] + 2)) - math.log((seen[0][w] + 1) / (total[0] + 2)) for w in sorted(words)}


@dataclass
class Corpus:
    """Dictionary words, the log-probability of one character after another in all words, and odds of words before findings."""

    words: set[str] = field(default_factory=set)
    logs: np.ndarray = field(default_factory=lambda: np.full((ALPHABET, ALPHABET), -math.log(ALPHABET)))
    odds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.longest = max(map(len, self.words), default=0)

    def covered(self, value: str) -> float:
        """Share of the characters that the longest dictionary words from the left on cover."""
        low, at, n = value.lower(), 0, 0
        while at < len(low):
            for size in range(min(self.longest, len(low) - at, 24), 2, -1):
                if low[at : at + size] in self.words:
                    n += size
                    at += size
                    break
            else:
                at += 1
        return n / max(1, len(low))

    def features(self, value: str, before: str, after: str) -> list[float]:
        kinds = ["U" if c.isupper() else "l" if c.isalpha() else "d" if c.isdigit() else "-" for c in value]
        row, n = [38, *map(_place, value), 38], len(value)
        odds = [self.odds.get(w, 0.0) for w in neighbours(before)]
        return [
            float(n),
            float(np.mean([self.logs[a, b] for a, b in zip(row, row[1:])])),
            sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
            kinds.count("U") / n, kinds.count("d") / n, kinds.count("-") / n,
            len(set(value)) / n,
            self.covered(value),
            float(value.count("/") + value.count(".")), float(all(c in "0123456789abcdef" for c in value)),
            max(odds, default=0.0), sum(odds), odds[-1] if odds else 0.0,
            float(before[-1:] in "\"'" and before != ""), float(before.rstrip("\"' ")[-1:] in ("=", ":")),
            float(before[-1:] == "@" or after[:1] == "@"), float(after[:1] == "@" and AUTHORITY.search(before) is not None),
        ]


def _beside(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[start:end], text[max(0, start - 32) : start], text[end : end + 8]


def _unassigned(text: str) -> str:
    """A text without the values assigned in it: in a small corpus they would be words themselves."""
    parts, at = [], 0
    for start, end in assigned(text):
        parts.append(text[at:start])
        at = max(at, end)
    return " ".join([*parts, text[at:]])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): every word outside assigned values, in lower case, over all documents."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            seen = Counter(w for t in batch.column(0).to_pylist() if t for w in WORDS.findall(_unassigned(t).lower()))
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return docs.select(F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def corpus_of(docs: DataFrame, text: str = "text") -> Corpus:
    """The dictionary and the transitions of all documents' words, each document read once."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.table(word_counts(docs, text))

    def step(batches):
        import pyarrow as pa

        for batch in batches:
            table = np.zeros((ALPHABET, ALPHABET), dtype=np.int64)
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = [38, *map(_place, word), 38]
                for a, b in zip(row, row[1:]):
                    table[a, b] += n
            a, b = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(table[a, b])], names=["a", "b", "n"])

    table = np.full((ALPHABET, ALPHABET), 0.5)
    for r in counts.mapInArrow(step, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # ALPHABET squared
        table[r.a, r.b] += r.n
    whole = counts.agg(F.sum("n")).first()[0] or 0
    usual = counts.where((F.col("n") >= USUAL * whole) & (F.length("word") >= 3)).select("word").collect()  # 1 / USUAL words at most
    scratch.drop(counts)
    return Corpus({r.word for r in usual}, np.log(table / table.sum(axis=1, keepdims=True)))


def drawn_words(words: set[str]) -> list[str]:
    """``TWIN_WORDS`` of the dictionary, by a digest of the word."""
    return sorted(words, key=lambda w: (zlib.crc32(w.encode()), w))[:TWIN_WORDS] or ["the", "and", "example", "value", "local"]


#: Naming words of the other languages, as generated findings have them.
FOREIGN = ["pwd", "Passwort", "Kennwort", "Zugangscode", "contraseña", "clave secreta", "clave de acceso", "mot de passe", "clé API", "clé secrète"]
LETTERS = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def generated(words: list[str], rng: np.random.Generator, each: int = 60) -> list[tuple[str, str, str, int]]:
    """Findings (value, before, after, label) of both kinds, for corpora that have few."""
    upper, lower, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    spoken = lambda: f"{rng.choice(words)} {rng.choice(words)} "
    out = []
    for _ in range(each):
        name = str(rng.choice(["password", "token", "secret", "api_key", "access_key", "auth", "passwd", "credential", "private_key", *FOREIGN]))
        joint = str(rng.choice(["=", ": ", ' = "', '="']))
        out.append(("AKIA" + draw(upper, 16), spoken(), " ", 1))
        out.append((draw(hexa, int(rng.choice([16, 18, 20, 32, 40, 64]))), spoken() + name + joint, '" ' if '"' in joint else " ", 1))
        out.append((draw(upper + lower, int(rng.integers(12, 44))), spoken() + name + joint, " ", 1))
        out.append((draw("0123456789", 16), spoken(), " ", 0))
        out.append((".".join(str(rng.integers(1, 255)) for _ in range(4)), spoken(), " ", 0))
        out.append((f"mail{rng.integers(1, 99)}.{rng.choice(words)}.com", f"{rng.choice(words)}@", " ", 0))
        out.append((draw(hexa, 40), spoken(), " ", 0))
        out.append(("-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), spoken(), " ", 0))
        out.append((f"{rng.choice(words)}/{rng.choice(words)}/{rng.choice(words)}{rng.integers(0, 99)}.html", spoken(), " ", 0))
        out.append((f"{rng.choice(words)}{rng.choice(words)}{rng.choice(words)}{rng.integers(1, 9)}", spoken() + name + joint, " ", 0))
        # Addresses with a password, and with a plain word in its place.
        address = f"{spoken()}{rng.choice(['https', 'ftp', 'postgres', 'amqp'])}://{rng.choice(words)[:12]}:"
        host = f"@{rng.choice(words)}"[:8]
        out.append((draw(upper + lower, int(rng.integers(8, 24))), address[-32:], host, 1))
        out.append((f"{rng.choice(words)}{rng.integers(0, 999)}", address[-32:], host, 1))
        out.append((str(rng.choice(words)), address[-32:], host, 0))
        # Assigned values without digits, with symbols, and words alone.
        ahead = spoken() + name + joint
        out.append((draw(LETTERS, int(rng.integers(8, 33))), ahead, " ", 1))
        out.append((draw(LETTERS[:26], int(rng.integers(10, 33))), ahead, " ", 1))
        out.append((draw([*LETTERS, *"0123456789@#!$%^&*?~"], int(rng.integers(8, 25))), ahead, " ", 1))
        out.append((draw([*LETTERS, *"@#!$%^&*?~"], int(rng.integers(8, 25))), ahead, " ", 1))
        for size in (1, 2, 3):
            spelled = "".join(rng.choice(words, size))
            out.append((spelled.capitalize() if rng.random() < 0.3 else spelled, ahead, " ", 0))
        out.append((draw("0123456789", int(rng.integers(1, 7))), ahead, " ", 0))
    return out


def labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, str, str, int]]:
    """Labelled findings of about ``SAMPLE`` documents."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    chosen = docs.where(drawn(F.xxhash64(F.col(doc_id), F.col(text), F.lit(41)), share)).select(text)

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            parts = (_beside(t, a, b) for t in batch.column(0).to_pylist() if t for a, b in candidates(t))
            rows = [(*p, int(label)) for p in parts if (label := looks_secret(*p)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], names=["value", "before", "after", "label"])

    found = chosen.mapInArrow(find, "value string, before string, after string, label int").distinct()
    found = found.orderBy(F.xxhash64("value", "before")).limit(FINDINGS)
    return [tuple(r) for r in found.collect()]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", findings: list[tuple[str, str, str, int]] | None = None) -> tuple[Corpus, Forest]:
    """The model of ``docs``; ``findings``: (value, before, after, label), those of the corpus if not given."""
    corpus, rng = corpus_of(docs, text), np.random.default_rng(3)
    rows, words = list(labelled(docs, doc_id, text) if findings is None else findings), drawn_words(corpus.words)
    twins = []
    for _, before, after, label in rows:
        if label and NAMING.search(before):
            twins.append(("".join(rng.choice(words, 3)) + str(rng.integers(1, 99)), before, after, 0))
            twins.append(("".join(rng.choice(words, int(rng.integers(1, 4)))), before, after, 0))
            twins.append(("".join(rng.choice(LETTERS, int(rng.integers(8, 33)))), before, after, 1))
    rows += generated(words, rng)
    corpus.odds = word_odds(rows)  # without the twins: their neighbours say nothing
    rows += twins
    x = np.array([corpus.features(*r[:3]) for r in rows])
    return corpus, Forest(x, np.array([r[3] for r in rows], dtype=float))


def scan(df: DataFrame, model: tuple[Corpus, Forest], text: str = "text", keep: list[str] | None = None, redact: str | None = None) -> DataFrame:
    """``df`` (its columns ``keep``) with ``findings``: start, end, score, secret.  ``redact`` stands for every secret in ``text`` if given."""
    corpus, forest = model
    trees = [t.__dict__ for t in forest.trees]
    shared = df.sparkSession.sparkContext.broadcast((corpus.words, corpus.logs, corpus.odds, trees))  # 1 / USUAL words and a fixed number of trees

    def make():
        *known, trees = shared.value
        corpus, own = Corpus(*known), Forest.__new__(Forest)
        own.trees = []
        for held in trees:
            tree = Tree.__new__(Tree)
            tree.__dict__.update(held)
            own.trees.append(tree)

        def work(texts):
            texts = texts.to_pylist()
            spans = [candidates(t) if t else [] for t in texts]
            rows = [corpus.features(*_beside(t, a, b)) for t, found in zip(texts, spans) for a, b in found]
            scores = iter(own.predict(np.array(rows)).tolist() if rows else [])
            out = [_outermost([{"start": a, "end": b, "score": (p := next(scores)), "secret": p >= THRESHOLD} for a, b in found]) for found in spans]
            if redact is None:
                return (out,)
            return out, [_redacted(t, found, redact) for t, found in zip(texts, out)]

        return work

    added = "findings array<struct<start:int,end:int,score:double,secret:boolean>>"
    return add_columns(df, text, added if redact is None else f"{added}, `{text}` string", make, keep)


def _outermost(found: list[dict]) -> list[dict]:
    """Findings without those that lie within a secret one; they come by start, the longer first."""
    out, end = [], 0
    for f in found:
        if f["end"] > end:
            out.append(f)
            end = f["end"] if f["secret"] else end
    return out


def _redacted(text: str | None, found: list[dict], mark: str) -> str | None:
    if not any(f["secret"] for f in found):
        return text
    parts, at = [], 0
    for f in found:
        if f["secret"]:
            parts += [text[at : f["start"]], mark] if f["start"] >= at else []
            at = f["end"]
    return "".join(parts) + text[at:]
