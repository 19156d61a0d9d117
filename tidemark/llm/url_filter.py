"""URL filters by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that any URL it fits
must hold.  Token counts over all URLs choose the rarest token of each rule;
the index maps that token to the rule.  A URL's own tokens fetch its candidate
rules through one equi-join, and only candidates run their expression.

Two kinds of rules go through the same index.  A *site rule* (``example.org/es/``)
fits its host and all subdomains where the path starts with the rule's; the
longest that fits gives the verdict.  A *pattern* fits anywhere in the URL and
decides where no site rule fits: any blocking pattern blocks, else the URL is
allowed.

Defined results: a null URL, and one without ``://``, has an empty host and
path; no site rule fits it.  Repeated rows are judged each on its own.  Other
columns are not read.  The rules are a parameter, at most ``MOST_RULES``, so
the broadcast index has a bound.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``rule`` is a site rule as ``host/path`` or, for a pattern, its regular expression."""

    rule: str
    verdict: str
    site: bool = True

    @property
    def pattern(self) -> str:
        if not self.site:
            return f"(?s){self.rule}"
        return r"(?s)\A(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", self.rule)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that stand whole in every URL that the rule fits."""
        if self.site:
            whole = self.rule if re.search(r"[^A-Za-z0-9]\Z", self.rule) else re.sub(r"[A-Za-z0-9]+\Z", "", self.rule)
            return re.findall("[a-z0-9]+", whole.lower())
        # Of a pattern, only what stands between two boundaries of words is a whole token.
        return [t for t in re.findall(r"\\b([a-z0-9]+)(?=\\b)", self.rule)]


#: Rules of the shared contract, in its order.
SITE_RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)
#: Patterns for what no site rule covers; alternatives are rules of their own, so that each has a literal.
PATTERNS = (
    Rule(r"\bcheap\b[-.]?\bpills\b", "block", site=False),
    Rule(r"\bcasino\b[-.]", "block", site=False),
    Rule(r"\bspam\b[-.]", "block", site=False),
    Rule(r"\bads\b[-.]\btrack(?:er)?\b", "block", site=False),
    Rule(r"\bxxx\b[-.]", "block", site=False),
    Rule(r"\badult\b[-.]", "block", site=False),
    Rule(r"[-.]\bbet\b", "block", site=False),
    Rule(r"[-.]\bbets\b", "block", site=False),
    Rule(r"\bpayday\b[-.]?\bloan\b", "block", site=False),
    Rule(r"\bpayday\b[-.]?\bloans\b", "block", site=False),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _tokens(url: Column) -> Column:
    """Distinct tokens of a URL, and the empty one: rules without a literal are filed under it, and rows without another token stay."""
    low = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))))


def index(urls: DataFrame, url: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(token, site, rule, pattern, verdict): each rule under its rarest token, as counted over all ``urls``."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; the index is broadcast and holds {MOST_RULES} at most")
    spark = urls.sparkSession
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = {}
    if wanted:
        literals = spark.createDataFrame([(t,) for t in wanted], "token string")
        held = urls.select(F.explode(_tokens(F.col(url))).alias("token")).join(F.broadcast(literals), "token")
        counts = {x.token: x.n for x in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), r.site, r.rule, r.pattern, r.verdict) for r in rules]
    return spark.createDataFrame(rows, "token string, site boolean, rule string, pattern string, verdict string")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = SITE_RULES + PATTERNS) -> DataFrame:
    """One line per row of ``pages``: page_id, host, path, rule, verdict, and the pattern that decided where no rule fits."""
    own = F.col(url)
    lines = pages.select(F.col(page_id).alias("page_id"), host_of(own).alias("host"), path_of(own).alias("path"), F.translate(F.coalesce(own, F.lit("")), UPPER, LOWER).alias("url"), _tokens(own).alias("tokens"))
    # A row id for rows that agree in page_id; all rows of one id are made in one task and meet again in the map-side part of the aggregate.
    lines = lines.withColumn("row", F.monotonically_increasing_id())
    rules_by_token = F.broadcast(index(pages, url, rules))
    near = lines.select("row", "page_id", "host", "path", "url", F.explode("tokens").alias("token")).join(rules_by_token, "token", "left")
    subject = F.when(F.col("site"), F.concat("host", "path")).otherwise(F.col("url"))
    fits = F.col("pattern").isNotNull() & F.regexp_like(subject, F.col("pattern"))
    site = F.when(fits & F.col("site"), F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict")))
    pattern = F.when(fits & ~F.col("site"), F.struct(F.col("verdict"), F.col("rule")))
    best = near.groupBy("row", "page_id", "host", "path").agg(F.max(site).alias("site"), F.max(pattern).alias("pattern"))
    return best.select(
        "page_id", "host", "path",
        F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", "pattern.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("site").isNull(), F.col("pattern.rule")).alias("pattern"),
    )
