"""URL rules, looked up by literal tokens.

A pattern rule names literal tokens, in one set for each of its alternatives: any
URL that it fits holds all tokens of one set. That is checked on the regular
expression itself when a rule is made. The rule is filed under the rarest
token of every set, by their counts over the URLs to be judged. A URL's own
tokens fetch the rules filed under them and only these run their
regular expression. Host rules are filed under their host and fetched by the
suffixes of a URL's host.

Both indexes are hash tables held as one array literal of buckets, so a lookup
costs the same however many rules there are, no row is shuffled and nothing
runs in Python. A literal travels with every task: a list of more than
``MOST_RULES`` rules is a table instead, which the tokens and host suffixes of
the different URLs are joined with.
"""

from __future__ import annotations

import json
import re
import re._parser as parser
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits its host and all subdomains, where the path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Most ways through a regular expression that are looked at.
MOST_WAYS = 512
TOKEN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: In a way: a place where no letter or digit a-z, 0-9 is, and one where anything may be.
EDGE, ANY = "edge", "any"


def _class_is_edge(items) -> bool:
    """Whether a class of characters holds no letter and no digit a-z, 0-9."""
    negated = bool(items) and items[0][0] is parser.NEGATE
    named = set()
    for op, av in items[negated:]:
        if op not in (parser.LITERAL, parser.RANGE):
            return False
        low, high = (av, av) if op is parser.LITERAL else av
        named |= {c for c in TOKEN if low <= ord(c) <= high}
    return named == TOKEN if negated else not named


def _ways(tree) -> list[tuple]:
    """The ways through a parsed expression, each a row of characters, EDGE and ANY."""
    out: list[tuple] = [()]
    for op, av in tree:
        if op is parser.LITERAL:
            more = [(chr(av) if chr(av) in TOKEN else EDGE,)]
        elif op is parser.IN:
            one = lambda c: chr(c) if chr(c) in TOKEN else EDGE
            few = len(av) <= 4 and all(kind is parser.LITERAL for kind, _ in av)  # (a|b) is read as [ab]
            more = [(EDGE,)] if _class_is_edge(av) else [(one(c),) for _, c in av] if few else [(ANY,)]
        elif op is parser.AT:
            more = [(EDGE,)] if av in (parser.AT_BEGINNING, parser.AT_BEGINNING_STRING, parser.AT_END, parser.AT_END_STRING, parser.AT_BOUNDARY) else [()]
        elif op is parser.SUBPATTERN:
            if av[1] or av[2]:
                raise ValueError("flags in a rule's regular expression")
            more = _ways(av[3])
        elif op is parser.BRANCH:
            more = [w for branch in av[1] for w in _ways(branch)]
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            low, high, inner = av
            once = _ways(inner)
            more = ([()] if low == 0 else []) + (once if high == 1 else [(ANY,)] if low == 0 else [(*w, ANY) for w in once])
        else:
            more = [(ANY,)]
        out = [(*a, *b) for a in out for b in more]
        if len(out) > MOST_WAYS:
            raise ValueError("too many ways through a rule's regular expression")
    return out


def tokens_of_ways(regex: str) -> list[set[str]]:
    """For each way through a regular expression: the whole tokens that any URL has which fits it that way."""
    found = []
    if "&&" in regex or re.search(r"\[[^]]*\[", regex.replace(r"\[", "")):
        raise ValueError("sets of sets in a rule's regular expression")  # which the parser here reads otherwise
    try:
        tree = parser.parse(regex.replace(r"\z", r"\Z"))  # Python's name for the end
    except re.error as e:
        raise ValueError(f"{regex}: {e}") from e
    if tree.state.flags & ~re.UNICODE:
        raise ValueError("flags in a rule's regular expression")
    for way in _ways(tree):
        tokens, run, whole = set(), "", False
        for x in (*way, ANY):
            if x in (EDGE, ANY):
                if run and whole and x is EDGE:
                    tokens.add(run)
                run, whole = "", x is EDGE
            else:
                run += x
        found.append(tokens)
    return found


@dataclass(frozen=True)
class PatternRule:
    """regex is a Java regular expression over the lower-cased URL; any URL it
    fits must hold each of literals, or of one of others, as whole tokens
    (letters and digits). A rule of which the expression doesn't show that is
    an error, and so is one with flags, such as (?i): the URL is lower-case already."""

    verdict: str
    regex: str
    literals: tuple[str, ...]
    others: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self):
        for tokens in tokens_of_ways(self.regex):
            if not any(x and tokens.issuperset(x) for x in self.sets()):
                raise ValueError(f"{self.regex} may fit a URL without its literals")

    def sets(self) -> tuple[tuple[str, ...], ...]:
        return (self.literals, *self.others)


#: For the registered query.
HOST_RULES = (
    HostRule("block", "com", "/en/"),
    HostRule("allow", "example.com", "/en/7"),
    HostRule("allow", "net", "/de/"),
    HostRule("block", "example.net", "/de/8"),
    HostRule("block", "org", "/es/"),
)
PATTERN_RULES = tuple(
    PatternRule("block", rf"://([^/?#]*[^a-z0-9_/?#])?{a}-{b}([^a-z0-9_]|\z)", (a, b))
    for a, b in (("cheap", "pills"), ("free", "bets"), ("casino", "win"), ("adult", "x"), ("spam", "farm"), ("ads", "track"))
) + (
    PatternRule("block", r"[/?&=._-](porn|xxx)[/?&=._-]", ("porn",), (("xxx",),)),
    PatternRule("block", r"[?&]aff(iliate)?_id=\d+", ("id",)),
    PatternRule("allow", r"/(robots|sitemap)\.(txt|xml)\z", ("robots", "txt"), (("robots", "xml"), ("sitemap", "txt"), ("sitemap", "xml"))),
)


def lowered(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct runs of letters and digits of the lower-cased URL."""
    return F.array_distinct(F.split(F.coalesce(lowered(url), F.lit("")), "[^a-z0-9]+"))


class Index:
    """Entries under keys, as a literal array of hash buckets."""

    def __init__(self, entries: list[tuple[str, dict]], fields: str):
        self.size = max(1, 2 * len(entries))
        buckets: list[list] = [[] for _ in range(self.size)]
        for key, value in entries:
            buckets[zlib.crc32(key.encode()) % self.size].append({"key": key, **value})
        self.table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<key:string,{fields}>>>")

    def found(self, keys: Column) -> Column:
        """The entries under any of the keys."""
        bucket = lambda k: F.get(self.table, (F.crc32(k.cast("binary")) % self.size).cast("int"))
        return F.flatten(F.transform(keys, lambda k: F.filter(bucket(k), lambda e: e["key"] == k)))


def rarest(urls: DataFrame, url: str, rules) -> list[tuple[str, PatternRule]]:
    """(literal, rule) for each set of a rule's literals: the one that the fewest
    URLs hold. Only the rules' own literals are counted, so what comes to the
    driver is no longer than the rules."""
    literals = sorted({x for r in rules for s in r.sets() for x in s})
    if not literals:
        return []
    tokens = tokens_of(F.col(url))
    if len(literals) <= MOST_RULES:
        found = urls.select(F.explode(Index([(x, {}) for x in literals], "none:string").found(tokens)).alias("e")).select("e.key")
    else:
        known = urls.sparkSession.createDataFrame([(x,) for x in literals], "key string")
        found = urls.select(F.explode(tokens).alias("key")).join(known, "key")
    n = {r["key"]: r["count"] for r in found.groupBy("key").count().collect()}
    return list(dict.fromkeys((min(s, key=lambda x: (n.get(x, 0), x)), r) for r in rules for s in r.sets()))


def suffixes_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def by_tables(urls: DataFrame, url: str, hosts: list, patterns: list) -> DataFrame:
    """urls with structs __longest and __met, where lists are too long for literals.

    Each different URL is judged once, by joins of its tokens and host suffixes with the rules."""
    spark = urls.sparkSession
    once = urls.select(F.col(url).alias("__url")).filter("__url IS NOT NULL").distinct()
    rules = spark.createDataFrame([(k, r.verdict, r.regex) for k, r in patterns], "key string, verdict string, regex string")
    met = once.select("__url", F.explode(tokens_of(F.col("__url"))).alias("key")).join(rules, "key").filter(F.rlike(lowered(F.col("__url")), F.col("regex")))
    met = met.groupBy("__url").agg(F.collect_set(F.struct("verdict")).alias("__met"))  # two verdicts at most
    rules = spark.createDataFrame([(r.host, r.verdict, r.path, r.name, len(r.name)) for r in hosts], "key string, verdict string, path string, name string, long int")
    fits = once.select("__url", F.explode(suffixes_of(host_of(F.col("__url")))).alias("key")).join(rules, "key").filter(F.startswith(path_of(F.col("__url")), F.col("path")))
    longest = fits.groupBy("__url").agg(F.max_by(F.struct("verdict", "name"), "long").alias("__longest"))
    judged = once.join(met, "__url", "left").join(longest, "__url", "left")
    rows = urls.join(judged, F.col(url) == F.col("__url"), "left").drop("__url")
    return rows.withColumn("__met", F.coalesce("__met", F.array().cast("array<struct<verdict:string>>")))


def judge(urls: DataFrame, url: str = "url", hosts=HOST_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """urls with host, path, rule and verdict (these replace columns so named).

    The longest fitting host rule decides; else an allowing pattern rule, else
    a blocking one, else the verdict is allow. Null URLs and those without
    ``://`` have an empty host and path, and a null one fits no rule. Each row
    is judged by itself, however long its URL is: repeated rows stay, an empty
    table stays empty. Of host rules of one name the last one counts.
    """
    filed = rarest(urls, url, patterns)
    hosts = list({r.name: r for r in hosts}.values())
    # computed once per row: what follows reads them more than once
    rows = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if max(len(filed), len(hosts)) > MOST_RULES:
        rows = by_tables(rows, url, hosts, filed)
    else:
        pattern_index = Index([(k, {"verdict": r.verdict, "regex": r.regex}) for k, r in filed], "verdict:string,regex:string")
        host_index = Index([(r.host, {"verdict": r.verdict, "path": r.path, "name": r.name, "long": len(r.name)}) for r in hosts], "verdict:string,path:string,name:string,long:int")
        fits = F.filter(host_index.found(suffixes_of(F.col("host"))), lambda e: F.startswith(F.col("path"), e["path"]))
        longest = F.get(F.array_sort(fits, lambda a, b: b["long"] - a["long"]), 0)
        met = F.filter(pattern_index.found(tokens_of(F.col(url))), lambda e: F.coalesce(F.rlike(lowered(F.col(url)), e["regex"]), F.lit(False)))
        rows = rows.withColumns({"__longest": longest, "__met": met})
    by_pattern = F.when(F.exists("__met", lambda e: e["verdict"] == "allow"), "allow").when(F.size("__met") > 0, "block").otherwise("allow")
    rows = rows.withColumns({"rule": F.col("__longest")["name"], "verdict": F.coalesce(F.col("__longest")["verdict"], by_pattern)})
    return rows.drop("__longest", "__met")


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page's URL with its verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    hosts = ", ".join(f"({quoted(r.verdict)}, {quoted(r.host)}, {quoted(r.path)})" for r in HOST_RULES)
    patterns = ", ".join(f"({quoted(r.verdict)}, {quoted(r.regex)})" for r in PATTERN_RULES)
    lower = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    return rf"""
WITH hosts(verdict, host, path) AS (VALUES {hosts}), patterns(verdict, regex) AS (VALUES {patterns}),
pages_ AS (
  SELECT page_id, {lower("url")} AS low,
         coalesce({lower("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT p.*, (SELECT max({{'n': length(h.host || h.path), 'name': h.host || h.path, 'verdict': h.verdict}}) FROM hosts h
               WHERE (p.host = h.host OR ends_with(p.host, '.' || h.host)) AND starts_with(p.path, h.path)) AS best,
         (SELECT min(t.verdict) FROM patterns t WHERE regexp_matches(p.low, t.regex)) AS met
  FROM pages_ p)
SELECT page_id, host, path, best['name'] AS rule, coalesce(best['verdict'], met, 'allow') AS verdict FROM ruled
"""


OP8_SQL = _sql()
