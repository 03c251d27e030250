"""URL filters: rules found through their rarest literal token, then checked by regular expression.

A rule is reached only from URLs that hold its index token, so a URL runs a handful of regular
expressions however many rules there are. Up to BROADCAST_RULES rules every worker holds the index;
beyond, URLs and rules meet by a join on the token. Both ways give the same.

Edge cases: a null URL, or one without "://", has an empty host and path, fits no rule and is judged by
the default verdict; repeated rows each get their row; of host rules of one length, and of pattern rules
of one action, the first by text counts; an empty table gives an empty table; columns besides the key
and the URL are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.common import free, id_for_python, materialize, small

#: Most rules of an index that goes to every executor.
BROADCAST_RULES = 50_000
TOKEN = r"[a-z0-9]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression, searched in the lower-cased URL; tokens: literal tokens that
    stand whole in every URL that fits; text: what is reported; weight: the largest wins."""

    text: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    kind: str = "pattern"
    path: str = ""
    host: str = ""

    @property
    def weight(self) -> int:
        return len(self.text)


def host_rule(text: str, action: str) -> Rule:
    """A rule written host/path: it fits the host and its subdomains, if the path starts with /path."""
    host, _, path = text.partition("/")
    path = "/" + path
    whole = re.findall(TOKEN, host)
    # The last token of the path may go on in the URL, unless the rule itself ends it.
    inside = re.findall(TOKEN, path.lower())
    if inside and not path.endswith("/"):
        inside = inside[:-1]
    pattern = rf"(?s)^(?:(?!://).)*://(?:[^/?#]*\.)?{re.escape(host)}(?={re.escape(path.lower())})"
    return Rule(text, action, pattern, tuple(whole + inside), "host", path, host)


def pattern_rule(pattern: str, action: str, tokens: tuple[str, ...]) -> Rule:
    """A regular expression over the whole lower-cased URL with the literal tokens that it demands."""
    return Rule(pattern, action, pattern, tokens)


HOST_RULES = (
    host_rule("org/", "allow"),
    host_rule("example.org/es/", "block"),
    host_rule("example.org/en/1", "block"),
    host_rule("com/fr/", "allow"),
    host_rule("com/de/", "block"),
)
#: Words that condemn a host that has them, and those that do so in company.
STRONG = tuple("casino casinos bets pills porn xxx viagra cialis jackpot sportsbook hentai escorts".split())
WEAK = tuple(
    "bet betting wager poker slot slots roulette blackjack lottery lotto bingo baccarat keno odds punter gamble gambling pharmacy pharma "
    "meds drugstore steroids generics tablets sildenafil adult sex sexy cam cams webcams escort nude milf dating hookup loan loans payday "
    "credit replica warez cracks torrent torrents keygen".split()
)
COMPANY = tuple(
    "free online best cheap live win wins winner bonus buy top club world hot vip deals royal lucky mega star gold golden king hub zone city "
    "palace express now today fast easy shop store direct secret real super max pro plus prime fun play games".split()
)
TRACKERS = tuple("ad ads adserver banner banners track tracker tracking pixel click clicks beacon metrics telemetry popup popunder affiliate".split())
_HOST = r"(?s)^(?:(?!://).)*://"


def word_rule(word: str, action: str = "block") -> Rule:
    """The word stands whole in the host."""
    return Rule(word, action, rf"{_HOST}[^/?#]*\b{re.escape(word)}\b", (word,), "pattern")


def label_rule(label: str, action: str = "block") -> Rule:
    """A label of the host, between its dots, is just this."""
    return Rule(f"{label}.", action, rf"{_HOST}(?:[^/?#]*\.)?{re.escape(label)}(?=[.:/?#]|$)", tuple(re.findall(TOKEN, label)), "pattern")


def compound_labels() -> list[str]:
    pairs = [(w, c) for w in WEAK for c in COMPANY] + [(a, b) for a in TRACKERS for b in TRACKERS if a != b]
    return sorted({x for a, b in pairs for x in (f"{a}-{b}", f"{b}-{a}", a + b, b + a)})


#: The method's own rules: gambling, pharmacy, adult, lending, piracy and tracking hosts.
PATTERN_RULES = (*map(word_rule, STRONG), *map(label_rule, compound_labels()))

_RULE = "text string, action string, pattern string, tokens array<string>, kind string, path string, host string"


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(url, UPPER, UPPER.lower()), F.lit(TOKEN), F.lit(0)))


def as_table(spark: SparkSession, rules: Iterable[Rule] | DataFrame) -> DataFrame:
    """(text, action, pattern, tokens, kind, path, host): a row for each rule."""
    if isinstance(rules, DataFrame):
        return rules.select("text", "action", "pattern", "tokens", "kind", "path", "host").distinct()
    return spark.createDataFrame(pd.DataFrame([astuple(r) for r in rules], columns=[c.split()[0] for c in _RULE.split(", ")], dtype=object), _RULE)


def rarest_tokens(table: DataFrame, urls: Column, df: DataFrame) -> DataFrame:
    """table with key: that token of each rule which the fewest URLs of df have; null without any token."""
    tokens = table.select("text", "pattern", F.explode("tokens").alias("t"))
    counts = df.select(F.explode(url_tokens(urls)).alias("t")).join(small(tokens.select("t").distinct()), "t", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    keys = tokens.join(counts, "t", "left").groupBy("text", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t")).alias("k"))
    return table.join(keys.select("text", "pattern", F.col("k.t").alias("key")), ["text", "pattern"], "left")


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without "://"."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host = m[1].translate(_LOWER)
    return host, m[2]


_LOWER = {c: c + 32 for c in range(65, 91)}


@lru_cache(maxsize=100_000)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def fits(rule: Rule, low: str, host: str, path: str) -> bool:
    """The expression runs on lower case; the path of a host rule is case-sensitive."""
    if not _compiled(rule.pattern).search(low):
        return False
    return rule.kind != "host" or (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def strength(rule: Rule) -> tuple:
    """The greatest counts: host rules by length, then pattern rules that block; then the first by text."""
    return (rule.kind == "host", rule.weight if rule.kind == "host" else int(rule.action == "block"), *(-ord(c) for c in rule.text), 1)


def _decided(best: Rule | None, default: str) -> tuple[str | None, str, str | None]:
    if best is None:
        return None, default, None
    return (best.text, best.action, None) if best.kind == "host" else (None, best.action, best.text)


def judge(
    df: DataFrame,
    key_col: str = "page_id",
    url_col: str = "url",
    rules: Iterable[Rule] | DataFrame = HOST_RULES + PATTERN_RULES,
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
    with_tried: bool = False,
) -> DataFrame:
    """Per row: key, host, path, rule (the longest fitting host rule, else null), verdict, pattern [, tried].

    A host rule decides before the pattern rules; among pattern rules a block wins; else the default.
    pattern names the pattern rule that decided, or is null; tried: the expressions run for the row.
    Rules: Rule objects, or a table as as_table() makes one. Those without any token are tried on every
    URL, so they are few.
    """
    table = materialize(rarest_tokens(as_table(df.sparkSession, rules), F.col(url_col), df))
    always = [Rule(*r) for r in table.filter("key is null").drop("key").select(*[c.split()[0] for c in _RULE.split(", ")]).collect()]
    names = ["host", "path", "rule", "verdict", "pattern", "tried"]
    wanted = names if with_tried else names[:-1]
    kind = df.schema[key_col].dataType.simpleString()
    rows = df.select(id_for_python(df, key_col).alias("key"), F.col(url_col).alias("url"))
    back = lambda found: found.withColumn(key_col, F.col(key_col).cast(kind))
    keyed = table.filter("key is not null")
    rule_cols = [c.split()[0] for c in _RULE.split(", ")]
    index: dict[str, list[Rule]] | None = None
    if keyed.limit(broadcast_rules + 1).count() <= broadcast_rules:
        index = defaultdict(list)
        for r in keyed.select("key", *rule_cols).collect():
            index[r["key"]].append(Rule(*r[1:]))
        index = dict(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = re.compile(TOKEN).findall
        for pdf in batches:
            out = []
            for url, given in zip(pdf["url"], pdf["found"] if "found" in pdf else [None] * len(pdf)):
                host, path = split_url(url)
                tried, ok = 0, []
                if url is not None and "://" in url:
                    low = url.translate(_LOWER)
                    some = always + [r for t in set(find(low)) for r in index.get(t, ())] if index is not None else always
                    tried = len(some)
                    ok = [r for r in some if fits(r, low, host, path)]
                    if given is not None:
                        tried += given["tried"]
                        ok += [Rule(*x.values()) if isinstance(x, dict) else Rule(*x) for x in (given["host"], given["pattern"]) if x is not None]
                out.append((host, path, *_decided(max(ok, key=strength, default=None), default), tried))
            got = pd.DataFrame(out, columns=names, dtype=object)
            got.insert(0, key_col, pdf["key"].to_numpy())
            yield got[[key_col, *wanted]]

    schema = f"`{key_col}` {rows.schema['key'].dataType.simpleString()}, host string, path string, rule string, verdict string, pattern string" + (", tried int" if with_tried else "")
    if index is not None:
        return back(rows.mapInPandas(run, schema))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for url, *r in zip(pdf["url"], *(pdf[c] for c in rule_cols)):
                ok.append(fits(Rule(*r), url.translate(_LOWER), *split_url(url)))
            yield pdf.assign(ok=ok)

    met = rows.select("url").filter(F.contains("url", F.lit("://"))).distinct().select("url", F.explode(url_tokens(F.col("url"))).alias("key")).join(keyed.select("key", *rule_cols), "key")
    checked = met.select("url", *rule_cols).mapInPandas(check, f"url string, {_RULE}, ok boolean")
    rule = F.struct(*rule_cols)
    is_host = F.col("kind") == "host"
    # min by (weakness, text): the same order as strength()
    best = lambda when, weak: F.min(F.when(F.col("ok") & when, F.struct(weak.alias("w"), F.col("text").alias("t"), rule.alias("rule"))))["rule"]
    found = checked.groupBy("url").agg(
        F.count("*").cast("int").alias("tried"), best(is_host, -F.length("text")).alias("host"), best(~is_host, (F.col("action") != "block").cast("int")).alias("pattern")
    )
    both = rows.join(found.select("url", F.struct("tried", "host", "pattern").alias("found")), "url", "left")
    return back(both.select("key", "url", "found").mapInPandas(run, schema))


def keep_allowed(df: DataFrame, url_col: str = "url", **options) -> DataFrame:
    """The rows of df whose URL is allowed, with all their columns; verdicts are found once per different URL."""
    (own,) = free(df, "u")
    bad = judge(df.select(F.col(url_col).alias("u"), F.col(url_col).alias("url")).distinct(), "u", "url", **options)
    bad = bad.filter("verdict = 'block'").select(F.col("u").alias(own))
    return df.join(bad, F.col(url_col) == F.col(own), "left_anti")
