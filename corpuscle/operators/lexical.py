"""Lexical diversity: of a corpus, by period, and of each document.

Pooled measures see the corpus as one stream of tokens in order of its ids. Positions in the stream
come from two-level sums, the moving ratio from blocks that overlap, and MTLD from blocks that are run again
where the factor they begin within turns out to be another.
"""

from __future__ import annotations

import datetime
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.special import lgamma
from corpuscle.operators.corpus import Corpus, period_label, unit_of
from corpuscle.operators.resampling import _products
from corpuscle.plans.storage import ranged, running, written

METRICS = ("ttr", "mattr", "mtld", "hdd")
#: Positions of a stream that one task looks at.
BLOCK = 65_536
#: Tokens of a task, rounds until blocks agree (beyond, a group is one task's), and lists that go to Python at once.
TASK_TOKENS = 2_000_000
ROUNDS = 12
LISTS = 256
#: Numbers that a task computes at once.
PRODUCTS = 1 << 20

# kernels on one token list


def ttr(tokens: Sequence[str]) -> float:
    return len(set(tokens)) / len(tokens) if len(tokens) else math.nan


def mattr(tokens: Sequence[str], window: int = 100) -> float:
    """Mean share of types over all windows; of shorter texts the plain ratio."""
    if window < 1:
        raise ValueError("a window has at least one token")
    n = len(tokens)
    if n < window:
        return ttr(tokens)
    seen, total = Counter(tokens[:window]), 0
    total = len(seen)
    for gone, come in zip(tokens, tokens[window:]):
        seen[gone] -= 1
        if not seen[gone]:
            del seen[gone]
        seen[come] += 1
        total += len(seen)
    return total / (window * (n - window + 1))


class Factors:
    """One direction of MTLD, token by token."""

    def __init__(self, threshold: float):
        self.threshold, self.types, self.run, self.factors, self.tokens = threshold, set(), 0, 0.0, 0

    def add(self, token: str) -> None:
        self.types.add(token)
        self.run += 1
        if len(self.types) / self.run <= self.threshold:
            self.factors += 1
            self.tokens += self.run
            self.types, self.run = set(), 0

    def mean_length(self) -> float:
        factors, tokens = self.factors, self.tokens
        if self.run:
            r = len(self.types) / self.run
            if r < 1:  # an unfinished factor counts in part; without repetition it tells nothing
                factors += (1 - r) / (1 - self.threshold)
                tokens += self.run
        return tokens / factors if factors else math.nan


def mtld(tokens: Sequence[str], threshold: float = 0.72) -> float:
    both = []
    for direction in (tokens, reversed(tokens)):
        f = Factors(threshold)
        for t in direction:
            f.add(t)
        both.append(f.mean_length())
    real = [x for x in both if not math.isnan(x)]
    return sum(real) / len(real) if real else math.nan


def hdd_from_counts(counts: Sequence[int], sample_size: int = 42) -> float:
    """Expected types in a sample: for each type the chance to be drawn. Few tokens: the types."""
    c = np.asarray(counts, float)
    n, s = c.sum(), sample_size
    if n <= s:
        return float((c > 0).sum())
    none = np.zeros(len(c))
    can = n - c >= s
    none[can] = np.exp(lgamma(n - c[can] + 1) - lgamma(n - c[can] - s + 1) - lgamma(n + 1) + lgamma(n - s + 1))
    return float((1 - none).sum())


def hdd(tokens: Sequence[str], sample_size: int = 42) -> float:
    return hdd_from_counts(list(Counter(tokens).values()), sample_size) if len(tokens) else math.nan


def hill_from_counts(counts: Sequence[int], q: float) -> float:
    c = np.asarray([x for x in counts if x > 0], float)
    if not len(c):
        return 0.0
    p = c / c.sum()
    if q == 1:
        return math.exp(float(-np.dot(p, np.log(p))))
    return float(np.power(np.power(p, q).sum(), 1.0 / (1.0 - q)))


def rarefaction_from_counts(counts: Sequence[int], sample_size: int) -> float:
    n = sum(counts)
    if not 1 <= sample_size <= n:
        raise ValueError("a sample has between 1 and all tokens")
    c = np.asarray(counts, float)
    none = np.zeros(len(c))
    can = n - c >= sample_size
    none[can] = np.exp(lgamma(n - c[can] + 1) - lgamma(n - c[can] - sample_size + 1) - lgamma(n + 1) + lgamma(n - sample_size + 1))
    return float((1 - none).sum())


# on a corpus


def count_histogram(corpus: Corpus) -> DataFrame:
    """(c, types): how many terms occur c times; far smaller than the vocabulary."""
    return corpus.terms().groupBy("term").agg(F.count("*").alias("c")).groupBy("c").agg(F.count("*").alias("types"))


def hill_numbers(corpus: Corpus, orders: Sequence[float] = (0, 1, 2)) -> DataFrame:
    """(q, hill): the effective number of types of each order."""
    h = written(count_histogram(corpus))
    n = h.agg(F.sum(F.col("c") * F.col("types")).cast("double").alias("n"))
    p = h.crossJoin(F.broadcast(n)).select((F.col("c") / F.col("n")).alias("p"), "types")
    found = None
    for q in orders:
        q = float(q)
        if q == 1:
            value = F.exp(-F.sum(F.col("types") * F.col("p") * F.ln("p")))
        else:
            value = F.pow(F.sum(F.col("types") * F.pow(F.col("p"), F.lit(q))), F.lit(1 / (1 - q)))
        one = p.agg(F.coalesce(value, F.lit(0.0)).alias("hill")).select(F.lit(q).alias("q"), "hill")
        found = one if found is None else found.unionByName(one)
    return found


def rarefaction(corpus: Corpus, sample_size: int) -> float:
    """Expected types in a sample of so many tokens, from the histogram of counts."""
    h = count_histogram(corpus).toPandas()
    c, t = h["c"].to_numpy(float), h["types"].to_numpy(float)
    n = (c * t).sum()
    if not 1 <= sample_size <= n:
        raise ValueError("a sample has between 1 and all tokens")
    none = np.zeros(len(c))
    can = n - c >= sample_size
    none[can] = np.exp(lgamma(n - c[can] + 1) - lgamma(n - c[can] - sample_size + 1) - lgamma(n + 1) + lgamma(n - sample_size + 1))
    return float((t * (1 - none)).sum())


def stream(corpus: Corpus, group: str | None = None) -> DataFrame:
    """(grp, pos, term): the tokens of each group in order of the ids, numbered from 0."""
    key = corpus.need_id("a stream of tokens")
    grp = F.col(group) if group else F.lit("")
    lists = corpus.df.select(grp.alias("grp"), F.col(key).alias("key"), F.col(corpus.text_col).alias("_text"))
    lists = Corpus(lists, "_text", "key", tokenizer=corpus.tokenizer).token_lists("grp", "key")
    # the table fixes which rows are in which range, so the sums of the ranges hold
    placed = written(lists.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("grp", "part").agg(F.sum(F.size("tokens")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("grp", "part", before.alias("start"))
    own = F.coalesce(F.sum(F.size("tokens")).over(Window.partitionBy("grp", "part").orderBy("key", "tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = placed.withColumn("own", own).join(F.broadcast(starts), ["grp", "part"])
    return offset.select("grp", (F.col("start") + F.col("own")).alias("at"), F.posexplode("tokens").alias("i", "term")).select(
        "grp", (F.col("at") + F.col("i")).cast("long").alias("pos"), "term"
    )


def pooled_mattr(tokens: DataFrame, window: int = 100) -> DataFrame:
    """(grp, mattr): each token counts in the windows in which it is the first of its type.

    The stream is cut to blocks of positions that share a window's length: an earlier occurrence counts
    only within the window, so a block needs no more, and a common word is not one task's.
    """
    size = max(BLOCK, 4 * window)
    n = tokens.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("term").alias("types"))
    own = F.floor(F.col("pos") / size)
    later = F.when(F.pmod("pos", F.lit(size)) > size - window, F.array(own, own + 1)).otherwise(F.array(own))
    spread = tokens.withColumn("block", F.explode(later))
    prev = F.coalesce(F.lag("pos").over(Window.partitionBy("grp", "block", "term").orderBy("pos")), F.lit(-1))
    rows = spread.withColumn("prev", prev).filter(F.col("block") == own).join(F.broadcast(n), "grp")
    first = F.greatest(F.col("pos") - (window - 1), F.col("prev") + 1, F.lit(0))
    windows = F.greatest(F.least(F.col("pos"), F.col("n") - window) - first + 1, F.lit(0))
    sums = rows.groupBy("grp", "n", "types").agg(F.sum(windows).alias("s"))
    value = F.when(F.col("n") < window, F.col("types") / F.col("n")).otherwise(F.col("s") / (window * (F.col("n") - window + 1)).cast("double"))
    return sums.select("grp", value.alias("mattr"))


def factor_ends(tokens: Sequence[str], held: Sequence[str], threshold: float, ends: Sequence[int], tail: Sequence[str]) -> tuple[list[int], list[str]]:
    """Where factors end in a block, and the tokens of the one that does not, when the first began with held.

    ends and tail are what another beginning gave: from the first end in common on all is the same.
    """
    known, out = {int(e): i for i, e in enumerate(ends)}, []
    types, run, start = set(held), len(held), 0
    for i, t in enumerate(tokens, 1):
        types.add(t)
        run += 1
        if len(types) / run <= threshold:
            out.append(i)
            if i in known:
                return out + [int(e) for e in ends[known[i] + 1 :]], list(tail)
            types, run, start = set(), 0, i
    return out, list(tokens[start:]) if out else [*held, *tokens]


def pooled_mtld(tokens: DataFrame, threshold: float = 0.72) -> DataFrame:
    """(grp, mtld): both directions, each in blocks of the stream.

    A block is first run as if a factor began with it, then again with the tokens that the block before
    left over, until no block's left-over changes: factors of different beginnings soon end together.
    """
    kind = tokens.schema["grp"].dataType.simpleString()
    parts = max(1, -(-tokens.count() // TASK_TOKENS))
    parts = max(parts, min(tokens.sparkSession.sparkContext.defaultParallelism, 4 * parts))
    placed = tokens.withColumn("block", F.floor(F.col("pos") / BLOCK)).repartition(parts, "grp", "block")
    blocks = placed.groupBy("grp", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("s"))
    blocks = written(blocks.select("grp", "block", F.transform("s", lambda x: x["term"]).alias("tokens")))
    found = None
    for step in (1, -1):
        one = _directed(blocks, kind, step, threshold)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("grp").agg(F.coalesce(F.avg(F.when(~F.isnan("x"), F.col("x"))), F.lit(math.nan)).alias("mtld"))


def _directed(blocks: DataFrame, kind: str, step: int, threshold: float) -> DataFrame:
    """(grp, x): the mean length of factors in one direction."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [factor_ends(list(t)[::step], list(h), threshold, e, l) for t, h, e, l in zip(pdf["tokens"], pdf["held"], pdf["ends"], pdf["tail"])]
            ends, tail = pd.Series([g[0] for g in got], dtype=object), pd.Series([g[1] for g in got], dtype=object)
            out = pd.DataFrame({"grp": pdf["grp"].array, "block": pdf["block"].array, "n": pdf["tokens"].map(len).array, "held": pdf["held"].array})
            yield out.assign(ends=ends, tail=tail)

    schema = f"grp {kind}, block long, n long, held array<string>, ends array<int>, tail array<string>"
    same = lambda a, b: a["grp"].eqNullSafe(b["grp"]) & (a["block"] == b["block"])
    none = F.array().cast("array<string>")
    begin = blocks.select("*", none.alias("held"), F.array().cast("array<int>").alias("ends"), none.alias("tail"))
    state = written(begin.mapInPandas(run, schema), 4)
    for _ in range(ROUNDS):
        left = state.select("grp", (F.col("block") + step).alias("block"), F.col("tail").alias("given"))
        todo = written(state.alias("a").join(left.alias("b"), same(state, left)).filter("a.held <> b.given").select("a.grp", "a.block", F.col("b.given").alias("held"), "a.ends", "a.tail"))
        if todo.isEmpty():
            break
        again = blocks.join(todo, same(blocks, todo)).select(blocks["grp"], blocks["block"], "tokens", "held", "ends", "tail")
        again = written(again.mapInPandas(run, schema), 4)
        state = written(state.join(again, same(state, again), "left_anti").unionByName(again))
    else:
        return _in_one_task(blocks, kind, step, threshold)
    last = F.max_by("tail", F.col("block") * step)
    sums = state.groupBy("grp").agg(F.sum(F.size("ends")).alias("f"), F.sum("n").alias("n"), F.size(last).alias("run"), F.size(F.array_distinct(last)).alias("types"))
    # an unfinished factor counts in part; without repetition it tells nothing
    part = F.col("types") < F.col("run")
    f = F.col("f") + F.when(part, (1 - F.col("types") / F.col("run")) / (1 - threshold)).otherwise(0.0)
    n = F.col("n") - F.when(part, 0).otherwise(F.col("run"))
    return sums.select("grp", F.when(f > 0, n / F.when(f > 0, f)).otherwise(F.lit(math.nan)).alias("x"))


def _in_one_task(blocks: DataFrame, kind: str, step: int, threshold: float) -> DataFrame:
    """As _directed(), for streams whose factors are longer than blocks: a pass over each group, with the types of one factor in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, f = None, None
        for pdf in batches:
            for grp, tokens in zip(pdf["grp"], pdf["tokens"]):
                if f is None or grp != now:
                    if f is not None:
                        yield pd.DataFrame({"grp": [now], "x": [f.mean_length()]})
                    now, f = grp, Factors(threshold)
                for t in tokens[::step]:
                    f.add(t)
        if f is not None:
            yield pd.DataFrame({"grp": [now], "x": [f.mean_length()]})

    order = blocks.repartition("grp").sortWithinPartitions(F.col("grp"), F.col("block") * step).select("grp", "tokens")
    return written(order.mapInPandas(run, f"grp {kind}, x double"), 4)


def pooled_hdd(tokens: DataFrame, sample_size: int = 42) -> DataFrame:
    """(grp, hdd): from counts of counts, with the chance of a miss as a product of sample_size factors."""
    counts = tokens.groupBy("grp", "term").agg(F.count("*").alias("c"))
    return hdd_of_counts(counts.groupBy("grp", "c").agg(F.count("*").alias("k")), sample_size)


def hdd_of_counts(counts: DataFrame, sample_size: int = 42) -> DataFrame:
    """(grp, hdd) of (grp, c, k): k terms occur c times."""
    n = counts.groupBy("grp").agg(F.sum(F.col("c") * F.col("k")).alias("n"), F.sum("k").alias("types"))
    h = counts.join(F.broadcast(n), "grp")
    # once n - c < sample_size a factor is zero or less, and the term cannot be missed
    factor = lambda j: F.greatest((F.col("n") - F.col("c") - j).cast("double"), F.lit(0.0)) / F.greatest(F.col("n") - j, F.lit(1))
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(sample_size - 1)), F.lit(1.0), lambda acc, j: acc * factor(j))
    value = F.when(F.max("n") <= sample_size, F.max("types").cast("double")).otherwise(F.sum(F.col("k") * (1 - miss)))
    return h.groupBy("grp").agg(value.alias("hdd"))


def pooled(tokens: DataFrame, metrics: Sequence[str] = METRICS, window: int = 100, threshold: float = 0.72, sample_size: int = 42) -> DataFrame:
    """(grp, n_tokens, n_types, and a column for each metric)."""
    unknown = set(metrics) - set(METRICS)
    if unknown or not metrics:
        raise ValueError(f"metrics are {', '.join(METRICS)}, not {', '.join(sorted(unknown)) or 'none'}")
    out = tokens.groupBy("grp").agg(F.count("*").alias("n_tokens"), F.countDistinct("term").alias("n_types"))
    for m in metrics:
        if m == "ttr":
            out = out.withColumn("ttr", F.col("n_types") / F.col("n_tokens"))
        else:
            out = out.join({"mattr": lambda: pooled_mattr(tokens, window), "mtld": lambda: pooled_mtld(tokens, threshold), "hdd": lambda: pooled_hdd(tokens, sample_size)}[m](), "grp")
    return out


def per_document(corpus: Corpus, window: int = 100, threshold: float = 0.72, sample_size: int = 42) -> DataFrame:
    """(doc_id, n_tokens, ttr, mattr, mtld, hdd) of the documents that have tokens."""
    key = corpus.need_id("a table by document")

    @F.pandas_udf("struct<mattr:double,mtld:double,hdd:double>")
    def run(lists: pd.Series) -> pd.DataFrame:
        rows = [(mattr(t, window), mtld(t, threshold), hdd(t, sample_size)) for t in map(list, lists)]
        return pd.DataFrame(rows, columns=["mattr", "mtld", "hdd"])

    rows = corpus.token_lists(key).filter(F.size("tokens") > 0)
    rows = rows.select(F.col(key).alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"), (F.size(F.array_distinct("tokens")) / F.size("tokens")).alias("ttr"), run("tokens").alias("m"))
    return written(rows.select("doc_id", "n_tokens", "ttr", "m.*"), LISTS)


def lexical_diversity(
    corpus: Corpus,
    freq: str | None = None,
    time_col: str = "date",
    per_doc: bool = False,
    window: int = 100,
    threshold: float = 0.72,
    sample_size: int = 42,
    ci: bool = False,
    n_boot: int = 199,
    ci_level: float = 0.95,
    seed: int = 0,
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """(metric, value); with freq (period, metric, value, n_tokens, n_types[, ci_lower, ci_upper]); or per_document()."""
    if set(metrics) - set(METRICS) or not metrics:
        raise ValueError(f"metrics are some of {', '.join(METRICS)}")
    if not 0 < ci_level < 1 or n_boot < 1:
        raise ValueError("a confidence level lies between 0 and 1, and there is at least one replicate")
    if per_doc:
        return per_document(corpus, window, threshold, sample_size)
    names = ", ".join(f"'{m}', {m}" for m in metrics)
    unpivot = F.expr(f"stack({len(metrics)}, {names}) as (metric, value)")
    if freq is None:
        return pooled(written(stream(corpus)), metrics, window, threshold, sample_size).select(unpivot)
    unit = unit_of(freq)
    dated = corpus.by_time(time_col, freq).docs.filter("period is not null")
    timed = Corpus(dated, corpus.text_col, corpus.id_col, tokenizer=corpus.tokenizer)
    table = pooled(written(stream(timed, "period")), metrics, window, threshold, sample_size)
    table = table.select(F.col("grp").alias("period"), unpivot, "n_tokens", "n_types")
    if ci:
        table = table.join(_period_intervals(timed, metrics, window, threshold, sample_size, n_boot, ci_level, seed), ["period", "metric"], "left")
    return table.withColumn("period_label", period_label(F.col("period"), unit)).orderBy("metric", "period")


def _period_intervals(timed: Corpus, metrics, window, threshold, sample_size, n_boot, ci_level, seed) -> DataFrame:
    """Documents of a period drawn with replacement and pooled in the order drawn."""
    key = timed.need_id("a bootstrap")
    rows = ranged(timed.token_lists(F.struct("period", F.col(key).alias("key")).alias("at")).withColumn("one", F.lit(1)), "at")
    rows = running(rows, "at", "sum", "one", "place").select("at.period", "tokens", "place")
    sizes = written(rows.groupBy("period").agg(F.count("*").alias("docs"), F.min("place").alias("first")))
    lists = written(rows.join(F.broadcast(sizes.select("period", "first")), "period").select("period", (F.col("place") - F.col("first")).cast("int").alias("slot"), "tokens"))
    tail = (1 - ci_level) / 2
    free = [m for m in metrics if m in ("ttr", "hdd")]
    drawn = None
    if free:
        docs = {r["period"]: r["docs"] for r in sizes.collect()}
        drawn = _order_free(lists, docs, free, sample_size, n_boot, seed)
    metrics = [m for m in metrics if m not in free]
    if metrics:
        own = _in_order(lists, sizes, metrics, window, threshold, sample_size, n_boot, seed)
        drawn = own if drawn is None else drawn.unionByName(own)
    drawn = drawn.filter(~F.isnan("x"))
    return drawn.groupBy("period", "metric").agg(F.percentile("x", tail).alias("ci_lower"), F.percentile("x", 1 - tail).alias("ci_upper"))


def _order_free(lists: DataFrame, docs: dict, metrics: Sequence[str], sample_size: int, n_boot: int, seed: int) -> DataFrame:
    """(period, metric, x) of metrics that do not depend on the order drawn: from how often a replicate has each term.

    Terms stay where their cells are; what goes on is how many terms a replicate has so often.
    """
    cells = written(lists.select("period", "slot", F.explode("tokens").alias("term")).groupBy("period", "term", "slot").agg(F.count("*").alias("n")))
    many = cells.count()
    tasks = max(1, -(-many // TASK_TOKENS), min(lists.sparkSession.sparkContext.defaultParallelism, -(-many // 50_000)))
    schema = "period date, b int, c long, k long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            same = pdf["period"].to_numpy()
            cuts = [0, *(np.flatnonzero(same[1:] != same[:-1]) + 1).tolist(), len(pdf)]
            for x, y in zip(cuts, cuts[1:]):
                piece = pdf.iloc[x:y]
                # another period, or enough of this one and another term
                if held and (piece["period"].iloc[0] != held[0]["period"].iloc[0] or size >= TASK_TOKENS and piece["term"].iloc[0] != held[-1]["term"].iloc[-1]):
                    yield settle(held)
                    held, size = [], 0
                held.append(piece)
                size += len(piece)
        if held:
            yield settle(held)

    def settle(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        period = pdf["period"].iloc[0]
        names = pdf["term"].to_numpy()
        number = np.cumsum(np.r_[True, names[1:] != names[:-1]]) - 1
        at, n, terms = pdf["slot"].to_numpy(), pdf["n"].to_numpy(float), int(number[-1]) + 1
        found: Counter = Counter()
        size = max(1, PRODUCTS // n_boot)
        for t in range(0, terms, size):
            x, y = np.searchsorted(number, [t, t + size])
            slots, slot = np.unique(at[x:y], return_inverse=True)
            table = lambda chosen: drawn_weights(period, docs[period], chosen, seed)[slots]  # noqa: E731, B023
            counts = _products(number[x:y] - t, slot, n[x:y], min(size, terms - t), n_boot, docs[period], table).astype(np.int64)
            for b in range(n_boot):
                c, k = np.unique(counts[:, b], return_counts=True)
                found.update({(b, int(i)): int(j) for i, j in zip(c, k)})
        keys = list(found)
        return pd.DataFrame({"period": period, "b": [b for b, _ in keys], "c": [c for _, c in keys], "k": [found[x] for x in keys]})

    counts = cells.repartition(tasks, "period", "term").sortWithinPartitions("period", "term", "slot").mapInPandas(run, schema)
    counts = written(counts.filter("c > 0").groupBy("period", "b", "c").agg(F.sum("k").alias("k")))
    out = None
    for m in metrics:
        if m == "ttr":
            own = counts.groupBy("period", "b").agg((F.sum("k") / F.sum(F.col("k") * F.col("c"))).alias("x"))
        else:
            spread = counts.select(F.struct("period", "b").alias("grp"), "c", "k")
            own = hdd_of_counts(spread, sample_size).select("grp.*", F.col("hdd").alias("x"))
        own = own.select("period", F.lit(m).alias("metric"), "x")
        out = own if out is None else out.unionByName(own)
    return out


_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def xx_int(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int or a date, after what gave seed."""
    with np.errstate(over="ignore"):
        h = seed + _P[4] + np.uint64(4)
        h = h ^ ((value.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)) * _P[0])
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P[1] + _P[2]
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


def drawn_weights(period, docs: int, replicates: Sequence[int], seed: int) -> np.ndarray:
    """(documents, replicates): how often each is drawn; draws are xxhash64(period, b, draw, seed) modulo the documents."""
    out = np.empty((len(replicates), docs), np.uint16)
    day = xx_int(np.array([(period - datetime.date(1970, 1, 1)).days]), np.array([42], np.uint64))
    for row, b in zip(out, replicates):
        start, count = xx_int(np.array([b]), day), np.zeros(docs, np.int64)
        for at in range(0, docs, PRODUCTS):
            h = xx_int(np.array([seed]), xx_int(np.arange(at, min(docs, at + PRODUCTS)), start))
            count += np.bincount(h.view(np.int64) % docs, minlength=docs)
        row[:] = np.minimum(count, 65_535)
    return out.T


def _in_order(lists: DataFrame, sizes: DataFrame, metrics: Sequence[str], window: int, threshold: float, sample_size: int, n_boot: int, seed: int) -> DataFrame:
    """(period, metric, x) of metrics that depend on the order: a replicate is a task of its own."""
    draws = sizes.select("period", "docs", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    draws = draws.select("period", "b", "docs", F.explode(F.sequence(F.lit(0), F.col("docs").cast("int") - 1)).alias("draw"))
    draws = draws.withColumn("slot", F.pmod(F.xxhash64("period", "b", "draw", F.lit(seed)), "docs").cast("int"))
    both = draws.join(lists.hint("merge"), ["period", "slot"]).select("period", "b", "draw", "tokens")
    kernels = {"ttr": ttr, "mattr": lambda t: mattr(t, window), "mtld": lambda t: mtld(t, threshold), "hdd": lambda t: hdd(t, sample_size)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = [t for row in pdf.sort_values("draw")["tokens"] for t in row]
        return pd.DataFrame({"period": pdf["period"].iloc[0], "metric": list(metrics), "x": [kernels[m](tokens) for m in metrics]})

    return both.groupBy("period", "b").applyInPandas(run, "period date, metric string, x double")
