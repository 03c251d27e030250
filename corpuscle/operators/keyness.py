"""Keyness: which terms set one side apart from another, from N corpora, or from a reference list."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import stats
from corpuscle.functions.special import p_value
from corpuscle.operators.corpus import Corpus, require_documents
from corpuscle.plans.storage import ranged, running, small, written

CORRECTIONS = ("none", "bh", "bonferroni")


def without(terms: DataFrame, stop_words: Iterable[str] | None) -> DataFrame:
    """Rows whose term isn't a stop word; applied after the totals are taken."""
    words = sorted(set(stop_words or ()))
    if not words:
        return terms
    if len(words) <= 1000:
        return terms.filter(~F.col("term").isin(words))
    listed = terms.sparkSession.createDataFrame([(w,) for w in words], "term string")
    return terms.join(listed, "term", "left_anti")


def side_counts(a: Corpus, b: Corpus) -> DataFrame:
    """(term, count_a, count_b): both sides in one aggregation, combined before the shuffle."""
    both = a.terms().select("term", F.lit(1).alias("in_a")).unionByName(b.terms().select("term", F.lit(0).alias("in_a")))
    return both.groupBy("term").agg(F.sum("in_a").alias("count_a"), F.sum(1 - F.col("in_a")).alias("count_b"))


def with_totals(counts: DataFrame, columns: Sequence[str], sides: Sequence[Corpus]) -> tuple[DataFrame, list[int]]:
    """counts as a table, and the sum of each column: texts are read and cut to tokens once for both."""
    counts = written(counts)
    row = counts.agg(*[F.sum(F.col(f"`{c}`")) for c in columns]).first()
    for side, n in zip(sides, row):
        if not n:
            raise ValueError(f"{side.label} holds no tokens")
    return counts, [int(n) for n in row]


def adjusted(table: DataFrame, method: str, p_col: str = "p_value", out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg or Bonferroni over the rows whose p isn't NaN; NaN stays.

    For Benjamini-Hochberg, ranks come from counts of equal p in a table of different values, which is
    cut to ranges: what runs over all of it is carried from range to range.
    """
    if method not in CORRECTIONS:
        raise ValueError(f"a correction is one of {', '.join(CORRECTIONS)}, not {method!r}")
    if method == "none":
        return table
    real = table.filter(~F.isnan(p_col) & F.col(p_col).isNotNull())
    if method == "bonferroni":
        m = real.agg(F.count("*").alias("_m"))
        both = table.crossJoin(F.broadcast(m))
        return both.withColumn(out, F.least(F.col(p_col) * F.col("_m"), F.lit(1.0))).drop("_m")
    values = ranged(real.groupBy(F.col(p_col).alias("_p")).agg(F.count("*").alias("_n")), "_p")
    ranked = running(values, "_p", "sum", "_n", "_r")
    m = values.agg(F.sum("_n").alias("_m"))
    raw = ranked.crossJoin(F.broadcast(m)).withColumn("_raw", F.col("_p") * F.col("_m") / F.col("_r"))
    ranked = running(raw, "_p", "min", "_raw", "_low", backwards=True).select("_p", F.least("_low", F.lit(1.0)).alias("_adj"))
    return table.join(ranked, F.col(p_col) == F.col("_p"), "left").withColumn(out, F.coalesce("_adj", F.col(p_col))).drop("_p", "_adj")


def statistics(
    counts: DataFrame,
    n_a: int | Column,
    n_b: int | Column,
    method: str = "log_likelihood",
    formula: str = "rayson",
    effect_size: bool = True,
    with_p: bool = True,
) -> DataFrame:
    """The columns of a two-sided table from count_a and count_b."""
    if method not in ("log_likelihood", "chi_squared", "log_ratio", "percent_diff", "bayes_factor"):
        raise ValueError(f"unknown method {method!r}")
    if method in ("log_ratio", "percent_diff", "bayes_factor") and not effect_size:
        raise ValueError(f"{method} needs effect_size=True")
    for n in (n_a, n_b):
        if not isinstance(n, Column) and n <= 0:
            raise ValueError("totals must be positive")
    a, b = F.col("count_a"), F.col("count_b")
    n_a, n_b = stats.dbl(n_a), stats.dbl(n_b)
    e_a, e_b = stats.expected(stats.dbl(a), stats.dbl(b), n_a, n_b)
    table = counts.select("term", "count_a", "count_b", e_a.alias("expected_a"), e_b.alias("expected_b"), stats.g2(a, b, n_a, n_b, formula).alias("g2"))
    if with_p:
        table = table.withColumn("p_value", p_value(F.col("g2")))
    if method == "chi_squared":
        table = table.withColumn("chi_squared", stats.chi_squared(a, b, n_a, n_b))
    if effect_size:
        table = table.withColumns({
            "log_ratio": stats.log_ratio(a, b, n_a, n_b),
            "percent_diff": stats.percent_diff(a, b, n_a, n_b),
            "bayes_factor": stats.bayes_factor(a, b, n_a, n_b, formula),
        })
    return table


SCORE = {"log_likelihood": "g2"}


def by_strength(table: DataFrame, method: str) -> DataFrame:
    return table.orderBy(F.desc(F.abs(SCORE.get(method, method))), "term")


def keyness(
    a: Corpus,
    b: Corpus,
    method: str = "log_likelihood",
    formula: str = "rayson",
    effect_size: bool = True,
    min_count: int = 5,
    multiple_comparisons: str = "bh",
    stop_words: Iterable[str] | None = None,
    dispersion: bool = False,
    flag_below: float = 0.3,
) -> DataFrame:
    """The two-sided table, strongest first. min_count is on the sum of both counts."""
    require_documents(a, b)
    counts, (n_a, n_b) = with_totals(side_counts(a, b), ("count_a", "count_b"), (a, b))
    counts = counts.filter(F.col("count_a") + F.col("count_b") >= min_count)
    table = statistics(without(counts, stop_words), n_a, n_b, method, formula, effect_size)
    if dispersion:
        for side, name in ((a, "dispersion_a"), (b, "dispersion_b")):
            # a document's length is what it holds of the terms kept
            d = juilland_d(side, table.select("term")).select("term", F.col("juilland_d").alias(name))
            table = table.join(d, "term", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
        table = table.withColumn("dispersion_flag", F.least("dispersion_a", "dispersion_b") < flag_below)
    if multiple_comparisons in CORRECTIONS:
        table = adjusted(table, multiple_comparisons)
    return by_strength(table, method)


def keyness_multi(
    corpora: Sequence[Corpus],
    labels: Sequence[str] | None = None,
    min_count: int = 5,
    multiple_comparisons: str = "bh",
    stop_words: Iterable[str] | None = None,
    with_p: bool = True,
) -> DataFrame:
    """(term, count_<label>..., g2, p_value[, p_adjusted]); unsigned, with one degree of freedom less than corpora."""
    if len(corpora) < 2:
        raise ValueError("at least two corpora are compared")
    labels = list(labels) if labels is not None else ["c" + str(i) for i, _ in enumerate(corpora)]
    if len(labels) != len(corpora) or len(set(labels)) != len(labels):
        raise ValueError("each corpus needs a label of its own")
    if multiple_comparisons not in CORRECTIONS:
        raise ValueError(f"a correction is one of {', '.join(CORRECTIONS)}, not {multiple_comparisons!r}")
    require_documents(*corpora)
    every = None
    for i, c in enumerate(corpora):
        own = c.terms().select("term", F.lit(i).alias("i"))
        every = own if every is None else every.unionByName(own)
    names = [f"count_{x}" for x in labels]
    counts = every.groupBy("term").agg(*[F.sum((F.col("i") == i).cast("long")).alias(n) for i, n in enumerate(names)])
    counts, sizes = with_totals(counts, names, corpora)
    columns = [F.col(f"`{n}`") for n in names]
    counts = without(counts.filter(sum(columns[1:], columns[0]) >= min_count), stop_words)
    table = counts.withColumn("g2", stats.g2_many(columns, sizes))
    if with_p:
        table = adjusted(table.withColumn("p_value", p_value(F.col("g2"), len(corpora) - 1)), multiple_comparisons)
    return table.orderBy(F.desc("g2"), "term")


def against_baseline(
    corpus: Corpus,
    baseline,
    formula: str = "rayson",
    method: str = "log_likelihood",
    min_count: int = 5,
    effect_size: bool = True,
    multiple_comparisons: str = "none",
    stop_words: Iterable[str] | None = None,
    with_p: bool = True,
) -> DataFrame:
    """Keyness against a frequency list; its total includes what the list left out."""
    require_documents(corpus)
    own, (n_a,) = with_totals(corpus.terms().groupBy("term").agg(F.count("*").alias("count_a")), ("count_a",), (corpus,))
    other = baseline.counts.select("term", F.col("count").alias("count_b"))
    both = own.join(other, "term", "full_outer").na.fill(0, ["count_a", "count_b"]).filter(F.col("count_a") + F.col("count_b") >= min_count)
    table = statistics(without(both, stop_words), n_a, baseline.total_tokens, method, formula, effect_size, with_p)
    if with_p:
        table = adjusted(table, multiple_comparisons)
    return by_strength(table, method)


def _cells(corpus: Corpus, kept: DataFrame | None) -> tuple[DataFrame, str]:
    key = corpus.need_id("dispersion")
    cells = corpus.doc_term_counts()
    return (cells.join(kept, "term", "left_semi") if kept is not None else cells), key


def juilland_d(corpus: Corpus, kept: DataFrame | None = None) -> DataFrame:
    """(term, juilland_d): 1 - CV / sqrt(k - 1) of the rates over all k documents, empty ones included."""
    cells, key = _cells(corpus, kept)
    cells = written(cells)
    sizes = written(cells.groupBy(key).agg(F.sum("n").alias("size")))
    k = float(corpus.df.count())
    rates = cells.join(small(sizes), key).select("term", (F.col("n") / F.col("size")).alias("r"))
    sums = rates.groupBy("term").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    mean = F.col("s") / k
    sd = F.sqrt(F.greatest(F.col("q") / k - mean * mean, F.lit(0.0)))
    value = F.when(F.lit(k) <= 1, stats.NAN).when(mean == 0, 0.0).otherwise(1 - sd / F.when(mean == 0, 1.0).otherwise(mean) / max(1.0, k - 1) ** 0.5)
    return sums.select("term", value.alias("juilland_d"))


def dispersion_dp(corpus: Corpus, kept: DataFrame | None = None) -> DataFrame:
    """(term, dp): half the sum of the differences between shares of the term and of the text.

    Documents without the term add their share of the text; that needs no row of theirs.
    """
    cells, key = _cells(corpus, kept)
    cells = written(cells)
    sizes = written(cells.groupBy(key).agg(F.sum("n").alias("size")))
    whole = sizes.agg(F.sum("size").alias("whole"))
    per = written(cells.groupBy("term").agg(F.sum("n").alias("c")))
    rows = cells.join(small(sizes), key).join(small(per), "term").crossJoin(F.broadcast(whole))
    e = F.col("size") / F.col("whole")
    sums = rows.groupBy("term").agg(F.sum(F.abs(F.col("n") / F.col("c") - e)).alias("d"), F.sum(e).alias("e"))
    return sums.select("term", (0.5 * (F.col("d") + 1 - F.col("e"))).alias("dp"))
