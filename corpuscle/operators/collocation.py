"""Collocates, their shift between corpora, and networks of terms that occur together.

Windows are slices of each document's own token array: no join, no shuffle before the counts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import stats
from corpuscle.functions.text import left_of, positions, right_of
from corpuscle.operators.corpus import Corpus
from corpuscle.operators.keyness import without


def occurrences(corpus: Corpus, target: str, *keep: str) -> DataFrame:
    """A row for each occurrence of the target: keep, tokens, at (its position from 1)."""
    lists = corpus.token_lists(*keep).filter(F.array_contains("tokens", target))
    return lists.select(*keep, "tokens", F.explode(positions(F.col("tokens"), target)).alias("at"))


def collocate_counts(corpus: Corpus, target: str, window: int = 5) -> DataFrame:
    """(collocate, count): tokens within the window of an occurrence, each occurrence on its own.

    Only the occurrence itself is left out: another one of the target nearby counts.
    """
    if window < 1:
        raise ValueError("a window has at least one token")
    found = occurrences(corpus, target)
    around = F.concat(left_of(F.col("tokens"), F.col("at"), window), right_of(F.col("tokens"), F.col("at"), window))
    return found.select(F.explode(around).alias("collocate")).groupBy("collocate").agg(F.count("*").alias("count"))


def collocates(corpus: Corpus, target: str, window: int = 5, measure: str = "logDice", min_count: int = 1, smoothing: float = 0.0) -> DataFrame:
    """(collocate, count, f_y, score) of one corpus."""
    counts = collocate_counts(corpus, target, window).filter(F.col("count") >= min_count)
    vocab = corpus.terms().groupBy("term").agg(F.count("*").alias("f_y"))
    n, f_x = corpus.total_tokens(), _frequency(corpus, target)
    both = counts.join(vocab.withColumnRenamed("term", "collocate"), "collocate", "left")
    score = stats.association(measure, F.col("count") + smoothing, F.lit(f_x + smoothing), F.col("f_y") + smoothing, n)
    return both.withColumn("score", score)


def _frequency(corpus: Corpus, term: str) -> int:
    hits = F.size(F.filter("tokens", lambda t: t == term)).cast("long")
    return corpus.token_lists().agg(F.coalesce(F.sum(hits), F.lit(0))).first()[0]


def collocation_shift(
    a: Corpus, b: Corpus, target: str, window: int = 5, measure: str = "logDice", min_count: int = 5, smoothing: float = 0.5
) -> DataFrame:
    """(collocate, count_a, count_b, score_a, score_b, shift), largest shift first.

    The smoothing is added to the pair's and both terms' counts, not to the corpus size.
    """
    if smoothing <= 0:
        raise ValueError("smoothing must be positive")
    if measure not in stats.MEASURES:
        raise ValueError(f"measure is one of {', '.join(stats.MEASURES)}, not {measure!r}")
    if window < 1:
        raise ValueError("a window has at least one token")
    table = None
    for side, name in ((a, "a"), (b, "b")):
        if _frequency(side, target) == 0:
            raise ValueError(f"{target!r} does not occur in {side.label}")
        own = collocate_counts(side, target, window).select("collocate", F.col("count").alias(f"count_{name}"))
        table = own if table is None else table.join(own, "collocate", "full_outer")
    table = table.na.fill(0, ["count_a", "count_b"]).filter(F.col("count_a") + F.col("count_b") >= min_count)
    for side, name in ((a, "a"), (b, "b")):
        vocab = side.terms().groupBy("term").agg(F.count("*").alias(f"f_{name}")).withColumnRenamed("term", "collocate")
        n, f_x = side.total_tokens(), _frequency(side, target)
        table = table.join(vocab, "collocate", "left").na.fill(0, [f"f_{name}"])
        score = stats.association(measure, F.col(f"count_{name}") + smoothing, F.lit(f_x + smoothing), F.col(f"f_{name}") + smoothing, n)
        table = table.withColumn(f"score_{name}", score)
    table = table.select("collocate", "count_a", "count_b", "score_a", "score_b", (F.col("score_a") - F.col("score_b")).alias("shift"))
    return table.orderBy(F.desc(F.abs("shift")), "collocate")


def cooccurrence_network(
    corpus: Corpus,
    top_n: int = 50,
    window: int = 5,
    measure: str = "PMI",
    min_count: int = 3,
    min_cooccur: int = 2,
    smoothing: float = 0.5,
    stop_words: Iterable[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes: term, count, degree; edges: source, target, cooccur_count, weight, rank).

    Each pair of positions at most `window` apart counts once, under source < target; positions are
    those of the whole text. Nodes without an edge stay, with degree 0.
    """
    if top_n < 2:
        raise ValueError("a network has at least two terms")
    if window < 1:
        raise ValueError("a window has at least one token")
    if smoothing <= 0:
        raise ValueError("smoothing must be positive")
    vocab = without(corpus.terms().groupBy("term").agg(F.count("*").alias("count")).filter(F.col("count") >= min_count), stop_words)
    # at most top_n rows
    top = [(r["term"], r["count"]) for r in vocab.orderBy(F.desc("count"), "term").limit(top_n).collect()]
    if len(top) < 2:
        raise ValueError("fewer than two terms are frequent enough")
    spark = corpus.df.sparkSession
    nodes = spark.createDataFrame(top, "term string, count long")
    names = F.array(*[F.lit(t) for t, _ in top])
    placed = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: F.array_contains(names, x["t"]))
    lists = corpus.token_lists().select(placed.alias("p")).filter(F.size("p") > 1)
    # in the shortened list the window's tokens are among the next `window` entries
    pairs = lists.select("p", F.posexplode("p").alias("k", "x")).select("x", F.explode(F.slice("p", F.col("k") + 2, window)).alias("y"))
    near = pairs.filter((F.col("y.i") - F.col("x.i") <= window) & (F.col("x.t") != F.col("y.t")))
    counts = near.groupBy(F.least("x.t", "y.t").alias("source"), F.greatest("x.t", "y.t").alias("target")).agg(F.count("*").alias("cooccur_count"))
    counts = counts.filter(F.col("cooccur_count") >= min_cooccur)
    n = corpus.total_tokens()
    known = F.broadcast(nodes)
    edges = counts.join(known.select(F.col("term").alias("source"), F.col("count").alias("f_s")), "source").join(
        known.select(F.col("term").alias("target"), F.col("count").alias("f_t")), "target"
    )
    score = stats.association(measure, F.col("cooccur_count") + smoothing, F.col("f_s") + smoothing, F.col("f_t") + smoothing, n)
    # at most top_n squared rows
    rank = F.row_number().over(Window.orderBy(F.desc("weight"), "source", "target")) - 1
    edges = edges.select("source", "target", "cooccur_count", score.alias("weight")).withColumn("rank", rank)
    ends = edges.select(F.explode(F.array("source", "target")).alias("term")).groupBy("term").agg(F.count("*").alias("degree"))
    nodes = nodes.join(ends, "term", "left").na.fill(0, ["degree"]).orderBy(F.desc("count"), "term")
    return nodes, edges.orderBy("rank")


def kwic(corpus: Corpus, target: str, window: int = 5, n: int | None = None, label: str | None = None, collocate: str | None = None) -> DataFrame:
    """(corpus, doc_id, position from 0, left, keyword, right), in document order; the first n."""
    if window < 1:
        raise ValueError("a window has at least one token")
    key = corpus.need_id("a concordance")
    found = occurrences(corpus, target, key)
    before, after = left_of(F.col("tokens"), F.col("at"), window), right_of(F.col("tokens"), F.col("at"), window)
    if collocate is not None:
        found = found.filter(F.array_contains(F.concat(before, after), collocate))
    rows = found.select(
        F.lit(label or corpus.label).alias("corpus"), F.col(key).alias("doc_id"), (F.col("at") - 1).alias("position"),
        F.array_join(before, " ").alias("left"), F.lit(target).alias("keyword"), F.array_join(after, " ").alias("right"),
    ).orderBy("doc_id", "position")
    return rows if n is None else rows.limit(n)


def kwic_compare(a: Corpus, b: Corpus, target: str, window: int = 5, n_per_side: int = 5, collocate: str | None = None, labels: tuple[str, str] = ("a", "b")) -> DataFrame:
    """The first lines of both sides, a before b."""
    sides = [kwic(s, target, window, n_per_side, x, collocate) for s, x in zip((a, b), labels)]
    return sides[0].unionByName(sides[1])


def representative_docs(corpus: Corpus, target: str, n: int = 5) -> DataFrame:
    """(doc_id, count, text): the documents with most occurrences; earlier ones first among equals."""
    key = corpus.need_id("representative documents")
    rows = corpus.token_lists(key, corpus.text_col).select(
        F.col(key).alias("doc_id"), F.size(F.filter("tokens", lambda t: t == target)).alias("count"), F.col(corpus.text_col).alias("text")
    )
    return rows.filter(F.col("count") > 0).orderBy(F.desc("count"), "doc_id").limit(n)
