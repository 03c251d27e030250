"""Registered queries: one or more for each operator, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import stats
from corpuscle.operators import collocation, keyness, lexical, matching, resampling, semantic, senses, temporal
from corpuscle.operators.corpus import Corpus, before_after
from corpuscle.plans import oracles, plots
from corpuscle.plans.compare import compare
from corpuscle.sources import baselines, readers, speeches
from corpuscle.streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

tok = oracles.tok


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> Corpus:
    return Corpus(table(spark, d, "documents"), "text", "doc_id")


def turns(spark: SparkSession, d: str) -> Corpus:
    df = table(spark, d, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return Corpus(df, "text", "id")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Sums in another order differ in their last digits; minus zero is zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


def plain(df: DataFrame, *cols: str) -> DataFrame:
    """Dates and times as text, to the second: engines differ in how they hand them over."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd" if kinds[c] == "date" else "yyyy-MM-dd HH:mm:ss") for c in cols})


def rnd(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _xlogy(x: str, y: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0.0 ELSE {x} * ln({y}) END)"


def _g2(a: str = "a", b: str = "b", na: str = "na", nb: str = "nb", dunning: bool = False) -> str:
    e = f"(({a} + {b}) / ({na} + {nb}))"
    s = f"{_xlogy(a, f'{a} / ({na} * {e})')} + {_xlogy(b, f'{b} / ({nb} * {e})')}"
    if dunning:
        c, d = f"({na} - {a})", f"({nb} - {b})"
        f = f"(({c} + {d}) / ({na} + {nb}))"
        s += f" + {_xlogy(c, f'{c} / ({na} * {f})')} + {_xlogy(d, f'{d} / ({nb} * {f})')}"
    return f"(CASE WHEN {a} / {na} >= {b} / {nb} THEN 1 ELSE -1 END * greatest(2 * ({s}), 0.0))"


SIDES = f"""
WITH t AS (SELECT lang, unnest({tok()}) AS term FROM documents WHERE lang IN ('en', 'de')),
n AS (SELECT count(*) FILTER (lang = 'en')::DOUBLE AS na, count(*) FILTER (lang = 'de')::DOUBLE AS nb FROM t),
c AS (SELECT term, count(*) FILTER (lang = 'en') AS count_a, count(*) FILTER (lang = 'de') AS count_b FROM t GROUP BY term
      HAVING count(*) >= 5),
x AS (SELECT c.*, count_a::DOUBLE AS a, count_b::DOUBLE AS b, na, nb FROM c, n)
"""


def en_de(spark: SparkSession, d: str) -> tuple[Corpus, Corpus]:
    c = documents(spark, d)
    return c.slice(lang="en"), c.slice(lang="de")


# tokens and slices


@query("vocab", f"SELECT term, count(*) AS count FROM (SELECT unnest({tok()}) AS term FROM documents) GROUP BY term")
def _(spark, d):
    return documents(spark, d).vocab()


@query("doc_term_counts", f"""
WITH t AS (SELECT doc_id, unnest({tok()}) AS term FROM documents), k AS (SELECT term FROM t GROUP BY term HAVING count(*) >= 50)
SELECT doc_id, term, count(*) AS n FROM t WHERE term IN (SELECT term FROM k) GROUP BY doc_id, term""")
def _(spark, d):
    return documents(spark, d).doc_term_counts(50)


@query("doc_term_sparse", f"""
WITH t AS (SELECT doc_id, unnest({tok()}) AS term FROM documents), k AS (SELECT term FROM t GROUP BY term HAVING count(*) >= 50),
c AS (SELECT term, row_number() OVER (ORDER BY encode(term)) - 1 AS "column" FROM k)
SELECT doc_id, "column", count(*) AS n FROM t JOIN c USING (term) GROUP BY doc_id, "column" """)
def _(spark, d):
    return documents(spark, d).doc_term_counts_sparse(50)[0]


@query("total_tokens", f"SELECT lang, sum(len({tok()}))::BIGINT AS tokens FROM documents GROUP BY lang")
def _(spark, d):
    return documents(spark, d).token_lists("lang").groupBy("lang").agg(F.sum(F.size("tokens").cast("long")).alias("tokens"))


@query("bigrams", f"""
WITH w AS (SELECT {tok()} AS w FROM documents), g AS (SELECT unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]) ELSE [] END) AS term FROM w)
SELECT term, count(*) AS count FROM g GROUP BY term HAVING count(*) >= 5""")
def _(spark, d):
    from corpuscle.functions.text import NgramTokenizer

    return documents(spark, d).with_tokenizer(NgramTokenizer(n=2)).vocab(5)


@query("slice", "SELECT source, count(*) AS docs FROM documents WHERE lang IN ('fr', 'es') AND source IN ('src0', 'src1', 'src2') GROUP BY source")
def _(spark, d):
    return documents(spark, d).slice(lang=["fr", "es"]).slice(source=["src0", "src1", "src2"]).df.groupBy("source").agg(F.count("*").alias("docs"))


@query("stop_words", f"""
SELECT term, count(*) AS count FROM (SELECT unnest({tok()}) AS term FROM documents) WHERE term NOT IN ('the', 'of', 'and', 'de', 'la', 'der') GROUP BY term HAVING count(*) >= 20""")
def _(spark, d):
    return keyness.without(documents(spark, d).vocab(20), ["the", "of", "and", "de", "la", "der"])


@query("from_sql", "SELECT lang, count(*) AS docs FROM documents WHERE n_chars > 1000 GROUP BY lang")
def _(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("documents")
    return readers.from_sql(spark, "SELECT * FROM documents WHERE n_chars > :least", {"least": 1000}).df.groupBy("lang").agg(F.count("*").alias("docs"))


# keyness


@query("keyness_log_likelihood", SIDES + f"""
SELECT term, count_a, count_b, {rnd('na * (a + b) / (na + nb)', 'expected_a')}, {rnd('nb * (a + b) / (na + nb)', 'expected_b')}, {rnd(_g2(), 'g2')},
  {rnd('log2(((a + 0.5) / na) / ((b + 0.5) / nb))', 'log_ratio')},
  CASE WHEN b = 0 THEN NULL ELSE round((a / na - b / nb) / (b / nb) * 100, 6) + 0.0 END AS percent_diff,
  round(least((abs({_g2()}) - ln(na + nb)) / 2, 700), 6) + 0.0 AS log_bayes_factor FROM x""")
def keyness_log_likelihood(spark, d):
    """Infinite changes are null here, and Bayes factors are logarithms (up to 700, beyond which the
    factor itself is no double), so that both engines print them alike."""
    a, b = en_de(spark, d)
    t = keyness.keyness(a, b, multiple_comparisons="none")
    t = t.withColumn("log_bayes_factor", F.when(F.col("bayes_factor") > F.exp(F.lit(700.0)), 700.0).otherwise(F.ln("bayes_factor")))
    t = t.withColumn("percent_diff", F.when(F.col("count_b") == 0, F.lit(None)).otherwise(F.col("percent_diff"))).drop("bayes_factor", "p_value")
    return rounded(t, "expected_a", "expected_b", "g2", "log_ratio", "percent_diff", "log_bayes_factor")


@query("keyness_dunning", SIDES + f"SELECT term, count_a, count_b, {rnd(_g2(dunning=True), 'g2')} FROM x")
def _(spark, d):
    t = keyness.keyness(*en_de(spark, d), formula="dunning", multiple_comparisons="none")
    return rounded(t.select("term", "count_a", "count_b", "g2"), "g2")


@query("keyness_chi_squared", SIDES + f"""
SELECT term, {rnd("CASE WHEN a / na >= b / nb THEN 1 ELSE -1 END * (a * (nb - b) - b * (na - a)) ** 2 * (na + nb) / ((a + b) * (na - a + nb - b) * na * nb)", 'chi_squared', 5)} FROM x""")
def _(spark, d):
    t = keyness.keyness(*en_de(spark, d), method="chi_squared", multiple_comparisons="none")
    return rounded(t.select("term", "chi_squared"), "chi_squared", digits=5)


@query("keyness_p_adjusted", oracles.KEYNESS)
def _(spark, d):
    """Through the public verb, with p-values, their correction and dispersion."""
    t = compare(*en_de(spark, d)).keyness(min_count=20, dispersion=True).table
    t = t.select("term", "count_a", "count_b", "g2", "p_value", "p_adjusted", "dispersion_a", "dispersion_b", "dispersion_flag")
    return rounded(rounded(t, "g2", "dispersion_a", "dispersion_b"), "p_value", "p_adjusted", digits=9)


_MANY = ["de", "en", "es", "fr"]


@query("keyness_multi", f"""
WITH t AS (SELECT lang, unnest({tok()}) AS term FROM documents), n AS (SELECT {', '.join(f"count(*) FILTER (lang = '{x}')::DOUBLE AS n_{x}" for x in _MANY)}, count(*)::DOUBLE AS n FROM t WHERE lang IN ('de', 'en', 'es', 'fr')),
c AS (SELECT term, {', '.join(f"count(*) FILTER (lang = '{x}') AS count_{x}" for x in _MANY)}, count(*)::DOUBLE AS s FROM t WHERE lang IN ('de', 'en', 'es', 'fr') GROUP BY term HAVING count(*) >= 5)
SELECT term, {', '.join(f'count_{x}' for x in _MANY)}, {rnd('greatest(2 * (' + ' + '.join(_xlogy(f'count_{x}::DOUBLE', f'count_{x} * n / (s * n_{x})') for x in _MANY) + '), 0.0)', 'g2')} FROM c, n""")
def _(spark, d):
    c = documents(spark, d)
    t = keyness.keyness_multi([c.slice(lang=x) for x in _MANY], _MANY, with_p=False)
    return rounded(t, "g2")


@query("keyness_baseline", f"""
WITH t AS (SELECT unnest({tok()}) AS term FROM documents WHERE lang = 'en'), u AS (SELECT unnest({tok()}) AS term FROM benchmark),
n AS (SELECT (SELECT count(*) FROM t)::DOUBLE AS na, (SELECT count(*) FROM u)::DOUBLE AS nb),
p AS (SELECT term, count(*) AS count_a FROM t GROUP BY term), q AS (SELECT term, count(*) AS count_b FROM u GROUP BY term HAVING count(*) >= 2),
x AS (SELECT coalesce(p.term, q.term) AS term, coalesce(count_a, 0) AS count_a, coalesce(count_b, 0) AS count_b FROM p FULL JOIN q ON p.term = q.term),
y AS (SELECT *, count_a::DOUBLE AS a, count_b::DOUBLE AS b FROM x, n WHERE count_a + count_b >= 5)
SELECT term, count_a, count_b, {rnd(_g2(), 'g2')} FROM y""")
def _(spark, d):
    base = baselines.baseline_from_corpus(Corpus(table(spark, d, "benchmark"), "text", "item_id"), "benchmark")
    t = keyness.against_baseline(documents(spark, d).slice(lang="en"), base, with_p=False)
    return rounded(t.select("term", "count_a", "count_b", "g2"), "g2")


@query("bh", """
WITH p AS (SELECT doc_id, (n_chars * 7919 + doc_id * 104729) % 1000003 / 1000003.0::DOUBLE AS p_value FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY p_value, doc_id) AS r, count(*) OVER () AS m FROM p)
SELECT doc_id, round(least(min(p_value * m / r) OVER (ORDER BY p_value, doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 9) AS p_adjusted FROM r""")
def _(spark, d):
    p = table(spark, d, "documents").select("doc_id", ((F.col("n_chars") * 7919 + F.col("doc_id") * 104729) % 1000003 / 1000003.0).alias("p_value"))
    return rounded(keyness.adjusted(p, "bh").select("doc_id", "p_adjusted"), "p_adjusted", digits=9)


@query("bonferroni", "SELECT doc_id, round(least((n_chars % 1000) / 1000.0::DOUBLE * count(*) OVER (), 1.0), 9) AS p_adjusted FROM documents")
def _(spark, d):
    p = table(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("p_value"))
    return rounded(keyness.adjusted(p, "bonferroni").select("doc_id", "p_adjusted"), "p_adjusted", digits=9)


_CELLS = f"""
WITH t AS (SELECT doc_id, unnest({tok()}) AS term FROM documents WHERE lang = 'en'), c AS (SELECT doc_id, term, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2),
s AS (SELECT doc_id, sum(n) AS size FROM c GROUP BY 1), k AS (SELECT count(*)::DOUBLE AS k FROM documents WHERE lang = 'en'), w AS (SELECT sum(size) AS w FROM s)
"""


@query("juilland_d", _CELLS + """
, r AS (SELECT term, sum(n / size) AS s, sum((n / size) ** 2) AS q FROM c JOIN s USING (doc_id) GROUP BY term)
SELECT term, round(1 - sqrt(greatest(q / k - (s / k) ** 2, 0.0)) / (s / k) / sqrt(k - 1), 6) + 0.0 AS juilland_d FROM r, k""")
def _(spark, d):
    return rounded(keyness.juilland_d(documents(spark, d).slice(lang="en")), "juilland_d")


@query("dispersion_dp", _CELLS + """
, f AS (SELECT term, sum(n) AS c FROM c GROUP BY term)
SELECT term, round(0.5 * (sum(abs(n / f.c - size / w)) + 1 - sum(size / w)), 6) AS dp FROM c JOIN s USING (doc_id) JOIN f USING (term), w GROUP BY term""")
def _(spark, d):
    return rounded(keyness.dispersion_dp(documents(spark, d).slice(lang="en")), "dp")


@query("permutation_pvalues", oracles.permutation(999, 1, 20))
def _(spark, d):
    c = turns(spark, d)
    a, b = c.slice(role="user"), c.slice(role="assistant")
    terms = keyness.side_counts(a, b).filter("count_a + count_b >= 20")
    return rounded(resampling.permutation_pvalues(a, b, terms, 999, seed=1), "p_permutation", digits=9)


@query("bootstrap_ci", oracles.bootstrap(oracles.EN_DE, "doc_id", 999, 1, 50, True))
def _(spark, d):
    a, b = en_de(spark, d)
    terms = keyness.side_counts(a, b).filter("count_a + count_b >= 50")
    found = resampling.bootstrap_g2_ci(a, b, terms, n_boot=999, simultaneous=True, seed=1)
    return rounded(found, *[c for c in found.columns if c != "term"], digits=5)


@query("bootstrap_ci_cluster", oracles.bootstrap(oracles.TURNS, "conv_id", 999, 1, 20, False))
def _(spark, d):
    c = turns(spark, d)
    a, b = c.slice(role="user"), c.slice(role="assistant")
    terms = keyness.side_counts(a, b).filter("count_a + count_b >= 20")
    found = resampling.bootstrap_g2_ci(a, b, terms, n_boot=999, cluster_col="conv_id", seed=1)
    return rounded(found, "g2_ci_lower", "g2_ci_upper", digits=5)


# collocation


def _around(where: str) -> str:
    return f"""w AS (SELECT doc_id, {tok()} AS w FROM documents WHERE {where}), o AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
h AS (SELECT doc_id, w, i FROM o WHERE w[i] = 'the'), a AS (SELECT unnest(w[greatest(i - 5, 1) : i - 1] || w[i + 1 : i + 5]) AS collocate FROM h)"""


@query("collocate_counts", f"WITH {_around('true')} SELECT collocate, count(*) AS count FROM a GROUP BY collocate")
def _(spark, d):
    return collocation.collocate_counts(documents(spark, d), "the")


@query("collocation_measures", f"""
WITH {_around("lang = 'en'")}, v AS (SELECT w[i] AS term, count(*)::DOUBLE AS fy FROM o GROUP BY 1), n AS (SELECT sum(fy) AS n, max(CASE WHEN term = 'the' THEN fy END) AS fx FROM v),
c AS (SELECT collocate, count(*)::DOUBLE AS f FROM a GROUP BY 1 HAVING count(*) >= 5)
SELECT collocate, {rnd('14 + log2(2 * f / (fx + fy))', 'log_dice')}, {rnd('log2(f * n / (fx * fy))', 'pmi')}, {rnd('(f - fx * fy / n) / sqrt(f)', 't_score')}, {rnd('log2(f * f * f * n / (fx * fy))', 'mi3')}
FROM c JOIN v ON v.term = c.collocate, n""")
def _(spark, d):
    c = documents(spark, d).slice(lang="en")
    found = [
        collocation.collocates(c, "the", measure=m, min_count=5).select("collocate", F.col("score").alias(n))
        for m, n in (("logDice", "log_dice"), ("PMI", "pmi"), ("t-score", "t_score"), ("MI3", "mi3"))
    ]
    return rounded(reduce(lambda x, y: x.join(y, "collocate"), found), "log_dice", "pmi", "t_score", "mi3")


def _shift_side(name: str, where: str) -> str:
    return f"""w{name} AS (SELECT {tok()} AS w FROM documents WHERE {where}), o{name} AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w{name}),
k{name} AS (SELECT collocate, count(*) AS c FROM (SELECT unnest(w[greatest(i - 5, 1) : i - 1] || w[i + 1 : i + 5]) AS collocate FROM o{name} WHERE w[i] = 'the') GROUP BY 1),
v{name} AS (SELECT w[i] AS term, count(*) AS f FROM o{name} GROUP BY 1), x{name} AS (SELECT max(CASE WHEN term = 'the' THEN f END) AS fx FROM v{name})"""


@query("collocation_shift", f"""
WITH {_shift_side('a', "lang = 'en' AND source = 'src0'")}, {_shift_side('b', "lang = 'en' AND source <> 'src0'")},
j AS (SELECT coalesce(ka.collocate, kb.collocate) AS collocate, coalesce(ka.c, 0) AS count_a, coalesce(kb.c, 0) AS count_b FROM ka FULL JOIN kb ON ka.collocate = kb.collocate),
s AS (SELECT j.*, 14 + log2(2 * (count_a + 0.5) / (xa.fx + 0.5 + coalesce(va.f, 0) + 0.5)) AS sa, 14 + log2(2 * (count_b + 0.5) / (xb.fx + 0.5 + coalesce(vb.f, 0) + 0.5)) AS sb
 FROM j LEFT JOIN va ON va.term = collocate LEFT JOIN vb ON vb.term = collocate, xa, xb WHERE count_a + count_b >= 5)
SELECT collocate, count_a, count_b, {rnd('sa', 'score_a')}, {rnd('sb', 'score_b')}, {rnd('sa - sb', 'shift')} FROM s""")
def _(spark, d):
    c = documents(spark, d).slice(lang="en")
    t = collocation.collocation_shift(c.slice(source="src0"), c.where("source <> 'src0'"), "the")
    return rounded(t, "score_a", "score_b", "shift")


_NETWORK = f"""
WITH w AS (SELECT doc_id, {tok()} AS w FROM documents WHERE lang = 'en'), o AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), t AS (SELECT doc_id, i, w[i] AS term FROM o),
v AS (SELECT term, count(*) AS count FROM t GROUP BY 1 HAVING count(*) >= 3 ORDER BY count DESC, encode(term) LIMIT 30), n AS (SELECT count(*)::DOUBLE AS n FROM t),
k AS (SELECT * FROM t WHERE term IN (SELECT term FROM v)),
p AS (SELECT least(x.term, y.term) AS source, greatest(x.term, y.term) AS target, count(*) AS c FROM k x JOIN k y ON x.doc_id = y.doc_id AND y.i > x.i AND y.i - x.i <= 5 WHERE x.term <> y.term GROUP BY 1, 2 HAVING count(*) >= 2),
e AS (SELECT source, target, c AS cooccur_count, log2((c + 0.5) * n / ((a.count + 0.5) * (b.count + 0.5))) AS weight FROM p JOIN v a ON a.term = source JOIN v b ON b.term = target, n)
"""


@query("network_edges", _NETWORK + f"SELECT source, target, cooccur_count, {rnd('weight', 'weight')} FROM e")
def _(spark, d):
    edges = collocation.cooccurrence_network(documents(spark, d).slice(lang="en"), top_n=30)[1]
    return rounded(edges.drop("rank"), "weight")


@query("network_nodes", _NETWORK + """
SELECT v.term, v.count, count(e.source) AS degree FROM v LEFT JOIN e ON e.source = v.term OR e.target = v.term GROUP BY 1, 2""")
def _(spark, d):
    return collocation.cooccurrence_network(documents(spark, d).slice(lang="en"), top_n=30)[0]


@query("kwic", f"""
WITH w AS (SELECT doc_id, {tok()} AS w FROM documents), o AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)
SELECT 'all' AS corpus, doc_id, i - 1 AS position, array_to_string(w[greatest(i - 5, 1) : i - 1], ' ') AS "left", w[i] AS keyword, array_to_string(w[i + 1 : i + 5], ' ') AS "right" FROM o WHERE w[i] = 'with'""")
def _(spark, d):
    return collocation.kwic(documents(spark, d), "with", label="all")


@query("kwic_compare", f"""
WITH w AS (SELECT doc_id, source, {tok()} AS w FROM documents WHERE lang = 'en'), o AS (SELECT doc_id, source = 'src0' AS a, w, unnest(range(1, len(w) + 1)) AS i FROM w),
h AS (SELECT CASE WHEN a THEN 'a' ELSE 'b' END AS corpus, doc_id, i - 1 AS position, w[greatest(i - 5, 1) : i - 1] AS l, w[i + 1 : i + 5] AS r FROM o WHERE w[i] = 'the'),
q AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY doc_id, position) AS k FROM h WHERE list_contains(l || r, 'of'))
SELECT corpus, doc_id, position, array_to_string(l, ' ') AS "left", 'the' AS keyword, array_to_string(r, ' ') AS "right" FROM q WHERE k <= 5""")
def _(spark, d):
    c = documents(spark, d).slice(lang="en")
    return collocation.kwic_compare(c.slice(source="src0"), c.where("source <> 'src0'"), "the", collocate="of")


@query("representative_docs", f"""
SELECT doc_id, len(list_filter({tok()}, lambda t: t = 'the')) AS count, text FROM documents WHERE list_contains({tok()}, 'the') ORDER BY count DESC, doc_id LIMIT 5""")
def _(spark, d):
    return collocation.representative_docs(documents(spark, d), "the")


# diversity


@query("ttr_mattr_hdd", f"""
WITH w AS (SELECT lang, doc_id, {tok()} AS w FROM documents), o AS (SELECT lang, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
p AS (SELECT lang, w[i] AS term, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1 AS pos FROM o),
n AS (SELECT lang, count(*) AS n, count(DISTINCT term) AS t FROM p GROUP BY 1),
q AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY lang, term ORDER BY pos), -1) AS prev FROM p),
m AS (SELECT lang, sum(greatest(least(pos, n - 100) - greatest(pos - 99, prev + 1, 0) + 1, 0))::DOUBLE / (100 * (max(n) - 99)) AS mattr FROM q JOIN n USING (lang) GROUP BY 1),
c AS (SELECT lang, term, count(*) AS c FROM p GROUP BY 1, 2), g AS (SELECT lang, c, count(*) AS k FROM c GROUP BY 1, 2),
h AS (SELECT lang, sum(k * (1 - list_reduce(list_transform(range(0, 42), lambda j: greatest((n - c - j)::DOUBLE, 0) / (n - j)), lambda x, y: x * y))) AS hdd FROM g JOIN n USING (lang) GROUP BY 1)
SELECT lang, n AS n_tokens, t AS n_types, round(t / n::DOUBLE, 6) AS ttr, round(mattr, 6) AS mattr, round(hdd, 6) AS hdd FROM n JOIN m USING (lang) JOIN h USING (lang)""")
def _(spark, d):
    from corpuscle.plans.storage import written

    s = written(lexical.stream(documents(spark, d), "lang"))
    t = lexical.pooled(s, ("ttr", "mattr", "hdd")).withColumnRenamed("grp", "lang")
    return rounded(t, "ttr", "mattr", "hdd")


def known(df: DataFrame, *cols: str) -> DataFrame:
    """NaN is null, which both engines print alike."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


@query("mtld", f"""WITH g AS (SELECT lang, flatten(list({tok()} ORDER BY doc_id)) AS w FROM documents GROUP BY lang)
SELECT lang, round({oracles.mtld('w')}, 6) AS mtld FROM g""")
def _(spark, d):
    from corpuscle.plans.storage import written

    t = lexical.pooled_mtld(written(lexical.stream(documents(spark, d), "lang"))).withColumnRenamed("grp", "lang")
    return rounded(known(t, "mtld"), "mtld")


@query("lexical_per_doc", "WITH " + oracles.diversity(f"SELECT doc_id, {tok()} AS w FROM documents WHERE len({tok()}) > 0", "doc_id") + """
SELECT doc_id, n AS n_tokens, round(ttr, 6) AS ttr, round(mattr, 6) AS mattr, round(mtld, 6) AS mtld, round(hdd, 6) AS hdd FROM d""")
def _(spark, d):
    t = lexical.lexical_diversity(documents(spark, d), per_doc=True)
    return rounded(known(t, "mtld"), "ttr", "mattr", "mtld", "hdd")


@query("hill_numbers", f"""
WITH c AS (SELECT term, count(*)::DOUBLE AS c FROM (SELECT unnest({tok()}) AS term FROM documents) GROUP BY 1), p AS (SELECT c / sum(c) OVER () AS p FROM c)
SELECT 0.0::DOUBLE AS q, round(count(*)::DOUBLE, 4) AS hill FROM p UNION ALL SELECT 1.0, round(exp(-sum(p * ln(p))), 4) FROM p UNION ALL SELECT 2.0, round(1 / sum(p * p), 4) FROM p""")
def _(spark, d):
    return rounded(lexical.hill_numbers(documents(spark, d)), "hill", digits=4)


@query("rarefaction", f"""
WITH c AS (SELECT count(*)::DOUBLE AS c FROM (SELECT unnest({tok()}) AS term FROM documents) GROUP BY term), n AS (SELECT sum(c) AS n FROM c), h AS (SELECT c, count(*) AS k FROM c GROUP BY c)
SELECT 1000 AS sample, round(sum(k * (1 - CASE WHEN n - c < 1000 THEN 0 ELSE exp(lgamma(n - c + 1) - lgamma(n - c - 999) - lgamma(n + 1) + lgamma(n - 999)) END)), 2) AS types FROM h, n""")
def _(spark, d):
    return spark.createDataFrame([(1000, round(lexical.rarefaction(documents(spark, d), 1000), 2))], "sample int, types double")


# matching


def _matched(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    c = Corpus(df, "text", "doc_id")
    return matching.match(c.slice(quality=0), c.slice(quality=1), ["lang", "n_chars"], {"n_chars": [0, 500, 1000, 2000, 5000, 1_000_000]})


_BINS = """CASE WHEN n_chars <= 500 THEN '0' WHEN n_chars <= 1000 THEN '1' WHEN n_chars <= 2000 THEN '2' WHEN n_chars <= 5000 THEN '3' ELSE '4' END"""
_STRATA = f"""WITH j AS (SELECT quality, lang || '|' || {_BINS} AS stratum, {_BINS} AS b, lang FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"""


@query("cem_strata", _STRATA + """, s AS (SELECT stratum, count(*) FILTER (quality = 0) AS n_a_pre, count(*) FILTER (quality = 1) AS n_b_pre FROM j GROUP BY 1)
SELECT stratum, n_a_pre, n_b_pre, 2 * least(n_a_pre, n_b_pre) AS n_kept, least(n_a_pre, n_b_pre) > 0 AS matched FROM s""")
def _(spark, d):
    return _matched(spark, d).strata


_KEPT = f"""SELECT quality, stratum, b, lang FROM (SELECT quality, lang || '|' || {_BINS} AS stratum, {_BINS} AS b, lang,
  row_number() OVER (PARTITION BY quality, lang || '|' || {_BINS} ORDER BY md5('0:' || doc_id), doc_id) AS r FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1))
JOIN (SELECT stratum, least(count(*) FILTER (quality = 0), count(*) FILTER (quality = 1)) AS k FROM j GROUP BY 1) USING (stratum) WHERE r <= k"""


def _l1(covariate: str, col: str) -> str:
    one = lambda rows, out: f"""(SELECT round(sum(abs(qa / na - qb / nb)) / 2, 6) + 0.0 AS {out} FROM (SELECT {col}, count(*) FILTER (quality = 0)::DOUBLE AS qa, count(*) FILTER (quality = 1)::DOUBLE AS qb FROM {rows} GROUP BY 1),
(SELECT count(*) FILTER (quality = 0)::DOUBLE AS na, count(*) FILTER (quality = 1)::DOUBLE AS nb FROM {rows}))"""  # noqa: E731
    return f"SELECT '{covariate}' AS covariate, l1_pre, l1_post FROM {one('j', 'l1_pre')}, {one('kept', 'l1_post')}"


@query("cem_imbalance", _STRATA + f", kept AS ({_KEPT}) " + " UNION ALL ".join(_l1(*x) for x in (("lang", "lang"), ("n_chars", "b"), ("(joint)", "stratum"))))
def _(spark, d):
    return rounded(_matched(spark, d).imbalance, "l1_pre", "l1_post")


@query("cem_matched", f"""
WITH j AS (SELECT doc_id, quality, lang || '|' || {_BINS} AS stratum FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
k AS (SELECT stratum, least(count(*) FILTER (quality = 0), count(*) FILTER (quality = 1)) AS k FROM j GROUP BY 1),
r AS (SELECT doc_id, quality, k, row_number() OVER (PARTITION BY quality, stratum ORDER BY md5('0:' || doc_id), doc_id) AS r FROM j JOIN k USING (stratum))
SELECT doc_id, quality FROM r WHERE r <= k""")
def _(spark, d):
    m = _matched(spark, d)
    return m.a.df.select("doc_id", "quality").unionByName(m.b.df.select("doc_id", "quality"))


# time


def dated(spark: SparkSession, d: str) -> Corpus:
    """Names of parts, dated by their shipping."""
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_shipdate").alias("date"), "l_orderkey", "l_linenumber")
    df = lines.join(F.broadcast(parts), "p_partkey").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return Corpus(df, "p_name", "id")


_DATED = f"WITH w AS (SELECT date_trunc('month', l_shipdate)::DATE AS period, l_shipdate AS date, {tok('p_name')} AS w FROM lineitem JOIN part ON p_partkey = l_partkey)"
_Z = 1.959963984540054


def _wilson(sign: str, x: str = "count", n: str = "total") -> str:
    p, z2 = f"({x} / {n}::DOUBLE)", _Z * _Z
    return f"least(greatest(({p} + {z2} / (2 * {n}) {sign} {_Z} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n}))) / (1 + {z2} / {n}), 0.0), 1.0)"


@query("over_time", _DATED + f""", s AS (SELECT period, sum(len(w))::BIGINT AS total, sum(len(list_filter(w, lambda t: t = 'red')))::BIGINT AS red, sum(len(list_filter(w, lambda t: t = 'widget')))::BIGINT AS widget FROM w GROUP BY 1),
u AS (SELECT period, total, 'red' AS term, red AS count FROM s UNION ALL SELECT period, total, 'widget', widget FROM s)
SELECT period::VARCHAR AS period, strftime(period, '%Y-%m') AS period_label, term, count, total, {rnd('count / total::DOUBLE', 'relfreq')}, {rnd(_wilson('-'), 'ci_lower')}, {rnd(_wilson('+'), 'ci_upper')} FROM u""")
def _(spark, d):
    t = temporal.track(dated(spark, d), ["red", "widget"]).over_time("M").table
    return rounded(plain(t, "period"), "relfreq", "ci_lower", "ci_upper")


@query("events_over_time", f"""
WITH c AS (SELECT date_trunc('day', ts)::DATE AS period, event_type AS term, count(*) AS count FROM events GROUP BY 1, 2), t AS (SELECT *, sum(count) OVER (PARTITION BY period)::BIGINT AS total FROM c)
SELECT period::VARCHAR AS period, strftime(period, '%Y-%m-%d') AS period_label, term, count, total, {rnd('count / total::DOUBLE', 'relfreq')}, {rnd(_wilson('-'), 'ci_lower')}, {rnd(_wilson('+'), 'ci_upper')} FROM t""")
def _(spark, d):
    return rounded(plain(temporal.event_trajectory(table(spark, d, "events"), "ts", "event_type"), "period"), "relfreq", "ci_lower", "ci_upper")


@query("before_after", _DATED + """SELECT CASE WHEN date < TIMESTAMP '1998-07-01' THEN 'before' ELSE 'after' END AS side, count(*) AS docs FROM w GROUP BY 1""")
def _(spark, d):
    a, b = before_after(dated(spark, d), "1998-07-01")
    one = lambda c, n: c.df.agg(F.count("*").alias("docs")).select(F.lit(n).alias("side"), "docs")
    return one(a, "before").unionByName(one(b, "after"))


@query("periods", "SELECT DISTINCT date_trunc('quarter', l_shipdate)::DATE::VARCHAR AS period, year(l_shipdate) || 'Q' || quarter(l_shipdate) AS period_label FROM lineitem")
def _(spark, d):
    return dated(spark, d).by_time("date", "Q").docs.select(F.col("period").cast("string"), "period_label").distinct()


def planted(spark: SparkSession, d: str) -> Corpus:
    """The same with a word that is frequent between two known dates."""
    c = dated(spark, d)
    n = F.col("l_orderkey") + F.col("l_linenumber")
    inside = (F.col("date") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("date") < F.lit("1999-03-01").cast("timestamp"))
    extra = F.when(inside & (n % 3 == 0), " surge surge").when(n % 11 == 0, " surge").otherwise("")
    return Corpus(c.df.withColumn("p_name", F.concat("p_name", extra)), "p_name", "id")


def _trajectory(spark, d):
    return temporal.track(planted(spark, d), list(oracles.TERMS)).over_time("M")


@query("changepoints", oracles.changepoints())
def _(spark, d):
    return _trajectory(spark, d).changepoints().withColumn("period", F.col("period").cast("string"))


@query("changepoints_online", oracles.bocpd())
def _(spark, d):
    t = _trajectory(spark, d).changepoints_online().withColumn("period", F.col("period").cast("string"))
    return rounded(rounded(t, "value", digits=9), "cp_probability", "cp_recent")


@query("burstiness", oracles.burstiness())
def _(spark, d):
    return _trajectory(spark, d).burstiness().withColumn("period", F.col("period").cast("string"))


@query("bursts", oracles.bursts())
def _(spark, d):
    t = _trajectory(spark, d).bursts(s=1.1, gamma=0.1)
    return rounded(t.withColumns({c: F.col(c).cast("string") for c in ("start", "end")}), "mean_relfreq", digits=9)


@query("interrupted_time_series", oracles.interrupted("1998-07-01"))
def _(spark, d):
    t = _trajectory(spark, d).interrupted_time_series("1998-07-01")
    return rounded(rounded(rounded(t, "coef", "std_err", "ci_lower", "ci_upper", digits=8), "t", digits=5), "p_value")


for _name, _run in {
    "causal_impact": lambda t: t.causal_impact("1998-07-01"),
    "causal_metrics": lambda t: t.causal_metrics("1998-07-01"),
    "forecast": lambda t: t.forecast(horizon=6),
    "forecast_combined": lambda t: t.to_combined(horizon=6),
}.items():
    QUERIES[_name] = lambda spark, d, run=_run: run(_trajectory(spark, d))


@query("lexical_trajectory", "WITH " + oracles.diversity(
    f"SELECT date_trunc('year', l_shipdate)::DATE AS period, flatten(list({tok('p_name')} ORDER BY l_orderkey * 10 + l_linenumber, p_name)) AS w FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1", "period"
) + """, r AS (SELECT period, n, t, unnest(['ttr', 'mattr', 'mtld', 'hdd']) AS metric, unnest([ttr, mattr, mtld, hdd]) AS value FROM d)
SELECT period::VARCHAR AS period, strftime(period, '%Y') AS period_label, metric, round(value, 6) AS value, n AS n_tokens, t AS n_types FROM r""")
def _(spark, d):
    t = lexical.lexical_diversity(dated(spark, d), freq="Y")
    return rounded(known(t.withColumn("period", F.col("period").cast("string")), "value"), "value")


@query("lexical_intervals")
def _(spark, d):
    """Documents of a year drawn again, 199 times."""
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("text")) if "o_orderpriority" in table(spark, d, "orders").columns else None
    c = Corpus(df, "text", "o_orderkey") if df is not None else dated(spark, d)
    return lexical.lexical_diversity(c, freq="Y", metrics=("ttr",), ci=True)


@query("forecast_semantic_drift")
def _(spark, d):
    t = semantic.semantic_trajectory(dated(spark, d), ["red"], freq="Q", embedder=semantic.LetterEmbedder())
    return temporal.forecast_semantic_drift(t, "Q")


# embeddings


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Ten periods of neighbouring ids; the label stands for a text."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), "embedding", "label", F.pmod("vec_id", F.lit(10)).cast("int").alias("period"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("text"))


_COS = "list_cosine_similarity(list_transform({0}, lambda v: v::DOUBLE), list_transform({1}, lambda v: v::DOUBLE))"


@query("cosine_similarity", f"""
SELECT a.vec_id AS vec_id, {rnd(_COS.format('a.embedding', 'b.embedding'), 'cosine')} FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return rounded(both.select("vec_id", stats.cosine(F.col("embedding"), F.col("other")).alias("cosine")), "cosine")


@query("knn_novelty", f"""
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 10 >= 3), r AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 10 < 3),
s AS (SELECT q.vec_id AS id, {_COS.format('q.embedding', 'r.embedding')} AS s FROM q, r), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS k FROM s)
SELECT id, round(1 - avg(s), 6) AS novelty FROM k WHERE k <= 10 GROUP BY id""")
def _(spark, d):
    v = vectors(spark, d).select(F.col("doc_id").alias("id"), "period", senses.unit(F.col("embedding")).alias("x"))
    return rounded(senses.knn_novelty(v.filter("period >= 3"), v.filter("period < 3"), 10), "novelty")


def _density(cumulative: bool) -> str:
    """Novelty by the ten nearest of the reference, or of all earlier periods; the cutoff from the reference within itself."""
    near = lambda name, pairs: f"{name} AS (SELECT id, 1 - avg(s) AS nov FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS k FROM ({pairs})) WHERE k <= 10 GROUP BY id)"
    pair = lambda where: f"SELECT q.vec_id AS id, {_COS.format('q.embedding', 'r.embedding')} AS s FROM embeddings q, embeddings r WHERE q.vec_id <> r.vec_id AND {where}"
    ref = lambda x: f"{x}.vec_id % 10 < 3"
    own = "SELECT vec_id AS id, coalesce(nov, 0.0) AS nov FROM embeddings LEFT JOIN b ON b.id = vec_id" if cumulative else "SELECT * FROM a UNION ALL SELECT * FROM b"
    other = "r.vec_id % 10 < q.vec_id % 10" if cumulative else f"NOT {ref('q')} AND {ref('r')}"
    return f"""WITH {near('a', pair(ref('q') + ' AND ' + ref('r')))}, {near('b', pair(other))}, o AS ({own}), cut AS (SELECT quantile_cont(nov, 0.95) AS cut FROM a),
p AS (SELECT id % 10 AS period, count(*) AS n, avg((nov > cut)::INT) AS d FROM o, cut GROUP BY 1), lim AS (SELECT avg(d) + 3 * stddev_samp(d) AS lim FROM p WHERE period < 3),
f AS (SELECT *, period >= 3 AND d > lim AS raw FROM p, lim)
SELECT period::BIGINT AS period, n, round(d, 6) AS novelty_density, raw AND (coalesce(lag(raw) OVER (ORDER BY period), false) OR coalesce(lead(raw) OVER (ORDER BY period), false)) AS drift FROM f"""


@query("knn_density_drift", _density(False))
def _(spark, d):
    return rounded(spark.createDataFrame(senses.knn_density_drift(vectors(spark, d), "period", [0, 1, 2]).table), "novelty_density")


@query("knn_density_cumulative", _density(True))
def _(spark, d):
    return rounded(spark.createDataFrame(senses.knn_density_drift(vectors(spark, d), "period", [0, 1, 2], mode="cumulative").table), "novelty_density")


@query("knn_density_permuted")
def _(spark, d):
    r = senses.knn_density_drift(vectors(spark, d), "period", [0, 1, 2], n_permutations=9)
    return spark.createDataFrame([(float(r.threshold), float(r.p_value))], "threshold double, p_value double")


@query("knn_novelty_indexed")
def _(spark, d):
    v = vectors(spark, d).select(F.col("doc_id").alias("id"), "period", senses.unit(F.col("embedding")).alias("x"))
    prior = v.filter("period < 3")
    return senses.knn_novelty(v.filter("period >= 3"), prior, 10, index=senses.knn_index(prior))


@query("leakage_audit", """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), c AS (SELECT label AS other, i, avg(x) AS c FROM e GROUP BY 1, 2),
d AS (SELECT vec_id, label, other, sqrt(sum((x - c) ** 2)) AS d FROM e JOIN c USING (i) GROUP BY 1, 2, 3),
m AS (SELECT vec_id, label, min(d) FILTER (label = other) AS own, min(d) FILTER (label <> other) AS rival, arg_min(other, d) FILTER (label <> other) AS other FROM d GROUP BY 1, 2)
SELECT vec_id AS doc_id, label AS reference_sense, other AS nearest_other_sense, round(own - rival, 6) AS margin FROM m WHERE own > rival""")
def _(spark, d):
    return rounded(senses.leakage_audit(vectors(spark, d), "label", k=None), "margin")


@query("agreement", """
WITH c AS (SELECT label AS a, vec_id % 7 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS nl FROM c),
a AS (SELECT sum(n * (n - 1) / 2) AS a2, sum(n * ln(n)) AS al FROM (SELECT sum(n) AS n FROM c GROUP BY a)), b AS (SELECT sum(n * (n - 1) / 2) AS b2, sum(n * ln(n)) AS bl FROM (SELECT sum(n) AS n FROM c GROUP BY b)),
r AS (SELECT (p - a2 * b2 / (t * (t - 1) / 2)) / ((a2 + b2) / 2 - a2 * b2 / (t * (t - 1) / 2)) AS ari, 1 - ((al - nl) / t) / (ln(t) - bl / t) AS h, 1 - ((bl - nl) / t) / (ln(t) - al / t) AS c FROM t, a, b)
SELECT round(ari, 6) + 0.0 AS ari, round(h, 6) + 0.0 AS homogeneity, round(c, 6) + 0.0 AS completeness, round(2 * h * c / (h + c), 6) + 0.0 AS v_measure FROM r""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("b"))
    return rounded(senses.agreement_table(e, "label", "b"), "ari", "homogeneity", "completeness", "v_measure")


@query("induce_senses")
def _(spark, d):
    return senses.induce_senses(vectors(spark, d), k=4, text_col="text").clusters


@query("induce_senses_merged")
def _(spark, d):
    return senses.induce_senses(vectors(spark, d), k=4, method="agglomerative").clusters


@query("sense_drift")
def _(spark, d):
    return spark.createDataFrame(senses.sense_drift(vectors(spark, d), "period", [0, 1, 2]).table)


@query("sense_drift_permuted")
def _(spark, d):
    r = senses.sense_drift(vectors(spark, d), "period", [0, 1, 2], n_permutations=9)
    return spark.createDataFrame([(float(r.threshold), float(r.p_value))], "threshold double, p_value double")


def labelled(spark: SparkSession, d: str) -> senses.SenseResult:
    """Senses as if the labels were clusters, dated by their ids."""
    df = vectors(spark, d).withColumn("sense", F.col("label").cast("int")).withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int") * 3))
    return senses.SenseResult(df, df.groupBy("sense").count(), np.zeros((10, 1)), 10, "doc_id")


@query("share_over_time", """
WITH c AS (SELECT date_trunc('year', DATE '2020-01-01' + (vec_id * 3)::INT)::DATE AS period, label AS sense, count(*) AS count FROM embeddings GROUP BY 1, 2)
SELECT period::VARCHAR AS period, strftime(period, '%Y') AS period_label, sense::INT AS sense, count, round(count / sum(count) OVER (PARTITION BY period)::DOUBLE, 9) AS share FROM c""")
def _(spark, d):
    t = labelled(spark, d).share_over_time("date")
    return rounded(t.withColumn("period", F.col("period").cast("string")), "share", digits=9)


@query("contingency", "SELECT (vec_id % 4)::INT AS quarter, " + ", ".join(f'count(*) FILTER (label = {i}) AS "{i}"' for i in range(10)) + " FROM embeddings GROUP BY 1")
def _(spark, d):
    r = labelled(spark, d)
    df = r.assignments.withColumn("quarter", (F.col("doc_id") % 4).cast("int"))
    return senses.SenseResult(df, r.clusters, r.centroids, r.k, "doc_id").contingency("quarter")


def judged(spark: SparkSession, d: str) -> senses.DriftResult:
    """Drift as if the labels were the nearest senses, and each seventh row were novel."""
    df = vectors(spark, d).withColumn("nearest_sense", F.col("label").cast("int")).withColumn("novelty", F.pmod(F.col("doc_id") * 37, F.lit(101)) / 101.0).withColumn("novel", F.col("doc_id") % 7 == 0)
    # some senses fade, one rises
    df = df.filter((F.col("label") % 3 != 0) | (F.col("period") < 5) | (F.col("doc_id") % 4 == 0)).filter((F.col("label") != 1) | (F.col("period") > 4) | (F.col("doc_id") % 3 == 0))
    return senses.DriftResult(pd.DataFrame(), df, (0, 1, 2), 10, 0.0, None, None)


_JUDGED = """WITH r AS (SELECT vec_id, label::INT AS nearest, (vec_id % 10)::INT AS period, vec_id % 7 = 0 AS novel, (vec_id * 37) % 101 / 101.0::DOUBLE AS novelty FROM embeddings
  WHERE (label % 3 <> 0 OR vec_id % 10 < 5 OR vec_id % 4 = 0) AND (label <> 1 OR vec_id % 10 > 4 OR vec_id % 3 = 0))"""
_SENSES = """, f AS (SELECT period, s AS sense, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT period FROM r), (SELECT unnest(range(10))::INT AS s)) LEFT JOIN (SELECT period, nearest AS s, count(*) AS n FROM r GROUP BY ALL) USING (period, s)),
h AS (SELECT *, n / sum(n) OVER (PARTITION BY period)::DOUBLE AS share FROM f)"""


@query("composition", _JUDGED + """, c AS (SELECT period, CASE WHEN novel THEN -1 ELSE nearest END AS sense, count(*) AS n FROM r GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY period)::DOUBLE, 9) AS share FROM c""")
def _(spark, d):
    return rounded(judged(spark, d).composition(), "share", digits=9)


@query("sense_trajectories", _JUDGED + _SENSES + " SELECT period, sense, n, round(share, 9) AS share FROM h")
def _(spark, d):
    return rounded(judged(spark, d).sense_trajectories(), "share", digits=9)


@query("decline_report", _JUDGED + _SENSES + """
, a AS (SELECT sense, avg(share) FILTER (period < 3) AS early_share, avg(share) FILTER (period > 6) AS late_share, avg(n) FILTER (period < 3) AS early_count, avg(n) FILTER (period > 6) AS late_count FROM h GROUP BY sense),
c AS (SELECT *, CASE WHEN early_share > 0 THEN (late_share - early_share) / early_share ELSE 0 END AS rel FROM a)
SELECT sense, round(early_share, 9) AS early_share, round(late_share, 9) AS late_share, round(early_count, 6) AS early_count, round(late_count, 6) AS late_count, round(rel, 6) + 0.0 AS rel_share_change,
  CASE WHEN early_share < 0.05 THEN 'minor' WHEN rel <= -0.3 THEN CASE WHEN late_count < early_count * 0.7 THEN 'obsolescence' ELSE 'dilution' END WHEN rel >= 0.3 THEN 'rising' ELSE 'stable' END AS verdict FROM c""")
def _(spark, d):
    t = judged(spark, d).decline_report()
    return rounded(rounded(t, "early_share", "late_share", digits=9), "early_count", "late_count", "rel_share_change")


@query("flagged_records", _JUDGED + " SELECT vec_id AS doc_id, period, round(novelty, 9) AS novelty FROM r WHERE novel")
def _(spark, d):
    return rounded(judged(spark, d).flagged_records().select("doc_id", "period", "novelty"), "novelty", digits=9)


_WORDS = f"SELECT lang, source, {tok()} AS w FROM documents"


@query("semantic_shift", f"""
WITH x AS ({oracles.contexts(f"SELECT lang, {tok()} AS w FROM documents WHERE lang IN ('en', 'de')", "w[i] IN ('in', 'die', 'the')", "lang")}), c AS ({oracles.centroids("SELECT * FROM x", "lang, target")}),
t AS (SELECT unnest(['in', 'die', 'the']) AS target), j AS (SELECT target, a.c AS ca, b.c AS cb, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM t LEFT JOIN (SELECT * FROM c WHERE lang = 'en') a USING (target) LEFT JOIN (SELECT * FROM c WHERE lang = 'de') b USING (target))
SELECT target, round({oracles.COS.format('ca', 'cb')}, 6) AS cosine_similarity, round(1 - {oracles.COS.format('ca', 'cb')}, 6) + 0.0 AS cosine_distance, na AS n_contexts_a, nb AS n_contexts_b FROM j""")
def _(spark, d):
    t = semantic.semantic_shift(*en_de(spark, d), ["in", "die", "the"], semantic.LetterEmbedder())
    return rounded(known(t, "cosine_similarity", "cosine_distance"), "cosine_similarity", "cosine_distance")


@query("semantic_shift_aligned")
def _(spark, d):
    """With the rotation of one side to the other, on hashed vectors."""
    return semantic.semantic_shift(*en_de(spark, d), ["in", "die", "the"], align="procrustes")


def _near(side: str, where: str) -> str:
    rows = f"SELECT {tok()} AS w FROM documents WHERE lang = 'en' AND {where}"
    own = f"SELECT w, i FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM ({rows})) WHERE w[i] = 'worthless'"
    return f"""near{side} AS (SELECT DISTINCT v AS neighbor FROM (SELECT unnest(w[greatest(i - 5, 1) : i + 5]) AS v FROM ({own})) WHERE v <> 'worthless'),
x{side} AS ({oracles.contexts(rows, f"w[i] = 'worthless' OR w[i] IN (SELECT neighbor FROM near{side})", "1 AS one")}), c{side} AS ({oracles.centroids(f"SELECT * FROM x{side}", "target")}),
s{side} AS (SELECT a.target AS neighbor, {oracles.COS.format('a.c', 'b.c')} AS sim FROM c{side} a, c{side} b WHERE b.target = 'worthless' AND a.target <> 'worthless' AND a.n >= 2),
r{side} AS (SELECT *, row_number() OVER (ORDER BY sim DESC, neighbor) AS r FROM s{side})"""


@query("neighborhood_drift", f"""
WITH {_near('a', "source = 'src0'")}, {_near('b', "source = 'src1'")},
t AS (SELECT coalesce(x.neighbor, y.neighbor) AS neighbor, x.r AS rank_a, y.r AS rank_b FROM (SELECT * FROM ra WHERE r <= 10) x FULL JOIN (SELECT * FROM rb WHERE r <= 10) y ON x.neighbor = y.neighbor)
SELECT neighbor, round(sa.sim, 6) AS sim_a, round(sb.sim, 6) AS sim_b, rank_a::DOUBLE AS rank_a, rank_b::DOUBLE AS rank_b, round(coalesce(sa.sim, 0) - coalesce(sb.sim, 0), 6) + 0.0 AS drift,
  CASE WHEN rank_a IS NOT NULL AND rank_b IS NOT NULL THEN 'shared' WHEN rank_a IS NOT NULL THEN 'gained_in_a' ELSE 'lost_in_a' END AS status FROM t LEFT JOIN sa USING (neighbor) LEFT JOIN sb USING (neighbor)""")
def _(spark, d):
    c = documents(spark, d).slice(lang="en")
    t = semantic.neighborhood_drift(c.slice(source="src0"), c.slice(source="src1"), "worthless", embedder=semantic.LetterEmbedder())
    # a count that may be missing prints differently in either engine
    return rounded(t.withColumns({c: F.col(c).cast("double") for c in ("rank_a", "rank_b")}), "sim_a", "sim_b", "drift")


@query("semantic_trajectory", f"""
WITH x AS ({oracles.contexts(f"SELECT date_trunc('year', l_shipdate)::DATE AS period, {tok('p_name')} AS w FROM lineitem JOIN part ON p_partkey = l_partkey", "w[i] = 'red'", "period")}), c AS ({oracles.centroids("SELECT * FROM x", "period")}),
b AS (SELECT arg_min(c, period) AS base FROM c), p AS (SELECT DISTINCT date_trunc('year', l_shipdate)::DATE AS period FROM lineitem)
SELECT period::VARCHAR AS period, strftime(period, '%Y') AS period_label, 'red' AS target, coalesce(n, 0) AS n_contexts, round({oracles.COS.format('c', 'base')}, 6) AS similarity_to_baseline,
  round(1 - {oracles.COS.format('c', 'base')}, 6) + 0.0 AS distance_from_baseline FROM p LEFT JOIN c USING (period), b""")
def _(spark, d):
    t = semantic.semantic_trajectory(dated(spark, d), ["red"], freq="Y", embedder=semantic.LetterEmbedder())
    return rounded(known(t.withColumn("period", F.col("period").cast("string")), "similarity_to_baseline", "distance_from_baseline"), "similarity_to_baseline", "distance_from_baseline")


@query("vector_shift", f"SELECT a.vec_id::VARCHAR AS word, {rnd('1 - ' + _COS.format('a.embedding', 'b.embedding'), 'cosine_distance')} FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 10")
def _(spark, d):
    e = table(spark, d, "embeddings")
    early = e.select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").cast("array<double>").alias("vector"))
    late = e.select((F.col("vec_id") - 10).cast("string").alias("word"), F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(readers.vector_shift(early, late), "cosine_distance")


# idioms and plot data


def _html() -> str:
    """Entities of the pages, those without a semicolon too; the ampersand itself comes last."""
    text = r"regexp_replace(html, '<[^>]+>', ' ', 'g')"
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return rf"SELECT page_id, trim(regexp_replace({text}, '[\s\x{{00A0}}]+', ' ', 'g')) AS text FROM pages"


@query("clean_html", _html())
def _(spark, d):
    return table(spark, d, "pages").select("page_id", readers.clean_html(F.col("html")).alias("text"))


@query("classify_text", """SELECT doc_id, CASE WHEN regexp_matches(text, 'License|Licensed') THEN 'license' WHEN regexp_matches(text, '@mail') THEN 'mail' WHEN regexp_matches(text, 'token = ') THEN 'secret' ELSE 'unknown' END AS kind FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", readers.classify_text(F.col("text"), [("License|Licensed", "license"), ("@mail", "mail"), ("token = ", "secret")]).alias("kind"))


@query("share_pivot", "SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in _MANY) + " FROM documents GROUP BY source")
def _(spark, d):
    return plots.share_pivot(table(spark, d, "documents"), "source", "lang", _MANY)


@query("decades", """WITH c AS (SELECT (year(o_orderdate) // 10 * 10)::INT AS decade, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT decade, o_orderstatus, n, round(n / sum(n) OVER (PARTITION BY decade)::DOUBLE, 9) AS share FROM c""")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return rounded(plots.decades(o, "year", "o_orderstatus"), "share", digits=9)


@query("crossover", """
WITH w AS (SELECT year(ts) * 100 + week(ts) AS y, count(*) FILTER (event_type = 'click') AS o, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY 1)
SELECT min(y) FILTER (n > o) AS crossover, arg_max(n >= o, y) AS held FROM w""")
def _(spark, d):
    e = table(spark, d, "events").select((F.year("ts") * 100 + F.weekofyear("ts")).cast("long").alias("y"), "event_type", F.lit(1).alias("v"))
    return plots.crossover(e, "y", "event_type", "v", "click", "purchase")


@query("stratified_cap", """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 25""")
def _(spark, d):
    return readers.stratified_cap(table(spark, d, "documents"), "lang", 25, "doc_id").select("doc_id", "lang")


@query("scattertext", f"""
WITH t AS (SELECT lang, unnest({tok()}) AS term FROM documents WHERE lang IN ('en', 'de')), c AS (SELECT term, count(*) FILTER (lang = 'en') AS count_a, count(*) FILTER (lang = 'de') AS count_b FROM t GROUP BY 1 HAVING count(*) >= 5),
r AS (SELECT *, (rank() OVER (ORDER BY count_a) + (count(*) OVER (PARTITION BY count_a) - 1) / 2.0) / count(*) OVER () AS x, (rank() OVER (ORDER BY count_b) + (count(*) OVER (PARTITION BY count_b) - 1) / 2.0) / count(*) OVER () AS y FROM c)
SELECT term, count_a, count_b, {rnd('x', 'x')}, {rnd('y', 'y')}, {rnd('x - y', 'score')} FROM r""")
def _(spark, d):
    return rounded(plots.scattertext(*en_de(spark, d)), "x", "y", "score")


@query("dispersion_ticks", f"""
WITH w AS (SELECT doc_id, {tok()} AS w FROM documents), o AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)
SELECT doc_id, w[i] AS target, i - 1 AS position, round((i - 1) / len(w)::DOUBLE, 9) AS share FROM o WHERE w[i] IN ('idiot', 'clown')""")
def _(spark, d):
    return rounded(plots.dispersion_ticks(documents(spark, d), ["idiot", "clown"]), "share", digits=9)


@query("windowed_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS period_start, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS period_end, event_type AS term, count(*) AS count FROM events GROUP BY 1, 2, 3")
def _(spark, d):
    return plain(online.windowed_counts(table(spark, d, "events"), "ts", "event_type"), "period_start", "period_end")


@query("sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def _(spark, d):
    return plain(online.sessions(table(spark, d, "events"), "ts", "user_id"), "start", "end")


@query("sample_speeches")
def _(spark, d):
    return speeches.generate(spark).df
