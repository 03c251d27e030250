"""Registered queries of what surrounds the operators: readers, results, plot data, verbs and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import NgramTokenizer
from corpuscle.operators import keyness, matching, senses
from corpuscle.operators.corpus import Corpus
from corpuscle.plans import oracles, plots, results
from corpuscle.plans.compare import against_baseline, compare
from corpuscle.plans.queries import _BINS, documents, dated, en_de, known, plain, query, rounded, table, tok
from corpuscle.plans.storage import shared_dir
from corpuscle.sources import baselines, readers
from corpuscle.streaming import online


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/surface-{uuid.uuid4().hex}"


# readers


@query("read_parquet", "SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def _(spark, d):
    c = readers.read_parquet(spark, f"{d}/documents.parquet", id_col="doc_id", columns=["doc_id", "lang", "text"])
    return c.df.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("read_csv", "SELECT doc_id, lang, md5(text) AS digest FROM documents WHERE text IS NOT NULL AND text <> ''")
def _(spark, d):
    """Written and read again; quotes and line breaks survive."""
    path = _folder(spark)
    docs = table(spark, d, "documents").select("doc_id", "lang", "text").filter("text is not null and text <> ''")
    docs.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    c = readers.read_csv(spark, path, id_col="doc_id", schema="doc_id long, lang string, text string", lineSep="\n")
    return c.df.select("doc_id", "lang", F.md5(F.encode("text", "utf-8")).alias("digest"))


@query("read_txt", "SELECT p_name AS text, count(*) AS lines FROM part WHERE trim(p_name) <> '' GROUP BY 1")
def _(spark, d):
    """One document a line."""
    path = _folder(spark)
    table(spark, d, "part").select("p_name").write.text(path)
    return readers.read_txt(spark, path + "/part-*", one_doc_per="line").df.groupBy("text").agg(F.count("*").alias("lines"))


@query("from_dataframe", f"SELECT term, count(*) AS count FROM (SELECT unnest({tok('r_name')}) AS term FROM region) GROUP BY term")
def _(spark, d):
    return readers.from_dataframe(spark, table(spark, d, "region").toPandas(), "r_name", "r_regionkey").vocab()


@query("from_dataset", "SELECT lang, count(*) AS docs FROM documents GROUP BY lang")
def _(spark, d):
    c = readers.from_dataset(spark, "documents", lambda name, config, split: f"{d}/{name}.parquet", id_col="doc_id", columns=["doc_id", "lang"])
    return c.df.groupBy("lang").agg(F.count("*").alias("docs"))


@query("corpus_facts", f"SELECT count(*) AS docs, count(*) FILTER (lang = 'en') AS en, sum(len({tok()}))::BIGINT AS tokens FROM documents")
def _(spark, d):
    c = documents(spark, d)
    return spark.createDataFrame([(len(c), len(c.slice(lang="en")), c.total_tokens())], "docs long, en long, tokens long")


@query("custom_tokenizer", "SELECT term, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part) GROUP BY term")
def _(spark, d):
    return Corpus(table(spark, d, "part"), "p_name", "p_partkey").with_tokenizer(lambda t: t.split(" ")).vocab()


@query("shorter_grams", f"""
WITH w AS (SELECT {tok('p_name')} AS w FROM part), g AS (SELECT unnest(w || CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]) ELSE [] END) AS term FROM w)
SELECT term, count(*) AS count FROM g GROUP BY term""")
def _(spark, d):
    return Corpus(table(spark, d, "part"), "p_name", "p_partkey").with_tokenizer(NgramTokenizer(n=2, include_lower=True)).vocab()


# verbs and results


_SIDES = f"""WITH w AS (SELECT doc_id, lang, {tok()} AS w FROM documents WHERE lang IN ('en', 'de')), o AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w),
h AS (SELECT CASE WHEN lang = 'en' THEN 'lang=en' ELSE 'lang=de' END AS corpus, doc_id, i - 1 AS position, w[greatest(i - 5, 1) : i - 1] AS l, w[i] AS keyword, w[i + 1 : i + 5] AS r FROM o WHERE w[i] = '<TERM>'),
q AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY doc_id, position) AS k FROM h)
SELECT doc_id, position, array_to_string(l, ' ') AS "left", keyword, array_to_string(r, ' ') AS "right" FROM q WHERE k <= <N>"""


@query("concordance", _SIDES.replace("<TERM>", "in").replace("<N>", "20"))
def _(spark, d):
    return compare(*en_de(spark, d)).concordance("in").drop("corpus")


@query("explain", _SIDES.replace("<TERM>", "die").replace("<N>", "5"))
def _(spark, d):
    """The lines behind a row of a keyness table."""
    return compare(*en_de(spark, d)).keyness(min_count=50).explain("die").drop("corpus")


@query("keyness_top", f"""
WITH t AS (SELECT lang, unnest({tok()}) AS term FROM documents WHERE lang IN ('en', 'de')), n AS (SELECT count(*) FILTER (lang = 'en')::DOUBLE AS na, count(*) FILTER (lang = 'de')::DOUBLE AS nb FROM t),
c AS (SELECT term, count(*) FILTER (lang = 'en') AS count_a, count(*) FILTER (lang = 'de') AS count_b FROM t GROUP BY term HAVING count(*) >= 5),
g AS (SELECT term, count_a, count_b, {oracles.g2('count_a::DOUBLE', 'count_b::DOUBLE')} AS g2 FROM c, n)
SELECT term, count_a, count_b, round(g2, 6) + 0.0 AS g2 FROM g WHERE g2 > 0 ORDER BY g2 DESC, term LIMIT 20""")
def _(spark, d):
    return rounded(compare(*en_de(spark, d)).keyness().top(20, "a").select("term", "count_a", "count_b", "g2"), "g2")


@query("keyness_bar", f"""
WITH t AS (SELECT lang, unnest({tok()}) AS term FROM documents WHERE lang IN ('en', 'de')), n AS (SELECT count(*) FILTER (lang = 'en')::DOUBLE AS na, count(*) FILTER (lang = 'de')::DOUBLE AS nb FROM t),
c AS (SELECT term, count(*) FILTER (lang = 'en') AS count_a, count(*) FILTER (lang = 'de') AS count_b FROM t GROUP BY term HAVING count(*) >= 5),
g AS (SELECT term, {oracles.g2('count_a::DOUBLE', 'count_b::DOUBLE')} AS g2 FROM c, n)
SELECT term, round(g2, 6) + 0.0 AS g2, side FROM (SELECT *, 'a' AS side FROM g WHERE g2 > 0 ORDER BY g2 DESC, term LIMIT 20) UNION ALL
SELECT term, round(g2, 6) + 0.0 AS g2, side FROM (SELECT *, 'b' AS side FROM g WHERE g2 < 0 ORDER BY g2, term LIMIT 20)""")
def _(spark, d):
    return rounded(plots.bar(keyness.keyness(*en_de(spark, d), multiple_comparisons="none")).select("term", "g2", "side"), "g2")


@query("keyness_volcano", f"""
WITH t AS (SELECT lang, unnest({tok()}) AS term FROM documents WHERE lang IN ('en', 'de')), n AS (SELECT count(*) FILTER (lang = 'en')::DOUBLE AS na, count(*) FILTER (lang = 'de')::DOUBLE AS nb FROM t),
c AS (SELECT term, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang = 'de') AS b FROM t GROUP BY term HAVING count(*) >= 5),
g AS (SELECT term, log2(((a + 0.5) / na) / ((b + 0.5) / nb)) AS lr, sqrt(abs({oracles.g2('a::DOUBLE', 'b::DOUBLE')}) / 2) AS z FROM c, n)
SELECT term, round(lr, 6) + 0.0 AS log_ratio, round(-log10(greatest({oracles.erfc('z')}, 1e-300)), 5) + 0.0 AS minus_log10_p FROM g""")
def _(spark, d):
    return rounded(rounded(plots.volcano(keyness.keyness(*en_de(spark, d), multiple_comparisons="none")), "log_ratio"), "minus_log10_p", digits=5)


@query("baseline_verb", f"""
WITH t AS (SELECT unnest({tok()}) AS term FROM documents WHERE lang = 'fr'), u AS (SELECT unnest({tok()}) AS term FROM documents WHERE lang = 'es'),
n AS (SELECT (SELECT count(*) FROM t)::DOUBLE AS na, (SELECT count(*) FROM u)::DOUBLE AS nb),
p AS (SELECT term, count(*) AS count_a FROM t GROUP BY term), q AS (SELECT term, count(*) AS count_b FROM u GROUP BY term HAVING count(*) >= 2),
x AS (SELECT coalesce(p.term, q.term) AS term, coalesce(count_a, 0) AS count_a, coalesce(count_b, 0) AS count_b FROM p FULL JOIN q ON p.term = q.term)
SELECT term, count_a, count_b, round({oracles.g2('count_a::DOUBLE', 'count_b::DOUBLE')}, 6) + 0.0 AS g2 FROM x, n WHERE count_a + count_b >= 5""")
def _(spark, d):
    """A reference list is saved, listed, loaded and compared with."""
    import tempfile

    c = documents(spark, d)
    base = baselines.baseline_from_corpus(c.slice(lang="es"), "spanish")
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="corpuscle-lists-")
        baselines.save_baseline(base, folder)
        base = baselines.load_baseline(spark, baselines.list_baselines(folder)[0], folder)
    return rounded(against_baseline(c.slice(lang="fr"), base).table.select("term", "count_a", "count_b", "g2"), "g2")


@query("stop_words_joined", f"""
SELECT term, count(*) AS count FROM (SELECT unnest({tok()}) AS term FROM documents) WHERE term NOT IN (SELECT 'w' || i FROM range(2000) r(i)) AND term NOT IN ('the', 'of', 'and') GROUP BY term HAVING count(*) >= 20""")
def _(spark, d):
    """A long list is joined, not written into the plan."""
    return keyness.without(documents(spark, d).vocab(20), ["the", "of", "and", *(f"w{i}" for i in range(2000))])


@query("cem_quantiles", """
WITH j AS (SELECT quality, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)), e AS (SELECT quantile_cont(n_chars, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM j),
b AS (SELECT quality, (len(list_filter(list_distinct(e), lambda v: v < n_chars)) - CASE WHEN n_chars > e[1] THEN 1 ELSE 0 END)::VARCHAR AS stratum FROM j, e),
s AS (SELECT stratum, count(*) FILTER (quality = 0) AS n_a_pre, count(*) FILTER (quality = 1) AS n_b_pre FROM b GROUP BY 1)
SELECT stratum, n_a_pre, n_b_pre, 2 * least(n_a_pre, n_b_pre) AS n_kept, least(n_a_pre, n_b_pre) > 0 AS matched FROM s""")
def _(spark, d):
    """Bins at the quantiles of both sides together."""
    c = Corpus(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), "text", "doc_id")
    return matching.match(c.slice(quality=0), c.slice(quality=1), ["n_chars"]).strata


@query("control_threshold", """
WITH p AS (SELECT (vec_id % 10)::INT AS period, avg((label = 3)::INT) AS d FROM embeddings GROUP BY 1) SELECT round(avg(d) + 3 * stddev_samp(d), 9) AS threshold FROM p WHERE period < 5""")
def _(spark, d):
    e = table(spark, d, "embeddings").groupBy((F.col("vec_id") % 10).alias("p")).agg(F.avg((F.col("label") == 3).cast("double")).alias("d")).filter("p < 5").orderBy("p")
    return spark.createDataFrame([(round(senses.control_threshold([r["d"] for r in e.collect()], 3, 1, 0.0), 9),)], "threshold double")


@query("divergence", """
WITH c AS (SELECT (vec_id % 10)::INT AS period, label, count(*)::DOUBLE AS n FROM embeddings GROUP BY ALL), g AS (SELECT period, label FROM (SELECT DISTINCT period FROM c), (SELECT DISTINCT label FROM c)),
f AS (SELECT period, label, coalesce(n, 0) + 1e-12 AS n, sum(coalesce(n, 0) + 1e-12) OVER (PARTITION BY period) AS s FROM g LEFT JOIN c USING (period, label)), x AS (SELECT a.period, a.n / a.s AS p, b.n / b.s AS q FROM f a JOIN f b ON a.label = b.label AND b.period = 0)
SELECT period, round(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2, 9) + 0.0 AS jsd FROM x GROUP BY period""")
def _(spark, d):
    """Jensen-Shannon divergence of each period's labels from the first's."""
    import numpy as np

    got: dict[int, np.ndarray] = {}
    for r in table(spark, d, "embeddings").groupBy((F.col("vec_id") % 10).cast("int").alias("p"), "label").count().collect():
        got.setdefault(r["p"], np.zeros(10))[r["label"]] += r["count"]
    return spark.createDataFrame([(p, round(senses.jsd(v, got[0]), 9) + 0.0) for p, v in sorted(got.items())], "period int, jsd double")


# plot data and idioms


@query("network_layout", """
WITH n AS (SELECT r_name AS term, (r_regionkey + 1) * 10 AS count FROM region), p AS (SELECT term, (row_number() OVER (ORDER BY count DESC, term) - 1) * 2 * pi() / count(*) OVER () AS a FROM n),
e AS (SELECT a.r_name AS source, b.r_name AS target, 1.5 AS weight FROM region a JOIN region b ON b.r_regionkey = a.r_regionkey + 1)
SELECT source, target, weight::DOUBLE AS weight, round(cos(x.a), 6) + 0.0 AS x1, round(sin(x.a), 6) + 0.0 AS y1, round(cos(y.a), 6) + 0.0 AS x2, round(sin(y.a), 6) + 0.0 AS y2 FROM e JOIN p x ON x.term = source JOIN p y ON y.term = target""")
def _(spark, d):
    r = table(spark, d, "region")
    nodes = r.select(F.col("r_name").alias("term"), ((F.col("r_regionkey") + 1) * 10).alias("count"))
    edges = r.alias("a").join(r.alias("b"), F.expr("b.r_regionkey = a.r_regionkey + 1")).select(F.col("a.r_name").alias("source"), F.col("b.r_name").alias("target"), F.lit(1.5).alias("weight"))
    return rounded(plots.network_layout(nodes, edges), "x1", "y1", "x2", "y2")


@query("ngram_long", "SELECT ngram, year::INT AS year, frequency FROM (SELECT r_name AS ngram, unnest([1990, 1991]) AS year, unnest([r_regionkey * 2, r_regionkey * 3 + 1])::BIGINT AS frequency FROM region)")
def _(spark, d):
    wide = table(spark, d, "region").select(F.col("r_name").alias("ngram"), (F.col("r_regionkey") * 2).cast("long").alias("1990"), (F.col("r_regionkey") * 3 + 1).cast("long").alias("1991"))
    return plots.ngram_long(wide, "ngram", ["1990", "1991"])


@query("clean_post", r"""SELECT c_custkey, trim(regexp_replace(regexp_replace('see http://x.org/' || c_custkey || ' & ' || c_name, '(www\.|https?://)\S+', ' ', 'g'), '\s+', ' ', 'g')) AS post FROM customer""")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", readers.clean_post(F.concat(F.lit("see http://x.org/"), "c_custkey", F.lit(" &amp; "), "c_name")).alias("post"))


@query("book_body", "SELECT c_custkey, c_name AS body FROM customer")
def _(spark, d):
    text = F.concat(F.lit("head\n*** START OF THE BOOK ***\n"), "c_name", F.lit("\n*** END OF THE BOOK ***\nlicense"))
    return table(spark, d, "customer").select("c_custkey", baselines.book_body(text).alias("body"))


@query("grouping_sets", "SELECT lang, source, count(*) AS docs, grouping(lang) + grouping(source) AS level FROM documents GROUP BY CUBE (lang, source)")
def _(spark, d):
    """Counts by all subsets of two groupings."""
    return plots.cube(table(spark, d, "documents"), ["lang", "source"], docs=F.count("*"))


@query("distinct_terms", f"SELECT lang, count(DISTINCT term) AS types FROM (SELECT lang, unnest({tok()}) AS term FROM documents) GROUP BY lang")
def _(spark, d):
    return documents(spark, d).terms("lang").groupBy("lang").agg(F.count_distinct("term").alias("types"))


@query("exports", "SELECT count(*) AS docs, sum(doc_id)::BIGINT AS ids FROM documents")
def _(spark, d):
    """Through JSON and back."""
    import json

    rows = json.loads(results.to_json(table(spark, d, "documents").select("doc_id")))
    return spark.createDataFrame([(len(rows), sum(r["doc_id"] for r in rows))], "docs long, ids long")


# streams


def _stream(spark, df: DataFrame) -> DataFrame:
    """df as files that a stream reads."""
    path = _folder(spark)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _drained(spark, stream: DataFrame, mode: str) -> DataFrame:
    """All that the stream has now, as a table; small results alone go this way."""
    name = "s" + uuid.uuid4().hex
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", _folder(spark)).start()
    run.awaitTermination()
    return spark.table(name)


@query("streamed_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS period_start, event_type AS term, count(*) AS count FROM events GROUP BY 1, 2")
def _(spark, d):
    """Windowed counts by Structured Streaming."""
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    t = _drained(spark, online.windowed_counts(_stream(spark, events), "ts", "event_type"), "complete")
    return plain(t.select("period_start", "term", "count"), "period_start")


_DAILY = "SELECT event_type AS term, date_trunc('day', ts)::DATE AS day, count(*)::DOUBLE AS x FROM events GROUP BY ALL"


@query("streamed_changepoints", oracles.online(_DAILY))
def _(spark, d):
    """Run lengths, value by value, with the state of each key between batches."""
    daily = table(spark, d, "events").groupBy(F.col("event_type").alias("term"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("x"))
    t = _drained(spark, online.online_changepoints(_stream(spark, daily.coalesce(1)), "term", "x", "day", mu_0=10.0, beta_0=10.0), "append")
    return rounded(t, "cp_recent")


@query("streamed_novelty", """
WITH e AS (SELECT vec_id, (vec_id % 3)::INT AS batch, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
s AS (SELECT q.vec_id AS id, q.batch, list_cosine_similarity(q.x, r.x) AS s FROM e q JOIN e r ON r.batch < q.batch), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS k FROM s)
SELECT vec_id AS id, e.batch::BIGINT AS epoch, round(coalesce(n, 0.0), 6) AS novelty FROM e LEFT JOIN (SELECT id, 1 - avg(s) AS n FROM k WHERE k <= 10 GROUP BY id) ON id = vec_id""")
def _(spark, d):
    """Three batches, each against all before it."""
    store, out = _folder(spark), _folder(spark)
    handle = online.novelty_sink(store, out)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    for epoch in range(3):
        handle(e.filter(F.col("id") % 3 == epoch), epoch)
    return rounded(spark.read.parquet(out).select("id", F.col("epoch").cast("long").alias("epoch"), "novelty"), "novelty")
