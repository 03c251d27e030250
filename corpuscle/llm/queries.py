"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import bpe, debruijn, decontam, imatch, licenses, secrets, simhash, suffixdedup, toxicity, urlfilter
from corpuscle.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", toxicity.held_out())
    model = toxicity.train(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "offending")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' places: source, then groups of 1000 and of 50 ids, then the document; every fifth
    document stands one directory higher, and every 25th two."""
    docs = table(spark, sf_dir, "documents")
    group = lambda n, k: F.when(F.col("doc_id") % k != 0, F.floor(F.col("doc_id") / n).cast("string"))
    path = F.concat_ws("/", "source", group(1000, 25), group(50, 5), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs, path)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, digests_only=True).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.compare_with_edits(docs, imatch.lexicon(docs))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.deduplicate(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.deduplicate(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_licenses": op3_licenses,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_imatch": op6_imatch,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_secrets": op8_secrets,
    "op9_debruijn": op9_debruijn,
    "op10_url_filter": op10_url_filter,
}

def url_sql() -> str:
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"""
WITH lists AS (SELECT {listed(urlfilter.STRONG)} AS strong, {listed(urlfilter.WEAK)} AS weak, {listed(urlfilter.COMPANY)} AS company, {listed(urlfilter.TRACKERS)} AS trackers
), pairs AS (
  SELECT a, unnest(company) AS b FROM (SELECT unnest(weak) AS a, company FROM lists) UNION ALL
  SELECT a, b FROM (SELECT a, unnest(trackers) AS b FROM (SELECT unnest(trackers) AS a, trackers FROM lists)) WHERE a <> b
), labels AS (SELECT DISTINCT unnest([a || '-' || b, b || '-' || a, a || b, b || a]) AS label FROM pairs
), split AS (
  SELECT page_id, strpos(url, '://') AS mark, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS k, page_id,
         CASE WHEN mark > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN mark > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM split
), met AS (
  SELECT k, label || '.' AS t FROM (SELECT k, unnest(list_transform(string_split(host, '.'), lambda x: regexp_replace(x, ':.*$', '', 's'))) AS label FROM parts) JOIN labels USING (label)
  UNION ALL SELECT k, w FROM parts, (SELECT unnest(strong) AS w FROM lists) WHERE regexp_matches(host, '\\b' || w || '\\b')
), found AS (SELECT k, min(t) AS p FROM met GROUP BY k
), named AS (
  SELECT parts.*, p, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts LEFT JOIN found USING (k)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN p IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN p END AS pattern
FROM named
"""


DECONTAMINATION_SQL = """
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), items AS (
  SELECT id AS item_id, least(len(w), 13) AS m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w
  FROM words WHERE side = 'b' AND len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, m, w[i : i + m - 1] AS win FROM items
), sizes AS (SELECT DISTINCT m FROM wins
), grams AS (
  SELECT id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM words, sizes WHERE side = 'd' AND len(w) >= m
), hit AS (
  SELECT g.id, g.i, g.m, wins.item_id FROM grams g JOIN wins ON wins.m = g.m AND wins.win = g.w[g.i : g.i + g.m - 1]
), covered AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY id
), named AS (
  SELECT id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY id
)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.s, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN covered c ON c.id = w.id LEFT JOIN named n ON n.id = w.id WHERE w.side = 'd'
"""

DEBRUIJN_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)
), r AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1
), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM g JOIN r USING (win)
), n AS (
  SELECT c.doc_id, count(*) AS n_removed, count(*) FILTER (d.p IS NULL) AS n_spans
  FROM c LEFT JOIN c d ON d.doc_id = c.doc_id AND d.p = c.p - 1 GROUP BY c.doc_id
), k AS (
  SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.p) AS kept
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w) u
  LEFT JOIN c ON c.doc_id = u.doc_id AND c.p = u.p WHERE c.p IS NULL GROUP BY u.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n.n_removed, 0) AS n_removed, coalesce(n.n_spans, 0) AS n_spans,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""



def licenses_sql() -> str:
    quoted = lambda t: t.replace("'", "''")
    rows = ", ".join(
        f"({i}, '{licenses.TEMPLATES[i][0]}', {len(licenses.TEMPLATES[i][1])}, '{quoted(t)}', {n})" for i, c in enumerate(licenses.template_terms()) for t, n in sorted(c.items())
    )
    lines = lambda t: f"regexp_split_to_array(regexp_replace({t}, '{licenses.SENTENCE}', '\\1\n', 'g'), '\\n+')"
    return f"""
WITH tpl(template, license, size, term, n) AS (VALUES {rows}
), d AS (
  SELECT doc_id, text, concat_ws('/', source, CASE WHEN doc_id % 25 <> 0 THEN doc_id // 1000 END, CASE WHEN doc_id % 5 <> 0 THEN doc_id // 50 END) AS dir, doc_id || '.txt' AS file FROM documents
), total AS (SELECT count(*) AS total FROM d
), freq AS (
  SELECT term, count(*) AS freq
  FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM d) GROUP BY term
), idf AS (
  SELECT DISTINCT term, ln((1 + total) / (1 + coalesce(freq, 0))::DOUBLE) + 1 AS idf FROM tpl LEFT JOIN freq USING (term), total
), norms AS (SELECT template, sqrt(sum((n * idf) ** 2)) AS norm FROM tpl JOIN idf USING (term) GROUP BY template
), wt AS (SELECT template, license, size, term, n * idf / norm AS w FROM tpl JOIN idf USING (term) JOIN norms USING (template)
), par AS (
  SELECT doc_id, text, list_transform(string_split(regexp_replace(regexp_replace(text, '{licenses.MARK}', '\\1', 'g'), '{licenses.GAP}', chr(12), 'g'), chr(12)), lambda p: regexp_replace(p, '\\s*\\n\\s*', ' ', 'g')) AS par FROM d
), seg AS (
  SELECT doc_id, seg, row_number() OVER () AS k FROM (
  SELECT doc_id, unnest(list_distinct({lines("text")} || par || {lines("array_to_string(par, chr(10))")} || [regexp_replace(array_to_string(par, ' '), '\\s*\\n\\s*', ' ', 'g')])) AS seg FROM par)
), words AS (SELECT k, doc_id, term, count(*) AS tf FROM (SELECT k, doc_id, unnest(regexp_extract_all(lower(seg), '[\\p{{L}}\\p{{N}}]+')) AS term FROM seg) GROUP BY ALL
), x AS (SELECT k, doc_id, term, tf * coalesce(idf, ln(1 + total) + 1) AS x FROM words LEFT JOIN idf USING (term), total
), xn AS (SELECT k, sqrt(sum(x * x)) AS norm FROM x GROUP BY k
), s AS (
  SELECT x.k, doc_id, template, license, size, round(sum(x * w) / max(norm), 6) AS score FROM x JOIN wt USING (term) JOIN xn ON xn.k = x.k
  GROUP BY ALL HAVING round(sum(x * w) / max(norm), 6) >= {licenses.THRESHOLD}
), best AS (SELECT doc_id, license, size, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) = 1
), f AS (
  SELECT d.doc_id, dir, dir || '/' || file AS path, license, score, license IS NOT NULL AND length(text) <= 2 * size + {licenses.EXTRA} AS license_file
  FROM d LEFT JOIN best USING (doc_id)
), h AS (SELECT dir AS up, license AS inherited FROM f WHERE license_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license DESC) = 1
), a AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[1 : depth], '/') AS up FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM f))
), near AS (SELECT dir, arg_max(inherited, depth) AS inherited, arg_max(up, depth) AS inherited_from FROM a JOIN h USING (up) GROUP BY dir)
SELECT doc_id, path, license, score, license_file, inherited, inherited_from, coalesce(license, inherited) AS final
FROM f LEFT JOIN near USING (dir)
"""


SQL: dict[str, str] = {
    "op3_licenses": licenses_sql(),
    "op9_debruijn": DEBRUIJN_SQL,
    "op2_decontamination": DECONTAMINATION_SQL,
    "op10_url_filter": url_sql(),
}
