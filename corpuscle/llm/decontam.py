"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows become a hash table; a document's windows are hashed in one pass, those
found in the table are verified word by word, and each hit covers its words.

Edge cases: null texts have no words; null ids are ids like any other; repeated rows with the same id
and text give one result row (remove() keeps them all); an empty table gives no rows; an empty benchmark
hits nothing; items without words have no window; other columns aren't read, and remove() keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import BROADCAST_ROWS, free, materialize, small

N = 13
#: Words of a text that are compared with windows at once.
BLOCK = 1024
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Outside ASCII, whatever Unicode lower-casing might change.
CASED = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{P}]"
#: The share of a document's words, in hits, from which it counts as contaminated: one in so many.
SHARE = 20


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; lower() is used where it does just that, as it is faster."""
    return F.when(text.rlike(CASED), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def windows_of(benchmark: DataFrame, n: int = N, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, size, win, items): the different windows of the benchmark and the sorted ids that hold them."""
    w = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    w = w.select("item", F.expr(f"explode(transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> slice(w, i, {n})))").alias("win"))
    return w.groupBy("win").agg(F.collect_set("item").alias("items")).select(
        F.xxhash64("win").alias("h"), F.size("win").alias("size"), "win", "items"
    )


def hits(
    df: DataFrame,
    benchmark: DataFrame,
    n: int = N,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows (id, text_key, n_words, pos, size, items): a row of pos 0 for each (id, text), and one for
    each verified window, which starts at word pos (from 1).

    Only hashes are exploded, so work grows in proportion to a text's length; the words themselves are
    fetched for the texts with hits, in blocks of bounded size, and compared with the windows.
    """
    table = materialize(windows_of(benchmark, n))
    known = table.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    sizes = sorted(known["sizes"])
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    lists = docs.select("id", "text_key", words(F.col("text")).alias("w")).select("id", "text_key", "w", F.size("w").alias("n_words"))
    none = F.lit(None).cast("array<string>")
    marks = lists.select("id", "text_key", "n_words", F.lit(0).alias("pos"), F.lit(0).alias("size"), none.alias("items"))
    if not sizes:
        return marks
    each = [
        f"case when n_words >= {m} then transform(sequence(1, n_words - {m - 1}), i -> xxhash64(slice(w, i, {m}))) else array() end"
        for m in sizes
    ]
    keys = table.select("h", "size").distinct()
    one_pass = known["n"] <= broadcast_rows
    if one_pass:
        # the first entry stands for the text itself and always finds its row
        each.insert(0, "cast(array(-1L) as array<bigint>)")
        own = df.sparkSession.range(1).select(F.lit(-1).cast("long").alias("h"), F.lit(0).alias("size"))
        keys = F.broadcast(keys.unionByName(own))
    # windows of every size in one array, each size with its own offset
    hashed = lists.select("id", "text_key", "n_words", F.posexplode(F.expr(f"concat({', '.join(each)})")).alias("at", "h")).join(keys, "h")
    before, pos = F.lit(1 if one_pass else 0), F.lit(-1)
    for m in sizes:
        pos = F.when(F.col("size") == m, F.col("at") - before + 1).otherwise(pos)
        before = before + F.greatest(F.col("n_words") - F.lit(m - 1), F.lit(0))
    mine = F.col("n_words") - F.col("size") + 1
    real = (F.col("size") > 0) & (F.col("pos") >= 1) & (F.col("pos") <= mine) | (F.col("size") == 0) & (F.col("at") == 0)
    found = hashed.withColumn("pos", F.when(F.col("size") == 0, F.lit(0)).otherwise(pos)).filter(real)
    # repeated rows find the same
    found = materialize(found.select("id", "text_key", "n_words", "pos", "size", "h").distinct())
    near = found.filter("pos > 0")
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["text_key"] == b["text_key"])
    hit_keys = small(near.select("id", "text_key").distinct())
    hit = docs.join(hit_keys, same(docs, hit_keys), "left_semi").dropDuplicates(["id", "text_key"]).select("id", "text_key", words(F.col("text")).alias("w"))
    cut = f"transform(sequence(0, (size(w) - 1) div {BLOCK}), b -> struct(cast(b as int) as block, slice(w, cast(b as int) * {BLOCK} + 1, {BLOCK + n - 1}) as part))"
    blocks = hit.select("id", "text_key", F.explode(F.expr(cut)).alias("b")).select("id", "text_key", "b.block", "b.part")
    wanted = table if not one_pass else F.broadcast(table)
    per = near.join(wanted, ["h", "size"]).withColumn("block", F.floor((F.col("pos") - 1) / BLOCK).cast("int"))
    per = per.groupBy("id", "text_key", "n_words", "block").agg(F.collect_list(F.struct("pos", "size", "win", "items")).alias("found"))
    both = per.join(blocks, same(per, blocks) & (per["block"] == blocks["block"])).select(per["id"], per["text_key"], "n_words", "part", per["block"], "found")
    alike = F.filter("found", lambda x: F.slice("part", x["pos"] - F.col("block") * BLOCK, x["size"]) == x["win"])
    true = both.select("id", "text_key", "n_words", F.explode(alike).alias("x")).select("id", "text_key", "n_words", "x.pos", "x.size", "x.items")
    if one_pass:
        marks = found.filter("pos = 0").select("id", "text_key", "n_words", "pos", "size", none.alias("items"))
    return marks.unionByName(true)


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per (id, text): n_words, n_hit, n_items, items (sorted ids), contaminated, spans.

    spans: the runs of words hit, as (first, last) word numbers from 1.
    """
    # written once, as it is read twice: a row for each text and one for each hit
    found = materialize(hits(df, benchmark, id_col=id_col, **options))
    # Intervals in order of their start: what each adds to the words covered so far.
    order = Window.partitionBy("id", "text_key").orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("size")
    real = found.filter("pos > 0").withColumn("reach", F.coalesce(F.max(end).over(order), F.lit(1)))
    real = real.withColumn("fresh", F.greatest(end - F.greatest(F.col("pos"), F.col("reach")), F.lit(0)))
    per = real.groupBy("id", "text_key").agg(
        F.sum("fresh").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.collect_set(F.when(F.col("fresh") > 0, F.struct(F.greatest("pos", "reach").alias("first"), (end - 1).alias("last"))))).alias("spans"),
    )
    whole = found.filter("pos = 0").groupBy("id", "text_key").agg(F.max("n_words").cast("long").alias("n_words"))
    both = whole.join(per, (whole.id.eqNullSafe(per.id)) & (whole.text_key == per.text_key), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return both.select(
        whole.id.alias(id_col), whole.text_key, "n_words", n_hit.alias("n_hit"),
        F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


def remove(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without contaminated documents; in the others the words hit are cut out of the text.

    A cut takes each word with the separators after it.
    """
    key, own, own_key, gone, spans, words_ = free(df, "key", "id", "id_key", "gone", "spans", "pieces")
    bad = contamination(df, benchmark, id_col=id_col, text_col=text_col, **options).filter("n_hit > 0")
    bad = bad.select(F.col(id_col).alias(own), F.col("text_key").alias(own_key), F.col("contaminated").alias(gone), F.col("spans").alias(spans))
    keyed = df.withColumn(key, F.xxhash64(text_col))
    both = keyed.join(bad, keyed[id_col].eqNullSafe(bad[own]) & (keyed[key] == bad[own_key]), "left")
    both = both.filter(~F.coalesce(gone, F.lit(False)))
    # leading separators, then each word with what follows it
    pieces = F.regexp_extract_all(text_col, F.lit(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    both = both.withColumn(words_, F.when(F.col(spans).isNotNull(), pieces))
    lead = F.when(F.col(text_col).rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)
    # what stands between the spans, from one to the next
    starts = F.concat(F.array(F.lit(1)), F.transform(spans, lambda s: s["last"] + lead + 1))
    ends = F.concat(F.transform(spans, lambda s: s["first"] + lead - 1), F.array(F.size(words_)))
    kept = F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(words_, a, F.greatest(b - a + 1, F.lit(0))), ""))
    return both.withColumn(text_col, F.when(F.col(spans).isNotNull(), F.array_join(kept, "")).otherwise(F.col(text_col))).select(*df.columns)
