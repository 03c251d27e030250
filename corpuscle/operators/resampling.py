"""Permutation p-values and bootstrap intervals of keyness.

Cells of the document-term table are shuffled once, by term; a term's replicates are all computed
where its cells are, as products of its counts with the weights of its documents. The weights come
from the replicate's number and the seed alone, so no task needs another's, and results depend neither
on the partitioning nor on the input's size. A task makes them for some replicates at a time. Only
totals and limits, three numbers a replicate, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.corpus import Corpus
from corpuscle.plans.storage import ranged, running, small, written

#: Weights (units x replicates) that a task holds at once, cells and terms that it takes together, and numbers hashed at once.
TABLE_CELLS = 32_000_000
TASK_CELLS = 4_000_000
TASK_TERMS = 4096
PIECE = 1 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def keyed_permutation(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A bijection of 0..n-1, evaluated at index: a Feistel network, walked until inside the range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = _U((1 << half) - 1)
    out = index.astype(np.uint64)
    left = np.ones(len(out), bool)
    while left.any():
        x = out[left]
        a, b = x >> _U(half), x & low
        for r in range(4):
            salt = (key * 1_000_003 + r * 7919 + 12345) % (1 << 64)
            with np.errstate(over="ignore"):
                a, b = b, a ^ (_mix(b + _U(salt)) & low)
        out[left] = (a << _U(half)) | b
        left = out >= _U(n)
    return out.astype(np.int64)


def _salt(number: int) -> np.ndarray:
    return _mix(np.array([number % (1 << 64)], np.uint64))


def _stream(salt: int, n: int, at: int = 0) -> np.ndarray:
    """n hashed numbers, from the number at on, that any engine with 64-bit arithmetic can make."""
    with np.errstate(over="ignore"):
        return _mix(np.arange(at, at + n, dtype=np.uint64) + _salt(salt))


def _label_salt(b: int, seed: int) -> int:
    return seed * 1_000_003 + b + 1


def label_limit(n: int, n_a: int, b: int, seed: int) -> int:
    """The n_a-th least of the numbers of n units: side a gets the units up to it. No two are equal, as hashing is one to one."""
    # where it will be but for a chance of 10^-15; else all numbers are looked through
    middle, spread = n_a / n, 8 * np.sqrt(n_a * max(n - n_a, 1) / n) / n + 2 / n
    for low, high in ((max(0.0, middle - spread), min(1.0, middle + spread)), (0.0, 1.0)):
        lo, hi = _U(int(low * (1 << 63)) << 1), _U(min(int(high * (1 << 63)) << 1, (1 << 64) - 1) if high < 1 else (1 << 64) - 1)
        below, near = 0, []
        for at in range(0, n, PIECE):
            h = _stream(_label_salt(b, seed), min(PIECE, n - at), at)
            below += int((h < lo).sum())
            near.append(h[(h >= lo) & (h <= hi)])
        found = np.concatenate(near)
        if below < n_a <= below + len(found):
            return int(np.partition(found, n_a - below - 1)[n_a - below - 1])
    raise ValueError("side a has between 1 and all units")


def _drawn_numbers(n: int, b: int, seed: int, side: int) -> Iterator[np.ndarray]:
    """n draws with replacement: hashed numbers modulo n, in pieces."""
    for at in range(0, n, PIECE):
        h = _stream(seed * 1_000_003 + 2 * b + side + 500_009, min(PIECE, n - at), at)
        yield (h - h // _U(n) * _U(n)).astype(np.int64)


def label_weights(index: np.ndarray, n: int, n_a: int, replicates: int | Iterable[int], seed: int, limits: Mapping[int, int] | Sequence[int] | None = None) -> np.ndarray:
    """(units, replicates): 1 where the replicate puts the unit on side a; exactly n_a units each."""
    chosen = list(range(replicates) if isinstance(replicates, int) else replicates)
    limits = np.array([label_limit(n, n_a, b, seed) if limits is None else limits[b] for b in chosen], np.uint64)
    salts = np.concatenate([_salt(_label_salt(b, seed)) for b in chosen])
    out = np.empty((len(index), len(chosen)), np.uint8)
    step = max(1, PIECE // len(chosen))
    for x in range(0, len(index), step):
        with np.errstate(over="ignore"):
            out[x : x + step] = _mix(index[x : x + step].astype(np.uint64)[:, None] + salts[None]) <= limits[None]
    return out


def draw_weights(index: np.ndarray, n: int, replicates: int | Iterable[int], seed: int, side: int) -> np.ndarray:
    """(units, replicates): how often the replicate draws the unit; n draws each."""
    chosen = list(range(replicates) if isinstance(replicates, int) else replicates)
    out = np.empty((len(chosen), len(index)), np.uint8)
    for k, b in enumerate(chosen):
        row = np.zeros(n, np.int64)
        for drawn in _drawn_numbers(n, b, seed, side):
            row += np.bincount(drawn, minlength=n)
        row = row[index]
        if len(row) and row.max() > np.iinfo(out.dtype).max:
            out = out.astype(np.int64)
        out[k] = row
    return np.ascontiguousarray(out.T)


def _label_table(n: int, n_a: int, replicates: int, seed: int) -> np.ndarray:
    return label_weights(np.arange(n), n, n_a, replicates, seed)


def _draw_table(n: int, replicates: int, seed: int, side: int) -> np.ndarray:
    return draw_weights(np.arange(n), n, replicates, seed, side)


def g2_array(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, formula: str = "rayson") -> np.ndarray:
    """Signed log-likelihood of arrays; NaN where a side has no tokens."""

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.where(o > 0, o, 1) / np.where(e > 0, e, 1)), 0.0)

    with np.errstate(all="ignore"):
        share = (a + b) / (n_a + n_b)
        total = part(a, n_a * share) + part(b, n_b * share)
        if formula == "dunning":
            c, d = n_a - a, n_b - b
            share = (c + d) / (n_a + n_b)
            total = total + part(c, n_a * share) + part(d, n_b * share)
        size = np.maximum(2 * total, 0.0)
        signed = np.where(a / n_a >= b / n_b, size, -size)
    return np.where((n_a > 0) & (n_b > 0), signed, np.nan)


def dense_index(df: DataFrame, key: str, parts: int = 256) -> DataFrame:
    """(key, index): a number from 0 for each different key, without one task that sees them all."""
    keys = df.select(key).distinct().withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)))
    sizes = keys.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return keys.join(F.broadcast(starts), "_part").select(key, (F.col("_start") + own).alias("index"))


def ranked_index(df: DataFrame, key: str) -> DataFrame:
    """(key, index): the place of each different key in their order, counted range by range; null has none."""
    keys = ranged(df.select(key).distinct().filter(F.col(key).isNotNull()).withColumn("_one", F.lit(1)), key)
    return running(keys, key, "sum", "_one", "_place").select(key, (F.col("_place") - 1).alias("index"))


def _units(side: Corpus, cluster_col: str | None) -> str:
    if cluster_col is None:
        return side.need_id("resampling")
    if cluster_col not in side.df.columns:
        raise ValueError(f"no cluster column {cluster_col!r}")
    return cluster_col


def _prepare(a: Corpus, b: Corpus, terms: DataFrame | None, cluster_col: str | None, denominator: str, pooled: bool):
    """(cells: term, side, index, n; sizes: side, index, size; units of a; units of b). Units are numbered in their order."""
    if denominator not in ("kept", "full"):
        raise ValueError("denominator is 'kept' or 'full'")
    cells = None
    counts = []
    terms = written(terms.select("term").distinct()) if terms is not None else None
    for s, side in enumerate((a, b)):
        key = _units(side, cluster_col)
        units = written(ranked_index(side.df, key))
        counts.append(side.df.select(key).distinct().count())
        if counts[-1] == 0:
            raise ValueError(f"{side.label} holds no documents")
        shift = counts[0] if pooled and s else 0
        units = units.withColumn("index", F.col("index") + shift)
        rows = side.terms(key)
        if terms is not None and denominator == "kept":
            rows = rows.join(small(terms), "term", "left_semi")
        rows = rows.groupBy(key, "term").agg(F.count("*").alias("n")).join(small(units), key)
        rows = rows.select("term", F.lit(s).alias("side"), "index", "n")
        cells = rows if cells is None else cells.unionByName(rows)
    cells = written(cells)
    kept = written(cells.join(small(terms), "term", "left_semi")) if terms is not None and denominator == "full" else cells
    sizes = cells.groupBy("side", "index").agg(F.sum("n").alias("size"))
    return kept, sizes, counts[0], counts[1]


def _by_replicate(sizes: DataFrame, replicates: int, one: Callable[[int, list[tuple[np.ndarray, np.ndarray]]], tuple]) -> list[tuple]:
    """one(replicate, [(index, size) of each side]) for each replicate, in as many tasks as run at once; each holds the units' sizes."""
    tasks = min(replicates, max(1, sizes.sparkSession.sparkContext.defaultParallelism))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [(own["index"].to_numpy(), own["size"].to_numpy(float)) for own in (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1])]
        mine = range(int(pdf["task"].iloc[0]), replicates, tasks)
        return pd.DataFrame([(b, *one(b, sides)) for b in mine], columns=["b", "limit", "t0", "t1"])

    spread = sizes.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    found = spread.groupBy("task").applyInPandas(run, "b int, limit string, t0 double, t1 double").collect()
    return [(r["limit"], r["t0"], r["t1"]) for r in sorted(found, key=lambda r: r["b"])]


def _dense(n: int, index: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(n)
    out[index] = size
    return out


def _products(term: np.ndarray, unit: np.ndarray, count: np.ndarray, terms: int, replicates: int, units: int, table: Callable[[range], np.ndarray]) -> np.ndarray:
    """(terms, replicates): sums of counts times the weights of their units; table(replicates) has a row for each unit. Cells are in order of their terms."""
    out = np.zeros((terms, replicates))
    if not len(term):
        return out
    width = max(1, min(replicates, TABLE_CELLS // max(units, 1)))
    step = max(1, PIECE // width)
    for b in range(0, replicates, width):
        chosen = range(b, min(b + width, replicates))
        weights = table(chosen)
        for x in range(0, len(term), step):
            t = term[x : x + step]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            out[t[first], b : chosen.stop] += np.add.reduceat(weights[unit[x : x + step]] * count[x : x + step, None], first, axis=0)
    return out


def _per_term(cells: DataFrame, some: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], dict], schema: str, last=None) -> DataFrame:
    """A row for each term: some(term's number, side, index, n, terms) has the columns of several terms, whose cells are together and in their order."""

    def settle(parts: list[tuple]) -> pd.DataFrame:
        names, side, index, n = (np.concatenate(p) for p in zip(*parts))
        new = np.r_[True, names[1:] != names[:-1]]
        number = np.cumsum(new) - 1
        return pd.DataFrame({"term": names[new], **some(number, side, index, n.astype(float), int(number[-1]) + 1)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held, terms = [], 0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            arrays = tuple(pdf[c].to_numpy() for c in ("term", "side", "index", "n"))
            names = arrays[0]
            if held >= TASK_CELLS or terms >= 2 * TASK_TERMS:
                cuts = np.flatnonzero(np.r_[parts[-1][0][-1] != names[0], names[1:] != names[:-1]])
                if len(cuts):
                    x = int(cuts[0])
                    yield settle([*parts, tuple(v[:x] for v in arrays)])
                    arrays, parts, held, terms = tuple(v[x:] for v in arrays), [], 0, 0
            parts.append(arrays)
            held += len(arrays[0])
            terms += int((arrays[0][1:] != arrays[0][:-1]).sum())
        if parts:
            yield settle(parts)
        if last is not None:
            yield pd.DataFrame([last()])

    # each task makes the weights once, so there are only as many as are needed
    n = cells.agg(F.count("*").alias("n"), F.approx_count_distinct("term").alias("t")).first()
    least = min(cells.sparkSession.sparkContext.defaultParallelism, -(-n["n"] // 100_000))
    tasks = max(1, least, -(-n["n"] // TASK_CELLS), -(-n["t"] // TASK_TERMS))
    return cells.repartition(tasks, "term").sortWithinPartitions("term", "side", "index").mapInPandas(run, schema)


def permutation_pvalues(
    a: Corpus, b: Corpus, terms: DataFrame | None = None, n_permutations: int = 999, seed: int = 0, denominator: str = "kept"
) -> DataFrame:
    """(term, p_permutation): (number of label shuffles at least as extreme + 1) / (shuffles + 1).

    The statistic is the unsigned log-likelihood, whatever formula the table uses; a shuffle that
    leaves a side without tokens counts as not extreme.
    """
    if n_permutations < 1:
        raise ValueError("at least one permutation is needed")
    cells, sizes, units_a, units_b = _prepare(a, b, terms, None, denominator, True)
    n, reps = units_a + units_b, n_permutations

    def drawn_total(r: int, sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
        limit, total = label_limit(n, units_a, r, seed), 0.0
        for index, size in sides:
            total += float(size @ label_weights(index, n, units_a, [r], seed, {r: limit})[:, 0])
        return str(limit), total, 0.0

    known = {r["side"]: float(r["t"]) for r in sizes.groupBy("side").agg(F.sum("size").alias("t")).collect()}
    whole = sum(known.values())
    rows = _by_replicate(sizes, reps, drawn_total)
    limits, t_a = np.array([int(r[0]) for r in rows], np.uint64), np.array([r[1] for r in rows])

    def some(term: np.ndarray, side: np.ndarray, index: np.ndarray, count: np.ndarray, terms: int) -> dict:
        units, unit = np.unique(index, return_inverse=True)
        drawn = _products(term, unit, count, terms, reps, len(units), lambda chosen: label_weights(units, n, units_a, chosen, seed, limits))
        full, own = np.bincount(term, count, terms), np.bincount(term, count * (side == 0), terms)
        seen = np.abs(g2_array(own, full - own, np.array([known.get(0, 0.0)]), np.array([known.get(1, 0.0)])))
        p = np.empty(terms)
        for x in range(0, terms, 256):
            at = slice(x, x + 256)
            size = np.abs(g2_array(drawn[at], full[at, None] - drawn[at], t_a, whole - t_a))
            p[at] = ((size >= seen[at, None] - 1e-9).sum(axis=1) + 1) / (reps + 1)
        return {"p_permutation": p}

    return _per_term(cells, some, "term string, p_permutation double")


def bootstrap_g2_ci(
    a: Corpus,
    b: Corpus,
    terms: DataFrame | None = None,
    formula: str = "rayson",
    n_boot: int = 999,
    ci_level: float = 0.95,
    simultaneous: bool = False,
    cluster_col: str | None = None,
    seed: int = 0,
    denominator: str = "kept",
) -> DataFrame:
    """(term, g2_ci_lower, g2_ci_upper[, ..._simultaneous]): resampled documents, or whole clusters."""
    if n_boot < 1:
        raise ValueError("at least one replicate is needed")
    if not 0 < ci_level < 1:
        raise ValueError("ci_level lies between 0 and 1")
    cells, sizes, units_a, units_b = _prepare(a, b, terms, cluster_col, denominator, False)
    units = (units_a, units_b)

    def drawn_totals(r: int, sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
        size = [_dense(units[s], *sides[s]) for s in (0, 1)]
        return None, *[float(sum(size[s][x].sum() for x in _drawn_numbers(units[s], r, seed, s))) for s in (0, 1)]

    total = np.array([r[1:] for r in _by_replicate(sizes, n_boot, drawn_totals)]).reshape(-1, 2).T
    tail = (1 - ci_level) / 2
    most = np.zeros(n_boot)

    def some(term: np.ndarray, side: np.ndarray, index: np.ndarray, count: np.ndarray, terms: int) -> dict:
        drawn = []
        for s in (0, 1):
            on = side == s
            own, unit = np.unique(index[on], return_inverse=True)
            drawn.append(_products(term[on], unit, count[on], terms, n_boot, units[s], lambda chosen: draw_weights(own, units[s], chosen, seed, s)))
        out = {c: np.full(terms, np.nan) for c in ("lo", "hi", "mean", "sd")}
        out["sd"][:] = 0.0
        good = (total[0] > 0) & (total[1] > 0)
        for x in range(0, terms, 256) if good.any() else ():
            at = slice(x, x + 256)
            g = g2_array(drawn[0][at], drawn[1][at], total[0], total[1], formula)
            real = g[:, good]
            out["lo"][at], out["hi"][at] = np.quantile(real, [tail, 1 - tail], axis=1)
            out["mean"][at] = real.mean(axis=1)
            if good.sum() > 1:
                out["sd"][at] = real.std(axis=1, ddof=1)
            sd = np.where(out["sd"][at] == 0, 1.0, out["sd"][at])
            np.fmax(most, np.fmax.reduce(np.abs(g - out["mean"][at, None]) / sd[:, None], axis=0), out=most)
        return {**out, "z": None}

    def last() -> dict:
        return {"term": None, "lo": None, "hi": None, "mean": None, "sd": None, "z": most.tolist()}

    schema = "term string, lo double, hi double, mean double, sd double, z array<double>"
    found = _per_term(cells, some, schema, last if simultaneous else None)
    if not simultaneous:
        return found.select("term", F.col("lo").alias("g2_ci_lower"), F.col("hi").alias("g2_ci_upper"))
    found = written(found)
    worst = found.filter("z is not null").select(F.posexplode("z").alias("b", "z")).groupBy("b").agg(F.max("z").alias("z"))
    q = worst.agg(F.percentile("z", ci_level)).first()[0] or 0.0
    return found.filter("z is null").select(
        "term", F.col("lo").alias("g2_ci_lower"), F.col("hi").alias("g2_ci_upper"),
        (F.col("mean") - q * F.col("sd")).alias("g2_ci_lower_simultaneous"), (F.col("mean") + q * F.col("sd")).alias("g2_ci_upper_simultaneous"),
    )


def kept_terms(table: DataFrame | Iterable[str], like: DataFrame) -> DataFrame:
    if isinstance(table, DataFrame):
        return table.select("term").distinct()
    return like.sparkSession.createDataFrame([(t,) for t in table], "term string")
