"""SQL of the registered queries that is longer than a line or two: resampling, diversity, series, senses.

It says the same as the operators by other means: closed forms where they iterate, lists folded step by
step where they hold a state.
"""

from __future__ import annotations

TOKENS = r"regexp_extract_all(lower(nfc_normalize(coalesce({0}, ''))), '[\p{{L}}\p{{N}}_]+')"


def tok(col: str = "text") -> str:
    return TOKENS.format(col)


def erfc(z: str) -> str:
    """A series below 2.5, a continued fraction from there on."""
    return f"""(CASE WHEN {z} < 2.5
 THEN 1 - 1.1283791670955126 * exp(-{z} * {z}) * {z} * list_reduce([1.0::DOUBLE] || list_transform(range(90, 0, -1), lambda k: k::DOUBLE), lambda acc, k: 1 + 2 * {z} * {z} / (2 * k + 1) * acc)
 ELSE exp(-{z} * {z}) / 1.7724538509055159 / list_reduce([{z}::DOUBLE] || list_transform(range(150, 0, -1), lambda k: k::DOUBLE), lambda acc, k: {z} + (k / 2) / acc) END)"""


def xlogy(x: str, y: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0.0 ELSE {x} * ln({y}) END)"


def g2(a: str = "a", b: str = "b", na: str = "na", nb: str = "nb") -> str:
    e = f"(({a} + {b}) / ({na} + {nb}))"
    s = f"{xlogy(a, f'{a} / ({na} * {e})')} + {xlogy(b, f'{b} / ({nb} * {e})')}"
    return f"(CASE WHEN {a} / {na} >= {b} / {nb} THEN 1 ELSE -1 END * greatest(2 * ({s}), 0.0))"


KEYNESS = f"""
WITH t AS (SELECT doc_id, lang, unnest({tok()}) AS term FROM documents WHERE lang IN ('en', 'de')),
n AS (SELECT count(*) FILTER (lang = 'en')::DOUBLE AS na, count(*) FILTER (lang = 'de')::DOUBLE AS nb FROM t),
c AS (SELECT term, count(*) FILTER (lang = 'en') AS count_a, count(*) FILTER (lang = 'de') AS count_b FROM t GROUP BY term HAVING count(*) >= 20),
g AS (SELECT term, count_a, count_b, {g2('count_a::DOUBLE', 'count_b::DOUBLE')} AS g2 FROM c, n),
p AS (SELECT *, {erfc('z')} AS p FROM (SELECT *, sqrt(abs(g2) / 2) AS z FROM g)),
r AS (SELECT *, row_number() OVER (ORDER BY p, term) AS r, count(*) OVER () AS m FROM p),
q AS (SELECT *, least(min(p * m / r) OVER (ORDER BY p, term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS adj FROM r),
cells AS (SELECT lang, doc_id, term, count(*)::DOUBLE AS n FROM t WHERE term IN (SELECT term FROM c) GROUP BY ALL),
s AS (SELECT lang, doc_id, sum(n) AS size FROM cells GROUP BY ALL), k AS (SELECT lang, count(*)::DOUBLE AS k FROM documents GROUP BY lang),
d AS (SELECT lang, term, sum(n / size) AS s, sum((n / size) ** 2) AS q FROM cells JOIN s USING (lang, doc_id) GROUP BY ALL),
j AS (SELECT lang, term, 1 - sqrt(greatest(q / k - (s / k) ** 2, 0.0)) / (s / k) / sqrt(k - 1) AS d FROM d JOIN k USING (lang)),
o AS (SELECT q.*, coalesce(x.d, 0.0) AS dispersion_a, coalesce(y.d, 0.0) AS dispersion_b FROM q
  LEFT JOIN j x ON x.term = q.term AND x.lang = 'en' LEFT JOIN j y ON y.term = q.term AND y.lang = 'de')
SELECT term, count_a, count_b, round(g2, 6) + 0.0 AS g2, round(p, 9) AS p_value, round(adj, 9) AS p_adjusted,
  round(dispersion_a, 6) + 0.0 AS dispersion_a, round(dispersion_b, 6) + 0.0 AS dispersion_b, least(dispersion_a, dispersion_b) < 0.3 AS dispersion_flag FROM o
"""


# resampling: the hashed numbers of the replicates, in 128-bit arithmetic


def mix(x: str) -> str:
    """The finaliser of a 64-bit generator; x is a UBIGINT."""
    one = f"((xor({x}, {x} >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    two = "((xor(h1, h1 >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"list_transform(list_transform([{one}], lambda h1: {two}), lambda h2: xor(h2, h2 >> 31))[1]"


def _stream(salt: str, at: str) -> str:
    return mix(f"((({at})::UHUGEINT + ({salt})::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT")


def _sides(rows: str, unit: str, least: int) -> str:
    """units: side, unit, idx, n; cells of kept terms: side, idx, term, n; sizes: side, idx, size."""
    return f"""
WITH src AS ({rows}), w AS (SELECT side, {unit} AS unit, {tok()} AS w FROM src),
units AS (SELECT side, unit, row_number() OVER (PARTITION BY side ORDER BY unit) - 1 AS idx FROM (SELECT DISTINCT side, unit FROM w)),
many AS (SELECT count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM units),
t AS (SELECT side, unit, unnest(w) AS term FROM w),
kept AS (SELECT term FROM t GROUP BY term HAVING count(*) >= {least}),
cells AS (SELECT t.side, idx, term, count(*)::DOUBLE AS n FROM t JOIN kept USING (term) JOIN units USING (side, unit) GROUP BY ALL),
sizes AS (SELECT side, idx, sum(n) AS size FROM cells GROUP BY ALL)"""


TURNS = "SELECT CASE WHEN role = 'user' THEN 0 ELSE 1 END AS side, conv_id, turn, text FROM conversations WHERE role IN ('user', 'assistant')"
EN_DE = "SELECT CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS side, doc_id, text FROM documents WHERE lang IN ('en', 'de')"


def permutation(n: int, seed: int, least: int) -> str:
    return _sides(TURNS, "conv_id || '-' || turn", least) + f"""
, salts AS (SELECT b, {mix(f'({seed} * 1000003 + b + 1)::UBIGINT')} AS salt FROM (SELECT unnest(range({n})) AS b)),
nums AS (SELECT b, i, row_number() OVER (PARTITION BY b ORDER BY {_stream('salt', 'i')}, i) AS r FROM salts, (SELECT unnest(range(n0 + n1)) AS i FROM many)),
lab AS (SELECT b, i FROM nums, many WHERE r <= n0),
pc AS (SELECT idx + CASE WHEN side = 1 THEN n0 ELSE 0 END AS i, side, term, n FROM cells, many),
ta AS (SELECT b, sum(size)::DOUBLE AS ta FROM (SELECT i, sum(n) AS size FROM pc GROUP BY i) JOIN lab USING (i) GROUP BY b),
obs AS (SELECT term, sum(n) AS whole, coalesce(sum(n) FILTER (side = 0), 0.0) AS own FROM pc GROUP BY term),
tot AS (SELECT sum(n) AS whole_all, sum(n) FILTER (side = 0) AS known0, sum(n) FILTER (side = 1) AS known1 FROM pc),
dr AS (SELECT term, b, sum(n) AS drawn FROM pc JOIN lab USING (i) GROUP BY ALL),
grid AS (SELECT term, b, whole, coalesce(drawn, 0.0) AS drawn, ta, whole_all,
  abs({g2('own', '(whole - own)', 'known0', 'known1')}) AS seen FROM obs CROSS JOIN ta CROSS JOIN tot LEFT JOIN dr USING (term, b))
SELECT term, round((count(*) FILTER (abs({g2('drawn', '(whole - drawn)', 'ta', '(whole_all - ta)')}) >= seen - 1e-9) + 1) / ({n} + 1)::DOUBLE, 9) AS p_permutation FROM grid GROUP BY term"""


def bootstrap(rows: str, unit: str, n: int, seed: int, least: int, simultaneous: bool) -> str:
    sql = _sides(rows, unit, least) + f"""
, salts AS (SELECT b, side, {mix(f'({seed} * 1000003 + 2 * b + side + 500009)::UBIGINT')} AS salt FROM (SELECT unnest(range({n})) AS b), (SELECT unnest([0, 1]) AS side)),
each AS (SELECT b, side, salt, CASE WHEN side = 0 THEN n0 ELSE n1 END AS many FROM salts, many),
draws AS (SELECT b, side, ({_stream('salt', 'j')} % many::UBIGINT)::BIGINT AS idx FROM (SELECT *, unnest(range(many)) AS j FROM each)),
wts AS (SELECT b, side, idx, count(*) AS w FROM draws GROUP BY ALL),
tot AS (SELECT b, coalesce(sum(size * w) FILTER (side = 0), 0.0) AS na, coalesce(sum(size * w) FILTER (side = 1), 0.0) AS nb FROM sizes JOIN wts USING (side, idx) GROUP BY b),
dr AS (SELECT term, b, coalesce(sum(n * w) FILTER (side = 0), 0.0) AS a, coalesce(sum(n * w) FILTER (side = 1), 0.0) AS b2 FROM cells JOIN wts USING (side, idx) GROUP BY ALL),
grid AS (SELECT kept.term, tot.b AS rep, coalesce(a, 0.0) AS a, coalesce(b2, 0.0) AS b2, na, nb FROM kept CROSS JOIN tot LEFT JOIN dr ON dr.term = kept.term AND dr.b = tot.b),
g AS (SELECT term, rep, {g2('a', 'b2')} AS g FROM grid),
s AS (SELECT term, quantile_cont(g, 0.025) AS lo, quantile_cont(g, 0.975) AS hi, avg(g) AS mean, stddev_samp(g) AS sd FROM g GROUP BY term)"""
    if not simultaneous:
        return sql + " SELECT term, round(lo, 5) + 0.0 AS g2_ci_lower, round(hi, 5) + 0.0 AS g2_ci_upper FROM s"
    return sql + """
, z AS (SELECT rep, max(abs(g - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END) AS z FROM g JOIN s USING (term) GROUP BY rep), q AS (SELECT quantile_cont(z, 0.95) AS q FROM z)
SELECT term, round(lo, 5) + 0.0 AS g2_ci_lower, round(hi, 5) + 0.0 AS g2_ci_upper, round(mean - q * sd, 5) + 0.0 AS g2_ci_lower_simultaneous, round(mean + q * sd, 5) + 0.0 AS g2_ci_upper_simultaneous FROM s, q"""


# diversity


def mtld(tokens: str) -> str:
    """The mean of both directions: the factors are folded token by token."""

    def way(w: str) -> str:
        empty = "'types': []::VARCHAR[], 'run': 0, 'f': 0.0::DOUBLE, 'n': 0"
        more = "CASE WHEN list_contains(a.types, x.t) THEN a.types ELSE list_append(a.types, x.t) END"
        size = "(len(a.types) + CASE WHEN list_contains(a.types, x.t) THEN 0 ELSE 1 END)"
        state = f"""list_reduce([{{{empty}, 't': ''}}] || list_transform({w}, lambda t: {{{empty}, 't': t}}), lambda a, x: CASE WHEN {size}::DOUBLE / (a.run + 1) <= 0.72
 THEN {{'types': []::VARCHAR[], 'run': 0, 'f': a.f + 1, 'n': a.n + a.run + 1, 't': ''}} ELSE {{'types': {more}, 'run': a.run + 1, 'f': a.f, 'n': a.n, 't': ''}} END)"""
        rest = "len(s.types) / s.run::DOUBLE"
        part = f"(s.run > 0 AND {rest} < 1)"
        f = f"(s.f + CASE WHEN {part} THEN (1 - {rest}) / (1 - 0.72) ELSE 0 END)"
        n = f"(s.n + CASE WHEN {part} THEN s.run ELSE 0 END)"
        return f"list_transform([{state}], lambda s: CASE WHEN {f} > 0 THEN {n} / {f} END)[1]"

    return f"list_avg(list_filter([{way(tokens)}, {way(f'list_reverse({tokens})')}], lambda v: v IS NOT NULL))"


def diversity(rows: str, by: str) -> str:
    """ttr, mattr, mtld and hdd of each group of rows (grp, w), from its list of tokens: d(grp, n, t, ttr, mattr, mtld, hdd)."""
    return f"""g AS ({rows}), o AS (SELECT {by}, w, unnest(range(1, len(w) + 1)) AS i FROM g), p AS (SELECT {by}, w[i] AS term, i - 1 AS pos FROM o),
n AS (SELECT {by}, count(*) AS n, count(DISTINCT term) AS t FROM p GROUP BY 1),
q AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY {by}, term ORDER BY pos), -1) AS prev FROM p),
m AS (SELECT {by}, CASE WHEN max(n) < 100 THEN max(t) / max(n)::DOUBLE ELSE sum(greatest(least(pos, n - 100) - greatest(pos - 99, prev + 1, 0) + 1, 0))::DOUBLE / (100 * (max(n) - 99)) END AS mattr FROM q JOIN n USING ({by}) GROUP BY 1),
c AS (SELECT {by}, term, count(*) AS c FROM p GROUP BY 1, 2), k AS (SELECT {by}, c, count(*) AS k FROM c GROUP BY 1, 2),
h AS (SELECT {by}, CASE WHEN max(n) <= 42 THEN max(t)::DOUBLE ELSE sum(k * (1 - list_reduce(list_transform(range(0, 42), lambda j: greatest((n - c - j)::DOUBLE, 0) / greatest(n - j, 1)), lambda x, y: x * y))) END AS hdd FROM k JOIN n USING ({by}) GROUP BY 1),
d AS (SELECT {by}, n, t, t / n::DOUBLE AS ttr, mattr, {mtld('w')} AS mtld, hdd FROM g JOIN n USING ({by}) JOIN m USING ({by}) JOIN h USING ({by}))"""


# series: folded over a term's periods


PLANTED_TEXT = "p_name || CASE WHEN l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1999-03-01' AND (l_orderkey + l_linenumber) % 3 = 0 THEN ' surge surge' WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN ' surge' ELSE '' END"
TERMS = ("red", "blue", "widget", "surge")


def series() -> str:
    """u: term, t (from 0), period, count, total, x; l: term, xs, rs, ds (lists by period)."""
    sums = ", ".join(f"sum(len(list_filter(w, lambda v: v = '{x}')))::BIGINT AS {x}" for x in TERMS)
    union = " UNION ALL ".join(f"SELECT period, '{x}' AS term, {x} AS count, total FROM s" for x in TERMS)
    return f"""
WITH w AS (SELECT date_trunc('month', l_shipdate)::DATE AS period, {tok(PLANTED_TEXT)} AS w FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT period, sum(len(w))::BIGINT AS total, {sums} FROM w GROUP BY 1),
u AS (SELECT *, count / total::DOUBLE AS x, row_number() OVER (PARTITION BY term ORDER BY period) - 1 AS t FROM ({union})),
l AS (SELECT term, list(x ORDER BY period) AS xs, list(count::DOUBLE ORDER BY period) AS rs, list(total::DOUBLE ORDER BY period) AS ds, list(period ORDER BY period) AS ps FROM u GROUP BY term)"""


def changepoints() -> str:
    """Optimal partitioning over all ends, with no pruning."""
    return series() + """
, d AS (SELECT a.term, a.t AS i, b.t AS j, (a.x - b.x) ** 2 AS d FROM u a JOIN u b USING (term)),
mid AS (SELECT term, median(d) AS mid FROM d WHERE i < j GROUP BY term),
k AS (SELECT term, i, j, CASE WHEN i = j THEN 1.0 ELSE exp(-least(greatest(CASE WHEN mid > 0 THEN d / mid ELSE d END, 0.01), 100.0)) END AS k FROM d JOIN mid USING (term)),
n AS (SELECT term, count(*) AS n FROM u GROUP BY term),
e AS (SELECT DISTINCT term, e FROM (SELECT term, unnest(range(5, n, 5)) AS e FROM n UNION ALL SELECT term, n FROM n)),
st AS (SELECT term, e AS s FROM e JOIN n USING (term) WHERE e < n UNION ALL SELECT term, 0 FROM n),
cost AS (SELECT term, s, e, (e - s) - (SELECT sum(k) FROM k WHERE k.term = st.term AND i >= s AND i < e AND j >= s AND j < e) / (e - s) AS c FROM st JOIN e USING (term) WHERE s < e),
rows_ AS (SELECT term, e, list(CASE WHEN e - s >= 2 THEN c ELSE 1e300 END ORDER BY s) AS cs, list(s ORDER BY s) AS ss FROM cost GROUP BY ALL),
f AS (SELECT term, n, list_reduce([{'best': [0.0::DOUBLE], 'path': [[]::BIGINT[]], 'cs': []::DOUBLE[], 'ss': []::BIGINT[]}] || list({'best': []::DOUBLE[], 'path': []::BIGINT[][], 'cs': cs, 'ss': ss} ORDER BY e),
  lambda a, v: list_transform([list_transform(range(1, len(a.best) + 1), lambda i: a.best[i] + v.cs[i] + ln(n))], lambda o:
    {'best': list_append(a.best, list_min(o)), 'path': list_append(a.path, list_append(a.path[list_position(o, list_min(o))], v.ss[list_position(o, list_min(o))])), 'cs': a.cs, 'ss': a.ss})[1]) AS z
  FROM rows_ JOIN n USING (term) GROUP BY term, n)
SELECT term, ps[cut + 1]::VARCHAR AS period, cut AS index, 'pelt' AS method FROM (SELECT term, unnest(list_filter(z.path[-1], lambda v: v > 0)) AS cut FROM f) JOIN l USING (term)"""


def bocpd() -> str:
    state = "'p': {p}, 'mu': {mu}, 'ka': {ka}, 'al': {al}, 'be': {be}, 'x': {x}, 'out': {out}"
    first = "{" + state.format(p="[1.0::DOUBLE]", mu="[m]", ka="[1.0::DOUBLE]", al="[1.0::DOUBLE]", be="[b0]", x="0.0::DOUBLE", out="[]::STRUCT(r BIGINT, c DOUBLE, q DOUBLE)[]") + "}"
    item = "{" + state.format(p="[]::DOUBLE[]", mu="[]::DOUBLE[]", ka="[]::DOUBLE[]", al="[]::DOUBLE[]", be="[]::DOUBLE[]", x="x", out="[]::STRUCT(r BIGINT, c DOUBLE, q DOUBLE)[]") + "}"
    z2 = "((v.x - a.mu[i]) ** 2 / (a.be[i] * (a.ka[i] + 1) / (a.al[i] * a.ka[i])))"
    seen = f"exp(lgamma(a.al[i] + 0.5) - lgamma(a.al[i]) - 0.5 * ln(2 * a.al[i] * pi()) - 0.5 * ln(a.be[i] * (a.ka[i] + 1) / (a.al[i] * a.ka[i])) - (a.al[i] + 0.5) * ln(1 + {z2} / (2 * a.al[i]))) * a.p[i]"
    fresh = "{" + state.format(
        p="pn", mu="[m] || list_transform(range(1, len(a.p) + 1), lambda i: (a.ka[i] * a.mu[i] + v.x) / (a.ka[i] + 1))",
        ka="[1.0::DOUBLE] || list_transform(a.ka, lambda q: q + 1)", al="[1.0::DOUBLE] || list_transform(a.al, lambda q: q + 0.5)",
        be="[b0] || list_transform(range(1, len(a.p) + 1), lambda i: a.be[i] + a.ka[i] * (v.x - a.mu[i]) ** 2 / (2 * (a.ka[i] + 1)))",
        x="0.0::DOUBLE", out="list_append(a.out, {'r': list_position(pn, list_max(pn)) - 1, 'c': pn[1], 'q': list_sum(pn[1:4])})",
    ) + "}"
    return series() + f"""
, pri AS (SELECT term, xs, ps, list_avg(xs) AS m, greatest(list_var_samp(xs) * 0.5, 1e-6) AS b0 FROM l),
f AS (SELECT term, xs, ps, list_reduce([{first}] || list_transform(xs, lambda x: {item}), lambda a, v:
  list_transform([list_transform(range(1, len(a.p) + 1), lambda i: {seen})], lambda s:
  list_transform([[list_sum(s) * 0.01] || list_transform(s, lambda q: q * 0.99)], lambda w:
  list_transform([list_transform(w, lambda q: q / list_sum(w))], lambda pn: {fresh})[1])[1])[1]).out AS o FROM pri)
SELECT term, ps[i]::VARCHAR AS period, round(xs[i], 9) AS value, o[i].r AS map_run_length, round(o[i].c, 6) + 0.0 AS cp_probability, round(o[i].q, 6) + 0.0 AS cp_recent
FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM f)"""


def states(s: float, gamma: float) -> str:
    """st: term, t, state: the cheapest path, kept whole for each last state."""
    up = f"({gamma} * ln(greatest(len(rs), 2)) * greatest(j - i, 0))"
    emit = "(-(v.r * ln(rates[j + 1]) + (v.d - v.r) * ln(1 - rates[j + 1])))"
    first = emit.replace("v.r", "rs[1]").replace("v.d", "ds[1]")
    start = f"{{'c': list_transform(range(5), lambda j: {up.replace('j - i', 'j')} + {first}), 'p': list_transform(range(5), lambda j: [j]), 'r': 0.0::DOUBLE, 'd': 0.0::DOUBLE}}"
    rest = "list_transform(range(2, len(rs) + 1), lambda q: {'c': []::DOUBLE[], 'p': []::BIGINT[][], 'r': rs[q], 'd': ds[q]})"
    through = f"list_transform(range(5), lambda j: list_transform(range(5), lambda i: a.c[i + 1] + {up}))"
    return series() + f"""
, ra AS (SELECT *, list_transform(range(5), lambda j: least(list_sum(rs) / list_sum(ds) * {s}::DOUBLE ** j, 0.999999)) AS rates FROM l),
f AS (SELECT term, rs, list_reduce([{start}] || {rest}, lambda a, v: list_transform([{through}], lambda o:
  {{'c': list_transform(range(5), lambda j: list_min(o[j + 1]) + {emit}), 'p': list_transform(range(5), lambda j: list_append(a.p[list_position(o[j + 1], list_min(o[j + 1]))], j)), 'r': 0.0::DOUBLE, 'd': 0.0::DOUBLE}})[1]) AS z FROM ra),
st AS (SELECT term, unnest(CASE WHEN list_sum(rs) = 0 THEN list_transform(rs, lambda r: 0::BIGINT) ELSE z.p[list_position(z.c, list_min(z.c))] END) AS state, unnest(range(len(rs))) AS t FROM f)"""


def burstiness() -> str:
    return states(2.0, 1.0) + " SELECT term, period::VARCHAR AS period, count, total, state FROM st JOIN u USING (term, t)"


def bursts() -> str:
    return states(1.1, 0.1) + """
, i AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY t) - row_number() OVER (PARTITION BY term, state > 0 ORDER BY t) AS run FROM st JOIN u USING (term, t))
SELECT term, min(period)::VARCHAR AS start, max(period)::VARCHAR AS "end", count(*) AS n_periods, max(state) AS max_state, sum(count)::BIGINT AS total_count, round(avg(count / total::DOUBLE), 9) AS mean_relfreq
FROM i WHERE state > 0 GROUP BY term, run"""


def interrupted(event: str) -> str:
    """Two lines, one on each side of the event, say what four coefficients say. Tails of Student's
    distribution are a finite sum; its quantile is found by halving."""

    def area(x: str) -> str:
        th = f"atan(({x}) / sqrt(f::DOUBLE))"
        odd = f"(2 / pi() * ({th} + CASE WHEN f = 1 THEN 0 ELSE sin({th}) * list_sum(list_transform(range(1, ((f - 1) // 2)::BIGINT + 1), lambda q: cos({th}) ** (2 * q - 1) * CASE WHEN q = 1 THEN 1.0 ELSE list_product(list_transform(range(1, q), lambda g: 2.0 * g / (2 * g + 1))) END)) END))"
        even = f"(sin({th}) * list_sum(list_transform(range(0, (f // 2)::BIGINT), lambda q: cos({th}) ** (2 * q) * CASE WHEN q = 0 THEN 1.0 ELSE list_product(list_transform(range(1, q + 1), lambda g: (2.0 * g - 1) / (2 * g))) END)))"
        return f"(CASE WHEN f % 2 = 1 THEN {odd} ELSE {even} END)"

    halve = area("(a.lo + a.hi) / 2")
    quantile = f"list_reduce([{{'lo': 0.0::DOUBLE, 'hi': 64.0::DOUBLE}}] || list_transform(range(80), lambda g: {{'lo': 0.0::DOUBLE, 'hi': 64.0::DOUBLE}}), lambda a, v: CASE WHEN {halve} < 0.95 THEN {{'lo': (a.lo + a.hi) / 2, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': (a.lo + a.hi) / 2}} END).lo"
    names = ("intercept", "time", "level_change", "slope_change")
    each = " UNION ALL ".join(f"SELECT term, '{c}' AS coefficient, c{i} AS coef, sqrt(v{i} * s2) AS se, f, q FROM co" for i, c in enumerate(names))
    return series() + f"""
, ev AS (SELECT term, count(*) FILTER (period < DATE '{event}') AS ev, count(*) AS n FROM u GROUP BY term),
a AS (SELECT term, ev, n, t, x, (t >= ev)::INT AS post FROM u JOIN ev USING (term)),
m AS (SELECT term, ev, n, post, count(*) AS k, avg(t) AS mt, avg(x) AS mx FROM a GROUP BY ALL),
ss AS (SELECT term, post, sum((t - mt) ** 2) AS sxx, sum((t - mt) * (x - mx)) AS sxy, sum((x - mx) ** 2) AS syy FROM a JOIN m USING (term, post) GROUP BY ALL),
b AS (SELECT m.*, sxx, sxy / sxx AS slope, syy - sxy * sxy / sxx AS rss FROM m JOIN ss USING (term, post)),
c2 AS (SELECT p.term, p.n - 4 AS f, (p.rss + o.rss) / (p.n - 4) AS s2, p.mx - p.slope * p.mt AS c0, p.slope AS c1,
  o.mx - o.slope * (o.mt - p.ev) - (p.mx + p.slope * (p.ev - p.mt)) AS c2, o.slope - p.slope AS c3,
  1.0 / p.k + p.mt ** 2 / p.sxx AS v0, 1 / p.sxx AS v1, 1.0 / o.k + (o.mt - p.ev) ** 2 / o.sxx + 1.0 / p.k + (p.ev - p.mt) ** 2 / p.sxx AS v2, 1 / p.sxx + 1 / o.sxx AS v3
  FROM b p JOIN b o ON p.term = o.term AND p.post = 0 AND o.post = 1),
co AS (SELECT *, {quantile} AS q FROM c2), e AS ({each})
SELECT term, coefficient, round(coef, 8) + 0.0 AS coef, round(se, 8) + 0.0 AS std_err, round(coef / se, 5) + 0.0 AS t, round(1 - {area('abs(coef / se)')}, 6) + 0.0 AS p_value,
  round(coef - q * se, 8) + 0.0 AS ci_lower, round(coef + q * se, 8) + 0.0 AS ci_upper FROM e"""


# letters of contexts


LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (len({0}) - len(replace({0}, c, '')))::DOUBLE)"
COS = "list_cosine_similarity({0}, {1})"


def contexts(rows: str, target: str, keys: str) -> str:
    """Rows (keys, target, v): each occurrence's letters; rows has keys and w, target is an expression on w[i]."""
    text = "array_to_string(w[greatest(i - 5, 1) : i + 5], ' ')"
    return f"SELECT {keys}, w[i] AS target, {LETTERS.format(text)} AS v FROM (SELECT {keys}, w, unnest(range(1, len(w) + 1)) AS i FROM ({rows})) WHERE {target}"


def centroids(contexts_: str, keys: str) -> str:
    return f"""SELECT {keys}, list(x ORDER BY i) AS c, max(n) AS n FROM (SELECT {keys}, i, avg(x) AS x, count(*) AS n FROM (SELECT {keys}, unnest(v) AS x, unnest(range(26)) AS i FROM ({contexts_})) GROUP BY ALL) GROUP BY {keys}"""


def online(rows: str) -> str:
    """The same run lengths for given priors: mean 10, beta 10."""
    sql = bocpd()
    start = sql.index(", pri AS")
    body = sql[start:].replace("list_avg(xs) AS m, greatest(list_var_samp(xs) * 0.5, 1e-6) AS b0", "10.0::DOUBLE AS m, 10.0::DOUBLE AS b0")
    body = body[: body.index("SELECT term, ps[i]")]
    return f"WITH l AS (SELECT term, list(x ORDER BY day) AS xs, list(day ORDER BY day) AS ps FROM ({rows}) GROUP BY term)" + body + """
SELECT term AS key, i - 1 AS seq, xs[i] AS value, o[i].r AS map_run_length, round(o[i].q, 6) + 0.0 AS cp_recent FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM f)"""
