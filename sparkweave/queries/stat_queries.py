"""Queries on intervals and tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkweave.functions import stats as T
from sparkweave.functions.rounding import settle
from sparkweave.operators import reports as A
from sparkweave.operators import resampling as R
from sparkweave.operators.ranges import quantiles
from sparkweave.queries.base import DRAW, query
from sparkweave.sources.sequences import table

R6 = "round({} + 1e-10::DOUBLE, 6)"
Z = "1.959963984540054::DOUBLE"


def phi(z: str) -> str:
    """The normal distribution in SQL, by the same series written with gamma functions."""
    series = f"list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5::DOUBLE) + 0.5 * ln(pi()))))"
    return f"CASE WHEN {z} < -8 THEN 0 WHEN {z} > 8 THEN 1 ELSE 0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series} END"


@query(f"""WITH c AS (SELECT l_returnflag, l_linestatus, count(*) FILTER (l_discount >= 0.05)::DOUBLE AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), p AS (SELECT *, k / n AS p FROM c)
SELECT l_returnflag, l_linestatus, {R6.format(f"CASE WHEN k = 0 THEN 0 ELSE (p + {Z} * {Z} / (2 * n) - {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n))) / (1 + {Z} * {Z} / n) END")} AS low,
{R6.format(f"CASE WHEN k = n THEN 1 ELSE (p + {Z} * {Z} / (2 * n) + {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n))) / (1 + {Z} * {Z} / n) END")} AS high FROM p""")
def t1_wilson_interval(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.when(F.col("l_discount") >= 0.05, 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = T.wilson_interval(F.col("k"), F.col("n"))
    return c.select("l_returnflag", "l_linestatus", settle(low).alias("low"), settle(high).alias("high"))


@query(f"SELECT l_returnflag, {R6.format('quantile_cont(l_extendedprice, 0.05)')} AS p05, {R6.format('quantile_cont(l_extendedprice, 0.5)')} AS p50, {R6.format('quantile_cont(l_extendedprice, 0.95)')} AS p95 FROM lineitem GROUP BY 1")
def t4_percentile(spark, d):
    q = quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return q.select("l_returnflag", *(settle(n).alias(n) for n in ("p05", "p50", "p95")))


@query(f"""WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS n10, count(*) FILTER (quality = 0 AND toxic = 1) AS n01, count(*) FILTER (quality = 1 AND toxic = 1) AS n11, count(*) FILTER (quality = 0 AND toxic = 0) AS n00 FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT *, {R6.format("CASE WHEN n10 + n01 = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(n10, n01) + 1), lambda k: exp(lgamma(n10 + n01 + 1) - lgamma(k + 1) - lgamma(n10 + n01 - k + 1) - (n10 + n01) * ln(2))))) END")} AS p FROM c""")
def t6_mcnemar_exact(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return T.mcnemar_exact(rows, "quality", "toxic", ["lang"]).select("lang", "n10", "n01", "n11", "n00", settle("p").alias("p"))


WILCOXON = f"""d AS (SELECT {{by}}, round({{a}} - {{b}}, 9) AS d FROM {{source}}), nz AS (SELECT *, abs(d) AS s FROM d WHERE d <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY {{by}} ORDER BY s) + (count(*) OVER (PARTITION BY {{by}}, s) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY {{by}}, s) AS tie FROM nz),
w AS (SELECT {{by}}, count(*) AS n_nonzero, count(*) FILTER (d > 0) AS n_positive, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus, sum((tie * tie * tie - tie) / tie::DOUBLE) AS ties FROM r GROUP BY ALL),
m AS (SELECT {{by}}, count(*) AS n_pairs, list_sort(list(d))[count(*) // 2 + 1] AS median_delta FROM d GROUP BY ALL),
j AS (SELECT *, least(w_plus, w_minus) AS w, (n_nonzero * (n_nonzero + 1.0::DOUBLE) * (2 * n_nonzero + 1) - ties / 2) / 24 AS var FROM m JOIN w USING ({{by}})),
z AS (SELECT *, greatest((abs(w - n_nonzero * (n_nonzero + 1.0::DOUBLE) / 4) - 0.5) / sqrt(var), 0) AS z FROM j)"""
RAW_W = WILCOXON.replace("{{", "{").replace("}}", "}")


@query("WITH " + RAW_W.format(by="l_returnflag", a="l_discount", b="l_tax", source="lineitem") + f" SELECT l_returnflag, n_pairs, n_nonzero, n_positive, n_nonzero - n_positive AS n_negative, w_plus, w_minus, {R6.format('median_delta')} AS median_delta, {R6.format('least(1, 2 * (1 - (' + phi('z') + ')))')} AS p FROM z")
def t7_wilcoxon_signed_rank(spark, d):
    w = T.wilcoxon_signed_rank(table(spark, d, "lineitem"), "l_discount", "l_tax", ["l_returnflag"])
    return w.select("l_returnflag", "n_pairs", "n_nonzero", "n_positive", "n_negative", "w_plus", "w_minus", settle("median_delta").alias("median_delta"), settle("p").alias("p"))


@query(f"""WITH RECURSIVE {RAW_W.format(by="o_custkey", a="o_totalprice", b="150000", source="orders")},
e AS MATERIALIZED (SELECT o_custkey, n_nonzero AS n, w FROM j WHERE ties = 0 AND n_nonzero <= 50),
c(o_custkey, n, w, k, counts) AS (SELECT o_custkey, n, w, 0::BIGINT, list_transform(range(0, n * (n + 1) // 2 + 1), lambda i: CASE WHEN i = 0 THEN 1::BIGINT ELSE 0::BIGINT END) FROM e
UNION ALL SELECT o_custkey, n, w, k + 1, list_transform(range(0, len(counts)), lambda i: counts[i + 1] + CASE WHEN i >= k + 1 THEN counts[i - k] ELSE 0 END) FROM c WHERE k < n)
SELECT o_custkey, n AS n_nonzero, w, {R6.format("least(1, 2 * list_sum(counts[1 : floor(w)::BIGINT + 1])::DOUBLE / pow(2, n))")} AS p FROM c WHERE k = n""")
def t8_wilcoxon_exact_p(spark, d):
    w = T.wilcoxon_signed_rank(table(spark, d, "orders").withColumn("middle", F.lit(150000.0)), "o_totalprice", "middle", ["o_custkey"])
    exact = w.filter("ties = 0 and n_nonzero > 0 and n_nonzero <= 50")
    return exact.select("o_custkey", "n_nonzero", F.least("w_plus", "w_minus").alias("w"), settle("p").alias("p"))


RANKS = """x AS (SELECT {by}, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM {source}), rk AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0::DOUBLE AS ry FROM x)"""


@query(f"WITH {RANKS.format(by='lang', x='n_chars', y='quality', source='documents JOIN labels USING (doc_id)')} SELECT lang, count(*) AS n, {R6.format('corr(rx, ry)')} AS rho FROM rk GROUP BY lang HAVING count(*) >= 4 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0")
def t9_spearman(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return T.spearman(rows, "n_chars", "quality", ["lang"]).filter("rho is not null").select("lang", "n", settle("rho").alias("rho"))


@query(f"""WITH t AS (SELECT p_size AS df, sum(p_partkey % 97)::DOUBLE / count(*) / 24 AS t FROM part GROUP BY 1), u AS (SELECT *, atan(t / sqrt(df)) AS th, df % 2 = 1 AS odd FROM t)
SELECT df, {R6.format("t")} AS t, {R6.format("1 - CASE WHEN df = 1 THEN 2 * th / pi() WHEN odd THEN 2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, (df - 3) // 2 + 1), lambda k: pow(cos(th), 2 * k + 1) * exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2))))) ELSE sin(th) * list_sum(list_transform(range(0, (df - 2) // 2 + 1), lambda k: pow(cos(th), 2 * k) * exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1)))) END")} AS p FROM u""")
def t10_student_t(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_size").alias("df")).agg((F.sum(F.col("p_partkey") % 97).cast("double") / F.count(F.lit(1)) / 24).alias("raw"))
    return t.select("df", settle("raw").alias("t"), settle(T.student_t_two_sided(F.col("raw"), F.col("df"))).alias("p"))


HOLM = "hm AS (SELECT *, count(p) OVER (PARTITION BY {f}) AS m, row_number() OVER (PARTITION BY {f} ORDER BY p) AS place FROM {src}), h AS (SELECT *, least(1, max((m - place + 1) * p) OVER (PARTITION BY {f} ORDER BY p ROWS UNBOUNDED PRECEDING)) AS p_holm FROM hm)"


@query(f"WITH q AS (SELECT s_nationkey AS family, s_suppkey AS id, round(abs(s_acctbal) / 200000, 6) AS p FROM supplier), {HOLM.format(f='family', src='q')} SELECT family, id, p, {R6.format('p_holm')} AS p_holm FROM h")
def t11_holm(spark, d):
    q = table(spark, d, "supplier").select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("id"), F.round(F.abs("s_acctbal") / 200000, 6).alias("p"))
    return T.holm(q, "p", ["family"]).select("family", "id", "p", settle("p_holm").alias("p_holm"))



@query(f"WITH long AS (SELECT l_linestatus || l_returnflag AS metric, l_linestatus, l_discount, l_tax FROM lineitem), {RAW_W.format(by='metric', a='l_discount', b='l_tax', source='long')}, q AS (SELECT metric, left(metric, 1) AS family, n_nonzero, {R6.format('least(1, 2 * (1 - (' + phi('z') + ')))')} AS p FROM z), {HOLM.format(f='family', src='q')} SELECT metric, family, n_nonzero, p, {R6.format('p_holm')} AS p_holm, p_holm <= 0.05 AS reject FROM h")
def t12_compare_arms(spark, d):
    rows = table(spark, d, "lineitem").withColumn("metric", F.concat("l_linestatus", "l_returnflag"))
    w = T.wilcoxon_signed_rank(rows, "l_discount", "l_tax", ["metric"]).select("metric", F.left("metric", F.lit(1)).alias("family"), "n_nonzero", settle("p").alias("p"))
    return T.holm(w, "p", ["family"]).select("metric", "family", "n_nonzero", "p", settle("p_holm").alias("p_holm"), (F.col("p_holm") <= 0.05).alias("reject"))


def two_groups(spark, d):
    """Documents of two languages in bins of length, with the length as the value."""
    docs = table(spark, d, "documents").filter(F.col("lang").isin("en", "fr") & F.col("n_chars").isNotNull())
    return docs.select("doc_id", F.col("lang").alias("grp"), F.floor(F.col("n_chars") / 500).alias("bin"), F.col("n_chars").cast("double").alias("value"))


GROUPS = "g AS (SELECT doc_id, lang AS grp, n_chars // 500 AS bin, n_chars::DOUBLE AS value FROM documents WHERE lang IN ('en', 'fr') AND n_chars IS NOT NULL)"
SDELTA = "b AS ({sel} count(*) FILTER (grp = 'en') AS na, count(*) FILTER (grp = 'fr') AS nb, avg(value) FILTER (grp = 'en') AS ma, avg(value) FILTER (grp = 'fr') AS mb FROM {src} GROUP BY ALL)"


@query(f"WITH {GROUPS}, {SDELTA.format(sel='SELECT bin,', src='g')} SELECT {R6.format('sum((ma - mb) * (na + nb)) / sum(na + nb)')} AS delta, {R6.format('sum(mb * (na + nb)) / sum(na + nb)')} AS base, count(*) AS bins FROM b WHERE na >= 3 AND nb >= 3")
def a26_stratified_delta(spark, d):
    return A.stratified_delta(two_groups(spark, d), [], "grp", "en", "fr", "value").select(settle("delta").alias("delta"), settle("base").alias("base"), "bins")


@query(f"""WITH {GROUPS}, perm AS (SELECT range AS perm FROM range(50)), v AS (SELECT perm, bin, value, row_number() OVER (PARTITION BY perm, bin ORDER BY doc_id) AS k FROM g, perm),
l AS (SELECT perm, bin, grp, row_number() OVER (PARTITION BY perm, bin ORDER BY md5(concat_ws('|', 42, perm, doc_id)), doc_id) AS k FROM g, perm), s AS (SELECT v.perm, v.bin, l.grp, v.value FROM v JOIN l USING (perm, bin, k)),
{SDELTA.format(sel='SELECT perm, bin,', src='s')}, ds AS (SELECT perm, sum((ma - mb) * (na + nb)) / sum(na + nb) AS delta FROM b WHERE na >= 3 AND nb >= 3 GROUP BY perm),
o AS (SELECT sum((ma - mb) * (na + nb)) / sum(na + nb) AS observed FROM (SELECT bin, count(*) FILTER (grp = 'en') AS na, count(*) FILTER (grp = 'fr') AS nb, avg(value) FILTER (grp = 'en') AS ma, avg(value) FILTER (grp = 'fr') AS mb FROM g GROUP BY bin) WHERE na >= 3 AND nb >= 3)
SELECT {R6.format("(count(*) FILTER (abs(delta) >= abs(observed) - 1e-9) + 1) / 51.0::DOUBLE")} AS p FROM ds, o""")
def t13_stratified_permutation_p(spark, d):
    """Labels of a bin are dealt anew in 50 seeded orders; how often the gap is at least as large."""
    rows = two_groups(spark, d).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(49))))
    of = Window.partitionBy("perm", "bin")
    values = rows.select("perm", "bin", "value", F.row_number().over(of.orderBy("doc_id")).alias("k"))
    shuffle = F.md5(F.concat_ws("|", F.lit("42"), F.col("perm").cast("string"), F.col("doc_id").cast("string")))
    labels = rows.select("perm", "bin", "grp", F.row_number().over(of.orderBy(shuffle, "doc_id")).alias("k"))
    deltas = A.stratified_delta(values.join(labels, ["perm", "bin", "k"]), ["perm"], "grp", "en", "fr", "value")
    observed = A.stratified_delta(two_groups(spark, d), [], "grp", "en", "fr", "value").select(F.col("delta").alias("observed"))
    hits = deltas.join(F.broadcast(observed)).agg(F.count(F.when(F.abs("delta") >= F.abs("observed") - 1e-9, 1)).alias("hits"))
    return hits.select(settle((F.col("hits") + 1) / 51.0).alias("p"))


@query(f"WITH {GROUPS}, ok AS (SELECT bin FROM g GROUP BY bin HAVING count(*) FILTER (grp = 'en') >= 3 AND count(*) FILTER (grp = 'fr') >= 3), p AS (SELECT (a.value > b.value)::INTEGER + (a.value = b.value)::INTEGER / 2.0::DOUBLE AS w FROM g a JOIN g b USING (bin) JOIN ok USING (bin) WHERE a.grp = 'en' AND b.grp = 'fr') SELECT {R6.format('avg(w)')} AS effect, (SELECT count(*) FROM ok) AS bins FROM p")
def t14_common_language_effect(spark, d):
    return A.common_language_effect(two_groups(spark, d), "grp", "en", "fr", "value").select(settle("effect").alias("effect"), "bins")


def by_nation(spark, d):
    """The suppliers' balances of each nation, numbered."""
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("x"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("k"))
    return rows.select("g", "x", (F.col("k") - 1).alias("idx"))


def boot(replicates: int = 200) -> str:
    """Seeded resamples of v (g, x, idx): bm has the mean of each replicate."""
    return f""", n AS (SELECT g, count(*) AS n FROM v GROUP BY g), dr AS (SELECT v.g, rep.range AS replicate, floor({DRAW.format('42, v.g, rep.range, v.idx')} * n)::BIGINT AS idx FROM v JOIN n USING (g), range({replicates}) rep),
bm AS (SELECT g, replicate, avg(x) AS mean FROM dr JOIN v USING (g, idx) GROUP BY ALL)"""


def bca(replicates: int = 200) -> str:
    """bca from v and the replicates of boot."""
    return boot(replicates) + f""", pt AS (SELECT g, count(*) AS n, avg(x) AS point, sum(x) AS s, min(x) AS small, max(x) AS large FROM v GROUP BY g),
dv AS (SELECT g, s / n - CASE WHEN n > 1 THEN (s - x) / (n - 1) END AS dev FROM v JOIN pt USING (g)),
ac AS (SELECT g, CASE WHEN sum(dev * dev) > 0 THEN sum(dev * dev * dev) / (6 * pow(sum(dev * dev), 1.5)) ELSE 0 END AS a FROM dv GROUP BY g)""" + corrected(replicates)


def corrected(replicates: int) -> str:
    """bca (g, n, point, low, high, method) from pt, ac and the replicates bm; z0 comes from 60 halvings of [-8, 8]."""
    halving = f"list_reduce(list_concat([0::DOUBLE], list_transform(range(1, 61), lambda h: 8 / pow(2, h))), lambda y, step: y + CASE WHEN ({phi('y')}) < share THEN step ELSE -step END)"
    end = "CASE WHEN 1 - a * (z0 + {0}) > 0 THEN z0 + (z0 + {0}) / (1 - a * (z0 + {0})) END"
    place = "m[floor({0} * {1})::INTEGER + 1] + (m[least(floor({0} * {1})::INTEGER + 2, {2})] - m[floor({0} * {1})::INTEGER + 1]) * ({0} * {1} - floor({0} * {1}))"
    at = lambda q: place.format(q, replicates - 1, replicates)
    value = lambda q, p: f"CASE WHEN n < 2 THEN 'nan'::DOUBLE WHEN small = large THEN point WHEN plain = '' THEN {at(q)} ELSE {at(p)} END"
    return f""",
ms AS (SELECT g, list(mean ORDER BY mean) AS m FROM bm GROUP BY g),
sh AS (SELECT g, n, point, small, large, a, m, len(list_filter(m, lambda y: round(y + 1e-13::DOUBLE, 9) < round(point + 1e-13::DOUBLE, 9))) / {replicates}::DOUBLE AS share FROM pt JOIN ac USING (g) JOIN ms USING (g)),
z0 AS (SELECT *, {halving} AS z0 FROM sh), zs AS (SELECT *, {end.format('(-' + Z + ')')} AS z_low, {end.format(Z)} AS z_high FROM z0),
qs AS (SELECT *, {phi('z_low')} AS q_low, {phi('z_high')} AS q_high, CASE WHEN share <= 0 OR share >= 1 THEN 'percentile (BCa z0 undefined)' WHEN z_low IS NULL OR z_high IS NULL THEN 'percentile (BCa acceleration unstable)' ELSE '' END AS plain FROM zs),
bca AS (SELECT g, n, {R6.format('point')} AS point, {R6.format(value('q_low', '0.025::DOUBLE'))} AS low, {R6.format(value('q_high', '0.975::DOUBLE'))} AS high,
  CASE WHEN n < 2 THEN 'bca (insufficient n)' WHEN small = large THEN 'bca (degenerate: constant sample)' WHEN plain = '' THEN 'bca' ELSE plain END AS method FROM qs)"""


SUPPLIERS = "v AS (SELECT s_nationkey AS g, s_acctbal AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS idx FROM supplier)"
BOOT = SUPPLIERS + boot()


@query(f"WITH {BOOT} SELECT g, replicate::INTEGER AS replicate, {R6.format('mean')} AS mean FROM bm")
def t2_bootstrap_replicates(spark, d):
    return T.bootstrap_means(by_nation(spark, d), ["g"], "idx", "x", 200, 42).select("g", "replicate", settle("mean").alias("mean"))


@query(f"WITH {SUPPLIERS}{bca()} SELECT * FROM bca")
def t2_bca_bootstrap(spark, d):
    b = T.bca_bootstrap(by_nation(spark, d), ["g"], "idx", "x", 200, 42)
    return b.select("g", "n", settle("point").alias("point"), settle("low").alias("low"), settle("high").alias("high"), "method")


def mixed(x: str) -> str:
    """The 32-bit mixing function of the tree's draws."""
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * 73244475) & 4294967295)"
    return f"xor({x}, {x} >> 16)"


#: Log of the chance that k of times draws from c rows fall on l of them, with and without replacement.
BINOMIAL = "lgamma(times + 1) - lgamma(k + 1) - lgamma(times - k + 1) + k * ln(l / c::DOUBLE) + (times - k) * ln((c - l) / c::DOUBLE)"
CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"
HYPERGEOMETRIC = f"{CHOOSE.format('l', 'k')} + {CHOOSE.format('(c - l)', '(times - k)')} - ({CHOOSE.format('c', 'times')})"


def tree(draws: int, replace: bool) -> str:
    """dealt (g, x, draw, times) from cells (g, x, c) and m (g, m): every split is looked up in its whole distribution."""
    span = "range(0, times + 1)" if replace else "range(greatest(0, times - (c - l)), least(times, l) + 1)"
    possible = "" if replace else "AND times <= c"
    return f""",
numbered AS MATERIALIZED (SELECT g, x, c, row_number() OVER (PARTITION BY g ORDER BY x) - 1 AS number FROM cells),
top AS (SELECT greatest(1, ceil(log2(max(number) + 1)))::BIGINT AS top FROM numbered),
nodes AS MATERIALIZED (SELECT g, height, number >> height AS node, sum(c)::BIGINT AS c FROM (SELECT g, number, c, unnest(range(0, top + 1)) AS height FROM numbered, top) GROUP BY ALL),
splits AS MATERIALIZED (
  SELECT p.g, p.height, p.node, p.c, coalesce(l.c, 0) AS l, ('0x' || substr(md5(concat_ws('|', 42, p.g, p.height, p.node)), 1, 8))::BIGINT AS base
  FROM nodes p LEFT JOIN nodes l ON l.g = p.g AND l.height = p.height - 1 AND l.node = 2 * p.node WHERE p.height > 0),
sized AS (SELECT DISTINCT l, c, times FROM (SELECT l, c, unnest(range(1, m + 1)) AS times FROM splits JOIN m USING (g) WHERE l > 0 AND l < c) WHERE true {possible}),
chances AS (SELECT *, exp({BINOMIAL if replace else HYPERGEOMETRIC}) AS p FROM (SELECT l, c, times, unnest({span}) AS k FROM sized)),
law AS MATERIALIZED (
  SELECT l, c, times, min(k) AS low, max(k) AS high, list(f ORDER BY k) AS reached
  FROM (SELECT *, sum(p) OVER (PARTITION BY l, c, times ORDER BY k) AS f FROM chances) GROUP BY l, c, times),
rep AS (SELECT range AS draw, {mixed('(range + 1)')} AS h FROM range({draws})),
split AS (
  SELECT m.g, top AS height, 0::BIGINT AS node, draw, h, m::BIGINT AS times FROM m, top, rep
  UNION ALL
  SELECT g, height - 1, 2 * node + side, draw, h, CASE WHEN side = 0 THEN b ELSE times - b END FROM (
    SELECT g, height, node, draw, h, times,
      CASE WHEN l = 0 THEN 0 WHEN l = c THEN times ELSE least(high, low + len(list_filter(reached, lambda y: y <= u))) END AS b
    FROM (
      SELECT t.*, s.l, s.c, w.low, w.high, w.reached, {mixed('xor(t.h, s.base)')} / 4294967296::DOUBLE AS u
      FROM split t JOIN splits s ON s.g = t.g AND s.height = t.height AND s.node = t.node
      LEFT JOIN law w ON w.l = s.l AND w.c = s.c AND w.times = t.times)), (VALUES (0), (1)) e(side)
  WHERE CASE WHEN side = 0 THEN b ELSE times - b END > 0),
dealt AS (SELECT s.g, n.x, s.draw, s.times FROM split s JOIN numbered n ON n.g = s.g AND n.number = s.node WHERE s.height = 0)"""


RESAMPLED = f"WITH RECURSIVE {SUPPLIERS}, cells AS (SELECT g, x, count(*) AS c FROM v GROUP BY ALL), m AS (SELECT g, count(*) AS m FROM v GROUP BY g)" + tree(10_000, True)


@query(f"""{RESAMPLED}, bm AS (SELECT g, draw, sum(times * x) / sum(times) AS mean FROM dealt GROUP BY ALL),
pt AS (SELECT g, count(*) AS n, avg(x) AS point, min(x) AS small, max(x) AS large FROM v GROUP BY g),
dv AS (SELECT v.g, (x - point) / (n - 1) AS dev FROM v JOIN pt USING (g) WHERE n > 1),
ac AS (SELECT pt.g, coalesce(CASE WHEN sum(dev * dev) > 0 THEN sum(dev * dev * dev) / (6 * pow(sum(dev * dev), 1.5)) END, 0) AS a FROM pt LEFT JOIN dv ON dv.g = pt.g GROUP BY pt.g)
{corrected(10_000)} SELECT * FROM bca""")
def t2_bca_by_counts(spark, d):
    """Intervals of each nation's mean balance from 10,000 resamples, drawn as counts of distinct values."""
    b = T.bca_interval(by_nation(spark, d), ["g"], "x", R.MEAN, 10_000, 42)
    return b.select("g", "n", settle("point").alias("point"), settle("low").alias("low"), settle("high").alias("high"), "method")


@query(f"""{RESAMPLED}, placed AS (SELECT g, draw, x, times, sum(times) OVER (PARTITION BY g, draw ORDER BY x) - times AS before, sum(times) OVER (PARTITION BY g, draw) AS n FROM dealt),
bm AS (SELECT g, draw, (max(x) FILTER (before <= (n - 1) // 2 AND (n - 1) // 2 < before + times) + max(x) FILTER (before <= n // 2 AND n // 2 < before + times)) / 2 AS mean FROM placed GROUP BY ALL),
pt AS (SELECT g, count(*) AS n, median(x) AS point, min(x) AS small, max(x) AS large FROM v GROUP BY g),
lo AS (SELECT a.g, a.idx, median(b.x) AS theta FROM v a JOIN v b ON a.g = b.g AND a.idx <> b.idx GROUP BY ALL),
dv AS (SELECT g, avg(theta) OVER (PARTITION BY g) - theta AS dev FROM lo),
ac AS (SELECT pt.g, coalesce(CASE WHEN sum(dev * dev) > 0 THEN sum(dev * dev * dev) / (6 * pow(sum(dev * dev), 1.5)) END, 0) AS a FROM pt LEFT JOIN dv ON dv.g = pt.g GROUP BY pt.g)
{corrected(10_000)} SELECT * FROM bca""")
def t2_bca_of_median(spark, d):
    """The same resamples with the median as the statistic."""
    b = T.bca_interval(by_nation(spark, d), ["g"], "x", R.MEDIAN, 10_000, 42)
    return b.select("g", "n", settle("point").alias("point"), settle("low").alias("low"), settle("high").alias("high"), "method")


GAP = "sum(((s - {0}) / na - {0} / nb) * (na + nb)) / sum(na + nb)"


@query(f"""WITH RECURSIVE {GROUPS}, bins AS (SELECT bin AS g, count(*) FILTER (grp = 'en') AS na, count(*) FILTER (grp = 'fr') AS nb, sum(value) AS s, sum(value) FILTER (grp = 'fr') AS sb FROM g GROUP BY bin HAVING na >= 3 AND nb >= 3),
cells AS (SELECT bin AS g, value AS x, count(*) AS c FROM g WHERE bin IN (SELECT g FROM bins) GROUP BY ALL), m AS (SELECT g, nb AS m FROM bins){tree(10_000, False)},
o AS (SELECT {GAP.format('sb')} AS observed, count(*) AS bins FROM bins), sums AS (SELECT g, draw, sum(times * x) AS ds FROM dealt GROUP BY ALL), gaps AS (SELECT draw, {GAP.format('ds')} AS gap FROM sums JOIN bins USING (g) GROUP BY draw)
SELECT {R6.format('any_value(observed)')} AS observed, any_value(bins) AS bins, {R6.format('(count(*) FILTER (abs(gap) >= abs(observed) - 1e-9) + 1) / 10001.0::DOUBLE')} AS p FROM gaps, o""")
def t13_permutation_by_counts(spark, d):
    """The gap of two languages within bins of length against 10,000 new deals of their labels, drawn as counts of distinct values."""
    p = R.permuted_gap(two_groups(spark, d), "grp", "en", "fr", "value", 10_000, 42)
    return p.select(settle("observed").alias("observed"), "bins", settle("p").alias("p"))


@query(f"WITH {SUPPLIERS}, s AS (SELECT g, count(*) AS n, sum(x) AS s FROM v GROUP BY g), l AS (SELECT g, s / n - (s - x) / (n - 1) AS dev FROM v JOIN s USING (g) WHERE n > 1) SELECT g, {R6.format('CASE WHEN sum(dev * dev) > 0 THEN sum(dev * dev * dev) / (6 * pow(sum(dev * dev), 1.5)) ELSE 0 END')} AS acceleration FROM l GROUP BY g")
def t3_jackknife_acceleration(spark, d):
    rows = by_nation(spark, d)
    s = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
    dev = F.col("s") / F.col("n") - (F.col("s") - F.col("x")) / (F.col("n") - 1)
    out = rows.join(s, "g").filter("n > 1").groupBy("g").agg(F.sum(dev * dev).alias("d2"), F.sum(dev * dev * dev).alias("d3"))
    return out.select("g", settle(F.when(F.col("d2") > 0, F.col("d3") / (6 * F.pow("d2", F.lit(1.5)))).otherwise(0.0)).alias("acceleration"))


DELTAS = "v AS (SELECT n_regionkey AS g, round(s_acctbal - s_suppkey, 6) AS x, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) - 1 AS idx FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"WITH {DELTAS}{bca()} SELECT g AS n_regionkey, n, point, low, high, method FROM bca")
def t5_bca_paired_delta(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select("n_regionkey", F.round(F.col("s_acctbal") - F.col("s_suppkey"), 6).alias("delta"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("s_suppkey")).alias("k"))
    b = T.bca_bootstrap(rows.select("n_regionkey", "delta", (F.col("k") - 1).alias("idx")), ["n_regionkey"], "idx", "delta", 200, 42)
    return b.select("n_regionkey", "n", settle("point").alias("point"), settle("low").alias("low"), settle("high").alias("high"), "method")


#: Student's two-sided p of t >= 0 with df degrees, th being atan(t / sqrt(df)).
T_P = "1 - CASE WHEN df = 1 THEN 2 * th / pi() WHEN df % 2 = 1 THEN 2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, (df - 3) // 2 + 1), lambda k: pow(cos(th), 2 * k + 1) * exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2))))) ELSE sin(th) * list_sum(list_transform(range(0, (df - 2) // 2 + 1), lambda k: pow(cos(th), 2 * k) * exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1)))) END"


@query(f"""WITH s AS (SELECT l_returnflag, unnest(['quantity', 'price', 'discount']) AS predictor, unnest([l_quantity, l_extendedprice, l_discount]) AS x, l_tax AS y FROM lineitem), t AS (SELECT l_returnflag || '/' || predictor AS k, x, y FROM s),
{RANKS.format(by='k', x='x', y='y', source='t')}, c AS (SELECT k, count(*) AS n, corr(rx, ry) AS r FROM rk GROUP BY k), u AS (SELECT k, n, r, n - 2 AS df, atan(abs(r) / sqrt(1 - r * r)) AS th FROM c),
q AS (SELECT 'all' AS family, k, n, {R6.format('r')} AS rho, {R6.format(T_P)} AS p FROM u), {HOLM.format(f='family', src='q')} SELECT k, n, rho, p, {R6.format('p_holm')} AS p_holm FROM h""")
def t16_correlation_sweep(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.expr("stack(3, 'quantity', l_quantity, 'price', l_extendedprice, 'discount', l_discount) as (predictor, x)"), F.col("l_tax").alias("y"))
    rows = rows.withColumn("k", F.concat_ws("/", "l_returnflag", "predictor"))
    found = T.spearman(rows, "x", "y", ["k"]).select("k", F.lit("all").alias("family"), "n", settle("rho").alias("rho"), settle("p").alias("p"))
    return T.holm(found, "p", ["family"]).select("k", "n", "rho", "p", settle("p_holm").alias("p_holm"))


WILSON = "({p} + {z} * {z} / (2 * n) {s} {z} * sqrt({p} * (1 - {p}) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)"
CUSTOMERS = "c AS (SELECT c_nationkey AS nation, c_acctbal AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx FROM customer WHERE c_acctbal IS NOT NULL), v AS (SELECT nation || '|value' AS g, x, idx FROM c)"


@query(f"""WITH {CUSTOMERS}{bca()}, w AS (SELECT nation, count(*)::DOUBLE AS n, count(*) FILTER (x >= 4500)::DOUBLE AS k FROM c GROUP BY nation)
SELECT nation, 'exact' AS metric, n::BIGINT AS n, {R6.format('k / n')} AS point, {R6.format('CASE WHEN k = 0 THEN 0 ELSE ' + WILSON.format(p='(k / n)', z=Z, s='-') + ' END')} AS low, {R6.format('CASE WHEN k = n THEN 1 ELSE ' + WILSON.format(p='(k / n)', z=Z, s='+') + ' END')} AS high, 'wilson' AS method FROM w
UNION ALL SELECT split_part(g, '|', 1)::INTEGER, 'value', n, point, low, high, method FROM bca""")
def t15_metric_interval(spark, d):
    """Intervals of two metrics of each nation's customers: whether the balance reaches 4500, and the balance."""
    rows = table(spark, d, "customer").filter("c_acctbal is not null")
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = rows.select(F.col("c_nationkey").alias("nation"), k.alias("idx"), F.col("c_acctbal").alias("x"))
    stacked = rows.select("nation", "idx", F.explode(F.create_map(F.lit("exact"), (F.col("x") >= 4500).cast("double"), F.lit("value"), F.col("x").cast("double"))).alias("metric", "x"))
    b = T.metric_interval(stacked, ["nation"], "idx", "x", ["exact"], 200, 42)
    return b.select("nation", "metric", "n", settle("point").alias("point"), settle("low").alias("low"), settle("high").alias("high"), "method")
