"""Queries on sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkweave.operators import segment as S
from sparkweave.operators import reports as A
from sparkweave.queries.base import SEQS, query
from sparkweave.queries.fragments import MIXED, cut, frags, primaries, seqs
from sparkweave.sources import sequences as Q
from sparkweave.sources.sequences import table

DESCRIPTION = "seq_id || ' OS=' || coalesce(grp, 'none') || ' GN=g' || (seq_id % 1000)"


@query(f"WITH {SEQS} SELECT seq_id::VARCHAR AS id, {DESCRIPTION} AS description, coalesce(grp, 'none') AS organism, 'g' || (seq_id % 1000) AS gene, seq AS sequence FROM seqs")
def io1_fasta_round_trip(spark, d):
    """Write all sequences as FASTA and scan them again."""
    s = seqs(spark, d)
    text = F.concat(F.col("seq_id").cast("string"), F.lit(" OS="), F.coalesce("grp", F.lit("none")), F.lit(" GN=g"), (F.col("seq_id") % 1000).cast("string"))
    path = Q.shared_folder(spark, "fasta")
    Q.fasta_sink(s.select(F.col("seq_id").cast("string").alias("id"), text.alias("description"), F.col("seq").alias("sequence")), path)
    return Q.fasta_scan(spark, path)


@query(f"WITH {MIXED}, u AS (SELECT seq_id, string_agg(fragment, ',' ORDER BY place) AS fragments, count(*)::INTEGER AS num_fragments FROM placed GROUP BY seq_id) SELECT seq_id, seq AS target, md5(fragments) AS fragments_md5, num_fragments FROM seqs JOIN u USING (seq_id)")
def io3_fragment_jsonl_round_trip(spark, d):
    path = Q.shared_folder(spark, "fragments")
    Q.fragment_jsonl_sink(S.records_in_rows(cut(spark, d), 42), path)
    return Q.fragment_jsonl_scan(spark, path).select("seq_id", "target", F.md5(F.array_join("fragments", ",")).alias("fragments_md5"), "num_fragments")


@query(f"WITH {SEQS} SELECT seq_id FROM seqs ORDER BY md5('42|' || seq_id), seq_id LIMIT 100")
def io4_sample_records(spark, d):
    """A seeded sample of 100 records: the operator's own limit."""
    s = seqs(spark, d)
    path = Q.shared_folder(spark, "pool")
    Q.fragment_jsonl_sink(s.select("seq_id", F.col("seq").alias("target")), path)
    return Q.fragment_jsonl_scan(spark, path, 100, 42).select("seq_id")


@query("SELECT l_orderkey AS k, l_returnflag AS flag, l_discount AS x, NULL::INTEGER AS late FROM lineitem UNION ALL SELECT o_orderkey, o_orderstatus, NULL, (o_totalprice > 100000)::INTEGER FROM orders")
def io9_rows_csv_round_trip(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("x"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("flag"), (F.col("o_totalprice") > 100000).alias("late"))
    path = Q.shared_folder(spark, "csv")
    Q.rows_csv_sink([a, b], path)
    return spark.read.option("header", True).schema("k long, flag string, x double, late int").csv(path)


@query("WITH l AS (SELECT text AS target, doc_id AS line, string_split(text, ' ') AS fragments, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS r FROM documents WHERE text IS NOT NULL) SELECT line, length(target) AS length, len(fragments)::INTEGER AS num_fragments, list_sum(list_transform(fragments, lambda x: length(x)))::BIGINT AS letters FROM l WHERE r = 1")
def io10_load_pool(spark, d):
    lines = table(spark, d, "documents").filter("text is not null").select(F.col("text").alias("target"), F.col("doc_id").alias("line"), F.split("text", " ").alias("fragments"))
    p = Q.latest_record(lines)
    return p.select("line", F.col("length").cast("long").alias("length"), "num_fragments", F.aggregate("fragment_lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("letters"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= floor(count(*) OVER () * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM documents")
def io12_train_test_split(spark, d):
    return Q.train_test_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2, 42)


PATTERNS = ["the", "que", "und", "zzzz"]


@query(f"WITH m AS (SELECT CASE {' '.join(f'''WHEN contains(text, '{p}') THEN '{p}' ''' for p in PATTERNS)} END AS pattern FROM documents) SELECT p.pattern, count(m.pattern) AS n FROM (SELECT unnest({PATTERNS}) AS pattern) p LEFT JOIN m USING (pattern) GROUP BY ALL")
def pf1_filter_by_patterns(spark, d):
    first = F.coalesce(*(F.when(F.col("text").contains(p), F.lit(p)) for p in PATTERNS))
    hits = table(spark, d, "documents").select(first.alias("pattern")).filter("pattern is not null").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(p,) for p in PATTERNS], "pattern string").join(hits, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '//([^/]+)', 1), ''), page_id::VARCHAR) AS key FROM pages")
def pf2_key_or_id(spark, d):
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("url", "//([^/]+)", 1), F.lit("")), F.col("page_id").cast("string")).alias("key"))


@query("SELECT c_mktsegment, c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r = 1")
def pf3_dedupe_first(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))


@query(f"WITH {SEQS} SELECT grp, count(*) FILTER (regexp_full_match(seq, '[ACDEFGHIKLMNPQRSTVWY]*')) AS inside, count(*) FILTER (NOT regexp_full_match(seq, '[ACDEFGHIKLMNPQRSTVWY]*')) AS outside FROM seqs GROUP BY grp")
def pf4_alphabet_profile(spark, d):
    inside = F.col("seq").rlike("^[ACDEFGHIKLMNPQRSTVWY]*$")
    return seqs(spark, d).groupBy("grp").agg(F.count(F.when(inside, 1)).alias("inside"), F.count(F.when(~inside, 1)).alias("outside"))


@query(f"WITH {SEQS}, l AS (SELECT DISTINCT grp, unnest(string_split(seq, '')) AS letter FROM seqs) SELECT grp, string_agg(letter, '' ORDER BY letter) AS letters FROM l GROUP BY grp")
def pf4_letters_seen(spark, d):
    """The letters of each language's sequences, in order."""
    letters = seqs(spark, d).select("grp", F.explode(F.array_distinct(F.split("seq", ""))).alias("letter")).filter("letter <> ''").distinct()
    return letters.groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set("letter")), "").alias("letters"))


@query("SELECT l_returnflag, count(*) AS n, count(CASE WHEN l_discount > 0 AND l_tax > 0 THEN 1 END) AS usable FROM lineitem GROUP BY 1")
def pf8_clean_pairs(spark, d):
    from sparkweave.functions.stats import finite

    a, b = F.when(F.col("l_discount") > 0, F.col("l_discount")).otherwise(float("nan")), F.when(F.col("l_tax") > 0, F.col("l_tax")).otherwise(float("inf"))
    both = finite(a).isNotNull() & finite(b).isNotNull()
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(both, 1)).alias("usable"))


@query("SELECT l_orderkey, list_sort(list(l_linenumber)) = range(1, count(*) + 1) AS clean FROM lineitem GROUP BY 1")
def pf9_is_clean_permutation(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("o"))
    return rows.select("l_orderkey", (F.col("o") == F.sequence(F.lit(1), F.size("o"))).alias("clean"))


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, n - least(n, 3) AS hidden FROM r WHERE n <= 3 OR k <= 2 OR k > n - 1")
def pf11_display_samples(spark, d):
    of = Window.partitionBy("conv_id")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(of.orderBy("turn")).alias("k"), F.count(F.lit(1)).over(of).alias("n"))
    return rows.filter("n <= 3 or k <= 2 or k > n - 1").select("conv_id", "turn", (F.col("n") - F.least("n", F.lit(3))).alias("hidden"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, CASE WHEN n > 30 THEN n - 20 ELSE 0 END AS hidden FROM r WHERE n <= 30 OR k <= 15 OR k > n - 5")
def pf11_display_thirty(spark, d):
    """Up to 30 events of a user, else the first 15 and the last 5."""
    return A.display_samples(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("""WITH r AS (SELECT l_orderkey AS k, count(*) AS lines, bool_or(l_returnflag = 'R') AS control FROM lineitem GROUP BY 1)
SELECT o_orderpriority AS run, max((o_orderdate, o_orderkey))[2] AS latest, count(*) AS candidates FROM orders JOIN r ON k = o_orderkey WHERE lines = 3 AND control GROUP BY 1""")
def pf12_resolve_runs(spark, d):
    """The latest order of each priority among those with three lines, one of them returned (which stands for the control arm)."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.bool_or(F.col("l_returnflag") == "R").alias("control"))
    rows = table(spark, d, "orders").join(lines.filter("lines = 3 and control"), "o_orderkey", "left_semi")
    found = rows.groupBy(F.col("o_orderpriority").alias("run")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"), F.count(F.lit(1)).alias("candidates"))
    return found.select("run", F.col("x.o_orderkey").alias("latest"), "candidates")


@query("SELECT lang, bool_or(quality IS NOT NULL) AS has_quality, bool_or(toxic = 1) AS has_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def pf13_arms_present(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.bool_or(F.col("quality").isNotNull()).alias("has_quality"), F.bool_or(F.col("toxic") == 1).alias("has_toxic"))


@query(f"WITH {MIXED}, n AS (SELECT seq_id, count(*) AS n FROM prim GROUP BY seq_id) SELECT seq_id, n AS fragments, round(length(seq) / n::DOUBLE + 1e-10, 6) AS mean_length, length(seq) AS length FROM seqs JOIN n USING (seq_id)")
def pf17_shape_predictors(spark, d):
    from sparkweave.functions.rounding import settle

    n = primaries(spark, d).groupBy("seq_id").agg(F.count(F.lit(1)).alias("fragments"))
    return seqs(spark, d).join(n, "seq_id").select("seq_id", "fragments", settle(F.length("seq") / F.col("fragments")).alias("mean_length"), F.length("seq").cast("long").alias("length"))


@query("SELECT n_nationkey, count(s_suppkey) AS suppliers, n_regionkey NOT IN (SELECT r_regionkey FROM region) AS orphan FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def j11_pool_lookup(spark, d):
    nation, supplier, region = (table(spark, d, t) for t in ("nation", "supplier", "region"))
    orphans = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_anti").select(F.col("n_nationkey").alias("o"))
    rows = nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(orphans, F.col("o") == F.col("n_nationkey"), "left")
    return rows.groupBy("n_nationkey").agg(F.count("s_suppkey").alias("suppliers"), F.max(F.col("o").isNotNull()).alias("orphan"))
