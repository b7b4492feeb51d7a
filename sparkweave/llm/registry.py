"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import bpe, centroid_blocks, chat_format, collocations, debruijn, hmm, mixing, near_vectors, simhash, suffix_array, token_counts, toxicity, va_search
from sparkweave.llm.common import read


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(read(spark, sf_dir, "embeddings"), 0.93)


def op2_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.digests(debruijn.without_earlier(read(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), *_vocabulary())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, radius=2)


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), (5.0, 2.0, 1.0)).select("doc_id", "size", "source_size", "target", "taken")


def op7_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.digests(suffix_array.without_repeats(read(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), *_vocabulary())


def op11_centroid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_blocks.cluster(read(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more whose texts hold the template's own control strings."""
    tricky = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.format_chats(rows.withColumn("parts", chat_format.text_parts(F.col("text")))))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), least=100, limit=2000)


#: All pairs within a label, and reachability through links by recursion.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
reach(u, w) AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE u = v.vec_id) AS n_links,
  least(v.vec_id, coalesce((SELECT min(w) FROM reach WHERE u = v.vec_id), v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce((SELECT min(w) FROM reach WHERE u = v.vec_id), v.vec_id)) AS kept
FROM v
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""



def _op11_sql(rounds: int = 10) -> str:
    """Every vector against every centroid, round by round."""
    distance = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = ""
    for r in range(rounds + 1):
        steps += f""",
d{r} AS (SELECT id, vec_id, k, {distance} AS d FROM kept, c{r}),
a{r} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, min(d) AS d, arg_min(k, d * 8 + k) AS k FROM d{r} GROUP BY id)"""
        if r < rounds:
            steps += f""",
s{r} AS (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{r} JOIN kept USING (id), range(1, 65) t(i) GROUP BY k, i),
n{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN n{r} n USING (k))"""
    last = f"a{rounds}"
    return f"""
WITH ok AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM ok),
c0 AS MATERIALIZED (
  SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS k, v AS c FROM kept) WHERE k < 8){steps},
i AS (SELECT k, sum(d)::BIGINT AS cluster_inertia FROM {last} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, cluster_inertia, (SELECT sum(d) FROM {last})::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {last} JOIN i USING (k) JOIN c{rounds} USING (k)
"""


#: The digests from the table itself; the formatted length from texts with the template's escapes.
OP12_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, length(regexp_replace(role || chr(0) || text, '([<\[])(\\*)(s>|INST\]|/INST\]|/s>|image>|audio>|document>)', '\1\\\2\3', 'g')) - 1 + 20 AS size FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""

#: Every run of one to five words spelt out and counted.
OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS total FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
runs AS (SELECT lang, w[i : i + n - 1] AS w, n FROM starts, range(1, 6) t(n) WHERE i + n - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, w, any_value(n) AS n, count(*)::HUGEINT AS f FROM runs GROUP BY lang, w HAVING count(*) >= 100),
cuts AS (SELECT lang, w, n, f AS a, unnest(range(1, n)) AS k FROM f WHERE n > 1),
parts AS (
  SELECT c.lang, c.w, c.n, c.a, c.k, x.f AS l, y.f AS r, total, (1000 * c.a * total) // (x.f * y.f) AS score
  FROM cuts c JOIN totals USING (lang) JOIN f x ON x.lang = c.lang AND x.w = c.w[1 : k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1 : c.n]),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS place FROM parts),
absorbed AS (SELECT lang, w[1 : n - 1] AS w, f AS a FROM f WHERE n > 2 UNION SELECT lang, w[2 : n], f FROM f WHERE n > 2),
kept AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, total, score FROM best ANTI JOIN absorbed USING (lang, w, a) WHERE place = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_vectors, op2_debruijn, op3_token_counts, op4_simhash, op5_hmm, op6_mixing, op7_va_search, op8_suffix_array, op9_toxicity, op10_byte_bpe, op11_centroid_blocks, op12_chat_format, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_vectors": OP1_SQL, "op7_va_search": OP7_SQL, "op11_centroid_blocks": _op11_sql(), "op12_chat_format": OP12_SQL, "op13_collocations": OP13_SQL}
