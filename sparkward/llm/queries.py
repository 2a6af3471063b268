"""The registered queries of the operators, with their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import (
    chat_format,
    embedding_dedup,
    exact_dedup,
    genetic_packing,
    language,
    minhash_dedup,
    mixing,
    packing,
    periodic_runs,
    sharding,
    suffix_tree,
    toxicity,
    vector_codes,
)
from sparkward.llm.common import WORD, remainder

PROBE = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return suffix_tree.score_documents(docs, remainder("doc_id", 5) != 1)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    return language.predict(docs, model).withColumn("held_out", remainder("doc_id", 4) == 2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return toxicity.predict(docs, model).withColumn("held_out", remainder("doc_id", 4) == 2)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    formatted = chat_format.format_chats(turns.unionByName(probe))
    read = chat_format.read_back(formatted.select("conv_id", "formatted", "loss_mask"))
    newline = F.lit("\n")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    learned = F.array_join("loss_texts", "")
    digests = read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )
    return digests


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.link_documents(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    digits = F.transform("codes", lambda code: F.lower(F.lpad(F.hex(code), 2, "0")))
    return coded.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", "codebooks_sha256")


def op12_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genetic_packing.pack_fewest(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_periods(_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"])))
    found = found.withColumn("first", first)
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("first.start").alias("start"),
        (-F.col("first.l")).alias("length"),
        F.col("first.period").alias("period"),
        F.expr("(-1000 * first.l) div first.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; a tenth of the texts repeat a stretch of their words to the end.

    With ``h`` the ``crc32`` of the identifier in decimal (null: empty text) and ``g = h // 10``, this is so
    where ``h % 10 = 0``: of ``n`` words those from ``a = g % n`` on repeat the first
    ``1 + (n - a) // (3 + g % 8)`` of them.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})")))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("rest", F.col("n") - F.col("a"))
    rows = rows.withColumn("p", (1 + F.floor(F.col("rest") / (3 + F.col("g") % 8))).cast("int"))
    stretch = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.flatten(F.array_repeat(stretch, F.ceil(F.col("rest") / F.col("p")).cast("int")))
    changed = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), F.col("rest")))
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


_OP5_SQL = r"""
WITH RECURSIVE rows AS (
 SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), keyed AS (
 SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size,
  -ln((('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
  / (1.0 / (1.0 + 4.0 * CASE WHEN length(t) > 0 THEN
   length(regexp_replace(t, '[\p{L}\x20\x09-\x0D]+', '', 'g'))::DOUBLE / length(t) ELSE 0 END)) AS k
 FROM rows
), sources AS (
 SELECT source, sum(size)::BIGINT AS source_size,
  [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
 FROM keyed GROUP BY source
), step AS (
 SELECT 0 AS i, source, source_size, w, FALSE AS stopped FROM sources
 UNION ALL
 SELECT i + 1, source, source_size, w, stopped OR share_ >= 2.0 * source_size
 FROM (SELECT *, w * (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (stopped) OVER (), 0))
   / sum(w) FILTER (NOT stopped) OVER () AS share_ FROM step) WHERE i < 40
), final AS (
 SELECT source, source_size, CASE WHEN stopped THEN 2.0 * source_size ELSE
  w * (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (stopped) OVER (), 0))
  / sum(w) FILTER (NOT stopped) OVER () END::DOUBLE AS target
 FROM step WHERE i = 40
), epochs AS (
 SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END AS whole FROM final
), summed AS (
 SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.whole,
  e.target - e.whole * e.source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sooner
 FROM keyed d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, source, size::BIGINT AS size, source_size, target,
 (size * (whole + CASE WHEN sooner + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""

_OP6_SQL = """
WITH RECURSIVE v AS (
 SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), sound AS (
 SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
 WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND list_dot_product(e, e) > 0
), links AS (
 SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
 ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
 SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links,
 least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id,
 v.vec_id <= coalesce(c.low, v.vec_id) AS kept
FROM v
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = v.vec_id
"""

_OP8_SQL = r"""
WITH rows AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
 UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
 SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) AS role_chars,
  length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS text_chars,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS begins
 FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(text_chars + CASE WHEN begins THEN role_chars + 24 ELSE 7 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

_OP9_SQL = r"""
WITH RECURSIVE lowered AS (
 SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
 FROM documents
), sets AS (
 SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w
  ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM lowered
), shingles AS (
 SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), common AS (
 SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n
 FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
 WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
 GROUP BY ALL
), pairs AS (
 SELECT a, b FROM common WHERE 100 * n >= 80 * (na + nb - n)
), links AS (
 SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
 SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles,
 least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id,
 s.doc_id <= coalesce(c.low, s.doc_id) AS kept
FROM sets s LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = s.doc_id
"""

_OP10_SQL = r"""
WITH norm AS (
 SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM norm
"""

def _op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The rounds one after the other; distances by dot products of integers, which doubles hold exactly."""
    steps = [f"""
kept AS MATERIALIZED (
 SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
  list_transform(embedding, lambda x: floor({scale}::DOUBLE * x)::DOUBLE) AS e
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
 SELECT r, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS x FROM kept, range({parts}) t(p)
), book0 AS MATERIALIZED (
 SELECT p, r - 1 AS i, x FROM parts WHERE r <= {entries}
)"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
 SELECT a.r, a.p, min(((list_dot_product(a.x, a.x) - 2 * list_dot_product(a.x, b.x) + list_dot_product(b.x, b.x))::BIGINT
  * {entries}) + b.i) AS k FROM parts a JOIN book{k} b ON a.p = b.p GROUP BY a.r, a.p
)""")
        if k < rounds:
            steps.append(f"""mean{k} AS MATERIALIZED (
 SELECT p, i, list(m ORDER BY pos) AS x FROM (
  SELECT n.p, n.k % {entries} AS i, pos, floor(sum(a.x[pos]) / count(*)) AS m
  FROM near{k} n JOIN parts a ON a.r = n.r AND a.p = n.p, LATERAL (SELECT unnest(range(1, len(a.x) + 1)) AS pos)
  GROUP BY ALL) GROUP BY p, i
), book{k + 1} AS MATERIALIZED (
 SELECT b.p, b.i, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.i = b.i
)""")
    return "WITH" + ", ".join(steps) + f""", coded AS (
 SELECT r, string_agg(lower(printf('%02x', k % {entries})), '' ORDER BY p) AS code, sum(k // {entries})::BIGINT AS error
 FROM near{rounds} GROUP BY r
), digest AS (
 SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: v::BIGINT), ','), ',' ORDER BY p, i)) AS d FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, d AS codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_sharding": (op1_sharding, None),
    "op2_packing": (op2_packing, None),
    "op3_suffix_tree": (op3_suffix_tree, None),
    "op4_language": (op4_language, None),
    "op5_mixing": (op5_mixing, _OP5_SQL),
    "op6_embedding_dedup": (op6_embedding_dedup, _OP6_SQL),
    "op7_toxicity": (op7_toxicity, None),
    "op8_chat_format": (op8_chat_format, _OP8_SQL),
    "op9_minhash_dedup": (op9_minhash_dedup, _OP9_SQL),
    "op10_exact_dedup": (op10_exact_dedup, _OP10_SQL),
    "op11_vector_codes": (op11_vector_codes, _op11_sql()),
    "op12_genetic_packing": (op12_genetic_packing, None),
    "op13_periodic_runs": (op13_periodic_runs, None),
}
