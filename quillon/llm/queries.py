"""Registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .decontaminate import find_contamination
from .hard_negatives import mine
from .html_main import extract_main_text
from .line_dedup import remove_repeated_lines
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .quality import held_out, score_quality, train
from .substring_dedup import remove_repeated_passages
from .suffix_dedup import remove_repeated_suffixes
from .topk import top_k
from .warc import round_trip
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win),
grams AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT g.doc_id, g.i, g.size, win.item_id FROM grams g JOIN win USING (size, gram)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         ('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source
), r AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER w, 0)) / ((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM r WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT min_by(level, cap / weight) AS level FROM levels WHERE level <= cap / weight),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM l)) AS target FROM r),
p AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""


def _passages(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(remove_repeated_passages(_table(spark, sf_dir, "documents"), length=50))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(remove_repeated_suffixes(_table(spark, sf_dir, "documents"), length=50))


PASSAGES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), f AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (h) WHERE doc_id > first),
kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) a ANTI JOIN cut ON a.doc_id = cut.doc_id AND a.p = cut.p
  GROUP BY a.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def near_sql(words: int, docs: str = "documents") -> str:
    """Exact classes: candidates share one of their rarest shingles (prefix filter), links are closed recursively."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM {docs}
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {words} - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words} + 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), f AS (SELECT s, count(*) AS df FROM g GROUP BY s),
o AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM g JOIN f USING (s)
), p AS (SELECT doc_id, s, n FROM o WHERE r <= n - (80 * n + 99) // 100 + 1),
sets AS (SELECT doc_id, list(s) AS l, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
k AS (
  SELECT a, b, len(list_intersect(x.l, y.l)) AS i, x.n + y.n AS t FROM c JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
), e AS (SELECT a, b FROM k WHERE 100 * i >= 80 * (t - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS x, b AS y FROM both_ways UNION SELECT r.x, e2.b FROM reach r JOIN both_ways e2 ON r.y = e2.a),
classes AS (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (doc_id)
"""


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


OP6_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).drop("url")


_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_FIVE_BITS = " || ".join(f"substr({_BASE32}, (x >> {shift} & 31) + 1, 1)" for shift in (15, 10, 5, 0))
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, t, array_to_string([{_FIVE_BITS} FOR x IN [('0x' || substr(sha1(t), 5 * i + 1, 5))::INTEGER FOR i IN range(8)]], '') AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS top FROM d)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM w
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_lines(_table(spark, sf_dir, "documents"), min_lines=3)
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''),
win AS (
  SELECT doc_id, n, i, array_to_string(l[i : i + n - 1], chr(10)) AS run
  FROM (SELECT doc_id, n, l, unnest(range(1, len(l) - n + 2)) AS i FROM d, (VALUES (1), (2), (3)) AS depths(n) WHERE len(l) >= n)
),
later AS (SELECT * FROM (SELECT doc_id, n, i, run FROM win QUALIFY row_number() OVER (PARTITION BY n, md5(run) ORDER BY doc_id, i) > 1)
          WHERE n = 3 OR len(regexp_extract_all(run, '[^\x20\x09-\x0D]+')) >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM later),
kept AS (
  SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d) a ANTI JOIN gone ON a.doc_id = gone.doc_id AND a.p = gone.p
  GROUP BY a.doc_id
)
SELECT documents.doc_id, CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(d.l), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_deleted,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), components=16, scale=64.0, shift=1_000_000)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.segments(given.unionByName(more)))


OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e') AS r, replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e') AS t FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ') + length(replace(r, ':', '\c')) + length(': ') + length(t) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), every=50, positives=5, negatives=3, window=(50, 95), scale=256.0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_exact_topk": op6_exact_topk,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_warc": op10_warc,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_hard_negatives": op13_hard_negatives,
}
#: What SQL cannot express (trees, page trees, archives) is tested against brute force, held-out accuracy or a round trip.
ORACLE_SQL = {
    "op1_decontamination": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op3_source_mixing": OP3_SQL,
    "op4_substring_dedup": PASSAGES_SQL,
    "op6_exact_topk": OP6_SQL,
    "op7_minhash_near_dedup": near_sql(2),
    "op8_suffix_array_dedup": PASSAGES_SQL,
    "op10_warc": OP10_SQL,
    "op12_chat_formatting": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
