"""Question-set operators bound to documents, conversations, customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query, table
from quillon.functions import numeric as N
from quillon.functions import text as T
from quillon.operators import datasets as D
from quillon.operators.ranges import checkpointed


def norm_sql(x: str) -> str:
    """The normalization in DuckDB; articles are replaced twice, as matches share separators."""
    article = r"'(^|[^\p{L}\p{N}\p{M}_])(a|an|the)($|[^\p{L}\p{N}\p{M}_])', '\1 \3', 'g'"
    plain = rf"regexp_replace(replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ'), '\p{{P}}', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({plain}, {article}), {article}), '\s+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({norm_sql(x)}, ' '), lambda t: t <> '')"


def md5_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({' || \':\' || '.join(parts)}), 1, 15))::BIGINT"


@query(f"SELECT doc_id, {norm_sql('text')} AS normalized FROM documents")
def normalize_answer_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize("text").alias("normalized"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = T.tokens("text")
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS first_line FROM documents WHERE trim(text) <> ''")
def first_line_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("trim(text) <> ''").select("doc_id", T.first_line(F.col("text")).alias("first_line"))


_PREFIXED = "CASE conv_id % 4 WHEN 0 THEN 'Answer: ' WHEN 1 THEN 'a:' WHEN 2 THEN 'The answer is ' ELSE '' END || text"


@query(f"SELECT conv_id, turn, regexp_replace(trim({_PREFIXED}), '(?i)^(answer:|a:|the answer is)\\s*', '') AS answer FROM conversations")
def prefix_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.strip_answer_prefix(F.expr(_PREFIXED)).alias("answer"))


@query(
    f"""SELECT min(doc_id) AS first_id, CAST(count(*) - 1 AS BIGINT) AS collapsed, CAST(count(DISTINCT source) AS BIGINT) AS n_aliases
    FROM (SELECT doc_id, source, {norm_sql('text')} AS nq FROM documents) GROUP BY nq"""
)
def dedup_normalized_docs(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("dataset"), F.col("text").alias("question"), F.array("source").alias("gold_answers"))
    return D.merge_duplicates(q).select(F.col("qid").alias("first_id"), "collapsed", F.size("gold_answers").cast("long").alias("n_aliases"))


@query(
    f"""WITH d AS (SELECT doc_id, source, {norm_sql('text')} AS nq FROM documents)
    SELECT doc_id, source FROM d WHERE nq NOT IN (SELECT nq FROM d GROUP BY nq HAVING count(DISTINCT source) > 1)"""
)
def ambiguous_group_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    return D.drop_ambiguous(table(spark, sf, "documents"), "text", "source", ["doc_id", "source"])


@query(
    f"""SELECT CAST(count(*) AS BIGINT) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM
    (SELECT count(*) AS n FROM (SELECT source, {norm_sql('text')} AS nq FROM documents) GROUP BY nq HAVING count(DISTINCT source) > 1)"""
)
def ambiguity_report(spark: SparkSession, sf: str) -> DataFrame:
    return D.ambiguity_counts(table(spark, sf, "documents"), "text", "source")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.9) FROM customer WHERE c_mktsegment = 'BUILDING')")
def popularity_quantile_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").withColumn("pop", F.col("c_acctbal").cast("string"))
    return D.restrict_popular(c, "pop", 0.9).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def relation_in_filter(spark: SparkSession, sf: str) -> DataFrame:
    return D.restrict_categories(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority")


@query(
    """WITH c AS (SELECT conv_id, turn, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations)
    SELECT conv_id, turn FROM c WHERE len(w) >= 8 AND len(regexp_split_to_array(trim(text), '\\s+')) <= 20 AND len(regexp_split_to_array(trim(w[1]), '\\s+')) <= 4"""
)
def easy_slice_filter(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(F.split("text", " "), lambda x: x != "")
    return table(spark, sf, "conversations").withColumn("w", words).where(D.looks_easy(F.col("text"), F.col("w"), least_aliases=8)).select("conv_id", "turn")


@query(
    f"""WITH d AS (SELECT doc_id, ' ' || {norm_sql('text')} || ' ' AS n FROM documents), b AS (SELECT item_id, ' ' || {norm_sql('text')} || ' ' AS n FROM benchmark)
    SELECT doc_id, item_id FROM d JOIN b ON contains(d.n, b.n)"""
)
def benchmark_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Items stated in documents."""
    return D.stated_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(f"WITH d AS (SELECT doc_id, {norm_sql('text')} AS n FROM documents) SELECT doc_id FROM d WHERE doc_id IN (SELECT doc_id FROM labels) AND n IN (SELECT n FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def few_shot_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents, as the few shots, whose text also stands among the unlabelled."""
    d, l = checkpointed(table(spark, sf, "documents").select("doc_id", F.sha2(T.normalize("text"), 256).alias("n"))), table(spark, sf, "labels").select("doc_id")  # normalized once
    return d.join(l, "doc_id", "left_semi").join(d.join(l, "doc_id", "left_anti").select("n"), "n", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 < 0.2")
def hash_audit_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("qid"))
    return D.audit_sample(d, 0.2).select("doc_id")


@query(f"SELECT doc_id FROM documents ORDER BY {md5_sql(chr(39) + '17' + chr(39), 'CAST(doc_id AS VARCHAR)')}, CAST(doc_id AS VARCHAR) LIMIT 50")
def hash_sample_n(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("qid"))
    return D.hash_sample(d, 50, 17).select("doc_id")


@query("SELECT substr(sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))), 1, 16) AS digest FROM labels")
def row_set_digest(spark: SparkSession, sf: str) -> DataFrame:
    return D.row_set_digest(table(spark, sf, "labels"), "doc_id")


@query(
    f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {md5_sql("'5'", 'CAST(doc_id AS VARCHAR)')}, doc_id) AS rn FROM labels)
    SELECT doc_id, quality FROM r ORDER BY rn > 30, rn, quality LIMIT 60"""
)
def balanced_validation_sample(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels").select("doc_id", "quality")
    return D.balanced_sample(l, 60, 5, label="quality", classes=(0, 1), key="doc_id").select("doc_id", "quality")


@query(
    """WITH s AS (SELECT doc_id, doc_id % 2 = 0 AS in_a, doc_id % 3 = 0 AS in_b FROM labels), k AS (SELECT count(*) FILTER (in_a AND in_b) AS shared FROM s),
    r AS (SELECT doc_id, CASE WHEN in_a AND in_b THEN 0 WHEN in_a THEN 1 ELSE 2 END AS part FROM s WHERE in_a OR in_b),
    n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id) AS rn FROM r)
    SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(row_number() OVER (ORDER BY part, doc_id) AS INTEGER) AS step FROM n, k WHERE part = 0 OR rn <= (CASE part WHEN 1 THEN 80 ELSE 70 END) - shared"""
)
def label_plan(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "labels").select("doc_id", (F.col("doc_id") % 2 == 0).alias("in_a"), (F.col("doc_id") % 3 == 0).alias("in_b"))
    return D.label_plan(s, 80, 70, key="doc_id").select("doc_id", "part", "step")


@query(f"SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY {md5_sql(chr(39) + '31337' + chr(39), 'CAST(doc_id AS VARCHAR)')}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return D.stratified_folds(table(spark, sf, "labels").withColumn("y", F.col("quality") == 0), 5, 31337, key="doc_id").select("doc_id", "fold")


@query(
    """WITH t AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n FROM conversations)
    SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY n ORDER BY conv_id * 1000 + turn) - 1) // 4 AS INTEGER) AS bucket FROM t"""
)
def length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").withColumns({"n": F.size(F.split("text", " ")), "pos": F.col("conv_id") * 1000 + F.col("turn")})
    return D.length_buckets(t, "n", 4, "pos").select("conv_id", "turn", "bucket")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without a label."""
    return D.not_done(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), key="doc_id")


_ALIASES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _spaced(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


_SIZE = "len(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


@query(
    f"""WITH d AS (SELECT doc_id, source, text, string_split(text, ' ') AS al FROM documents), e AS (SELECT doc_id, source, al[1:6] AS al, array_to_string(al[4:9], ' ') AS question FROM d WHERE text IS NOT NULL), w AS (SELECT *, unnest(al) AS a FROM e),
    p AS (SELECT doc_id, list({_spaced('a')}) AS plain FROM w GROUP BY doc_id), f AS (SELECT e.*, coalesce(plain, []) AS plain, {_spaced('question')} AS q FROM e LEFT JOIN p USING (doc_id)),
    g AS (SELECT *, len(list_filter(plain, lambda a: a <> '' AND contains(' ' || q || ' ', ' ' || a || ' '))) > 0 AS leak,
      len(list_filter(plain, lambda a: len(list_filter(plain, lambda b: a <> b AND ({_SIZE.format(x='a')} - {_SIZE.format(x='b')} > 2 OR (b <> '' AND contains(' ' || a || ' ', ' ' || b || ' '))))) > 0)) > 0 AS granular FROM f)
    SELECT source, CAST(count(*) AS BIGINT) AS candidates, round(avg(len(al)), 3) AS mean_aliases, CAST(median(len(al)) AS DOUBLE) AS median_aliases, round(avg(CAST(len(al) = 1 AS DOUBLE)), 3) AS single_alias_fraction,
           round(avg(CAST(leak AS DOUBLE)), 3) AS leak_fraction, round(avg(CAST(granular AS DOUBLE)), 3) AS granularity_fraction, arg_min(question, doc_id) AS example FROM g GROUP BY source"""
)
def gold_quality(spark: SparkSession, sf: str) -> DataFrame:
    """A document's first words as aliases, the words around them as the question."""
    words = F.split("text", " ")
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "source", F.array_join(F.slice(words, 4, 6), " ").alias("question"), F.slice(words, 1, 6).alias("gold_answers"))
    return D.gold_quality(d, "source", "doc_id").select("source", "candidates", F.round("mean_aliases", 3).alias("mean_aliases"), F.col("median_aliases").cast("double"), "single_alias_fraction", "leak_fraction", "granularity_fraction", "example")


_ASKED = "'What is ' || n_name || ' the capital of?'"
_TOLD = "CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' city' ELSE 'elsewhere' END"


@query(
    f"""WITH n AS (SELECT n_nationkey, lower(n_name) AS s, lower({_TOLD}) AS a FROM nation)
    SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (a = s) AS BIGINT) AS answer_exact,
           CAST(count(*) FILTER (a <> s AND (contains(' ' || a || ' ', ' ' || s || ' ') OR contains(' ' || s || ' ', ' ' || a || ' '))) AS BIGINT) AS answer_contained,
           CAST(count(*) FILTER (n_nationkey % 2 = 0) AS BIGINT) AS alias_exact, CAST(count(*) FILTER (a = s AND n_nationkey % 2 = 0) AS BIGINT) AS credited_echoes FROM n"""
)
def echo_report(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    even = F.col("n_nationkey") % 2 == 0
    rows = n.select(F.expr(_ASKED).alias("question"), F.expr(_TOLD).alias("greedy_answer"), F.when(even, F.array("n_name")).otherwise(F.array(F.lit("other"))).alias("gold_answers"), F.when(even, "correct").otherwise("incorrect").alias("label"))
    return D.echo_report(rows)


@query("WITH c AS (SELECT role AS template, count(*) AS n FROM conversations GROUP BY 1) SELECT max_by(template, (n, template)) AS template, round(max(n) / sum(n), 9) AS share, max(n) / sum(n) <= 0.4 AS within FROM c".replace("max_by(template, (n, template))", "first(template ORDER BY n DESC, template DESC)"))
def template_share(spark: SparkSession, sf: str) -> DataFrame:
    return D.template_share(table(spark, sf, "conversations"), F.col("role")).withColumn("share", F.round("share", 9))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, len(json_keys(props)) AS n_keys FROM events".replace("len(json_keys(props))", "CAST(len(json_keys(props)) AS INTEGER)"))
def json_props_explode(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).alias("n_keys"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3")
def events_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    from quillon.streaming.incremental import window_counts

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = window_counts(e).withColumn("total", F.round("total", 6))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def context_left_joins(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    r = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, sf, "supplier").join(n, "s_nationkey", "left").join(r, "n_regionkey", "left").select("s_suppkey", "n_name", "r_name")


@query(
    """WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM labels WHERE toxic = 0)
    SELECT 'intersection' AS op, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
    SELECT 'union', CAST(count(*) AS BIGINT) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'difference', CAST(count(*) AS BIGINT) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def judged_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels")
    a, b = l.where("quality = 1").select("doc_id"), l.where("toxic = 0").select("doc_id")
    count = lambda name, df: df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    return count("intersection", a.intersect(b)).unionByName(count("union", a.union(b).distinct())).unionByName(count("difference", b.exceptAll(a)))


@query("SELECT doc_id, row_number() OVER (ORDER BY quality, CASE WHEN toxic = 1 THEN 0 ELSE 1 END, doc_id) AS place FROM labels".replace("row_number()", "CAST(row_number()").replace("doc_id) AS place", "doc_id) AS INTEGER) AS place"))
def priority_order(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("moved"))
    return D.placed_by(l, "quality", F.when(F.col("moved"), 0).otherwise(1), "doc_id").select("doc_id", "place")


@query("WITH w AS (SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM labels), z AS (SELECT 1.959963984540054::DOUBLE AS z, n::DOUBLE AS n, k::DOUBLE AS k FROM w) SELECT round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM z")
def wilson_rate(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    return w.select(N.wilson(F.col("k"), F.col("n")).alias("w")).select(F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))
