"""Signals, clusters and labels bound to embeddings, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query, table
from quillon.catalog.questions import norm_sql, tokens_sql
from quillon.functions import numeric as N
from quillon.functions import text as T
from quillon.functions.bind import let
from quillon.operators import clusters as K
from quillon.operators import labels as A
from quillon.operators import signals as S
from quillon.plans import leaderboard as L

_TOKENS = """t AS (SELECT vec_id, p, [CAST(x AS DOUBLE) FOR x IN embedding[p * 8 + 1 : p * 8 + 8]] AS e FROM (SELECT vec_id, embedding, unnest(range(8)) AS p FROM embeddings)),
  z AS (SELECT vec_id, p, e, list_max(e) AS mx, ln(list_sum([exp(x - list_max(e)) FOR x IN e])) + list_max(e) AS lse FROM t),
  q AS (SELECT vec_id, p, e[1] - lse AS lp, list_reverse_sort([exp(x - lse) FOR x IN e]) AS pr FROM z)"""


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Eight token positions of eight alternatives from each embedding, as log-probabilities."""

    names = F.array(*[F.lit(str(i)) for i in range(8)])

    def scaled(e):
        sums = lambda top: F.ln(N.total(F.transform(e, lambda x: F.exp(x - top)))) + top
        return let(let(F.array_max(e), sums), lambda lse: F.transform(e, lambda x: x - lse))

    def token(p):
        e = F.transform(F.slice("embedding", p * 8 + 1, 8), lambda x: x.cast("double"))
        made = lambda lps: F.struct(p.cast("string").alias("token"), F.get(lps, F.lit(0)).alias("logprob"), F.map_from_arrays(names, lps).alias("top_logprobs"))
        return let(let(e, scaled), made)

    return table(spark, sf, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), token).alias("tokens"))


@query(
    f"""WITH {_TOKENS}, h AS (SELECT *, -list_sum([x * ln(x) FOR x IN pr]) AS ent FROM q)
    SELECT vec_id, round(-(sum(lp) / 8), 9) AS a_mean_logprob, round(-min(lp), 9) AS a_min_logprob, round(-sum(lp), 9) AS a_total_logprob, round(-sum(lp) / pow((5 + 8) / 6.0::DOUBLE, 0.6), 9) AS a_length_normalized_logprob,
           round(exp(least(-sum(lp) / 8, 20)), 9) AS a_perplexity, round(-(max(lp) FILTER (p = 0)), 9) AS a_first_token_logprob, round(avg(ent), 9) AS a_mean_top5_entropy, round(max(ent), 9) AS a_max_top5_entropy,
           round(-(max(pr[1] - pr[2]) FILTER (p = 0)), 9) AS a_first_token_margin FROM h GROUP BY vec_id"""
)
def family_a_signals(spark: SparkSession, sf: str) -> DataFrame:
    out = _tokens(spark, sf).select("vec_id", *S.orient(S.family_a(F.col("tokens"))))
    return out.select("vec_id", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


_ANSWERS = """a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
  s AS (SELECT user_id || '-' || part AS user_id, g, x FROM (SELECT user_id, k // 6 AS part, max(event_type) FILTER (k % 6 = 0) AS g, list(event_type ORDER BY k) FILTER (k % 6 > 0) AS x FROM a GROUP BY user_id, k // 6 HAVING count(*) >= 2))"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every six consecutive events of a user: the first as the greedy answer, the others as samples; a last set of one event has none."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    placed = table(spark, sf, "events").select("user_id", "event_type", k.alias("k")).withColumn("part", F.floor(F.col("k") / 6))
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("k", "event_type"))), lambda s: s["event_type"])
    sets = placed.groupBy("user_id", "part").agg(all_.alias("all")).where(F.size("all") >= 2)
    return sets.select(F.concat_ws("-", "user_id", "part").alias("qid"), F.get("all", F.lit(0)).alias("greedy_norm"), F.slice("all", 2, 5).alias("samples_norm"))


@query(
    f"""WITH {_ANSWERS} SELECT user_id AS qid, round(len(list_filter(x, lambda v: v <> g)) / len(x)::DOUBLE, 9) AS disagreement, CAST(len(list_distinct(list_append(x, g))) AS DOUBLE) AS distinct_count,
    round(len(list_distinct(list_append(x, g))) / (len(x) + 1)::DOUBLE, 9) AS distinct_fraction, round(1 - list_max([len(list_filter(x, lambda v: v = u)) FOR u IN x]) / len(x)::DOUBLE, 9) AS plurality_disagreement FROM s"""
)
def family_b_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<int>")
    raw = S.family_b(F.col("greedy_norm"), F.col("samples_norm"), none, none)
    names = {"b_disagreement_rate": "disagreement", "b_distinct_count": "distinct_count", "b_distinct_fraction": "distinct_fraction", "b_disagreement_rate_samples_only": "plurality_disagreement"}
    return _answers(spark, sf).select("qid", *[F.round(raw[k].cast("double"), 9).alias(v) for k, v in names.items()])


@query(
    f"""WITH {_ANSWERS}, n AS (SELECT user_id, unnest([1, 2, 3, 5]) AS level, g, x FROM s), c AS (SELECT user_id, level, g, x[1:level] AS x FROM n)
    SELECT level, user_id AS qid, round(len(list_filter(x, lambda v: v <> g)) / len(x)::DOUBLE, 9) AS score FROM c"""
)
def ablation_levels(spark: SparkSession, sf: str) -> DataFrame:
    out = L.ablation(_answers(spark, sf), [1, 2, 3, 5]).where("signal = 'b_disagreement_rate'")
    return out.select("level", "qid", F.round("score", 9).alias("score"))


@query(
    f"""WITH {_ANSWERS}, f AS (SELECT user_id, unnest([left(v, 1) FOR v IN list_prepend(g, x)]) AS c FROM s), m AS (SELECT user_id, c, count(*) AS k FROM f GROUP BY ALL), t AS (SELECT *, sum(k) OVER (PARTITION BY user_id) AS n FROM m)
    SELECT user_id AS qid, CAST(count(*) AS INTEGER) AS n_clusters, round(-sum(k / n * ln(k / n)) + 0.0, 9) AS entropy FROM t GROUP BY user_id"""
)
def semantic_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Scripted entailment: answers with the same first letter mean the same."""

    def scorer(frames):
        for pdf in frames:
            yield pdf.assign(entail=(pdf["premise"].str[:1] == pdf["hypothesis"].str[:1]).astype(float))

    sets = _answers(spark, sf).withColumn("answers", F.concat(F.array("greedy_norm"), F.col("samples_norm")))
    scored = K.score_pairs(K.answer_pairs(sets, "answers"), scorer)
    out = K.attach_scores(sets, scored, "answers").withColumn("clusters", K.cluster(F.col("answers"), F.col("entailment")))
    sizes = K.cluster_sizes(F.col("clusters"))
    return out.select("qid", F.size(sizes).alias("n_clusters"), F.round(N.cluster_entropy(sizes) + 0.0, 9).alias("entropy"))


@query()
def clustering_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy against exhaustive clustering on hash-sampled rows, chained by neighbouring first letters."""

    def scorer(frames):
        for pdf in frames:
            yield pdf.assign(entail=((pdf["premise"].str[:1].map(ord) - pdf["hypothesis"].str[:1].map(ord)).abs() <= 3).astype(float))

    sets = _answers(spark, sf).withColumn("answers", F.concat(F.array("greedy_norm"), F.col("samples_norm")))
    out = K.attach_scores(sets, K.score_pairs(K.answer_pairs(sets, "answers"), scorer), "answers")
    out = out.withColumns({"g": K.cluster(F.col("answers"), F.col("entailment"), "greedy"), "x": K.cluster(F.col("answers"), F.col("entailment"))})
    return K.clustering_audit(out, "g", "x", N.hash_share(F.col("qid").cast("string")) < 0.5)


@query(
    f"""WITH c AS (SELECT conv_id, turn, {tokens_sql('text')} AS t FROM conversations), p AS (SELECT a.conv_id, a.t AS x, b.t AS y FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn),
    f AS (SELECT conv_id, CASE WHEN len(x) + len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE 2.0 * list_sum([least(len(list_filter(x, lambda v: v = u)), len(list_filter(y, lambda v: v = u))) FOR u IN list_distinct(x)]) / (len(x) + len(y)) END AS f1 FROM p),
    k AS (SELECT conv_id, count(*) AS n FROM c GROUP BY 1) SELECT k.conv_id, round(coalesce(avg(f1), 1.0)::DOUBLE, 9) AS mean_f1 FROM k LEFT JOIN f USING (conv_id) GROUP BY k.conv_id"""
)
def pairwise_f1(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.normalize("text").alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda s: s["t"])
    return c.groupBy("conv_id").agg(texts.alias("ts")).select("conv_id", F.round(T.mean_pairwise_f1(F.col("ts")), 9).alias("mean_f1"))


_ASK = f"""SELECT a.conv_id, a.turn, {norm_sql('a.text')} AS q, {norm_sql('b.text')} AS full_ FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """A turn as the question, parts of the next one as answer and aliases; every branch of the cascade occurs."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.normalize("text").alias("n"))
    q, b = c.withColumnRenamed("n", "q"), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("full_"))
    rows = q.join(b, ["conv_id", "turn"]).withColumns({"qt": F.split("q", " "), "ft": F.split("full_", " ")})
    part = lambda c, i, n: F.array_join(F.slice(c, i, n), " ")
    kind = F.col("conv_id") % 5
    answer = F.when(kind == 0, part("ft", 2, 1)).when(kind == 1, F.concat_ws(" ", part("qt", 1, 2), part("ft", 1, 2))).when(kind == 2, part("qt", 1, 2)).when(kind == 3, part("ft", 1, 2)).otherwise(part("ft", 1, 5))
    return rows.select("conv_id", "turn", F.col("q").alias("question"), answer.alias("answer"), F.array(part("ft", 1, 2), part("ft", 2, 3)).alias("gold"))


_NEG = "[" + ", ".join(f"'{w}'" for w in A.NEGATIONS) + "]"
_COVERED = "list_contains(qt, {t}) OR (length({t}) > 1 AND {t}[-1] = 's' AND list_contains(qt, {t}[1:-2]))"
_ALL_COVERED = "len(list_filter({x}, lambda t: NOT (" + _COVERED.format(t="t") + "))) = 0"


#: The rule in SQL: CTEs ending in ``w`` (conv_id, turn, qt, an, at_, gs, restated), and the label of such a row.
CASCADE = f"""k AS ({_ASK}), p AS (SELECT conv_id, turn, q, string_split(q, ' ') AS qs, string_split(full_, ' ') AS fs FROM k),
    m AS (SELECT conv_id, turn, list_filter(qs, lambda t: t <> '') AS qt, CASE conv_id % 5 WHEN 0 THEN fs[2:2] WHEN 1 THEN qs[1:2] || fs[1:2] WHEN 2 THEN qs[1:2] WHEN 3 THEN fs[1:2] ELSE fs[1:5] END AS araw, [fs[1:2], fs[2:4]] AS graw FROM p),
    n0 AS (SELECT conv_id, turn, qt, {norm_sql("array_to_string(araw, ' ')")} AS an, [{norm_sql("array_to_string(g, ' ')")} FOR g IN graw] AS gn FROM m),
    n AS (SELECT conv_id, turn, qt, an, list_filter(string_split(an, ' '), lambda t: t <> '') AS at_, list_filter(gn, lambda g: g <> '') AS gs FROM n0),
    w AS (SELECT *, len(list_filter(gs, lambda g: contains(' ' || an || ' ', ' ' || g || ' ') AND g <> an AND
        (len(list_filter(string_split(regexp_replace(' ' || an || ' ', ' ' || g || ' ', ' ')[2:], ' '), lambda t: t <> '' AND NOT ({_COVERED.format(t='t')}))) = 0))) > 0 AS restated FROM n)"""
CASCADE_LABEL = f"""CASE WHEN len(at_) = 0 THEN 'incorrect' WHEN list_contains(gs, an) THEN 'correct' WHEN restated THEN CASE WHEN len(list_intersect(qt, {_NEG})) > 0 THEN 'ambiguous' ELSE 'correct' END
      WHEN {_ALL_COVERED.format(x='at_')} THEN 'incorrect' WHEN len(list_filter(gs, lambda g: g <> an AND contains(' ' || g || ' ', ' ' || an || ' '))) > 0 THEN 'ambiguous'
      WHEN len(list_filter(gs, lambda g: contains(' ' || an || ' ', ' ' || g || ' '))) > 0 THEN 'ambiguous' ELSE 'incorrect' END"""


@query(f"WITH {CASCADE} SELECT conv_id, turn, {CASCADE_LABEL} AS label FROM w")
def fuzzy_label_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("conv_id", "turn", A.fuzzy_label(F.col("answer"), F.col("gold"), F.col("question")).alias("label"))


@query(
    """WITH p AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'quite sure' ELSE (n_chars % 130)::VARCHAR || '%' END AS raw FROM documents),
    v AS (SELECT CASE WHEN raw <> 'quite sure' AND replace(raw, '%', '')::INT <= 100 THEN replace(raw, '%', '')::INT / 100.0::DOUBLE END AS c FROM p), m AS (SELECT round(c, 4) AS c4, count(*) AS k FROM v WHERE c IS NOT NULL GROUP BY 1)
    SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (c IS NULL) AS BIGINT) AS n_parse_failures, round(avg(c), 9) AS mean, round(stddev_pop(c), 9) AS std, round((SELECT max(k) / sum(k) FROM m)::DOUBLE, 9) AS modal_share FROM v"""
)
def verbal_parse_health(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 7 == 0, "quite sure").otherwise(F.concat((F.col("n_chars") % 130).cast("string"), F.lit("%")))
    parsed = table(spark, sf, "documents").select((-T.parse_confidence(raw)).alias("c_verbal_confidence"))
    out = L.confidence_health(parsed)
    return out.select("n", "n_parse_failures", *[F.round(c, 9).alias(c) for c in ("mean", "std", "modal_share")])


@query(
    f"""SELECT doc_id, CAST(len({tokens_sql('text')}) AS DOUBLE) AS t_answer_length, ('0x' || substr(sha256('0:' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 AS t_random FROM documents"""
)
def family_t_signals(spark: SparkSession, sf: str) -> DataFrame:
    raw = S.family_t(F.col("doc_id").cast("string"), F.lit(""), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", raw["t_answer_length"].alias("t_answer_length"), raw["t_random"].alias("t_random"))


_VERDICT = "CASE conv_id % 4 WHEN 0 THEN 'INCORRECT.' WHEN 1 THEN 'Correct, because' WHEN 2 THEN 'I think correct' ELSE 'AMBIGUOUS!' END"


@query(f"WITH v AS (SELECT nullif(regexp_extract({norm_sql(_VERDICT)}, '^(incorrect|correct|ambiguous)\\b', 1), '') AS verdict FROM conversations) SELECT coalesce(verdict, 'none') AS verdict, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1")
def verdict_parse(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "conversations").select(T.parse_verdict(F.expr(_VERDICT)).alias("v"))
    return v.groupBy(F.coalesce("v", F.lit("none")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT vec_id, round(CASE WHEN vec_id % 9 <> 0 THEN 1 / (1 + exp(CAST(embedding[2] AS DOUBLE) - CAST(embedding[1] AS DOUBLE))) END, 9) AS p_true FROM embeddings"""
)
def p_true_renormalized(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", F.round(N.p_true(F.when(F.col("vec_id") % 9 != 0, at(0)), at(1)), 9).alias("p_true"))


@query("SELECT CASE WHEN turn % 2 = 0 THEN 'greedy' ELSE 'sample' END AS kind, round(avg(length(text)), 9) AS mean_tokens, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1")
def token_means(spark: SparkSession, sf: str) -> DataFrame:
    made = F.struct(F.lit(0).alias("prompt_tokens"), F.length("text").alias("completion_tokens"))
    c = table(spark, sf, "conversations")
    none = F.array().cast("array<struct<prompt_tokens:int,completion_tokens:int>>")
    rows = c.select(F.when(F.col("turn") % 2 == 0, made).alias("greedy"), F.when(F.col("turn") % 2 != 0, F.array(made)).otherwise(none).alias("samples"))
    return L.token_means(rows).withColumn("mean_tokens", F.round("mean_tokens", 9))


_COSTED = ", ".join(f"('{c.name}', '{c.name[0].upper()}')" for c in S.catalog())


@query(
    f"""WITH m AS (SELECT avg(length(text)) FILTER (turn % 2 = 0) AS g, avg(length(text)) FILTER (turn % 2 <> 0) AS s FROM conversations), t AS (SELECT avg(value) AS v FROM events),
    r AS (SELECT col0 AS signal, col1 AS family, CASE col1 WHEN 'B' THEN 5.0 WHEN 'C' THEN 1.0 ELSE 0.0 END::DOUBLE AS extra FROM (VALUES {_COSTED}))
    SELECT signal, family, 1 + extra AS cost_multiplier, extra AS extra_model_calls, round(CASE family WHEN 'B' THEN 5 * s WHEN 'C' THEN NULL ELSE 0.0 END::DOUBLE, 6) AS extra_tokens,
           round((1 + CASE family WHEN 'B' THEN 5 * s WHEN 'C' THEN NULL ELSE 0.0 END / g)::DOUBLE, 6) AS token_multiplier, round((v * extra + CASE WHEN family = 'B' THEN v / 10 ELSE 0.0 END)::DOUBLE, 6) AS extra_seconds FROM r, m, t"""
)
def signal_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Costs of the registered signals at the mean lengths of the conversations' turns and the mean value of the events as seconds."""
    made = F.struct(F.lit(0).alias("prompt_tokens"), F.length("text").alias("completion_tokens"))
    none = F.array().cast("array<struct<prompt_tokens:int,completion_tokens:int>>")
    rows = table(spark, sf, "conversations").select(F.when(F.col("turn") % 2 == 0, made).alias("greedy"), F.when(F.col("turn") % 2 != 0, F.array(made)).otherwise(none).alias("samples"))
    tokens = {r["kind"]: r["mean_tokens"] for r in L.token_means(rows).collect()}  # two rows
    seconds = table(spark, sf, "events").agg(F.avg("value")).first()[0]
    out = L.cost_table(S.catalog_table(spark), 5, greedy_tokens=tokens.get("greedy"), sample_tokens=tokens.get("sample"), generate_s=seconds, family_b_s=seconds / 10 if seconds is not None else None)
    return out.withColumns({c: F.round(c, 6) for c in ("extra_tokens", "token_multiplier", "extra_seconds")})


@query(
    f"""WITH {CASCADE}, l AS (SELECT CAST(conv_id % 2 AS VARCHAR) AS dataset, {CASCADE_LABEL} AS label FROM w)
    SELECT dataset, CAST(0 AS BIGINT) AS abstain, CAST(count(*) FILTER (label = 'correct') AS BIGINT) AS correct, CAST(count(*) FILTER (label = 'ambiguous') AS BIGINT) AS unresolved,
           CAST(count(*) FILTER (label = 'incorrect') AS BIGINT) AS incorrect FROM l GROUP BY dataset"""
)
def base_rate_probe(spark: SparkSession, sf: str) -> DataFrame:
    label = A.fuzzy_label(F.col("answer"), F.col("gold"), F.col("question"))
    rows = _asked(spark, sf).select((F.col("conv_id") % 2).cast("string").alias("dataset"), label.alias("label"))
    return A.base_rate_probe(rows.withColumn("source", F.when(F.col("label") == "ambiguous", "heuristic_unresolved").otherwise("heuristic_fuzzy")))


