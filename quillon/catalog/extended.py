"""Contrasts, restatements, label errors, samples-only signals, figures and fingerprints over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import ORACLE_SQL, query, table
from quillon.catalog.audits import _answered
from quillon.catalog.features import _ALL_COVERED, _ANSWERS, _COVERED, _answers, _asked, CASCADE
from quillon.catalog.inference import SEED, draws_sql
from quillon.catalog.questions import norm_sql, tokens_sql
from quillon.catalog.ranking import _MATRIX, SCORES, auroc_sql, r9, scores, wide_scores
from quillon.operators import datasets as D
from quillon.operators import labels as A
from quillon.operators import merkle
from quillon.operators import metrics as M
from quillon.operators import signals as S
from quillon.operators.exact import exact_sums
from quillon.operators.quantiles import quantiles
from quillon.plans import compare as C
from quillon.plans import leaderboard as L

LEVELS, FEW = [1, 3, 5], 500
_LEVEL_SIGNALS = ("b_disagreement_rate", "b_distinct_count", "b_distinct_fraction")


def _judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answer sets, wrong where the first answer is rarer among all events than the median one."""
    share = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return _answers(spark, sf).join(F.broadcast(share), F.col("greedy_norm") == F.col("event_type")).withColumn("y", (F.col("n") + F.length("qid")) % 2 == 0).drop("n", "event_type")  # a row per type


_JUDGED = f"{_ANSWERS}, n0 AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), j AS (SELECT user_id AS qid, g, x, (n + length(user_id)) % 2 = 0 AS y FROM s JOIN n0 ON g = event_type)"
_ABLATED = f"""{_JUDGED}, a0 AS (SELECT qid, y, g, level, x[1:level] AS x FROM (SELECT *, unnest({LEVELS}) AS level FROM j)),
  a1 AS (SELECT qid, y, level, len(list_filter(x, lambda v: v <> g)) / len(x)::DOUBLE AS d, len(list_distinct(list_append(x, g)))::DOUBLE AS c, len(list_distinct(list_append(x, g))) / (len(x) + 1)::DOUBLE AS f FROM a0),
  arms AS MATERIALIZED (SELECT qid, y, level, unnest({list(_LEVEL_SIGNALS)}) AS signal, unnest([d, c, f]) AS score FROM a1)"""


@query(
    f"""WITH {_ABLATED}, {draws_sql('j', resamples=FEW)}, d AS (SELECT w.r, a.signal, a.level, a.score, a.y, w.w FROM arms a JOIN w USING (qid)), v AS (SELECT * FROM {auroc_sql('r, signal, level', 'd', 'w')}), p AS (SELECT * FROM {auroc_sql('signal, level', 'arms')}),
    pairs AS (SELECT * FROM (VALUES (1, 3), (3, 5), (1, 5)) t(low, high)),
    t AS (SELECT a.signal, low, high, a.auroc - b.auroc AS delta, a.n AS n_paired FROM pairs JOIN p a ON a.level = low JOIN p b ON b.level = high AND a.signal = b.signal),
    e AS (SELECT a.signal, low, high, a.auroc - b.auroc AS d FROM pairs JOIN v a ON a.level = low JOIN v b ON b.level = high AND a.signal = b.signal AND a.r = b.r),
    k AS (SELECT signal, low, high, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high, count(*) FILTER (CASE WHEN delta >= 0 THEN d <= 0 ELSE d >= 0 END) AS tail, count(*) AS total FROM e JOIN t USING (signal, low, high) GROUP BY ALL),
    h AS (SELECT *, least(1.0, 2.0 * (tail + 1) / (total + 1))::DOUBLE AS p_value FROM t JOIN k USING (signal, low, high)), o AS (SELECT *, row_number() OVER (ORDER BY p_value, signal, low, high) AS rn, count(*) OVER () AS m FROM h)
    SELECT signal, CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high, round(delta, 9) AS delta, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(p_value, 9) AS p_value, CAST(n_paired AS BIGINT) AS n_paired,
           round(least(1.0, max((m - rn + 1) * p_value) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING)), 8) AS p_holm FROM o"""
)
def ablation_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Each number of samples against the largest and its neighbour, for every signal of answer sets."""
    long = L.ablation(_judged_answers(spark, sf), LEVELS).where(F.col("signal").isin(*_LEVEL_SIGNALS))
    out = L.ablation_differences(long, LEVELS, L.Options(resamples=FEW, seed=SEED)).withColumn("p_holm", F.round("p_holm", 8))
    return r9(out.select("signal", "low", "high", "delta", "ci_low", "ci_high", "p_value", "n_paired", "p_holm"), "delta", "ci_low", "ci_high", "p_value")


def _restated(spark: SparkSession, sf: str) -> DataFrame:
    """The scores and two restatements: ``words`` cubed, ``chars`` reversed."""
    s = scores(spark, sf)
    more = s.where(F.col("signal").isin("words", "chars")).withColumns({"score": F.when(F.col("signal") == "words", F.pow("score", F.lit(3.0))).otherwise(-F.col("score")), "signal": F.concat(F.lit("re_"), "signal")})
    return s.unionByName(more)


_RESTATED = f"""{SCORES.replace('scores AS MATERIALIZED', 'scores0 AS MATERIALIZED')}, scores AS MATERIALIZED (SELECT * FROM scores0 UNION ALL
  SELECT qid, stratum, row_pos, y, toxic, 're_' || signal, CASE WHEN signal = 'words' THEN pow(score, 3.0) ELSE -score END FROM scores0 WHERE signal IN ('words', 'chars'))"""


@query(f"WITH {_RESTATED}, {_MATRIX} SELECT a, b, CAST(n AS BIGINT) AS n, coalesce(abs(abs(rho) - 1) < 1e-12, false) AS rank_equivalent, CASE WHEN rho > 0 THEN 'same' WHEN rho < 0 THEN 'reversed' END AS direction FROM m WHERE a <> b")
def duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return C.duplicate_pairs(M.spearman_matrix(_restated(spark, sf))).select("a", "b", "n", "rank_equivalent", "direction")


@query(f"WITH {_RESTATED}, {_MATRIX} SELECT CAST(count(*) AS BIGINT) AS n_independent FROM m s WHERE a = b AND NOT EXISTS (SELECT 1 FROM m t WHERE t.b = s.a AND t.a < t.b AND abs(abs(t.rho) - 1) < 1e-12)")
def independent_signals(spark: SparkSession, sf: str) -> DataFrame:
    return C.independent_signals(M.spearman_matrix(_restated(spark, sf)))


@query(f"WITH {_RESTATED}, {_MATRIX} SELECT a, b, round(rho, 8) AS rho FROM m WHERE a = 'distinct' AND b = 'words'")
def spearman_between(spark: SparkSession, sf: str) -> DataFrame:
    a, b = sorted(("words", "distinct"))
    value = C.spearman_between(M.spearman_matrix(_restated(spark, sf)), b, a)
    return spark.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.lit(value), 8).alias("rho"))


@query(
    f"""WITH {_RESTATED}, b AS (SELECT *, CAST(row_number() OVER (ORDER BY auroc DESC, signal) AS INTEGER) AS rank FROM {auroc_sql('signal')}), {_MATRIX},
    e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, abs(abs(rho) - 1) < 1e-12 AS same FROM m), dec AS (SELECT * FROM (VALUES ('re_words', 'words'), ('re_chars', 'chars'), ('random', 'distinct')) t(signal, twin))
    SELECT b.signal, b.rank, coalesce(e.same, false) AS dropped, dec.twin IS NOT NULL AS testable FROM b LEFT JOIN dec USING (signal) LEFT JOIN e ON e.a = least(dec.signal, dec.twin) AND e.b = greatest(dec.signal, dec.twin)"""
)
def distinct_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The ranking without declared restatements; one declaration here is wrong and is found out."""
    s = _restated(spark, sf)
    declared = spark.createDataFrame([("re_words", "words"), ("re_chars", "chars"), ("random", "distinct")], "signal string, rank_equivalent_to string")
    return L.distinct_ranking(s, L.ranking(s, []), declared).select("signal", "rank", "dropped", "testable")


@query(
    f"""WITH {SCORES}, {_MATRIX}, med AS (SELECT median(words) AS med FROM wide), h2 AS (SELECT distinct_ AS score, y, words <= med AS part FROM wide, med), a AS (SELECT * FROM {auroc_sql('part', 'h2')})
    SELECT 'distinct' AS leader, false AS leader_is_length, round((SELECT rho FROM m WHERE a = 'distinct' AND b = 'words'), 8) AS rho_with_length, round(min(auroc), 9) AS worst_stratum_auroc,
           min(auroc) > 0.55 AND count(*) FILTER (auroc IS NULL) = 0 AS survives FROM a"""
)
def length_confound(spark: SparkSession, sf: str) -> DataFrame:
    out = L.length_confound(scores(spark, sf), "distinct", "words", "chars")
    return r9(out.withColumn("rho_with_length", F.round("rho_with_length", 8)), "worst_stratum_auroc")


_ERRORS = f"""{CASCADE}, o AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'correct' ELSE 'incorrect' END AS label, list_filter(gs, lambda g: contains(' ' || an || ' ', ' ' || g || ' ') AND
    len(list_filter(string_split(regexp_replace(' ' || an || ' ', ' ' || g || ' ', ' ')[2:], ' '), lambda t: t <> '' AND NOT ({_COVERED.format(t='t')}))) = 0) AS inside FROM w),
  told AS (SELECT *, CASE WHEN label = 'correct' AND len(at_) > 0 AND {_ALL_COVERED.format(x='at_')} THEN 'echo_fp' WHEN label = 'incorrect' AND len(inside) > 0 THEN 'verbose_fn' END AS pattern FROM o)"""


def _stated(spark: SparkSession, sf: str) -> DataFrame:
    return _answered(spark, sf).withColumn("label", F.when(F.col("conv_id") % 2 == 0, "correct").otherwise("incorrect"))


@query(f"WITH {_ERRORS} SELECT conv_id, turn, label, pattern FROM told")
def label_error_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that look wrong: echoes called right, verbose answers called wrong."""
    return A.error_patterns(_stated(spark, sf)).select("conv_id", "turn", "label", "pattern")


@query(
    f"""WITH {_ERRORS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (pattern = 'echo_fp') AS BIGINT) AS n_echo_fp, CAST(count(*) FILTER (pattern = 'verbose_fn') AS BIGINT) AS n_verbose_fn,
    round(avg((pattern IS NOT NULL)::INT), 9) AS error_rate_lower_bound FROM told"""
)
def label_error_floor(spark: SparkSession, sf: str) -> DataFrame:
    return r9(A.error_floor(_stated(spark, sf)), "error_rate_lower_bound")


@query(f"WITH {_ERRORS} SELECT conv_id, turn, list_max([{{'n': len(string_split(g, ' ')), 'alias': g}} FOR g IN inside]).alias AS alias FROM told")
def longest_covered_alias(spark: SparkSession, sf: str) -> DataFrame:
    found = A.longest_covered_alias(F.col("greedy_answer"), F.col("gold_answers"), F.col("question"))
    return _answered(spark, sf).select("conv_id", "turn", found.alias("alias"))


_SETS = f"""{_ANSWERS}, b AS (SELECT user_id AS qid, list_prepend(g, x) AS all_, x FROM s), k AS (SELECT *, [len(list_filter(all_, lambda v: v = u))::DOUBLE FOR u IN list_distinct(all_)] AS ka, [len(list_filter(x, lambda v: v = u))::DOUBLE FOR u IN list_distinct(x)] AS kx FROM b),
  h AS (SELECT *, list_sum([-(c / len(all_) * ln(c / len(all_))) FOR c IN ka]) AS ha, list_sum([-(c / len(x) * ln(c / len(x))) FOR c IN kx]) AS hx FROM k)"""
_F1 = "CASE WHEN len({x}) < 2 THEN 1.0 ELSE list_sum([c * (c - 1) / 2 FOR c IN {k}]) / (len({x}) * (len({x}) - 1) / 2.0) END"
_SAMPLED = {
    "b_mean_pairwise_f1": f"-({_F1.format(x='all_', k='ka')})", "b_semantic_entropy": "ha", "b_semantic_entropy_normalized": "CASE WHEN len(all_) > 1 THEN ha / ln(len(all_)) END",
    "b_distinct_count_samples_only": "len(list_distinct(x))::DOUBLE", "b_distinct_fraction_samples_only": "len(list_distinct(x)) / len(x)::DOUBLE", "b_mean_pairwise_f1_samples_only": f"-({_F1.format(x='x', k='kx')})",
    "b_semantic_entropy_samples_only": "hx", "b_semantic_entropy_normalized_samples_only": "CASE WHEN len(x) > 1 THEN hx / ln(len(x)) END",
}


@query(f"WITH {_SETS} SELECT qid, {', '.join(f'round({v} + 0.0, 9) AS {k}' for k, v in _SAMPLED.items())} FROM h")
def family_b_sample_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement and entropy of answer sets, with and without the greedy answer; answers that are the same word mean the same."""
    sets = _answers(spark, sf).withColumn("all", F.concat(F.array("greedy_norm"), F.col("samples_norm")))
    sizes = lambda x: F.transform(F.array_distinct(x), lambda u: F.size(F.filter(x, lambda v: v == u)))
    raw = S.family_b(F.col("greedy_norm"), F.col("samples_norm"), sizes(F.col("all")), sizes(F.col("samples_norm")))
    out = sets.select("qid", *S.orient({k: raw[k] for k in _SAMPLED}))
    return out.select("qid", *[F.round(F.col(c) + 0.0, 9).alias(c) for c in _SAMPLED])


@query(
    """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 9 <> 0 THEN 1 / (1 + exp(CAST(embedding[2] AS DOUBLE) - CAST(embedding[1] AS DOUBLE))) END AS p, CASE WHEN vec_id % 5 <> 0 THEN 1 / (1 + exp(CAST(embedding[4] AS DOUBLE) - CAST(embedding[3] AS DOUBLE))) END AS q, label FROM embeddings)
    SELECT vec_id, round(-p, 9) AS c_p_true_plain, round(-q, 9) AS c_p_true_with_samples, CASE WHEN label % 3 <> 0 THEN round(-(label / 10.0::DOUBLE), 9) END AS c_verbal_confidence FROM e"""
)
def family_c_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(spark, sf).select("vec_id", *[F.round(c, 9).alias(c) for c in ("c_p_true_plain", "c_p_true_with_samples", "c_verbal_confidence")])


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    from quillon.functions import numeric as N

    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    told = lambda i, every: F.struct(N.p_true(F.when(F.col("vec_id") % every != 0, at(i)), at(i + 1)).alias("p_true"))
    raw = S.family_c(told(0, 9), told(2, 5), F.when(F.col("label") % 3 != 0, F.col("label") / 10.0))
    return table(spark, sf, "embeddings").select("vec_id", "label", *S.orient(raw))


@query(
    f"""WITH e AS ({ORACLE_SQL.get('family_c_signals', '')}), f AS (SELECT e.*, embeddings.label FROM e JOIN embeddings USING (vec_id)), s AS (SELECT unnest(['c_p_true_plain', 'c_p_true_with_samples', 'c_verbal_confidence']) AS signal, unnest([1 + c_p_true_plain, 1 + c_p_true_with_samples, 1 + c_verbal_confidence]) AS p, label < 4 AS y FROM f),
    b AS (SELECT signal, len(list_filter([i / 15.0::DOUBLE FOR i IN range(1, 15)], lambda e: e < p)) AS bin, avg(p) AS c, avg(y::INT) AS a, count(*) AS n FROM s WHERE p IS NOT NULL GROUP BY ALL) SELECT signal, round(sum(n * abs(c - a)) / sum(n), 7) AS ece FROM b GROUP BY signal"""
)
def raw_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration error before any scaling, of the signals that are probabilities."""
    v = _verified(spark, sf).select(F.col("vec_id").alias("qid"), (F.col("label") < 4).alias("y"), *[F.round(c, 9).alias(c) for c in L.PROBABILITIES])
    return L.raw_calibration(v.unpivot(["qid", "y"], list(L.PROBABILITIES), "signal", "score"), []).withColumn("ece", F.round("ece", 7))


@query(f"WITH c AS ({ORACLE_SQL['ece_bins']}) SELECT bin, n, confidence, accuracy FROM c WHERE n > 0 AND confidence IS NOT NULL AND accuracy IS NOT NULL")
def reliability_points(spark: SparkSession, sf: str) -> DataFrame:
    out = C.reliability_points(M.ece_bins(scores(spark, sf).where("signal = 'random'"), ["signal"], 10)).select("bin", "n", "confidence", "accuracy")
    return r9(out, "confidence", "accuracy")


@query(f"SELECT signal, auroc, rank FROM ({ORACLE_SQL['leader_ranking']}) WHERE rank <= 3")
def figure_panels(spark: SparkSession, sf: str) -> DataFrame:
    return r9(C.figure_panels(L.ranking(scores(spark, sf), []), 3).select("signal", "auroc", "rank"), "auroc")


@query(f"WITH c AS ({ORACLE_SQL['compare_runs']}) SELECT CAST(count(*) AS BIGINT) AS n_signals, CAST(count(*) FILTER (NOT (in_left AND in_right AND left_auroc = right_auroc)) AS BIGINT) AS n_differ, CAST(count(*) FILTER (NOT (in_left AND in_right)) AS BIGINT) AS n_one_sided FROM (SELECT *, coalesce(in_left, false) AS a, coalesce(in_right, false) AS b FROM c)")
def run_differences(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf)
    ends = lambda df: M.auroc(df, ["signal"]).select("signal", "auroc", F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"))
    return C.count_differences(C.compare_signals(ends(s), ends(s.withColumn("y", F.col("toxic")).where("signal <> 'words'"))))


@query(f"SELECT conv_id, turn, CAST(len({tokens_sql('text')}) AS DOUBLE) AS t_question_length, CAST(len({tokens_sql('role')}) AS DOUBLE) AS t_answer_length FROM conversations")
def question_lengths(spark: SparkSession, sf: str) -> DataFrame:
    raw = S.family_t(F.concat_ws("-", "conv_id", "turn"), F.col("text"), F.col("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", raw["t_question_length"].alias("t_question_length"), raw["t_answer_length"].alias("t_answer_length"))


_JOINED = "array_to_string(g, ' ')"
_KEPT = f"k AS (SELECT a.conv_id, a.turn, {norm_sql('a.text')} AS q, string_split({norm_sql('b.text')}, ' ')[1:2] AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


@query(f"WITH {_KEPT}, n AS (SELECT conv_id, turn, q, {norm_sql(_JOINED)} AS g FROM k) SELECT conv_id, turn FROM n WHERE g = '' OR NOT contains(' ' || q || ' ', ' ' || g || ' ')")
def leak_free_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that do not state the first two words of what follows them."""
    rows = _asked(spark, sf).withColumn("gold", F.slice("gold", 1, 1))
    return D.drop_leaks(rows, "question", "gold").select("conv_id", "turn")


@query("SELECT lang, CAST(count(n_chars) AS BIGINT) AS n, round(quantile_cont(n_chars::DOUBLE, 0.1), 6) AS q10, round(median(n_chars::DOUBLE), 6) AS q50, round(quantile_cont(n_chars::DOUBLE, 0.975), 6) AS q975 FROM documents GROUP BY lang")
def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = quantiles(table(spark, sf, "documents"), ["lang"], "n_chars", [0.1, 0.5, 0.975])
    return q.select("lang", "n", *[F.round(F.col("quantiles")[i], 6).alias(name) for i, name in enumerate(("q10", "q50", "q975"))])


@query("SELECT l_returnflag, CAST(count(l_extendedprice) AS BIGINT) AS n, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(30, 12))) AS DOUBLE), 4) AS total FROM lineitem GROUP BY l_returnflag")
def exactly_rounded_sums(spark: SparkSession, sf: str) -> DataFrame:
    out = exact_sums(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "n", F.round("total", 4).alias("total"))


@query(
    """WITH k AS (SELECT CAST(doc_id AS VARCHAR) AS key FROM labels), l AS (SELECT substr(sha256(key), 1, 1) AS path, sha256(string_agg(key, chr(10) ORDER BY key)) AS digest, count(*) AS n FROM k GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(path || ':' || digest, chr(10) ORDER BY path)) AS digest FROM l"""
)
def row_set_root(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.root(table(spark, sf, "labels").select(F.col("doc_id").alias("qid")), depth=1)


@query("SELECT coalesce(d.doc_id, l.doc_id)::VARCHAR AS qid, CAST(d.doc_id IS NOT NULL AS BIGINT) AS in_a, CAST(l.doc_id IS NOT NULL AS BIGINT) AS in_b FROM documents d FULL JOIN labels l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def row_set_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents have no label, found by the leaves in which the two sets differ."""
    ids = lambda name: table(spark, sf, name).select(F.col("doc_id").alias("qid"))
    return merkle.difference(ids("documents"), ids("labels"))


@query("WITH w AS (SELECT lang, quality = 0 AS y, text FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL) SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (y) AS BIGINT) AS n_incorrect, CAST(count(*) FILTER (NOT y) AS BIGINT) AS n_correct, (SELECT CAST(count(*) AS BIGINT) FROM labels WHERE toxic = 1) AS n_abstain FROM w")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    w = wide_scores(spark, sf).select("qid", "y")
    labels = table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "abstain").otherwise("correct").alias("label"))
    ends = M.auroc(scores(spark, sf), ["signal"]).withColumn("resamples", F.lit(0))
    return C.run_summary(w, labels, ends).select("n", "n_incorrect", "n_correct", "n_abstain")
