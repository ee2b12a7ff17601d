"""Label stages, audits and agreement bound to conversations, labels and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import ORACLE_SQL, query, table
from quillon.catalog.features import _VERDICT, CASCADE, CASCADE_LABEL, _asked
from quillon.catalog.inference import _HUMAN, _KAPPA, RESAMPLES, SEED
from quillon.catalog.questions import norm_sql
from quillon.catalog.ranking import SCORES, auroc_sql, r9, scores, stored_scores, wide_scores
from quillon.functions import numeric as N
from quillon.operators import labels as A
from quillon.operators import metrics as M
from quillon.operators import resample as R
from quillon.operators import signals as S
from quillon.plans import compare as C
from quillon.plans import gates as G
from quillon.plans import leaderboard as L

_SOURCE = "CASE WHEN an = 'unknown' OR (an <> '' AND list_contains(gs, an)) THEN 'exact_match' WHEN fuzzy = 'ambiguous' THEN 'heuristic_unresolved' ELSE 'heuristic_fuzzy' END"
_LABELLED = f"{CASCADE}, f AS (SELECT *, {CASCADE_LABEL} AS fuzzy FROM w), l AS (SELECT conv_id, turn, an, gs, CASE WHEN an = 'unknown' THEN 'abstain' ELSE fuzzy END AS label, {_SOURCE} AS source FROM f)"


def _answered(spark: SparkSession, sf: str) -> DataFrame:
    qid = F.concat_ws("-", "conv_id", "turn")
    return _asked(spark, sf).select("conv_id", "turn", qid.alias("qid"), "question", F.col("gold").alias("gold_answers"), F.col("answer").alias("greedy_text"), F.col("answer").alias("greedy_answer"))


@query(f"WITH {_LABELLED} SELECT conv_id, turn, label, source FROM l")
def heuristic_labels(spark: SparkSession, sf: str) -> DataFrame:
    return A.heuristic_labels(_answered(spark, sf)).select("conv_id", "turn", "label", "source")


@query(f"WITH {_LABELLED} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (source <> 'exact_match') AS BIGINT) AS n_contested FROM l")
def contested_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answered(spark, sf)
    return rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(A.contested(rows).agg(F.count(F.lit(1)).alias("n_contested")))  # one row each


@query(
    f"""WITH {_LABELLED}, v AS (SELECT *, nullif(regexp_extract({norm_sql(_VERDICT)}, '^(incorrect|correct|ambiguous)\\b', 1), '') AS verdict FROM l)
    SELECT conv_id || '-' || turn AS qid, CASE WHEN source <> 'exact_match' AND verdict IS NOT NULL THEN verdict ELSE label END AS label,
           CASE WHEN source <> 'exact_match' AND verdict IS NOT NULL THEN 'judge_primary' ELSE source END AS source, coalesce(verdict, '') AS judge_primary_verdict FROM v"""
)
def label_stage(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answered(spark, sf)
    judge = rows.select("qid", F.expr(_VERDICT).alias("raw"))
    return A.label_rows(rows, judge).select("qid", "label", "source", "judge_primary_verdict")


@query(
    f"""WITH {_LABELLED}, o AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'correct' ELSE 'incorrect' END AS old_label, CASE WHEN conv_id % 3 = 0 THEN 'exact_match' ELSE 'heuristic_fuzzy' END AS old_source FROM l)
    SELECT conv_id || '-' || turn AS qid, old_label, CASE WHEN old_source = 'exact_match' THEN old_label ELSE label END AS new_label, old_source <> 'exact_match' AND (label <> old_label OR source <> old_source) AS moved FROM o"""
)
def relabel_moves(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answered(spark, sf)
    third = F.col("conv_id") % 3 == 0
    old = rows.select("qid", F.when(third, "correct").otherwise("incorrect").alias("label"), F.when(third, "exact_match").otherwise("heuristic_fuzzy").alias("source"))
    return A.relabel(old, rows).select("qid", "old_label", "new_label", "moved")


_TOKENS = "len(list_filter(string_split({}, ' '), lambda t: t <> ''))"


@query(
    f"""WITH {CASCADE} SELECT conv_id, turn, an <> '' AND len(list_filter(gn, lambda a: a = an OR (contains(' ' || a || ' ', ' ' || an || ' ') AND {_TOKENS.format('a')} - {_TOKENS.format('an')} <= 2))) > 0 AS strict,
    an <> '' AND len(list_filter(gn, lambda a: a <> an AND contains(' ' || a || ' ', ' ' || an || ' '))) > 0 AS swallowed FROM n0 WHERE true""".replace(" FROM n0 WHERE true", " FROM n0")
)
def strict_and_swallowed(spark: SparkSession, sf: str) -> DataFrame:
    answer, gold = F.col("greedy_answer"), F.col("gold_answers")
    return _answered(spark, sf).select("conv_id", "turn", A.strict_match(answer, gold).alias("strict"), A.swallowed(answer, gold).alias("swallowed"))


_LABEL = "CASE WHEN doc_id % 11 = 0 THEN 'ambiguous' WHEN doc_id % 7 = 0 THEN 'abstain' WHEN quality = 0 THEN 'incorrect' ELSE 'correct' END"


@query(
    f"""WITH l AS (SELECT doc_id, {_LABEL} AS label FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL),
    v AS (SELECT unnest(CASE WHEN label = 'abstain' THEN ['with_abstentions'] ELSE ['primary', 'with_abstentions'] END) AS view, label = 'incorrect' AS y FROM l WHERE label <> 'ambiguous')
    SELECT view, y, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL"""
)
def view_counts(spark: SparkSession, sf: str) -> DataFrame:
    wide = wide_scores(spark, sf).select("qid", "chars")
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("qid"), F.expr(_LABEL).alias("label"), F.lit("x").alias("source"))
    return L.views(L.analysis_rows(wide, labels)).groupBy("view", "y").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT d.doc_id::VARCHAR AS qid, CASE WHEN d.doc_id % 2 = 0 THEN d.n_chars::DOUBLE END AS a_mean_logprob, NULL::DOUBLE AS b_disagreement_rate, l.quality::DOUBLE AS t_answer_length
    FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def assembled_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Families joined in registry order; what no part holds and rows that a part lacks are null."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("qid"), "doc_id", "n_chars")
    t = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("qid"), F.col("quality").alias("t_answer_length"))
    out = S.assemble(d, d.where("doc_id % 2 = 0").select("qid", F.col("n_chars").alias("a_mean_logprob")), t)
    S.assert_coverage(out.columns[1:])
    return out.select("qid", "a_mean_logprob", "b_disagreement_rate", "t_answer_length")


@query(
    f"""WITH {SCORES}, e AS (SELECT * FROM {auroc_sql('stratum, signal')}) SELECT signal, round(sum(auroc * n) / sum(n), 9) AS auroc FROM e WHERE auroc IS NOT NULL GROUP BY signal"""
)
def weighted_mean_auroc(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.weighted_mean(M.auroc(scores(spark, sf), ["stratum", "signal"]), ["signal"], "auroc", "n"), "auroc")


@query(
    """WITH b AS (SELECT lang, avg((quality = 0)::INT) AS b, avg((quality = 0)::INT) / 4 AS e FROM documents JOIN labels USING (doc_id) GROUP BY lang)
    SELECT lang, round(CASE WHEN b > 0 AND b < 1 THEN 0.5 + (b * (1 - e) / (b * (1 - e) + (1 - b) * e) - b * e / (b * e + (1 - b) * (1 - e))) / 2 END, 9) AS ceiling FROM b"""
)
def oracle_ceilings(spark: SparkSession, sf: str) -> DataFrame:
    rate = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.avg((F.col("quality") == 0).cast("double")).alias("b"))
    return rate.select("lang", F.round(N.oracle_ceiling(F.col("b") / 4, F.col("b")), 9).alias("ceiling"))


def _sample(spark: SparkSession, sf: str) -> DataFrame:
    human = F.expr("CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 17 = 0 THEN 'maybe' WHEN quality = 0 THEN ' Incorrect' ELSE 'correct ' END")
    machine = F.when(F.col("toxic") == 1, "incorrect").otherwise("correct")
    second = F.when(F.col("doc_id") % 3 == 0, "Incorrect").otherwise(machine)
    return table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), human.alias("human_label"), machine.alias("machine_label"), second.alias("heuristic_verdict"))


@query(
    f"""WITH s AS (SELECT qid, lower(trim(human_label)) AS h, machine_label AS m1, CASE WHEN qid % 3 = 0 THEN 'incorrect' ELSE machine_label END AS m2 FROM ({_HUMAN})),
    rated AS (SELECT unnest(['machine_label', 'heuristic_verdict']) AS machine, h AS a, unnest([m1, m2]) AS b FROM s WHERE h IN ('correct', 'incorrect'))
    SELECT machine, CAST(n AS BIGINT) AS n, CAST(g AS BIGINT) AS n_agree, round(kappa, 9) AS kappa FROM {_KAPPA.format(by='machine,', w='1', source='rated', group='GROUP BY machine', keys='machine, c', join='JOIN q USING (machine)')}"""
)
def machine_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return r9(C.machine_agreement(_sample(spark, sf)).select("machine", "n", "n_agree", "kappa"), "kappa")


@query(f"SELECT qid FROM ({_HUMAN}) WHERE lower(trim(human_label)) IN ('correct', 'incorrect') AND lower(trim(human_label)) <> machine_label")
def human_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return C.disagreements(_sample(spark, sf))


_P = "(n_nationkey * 37 % 25) / 250.0::DOUBLE"
_HOLM = "least(1.0, max((m - rn + 1) * p) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING))"
_FAMILY = "(SELECT signal, p, row_number() OVER (ORDER BY p, signal) AS rn, count(*) OVER () AS m FROM t {where})"


@query(
    f"""WITH t AS (SELECT n_name AS signal, {_P} AS p FROM nation), f AS (SELECT signal, {_HOLM} AS a FROM {_FAMILY.format(where='')}), d AS (SELECT signal, {_HOLM} AS a FROM {_FAMILY.format(where="WHERE signal NOT IN ('CHINA', 'FRANCE')")})
    SELECT signal, round(f.a, 9) AS p_full, round(d.a, 9) AS p_distinct, d.a IS NULL AS dropped, coalesce((f.a <= 0.05) <> (d.a <= 0.05), false) AS verdict_changed FROM f LEFT JOIN d USING (signal)"""
)
def holm_comparison(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "nation").select(F.col("n_name").alias("signal"), (F.col("n_nationkey") * 37 % 25 / F.lit(250.0)).alias("p_value"))
    return r9(C.holm_comparison(t, ["CHINA", "FRANCE"]).select("signal", "p_full", "p_distinct", "dropped", "verdict_changed"), "p_full", "p_distinct")


@query(
    f"""WITH b AS ({ORACLE_SQL['bootstrap_auroc_ci_hash']}), h AS ({ORACLE_SQL['hanley_mcneil_ci']}), g AS (SELECT greatest(abs(analytic_low - ci_low), abs(analytic_high - ci_high)) AS gap,
    (ci_low > 0.5 OR ci_high < 0.5) <> (analytic_low > 0.5 OR analytic_high < 0.5) AS differ FROM b JOIN h USING (signal)) SELECT CAST(count(*) AS BIGINT) AS n, round(max(gap), 7) AS max_gap, round(avg(gap), 7) AS mean_gap, CAST(count(*) FILTER (differ) AS BIGINT) AS n_disagree FROM g"""
)
def method_agreement(spark: SparkSession, sf: str) -> DataFrame:
    s = stored_scores(spark, sf)
    both = C.analytic_intervals(M.auroc(s, ["signal"])).join(R.bootstrap_auroc(s, RESAMPLES, SEED).select("signal", "ci_low", "ci_high"), "signal")
    return C.method_agreement(both).select("n", F.round("max_gap", 7).alias("max_gap"), F.round("mean_gap", 7).alias("mean_gap"), "n_disagree")


@query(f"SELECT 'random_baseline_ci_contains_chance' AS name, ci_low <= 0.5 AND ci_high >= 0.5 AS passed FROM ({ORACLE_SQL['bootstrap_auroc_ci_hash']}) WHERE signal = 'random'")
def random_baseline_gate(spark: SparkSession, sf: str) -> DataFrame:
    ci = R.bootstrap_auroc(stored_scores(spark, sf), RESAMPLES, SEED)
    return G.random_baseline(ci.withColumn("signal", F.when(F.col("signal") == "random", G.RANDOM_SIGNAL).otherwise(F.col("signal")))).select("name", "passed")


@query(f"WITH {SCORES} SELECT substr(sha256(string_agg(qid, chr(10) ORDER BY qid)), 1, 16) AS digest FROM wide")
def frozen_set(spark: SparkSession, sf: str) -> DataFrame:
    return G.frozen_set(wide_scores(spark, sf), ["chars", "words"])


@query(
    f"""WITH r AS (SELECT conv_id, turn + 1 AS width, text, {norm_sql('text')} AS n, length(text) / 100.0::DOUBLE AS lp FROM conversations), b AS (SELECT conv_id, text AS t0, n AS n0, lp AS l0 FROM r WHERE width = 1)
    SELECT CAST(width AS BIGINT) AS width, CAST(count(*) AS BIGINT) AS n, round(avg((text <> t0)::INT), 9) AS text_mismatch_rate, round(avg((n <> n0)::INT), 9) AS answer_mismatch_rate, round(max(abs(lp - l0)), 9) AS max_first_token_diff FROM r JOIN b USING (conv_id) WHERE width <> 1 GROUP BY width"""
)
def batch_invariance(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).cast("long").alias("width"), "text", (F.length("text") / F.lit(100.0)).alias("first_logprob"))
    return r9(L.batch_invariance(runs), "text_mismatch_rate", "answer_mismatch_rate", "max_first_token_diff")


@query(
    f"""WITH {SCORES}, t AS (SELECT signal, CASE WHEN row_pos % 13 = 0 THEN NULL WHEN signal = 'chars' AND row_pos % 5 = 0 THEN score + 0.5 ELSE score END AS x, score FROM scores)
    SELECT signal, round(max(abs(x - score)), 9) AS max_abs_diff, CAST(count(*) FILTER ((x IS NULL) <> (score IS NULL)) AS BIGINT) AS n_one_sided, coalesce(max(abs(x - score)), 0) < 1e-9 AND count(*) FILTER ((x IS NULL) <> (score IS NULL)) = 0 AS agrees FROM t GROUP BY signal"""
)
def agreement_with_main(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf)
    odd = F.when(F.col("row_pos") % 13 == 0, F.lit(None)).when((F.col("signal") == "chars") & (F.col("row_pos") % 5 == 0), F.col("score") + 0.5).otherwise(F.col("score"))
    return r9(L.agreement_with_main(s.withColumn("score", odd), s), "max_abs_diff")


@query(
    """WITH e AS (SELECT event_type AS judge, event_id, value < 30 AS failed FROM events), g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY judge ORDER BY event_id) AS okay FROM e),
    r AS (SELECT *, sum(failed::INT) OVER (PARTITION BY judge, okay ORDER BY event_id) AS run FROM g) SELECT judge, min(event_id) AS stopped_at FROM r WHERE run >= 3 GROUP BY judge"""
)
def failure_breaker(spark: SparkSession, sf: str) -> DataFrame:
    replies = table(spark, sf, "events").select(F.col("event_type").alias("judge"), "event_id", (F.col("value") < 30).alias("failed"))
    return C.consecutive_failures(replies, "event_id", 3)


@query(
    f"""WITH s AS (SELECT conv_id || '-' || turn AS qid, nullif(regexp_extract({norm_sql(_VERDICT)}, '^(incorrect|correct|ambiguous)\\b', 1), '') AS recovered, CASE WHEN turn % 2 = 0 THEN 'correct' ELSE 'incorrect' END AS judge_primary_verdict, conv_id % 3 <> 0 AS cached FROM conversations)
    SELECT qid, CASE WHEN cached THEN recovered END AS recovered, CASE WHEN cached THEN recovered = judge_primary_verdict END AS agrees FROM s"""
)
def recovered_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("qid", F.concat_ws("-", "conv_id", "turn"))
    cache = c.where("conv_id % 3 <> 0").select(F.md5("qid").alias("key"), F.expr(_VERDICT).alias("value"))
    sample = c.select("qid", F.when(F.col("turn") % 2 == 0, "correct").otherwise("incorrect").alias("judge_primary_verdict"))
    return C.recovered_verdicts(sample, cache, F.md5("qid")).select("qid", "recovered", "agrees")


@query(f"WITH {SCORES}, d AS (SELECT count(*) AS n, sum(words) AS w FROM wide) SELECT CAST(n AS BIGINT) AS n, round(w / n, 9) AS mean, round((SELECT stddev_pop(words) FROM wide), 9) AS std FROM d")
def mean_and_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return r9(wide_scores(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.avg("words").alias("mean"), F.stddev_pop("words").alias("std")), "mean", "std")
