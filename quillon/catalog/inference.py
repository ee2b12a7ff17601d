"""Resampling, agreement, gates and the leaderboard over the same score table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import ORACLE_SQL, query, table
from quillon.catalog.questions import md5_sql
from quillon.catalog.ranking import _AP, SCORES, auroc_sql, r9, stored_scores, wide_scores
from quillon.operators import draws as D
from quillon.operators import labels as A
from quillon.operators import resample as R
from quillon.plans import compare as C
from quillon.plans import gates as G
from quillon.plans import leaderboard as L

RESAMPLES, SEED = 10_000, 987654321
#: Resamples of the agreement of two raters.
RATERS = 2_000
_LIMITS = ", ".join(f"({p}, {[*D.limits(p)[0]]}::BIGINT[], {[*D.limits(p)[1]]}::BIGINT[])" for p in range(18))


def _low(x: str) -> str:
    """The low 64 bits of a wide number."""
    return f"(({x}) & 18446744073709551615::UHUGEINT)::UBIGINT"


def _mix(x: str, n: int) -> str:
    """Columns m<n>0.. of a select: the splitmix64 finaliser of ``x``, the last one its value."""
    at = [f"m{n}{i}" for i in range(4)]
    step = lambda z, shift, c: _low(f"xor({z}, {z} >> {shift})::UHUGEINT * {c}::UHUGEINT")
    return f"{x} AS {at[0]}, {step(at[0], 30, D.FIRST)} AS {at[1]}, {step(at[1], 27, D.SECOND)} AS {at[2]}, xor({at[2]}, {at[2]} >> 31) AS {at[3]}"


def draws_sql(rows: str, key: str = "qid", name: str = "w", by: str = "", cls: str = "y", resamples: int = RESAMPLES) -> str:
    """How often each key is drawn in each resample, as a CTE ``name`` (r, by, key, w): the first n arrivals of each class of n keys."""
    g = f"{by}, " if by else ""
    u, c, x = f"{name}_units", f"{name}_cells", f"{name}_times"
    hexed = lambda a: f"('0x' || substr(h, {a}, 16))::UBIGINT"
    return f"""{u} AS MATERIALIZED (SELECT *, {hexed(1)} AS h1, {hexed(17)} AS h2, len(bin(n)) - 1 AS power FROM (
      SELECT {g}{key}, {cls} AS cls, md5('{SEED}:' || CAST({key} AS VARCHAR)) AS h, count(*) OVER (PARTITION BY {g}{cls}) AS n FROM (SELECT DISTINCT {g}{key}, {cls} FROM {rows}))),
    {c} AS MATERIALIZED (SELECT {g}{key}, cls, n, h2, r, len(list_filter(l0, lambda l: l <= (m03 >> 32))) AS k0, len(list_filter(l1, lambda l: l <= (m03 & 4294967295))) AS k1 FROM (
      SELECT *, {_mix(_low(f"h1::UHUGEINT + {D.GOLDEN}::UHUGEINT * (r + 1)::UHUGEINT"), 0)} FROM {u}, (SELECT unnest(range({resamples})) AS r)) JOIN (VALUES {_LIMITS}) l(power, l0, l1) USING (power)),
    {x} AS (SELECT {g}{key}, cls, r, n, k, row_number() OVER (PARTITION BY {g}cls, r ORDER BY t) AS place FROM (
      SELECT *, {_mix(_low(f"h2::UHUGEINT + {D.GOLDEN}::UHUGEINT * ({D.STRIDE} * r + j + 1)::UHUGEINT"), 1)}, m13 >> 2 AS t FROM (SELECT {g}{key}, cls, r, n, h2, unnest(range(k1)) AS j FROM {c} WHERE k1 > 0))
      JOIN (SELECT {g}cls, r, sum(k0) AS k FROM {c} GROUP BY ALL) USING ({g}cls, r)),
    {name} AS MATERIALIZED (SELECT {g}{key}, r, CAST(sum(w) AS BIGINT) AS w FROM (SELECT {g}{key}, r, k0 AS w FROM {c} WHERE k0 > 0 UNION ALL SELECT {g}{key}, r, 1 FROM {x} WHERE place <= n - k) GROUP BY ALL)"""


def interval_sql(source: str, by: str, value: str) -> str:
    return f"(SELECT {by}, quantile_cont({value}, 0.025) AS ci_low, quantile_cont({value}, 0.975) AS ci_high, count({value}) AS resamples FROM {source} WHERE {value} IS NOT NULL GROUP BY {by})"


@query(
    f"""WITH {SCORES}, {draws_sql('wide')}, d AS (SELECT w.r, s.signal, s.score, s.y, w.w FROM scores s JOIN w USING (qid)), v AS (SELECT * FROM {auroc_sql('r, signal', 'd', 'w')}),
    p AS (SELECT * FROM {auroc_sql('signal')}) SELECT signal, round(auroc, 9) AS auroc, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, CAST(resamples AS BIGINT) AS resamples FROM p JOIN {interval_sql('v', 'signal', 'auroc')} USING (signal)"""
)
def bootstrap_auroc_ci_hash(spark: SparkSession, sf: str) -> DataFrame:
    out = R.bootstrap_auroc(stored_scores(spark, sf), RESAMPLES, SEED).select("signal", "auroc", "ci_low", "ci_high", "resamples")
    return r9(out, "auroc", "ci_low", "ci_high")


@query(
    f"""WITH {SCORES}, {draws_sql('wide')}, d AS (SELECT w.r, s.signal, s.score, s.y, w.w FROM scores s JOIN w USING (qid)), v AS (SELECT * FROM {_AP.format(by='r, signal', w='w', source='d')}),
    p AS (SELECT * FROM {_AP.format(by='signal', w='1', source='scores')})
    SELECT signal, round(average_precision, 9) AS average_precision, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM p JOIN {interval_sql('v', 'signal', 'average_precision')} USING (signal)"""
)
def bootstrap_ap_ci_hash(spark: SparkSession, sf: str) -> DataFrame:
    out = R.bootstrap_average_precision(stored_scores(spark, sf), RESAMPLES, SEED).select("signal", "average_precision", "ci_low", "ci_high")
    return r9(out, "average_precision", "ci_low", "ci_high")


@query(
    f"""WITH {SCORES}, {draws_sql('wide', by='stratum')}, d AS (SELECT w.r, s.stratum, s.signal, s.score, s.y, w.w FROM scores s JOIN w USING (stratum, qid)), e AS (SELECT * FROM {auroc_sql('r, stratum, signal', 'd', 'w')}),
    z AS (SELECT stratum, count(*) AS weight FROM wide GROUP BY 1), v AS (SELECT r, signal, sum(auroc * weight) / sum(weight) FILTER (auroc IS NOT NULL) AS auroc FROM e JOIN z USING (stratum) GROUP BY ALL)
    SELECT signal, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM {interval_sql('v', 'signal', 'auroc')}"""
)
def stratified_bootstrap_hash(spark: SparkSession, sf: str) -> DataFrame:
    return r9(R.bootstrap_stratified(stored_scores(spark, sf), "stratum", RESAMPLES, SEED).where("resamples > 0").select("signal", "ci_low", "ci_high"), "ci_low", "ci_high")


@query(
    f"""WITH {SCORES}, {draws_sql('wide', by='stratum')}, d AS (SELECT w.r, s.stratum, s.signal, s.score, s.y, w.w FROM scores s JOIN w USING (stratum, qid)), v AS (SELECT * FROM {auroc_sql('r, stratum, signal', 'd', 'w')}),
    p AS (SELECT * FROM {auroc_sql('stratum, signal')})
    SELECT stratum, signal, round(auroc, 9) AS auroc, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, ci_low > 0.5 OR ci_high < 0.5 AS excludes_chance FROM p LEFT JOIN {interval_sql('v', 'stratum, signal', 'auroc')} USING (stratum, signal)"""
)
def per_dataset_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    out = R.bootstrap_by_stratum(stored_scores(spark, sf), "stratum", RESAMPLES, SEED).select("stratum", "signal", "auroc", "ci_low", "ci_high", "excludes_chance")
    return r9(out, "auroc", "ci_low", "ci_high")


@query(
    f"""WITH {SCORES}, votes AS (SELECT row_pos // 3 AS cluster_id, avg(y::INT) >= 0.5 AS y FROM wide GROUP BY 1), {draws_sql('votes', 'cluster_id')},
    d AS (SELECT w.r, s.signal, s.score, s.y, w.w FROM scores s JOIN w ON s.row_pos // 3 = w.cluster_id), v AS (SELECT * FROM {auroc_sql('r, signal', 'd', 'w')})
    SELECT signal, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM {interval_sql('v', 'signal', 'auroc')}"""
)
def cluster_bootstrap_hash(spark: SparkSession, sf: str) -> DataFrame:
    s = stored_scores(spark, sf).withColumn("cluster_id", F.expr("row_pos div 3"))
    return r9(R.bootstrap_auroc(s, RESAMPLES, SEED, clusters=True).select("signal", "ci_low", "ci_high"), "ci_low", "ci_high")


@query(
    f"""WITH {SCORES}, {draws_sql('wide')},
    d AS (SELECT w.r, s.signal, s.score, s.y, w.w FROM scores s JOIN w USING (qid)), a AS (SELECT * FROM {auroc_sql('r, signal', 'd', 'w')}), p AS (SELECT * FROM {auroc_sql('signal')}),
    t AS (SELECT o.signal, o.auroc - f.auroc AS delta, o.n AS n_paired FROM p o, p f WHERE f.signal = 'distinct' AND o.signal <> 'distinct'),
    v AS (SELECT o.r, o.signal, o.auroc - f.auroc AS d FROM a o JOIN a f ON o.r = f.r AND f.signal = 'distinct' WHERE o.signal <> 'distinct'),
    k AS (SELECT signal, count(*) FILTER (CASE WHEN delta >= 0 THEN d <= 0 ELSE d >= 0 END) AS tail, count(*) AS total FROM v JOIN t USING (signal) GROUP BY signal)
    SELECT signal, round(delta, 9) AS delta, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(least(1.0, 2.0 * (tail + 1) / (total + 1))::DOUBLE, 9) AS p_value, CAST(n_paired AS BIGINT) AS n_paired
    FROM t JOIN k USING (signal) JOIN {interval_sql('v', 'signal', 'd')} USING (signal)"""
)
def paired_auroc_diff_hash(spark: SparkSession, sf: str) -> DataFrame:
    out = R.paired_auroc_diff(stored_scores(spark, sf), "distinct", RESAMPLES, SEED).drop("resamples")
    return r9(out, "delta", "ci_low", "ci_high", "p_value")


@query(
    f"""WITH {SCORES}, {draws_sql('wide', cls='toxic')}, l AS (SELECT qid, signal, score, unnest(['old', 'new']) AS side, unnest([y, toxic]) AS y FROM scores),
    d AS (SELECT w.r, l.signal, l.side, l.score, l.y, w.w FROM l JOIN w USING (qid)), a AS (SELECT * FROM {auroc_sql('r, signal, side', 'd', 'w')}), p AS (SELECT * FROM {auroc_sql('signal, side', 'l')}),
    t AS (SELECT n.signal, n.auroc - o.auroc AS delta FROM p n JOIN p o ON n.signal = o.signal AND n.side = 'new' AND o.side = 'old'),
    v AS (SELECT n.signal, n.auroc - o.auroc AS delta FROM a n JOIN a o ON n.r = o.r AND n.signal = o.signal AND n.side = 'new' AND o.side = 'old')
    SELECT signal, round(t.delta, 9) AS delta, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM t JOIN {interval_sql('v', 'signal', 'delta')} USING (signal)"""
)
def label_delta(spark: SparkSession, sf: str) -> DataFrame:
    return r9(R.label_delta(stored_scores(spark, sf), "y", "toxic", RESAMPLES, SEED).select("signal", "delta", "ci_low", "ci_high"), "delta", "ci_low", "ci_high")


_P = "((l_orderkey + 7 * l_linenumber) % 997) / 9970.0::DOUBLE"


@query(
    f"""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS k, {_P} AS p FROM lineitem), r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS rn, count(*) OVER () AS m FROM f),
    h AS (SELECT k, p, least(1.0, max((m - rn + 1) * p) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS a FROM r) SELECT k, round(a, 9) AS p_holm, a <= 0.05 AS significant FROM h"""
)
def holm_adjust(spark: SparkSession, sf: str) -> DataFrame:
    """All lines are one family."""
    f = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), ((F.col("l_orderkey") + 7 * F.col("l_linenumber")) % 997 / F.lit(9970.0)).alias("p"))
    return r9(R.holm(f, "p", "k", spread=64).select("k", "p_holm", F.col("significant_p_holm").alias("significant")), "p_holm")


_KAPPA = """(WITH c AS (SELECT {by} a, b, {w}::DOUBLE AS n FROM {source}), t AS (SELECT {by} sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS g FROM c {group}),
  x AS (SELECT {by} a AS c, sum(n) AS rr FROM c GROUP BY ALL), z AS (SELECT {by} b AS c, sum(n) AS kk FROM c GROUP BY ALL), q AS (SELECT {by} sum(rr * kk) AS pr FROM x JOIN z USING ({keys}) {group})
  SELECT {by} n, g, g / n AS po, pr / (n * n) AS pe, CASE WHEN pr / (n * n) < 1 THEN (g / n - pr / (n * n)) / (1 - pr / (n * n)) END AS kappa FROM t {join})"""
_RATED = "rated AS (SELECT doc_id AS qid, CASE WHEN quality = 0 THEN 'incorrect' ELSE 'correct' END AS a, CASE WHEN toxic = 1 OR doc_id % 3 = 0 THEN 'incorrect' ELSE 'correct' END AS b FROM labels)"


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    two = lambda c: F.when(c, "incorrect").otherwise("correct")
    l = table(spark, sf, "labels")
    return l.select(F.col("doc_id").alias("qid"), two(F.col("quality") == 0).alias("a"), two((F.col("toxic") == 1) | (F.col("doc_id") % 3 == 0)).alias("b"))


_CELLS = _KAPPA.format(by="", w="1", source="rated", group="", keys="c", join=", q")


@query(f"WITH {_RATED} SELECT CAST(n AS BIGINT) AS n, CAST(g AS BIGINT) AS n_agree, round(po, 9) AS observed, round(pe, 9) AS expected, round(kappa, 9) AS kappa FROM {_CELLS}")
def cohens_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return r9(A.cohens_kappa(_rated(spark, sf), "a", "b").select("n", "n_agree", "observed", "expected", "kappa"), "observed", "expected", "kappa")


@query(
    f"""WITH {_RATED}, {draws_sql('rated', cls='0', resamples=RATERS)}, cells AS (SELECT r, a, b, sum(w) AS w FROM rated JOIN w USING (qid) GROUP BY ALL),
    v AS (SELECT * FROM {_KAPPA.format(by='r,', w='w', source='cells', group='GROUP BY r', keys='r, c', join='JOIN q USING (r)')}), p AS (SELECT kappa FROM {_CELLS})
    SELECT round((SELECT kappa FROM p), 9) AS kappa, round(quantile_cont(kappa, 0.025), 9) AS ci_low, round(quantile_cont(kappa, 0.975), 9) AS ci_high FROM v"""
)
def kappa_bootstrap_hash(spark: SparkSession, sf: str) -> DataFrame:
    return r9(R.bootstrap_kappa(_rated(spark, sf), "a", "b", RATERS, SEED).select("kappa", "ci_low", "ci_high"), "kappa", "ci_low", "ci_high")


_PR = "{w} FILTER (a = 'incorrect' AND b = 'incorrect')"
_RATES = "{p} / nullif({w} FILTER (b = 'incorrect'), 0)::DOUBLE AS precision, {p} / nullif({w} FILTER (a = 'incorrect'), 0)::DOUBLE AS recall"
_RATE = lambda w: _RATES.format(p=_PR.format(w=w), w=w)


@query(
    f"""WITH {_RATED}, {draws_sql('rated', cls='0', resamples=RATERS)}, v AS (SELECT r, {_RATE('sum(w)')} FROM rated JOIN w USING (qid) GROUP BY r),
    q AS (SELECT {', '.join(f"round(quantile_cont({m}, {at}), 9) AS {m}_{end}" for m in ('precision', 'recall') for at, end in ((0.025, 'low'), (0.975, 'high')))} FROM v),
    p AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST({_PR.format(w='count(*)')} AS BIGINT) AS tp, {_RATE('count(*)')} FROM rated)
    SELECT n, tp, round(precision, 9) AS precision, round(recall, 9) AS recall, q.* FROM p, q"""
)
def rule_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    ends = [f"{m}_{end}" for m in ("precision", "recall") for end in ("low", "high")]
    out = R.bootstrap_rule_accuracy(_rated(spark, sf), F.col("b") == "incorrect", F.col("a") == "incorrect", RATERS, SEED)
    return r9(out.select("n", "tp", "precision", "recall", *ends), "precision", "recall", *ends)


_FILLED = "CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN quality = 0 THEN 'incorrect' ELSE 'correct' END"


@query(
    f"""WITH {SCORES}, g AS (SELECT stratum, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM wide GROUP BY 1), f AS (SELECT avg((trim({_FILLED}) <> '')::INT) AS c FROM labels)
    SELECT 'minimum_rows_per_class' AS name, least(sum(p), sum(n)) >= 30 AS passed FROM g UNION ALL SELECT 'per_dataset_class_counts', bool_and(least(p, n) >= 30) FROM g
    UNION ALL SELECT 'abstention_rate_below_ceiling', count(*) FILTER (toxic) / count(*)::DOUBLE < 0.10 FROM wide UNION ALL SELECT 'labeling_protocol_validated', c >= 0.5 FROM f UNION ALL SELECT 'human_label_coverage', c >= 0.8 FROM f
    UNION ALL SELECT 'random_baseline_ci_contains_chance', ci_low <= 0.5 AND ci_high >= 0.5 FROM ({ORACLE_SQL['bootstrap_auroc_ci_hash']}) WHERE signal = 'random'"""
)
def validity_gates(spark: SparkSession, sf: str) -> DataFrame:
    """All six gates; people have filled two thirds of the labelling file."""
    w = wide_scores(spark, sf).withColumns({"dataset": F.col("stratum"), "label": F.when(F.col("toxic"), "abstain").otherwise("correct")})
    people = table(spark, sf, "labels").select(F.expr(_FILLED).alias("human_label"))
    ends = R.bootstrap_auroc(stored_scores(spark, sf), RESAMPLES, SEED).withColumn("signal", F.when(F.col("signal") == "random", G.RANDOM_SIGNAL).otherwise(F.col("signal")))
    return G.evaluate(w, w, ends, protocol=people, fuzzy=people).select("name", "passed")


@query(
    """WITH c AS (SELECT count(*) FILTER (quality = 1) AS k, count(*) FILTER (quality = 0) AS i, count(*) AS n FROM labels)
    SELECT CAST(k AS BIGINT) AS n_correct, CAST(i AS BIGINT) AS n_incorrect, CAST(n AS BIGINT) AS n, round(i / (i + k)::DOUBLE, 9) AS error_rate, i / (i + k)::DOUBLE BETWEEN 0.25 AND 0.65 AS in_band FROM c"""
)
def pilot_gate(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels").select(F.when(F.col("quality") == 0, "incorrect").otherwise("correct").alias("label"))
    return r9(G.pilot_gate(l).select("n_correct", "n_incorrect", "n", "error_rate", "in_band"), "error_rate")


_HUMAN = "SELECT doc_id AS qid, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 17 = 0 THEN 'maybe' WHEN quality = 0 THEN ' Incorrect' ELSE 'correct ' END AS human_label, CASE WHEN toxic = 1 THEN 'incorrect' ELSE 'correct' END AS machine_label FROM labels"


@query(
    f"""WITH s AS (SELECT qid, lower(trim(human_label)) AS h, machine_label AS m FROM ({_HUMAN})), c AS (SELECT *, h IN ('correct', 'incorrect') AS ok FROM s)
    SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (ok) AS BIGINT) AS n_labelled, CAST(count(*) FILTER (h <> '' AND NOT ok) AS BIGINT) AS n_invalid,
           round(avg((h = 'incorrect')::INT) FILTER (ok), 9) AS base_rate, round(avg((h <> m)::INT) FILTER (ok), 9) AS error_rate FROM c"""
)
def human_agreement_report(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels")
    human = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 17 == 0, "maybe").when(F.col("quality") == 0, " Incorrect").otherwise("correct ")
    s = l.select(F.col("doc_id").alias("qid"), human.alias("human_label"), F.when(F.col("toxic") == 1, "incorrect").otherwise("correct").alias("machine_label"))
    return r9(C.human_report(s).select("n_rows", "n_labelled", "n_invalid", "base_rate", "error_rate"), "base_rate", "error_rate")


_OF = {name: ORACLE_SQL[name] for name in ("auroc_pooled", "average_precision", "aurc", "bootstrap_auroc_ci_hash", "leader_ranking")}


@query(
    f"""SELECT a.signal, a.n, a.n_pos, a.n_neg, a.auroc, p.average_precision, c.aurc, c.base_rate, c.coverage_at_target, b.ci_low, b.ci_high, b.resamples, r.rank
    FROM ({_OF['auroc_pooled']}) a JOIN ({_OF['average_precision']}) p USING (signal) JOIN ({_OF['aurc']}) c USING (signal) JOIN ({_OF['bootstrap_auroc_ci_hash']}) b USING (signal) JOIN ({_OF['leader_ranking']}) r USING (signal)"""
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Every metric of every signal with its interval and rank: the analysis in one table."""
    s = stored_scores(spark, sf)
    board = L.metrics_table(s, [])
    ci = R.bootstrap_auroc(s, RESAMPLES, SEED).select("signal", "ci_low", "ci_high", "resamples")
    out = L.ranked(board.join(ci, "signal"), [])
    return r9(out, "auroc", "average_precision", "aurc", "base_rate", "coverage_at_target", "ci_low", "ci_high")


_LEADER = "(SELECT signal FROM p ORDER BY auroc DESC, signal LIMIT 1)"
_AGAINST_LEADER = ORACLE_SQL["paired_auroc_diff_hash"].replace("= 'distinct'", f"= {_LEADER}").replace("<> 'distinct'", f"<> {_LEADER}")


@query(
    f"""WITH k AS (SELECT *, row_number() OVER (ORDER BY p_value, rank) AS rn, count(*) OVER () AS m FROM ({_AGAINST_LEADER}) JOIN (SELECT signal, rank FROM ({_OF['leader_ranking']})) USING (signal))
    SELECT signal, delta, ci_low, ci_high, p_value, n_paired, round(least(1.0, max((m - rn + 1) * p_value) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING)), 8) AS p_holm, (SELECT signal FROM ({_OF['leader_ranking']}) WHERE rank = 1) AS reference FROM k"""
)
def significance_table(spark: SparkSession, sf: str) -> DataFrame:
    s = stored_scores(spark, sf)
    out = L.significance(s, L.ranking(s, []), L.Options(resamples=RESAMPLES, seed=SEED)).select("signal", "delta", "ci_low", "ci_high", "p_value", "n_paired", F.round("p_holm", 8).alias("p_holm"), "reference")
    return r9(out, "delta", "ci_low", "ci_high", "p_value")


@query(
    f"""WITH b AS (SELECT r.signal, r.auroc, r.rank, i.ci_low, i.ci_high FROM ({_OF['leader_ranking']}) r JOIN ({_OF['bootstrap_auroc_ci_hash']}) i USING (signal)), x AS (SELECT * FROM b WHERE rank = 1), y AS (SELECT * FROM b WHERE rank = 2)
    SELECT x.signal AS leader, x.auroc, y.signal AS runner_up, y.auroc AS next_auroc, x.ci_low > y.ci_high AS intervals_disjoint, x.auroc - y.auroc >= 0.02 AS gap_meaningful, x.ci_low > y.ci_high AND x.auroc - y.auroc >= 0.02 AS has_winner FROM x, y"""
)
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    s = stored_scores(spark, sf)
    ci = R.bootstrap_auroc(s, RESAMPLES, SEED).select("signal", "ci_low", "ci_high")
    return r9(L.verdict(L.ranking(s, []).join(ci, "signal")), "auroc", "next_auroc")
