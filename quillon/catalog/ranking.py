"""Metric operators over one score table: labelled documents, low quality as the positive class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query, table
from quillon.catalog.questions import md5_sql
from quillon.functions.numeric import hash_index
from quillon.operators import metrics as M
from quillon.operators import resample as R
from quillon.operators import signals as S
from quillon.operators.ranges import checkpointed
from quillon.plans import compare as C
from quillon.plans import leaderboard as L

SIGNALS = ["chars", "distinct", "random", "words"]
_WORDS = "string_split(d.text, ' ')"
#: The same score table in SQL: (qid, stratum, row_pos, y, signal, score).
SCORES = f"""
  wide AS MATERIALIZED (
    SELECT CAST(d.doc_id AS VARCHAR) AS qid, d.lang AS stratum, d.doc_id AS row_pos, l.quality = 0 AS y, l.toxic = 1 AS toxic, CAST(d.n_chars AS DOUBLE) AS chars,
           -(len(list_distinct({_WORDS}))::DOUBLE / len({_WORDS})) AS distinct_, {md5_sql("'0'", 'CAST(d.doc_id AS VARCHAR)')}::DOUBLE / 1152921504606846976.0 AS random_, CAST(len({_WORDS}) AS DOUBLE) AS words
    FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL
  ), scores AS MATERIALIZED (
    SELECT qid, stratum, row_pos, y, toxic, unnest(['chars', 'distinct', 'random', 'words']) AS signal, unnest([chars, distinct_, random_, words]) AS score FROM wide
  )"""


def wide_scores(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("text", " ")
    joined = table(spark, sf, "documents").where("text is not null").join(table(spark, sf, "labels"), "doc_id")
    return joined.select(
        F.col("doc_id").cast("string").alias("qid"), F.col("lang").alias("stratum"), F.col("doc_id").alias("row_pos"), (F.col("quality") == 0).alias("y"), (F.col("toxic") == 1).alias("toxic"),
        F.col("n_chars").cast("double").alias("chars"), (-(F.size(F.array_distinct(words)) / F.size(words))).alias("distinct"),
        (hash_index(F.lit("0"), F.col("doc_id").cast("string")) / F.lit(1152921504606846976.0)).alias("random"), F.size(words).cast("double").alias("words"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return S.long_scores(wide_scores(spark, sf), keep=["qid", "stratum", "row_pos", "y", "toxic"], signals=SIGNALS)


def stored_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score table for queries that read it several times: texts are read and split once."""
    return S.long_scores(checkpointed(wide_scores(spark, sf)), keep=["qid", "stratum", "row_pos", "y", "toxic"], signals=SIGNALS)


def auroc_sql(by: str, source: str = "scores", w: str = "1") -> str:
    """AUROC from the score histogram, as a select of (by, n, n_pos, n_neg, auroc)."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""(WITH h AS (SELECT {by + ',' if by else ''} score, sum(CASE WHEN y THEN {w} ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN y THEN 0 ELSE {w} END)::DOUBLE AS n FROM {source} WHERE score IS NOT NULL GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM h)
    SELECT {by + ',' if by else ''} CAST(sum(p) + sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg,
           CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (nb + n / 2)) / (sum(p) * sum(n)) END AS auroc FROM b {'GROUP BY ' + by if by else ''})"""


def r9(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"WITH {SCORES} SELECT signal, n, n_pos, n_neg, round(auroc, 9) AS auroc FROM {auroc_sql('signal')}")
def auroc_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.auroc(scores(spark, sf), ["signal"]), "auroc")


@query(f"WITH {SCORES} SELECT stratum, signal, n, n_pos, n_neg, round(auroc, 9) AS auroc FROM {auroc_sql('stratum, signal')}")
def auroc_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.auroc(scores(spark, sf), ["stratum", "signal"]), "auroc")


@query(
    f"""WITH {SCORES}, e AS (SELECT * FROM {auroc_sql('stratum, signal')}), s AS (SELECT stratum, count(*) AS weight FROM wide GROUP BY 1)
    SELECT signal, round(sum(auroc * weight) / sum(weight) FILTER (auroc IS NOT NULL), 9) AS auroc FROM e JOIN s USING (stratum) GROUP BY signal"""
)
def auroc_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return r9(R.stratified_auroc(scores(spark, sf), "stratum"), "auroc")


_AP = """(WITH h AS (SELECT {by}, score, sum(CASE WHEN y THEN {w} ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN y THEN 0 ELSE {w} END)::DOUBLE AS n FROM {source} GROUP BY ALL),
  c AS (SELECT {by}, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM h WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
  SELECT {by}, sum(p * tp / (tp + fp)) / sum(p) AS average_precision FROM c GROUP BY {by})"""


@query(f"WITH {SCORES} SELECT signal, round(average_precision, 9) AS average_precision FROM {_AP.format(by='signal', w='1', source='scores')}")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.average_precision(scores(spark, sf), ["signal"]), "average_precision")


@query(
    f"""WITH {SCORES}, h AS (SELECT signal, score, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM scores GROUP BY ALL),
    c AS (SELECT signal, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY signal) AS total FROM h WINDOW w AS (PARTITION BY signal ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
    SELECT signal, round(score, 9) AS score, round((tp / (tp + fp))::DOUBLE, 9) AS precision, round((tp / total)::DOUBLE, 9) AS recall FROM c"""
)
def precision_recall_points(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.precision_recall(scores(spark, sf), ["signal"]).select("signal", "score", "precision", "recall"), "score", "precision", "recall")


_CURVE = """SELECT signal, row_number() OVER w AS k, row_number() OVER w / count(*) OVER (PARTITION BY signal)::DOUBLE AS coverage,
  avg(y::INT) OVER (PARTITION BY signal ORDER BY score, row_pos ROWS UNBOUNDED PRECEDING) AS risk, avg(y::INT) OVER (PARTITION BY signal) AS base_rate FROM scores WINDOW w AS (PARTITION BY signal ORDER BY score, row_pos)"""


@query(f"WITH {SCORES}, c AS ({_CURVE}) SELECT signal, CAST(k AS BIGINT) AS k, round(coverage, 9) AS coverage, round(risk, 9) AS risk FROM c")
def risk_coverage_curve(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.risk_coverage(scores(spark, sf), ["signal"]).drop("base_rate"), "coverage", "risk")


@query(
    f"""WITH {SCORES}, c AS ({_CURVE}) SELECT signal, round(avg(risk), 9) AS aurc, round(max(base_rate), 9) AS base_rate,
    round(max(coverage) FILTER (risk <= 1.0::DOUBLE - 0.9::DOUBLE), 9) AS coverage_at_target FROM c GROUP BY signal"""
)
def aurc(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.aurc(scores(spark, sf), ["signal"], 0.9), "aurc", "base_rate", "coverage_at_target")


_BINS = """(SELECT len(list_filter([i / 10.0::DOUBLE FOR i IN range(1, 10)], lambda e: e < score)) AS bin, score, y FROM scores WHERE signal = 'random')"""


@query(
    f"""WITH {SCORES}, g AS (SELECT unnest(range(10)) AS bin), s AS (SELECT bin, count(*) AS n, avg(score) AS c, avg(y::INT) AS a FROM {_BINS} GROUP BY bin)
    SELECT CAST(g.bin AS INTEGER) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n, round(c, 9) AS confidence, round(a, 9) AS accuracy, round((g.bin + 0.5::DOUBLE) / 10, 9) AS center FROM g LEFT JOIN s USING (bin)"""
)
def ece_bins(spark: SparkSession, sf: str) -> DataFrame:
    out = M.ece_bins(scores(spark, sf).where("signal = 'random'"), ["signal"], 10).select("bin", "n", "confidence", "accuracy", "center")
    return r9(out, "confidence", "accuracy", "center")


@query(f"WITH {SCORES}, s AS (SELECT bin, count(*) AS n, avg(score) AS c, avg(y::INT) AS a FROM {_BINS} GROUP BY bin) SELECT 'random' AS signal, round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM s")
def ece(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.ece(scores(spark, sf).where("signal = 'random'"), ["signal"], 10), "ece")


_RANK = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"
_MATRIX = f"""p AS (SELECT a.signal AS a, b.signal AS b, a.score AS x, b.score AS z FROM scores a JOIN scores b ON a.qid = b.qid AND a.signal <= b.signal),
  k AS (SELECT a, b, {_RANK.format(by='a, b', x='x')} AS rx, {_RANK.format(by='a, b', x='z')} AS rz FROM p),
  m AS (SELECT a, b, count(*) AS n, CASE WHEN stddev_pop(rx) * stddev_pop(rz) > 0 THEN covar_pop(rx, rz) / (stddev_pop(rx) * stddev_pop(rz)) END AS rho FROM k GROUP BY a, b)"""


@query(f"WITH {SCORES}, {_MATRIX} SELECT a, b, CAST(n AS BIGINT) AS n, round(rho, 8) AS rho FROM m")
def spearman_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return M.spearman_matrix(scores(spark, sf)).withColumn("rho", F.round("rho", 8))


@query(f"WITH {SCORES}, {_MATRIX} SELECT a, b, bool_and(rx = rz) AS same, bool_and(rx + rz = (SELECT count(*) FROM wide) + 1) AS reversed FROM k GROUP BY a, b")
def rank_identity(spark: SparkSession, sf: str) -> DataFrame:
    return M.rank_identity(scores(spark, sf))


_RESID = "r{0} - avg(r{0}) OVER () - coalesce(covar_pop(r{0}, rg) OVER () / nullif(var_pop(rg) OVER (), 0), 0) * (rg - avg(rg) OVER ())"


@query(
    f"""WITH {SCORES}, k AS (SELECT {_RANK.format(by='1', x='distinct_')} AS rx, {_RANK.format(by='1', x='y::INT')} AS rz, {_RANK.format(by='1', x='chars')} AS rg FROM wide),
    e AS (SELECT round({_RESID.format('x')}, 9) AS ex, round({_RESID.format('z')}, 9) AS ez FROM k),
    f AS (SELECT {_RANK.format(by='1', x='ex')} AS rx, {_RANK.format(by='1', x='ez')} AS rz FROM e)
    SELECT CAST(count(*) AS BIGINT) AS n, round(covar_pop(rx, rz) / (stddev_pop(rx) * stddev_pop(rz)), 4) AS partial_rho FROM f"""
)
def partial_spearman(spark: SparkSession, sf: str) -> DataFrame:
    w = wide_scores(spark, sf).withColumns({"label": F.col("y").cast("double"), "_all": F.lit(1)})
    return M.partial_spearman(w, ["_all"], "distinct", "label", "chars").select("n", F.round("partial_rho", 4).alias("partial_rho"))


@query(
    f"""WITH {SCORES}, m AS (SELECT median(chars) AS med FROM wide), s2 AS (SELECT s.signal, s.score, s.y, CASE WHEN w.chars <= med THEN 'at_or_below' ELSE 'above' END AS length_stratum FROM scores s JOIN wide w USING (qid), m)
    SELECT signal, length_stratum, n, n_pos, n_neg, round(auroc, 9) AS auroc FROM {auroc_sql('signal, length_stratum', 's2')}"""
)
def length_strata_auroc(spark: SparkSession, sf: str) -> DataFrame:
    w = wide_scores(spark, sf).withColumn("length", F.col("chars"))
    long = w.unpivot(["qid", "y", "length"], SIGNALS, "signal", "score")
    return r9(M.strata_auroc(long, ["signal"], "length"), "auroc")


@query(f"WITH {SCORES}, b AS (SELECT * FROM {auroc_sql('signal')}) SELECT signal, round(auroc, 9) AS auroc, CAST(row_number() OVER (ORDER BY auroc DESC, signal) AS INTEGER) AS rank FROM b")
def leader_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return r9(L.ranking(scores(spark, sf), []).select("signal", "auroc", "rank"), "auroc")


@query(
    f"""WITH {SCORES}, h AS (SELECT stratum, count(*) AS n, count(*) FILTER (y) AS n_incorrect, count(*) FILTER (NOT y) AS n_correct, avg(y::INT) AS base_rate FROM wide GROUP BY GROUPING SETS ((stratum), ()))
    SELECT stratum, CAST(n AS BIGINT) AS n, CAST(n_incorrect AS BIGINT) AS n_incorrect, CAST(n_correct AS BIGINT) AS n_correct, round(base_rate, 9) AS base_rate FROM h"""
)
def class_counts_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.class_counts(wide_scores(spark, sf), "stratum"), "base_rate")


@query(
    f"""WITH {SCORES}, b AS (SELECT *, CASE signal WHEN 'chars' THEN 1.0 WHEN 'distinct' THEN 2.0 WHEN 'random' THEN 1.0 ELSE 6.0 END::DOUBLE AS cost FROM {auroc_sql('signal')}),
    p AS (SELECT *, max(auroc) OVER (ORDER BY cost, auroc DESC, signal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM b)
    SELECT signal, cost AS cost_multiplier, round(auroc, 9) AS auroc FROM p WHERE best IS NULL OR auroc > best"""
)
def pareto_cost(spark: SparkSession, sf: str) -> DataFrame:
    cost = F.when(F.col("signal") == "distinct", 2.0).when(F.col("signal") == "words", 6.0).otherwise(1.0)
    return r9(L.pareto(M.auroc(scores(spark, sf), ["signal"]).withColumn("cost_multiplier", cost)).select("signal", "cost_multiplier", "auroc"), "auroc")


_HM = """h AS (SELECT *, greatest(auroc, 1 - auroc) AS a FROM b), v AS (SELECT *, a / (2 - a) AS q1, 2 * a * a / (1 + a) AS q2 FROM h),
  i AS (SELECT signal, auroc, sqrt(greatest((a * (1 - a) + (n_pos - 1) * (q1 - a * a) + (n_neg - 1) * (q2 - a * a)) / (n_pos * n_neg), 0)) AS se FROM v)"""


@query(
    f"""WITH {SCORES}, b AS (SELECT * FROM {auroc_sql('signal')}), {_HM}
    SELECT signal, round(auroc, 9) AS auroc, round(auroc - 1.959963984540054 * se, 9) AS analytic_low, round(auroc + 1.959963984540054 * se, 9) AS analytic_high FROM i"""
)
def hanley_mcneil_ci(spark: SparkSession, sf: str) -> DataFrame:
    out = C.analytic_intervals(M.auroc(scores(spark, sf), ["signal"])).select("signal", "auroc", "analytic_low", "analytic_high")
    return r9(out, "auroc", "analytic_low", "analytic_high")


@query(
    f"""WITH {SCORES}, q AS (SELECT signal, score, toxic AS y FROM scores), a AS (SELECT * FROM {auroc_sql('signal')}), b AS (SELECT * FROM {auroc_sql('signal', 'q')} WHERE signal <> 'words')
    SELECT signal, round(a.auroc, 9) AS left_auroc, round(b.auroc, 9) AS right_auroc, round(b.auroc - a.auroc, 9) AS delta, a.signal IS NOT NULL AS in_left, b.signal IS NOT NULL AS in_right
    FROM a FULL JOIN b USING (signal)"""
)
def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf)
    ends = lambda df: M.auroc(df, ["signal"]).select("signal", "auroc", F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"))
    out = C.compare_signals(ends(s), ends(s.withColumn("y", F.col("toxic")).where("signal <> 'words'")))
    return r9(out.select("signal", "left_auroc", "right_auroc", "delta", "in_left", "in_right"), "left_auroc", "right_auroc", "delta")


@query(
    f"""WITH {SCORES}, n AS (SELECT signal, min(score) AS lo, max(score) AS hi FROM scores GROUP BY signal)
    SELECT signal, y, CAST(least(19, floor(coalesce((score - lo) * 20 / nullif(hi - lo, 0), 0))) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM scores JOIN n USING (signal) GROUP BY ALL"""
)
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return C.score_histogram(scores(spark, sf))


@query(
    f"""WITH {SCORES}, l AS (SELECT 'quality' AS label_set, signal, score, y FROM scores UNION ALL SELECT 'toxic', signal, score, toxic FROM scores)
    SELECT label_set, signal, n, n_pos, n_neg, round(auroc, 9) AS auroc FROM {auroc_sql('label_set, signal', 'l')}"""
)
def rule_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf)
    w = s.select("qid", "y", "toxic").distinct()
    label = lambda c: F.when(F.col(c), "incorrect").otherwise("correct").alias("label")
    sets = w.select(F.lit("quality").alias("label_set"), "qid", label("y")).unionByName(w.select(F.lit("toxic").alias("label_set"), "qid", label("toxic")))
    return r9(L.rule_decomposition(s, sets), "auroc")


@query(f"WITH {SCORES} SELECT CAST(count(*) AS BIGINT) AS n_shared, CAST(count(*) FILTER (y <> toxic) AS BIGINT) AS n_differ, count(*) FILTER (y <> toxic) = 0 AS no_power FROM wide")
def power_block(spark: SparkSession, sf: str) -> DataFrame:
    w = wide_scores(spark, sf)
    label = lambda c: F.when(F.col(c), "incorrect").otherwise("correct").alias("label")
    sets = w.select(F.lit("a").alias("label_set"), "qid", label("y")).unionByName(w.select(F.lit("b").alias("label_set"), "qid", label("toxic")))
    return L.power_block(sets, "a", "b")


@query(f"WITH {SCORES}, m AS (SELECT lang AS v, count(*) AS n FROM documents GROUP BY 1) SELECT round(max(n) / sum(n), 9) AS modal_share, CAST(count(*) AS BIGINT) AS n_distinct FROM m".replace(f"WITH {SCORES}, m", "WITH m"))
def modal_share(spark: SparkSession, sf: str) -> DataFrame:
    code = F.ascii("lang") * 1000 + F.ascii(F.substring("lang", 2, 1))
    return M.modal_share(table(spark, sf, "documents"), code).select(F.round("modal_share", 9).alias("modal_share"), "n_distinct")


def platt_sql(source: str, steps: int = 40) -> str:
    """CTEs ending in ``fit`` (signal, a, b): the same Newton steps as a recursion, on the rows of ``source`` (signal, score, y)."""
    return f"""ps AS MATERIALIZED (SELECT signal, avg(score) AS m, stddev_pop(score) AS s FROM {source} GROUP BY signal),
    pz AS MATERIALIZED (SELECT signal, (score - m) / s AS z, y::INT AS t FROM {source} JOIN ps USING (signal)),
    pn AS (WITH RECURSIVE step(signal, i, a, b) AS (SELECT signal, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM ps UNION ALL
      SELECT signal, i + 1, a - ((hbb + 1e-9) * ga - hab * gb) / det, b - ((haa + 1e-9) * gb - hab * ga) / det FROM (SELECT *, (haa + 1e-9) * (hbb + 1e-9) - hab * hab AS det FROM (
        SELECT signal, i, a, b, sum((p - t) * z) AS ga, sum(p - t) AS gb, sum(greatest(p * (1 - p), 1e-12) * z * z) AS haa, sum(greatest(p * (1 - p), 1e-12) * z) AS hab, sum(greatest(p * (1 - p), 1e-12)) AS hbb
        FROM (SELECT step.*, z, t, 1 / (1 + exp(-greatest(-60.0, least(60.0, a * z + b)))) AS p FROM step JOIN pz USING (signal) WHERE i < {steps}) GROUP BY signal, i, a, b))) SELECT * FROM step),
    fit AS (SELECT signal, a / s AS a, b - a * m / s AS b FROM pn JOIN ps USING (signal) WHERE i = {steps})"""


@query(f"WITH {SCORES}, {platt_sql('scores')} SELECT signal, round(a, 6) AS a, round(b, 6) AS b FROM fit")
def platt_fit(spark: SparkSession, sf: str) -> DataFrame:
    return M.fit_platt(scores(spark, sf), ["signal"]).select("signal", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


_TRAINED = "('0x' || substr(sha256('20260101:' || qid), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 < 0.3"


@query(
    f"""WITH {SCORES}, half AS MATERIALIZED (SELECT signal, score, y FROM scores WHERE {_TRAINED}), {platt_sql('half')},
    v AS (SELECT signal, y, 1 / (1 + exp(-greatest(-60.0, least(60.0, a * score + b)))) AS p FROM scores JOIN fit USING (signal) WHERE NOT {_TRAINED}),
    g AS (SELECT signal, len(list_filter([i / 15.0::DOUBLE FOR i IN range(1, 15)], lambda e: e < p)) AS bin, count(*) AS n, avg(p) AS c, avg(y::INT) AS a FROM v GROUP BY ALL)
    SELECT signal, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM g GROUP BY signal"""
)
def calibrated_ece(spark: SparkSession, sf: str) -> DataFrame:
    from quillon.functions.numeric import hash_share

    out = L.calibration_table(scores(spark, sf), hash_share(F.lit("20260101"), F.col("qid")) < 0.3, [])
    return out.withColumn("ece", F.round("ece", 6))


def _fold_fit_sql(steps: int = 20, l2: float = 1e-3) -> str:
    """CTEs ending in ``w`` (held, w0, w1, w2): Newton steps of a logistic regression on (x1, x2) for each held-out fold of ``rows`` (qid, y, x1, x2, fold)."""
    h = {(i, j): f"h{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}
    minor = lambda i, j: "({} * {} - {} * {})".format(*[h[r, c] for r, c in ((i + 1, j + 1), (i + 2, j + 2), (i + 1, j + 2), (i + 2, j + 1)) for r, c in [(r % 3, c % 3)]])
    det = " + ".join(f"{h[0, j]} * {minor(0, j)}" for j in range(3))
    move = lambda i: "(" + " + ".join(f"{minor(j, i)} * g{j}" for j in range(3)) + ") / det"
    sums = ", ".join([*[f"sum((p - t) * z{i}) / count(*) + {l2} * any_value(w{i}) AS g{i}" for i in range(3)], *[f"sum(p * (1 - p) * z{i} * z{j}) / count(*) + {l2 if i == j else 0.0} AS h{i}{j}" for i in range(3) for j in range(i, 3)]])
    return f"""held AS (SELECT unnest(range(5)) AS held), st AS MATERIALIZED (SELECT held, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM rows, held WHERE fold <> held GROUP BY held),
    tr AS MATERIALIZED (SELECT held, y::INT AS t, 1.0::DOUBLE AS z0, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM rows JOIN st ON fold <> held),
    w AS (WITH RECURSIVE step(held, i, w0, w1, w2) AS (SELECT held, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM st UNION ALL
      SELECT held, i + 1, w0 - {move(0)}, w1 - {move(1)}, w2 - {move(2)} FROM (SELECT *, {det} AS det FROM (SELECT held, i, w0, w1, w2, {sums}
        FROM (SELECT step.*, t, z0, z1, z2, 1 / (1 + exp(-greatest(-30.0, least(30.0, w0 + w1 * z1 + w2 * z2)))) AS p FROM step JOIN tr USING (held) WHERE i < {steps}) GROUP BY held, i, w0, w1, w2)))
      SELECT held, w0, w1, w2 FROM step WHERE i = {steps})"""


@query(
    f"""WITH {SCORES}, rows AS MATERIALIZED (SELECT qid, y, chars AS x1, distinct_ AS x2, (row_number() OVER (PARTITION BY y ORDER BY {md5_sql("'31337'", 'qid')}, qid) - 1) % 5 AS fold FROM wide), {_fold_fit_sql()},
    oof AS (SELECT y, 1 / (1 + exp(-greatest(-30.0, least(30.0, w0 + w1 * (x1 - m1) / s1 + w2 * (x2 - m2) / s2)))) AS score FROM rows JOIN w ON fold = held JOIN st USING (held)),
    c AS (SELECT * FROM {auroc_sql('', 'oof')}), b AS (SELECT signal, auroc FROM {auroc_sql('signal')} WHERE signal IN ('chars', 'distinct'))
    SELECT c.n, c.n_pos AS n_incorrect, round(c.auroc, 8) AS cross_validated_auroc, round((SELECT max(auroc) FROM b), 8) AS best_single_auroc, (SELECT signal FROM b ORDER BY auroc DESC LIMIT 1) AS best_single_name,
           round(c.auroc - (SELECT max(auroc) FROM b), 8) AS improvement, c.auroc - (SELECT max(auroc) FROM b) > 0.02 AS beats_best_single FROM c"""
)
def logreg_combination(spark: SparkSession, sf: str) -> DataFrame:
    """Two signals together, cross-validated, against the better one."""
    out = L.combination(scores(spark, sf), "chars", "distinct", steps=20)
    return out.withColumns({c: F.round(c, 8) for c in ("cross_validated_auroc", "best_single_auroc", "improvement")})


_BY = "stratum, signal"
_CORR = "CASE WHEN stddev_pop({0}) * stddev_pop({1}) > 0 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"
_RESID_BY = _RESID.replace("OVER ()", f"OVER (PARTITION BY {_BY})")


@query(
    f"""WITH {SCORES}, b AS (SELECT s.stratum, s.signal, s.score, s.y, w.chars FROM scores s JOIN wide w USING (qid) WHERE s.signal IN ('distinct', 'random')),
    k AS (SELECT {_BY}, {_RANK.format(by=_BY, x='score')} AS rx, {_RANK.format(by=_BY, x='y::INT')} AS rz, {_RANK.format(by=_BY, x='chars')} AS rg FROM b),
    e AS (SELECT {_BY}, round({_RESID_BY.format('x')}, 9) AS ex, round({_RESID_BY.format('z')}, 9) AS ez FROM k), f AS (SELECT {_BY}, {_RANK.format(by=_BY, x='ex')} AS rx, {_RANK.format(by=_BY, x='ez')} AS rz FROM e),
    r AS (SELECT {_BY}, {_CORR.format('rx', 'rz')} AS rho FROM k GROUP BY {_BY}), p AS (SELECT {_BY}, count(*) AS n, CASE WHEN count(*) >= 5 THEN {_CORR.format('rx', 'rz')} END AS partial_rho FROM f GROUP BY {_BY}),
    m AS (SELECT {_BY}, median(chars) AS med FROM b GROUP BY {_BY}), h2 AS (SELECT {_BY}, score, y, CASE WHEN chars <= med THEN 'at_or_below' ELSE 'above' END AS part FROM b JOIN m USING ({_BY})),
    a AS (SELECT * FROM {auroc_sql(_BY + ', part', 'h2')})
    SELECT {_BY}, round(rho, 8) AS rho, CAST(p.n AS BIGINT) AS n, round(partial_rho, 4) AS partial_rho, round(max(auroc) FILTER (part = 'at_or_below'), 9) AS at_or_below, round(max(auroc) FILTER (part = 'above'), 9) AS above
    FROM r JOIN p USING ({_BY}) JOIN a USING ({_BY}) GROUP BY {_BY}, rho, p.n, partial_rho"""
)
def length_audit(spark: SparkSession, sf: str) -> DataFrame:
    out = L.length_audit(wide_scores(spark, sf).withColumn("length", F.col("chars")), ["distinct", "random"], "length", ["stratum"])
    out = out.withColumns({"rho": F.round("rho", 8), "partial_rho": F.round("partial_rho", 4)})
    return r9(out.select("stratum", "signal", "rho", "n", "partial_rho", "at_or_below", "above"), "at_or_below", "above")
