"""Labels: the rule cascade, judge fallback, agreement, relabelling, error patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.bind import let
from quillon.schema import ContractError

# Normalized words that negate a question.
NEGATIONS = (
    "not", "never", "no", "nobody", "nothing", "neither", "nor", "without", "except", "unless", "false", "deny", "denied",
    "refuse", "refused", "cannot", "cant", "didnt", "doesnt", "wasnt", "isnt", "arent", "wont", "nowhere",
)


def early_label(answer: Column, aliases: Column, abstain: str = T.ABSTAIN) -> Column:
    """abstain or correct where an equal text decides, else null."""
    return F.when(T.is_abstention(answer, abstain), "abstain").when(T.exact_match(answer, aliases), "correct")


def _outside(mine: Column, alias: Column) -> Column:
    """Tokens of an answer around the first place where an alias stands in it."""
    at, size, all_ = T.first_run(mine, alias), F.size(T.split_tokens(alias)), T.split_tokens(mine)
    return F.concat(F.slice(all_, F.lit(1), at), F.slice(all_, at + size + 1, F.size(all_)))


def fuzzy_label(answer: Column, aliases: Column, question: Column) -> Column:
    """correct, incorrect or ambiguous by how an answer's tokens relate to aliases and question.

    In order: an empty answer is wrong; an alias itself is right; an alias in
    nothing but words of the question is right, unless the question negates;
    a bare echo of the question is wrong; a part of a longer alias and an
    alias among other words are open; anything else is wrong.
    """

    def decide(mine: Column, words: Column, asked: Column, gold: Column) -> Column:
        def restates(a: Column) -> Column:
            return let(_outside(mine, a), lambda rest: (F.size(rest) > 0) & F.forall(rest, lambda t: T.covered(t, asked)))

        restated = F.exists(gold, lambda a: T.contains_run(mine, a) & restates(a))
        negated = F.arrays_overlap(asked, F.array(*map(F.lit, NEGATIONS)))
        return (
            F.when(F.coalesce(F.size(words), F.lit(0)) < 1, "incorrect")
            .when(F.array_contains(gold, mine), "correct")
            .when(restated, F.when(negated, "ambiguous").otherwise("correct"))
            .when(F.forall(words, lambda t: T.covered(t, asked)), "incorrect")
            .when(F.exists(gold, lambda a: (a != mine) & T.contains_run(a, mine)), "ambiguous")
            .when(F.exists(gold, lambda a: T.contains_run(mine, a)), "ambiguous")
            .otherwise("incorrect")
        )

    gold = F.filter(T.normalize_all(aliases), lambda a: a != "")
    known = F.struct(T.normalize(answer).alias("mine"), T.tokens(question).alias("asked"), gold.alias("gold"))
    return let(known, lambda k: let(T.split_tokens(k["mine"]), lambda words: decide(k["mine"], words, k["asked"], k["gold"])))


def heuristic_labels(df: DataFrame, abstain: str = T.ABSTAIN) -> DataFrame:
    """label and source without a judge, from question, gold_answers and greedy_text."""
    answer = T.clean_answer(F.col("greedy_text"), abstain)
    staged = df.withColumn("_answer", answer)
    early, fuzzy = early_label(F.col("_answer"), F.col("gold_answers"), abstain), fuzzy_label(F.col("_answer"), F.col("gold_answers"), F.col("question"))
    staged = staged.withColumns({"_early": early, "_fuzzy": fuzzy})
    source = F.when(F.col("_early").isNotNull(), "exact_match").when(F.col("_fuzzy") == "ambiguous", "heuristic_unresolved").otherwise("heuristic_fuzzy")
    return staged.withColumns({"label": F.coalesce("_early", "_fuzzy"), "source": source}).drop("_answer", "_early", "_fuzzy")


def contested(df: DataFrame, abstain: str = T.ABSTAIN) -> DataFrame:
    """Rows that equal texts do not decide: the only ones a judge has to see."""
    return df.where(early_label(T.clean_answer(F.col("greedy_text"), abstain), F.col("gold_answers"), abstain).isNull())


def label_rows(df: DataFrame, primary: DataFrame | None = None, secondary: DataFrame | None = None, abstain: str = T.ABSTAIN) -> DataFrame:
    """Labels with provenance: equal texts, then the primary judge, then the rule.

    Judge tables hold (qid, raw); a reply that does not parse leaves the row to
    the rule. Verdict columns are empty where a judge was not asked.
    """
    out = heuristic_labels(df, abstain)
    for name, judge in (("primary", primary), ("secondary", secondary)):
        if judge is None:
            out = out.withColumns({f"_{name}_raw": F.lit(None).cast("string")})
        else:
            out = out.join(judge.select("qid", F.col("raw").alias(f"_{name}_raw")), "qid", "left")
        out = out.withColumn(f"_{name}", T.parse_verdict(F.col(f"_{name}_raw")))
    judged = (F.col("source") != "exact_match") & F.col("_primary").isNotNull()
    return out.select(
        "qid",
        F.when(judged, F.col("_primary")).otherwise(F.col("label")).alias("label"),
        F.when(judged, "judge_primary").otherwise(F.col("source")).alias("source"),
        F.coalesce(F.substring("_primary_raw", 1, 200), F.lit("")).alias("judge_raw"),
        F.coalesce("_primary", F.lit("")).alias("judge_primary_verdict"),
        F.coalesce("_secondary", F.lit("")).alias("judge_secondary_verdict"),
    )


def kappa_from(counts: DataFrame, keys: list[str], a: str, b: str, n: str, trust: float = 0.7, floor: int = 10) -> DataFrame:
    """Cohen's kappa of a contingency table; null where chance agreement is total."""
    row = counts.groupBy(*keys, F.col(a).alias("c")).agg(F.sum(n).alias("_row"))
    col = counts.groupBy(*keys, F.col(b).alias("c")).agg(F.sum(n).alias("_col"))
    whole = counts.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col(n)).otherwise(0)).alias("agree"))
    on = [*keys, "c"]
    margins = row.join(col, on, "full_outer").fillna(0, ["_row", "_col"]).groupBy(*keys).agg(
        F.sum(F.col("_row").cast("double") * F.col("_col")).alias("product"), F.min(F.col("_row") + F.col("_col")).alias("minority_count"), F.count(F.lit(1)).alias("n_categories")
    )
    both = whole.join(margins, keys) if keys else whole.crossJoin(F.broadcast(margins))  # one row each without keys
    po, pe = F.col("agree") / F.col("n"), F.col("product") / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(pe < 1.0, (po - pe) / (1.0 - pe))
    trusted = F.coalesce((kappa >= trust) & (F.col("minority_count") >= floor), F.lit(False))
    return both.select(*keys, F.col("n").cast("long").alias("n"), F.col("agree").cast("long").alias("n_agree"), po.alias("observed"), pe.alias("expected"), kappa.alias("kappa"), F.col("minority_count").cast("long").alias("minority_count"), "n_categories", trusted.alias("trustworthy"))


def cohens_kappa(df: DataFrame, a: str, b: str, keys: list[str] | None = None, **options) -> DataFrame:
    """Agreement of two raters over rows that both rated."""
    keys = keys or []
    rated = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != "") & (F.col(b) != ""))
    return kappa_from(rated.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("cell")), keys, a, b, "cell", **options)


def assert_kappa_rows(judged: int, compared: int) -> None:
    if judged != compared:
        raise ContractError(f"kappa compared {compared} rows, both judges replied on {judged}")


def relabel(old: DataFrame, df: DataFrame, abstain: str = T.ABSTAIN) -> DataFrame:
    """Decide everything but equal texts anew: qid, old and new label and source, and whether the row moved."""
    new = heuristic_labels(df, abstain).select("qid", F.col("label").alias("new_label"), F.col("source").alias("new_source"))
    both = old.select("qid", F.col("label").alias("old_label"), F.col("source").alias("old_source")).join(new, "qid")
    keep = F.col("old_source") == "exact_match"
    both = both.withColumns({"new_label": F.when(keep, F.col("old_label")).otherwise(F.col("new_label")), "new_source": F.when(keep, F.col("old_source")).otherwise(F.col("new_source"))})
    return both.withColumn("moved", (F.col("old_label") != F.col("new_label")) | (F.col("old_source") != F.col("new_source")))


def _known(answer: Column, aliases: Column, question: Column | None = None) -> Column:
    """Normalized answer, aliases and question tokens in one struct, to be named once outside of any lambda."""
    asked = [] if question is None else [T.tokens(question).alias("asked")]
    return F.struct(T.normalize(answer).alias("mine"), T.normalize_all(aliases).alias("gold"), *asked)


def strict_match(answer: Column, aliases: Column, gap: int = 2) -> Column:
    """Equal to an alias, or part of one that is at most ``gap`` tokens longer."""

    def matches(k: Column) -> Column:
        size = F.size(T.split_tokens(k["mine"]))
        near = lambda a: T.contains_run(a, k["mine"]) & (F.size(T.split_tokens(a)) - size <= gap)
        return (k["mine"] != "") & F.exists(k["gold"], lambda a: (a == k["mine"]) | near(a))

    return let(_known(answer, aliases), matches)


def swallowed(answer: Column, aliases: Column) -> Column:
    """Whether the answer is a proper part of a longer alias."""
    return let(_known(answer, aliases), lambda k: F.exists(k["gold"], lambda a: (a != k["mine"]) & T.contains_run(a, k["mine"])))


def longest_covered_alias(answer: Column, aliases: Column, question: Column) -> Column:
    """The longest alias that the answer states among words of the question alone, or null."""

    def longest(k: Column) -> Column:
        gold = F.filter(k["gold"], lambda a: T.contains_run(k["mine"], a) & F.forall(_outside(k["mine"], a), lambda t: T.covered(t, k["asked"])))
        return F.array_max(F.transform(gold, lambda a: F.struct(F.size(T.split_tokens(a)).alias("n"), a.alias("alias"))))["alias"]

    return let(_known(answer, aliases, question), longest)


def error_patterns(df: DataFrame) -> DataFrame:
    """Rows whose label looks wrong: echoes called right, verbose answers called wrong, and the rate that bounds the error below."""
    both = F.struct(T.tokens(F.col("greedy_answer")).alias("told"), T.tokens(F.col("question")).alias("asked"))
    echoed = let(both, lambda b: (F.size(b["told"]) > 0) & F.forall(b["told"], lambda t: T.covered(t, b["asked"])))
    verbose = (F.col("label") == "incorrect") & longest_covered_alias(F.col("greedy_answer"), F.col("gold_answers"), F.col("question")).isNotNull()
    return df.withColumn("pattern", F.when((F.col("label") == "correct") & echoed, "echo_fp").when(verbose, "verbose_fn"))


def error_floor(df: DataFrame) -> DataFrame:
    found = error_patterns(df)
    return found.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pattern") == "echo_fp").alias("n_echo_fp"), F.count_if(F.col("pattern") == "verbose_fn").alias("n_verbose_fn"),
        F.avg(F.col("pattern").isNotNull().cast("double")).alias("error_rate_lower_bound"),
    )


def base_rate_probe(labelled: DataFrame) -> DataFrame:
    """Rows by dataset and outcome."""
    outcome = F.when(F.col("source") == "heuristic_unresolved", "unresolved").otherwise(F.col("label"))
    return labelled.withColumn("outcome", outcome).groupBy("dataset").pivot("outcome", ["abstain", "correct", "unresolved", "incorrect"]).count().fillna(0)
