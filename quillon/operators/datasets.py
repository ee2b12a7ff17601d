"""Question sets: filters, guards, dedup and seeded sampling over candidate tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.numeric import hash_index, hash_share
from quillon.operators.quantiles import quantiles
from quillon.operators.ranges import checkpointed, global_rank, rank_within, running_sums
from quillon.schema import ContractError, require_columns

# Relations whose questions hold the answer's counterpart.
INVERSE_RELATIONS = ("capital of",)


def restrict_categories(df: DataFrame, column: str, wanted: list[str] | None, *, allow_inverse: bool = False) -> DataFrame:
    """Keep the wanted categories; None keeps all; an unknown or an inverse one raises."""
    if wanted is None:
        return df
    if not allow_inverse and (inverse := set(wanted) & set(INVERSE_RELATIONS)):
        raise ContractError(f"inverse relations {sorted(inverse)} need allow_inverse")
    found = {r[0] for r in df.select(column).where(F.col(column).isin(list(wanted))).distinct().collect()}  # at most the wanted ones
    if missing := sorted(set(wanted) - found):
        known = [r[0] for r in df.select(column).distinct().orderBy(column).limit(50).collect()]
        raise ContractError(f"unknown categories {missing}; there are {known}")
    return df.where(F.col(column).isin(list(wanted)))


def restrict_popular(df: DataFrame, column: str, quantile: float | None) -> DataFrame:
    """Keep rows at or above an exact quantile of a numeric text column; other rows go. None keeps all."""
    if quantile is None:
        return df
    x = F.col(column).try_cast("double")
    cut = quantiles(df.select(x.alias("x")), [], "x", [float(quantile)]).first()
    return df.where(x >= F.lit(cut["quantiles"][0]) if cut else F.lit(False))


def drop_ambiguous(df: DataFrame, question: str, subject: str, keep: list[str] | None = None) -> DataFrame:
    """Drop every row whose normalized question asks about several subjects.

    Questions meet by the SHA-256 of their normalized text. Where ``keep`` names
    the columns that are wanted, these and the digest are stored, so that texts
    are normalized once.
    """
    key = F.sha2(T.normalize(question), 256).alias("_nq")
    keyed = df.select("*", key) if keep is None else checkpointed(df.select(*dict.fromkeys([*keep, subject]), key))
    several = keyed.groupBy("_nq").agg(F.min(subject).alias("lo"), F.max(subject).alias("hi")).where("lo <> hi").select("_nq")
    return keyed.join(several, "_nq", "left_anti").select(*(df.columns if keep is None else keep))


def ambiguity_counts(df: DataFrame, question: str, subject: str) -> DataFrame:
    """Groups and rows that the ambiguity guard drops."""
    groups = df.groupBy(T.normalize(question).alias("q")).agg(F.countDistinct(subject).alias("k"), F.count(F.lit(1)).alias("n")).where("k > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def drop_blank(df: DataFrame, question: str, aliases: str) -> DataFrame:
    return df.where((F.trim(question) != "") & (F.size(aliases) > 0))


def drop_leaks(df: DataFrame, question: str, aliases: str) -> DataFrame:
    """Drop rows whose question states an alias."""
    return df.where(~F.coalesce(T.gold_in_question(F.col(question), F.col(aliases)), F.lit(False)))


#: Items whose leads are broadcast, and candidates whose ids are; more are joined by shuffling.
MOST_LEADS = 1_000_000


def stated_items(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", item: str = "item_id", text: str = "text", lead: int = 5) -> DataFrame:
    """(doc, item) of every item whose normalized tokens stand side by side in a document.

    A document is a candidate where one of its runs of tokens has the hash of an
    item's first ``lead`` tokens (all of them, if it has fewer); runs are hashed
    and looked up in the scan, and only candidates are normalized again and
    compared. An item without tokens is in nothing.
    """
    t = T.split_tokens(F.col("part"))
    leads = items.select(F.col(item), T.normalize(text).alias("part")).withColumns({"n": F.least(F.size(t), F.lit(lead)), "t": t}).where("n > 0")
    leads = checkpointed(leads.select(item, "part", "n", F.xxhash64("n", F.slice("t", F.lit(1), F.col("n"))).alias("lead")))
    sizes = [r[0] for r in leads.select("n").distinct().collect()]  # at most ``lead`` numbers

    def hashed(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.lit(n), F.slice("w", i, F.lit(n))))
        return F.when(F.size("w") >= n, runs).otherwise(F.array().cast("array<bigint>"))

    runs = docs.select(F.col(doc), T.normalize(text).alias("whole")).select(doc, T.split_tokens(F.col("whole")).alias("w")).select(doc, F.explode(F.concat(F.array().cast("array<bigint>"), *[hashed(n) for n in sizes])).alias("lead"))
    heads = leads.select(item, "lead")
    found = checkpointed(runs.join(F.broadcast(heads) if heads.count() <= MOST_LEADS else heads, "lead").select(doc, item).distinct())
    small = F.broadcast if found.count() <= MOST_LEADS else lambda df: df
    texts = docs.join(small(found.select(doc)), doc, "left_semi").select(F.col(doc), T.normalize(text).alias("whole"))
    return texts.join(small(found), doc).join(leads.select(item, "part"), item).where(T.contains_run(F.col("whole"), F.col("part"))).select(doc, item)


def looks_easy(question: Column, aliases: Column, least_aliases: int = 12, most_words: int = 20, most_alias_words: int = 4) -> Column:
    """A short question about an entity of many names, the first of them short."""
    words = lambda x: F.when(F.trim(x) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(x), r"\s+")))
    return (F.size(aliases) >= least_aliases) & (words(question) <= most_words) & (words(F.get(aliases, F.lit(0))) <= most_alias_words)


def first_by_id(df: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each id by source position, without a sort of whole groups."""
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(position)).alias("r"))
    return best.select(key, "r.*").select(*df.columns)


def popqa_questions(
    raw: DataFrame, *, relations: list[str] | None = None, popularity_quantile: float | None = None, allow_inverse: bool = False, drop_gold_in_question: bool = False
) -> DataFrame:
    """Candidates of an entity table (all columns text): filters, ambiguity guard, aliases with the object first."""
    require_columns(raw, "id", "subj", "prop", "obj", "s_pop", "question", "possible_answers")
    df = restrict_categories(raw, "prop", relations, allow_inverse=allow_inverse)
    df = restrict_popular(df, "s_pop", popularity_quantile)
    df = drop_ambiguous(df, "question", "subj_id" if "subj_id" in raw.columns else "subj")
    df = df.withColumn("gold_answers", T.parse_alias_json(F.col("possible_answers"), F.col("obj")))
    df = drop_blank(df, "question", "gold_answers")
    df = drop_leaks(df, "question", "gold_answers") if drop_gold_in_question else df
    return df.select(F.concat(F.lit("popqa-"), "id").alias("qid"), F.lit("popqa").alias("dataset"), F.trim("question").alias("question"), "gold_answers")


def triviaqa_questions(raw: DataFrame, *, easy_only: bool = False, least_aliases: int = 12, drop_gold_in_question: bool = False, position: str = "src_pos") -> DataFrame:
    """Candidates of a nested table: first usable row of each id; the leak test sees that row alone."""
    require_columns(raw, "question", "question_id", "answer", position)
    df = raw.withColumn("gold_answers", T.struct_aliases(F.col("answer")))
    df = drop_blank(df, "question", "gold_answers")
    df = df.where(looks_easy(F.col("question"), F.col("gold_answers"), least_aliases)) if easy_only else df
    df = first_by_id(df.select("question_id", "question", "gold_answers", position), "question_id", position)
    df = drop_leaks(df, "question", "gold_answers") if drop_gold_in_question else df
    return df.select(F.concat(F.lit("triviaqa-"), "question_id").alias("qid"), F.lit("triviaqa").alias("dataset"), F.trim("question").alias("question"), "gold_answers")


def merge_duplicates(df: DataFrame) -> DataFrame:
    """One row per normalized question: the smallest qid's, with the aliases of all, in qid order and each once.

    Questions are grouped by length and two hashes of the normalized text, 128
    bits, so that long texts are not shuffled as keys; the aliases of one
    question are one list, as they are in the result.
    """
    nq = T.normalize("question")
    keyed = df.select("qid", "dataset", "question", "gold_answers", nq.alias("_nq")).withColumns({"_n": F.length("_nq"), "_h": F.xxhash64("_nq"), "_g": F.xxhash64(F.lit(1), "_nq")}).drop("_nq")
    groups = keyed.groupBy("_n", "_h", "_g").agg(
        F.min_by(F.struct("qid", "dataset", "question"), "qid").alias("first"),
        F.array_sort(F.collect_list(F.struct("qid", "gold_answers"))).alias("all"),
        F.count(F.lit(1)).alias("merged"),
    )
    aliases = F.flatten(F.transform("all", lambda s: s["gold_answers"]))
    return groups.select("first.*", T.clean_aliases(aliases).alias("gold_answers"), (F.col("merged") - 1).alias("collapsed"))


def hash_sample(df: DataFrame, n: int, seed: int, key: str = "qid") -> DataFrame:
    """n rows by the order of a hash of seed and key; the same rows whatever the partitions."""
    return df.orderBy(hash_index(F.lit(str(seed)), F.col(key)), key).limit(n)


def exact_sample(df: DataFrame, n: int, seed: int, key: str = "qid") -> DataFrame:
    """n rows drawn without replacement by numpy's generator over the sorted keys; raises if there are fewer."""
    pool = df.count()
    if pool < n:
        raise ContractError(f"the pool has {pool} rows, {n} are asked for")
    picks = np.sort(np.random.default_rng(seed).choice(pool, size=n, replace=False))
    at = df.sparkSession.createDataFrame([(int(i),) for i in picks], "_at long")  # as many as are asked for
    ranked = global_rank(df, [key], "_at")
    return ranked.join(F.broadcast(at), "_at").drop("_at").orderBy(key)


def build(candidates: DataFrame, n: int, seed: int, *, exact: bool = False) -> DataFrame:
    """Dedup, draw n, order by qid."""
    pool = merge_duplicates(candidates)
    drawn = exact_sample(pool, n, seed) if exact else hash_sample(pool, n, seed)
    return drawn.drop("collapsed").orderBy("qid")


BUILDERS: dict[str, Callable[..., DataFrame]] = {"popqa": popqa_questions, "triviaqa": triviaqa_questions}


def build_mix(raw: dict[str, DataFrame], mix: dict[str, int], seed: int, options: dict[str, dict] | None = None) -> DataFrame:
    """Draw from every source that has a count; a source without a builder raises, one with count 0 is not looked at."""
    out = None
    for name, n in mix.items():
        if not n:
            continue
        if name not in BUILDERS:
            raise ContractError(f"no builder for {name!r}")
        part = build(BUILDERS[name](raw[name], **(options or {}).get(name, {})), n, seed)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ContractError("the mix is empty")
    return out


def audit_sample(df: DataFrame, fraction: float, key: str = "qid") -> DataFrame:
    return df.where(hash_share(F.col(key)) < fraction)


def train_mask(df: DataFrame, fraction: float, seed: int, key: str = "qid") -> DataFrame:
    """Add ``train``: true for bround(fraction * n) rows by hash order."""
    n = df.count()
    some = hash_sample(df.select(key), int(round(fraction * n)), seed, key).withColumn("train", F.lit(True))
    return df.join(some, key, "left").fillna(False, ["train"])


def assert_disjoint(questions: DataFrame, exemplars: list[str]) -> DataFrame:
    """Raise if an exemplar question is, normalized, one of the questions."""
    spark = questions.sparkSession
    shots = spark.createDataFrame([(e,) for e in exemplars], "exemplar string").select(T.normalize("exemplar").alias("nq"), "exemplar")
    leaked = shots.join(questions.select(T.normalize("question").alias("nq")), "nq", "left_semi").limit(1).collect()
    if leaked:
        raise ContractError(f"exemplar is in the evaluation set: {leaked[0]['exemplar']!r}")
    return questions


def not_done(df: DataFrame, done: DataFrame, key: str = "qid", limit: int | None = None) -> DataFrame:
    """Rows whose key has no result yet; with a limit, the first by key."""
    rest = df.join(done.select(key), key, "left_anti")
    return rest.orderBy(key).limit(limit) if limit is not None else rest


def balanced_sample(df: DataFrame, n: int, seed: int, label: str = "label", classes: tuple[str, str] = ("correct", "incorrect"), key: str = "qid") -> DataFrame:
    """Half of n from each class by hash order; what a small class lacks comes from the other."""
    order = hash_index(F.lit(str(seed)), F.col(key))
    two = df.where(F.col(label).isin(*classes))
    ranked = two.withColumn("_rn", F.row_number().over(Window.partitionBy(label).orderBy(order, key)))
    return ranked.orderBy((F.col("_rn") > n // 2), "_rn", label).limit(n).drop("_rn")


def label_plan(sets: DataFrame, quota_a: int, quota_b: int, key: str = "qid") -> DataFrame:
    """Smallest labelling order for two samples (flags in_a, in_b): shared rows, then each sample's own up to its quota."""
    shared = sets.where("in_a and in_b").count()
    kind = F.when(F.col("in_a") & F.col("in_b"), 0).when(F.col("in_a"), 1).otherwise(2)
    ranked = rank_within(sets.where("in_a or in_b").withColumn("part", kind), F.col("part"), [key], "_rn")
    quota = F.when(F.col("part") == 1, quota_a - shared).when(F.col("part") == 2, quota_b - shared).otherwise(F.lit(1 << 62))
    return global_rank(ranked.where(F.col("_rn") < quota), ["part", key], "_step").withColumn("step", (F.col("_step") + 1).cast("int")).drop("_rn", "_step")


def priority_order(df: DataFrame) -> DataFrame:
    """Unresolved rows, then moved ones, then the rest, by id, with ``place`` from 1."""
    return placed_by(df, F.when(F.col("source") == "heuristic_unresolved", 0).when(F.coalesce("moved", F.lit(False)), 1).otherwise(2), "qid")


def placed_by(df: DataFrame, *order: Column | str) -> DataFrame:
    """Add ``place``, the 1-based number of a row in a total order."""
    named = df.withColumns({f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)})
    return global_rank(named, [f"_o{i}" for i in range(len(order))], "_place").withColumn("place", (F.col("_place") + 1).cast("int")).drop("_place", *[f"_o{i}" for i in range(len(order))])


def stratified_folds(df: DataFrame, folds: int, seed: int, y: str = "y", key: str = "qid") -> DataFrame:
    """Deal the rows of each class round-robin in hash order."""
    hashed = df.withColumn("_hash", hash_index(F.lit(str(seed)), F.col(key)))
    return rank_within(hashed, F.col(y), ["_hash", key], "_place").withColumn("fold", (F.col("_place") % folds).cast("int")).drop("_hash", "_place")


def length_buckets(df: DataFrame, length: str, cap: int, position: str) -> DataFrame:
    """Batches of equal length, at most ``cap`` rows each: no padding in a batch."""
    return running_sums(df, [length], [position], []).withColumn("bucket", F.floor((F.col("k") - 1) / cap).cast("int")).drop("k")


def row_set_digest(df: DataFrame, key: str = "qid") -> DataFrame:
    """First 16 hex digits of the SHA-256 of the sorted keys, newline-joined: the reference form, for analysis sets, whose ids fit in one row; of large ones take ``row_set_sum``."""
    return df.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\n"), 256), 1, 16).alias("digest"))


def row_set_sum(df: DataFrame, key: str = "qid") -> DataFrame:
    """Order-free fingerprint of a set of keys of any size: count, and sums of two hashes."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col(key).cast("string")).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n"), h(1).alias("sum_1"), h(2).alias("sum_2"))


def gold_quality(df: DataFrame, by: str = "prop", position: str = "src_pos") -> DataFrame:
    """Per relation: candidates, alias counts, single-alias, leak and granularity shares, an example."""
    n = F.size("gold_answers")
    leak = F.exists("gold_answers", lambda a: T.contains_run(T.normalize_spaced(F.col("question")), T.normalize_spaced(a)))
    share = lambda c: F.bround(F.avg(c.cast("double")), 3)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("candidates"), F.bround(F.avg(n), 3).alias("mean_aliases"), F.median(n).alias("median_aliases"), share(n == 1).alias("single_alias_fraction"),
        share(leak).alias("leak_fraction"), share(T.spans_granularity(F.col("gold_answers"))).alias("granularity_fraction"), F.min_by("question", position).alias("example"),
    )


def echo_report(df: DataFrame) -> DataFrame:
    """Questions of the inverse template whose answer or alias repeats their subject."""
    told = df.withColumn("subject", T.inverse_subject(F.col("question"))).where("subject is not null")
    kind = T.echoes(F.col("greedy_answer"), F.col("subject"))
    gold = F.exists("gold_answers", lambda a: T.echoes(a, F.col("subject")) == "exact")
    return told.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kind == "exact").alias("answer_exact"), F.count_if(kind == "contained").alias("answer_contained"), F.count_if(gold).alias("alias_exact"),
        F.count_if((kind == "exact") & (F.col("label") == "correct")).alias("credited_echoes"),
    )


def template_share(df: DataFrame, template: Column, most: float = 0.4) -> DataFrame:
    """Share of the most frequent question template, and whether it is within the census limit."""
    counts = df.groupBy(template.alias("template")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max_by("template", F.struct("n", "template")).alias("template"), (F.max("n") / F.sum("n")).alias("share"))
    return top.withColumn("within", F.col("share") <= most)
