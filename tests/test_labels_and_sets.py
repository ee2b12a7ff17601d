import pytest
from pyspark.sql import functions as F

from quillon.operators import clusters as K
from quillon.operators import datasets as D
from quillon.operators import labels as A
from quillon.operators import signals as S
from quillon.schema import ContractError, assert_questions, assert_unique


@pytest.mark.parametrize(
    "answer,gold,question,want",
    [
        ("Jamaica", ["Kingston"], "What is the capital of Jamaica?", "incorrect"),
        ("whale", ["Unicorn Whale"], "What animal is a narwhal?", "ambiguous"),
        ("Oman's capital is Muscat.", ["Muscat"], "What is the capital of Oman?", "correct"),
        ("Kuwait was not invaded", ["Kuwait"], "Which country was not invaded?", "ambiguous"),
        ("Bram Stoker, the Irish novelist", ["Stoker"], "Who wrote Dracula?", "ambiguous"),
        ("Muscat", ["Muscat"], "What is the capital of Oman?", "correct"),
        ("", ["x"], "q?", "incorrect"),
        ("London", ["Paris"], "What is the capital of France?", "incorrect"),
    ],
)
def test_fuzzy_rule(spark, answer, gold, question, want):
    df = spark.createDataFrame([(answer, gold, question)], "a string, g array<string>, q string")
    assert df.select(A.fuzzy_label(F.col("a"), F.col("g"), F.col("q"))).first()[0] == want


def test_label_rows_prefers_equal_texts_then_judge(spark):
    g = spark.createDataFrame([("q1", "Capital?", ["Paris"], "Answer: paris"), ("q2", "Capital?", ["Paris"], "London"), ("q3", "Capital?", ["Paris"], "UNKNOWN"), ("q4", "Capital?", ["Paris"], "Rome")], "qid string, question string, gold_answers array<string>, greedy_text string")
    judge = spark.createDataFrame([("q1", "INCORRECT"), ("q2", "CORRECT"), ("q4", "no idea")], "qid string, raw string")
    got = {r["qid"]: (r["label"], r["source"]) for r in A.label_rows(g, judge).collect()}
    assert got == {"q1": ("correct", "exact_match"), "q2": ("correct", "judge_primary"), "q3": ("abstain", "exact_match"), "q4": ("incorrect", "heuristic_fuzzy")}


def test_ambiguity_guard(spark):
    df = spark.createDataFrame([(1, "Where is Georgia?", "US"), (2, "where is georgia", "GE"), (3, "Where is Georgia", "US"), (4, "Same?", "A"), (5, "same", "A")], "id int, question string, subj string")
    assert {r["id"] for r in D.drop_ambiguous(df, "question", "subj").collect()} == {4, 5}
    assert tuple(D.ambiguity_counts(df, "question", "subj").first()) == (1, 3)


def test_merge_duplicates(spark):
    df = spark.createDataFrame([("popqa-2", "p", "What is it?", ["Lazio", "Rome"]), ("popqa-1", "p", "what is it", ["Rome"])], "qid string, dataset string, question string, gold_answers array<string>")
    row = D.merge_duplicates(df).first()
    assert (row["qid"], row["gold_answers"], row["collapsed"]) == ("popqa-1", ["Rome", "Lazio"], 1)


def test_popqa_and_triviaqa(spark):
    raw = spark.createDataFrame(
        [("1", "Rome", "capital", "Italy", "10", "1", "What is it?", '["Italia"]'), ("2", "x", "capital", "y", "bad", "1", " ", "[]"), ("3", "z", "author", "w", "99", "1", "Who wrote z?", "broken")],
        ["id", "subj", "prop", "obj", "s_pop", "o_pop", "question", "possible_answers"],
    )
    got = {r["qid"]: r["gold_answers"] for r in D.popqa_questions(raw).collect()}
    assert got == {"popqa-1": ["Italy", "Italia"], "popqa-3": ["w"]}
    assert D.popqa_questions(raw, relations=["author"]).count() == 1
    with pytest.raises(ContractError):
        D.popqa_questions(raw, relations=["nope"])
    assert D.popqa_questions(raw, popularity_quantile=0.9).count() == 1
    t = spark.createDataFrame([(0, "Q one?", "a", ("X", ["X", "Y"], None)), (1, "Q two?", "a", ("Z", [], None)), (2, " ", "b", ("Z", [], None))], "src_pos long, question string, question_id string, answer struct<value:string,aliases:array<string>,normalized_aliases:array<string>>")
    assert [(r["qid"], r["gold_answers"]) for r in D.triviaqa_questions(t).collect()] == [("triviaqa-a", ["X", "Y"])]


def test_sampling(spark):
    df = spark.createDataFrame([(f"q{i}",) for i in range(50)], "qid string")
    one, two = (sorted(r["qid"] for r in D.hash_sample(d, 10, 3).collect()) for d in (df, df.repartition(7)))
    assert one == two and len(one) == 10
    assert D.exact_sample(df, 10, 3).count() == 10
    with pytest.raises(ContractError):
        D.exact_sample(df, 51, 3)
    assert D.train_mask(df, 0.3, 1).where("train").count() == 15


def test_contracts(spark):
    with pytest.raises(ContractError):
        assert_unique(spark.createDataFrame([("a",), ("a",)], "qid string"), "qid")
    q = spark.createDataFrame([("a", "d", "Same?", ["x"]), ("b", "d", "same", ["x"])], "qid string, dataset string, question string, gold_answers array<string>")
    with pytest.raises(ContractError):
        assert_questions(q, __import__("quillon.functions.text", fromlist=["x"]).normalize("question"))
    with pytest.raises(ContractError):
        D.assert_disjoint(q, ["SAME!"])


def chain(spark):
    scores = F.expr("map('0,1', 0.95D, '1,0', 0.95D, '1,2', 0.95D, '2,1', 0.95D, '0,2', 0.1D, '2,0', 0.1D)")
    return spark.range(1).select(F.array(*[F.lit(x) for x in ("ax", "bx", "cx")]).alias("a"), scores.alias("s"))


def test_clustering_chain(spark):
    row = chain(spark).select(K.cluster_sizes(K.cluster_greedy(F.col("a"), F.col("s"), 0.9)).alias("g"), K.cluster_sizes(K.cluster_exhaustive(F.col("a"), F.col("s"), 0.9)).alias("x")).first()
    assert row["g"] == [2, 1] and row["x"] == [3]
    assert not chain(spark).select(K.same_partition(F.array(F.lit(0), F.lit(0)), F.array(F.lit(0), F.lit(1)))).first()[0]


def test_family_b(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    raw = S.family_b(F.lit("g"), arr("a", "b", "c", "d", "e"), arr(1, 1, 1, 1, 1, 1), arr(1, 1, 1, 1, 1))
    row = spark.range(1).select(*[v.alias(k) for k, v in raw.items()]).first()
    import math

    assert row["b_distinct_count"] == 6 and row["b_semantic_entropy"] == pytest.approx(math.log(6)) and row["b_semantic_entropy_samples_only"] == pytest.approx(math.log(5)) and row["b_semantic_entropy_normalized"] == pytest.approx(1)
    plural = S.family_b(F.lit("rome"), arr("rome", "rome", "rome", "x", "y"), arr(4, 1, 1), arr(3, 1, 1))
    assert spark.range(1).select(plural["b_disagreement_rate_samples_only"]).first()[0] == pytest.approx(0.4)


def test_relabel_keeps_equal_texts(spark):
    g = spark.createDataFrame([("q1", "Capital?", ["Paris"], "paris"), ("q2", "Capital?", ["Paris"], "London")], "qid string, question string, gold_answers array<string>, greedy_text string")
    old = spark.createDataFrame([("q1", "correct", "exact_match"), ("q2", "correct", "judge_primary")], "qid string, label string, source string")
    got = {r["qid"]: (r["new_label"], r["moved"]) for r in A.relabel(old, g).collect()}
    assert got == {"q1": ("correct", False), "q2": ("incorrect", True)}


def test_stated_items(spark):
    """Items of fewer tokens than the lead are found in longer documents."""
    docs = spark.createDataFrame([(1, "x x x Alpha beta, gamma y y y"), (2, "alpha beta gamma"), (3, None), (4, "a b c d e f g h"), (5, "alpha beta"), (6, "")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "b c d e f g"), (3, "..."), (4, None), (5, "beta"), (6, "c d e f g z")], "item_id int, text string")
    got = sorted(map(tuple, D.stated_items(docs, items).collect()))
    assert got == [(1, 1), (1, 5), (2, 1), (2, 5), (4, 2), (5, 5)]


def test_stated_items_normalizes_candidates_only(spark):
    """The second reading of texts is cut to candidates before it normalizes them."""
    docs = spark.createDataFrame([(1, "x Alpha beta, gamma y"), (2, "alpha beta"), (2, "alpha beta gamma"), (3, None)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta")], "item_id int, text string")
    got = D.stated_items(docs, items)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS whole") < plan.index("Join LeftSemi")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 2)]


def test_row_set_sum(spark):
    df = spark.range(100).select(F.col("id").alias("qid"))
    a, b = D.row_set_sum(df).first(), D.row_set_sum(df.orderBy(F.desc("qid")).repartition(3)).first()
    assert a == b and a != D.row_set_sum(df.where("qid <> 5")).first()
