import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,want",
    [("The  Beatles!", "beatles"), ("An apple, a day", "apple day"), ("Straße", "strasse"), ("O’Neil", "oneil"), ("«Oui»", "oui"), ("", ""), ("the", ""), ("Άλφας", "άλφασ")],
)
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize(F.col("t")), t=raw) == want
    assert one(spark, F.get(T.normalize_all(F.array(F.col("t"), F.lit("x"))), F.lit(0)), t=raw) == want


def test_normalize_exact_folds_compatibility_forms(spark):
    assert one(spark, T.normalize(F.col("t")), t="ﬁne １２") == "fine 12"


@pytest.mark.parametrize("a,b,want", [("New York City", "New York", 0.8), ("xx xx", "xx", 2 / 3), ("", "", 1.0), ("x", "", 0.0)])
def test_token_f1(spark, a, b, want):
    assert one(spark, T.token_f1(T.tokens(F.col("a")), T.tokens(F.col("b"))), a=a, b=b) == pytest.approx(want)


def test_pairwise_f1(spark):
    texts = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, T.mean_pairwise_f1(texts("paris", "paris", "london"))) == pytest.approx(1 / 3)
    assert one(spark, T.mean_pairwise_f1(texts("paris"))) == 1.0


@pytest.mark.parametrize("raw,want", [("INCORRECT", "incorrect"), ("Correct.", "correct"), ("AMBIGUOUS!", "ambiguous"), ("I think correct", None), ("correctly", None)])
def test_verdict(spark, raw, want):
    assert one(spark, T.parse_verdict(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,want", [("90%", 0.9), ("7", 0.07), (" 100 % ", 1.0), ("101", None), ("about 90", None), ("", None)])
def test_confidence(spark, raw, want):
    assert one(spark, T.parse_confidence(F.col("t")), t=raw) == (pytest.approx(want) if want is not None else None)


def test_leakage_is_by_token(spark):
    asked = lambda q, *a: one(spark, T.gold_in_question(F.lit(q), F.array(*map(F.lit, a))))
    assert not asked("who leads finance?", "nan")
    assert asked("What is Rome the capital of?", "Rome")


def test_first_line_and_prefix(spark):
    assert one(spark, T.clean_answer(F.col("t")), t="\n  Answer: Paris \nmore") == "Paris"
    assert one(spark, T.clean_answer(F.col("t")), t="unknown.") == "UNKNOWN"
    assert one(spark, T.first_line(F.col("t")), t="  \n ") == ""


def test_first_run(spark):
    assert one(spark, T.first_run(F.lit("a b c b c"), F.lit("b c"))) == 1
    assert one(spark, T.first_run(F.lit("a b"), F.lit("c"))) == -1


def test_alias_json(spark):
    parse = lambda raw: one(spark, T.parse_alias_json(F.lit(raw), F.lit("obj")))
    assert parse('["x", "obj", " y "]') == ["obj", "x", "y"]
    assert parse("broken [") == ["obj"]
    assert parse('"single"') == ["obj", "single"]


def test_granularity_and_echo(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, T.spans_granularity(arr("Paris", "Paris, France")))
    assert not one(spark, T.spans_granularity(arr("Paris", "Lutetia")))
    assert one(spark, T.inverse_subject(F.lit("What is Rome the capital of?"))) == "Rome"
    assert one(spark, T.echoes(F.lit("Rome!"), F.lit("Rome"))) == "exact"


def test_render(spark):
    assert one(spark, T.render("Q: {q} A: {a}", q=F.lit("x?"), a=F.lit(" "))) == "Q: x? A: (empty)"


def test_labels_fold_compatibility_forms(spark):
    from quillon.operators.labels import fuzzy_label

    gold = F.array(F.lit("ﬁne １２"), F.lit("other"))
    assert one(spark, T.exact_match(F.col("t"), gold), t="Fine 12.") is True
    assert one(spark, T.gold_in_question(F.col("t"), gold), t="is it ＦＩＮＥ 12?") is True
    assert one(spark, fuzzy_label(F.col("t"), gold, F.lit("how is it?")), t="fine 12") == "correct"
