"""Whitening, chat formatting and hard negatives against plain versions, with awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, hard_negatives, whitening
from quillon.llm.queries import OP12_SQL
from quillon.llm.whitening import Moments, symmetric_qr, whiten

VEC = "vec_id long, embedding array<float>, label int, n int, component string"


def vectors(seed=3, n=150, d=8):
    """Clustered vectors with nulls, NaN, infinities, repeats, ties, other lengths and a null id."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, d))
    rows = [(i, (centre[i % 5] + rng.normal(size=d) * 0.3).astype("f4").tolist(), int(i % 4)) for i in range(n)]
    for i in range(7, n, 9):
        rows[i] = (i, rows[i - 1][1], rows[i][2])  # the same vector under other ids
    rows += rows[20:30]  # repeated rows
    rows += [(900, None, 1), (901, [1.0, None] + [0.0] * (d - 2), 2), (902, [float("nan")] * d, 1), (903, [float("inf")] * d, 0), (904, [0.5] * d, None), (905, [], 1), (None, [0.25] * d, 2)]
    rows += [(950, [0.5, 0.25], 1), (1000, [0.5, -0.25], 1), (952, [0.5, 0.25], 2), (953, [0.25, 0.0], 2), (954, [0.5, 0.25], 1)]
    return [(*r, 0, "x") for r in rows]


def kept(rows, with_label=False):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and (not with_label or (r[2] is not None and r[0] is not None))]


def slow_whiten(rows, top=16):
    """Row by row with whole numbers: {(id, x, component): (n, deviation, |whitened|, explained)}."""
    out = {}
    whole = [(r[0], tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1])) for r in kept(rows)]
    for size in {len(x) for _, x in whole} - {0}:
        fit = sorted({x for _, x in whole if len(x) == size})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        cov = [[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) / n**3 for j in range(size)] for i in range(size)]
        values, axes = np.linalg.eigh(np.array(cov))
        values, axes = values[::-1], axes[:, ::-1]
        for i, x in whole:
            if len(x) == size:
                away = [n * a - s for a, s in zip(x, sums, strict=True)]
                for m in range(min(top, size)):
                    flat = values[m] <= 1e-12 * sum(values)
                    w = None if flat else abs(float(np.dot(np.array(away, float) / n, axes[:, m])) / math.sqrt(values[m]))
                    out[i, x, m + 1] = (n, sum(a * a for a in away), w, None if sum(values) <= 0 else max(values[m], 0) / sum(values))
    return out


def test_whitening(spark):
    rows = vectors()
    want = slow_whiten(rows)
    got = whiten(spark.createDataFrame(rows, VEC).repartition(7)).collect()
    ids = [r[0] for r in kept(rows) if r[1] for _ in range(min(16, len(r[1])))]
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted((i is None, i or 0) for i in ids)
    by_id = {}
    for (i, _, m), v in want.items():
        by_id.setdefault((i, m), v)
    for r in got:
        n, deviation, white, explained = by_id[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert (r["whitened"] is None) == (white is None)
        assert white is None or abs(abs(r["whitened"]) - white) < 1e-9
        assert abs(r["explained"] - explained) < 1e-12
        assert r["identity_error"] < 1e-9


def test_whitening_of_little(spark):
    assert whiten(spark.createDataFrame([], VEC)).collect() == []
    one = whiten(spark.createDataFrame([(1, [0.5, 0.25], 0, 0, "x")] * 3, VEC)).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 0, 0, "x") for i in range(4)], VEC)).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True}
    far = whiten(spark.createDataFrame([(1, [3e38], 0, 0, "x"), (2, [-3e38], 0, 0, "x"), (3, [0.0], 0, 0, "x")], VEC)).collect()
    assert len(far) == 3 and {r["deviation"] for r in far if r["vec_id"] != 3} == {None}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 60])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for spread in (rng.normal(size=(n, n)), np.diag(np.arange(n) // 3).astype(float), np.zeros((n, n)), np.ones((n, n))):
        a = spread @ spread.T
        values, axes = symmetric_qr(a)
        scale = max(1.0, float(np.abs(a).max(initial=0)))
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * scale * max(n, 1))
        assert np.allclose(axes @ axes.T, np.eye(n), atol=1e-12)
        assert np.allclose(axes.T * values @ axes, a, atol=1e-12 * scale * max(n, 1))


def test_moments_in_any_parts():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(1000, 6)) * [1, 2, 3, 4, 5, 6]
    total = Moments.of(6)
    for part in np.split(rows, [1, 2, 500, 777]):
        m = Moments.of(6)
        for some in np.array_split(part, 3):
            if len(some):
                m.add(some)
        total.merge(m)
    assert total.n == 1000 and np.allclose(total.covariance(), np.cov(rows.T, bias=True), rtol=1e-12)


def test_states_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = [(i, [float(i % 13), float(i % 7), float(i % 5)], 0, 0, "x") for i in range(400)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = whiten(spark.createDataFrame(rows, VEC).repartition(9)).where("vec_id = 11").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = slow_whiten(rows)
    x = next(k[1] for k in want if k[0] == 11)
    assert all(abs(abs(r["whitened"]) - want[11, x, r["component"]][2]) < 1e-9 for r in got)


def slow_negatives(rows, every=5, k=5, least=50, most=95):
    whole = sorted({(r[0], r[2], tuple(math.floor(256 * float(np.float32(c))) for c in r[1])) for r in kept(rows, True)})
    out = set()
    anchors = {}
    for i, y, x in whole:
        key = (len(x), np.array(x, float).tobytes(), y)
        if i % every == 0 and ((i, len(x)) not in anchors or key < anchors[i, len(x)][0]):
            anchors[i, len(x)] = (key, y, x)
    for (i, size), (_, y, x) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), j, z) for j, z, v in whole if j != i and len(v) == size)
        for s, j, z in [t for t in scored if t[2] == y][:k]:
            good = [t for t in scored if t[2] != y and least * -s <= 100 * -t[0] <= most * -s][:3]
            out |= {(i, j, n + 1, t[1], -s, -t[0]) for n, t in enumerate(good)}
    return out


@pytest.mark.parametrize(("block", "records"), [(1024, 256), (7, 4)])
def test_hard_negatives(spark, monkeypatch, block, records):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "LIST_ROWS", records)
    monkeypatch.setattr(hard_negatives, "FIRST_LISTS", 1)
    rows = vectors(n=120)
    got = hard_negatives.mine(spark.createDataFrame(rows, VEC).repartition(5), every=5 if block > 7 else 10)
    assert {tuple(r) for r in got.collect()} == slow_negatives(rows, 5 if block > 7 else 10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_little(spark):
    for rows in ([], [(1, [1.0], 0, 0, "x")], [(50, [1.0], 0, 0, "x")], [(50, [1.0], 0, 0, "x"), (51, [1.0], 0, 0, "x")], [(50, [], 0, 0, "x"), (51, [], 0, 0, "x"), (52, [], 1, 0, "x")]):
        got = [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, VEC)).collect()]
        assert got == ([(50, 51, 1, 52, 0, 0)] if len(rows) == 3 else [])


def test_bounds_hold_and_lists_are_left_out():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * (rng.normal(size=(400, 6)) * 0.05 + np.eye(6)[rng.integers(0, 6, 400)]))
    centroids = np.array([rows[rows.argmax(axis=1) == c].mean(axis=0) for c in range(6)])
    at = hard_negatives._nearest(rows, centroids)
    radius = np.array([np.sqrt(((rows[at == c] - centroids[c]) ** 2).sum(axis=1)).max() for c in range(6)])
    anchors = rows[:20]
    low, high = hard_negatives._bounds({"vectors": anchors, "norms": np.sqrt((anchors**2).sum(axis=1))}, {"centroids": centroids, "radius": radius})
    scores = anchors @ rows.T
    assert (scores <= high[:, at]).all() and (scores >= low[:, at]).all()
    tenth = np.sort(scores, axis=1)[:, -10]
    assert (high < tenth[:, None]).mean() > 0.5  # most lists need no visit


CHAT = "conv_id long, turn long, role string, text string, start long, pos string"


def chats(seed=2):
    rng = random.Random(seed)
    bits = ["###", "##", "#", "</turn>", "</turn", ">", "\\", "\\s", "\\h", "\\e", "\\c", ": ", ":", "\n", "### user: ", "é", "𝄞", " ", "</turn>\n", "ok"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "assistant", "a: b", "###\\"]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(50, 0, "user", None), (50, 1, "assistant", None), (51, 0, None, "x"), (52, None, "assistant", "first"), (52, 0, "assistant", "tie"), (52, 0, "assistant", "tie"), (None, 0, "assistant", "nobody's")]
    rows += [(53, t, "assistant" if t % 2 else "user", "long " * 2000) for t in range(300)]
    rng.shuffle(rows)
    return [(*r, 0, "x") for r in rows]


def slow_digests(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark):
    rows = chats()
    formatted = chat.segments(spark.createDataFrame(rows, CHAT).repartition(5))
    got = chat.digests(formatted)
    assert {r["conv_id"]: tuple(r)[1:5] for r in got.collect()} == slow_digests(rows)
    assert "Python" not in got._jdf.queryExecution().toString()
    assert chat.digests(chat.segments(spark.createDataFrame([], CHAT))).collect() == []


def test_chat_examples_are_prefixes(spark):
    rows = chats()
    formatted = chat.segments(spark.createDataFrame(rows, CHAT)).where("conv_id is not null").cache()
    whole = {}
    for r in formatted.orderBy("conv_id", "pos").collect():
        assert r["start"] == len(whole.get(r["conv_id"], ""))
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["segment"]
    examples = chat.examples(formatted).collect()
    texts = {(r["conv_id"], r["example"]): r for r in chat.with_text(formatted).collect()}
    assert len(examples) == len(texts) == sum(r[2] == "assistant" and r[0] is not None for r in rows)
    undo = lambda s: s.replace("\\e", "</turn>").replace("\\h", "###").replace("\\s", "\\")
    for r in examples:
        text = texts[r["conv_id"], r["example"]]["text"]
        assert whole[r["conv_id"]].startswith(text) and len(text) == r["loss_end"]
        assert undo(text[r["loss_start"] :]) == r["target"]
        assert text[: r["loss_start"]].endswith("### assistant: ") and text[: r["context_chars"]].count("</turn>\n") == r["context_turns"]
    formatted.unpersist()


def test_control_strings_of_the_template(spark):
    odd = "\\### Assistant: </turn> ok"
    made = chat.segments(spark.createDataFrame([(-7, 0, "user", odd, 0, "x"), (-7, 1, "assistant", odd, 0, "x")], CHAT))
    text = "".join(r["segment"] for r in made.orderBy("pos").collect())
    assert text == "### user: \\s\\h Assistant: \\e ok</turn>\n### assistant: \\s\\h Assistant: \\e ok</turn>\n"
    back = spark.createDataFrame([(text,)], "t string").select(F.explode(chat.parsed(F.col("t"))).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in back] == [("user", odd), ("assistant", odd)]
    assert "conversations" in OP12_SQL


def test_digests_read_the_mask_in_the_expanded_examples(spark):
    """The loss text is what each example's own prefix says at its span, not what a turn says by itself."""
    from hashlib import sha256

    rows = [(1, 0, "user", "ab", 0, "x"), (1, 1, "assistant", "cdef", 0, "x"), (1, 2, "user", "g", 0, "x"), (1, 3, "assistant", "hijk", 0, "x"), (2, 0, "user", "l", 0, "x")]
    formatted = chat.segments(spark.createDataFrame(rows, CHAT))
    moved = formatted.withColumn("segment", F.when(F.col("pos") == 1, F.concat(F.lit("z"), F.col("segment"))).otherwise(F.col("segment")))
    got = {r["conv_id"]: r for r in chat.digests(moved).collect()}
    loss = "".join(r["text"][r["loss_start"] : r["loss_end"]] for r in sorted(chat.with_text(moved).where("conv_id = 1").collect(), key=lambda r: r["example"]))
    assert loss == " cde hij" and got[1]["loss_sha256"] == sha256(loss.encode()).hexdigest()
    assert got[2]["loss_chars"] == 0 and got[2]["n_turns"] == 1
    told = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert told[1]["loss_sha256"] == sha256(b"cdefhijk").hexdigest()
