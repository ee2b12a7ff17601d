"""Each operator against brute force on small tables with awkward rows."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, html_main, near_dedup, quality, topk, warc
from quillon.llm.graph import components
from quillon.llm.line_dedup import remove_repeated_lines, suffix_intervals
from quillon.llm.mixing import mix_sources
from quillon.llm.shared import global_rank
from quillon.llm.substring_dedup import remove_repeated_passages
from quillon.llm.suffix_dedup import remove_repeated_suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, lang string"


def words(n, rng, pool=400):
    return [f"w{rng.randrange(pool)}é" for _ in range(n)]


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, nulls, empties, repeated ids, one long text."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng.randrange(1, 160), rng)) for _ in range(n)]
    passage = " ".join(words(70, rng))
    for i in range(5, n, 7):
        texts[i] = texts[i] + " " + passage + "\n" + " ".join(words(20, rng))
    for i in range(9, n, 11):
        w = texts[i - 1].split()
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = "changed"
        texts[i] = " ".join(w)
    texts[20] = texts[3] = texts[41]
    texts[30], texts[31], texts[32], texts[33] = None, "", " \t\n ", "Solo"
    texts[34] = " ".join(words(6000, rng)) + " " + passage
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, "en") for i, t in enumerate(texts)]
    return [*rows, rows[7], (8, passage + " tail", "s1", "en"), (None, passage, "s2", None), (None, texts[3], "s2", None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "doc": F.lit("x"), "n_words": F.lit(0), "key": F.lit(None), "score": F.lit(1)}).repartition(3)


def removal(rows, length):
    """Windows that also start in a smaller document go."""
    big = 1 << 62
    first = {}
    for d, t, *_ in rows:
        w, d = WORD.findall(t or ""), big if d is None else d
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t, *_ in rows:
        w, key = WORD.findall(t or ""), big if d is None else d
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < key:
                gone |= set(range(i, i + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("operator", [remove_repeated_passages, remove_repeated_suffixes])
def test_passages(spark, operator):
    rows = corpus()
    got = operator(frame(spark, rows), length=50).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == removal(rows, 50)
    assert sum(r["n_removed"] for r in got) > 500
    assert operator(frame(spark, []), length=50).count() == 0


def test_lines(spark):
    rng = random.Random(3)
    pool = [f"line {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))), "s", "en") for i in range(40)]
    rows[5] = (5, None, "s", "en")
    rows[6] = (6, "\n\n\n\n", "s", "en")
    rows += [(None, rows[0][1], "s", "en"), (None, rows[1][1], "s", None)]
    clash = {c: F.lit("clash") for c in ("n_lines", "_gone", "_doc", "_row", "_lines", "doc", "row", "in", "runs", "lines")}
    got = remove_repeated_lines(spark.createDataFrame(rows, DOCS).withColumns(clash).repartition(3), min_lines=3)
    assert got.columns == ["doc_id", "text", "source", "lang", "_gone", "_doc", "_row", "_lines", "doc", "row", "in", "runs", "lines", "n_lines", "n_deleted"]
    assert {r[c] for r in got.collect() for c in got.columns[4:-2]} == {"clash"}
    text_hash = {r["t"]: r["h"] for r in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    place = lambda r: (1 << 62 if r[0] is None else r[0], text_hash[r[1] or ""])
    first = {}
    for r in sorted(rows, key=place):
        lines = (r[1] or "").split("\n") if r[1] else []
        for i in range(len(lines) - 2):
            first.setdefault(tuple(lines[i : i + 3]), (*place(r), i))
    want = []
    for r in rows:
        lines = r[1].split("\n") if r[1] else []
        gone = {j for i in range(len(lines) - 2) if first[tuple(lines[i : i + 3])] != (*place(r), i) for j in range(i, i + 3)}
        kept = r[1] if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        want.append((r[0], kept, len(lines), len(gone)))
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_deleted").collect()), key=str) == sorted(want, key=str)
    assert remove_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_maximal_line_runs(spark):
    """Intervals go as deep as the longest repeat; overlapping copies make one run."""
    lines = [f"l{i}" for i in range(300)]
    rows = [(1, "\n".join(lines), "s", "en"), (2, "\n".join(["a", *lines[20:270], "b", *lines[:2]]), "s", "en"), (3, "\n".join(lines[100:140] + lines[10:50]), "s", "en"), (4, "x\n" * 500, "s", "en")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in remove_repeated_lines(docs).collect()}
    assert [got[i]["n_deleted"] for i in (1, 2, 3, 4)] == [0, 250, 80, 499]
    assert got[2]["text"] == "a\nb\nl0\nl1" and got[3]["text"] == "" and got[4]["text"] == "x\n"
    split = docs.select(F.col("doc_id").alias("doc"), F.lit(1).alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    found = suffix_intervals(split.select("doc", "row", "pos", F.xxhash64("l").alias("l1"), F.xxhash64("l").alias("l2"), F.array(F.lit(1)).alias("words")), 3)
    assert sorted(found) == [1, 2, 3, *(1 << i for i in range(2, 10))] and found[512].isEmpty() and found[256].where("doc < 4").isEmpty()
    deep = found[128].where("doc < 4").groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    assert deep.count() == 123 and deep.where("n <> 2").isEmpty()  # 250 - 128 + 1 intervals of two suffixes


@pytest.mark.parametrize("min_lines", [3, 6])
def test_short_runs_of_many_words(spark, min_lines):
    """Every repeated run of fewer lines than ``min_lines`` goes as well where it has 50 words."""
    rng = random.Random(11)
    pool = [" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate([0, 1, 12, 20, 24, 25, 26, 49, 50, 60, 168])]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {j}" for j in range(rng.randrange(1, 12))), "s", "en") for i in range(60)]
    rows += [(60, "first\n" + pool[-1], "s", "en"), (61, pool[-1] + "\nlast", "s", "en"), (62, pool[3], "s", "en"), (63, pool[3], "s", "en")]
    split = [(d, t.split("\n")) for d, t, *_ in rows]
    runs = lambda lines: ((i, n) for n in range(1, min_lines + 1) for i in range(len(lines) - n + 1))
    first = {}
    for d, lines in split:
        for i, n in runs(lines):
            first.setdefault(tuple(lines[i : i + n]), (d, i))
    want = []
    for d, lines in split:
        gone = set()
        for i, n in runs(lines):
            if first[tuple(lines[i : i + n])] != (d, i) and (n == min_lines or len(" ".join(lines[i : i + n]).split()) >= 50):
                gone |= set(range(i, i + n))
        want.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    got = remove_repeated_lines(spark.createDataFrame(rows, DOCS).repartition(3), min_lines=min_lines).select("doc_id", "text", "n_deleted").collect()
    assert sorted(map(tuple, got)) == want
    assert want[61] == (61, "last", 1) and want[63][2] == 0


def test_decontamination(spark, monkeypatch):
    rng = random.Random(5)
    item = [" ".join(f"b{rng.randrange(50)}" for _ in range(n)) for n in (14, 10, 3, 25)]
    bench = [(10, item[0]), (9, item[1]), (2, item[2]), (100, item[3]), (7, None), (8, "..."), (None, item[0])]
    texts = ["x " + item[0].upper() + " y", item[1] + "!" + item[2], "Ünï " + ", ".join(item[3].split()[3:20]), item[0][:20], None, "", "--", item[2].replace(" ", "\n") * 1]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(0, texts[0], None, None), (None, texts[1], None, None)]
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    want = []
    for d, t, *_ in rows:
        w, hit, ids = fold(t), set(), set()
        for i, b in bench:
            u = fold(b)
            for s in range(max(0, len(u) - 9)) if len(u) >= 10 else range(1 if u else 0):
                win = u[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids.add("null" if i is None else str(i))
        want.append((d, len(w), len(hit), sorted(ids)))
    b = spark.createDataFrame(bench, "item_id long, text string")
    docs = spark.createDataFrame(rows, DOCS).withColumns({"n_words": F.lit("clash"), "_text": F.lit(1)})
    for limit in (8 << 20, 60):  # one automaton, then several
        monkeypatch.setattr(decontaminate, "MAX_AUTOMATON_BYTES", limit)
        got = decontaminate.find_contamination(docs, b).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r for r in got}
    (a, e), = by[2]["spans"]
    assert fold(texts[2][a:e]) == item[3].split()[3:20]
    kept = decontaminate.find_contamination(docs, b, keep_columns=True)
    assert kept.columns == ["doc_id", "text", "source", "lang", "_text", "n_words", "n_hit", "items", "spans"]
    assert decontaminate.find_contamination(docs, b.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_contamination(docs.limit(0), b).count() == 0


def test_mixing(spark):
    rows = corpus(7)
    got = mix_sources(frame(spark, rows)).collect()
    again = mix_sources(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    by_id = defaultdict(list)
    for d, t, s, _ in rows:
        n = len(WORD.findall(t or ""))
        size[s] += n
        by_id[d].append((n, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    open_, goal, left = set(size), {}, sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            goal |= share
            break
        goal |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        open_ -= over
    sources = {v: k for k, v in size.items()}
    assert len(sources) == len(size)
    for r in got:
        s = sources[r["source_size"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"], s) in by_id[r["doc_id"]]
    for s in size:
        assert target[s] == pytest.approx(goal[s]) and taken[s] == int(goal[s] + 1e-6)
    assert mix_sources(frame(spark, [])).count() == 0
    assert mix_sources(frame(spark, [(1, None, "a", "x"), (2, "", None, "x")])).agg(F.sum("taken")).first()[0] == 0


def brute_near(rows, k, percent):
    fold = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sets = []
    for d, t, *_ in rows:
        w = fold(t)
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = sorted((find(a), find(b)))
                parent[s] = r
    return sorted(((d, len(x), None if d is None else find(d), d is None or find(d) == d) for d, x in sets), key=str)


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k, exact):
    rows = corpus(11)
    got = near_dedup.near_duplicates(frame(spark, rows), words=k, exact=exact)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str) == brute_near(rows, k, 80)


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_hashes_that_collide_by_construction(spark):
    """Texts whose polynomial hashes are equal: single words, and runs of two words."""
    rng = random.Random(9)
    common = words(49, rng)
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    rows = [(1, " ".join([*common, x]), "s", "en"), (2, " ".join([*common, y]), "s", "en"), (3, x, "s", "en"), (4, y, "s", "en")]
    p, q = (" ".join(thue_morse(2048, a, b)) for a, b in ("ab", "ba"))
    rows += [(5, p, "s", "en"), (6, q + " " + x, "s", "en")]
    docs = spark.createDataFrame(rows, DOCS)
    for operator in (remove_repeated_passages, remove_repeated_suffixes):
        got = operator(docs, length=50).select("doc_id", "n_words", "n_removed", "kept_text").collect()
        assert sorted(map(tuple, got), key=str) == removal(rows, 50)
        assert {r["doc_id"]: r["n_removed"] for r in got}[2] == 0
    got = near_dedup.near_duplicates(docs.where("doc_id in (3, 4)"), words=2)
    assert all(r["kept"] for r in got.collect())


def test_compaction_over_many_edges(spark):
    """Long shared passages, whole copies and passages that branch: the chains of edges take several rounds."""
    rng = random.Random(21)
    long_ = words(3000, rng, 10**6)
    rows = [(i, " ".join([*words(rng.randrange(0, 90), rng, 10**6), *long_[rng.randrange(0, 900) : rng.randrange(1200, 3000)], *words(rng.randrange(0, 90), rng, 10**6)]), "s", "en") for i in range(14)]
    rows += [(20, " ".join(long_), "s", "en"), (21, " ".join(long_), "s", "en"), (22, " ".join(long_[:70] * 9), "s", "en"), (23, " ".join(long_[:70] * 6), "s", "en")]
    for operator in (remove_repeated_passages, remove_repeated_suffixes):
        got = operator(spark.createDataFrame(rows, DOCS), length=50).select("doc_id", "n_words", "n_removed", "kept_text").collect()
        assert sorted(map(tuple, got), key=str) == removal(rows, 50)


def test_near_links_are_checked_by_words(monkeypatch):
    """Where two shingles share a hash the words decide."""
    import pyarrow as pa

    from quillon.llm import words as W

    block = lambda t: next(W.blocks(pa.array([t]), lower=True))
    text = " ".join(f"longer{i}word" for i in range(50))
    assert near_dedup._similar(block(text), block(text.upper()), 2, 80)
    assert not near_dedup._similar(block(text), block(" ".join(text.split()[25:])), 2, 80)
    monkeypatch.setattr(W, "xxh3_64_intdigest", lambda data: 7)
    assert not near_dedup._similar(block(text), block(text.replace("word", "wort")), 2, 80)
    assert near_dedup._similar(block(text), block(text), 2, 80)


def test_near_duplicates_families(spark, monkeypatch):
    """A chain of drifting copies: classes that only members of the same family can join, in several packs."""
    monkeypatch.setattr(near_dedup, "PACK", 8)
    rng = random.Random(2)
    base, rows = words(80, rng, 5000), []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(2, 12)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "s", "en"))
        if i % 9 == 8:
            base = w
    want = brute_near(rows, 2, 80)
    assert 1 < len({r[2] for r in want}) < 70
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), words=2)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_near_pairs_of_a_group_are_not_told(spark, monkeypatch):
    """A group below the limit, in which most pairs may link by estimate and few do: tasks tell edges that join, not pairs."""
    told, links = [], near_dedup._links
    monkeypatch.setattr(near_dedup, "_links", lambda pairs, *rest: told.append(pairs.count()) or links(pairs, *rest))
    rng = random.Random(5)
    base, rows = words(150, rng, 10**6), []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(150), rng.choice((4, 9, 11, 12, 13))):
            w[at] = f"z{i}x{at}"
        rows.append((i, " ".join(w), "s", "en"))
    want = brute_near(rows, 2, 80)
    assert 10 < len({r[2] for r in want}) < 110
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), words=2)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert told[-1] < 120


def test_near_links_by_hashes_that_words_refuse(spark, monkeypatch):
    """Where the links that were told fail by words, all others of the group are tried."""
    rng = random.Random(6)
    base, rows = words(100, rng, 10**6), []
    for i in range(12):
        w = list(base)
        w[rng.randrange(100)] = f"z{i}"
        rows.append((i, " ".join(w), "s", "en"))
    texts = spark.createDataFrame(rows, DOCS).selectExpr("doc_id as doc", "text")
    data = texts.mapInArrow(near_dedup._full_sets(2), "doc long, n long, data binary")
    members = texts.selectExpr("doc", "doc as comp", "0L as family")
    links, calls = near_dedup._links, []
    monkeypatch.setattr(near_dedup, "_links", lambda pairs, *rest: calls.append(1) or links(pairs, *rest).where("b - a > 1 and b <> 11" if len(calls) == 1 else "b - a > 1"))
    got = near_dedup._exact_links(members, "family", data, texts, 2, 80)
    assert len(calls) == 2
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in range(12) for b in range(a + 2, 12)}


def test_exact_links_need_no_bands(spark, monkeypatch):
    """Where no band meets, prefixes find every link: pairs at the limit, a family of near copies, texts of common words only."""
    monkeypatch.setattr(near_dedup, "_bands", lambda batches: (b.select([]) for b in ()))
    rng = random.Random(31)
    rows = []
    for i in range(40):
        w = words(rng.randrange(30, 120), rng, 10**6)
        rows.append((2 * i, " ".join(w), "s", "en"))
        rows.append((2 * i + 1, " ".join(w[: rng.randrange(round(0.76 * len(w)), round(0.86 * len(w)))]), "s", "en"))
    base = words(60, rng, 10**6)
    for i in range(100, 160):
        w = list(base)
        w[rng.randrange(60)] = f"z{i}"
        rows.append((i, " ".join(w), "s", "en"))
    rows += [(i, " ".join(words(rng.randrange(1, 9), rng, 4)), "s", "en") for i in range(200, 260)]
    docs = spark.createDataFrame(rows, DOCS)
    want = brute_near(rows, 2, 80)
    got = near_dedup.near_duplicates(docs, words=2, exact=True)
    assert sorted(map(tuple, got.collect()), key=str) == want
    without = near_dedup.near_duplicates(docs, words=2)
    assert without.where("kept").count() > got.where("kept").count()


def test_estimates_are_corrected():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(30):
        both, a, b = (rng.integers(1, 1 << 63, n).astype(np.uint64) * np.uint64(2) for n in (800, 100, 100))
        x, y = np.sort(np.r_[both, a]), np.sort(np.r_[both, b])
        r = near_dedup.registers(np.r_[x, y], np.array([0, 900, 1800]))
        errors.append(float(near_dedup.estimate(r[0], r[1], np.array(900), np.array(900))) - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 8), (9, 8), *[(100, i) for i in range(101, 140)], (139, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 6)}, 8: 8, 9: 8, 50: 50, **{i: 50 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_global_rank(spark):
    got = global_rank(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")), ["x"]).collect()
    assert all(r["x"] == r["rank"] for r in got) and len(got) == 1000


def test_topk(spark):
    rng = np.random.default_rng(1)
    vec = [(i, rng.normal(size=6).round(1).tolist()) for i in range(120)]
    for i in (7, 30, 31, 77):
        vec[i] = (i, vec[3][1])
    vec[10], vec[11], vec[50], vec[51] = (10, None), (11, [1.0] * 5 + [None]), (50, [float("nan")] + [1.0] * 5), (51, [1.0, 2.0])
    vec += [vec[3], (None, vec[3][1]), (100, vec[100][1])]
    for big in (1.0, 3e12):
        rows = [(i, None if v is None else [None if x is None else x * big for x in v]) for i, v in vec]
        whole = {}
        for i, v in rows:
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
                whole[i] = [int(np.floor(256 * x)) for x in v]
        want = []
        for q in sorted(whole):
            if q % 10 == 0:
                clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
                found = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
                want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "rank": F.lit(0)})
        got = topk.top_k(df, k=5, every=10)
        assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(df.where("vec_id % 10 <> 0"), every=10).count() == 0
    assert topk.top_k(df.where("vec_id in (20, 21)"), k=5, every=10).count() == 1


def test_warc(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "CHUNK", 64)
    rng = random.Random(4)
    body = ["<p>hé</p>", None, "", "x" * 63, "y" * 64, "WARC/1.1\r\n\r\n" * 40, "<p>hé</p>", "z" * 1000, "x" * 63, ""]
    pages = [(i, f"http://h/{i}\r\n", b) for i, b in enumerate(body)] + [(None, None, "<p>hé</p>"), (6, "u", "<p>hé</p>")]
    rng.shuffle(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"id": F.lit(1), "digest": F.lit("x"), "size": F.lit(0)}).repartition(3)
    got = warc.round_trip(df)
    last = {}
    for i, _, b in pages:
        if i is not None:
            last[b or ""] = max(i, last.get(b or "", -1))
    want = []
    for i, _, b in pages:
        raw = (b or "").encode()
        revisit = i is not None and i < last[b or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", last[b or ""] if revisit else None))
    assert sorted(map(tuple, got.drop("url").collect()), key=str) == sorted(want, key=str)
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(df, folder)
    chunks = warc.read_chunks(files, folder, with_data=True).collect()
    assert max(r["bytes"] for r in chunks) <= 64 and max(r["chunk"] for r in chunks) >= 15
    whole = defaultdict(bytes)
    for r in sorted(chunks, key=lambda r: (r["file"], r["record"], r["chunk"])):
        whole[r["file"], r["record"]] += bytes(r["data"])
        assert base64.b32encode(hashlib.sha1(whole[r["file"], r["record"]]).digest()).decode() == r["digest"]
    assert sorted(whole.values()) == sorted(b"" if w[3] == "revisit" else (b or "").encode() for (i, _, b), w in zip(pages, want, strict=True))
    raw = gzip.decompress(next((tmp_path / "w").glob("*.warc.gz")).read_bytes())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
    small = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, min_bytes=64).collect()}
    assert set(small.values()) == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_html():
    page = lambda s: html_main.Page(s).main_text()
    assert page(None) == "" and page("") == "" and page("plain &lt;text&gt;") == "plain <text>"
    assert page("<body><nav>menu</nav><div class='cookie-notice'>c</div><p>a&nbsp; b<br>c<p><b>d</b>e<ul><li>x<li>y</ul><div id=comments><p>no</div><aside>s</aside><form>f</form><footer>f") == "a b c de x y"
    assert page("<body><p>out</p><article><header>h</header><h1>T</h1><p>in <a href='a>b'>link</a></p><div class='ad-slot'>ad</div><script>var t='</p>';</script><section class=\"share\">s</section></article><p>out") == "T in link"
    assert page("<main><p>" + "x " * 50000 + "</p></main>").count("x") == 50000
    assert page("<div>" * 3000 + "deep") == "deep"
    assert page("<div class='has-sidebar content'><p>a</p><div class='widget siteSidebar'>b</div></div>") == "a"
    assert page("<p>a<!-- <p>b</p> -->c</p><style>p{}</style><![CDATA[z]]><title>t</title>") == "ac"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content-with-sidebar"><article><p>real text here</article></div>',
        '<div id="layout-sidebar-right"><main><p>real text here</main></div>',
        '<article><div class="entry-content social-share-enabled"><p>real text here</div></article>',
        '<form id="aspnetForm"><article><p>real text here</article></form>',
        '<div class="page footer-fixed"><p>real text here</p></div>',
        '<div class="wrap-nav-open"><nav>home about</nav><article><h1>real</h1><p>text here<aside>buy</aside></article><div class="comments"><article>me too</article></div></div>',
    ],
)
def test_articles_under_compound_names(page):
    assert html_main.Page(page).main_text() == "real text here"
    body = "a long body " * 9
    assert html_main.Page(f'<article><h1>title</h1><div class="post share-bar-left">{body}</div></article>').main_text() == f"title {body}".strip()


def test_what_readers_say_is_no_article():
    assert html_main.Page('<div class="comments"><article>long long long words of a reader</article></div><p>hm</p>').main_text() == "hm"
    assert html_main.Page('<aside><article>teaser teaser teaser</article></aside>').main_text() == ""


def test_pages_cut_anywhere_and_broken_tags_end():
    import time

    page = '<html><body class="a"><article id=\'x\'><p title="a b">real &amp; text</p><img ' + " ".join(f'a{i}="v{i}"' for i in range(30)) + "></article><!-- c --></body></html>"
    began = time.time()
    for end in range(len(page) + 1):
        text = html_main.Page(page[:end]).main_text().rstrip("<")  # a last "<" may be text
        assert "real & text".startswith(text.rstrip("&amp;")) or text.startswith("real")
        assert "v1" not in text and "a1" not in text
    assert html_main.Page('<p title="a > b">real</p>').main_text() == "real"
    for part in ("<a", '<a "', "<a '", '<img a="b" ', "<!", "<!-", "</", "<div><", '"', "<div>x", '<b "x>'):
        html_main.Page(part * 20000)
        html_main.Page("<article>ok</article>" + part * 20000)
    assert time.time() - began < 30


def test_site_templates(spark):
    rows = [(i, "http://a.org/x" if i < 8 else f"http://b.org/{i}", f"<body><div><p>Subscribe to our letter</p></div><p>text {i}</p><p>{'quoted' if i % 2 else i}</p></body>") for i in range(10)]
    rows += [(20 + i, "http://copy.org/", "<body><p>one page</p></body>") for i in range(9)] + [(40, None, "<p>x</p>"), (41, "http://a.org", None), (42, "http://a.org", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "templates": F.lit("x"), "text": F.lit("y")}).repartition(3)
    got = {r["page_id"]: r["text"] for r in html_main.extract_main_text(df).collect()}
    assert len(got) == len(rows)
    assert got[0] == "text 0 0" and got[1] == "text 1 quoted" and got[42] == "text 0 0"  # quoted on half of seven pages at most
    assert got[9] == "Subscribe to our letter text 9 quoted"  # a host of few pages has no templates
    assert got[20] == "one page" and got[40] == "x" and got[41] == ""
    assert html_main.extract_main_text(df.limit(0)).count() == 0


def test_templates_alone_remove_furniture(spark):
    """No marked article, no telling names, no tags of furniture: counts by host must do, as plain Python counts say."""
    rng = random.Random(8)
    rows, body = [], {}
    for site in range(3):
        menu = "".join(f"<li>{w}</li>" for w in words(6, rng))
        foot, side = " ".join(words(12, rng)), " ".join(words(9, rng))
        for i in range(8):
            text = [" ".join(words(20, rng, 10**6)) for _ in range(3)]
            ad = f"<div>{' '.join(words(4, rng, 10**6))}</div>" if i % 2 else ""
            body[len(rows)] = " ".join([*([re.sub("<[^>]*>", "", ad)] if ad else []), *text])
            tag = ("nav", "div", "table")[site]
            rows.append((len(rows), f"https://s{site}.example/p{i}", f"<html><body><{tag}><ul>{menu}</ul></{tag}>{ad}<div><p>{'</p><p>'.join(text)}</p><div>{side}</div></div><footer>{foot}</footer></body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_main.extract_main_text(df, by_names=False).collect()}
    assert got == body
    counts, sizes = defaultdict(Counter), defaultdict(set)
    for _, url, source in rows:
        page = html_main.Page(source)
        counts[url.split("/")[2]].update({h for _, _, h, _ in page.subtrees})
        sizes[url.split("/")[2]].add(source)
    found = {r["host"]: set(r["templates"]) for r in html_main.site_templates(df.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))).collect()}
    assert found == {h: {s for s, n in c.items() if n >= 5 and n >= len(sizes[h]) / 2} for h, c in counts.items()}


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        w = words(80, rng)
        rows.append((i, " ".join(w) if good else " ".join(x + "!!" for x in w).upper() if i % 2 else " ".join([w[0]] * 60), "s", "en"))
        labels.append((i, int(good)))
    rows += [(None, "x", "s", "en"), (1000, None, "s", "en"), (1001, "", "s", "en"), rows[0]]
    docs = frame(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 1), (1, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    model = quality.train(docs, marks)
    got = quality.score_quality(docs, model).select("doc_id", "score", quality.held_out("doc_id").alias("held")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got if r["held"] and r["doc_id"] in truth]
    assert len(held) > 50 and np.mean(held) > 0.95
    bounded = quality.train(docs, marks, max_rows=100)
    assert len(bounded.root) > 0
    none = quality.train(docs, marks.limit(0))
    assert quality.score_quality(docs.limit(5), none).select("score").distinct().count() == 1
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_trees_walk_like_their_fit():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97

    def walk(row):
        total = model.base
        for node in model.root:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert [walk(r) for r in x[:50]] == pytest.approx(model.score(x[:50]).tolist())


def slow_fit(x, y, trees, depth, rate=0.15, bins=64, least=5, l2=1.0):
    """Boosting by plain loops: score function of the same trees."""
    base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    edges = [sorted(set(np.quantile(x[:, f], [i / bins for i in range(1, bins)]).tolist())) for f in range(x.shape[1])]
    margin, forest = [base] * len(y), []

    def grow(rows, level, g, h):
        total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best, split = 1e-6, None
        for f in range(x.shape[1]) if level < depth else ():
            for e in edges[f]:
                left = [i for i in rows if x[i, f] <= e]
                if least <= len(left) <= len(rows) - least:
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
                    if gain > best + 1e-9:
                        best, split = gain, (f, e)
        if split is None:
            return -rate * total_g / (total_h + l2)
        f, e = split
        return f, e, grow([i for i in rows if x[i, f] <= e], level + 1, g, h), grow([i for i in rows if x[i, f] > e], level + 1, g, h)

    def walk(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for _ in range(trees):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        tree = grow(list(range(len(y))), 0, [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p])
        forest.append(tree)
        margin = [m + walk(tree, row) for m, row in zip(margin, x, strict=True)]
    return lambda row: 1 / (1 + np.exp(-(base + sum(walk(t, row) for t in forest))))


def test_boosting_against_plain_loops():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = ((x[:, 0] + 0.3 * x[:, 2] > 0) ^ (rng.random(120) < 0.1)).astype(float)
    fast, slow = quality.fit(x, y, trees=4, depth=2), slow_fit(x, y, 4, 2)
    assert fast.score(x) == pytest.approx([slow(r) for r in x], abs=1e-9)


def test_quality_on_held_out_documents(spark):
    """The registered query ranks and decides the labelled documents it has not learnt from."""
    from quillon.llm.queries import op5_quality_classifier

    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in op5_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    good, bad = ([s for s, _, y in held if y == k] for k in (1, 0))
    pairs = [(a > b) + (a == b) / 2 for a in good for b in bad]
    assert len(held) > 50 and np.mean(pairs) > 0.97
    assert np.mean([p == y for _, p, y in held]) > 0.95
