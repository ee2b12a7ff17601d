"""Near-duplicate classes by HyperMinHash.

A document's shingle hashes fall into buckets; a bucket keeps the smallest
value, compressed to its leading-zero count and the mantissa bits after it.
Empty buckets borrow from others in a fixed random order. Bands of registers
give candidates, collision-corrected estimates discard most false ones, and
what is left is verified on full shingle sets and their words. Equal sets are one node. First
each document is compared with one candidate, the leader it meets in most of
its buckets. What is in different classes then and shares a bucket is compared
in packs of bounded size inside the tasks, first by estimate, which puts
documents that may link into one family, then families on their full sets. A
task tells no pairs, only edges that join what its pairs join: fewer than it has
documents. So neither buckets nor families are expanded into their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import drop_materialized, materialize
from .words import Block, blocks, mix

BITS, MANTISSA, BAND = 8, 10, 6
BUCKETS = 1 << BITS
BANDS = BUCKETS // BAND
PACK, PACK_BYTES = 256, 4 << 20
DENSE = 3  # buckets in which two documents of a family meet: at a similarity of 0.65 that is the mean
_U = np.uint64
_PROBES = np.argsort(mix(np.arange(1, BUCKETS * BUCKETS + 1, dtype=_U)).reshape(BUCKETS, BUCKETS), axis=1)


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, words) of each k-word shingle and where each text's begin; fewer words are one shingle, none are none."""
    sizes = np.diff(block.first)
    count = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    at = np.r_[0, np.cumsum(count)]
    lo = np.arange(at[-1]) - np.repeat(at[:-1] - block.first[:-1], count)
    width = np.repeat(np.minimum(sizes, k), count)
    hashes = mix(block.hash[lo] + width.astype(_U))
    for i in range(1, k):
        some = np.flatnonzero(width > i)
        hashes[some] = mix(hashes[some] * _U(0xD1342543DE82EF95) + block.hash[lo[some] + i])
    return hashes, lo, width, at


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of k-word shingles and where each text's begin."""
    hashes, _, _, at = shingles(block, k)
    for i, j in zip(at[:-1], at[1:], strict=True):
        hashes[i:j].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    return hashes[new], np.r_[0, np.cumsum(new)][at]


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16: leading zeros, then mantissa) of sorted sets; rows of empty sets are 0."""
    n, sizes = len(at) - 1, np.diff(at)
    owner = np.repeat(np.arange(n), sizes)
    bucket = (hashes >> _U(64 - BITS)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.zeros(0, np.int64)
    value = hashes[head] << _U(BITS) | _U((1 << BITS) - 1)  # the bits after the bucket's
    high = (value >> _U(11)).astype(np.float64)
    zeros = np.maximum(0, 53 - np.frexp(high)[1]).astype(np.int64)
    mantissa = (value << (zeros + 1).astype(_U)) >> _U(64 - MANTISSA)
    out = np.full((n, BUCKETS), -1, np.int32)
    out[owner[head], bucket[head]] = zeros << MANTISSA | mantissa.astype(np.int64)
    some = np.flatnonzero((sizes > 0) & (out < 0).any(axis=1))
    source = out[some]
    filled, left = source.copy(), np.arange(len(some))
    for t in range(BUCKETS):
        if not len(left):
            break
        part, borrowed = filled[left], source[left][:, _PROBES[:, t]]
        part = np.where(part < 0, borrowed, part)
        filled[left] = part
        left = left[(part < 0).any(axis=1)]
    out[some] = filled
    return np.maximum(out, 0).astype(np.uint16)


def collision_rate(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that the registers of two unrelated sets agree: over the cells a register can name, both minima fall in one."""
    a, b = (np.maximum(np.asarray(n, float) / BUCKETS, 1.0) for n in (n_a, n_b))
    total = np.zeros(np.broadcast(a, b).shape)
    for zeros in range(40):
        low, high = 2.0 ** -(zeros + 1), 2.0**-zeros
        mass = a * b / (a + b) * (np.exp(-(a + b) * low) - np.exp(-(a + b) * high))
        total += mass * (high - low) / (1 << MANTISSA)
    return total


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from agreeing registers, less the agreement by chance."""
    agree, chance = (regs_a == regs_b).mean(axis=-1), collision_rate(n_a, n_b)
    return (agree - chance) / (1 - chance)


def may_link(est: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """False only where the estimate is 6 standard errors too low (about 1e-8 at the very limit) or the sizes rule the similarity out."""
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    s = percent / 100
    return (est >= s - 6 * np.sqrt(s * (1 - s) / np.minimum(np.maximum(low, 1), BUCKETS))) & (100 * low >= percent * high)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                hashes, at = shingle_sets(block, k)
                regs = registers(hashes, at)
                named = b"".join(blake2b(hashes[i:j].tobytes(), digest_size=16).digest() for i, j in zip(at[:-1], at[1:], strict=True))
                name = np.frombuffer(named, np.int64).reshape(-1, 2)
                cols = [
                    batch.column("doc").slice(block.row, block.n_texts),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array(name[:, 0]),
                    pa.array(name[:, 1]),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "n", "f1", "f2", "regs"])

    return run


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=_U))
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = _regs(batch.column("regs"))[:, : BANDS * BAND].reshape(-1, BANDS, BAND).astype(_U)
        key = np.broadcast_to(salt, regs.shape[:2]).copy()
        for i in range(BAND):
            key = mix(key ^ regs[:, :, i])
        doc = np.repeat(batch.column("doc").to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(doc)], names=["key", "doc"])


def _estimated(percent: int):
    """The pairs whose registers say that they may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
                est = estimate(_regs(batch.column("regs_a")), _regs(batch.column("regs_b")), n_a, n_b)
                yield batch.select(["a", "b"]).filter(pa.array(may_link(est, n_a, n_b, percent)))

    return run


def _same_words(x: Block, i: np.ndarray, y: Block, j: np.ndarray) -> np.ndarray:
    """Whether words i of one block are words j of the other; short words by their hash, which tells them apart, long ones by their bytes."""
    size = x.end[i] - x.start[i]
    same = (size == y.end[j] - y.start[j]) & (x.hash[i] == y.hash[j])
    long_ = np.flatnonzero(same & (size > 8))
    if len(long_):
        n = size[long_]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = x.raw[np.repeat(x.start[i[long_]], n) + step] != y.raw[np.repeat(y.start[j[long_]], n) + step]
        same[long_] = np.bincount(np.repeat(np.arange(len(n)), n), differ, minlength=len(n)) == 0
    return same


def _similar(x: Block, y: Block, k: int, percent: int) -> bool:
    """Whether the texts of two blocks of one text link: by hashes, which are then checked against the words."""

    def distinct(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        hashes, lo, width, _ = shingles(block, k)
        order = np.argsort(hashes, kind="stable")
        hashes, lo, width = hashes[order], lo[order], width[order]
        again = np.flatnonzero(hashes[1:] == hashes[:-1])
        new = np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]
        return hashes[new], lo[new], width[new], same(block, lo[again], block, lo[again + 1], width[again])

    def same(p: Block, i: np.ndarray, q: Block, j: np.ndarray, width: np.ndarray) -> bool:
        return all(_same_words(p, i[width > w] + w, q, j[width > w] + w).all() for w in range(k))

    h_x, lo_x, width_x, sound_x = distinct(x)
    h_y, lo_y, width_y, sound_y = distinct(y)
    common, i, j = np.intersect1d(h_x, h_y, assume_unique=True, return_indices=True)
    both, either = len(common), len(h_x) + len(h_y) - len(common)
    if not (sound_x and sound_y and (width_x[i] == width_y[j]).all() and same(x, lo_x[i], y, lo_y[j], width_x[i])):  # two shingles share a hash
        sets = []
        for block in (x, y):
            words = [bytes(block.raw[a:b]) for a, b in zip(block.start, block.end, strict=True)]
            sets.append({tuple(words[a : a + k]) for a in range(max(1, len(words) - k + 1))} if words else set())
        both, either = len(sets[0] & sets[1]), len(sets[0] | sets[1])
    return both > 0 and 100 * both >= percent * either


def _verified(k: int, percent: int):
    """The pairs that link on their full texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [
                _similar(next(blocks(batch.column("text_a").slice(i, 1), lower=True)), next(blocks(batch.column("text_b").slice(i, 1), lower=True)), k, percent)
                for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _members(row: list[dict], *names: str) -> list[np.ndarray]:
    return [np.array([m[c] for m in row], np.int64) for c in names]


def _spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The places of edges (a, b) that join, without a circle, all that the edges join."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    at = np.unique(np.stack([a, b]), axis=1, return_index=True)[1] if len(a) else []
    for i in at:
        x, y = find(int(a[i])), find(int(b[i]))
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(int(i))
    return kept


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _cross(percent: int):
    """Edges between families: they join those of which two packs of a bucket hold documents of different classes whose registers say they may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for row in batch.to_pylist():
                (da, ca, fa, na), (db, cb, fb, nb) = (_members(row[p], "doc", "comp", "family", "n") for p in "xy")
                regs = [np.frombuffer(b"".join(m["data"] for m in row[p]), np.uint16).reshape(-1, BUCKETS) for p in "xy"]
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for at in range(0, len(da), 32):
                    x = slice(at, at + 32)
                    agree = (regs[0][x, None, :] == regs[1][None, :, :]).mean(axis=2)
                    # an estimate is never above the share of agreeing registers, so most pairs need none
                    ok = (ca[x, None] != cb) & (fa[x, None] != fb) & may_link(agree, na[x, None], nb[None, :], percent)
                    if row["same"]:
                        ok &= da[x, None] < db
                    i, k = np.nonzero(ok)
                    chance = collision_rate(na[x][i], nb[k])
                    good = may_link((agree[i, k] - chance) / (1 - chance), na[x][i], nb[k], percent)
                    found.append((fa[x][i[good]], fb[k[good]]))
                a, b = (np.concatenate([f[side] for f in found]) for side in (0, 1))
                kept = _spanning(a, b)
                out_a += a[kept].tolist()
                out_b += b[kept].tolist()
            yield _edges(out_a, out_b)

    return run


def _incidence(sets: list[np.ndarray], common: np.ndarray) -> np.ndarray:
    """Which of some common hashes each set holds."""
    out = np.zeros((len(sets), len(common)), np.float32)
    for i, x in enumerate(sets):
        at = np.searchsorted(common, x)
        at[at == len(common)] = 0
        out[i, at[common[at] == x]] = 1
    return out


def _dense(percent: int, every: bool = False):
    """Links of two packs of a family, exact on full sets: as many as join the classes that links join, or ``every`` one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for row in batch.to_pylist():
                (da, ca, na), (db, cb, nb) = (_members(row[p], "doc", "comp", "n") for p in "xy")
                x, y = ([np.frombuffer(m["data"], _U) for m in row[p]] for p in "xy")
                common = np.intersect1d(np.concatenate(x), np.concatenate(y))
                both = np.zeros((len(x), len(y)), np.float32)
                for at in range(0, len(common), 1 << 14):
                    part = common[at : at + (1 << 14)]
                    both += _incidence(x, part) @ _incidence(y, part).T
                both = both.astype(np.int64)
                linked = (100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (ca[:, None] != cb[None, :])
                i, j = np.nonzero(linked)
                kept = np.arange(len(i)) if every else _spanning(ca[i], cb[j])
                out_a += da[i[kept]].tolist()
                out_b += db[j[kept]].tolist()
            yield _edges(out_a, out_b)

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data: list[bytes] = []
            for block in blocks(batch.column("text"), lower=True):
                hashes, at = shingle_sets(block, k)
                data += [hashes[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([len(d) // 8 for d in data], pa.int64()), pa.array(data, pa.binary())], names=["doc", "n", "data"])

    return run


def _both_sides(pairs: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    """The pairs (a, b) with what is known of both documents."""
    left, right = (docs.select(F.col("doc").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in names]) for c in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b")


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link; texts are joined to what the registers let through only."""
    return _both_sides(pairs, texts, "text").mapInArrow(_verified(k, percent), "a long, b long").distinct()


def _proposals(buckets: DataFrame) -> DataFrame:
    """One candidate per document: of the smallest documents of its buckets, the one it meets in most of them."""
    leads = buckets.groupBy("key").agg(F.min("doc").alias("lead"))
    votes = buckets.join(leads, "key").where("lead < doc").groupBy("doc", "lead").agg(F.count(F.lit(1)).alias("v"))
    return votes.groupBy("doc").agg(F.max(F.struct("v", -F.col("lead"))).alias("best")).select(F.col("doc").alias("b"), (-F.col("best.col2")).alias("a"), F.col("best.v").alias("v"))


def _open_buckets(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, doc, comp) of the buckets in which several classes meet."""
    known = shared.join(comps, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("comp"))
    open_ = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return known.join(open_, "key")


def _pack_pairs(members: DataFrame, group: str, data: DataFrame) -> DataFrame:
    """Pairs of packs (x, y, same) of each group; a pack has about PACK rows or PACK_BYTES bytes of data, large classes are apart from the rest."""
    full = members.join(data.select("doc", "n", F.octet_length("data").cast("long").alias("bytes")), "doc")
    share = full.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"))
    alone = share.select(group, "comp", F.greatest(F.col("size") / PACK, F.col("bytes") / PACK_BYTES).alias("fill")).withColumn("alone", F.col("fill") >= 1)
    rest = alone.groupBy(group).agg(F.sum(F.when(~F.col("alone"), F.col("fill")).otherwise(0.0)).alias("rest"))
    sized = members.join(alone, [group, "comp"]).join(rest, group)
    slot = lambda fill: F.pmod(F.xxhash64("doc"), F.ceil(F.greatest(fill, F.lit(1.0))))
    pack = F.when(F.col("alone"), F.xxhash64("comp", slot(F.col("fill")))).otherwise(slot(F.col("rest")))
    packs = (
        sized.join(data, "doc")
        .groupBy(F.col(group).alias("group"), pack.alias("pack"), F.when(F.col("alone"), F.col("comp")).alias("only"))
        .agg(F.collect_list(F.struct("doc", "comp", "family", "n", "data")).alias("rows"))
    )
    packs = materialize(packs.withColumn("id", F.monotonically_increasing_id()), "packs")
    # which packs meet is settled without their rows, so that a group of many packs is spread over tasks by pack
    x = packs.select("group", F.col("id").alias("id_x"), F.col("pack").alias("px"), F.col("only").alias("ox"))
    y = packs.select("group", F.col("id").alias("id_y"), F.col("pack").alias("py"), F.col("only").alias("oy"))
    within = F.col("id_x") == F.col("id_y")
    apart = (F.struct("px", "ox") < F.struct("py", "oy")) & ~F.coalesce(F.col("ox") == F.col("oy"), F.lit(False))
    pairs = x.join(y, "group").where((within & F.col("ox").isNull()) | apart).select("id_x", "id_y", within.alias("same"))
    return pairs.join(packs.select(F.col("id").alias("id_x"), F.col("rows").alias("x")), "id_x").join(packs.select(F.col("id").alias("id_y"), F.col("rows").alias("y")), "id_y").select("x", "y", "same")


def _exact_links(members: DataFrame, group: str, data: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that join the classes which meet in a group and link, found on full sets and confirmed by words."""
    packed = _pack_pairs(members, group, data)
    pairs = materialize(packed.mapInArrow(_dense(percent), "a long, b long").distinct(), "rest-pairs")
    links = materialize(_links(pairs, texts, k, percent), "links")
    if not pairs.join(links, ["a", "b"], "left_anti").isEmpty():  # shingles that share a hash: other links may join what these do not
        again = materialize(packed.mapInArrow(_dense(percent, every=True), "a long, b long").distinct(), "rest-pairs")
        links = materialize(_links(again, texts, k, percent), "links")
        drop_materialized(again)
    drop_materialized(pairs)
    return links


def _rest_links(open_: DataFrame, families: DataFrame, signed: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of classes that are still apart; families that estimates join are one family, and are compared on full sets."""
    placed = materialize(open_.join(families, "doc", "left").withColumn("family", F.coalesce("family", "doc")), "placed")
    several = placed.groupBy("key").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo < hi").select("key")
    regs = signed.select("doc", "n", F.col("regs").alias("data"))
    joined = materialize(_pack_pairs(placed.join(several, "key"), "key", regs).mapInArrow(_cross(percent), "a long, b long").distinct(), "family-edges")
    wide = materialize(components(joined), "wide-families")
    alike = placed.select("doc", "comp", "family").distinct().join(wide, F.col("family") == F.col("node"), "left").select("doc", "comp", F.coalesce("component", "family").alias("family"))
    apart = alike.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("family")
    alike = materialize(alike.join(apart, "family"), "alike")
    data = materialize(texts.join(alike.select("doc"), "doc", "left_semi").select("doc", "text").mapInArrow(_full_sets(k), "doc long, n long, data binary"), "full-sets")
    links = _exact_links(alike, "family", data, texts, k, percent)
    for table in (placed, joined, wide, alike, data):
        drop_materialized(table)
    return links


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each hash of a set, in batches of bounded size."""
    for batch in batches:
        sizes = batch.column("n").to_numpy()
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), 1 << 18, "right")) + start)
            part = batch.slice(start, stop - start)
            hashes = np.frombuffer(b"".join(part.column("data").to_pylist()), np.int64)
            doc, n = (np.repeat(part.column(c).to_numpy(), sizes[start:stop]) for c in ("doc", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(n), pa.array(hashes)], names=["doc", "n", "key"])
            start = stop


def _prefix_buckets(data: DataFrame, percent: int) -> DataFrame:
    """(key, doc): the rarest shingles of each set, as many as two sets that link cannot both do without.

    Of a set of n shingles these are the first n - ceil(percent * n / 100) + 1 by
    (documents, hash). Shingles of one document come first and meet nothing, so
    only the others are ranked.
    """
    every = data.mapInArrow(_hash_rows, "doc long, n long, key long")
    common = every.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    of_doc = Window.partitionBy("doc", "n")  # no more rows than the document has words
    ranked = every.join(common, "key").withColumns({"at": F.row_number().over(of_doc.orderBy("df", "key")), "c": F.count(F.lit(1)).over(of_doc)})
    return ranked.where(f"at <= n - ({percent} * n + 99) div 100 + 1 - (n - c)").select("key", "doc").distinct()


def _missed_links(rows: DataFrame, once: DataFrame, comps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between classes that no band has shown, found by exact prefixes; buckets of the same members count once."""
    texts = materialize(rows.join(once.select("doc").distinct(), "doc").select("doc", "text"), "texts")
    data = materialize(texts.mapInArrow(_full_sets(k), "doc long, n long, data binary").where("n > 0"), "full-sets")
    buckets = materialize(_prefix_buckets(data, percent), "prefixes")
    open_ = materialize(_open_buckets(buckets, comps), "open-buckets")
    drop_materialized(buckets)
    # two seeds over all members name a bucket's content
    named = open_.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *[F.sum(F.xxhash64("doc", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)])
    chosen = named.groupBy("size", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    members = open_.join(chosen, "key").withColumn("family", F.col("doc"))
    links = _exact_links(members, "key", data, texts, k, percent)
    for table in (texts, data, open_):
        drop_materialized(table)
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable by links), kept.

    Documents link where 100 * intersection >= ``percent`` * union of their
    sets of ``words``-word shingles (lower-cased A-Z, split at ASCII white
    space); a shorter text is one shingle, a null or empty one has none and
    links with nothing. Rows under one id are one document. A row with a null
    id links with nothing, has a null component and is kept. An empty table
    gives an empty result; other columns are ignored.

    Bands lose a pair at the very limit with a probability of some 3e-6. With
    ``exact`` they lose none: what is still in different classes is then
    compared wherever two documents share one of their rarest shingles, which
    costs a shuffle of all shingles.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(rows.mapInArrow(_sign(words), "doc long, n long, f1 long, f2 long, regs binary"), "sets")
    key = ["n", "f1", "f2"]
    # one row for each different set: the smallest document that has it
    once = sets.where("n > 0 and doc is not null").groupBy(*key).agg(F.min(F.struct("doc", "regs")).alias("rep"))
    once = materialize(once.select(*key, "rep.doc", "rep.regs"), "once")
    ids = materialize(sets.drop("regs"), "ids")
    drop_materialized(sets)
    nodes = once.select(*key, F.col("doc").alias("rep"))
    bands = materialize(once.select("doc", "regs").mapInArrow(_bands, "key long, doc long"), "bands")
    buckets = bands.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key")
    shared = materialize(bands.join(buckets, "key"), "shared")
    drop_materialized(bands)
    met = materialize(shared.select("doc").distinct(), "met")
    signed = materialize(once.select("doc", "n", "regs").join(met, "doc", "left_semi"), "signed")

    # first one candidate per document, then whatever is still apart and shares a bucket
    best = materialize(_proposals(shared), "proposals")
    likely = materialize(_both_sides(best, signed, "n", "regs").mapInArrow(_estimated(percent), "a long, b long"), "likely")
    texts = materialize(rows.join(once.select("doc", *key).join(met, "doc", "left_semi"), "doc").select("doc", "text"), "texts")
    links = materialize(_links(likely, texts, words, percent), "links")
    comps = materialize(components(links), "classes")
    drop_materialized(links)
    drop_materialized(likely)
    open_ = materialize(_open_buckets(shared, comps), "open-buckets")
    drop_materialized(shared)
    near = best.where(F.col("v") >= DENSE).join(open_.select(F.col("doc").alias("b")).distinct(), "b", "left_semi")
    families = materialize(components(near).select(F.col("node").alias("doc"), F.col("component").alias("family")), "families")
    more = _rest_links(open_, families, signed, texts, words, percent)
    for table in (best, open_, families, signed, met, texts):
        drop_materialized(table)
    links = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    if exact:
        links = materialize(links, "links")
        links = links.unionByName(_missed_links(rows.where("doc is not null"), once, materialize(components(links), "classes"), words, percent))
    # rows of one id that differ in text are one node through the id they share
    named = ids.where("n > 0 and doc is not null")
    several = named.groupBy("doc").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).where("lo < hi").select("doc")
    ties = named.join(several, "doc").join(nodes, key).where("rep < doc").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    comps = materialize(components(links.unionByName(ties)), "classes")
    placed = (
        ids.join(nodes, key, "left")
        .join(comps, F.col("rep") == F.col("node"), "left")
        .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc")).alias("component_id"))
    )
    return placed.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
