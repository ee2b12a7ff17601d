"""Substring dedup by de Bruijn compaction.

The graph is built on selected token k-mers. An edge is a selected k-mer with the
words around it that its windows cover; two edges meet in the node of the
``length - 1`` words that the last window of the one shares with the first window
of the other. Nodes whose edges in and out are one each do not branch: the
edges on both sides always follow each other, and such chains are compacted by
joins that double the pointer to the chain's head. A compacted path comes back
with the coordinates of its source, the first place of its smallest document; an
occurrence further on is a copy if it runs through the path from end to end.
Where a k-mer has several edges, single windows of them are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .passages import keyed, path_scan, resolve_windows, strip_passages
from .shared import drop_materialized, materialize

_EDGE = ["p1", "p2"]


def _chain_heads(placed: DataFrame) -> DataFrame:
    """(p1, p2, h1, h2, away): the head of each edge's nonbranching path and how many windows it lies before the edge; heads are left out.

    ``placed`` has the repeated edges in place (doc, row, p1, p2, lo, hi), each
    place once.
    """
    edge, text = F.struct(*_EDGE), Window.partitionBy("doc", "row").orderBy("lo")
    before, after = F.lag(F.struct("hi", *_EDGE)).over(text), F.lead(F.struct("lo", *_EDGE)).over(text)
    met = placed.withColumns({"before": before, "after": after}).select(
        *_EDGE,
        F.when(F.col("before.hi") + 1 == F.col("lo"), F.struct("before.p1", "before.p2")).alias("before"),
        F.when(F.col("after.lo") == F.col("hi") + 1, F.struct("after.p1", "after.p2")).alias("after"),
        (F.col("hi") - F.col("lo") + 1).cast("long").alias("size"),
    )
    one = lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c))
    ends = materialize(met.groupBy(*_EDGE).agg(one("before").alias("before"), one("after").alias("after"), F.first("size").alias("size")), "edge-ends")
    out = ends.where("after is not null").select(F.col("after.p1").alias("p1"), F.col("after.p2").alias("p2"), F.col("p1").alias("h1"), F.col("p2").alias("h2"), F.col("size").alias("away"))
    into = ends.where("before is not null").select(*_EDGE, F.col("before.p1").alias("h1"), F.col("before.p2").alias("h2"))
    heads = materialize(out.join(into, [*_EDGE, "h1", "h2"]), "chains")
    while True:  # every round doubles how far a pointer reaches
        up = heads.select(F.col("p1").alias("h1"), F.col("p2").alias("h2"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("away").alias("more"))
        moved = heads.join(up, ["h1", "h2"], "left").select(
            *_EDGE, F.coalesce("g1", "h1").alias("h1"), F.coalesce("g2", "h2").alias("h2"), (F.col("away") + F.coalesce("more", F.lit(0))).alias("away"), F.col("g1").isNotNull().alias("moved")
        )
        moved = materialize(moved, "chains")
        drop_materialized(heads)
        heads = moved.drop("moved")
        if moved.where("moved").isEmpty():
            drop_materialized(ends)
            return heads


def compacted_paths(placed: DataFrame) -> DataFrame:
    """(doc, row, lo, hi, source_doc, source_row, source_lo): later occurrences of the compacted paths, each with its source's coordinates."""
    places = materialize(placed.repartition("doc", "row").dropDuplicates(["doc", "row", "lo"]), "places")
    heads = _chain_heads(places)
    whole = (
        places.join(heads, _EDGE, "left")
        .withColumns({"h1": F.coalesce("h1", "p1"), "h2": F.coalesce("h2", "p2"), "start": F.col("lo") - F.coalesce("away", F.lit(0))})
        .groupBy("h1", "h2", "doc", "row", "start")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.col("hi") - F.col("lo") + 1).alias("windows"))
    )
    whole = materialize(whole, "compacted")
    source = whole.groupBy("h1", "h2").agg(F.min(F.struct("doc", "row", "lo", "hi")).alias("source"))
    # an occurrence runs through its path without a gap and is as long as the source
    full = (F.col("windows") == F.col("hi") - F.col("lo") + 1) & (F.col("hi") - F.col("lo") == F.col("source.hi") - F.col("source.lo"))
    return whole.join(source, ["h1", "h2"]).where(full & (F.col("doc") > F.col("source.doc"))).select(
        "doc", "row", "lo", "hi", F.col("source.doc").alias("source_doc"), F.col("source.row").alias("source_row"), F.col("source.lo").alias("source_lo")
    )


def remove_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 16) -> DataFrame:
    """Remove each word covered by a ``length``-word window that also starts in a document with a smaller id.

    Windows are judged on the input. Returns per document: id, n_words,
    n_removed, kept_text (words joined by one space) and removed_spans (word
    ranges). Null and empty texts have no words; a document shorter than
    ``length`` words loses none; a null id counts as larger than any other;
    rows that repeat an id are one document for the comparison and each return
    a row; an empty table gives an empty result; other columns are ignored.
    """
    texts = keyed(docs, id_col, text_col)
    scan, schema = path_scan(k, length)
    edges = materialize(texts.mapInArrow(scan, schema), "edges")
    named = materialize(edges.groupBy("kmer", *_EDGE).agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "named-edges")
    branching = named.groupBy("kmer").agg(F.count(F.lit(1)).alias("edges")).where("edges > 1").select("kmer", F.lit(True).alias("branches"))
    # an edge that neither branches nor reaches a second document takes nothing away
    kept = named.join(branching, "kmer", "left").where("branches or first < last").select(*_EDGE, "kmer", "first", "last", F.coalesce("branches", F.lit(False)).alias("branches"))
    placed = materialize(edges.join(kept, ["kmer", *_EDGE]), "placed")
    drop_materialized(edges)
    drop_materialized(named)
    whole = compacted_paths(placed.where("first < last").select("doc", "row", *_EDGE, "lo", "hi"))
    parts = resolve_windows(texts, placed.where("branches and doc = first").select("doc", "row", "lo", "hi"), length)
    return strip_passages(docs, whole.select("doc", "row", "lo", "hi").unionByName(parts), length, id_col, text_col)
