"""A graph of articles that share terms, and the propagation of labels over it.

Every two articles that share a content term are partners; no partner is left
out.  Their number grows with the square of the articles, so the edges are
never listed: what all partners of an article say is summed by term first,
exactly, and an article adds the sums of its terms less its own part.  A step
costs as much as the articles have terms, however many partners they have.

``alike_articles`` lists near partners only, a constant number per article; the
propagation does not use it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import written

#: Orders of the articles (8 at most), and with how many of the next ones each is compared in every order.
TREES, NEXT = 6, 1
#: Least number of terms that two alike articles share, and of an article's terms to be a node of the graph.
LEAST_SHARED = 2
#: Least share of the shorter article's terms that the other has too.
LEAST_OVERLAP = 0.2
#: Sums by term and area that every executor holds at once; more areas than that go in several rounds.
MAX_SUMS = 24_000_000
#: What a shared term tells at least, beside how far its labels are from those of all terms: no partner weighs nothing.
LEAST_TOLD = 0.01
#: Part of an article's label that stays from step to step, so that labels settle.
INERTIA = 0.5
#: Labels are sent in so many parts of one: sums of whole numbers are the same in any order, and small in a shuffle.
PARTS = 1000
#: Labels stand still when at most this share of all articles changes its first area.
STILL = 0.02
#: A seed is trusted where it has this part of what an article's neighbours say; its areas then have this part of the article's label at least.
TRUST, CLAMPED = 0.4, 0.75
#: Weight of labels that neighbours disagree with, and of labels that nothing is known for.
DISAGREED, UNKNOWN = 0.25, 0.5

_NODE = ("doc_id", "article")


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary per row with its 32-bit numbers; ``bounds`` are the places where the rows begin, and the end.

    Lists of numbers travel like this, as a list costs the JVM every element.
    """
    data = np.ascontiguousarray(values, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((np.asarray(bounds) * 4).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each row has, and all numbers; NULL has none."""
    column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    count = (int(offsets[-1]) - int(offsets[0])) // 4
    return np.diff(offsets) // 4, np.frombuffer(column.buffers()[2], np.int32, count, int(offsets[0])) if count else np.zeros(0, np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers well spread (the finaliser of a multiplicative hash)."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def sketches(graph: DataFrame, content: np.ndarray, trees: int = TREES) -> DataFrame:
    """place, doc_id, article and terms: every article with at least ``LEAST_SHARED`` content terms once for each tree.

    ``content`` are the numbers of the terms that count, in order.  ``place``
    is made of the tree's number and the three least hashes of the terms under
    the tree's hash function, of 20 bits each.
    """
    held = graph.sparkSession.sparkContext.broadcast(content)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            size, term = unpacked(batch.column("node_terms"))
            article = unpacked(batch.column("node_articles"))[1]
            page = np.repeat(np.arange(batch.num_rows), size)
            at = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
            keep = known[at] == term if len(known) else np.zeros(len(term), bool)
            page, article, term = page[keep], article[keep], term[keep]
            if not len(page):
                continue
            new = np.concatenate([[True], (page[1:] != page[:-1]) | (article[1:] != article[:-1])])
            node = np.cumsum(new) - 1
            count = np.bincount(node)
            enough = count >= LEAST_SHARED
            use = enough[node]
            page, article, term, node = page[use], article[use], term[use], (np.cumsum(enough) - 1)[node[use]]
            if not len(page):
                continue
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            owner = batch.column("doc_id").take(pa.array(page[first]))
            lists = packed(term, np.append(first, len(node)))
            size = np.diff(np.append(first, len(node)))
            for tree in range(trees):
                code = (_mixed(term.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(44)).astype(np.int64)
                code = code[np.lexsort((code, node))]
                place = sum(np.where(size > i, code[np.minimum(first + i, first + size - 1)], 2**20 - 1) << (20 * (2 - i)) for i in range(3)) + (tree << 60)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), owner, pa.array(article[first], pa.int32()), lists], names=["place", *_NODE, "terms"])

    return graph.select("doc_id", "node_articles", "node_terms").mapInArrow(sketch, "place bigint, doc_id bigint, article int, terms binary")



def _overlaps(size: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many terms rows ``left`` and ``right`` share, pair by pair; a row has no term twice."""
    begin = np.cumsum(size) - size
    wide = int(values.max(initial=0)) + 1

    def keys(rows: np.ndarray) -> np.ndarray:
        pair = np.repeat(np.arange(len(rows)), size[rows])
        at = np.arange(len(pair)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows]) + np.repeat(begin[rows], size[rows])
        return pair * wide + values[at]

    both = np.sort(np.concatenate([keys(left), keys(right)]))
    return np.bincount(both[1:][both[1:] == both[:-1]] // wide, minlength=len(left))


def _verified_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted sketches the pairs of neighbours that are alike, in both directions."""
    kept: pa.RecordBatch | None = None
    for batch in batches:
        fresh = kept.num_rows if kept is not None else 0
        rows = pa.concat_batches([kept, batch]) if fresh else batch
        n = rows.num_rows
        tree = rows.column("place").to_numpy(zero_copy_only=False) >> 60
        size, values = unpacked(rows.column("terms"))
        size, values = size.astype(np.int64), values.astype(np.int64)
        for step in range(1, NEXT + 1):
            right = np.arange(max(fresh, step), n)
            left = right - step
            same = tree[left] == tree[right]
            left, right = left[same], right[same]
            shared = _overlaps(size, values, left, right)
            good = (shared >= LEAST_SHARED) & (shared >= LEAST_OVERLAP * np.minimum(size[left], size[right]))
            a, b, weight = pa.array(left[good]), pa.array(right[good]), pa.array(shared[good], pa.int64())
            for x, y in ((a, b), (b, a)):
                yield pa.RecordBatch.from_arrays([*[rows.column(c).take(x) for c in _NODE], *[rows.column(c).take(y) for c in _NODE], weight], names=["doc_id", "article", "to_doc", "to_article", "weight"])
        kept = rows.slice(max(n - NEXT, 0))


def alike_articles(graph: DataFrame, content: np.ndarray) -> DataFrame:
    """doc_id, article, to_doc, to_article, weight (the number of shared terms): verified edges in both directions; one that several trees find weighs as often."""
    # Articles with equal terms stand in another order in each tree, so that many of them are no long chain.
    order = [F.col("place"), F.xxhash64(F.shiftright("place", 60), *_NODE)]
    return sketches(graph, content).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_verified_pairs, "doc_id bigint, article int, to_doc bigint, to_article int, weight bigint")


def sums_schema(names: list[str]) -> str:
    return ", ".join(["term int", *[f"{n} double" for n in names[1:]]])


def summed(term: np.ndarray, weight: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """The weights (a row per place) summed by term."""
    found, code = np.unique(term, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *[pa.array(np.bincount(code, weights=weight[:, i], minlength=len(found)), pa.float64()) for i in range(weight.shape[1])]], names=names)


def article_terms(graph: DataFrame, content: np.ndarray) -> DataFrame:
    """doc_id, article and terms of every article that has terms: the places in ``content`` of those that count, packed."""
    held = graph.sparkSession.sparkContext.broadcast(content)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            size, term = unpacked(batch.column("node_terms"))
            article = unpacked(batch.column("node_articles"))[1]
            page = np.repeat(np.arange(batch.num_rows), size)
            new = np.ones(len(page), bool)
            new[1:] = (page[1:] != page[:-1]) | (article[1:] != article[:-1])
            at = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
            keep = known[at] == term if len(known) else np.zeros(len(term), bool)
            lists = packed(at[keep], np.searchsorted((np.cumsum(new) - 1)[keep], np.arange(new.sum() + 1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(page[new])), pa.array(article[new], pa.int32()), lists], names=[*_NODE, "terms"])

    return graph.select("doc_id", "node_articles", "node_terms").mapInArrow(tell, "doc_id bigint, article int, terms binary")


def _total(names: list[str]) -> Column:
    return sum((F.col(n) for n in names[1:]), F.col(names[0]))


def _names(areas: int) -> list[str]:
    return [f"s{i}" for i in range(areas)]


def _told(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """The labels of a batch of articles as whole numbers of parts."""
    return np.stack([np.floor(batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) * PARTS + 0.5) for n in names], axis=1)


def partners_by_term(terms: int, areas: int, holders: np.ndarray) -> Callable[[DataFrame], DataFrame]:
    """What tells every article what all that share terms with it say: adds got_s0, got_s1, ... to articles with ``terms`` and labels.

    Each of an article's terms listens evenly to all other articles with the
    term, and a term whose labels are like everybody's tells little: an edge
    weighs the sum of told^2 / (``holders`` - 1) over the shared terms, where
    told is the relative entropy of the term's labels (and one more article
    that is like all) against those of all terms, and ``LEAST_TOLD``.  Labels
    are summed by term as whole numbers, and an article's own is taken off
    before anything is divided, so no rounding stands for a partner.
    """
    names = _names(areas)
    wide = max(1, MAX_SUMS // max(terms, 1))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, term = unpacked(batch.column("terms"))
            yield summed(term, _told(batch, names)[np.repeat(np.arange(len(size)), size)], ["term", *names])

    def listener(held: Broadcast, part: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def listen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, weight = held.value
            for batch in batches:
                size, term = unpacked(batch.column("terms"))
                row = np.repeat(np.arange(len(size)), size)
                own, w = _told(batch, part), weight[term]
                got = [np.bincount(row, weights=(sums[term, i] - own[row, i]) * w, minlength=len(size)) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(g, pa.float64()) for g in got]], names=[*batch.schema.names, *[f"got_{n}" for n in part]])

        return listen

    def hear(now: DataFrame) -> DataFrame:
        spoken = now.where(_total(names) > 0).select("terms", *names).mapInArrow(add, sums_schema(["term", *names]))
        sums = written(spoken.groupBy("term").agg(*[F.sum(n).alias(n) for n in names]), "said")
        whole = sums.agg(*[F.sum(n) for n in names]).first()
        total = sum(x or 0.0 for x in whole) or 1.0
        prior = [max((x or 0.0) / total, 1e-3) for x in whole]
        shares = [(p, (F.col(n) + PARTS * p) / (_total(names) + PARTS)) for n, p in zip(names, prior)]
        told = F.greatest(sum((q * F.log(q / p) for p, q in shares), F.lit(0.0)), F.lit(0.0)) + LEAST_TOLD
        for start in range(0, areas, wide):
            part = names[start : start + wide]
            said = sums.select("term", (told * told).alias("weight"), *part).toArrow()
            term = said.column("term").to_numpy()
            table, weight = np.zeros((terms, len(part))), np.zeros(terms)
            weight[term] = said.column("weight").to_numpy() / np.maximum(holders[term] - 1, 1)
            for i, n in enumerate(part):
                table[term, i] = said.column(n).to_numpy()
            held = now.sparkSession.sparkContext.broadcast((table, weight))
            fields = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in now.schema.fields] + [f"got_{n} double" for n in part])
            now = now.mapInArrow(listener(held, part), fields)
        return now

    return hear


def propagated_by_terms(nodes: DataFrame, terms: int, seeds: DataFrame, areas: int) -> DataFrame:
    """doc_id, article and s0, s1, ... of the articles of ``article_terms``: labels spread between all that share terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term = unpacked(batch.column("terms"))[1]
            yield summed(term, np.ones((len(term), 1)), ["term", "n"])

    nodes = written(nodes, "nodes")
    counted = nodes.select("terms").mapInArrow(count, sums_schema(["term", "n"])).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    holders = np.zeros(terms)
    holders[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return _settled(nodes, seeds, areas, partners_by_term(terms, areas, holders))


def propagated(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, areas: int) -> DataFrame:
    """The same for a graph whose edges are listed: doc_id, article, to_doc, to_article and weight, in both directions."""
    names = _names(areas)
    linked = written(edges.groupBy(*_NODE).agg(F.collect_list(F.struct("to_doc", "to_article", "weight")).alias("to")), "links")

    def hear(now: DataFrame) -> DataFrame:
        told = now.where(_total(names) > 0).select(*_NODE, *[F.floor(F.col(n) * PARTS + 0.5).alias(n) for n in names]).join(linked, list(_NODE)).select(F.explode("to").alias("to"), *names)
        sent = told.select(F.col("to.to_doc").alias("doc_id"), F.col("to.to_article").alias("article"), *[(F.col(n) * F.col("to.weight")).alias(n) for n in names])
        got = sent.groupBy(*_NODE).agg(*[F.sum(n).alias(f"got_{n}") for n in names])
        return now.join(got, list(_NODE), "left").select(*now.columns, *[F.coalesce(F.col(f"got_{n}").cast("double"), F.lit(0.0)).alias(f"got_{n}") for n in names])

    return _settled(nodes, seeds, areas, hear)


def _settled(nodes: DataFrame, seeds: DataFrame, areas: int, hear: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, article and s0, s1, ...: how much of each area every article has, once the labels stand still.

    ``nodes`` has doc_id, article and what ``hear`` needs, ``seeds`` doc_id and the list ``seed`` of
    the areas that labels give a page.  Labels spread evenly to their page's
    articles first.  Each step takes to every article the labels of its
    partners (``hear`` adds their sums).  Where an article's neighbours
    agree with its page's labels these are trusted, and the article is clamped
    to them in every step and in the result: only the rest of its label may be
    of other areas, as hands leave some out.  Where they do not agree the
    article goes by its neighbours and counts less.  Articles keep all areas
    that reach them.  Steps go on until hardly any article changes its
    first area, or the number of changes has not fallen three times in a row.
    """
    names = _names(areas)
    kept = [*nodes.columns, "seed"]
    zero = F.lit(0.0)

    def even(i: int) -> Column:
        return F.when(F.array_contains("seed", i), 1.0 / F.size("seed")).otherwise(0.0)

    def first_area(of: list[str]) -> Column:
        return F.array_position(F.array(*of), F.array_max(F.array(*of))) * (_total(of) > 0).cast("int")

    def fresh(i: int, n: str) -> Column:
        part = F.when(F.col("total") > 0, F.col(f"got_{n}") / F.col("total"))
        own = F.when(F.array_contains("seed", i), F.col(f"got_{n}") / F.col("inside")).otherwise(0.0)
        taken = F.coalesce(
            F.when(F.col("seed").isNull(), part)
            .when(F.col("total") == 0, even(i) * UNKNOWN)
            .when(F.col("inside") >= TRUST * F.col("total"), own * CLAMPED + part * (1 - CLAMPED))
            .otherwise(part * DISAGREED),
            zero,
        )
        # What had no label before takes the new one whole.
        return F.when(_total(names) > 0, F.col(n) * INERTIA + taken * (1 - INERTIA)).otherwise(taken)

    now = written(nodes.join(seeds, "doc_id", "left").select(*kept, *[F.coalesce(even(i), zero).cast("float").alias(n) for i, n in enumerate(names)]), "labels")
    articles = now.count()
    least, waited = None, 0
    while True:
        weighed = hear(now).withColumn("total", _total([f"got_{n}" for n in names])).withColumn("inside", sum((F.when(F.array_contains("seed", i), F.col(f"got_{n}")).otherwise(0.0) for i, n in enumerate(names)), zero))
        took = weighed.select(*kept, *[fresh(i, n).cast("float").alias(n) for i, n in enumerate(names)], first_area(names).alias("before"))
        now = written(took.withColumn("changed", first_area(names) != F.col("before")).drop("before"), "labels")
        changed = now.where("changed").count()
        now = now.drop("changed")
        waited = waited + 1 if least is not None and changed >= least else 0
        least = changed if least is None else min(least, changed)
        if changed <= STILL * articles or waited == 3:
            return now.select(*_NODE, *names)
