"""Subject areas of pages, by propagation of labels over a graph of articles.

The graph (``article_graph``) joins all articles that share content terms.  The
labels of pages are its seeds; they spread in steps until they stand still,
trusted seeds clamped, and an article keeps every area that reaches it.  Those areas are the rows; a check of each article's
sentences follows, which drops areas that are only mentioned in passing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..storage import written
from .article_graph import article_terms, packed, propagated_by_terms, summed, sums_schema, unpacked
from .layout import Pieces, bounded, joined, pieces

#: Least number of articles with a term for it to be a node; frequent words are left out where they lean to no area.
MIN_ARTICLES = 3
#: Nodes are held by every executor; more terms than this are refused.
MAX_TERMS = 3_000_000
#: Every verified term has a number for each area, so more areas than this are refused.
MAX_AREAS = 1000
#: A term leans to an area if the area has so many of its articles, a share above the area's share of all by so many standard deviations, and by this factor.
LEAST_SUPPORT, DEVIATIONS, LIFT = 2.5, 3.0, 1.6
#: The same of the seeds' own labels, and from how many labelled articles on a term that leans nowhere does not make articles alike.
SEED_SUPPORT, SEED_DEVIATIONS, TESTED = 1.5, 2.5, 3.0
#: Least part of an article's label that counts as an area of it.
LEAST_PART = 0.03
#: Cost of a change of area within an article as printed, and least evidence for an area, in log odds relative to the log of the number of areas.
CHANGE_COST, LEAST_EVIDENCE = 1.44, 1.2
#: Least number of terms of an article's area, and of sentences or headlines.
LEAST_TERMS, LEAST_SENTENCES = 2, 2
#: Share that every area keeps of every term, against over-confidence.
FLOOR = 0.03

# Headlines are words in capitals and a place, with one of these between them (or what a scan makes of it);
# the words that stand between two wares of an advert; the marks for a headline's start and end.
_TITLE = r"^\S+( \S+){0,3} ( ?|À|I+N+|A+T+|[&·•*+]{1,2}|[^\p{L}\p{N}\s]?[NT]|[IAlL1][^\p{L}\p{N}\s]?|lN|[^\p{L}\p{N}\s]{1,2}) \S{4,}$"
_WARES = r" (AND|UND|ET) "
_OPEN, _CLOSE, _LOUD = "\x02", "\x03", "\x04"
_TRIM = ".,;:!?\"'()[]*«»„“”‘’·&-‐¬­–—…"


def _headlines(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines in capitals (up to two letters may be misread) that have the form of a headline, and other lines in capitals."""
    if not len(text):
        return np.zeros(0, bool), np.zeros(0, bool)
    loud = pc.match_substring_regex(text, r"^\P{Ll}*(\p{Ll}\P{Ll}*){0,2}$").to_numpy(zero_copy_only=False).astype(bool)
    loud[loud] = pc.match_substring_regex(text.filter(pa.array(loud)), r"\p{Lu}{3}").to_numpy(zero_copy_only=False)
    shape = np.zeros(len(text), bool)
    lines = text.filter(pa.array(loud))
    shape[loud] = pc.and_not(pc.match_substring_regex(lines, _TITLE), pc.match_substring_regex(lines, _WARES)).to_numpy(zero_copy_only=False)
    return shape, loud & ~shape


def _sentences(texts: pa.Array, boxes: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the pages' articles (in lower case), and of each its page, sentence, article and whether it is of a headline.

    What is set in, and sentences with words in capitals, are adverts and left out.
    """
    p = pieces(texts, boxes)
    title, loud = _headlines(p.text)
    title &= p.flow == 0
    marked = pc.if_else(pa.array(title), pc.binary_join_element_wise("", _OPEN, p.text, _CLOSE, " "), pc.if_else(pa.array(loud), pc.binary_join_element_wise("", _LOUD, p.text, _CLOSE, " "), p.text)) if len(p.text) else p.text
    text, page = joined(Pieces(p.page, marked, p.flow, p.pages), p.flow == 0)
    none = np.zeros(0, np.int64)
    if not len(text):
        return pa.array([], pa.string()), none, none, none, none.astype(bool)
    starts = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]]))
    owner = page[starts]
    lengths = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))])
    whole = pa.concat_arrays([text])
    base = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset]
    running = pa.StringArray.from_buffers(len(starts), pa.py_buffer((lengths[np.append(starts, len(page))] + base).astype(np.int32).tobytes()), whole.buffers()[2])
    split = pc.utf8_split_whitespace(running)
    run = np.repeat(np.arange(len(running)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    # Every distinct word is looked at once.
    coded = pc.list_flatten(split).dictionary_encode()
    code, raw = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    opens, closes, louds = (pc.equal(raw, m).to_numpy(zero_copy_only=False)[code] for m in (_OPEN, _CLOSE, _LOUD))
    ends = (pc.match_substring_regex(raw, "[.?!][\"”»“'’]*$").to_numpy(zero_copy_only=False) & (pc.utf8_length(raw).to_numpy(zero_copy_only=False) > 4))[code]
    fresh = np.concatenate([[True], run[1:] != run[:-1]])
    after = np.concatenate([[False], (ends | closes)[:-1]])
    sentence = np.cumsum(fresh | after | opens | louds)
    article = np.cumsum(fresh | opens)
    place = np.arange(len(code))
    # What each word stands after last: the start of a headline, or something else.
    mark = np.maximum.accumulate(np.where(opens | closes | louds, place, -1))
    headline = (mark >= 0) & opens[mark] & ~opens
    capitals = pc.match_substring_regex(raw, r"^\P{Ll}*\p{Lu}{3,}").to_numpy(zero_copy_only=False)[code] & ~headline
    advert = np.zeros(int(sentence[-1]) + 1, bool)
    advert[sentence[capitals]] = True
    words = pc.utf8_trim(pc.utf8_lower(raw), characters=_TRIM)
    keep = ~advert[sentence] & ~opens & ~closes & ~louds & pc.match_substring_regex(words, r"^[\p{L}-]{4,}$").to_numpy(zero_copy_only=False)[code]
    return words.take(pa.array(code[keep])), owner[run[keep]], sentence[keep], article[keep], headline[keep]


def article_words(documents: DataFrame) -> DataFrame:
    """Per page the words of its articles in order, with sentence and article of each (counted within the page), and a digest of it all (NULL without words).

    Words stand in one text, apart by blanks; numbers are packed.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            words, page, sentence, article, _ = _sentences(batch.column("text"), batch.column("line_boxes"))
            bounds = np.searchsorted(page, np.arange(batch.num_rows + 1))
            first = np.searchsorted(page, page)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.concat_arrays([words])), " ")
            sentences, articles = (packed(x - x[first], bounds) for x in (sentence, article))
            digests = [hashlib.blake2b(b"\0".join(parts), digest_size=16).digest() if parts[0] else None for parts in zip(text.cast(pa.binary()).to_pylist(), sentences.to_pylist(), articles.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, sentences, articles, pa.array(digests, pa.binary())], names=["doc_id", "words", "sentences", "articles", "digest"])

    return documents.select("doc_id", "text", "line_boxes").mapInArrow(read, "doc_id bigint, words string, sentences binary, articles binary, digest binary")


def _flat(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of each number of the packed columns, and the numbers."""
    read = [unpacked(batch.column(n)) for n in names]
    return np.repeat(np.arange(batch.num_rows), read[0][0]), [x for _, x in read]


def _lists(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[pa.Array]]:
    """Row of each element of the list columns, and the elements."""
    size = pc.fill_null(pc.list_value_length(batch.column(names[0])), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), size), [pc.list_flatten(batch.column(n)) for n in names]


def _words(batch: pa.RecordBatch) -> pa.Array:
    """The words of all pages, one after the other."""
    words = pc.list_flatten(pc.split_pattern(batch.column("words"), " "))
    return words.filter(pc.greater(pc.binary_length(words), 0))


def repeated_pages(pages: DataFrame) -> DataFrame:
    """doc_id and first (the smallest doc_id) of every page whose articles read the same as those of a page before it."""
    read = pages.where("digest is not null").select("doc_id", "digest")
    groups = read.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return read.join(groups, "digest").where("doc_id <> first").select("doc_id", "first").distinct()


def term_counts(pages: DataFrame) -> DataFrame:
    """In how many articles each word occurs: word, articles.  Every batch is counted by itself before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, (articles,) = _flat(batch, "articles")
            code = _words(batch).dictionary_encode()
            n = len(code.dictionary)
            new = np.ones(len(page), bool)
            new[1:] = (page[1:] != page[:-1]) | (articles[1:] != articles[:-1])
            pairs = np.unique(np.cumsum(new) * (n + 1) + code.indices.to_numpy(zero_copy_only=False)) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([code.dictionary, pa.array(np.bincount(pairs % (n + 1), minlength=n)[:n], pa.int64())], names=["word", "articles"])

    return pages.select("words", "articles").mapInArrow(count, "word string, articles bigint").groupBy("word").agg(F.sum("articles").alias("articles"))


def incidence(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Per page its terms (as numbers) in order with sentence and article of each, and as ``node_articles`` and ``node_terms`` the distinct pairs of article and term; all packed."""
    known = pages.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, (sentence, article) = _flat(batch, "sentences", "articles")
            code = pc.fill_null(pc.index_in(_words(batch), value_set=known.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = code >= 0
            page, code, sentence, article = page[keep], code[keep], sentence[keep], article[keep]
            order = np.lexsort((code, article, page))
            p, a, c = page[order], article[order], code[order]
            new = np.ones(len(order), bool)
            new[1:] = (p[1:] != p[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            bounds = lambda of: np.searchsorted(of, np.arange(batch.num_rows + 1))
            lists = [packed(x, bounds(page)) for x in (code, sentence, article)] + [packed(x[new], bounds(p[new])) for x in (a, c)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "words", "sentences", "articles", "node_articles", "node_terms"])

    return pages.select("doc_id", "words", "sentences", "articles").mapInArrow(find, "doc_id bigint, words binary, sentences binary, articles binary, node_articles binary, node_terms binary")


def _scale(areas: int) -> float:
    """About what one term can say of an area at most."""
    return float(np.log(max(areas, 2)))


def _verified(sums: DataFrame, areas: list[str], prior: list[float], support: float = LEAST_SUPPORT, deviations: float = DEVIATIONS) -> DataFrame:
    """Of the summed labels of each term those that lean to some area, with their log odds by area."""
    total = sum(F.col(f"s{i}") for i in range(len(areas)))
    leans = F.lit(False)
    for i, p in enumerate(prior):
        bound = F.lit(p) * total
        leans = leans | ((F.col(f"s{i}") >= support) & (F.col(f"s{i}") > bound * LIFT) & (F.col(f"s{i}") - bound > deviations * F.sqrt(bound * (1 - p))))
    odds = F.array(*[F.log((F.col(f"s{i}") / total * (1 - FLOOR * len(areas)) + FLOOR) / F.lit(max(p, 1e-6))) for i, p in enumerate(prior)])
    return sums.where((total > 0) & leans).select("term", odds.alias("odds"))


def _votes(labels: DataFrame, copies: DataFrame, areas: list[str]) -> DataFrame:
    """doc_id and seed: the areas that labels give each page.  Copies vote for their first page; of its areas those with half the votes of the best stay."""
    number = F.create_map(*[x for i, a in enumerate(areas) for x in (F.lit(a), F.lit(i))])
    each = labels.select("doc_id", F.element_at(number, F.col("subject")).alias("area")).where("area is not null and doc_id is not null").distinct()
    counted = each.join(copies, "doc_id", "left").groupBy(F.coalesce("first", "doc_id").alias("doc_id"), "area").agg(F.count("*").alias("n"))
    votes = counted.groupBy("doc_id").agg(F.collect_list(F.struct("area", "n")).alias("votes"), F.max("n").alias("most"))
    return votes.select("doc_id", F.transform(F.filter("votes", lambda v: v["n"] * 2 >= F.col("most")), lambda v: v["area"]).alias("seed"))


def _seed_sums(graph: DataFrame, areas: int) -> DataFrame:
    """term, s0, s1, ...: the labels of pages, spread evenly to their areas, summed over the articles with the term."""
    names = ["term", *[f"s{i}" for i in range(areas)]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, (term,) = _flat(batch, "node_terms")
            row, (area,) = _lists(batch, "seed")
            seeds = np.zeros((batch.num_rows, areas))
            seeds[row, area.to_numpy(zero_copy_only=False)] = 1.0
            yield summed(term, (seeds / np.maximum(seeds.sum(axis=1), 1)[:, None])[page], names)

    labelled = graph.where("seed is not null").select("node_terms", "seed")
    return labelled.mapInArrow(walk, sums_schema(names)).groupBy("term").agg(*[F.sum(n).alias(n) for n in names[1:]])


def _parts(batch: pa.RecordBatch, page: np.ndarray, article: np.ndarray, areas: int) -> np.ndarray:
    """The label of each place's article (zeros where it has none), from the lists ``of_article`` and ``of_label`` of its page."""
    row, (labelled, label) = _lists(batch, "of_article", "of_label")
    label = pc.list_flatten(label).to_numpy(zero_copy_only=False).reshape(-1, areas)
    wide = 1 << 31
    key = row * wide + labelled.to_numpy(zero_copy_only=False)
    order = np.argsort(key)
    mine = page * wide + article
    if not len(key):
        return np.zeros((len(mine), areas))
    at = np.minimum(np.searchsorted(key[order], mine), len(key) - 1)
    return np.where((key[order][at] == mine)[:, None], label[order][at], 0.0)


def _label_sums(pages: DataFrame, areas: int) -> DataFrame:
    """term, s0, s1, ...: the labels of articles summed over the articles with the term."""
    names = ["term", *[f"s{i}" for i in range(areas)]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, (article, term) = _flat(batch, "node_articles", "node_terms")
            yield summed(term, _parts(batch, page, article, areas), names)

    return pages.select("node_articles", "node_terms", "of_article", "of_label").mapInArrow(walk, sums_schema(names)).groupBy("term").agg(*[F.sum(n).alias(n) for n in names[1:]])


def _prior(whole: list[float | None]) -> list[float]:
    total = sum(x or 0.0 for x in whole) or 1.0
    return [max((x or 0.0) / total, 1e-3) for x in whole]


def content_terms(graph: DataFrame, terms: int, areas: list[str]) -> np.ndarray:
    """Numbers of the terms that make articles alike: all but those that labelled articles use in every area alike."""
    sums = written(_seed_sums(graph, len(areas)), "sums")
    names = [f"s{i}" for i in range(len(areas))]
    labelled = graph.where("seed is not null").select(F.explode("seed").alias("area"), F.size("seed").alias("n")).groupBy("area").agg(F.sum(1 / F.col("n")).alias("n")).collect()  # one row per area
    share = {r["area"]: r["n"] for r in labelled}
    prior = _prior([share.get(i) for i in range(len(areas))])
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    even = sums.where(total >= TESTED).select("term").join(_verified(sums, areas, prior, SEED_SUPPORT, SEED_DEVIATIONS).select("term"), "term", "left_anti")
    return np.setdiff1d(np.arange(terms), even.toArrow().column("term").to_numpy())


def article_labels(graph: DataFrame, seeds: DataFrame, terms: int, areas: list[str]) -> DataFrame:
    """doc_id, article, s0, s1, ...: the areas of every article, by propagation between all articles that share content terms."""
    content = content_terms(graph, terms, areas)
    return propagated_by_terms(article_terms(graph, content), len(content), seeds, len(areas))


def _assign(odds: np.ndarray, page: np.ndarray, sentence: np.ndarray, article: np.ndarray, term: np.ndarray, pages: int, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Areas of pages: the best path through each page's sentences, with a cost for changing the area within an article.

    ``odds`` has a row per term and a column per area; ``held`` tells for each
    place and area whether the place's article has the area at all.  Returns
    pairs of page and area, several per page where it has several.
    """
    n_areas = odds.shape[1]
    if not len(page):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (page[1:] != page[:-1]) | (sentence[1:] != sentence[:-1])])
    row = np.cumsum(new) - 1
    emission = np.zeros((row[-1] + 1, n_areas))
    np.add.at(emission, row, odds[term])
    if held is not None:
        emission[~held[new]] = -np.inf
    s_page, s_article = page[new], article[new]
    first = np.searchsorted(s_page, np.arange(pages))
    step = np.arange(len(s_page)) - first[s_page]
    longest = int(step.max()) + 1
    # State n_areas is "none": no evidence for or against.
    states = n_areas + 1
    full = np.concatenate([emission, np.zeros((len(emission), 1))], axis=1)
    value, back = np.zeros((pages, states)), np.zeros((len(full), states), np.int32)
    order = np.argsort(step, kind="stable")
    bounds = np.searchsorted(step[order], np.arange(longest + 1))
    last_article = np.full(pages, -1)
    for t in range(longest):
        now = order[bounds[t] : bounds[t + 1]]
        who = s_page[now]
        before = value[who]
        cost = np.where(s_article[now] == last_article[who], CHANGE_COST * _scale(n_areas), 0.0)[:, None] if t else np.zeros((len(now), 1))
        top = before.argmax(axis=1)
        jump = before[np.arange(len(now)), top][:, None] - cost
        stay = before >= jump
        back[now] = np.where(stay, np.arange(states), top[:, None])
        value[who] = np.where(stay, before, jump) + full[now]
        last_article[who] = s_article[now]
    state = np.empty(len(full), np.int64)
    current = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        now = order[bounds[t] : bounds[t + 1]]
        who = s_page[now]
        state[now] = current[who]
        current[who] = back[now, state[now]]
    # What an article says of an area: a single sentence is a mention in passing, whatever it holds.
    block = np.cumsum(np.concatenate([[True], (s_page[1:] != s_page[:-1]) | (s_article[1:] != s_article[:-1])])) - 1
    own = full[np.arange(len(full)), state]
    speaks = (state < n_areas) & (own > 0)
    keys, at = np.unique(block[speaks] * states + state[speaks], return_inverse=True)
    evidence, sentences = np.bincount(at, weights=own[speaks]), np.bincount(at)
    good = (evidence >= LEAST_EVIDENCE * _scale(n_areas)) & (sentences >= LEAST_SENTENCES)
    of_block = s_page[np.concatenate([[True], block[1:] != block[:-1]])]
    found_page, found_area = of_block[keys[good] // states], keys[good] % states
    pairs = np.unique(found_page * n_areas + found_area)
    return pairs // n_areas, pairs % n_areas


def subject_areas(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and subject of each page, one row for every area that is the main concern of an article of it.

    The areas are those that propagation brings to the page's articles.  The
    check that follows takes each page's sentences in order, so that articles
    without headline come apart, and asks of every area of an article whether
    its sentences speak of it.  Terms and their areas go to every executor;
    their number is checked.

    Defined cases: pages with NULL or blank text, and pages without evidence,
    have no row; labels of unknown areas or pages count for nothing; without
    any label there are no rows; a page kept twice has its rows once; pages
    whose articles read the same count as one and have the same rows.
    """
    names = [r[0] for r in areas.select("subject").where("subject is not null").distinct().orderBy("subject").limit(MAX_AREAS + 1).collect()]
    if len(names) > MAX_AREAS:
        raise ValueError(f"more than {MAX_AREAS} subject areas")
    if not names:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, subject string")
    words = written(article_words(documents), "articles")
    # Copies count once, or a page scanned often enough would make its words look like everybody's.
    copies = written(repeated_pages(words), "copies")
    words = words.join(copies, "doc_id", "left_anti")
    chosen = written(term_counts(words).where(F.col("articles") >= MIN_ARTICLES), "words")
    if (found := chosen.count()) > MAX_TERMS:
        raise ValueError(f"{found} terms; at most {MAX_TERMS} are held by every executor")
    terms = sorted(r[0] for r in chosen.select("word").collect())
    pages = written(incidence(words, terms), "incidence")
    seeds = written(_votes(labels, copies, names), "seeds")
    graph = pages.select("doc_id", "node_articles", "node_terms").join(seeds, "doc_id", "left")
    spread = article_labels(graph, seeds, len(terms), names)
    each = [F.col(f"s{i}") for i in range(len(names))]
    label = spread.where(sum(each) > 0).groupBy("doc_id").agg(F.collect_list("article").alias("of_article"), F.collect_list(F.array(*each)).alias("of_label"))
    labelled = written(pages.join(label, "doc_id"), "labelled")
    sums = written(_label_sums(labelled, len(names)), "sums")
    prior = _prior(list(spread.agg(*[F.sum(x) for x in each]).first()))
    leaning = _verified(sums, names, prior).orderBy("term").toArrow().combine_chunks()
    odds = np.array(pc.list_flatten(leaning.column("odds")).to_numpy(), float).reshape(-1, len(names))
    held = documents.sparkSession.sparkContext.broadcast((leaning.column("term").to_numpy(), odds, len(terms), names))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verified, odds, n_terms, subjects = held.value
        place = np.full(n_terms + 1, -1)
        place[verified] = np.arange(len(verified))
        for batch in batches:
            page, (term, sentence, article) = _flat(batch, "words", "sentences", "articles")
            row = place[term]
            keep = row >= 0
            parts = _parts(batch, page[keep], article[keep], len(subjects))
            who, area = _assign(odds, page[keep], sentence[keep], article[keep], row[keep], batch.num_rows, parts >= LEAST_PART)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(who)), pa.array(subjects, pa.string()).take(pa.array(area))], names=["doc_id", "subject"])

    found = written(labelled.mapInArrow(check, "doc_id bigint, subject string").distinct(), "subjects")
    return found.unionByName(copies.join(found.withColumnRenamed("doc_id", "first"), "first").select("doc_id", "subject"))
