import math
import random

import numpy as np
import pytest

from changeweave.llm import article_graph
from changeweave.llm.article_graph import LEAST_OVERLAP, LEAST_SHARED, NEXT, TREES, UNKNOWN, alike_articles, article_terms, partners_by_term, propagated
from changeweave.llm.subjects import _assign, article_labels, subject_areas

DOCS = "doc_id bigint, text string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:int>>"
STEMS = {"law": "court plead statut", "music": "violin choral oper", "farming": "harvest plough cattl", "sport": "wicket wrestl sprint", "health": "nurs clinic fever", "software": "server comput modul"}
WORDS = {s: [stem + end for stem in stems.split() for end in ("", "er", "ing", "ish", "ful")] for s, stems in STEMS.items()}
FILLER = ["It rained all day and the station stood empty.", "Nobody said why the baker was late again.", "More people waited at the tower until evening."]


def article(rng, subject, sentences=4):
    lines = [f"{rng.choice(WORDS[subject]).upper()}S IN {rng.choice(['NOLFORD', 'WENBY', 'TAMSTEAD'])}"] if rng.random() < 0.8 else []
    for _ in range(sentences):
        a, b = rng.sample(WORDS[subject], 2)
        lines += [f"The {a} of the town met the {b} there.", rng.choice(FILLER)]
    return lines


def corpus(rng, n):
    docs, truth = [], {}
    for i in range(n):
        subjects = rng.sample(list(WORDS), rng.choice([1, 1, 2]))
        lines = []
        for s in subjects:
            lines += article(rng, s)
        other = rng.choice([s for s in WORDS if s not in subjects])
        a, b = rng.sample(WORDS[other], 2)
        lines.insert(len(lines) // 2, f"So the {a} and the {b} were seen.")
        lines.append(f"FINEST {rng.choice(WORDS[other]).upper()}S at Orel.")
        docs.append((i, "\n".join(lines), [(50, 100 + 25 * k, 50 + 11 * len(t), 120 + 25 * k, 80) for k, t in enumerate(lines)]))
        truth[i] = set(subjects)
    return docs, truth


def test_labels_spread_to_pages_without(spark):
    rng = random.Random(3)
    docs, truth = corpus(rng, 600)
    labels = []
    for i in range(0, 600, 4):
        for s in truth[i]:
            labels.append((i, s if rng.random() > 0.1 else rng.choice(list(WORDS)), "hand"))
    docs += [(900, None, None), (901, "  ", None), (902, "Nothing here.", None)]
    areas = spark.createDataFrame([(s, "") for s in WORDS] + [(None, None)], "subject string, description string")
    found = {}
    for r in subject_areas(spark.createDataFrame(docs, DOCS), areas, spark.createDataFrame(labels + [(5, "unknown", "x"), (None, "law", "x")], "doc_id bigint, subject string, labeller string")).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    held_out = [i for i in truth if i % 4]
    right = sum(found.get(i) == truth[i] for i in held_out)
    assert right / len(held_out) >= 0.95
    assert not {900, 901, 902} & set(found)


def test_copies_of_a_page_do_not_make_its_words_stop_words(spark):
    """A page scanned 300 times beside 600 others, half of the scans read alike and half with a line of their own."""
    rng = random.Random(3)
    docs, truth = corpus(rng, 600)
    labels = [(i, s, "hand") for i in range(0, 600, 4) for s in truth[i]]
    text, boxes = docs[1][1:]
    for n in range(300):
        more = f"\nSeen by Mr {chr(97 + n % 26)}{chr(97 + n // 26)}orbel." if n % 2 else ""
        docs.append((1000 + n, text + more, boxes + [(50, 5000, 90, 5020, 80)] if more else boxes))
        truth[1000 + n] = truth[1]
    areas = spark.createDataFrame([(s, "") for s in WORDS], "subject string, description string")
    found = {}
    for r in subject_areas(spark.createDataFrame(docs, DOCS), areas, spark.createDataFrame(labels, "doc_id bigint, subject string, labeller string")).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    assert all(found.get(1000 + n) == truth[1] for n in range(300))
    assert sum(found.get(i) == truth[i] for i in range(600)) >= 0.95 * 600


def test_labels_reach_articles_through_unlabelled_ones(spark):
    """Law's labels stand at its first words only; the others are tied to them by chains of pages without label."""
    rng = random.Random(5)
    links = [[stem + end for end in ("a", "er", "ing", "ish", "ful", "ment", "ory", "age")] for stem in ("court", "plead", "statut", "juror")]
    docs, labels = [], []

    def add(words, subject, label):
        lines = []
        for _ in range(4):
            a, b, c = (rng.choice(w) for w in (words[0], words[-1], words[rng.randrange(len(words))]))
            lines += [f"The {a} of the {c} met the {b} there.", rng.choice(FILLER)]
        docs.append((len(docs), "\n".join(lines), [(50, 100 + 25 * k, 50 + 11 * len(t), 120 + 25 * k, 80) for k, t in enumerate(lines)]))
        if label:
            labels.append((docs[-1][0], subject, "hand"))
        return docs[-1][0]

    for subject in ("music", "farming", "sport"):
        for n in range(100):
            add([WORDS[subject]], subject, n % 2)
    for n in range(40):
        add([links[0]], "law", n % 2)
    for one, two in zip(links, links[1:]):
        for _ in range(30):
            add([one, two], "law", False)
    wanted = [add([links[-1]], "law", False) for _ in range(30)]
    areas = spark.createDataFrame([(s, "") for s in ("law", "music", "farming", "sport")], "subject string, description string")
    rows = subject_areas(spark.createDataFrame(docs, DOCS), areas, spark.createDataFrame(labels, "doc_id bigint, subject string, labeller string")).collect()
    assert {d for d, s in rows if s == "law"} >= set(wanted)


def test_seeds_clamp_where_neighbours_agree(spark):
    """Pages 1 and 2 are alike, 3 to 6 too, and 2 is alike 3; page 6 is labelled against its neighbours."""
    nodes = spark.createDataFrame([(i, 0) for i in range(1, 8)], "doc_id bigint, article int")
    pairs = [(1, 2), (3, 4), (4, 5), (5, 6), (3, 5), (3, 6), (4, 6), (2, 3)]
    edges = spark.createDataFrame([(a, 0, b, 0, 4) for x in pairs for a, b in (x, x[::-1])], "doc_id bigint, article int, to_doc bigint, to_article int, weight bigint")
    seeds = spark.createDataFrame([(1, [0]), (3, [1]), (4, [1]), (6, [2]), (7, [0, 2])], "doc_id bigint, seed array<int>")
    found = {r.doc_id: [r.s0, r.s1, r.s2] for r in propagated(nodes, edges, seeds, 3).collect()}
    assert found[3][1] > 0.75 and found[4][1] > 0.75  # clamped
    assert found[5][1] == max(found[5]) > 0  # reached by neighbours
    assert found[6][1] > found[6][2]  # its label is not trusted
    assert found[2][0] > 0 and found[2][1] > 0  # keeps both areas
    assert found[7] == pytest.approx([UNKNOWN / 2, 0.0, UNKNOWN / 2], abs=0.1) and found[7][1] == 0  # nothing is known against it; goes there by steps


def test_edges_are_verified_and_bounded(spark):
    """Every edge joins articles with enough shared terms; a group of any size costs a constant per member; nearly all members are linked."""
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(40 * (i % 5), 40 * (i % 5) + 40), 12)) for i in range(400)] + [list(range(300, 310))] * 200 + [[7], []]
    pack = lambda x: np.array(x, np.int32).tobytes()
    graph = spark.createDataFrame([(i, pack([0] * len(t)), pack(t)) for i, t in enumerate(sets)], "doc_id bigint, node_articles binary, node_terms binary")
    edges = alike_articles(graph, np.arange(1000)).collect()
    for e in edges:
        shared = len(set(sets[e.doc_id]) & set(sets[e.to_doc]))
        assert shared >= LEAST_SHARED and shared >= LEAST_OVERLAP * 10 and e.weight == shared
    assert {(e.doc_id, e.to_doc) for e in edges} == {(e.to_doc, e.doc_id) for e in edges}
    assert len(edges) <= 2 * TREES * NEXT * len(sets)
    assert len({e.doc_id for e in edges}) >= 0.98 * 600
    assert alike_articles(graph.limit(0), np.arange(1000)).count() == alike_articles(graph, np.zeros(0, int)).count() == 0


def term_pages(spark, sets, seeds):
    """A page with one article of each set of terms, and the labels of some."""
    pack = lambda x: np.array(x, np.int32).tobytes()
    schema = "doc_id bigint, node_articles binary, node_terms binary, seed array<int>"
    return spark.createDataFrame([(i, pack([0] * len(t)), pack(sorted(t)), seeds.get(i)) for i, t in enumerate(sets)], schema), spark.createDataFrame(list(seeds.items()), "doc_id bigint, seed array<int>")


def test_no_partner_is_dropped(spark):
    """300 articles are nearly the same; each has 40 labelled partners of area 0 and 20 of area 1, further away than the others."""
    rng = random.Random(2)
    own = iter(range(100, 100_000))
    alike = [[*range(4), *range(10, 14), *rng.sample(range(20, 40), 16)] for _ in range(300)]
    far = [[*range(4), *(next(own) for _ in range(14))] for _ in range(40)] + [[*range(10, 14), *(next(own) for _ in range(14))] for _ in range(20)]
    other = [[next(own) for _ in range(8)] for _ in range(60)]
    seeds = {300 + i: [0 if i < 40 else 1 if i < 60 else 2] for i in range(120)}
    graph, labels = term_pages(spark, alike + far + other, seeds)
    found = {r.doc_id: (r.s0, r.s1) for r in article_labels(graph, labels, next(own), ["law", "music", "sport"]).collect()}
    assert len(found) == 420
    assert all(min(found[i]) > 0.2 * sum(found[i]) for i in range(300))


def test_sums_by_term_are_those_over_all_pairs(spark, monkeypatch):
    """What partners say is what a loop over all pairs gives, whatever share of them is alike, and in several rounds of areas too."""
    rng = random.Random(4)
    sets = [set(rng.sample(range(30), rng.randrange(6))) for _ in range(120)] + [{1, 2, 3, 40}] * 60
    graph, _ = term_pages(spark, sets, {})
    rows = article_terms(graph, np.arange(1, 41)).collect()
    assert sorted(r.doc_id for r in rows) == [i for i, t in enumerate(sets) if t]
    label = {r.doc_id: [rng.choice([0.0, 0.25, 1.0]) for _ in range(3)] for r in rows}
    now = spark.createDataFrame([(r.doc_id, r.article, r.terms, None, *label[r.doc_id]) for r in rows], "doc_id bigint, article int, terms binary, seed array<int>, s0 float, s1 float, s2 float").repartition(3)
    holders = np.array([sum(t in x for x in sets) for t in range(1, 41)])
    said = {t: [sum(label[d][i] * article_graph.PARTS for d in label if t in sets[d]) for i in range(3)] for t in range(1, 41)}
    prior = [sum(x[i] for x in said.values()) / sum(map(sum, said.values())) for i in range(3)]
    shares = {t: [(x + article_graph.PARTS * p) / (sum(said[t]) + article_graph.PARTS) for x, p in zip(said[t], prior)] for t in said}
    weight = {t: (sum(q * math.log(q / p) for q, p in zip(shares[t], prior)) + article_graph.LEAST_TOLD) ** 2 / max(holders[t - 1] - 1, 1) for t in said}
    for most in (article_graph.MAX_SUMS, 40):
        monkeypatch.setattr(article_graph, "MAX_SUMS", most)
        got = {r.doc_id: [r.got_s0, r.got_s1, r.got_s2] for r in partners_by_term(40, 3, holders)(now).collect()}
        for a in label:
            edge = {b: sum(weight[t] for t in (sets[a] & sets[b]) - {0}) for b in label if b != a}
            assert got[a] == pytest.approx([sum(edge[b] * label[b][i] * article_graph.PARTS for b in edge) for i in range(3)])
    assert article_terms(graph.limit(0), np.arange(9)).count() == 0
    assert not any(r.terms for r in article_terms(graph, np.zeros(0, int)).collect())


def test_without_labels_or_pages(spark):
    areas = spark.createDataFrame([("law", "")], "subject string, description string")
    none = spark.createDataFrame([], "doc_id bigint, subject string, labeller string")
    docs = spark.createDataFrame(corpus(random.Random(1), 5)[0], DOCS)
    assert subject_areas(docs, areas, none).count() == 0
    assert subject_areas(docs.limit(0), areas, none).count() == 0


def test_one_sentence_is_a_mention_in_passing():
    odds = np.array([[2.0, -1.0], [-1.0, 2.0]])
    args = lambda terms: (odds, np.zeros(len(terms), int), np.arange(len(terms)), np.zeros(len(terms), int), np.array(terms), 1)
    assert _assign(*args([0, 0, 1, 0, 0]))[1].tolist() == [0]
    assert _assign(*args([0, 0, 0, 1, 1, 1]))[1].tolist() == [0, 1]
    assert _assign(odds, *[np.zeros(0, int)] * 4, 3)[0].tolist() == []


def test_many_areas(spark):
    odds = np.full((2, 200), -1.0)
    odds[0, 150] = odds[1, 160] = 9.0
    n = 6
    assert _assign(odds, np.zeros(n, int), np.arange(n), np.zeros(n, int), np.array([0, 0, 0, 1, 1, 1]), 1)[1].tolist() == [150, 160]
    docs = spark.createDataFrame([], DOCS)
    areas = spark.createDataFrame([(f"area {i}", "") for i in range(1001)], "subject string, description string")
    with pytest.raises(ValueError, match="subject areas"):
        subject_areas(docs, areas, spark.createDataFrame([], "doc_id bigint, subject string, labeller string"))
