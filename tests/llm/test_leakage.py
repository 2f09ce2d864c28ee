import numpy as np
import pytest

from changeweave.llm.fm_index import FMIndex, WaveletMatrix, suffix_array
from changeweave.llm.leakage import leaked_items, leaked_spans, prepare_items, removal_spans

ITEM = "The harbour at Nolford kept eleven lanterns and the baker of Wenby counted each of them twice before the morning bell was rung by Tamsin Orlo"
DOCS = "doc_id bigint, text string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:int>>"
ITEMS = "item_id bigint, suite string, lang string, item_text string"


@pytest.mark.parametrize("n", [1, 2, 17, 400])
def test_suffix_order_and_search(n):
    rng = np.random.default_rng(n)
    text = rng.integers(1, 4, n)
    whole = [*text.tolist(), 0]
    assert suffix_array(np.array(whole)).tolist() == sorted(range(n + 1), key=lambda i: whole[i:])
    index = FMIndex(text, 4)
    assert sorted(index.locate(np.arange(n + 1)).tolist()) == list(range(n + 1))
    for phrase in ([1], [2, 3], [3, 3, 1], [4]):
        low, high = index.search(np.array([phrase]))
        found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert found == [i for i in range(n - len(phrase) + 1) if text[i : i + len(phrase)].tolist() == phrase]


def test_all_equal():
    assert suffix_array(np.array([1] * 300 + [0])).tolist() == list(range(300, -1, -1))


def test_wavelet_matrix():
    values = np.random.default_rng(0).integers(0, 50, 500)
    matrix = WaveletMatrix(values, 6)
    at = np.arange(500)
    assert (matrix.rank(values, at) == [int((values[:i] == values[i]).sum()) for i in at]).all()
    symbol, before = matrix.step(at)
    assert (symbol == values).all() and (before == matrix.rank(values, at)).all()


def page(spark, texts):
    rows = []
    for i, lines in enumerate(texts, 1):
        text = None if lines is None else "\n".join(t for t, *_ in lines)
        rows.append((i, text, None if lines is None else [(x, y, x + 11 * len(t), y + 20, 80) for t, x, y in lines]))
    return spark.createDataFrame(rows, DOCS)


def column(text, x=50, y=100, width=30):
    words, lines, line = text.split(), [], ""
    for w in words:
        if len(line) + len(w) > width:
            lines.append(line.strip())
            line = ""
        line += w + " "
    return [(t, x, y + 25 * i) for i, t in enumerate([*lines, line.strip()])]


def test_passages(spark):
    words = ITEM.split()
    exact, short, wrong = " ".join(words[3:18]), " ".join(words[3:14]), " ".join(reversed(words))
    damaged = exact.replace("lanterns", "lantems").replace("baker", "b.ker").replace("counted", "countedd")
    filler = "Nothing of note was heard in the square that day and nobody asked why"
    across = column(filler + " " + " ".join(words[:9]), 50) + column(" ".join(words[9:20]) + " " + filler, 500)
    advert = column(filler + " " + " ".join(words[2:10]), 50)
    below = advert[-1][2] + 25
    advert += [("BEST LAMPS at Orel & Sons.", 80, below)] + [(t, x, y + below - 75) for t, x, y in column(" ".join(words[10:20]), 50)]
    docs = page(spark, [column(f"{filler} {exact} {filler}"), column(f"{filler} {short} {filler}"), column(wrong), column(f"{filler} {damaged.upper()} {filler}"), across, advert, None, [("", 0, 0)]])
    items = spark.createDataFrame([(7, "a", "en", ITEM), (8, "a", "en", None), (9, "a", "en", "too short")], ITEMS)
    assert sorted(tuple(r) for r in leaked_items(docs, items).collect()) == [(d, 7) for d in (1, 4, 5, 6)]
    spans = {r.doc_id: (r.first_word, r.last_word) for r in leaked_spans(docs, items).collect()}
    assert spans[1][1] - spans[1][0] + 1 == 15


def test_instructions_alone_are_no_case(spark):
    head = "Read the following long passage with great care and then answer every single question about it below."
    items = spark.createDataFrame([(i, "a", "en", f"{head} {ITEM.replace('Nolford', name)}") for i, name in enumerate(["Ab", "Cd", "Ef", "Gh"])], ITEMS)
    assert leaked_items(page(spark, [column(head)]), items).count() == 0


def test_shared_passages_are_no_instructions(spark):
    """One passage under three questions, and one item under four numbers; an instruction that stands in one item only."""
    second = "Nobody at Wenby had asked for lanterns so the eleven were sold to a sailor from Orel within the week."
    questions = ["Who counted them?", "Where did the baker live?", "Which of these statements agrees with the text?"]
    rows = [(i, f"{ITEM}. {second} {q}") for i, q in enumerate(questions)] + [(i, f"{second.replace('Wenby', 'Tamstead')} {ITEM.replace('Nolford', 'Ab')}.") for i in range(10, 14)]
    alone = "Please read the short passage on the next page and then choose one of the four answers below it."
    rows.append((20, f"{alone} A widow at Kaville gave seven violins to the clerk of Ulau and he sold every one of them at noon."))
    items = spark.createDataFrame([(i, "a", "en", t) for i, t in rows], ITEMS)
    found = {tuple(r) for r in leaked_items(page(spark, [column(second), column(second.replace("Wenby", "Tamstead")), column(alone)]), items).collect()}
    assert {(1, 0), (1, 1), (1, 2), (2, 10), (2, 11), (2, 12), (2, 13)} <= found
    assert not {d for d, _ in found} - {1, 2}


def test_empty_tables(spark):
    docs, items = page(spark, [column(ITEM)]), spark.createDataFrame([(1, "a", "en", ITEM)], ITEMS)
    assert leaked_items(docs.limit(0), items).count() == 0
    assert leaked_items(docs, items.limit(0)).count() == 0


def test_merged_spans(spark):
    spans = spark.createDataFrame([(1, 1, 5, 9), (1, 2, 8, 12), (1, 3, 13, 14), (1, 3, 20, 25), (2, 1, 0, 3), (2, 1, 0, 3)], "doc_id bigint, item_id bigint, first_word int, last_word int")
    assert sorted(tuple(r) for r in removal_spans(spans).collect()) == [(1, 5, 14), (1, 20, 25), (2, 0, 3)]


def test_against_direct_search(spark):
    """Every page of the smallest tables: pages with 12 words of an item in a row, letter by letter, are all found."""
    folder = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/test_items.parquet")
    found = {tuple(r) for r in leaked_items(docs, items).collect()}
    import re

    def words(text):
        text = re.sub(r"[-‐¬­]\r?\n", "", text or "")
        return [w for w in (x.strip(".,;:!?\"'()*«»").lower() for x in text.split()) if w]

    runs = {}
    for i in items.collect():
        ws = words(i.item_text)
        for k in range(len(ws) - 11):
            runs.setdefault(tuple(ws[k : k + 12]), set()).add(i.item_id)
    direct = set()
    for d in docs.collect():
        ws = words(d.text)
        for k in range(len(ws) - 11):
            direct |= {(d.doc_id, i) for i in runs.get(tuple(ws[k : k + 12]), ())}
    assert direct <= found


def test_recall_by_damage(spark):
    """Passages of 12 to 24 words with so many of their words misread by one letter: share that is found."""
    rng = np.random.default_rng(4)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 5)))
    filler = [word() for _ in range(300)]
    items = [" ".join(word() for _ in range(40)) for _ in range(150)]
    table = spark.createDataFrame([(i, "a", "en", t) for i, t in enumerate(items)], ITEMS)
    for rate, least in ((0.0, 1.0), (0.1, 0.97), (0.2, 0.95), (0.3, 0.8)):
        pages = []
        for text in items:
            n = int(rng.integers(12, 25))
            words = text.split()[5 : 5 + n]
            for k in range(n):
                if rng.random() < rate:
                    at = int(rng.integers(len(words[k])))
                    words[k] = words[k][:at] + str(rng.choice(list("aeiournm"))) + words[k][at + 1 :]
            around = list(rng.choice(filler, 30))
            pages.append(column(" ".join(around[:15] + words + around[15:])))
        found = {tuple(r) for r in leaked_items(page(spark, pages), table).collect()}
        assert {(i + 1, i) for i in range(150)} >= found
        assert len(found) >= least * 150, (rate, len(found))


def test_phrases_that_are_asked():
    items = prepare_items([(i, " ".join(f"w{i}x{k}" for k in range(14))) for i in range(50)])
    vocabulary = items.vocabulary.to_pylist()
    code = lambda w: vocabulary.index(w) + 2
    text = np.array([1, code("w3x4"), code("w3x5"), code("w3x6"), 1, code("w7x1"), code("w7x2")])
    assert sorted(tuple(p) for p in items.phrases[items.present(text)]) == sorted(tuple(code(f"w{i}x{k + j}") for j in range(3)) for i, k in ((3, 4), (3, 5), (7, 1)))
    assert not len(items.present(text[:1])) and not len(prepare_items([]).present(text))
