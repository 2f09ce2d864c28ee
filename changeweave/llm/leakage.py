"""Evaluation texts leaking into training text."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .fm_index import FMIndex
from .layout import bounded, joined, normalised, pieces

#: Least number of consecutive words that count as a passage.
PASSAGE = 12
#: Words of a phrase that is searched for exactly; a passage is looked at where two such phrases lie on one line.
PHRASE = 3
#: Items are held by every executor; more than so many characters in all are refused.
MAX_ITEM_CHARACTERS = 64_000_000
#: A short first or last sentence is an instruction if so many texts with nothing else in common share it.
SHARED_BY = 3
# What is cut off words at both ends.
PUNCTUATION = ".,;:!?\"'()[]*«»„“”‘’·&-‐¬­–—…"
# What instructions begin with, and that they speak of the item.
_TELLS = r"(?i)((please|bitte|veuillez)\s+)?(read|answer|choose|select|decide|complete|consider|lies|lest|lesen|beantworte\w*|wähle\w*|entscheide\w*|lisez|lis|lire|réponde[zs]|choisissez|complétez)\b"
_SPEAKS = r"(?i)\b(passages?|texts?|questions?|statements?|answers?|paragraphs?|abschnitte?s?|textes?|fragen?|aussagen?|antwort\w*|réponses?|énoncés?)\b"


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words in lower case without the punctuation around them, and the number of the text of each."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(text))
    owner = np.repeat(np.arange(len(text)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    words = pc.utf8_trim(pc.list_flatten(split), characters=PUNCTUATION)
    keep = pc.greater(pc.utf8_length(words), 0)
    return words.filter(keep), owner[keep.to_numpy(zero_copy_only=False)]


def _sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.?!])\s+", text)


def _template(sentence: str) -> str:
    return re.sub(r"[\"«„“][^\"»“”]*[\"»“”]", '""', sentence)


def _by_form(sentence: str) -> bool:
    """Whether a sentence at an end of an item tells the reader what to do with it, or asks about it or about a word of it."""
    speaks = bool(re.search(_SPEAKS, sentence))
    asks = sentence.rstrip().endswith("?") and len(sentence.split()) < PASSAGE and (speaks or '""' in _template(sentence))
    return asks or speaks and bool(re.match(_TELLS, sentence))


def _by_count(texts: set[str]) -> set[str]:
    """Templates of short sentences at an end of SHARED_BY texts whose middles differ: a passage under several questions, or an item under several numbers, shares its middle as well."""
    middles = defaultdict(set)
    counts: Counter = Counter()
    for text in sorted(texts):
        sentences = [_template(s) for s in _sentences(text.strip())]
        middle = set(sentences[1:-1])
        for end in {sentences[0], sentences[-1]} if middle else ():
            if len(end.split()) < PASSAGE and not middle & middles[end]:
                middles[end] |= middle
                counts[end] += 1
    return {t for t, n in counts.items() if n >= SHARED_BY}


def _without_instructions(text: str, shared: set[str]) -> str:
    """The text without the instructions at its ends; nothing is cut from within, so no words are joined that do not stand together."""
    sentences = _sentences(text.strip())
    is_one = lambda s: _template(s) in shared or _by_form(s)
    while sentences and is_one(sentences[0]):
        del sentences[0]
    while sentences and is_one(sentences[-1]):
        del sentences[-1]
    return " ".join(sentences)


@dataclass
class Items:
    """The test items: words of each without instructions, and all their phrases as symbols."""

    #: of each item the numbers under which it is kept
    ids: list[list[int]]
    words: list[list[str]]
    vocabulary: pa.Array
    #: in order, so that phrases with the same first two words stand together
    phrases: np.ndarray
    #: the first two words of phrases, each pair once and as one number, and where its phrases begin
    pairs: np.ndarray
    pair_first: np.ndarray
    #: items and places of all phrases, one phrase after the other, where each begins and how many it has
    places: np.ndarray
    place_first: np.ndarray
    place_count: np.ndarray

    def present(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of the phrases that may stand in the text: those whose first two words do.

        The text's pairs of words are looked up among the phrases', so what is
        spent depends on the text and on what it has of the items, not on the
        number of items.
        """
        here = np.unique(symbols[:-1] * self.wide + symbols[1:]) if len(symbols) > 1 else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.pairs, here), max(len(self.pairs) - 1, 0))
        found = at[self.pairs[at] == here] if len(self.pairs) else at[:0]
        first, size = self.pair_first[found], self.pair_first[found + 1] - self.pair_first[found]
        return np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)

    @property
    def wide(self) -> int:
        return len(self.vocabulary) + 2


def prepare_items(rows: list[tuple[int, str | None]]) -> Items:
    """Items without text, or with fewer words than a passage, cannot leak and are left out."""
    shared = _by_count({text for _, text in rows if text})
    numbers: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for item_id, text in rows:
        found = _words(normalised(pa.array([_without_instructions(text or "", shared)], pa.string())))[0].to_pylist()
        if item_id is not None and len(found) >= PASSAGE:
            numbers[tuple(found)].append(item_id)
    ids, words = list(numbers.values()), [list(w) for w in numbers]
    vocabulary = sorted({w for ws in words for w in ws})
    number = {w: i + 2 for i, w in enumerate(vocabulary)}  # 0 ends the text, 1 is any other word
    item = np.repeat(np.arange(len(words)), [len(ws) - PHRASE + 1 for ws in words])
    place = np.concatenate([np.arange(len(ws) - PHRASE + 1) for ws in words]) if words else np.zeros(0, np.int64)
    flat = np.array([number[w] for ws in words for w in ws], np.int64)
    begin = np.cumsum([0, *[len(ws) for ws in words]])[:-1]
    every = flat[(begin[item] + place)[:, None] + np.arange(PHRASE)] if len(item) else np.zeros((0, PHRASE), np.int64)
    order = np.lexsort(every.T[::-1])
    phrases, first, count = np.unique(every[order], axis=0, return_index=True, return_counts=True)
    pairs, pair_first = np.unique(phrases[:, 0] * (len(vocabulary) + 2) + phrases[:, 1], return_index=True)
    return Items(ids, words, pa.array(vocabulary, pa.string()), phrases, pairs, np.append(pair_first, len(phrases)), np.stack([item, place], axis=1)[order], first, count)


def _near(a: str, b: str) -> bool:
    """Whether the words differ by no more than misread letters: one edit in short words, two in longer ones."""
    if a == b:
        return True
    limit = 1 if max(len(a), len(b)) <= 5 else 2
    if abs(len(a) - len(b)) > limit:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > limit:
            return False
    return row[-1] <= limit


def _extend(item: list[str], page: list[str], i: int, j: int, by: int) -> tuple[int, int]:
    """How many words of item and page agree from (i, j) on in direction ``by``."""
    start_i, start_j = i, j

    def there(words: list[str], k: int) -> bool:
        return 0 <= k < len(words)

    def same(a: int, b: int) -> bool:
        return there(item, a) and there(page, b) and _near(item[a], page[b])

    while there(item, i) and there(page, j):
        if _near(item[i], page[j]):
            i, j = i + by, j + by
        elif there(page, j + by) and _near(item[i], page[j] + page[j + by] if by > 0 else page[j + by] + page[j]):
            i, j = i + by, j + 2 * by  # one word read as two
        elif there(item, i + by) and _near(item[i] + item[i + by] if by > 0 else item[i + by] + item[i], page[j]):
            i, j = i + 2 * by, j + by  # two words read as one
        elif len(item[i]) <= 2 and same(i + by, j) and same(i + 2 * by, j + by):
            i += by  # a short word lost in the scan
        elif len(page[j]) <= 2 and same(i, j + by) and same(i + by, j + 2 * by):
            j += by  # a speck read as a word
        else:
            break
    return abs(i - start_i), abs(j - start_j)


_SPANS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32())])


def _shard(doc_ids: pa.Array, texts: pa.Array, boxes: pa.Array, items: Items) -> pa.RecordBatch:
    """Leaked passages of the pages of one shard."""
    out: dict[str, list] = {n: [] for n in _SPANS.names}
    p = pieces(texts, boxes)
    text, page = joined(p)
    if len(text) and len(items.phrases):
        # One running text per page and flow, a line break between them.
        flow_of = p.flow
        change = np.flatnonzero((page[1:] != page[:-1]) | (flow_of[1:] != flow_of[:-1])) + 1
        starts = np.concatenate([[0], change, [len(page)]])
        lengths = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))])
        whole = pa.concat_arrays([text])
        base = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset]
        running = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer((lengths[starts] + base).astype(np.int32).tobytes()), whole.buffers()[2])
        owner = page[starts[:-1]]
        words, run = _words(running)
        code = pc.fill_null(pc.index_in(words, value_set=items.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        # Other words only part phrases: one stands for a whole stretch of them, and for the end of a text.
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 1) | (code[:-1] != 1) | (run[1:] != run[:-1])
        place = np.flatnonzero(keep)
        symbols, of = code[place], run[place]
        ends = np.flatnonzero(of[1:] != of[:-1]) + 1
        symbols, place, of = np.insert(symbols, ends, 1), np.insert(place, ends, -1), np.insert(of, ends, -1)
        index = FMIndex(symbols, len(items.vocabulary) + 1)
        asked = items.present(symbols)
        low, high = index.search(items.phrases[asked])
        some = high > low
        found, low, number = asked[some], low[some], (high - low)[some]
        rows = np.repeat(low, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        at = index.locate(rows)
        # Every item and place at which the phrase stands.
        per_hit = np.repeat(items.place_count[found], number)
        hit = np.repeat(np.arange(len(at)), per_hit)
        inner = np.arange(len(hit)) - np.repeat(np.cumsum(per_hit) - per_hit, per_hit)
        item, k = items.places[np.repeat(np.repeat(items.place_first[found], number), per_hit) + inner].T
        word = place[at[hit]]
        line = word - k
        order = np.lexsort((word, line, item, run[word]))
        item, k, word, line = item[order], k[order], word[order], line[order]
        where = run[word]
        # Two phrases nearly on one line, that is of one stretch of the item.
        close = np.zeros(len(word), bool)
        pair = (item[1:] == item[:-1]) & (where[1:] == where[:-1]) & (line[1:] - line[:-1] <= 2)
        close[1:] |= pair
        close[:-1] |= pair
        first_word = np.searchsorted(run, np.arange(len(running) + 1))
        cached: dict[int, list[str]] = {}
        covered: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for h in np.flatnonzero(close):
            r, i, kk, w = int(where[h]), int(item[h]), int(k[h]), int(word[h])
            a, b = int(first_word[r]), int(first_word[r + 1])
            j = w - a
            if any(s <= j < e for s, e in covered[r, i]):
                continue
            if r not in cached:
                cached[r] = words.slice(a, b - a).to_pylist()
            ahead_i, ahead_j = _extend(items.words[i], cached[r], kk, j, 1)
            back_i, back_j = _extend(items.words[i], cached[r], kk - 1, j - 1, -1)
            covered[r, i].append((j - back_j, j + ahead_j))
            if ahead_i + back_i >= PASSAGE:
                base_word = a - int(first_word[np.searchsorted(owner, owner[r])])
                for item_id in items.ids[i]:
                    for n, v in zip(_SPANS.names, (int(owner[r]), item_id, base_word + j - back_j, base_word + j + ahead_j - 1)):
                        out[n].append(v)
    made = {n: pa.array(v, _SPANS.field(n).type) for n, v in out.items()}
    made["doc_id"] = doc_ids.take(made["doc_id"])
    return pa.RecordBatch.from_pydict(made, schema=_SPANS)


def leaked_spans(documents: DataFrame, test_items: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, last_word of each leaked passage, in words of the page's reading order.

    Each Arrow batch of pages (at most some 48 MB of text) is a shard with an FM-index of its own over word
    symbols; all phrases of three words of all items are searched backward in
    it together, and where two of them lie on one line of an item, the passage
    is followed word by word, misread letters allowed.  Whole pages are
    indexed, and no shard depends on another, so nothing is shuffled.

    The items go to all executors; their size is checked.  Defined cases:
    pages with NULL or empty text and items with NULL, empty or short text
    have no passage; a page scanned twice leaks twice; an item that leaks
    twice into a page gives two spans.
    """
    total = test_items.select(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    if total > MAX_ITEM_CHARACTERS:
        raise ValueError(f"test items have {total} characters; at most {MAX_ITEM_CHARACTERS} are held by every executor")
    spark = documents.sparkSession
    items = spark.sparkContext.broadcast(prepare_items([tuple(r) for r in test_items.select("item_id", "item_text").distinct().collect()]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield _shard(batch.column("doc_id"), batch.column("text"), batch.column("line_boxes"), items.value)

    return documents.select("doc_id", "text", "line_boxes").mapInArrow(search, "doc_id bigint, item_id bigint, first_word int, last_word int")


def leaked_items(documents: DataFrame, test_items: DataFrame) -> DataFrame:
    """doc_id and item_id of each page with a passage of an item, once."""
    return leaked_spans(documents, test_items).select("doc_id", "item_id").distinct()


def removal_spans(spans: DataFrame) -> DataFrame:
    """Spans of words to remove from each page: those of all items, merged where they overlap or touch."""
    ordered = F.array_sort(F.collect_set(F.struct("first_word", "last_word")))
    empty = F.array().cast("array<struct<first_word:int,last_word:int>>")

    def merge(done, span):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first_word"].alias("first_word"), F.greatest(last["last_word"], span["last_word"]).alias("last_word"))))
        return F.when(F.size(done) == 0, F.array(span)).when(span["first_word"] <= last["last_word"] + 1, longer).otherwise(F.concat(done, F.array(span)))

    merged = spans.groupBy("doc_id").agg(ordered.alias("spans")).select("doc_id", F.explode(F.aggregate("spans", empty, merge)).alias("span"))
    return merged.select("doc_id", "span.first_word", "span.last_word")
