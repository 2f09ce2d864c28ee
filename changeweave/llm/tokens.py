"""Encoding of texts by a public byte-level BPE tokenizer, for whole Arrow batches.

Pre-tokenisation knows no regular expression: every character gets a class,
and where a slice begins follows from the classes around it and from a scan.
The automaton behind the pattern has only transition functions that either
keep the state or set it anew, whatever it was; such functions compose to the
last one that sets, so their associative scan is a running maximum over the
places where the state is set.  The slices are views into the text; each
distinct slice is merged once, all new ones of a batch together, and kept.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .layout import bounded

#: Folder of the vocabulary files; a parameter of every function here.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Distinct slices that a worker keeps; beyond that it starts afresh.
CACHE_SLICES = 1_000_000
#: Longer slices are merged one by one with a heap.
LONG_SLICE = 200

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# White space of the pattern, and the contractions it splits off.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHORT = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point."""
    classes = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            classes[point] = LETTER
        elif kind == "N":
            classes[point] = NUMBER
    classes[_WHITE] = SPACE
    return classes


def slice_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Whether a slice begins at each character; no slice goes over the start of a text."""
    n = len(points)
    kind = character_classes()[points]
    place = np.arange(n)
    begins = np.zeros(n, bool)
    begins[text_starts[text_starts < n]] = True
    run = begins.copy()
    run[1:] |= kind[1:] != kind[:-1]
    # Scan: the place where the state was last set, that is where the run of each character began.
    run_start = np.maximum.accumulate(np.where(run, place, 0))
    ends = np.ones(n, bool)
    ends[:-1] = run[1:]
    text_end = np.ones(n, bool)
    text_end[:-1] = begins[1:]
    starts = run.copy()
    # The last white space before a word stands apart from the others; a blank joins the word.
    last_white = (kind == SPACE) & ends & ~text_end
    starts |= last_white
    blank = last_white & (points == 32)
    joins = np.zeros(n, bool)
    joins[1:] = blank[:-1]
    starts &= ~joins
    # An apostrophe that begins a slice takes the short ending after it along.
    quote = np.flatnonzero((points == 39) & (run_start == place) & ~joins)
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        fence = np.concatenate([begins, np.ones(3, bool)])
        taken = np.zeros(len(quote), np.int64)
        for short in _SHORT:
            fits = np.ones(len(quote), bool)
            for i, c in enumerate(short):
                at = quote + 1 + i
                fits &= (padded[at] == ord(c)) & ~fence[at]
            taken = np.where((taken == 0) & fits, len(short), taken)
        quote, taken = quote[taken > 0], taken[taken > 0]
        starts[quote + 1] = False
        after = quote + 1 + taken
        starts[after[after < n]] = True
        # What follows is a slice of its own, unless a blank or the end stands there, which begin one anyway.
    return starts


class Vocabulary:
    """Merges of a byte-level BPE vocabulary, as sorted arrays."""

    def __init__(self, name: str = NAME, folder: str = VOCABULARIES):
        model = json.load(open(f"{folder}/{name}.json", encoding="utf-8"))["model"]
        ids = model["vocab"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in visible)}
        self.byte_ids = np.array([ids[shown[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([ids[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        key = (left << 20) | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        self.never = len(pairs)
        back = {c: b for b, c in shown.items()}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in ids.items() if all(c in back for c in t)}

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``never`` if it does not merge) and what it becomes."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], self.never), self.made[at]

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))

    def merge_long(self, data: bytes) -> list[int]:
        """One long slice, by a heap of its pairs."""
        ids = self.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        following, previous, dead = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        pairs = self.pairs
        heap = [(*p[:1], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = following[i]
            if dead[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], dead[j] = new, True
            following[i] = following[j]
            if following[j] < n:
                previous[following[j]] = i
            for left in (previous[i], i):
                right = following[left] if left >= 0 else n
                if left >= 0 and right < n and (p := pairs.get(ids[left] << 20 | ids[right])):
                    heapq.heappush(heap, (p[0], left, ids[left], ids[right], p[1]))
        return [x for x, d in zip(ids, dead) if not d]

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many slices at once: each round merges, in every slice, its leftmost pair of least rank.

        ``data`` has the slices' bytes one after the other; slices are not
        empty.  Returns all ids one after the other, and their number by slice.
        """
        symbol = self.byte_ids[data]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(symbol))

        def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            other = np.minimum(at + 1, len(symbol) - 1)
            r, m = self.rank(symbol[at], symbol[other])
            return np.where((at + 1 < len(symbol)) & (owner[at] == owner[other]), r, self.never), m

        rank, made = ranked(place)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.concatenate([first, [len(symbol)]]))
            least_of = np.repeat(least, size)
            finished = least_of == self.never
            if finished.any():
                done.append((owner[finished], symbol[finished]))
                keep = ~finished
                symbol, owner, rank, made, least_of = symbol[keep], owner[keep], rank[keep], made[keep], least_of[keep]
                if not len(symbol):
                    break
            hits = np.flatnonzero(rank == least_of)
            hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
            symbol[hits] = made[hits]
            keep = np.ones(len(symbol), bool)
            keep[hits + 1] = False
            moved = np.cumsum(keep) - 1
            symbol, owner, rank, made = symbol[keep], owner[keep], rank[keep], made[keep]
            at = moved[hits]
            before = at[at > 0] - 1
            for changed in (at, before):
                rank[changed], made[changed] = ranked(changed)
        owners = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
        symbols = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        return symbols[order], np.bincount(owners, minlength=len(lengths))


class Encoder:
    """Encodes batches of texts; distinct slices are merged once and kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def _numbers(self, slices: pa.Array) -> np.ndarray:
        """Number of each of the distinct slices in the cache, new ones merged all together."""
        keys = slices.to_pylist()
        if len(self.number) + len(keys) > CACHE_SLICES:
            self._forget()
        new = [k for k in keys if k not in self.number]
        if new:
            short = [k for k in new if len(k) <= LONG_SLICE]
            ids, counts = self.vocabulary.merge(np.frombuffer(b"".join(short), np.uint8), np.array([len(k) for k in short], np.int64)) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            long = [(k, self.vocabulary.merge_long(k)) for k in new if len(k) > LONG_SLICE]
            self.number.update(zip([*short, *[k for k, _ in long]], range(len(self.number), len(self.number) + len(new))))
            self.ids = np.concatenate([self.ids, ids, *[np.array(v, np.int64) for _, v in long]])
            ends = np.cumsum(np.concatenate([counts, np.array([len(v) for _, v in long], np.int64)]))
            self.first = np.concatenate([self.first, self.first[-1] + ends])
        return np.array([self.number[k] for k in keys], np.int64)

    def encode(self, texts: pa.Array, with_offsets: bool = False) -> tuple[pa.Array, pa.Array | None]:
        """Ids of each text; with offsets also, for each id, the byte at which its slice begins in the text."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = pa.concat_arrays([texts.cast(pa.string()).fill_null("")])
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
        if len(data):
            points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            byte_of = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
            starts = byte_of[slice_starts(points, np.searchsorted(byte_of, offsets[:-1]))]
            slices = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
            number = self._numbers(slices.dictionary)[slices.indices.to_numpy(zero_copy_only=False)]
        else:
            starts, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = self.first[number + 1] - self.first[number]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.first[number] - total[:-1], size) + np.arange(total[-1])]
        bounds = pa.array(total[np.searchsorted(starts, offsets)], pa.int32())
        made = pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32()))
        if not with_offsets:
            return made, None
        text_of = np.searchsorted(offsets, starts, side="right") - 1
        return made, pa.ListArray.from_arrays(bounds, pa.array(np.repeat(starts - offsets[text_of], size), pa.int32()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(name: str = NAME, folder: str = VOCABULARIES) -> Encoder:
    """The encoder of this worker, with what it has kept."""
    if (name, folder) not in _encoders:
        _encoders[name, folder] = Encoder(Vocabulary(name, folder))
    return _encoders[name, folder]


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    return b"".join(vocabulary.bytes_of[i] for i in ids).decode("utf-8", errors="replace")


def encode_documents(documents: DataFrame, name: str = NAME, folder: str = VOCABULARIES, with_offsets: bool = False) -> DataFrame:
    """doc_id and ids of every document, and ``offsets`` if asked for.

    No special tokens are added, and their strings in a text are ordinary
    text.  NULL and empty texts give an empty list; repeated rows repeated
    rows.  Documents are not shuffled, and each is encoded whole.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name, folder)
        for batch in bounded(batches):
            ids, offsets = own.encode(batch.column("text"), with_offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, *([offsets] if with_offsets else [])], names=["doc_id", "ids", *(["offsets"] if with_offsets else [])])

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>" + (", offsets array<int>" if with_offsets else ""))
