import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from changeweave.llm.tokens import NAME, VOCABULARIES, Vocabulary, decode, encode_documents, encoder

TEXTS = [None, "", "it's don't 're  'sabc ''s x's's 'S", "\n\n a\n b \t c  \n", "  ", "<|endoftext|> x", "'", " 's", "é ß １２ ½ 漢字 😀", " " * 50 + "a", "=" * 900 + "x" * 700, "a 'll", "\r\nx", "\x00​﻿"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(f"{VOCABULARIES}/{NAME}.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_same_ids_as_the_tokenizer(reference):
    assert encoder().encode(pa.array(TEXTS, pa.string()))[0].to_pylist() == reference(TEXTS)


def test_random_texts(reference):
    rng = random.Random(1)
    letters = "ab'sretvlmd  \n\t1½é漢😀.,-!​́S'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert encoder().encode(pa.array(texts))[0].to_pylist() == reference(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_round_trip(texts):
    ids, offsets = encoder().encode(pa.array(texts, pa.string()), with_offsets=True)
    vocabulary = encoder().vocabulary
    assert [decode(i, vocabulary) for i in ids.to_pylist()] == texts
    for text, o in zip(texts, offsets.to_pylist()):
        assert o == sorted(o) and all(x < max(1, len(text.encode())) for x in o)


def test_sliced_arrays(reference):
    array = pa.array(["skip", "hello world", None, "x"]).slice(1)
    assert encoder().encode(array)[0].to_pylist() == reference(["hello world", None, "x"])


def test_documents(spark, reference):
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (2, None, 7), (3, "", 7), (None, "c", 7)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id or 0, r.ids) for r in encode_documents(df).collect())
    assert got == [(0, reference(["c"])[0]), (1, reference(["a b"])[0]), (1, reference(["a b"])[0]), (2, []), (3, [])]
    assert encode_documents(df.limit(0)).count() == 0


def test_long_slice_merges_like_short_ones():
    v = Vocabulary()
    for data in (b"a" * 300, b"hello" * 60, bytes(range(97, 123)) * 20):
        import numpy as np

        assert v.merge_long(data) == v.merge(np.frombuffer(data, np.uint8), np.array([len(data)]))[0].tolist()
