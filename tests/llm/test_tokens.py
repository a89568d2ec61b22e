import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from polyad.llm.tokens import PATTERN, TokenizedText, count_corpus, encode_corpus, encoder, read_ranks

NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k")
HARD = ["", " ", "\n \n\t x", "it's we'll 'll'", "<|endoftext|> a <|x", "aaaaaaaaaaaaaaaaab", "日本語のテキスト、ひらがな。カタカナー", "ﬁ​﻿\x1c\x85a", "  　  z", "ÀÉ" * 50, "x" * 3000, "абв где", "1234567 89%$#@!!!!!!!", "🙂🙃👩‍👩‍👧"]


def reference(name):
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=read_ranks(name), special_tokens={})


@pytest.mark.parametrize("name", NAMES)
def test_hard_texts(name):
    want = reference(name)
    for text in HARD:
        assert encoder(name).encode(text) == want.encode_ordinary(text)
        assert encoder(name).count(text) == len(want.encode_ordinary(text))


@settings(max_examples=40, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from("ab 'lst\nあ一")), max_size=60))
def test_any_text(text):
    for name in NAMES:
        assert encoder(name).encode(text) == reference_of(name).encode_ordinary(text)


_made = {}


def reference_of(name):
    return _made.setdefault(name, reference(name))


def test_every_prefix_has_its_own_encoding():
    vocabulary, want = encoder(NAMES[0]).vocabulary, reference_of(NAMES[0])
    data = " internationalization"
    last = []
    vocabulary.extend(data.encode(), last)
    for k in range(1, len(data) + 1):
        assert vocabulary.back(last[:k]) == want.encode_ordinary(data[:k])


def test_edits_and_appends():
    rng, want = random.Random(5), reference_of(NAMES[0])
    bits = ["the ", "don", "'", "ll", "l", " ", "\n", "  x", "cat", "日本", "12", "!!", "s"]
    state = TokenizedText(encoder(NAMES[0]), "")
    for _ in range(400):
        a = rng.randint(0, len(state.text))
        b = min(len(state.text), a + rng.choice([0, 0, 1, 3]))
        state.edit(a, b, "".join(rng.choices(bits, k=rng.randint(0, 3))))
        assert state.ids() == want.encode_ordinary(state.text)
        state.append(rng.choice(bits))
        assert state.ids() == want.encode_ordinary(state.text)


def test_an_edit_redoes_only_its_surroundings():
    state = TokenizedText(encoder(NAMES[0]), "some words here " * 1000)
    state.edit(8000, 8001, "q")
    assert state.redone < 60
    assert state.ids() == reference_of(NAMES[0]).encode_ordinary(state.text)


def test_corpus(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", None), (None, "a", "x"), (1, "hello world", "x"), (4, " \t", "x"), (5, "ab " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_corpus(df).collect()), key=str)
    want = reference_of(NAMES[0])
    assert got == sorted(((i, want.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    counts = sorted(((r.doc_id, r.n_tokens) for r in count_corpus(df).collect()), key=str)
    assert counts == sorted(((i, len(want.encode_ordinary(t or ""))) for i, t, _ in rows), key=str)
    assert encode_corpus(df.limit(0)).collect() == []
