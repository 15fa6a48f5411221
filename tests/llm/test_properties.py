"""Properties that hold for any text."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestat.llm import bpe, lookalike, packing, sentences

TEXTS = st.text(st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(list("aA. !?\n\"“”„«»()[]1。？」「กข;"))), max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_units_are_ordered_and_cover(text):
    at = 0
    for a, b in sentences.split_units(text):
        assert at <= a < b <= len(text) and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_visible_forms_are_stable(text):
    form = lookalike.visible_form(text)
    assert lookalike.visible_form(form) == form


@pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZERS), reason="the public vocabularies are not here")
@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_tokens_decode_to_their_text(text):
    e = bpe.encoder()
    ids = np.array(e.encode(text), dtype=np.int64)
    assert bpe.decode_lists(ids, np.array([0, len(ids)]), *e.decoder()) == [text]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(40, 80))
def test_containers_hold_all_and_are_filled(sizes, capacity):
    at = packing.best_two_fit(np.array(sizes, dtype=np.int64), capacity)
    loads = np.bincount(at, weights=sizes) if sizes else np.zeros(1)
    assert loads.max() <= capacity
    used = loads[loads > 0]
    assert len(used) <= 2 * -(-sum(sizes) // capacity)
