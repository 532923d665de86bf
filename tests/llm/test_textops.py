import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.textops import Scanner, distinct, shingle_hashes, text_slices
from tests.llm.helpers import shingles, words

TEXTS = st.lists(
    st.one_of(st.none(), st.text("aAzZ bé\t\n\x0b\x1c漢", max_size=30)), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 20))
def test_words_and_shingles_match_plain_python(texts, limit):
    scanner, seen = Scanner(), {}
    found = []
    for low, high, data, offsets in text_slices(pa.array(texts, pa.string()), limit):
        hashes, bounds = scanner.words(data, offsets)
        values, edges = distinct(*shingle_hashes(hashes, bounds, 2))
        for i in range(high - low):
            found.append((hashes[bounds[i] : bounds[i + 1]].tolist(), int(np.diff(edges)[i]),
                          frozenset(values[edges[i] : edges[i + 1]].tolist())))
    assert len(found) == len(texts)
    by_set = {}
    for text, (hashes, n, values) in zip(texts, found, strict=True):
        assert len(hashes) == len(words(text))
        for word, value in zip(words(text), hashes, strict=True):
            assert seen.setdefault(word, value) == value
        assert n == len(shingles(text, 2)) == len(values)
        assert by_set.setdefault(shingles(text, 2), values) == values
    assert len(set(seen.values())) == len(seen)
    assert len(set(by_set.values())) == len(by_set)


def test_slices_keep_long_texts_whole():
    texts = ["a" * 10, "b" * 5000, "", "c"]
    parts = list(text_slices(pa.array(texts), 64))
    assert [p[:2] for p in parts][-1][1] == 4
    assert b"".join(p[2].tobytes() for p in parts).decode() == "".join(texts)
