import numpy as np
import pyarrow as pa
from conftest_llm import words
from hypothesis import given, settings, strategies as st

from vigil.llm import kit

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b漢 ", max_size=30)), min_size=1, max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    data, offsets = kit.texts(pa.chunked_array([pa.array(texts, pa.string())]))
    start, end, first = kit.words(data, offsets)
    raw = data.tobytes()
    got = [[raw[start[i]: end[i]].decode() for i in range(a, b)] for a, b in zip(first, first[1:])]
    assert got == [words(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_equal_words_and_windows_have_equal_hashes(texts):
    data, offsets = kit.texts(pa.chunked_array([pa.array(texts, pa.string())]))
    start, end, first = kit.words(data, offsets)
    hashes, raw = kit.word_hashes(data, start, end), data.tobytes()
    assert len(set(hashes.tolist())) == len({raw[a:b] for a, b in zip(start, end)})
    sums = kit.prefix(hashes)
    at = np.arange(max(len(start) - 1, 0))
    pairs = kit.span(sums, at, at + 2)
    assert len(set(pairs.tolist())) == len({(hashes[i], hashes[i + 1]) for i in at})


def test_packed_arrays_come_back():
    arrays = [np.array([1, 5, 2**63], np.uint64), np.zeros(0, np.uint8), np.array([-3, 7], np.int64), np.array([1.5], np.float32)]
    for a, b in zip(arrays, kit.unpack(kit.pack(*arrays))):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()
    keys = np.array([0, 3, 2**64 - 1], np.uint64)
    assert kit.ungaps(kit.gaps(keys)).tolist() == keys.tolist()


def test_slices_take_all_rows_and_long_ones_alone():
    offsets = np.array([0, 3, 3, 50, 51, 51])
    assert list(kit.slices(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]
