import hypothesis.strategies as st
import numpy as np
import pyarrow as pa
from hypothesis import given, settings

from sparkloom.llm import words as W

from .helpers import words

texts = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x1c\xa0abcé中", max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 64))
def test_words_and_grams_match_a_plain_split(values, size):
    seen = {}
    row = 0
    for run in W.word_runs(pa.array(values, pa.string()), size):
        assert run.first == row
        for i in range(run.docs):
            mine = words(values[row])
            hashes = run.hashes[run.offsets[i] : run.offsets[i + 1]]
            assert len(mine) == len(hashes)
            for word, h in zip(mine, hashes, strict=True):
                assert seen.setdefault(word, h) == h
            for n in (1, 2, 3):
                start = np.arange(run.offsets[i], max(run.offsets[i], run.offsets[i + 1] - n + 1))
                for k, h in enumerate(run.grams(start, n)):
                    assert seen.setdefault(tuple(mine[k : k + n]), h) == h
            row += 1
    assert row == len(values)
    assert len(set(seen.values())) == len(seen)
