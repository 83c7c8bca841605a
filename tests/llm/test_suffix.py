"""Suffix arrays and permuted common prefixes against their definitions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm.suffix import classify, common_prefixes, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=80).map(str.encode), st.text("abc", min_size=1, max_size=8).map(lambda s: s.encode() * 9)))
def test_suffix_array(b):
    data = np.frombuffer(b, np.uint8)
    want = sorted(range(len(b)), key=lambda i: b[i:])
    sa = suffix_array(data)
    assert sa.tolist() == want
    plcp, phi = common_prefixes(data, sa)
    for r, i in enumerate(want):
        j = want[r - 1] if r else None
        n = 0
        while j is not None and i + n < len(b) and j + n < len(b) and b[i + n] == b[j + n]:
            n += 1
        assert plcp[i] == n and phi[i] == (-1 if j is None else j)


def test_types():
    text = np.array([3, 2, 2, 3, 1, 0], np.int16)
    assert classify(text).tolist() == [False, True, True, False, False, True]
