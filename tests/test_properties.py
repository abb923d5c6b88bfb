"""Properties of the parts that need no session."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.known import versions
from tidemark.sources.digest import value_bytes

interval = st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(0, 30), st.integers(0, 5))


@settings(max_examples=200, deadline=None)
@given(st.lists(interval, max_size=12))
def test_versions_hold_what_is_in_force(intervals):
    unit, begin, end = ([x[i] for x in intervals] for i in range(3))
    rank = [(x[3], n) for n, x in enumerate(intervals)]
    found = list(zip(*versions(unit, begin, end, rank), strict=True))
    for u in range(4):
        mine = [(at, w) for v, at, w in found if v == u]
        assert [at for at, _ in mine] == sorted({at for at, _ in mine})
        for t in range(-1, 32):
            now = [w for at, w in mine if at <= t]
            holding = [i for i in range(len(intervals)) if unit[i] == u and begin[i] <= t < end[i]]
            assert (now[-1] if now else None) == (max(holding, key=rank.__getitem__) if holding else None)


WORDS = st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), min_size=1, max_size=6)


@given(WORDS, st.data())
def test_a_cut_elsewhere_gives_other_bytes(words, data):
    """The same characters divided into words in another way are told apart, since each word's length goes before it."""
    whole, n = "".join(words), len(words)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(whole)), min_size=n - 1, max_size=n - 1)))
    other = [whole[i:j] for i, j in zip([0, *cuts], [*cuts, len(whole)], strict=True)]
    of = lambda values: b"".join(value_bytes(v, "string") for v in values)
    assert (of(words) == of(other)) == (words == other)
    assert len(of(words)) == 8 * n + len(whole.encode("utf-8"))
