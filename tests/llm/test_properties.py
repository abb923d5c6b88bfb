"""Properties of the parts that need no session."""

import random
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.encodings import candidates, outside_shown, span_places
from tidemark.llm.grouped_splits import allocate
from tidemark.llm.packing import best_fit, crossover, mutate

SHARES = [Fraction(7, 10), Fraction(2, 10), Fraction(1, 10)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(1, 6), st.sampled_from("abc")), st.integers(1, 60), min_size=1, max_size=12))
def test_allocations_add_up_and_meet_quotas(bundles):
    rows = [(size, label, n) for (size, label), n in sorted(bundles.items())]
    parts = allocate(rows, SHARES)
    assert all(sum(p) == n and min(p) >= 0 for p, (_, _, n) in zip(parts, rows, strict=True))
    total = sum(size * n for size, _, n in rows)
    for k, share in enumerate(SHARES):
        assert abs(sum(size * p[k] for p, (size, _, _) in zip(parts, rows, strict=True)) - share * total) <= 6 * 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=2, max_size=60), st.integers(0, 2**32))
def test_packing_steps_lose_nothing(sizes, seed):
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    a, b = best_fit(order, sizes, 50, []), best_fit(rng.sample(order, len(order)), sizes, 50, [])
    for bins in (a, b, crossover(a, b, sizes, 50, rng), mutate(a, sizes, 50, rng)):
        assert sorted(i for x in bins for i in x) == list(range(len(sizes))) and all(sum(sizes[i] for i in x) <= 50 for x in bins)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1é–я\\verb|{}"), max_size=60))
def test_spans_partition_the_text(text):
    parts, at = [], 0
    for start, end in outside_shown(text):
        for i, j in span_places(text, start, end):
            assert at <= i < j <= len(text) and any(ch > "\x7f" for ch in text[i:j])
            parts += [text[at:i], text[i:j]]
            at = j
    assert "".join([*parts, text[at:]]) == text


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("äöüéèçłśąяжд–’"), min_size=1, max_size=8), st.sampled_from(["cp1252", "mac_roman", "cp850", "latin_1"]))
def test_utf8_read_wrongly_is_among_the_candidates(word, codec):
    try:
        bad = word.encode("utf-8").decode(codec)
    except UnicodeDecodeError:
        return
    assert any(text == word for text, _, _ in candidates(bad))
