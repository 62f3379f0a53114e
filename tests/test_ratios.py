"""Ratios of many pairs at once equal SequenceMatcher's, whatever the texts."""

import random
from difflib import SequenceMatcher

from paymatch.functions import similarity as sim

rng = random.Random(11)


def text(letters, longest):
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))


def test_ratios_equal_sequence_matcher():
    pairs = [("", ""), ("", "A"), ("A", ""), ("AB", "AB"), ("\0", "\0A"), ("A" * 199, "A" * 198), ("A" * 250, "BA"), ("BA", "A" * 250)]
    for letters in ("AB", "ABCDEFGH 12", "\u00e9\u20ac\U0001F600A \0"):
        for left, right in ((10, 10), (40, 40), (2, 30), (30, 2), (230, 230)):
            some = [(text(letters, left), text(letters, right)) for _ in range(150)]
            pairs += some + [(a, a[:rng.randint(0, len(a))] + b) for a, b in some[:50]]
    assert sim.ratios(pairs) == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_lines_are_assigned_with_few_single_ratios(monkeypatch):
    # the ratio that each line asks for first is worked out with all others of a batch
    single = []
    monkeypatch.setattr(sim, "SequenceMatcher", lambda *a: single.append(a) or SequenceMatcher(*a))
    sim._SEEN.clear()
    left, right = ["RED BOLT SMALL 16 ITEM", "HOT RING LARGE 33 ITEM"], ["RED BOLT SMALL 16", "HOT RING LARGE 33"]
    row = (left, left, [1.0, 2.0], [3.0, 4.0], right, right, ["", ""], [1.0, 2.0], [3.0, 4.0])
    sim.remember(sim._likely(left, right, sim._bounded(*row)))
    assert [p for p, _ in sim.best_lines(*row, 0.25)] == [0.0, 1.0] and not single
