"""Whole-text distances by the bits of long numbers, against tables filled cell by cell."""

import random

import pytest

from pairlens.operators import fuzzy as Z


def _table(s, t):
    """`(lcs, edits)` by the textbook recurrences."""
    lcs, edits = [0] * (len(t) + 1), list(range(len(t) + 1))
    for i, a in enumerate(s, 1):
        row, line = [0], [i]
        for j, b in enumerate(t, 1):
            row.append(lcs[j - 1] + 1 if a == b else max(lcs[j], row[-1]))
            line.append(min(edits[j - 1] + (a != b), edits[j] + 1, line[-1] + 1))
        lcs, edits = row, line
    return lcs[-1], edits[-1]


@pytest.mark.parametrize("long_text, steps", [(1_000, 512), (0, 1), (5, 7), (10_000, 3)])
def test_distances_do_not_depend_on_where_numbers_are_cut(monkeypatch, long_text, steps):
    monkeypatch.setattr(Z, "LONG_TEXT", long_text)
    monkeypatch.setattr(Z, "UNMASKED_STEPS", steps)
    rng = random.Random(steps)
    for _ in range(150):
        letters = rng.choice(["ab", "abcdefgh", "aé漢🙂 "])
        s, t = ("".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(2))
        assert (Z.lcs_length(s, t), Z.edit_distance(s, t)) == _table(s, t)


def test_long_texts_are_exact():
    rng = random.Random(3)
    s, t = ("".join(rng.choices("abcdé ", k=k)) for k in (1_400, 1_100))
    assert (Z.lcs_length(s, t), Z.edit_distance(s, t)) == _table(s, t)
    assert (Z.lcs_length(t, s), Z.edit_distance(t, s)) == _table(s, t)
