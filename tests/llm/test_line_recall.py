"""How many lines that are just similar enough meet in a band."""

import random

import numpy as np

from quillon.llm import linededup


def test_lines_at_the_threshold_meet():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    lines, pairs = [], []
    while len(pairs) < 4000:
        shared, tail = word() + word() + word(), rng.randrange(20, 31)
        left, right = shared + word()[:tail], shared + word()[:tail]
        x, y = linededup._set(left), linededup._set(right)
        both = len(np.intersect1d(x, y))
        if 75 <= 100 * both / (len(x) + len(y) - both) < 77:
            pairs.append((len(lines), len(lines) + 1))
            lines += [left, right]
    keys = linededup.line_keys(lines)
    met = sum(bool((keys[l] == keys[r]).any()) for l, r in pairs)
    assert met >= 0.998 * len(pairs)


def test_recall_at_the_threshold():
    assert 1 - (1 - (linededup.PERCENT / 100) ** linededup.ROWS) ** linededup.BANDS >= 0.999
