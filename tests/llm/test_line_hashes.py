"""Band keys of lines: each hash of a shingle gives the least and the greatest value of a line, and texts are hashed a piece at a time."""

import random

import numpy as np
import pytest

from quillon.llm import linededup, minhash


def lines_of(rng, n):
    return ["a", "sevenup", "\ud800 surrogate"] + ["".join(rng.choices("abcdé ", k=rng.randint(1, 300))) for _ in range(n)]


def test_a_hash_function_serves_two_hashes_of_a_line(monkeypatch):
    """There was one function for each hash of a band before, which each took its own passes over all shingles."""
    counts = []
    functions = minhash.functions
    monkeypatch.setattr(minhash, "functions", lambda count, *rest: counts.append(count) or functions(count, *rest))
    keys = linededup.line_keys(lines_of(random.Random(1), 40))
    assert keys.shape == (43, linededup.BANDS) and counts == [linededup.BANDS * linededup.ROWS // 2]


def test_keys_against_brute_force():
    lines = lines_of(random.Random(2), 60)
    factors, offsets = minhash.functions(linededup.BANDS * linededup.ROWS // 2, 6, 32)
    values = []
    for line in lines:
        x = line.ljust(linededup.CHARS, "\0")
        shingles = []
        for k in range(len(x) - linededup.CHARS + 1):
            h = 0
            for c in x[k : k + linededup.CHARS]:
                h = (h * 0x01000193 + ord(c)) % 2**32
            h = (h ^ h >> 16) * 0x7FEB352D % 2**32
            shingles.append(h ^ h >> 15)
        of = [[(h * int(a) + int(b)) % 2**32 for h in shingles] for a, b in zip(factors, offsets, strict=True)]
        values.append([min(v) for v in of] + [max(v) for v in of])
    assert (linededup.line_keys(lines) == minhash.halves(np.array(values, np.uint32), linededup.ROWS)).all()


def test_pieces_do_not_change_keys_and_are_small(monkeypatch):
    lines = lines_of(random.Random(3), 2000)
    pieces = []
    hashed = linededup.shingle_hashes
    monkeypatch.setattr(linededup, "shingle_hashes", lambda some, *rest: pieces.append(sum(map(len, some))) or hashed(some, *rest))
    keys = linededup.line_keys(lines)
    assert len(pieces) > 2 and max(pieces) <= 100_000  # 400 000 before, which left a core's cache
    monkeypatch.setattr(linededup, "CHUNK", 700)
    assert (linededup.line_keys(lines) == keys).all()


@pytest.mark.parametrize("similarity", [0.5, 0.75, 0.9])
@pytest.mark.parametrize("union", [4, 20, 200])
def test_bands_of_both_ends_meet_as_often_as_separate_functions(similarity, union):
    """Of random orders: the chance that a band of least or one of greatest values is the same is no less than of two bands of separate functions, and no more than of two that never meet at once."""
    rng = np.random.default_rng(4)
    shared = round(similarity * union)
    order = rng.random((20_000, linededup.ROWS, union))
    least, greatest = (order.argmin(2) < shared).all(1), (order.argmax(2) < shared).all(1)
    p = (shared / union) ** linededup.ROWS
    assert 1 - (1 - p) ** 2 - 0.015 <= (least | greatest).mean() <= 2 * p + 0.015


def test_texts_in_lower_case_have_the_lines_that_each_line_has():
    text = "ΟΔΟΣ\nΣ\n ΑΣ  Σ\nİstanbul\x1f\n\n\tMixed Case \r\nΣΑ\ud800"
    assert linededup.normals(text) == [linededup.normal(x) for x in text.split("\n")]
    assert linededup.normals("") == linededup.normals(None) == []
