"""Equal runs of many pairs of texts against the standard library's matcher."""

import random
import time
from difflib import SequenceMatcher

import pytest

from pagewright.operators import matching


def plain(a, b, least):
    return [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= least]


def texts(rng, n):
    for _ in range(n):
        letters = rng.choice(("a", "ab", "abcd", "abcdefghijkl", "aé\U0001f600"))
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
        b = list(a) if rng.random() < 0.7 else [rng.choice(letters) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = [rng.choice(letters) for _ in range(rng.randrange(4))]
        words = ["largering", "hotbolt", "bluegear", "oldplate"]
        yield rng.choice(((a, "".join(b)), ("".join(rng.choice(words) for _ in range(20)), "".join(rng.choice(words) for _ in range(20)))))


@pytest.mark.parametrize("least", [1, 4])
@pytest.mark.parametrize("side_by_side", [1, 400, 400_000])
def test_runs_are_the_matchers(monkeypatch, least, side_by_side):
    monkeypatch.setattr(matching, "_LETTERS", side_by_side)
    pairs = [("", ""), ("abcd", ""), ("abcd", "abcd"), ("xabcdx", "yabcdy"), *texts(random.Random(least), 600)]
    assert matching.equal_runs(*zip(*pairs, strict=True), least) == [plain(a, b, least) for a, b in pairs]


def test_numbers_that_do_not_fit_are_ranked(monkeypatch):
    monkeypatch.setattr(matching, "_MOST", 1000)
    pairs = list(texts(random.Random(8), 200))
    assert matching.equal_runs(*zip(*pairs, strict=True), 4) == [plain(a, b, 4) for a, b in pairs]


def test_a_long_block_takes_seconds():
    """6,000 lines: the matcher looks at some 10^8 pairs of letters for a run."""
    rng = random.Random(1)
    lines = [rng.choice("large hot blue old cold small red new".split()) + rng.choice("ring bolt plate gear nut screw pin rod".split()) for _ in range(6000)]
    other = [x.translate(str.maketrans("ae", "oo")) if rng.random() < 0.25 else x + "addedwords" * (rng.random() < 0.15) for x in lines]
    began = time.process_time()
    runs = matching.equal_runs(["".join(lines)], ["".join(other)], 4)[0]
    assert time.process_time() - began < 20
    assert sum(n for _, _, n in runs) > 20_000
