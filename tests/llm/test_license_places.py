import random

import pytest

from phonoframe.llm import licenses


def notice(name):
    return licenses.words_of(licenses.TEMPLATES[name])


def filler(rng, n):
    return [b"".join(rng.choices([b"x", b"y", b"z", b"q"], k=6)) for _ in range(n)]


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES)


def places(scanner, words, name):
    (found,) = scanner.scan([b" ".join(words).decode()])
    return [x[1:] for x in found if x[0] == name]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_two_notices_close_together_are_two_places(scanner, name):
    rng, n = random.Random(name), len(notice(name))
    for gap in [*range(30), *range(30, 201, 10)]:
        a = rng.randint(0, 300)
        words = filler(rng, a) + notice(name) + filler(rng, gap) + notice(name) + filler(rng, 50)
        assert places(scanner, words, name) == [(a, n, 1.0), (a + n + gap, n, 1.0)], gap


def test_many_notices_in_a_row(scanner):
    rng, t = random.Random(1), notice("mit")
    words, starts = [], []
    for gap in (0, 3, 1, 0, 40, 0, 0, 7, 120, 0):
        words += filler(rng, gap)
        starts.append(len(words))
        words += t
    assert places(scanner, words, "mit") == [(i, len(t), 1.0) for i in starts]


def test_notices_that_lack_words(scanner):
    rng, t = random.Random(2), notice("mit")
    n = len(t)
    for first, second in ((t[8:], t), (t[:-8], t), (t, t[8:]), (t, t[:-8])):
        for gap in (0, 1, 20):
            words = filler(rng, 30) + first + filler(rng, gap) + second
            got = places(scanner, words, "mit")
            assert [(a, k) for a, k, _ in got] == [(30, len(first)), (30 + len(first) + gap, len(second))]
    for part in (t[: n // 2], t[n // 2 :]):  # too little for a place of its own
        words = part + filler(rng, 2) + t
        assert [(a, k) for a, k, _ in places(scanner, words, "mit")] == [(len(part) + 2, n)]
    words = t[n // 2 :] + t[: n // 2]
    assert [(a, k) for a, k, _ in places(scanner, words, "mit")] == [(0, n)]
