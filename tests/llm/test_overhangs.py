"""Long texts that share words are compared to the end, however many ways their words can be laid side by side."""

import itertools
import random

import pytest

from tesserae.llm import copies as D
from tesserae.llm import overhangs


def spelt(words):
    return ". " + " ".join(sorted(words))


def many_ways(pairs):
    """Words that both texts hold: each third one can also be put together from the two before it."""
    words = [(chr(0x4E00 + 2 * i) * 4, chr(0x4E01 + 2 * i) * 4) for i in range(pairs)]
    return [w for x, y in words for w in (x, y, x + y)]


@pytest.mark.parametrize("pairs", [0, 16, 300])
def test_a_shared_word_is_needed_as_a_part_of_others(pairs):
    # c aaaabbbbb d, eaaaa bbbbbf beside caaaa bbbbbd, e aaaabbbbb f
    one = ["c", "aaaabbbbb", "d", "eaaaa", "bbbbbf", *many_ways(pairs)]
    two = ["caaaa", "bbbbbd", "e", "aaaabbbbb", "f", *many_ways(pairs)]
    assert D.same_text(spelt(one), spelt(two))
    # the same letters, but no word of the second text can come before or after g
    assert not D.same_text(spelt([*one, "gh"]), spelt([*two, "hg"]))


def test_one_text_cut_in_two_ways():
    rng = random.Random(3)
    for letters, cut in itertools.product(("ab", "abc"), (60, 120)):
        text = "".join(rng.choice(letters) for _ in range(cut))
        one, two = ("".join(c + rng.choice(["", " "]) for c in text).split() for _ in range(2))
        assert D._runs_alike(one, two), (one, two)


def test_long_texts_of_a_class():
    texts = [["c", "aaaabbbbb", "d", "eaaaa", "bbbbbf"], ["caaaa", "bbbbbd", "e", "aaaabbbbb", "f"], ["caaa", "abbbbbd", "e", "aaaabbbbf", "b"]]
    entries = [{"spelling": spelt([*t, *many_ways(16)]), "fine": i, "first_id": 10 + i, "copies": 2} for i, t in enumerate(texts)]
    assert sorted(D._classes_of(entries)) == [(0, 10, 4), (1, 10, 4), (2, 12, 2)]


def test_by_all_orders():
    rng, orders, alike = random.Random(9), lambda words: {"".join(p) for p in itertools.permutations(words)}, 0
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(["ab", "abc"])) for _ in range(rng.randint(1, 12)))
        one, two = ("".join(c + rng.choice(["", "", " "]) for c in text).split() for _ in range(2))
        rng.shuffle(two)
        if rng.random() < 0.6:
            two = ["".join(rng.sample(w, len(w))) for w in two]
        if max(len(one), len(two)) <= 7:
            want = bool(orders(one) & orders(two))
            assert overhangs.run_alike(one, two) == want, (one, two)
            alike += want
    assert alike > 300
