"""Common blocks against ``difflib``."""

import random
import time
from difflib import SequenceMatcher

import plain
import pytest

from clearlines.functions import blocks
from clearlines.functions.blocks import SuffixAutomaton, block_ratio, block_ratio_reaches, matched


def edited(rng, text, edits, letters):
    signs = list(text)
    for _ in range(edits):
        at = rng.randrange(len(signs) + 1)
        if rng.random() < 0.5 and at < len(signs):
            del signs[at]
        else:
            signs.insert(at, rng.choice(letters))
    return "".join(signs)


def pairs(n, most, seed):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(["a", "ab", "abc ", "etaoin shrdlu", "áб字\U0001f600 "])
        a = "".join(rng.choices(letters, k=rng.randrange(most)))
        yield a, edited(rng, a, rng.randrange(8), letters) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randrange(most)))


def test_longest_block_and_its_ties():
    for a, b in pairs(3000, 40, 1):
        block = SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b))
        assert SuffixAutomaton(b).longest_block(a) == (block if block.size else (0, 0, 0))


@pytest.mark.parametrize("few_pairs", [-1, 200])
def test_matched_equals_difflib(few_pairs):
    """10,000 pairs, by automata alone and with small windows left to ``difflib``."""
    for a, b in pairs(5000, 60, 2 + few_pairs):
        assert matched(a, b, few_pairs=few_pairs) == sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_ratio_and_threshold():
    texts = [(a, b) for a in plain.AWKWARD for b in plain.AWKWARD] + list(pairs(1500, 50, 3))
    for a, b in texts:
        wanted = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert block_ratio(a, b) == wanted
        for threshold in (0.0, 0.5, 0.9, 0.95, 1.0, wanted):
            assert block_ratio_reaches(a, b, threshold) == (wanted >= threshold)
            assert block_ratio_reaches(a, b, threshold, above=True) == (wanted > threshold)


def test_long_texts_take_no_square():
    """Near copies of 100,000 letters, one letter only, and unlike texts."""
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlucmf", k=rng.randint(1, 9))) for _ in range(3000)]
    a = " ".join(rng.choices(words, k=17_000))[:100_000]
    b = edited(rng, a, 400, "etaoin ")
    began = time.perf_counter()
    assert 0.99 < block_ratio(a, b) < 1
    assert time.perf_counter() - began < 20
    began = time.perf_counter()
    assert block_ratio("x" * 100_000, "x" * 99_000 + "y") == 2 * 99_000 / 199_001
    assert not block_ratio_reaches(a, " ".join(rng.choices(words, k=17_000))[:100_000], 0.9)
    assert time.perf_counter() - began < 20


def test_one_stretch_of_foreign_characters_needs_no_search(monkeypatch):
    rng = random.Random(11)
    made = []
    for letters in ("ab", "abcdef"):
        def text(most, signs):
            return "".join(rng.choice(signs) for _ in range(rng.randint(0, most)))

        for _ in range(1500):
            before, behind = text(6, letters), text(6, letters)
            made.append((before + text(2, "XY") + behind, before + text(2, "ZW") + behind))
    wanted = [sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for a, b in made]
    assert [blocks.matched(a, b) for a, b in made] == wanted
    monkeypatch.setattr(blocks, "SequenceMatcher", None)
    sentence = "The quick brown fox jumps over the lazy dog."
    assert blocks.matched(sentence, sentence[:20] + "␀" * 5 + sentence[20:]) == len(sentence)
    assert blocks.block_ratio_reaches(sentence.replace("q", "␀"), sentence, 0.97)


def test_short_windows_are_searched_by_pieces(monkeypatch):
    """Longest blocks and their ties as ``difflib`` finds them, without its loops over all pairs of characters."""
    made = list(pairs(3000, 60, 12))
    blocks_wanted = [SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b)) for a, b in made]
    assert [blocks.longest_block(a, b) for a, b in made] == [block if block.size else (0, 0, 0) for block in blocks_wanted]
    wanted = [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in made]
    monkeypatch.setattr(blocks, "SequenceMatcher", None)
    monkeypatch.setattr(blocks, "SuffixAutomaton", None)
    assert [block_ratio(a, b) for a, b in made] == wanted
    for threshold in (0.0, 0.3, 0.92, 1.0, 1.5):
        assert [block_ratio_reaches(a, b, threshold) for a, b in made] == [ratio >= threshold for ratio in wanted]
        assert [block_ratio_reaches(a, b, threshold, above=True) for a, b in made] == [ratio > threshold for ratio in wanted]
