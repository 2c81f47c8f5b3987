"""Whole-word replacement by a trie of words: one pass over a text, however many entries there are."""

from __future__ import annotations

import re
from collections.abc import Iterable

TOKEN = re.compile(r"\w+|\W")  # words, and every other character by itself; joined they are the text


def _fold_letter(letter: str) -> str:
    """The letter without its case, by single-letter mappings, as case-insensitive patterns compare."""
    upper = letter.upper()
    return (upper if len(upper) == 1 else letter).lower()[0]


def fold(text: str) -> str:
    """Text of the same length without case."""
    return text.lower() if text.isascii() else "".join(map(_fold_letter, text))


def is_word(token: str) -> bool:
    return token[0].isalnum() or token[0] == "_"


class Lexicon:
    """Entries ``(key, replacement)``. Of keys that differ by case only, the first counts; empty keys match nothing.

    A key matches whole words. Where it begins or ends in punctuation, a word must stand beside it there.
    """

    def __init__(self, entries: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for order, (key, new) in enumerate(entries):
            node = self.root
            for token in TOKEN.findall(fold(key)):
                node = node.setdefault(token, {})
            if key:
                node.setdefault(None, (-len(key), order, new))

    def _hits(self, tokens: list[str]) -> list[tuple]:
        """``(-length, order, first token, token after, replacement)`` of every place of every key."""
        found, last = [], len(tokens)
        for start, token in enumerate(tokens):
            node = self.root.get(token)
            if node is None or not (is_word(token) or start and is_word(tokens[start - 1])):
                continue
            end = start + 1
            while node is not None:
                if None in node and (is_word(tokens[end - 1]) or end < last and is_word(tokens[end])):
                    length, order, new = node[None]
                    found.append((length, order, start, end, new))
                node = node.get(tokens[end]) if end < last else None
                end += 1
        return found

    def replace(self, text: str) -> str:
        """Every match replaced; of matches that overlap, the longest key, the earlier entry, the first place."""
        hits = self._hits(TOKEN.findall(fold(text)))
        if not hits:
            return text
        tokens, taken = TOKEN.findall(text), set()
        for _, _, start, end, new in sorted(hits, key=lambda hit: hit[:3]):
            if start not in taken and end - 1 not in taken:  # taken matches are no shorter: none lies within
                taken.update(range(start, end))
                tokens[start:end] = [new] + [""] * (end - start - 1)
        return "".join(tokens)


def grams(text: str, lengths: Iterable[int]) -> list[str]:
    """Distinct folded runs of the given numbers of tokens."""
    tokens = TOKEN.findall(fold(text))
    return list({"".join(tokens[i:i + n]) for n in lengths for i in range(len(tokens) - n + 1)})
