"""Characters that two texts share in blocks: the longest common block first, then what stands before and after it.

Of longest blocks the one that is earliest in the first text counts, then the one earliest in the second; both sides of it
are treated alike. This is the measure of ``difflib``, whose search takes time with the square of a text's
length. Here a suffix automaton of the second text finds the longest block in one pass over the first, so a level of the
recursion is linear. In windows of few character pairs pieces of the first text are looked up in the second, which is faster there.
"""

from __future__ import annotations

import heapq
from difflib import SequenceMatcher

#: Character pairs of a window up to which looking up pieces is the faster way.
FEW_PAIRS = 1 << 17


class SuffixAutomaton:
    """All substrings of a text; each state knows where its substrings end first."""

    def __init__(self, text: str):
        self.following: list[dict] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        following, link, length, end = self.following, self.link, self.length, self.end
        last = 0
        for at, sign in enumerate(text):
            new = len(length)
            length.append(length[last] + 1)
            end.append(at)
            link.append(0)
            following.append({})
            state = last
            while state >= 0 and sign not in following[state]:
                following[state][sign] = new
                state = link[state]
            if state >= 0:
                target = following[state][sign]
                if length[target] == length[state] + 1:
                    link[new] = target
                else:
                    # the substrings of the target that are suffixes here get a state of their own
                    part = len(length)
                    length.append(length[state] + 1)
                    end.append(end[target])
                    link.append(link[target])
                    following.append(following[target].copy())
                    while state >= 0 and following[state].get(sign) == target:
                        following[state][sign] = part
                        state = link[state]
                    link[target] = link[new] = part
            last = new

    def longest_block(self, text: str) -> tuple[int, int, int]:
        """Start in ``text``, start in the automaton's text, and length of the longest common block."""
        following, link, length = self.following, self.link, self.length
        state = size = best = stop = found = 0
        for at, sign in enumerate(text):
            while state and sign not in following[state]:
                state = link[state]
                size = length[state]
            if sign in following[state]:
                state = following[state][sign]
                size += 1
                if size > best:
                    best, stop, found = size, at + 1, self.end[state] + 1
        return stop - best, found - best, best


def _same_start(a: str, b: str) -> int:
    """Characters that two texts share from their starts on."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """As :meth:`SuffixAutomaton.longest_block`, by looking up pieces of ``a`` in ``b``.

    Only a longer block than the best so far counts, so the first of the longest ones stays. Where the latter half of a piece does not
    occur, no piece that holds it does.
    """
    at = start = best = 0
    while at + best < len(a):
        half, end = at + (best + 1) // 2, at + best + 1
        if a[half:end] not in b:
            at = half + 1
            continue
        found = b.find(a[at:end])
        if found < 0:
            at += 1
        else:
            start, best = at, best + 1 + _same_start(a[end:], b[found + best + 1:])
    return start, b.find(a[start:start + best]) if best else 0, best


def matched_around(a: str, b: str) -> int | None:
    """Characters in common blocks where the texts differ in one stretch, of characters that the other text does not have; else None.

    Every block then lies before the stretch or behind it, and the longer of both is the longest block. If nothing
    stands there in one of the texts, what is behind must not occur earlier in that text: of equal blocks the first counts.
    """
    start = _same_start(a, b)
    most = min(len(a), len(b)) - start
    end = _same_start(a[:len(a) - most - 1:-1], b[:len(b) - most - 1:-1]) if most else 0
    here, there = a[start:len(a) - end], b[start:len(b) - end]
    if not set(here).isdisjoint(b) or not set(there).isdisjoint(a):
        return None
    if end > start and not (here and there) and (a if not here else b).find(a[len(a) - end:]) != start:
        return None
    return start + end


def matched(a: str, b: str, enough: int | None = None, few_pairs: int = FEW_PAIRS) -> int:
    """Characters in common blocks. With ``enough``, a number on the same side of it: the search ends once that is certain."""
    around = matched_around(a, b)
    return _searched(a, b, enough, few_pairs) if around is None else around


def _searched(a: str, b: str, enough: int | None = None, few_pairs: int = FEW_PAIRS) -> int:
    """The same by a search for blocks."""
    total, possible = 0, min(len(a), len(b))
    windows = [(-possible, 0, len(a), 0, len(b))] if possible else []
    while windows and not (enough is not None and (total >= enough or total + possible < enough)):
        most, a_from, a_to, b_from, b_to = heapq.heappop(windows)
        left, right = a[a_from:a_to], b[b_from:b_to]
        i, j, size = longest_block(left, right) if len(left) * len(right) <= few_pairs else SuffixAutomaton(right).longest_block(left)
        possible += most
        if not size:
            continue
        total += size
        for window in ((a_from, a_from + i, b_from, b_from + j), (a_from + i + size, a_to, b_from + j + size, b_to)):
            most = min(window[1] - window[0], window[3] - window[2])
            if most:
                heapq.heappush(windows, (-most, *window))
                possible += most
    return total


def block_ratio(a: str, b: str) -> float:
    """Twice the matched characters over all characters; 1.0 for two empty texts."""
    both = len(a) + len(b)
    return 2.0 * matched(a, b) / both if both else 1.0


def block_ratio_reaches(a: str, b: str, threshold: float, above: bool = False) -> bool:
    """Whether the ratio is at least (``above``: more than) the threshold."""
    both = len(a) + len(b)

    def holds(count: int) -> bool:
        ratio = 2.0 * count / both if both else 1.0
        return ratio > threshold if above else ratio >= threshold

    # the least count that is enough, by the same rounding as the ratio itself
    most = min(len(a), len(b))
    low = int(min(max(0.0, threshold * both / 2), most + 1))
    while low and holds(low - 1):
        low -= 1
    while low <= most and not holds(low):
        low += 1
    if low > most or not both:
        return holds(0) if not both else False
    if low == 0:
        return True
    around = matched_around(a, b)
    if around is not None:
        return around >= low
    if len(a) * len(b) > FEW_PAIRS:
        # letters in any order bound the blocks
        counts: dict[str, int] = {}
        for sign in b:
            counts[sign] = counts.get(sign, 0) + 1
        shared = 0
        for sign in a:
            left = counts.get(sign, 0)
            if left:
                counts[sign] = left - 1
                shared += 1
        if shared < low:
            return False
    return _searched(a, b, low) >= low


def infrequent_ratio(a: str, b: str) -> float:
    """``difflib``'s own ratio: frequent characters of texts of 200 characters and more do not count."""
    return SequenceMatcher(None, a, b).ratio()


def infrequent_ratio_reaches(a: str, b: str, threshold: float, above: bool = False) -> bool:
    """Whether that ratio is at least (``above``: more than) the threshold."""
    def enough(ratio: float) -> bool:
        return ratio > threshold if above else ratio >= threshold

    match = SequenceMatcher(None, a, b)
    # quick_ratio is an upper bound of ratio and linear in the lengths
    return enough(match.quick_ratio()) and enough(match.ratio())
