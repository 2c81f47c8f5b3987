"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled one after the other, each by a *merge gadget*. The automaton reads
tokens; it starts with one state that has an arc for every byte. The gadget of the merge
``(u, v) -> w`` with rank ``r``

* gives the state that ``u`` leads to a copy without the arc ``v`` (``u v`` is no longer a path),
* gives every state that had an arc ``u`` an arc ``w``, leading to where ``v`` led.

A state's arcs would be nearly the whole vocabulary, so copies are kept as differences: a state
is the token that led to it, ``cut[u, v] = r`` says that its copy of time ``r`` lost the arc
``v``, ``came[w] = (v, r)`` that ``w`` leads to the state that ``v`` led to at that time, and
``grew[w] = (u, r)`` that the arc ``w`` is there where ``u`` was at that time. Following the two
chains answers whether a state has an arc; answers are kept in a transition table.

The automaton has exactly one path for each byte string, and the tokens along it are its BPE
encoding. A path's prefixes are the paths of the string's prefixes, so one pass over the bytes
finds it: the last arc of each prefix is the one whose start has that arc. Decoding emits the
arcs' labels (bytes) in order.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines.llm.common import arrow_map, per_worker

START = -1
_LATER = 1 << 60

#: Words, and answers about arcs, that a worker keeps.
CACHE_WORDS = 400_000
CACHE_ARCS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the
    others, in order, from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Compiled merges. ``labels[token]`` are the bytes of an arc, ``tokens[bytes]`` its token."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.tokens = {bytes([b]): vocabulary[bytes([b])] for b in range(256) if bytes([b]) in vocabulary}
        self.cut: dict[tuple[int, int], int] = {}
        self.came: dict[int, tuple[int, int]] = {}
        self.grew: dict[int, tuple[int, int]] = {}
        self.arcs: dict[int, bool] = {}  # the transition table: (token << 32 | following) -> whether it is there
        for rank, (left, right) in enumerate(merges):
            self.gadget(self.tokens[left], self.tokens[right], left + right, vocabulary[left + right], rank)
        self.labels = {token: label for label, token in self.tokens.items()}
        self.steps: dict[int, int] = {}  # (node << 8 | byte) -> node: the labels' common prefixes
        self.ends: dict[int, int] = {}  # node -> the arc whose label ends there
        for label, token in self.tokens.items():
            node = 0
            for byte in label:
                node = self.steps.setdefault(node << 8 | byte, len(self.steps) + 1)
            self.ends[node] = token

    def gadget(self, u: int, v: int, label: bytes, w: int, rank: int) -> None:
        """Compile one merge; a merge whose ``u v`` is not a path adds no arc."""
        if (u, v) in self.cut or not self.has_arc(u, v):
            return
        self.cut[u, v] = rank
        if label not in self.tokens:
            self.tokens[label] = w
            self.came[w] = (v, rank)
            self.grew[w] = (u, rank)

    def has_arc(self, token: int, following: int) -> bool:
        """Whether the state that ``token`` led to has the arc ``following``."""
        cut, came, grew = self.cut, self.came, self.grew
        until = _LATER
        while token is not None:
            arc, before = following, _LATER
            while arc is not None:
                lost = cut.get((token, arc))
                if lost is not None and lost < until and lost <= before:
                    return False
                arc, before = grew.get(arc, (None, 0))
            token, until = came.get(token, (None, 0))
        return True

    def path(self, word: bytes) -> list[int]:
        """The arcs of the word's only path.

        A table of byte transitions gives the arcs that begin at a position; longer ones are tried
        first. What leads to a position is always the one path of the bytes before it, so a position
        that cannot be left is never tried again: steps are linear.
        """
        arcs, steps, ends, size = self.arcs, self.steps, self.ends, len(word)
        found: list[int] = []
        choices: list[list[tuple[int, int]]] = []  # arcs not yet tried, by position on the path
        closed: set[int] = set()
        at, before, due = 0, START, None
        while at < size:
            if due is None:
                due, node, place = [], 0, at
                while place < size:
                    node = steps.get(node << 8 | word[place])
                    if node is None:
                        break
                    place += 1
                    token = ends.get(node)
                    if token is not None:
                        due.append((place, token))
            while due:
                place, token = due.pop()
                if place in closed:
                    continue
                if before == START:
                    break
                key = before << 32 | token
                there = arcs.get(key)
                if there is None:
                    if len(arcs) > CACHE_ARCS:
                        arcs.clear()
                    there = arcs[key] = self.has_arc(before, token)
                if there:
                    break
            else:
                if not found:
                    raise ValueError(f"no path for {word[:40]!r}")
                closed.add(at)
                at -= len(self.labels[found.pop()])
                due = choices.pop()
                before = found[-1] if found else START
                continue
            found.append(token)
            choices.append(due)
            at, before, due = place, token, None
        return found


class Words(dict):
    """Words and their paths: at most ``most``, in two generations; a word that is met again stays."""

    def __init__(self, path, most: int):
        super().__init__()
        self.path, self.most, self.older = path, most // 2, {}

    def __missing__(self, word: str) -> list[int]:
        found = self.older.get(word)
        if found is None:
            found = self.path(word.encode())
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


class Codec:
    """Encodes and decodes whole texts with the vocabulary file of a byte-level tokenizer."""

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"]]
        # special tokens stand outside the alphabet or are read before any word; they have no arc
        words = {as_bytes(t): i for t, i in parts["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.automaton = Automaton(words, [(as_bytes(a), as_bytes(b)) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in parts.get("added_tokens") or []}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.split_latin = re.compile(LATIN_WORDS).findall
        self.labels = self.automaton.labels | {i: t.encode() for t, i in self.special.items()}
        self.known = Words(self.automaton.path, CACHE_WORDS)

    def words(self, text: str) -> list[str]:
        """The words that merges never cross."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [text[a:b] for _, (a, b) in self.split(text)]
        return self.split_latin(text)

    def encode_words(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.words(text))))

    def encode(self, text: str) -> list[int]:
        if not self.special or not any(t in text for t in self.special):
            return self.encode_words(text)
        ids: list[int] = []
        for part in self.at_special.split(text):
            ids += [self.special[part]] if part in self.special else self.encode_words(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after the other."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"

#: The byte-level word pattern, written out for texts of Latin-1 characters: contractions, then letters,
#: digits or other signs with at most one space before, then white space.
LATIN_WORDS = (f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids array<int>`` and ``decoded string`` of every whole text, one row per row of ``docs``.

    A NULL text is encoded as the empty one: no ids, decoded to the empty string. Keys are carried
    along, so NULL or repeated keys and repeated rows give a row each. Other columns are not read. A text of any
    length is encoded whole, in time proportional to its length. An empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codec = per_worker(("codec", path), lambda: Codec(path))
        for batch in batches:
            found = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int32)
            flat = pa.array(np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                 pa.array([codec.decode(ids) for ids in found], pa.string())], ["key", "ids", "decoded"])

    columns = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return arrow_map(columns, run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
