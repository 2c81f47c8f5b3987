"""Secrets: a keyword automaton over every text, anchored patterns near its hits, checksums inside.

One pass of an Aho-Corasick automaton finds keywords; a pattern is only tried at a hit of its own
keyword. Runs of hexadecimal digits have no keyword: they are found by their length. Kinds with a
checksum or a structure of their own are reported only if it holds.

All patterns are of ASCII characters, so texts are matched as bytes; spans are counted in code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlines.llm.common import arrow_map, bounded_batches, per_worker

#: Kinds, in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "card", "jwt", "iban", "key_block")


def base62(number: int, width: int) -> bytes:
    """Base 62 with the digits 0-9, A-Z, a-z, filled with zeros."""
    digits = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    out = bytearray()
    while number:
        number, d = divmod(number, 62)
        out.append(digits[d])
    return bytes(reversed(out)).rjust(width, b"0")


def crc_ends(token: bytes) -> bool:
    """Tokens of a prefix, 30 characters, and their CRC-32 as six base-62 digits."""
    import zlib

    body = token.partition(b"_")[2]
    return base62(zlib.crc32(body[:30]), 6) == body[30:]


def luhn(digits: bytes) -> bool:
    """Card numbers: every second digit from the right doubled, digits summed, a multiple of ten."""
    numbers = [c - 48 for c in reversed(digits) if 48 <= c <= 57]
    total = sum(numbers[::2]) + sum(sum(divmod(2 * n, 10)) for n in numbers[1::2])
    return 13 <= len(numbers) <= 19 and len(set(numbers)) > 1 and total % 10 == 0


def iban(text: bytes) -> bool:
    """Account numbers: the first four characters moved to the end, letters as 10 to 35, 1 modulo 97."""
    turned = (text[4:] + text[:4]).decode()
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def jwt(token: bytes) -> bool:
    """Signed web tokens: the first part is a JSON object that names an algorithm."""
    import base64
    import json

    head = token.split(b".")[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except ValueError:
        return False
    return isinstance(found, dict) and "alg" in found


ASSIGN = re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
                    rb"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")


def assigned(found: re.Match) -> bool:
    return found.end(1) - found.start(1) >= 8


def long_enough(found: re.Match) -> bool:
    return found.end() - found.start() >= 16


#: Keyword (lower case) -> the rules tried at its hits: kind, pattern, test. A failing match still takes
#: its place, so a later hit of the same kind inside it is passed over.
RULES: dict[str, list[tuple[str, re.Pattern, Callable[[re.Match], bool]]]] = {
    **{word: [("assign", ASSIGN, assigned)] for word in ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": [("access", ACCESS, long_enough)],
    **{f"gh{kind}_": [("github", re.compile(rb"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), lambda m: crc_ends(m[0]))]
       for kind in "pousr"},
    "npm_": [("npm", re.compile(rb"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), lambda m: crc_ends(m[0]))],
    "eyj": [("jwt", re.compile(rb"(?<![\w-])eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}"), lambda m: jwt(m[0]))],
    **{word: [("card", re.compile(word.encode() + rb"[^0-9\n]{0,20}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.I),
               lambda m: luhn(m[1]))] for word in ("card", "visa")},
    "iban": [("iban", re.compile(rb"iban[^0-9A-Za-z\n]{0,4}([A-Z]{2}[0-9]{2}[0-9A-Z]{11,30})(?![0-9A-Za-z])", re.I),
              lambda m: m[1].isupper() and iban(m[1]))],
    "-----begin ": [("key_block", re.compile(
        rb"-----BEGIN ([A-Z ]{0,20}PRIVATE KEY)-----[0-9A-Za-z+/=\s]{16,}-----END \1-----"), lambda m: True)],
}


class Scanner:
    """The keyword automaton and its rules."""

    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for word, rules in RULES.items():
            self.words.add_word(word, (len(word), rules))
        self.words.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then kind."""
        raw = text.encode()
        found = [("hex", m.start(), m.end()) for m in HEX.finditer(raw)]
        taken: dict[str, int] = {}
        # lower() of bytes touches ASCII alone; Latin-1 makes one character of each byte. Starts must
        # rise: hits come by their ends, so those of the shorter keywords may come too early
        hits = ((end - length + 1, rules) for end, (length, rules) in self.words.iter(raw.lower().decode("latin-1")))
        for start, rules in sorted(hits, key=lambda hit: hit[0]):
            for kind, pattern, holds in rules:
                if start < taken.get(kind, 0):
                    continue
                match = pattern.match(raw, start)
                if match is None:
                    continue
                if kind in ("assign", "access") or holds(match):
                    taken[kind] = match.end()
                if holds(match):
                    at = match.span(1) if kind in ("card", "iban") else match.span()
                    found.append((kind, *at))
        if not found:
            return []
        if len(raw) != len(text):  # bytes to code points, in one pass
            places = sorted({p for _, a, b in found for p in (a, b)})
            points, before, count = {}, 0, 0
            for p in places:
                count += len(raw[before:p].decode())
                points[p], before = count, p
            found = [(kind, points[a], points[b]) for kind, a, b in found]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans array<struct<kind, start, end>>`` of every row's whole text.

    Spans are in code points, ends exclusive; of a kind they do not overlap, different kinds may.
    NULL and empty texts have an empty list. NULL and repeated keys and rows give a row each. Spans that
    start together are in the order of :data:`KINDS`. No other column is read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator):
        import pyarrow as pa

        scanner = per_worker("scanner", Scanner)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(t or "")]
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["key", "spans"])

    columns = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return arrow_map(columns, run, schema).withColumnRenamed("key", key)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span (overlapping ones joined) replaced by ``[kind]``."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by their kind in brackets.

    Rows, columns and their order stay; NULL texts stay NULL. ``length`` names a column that is set
    to the new number of characters of non-NULL texts.
    """
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pandas as pd

        scanner = per_worker("scanner", Scanner)
        for part in texts:
            yield pd.Series([None if t is None else redact(t, scanner.spans(t)) for t in part], dtype=object)

    bounded_batches(docs)
    cleaned = docs.withColumn(text, F.pandas_udf(run, "string")(F.col(text)))
    if length:
        count = F.length(F.col(text)).cast(docs.schema[length].dataType)
        cleaned = cleaned.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(count))
    return cleaned.select(*docs.columns)
