"""Sentence-level SARI inside the row: no explode, no shuffle.

For n = 1..4 the n-grams of source, prediction and references are counted for a batch of rows
at once, as numbers in an Arrow call: a few passes of array operations for thousands of pairs. ``s``, ``c`` and ``r`` below are the counts of one distinct n-gram (with k references
the first two are multiplied by k). Empty denominators score 1; F1 is 0 when both of its
parts are 0. The score of a pair is the mean over n of keep F1, delete precision and add F1.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from clearlines.functions.text import WS, strip

SIZES = (1, 2, 3, 4)
# So many times 4,096 tokens are counted together: enough for array operations to pay, little enough for a worker's memory.
FEW = 32
# {-~ [-` !-& (-+ :-@ / sign by sign: a set of single characters is one look-up for each character of a text
SIGNS = "".join(f"\\x{ord(sign):02x}" for sign in "{|}~[\\]^_`!\"#$%&()*+:;<=>?@/")


def punctuation_apart(text: Column) -> Column:
    """The text with punctuation split off (the published 13a scheme)."""
    text = F.replace(text, F.lit("<skipped>"), F.lit(""))
    text = F.replace(F.replace(text, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    # the scheme also pads spaces, which changes nothing once words are split at whitespace
    text = F.regexp_replace(text, f"([{SIGNS}])", " $1 ")
    text = F.regexp_replace(text, r"([^0-9])([.,])", "$1 $2 ")
    text = F.regexp_replace(text, r"([.,])([^0-9])", " $1 $2")
    return F.regexp_replace(text, r"([0-9])(-)", "$1 $2 ")


def punctuation_tokens(text: Column) -> Column:
    """Tokens with punctuation split off, as an array."""
    return space_tokens(punctuation_apart(text))


def space_tokens(text: Column) -> Column:
    """Tokens between whitespace; blank text is one empty token."""
    return F.split(strip(text), f"{WS}+", -1)


APART = {"13a": punctuation_apart, "space": lambda text: text}


def sari_tokens(text: Column, tokenizer: str = "13a", lower: bool = True) -> Column:
    """A text's tokens as the score counts them, one space between them: a row waits for Python with its inputs, and a text takes a fraction
    of the room of an array."""
    return F.regexp_replace(strip(APART[tokenizer](F.lower(text) if lower else text)), f"{WS}+", " ")


def _ratio(top, bottom):
    """``top / bottom``, 1 for an empty denominator."""
    import numpy as np

    return np.where(bottom == 0, 1.0, top / np.where(bottom == 0, 1.0, bottom))


def _f1(p, r):
    import numpy as np

    return np.where(p + r > 0, 2.0 * p * r / np.where(p + r > 0, p + r, 1.0), 0.0)


def _score(words, texts, row, side, references):
    """(keep, delete, add) of rows, averaged over n.

    ``words`` are numbers of words, text after text; of each text ``texts`` holds its size, ``row`` its row and ``side`` 0, 1 or 2 for
    source, prediction or reference; ``references`` is the number of references of each row.
    """
    import numpy as np
    import pandas as pd

    rows = len(references)
    at_row, at_side = np.repeat(row, texts), np.repeat(side, texts)
    ends = np.repeat(np.cumsum(texts), texts)
    # one number for each distinct n-gram of a row: of the (n-1)-gram before it, and its last word
    gram = word = pd.factorize(at_row * (int(words.max(initial=0)) + 1) + words)[0]
    place, distinct = np.arange(len(words)), int(word.max(initial=-1)) + 1
    means = np.zeros((3, rows))
    for n in SIZES:
        if n > 1:
            fits = place + n <= ends[place]
            place = place[fits]
            gram = pd.factorize(gram[fits] * distinct + word[place + n - 1])[0]
        kinds, where = int(gram.max(initial=-1)) + 1, at_side[place]
        owner = np.zeros(kinds, np.int64)
        owner[gram] = at_row[place]
        s, c, r = np.bincount(gram * 3 + where, minlength=3 * kinds).reshape(kinds, 3).T
        s, c = s * references[owner], c * references[owner]
        kept, gone = np.minimum(s, c), np.maximum(s - c, 0)
        good, new = np.minimum(kept, r), (c > 0) & (s == 0)

        def total(terms):
            return np.bincount(owner, weights=terms, minlength=rows)

        added = total(new & (r > 0))
        keep = _f1(_ratio(total(good / np.maximum(kept, 1)), total(kept > 0)), _ratio(total(good), total(np.minimum(s, r))))
        delete = _ratio(total(np.maximum(gone - r, 0) / np.maximum(gone, 1)), total(gone > 0))
        add = _f1(_ratio(added, total(new)), _ratio(added, total((r > 0) & (s == 0))))
        means += np.stack([keep, delete, add])
    return means / len(SIZES)


def _sari_udf(many: bool):
    """Arrow UDF (source, prediction, reference or array of references: tokens between spaces) -> (keep, delete, add)."""
    most = max(1, FEW << 12)

    def split(texts):
        import pyarrow.compute as pc

        return pc.split_pattern(texts, " ")

    def sizes_of(lists):
        import numpy as np
        import pyarrow.compute as pc

        return np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)

    def piece(source, prediction, references):
        import numpy as np
        import pyarrow as pa

        rows = len(source)
        every, counts = np.arange(rows), np.ones(rows, np.int64)
        # all tokens of a side, and the size and row of each of its texts
        sides = [(lists.flatten(), sizes_of(lists), every) for lists in (source, prediction)]
        if many:
            counts = sizes_of(references)
            references = split(references.flatten())
        sides.append((references.flatten(), sizes_of(references), np.repeat(every, counts)))
        words = pa.chunked_array([tokens.cast(pa.string()) for tokens, _, _ in sides]).combine_chunks().dictionary_encode()
        return _score(np.asarray(words.indices, np.int64), *(np.concatenate(x) for x in zip(*[s[1:] for s in sides])),
                      np.repeat(np.arange(3), [len(s[1]) for s in sides]), counts)

    def scores(source: pa.Array, prediction: pa.Array, references: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        sides = [split(source), split(prediction), references if many else split(references)]
        load = sizes_of(sides[0]) + sizes_of(sides[1])
        if many:
            deep = sizes_of(split(references.flatten()))
            load += np.bincount(np.repeat(np.arange(len(load)), sizes_of(references)), weights=deep, minlength=len(load)).astype(np.int64)
        else:
            load += sizes_of(sides[2])
        cuts = np.flatnonzero(np.diff(np.cumsum(load) // most)) + 1
        means = [np.zeros((3, 0))]
        for start, end in zip([0, *cuts], [*cuts, len(load)]):
            means.append(piece(*[lists.slice(start, end - start) for lists in sides]))
        return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(means, axis=1)], ["keep", "delete", "add"])

    return F.arrow_udf(scores, "keep double, delete double, add double")


def with_sari(df: DataFrame, source: str, prediction: str, references: str, into: str = "sari",
              tokenizer: str = "13a", lower: bool = True, tokens: tuple[str, str, str] | None = None) -> DataFrame:
    """Add ``into``: a struct (keep, delete, add, score), the first three averaged over n.

    ``tokens`` names columns that hold the three texts' tokens already (see :func:`sari_tokens`): make
    them before pairs are multiplied by systems, and each text is cut up once.

    ``references`` is a text column or an array of texts. All values lie between 0 and 1. A pair with a
    missing text has no score.
    """
    def prepared(text: Column) -> Column:
        return sari_tokens(text, tokenizer, lower)

    many = isinstance(df.schema[references].dataType, ArrayType)
    kept = df.columns
    ready = [F.col(name) for name in tokens] if tokens else [
        prepared(F.col(source)), prepared(F.col(prediction)),
        F.transform(F.col(references), prepared) if many else prepared(F.col(references))]
    whole = F.col(source).isNotNull() & F.col(prediction).isNotNull() & F.col(references).isNotNull()
    if many:
        whole = whole & F.forall(F.col(references), lambda text: text.isNotNull())
    # a column first: the texts need not pass the exchange with Python
    df = df.withColumn("_whole", whole)
    df = df.withColumn("_sari", _sari_udf(many)(*[F.when(F.col("_whole"), side) for side in ready]))
    parts = [F.col("_sari")[name] for name in ("keep", "delete", "add")]
    score = F.struct(*[p.alias(name) for p, name in zip(parts, ("keep", "delete", "add"))],
                     ((parts[0] + parts[1] + parts[2]) / 3.0).alias("score"))
    return df.select(*kept, F.when(F.col("_whole"), score).alias(into))
