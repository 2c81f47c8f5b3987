"""Quality rules: facts of a text, and the cross-document frequency of its lines.

Lines are normalised and hashed in the JVM; per host (the ``source`` column) the distinct documents of
a line are counted, lines in more than ``limit`` documents are removed, and a document that loses more than
``depleted`` of its characters is rejected. Counting is two partial aggregations: a line that a
third of all documents share reaches a reducer as one row per task. The frequent lines then meet the
documents' lines in a join that salts both sides by document, so no line of a host is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines.llm.common import arrow_map

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

#: A line in more documents of a host than this is boilerplate.
LIMIT = 20
#: Share of a document's counted characters that may be removed.
DEPLETED = 0.5
SALTS = 32


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of ``width`` words found twice or more, the first included."""
    import numpy as np

    if len(words) <= width:
        return 0
    windows = list(zip(*[words[i:] for i in range(width)]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in windows), np.int64, len(windows))
    hits = (np.bincount(numbers)[numbers] > 1).astype(np.int64)
    inside = np.convolve(hits, np.ones(width, np.int64)) > 0
    return int(inside.sum())


def text_facts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, lines (with a word) equal to an earlier one, repeated words.

    Words are runs without ASCII white space. NULL has none.
    """
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def with_facts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the facts of every row's whole text (rows with NULL or repeated keys included)."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            facts = list(zip(*map(text_facts, batch.column(1).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(f, pa.int64()) for f in facts]],
                                             ["key", *names])

    columns = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = "key " + kind + "".join(f", {n} long" for n in names)
    return arrow_map(columns, run, schema).withColumnRenamed("key", key)


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, letters and digits only: what makes two lines the same."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), "[^\\p{L}\\p{N}]+", ""), "\\p{N}", "0")


def hashed_lines(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """``key, host, line, chars``: every line with a letter or digit of every row, however short; NULL texts have none."""
    plain = F.transform(F.split(F.col(text), "\n"), normalised)
    counted = F.filter(plain, lambda line: line != "")
    hashes = F.transform(counted, lambda line: F.struct(F.xxhash64(line).alias("line"), F.length(line).alias("chars")))
    rows = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.explode(hashes).alias("at"))
    return rows.select("key", "host", "at.line", "at.chars")


def frequent_lines(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``host, line, documents`` of the lines in more than ``limit`` distinct documents of a host."""
    once = lines.select("key", "host", "line").distinct()
    return once.groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > limit)


def line_filter(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                limit: int = LIMIT, depleted: float = DEPLETED) -> DataFrame:
    """Per ``key``: ``counted_chars``, ``removed_chars``, ``removed_lines`` (hashes) and ``depleted``.

    One row for each distinct non-NULL key that has a counted line; documents without one lose
    nothing. NULL hosts are one host. Rows that share a key are one document: repeated rows do not
    make a line frequent. Rows with NULL keys are neither counted nor removed. A tie at ``limit`` stays.
    """
    lines = hashed_lines(docs.where(F.col(key).isNotNull()), key, text, host)
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
    hot = frequent_lines(lines, limit).select(
        F.col("host").alias("h"), F.col("line").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    met = lines.join(hot, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")) & (salt == F.col("s")),
                     "left")
    lost = F.col("l").isNotNull()
    summed = met.groupBy("key").agg(
        F.sum("chars").alias("counted_chars"), F.sum(F.when(lost, F.col("chars")).otherwise(0)).alias("removed_chars"),
        F.collect_set(F.when(lost, F.col("line"))).alias("removed_lines"))
    gone = F.col("removed_chars") > F.lit(depleted) * F.col("counted_chars")
    return summed.withColumn("depleted", gone).withColumnRenamed("key", key)


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are in ``removed``."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.coalesce(
        F.array_contains(removed, F.xxhash64(normalised(line))) & (normalised(line) != ""), F.lit(False)))
    return F.array_join(kept, "\n")


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                  limit: int = LIMIT, depleted: float = DEPLETED) -> DataFrame:
    """Facts, ``base_failed``, line columns and ``kept`` of every row of ``docs``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows. ``kept`` is
    false for those and for depleted documents. Empty and NULL texts fail. Rows with NULL keys are
    judged by their facts alone.
    """
    facts = with_facts(docs, key, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lines = line_filter(docs, key, text, host, limit, depleted)
    both = facts.withColumn("base_failed", failed).join(lines, key, "left")
    return both.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("depleted"), F.lit(False)))
