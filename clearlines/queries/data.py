"""Relations derived from the test tables that several queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearlines.functions.readability import text_counts
from clearlines.functions.sari import sari_tokens
from clearlines.functions.text import NOT_WS, WS, collapse_ws, strip
from clearlines.operators.documents import explode_sentences
from clearlines.queries import sql
from clearlines.queries.sql import TRIAL_LEXICON  # noqa: F401
from clearlines.sources.tables import even_tasks, spread

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, by_key: bool = True) -> DataFrame:
    """The documents. The test tables are one file of one row group, so they are spread over the cores.

    Spreading writes every text to disk once. It also puts a document's rows together: a query that groups by none
    says ``by_key=False``, and a table whose splits already are two tasks a core is then left as it is.
    """
    cores, read = spark.sparkContext.defaultParallelism, table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return read if not by_key and even_tasks(read) >= 2 * cores else spread(read, "doc_id", 3 * cores)


def sentences(spark: SparkSession, folder: str, by_key: bool = True) -> DataFrame:
    """(doc_id, lang, source, pos, sentence) of all documents."""
    return sentences_of(documents(spark, folder, by_key))


def sentences_of(docs: DataFrame) -> DataFrame:
    split = explode_sentences(docs.select("doc_id", "lang", "source", "text"), "text")
    return split.withColumn("pos", F.col("pos").cast("bigint"))


def clause(sentence: Column) -> Column:
    """Text before the first clause mark."""
    return strip(F.regexp_extract(sentence, r"\A[^,;:]*", 0))


def short_words(sentence: Column) -> Column:
    """The words of at most eight characters."""
    return collapse_ws(F.regexp_replace(sentence, f"{NOT_WS}{{9,}}", ""))


def first_words(sentence: Column, n: int) -> Column:
    """The start of the sentence up to its n-th word, a prefix of it."""
    more = f"(?:{WS}+{NOT_WS}+){{0,{n - 1}}}"
    return F.regexp_extract(sentence, rf"\A{NOT_WS}+{more}", 0)


def pairs(spark: SparkSession, folder: str, by_key: bool = True) -> DataFrame:
    """(doc_id, pos, source, normal, clause, simple): each sentence with derived texts."""
    return pairs_of(sentences(spark, folder, by_key))


def pairs_of(cut: DataFrame) -> DataFrame:
    s = F.col("sentence")
    return cut.select(
        "doc_id", "pos", "source", s.alias("normal"), clause(s).alias("clause"), short_words(s).alias("simple"))


def strange_middle(text: Column, size: Column) -> Column:
    """The text with strange characters in its middle, ``size`` of them per character, at least one."""
    half = F.floor((F.length(text) + 1) / 2).cast("int")
    strange = F.repeat(F.lit(sql.STRANGE), F.greatest(F.lit(1), F.floor(F.length(text) * size + 0.5)).cast("int"))
    return F.concat(F.substring(text, F.lit(1), half), strange, F.substring(text, half + 1, F.length(text)))


def near_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`pairs` with ``near``, a near copy of the sentence whose ratio is known."""
    sizes = F.array(*[F.lit(sql.near_size(r)) for r in sql.NEAR_RATIOS])
    size = F.get(sizes, ((F.col("doc_id") + F.col("pos")) % 8).cast("int"))
    return pairs(spark, folder).withColumn("near", strange_middle(F.col("normal"), size))


def systems(spark: SparkSession, folder: str) -> DataFrame:
    """(system, normal, predicted, simple) for two derived systems: the clause, and the source itself."""
    made = F.array(F.struct(F.lit("clause").alias("system"), F.col("clause").alias("predicted")),
                   F.struct(F.lit("same").alias("system"), F.col("normal").alias("predicted")))
    return (pairs(spark, folder).withColumn("s", F.explode(made))
            .select("source", "s.system", "normal", "s.predicted", "simple"))


#: Names of the token columns of :func:`systems_with_tokens`, and of its columns of counts.
TOKENS = ("normal_tokens", "predicted_tokens", "simple_tokens")
COUNTS = ("normal_counts", "predicted_counts")


def systems_with_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`systems` with the tokens and counts of each text, made before the pairs are multiplied; a text that equals its source shares them."""
    cut = pairs(spark, folder, by_key=False).withColumns({"normal_tokens": sari_tokens(F.col("normal")), "normal_counts": text_counts(F.col("normal"))})

    def shared(name: str, known: str, made: Column) -> Column:
        return F.when(F.col(name) == F.col("normal"), F.col(known)).otherwise(made)

    cut = cut.withColumns({f"{c}_tokens": shared(c, "normal_tokens", sari_tokens(F.col(c))) for c in ("clause", "simple")}
                          | {"clause_counts": shared("clause", "normal_counts", text_counts(F.col("clause")))})
    made = F.array(*[F.struct(F.lit(name).alias("system"), F.col(c).alias("predicted"), F.col(f"{c}_tokens").alias("predicted_tokens"),
                              F.col(f"{c}_counts").alias("predicted_counts")) for name, c in (("clause", "clause"), ("same", "normal"))])
    return (cut.withColumn("s", F.explode(made))
            .select("source", "s.system", "normal", "s.predicted", "simple", "normal_tokens", "s.predicted_tokens", "simple_tokens",
                    "normal_counts", "s.predicted_counts"))


def candidates(spark: SparkSession, folder: str, by_key: bool = True, **known: Column) -> DataFrame:
    """(doc_id, pos, kind, normal, candidate) with candidates that break each gate rule.

    ``by_key`` as in :func:`documents`. ``known`` are further columns of a pair, made once for all its candidates.
    """
    kinds = {
        "clause": F.col("clause"),
        "short": F.col("simple"),
        "longer": F.concat("clause", F.lit(" indeed certainly moreover probably likely")),
        "dated": F.concat("clause", F.lit(" 1999 5%")),
        "same": F.concat(F.lit(" "), F.lower("normal")),
        "blank": F.lit(" "),
    }
    made = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("candidate")) for k, c in kinds.items()])
    return (pairs(spark, folder, by_key).withColumns(known).withColumn("c", F.explode(made))
            .select("doc_id", "pos", "c.kind", "normal", "c.candidate", *known))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """The events as timings: (session, stage, ts, id, seconds, words)."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("session"),
        F.when(F.col("event_type").isin("signup", "purchase"), "translate").otherwise("simplify").alias("stage"),
        "ts", F.col("event_id").alias("id"), F.col("value").alias("seconds"),
        F.get_json_object("props", "$.k").cast("int").alias("words"))
