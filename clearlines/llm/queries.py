"""The operators' queries over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearlines.llm import bpe, covertree, embeddings, language, licenses, lines, neardup, packing, periods, quality, secrets, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = lines.quality_rules(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def trained_quality(docs: DataFrame, labels: DataFrame):
    """Weights learned from the rows that are not held out."""
    return quality.fit(docs, labels.where(~quality.held_out("doc_id", 4, 2)))


@query
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality.score(docs, trained_quality(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", quality.held_out("doc_id", 4, 2).alias("held_out"), "score",
                         (F.col("score") >= quality.GOOD).cast("int").alias("predicted"))


@query
def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "kept")


@query
def op5_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.license_scan(table(spark, folder, "documents"))
    of = lambda name: F.transform(F.col(name), lambda x: x["label"])
    place = F.transform("base", lambda x: x["word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    certain = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)),
                         F.when(F.size("base") > 0, F.lit(0.6)).otherwise(F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                        F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
                        joined(of("base")).alias("base_labels"),
                        joined(F.concat(of("base"), of("detections"))).alias("labels"), certain.alias("score"))


@query
def op6_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op7_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query
def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    away = quality.held_out("doc_id", 3, 1)
    found = language.identify(docs, language.learn(docs, ~away))
    return found.select("doc_id", away.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op11_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    found = covertree.top_inner_products(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = periods.periodic_runs(docs.select("doc_id", planted_periods().alias("text")), digest=True)
    line = lambda r: F.concat(F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]), F.lit("\n"))
    listed = F.array_join(F.transform("runs", line), "")
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent,
                        F.sha2(listed, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def planted_periods(key: str = "doc_id", text: str = "text") -> Column:
    """The text; of every tenth document (by the hash of its id) one that repeats itself from some word on."""
    h, words = F.crc32(F.col(key).cast("string")), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size(words)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        at = lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), at), " ")

    made = F.get(F.transform(F.array(words), repeated), 0)  # words are split once
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(F.col(text))


_WORD = r"[^\x20\x09-\x0D]"
_PLAIN = r"regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{N}]+', '', 'g'), '\p{N}', '0', 'g')"
ORACLES["op2_quality_rules"] = f"""WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}+') AS w, string_split(text, chr(10)) AS lines, text FROM texts),
facts AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}')))) AS n_dup_lines
  FROM tokens),
windows AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM tokens WHERE len(w) >= 3),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM counted, range(0, 3) AS inside(k) WHERE counted.n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM texts),
plain AS (SELECT doc_id, source, {_PLAIN} AS line FROM lines),
long AS (SELECT * FROM plain WHERE line <> ''),
hot AS (SELECT source, line FROM long GROUP BY source, line HAVING count(DISTINCT doc_id) > {lines.LIMIT}),
lost AS (SELECT doc_id, sum(CASE WHEN hot.line IS NOT NULL THEN length(long.line) ELSE 0 END) > {lines.DEPLETED} * sum(length(long.line)) AS depleted
  FROM long LEFT JOIN hot ON long.line = hot.line AND long.source IS NOT DISTINCT FROM hot.source GROUP BY doc_id),
judged AS (SELECT facts.*, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(depleted, FALSE) AS depleted,
  n_words < 50 OR 100 * coalesce(repeated.n, 0) > 50 * n_words AS base_failed
  FROM facts LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept FROM judged"""

ORACLES["op11_exact_top_k"] = """WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM vectors q JOIN vectors d
  ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5"""

ORACLES["op7_embedding_near_dedup"] = f"""WITH RECURSIVE vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS one, b.vec_id AS other FROM vectors a JOIN vectors b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {embeddings.THRESHOLD}::DOUBLE),
reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.other FROM reached r JOIN links l ON r.other = l.one),
groups AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
counts AS (SELECT one AS vec_id, count(*) AS n FROM links GROUP BY one)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM groups LEFT JOIN counts USING (vec_id)"""


def _split_sql(url: str) -> tuple[str, str]:
    """Host and path of a URL, as SQL."""
    rest = f"(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END)"
    host = f"regexp_extract({rest}, '^[^/?#]*')"
    return f"translate({host}, '{urls._UPPER}', '{urls._LOWER}')", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def _rule_sql(host: str, path: str) -> str:
    fits = [f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r.site}'"
            for r in sorted(urls.RULES, key=lambda r: -len(r.site))]
    return f"(CASE {' '.join(fits)} END)"


def _address_sql(url: str) -> str:
    rest = f"regexp_extract(substr({url}, instr({url}, '://') + 3), '^[^/?#]*([^#]*)', 1)"
    scheme = f"translate(split_part({url}, '://', 1), '{urls._UPPER}', '{urls._LOWER}')"
    return (f"(CASE WHEN instr({url}, '://') > 0 THEN {scheme} || '://' || {_split_sql(url)[0]} || "
            f"CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END)")


_HOST, _PATH = _split_sql("url")
_VERDICT = "CASE rule " + " ".join(f"WHEN '{r.site}' THEN '{r.verdict}'" for r in urls.RULES) + " END"
_QUOTE = "[\"'']?"
ORACLES["op8_url_filters"] = rf"""WITH RECURSIVE tags AS (SELECT url,
  regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*{_QUOTE}canonical\b[^>]*>') AS a,
  regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*{_QUOTE}refresh\b[^>]*>') AS b FROM pages),
found AS (SELECT url, replace(coalesce(nullif(regexp_extract(a, '(?is)\bhref\s*=\s*{_QUOTE}([^"''\s>]+)', 1), ''),
  nullif(regexp_extract(b, '(?is)\burl\s*=\s*([^"''\s>]+)', 1), '')), '&amp;', '&') AS link FROM tags),
targets AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
  WHEN starts_with(link, '//') THEN split_part(url, '://', 1) || ':' || link
  WHEN starts_with(link, '/') THEN split_part(url, '://', 1) || '://' || {_HOST} || link END AS target FROM found),
edges AS (SELECT {_address_sql('url')} AS one, {_address_sql('target')} AS other FROM targets),
links AS (SELECT one, other FROM edges WHERE one <> other UNION SELECT other, one FROM edges WHERE one <> other),
reached AS (SELECT one AS start, one AS node FROM links UNION SELECT r.start, l.other FROM reached r JOIN links l ON r.node = l.one),
ruled AS (SELECT node, {_rule_sql(*_split_sql("node"))} AS rule FROM (SELECT DISTINCT node FROM reached)),
carried AS (SELECT start, min({_VERDICT}) AS carried FROM reached JOIN ruled USING (node) GROUP BY start),
judged AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_rule_sql(_HOST, _PATH)} AS rule, {_address_sql('url')} AS start FROM pages)
SELECT page_id, host, path, rule, coalesce({_VERDICT}, carried, 'allow') AS verdict FROM judged LEFT JOIN carried USING (start)"""
