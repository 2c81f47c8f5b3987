"""Text operators over every sentence (or document, or turn) of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions import languages, prompts, readability, rewrite, similarity, terms, text
from clearlines.operators.lexicon import replace_terms
from clearlines.queries import sql
from clearlines.queries.data import TRIAL_LEXICON, clause, documents, near_pairs, pairs, sentences, table
from clearlines.queries.registry import query


def _per_sentence(name: str, column, expression: str):
    """Register (doc_id, pos, value) for one function of the sentence."""
    statement = f"WITH {sql.SENTENCES} SELECT doc_id, pos, {expression} AS value FROM sentences"

    @query(name, statement)
    def run(spark, folder):
        return sentences(spark, folder).select("doc_id", "pos",
                                               column(F.col("sentence")).alias("value"))


def _sorted_text(items):
    return F.array_join(F.sort_array(items), "|")


@query("split_sentences", f"WITH {sql.SENTENCES} SELECT doc_id, pos, sentence FROM sentences")
def split_sentences(spark, folder):
    return sentences(spark, folder).select("doc_id", "pos", "sentence")


@query("first_sentence", f"SELECT doc_id, {sql.first_sentence('text')} AS value FROM documents")
def first_sentence(spark, folder):
    return documents(spark, folder).select("doc_id", text.first_sentence(F.col("text")).alias("value"))


@query("collapse_ws", f"SELECT doc_id, {sql.collapse('text')} AS value FROM documents")
def collapse_ws(spark, folder):
    return documents(spark, folder).select("doc_id", text.collapse_ws(F.col("text")).alias("value"))


_per_sentence("clean_sentence", lambda s: text.clean_sentence(F.lower(clause(s))), sql.clean("lower(" + sql.clause("sentence") + ")"))
_per_sentence("extract_numbers", lambda s: _sorted_text(terms.extract_numbers(s)), sql.joined(sql.numbers("sentence")))
_per_sentence("key_terms", lambda s: _sorted_text(terms.key_terms(s)), sql.joined(sql.terms("sentence")))
_per_sentence("lexicon_replace", lambda s: rewrite.lexicon_replace(s, TRIAL_LEXICON), sql.lexicon("sentence"))
_per_sentence("first_clause", rewrite.first_clause, sql.first_clause("sentence"))
_per_sentence("heuristic_simplify", lambda s: rewrite.heuristic_simplify(s, TRIAL_LEXICON), sql.heuristic("sentence"))


# Every word of 8 and more letters of the documents is an entry, so the lexicon grows with them.
_LEXICON_TABLE = r"""WITH tokens AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]')) AS token,
           generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]'), 1) AS i FROM documents),
  lexicon AS (SELECT DISTINCT lower(token) AS key FROM tokens WHERE regexp_full_match(token, '[A-Za-z]{8,}')),
  made AS (SELECT doc_id, string_agg(coalesce(left(key, 4) || '.', token), '' ORDER BY i) AS value
           FROM tokens LEFT JOIN lexicon ON lower(token) = key GROUP BY doc_id)
  SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(value, '') END AS value FROM documents LEFT JOIN made USING (doc_id)"""


def _with_lexicon_table(spark, folder, **options):
    docs = documents(spark, folder).select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word"))
    key = F.lower("word").alias("key")
    lexicon = words.where(F.col("word").rlike(r"\A[A-Za-z]{8,}\z")).select(key).distinct()
    lexicon = lexicon.select("key", F.concat(F.left("key", F.lit(4)), F.lit(".")).alias("replacement"))
    return replace_terms(docs, "text", lexicon, "value", "doc_id", **options).select("doc_id", "value")


@query("lexicon_table", _LEXICON_TABLE)
def lexicon_table(spark, folder):
    return _with_lexicon_table(spark, folder)


@query("lexicon_table_joined", _LEXICON_TABLE)
def lexicon_table_joined(spark, folder):
    """The same where no entry may be broadcast."""
    return _with_lexicon_table(spark, folder, broadcast_bytes=-1)


def _model_output(prompt, answer):
    """What a model that echoes its prompt and runs on would return."""
    return F.concat(F.lit(" "), prompt, answer, F.lit(" And more.\n\n### Input:\nnext ### Response"))


_RESPONSES = {
    "echo": (lambda t: _model_output(prompts.build_prompt(t), t),
             "' ' || " + " || ".join([sql.lit(fixed.STANDARD_PROMPT.split("{text}")[0]), "text",
                                      sql.lit(fixed.STANDARD_PROMPT.split("{text}")[1]), "text"])
             + " || ' And more.' || chr(10) || chr(10) || '### Input:' || chr(10) || 'next ### Response'"),
    "short": (lambda t: F.concat(F.lit("Simplified: "), t, F.lit(" Simple: x "), t), "'Simplified: ' || text || ' Simple: x ' || text"),
    "plain": (lambda t: t, "text"),
}
_OUTPUTS = "outputs AS (" + " UNION ALL ".join(
    f"SELECT conv_id, turn, '{k}' AS kind, {s} AS raw FROM conversations" for k, (_, s) in _RESPONSES.items()) + ")"


def _outputs(spark, folder):
    made = F.array(*[F.struct(F.lit(k).alias("kind"), f(F.col("text")).alias("raw")) for k, (f, _) in _RESPONSES.items()])
    turns = table(spark, folder, "conversations")
    return turns.withColumn("o", F.explode(made)).select("conv_id", "turn", "o.kind", "o.raw")


def _extracted(x, markers=fixed.RESPONSE_MARKERS):
    """The part after the last occurrence of the first marker present (marker by marker)."""
    options = "".join(f"WHEN contains({x}, {sql.lit(m)}) THEN list_last(string_split({x}, {sql.lit(m)})) " for m in markers)
    return sql.strip(f"CASE {options} ELSE {x} END")


def cut(x, stops=fixed.STOP_MARKERS):
    for stop in stops:
        x = sql.strip(f"string_split({x}, {sql.lit(stop)})[1]")
    return x


_STEP_SQL = (f"WITH {_OUTPUTS}, taken AS (SELECT conv_id, turn, kind, {_extracted('raw')} AS response FROM outputs), "
             f"stopped AS (SELECT *, {cut('response')} AS stopped FROM taken) ")


@query("extract_response", _STEP_SQL + "SELECT conv_id, turn, kind, response AS value FROM stopped")
def extract_response(spark, folder):
    return _outputs(spark, folder).select("conv_id", "turn", "kind", text.extract_response(F.col("raw")).alias("value"))


@query("cut_at_stop", f"WITH {_OUTPUTS} SELECT conv_id, turn, kind, {cut('raw')} AS value FROM outputs")
def cut_at_stop(spark, folder):
    return _outputs(spark, folder).select("conv_id", "turn", "kind", text.cut_at_stop(F.col("raw")).alias("value"))


@query("decode_output", _STEP_SQL + f"SELECT conv_id, turn, kind, {sql.collapse(sql.first_sentence('stopped'))} AS value FROM stopped")
def decode_output(spark, folder):
    return _outputs(spark, folder).select("conv_id", "turn", "kind", text.decode_output(F.col("raw")).alias("value"))


@query("surface_stats", f"""WITH {sql.SENTENCES} SELECT doc_id, pos, {sql.count('sentence', '[A-Za-z]+')} AS tokens,
  round(coalesce(length({sql.replace_all('sentence', '[^A-Za-z]+', '')})::DOUBLE
    / nullif({sql.count('sentence', '[A-Za-z]+')}, 0), 0), 6) AS mean_length,
  {sql.count('sentence', '[A-Za-z]{9,}')} AS long_words FROM sentences""")
def surface_stats(spark, folder):
    s = F.col("sentence")
    return sentences(spark, folder).select(
        "doc_id", "pos", terms.token_count(s).cast("bigint").alias("tokens"),
        F.round(terms.avg_word_len(s), 6).alias("mean_length"), terms.long_word_count(s).cast("bigint").alias("long_words"))


@query("strip_the", f"""WITH {sql.PAIRS} SELECT doc_id, pos,
  CASE WHEN lower(clause) = lower(normal) THEN {sql.strip("replace(clause, 'the ', '')")} ELSE clause END AS value FROM pairs""")
def strip_the(spark, folder):
    copied = F.lower("clause") == F.lower("normal")
    return pairs(spark, folder).select("doc_id", "pos",
                                       rewrite.strip_the(F.col("clause"), copied).alias("value"))


def _spaced(x):
    """Text with the loose spacing that translated output shows."""
    return F.regexp_replace(x, r"([,.!?])", ' $1 ( " ) ')


_SPACED = sql.replace_all("text", "([,.!?])", ' \\1 ( " ) ')


def clean_translation_sql(x: str) -> str:
    x = sql.replace_all(x, sql.WS + "+", " ")
    x = sql.replace_all(x, sql.WS + "+([।,;:!?])", "\\1")
    x = sql.replace_all(x, '([("])' + sql.WS + "+", "\\1")
    return sql.strip(sql.replace_all(x, sql.WS + '+([)"])', "\\1"))


@query("clean_translation", f"SELECT doc_id, {clean_translation_sql(_SPACED)} AS value FROM documents")
def clean_translation(spark, folder):
    return documents(spark, folder).select("doc_id", languages.clean_translation(_spaced(F.col("text"))).alias("value"))


# every name of the table, and one that is not in it
NAMES = [*fixed.LANGUAGES, "Klingon"]
NAMES_SQL = "[" + ", ".join(sql.lit(n) for n in NAMES) + "]"
TAG_SQL = "CASE " + " ".join(f"WHEN language = '{n}' THEN '{t}'" for n, t in fixed.LANGUAGES.items()) + " ELSE 'hin_Deva' END"
KNOWN_SQL = "[" + ", ".join(sql.lit(t) for t in fixed.LANGUAGES.values()) + "]"
TURNS_SQL = f"""turns AS (SELECT *, {NAMES_SQL}[(conv_id + turn) % 12 + 1] AS language FROM conversations)"""


def with_language(turns):
    """A language name for every turn, by its number."""
    at = ((F.col("conv_id") + F.col("turn")) % len(NAMES) + 1).cast("int")
    return turns.withColumn("language", F.element_at(F.array(*[F.lit(n) for n in NAMES]), at))


@query("language_lookup", f"""WITH {TURNS_SQL} SELECT language, {TAG_SQL} AS tag, count(*) AS turns FROM turns GROUP BY 1, 2""")
def language_lookup(spark, folder):
    turns = with_language(table(spark, folder, "conversations"))
    return (turns.groupBy("language").agg(F.count(F.lit(1)).alias("turns"))
            .select("language", languages.language_tag(F.col("language")).alias("tag"), "turns"))


@query("ensure_lang_tags", f"""WITH {TURNS_SQL}, given AS (
  SELECT conv_id, turn, {TAG_SQL} AS tag, CASE WHEN role = 'user' THEN text WHEN role = 'system' THEN 'eng_Latn xxx_Xxxx ' || text
    ELSE 'eng_Latn tam_Taml ' || text END AS t FROM turns)
SELECT conv_id, turn, CASE WHEN len(string_split(t, ' ')) >= 3 AND string_split(t, ' ')[1] = 'eng_Latn'
  AND list_contains({KNOWN_SQL}, string_split(t, ' ')[2]) THEN t ELSE 'eng_Latn ' || tag || ' ' || t END AS value FROM given""")
def ensure_lang_tags(spark, folder):
    turns = with_language(table(spark, folder, "conversations"))
    given = (F.when(F.col("role") == "user", F.col("text"))
             .when(F.col("role") == "system", F.concat(F.lit("eng_Latn xxx_Xxxx "), "text"))
             .otherwise(F.concat(F.lit("eng_Latn tam_Taml "), "text")))
    return turns.select("conv_id", "turn", languages.ensure_lang_tags(
        given, languages.language_tag(F.col("language"))).alias("value"))


_TEMPLATES = {
    "standard": fixed.STANDARD_PROMPT, "retry": fixed.RETRY_PROMPT, "quantised": fixed.QUANTISED_PROMPT,
    "quantised_retry": fixed.QUANTISED_RETRY_PROMPT, "quantised_last": fixed.QUANTISED_LAST_PROMPT,
    "merged": fixed.MERGED_PROMPT,
}


def filled(template: str, **values: str) -> str:
    for name, column in values.items():
        template = template.replace("{" + name + "}", "\0" + column + "\0")
    parts = [p if i % 2 else sql.lit(p) for i, p in enumerate(template.split("\0"))]
    return "(" + " || ".join(parts) + ")"


@query("build_prompt", " UNION ALL ".join(
    f"SELECT conv_id, turn, '{k}' AS template, {filled(t, text='text')} AS prompt FROM conversations" for k, t in _TEMPLATES.items()))
def build_prompt(spark, folder):
    made = F.array(*[F.struct(F.lit(k).alias("template"), prompts.build_prompt(F.col("text"), t).alias("prompt"))
                     for k, t in _TEMPLATES.items()])
    return table(spark, folder, "conversations").select("conv_id", "turn", F.inline(made))


@query("training_text", f"""WITH {sql.PAIRS} SELECT doc_id, pos,
  {filled(fixed.TRAINING_TEXT, normal='normal', simple='simple')} AS text FROM pairs""")
def training_text(spark, folder):
    return pairs(spark, folder).select("doc_id", "pos",
                                       prompts.training_text(F.col("normal"), F.col("simple")).alias("text"))


@query("generation_budget", f"""WITH {sql.SENTENCES} SELECT doc_id, pos,
  least(256, greatest({sql.words('sentence')}, 24), 48)::BIGINT AS budget FROM sentences""")
def generation_budget(spark, folder):
    size = F.size(prompts.default_tokens(F.col("sentence")))
    return sentences(spark, folder).select("doc_id", "pos",
                                           prompts.generation_budget(size).cast("bigint").alias("budget"))


@query("readability", f"""WITH {sql.SYSTEMS} SELECT source, system, count(*) AS sentences,
  round(avg({sql.fkgl('normal')}), 6) AS source_fkgl, round(avg({sql.fkgl('predicted')}), 6) AS predicted_fkgl,
  round(avg({sql.fre('normal')}), 6) AS source_fre, round(avg({sql.fre('predicted')}), 6) AS predicted_fre
FROM systems GROUP BY source, system""")
def readability_by_source(spark, folder):
    from clearlines.queries.data import systems

    counted = systems(spark, folder).withColumns({
        "n": readability.text_counts(F.col("normal")), "p": readability.text_counts(F.col("predicted"))})
    return counted.groupBy("source", "system").agg(
        F.count(F.lit(1)).alias("sentences"),
        F.round(F.avg(readability.fkgl(F.col("n"))), 6).alias("source_fkgl"),
        F.round(F.avg(readability.fkgl(F.col("p"))), 6).alias("predicted_fkgl"),
        F.round(F.avg(readability.fre(F.col("n"))), 6).alias("source_fre"),
        F.round(F.avg(readability.fre(F.col("p"))), 6).alias("predicted_fre"))


@query("similarity_bounds", f"""WITH {sql.PAIRS} SELECT doc_id, pos, round({sql.bound('normal', 'clause')}, 6) AS clause_bound,
  round({sql.bound('normal', 'simple')}, 6) AS simple_bound FROM pairs""")
def similarity_bounds(spark, folder):
    n = F.col("normal")
    return pairs(spark, folder).select(
        "doc_id", "pos",
        F.round(similarity.length_bound(n, F.col("clause")), 6).alias("clause_bound"),
        F.round(similarity.length_bound(n, F.col("simple")), 6).alias("simple_bound"))


@query("similarity_whole", f"""WITH {sql.PAIRS} SELECT doc_id, pos, round({sql.bound('normal', 'clause')}, 6) AS ratio FROM pairs""")
def similarity_whole(spark, folder):
    """Ratio of sentence and clause with frequent characters counted (one contains the other)."""
    ratio = similarity.similarity_ratio(F.col("normal"), F.col("clause"))
    return pairs(spark, folder).select("doc_id", "pos", F.round(ratio, 6).alias("ratio"))


@query("similarity_ratio", f"WITH {sql.NEAR} SELECT doc_id, pos, round({sql.near_ratio('normal', 'near')}, 9) AS ratio FROM near_pairs")
def similarity_ratio(spark, folder):
    """Ratio of a sentence and a near copy: neither holds the other, so each pair is asked of ``difflib``."""
    ratio = similarity.similarity_ratio(F.col("normal"), F.col("near"))
    return near_pairs(spark, folder).select("doc_id", "pos", F.round(ratio, 9).alias("ratio"))
