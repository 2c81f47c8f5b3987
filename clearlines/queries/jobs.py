"""Whole jobs: sources, ladders with stand-in models, documents, translation, streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions.prompts import default_tokens
from clearlines.functions.text import decode_output
from clearlines.operators.answers import Answers
from clearlines.operators.generate import IDENTITY, Generator, generate, heuristic
from clearlines.operators.ladder import THREE, TWO, UNGATED, run_ladder
from clearlines.operators.scores import length_ratio
from clearlines.operators.translate import translate
from clearlines.plans.simplify import simplify, simplify_and_translate, simplify_by_rule
from clearlines.plans.staging import Staging, shuffles_removed
from clearlines.queries import sql
from clearlines.queries.data import TRIAL_LEXICON, documents, pairs, pairs_of, sentences, sentences_of, table
from clearlines.queries.registry import query
from clearlines.queries.text import TAG_SQL, TURNS_SQL, clean_translation_sql, cut, filled, with_language
from clearlines.sources import pairs as sources
from clearlines.streaming.documents import simplify_stream

TRIAL = heuristic(TRIAL_LEXICON)


# --- stand-in models (they travel by value; each attempt's prompt tells it which attempt it is) ---

def reader():
    """A function that takes a prompt apart: the number of the attempt, and the sentence."""
    templates = [(number, *template.split("{text}")) for number, template in (
        (1, fixed.STANDARD_PROMPT), (2, fixed.RETRY_PROMPT), (1, fixed.QUANTISED_PROMPT),
        (2, fixed.QUANTISED_RETRY_PROMPT), (3, fixed.QUANTISED_LAST_PROMPT), (1, fixed.MERGED_PROMPT))]

    def read(prompt):
        for number, before, after in templates:
            if prompt.startswith(before) and prompt.endswith(after):
                return number, prompt[len(before):len(prompt) - len(after)]
        raise ValueError("no known prompt")

    return read


def answering(answer):
    """A model that gives ``answer(attempt, sentence)`` to each prompt."""
    def build():
        read = reader()
        return lambda prompts, budgets: [answer(*read(p)) for p in prompts]

    return build


def shorter(attempt, sentence):
    """A start of the sentence, a shorter one at each attempt."""
    import re

    if attempt == 1:
        return re.match(r"[^,;:]*", sentence).group(0)
    return re.match(r"\S+(?:\s+\S+){0,%d}" % (5 if attempt == 2 else 2), sentence).group(0)


def failing(attempt, sentence):
    """The same, but some calls fail: by the sentence's length, at the first attempt or at all of them."""
    if len(sentence) % 11 == 0 or (attempt == 1 and len(sentence) % 7 == 0):
        raise RuntimeError("no answer")
    return shorter(attempt, sentence)


def nearly(attempt, sentence):
    """A near copy at the first attempt, then starts of the sentence."""
    if attempt > 1:
        return shorter(attempt, sentence)
    half = (len(sentence) + 1) // 2
    strange = max(1, int(len(sentence) * NEAR[len(sentence) % len(NEAR)] + 0.5))
    return sentence[:half] + STRANGE * strange + sentence[half:]


#: Well away from the gates' limits, for line feeds and runs of spaces inside a sentence are lost on the way.
NEAR = [sql.near_size(r) for r in (0.80, 0.86, 0.99, 0.995)]
STRANGE = sql.STRANGE
shortening_model, failing_model, near_model = answering(shorter), answering(failing), answering(nearly)


def echo_model():
    """Echoes the prompt and the sentence after it, as a model without training would."""
    read = reader()
    return lambda prompts, budgets: [p + read(p)[1] for p in prompts]


def echo_translator():
    return lambda texts, tag: list(texts)


# --- sources -----------------------------------------------------------------------------

def _as_csv(df):
    key = (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("pair_id")
    return df.select(key, F.col("normal").alias("Normal"), F.col("simple").alias("Simple"))


@query("read_pairs", f"""WITH {sql.PAIRS} SELECT doc_id * 1000000 + pos AS pair_id, nullif(normal, '') AS normal,
  nullif(simple, '') AS simple FROM pairs""")
def read_pairs(spark, folder):
    """Pairs written as CSV and read again by their key."""
    path = Staging(spark).path("pairs_csv")
    sources.write_csv(_as_csv(pairs(spark, folder)), path)
    return sources.read_pairs(spark, path, key="pair_id").select(
        "pair_id", F.nullif("normal", F.lit("")).alias("normal"), F.nullif("simple", F.lit("")).alias("simple"))


_SPLITS = ("train", "validation", "test")


@query("read_splits", f"""WITH {sql.PAIRS}, named AS (SELECT ['train', 'validation', 'test'][1 + doc_id % 3] AS split, * FROM pairs)
SELECT split, count(*) AS pairs, count(DISTINCT doc_id * 1000000 + pos) AS keys, count(nullif(simple, '')) AS simple,
  sum(length(normal))::BIGINT AS characters FROM named GROUP BY split""")
def read_splits(spark, folder):
    """Three files, one for each split, read as one table."""
    staging, whole = Staging(spark), pairs(spark, folder)
    for i, name in enumerate(_SPLITS):
        sources.write_csv(_as_csv(whole.where(F.col("doc_id") % 3 == i)), staging.path(name))
    read = sources.read_splits(spark, {name: staging.path(name) for name in _SPLITS}, key="pair_id")
    return read.groupBy("split").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("pair_id").alias("keys"),
        F.count(F.nullif("simple", F.lit(""))).alias("simple"), F.sum(F.length("normal")).alias("characters"))


@query("split_counts", """SELECT CASE quality WHEN 1 THEN 'train' WHEN 0 THEN 'validation' ELSE 'test' END AS split,
  count(*) AS documents FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def split_counts(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    split = F.when(F.col("quality") == 1, "train").when(F.col("quality") == 0, "validation").otherwise("test")
    joined = documents(spark, folder).select("doc_id").join(labels, "doc_id", "left")
    return joined.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("documents"))


@query("first_n", "SELECT doc_id, source, text FROM documents ORDER BY doc_id LIMIT 100")
def first_n(spark, folder):
    """The first 100 documents: a limit is what this operator is."""
    return sources.first_rows(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id", 100)


def _padded_sql(size: int) -> str:
    return f"""WITH {sql.PAIRS}, texts AS (SELECT doc_id, pos, {filled(fixed.TRAINING_TEXT, normal='normal', simple='simple')} AS t FROM pairs),
tokens AS (SELECT doc_id, pos, regexp_extract_all(t, {sql.lit(sql.NOT_WS + '+')}) AS k FROM texts),
parts AS (SELECT doc_id, pos, k, unnest(range((len(k) + {size - 1}) // {size})) AS part FROM tokens),
cut AS (SELECT doc_id, pos, part, k[part * {size} + 1:(part + 1) * {size}] AS k FROM parts)
SELECT doc_id, pos, part, repeat('<pad> ', {size} - len(k)) || array_to_string(k, ' ') AS tokens FROM cut"""


def _padded(spark, folder, size):
    made = sources.training_tokens(pairs(spark, folder).select("doc_id", "pos", "normal", "simple"), default_tokens, "<pad>", size)
    return made.select("doc_id", "pos", F.col("part").cast("bigint").alias("part"), F.array_join("tokens", " ").alias("tokens"))


@query("pad_tokens", _padded_sql(fixed.TRAINING_TOKENS))
def pad_tokens(spark, folder):
    return _padded(spark, folder, fixed.TRAINING_TOKENS)


@query("pad_tokens_parts", _padded_sql(48))
def pad_tokens_parts(spark, folder):
    """The same with few tokens a row, so that many texts go on in further rows."""
    return _padded(spark, folder, 48)


@query("aligned_files", f"""WITH {sql.PAIRS}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS pair_id FROM pairs)
SELECT pair_id, nullif(normal, '') AS normal, nullif(simple, '') AS simple, nullif(clause, '') AS predicted FROM numbered""")
def aligned_files(spark, folder):
    """Pairs and predictions as CSV folders without keys, cut into files at different rows, read back side by side.

    Documents are put in order before they are cut into sentences, so that each text moves once a folder.
    """
    staging, docs = Staging(spark), table(spark, folder, "documents")
    splits = 2 * docs.rdd.getNumPartitions()  # files of a bounded size, however large the table is

    def in_order(n):
        parts = docs.repartitionByRange(n + splits, "doc_id")
        return pairs_of(sentences_of(parts)).sortWithinPartitions("doc_id", "pos", "normal")

    normal, predicted = staging.path("normal.gz"), staging.path("predicted.gz")
    with shuffles_removed(spark):
        sources.write_csv(in_order(7).select(F.col("normal").alias("Normal"), F.col("simple").alias("Simple")), normal)
        sources.write_csv(in_order(4).select(F.col("clause").alias("Predicted")), predicted)
    read = sources.read_aligned(spark, normal, predicted)
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return read.select("pair_id", *[blank(c) for c in ("normal", "simple", "predicted")])


@query("predictions_round_trip", f"""WITH {sql.SYSTEMS} SELECT system, count(*) AS sentences,
  round(avg({sql.length_ratio('normal', 'predicted')}), 6) AS length_ratio FROM systems GROUP BY system""")
def predictions_round_trip(spark, folder):
    """Predictions written next to their sources by key, read back and scored."""
    base = pairs(spark, folder).select(F.concat_ws("-", "doc_id", "pos").alias("pair_id"), "normal", "simple", "clause")
    both = F.array(F.struct(F.lit("clause").alias("system"), F.col("clause").alias("predicted")),
                   F.struct(F.lit("same").alias("system"), F.col("normal").alias("predicted")))
    predictions = base.select("pair_id", F.inline(both))
    path = Staging(spark).path("predictions")
    sources.write_predictions(base.select("pair_id", "normal", "simple"), predictions, path)
    read = sources.read_predictions(spark, path)
    return read.groupBy("system").agg(
        F.count(F.lit(1)).alias("sentences"),
        F.round(F.avg(length_ratio(F.col("normal"), F.col("predicted"))), 6).alias("length_ratio"))


# --- simplifying ------------------------------------------------------------------------------

_JOINED = f"""parts AS (SELECT doc_id, array_to_string(list({{part}} ORDER BY pos), ' ') AS simplified FROM {{relation}} GROUP BY doc_id),
joined AS (SELECT d.doc_id, d.lang, d.source, d.text, coalesce(p.simplified, d.text) AS simplified FROM documents d LEFT JOIN parts p USING (doc_id))"""


def _joined(part: str, relation: str = "sentences") -> str:
    return _JOINED.replace("{part}", part).replace("{relation}", relation)


@query("split_join", f"WITH {sql.SENTENCES}, {_joined(sql.heuristic('sentence'))} SELECT doc_id, simplified FROM joined")
def split_join(spark, folder):
    """Rule-based simplification of whole documents, inside the row."""
    return simplify_by_rule(documents(spark, folder).select("doc_id", "text"), "text", TRIAL).select("doc_id", "simplified")


FLAGSHIP_SQL = f"""WITH {sql.SENTENCES}, {_joined(sql.heuristic('sentence'))}
SELECT lang, source, count(*) AS documents, round(avg({sql.length_ratio('text', 'simplified')}), 6) AS length_ratio,
  round(avg({sql.fkgl('text')}), 6) AS source_fkgl, round(avg({sql.fkgl('simplified')}), 6) AS simplified_fkgl
FROM joined GROUP BY lang, source"""


@query("flagship", FLAGSHIP_SQL)
def flagship(spark, folder):
    """Simplify every document and compare length and reading grade per language and source."""
    from clearlines.functions.readability import fkgl, text_counts

    done = simplify_by_rule(documents(spark, folder).select("lang", "source", "text"), "text", TRIAL)
    # in one step, so that the words of a text are counted once
    done = done.withColumns({"before": text_counts(F.col("text")), "after": text_counts(F.col("simplified")),
                             "ratio": length_ratio(F.col("text"), F.col("simplified"))})
    return done.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.round(F.avg("ratio"), 6).alias("length_ratio"),
        F.round(F.avg(fkgl(F.col("before"))), 6).alias("source_fkgl"),
        F.round(F.avg(fkgl(F.col("after"))), 6).alias("simplified_fkgl"))


def _sentences(spark, folder):
    return sentences(spark, folder).select("doc_id", "pos", "sentence")


def _decoded(x: str) -> str:
    """What decoding leaves of a model output without markers."""
    return sql.collapse(sql.first_sentence(cut(sql.strip(x))))


def _decoded_quantised(x: str) -> str:
    for stop in fixed.QUANTISED_STOPS:
        x = f"string_split({x}, {sql.lit(stop)})[1]"
    return sql.first_sentence(x)


_DECODED = _decoded("sentence")


@query("generate_identity", f"WITH {sql.SENTENCES} SELECT doc_id, pos, {_DECODED} AS decoded, TRUE AS fine FROM sentences")
def generate_identity(spark, folder):
    """A model that echoes prompt and sentence, and its output decoded."""
    from clearlines.functions.prompts import build_prompt

    asked = _sentences(spark, folder)
    answered = generate(asked, Generator(echo_model), build_prompt(F.col("sentence")), F.lit(48))
    return answered.select("doc_id", "pos", decode_output(F.col("raw")).alias("decoded"), F.col("error").isNull().alias("fine"))


@query("ungated", f"""WITH {sql.SENTENCES}, tried AS (SELECT doc_id, pos, sentence, {sql.clean(sql.first_sentence(sql.clause('sentence')))} AS t FROM sentences)
SELECT doc_id, pos, CASE WHEN t <> '' THEN t ELSE {sql.clean('sentence')} END AS simplified FROM tried""")
def ungated(spark, folder):
    return run_ladder(_sentences(spark, folder), ["doc_id", "pos"], Generator(shortening_model), UNGATED).drop("sentence", "error", "failed_calls")


# The stand-in model's tries are starts of the sentence, so every similarity has a closed form.
_TRY = {1: _decoded(sql.clause("sentence")), 2: _decoded(sql.first_words("sentence", 6))}


def _passes(candidate: str, ratio: str, loose: bool) -> str:
    return f"({sql.rule('sentence', candidate, loose, ratio)}) IS NULL"


def _start_ratio(t: str) -> str:
    """Similarity of a sentence and a start of it whose line feeds and double spaces became one space.

    Only the collapsed whitespace can differ; with none collapsed one contains the other.
    """
    return sql.bound("sentence", t)


_TWO_SQL = f"""tried AS (SELECT doc_id, pos, sentence, {_TRY[1]} AS t1, {_TRY[2]} AS t2 FROM sentences),
judged AS (SELECT *, {_passes('t1', _start_ratio('t1'), False)} AS ok1, {_passes('t2', _start_ratio('t2'), False)} AS ok2 FROM tried),
two AS (SELECT doc_id, pos, CASE WHEN ok1 THEN t1 WHEN ok2 THEN t2 WHEN length(t1) <= length(t2) THEN t1 ELSE t2 END AS t FROM judged),
laddered AS (SELECT doc_id, pos, {sql.clean('t', collapsed=False)} AS simplified FROM two)"""


@query("ladder_two", f"WITH {sql.SENTENCES}, {_TWO_SQL} SELECT doc_id, pos, simplified FROM laddered")
def ladder_two(spark, folder):
    """Two attempts by a model, each written once."""
    return run_ladder(_sentences(spark, folder), ["doc_id", "pos"], Generator(shortening_model), TWO).drop("sentence", "error", "failed_calls")


def _usable(clean: str, t: str) -> str:
    """Not a near copy and simpler; the full stop added by cleaning may match a later one in the sentence."""
    rest = f"substr(sentence, length({t}) + 1)"
    matches = f"length({t}) + CASE WHEN length({clean}) > length({t}) AND contains({rest}, '.') THEN 1 WHEN length({clean}) > length({t}) THEN 0 ELSE 0 END"
    ratio = f"2.0::DOUBLE * ({matches}) / (length(sentence) + length({clean}))"
    same = f"{sql.strip(f'lower({clean})')} = {sql.strip('lower(sentence)')}"
    return f"{clean} <> '' AND NOT ({same}) AND {ratio} < 0.985::DOUBLE AND {sql.simpler('sentence', clean)}"


_T3 = {1: _decoded_quantised(sql.clause("sentence")), 2: _decoded_quantised(sql.first_words("sentence", 6)),
       3: _decoded_quantised(sql.first_words("sentence", 3))}
_THREE_SQL = f"""tried AS (SELECT doc_id, pos, sentence, {', '.join(f'{t} AS t{i}' for i, t in _T3.items())} FROM sentences),
cleaned AS (SELECT *, {', '.join(f"{sql.clean(f't{i}')} AS c{i}" for i in _T3)} FROM tried),
judged AS (SELECT *, {', '.join(f"{_passes(f't{i}', _start_ratio(f't{i}'), True)} AS ok{i}" for i in _T3)},
  {', '.join(f"CASE WHEN {_usable(f'c{i}', f't{i}')} THEN c{i} END AS u{i}" for i in _T3)} FROM cleaned),
laddered AS (SELECT doc_id, pos, CASE WHEN ok1 THEN c1 WHEN ok2 THEN c2 WHEN ok3 THEN c3
  WHEN u1 IS NOT NULL AND length(u1) <= coalesce(length(u2), 1000000) AND length(u1) <= coalesce(length(u3), 1000000) THEN u1
  WHEN u2 IS NOT NULL AND length(u2) <= coalesce(length(u3), 1000000) THEN u2
  WHEN u3 IS NOT NULL THEN u3 ELSE {sql.heuristic('sentence', fixed.LEXICON)} END AS simplified FROM judged)"""


@query("ladder_three", f"WITH {sql.SENTENCES}, {_THREE_SQL} SELECT doc_id, pos, simplified FROM laddered")
def ladder_three(spark, folder):
    """Three attempts, the simplest usable try, the rules as a last resort."""
    return run_ladder(_sentences(spark, folder), ["doc_id", "pos"], Generator(shortening_model), THREE).drop("sentence", "error", "failed_calls")


# The near model: a sentence with strange characters in its middle, decoded (first sentence, one line).
_HALF = "(length(sentence) + 1) // 2"
_NEARLY = (f"(left(sentence, {_HALF}) || repeat('{STRANGE}', greatest(1, floor(length(sentence) * "
           f"[{', '.join(f'{n!r}::DOUBLE' for n in NEAR)}][1 + length(sentence) % {len(NEAR)}] + 0.5))::BIGINT) || substr(sentence, {_HALF} + 1))")


def _near_ratio(t: str) -> str:
    return sql.near_ratio("sentence", t)


@query("ladder_two_default", f"""WITH {sql.SENTENCES}, tried AS (SELECT doc_id, pos, sentence, {_decoded(_NEARLY)} AS t1, {_TRY[2]} AS t2 FROM sentences),
judged AS (SELECT *, {_passes('t1', _near_ratio('t1'), False)} AS ok1, {_passes('t2', _start_ratio('t2'), False)} AS ok2 FROM tried),
two AS (SELECT doc_id, pos, CASE WHEN ok1 THEN t1 WHEN ok2 THEN t2 WHEN length(t1) <= length(t2) THEN t1 ELSE t2 END AS t FROM judged)
SELECT doc_id, pos, {sql.clean('t', collapsed=False)} AS simplified FROM two""")
def ladder_two_default(spark, folder):
    """Near copies at the first attempt, so that the gate must ask ``difflib``."""
    done = run_ladder(_sentences(spark, folder), ["doc_id", "pos"], Generator(near_model), TWO)
    return done.select("doc_id", "pos", "simplified")


def _best_usable(names: str) -> str:
    u = [f"u{i}" for i in names]
    return "\n".join(f"WHEN {a} IS NOT NULL" + "".join(f" AND length({a}) <= coalesce(length({b}), 1000000)" for b in u[i + 1:])
                     + f" THEN {a}" for i, a in enumerate(u))


_N3 = {1: _decoded_quantised(_NEARLY), 2: _T3[2], 3: _T3[3]}
_NEAR_USABLE = ("c1 <> '' AND " + _near_ratio("c1") + f" < 0.95::DOUBLE AND {sql.simpler('sentence', 'c1')}")


@query("ladder_three_default", f"""WITH {sql.SENTENCES}, tried AS (SELECT doc_id, pos, sentence, {', '.join(f'{t} AS t{i}' for i, t in _N3.items())} FROM sentences),
cleaned AS (SELECT *, {', '.join(f"{sql.clean(f't{i}')} AS c{i}" for i in _N3)} FROM tried),
judged AS (SELECT *, {_passes('t1', _near_ratio('t1'), True)} AS ok1, {_passes('t2', _start_ratio('t2'), True)} AS ok2,
  {_passes('t3', _start_ratio('t3'), True)} AS ok3, CASE WHEN {_NEAR_USABLE} THEN c1 END AS u1,
  {', '.join(f"CASE WHEN {_usable(f'c{i}', f't{i}')} THEN c{i} END AS u{i}" for i in (2, 3))} FROM cleaned)
SELECT doc_id, pos, CASE WHEN ok1 THEN c1 WHEN ok2 THEN c2 WHEN ok3 THEN c3 {_best_usable('123')}
  ELSE {sql.heuristic('sentence', fixed.LEXICON)} END AS simplified FROM judged""")
def ladder_three_default(spark, folder):
    done = run_ladder(_sentences(spark, folder), ["doc_id", "pos"], Generator(near_model), THREE)
    return done.select("doc_id", "pos", "simplified")


_FAILS = "length(sentence) % 11 = 0"
_FAILS_1 = f"({_FAILS} OR length(sentence) % 7 = 0)"
_FAILING_SQL = f"""WITH {sql.SENTENCES}, tried AS (SELECT doc_id, pos, sentence,
  CASE WHEN NOT {_FAILS_1} THEN {_TRY[1]} END AS t1, CASE WHEN NOT {_FAILS} THEN {_TRY[2]} END AS t2,
  {', '.join(f"CASE WHEN NOT {_FAILS_1 if i == 1 else _FAILS} THEN {t} END AS q{i}" for i, t in _T3.items())},
  CASE WHEN NOT {_FAILS_1} THEN {sql.clean(sql.first_sentence(sql.clause('sentence')))} END AS g FROM sentences),
cleaned AS (SELECT *, {', '.join(f"{sql.clean(f'q{i}')} AS c{i}" for i in _T3)} FROM tried),
judged AS (SELECT *, t1 IS NOT NULL AND {_passes('t1', _start_ratio('t1'), False)} AS ok1,
  t2 IS NOT NULL AND {_passes('t2', _start_ratio('t2'), False)} AS ok2,
  {', '.join(f"q{i} IS NOT NULL AND {_passes(f'q{i}', _start_ratio(f'q{i}'), True)} AS fine{i}" for i in _T3)},
  {', '.join(f"CASE WHEN {_usable(f'c{i}', f'q{i}')} THEN c{i} END AS u{i}" for i in _T3)} FROM cleaned),
two AS (SELECT *, CASE WHEN ok1 THEN t1 WHEN ok2 THEN t2 WHEN t2 IS NULL THEN coalesce(t1, sentence)
  WHEN length(t1) <= length(t2) THEN t1 ELSE t2 END AS t FROM judged)
SELECT 'two' AS ladder, doc_id, pos, {sql.clean('t', collapsed=False)} AS simplified,
  {_FAILS_1}::BIGINT + (NOT ok1 AND {_FAILS})::BIGINT AS failed_calls FROM two
UNION ALL SELECT 'three', doc_id, pos, CASE WHEN fine1 THEN c1 WHEN fine2 THEN c2 WHEN fine3 THEN c3 {_best_usable('123')}
  ELSE {sql.heuristic('sentence', fixed.LEXICON)} END,
  {_FAILS_1}::BIGINT + (NOT fine1 AND {_FAILS})::BIGINT + (NOT fine1 AND NOT fine2 AND {_FAILS})::BIGINT FROM judged
UNION ALL SELECT 'ungated', doc_id, pos, CASE WHEN g <> '' THEN g ELSE {sql.clean('sentence')} END, {_FAILS_1}::BIGINT FROM judged"""


@query("ladder_failing_calls", _FAILING_SQL)
def ladder_failing_calls(spark, folder):
    """A model some of whose calls fail: every sentence stays, and every failed call is counted."""
    done = [run_ladder(_sentences(spark, folder), ["doc_id", "pos"], Generator(failing_model), ladder)
            .select(F.lit(name).alias("ladder"), "doc_id", "pos", "simplified", "failed_calls")
            for name, ladder in (("two", TWO), ("three", THREE), ("ungated", UNGATED))]
    return done[0].unionByName(done[1]).unionByName(done[2])


@query("simplify_model", f"""WITH {sql.SENTENCES}, {_TWO_SQL}, {_joined('simplified', 'laddered')}, counted AS (
  SELECT doc_id, count(*) AS n FROM sentences GROUP BY doc_id)
SELECT joined.doc_id, simplified, coalesce(n, 0) AS sentences, 0::BIGINT AS failed_calls FROM joined LEFT JOIN counted USING (doc_id)""")
def simplify_model(spark, folder):
    """Documents through the two-attempt ladder and back."""
    docs = documents(spark, folder).select("doc_id", "text")
    return simplify(docs, generator=Generator(shortening_model), ladder=TWO).drop("text")


def _answered_twice(spark, folder):
    """The two-attempt ladder over all sentences, twice with one table of answers: the second run, and the table."""
    answers = Answers(Staging(spark).path("answers"), "shortening")
    for run in ("first", "second"):
        done = run_ladder(_sentences(spark, folder), ["doc_id", "pos"], Generator(shortening_model), TWO,
                          answers=replace(answers, run=run))
    return done, answers.read(spark)


@query("ladder_answers", f"WITH {sql.SENTENCES}, {_TWO_SQL} SELECT doc_id, pos, simplified FROM laddered")
def ladder_answers(spark, folder):
    """A second run takes every answer from the table that the first one filled."""
    return _answered_twice(spark, folder)[0].select("doc_id", "pos", "simplified")


@query("answers_asked", f"""WITH {sql.SENTENCES}, {_TWO_SQL}
SELECT 'first' AS run, count(DISTINCT sentence) + count(DISTINCT CASE WHEN NOT ok1 THEN sentence END) AS calls FROM judged""")
def answers_asked(spark, folder):
    """How many prompts each of the two runs asked: each distinct one once, and none in the second run."""
    return _answered_twice(spark, folder)[1].groupBy("run").agg(F.count(F.lit(1)).alias("calls"))


# --- translating --------------------------------------------------------------------------------

@query("translate_identity", f"""WITH {TURNS_SQL}, tagged AS (SELECT conv_id, turn, language, 'eng_Latn ' || {TAG_SQL} || ' ' || text AS t FROM turns)
SELECT conv_id, turn, language, {clean_translation_sql('t')} AS translated FROM tagged""")
def translate_identity(spark, folder):
    turns = with_language(table(spark, folder, "conversations"))
    return translate(turns, "text", "language", echo_translator).select("conv_id", "turn", "language", "translated")


_TWO_LANGUAGES = f"""tagged AS (SELECT doc_id, 'Tamil' AS language, 'eng_Latn tam_Taml ' || simplified AS t FROM joined
  UNION ALL SELECT doc_id, 'Latin', 'eng_Latn hin_Deva ' || simplified FROM joined)"""


@query("simplify_and_translate", f"""WITH {sql.SENTENCES}, {_joined(sql.clean(_DECODED, collapsed=False))}, {_TWO_LANGUAGES}
SELECT doc_id, language, {clean_translation_sql('t')} AS translated FROM tagged""")
def both_stages(spark, folder):
    """Both stages with stand-ins for the models, into a known and an unknown language."""
    docs = documents(spark, folder).select("doc_id", "text")
    ungated_two = replace(TWO, gate=None, fallback="source", collapse=False)
    done = simplify_and_translate(docs, echo_translator, ["Tamil", "Latin"], generator=IDENTITY, ladder=ungated_two)
    return done.select("doc_id", "language", "translated")


@query("simplify_model_and_translate", f"""WITH {sql.SENTENCES}, {_TWO_SQL}, {_joined('simplified', 'laddered')}, {_TWO_LANGUAGES}
SELECT doc_id, language, {clean_translation_sql('t')} AS translated FROM tagged""")
def both_stages_by_models(spark, folder):
    """A gated model, its results written, and a translator that is asked once for each text."""
    docs = documents(spark, folder).select("doc_id", "text")
    done = simplify_and_translate(docs, echo_translator, ["Tamil", "Latin"], generator=Generator(shortening_model), ladder=TWO)
    return done.select("doc_id", "language", "translated")


# --- streams ----------------------------------------------------------------------------------------

def _stream(spark, folder, name):
    """The table, one file or a folder of parts: a stream's path must be a folder or a pattern, and this one fits both."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


@query("stream_simplify", f"WITH {sql.SENTENCES}, {_joined(sql.heuristic('sentence'))} SELECT doc_id, simplified FROM joined")
def stream_by_rule(spark, folder):
    """The documents as a stream through the rule."""
    staging = Staging(spark)
    docs = _stream(spark, folder, "documents").select("doc_id", "text")
    simplify_stream(docs, staging.path("out"), staging.path("state"), TRIAL,
                    partitions=3 * spark.sparkContext.defaultParallelism).awaitTermination()
    return spark.read.parquet(staging.path("out")).select("doc_id", "simplified")


@query("stream_simplify_model", f"""WITH {sql.SENTENCES}, {_TWO_SQL}, {_joined('simplified', 'laddered')}
SELECT doc_id, simplified FROM joined""")
def stream_by_model(spark, folder):
    """The documents as a stream through the two-attempt ladder, batch by batch."""
    staging = Staging(spark)
    docs = _stream(spark, folder, "documents").select("doc_id", "text")
    simplify_stream(docs, staging.path("out"), staging.path("state"), Generator(shortening_model), TWO).awaitTermination()
    return spark.read.parquet(staging.path("out")).select("doc_id", "simplified")


@query("stream_ladder", f"""WITH {sql.SENTENCES}, {_TWO_SQL}, {_joined('simplified', 'laddered')}, counted AS (
  SELECT doc_id, count(*) AS n FROM sentences GROUP BY doc_id)
SELECT joined.doc_id, simplified, coalesce(n, 0) AS sentences, 0::BIGINT AS failed_calls FROM joined LEFT JOIN counted USING (doc_id)""")
def stream_ladder(spark, folder):
    """The documents as a stream through the two-attempt ladder inside one streaming plan."""
    staging = Staging(spark)
    docs = _stream(spark, folder, "documents").select("doc_id", "text")
    simplify_stream(docs, staging.path("out"), staging.path("state"), Generator(shortening_model), TWO,
                    partitions=3 * spark.sparkContext.defaultParallelism, in_row=True).awaitTermination()
    return spark.read.parquet(staging.path("out")).select("doc_id", "simplified", "sentences", "failed_calls")
