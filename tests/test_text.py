"""Column functions against small Python versions, over documents and awkward texts."""

import re

import plain
import pytest
from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions import languages, prompts, readability, rewrite, sari, terms, text


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").cache()


def values(df, column):
    return [r.v for r in df.select("id", column.alias("v")).orderBy("id").collect()]


T = "t"

CASES = {
    "strip": (lambda: text.strip(F.col(T)), str.strip),
    "collapse": (lambda: text.collapse_ws(F.col(T)), lambda t: " ".join(t.split())),
    "word_count": (lambda: text.word_count(F.col(T)), lambda t: len(t.split())),
    "words": (lambda: text.words(F.col(T)), str.split),
    "split": (lambda: text.split_sentences(F.col(T)), plain.split),
    "sentence_count": (lambda: text.sentence_count(F.col(T)), lambda t: len(plain.split(t))),
    "first_sentence": (lambda: text.first_sentence(F.col(T)), plain.first_sentence),
    "clean": (lambda: text.clean_sentence(F.col(T)), plain.clean),
    "clean_trim": (lambda: text.clean_sentence(F.col(T), collapse=False), lambda t: plain.clean(t, False)),
    "numbers": (lambda: F.sort_array(terms.extract_numbers(F.col(T))), lambda t: sorted(plain.numbers(t))),
    "terms": (lambda: F.sort_array(terms.key_terms(F.col(T))), lambda t: sorted(plain.terms(t, fixed.STOP_WORDS))),
    "tokens": (lambda: terms.token_count(F.col(T)), lambda t: len(plain.letters(t))),
    "long_words": (lambda: terms.long_word_count(F.col(T)), lambda t: sum(len(w) >= 9 for w in plain.letters(t))),
    "lexicon": (lambda: rewrite.lexicon_replace(F.col(T)), lambda t: plain.replace_words(t, fixed.LEXICON)),
    "lexicon_trial": (lambda: rewrite.lexicon_replace(F.col(T), TRIAL), lambda t: plain.replace_words(t, TRIAL)),
    "heuristic": (lambda: rewrite.heuristic_simplify(F.col(T), TRIAL), lambda t: plain.heuristic(t, TRIAL)),
    "13a": (lambda: sari.punctuation_tokens(F.lower(F.col(T))), plain.tokens_13a),
}

TRIAL = {**fixed.LEXICON, "and": "plus", "in the": "inside", "und": "sowie", "de la": "della", "cost": "a$1\\b"}



@pytest.mark.parametrize("name", CASES)
def test_same_as_python(df, texts, name):
    column, function = CASES[name]
    for t, got in zip(texts, values(df, column())):
        assert got == function(t), (name, t)


def test_missing_text_stays_missing(spark):
    empty = spark.createDataFrame([(0, None)], "id int, t string")
    for name, (column, _) in CASES.items():
        assert values(empty, column()) == [None], name


def test_clean_is_idempotent(df):
    once = text.clean_sentence(F.col(T))
    assert df.where(text.clean_sentence(once) != once).count() == 0


def test_split_keeps_all_but_space(df):
    joined = F.regexp_replace(F.array_join(text.split_sentences(F.col(T)), ""), text.WS, "")
    assert df.where(joined != F.regexp_replace(F.col(T), text.WS, "")).count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("given, wanted", [
    ("Hello , world ( test ) !", "Hello, world (test)!"), ('say "hi" now', 'say"hi"now'),
    ("यह है ।", "यह है।"), ("end .", "end ."),
])
def test_translation_spacing(spark, given, wanted):
    assert one(spark, languages.clean_translation(F.lit(given))) == wanted


def test_tags(spark):
    def tagged(t, tag="hin_Deva"):
        return one(spark, languages.ensure_lang_tags(F.lit(t), F.lit(tag)))

    assert tagged("Hi.") == "eng_Latn hin_Deva Hi."
    assert tagged("eng_Latn tam_Taml Hi.") == "eng_Latn tam_Taml Hi."
    assert tagged("eng_Latn tam_Taml") == "eng_Latn hin_Deva eng_Latn tam_Taml"
    assert tagged(tagged("Hi.")) == tagged("Hi.")
    assert one(spark, languages.language_tag(F.lit("Urdu"))) == "urd_Arab"
    assert one(spark, languages.language_tag(F.lit("Klingon"))) == "hin_Deva"
    assert one(spark, languages.language_tag(F.lit(None).cast("string"))) == "hin_Deva"


def test_readability(spark):
    counts = readability.text_counts(F.lit("The cat sat on the mat."))
    assert one(spark, readability.fkgl(counts)) == pytest.approx(-1.45)
    assert one(spark, readability.fre(counts)) == pytest.approx(116.145)


def test_syllables(df, texts):
    for t, got in zip(texts, values(df, readability.syllable_count(F.col(T)))):
        low = t.lower()
        assert got == len(re.findall("[aeiouy]+", low)) + sum(not re.search("[aeiouy]", w) for w in low.split()), t


def test_prompts_and_budget(spark):
    assert one(spark, prompts.build_prompt(F.lit("A {text} $1"), fixed.MERGED_PROMPT)).endswith(
        "### Input:\nA {text} $1\n\n### Response:\n")
    assert one(spark, prompts.training_text(F.lit("n {simple}"), F.lit("s"))).endswith("Sentence: n {simple}\nSimple: s")
    budgets = [one(spark, prompts.generation_budget(F.lit(n))) for n in (1, 30, 500)]
    assert budgets == [24, 30, 48]
    assert one(spark, prompts.generation_budget(F.lit(500), 10)) == 10


@pytest.mark.parametrize("side", ["left", "right"])
def test_padding(spark, side):
    tokens = F.array(*[F.lit(i) for i in (1, 2, 3)])
    pad = one(spark, prompts.pad_tokens(tokens, F.lit(0), 5, side))
    assert pad == ([0, 0, 1, 2, 3] if side == "left" else [1, 2, 3, 0, 0])
    assert one(spark, prompts.pad_tokens(tokens, F.lit(0), 2, side)) == [1, 2]


@pytest.mark.parametrize("given, wanted", [
    ("no stop here ", "no stop here"), ("x ###\n\n y", "x"), ("a\n\nb ### c", "a"), ("### first", ""), ("  \n\n late", "late"), ("a ### b\n\nc", "a"), ("", ""),
    ("one # two ## three", "one # two ## three"), ("one\ntwo", "one\ntwo")])
def test_cut_at_stop(spark, given, wanted):
    assert one(spark, text.cut_at_stop(F.lit(given))) == wanted


@pytest.mark.parametrize("given, wanted", [
    (" plain ", "plain"), ("p ### Response: a", "a"), ("### Response: x ### Response: y. Z", "y. Z"),
    ("### Response:", ""), ("", ""), ("a Response b", "a Response b")])
def test_extract_response(spark, given, wanted):
    assert one(spark, text.extract_response(F.lit(given))) == wanted


@pytest.mark.parametrize("size, wanted", [(2, [[1, 2], [3]]), (3, [[1, 2, 3]]), (5, [[1, 2, 3]])])
def test_token_parts(spark, size, wanted):
    assert one(spark, prompts.token_parts(F.array(*[F.lit(i) for i in (1, 2, 3)]), size)) == wanted
    assert one(spark, prompts.token_parts(F.array().cast("array<int>"), size)) == [[]]


def test_decoders(spark):
    raw = " x ### Response: a ### Response:  First one.  Second.\n\n### Input: z"
    assert one(spark, text.decode_output(F.lit(raw))) == "First one."
    assert one(spark, text.decode_quantised(F.lit("\n\nlate"))) == ""
    assert one(spark, text.decode_quantised(F.lit(" It is.  More ### no"))) == "It is."
    assert one(spark, text.decode_merged(F.lit("p ### Response: Simple: kept ###. X"))) == "Simple: kept ###."
    assert one(spark, text.empty_fallback(F.lit(" 　"), F.lit("src"))) == "src"


def test_awkward_texts_are_awkward():
    assert any(not t.strip() for t in plain.AWKWARD)


def test_texts_are_read_once_for_syllables(spark):
    """One pass over a text, whatever its words hold: vowels, none, or signs alone."""
    rows = ["", "  ", "rhythm", "pst", "Pst! brrr -- 12", "queue au y\u2028xyz\u00a0tsk", "\u00c9t\u00e9 \u0130stanbul", "a", "strength's b", None]
    df = spark.createDataFrame([(t,) for t in rows], "text string").select("text", readability.syllable_count(F.col("text")).alias("n"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1

    def plainly(text):
        return sum(max(1, len(re.findall("[aeiouy]+", word.lower()))) for word in text.split())

    assert [(r.text, r.n) for r in df.collect()] == [(t, None if t is None else plainly(t)) for t in rows]


def test_sentences_are_counted_as_they_are_cut(spark, texts):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    own = blanks + [f"{b}A.{b}B!{b}{b}C? d{b}" for b in blanks] + ["", "a", ". A", "A.. B", "A. .B", "Is it? \n\n Yes.A", "​", "\x00"]
    df = spark.createDataFrame([(t,) for t in texts + own], "t string")
    for t, cut, counted in df.select("t", F.size(text.split_sentences(F.col("t"))), text.sentence_count(F.col("t"))).collect():
        assert counted == (None if t is None else cut), repr(t)
