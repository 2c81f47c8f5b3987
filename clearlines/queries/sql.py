"""Pieces of checking SQL: the same definitions again, written for an SQL engine.

Nothing here is used by the library. RE2 has no look-around, so some rules take another form
than in Spark.
"""

from __future__ import annotations

from clearlines import fixed

# The prose of the test tables is invented, so these common words stand in for hard ones.
TRIAL_LEXICON = {
    **fixed.LEXICON,
    "and": "plus",
    "thing": "item",
    "in the": "inside",
    "of": "from",
    "und": "sowie",
    "de la": "della",
}

WS, NOT_WS = fixed.WS, fixed.NOT_WS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_all(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def strip(x: str) -> str:
    return f"trim({x}, {lit(fixed.WS_CHARS)})"


def collapse(x: str) -> str:
    return f"trim({replace_all(x, WS + '+', ' ')}, ' ')"


def split(x: str) -> str:
    marked = f"regexp_replace({x}, {lit(f'([.!?]){WS}+([A-Z])')}, '\\1' || chr(1) || '\\2', 'g')"
    return f"string_split({marked}, chr(1))"


def first_sentence(x: str) -> str:
    return f"regexp_replace({strip(x)}, {lit(rf'\A(.*?[.!?])(?:{WS}(?s:.*)|\z)')}, '\\1')"


def clean(x: str, collapsed: bool = True) -> str:
    body = collapse(x) if collapsed else strip(x)
    closed = f"regexp_replace({body}, '([^.!?])\\z', '\\1.')"
    return f"(CASE left({body}, 1) WHEN 'ß' THEN 'SS' ELSE upper(left({body}, 1)) END || substr({closed}, 2))"


def clause(x: str) -> str:
    return strip(f"regexp_extract({x}, '\\A[^,;:]*')")


def short_words(x: str) -> str:
    return collapse(replace_all(x, NOT_WS + "{9,}", ""))


def first_words(x: str, n: int) -> str:
    return f"regexp_extract({x}, {lit(rf'\A{NOT_WS}+(?:{WS}+{NOT_WS}+){{0,{n - 1}}}')})"


def lexicon(x: str, table: dict[str, str] = TRIAL_LEXICON) -> str:
    """Neighbouring matches share a separator, so each key is replaced twice."""
    edge = r"[^\p{L}\p{N}_]"
    for old in sorted(table, key=len, reverse=True):
        pattern = rf"(?i)(^|{edge})" + old.replace("-", r"\-") + rf"({edge}|$)"
        for _ in range(2):
            x = replace_all(x, pattern, rf"\1{table[old]}\2")
    return x


def first_clause(x: str) -> str:
    part = f"[^{WS[1:-1]},;:]"
    enough = f"{WS}*(?:{part}+{WS}+){{5}}{part}[^,;:]*"
    return strip(f"regexp_replace({x}, {lit(rf'\A({enough})[,;:](?s:.*)\z')}, '\\1')")


def heuristic(x: str, table: dict[str, str] = TRIAL_LEXICON) -> str:
    return clean(first_clause(lexicon(x, table)))


def numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, {lit(fixed.NUMBER)}))"


def terms(x: str) -> str:
    stop = "[" + ", ".join(lit(w) for w in fixed.STOP_WORDS) + "]"
    found = f"regexp_extract_all(lower({x}), {lit(fixed.KEY_TERM)})"
    return f"list_distinct(list_filter({found}, lambda w: NOT list_contains({stop}, w)))"


def minus(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda w: NOT list_contains({b}, w)))"


def joined(x: str) -> str:
    """A set as text, sorted."""
    return f"array_to_string(list_sort({x}), '|')"


def words(x: str) -> str:
    return count(x, NOT_WS + "+")


def sentence_count(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN 0 ELSE len({split(strip(x))}) END"


def syllables(x: str) -> str:
    """Vowel groups, and words without a vowel (every word stands between two spaces of its own)."""
    spaced = f"('  ' || regexp_replace({x}, {lit(WS + '+')}, '  ', 'g') || '  ')"
    return f"({count(f'lower({x})', '[aeiouy]+')} + {count(f'lower({spaced})', f' [^{WS[1:-1]}aeiouy]+ ')})"


def fkgl(x: str) -> str:
    w, s = f"greatest({words(x)}, 1)::DOUBLE", f"greatest({sentence_count(x)}, 1)::DOUBLE"
    return f"(0.39::DOUBLE * {w} / {s} + 11.8::DOUBLE * {syllables(x)}::DOUBLE / {w} - 15.59::DOUBLE)"


def fre(x: str) -> str:
    w, s = f"greatest({words(x)}, 1)::DOUBLE", f"greatest({sentence_count(x)}, 1)::DOUBLE"
    return f"(206.835::DOUBLE - 1.015::DOUBLE * {w} / {s} - 84.6::DOUBLE * {syllables(x)}::DOUBLE / {w})"


def length_ratio(source: str, predicted: str) -> str:
    return f"({words(predicted)}::DOUBLE / greatest({words(source)}, 1))"


def bound(a: str, b: str) -> str:
    """The similarity ratio of two texts of which one contains the other."""
    return (f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0::DOUBLE ELSE "
            f"2.0::DOUBLE * least(length({a}), length({b})) / (length({a}) + length({b})) END")


def tokens_13a(x: str) -> str:
    x = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    x = f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    x = f"(' ' || {x} || ' ')"
    x = replace_all(x, r"([\x{7b}-\x{7e}\x{5b}-\x{60}\x{20}-\x{26}\x{28}-\x{2b}\x{3a}-\x{40}/])", r" \1 ")
    x = replace_all(x, r"([^0-9])([.,])", r"\1 \2 ")
    x = replace_all(x, r"([.,])([^0-9])", r" \1 \2")
    x = replace_all(x, r"([0-9])(-)", r"\1 \2 ")
    return f"string_split({collapse(x)}, ' ')"


def tokens_space(x: str) -> str:
    return f"string_split({collapse(x)}, ' ')"


# --- relations ---------------------------------------------------------------------

SENTENCES = f"""sentences AS (
  SELECT doc_id, lang, source, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS pos
  FROM (SELECT doc_id, lang, source, {split(strip('text'))} AS parts FROM documents WHERE {strip('text')} <> ''))"""

PAIRS = f"""{SENTENCES}, pairs AS (
  SELECT doc_id, pos, source, sentence AS normal, {clause('sentence')} AS clause, {short_words('sentence')} AS simple
  FROM sentences)"""

SYSTEMS = f"""{PAIRS}, systems AS (
  SELECT doc_id, pos, source, 'clause' AS system, normal, clause AS predicted, simple FROM pairs
  UNION ALL SELECT doc_id, pos, source, 'same' AS system, normal, normal AS predicted, simple FROM pairs)"""

CANDIDATES = f"""{PAIRS}, candidates AS (
  SELECT doc_id, pos, 'clause' AS kind, normal, clause AS candidate FROM pairs
  UNION ALL SELECT doc_id, pos, 'short', normal, simple FROM pairs
  UNION ALL SELECT doc_id, pos, 'longer', normal, clause || ' indeed certainly moreover probably likely' FROM pairs
  UNION ALL SELECT doc_id, pos, 'dated', normal, clause || ' 1999 5%' FROM pairs
  UNION ALL SELECT doc_id, pos, 'same', normal, ' ' || lower(normal) FROM pairs
  UNION ALL SELECT doc_id, pos, 'blank', normal, ' ' FROM pairs)"""

# A near copy: the sentence with m strange characters put into its middle. Neither text holds the other, and all n
# characters of the sentence match, so the ratio is 2n / (2n + m). m brings it to one of NEAR_RATIOS.
STRANGE = "\u2400"
NEAR_RATIOS = (0.90, 0.935, 0.945, 0.96, 0.965, 0.975, 0.98, 0.99)


def near_size(ratio: float) -> float:
    """Strange characters per character of the sentence."""
    return 2 * (1 / ratio - 1)


NEAR = f"""{PAIRS}, near AS (
  SELECT *, (length(normal) + 1) // 2 AS half, [{', '.join(f'{near_size(r)!r}::DOUBLE' for r in NEAR_RATIOS)}][1 + (doc_id + pos) % 8] AS size
  FROM pairs), near_pairs AS (
  SELECT doc_id, pos, source, normal, clause, simple,
    left(normal, half) || repeat('{STRANGE}', greatest(1, floor(length(normal) * size + 0.5))::BIGINT) || substr(normal, half + 1) AS near
  FROM near)"""


def near_ratio(a: str, b: str) -> str:
    """The similarity ratio of a sentence and a near copy of it, or of a part of one from its start."""
    return f"(2.0::DOUBLE * length(replace({b}, '{STRANGE}', '')) / (length({a}) + length({b})))"


REQUESTS = """requests AS (
  SELECT user_id AS session, CASE WHEN event_type IN ('signup', 'purchase') THEN 'translate' ELSE 'simplify' END AS stage,
    ts, event_id AS id, value AS seconds, CAST(json_extract_string(props, '$.k') AS INTEGER) AS words FROM events)"""


def rule(source: str, candidate: str, loose: bool, ratio: str | None = None) -> str:
    """First failed gate rule, NULL if none; ``ratio`` is SQL for the similarity, if it counts."""
    missing, least_added, share = (0.60, 4, 0.35) if loose else (0.55, 3, 0.30)
    limit = 0.97 if loose else 0.92
    allowed = f"{share}::DOUBLE * len({terms(source)})"
    if loose:
        allowed = f"floor({allowed})"
    blank = f"WHEN {strip(candidate)} = '' THEN 'blank'" if loose else ""
    close = f"WHEN {ratio} >= {limit}::DOUBLE THEN 'ratio'" if ratio else ""
    return f"""CASE {blank}
      WHEN {strip(f'lower({source})')} = {strip(f'lower({candidate})')} THEN 'same'
      {close}
      WHEN {minus(numbers(candidate), numbers(source))} > 0 THEN 'numbers'
      WHEN len({terms(source)}) = 0 THEN NULL
      WHEN {minus(terms(source), terms(candidate))}::DOUBLE / len({terms(source)}) > {missing}::DOUBLE THEN 'missing'
      WHEN {minus(terms(candidate), terms(source))}::DOUBLE > greatest({least_added}::DOUBLE, {allowed}) THEN 'added' END"""


def simpler(source: str, candidate: str) -> str:
    def tokens(x):
        return count(x, "[A-Za-z]+")

    def average(x):
        return f"coalesce(length({replace_all(x, '[^A-Za-z]+', '')})::DOUBLE / nullif({tokens(x)}, 0), 0.0::DOUBLE)"

    def long(x):
        return count(x, "[A-Za-z]{9,}")

    return (f"(greatest({tokens(candidate)}, 1) <= floor(greatest({tokens(source)}, 1) * 1.05::DOUBLE) AND "
            f"({average(candidate)} <= {average(source)} - 0.25::DOUBLE OR {long(candidate)} <= {long(source)} - 1))")


def sari(relation: str, keys: str, tokens) -> str:
    """CTEs that end in ``sari(keys..., keep, del, add_f1, score)`` for (keys, normal, predicted, simple)."""
    return f"""toks AS (
  SELECT {keys}, {tokens('lower(normal)')} AS s, {tokens('lower(predicted)')} AS c, {tokens('lower(simple)')} AS r FROM {relation}),
sides AS (
  SELECT {keys}, 's' AS side, s AS t FROM toks UNION ALL SELECT {keys}, 'c', c FROM toks
  UNION ALL SELECT {keys}, 'r', r FROM toks),
starts AS (SELECT {keys}, side, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM sides, range(1, 5) AS sizes(n) WHERE len(t) >= n),
grams AS (SELECT {keys}, side, n, array_to_string(list_slice(t, i, i + n - 1), ' ') AS g FROM starts),
counts AS (
  SELECT {keys}, n, g, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 'c') AS c, count(*) FILTER (side = 'r') AS r
  FROM grams GROUP BY {keys}, n, g),
parts AS (
  SELECT *, least(s, c) AS kp, least(s, c, r) AS kg, least(s, r) AS ka, greatest(s - c, 0) AS d,
    greatest(greatest(s - c, 0) - r, 0) AS dg FROM counts),
sums AS (
  SELECT {keys}, n,
    coalesce(sum(kg::DOUBLE / kp) FILTER (kp > 0) / nullif(count(*) FILTER (kp > 0), 0), 1.0::DOUBLE) AS kprec,
    coalesce(sum(kg)::DOUBLE / nullif(sum(ka), 0), 1.0::DOUBLE) AS krec,
    coalesce(sum(dg::DOUBLE / d) FILTER (d > 0) / nullif(count(*) FILTER (d > 0), 0), 1.0::DOUBLE) AS del,
    coalesce(count(*) FILTER (c > 0 AND s = 0 AND r > 0)::DOUBLE / nullif(count(*) FILTER (c > 0 AND s = 0), 0), 1.0::DOUBLE) AS aprec,
    coalesce(count(*) FILTER (c > 0 AND s = 0 AND r > 0)::DOUBLE / nullif(count(*) FILTER (r > 0 AND s = 0), 0), 1.0::DOUBLE) AS arec
  FROM parts GROUP BY {keys}, n),
spine AS (SELECT {keys}, n FROM toks, range(1, 5) AS sizes(n)),
by_size AS (
  SELECT {keys}, n,
    CASE WHEN kprec IS NULL THEN 1.0::DOUBLE WHEN kprec + krec > 0 THEN 2 * kprec * krec / (kprec + krec) ELSE 0.0::DOUBLE END AS keep,
    coalesce(del, 1.0::DOUBLE) AS del,
    CASE WHEN aprec IS NULL THEN 1.0::DOUBLE WHEN aprec + arec > 0 THEN 2 * aprec * arec / (aprec + arec) ELSE 0.0::DOUBLE END AS add_f1
  FROM spine LEFT JOIN sums USING ({keys}, n)),
sari AS (
  SELECT {keys}, avg(keep) AS keep, avg(del) AS del, avg(add_f1) AS add_f1, (avg(keep) + avg(del) + avg(add_f1)) / 3 AS score
  FROM by_size GROUP BY {keys})"""
