"""The queries of plans.queries as DuckDB SQL, put together from the same definitions."""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import lexicons as L
from ..functions.rounding import exact_round_sql
from ..functions.text import GREETING
from ..operators.analytics import TRANSLATION_PROFILES

TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"
ASCII = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z]+(?:''[a-z]+)?')"
KEYS = "conv_id, turn"


def _strings(words: Iterable[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


def grams(w: str, n: int) -> str:
    inner = " || ' ' || ".join(f"{w}[i + {k}]" for k in range(1, n + 1))
    return f"list_transform(range(0, greatest(len({w}) - {n - 1}, 0)), lambda i: {inner})"


def ratio(a: str, b: str) -> str:
    return f"CAST(CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END AS DOUBLE)"


def _met(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def _either(a: str, b: str) -> str:
    return f"len(list_distinct(list_concat({a}, {b})))"


def _distinct(a: str) -> str:
    return f"len(list_distinct({a}))"


def rounded(ctes: str, source: str, keys: str, columns: dict[str, str], places: int, whole: Iterable[str] = ()) -> str:
    """WITH ctes SELECT keys and the columns (name: expression over source), rounded but for those of `whole`."""
    whole = set(whole)
    raw = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" if k not in whole else f"{v} AS {k}" for k, v in columns.items())
    out = ", ".join(k if k in whole else f"{exact_round_sql(k, places)} AS {k}" for k in columns)
    return f"WITH {ctes}, raw AS (SELECT {keys}, {raw} FROM {source}) SELECT {keys}, {out} FROM raw"


STATS = f"""words AS (SELECT doc_id, lang, source, {TOK.format('text')} AS w FROM documents),
grams AS (SELECT *, {grams('w', 3)} AS g FROM words),
stats AS (SELECT doc_id, lang, source, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct,
  CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END AS ttr, CASE WHEN len(g) > 0 THEN (len(g) - len(list_distinct(g))) / len(g) ELSE 0 END AS redundancy FROM grams),
scored AS (SELECT *, CAST((ttr * 0.6::DOUBLE + redundancy * -0.4::DOUBLE) / 1.0::DOUBLE AS DOUBLE) AS score FROM stats)"""
PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant')"""
WORDS = f"{PAIRS}, w AS (SELECT {KEYS}, answer, prompt, {TOK.format('answer')} AS h, {TOK.format('prompt')} AS r FROM pairs)"


def _f1(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"


def rouge(n: int) -> str:
    ctes = f"""{WORDS}, g AS (SELECT {KEYS}, {grams('h', n)} AS h, {grams('r', n)} AS r FROM w),
x AS (SELECT {KEYS}, unnest(h) AS gram, 1 AS x, 0 AS y FROM g UNION ALL SELECT {KEYS}, unnest(r), 0, 1 FROM g),
c AS (SELECT {KEYS}, gram, sum(x) AS x, sum(y) AS y FROM x GROUP BY ALL),
m AS (SELECT g.conv_id, g.turn, coalesce(max(len(h)), 0) AS nh, coalesce(max(len(r)), 0) AS nr, coalesce(sum(least(x, y)), 0) AS m FROM g LEFT JOIN c USING ({KEYS}) GROUP BY ALL),
p AS (SELECT {KEYS}, {ratio('m', 'nh')} AS p, {ratio('m', 'nr')} AS r FROM m)"""
    return rounded(ctes, "p", KEYS, {'"precision"': "p", "recall": "r", "f1": _f1("p", "r")}, 4)


_CLIPPED = f"""c AS (SELECT {KEYS}, n, gram, sum(x) AS x, sum(y) AS y FROM g GROUP BY ALL),
m AS (SELECT {KEYS}, n, sum(least(x, y))::DOUBLE AS m, sum(x)::DOUBLE AS na, sum(y)::DOUBLE AS nb, sum(x * y)::DOUBLE AS dot,
  sum(x * x * pow(CASE WHEN x > 0 AND y > 0 THEN 1 ELSE ln(1.5::DOUBLE) + 1 END, 2))::DOUBLE AS sa, sum(y * y * pow(CASE WHEN x > 0 AND y > 0 THEN 1 ELSE ln(1.5::DOUBLE) + 1 END, 2))::DOUBLE AS sb FROM c GROUP BY ALL)"""


def _orders(made, n: int, kind: str = "0") -> str:
    return " UNION ALL ".join(f"SELECT {KEYS}, {kind} + {k} AS n, unnest({made(s, k)}) AS gram, {x} AS x, {1 - x} AS y FROM w" for k in range(1, n + 1) for s, x in (("h", 1), ("r", 0)))


def bleu() -> str:
    mean = ", ".join(f"avg(CASE WHEN m > 0 AND n <= {k} THEN ln(m / na) END) AS l{k}" for k in (1, 2, 4))
    first = ", ".join(f"max({c}) FILTER (n = 1) AS {c}" for c in ("na", "nb", "dot", "sa", "sb"))
    bp = "CASE WHEN na < nb THEN exp(1 - nb / na) ELSE 1 END"
    ctes = f"""{WORDS}, g AS ({_orders(grams, 4)}), {_CLIPPED},
b AS (SELECT {KEYS}, {mean}, bool_or(na > 0 AND m = 0) AS missing, {first} FROM m GROUP BY ALL),
p AS (SELECT pairs.conv_id, pairs.turn, b.* EXCLUDE (conv_id, turn) FROM pairs LEFT JOIN b USING ({KEYS}))"""
    columns = {f"bleu_{k}": f"coalesce({bp} * exp(l{k}), 0)" for k in (1, 2, 4)}
    columns["bleu_strict"] = f"CASE WHEN missing OR l4 IS NULL THEN 0 ELSE {bp} * exp(l4) END"
    columns["tfidf_cosine"] = "coalesce(CASE WHEN sa * sb > 0 THEN dot / (sqrt(sa) * sqrt(sb)) END, 0)"
    return rounded(ctes, "p", KEYS, columns, 4)


def chrf() -> str:
    pieces = lambda s, k: f"list_transform(range(1, greatest(length({s}) - {k - 1}, 0) + 1), lambda i: substring({s}, i, {k}))"
    bare = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '\\s+', '', 'g')"
    spaced = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '^\\s+|\\s+$', '', 'g')"
    # orders 1 to 6 of the bare texts, and 11 to 16 of those with their white space
    parts = [f"SELECT {KEYS}, n, gram, x, y FROM (WITH w AS (SELECT {KEYS}, {f('answer')} AS h, {f('prompt')} AS r FROM pairs) {_orders(pieces, 6, kind)})" for f, kind in ((bare, "0"), (spaced, "10"))]
    score = lambda p, q: f"CASE WHEN {p} + {q} > 0 THEN 5 * {p} * {q} / (4 * {p} + {q}) ELSE 0 END"
    ctes = f"""{PAIRS}, g AS ({' UNION ALL '.join(parts)}), {_CLIPPED},
b AS (SELECT {KEYS}, avg(m / na) FILTER (n < 10) AS p, avg(m / nb) FILTER (n < 10) AS q, avg(m / na) FILTER (n > 10) AS ps, avg(m / nb) FILTER (n > 10) AS qs FROM m WHERE na > 0 AND nb > 0 GROUP BY ALL),
k AS (SELECT pairs.conv_id, pairs.turn, p, q, ps, qs FROM pairs LEFT JOIN b USING ({KEYS}))"""
    return rounded(ctes, "k", KEYS, {"chrf": score("p", "q"), "chrf_spaced": score("ps", "qs")}, 4)


def pair_sets() -> str:
    ctes = f"{WORDS}, g AS (SELECT *, {grams('h', 2)} AS h2, {grams('r', 2)} AS r2 FROM w)"
    columns = {
        "jaccard": ratio(_met("h", "r"), _either("h", "r")),
        "bigram_overlap": ratio(_met("h2", "r2"), _either("h2", "r2")),
        "novel_bigrams": ratio(f"{_distinct('h2')} - {_met('h2', 'r2')}", _distinct("h2")),
        "compression": ratio("len(h)", "len(r)"),
    }
    return rounded(ctes, "g", KEYS, columns, 4)


def _sentences(text: str) -> str:
    """Lists of distinct tokens of sentences, empty pieces left out."""
    trim = f"regexp_replace(coalesce({text}, ''), '^\\s+|\\s+$', '', 'g')"
    cut = f"list_filter(string_split(regexp_replace({trim}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\\S'))"
    return f"list_transform({cut}, lambda s: list_distinct({TOK.format('s')}))"


def _clauses(text: str) -> str:
    cut = f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[.!?]+'), lambda x: regexp_matches(x, '\\S'))"
    return f"list_transform({cut}, lambda s: list_distinct({TOK.format('s')}))"


def summary_overlaps() -> str:
    stops = _strings(L.SUMMARY_STOPS)
    content = lambda x: f"list_filter({x}, lambda v: length(v) > 1 AND NOT list_contains({stops}, v))"
    like = f"len(list_filter(rs, lambda t: {ratio(_met('s', 't'), _either('s', 't'))} > 0.3::DOUBLE)) > 0"
    ctes = f"""{WORDS}, g AS (SELECT *, {grams('h', 2)} AS h2, {grams('r', 2)} AS r2, {grams('h', 3)} AS h3, {grams('r', 3)} AS r3, {content('h')} AS hc, {content('r')} AS rc, {_sentences('answer')} AS hs, {_sentences('prompt')} AS rs FROM w)"""
    columns = {
        "lexical_diversity": ratio(_distinct("h"), "len(h)"),
        "information_density": ratio("len(hc)", "len(h)"),
        "redundancy": ratio(f"len(h3) - {_distinct('h3')}", "len(h3)"),
        "summary_word_count": "len(h)",
        "summary_sent_count": "len(hs)",
        "jaccard": ratio(_met("h", "r"), _either("h", "r")),
        "content_word_overlap": f"CASE WHEN len(hc) > 0 AND len(rc) > 0 THEN {ratio(_met('hc', 'rc'), _either('hc', 'rc'))} ELSE 0 END",
        "bigram_overlap": f"CASE WHEN len(h2) > 0 AND len(r2) > 0 THEN {ratio(_met('h2', 'r2'), _either('h2', 'r2'))} ELSE 0 END",
        "compression_ratio": ratio("len(h)", "len(r)"),
        "coverage": ratio(_met("rc", "h"), _distinct("rc")),
        "sentence_overlap": f"CASE WHEN len(rs) > 0 THEN {ratio(f'len(list_filter(hs, lambda s: {like}))', 'len(hs)')} ELSE 0 END",
        "novel_bigram_ratio": ratio(f"{_distinct('h2')} - {_met('h2', 'r2')}", _distinct("h2")),
        "abstractivity": ratio(f"{_distinct('h3')} - {_met('h3', 'r3')}", _distinct("h3")),
        "source_word_count": "len(r)",
    }
    return rounded(ctes, "g", KEYS, columns, 4, ["summary_word_count", "summary_sent_count", "source_word_count"])


def translation_overlaps() -> str:
    stops = _strings(L.TRANSLATION_STOPS)
    content = lambda x: f"list_filter({x}, lambda v: length(v) > 3 AND NOT list_contains({stops}, v))"
    alike = f"CASE WHEN {_either('s', 't')} > 0 THEN {_met('s', 't')} / {_either('s', 't')} ELSE 1 END"
    best = f"list_max(list_transform(list_transform(hs, lambda t: ({alike})::DOUBLE), lambda x: {exact_round_sql('x', 4)}))"
    ctes = f"""{WORDS}, g AS (SELECT *, {grams('h', 2)} AS h2, {grams('r', 2)} AS r2, {content('h')} AS hc, {content('r')} AS rc, {_clauses('answer')} AS hs, {_clauses('prompt')} AS rs, {exact_round_sql('q', 4)} AS length_ratio
FROM (SELECT *, {ratio('len(h)', 'len(r)')} AS q FROM w))"""
    columns = {
        "jaccard": f"CASE WHEN {_either('h', 'r')} > 0 THEN {_met('h', 'r')} / {_either('h', 'r')} ELSE 1 END",
        "length_ratio": "length_ratio",
        "length_score": "greatest(0, 1 - abs(1 - length_ratio))",
        "lex_div_original": ratio(_distinct("r"), "len(r)"),
        "lex_div_backtranslation": ratio(_distinct("h"), "len(h)"),
        "content_word_overlap": f"CASE WHEN {_either('hc', 'rc')} > 0 THEN {_met('hc', 'rc')} / {_either('hc', 'rc')} ELSE 1 END",
        "bigram_overlap": ratio(_met("h2", "r2"), f"(CASE WHEN len(h2) > 0 AND len(r2) > 0 THEN {_either('h2', 'r2')} ELSE 0 END)"),
        "sentence_overlap": f"CASE WHEN len(hs) > 0 AND len(rs) > 0 THEN list_reduce(list_transform(rs, lambda s: {best}), lambda a, x: a + x) / len(rs) ELSE 0 END",
        "orig_word_count": "len(r)",
        "bt_word_count": "len(h)",
    }
    return rounded(ctes, "g", KEYS, columns, 4, ["orig_word_count", "bt_word_count"])


def _syllables(w: str) -> str:
    groups = lambda x: f"len(regexp_extract_all({x}, '[aeiouy]+'))"
    base = f"(CASE WHEN {w} LIKE '%e' AND {w} NOT LIKE '%le' THEN {groups(f'left({w}, -1)')} ELSE {groups(w)} END + CASE WHEN regexp_matches({w}, '[^aeiouy]le$') THEN 1 ELSE 0 END)"
    return f"CASE WHEN length({w}) <= 3 THEN 1 WHEN regexp_matches({w}, '(tion|sion|cian)$') THEN greatest({base}, 2) ELSE greatest({base}, 1) END"


def _prose(text: str) -> str:
    """The list of sentences of prose."""
    names = "|".join(a.replace(".", "\\.") for a in L.ABBREVIATIONS)
    flat = f"regexp_replace(regexp_replace(coalesce({text}, ''), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
    guarded = f"regexp_replace({flat}, '({names})\\.', '\\1' || chr(2), 'g')"
    cut = f"string_split(regexp_replace({guarded}, '([.!?]) ([A-Z\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    # a guarded stop is one again before pieces are joined
    pieces = f"list_transform({cut}, lambda s: replace(s, chr(2), '.'))"
    short = "length(s) - length(replace(s, ' ', '')) + 1 <= 2 AND NOT regexp_matches(s, '[.!?]$')"
    joined = f"list_transform({pieces}, lambda s, i: CASE WHEN i = 1 THEN s WHEN {short} THEN ' ' || s ELSE chr(1) || s END)"
    return f"string_split(array_to_string({joined}, ''), chr(1))"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def _paragraphs(t: str) -> str:
    """The list of paragraphs of a trimmed text."""
    greeting = GREETING.replace("(?:", "(")
    kept = f"length(p) >= 3 AND NOT (p NOT LIKE '%' || chr(10) || '%' AND len(regexp_split_to_array(p, '\\s+')) <= 4 AND regexp_matches(lower(p), '{greeting}'))"
    blocks = f"list_filter(list_transform(regexp_split_to_array({t}, '\\n\\s*\\n'), lambda p: {_trim('p')}), lambda p: {kept})"
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda p: {_trim('p')}), lambda p: length(p) > 10)"
    return f"CASE WHEN len({blocks}) <= 1 AND len({lines}) > 1 THEN {lines} WHEN len({blocks}) > 0 THEN {blocks} ELSE [{t}] END"


_SHORT = _strings(L.SHORT_VERBS)
FACTS = f"""d AS (SELECT doc_id, {ASCII.format('text')} AS w, len({_prose('text')}) AS n_sentences FROM documents),
t AS (SELECT doc_id, unnest(w) AS w FROM d),
c AS (SELECT doc_id, w, count(*) AS c, regexp_replace(w, '(ed|es|ing|ly)$', '') AS v FROM t GROUP BY doc_id, w),
s AS (SELECT *, length(w) AS l, {_syllables('w')} AS s, {_syllables('v')} AS sv FROM c),
m AS (SELECT doc_id, sum(c * l) AS n_letters, sum(c * s) AS n_syllables, sum(c) FILTER (s >= 3 AND sv >= 3) AS n_complex, sum(c) FILTER (s >= 3 AND l >= 7) AS n_sophisticated,
  sum(c) FILTER (l > 5 OR list_contains({_SHORT}, w)) AS n_content, count(*) AS n_distinct, count(*) FILTER (c = 1) AS n_once, sum(c * c) AS sum_squares FROM s GROUP BY doc_id),
facts AS (SELECT d.doc_id, len(w) AS n_words, n_sentences, {', '.join(f'CAST(coalesce({x}, 0) AS BIGINT) AS {x}' for x in ('n_letters', 'n_syllables', 'n_complex', 'n_sophisticated', 'n_content', 'n_distinct', 'n_once', 'sum_squares'))}
  FROM d LEFT JOIN m USING (doc_id))"""


def word_facts() -> str:
    return f"WITH {FACTS} SELECT * FROM facts"


def readability() -> str:
    ctes = f"""{FACTS}, f AS (SELECT *, greatest(n_words, 1)::DOUBLE AS n FROM facts),
q AS (SELECT doc_id, n_complex, n_sentences, n / n_sentences AS asl, n_syllables / n AS asw, n_letters / n AS letters, n_complex / n AS hard, n_sentences / n * 100 AS per_100 FROM f)"""
    ease, grade = "(206.835::DOUBLE - 1.015::DOUBLE * asl - 84.6::DOUBLE * asw)", "(0.39::DOUBLE * asl + 11.8::DOUBLE * asw - 15.59::DOUBLE)"
    columns = {
        "flesch_reading_ease": f"least(greatest({ease}, 0), 100)",
        "flesch_kincaid_grade": f"greatest({grade}, 0)",
        "gunning_fog_index": "0.4::DOUBLE * (asl + 100 * hard)",
        "coleman_liau_index": "greatest(0.0588::DOUBLE * (letters * 100) - 0.296::DOUBLE * per_100 - 15.8::DOUBLE, 0)",
        "automated_readability_index": "greatest(4.71::DOUBLE * letters + 0.5::DOUBLE * asl - 21.43::DOUBLE, 0)",
        "smog_grade": f"greatest(CASE WHEN n_sentences >= 3 THEN 1.043::DOUBLE * sqrt(n_complex * (30 / n_sentences)) + 3.1291::DOUBLE ELSE {grade} END, 0)",
        "readability_score": f"greatest(100 - abs({ease} - 60) * 1.5::DOUBLE, 0)",
    }
    return rounded(ctes, "q", "doc_id", columns, 2)


def lexis() -> str:
    ctes = f"""{FACTS}, q AS (SELECT *, greatest(n_words, 1)::DOUBLE AS n, n_distinct AS u, n_once AS h FROM facts),
k AS (SELECT *, CASE WHEN sum_squares > n THEN 10000 * (sum_squares - n) / (n * n) ELSE 0 END AS k FROM q)"""
    columns = {
        "type_token_ratio": "u / n * 100",
        "root_ttr": "least(u / sqrt(n) / 15 * 100, 100)",
        "hapax_legomena_ratio": "h / greatest(u, 1) * 100",
        "yules_k": "k",
        "vocabulary_richness": "least(greatest(100 - k * 0.5::DOUBLE, 0), 100)",
        "avg_word_length": "n_letters / n",
        "lexical_sophistication": "n_sophisticated / n * 100",
        "information_density": "n_content / n * 100",
        "brunets_w": "CASE WHEN u > 0 THEN pow(n, pow(u::DOUBLE, -0.172::DOUBLE)) ELSE 0 END",
        "honores_r": "CASE WHEN h > 0 AND u > h THEN 100 * ln(n) / (1 - h / u) ELSE 0 END",
    }
    return rounded(ctes, "k", "doc_id", columns, 2)


def structure() -> str:
    size = lambda x: f"list_transform({x}, lambda s: len({ASCII.format('s')}))"
    var = lambda x, n: f"((list_sum(list_transform({x}, lambda v: v * v)) * {n} - list_sum({x}) * list_sum({x}))::DOUBLE / ({n} * {n}))"
    ctes = f"""t AS (SELECT doc_id, coalesce(text, '') AS text, {_trim("coalesce(text, '')")} AS trimmed FROM documents),
p AS (SELECT doc_id, text, {_prose('text')} AS s, {_paragraphs('trimmed')} AS p FROM t),
q AS (SELECT doc_id, text, {size('s')} AS ss, {size('p')} AS ps, len(s) AS n, len(p) AS np, len(list_filter(s, lambda x: x LIKE '%?')) AS asks, len(list_filter(s, lambda x: x LIKE '%!')) AS calls, len({ASCII.format('text')}) AS words FROM p),
v AS (SELECT *, {var('ss', 'n')} AS vs, {var('ps', 'np')} AS vp, list_sum(ss)::BIGINT AS total, n - asks - calls AS plain FROM q)"""
    columns = {
        "word_count": "words",
        "sentence_count": "n",
        "paragraph_count": "np",
        "character_count": "length(text)",
        "character_count_no_spaces": "length(replace(text, ' ', ''))",
        "avg_sentence_length": "total / n",
        "min_sentence_length": "list_min(ss)",
        "max_sentence_length": "list_max(ss)",
        "sentence_length_std": "sqrt(vs)",
        "sentence_length_variance": "vs",
        "sentence_length_cv": "CASE WHEN total > 0 THEN sqrt(vs) / (total / n) * 100 ELSE 0 END",
        "avg_paragraph_length": "list_sum(ps) / np",
        "paragraph_length_std": "sqrt(vp)",
        "question_ratio": "asks / n * 100",
        "exclamation_ratio": "calls / n * 100",
        "declarative_ratio": "plain / n * 100",
        "sentence_type_variety": "((asks > 0)::INT + (calls > 0)::INT + (plain > 0)::INT) / 3 * 100",
        "words_per_paragraph": "words / np",
    }
    return rounded(ctes, "v", "doc_id", columns, 2, [k for k in columns if k.endswith("_count") or k.startswith(("min_", "max_", "character"))])


def tone() -> str:
    hit = lambda w, x: f"len(list_filter({w}, lambda v: list_contains({_strings(x)}, v)))"
    counts = ", ".join(f"{hit('w', x)} AS {k}" for k, x in (("pos", L.POSITIVE), ("neg", L.NEGATIVE), ("subj", L.SUBJECTIVE), ("formal", L.FORMAL), ("casual", L.INFORMAL)))
    ctes = f"""t AS (SELECT doc_id, coalesce(text, '') AS text, {ASCII.format('text')} AS w, {_prose('text')} AS s FROM documents),
u AS (SELECT doc_id, unnest(s) AS s FROM t), x AS (SELECT doc_id, {ASCII.format('s')} AS w FROM u),
y AS (SELECT doc_id, {hit('w', L.POSITIVE)} AS p, {hit('w', L.NEGATIVE)} AS n FROM x),
b AS (SELECT doc_id, count(*) AS ns, sum(((p - n) / greatest(p + n, 1))::DOUBLE) AS bs, sum((((p - n) / greatest(p + n, 1)) ** 2)::DOUBLE) AS bq FROM y GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n, list_sum(list_transform(w, lambda v: length(v))) AS letters, {counts}, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+''[\\p{{L}}\\p{{N}}_]+')) AS joined FROM t),
q AS (SELECT *, greatest(n, 1) AS m, pos + neg AS felt, casual + joined AS informal FROM c JOIN b USING (doc_id))"""
    columns = {
        "sentiment_polarity": "(CASE WHEN felt > 0 THEN (pos - neg) / felt ELSE 0 END + 1) * 50",
        "subjectivity": "least(subj / m * 10, 1) * 100",
        "formality_score": "CASE WHEN formal + informal > 0 THEN formal / (formal + informal) WHEN n > 0 THEN least(letters / n / 8, 1) ELSE 0.625::DOUBLE END * 100",
        "tone_consistency": "CASE WHEN ns >= 2 THEN greatest(1 - (bq / ns - (bs / ns) * (bs / ns)), 0) * 100 ELSE 80 END",
        "emotional_range": "least(felt / m * 20, 1) * 100",
    }
    return rounded(ctes, "q", "doc_id", columns, 2)


def _links() -> str:
    """Cosines of the sentences of each document: those of neighbours and all, and what is counted beside them."""
    terms = f"list_filter(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda v: NOT list_contains({_strings(L.VECTOR_STOPS)}, v))"
    held = f"len(list_filter({_strings(L.TRANSITION)}, lambda v: contains(lower(coalesce(text, '')), v)))"
    return f"""d AS (SELECT doc_id, {_prose('text')} AS s, {held} AS transitions FROM documents),
x AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM d),
t AS (SELECT doc_id, i, unnest({terms}) AS v FROM x), f AS (SELECT doc_id, i, v, count(*) AS c FROM t GROUP BY ALL),
df AS (SELECT doc_id, v, count(*) AS df FROM f GROUP BY ALL),
g AS (SELECT doc_id, i, v, c * (ln((1 + len(s)) / (1 + df)) + 1) AS w FROM f JOIN df USING (doc_id, v) JOIN d USING (doc_id)),
n AS (SELECT doc_id, i, sqrt(sum(w * w)) AS n FROM g GROUP BY ALL), z AS (SELECT doc_id, i, v, w / n AS w FROM g JOIN n USING (doc_id, i)),
near AS (SELECT a.doc_id, a.i, sum(a.w * b.w) AS c FROM z a JOIN z b ON a.doc_id = b.doc_id AND a.v = b.v AND b.i = a.i + 1 GROUP BY ALL),
every AS (SELECT doc_id, max(c) AS most FROM (SELECT a.doc_id, sum(a.w * b.w) AS c FROM z a JOIN z b ON a.doc_id = b.doc_id AND a.v = b.v AND a.i < b.i GROUP BY a.doc_id, a.i, b.i) GROUP BY doc_id),
nn AS (SELECT x.doc_id, avg(coalesce(c, 0)) AS near_mean, min(coalesce(c, 0)) AS near_least, var_pop(coalesce(c, 0)) AS near_var FROM x JOIN d USING (doc_id) LEFT JOIN near ON near.doc_id = x.doc_id AND near.i = x.i WHERE x.i < len(d.s) - 1 GROUP BY x.doc_id),
whole AS (SELECT doc_id, sum(w * w) AS q FROM (SELECT doc_id, v, sum(w) AS w FROM z GROUP BY ALL) GROUP BY doc_id), own AS (SELECT doc_id, count(DISTINCT i) AS own FROM z GROUP BY doc_id),
links AS (SELECT d.doc_id, len(s) AS n, transitions, CASE WHEN own > 0 THEN near_mean END AS near_mean, CASE WHEN own > 0 THEN near_least END AS near_least, CASE WHEN own > 0 THEN near_var END AS near_var,
  CASE WHEN len(s) > 1 THEN (q - own) / (len(s) * (len(s) - 1)) END AS mean, CASE WHEN len(s) > 1 AND own > 0 THEN greatest(coalesce(most, 0), 0) END AS most
  FROM d LEFT JOIN nn USING (doc_id) LEFT JOIN whole USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN every USING (doc_id))"""


def coherence() -> str:
    columns = {
        "avg_inter_sentence_similarity": "coalesce(near_mean * 100, 50)",
        "min_inter_sentence_similarity": "coalesce(near_least * 100, 50)",
        "coherence_variance": "coalesce(near_var * 100, 0)",
        "transition_density": "transitions / n * 100",
        "global_coherence": "coalesce(CASE WHEN n >= 3 THEN mean * 100 END, 50)",
    }
    flow = "0.4::DOUBLE * avg_inter_sentence_similarity + 0.3::DOUBLE * least(transition_density * 10, 100) + 0.3::DOUBLE * global_coherence"
    return f"SELECT * EXCLUDE (s), {exact_round_sql('s', 2)} AS flow_score FROM (SELECT *, {flow} AS s FROM ({rounded(_links(), 'links', 'doc_id', columns, 2)}))"


def sentence_repetition() -> str:
    columns = {"max_sentence_similarity": "coalesce(most * 100, 0)", "avg_cross_sentence_similarity": "coalesce(mean * 100, 0)"}
    return rounded(_links(), "links", "doc_id", columns, 2)


def repetition() -> str:
    stops = _strings(L.REPETITION_STOPS)
    again = lambda x: f"{ratio(f'len({x}) - {_distinct(x)}', f'len({x})')} * 100"
    ctes = f"""t AS (SELECT doc_id, {ASCII.format('text')} AS w FROM documents),
g AS (SELECT doc_id, {grams('w', 2)} AS b, {grams('w', 3)} AS t, list_filter(w, lambda v: NOT list_contains({stops}, v)) AS c FROM t)"""
    names = {"bigram_repetition_rate": "b", "trigram_repetition_rate": "t", "content_word_repetition": "c"}
    inner = rounded(ctes, "g", "doc_id", {k: again(v) for k, v in names.items()}, 2)
    return f"""SELECT * EXCLUDE (s), {exact_round_sql('s', 2)} AS redundancy_score
FROM (SELECT *, greatest(100 - (bigram_repetition_rate * 2 + trigram_repetition_rate * 3 + content_word_repetition * 0.5::DOUBLE), 0) AS s FROM ({inner}))"""


def content() -> str:
    terms = lambda c: f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda v: NOT list_contains({_strings(L.VECTOR_STOPS)}, v))"
    wanted = f"list_distinct(list_filter({ASCII.format('prompt')}, lambda v: NOT list_contains({_strings(L.COVERAGE_STOPS)}, v)))"
    # a word ends at no letter of any script: other letters become ones that the ASCII word boundary knows
    plain = "regexp_replace(regexp_replace(coalesce(prompt, ''), '[^\\p{L}\\p{N}\\x00-\\x7F]', '.', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
    ctes = f"""{PAIRS}, w AS (SELECT {KEYS}, coalesce(answer, '') AS answer, {terms('answer')} AS h, {terms('prompt')} AS r, {wanted} AS wanted, {ASCII.format('answer')} AS held,
  list_distinct(regexp_extract_all({plain}, '\\b[A-Z][a-z]+(?:\\s[A-Z][a-z]+)*\\b')) AS names FROM pairs),
g AS ({_orders(lambda x, _: x, 1)}), {_CLIPPED}, k AS (SELECT w.*, dot, sa, sb FROM w LEFT JOIN m USING ({KEYS}))"""
    columns = {
        "context_similarity": "coalesce(CASE WHEN sa * sb > 0 THEN dot / (sqrt(sa) * sqrt(sb)) END, 0) * 100",
        "information_coverage": f"{ratio(_met('wanted', 'held'), 'len(wanted)')} * 100",
        "entity_retention": "CASE WHEN len(names) > 0 THEN len(list_filter(names, lambda e: contains(lower(answer), lower(e)))) / len(names) * 100 ELSE 100 END",
    }
    blend = "0.5::DOUBLE * context_similarity + 0.3::DOUBLE * information_coverage + 0.2::DOUBLE * entity_retention"
    return f"SELECT * EXCLUDE (s), {exact_round_sql('s', 2)} AS relevance_score FROM (SELECT *, {blend} AS s FROM ({rounded(ctes, 'k', KEYS, columns, 2)}))"


def translation_board() -> str:
    """Composites of the measures that translation_overlaps gives, their z-scores and statistics."""
    weights = {k: w for k, w in TRANSLATION_PROFILES["balanced"].items() if k in ("jaccard", "content_word_overlap", "bigram_overlap", "length_score")}
    top = " + ".join(f"{k} * {w}::DOUBLE" for k, w in weights.items())
    under = " + ".join(f"{w}::DOUBLE" for w in weights.values())
    return f"""WITH o AS ({translation_overlaps()}), c AS (SELECT {KEYS}, {exact_round_sql('x', 4)} AS composite FROM (SELECT *, (0.0::DOUBLE + {top}) / (0.0::DOUBLE + {under}) AS x FROM o)),
s AS (SELECT avg(composite) AS m, stddev_pop(composite) AS d, count(*) AS n FROM c), z AS (SELECT {KEYS}, composite, CASE WHEN n > 1 AND d > 1e-12 THEN (composite - m) / d ELSE 0 END AS z FROM c, s)
SELECT {KEYS}, composite, {exact_round_sql('z', 4)} AS z FROM z"""


def oracle_sql() -> dict[str, str]:
    return {
        "token_stats": f"WITH {STATS} SELECT * FROM stats",
        "composite_balanced": f"WITH {STATS} SELECT doc_id, score FROM scored",
        "zscore_by_lang": f"""WITH {STATS}, g AS (SELECT lang, avg(score) AS m, stddev_pop(score) AS s, count(score) AS n FROM scored GROUP BY lang)
SELECT doc_id, d.lang, score, CASE WHEN n > 1 AND s > 1e-12 THEN (score - m) / s ELSE 0 END AS z FROM scored d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang""",
        "stats_by_lang": f"WITH {STATS} SELECT lang, count(score) AS n, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS low, max(score) AS high, max(score) - min(score) AS spread, median(score) AS median FROM scored GROUP BY lang",
        "leaderboard": f"""WITH {STATS}, m AS (SELECT lang, source, avg(score) AS score FROM scored GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, source NULLS LAST) AS INTEGER) AS rank FROM m""",
        "word_facts": word_facts(),
        "readability": readability(),
        "lexical_richness": lexis(),
        "structure": structure(),
        "tone": tone(),
        "repetition": repetition(),
        "coherence": coherence(),
        "sentence_repetition": sentence_repetition(),
        "pair_sets": pair_sets(),
        "pair_rouge1": rouge(1),
        "pair_rouge2": rouge(2),
        "pair_bleu_tfidf": bleu(),
        "pair_chrf": chrf(),
        "summary_overlaps": summary_overlaps(),
        "translation_overlaps": translation_overlaps(),
        "translation_board": translation_board(),
        "content": content(),
    }
