"""SQL of the same queries for DuckDB.

Its regular expressions have no look-around. Digits that start or end a number
at a word boundary are therefore marked first (U+0001 before, U+0002 after),
number patterns ask for the marks, and the marks are removed from the tokens.
"""

from __future__ import annotations

from .queries import DOC_LIMIT

WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
W = r"\p{L}\p{N}_\x{0C5D}"
URL = f"(?i:https?://[^{WS}<>\"'']+|www\\.[^{WS}<>\"'']+)"
D = r"\p{Nd}"
EMAIL = r"[a-zA-Z0-9._%+\x01\x02-]+@[a-zA-Z0-9.\x01\x02-]+\.[a-zA-Z]{2,}"
DATE = rf"\x01{D}{{4}}\x02[-/]\x01{D}{{1,2}}\x02[-/]\x01{D}{{1,2}}\x02|\x01{D}{{1,2}}\x02[-/.]\x01{D}{{1,2}}\x02[-/.]\x01{D}{{2,4}}\x02"
NUMBER = rf"\x01{D}+\x02\.\x01{D}+\x02|\x01{D}+\x02"
TELUGU = r"[\x{0C00}-\x{0C7F}](?:[\x01\x02]*[\x{0C00}-\x{0C7F}])*"
TOKEN = f"{URL}|{EMAIL}|{DATE}|{NUMBER}|{TELUGU}|[a-zA-Z]+|[^{WS}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS}]+')"


def tokens(x: str) -> str:
    before = rf"regexp_replace({x}, '(\A|[^{W}])({D})', '\1' || chr(1) || '\2', 'g')"
    both = rf"regexp_replace({before}, '({D})([^{W}]|\z)', '\1' || chr(2) || '\2', 'g')"
    return f"list_filter(list_transform(regexp_extract_all({both}, '{TOKEN}'), lambda x: replace(replace(x, chr(1), ''), chr(2), '')), lambda x: x <> '')"


def sentences(x: str) -> str:
    text = strip(f"replace({x}, chr(64976), '')")
    urls = rf"regexp_replace({text}, '({URL})', '\1' || chr(64976), 'g')"
    cut = rf"regexp_replace({urls}, '([.!?\x{{964}}\x{{965}}])[{WS}]+', '\1' || chr(1), 'g')"
    part = strip("replace(x, chr(64976), '')")
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: {part}), lambda x: x <> '')"


SENTENCES = f"""
SELECT doc_id AS doc_ord, unnest(range(len(s)))::INT AS sent_idx, unnest(s) AS sentence
FROM (SELECT doc_id, {sentences("text")} AS s FROM documents WHERE text <> '')
"""
TOKENIZED = f"SELECT doc_ord, sent_idx, t AS tokens, array_to_string(t, ' ') AS tokenized_sentence FROM (SELECT *, {tokens('sentence')} AS t FROM ({SENTENCES})) WHERE len(t) > 0"
TOKENS = f"SELECT doc_ord, sent_idx, unnest(range(len(tokens)))::INT AS tok_idx, unnest(tokens) AS token FROM ({TOKENIZED})"
KIND = rf"""CASE WHEN regexp_full_match(token, '{URL}') THEN 'url'
WHEN regexp_full_match(token, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}') THEN 'email'
WHEN regexp_full_match(token, '{D}{{4}}[-/]{D}{{1,2}}[-/]{D}{{1,2}}|{D}{{1,2}}[-/.]{D}{{1,2}}[-/.]{D}{{2,4}}') THEN 'date'
WHEN regexp_full_match(token, '{D}+\.{D}+') THEN 'decimal'
WHEN regexp_full_match(token, '{D}+') THEN 'integer'
WHEN regexp_full_match(token, '[\x{{0C00}}-\x{{0C7F}}]+') THEN 'telugu_word'
WHEN regexp_full_match(token, '[a-zA-Z]+') THEN 'latin_word'
WHEN regexp_full_match(token, '[^{W}{WS}\x{{0C00}}-\x{{0C7F}}]') THEN 'punct' ELSE 'other' END"""

STATS_A = f"""
WITH t AS ({TOKENIZED}), d AS (SELECT count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS c FROM documents), u AS (SELECT count(DISTINCT x) AS n FROM (SELECT unnest(tokens) AS x FROM t)),
s AS (SELECT count(*) AS total_sentences, coalesce(sum(len(tokens)), 0)::BIGINT AS total_words, coalesce(sum(length(tokenized_sentence)), 0)::BIGINT AS total_characters FROM t)
SELECT d.n AS total_documents, total_sentences, total_words, total_characters, d.c AS original_characters,
  CASE WHEN total_sentences > 0 THEN total_words / total_sentences ELSE 0 END AS average_sentence_length,
  CASE WHEN total_words > 0 THEN total_characters / total_words ELSE 0 END AS average_word_length,
  u.n AS unique_tokens, CASE WHEN total_words > 0 THEN u.n / total_words ELSE 0 END AS type_token_ratio
FROM s, d, u
"""
STATS_B = f"""
WITH t AS (SELECT tokenized_sentence AS s, {words("tokenized_sentence")} AS w FROM indiccorp_te_tokenized WHERE tokenized_sentence IS NOT NULL),
r AS (SELECT * FROM t WHERE len(w) > 0), u AS (SELECT count(DISTINCT x) AS n FROM (SELECT unnest(w) AS x FROM r)),
a AS (SELECT count(*) AS total_sentences, coalesce(sum(len(w)), 0)::BIGINT AS total_words, coalesce(sum(length(s)), 0)::BIGINT AS total_characters, coalesce(sum(length(array_to_string(w, ''))), 0) AS c FROM r)
SELECT total_sentences, total_words, total_characters,
  CASE WHEN total_sentences > 0 THEN total_words / total_sentences ELSE 0 END AS average_sentence_length,
  CASE WHEN total_words > 0 THEN c / total_words ELSE 0 END AS average_word_length,
  u.n AS unique_token_types, CASE WHEN total_words > 0 THEN u.n / total_words ELSE 0 END AS type_token_ratio
FROM a, u
"""
NTH = f"SELECT max(doc_id) AS n, count(*) AS c FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {DOC_LIMIT})"
WORDS = f"SELECT DISTINCT unnest({words('tokenized_sentence')}) AS word FROM indiccorp_te_tokenized"
NOUNS = f"SELECT DISTINCT noun FROM (SELECT lower({strip('noun')}) AS noun FROM noun_list) WHERE regexp_full_match(noun, '[a-z]+')"
CLASS = "CASE WHEN {0} LIKE '%y' THEN 'Y' WHEN regexp_matches({0}, '(s|z|x|ch|sh)$') THEN 'ES' ELSE 'S' END"
FORMS = "SELECT DISTINCT word FROM (SELECT unnest([noun, upper(noun), noun || 's', noun || 'es', left(noun, length(noun) - 1) || 'ies', noun || '!']) AS word FROM nouns UNION ALL SELECT noun FROM noun_list WHERE noun IS NOT NULL)"


def analysis(source: str, word: str) -> str:
    return f"""
SELECT f.{word} AS word, CASE WHEN NOT regexp_full_match(lower(f.{word}), '[a-z]+') THEN 'Invalid Word'
  WHEN lower(f.{word}) LIKE '%ies' AND y.noun IS NOT NULL AND {CLASS.format("y.noun")} = 'Y' THEN y.noun || '+N+PL'
  WHEN lower(f.{word}) LIKE '%es' AND e.noun IS NOT NULL AND {CLASS.format("e.noun")} = 'ES' THEN e.noun || '+N+PL'
  WHEN lower(f.{word}) LIKE '%s' AND s.noun IS NOT NULL AND {CLASS.format("s.noun")} = 'S' THEN s.noun || '+N+PL'
  WHEN w.noun IS NOT NULL THEN w.noun || '+N+SG' ELSE 'Invalid Word' END AS analysis
FROM ({source}) f LEFT JOIN nouns y ON y.noun = left(lower(f.{word}), greatest(length(f.{word}) - 3, 0)::BIGINT) || 'y'
LEFT JOIN nouns e ON e.noun = left(lower(f.{word}), greatest(length(f.{word}) - 2, 0)::BIGINT)
LEFT JOIN nouns s ON s.noun = left(lower(f.{word}), greatest(length(f.{word}) - 1, 0)::BIGINT)
LEFT JOIN nouns w ON w.noun = lower(f.{word})
"""


SEGMENT = """
WITH RECURSIVE v AS (SELECT word, sum(cnt) AS cnt FROM vocab WHERE cnt > 0 AND word <> '' GROUP BY word),
m AS (SELECT max(length(word)) AS m, sum(cnt) AS total FROM v),
c AS (SELECT case_id, coalesce(input, '') AS input, ground_truth FROM seg_cases),
p AS (SELECT case_id, input, unnest(range(length(input))) AS start FROM c),
q AS (SELECT p.*, unnest(range(1, m.m + 1)) AS len, m.total FROM p, m),
e AS (SELECT q.case_id, q.start, q.len, ln(v.cnt / q.total) AS logp FROM q JOIN v ON v.word = substring(q.input, q.start + 1, q.len) WHERE q.start + q.len <= length(q.input)),
b AS (SELECT case_id, start, max(len) AS len FROM e GROUP BY case_id, start),
g AS (SELECT case_id, input, 0::BIGINT AS pos, []::VARCHAR[] AS words FROM c
  UNION ALL SELECT g.case_id, g.input, g.pos + coalesce(b.len, 1), list_append(g.words, substring(g.input, g.pos + 1, coalesce(b.len, 1)))
  FROM g LEFT JOIN b ON b.case_id = g.case_id AND b.start = g.pos WHERE g.pos < length(g.input)),
l AS (SELECT case_id, start + len AS fin, list(struct_pack(start := start, len := len, logp := logp) ORDER BY len) AS es FROM e GROUP BY case_id, start + len),
d AS (SELECT case_id, input, 0::BIGINT AS i, [0.0]::DOUBLE[] AS score, [0]::BIGINT[] AS last FROM c
  UNION ALL SELECT case_id, input, i + 1, list_append(score, list_max(s)), list_append(last, CASE WHEN list_max(s) IS NOT NULL THEN es[list_position(s, list_max(s))].len END)
  FROM (SELECT d.*, l.es, list_transform(l.es, lambda x: d.score[x.start + 1] + x.logp) AS s FROM d LEFT JOIN l ON l.case_id = d.case_id AND l.fin = d.i + 1 WHERE d.i < length(d.input))),
r AS (SELECT case_id, input, length(input)::BIGINT AS pos, last, []::VARCHAR[] AS words FROM d WHERE i = length(input)
  UNION ALL SELECT case_id, input, pos - coalesce(last[pos + 1], 1), last, list_prepend(substring(input, pos - coalesce(last[pos + 1], 1) + 1, coalesce(last[pos + 1], 1)), words) FROM r WHERE pos > 0),
greedy AS (SELECT case_id, words FROM g WHERE pos = length(input)), dp AS (SELECT case_id, words FROM r WHERE pos = 0)
"""


def accuracy(p: str) -> str:
    n = f"least(len({p}), len(a))"
    return f"CASE WHEN len(a) > 0 THEN len(list_filter(list_zip({p}[1:{n}], a[1:{n}]), lambda x: x[1] = x[2])) / len(a) ELSE 0 END"


#: the distance counts bytes here, which is the same for the ASCII cases of the table
METRICS = SEGMENT + f""", t AS (SELECT case_id, {words("coalesce(ground_truth, '')")} AS a FROM c)
SELECT case_id, {accuracy("greedy.words")} AS greedy_accuracy, levenshtein(array_to_string(greedy.words, ' '), array_to_string(a, ' '))::INT AS greedy_distance,
  {accuracy("dp.words")} AS dp_accuracy, levenshtein(array_to_string(dp.words, ' '), array_to_string(a, ' '))::INT AS dp_distance
FROM t JOIN greedy USING (case_id) JOIN dp USING (case_id)"""
REPORT = f"""
WITH s AS ({METRICS}), m AS (SELECT avg(greedy_accuracy) AS greedy_accuracy, avg(greedy_distance) AS greedy_distance, avg(dp_accuracy) AS dp_accuracy, avg(dp_distance) AS dp_distance, count(*) AS cases FROM s)
SELECT *, CASE WHEN greedy_accuracy > dp_accuracy THEN 'greedy' WHEN greedy_accuracy < dp_accuracy THEN 'dp' ELSE 'same' END AS better_accuracy,
  CASE WHEN dp_distance > greedy_distance THEN 'greedy' WHEN dp_distance < greedy_distance THEN 'dp' ELSE 'same' END AS better_distance
FROM m"""


#: the faulty automaton is built anew here, and each rule is checked on its own
FAULTS = """
WITH s AS (SELECT unnest(['q0', 'q1', 'q_dead']) AS state, unnest([true, true, false]) AS is_start),
t AS (SELECT src, chr(96 + i::INT) AS symbol, CASE WHEN src = 'q_dead' THEN 'q_dead' ELSE 'q1' END AS dst FROM (SELECT unnest(['q0', 'q1', 'q_dead']) AS src), range(1, 27) r(i) WHERE NOT (src = 'q1' AND i IN (24, 25))
  UNION ALL VALUES ('q0', 'a', 'q0'), ('q1', 'x', 'q9'))
SELECT 'not exactly one start state' AS problem FROM s HAVING count(*) FILTER (is_start) <> 1
UNION ALL SELECT 'two moves: ' || src || ' ' || symbol FROM t GROUP BY src, symbol HAVING count(*) > 1
UNION ALL SELECT 'moves missing: ' || state FROM s WHERE EXISTS (SELECT symbol FROM t EXCEPT SELECT symbol FROM t WHERE src = state)
UNION ALL SELECT DISTINCT 'unknown state: ' || q FROM (SELECT src AS q FROM t UNION SELECT dst FROM t) WHERE q NOT IN (SELECT state FROM s)
"""


def dot(name: str, states: str, edges: str) -> str:
    """Lines of a digraph; ``states`` has state, is_start, is_accept, ``edges`` src, label, dst."""
    return f"""
WITH states AS ({states}), edges AS ({edges})
SELECT 'digraph {name} {{' AS line UNION ALL SELECT '  rankdir=LR' UNION ALL SELECT '}}'
UNION ALL SELECT '  "' || state || '" [shape=' || CASE WHEN is_accept THEN 'doublecircle' ELSE 'circle' END || ']' FROM states
UNION ALL SELECT '  "" [shape=none]' FROM states WHERE is_start
UNION ALL SELECT '  "" -> "' || state || '"' FROM states WHERE is_start
UNION ALL SELECT '  "' || src || '" -> "' || dst || '" [label="' || label || '"]' FROM edges
"""


DFA_DOT = dot(
    "words",
    "SELECT * FROM (VALUES ('q0', true, false), ('q1', false, true), ('q_dead', false, false)) v(state, is_start, is_accept)",
    "SELECT src, chr(96 + i::INT) AS label, CASE WHEN src = 'q_dead' THEN 'q_dead' ELSE 'q1' END AS dst FROM (SELECT unnest(['q0', 'q1', 'q_dead']) AS src), range(1, 27) r(i)",
)
NOUN_DOT = dot(
    "nouns",
    "SELECT state, state = 'q0' AS is_start, state = 'qF' AS is_accept FROM (SELECT unnest(['q0', 'qN', 'qES', 'qY', 'qF', 'qD']) AS state)",
    """SELECT * FROM (VALUES ('q0', 'letter : same', 'qN'), ('qN', 'normal letter : same', 'qN'), ('qN', 's/x/z : same', 'qES'), ('qN', 'ch/sh : same', 'qES'), ('qN', 'y : y', 'qY'),
  ('qN', 'END : +N+SG', 'qF'), ('qN', 's : +N+PL', 'qF'), ('qES', 'es : +N+PL', 'qF'), ('qY', 'ies : +N+PL', 'qF'), ('qES', 's : Invalid', 'qD'), ('qY', 's : Invalid', 'qD')) v(src, label, dst)""",
)


def oracle_sql() -> dict[str, str]:
    nouns = f"WITH nouns AS ({NOUNS}) "
    return {
        "sentence_split": SENTENCES,
        "word_tokens": TOKENS,
        "tokenized_sentences": f"SELECT doc_ord, sent_idx, tokenized_sentence FROM ({TOKENIZED})",
        "tokenized_sentences_sql": f"SELECT doc_ord, sent_idx, tokenized_sentence FROM ({TOKENIZED})",
        "corpus_stats_inline": STATS_A,
        "corpus_stats_table": STATS_B,
        "doc_limit": f"SELECT doc_id AS doc_ord FROM documents ORDER BY doc_id LIMIT {DOC_LIMIT}",
        "doc_limit_literal": f"WITH n AS ({NTH}), s AS (SELECT min(doc_id) AS m FROM documents, n WHERE doc_id >= n.n AND text <> '') SELECT doc_id AS doc_ord FROM documents, n, s WHERE n.c < {DOC_LIMIT} OR s.m IS NULL OR doc_id <= s.m",
        "table_profile": "SELECT count(*) AS row_count, 'sent_id,doc_ord,sent_idx,tokenized_sentence,shard,written_at' AS column_names FROM indiccorp_te_tokenized",
        "head_split": f"SELECT sent_id, tokenized_sentence, {words('tokenized_sentence')} AS words FROM (SELECT * FROM indiccorp_te_tokenized ORDER BY sent_id LIMIT 10)",
        "url_tokens": f"SELECT doc_ord, token, count(*) AS n FROM (SELECT rec_id AS doc_ord, unnest({tokens('content')}) AS token FROM oscar_te) WHERE regexp_full_match(token, '{URL}') GROUP BY doc_ord, token",
        "token_kind_counts": f"SELECT {KIND} AS kind, sum(n)::BIGINT AS tokens, count(*) AS types FROM (SELECT token, count(*) AS n FROM ({TOKENS}) GROUP BY token) GROUP BY 1",
        "dfa_accept": f"SELECT word, CASE WHEN regexp_full_match(word, '[a-z]+') THEN 'Accepted' ELSE 'Not Accepted' END AS result FROM ({WORDS})",
        "dfa_accept_ci": f"SELECT word, regexp_full_match(lower(word), '[a-z]+') AS valid FROM ({WORDS})",
        "dfa_run": "SELECT line_no, coalesce(regexp_full_match(noun, '[a-z]+'), false) AS accepted FROM noun_list",
        "dfa_transitions": "SELECT src, chr(96 + i::INT) AS symbol, CASE WHEN src = 'q_dead' THEN 'q_dead' ELSE 'q1' END AS dst FROM (SELECT unnest(['q0', 'q1', 'q_dead']) AS src), range(1, 27) t(i)",
        "dfa_check": "SELECT ''::VARCHAR AS problem WHERE false",
        "dfa_faults": FAULTS,
        "dfa_dot": DFA_DOT,
        "noun_fst_dot": NOUN_DOT,
        "noun_lexicon": NOUNS,
        "plural_class": f"{nouns} SELECT noun, {CLASS.format('noun')} AS plural_class FROM nouns",
        "morph_analyze": nouns + analysis(FORMS, "word"),
        "morph_corpus": nouns + f"SELECT word || ' = ' || analysis AS value FROM ({analysis('SELECT noun FROM nouns', 'noun')})",
        "segment_greedy": SEGMENT + "SELECT case_id, array_to_string(words, '|') AS words FROM greedy",
        "segment_metrics": METRICS,
        "segment_report": REPORT,
        "segment_dp": SEGMENT + "SELECT case_id, array_to_string(words, '|') AS words FROM dp",
    }
