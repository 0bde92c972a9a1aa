"""Hand-counted tokenizer and sentence cases, and properties every tokenization keeps."""

import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexspark.functions import sql, tokens as T
from lexspark.functions.charclass import WS
from lexspark.operators import compat, corpus

WORDS = {
    "Être": "Ê tre", "dog1": "dog 1", "abc12": "abc 1 2", "5వ": "5 వ", "కి12": "కి 12", "క12": "క 1 2", "a_b": "a _ b", "don't": "don ' t", "1,000.50": "1 , 000.50", "1.2.3": "1.2 . 3", "3.14.15": "3.14.15",
    "70.23.22.57": "70.23.22 . 57", "152.143.123.131": "152.143 . 123.131", "(523) 555-1055": "( 523 ) 555 - 1055", "2026-13-99": "2026-13-99", "WWW.A.com, x": "WWW.A.com, x", "a.b@c.org.": "a.b@c.org .", "a@b.com1": "a@b.com 1", "": "",
}
SENTENCES = {
    "": [], " \t": [], "A b.  C d! E": ["A b.", "C d!", "E"], "A b.C d": ["A b.C d"], 'He said "no." Then': ['He said "no." Then'], "see www.a.b. Next one. End": ["see www.a.b. Next one.", "End"], "x। y": ["x।", "y"],
    "Wait... what?! ok": ["Wait...", "what?!", "ok"], "line one\nline two": ["line one\nline two"], "A 1.5 x. B 2.5 y.": ["A 1.5 x.", "B 2.5 y."],
}
#: a text of our own with its sentences as token lines, counted by hand
SAMPLE = "రామయ్య ఉదయం పొలానికి వెళ్ళాడు. వాన రాలేదు! Visit www.rain.example/map?x=1 now? Mail ravi.k@farm.example or pay 12.75 by 3/4/2025.\nఎవరు వచ్చారు? పంట బాగుంది।"
SAMPLE_LINES = [
    "రామయ్య ఉదయం పొలానికి వెళ్ళాడు .", "వాన రాలేదు !", "Visit www.rain.example/map?x=1 now ?",
    "Mail ravi.k@farm.example or pay 12.75 by 3/4/2025 .", "ఎవరు వచ్చారు ?", "పంట బాగుంది ।",
]
SAMPLE_KINDS = ["latin_word", "email", "latin_word", "latin_word", "decimal", "latin_word", "date", "punct"]


def tokens_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", T.word_tokens("t").alias("x")).orderBy("i").collect()]


def test_words(spark):
    assert [" ".join(x) for x in tokens_of(spark, WORDS)] == list(WORDS.values())


def test_sentences(spark):
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "i int, t string")
    assert [r.x for r in df.select("i", T.sentences("t").alias("x")).orderBy("i").collect()] == list(SENTENCES.values())


def test_sample(spark):
    docs = corpus.documents(spark.createDataFrame([(0, SAMPLE), (1, None), (2, "")], "id int, t string"), "t", "id")
    rows = corpus.tokenized_sentences(docs).orderBy("sent_idx").collect()
    assert [r.tokenized_sentence for r in rows] == SAMPLE_LINES
    r = corpus.inline_statistics(docs).first()
    # 5 + 3 + 4 + 8 + 3 + 3 words, of which '.' and '?' come twice
    assert (r.total_documents, r.total_sentences, r.total_words, r.unique_tokens) == (3, 6, 26, 24)
    assert r.total_characters == sum(map(len, SAMPLE_LINES)) and r.original_characters == len(SAMPLE)
    kinds = spark.createDataFrame(list(enumerate(SAMPLE_LINES[3].split(" "))), "i int, t string")
    assert [r.k for r in kinds.select("i", T.token_kind("t").alias("k")).orderBy("i").collect()] == SAMPLE_KINDS


def test_empty_and_missing_field(spark):
    docs = corpus.documents(spark.createDataFrame([], "id int, t string"), "other", "id")
    r = corpus.inline_statistics(docs).first()
    assert r.total_documents == 0 and r.average_word_length == 0.0 and r.type_token_ratio == 0.0
    r = corpus.table_statistics(spark.createDataFrame([(None,), (" ",)], "tokenized_sentence string")).first()
    assert r.total_sentences == 0 and r.average_sentence_length == 0.0


def test_white_space_is_pythons(spark):
    chars = spark.createDataFrame([(o, chr(o)) for o in range(0x3100)], "id int, c string")
    java = {r.id for r in chars.where(f"c rlike r'[{WS}]'").collect()}
    assert java == {o for o in range(0x3100) if chr(o).isspace()}


def test_statistics_agree(spark):
    docs = corpus.documents(spark.createDataFrame([(i, SAMPLE[i:]) for i in range(40)], "id int, t string"), "t", "id")
    a, b = corpus.inline_statistics(docs).first(), corpus.table_statistics(corpus.tokenized_sentences(docs)).first()
    assert (a.total_sentences, a.total_words, a.total_characters, a.unique_tokens) == (b.total_sentences, b.total_words, b.total_characters, b.unique_token_types)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1Ź9.,-/@:w _కిం౧é\n‌।!? ", max_size=30), min_size=20, max_size=40))
def test_tokens_keep_what_they_promise(spark, texts):
    alone, both = tokens_of(spark, texts), tokens_of(spark, [f"{a} {b}" for a, b in zip(texts, texts[1:])])
    for t, tokens in zip(texts, alone):
        assert "".join(tokens) == "".join(t.split()) and all(tokens)  # nothing is lost, and white space is no token
        at = -1
        for x, y in zip(tokens, tokens[1:]):
            at = t.index(x, at + 1)
            close = t[at + len(x) : at + len(x) + 1] == y[:1] and not x[-1].isdigit()  # a number ends where a sign follows
            for low, high in (("ఀ", "౿"), ("a", "z")):  # runs of one class are whole
                assert not (close and low <= x[-1] <= high and low <= y[0] <= high and all(low <= c <= high for c in x + y)), (t, tokens)
    for (a, b), tokens in zip(zip(alone, alone[1:]), both):
        assert tokens == a + b  # white space parts independent texts


def test_long_runs_are_read_once(spark):
    texts = ["a." * 60_000, "x1" * 60_000, "ab" * 60_000, "1" * 60_000]
    began = time.time()
    assert [len(x) for x in tokens_of(spark, texts)] == [120_000, 120_000, 1, 1]
    assert time.time() - began < 20


def test_sql_functions(spark):
    assert set(sql.register(spark)) >= {"lex_word_tokens", "lex_sentences"}
    r = spark.sql("SELECT lex_word_tokens('a b@c.de 1.5') AS t, lex_sentences('A. B') AS s, lex_plural_class('fox') AS c").first()
    assert (r.t, r.s, r.c) == (["a", "b@c.de", "1.5"], ["A.", "B"], "ES")


def test_literal_sentences(spark):
    cases = {
        "A 1.5 x. B 2.5 y.": ["A 1.5 x.", "B 1.5 y."],  # the first decimal lands in both
        "1234567.89 a@b.co": ["a@b.co\0\0\0\0 \0\0\0\0\0\0"],  # the e-mail lands inside the longer number
        "see www.a.b. Next x@y.zz. End": ["see www.a.b. Next x@y.zz.", "End"],
        "no gap. at all": ["no gap.", "at all"],
        " \n": [],
    }
    for text, want in cases.items():
        assert compat.split_literally(text) == want
    assert compat.split_literally(None) == []
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*cases, None])], "i int, t string")
    assert [r.x for r in df.select("i", compat.literal_sentences("t").alias("x")).orderBy("i").collect()] == [*cases.values(), []]


@pytest.mark.parametrize("literal,ids", [(False, [0, 1]), (True, [0, 1, 2])])
def test_document_limit(spark, literal, ids):
    docs = corpus.documents(spark.createDataFrame(list(enumerate(["a.", "", "b.", "c."])), "id int, t string"), "t", "id")
    assert [r.doc_ord for r in corpus.limit_documents(docs, 2, literal).orderBy("doc_ord").collect()] == ids
    assert corpus.limit_documents(docs, 9, literal).count() == 4

