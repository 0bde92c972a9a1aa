"""Automata, morphology, segmentation, sources and streaming on small fixtures."""

import itertools
import math
import random
import time
from io import StringIO

import pytest
from pyspark.sql import functions as F

from lexspark.operators import automata, dot, morphology, progress, segment
from lexspark.operators import corpus
from lexspark.sources import io
from lexspark.streaming import tokenize


def col(spark, values):
    return spark.createDataFrame([(v,) for v in values], "w string")


def test_acceptors(spark):
    words = ["cat", "zebra", "DogHouse", "dog1", " cats", "cat!", "hello world", "75%", "", "cat\n", None]
    r = col(spark, words).select("w", automata.accept(F.col("w")).alias("a"), automata.accept_ignoring_case(F.col("w")).alias("b"), automata.run(F.col("w"), automata.word_table(), "q0", {"q1"}).alias("c")).collect()
    assert {x.w for x in r if x.a == "Accepted"} == {"cat", "zebra"} == {x.w for x in r if x.c}
    assert {x.w for x in r if x.b} == {"cat", "zebra", "DogHouse"}


def test_tables_are_an_automaton(spark):
    assert automata.transitions(spark).count() == 78
    assert automata.check(automata.states(spark), automata.transitions(spark)).isEmpty()
    assert not automata.check(automata.states(spark), automata.transitions(spark).where("symbol <> 'a' or src <> 'q1'")).isEmpty()
    states = automata.states(spark).withColumn("is_start", F.lit(True))
    extra = spark.createDataFrame([("q0", "a", "q0"), ("q1", "a", "q9")], "src string, symbol string, dst string")
    faulty = automata.check(states, automata.transitions(spark).where("src <> 'q1'").unionByName(extra))
    assert {r.problem for r in faulty.collect()} == {"not exactly one start state", "two moves: q0 a", "moves missing: q1", "unknown state: q9"}
    lines = [r.line for r in dot.dot(dot.noun_edges(spark), dot.noun_states(spark), "n").orderBy("ord").collect()]
    assert lines[0] == "digraph n {" and lines[-1] == "}" and sum("->" in x for x in lines) == 12


LEXICONS = [
    ("fox watch try bag cat dog accomplishment", {"Dog": "dog+N+SG", "fox": "fox+N+SG", "foxes": "fox+N+PL", "watches": "watch+N+PL", "tries": "try+N+PL", "bags": "bag+N+PL", "accomplishments": "accomplishment+N+PL", **dict.fromkeys(["foxs", "watchs", "trys", "742", "80's", "a/3", "hello!", "", None], "Invalid Word")}),
    ("boy", {"boys": "Invalid Word", "boies": "boy+N+PL"}),
    ("ax axe axes", {"axes": "ax+N+PL"}),
    ("ty tie", {"ties": "ty+N+PL"}),
    ("tie", {"ties": "tie+N+PL"}),
    ("news new", {"news": "new+N+PL"}),
    ("class", {"class": "class+N+SG"}),
]


@pytest.mark.parametrize("lexicon,cases", LEXICONS)
def test_morphology(spark, lexicon, cases):
    nouns = morphology.lexicon(col(spark, lexicon.split()), "w")
    got = {r.w: r.analysis for r in morphology.analyze(col(spark, cases), "w", nouns).collect()}
    assert got == cases


def test_noun_list(spark):
    nouns = morphology.lexicon(col(spark, ["Dog", "80's", "", " cat ", "dog", "a/3", None]), "w")
    assert {r.noun for r in nouns.collect()} == {"cat", "dog"}
    assert {r.value for r in morphology.analyze_lexicon(nouns).collect()} == {"cat = cat+N+SG", "dog = dog+N+SG"}
    assert morphology.analyze(col(spark, ["a"]), "w", nouns.limit(0)).first().analysis == "Invalid Word"


def solve(text, vocab, total):
    """Both segmentations by trying everything."""
    greedy, i = [], 0
    while i < len(text):
        k = max((len(w) for w in vocab if text.startswith(w, i)), default=1)
        greedy.append(text[i : i + k])
        i += k
    score, last = {0: 0.0}, {}
    for end in range(1, len(text) + 1):
        for k in range(1, end + 1):
            w = text[end - k : end]
            if w in vocab and end - k in score and (s := score[end - k] + math.log(vocab[w] / total)) > score.get(end, -math.inf):
                score[end], last[end] = s, k
    dp, end = [], len(text)
    while end:
        dp.insert(0, text[end - last.get(end, 1) : end])
        end -= last.get(end, 1)
    return greedy, dp


@pytest.mark.parametrize("most", [200_000, 3])
def test_segmentation(spark, monkeypatch, most):
    monkeypatch.setattr(segment, "HELD_WORDS", most)  # both ways of finding candidates
    rnd = random.Random(3)
    vocab = {"a": 2, "aa": 1, "b": 1, "ab": 4, "bab": 3, "𝄞a": 1}
    texts = ["", None, "abx", "xab", "aab", "aa", "𝄞ab"] + ["".join(rnd.choice("aabx") for _ in range(rnd.randint(1, 12))) for _ in range(40)]
    cases = spark.createDataFrame(list(enumerate(texts)), "case_id bigint, input string")
    v = segment.vocabulary(spark.createDataFrame([*vocab.items(), ("zero", 0), ("", 5)], "word string, cnt bigint"))
    got = {r.case_id: (r.greedy, r.dp) for r in segment.segmentations(cases, v, 12).collect()}
    for i, t in enumerate(texts):
        assert got[i] == solve(t or "", vocab, 12), t
    assert {r.case_id: r.dp for r in segment.segmentations(cases, v.limit(0), 12).collect()} == {i: list(t or "") for i, t in enumerate(texts)}


def test_metrics(spark):
    rows = [("a|ab", "a|ab", 1.0, 0), ("the|cat", "thecat", 0.0, 1), ("x", "", 0.0, 1), ("a|b|c", "a|b", 1.0, 2)]
    df = spark.createDataFrame(rows, "p string, a string, acc double, d int")
    parts = {c: F.filter(F.split(c, r"\|"), lambda x: x != "") for c in "pa"}
    for r in df.select(segment.accuracy(parts["p"], parts["a"]).alias("x"), segment.edit_distance(parts["p"], parts["a"]).alias("y"), "acc", "d").collect():
        assert (r.x, r.y) == (r.acc, r.d)


def test_sources_and_sinks(spark, tmp_path):
    docs = corpus.documents(spark.createDataFrame([(0, "A b. C d!"), (1, "E")], "id int, t string"), "t", "id")
    rows = corpus.tokenized_sentences(docs)
    io.write_tokenized(rows, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").columns == ["tokenized_sentence"]
    io.parquet_to_text(spark, f"{tmp_path}/p", f"{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["A b .", "C d !", "E"]
    assert io.write_statistics(corpus.inline_statistics(docs), f"{tmp_path}/s.json")["total_sentences"] == 3
    (tmp_path / "seg.json").write_text('{"word_counts": {"ab": 1}, "test_cases": [{"input": "abab", "ground_truth": "ab ab"}],\n "metadata": {"total_corpus_words": 1}}')
    vocab, cases, total = io.read_segmentation(spark, f"{tmp_path}/seg.json")
    r = segment.report(segment.metrics(cases, segment.vocabulary(vocab), total)).first()
    assert r.dp_accuracy == r.greedy_accuracy == 1.0 and r.better_accuracy == "same"
    assert io.read_lines(spark, f"{tmp_path}/none").isEmpty()


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([(i, f"A {i}. B.") for i in range(9)], "doc_id bigint, text string")
    src.write.parquet(f"{tmp_path}/in")
    docs = tokenize.read_documents(spark, f"{tmp_path}/in", "doc_id bigint, text string", "text", "doc_id")
    said = StringIO()
    listener = progress.DocumentProgress(every=5, out=said)
    spark.streams.addListener(listener)
    try:
        for _ in range(2):  # a second run finds nothing new
            tokenize.write_tokenized(docs, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        until = time.time() + 20
        while listener.seen < 9 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 18 and said.getvalue() == "9 documents\n"


def test_messages_of_progress(spark):
    said = StringIO()
    listener = progress.DocumentProgress(every=10, out=said)
    for n in (9, 1, 5, 25):
        listener.add(n)
    assert said.getvalue().splitlines() == ["10 documents", "40 documents"]
    with progress.tasks(spark, "run", 0.05, said):
        spark.range(4).mapInPandas(lambda it: (time.sleep(0.3) or p for p in it), "id bigint").count()
    assert "run: " in said.getvalue() and "tasks" in said.getvalue()


def test_segmentation_joins_back(spark):
    words = ["".join(x) for x in itertools.product("ab", repeat=3)]
    cases = spark.createDataFrame(list(enumerate(words)), "case_id bigint, input string")
    v = segment.vocabulary(spark.createDataFrame([("ab", 2), ("b", 1)], "word string, cnt bigint"))
    rows = segment.segmentations(cases, v, 3).collect()
    assert {r.case_id: "".join(r.greedy) for r in rows} == {r.case_id: "".join(r.dp) for r in rows} == dict(enumerate(words))


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), sc._gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_large_vocabulary_moves_a_word_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(segment, "HELD_WORDS", 3)
    monkeypatch.setattr(segment, "BLOCK_CHARACTERS", 20_000)
    rnd = random.Random(5)
    vocab = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 20))): rnd.randint(1, 9) for _ in range(500)}
    parts = list(vocab)
    texts = ["".join(rnd.choice(parts) for _ in range(8)) for _ in range(1000)]
    cases = spark.createDataFrame([(i // 2, t, t) for i, t in enumerate(texts)], "case_id bigint, input string, ground_truth string")
    v = segment.vocabulary(spark.createDataFrame(list(vocab.items()), "word string, cnt bigint"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a vocabulary that is too large for it
    try:
        before = shuffled(spark)
        rows = segment.segmentations(cases, v, 2500).collect()
        assert shuffled(spark) - before < 10 * sum(map(len, texts))
        assert segment.metrics(cases, v, 2500).count() == 1000  # a row a case, though ids repeat
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = sorted((r.case_id, r.greedy, r.dp) for r in rows)
    assert got == sorted((i // 2, *solve(t, vocab, 2500)) for i, t in enumerate(texts))
