"""The command line on small files: outputs, exit codes, limits, rounding."""

import json
import zipfile
from pathlib import Path
from types import SimpleNamespace

import pytest

from lexspark import cli, ship
from lexspark.operators import corpus
from lexspark.sources import io

TEXTS = ["A b. C d!", "", None, "Être 1.5 x. B www.a.b. c", "E f?"]


@pytest.fixture
def docs(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/in")
    return tmp_path


def lines(path):
    """Lines of the part files, in their order."""
    return [x for p in sorted(Path(path).glob("part-*")) for x in p.read_text(encoding="utf-8").split("\n")[:-1]]


@pytest.mark.parametrize("limit,documents", [([], 5), (["--limit", "0"], 0), (["--limit", "2"], 2), (["--limit", "2", "--literal-limit"], 4)])
def test_corpus_run(spark, docs, capsys, limit, documents):
    assert cli.main(["corpus", "indiccorp", f"{docs}/in", f"{docs}/out", *limit]) == 0
    stats = json.loads((docs / "out/indiccorp_statistics.json").read_text())
    df = corpus.documents(spark.createDataFrame(list(enumerate(TEXTS))[:documents], "doc_id bigint, text string"), "text", "doc_id")
    want = corpus.inline_statistics(df).first().asDict()
    assert stats == want and list(stats) == list(io.STATISTICS_A)
    sentences = [r.tokenized_sentence for r in corpus.tokenized_sentences(df).orderBy("doc_ord", "sent_idx").collect()]
    assert lines(f"{docs}/out/indiccorp_tokenized.txt") == sentences
    stored = spark.read.parquet(f"{docs}/out/indiccorp_tokenized.parquet")
    assert stored.columns == ["tokenized_sentence"] and stored.count() == len(sentences)
    said = capsys.readouterr().out
    assert f"total_documents: {documents}\n" in said and f"type_token_ratio: {stats['type_token_ratio']:.6f}" in said


def test_content_of_the_other_preset(spark, tmp_path):
    spark.createDataFrame([(0, "A b.", "x")], "doc_id bigint, content string, text string").write.parquet(f"{tmp_path}/in")
    assert cli.main(["corpus", "oscar", f"{tmp_path}/in", f"{tmp_path}/out"]) == 0
    assert lines(f"{tmp_path}/out/oscar_tokenized.txt") == ["A b ."]


def test_statistics_are_rounded(spark, tmp_path):
    rows = [("a b c",), ("a b",), ("dd",), (None,), (" ",)]
    spark.createDataFrame(rows, "tokenized_sentence string").coalesce(1).write.parquet(f"{tmp_path}/p")
    assert cli.main(["stats", f"{tmp_path}/p", f"{tmp_path}/new/s.json"]) == 0
    text = (tmp_path / "new/s.json").read_text()
    # 6 words in 3 sentences, 7 letters, 4 types
    assert json.loads(text) == {"total_sentences": 3, "total_words": 6, "total_characters": 10, "average_sentence_length": 2.0, "average_word_length": 1.1667, "unique_token_types": 4, "type_token_ratio": 0.666667}
    assert text.startswith('{\n  "total_sentences"')


@pytest.mark.parametrize("command", [["stats", "none", "x.json"], ["view", "none"], ["to-text", "none", "x"]])
def test_missing_input(spark, tmp_path, capsys, command):
    command[1] = f"file://{tmp_path}/none"  # any file system's address will do
    assert cli.main(command) == 1 and "no such file" in capsys.readouterr().err


def test_view_and_text(spark, tmp_path, capsys):
    spark.createDataFrame([(f"w{i:02} x",) for i in range(30)], "tokenized_sentence string").repartitionByRange(3, "tokenized_sentence").sortWithinPartitions("tokenized_sentence").write.parquet(f"{tmp_path}/p")
    assert cli.main(["view", f"{tmp_path}/p"]) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[0] == "30 ['tokenized_sentence']" and said[1::2] == [f"w{i:02} x" for i in range(10)] and said[2] == "['w00', 'x']"
    assert cli.main(["to-text", f"{tmp_path}/p", f"{tmp_path}/t"]) == 0
    assert lines(f"{tmp_path}/t") == [f"w{i:02} x" for i in range(30)]


def test_nouns(spark, tmp_path, capsys):
    (tmp_path / "n").write_text("Dogs\n dog \n80's\n\nfox\n")
    assert cli.main(["nouns", f"{tmp_path}/n", f"{tmp_path}/o"]) == 0
    assert lines(f"{tmp_path}/o") == ["dog = dog+N+SG", "dogs = dog+N+PL", "fox = fox+N+SG"]
    (tmp_path / "e").write_text("80's\n")
    for path in ("e", "none"):
        assert cli.main(["nouns", f"{tmp_path}/{path}", f"{tmp_path}/o2"]) == 1
    assert "the noun list is empty" in capsys.readouterr().err


def test_diagrams_and_segmentation(spark, tmp_path, capsys):
    assert cli.main(["dfa", f"{tmp_path}/d"]) == 0 and cli.main(["noun-fst", f"{tmp_path}/f"]) == 0
    assert sum("->" in x for x in lines(f"{tmp_path}/d")) == 53 and sum("->" in x for x in lines(f"{tmp_path}/f")) == 12
    (tmp_path / "s.json").write_text('{"word_counts": {"ab": 1}, "test_cases": [{"input": "abab", "ground_truth": "ab ab"}], "metadata": {"total_corpus_words": 1}}')
    assert cli.main(["segment", f"{tmp_path}/s.json"]) == 0 and "same" in capsys.readouterr().out


def test_package_is_shipped_to_a_cluster(spark):
    assert ship.ship(spark) is None  # local tasks share the driver's path
    sent = []
    context = SimpleNamespace(master="spark://somewhere:7077", addPyFile=sent.append)
    path = ship.ship(SimpleNamespace(sparkContext=context))
    assert sent == [path] and ship.ship(SimpleNamespace(sparkContext=context)) == path and len(sent) == 1  # once a session
    names = zipfile.ZipFile(path).namelist()
    assert {"lexspark/__init__.py", "lexspark/operators/segment.py"} <= set(names)
