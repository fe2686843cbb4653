import pytest
from pyspark.sql import functions as F

from quillscan.functions.text import casefold, normalize_text, percent, split_paragraphs, split_sentences, words


@pytest.fixture
def value(spark):
    return lambda expression, text: spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


def test_normalize(value):
    assert value(normalize_text, "a\u00a0b\u200b c\t ﬁ ① ２") == "a b c fi 1 2"


def test_sentences(value):
    assert value(split_sentences, 'He said "Go." Then left. 3.14 is pi.') == ['He said "Go.', "Then left.", "3.14 is pi."]
    assert value(split_sentences, "도시 사람이 다 요 가 왔다 그래 했다. 끝") == ["도시", "사람이 다", "요", "가 왔다", "그래 했다.", "끝"]


def test_sentences_keep_their_digits(value):
    # the n-th sentence once lost the digits of n at its ends
    assert value(split_sentences, "0 none. 1 is next! 22 for 2. Was it 3? 44 in 4") == ["0 none.", "1 is next!", "22 for 2.", "Was it 3?", "44 in 4"]
    assert value(split_sentences, " 0 spaced. ") == ["0 spaced."]


def test_paragraphs(value):
    assert value(split_paragraphs, "First  one.\n\n\r\n \n\nsecond") == ["First one.", "second"]


def test_tokens(value):
    assert value(words, "Straße ²½ it's well-known Ⅻ ٣") == ["Straße", "²½", "it's", "well-known", "Ⅻ", "٣"]
    assert value(casefold, "Straße ς") == "strasse σ"


@pytest.mark.parametrize("ratio,text", [(0.125, "12%"), (0.135, "14%"), (0.3333, "33%"), (1.0, "100%")])
def test_percent(value, spark, ratio, text):
    assert spark.range(1).select(percent(F.lit(ratio))).first()[0] == text
