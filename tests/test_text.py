import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as T


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,n", [("It rose (Lee, 2001).", 2), ("(ibid) yes", 1), ("( , )", 0), ("", 0), ("in 1999 we", 3), ("a (the other) b", 4), ("see (Roe ET AL) x", 2)])
def test_assessed_words(spark, text, n):
    assert one(spark, T.assessed_words, text) == n


@pytest.mark.parametrize("text,item", [("1. x", True), ("2)", True), ("AB12 x", True), ("• x", True), ("x\ty", True), ("J. R. wrote", False), ("1984 was", False), ("ABCDEF1 x", False), ("", False)])
def test_list_items(spark, text, item):
    assert one(spark, T.is_list_item, text) is item


def test_sentences_keep_one_closer(spark):
    assert one(spark, T.sentences, "He left.” She stayed!) No?  Yes") == ["He left.”", "She stayed!)", "No?", "Yes"]


def test_sample_problem_order(spark):
    body = "Word " * 59 + "end."
    assert one(spark, T.sample_problem, body) is None
    assert one(spark, T.sample_problem, "short") == "only 1 words"
    assert one(spark, T.sample_problem, "x" + body) == "starts mid-sentence"
    assert one(spark, T.sample_problem, body[:-1]) == "ends mid-sentence"
    assert one(spark, T.sample_problem, "Word ** " + body) == "contains markdown"


def test_trim_keeps_whole_sentences(spark):
    assert one(spark, lambda c: T.trim_to_words(c, 3), "One two. Three four. Five. (12 words)") == "One two. Three four."
    assert one(spark, lambda c: T.trim_to_words(c, 99), "One two. and then") == "One two."
    assert one(spark, lambda c: T.trim_to_words(c, 99), "no stop") == ""


def test_empty_text_is_no_prose(spark):
    assert one(spark, lambda c: T.is_prose(c, 0), "") is False


@pytest.mark.parametrize("damaged,clean", [('the "word" 4 next', 'the "word" next'), ("warm°, then", "warm, then"), ("H2O at 25°C", "H2O at 25°C"), ('said "no" I left', 'said "no" I left')])
def test_strip_markers(spark, damaged, clean):
    assert one(spark, T.strip_markers, damaged) == clean
