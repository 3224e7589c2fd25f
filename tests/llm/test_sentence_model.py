"""What the sentence model is fitted on: words from all distinct texts, weights from a sample of them."""

from __future__ import annotations

from cellwright.llm.sentence_split import _sample, train

WORDS = [f"{a}{b}ra" for a in "klmn" for b in "aeiou"][:16]


def _docs(spark):
    texts = [f"{w.title()} was seen on day {k} by {w}." for w in WORDS for k in range(25)]
    texts += [f"Seldom was seen on day {k} by seldom." for k in range(4)] + ["Copied was seen by copied."] * 200
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_words_come_from_all_texts(spark):
    _, starters, finals = train(_docs(spark), "id", "text", sample_docs=40)
    assert set(WORDS) <= starters and set(WORDS) <= finals  # 25 times in 405 texts, more than 2 in 40
    assert not {"seldom", "copied"} & (starters | finals)  # 4 times, and one text however often it comes


def test_sample_holds_each_text_once(spark):
    docs = _docs(spark).groupBy("text").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    some, n = _sample(docs, 1000, 3)
    assert n == 405 and some.count() == 405
    few, _ = _sample(docs, 100, 3)
    assert 50 < few.count() < 150
