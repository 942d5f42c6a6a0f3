"""Without anything to learn from, the quality stage drops no document."""

import pytest

from factloom.llm import quality

TEXTS = ["a", "", None, "good words. " * 50, "### $$$ " * 50, "é字", *[chr(97 + i) * (7 * i) for i in range(20)]]


@pytest.mark.parametrize("marks", [[], [(None, 1)], [(3, None), (4, 7)], [(9_999, 1), (9_998, 0), (9_997, 0), (9_996, 0), (9_995, 1)]])
def test_every_document_scores_a_half_and_stays(spark, marks):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, y in marks], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.op8(docs, labels).collect()} == {0.5}
    assert quality.keep_good(docs, labels).count() == len(TEXTS)
