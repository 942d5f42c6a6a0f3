"""Language identification counts document frequencies over the corpus, not over its sample."""

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import langid
from factloom.llm.shared import fold


def test_idf_is_that_of_all_learning_texts(spark):
    rows = [(i, f"the house {'q' * (i % 3)} water", "en") for i in range(900)] + [(900 + i, f"das haus {'x' * (i % 2)} wasser", None if i % 5 == 0 else "de") for i in range(90)] + [(2000, "123", "en"), (2001, None, "en"), (None, "zzz", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, sample_rows=40)
    seen = [langid.ngram_counts(r["text"]) for r in df.where(fold(F.col("doc_id"), langid.FOLDS) != langid.HELD_OUT).collect() if r["text"]]
    seen = [x > 0 for x in seen if x is not None]
    want = np.log((1 + len(seen)) / (1 + np.sum(seen, axis=0))) + 1
    assert len(seen) > 700 and np.allclose(model.idf, want)
