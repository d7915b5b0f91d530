"""Single rules of earlier queries."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import language, neighbours


def test_a_text_without_a_letter_has_no_language(spark):
    assert language.words_of("½ ² ①② 12 Ⅻa٣b _x_ é") == ["a", "b", "x", "é"]
    rows = [(i, t, x) for i, (t, x) in enumerate([("das ist gut", "de"), ("this is it", "en")] * 20)]
    df = spark.createDataFrame(rows + [(100, "½ ²", None), (101, "①②", "de"), (102, "", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify_language(df, language.train_language(df)).collect()}
    assert [found[i] for i in (100, 101, 102)] == ["und"] * 3 and found[0] == "de" and found[1] == "en"


def test_another_row_of_the_same_key_is_a_candidate(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(30)]
    df = spark.createDataFrame(rows + [(20, [9.0, 0.0, 0.0, 0.0]), (0, rows[0][1])], "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=31).collect()
    lists = {}
    for r in found:
        lists.setdefault(r["query_id"], []).append(r["vec_id"])
    # Four query rows, two of either key; each meets the other row of its key, and none itself.
    assert [len(lists[q]) for q in (0, 20)] == [62, 62]
    assert lists[0].count(0) == 2 and lists[20].count(20) == 2
