import random

import corpus_pipeline
from pyspark.sql import functions as F

from quernel.llm import neardup


def test_rows_are_kept_by_id_and_text(spark):
    a, b, c = "x y z w v", "k l m n o", "p q r s t u"
    rows = [(4, a), (4, b), (4, b), (5, b), (3, a), (6, ""), (6, " "), (6, c), (None, c), (None, c), (None, c.upper()), (None, "e f g h"), (None, "e f g h"), (None, ""), (None, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit(1)).repartition(3)
    got = sorted((str(r.doc_id), (r.text or "").strip().lower()) for r in neardup.deduplicated_rows(df, shingle=3, num=85).collect())
    # of 4, the copy of 3 goes and the distinct text stays
    assert got == sorted([("3", a), ("4", b), ("6", ""), ("6", c), ("None", c), ("None", "e f g h"), ("None", ""), ("None", ""), ("7", "")])
    assert neardup.deduplicated_rows(df.where("false")).count() == 0


def test_near_copies_without_ids_and_the_stage(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(None, " ".join(words), "en", "s", 1), (None, near, "en", "s", 1), (9, "a b c d e f", "en", "s", 1), (9, "g h i j k l", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in out) == ["9", "9", "None"]


def test_stages_take_very_long_texts(spark):
    """A text of 1.5 MB among others, beside columns that any stage makes."""
    sf_dir, r = "/root/testdata/sf0.001", random.Random(1)
    good = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id = 6").first().text
    long = " ".join([good, *(r.choice(good.split()) for _ in range(250_000)), "token=abcdefgh1"])
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (3, good, "en", "s", len(good))], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        rows = {x.doc_id: x for x in stage(spark, docs.withColumns({c: F.lit(1) for c in ("node", "label", "pair", "_row", "n_words")}), sf_dir).collect()}
        assert set(rows) == ({1, 3} if name == "near-duplicates" else {1, 2, 3}), name
        assert rows[1].text == (long.replace("token=abcdefgh1", "[SECRET]") if name == "secrets" else long)
