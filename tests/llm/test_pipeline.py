"""The pipeline's stages on one small corpus."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from concord.llm.common import materialize
from concord.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rnd, n):
    common = "the of and is that for with was are by".split()
    return " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) + ("." if rnd.random() < 0.15 else "") for _ in range(n))


def test_stages_in_order(spark, tmp_path):
    rnd = random.Random(3)
    clean = [prose(rnd, rnd.randint(80, 200)) for _ in range(60)]
    copy = clean[0].split()
    copy[40] = "changed"
    passage = prose(rnd, 60)
    texts = [*clean, clean[1], " ".join(copy), "%%% ### $$$ " * 80, "short", None, "", prose(rnd, 90) + " " + passage + " " + prose(rnd, 90), prose(rnd, 90) + " " + passage + " " + prose(rnd, 90)]
    rows = [(i, t, rnd.choice(("en", "de", None)), rnd.choice(("src0", "src7", None)), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS
    ids = {name: {r["doc_id"] for r in got} for name, got in seen.items()}
    assert ids["quality_rules"] == {*range(62), 66, 67}
    assert len(ids["ngram_join"]) == 62 and len(ids["ngram_join"] & {0, 61}) == 1 and len(ids["ngram_join"] & {1, 60}) == 1
    assert ids["suffix_dedup"] == ids["ngram_join"] and all(passage not in r["text"] for r in seen["suffix_dedup"])
    assert ids["mixing"] < ids["suffix_dedup"] and len(seen["packing"]) == len(seen["mixing"]) == len(ids["mixing"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids["packing"]


def test_empty_tables_repeated_ids_and_clashing_names(spark):
    rnd = random.Random(5)
    rows = [(i // 2, prose(rnd, 90), "en", "src1", 5, i) for i in range(20)] + [(None, prose(rnd, 90), None, None, None, 99), (3, None, "en", "src1", 0, 98)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row long").withColumns({"row": F.lit("mine"), "spans": F.lit(1), "kept": F.lit("x"), "epoch": F.lit(2)})
    for df, n in ((docs, 21), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            columns, df = df.columns, materialize(stage(spark, df, ""), name)
            if name != "packing":
                assert df.columns == columns
            if name in ("quality_rules", "ngram_join", "suffix_dedup"):
                assert df.count() == n and {r["_row"] for r in df.collect()} == ({*range(20), 99} if n else set())
        assert {"doc_id", "text", "_row", "row", "spans", "batch_id"} <= set(df.columns) and {r["_row"] for r in df.collect()} <= {*range(20), 99}


def test_passages_of_short_words_are_cut_and_short_ones_stay(spark):
    rnd = random.Random(8)
    passage, phrase = " ".join(rnd.choice("abcdefgh") for _ in range(51)), " ".join("".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(40))
    texts = [prose(rnd, 70) + " " + p + " " + prose(rnd, 70) for p in (passage, passage, phrase, phrase)]
    got = corpus_pipeline.passages_stage(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()
    kept = {r["doc_id"]: r["text"] for r in got}
    assert passage not in kept[0] + kept[1] and len(kept[0]) + 101 <= len(texts[0]) and [kept[2], kept[3]] == texts[2:]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
