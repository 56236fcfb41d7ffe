"""The pipeline's stages keep the columns of documents, and its queries are registered."""

from __future__ import annotations

import random


def test_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    words = [f"word{k}" for k in range(2000)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    clean = [make(120) for _ in range(20)]
    passage = make(60) + "."
    rows = [(k, t, "en", f"h{k % 3}", len(t)) for k, t in enumerate(clean)]
    rows += [(100, clean[3], "en", "h0", 0), (101, clean[4] + " tail", "en", "h1", 0), (102, "too short", "en", "h1", 0), (103, None, None, None, None)]
    rows += [(110 + k, make(60) + ".\n" + passage + "\n" + make(60), "en", "h2", 0) for k in range(3)]
    rows += [(120, clean[0][:0] + make(80) + " password = hunter2hunter2x", "en", "h2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        assert docs.columns == columns, name
        seen[name] = {x["doc_id"]: x for x in docs.collect()}
    assert set(seen["quality rules"]) == {*range(20), 100, 101, 110, 111, 112, 120}
    assert set(seen["n-gram Jaccard join"]) == {*range(20), 110, 111, 112, 120}
    texts = seen["substring dedup"]
    assert passage in texts[110]["text"] and passage not in texts[111]["text"] + texts[112]["text"]
    assert all(texts[k]["text"] == clean[k] for k in range(20))
    last = seen["secret scans"]
    assert "hunter2" not in last[120]["text"] and last[120]["n_chars"] == len(last[120]["text"])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == set(last)


CLASHES = ["_w", "_doc", "_text", "_source", "host", "start", "n_words", "class", "_spans", "_id", "_key", "digest", "kept", "n", "rate", "base", "shard", "comp"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, an empty text, a very long one, columns with the names that stages use, and no rows."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    r = random.Random(4)
    long = " ".join(f"w{r.randrange(50_000)}" for _ in range(60_000))
    same = " ".join(f"v{k}" for k in range(70))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, long, None, None, len(long)), (3, same, "en", "a", None), (3, same, "en", "a", None), (4, same, "en", None, 3), (None, same + " x", None, "a", None), (5, " \n\t", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == before.columns and all(x[c] == k for x in docs.collect() for k, c in enumerate(CLASHES)), name
        none = stage(spark, before.limit(0), str(tmp_path))
        assert none.count() == 0
    assert dict(seen)["quality rules"] == 5 and dict(seen)["n-gram Jaccard join"] == 4  # long, both rows of 3, and the row without an id


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
