"""The pipeline on a small table, each stage against what it must leave."""

import pytest


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    import random

    r = random.Random(11)
    say = lambda n: " ".join(f"word{r.randrange(400)}" for _ in range(n)) + "."
    rows = [(i, say(r.randrange(20, 80)), "en", r.choice(["a", "b", None]), 0) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more", "en", "a", 0) for i in range(20)]
    rows += [(400 + i, say(10) + " you vileword person. " + say(10), "en", "b", 0) for i in range(60)]
    rows += [(500, "write to a@b.cc now " + say(30), "en", "a", 0), (501, None, "en", "a", None), (502, "", None, None, 0)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    labels = [(i, 1, 0) for i in range(300)] + [(400 + i, 1, 1) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        after[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in after.items()}
    assert not ids["toxicity"] & set(range(400, 460)) and set(range(320)) <= ids["toxicity"] and {500, 501, 502} <= ids["toxicity"]
    assert not ids["near_dedup"] & set(range(300, 320)) and set(range(300)) <= ids["near_dedup"]
    assert "<EMAIL>" in after["pii"].where("doc_id = 500").first().text and after["pii"].count() == after["near_dedup"].count()
    assert ids["packing"] == ids["mixing"] and after["packing"].groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_run_equals_the_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, docs.select(columns).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(columns).collect()))


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_stages_take_odd_tables(spark, sf_dir, tmp_path, rows):
    """An empty table; nulls, ties, repeated rows, a long text and columns with names that operators use."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, _word int, _place int, copies int, rank int, mark long, part int"
    long = " ".join(f"w{i % 997}" for i in range(40_000))
    same = "one two three four five six seven eight nine ten"
    made = [] if rows == "none" else [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (4, same, "en", "b", 2), (5, same, "en", "b", 2), (5, same, "en", "b", 2), (None, "no id here", None, None, 3)]
    docs = spark.createDataFrame([(*x, 7, 7, 7, 7, 7, 7, 7) for x in made], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert name == "packing" or docs.columns == [x.split()[0] for x in schema.split(", ")]
        counts[name] = docs.count()
    assert counts == dict.fromkeys(counts, 0) if rows == "none" else (counts["toxicity"], counts["near_dedup"], counts["pii"]) == (7, 5, 5)
