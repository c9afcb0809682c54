"""The pipeline's stages on a small corpus, each against what it must keep."""

import __spark_entry__
import corpus_pipeline
import pytest

from .test_operators import brute_repeats, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    passage = prose(5000, 60)
    rows = [(i, prose(i, 150), "en") for i in range(60)]
    rows += [(100, rows[0][1], "en"), (101, rows[1][1].replace("the", "th3", 1), "en"), (102, "1234 !!", "en"), (103, None, None), (104, "too short", "en")]
    rows += [(110 + i, prose(7000 + i, 100) + " " + passage + " " + prose(8000 + i, 100), "en") for i in range(2)]
    junk = lambda s: " ".join(w + "***" for w in prose(s, 90).split())
    rows += [(200 + i, junk(9000 + i), "en") for i in range(120)]
    spark.createDataFrame([(i, t, lang, "src", len(t or ""), "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in rows if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{tmp_path}/{at}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{at}")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r for r in docs.collect()}
        if name == "substring":
            rows = before.collect()
            want = {r.doc_id: x for r, x in zip(rows, brute_repeats([r.text for r in rows], 35))}
            for i, r in kept[name].items():
                old = next(x for x in rows if x.doc_id == i)
                assert r.text == (want[i][2] if want[i][1] else old.text) and r.n_chars == len(r.text)
            assert want[110][1] == want[111][1] >= 60
    clean = set(range(60)) | {110, 111}
    assert set(kept["language"]) == clean | {100, 101, 104} | set(range(200, 320))
    assert set(kept["quality"]) == clean | {100, 101}
    assert set(kept["near_dedup"]) == clean == set(kept["substring"])
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == clean


def test_empty_corpus(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
