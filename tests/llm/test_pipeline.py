"""The pipeline's stages on a small corpus."""

import pytest

import corpus_pipeline
from meshloom.llm import jaccard, quality, queries, toxicity


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {}
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf_dir).write.parquet(str(tmp_path / str(k)))
        before, now = now, spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert now.columns == docs.columns
        kept[name] = before, now
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    before, after = kept["quality rules"]
    assert ids(after) == sorted(r["doc_id"] for r in quality.quality_verdicts(before).collect() if r["kept"])
    before, after = kept["toxicity"]
    assert ids(after) == sorted(r["doc_id"] for r in toxicity.toxicity_scores(before, labels).collect() if not r["predicted"])
    before, after = kept["n-gram Jaccard join"]
    assert ids(after) == sorted({r["component_id"] for r in jaccard.jaccard_components(before).collect()})
    before, after = kept["best-fit packing"]
    assert sorted({r["doc_id"] for r in after.collect()}) == ids(before)
    ran = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, ran.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, after.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "best-fit packing"]


WORDS = [f"plain{i} simple{i} words{i} of{i} usual{i} length{i}" for i in range(40)]
GOOD, OTHER = " ".join(WORDS[:12]), " ".join(WORDS[12:30])
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k int, y string, n int, part int, comp long, rep long, sig long, failed_bits int, utf8 string, task int, length int"


def odd(spark, rows):
    """Documents with nulls in every column and names that the stages use inside."""
    full = [(i, t, None, None, None, 1, None, 3, None, 5, None, 7, None, "u", None, 9) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.mark.parametrize("rows", [
    [(5, GOOD), (3, GOOD), (3, GOOD), (None, GOOD), (None, OTHER), (7, None), (8, ""), (9, OTHER + " end"), (10, "few words"), (11, "again " * 400), (12, " ".join(f"long{i}" for i in range(30_000)))],
    [(None, None), (None, "")], [],
])
def test_stages_on_odd_rows(spark, tmp_path, monkeypatch, rows):
    labels = spark.createDataFrame([(None, 1, 1), (3, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: {"labels": labels}[name])
    docs = now = odd(spark, rows)
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "nowhere").write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert now.schema.simpleString() == docs.schema.simpleString()
        seen.append(sorted(((r["doc_id"] is not None, r["doc_id"] or 0) for r in now.select("doc_id").collect())))
    if len(rows) > 2:
        left = [(False, 0), (False, 0), (True, 3), (True, 3), (True, 5), (True, 9), (True, 12)]
        assert seen[0] == seen[1] == left
        # the keyless copy goes with its group, and so does 5; 3 is one document in two rows; the keyless text near 9 stays
        assert seen[2] == [(False, 0), (True, 3), (True, 3), (True, 9), (True, 12)]
        assert set(seen[3]) == set(seen[2])
    else:
        assert seen == [[]] * 4
