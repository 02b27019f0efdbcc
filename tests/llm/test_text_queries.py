"""The text queries against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from compare import differences, duck
from ratewell.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_like_its_sql(spark, database, name):
    assert differences(QUERIES[name].run(spark, FOLDER), database.sql(QUERIES[name].sql)) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op6_packing", "op13_conversation_trie")])
def test_one_row_per_input_row(spark, name):
    table, key = ("pages", "page_id") if name == "op4_url_filter" else ("documents", "doc_id")
    rows = [r[key] for r in QUERIES[name].run(spark, FOLDER).select(key).collect()]
    given = [r[key] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()]
    assert sorted(rows) == sorted(given)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() < before, name
    assert docs.agg({"length": "max"}).first()[0] <= 2048
    again = corpus_pipeline.run(spark, FOLDER)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))


def test_pipeline_takes_odd_documents(spark, documents):
    docs = documents.selectExpr("doc_id", "text", "host AS lang", "ids AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() > 0


def test_near_copies_with_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(3, text), (7, text.replace("w30", "new")), (7, other), (9, "x y z"), (9, "x y z"), (None, text), (None, "lonely words here"),
            (None, ""), (11, None), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [
        (3, text), (7, other), (9, "x y z"), (None, "lonely words here"), (None, ""), (11, None), (11, None)]))


def test_stages_bound_the_bytes_of_a_batch(spark, monkeypatch):
    def sizes(docs, path):
        return docs.mapInPandas(lambda batches: (b.assign(text=b["text"].str.len().sum())[["text"]][:1] for b in batches), "text long")

    monkeypatch.setattr(corpus_pipeline.packing, "pack", sizes)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(40, numPartitions=1).selectExpr("id AS doc_id", "repeat('x', 1000000) AS text")
    spark.conf.unset(name)
    found = [r["text"] for r in corpus_pipeline.pack(spark, docs, FOLDER).collect()]
    assert sum(found) == 40_000_000 and max(found) <= corpus_pipeline.BATCH_BYTES + 1_000_000
