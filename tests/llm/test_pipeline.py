"""Each stage against a brute-force version on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from ridgeline.llm import mixing
from ridgeline.session import materialize
from tests.duck import oracle
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_copies import slow_kept
from tests.llm.test_token_records import expected

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing", "token records"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(5000, None, "en", "s", 0), (5001, "", None, "s", 0), (5002, "12 !", "en", None, 4), (5003, "The others of that. " * 3000, None, None, None), (5004, "Of the others and that is.", "en", "s", 1), (5004, "Of the others and that is.", "en", "s", 1)], docs.schema)
    docs = docs.union(odd).withColumns({"row": F.lit(1), "score": F.lit("x"), "kept": F.lit(None).cast("int"), "root": F.lit(2)})
    columns = docs.columns

    def step(name, before):
        out = materialize(stages[name](spark, before, SF), "stage")
        if name != "token records":
            assert out.columns == columns and out.join(before, out.doc_id.eqNullSafe(before.doc_id), "left_anti").count() == 0
        return out

    def rows(frame):
        return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]

    one = step("language ID", docs)
    gone = {d for d, _ in rows(docs)} - {d for d, _ in rows(one)}
    assert {5000, 5001, 5002} <= gone and len(gone) < 8

    two = step("SimHash near-dedup", one)
    assert {d for d, _ in rows(two)} == slow_kept(rows(one))[0] and two.count() < one.count()

    three = step("benchmark decontamination", two)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in contaminated(rows(two), items) if not r[5]}
    assert {d for d, _ in rows(three)} == clean and len(clean) < two.count()

    four = step("mixing", three)
    names, want = oracle(SF, mixing.oracle_sql(), {"documents": three.select("doc_id", "text", "lang", "source").toPandas()})
    assert {d for d, _ in rows(four)} == {w[names.index("doc_id")] for w in want if w[names.index("kept")]}

    five = step("token records", four)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in five.collect()) == expected(rows(four))


def test_run_and_empty_table(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 300 and set(got.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "empty")
        assert docs.count() == 0
