import brute
import corpus_pipeline
from compare import SF
from pyspark.sql import functions as F

from quantloom.llm import common, jaccard, quality, toxicity


def test_stages_match_their_operators(spark):
    docs = common.table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    one = common.materialise(stages["quality rules"](spark, docs, SF), "one")
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    two = common.materialise(stages["toxicity"](spark, one, SF), "two")
    model = toxicity.sample_and_train(one, common.table(spark, SF, "labels"), common.crc32_mod("doc_id", 4) != 2)
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in toxicity.score(one, model).where("predicted = 0").collect()}
    three = common.materialise(stages["near duplicates"](spark, two, SF), "three")
    want = brute.components([(r.doc_id, r.text) for r in two.collect()], 5, 80)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == {i for i, (_, c) in want.items() if c == i}
    rows = stages["packing"](spark, three, SF).collect()
    brute.pieces_fit([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
    assert {r.doc_id for r in rows} == {r.doc_id for r in three.collect()}


def test_run_on_odd_documents(spark, docs, tmp_path):
    """Ordinary documents with near copies and repeated rows among null, empty, odd and very long texts."""
    own = common.table(spark, SF, "documents").where("doc_id < 80").select("doc_id", "text", "lang", "source")
    copies = own.withColumns({"doc_id": F.col("doc_id") + 1000, "text": F.concat("text", F.lit(" more"))})
    odd = docs.select((F.col("doc_id") + 5000).alias("doc_id"), "text", "lang", "source")
    rows = own.unionByName(copies).unionByName(own.where("doc_id % 7 = 0")).unionByName(odd).unionByName(odd.limit(3))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = common.materialise(quality.keep_quality(rows), "good")
    model = toxicity.sample_and_train(good, labels, common.crc32_mod("doc_id", 4) != 2)
    clean = {(r.doc_id, r.text) for r in toxicity.keep_clean(good, model).collect()}
    want = brute.components(sorted(clean), 5, 80)
    kept = {i for i, (_, c) in want.items() if c == i}
    assert len(kept) < len(want) and {r.doc_id for r in out} == kept
    assert len({(r.doc_id, r.piece) for r in out}) == len(out)
    brute.pieces_fit([(r.sequence_id, r.offset, r.length) for r in out], 2048)


def test_run_on_an_empty_table(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_threshold_of_near_duplicates_is_exact():
    for a in range(1, 60):
        for b in range(1, 60):
            for percent in (80, 90):
                least = next((i for i in range(a + b + 1) if 100 * i >= percent * (a + b - i)), None)
                assert jaccard.needed(a, b, percent) == least
