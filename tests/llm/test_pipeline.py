import corpus_pipeline
from helpers import components

from platewright.llm import decontaminate, secret_scan, simhash, toxicity


def test_stages_take_effect(spark, sf, tmp_path):
    """Each stage is held against the plain reading of its operator's rows on its own input."""
    source = spark.read.parquet(f"{sf}/documents.parquet")
    columns = source.columns
    docs, sizes = source, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns and docs.count() == docs.select("doc_id").distinct().count()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        rows = before.select("doc_id", "text").collect()
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            scores = toxicity.toxicity(before, labels).collect()
            assert ids == {r.doc_id for r in scores if r.predicted == 0} and len(ids) < len(rows)
        if name == "near-duplicates":
            prints = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in rows}
            assert ids == set(components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4).values())
        if name == "decontamination":
            found = decontaminate.contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
            assert ids == {r.doc_id for r in found if not r.contaminated}
        if name == "secrets":
            assert len(ids) == len(rows)
            assert not any(r.base for r in secret_scan.find_secrets(docs).collect())
            changed = {r.doc_id for r in rows} - {
                r.doc_id for r in before.select("doc_id", "text").join(docs.select("doc_id", "text"), ["doc_id", "text"]).collect()
            }
            assert changed == {r.doc_id for r in secret_scan.find_secrets(before).collect() if r.spans}
        if name == "mixing":
            assert docs.columns == [*columns, "copy"]
            assert ids <= {r.doc_id for r in rows}
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() == sizes[-1]


def test_stages_on_no_rows(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
