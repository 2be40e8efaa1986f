"""The pipeline against plain versions of its stages, each on its own input."""

import corpus_pipeline
from skerry.llm import langid, mixing
from tests.conftest import SF
from tests.llm import brute


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        made = stage(spark, docs, SF)
        made.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = sorted(r.doc_id for r in out.collect())
        if name == "language_id":
            rejected = {r.doc_id for r in langid.report(docs).collect() if r.rejected}
            assert after == sorted(r.doc_id for r in before if r.doc_id not in rejected) and len(after) > 0.98 * len(before)
        elif name == "near_dedup":
            assert after == sorted(d for d, *_, kept in brute.components([(r.doc_id, r.text) for r in before]) if kept)
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert after == sorted(d for d, *_, bad in brute.contamination([(r.doc_id, r.text) for r in before], bench) if not bad)
        elif name == "source_mix":
            copies = {r.doc_id: r.copies for r in mixing.report(docs).collect()}
            assert after == sorted(d for d, n in copies.items() for _ in range(n))
        else:
            assert [(r.doc_id, r.shard) for r in out.orderBy("doc_id").collect()] == [(d, brute.jump(brute.md5_key(d), 16)) for d in sorted(r.doc_id for r in before)]
        assert out.columns[: len(columns)] == columns
        docs = out


def _shard(doc):
    return brute.jump(brute.md5_key(doc), 16)


def test_run(spark):
    """The whole run's rows are those that the stages give one after another, and all of a document's copies share its shard."""
    out = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert out and all(r.shard == _shard(r.doc_id) and r.text == docs[r.doc_id].text for r in out)
    kept = {r.doc_id for r in out}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(bad for *_, bad in brute.contamination([(d, docs[d].text) for d in kept], bench))
    assert all(c[2] == c[0] for c in brute.components([(d, docs[d].text) for d in kept]))


def test_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty, long and equal texts, clashing names, and an empty table."""
    words = [f"w{k}" for k in range(60)]
    long_ = " ".join(f"{w}x{k}" for k in range(300) for w in words)
    texts = [" ".join(words), " ".join(words), None, "", "  ", long_, "quite another text of nine words to be kept here", " ".join(words[::-1])]
    rows = [(k, t, ["en", "de", None][k % 3], ["s", None][k % 2], None, "own", "h", "shard") for k, t in enumerate(texts)]
    rows += [(None, "a text without an id that is kept for once", None, None, None, None, None, None), (None,) * 8, rows[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, own string, h string, shard string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", long_[:400]), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns[: len(docs.columns)] == docs.columns and {(r.doc_id, r.text) for r in out.collect()} <= set(before)
        if name == "near_dedup":
            known = [x for x in before if x[0] is not None]
            assert {r.doc_id for r in out.collect() if r.doc_id is not None} == {d for d, *_, kept in brute.components(known) if kept}
        if name == "sharding":
            assert out.columns[-1] == "shard_" and all(r["shard_"] == _shard(r.doc_id) for r in out.collect())
        docs = out
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
