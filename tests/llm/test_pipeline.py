import corpus_pipeline
from pyspark.sql import functions as F
from test_counts_and_packing import check_pieces
from test_duplicates import brute_lines, brute_simhash, components

from meshlight.llm import decontaminate

NAMES = ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]


def test_stages_against_brute_force(spark, rows, docs, tmp_path):
    rows = [(*r[:2], "en", *r[3:]) for r in rows]
    folder = str(tmp_path)
    passage = next(r[1] for r in rows if r[1] and r[1].startswith(rows[12][1][:20]))[40:300]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        columns = now.columns
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        after = now.collect()
        if name == "packing":
            check_pieces(after, before)
            continue
        assert now.columns == columns and all(r.n_chars == len(r.text or "") for r in after)
        got = {r.doc_id: r.text for r in after}
        if name == "language_id":
            want = {i: t for i, t in before.items() if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            want = {i: t for i, (t, _, gone) in brute_lines(before).items() if not gone or t.strip(" ")}
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            least = components([brute_simhash(before[i]) for i in ids])
            want = {i: before[i] for k, i in enumerate(ids) if least[k] == k}
        else:
            want = {i: t for i, t in before.items() if decontaminate.folded(passage) not in decontaminate.folded(t)}
        assert got == want
        assert len(got) < len(before)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in now.collect())


def test_repeated_rows_and_empty_table(spark, docs, none):
    kept = corpus_pipeline.simhash_stage(spark, docs, "")
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and kept.columns == docs.columns
    for stage in (corpus_pipeline.language_id, corpus_pipeline.line_dedup_stage, corpus_pipeline.simhash_stage, corpus_pipeline.packing_stage):
        assert stage(spark, none, "").count() == 0


def test_columns_named_like_the_stages_own(spark, docs):
    names = ["__dedup_id", "__dedup_digest", "__Dedup_starts", "__count_lines", "__count_removed", "__kept_id", "__kept_own", "__kept_digest", "digest", "salt", "component", "own"]
    clash = docs
    for name in names:
        clash = clash.withColumn(name, F.lit(name))
    for stage in (corpus_pipeline.line_dedup_stage, corpus_pipeline.simhash_stage):
        got, want = stage(spark, clash, ""), stage(spark, docs, "")
        assert got.columns == clash.columns
        rows = got.collect()
        assert all(r[name] == name for r in rows for name in names)
        assert sorted((str(r.doc_id), r.text or "") for r in rows) == sorted((str(r.doc_id), r.text or "") for r in want.collect())
