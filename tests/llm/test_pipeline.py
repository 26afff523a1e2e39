"""The corpus pipeline on the smallest tables: every stage's decisions."""

import re
from collections import Counter

import corpus_pipeline
from hourcast.llm import decontam, fertility, jaccard, queries, secret_scan, wordcache

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "decontamination", "secret_scans", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = {r.doc_id: r.text for r in docs.collect()}
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stage(spark, frames[-1], SF))
        assert frames[-1].columns == docs.columns
    good, alone, clean, safe = [{r.doc_id: r for r in f.collect()} for f in frames[1:]]
    rated = fertility.rate(docs, wordcache.tokenizer_path(queries.PIECE_BPE)).where("kept").collect()
    assert set(good) == {r.doc_id for r in rated}
    comp = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frames[1], 5, 80, 100).collect()}
    assert set(alone) == {d for d, c in comp.items() if d == c}
    bad = {r.doc_id for r in decontam.leaks(frames[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert bad and set(clean) == set(alone) - bad == set(safe)
    for d, r in safe.items():
        assert r.text == secret_scan.redact(start[d], secret_scan.scan(start[d])) and r.n_chars == len(r.text)
        assert not secret_scan.base_spans(re.sub(r"\[SECRET\]", "", r.text)) or r.text == start[d]
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(safe)
    assert max(Counter((r.doc_id, r.piece) for r in packed).values()) == 1


def test_stages_on_edge_rows(spark, tmp_path):
    """Null, empty, repeated and very long rows pass every stage; ids that
    carry two texts lose neither."""
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(6).collect()]
    rows = [(1, good[0], "en"), (1, good[0], "en"), (1, good[1], "en"), (None, good[2], None), (3, None, "en"), (4, "", "en"), (5, good[3] * 60, "xx")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame.write.mode("overwrite").parquet(str(tmp_path / "in"))
            frame = spark.createDataFrame(spark.read.parquet(str(tmp_path / "in")).collect(), docs.schema)
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
        assert len(packed) == 0 or max(r.length for r in packed) <= 2048
    alone = corpus_pipeline.ngram_jaccard(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in alone if r.text) == sorted([(1, good[0]), (1, good[1]), (0, good[2]), (5, good[3] * 60)])


def test_entry_lists_all():
    import __spark_entry__ as e
    names = e.queries()
    assert {f"op{i}_" for i in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")} and "pipeline" in names
