"""Readers on small files as they are found on disk: indented JSON, plain text, token files."""

import json

import pytest
from pyspark.sql import functions as F

from veilspan import lexicon as L
from veilspan import streaming
from veilspan.operators import endtoend, masking
from veilspan import session
from veilspan.session import choose_folder
from veilspan.sources import documents, tokens, transcripts, vault


def put(path, name, value):
    path.mkdir(exist_ok=True)
    (path / name).write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    return str(path)


def test_text_files(spark, tmp_path):
    put(tmp_path / "t", "a.txt", "첫 줄\n둘째 줄\n")
    rows = documents.read_text_files(spark, put(tmp_path / "t", "b.txt", "")).collect()
    # Spark's text source has no row for an empty file
    assert [(r.path[-5:], r.text) for r in rows] == [("a.txt", "첫 줄\n둘째 줄\n")]


def test_transcript_meta(spark, tmp_path):
    full = {"timestamp": "2025-08-14T08:10:51", "original_audio": "in.wav", "audio_improvement": {"noise_reduction": 21.5, "clarity": -20.25, "overall": 3.0},
            "stt_stats": {"total_chunks": 3, "success_chunks": 2, "failed_chunks": 1, "retry_count": 1, "total_duration": 12.5, "success_rate": 0.667, "processing_time": 4.0},
            "processing_time": 5.5, "sentences": [{"text": "안녕하세요.", "start_time": 0.0, "end_time": 2.5}, {"text": "네.", "start_time": 2.5, "end_time": 3.0}]}
    old = {"timestamp": "2025-08-13T00:00:00", "original_audio": "old.wav", "processing_time": 1}
    put(tmp_path / "m", "one.json", full)
    back = transcripts.read_transcripts(spark, put(tmp_path / "m", "two.json", old))
    rows = {r.original_audio: r for r in back.collect()}
    assert rows["in.wav"].stt_stats.success_chunks == 2 and rows["in.wav"].audio_improvement.clarity == -20.25
    assert rows["old.wav"].sentences is None and rows["old.wav"].processing_time == 1.0 and rows["old.wav"].path.endswith("two.json")
    sentences = transcripts.transcript_sentences(back, "original_audio").orderBy("pos").collect()
    assert [(s.pos, s.text, s.end_time) for s in sentences] == [(0, "안녕하세요.", 2.5), (1, "네.", 3.0)]


def test_run_results(spark, tmp_path):
    side = lambda rms: {"rms": rms, "rms_db": "-20.5", "dynamic_range": "n/a", "spectral_centroid": 1.5, "zcr": 0.1}
    run = {"session_id": "s1", "timestamp": "t", "audio_enhancement": {"before": side("0.25"), "after": side("broken"), "improvement": {"overall": 3.5}},
           "speech_to_text": {"success": True, "chunks": [{"chunk_index": 0, "text": "가", "success": True, "duration": 1.5}, {"chunk_index": 1, "text": "", "success": False, "error": "E", "duration": 0.5}]},
           "pii_detection": {"total_entities": 1, "entities": [{"start": 0, "end": 2, "text": "김민", "label": "이름", "score": 0.9}]},
           "masking": {"masked_text": "[이름]", "total_masked": 1}, "processing_time": {"masking": 0.5}, "errors": []}
    back = transcripts.read_runs(spark, put(tmp_path / "r", "run.json", run))
    r = back.first()
    assert (r.before_rms, r.after_rms, r.before_rms_db, r.after_dynamic_range) == (0.25, None, -20.5, None)
    assert r.pii_detection.entities[0].label == "이름" and r.processing_time == {"masking": 0.5}
    chunks = transcripts.run_chunks(back, "session_id").orderBy("chunk_index").collect()
    assert [(c.session_id, c.chunk_index, c.success, c.error) for c in chunks] == [("s1", 0, True, None), ("s1", 1, False, "E")]


def test_indented_vault_restores(spark, tmp_path):
    text, hits = "김민수 010-1234-5678", [("김민수", 0, 3, "[이름]", "이름"), ("010-1234-5678", 4, 17, "[번호]", "번호")]
    entry = {"session_id": "s", "timestamp": "t", "original_text": text, "masked_text": "[이름] [번호]", "masking_rules": {"mode": "simple", "simple_rule": "[x]"},
             "records": [{"entity_id": f"s_{i:04}", "original_text": o, "masked_text": m, "label": lab, "start": a, "end": b, "metadata": {"source": "regex", "confidence": 0.9}}
                         for i, (o, a, b, m, lab) in enumerate(hits)], "stats": {"total_masked": 2, "text_length": 17, "masked_length": 9}}
    back = vault.read_vault(spark, put(tmp_path / "v", "one.json", entry))
    assert back.first().stats.total_masked == 2
    assert [(r.ord, r.label, r.metadata.confidence) for r in vault.vault_records(back, "session_id").orderBy("ord").collect()] == [(0, "이름", 0.9), (1, "번호", 0.9)]
    restored = masking.restore(back.select("session_id"), back, "session_id").first()
    assert restored.original == text and restored.rules_used.simple_rule == "[x]"


def test_presets(spark, tmp_path):
    path = str(tmp_path / "p")
    vault.write_preset(spark, "standard", L.DEFAULT_RULES, path)
    vault.write_preset(spark, "plain", {"mode": "simple", "simple_rule": "[가림]"}, path)
    got = {r.name: r.rules for r in vault.read_presets(spark, path).collect()}
    assert set(got) == {"standard", "plain"} and got["plain"].simple_rule == "[가림]" and got["standard"].label_rules == L.DEFAULT_RULES["label_rules"]


def test_token_files_and_schemas(spark, tmp_path):
    rows = tokens.read_bio(spark, put(tmp_path / "b", "x.bio", "김민수\tB-이름\n님\tI-이름\n\n\n서울\tB-주소\n에\n")).orderBy("sent").collect()
    assert [(r.tokens, r.tags) for r in rows] == [(["김민수", "님"], ["B-이름", "I-이름"]), (["서울", "에"], ["B-주소", "O"])]
    labels = [f"{p}-{x}" for x in L.LABELS for p in "BI"]
    got = {r.path.rsplit("/", 1)[1]: r.labels for r in tokens.read_schema(spark, [put(tmp_path / "s", n, c) for n, c in [
        ("a.json", {"labels": ["O", *labels]}), ("b.json", {"B-X": 1, "O": 0}), ("c.json", ["B-Y"]), ("d.txt", "B-Z\n\n I-Z \n")]][0]).collect()}
    assert len(got["a.json"]) == 25 and got["b.json"] == ["O", "B-X"] and got["c.json"] == ["O", "B-Y"] and got["d.txt"] == ["O", "B-Z", "I-Z"]


def test_document_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "메일 hong@a1.com"), (2, "없음")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = streaming.masked_stream(streaming.document_stream(spark, str(tmp_path / "in"), "doc_id long, text string"))
    query = stream.select("doc_id", "masked_text").writeStream.format("memory").queryName("masked_documents").start()
    query.processAllAvailable()
    query.stop()
    want = {r.doc_id: r.masked_text for r in streaming.masked_stream(docs).collect()}
    assert {r.doc_id: r.masked_text for r in spark.table("masked_documents").collect()} == want and "hong" not in want[1]


def test_end_to_end_keeps_failed_documents(spark):
    rows = [(1, "연락  hong@a1.com 끝.", None), (2, None, None), (3, "  ", None), (4, "연락 hong@a1.com", "timeout"), (5, "없음", "")]
    out = {r.id: r for r in endtoend.process(spark.createDataFrame(rows, "id long, text string, e string"), error="e").collect()}
    assert [out[i].success for i in (1, 2, 3, 4, 5)] == [True, False, False, False, True]
    assert [out[i].errors for i in (1, 2, 3, 4, 5)] == [[], ["no text"], ["no text"], ["timeout"], []]
    assert "hong" not in out[1].masked_text and out[4].masked_text is None and out[4].spans == [] and out[5].masked_text == "없음"


def test_shared_folder_is_required_on_a_cluster():
    assert choose_folder("spark://host:7077", "hdfs://x/y") == "hdfs://x/y"
    assert choose_folder("local[8]", None) and choose_folder("local", None)
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            choose_folder(master, None)


def test_stage_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "")], "doc_id long, text string, masked_text string")
    documents.write_stages(df, str(tmp_path / "s"), original="text", masked="masked_text")
    assert documents.read_stage(spark, str(tmp_path / "s"), "masked").select("doc_id", "text").collect() == [(1, "b")]
    assert documents.read_stage(spark, str(tmp_path / "s")).where(F.col("stage") == "original").count() == 2


def test_written_tables_are_cleaned_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark, "_veilspan_folder", str(tmp_path), raising=False)
    monkeypatch.setattr(spark, "_veilspan_tables", [], raising=False)
    assert session.written(spark.range(3)).count() == 3
    assert len(list(tmp_path.iterdir())) == 1 and session.clean_up(spark) == 1 and list(tmp_path.iterdir()) == []
