"""What is written on the way: compressed, once, and no more than is needed."""

import gzip
import random

import pyarrow as pa
from pyspark.sql import functions as F

from veilspan import session
from veilspan.functions.arrays import make_span
from veilspan.operators import masking, transcripts
from veilspan.sources import tokens, vault


def test_a_json_vault_is_compressed_and_masked_once(spark, tmp_path):
    texts = [f"담당 김민수{i} 입니다" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "frei"])), "doc_id long, text string").repartition(2)
    name = make_span(start=F.lit(3), end=F.lit(6), text=F.lit("김민수"), label=F.lit("이름"), score=F.lit(0.5))
    found = docs.withColumn("spans", F.when(F.col("doc_id") < 300, F.array(name)).otherwise(F.array().cast(f"array<{docs.select(name.alias('s')).schema['s'].dataType.simpleString()}>")))
    rows = vault.vault_rows(masking.mask(found), F.concat(F.lit("s"), F.col("doc_id").cast("string")), F.lit("2025-01-01T00:00:00"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # records are sorted by their ends, once
    assert plan.count("sort_array(") == 1
    vault.write_vault(rows, str(tmp_path / "v"), "json")
    files = list((tmp_path / "v").glob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert sum(f.stat().st_size for f in files) < 300 * 60
    stored = spark.read.schema(vault.VAULT).json(str(tmp_path / "v"))
    got = {(r["session_id"], r["original_text"], r["masked_text"], r["stats"]["total_masked"], r["records"][0]["label"]) for r in stored.collect()}
    assert got == {(f"s{i}", t, f"담당 [이름]{i} 입니다", 1, "이름") for i, t in enumerate(texts)}


def test_sentences_are_put_together_where_their_lines_are_read(spark, tmp_path):
    """Splits of a few lines, sentences over several of them, blank lines in a row; what is shuffled is no text."""
    rng, want = random.Random(3), {}
    for name in ("a.bio", "b.bio", "c.bio.gz"):
        lines, gap = [], 0
        for n in range(400):
            line = rng.choice(["", "", f"토큰{n}\tB-X", f"v{n}", f"u{n}\tO\tmore", "\tB-Y", *[f"w{n}\tI-X"] * (6 if 100 < n < 300 else 1)])
            lines.append(line)
            cut = line.split("\t")
            if line:
                want.setdefault((name, gap), []).append((cut[0], cut[1] if len(cut) > 1 else "O"))
            gap += line == ""
        (gzip.open if name.endswith("gz") else open)(tmp_path / name, "wt", encoding="utf-8", newline="\n").write("\n".join(lines) + "\n")
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    for size in ("97b", "1000b", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = tokens.read_bio(spark, str(tmp_path)).select(name, "sent", "tokens", "tags").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(got) == len(want) and {(r["name"], r["sent"]): list(zip(r["tokens"], r["tags"])) for r in got} == want
    one = tokens.read_bio(spark, str(tmp_path / "c.bio.gz"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in one and "Aggregate" not in one


def test_batches_of_lines(monkeypatch):
    """Sentences over several batches, several splits in a batch, empty batches."""
    rng, rows = random.Random(4), []
    for split in (("a", 0), ("a", 9), ("b", 0), ("c", 0)):
        rows += [(*split, rng.random() < 0.2, f"t{i}", "O") for i in range(rng.randint(1, 60))]
    want, gaps = {}, {}
    for path, at, blank, token, _ in rows:
        gaps[path, at] = gaps.get((path, at), 0) + blank
        if not blank:
            want.setdefault((path, at, gaps[path, at]), []).append(token)
    names, at = ["path", "at", "blank", "token", "tag"], 0
    batches = []
    while at < len(rows):
        step = rng.choice([0, 1, 2, 5, 30])
        part = rows[at:at + step]
        at += step
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()))], names))
    got = [r for b in tokens._pieces(iter(batches)) for r in b.to_pylist()]
    assert len(got) == len(want) and {(r["path"], r["at"], r["gap"]): r["tokens"] for r in got} == want


def test_a_merged_transcript_gathers_its_texts_once(spark, monkeypatch):
    """Lines are neither numbered nor joined to their next ones: they are gathered as they are."""
    said = [(True, "one  two three . four"), (False, "lost"), (True, "  "), (True, "Upper here"), (True, "lower here"), (None, "x"), (False, None), (False, None),
            (True, ", comma"), (True, "end!"), (True, "after ?"), (False, "tail")]
    rows = [(key, n, ok, text) for key in (1, 2) for n, (ok, text) in enumerate(said)] + [(3, 0, False, "x"), (3, 1, True, "only"), (4, 0, False, "x"), (None, 0, True, "no one's")]
    tables, write = [], transcripts.written
    monkeypatch.setattr(transcripts, "written", lambda df: tables.append(df.columns) or write(df))
    held = len(session._tables(spark))
    df = transcripts.merged_transcript(spark.createDataFrame(rows, "rec_id long, chunk_index long, success boolean, text string").repartition(3))
    whole = "one two three. four [...] Upper here. lower here [...] [...]., comma. end! after?"
    assert sorted(map(tuple, df.collect())) == [(1, whole), (2, whole), (3, "only")]
    # the texts as given, as numbered, those that are asked for again with what is left of them, the gaps, and the pieces
    assert sum(bool({"text", "piece"} & set(t)) for t in tables) <= 5
    # of all tables the result reads the last two
    assert len(session._tables(spark)) == held + 2
