"""Packages, sinks, the catalogue and stateful streams on small inputs."""

import datetime
import zipfile

from pyspark.sql import functions as F

from quillspark.sources import catalogue, packages, sinks
from quillspark.streaming import streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = f"""<?xml version="1.0"?><w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading2"/><w:jc w:val="left"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>A heading</w:t></w:r></w:p>
<w:p><w:r><w:t>Known</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>45,</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>48</w:t></w:r><w:ins><w:r><w:t> new</w:t></w:r></w:ins><w:del><w:r><w:delText> old</w:delText></w:r></w:del></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:left="1440" w:right="1440" w:top="864" w:bottom="720"/></w:sectPr></w:body></w:document>"""


def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", BODY)
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("ppt/slide.xml", "<a/>")
    (tmp_path / "c.docx").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.docx").write_bytes(b"PK\x03\x04broken")
    return str(tmp_path)


def test_triage(spark, tmp_path):
    got = {r.path[-6]: r.reason for r in packages.triage_files(packages.files(spark, folder(tmp_path))).collect()}
    assert got == {"a": None, "b": "PowerPoint", "c": "PDF", "d": "damaged"}


def test_ingest(spark, tmp_path):
    t = packages.ingest_packages(spark, folder(tmp_path))
    assert [(r.idx, r.outline_level, r.alignment) for r in t["para_format"].orderBy("idx").collect()] == [(0, 1, "left"), (1, None, None)]
    assert [r.text for r in t["paragraphs"].orderBy("idx").collect()][1].startswith("Known[45, 48]")
    assert [r.text for r in t["cells"].collect()] == ["cell"]
    assert t["sections"].first().left_in == 1.0
    assert t["runs"].orderBy("idx", "run_no").first().bold is True


def test_tracked_changes(spark, tmp_path):
    r = packages.revisions_from_tracked(packages.files(spark, folder(tmp_path))).filter("idx = 1").first()
    assert (r.original, r.edited) == ("Known45,48 old", "Known45,48 new")


def test_a_day_written_twice(spark, tmp_path):
    path = str(tmp_path / "daily")
    row = lambda d, n: spark.createDataFrame([(d, n)], "date string, jobs int")
    for d, n in (("2026-09-16", 1), ("2026-09-17", 5), ("2026-09-16", 2)):
        sinks.write_daily(row(d, n), path)
    got = {str(r.date): r.jobs for r in spark.read.parquet(path).collect()}
    assert got == {"2026-09-16": 2, "2026-09-17": 5}


def test_retention(spark):
    df = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 1, 20))], "id int, ts timestamp")
    at = datetime.datetime(2024, 1, 30)
    assert [r.id for r in sinks.retain(df, "ts", 14, at).collect()] == [2]
    assert sinks.retain(df, "ts", 0, at).count() == 2


def test_catalogue_refresh(spark):
    listing = spark.createDataFrame([("a", "Journal  A", "Law"), ("b", "Journal B", ""), ("c", "Journal C", "")], "code string, title string, domain string")
    details = spark.createDataFrame([("a", "Journal A", ["x"], "scope", "P")], "code string, title string, subject_areas array<string>, scope string, publisher_name string")
    previous = spark.createDataFrame([("journal a", "old", ["y"], "P", 2.5), ("Journal B", "kept", ["z"], "Q", None)], "name string, scope string, subject_areas array<string>, publisher string, impact_factor double")
    rows, audit = catalogue.refresh_catalogue(listing, details, previous)
    assert {r.name: (r.scope, r.impact_factor) for r in rows.collect()} == {"Journal A": ("scope", 2.5), "Journal B": ("kept", None)}
    assert audit.first().asDict() == {"fetched": 1, "carried": 1, "lost": 1, "complete": False}


def replay(spark, rows, schema, make, mode, tmp_path, batches=1):
    path, name = str(tmp_path / "in"), f"t{abs(hash(str(tmp_path)))}"
    for part in rows if batches > 1 else [rows]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def at(minute, second=0):
    return datetime.datetime(2024, 1, 1, 10, minute, second)


def test_reviews_close_after_idle(spark, tmp_path):
    rows = [(1, 5, "accept", at(0)), (1, 5, "reject", at(0, 20)), (1, 6, "accept", at(2)), (2, 1, "accept", at(50))]
    got = replay(spark, [rows, [(9, 0, "accept", at(59))]], "job_id int, idx int, decision string, ts timestamp", lambda s: streams.reviews(s, late="1 minute"), "append", tmp_path, 2)
    first = [r for r in got if r.job_id == 1 and r.start == at(0)]
    assert [(a.idx, a.decision) for a in first[0].answers] == [(5, "reject")]


def test_stalled_jobs(spark, tmp_path):
    rows = [[(1, at(0)), (2, at(0))], [(2, at(14)), (3, at(20))], [(3, at(29))]]
    got = replay(spark, rows, "job_id int, ts timestamp", lambda s: streams.stalled(s, 15), "append", tmp_path, 3)
    assert 1 in {r.job_id for r in got} and 3 not in {r.job_id for r in got}


def test_feed_keeps_the_last(spark, tmp_path):
    rows = [(1, f"e{i:02d}", at(i)) for i in range(9)]
    got = replay(spark, rows, "job_id int, text string, ts timestamp", lambda s: streams.live_feed(s, 4), "update", tmp_path)
    assert got[-1].events == ["e05", "e06", "e07", "e08"]


def test_throttle(spark, tmp_path):
    rows = [(1, "a", 0.1, at(0, 0)), (1, "b", 0.2, at(0, 1)), (1, "c", 0.3, at(0, 4)), (1, "z", 1.0, at(30))]
    got = replay(spark, rows, "job_id int, stage string, progress double, ts timestamp", lambda s: streams.throttle(s), "append", tmp_path)
    assert F is not None and {r.stage for r in got} <= {"b", "c", "z"}
