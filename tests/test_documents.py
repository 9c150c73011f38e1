"""Listings, roll-ups, versions, recognition, changes, exports and streams on small tables."""

import csv
import datetime as dt
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirespark.operators import contents, listing, mutate, ocr, rollup, versions
from quirespark.plans.catalog import QUERIES
from quirespark.sources import files, schema, sinks
from quirespark.streaming import tasks

T0 = dt.datetime(2024, 1, 1)


def docs(spark, *rows):
    """Rows as dictionaries over defaults."""
    base = {"sygnatura": None, "doc_type": None, "original_filename": "a.pdf", "stored_filename": "a", "step": "k1", "ocr_status": "none", "upload_time": T0, "content_type": "document", "is_main": False}
    names = [f.name for f in schema.DOCUMENT]
    typed = schema.DOCUMENT.jsonValue()["fields"]
    assert len(typed) == len(names)
    full = [tuple({**base, **r}.get(n) for n in names) + (r.get("text"),) for r in rows]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.DOCUMENT) + ", text string"
    return spark.createDataFrame(full, kind)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_step_filters(spark):
    d = docs(spark, *({"id": i, "step": f"k{i}", "is_main": i != 4} for i in range(1, 5)))
    assert ids(listing.by_steps(d, [])) == [1, 2, 3, 4] and ids(listing.by_steps(d, ["k2"])) == [2]
    assert ids(listing.cases(d)) == [1, 2, 3] and ids(listing.cases(d, ["k1"])) == [1]
    assert ids(listing.cases(d, [])) == ids(listing.cases(d, search="x")) == []


def test_search(spark):
    d = docs(spark, {"id": 1, "sygnatura": "Jan", "doc_type": "Opinia", "text": "wyrok sądu"}, {"id": 2, "sygnatura": "", "text": None}, {"id": 3, "text": "wirok"})
    assert ids(listing.search(d, "PDF jan opinia")) == [1] and ids(listing.search(d, "  ")) == [1, 2, 3]
    found = {r.id: r.matches for r in listing.search(d, "wyrok", content=True, fuzzy=True).collect()}
    assert found == {1: ["content"], 3: ["fuzzy_content"]}
    assert {r.id: r.matches for r in listing.search(d, "!!!", content=True, fuzzy=True).collect()} == {1: ["fuzzy_metadata", "fuzzy_content"], 2: ["fuzzy_metadata"], 3: ["fuzzy_metadata", "fuzzy_content"]}
    assert listing.by_id(d, 2).first().id == 2
    with pytest.raises(LookupError, match="no document 9"):
        listing.by_id(d, 9)


def test_numbering_is_the_order(spark):
    d = docs(spark, *({"id": i, "upload_time": T0 + dt.timedelta(minutes=i * 7919 % 31)} for i in range(200)))
    want = [r.id for r in listing.newest_first(d).collect()]
    assert [r.id for r in sorted(listing.numbered(d).collect(), key=lambda r: r.position)] == want


def test_progress_of_cases(spark):
    children = {1: [], 2: ["fail", "fail"], 3: ["none"], 4: ["done", "pending"], 5: ["done", "none"]}
    rows = [{"id": c, "is_main": True} for c in children]
    rows += [{"id": 10 * c + k, "parent_id": c, "ocr_status": s, "doc_type": "Akta", "ocr_progress": 0.5 if s == "pending" else None} for c, ss in children.items() for k, s in enumerate(ss)]
    rows += [{"id": 99, "parent_id": 1, "ocr_status": "pending", "doc_type": None}, {"id": 98, "parent_id": 1, "ocr_status": "pending", "doc_type": "OCR TXT"}]
    d = docs(spark, *rows)
    got = {r.case_id: (r.total, r.failed, r.progress, r.ocr_done) for r in rollup.ocr_progress(d).collect()}
    assert got == {1: (0, None, 1.0, True), 2: (2, 2, 0.0, False), 3: (1, 0, 0.0, False), 4: (2, 0, 0.75, False), 5: (2, 0, 0.5, True)}
    assert {r.case_id: r.images for r in rollup.footer_counts(d).collect()} == dict.fromkeys(children, 0)


def test_newest_breaks_ties_by_id(spark):
    d = docs(spark, {"id": 1}, {"id": 2, "doc_type": "OCR TXT", "ocr_parent_id": 1, "text": "old"}, {"id": 3, "doc_type": "OCR TXT", "ocr_parent_id": 1, "text": "new"}, {"id": 4})
    assert [(r.ocr_parent_id, r.id) for r in versions.latest_ocr(d).collect()] == [(1, 3)]
    assert {r.id: r.ocr_text for r in versions.with_latest_ocr(d).collect()} == {1: "new", 2: None, 3: None, 4: None}
    assert ids(versions.has_ocr(d)) == [1] and ids(versions.without_ocr(d)) == [2, 3, 4]


def test_available_file(spark):
    rows = [{"id": 1, "is_main": True, "stored_filename": "x.pdf"}, {"id": 2, "parent_id": 1, "stored_filename": "history/y.pdf", "last_modified": T0}, {"id": 3, "parent_id": 1, "stored_filename": "z.pdf", "last_modified": T0 + dt.timedelta(1)}]
    there = spark.createDataFrame([("file:/f/x.pdf",), ("file:/f/history/y.pdf",)], "path string")
    assert [(r.family_id, r.id) for r in versions.available(docs(spark, *rows), there).collect()] == [(1, 2)]


def test_recognition(spark):
    def render(content):
        yield from content.split(b"|")

    def load():
        def read(image):
            if image == b"bad":
                raise ValueError("nieczytelne")
            return image.decode()

        return read

    pdfs = spark.createDataFrame([(1, bytearray("Pierwsza strona tekstu|bad|trzecia".encode())), (2, bytearray(b"jedna"))], "doc_id long, content binary")
    pages = ocr.scored(ocr.recognize(ocr.pdf_pages(pdfs, render), load))
    got = {r.doc_id: r for r in ocr.assemble(pages.repartition(3)).collect()}
    assert got[1].text == "=== Strona 1 ===\n\nPierwsza strona tekstu\n\n=== Strona 2 ===\n\n[Błąd OCR dla strony 2: nieczytelne]\n\n=== Strona 3 ===\n\ntrzecia"
    assert got[1].pages == 3 and got[1].confidence == pytest.approx(0.7 / 3)
    assert [r.batch for r in ocr.batches_of(spark.createDataFrame([(p,) for p in (1, 5, 6)], "page int")).collect()] == [0, 0, 1]
    asked = spark.createDataFrame([(1, 7, 1, bytearray(b"fragment"), False), (2, 7, 1, bytearray(b"page"), True), (3, 8, 1, bytearray(b"page"), True)], "request_id long, doc_id long, page int, image binary, whole boolean")
    stored = docs(spark, {"id": 9, "ocr_parent_id": 7, "doc_type": "OCR TXT", "text": "cały dokument"})
    assert {r.request_id: r.text for r in ocr.region(asked, stored, load).collect()} == {1: "fragment", 2: "cały dokument", 3: "page"}


def test_contents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("zażółć\r\nb".encode())
    (tmp_path / "b.txt").write_bytes("ó".encode("latin-1"))
    assert {r.name: r.text for r in files.text_files(spark, str(tmp_path)).collect()} == {"a.txt": "zażółć\nb", "b.txt": "ó"}
    assert files.within_limits(files.blobs(spark, str(tmp_path))).first().ok
    d = docs(spark, {"id": 1, "mime_type": "application/pdf", "text": "pdf"}, {"id": 2, "doc_type": "OCR TXT", "ocr_parent_id": 1, "text": "ocr "}, {"id": 3, "mime_type": "application/pdf", "text": None}, {"id": 4, "mime_type": "image/png", "text": "raw"})
    assert {r.id: r.content for r in contents.with_ocr(d).collect()} == {1: "pdf\n\n=== OCR RESULTS ===\nocr", 2: "ocr ", 3: "", 4: ""}

    def refuse(content):
        raise ValueError

    got = contents.extracted(spark.createDataFrame([(1, bytearray(b" x "))], "id long, content binary"), [refuse, lambda c: "", lambda c: c.decode()])
    assert got.first().text == "x"

    def client():
        return lambda p: p[-3:] if "boom" not in p else 1 / 0

    out = {r.id: r for r in contents.summaries(spark.createDataFrame([(1, "abc"), (2, "boom")], "id long, content string"), client, "Streść").collect()}
    assert out[1].summary == "abc" and out[2].error == "division by zero"


def test_changes(spark):
    d = docs(
        spark,
        {"id": 1, "is_main": True, "sygnatura": "S", "step": "k2", "stored_filename": "1.docx", "note": "n"},
        {"id": 2, "parent_id": 1, "ocr_status": "none"},
        {"id": 3, "ocr_parent_id": 2, "doc_type": "OCR TXT", "text": "t"},
        {"id": 4, "is_main": True, "stored_filename": "4.empty"},
    )
    one = spark.createDataFrame([(1,)], "id long")
    assert ids(mutate.delete(d, one)) == [3, 4] and ids(mutate.orphans(mutate.delete(d, one))) == [3]
    assert mutate.deleted_counts(d, one).first().rows == 2
    edits = spark.createDataFrame([(50, 2, "neu"), (51, 1, "made")], "id long, source_id long, text string")
    out = {r.id: r for r in mutate.save_manual_text(d, edits, "2024-02-02 00:00:00").collect()}
    assert out[3].text == "neu" and set(out) == {1, 2, 3, 4, 51} and out[51].ocr_parent_id == 1 and out[51].sygnatura == "S"
    assert out[1].ocr_status == "done" and out[1].ocr_confidence == 0.8 and out[2].ocr_status == "none"
    updates = spark.createDataFrame([(1, "n.docx", "n", 60, "uwaga"), (4, "m.docx", "m", 61, "")], "id long, original_filename string, stored_filename string, history_id long, comments string")
    out = {r.id: r for r in mutate.replace_file(d, updates, "2024-02-02 10:00:00", "s").collect()}
    assert set(out) == {1, 2, 3, 4, 60} and out[60].parent_id == 1 and out[60].stored_filename == "history/1_backup_s.docx" and out[60].upload_time == T0
    assert out[1].note == "n\n[2024-02-02 10:00] Aktualizacja: uwaga" and out[4].content_type == "opinion" and out[4].note is None
    assert mutate.with_container(d, docs(spark, {"id": 70, "is_main": True, "doc_type": mutate.CONTAINER})).count() == 5
    again = mutate.with_container(docs(spark, {"id": 5, "is_main": True, "doc_type": mutate.CONTAINER}), docs(spark, {"id": 70, "is_main": True, "doc_type": mutate.CONTAINER}))
    assert ids(again) == [5]
    uploads = spark.createDataFrame([(80, "a.docx", "s", T0), (81, "a.png", "s", T0)], "id long, original_filename string, stored_filename string, upload_time timestamp_ntz")
    assert ids(mutate.quick_uploads(uploads, 5)) == [81]
    assert ids(mutate.new_cases(uploads.where("id = 80"))) == [80]
    with pytest.raises(Exception, match="not a Word file"):
        mutate.new_cases(uploads).collect()
    noted = mutate.save_summaries(d, spark.createDataFrame([(1, "S"), (2, None)], "id long, summary string"), "t")
    assert {r.id: r.note for r in noted.collect()}[1] == "n\n\n---\n\n[PODSUMOWANIE AI - t]\nS"
    assert schema.missing_columns(d.drop("note")) == ["note"] and schema.conform(d.drop("note", "text")).columns == schema.DOCUMENT.fieldNames()


def read_lines(path):
    return b"".join(p.read_bytes() for p in sorted(Path(path).glob("part-*")))


def test_exports(spark, tmp_path):
    d = docs(spark, {"id": 1, "sygnatura": 'a,"b"', "original_filename": "x\ny", "upload_time": T0}, {"id": 2, "upload_time": T0 + dt.timedelta(1)})
    sinks.write_csv(listing.export(listing.newest_first(d)), f"{tmp_path}/csv")
    raw = read_lines(f"{tmp_path}/csv")
    assert raw.startswith(b"\xef\xbb\xbfID,Typ,")
    rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    assert [r[0] for r in rows] == ["ID", "2", "1"] and rows[2][2] == 'a,"b"' and rows[2][4] == "x\ny" and rows[1][7] == "2024-01-02 00:00"
    one = d.where("id = 1").select("sygnatura", "original_filename")
    sinks.write_quoted(one, f"{tmp_path}/q")
    assert read_lines(f"{tmp_path}/q").decode() == '"sygnatura","original_filename"\n"a,""b""","x y"\n'
    sinks.write_plain(one, f"{tmp_path}/p")
    assert read_lines(f"{tmp_path}/p").decode() == 'sygnatura,original_filename\na;"b",x y\n'
    sinks.write_texts(spark.createDataFrame([(1, "t")], "id long, text string"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").first().text == "t"
    assert sinks.as_json(d.where("id = 1"), "id", "step").first().value == '{"id":1,"step":"k1"}'


def test_exports_keep_their_partitions(spark, tmp_path):
    df = spark.range(0, 40, 1, 4).selectExpr("id", "id % 3 as n")
    for name, write in (("csv", sinks.write_csv), ("q", sinks.write_quoted), ("p", sinks.write_plain)):
        write(df, f"{tmp_path}/{name}")
        files = sorted(Path(f"{tmp_path}/{name}").glob("part-*"))
        assert len(files) == 4 and all(len(f.read_text().splitlines()) == 11 for f in files)
        write(df, f"{tmp_path}/{name}1", files=1)
        assert len(list(Path(f"{tmp_path}/{name}1").glob("part-*"))) == 1


def drain(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    times = [r.t for r in events.selectExpr("unix_seconds(cast(ts as timestamp)) as t").collect()]
    middle = sorted(times)[len(times) // 2]
    for k, part in enumerate((f"< {middle}", f">= {middle}")):  # a document's events in order from file to file
        events.where(f"unix_seconds(cast(ts as timestamp)) {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        for p in Path(f"{tmp_path}/e").glob("part-*"):
            if not p.name.startswith("part-done"):
                p.rename(p.with_name(f"part-done{k}{p.suffix}"))
    own = tasks.status_events(events)
    stream = tasks.stream(spark, f"{tmp_path}/e")
    got = {(r.id, r.event_id) for r in drain(spark, tasks.admitted_stream(stream), "append", "admitted").collect()}
    assert got == {(r.id, r.event_id) for r in tasks.admitted(own).collect()}
    latest = {r.id: (r.status, r.events) for r in drain(spark, tasks.latest_status(stream), "complete", "latest").collect()}
    assert latest == {r.id: (r.status, r.events) for r in tasks.latest_status(own).collect()}
    assert drain(spark, tasks.once_within(stream), "append", "once").count() > 0
    closed = {(r.start, r.status): r.events for r in drain(spark, tasks.activity(stream), "append", "activity").collect()}
    every = {(r.start, r.status): r.events for r in tasks.activity(own).collect()}
    assert closed and all(every[k] == n for k, n in closed.items())


def test_status_is_applied(spark):
    d = docs(spark, {"id": 1, "ocr_status": "none"}, {"id": 2, "ocr_status": "done", "ocr_progress": 1.0})
    events = tasks.rerun(spark.createDataFrame([(2,)], "id long"), "2024-01-01 00:00:00", 100)
    out = {r.id: (r.ocr_status, r.ocr_progress) for r in tasks.apply_status(d, tasks.latest_status(events)).collect()}
    assert out == {1: ("none", None), 2: ("pending", 0.0)}


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["doc_type_facets"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan
    plan = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("source").isin("src1", "src2")).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(source" in plan


def test_empty_exports_have_a_heading(spark, tmp_path):
    none = listing.export(docs(spark)).select("ID", "Typ")
    for write, mark in ((sinks.write_csv, "\ufeff"), (sinks.write_quoted, ""), (sinks.write_plain, "")):
        write(none, f"{tmp_path}/{write.__name__}")
        text = "".join(p.read_bytes().decode() for p in sorted(Path(f"{tmp_path}/{write.__name__}").glob("part-*")))
        assert text.strip("\r\n") == mark + ('"ID","Typ"' if write is sinks.write_quoted else "ID,Typ")


def test_started_queue_goes_on_where_it_ended(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(2):  # half of the files arrive later
        events.where(f"event_id % 2 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        tasks.run_queue(tasks.stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        got = [(r.id, r.event_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
        assert len(set(got)) == len(got)
        if k == 0:
            first = set(got)
            want = tasks.admitted(tasks.status_events(events.where("event_id % 2 = 0"))).collect()
            assert first == {(r.id, r.event_id) for r in want}
    assert first < set(got)


def test_restart_and_omitted_fields(spark):
    rows = [(1, 1, "pending", None, None, None, None), (1, 2, "running", 0.3, "strona 1", 1, 4), (1, 3, "running", None, "czeka", 2, 4), (1, 4, "fail", None, None, None, None), (2, 1, "running", 0.5, "x", 3, 4), (2, 2, "pending", 0.9, None, None, None), (3, 1, "running", 0.4, "y", 3, None)]
    events = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=n), n, s, p, info, a, b, None) for i, n, s, p, info, a, b in rows], "id long, ts timestamp, event_id long, status string, progress double, info string, current_page int, total_pages int, confidence double")
    got = {r.id: (r.status, r.progress, r.info, r.current_page, r.total_pages, r.confidence) for r in tasks.latest_status(events).collect()}
    assert got == {1: ("fail", 0.3, "czeka", 1, 4, None), 2: ("pending", 0.0, tasks.WAITING, 3, 4, None), 3: ("running", 0.4, "y", None, None, None)}


def test_changes_with_repeated_ids(spark):
    d = docs(spark, {"id": 1, "is_main": True, "stored_filename": "1.docx"}, {"id": 2})
    twice = spark.createDataFrame([(1, "first", 1), (1, "last", 2), (2, "x", 1), (None, "lost", 3)], "id long, note string, n int")
    assert {r.id: r.note for r in mutate.update_note(d, twice, order="n").collect()} == {1: "last", 2: "x"}
    with pytest.raises(Exception, match="several changes of id 1"):
        mutate.update_note(d, twice).collect()
    steps = spark.createDataFrame([(1, "k2", "", "S", 1), (1, "k3", "T", None, 2)], "id long, step string, doc_type string, sygnatura string, n int")
    assert {r.id: (r.step, r.doc_type, r.sygnatura) for r in mutate.update_metadata(d, steps, order="n").collect()} == {1: ("k3", "T", None), 2: ("k1", None, None)}
    texts = spark.createDataFrame([(50, 2, "old", 1), (51, 2, "new", 2)], "id long, source_id long, text string, n int")
    assert [(r.id, r.text) for r in mutate.save_manual_text(d, texts, "2024-02-02 00:00:00", order="n").where("ocr_parent_id = 2").collect()] == [(51, "new")]
    new = spark.createDataFrame([(1, "a.docx", "a", 70, "", 1), (1, "b.docx", "b", 71, "", 2)], "id long, original_filename string, stored_filename string, history_id long, comments string, n int")
    assert {r.id: r.original_filename for r in mutate.replace_file(d, new, "2024-02-02 00:00:00", "s", order="n").collect()} == {1: "b.docx", 2: "a.pdf", 71: "a.pdf (wersja z s)"}
    said = spark.createDataFrame([(2, "eins", 1), (2, "zwei", 2)], "id long, summary string, n int")
    assert [r.note for r in mutate.save_summaries(d, said, "t", order="n").where("id = 2").collect()] == ["[PODSUMOWANIE AI - t]\nzwei"]


def test_uploads_up_to_a_refused_one(spark):
    names = ["a.docx", "B.DOC", "c.pdf", "d.docx", "e.exe"]
    up = spark.createDataFrame([(i, n, f"{i}.bin", T0, "application/msword" if i == 1 else None) for i, n in enumerate(names)], "id long, original_filename string, stored_filename string, upload_time timestamp_ntz, mime_type string")
    assert [r.error for r in mutate.taken(up).orderBy("id").collect()] == [None, None, mutate.NOT_WORD, mutate.NOT_WORD, mutate.NOT_WORD]
    assert {r.id: r.mime_type for r in mutate.new_cases(up, partial=True).collect()} == {0: schema.WORD_MIME, 1: "application/msword"}
    assert [r.error for r in mutate.taken(up.where("id > 3")).collect()] == [mutate.NOT_ALLOWED] and mutate.new_cases(up.where("id > 9"), partial=True).collect() == []
    with pytest.raises(Exception, match="not a Word file: [ce]"):
        mutate.new_cases(up).collect()


def test_exports_trim_white_space_of_all_kinds(spark):
    df = spark.createDataFrame([("\n  a, b\r\nc ﻿",)], "v string")
    assert sinks.body(df, sinks.always).first().value == '"a, b c"' and sinks.body(df, sinks.never).first().value == "a; b c"


def test_bytes_are_decoded_without_python(spark):
    """Surrogates, numbers beyond Unicode and overlong or broken sequences are no UTF-8; a mark at the beginning stays."""
    rows = [b"", None, b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xf4\x8f\xbf\xbf", b"\xc0\x80", b"\xe0\x80\x80", b"\xef\xbb\xbfabc", b"\xc5", b"a\r\n\r\rb\n\r", b"\x80\x9f\xff\r", b"\x00a", b"z\xc5\x82\r\n"]

    def plain(b):
        try:
            text = b.decode()
        except UnicodeDecodeError:
            text = b.decode("latin-1")
        return text.replace("\r\n", "\n").replace("\r", "\n")

    texts = spark.createDataFrame(list(enumerate(rows)), "id int, content binary").select("id", contents.decoded("content").alias("text"))
    assert {r.id: r.text for r in texts.collect()} == {i: None if b is None else plain(b) for i, b in enumerate(rows)}
    assert "Python" not in texts._jdf.queryExecution().executedPlan().toString()
