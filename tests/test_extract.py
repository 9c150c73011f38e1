import io
import json
import threading
import time
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest

from quirespark.operators import extract, ocr, tables

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {NS}><w:body>{body}</w:body></w:document>')
    return bytearray(out.getvalue())


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_word_files_by_a_chain_of_parsers(spark):
    body = p("Wyrok") + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r><w:r><w:t> d</w:t></w:r></w:p><w:tbl><w:tr><w:tc>" + p("cell") + "</w:tc></w:tr></w:tbl>" + p("") + p("końca &amp; nie ma")

    def hangs(content):
        if content == b"slow":
            time.sleep(60)
        raise ValueError

    def old(content):
        return content.decode("utf-8") if content != b"bad" else ""

    rows = [(1, docx(body)), (2, bytearray(b"slow")), (3, bytearray(b"old text ")), (4, bytearray(b"bad")), (5, None), (6, docx(""))]
    df = spark.createDataFrame(rows, "id long, content binary")
    start = time.time()
    got = {r.id: r for r in extract.word_texts(df, [("hangs", hangs), ("old", old)], limit=1.0).collect()}
    assert time.time() - start < 40
    assert (got[1].text, got[1].parser) == ("Wyrok\na\tb\nc d\n\nkońca & nie ma", "docx")
    assert (got[2].text, got[2].parser, got[2].tried) == ("slow", "old", ["docx: BadZipFile", "hangs: TimeoutError"])
    assert (got[3].text, got[3].tried) == ("old text", ["docx: BadZipFile", "hangs: ValueError"])
    assert (got[4].text, got[4].parser) == (extract.UNREADABLE, None) and got[5].text == extract.UNREADABLE and got[5].tried == []
    assert got[6].tried[0] == "docx: empty"


class Stub(BaseHTTPRequestHandler):
    def do_POST(self):
        prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"].rsplit("\n", 1)[-1]
        if prompt == "slow":
            time.sleep(3)
        code, body = (500, b"za duzo") if prompt == "500" else (200, {"empty": b'{"content": "  "}', "null": b'{"content": null, "text": "x"}', "keys": b'{"other": 1}', "junk": b"<html>"}.get(prompt, json.dumps({"response": f" re: {prompt} "}).encode()))
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_errors_of_a_language_model_are_told_apart(spark):
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    asked = ["hello", "500", "empty", "null", "keys", "junk", "slow"]
    df = spark.createDataFrame(list(enumerate(asked)), "id long, content string")
    got = {asked[r.id]: (r.summary, r.error) for r in extract.answers(df, url, "Streść", limit=1.0, at_once=1).collect()}
    server.shutdown()
    server.server_close()
    assert got["hello"] == ("re: hello", None) and got["500"] == (None, "status: LLM server zwrócił błąd HTTP 500: za duzo")
    assert got["empty"] == got["null"] == (None, "empty: LLM zwrócił pusty wynik")
    assert got["keys"] == (None, "no_text: LLM zwrócił odpowiedź bez tekstu. Dostępne klucze: ['other']")
    assert got["junk"][1].startswith("other: Nieoczekiwany") and got["slow"][1] == "timeout: Timeout - LLM nie odpowiedział w ciągu 1.0 sekund"
    gone = extract.answers(df.limit(1), url, "Streść", limit=1.0).first()
    assert gone.error == f"connection: Nie można połączyć się z LLM serverem ({url})"


def test_pages_by_table_functions(spark):
    def render(content):
        yield from content.split(b"|")

    files = spark.createDataFrame([(1, bytearray(b"a|b|c|d|e|f|boom")), (2, bytearray(b"x")), (3, None)], "doc_id long, content binary")
    pages = tables.pages_of(files, render)
    plain = ocr.pdf_pages(files.where("content is not null"), render)
    assert sorted(map(tuple, pages.collect())) == sorted(map(tuple, plain.collect()))

    def load():
        def read(images):
            if b"boom" in images:
                raise ValueError("nieczytelne")
            return [f"{len(images)}{i.decode()}" for i in images]

        return read

    got = {(r.doc_id, r.page): (r.text, r.failed) for r in tables.recognized_in_batches(pages, load, 5).collect()}
    assert [got[1, k][0] for k in range(1, 6)] == ["5a", "5b", "5c", "5d", "5e"] and got[2, 1] == ("1x", False)
    assert got[1, 6] == ("[Błąd OCR dla strony 6: nieczytelne]", True) and got[1, 7][1] and len(got) == 8


def test_changes_are_written_once_whatever_is_repeated(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "id long, version long, step string, deleted boolean"
    tables.keep(spark.createDataFrame([(i, 0, "k1", False) for i in range(50)], kind), path, 8)
    state = lambda: {r.id: (r.version, r.step) for r in tables.table(spark, path).collect()}
    files = lambda: {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    put = tables.upsert(path, 8)
    before, batch = files(), spark.createDataFrame([(3, 2, "k3", False), (3, 1, "k2", False), (90, 1, "k1", False), (4, 5, None, True)], kind)
    put(batch, 0)
    want = {i: (0, "k1") for i in range(50) if i not in (3, 4)} | {3: (2, "k3"), 90: (1, "k1")}
    assert state() == want and len(before.items() & files().items()) >= 5  # files of untouched buckets are the same
    put(batch, 0)
    put(spark.createDataFrame([(3, 1, "k2", False), (4, 4, "k4", False)], kind), 1)  # late
    assert state() == want
    put(spark.createDataFrame([], kind), 2)
    broken = batch.selectExpr("id", "version + 10 as version", "cast(raise_error('stopped') as string) as step", "deleted")
    with pytest.raises(Exception, match="stopped"):
        put(broken, 3)
    assert state() == want


def test_a_stream_of_changes(spark, tmp_path):
    path, source, check, kind = *(str(tmp_path / x) for x in ("t", "in", "check")), "id long, version long, step string, deleted boolean"
    tables.keep(spark.createDataFrame([(1, 0, "k1", False)], kind), path, 4)
    for n in (1, 2):
        spark.createDataFrame([(1, n, f"k{n}", False), (n + 1, 1, "new", False)], kind).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        stream.writeStream.foreachBatch(tables.upsert(path, 4)).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(60)
    assert {r.id: r.step for r in tables.table(spark, path).collect()} == {1: "k2", 2: "new", 3: "new"}
