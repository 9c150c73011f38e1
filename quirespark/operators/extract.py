"""Text of Word files by a chain of parsers with time limits, and answers of a language model with its errors told apart."""

from __future__ import annotations

import io
import json
import signal
import socket
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

#: Seconds that a parser may take, and what stands for a text that no parser could read.
PARSER_LIMIT, UNREADABLE = 30.0, "[BŁĄD ODCZYTU] Nie można odczytać dokumentu Word. "
#: The keys under which an answer may come, and what is said of those that fail.
ANSWER_KEYS = ("content", "response", "text", "completion")
ERRORS = {
    "timeout": "Timeout - LLM nie odpowiedział w ciągu {0} sekund",
    "status": "LLM server zwrócił błąd HTTP {0}: {1}",
    "connection": "Nie można połączyć się z LLM serverem ({0})",
    "no_text": "LLM zwrócił odpowiedź bez tekstu. Dostępne klucze: {0}",
    "empty": "LLM zwrócił pusty wynik",
    "other": "Nieoczekiwany błąd podczas komunikacji z LLM: {0}",
}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@contextmanager
def at_most(seconds: float) -> Iterator[None]:
    """Raises TimeoutError within the block when it takes longer. For a worker's main thread."""

    def late(*_: object) -> None:
        raise TimeoutError(f"over {seconds} seconds")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def docx_text(content: bytes) -> str:
    """The paragraphs of a .docx file, one a line, read from its zip entry as a stream: each is let go when it has been read. Tables are left out."""
    out, path = [], []
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as part:
        for event, e in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                path.append(e.tag)
                continue
            path.pop()
            if path and path[-1] == f"{_W}body":
                if e.tag == f"{_W}p":
                    out.append("".join(run_text(r) for r in e.iter(f"{_W}r")))
                e.clear()
    return "\n".join(out).strip()


def run_text(run: ElementTree.Element) -> str:
    own = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join((c.text or "") if c.tag == f"{_W}t" else own.get(c.tag, "") for c in run)


def first_text(content: bytes | None, parsers: list[tuple[str, Callable[[bytes], str]]], limit: float, failure: str) -> tuple[str, str | None, list[str]]:
    """The text of the first parser that gives one within the limit (else the failure), its name, and why those before it gave none."""
    why = []
    for name, parse in parsers if content else ():
        try:
            with at_most(limit):
                text = (parse(bytes(content)) or "").strip()
        except Exception as e:  # the next parser is the fallback
            why.append(f"{name}: {type(e).__name__}")
            continue
        if text:
            return text, name, why
        why.append(f"{name}: empty")
    return failure, None, why


def word_texts(files: DataFrame, others: list[tuple[str, Callable[[bytes], str]]] | None = None, limit: float = PARSER_LIMIT, failure: str = UNREADABLE) -> DataFrame:
    """(id, text, parser, tried) of Word files (id, content): .docx by docx_text(), then the caller's parsers (name, function) in order.

    A parser that fails, hangs beyond the limit (in seconds) or gives no text is passed over; if all are, text is the failure and parser null.
    """
    parsers = [("docx", docx_text), *(others or [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [first_text(c, parsers, limit, failure) for c in pdf["content"]]
            yield pdf[["id"]].assign(text=[t for t, *_ in found], parser=[p for _, p, _ in found], tried=[w for *_, w in found])

    return files.select("id", "content").mapInPandas(run, "id long, text string, parser string, tried array<string>")


def completion(url: str, settings: dict, limit: float) -> Callable[[str], tuple[str | None, str | None]]:
    """Asks a server for the completion of a prompt: (answer, None), or (None, the kind of error and its text as `kind: text`)."""

    def fail(kind: str, *values: object) -> tuple[None, str]:
        return None, f"{kind}: {ERRORS[kind].format(*values)}"

    def ask(prompt: str) -> tuple[str | None, str | None]:
        body = json.dumps({"prompt": prompt, **settings}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{url}/completion", body, {"Content-Type": "application/json"}), timeout=limit) as r:
                said = json.load(r)
        except urllib.error.HTTPError as e:
            return fail("status", e.code, e.read().decode("utf-8", "replace"))
        except (TimeoutError, socket.timeout):
            return fail("timeout", limit)
        except urllib.error.URLError as e:
            return fail("timeout", limit) if isinstance(e.reason, TimeoutError) else fail("connection", url)
        except Exception as e:  # one request's failure is a result
            return fail("other", e)
        key = next((k for k in ANSWER_KEYS if k in said), None) if isinstance(said, dict) else None
        if key is None or said[key] is None:
            return fail("no_text", list(said)) if key is None else fail("empty")
        text = str(said[key]).strip()
        return (text, None) if text else fail("empty")

    return ask


def answers(df: DataFrame, url: str, instruction: str, settings: dict | None = None, limit: float = 60.0, at_once: int | None = None) -> DataFrame:
    """(id, summary, error) of documents (id, content), asked one by one in each task; error is null or `kind: text`, the kinds being those of ERRORS.

    at_once bounds the tasks, and with them the requests that the server has at a time. Rows are handed on as they are answered, a batch each.
    """
    asked = df.select("id", L.prompt(F.col("content"), instruction).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = completion(url, settings or {}, limit)
        for pdf in batches:
            said = [ask(p or "") for p in pdf["prompt"]]
            yield pdf[["id"]].assign(summary=[s for s, _ in said], error=[e for _, e in said])

    return (asked.repartition(at_once) if at_once else asked).mapInPandas(run, "id long, summary string, error string")
