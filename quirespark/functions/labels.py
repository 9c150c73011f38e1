"""Labels and other derived columns of the document table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
OCR_LABELS = {"done": "Zakończony", "running": "W trakcie", "fail": "Błąd", "pending": "Oczekuje"}
CONTEXT_LABELS = {"none": "Niewykonany", **OCR_LABELS}
STEP_CLASSES = {"k1": "bg-danger", "k2": "bg-warning", "k3": "bg-success", "k4": "bg-secondary"}
STEP_ICONS = {"k1": "pencil-fill", "k2": "journals", "k3": "check-circle-fill", "k4": "archive-fill"}
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".bmp": "image/bmp",
    ".webp": "image/webp",
    ".txt": "text/plain",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
SIZES = ("B", "KB", "MB", "GB", "TB")


def lookup(key: Column, values: dict[str, str], other: str | None) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def filled(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def is_image(mime: Column) -> Column:
    return F.coalesce(F.startswith(mime, F.lit("image/")), F.lit(False))


def is_word(mime: Column) -> Column:
    return F.coalesce(F.contains(mime, F.lit("word")), F.lit(False))


def kind_label(is_main: Column, mime: Column, doc_type: Column) -> Column:
    """The first that holds decides."""
    return (
        F.when(is_main, "Opinia główna")
        .when(is_image(mime), "Obraz")
        .when(mime == "application/pdf", "PDF")
        .when(is_word(mime), "Word")
        .when(doc_type == "OCR TXT", "Wynik OCR")
        .otherwise("Dokument")
    )


def ocr_label(status: Column) -> Column:
    return lookup(status, OCR_LABELS, "Brak")


def minute(time: Column, empty: str = "") -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd HH:mm"), F.lit(empty))


def percent(status: Column, confidence: Column) -> Column:
    """Confidence in whole percent for finished documents; null otherwise, and for a confidence of zero. Halves go to the even number."""
    return F.when((status == "done") & (confidence != 0), F.concat(F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("%")))


def context_rows(status: Column, confidence: Column, doc_type: Column, uploaded: Column) -> Column:
    """(label, value) of what is shown beside a document."""

    def row(label: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(label).alias("label"), value.alias("value")))

    return F.array_compact(
        F.array(
            row("Status OCR", lookup(status, CONTEXT_LABELS, "Nieznany")),
            row("Pewność OCR", percent(status, confidence)),
            row("Typ dokumentu", F.coalesce(filled(doc_type), F.lit("Nieznany"))),
            row("Data dodania", minute(uploaded, "Brak")),
        )
    )


def step_class(step: Column) -> Column:
    return lookup(step, STEP_CLASSES, "bg-secondary")


def step_icon(step: Column) -> Column:
    return lookup(step, STEP_ICONS, "question-circle")


def display_name(sygnatura: Column, filename: Column, id_: Column) -> Column:
    return F.coalesce(filled(sygnatura), filled(filename), F.concat(F.lit("Opinia #"), id_.cast("string")))


def content_type(mime: Column) -> Column:
    return F.when(is_image(mime), "image").when(is_word(mime), "opinion").otherwise("document")


def extension(filename: Column) -> Column:
    """The lower-cased ending with its dot; '' if there is none, or the name only begins with a dot."""
    return F.lower(F.regexp_extract(filename, r"[^/](\.[^./]+)$", 1))


def allowed(filename: Column) -> Column:
    return extension(filename).isin(*MIME_TYPES)


def mime_of(filename: Column) -> Column:
    return lookup(extension(filename), MIME_TYPES, "application/octet-stream")


#: Classes of files by ending on the server, and what the quick recognition page takes.
SERVER_KINDS = {"image": (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp"), "pdf": (".pdf",), "word": (".doc", ".docx"), "text": (".txt",)}
QUICK = (".pdf", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff")


def server_kind(filename: Column) -> Column:
    """image, pdf, word or text by the ending; null for any other."""
    e = extension(filename)
    return F.coalesce(*(F.when(e.isin(*v), k) for k, v in SERVER_KINDS.items()))


def quick_allowed(filename: Column) -> Column:
    """Whether the quick recognition page takes a file; what follows the last dot counts, though the name begin with it or have none."""
    return F.concat(F.lit("."), F.lower(F.element_at(F.split(filename, r"\."), -1))).isin(*QUICK)


def in_history(stored: Column) -> Column:
    """Whether a stored file is an archived version."""
    return F.startswith(stored, F.lit("history/"))


def on_page(page: Column, total: Column) -> Column:
    """Whether a document has such a page."""
    return F.coalesce(page.between(1, total), F.lit(False))


def progress_record() -> Column:
    """What a page that shows the progress of recognition polls; only the confidence may be null."""
    c = F.col
    return F.struct(
        c("ocr_status").alias("status"),
        F.coalesce("ocr_progress", F.lit(0.0)).alias("progress"),
        F.coalesce("ocr_progress_info", F.lit("")).alias("info"),
        F.coalesce("ocr_current_page", F.lit(0)).alias("current_page"),
        F.coalesce("ocr_total_pages", F.lit(0)).alias("total_pages"),
        c("ocr_confidence").alias("confidence"),
    )


def status_record() -> Column:
    done = F.coalesce(F.col("ocr_status") == "done", F.lit(False))
    return F.struct(done.alias("ocr_done"), "ocr_status", F.coalesce("ocr_progress", F.lit(0.0)).alias("ocr_progress"), F.coalesce("ocr_progress_info", F.lit("")).alias("ocr_info"))


def client_kind(filename: Column) -> Column:
    """What a browser takes a file for by its ending."""
    e = F.lower(F.regexp_extract(filename, r"(\.[^./]+)$", 1))
    return F.when(e == ".pdf", "pdf").when(e.isin(".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp"), "image").when(e.isin(".doc", ".docx"), "word").when(e.isin(".txt", ".log"), "text").otherwise("unknown")


def preview_target(mime: Column, filename: Column, embedded: bool = False) -> Column:
    """Where a preview goes: file, word_text, word_preview, text_preview or download."""
    kind = F.coalesce(filled(mime), mime_of(filename))
    text = (kind == "text/plain") | F.endswith(F.lower(filename), F.lit(".txt"))
    return (
        F.when(is_image(kind) | (kind == "application/pdf"), "file")
        .when(is_word(kind), "word_text" if embedded else "word_preview")
        .when(text, "file" if embedded else "text_preview")
        .otherwise("download")
    )


def actions(status: Column, mime: Column) -> Column:
    """What can be done with a document, in order."""
    return F.array_compact(
        F.array(
            F.lit("download"),
            F.when((status == "none") & ~mime.eqNullSafe(F.lit("text/plain")), F.lit("run_ocr")),
            F.when(status == "done", F.lit("summarize")),
            F.when(is_word(mime), F.lit("update")),
        )
    )


def file_size(n: Column) -> Column:
    """Bytes in units of 1024 with one decimal (halves to the even one), TB at most; 0 is '0 B'."""
    unit = F.least(F.lit(len(SIZES) - 1), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 10 + F.lit(1e-12))).cast("int")
    return F.when(n == 0, "0 B").otherwise(F.concat(F.format_string("%.1f", F.bround(n / F.pow(F.lit(1024.0), unit), 1)), F.lit(" "), F.element_at(F.array(*map(F.lit, SIZES)), unit + 1)))


def progress(status: Column, value: Column) -> Column:
    """A document's part in the progress of its case."""
    return F.when(status == "done", F.lit(1.0)).when(status.isin("pending", "running"), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def page_progress(page: Column, total: Column) -> Column:
    return 0.2 + 0.7 * page / total


def progress_percent(value: Column) -> Column:
    return F.floor(value * 100 + 0.5).cast("int")


#: Marks in notes, recognized texts and prompts.
SUMMARY_MARK, UPDATE_MARK, FRAGMENT_MARK, CUT_MARK = "[PODSUMOWANIE AI - {}]\n", "\n[{}] Aktualizacja: ", "\n\n--- Dodany fragment ---\n", "\n\n[TEKST SKRÓCONY...]"


def note_with_summary(note: Column, summary: Column, at: str, mode: str = "append") -> Column:
    """A note with a summary made at the time `at` put after it, before it or in its place; any other mode puts it after."""
    new = F.concat(F.lit(SUMMARY_MARK.format(at)), summary)
    line = "\n\n---\n\n"
    merged = {"replace": new, "prepend": F.concat(new, F.lit(line), note)}.get(mode, F.concat(note, F.lit(line), new))
    return F.when(F.trim(F.regexp_replace(F.coalesce(note, F.lit("")), r"(?U)\s+", " ")) == "", new).otherwise(merged)


def note_with_comment(note: Column, comment: str, at: str) -> Column:
    return F.concat(F.coalesce(note, F.lit("")), F.lit(UPDATE_MARK.format(at) + comment))


def with_fragment(text: Column, fragment: Column) -> Column:
    return F.concat(text, F.lit(FRAGMENT_MARK), fragment)


def with_breaks(text: Column) -> Column:
    return F.regexp_replace(text, "\n", "<br>")


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: int = 5) -> dict[str, Column]:
    """A selection in shares of a page as pixels, with a margin, within the page; and the factor that makes its shorter side 300."""

    def low(x: Column, size: Column) -> Column:
        return F.greatest(F.lit(0), (x * size).cast("int") - margin)

    def high(x: Column, size: Column) -> Column:
        return F.least(size, (x * size).cast("int") + margin)

    box = {"left": low(x1, width), "top": low(y1, height), "right": high(x2, width), "bottom": high(y2, height)}
    side = F.least(box["right"] - box["left"], box["bottom"] - box["top"])
    return box | {"scale": F.when((side > 0) & (side < 300), 300.0 / side).otherwise(F.lit(1.0))}


def selection(ax: Column, ay: Column, bx: Column, by: Column, width: Column, height: Column) -> dict[str, Column]:
    """Two corners in pixels as shares of a page; null where a side is under 10 pixels."""
    ok = (F.abs(ax - bx) >= 10) & (F.abs(ay - by) >= 10)
    return {"x1": F.when(ok, F.least(ax, bx) / width), "y1": F.when(ok, F.least(ay, by) / height), "x2": F.when(ok, F.greatest(ax, bx) / width), "y2": F.when(ok, F.greatest(ay, by) / height)}


def whole_page(x1: Column, y1: Column, x2: Column, y2: Column, near: float = 0.01) -> Column:
    return (F.abs(x1) < near) & (F.abs(y1) < near) & (F.abs(x2 - 1) < near) & (F.abs(y2 - 1) < near)


def stem_with(filename: Column, suffix: str) -> Column:
    """A file name without its ending, and a suffix."""
    return F.concat(F.regexp_replace(filename, r"(?<=.)\.[^./]+$", ""), F.lit(suffix))


def first_present(json: Column, keys: tuple[str, ...] = ("content", "response", "text", "completion")) -> Column:
    """The value of the first of the keys that a JSON object has, though it be null or empty."""
    values = F.from_json(json, "map<string,string>")
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(values, k), values[k]).otherwise(out)
    return out


def prompt(text: Column, instruction: str, most: int = 8000, mark: str = CUT_MARK) -> Column:
    return F.concat(F.lit(f"{instruction}\n\n"), truncate_at(text, most, mark))


def truncate_at(text: Column, most: int, mark: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)
