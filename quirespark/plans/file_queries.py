"""Queries on the bytes of files. The given tables hold none, so contents are put together from their rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import images
from ..functions import labels as L
from .catalog import query


def _bytes(*parts) -> Column:
    """Binary of hexadecimal strings, and of (number, bytes, lowest first) triples."""

    def one(p) -> Column:
        if isinstance(p, str):
            return F.unhex(F.lit(p))
        if not isinstance(p, tuple):
            return p
        value, n, low = p
        h = F.lpad(F.hex(value), 2 * n, "0")
        return F.unhex(F.concat(*(F.substr(h, F.lit(2 * k + 1), F.lit(2)) for k in reversed(range(n)))) if low else h)

    return F.concat(*map(one, parts))


_WIDTH, _HEIGHT = "1 + doc_id * 37 % 5000", "1 + doc_id * 53 % 3000"


@query(
    f"""select doc_id, w as width, h as height, greatest(0, floor(w * 0.25)::int - 5) as "left", greatest(0, floor(h * 0.5)::int - 5) as top,
    least(w, floor(w * 0.75)::int + 5) as "right", least(h, floor(h * 0.625)::int + 5) as bottom
from (select doc_id, ({_WIDTH})::int as w, ({_HEIGHT})::int as h from documents)""",
    tables="",
)
def image_sizes(spark, sf_dir):
    """Sizes read from the headers of an image for each document, of seven formats by turns, with the document's text as what follows; and a crop in pixels of that size."""
    w, h, text = F.expr(_WIDTH), F.expr(_HEIGHT), F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    short = "0003", "00000001"
    kinds = [
        _bytes("89504E470D0A1A0A0000000D49484452", (w, 4, False), (h, 4, False), text),
        _bytes("474946383961", (w, 2, True), (h, 2, True), text),
        _bytes("424D" + "00" * 12 + "28000000", (w, 4, True), (h, 4, True), text),
        _bytes("FFD8FFE1", (F.lit(2) + F.octet_length("text") % 60000, 2, False), F.substr(text, F.lit(1), (F.octet_length("text") % 60000).cast("int")), "FFC2001108", (h, 2, False), (w, 2, False), text),
        _bytes("49492A0008000000" + "0200" + "0001" + "0300" + "01000000", (w, 2, True), "0000" + "0101" + "0400" + "01000000", (h, 4, True), text),
        _bytes("4D4D002A00000008" + "0002" + "0100" + "".join(short), (w, 2, False), "0000" + "0101" + "".join(short), (h, 2, False), "0000", text),
        _bytes("524946460000000057454250" + "56503858" + "00" * 8, (w - 1, 3, True), (h - 1, 3, True), text),
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    content = kinds[-1]
    for k, c in enumerate(kinds[:-1]):
        content = F.when(F.col("doc_id") % len(kinds) == k, c).otherwise(content)
    sized = docs.select("doc_id", content.alias("content")).select("doc_id", images.image_size(F.col("content")).alias("_s")).select("doc_id", "_s.width", "_s.height")
    box = L.crop_box(*(F.lit(x) for x in (0.25, 0.5, 0.75, 0.625)), F.col("width"), F.col("height"))
    return sized.withColumns({k: v for k, v in box.items() if k != "scale"})


_NAMES = {0: ".txt", 1: ".pdf", 2: ".docx", 3: ".png", 4: "", 5: ".jpg", 6: ".tif"}
_WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
_NAME = "concat('plik', case doc_id % 7 " + " ".join(f"when {k} then '{v}'" for k, v in _NAMES.items()) + " end)"


@query(
    f"""select mime_type, file_class, count(*)::bigint as files, sum(renamed)::bigint as renamed from (
    select case doc_id % 6 when 0 then 'application/pdf' when 1 then 'image/jpeg' when 2 then '{_WORD}' when 3 then 'application/zip' when 4 then case when length(text) = 0 then 'inode/x-empty' else 'text/plain' end
        else case doc_id % 7 when 0 then 'text/plain' when 1 then 'application/pdf' when 2 then '{_WORD}' when 3 then 'image/png' when 4 then 'application/octet-stream' when 5 then 'image/jpeg' else 'image/tiff' end end as mime_type,
        case when mime_type like 'image/%' then 'image' when mime_type like '%word%' then 'opinion' else 'document' end as file_class,
        (case doc_id % 7 when 0 then 'text/plain' when 1 then 'application/pdf' when 2 then '{_WORD}' when 3 then 'image/png' when 4 then 'application/octet-stream' when 5 then 'image/jpeg' else 'image/tiff' end <> mime_type)::int as renamed
    from (select doc_id, coalesce(text, '') as text from documents)) group by all""",
    tables="",
)
def content_types(spark, sf_dir):
    """Types of files by their bytes where the names say something else: PDF, JPEG, Word, zip, text, and bytes that say nothing, so that the name decides."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    kinds = [
        _bytes("255044462D312E370A", text),
        _bytes("FFD8FFE0", text),
        _bytes("504B03041400", text, F.encode(F.lit("word/document.xml"), "UTF-8")),
        _bytes("504B03041400", text),
        text,
        _bytes("00", text),
    ]
    content = kinds[-1]
    for k, c in enumerate(kinds[:-1]):
        content = F.when(F.col("doc_id") % len(kinds) == k, c).otherwise(content)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(content.alias("content"), F.expr(_NAME).alias("name"))
    found = docs.select(images.mime_of_content(F.col("content"), F.col("name")).alias("mime_type"), L.mime_of(F.col("name")).alias("_by_name"))
    named = found.withColumn("file_class", L.content_type(F.col("mime_type")))
    return named.groupBy("mime_type", "file_class").agg(F.count(F.lit(1)).alias("files"), F.sum((F.col("mime_type") != F.col("_by_name")).cast("long")).alias("renamed"))
