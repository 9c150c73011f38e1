"""What a file is and how large an image is, by its first bytes: built-in expressions on binary columns, no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L

#: The first bytes of files (in hexadecimal, from the start) and their types.
SIGNATURES = {
    "255044462D": "application/pdf",
    "89504E470D0A1A0A": "image/png",
    "FFD8FF": "image/jpeg",
    "474946383761": "image/gif",
    "474946383961": "image/gif",
    "49492A00": "image/tiff",
    "4D4D002A": "image/tiff",
    "424D": "image/bmp",
    "D0CF11E0A1B11AE1": "application/msword",
    "7B5C727466": "text/rtf",
    "1F8B": "application/gzip",
    "377ABCAF271C": "application/x-7z-compressed",
    "52617221": "application/x-rar",
}
#: A name that one of a zip container's entries has, and the type of the whole.
ENTRIES = {
    "word/document.xml": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xl/workbook.xml": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt/presentation.xml": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "mimetypeapplication/vnd.oasis.opendocument.text": "application/vnd.oasis.opendocument.text",
}
#: Control characters that do not stand in text.
CONTROL = r"[\x00-\x06\x0E-\x1A\x1C-\x1F]"
#: JPEG segments that are passed over before a frame is given up.
SEGMENTS = 1000


def hexed(content: Column, at: Column | int, n: int) -> Column:
    """n bytes from `at` (0 is the first) in hexadecimal; fewer where the content ends."""
    return F.hex(F.substr(content, F.lit(at) + 1, F.lit(n)))


def big(content: Column, at: Column | int, n: int) -> Column:
    """An unsigned number of n bytes, the highest first; null beyond the end."""
    h = hexed(content, at, n)
    return F.when(F.length(h) == 2 * n, F.conv(h, 16, 10).cast("long"))


def little(content: Column, at: Column | int, n: int) -> Column:
    """An unsigned number of n bytes, the lowest first; null beyond the end."""
    h = hexed(content, at, n)
    turned = F.concat(*(F.substr(h, F.lit(2 * k + 1), F.lit(2)) for k in reversed(range(n))))
    return F.when(F.length(h) == 2 * n, F.conv(turned, 16, 10).cast("long"))


def signature(content: Column, table: dict[str, str] | None = None) -> Column:
    """The type whose first bytes a content has; the longest that fit count. null if none does."""
    table = table or SIGNATURES
    head = F.hex(F.substr(content, F.lit(1), F.lit(max(map(len, table)) // 2)))
    fits = [F.when(F.startswith(head, F.lit(p)), v) for p, v in sorted(table.items(), key=lambda x: -len(x[0]))]
    webp = F.when(F.startswith(head, F.lit("52494646")) & (hexed(content, 8, 4) == "57454250"), "image/webp")
    return F.coalesce(webp, *fits)


def container(content: Column) -> Column:
    """The type of a zip container by the names of its entries, which stand in it as they are; null if it is none."""
    raw = F.decode(content, "ISO-8859-1")
    kinds = [F.when(F.contains(raw, F.lit(e)), v) for e, v in ENTRIES.items()]
    return F.when(hexed(content, 0, 4) == "504B0304", F.coalesce(*kinds, F.lit("application/zip")))


def textual(content: Column) -> Column:
    """Whether bytes are text: UTF-8 without control characters."""
    text = content.cast("string")
    return F.is_valid_utf8(text) & ~F.coalesce(F.make_valid_utf8(text).rlike(CONTROL), F.lit(False))


def mime_of_content(content: Column, filename: Column) -> Column:
    """A file's type by its bytes; where these say nothing, or there are none (null), by its name."""
    empty = F.when(F.octet_length(content) == 0, "inode/x-empty")
    text = F.when(textual(content), "text/plain")
    return F.coalesce(empty, signature(content), container(content), text, L.mime_of(filename))


def jpeg_frame(content: Column) -> Column:
    """Where the header of a JPEG's frame lies: segments are passed over by their lengths. null if there is none among SEGMENTS."""

    def step(at: Column, _: Column) -> Column:
        code = hexed(content, at + 1, 1)
        frame = (F.substr(code, F.lit(1), F.lit(1)) == "C") & ~code.isin("C4", "C8", "CC")
        filler = code == "FF"
        alone = code.isin("01", *(f"D{k}" for k in range(8)))
        bad = (hexed(content, at, 1) != "FF") | code.isin("D9", "DA")
        on = F.when(filler, at + 1).when(alone, at + 2).otherwise(at + 2 + big(content, at + 2, 2))
        # a place found is kept below zero, so that later steps leave it alone
        return F.when(at.isNull() | (at < 0), at).when(bad, F.lit(None)).when(frame, -at).otherwise(on).cast("long")

    found = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(SEGMENTS), F.octet_length(content))), F.lit(2).cast("long"), step)
    return F.when(found < 0, -found)


def tiff_entry(content: Column, tag: int) -> Column:
    """The number under a tag in the first directory of a TIFF file."""
    turned = hexed(content, 0, 1) == "49"

    def number(at: Column | int, n: int) -> Column:
        return F.when(turned, little(content, at, n)).otherwise(big(content, at, n))

    def entry(directory: Column) -> Column:
        count = F.coalesce(number(directory, 2), F.lit(0))
        places = F.transform(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>")), lambda k: directory + 2 + 12 * k)
        own = F.filter(places, lambda at: number(at, 2) == tag)
        return F.transform(F.slice(own, 1, 1), lambda at: F.when(number(at + 2, 2) == 3, number(at + 8, 2)).otherwise(number(at + 8, 4)))

    # as an element of an array the directory's place is read once
    return F.get(F.get(F.transform(F.array(number(4, 4)), entry), F.lit(0)), F.lit(0))


def image_size(content: Column) -> Column:
    """(width, height) in pixels of PNG, JPEG, GIF, BMP, TIFF and WebP images from their headers; null if the content is no such image or its header is cut off."""

    def size(width: Column, height: Column) -> Column:
        return F.when(width.isNotNull() & height.isNotNull(), F.struct(width.cast("int").alias("width"), height.cast("int").alias("height")))

    old = little(content, 14, 4) == 12
    rows = F.when(old, little(content, 20, 2)).otherwise(little(content, 22, 4))
    rows = F.when(rows > 0x7FFFFFFF, 0x100000000 - rows).otherwise(rows)  # negative: the upper row first
    part, bits = hexed(content, 12, 4), little(content, 21, 4)
    webp = (
        F.when(part == "56503858", size(little(content, 24, 3) + 1, little(content, 27, 3) + 1))
        .when(part == "5650384C", size(bits.bitwiseAND(F.lit(0x3FFF)) + 1, F.shiftright(bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1))
        .when(part == "56503820", size(little(content, 26, 2).bitwiseAND(F.lit(0x3FFF)), little(content, 28, 2).bitwiseAND(F.lit(0x3FFF))))
    )
    jpeg = F.get(F.transform(F.array(jpeg_frame(content)), lambda at: size(big(content, at + 7, 2), big(content, at + 5, 2))), F.lit(0))
    def by_kind(kind: Column) -> Column:
        return (
            F.when(kind == "image/png", size(big(content, 16, 4), big(content, 20, 4)))
            .when(kind == "image/gif", size(little(content, 6, 2), little(content, 8, 2)))
            .when(kind == "image/bmp", size(F.when(old, little(content, 18, 2)).otherwise(little(content, 18, 4)), rows))
            .when(kind == "image/tiff", size(tiff_entry(content, 256), tiff_entry(content, 257)))
            .when(kind == "image/webp", webp)
            .when(kind == "image/jpeg", jpeg)
        )

    # as an element of an array the kind is found once
    return F.get(F.transform(F.array(signature(content)), by_kind), F.lit(0))
