import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quirespark.functions import images
from quirespark.sources import files


def png(w, h):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


def jpeg(w, h, *, before=(b"\xff\xe0\x00\x10" + b"J" * 14,), sof=0xC0):
    return b"\xff\xd8" + b"".join(before) + bytes([0xFF, sof]) + struct.pack(">HBHH", 17, 8, h, w) + b"\x03" + b"\0" * 9 + b"\xff\xda"


def tiff(w, h, order="<", size="H", at=8):
    entry = lambda tag, v: struct.pack(order + "HHI", tag, 3 if size == "H" else 4, 1) + struct.pack(order + size, v).ljust(4, b"\0")
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + b"\0" * (at - 8) + struct.pack(order + "H", 3) + entry(254, 0) + entry(256, w) + entry(257, h)


IMAGES = {
    "a.png": (png(300, 70000), (300, 70000)),
    "b.gif": (b"GIF89a" + struct.pack("<HH", 640, 400) + b"\0" * 5, (640, 400)),
    "c.bmp": (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 33, 44), (33, 44)),
    "d.bmp": (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 33, -44), (33, 44)),
    "e.bmp": (b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 65000, 7) + b"\0" * 8, (65000, 7)),
    "f.jpg": (jpeg(1024, 768), (1024, 768)),
    "g.jpg": (jpeg(9, 8, before=(b"\xff\xe1\xff\xff" + b"\xff\xc0" * 32766 + b"x", b"\xff\xff\xff\xfe\x00\x04ab", b"\xff\xc4\x00\x05xyz", b"\xff\xd0"), sof=0xC2), (9, 8)),
    "h.tif": (tiff(1700, 2200), (1700, 2200)),
    "i.tif": (tiff(80000, 3, ">", "I", 64), (80000, 3)),
    "j.webp": (b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + (4999).to_bytes(3, "little") + (70000).to_bytes(3, "little"), (5000, 70001)),
    "k.webp": (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + ((16383) | (200 << 14)).to_bytes(4, "little"), (16384, 201)),
    "l.webp": (b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 550 | 0x4000, 368), (550, 368)),
}
OTHERS = {"m.png": b"\x89PNG\r\n\x1a\n\0\0", "n.jpg": b"\xff\xd8\xff\xd9", "o.jpg": jpeg(5, 5)[:25], "p.tif": b"II*\0\xff\xff\0\0", "q.tif": tiff(3, 4)[:20], "s.txt": b"text", "t.jpg": b"\xff\xd8\xffXX"}


def test_sizes_of_files(spark, tmp_path):
    for name, (data, _) in IMAGES.items():
        (tmp_path / name).write_bytes(data)
    for name, data in OTHERS.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.width, r.height) for r in files.image_sizes(files.blobs(spark, str(tmp_path))).collect()}
    assert got == {**{k: v[1] for k, v in IMAGES.items()}, **dict.fromkeys(OTHERS, (None, None))}


def test_no_content(spark):
    assert spark.createDataFrame([(None,)], "b binary").select(images.image_size(F.col("b")).alias("s"), images.mime_of_content(F.col("b"), F.lit("x.pdf")).alias("m")).first() == (None, "application/pdf")


def zipped(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x" * 50)
    return out.getvalue()


WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
TYPES = [
    (b"%PDF-1.7 x", "x.txt", "application/pdf"),
    (png(1, 1), "x.pdf", "image/png"),
    (IMAGES["l.webp"][0], "x", "image/webp"),
    (b"RIFF\0\0\0\0WAVE", "x.wav", "application/octet-stream"),
    (zipped("[Content_Types].xml", "word/document.xml"), "x.pdf", WORD),
    (zipped("xl/workbook.xml"), "x.docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    (zipped("a.txt"), "x.docx", "application/zip"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "x.bin", "application/msword"),
    ("zażółć\n".encode(), "x.png", "text/plain"),
    ("ó".encode("latin-1"), "x.txt", "text/plain"),
    (b"a\x00b", "x.docx", WORD),
    (b"", "x.pdf", "inode/x-empty"),
]


@pytest.mark.parametrize("content, name, mime", TYPES)
def test_type_by_content_before_name(spark, content, name, mime):
    df = spark.createDataFrame([(bytearray(content), name)], "content binary, name string")
    assert df.select(images.mime_of_content(F.col("content"), F.col("name"))).first()[0] == mime
