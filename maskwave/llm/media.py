"""Operator 5: media columns, typed by what their bytes hold and not by what is declared."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A medium found in a value: its type, where it starts, its length, and where its payload (samples or body) lies.
PARTS = "array<struct<mime:string,start:long,length:long,payload_start:long,payload_length:long>>"

Found = tuple[int, int, int] | None  # length, payload start, payload length; offsets from the medium's first byte


class _Value:
    """A value's bytes, with the last answer of each search kept, so that many media in one value don't search its rest anew."""

    def __init__(self, data: bytes):
        self.data = data
        self.seen: dict[bytes, tuple[int, int]] = {}

    def find(self, what: bytes, start: int) -> int:
        """First place of ``what`` at or after ``start``, or -1."""
        asked, at = self.seen.get(what, (0, -2))
        if at == -2 or asked > start or 0 <= at < start:
            at = self.data.find(what, start)
            self.seen[what] = (start, at)
        return at


def _wav(b: memoryview, value: _Value, start: int) -> Found:
    if len(b) < 44 or bytes(b[8:12]) != b"WAVE":
        return None
    length, at = struct.unpack_from("<I", b, 4)[0] + 8, 12
    if length > len(b):
        return None
    fmt = None
    while at + 8 <= length:
        name, size = bytes(b[at : at + 4]), struct.unpack_from("<I", b, at + 4)[0]
        if at + 8 + size > length:
            return None
        if name == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, at + 8)
        if name == b"data":
            ok = fmt and fmt[0] == 1 and fmt[4] == fmt[1] * fmt[5] // 8 and fmt[3] == fmt[2] * fmt[4]
            return (length, at + 8, size) if ok else None
        at += 8 + size + size % 2
    return None


def _png(b: memoryview, value: _Value, start: int) -> Found:
    at, first = 8, None
    while at + 12 <= len(b):
        size, name = struct.unpack_from(">I", b, at)[0], bytes(b[at + 4 : at + 8])
        if at == 8 and (size != 13 or name != b"IHDR"):  # before any sum over bytes
            return None
        if at + 12 + size > len(b) or zlib.crc32(b[at + 4 : at + 8 + size]) != struct.unpack_from(">I", b, at + 8 + size)[0]:
            return None
        if (at == 8) != (name == b"IHDR"):
            return None
        if name == b"IDAT" and first is None:
            first = (at + 8, size)
        at += 12 + size
        if name == b"IEND":
            return (at, *first) if first else None
    return None


def _gif(b: memoryview, value: _Value, start: int) -> Found:
    if len(b) < 14:
        return None
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 0x80 else 0)
    body = at
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1, body, at - body
        if b[at] == 0x2C and at + 10 < len(b):
            at += 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 0x80 else 0)
        elif b[at] == 0x21:
            at += 2
        else:
            return None
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1
    return None


def _jpeg(b: memoryview, value: _Value, start: int) -> Found:
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind, size = b[at + 1], struct.unpack_from(">H", b, at + 2)[0]
        if size < 2:
            return None
        at += 2 + size
        if kind == 0xDA:
            end = value.find(b"\xff\xd9", start + at) - start
            return (end + 2, at, end - at) if end >= at else None
    return None


def _bmp(b: memoryview, value: _Value, start: int) -> Found:
    if len(b) < 30:
        return None
    size, spare, body, head = struct.unpack_from("<IIII", b, 2)
    return (size, body, size - body) if not spare and head in (12, 40, 108, 124) and 26 <= body < size <= len(b) else None


#: Bytes that a gzip member is unpacked by.
CHUNK = 1 << 18


def _gzip(b: memoryview, value: _Value, start: int) -> Found:
    if len(b) < 18 or b[2] != 8 or b[3] & 0xE0:
        return None
    # What it unpacks to is thrown away as it comes, so a small member that holds much costs no memory.
    d, at, given = zlib.decompressobj(31), 0, b""
    try:
        while not d.eof and (given or at < len(b)):
            if not given:
                given, at = bytes(b[at : at + CHUNK]), at + CHUNK
            d.decompress(given, CHUNK)
            given = d.unconsumed_tail
    except zlib.error:
        return None
    length = min(at, len(b)) - len(d.unused_data)
    return (length, 10, length - 18) if d.eof else None


def _zip(b: memoryview, value: _Value, start: int) -> Found:
    """Up to the first end record whose directory lies where it says; those of archives inside this one don't."""
    if len(b) < 30 or struct.unpack_from("<H", b, 4)[0] > 63:
        return None
    end = value.find(b"PK\x05\x06", start)
    while 0 <= end and end - start + 22 <= len(b):
        size, at, note = struct.unpack_from("<IIH", b, end - start + 12)
        if at + size == end - start and bytes(b[at : at + 4]) == b"PK\x01\x02" and end - start + 22 + note <= len(b):
            return end - start + 22 + note, 0, at
        end = value.data.find(b"PK\x05\x06", end + 4)
    return None


def _pdf(b: memoryview, value: _Value, start: int) -> Found:
    """Up to its last end mark before the next document: updates append marks."""
    if len(b) < 9 or b[5] not in b"12" or b[6] != 0x2E:
        return None
    after = value.find(b"%PDF-", start + 5)
    end = value.data.rfind(b"%%EOF", start, after if after >= 0 else len(value.data)) - start
    return (end + 5, 8, end - 8) if end > 8 else None


# Magic bytes, type; beside each, the check of its structure and length.
FORMATS: tuple[tuple[bytes, str, Callable[[memoryview, _Value, int], Found]], ...] = (
    (b"RIFF", "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
)


@lru_cache(maxsize=1)
def _magics() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        out.add_word(magic.decode("latin-1"), (k, len(magic)))
    out.make_automaton()
    return out


def parts_of(value: bytes | None) -> list[tuple[str, int, int, int, int]]:
    """Every valid medium in the bytes, by start; media inside media are listed too."""
    if not value:
        return []
    view, held, out = memoryview(value), _Value(bytes(value)), []
    for last, (k, length) in _magics().iter(str(value, "latin-1")):
        start = last - length + 1
        if found := FORMATS[k][2](view[start:], held, start):
            out.append((FORMATS[k][1], start, found[0], start + found[1], found[2]))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def sniff(df: DataFrame, media: str = "media", declared: str | None = None) -> DataFrame:
    """Adds ``parts`` (each valid medium in the column, carved or whole), ``mime`` (the type of the medium that the value
    starts with, else the declared type, else application/octet-stream) and ``type_corrected`` (that differs from the declared).

    Null and empty values have no parts; a truncated or damaged medium is none; repeated rows get the same; an empty table gives an empty
    result. Columns of those names are replaced.
    """

    @F.pandas_udf(PARTS)
    def find(values: pd.Series) -> pd.Series:
        names = ("mime", "start", "length", "payload_start", "payload_length")
        return pd.Series([[dict(zip(names, p, strict=True)) for p in parts_of(v)] for v in values])

    said = F.col(declared) if declared else F.lit(None).cast("string")
    whole = F.try_element_at(F.filter("parts", lambda p: p["start"] == 0), F.lit(1))
    out = df.withColumn("parts", find(F.col(media)))
    out = out.withColumn("mime", F.coalesce(whole["mime"], said, F.lit("application/octet-stream")))
    return out.withColumn("type_corrected", F.coalesce(~F.col("mime").eqNullSafe(said) & said.isNotNull(), F.lit(False)))


def carve(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each embedded medium of a sniffed frame: part (its type, start, length, ...) and carved (its bytes), beside the frame's other
    columns; columns of those two names are replaced. Rows without media have none; repeated rows give theirs as often."""
    out = df.withColumn("part", F.explode("parts")).drop("parts")
    return out.withColumn("carved", F.substring(F.col(media), F.col("part.start").cast("int") + 1, F.col("part.length").cast("int")))


def _little(n: Column) -> Column:
    """A count as four bytes, lowest first."""
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def as_wav(text: Column) -> tuple[Column, Column]:
    """(number of payload bytes before padding, a WAV of 8-bit samples that holds them): UTF-8, zeros up to a multiple of 64."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    size = F.greatest(F.ceil(n / 64) * 64, F.lit(64)).cast("long")
    zeros = F.unhex(F.repeat(F.lit("00"), (size - n).cast("int")))
    fixed = F.unhex(F.lit((b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data").hex()))
    wav = F.concat(F.encode(F.lit("RIFF"), "UTF-8"), _little(size + 36), F.encode(F.lit("WAVE"), "UTF-8"), fixed, _little(size), raw, zeros)
    return n.cast("long"), wav


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores each text as a medium under a wrong declared type, sniffs it, and reads the payload back where the sniffer found it."""
    n, wav = as_wav(F.col("text"))
    stored = table(spark, sf_dir, "documents").select("doc_id", n.alias("n_bytes"), wav.alias("media"), F.lit("image/png").alias("declared"))
    got = sniff(stored, declared="declared").withColumn("whole", F.element_at(F.filter("parts", lambda p: p["start"] == 0), 1))
    begin, length = F.col("whole.payload_start").cast("int"), F.col("whole.payload_length").cast("int")
    payload = F.substring(F.col("media"), begin + 1, length)
    inside = F.filter("parts", lambda p: p["start"] > 0)
    return got.select(
        "doc_id",
        "n_bytes",
        length.cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, length - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "mime", F.when(F.col("type_corrected"), "corrected"), F.concat_ws(",", F.transform(inside, lambda p: F.concat_ws("@", p["mime"], p["start"].cast("string"))))).alias("feature"),
    )
