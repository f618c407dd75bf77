"""Media columns: signature sniffing with validators.

An Aho-Corasick automaton finds magic bytes anywhere in the stored bytes; a validator for each format then walks the
structure and its lengths. What stands at byte 0 corrects the declared type; what stands later is carved out.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, arrow_schema, map_rows

BLOCK = 64
RATE = 8000
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared_type string, corrected_type string"


class Body:
    """Stored bytes, with what the validators look for in them. Everything is found once, however many signatures there are."""

    def __init__(self, b: bytes):
        self.b, self.view = b, memoryview(b)
        self.found: dict[bytes, tuple[int, int]] = {}
        self.walks: dict[str, dict[int, int]] = {}

    def next(self, what: bytes, i: int) -> int:
        """Where `what` stands at or after i, else -1. Signatures come in order, so the last answer mostly still holds."""
        since, at = self.found.get(what, (0, -2))
        if at == -2 or i < since or -1 < at < i:
            since, at = i, self.b.find(what, i)
            self.found[what] = since, at
        return at

    def follow(self, name: str, i: int, step: Callable[[int], tuple[int, int]]) -> int:
        """Where a walk from i ends. step gives (next place, 0), or (-1, end). Walks that meet share their end, so all of them together are linear."""
        ends, path, k = self.walks.setdefault(name, {}), [], 0
        while True:
            end = ends.get(i, -1)
            if end >= 0:
                break
            if k % 16 == 0:
                path.append(i)
            k += 1
            i, end = step(i)
            if i < 0:
                break
        ends.update(dict.fromkeys(path, end))
        return end

    @cached_property
    def pdf_references(self) -> list[int]:
        """Where cross-references begin: tables, and objects, which may be streams of them."""
        return [m.start() for m in re.finditer(rb"(?<!start)xref|(?<!\d)\d{1,10}\s{1,8}\d{1,5}\s{1,8}obj", self.b)]

    @cached_property
    def pdf_trailers(self) -> tuple[dict[int, int], dict[int, list[int]]]:
        """Trailers by the place where their file begins, and by the offset that they name.

        A save's trailer names the cross-references right before it, which tells where the file begins; of each file
        the last one counts. A linearised file's last trailer names the first cross-references instead.
        """
        begins, named = {}, {}
        for m in re.finditer(rb"startxref\s{1,8}(\d{1,10})\s{1,8}%%EOF", self.b):
            start = int(m[1])
            k = bisect_left(self.pdf_references, m.start())
            if start and k:
                begins[self.pdf_references[k - 1] - start] = m.end()
            named.setdefault(start, []).append(m.end())
        return begins, named

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """Where each archive ends, by where it begins: an end record tells the size and the offset of the directory before it."""
        ends = {}
        for m in re.finditer(rb"PK\x05\x06", self.b):
            end = m.start()
            size, start = u32(self.b, end + 12), u32(self.b, end + 16)
            tail = end + 22 + int.from_bytes(self.b[end + 20 : end + 22], "little")
            if end + 22 <= len(self.b) and tail <= len(self.b) and size and self.b[end - size : end - size + 4] == b"PK\x01\x02":
                ends[end - size - start] = tail
        return ends


def u32(b: bytes, i: int, order: str = "little") -> int:
    return int.from_bytes(b[i : i + 4], order) if i + 4 <= len(b) else -1


# Each validator gets the bytes and where the item would begin, and returns the length of the whole item, or 0.
def riff(body: Body, at: int) -> int:
    b = body.b
    size = u32(b, at + 4)
    end, i, seen = at + 8 + size, at + 12, set()
    if size < 4 or end > len(b):
        return 0
    need = {b"WAVE": {b"fmt ", b"data"}, b"AVI ": {b"LIST"}, b"WEBP": set()}.get(b[at + 8 : at + 12])
    if need is None:
        return 0
    while i + 8 <= end:
        n = u32(b, i + 4)
        if i + 8 + n > end:
            return 0
        seen.add(b[i : i + 4])
        i += 8 + n + (n & 1)
    return end - at if i >= end and seen and need <= seen else 0


def png(body: Body, at: int) -> int:
    b = body.b

    def chunk(i: int) -> tuple[int, int]:
        n = u32(b, i, "big")
        if n < 0 or i + 12 + n > len(b) or zlib.crc32(body.view[i + 4 : i + 8 + n]) != u32(b, i + 8 + n, "big"):
            return -1, 0
        return (-1, i + 12) if b[i + 4 : i + 8] == b"IEND" else (i + 12 + n, 0)

    end = body.follow("png", at + 8, chunk) if b[at + 12 : at + 16] == b"IHDR" else 0
    return max(0, end - at)


def gif(body: Body, at: int) -> int:
    b = body.b
    palette = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    parts = lambda i: (-1, 0) if i >= len(b) else (i + 1 + b[i], 0) if b[i] else (-1, i + 1)

    def block(i: int) -> tuple[int, int]:
        if i >= len(b):
            return -1, 0
        if b[i] == 0x3B:
            return -1, i + 1
        start = i + 11 + palette(b[i + 9]) if b[i] == 0x2C and i + 10 <= len(b) else i + 2 if b[i] == 0x21 else 0
        end = body.follow("gif parts", start, parts) if start else 0
        return (end, 0) if end else (-1, 0)

    end = body.follow("gif", at + 13 + palette(b[at + 10]), block) if at + 13 <= len(b) else 0
    return max(0, end - at)


def jpeg(body: Body, at: int) -> int:
    b = body.b

    def segment(state: int) -> tuple[int, int]:
        i, frame = state >> 1, state & 1
        if i + 4 > len(b) or b[i] != 0xFF:
            return -1, 0
        kind, n = b[i + 1], int.from_bytes(b[i + 2 : i + 4], "big")
        if not 0xC0 <= kind <= 0xFE or n < 2 or i + 2 + n > len(b):
            return -1, 0
        if kind == 0xDA:
            return -1, body.next(b"\xff\xd9", i + 2 + n) + 2 if frame and body.next(b"\xff\xd9", i + 2 + n) >= 0 else 0
        return (i + 2 + n) << 1 | frame | (0xC0 <= kind <= 0xC2), 0

    return max(0, body.follow("jpeg", (at + 2) << 1, segment) - at)


def bmp(body: Body, at: int) -> int:
    b = body.b
    size, start, head = u32(b, at + 2), u32(b, at + 10), u32(b, at + 14)
    return size if head in (12, 40, 108, 124) and 14 + head <= start <= size <= len(b) - at and b[at + 6 : at + 10] == bytes(4) else 0


def pdf(body: Body, at: int) -> int:
    """To the last trailer of its own; to the first one at all if none names cross-references."""
    if not re.match(rb"%PDF-[12]\.\d[\r\n]", body.b[at : at + 9]):
        return 0
    begins, named = body.pdf_trailers
    last = begins.get(at, 0)
    k = bisect_left(body.pdf_references, at)
    if k < len(body.pdf_references):
        ends = named.get(body.pdf_references[k] - at, [])
        n = bisect_right(ends, at)
        last = max(last, ends[n] if n < len(ends) else 0)
    if last > at:
        return last - at
    begin = body.next(b"startxref", at)
    end = body.next(b"%%EOF", begin) if begin >= 0 else -1
    return end + 5 - at if end >= 0 else 0


def gzip(body: Body, at: int) -> int:
    b = body.b
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    flags, i = b[at + 3], at + 10
    if flags & 4:
        i += 2 + int.from_bytes(b[i : i + 2], "little")
    for name in (8, 16):
        if flags & name:
            i = body.next(b"\0", i) + 1
            if not i:
                return 0
    i += flags & 2
    un, crc, size, step = zlib.decompressobj(-15), 0, 0, 512
    while not un.eof and i < len(b):
        data = body.view[i : i + step]
        i, step = i + len(data), 1 << 16
        while len(data) and not un.eof:
            try:
                out = un.decompress(data, 1 << 20)
            except zlib.error:
                return 0
            crc, size, data = zlib.crc32(out, crc), size + len(out), un.unconsumed_tail
    end = i - len(un.unused_data) + 8
    return end - at if un.eof and end <= len(b) and u32(b, end - 8) == crc and u32(b, end - 4) == size & 0xFFFFFFFF else 0


def zip_(body: Body, at: int) -> int:
    return max(0, body.zip_ends.get(at, 0) - at)


# Boxes that stand at the top of an ISO media file.
BOXES = {b"ftyp", b"moov", b"mdat", b"moof", b"free", b"skip", b"wide", b"udta", b"meta", b"uuid", b"mfra", b"sidx", b"styp", b"pdin", b"emsg", b"ssix", b"prft"}


def mp4(body: Body, at: int) -> int:
    """Boxes one after another, one of them the movie's (or, in a still picture, its metadata)."""
    b = body.b

    def box(i: int) -> tuple[int, int]:
        n = u32(b, i, "big")
        if b[i + 4 : i + 8] not in BOXES:
            return -1, i
        if n == 1:
            n = int.from_bytes(b[i + 8 : i + 16], "big") if i + 16 <= len(b) else 0
        n = len(b) - i if n == 0 and u32(b, i, "big") == 0 else n
        return (i + n, 0) if n >= 8 and i + n <= len(b) else (-1, 0)  # a box that is cut off

    end = body.follow("mp4", at, box)
    if end <= at or not any(at < body.next(kind, at) < end for kind in (b"moov", b"moof", b"meta")):
        return 0
    return end - at


REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def ogg(body: Body, at: int) -> int:
    """Pages one after another, each with its checksum right; the first begins a stream."""
    b = body.b

    def page(i: int) -> tuple[int, int]:
        if b[i : i + 5] != b"OggS\0" or i + 27 + (b[i + 26] if i + 27 <= len(b) else 1 << 30) > len(b):
            return -1, i
        head = 27 + b[i + 26]
        n = head + sum(b[i + 27 : i + head])
        if i + n > len(b):
            return -1, i
        whole = b[i : i + 22] + bytes(4) + b[i + 26 : i + n]
        # The checksum runs over bits the other way round than zlib's, without inversions.
        crc = zlib.crc32(whole.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
        return (i + n, 0) if int(f"{crc:032b}"[::-1], 2) == u32(b, i + 22) else (-1, i)

    return body.follow("ogg", at, page) - at if at + 6 <= len(b) and b[at + 5] & 2 else 0


def flac(body: Body, at: int) -> int:
    """Metadata blocks, the first that of the stream, and the mark of a frame; frames tell no length, so it runs to the end."""
    b, i, kind = body.b, at + 4, 0
    if b[at + 4 : at + 8] not in (b"\0\0\0\x22", b"\x80\0\0\x22"):
        return 0
    while i + 4 <= len(b) and not kind & 0x80:
        kind = b[i]
        i += 4 + int.from_bytes(b[i + 1 : i + 4], "big")
    return len(b) - at if kind & 0x80 and b[i : i + 1] == b"\xff" and b[i + 1 : i + 2] in (b"\xf8", b"\xf9") else 0


# Kilobits a second by code, in the two families of layer III, and samples a second.
MP3_RATES = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MP3_SAMPLES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Frames in a row that tell a stream from chance.
MP3_FRAMES = 3


def mp3(body: Body, at: int) -> int:
    """A tag, if there is one, and frames of layer III that follow each other."""
    b = body.b

    def frame(i: int) -> tuple[int, int]:
        if i + 4 > len(b) or b[i] != 0xFF or b[i + 1] & 0xE6 != 0xE2:
            return -1, i
        version, rate, sample = b[i + 1] >> 3 & 3, b[i + 2] >> 4, b[i + 2] >> 2 & 3
        if version == 1 or rate in (0, 15) or sample == 3:
            return -1, i
        n = (144 if version == 3 else 72) * 1000 * MP3_RATES[max(version, 2)][rate] // MP3_SAMPLES[version][sample] + (b[i + 2] >> 1 & 1)
        return (i + n, 0) if i + n <= len(b) else (-1, i)

    i = at
    if b[at : at + 3] == b"ID3":
        if at + 10 > len(b) or not 2 <= b[at + 3] <= 4 or any(x & 0x80 for x in b[at + 6 : at + 10]):
            return 0
        i += 10 + (b[at + 6] << 21 | b[at + 7] << 14 | b[at + 8] << 7 | b[at + 9]) + 10 * (b[at + 5] >> 4 & 1)
    j = i
    for _ in range(MP3_FRAMES):
        j = frame(j)[0]
        if j < 0:
            return 0
    end = body.follow("mp3", i, frame)
    return end + 128 * (b[end : end + 3] == b"TAG" and end + 128 <= len(b)) - at


# Bytes of each type of field.
TIFF_SIZES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)
#: Fields that say where strips or tiles lie, and those that say how long they are.
TIFF_DATA = {273: 279, 324: 325}


def tiff(body: Body, at: int) -> int:
    """Directories whose fields stand in order; the item ends with the last byte that any of them names."""
    b = body.b
    order = "little" if b[at] == 0x49 else "big"
    whole = lambda i, n: int.from_bytes(b[i : i + n], order)
    reach, place, seen, pixels = at + 8, whole(at + 4, 4), set(), False
    while place and place not in seen:
        seen.add(place)
        i = at + place
        count = whole(i, 2)
        end = i + 2 + 12 * count
        if place < 8 or not count or end + 4 > len(b):
            return 0
        last, fields = 0, {}
        for k in range(count):
            e = i + 2 + 12 * k
            tag, kind, n = whole(e, 2), whole(e + 2, 2), whole(e + 4, 4)
            if tag <= last or not 1 <= kind <= 12:
                return 0
            size, last = TIFF_SIZES[kind] * n, tag
            value = e + 8 if size <= 4 else at + whole(e + 8, 4)
            if value + size > len(b):
                return 0
            fields[tag] = kind, n, value
            reach = max(reach, value + size)
        for offsets, lengths in TIFF_DATA.items():
            if offsets in fields and lengths in fields:
                (ka, n, a), (kb, m, c) = fields[offsets], fields[lengths]
                for k in range(min(n, m)):
                    to = at + whole(a + k * TIFF_SIZES[ka], TIFF_SIZES[ka]) + whole(c + k * TIFF_SIZES[kb], TIFF_SIZES[kb])
                    if to > len(b):
                        return 0
                    reach, pixels = max(reach, to), True
        reach, place = max(reach, end + 4), whole(end, 4)
    return reach - at if pixels else 0


def ebml(body: Body, at: int) -> int:
    """A header that names the type, and a segment, which runs to the end if its size isn't said."""
    b = body.b

    def size(i: int) -> tuple[int, int]:
        n = 9 - b[i].bit_length() if i < len(b) and b[i] else 9
        if n > 8 or i + n > len(b):
            return -1, i
        value = int.from_bytes(b[i : i + n], "big") & (1 << 7 * n) - 1
        return (len(b) - i - n if value == (1 << 7 * n) - 1 else value), i + n

    n, i = size(at + 4)
    if n < 0 or not re.search(rb"\x42\x82[\x84\x88](?:webm|matroska)", b[i : i + min(n, 256)]) or b[i + n : i + n + 4] != b"\x18\x53\x80\x67":
        return 0
    n, i = size(i + n + 4)
    return i + n - at if 0 <= n <= len(b) - i else 0


# Magic bytes, how far before them the item begins, the type they stand for, and its validator.
FORMATS = [
    (b"RIFF", 0, "riff", riff),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", png),
    (b"GIF87a", 0, "image/gif", gif),
    (b"GIF89a", 0, "image/gif", gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", jpeg),
    (b"BM", 0, "image/bmp", bmp),
    (b"II*\0", 0, "image/tiff", tiff),
    (b"MM\0*", 0, "image/tiff", tiff),
    (b"%PDF-", 0, "application/pdf", pdf),
    (b"\x1f\x8b\x08", 0, "application/gzip", gzip),
    (b"PK\x03\x04", 0, "application/zip", zip_),
    (b"ftyp", 4, "iso", mp4),
    (b"OggS", 0, "application/ogg", ogg),
    (b"fLaC", 0, "audio/flac", flac),
    (b"ID3", 0, "audio/mpeg", mp3),
    (b"\xff\xfb", 0, "audio/mpeg", mp3),
    (b"\xff\xfa", 0, "audio/mpeg", mp3),
    (b"\xff\xf3", 0, "audio/mpeg", mp3),
    (b"\xff\xf2", 0, "audio/mpeg", mp3),
    (b"\x1a\x45\xdf\xa3", 0, "video/webm", ebml),
]
# Types that the bytes at 8 tell apart; other brands are video.
FORMS = {"riff": {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}, "iso": {b"M4A ": "audio/mp4", b"M4B ": "audio/mp4", b"qt  ": "video/quicktime", b"heic": "image/heic", b"mif1": "image/heif", b"avif": "image/avif"}}


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for k, (magic, *_) in enumerate(FORMATS):
            self.machine.add_word(magic.decode("latin-1"), k)
        self.machine.make_automaton()

    def __call__(self, b: bytes) -> list[tuple[int, int, str]]:
        """Valid items as (offset, length, type): the one at 0, then those inside it or after it that don't overlap."""
        whole, inner, reach, body = None, [], 0, Body(b)
        for end, k in self.machine.iter(b.decode("latin-1")):
            magic, back, kind, valid = FORMATS[k]
            at = end + 1 - len(magic) - back
            if at < reach:
                continue  # inside an item that has been carved
            if n := valid(body, at):
                item = (at, n, FORMS[kind].get(b[at + 8 : at + 12], "video/mp4") if kind in FORMS else kind)
                if at == 0:
                    whole = item
                else:
                    inner.append(item)
                    reach = at + n
        return [*([whole] if whole else []), *inner]


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def to_wav(payload: bytes) -> bytes:
    """Mono samples of 8 bits, one for each byte."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    odd = bytes(len(payload) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload) + len(odd), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + odd


def from_wav(media: bytes) -> bytes:
    i = 12
    while i + 8 <= len(media):
        n = u32(media, i + 4)
        if media[i : i + 4] == b"data":
            return media[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a media column: doc_id, n_bytes, declared_type, media. Null and empty texts are one block of zeros."""

    def start() -> Callable[..., tuple]:
        def one(key, text):
            n, payload = padded(text)
            return key, n, "application/octet-stream", to_wav(payload)

        return one

    return map_rows(docs, [F.col(id_col).cast("long"), F.col(text_col)], "doc_id long, n_bytes long, declared_type string, media binary", start, rows=128)


def sniffed(media: DataFrame, media_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """Adds detected_type, detected_bytes, corrected_type and carved items to any table of media.

    A null or empty media, or one that no validator confirms, has a null detected type, keeps its declared type and
    carves what stands inside. All input columns stay; a clashing name is replaced.
    """
    arrow_batches(media.sparkSession, 128)
    new = "detected_type string, detected_bytes long, corrected_type string, carved array<struct<offset:long,length:long,type:string>>"
    names = {f.split()[0] for f in ("detected_type", "detected_bytes", "corrected_type", "carved")}
    base = media.select(*[c for c in media.columns if c not in names])
    schema = arrow_schema(media.sparkSession, base._jdf.schema().toDDL() + ", " + new)

    def run(batches):
        sniff = Sniffer()
        for batch in batches:
            out = []
            for b, declared in zip(batch.column(batch.schema.get_field_index(media_col)).to_pylist(), batch.column(batch.schema.get_field_index(declared_col)).to_pylist(), strict=True):
                items = sniff(b or b"")
                size, found = items[0][1:] if items and items[0][0] == 0 else (0, None)
                out.append((found, size, found or declared, [{"offset": a, "length": n, "type": t} for a, n, t in items if a]))
            if out:
                cols = [pa.array(c, type=schema.field(batch.num_columns + k).type) for k, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=schema)

    return base.mapInArrow(run, base._jdf.schema().toDDL() + ", " + new)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as 8-bit samples, sniffs the stored bytes, reads them back and describes them.

    Null and empty texts are 64 zero bytes; a null id stays null; repeated rows each get their row; an empty table gives
    no rows; other columns are ignored; equal texts have equal values. The feature names the corrected type, its validated
    length, and what is carved from inside. No shuffle.
    """

    def start() -> Callable[..., tuple]:
        def one(key, n, media, declared, kind, size, carved):
            back = from_wav(media)
            inner = ";".join(f"{x['type']}@{x['offset']}+{x['length']}" for x in carved)
            return key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), f"{kind}:{size}:{inner}", declared, kind

        return one

    rows = sniffed(store_texts(docs, id_col, text_col))
    return map_rows(rows, [F.col(c) for c in ("doc_id", "n_bytes", "media", "declared_type", "corrected_type", "detected_bytes", "carved")], SCHEMA, start, rows=128)
