"""TIFF columns: store bytes as grey images of 8-bit samples, and read the pages of TIFF files.

The reader follows the TIFF 6.0 specification: it walks the chain of image directories in either byte order, decodes
uncompressed, PackBits, LZW and deflate strips or tiles, undoes horizontal differencing, and gives one row for each page.

Defined results: null bytes have no pages. `read_tiff` raises ValueError for a file that is not a TIFF, is cut short, or
lacks strips; the columns of `with_pages` say so in `fault` and have no pages then, so one broken file stops nothing. Null
text is stored like empty text, as 64 zero bytes; texts of any length are cut into pages of PAGE_ROWS rows. Equal payloads
have equal files, repeated rows too. A payload of megabytes is one cell and one file of many pages. Other columns are kept, but for `pages` and `fault`, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices

# fixed values of the format
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
_CLEAR, _END = 256, 257

WIDTH = 64
#: Rows in a page, in a strip and in a tile.
PAGE_ROWS, STRIP_ROWS, TILE = 256, 64, 64
_RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits(row: bytes) -> bytes:
    """One row in PackBits."""
    out, at = bytearray(), 0
    for run in _RUNS.finditer(row):
        for i in range(at, run.start(), 128):
            part = row[i : min(i + 128, run.start())]
            out.append(len(part) - 1)
            out += part
        out.append(257 - (run.end() - run.start()))
        out += run[1]
        at = run.end()
    for i in range(at, len(row), 128):
        part = row[i : i + 128]
        out.append(len(part) - 1)
        out += part
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the high bit on, and a code is a bit longer one code early."""
    table = {bytes([i]): i for i in range(256)}
    first = dict(table)
    bits, n, out = _CLEAR, 9, bytearray()
    width, size = 9, 258
    word = b""

    def put(code: int) -> None:
        nonlocal bits, n
        bits = (bits << width) | code
        n += width
        while n >= 8:
            n -= 8
            out.append((bits >> n) & 255)
        bits &= (1 << n) - 1

    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size == 4095:
            put(_CLEAR)
            table, width, size = dict(first), 9, 258
        elif size > (1 << width) - 1 and width < 12:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        size += 1
        if size > (1 << width) - 1 and width < 12:
            width += 1
    put(_END)
    if n:
        out.append((bits << (8 - n)) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, bits, n, out, done, last = list(first), 9, 0, 0, [], 0, None
    for byte in data:
        bits = ((bits << 8) | byte) & 0xFFFFFFFF
        n += 8
        if n < width:
            continue
        n -= width
        code = (bits >> n) & ((1 << width) - 1)
        if code == _CLEAR:
            table, width, last = list(first), 9, None
            continue
        if code == _END or done >= size:
            break
        if last is None:
            word = table[code]
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = last + last[:1]
            else:
                raise ValueError("broken LZW data")
            table.append(last + word[:1])
            if len(table) + 1 > (1 << width) - 1 and width < 12:
                width += 1
        out.append(word)
        done += len(word)
        last = word
    return b"".join(out)


def _squeeze(block: np.ndarray, codec: int) -> bytes:
    if codec == PACKBITS:
        return b"".join(packbits(row.tobytes()) for row in block)
    raw = block.tobytes()
    return lzw(raw) if codec == LZW else zlib.compress(raw, 1) if codec in (DEFLATE, OLD_DEFLATE) else raw


def write_tiff(samples: bytes, codec: int, predictor: int = 1, tiles: bool = False, page_rows: int = PAGE_ROWS) -> bytes:
    """Pages of 8-bit grey samples, WIDTH in a row; the number of samples is a multiple of WIDTH."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        step = TILE if tiles else min(STRIP_ROWS, len(page))
        where, sizes = [], []
        for y in range(0, len(page), step):
            block = page[y : y + step]
            if tiles and len(block) < TILE:
                block = np.vstack([block, np.zeros((TILE - len(block), WIDTH), np.uint8)])
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            packed = _squeeze(block, codec)
            out += b"\0" * (len(out) % 2)
            where.append(len(out))
            sizes.append(len(packed))
            out += packed
        tags = {256: (4, [WIDTH]), 257: (4, [len(page)]), 258: (3, [8]), 259: (3, [codec]), 262: (3, [1]), 277: (3, [1]), 317: (3, [predictor])}
        tags |= {322: (4, [WIDTH]), 323: (4, [TILE]), 324: (4, where), 325: (4, sizes)} if tiles else {273: (4, where), 278: (4, [step]), 279: (4, sizes)}
        body = {}
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                body[tag] = struct.pack("<HHII", tag, kind, len(values), len(out))
                out += raw
            else:
                body[tag] = struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(body)) + b"".join(body.values())
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes


def _directory(file: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(f"{order}H", file, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", file, at + 2 + 12 * i)
        if kind not in _TYPES:
            continue
        form = f"{order}{count}{_TYPES[kind]}"
        place = at + 10 + 12 * i
        if struct.calcsize(form) > 4:
            (place,) = struct.unpack_from(f"{order}I", file, place)
        tags[tag] = struct.unpack_from(form, file, place)
    return tags, struct.unpack_from(f"{order}I", file, at + 2 + 12 * n)[0]


def read_tiff(file: bytes) -> list[Page]:
    """The pages of a TIFF file, with their samples in rows from the top, 16-bit ones in the machine's order."""
    order = {b"II": "<", b"MM": ">"}.get(file[:2])
    try:
        if order is None or struct.unpack_from(f"{order}H", file, 2)[0] != 42:
            raise ValueError("not a TIFF file")
        (at,) = struct.unpack_from(f"{order}I", file, 4)
        pages, seen = [], set()
        while at and at not in seen:
            seen.add(at)
            tags, at = _directory(file, order, at)
            pages.append(_page(file, order, tags))
    except (struct.error, zlib.error, IndexError) as broken:
        raise ValueError(f"cut TIFF file: {broken}") from None
    return pages


def _page(file: bytes, order: str, tags: dict[int, tuple]) -> Page:
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, bits, samples = one(256, 0), one(257, 0), one(258, 1), one(277, 1)
    codec, predictor, tiled = one(259, NONE), one(317, 1), 322 in tags
    if bits not in (8, 16) or one(284, 1) != 1:
        raise ValueError("only 8- and 16-bit samples that stand together are read")
    if width < 1 or height < 1 or samples < 1:
        raise ValueError("a page without samples")
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(f"{order}u2")
    across, down = (one(322, width), one(323, height)) if tiled else (width, min(one(278, height), height))
    image = np.zeros((height, width, samples), np.uint8 if bits == 8 else np.uint16)
    if across < 1 or down < 1:
        raise ValueError("strips or tiles without samples")
    per_row = -(-width // across)
    where, sizes = tags.get(324 if tiled else 273, ()), tags.get(325 if tiled else 279, ())
    if min(len(where), len(sizes)) < per_row * -(-height // down):
        raise ValueError("strips or tiles are missing")
    for i, (start, size) in enumerate(zip(where[: per_row * -(-height // down)], sizes)):
        y, x = i // per_row * down, i % per_row * across
        rows = down if tiled else min(down, height - y)
        want = rows * across * samples * kind.itemsize
        raw = file[start : start + size]
        if codec == PACKBITS:
            raw = unpackbits(raw, want)
        elif codec == LZW:
            raw = unlzw(raw, want)
        elif codec in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif codec != NONE:
            raise ValueError(f"compression {codec} is not read")
        if len(raw) < want:
            raise ValueError("cut TIFF data")
        block = np.frombuffer(raw[:want], kind).reshape(rows, across, samples).astype(image.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not undone")
        image[y : y + rows, x : x + across] = block[: height - y, : width - x]
    return Page(width, height, bits, samples, codec, predictor, tiled, image.tobytes())


def store(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as a TIFF file; codec, predictor and layout follow from its checksum."""
    pick = zlib.crc32(payload)
    return write_tiff(payload, (LZW, PACKBITS, DEFLATE)[pick % 3], 1 + (pick >> 4) % 2, bool((pick >> 5) % 2))


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def store_text(docs: DataFrame, column: str = "text", out: str = "media") -> DataFrame:
    """doc_id, n_bytes and a TIFF file of each text's UTF-8 bytes, padded with zeros to a positive multiple of 64."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(parts):
            raws = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in part[column]]
            files = [store(r + b"\0" * (-len(r) % WIDTH if r else WIDTH)) for r in raws]
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_bytes": [len(r) for r in raws], out: files})

    # ids pass Python as text, since pandas has no whole numbers with nulls
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), column)
    return rows.mapInPandas(run, f"doc_id string, n_bytes long, {out} binary").withColumn("doc_id", F.col("doc_id").cast("long"))


_PAGES = "array<struct<page:int,width:int,height:int,bits:int,samples:int,compression:int,predictor:int,tiled:boolean,mean:double,data:binary>>"


def with_pages(files: DataFrame, column: str = "media") -> DataFrame:
    """files with an array `pages` of each file's pages, and `fault`, what is wrong with a file that cannot be read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(parts):
            pages, faults = [], []
            for file in part[column]:
                found, fault = [], None
                try:
                    found = read_tiff(bytes(file)) if file is not None else []
                except ValueError as broken:
                    fault = str(broken)
                pages.append([dict(vars(p), page=i, mean=float(np.frombuffer(p.data, np.uint8 if p.bits == 8 else np.uint16).mean())) for i, p in enumerate(found)])
                faults.append(fault)
            yield part.assign(pages=pages, fault=faults)

    files = files.drop("pages", "fault")
    return files.mapInPandas(run, f"{_columns(files)}, pages {_PAGES}, fault string")


def tiff_pages(files: DataFrame, column: str = "media") -> DataFrame:
    """One row for each page: the other columns of files, then the page's number, size, coding and samples."""
    return with_pages(files, column).drop(column).withColumn("p", F.explode("pages")).select("*", "p.*").drop("pages", "p", "fault")


def text_media(docs: DataFrame) -> DataFrame:
    """Store each text as TIFF, read the file back, and describe what was read."""
    # several pages are joined in one go, as hexadecimal text
    several = F.unhex(F.array_join(F.transform("pages", lambda p: F.hex(p["data"])), ""))
    payload = F.when(F.size("pages") == 1, F.col("pages")[0]["data"]).otherwise(several)
    read = with_pages(store_text(docs).withColumn("doc_id", F.col("doc_id").cast("string"))).withColumn("payload", payload)
    shape = F.transform("pages", lambda p: F.format_string("%dx%d:c%d:p%d:%s:%.4f", p["width"], p["height"], p["compression"], p["predictor"], F.when(p["tiled"], "tiles").otherwise("strips"), p["mean"]))
    return read.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.array_join(shape, ";").alias("feature"), F.size("pages").alias("n_pages"),
    )
