"""Pages of PDF files: a table function over binary files, and a writer for files of text pages.

The reader walks a file as its format says: from the offset at its end to the
cross-reference table (and those it was updated from), from the trailer to the
catalog, from there down the tree of pages.  Only plain tables and streams that
are uncompressed, deflated or hexadecimal are read; a file that is damaged or of
another kind has no pages.  A page's text is what its content stream shows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "page int, pages int, size long, text string"
_REF = rb"(\d+)\s+\d+\s+R"


def references(data: bytes) -> tuple[dict[int, int], bytes]:
    """(offset of each object, newest trailer), following updates back to the first table."""
    at = int(re.findall(rb"startxref\s+(\d+)", data)[-1])
    found, newest, seen = {}, b"", set()
    while at not in seen:
        seen.add(at)
        if data[at : at + 4] != b"xref":
            raise ValueError("no cross-reference table")
        end = data.index(b"trailer", at)
        rows = data[at + 4 : end].split()
        i = 0
        while i < len(rows):
            first, count = int(rows[i]), int(rows[i + 1])
            for k in range(count):
                offset, _, kind = rows[i + 2 + 3 * k : i + 5 + 3 * k]
                if kind == b"n":
                    found.setdefault(first + k, int(offset))
            i += 2 + 3 * count
        trailer = data[end : data.index(b"startxref", end)]
        newest = newest or trailer
        before = re.search(rb"/Prev\s+(\d+)", trailer)
        if before:
            at = int(before[1])
    return found, newest


def body(data: bytes, offsets: dict[int, int], number: int) -> bytes:
    at = offsets[number]
    head = re.match(rb"\s*(\d+)\s+\d+\s+obj", data[at : at + 40])
    if not head or int(head[1]) != number:
        raise ValueError("an offset misses its object")
    stream = data.find(b"stream", at)
    end = data.index(b"endobj", at)
    if 0 <= stream < end:
        size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", data[at:stream])
        if size:
            end = data.index(b"endobj", stream + int(size[1]))
    return data[at + head.end() : end]


def stream(raw: bytes) -> bytes:
    """The content of a stream object."""
    head, _, rest = raw.partition(b"stream")
    rest = rest[2:] if rest[:2] == b"\r\n" else rest[1:]
    size = re.search(rb"/Length\s+(\d+)", head)
    rest = rest[: int(size[1])] if size else rest.rpartition(b"endstream")[0]
    for f in re.findall(rb"/(FlateDecode|ASCIIHexDecode)", head):
        rest = zlib.decompress(rest) if f == b"FlateDecode" else bytes.fromhex(rest.split(b">")[0].decode())
    return rest


def shown(content: bytes) -> str:
    """The strings that a content stream shows, a line for each."""
    out = []
    for text, hexa in re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj|<([0-9A-Fa-f\s]*)>\s*Tj", content, re.S):
        raw = bytes.fromhex(hexa.decode()) if hexa else re.sub(rb"\\([()\\])", rb"\1", text)
        out.append(raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1"))
    return "\n".join(out)


def pages(data: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(page, pages, size of its content, text) in order, from 1; nothing for a file that can't be read."""
    try:
        if not data.startswith(b"%PDF-"):
            return
        offsets, trailer = references(data)
        get = lambda n: body(data, offsets, int(n))
        root = get(re.search(rb"/Root\s+" + _REF, trailer)[1])
        todo, leaves, seen = [int(re.search(rb"/Pages\s+" + _REF, root)[1])], [], set()
        while todo:
            number = todo.pop()
            if number in seen:
                raise ValueError("the tree of pages has a circle")
            seen.add(number)
            node = get(number)
            kids = re.search(rb"/Kids\s*\[(.*?)\]", node, re.S)
            if kids:
                todo += [int(k) for k in reversed(re.findall(_REF, kids[1]))]
            else:
                leaves.append(node)
        made = []
        for node in leaves:
            listed = re.search(rb"/Contents\s*(?:\[(.*?)\]|" + _REF + rb")", node, re.S)
            own = re.findall(_REF, listed[1]) if listed and listed[1] is not None else [listed[2]] if listed else []
            content = b"\n".join(stream(get(n)) for n in own)
            made.append((len(content), shown(content)))
    except (ValueError, IndexError, KeyError, TypeError, AttributeError, zlib.error):
        return
    for i, (size, text) in enumerate(made):
        yield i + 1, len(made), size, text


class Pages:
    """Table function: a row for each page of one file."""

    def eval(self, content: bytes) -> Iterator[tuple[int, int, int, str]]:
        if content is not None:
            yield from pages(bytes(content))


def split(files: DataFrame, content: str = "content") -> DataFrame:
    """files with a row for each page: page, pages, size and text in place of the content."""
    function = F.udtf(Pages, returnType=PAGE, useArrow=True)
    others = [c for c in files.columns if c != content]
    return files.lateralJoin(function(F.col(content).outer())).select(*others, "page", "pages", "size", "text")


def read(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, page, pages, size, text) of the PDF files of a folder tree."""
    return split(spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup="true").load(path).select("path", "content"))


def written(texts: list[str]) -> str:
    """A PDF file, all in ASCII, with a page for each text."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(texts)} /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(texts)))}] >>"]
    for i, text in enumerate(texts):
        content = f"BT /F1 12 Tf <FEFF{(text or '').encode('utf-16-be').hex().upper()}> Tj ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>", f"<< /Length {len(content)} >>\nstream\n{content}\nendstream"]
    out, at, offsets = ["%PDF-1.4\n"], 9, []
    for n, o in enumerate(objects, 1):
        offsets.append(at)
        out.append(f"{n} 0 obj\n{o}\nendobj\n")
        at += len(out[-1])
    table = "".join(f"{x:010d} 00000 n \n" for x in offsets)
    out.append(f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{at}\n%%EOF")
    return "".join(out)


def bundled(texts: Column) -> Column:
    """A PDF file of an array of texts."""

    @F.udf("string", useArrow=True)
    def run(listed):
        return written(list(listed))

    return run(texts)
