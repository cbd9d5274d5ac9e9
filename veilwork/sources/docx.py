"""Word documents as rows of paragraphs, masked by Spark and written back.

Only unpacking and repacking the archive is Python, one file at a time and of a
checked size; detection and masking are column expressions over the rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lets import is_blank, let
from ..operators.mask import anonymize

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARTS = re.compile(r"word/(document|header\d*|footer\d*)\.xml")
# The core properties that name people or contents.
PROPERTIES = ("creator", "lastModifiedBy", "title", "subject", "description", "keywords", "category", "contentStatus", "identifier", "version")


#: Bytes that all parts of an archive may have when unpacked.
MAX_UNPACKED = 200 * 1024 * 1024


class TooLarge(ValueError):
    """An archive that unpacks to more than is allowed."""


def _opened(content: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(content))
    if sum(i.file_size for i in z.infolist()) > MAX_UNPACKED:
        raise TooLarge("too large when unpacked")
    return z


def _read(z: zipfile.ZipFile, name: str) -> bytes:
    """A part, of no more bytes than its entry tells."""
    with z.open(name) as f:
        data = f.read(z.getinfo(name).file_size + 1)
    if len(data) > z.getinfo(name).file_size:
        raise TooLarge("a part is larger than it tells")
    return data


def _written(root: ET.Element, source: bytes) -> bytes:
    """XML with the namespace prefixes of ``source``, all declared at the root: some are named in attributes only."""
    names = {}
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(source), events=["start-ns"]):
        names.setdefault(prefix, uri)
    for prefix, uri in names.items():
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    out = ET.tostring(root, encoding="unicode")
    head = re.match(r"<[^\s/>]+", out)
    missing = "".join(f' xmlns{":" * bool(p)}{p}="{u}"' for p, u in names.items() if f'xmlns{":" * bool(p)}{p}="' not in out[: out.index(">")] and p)
    return ("<?xml version='1.0' encoding='UTF-8' standalone='yes'?>\n" + out[: head.end()] + missing + out[head.end() :]).encode()


def _walk(node: ET.Element, at: tuple = (None, None, None)) -> Iterator[tuple[ET.Element, tuple]]:
    """Paragraphs in order, each with its innermost table, row and cell."""
    tables = 0
    for child in node:
        if child.tag == W + "p":
            yield child, at
        elif child.tag == W + "tbl":
            name = f"{at[0] or ''}/{at[1] or 0}.{at[2] or 0}/{tables}"
            tables += 1
            for r, row in enumerate(child.findall(W + "tr")):
                for c, cell in enumerate(row.findall(W + "tc")):
                    yield from _walk(cell, (name, r, c))
        else:
            yield from _walk(child, at)


def _parts(content: bytes) -> Iterator[tuple[str, ET.Element]]:
    with _opened(content) as z:
        for name in z.namelist():
            if PARTS.fullmatch(name):
                yield name, ET.fromstring(_read(z, name))


def _runs(paragraph: ET.Element) -> list[ET.Element]:
    return [t for t in paragraph.iter(W + "t")]


def read_paragraphs(files: DataFrame) -> DataFrame:
    """``path, content`` to ``path, part, para, tbl, row, cell, text``; a broken file gives no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                rows = []
                try:
                    for part, root in _parts(content):
                        for i, (p, (table, row, cell)) in enumerate(_walk(root)):
                            rows.append((path, part, i, table, row, cell, "".join(t.text or "" for t in _runs(p))))
                except (zipfile.BadZipFile, ET.ParseError, TooLarge):
                    continue
                yield pd.DataFrame(rows, columns=["path", "part", "para", "tbl", "row", "cell", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, part string, para int, tbl string, row int, cell int, text string")


def replaced(text: Column, values: Column) -> Column:
    """``text`` with each ``(value, placeholder)`` replaced, the longest value first."""
    ordered = F.array_sort(F.transform(values, lambda v: F.struct((-F.length(v["value"])).alias("n"), v["value"].alias("v"), v["key"].alias("k"))))
    return F.aggregate(ordered, text, lambda acc, v: F.replace(acc, v["v"], v["k"]))


def mask_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Masked paragraphs: ``path, part, para, masked, n``.

    A paragraph outside tables is masked by itself.  In a table the cells of a
    row are read as one text, so a label in one cell explains the value in the
    next; what is found there is replaced in each cell, and ``n`` is the row's.
    """
    free = paragraphs.filter("tbl is null").select("path", "part", "para", F.when(~is_blank(F.col("text")), anonymize(F.col("text"))).alias("r"))
    free = free.select("path", "part", "para", F.col("r.anonymized").alias("masked"), F.coalesce(F.size("r.entities_found"), F.lit(0)).alias("n"))
    place = ["path", "part", "tbl", "row"]
    in_cell = F.struct("cell", "para", "text")
    filled = paragraphs.filter(F.col("tbl").isNotNull() & ~is_blank(F.col("text")))
    rows = filled.groupBy(*place).agg(F.array_sort(F.collect_list(in_cell)).alias("cells"))
    rows = rows.withColumn("r", anonymize(F.array_join(F.transform("cells", lambda c: c["text"]), " ")))
    # of equal values, the last placeholder stands
    last = lambda e: F.reverse(F.map_entries(e))
    seen = lambda acc, e: F.when(F.exists(acc, lambda x: x["value"] == e["value"]), acc).otherwise(F.concat(acc, F.array(e)))
    values = let(F.col("r.mapping"), lambda m: F.aggregate(last(m), F.array().cast("array<struct<key:string,value:string>>"), seen))
    rows = rows.withColumn("values", values)
    cells = rows.select("path", "part", F.size("values").alias("n"), F.explode(F.transform("cells", lambda c: F.struct(c["para"].alias("para"), replaced(c["text"], F.col("values")).alias("masked")))).alias("c"))
    counted = cells.select("path", "part", "c.para", "c.masked", "n")
    return free.filter("masked is not null").unionByName(counted)


def _edited(content: bytes, edits: dict[tuple[str, int], str]) -> bytes:
    out = io.BytesIO()
    with _opened(content) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
        for name in src.namelist():
            data = _read(src, name)
            if PARTS.fullmatch(name):
                source, root = data, ET.fromstring(data)
                for i, (p, _) in enumerate(list(_walk(root))):
                    runs, text = _runs(p), edits.get((name, i))
                    if runs and text is not None:
                        for k, t in enumerate(runs):
                            t.text = text if k == 0 else ""
                for parent in root.iter():  # deleted text is still in the file
                    for child in [c for c in parent if c.tag == W + "del"]:
                        parent.remove(child)
                data = _written(root, source)
            elif name == "docProps/core.xml":
                root = ET.fromstring(data)
                for e in root:
                    if e.tag.rpartition("}")[2] in PROPERTIES:
                        e.text = ""
                data = _written(root, data)
            dst.writestr(name, data)
    return out.getvalue()


def write_back(files: DataFrame, masked: DataFrame) -> DataFrame:
    """``path, out_name, content`` of the masked documents, and what a reader should look at.

    ``tracked_insertions`` and ``comments`` tell of text that stays in the file;
    ``summary`` is JSON of counts and warnings, without any value.
    """
    edits = masked.groupBy("path").agg(F.collect_list(F.struct("part", "para", "masked")).alias("edits"), F.sum("n").alias("entities"), F.count("*").alias("paragraphs"))
    joined = files.select("path", "content").join(edits.drop("entities", "paragraphs"), "path", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content, own in zip(f["path"], f["content"], f["edits"], strict=True):
                todo = {(e["part"], e["para"]): e["masked"] for e in (own if own is not None else [])}
                try:
                    done = _edited(content, todo)
                    with _opened(content) as z:
                        inserted, noted = b"<w:ins " in _read(z, "word/document.xml"), "word/comments.xml" in z.namelist()
                except (zipfile.BadZipFile, ET.ParseError, KeyError, TooLarge):
                    done, inserted, noted = None, None, None
                rows.append((path, "anonymized_" + path.rpartition("/")[2], done, inserted, noted))
            yield pd.DataFrame(rows, columns=["path", "out_name", "content", "tracked_insertions", "comments"])

    done = joined.mapInPandas(run, "path string, out_name string, content binary, tracked_insertions boolean, comments boolean")
    counts = edits.select("path", "entities", "paragraphs")
    summary = F.struct(F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), "tracked_insertions", "comments")
    return done.join(counts, "path", "left").withColumn("summary", F.when(F.col("content").isNotNull(), F.to_json(summary))).drop("entities", "paragraphs")
