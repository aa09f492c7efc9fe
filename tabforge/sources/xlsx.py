"""XLSX by the standard library: a preflight that refuses unsafe workbooks, sheet selection, and rows as raw text."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

from tabforge.schema import MAX_COLUMNS, ROW_ID, EngineError

#: Limits of a workbook.
LIMITS = {"members": 4096, "total_bytes": 16 << 30, "member_bytes": 8 << 30, "ratio": 100, "sheets": 64, "rows": 1_048_576, "columns": MAX_COLUMNS, "cells": 75_000_000, "shared_string_bytes": 512 << 20}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _unsafe(why: str) -> EngineError:
    return EngineError("XLSX_UNSAFE", why)


@dataclass(frozen=True)
class Sheet:
    name: str
    member: str
    hidden: bool


def preflight(data: bytes, limits: dict[str, int] = LIMITS) -> list[Sheet]:
    """The sheets of a workbook that is safe to read: within limits, no odd paths, no encryption, macros, external links,
    formulas or document types."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise EngineError("INPUT_FORMAT_UNSUPPORTED", "not a workbook") from None
    members = z.infolist()
    names = [m.filename for m in members]
    if len(members) > limits["members"] or sum(m.file_size for m in members) > limits["total_bytes"]:
        raise _unsafe("too many or too large members")
    if len({n.lower() for n in names}) < len(names):
        raise _unsafe("member names repeat")
    for m in members:
        if m.flag_bits & 1:
            raise _unsafe("encrypted")
        if m.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", m.filename) or ":" in m.filename:
            raise _unsafe("a member leaves the archive")
        if m.file_size > limits["member_bytes"] or m.file_size > limits["ratio"] * max(1, m.compress_size) and m.file_size > 1 << 20:
            raise _unsafe("a member is too large for its packed size")
        low = m.filename.lower()
        if "vbaproject" in low or low.endswith(".bin") and "printersettings" not in low:
            raise _unsafe("macros")
        if low.startswith("xl/externallinks/") or low.startswith("xl/embeddings/"):
            raise _unsafe("external links")
        if low.endswith((".xml", ".rels")):
            with z.open(m) as f:
                head = f.read(4096).upper()
            if b"<!DOCTYPE" in head or b"<!ENTITY" in head:
                raise _unsafe("document type declarations")
        if low.endswith(".rels") and b'TargetMode="External"' in z.read(m):
            raise _unsafe("external links")
    if "xl/workbook.xml" not in names or "[Content_Types].xml" not in names:
        raise EngineError("INPUT_FORMAT_UNSUPPORTED", "not a workbook")
    if "xl/sharedStrings.xml" in names and z.getinfo("xl/sharedStrings.xml").file_size > limits["shared_string_bytes"]:
        raise _unsafe("too many shared strings")
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[s.get(f"{_REL}id")]
        member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        out.append(Sheet(s.get("name"), member, s.get("state", "visible") != "visible"))
    if not 0 < len(out) <= limits["sheets"]:
        raise _unsafe("no or too many sheets")
    return out


def select(sheets: list[Sheet], name: str | None) -> Sheet:
    """Exactly one sheet: the named one, or the only one."""
    found = [s for s in sheets if s.name == name] if name is not None else sheets
    if len(found) != 1:
        raise EngineError("INPUT_FORMAT_UNSUPPORTED", "choose one sheet", sheets=[s.name for s in sheets])
    return found[0]


def raw_text(value) -> str | None:
    """How a cell value is written as raw text."""
    if value is None or value == "":
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, dt.date | dt.time):
        return value.isoformat()
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise EngineError("INPUT_FORMAT_UNSUPPORTED", "a number is not finite")
        return str(int(value)) if value.is_integer() and abs(value) < 1 << 53 else repr(value)
    return str(value)


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower())}
    xfs = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(xfs if xfs is not None else []) if int(x.get("numFmtId", 0)) in own | _DATE_FORMATS}


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def rows(data: bytes, sheet: Sheet, limits: dict[str, int] = LIMITS) -> Iterator[list[str | None]]:
    """The rows of a sheet as raw text, read one at a time."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared, dates, n, cells = _shared(z), _date_styles(z), 0, 0
    with z.open(sheet.member) as f:
        for _, row in ET.iterparse(f):
            if row.tag != f"{_MAIN}row":
                continue
            out: list[str | None] = []
            for i, c in enumerate(row.findall(f"{_MAIN}c")):
                if c.find(f"{_MAIN}f") is not None:
                    raise _unsafe("formulas")
                at = _column(c.get("r")) if c.get("r") else i
                kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
                text = v.text if v is not None else None
                if kind == "s":
                    value = shared[int(text)] if text else None
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif kind == "b":
                    value = text == "1"
                elif kind == "n" and text is not None and int(c.get("s", 0)) in dates:
                    moment = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(float(text) * 86400))
                    value = moment.date() if float(text).is_integer() else moment
                elif kind == "n" and text is not None:
                    value = float(text)
                else:
                    value = text
                out += [None] * (at + 1 - len(out))
                out[at] = raw_text(value)
            n, cells = n + 1, cells + len(out)
            if n > limits["rows"] or len(out) > limits["columns"] or cells > limits["cells"]:
                raise _unsafe("the sheet is too large")
            yield out
            row.clear()


def read_raw(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The raw table of one sheet: row ids by position, all columns nullable text; the first row names them."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    chosen = select(preflight(data), sheet)
    names = [n or "" for n in next(rows(data, chosen), [])]
    if not names or "" in names or len(set(names)) < len(names) or ROW_ID in names:
        raise EngineError("SCHEMA_INVALID", "the header is empty, repeats a name or uses a reserved one", names=names)

    def make(frames):
        import pandas as pd

        for pdf in frames:
            for content in pdf["content"]:
                held: list = []
                for i, r in enumerate(rows(bytes(content), chosen)):
                    if i:
                        held.append([i - 1, *(r + [None] * len(names))[: len(names)]])
                    if len(held) == 65_536:
                        yield pd.DataFrame(held, columns=[ROW_ID, *names])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=[ROW_ID, *names])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(make, ", ".join([f"`{ROW_ID}` long", *(f"`{n}` string" for n in names)]))
