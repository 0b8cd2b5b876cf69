"""Markdown documents to atoms: leaf blocks as byte-exact slices of whole lines, with a path through their containers.

A block scanner for the block structure of CommonMark, written as a recursion over numbered lines: each container (list, item,
quote) strips its own marker and scans what is left. Leaves keep the numbers of their first and last source line, so an atom's
text is always a slice of the source, markers and all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusforge.functions.text import norm_key_full
from corpusforge.operators.merge import detected_kind

LETTERS = {"heading": "h", "paragraph": "p", "fence": "c", "code_block": "c", "html_block": "x", "hr": "r"}
_FENCE = re.compile(r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]|$)")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
_QUOTE = re.compile(r"^ {0,3}> ?")
_ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|$)")
_HTML = re.compile(r"^ {0,3}<(?:!--|\?|![A-Z]|/?(?:address|article|aside|blockquote|body|center|details|dialog|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|nav|ol|option|p|param|pre|script|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul)(?:[\s/>]|$))", re.I)


def _blank(text: str) -> bool:
    return not text.strip()


def _opens_block(text: str) -> bool:
    """Whether a line ends a paragraph before it by opening something else."""
    item = _ITEM.match(text)
    listed = bool(item) and not _blank(text[item.end() :]) and (item[2] in "-*+" or item[2][:-1] == "1")
    return bool(_FENCE.match(text) or _ATX.match(text) or _RULE.match(text) or _QUOTE.match(text) or _HTML.match(text)) or listed


def scan_blocks(lines: list[tuple[int, str]], prefix: str = "") -> Iterator[tuple[str, str, int, int]]:
    """(block, path, first line, line after the last) of each leaf among lines (number, text without container markers)."""
    ordinal, i = 0, 0

    def path(letter: str) -> str:
        nonlocal ordinal
        ordinal += 1
        return f"{prefix}{'/' if prefix else ''}{letter}{ordinal - 1}"

    def leaf(block: str, a: int, b: int) -> tuple[str, str, int, int]:
        return block, path(LETTERS[block]), lines[a][0], lines[b - 1][0] + 1

    while i < len(lines):
        text, start = lines[i][1], i
        if _blank(text):
            i += 1
        elif fence := _FENCE.match(text):
            mark = fence[1]
            close = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            i += 1
            while i < len(lines) and not close.match(lines[i][1]):
                i += 1
            i = min(i + 1, len(lines))
            yield leaf("fence", start, i)
        elif text.startswith("    ") or text.startswith("\t"):
            while i < len(lines) and (_blank(lines[i][1]) or lines[i][1].startswith(("    ", "\t"))):
                i += 1
            end = i
            while _blank(lines[end - 1][1]):
                end -= 1
            yield leaf("code_block", start, end)
        elif _ATX.match(text):
            i += 1
            yield leaf("heading", start, i)
        elif _RULE.match(text):
            i += 1
            yield leaf("hr", start, i)
        elif _QUOTE.match(text):
            inner = []
            while i < len(lines) and not _blank(lines[i][1]):
                mark = _QUOTE.match(lines[i][1])
                if not mark and (_opens_block(lines[i][1]) or not inner or _blank(inner[-1][1])):
                    break
                inner.append((lines[i][0], lines[i][1][mark.end() :] if mark else lines[i][1]))
                i += 1
            yield from scan_blocks(inner, path("q"))
        elif item := _ITEM.match(text):
            kind, here, n = item[2][-1], path("l"), 0
            while i < len(lines) and (item := _ITEM.match(lines[i][1])) and item[2][-1] == kind and not _RULE.match(lines[i][1]):
                width = len(item[1]) + len(item[2])
                spaces = len(item[3].replace("\t", "    "))
                rest = lines[i][1][item.end() :]
                width += 1 if _blank(rest) or spaces > 4 else spaces
                inner = [(lines[i][0], rest if spaces <= 4 or _blank(rest) else " " * (spaces - 1) + rest)]
                i += 1
                while i < len(lines):
                    line = lines[i][1].replace("\t", "    ", 1) if lines[i][1].startswith("\t") else lines[i][1]
                    if _blank(line):
                        inner.append((lines[i][0], ""))
                    elif len(line) - len(line.lstrip(" ")) >= width:
                        inner.append((lines[i][0], line[width:]))
                    elif not _blank(inner[-1][1]) and not _opens_block(line) and not _ITEM.match(line):
                        inner.append((lines[i][0], line))  # a paragraph goes on without its indent
                    else:
                        break
                    i += 1
                yield from scan_blocks(inner, f"{here}/i{n}")
                n += 1
        elif _HTML.match(text):
            ends_at = "-->" if text.lstrip().startswith("<!--") else None
            while i < len(lines) and (ends_at or not _blank(lines[i][1])):
                i += 1
                if ends_at and ends_at in lines[i - 1][1]:
                    break
            yield leaf("html_block", start, i)
        else:
            i += 1
            block = "paragraph"
            while i < len(lines) and not _blank(lines[i][1]):
                if _SETEXT.match(lines[i][1]):
                    block = "heading"
                    i += 1
                    break
                if _opens_block(lines[i][1]):
                    break
                i += 1
            yield leaf(block, start, i)


def atoms_of(body: str) -> list[tuple[str, str, int, int, str]]:
    """(block, path, start byte, end byte, text) of each atom of a body, in order."""
    raw = body.encode("utf-8")
    starts = [0, *(m.end() for m in re.finditer(b"\n", raw))]
    lines = list(enumerate(body.split("\n")))
    if lines and lines[-1][1] == "":
        lines.pop()
    out = []
    for block, path, first, after in scan_blocks(lines):
        a, b = starts[first], starts[after] if after < len(starts) else len(raw)
        out.append((block, path, a, b, raw[a:b].decode("utf-8")))
    return out


def parse_atoms(docs: DataFrame) -> DataFrame:
    """Atoms of documents (skill, body): id, skill, path, text, start, end, detected_kind, source_order, norm_key.

    A null body has no atoms. start and end are byte places in the body.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, n, *atom) for s, body in zip(batch.column("skill").to_pylist(), batch.column("body").to_pylist()) for n, atom in enumerate(atoms_of(body or ""))]
            if rows:
                s, n, block, path, a, b, text = zip(*rows)
                ids = [f"{x}:{p}:{hashlib.sha256(t.encode()).hexdigest()[:16]}" for x, p, t in zip(s, path, text)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(s, pa.string()), pa.array(path, pa.string()), pa.array(text, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(block, pa.string()), pa.array(n, pa.int32())], ["id", "skill", "path", "text", "start", "end", "block", "source_order"])

    parsed = docs.select("skill", "body").mapInArrow(parse, "id string, skill string, path string, text string, start bigint, end bigint, block string, source_order int")
    return parsed.withColumn("detected_kind", detected_kind("block", "text")).withColumn("norm_key", norm_key_full("text")).drop("block")
