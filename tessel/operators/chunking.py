"""Chunks of documents: sections by Markdown headers, then pieces of a bounded size.

Sections: a line of one to four # and a blank (or only those) is a header; it stays in the text
and in the metadata of its section until a header of the same or a higher level comes. Fences
(``` or ~~~) hide headers. Pieces: a section is cut at blank lines, then at line ends, then at
blanks, then anywhere; cuts keep the separator with the piece after it; neighbours are merged up to
`size` characters, with `overlap` characters at most of the pieces before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import CHUNK_OVERLAP, CHUNK_SIZE

SEPARATORS = ("\n\n", "\n", " ", "")


def _level(line: str) -> int:
    n = len(line) - len(line.lstrip("#"))
    return n if 1 <= n <= 4 and (len(line) == n or line[n] == " ") else 0


def sections(text: str) -> list[tuple[str, dict[str, str]]]:
    """(text, headers) of runs of lines under the same headers; blank lines end a run, equal headers join runs."""
    runs: list[tuple[list[str], dict[int, str]]] = []
    open_, headers, fence = [], {}, ""

    def close() -> None:
        nonlocal open_
        if open_:
            if runs and runs[-1][1] == headers:
                runs[-1][0].append("\n".join(open_))
            else:
                runs.append((["\n".join(open_)], dict(headers)))
        open_ = []

    for raw in text.split("\n"):
        line = raw.strip()
        if not line.isprintable():
            line = "".join(c for c in line if c.isprintable())
        mark = line[:3]
        if fence:
            fence = "" if mark == fence else fence
        elif mark in ("```", "~~~") and line.count(mark) == 1:
            fence = mark
        elif level := _level(line):
            close()
            headers = {k: v for k, v in headers.items() if k < level} | {level: line[level:].strip()}
        if line:
            open_.append(line)
        else:
            close()
    close()
    return [("  \n".join(parts), {f"header {k}": v for k, v in h.items()}) for parts, h in runs]


def _cut(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    sep = next(s for s in separators if not s or s in text)
    rest = separators[separators.index(sep) + 1 :]
    parts = text.split(sep) if sep else list(text)
    parts = [p for p in ([parts[0], *[sep + p for p in parts[1:]]] if sep else parts) if p]
    out, small = [], []
    for p in parts:
        if len(p) <= size:
            small.append(p)
            continue
        out += _merge(small, size, overlap)
        small = []
        out += _cut(p, size, overlap, rest) if rest else [p]
    return out + _merge(small, size, overlap)


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    out, run, total = [], [], 0
    for p in parts:
        if run and total + len(p) > size:
            out.append("".join(run).strip())
            while run and (total > overlap or total + len(p) > size):
                total -= len(run.pop(0))
        run.append(p)
        total += len(p)
    out.append("".join(run).strip())
    return [x for x in out if x]


def pieces(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[str, dict[str, str]]]:
    for section, headers in sections(text or ""):
        for piece in _cut(section, size, overlap, SEPARATORS):
            yield piece, headers


def chunk_documents(documents: DataFrame, id_col: str = "id", text_col: str = "content", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """doc_id, chunk_order, content, headers of all chunks of all documents."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, piece, headers) for i, text in zip(frame["i"], frame["t"], strict=True) for k, (piece, headers) in enumerate(pieces(text, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_order", "content", "headers"])

    return documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"doc_id {kind}, chunk_order int, content string, headers map<string,string>")


def chunk_records(chunks: DataFrame, source: Column | None = None) -> DataFrame:
    """doc_id, chunk_order, content, source, metadata of chunks: the headers without a source of their own, which is the file's name, or empty."""
    metadata = F.map_filter("headers", lambda k, _: k != "source")
    return chunks.select("doc_id", "chunk_order", "content", F.coalesce(source if source is not None else F.lit(""), F.lit("")).alias("source"), metadata.alias("metadata"))
