"""Byte ranges of files: listing, opening and the scans that need positions inside a file.

Spark's file sources split files themselves and do not tell where in a file a record stood. Sources
that resume inside a file (logs) or that must find record borders from any byte on (JSON arrays) read
ranges: the driver lists files and sizes, tasks open their own range. Local paths and every scheme that
``pyarrow.fs`` knows (hdfs, s3, gs, abfs) can be read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow.fs as pafs

BLOCK = 4 << 20


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri and not uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)


def listing(uri: str) -> list[tuple[str, int]]:
    """(path, size) of every file at or under ``uri``, by path; names that begin with _ or . are left out."""
    fs, path = resolve(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        return []
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    inside = len(path.rstrip("/")) + 1
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File
                  and not any(part[0] in "_." for part in f.path[inside:].split("/")))


def blocks(uri: str, lo: int, hi: int | None = None, size: int = BLOCK) -> Iterator[bytes]:
    """Bytes lo to hi (None: the end) in blocks."""
    fs, path = resolve(uri)
    with fs.open_input_file(path) as f:
        end = f.size() if hi is None else min(hi, f.size())
        while lo < end:
            block = f.read_at(min(size, end - lo), lo)
            if not block:
                return
            yield block
            lo += len(block)


def lines(uri: str, lo: int, hi: int) -> Iterator[tuple[int, bytes]]:
    """(position, line without its break) of the lines that begin at lo to hi - 1, each read to its end."""
    at, rest = lo, b""
    if lo:      # a line that began earlier belongs to the range before
        start = lo - 1
        for block in blocks(uri, start):
            cut = block.find(b"\n")
            if cut >= 0:
                at = start + cut + 1
                break
            start += len(block)
        else:
            return
    place = at
    if at >= hi:
        return
    for block in blocks(uri, at):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield place, line
            place += len(line) + 1
            if place >= hi:
                return
    if rest:
        yield place, rest


def last_break(uri: str, size: int) -> int:
    """Position after the last line break among the first ``size`` bytes (0: none)."""
    fs, path = resolve(uri)
    with fs.open_input_file(path) as f:
        hi = min(size, f.size())
        while hi > 0:
            lo = max(0, hi - (1 << 16))
            cut = f.read_at(hi - lo, lo).rfind(b"\n")
            if cut >= 0:
                return lo + cut + 1
            hi = lo
    return 0


def head(uri: str, size: int) -> bytes:
    fs, path = resolve(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(min(size, f.size()), 0)
