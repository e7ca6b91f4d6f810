"""Package archives: the files of .tar.gz archives that are worth reading, one row per file.

Archives are read in tasks and within limits; nothing is written to disk. An archive's paths and its package.json are looked at first, and only then
are the files chosen that are read, so it doesn't matter where in an archive they stand. Whatever a limit leaves out is a problem row.
"""

from __future__ import annotations

import fnmatch
import io
import json
import re
import tarfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame

MOST_PACKED, MOST_UNPACKED, MOST_FILE, MOST_FILES = 5 << 20, 50 << 20, 512 << 10, 10
#: Paths that are worth reading.
INSPECTABLE = re.compile(r"/(index|main|cli)\.[mc]?js$|/bin/[^/]+\.[mc]?js$|/(install|postinstall|preinstall|prepare|setup|loader)\.js$|/(dist|lib)/index\.[mc]?js$|/(setup|__init__|cli|main|__main__|conftest)\.py$")
SCRIPT = re.compile(r"\.([mc]?js|py)$")
MANIFEST = "package.json"


def entry_points(manifest: str) -> list[str]:
    """Patterns of the paths that a package.json names in main, bin and exports, however deep they stand; none if it can't be read."""
    try:
        doc = json.loads(manifest)
    except (ValueError, RecursionError):
        return []
    out, rest = [], [doc.get(field) for field in ("main", "bin", "exports")] if isinstance(doc, dict) else []
    while rest:
        x = rest.pop()
        if isinstance(x, str):
            out.append(x.removeprefix("./"))
        elif isinstance(x, dict | list):
            rest += x.values() if isinstance(x, dict) else x
    return out


def _is_point(name: str, points: list[str]) -> bool:
    """A point names a file, a file without its ending, or a folder with an index; * stands for any text."""
    return any(fnmatch.fnmatchcase(name, form) for p in points for form in (p, f"{p}.js", f"{p.rstrip('/')}/index.js"))


def _entries(data: bytes):
    """Rows ``entry, ord, text, problem`` of one archive."""
    if len(data) > MOST_PACKED:
        yield None, None, None, "archive too large"
        return
    try:
        unpacker = zlib.decompressobj(31)
        raw = unpacker.decompress(data, MOST_UNPACKED)
        if unpacker.unconsumed_tail:
            yield None, None, None, "archive unpacks to too much"
            return
        if not unpacker.eof:
            yield None, None, None, "archive is cut off"
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as tar:
            members = [(m.name.removeprefix("package/"), m) for m in tar if m.isfile()]
            read = lambda m: tar.extractfile(m).read().decode("utf-8", "replace")
            manifest = next((m for name, m in members if name == MANIFEST and m.size <= MOST_FILE), None)
            points = entry_points(read(manifest)) if manifest else []
            chosen = [(k, name, m) for k, (name, m) in enumerate(members) if SCRIPT.search(name) and (INSPECTABLE.search("/" + name) or _is_point(name, points))]
            for k, name, m in chosen[:MOST_FILES]:
                if m.size > MOST_FILE:
                    yield name, k, None, f"file too large: {name}"
                else:
                    yield name, k, read(m), None
            if len(chosen) > MOST_FILES:
                yield None, None, None, f"files left out: {len(chosen) - MOST_FILES}"
    except (zlib.error, tarfile.TarError, EOFError) as error:
        yield None, None, None, f"unreadable archive: {error}"


def untar(archives: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, entry, ord, text, problem`` of ``archives(keys, content)``; ``keys`` are ``path`` unless given.

    Of each archive at most MOST_FILES files are read: those of telling names, and the entry points that its package.json names. Rows with
    ``problem`` have no text and tell what could not be read or was left out. An archive without content is unreadable.
    """
    keys = keys or ["path"]
    kept = archives.select(*keys, "content")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keys).schema], "entry string, ord int, text string, problem string"])

    def read(batches):
        for batch in batches:
            rows = [(*row[:-1], *entry) for row in batch.itertuples(index=False, name=None) for entry in _entries(bytes(row[-1] or b""))]
            yield pd.DataFrame(rows, columns=[*keys, "entry", "ord", "text", "problem"]).astype({"ord": "Int32"})

    return kept.mapInPandas(read, schema)


def inspectable(entries: DataFrame) -> DataFrame:
    """The files that were read."""
    return entries.filter("problem is null")
