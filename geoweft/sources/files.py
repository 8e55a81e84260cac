"""Files that tasks write on their own, under names that do not depend on the attempt.

A file appears under its name only when whole, so a repeated or speculative task replaces it by an
equal one.
"""

from __future__ import annotations

import os
import uuid


def write_file(path: str, *pieces: bytes) -> None:
    """``path`` is a mounted path or the URI of a store that pyarrow knows."""
    mark = f".{uuid.uuid4().hex}.tmp"
    if path.startswith(("file:", "/")):
        local = "/" + path.removeprefix("file:").lstrip("/")
        draft = local + mark
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(draft, "wb") as f:
            f.writelines(pieces)
        os.replace(draft, local)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner))
    with store.open_output_stream(inner + mark) as f:
        for p in pieces:
            f.write(p)
    store.move(inner + mark, inner)


def read_files(spark, path: str, suffix: str):
    """path, content of one file, or of all files in a folder that end in ``suffix`` of any case."""
    reader = spark.read.format("binaryFile")
    if not path.lower().endswith(f".{suffix}"):
        either = "".join(f"[{c}{c.upper()}]" for c in suffix)
        reader = reader.option("pathGlobFilter", f"*.{either}").option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "content")
