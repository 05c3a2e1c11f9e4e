"""Files as Python workers reach them."""

from __future__ import annotations

import os
import re
import uuid
from contextlib import suppress

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a path or address, and the path in it."""
    uri = re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def files_below(uri: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of all files below a folder with that ending, or of those that a pattern (*, ?) names."""
    fs, path = open_fs(uri)
    if pattern := re.search(r"[*?]", path):
        top = path[: path.rindex("/", 0, pattern.start())]
        wanted = re.compile("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in path))
    else:
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(uri)
        if info.is_file:
            return [(path, info.size)]
        top, wanted = path, re.compile(f".*{re.escape(ending)}", re.IGNORECASE)
    found = fs.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and wanted.fullmatch(f.path))


def created(uri: str, data: bytes) -> bool:
    """Write a file that must not be there yet; whether it was not. Exclusive on a local (or mounted) file system; elsewhere a look
    comes first."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    if isinstance(fs, pafs.LocalFileSystem):
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "xb") as f:
            f.write(data)
        try:
            os.link(part, path)  # whole or not at all
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        return False
    with fs.open_output_stream(path) as out:
        out.write(data)
    return True


def content(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def removed(uri: str, names: list[str]) -> None:
    """Delete files below a folder, those that are there."""
    fs, top = open_fs(uri)
    for name in names:
        with suppress(OSError):
            fs.delete_file(f"{top}/{name}")
