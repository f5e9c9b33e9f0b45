"""Files of our own formats in a folder that driver and executors share."""

from __future__ import annotations

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and inner path of a URI or absolute path."""
    return fs.FileSystem.from_uri(path)


def make_folder(path: str) -> None:
    store, inner = at(path)
    store.create_dir(inner, recursive=True)


def write_bytes(path: str, data: bytes) -> None:
    store, inner = at(path)
    with store.open_output_stream(inner, compression=None) as out:
        out.write(data)


def read_bytes(path: str) -> bytes:
    store, inner = at(path)
    with store.open_input_file(inner) as src:
        return src.read()


def remove(path: str) -> None:
    store, inner = at(path)
    if store.get_file_info(inner).type != fs.FileType.NotFound:
        store.delete_file(inner)
