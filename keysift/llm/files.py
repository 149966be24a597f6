"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs


def new_file(folder: str, suffix: str):
    """(uri, open output stream) of a file with a name of its own.

    A task that is tried again writes another file; only files that a finished task has
    reported are ever read, so nothing needs renaming.
    """
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def open_file(uri: str):
    """The file for reading at any place."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
