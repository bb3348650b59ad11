"""Numpy arrays in the shared folder: written whole by tasks, memory-mapped by workers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np


def _local(folder: str) -> Path | None:
    """The path of a folder that the machine mounts; None for other stores."""
    parts = urlparse(folder)
    return Path(unquote(parts.path)) if parts.scheme in ("", "file") else None


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write ``name`` at once: a lost or repeated task leaves a whole file or none."""
    here = _local(folder)
    if here is not None:
        here.mkdir(parents=True, exist_ok=True)
        part = here / f".{name}-{uuid.uuid4().hex}"
        array.tofile(part)
        os.replace(part, here / name)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(array.tobytes())
    store.move(part, f"{path}/{name}")


def load(folder: str, name: str, dtype: np.dtype | str) -> np.ndarray:
    """Memory-map ``name``; from a store that isn't mounted, by way of an unnamed local file."""
    here = _local(folder)
    if here is not None:
        path = here / name
        return np.memmap(path, dtype=dtype, mode="r") if path.stat().st_size else np.empty(0, dtype=dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    copy = tempfile.TemporaryFile()
    with store.open_input_stream(f"{path}/{name}") as source:
        shutil.copyfileobj(source, copy)
    copy.flush()
    return np.memmap(copy, dtype=dtype, mode="r") if copy.tell() else np.empty(0, dtype=dtype)
