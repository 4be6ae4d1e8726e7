"""Arrays as files in the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write ``folder/name.npy``. The file appears whole or not at all, and a repeated task writes the same bytes again."""
    path = _local(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        draft = f"{path}/.{name}-{uuid.uuid4().hex}.npy"
        np.save(draft, array)
        os.replace(draft, f"{path}/{name}.npy")
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    data = io.BytesIO()
    np.save(data, array)
    draft = f"{base}/.{name}-{uuid.uuid4().hex}.npy"
    with store.open_output_stream(draft) as out:
        out.write(data.getbuffer())
    store.move(draft, f"{base}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    """Memory-map ``folder/name.npy``. From a store that is no file system it is first copied into an unnamed local file."""
    path = _local(folder)
    if path is not None:
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    with tempfile.NamedTemporaryFile(suffix=".npy") as copy:
        with store.open_input_stream(f"{base}/{name}.npy") as data:
            while block := data.read(1 << 22):
                copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")  # the mapping outlives the name


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, byte by byte of equal weight, so that small values compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
