"""Small files in the folder that driver and executors share, and bounded samples."""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_arrays(uri: str, **arrays) -> None:
    """Arrays in one file, written under a temporary name and renamed."""
    system, path = filesystem(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    data = io.BytesIO()
    np.savez(data, **arrays)
    part = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}.part"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data.getvalue())
    system.move(part, path)


def get_arrays(uri: str) -> dict:
    system, path = filesystem(uri)
    with system.open_input_stream(path, compression=None) as f:
        return dict(np.load(io.BytesIO(f.read())))


def under(key: Column, rows: int, sample: int) -> Column:
    """A condition on a 64-bit hash that about `sample` of `rows` rows and a few more meet; all, if there are no more."""
    wanted = sample + 8 * math.sqrt(sample) + 8
    if wanted >= rows:
        return F.lit(True)
    return key < F.lit(int(-(1 << 63) + (1 << 64) * wanted / rows))
