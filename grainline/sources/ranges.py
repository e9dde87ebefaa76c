"""What tasks do with local files. It imports little: every Python worker of an executor holds what this module imports."""

from __future__ import annotations

import hashlib

#: Bytes of a range that are in memory at once.
PIECE_BYTES = 1 << 20


def digest(name: str, start: int, length: int) -> bytes:
    """SHA-256 of at most length bytes of a file."""
    out, piece = hashlib.sha256(), memoryview(bytearray(min(PIECE_BYTES, length)))
    with open(name, "rb", buffering=0) as f:
        f.seek(start)
        while n := f.readinto(piece[:length]):
            out.update(piece[:n])
            length -= n
    return out.digest()


def footer(name: str) -> bytes:
    """The Arrow schema of a Parquet file, without metadata."""
    import pyarrow.parquet as pq  # here, because digests do without

    return pq.read_schema(name).remove_metadata().serialize().to_pybytes()
