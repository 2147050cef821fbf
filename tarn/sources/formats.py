"""Formats and compressions by suffix."""

from __future__ import annotations

# Suffixes of the formats and of the stream compressions.
SUFFIXES = {"txt": "text", "text": "text", "csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "avro": "avro", "parquet": "parquet"}
COMPRESSIONS = {"gz": "gzip", "gzip": "gzip", "zst": "zstd", "zstd": "zstd"}
#: Compressions of each format, the default first.
CODECS = {
    "parquet": ("snappy", "none", "gzip", "zstd"),
    "avro": ("null", "deflate", "snappy", "zstd"),
    "csv": ("none", "gzip", "zstd"),
    "text": ("none", "gzip", "zstd"),
    "json": ("none", "gzip", "zstd"),
}


def by_suffix(path: str) -> tuple[str | None, str]:
    """(format or None, stream compression) of a path; the compression suffix is taken off first."""
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    compression = COMPRESSIONS.get(parts[-1], "none")
    if compression != "none":
        parts = parts[:-1]
    return (SUFFIXES.get(parts[-1]) if len(parts) > 1 else None), compression


def file_pattern(kind: str) -> str:
    """A glob of the file names of a format, compressed or not."""
    plain = [s for s, k in SUFFIXES.items() if k == kind]
    return "*.{" + ",".join([*plain, *(f"{s}.{c}" for s in plain for c in COMPRESSIONS)]) + "}"


def check_codec(kind: str, codec: str | None) -> str:
    if kind not in CODECS:
        raise ValueError(f"no such format: {kind}")
    codec = codec or CODECS[kind][0]
    if codec not in CODECS[kind]:
        raise ValueError(f"{kind} has no compression {codec}")
    return codec
