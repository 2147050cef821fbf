"""Avro object container files without a JVM package.

Files are cut into splits of ``SPLIT`` bytes; a task finds the first sync marker of its split and decodes the blocks
from there on, one at a time, so neither a large file nor many small ones weigh on one task. Stores that Arrow's file
systems do not open are read whole by Spark's binary reader instead (2 GB a file at most). Only bound fields are decoded,
the others are skipped by the writer's schema. Writing goes through a data source whose tasks write through Arrow's file
systems.
"""

from __future__ import annotations

import datetime as dt
import decimal
import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MAGIC = b"Obj\x01"
EPOCH = dt.datetime(1970, 1, 1)


def _long(f: io.BytesIO) -> int:
    shift = value = 0
    while True:
        b = f.read(1)[0]
        value |= (b & 127) << shift
        if b < 128:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def _zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _blob(f: io.BytesIO) -> bytes:
    return f.read(_long(f))


def _inflate(codec: str, data: bytes) -> bytes:
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "snappy":
        # The block ends with a checksum; its length stands at the front of the snappy data.
        size = shift = k = 0
        while True:
            size |= (data[k] & 127) << shift
            k += 1
            if data[k - 1] < 128:
                break
            shift += 7
        out = pa.Codec("snappy").decompress(data[:-4], size).to_pybytes()
        if zlib.crc32(out) != struct.unpack(">I", data[-4:])[0]:
            raise ValueError("corrupt Avro block")
        return out
    return zstandard.ZstdDecompressor().decompressobj().decompress(data) if codec in ("zstandard", "zstd") else data


def _deflate(codec: str, data: bytes) -> bytes:
    if codec == "deflate":
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        return z.compress(data) + z.flush()
    if codec == "snappy":
        return pa.Codec("snappy").compress(data).to_pybytes() + struct.pack(">I", zlib.crc32(data))
    return zstandard.compress(data) if codec == "zstd" else data


def _decoder(schema: object, named: dict[str, object]) -> Callable[[io.BytesIO], object]:
    """A function that reads (or skips) one value of a writer's schema."""
    if isinstance(schema, list):
        branches = [_decoder(s, named) for s in schema]
        return lambda f: branches[_long(f)](f)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(schema, dict) and isinstance(kind, dict | list):
        return _decoder(kind, named)
    if kind in ("record", "error"):
        fields: list[tuple[str, Callable]] = []
        read = lambda f: {n: d(f) for n, d in fields}
        _name(schema, named, read)
        fields += [(x["name"], _decoder(x["type"], named)) for x in schema["fields"]]
        return read
    if kind in ("array", "map"):
        item = _decoder(schema["items" if kind == "array" else "values"], named)

        def blocks(f: io.BytesIO) -> object:
            out: list = []
            while n := _long(f):
                if n < 0:
                    n = -n
                    _long(f)
                out += [(_blob(f).decode(), item(f)) if kind == "map" else item(f) for _ in range(n)]
            return dict(out) if kind == "map" else out

        return blocks
    if kind == "enum":
        symbols = schema["symbols"]
        read = lambda f: symbols[_long(f)]
        _name(schema, named, read)
        return read
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if kind == "fixed":
        size = schema["size"]
        read = lambda f: f.read(size)
        if logical == "decimal":
            scale = schema.get("scale", 0)
            read = lambda f: decimal.Decimal(int.from_bytes(f.read(size), "big", signed=True)).scaleb(-scale)
        _name(schema, named, read)
        return read
    if logical == "decimal":
        return lambda f: decimal.Decimal(int.from_bytes(_blob(f), "big", signed=True)).scaleb(-schema.get("scale", 0))
    if logical == "date":
        return lambda f: dt.date(1970, 1, 1) + dt.timedelta(days=_long(f))
    if logical in ("timestamp-millis", "local-timestamp-millis"):
        return lambda f: EPOCH + dt.timedelta(milliseconds=_long(f))
    if logical in ("timestamp-micros", "local-timestamp-micros"):
        return lambda f: EPOCH + dt.timedelta(microseconds=_long(f))
    plain = {
        "null": lambda f: None,
        "boolean": lambda f: f.read(1) == b"\1",
        "int": _long,
        "long": _long,
        "float": lambda f: struct.unpack("<f", f.read(4))[0],
        "double": lambda f: struct.unpack("<d", f.read(8))[0],
        "bytes": _blob,
        "string": lambda f: _blob(f).decode(),
    }
    return plain[kind] if kind in plain else (lambda f: named[kind](f))


def _name(schema: dict, named: dict[str, object], value: object) -> None:
    """Make a named type known by its short and its full name."""
    named[schema["name"].rsplit(".", 1)[-1]] = named[schema["name"]] = value
    if schema.get("namespace"):
        named[f"{schema['namespace']}.{schema['name']}"] = value


def _skipper(schema: object, named: dict[str, object]) -> Callable[[io.BytesIO], None]:
    """A function that passes over one value of a writer's schema."""
    if isinstance(schema, list):
        branches = [_skipper(s, named) for s in schema]
        return lambda f: branches[_long(f)](f)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(schema, dict) and isinstance(kind, dict | list):
        return _skipper(kind, named)
    if kind in ("record", "error"):
        parts: list[Callable] = []

        def skip(f: io.BytesIO) -> None:
            for part in parts:
                part(f)

        _name(schema, named, skip)
        parts += [_skipper(x["type"], named) for x in schema["fields"]]
        return skip
    if kind in ("array", "map"):
        item = _skipper(schema["items" if kind == "array" else "values"], named)

        def blocks(f: io.BytesIO) -> None:
            while n := _long(f):
                if n < 0:  # the block's bytes are told
                    f.seek(_long(f), 1)
                    continue
                for _ in range(n):
                    if kind == "map":
                        f.seek(_long(f), 1)
                    item(f)

        return blocks
    sizes = {"null": 0, "boolean": 1, "float": 4, "double": 8}
    if kind == "fixed" or kind in sizes:
        size = schema["size"] if kind == "fixed" else sizes[kind]
        skip = lambda f: f.seek(size, 1)
        if kind == "fixed":
            _name(schema, named, skip)
        return skip
    if kind in ("string", "bytes"):
        return lambda f: f.seek(_long(f), 1)
    if kind == "enum":
        _name(schema, named, _long)
        return _long
    return _long if kind in ("int", "long") else (lambda f: named[kind](f))


class Container:
    """The header of a container file, and its rows of the named top-level fields; missing fields are None."""

    def __init__(self, f: io.BufferedIOBase, names: list[str]) -> None:
        if f.read(4) != MAGIC:
            raise ValueError("not an Avro object container file")
        meta: dict[str, bytes] = {}
        while n := _long(f):
            if n < 0:
                n = -n
                _long(f)
            for _ in range(n):
                key = _blob(f).decode()
                meta[key] = _blob(f)
        self.sync, self.codec, self.start = f.read(16), meta.get("avro.codec", b"null").decode(), f.tell()
        record = json.loads(meta["avro.schema"])
        wanted, skipped = {}, {}
        _decoder(record, wanted)  # both know every named type, wherever it stands
        _skipper(record, skipped)
        place = {n: k for k, n in enumerate(names)}
        self.fields = [(place[x["name"]], _decoder(x["type"], wanted)) if x["name"] in place else (-1, _skipper(x["type"], skipped)) for x in record["fields"]]
        self.width = len(names)

    def block(self, f: io.BufferedIOBase) -> Iterator[list[object]]:
        """The rows of the block that begins here; afterwards the next one begins."""
        n = _long(f)
        data = io.BytesIO(_inflate(self.codec, _blob(f)))
        if f.read(16) != self.sync:
            raise ValueError("corrupt Avro block")
        for _ in range(n):
            row: list[object] = [None] * self.width
            for k, read in self.fields:
                if k < 0:
                    read(data)
                else:
                    row[k] = read(data)
            yield row

    def rows(self, f: io.BufferedIOBase, begin: int, end: int) -> Iterator[list[object]]:
        """The rows of all blocks whose sync marker before them begins from ``begin`` on and before ``end``."""
        at = self.start - 16
        if at < begin:
            at = self._marker(f, begin)
        while 0 <= at < end:
            f.seek(at + 16)
            if not f.read(1):
                return
            f.seek(at + 16)
            yield from self.block(f)
            at = f.tell() - 16

    def _marker(self, f: io.BufferedIOBase, begin: int, step: int = 1 << 20) -> int:
        """Where the first marker from ``begin`` on begins, -1 without one."""
        f.seek(begin)
        held, offset = b"", begin
        while data := f.read(step):
            held += data
            found = held.find(self.sync)
            if found >= 0:
                return offset + found
            offset += max(0, len(held) - 15)
            held = held[-15:]
        return -1


def decode_file(data: bytes, names: list[str]) -> Iterator[list[object]]:
    """Rows of the named top-level fields of a container file; missing fields are None."""
    f = io.BytesIO(data)
    return Container(f, names).rows(f, 0, len(data))


def _value_encoder(schema: object) -> Callable[[object], bytes]:
    """A function that encodes one value of a schema of records, arrays, optional and plain types."""
    if isinstance(schema, list):  # ["null", kind]
        inner = _value_encoder(schema[1])
        return lambda v: _zigzag(0) if v is None else _zigzag(1) + inner(v)
    if isinstance(schema, dict) and schema["type"] == "record":
        fields = [(f["name"], _value_encoder(f["type"])) for f in schema["fields"]]
        return lambda v: b"".join(encode(v[name]) for name, encode in fields)
    if isinstance(schema, dict) and schema["type"] == "array":
        item = _value_encoder(schema["items"])
        return lambda v: (_zigzag(len(v)) + b"".join(map(item, v)) if v else b"") + _zigzag(0)
    plain = {"boolean": lambda v: bytes([v]), "int": _zigzag, "long": _zigzag, "string": lambda v: _zigzag(len(b := v.encode())) + b, "bytes": lambda v: _zigzag(len(v)) + bytes(v)}
    return plain[schema]


def encode_file(schema: dict, records: list[dict], extra: dict[str, str] | None = None) -> bytes:
    """A container file of one deflated block; for small files of metadata."""
    meta = {"avro.schema": json.dumps(schema), "avro.codec": "deflate", **(extra or {})}
    sync, encode = os.urandom(16), _value_encoder(schema)
    head = b"".join(_zigzag(len(k.encode())) + k.encode() + _zigzag(len(v.encode())) + v.encode() for k, v in meta.items())
    data = _deflate("deflate", b"".join(map(encode, records)))
    block = _zigzag(len(records)) + _zigzag(len(data)) + data + sync if records else b""
    return MAGIC + _zigzag(len(meta)) + head + b"\0" + sync + block


#: Bytes of a file that one task reads.
SPLIT = 32 << 20
# Schemes that Arrow's file systems open.
_ARROW_SCHEMES = frozenset("file s3 gs".split())


def read_avro(spark: SparkSession, path: str, schema: T.StructType, split: int = SPLIT) -> DataFrame:
    """Rows of the fields of ``schema`` of a file, or of all ``.avro`` files below a prefix."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.avro").load(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    in_splits = where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() in _ARROW_SCHEMES

    def batches_of(rows: Iterator[list[object]]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, held = to_arrow_schema(schema), []
        for row in rows:
            held.append(row)
            if len(held) == 8192:
                yield _batch(held, target)
                held = []
        if held:
            yield _batch(held, target)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from batches_of(decode_file(content.as_py(), schema.names))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as opened, io.BufferedReader(opened, 1 << 20) as f:
                    yield from batches_of(Container(f, schema.names).rows(f, begin, begin + split))

    if not in_splits:
        return files.select("content").mapInArrow(whole, schema)
    # Only names and sizes are read here, not contents.
    begins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split).cast("bigint"))).alias("begin")
    splits = files.where("length > 0").select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), begins)
    return splits.repartition("path", "begin").mapInArrow(parts, schema)


def _batch(rows: list[list], target: pa.Schema) -> pa.RecordBatch:
    columns = []
    for values, f in zip(zip(*rows, strict=True), target, strict=True):
        if pa.types.is_timestamp(f.type) and f.type.tz:
            values = [None if v is None else v.replace(tzinfo=dt.timezone.utc) for v in values]
        columns.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=target)


def _avro_type(kind: T.DataType) -> object:
    # The connector's type mapping.
    plain = {T.BooleanType: "boolean", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes"}
    if isinstance(kind, T.DateType):
        return {"type": "int", "logicalType": "date"}
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return {"type": "long", "logicalType": "timestamp-micros" if isinstance(kind, T.TimestampType) else "local-timestamp-micros"}
    if isinstance(kind, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    for spark_type, name in plain.items():
        if isinstance(kind, spark_type):
            return name
    raise ValueError(f"Avro has no mapping for {kind.simpleString()}")


def _encoder(kind: T.DataType) -> Callable[[object], bytes]:
    if isinstance(kind, T.BooleanType):
        return lambda v: bytes([v])
    if isinstance(kind, T.IntegerType | T.LongType):
        return _zigzag
    if isinstance(kind, T.FloatType | T.DoubleType):
        code = "<f" if isinstance(kind, T.FloatType) else "<d"
        return lambda v: struct.pack(code, v)
    if isinstance(kind, T.StringType):
        return lambda v: _zigzag(len(b := v.encode())) + b
    if isinstance(kind, T.BinaryType):
        return lambda v: _zigzag(len(v)) + bytes(v)
    if isinstance(kind, T.DateType):
        return lambda v: _zigzag((v - dt.date(1970, 1, 1)).days)
    if isinstance(kind, T.DecimalType):

        def number(v: decimal.Decimal) -> bytes:
            n = int(v.scaleb(kind.scale).to_integral_value())
            raw = n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True)
            return _zigzag(len(raw)) + raw

        return number
    return lambda v: _zigzag(round((v.replace(tzinfo=None) - EPOCH) / dt.timedelta(microseconds=1)))


class AvroWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, path: str, codec: str) -> None:
        self.schema, self.path, self.codec = schema, path, codec

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fields = [{"name": f.name, "type": ["null", _avro_type(f.dataType)]} for f in self.schema]
        name = {"zstd": "zstandard"}.get(self.codec, self.codec).encode()
        meta = {"avro.schema": json.dumps({"type": "record", "name": "row", "fields": fields}).encode(), "avro.codec": name}
        sync, encoders = os.urandom(16), [_encoder(f.dataType) for f in self.schema]
        from pyarrow import fs

        # Hadoop writes file:/x where Arrow wants file:///x.
        store, folder = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", self.path))
        store.create_dir(folder, recursive=True)
        target = f"{folder}/part-{uuid.uuid4().hex}.avro"
        with store.open_output_stream(target) as out:
            head = b"".join(_zigzag(len(k)) + k.encode() + _zigzag(len(v)) + v for k, v in meta.items())
            out.write(MAGIC + _zigzag(len(meta)) + head + b"\0" + sync)
            block, n = bytearray(), 0

            def flush() -> None:
                nonlocal block, n
                if n:
                    data = _deflate(self.codec, bytes(block))
                    out.write(_zigzag(n) + _zigzag(len(data)) + data + sync)
                block, n = bytearray(), 0

            for row in rows:
                for v, encode in zip(row, encoders, strict=True):
                    block += b"\0" if v is None else b"\2" + encode(v)
                n += 1
                if len(block) >= 1 << 20:
                    flush()
            flush()
        return WriterCommitMessage()


class AvroSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarn_avro"

    def writer(self, schema: T.StructType, overwrite: bool) -> AvroWriter:
        return AvroWriter(schema, self.options["path"], self.options.get("compression", "null"))
