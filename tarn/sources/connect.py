"""Reading and writing of files and prefixes by format, and COPY-like transfer."""

from __future__ import annotations

import csv
import io
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources import inference
from tarn.sources.avro import AvroSource, read_avro
from tarn.sources.formats import by_suffix, check_codec, file_pattern

#: Bytes of a JSON record, at most.
MAX_RECORD = 16 << 20


def _reader(spark: SparkSession, path: str, kind: str, match_suffix: bool) -> DataFrameReader:
    """A reader of a file, or of the files below a prefix whose suffix is of the format."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", file_pattern(kind)) if match_suffix and by_suffix(path)[0] is None else reader


def _zstd_lines(encoding: str, newline: str | None, content: bytes) -> io.TextIOWrapper:
    """The text of a zstd file, unpacked as it is read."""
    return io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True), encoding, newline=newline)


def _lines(reader: DataFrameReader, path: str, compression: str, encoding: str = "UTF-8") -> DataFrame:
    """Lines of text files; gzip and plain are Spark's to read, zstd is unpacked in Python, file by file (of 2 GB packed at most)."""
    if compression != "zstd":
        return reader.option("encoding", encoding).text(path)
    files = reader.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[str] = []
                for line in _zstd_lines(encoding, None, content.as_py()):
                    held.append(line.rstrip("\n"))
                    if len(held) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(held)], names=["value"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return files.mapInArrow(run, "value string")


# Letters after a backslash in COPY text, and what they stand for.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _unescape(text: Column) -> Column:
    """COPY text escapes: a letter of ``ESCAPES``, up to three octal digits, x and up to two hexadecimal digits; any
    other character stands for itself. Codes are those of ASCII; larger ones are an error."""

    def piece(p: Column) -> Column:
        octal, hexadecimal = F.regexp_extract(p, "^([0-7]{1,3})", 1), F.regexp_extract(p, "^x([0-9a-fA-F]{1,2})", 1)
        code = F.when(octal != "", F.conv(octal, 8, 10)).otherwise(F.conv(hexadecimal, 16, 10)).cast("int")
        rest = F.when(octal != "", F.regexp_replace(p, "^[0-7]{1,3}", "")).otherwise(F.regexp_replace(p, "^x[0-9a-fA-F]{1,2}", ""))
        character = F.when(code < 128, F.char(code)).otherwise(F.raise_error(F.lit("an escaped code is no ASCII character")).cast("string"))
        out = F.when((octal != "") | (hexadecimal != ""), F.concat(character, rest))
        for letter, meaning in ESCAPES.items():
            out = out.when(p.startswith(letter), F.concat(F.lit(meaning), F.substring(p, 2, 1 << 30)))
        return out.otherwise(p)

    # A backslash that stands for itself is set aside, so that every other one begins an escape.
    parts = F.split(F.replace(text, F.lit("\\\\"), F.lit("\0")), "\\\\", -1)
    whole = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1 << 30), piece), ""))
    return F.when(text.contains("\\"), F.replace(whole, F.lit("\0"), F.lit("\\"))).otherwise(text)


def _escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for letter, meaning in ESCAPES.items():
        out = F.replace(out, F.lit(meaning), F.lit("\\" + letter))
    return out


def _read_copy_text(lines: DataFrame, schema: T.StructType, sep: str, null: str) -> DataFrame:
    # A line of a backslash and a full stop only marks the end of the data.
    parts = lines.where(F.col("value") != "\\.").select(F.split("value", "\\Q" + sep + "\\E", -1).alias("p"))
    checked = parts.where(F.when(F.size("p") == len(schema), F.lit(True)).otherwise(F.raise_error(F.lit("a record has another number of fields")).cast("boolean")))
    return checked.select(*[F.when(F.col("p")[k] != null, _unescape(F.col("p")[k])).cast(f.dataType).alias(f.name) for k, f in enumerate(schema)])


def _records(text: io.TextIOBase, sep: str, quote: str, escape: str) -> Iterator[list[str | None]]:
    """CSV records; an empty field without quotes is None."""
    own = {"doublequote": True} if escape == quote else {"doublequote": False, "escapechar": escape}
    return csv.reader(text, delimiter=sep, quotechar=quote, quoting=csv.QUOTE_NOTNULL, strict=True, **own)


def _zstd_records(files: DataFrame, schema: T.StructType, header: bool, sep: str, quote: str, escape: str, null: str, encoding: str) -> DataFrame:
    """CSV records of zstd files; quotes may hold line breaks. Only a file's first record is a header."""
    names, marker = schema.names, "" if null else "\0empty"

    def batch_of(rows: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names=names)

    def value(v: str | None) -> str | None:
        return (None if not null else "") if v is None else None if v == null and null else v or marker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[list[str | None]] = []
                for k, fields in enumerate(_records(_zstd_lines(encoding, "", content.as_py()), sep, quote, escape)):
                    if (header and k == 0) or not fields:
                        continue
                    if len(fields) != len(names):
                        raise ValueError("a record has another number of fields")
                    held.append([value(v) for v in fields])
                    if len(held) == 8192:
                        yield batch_of(held)
                        held = []
                yield batch_of(held)

    return files.mapInArrow(run, schema)


def _first_text(spark: SparkSession, path: str, packed: str, encoding: str, most: int = 1 << 20) -> str:
    """The beginning of a file, unpacked."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(where)
    try:
        data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(most, fs.getFileStatus(where).getLen())))
    finally:
        stream.close()
    if packed == "gzip":
        data = zlib.decompressobj(31).decompress(data, most)
    elif packed == "zstd":
        data = zstandard.ZstdDecompressor().stream_reader(data).read(most)
    return data.decode(encoding, "ignore")


def _check_headers(reader: DataFrameReader, spark: SparkSession, path: str, names: list[str], packed: str, encoding: str, **dialect: str) -> None:
    """Every file's first record must be the column names; only the beginning of each file is read."""
    for row in reader.format("binaryFile").load(path).where("length > 0").select("path").toLocalIterator():
        text = _first_text(spark, row["path"], packed if packed != "none" else by_suffix(row["path"])[1], encoding)
        first = next(_records(io.StringIO(text, newline=""), **dialect), None)
        if first is not None and first != names:
            raise ValueError("the header does not match the column names")


def read_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    kind: str | None = None,
    compression: str | None = None,
    on_error: str = "stop",
    header: bool | str = True,
    sep: str | None = None,
    quote: str = '"',
    escape: str | None = None,
    null: str | None = None,
    encoding: str = "UTF-8",
    force_null: tuple[str, ...] = (),
    force_not_null: tuple[str, ...] = (),
    multiline: bool = False,
    match_suffix: bool = True,
) -> DataFrame:
    """Rows of a file, or of all files below a prefix with a suffix of the format (``match_suffix``: false for any); a
    missing schema is read from the footer or inferred.

    ``header``: true, false, or "match" (the first record must be the column names). ``on_error``: "stop", or "ignore"
    for JSON. ``force_null``/``force_not_null``: columns whose quoted/unquoted null string is NULL/kept as text.
    ``multiline``: CSV fields in quotes may hold line breaks; without it large CSV files are read by many tasks, as a
    record ends with its line.
    """
    found, packed = by_suffix(path)
    kind = kind or found
    packed = compression or packed
    if kind is None:
        raise ValueError(f"{path}: no format by its suffix; name one")
    if on_error not in ("stop", "ignore") or (on_error == "ignore" and kind != "json"):
        raise ValueError("on_error is 'stop', or 'ignore' for JSON")
    reader = _reader(spark, path, kind, match_suffix)
    if kind == "parquet":
        found_schema = reader.parquet(path).schema
        if schema is None:
            return reader.parquet(path)
        own = {f.name: f.dataType for f in found_schema}
        for f in schema:
            if f.name not in own or own[f.name] != f.dataType:
                raise ValueError(f"column {f.name} is {own.get(f.name)} in the file, declared {f.dataType}")
        return reader.schema(schema).parquet(path)
    if kind == "avro":
        if schema is None:
            raise ValueError("Avro needs a declared schema")
        return read_avro(spark, path, schema)
    if kind == "json":
        lines = _lines(reader, path, packed)
        schema = schema or inference.infer_json_schema([r[0] for r in lines.limit(inference.SAMPLE).collect()])
        kept = lines.where(F.trim("value") != "")
        mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
        parsed = kept.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), mode).alias("r"))
        bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | (F.octet_length("value") > MAX_RECORD)
        if on_error == "ignore":
            return parsed.where(~bad).select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema])
        checked = parsed.where(F.when(bad, F.raise_error(F.lit("malformed JSON record")).cast("boolean")).otherwise(F.lit(True)))
        return checked.select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema])
    if kind == "text":
        lines = _lines(reader, path, packed, encoding)
        if schema is None:
            schema = inference.infer_csv_schema([r[0] for r in lines.limit(inference.SAMPLE).collect()], False, sep or "\t", "\0", "\\N")
        return _read_copy_text(lines, schema, sep or "\t", "\\N" if null is None else null)
    sep, null = sep or ",", "" if null is None else null
    dialect = {"sep": sep, "quote": quote, "escape": escape or quote}
    if schema is None:
        lines = [r[0] for r in _lines(_reader(spark, path, kind, match_suffix), path, packed, encoding).limit(inference.SAMPLE + 1).collect()]
        schema = inference.infer_csv_schema(lines, bool(header), sep, quote, null)
    if header == "match":
        _check_headers(_reader(spark, path, kind, match_suffix), spark, path, schema.names, packed, encoding, **dialect)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    # Quoted empties come back as a marker, so that they are told from unquoted (NULL) ones.
    options = {"encoding": encoding, "header": str(bool(header)).lower(), "mode": "FAILFAST", "multiLine": str(multiline).lower(), "nullValue": null, "emptyValue": "" if null else "\0empty"}
    if packed == "zstd":
        files = reader.format("binaryFile").load(path).select("content")
        raw = _zstd_records(files, text, bool(header), null=null, encoding=encoding, **dialect)
    else:
        raw = reader.options(**dialect, **options).schema(text).csv(path)

    def value(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if not null:
            c = F.when(c == "\0empty", F.lit(None) if f.name in force_null else F.lit("")).otherwise(c)
        if f.name in force_not_null:
            c = F.coalesce(c, F.lit(null))
        return c.cast(f.dataType).alias(f.name)

    return raw.select(*[value(f) for f in schema])


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: the default file system's where none is given."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def write_files(
    df: DataFrame, path: str, kind: str | None = None, compression: str | None = None, header: bool = True, sep: str | None = None, null: str | None = None, mode: str = "append", max_records: int = 0, target_bytes: int = 0
) -> None:
    """Append files below a prefix; each task rolls over after ``max_records`` rows if given.

    ``target_bytes``: rows are dealt out so that each task writes about so much (measured where rows are shuffled, so
    files differ by what the format and its compression make of them).
    """
    if target_bytes:
        with _setting(df.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes)):
            return write_files(df.hint("rebalance"), path, kind, compression, header, sep, null, mode, max_records)
    found, packed = by_suffix(path)
    kind = kind or found or "parquet"
    codec = check_codec(kind, compression or (packed if packed != "none" else None))
    if kind == "avro":
        df.sparkSession.dataSource.register(AvroSource)
        df.write.format("tarn_avro").option("path", _qualified(df.sparkSession, path)).option("compression", codec).mode("append").save()
        return
    writer = df.write.mode(mode).option("compression", codec)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "json":
        writer.option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        writer.options(header=str(header).lower(), sep=sep or ",", nullValue=null or "", emptyValue='""', escape='"', quote='"').csv(path)
    else:
        columns = [F.coalesce(_escape(F.col(f"`{f.name}`").cast("string")), F.lit("\\N" if null is None else null)) for f in df.schema]
        lines = df.select(F.concat_ws(sep or "\t", *columns).alias("value")).write.mode(mode).option("compression", codec)
        (lines.option("maxRecordsPerFile", max_records) if max_records else lines).text(path)


def export_to(df: DataFrame, path: str, **options) -> int:
    """COPY (query) TO path: published only when all of it is written; returns the rows, counted as they are written."""
    counted = Observation()
    write_files(df.observe(counted, F.count(F.lit(1)).alias("n")), path, **options)
    return counted.get["n"]


def analyze_files(spark: SparkSession, path: str, fraction: float = 0.1, seed: int = 1, **options) -> DataFrame:
    """ANALYZE of files: statistics of each column from a sample of the records."""
    from tarn.tables.catalog import column_statistics

    rows = read_files(spark, path, **options)
    return column_statistics(rows.sample(fraction, seed) if fraction < 1 else rows)


def truncate_files(spark: SparkSession, path: str, kind: str) -> int:
    """TRUNCATE of a prefix: its files with a suffix of the format go, others stay; returns how many."""
    files = _reader(spark, path, kind, True).format("binaryFile").load(path).select("path")
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for row in files.toLocalIterator():
        where = jvm.org.apache.hadoop.fs.Path(row["path"])
        n += bool(where.getFileSystem(conf).delete(where, False))
    return n


def import_from(spark: SparkSession, table, path: str, **options) -> int:
    """COPY table FROM path with assignment casts to the table's types; all rows or none. Returns the rows."""
    rows = read_files(spark, path, **({"schema": table.schema} | options))
    return table.insert(rows)
