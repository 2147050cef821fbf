"""File connectors: Parquet, CSV, text, JSON lines and Avro, with compression, inference and COPY-like transfer."""

from tarn.sources.connect import analyze_files, export_to, import_from, read_files, truncate_files, write_files
from tarn.sources.inference import infer_csv_schema, infer_json_schema

__all__ = ["analyze_files", "export_to", "import_from", "infer_csv_schema", "infer_json_schema", "read_files", "truncate_files", "write_files"]
