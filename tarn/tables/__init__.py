"""Versioned lake tables: transactional, partitioned by transforms, with row deletes and schema evolution."""

from tarn.tables.catalog import LakeCatalog, Policy, analyze, column_statistics, maintain
from tarn.tables.catalogs import RestCatalog, SqliteCatalog
from tarn.tables.iceberg import IcebergTable
from tarn.tables.lake import CommitConflict, LakeTable

__all__ = ["CommitConflict", "IcebergTable", "LakeCatalog", "LakeTable", "Policy", "RestCatalog", "SqliteCatalog", "analyze", "column_statistics", "maintain"]
