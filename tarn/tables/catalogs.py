"""Catalogs of tables in the Apache Iceberg format: a SQLite database, or a REST service.

A catalog says where each table's newest metadata is and replaces it only if it is still what the writer has seen.
"""

from __future__ import annotations

import json
import sqlite3
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tarn.tables.files import Store
from tarn.tables.iceberg import IcebergTable, format_type, new_metadata


class _Catalog:
    """What both kinds have in common; namespaces are names joined by full stops."""

    spark: SparkSession

    def load(self, namespace: str, name: str) -> IcebergTable:
        return IcebergTable(self.spark, catalog=_Entry(self, namespace, name))

    def import_schema(self, namespace: str, only: list[str] | None = None) -> dict[str, IcebergTable]:
        """The tables of a namespace, or those named, as temporary views."""
        found = {n: self.load(namespace, n) for n in self.tables(namespace) if only is None or n in only}
        if only and (missing := set(only) - set(found)):
            raise ValueError(f"no tables {sorted(missing)} in {namespace}")
        for name, table in found.items():
            table.scan().createOrReplaceTempView(name)
        return found


class _Entry:
    """One table of a catalog, as ``IcebergTable`` needs it."""

    def __init__(self, catalog: _Catalog, namespace: str, name: str) -> None:
        self.catalog, self.key = catalog, (namespace, name)

    def load(self) -> tuple[object, dict]:
        return self.catalog._load(*self.key)

    def swap(self, state: object, meta: dict, snapshot: dict) -> bool:
        return self.catalog._swap(*self.key, state, meta, snapshot)


class SqliteCatalog(_Catalog):
    """The tables that a SQLite database of the common layout lists; the database is a file of the driver's machine."""

    def __init__(self, spark: SparkSession, database: str, name: str, warehouse: str) -> None:
        self.spark, self.database, self.name, self.warehouse = spark, database, name, warehouse.rstrip("/")
        with self._connection() as c:
            c.execute("CREATE TABLE IF NOT EXISTS iceberg_tables (catalog_name TEXT, table_namespace TEXT, table_name TEXT, metadata_location TEXT, previous_metadata_location TEXT, PRIMARY KEY (catalog_name, table_namespace, table_name))")
            c.execute("CREATE TABLE IF NOT EXISTS iceberg_namespace_properties (catalog_name TEXT, namespace TEXT, property_key TEXT, property_value TEXT, PRIMARY KEY (catalog_name, namespace, property_key))")

    @contextmanager
    def _connection(self) -> Iterator[sqlite3.Connection]:
        connection = sqlite3.connect(self.database, timeout=30)
        try:
            with connection:  # one transaction
                yield connection
        finally:
            connection.close()

    def namespaces(self) -> list[str]:
        with self._connection() as c:
            return [r[0] for r in c.execute("SELECT DISTINCT table_namespace FROM iceberg_tables WHERE catalog_name = ? ORDER BY 1", (self.name,))]

    def tables(self, namespace: str) -> list[str]:
        with self._connection() as c:
            return [r[0] for r in c.execute("SELECT table_name FROM iceberg_tables WHERE catalog_name = ? AND table_namespace = ? ORDER BY 1", (self.name, namespace))]

    def _metadata_file(self, location: str, meta: dict, number: int) -> str:
        name = f"metadata/{number:05d}-{uuid.uuid4()}.metadata.json"
        Store(self.spark, location).write_bytes(name, json.dumps(meta).encode())
        return f"{location}/{name}"

    def create(self, namespace: str, name: str, schema: T.StructType) -> IcebergTable:
        location = f"{self.warehouse}/{namespace.replace('.', '/')}/{name}"
        if name in self.tables(namespace):
            raise ValueError(f"table {namespace}.{name} exists")
        file = self._metadata_file(location, new_metadata(location, schema), 0)
        with self._connection() as c:
            done = c.execute("INSERT OR IGNORE INTO iceberg_tables VALUES (?, ?, ?, ?, NULL)", (self.name, namespace, name, file)).rowcount
        if not done:
            raise ValueError(f"table {namespace}.{name} exists")
        return self.load(namespace, name)

    def rename(self, namespace: str, name: str, new_namespace: str, new_name: str) -> None:
        with self._connection() as c:
            c.execute("UPDATE iceberg_tables SET table_namespace = ?, table_name = ? WHERE catalog_name = ? AND table_namespace = ? AND table_name = ?", (new_namespace, new_name, self.name, namespace, name))

    def drop(self, namespace: str, name: str) -> None:
        """Forget the table; its files stay."""
        with self._connection() as c:
            c.execute("DELETE FROM iceberg_tables WHERE catalog_name = ? AND table_namespace = ? AND table_name = ?", (self.name, namespace, name))

    def _load(self, namespace: str, name: str) -> tuple[str, dict]:
        with self._connection() as c:
            row = c.execute("SELECT metadata_location FROM iceberg_tables WHERE catalog_name = ? AND table_namespace = ? AND table_name = ?", (self.name, namespace, name)).fetchone()
        if row is None:
            raise ValueError(f"no table {namespace}.{name}")
        return row[0], json.loads(Store(self.spark, self.warehouse).read_bytes(row[0], absolute=True))

    def _swap(self, namespace: str, name: str, state: str, meta: dict, snapshot: dict) -> bool:
        number = int(state.rsplit("/", 1)[1].split("-")[0]) + 1
        file = self._metadata_file(meta["location"], meta, number)
        with self._connection() as c:
            done = c.execute("UPDATE iceberg_tables SET metadata_location = ?, previous_metadata_location = ? WHERE catalog_name = ? AND table_namespace = ? AND table_name = ? AND metadata_location = ?", (file, state, self.name, namespace, name, state)).rowcount
        return done == 1


class RestCatalog(_Catalog):
    """The tables of a REST catalog service; options: warehouse, token, timeout."""

    def __init__(self, spark: SparkSession, uri: str, **options: object) -> None:
        if unknown := set(options) - {"warehouse", "token", "timeout"}:
            raise ValueError(f"unknown catalog options: {sorted(unknown)}")
        self.spark, self.uri, self.options, self.prefix = spark, uri.rstrip("/"), options, ""
        query = "?" + urllib.parse.urlencode({"warehouse": options["warehouse"]}) if "warehouse" in options else ""
        found = self._call("GET", f"/v1/config{query}")
        self.prefix = {**found.get("defaults", {}), **found.get("overrides", {})}.get("prefix", "")

    def _call(self, method: str, path: str, body: dict | None = None) -> dict:
        request = urllib.request.Request(self.uri + path, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"}, method=method)
        if "token" in self.options:
            request.add_header("Authorization", f"Bearer {self.options['token']}")
        try:
            with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 60))) as answer:
                return json.loads(answer.read() or b"{}")
        except urllib.error.HTTPError as refused:
            if refused.code == 409:
                raise FileExistsError(path) from refused
            try:
                said = json.loads(refused.read())["error"]["message"]
            except (ValueError, KeyError):
                said = refused.reason
            raise ValueError(f"{method} {path}: {refused.code} {said}") from refused

    def _path(self, namespace: str | None = None, name: str | None = None) -> str:
        path = f"/v1/{self.prefix}/namespaces" if self.prefix else "/v1/namespaces"
        if namespace is not None:
            path += "/" + "%1F".join(urllib.parse.quote(part, safe="") for part in namespace.split(".")) + "/tables"
        return path if name is None else f"{path}/{urllib.parse.quote(name, safe='')}"

    def namespaces(self) -> list[str]:
        return sorted(".".join(n) for n in self._call("GET", self._path())["namespaces"])

    def tables(self, namespace: str) -> list[str]:
        return sorted(t["name"] for t in self._call("GET", self._path(namespace))["identifiers"])

    def create(self, namespace: str, name: str, schema: T.StructType) -> IcebergTable:
        fields = [{"id": k, "name": f.name, "required": not f.nullable, "type": format_type(f.dataType)} for k, f in enumerate(schema, 1)]
        try:
            self._call("POST", self._path(namespace), {"name": name, "schema": {"type": "struct", "schema-id": 0, "fields": fields}})
        except FileExistsError:
            raise ValueError(f"table {namespace}.{name} exists") from None
        return self.load(namespace, name)

    def drop(self, namespace: str, name: str) -> None:
        self._call("DELETE", self._path(namespace, name))

    def _load(self, namespace: str, name: str) -> tuple[int | None, dict]:
        meta = self._call("GET", self._path(namespace, name))["metadata"]
        return meta.get("refs", {}).get("main", {}).get("snapshot-id"), meta

    def _swap(self, namespace: str, name: str, state: int | None, meta: dict, snapshot: dict) -> bool:
        requirements = [{"type": "assert-table-uuid", "uuid": meta["table-uuid"]}, {"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": state}]
        updates = [{"action": "add-snapshot", "snapshot": snapshot}, {"action": "set-snapshot-ref", "ref-name": "main", "type": "branch", "snapshot-id": snapshot["snapshot-id"]}]
        try:
            self._call("POST", self._path(namespace, name), {"identifier": {"namespace": namespace.split("."), "name": name}, "requirements": requirements, "updates": updates})
        except FileExistsError:
            return False
        return True
