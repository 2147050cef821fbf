"""Which server's credentials apply to a path: the longest matching scope, ties rejected."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Server:
    """A storage server: the path prefix it serves (empty: only by name) and its Hadoop settings."""

    name: str
    scope: str = ""
    settings: dict[str, str] = field(default_factory=dict, hash=False)


def _covers(scope: str, path: str) -> bool:
    scope = scope.rstrip("/")
    return path == scope or path.startswith(scope + "/")


def resolve(servers: list[Server], path: str, name: str | None = None) -> Server | None:
    """The named server, or the one with the longest scope that covers ``path``; None if none does."""
    if name is not None:
        found = [s for s in servers if s.name == name]
        if not found:
            raise ValueError(f"no server {name}")
        if found[0].scope and not _covers(found[0].scope, path):
            raise ValueError(f"{path} lies outside the scope of server {name}")
        return found[0]
    matching = sorted((s for s in servers if s.scope and _covers(s.scope, path)), key=lambda s: -len(s.scope.rstrip("/")))
    if len(matching) > 1 and len(matching[0].scope.rstrip("/")) == len(matching[1].scope.rstrip("/")):
        raise ValueError(f"servers {matching[0].name} and {matching[1].name} both serve {path}")
    return matching[0] if matching else None


def apply(spark: SparkSession, server: Server) -> None:
    """Put a server's settings into the session's Hadoop configuration."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in server.settings.items():
        conf.set(key, value)
