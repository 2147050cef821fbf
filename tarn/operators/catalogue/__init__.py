"""The registered queries over the driver tables, by operator family."""

from tarn.operators.catalogue import helpers, lake, scans, sql, streams  # noqa: F401
