"""All queries of the engine's own kind, with the SQL that gives the same rows."""

from __future__ import annotations

from lectern.plans import further, relational, textual, vaulted  # noqa: F401  (the others register with relational)

QUERIES: dict = {**relational.Q}
ORACLE: dict[str, str] = {**relational.SQL}
FLAGSHIP = "j3_shared_source_pairs"
