"""All registered queries of the library outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from recallspark.plans import conversations, files, graph, memories, more, scalars, work

MODULES = [conversations, memories, graph, work, more, scalars, files]
FLAGSHIP = "r7_coverage"

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
