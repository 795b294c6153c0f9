"""The queries of the engine's own operators and their SQL."""

from __future__ import annotations

from kinespark.plans import aggregates, evidence, extras, files, geometry, grounding, joins, parsing, prompts, scores, scans  # noqa: F401  they register
from kinespark.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
