"""Every query by name, with the SQL that expresses it where SQL can."""

from __future__ import annotations

from .queries import ORACLES, QUERIES, analysis, appended, dispatch, evaluation, grounding, io, merging, parsing, plans, runs, staged, vector_files, vectors  # noqa: F401
