"""All queries of the core, by name, with the SQL that an independent engine runs."""

from __future__ import annotations

from tanzaku.plans import etl, evaluation, features, lookups, recommending, retrieval, searching, selecting, texts, titles  # noqa: F401
from tanzaku.plans.registry import ORACLES, QUERIES  # noqa: F401
