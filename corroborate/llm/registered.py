"""The queries of the training-data operators and of the pipeline, with their SQL."""

from __future__ import annotations

import importlib

import corpus_pipeline
from corroborate.llm.common import QUERIES, SQL

for _name in ("langid", "packing", "lines", "hashindex", "mixing", "warc", "quality", "lattice", "simhash", "substring", "audit", "exact", "resample"):
    importlib.import_module(f"corroborate.llm.{_name}")

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["QUERIES", "SQL"]
