"""Operators of a training-data pipeline: extraction, dedup, mixing, scoring, packing.

Nothing outside this subpackage imports it.  ``QUERIES`` maps each ``opN_<name>`` to a
``(spark, sf_dir) -> DataFrame``; ``ORACLES`` holds DuckDB SQL where SQL can express one.
"""

from quillstream.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
