"""Training-data operators. Nothing else in the library imports this subpackage."""

from replicalens.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
