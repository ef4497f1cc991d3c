"""All registered queries."""

from lexiloom.catalog import blocks, files, glossary, layout, projects, reviews, scalars, terms, translation  # noqa: F401
from lexiloom.catalog.registry import ORACLES, QUERIES, render_oracles

render_oracles()

__all__ = ["ORACLES", "QUERIES"]
