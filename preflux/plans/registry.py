"""All queries of the analytics engine, with their SQL twins where SQL can express them."""

from __future__ import annotations

from . import corpus, model, visual

QUERIES: dict = {**corpus.QUERIES, **model.QUERIES, **visual.QUERIES}
ORACLES: dict[str, str] = {**corpus.ORACLES, **model.ORACLES, **visual.ORACLES}
