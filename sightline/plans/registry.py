"""The library's queries by name, and their SQL."""

from sightline.plans import answers, catalog, entities, hierarchy, mentions, ranks, resolve, streams, visibility

_PLANS = (visibility, ranks, answers, entities, catalog, hierarchy, mentions, resolve, streams)
QUERIES: dict = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLES: dict = {k: v for p in _PLANS for k, v in p.ORACLES.items()}
