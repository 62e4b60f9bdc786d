"""All queries of the time-series engine and their SQL."""

from __future__ import annotations

from chronofold.plans import classification, cleaning, extras, morphology, periods, recommendation, shapes, spaces

_PARTS = [cleaning, periods, recommendation, morphology, shapes, classification, spaces, extras]


def queries() -> dict:
    return {k: v for p in _PARTS for k, v in p.QUERIES.items()}


def oracles() -> dict:
    return {k: v for p in _PARTS for k, v in p.ORACLES.items()}
