"""Operators for training-data pipelines. Nothing else in the library imports this package."""

from __future__ import annotations


def queries() -> dict:
    from . import contamination, encoding, language, mixing, names, ocr_noise, quality, subjects, truncation

    out: dict = {}
    for module in (encoding, subjects, truncation, language, ocr_noise, names, contamination, mixing, quality):
        out.update(module.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return dict(oracles.SQL)
