"""Column names of user frames: arguments may be in any case."""

from __future__ import annotations

from pyspark.sql import DataFrame


def resolve(df: DataFrame, name: str) -> str:
    """The frame's own spelling of ``name``; an unknown name is an error."""
    if name in df.columns:
        return name
    found = [c for c in df.columns if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"column {name!r}: {'ambiguous' if found else 'missing'} in {df.columns}")
    return found[0]


def resolve_all(df: DataFrame, names) -> list[str]:
    return [resolve(df, n) for n in names]


def resolve_keys(df: DataFrame, values: dict | None) -> dict:
    """A dict keyed by column name, with the frame's own spelling; names that the frame
    lacks stay (they name no column to fill)."""
    have = {c.lower(): c for c in df.columns}
    return {have.get(k.lower(), k): v for k, v in (values or {}).items()}
