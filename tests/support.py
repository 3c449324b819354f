"""Paths and row helpers of the tests (fixtures are in the ``conftest`` modules)."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_SMALL = "/root/testdata/sf0.001"


def rows(df, *cols):
    """Sorted list of tuples of ``cols`` (all columns when omitted)."""
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def executed_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
