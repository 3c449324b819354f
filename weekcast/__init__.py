"""weekcast: weekly sell-out and demand analytics as Spark DataFrame plans.

Sub-packages:

* ``functions``  Column-level helpers (ISO week arithmetic, clamps, guarded
  division, promotion price formulas).
* ``sources``    CSV / Parquet / JDBC readers and sinks.
* ``operators``  DataFrame -> DataFrame operators (cleaning, joins, aggregates,
  windows, gap fill, seasonality, clustering, forecasting, ML).
* ``plans``      Derived datasets over the provided tables and the registered
  end-to-end queries.
* ``streaming``  The weekly aggregation over a file stream.
"""

from weekcast.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
