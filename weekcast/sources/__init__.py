from weekcast.sources.files import from_rows, load_csv, rejects, require_columns, typed
from weekcast.sources.jdbc import read_options, read_table, write_options, write_table
from weekcast.sources.sinks import materialize, write_csv, write_parquet
from weekcast.sources.tables import load

__all__ = ["from_rows", "load_csv", "rejects", "require_columns", "typed", "read_options",
           "read_table", "write_options", "write_table", "materialize", "write_csv",
           "write_parquet", "load"]
