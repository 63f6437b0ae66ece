"""Sources and sinks: driver tables, fixtures mapping, CSV/JSON/Parquet I/O."""
