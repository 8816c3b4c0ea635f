"""Report plans (``reports``), their registry (``catalog``) and the DuckDB oracle (``oracle``)."""
