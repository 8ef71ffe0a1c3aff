"""Reading and writing: raw CSV zone, processed Parquet zone, warehouse tables, catalog, JSON."""
