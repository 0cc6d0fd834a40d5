"""PySpark engine for procurement notices: ingestion, matching, documents, corpus hygiene."""
