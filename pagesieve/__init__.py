"""Web-page audit engine: DataFrame operators over page corpora, fetch logs and snapshots."""
