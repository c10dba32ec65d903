"""pagemill: a PySpark engine that turns raw web pages into searchable, checkable study material."""
