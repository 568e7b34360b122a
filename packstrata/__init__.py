"""packstrata: a PySpark engine for versioned, content-addressed data.

Relations (nodes, entries, chunks, packs, journals, snapshots) are DataFrames;
operators are functions from DataFrames to DataFrames; nothing here schedules
work itself.
"""

__version__ = "0.1.0"
