"""Following a branch: what each new generation changes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from packstrata.operators.merging import difference
from packstrata.sources.generations import Root, Store


def changes_since(store: Store, branch: str, generation: int, name: str, key: list[str], content: list[str], attributes: list[str]) -> Iterator[tuple[Root, DataFrame]]:
    """Each root after ``generation`` with the differences of a table from the root before it.

    Call again with the last generation it gave to go on; a table that a
    generation carried over unchanged costs no read.
    """
    before = None
    for root in store.history(branch):
        if before is not None and root.generation > generation and name in root.tables and root.tables[name] != before.tables.get(name):
            old = store.read(before, name) if name in before.tables else store.read(root, name).limit(0)
            yield root, difference(old, store.read(root, name), key, content, attributes)
        before = root
