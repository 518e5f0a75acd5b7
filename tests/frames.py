"""Helpers of the tests. A module of its own, since every folder's ``conftest`` has that one name."""


def rows(df):
    """All rows as plain tuples, sorted by their text."""
    return sorted((tuple(r) for r in df.collect()), key=str)
