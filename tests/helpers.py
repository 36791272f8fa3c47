"""Helpers shared by the tests."""


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all when none)."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
