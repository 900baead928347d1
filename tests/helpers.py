"""Helpers for the tests, in a module whose name no other test folder has."""


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(row) for row in df.collect()), key=repr)
