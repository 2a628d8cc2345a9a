"""What several test files share."""


def rows(df, *order):
    """Rows as plain tuples, sorted by the given columns (or by all)."""
    keys = order or df.columns
    return [tuple(r) for r in sorted(df.collect(), key=lambda r: tuple(str(r[k]) for k in keys))]
