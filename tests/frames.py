"""What several tests do with frames."""


def rows(df, *columns):
    """Collected rows as sorted tuples."""
    wanted = columns or df.columns
    return sorted(tuple(r[c] for c in wanted) for r in df.collect())
