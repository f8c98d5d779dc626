"""What several tests need."""


def rows_of(df, *columns):
    """Rows as a sorted list of tuples, in the order of ``columns``."""
    return sorted((tuple(row) for row in df.select(*(columns or df.columns)).collect()), key=repr)
