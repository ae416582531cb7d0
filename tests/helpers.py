"""Paths and comparisons shared by the tests."""

SF = "/root/testdata/sf0.001"
SF_CORRECT = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df):
    """Rows as sorted tuples of strings, columns by name."""
    cols = sorted(df.columns)
    show = lambda x: f"{x:.9f}" if isinstance(x, float) else str(x)
    return cols, sorted(tuple(show(x) for x in row) for row in df[cols].itertuples(index=False, name=None))
