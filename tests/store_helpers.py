"""What the tests of the store share."""

DATA = "/root/testdata/sf0.001"


def rows(df_or_rel):
    """Rows with columns in order of name, sorted."""
    columns = df_or_rel.columns
    order = [columns.index(c) for c in sorted(columns)]
    got = df_or_rel.fetchall() if hasattr(df_or_rel, "fetchall") else [tuple(r) for r in df_or_rel.collect()]
    return sorted((tuple(r[i] for i in order) for r in got), key=repr)
