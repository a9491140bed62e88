"""What tests share."""

DATA = "/root/testdata/sf0.001"


def alike(got, want):
    """Whether two pandas tables hold the same rows in any order."""
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def plain(x):
        x = x[columns].copy()
        for k in columns:
            if x[k].dtype.kind in "fO":
                try:
                    x[k] = x[k].astype(float).round(6) + 0.0
                except (TypeError, ValueError):
                    pass
        return x.sort_values(columns).reset_index(drop=True).astype(str)

    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    unlike = (a != b).any(axis=1)
    assert not unlike.any(), f"{int(unlike.sum())} rows differ: {a[unlike].head(2).to_dict('records')} {b[unlike].head(2).to_dict('records')}"
