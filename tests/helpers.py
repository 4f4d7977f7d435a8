"""Helpers of the tests."""


def rows(df, *by):
    got = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(got, key=lambda r: tuple((r[c] is None, r[c]) for c in by)) if by else got
