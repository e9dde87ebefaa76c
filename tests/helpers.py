"""Comparing a Spark result with SQL on the same tables."""

SF = "/root/testdata/sf0.001"


def canonical(frame, columns) -> list[tuple]:
    import pandas as pd

    def show(v):
        if v is None or v is pd.NA or v is pd.NaT:
            return "null"
        if isinstance(v, float):
            return "null" if v != v else f"{v + 0.0:.9g}"
        return str(v)

    return sorted(tuple(show(v) for v in row) for row in frame[columns].itertuples(index=False))


def same(df, connection, sql: str) -> None:
    ours, theirs = df.toPandas(), connection.sql(sql).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert canonical(ours, columns) == canonical(theirs, columns)
