"""What several test modules of the point cloud share."""


def rows(df):
    """Rows as a sorted list of tuples, NULL first and NaN as text."""
    plain = [tuple("NaN" if v != v else v for v in r) for r in df.collect()]
    return sorted(plain, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def plan(df, mode="formatted"):
    """Text of the physical plan, with the pushed filters in full."""
    jvm = df.sparkSession._jvm
    explain = jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(explain)
