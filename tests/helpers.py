from pyspark.sql import functions as F


def column_values(spark, values, make, type_name="string"):
    """What a column function makes of each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")
    rows = df.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def plan_of(df, mode="formatted"):
    """The physical plan as text."""
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()
