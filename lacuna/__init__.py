"""Lacuna: a Spark-native engine that finds, merges and blanks out identifiers in free text."""

__all__ = ["ship", "spread"]


def ship(spark):
    """Let Python workers import this package when it is run from a checkout.

    Workers get PYTHONPATH from the session's environment; a cluster that installs the
    package (or submits it with --py-files) is not affected.
    """
    import os
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark


#: Bytes that keep a core busy; a table with less for each core is dealt out before costly row-by-row work.
SPREAD_BYTES = 64 << 20


def spread(df):
    """``df`` over all cores if it is small (a small file is one split, whatever the splits' size); a large one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(4 * cores) if size < cores * SPREAD_BYTES else df
