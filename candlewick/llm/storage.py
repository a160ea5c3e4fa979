"""Tables that cut lineage, written to the folder the cluster shares (``sources.scratch``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlewick.sources.scratch import written


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lost executor costs a reread, not a rerun."""
    return written(df, name)


def remove(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later step reads."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(hadoop).delete(path, True)
