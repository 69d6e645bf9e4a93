"""Row groups of Parquet tables, for sums whose last digit counts: engines that read a table's row groups side by side add up each by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a file that share a key of the look-up, as a power of two.
_SPAN = 16


def _spans(df: DataFrame) -> list[tuple[str, int, int, int, int]]:
    """file, key, first row, row behind the last, and number of every row group, by file and place; a row for each key that a group's rows have. Only footers are read."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    parquet, out, number = jvm.org.apache.parquet.hadoop, [], 0
    for file in sorted(df.inputFiles()):
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)), conf))
        try:
            sizes = [g.getRowCount() for g in reader.getRowGroups()]
        finally:
            reader.close()
        low = 0
        for n in sizes:
            out += [(file.replace(":///", ":/"), key, low, low + n, number) for key in range(low >> _SPAN, (low + n - 1 >> _SPAN) + 1)]
            low, number = low + n, number + 1
    return out


def with_row_group(df: DataFrame) -> DataFrame:
    """A table as it was read from Parquet, with row_group: the number of each row's row group, counted over the files by name. Rows stay in the order of their file."""
    spans = F.broadcast(df.sparkSession.createDataFrame(_spans(df), "_file string, _key long, _low long, _high long, row_group long"))
    rows = df.select("*", F.replace("_metadata.file_path", F.lit(":///"), F.lit(":/")).alias("_at"), F.col("_metadata.row_index").alias("_row"))
    here = (F.col("_file") == F.col("_at")) & (F.col("_key") == F.shiftright("_row", _SPAN)) & F.col("_row").between(F.col("_low"), F.col("_high") - 1)
    return rows.join(spans, here, "left").select(*df.columns, "row_group")


def mean_by_row_group(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, mean (null without values): each row group is added up as one running sum, and these sums in the order of the groups. df: rows of with_row_group."""
    parts = df.groupBy(key, "row_group").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("s"), F.count(value).alias("n"))
    sums = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row_group", "s"))).alias("parts"), F.sum("n").alias("n"))
    return sums.select(key, (F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["s"]) / F.nullif("n", F.lit(0))).alias("mean"))
