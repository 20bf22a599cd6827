"""Managing files of a corpus: names, ordinals, versions, conversion status, incremental exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as S


def ordinal_name(k: Column, total: int, group: int = 10_000) -> Column:
    """<first>-<last>/<zero-padded ordinal>: the folder of the group and the file's name in it."""
    digits = len(str(total))
    pad = lambda c: F.lpad(c.cast("string"), digits, "0")
    first = k - F.pmod(k, F.lit(group))
    return F.concat(pad(first), F.lit("-"), pad(F.least(first + group, F.lit(total)) - 1), F.lit("/"), pad(k))


def title_and_version(name: Column) -> tuple[Column, Column]:
    """'title.3' as (title, 3); without a number, version 0."""
    pattern = r"^(.*)\.([1-9][0-9]*)$"
    hit = name.rlike(pattern)
    return F.when(hit, F.regexp_extract(name, pattern, 1)).otherwise(name), F.when(hit, F.regexp_extract(name, pattern, 2).cast("int")).otherwise(0)


def versioned(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df and version: _v0, _v1 and so on for names met more than once, else empty."""
    n = F.count("*").over(Window.partitionBy(*by))
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("version", F.when(n > 1, F.concat(F.lit("_v"), k.cast("string"))).otherwise(""))


def lowest_versions(df: DataFrame, by: list[str], version: str, value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(value, version).alias(value), F.min(version).alias(version))


def stem(path: Column) -> Column:
    """The last part of a path without its ending; endings of scores go one after the other."""
    last = F.substring_index(path, "/", -1)
    return F.regexp_replace(F.regexp_replace(last, r"\.mxl$", ""), r"\.musicxml$", "")


def conversion(listing: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """listing and backend, status: which backend's output a file has (the first one's before the second one's)."""
    a, b = first.select("name", F.lit(True).alias("a")).distinct(), second.select("name", F.lit(True).alias("b")).distinct()
    rows = listing.join(a, "name", "left").join(b, "name", "left")
    backend = F.when(F.col("a"), "MS").when(F.col("b"), "LP").otherwise("NA")
    return rows.withColumns({"backend": backend, "status": F.when(backend == "NA", "error").otherwise("converted")}).drop("a", "b")


def orphans(outputs: DataFrame, listing: DataFrame) -> DataFrame:
    return outputs.join(listing, "name", "left_anti")


def by_title(songs: DataFrame, titles: DataFrame) -> DataFrame:
    """songs whose title, without accents, is among the titles."""
    want = titles.select(S.folded(F.col("title")).alias("folded")).distinct()
    return songs.withColumn("folded", S.folded(F.col("title"))).join(want, "folded", "left_semi").drop("folded")


def totals(files: DataFrame) -> DataFrame:
    """n_file, n_artist, n_song (distinct artist and title)."""
    return files.agg(F.count("*").alias("n_file"), F.count_distinct("artist").alias("n_artist"), F.count_distinct("artist", "title").alias("n_song"))


def lookup(paths: DataFrame, column: str, part: str) -> DataFrame:
    """The first path, in order, that holds this part, whatever its case; none if there is none."""
    return paths.where(F.contains(F.lower(column), F.lit(part.lower()))).orderBy(column).limit(1)


def paired(first: DataFrame, second: DataFrame, by: str) -> DataFrame:
    """by, stem, first, second: files of two formats with the same stem. Both: by, path."""
    of = lambda df, name: df.select(by, stem(F.col("path")).alias("stem"), F.col("path").alias(name))
    return of(first, "first").join(of(second, "second"), [by, "stem"])


def write_vocabulary(vocab: DataFrame, folder: str) -> None:
    """One JSON line a token (id, tok, tok_type), in the order of ids."""
    vocab.select("id", "tok", "tok_type").coalesce(1).sortWithinPartitions("id").write.mode("overwrite").json(folder)


def read_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("id int, tok string, tok_type string").json(folder)


def write_samples(samples: DataFrame, folder: str) -> None:
    """Generated texts with their prompts and parameters, one JSON line each."""
    samples.write.mode("overwrite").json(folder)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A side table as CSV with a header, strictly by its schema."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def kept(df: DataFrame, folder: str) -> DataFrame:
    """df, written to a folder once and read from there afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
