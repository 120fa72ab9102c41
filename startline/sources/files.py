"""Files and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from startline.functions.markup import gunzipped

# Columns of an organiser seed, and of a bulk feed.
SEED_COLUMNS = ("name", "listing_urls", "homepage_url", "discovered_via", "sitemap_url", "handler", "handler_params", "registrator")
FEED_COLUMNS = ("Event", "Latitude", "Longitude", "Country", "State", "County", "Status", "Cancellations", "Website")


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """Organiser seed rows; listing_urls from its JSON array, empty if blank."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in SEED_COLUMNS])
    rows = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=True, enforceSchema=False)
    urls = F.coalesce(F.from_json("listing_urls", "array<string>"), F.array().cast("array<string>"))
    return rows.withColumns({"listing_urls": urls, "handler": F.coalesce(F.nullif("handler", F.lit("")), F.lit("default")), "registrator": registrator(F.col("registrator")), "handler_params": handler_params(F.col("handler_params"), F.col("sitemap_url"))})


def registrator(c: Column) -> Column:
    """Who answers for a row: `bot` where nobody is named."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("bot"))


def handler_params(params: Column, sitemap_url: Column) -> Column:
    """The JSON object as a map, with the sitemap over its own entry; null, not empty, if there is nothing."""
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce(F.from_json(params, "map<string,string>"), none)
    with_sitemap = F.when(F.length(sitemap_url) > 0, F.map_concat(F.map_filter(own, lambda k, _: k != "sitemap_url"), F.create_map(F.lit("sitemap_url"), sitemap_url))).otherwise(own)
    return F.when(F.size(with_sitemap) > 0, with_sitemap)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store Spark reads; an error to look is an error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_feed(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of a bulk feed (tab-separated, with header); None if there is none or its header is another's.

    That is not the same as empty. Anything else that keeps a file from being read is raised.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in FEED_COLUMNS])
    if not exists(spark, path):
        return None
    header = spark.read.text(path).limit(1).collect()
    if not header or not set(FEED_COLUMNS) & set(header[0][0].split("\t")):
        return None
    named = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"')
    return named.select(*[(F.col(f.name) if f.name in named.columns else F.lit(None)).cast("string").alias(f.name) for f in schema])


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """path and xml of sitemap files, gunzipped where needed; xml is null for a file that cannot be read."""
    return spark.read.format("binaryFile").load(path).select("path", gunzipped("content").alias("xml"))


def decode_message(body: Column, schema: str) -> Column:
    """The JSON of a queue message in its envelope {"message": {"data": base64}}; null if the envelope is wrong."""
    data = F.get_json_object(body, "$.message.data")
    return F.from_json(F.try_to_binary(data, F.lit("base64")).cast("string"), schema)


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, data_type, nullable, position of every column of the tables by name; at least one table."""
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, n) for t, df in tables.items() for n, f in enumerate(df.schema.fields)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean, position int")
