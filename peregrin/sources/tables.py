"""Schemas, readers and writers. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import document_text

SCHEMAS = {
    "destinations": "destination_id string, city string, country string, lat double, lon double, budget_level int, tags string",
    "poi": "poi_id string, destination_id string, name string, category string, lat double, lon double, avg_visit_minutes int, price_level int, popularity_score double, description string, open_hour int, close_hour int, wikidata_qid string, wikipedia_title string, sitelink_count int, monthly_pageviews int, description_source string, hours_source string, price_source string",
    "transport": "transport_id string, destination_id string, name string, type string, lat double, lon double",
    "demand_timeseries": "destination_id string, date date, visitors bigint",
    "user_survey": "archetype string, budget double, culture double, nature double, nightlife double, relax double, adventure double",
}
OSM_ELEMENT = "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A CSV table by its schema, with doubled quotes; the JSON tags of destinations become an array."""
    df = spark.read.schema(SCHEMAS[table]).option("header", True).option("escape", '"').option("multiLine", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    return df.withColumn("tags", decode_tags(F.col("tags"))) if table == "destinations" else df


def decode_tags(raw: Column) -> Column:
    return F.from_json(raw, "array<string>")


def read_guides(spark: SparkSession, path: str, named: str = r"([^/]+)\.txt$") -> DataFrame:
    """destination_id, text: one row per text file, named by the group of a pattern in its path (the file's stem)."""
    files = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_path", named, 1).alias("destination_id"), F.col("value").alias("text"))


def corpus(guides: DataFrame, places: DataFrame, destinations: DataFrame) -> DataFrame:
    """doc_id, type, destination_id, city, poi_id, name, text: guides and places as one table of documents."""
    city = destinations.select("destination_id", "city")
    g = guides.join(city, "destination_id", "left").select(F.concat(F.lit("guide::"), "destination_id").alias("doc_id"), F.lit("guide").alias("type"), "destination_id", "city", "text")
    p = places.join(city, "destination_id", "left").select(F.concat(F.lit("poi::"), F.col("poi_id")).alias("doc_id"), F.lit("poi").alias("type"), "destination_id", "city", "poi_id", "name", document_text(F.col("name"), F.col("category"), F.col("city"), F.col("description")).alias("text"))
    return p.unionByName(g, allowMissingColumns=True)


def write_edges(edges: DataFrame, path: str) -> None:
    """The graph's edges as Parquet, a folder per relation, which readers prune."""
    edges.write.mode("overwrite").partitionBy("relation").parquet(path)


def read_edges(spark: SparkSession, path: str, *relations: str) -> DataFrame:
    """The edges that write_edges wrote, of the relations named or of all."""
    edges = spark.read.parquet(path)
    return edges.where(F.col("relation").isin(*relations)) if relations else edges


def store_graph(nodes: DataFrame, edges: DataFrame, name: str, path: str | None = None, buckets: int = 32) -> None:
    """Nodes (id, type and more) and edges (src, dst, relation and more) as two tables, name_nodes and name_edges, in buckets of id and src.

    Nodes and the edges that leave them lie in buckets of one number, sorted, so
    a step from nodes along their edges joins without moving the edges, however
    often it is made. Tables of that name are replaced. They lie under path, or
    else in the warehouse.
    """
    for kind, rows, key in (("nodes", nodes, "id"), ("edges", edges, "src")):
        writer = rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
        (writer if path is None else writer.option("path", f"{path}/{kind}")).saveAsTable(f"{name}_{kind}")


def stored_nodes(spark: SparkSession, name: str, *types: str) -> DataFrame:
    nodes = spark.table(f"{name}_nodes")
    return nodes.where(F.col("type").isin(*types)) if types else nodes


def walk(spark: SparkSession, name: str, start: DataFrame, *relations: str) -> DataFrame:
    """start, dst: the nodes that a path from a start node (id) along edges of these relations, one after the other, ends at; each path is a row."""
    at = start.select(F.col("id").alias("start"), F.col("id").alias("at"))
    for relation in relations:
        edges = spark.table(f"{name}_edges").where(F.col("relation") == relation).select("src", "dst")
        at = at.join(edges, F.col("at") == F.col("src")).select("start", F.col("dst").alias("at"))
    return at.withColumnRenamed("at", "dst")


def walk_counts(spark: SparkSession, name: str, start: DataFrame, *relations: str) -> DataFrame:
    """start, dst, paths: the ends that walk gives and how many paths lead there; paths that meet at a node go on as one row with their number."""
    at = start.select(F.col("id").alias("start"), F.col("id").alias("at"), F.lit(1).cast("long").alias("paths"))
    for relation in relations:
        edges = spark.table(f"{name}_edges").where(F.col("relation") == relation).select("src", "dst")
        at = at.join(edges, F.col("at") == F.col("src")).groupBy("start", F.col("dst").alias("at")).agg(F.sum("paths").alias("paths"))
    return at.withColumnRenamed("at", "dst")


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet, CSV with a header, or text (one string column)."""
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "csv": lambda p: writer.option("header", True).option("escape", '"').csv(p), "text": writer.text}[form](path)
