"""Documents of settings: layers merged to any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def merged_layers(layers: DataFrame, key: str, layer: str, document: str) -> DataFrame:
    """key, path (array of names), value (JSON text): the leaves of each key's documents (JSON texts), merged layer on layer.

    A higher layer goes over a lower one. Objects merge by name, to any depth; anything else (lists,
    null, an empty object too) replaces what was there, and what lies below a replaced value is gone.
    A null document, one that is no JSON, or no object at its top, is no layer. One pass a level of
    depth; a group is what the layers of one key have at one path.
    """
    # Values are kept as JSON texts between the passes; what a text is, is told when it is read.
    top = layers.select(F.col(key).alias("__key"), F.col(layer).alias("__layer"), F.array().cast("array<string>").alias("__path"), F.to_json(F.try_parse_json(document)).alias("__j"))
    members = F.try_variant_get(F.parse_json("__j"), "$", "map<string,variant>")
    now, found = top.filter("__j LIKE '{%'"), None
    while True:
        here = Window.partitionBy("__key", "__path")  # a row a layer
        marked = now.withColumn("__inner", F.col("__j").startswith("{") & (F.col("__j") != "{}"))
        marked = marked.withColumn("__floor", F.max(F.when(~F.col("__inner"), F.col("__layer"))).over(here)).withColumn("__top", F.max("__layer").over(here))
        # Documents that are empty at their top say nothing; below it an empty object is a value.
        wins = (F.col("__layer") > F.col("__floor")) | F.col("__floor").isNull() | (F.col("__layer") == F.col("__top")) & ~F.col("__inner")
        kept = stored(marked.filter((F.size("__path") > 0) | F.col("__inner")).filter(wins | (F.size("__path") == 0)))
        leaves = kept.filter(~F.col("__inner")).select("__key", "__path", F.col("__j").alias("__value"))
        found = leaves if found is None else found.unionByName(leaves)
        deeper = kept.filter("__inner").select("__key", "__layer", "__path", F.explode(members).alias("__name", "__v"))
        now = stored(deeper.select("__key", "__layer", F.concat("__path", F.array("__name")).alias("__path"), F.coalesce(F.to_json("__v"), F.lit("null")).alias("__j")))
        if now.isEmpty():
            return found.select(F.col("__key").alias(key), F.col("__path").alias("path"), F.col("__value").alias("value"))
