"""Documents that others wrote: ideas and reports, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ideas(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, id, title, status, score, parent, generation of documents that are a list of ideas or an object that holds one as `ideas`.

    Entries that are no objects or have no id, and texts that are no such document, are left out.
    """
    v = F.try_parse_json(text)
    listed = F.coalesce(F.try_variant_get(v, "$.ideas", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    get = lambda name, kind: F.try_variant_get("x", f"$.{name}", kind).alias(name)
    each = texts.select(key, F.explode(listed).alias("x"))
    return each.select(key, get("id", "string"), get("title", "string"), get("status", "string"), get("score", "double"), get("parent", "string"), get("generation", "int")).filter("id IS NOT NULL")


def report_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, mod, file, line, pattern, severity, message: the findings of nested reports (mods, files, findings); a text that is none gives no rows."""
    doc = F.from_json(text, "mods map<string, map<string, array<struct<line:int,pattern:string,severity:string,message:string>>>>")
    files = texts.select(key, F.explode(doc["mods"]).alias("mod", "files")).select(key, "mod", F.explode("files").alias("file", "found"))
    return files.select(key, "mod", "file", F.explode("found").alias("f")).select(key, "mod", "file", "f.line", "f.pattern", "f.severity", "f.message")


def report_edits(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, applied, dropped, modified, failures: the totals of a report and how many files failed; null where it doesn't say."""
    doc = F.from_json(text, "edits struct<applied:bigint,dropped:bigint>, files_modified bigint, failures array<struct<file:string,error:string>>")
    return texts.select(key, doc["edits"]["applied"].alias("applied"), doc["edits"]["dropped"].alias("dropped"), doc["files_modified"].alias("modified"), F.coalesce(F.size(F.filter(doc["failures"], lambda f: f["file"].isNotNull())), F.lit(0)).alias("failures"))
