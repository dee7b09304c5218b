"""Mods and benches on disk: which script belongs to what, metadata, encodings, bench files, bucketed settings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold no mods.
SKIPPED = ("__pycache__", "backup", "backups")


def relative(path: Column, root: str) -> Column:
    """A file's path below `root`, with forward slashes."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[a-z]+:/+", "/")
    base = root.replace("\\", "/").split(":", 1)[-1]
    return F.substring(clean, len("/" + base.strip("/") + "/") + 1, 1 << 30)


def mod_of(rel: Column, root_name: str) -> Column:
    """The mod a script belongs to by its path below the root, or null.

    The root may be the game's data folder itself, or a mod; else a mod is a folder, or a folder one
    level below that has no scripts of its own. Hidden and backup folders hold no mods.
    """
    parts = F.split(rel, "/")
    is_script = rel.rlike(r"\.(lua|script)$")
    skipped = parts[0].startswith(".") | parts[0].isin(*SKIPPED)
    if root_name == "gamedata":
        return F.when(is_script & (parts[0] == "scripts"), F.lit("(root)"))
    two = lambda i: (parts[i] == "gamedata") & (parts[i + 1] == "scripts")
    deep = F.when(two(2), F.concat_ws("/", parts[0], parts[1]))
    return F.when(is_script, F.when(two(0), F.lit(root_name)).when(~skipped, F.when(two(1), parts[0]).otherwise(deep)))


def discovered(files: DataFrame, root: str) -> DataFrame:
    """(mod, path) of all scripts of mods, once each, in order; a nested mod counts only where the folder above has no scripts of its own."""
    rel = relative(F.col("path"), root)
    named = files.select("path", mod_of(rel, root.rstrip("/").rsplit("/", 1)[-1]).alias("mod"), F.split(rel, "/")[0].alias("top")).filter("mod IS NOT NULL").distinct()
    own = named.filter("mod = top").select("top").distinct()
    nested = named.filter("mod != top AND instr(mod, '/') > 0").join(own, "top", "left_anti")
    return named.filter("mod = top OR instr(mod, '/') = 0").unionByName(nested.select("path", "mod", "top")).select("mod", "path").orderBy("mod", "path")


def direct(files: DataFrame) -> DataFrame:
    """All scripts of any tree, or one file, as one pseudo-mod."""
    return files.filter(F.col("path").rlike(r"\.(lua|script)$")).select(F.lit("(direct)").alias("mod"), "path").distinct().orderBy("path")


def find_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modified, content of the scripts below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{lua,script}").load(folder)


def mod_info(files: DataFrame) -> DataFrame:
    """mod, name, version, author from the texts (mod, file, text) of meta.ini and modinfo.txt; the latter's first line names the mod if it is there."""
    key = lambda k: F.max(F.when(F.col("file") == "meta.ini", F.nullif(F.regexp_extract("text", rf"(?m)^{k}=[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))))
    title = F.max(F.when(F.col("file") == "modinfo.txt", F.trim(F.split("text", r"\r?\n")[0])))
    return files.groupBy("mod").agg(F.coalesce(title, key("name"), F.first("mod")).alias("name"), key("version").alias("version"), key("author").alias("author"))


def encoding_of(raw: bytes) -> str:
    """utf-8-sig by its mark, utf-8 if it decodes, cp1251 if that gives Cyrillic letters, else latin-1."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    for name in ("utf-8", "cp1251"):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        if name == "utf-8" or any("Ѐ" <= c <= "ӿ" for c in text):
            return name
    return "latin-1"


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """The rows with `encoding` and `text`."""
    names = [c for c in files.columns if c != content]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != content), "encoding string", "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column(len(names)).to_pylist()]
            kinds = [encoding_of(x) for x in raw]
            texts = [x.decode(k) for x, k in zip(raw, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=[*names, "encoding", "text"])

    return files.select(*names, content).mapInArrow(run, schema)


def bench_cases(files: DataFrame) -> DataFrame:
    """(path, meta, sections, fault) of bench files (path, text) whose lines `-- @name rest` set a value or open a section.

    Several notes add up. Faults: an unknown name, another one given twice, a missing section, a missing pattern or title.
    """
    #: Fixed values of the format.
    sections, metas = ("setup", "original", "rewrite", "sink"), ("pattern", "title", "status", "n", "doc", "notes", "iters", "doc_at", "corpus_k", "corpus_src")
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    marked = lines.withColumn("name", F.nullif(F.regexp_extract("line", r"^\s*--\s*@(\w+)", 1), F.lit(""))).withColumn("rest", F.trim(F.regexp_extract("line", r"^\s*--\s*@\w+\s*(.*)$", 1)))
    opened = F.when(F.col("name").isin(*sections), F.col("name"))
    from pyspark.sql import Window

    upto = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("section", F.last(opened, ignorenulls=True).over(upto))
    own = F.when(opened.isNotNull(), F.nullif("rest", F.lit(""))).when(F.col("name").isNull(), F.col("line"))
    texts = placed.filter("section IS NOT NULL").select("path", "section", "at", own.alias("line")).groupBy("path", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"))
    bodies = texts.groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "body")))).alias("sections"))
    values = placed.filter(F.col("name").isin(*metas)).groupBy("path", "name").agg(F.sort_array(F.collect_list(F.struct("at", "rest"))).alias("v"))
    value = F.when(F.col("name") == "notes", F.array_join(F.transform("v", lambda x: x["rest"]), " ")).otherwise(F.element_at("v", -1)["rest"])
    meta = values.groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", value.alias("value"))))).alias("meta"))
    strange = placed.filter(F.col("name").isNotNull() & ~F.col("name").isin(*sections, *metas)).groupBy("path").agg(F.min_by("name", "at").alias("strange"))
    again = placed.filter(F.col("name").isin(*sections, *metas) & (F.col("name") != "notes")).groupBy("path", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("path").agg(F.min("name").alias("again"))
    joined = files.select("path").join(meta, "path", "left").join(bodies, "path", "left").join(strange, "path", "left").join(again, "path", "left")
    lacking = lambda names, bag: F.array_join(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: ~F.coalesce(F.array_contains(F.map_keys(bag), n), F.lit(False))), ", ")
    no_section, no_meta = lacking(sections[1:], "sections"), lacking(("pattern", "title"), "meta")
    fault = F.when(F.col("strange").isNotNull(), F.concat(F.lit("unknown directive @"), "strange")).when(F.col("again").isNotNull(), F.concat(F.lit("directive given twice @"), "again")).when(no_section != "", F.concat(F.lit("missing section "), no_section)).when(no_meta != "", F.concat(F.lit("missing @"), no_meta))
    return joined.select("path", "meta", "sections", fault.alias("fault"))


def keyed_rows(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of lines `N\\field=value` (line): one a number, in order, missing fields empty."""
    shape = r"^(\d+)\\(\w+)=(.*)$"
    parts = lines.filter(F.col("line").rlike(shape)).select(F.regexp_extract("line", shape, 1).cast("int").alias("row"), F.regexp_extract("line", shape, 2).alias("field"), F.regexp_extract("line", shape, 3).alias("value"))
    return parts.groupBy("row").agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col("value"))), F.lit("")).alias(f) for f in fields])


def counters(text: Column, labels: list[str]) -> Column:
    """A map of the numbers that follow `label:` in a text; labels that are not there are left out."""
    pairs = F.array(*[F.struct(F.lit(x).alias("k"), F.nullif(F.regexp_extract(text, rf"(?mi)^\s*{x}\s*:\s*(\d+)", 1), F.lit("")).cast("long").alias("v")) for x in labels])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def snapshot(files: DataFrame) -> DataFrame:
    """path, bytes, sha256 of each file (path, content), and the digest of the tree: of all paths and digests in order."""
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def restored(manifest: DataFrame, kinds: list[str] | None = None, paths: DataFrame | None = None) -> DataFrame:
    """The entries of a snapshot (path, kind, ...) to bring back: those of the kinds (null: all), of the paths asked for, if any; of a path that comes twice the one of the newest `taken`."""
    rows = manifest if kinds is None else manifest.filter(F.col("kind").isin(*kinds))
    rows = rows if paths is None else rows.join(paths.select("path").distinct(), "path", "left_semi")
    others = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*others), F.struct("taken", *[c for c in others if c != "taken"])).alias("e")).select("path", "e.*")


def tree_digest(entries: DataFrame, by: list[str]) -> DataFrame:
    """One digest a tree: of the digests of its files dealt to 4,096 parts by the first three digits of the path's SHA-256, each over its paths and digests in order.

    So a tree of any number of files brings at most 4,096 digests to its row.
    """
    part = F.substring(F.sha2("path", 256), 1, 3)
    joined = lambda a, b: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(a, b))), lambda x: F.concat_ws(" ", x[a], x[b])), "\n")
    parts = entries.groupBy(*by, part.alias("__part")).agg(F.sha2(joined("path", "sha256"), 256).alias("__digest"), F.count(F.lit(1)).alias("__files"))
    return parts.groupBy(*by).agg(F.sha2(joined("__part", "__digest"), 256).alias("digest"), F.sum("__files").alias("files"))
