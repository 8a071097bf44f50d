"""Source slices: a file with the files that it imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import scalar as S
from palisade.operators.reach import written
from palisade.sinks.folders import shared_folder

MOST_FILES, MOST_BYTES = 6, 16 << 10
# Extensions that an import may leave out, by the importing file's language.
PROBED = {"javascript": (".js", ".jsx", ".ts", ".tsx"), "typescript": (".ts", ".tsx", ".js", ".jsx")}


def js_imports(text: Column) -> Column:
    """Relative modules that a file imports, ascending."""
    a = F.regexp_extract_all(text, F.lit(r"from\s+['\"](\.[^'\"]+)['\"]"), F.lit(1))
    b = F.regexp_extract_all(text, F.lit(r"require\(\s*['\"](\.[^'\"]+)['\"]\s*\)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(a, b)))


def go_imports(text: Column) -> Column:
    """Packages that a file imports, ascending."""
    single = F.regexp_extract_all(text, F.lit(r'(?md)^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"'), F.lit(1))
    block = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)import\s*\((.*?)\)"), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit('"([^"]+)"'), F.lit(1))))
    return F.array_sort(F.array_distinct(F.concat(single, block)))


def go_package(text: Column) -> Column:
    return F.regexp_extract(text, r"(?md)^\s*package\s+(\w+)", 1)


def go_module(text: Column) -> Column:
    return F.regexp_extract(text, r"(?md)^module\s+(\S+)", 1)


def resolved(path: Column, module: Column) -> Column:
    """A relative module against its file's folder; null if it leaves the root."""
    folder = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    parts = F.filter(F.concat(folder, F.split(module, "/")), lambda x: ~x.isin("", "."))
    step = lambda acc, x: F.when(acc.isNull(), acc).when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def js_edges(files: DataFrame) -> DataFrame:
    """files (path, text) -> path, target: what each file imports, the first that exists of the name itself, the name
    with an extension, and an index file in it."""
    lang = S.language(F.col("path"))
    f = files.where(lang.isin(*PROBED)).select("path", lang.alias("_lang"), F.explode(js_imports(F.col("text"))).alias("_m"))
    base = f.withColumn("_base", resolved(F.col("path"), F.col("_m"))).where("_base is not null")
    exts = S.choose([(F.col("_lang") == k, F.array(*[F.lit(x) for x in v])) for k, v in PROBED.items()], F.array().cast("array<string>"))
    tries = F.concat(F.array(F.col("_base")), F.transform(exts, lambda e: F.concat("_base", e)), F.transform(exts, lambda e: F.concat(F.col("_base"), F.lit("/index"), e)))
    c = base.select("path", "_m", F.posexplode(tries).alias("_ord", "target"))
    found = c.join(files.select(F.col("path").alias("target")), "target", "left_semi")
    return found.groupBy("path", "_m").agg(F.min_by("target", "_ord").alias("target")).select("path", "target").distinct()


def go_edges(files: DataFrame, module: str) -> DataFrame:
    """path, target: siblings of the same package, then files of imported packages of the module; tests don't count."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    go = files.where("endswith(path, '.go') and not endswith(path, '_test.go')").select("path", folder.alias("dir"), go_package(F.col("text")).alias("pkg"), "text")
    b = go.select(F.col("path").alias("target"), "dir", "pkg")
    siblings = go.select("path", "dir", "pkg").join(b, ["dir", "pkg"]).where("path <> target").select("path", "target", F.lit("").alias("_via"))  # siblings come first
    via = go.select("path", F.explode(go_imports(F.col("text"))).alias("_via")).where((F.col("_via") == module) | F.col("_via").startswith(module + "/"))
    local = via.withColumn("dir", F.substring("_via", len(module) + 2, 1 << 20)).join(b.drop("pkg"), "dir").where("path <> target").select("path", "target", "_via")
    return siblings.union(local).groupBy("path", "target").agg(F.min("_via").alias("via"))


def supporting_language(path: Column) -> Column:
    """A supporting file's language, by its extension alone."""
    return F.when(F.contains(S.basename(path), F.lit(".")), S.language(F.concat(F.lit("x."), F.substring_index(path, ".", -1)))).otherwise("")


def supporting(edges: DataFrame, files: DataFrame, depth: int = MOST_FILES - 1, most_files: int = MOST_FILES - 1, most_bytes: int = MOST_BYTES) -> DataFrame:
    """primary, path, rank, text: files reached over edges (path, target, and via, which comes first in order) breadth
    first, each cut to what is left of the budget of bytes, most_files at most. Files that are missing or empty are
    passed over and lead nowhere. A cycle can bring back the primary."""
    has = files.where("octet_length(text) > 0").select(F.col("path").alias("target"))
    order = F.col("via") if "via" in edges.columns else F.lit("")
    step = edges.select("path", "target", F.array(order, F.col("target")).alias("_o")).join(has, "target", "left_semi")

    def cut(front: DataFrame) -> DataFrame:  # more than the budget of files is never used
        return front.withColumn("_r", F.row_number().over(Window.partitionBy("primary").orderBy("via"))).where(F.col("_r") <= most_files).drop("_r")

    # each level is written: the next one joins it and all before it, and none is computed again
    folder = shared_folder(edges.sparkSession, "slices")
    front = written(cut(step.select(F.col("path").alias("primary"), F.col("target").alias("path"), F.lit(1).alias("depth"), F.col("_o").alias("via"))), f"{folder}/1")
    seen = front
    for d in range(2, depth + 1):
        front = front.join(step, "path").select("primary", F.col("target").alias("path"), F.lit(d).alias("depth"), F.concat("via", F.col("_o")).alias("via"))
        front = written(cut(front.join(seen.select("primary", "path"), ["primary", "path"], "left_anti").groupBy("primary", "path").agg(F.min("depth").alias("depth"), F.min("via").alias("via"))), f"{folder}/{d}")
        seen = seen.union(front)
    w = Window.partitionBy("primary").orderBy("depth", "via")
    sized = seen.join(files.select("path", "text"), "path").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most_files)
    before = F.coalesce(F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = (F.lit(most_bytes) - before).cast("int")
    return sized.withColumn("_left", left).where("_left > 0").select("primary", "path", "rank", F.substring(F.col("text").cast("binary"), F.lit(1), F.col("_left")).cast("string").alias("text"))


def attribute(parsed: DataFrame) -> DataFrame:
    """parsed (primary, files: array of paths, location) -> with path: the first file that the location names in full or
    by its last part; else the primary."""
    by_path = F.filter("files", lambda p: F.contains(F.col("location"), p))
    by_name = F.filter("files", lambda p: F.contains(F.col("location"), S.basename(p)))
    return parsed.withColumn("path", F.coalesce(S.first(by_path), S.first(by_name), F.col("primary")))
