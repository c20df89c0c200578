"""Scans of source trees, archives and metadata (S1-S11). Nothing that is analysed is executed or written to disk."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.scalars import package_url

#: Languages by extension.
LANGUAGES = {
    "cs": "csharp", "vb": "vb", "fs": "fsharp", "fsi": "fsharp", "fsx": "fsharp", "r": "r", "rmd": "r", "qmd": "r",
    "c": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp",
}
BUILD_FOLDER = r"(^|/)(obj|bin)/"
#: What a package archive holds beside its content.
ARCHIVE_OWN = (".nuspec", "[Content_Types].xml")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    out = F.lit("text")
    for key, name in LANGUAGES.items():
        out = F.when(extension(path) == key, F.lit(name)).otherwise(out)
    return out


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of all files below a folder, or of one file. A path that doesn't exist raises."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan(files: DataFrame, kind: str = "dataflow") -> DataFrame:
    """Source files by the analysis that reads them, with their language.

    dataflow (S1) drops build folders and generated files; inventory (S2) drops obj always and bin for .NET languages;
    endpoints (S3) reads C# and VB; crypto (S4) drops node_modules too, and C sources and headers; frontend (S5) reads
    F#, R and C/C++ anywhere.
    """
    path, ext = F.col("path"), extension(F.col("path"))
    known = ext.isin(*LANGUAGES)
    built = path.rlike(BUILD_FOLDER)
    keep = {
        "dataflow": known & ~built & ~F.lower(path).rlike(r"\.g\.[a-z]+$"),
        "inventory": known & ~path.rlike(r"(^|/)obj/") & ~(path.rlike(r"(^|/)bin/") & ext.isin("cs", "vb", "fs")),
        "endpoints": ext.isin("cs", "vb") & ~built,
        "crypto": known & ~built & ~path.rlike(r"(^|/)node_modules/") & ~ext.isin("c", "h", "hpp", "hh"),
        "frontend": known & ~ext.isin("cs", "vb"),
    }[kind]
    return files.filter(keep).withColumn("language", language_of(path))


def project_assemblies(assemblies: DataFrame, project_names: DataFrame) -> DataFrame:
    """Assemblies (path, name) of the projects that metadata names; all, where it names none."""
    known = project_names.select(F.lower("name").alias("_n")).distinct()
    rows = assemblies.withColumn("_n", F.lower("name"))
    named = rows.join(known, "_n", "left_semi")
    none = known.agg(F.count("*").alias("_c")).filter("_c = 0")
    return named.unionByName(rows.join(F.broadcast(none), F.lit(True), "left_semi")).drop("_n")


def is_managed(content: bytes | None) -> bool:
    """Whether a portable executable has a header of the common language runtime; anything broken hasn't."""
    try:
        if content is None or content[:2] != b"MZ":
            return False
        at = struct.unpack_from("<I", content, 0x3C)[0]
        if content[at : at + 4] != b"PE\0\0":
            return False
        wide = struct.unpack_from("<H", content, at + 24)[0] == 0x20B
        directories = at + 24 + (112 if wide else 96)
        if struct.unpack_from("<I", content, directories - 4)[0] < 15:
            return False
        return struct.unpack_from("<I", content, directories + 14 * 8)[0] != 0
    except struct.error:
        return False


def with_managed(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with managed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "managed": [is_managed(x) for x in frame["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, managed boolean")


def archive_entries(files: DataFrame) -> DataFrame:
    """(archive, path, content) of package archives' entries, in memory; entries that climb out are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for entry in archive.infolist():
                            inside = entry.filename
                            own = inside.endswith(ARCHIVE_OWN) or inside.startswith(("package/", "_rels/"))
                            if not entry.is_dir() and not own and ".." not in inside.split("/") and not inside.startswith("/"):
                                rows.append((name, inside, archive.read(entry)))
                except zipfile.BadZipFile:
                    pass
                yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return files.select("path", "content").mapInPandas(run, "archive string, path string, content binary")


ASSETS = T.StructType([
    T.StructField("libraries", T.MapType(T.StringType(), T.StructType([T.StructField("type", T.StringType())]))),
    T.StructField("targets", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
        T.StructField("compile", T.MapType(T.StringType(), T.StringType())),
        T.StructField("runtime", T.MapType(T.StringType(), T.StringType())),
    ])))),
])


def packages(metadata: DataFrame) -> DataFrame:
    """(name, version, purl, assembly, alias) of the packages in metadata files (column text); broken files give none.

    The first entry of a package by file and key wins.
    """
    doc = metadata.withColumn("d", F.from_json("text", ASSETS)).select("path", "d.*")
    libraries = doc.select("path", F.explode("libraries").alias("key", "lib")).filter(F.lower("lib.type") == "package").select("path", "key")
    assets = doc.select("path", F.explode("targets").alias("tfm", "t")).select("path", F.explode("t").alias("key", "a"))
    files = assets.select("path", "key", F.explode(F.array_union(F.coalesce(F.map_keys("a.compile"), F.array()), F.coalesce(F.map_keys("a.runtime"), F.array()))).alias("file"))
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.(dll|exe)$", "")
    rows = libraries.join(files.withColumn("assembly", stem).filter(F.col("file").rlike(r"\.(dll|exe)$")).select("path", "key", "assembly").distinct(), ["path", "key"], "left")
    name, version = F.substring_index("key", "/", 1), F.substring_index("key", "/", -1)
    out = rows.select(name.alias("name"), version.alias("version"), package_url(name, version).alias("purl"), F.col("assembly"), F.substring_index(name, ".", -1).alias("alias"), "path", "key")
    w = Window.partitionBy(F.lower("name"), "assembly").orderBy("path", "key")
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "path", "key")
