"""Source trees: scanning, ignore rules, attribution to repositories, decoding and hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.filters import excluded, glob_pattern

# What a source scan takes, what it never enters, and its size limits in bytes.
SOURCE_EXTENSIONS = (
    ".java .kt .kts .groovy .gradle .scala .properties .yml .yaml .xml .sql .ts .tsx .js .jsx .mjs .cjs .vue .svelte "
    ".html .htm .css .scss .less .go .py .rb .cs .php .rs"
).split()
DOCUMENT_EXTENSIONS = ".md .markdown .rst .adoc .asciidoc .txt .docx .pdf .xlsx .csv .tsv".split()
IGNORED_DIRECTORIES = (
    ".git .svn .hg target build out dist bin node_modules .gradle .mvn .idea .vscode .settings __pycache__ .pytest_cache .venv venv obj"
).split()
SOURCE_LIMIT = 2_000_000
DOCUMENT_LIMIT = 25 * 1024 * 1024
BUILD_MARKERS = "pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts".split()


def ignore_rules(text: str) -> list[tuple[str, bool, bool]]:
    """(pattern, negated, directories only) of an ignore file, in order."""
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line
        only = body.endswith("/")
        body = (body[:-1] if only else body).strip()
        if body:
            out.append((body, negated, only))
    return out


def _rule_matches(path: Column, pattern: str) -> Column:
    """A rule against a relative path: from the root if anchored, else at any level."""
    bare = pattern.lstrip("/")
    whole = path.rlike(glob_pattern(bare)) | path.startswith(bare + "/")
    if pattern.startswith("/"):
        return whole
    return whole | F.regexp_extract(path, "([^/]*)$", 1).rlike(glob_pattern(bare)) | path.rlike(glob_pattern("*/" + bare)) | F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{bare}/")


def ignored(path: Column, rules: Sequence[tuple[str, bool, bool]], directory: bool = False) -> Column:
    """Whether the last rule that matches a relative path ignores it."""
    out = F.lit(False)
    for pattern, negated, only in rules:
        if only and not directory:
            continue
        out = F.when(_rule_matches(path, pattern), F.lit(not negated)).otherwise(out)
    return out


def pruned(path: Column, rules: Sequence[tuple[str, bool, bool]]) -> Column:
    """A file that lies under an ignored directory, or is ignored itself."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = F.when(F.size(parts) > 1, F.exists(above, lambda d: ignored(d, rules, True))).otherwise(False)
    return dirs | ignored(path, rules)


def keep(files: DataFrame, extensions: Sequence[str], limit: int, exclude: Sequence[str] = (), rules: Sequence[tuple[str, bool, bool]] = ()) -> DataFrame:
    """Files (path relative to the root, length, ...) that a scan takes."""
    under = F.exists(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda d: d.isin(IGNORED_DIRECTORIES))
    out = files.filter(tx.extension(F.col("path")).isin(list(extensions)) & (F.col("length") <= limit) & ~under)
    if exclude:
        out = out.filter(~excluded(F.col("path"), list(exclude)))
    return out.filter(~pruned(F.col("path"), rules)) if rules else out


def scan(spark: SparkSession, root: str, documents: bool = False, exclude: Sequence[str] = (), rules: Sequence[tuple[str, bool, bool]] = ()) -> DataFrame:
    """Files under a root: path, length, text, content_hash (SHA-1 of the text), blob_hash (SHA-256 of the bytes).

    The binary reader lists and reads in the executors; bytes of files that the filters drop are never decoded.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://", 1)[-1]
    path = F.regexp_replace("path", "^[a-z0-9+.-]+:/*(?=/)", "")
    kept = found.withColumn("path", tx.relative(path, base))
    kept = keep(kept, DOCUMENT_EXTENSIONS if documents else SOURCE_EXTENSIONS, DOCUMENT_LIMIT if documents else SOURCE_LIMIT, exclude, rules)
    text = tx.decode(F.col("content"))
    out = kept.select("path", "length", "content", text.alias("text"), F.sha2("content", 256).alias("blob_hash"))
    return out.withColumn("content_hash", tx.sha1_text(F.col("text")))


def repositories(files: DataFrame) -> DataFrame:
    """(path, repository): the outermost directory above a file with a build marker, else its first directory, else '.'."""
    here = files.select("path", tx.directory(F.col("path")).alias("dir"), tx.basename(F.col("path")).alias("name"))
    marked = here.filter(F.col("name").isin(BUILD_MARKERS)).select(F.col("dir").alias("repository")).distinct()
    parts = F.split("dir", "/")
    levels = F.concat(F.array(F.lit(".")), F.when(F.col("dir") != ".", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>")))
    above = here.select("path", "dir", F.posexplode(levels).alias("depth", "repository"))
    outer = above.join(marked, "repository").groupBy("path").agg(F.min_by("repository", "depth").alias("repository"))
    first = F.when(F.col("dir") == ".", ".").otherwise(F.split("dir", "/")[0])
    return here.join(outer, "path", "left").select("path", F.coalesce("repository", first).alias("repository"))


# Asset types by name and extension, the first that fits.
def asset_type(path: Column) -> Column:
    """Type of an asset by its path: test, build, document, config, source or other."""
    low, name, ext = F.lower(path), F.lower(tx.basename(path)), tx.extension(path)
    return (
        F.when(low.rlike(r"(^|/)(test|tests|__tests__|spec)/") | name.rlike(r"(^test_|_test\.|test\.|tests\.|\.spec\.|\.test\.)"), "test-source")
        .when(name.isin(BUILD_MARKERS + ["package.json", "pyproject.toml", "cargo.toml", "go.mod", "makefile", "dockerfile"]), "build")
        .when(ext.isin(DOCUMENT_EXTENSIONS), "document")
        .when(ext.isin(".yml", ".yaml", ".properties", ".toml", ".ini", ".xml", ".json"), "configuration")
        .when(ext.isin(SOURCE_EXTENSIONS), "source")
        .otherwise("other")
    )
