"""Files as content-addressed blobs: reading, filtering, fingerprints, reuse of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import is_hidden, is_sensitive, matches_any

# Media types and parsers by extension; folders never read; the largest file parsed.
MEDIA_TYPES = {
    "md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html", "jsonl": "application/x-ndjson", "ndjson": "application/x-ndjson",
    "json": "application/json", "txt": "text/plain", "csv": "text/csv", "tsv": "text/tab-separated-values", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg",
}
PARSERS = {
    "text/markdown": "markdown", "text/html": "html", "application/x-ndjson": "jsonl", "application/json": "plain-text", "text/plain": "plain-text",
    "text/csv": "plain-text", "text/tab-separated-values": "plain-text",
}
DEFAULT_EXCLUDES = ["**/.git/**", "**/node_modules/**", "**/.obsidian/**", "**/.DS_Store"]
PARSE_LIMIT = 25 * 1024 * 1024


def lookup(key: Column, table: dict[str, str], other: str | None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(other))


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def media_type(path: Column | str) -> Column:
    return lookup(extension(path), MEDIA_TYPES, "application/octet-stream")


def parser_id(media: Column, size: Column) -> Column:
    """The parser that takes a file; null: skipped."""
    return F.when(size <= PARSE_LIMIT, lookup(media, PARSERS, None))


def source_kind(uri: str) -> str:
    """How a source is read: ``-`` is standard input, http and https are pages, else a path."""
    if uri == "-":
        return "stdin"
    return "web" if uri.split("://")[0] in ("http", "https") else "path"


def read_files(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None, markdown_only: bool = False) -> DataFrame:
    """logical_path, content, size_bytes, mtime, media_type of a file or of a folder's files, without the excluded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = F.lit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/")
    full = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    files = files.withColumn("logical_path", F.when(F.startswith(full, base), F.substr(full, F.length(base) + 1)).otherwise(F.element_at(F.split(full, "/"), -1)))
    kept = ~matches_any("logical_path", DEFAULT_EXCLUDES if exclude is None else exclude)
    if include:
        kept = kept & matches_any("logical_path", include)
    if markdown_only:
        kept = kept & (extension("logical_path") == "md")
    return files.where(kept).select("logical_path", "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), media_type("logical_path").alias("media_type"))


def read_text(spark: SparkSession, name: str, text: str) -> DataFrame:
    """Standard input or other text at hand as a one-file source."""
    rows = spark.createDataFrame([(name, bytearray(text.encode()))], "logical_path string, content binary")
    return rows.select("*", F.length("content").cast("long").alias("size_bytes"), F.current_timestamp().alias("mtime"), media_type("logical_path").alias("media_type"))


def read_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages as files: the url's path names them."""
    path = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), F.lit("")), F.lit("page"))
    content = F.encode("html", "utf-8")
    return pages.select(path.alias("logical_path"), content.alias("content"), F.length(content).cast("long").alias("size_bytes"), F.lit("text/html").alias("media_type"))


def read_source(spark: SparkSession, uri: str, kind: str | None = None, text: str | None = None, pages: DataFrame | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The entries of a source: logical_path, content, size_bytes, media_type.

    ``kind``: file, markdown, directory, obsidian, web, text or jsonl; by default what the uri says.
    Text comes with the call, as from standard input. Pages are those of ``pages`` (url, html) that
    have the uri, or lie below it.
    """
    found = kind or {"stdin": "text", "web": "web", "path": "directory"}[source_kind(uri)]
    if found == "text":
        if text is None:
            raise ValueError("a source of text needs its text")
        rows = read_text(spark, "stdin.txt" if uri == "-" else uri, text)
    elif found == "web":
        if pages is None:
            raise ValueError("a source of pages needs the fetched pages")
        rows = read_pages(pages.where((F.col("url") == uri) | F.startswith(F.col("url"), F.lit(uri.rstrip("/") + "/"))))
    elif found in ("file", "markdown", "directory", "obsidian", "jsonl"):
        rows = read_files(spark, uri, include, exclude, markdown_only=found in ("markdown", "obsidian"))
        if found == "jsonl":
            rows = rows.where(F.col("media_type") == MEDIA_TYPES["jsonl"])
    else:
        raise ValueError(f"no source of kind {found}")
    return rows.select("logical_path", "content", "size_bytes", "media_type")


def settled(now: DataFrame, before: DataFrame, at, seconds: int = 2) -> DataFrame:
    """Files of a scan (logical_path, size_bytes, mtime) that a scan before saw alike and that nobody has written for ``seconds`` at the time ``at``."""
    old = before.select("logical_path", F.col("size_bytes").alias("s"), F.col("mtime").alias("m"))
    quiet = F.unix_micros(F.lit(at).cast("timestamp")) - F.unix_micros("mtime") >= seconds * 1_000_000
    return now.join(old, "logical_path").where((F.col("size_bytes") == F.col("s")) & (F.col("mtime") == F.col("m")) & quiet).drop("s", "m")


def source_identity(spec: Column, name: Column) -> Column:
    """The same source added again has the same id."""
    return F.concat(F.lit("source:src_"), F.substring(F.sha2(F.to_json(F.struct(spec.alias("spec"), name.alias("name"))), 256), 1, 32))


def blobs(entries: DataFrame) -> DataFrame:
    """One row per content: sha256, size_bytes, refs."""
    return entries.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.max(F.length("content")).cast("long").alias("size_bytes"), F.count("*").alias("refs"))


def damaged(stored: DataFrame) -> DataFrame:
    """Stored blobs (sha256, content) whose bytes no longer have their hash."""
    return stored.where(F.sha2("content", 256) != F.col("sha256")).select("sha256")


def quick_fingerprint(size: Column, mtime: Column, content: Column, edge: int = 4096) -> Column:
    """A digest of size, time and both ends of a file."""
    tail = F.when(F.length(content) > edge, F.substr(content, F.length(content) - edge + 1, F.lit(edge))).otherwise(content)
    return F.sha2(F.concat_ws("\n", size.cast("string"), mtime.cast("string"), F.sha2(F.substr(content, F.lit(1), F.lit(edge)), 256), F.sha2(tail, 256)), 256)


def inventory(files: DataFrame, observed: DataFrame, include: list[str], exclude: list[str], largest: int = PARSE_LIMIT) -> DataFrame:
    """Files with why they are ignored, if they are, and their content hash.

    The hash is taken over from ``observed`` (normalized_path_key, size_bytes, mtime,
    quick_fingerprint, content_hash) where all marks agree, and computed only elsewhere.
    """
    path = F.col("logical_path")
    reason = F.when(is_hidden(path), "hidden").when(is_sensitive(path), "sensitive").when(F.col("size_bytes") > largest, "too_large")
    reason = reason.when(matches_any(path, exclude), "excluded")
    if include:
        reason = reason.when(~matches_any(path, include), "not_included")
    marked = files.withColumn("ignored", reason).withColumn("normalized_path_key", F.lower("logical_path"))
    marked = marked.withColumn("quick_fingerprint", quick_fingerprint(F.col("size_bytes"), F.col("mtime"), F.col("content")))
    old = observed.select("normalized_path_key", *[F.col(c).alias(f"old_{c}") for c in ("size_bytes", "mtime", "quick_fingerprint", "content_hash")])
    same = F.lit(True)
    for c in ("size_bytes", "mtime", "quick_fingerprint"):
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    joined = marked.join(old, "normalized_path_key", "left")
    reused = same & F.col("old_content_hash").isNotNull()
    digest = F.when(F.col("ignored").isNull(), F.when(reused, F.col("old_content_hash")).otherwise(F.sha2("content", 256)))
    return joined.select("logical_path", "normalized_path_key", "size_bytes", "mtime", "quick_fingerprint", "ignored", digest.alias("content_hash"), reused.alias("reused"))
