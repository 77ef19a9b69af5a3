"""Queries that apply the engine's operators to whole tables. ``plans.sql`` has the same in SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as tx
from siltstone.functions import vectors as vx
from siltstone.operators import spaces as spaces_
from siltstone.operators import answers, chunking, claims, evidence, fulltext, graph, impact, layers, maintenance, mentions, ordered, pages, paging, records, retrieval, topics, vector, versioning
from siltstone.operators.textindex import TextIndex
from siltstone.sources import digests, files, generations, parsers
from siltstone.sources.scratch import modified, shared_folder, written
from siltstone.streaming import events as ev
from siltstone.streaming.run import drain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EARLY = "1996-01-01"
SEARCH = "licensed apache"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its times as instants in UTC."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one chunk each: doc_id, content, title (the first line), path, source."""
    d = table(spark, sf_dir, "documents")
    title = F.element_at(F.split("text", "\n"), 1)
    return d.select("doc_id", F.col("text").alias("content"), title.alias("title"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "source", F.lit("text/plain").alias("media_type"))


def stored_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of ``chunks`` in the shared folder: built where there is none of these very files yet."""
    files_ = sorted(table(spark, sf_dir, "documents").inputFiles())
    root = f"{shared_folder(spark)}/siltstone-index2-{hashlib.sha256(repr([(f, modified(spark, f)) for f in files_]).encode()).hexdigest()[:16]}"
    index = TextIndex(spark, root, "doc_id", ["content", "title"], ["source", "path", "media_type"])
    if index.current() is None:
        generation = uuid.uuid4().hex
        index.build(generation, chunks(spark, sf_dir))
        index.activate(generation, chunks(spark, sf_dir))
    return index


# -- text ---------------------------------------------------------------------


@query
def token_estimate_by_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.sum(tx.token_estimate("text")).alias("tokens"))


@query
def language_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.detect_language("text").alias("language"))


@query
def text_normalize_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.sha256(tx.normalize_text("text")).alias("content_hash"))


@query
def line_blocks(spark, sf_dir):
    b = chunking.line_blocks(table(spark, sf_dir, "documents"), "doc_id")
    return b.select("doc_id", F.col("line").cast("long").alias("line"), F.length("text").cast("long").alias("n_chars"), tx.token_estimate("text").alias("tokens"))


@query
def paragraph_anchor(spark, sf_dir):
    b = chunking.line_blocks(table(spark, sf_dir, "documents"), "doc_id").withColumn("heading", F.element_at(F.split("text", " "), 1))
    nth = F.row_number().over(Window.partitionBy("doc_id", "heading").orderBy("line")) - 1
    b = b.withColumn("occurrence", nth.cast("long"))
    return b.select("doc_id", F.col("line").cast("long").alias("line"), "occurrence", F.sha2(F.concat_ws("\n", "heading", F.col("occurrence").cast("string")), 256).alias("anchor_key"))


@query
def chunk_pack(spark, sf_dir):
    return chunking.chunk(chunking.line_documents(table(spark, sf_dir, "documents"), "doc_id"), key="doc_id", key_type="long")


@query
def secret_and_path_flags(spark, sf_dir):
    path = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), "html")
    return p.select("page_id", tx.is_hidden("path").alias("hidden"), tx.is_sensitive("path").alias("sensitive"), tx.matches_any("path", ["**/en/*", "www.*/**"]).alias("included"), tx.mentions_any("html", "idiot, trash;moron").alias("excluded"))


# -- pages --------------------------------------------------------------------

LINK = "(?is)<a\\b[^>]*href\\s*=\\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


def plain_entities(c):
    for name, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(by))
    return c


def page_links(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("target"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("label"))
    found = p.select("page_id", F.posexplode(both).alias("at", "l"))
    return found.select("page_id", (F.col("at") + 1).cast("long").alias("position"), plain_entities(F.col("l.target")).alias("target"), plain_entities(F.col("l.label")).alias("label"))


@query
def html_title(spark, sf_dir):
    found = F.regexp_extract("html", "(?is)<title\\b[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", plain_entities(found).alias("title"))


@query
def html_text(spark, sf_dir):
    x = F.regexp_replace("html", "(?s)<!--.*?-->", "")
    for tag in ("script", "style", "noscript", "template"):
        x = F.regexp_replace(x, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", "")
    x = F.regexp_replace(x, "(?i)</(h[1-6]|p|div|section|article|li|tr|pre|blockquote)>|<[bh]r\\b[^>]*>|<li\\b[^>]*>|<h[1-6]\\b[^>]*>", "\n")
    lines = F.split(plain_entities(F.regexp_replace(x, "<[^>]+>", " ")), "\n")
    tidy = F.filter(F.transform(lines, lambda v: F.trim(F.regexp_replace(v, "[ \\t\\r]+", " "))), lambda v: v != "")
    return table(spark, sf_dir, "pages").select("page_id", F.size(tidy).cast("long").alias("n_lines"), F.sha2(F.array_join(tidy, "\n"), 256).alias("text_hash"))


@query
def html_links(spark, sf_dir):
    return page_links(spark, sf_dir)


@query
def html_headings(spark, sf_dir):
    heads = F.regexp_extract_all("html", F.lit("(?is)<h([1-6])\\b[^>]*>.*?</h[1-6]>"), F.lit(0))
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(heads).alias("at", "h"))
    text = F.trim(plain_entities(F.regexp_replace("h", "<[^>]+>", "")))
    return found.select("page_id", (F.col("at") + 1).cast("long").alias("position"), F.regexp_extract("h", "^<[hH]([1-6])", 1).alias("level"), text.alias("heading"))


@query
def html_documents(spark, sf_dir):
    parsed = parsers.parse(files.read_pages(table(spark, sf_dir, "pages")))
    return parsed.select("logical_path", "title", "language", F.size("blocks").alias("n_blocks"), F.size("links").alias("n_links"), "normalized_content_hash", "structure_hash")


@query
def link_graph_resolve(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", plain_entities(F.regexp_extract("html", "(?is)<title\\b[^>]*>(.*?)</title>", 1)).alias("title"))
    documents = p.select(F.col("page_id").alias("document_id"), F.element_at(F.split("title", " "), 1).alias("path"), "title")
    resolved = graph.resolve_links(page_links(spark, sf_dir).select("page_id", "position", "target"), documents, "page_id")
    return resolved.select("page_id", "position", "target", F.col("n_targets").alias("n_targets"), "state", "document_id")


@query
def backlinks_topk(spark, sf_dir):
    edges = page_links(spark, sf_dir).select(F.col("page_id").alias("subject"), F.lit("links_to").alias("predicate"), F.col("target").alias("object"))
    return graph.backlinks(edges).orderBy(F.desc("n_links"), "object").limit(20)


# -- versions -----------------------------------------------------------------


@query
def blob_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.encode("text", "utf-8").alias("content"))
    return files.blobs(d)


@query
def gc_unreferenced(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    held = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    near = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return evidence.unreferenced(d.select("sha256").distinct(), "sha256", [(held, "sha256"), (near, "sha256")])


def shipped(spark, sf_dir, day: str | None) -> DataFrame:
    """A snapshot: what each order had shipped before a day; or in all, less what was shipped before ``EARLY`` and came back."""
    early = F.col("l_shipdate") < F.lit(day or EARLY).cast("timestamp")
    x = table(spark, sf_dir, "lineitem").where(early if day else ~(early & (F.col("l_returnflag") == "R")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda v: v.cast("string")), ",")
    return x.groupBy(F.col("l_orderkey").cast("string").alias("logical_path")).agg(F.sha2(lines, 256).alias("blob_sha256"))


@query
def snapshot_diff(spark, sf_dir):
    return versioning.snapshot_diff(shipped(spark, sf_dir, EARLY), shipped(spark, sf_dir, None))


@query
def build_diff(spark, sf_dir):
    a, b = (shipped(spark, sf_dir, day).withColumnRenamed("blob_sha256", "content_hash") for day in (EARLY, None))
    return versioning.component_diff(a, b, ["logical_path"], "content_hash").groupBy("change_kind").agg(F.count("*").alias("n"))


def observations(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    moved = F.when(F.col("lang") == "de", F.concat_ws("/", "source", "doc_id")).otherwise(F.concat_ws("/", "lang", "doc_id"))
    state = F.when(F.col("lang") == "es", "deleted").otherwise("active")
    none = F.lit(None).cast("timestamp")
    d = d.select(moved.alias("relative_path"), F.sha2("text", 256).alias("content_hash"), state.alias("state"), none.alias("missing_since"))
    since = F.when(F.length("html") > 3000, F.lit("2024-01-01 00:00:00")).otherwise(F.lit("2024-01-01 00:00:50")).cast("timestamp")
    p = table(spark, sf_dir, "pages").select("url", "html")
    p = p.groupBy(F.col("url").alias("relative_path")).agg(F.max("html").alias("html"))
    p = p.select("relative_path", F.sha2("html", 256).alias("content_hash"), F.lit("missing_pending").alias("state"), since.alias("missing_since"))
    return d.unionByName(p).select("*", F.lower("relative_path").alias("normalized_path_key"), F.lit(None).cast("string").alias("file_identity"))


@query
def change_classify(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    digest = F.when(F.col("lang") == "fr", F.sha2(tx.upper_each("text"), 256)).otherwise(F.sha2("text", 256))
    path = F.concat_ws("/", "lang", "doc_id")
    now = d.select(path.alias("relative_path"), F.lower(path).alias("normalized_path_key"), F.lit(None).cast("string").alias("file_identity"), digest.alias("content_hash"))
    return versioning.classify_changes(observations(spark, sf_dir), now, "2024-01-01 00:01:00", 30_000)


@query
def revision_reuse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return versioning.revisions(d, "source", ["doc_id"], "lang").select("doc_id", "source", "sequence", "reused")


@query
def chunk_jaccard_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # texts move: as arrays of tokens they are several times as large
    pairs = ordered.previous(d, ["source"], ["doc_id"], ["doc_id", "text"]).where("previous is not null")
    pairs = pairs.select("doc_id", tx.tokens("text").alias("t"), F.col("previous.doc_id").alias("previous_id"), tx.tokens("previous.text").alias("p"))
    return pairs.select("doc_id", "previous_id", F.round(tx.jaccard(F.col("t"), F.col("p")), 6).alias("similarity"))


@query
def chunk_lineage(spark, sf_dir):
    """Last year's conversations as chunks against the same with their roles put in front."""
    c = table(spark, sf_dir, "conversations")
    key = F.sha2(F.concat_ws("\n", "role", "turn"), 256)
    old = c.select(F.col("conv_id").cast("string").alias("document_id"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content_text"), key.alias("anchor_key"), F.col("turn").cast("int").alias("ordinal"))
    text = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat_ws(" ", F.lit("answer"), "text"))
    new = c.select(F.col("conv_id").cast("string").alias("document_id"), F.sha2(text, 256).alias("content_hash"), text.alias("content_text"), F.sha2(F.lit("new"), 256).alias("anchor_key"), F.col("turn").cast("int").alias("ordinal"))
    return versioning.align_chunks(old, new)


@query
def duplicate_lineages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n_documents"), F.count_distinct("source").alias("n_lineages"))
    return d.withColumn("n_reposts", F.col("n_documents") - F.col("n_lineages"))


@query
def watermark_digest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2("text", 256).alias("revision"))
    return generations.watermark(d, "doc_id", "revision")


@query
def digest_tree(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2("text", 256).alias("revision"))
    return digests.digest_tree(d, "doc_id", "revision").select(F.col("level").cast("long").alias("level"), "prefix", "digest", "n")


@query
def redirect_closure(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("from"), F.lag("doc_id").over(Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")).alias("to"))
    return graph.redirects(d.where("to is not null"))


# -- search -------------------------------------------------------------------


@query
def trigram_postings(spark, sf_dir):
    return stored_index(spark, sf_dir).terms("content")


@query
def fts_bm25_top20(spark, sf_dir):
    found = stored_index(spark, sf_dir).search(SEARCH, {"content": 1.0, "title": 1.5}, 20)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query
def fts_substring_fallback(spark, sf_dir):
    return fulltext.substring(chunks(spark, sf_dir), "zz", "doc_id", "content", 100)


def query_vector(spark, sf_dir) -> list[float]:
    e = table(spark, sf_dir, "embeddings")
    return e.select("embedding").orderBy("vec_id").first().embedding


@query
def knn_cosine_top20(spark, sf_dir):
    near = vector.nearest(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), "vec_id", "embedding", 20)
    return near.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query
def semantic_neighbors_top8(spark, sf_dir):
    n = vector.semantic_neighbors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    return n.select("vec_id", "neighbor", "rank", F.round("similarity", 6).alias("similarity"))


@query
def vector_l2_norm(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    unit = vx.norm(vx.normalized("embedding", 64))
    return e.select("vec_id", F.round(vx.norm("embedding"), 4).alias("norm"), F.round(unit, 4).alias("unit_norm"))


def spaces(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"), "lang")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label").join(d, "chunk_id", "left")
    old = F.when(F.col("label") < 5, F.coalesce("content_hash", F.lit("none"))).otherwise(F.sha2(F.concat(F.lit("old"), F.col("chunk_id").cast("string")), 256))
    return d.select("chunk_id", "content_hash"), e.select("chunk_id", old.alias("content_hash"))


@query
def vector_coverage(spark, sf_dir):
    return vector.coverage(*spaces(spark, sf_dir))


@query
def vector_stale(spark, sf_dir):
    return vector.stale(*spaces(spark, sf_dir))


@query
def vector_probe_recall(spark, sf_dir):
    """A stored space's neighbours, from as many cells as a sample needs for a recall of 0.95, against the exact ones."""
    e = table(spark, sf_dir, "embeddings")
    held = spaces_.VectorSpaces(spark, f"{shared_folder(spark)}/siltstone-spaces-{uuid.uuid4().hex}", "vec_id")
    held.create("probed", "test:64", 64)
    held.write("probed", e.select("vec_id", F.lit("").alias("content_hash"), "embedding"))
    found = held.neighbors("probed", 8, held.probes_for("probed"))
    counts = spaces_.recall(found, vector.semantic_neighbors(e, "vec_id", "embedding", 8), "vec_id")
    return counts.select("n_queries", "n_wanted", (10 * F.col("n_found") >= 9 * F.col("n_wanted")).alias("recall_ok"))


@query
def vector_space_life(spark, sf_dir):
    """Two spaces of the documents: one is activated, then makes way for the other; one with a hole is refused."""
    d, e = spaces(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    rows = d.join(e, "chunk_id")
    held = spaces_.VectorSpaces(spark, f"{shared_folder(spark)}/siltstone-spaces-{uuid.uuid4().hex}")
    chunks_ = rows.select("chunk_id", "content_hash")
    for name, own in (("first", rows), ("second", rows), ("holed", rows.where("chunk_id % 10 <> 3"))):
        held.create(name, f"test:{name}", 64)
        held.write(name, own)
    for name in ("first", "holed", "second"):
        try:
            held.activate(name, chunks_)
        except ValueError:
            held.delete(name)
    states = held.registry().select("space", "state", "active", "version")
    first = held.coverage("second", chunks_).select("expected", "covered")
    return states.join(first)  # one row


@query
def embedding_backlog(spark, sf_dir):
    """Documents left when a build of eight batches was stopped after three."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    build = spaces_.EmbeddingBuild(spark, f"{shared_folder(spark)}/siltstone-build-{uuid.uuid4().hex}", "stand-in")
    size = -(-d.select("content_hash").distinct().count() // 8)
    stand_in = lambda h: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.conv(F.substr(h, i * 8 - 7, F.lit(4)), 16, 10).cast("float"))
    build.run(d.withColumn("text", F.col("content_hash")), stand_in, "text", size, stop_after=3)
    return build.left(d).select("chunk_id", "content_hash")


@query
def fixture_embeddings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", vx.fixture_embedding(64, "fixture:stable")(F.col("text")).alias("v"))
    return d.where(vx.norm("v") > 0).select("doc_id", vx.vector_hash(vx.normalized("v", 64)).alias("vector_hash"))


@query
def rrf_hybrid(spark, sf_dir):
    fts = fulltext.ranked(stored_index(spark, sf_dir).search(SEARCH, {"content": 1.0, "title": 1.5}, 80), "doc_id")
    near = vector.nearest(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), "vec_id", "embedding", 80)
    near = near.withColumn("rank", F.row_number().over(Window.orderBy(F.round("similarity", 9).desc(), "vec_id"))).withColumnRenamed("vec_id", "doc_id")
    fused = retrieval.fuse({"fts": fts, "vector": near}, "doc_id")
    out = retrieval.top(fused, "doc_id", 20)
    return out.select("doc_id", F.round("score", 9).alias("score"), F.size("routes").cast("long").alias("n_routes"))


@query
def retrieval_items(spark, sf_dir):
    """A hybrid run's candidates by route, kept and read again: rank, and whether the fused result took them."""
    fts = fulltext.ranked(stored_index(spark, sf_dir).search(SEARCH, {"content": 1.0, "title": 1.5}, 80), "doc_id")
    near = vector.nearest(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), "vec_id", "embedding", 80)
    near = near.withColumn("rank", F.row_number().over(Window.orderBy(F.round("similarity", 9).desc(), "vec_id"))).select(F.col("vec_id").alias("doc_id"), "rank", F.col("similarity").alias("score"))
    routes = {"fts": fts, "vector": near}
    taken = retrieval.top(retrieval.fuse(routes, "doc_id"), "doc_id", 20)
    kept = records.RetrievalRecords(spark, f"{shared_folder(spark)}/siltstone-runs-{uuid.uuid4().hex}")
    run = kept.add(SEARCH, "hybrid", records.candidate_rows(routes, taken, "doc_id"), taken.select("doc_id", "score"))
    return kept.of(run, "candidates").select("route", "doc_id", "rank", "selected")


@query
def search_filtered(spark, sf_dir):
    narrow = retrieval.Filters(source="src0", path_prefix="src0/")
    found = retrieval.hybrid_search(chunks(spark, sf_dir), "licensed under", key="doc_id", mode="text", filters=narrow, index=stored_index(spark, sf_dir))
    return found.rows.select("doc_id", F.round("score", 9).alias("score"), "excerpt")


@query
def search_hybrid(spark, sf_dir):
    """By text and by vector at once, on the stored index."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    found = retrieval.hybrid_search(chunks(spark, sf_dir), SEARCH, key="doc_id", vectors=held, query_vector=query_vector(spark, sf_dir), index=stored_index(spark, sf_dir))
    return found.rows.select("doc_id", F.round("score", 9).alias("score"), F.transform("routes", lambda r: r["route"]).cast("string").alias("routes"))


@query
def context_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", tx.token_estimate("text").alias("tokens"))
    return retrieval.budget_cut(d, ["doc_id"], "tokens", 6000, ["source"])


@query
def grounding(spark, sf_dir):
    """Conversation turns as quotes from the turn before them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    found = c.select("conv_id", "turn", retrieval.locate(F.col("text"), F.col("before")).alias("at"))
    return found.select("conv_id", "turn", F.coalesce("at.exact", F.lit(False)).alias("exact"), "at.start", "at.length")


@query
def grounding_offsets(spark, sf_dir):
    """Words 6 to 15 of each document, in lower case and with dashes between, found again in its text."""
    d = table(spark, sf_dir, "documents")
    quote = F.lower(F.array_join(F.slice(F.split("text", " "), 6, 10), " - "))
    found = d.select("doc_id", retrieval.locate(quote, F.col("text")).alias("at"))
    return found.select("doc_id", "at.exact", "at.start", "at.length")


# -- graph --------------------------------------------------------------------


def structure(spark, sf_dir) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edges = graph.contains_edges(t("nation"), node("region", "n_regionkey"), node("nation", "n_nationkey"))
    edges = edges.unionByName(graph.contains_edges(t("customer"), node("nation", "c_nationkey"), node("customer", "c_custkey")))
    return edges.unionByName(graph.contains_edges(t("orders"), node("customer", "o_custkey"), node("order", "o_orderkey")))


@query
def graph_structure_edges(spark, sf_dir):
    return structure(spark, sf_dir)


@query
def graph_neighbors_2hop(spark, sf_dir):
    start = spark.createDataFrame([("customer:1",)], "node string")
    return graph.neighborhood(structure(spark, sf_dir), start, 2).select("node", F.col("depth").cast("long").alias("depth"))


@query
def graph_subgraph(spark, sf_dir):
    start = spark.createDataFrame([("region:0",)], "node string")
    edges = structure(spark, sf_dir)
    found = graph.neighborhood_edges(edges, graph.neighborhood(edges, start, 2))
    return found.select("subject", "predicate", "object", F.col("depth").cast("long").alias("depth"))


@query
def graph_path(spark, sf_dir):
    found = graph.shortest_path(structure(spark, sf_dir), "nation:0", "nation:5")
    return found.select(F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))


@query
def generation_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("object"), "o_orderdate", "o_orderstatus")
    early = F.col("o_orderdate") < F.lit(EARLY).cast("timestamp")
    return graph.generation_diff(o.where(early), o.where(~(early & (F.col("o_orderstatus") == "F"))), ["subject", "object"])


@query
def predicate_domain_check(spark, sf_dir):
    registry = spark.createDataFrame(
        [("contains", ["region", "nation"], ["nation", "customer"], False), ("similar_to", ["nation"], ["nation"], True)],
        "predicate string, domain array<string>, range array<string>, symmetric boolean",
    )
    edges = structure(spark, sf_dir)
    ids = edges.select(F.col("subject").alias("node_id")).union(edges.select("object")).distinct()
    return graph.relations(edges, registry, ids.withColumn("kind", F.element_at(F.split("node_id", ":"), 1)))


@query
def graph_verify(spark, sf_dir):
    """Documents as nodes, labels and embeddings as what points at them."""
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n"))
    edges = pages.select(F.col("page_id").alias("subject"), F.lit("about").alias("predicate"), F.col("n").cast("long").alias("object"))
    claim = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id"), F.col("doc_id").alias("subject"))
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("claim_id"))
    return graph.verify(nodes, edges, claim, held)


# -- claims and topics --------------------------------------------------------


def part_claims(spark, sf_dir, before: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Parts as claims and their line items as evidence, suppliers being lineages; a part conflicts if a sixth of its lines or more have the highest tax rate and a sixth the lowest."""
    x = table(spark, sf_dir, "lineitem")
    if before:
        x = x.where(F.col("l_shipdate") < F.lit(before).cast("timestamp"))
    directness = F.when(F.col("l_returnflag") == "N", "direct").when(F.col("l_returnflag") == "R", "paraphrase").otherwise("inferred")
    lines = x.select(F.col("l_partkey").alias("claim_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_suppkey").alias("source_lineage_key"), directness.alias("directness"), F.lit("support").alias("role"), "l_tax")
    disputed = lines.groupBy("claim_id").agg(F.count_if(F.col("l_tax") >= 0.08).alias("high"), F.count_if(F.col("l_tax") < 0.005).alias("low"), F.count("*").alias("n")).where("6 * high >= n and 6 * low >= n").select("claim_id")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim_id"), F.col("p_brand").alias("topic"), F.when(F.col("p_size") <= 5, "user_confirmed").when(F.col("p_size") >= 48, "rejected").otherwise("proposed").alias("status"), F.when(F.col("p_size") == 20, "user_opinion").when(F.col("p_size") == 30, "inference").otherwise("fact").alias("epistemic_status"))
    held = claims.with_confidence(parts, lines, disputed)
    held = held.join(disputed.withColumn("n_conflicts", F.lit(1)), "claim_id", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))
    return held.withColumn("confidence_level", F.col("confidence.level")), lines


def classified(spark, sf_dir, before: str | None = None) -> DataFrame:
    return topics.classify(*part_claims(spark, sf_dir, before))


@query
def claim_conflicts(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_suppkey")
    return claims.conflicts(x, ["l_partkey", "l_returnflag"], "l_suppkey")


@query
def claim_confidence(spark, sf_dir):
    held, _ = part_claims(spark, sf_dir)
    return held.select("claim_id", "status", F.col("confidence.score").alias("score"), "confidence_level", F.element_at("confidence.reasons", 1).alias("reason"))


@query
def evidence_expand(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    seeds = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("chunk_id"))
    claim = x.groupBy(F.concat_ws("-", "l_partkey", "l_suppkey").alias("claim_id")).agg(F.first("l_partkey").alias("subject"), F.first("l_suppkey").alias("object"), F.when(F.min("l_linestatus") == "F", "stale").otherwise("proposed").alias("status"))
    held = x.select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("claim_id"), F.col("l_orderkey").alias("chunk_id"), F.when(F.col("l_returnflag") == "R", "contradict").otherwise("support").alias("role"))
    mentions = x.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity"))
    found = evidence.expand(seeds, mentions, claim, held)
    return found.groupBy("route_rank", "role").agg(F.count("*").alias("n"), F.count_distinct("claim_id").alias("n_claims")).withColumn("route_rank", F.col("route_rank").cast("long"))


@query
def topic_classify(spark, sf_dir):
    c = classified(spark, sf_dir)
    return c.select("claim_id", "conclusion_type", "role", "independent_source_count", "evidence_count", "repost_count")


@query
def topic_sections(spark, sf_dir):
    return topics.sections(classified(spark, sf_dir), ["topic"])


@query
def topic_health(spark, sf_dir):
    return topics.report(classified(spark, sf_dir), ["topic"])


@query
def topic_gaps(spark, sf_dir):
    return topics.gaps(topics.report(classified(spark, sf_dir), ["topic"]), ["topic"])


@query
def topic_section_changes(spark, sf_dir):
    digest = F.sha2(F.concat_ws("|", "n_claims", "confidence_level", "health_status"), 256)
    a, b = (topics.sections(classified(spark, sf_dir, day), ["topic"]).withColumn("digest", digest) for day in (EARLY, None))
    return topics.section_changes(a, b, ["topic", "section"], "digest")


def topic_items(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Everything on the brands' pages, and their claims."""
    held, lines = part_claims(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim_id"), F.col("p_name").alias("statement"), "p_size")
    x = table(spark, sf_dir, "lineitem")
    day = lambda f: F.date_format(f("l_shipdate"), "yyyy-MM-dd")
    times = x.groupBy(F.col("l_partkey").alias("claim_id")).agg(day(F.min).alias("first"), day(F.max).alias("last"))
    short = F.col("p_size") < 10
    c = topics.classify(held, lines).join(parts, "claim_id").join(times, "claim_id").withColumns({"valid_from": F.when(short, F.col("first")), "valid_to": F.when(short, F.col("last"))})
    c = written(c.select("topic", "claim_id", "statement", "conclusion_type", "role", "confidence_level", "independent_source_count", "valid_from", "valid_to"))  # all parts of the pages read it
    r = topics.report(c, ["topic"])
    edges = x.select(F.col("l_partkey").alias("claim_id"), F.col("l_suppkey").alias("object")).distinct().join(c.select("topic", "claim_id"), "claim_id")
    edges = edges.select("topic", F.concat_ws("-", "claim_id", "object").alias("relation_id"), F.col("claim_id").alias("subject"), F.lit("supplied_by").alias("predicate"), "object")
    proof = lines.select("claim_id", "chunk_id", F.col("source_lineage_key").alias("source_id"))
    return pages.items("topic", r, c, proof, edges, topics.gaps(r, ["topic"])), c


@query
def topic_pages(spark, sf_dir):
    found, claims_ = topic_items(spark, sf_dir)
    return pages.rated(pages.components(found, "topic"), claims_, "topic")


@query
def impact_cascade(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    start = t("nation").where("n_name is not null and n_nationkey = 3").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("string").alias("id"))
    steps = [
        ("nation", t("supplier"), "s_nationkey", "s_suppkey", "supplier"),
        ("supplier", t("lineitem"), "l_suppkey", "l_orderkey", "order"),
        ("order", t("orders"), "o_orderkey", "o_custkey", "customer"),
    ]
    return evidence.impact_counts(evidence.cascade(start, steps)).withColumn("depth", F.col("depth").cast("long"))


@query
def integrity_checks(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    out = evidence.orphans(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey", "line_order")
    out = out.unionByName(evidence.orphans(t("embeddings"), t("labels"), "vec_id", "doc_id", "vector_label"))
    out = out.unionByName(evidence.uncovered(t("customer"), t("orders"), "c_custkey", "o_custkey", "customer_without_order"))
    return out.unionByName(evidence.uncovered(t("part"), t("lineitem"), "p_partkey", "l_partkey", "part_without_line"))


@query
def purge_blockers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    labelled = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    embedded = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    rows = {"documents": (d, F.col("source")), "labels": (labelled, F.col("source")), "embeddings": (embedded, F.col("source"))}
    return evidence.purge_blockers(F.lit("src0"), rows)


@query
def exclusive_blobs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha256"))
    return evidence.exclusive(d, "source", "sha256")


@query
def state_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query
def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return versioning.latest(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query
def next_sequence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    known = e.where("event_type = 'purchase' or event_type = 'click'").withColumn("sequence", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    fresh = e.where("not (event_type = 'purchase' or event_type = 'click')")
    return versioning.next_sequence(known, fresh, "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("sequence").cast("long").alias("sequence"))


@query
def undo_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return versioning.undo_fold(e, ["user_id", "event_type"], ["ts", "event_id"], "value").withColumn("value", F.round("value", 6))


@query
def event_hint_buckets(spark, sf_dir):
    b = ev.hint_buckets(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour")
    return b.select("event_type", F.unix_seconds("bucket").alias("bucket"), "n")


@query
def event_sessions(spark, sf_dir):
    s = ev.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes")
    return s.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


@query
def event_props_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


@query
def stream_hint_buckets(spark, sf_dir):
    """The batch query of the same name, run as a stream."""
    stored = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(stored).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    b = ev.hint_buckets(stream, "ts", ["event_type"], "1 hour", "1 hour")
    return drain(b, "complete").select("event_type", F.unix_seconds("bucket").alias("bucket"), "n")


@query
def conversation_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.lag("role").over(w).alias("previous_role"), F.sum(tx.token_estimate("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tokens_so_far"))


@query
def line_to_chunk(spark, sf_dir):
    """Every line of a document, blank ones too, to the chunk of ten lines with words that it falls in."""
    d = table(spark, sf_dir, "documents")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1
    made = chunking.line_blocks(d, "doc_id").withColumn("ordinal", F.floor(nth / 10))
    made = made.groupBy("doc_id", "ordinal").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    lines = d.select("doc_id", F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n")) + 1)).alias("line"))
    return maintenance.chunk_at_line(lines, made, "doc_id")


@query
def event_percentiles(spark, sf_dir):
    return maintenance.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query
def build_candidates(spark, sf_dir):
    """Documents as sources; those that are labelled have been built."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("snapshot_id"))
    done = d.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id")), "source_id", "left_semi")
    runs = done.select(maintenance.run_key(F.col("snapshot_id"), "v1").alias("run_key"), F.lit("ready").alias("state"))
    return maintenance.build_candidates(d, runs, "v1").select("source_id")


@query
def restorable_resources(spark, sf_dir):
    """Event types as operations on users, one of them taken for a delete."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "delete").otherwise("update")
    log = e.select("user_id", "ts", "event_id", kind.alias("kind"), F.col("event_type").alias("before"), F.lit(None).cast("string").alias("after"))
    return maintenance.restorable(log, ["user_id"], ["ts", "event_id"])


# -- answers, listings and runs -------------------------------------------------


def turns_as_evidence(spark, sf_dir) -> DataFrame:
    """Conversation turns as evidence for their conversation; long answers are disputed."""
    c = table(spark, sf_dir, "conversations")
    status = F.when((F.col("role") == "assistant") & (F.length("text") > 400), "disputed").otherwise("proposed")
    return c.select("conv_id", F.col("turn").alias("position"), F.concat(F.lit("E"), F.col("turn").cast("string")).alias("evidence_key"), F.col("text").alias("content"), status.alias("claim_status"), F.lit("seed").alias("role"))


@query
def answer_deterministic(spark, sf_dir):
    """An answer for each document's id as a conversation; those without turns have insufficient evidence."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"))
    found = answers.deterministic_answers(asked, turns_as_evidence(spark, sf_dir), "conv_id")
    return found.select("conv_id", "result_kind", F.array_join("evidence_keys", ",").alias("evidence_keys"), F.array_join("statements", "\n").alias("statements"))


@query
def retrieval_records(spark, sf_dir):
    """Conversations as runs: all turns are candidates, the user's are the context."""
    c = table(spark, sf_dir, "conversations")
    candidates = c.select("conv_id", F.col("role").alias("route"), F.col("turn").alias("chunk_id"), F.col("turn").alias("rank"))
    items = c.where("role = 'user'").select("conv_id", F.col("turn").alias("position"), F.col("turn").alias("chunk_id"), F.length("text").alias("taken"))
    return answers.run_records(candidates, items, "conv_id")


@query
def related_by_id(spark, sf_dir):
    return answers.related_nodes(structure(spark, sf_dir), "nation:7").select("node", F.col("depth").cast("long").alias("depth"))


@query
def fts_raw_score(spark, sf_dir):
    found = stored_index(spark, sf_dir).search(SEARCH, {"content": 1.0, "title": 1.5}, 20)
    return found.select("doc_id", F.round(fulltext.raw_score(F.col("score")), 6).alias("raw_score"))


def all_topics(spark, sf_dir) -> DataFrame:
    """Brands, which have claims, and regions, which have none."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("topic"))
    return brands.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("topic"))).distinct()


@query
def topic_health_all(spark, sf_dir):
    return topics.with_all_topics(topics.report(classified(spark, sf_dir), ["topic"]), all_topics(spark, sf_dir), ["topic"])


@query
def topic_gaps_all(spark, sf_dir):
    return topics.gaps(topic_health_all(spark, sf_dir), ["topic"])


@query
def topic_local_graph(spark, sf_dir):
    """Line items as claims of their brand about a part and a supplier; those of a returned item are rejected relations."""
    x = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"), "l_partkey", "l_suppkey", "l_returnflag")
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic"))
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    claim = x.join(brand, "l_partkey").select("topic", "claim_id", F.lit(None).cast("string").alias("node"), node("part", "l_partkey").alias("subject"), node("supplier", "l_suppkey").alias("object"))
    status = F.when(F.col("l_returnflag") == "R", "rejected").otherwise("confirmed")
    return topics.local_graph(claim, x.select(F.col("claim_id").alias("relation_id"), "claim_id", status.alias("status")), "topic")


@query
def artifact_dependencies(spark, sf_dir):
    """Orders as artifacts built from parts, suppliers and a customer."""
    x = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "artifact")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact"), F.col("o_custkey").alias("id"))
    of = lambda c: x.select("artifact", F.col(c).alias("id"))
    return topics.dependencies({"part": of("l_partkey"), "supplier": of("l_suppkey"), "customer": o}, "artifact")


def supplier_conflicts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers' line items as claims of one conflict set each; a scope is stated by the ships' mode."""
    x = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"), F.col("l_suppkey").alias("conflict_id"), F.col("l_returnflag").alias("position"), F.when(F.col("l_quantity") >= 50, F.col("l_linestatus")).otherwise(F.lit(" ")).alias("conflict_scope"))
    status = F.when(F.pmod("s_suppkey", F.lit(4)) == 0, "rejected").otherwise("proposed")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("conflict_id"), status.alias("status")), x.select("conflict_id", "claim_id"), x.select("claim_id", "position", "conflict_scope")


@query
def conflict_sets_resolved(spark, sf_dir):
    return graph.resolve_implicit(*supplier_conflicts(spark, sf_dir))


@query
def conflict_details(spark, sf_dir):
    _, members, claim = supplier_conflicts(spark, sf_dir)
    return graph.conflict_details(members, claim)


@query
def graph_bounded(spark, sf_dir):
    start = spark.createDataFrame([("region:0",)], "node string")
    found = graph.bounded_neighborhood(structure(spark, sf_dir), start, 2, 20, 15)
    return found.select("subject", "object", F.col("depth").cast("long").alias("depth"), "truncated")


@query
def snapshot_reuse(spark, sf_dir):
    """Documents by source and language as listings; Spanish texts of odd sources have changed since."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("source"), F.col("doc_id").alias("logical_path"), F.sha2("text", 256).alias("blob_sha256"))
    now = d.withColumn("blob_sha256", F.when(F.endswith("source", F.lit("/es")), F.sha2("blob_sha256", 256)).otherwise(F.col("blob_sha256")))
    return versioning.reuse_snapshots(d.where("not endswith(source, '/fr')"), now, "source")


@query
def ingestion_stages(spark, sf_dir):
    """Events as requests on their user's run; a purchase ends it."""
    state = F.when(F.col("event_type") == "purchase", "ready").otherwise("parsing")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", state.alias("state"))
    return versioning.mark_stages(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "state", "error")


@query
def scan_metrics(spark, sf_dir):
    return maintenance.scan_metrics(change_classify(spark, sf_dir))


@query
def event_feed(spark, sf_dir):
    return maintenance.feed(table(spark, sf_dir, "events"), ["ts", "event_id"], 200, {"event_type": "click"}).select("event_id", "user_id", "event_type")


@query
def event_pages(spark, sf_dir):
    """All events, read in seven pages by cursor."""
    e = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    size = -(-e.count() // 7)
    return paging.joined(list(paging.pages(e, ["ts", "event_id"], size, most=size))).select("page", "event_id", "user_id")


@query
def change_batch_keys(spark, sf_dir):
    """Events as changes in batches of 500 with the keys by which they are handed over once."""
    e = table(spark, sf_dir, "events").select(F.unix_micros("ts").alias("at"), "event_id", "user_id", "event_type")
    return ev.change_batches(e, ["at", "event_id"], 500).groupBy("batch", "key").agg(F.count("*").alias("n"))


@query
def entity_mentions(spark, sf_dir):
    """Documents that mention a benchmark item by its first three words."""
    words = F.slice(F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda w: w != ""), 1, 3)
    aliases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity_id"), F.array_join(words, " ").alias("alias"))
    return mentions.mentions(table(spark, sf_dir, "documents"), aliases, "doc_id", "text").select("doc_id", "entity_id", "alias", "start")


@query
def impact_closure(spark, sf_dir):
    """All that hangs on one region, over ten kinds."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    links = [
        ("region", "nation", t("nation"), "n_regionkey", "n_nationkey"), ("nation", "supplier", t("supplier"), "s_nationkey", "s_suppkey"), ("nation", "customer", t("customer"), "c_nationkey", "c_custkey"),
        ("customer", "order", t("orders"), "o_custkey", "o_orderkey"), ("order", "line", line, "l_orderkey", "line"), ("supplier", "line", line, "l_suppkey", "line"), ("line", "part", line, "line", "l_partkey"),
        ("part", "document", t("documents").select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")), "a", "b"),
        ("document", "embedding", t("embeddings").select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b")), "a", "b"), ("document", "label", t("labels").select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")), "a", "b"),
    ]
    start = spark.createDataFrame([("region", "2")], "kind string, id string")
    return impact.counts(impact.closure(start, links))


@query
def layered_union(spark, sf_dir):
    """A graph of three layers, built from an older state of the documents, then brought up to date; ``built`` counts what that took."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.element_at(F.split("text", " "), 1).alias("word"), F.xxhash64("source", "lang", "text").cast("string").alias("version"))
    edges = lambda kind, a, b: lambda docs: docs.select("doc_id", F.lit(kind).alias("predicate"), F.col(a).cast("string").alias("subject"), F.col(b).cast("string").alias("object"))
    layers_ = {"structure": edges("contains", "source", "doc_id"), "language": edges("speaks", "doc_id", "lang"), "opening": edges("opens_with", "doc_id", "word")}
    held = layers.LayeredGraph(spark, f"{shared_folder(spark)}/siltstone-layers-{uuid.uuid4().hex}", "doc_id", layers_)
    older = F.col("doc_id") % 10 == 0
    before = d.where("doc_id % 7 <> 3").withColumns({"lang": F.when(older, "older").otherwise(F.col("lang")), "version": F.when(older, "0").otherwise(F.col("version"))})
    gone = d.where("doc_id % 50 = 1").withColumn("doc_id", -F.col("doc_id"))
    held.build(before.unionByName(gone))
    built = held.build(d)
    out = None
    for name in layers_:
        rows = held.rows(name).select(F.lit(name).alias("layer"), "predicate", "subject", "object", F.lit(built[name]).cast("long").alias("built"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def topic_history(spark, sf_dir):
    """Two versions of all topics' reports, the first from early claims, and what changed with each."""
    held = records.TopicVersions(spark, f"{shared_folder(spark)}/siltstone-topics-{uuid.uuid4().hex}")
    for version, day in enumerate((EARLY, None)):
        held.publish(topics.report(classified(spark, sf_dir, day), ["topic"]), version)
    return held.history("topic", F.concat_ws("|", "n_claims", "n_consensus", "n_conflict", "n_single", "health_status", "confidence_level"))


@query
def entity_merges(spark, sf_dir):
    """Suppliers, of which three in four were merged into the one before: aliases of those that stand."""
    s = table(spark, sf_dir, "supplier")
    merges = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("from"), (F.col("s_suppkey") - 1).alias("to"))
    return records.merged_entities(s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("alias")), graph.redirects(merges))


@query
def moderated_relations(spark, sf_dir):
    """Customers' orders as relations, with events as decisions on the customer's: the last one counts."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("relation_id"), F.lit("active").alias("status")).distinct()
    decision = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "click", "reject").otherwise("none")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("relation_id"), decision.alias("decision"), "ts", "event_id")
    return records.moderated(o, e, "relation_id", ["ts", "event_id"])


@query
def deep_verify(spark, sf_dir):
    """Index and vectors missing or without need, series with gaps, links across documents, statements without evidence."""
    t = lambda n: table(spark, sf_dir, n)
    d, index = t("documents"), stored_index(spark, sf_dir)
    out = index.uncovered(index.current(), chunks(spark, sf_dir)).select(F.concat(F.lit("fts_"), "issue").alias("check"), F.col("doc_id").cast("string").alias("id"))
    out = out.unionByName(evidence.uncovered(d, t("embeddings"), "doc_id", "vec_id", "vector_missing")).unionByName(evidence.orphans(t("embeddings"), d, "vec_id", "doc_id", "vector_orphan"))
    out = out.unionByName(records.gaps_in_sequence(t("conversations"), "conv_id", "turn"))
    links = t("orders").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0)).alias("o_custkey"))
    out = out.unionByName(records.cross_document(links, t("orders"), "o_orderkey", "o_custkey"))
    cited = t("labels").select(F.col("doc_id").alias("statement_id"), F.col("doc_id").alias("evidence_key"))
    proof = t("embeddings").select(F.col("vec_id").alias("evidence_key"))
    return out.unionByName(records.unsupported(d.select(F.col("doc_id").alias("statement_id")), cited, proof))


@query
def resource_dependents(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    targets = {"part": (t("part"), "p_partkey"), "supplier": (t("supplier"), "s_suppkey"), "customer": (t("customer"), "c_custkey"), "nation": (t("nation"), "n_nationkey")}
    links = [("part", "line", t("lineitem"), "l_partkey"), ("supplier", "line", t("lineitem"), "l_suppkey"), ("customer", "order", t("orders"), "o_custkey"), ("nation", "customer", t("customer"), "c_nationkey"), ("nation", "supplier", t("supplier"), "s_nationkey")]
    return maintenance.dependents(targets, links)


@query
def operation_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("before"), F.round("value", 6).alias("after"))
    return maintenance.operation_diff(e, ["user_id"], ["ts", "event_id"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to lines, token-budgeted chunks, and the ten that answer a query best."""
    d = table(spark, sf_dir, "documents")
    made = chunking.chunk(chunking.line_documents(d, "doc_id"), 200, 20, key="doc_id", key_type="long")
    rows = made.select(F.concat_ws("-", "doc_id", "ordinal").alias("chunk_id"), F.col("content_text").alias("content"), F.element_at(F.split("content_text", "\n"), 1).alias("title"), "token_estimate")
    return retrieval.hybrid_search(rows, SEARCH, limit=10, mode="text").rows.select("chunk_id", "score", "excerpt", "token_estimate")
