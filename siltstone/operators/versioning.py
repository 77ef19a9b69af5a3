"""Snapshots, changes, revisions and chunk lineage, each as joins on keys and hashes."""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators import ordered


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(logical_path, change_kind, previous_blob_sha256, blob_sha256) of paths whose blob differs."""
    old = previous.select("logical_path", F.col("blob_sha256").alias("previous_blob_sha256"), F.lit(True).alias("was"))
    both = old.join(current.select("logical_path", "blob_sha256", F.lit(True).alias("now")), "logical_path", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("modified")
    changed = both.where(F.col("was").isNull() | F.col("now").isNull() | ~F.col("previous_blob_sha256").eqNullSafe(F.col("blob_sha256")))
    return changed.select("logical_path", kind.alias("change_kind"), "previous_blob_sha256", "blob_sha256")


def component_diff(previous: DataFrame, current: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """keys, change_kind for every key of two keyed, hashed lists, unchanged ones too."""
    both = previous.select(*keys, F.col(digest).alias("old")).join(current.select(*keys, F.col(digest).alias("new")), keys, "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return both.select(*keys, kind.alias("change_kind"))


def classify_changes(previous: DataFrame, current: DataFrame, now, delete_grace_ms: int) -> DataFrame:
    """OBSERVATION against INVENTORY rows: relative_path, kind, previous_path, previous_hash, current_hash.

    Same path: restored if it was deleted, modified if its hash differs. A new path
    takes the name of a vanished one by file identity, else by content hash, if just
    one vanished path has it; of several new paths with that hash the first in path
    order does. What is missing is ``missing_pending`` until its grace is over.
    """
    old = previous.select("normalized_path_key", "file_identity", "state", "missing_since", F.col("relative_path").alias("previous_path"), F.col("content_hash").alias("previous_hash"))
    new = current.select("normalized_path_key", "file_identity", "relative_path", F.col("content_hash").alias("current_hash"))
    key = "normalized_path_key"
    same = old.drop("file_identity").join(new.drop("file_identity"), key)
    kind = F.when(F.col("state") == "deleted", "restored").when(~F.col("previous_hash").eqNullSafe(F.col("current_hash")), "modified")
    none = F.lit(None).cast("string")
    out = same.select("relative_path", kind.alias("kind"), none.alias("previous_path"), "previous_hash", "current_hash").where("kind is not null")

    gone = old.join(new.select(key), key, "left_anti").where("state <> 'deleted'")
    fresh = new.join(old.select(key), key, "left_anti")
    for by, old_column, new_column in (("file_identity", "file_identity", "file_identity"), ("hash", "previous_hash", "current_hash")):
        one = gone.where(F.col(old_column).isNotNull()).groupBy(F.col(old_column).alias("by")).agg(F.count("*").alias("n"), F.first(key).alias("old_key"), F.first("previous_path").alias("previous_path"), F.first("previous_hash").alias("previous_hash"))
        first = fresh.groupBy(F.col(new_column).alias("by")).agg(F.min_by(key, F.struct("relative_path", key)).alias(key))
        pairs = one.where("n = 1").join(first, "by").select(key, "old_key", "previous_path", "previous_hash")
        renamed = fresh.join(pairs, key)
        out = out.unionByName(renamed.select("relative_path", F.lit("renamed").alias("kind"), "previous_path", "previous_hash", "current_hash"))
        fresh = fresh.join(pairs.select(key), key, "left_anti")
        gone = gone.join(pairs.select(F.col("old_key").alias(key)), key, "left_anti")
    out = out.unionByName(fresh.select("relative_path", F.lit("created").alias("kind"), none.alias("previous_path"), none.alias("previous_hash"), "current_hash"))
    over = (F.col("state") == "missing_pending") & (F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis("missing_since") >= delete_grace_ms)
    ended = F.when(F.coalesce(over, F.lit(False)), "deleted").otherwise("missing_pending")
    return out.unionByName(gone.select(F.col("previous_path").alias("relative_path"), ended.alias("kind"), none.alias("previous_path"), "previous_hash", none.alias("current_hash")))


def revisions(blobs: DataFrame, document: str, order: list[str], digest: str) -> DataFrame:
    """Adds ``sequence`` and whether a version reuses the revision before it, its hash being the same."""
    marked = ordered.previous(blobs, [document], order, [digest])
    marked = marked.withColumn("reused", F.col("previous").isNotNull() & F.col(f"previous.{digest}").eqNullSafe(F.col(digest))).drop("previous")
    marked = ordered.running_sum(marked.withColumn("new", (~F.col("reused")).cast("long")), [document], order, "new")
    return marked.withColumn("sequence", (F.col("before") + F.col("new")).cast("long")).drop("before", "new", "position")


def next_sequence(existing: DataFrame, fresh: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Numbers new rows of each key on from the greatest ``sequence`` there is."""
    top = existing.groupBy(key).agg(F.max("sequence").alias("top"))
    row = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return fresh.withColumn("row", row).join(top, key, "left").withColumn("sequence", F.coalesce("top", F.lit(0)) + F.col("row")).drop("row", "top")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by partial maxima rather than a sort."""
    columns = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row"))
    return picked.select(key, "row.*")


def tombstones(documents: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Documents (document_id, logical_path, state) with the state that a snapshot's paths give them."""
    here = snapshot.select("logical_path").distinct().withColumn("here", F.lit(True))
    joined = documents.join(here, "logical_path", "left")
    return joined.withColumn("state", F.when(F.col("here"), "active").otherwise("tombstoned")).drop("here")


def apply_renames(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Paths after renames; document ids survive."""
    moved = changes.where("kind = 'renamed'").select(F.col("previous_path").alias("logical_path"), F.col("relative_path").alias("to"))
    return documents.join(moved, "logical_path", "left").withColumn("logical_path", F.coalesce("to", "logical_path")).drop("to")


def _words(text: str) -> set[str]:
    return set(re.findall(r"[^\W_]+", text.lower()))


def align_document(previous: pd.DataFrame, drafts: pd.DataFrame) -> pd.DataFrame:
    """One document's drafts against its chunks: equal hash, else equal anchor, else the most similar of 0.15 or more."""
    old = previous.sort_values("ordinal").to_dict("records")
    new = drafts.sort_values("ordinal").to_dict("records")
    stock = defaultdict(list)
    for o in reversed(old):
        stock[o["content_hash"]].append(o)
    exact = [stock[n["content_hash"]].pop() if stock[n["content_hash"]] else None for n in new]
    kept = {o["chunk_id"] for o in exact if o}
    free = {o["chunk_id"]: o for o in old if o["chunk_id"] not in kept}
    words = {k: _words(o["content_text"]) for k, o in free.items()}
    rows = []
    for n, found in zip(new, exact, strict=True):
        relation, chunk_id, score = ("exact", found["chunk_id"], 1.0) if found else ("created", None, None)
        if not found and free:
            own = _words(n["content_text"])

            def likeness(o, own=own):
                other = words[o["chunk_id"]]
                return len(own & other) / len(own | other) if own | other else 1.0

            best = next((o for o in free.values() if o["anchor_key"] == n["anchor_key"]), None)
            if best is None:
                best = max(free.values(), key=lambda o: (likeness(o), -abs(o["ordinal"] - n["ordinal"])))
                best = best if likeness(best) >= 0.15 else None
            if best:
                relation, chunk_id, score = "modified", best["chunk_id"], likeness(best)
                del free[chunk_id]
        rows.append((n["document_id"], n["ordinal"], n["content_hash"], relation, chunk_id, score))
    used = {r[4] for r in rows if r[3] == "exact"}
    rows += [(o["document_id"], None, o["content_hash"], "tombstoned", o["chunk_id"], None) for o in old if o["chunk_id"] not in used]
    return pd.DataFrame(rows, columns=["document_id", "ordinal", "content_hash", "relation", "previous_chunk_id", "similarity"])


ALIGNED = "document_id string, ordinal int, content_hash string, relation string, previous_chunk_id string, similarity double"


def align_chunks(previous: DataFrame, drafts: DataFrame) -> DataFrame:
    """Lineage of chunks per document. The greedy order makes it sequential, so it runs in pandas, one document at a time."""
    old = previous.select("document_id", "chunk_id", "content_hash", "content_text", "anchor_key", "ordinal")
    new = drafts.select("document_id", "content_hash", "content_text", "anchor_key", "ordinal")
    return old.groupBy("document_id").cogroup(new.groupBy("document_id")).applyInPandas(align_document, ALIGNED)


def undo_fold(log: DataFrame, keys: list[str], order: list[str], after: str) -> DataFrame:
    """The state that a change log leaves: the last ``after`` of each key."""
    return log.groupBy(*keys).agg(F.max_by(after, F.struct(*order)).alias(after))


def compare_and_set(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Applies (key, before, after) where the state still is ``before``; ``applied`` says where."""
    joined = state.join(changes, key, "full_outer")
    ok = F.col("value").eqNullSafe(F.col("before")) & (F.col("before").isNotNull() | F.col("after").isNotNull())
    return joined.select(key, F.when(ok, F.col("after")).otherwise(F.col("value")).alias("value"), ok.alias("applied"))


def inverse(changes: DataFrame) -> DataFrame:
    """The changes that undo ``changes``."""
    swapped = {"before": "after", "after": "before"}
    return changes.select(*[F.col(c).alias(swapped.get(c, c)) for c in changes.columns])


def reuse_snapshots(previous: DataFrame, current: DataFrame, source: str) -> DataFrame:
    """(source, reused, n_changed): whether a source's new listing equals its last, so that no snapshot is made.

    Both have source, logical_path, blob_sha256. A source that was never listed is not reused.
    """
    keys = [source, "logical_path"]
    both = previous.select(*keys, F.col("blob_sha256").alias("old"), F.lit(True).alias("was")).join(current.select(*keys, F.col("blob_sha256").alias("new"), F.lit(True).alias("now")), keys, "full_outer")
    changed = F.col("was").isNull() | F.col("now").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    per = both.groupBy(source).agg(F.count_if(changed).alias("n_changed"), F.count("was").alias("before"), F.count("now").alias("after"))
    return per.where("after > 0").select(source, ((F.col("n_changed") == 0) & (F.col("before") > 0)).alias("reused"), "n_changed")


# The states of a run that no stage follows.
FINAL = ["ready", "cancelled"]


def mark_stages(requests: DataFrame, run: str, order: list[str]) -> DataFrame:
    """``requests`` (run, state, order...) with ``error``: ingestion_state_invalid once a run has ended."""
    end = requests.where(F.col("state").isin(*FINAL)).groupBy(run).agg(F.min(F.struct(*order)).alias("end"))
    return requests.join(end, run, "left").withColumn("error", F.when(F.struct(*order) > F.col("end"), "ingestion_state_invalid")).drop("end")


def chunk_list(chunks: DataFrame, lineage: DataFrame, document: str) -> DataFrame:
    """document, ordinal, chunk_id, lineage_kind, previous_chunk_id: chunks as they are listed, with where each comes from."""
    held = chunks.join(lineage.select("chunk_id", "lineage_kind", "previous_chunk_id"), "chunk_id", "left")
    return held.select(document, "ordinal", "chunk_id", F.coalesce("lineage_kind", F.lit("added")).alias("lineage_kind"), "previous_chunk_id")
