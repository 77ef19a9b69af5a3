"""URL filters: host and path rules, and association rules mined from labelled URLs.

A URL becomes a set of tokens: its top-level domain, the words of its host, its path's
segments (numbers by their length), extension and query keys. Token combinations that
are frequent among labelled URLs are counted size by size. A combination of at most
``longest`` tokens becomes a rule for a verdict if

* the URLs with it that have the verdict are at least ``support`` per mille of all
  labelled URLs, and at least ``least``;
* the verdict holds for at least ``confidence`` per cent of its URLs, and more often
  than among all labelled URLs;
* no rule of fewer of its tokens has the same verdict at the same confidence or more.

Rules are kept in an inverted index under their rarest token. Distinct token sets of
all URLs look their tokens up there, candidates are checked for all of the rule's
tokens, and the best rule decides: highest confidence, then most URLs, then most
tokens, then block before allow, then last in order. Where a fixed rule fits,
it decides; where nothing fits, the URL is allowed.

All tokens of a labelled URL are mined. Rare ones go first, then a combination grows
only from frequent ones, by tokens that follow in order, so each is made once for each
distinct set and its counts are combined before the shuffle. Only the numbers of
allowed and blocked URLs come to the driver.

A null URL, or one without ``://``, has an empty host and path and no tokens: it is
allowed unless a fixed rule says otherwise. Null labels aren't mined. Repeated rows
are separate rows, also for the counts. Without labelled URLs there are no rules. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, renamed

ALLOW, BLOCK = "allow", "block"
#: Thresholds of the query's rules.
SUPPORT, LEAST, CONFIDENCE, LONGEST = 5, 5, 80, 3

# The rules of the query, verdict and host with the start of a path.
RULES = [(ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/")]

RULE = "verdict string, items array<string>, n_both long, n_items long"


def parts(url: str = "url") -> dict[str, Column]:
    """host and path of a URL column."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return {"host": F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase), "path": F.regexp_extract(text, pattern, 2)}


def fixed_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = name.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(url: str = "url") -> Column:
    """The tokens of a URL, from columns host, path and the URL itself, host first."""
    labels = F.split("host", r"\.")
    words = F.split(F.concat_ws(".", F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))), r"[.\-]")
    tld = F.array(F.concat(F.lit("tld="), F.try_element_at(labels, F.lit(-1))))
    host = F.transform(F.reverse(words), lambda w: F.concat(F.lit("host="), w))
    stem = F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "")
    path = F.transform(F.filter(F.split(stem, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(s).cast("string"))).otherwise(s)))
    ext = F.array(F.concat(F.lit("ext="), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda k: F.concat(F.lit("query="), F.get(F.split(k, "="), F.lit(0))))
    return F.array_distinct(F.filter(F.concat(tld, host, path, ext, keys), lambda t: ~t.rlike("(?s)^[a-z]+=$")))


def frequent(labelled: DataFrame, needed: int, longest: int = LONGEST) -> DataFrame:
    """Token combinations (items, in order) of at most ``longest`` that ``needed`` URLs of one verdict have: how many are allowed, how many blocked."""
    counts = [F.sum(v).alias(v) for v in (ALLOW, BLOCK)]
    enough = F.greatest(ALLOW, BLOCK) >= needed
    sets = labelled.groupBy("tokens").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in (ALLOW, BLOCK)])
    sets = materialize(sets.withColumn("id", F.monotonically_increasing_id()), "url-sets")
    each = sets.select("id", ALLOW, BLOCK, F.explode("tokens").alias("token"))
    single = materialize(each.groupBy("token").agg(*counts).where(enough), "url-tokens")
    # rare tokens are in no frequent combination; without them many sets are the same
    common = each.join(single.select("token"), "token").groupBy("id", ALLOW, BLOCK).agg(F.sort_array(F.collect_set("token")).alias("rest"))
    held = common.groupBy("rest").agg(*counts).select(F.array().cast("array<string>").alias("items"), "rest", ALLOW, BLOCK)
    held = materialize(held, "url-common")
    found = single.select(F.array("token").alias("items"), ALLOW, BLOCK)
    levels = [found]
    for size in range(1, longest + 1):
        held = held.select("items", "rest", ALLOW, BLOCK, F.posexplode("rest").alias("at", "token"))
        held = held.select(F.array_append("items", F.col("token")).alias("items"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), ALLOW, BLOCK)
        if size > 1:
            found = materialize(held.groupBy("items").agg(*counts).where(enough), f"url-combinations-{size}")
            levels.append(found)
        held = held.where(F.size("rest") > 0).join(found.select("items"), "items", "left_semi")
    return reduce(DataFrame.unionByName, levels)


def mine(labelled: DataFrame, support: int = SUPPORT, least: int = LEAST, confidence: int = CONFIDENCE, longest: int = LONGEST) -> DataFrame:
    """Rules from ``labelled`` (tokens, verdict): verdict, items, and how many URLs have both and the items alone."""
    labelled = labelled.where(F.col("verdict").isin(ALLOW, BLOCK)).select("tokens", "verdict")
    totals = labelled.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in (ALLOW, BLOCK)]).first()
    n = totals[ALLOW] + totals[BLOCK]
    if not n:
        return labelled.sparkSession.createDataFrame([], RULE)
    needed = max(least, -(-n * support // 1000))
    sets = frequent(labelled, needed, longest)
    all_ = F.col(ALLOW) + F.col(BLOCK)
    said = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("n_both"), F.lit(totals[v]).alias("n_verdict")) for v in (ALLOW, BLOCK)])).alias("said")
    rules = sets.select("items", all_.alias("n_items"), said).select("said.*", "items", "n_items").where(F.col("n_both") >= needed)
    rules = rules.where((100 * F.col("n_both") >= confidence * F.col("n_items")) & (F.col("n_both") * n > F.col("n_items") * F.col("n_verdict")))
    return pruned(materialize(rules.select("verdict", "items", "n_both", "n_items"), "url-rules"), longest)


def pruned(rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Without the rules of which some tokens alone give the same verdict at the same confidence or more."""
    def part(mask: int) -> Column:
        return F.filter("items", lambda _, i: F.lit(mask).bitwiseAND(F.pow(2, i).cast("int")) != 0)

    subsets = F.array(*[part(mask) for mask in range(1, 2**longest - 1)])
    parts_ = rules.select("verdict", "items", "n_both", "n_items", F.explode(F.array_distinct(F.filter(subsets, lambda s: (F.size(s) > 0) & (F.size(s) < F.size("items"))))).alias("part"))
    shorter = rules.select(F.col("verdict").alias("v"), F.col("items").alias("part"), F.col("n_both").alias("b"), F.col("n_items").alias("a"))
    beaten = parts_.join(shorter, (parts_.verdict == shorter.v) & (parts_.part == shorter.part) & (shorter.b * parts_.n_items >= parts_.n_both * shorter.a))
    return rules.join(beaten.select("verdict", "items").distinct(), ["verdict", "items"], "left_anti")


def index(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Rules under their rarest token; ``counts`` has every token's number of URLs (token, n)."""
    key = rules.select("*", F.explode("items").alias("token")).join(counts, "token")
    rarest = key.groupBy("verdict", "items", "n_both", "n_items").agg(F.min(F.struct("n", "token")).alias("least"))
    return rarest.select(F.col("least.token").alias("token"), "verdict", "items", "n_both", "n_items")


def judge(urls: DataFrame, posted: DataFrame) -> DataFrame:
    """``urls`` (with tokens) and the best rule's ``mined`` verdict and ``pattern``; null where no rule matches."""
    sets = urls.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).where(F.size("tokens") > 0)
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(posted, "token")
    found = found.where(F.size(F.array_except("items", "tokens")) == 0)
    rank = F.struct(F.col("n_both") / F.col("n_items"), "n_both", F.size("items"), "verdict")
    best = found.groupBy("tokens").agg(F.max_by(F.struct("verdict", "items"), F.struct(rank, "items")).alias("best"))
    best = best.select("tokens", F.col("best.verdict").alias("mined"), F.array_join("best.items", " ").alias("pattern"))
    return urls.join(best, "tokens", "left")


def op11(pages: DataFrame) -> DataFrame:
    """Fixed rules and, where none fits, rules mined from the URLs that the fixed rules label."""
    urls = renamed(pages, page_id="page_id", url="url").withColumns(parts())
    rule, said = fixed_rule(RULES)
    urls = urls.withColumns({"tokens": tokens(), "rule": rule, "verdict": said}).drop("url")
    labelled = urls.where(F.col("verdict").isNotNull()).select("tokens", "verdict")
    rules = mine(labelled)
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = materialize(index(rules, counts), "url-index")
    judged = judge(urls, posted)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", "mined", F.lit(ALLOW)).alias("verdict"), F.when(F.col("rule").isNull(), F.col("pattern")).alias("pattern"))
