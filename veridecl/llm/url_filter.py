"""URL filtering by host rules and by association rules that FP-growth mines, in DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: The listed rules: verdict, and host and path together.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A mined rule holds for at least this share of the labelled pages, and is right for at least this share of those it fits.
SUPPORT, CONFIDENCE = 0.005, 0.6
BAD = "label:block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _listed(host: Column, path: Column, rules) -> Column:
    """The longest listed rule that fits, as a struct, else null."""
    fits = []
    for verdict, rule in rules:
        name, slash, tail = rule.partition("/")
        fit = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + tail)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: scheme, host labels and the last two of them, path segments, query names.

    Digits become ``#``, so that page numbers don't make every url unlike all others.
    """
    labels = F.split(host, r"\.")
    shape = lambda x: F.regexp_replace(x, r"[0-9]+", "#")
    tagged = lambda tag, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(tag), shape(x)))
    query = F.split(F.regexp_replace(F.regexp_extract(url, r"\?([^#]*)", 1), r"=[^&]*", ""), "&")
    parts = [tagged("h:", labels), tagged("d:", F.array(F.concat_ws(".", F.slice(labels, -2, 2)))), tagged("p:", F.split(path, "/")), tagged("q:", query), tagged("s:", F.array(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)))]
    parts[1] = F.when(F.size(labels) >= 2, parts[1]).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def token_classes(labelled: DataFrame, rows: int) -> list[tuple[int, int, list[str]]]:
    """Classes of tokens that stand in exactly the same rows (tokens, bad), as (rows, bad rows, tokens in order).

    Only tokens that enough bad rows hold: no other can be part of a rule. Each stands in a share SUPPORT of all rows, so
    there are as many as a row has tokens, over SUPPORT, at most; the driver holds them. Whether two tokens stand in the
    same rows is told by their counts and by two sums of 64-bit hashes over the distinct sets of tokens that hold them.
    """
    sets = labelled.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"))
    hash_ = lambda *salt: F.xxhash64("tokens", *map(F.lit, salt)).cast("decimal(20,0)")
    each = sets.select(F.explode("tokens").alias("token"), "n", "b", hash_().alias("h1"), hash_(1).alias("h2"))
    counts = each.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n", "b", "h1", "h2"))).filter(F.col("b") >= SUPPORT * rows)
    classes = counts.groupBy("n", "b", "h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("tokens"))  # of one url at most
    return sorted((int(r["n"]), int(r["b"]), list(r["tokens"])) for r in classes.collect())


def mine_rules(labelled: DataFrame) -> DataFrame:
    """Rules (rule, tokens, classes, confidence, support) that block, mined from rows (tokens, bad).

    Tokens that stand in exactly the same rows count as one, else each set of them would be a combination of its own:
    one of them is mined, and the rule holds the whole class (``classes``; in ``rule`` they are parted by ``|``), any of
    which will do. A class that stands in all rows changes nothing beside others and is judged alone.

    FP-growth finds the combinations that come with the label often enough. A rule is pruned if another, whose tokens it
    holds all, is as confident: level by level, each combination takes over the best confidence of those that lack one of
    its tokens. No labels, or no bad ones: no rules.
    """
    spark = labelled.sparkSession
    columns = "rule string, tokens array<string>, classes array<array<string>>, confidence double, support double"
    rows, hits = labelled.agg(F.count("*"), F.count_if("bad")).first()
    if not hits:
        return spark.createDataFrame([], columns)
    classes = token_classes(labelled, rows)
    everywhere = [(c[2][0], c[2], c[1] / c[0], c[1] / rows) for c in classes if c[0] == rows and c[1] / c[0] >= CONFIDENCE]
    alone = spark.createDataFrame([("|".join(t), [first], [t], sure, share) for first, t, sure, share in everywhere], columns)
    known = {c[2][0]: c for c in classes if c[0] < rows}
    if not known:
        return alone
    # a token stands for its class: a row holds all of it or none
    kept = F.array_intersect("tokens", F.array(*map(F.lit, known)))
    items = labelled.select(F.when(F.col("bad"), F.concat(kept, F.array(F.lit(BAD)))).otherwise(kept).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=SUPPORT, minConfidence=0.0).fit(items)
    # unsure combinations too: they pass on what their subsets reach
    rules = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    rules = materialize(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    longest = rules.agg(F.max(F.size("tokens"))).first()[0] or 0
    level = rules.filter(F.size("tokens") == 1).select("tokens", "confidence", F.lit(0.0).alias("shorter"))
    levels = level
    for size in range(2, longest + 1):
        lacking = F.transform("tokens", lambda _, i: F.filter("tokens", lambda __, j: j != i))
        subsets = rules.filter(F.size("tokens") == size).select(F.col("tokens").alias("whole"), F.col("confidence").alias("own"), F.explode(lacking).alias("tokens"))
        best = F.max(F.greatest("confidence", "shorter")).alias("shorter")
        level = materialize(subsets.join(level, "tokens").groupBy(F.col("whole").alias("tokens"), F.col("own").alias("confidence")).agg(best), "level")
        levels = levels.unionByName(level)
    chosen = levels.filter((F.col("confidence") >= CONFIDENCE) & (F.col("shorter") < F.col("confidence"))).select("tokens")
    members = spark.createDataFrame([(token, n, group) for token, (n, _, group) in known.items()], "token string, n long, members array<string>")
    parts = chosen.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(members), "token")
    # the rarest class first: a rule is looked up by it
    whole = parts.groupBy("tokens").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token", "members"))), lambda x: x["members"]).alias("classes"))
    name = F.array_join(F.array_sort(F.transform("classes", lambda c: F.array_join(c, "|"))), "&")
    return rules.join(whole, "tokens").select(name.alias("rule"), "tokens", "classes", "confidence", "support").unionByName(alone)


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """A verdict for every row of ``pages``: page_id, host, path, rule, verdict, mined.

    A listed rule fits its host and all subdomains if the path starts with its path; the longest that fits decides.
    Else the mined rules do: block if the url holds all tokens of one, else allow. ``labels`` (doc_id, quality, toxic)
    tells of the page with that page_id: bad if toxic is 1 or quality is 0. ``mined`` is the first mined rule that
    fits in the order of text, with one token of each class, or null.

    Urls are matched by an inverted index from tokens to rules: once for each distinct set of tokens, however many
    pages share it. Null urls and urls without ``://`` have an empty host and path and no tokens: allow. Repeated rows
    get equal results; several labels of one page each count; empty labels mine nothing. Further columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    tokens = F.when(F.col("host") != "", url_tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("tokens", tokens).withColumn("key", F.sha2(F.array_join("tokens", "\n"), 256))
    bad = F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    mined = mine_rules(rows.filter(F.size("tokens") > 0).join(known, "page_id").select("tokens", "bad"))

    # a rule stands in the index under its rarest class only, and is then tested whole
    index = mined.select("rule", "classes", F.explode(F.get("classes", 0)).alias("token"))
    shapes = rows.select("key", "tokens").dropDuplicates(["key"]).select("key", F.explode("tokens").alias("token"), "tokens")
    hits = shapes.join(index, "token").filter(F.forall("classes", lambda c: F.arrays_overlap(c, F.col("tokens"))))
    # of each class the first token that the url holds
    said = F.array_join(F.array_sort(F.transform("classes", lambda c: F.array_min(F.array_intersect(c, F.col("tokens"))))), "&")
    blocked = hits.groupBy("key").agg(F.min(said).alias("mined"))

    listed = _listed(F.col("host"), F.col("path"), rules)
    out = rows.select("page_id", "host", "path", "key", listed.alias("fit")).join(blocked, "key", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "mined")
