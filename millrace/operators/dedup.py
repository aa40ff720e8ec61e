"""Deduplication and contamination by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import components
from millrace.storage import materialise

TOKEN = r"[\p{L}\p{N}]+"


def first_of_content(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Smallest key and number of copies of each content; only hashes are shuffled."""
    return df.groupBy(content.alias("_h")).agg(F.min(key).alias(key), F.count("*").alias("n_copies")).drop("_h")


def tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str, item: str, few: int = 10_000) -> DataFrame:
    """Documents that hold a whole item of a benchmark, and how many different ones.

    Runs of as many words as the shortest item has are the keys: an item is looked up by its
    first such run, and where that run stands the whole item is compared in place.  Up to
    ``few`` items are looked up within the row of a text, so only hits leave it and no text is
    shuffled; the runs of texts meet more items in a join, and then their texts by id.
    """
    items = benchmark.select(F.col(item).alias("item"), tokens("text").alias("words")).where("size(words) > 0")
    facts = items.agg(F.min(F.size("words")).alias("least"), F.count("*").alias("n")).first()
    least = facts.least or 1
    run = lambda words, at: F.xxhash64(F.slice(words, at, F.lit(least)))
    keyed = items.select("item", F.col("words").alias("wanted"), run("words", F.lit(1)).alias("key"))
    d = docs.select(F.col(doc), tokens("text").alias("words")).where(f"size(words) >= {least}")
    place = F.when(F.size("words") >= least, F.sequence(F.lit(1), F.size("words") - least + 1))
    if facts.n <= few:
        known = keyed.select(F.get("wanted", F.lit(0)).alias("first"), "key").distinct().collect()  # at most `few` rows
        firsts, keys = sorted({r.first for r in known}), sorted({r.key for r in known})
        starts = F.filter(place, lambda i: F.element_at("words", i).isin(firsts) & run("words", i).isin(keys))
        hits = d.select(doc, "words", F.explode(starts).alias("at")).withColumn("key", run("words", F.col("at")))
        whole = hits.join(F.broadcast(keyed), "key").where("slice(words, at, size(wanted)) = wanted")
    else:
        starts = d.select(doc, F.posexplode(F.transform(place, lambda i: run("words", i))).alias("at", "key"))
        hits = starts.join(keyed, "key").select(doc, "at", "item", "wanted")
        whole = hits.join(d, doc).where("slice(words, at + 1, size(wanted)) = wanted")
    return whole.groupBy(doc).agg(F.count_distinct("item").alias("n_items"))


def ngram_overlap(docs: DataFrame, benchmark: DataFrame, doc: str, item: str, n: int = 5, least: float = 0.5, few: int = 100_000) -> DataFrame:
    """(doc, item, share): items of which a document holds at least a share ``least`` of the different runs of ``n`` words.

    Up to ``few`` runs of items are sent to the texts, so only hits are shuffled; more meet in a join.  Runs are
    exploded by the expression that makes them: a filter on a column of them would be pushed below the words, and
    the whole text would be split anew for each of its runs.
    """
    runs = lambda words: F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))
    grams = lambda df, key: df.select(key, tokens("text").alias("words")).select(key, F.explode(F.when(F.size("words") >= n, F.array_distinct(runs("words")))).alias("gram"))
    items = grams(benchmark, item).where(F.col(item).isNotNull()).groupBy(item).agg(F.collect_set("gram").alias("own"))
    keyed = materialise(items.select(item, F.size("own").alias("n_own"), F.explode("own").alias("gram")), "item-grams")
    hits = grams(docs, doc).join(F.broadcast(keyed) if keyed.count() <= few else keyed, "gram")
    shared = hits.groupBy(doc, item).agg(F.count_distinct("gram").alias("n"), F.max("n_own").alias("n_own"))
    return shared.where(F.col("n") >= least * F.col("n_own")).select(doc, item, F.round(F.col("n") / F.col("n_own"), 6).alias("share"))


def ngram_links(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of different ``texts`` (node, text) whose sets of character n-grams reach a Jaccard similarity.

    Prefix filtering: two such sets share one of the rarest grams of each, so only the first
    size - ceil(threshold * size) + 1 grams in order of frequency are join keys.  Only nodes and
    sizes meet there; the sets are compared once for each pair that is left.
    """
    grams = texts.where(F.length("text") >= n).select("node", F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - (n - 1)), lambda i: F.substring("text", i, F.lit(n)))).alias("grams"))
    each = grams.select("node", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = each.join(often, "gram").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    sets = materialise(ordered.select("node", F.transform("g", lambda x: x["gram"]).alias("g")), "grams")
    prefix = sets.select("node", F.size("g").alias("n"), F.explode(F.slice("g", F.lit(1), F.size("g") - F.ceil(F.size("g") * threshold).cast("int") + 1)).alias("gram"))
    a, b = (prefix.select("gram", F.col("node").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    near = (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
    pairs = a.join(b, "gram").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    one, two = (sets.select(F.col("node").alias(c), F.col("g").alias(f"g{c}")) for c in "ab")
    shared = F.size(F.array_intersect("ga", "gb"))
    jaccard = shared / (F.size("ga") + F.size("gb") - shared)
    return pairs.join(one, "a").join(two, "b").where(jaccard >= threshold).select("a", "b")


def ngram_classes(df: DataFrame, n: int, threshold: float) -> DataFrame:
    """id, class_id and n_links of every row of ``df`` (id, text): classes of texts linked by :func:`ngram_links`.

    Equal texts are one node, so copies meet no partner twice; ``class_id`` is the smallest id
    of a class and ``n_links`` the number of different texts that a row's text is linked with.
    """
    nodes = df.groupBy("text").agg(F.min("id").alias("node"))
    links = materialise(ngram_links(nodes, n, threshold), "links")
    comps = components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = nodes.join(comps, "node", "left").join(ends, "node", "left")
    named = named.select(F.col("text").alias("_text"), F.coalesce("comp", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return df.join(named, F.col("text").eqNullSafe(F.col("_text"))).select("id", "class_id", "n_links")
