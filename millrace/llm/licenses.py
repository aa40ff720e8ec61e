"""License scans with a positional rare-token index over templates.

A template is a label and its mandatory key phrase.  One pass counts in how many texts each
licence word occurs; a phrase is then indexed under its two words of highest IDF, with their
places in it.  A scan looks up the rare words of a file in that index: each gives postings
(template, place where the phrase would start), postings that both rare words of a phrase give
are intersected by sorting, and the phrase is verified there word by word.  So the work follows
the rare words of a file, not the number of templates.  All of it is DataFrame functions; the
only values a driver sees are the document frequencies of the licence words.

Defined results: a null text is empty and has no words; repeated rows give repeated results;
phrases may overlap, every place counts; an empty table gives an empty table; all columns are
passed through by ``find_licenses``, but those that it adds are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of digits, small ASCII letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that are always looked for, with their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Further key phrases.
MORE = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("apache license version 2 0", "apache-2.0"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("creative commons attribution", "cc-by"),
    ("bsd license", "bsd"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("isc license", "isc"),
    ("permission is hereby granted free of charge", "mit"),
)
Templates = tuple[tuple[tuple[str, ...], str], ...]
TEMPLATES: Templates = tuple((tuple(phrase.split()), label) for phrase, label in BASE + MORE)
VOCABULARY = tuple(sorted({w for phrase, _ in TEMPLATES for w in phrase}))


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def license_word_counts(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of those that hold each licence word (a row for each word reaches the driver)."""
    have = docs.select(F.array_distinct(F.filter(words(), lambda w: w.isin(*vocabulary))).alias("w"))
    counts = have.select(F.explode(F.concat("w", F.array(F.lit(" ")))).alias("w")).groupBy("w").count().collect()
    found = {r.w: r["count"] for r in counts}
    return found.pop(" ", 0), found


def idf(total: int, df: int) -> float:
    return math.log((total + 1) / (df + 1)) + 1


def find_licenses(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """``docs`` with n_words, hits (array of template number and start, in this order) and score.

    The score is 1 where a phrase is verified, else half the largest IDF-weighted share of a
    phrase's words that stand at their places around one of its rare words.
    """
    vocabulary = sorted({w for p, _ in templates for w in p})
    total, df = license_word_counts(docs, vocabulary)
    weight = {w: idf(total, df.get(w, 0)) for w in vocabulary}
    index: dict[str, list[tuple[int, int]]] = {}
    needs = []
    for n, (phrase, _) in enumerate(templates):
        rarest = sorted(range(len(phrase)), key=lambda k, p=phrase: (-weight[p[k]], k))[:2]
        needs.append(len(rarest))
        for k in rarest:
            index.setdefault(phrase[k], []).append((n, k))

    literal = lambda xs: F.array(*[F.lit(x) for x in xs])
    entries = [F.struct(F.lit(w).alias("key"), F.array(*[F.struct(F.lit(n).alias("template"), F.lit(k).alias("k")) for n, k in ps]).alias("value")) for w, ps in index.items()]
    postings = F.map_from_entries(F.array(*entries))
    phrases, need = F.array(*[literal(p) for p, _ in templates]), literal(needs)
    weights = F.array(*[literal([weight[w] for w in p]) for p, _ in templates])

    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(own.alias("row"), words().alias("words"))
    rare = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*index))
    out = out.withColumn("rare", rare).withColumn("any", F.size("rare") > 0)
    proposed = F.flatten(F.transform("rare", lambda x: F.transform(F.try_element_at(postings, x["w"]), lambda t: F.struct(t["template"].alias("template"), (x["i"] - t["k"]).cast("long").alias("start")))))
    out = out.withColumn("places", F.when(F.col("any"), F.array_sort(proposed)))
    phrase = lambda c: F.get(phrases, c["template"])
    both = F.filter("places", lambda c, j: (F.get(need, c["template"]) == 1) | c.eqNullSafe(F.get("places", j + 1)))
    fits = F.filter(both, lambda c: (c["start"] >= 0) & (F.slice("words", F.greatest(c["start"], F.lit(0)).cast("int") + 1, F.size(phrase(c))) == phrase(c)))
    out = out.withColumn("hits", F.when(F.col("any"), fits).otherwise(F.expr("cast(array() as array<struct<template:int,start:bigint>>)")))

    def share(c: Column) -> Column:
        own_weights = F.get(weights, c["template"])
        there = F.zip_with(phrase(c), F.sequence(F.lit(0), F.size(phrase(c)) - 1), lambda w, k: F.when(w == F.get("words", (c["start"] + k).cast("int")), F.get(own_weights, k)).otherwise(F.lit(0.0)))
        add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
        return add(there) / add(own_weights)

    partial = F.round(F.coalesce(F.array_max(F.transform(F.array_distinct("places"), share)), F.lit(0.0)) / 2, 6)
    score = F.when(F.size("hits") > 0, 1.0).when(F.col("any"), partial).otherwise(0.0)
    done = out.select("row", F.size("words").cast("long").alias("n_words"), "hits", score.alias("score"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_words", "hits", "score")]
    return done.select(*kept, F.col("n_words"), F.col("hits"), F.col("score"))


def labels_of(hits: str, templates: int) -> Column:
    """Distinct labels of the first ``templates`` templates among the hits, sorted and joined."""
    names = F.array(*[F.lit(label) for _, label in TEMPLATES])
    own = F.filter(hits, lambda h: h["template"] < templates)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(own, lambda h: F.get(names, h["template"])))), ",")


def license_sql() -> str:
    """DuckDB SQL for the same result from the same phrases, by trying every place."""

    def places(phrase: tuple[str, ...]) -> str:
        return f"list_filter(range(1, greatest(1, len(w) - {len(phrase) - 2})), lambda i: list_slice(w, i, i + {len(phrase) - 1}) = {list(phrase)})"

    columns = ",\n    ".join(f"{places(p)} AS p{n}" for n, (p, _) in enumerate(TEMPLATES))
    label = lambda n: f"CASE WHEN len(p{n}) > 0 THEN '{TEMPLATES[n][1]}' END"
    joined = lambda ns: f"coalesce(array_to_string(list_sort(list_distinct([x FOR x IN [{', '.join(map(label, ns))}] IF x IS NOT NULL])), ','), '')"
    base = f"flatten([{', '.join(f'p{n}' for n in range(len(BASE)))}])"
    table = ", ".join(f"({n}, {list(p)})" for n, (p, _) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
v AS (SELECT unnest({list(VOCABULARY)}) AS word),
n AS (SELECT v.word, ln(((SELECT count(*) FROM d) + 1) / (count(d.doc_id) + 1)) + 1 AS idf FROM v LEFT JOIN d ON list_contains(d.w, v.word) GROUP BY v.word),
t AS (SELECT * FROM (VALUES {table}) t(n, phrase)),
k AS (SELECT n, phrase, unnest(phrase) AS word, unnest(range(len(phrase))) AS k FROM t),
g AS (SELECT k.n, any_value(phrase) AS phrase, list(idf ORDER BY k) AS idfs FROM k JOIN n USING (word) GROUP BY k.n),
a AS (SELECT n, word, k FROM k JOIN n USING (word) QUALIFY row_number() OVER (PARTITION BY n ORDER BY idf DESC, k) <= 2),
i AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
c AS (SELECT DISTINCT r, n, i - k AS start FROM i JOIN a USING (word)),
q AS (SELECT r, max(list_sum(list_transform(range(len(phrase)), lambda k: CASE WHEN start + k >= 0 AND w[start + k + 1] = phrase[k + 1] THEN idfs[k + 1] ELSE 0 END)) / list_sum(idfs)) AS share FROM c JOIN g USING (n) JOIN d USING (r) GROUP BY r),
p AS (SELECT r, doc_id, w,
    {columns}
    FROM d),
s AS (SELECT *, list_transform({base}, lambda i: i - 1) AS b, {joined(range(len(BASE)))} AS base_labels, {joined(range(len(TEMPLATES)))} AS labels FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(b)::BIGINT AS n_base, list_min(b)::BIGINT AS first_word, list_max(b)::BIGINT AS last_word, base_labels, labels,
    CASE WHEN labels <> '' THEN 1.0 ELSE round(coalesce(share, 0) / 2, 6) END::DOUBLE AS score
FROM s LEFT JOIN q USING (r)
"""
