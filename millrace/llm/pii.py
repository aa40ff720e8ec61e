"""Information-theoretic sanitisation of personal data.

Personal data is found by pattern in whole texts.  Besides, the corpus tells how strongly the
words of a text reveal an entity in it: over all distinct texts, those without entities too,

    PMI(term, entity) = log(N * n(term, entity) / (n(term) * n(entity)))
    IC(entity)        = log(N / n(entity))

and a term that stands with an entity in at least ``support`` distinct texts, at any distance,
carries PMI >= ``threshold`` * IC and stands there by more than chance (n(term, entity) * PMI of at
least ``evidence`` nats, a likelihood ratio) discloses it.  It is found at every place of every
text, also where the entity itself does not stand.  Words that are part of an entity are no
terms.  Long tokens that mix letters and digits carry so much information by themselves that
they are found as secrets.  Copies of a text count once, so copying alone makes no term
disclosing.  Redaction generalises entities to their kind and removes disclosing terms.
Everything is DataFrame functions; terms travel as 64-bit hashes.

Positions are code points, ends exclusive.  Defined results: a null text has no spans and
stays null; an empty table gives an empty table; repeated rows give repeated results; ids may
repeat or be null, they are not used; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import drop, materialise

#: Kinds with their patterns.  Possessive runs that start at the start of a run (or where
#: the last match ended) find the same matches as plain ones, in linear time on any text.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{20,}+",
}
CHECKS = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(trim(leading '0' from p)) <= 3 and coalesce(try_cast(trim(leading '0' from p) as int), 0) <= 255)",
    "card": "length(regexp_replace(m, '[^0-9]', '')) between 13 and 19 and luhn_check(regexp_replace(m, '[^0-9]', ''))",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15",
    "secret": "true",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "contains(text, '@')", "ip": "contains(text, '.')", "card": "true", "phone": "contains(text, '+')", "secret": "true"}
KINDS = (*PATTERNS, "term")
TERM = r"\p{L}[\p{L}\p{M}'-]{2,}"
SPAN = "struct<kind:string,start:int,stop:int,value:string>"
NONE = f"cast(array() as array<{SPAN}>)"
SMALL = 1_000_000  # rows of one or two longs that are broadcast; more are shuffled


def _located(text: str, pattern: str) -> str:
    """SQL for array<struct<start, m>> of the matches: gaps and matches alternate, their lengths add up."""
    q = pattern.replace("\\", "\\\\").replace("'", "\\'")
    gaps, matches = f"split({text}, '{q}', -1)", f"regexp_extract_all({text}, '{q}', 0)"
    step = "(a, x) -> struct(a.at + length(x.g) + length(x.m) as at, concat(a.found, array(struct(a.at + length(x.g) as start, x.m as m))) as found)"
    zipped = f"filter(zip_with({gaps}, {matches}, (g, m) -> struct(coalesce(g, '') as g, m)), x -> x.m is not null)"
    return f"aggregate({zipped}, struct(0 as at, cast(array() as array<struct<start:int,m:string>>) as found), {step}).found"


def base_spans() -> Column:
    """All spans of ``text`` by pattern, in order of kind, then start."""
    parts = []
    for kind in PATTERNS:
        kept = f"filter({_located('text', PATTERNS[kind])}, x -> exists(array(x.m), m -> {CHECKS[kind]}))"
        parts.append(f"case when {HINTS[kind]} then transform({kept}, x -> named_struct('kind', '{kind}', 'start', x.start, 'stop', x.start + length(x.m), 'value', x.m)) else {NONE} end")
    return F.expr(f"cast(concat({', '.join(parts)}) as array<{SPAN}>)")


def _masked() -> str:
    """SQL for ``text`` with a space for each character of its spans."""
    step = "(a, s) -> case when s.start >= a.at then struct(s.stop as at, concat(a.done, array(substring(text, a.at + 1, s.start - a.at), repeat(' ', s.stop - s.start))) as done) else struct(greatest(a.at, s.stop) as at, concat(a.done, array(repeat(' ', greatest(s.stop - a.at, 0)))) as done) end"
    ordered = "array_sort(spans, (x, y) -> case when x.start < y.start then -1 when x.start > y.start then 1 else 0 end)"
    return f"case when size(spans) = 0 then text else aggregate({ordered}, struct(0 as at, cast(array() as array<string>) as done), {step}, a -> concat(array_join(a.done, ''), substring(text, a.at + 1))) end"


def _places(terms: str) -> str:
    """SQL for array<struct<start, stop, term>>: the places of ``terms`` (hashes) in ``masked``, in order."""
    q = TERM.replace("\\", "\\\\").replace("'", "\\'")
    zipped = f"filter(zip_with(split(masked, '{q}', -1), regexp_extract_all(masked, '{q}', 0), (g, m) -> struct(length(coalesce(g, '')) as g, m)), x -> x.m is not null)"
    place = "struct(a.at + x.g as start, a.at + x.g + length(x.m) as stop, lower(x.m) as term)"
    step = f"(a, x) -> struct(a.at + x.g + length(x.m) as at, case when array_contains({terms}, xxhash64(lower(x.m))) then concat(a.found, array({place})) else a.found end as found)"
    return f"aggregate({zipped}, struct(0 as at, cast(array() as array<struct<start:int,stop:int,term:string>>) as found), {step}).found"


def scan(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), text, text_key and spans by pattern of every text."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.withColumns({"text_key": F.xxhash64("text"), "spans": base_spans()})


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, as a broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def distinct_words(docs: DataFrame) -> DataFrame:
    """text_key, entities and words (hashes; distinct, outside of spans) of each distinct text."""
    entities = F.expr("array_distinct(transform(filter(spans, s -> s.kind <> 'secret'), s -> xxhash64(s.kind, lower(s.value))))")
    q = TERM.replace("\\", "\\\\").replace("'", "\\'")
    words = F.expr(f"array_distinct(transform(regexp_extract_all(masked, '{q}', 0), m -> xxhash64(lower(m))))")
    d = scan(docs.select("text")).select("text_key", entities.alias("entities"), F.expr(_masked()).alias("masked"))
    return d.select("text_key", "entities", words.alias("words")).dropDuplicates(["text_key"])


def disclosing(seen: DataFrame, threshold: float = 0.9, support: int = 3, evidence: float = 12.0) -> DataFrame:
    """(entity, term) pairs that exceed the threshold, from counts over :func:`distinct_words`.

    Only entities of at least ``support`` texts meet the words of these texts, and only terms
    that stand with one of them that often are counted in all texts.
    """
    holds = seen.where("size(entities) > 0").select("words", F.explode("entities").alias("entity"))
    per_entity = materialise(holds.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support), "entities")
    pairs = holds.join(_small(per_entity), "entity").select("entity", "n_e", F.explode("words").alias("term"))
    pairs = materialise(pairs.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support), "pairs")
    terms = materialise(pairs.select("term").distinct(), "terms")
    per_term = seen.select(F.explode("words").alias("term")).join(_small(terms), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    total = seen.count()
    joined = pairs.join(per_term, "term").withColumn("pmi", F.log(total * F.col("n_te") / (F.col("n_t") * F.col("n_e"))))
    shown = (F.col("n_e") < total) & (F.col("pmi") >= threshold * F.log(total / F.col("n_e"))) & (F.col("n_te") * F.col("pmi") >= evidence)
    out = materialise(joined.where(shown).select("entity", "term"), "disclosing")
    drop(per_entity, pairs, terms)
    return out


def all_spans(docs: DataFrame, threshold: float = 0.9, support: int = 3, evidence: float = 12.0) -> DataFrame:
    """row (all columns of ``docs``), text and spans: those by pattern and the disclosing terms."""
    seen = materialise(distinct_words(docs), "words")
    terms = materialise(disclosing(seen, threshold, support, evidence).select("term").distinct(), "disclosing")
    hits = seen.select("text_key", F.explode("words").alias("term")).join(_small(terms), "term")
    hits = materialise(hits.groupBy("text_key").agg(F.collect_set("term").alias("terms")), "hits")
    drop(seen, terms)
    both = scan(docs).join(hits, "text_key", "left").withColumn("masked", F.when(F.col("terms").isNotNull(), F.expr(_masked())))
    more = F.expr(f"case when terms is null then {NONE} else cast(transform({_places('terms')}, t -> named_struct('kind', 'term', 'start', t.start, 'stop', t.stop, 'value', t.term)) as array<{SPAN}>) end")
    return both.select("row", "text", F.concat("spans", more).alias("spans"))


def joined_spans(spans: str, kinds: tuple[str, ...] = KINDS) -> Column:
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(spans: str = "spans") -> Column:
    """``text`` with each span generalised to its kind, terms removed; spans that overlap become one."""
    mark = "case when s.kind = 'term' then '' else concat('<', upper(s.kind), '>') end"
    step = f"(a, s) -> case when s.start >= a.at then struct(s.stop as at, concat(a.done, array(substring(text, a.at + 1, s.start - a.at), {mark})) as done) else struct(greatest(a.at, s.stop) as at, a.done as done) end"
    ordered = f"array_sort({spans}, (x, y) -> case when x.start < y.start then -1 when x.start > y.start then 1 when x.stop > y.stop then -1 when x.stop < y.stop then 1 else 0 end)"
    walk = f"aggregate({ordered}, struct(0 as at, cast(array() as array<string>) as done), {step}, a -> concat(array_join(a.done, ''), substring(text, a.at + 1)))"
    return F.expr(walk)


def sanitise(docs: DataFrame, threshold: float = 0.9, support: int = 3, evidence: float = 12.0) -> DataFrame:
    """``docs`` with the personal data of ``text`` generalised or removed; all columns are kept."""
    found = all_spans(docs, threshold, support, evidence)
    clean = F.when(F.size("spans") > 0, redacted()).otherwise(F.col("row")["text"])
    return found.select(*[(clean if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
