"""Personal data in texts: fixed patterns, and identifiers found by the contexts such data stand in.

``base`` finds emails, IPv4 addresses, payment cards and phone numbers by their patterns.  They are the
seeds of a bootstrapped extraction:

1. Every identifier-like string (``SHAPES``: around an @, or a number of seven digits and more) is an
   *instance*; the words around it make up to three lexical *patterns*: the two words before it, the word
   before and the word after it, a last word before it that ends in ``:``, ``=`` or ``#``.
2. A pattern's precision for a kind is the confidence of its distinct instances for that kind over
   their number.  Patterns with the support ``SUPPORT`` and the precision ``PRECISION`` are trusted.
3. An unseen instance gets the confidence ``1 - product of (1 - precision)`` over the trusted
   patterns it stands in; from ``PRECISION`` on it counts as an instance of that kind in the next
   of ``ROUNDS`` rounds.

Where an accepted instance stands in a trusted pattern, and touches no span of ``base``, it becomes a
span of the pattern's kind.

Texts are read once; edges between patterns and instances are distinct and pre-aggregated, so that a
text with many copies or a very common pattern is a row with a count before anything is joined.
DataFrame functions only.

Defined results: a null text is empty; empty texts have no spans; equal texts, repeated rows and rows
with null ids each get their own row with the same spans; an empty table gives no rows; a tie between
kinds goes to the one listed first; columns other than doc_id and text play no part.  Offsets are
code points, ends are exclusive.  The patterns below need time linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.flow import Tables

KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain patterns: runs are taken whole, and a search that failed at the start
#: of a run isn't repeated inside it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before a pattern is tried on it.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){12}", "phone": r"\+[0-9]"}
SHAPES = {
    "at": r"""(?:\G|(?<![^\s@<>()"',;:]))[^\s@<>()"',;:]++@[^\s@<>()"',;:]++""",
    "number": r"[+(]?[0-9][0-9\x20().-]*[0-9]",
}
SHAPE_HINTS = {"at": "@", "number": r"[0-9](?:[\x20().-]*+[0-9]){6}"}
SHAPE_OF = {"email": "at", "ip": "number", "card": "number", "phone": "number"}

LEAST_DIGITS = 7
RUN = 256             # matches placed at a time
CONTEXT = 60          # characters looked at on either side
SUPPORT = 5           # distinct instances a pattern must have
PRECISION = 0.8
ROUNDS = 3

SPAN = "array<struct<kind:int,start:int,end:int>>"
SLOT = "array<struct<start:int,end:int,surface:string,before:string,after:string>>"


# --- spans by pattern

def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a short string of digits has the check digit of payment cards."""
    def add(total: Column, place: Column) -> Column:
        x = F.substr(number, F.length(number) - place + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return total + F.when(place % 2 == 0, twice).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """The condition on a match of the kind's pattern."""
    if kind == "email":
        return match.isNotNull()
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    n = F.length(digits(match))
    return n.between(9, 15) if kind == "phone" else n.between(13, 19) & luhn(digits(match))


def located(pieces: str, found: str, keep: Callable, entry: Callable, schema: str) -> Column:
    """Runs of ``RUN`` matches: the length of each with the pieces before its matches, and ``entry`` of
    every match that ``keep`` lets through, placed from the run's start.

    ``pieces`` is the text split at the matches, one more than ``found``.  Both are columns, so that a
    run takes slices of what was computed once.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast(schema).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        begin = acc["at"] + F.length(r["p"])
        end = begin + F.length(r["m"])
        return F.struct(end.alias("at"), F.when(F.coalesce(keep(r["m"]), F.lit(False)), F.concat(
            acc["out"], F.array(entry(begin, end, r)).cast(schema))).otherwise(acc["out"]).alias("out"))

    def run(k: Column) -> Column:
        here = k * RUN + 1
        rows = F.zip_with(F.zip_with(F.slice(pieces, here, F.lit(RUN)), F.slice(found, here, F.lit(RUN)),
                                     lambda p, m: F.struct(p.alias("p"), m.alias("m"))),
                          F.slice(pieces, here + 1, F.lit(RUN)),
                          lambda r, after: F.struct(r["p"].alias("p"), r["m"].alias("m"), after.alias("after")))
        return F.aggregate(F.filter(rows, lambda r: r["m"].isNotNull()), start, step)
    return F.when(F.size(found) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), run))


def joined(runs: str, shifted: Callable, schema: str) -> Column:
    """The entries of all runs, placed in the text."""
    starts = F.aggregate(F.slice(runs, 1, F.size(runs) - 1), F.array(F.lit(0)), lambda at, r: F.concat(
        at, F.array(F.element_at(at, -1) + r["at"])))
    placed = F.zip_with(runs, starts, lambda r, at: F.transform(r["out"], lambda e: shifted(e, at)))
    return F.coalesce(F.when(F.size(runs) > 0, F.flatten(placed).cast(schema)), F.array().cast(schema))


def read_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, one, two, base, at, number): the spans of ``base`` and the slots of both shapes.

    ``one`` and ``two`` are the key of the text, 128 bits.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("one"),
                       F.xxhash64(F.lit(len(KINDS)), "text").alias("two"))
    cut = {}
    for name, pattern in (PATTERNS | SHAPES).items():
        has = F.col("text").rlike((HINTS | SHAPE_HINTS)[name])
        cut[f"{name}_pieces"] = F.when(has, F.split("text", pattern, -1))
        cut[f"{name}_found"] = F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = rows.select("doc_id", "one", "two", *[c.alias(n) for n, c in cut.items()])

    def spans(k: int, kind: str) -> Column:
        return located(f"{kind}_pieces", f"{kind}_found", partial(holds, kind), lambda a, b, r: F.struct(
            F.lit(k).alias("kind"), a.alias("start"), b.alias("end")), SPAN)

    def slots(shape: str) -> Column:
        keep = (lambda m: m.isNotNull()) if shape == "at" else (
            lambda m: F.length(digits(m)) >= LEAST_DIGITS)
        return located(f"{shape}_pieces", f"{shape}_found", keep, lambda a, b, r: F.struct(
            a.alias("start"), b.alias("end"), r["m"].alias("surface"),
            F.right(r["p"], F.lit(CONTEXT)).alias("before"), F.left(r["after"], F.lit(CONTEXT)).alias("after")), SLOT)

    rows = rows.select("doc_id", "one", "two", *[spans(k, v).alias(v) for k, v in enumerate(KINDS)],
                       *[slots(s).alias(s) for s in SHAPES])

    def shifted(e: Column, at: Column) -> Column:
        return e.withField("start", e["start"] + at).withField("end", e["end"] + at)

    return rows.select("doc_id", "one", "two", F.concat(*[joined(v, shifted, SPAN) for v in KINDS]).alias("base"),
                       *[joined(s, shifted, SLOT).alias(s) for s in SHAPES])


# --- the graph of patterns and instances

def words(text: Column) -> Column:
    """Lower-case words with digits made equal."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"\s+"), lambda w: w != "")


def occurrences(texts: DataFrame) -> DataFrame:
    """(one, two, start, end, instance, shape, seeds, patterns) of every slot, once for equal texts."""
    both = None
    for shape in SHAPES:
        rows = texts.filter(F.size(shape) > 0).select("one", "two", F.explode(shape).alias("s"), F.lit(shape).alias(
            "shape"))
        both = rows if both is None else both.union(rows)
    rows = both.select("one", "two", "shape", "s.*").withColumns({
        "left": words(F.col("before")), "right": words(F.col("after")),
        "instance": F.when(F.col("shape") == "at", F.lower("surface")).otherwise(digits(F.col("surface")))})
    seeds = F.filter(F.array(*[F.when((F.col("shape") == SHAPE_OF[kind]) & F.exists(
        F.regexp_extract_all("surface", F.lit(PATTERNS[kind]), F.lit(0)), partial(holds, kind)), k)
        for k, kind in enumerate(KINDS)]), lambda k: k.isNotNull())
    second, last, after = (F.try_element_at(a, F.lit(n)) for a, n in (("left", -2), ("left", -1), ("right", 1)))
    patterns = F.array(F.concat(F.lit("2 "), second, F.lit(" "), last), F.concat(F.lit("m "), last, F.lit(" _ "), after),
                       F.when(last.rlike("[:=#]$"), F.concat(F.lit("1 "), last)))
    patterns = F.transform(F.filter(patterns, lambda p: p.isNotNull()), lambda p: F.concat("shape", F.lit(" "), p))
    return rows.select("one", "two", "start", "end", "shape", "instance", seeds.alias("seeds"),
                       patterns.alias("patterns")).filter(F.size("patterns") > 0).distinct()


def bootstrap(slots: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Trusted (pattern, kind, precision) and known (instance, kind, confidence) after all rounds."""
    every = slots.select(F.explode("patterns").alias("pattern"), "instance", "shape").distinct()
    # fewer distinct instances than the support can never be trusted
    totals = tables.stage(every.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT), "patterns")
    edges = tables.stage(every.join(totals, "pattern"), "edges")
    seeds = tables.stage(slots.select("instance", F.explode("seeds").alias("kind")).distinct().withColumn(
        "confidence", F.lit(1.0)), "seeds")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(SHAPE_OF[v]).alias("shape"))
                      for k, v in enumerate(KINDS)])
    known, trusted = seeds, None
    for _ in range(ROUNDS):
        held = edges.join(known, "instance").groupBy("pattern", "n", "kind").agg(
            F.sum("confidence").alias("mass"), F.count("*").alias("members"))
        trusted = tables.stage(held.withColumn("precision", F.col("mass") / F.col("n")).filter(
            (F.col("members") >= SUPPORT) & (F.col("precision") >= PRECISION)).select(
            "pattern", "kind", "precision"), "trusted")
        fits = F.exists(kinds, lambda k: (k["kind"] == F.col("kind")) & (k["shape"] == F.col("shape")))
        doubt = F.sum(F.log(1.0 - F.least(F.col("precision"), F.lit(0.999))))
        learned = (edges.join(trusted, "pattern").filter(fits).groupBy("instance", "kind")
                   .agg((1.0 - F.exp(doubt)).alias("confidence")).filter(F.col("confidence") >= PRECISION)
                   .join(seeds.select("instance", "kind"), ["instance", "kind"], "left_anti"))
        known = tables.stage(seeds.unionByName(learned), "known")
    return trusted, known


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) for every row: arrays of (kind, start, end), kinds as places in ``KINDS``."""
    tables = Tables(docs.sparkSession)
    texts = tables.stage(read_texts(docs), "texts")
    slots = tables.stage(occurrences(texts), "slots")
    trusted, known = bootstrap(slots, tables)
    best = F.min(F.struct((-F.col("precision")).alias("minus"), "kind"))
    hits = (slots.select("one", "two", "start", "end", "instance", F.explode("patterns").alias("pattern"))
            .join(trusted, "pattern").join(known, ["instance", "kind"])
            .groupBy("one", "two", "start", "end").agg(best.alias("best")))
    added = tables.stage(hits.groupBy("one", "two").agg(F.array_sort(F.collect_list(F.struct(
        F.col("best.kind").alias("kind"), "start", "end"))).cast(SPAN).alias("added")), "added")
    none = F.array().cast(SPAN)
    clear = F.filter(F.coalesce("added", none), lambda a: ~F.exists(
        "base", lambda b: (b["start"] < a["end"]) & (b["end"] > a["start"])))
    return texts.select("doc_id", "one", "two", "base").join(added, ["one", "two"], "left").select(
        "doc_id", "base", clear.alias("added"))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end by kind, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
