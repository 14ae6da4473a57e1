"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are the e-mail addresses, IP addresses, card and phone
numbers of the corpus. A term (a word of three letters or more) stands near an
entity if it is within ``NEAR`` characters of a find of it. Over all documents,
``PMI(term; entity) / IC(entity)`` is the share of the entity's information that
the term gives away: 1 where the term occurs with the entity only. Pairs that
stand together in ``LEAST_TEXTS`` or more different texts are judged; in the
documents where they do, terms are generalised from ``GENERALISE`` on and
removed from ``REMOVE`` on, wherever they stand in those documents.

Defined results: null text is empty; every row has its own result, repeated
rows and null ids too. Finds that fail their check are dropped without another
try at the same place. Words cut by the edge of a context are not in it; words
in e-mail addresses are no terms. Copies count as documents but not as further
texts. Entities that every document holds give nothing away. Other columns are
left out.

Bounds: arrays are those of one text; places in a text come from running sums
over its finds or words. Counts are pre-aggregated; nothing is broadcast by
hint or collected but the number of documents. Patterns take each run of
characters once, so long texts cost their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave.llm.common import table
from ringweave.session import stage

# The kinds in order, and their patterns. Possessive repeats and
# the look behind a run's start find what the plain patterns find, in linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what any valid find has; texts without it are not cut
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: further kinds of spans
GENERAL, REMOVED = "generalised", "removed"
NAMES = (*KINDS, GENERAL, REMOVED)

NEAR = 120
LEAST_TEXTS = 3
GENERALISE, REMOVE = 0.8, 0.95
LETTERS = r"[\p{L}\p{M}]"
TERM = LETTERS + "{3,}"
#: an address, or a run of letters that stops where an address starts
PIECE = f"{PATTERNS['email']}|(?:(?!{PATTERNS['email']}){LETTERS})++"

#: ``done`` is where the spans before end
SPAN = "struct<start:bigint,kind:int,stop:bigint,done:bigint>"


def pieces(text: Column, pattern: str) -> Column:
    """Finds of a pattern, each with the gap before and the gap after it."""
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), gaps.alias("before"), F.slice(gaps, 2, F.size(gaps)).alias("after"))
    return F.filter(zipped, lambda p: p["found"].isNotNull())


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(2 * v - 9 * (v > 4)) for v in range(10)]), d.cast("int") + 1)))
    return F.aggregate(places, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: Column, found: Column) -> Column:
    number = digits(found)
    size = F.length(number)
    parts = F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    # the number is read only where its length is right
    card = F.when(size.between(14, 19), luhn(number)).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, parts).when(kind == 2, card).otherwise(size.between(10, 15))


def context(before: Column, after: Column) -> Column:
    """Different lower-case terms within ``NEAR`` characters of a find."""
    left = F.when(F.length(before) > NEAR, F.regexp_replace(F.substring(before, -NEAR - 1, NEAR + 1), f"^{LETTERS}+", "")).otherwise(before)
    right = F.when(F.length(after) > NEAR, F.regexp_replace(F.substring(after, 1, NEAR + 1), f"{LETTERS}+$", "")).otherwise(after)
    plain = F.regexp_replace(F.concat(left, F.lit(" "), right), PATTERNS["email"], " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(TERM), F.lit(0)))


def rows_with_finds(docs: DataFrame, keep_text: bool) -> DataFrame:
    """``rid, doc_id, text, finds``: a written table, so that the row numbers hold."""
    text = F.coalesce(F.col("text"), F.lit(""))
    def cut(no: int, kind: str) -> Column:
        def find(p: Column, i: Column) -> Column:
            return F.struct(
                F.lit(no).alias("kind"), i.alias("i"), p["found"].alias("found"), F.length(p["before"]).alias("gap"), context(p["before"], p["after"]).alias("terms")
            )

        return F.when(F.rlike(text, F.lit(HINTS[kind])), F.transform(pieces(text, PATTERNS[kind]), find))

    found = [cut(no, kind) for no, kind in enumerate(KINDS)]
    none = F.array().cast("array<struct<kind:int,i:int,found:string,gap:int,terms:array<string>>>")
    rows = docs.select("doc_id", text.alias("text"), F.concat(*[F.coalesce(f, none) for f in found]).alias("finds"))
    text = F.col("text") if keep_text else F.when(F.size("finds") > 0, F.col("text"))
    own = F.monotonically_increasing_id().alias("rid")
    return stage(rows.select(own, "doc_id", text.alias("text"), F.xxhash64("text").alias("content"), "finds"), "private_rows")


def entities(rows: DataFrame) -> DataFrame:
    """``rid, content, kind, start, stop, entity, terms`` of every valid find."""
    each = rows.where(F.size("finds") > 0).select("rid", "content", F.explode("finds").alias("f")).select("rid", "content", "f.*")
    ends = F.sum(F.col("gap") + F.length("found")).over(Window.partitionBy("rid", "kind").orderBy("i"))
    placed = each.withColumn("stop", ends).withColumn("ok", valid(F.col("kind"), F.col("found"))).where("ok")
    name = F.when(F.col("kind") == 0, F.lower("found")).when(F.col("kind") == 1, F.col("found")).otherwise(digits(F.col("found")))
    return placed.select("rid", "content", "kind", (F.col("stop") - F.length("found")).alias("start"), "stop", F.concat_ws(":", "kind", name).alias("entity"), "terms")


def disclosing(docs: DataFrame, rows: DataFrame, finds: DataFrame) -> DataFrame:
    """``rid, term, share``: terms to sanitise in a document and how much they give away there."""
    n = rows.count()
    pairs = stage(finds.select("rid", "content", "entity", F.explode("terms").alias("term")).distinct(), "private_pairs")
    by_text = pairs.groupBy("entity", "term", "content").agg(F.count("*").alias("k"))
    both = by_text.groupBy("entity", "term").agg(F.sum("k").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= LEAST_TEXTS)
    both = stage(both, "private_counts")
    plain = F.when(F.contains("text", F.lit("@")), F.regexp_replace("text", PATTERNS["email"], " ")).otherwise(F.col("text"))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(TERM), F.lit(0)))).alias("term"))
    terms = words.groupBy("term").agg(F.count("*").alias("n_term"))
    known = finds.select("rid", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") < n)
    pmi = F.log2(F.lit(float(n)) * F.col("n_both") / F.col("n_entity") / F.col("n_term"))
    shares = both.join(terms, "term").join(known, "entity").select("entity", "term", (pmi / F.log2(F.lit(float(n)) / F.col("n_entity"))).alias("share"))
    shares = stage(shares.where(F.col("share") >= GENERALISE), "private_shares")
    return pairs.join(shares, ["entity", "term"]).groupBy("rid", "term").agg(F.max("share").alias("share"))


def term_spans(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``rid, start, kind, stop`` of every occurrence of a document's marked terms."""
    texts = rows.join(marked.select("rid").distinct(), "rid", "left_semi").select("rid", F.posexplode(pieces(F.col("text"), PIECE)).alias("i", "p"))
    lengths = texts.select("rid", "i", F.lower("p.found").alias("term"), F.length("p.found").alias("size"), F.length("p.before").alias("gap"))
    placed = lengths.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("rid").orderBy("i")))
    kind = F.when(F.col("share") >= REMOVE, NAMES.index(REMOVED)).otherwise(NAMES.index(GENERAL))
    return placed.join(marked, ["rid", "term"]).select("rid", (F.col("stop") - F.col("size")).alias("start"), kind.alias("kind"), "stop")


def spans_of(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, text, spans`` of every row; spans are sorted, then by kind as in ``NAMES``.

    Without ``keep_text`` rows without finds have null text.
    """
    docs = docs.select("doc_id", "text")
    rows = rows_with_finds(docs, keep_text)
    finds = stage(entities(rows), "private_finds")
    marked = stage(disclosing(docs, rows, finds), "private_terms")
    every = finds.select("rid", "start", "kind", "stop").unionByName(term_spans(rows, marked))
    earlier = Window.partitionBy("rid").orderBy("start", "kind", "stop").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("done", F.coalesce(F.max("stop").over(earlier), F.lit(0)))
    listed = every.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "done").cast(SPAN))).alias("spans"))
    spans = F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))
    return rows.select("rid", "doc_id", "text").join(listed, "rid", "left").select("doc_id", "text", spans.alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``doc_id, text, spans``: texts with placeholders for what gives an entity away."""
    rows = spans_of(docs, keep_text=True)
    names = F.array(*map(F.lit, NAMES))

    def piece(s: Column) -> Column:
        """The text between the spans before and this one, and its placeholder; spans that overlap earlier ones add nothing but what sticks out."""
        gap = F.greatest(s["start"] - s["done"], F.lit(0)).cast("int")
        sign = F.when(s["start"] >= s["done"], F.concat(F.lit("<"), F.get(names, s["kind"]), F.lit(">"))).otherwise("")
        return F.concat(F.substr("text", (s["done"] + 1).cast("int"), gap), sign)

    last = F.coalesce(F.array_max(F.transform("spans", lambda s: s["stop"])), F.lit(0)).cast("int")
    text = F.concat(F.array_join(F.transform("spans", piece), ""), F.substr("text", last + 1))
    return rows.select("doc_id", text.alias("text"), "spans")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, NAMES)), s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def is_kind(no: int):
    return lambda k: k == no


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans_of(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, is_kind(no))).cast("long").alias(f"n_{kind}") for no, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
