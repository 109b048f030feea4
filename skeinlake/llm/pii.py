"""Personal data by pattern, and information-theoretic sanitisation of the terms that give it away. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, materialize, shield

KINDS = ("email", "ip", "card", "phone", "term")
#: Code points on both sides of an entity whose words count as its context.
WINDOW = 60
#: A term discloses an entity if it stands near it in at least so many different contexts,
SUPPORT = 1
#: if at least this share of the documents that have the term also have it near the entity (above REMOVE and in SURE contexts it is removed, else generalised),
SHARE, REMOVE, SURE = 0.5, 0.9, 3
#: and if its contexts together make the entity likelier by so many bits.
BITS = 6.0
#: p(entity | term) is shrunken towards p(entity) by so many documents' worth.
PRIOR = 0.5

# What the kinds match, written so that Java's matcher neither tries a run of characters from its middle nor recurses: a match
# can only begin where a run does, or where the last one ended (\G).
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# runs of 14 digits and more: shorter ones fail in any case
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    digits = F.reverse(_digits(c))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise((F.substring(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.when(F.substring(digits, i, F.lit(1)) >= "5", 1).otherwise(0)),
    )
    return total % 10 == 0


def _valid(kind: str, c: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(c, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(c)).between(14, 19) & _luhn(c)
    if kind == "phone":
        return F.length(_digits(c)).between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: Column, kind: str, maybe: Column) -> Column:
    """Spans (start, order, kind, end, value) of all matches, in code points, end exclusive: the lengths of what lies between matches and of the matches add up."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    order = F.lit(KINDS.index(kind))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,value:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["between"])
        end = begin + F.length(x["found"])
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(begin.alias("start"), order.alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), x["found"].alias("value"))).alias("out"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("between"), found.alias("found"))
    return F.when(maybe, F.aggregate(pairs, start, step, lambda a: a["out"])).otherwise(F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,value:string>>"))


def _kept(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _of(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def base_spans(text: Column) -> Column:
    """All valid spans of the four patterns, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    numbers = text.rlike("[0-9]")
    each = (
        matches(text, F.lit(_EMAIL), "email", F.instr(text, "@") > 0),
        matches(text, F.lit(_IP), "ip", numbers & text.rlike(r"[0-9]\.[0-9]")),
        matches(text, F.lit(_CARD), "card", numbers & text.rlike(r"[0-9](?:[ -]?[0-9]){13}")),
        matches(text, F.lit(_PHONE), "phone", F.instr(text, "+") > 0),
    )
    kept = [_kept(k, m) for k, m in zip(KINDS, each, strict=False)]
    return F.array_sort(F.concat(*kept))


_NO_TERM = r"[^\p{L}\p{M}'-]+"


def disclosing_terms(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> tuple[DataFrame, DataFrame] | None:
    """(terms: term, bits, share, contexts), (hits: doc_id, term) of the terms that give a protected entity away, or None if there are none.

    A term's documents, and those where it stands within window of an entity, are counted over the whole corpus; contexts that copies repeat count once. The share is both / term's documents. p(entity | term)
    is shrunken towards p(entity), so that one context counts, but for less than many; log2 p(entity | term) / p(entity) are the bits that the term reveals, and contexts times bits its evidence:
    a rare entity needs one context, one that stands in many documents several, and one that stands in all is given away by nothing.
    Terms are words of three letters and more, whole within the window; what holds digits or @ is none.
    """
    # a code point more on either side shows where the window cuts a word, which is none then
    padded = F.concat(F.lit(" "), "text", F.lit(" "))
    before = F.substring(padded, F.greatest(F.lit(1), F.col("s.start") + 1 - window), F.least(F.lit(window), F.col("s.start")) + 1)
    after = F.substring(padded, F.col("s.end") + 2, F.lit(window + 1))
    spans = docs.select("doc_id", "text", F.explode(base_spans(F.col("text"))).alias("s")).select(
        "doc_id",
        F.xxhash64("s.kind", F.lower("s.value")).alias("entity"),
        F.concat_ws(" ", F.regexp_replace(before, r"^[\p{L}\p{M}'-]+", ""), F.regexp_replace(after, r"[\p{L}\p{M}'-]+$", "")).alias("context"),
    )
    near = materialize(spans.withColumn("context", F.lower(F.regexp_replace("context", r"\S*[@0-9]\S*", " "))), "contexts")
    entities = near.groupBy("entity").agg(F.count_distinct("doc_id").alias("e_docs"))
    words = near.select("doc_id", "entity", F.xxhash64("context").alias("c"), F.explode(F.array_distinct(F.split("context", _NO_TERM))).alias("term")).where(F.length("term") >= 3)
    pairs = words.groupBy("term", "entity").agg(F.count_distinct("c").alias("contexts"), F.count_distinct("doc_id").alias("both")).where(F.col("contexts") >= support)
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return None
    # terms are counted before they meet the candidates: near entities stand common words, too, and their rows would all pass the join
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), _NO_TERM))).alias("term"))
    df = tokens.groupBy("term").agg(F.count("*").alias("t_docs"))
    total = docs.count()
    # a term's best count decides first, in one row for each term, so that a common word's many entities meet no join
    top = pairs.groupBy("term").agg(F.max("both").alias("top")).join(df, "term").where(F.col("top") / F.col("t_docs") >= share)
    top = materialize(top.select("term", "t_docs"), "near-terms")
    own = pairs.join(broadcast_if_small(top), "term").where(F.col("both") / F.col("t_docs") >= share).join(entities, "entity")
    rate = F.col("e_docs") / F.lit(float(max(total, 1)))
    shrunken = (F.least("both", "t_docs") + PRIOR * rate) / (F.col("t_docs") + PRIOR)
    told = own.select("term", "contexts", F.least(F.lit(1.0), F.col("both") / F.col("t_docs")).alias("share"), F.log2(shrunken / rate).alias("bits")).where(F.col("contexts") * F.col("bits") >= bits)
    terms = materialize(told.groupBy("term").agg(F.max("bits").alias("bits"), F.max("share").alias("share"), F.max("contexts").alias("contexts")), "terms")
    n = terms.count()
    if not n:
        return None
    hits = materialize(tokens.join(F.broadcast(terms.select("term")) if n <= BROADCAST_ROWS else terms.select("term"), "term"), "hits")
    return terms, hits


def find(docs: DataFrame, text: str = "text", window: int = WINDOW, support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """docs with two more columns: spans, an array of (start, ord, kind, end, value) by start and kind, and removed, the found terms that are removed rather than generalised.

    Kinds email, ip, card and phone come from the patterns; term spans from disclosing_terms(). The corpus pass for terms runs once; a document's terms
    meet it by doc_id, so null ids share theirs; each term is then searched in the text itself.

    Null text: no spans. Repeated rows are searched each. Empty table: no rows. Other columns stay as they are.
    """
    slim = docs.select("doc_id", F.col(text).alias("text"))
    found = disclosing_terms(slim, window, support, share, bits)
    out = docs
    if found is None:
        return out.withColumn("spans", base_spans(F.col(text))).withColumn("removed", F.array().cast("array<string>"))
    terms, hits = found
    own = hits.join(terms, "term").groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set("term")).alias("_terms"), F.collect_set(F.when((F.col("share") >= REMOVE) & (F.col("contexts") >= SURE), F.col("term"))).alias("_removed"))
    own = materialize(own, "terms-of")
    n = own.count()
    out = docs.join(F.broadcast(own) if n <= BROADCAST_ROWS else own, docs["doc_id"].eqNullSafe(F.col("_id")), "left").drop("_id")
    # letters, marks, ' and - are all that a term holds, so it needs no quoting
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}'-])(?:"), F.array_join("_terms", "|"), F.lit(r")(?![\p{L}\p{M}'-])"))
    term_spans = matches(F.coalesce(F.col(text), F.lit("")), F.coalesce(pattern, F.lit("(?!)")), "term", F.col("_terms").isNotNull() & F.col(text).isNotNull())
    return out.withColumn("spans", F.array_sort(F.concat(base_spans(F.col(text)), term_spans))).withColumn("removed", F.coalesce("_removed", F.array().cast("array<string>"))).drop("_terms", "_removed")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of what find() returns."""
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(_of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def sanitize(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """docs with the spans of find() replaced in text: patterns by their kind in brackets, terms by [TERM] or, above REMOVE in SURE contexts, by nothing.

    Of spans that overlap the first replaces what it covers, later ones what is left of theirs. Null text stays null; n_chars, where docs has it, is counted anew.
    """
    own, restore = shield(docs, ("doc_id", text, "n_chars"))
    found = find(own, text, **limits)
    body = F.col(text)

    def step(a: Column, s: Column) -> Column:
        begin = F.greatest(a["at"], s["start"])
        gone = (s["kind"] == "term") & F.array_contains(F.col("removed"), F.lower(s["value"]))
        tag = F.when(s["end"] <= a["at"], F.lit("")).when(gone, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.substring(body, a["at"] + 1, begin - a["at"]), tag).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body))))
    out = found.withColumn("_clean", F.when(F.size("spans") > 0, clean).otherwise(body))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("_clean").cast("long")).otherwise(F.col("n_chars")))
    return restore(out.withColumn(text, F.col("_clean")))
