"""Extractors and text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*\bhref\s*=\s*"([^"]*)"'), F.lit(1))


def graphql(body: Column) -> Column:
    low = F.lower(body)
    seen = F.contains(low, F.lit("__schema")) | F.contains(low, F.lit("__typename"))
    return F.struct(low.rlike(r"\bgraphql\b|__schema|__typename|query\s*\{").alias("detected"), seen.alias("introspection"))


def sitemap_locs(xml: Column) -> Column:
    found = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def security_txt(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, key of the line, vals): the values of each field in order, joined by |."""
    lines = docs.select(F.col(key), F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("o", "raw")).select(key, "o", F.trim("raw").alias("line")).where("line <> '' and not startswith(line, '#') and instr(line, ':') > 0")
    fields = lines.select(F.col(key), "o", F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("v"))
    return fields.groupBy(key, "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]), "|").alias("vals"))


def cpe_fields(cpe: Column) -> Column:
    """Fields between unescaped colons, without the escapes."""
    return F.transform(F.split(cpe, r"(?<!\\):"), lambda x: F.regexp_replace(x, r"\\(.)", "$1"))


def cookie(value: Column) -> Column:
    """struct(name, attributes): lower-cased attribute names, null where there is no value."""
    parts = F.transform(F.split(value, ";"), lambda x: F.trim(x))
    own = F.filter(F.slice(parts, 2, 1000), lambda x: x != "")
    entry = lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit("="), F.lit(1)))).alias("key"), F.when(F.instr(x, "=") > 0, F.trim(F.regexp_extract(x, "^[^=]*=(.*)$", 1))).alias("value"))
    pairs = F.transform(own, entry)
    # of attributes that repeat the last one counts
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.lit(1000)), lambda y: y["key"] == x["key"]))
    return F.struct(F.trim(F.split_part(F.element_at(parts, 1), F.lit("="), F.lit(1))).alias("name"), F.map_from_entries(last).alias("attributes"))


def entropy_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entropy) in bits for each character; 0 for empty texts."""
    chars = docs.select(F.col(key), F.explode(F.split(F.coalesce(text, F.lit("")), "")).alias("ch")).where("ch <> ''").groupBy(key, "ch").agg(F.count("*").alias("c"))
    # -sum(p log p) = log(n) - sum(c log c) / n
    sums = chars.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return docs.select(key).distinct().join(sums, key, "left").select(key, F.coalesce(F.log2("n") - F.col("s") / F.col("n"), F.lit(0.0)).alias("entropy"))


def bounded(value: Column, low: float, high: float) -> Column:
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.least(F.lit(high), F.greatest(F.lit(low), value))).otherwise(0.0)


def csv_cell(value: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(value.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def csv_line(cells: Column) -> Column:
    """An array of texts as a line of CSV, quoted where one has a comma, quote or line end; a single empty cell is quoted."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    one = (F.size(cells) == 1) & (F.element_at(cells, 1) == "")
    return F.when(one, F.lit('""')).otherwise(F.array_join(F.transform(cells, lambda c: F.when(c.rlike('[,"\r\n]'), quoted(c)).otherwise(c)), ","))
