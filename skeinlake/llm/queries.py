"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, byte_bpe, decontamination, html_text, leaderboard, ngram_join, packing, pii, quality, toxicity, url_filter, warc
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), 4, (85, 100)).select("doc_id", "n_shingles", "component_id")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    found = toxicity.score(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"))
    # of every group the tokens are one more than its commas on either side of the bar
    count = lambda mark: (F.length("groups") - F.length(F.replace("groups", F.lit(mark)))).cast("long")
    n_groups = count("|")
    digests = found.select("doc_id", "n_a", (count(",") + 2 * n_groups - F.col("n_a")).alias("n_b"), n_groups.alias("n_groups"), F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256"), "links")
    return alignment.score(digests)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    words = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(words.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.feed(*(table(spark, sf_dir, t) for t in ("sale_lines", "vendors", "items")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_quality, op3_pii, op4_warc, op5_ngram_join, op6_toxicity, op7_decontamination, op8_ann, op9_html, op10_url_filter, op11_alignment, op12_byte_bpe, op13_leaderboard)
}

_TAG = lambda name, what: f"list_filter(regexp_extract_all(html, '(?is)<{name}\\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\\b{what}\\b'))[1]"
_FITS = "(host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%'"
_LONGEST = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
_RULE = "CASE " + " ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in _LONGEST) + " END"
_WORD = "CASE " + " ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{v}'" for v, h, p in _LONGEST) + " END"
_HOST = "translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

#: Only what SQL can say; the others are tested against brute force, round trips and held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op4_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS h FROM pages),
 o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS owner FROM p)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to FROM o""",
    "op10_url_filter": f"""WITH RECURSIVE found AS (SELECT regexp_replace(url, '(?s)#.*$', '') AS source, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site, unnest([
  regexp_extract({_TAG("link", "rel\\s*=\\s*[\"'']?canonical")}, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
  regexp_extract({_TAG("meta", "http-equiv\\s*=\\s*[\"'']?refresh")}, '(?is)url\\s*=\\s*([^"''\\s>]+)', 1)]) AS t FROM pages),
 links AS (SELECT DISTINCT source, target FROM (SELECT source, regexp_replace(CASE WHEN t LIKE '//%' THEN regexp_extract(site, '(?s)^(.*?:)//', 1) || t WHEN t LIKE '/%' THEN site || t ELSE t END, '(?s)#.*$', '') AS target FROM found WHERE t <> '') WHERE source <> target AND instr(target, '://') > 0),
 pairs AS (SELECT source AS a, target AS b FROM links UNION SELECT target, source FROM links),
 reach(node, alias) AS (SELECT a, a FROM pairs UNION SELECT reach.node, pairs.b FROM reach JOIN pairs ON reach.alias = pairs.a),
 words AS (SELECT node, bool_or(w = 'block') AS blocked, bool_or(w = 'allow') AS allowed FROM (SELECT node, {_WORD} AS w FROM (SELECT node, {_HOST.format(u="alias")} AS host, {_PATH.format(u="alias")} AS path FROM reach)) GROUP BY node),
 seen AS (SELECT page_id, url, coalesce({_HOST.format(u="url")}, '') AS host, coalesce({_PATH.format(u="url")}, '') AS path FROM pages)
 SELECT page_id, host, path, {_RULE} AS rule, coalesce({_WORD}, CASE WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' END, 'allow') AS verdict
 FROM seen LEFT JOIN words ON regexp_replace(url, '(?s)#.*$', '') = node""",
    "op13_leaderboard": """WITH texts AS (SELECT *, coalesce(sale_id::VARCHAR, '') || ',' || coalesce(item_id::VARCHAR, '') || ',' || coalesce(vendor_id::VARCHAR, '') || ',' || coalesce(line_no::VARCHAR, '') AS x FROM sale_lines),
 hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(x) + 1), lambda j: ascii(x[j])::UBIGINT)), lambda c, v: list_reduce([xor(c, v), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END)), 4294967295::UBIGINT)::BIGINT AS h FROM texts),
 dated AS (SELECT *, coalesce(date_diff('day', DATE '1970-01-01', shipped_at::DATE), 19723 + h % 150) AS s FROM hashed),
 arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM dated),
 cut AS (SELECT *, least(8, 1 + floor((a - 19723) * 8 / 180)) AS b FROM arrived),
 latest AS (SELECT b, max(max(s)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cut GROUP BY b),
 deltas AS (SELECT nation_id, cut.item_id, a, sum((CASE WHEN flag = 'swapped' THEN -1 ELSE 1 END) * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0)) AS delta
  FROM cut JOIN latest USING (b) JOIN vendors USING (vendor_id) JOIN items ON cut.item_id = items.item_id WHERE nation_id IS NOT NULL AND (m IS NULL OR s + 15 >= m) GROUP BY ALL),
 running AS (SELECT nation_id, item_id, a, sum(delta) OVER w AS revenue, lead(a) OVER w AS until FROM deltas WINDOW w AS (PARTITION BY nation_id, item_id ORDER BY a)),
 days AS (SELECT nation_id, a, row_number() OVER (PARTITION BY nation_id ORDER BY a) AS nth FROM (SELECT DISTINCT nation_id, a FROM deltas)),
 states AS (SELECT days.nation_id, days.a, nth, item_id, revenue FROM days JOIN running ON days.nation_id = running.nation_id AND days.a >= running.a AND (until IS NULL OR days.a < until)),
 ranked AS (SELECT *, CASE WHEN revenue > 0 AND row_number() OVER (PARTITION BY nation_id, a ORDER BY revenue DESC, item_id) <= 10 THEN row_number() OVER (PARTITION BY nation_id, a ORDER BY revenue DESC, item_id) END AS new_rank FROM states),
 compared AS (SELECT *, lag(new_rank) OVER (PARTITION BY nation_id, item_id ORDER BY nth) AS old_rank FROM ranked)
 SELECT nation_id::INTEGER AS nation_id, a::BIGINT AS arrival_day, item_id, least(8, 1 + floor((a - 19723) * 8 / 180))::INTEGER AS batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, old_rank::INTEGER AS old_rank, new_rank::INTEGER AS new_rank, revenue::BIGINT AS revenue
 FROM compared WHERE old_rank IS DISTINCT FROM new_rank""",
}
