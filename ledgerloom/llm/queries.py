"""The queries of this subpackage, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, near_dedup, packing, periodic, pii, pitman_yor, quality, sharding, spotsigs, suffix_dedup, toxicity, whitening
from .cluster import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit by windows of 10 words of benchmark items, over all documents; a null or wordless text has none, an empty benchmark hits nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.summary(decontaminate.find(docs, table(spark, sf_dir, "benchmark")))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 equal shards by law `key`; equal (doc_id, text) rows share a shard, null texts have size 16."""
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out; `und` where no letter is."""
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's; a null text is an empty one."""
    return spotsigs.neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the model of the training documents; a null text is an end token alone."""
    return pitman_yor.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; a null text is its end token alone."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component over 4-word shingles at 0.8; documents without words are linked with nothing."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of 400-byte strings that occur again; a null text is an empty one."""
    found = suffix_dedup.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and learned spans of personal data in every document; a null text has none."""
    return pii.summary(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that aren't held out; empty texts score as well."""
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All finite embeddings on the 32 leading axes of their covariance, to unit variance; a row for each vector and component."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels that aren't held out; empty texts score as well."""
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words in every document (some get a repeating tail first), of 24 words and 3 periods or more; a null text has none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find(docs.withColumn("text", periodic.tiled(F.col("doc_id"), F.col("text"))), least=24, exponent=3)
    return found.drop("runs")


def llm_shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each size op2 has sharded."""
    return op2_shard(spark, sf_dir).groupBy("size").agg(F.count("*").alias("n"))


def llm_lm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 counts, and its base score."""
    return op5_pitman_yor(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def llm_pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op9's base spans."""
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_shard": op2_shard,
    "op3_langid": op3_langid,
    "op4_spotsigs": op4_spotsigs,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_pack": op6_pack,
    "op7_near_dedup": op7_near_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_whiten": op11_whiten,
    "op12_quality": op12_quality,
    "op13_periodic_runs": op13_periodic_runs,
    "llm_shard_sizes": llm_shard_sizes,
    "llm_lm_counts": llm_lm_counts,
    "llm_pii_base": llm_pii_base,
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BITS = "[0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]"
#: CRC-32 of a doc_id's text, byte by byte and bit by bit.
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), {_BITS}), lambda b, k: xor(b >> 1, 3988292384::BIGINT * (b & 1)))), 4294967295::BIGINT)"

_DECONTAMINATE = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
    p AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS s FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k) WHERE len(w) > 0),
    x AS (SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS s FROM d, (SELECT DISTINCT m FROM p) l, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS k) WHERE len(w) >= m),
    h AS (SELECT doc_id, k, m, item FROM x JOIN p USING (m, s)),
    n AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS j FROM (SELECT DISTINCT doc_id, k, m FROM h)) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

_NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + least(len(w), 4) - 1], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS k) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
    l AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT doc_id AS node, doc_id AS top FROM documents UNION SELECT l.v, r.top FROM r JOIN l ON l.u = r.node WHERE r.top < l.v)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, t.top AS component_id, t.top = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(top) AS top FROM r GROUP BY 1) t USING (doc_id)"""

_REPEATS = """WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
    w AS (SELECT doc_id, i, md5(array_slice(t, i + 1, i + 400)) AS h FROM (SELECT doc_id, encode(text) AS t FROM documents), LATERAL (SELECT unnest(range(0, octet_length(t) - 399)) AS i) WHERE octet_length(t) >= 400),
    r AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
    g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM r)),
    c AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY 1, 2),
    k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM c),
    t AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS last FROM c GROUP BY doc_id),
    m AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM k JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, strlen(x) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)"""

_COUNTS = f"""WITH d AS (SELECT doc_id, {_CRC} % 5 = 1 AS held_out, list_append(regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+'), chr(10)) AS w FROM documents),
    c AS (SELECT t, count(*) AS c FROM (SELECT unnest(w) AS t FROM d WHERE NOT held_out) GROUP BY t),
    n AS (SELECT CAST(sum(c) AS BIGINT) AS n, sum(c) + 0.5 * (count(*) + 1) AS whole FROM c)
    SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / whole)), 4) AS base_score FROM (SELECT doc_id, held_out, unnest(w) AS t FROM d) LEFT JOIN c USING (t), n GROUP BY doc_id, held_out"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN (length({_DIGITS}) - k) % 2 = 0 THEN CAST(substr({_DIGITS}, k, 1) AS INTEGER) WHEN CAST(substr({_DIGITS}, k, 1) AS INTEGER) > 4 THEN 2 * CAST(substr({_DIGITS}, k, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr({_DIGITS}, k, 1) AS INTEGER) END)) % 10 = 0"
_PERSONAL = rf"""SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
    CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INTEGER) > 255)) = 0)) AS BIGINT) AS n_ip,
    CAST(len(list_filter(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN})) AS BIGINT) AS n_card,
    CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

#: The other queries can't be said in SQL; tests/llm holds them against brute force, round trips or held-out accuracy.
ORACLES: dict[str, str] = {
    "op1_decontaminate": _DECONTAMINATE,
    "op7_near_dedup": _NEAR,
    "op8_suffix_dedup": _REPEATS,
    "llm_shard_sizes": "SELECT coalesce(strlen(text), 0) + 16 AS size, count(*) AS n FROM documents GROUP BY 1",
    "llm_lm_counts": _COUNTS,
    "llm_pii_base": _PERSONAL,
}
