"""The subpackage's queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import capjoin, decontam, jaccard, mixing, pii, secrets, sharding, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(_table(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(_table(spark, sf_dir, "pages"))


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capjoin.linked(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_pii, op3_sharding, op4_secrets, op5_decontamination, op6_url_filter, op7_cap_filters, op8_toxicity, op9_mixing, op10_jaccard)
}
# ---- SQL

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BITS = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(sha1(coalesce(html, '')), '0', 'wwww'), '1', 'wwwv'), '2', 'wwvw'), '3', 'wwvv'), '4', 'wvww'), '5', 'wvwv'), '6', 'wvvw'), '7', 'wvvv'), '8', 'vwww'), '9', 'vwwv'), 'a', 'vwvw'), 'b', 'vwvv'), 'c', 'vvww'), 'd', 'vvwv'), 'e', 'vvvw'), 'f', 'vvvv')"
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, CAST(5 * i + j + 1 AS INTEGER), 1) = 'v' THEN 1 << (4 - j) ELSE 0 END)) AS INTEGER), 1)), '')"
_COMPONENT = """reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)"""

def _url_sql() -> str:
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule, action = ("CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p if i == 0 else a}'" for a, h, p in rules) + " END" for i in (0, 1))
    order, levels, kinds = urlfilter.ORDER, [], ("good", "bad")
    for k in range(1, order + 1):
        p = ", ".join(f"CASE WHEN n_{c} = 0 THEN p.{c} ELSE (l.{c} + t_{c} * p.{c}) / (n_{c} + t_{c}) END AS {c}" for c in kinds)
        sums = ", ".join(f"sum({c}) AS n_{c}, count(*) FILTER (WHERE {c} > 0) AS t_{c}" for c in kinds)
        levels.append(f"l{k} AS (SELECT substr(gram, {order + 1 - k}, {k + 1}) AS g, sum(good) AS good, sum(bad) AS bad FROM c GROUP BY ALL), s{k} AS (SELECT substr(g, 1, {k}) AS h, {sums} FROM l{k} GROUP BY ALL), "
                      f"p{k} AS (SELECT l.g, {p} FROM l{k} l JOIN s{k} ON h = substr(l.g, 1, {k}) JOIN p{k - 1} p ON p.g = substr(l.g, 2))")  # fmt: skip
    pad = " || ".join(["chr(2)"] * order)
    first = ", ".join(f"(sum({c}) + 1) / ((SELECT sum({c}) FROM c) + (SELECT count(DISTINCT substr(gram, {order + 1}, 1)) FROM c)) AS {c}" for c in kinds)
    return f"""WITH r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM r),
a AS (SELECT *, {rule} AS rule, {action} AS action FROM h), u AS (SELECT url, action, coalesce(substr(md5(url), 1, 1) < '{urlfilter.HELD}', FALSE) AS held, count(*) AS n, {pad} || regexp_replace(url, '^[^:/?#]*://', '') || chr(3) AS z FROM a GROUP BY url, action),
w AS (SELECT url, action, held, n, substr(z, CAST(i AS INTEGER), {order + 1}) AS gram FROM (SELECT *, unnest(range(1, length(z) - {order} + 1)) AS i FROM u)),
c AS (SELECT gram, coalesce(sum(n) FILTER (WHERE action = 'allow' AND NOT held), 0) AS good, coalesce(sum(n) FILTER (WHERE action = 'block' AND NOT held), 0) AS bad FROM w GROUP BY gram),
p0 AS (SELECT substr(gram, {order + 1}, 1) AS g, {first} FROM c GROUP BY ALL), {', '.join(levels)},
sc AS (SELECT url, action, held, n, round(avg(ln(good) - ln(bad)), 9) AS score FROM w JOIN p{order} ON g = gram GROUP BY url, action, held, n),
kn AS (SELECT * FROM sc WHERE action IS NOT NULL AND (held OR (SELECT count(DISTINCT action) FROM sc WHERE held) < 2)),
m AS (SELECT min(score) AS low, max(score) AS high FROM kn),
b AS (SELECT least(floor((score - low) / ((high - low) / {urlfilter.BINS})), {urlfilter.BINS - 1}) AS bin, sum(CASE WHEN action = 'allow' THEN n ELSE 0 END) AS good, sum(CASE WHEN action = 'block' THEN n ELSE 0 END) AS bad FROM kn, m GROUP BY ALL),
v AS (SELECT bin, coalesce(lag(bin) OVER o2, -1) AS last, 1 - coalesce(sum(good) OVER o, 0) / (SELECT sum(good) FROM b) + coalesce(sum(bad) OVER o, 0) / (SELECT sum(bad) FROM b) AS value FROM b WINDOW o AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o2 AS (ORDER BY bin)),
t AS (SELECT low + (last + 1 + bin) / 2 * ((high - low) / {urlfilter.BINS}) AS cut FROM v, m ORDER BY round(value, 12) DESC, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(a.action, CASE WHEN score < cut THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN a.action IS NULL THEN score END AS score
FROM a LEFT JOIN sc ON a.url = sc.url AND sc.action IS NOT DISTINCT FROM a.action, t"""


ORACLES: dict[str, str] = {
    "op6_url_filter": _url_sql(),
    "op1_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS body, {_BITS} AS bits FROM pages), g AS (SELECT body, max(page_id) AS last, count(*) AS n FROM p GROUP BY body)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN n > 1 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n > 1 AND page_id <> last THEN last END AS refers_to FROM p JOIN g USING (body)""",
    "op5_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bi AS (SELECT item_id, k, w, unnest(range(len(w) - k + 1)) AS i FROM b), bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1:i + k], ' ') AS s FROM bi), ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, k, w, unnest(range(len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k), dw AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS s FROM di), m AS (SELECT doc_id, item_id, k, i FROM dw JOIN bw USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(k)) AS p FROM m) GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op7_cap_filters": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9), {_COMPONENT}
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(y) FROM reach WHERE x = vec_id), vec_id)) AS component_id,
vec_id = least(vec_id, coalesce((SELECT min(y) FROM reach WHERE x = vec_id), vec_id)) AS kept FROM v""",
    "op9_mixing": """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM s) * (SELECT sum(n) FROM s) / n AS mean FROM s),
k AS (SELECT source, mean, unnest(range(0, CAST(ceil(mean + 12 * sqrt(mean) + 30) AS BIGINT) + 1)) AS k FROM r), c AS (SELECT source, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT *, ('0x' || substr(md5(concat('mix-1|', doc_id, '|', source)), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
n AS (SELECT doc_id, count(*) FILTER (WHERE cdf <= u) AS copies FROM u JOIN c USING (source) GROUP BY doc_id), e AS (SELECT doc_id, unnest(range(1, copies + 1)) AS mix_copy FROM n)
SELECT d.*, CAST(mix_copy AS INTEGER) AS mix_copy, ('0x' || substr(md5(concat('mix-1|', d.doc_id, '|', source, '|', mix_copy)), 1, 15))::BIGINT AS mix_key FROM documents d JOIN e USING (doc_id)""",
    "op10_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0), sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9), {_COMPONENT}, f AS (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x), l AS (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept FROM d LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id)""",
}
