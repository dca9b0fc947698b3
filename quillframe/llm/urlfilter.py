"""URL filter: rules first, then the ratio of two character language models; DataFrame functions only.

A rule (action, host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest
fitting rule decides. URLs that a rule allows or blocks train an accepted and a rejected model over all rows. Both are
variable-order Markov models of up to ORDER characters of context: Witten-Bell interpolation, so that a context that was
never seen passes its weight to the next shorter one. A url's score is the mean over its characters of the difference of
log probabilities, hence normalised by length. URLs whose MD5 begins with a digit below HELD (3 in 16) train no model: the
threshold is the score that best parts the rule-decided ones of them, by balanced accuracy over a histogram of BINS scores (of
all rule-decided URLs, if these aren't of both kinds); a url without a rule is allowed at or above it.

Each position of a padded url has one window of ORDER + 1 characters. Counts of windows are taken once over all rows
(aggregated before the shuffle); shorter contexts are sums of them. Scores of windows are joined back to the positions,
broadcast only where their number is at most BROADCAST_WINDOWS, else by a shuffle over salted windows, as some occur in
every url.

Nulls and edge cases: a null url or one without :// has an empty host and path and no rule; a null or empty url scores
as its end mark alone. Without rule-decided URLs of both kinds the verdict is allow, and so is that of a score equal to the
threshold. Repeated rows are judged each and alike; of an empty table comes an empty table.
Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm._base import written

#: Fixed rules of the production query: action, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 3
BINS = 400
HELD = "3"
BROADCAST_WINDOWS = 200_000
SALTS = 32
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PAD, END = "\x02", "\x03"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), *LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def decided(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, action)."""
    host, path = parts(F.col("url"))
    table = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return table.withColumn("rule", rule).withColumn("action", action)


def held(url: Column) -> Column:
    """URLs that calibrate the threshold and train no model."""
    return F.coalesce(F.md5(url) < HELD, F.lit(False))


def windows(urls: DataFrame) -> DataFrame:
    """A row (url columns, gram) for each character and the end mark of each url, with the ORDER characters before it."""
    padded = F.concat(F.lit(PAD * ORDER), F.coalesce(F.regexp_replace("url", r"^[^:/?#]*://", ""), F.lit("")), F.lit(END))
    n = F.length(padded) - ORDER
    dealt = urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url")
    return dealt.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))))


def model(counts: DataFrame) -> DataFrame:
    """(gram, good, bad counts of windows) to (gram, ratio): the difference of the two models' log probabilities."""
    sums = counts.agg(F.sum("good"), F.sum("bad"), F.countDistinct(F.substring("gram", ORDER + 1, 1))).first()
    totals, letters = {"good": sums[0] or 0, "bad": sums[1] or 0}, sums[2] or 1
    last = counts.groupBy(F.substring("gram", ORDER + 1, 1).alias("g")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    p = last.select("g", *[((F.col(c) + 1) / F.lit(float(totals[c] + letters))).alias(f"p_{c}") for c in totals])
    for k in range(1, ORDER + 1):
        level = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("g")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        level = level.withColumn("context", F.substring("g", 1, k)).withColumn("short", F.expr("substring(g, 2)"))
        seen = level.groupBy(F.col("context").alias("of")).agg(*[f(c).alias(f"{n}_{c}") for c in totals for n, f in (("n", F.sum), ("t", lambda x: F.sum((F.col(x) > 0).cast("long"))))])
        joined = level.join(seen, F.col("context") == F.col("of")).join(p.withColumnRenamed("g", "shorter"), F.col("short") == F.col("shorter"))
        p = joined.select("g", *[F.when(F.col(f"n_{c}") == 0, F.col(f"p_{c}")).otherwise((F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).alias(f"p_{c}") for c in totals])
    return p.select(F.col("g").alias("gram"), (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def scored(urls: DataFrame) -> DataFrame:
    """(url, n, action), one row per url, to (url, action, n, score)."""
    good, bad = [F.sum(F.when((F.col("action") == a) & ~held(F.col("url")), F.col("n")).otherwise(0)).alias(c) for a, c in (("allow", "good"), ("block", "bad"))]
    counts = written(windows(urls).groupBy("gram").agg(good, bad), "url-windows")
    ratios = written(model(counts), "url-ratios")
    rows = windows(urls)
    if ratios.count() <= BROADCAST_WINDOWS:
        joined = rows.join(F.broadcast(ratios), "gram")
    else:
        salted = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    return joined.groupBy("url", "action", "n").agg(F.round(F.avg("ratio"), 9).alias("score"))


def threshold(scores: DataFrame) -> float:
    """The score of best balanced accuracy on decided URLs, amid the empty bins there; BINS rows at most come to the driver."""
    known = scores.filter("action is not null")
    kept = known.filter(held(F.col("url")))
    if kept.agg(F.countDistinct("action")).first()[0] == 2:
        known = kept
    low, high, kinds = known.agg(F.min("score"), F.max("score"), F.countDistinct("action")).first()
    if kinds is None or kinds < 2 or not high > low:
        return float("-inf")
    width = (high - low) / BINS
    bins = known.groupBy(F.least(F.floor((F.col("score") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)).alias("bin"))
    rows = sorted(bins.agg(*[F.sum(F.when(F.col("action") == a, F.col("n")).otherwise(0)).alias(a) for a in ("allow", "block")]).collect())
    all_good, all_bad = sum(r["allow"] for r in rows), sum(r["block"] for r in rows)
    best, cut, good_below, bad_below, last = -1.0, low, 0, 0, -1
    for r in rows:
        if (value := (1 - good_below / all_good) + bad_below / all_bad) > best + 1e-12:
            best, cut = value, low + (last + 1 + r["bin"]) / 2 * width
        last = r["bin"]
        good_below, bad_below = good_below + r["allow"], bad_below + r["block"]
    return cut


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row; score is null where a rule decides."""
    table = decided(pages, rules)
    urls = written(table.groupBy("url", "action").agg(F.count(F.lit(1)).alias("n")), "urls")
    scores = written(scored(urls), "url-scores")
    cut = threshold(scores)
    open_ = scores.filter("action is null").select(F.col("url").alias("of"), "score")
    joined = table.join(open_, F.col("action").isNull() & F.col("url").eqNullSafe(F.col("of")), "left")
    verdict = F.coalesce("action", F.when(F.col("score") < F.lit(cut), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
