"""Operator 7: URL filters by host-suffix and path-prefix expressions, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Verdict, host, path of the contract's rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
# Words of hosts that the method itself blocks, where no rule fits; a word is what dots and hyphens leave of a host.
BAD_WORDS = ("ads", "adult", "adserver", "bets", "betting", "casino", "gambling", "malware", "phishing", "pills", "porn", "spam", "track", "tracker", "viagra", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or a url without ``://``."""
    after = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(after, host).otherwise(""), F.when(after, path).otherwise("")


def rules_frame(spark: SparkSession, rules=RULES, bad_words=BAD_WORDS) -> DataFrame:
    """Columns verdict, host, path, own (true for the method's own rules about words of hosts, which every other rule precedes)."""
    rows = [(*r, False) for r in rules] + [("block", w, "", True) for w in bad_words]
    return spark.createDataFrame(rows, "verdict string, host string, path string, own boolean")


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\x00"), path)


def _word(word: Column) -> Column:
    return F.concat(F.lit("\x01"), word)


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", short: int = 8) -> DataFrame:
    """Adds host, path, rule (host and path of the rule that fits, null if none does) and verdict.

    Each distinct (host, path) is expanded into every suffix of the host at a dot, of as many labels as some rule has, times every prefix
    of the path of a length that some rule has; and into its host's words for the rules marked ``own``. The first ``short`` hex digits of
    the expressions' SHA-256 are equi-joined with those of the rules; then the whole digests must agree. The longest host, then the
    longest path wins; of equal rules, allow before block. Rules marked ``own`` come after all others and leave ``rule`` null. Null urls and
    urls without ``://`` have an empty host and path and fit no rule, unless one names an empty host. Repeated rows are judged alike;
    df keeps its other columns, and columns with the added names are replaced. An empty rules table leaves everything to the default,
    an empty df gives an empty result.

    Only one row a distinct address goes through the expansion, so a hot page or host costs no more than another.
    """
    host, path = url_parts(F.col(url))
    rows = df.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    said = F.when(F.col("own"), _word(F.col("host"))).otherwise(_expression(F.col("host"), F.col("path")))
    listed = rules.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path"), "own", F.sha2(said, 256).alias("digest"))
    # Numbers alone come to the driver: how long the rules' paths are, and how many labels their hosts have.
    given = listed.where(~F.col("own"))
    lengths = [r[0] for r in given.select(F.length("r_path")).distinct().collect()]
    labels_of = lambda h: F.split(h, "\\.")
    counts = [r[0] for r in given.select(F.size(labels_of("r_host"))).distinct().collect()]
    labels, nothing = labels_of("host"), F.lit(None).cast("string")
    suffixes = F.filter(F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in counts] or [nothing]), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [nothing]), lambda p: p.isNotNull())
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _expression(h, p))))
    words = F.transform(F.split("host", "[.-]"), _word)
    digests = F.transform(F.array_distinct(F.concat(expressions, words)), lambda e: F.sha2(e, 256))
    wanted = rows.select("host", "path").distinct().select("host", "path", F.explode(digests).alias("want")).withColumn("short", F.substring("want", 1, short))
    near = wanted.join(listed.withColumn("short", F.substring("digest", 1, short)), "short").where(F.col("want") == F.col("digest"))
    rank = F.struct((~F.col("own")).alias("given"), F.length("r_host").alias("h"), F.length("r_path").alias("p"), (F.col("verdict") == "allow").alias("a"))
    best = near.groupBy("host", "path").agg(F.max_by(F.struct("verdict", "own", F.concat("r_host", "r_path").alias("said")), rank).alias("__best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.withColumns({"rule": F.when(~F.col("__best.own"), F.col("__best.said")), "verdict": F.coalesce("__best.verdict", F.lit(default))}).drop("__best")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge`` of all pages by the contract's rules."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def op7_sql() -> str:
    at = "strpos(url, '://')"
    rest = f"substr(url, {at} + 3)"
    fits = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    ordered = sorted(RULES, key=lambda r: (-len(r[1]), -len(r[2])))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    said = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    own = f"len(list_intersect(regexp_split_to_array(host, '[.-]'), [{', '.join(repr(w) for w in BAD_WORDS)}])) > 0"
    return f"""
WITH u AS (
  SELECT page_id,
    CASE WHEN coalesce({at}, 0) > 0 THEN translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
    CASE WHEN coalesce({at}, 0) > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {said} WHEN {own} THEN 'block' ELSE 'allow' END AS verdict FROM u"""
