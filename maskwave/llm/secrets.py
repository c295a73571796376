"""Operator 1: secret scans by one deterministic automaton for all rules."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Searcher, compile_rules
from .common import table

# Kind, pattern (all but the first three are the method's own additions).
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]{6,}"),
    ("github", r"gh[pousr]_[A-Za-z0-9]+"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+"),
    ("google", r"AIza[A-Za-z0-9_-]+"),
    ("jwt", r"eyJ[A-Za-z0-9_.-]+"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
# The fewest characters of a whole match, where the pattern doesn't say so.
LEAST = {"access": 20, "hex": 24, "github": 40, "slack": 15, "google": 39}
SPANS = "array<struct<kind:string,start:long,end:long>>"


@lru_cache(maxsize=4)
def searcher(rules: tuple = RULES) -> Searcher:
    return compile_rules([pattern for _, pattern in rules])


def _holds(kind: str, match: str) -> bool:
    if kind == "assign":
        value = match[min(k for k in (match.find(":"), match.find("=")) if k >= 0) + 1 :].lstrip(" ")
        return len(value[1:] if value[:1] in ('"', "'") else value) >= 6
    if kind == "jwt":
        parts = match.rstrip(".").split(".")
        return len(parts) == 3 and min(map(len, parts)) >= 8
    return len(match) >= LEAST.get(kind, 0)


def spans_of(text: str | None, rules: tuple = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by the order of the rules."""
    if not text:
        return []
    data = text.encode("utf-8", "replace")
    plain, found = len(data) == len(text), []
    for rule, start, end in searcher(rules).spans(data):
        kind, match = rules[rule][0], data[start:end].decode()
        if _holds(kind, match):
            begin = start if plain else len(data[:start].decode("utf-8"))
            found.append((begin, rule, begin + len(match)))
    return [(rules[r][0], s, e) for s, r, e in sorted(found)]


def scan(df: DataFrame, text: str = "text", out: str = "secret_spans", rules: tuple = RULES) -> DataFrame:
    """Adds ``out``, an array of (kind, start, end): every secret of each whole text, in code points, end exclusive.

    Null and empty texts have none; repeated rows each get their own. A column already named ``out`` is replaced. Each text is
    read once, byte by byte; a task holds one Arrow batch of texts and a table whose size depends on the rules alone.
    """

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, rules)] for t in texts])

    return df.withColumn(out, find(F.col(text).cast("string")))


def redact(df: DataFrame, text: str = "text", rules: tuple = RULES) -> DataFrame:
    """Replaces every secret in ``text`` by ``[kind]``; spans that overlap become one, named after the first. Null stays null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            parts, at = [], 0
            for kind, s, e in spans_of(t, rules):
                if s >= at:
                    parts += [t[at:s], f"[{kind}]"]
                at = max(at, e)
            return "".join([*parts, t[at:]])

        return pd.Series([one(t) for t in texts], dtype=object)

    return df.withColumn(text, cut(F.col(text).cast("string")))


BASE = ("assign", "access", "hex")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan`` of all documents, spans joined as the contract says."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), out="s").select("doc_id", "s")
    base = F.filter("s", lambda x: x["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def op1_sql() -> str:
    """Positions from the pieces between matches: a match starts after all pieces and matches before it."""

    def one(order: int, kind: str, pattern: str) -> str:
        quoted = pattern.replace("'", "''")
        if kind == "assign":
            quoted = quoted.replace('[A-Za-z0-9+/_.=-]+', '([A-Za-z0-9+/_.=-]+)')
        held = {"assign": "len(g) >= 6", "jwt": "len(string_split(rtrim(m, '.'), '.')) = 3 AND list_min(list_transform(string_split(rtrim(m, '.'), '.'), lambda x: len(x))) >= 8"}.get(kind, f"len(m) >= {LEAST.get(kind, 0)}")
        return f"""(SELECT doc_id, '{kind}' AS kind, {order} AS o, s, s + len(m) AS e FROM (
  SELECT *, CAST(sum(len(pre)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(len(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g, unnest(list_slice(ps, 1, len(ms))) AS pre, unnest(range(len(ms))) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{quoted}', 0) AS ms, regexp_extract_all(t, '{quoted}', {int(kind == "assign")}) AS gs, string_split_regex(t, '{quoted}') AS ps FROM d))) WHERE {held})"""

    spans = " UNION ALL ".join(one(k, kind, pattern) for k, (kind, pattern) in enumerate(RULES))
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({spans})
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, sha256(coalesce({joined} FILTER (o < 3), '')) AS base_sha256, coalesce({joined}, '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id"""
