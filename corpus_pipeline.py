"""A training-data pipeline over documents: five operators in a row, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. The stages work on the columns doc_id, text, lang, source and n_chars; other
columns of docs are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwave.llm import decontaminate, mixing, near_copies, secrets, toxicity
from maskwave.llm.common import doc_key, table, text_batches, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity of 0.5 or more; the lexicon is learned from the labelled rows outside the held-out fold.

    Null and empty texts have no toxic word and stay, as do rows without an id; equal rows are judged alike; an empty table stays empty."""
    text_batches(spark)
    known = toxicity.labelled(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs.select(*COLUMNS), toxicity.learn_lexicon(known))
    return scored.where("toxic_score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near copies: texts that share 80 % of their five-word shingles, compared whole.

    A row goes only for its own text's group; rows without an id come last in it. Null and blank texts count as equal texts, of which the
    smallest id stays. Of rows that are equal in id and text one stays; an empty table stays empty."""
    keyed = docs.select(*COLUMNS).withColumns({"key": doc_key(F.col("doc_id")), "t": near_copies.text_key(F.col("text"))})
    rows = keyed.groupBy("key", "t").agg(F.count("*").alias("n"))
    groups = near_copies.near_copies(docs.select("text"))
    grouped = rows.join(groups, rows["t"] == groups["node"], "left").select("key", "t", "n", F.coalesce("root", "t").alias("root"))
    first = written(grouped.groupBy("root").agg(F.min(F.struct("key", "t", "n")).alias("first")).select("first.*"), "firsts")
    # The ids are the small side, so that no text is sorted; only rows that share an id and a text are put together.
    kept = keyed.join(first.hint("shuffle_hash"), ["key", "t"])
    if first.where("n > 1").isEmpty():
        return kept.select(*COLUMNS)
    return kept.where("n = 1").unionByName(kept.where("n > 1").dropDuplicates(["key", "t"])).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose own text holds a benchmark item, whatever other rows of their id hold.

    Null and empty texts hold none and stay; equal rows go or stay together; without items, or without documents, nothing goes."""
    keyed = docs.select(*COLUMNS).withColumn("key", near_copies.text_key(F.col("text")))
    leaked = decontaminate.held(keyed.select("key", "text"), table(spark, sf_dir, "benchmark")).select("key").distinct()
    return keyed.join(leaked, "key", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind; n_chars follows the new text. Null texts stay null, with null n_chars; no row goes."""
    out = secrets.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that is taken, numbered by copy, with the document's columns and its source's target.

    A document is an id and a text: rows without an id, or of one id, are rounded and joined each by its own text. Null and empty texts have size
    0 and are not taken; a null source is a source; an empty table gives an empty mix."""
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), near_copies.text_key(F.col("text")))
    keyed = docs.select(*COLUMNS).withColumn("key", own)
    units = mixing.mix(keyed.select(F.col("key").alias("doc_id"), "source", "text"))
    taken = units.where("copies > 0").select(F.col("doc_id").alias("key"), F.col("source").alias("from"), "size", "source_size", "target", "copies").distinct()
    joined = keyed.alias("d").join(taken, (F.col("d.key") == taken["key"]) & F.col("d.source").eqNullSafe(F.col("from")))
    out = joined.select(*[f"d.{c}" for c in COLUMNS], "size", "source_size", "target", "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
]

#: SQL can't express the learned lexicon, the fingerprints or the rounding; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
