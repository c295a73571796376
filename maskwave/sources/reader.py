"""Text exports of one segment a file, read as whole files and parsed by expressions.

A file name holds subject, visit and label; files whose names don't are skipped. Lines are cut into numbers tolerantly: at tabs, else
at white space, else into every number that stands in them; decimal commas, junk is missing. The width of a file is the most frequent one
of its rows, the smallest of equals; shorter rows are padded, wider ones lose cells that are missing and are dropped (and counted) if they
have others, a leading time column is found by its steps and removed. ``exports`` is the same as a data source of Spark's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.protocol import Protocol
from .cells import KEY, vessel_type
from .shared import written

# The pattern of names, the extensions, what header lines hold.
NAME = r"([^_/]+)_([^_/]+)_([A-Za-z]\d+)"
EXTENSIONS = r"(?i)\.(rtf|txt|csv)$"
HEADER = r"(?i)^[{\\]|diameters complete|-> position|time"
NUMBERS = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
#: Lines of a part of a file that is given whole, and the first width that is too large to be told from a count.
PART = 4096
#: Numbers of a part of a file that is built, and rows of a task that builds parts.
SPAN = 1 << 18
DEALT = 1 << 18
_WIDEST = 1 << 23


@dataclass(frozen=True)
class Settings:
    """Lines to skip at the head of each file, the number of samples that files should have, and whether another number, a row that is too
    wide, or fewer than two samples, is an error; else such files stay (or, with fewer than two samples, go)."""

    skip_lines: int = 0
    expected_samples: int | None = None
    strict: bool = False


def normalise(text: Column) -> Column:
    """Rich-text tokens as tabs and line ends; blank lines close up, so a blank row vanishes and later samples move ahead."""
    out = F.regexp_replace(text, r"\\(tab|cell)(?![a-zA-Z]) ?", "\t")
    out = F.regexp_replace(out, r"\\(par|line)(?![a-zA-Z]) ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\r\n?", "\n"), "\n{2,}", "\n")


def named(files: DataFrame, pattern: str = NAME) -> DataFrame:
    """The files whose path has a name that holds subject, visit and label; these and the path of each, of equal ones the last."""
    name = F.element_at(F.split("path", "/"), -1)
    out = files.where(F.col("path").rlike(EXTENSIONS) & name.rlike(pattern))
    keys = out.select("path", *[F.regexp_extract(name, pattern, i + 1).alias(k) for i, k in enumerate(KEY)])
    return keys.groupBy(*KEY).agg(F.max("path").alias("path"))  # names alone are ranked, not what files hold


def in_parts(files: DataFrame) -> DataFrame:
    """path, part, content (normalised), lead (whether an empty first line counts): files that come whole are cut into parts of ``PART`` lines,
    files that come in parts keep them."""
    if "part" in files.columns:
        return files.select("path", F.col("part").cast("long").alias("part"), normalise(F.col("content")).alias("content"), F.lit(False).alias("lead"))
    lines = files.select("path", F.split(normalise(F.col("content")), "\n").alias("lines"))
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / PART).cast("int"))
    parts = F.transform(starts, lambda k: F.array_join(F.slice("lines", k * PART + 1, PART), "\n"))
    return lines.select("path", F.posexplode(parts).alias("part", "content")).withColumns({"part": F.col("part").cast("long"), "lead": F.col("part") == 0})


def built(rows: DataFrame, path: Column, order: str, line: Column, header: str) -> DataFrame:
    """Files in parts from a table of lines: path, part, content. A part has a file's lines of ``SPAN`` numbers of ``order``, the first one its header.

    Rows are dealt into more parts the more there are, so that no task has much over ``DEALT`` of them."""
    lines = rows.select(path.alias("path"), F.coalesce(F.floor(F.col(order) / SPAN).cast("long"), F.lit(1 - (1 << 31))).alias("part"), F.col(order).alias("at"), line.alias("line"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // DEALT + 1)
    dealt = lines.repartition(tasks, "path", "part").groupBy("path", "part").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    bodies = dealt.select("path", "part", F.array_join(F.transform("lines", lambda r: r["line"]), "\n").alias("content"))
    heads = lines.select("path").distinct().select("path", F.lit(-(1 << 31)).cast("long").alias("part"), F.lit(header).alias("content"))
    return heads.unionByName(bodies)


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _clean(token: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(token), F.lit(","), F.lit(".")), r"[^0-9.+\-eE]", "")


def number(token: Column) -> Column:
    """A tolerant number: decimal comma, other characters dropped, NULL if none is left."""
    return _finite(_clean(token).try_cast("double"))


def _cut(raw: Column) -> Column:
    words = F.split(F.trim(raw), r"\s+")
    found = F.regexp_extract_all(F.replace(raw, F.lit(","), F.lit(".")), F.lit(NUMBERS), F.lit(0))
    return F.when(raw.contains("\t"), F.split(F.regexp_replace(raw, "\t+$", ""), "\t")).when(F.size(words) > 1, words).otherwise(F.when(F.size(found) > 0, found).otherwise(words))


def _parsed(parts: DataFrame) -> DataFrame:
    """Instead of content, lines: for each line of a part at (its place in the file), v (its numbers) and data (whether it begins with one). Lines
    that hold nothing vanish; the first ``skip`` lines are never data."""
    lines = F.filter(F.split("content", "\n"), lambda r, i: (r != "") | ((i == 0) & F.col("lead")))
    out = parts.withColumn("lines", lines).drop("content", "lead")
    # One step a column of the struct: what a step names is computed once.
    out = out.withColumn("lines", F.transform("lines", lambda r: F.struct(r.alias("r"), F.regexp_replace(r, r"[{}]", "").alias("raw"))))
    out = out.withColumn("lines", F.transform("lines", lambda s: F.struct(s["r"].alias("r"), s["raw"].alias("raw"), _cut(s["raw"]).alias("cut"))))
    values = lambda s: F.transform(F.transform(s["cut"], lambda c: _clean(c).try_cast("double")), _finite)
    out = out.withColumn("lines", F.transform("lines", lambda s: F.struct(s["r"].alias("r"), s["raw"].alias("raw"), s["cut"][0].alias("one"), values(s).alias("v"))))

    def line(s, i):
        empty = F.trim(F.replace(s["raw"], F.lit("\t"), F.lit(""))) == ""
        data = s["v"][0].isNotNull() & s["one"].rlike(r"^\s*[-+0-9.,]") & ~s["r"].rlike(HEADER) & ~empty & (i >= F.col("skip"))
        return F.struct((F.shiftleft("part", 32) + i).alias("at"), s["v"].alias("v"), data.alias("data"))

    return out.withColumn("lines", F.transform("lines", line))


def _rows(parsed: DataFrame) -> DataFrame:
    """Instead of lines, rows: the numbers of each row that is not too wide; n_all counts the others too. Wider rows whose further cells are all
    missing are not too wide."""
    there = parsed.withColumn("rows", F.filter("lines", lambda s: s["at"].between(F.col("lo"), F.col("hi")))).drop("lines")
    spare = lambda v: F.forall(F.slice(v, F.col("p") + 1, F.greatest(F.size(v) - F.col("p"), F.lit(0))), lambda x: x.isNull())
    there = there.withColumn("n_all", F.size("rows").cast("long"))
    return there.withColumn("rows", F.transform(F.filter("rows", lambda s: spare(s["v"])), lambda s: s["v"]))


def _steps(xs: str) -> Column:
    """Differences of neighbours; the last is NULL."""
    return F.zip_with(F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1))), F.col(xs), lambda b, a: b - a)


def parse(files: DataFrame, protocol: Protocol, pattern: str = NAME, settings: Settings = Settings()) -> DataFrame:
    """Cells of text exports (columns path and content), with dropped, the number of rows that were too wide, on every cell.

    With a column part, files come in parts that end where a line does, in the order of that number (of 32 bits); their empty lines don't count as
    skipped ones. No step holds a file: what is shuffled is parts of texts and a few numbers for each, which are written to the shared folder; a
    file's bounds, width and time column come from those, and rows and cells are made last, part by part, and not shuffled.
    """
    parts = in_parts(files.where(F.col("path").isNotNull()))
    before = W.partitionBy("path").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    skip = F.lit(settings.skip_lines)
    if not settings.skip_lines:
        parts = parts.withColumn("skip", skip)
    elif "part" not in files.columns:
        parts = parts.withColumn("skip", skip - F.col("part") * PART)
    else:
        sizes = parts.select("path", "part", F.size(F.filter(F.split("content", "\n"), lambda r: r != "")).alias("n"))
        past = F.coalesce(F.sum("n").over(before), F.lit(0))
        parts = parts.join(sizes.select("path", "part", (skip - past).alias("skip")), ["path", "part"])
    # The most frequent width of each file, the smallest of equals, and its first and last row of numbers.
    data = _parsed(parts).select("path", F.filter("lines", lambda s: s["data"]).alias("data"))
    widths = data.withColumn("w", F.transform("data", lambda s: F.size(s["v"])))
    counted = F.explode(F.transform(F.array_distinct("w"), lambda k: F.struct(k.alias("width"), F.size(F.filter("w", lambda x: x == k)).alias("n"))))
    ends = widths.select("path", F.try_element_at("data", F.lit(1))["at"].alias("lo"), F.try_element_at("data", F.lit(-1))["at"].alias("hi"), counted.alias("c"))
    by_width = ends.groupBy("path", F.col("c.width").alias("width")).agg(F.sum("c.n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    most = (_WIDEST - 1 - F.max(F.col("n") * _WIDEST + (_WIDEST - 1 - F.col("width"))) % _WIDEST).cast("int")
    bounds = by_width.groupBy("path").agg(most.alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(named(files, pattern), "path")
    # What each part has of rows and of steps in its first column.
    first_column = lambda of: _rows(_parsed(parts.join(of, "path"))).withColumn("xs", F.transform("rows", lambda v: v[0])).drop("rows")
    steps = first_column(bounds).withColumn("d", _steps("xs"))
    counts = {"n": F.size("xs"), "gone": F.size(F.filter("xs", lambda x: x.isNull())), "n_d": F.size(F.filter("d", lambda x: x.isNotNull())), "up": F.size(F.filter("d", lambda x: x > 0))}
    held = steps.select("path", "part", "skip", *KEY, "p", "lo", "hi", "n_all", *[c.cast("long").alias(k) for k, c in counts.items()], F.try_element_at("xs", F.lit(1)).alias("x_first"), F.try_element_at("xs", F.lit(-1)).alias("x_last")).where("n_all > 0")
    held = held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # Parts of wide rows alone have no first or last row.
    last_row = F.last(F.when(F.col("n") > 0, F.struct("x_last")), ignorenulls=True).over(before)["x_last"]
    held = held.withColumn("d", F.when(F.col("n") > 0, F.col("x_first") - last_row))
    whole = W.partitionBy("path")
    total = {"rows": F.sum("n"), "dropped": F.sum(F.col("n_all") - F.col("n")), "gone": F.sum("gone"), "n_d": F.sum(F.col("n_d") + F.col("d").isNotNull().cast("int")), "up": F.sum(F.col("up") + F.coalesce((F.col("d") > 0).cast("int"), F.lit(0)))}
    held = held.withColumns({k: c.over(whole) for k, c in total.items()})
    held = written(held.select("path", "part", "skip", *KEY, "p", "lo", "hi", "before", "rows", "dropped", "gone", "n_d", "up", "d"), "parts")
    maybe = (F.col("p") >= 2) & (F.col("gone") / F.col("rows") <= 0.2) & (F.col("n_d") >= 10) & (F.col("up") / F.col("n_d") >= 0.95)
    rising = held.where(maybe)
    held = held.withColumn("last", F.col("rows") - 1)
    if settings.strict:
        wanted = F.lit(settings.expected_samples) if settings.expected_samples else F.col("last") + 1
        fault = F.when(F.col("last") < 1, "fewer than two samples").when(F.col("last") + 1 != wanted, "not as many samples as expected").when(F.col("dropped") > 0, "rows that are too wide")
        failed = F.raise_error(F.concat_ws(": ", "path", fault)).cast("long")
        held = held.withColumn("last", F.when(fault.isNotNull(), failed).otherwise(F.col("last")))
    held = held.where("last >= 1").drop("last")
    if rising.isEmpty():
        held = held.withColumn("timed", F.lit(0))
    else:
        inner = first_column(rising.select("path", "p", "lo", "hi").distinct()).select("path", F.explode(_steps("xs")).alias("d"))
        times = time_columns(inner.unionByName(rising.select("path", "d")).where(F.col("d").isNotNull()), ["path"])
        held = held.join(times.select("path", F.lit(1).alias("timed")), "path", "left").withColumn("timed", F.coalesce("timed", F.lit(0)))
    rows = _rows(_parsed(parts.drop("skip").join(held, ["path", "part"])))
    rows = rows.select(*KEY, "p", "before", "dropped", "timed", F.posexplode("rows").alias("k", "v")).withColumn("t_idx", (F.col("before") + F.col("k")).cast("int"))
    padded = F.transform(F.sequence(F.col("timed"), F.col("p") - 1), lambda k: F.get("v", k))
    cells = rows.select(*KEY, "dropped", "t_idx", F.posexplode(padded).alias("locus", "x"))
    return cells.select(*KEY, vessel_type(F.col("segment_label")).alias("vessel_type"), "t_idx", (F.col("t_idx") / F.lit(float(protocol.fs))).alias("t"), F.col("locus").cast("int").alias("locus"), "x", F.col("x").isNotNull().alias("m"), "dropped")


def time_columns(steps: DataFrame, by: list[str]) -> DataFrame:
    """Of columns that mostly rise (by, and a row with d for each step), those that count time: by nearly equal steps."""
    mid = steps.groupBy(*by).agg(F.median("d").alias("step"))
    spread = steps.join(mid, by).groupBy(*by).agg(F.first("step").alias("step"), F.median(F.abs(F.col("d") - F.col("step"))).alias("spread"))
    return spread.where((F.col("step") > 0) & (F.col("spread") < 0.05 * F.col("step"))).select(*by)


def read(spark: SparkSession, folder: str, protocol: Protocol, pattern: str = NAME, settings: Settings = Settings()) -> DataFrame:
    """Cells of every export under a folder, by Spark's own reader of whole files."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return parse(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")), protocol, pattern, settings)


def inclusion_list(texts: DataFrame, content: str = "content") -> DataFrame:
    """segment_label and subject_id of lists ``{label: [ids]}``; keys that begin with _ are notes."""
    lists = texts.select(F.explode(F.from_json(content, "map<string,array<string>>")).alias("segment_label", "ids"))
    return lists.where(~F.col("segment_label").startswith("_")).select("segment_label", F.explode("ids").alias("subject_id")).distinct()


def keep_included(df: DataFrame, included: DataFrame | None) -> DataFrame:
    """Rows of listed subjects; all rows without a list."""
    return df if included is None else df.join(included, ["segment_label", "subject_id"], "left_semi")
