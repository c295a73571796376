"""Operator 11: repair of conversations' structure by signatures that are solved once each."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import hot_keys, spread_join, table, text_batches, written

# Fixed values of the contract: costs of edits and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a segment at most: the longest signature that is solved as one, and the depth of the recursion.
SEGMENT = 96
BLANKS = " \t\n\x0b\f\r"
FAR = 1 << 60

# States of the grammar (s?(ua)+)?: nothing yet, a system row, a user's row, an assistant's row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
ENDS = (START, ASSISTANT)
#: What a row's role leads to: state -> state.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The one role that may be put in at a state, as a letter.
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: Signatures: s, u, a and o (another role) for rows without a fault, capitals for truncated ones, d for blank rows and duplicates.
#: Scripts: for each row the letters of what is put in before it (u, a) and one of D, K, U, A (delete, keep, change the role).


def _moves(symbol: str, state: int):
    """(audit letter, script letter, cost, next state) of a row, in the order of the audit's letters."""
    yield "D", "D", DELETE, state
    if symbol == "d":
        return
    role, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    if state in STEPS.get(role, {}):
        yield "K", "K", KEEP + more, STEPS[role][state]
    yield "R", NEXT[state].upper(), REROLE + more, STEPS[NEXT[state]][state]


def solve(signature: str) -> list[list[tuple[int, str, str] | None]]:
    """For each state before and after: (cost, audit, script) of the cheapest edits, the ASCII-least audit of equals; None if there are none.

    Two audits of the same rows from the same state never begin one another, for each ends with its last row's letter; so the least of a
    whole conversation is put together from the least of its segments."""

    @lru_cache(maxsize=None)
    def best(at: int, state: int, inserted: int) -> tuple:
        """Per state at the end, the best of the rows from ``at`` on."""
        if at == len(signature):
            return tuple((0, "", "") if s == state and not inserted else None for s in range(STATES))
        ways = [(letter, script, cost, best(at + 1, to, 0)) for letter, script, cost, to in _moves(signature[at], state)]
        if inserted < 2:  # a third one comes back to where one alone leads
            role = NEXT[state]
            ways.append(("I", role, INSERT, best(at, STEPS[role][state], inserted + 1)))
        out = []
        for s in range(STATES):
            found = [(cost + rest[s][0], letter + rest[s][1], script + rest[s][2]) for letter, script, cost, rest in ways if rest[s] is not None]
            out.append(min(found, default=None))
        return tuple(out)

    return [list(best(0, state, 0)) for state in range(STATES)]


#: After the last row: (cost, audit, script) from each state to an end.
CLOSING = {START: (0, "", ""), SYSTEM: (2 * INSERT, "II", "ua"), USER: (INSERT, "I", "a"), ASSISTANT: (0, "", "")}


def prepared(df: DataFrame) -> DataFrame:
    """conv, turn, role, text, id of conversations (conv_id, turn, role, text): null roles and texts become one space, rows get a number."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return df.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), *filled).withColumn("id", F.monotonically_increasing_id())


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, tie, id, initial, fault (blank, duplicate, truncated or null: the first that holds) and sign, the letter of the signature,
    of ``prepared`` rows from a written table. A row is a duplicate if one before it in its conversation has its role and text; the first
    place of each is an aggregate, so a text repeated without end is no task's burden.

    Texts stay where they are: a digest stands for them. Only where rows of one turn and role have different texts, ``tie`` holds the text,
    which then orders them; elsewhere it is empty."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank, open_ = bare == "", ~F.substring(bare, -1, 1).isin(".", "!", "?")
    said = F.md5(F.concat_ws("\x00", "role", "text").cast("binary"))
    marked = written(rows.select("conv", "turn", "role", "id", blank.alias("blank"), open_.alias("open"), said.alias("said")), "marked")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), F.col("id").alias("id"))
    first = marked.where(~F.col("blank")).groupBy("conv", "said").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv").alias("f_conv"), F.col("said").alias("f_said"), F.col("first.id").alias("f_id"))
    told = marked.join(first, F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("said") == F.col("f_said")), "left")
    ties = marked.groupBy("conv", "turn", "role").agg(F.min("said").alias("a"), F.max("said").alias("b")).where("a <> b")
    ties = ties.select(F.col("conv").alias("t_conv"), F.col("turn").alias("t_turn"), F.col("role").alias("t_role"))
    tied = rows.join(ties, F.col("conv").eqNullSafe(F.col("t_conv")) & F.col("turn").eqNullSafe(F.col("t_turn")) & (F.col("role") == F.col("t_role")))
    told = told.join(tied.select("id", F.col("text").alias("tie")), "id", "left")
    again = ~F.col("blank") & F.col("f_id").isNotNull() & (F.col("f_id") != F.col("id"))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("open"), "truncated")
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    sign = F.when(fault.isin("blank", "duplicate"), "d").when(fault == "truncated", F.upper(role)).otherwise(role)
    return told.select("conv", "turn", "role", F.coalesce("tie", F.lit("")).alias("tie"), "id", initial.alias("initial"), fault.alias("fault"), sign.alias("sign"))


def _segments(kind: pa.DataType):
    def cut(batches):
        """Runs of at most SEGMENT rows of one conversation in order; a conversation may begin and end within any partition."""
        from pyspark import TaskContext

        part, seq, at, ids, signs, initials, place = TaskContext.get().partitionId(), 0, None, [], [], [], None
        names, types = ["conv", "part", "seq", "ids", "signature", "first", "last", "illegal"], [kind, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.string(), pa.int64()]
        out = []

        def close():
            bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            out.append((at, part, seq, list(ids), "".join(signs), initials[0], initials[-1], bad))

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            for conv, i, sign, initial in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if ids and (conv != at or len(ids) == SEGMENT):
                    close()
                    seq += 1
                    ids, signs, initials = [], [], []
                at = conv
                ids.append(i)
                signs.append(sign)
                initials.append(initial)
            if out:
                yield made()
                out.clear()
        if ids:
            close()
            yield made()

    return cut


def segments(marked: DataFrame) -> DataFrame:
    """conv, part, seq, ids, signature, first, last, illegal: the rows of ``faults`` by turn (nulls first), role, text and number, cut where
    a conversation or a range ends.

    Rows are sorted by ranges of all of these, so a conversation of any size is spread over as many tasks as its rows need."""
    kind = to_arrow_type(marked.schema["conv"].dataType)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "tie", "id"]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "id", "sign", "initial")
    conv = dict(marked.dtypes)["conv"]
    return ranged.mapInArrow(_segments(kind), f"conv {conv}, part long, seq long, ids array<long>, signature string, first string, last string, illegal long")


WAY = "struct<before:int,after:int,cost:long,audit:string,script:string>"


def solutions(signatures: DataFrame) -> DataFrame:
    """signature, ways: each distinct signature solved once, from every state to every state that it can lead to."""

    @F.udf(f"array<{WAY}>")
    def ways(signature):
        return [(before, after, *w) for before, row in enumerate(solve(signature)) for after, w in enumerate(row) if w]

    return signatures.select("signature").distinct().withColumn("ways", ways("signature"))


def _streams(columns: list[str], types: list[pa.DataType], begin, step):
    """mapInArrow over sorted rows: ``begin()`` makes the state of a conversation, ``step(state, row)`` gives (state, what is added)."""

    def run(batches):
        at, state, fresh = None, None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if fresh or row["conv"] != at:
                    at, state, fresh = row["conv"], begin(), False
                state, more = step(state, row)
                out.append(more)
            if out:
                added = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *columns])

    return run


def _cheapest(after, row):
    """Backwards: (cost, way) from each state before a segment to the end. Of equal costs the least audit wins; audits of two ways differ."""
    best, taken = [FAR] * STATES, [-1] * STATES
    ranked = {}
    for k, way in enumerate(row["ways"]):
        total = way["cost"] + after[way["after"]]
        s = way["before"]
        if total < FAR and (s not in ranked or (total, way["audit"]) < ranked[s]):
            ranked[s], best[s], taken[s] = (total, way["audit"]), total, k
    return best, (taken,)


def _followed(state, row):
    """Forwards: the way that a segment takes from the state before it, and whether its first row may follow the one before."""
    now, last = state
    way = row["ways"][row["taken"][now]]
    bad = int(last is not None and last + row["first"] not in ("su", "ua", "au"))
    return (way["after"], row["last"]), (way["cost"], way["audit"], way["script"], way["after"], bad)


def chosen(cut: DataFrame) -> DataFrame:
    """conv, part, seq, ids, illegal, cost, audit, script, state (after it) of ``segments`` from a written table; illegal counts the pair
    with the segment before it too.

    A conversation's segments pass one task as a stream, backwards and then forwards: one row for SEGMENT of its rows, of which a task holds
    one Arrow batch and four numbers. A frequent signature's segments are dealt into parts before they meet its solution."""
    found = written(solutions(cut), "solutions")
    hot = hot_keys(cut.groupBy("signature").count(), "signature", "count")
    known = spread_join(cut.select("conv", "part", "seq", "signature", "first", "last"), found, "signature", hot, F.concat_ws(":", "part", "seq"))
    base = f"conv {dict(cut.dtypes)['conv']}, part long, seq long, first string, last string, ways array<{WAY}>"
    backwards = known.select("conv", "part", "seq", "first", "last", "ways").repartition("conv").sortWithinPartitions("conv", F.col("part").desc(), F.col("seq").desc())
    begin = lambda: [CLOSING[s][0] for s in range(STATES)]
    taken = backwards.mapInArrow(_streams(["taken"], [pa.list_(pa.int32())], begin, _cheapest), f"{base}, taken array<int>")
    forwards = taken.repartition("conv").sortWithinPartitions("conv", "part", "seq")
    added = ["cost", "audit", "script", "state", "between"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    out = forwards.mapInArrow(_streams(added, types, lambda: (START, None), _followed), f"{base}, taken array<int>, cost long, audit string, script string, state int, between int")
    out = out.select("part", "seq", "cost", "audit", "script", "state", "between").join(cut.select("conv", "part", "seq", "ids", "illegal"), ["part", "seq"])
    return out.select("conv", "part", "seq", "ids", (F.col("illegal") + F.col("between")).alias("illegal"), "cost", "audit", "script", "state")


def _closing(state: Column, k: int) -> Column:
    return F.element_at(F.array(*[F.lit(CLOSING[s][k]) for s in range(STATES)]), state + 1)


def audits(chosen_: DataFrame) -> DataFrame:
    """conv, illegal, cost, audit, one row a conversation that has rows."""
    piece = F.struct("part", "seq", "audit", "state")
    one = chosen_.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    end = F.element_at("pieces", -1)["state"]
    return one.select("conv", "illegal", (F.col("cost") + _closing(end, 0)).cast("long").alias("cost"), F.concat(F.array_join(F.transform("pieces", lambda p: p["audit"]), ""), _closing(end, 1)).alias("audit"))


def repaired(chosen_: DataFrame, rows: DataFrame) -> DataFrame:
    """conv, part, seq, nth, within (the order), edit (keep, rerole, insert), id (null for what was put in), role, text: the repaired
    conversations, row by row. Scripts are cut into rows by expressions; only rows that stay are joined with their texts, by number."""
    pieces = chosen_.select("conv", "part", "seq", F.posexplode(F.arrays_zip("ids", F.expr("regexp_extract_all(script, '[ua]*[DKUA]', 0)").alias("piece"))).alias("nth", "x"))
    pieces = pieces.select("conv", "part", "seq", "nth", F.col("x.ids").alias("id"), F.col("x.piece").alias("piece"))
    within, edit, name = F.length("piece") - 1, F.substring("piece", -1, 1), lambda c: F.when(F.lower(c) == "u", "user").otherwise("assistant")
    stays = pieces.where(edit != "D").select("conv", "part", "seq", "nth", within.alias("within"), edit.alias("letter"), "id").join(rows.select("id", "role", "text"), "id")
    said = F.when(F.col("letter") == "K", "keep").otherwise("rerole")
    stays = stays.select("conv", "part", "seq", "nth", "within", said.alias("edit"), "id", F.when(F.col("letter") == "K", F.col("role")).otherwise(name(F.col("letter"))).alias("role"), "text")
    ends = chosen_.groupBy("conv").agg(F.max(F.struct("part", "seq", "state")).alias("e")).select("conv", "e.part", "e.seq", F.lit(SEGMENT).alias("nth"), F.concat(_closing(F.col("e.state"), 2), F.lit("K")).alias("piece"))
    inserted = pieces.drop("id").unionByName(ends).where(F.length("piece") > 1)
    inserted = inserted.select("conv", "part", "seq", "nth", F.posexplode(F.split(F.expr("left(piece, length(piece) - 1)"), "")).alias("within", "letter"))
    inserted = inserted.select("conv", "part", "seq", "nth", "within", F.lit("insert").alias("edit"), F.lit(None).cast("long").alias("id"), name(F.col("letter")).alias("role"), F.lit("").alias("text"))
    return stays.unionByName(inserted)


def _hashes(kind: pa.DataType):
    def run(batches):
        at, running, fresh = None, None, True
        for batch in batches:
            convs, hashes = [], []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if fresh or conv != at:
                    if not fresh:
                        convs.append(at)
                        hashes.append(running.hexdigest())
                    at, running, lead, fresh = conv, hashlib.sha256(), "", False
                running.update(f"{lead}{role}:{text}".encode("utf-8", "surrogatepass"))
                lead = "\n"
            yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(hashes, pa.string())], ["conv", "repaired_sha256"])
        if not fresh:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([running.hexdigest()])], ["conv", "repaired_sha256"])

    return run


def digests(repaired_: DataFrame) -> DataFrame:
    """conv, repaired_sha256. A conversation's hash needs its rows in order in one task; they pass it as a stream from a sort that spills."""
    ordered = repaired_.repartition("conv").sortWithinPartitions("conv", "part", "seq", "nth", "within").select("conv", "role", "text")
    return ordered.mapInArrow(_hashes(to_arrow_type(repaired_.schema["conv"].dataType)), f"conv {dict(repaired_.dtypes)['conv']}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their faults, ``chosen`` segments, ``repaired`` rows) of ``prepared`` rows, which must be a written table.

    Null conversations are one of their own, null turns come first, null roles and texts are one space; rows of one turn are ordered by role
    and text, and rows that are equal in all are each other's duplicates. Blank roles have no place in the grammar and are changed or
    deleted. Extra columns are ignored; an empty table gives empty results."""
    text_batches(rows.sparkSession)
    marked = written(faults(rows), "faults")
    picked = written(chosen(written(segments(marked), "segments")), "chosen")
    return marked, picked, repaired(picked, rows)


def damage(df: DataFrame) -> DataFrame:
    """``prepared`` rows with the contract's damage, by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, without marks, repeated, or
    said by the user."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    coded = df.select("conv_id", "turn", "role", "text").withColumn("code", F.crc32(key.cast("binary")) % 20).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate(F.col("text").cast("string"), ".!?", "")).otherwise(F.col("text").cast("string"))
    coded = coded.withColumns({"text": text, "role": F.when(F.col("code") == 4, "user").otherwise(F.col("role").cast("string"))})
    return prepared(coded.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))))


def structure(df: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``df``, given its ``prepared``
    rows; a conversation without rows has zeros, an empty audit and the hash of an empty string."""
    marked, picked, made = repair(rows)
    seen = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    turns = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count_distinct("turn")
    counts = marked.groupBy("conv").agg(F.coalesce(turns.cast("long"), F.lit(0).cast("long")).alias("gaps"), *seen)
    out = df.select(F.col("conv_id").alias("conv_id")).distinct()
    for k, more in enumerate((counts, audits(picked), digests(made))):
        out = out.join(more.withColumnRenamed("conv", f"conv_{k}"), F.col("conv_id").eqNullSafe(F.col(f"conv_{k}")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``structure`` of all conversations, damaged as the contract says."""
    df = table(spark, sf_dir, "conversations")
    return structure(df, written(damage(df), "damaged"))


def _op11_sql() -> str:
    """Damage by a bitwise CRC, then the cheapest edits row by row: of each state the least (cost, audit)."""
    step = "list_reduce(list_prepend(c, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    ways = []
    for sign in "suaoSUAOd":
        for state in range(STATES):
            now, lead, cost = state, "", 0
            for _ in range(3):
                ways += [f"('{sign}', {state}, '{lead}{letter}', {cost + more}, {to})" for letter, _, more, to in _moves(sign, now)]
                now, lead, cost = STEPS[NEXT[now]][now], lead + "I", cost + INSERT
    closing = ", ".join(f"({s}, {c}, '{a}')" for s, (c, a, _) in CLOSING.items())
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY c) AS t FROM (SELECT c, {step} AS v FROM (SELECT unnest(range(256)) AS c))),
k AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS code FROM k, tab),
m AS (SELECT r, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy, conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM c WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), r, copy) AS i, rtrim(text, {blanks}) AS bare FROM m),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
g AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN ini NOT IN ('s', 'u', 'a') THEN CASE WHEN fault IS NULL THEN 'o' ELSE 'O' END WHEN fault IS NULL THEN ini ELSE upper(ini) END AS sign,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AS bad FROM f),
ways(sign, state, letters, cost, after) AS (VALUES {", ".join(ways)}),
closing(state, cost, letters) AS (VALUES {closing}),
best(conv_id, i, state, cost, audit) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '' FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL
  SELECT conv_id, i, after, w.cost, w.audit FROM (
    SELECT b.conv_id, g.i, ways.after, b.cost + ways.cost AS cost, b.audit || ways.letters AS audit,
      row_number() OVER (PARTITION BY b.conv_id, ways.after ORDER BY b.cost + ways.cost, b.audit || ways.letters) AS place
    FROM best b JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND g.i = b.i + 1 JOIN ways ON ways.sign = g.sign AND ways.state = b.state) w WHERE place = 1),
n AS (SELECT conv_id, max(i) AS n, max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM g GROUP BY ALL),
e AS (SELECT b.conv_id, min({{'cost': b.cost + closing.cost, 'audit': b.audit || closing.letters}}) AS x FROM best b JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.n = b.i JOIN closing USING (state) GROUP BY ALL),
p AS (SELECT conv_id, x.audit AS audit, unnest(string_split(x.audit, '')) AS letter, unnest(range(len(x.audit))) AS pos FROM e WHERE x.audit <> ''),
q AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS nth FROM p),
z AS (SELECT q.conv_id, pos, letter, nth, g.ini, g.role, g.text, bool_or(g.ini = 's' AND letter = 'K' AND nth = 1) OVER (PARTITION BY q.conv_id) AS led
  FROM q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id AND g.i = q.i AND letter <> 'I' WHERE letter <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - coalesce(led, false)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos)) AS s FROM z GROUP BY ALL)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.x.cost, 0) AS BIGINT) AS cost, coalesce(e.x.audit, '') AS audit, coalesce(h.s, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM a.conv_id"""


OP11_SQL = _op11_sql()
