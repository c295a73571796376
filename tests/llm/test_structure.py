"""Conversations, divergence and shards against brute force, with nulls, empty and long texts, ties, repeats, empty tables, clashing
columns, and one key that holds most rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwave.llm import conversations, divergence, queries, sharding

CONV = "conv_id long, turn long, role string, text string, text_crc32 string, conv long, id string"
DOCS = "doc_id long, text string, lang string, source string, shard string, size string, n long"


# Conversations.


def edits(signature):
    """Cheapest audit by trying everything, from the contract's words."""
    best = {("", ""): 0}  # (audit, roles) -> cost
    grow = lambda known: {**known, **{(a + "I" * k, r + ins): c + 5 * k for (a, r), c in known.items() for k in (1, 2) for ins in map("".join, itertools.product("ua", repeat=k))}}
    legal = lambda r: re.fullmatch("s?(ua)*u?", r)
    for sign in signature:
        after = {}
        for (a, r), c in grow(best).items():
            ways = [("D", "", 2)]
            if sign != "d":
                more = 5 * sign.isupper()
                ways += [("K", sign.lower(), more)] + [("R", x, 1 + more) for x in "ua"]
            for letter, role, cost in ways:
                key = (a + letter, r + role)
                if legal(key[1]) and c + cost < after.get(key, 1 << 30):
                    after[key] = c + cost
        least = {}
        for (a, r), c in after.items():  # only the role at the end and whether there is a system row alone decide what may follow
            k = (r[-1:], len(r) == 1 and r == "s", r == "")
            if k not in least or (c, a) < least[k][0]:
                least[k] = ((c, a), r)
        best = {(a, r): c for (c, a), r in least.values()}
    return min((c, a) for (a, r), c in grow(best).items() if re.fullmatch("(s?(ua)+)?", r))


def test_signatures_are_solved_as_by_trying_all():
    rng = np.random.default_rng(1)
    for _ in range(400):
        signature = "".join(rng.choice(list("suaoSUAOduaua"), rng.integers(0, 9)))
        row = conversations.solve(signature)[0]
        found = min((w[0] + conversations.CLOSING[s][0], w[1] + conversations.CLOSING[s][1]) for s, w in enumerate(row) if w)
        assert found == edits(signature), signature
    assert len(conversations.solve("ua" * (conversations.SEGMENT // 2))[0][3][1]) == conversations.SEGMENT


def structure_of(rows):
    """The contract, conversation by conversation: rows are (conv, turn, role, text) before damage."""
    by, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        by[conv] += [] if code == 0 else [(turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)] * (2 if code == 3 else 1)
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, signs = set(), [], ""
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            first = role[:1] if role[:1] in tuple("sua") else "o"
            signs += "d" if fault in ("blank", "duplicate") else first.upper() if fault else first
        initials = [r[1][:1] for r in mine]
        turns = [r[0] for r in mine if r[0] is not None]
        cost, audit = edits(signs)
        lines, at = [], 0
        led = False
        for letter in audit:
            row = None
            if letter != "I":
                row, at = mine[at], at + 1
            if letter == "D":
                continue
            led = led or (not lines and letter == "K" and row[1][:1] == "s")
            role = row[1] if letter == "K" else ("assistant", "user")[(len(lines) - led) % 2 == 0]
            lines.append(f"{role}:{row[2] if row else ''}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = Counter(faults)
        bad = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run_structure(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONV)
    from maskwave.llm.common import written

    out = conversations.structure(df, written(conversations.damage(df), "damaged"))
    return {r["conv_id"]: tuple(r)[1:] for r in out.collect()}


def test_conversations_are_repaired_as_by_hand(spark):
    rng = np.random.default_rng(2)
    pick = lambda *x: x[rng.integers(0, len(x))]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.integers(1, 9)):
            rows.append((conv, pick(None, turn, turn, turn, turn + 1), pick("user", "assistant", "user", "assistant", "system", "tool", "", None), pick("Yes.", "No", "\x0b ", "", None, f"é {turn}!", "Ja? \n", "What")))
    rows += [(70, 0, "user", "long " * 100_000 + "."), (70, 1, "assistant", "a."), (71, None, None, None), (72, -(1 << 62), "user", "a."), (72, 1 << 61, "assistant", "b.")]
    got, want = run_structure(spark, rows), structure_of(rows)
    assert got == want
    assert run_structure(spark, []) == {}


def test_a_conversation_of_most_rows_is_cut_into_segments(spark):
    roles = np.random.default_rng(3).choice(["user", "assistant", "assistant", "system"], 1500)
    rows = [(1, t, roles[t], f"{t % 700}" + ".x"[t % 11 == 0]) for t in range(1500)] + [(c, t, "user", "Hm.") for c in range(2, 40) for t in range(2)]
    got, want = run_structure(spark, rows), structure_of(rows)
    assert got == want
    assert got[1][0] > 0 and len(got[1][6]) > 1000


# Divergence.


def divergence_of(rows, least):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), g or "", s or "") for t, g, s in rows]
    out = set()
    for lang in {g for _, g, _ in docs}:
        mine = [(w, s) for w, g, s in docs if g == lang]
        held = Counter(x for w, _ in mine for x in set(w))
        kept = sorted((x for x, n in held.items() if n >= least), key=lambda x: x.encode())
        share = lambda c: [1 + 10**9 * (c[x] + 5) // (sum(c[y] for y in kept) + 5 * len(kept)) for x in kept]  # noqa: B023, E731
        whole = share(Counter(x for w, _ in mine for x in w))
        counts = {s: Counter(x for w, s2 in mine if s2 == s for x in w) for s in {s for _, s in mine}}
        p = {s: share(c) for s, c in counts.items()}
        for s in p:
            far = sorted(((sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o) for o in p if o != s), key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(far)}
            more = sorted(((a - q, x) for x, a, q in zip(kept, p[s], whole, strict=True) if counts[s][x] and a > q), key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "term", x, v, k + 1) for k, (v, x) in enumerate(more[:50])}
    return out


def test_divergence_is_that_of_the_plain_sums(spark):
    rng = np.random.default_rng(4)
    words = ["The", "the", "naïve", "Ünder", "Z", "a1b", "x_y", "日本", "😀", *(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(130))]
    pick = lambda *x: x[rng.integers(0, len(x))]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 60))), pick("en", "en", "de", None, ""), pick(*"abcdefg", None, "", "é")) for _ in range(600)]
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("solo", "fr", None), (None, None, None), ("the " * 50_000, "en", "a")] + [("same same text", "en", "hot")] * 400
    df = spark.createDataFrame([(i, t, g, s, "x", "y", 1) for i, (t, g, s) in enumerate(rows)], DOCS)
    want = divergence_of(rows, 30)
    assert {tuple(r) for r in divergence.divergence(df).collect()} == want
    assert {tuple(r) for r in divergence.divergence(df, width=7, block=3).collect()} == want
    assert divergence.divergence(df.limit(0)).collect() == []


def test_shares_beyond_64_bits_are_exact():
    counts = np.array([[3, 10**15 + 7], [0, 5]])
    got = divergence.shares(counts, np.array([[10**15 + 10], [5]]), 2)
    assert got.tolist() == [[1 + 10**9 * (int(c) + 5) // (n + 10) for c in row] for row, n in zip(counts, (10**15 + 10, 5), strict=True)]


# Shards.


def shards_of(spark, rows, **options):
    df = spark.createDataFrame([(i, t, None, None, "x", "y", 1) for i, t in rows], DOCS)
    return sharding.shard_documents(df, **options).collect()


def check_shards(rows, got, shards, within):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    size = Counter({k: 0 for k in range(shards)})
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) - min(size.values()) <= within
    for k in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_shards_are_even_and_move_little(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "é" * int(rng.integers(0, 300)) + str(i)) for i in range(2000)] + [(None, None), (None, ""), (7, "again"), (7, "again"), (-3, "again"), (9, "x" * 20_000)]
    got = shards_of(spark, rows)
    check_shards(rows, got, 8, 30)
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    total, old = sum(r["size"] for r in got), Counter()
    for r in got:
        old[r["old_shard"]] += r["size"]
    least = sum(max(0, n - total / 8) for n in old.values())
    assert least - 8 * 30 <= sum(r["size"] for r in got if r["moved"]) <= least + 2_000
    assert shards_of(spark, []) == []
    fewer = shards_of(spark, rows, shards=3, old_shards=7)
    check_shards(rows, fewer, 3, 30)


def test_a_group_of_more_than_a_shard_is_dealt(spark):
    rows = [(i if i % 3 else None, "copied text") for i in range(3000)] + [(i, f"own text {i}") for i in range(4000, 7000)]
    got = shards_of(spark, rows)
    check_shards(rows, got, 8, 40)


def test_the_flow_is_the_cheapest():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n, m = rng.integers(1, 4), rng.integers(1, 4)
        supply = rng.integers(0, 4, n).tolist()
        capacity = [sum(supply) // m + (j < sum(supply) % m) for j in range(m)]
        cost = rng.integers(0, 9, (n, m)).astype(float).tolist()
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        slots = [j for j, c in enumerate(capacity) for _ in range(c)]
        want = min((sum(cost[i][j] for i, j in zip(units, p, strict=True)) for p in set(itertools.permutations(slots))), default=0)
        flow = sharding.least_cost_flow(supply, capacity, cost)
        assert [sum(f) for f in flow] == supply and [sum(f[j] for f in flow) for j in range(m)] == capacity
        assert sum(cost[i][j] * flow[i][j] for i in range(n) for j in range(m)) == pytest.approx(want)


def test_files_are_rewritten_only_where_rows_leave(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} " * (i % 9), "en", "s", "x", "y", 1) for i in range(900)], DOCS)
    path = str(tmp_path / "layout")
    sharding.store(df, path, 5)
    before = {p.name: {q.name: q.stat().st_mtime_ns for q in p.glob("*.parquet")} for p in (tmp_path / "layout/files").glob("__name=*")}
    told = sharding.rewrite(spark, path, 6, 0)
    assert 0 < told["rewritten"] < told["files"] and told["new"] >= 5
    for p in before:
        assert {q.name: q.stat().st_mtime_ns for q in (tmp_path / "layout/files" / p).glob("*.parquet")} == before[p]
    for generation in (0, 1):
        back = sharding.stored(spark, path, generation)
        assert back.columns == [*df.columns, "__shard"] and back.drop("__shard").exceptAll(df).isEmpty() and back.count() == 900
    sizes = [r["n"] for r in sharding.stored(spark, path, 1).groupBy("__shard").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 30
    assert sharding.rewrite(spark, path, 6, 0) == told  # a run that is repeated gives the same
    assert sharding.stored(spark, path, 1).count() == 900


# The SQL of the subpackage.


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    data = "/root/testdata/sf0.001"
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    plain = lambda df: sorted(repr(tuple(r)) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False))
    assert plain(queries.QUERIES[name](spark, data).toPandas()) == plain(con.sql(queries.ORACLE_SQL[name]).df())
