"""Operator 6: toxicity by Levenshtein automata over a lexicon trie, with context windows."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

TOKEN = re.compile(r"[^\W\d_]+")
# Folds of the label rows, of which the first is held out.
FOLDS = 5
# Words that announce someone else's words, and marks that enclose them.
REPORTING = frozenset("said says quote quoted quotes wrote called calls dit disait écrit sagte schrieb zitierte dijo escribió citado".split())
OPENING, CLOSING = '"“«„‹', '"”»“›'
#: Words around a term that its context covers; what a term counts for inside a quotation; the least support of a lexicon entry.
CONTEXT, QUOTED, SUPPORT = 6, 0.35, 5
#: Labelled rows that the lexicon is learned from at most, those with the smallest hash of the id; scoring covers every text. They bound the
#: lexicon: an entry needs ``SUPPORT`` toxic ones of them.
FIT_ROWS = 20_000
#: States of the automaton and words that a worker keeps before it begins anew.
KEPT = 200_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo the folds is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn_lexicon(labelled: DataFrame) -> list[tuple[str, float, bool, int]]:
    """(entry, weight, whether it is a stem, most edits) from text and toxic, by one count over all rows.

    An entry is a word that occurs in ``SUPPORT`` toxic texts or more and hardly in clean ones, or a stem of four or more letters
    with three or more such words and no clean one to speak of. Its weight is its share of toxic texts, shrunk by its support. A
    second pass over the counted words finds those within one and two edits of an entry: misspellings are allowed only as far as
    clean words don't live there. No entry is left out: their number is bounded by that of the rows given. Rows with a null label or text
    don't count; repeated rows count as often; without toxic rows the lexicon is empty.
    """

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(TOKEN.findall(t.lower()))) if t else [] for t in texts])

    seen = labelled.where("toxic is not null").select("toxic", F.explode(words(F.col("text").cast("string"))).alias("word"))
    per = written(seen.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("good")), "words")
    prefixes = F.transform(F.sequence(F.lit(4), F.least(F.length("word") - 1, F.lit(8))), lambda k: F.substring("word", F.lit(1), k))
    stems = per.where(F.length("word") >= 5).select(F.explode(prefixes).alias("word"), "bad", "good").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > 1).alias("kinds"))
    strong = (F.col("bad") >= SUPPORT) & (F.col("bad") / (F.col("bad") + 3 * F.col("good") + 1) >= 0.8)
    pure = (F.col("bad") >= 4 * SUPPORT) & (F.col("kinds") >= 3) & (F.col("good") * 50 <= F.col("bad"))
    both = per.where(strong).select("word", "bad", "good", F.lit(False).alias("stem")).unionByName(stems.where(pure).select("word", "bad", "good", F.lit(True).alias("stem")))
    best = both.collect()  # bounded by the rows that are learned from
    weight = lambda r: r["bad"] / (r["bad"] + r["good"] + 4)
    wide = tuple(sorted((r["word"], weight(r), r["stem"], 0 if r["stem"] else _edits(r["word"])) for r in best))

    @F.pandas_udf("struct<entry:string,edits:int>")
    def near(found: pd.Series) -> pd.DataFrame:
        matcher = _matcher(wide)
        return pd.DataFrame([m[1:] if (m := matcher.match(w)) and m[1] else (None, None) for w in found], columns=["edits", "entry"])[["entry", "edits"]]

    around = per.select(near("word").alias("m"), "bad", "good").where("m.entry is not null").groupBy("m.entry", "m.edits").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    crowded: dict[str, int] = {}
    for r in around.where("good > 0 and bad < 9 * good").collect():  # two rows an entry at most
        crowded[r["entry"]] = min(crowded.get(r["entry"], 9), r["edits"])
    return [(w, share, stem, min(limit, crowded.get(w, 9) - 1)) for w, share, stem, limit in wide]


def _edits(word: str) -> int:
    return 2 if len(word) >= 9 else 1 if len(word) >= 6 else 0


class LexiconMatcher:
    """The product of the trie of a lexicon and the Levenshtein automaton of every entry, determinised as words ask for it.

    A state is the set of (trie node, edits so far) that the letters read may lead to; transitions are kept, so a word costs a table
    look-up a letter, and most words die after a few. A longer entry allows more edits.
    """

    def __init__(self, lexicon: list[tuple[str, float, bool, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.value: list[tuple[float, int, bool, str] | None] = [None]
        self.longest: list[int] = [0]
        self.parent: list[int] = [-1]
        for word, weight, stem, limit in lexicon:
            node = 0
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.value.append(None)
                    self.longest.append(0)
                    self.parent.append(node)
                node = self.children[node][c]
            if self.value[node] is None or not stem:
                self.value[node] = (weight, limit, stem, word)
            while node >= 0:
                self.longest[node] = max(self.longest[node], limit)
                node = self.parent[node]
        self.known: dict[str, tuple[float, int, str] | None] = {}
        self._begin()

    def _begin(self) -> None:
        start = self._closed({(0, 0)})
        self.moves: dict[tuple[int, str], int] = {}
        self.states: list[frozenset] = [start]
        self.number = {start: 0}
        self.result: list[tuple[float, int, str] | None] = [self._result(start)]

    def _closed(self, state: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo, best = list(state), {}
        for node, edits in state:
            best[node] = min(best.get(node, 9), edits)
        while todo:  # letters of the entry that the word leaves out
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.longest[child] and best.get(child, 9) > edits + 1:
                    best[child] = edits + 1
                    todo.append((child, edits + 1))
        return frozenset(best.items())

    def _next(self, state: frozenset, c: str) -> frozenset:
        out: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.longest[node] and out.get(node, 9) > edits:
                out[node] = edits

        for node, edits in state:
            put(node, edits + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, edits if letter == c else edits + 1)
        return self._closed(set(out.items()))

    def _result(self, state: frozenset) -> tuple[float, int, str] | None:
        """(weight, edits, entry) of the nearest entry that the letters read so far spell."""
        best = None
        for node, edits in state:
            v = self.value[node]
            if v and edits <= v[1] and (best is None or (edits, -v[0]) < (best[1], -best[0])):
                best = (v[0], edits, v[3])
        return best

    def match(self, word: str) -> tuple[float, int, str] | None:
        if word in self.known:
            return self.known[word]
        if len(self.known) > KEPT:
            self.known.clear()
        if len(self.moves) > KEPT:
            self._begin()
        at, node, stem = 0, 0, None
        for c in word:
            if node is not None:
                node = self.children[node].get(c)
                if node is not None and self.value[node] and self.value[node][2]:
                    stem = (self.value[node][0], 0, self.value[node][3])
            after = self.moves.get((at, c))
            if after is None:
                state = self._next(self.states[at], c)
                after = self.number.setdefault(state, len(self.states))
                if after == len(self.states):
                    self.states.append(state)
                    self.result.append(self._result(state))
                self.moves[at, c] = after
            at = after
            if not self.states[at]:
                break
        found = self.result[at] if self.states[at] else None
        self.known[word] = out = found if found and not (stem and found[1]) else stem
        return out


@lru_cache(maxsize=1)
def _matcher(lexicon: tuple) -> LexiconMatcher:
    return LexiconMatcher(list(lexicon))


def score_text(text: str | None, matcher: LexiconMatcher, prior: float = 0.02) -> tuple[float, int, int]:
    """(score, terms, terms that a quotation or report encloses). Terms are taken to be independent witnesses."""
    if not text:
        return prior, 0, 0
    low = text.lower()
    hits = [(m.start(), m.end(), hit) for m in TOKEN.finditer(low) if (hit := matcher.match(m.group()))]
    if not hits:
        return prior, 0, 0
    clean, quoted = 1.0 - prior, 0
    for start, end, (share, edits, _) in hits:
        before, after = low[max(0, start - 12 * CONTEXT) : start], low[end : end + 12 * CONTEXT]
        near = TOKEN.findall(before)[-CONTEXT:]
        opened = max((before.rfind(q) for q in OPENING), default=-1)
        closed = opened >= 0 and any(q in after for q in CLOSING) and before.count('"') % 2 == (1 if '"' in before else 0)
        enclosed = closed and len(TOKEN.findall(before[opened:])) <= CONTEXT
        told = enclosed and any(w in REPORTING for w in near + TOKEN.findall(after)[:CONTEXT])
        weight = share * 0.75**edits * (QUOTED if told else 1.0)
        quoted += told
        clean *= 1.0 - min(weight, 0.995)
    return 1.0 - clean, len(hits), quoted


def toxicity(df: DataFrame, lexicon: list[tuple[str, float, bool, int]], text: str = "text") -> DataFrame:
    """Adds toxic_score (0 to 1), toxic_terms and quoted_terms for each whole text; columns of those names are replaced.

    Null and empty texts, and texts in which no term occurs, get the same low score; an empty lexicon gives it to all; repeated rows get
    the same; an empty table gives an empty result. The lexicon goes to the tasks as a constant.
    """
    fixed = tuple(lexicon)
    held = "toxicity" + "_" * max(map(len, df.columns), default=0)  # no column of df

    @F.pandas_udf("struct<toxic_score:double,toxic_terms:int,quoted_terms:int>")
    def score(texts: pd.Series) -> pd.DataFrame:
        matcher = _matcher(fixed)
        return pd.DataFrame([score_text(t, matcher) for t in texts], columns=["toxic_score", "toxic_terms", "quoted_terms"])

    out = df.withColumn(held, score(F.col(text).cast("string")))
    return out.withColumns({n: F.col(f"{held}.{n}") for n in ("toxic_score", "toxic_terms", "quoted_terms")}).drop(held)


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text and toxic of up to ``rows`` labelled rows outside the held-out fold. Only that many ids are broadcast, so no text is shuffled."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon of the rows outside the held-out fold, and the score of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn_lexicon(labelled(docs, table(spark, sf_dir, "labels")))
    out = toxicity(docs, lexicon)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_terms", "quoted_terms")
