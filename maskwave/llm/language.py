"""Operator 9: language of texts by script ranges and a Viterbi walk over the scores of words."""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WORD = re.compile(r"[^\W\d_]+")
#: Letters with the marks that belong to them, for texts that have any.
MARKED = regex.compile(r"\p{L}[\p{L}\p{M}\u200c\u200d]*")
# Folds, and the one that is held out.
FOLDS, HELD = 4, 2
#: Different texts of each language that the model is fitted on, those with the smallest hashes.
SAMPLE = 3000
#: Whole words are grams if the sample has them so often; grams of two and three letters all are.
WORD_LEAST = 5
#: Cells of a table that grams are looked up in directly; where letters are too many for one, they are searched for.
DIRECT = 1 << 24
#: Cells of a table of all scores; a model of more grams and languages is filled in for the grams of a batch alone.
WHOLE = 1 << 24
#: What a change of language from one word to the next costs, in natural logarithms of probability.
SWITCH = 6.0
# First code points of ranges and their scripts.
SCRIPTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "indic"),
    (0x0E00, "thai"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3400, "han"),
    (0xAC00, "hangul"),
    (0xD800, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
)
_FROM = np.array([s for s, _ in SCRIPTS])


_SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_OF_RANGE = np.array([_SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


def _script_number(word: str) -> int:
    return int(_SCRIPT_OF_RANGE[np.searchsorted(_FROM, ord(word[0]), "right") - 1])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo the folds is the held one; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters with their marks; numerals such as ½ or Ⅷ are none."""
    if not text:
        return []
    text = text.lower()
    if text.isascii() or not _has_marks(text):
        return [p for w in WORD.findall(text) for p in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    return MARKED.findall(text)


def _has_marks(text: str) -> bool:
    """False where no character can be a mark: those below U+0300 aren't."""
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return regex.search(r"\p{M}", text) is not None


def grams_of(word: str) -> list[str]:
    w = f" {word} "
    return [w] + [w[k : k + 3] for k in range(len(w) - 2)] + [w[k : k + 2] for k in range(len(w) - 1)]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of grams of each language, by way of counts of words; what a task holds is bounded by the words of a flush."""

    def rows(words: dict[str, Counter]) -> pa.RecordBatch:
        out: dict[tuple[str, str], int] = defaultdict(int)
        for lang, counts in words.items():
            for w, n in counts.items():
                for g in grams_of(w):
                    out[lang, g] += n
        return pa.record_batch([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())], ["lang", "g", "n"])

    words: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words[lang].update(words_of(text))
            if sum(map(len, words.values())) > 50_000:
                yield rows(words)
                words.clear()
    if words:
        yield rows(words)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple:
    """(id, languages, grams, and their scores) from text and lang of rows with a language: naive Bayes over grams of two and three letters
    and frequent words.

    Fitted on ``sample`` different texts of each language at most (the smallest hashes; a text counts once, whatever its copies), which is the
    one bound of the model: every gram of letters that the sample has counts, and every word that it has five times. A gram holds scores
    for the languages that have it alone, so the model grows with the samples, not with their number squared. Scoring covers every word
    of every text. Rows without text or language don't count; without any there are no languages.
    """
    keyed = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    texts = keyed.select("lang", "h").distinct()
    # The hashes bound the sample before any text moves: each language's share of the hash range, from its number of texts.
    counts = texts.groupBy("lang").agg(F.count("*").alias("n")).withColumn("share", F.least(F.lit(1.0), F.lit(1.3 * sample) / F.col("n")))
    place = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    near = texts.join(counts, "lang").where(place <= F.col("share"))
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= sample).select("lang", "h")
    some = keyed.join(F.broadcast(written(chosen, "sample")), ["lang", "h"])  # ``sample`` pairs of numbers a language
    once = some.groupBy("lang", "h").agg(F.first("text").alias("text"))

    counted = once.select("lang", "text").mapInArrow(_gram_counts, "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    counted = written(counted, "grams")
    often = counted.groupBy("g").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).where((F.length("g") < 4) | (F.col("n") >= WORD_LEAST))
    rows = often.orderBy("g").collect()  # grams of the sample, which is bounded
    langs = sorted({lang for r in rows for lang in r["by"]})
    place = {lang: k for k, lang in enumerate(langs)}
    names = tuple(r["g"] for r in rows)
    kind = np.array([min(len(g), 4) - 2 for g in names], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(r["by"]) for r in rows], dtype=np.int64)]).astype(np.int64)
    column = np.array([place[lang] for r in rows for lang in r["by"]], np.int32)
    counts = np.array([n for r in rows for n in r["by"].values()], float)
    gram = np.repeat(np.arange(len(rows)), np.diff(starts))
    rest, values = np.zeros((3, len(langs)), np.float32), np.zeros(len(counts), np.float32)
    for k in range(3):
        mine = kind[gram] == k
        whole = np.bincount(column[mine], weights=counts[mine], minlength=len(langs)) + 0.5 * max(int((kind == k).sum()), 1) + 1
        rest[k], values[mine] = np.log(0.5 / whole), np.log((counts[mine] + 0.5) / 0.5)  # over what the language gives any other gram
    # A language writes the scripts that hold a hundredth of its grams.
    script = np.array([_script_number(g.strip()) if g.strip() else -1 for g in names], np.int64)
    weight = np.zeros((len(_SCRIPT_NAMES), len(langs)))
    at = script[gram] if len(gram) else script[:0]
    np.add.at(weight, (at[at >= 0], column[at >= 0]), counts[at >= 0])
    able = weight >= 0.01 * np.maximum(weight.sum(axis=0), 1)
    return uuid.uuid4().hex, tuple(langs), names, starts, column, values, rest, able


class _Table:
    """Numbers of known pairs of codes, 0 for others: a direct table where that is small, else a sorted list."""

    def __init__(self, pairs: np.ndarray, width: int):
        self.width = width
        self.keys = np.unique(pairs[:, 0].astype(np.int64) * width + pairs[:, 1])
        self.size = len(self.keys) + 1
        self.index = None
        top = (int(self.keys[-1]) // width + 1) * width if len(self.keys) else 0
        if top <= DIRECT:
            self.index = np.zeros(top + 1, np.int32)
            self.index[self.keys] = np.arange(1, self.size)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        if self.index is not None:
            return self.index[np.minimum(key, len(self.index) - 1)]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at + 1, 0)


class WordScorer:
    """Log probability of words in each language, many words at once; a script that no language writes says nothing, others leave
    only theirs. Letters that no gram of the model holds share one code."""

    def __init__(self, model: tuple, whole: int = WHOLE):
        _, self.langs, grams, self.starts, self.column, self.values, self.rest, able = model
        letters = sorted({c for g in grams if len(g) < 4 for c in g} - {" "})
        code = {" ": 0} | {c: k + 2 for k, c in enumerate(letters)}
        self.of_point = np.ones(0x110000, np.int32)
        for c, k in code.items():
            self.of_point[ord(c)] = k
        width = len(code) + 1
        rows = [np.array([k for k, g in enumerate(grams) if len(g) == n], np.int64) for n in (2, 3)]
        two, three = (np.array([[code[c] for c in grams[k]] for k in mine], np.int64).reshape(-1, n) for mine, n in zip(rows, (2, 3), strict=True))
        self.two = _Table(np.vstack([two, three[:, :2]]), width)
        begins = self.two.number(three[:, 0], three[:, 1])
        self.three = _Table(np.column_stack([begins, three[:, 2]]), width)
        self.gram_of = []  # of each number of a table the gram, or -1
        for table, at, mine in ((self.two, self.two.number(two[:, 0], two[:, 1]), rows[0]), (self.three, self.three.number(begins, three[:, 2]), rows[1])):
            held = np.full(table.size, -1, np.int64)
            held[at] = mine
            self.gram_of.append(held)
        words = [k for k, g in enumerate(grams) if len(g) > 3]
        self.whole = {grams[k][1:-1]: j + 1 for j, k in enumerate(words)}  # 0: another word
        self.gram_of.append(np.array([-1, *words], np.int64))
        self.tables = [self._filled(k, np.arange(len(g))) if len(g) * len(self.langs) <= whole else None for k, g in enumerate(self.gram_of)]
        self.able = able[_SCRIPT_OF_RANGE]

    def _filled(self, kind: int, numbers: np.ndarray) -> np.ndarray:
        """A row of scores for each number."""
        out = np.tile(self.rest[kind], (len(numbers), 1))
        gram = self.gram_of[kind][numbers]
        there = np.flatnonzero(gram >= 0)
        first, size = self.starts[gram[there]], self.starts[gram[there] + 1] - self.starts[gram[there]]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(there) else np.zeros(0, np.int64)
        out[np.repeat(there, size), self.column[at]] += self.values[at]
        return out

    def _rows(self, kind: int, numbers: np.ndarray) -> np.ndarray:
        if self.tables[kind] is not None:
            return self.tables[kind][numbers]
        some, back = np.unique(numbers, return_inverse=True)
        return self._filled(kind, some)[back]

    def scores(self, words: list[str]) -> np.ndarray:
        """One row a word, its best language at 0."""
        line = " " + " ".join(words) + " "
        points = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32)
        codes = self.of_point[points]
        size = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        pair = self.two.number(codes[:-1], codes[1:])
        part = self._rows(0, pair)
        inner = self._rows(1, self.three.number(pair[:-1], codes[2:]))
        inner[codes[1:-1] == 0] = 0  # runs over the space between two words
        part[:-1] += inner
        total = np.add.reduceat(part, starts, axis=0)
        get = self.whole.get
        longer = size > 1
        total[longer] += self._rows(2, np.fromiter((get(w, 0) for w in words), np.int64, len(words))[longer])
        total /= 2
        able = self.able[np.searchsorted(_FROM, points[starts + 1], "right") - 1]
        total[~able] = -np.inf
        none = ~able.any(axis=1)
        total[none] = 0
        total -= total.max(axis=1, keepdims=True)
        return np.where(np.isneginf(total), np.float32(-30), np.maximum(total, np.float32(-12)))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best language of each word of many texts at once. scores: words x languages, text after text; lengths: words of each text."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    live = lengths[order]
    back = np.empty(scores.shape, np.int32)
    value = np.zeros((len(lengths), scores.shape[1]), np.float32)
    steps = int(live[0]) if len(live) else 0
    alive = np.searchsorted(-live, -np.arange(1, steps + 1), "right")
    stay = np.arange(scores.shape[1], dtype=np.int32)
    begin = starts[order]
    for t in range(steps):
        n = alive[t]
        at = begin[:n] + t
        v = value[:n]
        if t:
            best = v.argmax(axis=1)
            top = v[np.arange(n), best][:, None] - penalty
            moved = top > v
            back[at] = np.where(moved, best[:, None], stay)
            v = np.maximum(v, top)
        value[:n] = v + scores[at]
        if t % 64 == 63:
            value[:n] -= value[:n].max(axis=1, keepdims=True)
    out = np.empty(len(scores), np.int32)
    now = value.argmax(axis=1).astype(np.int32)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        out[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    return out


_SCORERS: dict[str, WordScorer] = {}


def _scorer(model: tuple) -> WordScorer:
    """The scorer of a model, made once a worker."""
    if model[0] not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model[0]] = WordScorer(model)
    return _SCORERS[model[0]]


SPANS = "struct<lang:string,score:double,spans:array<struct<lang:string,first_word:int,n_words:int>>>"


def label_texts(texts, scorer: WordScorer) -> list[tuple]:
    """(language, score, spans) of each text; the language is that of most letters, the score its share of the letters times the
    mean probability of its words."""
    found = [words_of(t) for t in texts]
    if not scorer.langs:
        return [("und", 0.0, []) for _ in found]
    lengths = np.array([len(w) for w in found], np.int64)
    if not lengths.any():
        return [("und", 0.0, []) for _ in found]
    parts = ([w for ws in found[k : k + 64] for w in ws] for k in range(0, len(found), 64))
    scores = np.concatenate([scorer.scores(p) for p in parts if p])
    best = viterbi(scores, lengths)
    letters = np.fromiter((len(w) for ws in found for w in ws), np.int64, len(scores))
    odds = np.exp(np.clip(scores, -30, 0))
    sure = odds[np.arange(len(scores)), best] / odds.sum(axis=1)
    out, at = [], 0
    for n in lengths.tolist():
        if not n:
            out.append(("und", 0.0, []))
            continue
        mine, w = best[at : at + n], letters[at : at + n]
        mass = np.bincount(mine, weights=w, minlength=len(scorer.langs))
        top = int(mass.argmax())
        own = mine == top
        score = float(mass[top] / mass.sum() * np.average(sure[at : at + n][own], weights=w[own]))
        cuts = np.flatnonzero(np.diff(mine)) + 1
        firsts = np.concatenate([[0], cuts])
        spans = [(scorer.langs[mine[f]], int(f), int(e - f)) for f, e in zip(firsts, [*cuts, n], strict=True)]
        out.append((scorer.langs[top], min(max(score, 0.0), 1.0), spans))
        at += n
    return out


def identify(df: DataFrame, model: tuple, text: str = "text", out: str = "language") -> DataFrame:
    """Adds ``out``: language, score and spans (language, first word, words) of each whole text; replaces a column of that name.

    Null, empty and letterless texts are ``und`` with score 0 and no spans, as is every text under a model without languages; repeated
    rows get the same; an empty table gives an empty result. The model, whose size the sample bounds, is broadcast.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS)
    def of(texts: pd.Series) -> pd.DataFrame:
        scorer, rows = _scorer(held.value), []
        values = texts.tolist()
        for k in range(0, len(values), 1024):
            rows += label_texts(values[k : k + 1024], scorer)
        return pd.DataFrame({"lang": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": [[{"lang": s[0], "first_word": s[1], "n_words": s[2]} for s in r[2]] for r in rows]})

    return df.withColumn(out, of(F.col(text).cast("string")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fit`` on the rows outside the held-out fold, ``identify`` on all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.size("language.spans").cast("long").alias("n_spans"))
