"""Each corpus operator against brute force on small tables, with nulls, empty and very long texts, ties, repeats, empty tables and
clashing columns."""

import hashlib
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from maskwave.llm import decontaminate, html, language, media, mixing, queries, repeats, secrets, simhash, toxicity, urls
from maskwave.llm.automaton import compile_rules
from maskwave.llm.common import rolling

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas()


# Secrets.

BASE = (
    ("assign", r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m)]
    return [(BASE[k][0], s, e) for s, k, e in sorted(found)]


def test_secret_spans_are_those_of_the_patterns(real):
    rng = np.random.default_rng(0)
    parts = ["password", "passwd", "secret", "token", "api_key", "ApiKey", "AKIA", '"', "'", " ", ":", "=", "é", "abc", "0123456789abcdef", "XYZ9", "-", "\n", "a" * 30, "se", "to"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 15))) for _ in range(3000)] + real["text"].tolist() + [None, "", "x" * 300_000 + " token=abcdef1"]
    for t in texts:
        assert [s for s in secrets.spans_of(t) if s[0] in ("assign", "access", "hex")] == base_spans(t)


def test_secret_query(spark, real):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_secrets"](spark, DATA).collect()}
    assert len(got) == len(real)
    for i, t in zip(real["doc_id"], real["text"], strict=True):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert got[i]["n_hex"] == sum(k == "hex" for k, _, _ in want)


def test_secrets_on_odd_rows(spark):
    d = docs(spark, (None, None), (1, ""), (1, "token: abcdefg é"), (1, "token: abcdefg é")).withColumn("secret_spans", F.lit(1))
    assert sorted(len(r["secret_spans"]) for r in secrets.scan(d).collect()) == [0, 0, 1, 1]
    assert sorted(str(r["text"]) for r in secrets.redact(d).collect()) == ["", "None", "[assign] é", "[assign] é"]
    assert secrets.scan(d.limit(0)).count() == 0


def test_automaton_refuses_what_one_pass_cannot_do():
    with pytest.raises(ValueError):
        compile_rules(["a(bbc)?"]).spans(b"x")
    assert compile_rules(["ab+", "b{2}"]).spans(b"xabbb") == [(1, 2, 4), (0, 1, 5)]


# Repeats.


def brute_repeats(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = (t or "").encode().split()
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {k for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (i, s) for k in range(s, s + 20)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def test_repeats_are_brute_force(spark):
    rng = np.random.default_rng(2)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    shared = [words(n) for n in (19, 20, 21, 33, 60)]
    rows = [(k, " ".join(sum(([*words(int(rng.integers(0, 30))), *shared[j]] for j in rng.integers(0, 5, 3)), []))) for k in range(40)]
    rows += [(None, rows[3][1]), (100, None), (101, ""), (102, rows[5][1]), (102, rows[5][1]), (103, "a " * 100), (104, " ".join(words(20000)) + " " + rows[7][1])]
    got = repeats.remove_repeats(docs(spark, *rows).withColumn("key", F.lit(1)).withColumn("shared", F.lit(2))).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats(rows)
    assert repeats.remove_repeats(docs(spark, *rows).limit(0)).count() == 0


def test_cover_and_rolling_hash():
    for a in range(repeats.PERIOD):
        assert any((x - y) % repeats.PERIOD == a for x in repeats.COVER for y in repeats.COVER)
    h = np.arange(1, 60, dtype=np.uint64)
    for n in (1, 2, 7, 8, 20):
        r = rolling(h, n, repeats.FIRST)
        assert len(r) == 60 - n and (rolling(h[3:], n, repeats.FIRST) == r[3:]).all()


# Page text.


def test_template_subtrees_go_and_the_article_stays(spark):
    page = lambda k: f'<html><body><div><p>Our site</p><span>since 1999</span></div><p>Story {k} &lt;b&gt;\n text</p><p>quoted by all</p></body></html>'
    inside = lambda k: f'<body><nav>n{k}</nav><article><h1>T{k}</h1><p>quoted by all</p><aside>no</aside></article><footer>f</footer></body>'
    rows = [(k, f"http://a.com/{k}", page(k)) for k in range(12)] + [(k, f"http://b.com/{k}", inside(k)) for k in range(12)] + [(50, None, None), (51, "x", ""), (None, "http://c.com", "<p>a<p>b"), (None, "http://c.com", "<p>a<p>b"), (52, "http://d.com", page(1))]
    out = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("a", F.lit(1)).withColumn("templates", F.lit(1)))
    got = defaultdict(list)
    for r in out.collect():
        got[r["page_id"], r["url"]].append(r["text"])
    assert got[3, "http://a.com/3"] == ["Story 3 <b> text"]
    assert got[3, "http://b.com/3"] == ["T3\nquoted by all"]
    assert got[50, None] == [""] and got[51, "x"] == [""] and got[None, "http://c.com"] == ["a\nb"] * 2
    assert got[52, "http://d.com"] == ["Our site\nsince 1999\nStory 1 <b> text\nquoted by all"] or got[52, "http://d.com"] == ["Our site\nsince 1999\nStory 1 <b> text\nquoted by all".replace("\nsince", " since")]
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_against_a_plain_reading(spark):
    import html as entities

    pages = spark.read.parquet(f"{DATA}/pages.parquet").toPandas().set_index("page_id")
    for r in queries.QUERIES["op3_html"](spark, DATA).collect():
        a = re.search(r"<article>(.*?)</article>", pages.loc[r["page_id"], "html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"</?\w+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>|<br><p>", a)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_deep_and_broken_markup():
    began = time.perf_counter()
    for broken in ("<div>" * 100_000, "<b>" * 50_000, "<div></x>" * 50_000, "<p>a<li>b" * 30_000, "<table><tr><td>x" * 20_000, '<div class="q">t' * 30_000):
        assert html.text_without(html.read_page(broken + "deep"), set()).endswith("deep")
    assert time.perf_counter() - began < 30
    assert [t for t, _ in html.read_page("<p>a<b>b</p><p>c</b></p><script>x<y</script>d<")[0]] == ["ab", "c", "d<"]
    assert [t for t, _ in html.read_page("<article><p>a<p>b</article><div>no</div><article><p>c</article>")[0]] == ["a", "b", "c"]


# Decontamination.


def test_leaks_are_brute_force(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"v{k}" for k in rng.integers(0, 3000, n)]
    items = [(k, " ".join(words(int(n)))) for k, n in enumerate(rng.integers(1, 60, 30))] + [(100, None), (101, ""), (None, "a b c d e f")]
    rows = []
    for k in range(60):
        body = items[k % 30][1].split()
        for _ in range(k % 4):
            body[int(rng.integers(0, len(body)))] = "changed"
        rows.append((k, " ".join([*words(50), *body, *words(50)]).upper() if k % 2 else " ".join([*words(2000), *body])))
    rows += [(200, None), (201, ""), (None, items[20][1]), (202, items[21][1]), (202, items[21][1])]

    def sh(t):
        w = (t or "").lower().split()
        return {" ".join(w[s : s + 5]) for s in range(max(len(w) - 4, 1))} if w else set()

    want = {(i, j, len(sh(b)), len(sh(a) & sh(b))) for i, a in rows for j, b in items if j is not None and sh(b) and len(sh(a) & sh(b)) >= 0.8 * len(sh(b)) - 1e-9}
    found = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = decontaminate.leaks(docs(spark, *rows).withColumn("key", F.lit(1)), found).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want) > 20
    assert decontaminate.leaks(docs(spark, *rows), found.limit(0)).count() == 0 and decontaminate.leaks(docs(spark, *rows).limit(0), found).count() == 0


# Media.


def test_media_round_trip(spark, real):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_media"](spark, DATA).collect()}
    for i, t in zip(real["doc_id"], real["text"], strict=True):
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(payload) + 44 and r["feature"].startswith("audio/wav;corrected")


def test_media_odd_texts_and_carving(spark):
    n, wav = media.as_wav(F.col("text"))
    d = docs(spark, (1, None), (2, ""), (3, "x" * 64), (4, "é" * 200_000)).withColumn("parts", F.lit(0))
    rows = {r["doc_id"]: r for r in media.sniff(d.select("*", n.alias("n"), wav.alias("media"))).collect()}
    assert [rows[k]["n"] for k in (1, 2, 3, 4)] == [0, 0, 64, 400_000]
    assert [rows[k]["parts"][0]["payload_length"] for k in (1, 2, 3, 4)] == [64, 64, 64, 400_000]
    gz = zlib.compressobj(wbits=31)
    packed = gz.compress(b"hello") + gz.flush()
    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big") for k, b in ((b"IHDR", bytes(13)), (b"IDAT", b"zz"), (b"IEND", b"")))
    blob = spark.createDataFrame([(1, png + b"junk BM" + packed + b"tail", "image/gif"), (2, png[:-3], "image/png"), (3, None, None), (4, b"", None)], "id long, media binary, declared string")
    got = media.sniff(blob, declared="declared")
    by = {r["id"]: r for r in got.collect()}
    assert [p["mime"] for p in by[1]["parts"]] == ["image/png", "application/gzip"] and by[1]["mime"] == "image/png" and by[1]["type_corrected"]
    assert by[2]["parts"] == [] and by[2]["mime"] == "image/png" and by[3]["mime"] == "application/octet-stream"
    assert bytes(media.carve(got).where("part.start > 0").first()["carved"]) == packed


def test_many_magics_and_media_in_media(spark):
    import io
    import zipfile

    began = time.perf_counter()
    assert media.parts_of(b"%PDF-" * 100_000) == [] and media.parts_of(b"PK\x03\x04\x14" * 100_000) == []
    assert media.parts_of(b"\xff\xd8\xff\xda\x00\x02" * 50_000) == []
    assert time.perf_counter() - began < 10
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.txt", "inner text")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
    whole = outer.getvalue()
    assert media.parts_of(whole + b"tail")[0][:3] == ("application/zip", 0, len(whole)) and len(media.parts_of(whole)) == 2
    pdf = b"%PDF-1.4 first %%EOF update %%EOF"
    assert media.parts_of(pdf + b" between " + pdf)[0][:3] == ("application/pdf", 0, len(pdf))
    empty = spark.createDataFrame([], "media binary")
    assert media.sniff(empty).count() == 0
    twice = media.sniff(spark.createDataFrame([(bytearray(pdf),)] * 2, "media binary"))
    assert media.carve(twice.withColumn("part", F.lit(1))).count() == 2


# Toxicity.


def test_levenshtein_trie_is_edit_distance():
    lexicon = [("worthless", 0.9, False, 2), ("stupid", 0.9, False, 1), ("loser", 0.9, False, 0), ("lowei", 0.9, True, 0)]
    m = toxicity.LexiconMatcher(lexicon)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *[0] * len(b)] if (last := row) is None else [i] + [0] * len(b)
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    rng = np.random.default_rng(5)
    words = ["worthless", "stupid", "loser", "losers", "loweixyz", "lowe", "a", "wothles", "wrthlss", "stupidd", "xstupid"]
    for w in ("worthless", "stupid", "loser"):
        for _ in range(300):
            v = list(w)
            for _ in range(int(rng.integers(0, 4))):
                k, c = int(rng.integers(0, len(v) + 1)), str(rng.choice(list("abcdeilorstuw")))
                v[k : k + int(rng.integers(0, 2))] = [c] if rng.random() < 0.6 else []
            words.append("".join(v))
    for w in words:
        near = [distance(w, e) for e, _, stem, limit in lexicon if not stem and distance(w, e) <= limit]
        want = min(near) if near else 0 if w.startswith("lowei") else None
        got = m.match(w)
        assert (got[1] if got else None) == want, w


def test_quotation_counts_less():
    m = toxicity.LexiconMatcher([("idiot", 0.9, False, 0)])
    said = toxicity.score_text('She said "idiot" twice in court', m)
    assert said[0] < 0.5 <= toxicity.score_text("you are an idiot", m)[0] and said[2] == 1
    assert toxicity.score_text(None, m)[0] == toxicity.score_text("", m)[0] < 0.5


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES["op6_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = out["predicted"][out["toxic"] == 1].mean()
    assert out["predicted"][out["toxic"] == 0].mean() < 0.02 and hit > 0.8


def test_toxicity_without_labels(spark):
    d = docs(spark, (1, None), (2, ""), (None, "a b"))
    assert toxicity.learn_lexicon(d.select("text", F.lit(None).cast("int").alias("toxic"))) == []
    assert toxicity.toxicity(d.withColumn("toxic_score", F.lit("x")), []).where("toxic_score < 0.5").count() == 3


def test_toxicity_of_odd_tables(spark):
    d = docs(spark, (1, "you worthles idiot " + "calm words here " * 30_000), (1, "you idiot"), (1, "you idiot")).withColumn("_toxicity", F.lit("kept"))
    got = toxicity.toxicity(d, [("worthless", 0.9, False, 2), ("idiot", 0.9, False, 0)])
    rows = [(r["toxic_terms"], r["_toxicity"]) for r in got.collect()]
    assert sorted(rows) == [(1, "kept"), (1, "kept"), (2, "kept")]
    assert toxicity.toxicity(d.limit(0), []).count() == 0


def test_score_is_that_of_a_plain_reading(spark):
    """The query's score from every entry's edit distance to every word, and the fold's rows alone."""
    rng = np.random.default_rng(9)
    calm = [f"calm{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(400):
        toxic = k % 4 == 0
        words = [str(w) for w in rng.choice(calm, 12)] + ([str(rng.choice(["worthless", "stupidity", "dimwit"]))] if toxic else [])
        rows.append((k, " ".join(words), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn_lexicon(toxicity.labelled(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")))
    fold = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    plain = {w: sum(y for t, y in fold if w in t.split()) for w in ("worthless", "stupidity", "dimwit")}
    assert {w: round(v, 9) for w, v, stem, _ in lexicon if not stem} == {w: round(n / (n + 4), 9) for w, n in plain.items()}
    scored = {r["doc_id"]: r["toxic_score"] for r in toxicity.toxicity(frame.select("doc_id", "text"), lexicon).collect()}
    for i, t, _ in rows:
        clean = 0.98
        for w in t.split():
            if w in plain:
                clean *= 1 - plain[w] / (plain[w] + 4)
        assert np.isclose(scored[i], 1 - clean)


# URLs.


def test_urls_are_brute_force(spark):
    hosts = ["com", "example.com", "a.example.com", "notexample.com", "net", "example.net", "x.example.net", "org", "spam-farm.example.org", ""]
    paths = ["", "/", "/en/", "/en", "/en/7", "/en/71", "/de/8", "/de/1", "/es/", "/en/?q", "#x", "?a/b"]
    rows = [(k, f"http://{h.upper() if k % 2 else h}{p}") for k, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(900, None), (901, "nothing"), (902, ""), (902, ""), (None, "ftp://com/en/://x")]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("best", F.lit(1)), urls.rules_frame(spark))
    for r in out.collect():
        rest = r["url"].split("://", 1)[1] if r["url"] and "://" in r["url"] else None
        m = re.match(r"([^/?#]*)([^?#]*)", rest) if rest is not None else None
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [x for x in urls.RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fit, key=lambda x: len(x[1] + x[2]), default=None)
        own = bool(set(re.split("[.-]", host)) & set(urls.BAD_WORDS))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best[1] + best[2], best[0] if best else "block" if own else "allow")
    assert urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.rules_frame(spark).limit(0)).where("verdict = 'allow'").count() == len(rows)


def test_url_rules_say_what_the_contract_says(spark):
    want = [
        ("http://a.com/en/1", "com/en/", "block"), ("http://a.example.com/en/1", "com/en/", "block"), ("http://a.example.com/en/71", "example.com/en/7", "allow"),
        ("http://a.net/de/8", "net/de/", "allow"), ("http://spam.net/de/1", "net/de/", "allow"), ("http://a.example.net/de/7", "net/de/", "allow"), ("http://Example.NET/de/81", "example.net/de/8", "block"),
        ("http://a.org/es/", "org/es/", "block"), ("http://a.net/es/", None, "allow"), ("http://spam.net/en/", None, "block"),
    ]
    out = urls.judge(spark.createDataFrame([(u,) for u, _, _ in want], "url string"), urls.rules_frame(spark))
    assert {tuple(r) for r in out.select("url", "rule", "verdict").collect()} == set(want)


def test_long_rules_and_hosts_of_many_labels(spark):
    path = "/" + "p" * 10_000
    rules = spark.createDataFrame([("block", "a.com", path, False), ("allow", "b.a.com", "/", False)], "verdict string, host string, path string, own boolean")
    rows = [(1, f"http://x.a.com{path}/more"), (2, "http://a.com/p"), (3, "http://" + "l." * 20_000 + "b.a.com/q"), (4, f"http://b.a.com{path}")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {1: ("a.com" + path, "block"), 2: (None, "allow"), 3: ("b.a.com/", "allow"), 4: ("b.a.com/", "allow")}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_urls_use_no_python(spark):
    plan = queries.QUERIES["op7_urls"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# SimHash.


def brute_fingerprint(text):
    w = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(fps, distance=3):
    root = list(range(len(fps)))

    def top(k):
        while root[k] != k:
            k = root[k] = root[root[k]]
        return k

    u = np.array(fps, np.uint64)
    for k in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[k]) <= distance):
            a, b = top(k), top(int(j))
            root[max(a, b)] = min(a, b)
    return [top(k) for k in range(len(u))]


def test_simhash_query(spark, real):
    ids = real["doc_id"].tolist()
    fps = [brute_fingerprint(t) for t in real["text"]]
    names = {ids[k]: min(ids[j] for j, r in enumerate(roots) if r == roots[k]) for roots in [brute_components(fps)] for k in range(len(ids))}
    for r in queries.QUERIES["op8_simhash"](spark, DATA).collect():
        assert int(r["fingerprint"], 16) == fps[ids.index(r["doc_id"])] and r["component_id"] == names[r["doc_id"]]


@pytest.mark.parametrize("bucket", [256, 8])
def test_links_of_a_hot_family(spark, bucket):
    rng = np.random.default_rng(6)
    fps = {int(v) for v in rng.integers(0, 2**63, 100)}
    for b in list(fps)[:50]:
        fps |= {b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 5), replace=False)) for _ in range(3)}
    bits = rng.choice(63, 9, replace=False)
    hot = next(iter(fps))
    fps |= {hot ^ sum(1 << int(k) for k in bits if rng.random() < 0.5) for _ in range(300)}
    fps = sorted(fps)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, bucket)).collect()}
    want = [fps[k] for k in brute_components(fps)]
    part = lambda labels: {frozenset(f for f, y in zip(fps, labels, strict=True) if y == x) for x in set(labels)}
    assert part([got.get(f, f) for f in fps]) == part(want)


def test_simhash_odd_rows(spark):
    d = docs(spark, (5, None), (3, ""), (9, " \n"), (None, "alone text here now"), (7, "Alone text here NOW"), (7, "Alone text here NOW"), (8, "one"), (2, "z " * 100_000)).withColumn("fp", F.lit(0)).withColumn("root", F.lit(0))
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(d).collect())
    assert got == [("2", 2), ("3", 3), ("5", 3), ("7", 7), ("7", 7), ("8", 8), ("9", 3), ("None", 7)]
    assert simhash.near_duplicates(d.limit(0)).count() == 0


# Language.


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = queries.QUERIES["op9_language"](spark, sf).join(truth, "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.98 and out["score"].between(0, 1).all()


def test_viterbi_is_brute_force():
    from itertools import product

    rng = np.random.default_rng(7)
    lengths = np.array([3, 0, 6, 1, 5])
    s = rng.normal(size=(lengths.sum(), 3)).astype(np.float32) * 3
    got, at = language.viterbi(s, lengths, 2.0), 0
    for n in lengths:
        part = s[at : at + n]
        value = lambda p, part=part: sum(part[k, x] for k, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        if n:
            assert np.isclose(value(tuple(got[at : at + n])), max(map(value, product(range(3), repeat=int(n)))), atol=1e-4)
        at += n


def test_language_spans_scripts_and_odd_rows(spark):
    train = spark.createDataFrame([("the cat and the dog with them " * 5, "en"), ("der hund und die katze mit ihnen " * 5, "de"), ("кошка и собака с ними " * 5, "ru"), (None, "en"), ("x", None)], "text string, lang string")
    model = language.fit(train)
    d = docs(spark, (1, None), (2, ""), (3, "123 !"), (4, "the cat with the dog and them der hund und die katze mit ihnen"), (5, "собака и кошка"), (6, "the dog " * 50_000)).withColumn("language", F.lit(1))
    got = {r["doc_id"]: r["language"] for r in language.identify(d, model).collect()}
    assert [got[k]["lang"] for k in (1, 2, 3)] == ["und"] * 3 and got[3]["score"] == 0
    assert [s["lang"] for s in got[4]["spans"]] == ["en", "de"] and got[5]["lang"] == "ru" and got[6]["lang"] == "en"
    empty = language.fit(train.limit(0))
    assert language.identify(d, empty).select("language.lang").distinct().collect()[0][0] == "und"


def test_many_languages_and_scripts(spark):
    """200 languages, each with letters of its own in Han or Latin, and none taken for another."""
    rng = np.random.default_rng(7)
    names = [f"l{k:03d}" for k in range(200)]
    alphabets = [[chr(0x4E00 + 40 * k + j) if k % 2 else chr(0x100 + (k * 7 + j * 5) % 0x140) for j in range(14)] for k in range(200)]
    text = lambda k: " ".join("".join(rng.choice(alphabets[k], 5)) for _ in range(40))
    train = spark.createDataFrame([(text(k), names[k]) for k in range(200) for _ in range(3)], "text string, lang string")
    model = language.fit(train)
    scorer = language.WordScorer(model)
    got = language.label_texts([text(k) for k in range(200)], scorer)
    assert sum(g[0] == n for g, n in zip(got, names, strict=True)) >= 190 and got[199][0] == "l199"
    assert [g[0] for g in language.label_texts(["½ ² Ⅷ 12", None, "", "_"], scorer)] == ["und"] * 4


def test_copies_do_not_fill_the_sample(spark):
    rows = [("the same text again", "en")] * 500 + [(f"other words {chr(97 + k % 26) * 5} number", "en") for k in range(40)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), sample=20)
    assert "oth" in model[2]


def test_words_keep_their_marks():
    assert language.words_of("हिन्दी में, Ⅷ ½ naïve e\u0301t\u00e9 12x") == ["हिन्दी", "में", "naïve", "e\u0301t\u00e9", "x"]
    assert language.words_of("Ⅷ ½ A1b_c") == ["a", "b", "c"]


def test_scores_are_those_of_plain_sums(spark):
    """Grams counted and smoothed one by one; the table of all scores and the one of a batch's grams give the same."""
    rng = np.random.default_rng(11)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 6)))
    texts = [(" ".join(word(a) for _ in range(30)), lang) for lang, a in (("x", "abcde"), ("y", "cdefg"), ("z", "абвг")) for _ in range(12)]
    model = language.fit(spark.createDataFrame(texts, "text string, lang string"))
    counts, words = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for t, lang in texts:
        for w in t.split():
            for g in language.grams_of(w):
                counts[g][lang] += 1
                words[g] += 1
    held = {g: c for g, c in counts.items() if len(g) < 4 or words[g] >= language.WORD_LEAST}
    assert set(model[2]) == set(held)
    whole = {(k, lang): sum(c[lang] for g, c in held.items() if min(len(g), 4) == k) + 0.5 * sum(min(len(g), 4) == k for g in held) + 1 for k in (2, 3, 4) for lang in "xyz"}

    def plain(w):
        grams = language.grams_of(w)[1:] + ([f" {w} "] if len(w) > 1 else [])
        total = np.array([sum(np.log((held.get(g, {}).get(lang, 0) + 0.5) / whole[min(len(g), 4), lang]) for g in grams) / 2 for lang in "xyz"])
        total[[w[0] > "z", w[0] > "z", w[0] <= "z"]] = -np.inf
        total -= total.max()
        return np.where(np.isneginf(total), -30, np.maximum(total, -12))

    asked = [word("abcdefgh") for _ in range(200)] + [word("абвгд") for _ in range(50)] + ["q", "ж"]
    want = np.array([plain(w) for w in asked])
    assert np.allclose(language.WordScorer(model).scores(asked), want, atol=2e-3)
    assert np.allclose(language.WordScorer(model, whole=0).scores(asked), want, atol=2e-3)


# Mixing.


def test_targets_are_water_filling(spark):
    sizes = {"a": 100, "b": 1000, "c": 400, "d": 10, None: 700}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    weights, left, capped = dict(zip(sizes, (5, 2, 1, 5, 2), strict=True)), 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        over = {s: 2.0 * sizes[s] for s in free if left * weights[s] / sum(weights[x] for x in free) > 2 * sizes[s]}
        if not over:
            break
        capped |= over
        left -= sum(over.values())
    want = capped | {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
    assert got.keys() == want.keys() and all(np.isclose(got[s], want[s]) for s in want)


@pytest.mark.parametrize("leaf", [4096, 16])
def test_mix_meets_targets(spark, leaf):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 80))), None, f"s{k % 7}" if k % 3 else "hot", None) for k in range(1500)]
    rows += [(2000, None, None, None, None), (2001, "", None, "s1", None), (None, "a b c", None, "s2", None), (2002, "x y", None, None, None), (2002, "x y", None, None, None)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(1)).withColumn("unit", F.lit(1))
    one, two = mixing.mix(d, leaf=leaf), mixing.mix(d.repartition(9), leaf=leaf)
    a = one.toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert len(a) == len(rows) and sorted(map(str, a[key].values.tolist())) == sorted(map(str, two.toPandas()[key].values.tolist()))
    assert (a["taken"] <= 2 * a["size"]).all()
    for s, g in a.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 40, s
        assert g["source_size"].iloc[0] == g["size"].sum()
    assert mixing.mix(d.limit(0)).count() == 0


def test_equal_rows_are_rounded_one_by_one(spark):
    rows = [(None, "the same five words here", None, "s", None)] * 101 + [(k, "a b c", None, "t", None) for k in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 5 and g["copies"].max() - g["copies"].min() <= 1
    got = queries.QUERIES["op10_mix"](spark, DATA).toPandas()
    text = spark.read.parquet(f"{DATA}/documents.parquet").toPandas().set_index("doc_id")
    size = text["text"].map(lambda t: len((t or "").encode().split()))
    assert (got.set_index("doc_id")["size"] == size).all() and (got["taken"] == got["copies"] * got["size"]).all()
    for _, g in got.groupby(got["doc_id"].map(text["source"])):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= size.max() and g["source_size"].iloc[0] == g["size"].sum()


def test_rounding_keeps_expectations():
    import pandas as pd

    sizes = np.array([50, 40, 30, 20, 10, 10, 5, 5] * 6)
    p = np.full(len(sizes), 0.37)  # as in a source: one probability for all
    g = pd.DataFrame({"unit": [str(k) for k in range(len(sizes))], "source": "s", "size": sizes, "mass": p * sizes, "leaf": 0})
    runs = np.mean([(mixing._pivot(g, seed).sort_values("unit")["mass"] / mixing._pivot(g, seed).sort_values("unit")["size"]).to_numpy() for seed in range(400)], axis=0)
    assert np.abs(runs - (g.assign(p=p).sort_values("unit")["p"]).to_numpy()).max() < 0.12
    assert np.isclose(mixing._pivot(g, 1)["mass"].sum(), (p * sizes).sum())


def test_repeats_of_plain_ids_are_brute_force(spark):
    """Ids that order the documents by themselves."""
    rng = np.random.default_rng(12)
    shared = [f"s{k}" for k in range(50)]
    rows = [(int(i), " ".join([*(f"w{k}" for k in rng.integers(0, 5000, 25)), *shared[int(rng.integers(0, 9)) : int(rng.integers(25, 50))]])) for i in rng.choice(1 << 30, 40, replace=False)]
    assert sorted([tuple(r) for r in repeats.remove_repeats(docs(spark, *rows)).collect()], key=str) == brute_repeats(rows)
