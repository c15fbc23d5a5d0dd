"""URL filter, importance resampling and spelling variants against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import resampling, spelling, url_filter

from .test_llm import prose

URLS = [
    "http://a.example.net/en/1", "https://example.net/en/", "http://notexample.net/en/1", "http://EXAMPLE.com/de/x?y=/fr/", "http://example.com/De/x", "http://b.org/fr/#a", "http://b.org", "http://c.net", "http://c.net?x=1",
    "http://c.net/", "net", "://net/", "a://net/b://org/fr/", None, "", "http://", "http://org/fr/x", "http://xorg/fr/x", "http://example.com/de/", "http://café.net/é?q=ü&&a=b", "http://a.b/" + "x" * 300_000, "http://u@e.org:80/fr/",
]


def plain_verdict(url):
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[1:]) if fit else (host, path, None, None)


def test_rules_and_parts_of_urls(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = url_filter.op11_url_filter(df).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, rule, verdict = plain_verdict(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def invented(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        bad = r.random() < 0.3
        host = "-".join(r.choices(["win", "free", "best", "x99", "deal"], k=3)) if bad else "".join(r.choices("aeioulnrst", k=9))
        rows.append((f"http://{host}{i % 40}.{r.choice(['com', 'org'])}/{r.randrange(100)}" + ("?a=1&b=2&c=3" if bad and i % 2 else ""), bad))
    return rows


def test_trees_on_hosts_never_seen_and_against_plain_python(spark):
    model = url_filter.train(spark.createDataFrame(invented(600, 1), "url string, blocked boolean"), trees=8)
    held = invented(300, 2)
    df = spark.createDataFrame([(u, b) for u, b in held], "url string, y boolean").select("*", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    got = url_filter.block_odds(df, model).collect()
    assert sum((r.margin > 0) == r.y for r in got) >= 295
    x = url_filter._joined(url_filter._described(df, "url"), model.rates, model.total).collect()
    odds = {r.url: r.margin for r in got}
    for r in x:
        m = model.start
        for splits, leaves in model.trees:
            m += leaves[int("".join(str(int(r.x[f] > t)) for f, t in splits), 2)]
        assert odds[r.url] == pytest.approx(m)
        n = Counter(r.host)
        assert r.x[8] == pytest.approx(-sum(k / len(r.host) * math.log2(k / len(r.host)) for k in n.values()))
        assert r.x[0] == len(r.url) and r.x[10] == r.url.count("=") and r.x[6] == sum(c.isdigit() for c in r.host) / len(r.host)


def test_training_sample_is_bounded_and_labels_may_lack(spark):
    schema = "url string, blocked boolean"
    rows = spark.createDataFrame([*invented(400, 3), (None, None)], schema)
    assert url_filter.train(rows, trees=1, max_labelled=50).total == 50
    assert url_filter.train(rows.where("blocked"), trees=1).start > 0 > url_filter.train(rows.where("not blocked"), trees=1).start
    empty = url_filter.train(rows.limit(0))
    assert empty.trees == () and empty.start < 0
    pages = spark.createDataFrame([("http://q.com/", "v", "w")], "url string, HOST string, row string")
    out = url_filter.filter_urls(pages, rows.limit(0)).collect()
    assert [(r.row, r.host, r.verdict) for r in out] == [("w", "q.com", "allow")]
    assert url_filter.op11_url_filter(spark.createDataFrame([], "page_id long, url string")).collect() == []


def plain_features(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [zlib.crc32(x) % 10000 for x in w + [a + b" " + b for a, b in zip(w, w[1:])]]


@pytest.mark.parametrize("size", [1 << 20, 7, 50])
def test_byte_automaton_over_slices(monkeypatch, size):
    monkeypatch.setattr(resampling, "SLICE", size)
    r = random.Random(1)
    texts = ["".join(r.choices("abcXYZ 09.,-éß中😀\n\0", k=r.choice([0, 1, 5, 50, 300]))) for _ in range(60)] + [None, "", "a" * 500 + " b", "x y"]
    for given in (pa.array(texts), pa.array(["q q", *texts, "zz"]).slice(1, len(texts))):
        got = [[] for _ in texts]
        for doc, bucket, _ in resampling.features(given):
            for i, x in zip(doc, bucket):
                got[i].append(int(x))
        assert [sorted(g) for g in got] == [sorted(plain_features(t)[1]) for t in texts]


def plain_draw(docs, bench):
    s, t = Counter(), Counter()
    made = [plain_features(x[1]) for x in docs]
    for _, f in made:
        s.update(f)
    for x in bench:
        t.update(plain_features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    out = []
    for (i, _), (w, f) in zip(docs, made):
        gains = [math.floor(1000 * math.log(float(t[b] + 1) * float(n + 10000) / (float(s[b] + 1) * float(m + 10000)))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    ranks = defaultdict(list)
    for k, x in enumerate(able):
        ranks[x].append(k + 1 if k < 25 * len(able) // 100 else None)
    return Counter((x[0], *x[2:], ranks[x].pop() if x in ranks else None) for x in out)


def test_drawing_against_plain_python(spark):
    r = random.Random(4)
    docs = [(i, prose(r.choice([5, 19, 20, 60]), i % 90) + r.choice(["", " ÉÀ x", "\n\n"])) for i in range(200)]
    docs += [(None, None), (900, ""), (901, prose(2000, 3) * 20)] + [(7777, prose(30, 5))] * 40 + [(None, prose(30, 6))] * 9
    bench = [prose(40, i) for i in range(5)] + [None]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = resampling.op12_importance_resampling(df, spark.createDataFrame([(i, b) for i, b in enumerate(bench)], "item_id long, text string")).collect()
    assert Counter(tuple(x) for x in got) == plain_draw(docs, bench)
    none = df.limit(0)
    assert resampling.op12_importance_resampling(none, none).collect() == []


def test_scores_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, prose(30, 1), "v", "w")], "doc_id long, text string, row string, n_words string").withColumnsRenamed({"n_words": "body"})
    out = resampling.draw(resampling.weighted_documents(df, df), 100).collect()
    assert [(x.row, x.body, x.rank) for x in out] == [("v", "w", 1)]


def plain_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if words[v] >= 2 * words[w]}
    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def key(rows):
    return sorted(rows, key=lambda r: r[0])


def test_spelling_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    r = random.Random(2)
    base = ["".join(r.choices("abcdeé", k=r.choice([4, 5, 6, 7, 9]))) for _ in range(40)]
    docs = [(i if i % 9 else None, " ".join(r.choices(base, k=200)) + "—ÀÉ×÷ÿ Übung,ÜBUNG") for i in range(60)] + [(99, None), (98, ""), (97, "q" * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(x) for x in spelling.op13_spelling_variants(df).collect()]
    assert key(got) == plain_variants(plain_words(docs)) and len(got) > 30 and any(x[4] for x in got)
    assert spelling.op13_spelling_variants(df.limit(0)).collect() == []


@pytest.mark.parametrize("few", [0, 3, 4096])
def test_hot_segments_are_split_without_losing_a_pair(spark, few):
    r = random.Random(8)
    words = {"".join(r.choices("ab", k=r.choice([1, 5, 6, 7, 8]))) for _ in range(300)} | {"common" + "".join(r.choices("xyz", k=k)) for k in (1, 2, 3, 4) for _ in range(60)} | {"é", "éé", "a" * 70_000, "a" * 70_001}
    got = sorted(tuple(x) for x in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), few).collect())
    short = [w for w in words if len(w) < 100]
    want = {(a, b) if (len(a), a) < (len(b), b) else (b, a) for a in short for b in short if a != b and one_edit(a, b)} | {("a" * 70_000, "a" * 70_001)}
    assert got == sorted(want)


def test_rows_of_split_keys_do_not_carry_long_words(spark, monkeypatch):
    r, kept, materialize = random.Random(5), [], spelling.materialize
    monkeypatch.setattr(spelling, "materialize", lambda df, *a, **b: kept.append(out := materialize(df, *a, **b)) or out)
    monkeypatch.setattr(spelling, "release", lambda *frames: None)
    base = ["".join(r.choices("ab", k=k)) for k in (255, 256, 257, 300, 300, 400)] + ["b" * 300]
    words = sorted({w for x in base for w in (x, x[:9] + "c" + x[9:], x[:-9] + x[-8:], "z" + x[1:], x[:100] + "y" + x[101:], x[:-1] + "d")})
    got = sorted(tuple(x) for x in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), 0).collect())
    assert got == sorted({(a, b) if (len(a), a) < (len(b), b) else (b, a) for a in words for b in words if a != b and one_edit(a, b)})
    split = [x for x in kept if "rest" in x.columns]
    assert len(split) > 8 and max(len(v) for x in split for row in x.collect() for v in row if isinstance(v, str)) <= 257


def test_chains_of_forms_end_at_the_root(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "zzzzz": 5}
    got = [tuple(x) for x in spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert key(got) == plain_variants(counts) and {x[2] for x in got} == {"bbbbb", "zzzzz"}
