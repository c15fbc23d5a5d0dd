import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import classifier, embeddings, mixing, near_dedup, packing, pii, quality_rules, sharding, substrings, warc
from tidepanel.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, SLOT int, size string, target double, kept string, rid int, node string, context int, __text string"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


def texts():
    base = prose(150, 1)
    words = base.split()
    near = " ".join(words[:70] + ["changed"] + words[71:])
    shared = prose(90, 2)
    return [
        None, "", "   \n\t", "one", "Hello World", base, base, base.upper(), near, near + " tail", prose(30, 3) + " " + shared, shared + " " + prose(40, 4),
        "ab " * 400, "line a\nline a\nline b\n\n\nline a", "mail a@b.co c%d@e.f.g and a@b.c%d@e.f +1 (555) 555-1234 ip 1.2.3.4 300.1.1.1 card 4111 1111 1111 1111, 4111-1111-1111-1112.",
        "é" * 300 + " " + prose(60, 5), "1 2 3 4 5 6 7 8 9 " * 900, "x" * 5000, "THE QUICK!! " * 60, "# * $ % " * 50, "😀 naïve word 10.0.0.1", "a " * 3000,
    ]


def rows():
    t = texts()
    out = [(i, x, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(x) if x else None) for i, x in enumerate(t)]
    out += [(None, "null id", "en", "s1", 7), (3, "one", None, "s3", 3), (7, base_dup(t), "de", "s0", 1), (7, base_dup(t), "de", "s0", 1)]
    return [(*r, "x", 1, "y", 0.5, "k", 9, "n", 2, "z") for r in out]


def base_dup(t):
    return t[5]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(df):
    return df.collect()


def test_sharding_is_a_fair_and_repeatable_permutation(docs, nothing):
    out = sharding.op1_sharding(docs).collect()
    assert len(out) == len(rows())
    sizes = collections.Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert sorted(map(str, out)) == sorted(map(str, sharding.op1_sharding(docs.repartition(7)).collect()))
    crc = collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out)
    assert crc == collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sharding.op1_sharding(nothing).count() == 0
    full = sharding.assign_shards(docs, 4)
    assert full.count() == len(rows()) and "SLOT" not in full.columns and "slot" in full.columns


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1009])
def test_feistel_is_a_bijection(spark, n):
    steps = sharding.walk_length(spark, n, 5)
    got = sorted(r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n, steps, 5)).collect())
    assert got == list(range(n))


def test_sharding_deals_out_a_row_repeated_without_end(spark):
    df = spark.range(90_000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"))
    out = sharding.assign_shards(df, 16, rows_a_bucket=16).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert len(out) == 16 and all(r.n == r.d == r.m + 1 == 5625 for r in out)


def test_substrings_against_brute_force(docs, nothing, spark, monkeypatch):
    data = [(r[1] or "").encode() for r in rows()]
    seen = collections.Counter(t[i : i + 400] for t in data for i in range(len(t) - 399))
    want = []
    for (doc_id, *_), t in zip(rows(), data):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((doc_id, len(t), sum(gone), sum(k for k, _ in itertools.groupby(gone)), hashlib.sha256(kept).hexdigest()))
    got = substrings.op2_substring_dedup(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = substrings.repeated_bytes(docs, with_kept=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in kept)
    monkeypatch.setattr(substrings, "HOT", 1)
    assert sorted(map(str, map(tuple, substrings.op2_substring_dedup(docs).collect()))) == sorted(map(str, want))
    assert substrings.op2_substring_dedup(nothing).count() == 0


def test_segments_name_equal_suffixes_alike():
    a, b = prose(300, 9).encode(), prose(40, 10).encode() + prose(300, 9).encode()
    def keys(x):
        d = np.frombuffer(x, np.uint8)
        start, count, anchor, name = substrings.segments(d)
        out = {}
        for s, n, an, nm in zip(start, count, anchor, name):
            for i in range(s, s + n):
                out[bytes(d[i : i + 400])] = (nm, an - i)
        return out
    ka, kb = keys(a), keys(b)
    same = set(ka) & set(kb)
    assert len(same) > 1000 and all(ka[k] == kb[k] for k in same)


def labelled(n=400):
    good = [(i, prose(60 + i % 50, i), "en", f"s{i % 3}", 300) for i in range(n)]
    bad = [(n + i, (prose(5, n + i).upper() + "!! ") * 12, "en", "junk" if i % 2 else "s1", 300) for i in range(n)]
    return good + bad


def test_classifier_on_held_out_rows(spark, docs, nothing):
    rs = labelled()
    df = spark.createDataFrame(rs, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([(r[0], int(r[0] < 400), 0) for r in rs if r[0] % 2], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in classifier.op3_quality_classifier(df, lab).collect()}
    unseen = [i for i in out if i % 2 == 0]
    assert np.mean([out[i].kept == (i < 400) for i in unseen]) > 0.98
    assert len(classifier.op3_quality_classifier(docs, lab).collect()) == len(rows())
    assert classifier.op3_quality_classifier(nothing, lab).count() == 0
    none = classifier.op3_quality_classifier(docs, lab.limit(0)).collect()
    assert all(r.kept and r.score is None for r in none)


def test_co_training_teaches_the_other_view():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.5).astype(float)
    a, b = y[:, None] * 3 + rng.normal(size=(2000, 2)), y[:, None] * 3 + rng.normal(size=(2000, 2))
    few = np.zeros(2000, bool)
    few[:40] = True
    held = np.zeros(40, bool)
    held[::4] = True
    m = classifier.co_train(a[few], b[few], y[few], held, a[~few], b[~few])
    assert ((m.score(a[~few], b[~few])[2] >= 0.5) == (y[~few] == 1)).mean() > 0.97


def test_co_training_hears_every_sure_row_of_the_pool(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(3000) < 0.5).astype(float)
    a, b = (np.float32(y[:, None] * 6 + rng.normal(size=(3000, 2))) for _ in range(2))
    held = np.arange(400) % 4 == 0
    asked = []

    def added(*task):
        out = classifier.pool_sums((a[400:], b[400:]), *task)
        asked.append((task, out))
        return out

    m = classifier.co_train_by_sums(a[:400], b[:400], y[:400], held, added)
    counts = [out for (_, w, *_), out in asked if w is None]
    assert len(counts) == 3 and counts[0].reshape(2, 2).min() > 600  # far beyond 200 of a class and round
    pool = spark.createDataFrame([(p.tobytes(), q.tobytes()) for p, q in zip(a[400:], b[400:])], "xc binary, xm binary").repartition(5)
    added = classifier._added_on_executors(pool)
    for task, out in asked:
        assert np.allclose(added(*task), out, rtol=1e-4, atol=1e-3)
    assert np.allclose(classifier.co_train_by_sums(a[:400], b[:400], y[:400], held, added).content, m.content, atol=1e-5)


def test_classifier_pool_is_the_whole_corpus(spark, monkeypatch):
    rs = labelled(2400) + [(None, "no id here", None, None, None)]
    df = spark.createDataFrame(rs, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([(r[0], int(r[0] < 2400), 0) for r in rs[:-1] if r[0] % 20 == 0], "doc_id long, quality int, toxic int")
    sizes = []
    real = classifier._added_on_executors
    monkeypatch.setattr(classifier, "_added_on_executors", lambda pool: sizes.append(pool.count()) or real(pool))
    assert classifier.train(df, lab, rounds=1) is not None
    assert sizes == [len(rs) - 240]


def test_mixing_targets_and_budgets(docs, nothing):
    out = mixing.op4_mixing(docs).collect()
    src = {r[0]: r[3] for r in rows()}
    size = collections.Counter()
    for r in rows():
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(size.values()), {}, set(names)
    while True:  # excess goes to the others until none is above
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    taken = collections.Counter()
    for r in out:
        assert r.taken <= 2 * r.size
        if r.doc_id in src and list(x[0] for x in rows()).count(r.doc_id) == 1:
            assert r.source_size == size[src[r.doc_id]] and r.target == pytest.approx(target[src[r.doc_id]])
        taken[(r.source_size, round(r.target, 6))] += r.taken
    assert all(abs(v - k[1]) < 1.001 for k, v in taken.items())
    assert sorted(map(str, out)) == sorted(map(str, mixing.op4_mixing(docs.repartition(5)).collect()))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.select("text").collect()) == sum(taken.values())
    assert mixing.op4_mixing(nothing).count() == 0 == mixing.mix_documents(nothing).count()


def slow_best_fit(items, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in items:
        ok = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins) if capacity - sum(x[0] for x in b) >= size and cluster not in [x[2] for x in b] and [x[1] for x in b].count(source) < per_source]
        i = min(ok)[1] if ok else len(bins)
        if not ok:
            bins.append([])
        out.append((i, sum(x[0] for x in bins[i])))
        bins[i].append((size, source, cluster))
    return out


def test_best_fit_against_brute_force():
    r = random.Random(3)
    items = sorted(((r.randint(1, 60), r.randint(0, 3), r.randint(0, 20)) for _ in range(300)), reverse=True)
    assert packing.best_fit(items, 100, 2) == slow_best_fit(items, 100, 2)


def test_packing_places_every_word(docs, nothing):
    out = packing.pack_documents(docs, capacity=64).toPandas()
    used = out[out["n_words"] > 0].groupby("bin_id")["n_words"].sum()
    assert used.max() <= 64
    want = sorted((r[1] or "") for r in rows())
    out["doc_id"] = out["doc_id"].astype("Int64")
    solo = out[out["doc_id"].isin([r[0] for r in rows() if [x[0] for x in rows()].count(r[0]) == 1])]
    joined = solo.sort_values("piece").groupby("doc_id")["text"].agg("".join)
    assert all(joined[r[0]] == (r[1] or "") for r in rows() if r[0] in joined.index)
    assert sum(len(WORD.findall(t)) for t in out["text"]) == sum(len(WORD.findall(t)) for t in want)
    assert packing.op5_packing(nothing).count() == 0


def brute_statistics(t):
    w = WORD.findall(t or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = collections.Counter(grams)
    cover = {k for i, g in enumerate(grams) if c[g] > 1 for k in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_rules_statistics_and_outliers(spark, docs, nothing):
    out = quality_rules.op6_quality_rules(docs).collect()
    want = collections.Counter((r[0], *brute_statistics(r[1])) for r in rows())
    assert collections.Counter(tuple(r)[:6] for r in out) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in out)
    assert quality_rules.op6_quality_rules(nothing).count() == 0
    rs = [(i, prose(60, i), "en", "a") for i in range(200)] + [(900 + i, " ".join(w + "###" for w in prose(60, 500 + i).split()), "en", "a") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality_rules.op6_quality_rules(spark.createDataFrame(rs, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[900 + i] for i in range(20))


def brute_mcd(x):
    """Reweighted MCD with exact half subsets from many starts, for comparison."""
    x, best = x.astype(float), None
    rng, h = np.random.default_rng(1), (len(x) + 1) // 2
    for _ in range(60):
        at = rng.choice(len(x), 8, replace=False)
        m, c = x[at].mean(0), np.cov(x[at].T) + np.diag(np.square(quality_rules.FLOORS))
        for _ in range(12):
            near = np.argsort((np.linalg.solve(c, (x - m).T).T * (x - m)).sum(1), kind="stable")[:h]
            m, c = x[near].mean(0), quality_rules.INNER * np.cov(x[near].T, bias=True) + np.diag(np.square(quality_rules.FLOORS))
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = (np.linalg.slogdet(c)[1], m, c)
    _, m, c = best
    near = (np.linalg.solve(c, (x - m).T).T * (x - m)).sum(1) <= quality_rules.WITHIN
    m, c = x[near].mean(0), quality_rules.REWEIGHTED * np.cov(x[near].T, bias=True) + np.diag(np.square(quality_rules.FLOORS))
    return (np.linalg.solve(c, (x - m).T).T * (x - m)).sum(1)


def test_mcd_against_many_random_starts(spark):
    rng = np.random.default_rng(7)
    x = rng.multivariate_normal([3000] * 5, np.eye(5) * 200**2 + 100**2, 1500).round().astype(int)
    x[:600] += rng.integers(4000, 6000, (600, 1))  # two fifths are outliers on a line
    df = spark.createDataFrame([("g", "w", i, *map(int, r)) for i, r in enumerate(x)], "pair string, wide string, i int, x0 long, x1 long, x2 long, x3 long, x4 long")
    d = {r.i: r.d2 for r in quality_rules.mcd_distances(df).collect()}
    want = brute_mcd(x)
    assert ((want > quality_rules.CUTOFF) == np.array([d[i] > quality_rules.CUTOFF for i in range(1500)])).all()
    assert np.corrcoef(want[600:], [d[i] for i in range(600, 1500)])[0, 1] > 0.99 and min(d[i] for i in range(600)) > 200


def test_quality_verdicts_do_not_hear_other_languages(spark):
    few = [(i, prose(60, i), "de", "small") for i in range(10)]
    plain = [(1000 + i, " ".join(w.upper() for w in prose(60, 700 + i).split()), "fr", f"s{i % 20}") for i in range(100)]
    schema = "doc_id long, text string, lang string, source string"
    both = {r.doc_id: r.kept for r in quality_rules.op6_quality_rules(spark.createDataFrame(few + plain, schema)).collect()}
    alone = {r.doc_id: r.kept for r in quality_rules.op6_quality_rules(spark.createDataFrame(few, schema)).collect()}
    assert all(both.values()) and all(alone.values())
    for n in (2, 49, 50):  # nothing changes at any count
        rows = [(i, prose(60, i), "de", "small") for i in range(n)]
        assert all(r.kept for r in quality_rules.op6_quality_rules(spark.createDataFrame(rows + plain, schema)).collect())


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "tricky\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "é\n", "<p>a</p>", "x"]
    rs = [(i, f"http://h/{i}" if i % 2 else None, h, "response") for i, h in enumerate(html)] + [(None, "u", "x", "y"), (1, "again", "other", "z")]
    got = sorted(map(tuple, warc.op7_warc(spark.createDataFrame(rs, "page_id long, url string, html string, record_type string")).collect()), key=str)
    best = collections.defaultdict(lambda: -1)
    for i, _, h, _ in rs:
        best[h or ""] = max(best[h or ""], -1 if i is None else i)
    want = []
    for i, _, h, _ in rs:
        raw = (h or "").encode()
        first = best[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)
    assert warc.op7_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def brute_pii(t):
    out, n = [], []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        found = []
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and max(map(int, m.group().split("."))) <= 255, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        n.append(len(found))
        out += found
    return (*n, hashlib.sha256(",".join(x[2] for x in sorted(out)).encode()).hexdigest())


def test_pii_base_against_brute_force(docs, nothing):
    got = pii.op8_pii(docs).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == collections.Counter((r[0], *brute_pii(r[1])) for r in rows())
    assert pii.op8_pii(nothing).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert all(sum(brute_pii(r.text)[:4]) == 0 for r in clean.collect())


def test_pii_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"write to member mail: user{i}@site{i}.example.com for more") for i in range(30)]
    new = [(100, "write to member mail: 88-4412-9931-77x for more"), (101, "the year 1234567 was fine")]
    got = {r.doc_id: r.spans for r in pii.op8_pii(spark.createDataFrame(seeds + new, "doc_id long, text string")).collect()}
    assert got[100] == "context:22:38" and got[101] == ""


def test_pii_contexts_find_short_spaced_and_at_sign_identifiers(spark):
    texts = [f"write to member mail: user{i}@site{i}.example.com for more" for i in range(80)]
    texts += [f"by 2 mail: user{i}@site{i}.example.com for more" for i in range(80)] + [f"mail: user{i}@site{i}.example.com for more" for i in range(80)]
    new = {"write to member mail: AB-1234 x": "AB-1234", "write to member mail: user@intranet x": "user@intranet", "write to member mail: 555 123 4567 x": "555 123 4567",
           "by 7 mail: 1234567 x": "1234567", "mail: 4412-77 x": "4412-77", "the year 1234567 was 12 fine": None, "write to member mail: @ x": None}
    docs = spark.createDataFrame(list(enumerate([*texts, *new])), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.op8_pii(docs).collect()}
    for i, (text, part) in enumerate(new.items()):
        at = text.find(part) if part else 0
        assert got[len(texts) + i] == (f"context:{at}:{at + len(part)}" if part else "")


def test_near_dedup_against_brute_force(docs, nothing):
    got = near_dedup.op9_near_dedup(docs).collect()
    sets = []
    for r in rows():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    comp = list(range(len(sets)))
    for i, k in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[k])
        if sets[i] and sets[k] and 100 * both >= 80 * (len(sets[i]) + len(sets[k]) - both):
            comp = [min(comp[i], comp[k]) if c in (comp[i], comp[k]) else c for c in comp]
    want = []
    for i, r in enumerate(rows()):
        ids = [rows()[k][0] for k in range(len(sets)) if comp[k] == comp[i] and rows()[k][0] is not None] if sets[i] else [r[0]]
        c = min(ids) if ids else None
        want.append((r[0], len(sets[i]), c, r[0] == c))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert near_dedup.op9_near_dedup(nothing).count() == 0
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len({(w[2] if s else ("own", i, rows()[i][1])) for i, (w, s) in enumerate(zip(want, sets))} | set())


def test_deduplicate_keeps_unlike_texts_of_null_and_repeated_ids(spark):
    t = [prose(80, 900 + i) for i in range(6)]
    near = t[0] + " tail"
    rs = [(None, t[0]), (None, near), (None, t[1]), (None, t[2]), (None, ""), (None, " "), (None, None), (4, t[3]), (4, t[4]), (4, t[4]), (4, ""), (9, t[4]), (5, ""), (None, t[5]), (8, t[5])]
    kept = sorted(map(str, near_dedup.deduplicate(spark.createDataFrame(rs, "doc_id long, text string").repartition(3)).collect()))
    names = [(r, str(spark.createDataFrame([r], "doc_id long, text string").first())) for r in rs]
    got = [r for r, name in names for k in kept if k == name]
    for must in [(None, t[1]), (None, t[2]), (None, " "), (4, t[3]), (4, t[4]), (4, ""), (5, ""), (8, t[5])]:
        assert must in got
    assert len(kept) == 10 and sum(k in (names[0][1], names[1][1]) for k in kept) == 1
    assert (9, t[4]) not in got and (None, t[5]) not in got


def test_near_dedup_residual_links_two_stars(spark, monkeypatch):
    base = prose(200, 30).split()
    rs = []
    for i in range(40):  # each copy differs from the next by a little and from far ones by a lot
        w = list(base)
        for k in range(0, i):
            w[(k * 4 + 3) % 200] = f"e{k}"
        rs.append((i, " ".join(w)))
    df = spark.createDataFrame(rs, "doc_id long, text string")
    assert {r.component_id for r in near_dedup.op9_near_dedup(df).collect()} == {0}
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    assert {r.component_id for r in near_dedup.op9_near_dedup(df).collect()} == {0}


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    a, b = h[:3000], h[1000:4000]
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    assert (np.maximum(ra, rb) == near_dedup.registers(np.concatenate([a, b]))).all()
    est = near_dedup.likelihood_similarity((ra > rb).sum()[None], (ra < rb).sum()[None], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(est - 0.5) < 0.15


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    v = [(i, (centres[i % 12] + rng.normal(size=16) * 0.18).astype(np.float32).tolist(), int(i % 3) if i % 17 else None) for i in range(400)]
    v += [(500, v[1][1], v[1][2]), (501, [x * 2 for x in v[1][1]], v[1][2]), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] * 16, 1), (505, [None] * 16, 1), (506, [1.0, 2.0], 1), (507, [], 1), (508, [float("inf")] * 16, 1), (1, v[1][1], v[1][2])]
    df = spark.createDataFrame([(*r, "extra", 3) for r in v], "vec_id long, embedding array<float>, label int, node string, n_links int").repartition(3)
    ok = [i for i, r in enumerate(v) if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    comp, links = list(range(len(v))), [0] * len(v)
    for i, k in itertools.combinations(ok, 2):
        a, b = np.array(v[i][1], float), np.array(v[k][1], float)
        if v[i][2] == v[k][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
            links[i] += 1
            links[k] += 1
            comp = [min(comp[i], comp[k]) if c in (comp[i], comp[k]) else c for c in comp]
    want = collections.Counter()
    for i, r in enumerate(v):
        c = min(v[k][0] for k in range(len(v)) if comp[k] == comp[i])
        want[(r[0], links[i], c, r[0] == c)] += 1
    assert collections.Counter(map(tuple, embeddings.op10_embedding_dedup(df).collect())) == want
    monkeypatch.setattr(embeddings, "PART", 20)
    assert collections.Counter(map(tuple, embeddings.op10_embedding_dedup(df).collect())) == want
    assert embeddings.op10_embedding_dedup(df.limit(0)).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (3, 1)] + [(100 + i, 101 + i) for i in range(30)], "a long, b long")
    got = {r.node: r.comp for r in components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(31)}
    assert components(e.limit(0)).count() == 0
