"""Former limits, hot keys, clashing column names and very long texts of the corpus operators; brute force where SQL has no say."""

import collections
import glob
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidepanel.llm import classifier, common, embeddings, mixing, near_dedup, packing, pii, sharding, substrings, warc

from .test_llm import WORD, labelled, prose, slow_best_fit

HELPERS = ["hash", "bucket", "many", "start", "first", "at", "number", "place", "row", "times", "size", "skey", "key", "range", "before", "offset", "by_text", "busy", "copies", "copy", "rid", "__rid", "__s", "__hash", "__m", "t", "scored", "h1", "h2", "n", "base", "hits", "spans", "cut", "node", "m", "target", "epochs", "rest", "source_size", "x"]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"v_{h}").alias(h) for h in HELPERS])


def intact(rows):
    return all(r[h] == f"v_{h}" for r in rows for h in HELPERS)


def test_extra_columns_of_any_name_pass_through(spark):
    rows = labelled(60)
    df = clashing(spark, rows)
    lab = spark.createDataFrame([(r[0], int(r[0] < 60), 0) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    for out, n in ((sharding.assign_shards(df, 4), 120), (classifier.classify(df, lab, rounds=1), 120), (near_dedup.deduplicate(df), None), (pii.redact(df), 120), (mixing.mix_documents(df), None)):
        got = out.collect()
        assert intact(got) and len(got) == (n or len(got)) > 0 and set(df.columns) <= set(out.columns)
    assert packing.op5_packing(df).count() == packing.op5_packing(df.select("doc_id", "text", "source")).count()


def test_unlike_documents_of_null_and_repeated_ids_all_stay(spark):
    rows = [(None if i < 4 else 7, prose(50, 4000 + i), "en", "s", 1) for i in range(8)]
    assert near_dedup.deduplicate(clashing(spark, rows)).count() == 8


def spark_hash(*values):
    """Spark's xxhash64 of ints (kind i), longs (q) and strings: each value's hash seeds the next; nulls are passed over."""
    h = 42
    for kind, v in values:
        if v is not None:
            raw = v.encode() if kind == "s" else struct.pack(f"<{kind}", v)
            h = xxhash.xxh64(raw, seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute_place(x, n, seed):
    left = max(1, int(np.sqrt(n - 1)) + 1) if n > 1 else 1
    left = next(k for k in range(1, n + 2) if k * k >= n)
    right = -(-n // left)
    while True:
        l, r = divmod(x, right)
        for k in range(4):
            if k % 2 == 0:
                l = (l + spark_hash(("i", seed + k), ("q", r)) % left) % left
            else:
                r = (r + spark_hash(("i", seed + k), ("q", l)) % right) % right
        x = l * right + r
        if x < n:
            return x


def test_sharding_against_brute_force(spark):
    rows = [(i if i % 7 else None, prose(3, i % 40)) for i in range(300)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 16, seed=7).collect()
    order = sorted(rows, key=lambda r: (spark_hash(("q", r[0]), ("s", r[1])) % 256, spark_hash(("q", r[0]), ("s", r[1]))))
    places = [brute_place(i, 300, 7) for i in range(300)]
    want = collections.Counter((*r, p % 16, p // 16) for r, p in zip(order, places))
    assert collections.Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == want


def test_suffix_sorting_against_brute_force():
    r = random.Random(5)
    for _ in range(12):
        core = bytes(r.choice(b"ab\0") for _ in range(r.choice([300, 420, 700])))
        segs, offs, names = [], [], []
        for bucket in range(3):
            for _ in range(r.choice([2, 5, 40])):  # ties in groups below and above 8
                off = r.randint(0, 300)
                n = r.randint(1, min(off + 1, 300)) + 399
                body = bytearray((core * 5)[(1000 - off) % len(core) :][:n])
                for _ in range(r.choice([0, 0, 1, 2])):
                    body[r.randrange(n)] = r.choice(b"xyz")
                segs.append(bytes(body)), offs.append(off), names.append(bucket)
        hit, seg = substrings.repeated_suffixes(segs, offs, np.array(names))
        keys = [(b, o - k, s[k : k + 400]) for s, o, b in zip(segs, offs, names) for k in range(len(s) - 399)]
        count = collections.Counter(keys)
        assert hit.tolist() == [count[k] > 1 for k in keys] and len(seg) == len(keys)


def test_cover_holds_every_difference():
    assert {(a - b) % substrings.MODULUS for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.MODULUS))


def brute_removed(texts):
    data = [t.encode() for t in texts]
    seen = collections.Counter(t[i : i + 400] for t in data for i in range(len(t) - 399))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        out.append(int(gone.sum()))
    return out


@pytest.mark.parametrize("hot", [1, 2048])
def test_substrings_across_slices(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "SLICE", 3000)
    monkeypatch.setattr(substrings, "HOT", hot)
    shared = prose(150, 77)
    texts = [prose(500, i) + f" {shared} é{'x' * i} " + prose(450, 50 + i) for i in range(6)] + ["y" * 9000]
    got = {r.doc_id: r.n_removed for r in substrings.op2_substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)


def test_planted_passages_go_from_400_bytes_on(spark):
    r = random.Random(9)
    passage = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    long, short = passage(58), passage(52)  # 405 and 363 bytes, both of over 50 words
    texts = [f"{prose(300, 2 * i)} A{i}{p}{i}Z {prose(200, 2 * i + 1)}" for i, p in enumerate([long, long, short, short, passage(55)])]
    got = {d.doc_id: (d.n_bytes, d.n_removed) for d in substrings.op2_substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (len(t.encode()), [405, 405, 0, 0, 0][i]) for i, t in enumerate(texts)}
    assert [got[i][1] for i in range(5)] == brute_removed(texts)


def test_a_text_longer_than_a_slice(spark):
    long = "".join(random.Random(1).choices("abcdefghijklmnop ", k=(1 << 22) + 300_000))
    part = long[(1 << 22) - 500 : (1 << 22) + 500]  # over the border between two slices
    got = {r.doc_id: r.n_removed for r in substrings.op2_substring_dedup(spark.createDataFrame([(1, long), (2, "q" * 10 + part)], "doc_id long, text string")).collect()}
    assert got == {1: 1000, 2: 1000}
    assert [r.n_shingles for r in near_dedup.op9_near_dedup(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()] == [len(long.split()) - 3]
    assert pii.op8_pii(spark.createDataFrame([(1, long + " me@here.org")], "doc_id long, text string")).first().spans == f"email:{len(long) + 1}:{len(long) + 12}"


def test_mixing_of_ids_and_rows_repeated_without_end(spark):
    rows = [(None, prose(3 + i % 5, i), "s0") for i in range(300)] + [(5, "one two three", "s1")] * 200 + [(i, prose(6, i), "s2") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.plan_mix(df, often=20).select("row.*", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"))
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    for s in ("s0", "s1", "s2"):
        mine = [r for r in got if r.source == s]
        assert sum(r["size"] for r in mine) == mine[0].source_size and abs(sum(r.taken for r in mine) - mine[0].target) < 1.001
    again = mixing.plan_mix(df.repartition(7), often=20).select("row.*", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_folded_rows_keep_their_count(spark):
    df = spark.createDataFrame([(1, None)] * 50 + [(2, "b")] * 3 + [(None, None)] * 40, "a long, b string")
    got = sorted((str(r.row), r.times) for r in common.folded(df, 10).collect())
    assert got == sorted([("Row(a=1, b=None)", 50), ("Row(a=None, b=None)", 40)] + [("Row(a=2, b='b')", 1)] * 3)


def test_packing_keeps_its_constraints(spark):
    rows = [(i % 50 if i % 9 else None, prose(5 + i % 40, i % 60), f"s{i % 3}") for i in range(400)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), capacity=100).collect()
    source = {(r[0], r[1]): r[2] for r in rows}
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
    for b in bins.values():
        assert sum(r.n_words for r in b) <= 100 and sorted(r.slot for r in b) == list(range(len(b)))
        assert len({r.text.lower() for r in b}) == len(b) and len([r for r in b if r.doc_id is not None]) == len({r.doc_id for r in b if r.doc_id is not None})
        at = 0
        for r in sorted(b, key=lambda r: r.slot):
            assert r.offset == at
            at += r.n_words
    # one group, so the whole table is one best fit: largest first, ties by id, text hash and piece
    ids = sorted({r[0] for r in rows if r[0] is not None})
    texts = sorted({r[1] for r in rows})
    items = sorted(((-len(r[1].split()), -1 if r[0] is None else r[0], spark_hash(("s", r[1]))), r) for r in rows)
    want, bins = [], []
    for (neg, *_), r in items:
        ok = [(100 - sum(x[0] for x in b), k) for k, b in enumerate(bins) if 100 - sum(x[0] for x in b) >= -neg and all(r[1] != x[1][1] and (r[0] is None or r[0] != x[1][0]) for x in b) and sum(x[1][2] == r[2] for x in b) < 2]
        k = min(ok)[1] if ok else len(bins)
        if not ok:
            bins.append([])
        bins[k].append((-neg, r))
    sizes = collections.Counter(tuple(sorted(x[0] for x in b)) for b in bins)
    real = collections.defaultdict(list)
    for r in out:
        real[r.bin_id].append(r.n_words)
    assert collections.Counter(tuple(sorted(b)) for b in real.values()) == sizes and len(ids) and len(texts) and len(source)


def test_packing_deals_a_row_repeated_without_end(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 512)
    df = spark.range(6000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    out = packing.op5_packing(df)
    groups = out.groupBy(F.split("bin_id", "-")[0]).count().collect()
    assert out.count() == 6000 and len(groups) > 6 and out.select("bin_id").distinct().count() == 6000


def test_pii_contexts_have_no_reach_and_shapes_no_length(spark):
    texts = [f"write to member mail: user{i}@site{i}.example.com for more" for i in range(40)]
    code = "-".join(f"{k:02d}x" for k in range(60))
    long = ["write to member mail:" + " " * 500 + "88-4412-77x end", f"write to member mail: {code} end", "in 2020 mail: 4411-2 end"]
    texts += [f"in 19{i} mail: user{i}@site{i}.example.com" for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.op8_pii(spark.createDataFrame(list(enumerate([*texts, *long])), "doc_id long, text string")).collect()}
    for k, (text, part) in enumerate(zip(long, ("88-4412-77x", code, "4411-2"))):
        assert got[len(texts) + k] == f"context:{text.find(part)}:{text.find(part) + len(part)}"


@pytest.mark.parametrize(("dim", "n", "rho"), [(8, 100_000, 0.93), (64, 5000, 0.93), (384, 100_000, 0.93), (64, 100_000, 0.7686)])
def test_codes_find_pairs_at_the_threshold(dim, n, rho):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.standard_normal((1000, dim))
    e -= (e * x).sum(axis=1, keepdims=True) * x
    y = rho * x + np.sqrt(1 - rho**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    assert embeddings.Code.plan(dim, n, rho).misses(x, y) <= 0.005


@pytest.mark.parametrize("common_part", [0.0, 1.2, 2.5])
def test_embedding_recall_with_a_common_direction(spark, common_part):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((1500, 24)) / np.sqrt(24)
    v[750:] = v[:750] + rng.standard_normal((750, 24)) * 0.08
    v += common_part * np.eye(24)[0]
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.93).sum(axis=1) - 1).sum()
    got = embeddings.near_duplicate_vectors(spark.createDataFrame([(i, x.astype(np.float32).tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int"))
    assert want * 0.99 <= got.agg(F.sum("n_links")).first()[0] <= want


def members(path):
    return [m for f in glob.glob(f"{path}/part-*") for m in warc.unzip(open(f, "rb").read())]


@pytest.mark.parametrize("few", [0, 100_000])
def test_warc_records_are_members_and_large_ones_too(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW", few)
    monkeypatch.setattr(warc, "MOST_BITS", 1 << 6)  # a filter that holds much wrongly
    monkeypatch.setattr(warc, "_bloom", lambda keys, n, real=warc._bloom: real(keys, n))
    big = "z" * (17 << 20)
    rs = [(i, None, f"page {i % 40}") for i in range(100)] + [(200, "u", big), (201, "u", big)]
    warc.deduplicate_pages(spark.createDataFrame(rs, "page_id long, url string, html string").repartition(3), f"{tmp_path}/w{few}")
    found = [m for m in members(f"{tmp_path}/w{few}") if m]
    assert len(found) == len(rs) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in found)
    read = warc.restored(warc.read_archive(spark, f"{tmp_path}/w{few}")).collect()
    top = {f"page {k}": max(i for i in range(100) if i % 40 == k) for k in range(40)} | {big: 201}
    want = sorted((i, len(h), "response" if top[h] == i else "revisit", None if top[h] == i else top[h]) for i, _, h in rs)
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in read) == want


def plain_co_training(x, y, held, pool, rounds, sure):
    """Co-training as the textbook has it: pseudo-labelled rows are appended with a weight, and each view is fitted anew."""
    def fit(a, t, weight):
        a = np.hstack([a.astype(float), np.ones((len(a), 1))])
        penalty = np.r_[np.ones(a.shape[1] - 1), 1e-6]
        total = weight.sum()
        share = weight * np.where(t == 1, 0.5 * total / weight[t == 1].sum(), 0.5 * total / weight[t == 0].sum())
        w = np.zeros(a.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w -= np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (share * (p - t)) + penalty * w)
        return w

    def p_of(a, w):
        return 1 / (1 + np.exp(-np.clip(a.astype(float) @ w[:-1] + w[-1], -30, 30)))

    t, keep = y[~held], [a[~held] for a in x]
    w = [fit(a, t, np.ones(len(t))) for a in keep]
    given = [np.full(len(pool[0]), np.nan) for _ in range(2)]
    for _ in range(rounds):
        for v in range(2):
            p = p_of(pool[1 - v], w[1 - v])
            given[v] = np.where(np.isnan(given[v]), np.where(p >= sure, 1.0, np.where(p <= 1 - sure, 0.0, np.nan)), given[v])
        w = []
        for v in range(2):
            known = ~np.isnan(given[v])
            trust = min(1.0, len(t) / max(known.sum(), 1))
            w.append(fit(np.vstack([keep[v], pool[v][known]]), np.r_[t, given[v][known]], np.r_[np.ones(len(t)), np.full(known.sum(), trust)]))
    return w


def test_co_training_against_the_textbook():
    rng = np.random.default_rng(9)
    y = (rng.random(900) < 0.4).astype(float)
    x = [np.float32(y[:, None] * 3 + rng.normal(size=(900, 3))) for _ in range(2)]
    held = np.arange(200) % 4 == 0
    m = classifier.co_train(x[0][:200], x[1][:200], y[:200], held, x[0][200:], x[1][200:], 2, 0.9)
    want = plain_co_training([a[:200] for a in x], y[:200], held, [a[200:] for a in x], 2, 0.9)
    assert np.allclose(m.content, want[0], atol=5e-3) and np.allclose(m.meta, want[1], atol=5e-3)


def test_one_row_of_a_repeated_id_trains(spark, monkeypatch):
    rows = labelled(40)
    df = spark.createDataFrame(rows + [(1, f"{prose(30, k)}", "en", "s1", 1) for k in range(500)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    lab = spark.createDataFrame([(r[0], int(r[0] < 40), 0) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(classifier, "co_train_by_sums", lambda xc, *rest: seen.append(xc))
    classifier.train(df, lab)
    classifier.train(df.repartition(3), lab)
    assert len(seen[0]) == 40 and (seen[0] == seen[1]).all()


def test_state_is_deleted(spark, tmp_path):
    path = common.scratch(spark, "x")
    df = common.materialize(spark.range(5))
    assert glob.glob(df.scratch_path)
    common.release(df)
    assert not glob.glob(df.scratch_path) and path
