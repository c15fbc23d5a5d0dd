"""The bootstrap of personal data against plain Python, and long texts."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidepanel.llm import pii

from .test_llm import prose

TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])(?:" + r"(?:[^\x20\x09-\x0DA-Za-z@0-9]*[0-9][^\x20\x09-\x0DA-Za-z@]*(?![^\x20\x09-\x0D]))(?:\x20[^\x20\x09-\x0DA-Za-z@0-9]*[0-9][^\x20\x09-\x0DA-Za-z@]*(?![^\x20\x09-\x0D]))*" + r"|[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*)")


def plain_instances(i, text, base):
    """(doc, s, e, patterns, touches, seed) of ASCII texts."""
    out, matches = [], list(TOKEN.finditer(text))
    for k, m in enumerate(matches):
        core = re.search(r"(?s)[0-9A-Za-z@](?:.*[0-9A-Za-z])?", m[0])
        if core[0] == "@":
            continue
        before = re.findall(r"[^\x20\x09-\x0D]+", text[: m.start()])[-2:]
        a, b = (["^", "^"] + before)[-2:]
        gap = text[m.end() : matches[k + 1].start() if k + 1 < len(matches) else len(text)]
        c = (re.findall(r"[^\x20\x09-\x0D]+", gap) or ["^"])[0]
        a, b, c = (re.sub("[0-9]+", "9", w.lower()) for w in (a, b, c))
        shape = re.sub("[0-9]", "9", re.sub("[A-Za-z]+", "a", core[0]))
        patterns = [f"2 {a} {b}", *[f"1 {b}"] * (b != "^"), *[f"n {c}"] * (c != "^"), f"s {shape}"]
        s, e = m.start() + core.start(), m.start() + core.end()
        touches = any(x < e and y > s for x, y in base)
        key = re.fullmatch("[0-9A-Fa-f]{32,}", core[0]) and re.search("[0-9]", core[0]) and re.search("[A-Fa-f]", core[0])
        out.append(((i, s, e), patterns, touches, bool(touches or key)))
    return out


def plain_bootstrap(instances, rounds=4, accept=800_000, support=3):
    sure = {k: seed for k, _, _, seed in instances}
    found = set()
    for _ in range(rounds):
        n, t = Counter(), Counter()
        for k, ps, _, _ in instances:
            for p in ps:
                n[p] += 1
                t[p] += sure[k]
        score = {p: t[p] * 1_000_000 // (n[p] + 1) for p in n if t[p] >= support}
        now = set()
        for k, ps, _, _ in instances:
            lack = 1_000_000
            for p in sorted(score[p] for p in ps if p in score):
                lack = lack * (1_000_000 - p) // 1_000_000
            if 1_000_000 - lack >= accept and any(p in score for p in ps):
                now.add(k)
        same = len(now) == len(found)
        found = now
        if same:
            break
        sure = {k: seed or k in found for k, _, _, seed in instances}
    return found


def texts():
    out = [f"write to member mail: user{i}@site{i % 7}.example.com for more" for i in range(20)]
    out += [f'{prose(3, i)} token = "{i:02d}ab{i * 7919:036x}" {prose(2, i + 50)}' for i in range(8)]
    out += ['so token = "short-77" it is', "call member mail: 88-12 today", "the badge 88-12 today", "code 88-12 today", "room 99-13 today", "room 99-14 tonight", "year 1999 and 2001", "ip 10.0.0.1 2 3 +1 (017) 555-7713, @ x"]
    out += [f"room {i}{i}-1{i} today" for i in range(1, 6)] + ["", "7"]
    return out


def test_bootstrap_against_plain_python(spark):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.op8_pii(df).collect()}
    instances = []
    for i, t in docs:
        base = [(int(x.split(":")[1]), int(x.split(":")[2])) for x in got[i].spans.split(",") if x and not x.startswith("context")]
        instances += plain_instances(i, t, base)
    found = plain_bootstrap(instances)
    want = defaultdict(set)
    for k, _, touches, _ in instances:
        if k in found and not touches:
            want[k[0]].add(f"context:{k[1]}:{k[2]}")
    assert {i: {x for x in r.spans.split(",") if x.startswith("context")} for i, r in got.items()} == {i: want[i] for i, _ in docs}
    said = {t[k[1] : k[2]] for i, t in docs for k, *_ in instances if k in found and k[0] == i}
    assert "short-77" in said and "1999" not in said and sum(len(x) == 40 for x in said) == 8


def test_found_identifiers_vouch_for_further_patterns(spark):
    # "member mail:" has seeds; what it finds shares a shape with others whose contexts have none
    rows = [f"member mail: u{i}@s{i}.example.com" for i in range(40)] + [f"member mail: {i % 9}-{i % 9}{i % 9}-x" for i in range(20)] + [f"nothing {c} 7-77-x" for c in "pqr"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    seen = pii.context_instances(df.select(F.col("doc_id").alias("rid"), F.col("text").alias("t"), *pii.base_spans(F.col("text"))))
    one, more = ({r.rid for r in pii.bootstrap(seen, rounds=k).collect()} for k in (1, 4))
    assert set(range(40, 60)) <= one and not one & {60, 61, 62} and {60, 61, 62} <= more


def test_a_text_of_very_many_matches(spark):
    n = 12_000
    text = "é " + " ".join(f"a{i}@b.de 7x" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.op8_pii(df).first()
    assert r.n_email == n and r.spans.startswith("email:2:9,") and r.spans.count(":") == 2 * n
    clean = pii.redact(df.select("doc_id", "text")).first().text
    assert clean == "é " + " ".join(["[EMAIL] 7x"] * n)
