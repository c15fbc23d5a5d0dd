"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped contexts.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, without

# Possessive forms of the contract's patterns: the same leftmost matches in linear time and constant stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")
NUMBER = r"[^\x20\x09-\x0D\p{L}@0-9]*+[0-9][^\x20\x09-\x0D\p{L}@]*+(?![^\x20\x09-\x0D])"
TOKEN = rf"(?<![^\x20\x09-\x0D])(?:{NUMBER}(?:\x20{NUMBER})*+|[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*+)"
SOLID, BLANK = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
TOKENS = "struct<s:int,e:int,m:string,a:string,b:string,c:string>"
BLOCK = 512  # matches that are gathered at once
CHUNK = 4096  # code points of a text that a span is looked up in
SPAN = "array<struct<s:int,k:int,e:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _in_blocks(items: Column, start: Column, none: Column, step: Callable[[Column, Column], tuple[Column, Column]], block: int = BLOCK) -> Column:
    """The outputs of ``step`` over ``items``: (state, item) -> (state, array of outputs), with ``start`` and ``none`` as first state and no outputs.

    An array that grows is copied at every step, so outputs are gathered in blocks: n items cost n * ``block`` + (n / ``block``) ** 2 copies of
    a reference, not n ** 2.
    """
    def one(z: Column, x: Column) -> Column:
        state, out = step(z["state"], x)
        return F.struct(state.alias("state"), F.concat(z["out"], out).alias("out"))

    def many(z: Column, xs: Column) -> Column:
        return F.aggregate(xs, F.struct(z["state"].alias("state"), none.alias("out")), one, lambda d: F.struct(d["state"].alias("state"), F.concat(z["outs"], F.array(d["out"])).alias("outs")))

    def all_of(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int")), lambda k: F.slice(items, k * block + 1, F.lit(block)))
        first = F.struct(start.alias("state"), F.slice(F.array(none), 1, 0).alias("outs"))
        return F.when(F.size(items) > 0, F.aggregate(blocks, first, many, lambda z: F.flatten(z["outs"]))).otherwise(none)

    return _let(items, all_of)


def _matches(text: Column, pattern: str, words: bool = False) -> Column:
    """array<struct<s, e, m, a, b, c>> of the leftmost non-overlapping matches; if asked for, a and b are the two words before one and c that after it.

    Words of earlier matches count, however far back; a word that the text's ends leave out is empty, and so is c where the
    next match comes first.
    """
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cut = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("gap"), found.alias("m"), F.slice(parts, 2, F.size(found)).alias("next"))
    none = F.array().cast(f"array<{TOKENS}>")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("a"), F.lit("").alias("b"))

    def last(a: Column, b: Column, more: Column) -> tuple[Column, Column]:
        """The last two words of a, b and the words of ``more``, which is read from its end."""
        back = F.reverse(more)
        y = F.reverse(F.regexp_extract(back, rf"^{BLANK}*+({SOLID}++)", 1))
        x = F.reverse(F.regexp_extract(back, rf"^{BLANK}*+{SOLID}++{BLANK}++({SOLID}++)", 1))
        return F.when(y == "", a).when(x == "", b).otherwise(x), F.when(y == "", b).otherwise(y)

    def step(z: Column, x: Column) -> tuple[Column, Column]:
        s = z["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        a, b = last(z["a"], z["b"], x["gap"]) if words else (F.lit(""), F.lit(""))
        c, d = last(a, b, x["m"]) if words else (a, b)
        after = F.regexp_extract(x["next"], rf"^{BLANK}*+({SOLID}++)", 1) if words else F.lit("")
        fresh = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), a.alias("a"), b.alias("b"), after.alias("c"))
        return F.struct(e.alias("at"), c.alias("a"), d.alias("b")), F.array(fresh)

    return F.when(text.rlike(pattern), _in_blocks(cut, start, none, step)).otherwise(none)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]+", "")
    if kind == "ip":
        return m.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> list[Column]:
    """One array of spans (s, k, e) for each kind, in code points, end exclusive."""
    out = []
    for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        need = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else F.lit(True)
        out.append(F.when(need, _spans(text, pattern, kind, k)).otherwise(F.array().cast(SPAN)).alias(kind))
    return out


def _spans(text: Column, pattern: str, kind: str, k: int) -> Column:
    found = F.filter(_matches(text, pattern), lambda x: _valid(kind, x["m"]))
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(names, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def _name(kind: str, what: Column) -> Column:
    """A pattern's name: its kind and words, these as a digest where they are long."""
    return F.concat(F.lit(f"{kind} "), F.when(F.length(what) > 64, F.md5(what.cast("binary"))).otherwise(what))


def _touching(tokens: Column, base: Column) -> Column:
    """``tokens`` with until, the furthest end of a base span that starts before the token's end: one pass over both in order."""
    spans = F.transform(base, lambda x: F.struct(x["s"].alias("at"), F.lit(1).alias("kind"), x["e"].alias("end"), F.lit(None).cast(TOKENS).alias("x")))
    marks = F.transform(tokens, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("end"), x.alias("x")))
    none = F.array().cast(f"array<{TOKENS[:-1]},until:int>>")

    def step(until: Column, y: Column) -> tuple[Column, Column]:
        x = y["x"]
        told = F.struct(*[x[f].alias(f) for f in ("s", "e", "m", "a", "b", "c")], until.alias("until"))
        return F.greatest(until, y["end"]), F.when(y["kind"] == 0, F.array(told)).otherwise(none)

    return F.when(F.size(tokens) > 0, _in_blocks(F.array_sort(F.concat(spans, marks)), F.lit(0), none, step)).otherwise(none)


def context_instances(docs: DataFrame) -> DataFrame:
    """(rid, s, e, patterns, touches, seed) of each token with a digit or an at sign; a lone at sign is none.

    Number tokens (a digit, no letter or at sign) with one blank between them are one instance.  Its patterns are the two words
    before it ("2"), the one before it ("1"), the one after it ("n"), all lower-cased, digit runs as 9, with ^ for a word that the text's end leaves
    out (a lone ^ is no pattern), and its shape ("s"), letter runs as a and each digit as 9.  An instance that touches a base span is a seed, and
    so is a key of 32 or more hexadecimal digits, some of them letters.
    """
    base = F.concat(*[F.col(k) for k in KINDS])
    rows = docs.select("rid", F.explode(_touching(_matches(F.col("t"), TOKEN, words=True), base)).alias("x"))
    a, b, c = (F.when(w == "", "^").otherwise(w) for w in (F.regexp_replace(F.lower(f"x.{k}"), "[0-9]+", "9") for k in "abc"))
    lead = F.length(F.regexp_extract("x.m", r"^[^0-9A-Za-z@]*", 0))
    core = F.regexp_extract("x.m", r"(?s)[0-9A-Za-z@](?:.*[0-9A-Za-z])?", 0)
    shape = F.regexp_replace(F.regexp_replace(core, "[A-Za-z]+", "a"), "[0-9]", "9")
    patterns = F.array(_name("2", F.concat_ws(" ", a, b)), F.when(b != "^", _name("1", b)), F.when(c != "^", _name("n", c)), _name("s", shape))
    rows = rows.select("rid", "x.until", (F.col("x.s") + lead).alias("s"), (F.col("x.s") + lead + F.length(core)).alias("e"), core.alias("core"), F.array_compact(patterns).alias("patterns")).where("core <> '@'")
    touches = F.col("until") > F.col("s")
    seed = touches | F.col("core").rlike(r"^(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}$")
    return rows.select("rid", "s", "e", "patterns", touches.alias("touches"), seed.alias("seed"))


def bootstrap(instances: DataFrame, rounds: int = 4, accept: float = 0.8, support: int = 3) -> DataFrame:
    """(rid, s, e) of the instances that patterns discover, seeds among them.

    In each round a pattern scores the share of trusted ones among its instances (one more that isn't is added), if at least
    ``support`` are; an instance scores 1 less the product of what its patterns lack, and is trusted from the next round on
    if that reaches ``accept``.  At first the seeds are trusted.  So found identifiers vouch for further
    patterns, and patterns that also stand before other tokens lose by them.  Scores are whole millionths, so nothing depends on the
    order of addition.  Ends after ``rounds``, or when a round finds nothing.  Patterns of very many instances are counted before they
    are shuffled.
    """
    edges = materialize(instances.select("rid", "s", "e", "seed", F.explode("patterns").alias("pattern")))
    trusted, found = edges.select("rid", "s", "e", "pattern", F.col("seed").alias("sure")), None
    whole = F.lit(1_000_000)
    for _ in range(rounds):
        score = trusted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("sure").cast("long")).alias("sure"))
        score = score.where(F.col("sure") >= support).select("pattern", F.floor(F.col("sure") * whole / (F.col("n") + 1)).cast("long").alias("p"))
        voices = edges.select("rid", "s", "e", "pattern").join(score, "pattern").groupBy("rid", "s", "e").agg(F.sort_array(F.collect_list("p")).alias("ps"))  # four at most
        lack = F.aggregate("ps", whole.cast("long"), lambda z, p: F.floor(z * (whole - p) / whole).cast("long"))
        now = materialize(voices.where(whole - lack >= int(accept * 1_000_000)).select("rid", "s", "e", F.lit(True).alias("hit")))
        known = -1 if found is None else found.count()
        if found is not None:
            release(found)
        found = now
        if found.count() == known:
            break
        trusted = edges.join(found, ["rid", "s", "e"], "left").select("rid", "s", "e", "pattern", (F.col("seed") | F.coalesce("hit", F.lit(False))).alias("sure"))
    release(edges)
    return found


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with email, ip, card, phone (base spans of each kind) and context (spans that discovered patterns add).

    Spans are struct(s, k, e): start, kind's number, end, in code points.  Null text has no spans; rows equal in
    id and text have the same, and ids may be null or repeated.  Columns of these names are replaced, all others pass
    through, whatever their names.  Whole texts are read; one is a row in a task, whose time grows with its length (beside a term of
    its matches' square by 512 squared).  An empty table gives no rows.
    """
    docs = without(docs, *KINDS, "context")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(id_col), text).alias("rid"), text.alias("t"))
    based = keyed.select("*", *base_spans(F.col("t")))
    seen = materialize(context_instances(based.select("rid", "t", *KINDS)).distinct())
    found = bootstrap(seen)
    # what touches a base span is known already
    new = found.join(seen.where("touches").select("rid", "s", "e"), ["rid", "s", "e"], "left_anti")
    new = materialize(new.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("s", F.lit(len(KINDS)).alias("k"), "e"))).alias("context")))
    release(seen, found)
    return based.join(new, "rid", "left").select("row.*", *KINDS, F.coalesce("context", F.array().cast(SPAN)).alias("context"))


def mask(text: Column, spans: Column) -> Column:
    """``text`` with every span's characters replaced by its kind in brackets; overlapping spans give one.

    The text is cut into chunks first, since finding a place in a string means reading it up to there.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "id")])
    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))

    def part(chunks: Column, a: Column, b: Column) -> Column:
        """Code points a to b, b excluded and over a."""
        i, k = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
        first, last = F.element_at(chunks, i + 1), F.element_at(chunks, k + 1)
        apart = F.concat(F.substring(first, a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(k - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), b - k * CHUNK))
        return F.when(i == k, F.substring(first, a % CHUNK + 1, b - a)).otherwise(apart)

    def masked(x: Column) -> Column:
        def step(at: Column, y: Column) -> tuple[Column, Column]:
            before = F.when(y["s"] > at, F.concat(part(x["chunks"], at, y["s"]), F.element_at(names, y["k"] + 1))).otherwise(F.element_at(names, y["k"] + 1))
            return F.greatest(at, y["e"]), F.when(y["s"] >= at, F.array(before)).otherwise(F.array().cast("array<string>"))

        end = F.array_max(F.transform(x["spans"], lambda y: y["e"]))
        rest = F.when(end < x["n"], part(x["chunks"], end, x["n"])).otherwise("")
        return F.concat(F.array_join(_in_blocks(x["spans"], F.lit(0), F.array().cast("array<string>"), step), ""), rest)

    # one struct, so that chunks are cut once
    held = F.array(F.struct(chunks.alias("chunks"), spans.alias("spans"), F.length(text).alias("n")))
    return F.when(F.size(spans) > 0, F.transform(held, masked)[0]).otherwise(text)


def all_spans() -> Column:
    return F.sort_array(F.concat(*[F.col(k) for k in (*KINDS, "context")]))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, same columns, with personal data masked in ``text`` (and n_chars of the new text).

    Edge cases as in :func:`find_pii`; a null text stays null.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    found = find_pii(docs.select("doc_id", "text", F.struct(*rest).alias("row")))
    found = found.select("row", "text", all_spans().alias("spans")).select("row", F.size("spans").alias("hits"), mask(F.col("text"), F.col("spans")).alias("text"))

    def out(c: str) -> Column:
        old = F.col("row")[c]
        if c == "text":
            return F.col("text")
        return F.when(F.col("hits") > 0, F.length("text")).otherwise(old).cast("long").alias(c) if c == "n_chars" else old.alias(c)

    return found.select(*[out(c) for c in docs.columns])


def op8_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each base kind, digest of the base spans and all spans (see :func:`find_pii`) of every document."""
    found = find_pii(docs.select("doc_id", "text"))
    base = F.sort_array(F.concat(*[F.col(k) for k in KINDS]))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(all_spans()).alias("spans"))
