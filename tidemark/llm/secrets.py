"""Secrets in texts: fixed patterns, and random strings told from ordinary identifiers by character Markov models.

Two models of character pairs are trained on labelled samples: random strings, and ordinary identifiers. A candidate
string is a secret if the log-likelihood ratio speaks for the random model clearly enough. Everything that touches a
text is a built-in SQL function of its row: no shuffle and no Python. The places of matches are sums of the lengths of
what a pattern finds and what it leaves, summed up in blocks so that a text may hold very many.
"""

from __future__ import annotations

import functools
import math
import random
import string
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import unused

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of these are maximal, so a least length in the pattern finds what dropping shorter matches would leave.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Strings that the Markov models judge: of identifier characters, perhaps padded, with a letter and a digit.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
#: Nats by which the ratio must exceed zero, for each pair of characters.
THRESHOLD = 0.25
SAMPLE, SEED = 4000, 42
#: Spans whose lengths are summed up together, and characters of a text that are cut together.
BLOCK, CHUNK = 256, 1024

#: Words that programs and addresses are named after; the ordinary sample combines them by rule.
NAME_PARTS = """
access account action active add address admin after agent alert archive article asset async auth average backup base
batch before binary block body border branch bucket buffer build button cache callback cancel category center change
channel check child class client close cluster code collection color column command comment commit common component
config connection content context controller copy count create current customer data database date default delete
detail device directory document download driver dynamic element email enable end engine entity error event example
execute export factory field file filter final first format function general group handler header height helper hidden
history image import index info input install instance interface internal invalid invoice item job key language last
layout level library limit link list listener load local location log login main manager map master max member memory
message method metric middle min mode model module monitor name network next node number object offset option order
output owner package page parameter parent partition password path payment pending plugin point policy port position
prefix preview price primary process product profile project property provider proxy public quality quantity query queue
quick quota random range rate read record redirect reference region register release remote render report request
resource response result retry return role root route row rule sample schema scope screen search section secure segment
select sequence server service session setting shared signal simple size source space stage start state static status
storage stream string style subject submit success summary switch symbol sync system table target task template test
text theme thread time title token tool total trace track traffic transaction transfer tree trigger type unique unit
unknown update upload usage user utility valid value variable vector vendor version video view virtual visible volume
wait warning watch weight widget width window wizard word worker wrapper write year zero zone zoom
""".split()


def ordinary_sample(n: int = SAMPLE, seed: int = SEED) -> list[str]:
    """Names as people write them: words in several cases, with counters, years, versions and paths."""
    rng = random.Random(seed)

    def one() -> str:
        words = [rng.choice(NAME_PARTS) for _ in range(rng.randrange(3, 7))]
        style = rng.randrange(6)
        if style == 0:
            name = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 1:
            name = "".join(w.capitalize() for w in words)
        else:
            name = rng.choice("_-/" if style < 5 else "_").join(words)
            name = name.upper() if style == 5 else name
        tail = rng.choice(["", str(rng.randrange(1000)), f"_v{rng.randrange(30)}", f"-{rng.randrange(1990, 2040)}", f"{rng.randrange(1990, 2040)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"/{rng.randrange(100000)}"])
        return name + tail if rng.random() < 0.85 else f"{rng.randrange(100)}{tail}{name}"

    return [one() for _ in range(n)]


def random_sample(n: int = SAMPLE, seed: int = SEED) -> list[str]:
    """Keys as generators make them: evenly drawn characters of the usual alphabets."""
    rng = random.Random(seed + 1)
    letters = string.ascii_letters + string.digits
    sets = ["0123456789abcdef", "0123456789ABCDEF", letters, letters, letters + "+/", letters + "-_", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits]
    return ["".join(rng.choices(rng.choice(sets), k=rng.randrange(20, 65))) for _ in range(n)]


def train(samples: Iterable[str]) -> list[float]:
    """Log-probabilities of each character after each other one, with one added to every count."""
    size = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[1.0] * size for _ in range(size)]
    for text in samples:
        for a, b in zip(text, text[1:], strict=False):
            counts[place[a]][place[b]] += 1
    return [math.log(x / sum(row)) for row in counts for x in row]


@functools.cache
def ratios(seed: int = SEED) -> tuple[float, ...]:
    """Log-likelihood ratios by pair of characters, random over ordinary: one number for each of 67 x 67 pairs."""
    return tuple(a - b for a, b in zip(train(random_sample(seed=seed)), train(ordinary_sample(seed=seed)), strict=True))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for the row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str, group: int, keep: Callable[[Column], Column] | None, kind: int) -> Column:
    """Spans (from, kind, upto, at) of the matches whose group passes `keep`, in code points; the group starts `at`.

    The group ends where its match does.
    """
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
        F.split(text, pattern, -1).alias("gap"),
    )

    def spans(x: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(x["hit"])), lambda i: F.length(F.element_at(x["gap"], i)) + F.length(F.element_at(x["hit"], i)))
        return _let(steps, lambda s: _let(_before(s), lambda b: F.transform(F.sequence(F.lit(1), F.size(x["hit"])), lambda i: one(x, s, b, i))))

    def one(x: Column, s: Column, b: Column, i: Column) -> Column:
        stop = F.element_at(b, ((i - 1) / BLOCK).cast("int") + 1) + _sum(F.slice(s, ((i - 1) / BLOCK).cast("int") * BLOCK + 1, (i - 1) % BLOCK + 1))
        start, at = stop - F.length(F.element_at(x["hit"], i)), stop - F.length(F.element_at(x["part"], i))
        span = F.struct(start.alias("from"), F.lit(kind).alias("kind"), stop.alias("upto"), at.alias("at"))
        return span if keep is None else F.when(keep(F.element_at(x["part"], i)), span)

    held = _let(found, lambda x: F.when(F.size(x["hit"]) > 0, spans(x)))
    return held if keep is None else F.filter(held, lambda x: x.isNotNull())


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _before(steps: Column) -> Column:
    """The sum of all steps before each block of them."""
    last = (F.size(steps) / BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), last), lambda k: _sum(F.slice(steps, k * BLOCK + 1, BLOCK)))
    return _let(sums, lambda s: F.transform(F.sequence(F.lit(0), last), lambda k: _sum(F.slice(s, F.lit(1), k))))


def _random(text: Column, threshold: float) -> Column:
    """Spans of the candidates that the random model explains better."""
    size = len(ALPHABET)
    table, letters = F.lit(list(ratios())), F.lit(ALPHABET)

    def score(token: Column) -> Column:
        pair = lambda i: (F.instr(letters, F.substring(token, i, F.lit(1))) - 1) * size + F.instr(letters, F.substring(token, i + 1, F.lit(1)))
        return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda a, i: a + F.element_at(table, pair(i)))

    def secret(token: Column) -> Column:
        mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
        return F.when(mixed, score(token) > threshold * (F.length(token) - 1)).otherwise(F.lit(False))

    return _matches(text, CANDIDATE, 0, secret, 3)


def _tops(xs: Column, value: Callable[[Column], Column], use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """use(f), where f(i) is the largest value of the first i elements (0 of none), in about BLOCK steps each."""
    last = (F.size(xs) / BLOCK).cast("int")
    tops = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_max(F.transform(F.slice(xs, k * BLOCK + 1, BLOCK), value)))

    def upto(heads: Column) -> Callable[[Column], Column]:
        block = lambda i: (i / BLOCK).cast("int")
        own = lambda i: F.array_max(F.transform(F.slice(xs, block(i) * BLOCK + 1, i % BLOCK), value))
        return lambda i: F.greatest(F.get(heads, block(i)), own(i), F.lit(0))

    return _let(_let(tops, lambda t: F.transform(F.sequence(F.lit(0), last), lambda k: F.array_max(F.slice(t, F.lit(1), k)))), lambda heads: use(upto(heads)))


def _none() -> Column:
    return F.array().cast("array<struct<from:int,kind:int,upto:int,at:int>>")


def _free(spans: Column) -> Column:
    """Sorted spans without the random ones that touch a base span. Random spans don't touch each other, so only what
    starts before one, and what stands right behind it, can."""

    def kept(before: Callable[[Column], Column]) -> Column:
        after = lambda i: F.get(spans, i + 1)
        clear = lambda x, i: (before(i) <= x["from"]) & ~F.coalesce((after(i)["kind"] < 3) & (after(i)["from"] < x["upto"]), F.lit(False))
        return F.filter(spans, lambda x, i: (x["kind"] < 3) | clear(x, i))

    return _tops(spans, lambda x: F.when(x["kind"] < 3, x["upto"]).otherwise(0), kept)


def spans(text: Column, threshold: float = THRESHOLD) -> Column:
    """An array of structs (from, kind, upto, at) of all spans, in order; the secret itself starts `at`.

    A span of a base kind is a whole match of its pattern. The Markov models add spans (kind 3) that no base span
    touches. Patterns are run only where a cheap look finds it worth while. A null text has no spans.
    """
    t = F.coalesce(text, F.lit(""))

    def when(hint: Column, found: Column) -> Column:
        return F.coalesce(F.when(hint, found), _none())

    assign = when(t.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), _matches(t, ASSIGN, 2, lambda x: F.length(x) >= 6, 0))
    access = when(t.contains("AKIA"), _matches(t, ACCESS, 0, None, 1))
    hexes = when(t.rlike("[0-9a-f]{24}"), _matches(t, HEX, 0, None, 2))
    extra = when(t.rlike(r"[A-Za-z0-9+/_-]{20}"), _random(t, threshold))
    return _let(F.concat(assign, access, hexes, extra), lambda x: F.when(F.size(x) > 1, _let(F.array_sort(x), _free)).otherwise(x))


def scan(docs: DataFrame, text: str = "text", out: str = "found", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the column `out`: the spans of `text`, as `spans` gives them. No row is moved."""
    return docs.withColumn(out, spans(F.col(text), threshold))


def masked(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """text with the secret of each of its spans replaced by `mark`: what overlaps becomes one mark, names before
    assigned values stay, and nothing else changes.

    The text is cut into chunks once, so each of many spans costs a chunk and not the text.
    """
    def between(chunks: Column, a: Column, b: Column) -> Column:
        """The characters from a to b, counted from 0."""
        first, last = (a / CHUNK).cast("int"), (b / CHUNK).cast("int")
        head = lambda n: F.substring(F.get(chunks, first), a % CHUNK + 1, n)
        whole = F.array_join(F.slice(chunks, first + 2, last - first - 1), "")
        tail = F.substring(F.coalesce(F.get(chunks, last), F.lit("")), F.lit(1), b % CHUNK)
        return F.when(a >= b, F.lit("")).when(first == last, head(b - a)).otherwise(F.concat(head(F.lit(CHUNK)), whole, tail))

    def build(chunks: Column, cuts: Column, before: Callable[[Column], Column]) -> Column:
        piece = lambda x, i: F.concat(between(chunks, before(i), x["at"]), F.when(x["at"] >= before(i), F.lit(mark)).otherwise(F.lit("")))
        rest = between(chunks, before(F.size(cuts)), F.length(text))
        return F.concat(F.array_join(F.transform(cuts, piece), ""), rest)

    cuts = F.array_sort(F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["upto"].alias("upto"))))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    whole = _let(chunks, lambda c: _let(cuts, lambda s: _tops(s, lambda x: x["upto"], lambda before: build(c, s, before))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def named(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    kinds = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["from"].cast("string"), x["upto"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans.

    Defined cases: a null or empty text has no spans, and the digest of the empty string; a null id stays null; repeated
    rows give repeated results; other columns are ignored; an empty table gives no rows; texts may have any length.
    """
    found = scan(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text").select("id", "found")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(named(F.filter("found", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        named(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the secret of every span in `text` replaced by `mark`, and nothing else changed. Null texts stay null."""
    found = unused(docs.columns, "found")
    return scan(docs, text, found).withColumn(text, masked(F.col(text), F.col(found), mark)).drop(found)
