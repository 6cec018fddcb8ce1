"""Secret scans: native expressions only.

Three patterns give the base spans. Their places come from the pieces between matches (split) and the matches
themselves (regexp_extract_all): a match starts where the pieces and matches before it end. Beyond them, candidate
strings (runs of 20 or more of [A-Za-z0-9+/_=-]) are scored by the Shannon entropy of a sliding window of 20
characters. The window's counts are kept incrementally: five bits for each character of the alphabet, packed into a
few whole numbers, of which a step changes those of the character that enters and the one that leaves. The sum of
count * log2(count) is carried in whole units of 2^-40, so that no rounding builds up. A candidate's class (hex, or
wider) fixes the entropy that its best window must reach. An allow-list suppresses candidates that are numbers, plain
words, UUIDs, paths or runs without both letters and digits, and those that touch a base span.

The work is linear in a text's length but for sorting its spans: results of running sums are put together in runs of
RUN, and no pattern repeats a group in a way that recurses or goes back.

Defined cases: a null text has no spans; offsets count code points, ends are exclusive; every row is scanned on its
own, whole, so rows that repeat a doc_id (or have none) are scanned each; other columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

WIDTH = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WIDTH},}}+"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Bits a character that a candidate's best window must have.
BITS_HEX, BITS_WIDE = 3.0, 3.8
ALLOWED = (
    r"^[0-9]++$",
    r"^[A-Za-z_=+/-]++$",
    r"^[0-9_=+/-]++$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^/?(?:[a-z]++[0-9]*+[/_=-])++[a-z]*+[0-9]*+$",
)
SPAN = "struct<s:bigint,k:int,e:bigint,w:string>"
#: Results of a running sum that are put together at a time.
RUN = 256
#: Counts are packed five bits each, so a window has less than 32 characters; UNIT is the unit of the carried sum.
PACK, UNIT = 12, 1 << 40
#: What the sum grows by when a count goes from n to n + 1.
RISE = [round(UNIT * ((n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0))) for n in range(WIDTH)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _running(items: Column, start: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """step(state, item) -> (next state, result), over all items in order: the array of all results.

    Appending copies an array, so results are gathered in runs of RUN items, and the runs are joined at the end."""
    none = F.array().cast(f"array<{out}>")

    def one(state: Column, item: Column) -> Column:
        after, result = step(state["state"], item)
        return F.struct(after.alias("state"), F.concat(state["out"], F.array(result)).alias("out"))

    def many(state: Column, run: Column) -> Column:
        done = F.aggregate(run, F.struct(state["state"].alias("state"), none.alias("out")), one)
        return _let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    def whole(held: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / RUN).cast("int")), lambda k: F.slice(held, k * RUN + 1, F.lit(RUN)))
        first = F.struct(start.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out"))
        return F.when(F.size(held) == 0, none).otherwise(F.aggregate(runs, first, many, lambda s: F.flatten(s["out"])))

    return _let(items, whole)


def _places(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, words: bool = False) -> Column:
    """Spans (start, kind, end, word or null) of the pattern's matches; those whose group is shorter than least are left out."""
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    both = F.arrays_zip(pieces.alias("p"), whole.alias("w"), kept.alias("g"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["p"])
        end = begin + F.coalesce(F.length(x["w"]), F.lit(0))
        good = x["w"].isNotNull() & (F.length(x["g"]) >= least)
        word = x["w"] if words else F.lit(None).cast("string")
        return end, F.when(good, F.struct(begin.alias("s"), F.lit(kind).alias("k"), end.alias("e"), word.alias("w")))

    found = F.filter(_running(both, F.lit(0).cast("long"), SPAN, step), lambda x: x.isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def window_entropy(word: Column, width: int = WIDTH) -> Column:
    """The highest entropy, in bits a character, of a window of that width: counts are carried from step to step."""
    packs = -(-len(ALPHABET) // PACK)
    shift, right = (lambda x, n: F.call_function("shiftleft", x, n)), (lambda x, n: F.call_function("shiftright", x, n))
    one = F.lit(1).cast("long")

    def placed(c: Column) -> Column:
        place = F.instr(F.lit(ALPHABET), c) - 1
        return F.struct(F.floor(place / PACK).cast("int").alias("k"), (5 * (place % PACK)).alias("n"), shift(one, 5 * (place % PACK)).alias("bit"))

    rise = F.array(*map(F.lit, RISE))
    count = lambda counts, x: right(F.element_at(counts, x["k"] + 1), x["n"]).bitwiseAND(31).cast("int")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), packs).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("least"), F.lit(0).alias("i"))

    def step(state: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        # the character that leaves goes first
        left = F.when(old.isNull(), state["counts"]).otherwise(F.transform(state["counts"], lambda c, k: F.when(k == old["k"], c - old["bit"]).otherwise(c)))
        less = F.when(old.isNull(), F.lit(0).cast("long")).otherwise(F.element_at(rise, count(state["counts"], old)))

        def entered(counts: Column) -> Column:
            total = state["sum"] - less + F.element_at(rise, count(counts, new) + 1)
            return _let(
                total,
                lambda t: F.struct(
                    F.transform(counts, lambda c, k: F.when(k == new["k"], c + new["bit"]).otherwise(c)).alias("counts"),
                    t.alias("sum"),
                    F.when((state["i"] + 1 >= width) & ((state["least"] < 0) | (t < state["least"])), t).otherwise(state["least"]).alias("least"),
                    (state["i"] + 1).alias("i"),
                ),
            )

        return _let(left, entered)

    def whole(new: Column) -> Column:
        old = F.concat(F.array_repeat(F.lit(None).cast("struct<k:int,n:int,bit:bigint>"), width), new)
        pairs = F.slice(F.arrays_zip(new.alias("new"), old.alias("old")), 1, F.size(new))
        return F.aggregate(pairs, start, step, lambda s: F.when(s["least"] < 0, F.lit(0.0)).otherwise(F.lit(math.log2(width)) - s["least"] / F.lit(float(UNIT * width))))

    return _let(F.transform(F.split(word, ""), placed), whole)


def _secret(word: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | word.rlike(pattern)
    least = F.when(word.rlike("^[0-9a-fA-F]++$"), F.lit(BITS_HEX)).otherwise(F.lit(BITS_WIDE))
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(word) >= least)


def _apart(base: Column, candidates: Column) -> Column:
    """The candidates that touch no base span, by a merge: on the way up, how far the base spans so far reach; on the way
    down, where the next one starts."""
    pair = f"struct<x:{SPAN},ok:boolean>"
    every = F.array_sort(F.concat(base, candidates))
    is_base = lambda x: x["k"] < 3
    up = _running(every, F.lit(0).cast("long"), pair, lambda reach, x: (F.when(is_base(x), F.greatest(reach, x["e"])).otherwise(reach), F.struct(x.alias("x"), (reach <= x["s"]).alias("ok"))))
    far = F.lit((1 << 63) - 1)
    down = _running(F.reverse(up), far, pair, lambda ahead, y: (F.when(is_base(y["x"]), y["x"]["s"]).otherwise(ahead), F.struct(y["x"].alias("x"), (y["ok"] & (ahead >= y["x"]["e"])).alias("ok"))))
    return F.transform(F.filter(down, lambda y: ~is_base(y["x"]) & y["ok"]), lambda y: y["x"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text, base, found: arrays of spans (s, k, e, w) in order of start; found has the base spans as well."""
    text = F.coalesce(F.col("text"), F.lit(""))
    located = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        F.array_sort(F.concat(_places(F.col("text"), ASSIGN, 0, 2, 8), _places(F.col("text"), ACCESS, 1), _places(F.col("text"), HEX, 2))).alias("base"),
        _places(F.col("text"), CANDIDATE, 3, words=True).alias("candidates"),
    )
    apart = F.when(F.size("base") > 0, _apart(F.col("base"), F.col("candidates"))).otherwise(F.col("candidates"))
    good = F.filter(apart, lambda c: _secret(c["w"]))
    return located.select("doc_id", "text", "base", F.when(F.size("candidates") > 0, F.array_sort(F.concat("base", good))).otherwise(F.col("base")).alias("found"))


def listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op5(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return scan(docs).select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"))
