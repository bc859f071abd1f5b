"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text is the set of its distinct paragraphs, each a 64-bit digest; a paragraph ends with its line or, within one, after
a mark that ends a sentence of some length, so most short texts have several too. A sketch has three parts
of equal size; a digest is added to one cell of each part: cells hold a number, the digests' exclusive
or and that of their check hashes. The sketches of two versions subtract cell by cell; peeling takes
the digests of cells that hold just one, removes them everywhere, and goes on until all differing
digests are recovered, with the version that has them. If cells remain, the digests are sketched again four times as large.
Digests are dealt by their lowest bits into groups of some ``GROUP`` first, and each group is sketched by itself, so the
work grows with the number of paragraphs and not with its square.

The fingerprint is the sketch of ``CELLS`` cells of the whole text; equal texts have equal fingerprints. Null texts count
as empty: one empty paragraph. Very long texts only make the lists in their own row longer. Rows that repeat are compared
each; an empty table gives an empty table; columns of any name may be kept, and names of working columns avoid theirs.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._blocks import fresh

CELLS, FIRST, GROWTH, SIZES, ROUNDS, GROUP = 24, 45, 4, 6, 24, 16
SEED, MOST_RANGES = 7, 1 << 14
#: Within a line a paragraph ends with a sentence, where it has some length by then.
SENTENCE, LONG = r" (?<=[^.!?;]{40}[.!?;] )", 42


def paragraphs(text: Column) -> Column:
    """The lines of a text, long ones by sentences."""
    return F.flatten(F.transform(F.split(text, "\n", -1), lambda p: F.when(F.length(p) > LONG, F.split(p, SENTENCE, -1)).otherwise(F.array(p))))


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    """32-bit check hash of a digest."""
    return F.xxhash64(key, F.lit(SEED)).bitwiseAND(F.lit(0xFFFFFFFF))


def _places(key: Column, part: Column) -> list[Column]:
    """The digest's cell in each of the three parts of ``part`` cells."""
    return [F.pmod(F.shiftright(F.xxhash64(key, F.lit(SEED + 1 + t)), 8), part) + t * part for t in range(3)]


def _entries(keys: Column, part: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(1).alias("n"), k.alias("k"), _check(k).alias("h"), F.array(*_places(k, part)).alias("at")))


def _folded(entries: Column, j: Column, first: Column, sign: int = 1) -> Column:
    """The cell ``first`` with the entries of place j added (or taken away)."""
    mine = F.filter(entries, lambda e: F.array_contains(e["at"], j))
    return F.aggregate(mine, first, lambda a, e: F.struct((a["n"] + sign * e["n"]).alias("n"), a["k"].bitwiseXOR(e["k"]).alias("k"), a["h"].bitwiseXOR(e["h"]).alias("h")))


def _let(value: Column, f) -> Column:
    """f of the value, which is worked out once."""
    return F.transform(F.array(value), f)[0]


def sketch(keys: Column, cells: Column) -> Column:
    """Array of cells (n, k, h) of the digests; cells (a long) is a multiple of three."""
    part = (cells / 3).cast("long")
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    places = F.sequence(F.lit(0).cast("long"), cells - 1)
    return _let(_entries(keys, part), lambda entries: F.transform(places, lambda j: _folded(entries, j, zero)))


def as_text(cells: Column) -> Column:
    """The cells as base64 text: number, digest and check hash of each."""
    hexed = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"].cast("long")), 4, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"]), 8, "0")))
    return F.base64(F.unhex(F.array_join(hexed, "")))


def differing(a: Column, b: Column, cells: Column) -> Column:
    """The digests in which two sketches differ, as (n, k): n is 1 for those of the first and -1 for those of the second; null if peeling gets stuck."""
    part = (cells / 3).cast("long")
    minus = F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))
    pure = lambda cells_: F.array_distinct(F.transform(F.filter(cells_, lambda c: (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"]))), lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"), c["h"].alias("h"), F.array(*_places(c["k"], part)).alias("at"))))
    state = lambda cells_, found: _let(cells_, lambda c: F.struct(c.alias("cells"), pure(c).alias("pure"), found.alias("found")))
    brief = lambda pure_: F.transform(pure_, lambda p: F.struct(p["n"].alias("n"), p["k"].alias("k")))

    def step(s: Column, _: Column) -> Column:
        rest = F.transform(s["cells"], lambda c, j: _folded(s["pure"], j.cast("long"), c, -1))
        return F.when(F.size(s["pure"]) > 0, state(rest, F.concat(s["found"], brief(s["pure"])))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(minus, _none()), step, lambda s: F.when(~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0)), s["found"]))


def _none() -> Column:
    return F.from_json(F.lit("[]"), "array<struct<n:int,k:bigint>>")


def difference(a: Column, b: Column) -> Column:
    """The digests in which two sets differ, as (n, k), peeled from the difference of their sketches; larger sketches on failure.

    Should all sizes fail, which needs equal check hashes, the group is compared as it is.
    """
    sizes = F.array(*[F.lit(FIRST * GROWTH**i).cast("long") for i in range(SIZES)])
    marked = lambda x, y, n: F.transform(F.array_except(x, y), lambda k: F.struct(F.lit(n).alias("n"), k.alias("k")))

    def of_group(x: Column, y: Column) -> Column:
        peeled = F.aggregate(sizes, F.lit(None).cast("array<struct<n:int,k:bigint>>"), lambda d, m: F.when(d.isNull(), differing(sketch(x, m), sketch(y, m), m)).otherwise(d))
        return F.when(x == y, _none()).otherwise(F.coalesce(peeled, F.concat(marked(x, y, 1), marked(y, x, -1))))

    most = F.greatest(F.size(a), F.size(b))
    groups = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(most / GROUP, F.lit(1.0))))).cast("long")
    mine = lambda keys, g, n: F.filter(keys, lambda k: k.bitwiseAND(n - 1) == g)
    each = _let(groups, lambda n: F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda g: _let(F.struct(mine(a, g, n).alias("x"), mine(b, g, n).alias("y")), lambda p: of_group(p["x"], p["y"])))))
    return F.when(a == b, _none()).otherwise(each)


def likeness(a: Column, b: Column, differs: Column) -> Column:
    """Jaccard similarity of two sets of digests, given in how many they differ."""
    both = F.size(a) + F.size(b)
    return ((both - differs) / (both + differs)).cast("double")


def _past(cuts: Column, key: Column, step: int) -> Callable[[Column], Column]:
    """A place among the rising cuts, ``step`` farther if the cut before that is no larger than the key."""
    return lambda at: F.when(F.get(cuts, at + (step - 1)) <= key, at + step).otherwise(at)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 2000) -> DataFrame:
    """docs with _next: the text of the row with the next smaller key (after the smallest: the largest).

    Keys are cut into ranges at quantiles; each range is sorted by itself, and its last row takes the
    first of the next range, which are as few as the ranges. Null keys come last, ties by the text's hash.
    """
    range_, lead, more, nth, head, all_, after_ = fresh([*docs.columns, "_next"], "range", "lead", "more", "nth", "head", "all", "after")
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, math.ceil(n / rows_per_bucket)))
    found = docs.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    cuts = F.from_json(F.lit(json.dumps(sorted({int(x) for x in found or []}))), "array<bigint>")
    # how many cuts are no larger than the key, by halving steps
    at = F.lit(0)
    for step in reversed(range(len(found or []).bit_length())):
        at = _let(at, _past(cuts, F.col(key), 1 << step))
    order = Window.partitionBy(range_).orderBy(F.col(key).desc_nulls_last(), F.xxhash64(text))
    ranged = docs.withColumn(range_, at).withColumns({lead: F.lead(text).over(order), more: F.lead(F.lit(1)).over(order), nth: F.row_number().over(order)})
    heads = ranged.where(F.col(nth) == 1).select(range_, F.col(text).alias(head))
    spread = F.broadcast(heads.agg(F.array_sort(F.collect_list(range_)).alias(all_)))  # one row, of as many numbers as there are ranges
    place = F.array_position(all_, F.col(range_)).cast("int")
    # the range of the next smaller keys takes over at the end of one
    after = heads.join(spread).select(F.when(place < F.size(all_), F.get(all_, place)).otherwise(F.get(all_, F.lit(0))).alias(range_), F.col(head).alias(after_))
    return ranged.join(after, range_, "left").withColumn("_next", F.when(F.col(more).isNotNull(), F.col(lead)).otherwise(F.col(after_))).drop(range_, lead, more, nth, after_)


def compare(docs: DataFrame, keep: list[str], text: str, edited: str, other: str) -> DataFrame:
    """The columns to keep, with n_chars, edited_sha256, the fingerprints of text and edited, the likeness of text's to edited's and to other's, and the digests that only text and only edited has.

    Everything of one row is one array of one struct that is mapped and then unfolded, so that no digest is worked out twice.
    """
    begin = F.array(F.struct(F.col(text).alias("t"), F.col(edited).alias("e"), F.col(other).alias("o")))
    sets = F.transform(begin, lambda s: F.struct(F.length(s["t"]).cast("long").alias("n"), F.sha2(s["e"].cast("binary"), 256).alias("sha"), digests(s["t"]).alias("a"), digests(s["e"]).alias("b"), digests(s["o"]).alias("c")))
    with_diff = F.transform(sets, lambda s: F.struct(*[s[c].alias(c) for c in ("n", "sha", "a", "b", "c")], difference(s["a"], s["b"]).alias("d"), F.size(difference(s["a"], s["c"])).alias("next")))
    only = lambda d, n: F.array_sort(F.transform(F.filter(d, lambda x: x["n"] == n), lambda x: x["k"]))
    rows = F.transform(with_diff, lambda s: F.struct(
        s["n"].alias("n_chars"), s["sha"].alias("edited_sha256"), as_text(sketch(s["a"], F.lit(CELLS).cast("long"))).alias("fingerprint"), as_text(sketch(s["b"], F.lit(CELLS).cast("long"))).alias("edited_fingerprint"),
        likeness(s["a"], s["b"], F.size(s["d"])).alias("near_edited"), likeness(s["a"], s["c"], s["next"]).alias("near_next"), only(s["d"], 1).alias("only_text"), only(s["d"], -1).alias("only_edited"),
    ))
    return docs.select(*keep, F.inline(rows))
