"""What each of several filters does in each order they may be applied, and its Shapley value.

A document fails a set of filters, its mask. For each part of the corpus, the documents that a set
S of filters removes are v(S), the number of masks that meet S. Its multilinear extension is the
part's removal polynomial f(x_A, ..., x_E), the sum of c_T times the product of x_i, i in T, with
c_T = (-1)^(|T| + 1) times the documents that fail all of T. At a corner (x_i = 1 for the filters
applied, else 0) f is the number removed so far: survivors, removals and overlaps are differences
of corners. The Shapley value of i is the integral of df/dx_i along the diagonal x = (t, ..., t):
the sum of c_T / |T| over the sets T that hold i, in exact rationals, and times n! a whole number.

Masks are made row by row and counted before anything is shuffled; what follows has at most 2^n
rows a part.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The letters of the corpus filters, in the order of their bits.
FILTERS = "ABCDE"
WORDS = r"[^\x20\x09-\x0D]+"
COUNTED = ("n", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Filters A to D: short, repetitive, capital letters, code characters; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))
    capitals, marks = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""), F.translate(t, "#$%&*|", "")
    return [
        F.size(words) < 50,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        (F.octet_length(t) - F.octet_length(capitals)) * 100 > F.length(t) * 5,
        F.octet_length(marks) < F.octet_length(t),
    ]


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, mask, and kind of label: part, mask, n, good, toxic (numbers of documents).

    Filter E: some row of a smaller id has the same text (null counts as empty; a null id comes
    after all others, and rows of one id aren't copies of each other). A text's first row is found
    by its id and digest together, so that a text of a third of all rows is no hot key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        _mask(text_failures(F.col(text_col))).alias("mask"),
    )
    firsts = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest")).groupBy("digest").agg(F.min("id").alias("id"), F.lit(0).alias("later"))
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic"))
    a, b = read.alias("a"), firsts.alias("b")
    # Rows of one id and digest: their failures are the same and only counts go on.
    kinds = a.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")).alias("a")
    placed = kinds.join(b, (F.col("a.digest") == F.col("b.digest")) & F.col("a.id").eqNullSafe(F.col("b.id")), "left")
    placed = placed.select("a.id", "part", (F.col("mask") + F.coalesce("later", F.lit(1)) * (1 << 4)).alias("mask"), "n")
    labelled = placed.join(marked, "id", "left").select("part", "mask", "n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return labelled.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTED])


def _mask(fails: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)])


def polynomials(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part: total, and of each count (n, good, toxic) the coefficients c_T of its removal polynomial, by the number of T."""
    whole = range(1 << len(filters))

    def coefficient(count: str, t: int) -> Column:
        held = F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(t) == t, F.col(count))), F.lit(0)) if t else F.lit(0).cast("long")
        return held if t.bit_count() % 2 else -held

    return counts.groupBy("part").agg(F.sum("n").alias("total"), *[F.array(*[coefficient(c, t) for t in whole]).alias(f"c_{c}") for c in COUNTED])


def at_corner(coefficients: Column, corner: int, n: int) -> Column:
    """The polynomial where x_i = 1 for the bits of `corner` and 0 else: the coefficients of all its subsets."""
    return reduce(lambda x, y: x + y, [coefficients[t] for t in range(1 << n) if t & corner == t])


def shapley_weights(i: int, n: int) -> list[int]:
    """n! times the integral of d/dx_i of each monomial along the diagonal: n! / |T| for the sets T with i, else 0."""
    out = []
    for t in range(1 << n):
        integral = Fraction(1, t.bit_count()) if t >> i & 1 else Fraction(0)  # of t ** (|T| - 1) from 0 to 1
        scaled = integral * factorial(n)
        assert scaled.denominator == 1
        out.append(int(scaled))
    return out


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of all filters and step, from counts of masks (part, mask, n, good, toxic).

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley (the filter's removals summed over all orders). No counts, no rows; a part without
    failures has zeros.
    """
    n = len(filters)
    full, whole = (1 << n) - 1, range(1 << n)
    corners = polynomials(counts, filters).select(
        "part", "total", *[F.array(*[at_corner(F.col(f"c_{c}"), s, n) for s in whole]).alias(f"f_{c}") for c in COUNTED],
        F.array(*[reduce(lambda x, y: x + y, [F.col("c_n")[t] * w for t, w in enumerate(shapley_weights(i, n)) if w]) for i in range(n)]).alias("values"),
    )
    orders = " ".join("".join(p) for p in permutations(filters))
    each = corners.withColumn("filter_order", F.explode(F.split(F.lit(orders), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bits = lambda upto: reduce(lambda x, y: x + y, [F.when(F.instr(F.substr(F.col("filter_order"), F.lit(1), upto), c) > 0, 1 << k).otherwise(0) for k, c in enumerate(filters)])
    each = each.withColumns({"before": bits(F.col("step") - 1), "now": bits(F.col("step"))}).withColumn("own", F.col("now") - F.col("before"))
    removed = {c: F.get(f"f_{c}", F.col("now")) - F.get(f"f_{c}", F.col("before")) for c in COUNTED}
    letter = F.instr(F.lit(filters), F.substr(F.col("filter_order"), F.col("step"), F.lit(1))) - 1
    return each.select(
        "part", "filter_order", "step", (F.col("total") - F.get("f_n", F.col("now"))).alias("kept"), removed["n"].alias("removed"),
        (F.get("f_n", F.col("own")) - removed["n"]).alias("redundant"), (F.get("f_n", F.lit(full)) - F.get("f_n", F.lit(full) - F.col("own"))).alias("unique_fails"),
        removed["good"].alias("good_lost"), removed["toxic"].alias("toxic_lost"), F.get("values", letter).alias("shapley"),
    )


def corpus_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The audit of the five corpus filters; a part for each source, null as the empty string.

    An empty table of documents gives no rows; of a document's labels the highest counts, one
    without labels is neither good nor toxic; other columns are not read.
    """
    return audit(masks(docs, labels, **columns))
