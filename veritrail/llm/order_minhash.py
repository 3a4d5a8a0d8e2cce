"""Order MinHash fingerprints, in DataFrame operations only.

A text's tokens are its words, or single letters where a script is written without blanks; its k-mers are runs of three tokens (fewer:
all of them), each numbered by its occurrence, so that repeats differ. A fingerprint has SKETCHES tuples, each from an order of
the k-mers by hash: the LENGTH minimal ones are put back into text order and hashed. ORDERS hashes, independent of each other,
put the k-mers on as many circles, and each circle is read from STARTS evenly spaced points, which makes SKETCHES orders from
ORDERS sorts. The likeness of two texts is the share of equal tuples; it falls as k-mers are edited and as they change their order.

A null text counts as empty. Texts without tokens have one fingerprint, of zeros, and are alike with each other alone. Equal texts have
equal fingerprints, whatever their ids; rows that repeat stay rows of their own. A text may have 2^30 k-mers at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.shared import let, written

#: Tokens of a k-mer, k-mers of a tuple, independent orders and the points that each is read from.
WORDS, LENGTH, ORDERS, STARTS = 3, 2, 4, 16
SKETCHES = ORDERS * STARTS
#: Scripts written without blanks, of which each letter is a token (fixed values).
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Of these scripts no letter lies below U+0E01; below, no script is looked up, which takes several searches for each character.
TOKEN = rf"[\x{{E00}}-\x{{10FFFF}}&&[{UNSPACED}]]|[\x00-\x08\x0E-\x1F\x21-\x{{DFF}}[\x{{E00}}-\x{{10FFFF}}&&[^{UNSPACED}]]]+"
#: Low bits that hold a place in an array; the others hold a hash.
_BITS = 30
#: Documents in a bucket of neighbours, about; ranges that follow the distribution of ids.
_BUCKET, _RANGES = 2000, 64


def _top(v: Column) -> Column:
    return F.shiftright(v, _BITS)


def _place(v: Column) -> Column:
    return v.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")


def _marked(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(-1 << _BITS)).bitwiseOR(place.cast("long"))


def _k_mers(words: Column) -> Column:
    """Hashes of the k-mers, in text order."""
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - (WORDS - 1), F.lit(1)))
    return F.transform(heads, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WORDS))))


def _sorted_marks(hashes: Column) -> Column:
    """The leading bits of hashes, each with its place in the array, sorted."""
    return F.sort_array(F.transform(hashes, lambda h, i: _marked(h, i)))


def _last_step(steps: Column, holds) -> Column:
    """The largest sum of steps (falling powers of two) for which holds(sum), which holds up to some number."""
    return F.aggregate(steps, F.lit(0), lambda q, p: F.when(holds(q + p), q + p).otherwise(q))


def _numbered(mers: Column, marks: Column, steps: Column) -> Column:
    """Hashes of k-mer and occurrence number, in the order of the marks."""

    def number(v: Column, j: Column) -> Column:
        again = lambda q: (j - q >= 0) & (_top(F.get(marks, F.greatest(j - q, F.lit(0)))) == _top(v))
        return F.when(again(F.lit(1)), _last_step(steps, again)).otherwise(F.lit(0))

    return F.transform(marks, lambda v, j: F.xxhash64(F.get(mers, _place(v)), number(v, j)))


def _tuples(ids: Column, marks: Column, steps: Column) -> Column:
    """The tuples' hashes: of each circle of the ids, from each start."""
    n = F.size(ids)
    starts = F.array(*(F.lit(-(1 << 63) + k * ((1 << 64) // STARTS)) for k in range(STARTS)))
    circles = F.transform(F.array(*map(F.lit, range(ORDERS))), lambda order: F.sort_array(F.transform(ids, lambda v, i: _marked(F.xxhash64(v, order), i))))

    def tuple_from(ring: Column, start: Column) -> Column:
        below = _last_step(steps, lambda q: (q <= n) & (F.get(ring, F.least(q, n) - 1) < start))
        chosen = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(LENGTH)) - 1), lambda k: _place(F.get(ring, F.pmod(below + k, n))))
        in_text = F.array_sort(F.transform(chosen, lambda j: F.struct(_place(F.get(marks, j)).alias("at"), F.get(ids, j).alias("h"))))
        return F.xxhash64(F.transform(in_text, lambda x: x.h))

    return F.flatten(F.transform(circles, lambda ring: F.transform(starts, lambda start: tuple_from(ring, start))))


def fingerprint(text: Column) -> Column:
    """array<bigint> of SKETCHES tuple hashes."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    powers = F.array(*(F.lit(1 << k) for k in range(_BITS - 1, -1, -1)))

    def of_mers(mers: Column, steps: Column) -> Column:
        return let(_sorted_marks(mers), lambda marks: let(_numbered(mers, marks, steps), lambda ids: _tuples(ids, marks, steps)))

    def of_tokens(w: Column) -> Column:
        return let(F.filter(powers, lambda p: p <= F.size(w)), lambda steps: let(_k_mers(w), lambda mers: of_mers(mers, steps)))

    return let(tokens, lambda w: F.when(F.size(w) == 0, F.array_repeat(F.lit(0).cast("long"), SKETCHES)).otherwise(of_tokens(w)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v) / F.lit(float(SKETCHES))


def as_text(prints: Column) -> Column:
    """Sixteen hex digits of each tuple."""
    return F.array_join(F.transform(prints, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with fingerprints; a column of that name is replaced, all others and all rows stay."""
    return docs.withColumn(out, fingerprint(F.col(text)))


def with_next(docs: DataFrame, key: str, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """docs with the derived columns and, for these and columns, next_<column>: the value of the row that follows by key, or of
    the first row after the last.

    Columns named next_<column> are replaced, all others and all rows stay, whatever their names. Rows without key come first; rows
    of one key follow each other by the columns' values. The rows are dealt into buckets of neighbours; each bucket also gets the first
    rows of the bucket that follows, which end with it. One row for each bucket is ordered in one task to find which follows.
    """
    derived = derived or {}
    docs = docs.drop(*(f"next_{c}" for c in [*columns, *derived]))
    own = {k: f"__{k}_of_{len(docs.columns)}" for k in ("k", "bucket", "head")}
    while set(own.values()) & set(docs.columns):
        own = {k: f"_{v}" for k, v in own.items()}
    place = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    ids = docs.select(place.alias(own["k"]))
    facts = ids.agg(F.count("*").alias("n"), F.min(own["k"]).alias("low"), F.max(own["k"]).alias("high"), F.percentile_approx(own["k"], [k / _RANGES for k in range(1, _RANGES)], 10_000).alias("cuts")).first()
    if not facts["n"]:
        docs = docs.withColumns(derived) if derived else docs
        return docs.withColumns({f"next_{c}": F.col(c) for c in [*columns, *derived]})
    lows = sorted({facts["low"], *facts["cuts"]})
    highs = [*lows[1:], facts["high"] + 1]
    parts = -(-facts["n"] // (_BUCKET * len(lows)))
    nth = lambda values, k: F.get(F.array(*map(F.lit, values)), k)

    def bucket(k: Column) -> Column:
        span = F.size(F.filter(F.array(*map(F.lit, lows)), lambda x: x <= k)) - 1
        inside = (k.cast("double") - nth(lows, span).cast("double")) / nth([float(h) - float(x) for x, h in zip(lows, highs, strict=True)], span)
        return span.cast("long") * parts + F.least(F.floor(inside * parts), F.lit(parts - 1))

    firsts = written(ids.groupBy(bucket(F.col(own["k"])).alias(own["bucket"])).agg(F.min(own["k"]).alias(own["k"])))
    whole = Window.orderBy(own["bucket"])  # one row for each bucket
    heads = firsts.select(own["k"], F.coalesce(F.lag(own["bucket"]).over(whole), F.last(own["bucket"]).over(whole.rowsBetween(0, Window.unboundedFollowing))).alias(own["bucket"]))
    named = docs.withColumn(own["k"], place)
    rows = named.withColumns({own["bucket"]: bucket(F.col(own["k"])), own["head"]: F.lit(False)})
    heads = named.join(written(heads), own["k"]).withColumn(own["head"], F.lit(True)).select(rows.columns)
    order = Window.partitionBy(own["bucket"]).orderBy(own["head"], own["k"], *columns)
    following = {f"next_{c}": F.lead(c).over(order) for c in [*columns, *derived]}
    rows = rows.unionByName(heads)
    rows = rows.withColumns(derived) if derived else rows  # behind the join that picks the heads
    return rows.withColumns(following).filter(~F.col(own["head"])).drop(own["k"], own["bucket"], own["head"])
