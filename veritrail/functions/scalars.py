"""Scalar expressions: guards, hashes, name keys, label predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that mean a control, prefixes that do, and labels that mean nothing is known.
CONTROL_LABELS = ("", "control", "ctrl", "non-targeting", "nt", "mock", "vehicle", "dmso", "nan", "none", "null")
CONTROL_PREFIXES = ("ctrl", "control")
MISSING_LABELS = ("", "nan", "none", "null")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def numeric(x: Column) -> Column:
    """x as a number; null where it is none or not finite."""
    n = x.try_cast("double")
    return F.when(finite(n), n)


def settled(x: Column) -> Column:
    """x to twelve digits: what only the order of a sum tells apart is equal, so ranks of means do not depend on how rows were dealt."""
    return F.when(x.isNotNull(), F.format_string("%.11e", x.cast("double")).cast("double"))


def is_control(label: Column) -> Column:
    """Control labels and unknown ones."""
    key = F.lower(F.trim(label))
    starts = key.startswith(CONTROL_PREFIXES[0]) | key.startswith(CONTROL_PREFIXES[1])
    return F.coalesce(key.isin(*CONTROL_LABELS) | starts, F.lit(True))


def is_missing(label: Column) -> Column:
    return F.coalesce(F.lower(F.trim(label)).isin(*MISSING_LABELS), F.lit(True))


def name_key(name: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "")


def alias_key(name: Column) -> Column:
    """name_key without what stands in brackets."""
    return name_key(F.regexp_replace(name, r"\([^)]*\)", ""))


def label_between(label: Column, prefix: str, suffix: str) -> Column:
    """What stands between a label's prefix and suffix; a label without them raises."""
    inner = F.substring(label, F.lit(len(prefix) + 1), F.length(label) - len(prefix) - len(suffix))
    right = label.startswith(prefix) & label.endswith(suffix) & (F.length(label) >= len(prefix) + len(suffix))
    return F.when(right, inner).otherwise(F.raise_error(F.concat(F.lit("no such label: "), F.coalesce(label, F.lit("null")))))


def condition_genes(condition: Column) -> Column:
    """Sorted genes of a condition, in capitals, without controls."""
    parts = F.transform(F.split(condition, "[_+]"), lambda x: F.upper(F.trim(x)))
    return F.array_sort(F.filter(parts, lambda x: (x != "") & (x != "CTRL")))


def canonical_condition(genes: Column) -> Column:
    """ctrl, GENE+ctrl or GENE+GENE."""
    return F.when(F.size(genes) == 0, "ctrl").when(F.size(genes) == 1, F.concat(F.get(genes, F.lit(0)), F.lit("+ctrl"))).otherwise(F.array_join(genes, "+"))


def salted(salt: str, key: Column) -> Column:
    """sha256 of salt, NUL and key as 64 hex digits; orders ties and splits."""
    return F.sha2(F.concat(F.lit(salt), F.lit("\0"), key.cast("string")), 256)


def fold(digest: Column, folds: int) -> Column:
    """Fold number from a digest's first eight hex digits."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds


def unit_interval(digest: Column) -> Column:
    """A number in [0, 1) from a digest's first eight hex digits."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fisher_z(r: Column) -> Column:
    return F.atanh(F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999)))


def keep_count(n: Column, share: Column) -> Column:
    """max(1, ceil(share * n))."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(share * n - F.lit(1e-9)))


def decision(effect: Column, low: Column, share: Column) -> Column:
    """PASS, PARTIAL or FAIL of a median effect, its lower bound and the share of positive ones."""
    positive = F.coalesce(finite(effect) & (effect > 0), F.lit(False))
    strong = F.coalesce(finite(low) & (low > 0) & (share >= 0.6), F.lit(False))
    return F.when(~positive, "FAIL").when(strong, "PASS").otherwise("PARTIAL")
