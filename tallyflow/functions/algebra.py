"""Annotation values as column expressions: dense counters, sparse counters, tries of counters, polynomials, source lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- dense counters: array<bigint>, one for each channel


def one_hot(channel: Column, channels: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda i: (i == channel).cast("bigint"))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def total(hm: Column) -> Column:
    return F.aggregate(hm, F.lit(0).cast("bigint"), lambda s, x: s + x)


def shares(hm: Column, zero: bool = False) -> Column:
    """Each channel's part of the total. Of a total of zero: null, or zeros if zero is set."""
    t = total(hm)
    return F.transform(hm, lambda x: F.when(t != 0, x / t).otherwise(F.lit(0.0 if zero else None)))


# --- sparse counters: map<int|bigint, bigint> without zeros


def sparse(hm: Column) -> Column:
    """Dense to sparse."""
    pairs = F.transform(hm, lambda x, i: F.struct(i.alias("key"), x.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] != 0))


def dense(counters: Column, channels: int) -> Column:
    """Sparse to dense."""
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda i: F.coalesce(F.try_element_at(counters, i), F.lit(0).cast("bigint")))


def add_sparse(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


# --- a trie over the bits of a path, a counter at every node: sparse counters keyed by (1 << level) + prefix


def node(level: Column | int, prefix: Column | int) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.expr("cast(1 as bigint)") * F.pow(F.lit(2), as_col(level)).cast("bigint") + as_col(prefix)


def trie_nodes(path: Column, depth: int) -> Column:
    """The nodes from the root to the path's leaf; a node's prefix is the path's low bits."""
    return F.array(*[F.lit(1 << level).cast("bigint") + path.bitwiseAND(F.lit((1 << level) - 1)) for level in range(depth + 1)])


def prefix_count(trie: Column, level: int, prefix: Column | int) -> Column:
    """How much came over paths whose low `level` bits are prefix."""
    return F.coalesce(F.try_element_at(trie, node(level, prefix)), F.lit(0).cast("bigint"))


def trie_to_dense(trie: Column, depth: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit((1 << depth) - 1)), lambda i: F.coalesce(F.try_element_at(trie, F.lit(1 << depth).cast("bigint") + i), F.lit(0).cast("bigint")))


def trie_consistent(trie: Column, depth: int) -> Column:
    """Whether every inner node has the sum of its children."""
    at = lambda n: F.coalesce(F.try_element_at(trie, n), F.lit(0).cast("bigint"))
    checks = []
    for level in range(depth):
        checks.append(F.forall(F.filter(F.map_keys(trie), _at_level(level)), _children(at, level)))
    out = F.lit(True)
    for c in checks:
        out = out & c
    return out


def _at_level(level: int):
    return lambda n: (n >= (1 << level)) & (n < (2 << level))


def _children(at, level: int):
    # the next level's bit is above the prefix: children of p are p and p + (1 << level)
    return lambda n: at(n) == at(n + (1 << level)) + at(n + (2 << level))


# --- polynomials: array<struct<coef:int, vars:array<struct<v:bigint, e:int>>>>, like terms combined, no zero terms

POLYNOMIAL = "array<struct<coef:int,vars:array<struct<v:bigint,e:int>>>>"


def variable(v: Column) -> Column:
    return F.array(F.struct(F.lit(1).alias("coef"), F.array(F.struct(v.cast("bigint").alias("v"), F.lit(1).alias("e"))).alias("vars"))).cast(POLYNOMIAL)


def variable_id(seq: Column, subtask: Column | int, parallelism: int, channels: int, channel: Column) -> Column:
    """Distinct for each source row; its remainder by the channels is the channel."""
    return (seq * parallelism + subtask) * channels + channel


def _as_map(vars_: Column) -> Column:
    return F.map_from_entries(F.transform(vars_, lambda x: F.struct(x["v"].alias("key"), x["e"].alias("value"))))


def _as_vars(m: Column) -> Column:
    return F.array_sort(F.transform(F.map_entries(m), lambda x: F.struct(x["key"].alias("v"), x["value"].alias("e")))).cast("array<struct<v:bigint,e:int>>")


def times_monomial(a: Column, b: Column) -> Column:
    """The product of two variable lists: exponents add."""
    return _as_vars(F.map_zip_with(_as_map(a), _as_map(b), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))


def combine_like(p: Column) -> Column:
    """Like terms summed, zero terms dropped, terms in order."""
    names = F.array_sort(F.array_distinct(F.transform(p, lambda t: t["vars"])))
    coef = lambda vars_: F.aggregate(F.filter(p, lambda t: t["vars"] == vars_), F.lit(0), lambda s, t: s + t["coef"])
    return F.filter(F.transform(names, lambda vars_: F.struct(coef(vars_).alias("coef"), vars_.alias("vars"))), lambda t: t["coef"] != 0).cast(POLYNOMIAL)


def plus(a: Column, b: Column) -> Column:
    return combine_like(F.concat(a, b))


def times(a: Column, b: Column) -> Column:
    pairs = F.flatten(F.transform(a, lambda s: F.transform(b, lambda t: F.struct((s["coef"] * t["coef"]).alias("coef"), times_monomial(s["vars"], t["vars"]).alias("vars")))))
    return combine_like(pairs.cast(POLYNOMIAL))


def project_polynomial(p: Column, channels: int) -> Column:
    """How much each channel contributed: exponent times coefficient, summed by variable modulo channels."""
    terms = F.flatten(F.transform(p, lambda t: F.transform(t["vars"], lambda x: F.struct(F.pmod(x["v"], F.lit(channels)).alias("c"), (x["e"] * t["coef"]).cast("bigint").alias("n")))))
    per = lambda i: F.aggregate(F.filter(terms, lambda x: x["c"] == i), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), per)


# --- source lists: array<bigint>


def leaf_count(ids: Column) -> Column:
    """With multiplicity: how many derivations."""
    return F.size(ids).cast("bigint")


def backward(ids: Column) -> Column:
    """The set of sources, sorted."""
    return F.array_sort(F.array_distinct(ids))


# --- fixed-size ids


def uid(generator: Column | int, counter: Column) -> Column:
    """Six bits of generator, then 58 of counter."""
    g = F.lit(generator) if isinstance(generator, int) else generator
    return F.shiftleft(g.cast("bigint"), 58).bitwiseOR(counter.cast("bigint"))
