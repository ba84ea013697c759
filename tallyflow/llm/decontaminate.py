"""Benchmark decontamination: spaced seeds find benchmark passages in documents though some of their words were replaced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import words

#: A passage leaks if WINDOW of its words in a row stand in a document with at most SUBSTITUTED of them replaced.
WINDOW, SUBSTITUTED = 13, 2
#: The word positions that a seed looks at. Whatever two of 13 words are replaced, one of these masks fits between them somewhere
#: (a test tries all), so no such passage is missed.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Items of fewer words than WINDOW must occur whole, with at most one word replaced if they have TOLERANT words or more: then one of
#: their halves is untouched. Those of fewer than SHORTEST are words that any text may hold; unsearched() lists them.
SHORTEST, TOLERANT = 5, 8
#: How many words before a seed a window may begin, or a short item.
REACH = max(WINDOW - min(m[-1] for m in MASKS) - 1, (WINDOW - 1) // 2)
#: Seeds broadcast at once, each with some twenty words; more are taken in so many blocks.
BLOCK = 200_000


def _seed(tokens: Column, at: Column, n: int, mask: tuple[int, ...]) -> Column:
    """The hash of the words that mask n picks from position at on; null where it reaches beyond the text."""
    picked = [F.get(tokens, at + F.lit(m)) for m in mask]
    return F.when(at + F.lit(mask[-1]) < F.size(tokens), F.xxhash64(F.lit(n), *picked))


def _positions(tokens: Column, shortest: int) -> Column:
    return F.when(F.size(tokens) >= shortest, F.sequence(F.lit(0), F.size(tokens) - F.lit(shortest)))


def _same(a: Column, b: Column) -> Column:
    """How many words of two lists of one length are equal."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id) of each distinct text: its words, and the smallest of its ids."""
    return benchmark.select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("item")).groupBy("item").agg(F.min("item_id").alias("item_id"))


def unsearched(benchmark: DataFrame) -> DataFrame:
    """(item_id, text): the benchmark rows that contaminated() does not look for, as they have fewer than SHORTEST words. Null texts have none."""
    few = F.when(F.array_join(words(F.col("text")), "") == "", 0).otherwise(F.size(words(F.col("text")))) < SHORTEST
    return benchmark.where(few).select("item_id", "text")


def _parts(n: int) -> list[tuple[int, int]]:
    """(position, length) of the stretches of an item of n < WINDOW words that are looked up."""
    return [(0, n)] if n < TOLERANT else [(0, n // 2), (n // 2, n - n // 2)]


def seeds(benchmark: DataFrame) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(table, masks): a row for each seed of the distinct benchmark texts and what stands around it there (seed, p, item, long, size,
    item_ids: all texts that have it so); masks end with those that short texts need."""
    items = _items(benchmark).where(F.size("item") >= SHORTEST)
    short = sorted(r[0] for r in items.where(F.size("item") < WINDOW).select(F.size("item")).distinct().collect())  # eight at most
    lengths = sorted({k for n in short for _, k in _parts(n)})
    masks = [*MASKS, *(tuple(range(k)) for k in lengths)]
    placed = items.select("item_id", "item", F.explode(_positions(F.col("item"), min(SHORTEST, *lengths) if lengths else SHORTEST)).alias("p"))
    long = F.size("item") >= WINDOW
    looked = [long] * len(MASKS)
    for k in lengths:
        at = [(F.size("item") == n) & (F.col("p") == p) for n in short for p, size in _parts(n) if size == k]
        looked.append(reduce(lambda a, b: a | b, at))
    each = F.array(*[F.when(some, _seed(F.col("item"), F.col("p"), n, m)) for n, (m, some) in enumerate(zip(masks, looked, strict=True))])
    found = placed.select("item_id", "item", "p", F.explode(each).alias("seed")).where("seed is not null")
    first = F.greatest(F.lit(0), F.col("p") - F.lit(REACH))
    near = F.slice("item", first + 1, F.col("p") - first + F.lit(WINDOW))  # what windows around the seed can reach
    table = found.select("seed", "item_id", (F.col("p") - first).alias("p"), near.alias("item"), long.alias("long"))
    return table.groupBy("seed", "p", "item", "long").agg(F.collect_set("item_id").alias("item_ids")), masks


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each doc_id that holds a benchmark passage: doc_id, n_items, item_ids (sorted; the smallest of equal texts),
    first_word, last_word (positions of the verified hits' outer seeds).

    Words are compared with A-Z lower-cased, split at [\\x20\\x09-\\x0D]. Items with the same words around a seed are verified at once. Only the benchmark's seeds are broadcast, a block of bounded
    size at a time; documents are read in place and only verified hits are shuffled, combined before by document and item.
    Null texts count as empty. Null doc_ids are reported together as null. Repeated rows are one document. Empty tables give no rows.
    """
    table, masks = seeds(benchmark)
    blocks = max(1, -(-table.count() // block))
    least = min(m[-1] for m in masks) + 1
    tokens = docs.select(F.col("doc_id").alias("doc_id"), words(F.col("text")).alias("tokens"))
    placed = tokens.select("doc_id", "tokens", F.explode(_positions(F.col("tokens"), least)).alias("i"))
    looked = placed.select("doc_id", "tokens", "i", F.explode(F.array(*[_seed(F.col("tokens"), F.col("i"), n, m) for n, m in enumerate(masks)])).alias("seed"))
    reach = REACH
    window = _same(F.slice("near", F.col("q") - F.col("off") + 1, F.lit(WINDOW)), F.slice("item", F.col("p") - F.col("off") + 1, F.lit(WINDOW)))
    inside = (F.least("p", "q") >= F.col("off")) & (F.greatest(F.col("p") - F.size("item"), F.col("q") - F.size("near")) - F.col("off") + WINDOW <= 0)
    n = F.size("item")
    there = (F.col("q") >= F.col("p")) & (F.size("near") - F.col("q") + F.col("p") >= n)
    whole = _same(F.slice("near", F.greatest(F.lit(0), F.col("q") - F.col("p")) + 1, n), F.col("item")) >= n - F.when(n >= TOLERANT, 1).otherwise(0)
    fits = F.when(F.col("long"), F.when(inside, window >= WINDOW - SUBSTITUTED)).otherwise((F.col("off") == 0) & there & whole)
    found = None
    for k in range(blocks):
        some = table.where(F.pmod("seed", F.lit(blocks)) == k) if blocks > 1 else table
        first = F.greatest(F.lit(0), F.col("i") - F.lit(reach))
        # the look-up stays in one generated loop over positions: of a hit, only the words nearby leave it to be verified
        hits = looked.join(F.broadcast(some), "seed").select(
            "doc_id", "item_ids", "i", "p", "item", "long", (F.col("i") - first).alias("q"), F.slice("tokens", first + 1, F.lit(2 * WINDOW)).alias("near")
        )
        hits = hits.select("*", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("off")).where(fits).select("doc_id", "i", F.explode("item_ids").alias("item_id"))
        found = hits if found is None else found.unionByName(hits)
    by_item = found.groupBy("doc_id", "item_id").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    return by_item.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.min("first").alias("first_word"), F.max("last").alias("last_word")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in contaminated(), with all their columns."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("__doc"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__doc"]), "left_anti").select(docs.columns)
