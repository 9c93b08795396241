"""Benchmark decontamination: size-partitioned MinHash containment search, exact shingle containment.

A short item in a long document has a tiny Jaccard similarity with it, so both sides are partitioned by
size. Items fall into classes by their number of shingles, (u/2, u] for each power of two u. For a
class every document is cut into blocks of 2u shingles that begin every u shingles: whatever
run of up to u shingles it shares lies in one block, and there the similarity is high enough to
be found. Blocks and items are sketched by the smallest shingle hash in each of a number of bins of the
hash space; one equal minimum makes a candidate. The number of bins of a class follows from the
recall wanted at the containment threshold.

Candidates are verified exactly: the share of the item's distinct shingles that occur anywhere in the
whole document.

Native: built-in expressions only. Blocks are sketched inside the row, and only minima that equal one of
an item leave it. Equal texts are folded before candidates and shingles move. The sketches of the
items are counted and broadcast if few; else they shuffle. Candidate documents are read a second time for
the verification, so no document is carried through the search.

Words are runs of letters and digits in lower case, a shingle is five of them. Defined results: a null
text is empty; an item of fewer than five words has no shingles and is found nowhere; a null item id
stays null. With ``per_text``, as the queries have it, different texts of one id (or of null) are items of
their own, each judged and reported by itself, and rows equal in id and shingles are one item; without
it, all texts of an id are one item. Equal documents get equal answers. Other columns play no part.
Empty tables give an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import text_key, text_of
from waymesh.runtime import small, store

#: Smallest class of items, by shingles.
SMALLEST = 8


def words_of(text: Column) -> Column:
    """The words of a text, with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def shingle_hashes(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words, in their order; empty if there are fewer words."""
    hashes = F.transform(F.split(words, " "), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(h) - n + 1)
        return F.when(
            F.size(h) >= n, F.transform(at, lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(n)]))
        ).otherwise(F.array().cast("array<bigint>"))

    # a lambda binds the array of word hashes, so it is made once per row
    return F.element_at(F.transform(F.array(hashes), runs), 1)


def bins_for(u: int, threshold: float, recall: float) -> int:
    """Bins (a power of two) that find an item of class ``u`` with the recall wanted.

    The hardest case is the smallest item of the class in a full block that holds no more than the
    threshold's share of it.
    """
    item, block = u // 2 + 1, 2 * u
    bins = 8
    while True:
        filled = bins * (1 - (1 - 1 / bins) ** item)
        others = (block - threshold * item) / bins  # mean number of other shingles in a bin of the block
        wins = threshold * (1 - math.exp(-others)) / others
        if (1 - wins) ** filled <= 1 - recall or bins >= 1 << 16:
            return bins
        bins *= 2


def bin_minima(hashes: Column, bins: int) -> Column:
    """The smallest hash in each bin (the top bits of a hash) of an array, as an array."""
    drop = 64 - int(math.log2(bins))
    top = lambda x: F.shiftright(x, drop)
    return F.element_at(F.transform(
        F.array(F.sort_array(hashes)),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (top(x) != top(F.get(s, i - 1)))),
    ), 1)


def block_minima(shingles: Column, u: int, bins: int) -> Column:
    """The distinct bin minima of all blocks of class ``u``."""
    def of_block(s: Column):
        return lambda b: bin_minima(F.slice(s, b * u + 1, F.lit(2 * u)), bins)

    blocks = lambda s: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(s) / u).cast("int") - 2, F.lit(0)))
    return F.element_at(F.transform(
        F.array(shingles), lambda s: F.array_distinct(F.flatten(F.transform(blocks(s), of_block(s))))
    ), 1)


def _items(items: DataFrame, id: str, text: str, n: int, per_text: bool) -> DataFrame:
    """``item_id, item`` (a key of the item, never null), ``shingles`` (distinct), ``item_size`` and the class ``u``."""
    shingles = F.array_distinct(shingle_hashes(words_of(text_of(text)), n))
    rows = items.select(F.col(f"`{id}`").alias("item_id"), shingles.alias("shingles")).filter(F.size("shingles") > 0)
    named = F.to_json(F.struct(F.col("item_id").cast("string").alias("id")))  # a null id and the text "null" differ
    if per_text:
        rows = rows.select("item_id", F.sort_array("shingles").alias("shingles"))
        content = F.concat(text_key(named), text_key(F.concat_ws(",", F.col("shingles").cast("array<string>"))))
        one = rows.withColumn("item", content).groupBy("item").agg(F.first("item_id").alias("item_id"), F.first("shingles").alias("shingles"))
    else:
        one = (
            rows.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))
            .withColumn("item", text_key(named))
        )
    return (
        one.withColumn("item_size", F.size("shingles"))
        .withColumn("u", F.greatest(F.lit(SMALLEST), F.pow(2, F.ceil(F.log2("item_size")))).cast("int"))
    )


def contained_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    n: int = 5, threshold: float = 0.8, recall: float = 0.999, per_text: bool = False,
) -> DataFrame:
    """``key, item_id, item_size, shared, containment`` of the texts that contain items; one row per text and item."""
    known = store(_items(items, item_id, item_text, n, per_text)).df
    classes = [r.u for r in known.select("u").distinct().orderBy("u").collect()]  # at most one per power of two
    empty = F.array().cast("array<bigint>")

    def of_class(u: int) -> Column:
        minima = block_minima(F.col("shingles"), u, bins_for(u, threshold, recall))
        return F.transform(minima, lambda m: F.struct(F.lit(u).alias("u"), m.alias("least")))

    all_minima = F.flatten(F.array(*map(of_class, classes))) if classes else F.array().cast("array<struct<u:int,least:bigint>>")
    own = F.lit(None)
    for u in classes:
        own = F.when(F.col("u") == u, bin_minima(F.col("shingles"), bins_for(u, threshold, recall))).otherwise(own)
    sketches = small(known.select("item", "u", F.explode(own if classes else empty).alias("least")))
    body = text_of(text)
    texts = docs.select(text_key(body).alias("key"), shingle_hashes(words_of(body), n).alias("shingles"))
    # a block can only share a minimum with an item if the text has a shingle of that hash: all other texts need no sketch
    least = small(sketches.select("least").distinct())
    hit = texts.select("key", F.explode("shingles").alias("least")).join(least, "least", "left_semi").select("key").distinct()
    texts = (
        docs.select(text_key(body).alias("key"), body.alias("body")).join(small(hit), "key", "left_semi")
        .groupBy("key").agg(F.first("body").alias("body"))
        .select("key", shingle_hashes(words_of(F.col("body")), n).alias("shingles"))
    )
    minima = texts.select("key", F.explode(all_minima).alias("m"))
    candidates = store(
        minima.select("key", "m.u", "m.least").join(sketches, ["u", "least"]).select("key", "item").distinct()
    ).df
    wanted = small(candidates.select("key").distinct())
    # the second reading: only candidate texts go on, each once
    chosen = (
        docs.select(text_key(body).alias("key"), body.alias("body")).join(wanted, "key", "left_semi")
        .groupBy("key").agg(F.first("body").alias("body"))
    )
    there = chosen.select("key", F.explode(F.array_distinct(shingle_hashes(words_of(F.col("body")), n))).alias("shingle"))
    asked = small(known.select("item", F.explode("shingles").alias("shingle")))
    # a text and an item that share a shingle, restricted to candidates
    shared = there.join(asked, "shingle").groupBy("key", "item").agg(F.count(F.lit(1)).alias("shared"))
    sizes = known.select("item", "item_id", "item_size")
    return (
        shared.join(candidates, ["key", "item"], "left_semi").join(sizes, "item")
        .select("key", "item_id", F.col("item_size").cast("bigint").alias("item_size"), "shared",
                (F.col("shared") / F.col("item_size")).alias("containment"))
        .filter(F.col("containment") >= threshold)
    )


def contaminated(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """One row per row of ``docs`` and item found in it: ``id, item_id, item_size, shared, containment``."""
    found = small(contained_items(docs, items, text, **options))
    rows = docs.select(F.col(f"`{id}`").alias("id"), text_key(text_of(text)).alias("key"))
    return rows.join(found, "key").select(F.col("id").alias(id), "item_id", "item_size", "shared", "containment")


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns stay."""
    columns = docs.columns
    found = small(contained_items(docs, items, text, **options).select(F.col("key").alias("mark")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text_key(text_of(text)).alias("mark"))
    return rows.join(found, "mark", "left_anti").select("row.*")
