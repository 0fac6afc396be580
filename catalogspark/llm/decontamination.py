"""Benchmark decontamination with SimHash fingerprints (native).

A fingerprint has 64 bits, each set where more than half of the hashes of a window's five-word shingles have it, each as often as it occurs.

Every window of every text is fingerprinted, at every word and in each width that the pieces of the items have, and looked up in an
index of these pieces: four blocks of 16 bits each, one of which is equal in any pair at most 3 bits apart. The width of an
item's pieces follows from the similarity that is asked for (`_pieces`): any window of the item's size that is similar enough holds
a run of the item's shingles in which a whole piece fits, so its fingerprint is met at a distance of 0.

Where a piece is met, windows of the item's size are laid at all starts from which they hold it, whatever the order of the item's parts in them. Those with
enough shingles that the item has are fingerprinted as a whole and looked up under the item's name by their eight bytes: a pair within a distance of
23 bits differs in some byte by two bits at most, so looking up every byte among the values that close finds all such
pairs. They are verified by the weighted Jaccard similarity of the shingles themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.common import ascii_lower, packed, text_or_empty, words
from catalogspark.session import materialize, once

SHINGLE, BITS, BLOCKS = 5, 64, 8
#: Shingles of a piece, odd so that no bit is tied; and the blocks of its fingerprint, one of which is equal in a pair less than that many bits apart.
WIDTHS, PIECE_BLOCKS = (1, 3, 5, 9), 4
#: Words of items whose pieces share a file.
FILE_WORDS = 100_000
#: What names the text of an item.
ITEM = ["item_a", "item_b"]


@dataclass(frozen=True)
class Limits:
    """Similarity in percent, and the distance of fingerprints that is searched. At 75 % a distance of 11 bits is expected, with a deviation of 3."""

    percent: int = 75
    radius: int = 23


def _word_hashes(text: Column) -> Column:
    return F.transform(words(ascii_lower(text)), lambda x: F.xxhash64(x))


def _grams(hashes: str, size: int) -> Column:
    """Hashes of `size` neighbouring words, in order, from those of the words; none if there are fewer."""
    at = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), at))


def _shingles(w: Column, hashed: bool) -> Column:
    """The five-word shingles of a few words, or all of them as one if they are fewer."""
    text = F.when(
        F.size(w) >= SHINGLE,
        F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")),
    ).otherwise(F.array(F.array_join(w, " ")))
    return F.transform(text, lambda s: F.xxhash64(s)) if hashed else text


def fingerprint(hashes: str | Column) -> Column:
    """64 bits: each is set where more than half of the hashes have it, each hash as often as it occurs."""
    votes = lambda j: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.bit_get(h, j).cast("int") * 2 - 1)
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.lit(0).cast("long"),
        lambda bits, j: bits.bitwiseOR(F.when(votes(j) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))),
    )


def _add(planes: dict[int, list[Column]]) -> dict[int, list[Column]]:
    """Bits that count 2 ** plane each, three or two at a time, as their sum in the same plane and their carry in the next."""
    out: dict[int, list[Column]] = {}
    for plane, bits in planes.items():
        whole = len(bits) - len(bits) % 3
        parts = [bits[i : i + 3] for i in range(0, whole, 3)] + ([bits[whole:]] if whole < len(bits) else [])
        for part in parts:
            if len(part) == 1:
                out.setdefault(plane, []).append(part[0])
                continue
            a, b = part[:2]
            total, carry = a.bitwiseXOR(b), a.bitwiseAND(b)
            if len(part) == 3:
                total, carry = total.bitwiseXOR(part[2]), carry.bitwiseOR(part[2].bitwiseAND(total))
            out.setdefault(plane, []).append(total)
            out.setdefault(plane + 1, []).append(carry)
    return out


def _above(planes: list[Column], least: int) -> Column:
    """The bits whose count, given by its binary digits from the lowest on, is above `least`."""
    above, equal = None, None
    for k in reversed(range(len(planes))):
        if least >> k & 1:
            equal = planes[k] if equal is None else equal.bitwiseAND(planes[k])
        else:
            more = planes[k] if equal is None else equal.bitwiseAND(planes[k])
            above = more if above is None else above.bitwiseOR(more)
            equal = F.bitwise_not(planes[k]) if equal is None else equal.bitwiseAND(F.bitwise_not(planes[k]))
    return above


def every_window(texts: DataFrame, keep: list[str], widths: list[int]) -> DataFrame:
    """(keep, p, width, bits): each window of so many neighbouring hashes of the list `grams`, where it starts, and its fingerprint.

    The fingerprints are those of `fingerprint`. As their widths are fixed here, all 64 bits are counted at once by sums and carries, in compiled rows.
    """
    rows = texts.select(*keep, "grams", F.posexplode("grams").alias("p", "_0"))
    rows = rows.select(*keep, "p", "_0", *[F.get("grams", F.col("p") + i).alias(f"_{i}") for i in range(1, max(widths))])
    for w in widths:
        planes = {0: [F.col(f"_{i}") for i in range(w)]}
        # each step is a projection of its own, so that nothing is computed twice
        for step in range(BITS):
            if max(map(len, planes.values())) == 1:
                break
            named = {k: [(f"_{w}_{step}_{k}_{i}", bits) for i, bits in enumerate(columns)] for k, columns in _add(planes).items()}
            rows = rows.select("*", *[bits.alias(name) for columns in named.values() for name, bits in columns])
            planes = {k: [F.col(name) for name, _ in columns] for k, columns in named.items()}
        rows = rows.withColumn(f"bits_{w}", _above([planes[k][0] for k in sorted(planes)], w // 2))
    each = F.array(*[F.struct(F.lit(w).alias("width"), F.col(f"bits_{w}").alias("bits")) for w in widths])
    return rows.select(*keep, "p", F.inline(each)).where("bits IS NOT NULL")


def _slots(bits: Column, blocks: int) -> Column:
    """The blocks of a fingerprint, each with its number above its value."""
    width = BITS // blocks
    value = lambda k: F.shiftrightunsigned(bits, width * k).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")
    return F.array(*[value(k).bitwiseOR(F.lit(k << width)) for k in range(blocks)])


def within_radius(windows: DataFrame, items: DataFrame, radius: int, on: tuple[str, ...] = ("size",), blocks: int = BLOCKS) -> DataFrame:
    """Pairs of rows with equal `on` whose fingerprints `bits` and `item_bits` are at most `radius` apart, each once.

    Every block of an item is entered with all values up to radius / blocks bits away. By the pigeonhole principle
    a pair within the radius meets in one of them. The index has a fixed number of rows per item.
    """
    near, width = radius // blocks, BITS // blocks
    masks = [m for m in range(1 << width) if m.bit_count() <= near]
    entered = items.select("*", F.explode(_slots(F.col("item_bits"), blocks)).alias("slot")).withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    entered = entered.withColumn("slot", F.col("slot").bitwiseXOR(F.col("mask"))).drop("mask")
    looked_up = windows.select("*", F.explode(_slots(F.col("bits"), blocks)).alias("slot"))
    met = looked_up.join(entered, [*on, "slot"])
    apart = F.col("bits").bitwiseXOR(F.col("item_bits"))
    met = met.where(F.bit_count(apart) <= radius)
    # a pair may meet in several blocks: the first one counts
    close = lambda k: F.bit_count(F.shiftrightunsigned(apart, width * k).bitwiseAND(F.lit((1 << width) - 1).cast("long"))) <= near
    first = F.coalesce(*[F.when(close(k), F.lit(k)) for k in range(blocks)])
    return met.where(F.shiftright("slot", width) == first).drop("slot")


def _pieces(items: DataFrame, k: int, percent: int) -> DataFrame:
    """(item_a, item_b, size, width, item_bits): pieces of items, `width` shingles of k words, with their fingerprints.

    Of an item's S shingles, a window of its size at the similarity holds at least S * percent / 100, and at most
    S * (100 - percent) / (100 + percent) others. Where it leaves the order of the item, two shingles that do not follow each other in the item
    would overlap, unless others lie between: as many as a shingle overlaps its next one, less the words of the longest run that
    the item has twice. So the others allow only so many breaks, and the longest run between them has at least `run` shingles. Pieces start
    so close that one lies in any such run. If the item has a run of four words twice, breaks cost nothing and its pieces are single shingles.
    """
    h = items.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    twice = [F.when(F.size(F.array_distinct(g)) < F.size(g), F.lit(n)).otherwise(F.lit(0)) for n, g in ((n, _grams("h", n)) for n in range(1, SHINGLE))]
    spread = F.greatest(F.col("size") - SHINGLE + 1, F.lit(1))
    own = once(h, [*ITEM, "size"], grams=_grams("h", k), spread=spread, cost=SHINGLE - 1 - F.greatest(*twice))
    breaks = F.when(F.col("cost") > 0, F.floor(F.col("spread") * (100 - percent) / ((100 + percent) * F.col("cost"))))
    run = F.greatest(F.coalesce(F.ceil(F.col("spread") * percent / (100 * (breaks + 1))), F.lit(1)), F.lit(1)).cast("int")
    own = once(own, [*ITEM, "size", "grams", "spread"], run=run)
    width = F.coalesce(*[F.when(F.col("run") >= w, F.lit(w)) for w in sorted(WIDTHS, reverse=True)])
    own = once(own, [*ITEM, "size", "grams", "spread", "run"], width=width)
    starts = F.sequence(F.lit(0), F.col("spread") - F.col("width"), F.col("run") - F.col("width") + 1)
    own = own.select(*ITEM, "size", "width", "grams", F.explode(starts).alias("q"))
    return own.select(*ITEM, "size", "width", fingerprint(F.slice("grams", F.col("q") + 1, F.col("width"))).alias("item_bits"))


def weighted_similarity(a: str, b: str) -> tuple[Column, Column]:
    """(intersection, union) of two short bags."""
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return both, F.size(a) + F.size(b) - both


def _key(text: Column, names: list[str]) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit("|"), text).alias(names[1])]


TEXT = ["key_a", "key_b"]


def text_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(key_a, key_b, item_id, similarity, start, n_windows): texts, by their hash, with the items that some window of theirs repeats."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words(ascii_lower(text_or_empty())).alias("w")).where(F.size("w") > 0)
    items = materialize(items.select("item_id", "w", F.size("w").alias("size"), *_key(F.array_join("w", " "), ITEM)), "items")
    distinct = items.select("w", "size", *ITEM).dropDuplicates(ITEM)
    named = docs.select(*_key(text_or_empty(), TEXT), text_or_empty().alias("text"))
    # shingles of five words, and of as many as the shortest items have, with the words of their items
    sizes = items.groupBy(F.least("size", F.lit(SHINGLE)).alias("k")).agg(F.sum("size").alias("n")).orderBy("k").collect()
    hits = None
    for k, n_words in sizes:
        # stored, so that Spark knows its size and broadcasts it if it is small; in few files, as each has a size of its own
        own = _pieces(distinct.where(F.least("size", F.lit(SHINGLE)) == k), k, limits.percent)
        own = materialize(own.coalesce(1 + n_words // FILE_WORDS), "pieces")
        widths = sorted(r["width"] for r in own.select("width").distinct().collect())
        hashed = once(named, TEXT, h=_word_hashes(F.col("text")))
        hashed = once(hashed, TEXT, n=F.size("h"), grams=_grams("h", k))
        met = within_radius(every_window(hashed, [*TEXT, "n"], widths), own, PIECE_BLOCKS - 1, ("width",), PIECE_BLOCKS)
        met = met.groupBy(*TEXT, "n", *ITEM, "size", (F.col("width") + k - 1).alias("covers")).agg(F.collect_set("p").alias("met"))
        last = F.greatest(F.col("n") - F.col("size"), F.lit(0))
        around = F.transform("met", lambda p: F.sequence(F.greatest(p + F.col("covers") - F.col("size"), F.lit(0)), F.least(p, last)))
        met = met.select(*TEXT, *ITEM, "size", F.array_distinct(F.flatten(around)).alias("starts"))
        hits = met if hits is None else hits.unionByName(met)
    empty = "key_a long, key_b long, item_id long, similarity double, start int, n_windows long"
    if hits is None:
        return docs.sparkSession.createDataFrame([], empty)
    hits = hits.join(once(distinct, ITEM, h=F.transform("w", lambda x: F.xxhash64(x))).select(*ITEM, _grams("h", SHINGLE).alias("own")), ITEM)
    hits = materialize(hits.groupBy(*TEXT).agg(F.collect_list(F.struct(*ITEM, "size", "starts", "own")).alias("laid")), "windows")
    # names alone, as Spark tells by the bytes of a stored table whether texts have to be shuffled for it
    texts = named.join(materialize(hits.select(*TEXT), "names"), TEXT, "left_semi").dropDuplicates(TEXT)
    cut = once(texts.join(hits, TEXT), [*TEXT, "laid"], w=words(ascii_lower(F.col("text"))))
    cut = once(cut, [*TEXT, "laid", "w"], h=F.transform("w", lambda x: F.xxhash64(x)))
    cut = once(cut, [*TEXT, "laid", "w"], grams=_grams("h", SHINGLE))
    cut = once(cut.select(*TEXT, "w", "grams", F.inline("laid")), [*TEXT, *ITEM, "size", "w", "starts", "grams", "own"], first=F.array_min("starts"), last=F.array_max("starts"))
    # windows with too few shingles that the item has at all need no fingerprint
    spread = F.greatest(F.col("size") - SHINGLE + 1, F.lit(1))
    reach = F.slice("grams", F.col("first") + 1, F.col("last") - F.col("first") + spread)
    cut = once(cut, [*TEXT, *ITEM, "size", "w", "starts", "first"], shared=F.transform(reach, lambda g: F.array_contains("own", g)))
    here = lambda s: F.slice("shared", s - F.col("first") + 1, spread)
    enough = lambda s: (100 + limits.percent) * F.size(F.filter(here(s), lambda x: x)) >= limits.percent * (F.size(here(s)) + spread)
    starts = F.when(F.col("size") < SHINGLE, F.col("starts")).otherwise(F.filter("starts", enough))
    cut = cut.select(*TEXT, *ITEM, "size", F.col("w").alias("all"), F.explode(starts).alias("start"))
    cut = once(cut, [*TEXT, *ITEM, "size", "start"], w=F.slice("all", F.col("start") + 1, F.col("size")))
    cut = once(cut, [*TEXT, *ITEM, "size", "start", "w"], hashes=_shingles(F.col("w"), True))
    cut = once(cut, [*TEXT, *ITEM, "size", "start", "w"], bits=fingerprint("hashes"))
    marked = once(distinct, [*ITEM, "size", "w"], hashes=_shingles(F.col("w"), True))
    marked = marked.select(*ITEM, "size", F.col("w").alias("item_w"), fingerprint("hashes").alias("item_bits"))
    pairs = within_radius(cut, marked, limits.radius, ("size", *ITEM))
    pairs = once(pairs, [*TEXT, *ITEM, "start"], a=_shingles(F.col("w"), False), b=_shingles(F.col("item_w"), False))
    both, either = weighted_similarity("a", "b")
    pairs = once(pairs, [*TEXT, *ITEM, "start"], s=F.struct(both.alias("both"), either.alias("either")))
    found = pairs.where(100 * F.col("s.both") >= limits.percent * F.col("s.either"))
    ranked = F.max(F.struct((F.col("s.both") / F.col("s.either")).alias("similarity"), (-F.col("start")).alias("back")))
    found = found.groupBy(*TEXT, *ITEM).agg(ranked.alias("best"), F.count(F.lit(1)).alias("n_windows"))
    found = found.join(items.select("item_id", *ITEM).distinct(), ITEM)
    return found.select(*TEXT, "item_id", "best.similarity", (-F.col("best.back")).cast("int").alias("start"), "n_windows")


def leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_windows): each document with each item that it repeats.

    A document repeats an item if a window of as many words has fingerprints within the radius and a weighted similarity of 75 % or more
    on five-word shingles (A-Z lower-cased). A document shorter than the item is one window; an item of fewer than five words is one
    shingle. similarity is that of the best window, start its first word, n_windows how many qualify.

    NULL and blank texts and items have no words and match nothing, and items without item_id are left out. Equal texts are searched once and reported for each
    row, with its doc_id or NULL. Further columns are ignored. Without documents or items the result is empty.
    """
    found = materialize(text_leaks(docs, benchmark, limits), "leaks")
    keyed = docs.select("doc_id", *_key(text_or_empty(), TEXT))
    return keyed.join(found, TEXT).drop(*TEXT)


def without_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of `docs`, with all columns, whose text repeats no item; the cases are those of `leaks`."""
    found = materialize(text_leaks(docs, benchmark, limits).select(*TEXT).distinct(), "leaks")
    keyed = packed(docs).select("_row", *_key(F.coalesce(F.col("_row.text"), F.lit("")), TEXT))
    return keyed.join(found, TEXT, "left_anti").select("_row.*")
