"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A seed mask reads some of the tokens at a position and ignores those between, so that a substituted token breaks only
the seeds that read it. Seeds of all benchmark items and of all document positions are joined by hash; each hit fixes
an alignment, on which the windows that hold the seed are compared token by token.

One rule holds for items of every length: a window of the item's tokens, WINDOW of them or all that it has, must agree
with the document in SHARE of its tokens (13 of 16, 9 of 11, 4 of 5, all of 4 and fewer). For each length there are
masks that, together, hit every pattern of substitutions that the rule allows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a compared window (items of fewer tokens are one window), and the share of them that must agree.
WINDOW, SHARE = 16, 0.8
#: Least and greatest number of an item's tokens, and its masks: found by search, and proven by enumeration in the tests.
FAMILIES = (
    (WINDOW, None, ((0, 2, 3, 6, 7, 8), (0, 1, 2, 7, 9, 10))),
    (11, WINDOW - 1, ((0, 2, 3, 6, 7, 8), (0, 1, 2, 7, 9, 10), (0, 1, 2, 3, 5))),
    (6, 10, ((0, 1, 2, 3), (0, 1, 3, 4))),
    (5, 5, ((0, 1, 2), (0, 1, 3))),
    (4, 4, ((0, 1, 2, 3),)),
    (3, 3, ((0, 1, 2),)),
    (2, 2, ((0, 1),)),
    (1, 1, ((0,),)),
)
#: Positions of a block of tokens.
STEP = 16
#: Most benchmark seeds that are broadcast (rows of 48 bytes: 12 MB); beyond it, seeds are joined by a shuffle.
BROADCAST_SEEDS = 250_000


def tokens(text: Column) -> Column:
    """Runs of letters and numbers in lower case, each as a 32-bit hash, which is all that is compared."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.hash(w))


def needed(window: int) -> int:
    """Tokens of a window that must agree."""
    return math.ceil(window * SHARE)


def seed(t: Column, at: Column, number: int, mask: tuple[int, ...]) -> Column:
    """Hash of the mask's tokens at a place of an array; null where the mask reaches beyond the tokens."""
    read = [F.get(t, at + o) for o in mask]
    return F.when(read[-1].isNotNull(), F.xxhash64(F.lit(number), *read))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once: the optimiser would copy its expression into the functions that read it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def seeds(df: DataFrame, masks: dict[int, tuple[int, ...]], t: Column) -> DataFrame:
    """``df`` without ``text``, with a row for each position and mask that fits: adds ``at``, ``key``, ``span``, and ``cut`` with ``own``.

    ``cut`` has the tokens of a block of a few positions and WINDOW - 1 more on either side (null before the first), the
    position's own token at index ``own``. Everything that a hit is verified against travels in its row, so that neither
    texts nor hits are gathered by document, and a long text costs no more a token than a short one.
    """
    margin = WINDOW - 1
    starts = lambda t: F.sequence(F.lit(0), F.greatest(F.size(t) - 1 - margin, F.lit(0)), F.lit(STEP))
    padded = F.concat(F.array_repeat(F.lit(None).cast("int"), margin), t)
    blocks = bound(padded, lambda t: F.transform(starts(t), lambda i: F.slice(t, i + 1, STEP + 2 * margin)))
    kept = [c for c in df.columns if c != "text"]
    rows = df.select(*kept, F.posexplode(blocks).alias("block", "cut"))
    rows = rows.select(*kept, "block", "cut", F.explode(F.array(*[F.lit(margin + i) for i in range(STEP)])).alias("own"))
    keys = F.array(*[seed(F.col("cut"), F.col("own"), n, m) for n, m in masks.items()])
    rows = rows.select(*kept, (F.col("block") * STEP + F.col("own") - margin).alias("at"), "own", "cut", keys.alias("keys"))
    rows = rows.select(*kept, "at", "own", "cut", F.posexplode("keys").alias("j", "key")).where("key IS NOT NULL")
    span = F.get(F.array(*[F.lit(m[-1] + 1) for m in masks.values()]), F.col("j"))
    return rows.select(*kept, "key", "at", "own", span.alias("span"), "cut")


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``item_id``, ``matches`` (agreeing tokens of the best window), ``window`` and ``start`` (index of that
    window's first token in the document, the first of equals) for each document and item that overlap.

    Null texts and texts without words overlap with nothing; an item of one to four words overlaps with every text that
    has them in a row. Repeated rows of documents or items give one row for each pair of identifiers, the best of them.
    Null identifiers are kept as they are. Empty tables give no rows; further columns are not read.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("b")).where(F.size("b") > 0).distinct()
    sizes = [r[0] for r in items.select(F.least(F.size("b"), F.lit(WINDOW)).alias("n")).distinct().collect()]
    families = [f for f in FAMILIES if any(f[0] <= n <= (f[1] or WINDOW) for n in sizes)]
    numbers = {m: i for i, m in enumerate(dict.fromkeys(m for *_, masks in FAMILIES for m in masks))}
    used = {numbers[m]: m for *_, masks in families for m in masks}
    wanted = None
    for least, most, masks in families or FAMILIES[:1]:
        own = items.where((F.size("b") >= least) & (F.size("b") <= (most or 1 << 30)))
        rows = seeds(own, {numbers[m]: m for m in masks}, F.col("b"))
        # The first window that holds the whole seed: a mask of a short span may lie farther into it.
        low = F.greatest(F.lit(0), F.col("at") + F.col("span") - WINDOW)
        rows = rows.select("key", "item_id", F.col("at").alias("pos"), low.alias("low"))
        wanted = rows if wanted is None else wanted.union(rows)
    wanted = wanted.distinct()
    known = items.select(F.col("item_id").alias("known_id"), "b")
    if wanted.count() <= BROADCAST_SEEDS:  # then there are no more items than seeds either
        wanted, known = F.broadcast(wanted), F.broadcast(known)
    found = seeds(docs.select(key, "text"), used or {0: FAMILIES[0][2][0]}, tokens(F.col("text")))
    hits = found.join(wanted, "key").join(known, F.col("item_id").eqNullSafe(F.col("known_id")))
    window = F.least(F.size("b"), F.lit(WINDOW))
    last = F.least(F.col("pos"), F.size("b") - F.col("window"))  # the last window that holds the seed
    rows = hits.withColumn("window", window).select(key, "item_id", "window", "cut", "at", "own", (F.col("own") - F.col("pos") + F.col("low")).alias("first"), (last - F.col("low")).alias("more"), F.slice("b", F.col("low") + 1, last - F.col("low") + F.col("window")).alias("b"))
    agree = F.transform("b", lambda x, k: F.coalesce((F.get("cut", F.col("first") + k) == x).cast("int"), F.lit(0)))
    rows = rows.where("more >= 0").withColumn("agree", agree)
    windows = F.transform(
        F.sequence(F.lit(0), F.col("more")),
        lambda s: F.struct(
            F.aggregate(F.slice("agree", s + 1, F.col("window")), F.lit(0), lambda a, x: a + x).alias("matches"),
            (F.col("own") - F.col("at") - F.col("first") - s).alias("back"),
            (F.get("cut", F.col("first") + s).isNotNull() & F.get("cut", F.col("first") + s + F.col("window") - 1).isNotNull()).alias("inside"),
        ),
    )
    enough = F.ceil(F.col("window") * F.lit(SHARE)).cast("int")
    best = F.array_max(F.filter(windows, lambda w: w["inside"] & (w["matches"] >= enough)))
    found = rows.select(key, "item_id", "window", best.alias("best")).where("best IS NOT NULL")
    pairs = found.groupBy(key, "item_id").agg(F.max(F.struct(F.col("best.matches"), F.col("best.back"), F.col("window"))).alias("m"))
    return pairs.select(key, "item_id", F.col("m.matches").alias("matches"), F.col("m.window").alias("window"), (-F.col("m.back")).alias("start"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) that overlap with no item.

    Texts decide, by their digests: rows that share a doc_id, and rows without one, stay or go by their own text. Null
    and empty texts stay, repeated rows stay or go together, columns of any name pass through, an empty table stays empty.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = overlaps(docs.select(digest.alias("digest"), "text"), benchmark, "digest")
    # Reversed: a key that no grouping has dealt yet, so that adaptive execution can split a hot text's rows.
    gone = found.select(F.reverse("digest").alias("gone")).distinct()
    return docs.join(gone, F.reverse(digest) == F.col("gone"), "left_anti")
