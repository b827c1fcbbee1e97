"""Vector bin packing of documents into shards that are level in bytes, tokens and rows at once.

Documents with equal text form a group, and a group goes to one shard unless it outweighs a whole one. Groups are first
hashed into a fixed number of tiles, so what is packed has a fixed bound however large the corpus is; a group that holds
more than a tile's share of the bytes, tokens or rows is an item of its own, worked on in pieces of a tile's size. Only a
group with more than a shard's fair share of any of them is dealt out, piece by piece. Items are placed, largest first, on
the shard whose residual capacity has the highest dot product with the item's (bytes, tokens, rows).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofly.llm.common import stash

OVERHEAD = 8  # bytes a row costs besides its text
PIECE = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"  # what subword tokenizers cut a text into beforehand: counted as tokens


def pack_vectors(items: np.ndarray, bins: int, weights=(2.0, 1.0, 1.0)) -> np.ndarray:
    """Bin of each item (rows of non-negative sizes): largest first, on the bin with the highest dot product.

    A bin that an item overfills in no dimension comes before one that it overfills. Ties go to the lower bin, equal
    items keep their order. No items: an empty result.
    """
    total = items.sum(axis=0)
    share = items / np.where(total > 0, total, 1) * bins  # 1: one bin's fair part
    weigh = np.asarray(weights, float)
    free, out = np.ones((bins, items.shape[1])), np.zeros(len(items), np.int64)
    for i in np.argsort(-share.max(axis=1, initial=0), kind="stable"):
        fits = (free >= share[i] - 1e-12).all(axis=1)
        score = free @ (weigh * share[i])
        best = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        out[i] = best
        free[best] -= share[i]
    return out


def shard_documents(docs: DataFrame, *, shards: int = 24, tiles: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in a shard), grown_shard (null).

    Null text counts as empty; a document's size is its UTF-8 bytes plus OVERHEAD. Repeated rows stay and get slots of
    their own. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stash(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("grp"),
            F.regexp_count(text, F.lit(PIECE)).cast("long").alias("tokens"),
            F.monotonically_increasing_id().alias("row"),  # fixed as it's written
        ),
        "shard-rows",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]
    total = rows.agg(*sums).first()
    share = F.greatest(*(F.col(c) / F.lit(max(total[c] or 0, 1)) for c in ("size", "tokens", "n")))
    large = rows.groupBy("grp").agg(*sums).select("grp", F.ceil(share * tiles).alias("parts"), (share * shards <= 1).alias("whole")).filter("parts > 1")  # 3 x tiles at most
    piece = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), "parts"))
    item = F.when(F.col("parts").isNull(), F.pmod("grp", F.lit(tiles))).when(F.col("whole"), F.col("grp")).otherwise(F.xxhash64("grp", "piece"))
    dealt = rows.join(F.broadcast(large), "grp", "left").withColumn("piece", piece).withColumn("item", item)
    # At most `tiles` plain tiles and 6 x tiles pieces of large groups, so this fits the driver at any input size.
    found = sorted(dealt.groupBy("item", "piece").agg(*sums).collect(), key=lambda r: (r["item"], r["piece"]))
    names = sorted({r["item"] for r in found})
    place, sizes = {x: i for i, x in enumerate(names)}, np.zeros((len(names), 3))
    for r in found:
        sizes[place[r["item"]]] += (r["size"], r["tokens"], r["n"])
    placed = pack_vectors(sizes, shards).tolist()
    base, where = [0] * shards, []
    for r in found:
        s = placed[place[r["item"]]]
        where.append((r["item"], r["piece"], s, base[s]))
        base[s] += r["n"]
    spots = docs.sparkSession.createDataFrame(where, "item long, piece long, shard int, base long")
    turn = F.row_number().over(Window.partitionBy("item", "piece").orderBy("doc_id", "row"))
    return (
        dealt.withColumn("turn", turn)
        .join(F.broadcast(spots), ["item", "piece"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("turn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
