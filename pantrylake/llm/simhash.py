"""SimHash near-duplicates through pivot distance tables.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's 3-word shingles. Each distinct fingerprint gets
its Hamming distances to fixed reference fingerprints (the pivot table) once. Pairs within 3 bits agree on one whole
part of a split of the bits, so rows meet only inside such a part (exact, by the pigeonhole principle); there a sweep
over the first pivot distance and the largest coordinate difference to all pivots discard pairs (the triangle
inequality: over 3 means over 3 bits apart), and the survivors are verified bit by bit.

Defined cases: a null or empty text has no words, so its fingerprint is 0 and links like any other; fewer than three
words are one shingle; repeated rows share a fingerprint and a class; rows of one doc_id with different texts each have
the class of their own fingerprint; a row without doc_id links like any other and gets the class of its fingerprint
(null where no row of the class has an id); an empty table gives no rows. Columns other than doc_id and text are not
read.

A part that n distinct fingerprints share is compared in (n / TILE)^2 / 2 squares, so a crowd of n near copies with
distinct fingerprints sends n^2 / TILE rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, join_classes, map_arrow, staged
from .components import Forest, components

BITS, SHINGLE, SEED, MAX_BITS = 64, 3, 42, 3
#: Reference fingerprints: multiples of an odd constant, so that their bits look independent.
PIVOTS = [(k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) for k in range(1, 17)]
#: Rows of one part that are compared in one piece; fuller parts are dealt into squares of such pieces.
TILE = 512
#: Rows held at once while a partition is swept.
SWEEP_ROWS = 200_000


def fingerprint_bytes(raw: bytes) -> int:
    """The fingerprint of one text, unsigned."""
    import numpy as np
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(text, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[i:j], SEED) for i, j in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(major, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    from .pieces import slices, text_bytes

    for batch in slices(batches):
        data, at = text_bytes(batch.column("text"))
        at = at.tolist()
        found = np.array([fingerprint_bytes(data[i:j].tobytes()) for i, j in zip(at, at[1:])], np.uint64)
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found.view(np.int64))], [*names, "fp"])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, *more, fp): the signed 64-bit fingerprint of every whole text."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return map_arrow(picked, _fingerprints, picked.drop("text").withColumn("fp", F.lit(0).cast("long")).schema)


def parts_for(n: int) -> int:
    """Parts to split the bits into, so that few of n fingerprints agree by chance on all but MAX_BITS of them."""
    parts = MAX_BITS + 1
    while parts < 8 and n > 8 * 2 ** (BITS * (parts - MAX_BITS) // parts):
        parts += 1
    return parts


def part_masks(parts: int) -> list[int]:
    """One mask for each choice of the parts that stay equal."""
    cut = [round(BITS * k / parts) for k in range(parts + 1)]
    span = [((1 << cut[k + 1]) - 1) ^ ((1 << cut[k]) - 1) for k in range(parts)]
    return [sum(span[k] for k in kept) for kept in combinations(range(parts), parts - MAX_BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sweep(batches: Iterator) -> Iterator:
    """Star links of the rows of each tile that lie within MAX_BITS; rows come sorted by tile, then first distance."""
    import numpy as np
    import pyarrow as pa

    from .pieces import give_back

    def links(tab: pa.Table):
        node, fp = tab["node"].to_numpy(), tab["fp"].to_numpy().view(np.uint64)
        side = tab["side"].to_numpy()
        tile = np.stack([tab[c].to_numpy() for c in ("t", "key", "x", "y")])
        group = np.concatenate([[0], np.cumsum((tile[:, 1:] != tile[:, :-1]).any(axis=0))])
        pivots = np.frombuffer(tab["pivots"].combine_chunks().cast(pa.large_binary()).buffers()[2], np.uint8)[: len(node) * len(PIVOTS)].reshape(len(node), -1).astype(np.int16)
        forest = Forest(len(node))
        left, lag = np.arange(len(node)), 1
        while True:
            left = left[left + lag < len(node)]
            right = left + lag
            near = (group[left] == group[right]) & (pivots[right, 0] - pivots[left, 0] <= MAX_BITS)
            left = left[near]  # sorted: a row past its window stays past it
            if not len(left):
                break
            right = left + lag
            # in a square of two pieces, pairs of one piece belong to that piece's own tile
            keep = (side[left] < 0) | (side[left] != side[right])
            i, j = left[keep], right[keep]
            ok = np.abs(pivots[i] - pivots[j]).max(axis=1, initial=0) <= MAX_BITS
            i, j = i[ok], j[ok]
            same = np.bitwise_count(fp[i] ^ fp[j]) <= MAX_BITS
            forest.link(i[same], j[same])
            lag += 1
        rows, roots = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(node[roots])], ["a", "b"])

    held: list = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= SWEEP_ROWS:
            tab = pa.Table.from_batches(held).combine_chunks()
            last = [tab[c][-1].as_py() for c in ("t", "key", "x", "y")]
            same = np.logical_and.reduce([tab[c].to_numpy() == v for c, v in zip(("t", "key", "x", "y"), last)])
            cut = int(np.argmax(same))
            if cut:
                yield links(tab.slice(0, cut).combine_chunks())
                held = tab.slice(cut).combine_chunks().to_batches()
    if held:
        yield links(pa.Table.from_batches(held).combine_chunks())
    held.clear()
    give_back()


def near_links(points: DataFrame, n: int) -> DataFrame:
    """(a, b): links that connect all nodes within MAX_BITS of each other. points: node long, fp long, both distinct."""
    masks = part_masks(parts_for(n))
    distances = F.concat(*[F.unhex(F.lpad(F.hex(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))))), 2, "0")) for p in PIVOTS])
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    keyed = points.withColumn("pivots", distances).select("node", "fp", "pivots", F.posexplode(keys).alias("t", "key"))
    full = keyed.groupBy("t", "key").count().where(F.col("count") > TILE).select("t", "key", F.ceil(F.col("count") / TILE).cast("int").alias("pieces"))
    dealt = keyed.join(full, ["t", "key"], "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("pieces"))).cast("int"))
    # a fuller part: a row goes to its own piece's tile and to a square with each other piece
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1))
    tiles = dealt.withColumn("other", other).select(
        "node", "fp", "pivots", "t", "key",
        F.least("piece", "other").alias("x"), F.greatest("piece", "other").alias("y"),
        F.when(F.col("piece") == F.col("other"), -1).otherwise(F.col("piece")).alias("side"), F.substring("pivots", 1, 1).alias("first"),
    )
    return tiles.repartition("t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y", "first").mapInArrow(_sweep, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): every document with the smallest doc_id reachable over links of at most MAX_BITS."""
    found = staged(fingerprints(docs), "fingerprints")
    points = staged(found.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("_n")), "points")
    of = components(near_links(points.select(F.col("fp").alias("node"), "fp"), points.count()), "a", "b")
    grouped = points.join(of.withColumnRenamed("node", "_node"), F.col("fp") == F.col("_node"), "left").select("fp", "node", "_n", F.coalesce("component", "fp").alias("group"))
    grouped = staged(grouped, "groups")
    least = grouped.groupBy("group").agg(F.min("node").alias("component_id"))
    classes = grouped.join(least, "group").select("fp", "component_id", "_n")
    return join_classes(found, classes, ["fp"], found.count()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group stays: that with the smallest doc_id, then fingerprint, then text.

    Groups are of fingerprints, so an id that repeats with unrelated texts counts in each of their groups. Rows without
    doc_id cannot be told apart and all stay. Whole rows are dealt anew only where the ids that go are too many to
    broadcast.
    """
    found = staged(fingerprints(docs).where("doc_id is not null"), "fingerprints")
    points = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n")), "points")
    of = components(near_links(points.select(F.col("fp").alias("node"), "fp"), points.count()), "a", "b")
    points = points.join(of, F.col("fp") == F.col("node"), "left").select("fp", "first", "_n", F.coalesce("component", "fp").alias("group"))
    best = staged(points.groupBy("group").agg(F.min(F.struct("first", "fp")).alias("best")), "best")
    stays = staged(points.join(best, "group").select("fp", F.col("best.first").alias("_stay"), F.col("best.fp").alias("_fp"), "_n"), "stays")
    gone = join_classes(found, stays, ["fp"], found.count()).where("doc_id != _stay or fp != _fp").select(F.col("doc_id").alias("_gone"))
    again = staged(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "again")
    repeated = not again.isEmpty()
    left = staged((gone.unionByName(again.toDF("_gone")) if repeated else gone).distinct(), "gone")
    kept = docs.alias("_d").join(checked_broadcast(left).alias("_g"), F.col("_d.doc_id").cast("long") == F.col("_g._gone"), "left_anti")
    if repeated:  # such an id says nothing of the text: these rows are told apart by fingerprint as well
        some = docs.alias("_d").join(checked_broadcast(again).alias("_g"), F.col("_d.doc_id").cast("long") == F.col("_g._again"), "left_semi")
        some = some.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
        pairs = best.select(F.col("best.first").alias("doc_id"), F.col("best.fp").alias("fp"))
        some = fingerprints(some, "_row").join(pairs, ["doc_id", "fp"], "left_semi")
        least = F.min_by("_row", F.struct(F.coalesce(F.col("_row.text").cast("string"), F.lit("")), F.to_json("_row")))
        kept = kept.unionByName(some.groupBy("doc_id", "fp").agg(least.alias("_row")).select("_row.*"))
    return kept


def op9(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
