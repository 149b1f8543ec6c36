"""Near-duplicate embeddings by iterative quantisation.

Rotations that make balanced binary codes are learned on a bounded sample (FIT_ROWS distinct vectors, chosen by hash):
the code of a vector is the signs of its rotated principal components. Codes are cut into short substrings, each of
which is a Hamming table; two vectors meet where a substring agrees. How many tables there are follows from the
sample: so many that a pair right at the threshold is found with probability RECALL. Vectors that meet are reranked
by their cosine in double precision, tile by tile, and a pair counts in the first table where it meets, so each link
is counted once. Only counts and a star of links for each tile leave a task, never all pairs.

Equal vectors of a label are one row until the end, so large groups of copies cost nothing. A full table entry is
dealt into squares of tiles of TILE rows.

Defined cases: a vector that is null, empty, zero or has null or non-finite components, a null label, or a null
vec_id links with nothing; rows that repeat a vector are linked copies; vectors of different length are never
compared; rows that share a vec_id but not the vector each have links of their own; ties of the component go to the
smallest vec_id; an empty table gives no rows. Columns other than vec_id, embedding and label are not read.

A table entry that n distinct vectors share is compared in (n / TILE)^2 / 2 squares, so a crowd of n near copies with
distinct vectors sends n^2 / TILE rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, join_classes, staged
from .components import Forest, components

THRESHOLD, RECALL = 0.93, 0.995
FIT_ROWS, ITERATIONS = 8192, 30
#: Rows of a table entry that the substring length aims at, and rows compared in one piece.
ENTRY, TILE = 48, 512
SWEEP_ROWS = 50_000
SEED = 7


def learn(sample, bits: int):
    """Rotation, d x bits, by iterative quantisation of a sample of unit vectors.

    Vectors are not centred: all planes pass through the origin, so that close angles agree in most bits however
    crowded the data are (centring would cut a crowd of near copies into random codes); the rotation spreads the
    variance over all bits, which is what balances them.
    """
    import numpy as np

    d = sample.shape[1]
    _, _, axes = np.linalg.svd(sample.T @ sample / max(1, len(sample)))
    rng = np.random.default_rng(SEED)
    out = []
    while sum(w.shape[1] for w in out) < bits:
        k = min(d, bits - sum(w.shape[1] for w in out))
        own = axes[:k].T if not out else axes.T @ np.linalg.qr(rng.normal(size=(d, d)))[0][:, :k]
        v = sample @ own
        turn = np.linalg.qr(rng.normal(size=(k, k)))[0]
        for _ in range(ITERATIONS):
            u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
            turn = (u @ w).T
        out.append(own @ turn)
    return np.hstack(out)


def tables_for(flip: float, width: int) -> int:
    """Tables of `width` bits, so that a pair whose bits differ with probability `flip` meets with probability RECALL."""
    meet = (1 - flip) ** width
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))) if meet < 1 else 1


def _tiles(batches: Iterator) -> Iterator:
    """Counts of linked vectors by row (kind 0) and stars of linked rows (kind 1), of tiles that come together."""
    import numpy as np
    import pyarrow as pa

    def links(tab: pa.Table):
        node, copies, side = (tab[c].to_numpy() for c in ("node", "copies", "side"))
        table = tab["t"].to_numpy()
        entry = np.stack([tab[c].to_numpy() for c in ("space", "t", "key", "x", "y")])
        cut = np.concatenate([[0], np.nonzero((entry[:, 1:] != entry[:, :-1]).any(axis=0))[0] + 1, [len(node)]])
        vectors = tab["v"].combine_chunks()
        at, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
        codes = tab["codes"].combine_chunks()
        code_at, code_values = codes.offsets.to_numpy(), codes.values.to_numpy()
        counts, forest = np.zeros(len(node), np.int64), Forest(len(node))
        for lo, hi in zip(cut.tolist(), cut[1:].tolist()):
            if hi - lo < 2:
                continue
            x = values[at[lo] : at[hi]].reshape(hi - lo, -1)
            c = code_values[code_at[lo] : code_at[hi]].reshape(hi - lo, -1)
            for a in range(lo, hi, TILE):
                b = min(hi, a + TILE)
                near = x[a - lo : b - lo] @ x.T >= THRESHOLD
                near &= np.arange(a, b)[:, None] < np.arange(lo, hi)[None, :]
                if side[lo] >= 0 or side[hi - 1] >= 0:
                    near &= side[a:b, None] != side[None, lo:hi]
                i, j = np.nonzero(near)
                earlier = np.zeros(len(i), bool)
                for t in range(int(table[lo])):
                    earlier |= c[i + a - lo, t] == c[j, t]
                i, j = i[~earlier] + a, j[~earlier] + lo
                np.add.at(counts, i, copies[j])
                np.add.at(counts, j, copies[i])
                forest.link(i, j)
        some = np.nonzero(counts)[0]
        rows, roots = forest.edges()
        kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(rows), np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([node[some], node[rows]])), pa.array(np.concatenate([counts[some], node[roots]]))], ["kind", "a", "b"])

    held: list = []
    names = ("space", "t", "key", "x", "y")
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= SWEEP_ROWS:
            tab = pa.Table.from_batches(held).combine_chunks()
            same = np.logical_and.reduce([tab[c].to_numpy() == tab[c][-1].as_py() for c in names])
            cut = int(np.argmax(same))
            if cut:
                yield links(tab.slice(0, cut).combine_chunks())
                held = tab.slice(cut).combine_chunks().to_batches()
    if held:
        yield links(pa.Table.from_batches(held).combine_chunks())


def _unit(v: F.Column) -> F.Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


def linked(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (size > 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    useful = rows.where("good")
    points = useful.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # a number for each distinct vector, fixed by being written
    points = staged(points.withColumn("node", F.monotonically_increasing_id()), "points")
    spaces = points.groupBy("label", F.size("v").alias("d")).agg(F.count("*").alias("n"))
    most = spaces.agg(F.max("n").alias("n"), F.max("d").alias("d"), F.sum("n").alias("all")).first()
    if most["n"] is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = _links(points, int(most["n"]), int(most["all"]))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    of = components(found.where("kind = 1"), "a", "b")
    facts = points.select("node", "least", "copies").join(counts, "node", "left").join(of, "node", "left")
    facts = staged(facts.select("node", "least", "copies", "others", F.coalesce("component", "node").alias("group")), "facts")
    roots = facts.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    facts = join_classes(facts, roots, ["group"], int(most["all"])).select("node", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    facts = points.select("node", "label", "v").join(facts, "node").select("label", "v", "n_links", "component_id", F.col("copies").alias("_n"))
    members = join_classes(useful.select("vec_id", "label", "v"), facts, ["label", "v"], useful.count(), "inner").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(points: DataFrame, n: int, total: int) -> DataFrame:
    """(kind, a, b) from all tables; n: rows of the largest label, total: rows of points."""
    import numpy as np

    spark = points.sparkSession
    unit = staged(points.select("label", "node", "copies", _unit(F.col("v")).alias("v")), "unit")
    chosen = hash_sample(unit, FIT_ROWS, total, "node").orderBy(F.xxhash64("node"), "node").limit(FIT_ROWS).select("v").toPandas()
    width = max(4, min(24, math.ceil(math.log2(max(2, n / ENTRY)))))
    models = {}
    for dim, part in chosen.groupby(chosen["v"].map(len)):
        sample = np.stack(part["v"].to_numpy())
        # how often a bit differs between vectors right at the threshold: random pairs of that angle
        rng = np.random.default_rng(SEED)
        base = sample[rng.integers(0, len(sample), 2000)]
        off = rng.normal(size=base.shape)
        off -= (off * base).sum(axis=1, keepdims=True) * base
        off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
        pair = THRESHOLD * base + math.sqrt(1 - THRESHOLD**2) * off
        turn = learn(sample, int(dim))
        flip = float(np.mean((base @ turn > 0) != (pair @ turn > 0)))
        tables = tables_for(flip, width)
        models[int(dim)] = (learn(sample, tables * width), tables)
    shared = spark.sparkContext.broadcast(models)

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column("v")
            at, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
            codes = []
            for i, j in zip(at.tolist(), at[1:].tolist()):
                model = shared.value.get(j - i)
                if model is None:
                    codes.append([0])  # a length that the sample lacks: all its vectors meet in one table
                    continue
                turn, tables = model
                bits = values[i:j] @ turn > 0
                codes.append(bits.reshape(tables, width) @ (1 << np.arange(width)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.asarray(c, np.int32) for c in codes], pa.list_(pa.int32()))], [*batch.schema.names, "codes"])

    coded = staged(unit.mapInArrow(encode, "label string, node long, copies long, v array<double>, codes array<int>"), "codes")
    coded = coded.withColumn("space", F.xxhash64("label", F.size("v")))
    entries = coded.select("space", "node", F.posexplode("codes").alias("t", "key"))
    full = entries.groupBy("space", "t", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    full = full.select("space", "t", "key", F.ceil(F.col("n") / TILE).cast("int").alias("pieces"))
    placed = coded.select("space", "node", "copies", "v", "codes", F.posexplode("codes").alias("t", "key")).join(full, ["space", "t", "key"], "left")
    placed = placed.withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("pieces"))).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    tiles = placed.select(
        "space", "t", "key", F.least("piece", "other").alias("x"), F.greatest("piece", "other").alias("y"),
        F.when(F.col("piece") == F.col("other"), -1).otherwise(F.col("piece")).alias("side"), "node", "copies", "v", "codes",
    )
    return staged(tiles.repartition("space", "t", "key", "x", "y").sortWithinPartitions("space", "t", "key", "x", "y").mapInArrow(_tiles, "kind int, a long, b long"), "found")


def op1(vectors: DataFrame) -> DataFrame:
    return linked(vectors)
