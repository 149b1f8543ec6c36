"""Token ids in a content-addressed store.

A rolling hash over the last WINDOW ids cuts each document's id stream into chunks where the content says so, so equal
passages give equal chunks. Each distinct chunk is stored once under its BLAKE2b digest; a document is a recipe (the
digests of its chunks in order, with a Merkle root over them), recipes lie in ascending doc_id order, and a manifest
holds a Merkle root for each range of recipes and one for the store. Reading checks every digest and root.

Layout (Parquet): chunks(digest, n, payload), payload: little-endian unsigned 16-bit ids (32-bit if the vocabulary
needs it: a recipe states the width); recipes(bucket, doc_id, row, n_tokens, start, width, recipe, root);
manifest(bucket, documents, tokens, root).

Defined cases: a null text counts as empty and is its end id alone; repeated rows and rows without doc_id (first in
order) each have a recipe of their own; ties of doc_id are ordered by where they were encoded (task, then row), so an
id that many rows share, or none, is dealt over many buckets; a control string of the vocabulary in a text becomes its
id, as the tokenizers library has it (controls=False: ordinary text); an empty table gives an empty store. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, drop_path, fresh_path, range_bucket, running_start

END, VOCABULARY = 2, "byte_bpe_50k.json"
WINDOW, LEAST, MOST, MASK_BITS, DIGEST = 16, 64, 2048, 8, 16
#: A task leaves out payloads that it has written already; it remembers at most this many digests.
REMEMBERED = 1 << 20


def _digest(data: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Binary tree over digests; an odd one out moves up as it is; no leaf gives the digest of nothing."""
    level = list(leaves) or [_digest(b"")]
    while len(level) > 1:
        level = [_digest(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _rolling(ids):
    """Hash of the last WINDOW ids at each place, by doubling."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        step = 1
        while step < WINDOW:
            h[step:] = h[step:] + h[:-step] * np.uint64(pow(0xD6E8FEB86659FD93, step, 1 << 64))
            step *= 2
    return h


def cuts(hashes, candidates, begin: int, end: int) -> list[int]:
    """Ends of the chunks of ids[begin:end], from the places where the hash allows a cut."""
    import numpy as np

    out, at = [], begin
    k = int(np.searchsorted(candidates, begin + LEAST))
    while end - at > LEAST:
        while k < len(candidates) and candidates[k] < at + LEAST:
            k += 1
        to = int(candidates[k]) if k < len(candidates) else end
        to = min(to, at + MOST)
        if to >= end:
            break
        out.append(to)
        at = to
    return [*out, end] if end > at else out


def _encoded(vocabulary: str, controls: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .packing import vocabulary_path
        from .pieces import encoder, slices, text_bytes

        tool = encoder(vocabulary_path(vocabulary), "gpt", controls)
        width, part, row, seen = tool.width, TaskContext.get().partitionId(), 0, set()
        for batch in slices(batches):
            data, edges = text_bytes(batch.column("text"))
            ids, counts = tool.encode(data, edges)
            ends = np.cumsum(counts + 1)
            full = np.empty(int(ends[-1]) if len(ends) else 0, f"<u{width}")
            is_end = np.zeros(len(full), bool)
            is_end[ends - 1] = True
            full[is_end], full[~is_end] = END, ids
            hashes = _rolling(full)
            candidates = np.nonzero(hashes >> np.uint64(64 - MASK_BITS) == 0)[0]
            raw = full.tobytes()
            doc_ids = batch.column("doc_id").to_pylist()
            out: dict[str, list] = {k: [] for k in ("doc_id", "row", "n", "digest", "payload", "width", "recipe", "root")}
            for doc, begin, end in zip(doc_ids, (ends - counts - 1).tolist(), ends.tolist()):
                digests, at = [], begin
                for to in cuts(hashes, candidates, begin, end):
                    payload = raw[width * at : width * to]
                    digests.append(_digest(payload))
                    if digests[-1] not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(digests[-1])
                        for k, v in (("doc_id", None), ("row", None), ("n", to - at), ("digest", digests[-1]), ("payload", payload), ("width", width), ("recipe", None), ("root", None)):
                            out[k].append(v)
                    at = to
                for k, v in (("doc_id", doc), ("row", (part << 32) + row), ("n", end - begin), ("digest", None), ("payload", None), ("width", width), ("recipe", b"".join(digests)), ("root", merkle_root(digests))):
                    out[k].append(v)
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return run


_STAGED = "doc_id long, row long, n long, digest binary, payload binary, width int, recipe binary, root binary"


def _manifest_rows(batches: Iterator) -> Iterator:
    """Roots of runs of recipes that come sorted by bucket, then place."""
    import pyarrow as pa

    bucket, docs, tokens, leaves = None, 0, 0, []

    def done():
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([merkle_root(leaves)], pa.binary())], ["bucket", "documents", "tokens", "root"])

    for batch in batches:
        for b, n, root in zip(*(batch.column(k).to_pylist() for k in ("bucket", "n_tokens", "root"))):
            if b != bucket:
                if bucket is not None:
                    yield done()
                bucket, docs, tokens, leaves = b, 0, 0, []
            docs, tokens = docs + 1, tokens + n
            leaves.append(root)
    if bucket is not None:
        yield done()


def _manifest(recipes: DataFrame) -> DataFrame:
    return recipes.select("bucket", "start", "doc_id", "row", "n_tokens", "root").repartition("bucket").sortWithinPartitions("bucket", "start", "row").mapInArrow(_manifest_rows, "bucket long, documents long, tokens long, root binary")


def write_store(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, controls: bool = True) -> None:
    """Encode all documents and write chunks, recipes and manifest under `path`."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staging = fresh_path(spark, "encoded")
    rows.mapInArrow(_encoded(vocabulary, controls), _STAGED).write.option("compression", "zstd").parquet(staging)
    encoded = spark.read.schema(_STAGED).parquet(staging)
    recipes = encoded.where("digest IS NULL").select("doc_id", "row", F.col("n").alias("n_tokens"), "width", "recipe", "root")
    task = F.shiftright("row", 32)
    tasks = recipes.agg(F.max(task)).first()[0] or 0
    recipes = recipes.withColumn("bucket", range_bucket(recipes, "doc_id", bucket_count(spark), task / (tasks + 1))[0])
    recipes = running_start(recipes, "bucket", [F.col("doc_id"), F.col("row")], F.col("n_tokens"), "start")
    recipes.repartitionByRange("bucket").sortWithinPartitions("bucket", "start", "row").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(spark.read.parquet(f"{path}/recipes")).write.option("compression", "zstd").parquet(f"{path}/manifest")
    chunks = encoded.where("digest IS NOT NULL").groupBy("digest").agg(F.first("n").alias("n"), F.first("width").alias("width"), F.first("payload").alias("payload"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    drop_path(spark, staging)


def _read_chunks(batches: Iterator) -> Iterator:
    """Check each chunk against its digest; give the checksum of its ids as 32-bit integers."""
    import zlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        digests, payloads, widths = (batch.column(k).to_pylist() for k in ("digest", "payload", "width"))
        for d, p in zip(digests, payloads):
            if _digest(p) != d:
                raise ValueError(f"chunk {d.hex()} does not match its digest")
        crc = [zlib.crc32(np.frombuffer(p, f"<u{w}").astype("<u4").tobytes()) for p, w in zip(payloads, widths)]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([len(p) // w for p, w in zip(payloads, widths)], pa.int64()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])


def _times(a, b):
    """Products of polynomials over GF(2) modulo that of CRC-32, bit-reversed as CRC-32 is; element by element."""
    import numpy as np

    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return out


def _shifts(n: int):
    """x**(32 * k) for k = 0..n-1: what appending k ids multiplies a checksum by."""
    import numpy as np

    one = np.array([0x80000000], np.uint32)
    step = one >> np.uint32(31)  # x**31
    step = _times(step, one >> np.uint32(1))  # x**32
    table = one
    while len(table) < n:
        top = _times(table[-1:], step)
        table = np.concatenate([table, _times(table, np.repeat(top, len(table)))])
    return table[:n]


def _combined(batches: Iterator) -> Iterator:
    """Documents' checksums from their chunks' checksums, in order; each root is checked against the recipe."""
    import numpy as np
    import pyarrow as pa

    shifts = _shifts(MOST + 1)
    for batch in batches:
        cols = {k: batch.column(k).to_pylist() for k in ("recipe", "root", "n_tokens")}
        parts = batch.column("parts").to_pylist()
        crc = np.zeros(len(parts), np.uint32)
        for row, (recipe, root) in enumerate(zip(cols["recipe"], cols["root"])):
            digests = [recipe[i : i + DIGEST] for i in range(0, len(recipe), DIGEST)]
            if merkle_root(digests) != root or [p["at"] for p in parts[row]] != list(range(len(digests))) or sum(p["n"] for p in parts[row]) != cols["n_tokens"][row]:
                raise ValueError("a document does not match its recipe")
        for k in range(max(map(len, parts), default=0)):
            rows = np.array([i for i, p in enumerate(parts) if len(p) > k], np.int64)
            n = np.array([parts[i][k]["n"] for i in rows], np.int64)
            add = np.array([parts[i][k]["crc"] for i in rows], np.uint32)
            crc[rows] = _times(shifts[n], crc[rows]) ^ add
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _pieces(recipes: DataFrame) -> DataFrame:
    """(row, at, digest): the chunks of each recipe in order."""
    many = F.sequence(F.lit(0), (F.octet_length("recipe") / DIGEST).cast("int") - 1)
    digests = F.transform(many, lambda i: F.substring(F.col("recipe"), i * DIGEST + 1, F.lit(DIGEST)))
    return recipes.select("row", F.posexplode(digests).alias("at", "digest"))


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; a wrong digest or root raises."""
    recipes = spark.read.parquet(f"{path}/recipes")
    stated = spark.read.parquet(f"{path}/manifest").select("bucket", F.col("root").alias("stated"), F.col("tokens").alias("_tokens"))
    wrong = _manifest(recipes).join(stated, "bucket", "full_outer").where("NOT (root <=> stated AND tokens <=> _tokens)")
    if not wrong.isEmpty():
        raise ValueError("the recipes do not match the manifest")
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "payload", "width").mapInArrow(_read_chunks, "digest binary, n long, crc long")
    found = _pieces(recipes).join(chunks, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    whole = recipes.select("row", "doc_id", "start", "n_tokens", "recipe", "root").join(found, "row", "left")
    whole = whole.withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<at:int,n:long,crc:long>>")))
    return whole.select("doc_id", "start", "n_tokens", "recipe", "root", "parts").mapInArrow(_combined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document's ids, rebuilt from its chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "payload")
    found = _pieces(recipes).join(chunks, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "payload"))).alias("p"))
    whole = recipes.select("row", "doc_id", "start", "width").join(found, "row")

    def ids(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            widths = batch.column("width").to_pylist()
            lists = [np.frombuffer(b"".join(x["payload"] for x in p), f"<u{w}").astype(np.int64) for p, w in zip(batch.column("p").to_pylist(), widths)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return whole.select("doc_id", "start", "width", "p").mapInArrow(ids, "doc_id long, start long, ids array<long>")


def op8(docs: DataFrame) -> DataFrame:
    path = fresh_path(docs.sparkSession, "store")
    write_store(docs, path)
    return verify_store(docs.sparkSession, path)
