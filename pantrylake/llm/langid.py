"""Language ID by prediction by partial matching over bytes.

Each language has a variable-order context tree (up to ORDER bytes of context) with frozen counts. A byte costs its
exact code length: in the longest known context, seen bytes have n/(N+d), the escape has d/(N+d) for d distinct bytes
seen N times, and after an escape the bytes already ruled out are excluded from the shorter context; after the empty
context all 256 bytes are alike. The language with the shortest code wins.

Every context met in training is kept. For each order there is a bitmap of the bytes met in each context by any
language, their code lengths under all languages, and the escape's; so a byte costs one look-up where it was met, and
one more for each escape.

Training reads labelled documents that are not held out: per language at most TRAIN_DOCS of them in the order of a hash,
up to TRAIN_BYTES in all; documents beyond that size alone are not training documents (documented bounds of the
classifier's sample; no text is cut). Every document is scored over its whole text.

Defined cases: null text or text without a letter is "und" with score 0; a null lang is never learned; with nothing
to learn from, every document is "und"; equal code lengths go to the first language in alphabetical order; repeated
rows are scored alike; an empty table gives no rows. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

ORDER = 3
TRAIN_DOCS, TRAIN_BYTES = 400, 400_000
#: Context before the first byte of a text.
START = 10
SCORED_AT_ONCE = 1 << 19
#: A pipeline keeps documents whose language is this sure at least.
KEEP_SCORE = 0.5


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0 (null id: not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, text): the bounded sample that the trees are built from."""
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not sizes:
        return labelled.select("lang", "text")
    # a hash cut leaves a few times what is wanted of each language, however many documents there are
    cuts = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min((1 << 63) - 1, (1 << 63) * 4 * TRAIN_DOCS // r["n"]))])
    some = labelled.withColumn("_o", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)).where(F.col("_o") <= F.element_at(cuts, F.col("lang")))
    first = Window.partitionBy("lang").orderBy("_o", "doc_id", "text")
    some = some.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= TRAIN_DOCS)
    some = some.withColumn("_sum", F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= TRAIN_BYTES)
    return some.select("lang", "text")


class Layer:
    """The contexts of one order: which symbols follow them, and code lengths in bits by language."""

    def __init__(self, order: int, size: int, codes: list, counts: list, shorter):
        """codes, counts: by language, the grams (context * size + symbol) and how often; shorter: lengths one order down."""
        import numpy as np

        grams = np.unique(np.concatenate(codes))
        context, sym = grams // size, grams % size
        contexts, row = np.unique(context, return_inverse=True)
        self.row_of = np.full(size**order, -1, np.int32)
        self.row_of[contexts] = np.arange(len(contexts))
        words = (size + 63) // 64
        bits = np.zeros((len(contexts), words), np.uint64)
        np.bitwise_or.at(bits, (row, sym >> 6), np.uint64(1) << (sym & 63).astype(np.uint64))
        per_word = np.bitwise_count(bits).astype(np.int64).ravel()
        self.bits, self.words = bits.ravel(), words
        self.before = (np.cumsum(per_word) - per_word).astype(np.int32)  # grams are sorted as the bitmap's bits are
        below = shorter(context % size ** (order - 1), sym)
        self.lengths = np.empty((len(grams), len(codes)), np.float32)
        self.escape = np.zeros((len(contexts), len(codes)), np.float32)
        for which, (own, n) in enumerate(zip(codes, counts)):
            seen = np.zeros(len(grams))
            seen[np.searchsorted(grams, own)] = n
            met = seen > 0
            total, distinct = np.bincount(row, seen, len(contexts)), np.bincount(row, met, len(contexts))
            left = 1 - np.bincount(row, np.where(met, np.exp2(-below[:, which]), 0), len(contexts))
            escapes = np.where(left > 1e-9, distinct, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(total > 0, np.log2(total + escapes) - np.log2(escapes) + np.log2(np.maximum(left, 1e-9)), 0)
                out = np.minimum(out, 40)
                own_length = np.log2((total + escapes)[row]) - np.log2(seen)
            self.escape[:, which] = out
            self.lengths[:, which] = np.where(met, own_length, out[row] + below[:, which])


class Trees:
    """Code lengths of all languages' context trees."""

    def __init__(self, samples: dict[str, list[bytes]]):
        import numpy as np

        self.langs = sorted(samples)
        texts = {k: [np.frombuffer(bytes([START] * ORDER) + t, np.uint8) for t in v if t] for k, v in samples.items()}
        seen = np.zeros(256, bool)
        seen[START] = True
        for v in texts.values():
            for t in v:
                seen |= np.bincount(t, minlength=256) > 0
        known = np.nonzero(seen)[0]
        self.size = a = len(known) + 1  # the last symbol stands for all bytes never met
        self.symbol = np.full(256, a - 1, np.int32)
        self.symbol[known] = np.arange(a - 1)
        self.unmet = float(np.log2(max(1, 256 - (a - 1))))
        self.layers: list[Layer] = []
        flat = np.full(a, 8.0)
        flat[a - 1] = 8.0 - self.unmet if a <= 256 else 40.0
        self.flat = np.repeat(flat[:, None], len(self.langs), axis=1).astype(np.float32)
        if not self.langs:
            return
        for k in range(ORDER + 1):
            grams = {}
            for lang in self.langs:
                runs = [self.symbol[t].astype(np.int64) for t in texts[lang]]
                code = [sum((r[ORDER - j : len(r) - j] * a**j for j in range(k + 1)), np.zeros(len(r) - ORDER, np.int64)) for r in runs]
                grams[lang] = np.unique(np.concatenate(code) if code else np.zeros(0, np.int64), return_counts=True)
            shorter = (lambda context, sym: self._lengths(context, sym)) if k else (lambda context, sym: self.flat[sym])
            self.layers.append(Layer(k, a, [grams[x][0] for x in self.langs], [grams[x][1] for x in self.langs], shorter))

    def _lengths(self, context, sym):
        """Code length of each symbol after its context under each language, from the longest order there is."""
        import numpy as np

        cost = np.zeros((len(sym), len(self.langs)), np.float32)
        open_ = np.arange(len(sym))
        for k in range(len(self.layers) - 1, -1, -1):
            layer, s = self.layers[k], sym[open_]
            row = layer.row_of[context[open_] % self.size**k].astype(np.int64)
            known = row >= 0
            at = np.maximum(row, 0) * layer.words + (s >> 6)
            bit = (s & 63).astype(np.uint64)
            if not len(layer.bits):
                continue
            word = layer.bits[at]
            hit = known & ((word >> bit) & np.uint64(1)).astype(bool)
            rank = layer.before[at[hit]] + np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            cost[open_[hit]] += layer.lengths[rank]
            escaped = known & ~hit
            cost[open_[escaped]] += layer.escape[row[escaped]]
            open_ = open_[~hit]
        cost[open_] += self.flat[sym[open_]]
        return cost

    def lengths(self, data, edges):
        """Code length in bits of each text data[edges[i]:edges[i+1]] under each language."""
        import numpy as np

        a, out = self.size, np.zeros((len(edges) - 1, len(self.langs)))
        pads = self.symbol[START]
        begin, end = int(edges[0]), int(edges[-1])
        for at in range(begin, end, SCORED_AT_ONCE):
            to = min(end, at + SCORED_AT_ONCE)
            lo = max(begin, at - ORDER)
            sym = self.symbol[data[lo:to]].astype(np.int64)
            sym = np.concatenate([np.full(ORDER - (at - lo), pads), sym])
            context = np.zeros(to - at, np.int64)
            text_starts = edges[:-1]
            for k in range(1, ORDER + 1):
                before = sym[ORDER - k : len(sym) - k].copy()
                for j in range(k):  # the k-th byte before the j-th byte of a text lies before the text
                    fresh = text_starts + j
                    fresh = fresh[(fresh >= at) & (fresh < to)]
                    before[fresh - at] = pads
                context += before * a ** (k - 1)
            own = sym[ORDER:]
            cost = self._lengths(context, own)
            cost[own == a - 1] += self.unmet
            first = int(np.searchsorted(edges, at, "right")) - 1
            last = int(np.searchsorted(edges, to, "left"))
            cuts = np.clip(edges[first:last], at, to) - at
            sums = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(cost, axis=0, dtype=np.float64)])
            out[first:last] += sums[np.clip(edges[first + 1 : last + 1], at, to) - at] - sums[cuts]
        return out


def has_letter(raw: bytes) -> bool:
    if raw.lower() != raw.upper():  # an ASCII letter
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def fit(docs: DataFrame) -> Trees:
    samples: dict[str, list[bytes]] = {}
    for lang, text in training_sample(docs).orderBy("lang", F.xxhash64("text"), "text").toLocalIterator():  # bounded by TRAIN_BYTES a language
        samples.setdefault(lang, []).append(text.encode())
    return Trees(samples)


def _predictions(trees: Trees, column):
    """Language and score of each text of an Arrow column."""
    import numpy as np

    from .pieces import text_bytes

    data, edges = text_bytes(column)
    at = edges.tolist()
    able = np.array([bool(trees.langs) and has_letter(data[i:j].tobytes()) for i, j in zip(at, at[1:])], bool)
    names, scores = np.full(len(able), "und", object), np.zeros(len(able))
    if able.any():
        bits = trees.lengths(data, edges)
        n = np.maximum(np.diff(edges), 1)[:, None]
        surplus = (bits - bits.min(axis=1, keepdims=True)) / np.sqrt(n)  # tempered: bytes are not independent
        weight = np.exp2(-np.minimum(surplus, 900))
        names[able] = np.array(trees.langs, object)[bits.argmin(axis=1)][able]
        scores[able] = (1 / weight.sum(axis=1))[able]
    return names, scores


def identify(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """docs with lang_pred and score added."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    trees = fit(docs) if trees is None else trees
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .pieces import slices

        for batch in slices(batches):
            names, scores = _predictions(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    return map_arrow(docs, predict, schema)


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents whose language is recognised, with the columns they came with (whatever their names)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang")))

    def known(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .pieces import slices

        for batch in slices(batches):
            names, scores = _predictions(shared.value, batch.column("text"))
            yield batch.filter(pa.array((names != "und") & (np.asarray(scores) >= KEEP_SCORE)))

    texts = docs.withColumn("text", F.col("text").cast("string"))
    return map_arrow(texts, known, texts.schema)


def op7(docs: DataFrame) -> DataFrame:
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = identify(picked.select("doc_id", "text"), fit(picked))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
