"""Operators against plain Python that computes the same from their definitions."""

import hashlib
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pantrylake.llm import digest, langid, mixing, pii, secret_scan, simhash, store
from pantrylake.llm.common import fresh_path, join_classes


def spark_hash(*values):
    """xxhash64 of Spark: each value's bytes under the hash so far; (n,) is a 32-bit integer."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def plain_mixing(rows, repeats=2.0, budget=None):
    """(doc_id, source, n, epoch, start) of each time a document is taken."""
    docs = {}
    for d, t, s in rows:
        docs[d, s] = docs.get((d, s), 0) + len(re.findall(r"\S+", t or ""))
    total = {}
    for (_, s), n in docs.items():
        total[s] = total.get(s, 0) + n
    some, x = [n for n in total.values() if n], 1.0
    if some:
        lo, hi = 0, 1 << 30  # the least multiple of 2**-30 that keeps the limit
        met = lambda e: max((n / max(some)) ** (e - 1) for n in some) <= repeats
        while not met(0) and hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if met(mid / (1 << 30)) else (mid, hi)
        x = 0.0 if met(0) else hi / (1 << 30)
    z, out = sum(n**x for n in some), []
    for s, tokens in total.items():
        own = [(d, n) for (d, t), n in docs.items() if t == s]
        if not tokens:
            quota = 0
        elif budget is None:
            quota = max(tokens, math.floor(tokens * (tokens / max(some)) ** (x - 1) + 0.5))
        else:
            quota = math.floor(tokens**x / z * budget + 0.5)
        blocks = math.ceil(len(own) / mixing.BLOCK_DOCS)
        for epoch in range(max(1, math.ceil(quota / max(1, tokens)))):

            def place(d):
                b = spark_hash((mixing.SEED,), d, s) % blocks
                rank = spark_hash((mixing.SEED + 1,), (epoch,), s, b)
                return (rank % (1 << 64), b, spark_hash((mixing.SEED + 2,), (epoch,), d), d is not None, d or 0)

            at = epoch * tokens
            for d, n in sorted(own, key=lambda p: place(p[0])):
                if epoch == 0 and (budget is None or not tokens) or at < quota and (n or epoch == 0):
                    out.append((d, s, n, epoch, at))
                at += n
    return out


@pytest.mark.parametrize("budget", [None, 3000, 40_000])
def test_mixing_against_plain_python(spark, budget):
    rnd = np.random.default_rng(3)
    rows = [(i, "w " * int(rnd.integers(0, 30)), ("big", "small", "tiny", None)[min(3, int(rnd.exponential(0.6)))]) for i in range(900)]
    rows += [(5, "again", "big"), (5, "again", "big"), (None, "no id", "tiny"), (7, None, "void"), (8, " ", "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("src", F.lit(1)).repartition(3)
    want = sorted(plain_mixing(rows, budget=budget), key=str)
    got = mixing.plan(df, budget=budget).select("doc_id", "source", "n_tokens", "epoch", "start").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    times = {}
    for d, s, *_ in want:
        times[d, s] = times.get((d, s), 0) + 1
    out = mixing.mixed(df, budget=budget)
    assert out.columns == df.columns
    expected = sorted(((d, t, s) for d, t, s in rows for _ in range(times.get((d, s), 0))), key=str)
    assert sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str) == expected


def test_secret_ratio_and_spans_against_plain_python(docs, spark):
    model = secret_scan.fit(docs)
    base = re.compile(secret_scan.ASSIGN, re.A)
    token = re.compile(secret_scan.TOKEN, re.A)

    def ratio(t):
        codes = [0] + [secret_scan.SYMBOLS.find(c) + 1 for c in t]
        return sum(float(f"{model[a * secret_scan.SIZE + b]:.6f}") for a, b in zip(codes, codes[1:]))

    def added(text):
        taken = [(m.start(), m.end()) for m in base.finditer(text) if len(m[2]) >= 12]
        for kind in (secret_scan.ACCESS, secret_scan.HEX):
            taken += [m.span() for m in re.finditer(kind, text)]
        out = []
        for m in token.finditer(text):
            free = [i for i in range(m.start(), m.end()) if not any(a <= i < b for a, b in taken)]
            runs = [[i] for i in free[:1]]
            for i in free[1:]:
                if i == runs[-1][-1] + 1 and not any(i in (a, b) for a, b in taken):
                    runs[-1].append(i)
                else:
                    runs.append([i])
            out += [(r[0], r[-1] + 1) for r in runs if len(r) >= secret_scan.LEAST_VALUE]
        return [(a, b) for a, b in out if ratio(text[a:b]) >= max(secret_scan.THRESHOLD, secret_scan.EACH * (b - a))]

    many = " ".join(hashlib.sha256(str(i).encode()).hexdigest()[:20].upper() for i in range(1500))  # more matches than a lot
    texts = [r.text for r in docs.collect()] + [None, "", many, "é𝒳 Zk9QpX7vL2mTq8RsWc4JhYb3 deadbeefdeadbeef_Zk9QpX7vL2mTq8", "token=Zk9QpX7vL2mTq8RsWc4JhYb3/aGVsbG8gd29ybGQhISE"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan(frame, model).collect():
        assert [(s.start, s.end) for s in r.added] == added(texts[r.doc_id] or ""), r.doc_id


def digest_number(kind, step, half, key, modulus):
    return int(hashlib.sha256(f"{key}|{kind}|{step}|{half}".encode()).hexdigest()[:12], 16) % modulus


def feistel(value, a, b, kind, key, back=False):
    left, right = divmod(value, b)
    sign = -1 if back else 1
    for step in (range(pii.ROUNDS, 0, -1) if back else range(1, pii.ROUNDS + 1)):
        if step % 2:
            left = (left + sign * digest_number(kind, step, right, key, a)) % a
        else:
            right = (right + sign * digest_number(kind, step, left, key, b)) % b
    return left * b + right


def test_numbers_go_through_a_plain_feistel_network_and_back(spark):
    for a, b in ((pii.DAYS_A, pii.DAYS_B), (65536, 65536), (80_000, 80_000)):
        values = [0, 1, a * b - 1, *np.random.default_rng(1).integers(0, a * b, 40).tolist()]
        frame = spark.createDataFrame([(v,) for v in values], "v long")
        got = [r[0] for r in frame.select(pii.permuted_number(F.col("v"), a, b, "kind", "key")).collect()]
        assert got == [feistel(v, a, b, "kind", "key") for v in values]
        assert [feistel(v, a, b, "kind", "key", back=True) for v in got] == values


def shifted(part, other, kind, step, key, sign):
    h = hashlib.sha256(f"{key}|{kind}|{step}|{other}".encode()).hexdigest()
    out = ""
    for i, c in enumerate(part):
        by = sign * int(h[4 * (i % 16) : 4 * (i % 16) + 4], 16)
        for first, size in (("0", 10), ("a", 26), ("A", 26)):
            if ord(first) <= ord(c) < ord(first) + size:
                c = chr((ord(c) - ord(first) + by) % size + ord(first))
                break
        out += c
    return out


def test_texts_go_through_a_plain_feistel_network_and_back(spark):
    values = ["ab", "a.b-c1", "Jo.Doe77", "x" * 40, "1234567890", "a"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in frame.select(pii.permuted_text(F.col("v"), "kind", "key")).collect()]
    for v, new in zip(values, got):
        left, right = v[: len(v) // 2], v[len(v) // 2 :]
        for step in range(1, pii.ROUNDS + 1):
            left, right = right, shifted(left, right, "kind", step, "key", 1)
        assert new == left + right
        for step in range(pii.ROUNDS, 0, -1):
            left, right = shifted(right, left, "kind", step, "key", -1), left
        assert left + right == v


def test_phones_stay_valid_linked_and_known(spark):
    rnd = np.random.default_rng(2)
    digits = [f"{rnd.integers(200, 1000)}{rnd.integers(200, 1000)}{rnd.integers(0, 10000):04d}" for _ in range(300)]
    shapes = ["+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "+1-{}-{}-{}"]
    write = lambda s, d: s.format(d[:3], d[3:6], d[6:])
    rows = [(i, write(shapes[i % 4], d)) for i, d in enumerate(digits)] + [(1000 + i, write(shapes[0], d)) for i, d in enumerate(digits)]
    rows += [(2000, "+1 (123) 456-7890"), (2001, "+1 (234) 056-7890")]
    once = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k", counts=True).collect()
    assert {r.n_phone for r in once} == {1}
    new = {r.doc_id: re.sub(r"\D", "", r.text)[-10:] for r in once}
    assert all(new[i] == new[1000 + i] for i in range(300)) and len({new[i] for i in range(300)}) == len(set(digits))
    assert all(new[i][0] >= "2" and new[i][3] >= "2" for i in range(300))
    assert new[2000][0] < "2" and new[2001][0] >= "2" > new[2001][3]
    again = pii.pseudonymised(spark.createDataFrame([(r.doc_id, r.text) for r in once], "doc_id long, text string"), "k", counts=True)
    assert {r.n_phone for r in again.collect()} == {1}
    for i, d in enumerate(digits[:40]):
        place = ((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10_000 + int(d[6:])
        moved = feistel(place, 80_000, 80_000, "phone", "k")
        area, rest = divmod(moved, 800 * 10_000)
        assert new[i] == f"{area + 200:03d}{rest // 10_000 + 200:03d}{rest % 10_000:04d}"


def test_pseudonyms_depend_on_the_key(spark):
    df = spark.createDataFrame([(1, "mail jo.doe7@site.example.com")], "doc_id long, text string")
    one, two = (pii.pseudonymised(df, k).first().text for k in ("k", "l"))
    assert one != two and one.endswith("@site.example.com") and two.endswith("@site.example.com")


def test_language_predictions_against_a_plain_model(spark):
    """Training sample, code lengths, choice and score, from the definitions."""
    import zlib

    texts = {"xx": ["abra cadabra abra", "dabra abra cab", "barb crab arab abba"], "yy": ["zyzzy fuzzy zippy", "fizzy yuzu zuzz", "pizzy zyx zyzzyva"]}
    rows = [(i, texts[k][i // 2 % 3], k) for i, k in enumerate(["xx", "yy"] * 12)] + [(100, "abba zyz", None), (101, "fuzzy", "yy"), (102, "ab", "xx"), (103, "...", "xx"), (104, "ab" * 40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = {"xx": [], "yy": []}
    for d, t, k in rows:
        if k and zlib.crc32(str(d).encode()) % 5:
            train[k].append(t.encode())
    counts = {}
    for k, samples in train.items():
        for t in samples:
            s = bytes([langid.START] * langid.ORDER) + t
            for i in range(langid.ORDER, len(s)):
                for n in range(langid.ORDER + 1):
                    c = counts.setdefault((k, s[i - n : i]), {})
                    c[s[i]] = c.get(s[i], 0) + 1

    def p(k, context, b, n):
        if n < 0:
            return 1 / 256
        own = counts.get((k, context[len(context) - n :]), {})
        if not own:
            return p(k, context, b, n - 1)
        total, d = sum(own.values()), len(own)
        if b in own:
            return own[b] / (total + d)
        return d / (total + d) * p(k, context, b, n - 1) / (1 - sum(p(k, context, x, n - 1) for x in own))

    for r in langid.op7(df).collect():
        text = next(t for d, t, _ in rows if d == r.doc_id)
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        s = bytes([langid.START] * langid.ORDER) + text.encode()
        bits = {k: -sum(math.log2(p(k, s[i - langid.ORDER : i], s[i], langid.ORDER)) for i in range(langid.ORDER, len(s))) for k in train}
        best = min(bits, key=bits.get)
        weight = {k: 2 ** (-(v - bits[best]) / math.sqrt(len(text.encode()))) for k, v in bits.items()}
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(weight.values()), abs=1e-3)


def test_equal_code_lengths_go_to_the_first_language(spark):
    rows = [(i, "same text", k) for i, k in enumerate(["b", "a", "c"] * 10)]
    assert {r.lang_pred for r in langid.op7(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {"a"}


def test_hot_ids_and_no_ids_are_dealt_out(spark):
    """One doc_id, and none, on a third of all rows each, equal and unequal texts."""
    rows = [(i, f"text {i}") for i in range(200)] + [(50, f"hot {i % 40}") for i in range(200)] + [(None, f"no {i % 30}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1]))
    order = sorted(rows, key=key, reverse=True)
    want = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        want.append((d, hashlib.sha256(edited.encode()).hexdigest(), float(t == after)))
    got = [(r.doc_id, r.edited_sha256, r.near_next) for r in digest.op10(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    path = fresh_path(spark, "store")
    store.write_store(df, path)
    assert spark.read.parquet(f"{path}/recipes").select("bucket").distinct().count() > 8
    read = store.verify_store(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(read, read[1:]))


def test_ids_on_different_texts(spark):
    rows = [(1, "red apples and green pears"), (1, "the quarterly meeting moved"), (2, "red apples and green pears")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.op9(df).collect()) == [(1, 1), (1, 1), (2, 1)]
    prints = sorted((r.doc_id, r.fingerprint, r.group_id) for r in digest.op10(df).collect())
    assert len({p for _, p, _ in prints}) == 2 and {g for _, _, g in prints} == {1}


def test_classes_of_hot_values_are_joined_whole(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), "id")
    classes = rows.groupBy("k").agg(F.count("*").alias("_n"), F.min("id").alias("least"))
    got = join_classes(rows, classes, ["k"], 5000).toPandas()
    assert len(got) == 5000 and set(got.columns) == {"k", "id", "least"}
    assert (got[got.k == 7].least == 0).all() and (got[got.k != 7].least == got[got.k != 7].k).all()


def test_space_separators_fold(spark):
    """What NFKC leaves as white space, and Java's own, fold to one plain space."""
    spaces = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    df = spark.createDataFrame([(i, f"a{s}{s}b") for i, s in enumerate(spaces)], "doc_id long, text string")
    assert digest.op10(df).select("fingerprint").distinct().count() == 1
