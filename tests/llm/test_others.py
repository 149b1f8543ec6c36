"""Embeddings, conversations, components and the pipeline."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pantrylake.llm import chat, itq
from pantrylake.llm.components import components


def brute(rows, threshold=itq.THRESHOLD):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0]
    n = {i: 0 for i, _, _ in rows}
    comp = {i: i for i, _, _ in rows}
    links = []
    for a, (i, x, p) in enumerate(good):
        for j, y, q in good[a + 1 :]:
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(comp[i], comp[j])
            if comp[i] != low or comp[j] != low:
                comp[i] = comp[j] = low
                changed = True
    return {(i, n[i], comp[i], comp[i] == i) for i, _, _ in rows}


def test_embeddings_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * 0.08).tolist(), i % 2) for i in range(300)]
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(40)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, [None] * 16, 0), (2005, rows[0][1], None), (2006, [1.0, 0.0], 0), (2007, [2.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x")).withColumn("codes", F.lit(1))
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got, want = {tuple(r) for r in itq.op1(df).select("vec_id", "n_links", "component_id", "kept").collect()}, brute(rows)
    found, true = (sum(r[1] for r in x) for x in (got, want))
    assert found <= true and found >= 0.99 * true
    assert len(got & want) >= 0.97 * len(want)
    assert itq.op1(df.limit(0)).collect() == []


def test_rows_that_share_a_vec_id_have_links_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 2.0], 0), (3, [1.0, 0.01], 0), (1, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [-1.0, 0.0], 1)]
    got = sorted(tuple(r) for r in itq.op1(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (9, 0, 9, True), (9, 1, 1, False)]


def test_full_table_entries_are_dealt_out(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.01).tolist(), 1) for i in range(1300)]
    got = itq.op1(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.n_links for r in got} == {1299} and {r.component_id for r in got} == {0}


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in (200, 201, 202)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello " * 900), (1, 2, "assistant", "A # < \\ \\h \\b </turn>\n### user: x"), (1, 3, "user", "more " * 700),
    (1, 4, "assistant", "b" * 5000), (1, 5, "user", None), (1, 6, "assistant", ""), (1, 7, "assistant", "é𝒳 end"),
    (2, 0, "user", "only a question"), (3, 0, "system", "only rules"), (4, 1, "assistant", "tie"), (4, 1, "assistant", "tie"), (4, None, "user", "first"),
    (5, 0, None, None), (6, 0, "odd: role # <", "x"), (None, 0, "user", "nobody"), (7, 0, "user", "q"), (7, 1, "system", "late rules"), (7, 2, "assistant", "a"),
]


def test_chat_reads_back(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("k", F.lit("x"))
    got = {r.conv_id: r for r in chat.op6(df).collect()}
    rows = TURNS + [(-7, 0, "user", chat.ODD_TEXT), (-7, 1, "assistant", chat.ODD_TEXT)]
    assert set(got) == {r[0] for r in rows}
    assert max(w.tokens for w in chat.windows(df).collect()) <= chat.BUDGET
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_windows_keep_budget_system_turn_and_masks(spark):
    turns = [(1, 0, "system", "Rules.")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " * 30) for i in range(1, 60)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.windows(df, budget=512, history=100).orderBy("window").collect()
    assert len(made) > 5
    for w in made:
        assert w.text.startswith("### system: Rules.</turn>\n")
        assert w.tokens <= 512
        for s in w.loss:
            assert w.text[: s.start].endswith("### assistant: ") and w.text[s.start + s.n :].startswith("</turn>")
    assert sum(len(w.loss) for w in made) == sum(r[2] == "assistant" for r in turns)
    assert any(w.n_repeated > 1 for w in made[1:])


def plain_windows(turns, budget, history):
    """(text, targets, repeated) of each window of one conversation, turn by turn."""
    import regex

    token = regex.compile(chat.TOKEN)
    count = lambda t: len(token.findall(t))
    esc = lambda t: t.replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l")
    rows = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in turns))
    system = bool(rows) and rows[0][2] == "system" and count(rows[0][3]) + 8 <= budget // 2
    lead = count(rows[0][3]) + 8 if system else 0
    part = min(chat.PART, budget - budget // 2 - history - 8)
    parts = []  # text, tokens, piece, target
    for k, (_, _, role, text) in enumerate(rows):
        n, cut = count(text) + 8, [text]
        if not (system and k == 0) and n > budget - lead - history and len(text) > part:
            cut = [text[i : i + part] for i in range(0, len(text), part)]
        for j, t in enumerate(cut):
            size = n if len(cut) == 1 else min(len(t), count(t)) + 8
            parts.append((size, f"##{'+' if j else '#'} {esc(role).replace(':', chr(92) + 'c')}: {esc(t)}</turn>\n", role == "assistant", t))
    head, body = parts[: int(system)], parts[int(system) :]
    out, i = [], 0
    while i < len(body):
        back, used = i, lead
        if out:
            while back > 0 and sum(p[0] for p in body[back - 1 : i]) <= history:
                back -= 1
        used += sum(p[0] for p in body[back : i + 1])
        j = i + 1
        while j < len(body) and used + body[j][0] <= budget:
            used += body[j][0]
            j += 1
        again = (len(head) + i - back) if out else 0
        out.append(("".join(p[1] for p in head + body[back:j]), [p[3] for p in body[i:j] if p[2]], again, used))
        i = j
    return out or [("".join(p[1] for p in head), [], 0, lead)]


@pytest.mark.parametrize(("budget", "history"), [(256, 40), (2048, 256), (200, 0)])
def test_chat_windows_against_plain_python(spark, budget, history):
    rnd = np.random.default_rng(4)
    words = ["apple", "internationalization", "12345", "x", "é𝒳", "#", "<", "\\h", "  ", "\n", "end."]
    say = lambda n: " ".join(words[i] for i in rnd.integers(0, len(words), n))
    turns = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant", "tool: x")[t % 3], say(int(rnd.integers(0, 60)))) for c in range(8) for t in range(20)]
    turns += [(20, 0, "system", say(40)), (20, 1, "assistant", say(3000)), (20, 2, "user", say(3))] + [(21, i, "user", say(9)) for i in range(400)]
    turns += [(22, 0, "system", say(4000)), (22, 1, "assistant", say(5)), (23, 0, "system", "only rules")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = {}
    for w in chat.windows(df, budget, history).orderBy("conv_id", "window").collect():
        loss = [w.text[s.start : s.start + s.n] for s in w.loss]
        made.setdefault(w.conv_id, []).append((w.text, [x.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\") for x in loss], w.n_repeated, w.tokens))
    for conv in {r[0] for r in turns}:
        assert made[conv] == plain_windows([r for r in turns if r[0] == conv], budget, history), conv
    assert max(w[3] for ws in made.values() for w in ws) <= budget
    filled = [w[3] for w in made[21][:-1]]
    assert sum(filled) >= 0.9 * budget * len(filled) if budget > 1000 else True


def test_chat_takes_the_callers_token_counts(spark):
    turns = [(1, i, "user", "word", 90) for i in range(10)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, n long")
    got = chat.windows(df, 512, 0, tokens="n").orderBy("window").collect()
    assert [w.tokens for w in got] == [490, 490]


def test_chat_rows_without_conversation_stand_alone(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert [r.n_turns for r in chat.op6(df).collect() if r.conv_id is None] == [1, 1, 1]


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.op6(df).collect()] == [chat.ODD_CONVERSATION]


@pytest.mark.skipif(__import__("importlib.util").util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_stages(spark, sf_dir, odd_docs, empty_docs):
    import corpus_pipeline

    for start in (odd_docs, empty_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == start.columns, name
        assert {"doc_id", "sequence_id"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).columns)
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert set(out.doc_id) <= set(source.doc_id)
    # near copies leave one; all other documents stay
    from pantrylake.llm import langid, simhash

    known = langid.keep_known(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = {r.component_id for r in simhash.op9(known).collect()}
    assert set(out.doc_id) == kept
    sizes = out.groupby("sequence_id").length.sum()
    assert (sizes.iloc[:-1] == 2048).all()
