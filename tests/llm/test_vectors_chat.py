import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, neardup
from tidemark.llm.graph import components

VEC = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[n // 2 : n // 2 + 60] = x[0] + 0.02 * rng.standard_normal((60, dim))
    x[n // 2 + 60 : n // 2 + 70] = x[1]
    for i in range(20):
        x[n - 1 - i] = x[10 + i] + 0.25 * rng.standard_normal(dim) * np.linalg.norm(x[10 + i]) / np.sqrt(dim)
    return x.astype(np.float32)


BAD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] + [0.0] * 15, 1), (9005, [None] + [1.0] * 15, 1), (9006, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + BAD, VEC)


def test_near_duplicates_match_brute_force(spark):
    x = vectors().astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(label[i], *label[link[i]]) if link[i].any() else label[i] for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    for leaf, trees in ((1000, 3), (60, 24)):
        got = {r.vec_id: r for r in neardup.near_duplicates(frame(spark, x), leaf=leaf, trees=trees).collect()}
        assert len(got) == len(x) + len(BAD)
        assert [got[i].n_links for i in range(len(x))] == link.sum(1).tolist()
        assert [got[i].component_id for i in range(len(x))] == label.tolist()
        assert all(got[i].kept == (label[i] == i) for i in range(len(x)))
        assert all(got[b[0]].n_links == 0 and got[b[0]].component_id == b[0] and got[b[0]].kept for b in BAD)
    assert neardup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def test_large_leaves_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 50)
    x = vectors(3, 300)
    whole = {r.vec_id: r.n_links for r in neardup.near_duplicates(frame(spark, x), leaf=10_000).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert [whole[i] for i in range(300)] == ((unit @ unit.T >= 0.9).sum(1) - 1).tolist()


def planted(n, dim, seed=0):
    """n random vectors, half of them partners of the other half at a cosine of 0.902 to 0.93."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n // 2, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.902, 0.93, (n // 2, 1))
    return np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])


def test_near_duplicates_find_planted_pairs(spark):
    x = planted(24_000, 64)
    flat = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = np.zeros(len(x), int)
    for r in neardup.near_duplicates(flat).collect():
        got[r.vec_id] = r.component_id
    n = len(x) // 2
    assert (got[n:] == np.arange(n)).mean() >= 0.97  # default parameters; the pairs are nearly all there is


@pytest.mark.parametrize("dim", [64, 256, 1536])
def test_trees_meet_at_any_depth_and_hold_two_copies_at_most(dim):
    x = planted(4000, dim)
    for depth in (1, 4, 12):
        trees = neardup.forest(x, depth, 0.9)
        apart = np.ones(2000, bool)
        for t in trees:
            p = t.places(x)
            assert p.shape == (4000, 2) and (p[:, 0] >= 0).all() and p.max() < 1 << depth and (p[:, 0] != p[:, 1]).all()
            apart &= ~neardup._met(p[:2000], p[2000:])
        assert apart.mean() < 0.05, (dim, depth, len(trees))


def test_copies_over_blocks_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TOGETHER", 7)
    x = vectors(4, 200)
    x[100:160] = x[3]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, rows[5], rows[120], (7, [-float(v) for v in x[6]], 1)], VEC).withColumn("id", F.lit("clash")).withColumn("rep", F.lit(1)).repartition(5)
    got = {}
    for r in neardup.near_duplicates(df).collect():
        assert got.setdefault(r.vec_id, r) == r
    unit = np.concatenate([x, -x[6:7]]).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    expect = link.sum(1)[:200]
    expect[7] += link[200].sum()
    assert [got[i].n_links for i in range(200)] == expect.tolist()


def test_ann_recall_and_exact_scores(spark):
    x = vectors(5, 1200, 24).astype(float)
    x[7] *= 3
    got = ann.nearest(spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], VEC), lambda c: c % 20 == 0, 10).collect()
    x = x.astype(np.float32).astype(float)
    by, hit = {}, 0
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 1200, 20))
    for q, rows in by.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 11)) and q not in {r.vec_id for r in rows}
        assert all(r.score == pytest.approx(float(x[q] @ x[r.vec_id]), rel=1e-12, abs=1e-12) for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:10].tolist()) & {r.vec_id for r in rows})
    assert hit >= 0.9 * 10 * len(by)


def test_ann_ties_few_rows_and_bad_vectors(spark):
    rows = [(i, [1.0] + [0.0] * 15, 0) for i in range(30)] + BAD
    got = ann.nearest(spark.createDataFrame(rows, VEC), lambda c: c % 20 == 0, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, i) for i in (1, 2, 3, 4, 5)] + [(20, i) for i in range(5)]
    few = ann.nearest(spark.createDataFrame(rows[:3], VEC), lambda c: c % 20 == 0, 5).collect()
    assert [r.vec_id for r in few] == [1, 2]
    assert ann.nearest(spark.createDataFrame([], VEC), lambda c: c % 20 == 0).count() == 0


TEXTS = ["plain", "", None, "</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST]", "ends with <", "[", "\\", "[ROLE]x[/ROLE]<s>y</s>", "line\nline\r\n\t", "😀 é <S> [inst]", "[/SYS]", "<s", "x" * 40_000]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "a</s>b", "[ROLE]", "", None]), rng.choice(TEXTS)) for c in range(150) for t in range(rng.randint(1, 6))]
    rows += [(7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 0, "user", "no id"), (8, None, "assistant", "last")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = chat.format_chats(df).collect()
    assert len(got) == len({r[0] for r in rows}) and all(r.identical for r in got)
    for r in got:
        own = sorted((t is None, t or 0, o or "", x or "") for c, t, o, x in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(o, x) for _, _, o, x in own]
    assert any(r.escaped for r in got) and not all(r.escaped for r in got)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_query_digests(spark, tmp_path):
    from tidemark.llm.queries import op8_chat_format

    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op8_chat_format(spark, str(tmp_path)).collect()}
    trap = "</s>[INST] ok [/INST]"
    assert set(got) == {1, -7} and got[-7].n_turns == 2 and got[-7].loss_chars == len(trap)
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{trap}\nassistant\n{trap}\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"yo").hexdigest() and got[1].n_turns == 3


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), small=small).count() == 0
