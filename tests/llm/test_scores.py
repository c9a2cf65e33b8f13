"""The scores of op2, op4 and op6 once more, by plain loops over one text and the fitted tables; and every operator and
stage on nulls, empty and long texts, ties, repeats, empty tables and columns with clashing names."""

import math
import random
import re
import resource
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, chat, common, jaccard, langid, mixing, neardup, packing, quality, substring, toxicity
from tidemark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")}


def plain_quality(text):
    """The features of quality.NAMES from their definitions."""
    raw = text.encode()
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return [0.0] * len(quality.NAMES)
    n, size = len(words), len(raw)
    have = lambda s: sum(raw.count(c) for c in s.encode())
    upper = lambda c: 65 <= c <= 90
    lines = raw.split(b"\n")
    lines = lines[:-1] if not lines[-1] else lines
    mean = sum(map(len, words)) / n
    stop = have(".,")
    return [
        math.log1p(n), mean, math.sqrt(max(0, sum(len(w) ** 2 for w in words) / n - mean**2)), sum(map(upper, raw)) / size, have("0123456789") / size, stop / n, have("!") / n,
        have("|") / n, have("#$%&*+<=>@\\^_`{}~") / n, len(lines) / n, sum(c >= 128 for c in raw) / size, sum(a == b for a, b in zip(words[1:], words)) / n,
        len(set(words)) / n, len(set(lines)) / len(lines), n / (stop + 1), sum(upper(w[0]) and not upper(w[-1]) for w in words) / n, sum(upper(w[0]) and upper(w[len(w) // 2]) for w in words) / n,
    ]


def test_quality_scores_by_hand(spark, tables):
    model = quality.train(tables["documents"], tables["labels"], quality.may_teach())
    assert model.pairs and any(t.any() for t in model.tables)
    rows = tables["documents"].limit(60).collect()
    got = {r.doc_id: r.score for r in quality.score(tables["documents"], model).collect()}
    for r in rows:
        x = plain_quality(r.text or "")
        place = lambda edges, v: sum(e <= v for e in edges)
        z = model.bias + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
        z += sum(t[place(model.coarse[i], x[i]), place(model.coarse[j], x[j])] for i, j, t in model.pairs)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_quality_fit_lowers_the_loss_as_plain_boosting_does():
    rng = np.random.default_rng(1)
    x = rng.random((600, 2))
    y = (x[:, 0] > 0.4).astype(float)
    m = quality.fit(x, y, rounds=1, pair_rounds=0, rate=1.0)
    # one round, one feature after the other, by hand: the best split of the binned gradients, twice
    bias = math.log(y.mean() / (1 - y.mean()))
    z = np.full(600, bias)
    for j in range(2):
        b = np.searchsorted(m.edges[j], x[:, j], side="right")
        q = 1 / (1 + np.exp(-z))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)

        def tree(bins, depth):
            own = np.isin(b, bins)
            best = (0.0, None)
            for k in range(1, len(bins) if depth else 1):
                left, right = (np.isin(b, part) for part in (bins[:k], bins[k:]))
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 2.0) for s in (left, right)) - g[own].sum() ** 2 / (h[own].sum() + 2.0)
                best = max(best, (gain, k), key=lambda t: t[0])
            if best[1] is None or best[0] <= 1e-12:
                return {k: -g[own].sum() / (h[own].sum() + 2.0) for k in bins}
            return tree(bins[: best[1]], depth - 1) | tree(bins[best[1] :], depth - 1)

        table = tree(list(range(len(m.edges[j]) + 1)), 2)
        assert m.tables[j].tolist() == pytest.approx([table[k] for k in range(len(m.tables[j]))])
        z += np.array([table[k] for k in b])


def test_toxicity_scores_by_hand(spark, tables):
    model = toxicity.train(tables["documents"], tables["labels"], toxicity.may_teach())
    if not len(model.features):  # the smallest table has few positives
        model = toxicity.fit(toxicity.feature_sets([b"vile words here", b"vile words", b"vile deed"] * 30 + [bytes([97 + k]) * 4 + b" vile" for k in range(20)]), toxicity.feature_sets([b"plain %d text" % k + bytes([97 + k % 20]) for k in range(300)]), 0.1)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r.score for r in toxicity.score(tables["documents"], model).collect()}
    for r in tables["documents"].limit(60).collect():
        own = {int(f) for w in re.findall(rb"[A-Za-z\x80-\xff]+", (r.text or "").encode()) for f in toxicity.feature_sets([w])[0]}
        z = model.bias + sum(weight.get(f, 0.0) for f in own)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, z)))), abs=1e-9)


def test_toxicity_risk_falls_to_that_of_a_plain_descent():
    rng = np.random.default_rng(3)
    p = [np.unique(rng.choice(30, 5, p=np.r_[np.full(5, 0.14), np.full(25, 0.012)])).astype(np.uint32) for _ in range(300)]
    u = [np.unique(rng.choice(30, 5)).astype(np.uint32) for _ in range(900)]
    prior = 0.2
    m = toxicity.fit(p, u, prior)
    p, u = ([np.frombuffer(d, np.uint32) for d in {s.tobytes() for s in part}] for part in (p, u))

    def risk(weights, bias):
        z = lambda sets: np.array([bias + sum(weights.get(int(f), 0.0) for f in s) for s in sets])
        zp, zu = z(p), z(u)
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())

    fitted = dict(zip(m.features.tolist(), m.weights.tolist(), strict=True))
    base = risk(fitted, m.bias)
    assert base < risk({}, math.log(prior / (1 - prior)))
    for f in fitted:  # no single weight, moved, makes it better by much
        for step in (-0.1, 0.1):
            assert risk(fitted | {f: fitted[f] + step}, m.bias) > base - 2e-3


def plain_grams(text):
    raw = [32 if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else c + 32 if 65 <= c <= 90 else c for c in text.encode()]
    out = np.zeros(1 << langid.BITS)
    place = lambda v, salt: ((v + (salt << 24)) * 2654435761 % (1 << 32)) >> (32 - langid.BITS)
    for i, c in enumerate(raw):
        out[c] += c != 32
        if i and raw[i - 1 : i + 1] != [32, 32]:
            out[place(raw[i - 1] * 256 + c, 1)] += 1
        if i > 1 and raw[i - 1 : i + 1] != [32, 32]:
            out[place((raw[i - 2] * 256 + raw[i - 1]) * 256 + c, 2)] += 1
    return out


def test_language_scores_by_hand(spark, tables):
    docs = tables["documents"]
    model = langid.train(docs, langid.may_teach())
    # the same sample and idf by plain loops; one language's centroids by a refit
    teach = docs.where(langid.may_teach() & F.col("lang").isNotNull() & langid.has_letter()).select("lang", "text").collect()
    grams = [plain_grams(r.text) for r in teach]
    idf = [math.log((1 + len(grams)) / (1 + sum(g[k] > 0 for g in grams))) + 1 for k in range(1 << langid.BITS)]
    assert model.idf == pytest.approx(np.array(idf), rel=1e-5)
    own = sorted((g.astype(np.uint16).tobytes(), i) for i, (g, r) in enumerate(zip(grams, teach, strict=True)) if r.lang == model.languages[0])
    cs, reach = langid.fit_one(np.stack([grams[i] for _, i in own]).astype(np.float32), model.idf)
    assert np.allclose(cs, model.centroids[model.owner == 0], atol=1e-5) and np.allclose(reach, model.reach[model.owner == 0], atol=1e-4)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in docs.limit(40).collect():
        v = np.log1p(plain_grams(r.text or "")) * model.idf
        size = np.linalg.norm(v)
        cos = [float(v @ c) / size if size else 0.0 for c in model.centroids]
        best = int(np.argmax(cos))
        assert got[r.doc_id].lang_pred == model.languages[model.owner[best]] and got[r.doc_id].score == pytest.approx(cos[best], abs=1e-4)


def test_every_language_is_learned(spark):
    rng = random.Random(5)
    rows = []
    for k in range(1500):
        stem = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(4)]
        rows.append((k * 3, " ".join(stem * 3), f"l{k:04}", None, 0))
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train(df, F.lit(True), centroids=1)
    assert model.languages == [r[2] for r in rows]
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) == 1500


#: Names that operators use inside; a table may have them all.
INSIDE = """id row tag old clean places marks turn size tie again copies class salt before of c s n target source_size known toxic other
part df data rep smallest component least many node token have bits central prefix segments hub a b _id _tag _row _source _turn _clean _places
block kind frag digest removed_words2 quality held score d1 d2 doc how ids""".split()


def hard(spark, extra=True):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 7))) for _ in range(500)]
    make = lambda k: " ".join(rng.choices(vocab, k=k))
    same = make(70)
    texts = [None, "", " \n\t", "x", same, same, same + " more", make(40), make(40), make(30_000), "É ﬁ 漢字 🙂 " * 30, "z" * 100_000]
    rows = [(i, t, ["en", None, "de"][i % 3], ["a", None, "b"][i % 3], -9) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (4, texts[7], "en", "a", None), (None, same, None, None, None), (None, None, None, None, None), (None, texts[8], "en", "a", 3), (3, "y", None, "a", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.select("*", *[F.lit(f"<{c}>").alias(c) for c in INSIDE]) if extra else df


def as_text(rows):
    return sorted(str(r) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_hard_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = common.cut(hard(spark))
    out = stage(spark, docs, SF)
    got = out.collect()
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == out.columns
    assert as_text(stage(spark, docs.repartition(2), SF).collect()) == as_text(got) or name == "packing"
    if name == "packing":
        assert sum(p.length for p in got) == sum(p.doc_tokens for p in got if p.start == 0)
        assert sum(p.start == 0 for p in got) == docs.count()
        return
    assert out.columns == docs.columns and all(r[c] == f"<{c}>" for r in got for c in INSIDE)
    ids = [r.doc_id for r in got]
    if name == "toxicity":
        assert len(got) == docs.count()
    if name == "ngram_jaccard_join":
        assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 8, 9, 10, 11] and ids.count(None) == 3
    if name == "substring_dedup":
        assert len(got) == docs.count()
        assert [r.text for r in got if r.doc_id == 5] == [""] and all(r.n_chars in (-9, 0, 3, None) or r.n_chars == len(r.text) for r in got)
    if name == "source_mixing":
        assert set(ids) <= {r.doc_id for r in docs.collect()}


def test_operators_on_hard_tables(spark):
    df = common.cut(hard(spark))
    n = df.count()
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(9)] + [(3, 0, 0, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    for module in (quality, toxicity):
        model = module.train(df, labels, F.lit(True))
        got = module.score(df, model).collect()
        assert len(got) == n and len({r.score for r in got if r.doc_id in (4, 5)}) <= 2
        empty = module.train(df.limit(0), labels.limit(0), F.lit(True))
        assert module.score(df, empty).count() == n and module.score(df.limit(0), model).count() == 0
    model = langid.train(df, F.lit(True))
    got = langid.predict(df, model).collect()
    assert len(got) == n and sum(r.lang_pred == "und" for r in got) == 4
    assert langid.predict(df.limit(0), model).count() == 0
    assert packing.pack(df, tokenizer_path()).where("start = 0").count() == n
    mixed = mixing.mix(df)
    assert mixed.count() == n and mixed.columns == [c for c in df.columns if c not in ("size", "source_size", "target", "copies")] + ["size", "source_size", "target", "copies"]
    assert as_text(mixed.collect()) == as_text(mixing.mix(df.repartition(7)).collect())
    v = [[1.0, 0.0], [1.0, 0.0], [0.99, 0.1], [0.0, 1.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0], [None, 1.0]]
    vec = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(2, v[2]), (None, v[0])], "vec_id long, embedding array<float>")
    vec = vec.select("*", *[F.lit("<>").alias(c) for c in [*INSIDE, "v", "weight", "codes", "tree", "leaf", "query_id", "rank"]])
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(vec).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), **{i: (0, i) for i in range(4, 9)}, None: (0, None)}
    near = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(vec, lambda c: c % 2 == 0, top=2).orderBy("query_id", "rank").collect()]
    assert near == [(0, 1, 1), (0, 2, 2), (2, 1, 0), (2, 2, 1)]
    talk = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "x" * 100_000)], "conv_id long, turn long, role string, text string")
    got = chat.format_chats(talk.select("*", *[F.lit("<>").alias(c) for c in [*INSIDE, "_sorted", "turns", "formatted"] if c not in talk.columns])).collect()
    assert len(got) == 2 and all(r.identical for r in got)


LONG = """
import resource, sys
sys.path.insert(0, sys.argv[1])
import numpy as np
from tidemark.llm import jaccard, langid, packing, quality, substring, toxicity
from tidemark.llm.text import set_digest, shingle_sets
rng = np.random.default_rng(0)
words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(20000)]
text = b" ".join(words[i] for i in rng.integers(0, len(words), 8_300_000))[:50_000_000]
if sys.argv[2] == "one":
    text = b"x" * 50_000_000
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
what = sys.argv[3]
if what == "shingles":
    s = shingle_sets([text])[0]; set_digest(s); jaccard.parity_bits(s)
elif what == "chunks":
    substring.spans(text, np.arange(100))
elif what == "features":
    quality.features([text])
elif what == "toxic":
    toxicity.feature_sets([text])
elif what == "grams":
    langid.counts([text])
elif what == "ids":
    from tidemark.llm.queries import tokenizer_path
    packing.encoder(tokenizer_path()).encode(text.decode())
print(len(text), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - 0) // 1024)
"""


@pytest.mark.parametrize("what, kind", [(w, k) for w in ("shingles", "chunks", "features", "toxic", "grams", "ids") for k in ("words", "one") if (w, k) != ("ids", "one")])
def test_fifty_megabytes_fit_in_a_worker(what, kind):
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", LONG, root, kind, what], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(out[0]) > 40_000_000 and int(out[1]) < 1024 + 300, out  # making the text takes some of it
