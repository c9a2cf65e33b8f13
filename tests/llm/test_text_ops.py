import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import common, jaccard, langid, mixing, packing, quality, substring, toxicity
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.text import Words, shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if sets[a][0] is None or sets[b][0] is None:
                continue
            x, y = sets[a][1], sets[b][1]
            if sets[a][0] == sets[b][0] and x and y or x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[root(a)] = root(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i][1]), None if d is None else low[root(i)] if sets[i][1] else d) for i, (d, t) in enumerate(rows) if d is not None)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(300)]
    make = lambda k: " ".join(rng.choices(vocab, k=k))
    base = make(150)
    out = [make(rng.randint(5, 200)) for _ in range(n // 2)]
    for _ in range(n // 2):  # near copies of one text, each with some words changed
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


def test_similar_groups_match_brute_force(spark):
    texts = corpus() + ["", None, "  \n", "a b c", "A  b\tC", "a b c d", "Ünï cödé wörds hére nöw", "ÜNÏ cödé wörds hére nöw", "x" * 50_000 + " " + "y z " * 3000]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[5][0], "another text for the same id, of six words"), (None, texts[0]), (None, None)]
    df = spark.createDataFrame([(i, t, None, "s", 7) for i, t in rows], DOCS).repartition(5)
    got = jaccard.similar_groups(df.withColumnRenamed("lang", "n")).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute_groups(rows)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = jaccard.one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for _, _, c in brute_groups(rows)})


def test_similar_groups_of_an_empty_table(spark):
    assert jaccard.similar_groups(spark.createDataFrame([], DOCS)).count() == 0


UNLIKE = [" ".join(f"w{i}x{k}" for k in range(i % 9 + 1)) for i in range(50)]


COPIES = [UNLIKE[7]] * 3 + [UNLIKE[8]]
PAIR = [UNLIKE[8], UNLIKE[8].upper(), UNLIKE[7] + " z", UNLIKE[3]]


@pytest.mark.parametrize("texts, fragments", [(UNLIKE, 1), (UNLIKE, 64), (UNLIKE[8:9], 64), (COPIES, 1), (COPIES, 64), (COPIES, 1 << 17), (PAIR, 64)])
def test_similar_groups_where_little_is_shared(spark, texts, fragments):
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, None, "s", 7) for i, t in rows], DOCS)
    monkey = common.partitions
    common.partitions = lambda spark: 1 << 20  # no more tasks for more fragments
    try:
        got = sorted(tuple(r) for r in jaccard.similar_groups(df, fragments=fragments).collect())
        kept = sorted(r.doc_id for r in jaccard.one_of_each(df, fragments=fragments).collect())
    finally:
        common.partitions = monkey
    assert got == brute_groups(rows)
    assert kept == sorted({c for _, _, c in got})


@pytest.mark.parametrize("fragments", [1, 1 << 17])
def test_large_buckets_are_dealt(spark, monkeypatch, fragments):
    monkeypatch.setattr(jaccard, "DEALT", 3)
    monkeypatch.setattr(jaccard, "HUBS", 4)
    monkeypatch.setattr(jaccard, "GROWTH", 2)
    monkeypatch.setattr(common, "partitions", lambda spark: 1 << 20)
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(400)]
    line = "a b c d e f g h"
    texts = [f"{line} {' '.join(rng.choices(vocab, k=3))}" for _ in range(60)] + corpus(12, 40)
    rows = list(enumerate(texts))
    got = jaccard.similar_groups(spark.createDataFrame([(i, t, None, "s", 7) for i, t in rows], DOCS), fragments=fragments).collect()
    assert sorted(tuple(r) for r in got) == brute_groups(rows)


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:350], rng.integers(0, 1 << 63, 60).astype(np.uint64)])
    apart = bin(int.from_bytes((jaccard.parity_bits(a) ^ jaccard.parity_bits(b)).tobytes(), "little")).count("1")
    assert 60 < apart <= 110


def test_shingles_match_plain_python():
    texts = ["", "a", "a b c d e", "a b c d e f", "ä Ö x y z\x0bq", "A a A a A a A a"]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]


def test_chunks_resist_shifts_and_ignore_neighbours():
    rng = random.Random(3)
    w = ["".join(rng.choices("abcdefghijk", k=rng.randint(1, 7))) for _ in range(400)]
    one, shifted = " ".join(w).encode(), " ".join(["new", "start", *w]).encode()
    alone = substring.chunks(Words([one]))[2]
    pair = Words([b"something else, before", one])
    starts, _, both = substring.chunks(pair)
    assert (both[pair.doc[starts] == 1] == alone).all()
    assert len(set(alone) & set(substring.chunks(Words([shifted]))[2])) >= len(alone) - 3
    sizes = substring.chunk_ends(Words([one]))
    assert np.diff(np.concatenate([[0], sizes])).max() <= substring.MAX_WORDS


def test_repeated_passages_go_and_first_ones_stay(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(5000)]
    make = lambda k: " ".join(rng.choices(vocab, k=k))
    passage = make(60)
    rows = [(1, f"{make(80)} {passage} {make(50)}"), (2, f"{make(30)}\n{passage}\n{make(90)}"), (3, passage.upper()), (4, make(100)), (5, None), (6, ""), (7, " \n"), (None, make(40)), (8, make(6) + " é" * 3), (9, make(20_000))]
    rows += [rows[3]]
    df = spark.createDataFrame([(i, t, "x", None, len(t or "")) for i, t in rows], DOCS)
    out = {r.doc_id: r for r in substring.without_repeats(df).collect()}
    assert substring.without_repeats(df).count() == len(rows)
    for i in (1, 4, 5, 6, 7, 8, 9, None):
        assert out[i].text == dict(rows)[i] and not out[i].removed and out[i].removed_words == 0
    kept = set(words(dict(rows)[2])) - set(words(passage))
    assert out[2].removed_words >= 35 and kept <= set(words(out[2].text)) and out[2].n_chars == len(out[2].text)
    assert out[3].removed_words >= 50
    raw = dict(rows)[2].encode()
    (a, b), = [tuple(x) for x in out[2].removed]
    assert (raw[:a] + raw[b:]).decode() == out[2].text
    assert substring.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def plain_chunks(text):
    """[(first byte, byte behind, words)] of each chunk, byte by byte from the definition."""
    raw = text.encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    low = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in raw)
    out, held = [], []

    def close(k):
        out.append((held[0][0], held[k - 1][1], tuple(low[x:y] for x, y in held[:k])))
        del held[:k]

    for s, e in found:
        held.append((s, e))
        h = sum(int(substring._GEAR[low[i]]) << (e - 1 - i) for i in range(max(0, e - 16), e)) & 0xFFFFFFFF
        if len(held) > substring.MAX_WORDS:
            close(substring.MAX_WORDS)
        if h >> 14 & 3 == 0 and len(held) >= substring.MIN_WORDS:
            close(len(held))
    while held:
        close(min(len(held), substring.MAX_WORDS))
    return out


def plain_without_repeats(rows):
    """{id: text} by a dictionary of chunks in order of id and place; a run of 16 repeated words goes."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw, run, cuts = t.encode(), [], []
        parts = plain_chunks(t)
        for k, (s, _, w) in enumerate([*parts, (len(raw), 0, None)]):
            if w is not None and w in seen:
                run.append((s, w))
                continue
            if sum(len(x) for _, x in run) >= substring.MIN_RUN:
                cuts.append((run[0][0], s))
            run = []
            seen.add(w)
        kept, at = b"", 0
        for x, y in cuts:
            kept, at = kept + raw[at:x], y
        out[i] = (kept + raw[at:]).decode()
    return out


@pytest.mark.parametrize("fragments", [None, 1, 64])
def test_repeats_match_brute_force(spark, fragments):
    texts = [*corpus(7, 80), "one and only one and only one and only " * 20, "É " * 50, "\x0b a b  c\t"]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS).repartition(7)
    got = {r.doc_id: r.text for r in substring.without_repeats(df, fragments=fragments).collect()}
    expect = plain_without_repeats(enumerate(texts))
    assert got == expect and sum(got[i] != t for i, t in enumerate(texts)) > 10


def test_mix_reaches_targets_and_repeats_itself(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 300), None, f"s{i % 4}" if i % 9 else None, 0) for i in range(900)] + [(None, "a b", None, "s1", 0), (None, None, None, "empty", 0), (3, "x", None, "s1", 0), (3, "x", None, "s1", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(9)).collect()))
    total = sum(len(words(r[1])) for r in rows)
    by = {}
    for r in got:
        assert r.size == len(words(r.text)) and 0 <= r.copies <= 2
        s = by.setdefault(r.source, [0, r.target, r.source_size, 0])
        s[0] += r.copies * r.size
        s[3] += r.size
    assert abs(sum(s[1] for s in by.values()) - 1.5 * total) < 1e-6 * total
    for taken, target, size, own in by.values():
        assert size == own and target <= 2 * size + 1e-9 and abs(taken - target) <= 301
    assert mixing.mixed_rows(df).count() == sum(r.copies for r in got)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_targets_share_the_excess_by_weight(spark):
    t = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(t).collect()}
    # weights 5 2 1 5, all sizes 310, share 465: a stops at 20, the rest is shared 2 : 1 : 5, null stops at 200
    assert got["a"] == 20 and got[None] == 200
    assert got["b"] == pytest.approx(245 * 2 / 3) and got["c"] == pytest.approx(245 / 3)


def encode(text):
    from tokenizers import Tokenizer

    t = encode.t = getattr(encode, "t", None) or Tokenizer.from_file(tokenizer_path())
    return t.encode(text, add_special_tokens=False).ids


ODD = ["", "Hello, World!! it's   fine", "naïve ÉCOLE ß İstanbul ΣΑΣ", "tab\tand\nline\x0bvt\x1cfs\x85nel nbsp ls", "a<|endoftext|>b <|startoftext|>", "x" * 300, "12345 6,7 can't WE'LL", "é́ café́ ﬁ ½ Ⅷ 漢字 🙂", "a.b.c ... --- '''", "don'T 'S"]


def test_encoder_gives_the_tokenizers_ids():
    e = packing.Encoder(tokenizer_path())
    for _ in range(2):
        for text in ODD:
            assert e.encode(text).tolist() == encode(text), text


def test_packing_keeps_every_id_once(spark):
    rng = random.Random(6)
    texts = [*ODD, None, "long " * 9000, *(" ".join(rng.choices(["alpha", "beta", "gamma,", "Ünder"], k=rng.randint(1, 900))) for _ in range(60))]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[1], (None, "no id", None, None, 0)], DOCS).repartition(3)
    pieces = packing.pack(df, tokenizer_path()).collect()
    docs, windows = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        docs.setdefault(p.doc_id, []).append(p)
        windows.setdefault(p.sequence_id, []).append(p)
    for i, t in enumerate(texts):
        expect = [*encode(t or ""), 1] * (2 if i == 1 else 1)
        if i != 1:
            own = sorted(docs[i], key=lambda p: p.start)
            assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == expect
            assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
            assert all(p.doc_tokens == len(expect) for p in own)
        else:
            assert sum(p.length for p in docs[i]) == len(expect)
    for w in windows.values():
        w.sort(key=lambda p: p.offset)
        assert [p.offset for p in w] == [sum(q.length for q in w[:k]) for k in range(len(w))]
        fill = sum(p.length for p in w)
        assert fill <= 2048 and fill & (fill - 1) == 0
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


def test_sum_of_squares_picks_the_least_sum():
    rng, levels = random.Random(8), packing.SumOfSquares(16)
    for n in (rng.randint(1, 16) for _ in range(400)):
        before = levels.count.copy()
        full = levels.place(("x", 0, np.zeros(n), n, packing.PLACED))
        options = []
        for h in range(0, 17 - n):
            if h and not before[h]:
                continue
            c = before.copy()
            if h:
                c[h] -= 1
            if h + n < 16:
                c[h + n] += 1
            options.append((c**2).sum())
        assert (levels.count**2).sum() == min(options)
        assert len(full) < 2 and all(sum(len(i[2]) for i in w) == 16 for w in full)


@pytest.mark.parametrize("n, least", [(250, 0.85), (2000, 0.95), (8000, 0.98)])
def test_the_rule_places_most_pieces_whole(n, least):
    rng = np.random.default_rng(0)
    docs = [(i, np.arange(int(np.clip(rng.lognormal(5, 1), 1, 20_000)), dtype="<u4")) for i in range(n)]
    windows = list(packing.pack_ids(iter(docs)))
    pieces = [p for w in windows for p in w]
    whole = sum(p[4] in (packing.FULL, packing.PLACED) for p in pieces)
    assert whole >= least * len(pieces)
    fills = [sum(len(p[2]) for p in w) for w in windows]
    assert sum(f < packing.CAPACITY for f in fills) <= 11 and all(f & (f - 1) == 0 for f in fills)
    if n >= 2000:  # most windows hold nothing that was cut
        cut = sum(any(p[4] in (packing.SPLIT, packing.SEALED) for p in w) for w in windows)
        assert cut <= 0.25 * len(windows)
    by = {}
    for key, start, ids, total, _ in sorted(pieces, key=lambda p: p[:2]):
        assert by.get(key, 0) == start and ids[0] == start
        by[key] = start + len(ids)
    assert by == {k: len(ids) for k, ids in docs}


def test_toxicity_learns_from_positives_alone():
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    bad = ["vilest", "scorned", "loathly"]
    make = lambda toxic: " ".join([*rng.choices(vocab, k=60), *(rng.choices(bad, k=3) if toxic else [])]).encode()
    pos = toxicity.feature_sets([make(True) for _ in range(200)])
    unl = toxicity.feature_sets([make(i % 10 == 0) for i in range(1500)])
    m = toxicity.fit(pos, unl, 0.1)
    good, poor = m.score([make(False) for _ in range(200)]), m.score([make(True) for _ in range(200)])
    assert (good < 0.5).mean() > 0.99 and (poor >= 0.5).mean() > 0.99
    assert toxicity.fit([], unl, 0.1).score([b"", b"x"]).tolist() == pytest.approx([0.1, 0.1])


def test_toxicity_needs_no_labelled_negatives(spark):
    rng = random.Random(19)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    bad = [f"vile{c}" for c in "qrstuvw"]
    toxic = [i % 10 == 0 for i in range(2000)]
    texts = [" ".join([*rng.choices(vocab, k=50), *(rng.choices(bad, k=3) if t else [])]) for t in toxic]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 0, 1) for i, t in enumerate(toxic) if t], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels, toxicity.may_teach())
    flagged = np.zeros(2000, bool)
    for r in toxicity.score(df, model).collect():
        flagged[r.doc_id] = r.score >= 0.5
    toxic = np.array(toxic)
    assert flagged[~toxic].mean() < 0.05 and flagged[toxic].mean() > 0.95
    p = toxicity.feature_sets([t.encode() for t, x in zip(texts, toxic, strict=True) if x])
    u = toxicity.feature_sets([t.encode() for t in texts])
    assert 0.08 < toxicity.estimate_prior(p, u) < 0.16
    assert toxicity.estimate_prior(u[:100], u) < 0.2  # positives like any text: their own share


def test_toxicity_weighs_more_than_the_plainest_words():
    # each positive has some of 40 words that clean texts have too, only less often; no word decides alone
    rng = random.Random(29)
    mild = [f"mild{chr(97 + k // 6)}{chr(97 + k % 6)}" for k in range(40)]
    vocab = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    make = lambda k: " ".join([*rng.choices(vocab, k=40), *rng.sample(mild, k)]).encode()
    p = toxicity.feature_sets([make(12) for _ in range(400)])
    u = toxicity.feature_sets([make(12 if i % 10 == 0 else 2) for i in range(3000)])
    m = toxicity.fit(p, u, 0.1)
    assert (m.weights != 0).sum() >= 35
    assert (m.score([make(12) for _ in range(300)]) >= 0.5).mean() > 0.95 and (m.score([make(2) for _ in range(300)]) >= 0.5).mean() < 0.02


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y, 30, 40)
    assert ((m.margin(x) > 0) == (y == 1)).mean() > 0.95
    assert quality.fit(x, np.ones(4000)).margin(x[:2]).tolist() == pytest.approx([np.log(99)] * 2)
    f = quality.features([b"", b" \n", "É!! ONE | two 3".encode(), b"x" * 100_000])
    assert f.shape == (4, len(quality.NAMES)) and np.isfinite(f).all() and not f[:2].any()


def test_langid_rejects_what_is_far_and_names_the_rest(spark):
    rng = random.Random(2)
    word = {"aa": ["kalo", "miru", "sefa", "dona"], "bb": ["schtz", "pfrng", "grlst", "zwkn"]}
    rows = [(i, " ".join(rng.choices(word[k], k=40)), k, None, 0) for i in range(200) for k in [("aa", "bb")[i % 2]]]
    rows += [(1000, None, "aa", None, 0), (1001, "123 !!", "aa", None, 0), (1002, "", None, None, 0), (None, "kalo miru", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = langid.predict(df, langid.train(df, langid.may_teach())).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("aa", "bb")[i % 2] and 0 <= by[i].score <= 1 for i in range(200))
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[None].lang_pred == "aa"
    none = spark.createDataFrame([], DOCS)
    assert langid.predict(df, langid.train(none, langid.may_teach())).where("lang_pred <> 'und'").count() == 0


def test_scores_cover_every_row(spark):
    rows = [(i, t, None, None, 0) for i, t in enumerate([*ODD, None, "word " * 30_000])] + [(None, "x", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(8)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.score(df, module.train(df, labels, module.may_teach())).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.clean(df, toxicity.train(df, labels, toxicity.may_teach())).columns == df.columns
    none = spark.createDataFrame([], DOCS)
    assert quality.score(none, quality.train(none, labels.limit(0), quality.may_teach())).count() == 0


def test_crc_of_ids(spark):
    got = spark.createDataFrame([(12,), (None,)], "doc_id long").select(toxicity.may_teach().alias("t")).collect()
    assert [r.t for r in got] == [zlib.crc32(b"12") % 5 != 0, zlib.crc32(b"") % 5 != 0]
