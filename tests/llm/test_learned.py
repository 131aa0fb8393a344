"""Operators that learn or approximate: against enumeration, held-out rows and exact search."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm import cotrain_quality, crf_language, multi_index_hash, string_kernel_toxicity
from kinloom.llm.queries import queries

SF = "/root/testdata/sf0.01"


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    chain = crf_language.Chain(["a", "b", "c"], np.zeros((crf_language.SLOTS, 3), np.float32), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores, first = rng.normal(size=(11, 3)), np.array([0, 5, 5, 6, 11])
    for segment in (2, 64):
        crf_language.SEGMENT, kept = segment, crf_language.SEGMENT
        try:
            got = chain.marginals(scores, first)
        finally:
            crf_language.SEGMENT = kept
        for a, b in zip(first[:-1], first[1:], strict=True):
            want = np.zeros((b - a, 3))
            for path in itertools.product(range(3), repeat=b - a):
                s = chain.first[path[0]] + sum(scores[a + k, p] for k, p in enumerate(path)) + sum(chain.move[p, q] for p, q in itertools.pairwise(path)) if path else 0
                for k, p in enumerate(path):
                    want[k, p] += np.exp(s)
            if b > a:
                assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True), atol=1e-5)


def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = crf_language.held_out("doc_id", 3, 1)
    chain = crf_language.learn(docs, ~out)
    r = crf_language.identify(docs, chain).join(docs.select("doc_id", "lang"), "doc_id").where(out)
    assert r.where("lang = lang_pred").count() >= 0.98 * r.count() and r.where("score < 0 OR score > 1").isEmpty()
    words = crf_language.label_words("The thing heern and, ionerth der einung pfkeit \u00fcber die", chain)
    assert [x[1] for x in words][:4] == ["en"] * 4 and [x[1] for x in words][-4:] == ["de"] * 4
    odd = [(r["doc_id"], r["lang_pred"], r["score"]) for r in crf_language.identify(odd_docs, chain).collect()]
    assert len(odd) == odd_docs.count() and {x for x in odd if x[0] in (3, 4, 5, 9)} == {(k, "und", 0.0) for k in (3, 4, 5, 9)}
    carried = crf_language.identify(odd_docs, chain, carry=True)
    assert carried.count() == odd_docs.count() and "slot" in carried.columns
    assert crf_language.identify(no_docs, chain).count() == 0
    nothing = crf_language.learn(docs.where("false"), F.lit(True))
    assert nothing.labels == ["und"] and crf_language.identify(odd_docs, nothing).where("lang_pred <> 'und'").isEmpty()


def test_lexicon_and_words_without_blanks():
    """A word of one language is in the lexicon; of a word longer than WIDTH every byte is read."""
    texts = [(f"{'abcde'[k % 5]}{w} common {w} {w}{'uvwxyz'[k % 6]}".encode(), lang) for k in range(30) for w, lang in (("chat", "fr"), ("katze", "de"))]
    chain = crf_language.train(texts)
    name = lambda w: crf_language.word_names(*crf_language.Block(np.frombuffer(w, np.uint8), np.array([0, len(w)])).characters(np.array([0]), crf_language.WIDTH))
    assert [chain.lexicon.of(name(w))[0] for w in (b"chat", b"Katze", b"common", b"other")] == [1, 0, -1, -1]
    tail = crf_language.label_words("q" * 100 + "katze" * 40, chain)
    assert "".join(w for w, _, _ in tail) == "q" * 100 + "katze" * 40 and tail[-1][1] == "de"


def kernel_by_hand(s, t):
    total = 0.0
    for i in itertools.combinations(range(len(s)), 3):
        for j in itertools.combinations(range(len(t)), 3):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += string_kernel_toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


@pytest.mark.parametrize(("a", "b"), [("idiot", "idiot"), ("idiot", "idxiot"), ("abcabc", "cabab"), ("ab", "abc"), ("", "abc")])
def test_subsequence_kernel(a, b):
    raw = lambda x: np.frombuffer(x.encode().ljust(string_kernel_toxicity.WIDTH, b"\0"), dtype=np.uint8)[None]
    assert string_kernel_toxicity.kernel(raw(a), raw(b))[0] == pytest.approx(kernel_by_hand(a, b), rel=1e-5)


def test_toxicity(spark, odd_docs, no_docs):
    bad, pick = ["blorgard", "snixwort"], np.random.default_rng(3)
    rows, marks = [], []
    for k in range(400):
        words = [f"{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10 % 10]}{'uvwxyz'[x % 6]}ord" for x in pick.integers(0, 3000, 30).tolist()]
        if k % 3 == 0:
            words[k % 30] = bad[k % 2]
        rows.append((k, " ".join(words)))
        marks.append((k, int(k % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    out = crf_language.held_out("doc_id", 5, 0)
    machine = string_kernel_toxicity.learn(docs, labels, ~out)
    r = string_kernel_toxicity.score(docs, machine).join(labels, "doc_id").where(out)
    assert r.where("predicted = toxic").count() == r.count() > 40
    probe = spark.createDataFrame([(1, "w1ord blor*gard w2ord"), (2, "w1ord b l o r g a r d w3ord"), (3, "w1ord w2ord")], "doc_id long, text string")
    assert {x["doc_id"]: x["predicted"] for x in string_kernel_toxicity.score(probe, machine).collect()} == {1: 1, 2: 1, 3: 0}
    odd = string_kernel_toxicity.score(odd_docs, machine).collect()
    assert len(odd) == odd_docs.count() and all(x["predicted"] == 0 for x in odd if x["doc_id"] in (3, 4, 5))
    assert string_kernel_toxicity.score(no_docs, machine).count() == 0
    blank = string_kernel_toxicity.learn(docs, labels.where("false"), F.lit(True))
    assert string_kernel_toxicity.score(docs, blank).where("predicted = 1").isEmpty()


def test_quality(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = crf_language.held_out("doc_id", 5, 0)
    views = cotrain_quality.learn(docs, labels, ~out)
    r = cotrain_quality.score(docs, views).join(labels, "doc_id").where(out)
    assert r.where("kept = (quality = 1)").count() >= 0.95 * r.count()
    odd = {(x["doc_id"], x["kept"], x["score"]) for x in cotrain_quality.score(odd_docs, views).collect() if x["doc_id"] in (3, 4, 5)}
    assert odd == {(k, False, 0.0) for k in (3, 4, 5)}
    assert cotrain_quality.score(odd_docs, views, carry=True).count() == odd_docs.count() and cotrain_quality.score(no_docs, views).count() == 0
    assert cotrain_quality.score(docs, cotrain_quality.learn(docs, labels.where("false"), F.lit(True))).where("kept").count() > 900


def exchange_by_hand(text, meta, label, pool_text, pool_meta):
    """The exchange of labels row by row: (taught, pupils' labels)."""
    C = cotrain_quality
    aside, every, pool = [k % 4 == 0 for k in range(len(label))], {"text": text, "meta": meta}, {"text": pool_text, "meta": pool_meta}
    learn, held = [k for k, a in enumerate(aside) if not a], [k for k, a in enumerate(aside) if a]
    given, log, n = {"text": {}, "meta": {}}, [], len(pool_text)
    rate = sum(label[k] for k in learn) / len(learn)

    def model(view):
        rows = sorted(given[view])
        x = np.array([every[view][k] for k in learn] + [pool[view][k] for k in rows])
        return C.Logistic().fit(x, np.array([float(label[k]) for k in learn] + [given[view][k][0] for k in rows]), np.array([1.0] * len(learn) + [given[view][k][1] for k in rows]))

    for turn in range(C.ROUNDS):
        models = {v: model(v) for v in given}
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            says, own = models[teacher].margin(pool[teacher]), models[pupil].margin(pool[pupil])
            ranked = sorted((k for k in range(n) if k not in given[pupil]), key=lambda k: (says[k], k))
            counts, worths = [], []
            sure = [float(models[teacher].margin(every[teacher][k : k + 1])[0]) for k in held]
            for value, share in ((0, 1 - rate), (1, rate)):
                best = sorted(range(len(held)), key=lambda j: (sure[j] if value == 0 else -sure[j], j))[: max(1, int(np.ceil(C.SHARE * (turn + 1) * share * len(held))))]
                right, chance = (sum(label[held[j]] == value for j in best) + 1) / (len(best) + 2), sum(label[k] == value for k in held) / len(held)
                worths.append(max(0.0, (right - (right * (1 - right) / len(best)) ** 0.5 - chance) / (1 - chance)))
                many = int(C.SHARE * n * share)
                chosen = ranked[:many] if value == 0 else ranked[len(ranked) - many :]
                chosen = [k for k in chosen if (own[k] < C.SURE if value == 0 else own[k] > -C.SURE)]
                counts.append(chosen)
            for value in (0, 1):
                if worths[value] > 0:
                    given[pupil].update({k: (float(value), C.TAUGHT * worths[value]) for k in counts[value]})
            log.append((turn, teacher, *[len(c) if w > 0 else 0 for c, w in zip(counts, worths, strict=True)], *worths))
    return log, model("text"), model("meta")


def test_exchange_of_labels():
    """Two views of their own noise: both teach both labels, as by hand, and nobody weighs against itself."""
    rng = np.random.default_rng(4)
    make = lambda n: (y := (rng.random(n) < 0.6).astype(int), *[(2 * y - 1)[:, None] * s + rng.normal(size=(n, d)) for s, d in ((0.5, 6), (0.4, 5))])
    (y, text, meta), (_, pool_text, pool_meta), (want, more_text, more_meta) = make(400), make(2000), make(3000)
    views = cotrain_quality.cotrain(text, meta, y, pool_text, pool_meta)
    log, by_text, by_meta = exchange_by_hand(text, meta, y, pool_text, pool_meta)
    assert [t[:4] for t in views.taught] == [t[:4] for t in log] and np.allclose([t[4:] for t in views.taught], [t[4:] for t in log])
    assert np.allclose(views.text.margin(more_text), by_text.margin(more_text)) and np.allclose(views.meta.margin(more_meta), by_meta.margin(more_meta))
    for teacher in ("text", "meta"):
        assert all(sum(t[k] for t in views.taught if t[1] == teacher) > 50 for k in (2, 3))
    assert min(views.blend[:2]) > 0
    both, a, b = views.scores(more_text, more_meta)
    right = lambda p: np.mean((p >= 0.5) == (want == 1))
    assert right(both) > max(right(a), right(b)) > 0.7


def test_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[100:130] = x[100]
    x[300:310] = x[300] + 0.01 * rng.normal(size=(10, 24)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] + [1.0] * 23), (None, x[0].tolist()), (1004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS lead")
    got = {}
    for r in multi_index_hash.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    e = x.astype(float)
    hits = 0
    assert set(got) == set(range(0, 600, 20))
    for q, found in got.items():
        found.sort()
        s = e @ e[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -np.round(s, 9)))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        hits += len({int(w) for w in want} & {f[1] for f in found})
    assert hits / (20 * len(got)) >= 0.9
    assert [f[1] for f in got[100]][:20] == list(range(101, 121))
    few = multi_index_hash.search(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0, k=20).collect()
    assert len(few) == 4
    assert multi_index_hash.search(df.where("false"), F.lit(True)).count() == 0


def test_indexes_find_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    codes[:50] ^= (1 << rng.integers(0, 16, (50, 4))).astype(np.uint16)
    index = multi_index_hash.SubstringIndexes(codes)
    for a in (0, 1, 2):
        q, r, bits = index.probe(codes[:60], a)
        assert (bits <= 4 * (a + 1) - 1).all()
        whole = np.ascontiguousarray(codes).view(np.uint64).ravel()
        want = np.argwhere(np.bitwise_count(whole[:60, None] ^ whole[None, :]) <= 4 * (a + 1) - 1)
        assert sorted(zip(q.tolist(), r.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


@pytest.mark.parametrize("order", range(10))
def test_ties_with_the_last_go_by_id(spark, order):
    """Twenty nearer rows and 21 copies of the next vector: the smallest ids of the copies, whatever the rows' order."""
    rng = np.random.default_rng(order)
    base = rng.normal(size=16)
    near, tied = base * 2 + 0.01 * rng.normal(size=(19, 16)), base * 1.5
    x = np.concatenate([base[None, :], near, np.repeat(tied[None, :], 21, axis=0), rng.normal(size=(200, 16)) * 0.1])
    ids, at = np.arange(len(x)), rng.permutation(len(x))
    coder = multi_index_hash.fit(x)
    q, got, score, _ = multi_index_hash.search_block(coder, 1.5, 21, ids[:1], x[:1], ids[at], x[at])
    assert got.tolist() == np.lexsort((ids, -(x[:1] * x).sum(axis=1)))[:21].tolist()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_search_of_the_whole_table(spark, sf):
    """Recall against brute force, and that results come from probed codes: fewer inner products than pairs are worked out."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    table = df.toPandas()
    x = np.array(table["embedding"].tolist(), dtype=float)
    ids = table["vec_id"].to_numpy()
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x, ids = x[ok], ids[ok]
    asked = np.flatnonzero(ids % 20 == 0)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    kth = dict(zip(ids[asked].tolist(), np.sort(scores, axis=1)[:, -20], strict=True))
    rows = queries()["op4_multi_index_hash"](spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == 20 * len(asked)
    assert sum(r["score"] >= kth[r["query_id"]] - 1e-9 for r in rows) / len(rows) >= 0.95
    *_, scored = multi_index_hash.search_block(multi_index_hash.fit(x), multi_index_hash.REACH, 21, ids[asked], x[asked], ids, x)
    assert scored < 0.7 * len(asked) * len(x)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_runs_whole(spark, name):
    d = "/root/testdata/sf0.001"
    rows = queries()[name](spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").count()
    assert rows.count() >= docs if "op4" not in name else rows.count() == 500


def toxic_texts():
    bad, pick = ["blorgard", "snixwort"], np.random.default_rng(3)
    out = []
    for k in range(300):
        words = [f"{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10 % 10]}{'uvwxyz'[x % 6]}ord" for x in pick.integers(0, 3000, 30).tolist()]
        if k % 3 == 0:
            words[k % 30] = bad[k % 2]
        out.append((" ".join(words).encode(), int(k % 3 == 0)))
    return out


@pytest.mark.parametrize("rounds", [1, 2, 8])
def test_toxicity_is_calibrated_on_the_weights_kept(rounds):
    texts = toxic_texts()
    machine = string_kernel_toxicity.train(texts, rounds)
    column = string_kernel_toxicity.pa.array([t for t, _ in texts], string_kernel_toxicity.pa.binary())
    worst = np.concatenate([string_kernel_toxicity.worst_words(b, machine, string_kernel_toxicity.TypeTable(1, dtype=np.float64)) for _, _, b in string_kernel_toxicity.blocks(column, fold_ascii=True, marks=string_kernel_toxicity.MARKS)])
    want = string_kernel_toxicity.platt(worst, np.array([float(y) for _, y in texts]))
    assert (machine.slope, machine.offset) == pytest.approx(want, rel=1e-3)


@pytest.mark.parametrize("bad", ["blorgard", "SNIXWORT"])
@pytest.mark.parametrize("joined", ["fine-words_that(are/joined-here-{}", "nothing\u00a0but\u00a0good\u00a0words\u00a0{}\u00a0here", "{}".rjust(40, "\u4e00"), "#" * 30 + "{}", "spelled"])
def test_toxicity_reads_long_words_to_their_end(joined, bad):
    machine = string_kernel_toxicity.train(toxic_texts())
    make = (lambda w: "two " + " ".join("thesearethirtylettersinonerowx" + w)) if joined == "spelled" else (lambda w: "two " + joined.format(w))
    column = string_kernel_toxicity.pa.array([make(bad).encode(), make("harmless").encode()], string_kernel_toxicity.pa.binary())
    block = next(iter(string_kernel_toxicity.blocks(column, fold_ascii=True, marks=string_kernel_toxicity.MARKS)))[2]
    p = machine.probability(string_kernel_toxicity.worst_words(block, machine, string_kernel_toxicity.TypeTable(1, dtype=np.float64)))
    assert p[0] >= 0.5 > p[1]


def test_toxicity_knows_words_by_their_stem():
    """Stems whose inflected forms hardly recur are learned beside a hundred frequent toxic words, and known in forms never seen."""
    rng = random.Random(11)
    syllables = ["er", "an", "the", "ing", "ou", "ti", "le", "nd", "sto", "ha"]
    ordinary = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    frequent = [stem + end for stem in ("gruw", "plox") for end in (a + b for a in syllables for b in syllables[:5])]
    rare = lambda: "zorvk" + ordinary(3)

    def text(bad):
        words = [ordinary(rng.randint(1, 3)) for _ in range(30)]
        return " ".join([*words[:15], *([bad] if bad else []), *words[15:]]).encode()

    texts = [(text(frequent[k % len(frequent)]), 1) for k in range(600)] + [(text(rare()), 1) for _ in range(60)] + [(text(None), 0) for _ in range(700)]
    machine = string_kernel_toxicity.train(texts)
    asked = [text(rare()) for _ in range(50)] + [text("gruwhahaha")] + [text(None) for _ in range(100)]
    column = string_kernel_toxicity.pa.array(asked, string_kernel_toxicity.pa.binary())
    p = np.concatenate([machine.probability(string_kernel_toxicity.worst_words(b, machine, string_kernel_toxicity.TypeTable(1, dtype=np.float64))) for _, _, b in string_kernel_toxicity.blocks(column, fold_ascii=True, marks=string_kernel_toxicity.MARKS)])
    assert (p[:51] >= 0.5).all() and (p[51:] < 0.5).mean() > 0.97
