"""Operators with exact results, against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinloom.llm import common, hash_tree, histogram_pack, prefix_bpe, rule_ledger, set_relation_join, template_tree
from kinloom.llm.common import Shelf
from kinloom.llm.components import components

WORD_BPE, BYTE_BPE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
CODEC, LIBRARY = prefix_bpe.TextCodec(WORD_BPE), Tokenizer.from_file(WORD_BPE)
CHUNKS, BYTES = histogram_pack.ChunkTokenizer(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
TEXTS = st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "don't", "x's", "...", "Straße", "thehe,", "İ", "e\u0301", " ", "\n", "  "])), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_word_bpe_equals_library(text):
    (ids, decoded), want = next(CODEC.encode_column(pa.array([text.encode()]))), LIBRARY.encode(text, add_special_tokens=False)
    assert ids.tolist() == want.ids
    assert decoded.tobytes().decode() == LIBRARY.decode(want.ids, skip_special_tokens=False) == CODEC.decode(want.ids)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_byte_bpe_equals_library(text):
    assert next(CHUNKS.encode(pa.array([text.encode()]))).tolist() == BYTES.encode(text, add_special_tokens=False).ids


def test_bpe_rows(spark, odd_docs, no_docs):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in prefix_bpe.encode_texts(odd_docs, WORD_BPE).collect())
    want = []
    for r in odd_docs.collect():
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()))
    assert got == sorted(want)
    assert prefix_bpe.encode_texts(no_docs, WORD_BPE).count() == 0


def test_packing(spark, odd_docs, no_docs):
    rows = histogram_pack.pack_documents(odd_docs, BYTE_BPE, capacity=64).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = BYTES.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        cuts = list(range(len(ids) % 64 or 64, len(ids) + 1, 64)) if len(ids) > 64 else [len(ids)]
        start = 0
        for k, stop in enumerate(cuts):
            want[(r["doc_id"], k, start, stop - start, zlib.crc32(np.array(ids[start:stop], dtype="<u4").tobytes()))] += 1
            start = stop
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    full = {}
    for r in rows:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert histogram_pack.pack_documents(no_docs, BYTE_BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=20))
def test_plan_is_best_fit(histogram):
    slots = histogram_pack.plan(histogram, 50)
    ranks, used = Counter(), {}
    for length, low, high, sequence, offset in slots:
        ranks[length] += high - low
        for k in range(high - low):
            used.setdefault(sequence + k, []).append((offset, length))
    assert ranks == Counter(histogram)
    for parts in used.values():
        assert sum(n for _, n in parts) <= 50 and sorted(parts)[0][0] == 0
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(50 - length)
    assert len(used) <= len(rooms)


@pytest.mark.parametrize("place", [(0, 0), (1, 2), (5, 0)])
def test_hash_tree_moves_rows_only_into_the_new_shard(spark, place):
    tree = hash_tree.even_tree(24)
    rows = hash_tree.assign(spark.range(20000).withColumnRenamed("id", "doc_id"), "doc_id", tree, hash_tree.grow(tree, *place)).collect()
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows)
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) < 1.25 * min(sizes.values())
    assert 500 < sum(r["grown_shard"] == 24 for r in rows) < 1100
    twice = hash_tree.grow(hash_tree.grow(tree, *place), 0, 1)
    again = hash_tree.assign(spark.range(5000).withColumnRenamed("id", "doc_id"), "doc_id", hash_tree.grow(tree, *place), twice).collect()
    assert all(r["grown_shard"] in (r["shard"], 25) for r in again)


def test_hash_tree_weights_confine_movement(spark):
    tree = hash_tree.even_tree(24)
    heavier = tuple(hash_tree.Leaf(x.shard, x.region, x.rack, 3.0 if x.shard == 5 else 1.0, x.layer) for x in tree)
    rows = hash_tree.assign(spark.range(5000).withColumnRenamed("id", "doc_id"), "doc_id", tree, heavier).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert moved and all(r["grown_shard"] // 12 == 0 for r in moved)


def test_hash_tree_rows(spark, odd_docs, no_docs):
    tree = hash_tree.even_tree(6, 1, 2)
    rows = hash_tree.shard_documents(odd_docs, tree, hash_tree.grow(tree)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in odd_docs.collect())
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert hash_tree.shard_documents(no_docs, tree).count() == 0


def ledger_of(text):
    t = text or ""
    words = [w for w in re.split("[\x20\x09-\x0D]+", t) if w]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_ledger(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(100, "a b c d e f g h i a b c d e f g h\nx\nx\n\n\n y #|"), (101, "w " * 40), (102, " ".join(f"k{i}" for i in range(30)))], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    rows = rule_ledger.ledger(docs).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in rows) == Counter((r["doc_id"], *ledger_of(r["text"])) for r in docs.collect())
    entries = rule_ledger.apply_policy(rule_ledger.ledger(docs), "base-1")
    for r in entries.collect():
        assert r["kept"] == (not (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]))
    ab = {r["rule"]: r for r in rule_ledger.ablations(entries, "base-1").collect()}
    alone = sum(1 for r in rows if r["fail_bits"] & rule_ledger.BASE_MASK == 1)
    assert ab["too_few_words"]["failed_alone"] == alone and ab["too_few_words"]["kept_without"] == entries.where("kept").count() + alone
    assert rule_ledger.ledger(no_docs).count() == 0 and rule_ledger.ablations(rule_ledger.ledger(no_docs), "base-1").first()["failed"] == 0


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(r["text"]) for r in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    names = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            names[top(i)] = min(names.get(top(i), r["doc_id"]), r["doc_id"])
    return Counter((r["doc_id"], len(sets[i]), names.get(top(i))) for i, r in enumerate(rows))


def test_join_on_odd_rows(spark, odd_docs, no_docs):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in set_relation_join.link_components(odd_docs).collect())
    assert got == brute_components(odd_docs.collect())
    assert set_relation_join.link_components(no_docs).count() == 0


def test_join_on_chains_of_edits(spark):
    r = random.Random(4)
    rows, base = [], None
    for k in range(260):
        if k % 20 == 0 or base is None:
            base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 6, 12, 40, 120]))]
        base = list(base)
        for _ in range(r.choice([0, 1, 1, 2])):
            base[r.randrange(len(base))] = f"w{r.randint(0, 400)}"
        rows.append((k, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in set_relation_join.link_components(docs).collect())
    assert got == brute_components(docs.collect())


def thue_morse() -> tuple[str, str]:
    """Two words of 1,024 letters whose polynomial hashes modulo 2^64 are equal for any base and any values of the letters."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    one, two = thue_morse()
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{two} {one}")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["component_id"] for r in set_relation_join.link_components(docs).collect()} == {1: 1, 2: 2, 3: 3}
    texts = dict(docs.collect())
    for r in prefix_bpe.encode_texts(docs, WORD_BPE).collect():
        ids = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    got = {r["doc_id"]: r["ids_crc32"] for r in histogram_pack.pack_documents(docs, BYTE_BPE).collect() if r["piece"] == 0 and r["length"] < 1024}
    assert got
    for doc_id, crc in got.items():
        assert crc == zlib.crc32(np.array([*BYTES.encode(texts[doc_id], add_special_tokens=False).ids, 2], dtype="<u4").tobytes())


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 8), (7, 7), (20, 21), (None, 3), (1, None)], "a long, b long")
    with Shelf(spark) as shelf:
        assert {r["node"]: r["label"] for r in components(shelf, edges).collect()} == {3: 3, 4: 3, 5: 3, 8: 3, 9: 3, 20: 20, 21: 20}
        assert components(shelf, edges.where("false")).count() == 0


def test_line_templates(spark, odd_docs, no_docs):
    boiler = "Copyright 20{} by the ACME company all rights are kept"
    rows = [(k, "\n".join([f"unique{'abcde'[k]} start of text", boiler.format(10 + k), "", "To.", f"tail{'abcde'[k]} a b c"])) for k in range(5)] + [(9, "no boilerplate at all\n" + boiler.format(99) + "\nTo."), (10, None), (11, "")]
    rows += [(20, boiler.format(77)), (21, "the very same sentence with quite some words here"), (22, "the very same sentence with quite other words here"), (23, "the very same sentence with quite odd words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS place", "1 AS mh")
    got = {r["doc_id"]: r for r in template_tree.dedup_lines(docs).collect()}
    assert got[0]["n_dropped"] == 0 and got[0]["text"] == rows[0][1]
    for k in range(1, 5):
        assert got[k]["n_dropped"] == 1 and got[k]["text"] == f"unique{'abcde'[k]} start of text\n\nTo.\ntail{'abcde'[k]} a b c"
    assert got[9]["text"] == "no boilerplate at all\nTo." and got[10]["text"] is None and got[11]["text"] == ""
    assert got[20]["emptied"] and not got[9]["emptied"] and got[0]["place"] == "c"
    assert [got[k]["n_dropped"] for k in (21, 22, 23)] == [0, 1, 1]
    assert template_tree.dedup_lines(odd_docs).count() == odd_docs.count() and template_tree.dedup_lines(no_docs).count() == 0


def test_lines_of_two_documents(spark):
    long = " ".join(f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60))
    dated = f"In 2019 {long} on page 7"
    passage = ["a passage of several lines that two documents share", "its second line is not long by itself but belongs", "and with a third line it is whole"]
    rows = [(1, f"{long}\nfirst own line here"), (2, f"second own line here\n  {long.replace(' ', '  ', 1)} "), (3, dated), (4, f"fourth own line here\n{dated}"), (5, f"fifth own line here\n{dated.replace('7', '8')}")]
    rows += [(6, "\n".join(["sixth own line here", *passage])), (7, "\n".join([*passage, "seventh own line here"])), (8, f"{rows[0][1]}x\nVolume 1 of all the works\nVolume 1 of all the works"), (9, "Volume 2 of all the works\nninth own line here")]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in template_tree.dedup_lines(docs, min_docs=4).collect()}
    assert got[1] == rows[0][1] and got[3] == dated and got[6] == rows[5][1]
    assert [got[k] for k in (2, 4, 7)] == ["second own line here", "fourth own line here", "seventh own line here"]
    assert got[5] == rows[4][1] and got[9] == rows[8][1]
    assert got[8] == "first own line herex\nVolume 1 of all the works\nVolume 1 of all the works"
    three = {r["doc_id"]: r["text"] for r in template_tree.dedup_lines(docs).collect()}
    assert three[5] == "fifth own line here" and three[9] == rows[8][1]


@pytest.mark.parametrize("n", [6, 9, 12, 17, 40])
def test_a_leaf_has_as_many_templates_as_it_takes(spark, n):
    kinds = "abcdefghijkl"
    line = lambda kind, k: " ".join(["all", "lines", "begin", *[f"{kind}{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26]}" for i in range(3, n - 1)], f"end{'uvwxyz'[k]}"])
    rows = [(k, "\n".join([f"own{'uvwxyz'[k]} text of a document"] + [line(kind, k) for kind in kinds])) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in template_tree.dedup_lines(docs).collect()}
    assert [got[k]["n_dropped"] for k in range(5)] == [0, *[len(kinds)] * 4]


def test_four_templates_of_four_documents(spark):
    """Templates of one leaf (token count and leading tokens), each with a variable field in the middle and one at the end."""
    line = lambda t, k: f"please read this {' '.join(f'{w}{t}' for w in ('note', 'about', 'our', 'terms', 'and', 'prices'))} {'pqrs'[k]}{t} before you go on {'uvwx'[k]}end"
    rows = [(10 * k + i, f"own{'abcd'[k]}{'efgh'[i]} text of this document\n{line('abcd'[i], k)}") for k in range(4) for i in range(4)]
    got = {r["doc_id"]: r["n_dropped"] for r in template_tree.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [sum(got[10 * k + i] for k in range(4)) for i in range(4)] == [3, 3, 3, 3] and all(got[i] == 0 for i in range(4))


def test_leaders_of_a_large_group_of_near_copies(spark):
    """Each class is compared with a few leaders, those met under most hashes, though its hashes have many."""
    r = random.Random(6)
    fronts = {cid: r.sample(range(40), 8) for cid in range(1, 400)}
    rows = spark.createDataFrame(list(fronts.items()), "cid long, front array<long>")
    got = {}
    for a, b in set_relation_join.nearest_leaders(rows).collect():
        got.setdefault(a, []).append(b)
    ends = {h: [f((c for c, x in fronts.items() if h in x), default=0) for f in (min, max)] for h in range(40)}
    for cid, front in fronts.items():
        times = Counter(c for h in front for c in ends[h] if c != cid)
        assert sorted(got[cid]) == sorted(sorted(times, key=lambda c: (-times[c], c))[:4])


def test_single_classes_that_nearly_link_are_settled_once(spark, monkeypatch):
    """Of candidate pairs that don't link, only those with a group are looked at again."""
    r, rows = random.Random(8), []
    base = [f"w{r.randint(0, 4000)}" for _ in range(150)]
    for k in range(40):
        words = list(base)
        for _ in range(3):
            words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
        rows.append((k, " ".join(words)))
    met, left, join = [], [], set_relation_join
    pairs_of, visit = join.candidate_pairs, join.visit

    def candidates(*args):
        out = pairs_of(*args)
        met.append(out.count())
        return out

    def visited(shelf, pairs, groups, *args):
        labels = {x["label"] for x in groups.collect()}
        left.append(sum(x["a"] not in labels and x["b"] not in labels for x in pairs.collect()))
        return visit(shelf, pairs, groups, *args)

    monkeypatch.setattr(join, "candidate_pairs", candidates)
    monkeypatch.setattr(join, "visit", visited)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in join.link_components(docs).collect()) == brute_components(docs.collect())
    assert met[0] > 100 and left == [0]


def test_near_copies_that_hardly_link_meet_in_rooms(spark, monkeypatch):
    """Rows grow with the documents, not with their pairs, and no link is lost where places are split."""
    r, rows, met, join = random.Random(5), [], [], set_relation_join
    base = [f"w{r.randint(0, 4000)}" for _ in range(150)]
    for k in range(400):
        words = list(base)
        for _ in range(r.randint(3, 4)):
            words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
        rows.append((k, " ".join(words)))
    pairs_of = join.candidate_pairs

    def candidates(*args):
        out = pairs_of(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(join, "candidate_pairs", candidates)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(docs.collect())
    for entries_of_a_place in (join.PLACE_ENTRIES, 512):
        monkeypatch.setattr(join, "PLACE_ENTRIES", entries_of_a_place)
        assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in join.link_components(docs).collect()) == want
    assert 1 < len({x[2] for x in want}) < 400 and max(met) < 20 * len(rows)


def test_sets_are_read_without_shuffling_texts(spark, monkeypatch):
    """However many classes need their sets, the texts stay where they are."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame([*((k, " ".join(f"w{k}-{i}" for i in range(12))) for k in range(300)), (None, "a text without an id")], "doc_id long, text string")
    ids = spark.createDataFrame([(k,) for k in range(0, 300, 3)], "doc_id long")
    sets = set_relation_join.whole_sets(docs, ids, 5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning(doc_id" not in sets._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    cids = {r["doc_id"]: r["cid"] for r in set_relation_join.survey(docs, 5).where("slot IS NULL").collect()}
    got = {r["cid"] for r in sets.collect()}
    assert {c for k, c in cids.items() if k is None or k % 3 == 0} <= got and len(got) < 150


def test_what_was_shuffled_for_a_table_goes(spark):
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    with common.Shelf(spark) as shelf:
        rows = shelf.put(spark.range(1000).repartition(4, "id"), spark.range(1000, 1500).repartition(4, "id"))
        assert rows.distinct().count() == rows.count() == 1500
        shuffled = spark.range(1000).repartition(4, "id")
        at = files()
        shelf.put(shuffled)
        for _ in range(50):
            if files() <= at:
                break
            time.sleep(0.1)
        assert files() <= at


def test_join_where_nothing_is_broadcast_and_sets_go_in_rounds(spark, monkeypatch):
    r, rows, parts, join = random.Random(11), [], [], set_relation_join
    for c in range(6):
        base = [f"w{c}-{r.randint(0, 4000)}" for _ in range(100)]
        for k in range(60):
            words = list(base)
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
            rows.append((None if k == 7 else 100 * c + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(join, "CARRY_AT_LEAST", 30000)
    monkeypatch.setattr(join, "CARRY", 0)
    monkeypatch.setattr(join, "PLACE_ENTRIES", 512)
    rounds = join.rounds
    monkeypatch.setattr(join, "rounds", lambda *args: parts.append(len(out := rounds(*args))) or out)
    got = Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in join.link_components(docs).collect())
    assert got == brute_components(docs.collect()) and max(parts) > 1
