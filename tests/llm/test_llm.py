"""The training-data operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathom.llm import chat, common, decontaminate, graph, licenses, linededup, packing, quality, sharding, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "the of in an er on re st ou nd".split() for b in "ing tion ly ed es at ha".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, "\n".join(prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 6))), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), 5) for i in range(n)]
    rows += [(n, None, "en", "a", None), (n + 1, "", "en", "a", 0), (n + 2, " \t\n", None, None, 3), (n + 3, rows[0][1], "en", "a", 1), (n + 4, rows[0][1], "en", "b", 1), (n + 5, "Éa b c\x00d", "en", "a", 1), (n + 6, prose(rng, 9000), "en", "a", 1)]
    return [*rows, rows[5]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    df = spark.createDataFrame(corpus(), DOCS)
    for c in ("n_words", "slot", "hash", "__row", "node", "kept", "y", "length"):  # names that the operators use inside
        df = df.withColumn(c, F.lit("clash"))
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.doc_id].append(r)
    return out


# 1


def test_licenses(spark, docs, empty):
    texts = ["MIT License", "mit-LICENSE of the mit license! Mit\nlicense", "The Apache   License, Version 2.0", "GNU General Public License and General Public", "license mit", "", None, "general general public license public license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "x mitlicense éMIT license", "apache2 license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_scan(df).collect())
    want = collections.Counter()
    for r in df.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(r.text))
        at = [(i, lab) for p, lab in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want[r.doc_id, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert got == want
    full = licenses.license_scan(df.where("text like 'Permission is%'")).first()
    assert full.labels == "mit" and full.base_labels == "" and full.score == 1.0
    assert all(0 <= r.score <= 1 for r in licenses.license_scan(df).collect())
    assert licenses.license_scan(empty).count() == 0


# 2


def toxic_corpus(n=900):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        words = prose(rng, rng.randint(20, 120)).split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), "grumblo" + rng.choice(WORDS))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    extra = [(10_000, None), (10_001, ""), (10_001, ""), (None, "the of")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string").withColumn("toxic", F.lit("clash")).withColumn("score", F.lit(3))
    lab = spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(df, lab).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in labels)
    truth = {i: t for i, _, t in labels}
    hits = sum(got[i].predicted for i in held if truth[i])
    wrong = sum(got[i].predicted for i in held if not truth[i])
    assert hits >= 0.9 * sum(truth[i] for i in held) and wrong <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[10_000].score == got[10_001].score < 0.5
    kept = toxicity.drop_toxic(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_labels(spark, empty):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert all(r.score < 0.01 and r.predicted == 0 for r in toxicity.toxicity_scores(df, lab).collect())
    assert toxicity.toxicity_scores(empty, lab).count() == 0


def test_toxicity_in_parts_is_the_same(spark):
    rows, labels = toxic_corpus(300)
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, many = ({r.doc_id: r.score for r in toxicity.toxicity_scores(df, lab, part_nodes=n).collect()} for n in (1 << 20, 100))
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-9 for i in one)


def plain_kneser_ney(texts, words):
    """Differences of log-likelihood of words, by counting as the definitions say."""
    off = lambda c: min(c, 1.0 if c <= 1 else 1.3 if c == 2 else 1.6)
    vocabulary = collections.defaultdict(lambda: [0, 0])
    for text, toxic in texts:
        for w in set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))):
            vocabulary[w][toxic] += 1

    def steps(w):
        yield from ((w[: n - 1], w[n - 1]) for n in range(1, min(10, len(w)) + 1))
        yield w[:10], w[10:] + "\n"

    count, types = collections.defaultdict(lambda: [0, 0]), collections.Counter()
    for w, c in vocabulary.items():
        for s in steps(w):
            types[s] += 1
            for k in (0, 1):
                count[s][k] += c[k]

    def p(k, h, x):
        after = [s for s in types if s[0] == h]
        total = sum(count[s][k] for s in after)
        same = [s for s in types if s[0][-3:] == h[-3:]]
        lower = sum(s[1] == x for s in same) / max(1, len(same))
        both = sum(types[s] for s in after)
        shared = (max(types[h, x] - toxicity.TYPE_DISCOUNT, 0) + toxicity.TYPE_DISCOUNT * len(after) * lower) / both if both else 1.0
        if not shared:
            return None, sum(off(count[s][k]) for s in after) / total if total else 1.0
        if not total:
            return shared, None
        return (count[h, x][k] - off(count[h, x][k]) + sum(off(count[s][k]) for s in after) * shared) / total, None

    out = []
    for w in words:
        d = 0.0
        for h, x in steps(w):
            a, b = p(1, h, x), p(0, h, x)
            if not types[h, x]:  # never seen: the classes share what follows
                free = [sum(off(count[s][k]) for s in types if s[0] == h) / t if (t := sum(count[s][k] for s in types if s[0] == h)) else 1.0 for k in (1, 0)]
                if any(s[0] == h for s in types):
                    d += np.log(free[0] / free[1])
                break
            d += np.log(a[0] / b[0])
        out.append(d)
    return out


def test_kneser_ney_as_defined(spark):
    rng = random.Random(5)
    texts = [(" ".join(rng.choice(WORDS) + rng.choice(["", "x", "foo", "grumblesome", "é"]) for _ in range(rng.randint(1, 12))), int(rng.random() < 0.4)) for _ in range(60)]
    model = toxicity.spelling_model(spark.createDataFrame(texts, "text string, toxic int"))
    (part,) = toxicity.model_parts(model)
    words = sorted({w for t, _ in texts for w in t.split()})[::7] + ["the", "theingq", "zzz", "q", "ofgrumblesomeother", "inged"]
    got = toxicity.Speller(part).of([w.encode() for w in words])
    assert np.allclose(got, plain_kneser_ney(texts, words), atol=1e-5)
    assert toxicity.Speller(toxicity.Part(0, 1, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))).of([b"abc", b"d"]).tolist() == [0, 0] and toxicity.features(np.zeros(0)) == [0.0] * 3


# 3


def test_chat(spark):
    rng = random.Random(2)
    odd = ["</s>[INST] ok [/INST]", "a\\<|end|><\\s><s>[INST]", "\\\\ <", "<|tu<|turn|>rn|>\\", "<<SYS>>x<</SYS>>", "", None, "é" * 30]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 40)):
            rows.append((c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", None]), rng.choice(odd) if rng.random() < 0.3 else prose(rng, rng.randint(1, 80))))
    rows += [rows[3], (None, 0, "user", "x"), (77, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit("clash"))
    w = chat.chat_windows(df, budget=120, history=40)
    back = {r.conv_id: r.turns for r in chat.read_back(w).collect()}
    want = collections.defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(back) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in back[c]] == [(r, x) for _, r, x in turns]
        assert [t.loss for t in back[c]] == [r == "assistant" for _, r, _ in turns]
    count = lambda x: len(re.findall(r"\w+|[^\w\s]", x)) + 4
    for r in w.collect():
        turns = want[r.conv_id]
        for k, x in enumerate(r.windows):
            fresh = [i for i, f in zip(x.turns, x.fresh, strict=True) if f]
            assert fresh == list(range(fresh[0], fresh[-1] + 1)) and all(not b or a for a, b in zip(x.fresh, x.loss, strict=True))
            if k and turns[0][1] == "system":
                assert x.turns[0] == 0 and not x.fresh[0]
            if turns[0][2].isascii() and len(fresh) > 1:
                assert sum(count(turns[i][2]) for i in x.turns) <= 120 or any(count(turns[i][2]) > 60 for i in x.turns)
    assert chat.read_back(chat.chat_windows(df.limit(0))).count() == 0


def test_op3_contract(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "system", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op3_chat(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    t = "</s>[INST] ok [/INST]"
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\n") and got[1].loss_sha256 == sha("b") and got[1].loss_chars == 1
    assert got[-7].turns_sha256 == sha(f"user\n{t}\nassistant\n{t}\n") and got[-7].loss_sha256 == sha(t) and got[-7].n_turns == 2
    assert got[2].loss_sha256 == sha("") and got[2].turns_sha256 == sha("system\n\n")


# 4


def plain_tiles(a, b, least):
    """Greedy string tiling by looking at all pairs of places."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        out.append(best)


@pytest.mark.parametrize("seed", range(25))
def test_tiles(seed):
    rng = random.Random(seed)
    a, b = ([rng.randint(0, 2 + seed % 4) for _ in range(rng.randint(3, 30))] for _ in range(2))
    A, B = np.array(a, np.uint64), np.array(b, np.uint64)
    assert decontaminate.tiles(A, B, 3) == plain_tiles(a, b, 3)


def test_tiles_of_one_word_again_and_again():
    a, b = np.ones(100_000, np.uint64), np.ones(400, np.uint64)
    begin = time.time()
    assert decontaminate.tiles(a, b, 5) == [(0, 0, 400)]
    a[::300] = 2  # runs of 299
    got = decontaminate.tiles(a, b, 5)
    assert got == [(1, 0, 299), (301, 299, 101)] and time.time() - begin < 5
    seeds = decontaminate.Seeds([(None, [b"x"] * 200), (3, [b"x"] * 20)], 5)
    assert [(k, round(s, 3)) for k, s, _ in seeds.match([b"x"] * 20_000, 0.5)] == [(None, 1.0), (3, 1.0)] and time.time() - begin < 10


def test_leaks(spark, docs, empty):
    rng = random.Random(9)
    items = [prose(rng, 20) + f" item{k} end{k}" for k in range(6)] + ["too short", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    w = items[1].split()
    moved = " ".join(w[11:] + ["between"] + w[:11])
    more = [(500, "x " + items[0].upper() + " y"), (501, moved), (502, " ".join(items[2].split()[:6])), (503, items[3] + " " + items[4]), (503, items[3] + " " + items[4])]
    df = spark.createDataFrame(more, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect())
    assert got == [(500, 0), (501, 1), (503, 3), (503, 3), (503, 4), (503, 4)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench, block_bytes=300).collect()) == got
    clean = decontaminate.clean(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(999).cast("long")).withColumn("text", F.lit(moved))), bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


# 5


def test_warc(spark, tmp_path):
    big, other = "b\r\n\r\nWARC/1.1\r\n" * 90, "é" * 600
    rows = [(1, "http://a/", big), (2, None, big), (3, "u\r\nX: y", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", other), (10, "u", "z" * 999), (11, "u", "z" * 999), (12, "u", "q\x00\n")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in warc.op5_warc(spark, str(tmp_path)).collect()}
    last = {}
    for i, _, h in rows:
        last[h or ""] = i
    for i, _, h in rows:
        raw = (h or "").encode()
        old = len(raw) >= 1000 and last[h] != i
        assert tuple(got[i])[1:] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if old else "response", last[h] if old else None)
    again = spark.createDataFrame([(5, "u", big), (5, "u", big), (5, "u", other), (9, "u", big), (9, "u", big), (None, "u", big)], "page_id long, url string, html string")
    path = common.fresh_path(spark, "warc")
    warc.deduplicate(warc.records(again, "page_id", "url", "html"), path)
    kinds = collections.Counter((r.record_key, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect())
    assert kinds == {(5, len(big), "revisit", 9): 2, (5, 1200, "response", None): 1, (9, len(big), "response", None): 2, (None, len(big), "response", None): 1}
    path = common.fresh_path(spark, "warc")
    warc.deduplicate(warc.records(spark.read.parquet(str(tmp_path / "pages.parquet")), "page_id", "url", "html"), path)
    full = {r.record_key: r.payload for r in warc.read_warc(spark, path, with_payload=True).collect()}
    assert full[3] == big and full[1] is None and full[12] == "q\x00\n"
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert warc.op5_warc(spark, str(tmp_path / "none")).count() == 0


# 6


@pytest.mark.parametrize(("shards", "cells"), [(24, 16), (3, 16), (7, 4096)])
def test_minimax(spark, shards, cells):
    rng = random.Random(shards)
    sizes = [rng.choice([1, 2, 5, rng.randint(1, 400)]) for _ in range(400)]
    upto = np.cumsum(sizes).tolist()
    groups = spark.createDataFrame(list(zip(sizes, upto, strict=True)), "size long, upto long")
    capacity, cuts = sharding.minimax_cuts(groups, shards, cells)

    def fits(c):
        n, now = 1, 0
        for s in sizes:
            if s > c:
                return False
            if now + s > c:
                n, now = n + 1, 0
            now += s
        return n <= shards

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) == best == capacity and cuts[-1] == sum(sizes) and set(cuts) <= {0, *upto}
    even = sharding.even_cuts(groups, shards, cells)
    own, greedy = (np.diff([0, *c]) for c in (even, cuts))
    assert max(own) <= best and even[-1] == sum(sizes) and set(even) <= {0, *upto} and min(own) >= min(greedy)


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, 5).collect()
    assert len(got) == docs.count()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    shard_of = collections.defaultdict(set)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        shard_of[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    assert sharding.shard_documents(empty, 5).count() == 0


# 7


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def test_encoder(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    texts = ["a\x1cb \x1d\x1e c\x1f", "x <|endoftext|> y<|startoftext|>z <|END|> <| x", "<|endoftext|>", "a\x85b\u00a0c\u2028d\u3000e\u200bf", "", "  ", "a\x01b c", "ΑΣ ΣΑΣ. İstanbul ǰ J̌ é ́x a b don't it's DON'T <|endoftext|> </w> 12,3 ÀÉ× ß. ẞ K ŉ,. a.,", "\x01", "x \x01 y", "ª º µ ,. . ,", *(r[1] or "" for r in corpus())]
    for size in (300_000, 5):
        e = packing.WordBpe(tokenizer, size)
        for part in (texts, texts[:3], texts[3:]):
            assert [x.tolist() for x in e.encode(part)] == [t.encode(x, add_special_tokens=False).ids for x in part]


def test_packing(docs, empty, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    one = docs.dropDuplicates(["doc_id"])
    pieces = packing.pack_texts(one, tokenizer, max_tokens=256, max_segments=9).collect()
    of, seqs = by_id(pieces), collections.defaultdict(list)
    for r in one.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(of[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and np.frombuffer(p.ids, "<u4").tolist() == ids[at : at + p.length]
            at += p.length
        assert at == len(ids)
    for p in pieces:
        seqs[p.sequence_id].append(p)
    for s in seqs.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [0, *np.cumsum([p.length for p in s])[:-1]] and sum(p.length for p in s) <= 256 and len(s) <= 9
    assert packing.pack_texts(empty, tokenizer).count() == 0
    assert packing.pack_texts(docs, tokenizer).groupBy("doc_id").count().count() == one.count()


@pytest.mark.parametrize("cut", [True, False])
def test_packer_limits(cut):
    rng = np.random.default_rng(3)
    p, out, items = packing.Packer(0, 64, 5, 40, cut, 4), [], []
    for k in range(200):
        n = int(rng.integers(1, 200 if cut else 60))
        ids, loss = rng.integers(0, 9, n).astype(np.uint32), rng.random(n) < (0.5 if cut else 0.3)
        items.append((ids, loss))
        out += p.add(k, ids, loss)
    out += p.end()
    seqs, of = collections.defaultdict(list), collections.defaultdict(list)
    for key, start, ids, _total, m, s, offset in out:
        seqs[s].append((offset, len(ids), m))
        of[key].append((start, ids, m))
    for s in seqs.values():
        assert sum(n for _, n, _ in s) <= 64 and len(s) <= 5 and sum(m for _, _, m in s) <= 40
    for k, (ids, loss) in enumerate(items):
        got = sorted(of[k], key=lambda x: x[0])
        assert np.concatenate([g[1] for g in got]).tolist() == ids.tolist() and sum(g[2] for g in got) == loss.sum() and (cut or len(got) == 1)


def plain_packing(items, limits, most_open):
    """The dot-product heuristic without cutting, a loop for every sum."""
    bins, out, n = [], [], 0

    def close(k):
        nonlocal n
        out.extend((key, n) for key in bins.pop(k)[1])
        n += 1

    for key, need in items:
        while True:
            fits = [(k, left) for k, (left, _) in enumerate(bins) if all(x >= y for x, y in zip(left, need, strict=True))]
            if fits:
                exact = [k for k, left in fits if left[0] == need[0]]
                dot = lambda left: round(sum(x * y / m / m for x, y, m in zip(left, need, limits, strict=True)), 12)
                k = exact[0] if exact else max(fits, key=lambda f: (dot(f[1]), -f[0]))[0]
            elif len(bins) < most_open:
                bins.append((list(limits), []))
                k = len(bins) - 1
            else:
                close(min(range(len(bins)), key=lambda k: (bins[k][0][0], k)))
                continue
            left, keys = bins[k]
            keys.append(key)
            for d, y in enumerate(need):
                left[d] -= y
            if min(left) <= 0:
                close(k)
            break
    while bins:
        close(0)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packer_takes_the_largest_dot_product(seed):
    rng = np.random.default_rng(seed)
    p, out, items = packing.Packer(0, 64, 5, 32, False, 6), [], []
    for k in range(300):
        n = int(rng.integers(1, 40))
        loss = rng.random(n) < 0.5
        items.append((k, (n, 1, int(loss.sum()))))
        out += p.add(k, np.zeros(n, np.uint32), loss)
    out += p.end()
    assert [(x[0], x[5]) for x in out] == plain_packing(items, (64, 5, 32), 6)


# 8


def plain_dedup(rows, least=50):
    """Texts in order without the lines of runs of least words that were there before; (rows of (key, text))."""
    word, docs, first, out = re.compile(r"[^\x20\x09-\x0D]+"), [], {}, []
    for key, text in rows:
        lines = [] if text is None else text.split("\n")
        at = [(i, len(word.findall(x))) for i, x in enumerate(lines) if word.search(x)]
        runs = set()
        for k in range(len(at)):
            for step in (1, -1):
                e, n = k, at[k][1]
                while n < least and 0 <= e + step < len(at):
                    e += step
                    n += at[e][1]
                if n >= least:
                    runs.add((min(k, e), max(k, e)))
        docs.append((key, text, lines, at, sorted(runs)))
    content = lambda lines, at, a, e: tuple(lines[i] for i, _ in at[a : e + 1])
    for n, (_, _, lines, at, runs) in enumerate(docs):
        for a, e in runs:
            first.setdefault(content(lines, at, a, e), (n, a))
    for n, (key, text, lines, at, runs) in enumerate(docs):
        gone = set()
        for a, e in runs:
            if first[content(lines, at, a, e)] != (n, a):
                gone |= set(range(at[a][0], at[e + 1][0] if e + 1 < len(at) else len(lines)))
        out.append((key, None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def passages(seed=7, n=60):
    """Texts of lines of all lengths, with passages of 1 to 9 lines between lines of their own."""
    rng = random.Random(seed)
    shared = [[prose(rng, -(-60 // k)) for _ in range(k)] for k in (1, 1, 2, 3, 4, 6, 9)]
    rows = []
    for i in range(n):
        parts = [[prose(rng, rng.choice([1, 3, 12, 40, 70]))] for _ in range(rng.randint(0, 9))] + rng.sample(shared, rng.randint(0, 2))
        if rng.random() < 0.3:
            parts.append(rng.choice([["", " \t"], ["short line"], ["a  b\tc " + prose(rng, 60)]]))
        rng.shuffle(parts)
        rows.append((i, "\n".join(x for p in parts for x in p), "en", "a", 9))
    rows += [(90, None, None, None, None), (91, "", "en", "a", 0), (92, rows[1][1], "en", "a", 0), (93, "\n".join(shared[0] * 3), "en", "a", 0), (94, "\n".join(["ten words of text that repeat again and again here"] * 20), "en", "a", 0), rows[2], rows[2]]
    return rows, shared


def test_line_dedup(spark, tmp_path):
    rows, shared = passages()
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, DOCS).withColumn("hash", F.lit("clash")).withColumn("__row", F.lit("clash")).withColumn("first", F.lit("clash")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    got = linededup.dedup_lines(df).collect()
    assert set(df.columns) < set(got[0].asDict()) and {r["__row"] for r in got} == {"clash"}
    want = plain_dedup([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in got)
    before, after = ("\n\n".join(r.text or "" for r in x) for x in (df.collect(), got))
    for p in shared:  # of each passage one copy stays, and no line is lost
        assert before.count("\n".join(p)) > 1 and all(after.count(x) == 1 for x in p)
    sizes = {r.doc_id: len((r.text or "").encode()) for r in df.collect()}
    assert all(r["__removed_bytes"] == sizes[r.doc_id] - len((r.text or "").encode()) for r in got)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize(("before", "after"), [(1, 12), (4, 3), (6, 4), (3, 2)])
def test_line_dedup_does_not_depend_on_splits(spark, tmp_path, before, after):
    rows, _ = passages(8, 120)
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, DOCS).repartition(12, "doc_id").write.parquet(path)
    df = spark.read.parquet(path)
    setting = "spark.sql.leafNodeDefaultParallelism"
    try:
        spark.conf.set(setting, before)
        result = linededup.dedup_lines(df)
        spark.conf.set(setting, after)
        got = result.collect()
    finally:
        spark.conf.unset(setting)
    lines = lambda x: {y for r in x for y in (r.text or "").split("\n")}
    assert lines(got) - {""} == lines(df.collect()) - {""} and len(got) == len(rows)
    kept = [x for r in got for x in (r.text or "").split("\n") if len(x.split()) >= 50]
    assert len(kept) == len(set(kept))


# 9


def plain_print(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash(spark, docs, tmp_path, empty):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = simhash.op9_simhash(spark, str(tmp_path)).collect()
    rows = docs.collect()
    prints = [(r.doc_id, plain_print(r.text)) for r in rows]
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == collections.Counter((i, f"{f:016x}") for i, f in prints)
    root = union({f for _, f in prints}, [(a, b) for _, a in prints for _, b in prints if (a ^ b).bit_count() <= 2])
    least = collections.defaultdict(lambda: 10**9)
    for i, f in prints:
        least[root[f]] = min(least[root[f]], i)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, least[root[f]]) for i, f in prints}
    assert simhash.fingerprint_components(simhash.fingerprints(empty)).count() == 0


def test_links_of_near_fingerprints(spark):
    rng = random.Random(1)
    fs = [rng.getrandbits(64) for _ in range(5)]
    for f in fs[:]:
        for _ in range(20):
            f ^= (1 << rng.randrange(64)) ^ (rng.random() < 0.5) * (1 << rng.randrange(64))
            fs.append(f)
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fs)], "doc_id long, f0 long")
    got = {r.doc_id: r.component_id for r in simhash.fingerprint_components(df).collect()}
    near = [(i, j) for i in range(len(fs)) for j in range(i) if (fs[i] ^ fs[j]).bit_count() <= 2]
    assert got == union(range(len(fs)), near)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    path = [(i, i + 1) for i in range(60)]
    edges = [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(110)] + path + [(7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == union(nodes, [e for e in edges if e[0] != e[1]])


def test_near_duplicates(spark, tmp_path):
    rng = random.Random(3)
    base = [prose(rng, 300).split() for _ in range(12)]
    rows = []
    for k, w in enumerate(base):
        rows.append((k, " ".join(w)))
        for j in range(3):
            v = w[:]
            v[rng.randrange(300)] = "other"
            rows.append((100 + 10 * k + j, " ".join(v)))
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, ""), (501, None), (502, "alone here"), (503, "quite other words"), (502, "one id with two texts")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    kept = simhash.near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert got == sorted([*((str(k), " ".join(w)) for k, w in enumerate(base)), ("None", ""), ("502", "alone here"), ("502", "one id with two texts"), ("503", "quite other words")])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def jaccard(a, b, size=5):
    a, b = ({*zip(*(t.split()[i:] for i in range(size)), strict=False)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_duplicates_keep_a_family(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "%x" % rng.getrandbits(40)
    shared = [word() for _ in range(330)]
    texts = [" ".join(shared + [word() for _ in range(70)]) for _ in range(60)]
    assert all(0.68 < jaccard(a, b) < 0.72 for a in texts[:8] for b in texts[:8] if a != b)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert simhash.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).count() == 60


@pytest.mark.parametrize("block", [8, 512])
def test_near_duplicates_compare_whole_crowds(spark, tmp_path, block):
    rng = random.Random(6)
    word = lambda: "%x" % rng.getrandbits(40)
    shared, texts = [word() for _ in range(345)], []
    for _ in range(60):  # pairs of near copies in a family that is none
        own = [word() for _ in range(55)]
        texts += [" ".join(shared + own), " ".join(shared + own[:20] + [word() for _ in range(35)])]
    linked = [(i, j) for i in range(120) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert len(linked) == 60
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = simhash.near_duplicates(spark.read.parquet(str(tmp_path / "d")), block=block)
    root = union(range(120), linked)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_near_duplicates_recall(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "%x" % rng.getrandbits(40)
    texts = []
    while len(texts) < 400:
        own = [word() for _ in range(rng.randint(60, 500))]
        other = own[:]
        for _ in range(max(1, int(len(own) * rng.uniform(0.015, 0.03)))):
            other[rng.randrange(len(own))] = word()
        pair = [" ".join(own), " ".join(other)]
        if 0.8 <= jaccard(*pair) < 0.85:
            texts += pair
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = {r.doc_id for r in simhash.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert set(range(0, 400, 2)) <= kept and len(kept) - 200 <= 0.1 * 200


def test_jaccard_of_blocks():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 60))) for _ in range(40)] + [np.arange(100_000), np.arange(3, 100_000)]
    shared = simhash.shared_counts(sets[:20], sets)
    assert shared.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:20]]
    left = np.array([True] * 20 + [False] * 22)
    u, v = simhash.verified(np.arange(42), sets, left, 0.5)
    js = lambda a, b: len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b))
    want = union(range(42), [(i, j) for i in range(42) for j in range(i) if left[j] and js(sets[i], sets[j])])
    assert {int(a): int(b) for a, b in zip(u, v, strict=True)} == {n: r for n, r in want.items() if n != r}


def test_near_duplicates_by_any_band(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "%x" % rng.getrandbits(40)
    texts = []
    while len(texts) < 20:
        own = [word() for _ in range(200)]
        pair = [" ".join(own), " ".join(own[:180] + [word() for _ in range(20)])]
        a, b = (simhash.fingerprint(np.unique(simhash.shingle_hashes(t, 5)), 8) for t in pair)
        near = [(int.from_bytes(a[k : k + 4]) ^ int.from_bytes(b[k : k + 4])).bit_count() <= 2 for k in range(0, 64, 4)]
        if any(near[12:]) and not any(near[:12]):
            texts += pair
    assert all(jaccard(a, b) > 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = simhash.near_duplicates(spark.read.parquet(str(tmp_path / "d")))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 20, 2))


# 10


def plain_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    inside = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality(spark, docs, empty, tmp_path):
    rng = random.Random(5)
    more = [(900, "a b c d e f a b c d e", "en", "a", 1), (901, "same\nsame\n \nsame\n", None, "a", 1), (902, "x " * 50, "en", None, 1), (903, "# $ " + prose(rng, 40), "en", "a", 1)]
    df = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, DOCS).drop("n_chars"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = quality.op10_quality(spark, str(tmp_path)).collect()
    assert len(got) == df.count()
    want = collections.Counter()
    for r in df.collect():
        s = plain_stats(r.text)
        want[(r.doc_id, *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.quality_rules(empty).count() == 0


def plain_mcd(x, h=0.75, most_steps=12, settled=1e-3):
    """The estimates of all starts, by loops over rows; the one of smallest determinant."""
    n, p, floors = len(x), quality.P, np.square(quality.FLOORS)
    at = lambda q: np.sort(x, 0)[max(0, int(np.ceil(q * n)) - 1)]
    mu = at(0.5)
    var = ((at(0.75) - at(0.25)) / 1.349) ** 2 + floors
    u = (x - mu) / np.sqrt(var)
    back = mu + u / np.sqrt((u**2).sum(1, keepdims=True) / p + 1e-300) * np.sqrt(var)
    scatter = lambda y, c: np.cov(y.T, bias=True) * c + np.diag(floors)
    starts = [(mu, np.diag(var)), (x.mean(0), scatter(x, 1.0)), (back.mean(0), scatter(back, 1.0))]
    logs = []
    for step in range(most_steps):
        new = []
        for m, s in starts:
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            size = int(np.ceil(n * (0.5 if step == 0 else h)))
            fine = np.floor(np.log2(d2 + 1e-9) * quality.FINE)
            kept = x[fine <= np.sort(fine)[size - 1]]
            new.append((kept.mean(0), scatter(kept, quality._consistency(h))))
        starts, before, logs = new, logs, [np.linalg.slogdet(s)[1] for _, s in new]
        if step == 2:
            best = int(np.argmin(logs))
            starts, logs = [starts[best]], [logs[best]]
        if step > 2 and max(abs(a - b) for a, b in zip(logs, before, strict=True)) <= settled:
            break
    return starts[int(np.argmin(logs))]


def test_mcd(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(0, 1, (300, 6)) @ rng.normal(0, 1, (6, 6)), "b": rng.normal(2, 0.5, (40, 6)), "c": rng.normal(0, 1, (3, 6))}
    data["a"][:50] += 20
    rows = [(g, k, [float(v) for v in r]) for g, x in data.items() for k, r in enumerate(x)]
    got = {r.g: r for r in quality.mcd(spark.createDataFrame(rows, "g string, tie long, x array<double>")).collect()}
    data[""] = np.concatenate(list(data.values()))
    assert set(got) == set(data) and all(got[g].size == len(x) for g, x in data.items())
    for g, x in data.items():
        mu, cov = plain_mcd(x)
        assert np.allclose(got[g].mu, mu, atol=1e-3) and np.allclose(got[g]["cov"], cov[np.triu_indices(6)], atol=1e-2, rtol=1e-2), g
    assert abs(np.array(got["a"].mu)).max() < 2  # a sixth of the rows far away move nothing


def test_a_group_is_judged_alike_before_and_after_it_grows():
    own, pooled = (np.zeros(6), np.eye(6)), (np.full(6, 0.5), 4 * np.eye(6))
    last = None
    for n in range(1, 400):
        mu, cov = quality.shrink(n, *own, *pooled, 60.0)
        now = np.concatenate([mu, cov.ravel()])
        assert last is None or np.abs(now - last).max() < 0.1
        last = now
    assert np.abs(last[:6]).max() < 0.1


def test_outliers(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(60, 200)), "en", f"s{i % 2}") for i in range(600)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(rng, 100).split()), "en", "s0") for i in range(30)] + [(2000 + i, prose(rng, 100).upper(), "en", "s1") for i in range(30)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i] for i, *_ in junk) == 0 and sum(got[i] for i, *_ in rows) >= 0.99 * len(rows)
