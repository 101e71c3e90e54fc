"""Vector codes, filter audit and language identification against plain versions, and their defined cases."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import audit, language, vectors

VECTORS = "vec_id long, embedding array<float>, label int, id string, code int, v string"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows (id, vector, label) of finite vectors of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = [[math.floor(256 * float(x)) for x in r[1]] for r in rows]
    w = len(v[0]) // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    book = [[list(cut(x, p)) for x in v[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, p: min((far(cut(x, p), e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        got = defaultdict(list)
        for x in v:
            for p in range(parts):
                got[p, near(x, p)[1]].append(cut(x, p))
        for (p, e), xs in got.items():
            book[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[near(x, p) for p in range(parts)] for x in v]
    errors, by_label = [sum(d for d, _ in f) for f in found], Counter()
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    most = 2**63 - 1
    return sorted((str(r[0]), "".join(f"{k:02x}" for _, k in f), min(e, most), min(by_label[r[2]], most), sha) for r, f, e in zip(rows, found, errors, strict=True))


def codes(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def vector_rows(n, width=32, seed=0, scale=1.0):
    g = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in g.normal(0, scale, width)], [None, 1, 1, 2][i % 4]) for i in range(n)]


@pytest.mark.parametrize(("n", "scale"), [(150, 1.0), (20, 1.0), (90, 1e12), (80, 1e30)])
def test_codes_equal_plain(spark, n, scale):
    rows = vector_rows(n, scale=scale)
    rows += [rows[3], (None, rows[5][1], None), (7, rows[8][1], 2)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(3)
    assert codes(vectors.compress(df)) == plain_codes(rows)


def test_codes_drop_what_is_not_finite(spark):
    rows = vector_rows(70)
    bad = [(100, None, 1), (101, [None] + rows[0][1][1:], 1), (102, [float("nan")] + rows[0][1][1:], 1), (103, [float("-inf")] + rows[0][1][1:], 1)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows + bad], VECTORS)
    assert codes(vectors.compress(df)) == plain_codes(rows)
    assert vectors.compress(df.where("vec_id > 99")).count() == 0
    assert vectors.compress(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_of_short_vectors(spark):
    rows = vector_rows(70)
    df = spark.createDataFrame([(0, rows[0][1][:19], 1, "", 1, ""), *((*r, "", 1, "") for r in rows[1:])], VECTORS)
    assert codes(vectors.compress(df)) == plain_codes([(0, rows[0][1][:19] + [0.0] * 13, 1), *rows[1:]])
    empty = spark.createDataFrame([(1, [], 1, "", 1, "")], VECTORS)
    assert [(r.code, r.error) for r in vectors.compress(empty).collect()] == [("00" * 16, 0)]


def test_bounds_hold_and_filter():
    g = np.random.default_rng(1)
    entries, parts = g.integers(-90, 90, (64, 4)), g.integers(-99, 99, (500, 4))
    cells = vectors.Cells.of(entries)
    for j in range(4):
        at = cells.cell[j]
        assert (cells.low[j][at] <= entries[:, j]).all() and (entries[:, j] <= cells.high[j][at]).all()
    far = ((parts[:, None] - entries[None]) ** 2).sum(2)
    number, distance = cells.nearest(parts)
    assert (number == far.argmin(1)).all() and (distance == far.min(1)).all()


def test_walk_visits_every_order_by_swaps():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in audit.walk(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def plain_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = defaultdict(list)
    for i, text, _ in docs:
        if i is not None:
            least[text or ""].append(i)
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(least[t]) < i}
        fails.append((lang or "", {k for k in f if f[k]}, i in good, i in toxic))
    out = []
    for part in {p for p, *_ in fails}:
        mine, shapley, rows = [x[1:] for x in fails if x[0] == part], Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                rows.append((part, "".join(order), k + 1, len(left), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_audit_equals_plain(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "a b", long, long.upper(), long + " #", "x " * 400, long, "Ünï \x0b ç d | e", long + "\n" + long]
    docs = [(i % 37 if i % 11 else None, texts[i % len(texts)], ["en", None, "", "de"][i % 3 if i < 90 else 3]) for i in range(120)]
    labels = [(i, [None, 0, 1][i % 3], [1, 0, None][i % 3]) for i in range(30)] + [(3, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, lang string, mask int, part string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit.audit(df, lab).collect())
    assert got == plain_audit(docs, labels)
    assert audit.audit(df.limit(0), lab).count() == 0
    assert len(audit.audit(df, lab.limit(0)).collect()) == len(got)


def plain_languages(rows, order=4):
    """rows (id, text, lang, learn): predicted language and log scores."""
    counts, docs, model = defaultdict(Counter), Counter(), {}
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    for _, text, lang, learn in rows:
        if learn and lang is not None:
            docs[lang] += 1
            for w in words(text):
                counts[w][lang] += 1

    def evidence(table):
        of = Counter()
        for c in table.values():
            of.update(c)
        return {k: {g: math.log1p(n * sum(of.values()) / of[g]) for g, n in c.items()} for k, c in table.items()}

    gram = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    model = evidence(counts)
    spelt = {}
    for n in range(1, order + 1):
        table = defaultdict(Counter)
        for w, c in counts.items():
            for x in gram(w, n):
                for g in c:
                    table[x][g] += 1
        spelt[n] = evidence(table)

    def of(w):
        if w in model:
            return model[w]
        for n in range(order, 0, -1):
            known = [spelt[n][x] for x in gram(w, n) if x in spelt[n]]
            if known:
                return {g: sum(k.get(g, 0) for k in known) / len(known) for g in docs}
        return {}

    out = []
    for i, text, _, _ in rows:
        if not any(c.isalpha() for c in text or "") or not docs:
            out.append((i, "und", 0.0))
            continue
        s = {g: math.log(docs[g] / sum(docs.values())) + sum(of(w).get(g, 0) for w in words(text)) for g in sorted(docs)}
        best = max(sorted(s), key=s.get)
        out.append((i, best, 1 / sum(math.exp(x - s[best]) for x in s.values())))
    return sorted(out)


def identified(df, **more):
    return sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(df, F.col("learn"), **more).collect())


def test_languages_equal_plain(spark):
    g = np.random.default_rng(3)
    pools = {"aa": ["lano", "mireta", "so", "ka", "teron"], "bb": ["grumf", "stokt", "ka", "and", "wurz"], "cc": ["ñandú", "éso", "so"]}
    rows = []
    for i in range(160):
        lang = ["aa", "aa", "bb", "cc"][i % 4]
        text = " ".join(g.choice(pools[lang], int(g.integers(1, 9)))) + ("" if i % 5 else f" {g.choice(pools[lang])}{g.choice(list('xyz'))}ta")
        rows.append((i, text, None if i % 17 == 0 else lang, i % 4 != 2 or i % 3 == 0))
    odd = [None, "", "123 !!", "½ ²", "Ω", "qqqq", "LANO Mireta", "x", "grumf1stokt", "日本語", "é" * 3000, "a" * 50_000]
    rows += [(1000 + k, t, "aa", False) for k, t in enumerate(odd)] + [rows[4], rows[4]]
    df = spark.createDataFrame([(*r, 5, "z", 0.1) for r in rows], "doc_id long, text string, lang string, learn boolean, word int, lang_pred string, score double").repartition(5)
    want = plain_languages(rows)
    for chars in (1 << 24, 40):
        got = identified(df, block_chars=chars)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-6)
    kept = language.identify(df, F.col("learn"), keep=("doc_id", "word", "score", "lang_pred"))
    assert kept.columns == ["doc_id", "word", "lang_pred", "score"] and {r.word for r in kept.collect()} == {5}
    assert {x[1] for x in identified(df.withColumn("learn", F.lit(False)))} == {"und"}
    assert identified(df.limit(0)) == []


def test_bags_round_trip():
    for numbers in ({}, {0: 1}, {5: 2, 70_000: 300, 3: 1}):
        at, n = language.unpack(language.pack(numbers))
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == numbers
