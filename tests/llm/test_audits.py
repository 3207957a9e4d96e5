"""Top-k search, source divergence and spelling groups: awkward rows, against brute force."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lanwatch.llm import divergence, spelling, topk
from lanwatch.llm.queries import ENTRIES

RNG = random.Random(11)
INF, NAN = float("inf"), float("nan")


# -- exact top-k ---------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, copies string, side int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 5, "v", "c", 1) for i, v in rows], VECTORS)


def brute_top(rows, k):
    whole = [(n, i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for n, (i, v) in enumerate(rows)
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in whole:
        if i is None or i % 100:
            continue
        found = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for m, j, w in whole if m != n and len(w) == len(v)]
        out += [(i, r, None if void else j, -s) for r, (s, void, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def awkward_vectors():
    rows = [(i, [RNG.choice([-1.5, -0.25, 0.0, 0.001, 0.3, 1.0]) for _ in range(3)]) for i in range(420)]
    rows += [rows[100]] * 5 + [rows[7]] * 4  # repeated rows, queries among them
    rows += [(200, [9.0, 9.0, 9.0]), (200, [9.0, 9.0, 9.0]), (None, [9.0, 9.0, 9.0]), (None, [9.0, 9.0, 9.0])]
    rows += [(500, None), (600, []), (601, []), (700, [1.0, None, 2.0]), (800, [1.0, NAN, 0.0]), (900, [INF, 0.0, 0.0]), (1000, [1.0, 2.0]), (1100, [3.0])]
    return rows


@pytest.mark.parametrize("shard,block,fan", [(topk.SHARD_CELLS, topk.BLOCK_CELLS, topk.FAN), (60, 9, 2)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, block, fan):
    monkeypatch.setattr(topk, "SHARD_CELLS", shard)
    monkeypatch.setattr(topk, "BLOCK_CELLS", block)
    monkeypatch.setattr(topk, "FAN", fan)
    rows = awkward_vectors()
    got = topk.top_k(topk.integers(vectors(spark, rows)), F.col("id") % 100 == 0, 10)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_top(rows, 10)


def test_top_k_of_nothing_and_of_large_components(spark):
    assert topk.top_k(topk.integers(vectors(spark, [])), F.col("id") % 100 == 0, 10).count() == 0
    big = [(0, [1.5e6, 1.0]), (1, [1.5e6, -1.0]), (2, [-1.5e6, 0.5])]
    got = topk.top_k(topk.integers(vectors(spark, big)), F.col("id") % 100 == 0, 10).collect()
    assert [tuple(r) for r in sorted(got)] == brute_top(big, 10)
    far = [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0])]
    assert [r["vec_id"] for r in sorted(topk.top_k(topk.integers(vectors(spark, far)), F.col("id") % 100 == 0, 10).collect())] == [1, 2]


def test_scores_are_exact_at_every_magnitude():
    rng = np.random.default_rng(1)
    for top in (10, 2 ** 22, 2 ** 27, 2 ** 30):
        a, b = rng.integers(-top, top, (5, 9)), rng.integers(-top, top, (7, 9))
        assert topk._scores(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


# -- source divergence ---------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, term string, n long, value long, rank int, total long, block long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3, 4, 5) for r in rows], DOCS)


def audit_rows():
    words = ["alpha", "Beta", "GAMMA", "delta", "été", "Über", "straße", "日本", "x", "mu"]
    rows = []
    for i in range(90):
        lang = RNG.choice(["en", "en", "fr", None])
        weights = [1 / (j + 1 + (i % 3)) for j in range(len(words))]
        rows.append((i, " ".join(RNG.choices(words, weights, k=RNG.choice([1, 5, 60]))) + ", 12-" + RNG.choice(words), lang, f"s{i % 4}" if i % 7 else None))
    rows += [(1000, None, "xx", "a"), (1001, "rare words only", "xx", "b"), (1002, "", "xx", None), (1003, "one source", "yy", "a")]
    rows += [(None, "alpha alpha", "en", "only"), rows[3], rows[3], rows[3], (1004, "same same " * 5000 + "very long", "en", "s1"), (None, None, None, None)]
    return rows


def brute_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
            for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        groups = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if seen[t] >= least) for s in {d[1] for d in own}}
        everyone = sum(groups.values(), collections.Counter())

        def p(c, t):
            return 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in groups.items():
            pairs = {o: sum((p(c, t) - p(d, t)) ** 2 // p(d, t) for t in kept) for o, d in groups.items() if o != s}
            terms = {t: (p(c, t) - p(everyone, t)) ** 2 // p(everyone, t) for t in kept if c[t] and p(c, t) > p(everyone, t)}
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, r) for r, (item, v) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [divergence.CELLS, 7])
def test_audit_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = audit_rows()
    got = divergence.audit(documents(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_audit(rows)


def test_audit_cuts_terms_and_passes_on_full_tallies(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    rows = audit_rows()
    assert sorted(map(tuple, divergence.audit(documents(spark, rows), 2, 3).collect())) == brute_audit(rows, 2, 3)


def test_audit_of_nothing(spark):
    assert divergence.audit(documents(spark, [])).count() == 0


def test_share_is_exact_for_large_counts(spark):
    n, total, terms = 10 ** 15 + 7, 3 * 10 ** 15 + 1, 12_345
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()
    assert row["p"] == 1 + 10 ** 9 * (n + 1) // (total + terms)


# -- spelling ------------------------------------------------------------------------------------

SPELLED = "doc_id long, text string, word string, n long, bucket int, part int, form string"


def spelled(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, 2, 3, "f") for r in rows], SPELLED)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, out = {}, []
    for w, n in words.items():
        others = sorted((-words[v], v) for v in words if near(w, v))
        forms[w] = (others[0][1] if others and -others[0][0] >= 5 * n else None, len(others))
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, forms[w][0], root, n, forms[w][1], words[forms[w][0]] if forms[w][0] else None))
    return sorted(out)


def spelled_rows():
    base = ["".join(RNG.choices("abcdeé", k=RNG.randint(5, 9))) for _ in range(25)] + ["aaaaaaa", "aaaaaa", "ÀÉÎõüß", "a×b÷cd"]
    pool = []
    for w in base:
        pool += [w] * 60
        for _ in range(3):
            at = RNG.randrange(len(w))
            slip = RNG.choice([w[:at] + w[at + 1:], w[:at] + "c" + w[at:], w[:at] + "b" + w[at + 1:]])
            pool += [slip] * 9 + [slip.upper()] * 2 + [slip + "a"] * RNG.choice([1, 4, 6, 60])
    pool += ["lantern"] * 400 + ["lanterne"] * 50 + ["lanternes"] * 6  # a chain of forms
    RNG.shuffle(pool)
    rows = [(i, " ".join(pool[i::200]) + " 12,x-y") for i in range(200)]
    long = "".join(RNG.choices("abcde", k=3000))
    rows += [(900 + i, f"{long} {long[:1500]}x{long[1500:]}" if i < 5 else long) for i in range(40)]
    return rows + [(None, " ".join(pool[:50])), (5, rows[5][1]), (5, rows[5][1]), (7, None), (8, ""), (None, None)]


@pytest.mark.parametrize("chars,table", [(spelling.INDEX_CHARS, spelling.TABLE), (90, 400)])
def test_groups_equal_brute_force(spark, monkeypatch, chars, table):
    monkeypatch.setattr(spelling, "TABLE", table)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (chars,))
    monkeypatch.setattr(spelling, "HELD", 50 if chars == 90 else spelling.HELD)
    rows = spelled_rows()
    got = sorted(map(tuple, spelling.group(spelled(spark, rows)).collect()))
    assert got == brute_groups(rows)
    assert any(r[2] != r[1] and r[1] for r in got), "a chain of forms"
    assert any(len(r[0]) > 2000 and r[1] for r in got), "a very long word"


def test_groups_of_nothing(spark):
    assert spelling.group(spelled(spark, [])).count() == 0


def test_index_search_is_complete(monkeypatch):
    rng = random.Random(2)
    for trial in range(12):
        monkeypatch.setattr(spelling, "TABLE", [8 << 20, 300][trial % 2])
        letters = "abé" if trial % 3 else "abcd"
        words = sorted({"".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(rng.choice([1, 5, 200]))})
        asked = sorted({"".join(rng.choices(letters + "z", k=rng.randint(6, 9))) for _ in range(60)} | set(words[:60]))
        index, found = spelling.Index(words), set()
        for left in (False, True):
            q, w = index.near(asked, left)
            pairs = list(zip(q.tolist(), w.tolist()))
            assert len(pairs) == len(set(pairs))
            found |= set(pairs)
        assert found == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if near(a, b)}


# -- the registered queries ----------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op11_topk", "op12_divergence"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    run, sql = ENTRIES[name]
    got = run(spark, "/root/testdata/sf0.001")
    cur = con.execute(sql)
    at = [[c[0] for c in cur.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())


def test_spelling_query_equals_brute_force(spark):
    run, _ = ENTRIES["op13_spelling"]
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, run(spark, "/root/testdata/sf0.001").collect())) == brute_groups(docs)
