"""Exact duplicates, fill-in-middle and the prefix trie against brute force, and their defined cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from larkspur.llm import exactdedup, middle, prefixtrie, simhash
from larkspur.llm.rows import looked_up

DOCS = "doc_id long, text string, lang string, digest string, h string, block int, row string"
TURNS = "conv_id long, turn long, role string, text string, c int, key string, place string"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def duck(sf):
    import os

    import duckdb

    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{t}')")
    return c


@pytest.mark.parametrize("name", ["op11_two_pass_bloom", "op12_fill_in_middle", "op13_prefix_trie"])
def test_matches_sql(spark, sf, duck, name):
    from larkspur.llm.queries import ORACLE_SQL, QUERIES

    want = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def _copies():
    rng = random.Random(3)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\nb ", "a\nb\t", "a b", "a b", "é" * 50_000, "é" * 50_000, "once", "Once"]
    rows = [(k, x) for k, x in enumerate(texts)] + [(100 + k, "hot\n" * (1 + k % 2) + "copy") for k in range(150)] + [(300 + k, f"own {k}") for k in range(100)]
    rows += [(4, "a b"), (4, "a b"), (None, "a b"), (None, "nameless"), (None, "nameless"), (None, "alone")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("broadcast", [exactdedup.BROADCAST_BYTES, 0])
def test_exact_duplicates_by_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(exactdedup, "BROADCAST_BYTES", broadcast)
    rows = _copies()
    docs = spark.createDataFrame([(*r, "en", "d", "h", 7, "row") for r in rows], DOCS)
    plain = lambda x: re.sub("[ \t-\r]+", " ", x or "")
    groups = collections.defaultdict(list)
    for i, x in rows:
        groups[plain(x)].append(i)
    least = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    want = sorted(((i, least(groups[plain(x)]), len(groups[plain(x)]), sha(plain(x))) for i, x in rows), key=repr)
    got = exactdedup.exact_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    one = exactdedup.distinct_documents(docs)
    assert one.columns == docs.columns
    out = one.collect()
    assert sorted((plain(r["text"]), r["doc_id"]) for r in out if r["doc_id"] is not None) == sorted((x, least(i)) for x, i in groups.items() if least(i) is not None)
    assert sorted(r["text"] for r in out if r["doc_id"] is None) == ["alone", "nameless"] and {tuple(r)[2:] for r in out} == {("en", "d", "h", 7, "row")}


def test_exact_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert exactdedup.exact_duplicates(none).count() == 0 and exactdedup.distinct_documents(none).count() == 0


def test_filter_passes_most_single_rows(spark):
    """No repeated hash is missed; of single ones few pass."""
    from pyspark.sql import functions as F

    n = 20_000
    h = spark.range(n).select("id", F.xxhash64("id").alias("h"))
    twice = h.unionByName(h.where("id < 500"))
    blocks = exactdedup._blocks(twice.count())
    tested = exactdedup._tested(twice, exactdedup.shared_cells(twice, blocks), blocks).groupBy("id").agg(F.max("may").alias("may"))
    assert tested.where("id < 500 and may").count() == 500 and tested.where("id >= 500 and may").count() < 0.03 * n


def test_lookups_of_hot_keys(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(6000)] + [(-1, None), (-2, "absent")], "id long, key string")
    found = rows.where("key is not null and key <> 'absent'").groupBy("key").count()
    got = {r["id"]: r["count"] for r in looked_up(rows, found, "key", "count", 6002).collect()}
    assert got == {k: 4000 if k % 3 else 1 for k in range(6000)} | {-1: None, -2: None}


def _tokens(text):
    return re.findall("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)


def test_edges_are_those_of_the_pattern():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(" \t\n\r\x0b\x0cabé　\U0001f600<") for _ in range(rng.randrange(12)))
        at = middle.edges(np.array([ord(x) for x in text], np.uint32))
        assert [text[a:b] for a, b in zip(at, at[1:])] == _tokens(text)


def test_fill_in_middle_by_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "\n\t", "x", "one two", "a <M> b", "<P>", "z<S>", "\U0001f600 日本", " lead", "trail  ", "w " * 60_000, "<X> <p>"]
    texts += ["".join(rng.choice(" \nabé\U0001f600") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(k * 7 - 20, x) for k, x in enumerate(texts)] + [(None, "no id but a text"), (1, "one two"), (1, "one two three")]
    docs = spark.createDataFrame([(*r, "en", "d", "h", 7, "row") for r in rows], DOCS)
    want = []
    for i, x in rows:
        x = x or ""
        toks, h = _tokens(x), sha(f"42:{'' if i is None else i}")
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        lo, hi = sorted((h1 % (len(toks) + 1), h2 % (len(toks) + 1)))
        pre, mid, suf = "".join(toks[:lo]), "".join(toks[lo:hi]), "".join(toks[hi:])
        if not x or "<P>" in x or "<S>" in x or "<M>" in x or h3 % 100 >= 50:
            want.append((i, len(toks), "plain", None, None, x))
        elif h4 % 100 < 80:
            want.append((i, len(toks), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"))
        else:
            want.append((i, len(toks), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"))
    made = middle.fill_in_middle(docs)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
    assert {x[2] for x in want} == {"plain", "spm", "psm"}
    back = collections.Counter((r["doc_id"], r["restored_sha256"]) for r in middle.digests(docs).collect())
    assert back == collections.Counter((i, sha(x or "")) for i, x in rows)
    assert middle.digests(docs.limit(0)).count() == 0


def _trie(rows):
    """Nodes by brute force, and their intervals' lengths."""
    convs = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        giver = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(giver, [])[:h] + t[h:])
    nodes = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            nodes[rebuilt[c][:d]].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    out = {}
    for k, m in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in m if rebuilt[c] == k)
        out[(m[0], len(k))] = (nodes[k[:-1]][0] if k else None, len(m), kids[k], sum(not kids[x] for x in below), saved, sha(ends), len(below))
    return out


def _conversations(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = rng.choice([rng.randrange(40), 100 + rng.randrange(5), rng.randrange(-150, 400), 7 * rng.randrange(60)])
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "b", "", None, "é\U0001f600"])))
    return rows + [(None, 0, "user", "x"), (500, 0, None, None), (900, None, "user", "same"), (900, None, "user", "same")]


@pytest.mark.parametrize("fan,longest", [(32, 5), (2, 9), (3, 20)])
def test_prefix_trie_by_brute_force(spark, monkeypatch, fan, longest):
    monkeypatch.setattr(prefixtrie, "FAN", fan)
    monkeypatch.setattr(prefixtrie, "CHUNK", 2)
    rows = _conversations(fan, 90, longest)
    # Copies and a conversation that is a prefix of others; one without turns of its own left.
    rows += [(1000 + k, t, "user", "same") for k in range(30) for t in range(8)]
    r = prefixtrie.prefix_trie(spark.createDataFrame([(*x, 1, "key", "place") for x in rows], TURNS)).collect()
    got = {(x["conv_id"], x["depth"]): (x["parent_conv_id"], x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"], x["ends_sha256"], x["subtree_end"] - x["preorder"] + 1) for x in r}
    assert len(got) == len(r) and got == _trie(rows)
    assert sorted(x["preorder"] for x in r) == list(range(len(r)))


def test_prefix_trie_over_several_partitions(spark):
    """Chains that cross range partitions: each running sum is moved by its own sums of the partitions before."""
    rows = _conversations(9, 120, 20)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = prefixtrie.prefix_trie(d).collect()
        x = prefixtrie._scanned(spark.range(1000).selectExpr("id", "id % 7 AS a", "id % 3 AS b"), ["id"], ["id", "a", "b"], ["a", "b"], "sums").orderBy("id").collect()
    finally:
        spark.conf.unset(name)
    assert {(x["conv_id"], x["depth"]): (x["parent_conv_id"], x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"], x["ends_sha256"], x["subtree_end"] - x["preorder"] + 1) for x in got} == _trie(rows)
    assert sorted(r["preorder"] for r in got) == list(range(len(got)))
    assert [(r["place"], r["to_a"], r["to_b"]) for r in x] == [(k, sum(i % 7 for i in range(k + 1)), sum(i % 3 for i in range(k + 1))) for k in range(1000)]


def test_prefix_trie_without_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefixtrie.prefix_trie(none).count() == 0
    turnless = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1][:3]
    rows = [(c, 0, "user", "gone", 1, "key", "place") for c in turnless]
    r = [tuple(x) for x in prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS)).drop("preorder", "subtree_end").collect()]
    assert r == [(turnless[0], 0, None, 3, 0, 1, 0, sha(",".join(map(str, turnless))))]


@pytest.mark.parametrize("n,block,part", [(12_000, 1, 1), (3000, 8, 2), (3000, 4096, 700)])
def test_simhash_tries_of_any_depth_and_parts(spark, n, block, part):
    """Pairs of bytes first where one stretch is too short, and thousands of large nodes: components are those of all pairs."""
    from larkspur.llm.components import components

    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)
    flips = [np.array([sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for k in rng.integers(0, 7, len(base))], np.uint64) for _ in range(2)]
    fps = np.unique(np.concatenate([base, base ^ flips[0], base ^ flips[1]]))
    i, j = simhash._near(fps, fps, 0, 4, 4)
    root = simhash._forest(len(fps), i, j)
    want = {}
    for k, r in enumerate(root.tolist()):
        want.setdefault(r, set()).add(int(fps[k].view(np.int64)))
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {}
    for r in components(simhash.trie_links(rows, block=block, part=part), "a", "b").collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1) and len(got) > n // 10


def test_simhash_orders_can_be_undone():
    x = np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64)
    for order in simhash._orders(4, 12) + simhash._orders(4, 13):
        read, at = np.zeros_like(x), 0
        for first, length in order:
            read, at = read | x << np.uint64(first) >> np.uint64(64 - length) << np.uint64(64 - at - length), at + length
        assert (simhash._unread(read, order) == x).all() and sum(n for _, n in order) == 64


def _jaccard(a, b):
    x, y = ({s[k : k + 8] for k in range(max(1, len(s) - 7))} for s in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "的一是不了人我在有他这中大来上国个到说们\U00020000"])
def test_fuzzy_lines_recall_in_any_script(spark, alphabet):
    """Near copies at 0.8 to 0.85, and bodies whose tails are of another script, are found; unlike lines are not."""
    from larkspur.llm import linededup

    rng = random.Random(len(alphabet))
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 9)))
    pairs = []
    while len(pairs) < 60:
        words = [word() for _ in range(rng.randrange(40, 120))]
        other = list(words)
        for k in rng.sample(range(len(words)), rng.randrange(1, 5)):
            other[k] = word()
        a, b = " ".join(words), " ".join(other)
        if 0.8 <= _jaccard(a, b) <= 0.86:
            pairs.append((a, b))
    tails = ["".join(rng.choice("eeeeeetaoins ") for _ in range(16)) for _ in range(40)]
    for k in range(20):
        body = " ".join(word() for _ in range(60))
        pairs.append((body + " " + tails[2 * k], body + " " + tails[2 * k + 1]))
    assert all(_jaccard(a, b) >= 0.8 for a, b in pairs)
    docs = spark.createDataFrame([(2 * k + j, x) for k, p in enumerate(pairs) for j, x in enumerate(p)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in linededup.fuzzy_lines(docs).collect()}
    met = [got[2 * k] == got[2 * k + 1] for k in range(len(pairs))]
    assert sum(met[:60]) >= 54 and sum(met[60:]) >= 18 and len(set(got.values())) >= len(pairs)
