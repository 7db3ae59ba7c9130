"""The llm operators: edge cases, brute force, round trips and held-out accuracy on small rows."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from larkspur.llm import chat, components, decontaminate, gridjoin, hpyp, linededup, mixing, pii, quality, queries, rans, simhash, tokens
from larkspur.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997}" for k in range(20_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs far away into the deep green forest today"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PROSE, "en", "a", 0), (2, PROSE, "en", "a", 0), (2, PROSE, "en", "a", 0), (3, None, "en", None, 0), (4, "", "en", "b", 0), (5, "  \n\t ", None, "b", 0), (6, LONG, "en", "c", 0), (7, "Éa! ünï 日本語 <|endoftext|>", "en", "c", 0), (None, "no id here", "en", "a", 0), (8, PROSE.replace("fox", "cat"), "en", "a", 0)]
    return spark.createDataFrame([(*r, "clash", 1.5) for r in rows], DOCS + ", score string, component_id double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_simhash_edges(docs, none):
    got = simhash.simhash_components(docs).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["fingerprint"], r["component_id"]))
    assert len(got) == docs.count() and by[1] == by[2] and by[3] == by[4] == by[5] == {("0" * 16, 3)}
    assert simhash.simhash_components(none).count() == 0


def test_simhash_brute_force(spark, sf):
    r = simhash.simhash_components(table(spark, sf, "documents")).toPandas()
    text = table(spark, sf, "documents").toPandas().set_index("doc_id")["text"]
    import xxhash

    for i, f in list(zip(r.doc_id, r.fingerprint))[:40]:
        w = text[i].encode().lower().split()
        s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        assert f == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"
    fps = [int(x, 16) for x in r.fingerprint]
    root = list(range(len(fps)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(r.doc_id):
        least[find(k)] = min(least.get(find(k), i), i)
    assert [least[find(k)] for k in range(len(fps))] == list(r.component_id)


def test_trie_finds_all_pairs_within_the_budget():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for _ in range(300)], np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips]))
    i, j = simhash._near(fps, fps, 0, 4, 4)
    got = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b}
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 4}
    assert got == want and want


def test_tokens_match_the_library(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = tokens.token_digests(docs, path).toPandas().sort_values("start")
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want = [t.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in rows]
    assert sorted(got.n_tokens) == sorted(map(len, want)) and got.start.tolist() == (np.cumsum(got.n_tokens) - got.n_tokens).tolist()
    assert collections.Counter(got.ids_crc32) == collections.Counter(zlib.crc32(np.array(x, "<u4").tobytes()) for x in want)
    assert tokens.token_digests(none, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000, 300_000])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 60_000).astype(np.int64)
    blob = rans.encode([7, None], np.array([n // 3, n - n // 3]), ids)
    own, lengths, back = rans.decode(blob)
    assert own == [7, None] and lengths.sum() == n and (back == ids).all()
    if n >= 300_000:
        assert (rans.decode_from_checkpoint(blob, 0, 1) == ids[rans.CHECKPOINT * rans.LANES : rans.BLOCK]).all()
        bad = bytearray(blob)
        bad[-5] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(bad))


def test_mixing(spark, sf, docs, none):
    r = mixing.mix(table(spark, sf, "documents")).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").toPandas()
    g = r.groupby("source").agg(target=("target", "first"), size=("size", "sum"), taken=("taken", "sum"), most=("size", "max"))
    assert abs(g.target.sum() - 1.5 * g["size"].sum()) < 1e-3 and (g.target <= 2 * g["size"] + 1e-6).all()
    assert ((g.taken - g.target).abs() <= g.most).all() and (r.taken <= 2 * r["size"]).all()
    edge = mixing.mix(docs).toPandas()
    assert len(edge) == docs.count() and edge[edge["size"] == 0].taken.sum() == 0
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == edge.copies.sum()


def test_targets_fill_by_weight(spark):
    s = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    assert got["a"] == 200 and abs(got["b"] - (1665 - 220)) < 1e-9 and got[None] == 20


def test_pitman_yor(spark, sf, docs, none):
    d = table(spark, sf, "documents")
    r = hpyp.scores(d).toPandas().sort_values("doc_id").reset_index(drop=True)
    p = d.toPandas().sort_values("doc_id").reset_index(drop=True)
    toks = [x.encode().lower().split() + [None] for x in p.text]
    held = [zlib.crc32(str(k).encode()) % 10 == 0 for k in p.doc_id]
    c = collections.Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t) for t in toks]
    assert list(r.held_out) == held and np.allclose(r.base_score, base) and (r.train_tokens == n).all()
    assert list(r.n_known) == [sum(c[w] > 0 for w in t) for t in toks]
    x = r[r.held_out]
    assert x.score.sum() > x.base_score.sum() and (r.score < 0).all()
    edge = hpyp.scores(docs).toPandas()
    assert len(edge) == docs.count() and set(edge[edge.doc_id == 3].n_tokens) == {1}
    assert hpyp.scores(none).count() == 0


def _stirling(n, d):
    """S(n, t) for t = 0 ... n by their recurrence, in logarithms."""
    rows = np.full((n + 1, n + 2), -np.inf)
    rows[1, 1] = 0
    for i in range(1, n):
        for t in range(1, i + 2):
            rows[i + 1, t] = np.logaddexp(rows[i, t - 1], (np.log(i - t * d) if i > t * d else -np.inf) + rows[i, t])
    return rows[n, : n + 1]


@pytest.mark.parametrize("n, a, g, d", [(2, 0.1, 0.01, 0.6), (5, 0.3, 0.05, 0.7), (33, 0.3, 0.05, 0.7), (40, 5.0, 0.1, 0.7), (60, 300.0, 0.2, 0.5), (100, 20.0, 0.02, 0.6), (300, 0.5, 0.01, 0.8), (300, 4.0, 0.01, 0.2)])
def test_seating_has_the_exact_conditional(n, a, g, d):
    """Tables after a few sweeps, by whichever step serves n, against the distribution by Stirling numbers."""
    logs = _stirling(n, d)[1:] + np.cumsum(np.r_[0, np.log(a + g * np.arange(1, n))])
    want = np.exp(logs - logs.max())
    want /= want.sum()
    many, t = 6000, None
    for sweep in range(4):
        key = hpyp._mix(np.arange(many, dtype=np.uint64) * np.uint64(77) + np.uint64(sweep + 1))
        t = hpyp.reseat(np.full(many, n), np.ones(many, int) if t is None else t, np.full(many, a), np.full(many, g), d, key)
    assert np.abs(np.bincount(t, minlength=n + 1)[1 : n + 1] / many - want).sum() / 2 < 0.04


def test_pitman_yor_by_hand(spark):
    """One training text of distinct words leaves no seat to chance: scores by the formulas."""
    train, ask = next(k for k in range(100) if not hpyp.held_out(k)), next(k for k in range(100) if hpyp.held_out(k))
    r = hpyp.scores(spark.createDataFrame([(train, "A b c d"), (ask, "b c x a")], "doc_id long, text string")).toPandas().set_index("doc_id")
    d, theta, pairs = 0.95, 1.0, {("start", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "end")}

    def p(u, w):
        base = 0.1 / 5 if w != "x" else 0.9
        above = ((1 - d) * (w != "x") + (theta + d * 5) * base) / (theta + 5)
        seen = u != "x"
        return (((u, w) in pairs) * (1 - d) + (theta + d * seen) * above) / (theta + seen)

    for key, words in ((train, "start a b c d end"), (ask, "start b c x a end")):
        w = words.split()
        assert abs(r.score[key] - sum(math.log10(p(u, v)) for u, v in zip(w, w[1:]))) < 2e-4
    assert abs(sum(p("b", w) for w in ("a", "b", "c", "d", "end", "x")) - 1) < 1e-12
    assert abs(r.perplexity[ask] - 10 ** (-r.score[ask] / 5)) < 1e-6


def test_pitman_yor_does_not_depend_on_dealing(spark, docs):
    several = docs.unionAll(docs.withColumn("doc_id", docs.doc_id + 20)).select("doc_id", "text")
    one = hpyp.scores(several.coalesce(1)).toPandas().sort_values(["doc_id", "n_tokens"]).score
    two = hpyp.scores(several.repartition(5)).toPandas().sort_values(["doc_id", "n_tokens"]).score
    assert np.allclose(one, two, rtol=1e-9)


def test_quality(spark, sf, docs, none):
    labels = table(spark, sf, "labels")
    r = quality.quality_scores(table(spark, sf, "documents"), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = r[r.held_out]
    assert (held.predicted == held.quality).mean() >= 0.9 and r.score.between(0, 1).all()
    edge = quality.quality_scores(docs, labels.limit(0)).toPandas()
    assert len(edge) == docs.count() and (edge.score == 0.5).all()
    assert quality.quality_scores(none, labels).count() == 0
    assert quality.good_documents(docs, labels.limit(0), 0.4).columns == docs.columns


def test_pii_base_and_links(docs, none):
    card = "4845168114407329"
    t = f"Pay {card} now. Later 7536784127813050 {card} again, mail a.b@x.org, 10.0.0.300 and 10.0.0.30, +1 (917) 555-2670."
    base = pii.base_spans(t)
    assert [t[s:e] for _, s, e in base] == ["a.b@x.org", "10.0.0.30", card, "+1 (917) 555-2670"]
    f = pii.Field()
    f.skip[:] = 3 * (2 * np.eye(5) - 1)
    added = pii.model_spans([t], [base], f)[0]
    assert [t[s:e] for k, s, e in added if k == 2] == [card]
    r = pii.personal_data(docs).toPandas()
    assert len(r) == docs.count() and set(r.base_sha256) == {hashlib.sha256(b"").hexdigest()}
    assert pii.personal_data(none).count() == 0


@pytest.mark.parametrize("text", ["mail jane.doe@x.org " + "word " * 1000 + "jane.doe said", "mail jane.doe@x.org" + " then jane.doe left" * 40, "jane.doe left then " * 40 + "mail jane.doe@x.org", "jane.doe@x.org jane.doe jane.doe and more of jane.doe"])
def test_pii_repeats_are_tied_at_any_distance(text):
    f = pii.Field()
    f.skip[:] = 3 * (2 * np.eye(5) - 1)
    added = pii.model_spans([text], [pii.base_spans(text)], f)[0]
    assert " ".join(text[s:e] for k, s, e in added if k == 0).split() == ["jane.doe"] * (text.count("jane.doe") - 1)


def _planted(spark):
    """Documents with numbers and addresses, of which some come again in another form that no pattern finds."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(200):
        digits = "".join(map(str, rng.integers(0, 10, 7)))
        name = "".join(chr(97 + c) for c in rng.integers(0, 26, 5)) + ".smith"
        body = f"Order {k} of {rng.integers(1, 99)} items, call +1 (917) {digits[:3]}-{digits[3:]} or mail {name}@x{k}.org, from 10.0.{k}.7 on 2024-05-{k % 28 + 1:02d}. "
        if k % 4 == 0:
            body += "Some words later. " * (k % 7) + f"Ask {name} again, at 917{digits} please."
            want[k] = {name, "917" + digits}
        rows.append((k, body))
    return spark.createDataFrame(rows, "doc_id long, text string"), want


def test_pii_fitted_field_adds_planted_repeats(spark):
    d, want = _planted(spark)
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    got = pii.personal_data(d).toPandas()
    added = {}
    for r in got.itertuples():
        base = {f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(text[r.doc_id])}
        more = [x.split(":") for x in r.spans.split(",") if x not in base]
        added[r.doc_id] = {text[r.doc_id][int(s) : int(e)] for _, s, e in more}
        assert r.n_added == len(more) and r.n_ip == 1 and r.n_email == 1 and r.n_phone == 1
    assert sum(want[k] <= added[k] for k in want) >= 0.9 * len(want) and not any(added[k] for k in text if k not in want)


def test_pii_base_by_plain_patterns(spark, sf):
    """The base of whole tables, and of texts made to break a scan, against the contract's patterns."""
    import re

    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("a.@b-%+ c1"), int(rng.integers(0, 30)))) for _ in range(5000)]
    texts += [r["text"] or "" for r in table(spark, sf, "documents").collect()]
    for t in texts:
        assert [m.span() for m in plain.finditer(t)] == [(s, e) for k, s, e in pii.base_spans(t) if k == 0]
    many = "jane.doe@x.org" + " then jane.doe left" * 3000
    f = pii.Field()
    f.skip[:] = 3 * (2 * np.eye(5) - 1)
    assert len(pii.model_spans([many], [pii.base_spans(many)], f)[0]) == 3000
    assert len(pii.base_spans("a" * 300_000 + "@ " + "b@" * 100_000)) == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, PROSE), (2, PROSE.upper()), (3, "too short"), (4, None), (5, "unrelated words " * 8)], "item_id long, text string")
    changed = PROSE.split()
    changed[9], changed[15] = "x", "y"
    rows = [(1, f"start here {PROSE} and on", "", "", 0), (2, f"pre {' '.join(changed)} post", "", "", 0), (3, "nothing of it", "", "", 0), (4, None, "", "", 0), (5, "", "", "", 0), (6, LONG, "", "", 0)]
    d = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["item_id"]): r["overlap"] for r in decontaminate.overlaps(d, items).collect()}
    n = len(PROSE.split())
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): (n - 2) / n, (2, 2): (n - 2) / n}
    assert {r["doc_id"] for r in decontaminate.clean_documents(d, items).collect()} == {3, 4, 5, 6}
    assert decontaminate.overlaps(none, items).count() == 0 and decontaminate.overlaps(d, items.limit(0)).count() == 0
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == docs.count()


def test_units_of_words_by_their_shapes(monkeypatch):
    """Plain ASCII words get their shapes' rows without a look at each character; the rows are the definition's."""
    import xxhash

    words = ["word", "Word", "word,", "Word.", "WORD", "w", "W", "W,", ",", ".", "w0rd", "wOrd", "Örd", "örd", "Ab!!", "the,.", "don't", "的一", "ÉCOLE,", "wordé"]
    digest, free = xxhash.xxh32_intdigest, quality.ROWS - 2 - quality._SHAPES
    row = lambda b: 2 + quality._SHAPES + digest(b) % free
    want = [[row(w.lower()), 2 + digest(quality._shape(w.decode()).encode()) % quality._SHAPES, row(b"~" + w[-3:].lower())] for w in map(str.encode, words)]
    assert quality._units([w.encode() for w in words]).tolist() == want
    monkeypatch.setattr(quality, "_shape", None)
    assert quality._units([b"word", b"Word", b"word,"]).tolist() == want[:3]


def test_known_pre_tokens_are_looked_up_once():
    """A pre-token that is known is neither split nor encoded again, nor forgotten between tasks of 300,000 of them."""
    path = queries.tokenizer_path()
    encoder = tokens.Encoder(path)
    texts = ["some words, some more", " ünder  the line\n\nwords", "", "don't stop"]
    want = [[*encoder.whole.encode(t, add_special_tokens=False).ids, tokens.END] for t in texts]
    lengths, ids = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    encoder._piece = None
    assert encoder.encode(["some more words"])[1].tolist() == [*encoder.whole.encode("some more words", add_special_tokens=False).ids, tokens.END]
    kept = tokens.Encoder.of(path)
    kept.known |= {f"#{k}": (k,) for k in range(300_000)}
    try:
        assert len(tokens.Encoder.of(path).known) >= 300_000
    finally:
        kept.known.clear()


def test_lines(spark, docs, none):
    near = PROSE.replace("today", "tonight")
    d = spark.createDataFrame([(1, f"{PROSE}\n\n{near}\nother words of no likeness at all", "", "", 0), (2, f"  {PROSE}  \nab\nab", "", "", 0), (3, None, "", "", 0), (4, "\n", "", "", 0)], DOCS)
    got = sorted((r["doc_id"], r["line_no"], r["kept"]) for r in linededup.fuzzy_lines(d).collect())
    assert got == [(1, 0, True), (1, 2, False), (1, 3, True), (2, 0, False), (2, 1, True), (2, 2, False)]
    texts = {r["doc_id"]: r["text"] for r in linededup.deduplicated(d).collect()}
    assert texts[2] == "ab" and texts[3] is None and texts[1].startswith(PROSE)
    assert linededup.fuzzy_lines(none).count() == 0 and linededup.fuzzy_lines(docs).count() > 0


def test_decontamination_of_short_items(spark):
    """Items of every length under a window are found verbatim and with the most substitutions allowed, not with one more."""
    rng = np.random.default_rng(6)
    items, rows, want = [], [], set()
    for n in range(1, 26):
        for k in range(6):
            item = [f"i{n}x{k}y{j}" for j in range(n)]
            items.append((100 * n + k, " ".join(item)))
            for extra in (-(n // 5), 0, 1):
                changed = list(item)
                for j in rng.choice(n, n // 5 + extra, replace=False):
                    changed[j] = "other"
                doc = len(rows)
                rows.append((doc, " ".join(["some", "words"][: k % 3] + changed + ["after"] * (k % 2)), "", "", 0))
                want |= {(doc, 100 * n + k)} if extra < 1 else set()
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got - want == set()
    assert {x for x in want - got if x[1] < 2500} == set()


def _lines(spark, lines):
    return linededup.lines_of(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string"))


def _sets(lines):
    k = linededup.SHINGLE
    return [{x[i : i + k] for i in range(len(x) - k + 1)} or {x} for x in lines]


def _jaccard(x, y):
    return len(x & y) / len(x | y)


def test_line_pairs_at_the_threshold_are_found(spark):
    """Pairs of a similarity of 0.8 to 0.87, short and long, by changed words and characters: at least 0.9 are found, and none below 0.8."""
    rng = np.random.default_rng(4)
    lines, near = [], []
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9))))
    while len(near) < 300:
        words = [word() for _ in range(int(rng.integers(8, 90)))]
        other = list(words)
        for k in rng.choice(len(words), max(1, len(words) // 15), replace=False):
            other[k] = word()
        x, y = " ".join(words), " ".join(other)
        a, b = _sets([x, y])
        if 0.8 <= _jaccard(a, b) <= 0.87:
            near.append((len(lines), len(lines) + 1))
            lines += [x, y]
    far = len(lines)
    lines += [x[: len(x) * 7 // 10] + word() * 5 for x in lines[:200:2]]
    found = {r["class_id"]: r["component"] for r in linededup.line_components(_lines(spark, lines)).collect()}
    names = {r["line"]: r["class_id"] for r in _lines(spark, lines).select("line", "class_id").collect()}
    got = [found.get(names[x], names[x]) for x in lines]
    assert sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)
    assert len({*got[far:]} & {*got[:far]}) == 0


def test_no_line_pair_just_above_the_threshold_is_lost(spark):
    """400 pairs of lines at a similarity of 0.80 to 0.82: all are found."""
    rng = np.random.default_rng(21)
    lines = []
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9))))
    while len(lines) < 800:
        words = [word() for _ in range(int(rng.integers(15, 120)))]
        other = list(words)
        for k in rng.choice(len(words), max(1, len(words) // 16), replace=False):
            other[k] = word()
        x, y = " ".join(words), " ".join(other)
        if 0.8 <= _jaccard(*_sets([x, y])) <= 0.82:
            lines += [x, y]
    found = {r["class_id"]: r["component"] for r in linededup.line_components(_lines(spark, lines)).collect()}
    names = {r["line"]: r["class_id"] for r in _lines(spark, lines).select("line", "class_id").collect()}
    assert [k for k in range(0, 800, 2) if found.get(names[lines[k]], k) != found.get(names[lines[k + 1]], k + 1)] == []


def test_signing_shuffles_texts_not_minima(spark, tmp_path):
    """Signatures come from one exchange, of the lines themselves: no minimum of a bin is shuffled."""
    _lines(spark, [PROSE, PROSE + " more", "short"]).select("class_id", "line").write.parquet(str(tmp_path / "texts"))
    signed = linededup._signatures(spark.read.parquet(str(tmp_path / "texts")))
    assert signed.count() == 3
    plan = signed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert "HashAggregate" in plan and "HashAggregate" not in plan[plan.index("Exchange hashpartitioning") :]


def test_lines_with_returns_and_repeats(spark):
    rows = [(1, "a b\rc d\re f"), (2, "a b\rc d\re g"), (3, "\u2028\u2028x\u2028y"), (4, "same line of a document that comes twice"), (4, "same line of a document that comes twice"), (5, "same line of a document that comes twice")]
    got = sorted((r["doc_id"], r["kept"]) for r in linededup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got) == 6 and [k for i, k in got if i == 4] == [True, True] and (5, False) in got
    clash = spark.createDataFrame([(1, "x\nx", 5, "on", "new")], "doc_id long, text string, line_no int, `stays` string, new_text string")
    assert [tuple(r) for r in linededup.deduplicated(clash).collect()] == [(1, "x", 5, "on", "new")]


def test_crowded_band_is_compared_in_full(spark, monkeypatch):
    """All lines in one band, by a shingle of a very small hash: components as by all pairs' Jaccard, however few resemble the leaders."""
    monkeypatch.setattr(linededup, "BANDS", 1)
    monkeypatch.setattr(linededup, "ROWS", 1)
    monkeypatch.setattr(linededup, "AGREE", 1)
    monkeypatch.setattr(linededup, "BLOCK", 16)
    from pyspark.sql import functions as F

    some = spark.range(5_000_000).select(F.lpad(F.conv("id", 10, 36), linededup.SHINGLE, "0").alias("s"))
    mark = some.select(F.min_by("s", F.xxhash64(F.xxhash64(F.encode("s", "UTF-32")), F.lit(0)))).first()[0]
    rng = np.random.default_rng(5)
    lines = []
    for _ in range(30):
        x = mark + "".join(chr(97 + c) for c in rng.integers(0, 26, 60))
        lines += [x, x[:65] + "!!", x + "??????", x[:35]]
    sets = _sets(lines)
    pairs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if _jaccard(sets[a], sets[b]) >= 0.8]
    i, j = np.array(pairs).T
    want = simhash._forest(len(lines), i, j)
    d = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in linededup.fuzzy_lines(d).collect()}
    first = {}
    assert [first.setdefault(got[k], k) for k in range(len(lines))] == want.tolist() and len(i) >= 60


def test_components_of_a_long_chain(spark):
    from pyspark.sql import functions as F

    links = spark.range(9999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rounds = []
    got = components.components(links, "a", "b", rounds).agg(F.count("*"), F.max("component")).first()
    assert tuple(got) == (10_000, 0) and rounds[0] < 20


def test_stages_pass_clashing_columns(spark):
    """Columns that operators use inside: the stages return the caller's rows as they are."""
    names = ("rows", "leaked_id", "head_id", "line_no", "row", "own_id", "row_key", "all_copies", "fp", "item_id", "copies")
    schema = DOCS + "".join(f", {c} string" for c in names)
    rows = [(1, PROSE, "en", "a", 9, *names), (1, PROSE, "en", "a", 9, *names), (2, None, "en", None, 9, *names), (None, "no id", "en", "a", 9, *names), (3, LONG, "en", "b", 9, *names), (4, "", "en", "b", 9, *names)]
    d = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([(1, PROSE + " more words")], "item_id long, text string")
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))
    clean = decontaminate.clean_documents(d, items)
    assert clean.columns == d.columns and ids(clean) == [2, 3, 4, None]
    one = simhash.distinct_documents(d)
    assert one.columns == d.columns and ids(one) == [1, 2, 3, None]
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns and {tuple(r)[5:] for r in mixed.collect()} == {names}
    for f in (simhash.distinct_documents, mixing.mixed_documents, lambda x: decontaminate.clean_documents(x, items)):
        assert f(d.limit(0)).count() == 0


def test_grid_join(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base[:60] + 0.1 * rng.normal(size=(60, 16)), base[:20], base[20:30] * 3])
    rows = [(int(k), v.tolist(), 0) for k, v in enumerate(x)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("inf")] * 16, 0), (1003, [1.0, None], 0), (1004, [], 0), (1005, [1.0, 0.0], 0), (1006, [5.0, 0.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in gridjoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T >= 0.9
    np.fill_diagonal(c, False)
    i, j = np.nonzero(np.triu(c))
    root = simhash._forest(len(x), i, j)
    assert all(got[k] == (int(c[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(len(x))) and len(i) > 50
    assert all(got[k] == (0, k, True) for k in range(1000, 1005)) and got[1005] == (1, 1005, True) and got[1006] == (1, 1005, False)


def test_grid_join_shuffles_no_pairs(spark, monkeypatch):
    """Pairs of intervals are read where they lie, however many there are; intervals, blocks, a hot group and one-dimensional vectors by brute force."""
    monkeypatch.setattr(gridjoin, "WIDE", 200)
    monkeypatch.setattr(gridjoin, "BLOCK", 64)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 64))
    x = np.concatenate([x, x[:1] + 0.1 * rng.normal(size=(400, 64)), x[:100] + 0.25 * rng.normal(size=(100, 64)), x[5:6].repeat(50, 0), 2 * x[:30]]).astype(np.float32).astype(np.float64)
    plans = []
    pairs = gridjoin._pairs
    monkeypatch.setattr(gridjoin, "_pairs", lambda *a: plans.append(pairs(*a)) or plans[-1])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in gridjoin.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T >= 0.9
    np.fill_diagonal(c, False)
    root = simhash._forest(len(x), *np.nonzero(np.triu(c)))
    assert got == {k: (int(c[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(len(x))} and c.sum() > 100_000
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert len(plans) == 1 and "CartesianProduct" in plan and "Exchange" not in plan
    one = gridjoin.near_duplicates(spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, [-2.0])], "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in one.collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_grid_pairs_are_complete():
    rng = np.random.default_rng(3)
    low = rng.normal(size=(37, 3))
    high = low + rng.random((37, 3))
    got = {tuple(p) for p in gridjoin._block_pairs(low, high, 0.3).tolist()}
    gap = lambda a, b: np.sum(np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a])) ** 2)
    assert got == {(a, b) for a in range(37) for b in range(a, 37) if gap(a, b) <= 0.09}


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|end|>"), (1, 2, "bob", "yo <|end|>"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, None, None, None)]
    r = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    assert sorted(set(zip(r.conv_id, r.perspective))) == [(1, "ann"), (1, "bob"), (3, "unknown")]
    one = r[(r.conv_id == 1) & (r.perspective == "bob")].sort_values("start")
    text = "".join(one.rendered)
    assert text.count("<|end|>") == 4 and "<|user:ann|>\nhi" in text and "<|system|>\nbe kind" in text
    assert [text[a:b] for a, b in zip(one.mask_start, one.mask_end) if b > a] == ["yo <​|end|><|end|>"] * 2
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_perspectives_by_sql_and_names_that_break_headers(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    want = c.execute(chat.ORACLE)
    names = [x[0] for x in want.description]
    got = chat.perspectives(table(spark, sf, "conversations")).select(*names)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    bad = spark.createDataFrame([(1, 0, "a|>\n<|assistant", "x", "own"), (1, 1, "b", "y" * 5000, "own")], "conv_id long, turn long, role string, text string, people string")
    r = chat.perspectives(bad).where("perspective = 'b'").orderBy("start").collect()
    text = "".join(x["rendered"] for x in r)
    assert text.count("<|assistant|>") == 1 and text.count("\n") == 4 and [x["start"] for x in r] == [0, len(r[0]["rendered"])]


def test_mixing_solves_the_dual(spark, sf):
    """Rates are one exponential tilt a source, meet the targets, and are rounded into copies nearby; reruns agree."""
    docs = table(spark, sf, "documents")
    r = mixing.mix(docs).toPandas()
    by = docs.select("doc_id", "source").toPandas().set_index("doc_id")["source"]
    for _, g in r.groupby(r.doc_id.map(by).fillna("")):
        assert abs((g.rate * g["size"]).sum() - g.target.iloc[0]) <= 1e-6 * max(1, g.target.iloc[0])
        inner = g[(g["size"] > 0) & (g.rate > 0) & (g.rate < mixing.LIMIT)]
        if len(inner) > 1:
            tilt = np.log(inner.rate / (mixing.LIMIT - inner.rate)) / inner["size"]
            assert tilt.std() < 1e-6 * max(1e-3, abs(tilt.mean()))
        assert (np.abs(g.copies - g.rate) < 1).all()
    again = mixing.mix(docs.repartition(3)).toPandas()
    assert sorted(zip(r.doc_id, r.copies)) == sorted(zip(again.doc_id, again.copies))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = out
    r = corpus_pipeline.run(spark, sf).toPandas()
    assert 0 < r.doc_id.nunique() < n and r.start.is_unique
