"""Operators 11 to 13, and parts of 6, 9 and 10, against plain models over small tables with odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import clusters, common, divergence, langid, minhash, ngram_join, packing, prefix_trie, simhash
from tests.llm.test_operators import brute_components, corpus, key, sets_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, a string, label string, k_id long, part int, drops string, l_row int, signature string"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


# 11
def brute_trie(rows, every=100, heads=6):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        paths[c] = (turns.get(c - int(math.fmod(c, every)), [])[:h]) + mine[h:]
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    found = []
    for node, members in nodes.items():
        below = [k for k in nodes if k[: len(node)] == node]
        inner = {k[:-1] for k in nodes if k}
        ends = sorted(c for c in members if len(paths[c]) == len(node))
        found.append((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(k) == len(node) + 1 for k in below), sum(k not in inner for k in below),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(found, key=key)


def conversations(seed, n=160, ids=lambda rng, i: i * 3 % 307):
    rng = random.Random(seed)
    said = [None, "", "hello", "a\0b", "é" * 40, "x" * 3000, "why?", "bye"]
    rows = []
    for i in range(n):
        c = ids(rng, i)
        rows += [(c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None]) if rng.random() > 0.7 else "user", rng.choice(said[: rng.choice([2, 5, 8])])) for t in range(rng.choice([1, 2, 3, 8]))]
    rows += [(400, 0, "user", "same")] * 3 + [(401, t, "user", "same") for t in range(60)] + [(402, t, "user", "same") for t in range(60)]
    rows += [(None, 0, "user", "nobody's"), (-7, 0, "user", "hello"), (-107, 0, "user", "hello"), (-100, 1, "user", "x")]
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", [1, 7])
def test_trie_equals_all_prefixes(spark, parts):
    rows = conversations(parts)
    df = spark.createDataFrame(rows, TURNS).repartition(3).withColumns({"depth": F.lit(1), "codes": F.lit("x"), "n": F.lit(2)})
    found = prefix_trie.prefix_trie(df)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=key) == brute_trie(rows)


def test_ranges_of_any_cut_give_one_trie(spark):
    """The same paths in one range and in many, with paths that repeat each other's beginnings on both sides of a cut."""
    rng = random.Random(5)
    paths = sorted({tuple(rng.choice([1, 2, 3]) for _ in range(rng.randrange(0, 9))) for _ in range(300)} | {(7,) * k for k in range(0, 40)})
    rows = [(list(p), [2 * code + 1 for code in p], 1 + i % 3, i * 10, f"d{i}") for i, p in enumerate(paths)]
    classes = spark.createDataFrame(rows, "codes array<long>, lengths array<long>, n long, conv_id long, ends string")

    def whole(parts):
        nodes = prefix_trie.range_tries(classes, parts).cache()
        tops = prefix_trie.merged(nodes)
        columns = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
        return sorted(map(tuple, nodes.where("not shared").select(*columns).union(tops.select(*columns)).collect()), key=key)

    assert whole(1) == whole(5) == whole(40)


def test_tree_search_stays_short():
    tree, n = prefix_trie.TernaryTree(), 1023
    for i in prefix_trie.medians_first(n):
        assert tree.insert([i, 5], [1, 1])[0] == 0
    depth = {0: 0}
    for node in range(len(tree.code)):
        for child in (tree.low[node], tree.high[node]):
            if child >= 0:
                depth[child] = depth.get(node, 0) + 1
    assert max(depth.values()) < 10
    assert len(tree.code) == 1 + 2 * n


def test_digests_of_a_class_in_many_batches(spark):
    rows = [(i % 2, 0, i) for i in range(5000)] + [(2, 0, -5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r.k_a: r.ends for r in prefix_trie.end_digests(spark.createDataFrame(rows, "k_a long, k_b long, conv_id long").repartition(4)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {a: hashlib.sha256(",".join(str(r[2]) for r in rows if r[0] == a).encode()).hexdigest() for a in (0, 1, 2)}


# 12
@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, n, percent):
    chunks = 18 if percent == 85 else 21
    found = minhash.near_duplicates(docs, words=n, percent=percent, signatures=minhash.Signatures(chunks=chunks)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == brute_components(rows, n, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_in_dense_groups(spark):
    rng = random.Random(15)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(1, 7)):
            words[rng.randrange(150)] = f"n{rng.random()}"
        rows.append((i, " ".join(words)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=key) == brute_components(rows, 3, 85)
    one = minhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in brute_components(rows, 3, 85)})


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(3)
    for signatures in (minhash.Signatures(), minhash.Signatures(30, 5, 2), minhash.Signatures(10, 4, 0)):
        a = rng.integers(0, 1 << 16, (300, signatures.symbols)).astype(np.uint16)
        b = a.copy()
        for row in b:
            row[rng.permutation(signatures.symbols)[: signatures.radius]] += 1
        keys_a, keys_b = signatures.keys(a), signatures.keys(b)
        assert all(len(np.intersect1d(x, y)) for x, y in zip(keys_a, keys_b, strict=True))
        assert not np.intersect1d(keys_a[0], signatures.keys(a[1:2])[0]).size


def test_symbols_agree_as_often_as_sets():
    rng = np.random.default_rng(4)
    signatures, agree = minhash.Signatures(), []
    for _ in range(150):
        x = rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)
        a, b = signatures.sketches([np.unique(x[:900]), np.unique(x[100:])])
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 0.8) < 0.01
    assert not signatures.sketches([np.empty(0, np.uint64)]).any()


def test_bounds_agree_in_pairs_and_blocks():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(300)]
    sets = [np.unique(np.array(rng.sample(base, rng.randrange(200, 300)) + [rng.getrandbits(64) for _ in range(rng.randrange(40))], np.uint64)) for _ in range(40)]
    sizes = np.array([len(s) for s in sets])
    signatures = minhash.Signatures()
    for bound, sketches in ((minhash.Within(signatures, 85), signatures.sign(sets)[0]), (ngram_join.Buckets(85), [ngram_join.bucket_counts(s) for s in sets])):
        x, y, apart = bound.crossed(sketches, sizes, sketches, sizes, np.ones((40, 40), bool))
        i, j = np.divmod(np.arange(1600), 40)
        own, near = bound.aligned([sketches[k] for k in i], sizes[i], [sketches[k] for k in j], sizes[j])
        assert {*zip(x.tolist(), y.tolist(), apart.tolist())} == {*zip(i[near].tolist(), j[near].tolist(), own[near].tolist())}
        for a in range(40):
            for b in range(40):
                common_ = len(np.intersect1d(sets[a], sets[b]))
                if isinstance(bound, ngram_join.Buckets) and 100 * common_ >= 85 * (sizes[a] + sizes[b] - common_):
                    assert near[a * 40 + b]


def test_pairs_are_verified_in_one_pass_or_two(spark):
    rng = random.Random(6)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base + " " + " ".join(rng.choice("abc") for _ in range(rng.randrange(9)))) for i in range(60)] + [(i, f"own text {i} " * 9) for i in range(60, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = lambda: ngram_join.shingle_sets(docs, 4, 85)
    found = [
        sorted((r.doc_id, r.component_id) for r in clusters.joined_rows(docs, sets(), ngram_join.Buckets(85), words=4, percent=85, at_once=n, broadcast_rows=b).collect())
        for n, b in ((10**6, 10**6), (0, 10**6), (0, 0))
    ]
    assert found[0] == found[1] == found[2] == sorted((i, c) for i, _, c in brute_components(rows, 4, 85))


def test_rows_dealt_in_passes_link_alike(spark, docs):
    """Also dense groups that nearest members don't join, so that pairs of open groups are dealt in passes too."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    near = [(1000 + i, " ".join(w if rng.random() > 0.04 else f"x{i}-{k}" for k, w in enumerate(base))) for i in range(40)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    one, three = (
        sorted(map(tuple, clusters.joined_rows(both, ngram_join.shingle_sets(both, 4, 85), ngram_join.Buckets(85), words=4, percent=85, passes=n).select("n_shingles", "component_id", "class_id").collect()), key=str)
        for n in (1, 3)
    )
    assert one == three and len({x[1] for x in one}) < len(one)


def test_links_within_components_are_all_counted(spark, docs, rows):
    """Copies count as one set; pairs of blocks, whatever their size, give what one block gives."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    near = [(1000 + i, " ".join(w if rng.random() > 0.02 else f"x{i}-{k}" for k, w in enumerate(base))) for i in range(60)]
    near += [(2000, near[0][1]), (None, near[1][1]), *((i, " ".join(base[:9] * 30) + f" y{i}") for i in range(3000, 3003))]
    every = [(r[0], r[1]) for r in rows] + near
    sets = [frozenset(x) for x in sets_of(every, 4)]
    links = {x: sum(x != y and 100 * len(x & y) >= 85 * len(x | y) for y in {*sets} if y) if x else 0 for x in {*sets}}
    wanted = sorted(((i, len(x), links[x]) for (i, _), x in zip(every, sets, strict=True)), key=key)
    assert len({*links.values()}) > 5
    both = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string")).repartition(4)
    for found in (ngram_join.jaccard_join(both, words=4, percent=85), minhash.near_duplicates(both, words=4, percent=85)):
        assert sorted(map(tuple, found.select("doc_id", "n_shingles", "n_links").collect()), key=key) == wanted
    once = {text: i for i, text in near[:60]}
    only = spark.createDataFrame([(i, text) for text, i in once.items()], "doc_id long, text string").coalesce(1).cache()
    signed = common.stored(ngram_join.shingle_sets(only, 4, 85), "signed")
    labels = signed.selectExpr("row AS node", "0L AS label")
    own = {i: links[x] for (i, _), x in zip(every, sets, strict=True) if i}
    for block, features in ((512, 1 << 18), (7, 1 << 18), (512, 300), (1, 1)):
        counted = clusters.link_counts(labels, only, signed, 4, 85, 0, block, features).join(signed, "row")
        assert {r.doc_id: r.n_links for r in counted.collect()} == {i: own[i] for i in once.values()}


def test_passes_split_rows_by_whole_groups(spark):
    rows = spark.range(4000).selectExpr("id % 97 AS signature", "id AS row")
    parts = [df.collect() for df in clusters.in_passes(rows, 2, lambda part: part, "part")]
    assert sorted(r.row for part in parts for r in part) == list(range(4000))
    groups = [{r.signature for r in part} for part in parts]
    assert all(groups) and not groups[0] & groups[1]


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name for d in folders for p in Path(d).glob("*/shuffle_*")}


def test_passes_leave_no_shuffle_files(spark, docs):
    """Those of a pass are gone when the next begins, and those of all steps when the last join begins."""
    time.sleep(1)  # for Spark's listeners, which hold the query that ended last
    common.forget_shuffles(spark)
    before, seen = shuffle_files(spark), []
    rows = spark.range(4000).selectExpr("id % 97 AS signature", "id AS row")

    def step(part):
        seen.append(shuffle_files(spark) - before)
        return part.repartition(3, "signature")

    clusters.in_passes(rows, 3, step, "part")
    own = docs.select("doc_id", "text")
    clusters.joined_rows(own, ngram_join.shingle_sets(own, 4, 85), ngram_join.Buckets(85), words=4, percent=85, passes=2)
    assert [*seen, shuffle_files(spark) - before] == [set()] * 4


# 13
def brute_divergence(rows, least_docs=3, top=200):
    terms = [Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    groups = sorted({(r[2] or "", r[3] or "") for r in rows})
    found = []
    for lang in sorted({g[0] for g in groups}):
        own = [(r[3] or "", t) for r, t in zip(rows, terms, strict=True) if (r[2] or "") == lang]
        kept = {w for w, n in Counter(w for _, t in own for w in t).items() if n >= least_docs}
        counts = {"": Counter()} | {s: Counter() for s, _ in own}
        whole = Counter()
        for s, t in own:
            part = Counter({w: n for w, n in t.items() if w in kept})
            counts[s] += part
            whole += part
        sources = sorted({s for s, _ in own})
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        p = {s: {w: share(counts[s], w) for w in kept} for s in sources}
        q = {w: share(whole, w) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in sources if o != s]
            words = [(w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", words)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(order, 1) if part == "pair" or i <= top]
    return sorted(found)


@pytest.mark.parametrize(("least_docs", "top", "block_rows"), [(3, 200, 1 << 16), (2, 4, 9), (10**6, 200, 5)])
def test_divergence(docs, rows, least_docs, top, block_rows):
    found = divergence.source_divergence(docs, least_docs=least_docs, top=top, block_rows=block_rows)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute_divergence(rows, least_docs, top)
    small = divergence.source_divergence(docs, least_docs=least_docs, top=top, block_rows=block_rows, broadcast_rows=0)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, found.collect()))


def test_terms_of_every_length_are_counted():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abÉßж中A") for _ in range(n))
    vocab = [word(n) for n in [1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 40, 3000] for _ in range(4)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(60))) + rng.choice(["", "1", "-x"]) for _ in range(40)] + ["", "...", vocab[-1]]
    data, start, length, doc = divergence.spans(pa.array(["skipped", *texts]).slice(1))
    group = np.array([i % 3 for i in range(len(texts))])
    at, n, g, count, in_docs = divergence.counted_terms(data, start, length, doc, group)
    found = {(bytes(data[a : a + k]).decode(), int(b)): (int(c), int(d)) for a, k, b, c, d in zip(at, n, g, count, in_docs, strict=True)}
    assert len(found) == len(at)
    wanted = {}
    for i, t in enumerate(texts):
        for w, c in Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.replace("A", "a"))).items():
            a, b = wanted.get((w, i % 3), (0, 0))
            wanted[w, i % 3] = a + c, b + 1
    assert found == wanted


def test_radix_order_is_that_of_bytes():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 1 << 63, 500).astype(np.uint64) >> np.uint64(rng.integers(0, 60)) for _ in range(2)]
    words[0][::3] = words[0][0]
    assert divergence.radix_order(words).tolist() == np.lexsort(words[::-1]).tolist()


def test_shares_of_large_counts_are_exact(spark):
    df = spark.createDataFrame([(10**14, 3 * 10**15, 10**6)], "c long, n long, v long")
    assert df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (10**14 + 1) // (3 * 10**15 + 10**6)


# empty tables
def test_new_operators_on_empty_tables(spark, docs):
    empty = docs.limit(0)
    turns = spark.createDataFrame([], TURNS)
    for df in (minhash.near_duplicates(empty), minhash.keep_one_of_each(empty), divergence.source_divergence(empty), prefix_trie.prefix_trie(turns)):
        assert df.count() == 0
    nobody = spark.createDataFrame([(None, 0, "user", "x")], TURNS)
    assert prefix_trie.prefix_trie(nobody).count() == 0
    blank = spark.createDataFrame([(1, None, None, None), (2, "", "en", "b"), (3, " \n", "en", "a")], "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence.source_divergence(blank).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(blank).collect()} == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)}


# 9
def test_every_column_of_the_fingerprint_report(spark, docs):
    """Order by id (null first) and hash with the wrap from the last to the first, repeated rows as one, prints of edited texts, and neighbours."""
    found = simhash.fingerprint_report(docs).collect()
    order = [(r.k_id, r.k_a, r.k_b, r.text) for r in docs.select(*common.row_key(), F.coalesce("text", F.lit("")).alias("text")).distinct().collect()]
    order.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    edited = [t[: len(t) - len(t) // 2] + order[(i + 1) % len(order)][3][: len(t) // 2] for i, (*_, t) in enumerate(order)]
    texts = spark.createDataFrame([(i, side, t) for i in range(len(order)) for side, t in ((0, order[i][3]), (1, edited[i]))], "i int, side int, text string")
    prints = {(r.i, r.side): r.fp & (1 << 64) - 1 for r in simhash.fingerprints(texts, ["i", "side"], "text").collect()}
    own = sorted({prints[i, 0] for i in range(len(order))})
    near = {a: sum(a != b and (a ^ b).bit_count() <= 3 for b in own) for a in own}
    wanted = Counter()
    repeats = Counter((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    for i, (doc_id, _, _, t) in enumerate(order):
        a, e, n = prints[i, 0], prints[i, 1], prints[(i + 1) % len(order), 0]
        row = (doc_id, len(t), hashlib.sha256(edited[i].encode()).hexdigest(), f"{a:016x}", f"{e:016x}", 1 - (a ^ e).bit_count() / 64, 1 - (a ^ n).bit_count() / 64, near[a])
        wanted[row] += repeats[doc_id, t]
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.n_near) for r in found) == wanted


# 10
def test_network_equals_plain_loops(spark):
    rng = np.random.default_rng(2)
    filters = {w: rng.normal(0, 1, (w, 256, 3)).astype(np.float32) for w in langid.WIDTHS}
    net = langid.ByteNet(["a", "b"], filters, rng.normal(0, 1, (9, 2)).astype(np.float32), np.array([0.1, -0.2], np.float32))

    def plain(window):
        hidden = []
        for w, f in filters.items():
            for k in range(3):
                hidden.append(max(0.0, max(sum(float(f[i][window[p + i]][k]) for i in range(w)) for p in range(len(window) - w + 1))))
        z = [sum(h * float(net.out[i][c]) for i, h in enumerate(hidden)) + float(net.bias[c]) for c in range(2)]
        total = math.log(sum(math.exp(x - max(z)) for x in z)) + max(z)
        return [x - total for x in z]

    texts = ["short", "é" * 300, "abc " * 200]
    found = langid.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), net, ["i"]).orderBy("i").collect()
    for text, row in zip(texts, found, strict=True):
        raw = text.encode()
        raw += b" " * (-len(raw) % langid.WINDOW)
        windows = [raw[k : k + langid.WINDOW] for k in range(0, len(raw), langid.WINDOW)]
        wanted = [plain(x) for x in windows]
        assert np.allclose(langid.ByteNet(net.langs, filters, net.out, net.bias).prepare().log_probabilities(langid.windows_of(text)), wanted, atol=1e-3)
        mean = np.mean(wanted, axis=0)
        p = np.exp(mean - mean.max())
        assert row.lang_pred == net.langs[int(p.argmax())] and abs(row.score - p.max() / p.sum()) < 1e-3


# 6
def test_bins_are_near_the_least_number():
    """At the capacity of the contract, against the volume and against a plain best fit of the sorted pieces."""
    rng, cap = random.Random(12), 2048
    for weights in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (5, 2, 2), (1, 5, 1)):
        lengths = [min(cap, max(1, int({0: rng.expovariate(1 / 300), 1: rng.uniform(600, 1100), 2: rng.uniform(1, cap)}[rng.choices((0, 1, 2), weights)[0]]))) for _ in range(3000)]
        bins = packing.plan_bins(dict(Counter(lengths)), cap)
        n = sum(b.count for b in bins)
        rooms = []
        for x in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                rooms.append(cap - x)
        large = sum(2 * x > cap for x in lengths)
        assert n >= max(math.ceil(sum(lengths) / cap), large)
        assert n <= 1.02 * len(rooms) + 1
