"""Operators on the whole corpus: quality, mixing, near-duplicates, repeated passages, embeddings, and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import xxhash

from plotwise.llm import components as components_module
from plotwise.llm import embeddings, mixing, quality, repeats, simhash, similar
from plotwise.llm.common import held
from plotwise.llm.components import components
from plotwise.llm.suffixes import PrefixFreeParse
from tests.llm import fixtures as fx


def grouped(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
    return [root(i) for i in range(n)]


def smallest(ids, groups):
    best = {}
    for i, g in zip(ids, groups, strict=True):
        best[g] = min(best.get(g, i), i)
    return [best[g] for g in groups]


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_all_pairs(spark):
    rows = fx.rows()
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    ids = [r[0] for r in rows]
    want = Counter(zip(ids, (f"{p:016x}" for p in prints), smallest(ids, grouped(len(rows), edges)), strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(fx.docs(spark)).collect()) == want


def test_near_pairs_find_every_pair_once(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base:
        for _ in range(6):
            values.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = Counter((min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    for heavy in (4096, 3):  # also with every cell split in blocks
        assert Counter((r["a"], r["b"]) for r in simhash.near_pairs(frame, heavy=heavy, blocks=3).collect()) == want


def test_components_on_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in range(100, 140)) and len(found) == 101
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    forest = [(i, i // 3) for i in range(1, 200)] + [(500 + i, 500) for i in range(1, 50)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(forest, "a long, b long").repartition(7), forest=True).collect()}
    assert found == {i: 0 for i in range(200)} | {500 + i: 500 for i in range(50)}


def test_held_keeps_few_rows_and_refuses_more(spark):
    rows = spark.range(5).selectExpr("id", "cast(null as string) as name", "array(id / 3.0D) as v")
    kept = held(rows, 5)
    assert kept.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))
    assert held(rows, 4) is None
    assert held(rows.limit(0), 0).count() == 0


def test_keep_one_keeps_columns_and_one_of_each(spark):
    docs = fx.docs(spark)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    heads = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(kept) == sorted(heads)


def plain_similarity(a, b):
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if any(sets) else 1.0


def near_copies():
    """Texts with copies that differ in some words, above and below a similarity of 0.8, and chains of them."""
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    out = []
    for changes in (1, 2, 3, 4, 5, 6, 8) * 3:
        base = words(200)
        out.append(" ".join(base))
        for _ in range(4):
            for at in rng.sample(range(200), changes):
                base[at] = "changed"
            out.append(" ".join(base))
    return out


def test_stage_joins_near_copies_by_similarity(spark, sf):
    import corpus_pipeline as cp

    texts = near_copies()
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if plain_similarity(texts[i], texts[j]) >= 0.8]
    assert 20 < len(edges)
    want = set(smallest(list(range(len(texts))), grouped(len(texts), edges)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")
    got = [r["doc_id"] for r in cp.near_duplicates(spark, frame, sf).collect()]
    assert sorted(got) == sorted(want)


def test_linker_matches_all_pairs():
    texts = near_copies()
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if plain_similarity(texts[i], texts[j]) >= 0.8]
    linker = similar.Linker(0.8)
    for t in texts:
        found = similar.shingle_set(t)
        linker.add(found, similar.bands(found).tolist())
    assert smallest(list(range(len(texts))), [linker.root(i) for i in range(len(texts))]) == smallest(list(range(len(texts))), grouped(len(texts), edges))


def test_stage_keeps_rows_without_or_with_repeated_ids(spark, sf):
    import corpus_pipeline as cp

    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    rows = [(None, a), (None, b), (None, b), (1, c), (2, d), (2, c), (3, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (cp.near_duplicates(spark, frame, sf), simhash.keep_one(frame)):
        assert Counter(tuple(r) for r in out.collect()) == Counter([(None, a), (None, b), (1, c), (2, d), (3, None)])


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts_and_base_rule(spark):
    rows = quality.judge(fx.docs(spark)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    want = Counter()
    for doc_id, text, *_ in fx.rows():
        c = plain_counts(text)
        want[(doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_quality_rejects_outliers_only(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        centre = 0.0 if i % 2 else 5.0
        values = rng.normal(centre, 1.0, 2).tolist()
        if i >= 570:
            values = [v + 40 for v in values]
        rows.append((i, "en", f"s{i % 2}", *values))
    frame = spark.createDataFrame(rows, "row_id long, lang string, source string, x double, y double")
    bad = {r["row_id"] for r in quality.outliers(frame, {"x": 0.1, "y": 0.1}, z=6.0).collect()}
    assert bad == set(range(570, 600))
    assert quality.outliers(frame.limit(0), {"x": 0.1, "y": 0.1}).count() == 0


def test_mcd_agrees_with_numpy(spark):
    """One group's centre and scatter against the same steps over a plain array."""
    rng = np.random.default_rng(1)
    x = rng.multivariate_normal([1, -2], [[2, 0.8], [0.8, 1]], 400)
    x[:60] += 15
    frame = spark.createDataFrame([(i, "en", "s", *map(float, v)) for i, v in enumerate(x)], "row_id long, lang string, source string, x double, y double")
    bad = {r["row_id"] for r in quality.outliers(frame, {"x": 0.01, "y": 0.01}, z=5.0).collect()}
    h = x[60:]
    d = np.einsum("ij,jk,ik->i", h - h.mean(0), np.linalg.inv(np.cov(h.T)), h - h.mean(0))
    assert set(range(60)) <= bad and len(bad) <= 60 + (d > 18).sum() + 3


def plain_mcd(x, share=0.75, z=10.0, floors=None, tries=40):
    """A plain estimate of one group: many random starts over exact order statistics, the least determinant, reweighted."""
    n, p = x.shape
    floors = np.diag(np.square(floors))
    h, rng, best = math.ceil(n * share), np.random.default_rng(0), None
    for _ in range(tries):
        pick = rng.choice(n, p + 1, replace=False)
        mean, cov = x[pick].mean(0), np.cov(x[pick].T, bias=True) + floors
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = x[np.argsort(d)[:h]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) + floors
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], mean, cov
    for level in (1.96, z):
        d = np.einsum("ij,jk,ik->i", x - best[1], np.linalg.inv(best[2]), x - best[1])
        d /= max(1.0, np.median(d) / quality._quantile(p, 0.0))
        inside = d <= quality._quantile(p, level)
        best = None, x[inside].mean(0), np.cov(x[inside].T, bias=True) + floors
    return d


def test_quality_verdicts_agree_with_an_independent_estimate_on_documents(spark, sf):
    docs = spark.read.parquet(sf + "/documents.parquet")
    stats = quality.statistics(docs).where("not base_failed").toPandas()
    far = {r["doc_id"]: r["distance"] for r in quality.judge(docs).where("distance is not null").collect()}
    names, floors = list(quality.FEATURES), list(quality.FEATURES.values())
    big = stats.groupby(["lang", "source"]).doc_id.transform("size") >= 100
    wide = stats.groupby("lang").doc_id.transform("size") >= 100
    key = np.where(big, stats.lang + "/" + stats.source, np.where(wide, stats.lang, ""))
    limit = quality._quantile(len(names), 10.0)
    for _, rows in stats.groupby(key):
        d = plain_mcd(rows[names].to_numpy(), floors=floors)
        for doc_id, own in zip(rows.doc_id, d, strict=True):  # bins of 1/64 may move the estimate a little
            assert (doc_id in far) == (own > limit) or 0.75 * limit < own < 1.35 * limit


def test_keep_good_keeps_columns(spark):
    docs = fx.docs(spark)
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    kept = Counter(r["doc_id"] for r in quality.judge(docs).where("kept").collect())
    assert Counter(r["doc_id"] for r in out.collect()) == kept
    assert quality.keep_good(fx.none(spark)).count() == 0


def plain_number(rate, doc_id, seed=42):
    u = int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing_inverts_the_poisson_distribution(spark):
    docs = fx.docs(spark)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "mix_copy", "mix_key"]
    counts = Counter(r[3] or "" for r in fx.rows())
    total = sum(math.sqrt(n) for n in counts.values())
    want = Counter()
    for doc_id, _, _, source, *_ in fx.rows():
        n = counts[source or ""]
        for k in range(plain_number(len(fx.rows()) / total * math.sqrt(n) / n, doc_id)):
            want[(doc_id, k + 1)] += 1
    rows = out.collect()
    assert Counter((r["doc_id"], r["mix_copy"]) for r in rows) == want
    keys = [r["mix_key"] for r in rows]
    assert keys == sorted(keys)  # partitions are ranges, in order


def test_mixing_weights_rates_and_sizes(spark):
    docs = spark.createDataFrame([(i, "t", "a" if i % 10 else "b") for i in range(4000)], "doc_id long, text string, source string")
    out = Counter(r["source"] for r in mixing.mix(docs, weights={"a": 1.0, "b": 3.0}).collect())
    assert abs(out["a"] - 1000) < 120 and abs(out["b"] - 3000) < 220
    assert mixing.mix(docs, weights={"a": 1.0}).where("source = 'b'").count() == 0
    big = mixing.mix(docs.limit(3), weights={"a": 1.0, "b": 1.0}, size=1000.0).count()  # rates far beyond what exp() underflows at
    assert abs(big - 3000) < 300
    wide = mixing.mix(docs, most_broadcast=0)
    assert Counter(map(tuple, wide.collect())) == Counter(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def plain_repeats(rows, length=50):
    first, out = {}, Counter()
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        b = text.encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], doc_id)
    for doc_id, text in rows:
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < doc_id:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        spans = int(((np.diff(np.concatenate(([0], gone.astype(int))))) == 1).sum())
        out[(doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeats_match_brute_force(spark):
    got = Counter(tuple(r) for r in repeats.remove_repeats(fx.docs(spark)).drop("kept").collect())
    assert got == plain_repeats([(i, t or "") for i, t, *_ in fx.rows()])


def test_repeats_with_crowded_triggers(spark):
    """Periodic texts and one passage with a different neighbour in every document, in several partitions."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdef", k=12))
    rows = []
    for i in range(150):
        rows.append((i, word() + "the same passage of just over twenty-five bytes" + word() + "ab" * rng.randint(20, 60) + word()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for gram in (20, 8):
        got = Counter(tuple(r) for r in repeats.remove_repeats(frame, gram=gram).drop("kept").collect())
        assert got == plain_repeats(rows)


def test_triggers_of_one_document_alone_go_no_further():
    rng = np.random.default_rng(0)
    t, flag = rng.integers(0, 200, 100).astype(np.uint64), (rng.integers(0, 30, 100) == 1).astype(np.uint8)
    code = repeats.settle(t, flag)
    for i in range(100):
        mine = t == t[i]
        assert code[i] == (repeats.SHARED if flag[mine].any() or mine.sum() > 1 else repeats.UNIQUE)
    assert set(repeats.settle(np.ones(5, np.uint64), np.zeros(5, np.uint8), most=4)) == {repeats.CROWDED}


def test_prefix_free_parsing_orders_all_suffixes():
    rng = random.Random(1)
    for trial in range(60):
        alphabet = b"ab\x00\xff" if trial % 2 else b"abcdef"
        base = bytes(rng.choices(alphabet, k=200))
        strings = [base[(a := rng.randint(0, 150)) : a + rng.randint(0, 120)] + bytes(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 12))]
        p = PrefixFreeParse(strings, modulus=rng.choice([2, 5, 24]))
        places = np.concatenate([np.zeros(0, np.int64), *(s + np.arange(n) for s, n in zip(p.starts.tolist(), p.lengths.tolist(), strict=True))]).astype(np.int64)
        suffixes = [p.symbols[i:].tolist() for i in (p.order(places).tolist() if len(places) else [])]
        assert suffixes == sorted(suffixes)
        for length in (8, 11, 50):
            string, inner, number = (p if trial % 3 else PrefixFreeParse(strings, depth=length)).windows(length)
            seen = {}
            for s, i, c in zip(string.tolist(), inner.tolist(), number.tolist(), strict=True):
                assert seen.setdefault(strings[s][i : i + length], c) == c
            assert len(set(seen.values())) == len(seen) and len(string) == sum(max(0, len(x) - length + 1) for x in strings)


def test_repeats_across_null_largest_and_repeated_ids(spark):
    a, b = ("".join(random.Random(k).choices("abcdefgh", k=200)) for k in (1, 2))
    rows = [(None, a), (2**63 - 1, a), (-(2**63), b), (3, b + a), (3, a), (None, b), (4, None)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(None, 200, 200), (2**63 - 1, 200, 200), (-(2**63), 200, 0), (3, 400, 200), (3, 200, 0), (None, 200, 200), (4, 0, 0)])


def test_packed_integers_round_trip():
    for values in ([], [5], [-7, 2**62, 0], [2**63 - 1, 2**63 - 3], [-(2**63), 2**63 - 1]):
        a = np.array(values, np.int64)
        assert repeats.unpack(repeats.pack(a), np.int64).tolist() == values
    u = np.sort(np.random.default_rng(0).integers(0, 2**63, 100).astype(np.uint64))
    assert (repeats.unpack_sorted(repeats.pack_sorted(u)) == u).all()


def test_embeddings_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    vectors = [(centres[i % 6] + rng.normal(scale=0.15, size=8)).tolist() for i in range(60)] + rng.normal(size=(30, 8)).tolist()
    vectors += [vectors[0], vectors[0], None, [], [0.0] * 8, [1.0] * 7, [float("nan")] * 8, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(vectors[i]) / np.linalg.norm(vectors[i]) for i in good}
    edges = [(i, j) for i in good for j in good if j < i and unit[i] @ unit[j] >= 0.9]
    degree = Counter(x for e in edges for x in e)
    heads = smallest(range(len(rows)), grouped(len(rows), edges))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, head string")
    for block in (4096, 7):
        got = {tuple(r) for r in embeddings.near_duplicates(frame, block=block).collect()}
        assert got == {(i, degree[i], heads[i], heads[i] == i) for i in range(len(rows))}
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0
    assert embeddings.near_duplicates(frame.where("vec_id = 94")).collect()[0]["kept"]


def test_embeddings_of_every_length_link(spark):
    rows = [(i, [1.0, 0.01 * i] if i % 3 else [0.0, 1.0, 0.01 * i]) for i in range(12)] + [(12, [5.0]), (13, None), (14, [0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = {i: (7, 1) if i % 3 else (3, 0) for i in range(12)} | {i: (0, i) for i in (12, 13, 14)}
    assert got == want


def test_ego_join_skips_only_what_is_apart():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = v[np.lexsort(np.floor(v[:, :2] / 0.4472).T[::-1])]
    block = embeddings.Block(np.arange(300), np.ones(300, int), v, np.eye(6)[:, :2])
    joiner = embeddings.Joiner(0.9, leaf=16)
    joiner.join(block, block, True)
    linked = v @ v.T >= 0.9
    np.fill_diagonal(linked, False)
    assert {i: int(n) for i, n in enumerate(linked.sum(1)) if n} == joiner.degree


def test_pipeline_runs_stage_by_stage(spark, sf):
    import corpus_pipeline as cp

    assert [name for name, _ in cp.STAGES] == ["quality rules", "simhash near-dedup", "personal data", "source mix", "packing"]
    docs = fx.docs(spark)
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = out.collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    for _, stage in cp.STAGES:
        assert stage(spark, fx.none(spark), sf).count() == 0


def test_pipeline_over_a_table(spark, sf):
    import corpus_pipeline as cp

    rows = cp.run(spark, sf).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_registered_queries(spark, sf):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)} | {"pipeline"}
    assert set(entry.oracle_sql()) <= names


def test_near_copies_in_blocks_lose_no_link(spark):
    texts = near_copies()
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if plain_similarity(texts[i], texts[j]) >= 0.8]
    want = sorted(set(smallest(list(range(len(texts))), grouped(len(texts), edges))))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")
    assert sorted(r["doc_id"] for r in similar.keep_one(frame, most=2).collect()) == want


def test_filters_keep_every_column_and_clean_rows(spark):
    """Stages that pass columns on: names of their own, dots, null and repeated ids with other texts."""
    docs = fx.docs(spark)
    sound = " ".join(f"word{i} stands" for i in range(60))
    rows = [(None, sound, "en"), (None, sound + " more", "de"), (7, sound, "en"), (7, sound + " other", None)]
    for frame in (docs, spark.createDataFrame([(*r, *("c",) * len(fx.CLASHING)) for r in rows], ["doc_id", "text", "lang", *fx.CLASHING]).withColumnRenamed("node", "source")):
        for run in (quality.keep_good, similar.keep_one, simhash.keep_one, mixing.remix):
            out = run(frame)
            assert out.columns == frame.columns
            for r in out.collect():
                assert all(r[c] == "c" for c in fx.CLASHING if c in frame.columns)


def test_quality_verdicts_do_not_depend_on_how_estimates_travel(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few, many = (sorted((r.doc_id, r.kept) for r in quality.judge(docs, **o).collect()) for o in ({}, {"most_broadcast": 0}))
    assert few == many and not all(k for _, k in few)


def test_near_copies_come_from_simhash_too(spark):
    prints = [0, 1, 0b111, 1 << 40, (1 << 40) | (1 << 50), -1, 0x0F0F0F0F0F0F0F0F]
    cell = {r["fp"]: r["cell"] for r in similar.simhash_cells(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert set(cell) == set(prints)
    assert cell[0] == cell[1] == cell[0b111] == cell[1 << 40] == cell[(1 << 40) | (1 << 50)]
    assert len(set(cell.values())) == 3


def test_steps_of_the_quality_estimate_shuffle_counts_only(spark, sf):
    """By bin only counts travel, moments by key and start."""
    import pytest
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(str(i % 3), 0, i % 16, float(i), float(i * i % 7)) for i in range(300)], "key string, start int, salt int, a double, b double")
    floors, distance = [0.1, 0.1], F.col("a") + 0.5
    got = {few: {r["key"]: r for r in quality._step(rows, distance, 0.75, ["a", "b"], floors, few).collect()} for few in (True, False)}
    plan = quality._step(rows, distance, 0.75, ["a", "b"], floors, True)._jdf.queryExecution().optimizedPlan().toString()
    assert all("sum" not in line for line in plan.splitlines() if "Aggregate [key" in line and "bin" in line.split("]")[0])
    for key in "012":
        a = np.array([float(i) for i in range(300) if str(i % 3) == key])
        bins = np.floor(64 * np.log(a + 0.5 + 1e-9))
        inside = a[bins <= np.sort(bins)[int(np.ceil(0.75 * len(a))) - 1]]
        assert got[True][key]["mean"][0] == pytest.approx(inside.mean()) and got[False][key]["mean"] == pytest.approx(got[True][key]["mean"])


def test_equal_strings_are_parsed_once(monkeypatch):
    parsed = []

    class Counted(PrefixFreeParse):
        def __init__(self, strings, **options):
            parsed.append(len(strings))
            super().__init__(strings, **options)

    monkeypatch.setattr(repeats, "PrefixFreeParse", Counted)
    rng = np.random.default_rng(5)
    kinds = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (3, 8, 8, 9, 14, 20)]
    for _ in range(20):
        pick, doc = rng.integers(0, 6, 15), rng.integers(0, 6, 15)
        strings, want, least = [kinds[i] for i in pick], [], {}
        for s, d in zip(strings, doc.tolist(), strict=True):
            for i in range(len(s) - 7):
                least[s[i : i + 8]] = min(d, least.get(s[i : i + 8], d))
        for s, d in zip(strings, doc.tolist(), strict=True):
            want += [d > least[s[i : i + 8]] for i in range(len(s) - 7)]
        assert repeats.repeated_windows(strings, doc, 8).tolist() == want
        assert parsed[-1] == len(set(strings))


def test_quality_steps_read_keyed_rows_without_joining_them_again(spark, monkeypatch):
    plans, step = [], quality._with

    def watched(rows, *others, **options):
        plans.append(rows._jdf.queryExecution().analyzed().toString())
        return step(rows, *others, **options)

    monkeypatch.setattr(quality, "_with", watched)
    rng = np.random.default_rng(6)
    rows = [(i, f"l{i % 2}", "s", *map(float, rng.normal(size=2) + (30 if i == 17 else 0))) for i in range(400)]
    frame = spark.createDataFrame(rows, "row_id long, lang string, source string, a double, b double").repartition(40)
    far = quality.outliers(frame, {"a": 0.1, "b": 0.1})
    assert [r["row_id"] for r in far.collect()] == [17]
    assert plans and not any("lang" in p for p in plans)


def test_few_edges_are_merged_by_one_task_without_star_rounds(spark, monkeypatch):
    rounds, join = [], components_module._with_least

    def counted(*args):
        rounds.append(1)
        return join(*args)

    monkeypatch.setattr(components_module, "_with_least", counted)
    edges = [(i, j) for i in range(40) for j in range(i)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = {i: 0 for i in range(40)} | {i: 100 for i in range(100, 161)}
    got = lambda **o: sorted((r["node"], r["component"]) for r in components(frame, **o).collect())
    assert got() == sorted(want.items()) and not rounds
    assert got(most_alone=99) == sorted(want.items()) and rounds  # 39 and 60 edges are the least that rounds can leave
    until = len(rounds)
    assert got(most_alone=0) == sorted(want.items()) and len(rounds) > 2 * until


def test_falls_of_few_determinants_need_no_job(spark):
    old, new = (spark.createDataFrame(rows, "key string, logdet double") for rows in ([("a", 3.0), ("b", 1.0), ("c", 9.0)], [("a", 1.0), ("b", 0.5)]))
    held_old, held_new = held(old, 5), held(new, 5)
    context = spark.sparkContext
    context.setJobGroup("falls", "")
    try:
        assert quality._fall(held_old, held_new, True) == 2.0
        assert not context.statusTracker().getJobIdsForGroup("falls")
        assert quality._fall(old, new, False) == 2.0
        assert context.statusTracker().getJobIdsForGroup("falls")
        assert quality._fall(held_old, held(new.limit(0), 5), True) is None
    finally:
        context._jsc.clearJobGroup()
