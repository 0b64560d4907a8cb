"""Operators on one text at a time: licences, tokens, personal data, packing, toxicity."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from plotwise.llm import licences, packing, pii, tokens, toxicity
from plotwise.llm.registry import tokenizer
from tests.llm import fixtures as fx


def by_row(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_licences_match_a_scan(spark):
    got = by_row(licences.scan_licences(fx.docs(spark)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    want = Counter()
    for doc_id, text, *_ in fx.rows():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        found = [(i, label) for p, label in licences.BASE_PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        want[(doc_id, len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))] += 1
    assert got == want


def test_licence_index_adds_labels_and_keeps_base(spark):
    rows = licences.scan_licences(fx.docs(spark)).collect()
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    labels = {r["doc_id"]: r["labels"] for r in rows}
    ids = {t: i for i, t, *_ in fx.rows()}
    assert labels[ids["This work is licensed under the GNU General Public License, version 3."]] == "gpl-3"
    assert labels[ids["Released under the MIT License. Licensed under CC BY-NC 4.0."]] == "cc-by-nc,mit"


def test_token_counts_match_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    got = by_row(tokens.count_tokens(fx.docs(spark), tokenizer("piece_bpe_32k.model"), part_chars=300, batch_bytes=2000))
    want = Counter()
    for doc_id, text, *_ in fx.rows():
        n = len(sp.encode(text or ""))
        want[(doc_id, len((text or "").encode()), n, n > 4096)] += 1
    assert got == want


def test_token_counts_by_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = {(r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(fx.docs(spark), tokenizer("byte_bpe_50k.json")).collect()}
    assert got == {(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in fx.rows()}


def test_personal_data_matches_plain_expressions(spark):
    rng = random.Random(3)
    parts = ["a", "B7", "@", ".", "..", "-", "_", "+", "+1", " ", "(", ")", "12", "255", "256", "4539148803436467", "1.2.3.4", "x@y.z", "é", "\n", "😀", "%"]
    texts = [None, ""] + [t for _, t, *_ in fx.rows() if t] + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = ("email", "ip", "card", "phone")
    for r in pii.digest(frame).collect():
        spans = fx.base_spans(texts[r["doc_id"]])
        assert tuple(r[f"n_{k}"] for k in kinds) == tuple(sum(s[2] == k for s in spans) for k in kinds), texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest(), texts[r["doc_id"]]
        assert {f"{k}:{s}:{e}" for s, _, k, e in spans} <= set(r["spans"].split(","))


def test_personal_data_checksums_and_context(spark):
    text = "IBAN GB82 WEST 1234 5698 7654 32 here; ssn 123-45-6789; nothing 123-45-6780"
    frame = spark.createDataFrame([(1, text), (2, text.replace("82 WEST", "83 WEST").replace("ssn", "ref"))], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(frame).collect()}
    assert "iban:5:32" in spans[1] and "ssn:43:54" in spans[1]
    assert spans[2] == ""


def test_ibans_end_before_capital_or_digit_words(spark):
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"]
    rows = [(i, f"IBAN {iban}{tail}") for i, (iban, tail) in enumerate((b, t) for b in ibans for t in (" BIC COBADEFFXXX", " 2024", ".", ""))]
    spans = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in spans:
        found = [r["text"][s["start"] : s["end"]] for s in r["pii_spans"] if s["kind"] == "iban"]
        assert found == [ibans[r["doc_id"] // 4]]


def test_redaction_keeps_other_columns_and_text(spark):
    docs = fx.docs(spark)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    clean = {r["doc_id"]: r["text"] for r in out.collect()}
    for doc_id, text, *_ in fx.rows():
        if not fx.base_spans(text) and "IBAN" not in (text or ""):
            assert clean[doc_id] == text
    assert "c-d.org" not in clean[[i for i, t, *_ in fx.rows() if t and "c-d.org" in t][0]]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    docs = fx.docs(spark).repartition(2)
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json")).collect()
    want = Counter()
    for doc_id, text, *_ in fx.rows():
        want[doc_id] += 1
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x, *_ in fx.rows()}
    covered = Counter()
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        covered.update((r["doc_id"], i) for i in range(r["start"], r["start"] + r["length"]))
    assert covered == Counter({(d, i): want[d] for d in ids for i in range(len(ids[d]))})
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    encoder = packing.WordEncoder(tokenizer("byte_bpe_50k.json"), most_bytes=10_000)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "foo", ".", "'s", "\xa0", "　", "\x1c", "é", "日本", "😀", "<|endoftext|>", "1", "!?", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(seed):
    """Against dynamic programming over all pairs of cuts."""
    rng = np.random.default_rng(seed)
    ends = np.cumsum(rng.integers(1, 9, 60))
    fine = rng.choice([0.0, 2.0], 60)
    size = 32
    cuts = packing.choose_cuts(ends, fine, size, final=False, overhead=1.0, least_power=4)
    place, cost = [0, *ends.tolist()], [0.0]
    for j in range(1, 61):
        options = []
        for i in range(j):
            n = place[j] - place[i]
            if n <= size:
                options.append(cost[i] + (0 if n & (n - 1) == 0 and n >= 4 else size - n) + fine[j - 1] + 1.0)
        cost.append(min(options))

    def price(cuts):
        total, start = 0.0, 0
        for c in cuts:
            n = c - start
            total += (0 if n & (n - 1) == 0 and n >= 4 else size - n) + fine[list(ends).index(c)] + 1.0
            start = c
        return total

    assert price(cuts) == pytest.approx(cost[place.index(cuts[-1])])


def test_long_stretches_and_tails():
    assert packing.choose_cuts(np.array([5000]), np.array([0.0]), 2048, final=True)[-1] == 5000
    cuts = packing.choose_cuts(np.array([5000]), np.array([0.0]), 2048, final=True)
    assert max(np.diff([0, *cuts])) <= 2048
    assert packing.tail_lengths(1024, 2048, 16.0) == (0.0, [1024])
    assert packing.tail_lengths(2040, 2048, 16.0)[1] == [2040]


def test_toxicity_learns_without_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[10:10] = ["vilescum", "hatefool"]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic if zlib.crc32(str(i).encode()) % 5 else 1 - toxic))  # held-out labels are wrong
    frame = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    out = toxicity.classify(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == 402
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] < 900:
            assert r["predicted"] == int(r["doc_id"] % 4 == 0)
        else:
            assert r["predicted"] == 0


def test_toxicity_leaves_long_clean_texts_alone():
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(n))
    pairs = [(prose(100) + (" vilescum hatefool " if i % 4 == 0 else " ") + prose(50), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.fit(pairs, 12)  # far fewer buckets than n-grams in a text
    for words in (100, 1000, 10_000):
        assert toxicity.logit(prose(words), *model) < 0
    assert toxicity.logit(prose(100) + " vilescum hatefool " + prose(50), *model) > 0


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.classify(fx.docs(spark), labels).collect()} <= {0, 1}
    assert toxicity.classify(fx.none(spark), labels).count() == 0


def test_empty_tables(spark):
    none = fx.none(spark)
    assert licences.scan_licences(none).count() == 0
    assert tokens.count_tokens(none, tokenizer("piece_bpe_32k.model")).count() == 0
    assert pii.digest(none).count() == 0
    assert pii.redact(none).count() == 0
    assert packing.pack(none, tokenizer("byte_bpe_50k.json")).count() == 0


def dense(n):
    """A text of n e-mail addresses, addresses and phone numbers, some of which overlap."""
    return " ".join(f"a{i}@b.example 10.0.{i % 256}.1 +49 30 12345{i % 90 + 10} tel 555-123-{i % 9000 + 1000:04d}" for i in range(n))


def test_personal_data_in_a_span_dense_text(spark):
    text = dense(4000)  # 250 KB, 16,000 spans: quadratic work would take minutes
    begun = time.time()
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    clean = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]["text"]
    assert time.time() - begun < 120
    base = [(s["start"], s["kind"], s["end"]) for s in row["pii_spans"] if s["kind"] in ("email", "ip", "card", "phone")]
    assert base == [(a, k, z) for a, _, k, z in fx.base_spans(text)]
    want, done = [], 0
    for s in row["pii_spans"]:
        if s["start"] >= done:
            want += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    assert clean == "".join(want) + text[done:]


def test_redaction_crosses_pages(spark):
    rows = [(i, "é😀" * (2040 + i) + " x@y.example " + "ab" * 5000 + " 10.0.0.1") for i in range(12)]
    for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["text"] == rows[r["doc_id"]][1].replace("x@y.example", "[EMAIL]").replace("10.0.0.1", "[IP]")


def test_very_long_texts(spark):
    """A few MB of one character, of line feeds, of words and of letters without spaces."""
    long = ["z" * 2_000_000, "\n" * 1_500_000, "word " * 400_000, "日本" * 300_000, "мир и труд " * 100_000]
    frame = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(4, "doc_id")
    assert {r["doc_id"]: r["n_words"] for r in licences.scan_licences(frame).collect()} == {0: 1, 1: 0, 2: 400_000, 3: 1, 4: 300_000}
    assert {r["doc_id"]: r["n_bytes"] for r in tokens.count_tokens(frame, tokenizer("piece_bpe_32k.model")).collect()} == {i: len(t.encode()) for i, t in enumerate(long)}
    pieces = packing.pack(frame, tokenizer("byte_bpe_50k.json")).collect()
    for i in range(len(long)):
        own = sorted((p["start"], p["length"], p["doc_tokens"]) for p in pieces if p["doc_id"] == i)
        assert [s for s, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]
    assert {r["predicted"] for r in toxicity.score(frame, np.array([5], np.uint64), np.array([1.0]), -1.0).collect()} == {0}


def test_character_grams_count_characters():
    for text in ("日本語", "a", "", "straße", "x" * 10):
        whole = f" {text.lower()} "
        assert sum(len(w) for w in toxicity.windows_of(text)) == sum(len({whole[i : i + n] for i in range(len(whole) - n + 1)}) for n in toxicity.ORDERS)
    text = "".join(random.Random(3).choices("abc", k=toxicity.WINDOW + 50))
    first = {text[i : i + 6] for i in range(len(text) - 5)}
    assert len(first) == 3**6 and all(len(w) <= 3**3 + 3**4 + 3**5 + 3**6 + 8 for w in toxicity.windows_of(text))


def test_naive_bayes_ratios_and_fit_against_a_plain_one():
    """The weights of a few features against counts and a plain gradient descent over dense rows."""
    rng = random.Random(6)
    pairs = [(" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=12)) + (" poison" if i % 3 == 0 or i % 17 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    keys, weights, bias = toxicity.fit(pairs, 16)
    sets = [set().union(*(set(w.tolist()) for w in toxicity.windows_of(t))) for t, _ in pairs]
    y, base = np.array([label for _, label in pairs]), np.mean([label for _, label in pairs])
    every = sorted(set().union(*sets))
    x = np.array([[k in s for k in every] for s in sets], float)
    n = x.sum(0)
    z = np.where(n >= 3, np.abs(x[y == 1].sum(0) - n * base) / np.sqrt(n * base * (1 - base)), 0)
    x = x[:, z >= 6]
    assert keys.tolist() == [k for k, own in zip(every, z, strict=True) if own >= 6]
    ratio = np.log((x[y == 1].sum(0) + 1) / (y.sum() + 2)) - np.log((x[y == 0].sum(0) + 1) / ((1 - y).sum() + 2))
    f = x * ratio / np.sqrt([len(s) for s in sets])[:, None]
    f /= np.sqrt((f**2).sum(1).mean())
    v, b, sv, sb = np.ones(f.shape[1]), 0.0, 0.0, 0.0
    for _ in range(80):
        e = np.where(y > 0, 0.5 / base, 0.5 / (1 - base)) * (1 / (1 + np.exp(-(f @ v + b))) - y) / len(y)
        sv, sb = 0.9 * sv - (f.T @ e + 1e-5 * v), 0.9 * sb - e.sum()
        v, b = v + sv, b + sb
    for t, row in zip((t for t, _ in pairs), f @ v + b, strict=True):
        assert abs(toxicity.logit(t, keys, weights, bias) - row) < 1e-6
