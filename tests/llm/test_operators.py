"""Each operator against plain code, and on the rows that break careless ones."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from strataloom.llm import byte_bpe, components, fingerprints, labelled, near_dedup, packing, quality_fm, quality_rules, shared, token_counts, token_files, tokens, toxicity, url_filter

BYTE, WORD, RANKS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, part int, n int, ids string, keys string, band int, score double, held_out int, words string, tail int, start int, kept string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def odd_texts():
    rnd = random.Random(5)
    long_ = " ".join(rnd.choice(["alpha", "beta", "Gamma,", "délta.\n", "x1", "don't"]) for _ in range(30_000))
    base = [f"w{rnd.randrange(10_000)}" for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    return [None, "", " \n\t ", "one", "One", "three little words", "a b c d e", "A B C D E f", " ".join(base), " ".join(base), " ".join(near), "  double  spaced \n\n text ", "émile ça Σας ΑΣ. \u3000wide\u00a0space", long_, "<|endoftext|> <|startoftext|>", "mark \x00 here", "\U0001f600 " * 50, "x" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    rows += [(8, rows[8][1]), (None, "no id at all"), (None, None), (-5, "negative id"), (2**53 + 1, "large id"), (2**53 + 2, "large id too")]
    return spark.createDataFrame([(i, t, *["x", 1, 2, "y", "z", 3, 0.5, 4, "w", 5, 6, "k"]) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def rows_of(df):
    return sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def plain_tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


# tokens


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_parts_encode_like_whole_texts(path):
    rnd, alphabet = random.Random(1), list(" \n\t  \u00a0\u2003\u3000aAbé'sΣσ1２,.!$<|>中ｱ") + ["'ll", "’", "\u0308", "\x1c", "\x85", "\x00", "\U0001f600", "<|endoftext|>", "İ", "ß", " a", " b", " é"]
    texts = [t or "" for t in odd_texts()] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(5000)]
    ids, at = tokens.PartEncoder(path).encode(texts)
    t = plain_tokenizer(path)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgetting_keeps_results(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 50)
    e, t, rnd = tokens.PartEncoder(BYTE), plain_tokenizer(BYTE), random.Random(2)
    for _ in range(20):
        texts = [" ".join(f"w{rnd.randrange(200)}" for _ in range(20)) for _ in range(3)]
        ids, at = e.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_parts_that_share_a_hash():
    e, texts = tokens.PartEncoder(WORD), ["some words here", "", "and more, of them"]
    ids, at = e.encode(texts)
    e.second = e.second + np.uint64(1)  # as if other parts had been stored under these hashes
    again, places = e.encode(texts)
    assert ids.tolist() == again.tolist() and at.tolist() == places.tolist()


# 1


def test_packing(odd, none):
    got = packing.pack(odd, BYTE, width=128).collect()
    t = plain_tokenizer(BYTE)
    want = Counter()
    for doc, text in rows_of(odd):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        want[doc, len(ids), zlib.crc32(ids)] += 1
    assert sum(r.length for r in got) == sum(n * k for (_, n, _), k in want.items())
    by_window = defaultdict(list)
    for r in got:
        by_window[r.sequence_id].append((r.offset, r.length))
    for k, pieces in by_window.items():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 128 or k == max(by_window)
    whole = Counter((r.doc_id, r.length, r.ids_crc32) for r in got if r.length == r.doc_tokens)
    assert not whole - want
    starts = Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert starts == Counter({(d, n): sum(v for (a, b, _), v in want.items() if (a, b) == (d, n)) for d, n, _ in want})
    assert packing.pack(none, BYTE).count() == 0


def test_packing_returns_ids_and_padded_sequences(odd, none):
    stored = packing.sequences(odd, BYTE, width=128, pad_id=70_000)
    rows = sorted(stored.collect(), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in rows] == list(range(len(rows)))
    ids = {r.sequence_id: np.frombuffer(r.ids, dtype="<u4") for r in rows}
    assert {len(x) for x in ids.values()} == {128} and [r.n for r in rows[:-1]] == [128] * (len(rows) - 1)
    assert 0 < rows[-1].n < 128 and set(ids[rows[-1].sequence_id][rows[-1].n :].tolist()) == {70_000}
    stream = np.concatenate([ids[r.sequence_id][: r.n] for r in rows]).tolist()
    pieces = sorted(packing.pieces_of(stored).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert np.frombuffer(b"".join(r.ids for r in pieces), dtype="<u4").tolist() == stream
    docs, t = [], plain_tokenizer(BYTE)
    for r in pieces:
        if r.start == 0:
            docs.append((r.doc_id, []))
        docs[-1][1].extend(np.frombuffer(r.ids, dtype="<u4").tolist())
    want = [(d, [*t.encode(text, add_special_tokens=False).ids, 1]) for d, text in rows_of(odd)]
    assert sorted(docs, key=repr) == sorted(want, key=repr)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in packing.pack(odd, BYTE, width=128).collect())
    assert packing.sequences(none, BYTE).count() == 0


# 2


def plain_counts(text):
    w = WORDS.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, none, small):
    extra = spark.createDataFrame([(100, "a b c a b c\nx\nx\n\nx"), (101, "same same same same"), (102, "#" * 10 + " <tag>"), (103, "a\x0bb\x0cc\x1cd"), (104, "..." + "\n- x" * 5)], "doc_id long, text string")
    for df in (odd, extra, shared.table(spark, small, "documents")):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(df).collect())
        assert got == Counter((d, *plain_counts(t)) for d, t in rows_of(df))
    for r in quality_rules.judge(odd).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.failed == "")
    assert quality_rules.judge(none).count() == 0


@pytest.mark.parametrize("bits", [62, 3, 61])
def test_repeated_windows_whatever_the_hashes(spark, monkeypatch, bits):
    """With hardly a bit of hash left, or of places, the windows themselves are compared."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", bits)
    monkeypatch.setattr(quality_rules, "PLACE", 1 << bits)
    rnd = random.Random(bits)
    rows = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(60)))) for i in range(60)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain_counts(t)[4] for i, t in rows}


def test_quality_rules_keep_clean_texts(spark, middle):
    labels = {r.doc_id: r.quality for r in shared.table(spark, middle, "labels").collect()}
    rows = [r for r in quality_rules.judge(shared.table(spark, middle, "documents")).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept == bool(labels[r.doc_id]) for r in rows)


# 3 and 4


@pytest.mark.parametrize(("module", "target", "modulus", "remainder"), [(quality_fm, "quality", 4, 2), (toxicity, "toxic", 3, 1)])
def test_classifiers(spark, odd, none, middle, module, target, modulus, remainder):
    docs, labels = shared.table(spark, middle, "documents"), shared.table(spark, middle, "labels")
    model = module.train(docs, labels)
    truth = {r.doc_id: r[target] for r in labels.collect()}
    got = module.score(docs, model).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.93 * len(held)
    again = {r.doc_id: r.score for r in module.score(docs, module.train(docs, labels)).collect()}
    assert all(again[r.doc_id] == r.score for r in got)
    assert module.score(odd, model).count() == odd.count() and module.score(none, model).count() == 0
    kept = module.keep(odd, model)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    empty = module.train(none, labels)
    assert {round(r.score, 6) for r in module.score(odd, empty).collect()} == {0.5}
    one_sided = module.train(docs, labels.filter(f"{target} = 1"))
    assert module.score(odd, one_sided).count() == odd.count()


def test_factor_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.DIMENSIONS), rng.normal(size=(quality_fm.DIMENSIONS, quality_fm.RANK)) * 0.1)
    i, x = np.array([3, 99, 1000]), np.array([0.5, 1.0, 2.0], dtype=np.float32)
    pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(3) for b in range(a + 1, 3))
    assert np.isclose(m.score([i], [x])[0], 1 / (1 + np.exp(-(m.bias + m.weights[i] @ x + pairs))))


def test_isotonic_never_falls():
    rng = np.random.default_rng(1)
    points, values = toxicity.isotonic(np.round(rng.normal(size=500), 1), (rng.random(500) < 0.4).astype(float))
    assert (np.diff(points) >= 0).all() and (np.diff(values) >= -1e-12).all()


def plain_isotonic(margin, y):
    """At each distinct margin the greatest, over beginnings, of the least mean over ends: the isotonic regression."""
    at = sorted(set(margin))
    mean = lambda a, b: np.mean([v for m, v in zip(margin, y) if at[a] <= m <= at[b]])
    return [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]


@pytest.mark.parametrize("seed", range(20))
def test_isotonic_is_the_regression(seed):
    rng = np.random.default_rng(seed)
    margin, y = rng.integers(0, 8, 30) / 4, (rng.random(30) < 0.5).astype(float)
    points, values = toxicity.isotonic(margin, y)
    want = plain_isotonic(margin, y)
    # blocks of one value in the regression are the points, each with its mean, a little smoothed
    blocks = [[m for m, w in zip(sorted(set(margin)), want) if w == v] for v in sorted(set(want))]
    members = [[(m, v) for m, v in zip(margin, y) if m in b] for b in blocks]
    assert np.allclose(points, [np.mean([m for m, _ in x]) for x in members])
    assert np.allclose(values, [(sum(v for _, v in x) + 0.02) / (len(x) + 0.04) for x in members])
    for order in ([0, 0, 1, 1], [0, 1, 0, 1], [1, 1, 0, 0]):
        assert np.allclose(toxicity.isotonic(np.zeros(4), np.array(order, dtype=float))[1], 0.5)


def plain_margin(trees, x):
    total = trees.base
    for f, bound, leaf in zip(trees.feature, trees.bound, trees.leaf):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if x[f[node]] > bound[node] else 1)
        total += leaf[node - len(f)]
    return total


def test_scores_are_what_plain_code_gives(spark, small):
    docs, labels = shared.table(spark, small, "documents"), shared.table(spark, small, "labels")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.train(docs, labels)
    for r in toxicity.score(docs, model).collect():
        margin = plain_margin(model.trees, toxicity.features(toxicity.read([texts[r.doc_id]]), model.lexicon)[0])
        assert abs(r.score - min(1, max(0, np.interp(margin, model.points, model.values)))) < 1e-9
    m = quality_fm.train(docs, labels)
    for r in quality_fm.score(docs, m).collect()[:40]:
        (i,), (x,) = quality_fm.features([texts[r.doc_id]])
        v = m.factors[i] * x[:, None].astype(np.float64)
        pairs = sum(float(v[a] @ v[a + 1 :].sum(axis=0)) for a in range(len(i) - 1))
        assert abs(r.score - 1 / (1 + np.exp(-(m.bias + x @ m.weights[i] + pairs)))) < 1e-6


def test_toxicity_features(spark):
    lexicon = toxicity.Lexicon(np.sort(toxicity._hash_words(["zork"])), np.array([3.0]), np.empty(0, dtype=np.uint32))
    x = dict(zip(toxicity._NAMES, toxicity.features(toxicity.read(["You IDIOT! zork zork, s1lly heeey far away from all of them idiot"]), lexicon)[0]))
    assert x["insults"] == 2 / 13 and x["lexicon"] == 4 / 13 and x["lexicon_kinds"] == 2 and abs(x["lexicon_weight"] - 6 / 13) < 1e-12 and x["lexicon_most"] == 3
    assert x["near_address"] == 3 / 4 and x["address"] == 1 / 13 and x["exclaims"] == 1 / 13 and x["obfuscated"] == 1 / 13 and x["drawn_out"] == 1 / 13


def test_training_on_long_and_repeated_texts(spark):
    """Texts of megabytes, and a doc_id that comes very often, leave the driver's part of the sample small."""
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(3000)]
    text = lambda n, bad: " ".join(rnd.choice(words) if not bad or rnd.random() > 0.05 else "idiot" for _ in range(n))
    rows = [(i, text(150_000 if i % 10 == 0 else 80, i % 2 == 1 and i % 10 != 0)) for i in range(60)] + [(1, text(50, True)) for _ in range(500)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 2 == 0), int(i % 2 == 1 and i % 10 != 0)) for i in range(60)] * 2, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert model.score([text(80, True)])[0] > model.score([text(80, False)])[0]
    assert labelled.sample(docs, labels, "toxic", 3, 1, 100).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    machine = quality_fm.train(docs, labels)
    assert machine.score(*quality_fm.features([text(80, False)]))[0] > machine.score(*quality_fm.features([text(80, True)]))[0]
    some = spark.createDataFrame([(i, 10) for i in range(9)], "doc_id long, size long")
    assert labelled.within_bytes(some, F.col("size"), 45).count() == 4


def test_trees_learn_a_step():
    x = np.random.default_rng(2).random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert (((toxicity.boost(x, y).margin(x) > 0) == y).mean()) > 0.95


def test_a_large_lexicon_loses_nothing(spark):
    """More telling words than any fixed number of entries: all that enough toxic texts have are learned."""
    rnd, strong = random.Random(2), [f"q{chr(97 + k % 26)}{k}zx" for k in range(45_000)]
    telling = lambda i: " ".join(rnd.sample(strong[i // 12 * 1500 : (i // 12 + 1) * 1500], 1500))
    rows = [(i, telling(i) if i < 360 else f"plain words of text {i} and no more", int(i < 360)) for i in range(720)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels, modulus=10**6, remainder=0)
    assert toxicity.least_texts(toxicity.LEXICON_COUNTS) == toxicity.LEAST_TEXTS and toxicity.least_texts(10 * toxicity.LEXICON_COUNTS) == 10 * toxicity.LEAST_TEXTS
    known = set(np.asarray(model.lexicon.words).tolist())
    assert set(toxicity._hash_words(strong).tolist()) <= known
    scores = model.score([t for _, t, _ in rows])
    assert min(scores[:360]) > max(scores[360:])


# 5


def shingles(text, width=5):
    w = WORDS.findall(text.translate(LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, odd, none, middle):
    for df in (odd, shared.table(spark, middle, "documents")):
        rows = rows_of(df)
        got = fingerprints.with_edits(df).collect()
        nexts = [rows[(i + 1) % len(rows)][1] for i in range(len(rows))]
        changed = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), n in zip(rows, nexts)]
        want = Counter((d, len(t), hashlib.sha256(c.encode()).hexdigest()) for (d, t), c in zip(rows, changed))
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    # the likenesses of the whole table against the true similarities
    found = {r.doc_id: r for r in got}
    sets = [shingles(t) for _, t in rows]
    for column, others in (("near_edited", [shingles(c) for c in changed]), ("near_next", sets[1:] + sets[:1])):
        errors = np.array([found[d][column] - jaccard(a, b) for (d, _), a, b in zip(rows, sets, others)])
        assert abs(errors.mean()) < 0.01 and np.abs(errors).max() < 0.15
    prints: dict = {}
    for d, t in rows:
        assert prints.setdefault(t, found[d].fingerprint) == found[d].fingerprint
    assert fingerprints.with_edits(none).count() == 0
    assert fingerprints.fingerprint_table(odd).count() == odd.count()


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None, lambda i: None if i % 3 == 0 else 5 if i % 3 == 1 else i, lambda i: 2**53 + i % 2, lambda i: i // 40])
def test_fingerprints_where_rows_share_a_doc_id(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprints, "PART_BYTES", 3000)
    rnd = random.Random(9)
    table = [(ids(i), None if i == 5 else " ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(1, 40)))) for i in range(400)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(6)
    placed = fingerprints.in_ranges(spark, shared.text_of(docs, "doc_id"))
    sizes = [r["count"] for r in placed.groupBy("range").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 400 / 3  # no range has a third of all rows
    rows = rows_of(docs)
    want = Counter()
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        want[d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.with_edits(docs).collect()) == want


def test_likeness_is_near_the_similarity():
    rnd, errors = random.Random(4), []
    for _ in range(60):
        a = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([8, 60, 600]))]
        b = list(a)
        for _ in range(rnd.randrange(1 + len(a) // 8)):
            b[rnd.randrange(len(b))] = f"v{rnd.randrange(10**6)}"
        x, y = fingerprints.fingerprints([" ".join(a), " ".join(b)])
        errors.append(fingerprints.likeness(x, y) - jaccard(shingles(" ".join(a)), shingles(" ".join(b))))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15
    assert fingerprints.fingerprints(["Same  Text here"]) == fingerprints.fingerprints(["same text\nhere"])


# 6


def test_token_counts(odd, none):
    t = plain_tokenizer(BYTE)
    n = np.array([len(t.encode(text, add_special_tokens=False).ids) for _, text in rows_of(odd)])
    got = token_counts.token_histogram(odd, BYTE).collect()
    assert sorted(r.n_tokens for r in got) == sorted(set(n.tolist()))
    for r in got:
        assert (r.n_docs, r.docs_at_least) == ((n == r.n_tokens).sum(), (n >= r.n_tokens).sum())
        assert (r.tokens_at_least, r.truncated_tokens) == (n[n >= r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum())
        assert abs(r.share_at_most - (n <= r.n_tokens).mean()) < 1e-12
    assert token_counts.token_histogram(none, BYTE).count() == 0


def test_token_counts_at_any_limit_and_quantile(spark):
    n = np.array([3, 3, 10, 40, 5000])
    counts = token_counts.histogram(spark.createDataFrame([(int(x),) for x in n], "n_tokens long"))
    limits = [0, 1, 3, 4, 10, 39, 4096, 5000, 32768]
    got = {r.limit: (r.docs_at_least, r.tokens_at_least, r.truncated_tokens) for r in token_counts.at_limits(counts, limits).collect()}
    assert got == {x: ((n >= x).sum(), n[n >= x].sum(), np.minimum(n, x).sum()) for x in limits}
    got = {r.quantile: r.n_tokens for r in token_counts.at_quantiles(counts, [0, 0.4, 0.5, 0.8, 0.81, 1]).collect()}
    assert got == {0: 3, 0.4: 3, 0.5: 10, 0.8: 40, 0.81: 5000, 1: 5000}
    no = counts.filter("false")
    assert [tuple(r) for r in token_counts.at_limits(no, [7]).collect()] == [(7, 0, 0, 0)]
    assert [tuple(r) for r in token_counts.at_quantiles(no, [0.5]).collect()] == [(0.5, None)]


# 7


def plain_groups(rows, percent):
    sets = {d: shingles(t) for d, t in sorted(rows, reverse=True)}  # of a doc_id's texts the least
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup(odd, none, percent):
    got = near_dedup.groups(odd, percent).collect()
    known = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert known == plain_groups([r for r in rows_of(odd) if r[0] is not None], percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    kept = near_dedup.keep_one(odd, percent)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 2
    assert near_dedup.groups(none, percent).count() == 0


def test_near_dedup_of_rows_that_share_or_lack_a_doc_id(spark):
    near = lambda seed, *at: " ".join("changed" if i in at else f"{seed}{i}" for i in range(100))
    rows = [
        (3, near("a"), "first"), (5, near("a", 99), "copy of 3"), (5, "unique clean text of five", "unique"),
        (7, near("b", 99), "lesser"), (7, near("c", 0), "greater"), (9, near("c"), "copy of the greater"),
        (11, near("d"), "repeated"), (11, near("d"), "repeated"), (12, "", "empty"), (12, None, "empty"),
        (None, near("a", 0), "copy of 3 without id"), (None, near("e"), "e"), (None, near("e", 99), "e"), (None, "", "blank"), (None, None, "blank"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = near_dedup.keep_one(df, 80)
    assert kept.columns == df.columns
    assert sorted(r.lang for r in kept.collect()) == sorted(["first", "unique", "lesser", "greater", "repeated", "empty", "e", "blank", "blank"])
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.groups(df, 80).collect())
    want = [(3, 3, True), (5, 3, False), (5, 5, True), (7, 7, True), (7, 7, True), (9, 7, False), (11, 11, True), (12, 12, True), (None, 3, False), (None, None, True), (None, None, False), (None, None, True), (None, None, True)]
    assert got == Counter(want)


@pytest.mark.parametrize(("block", "size"), [(256, 8 << 20), (7, 8 << 20), (256, 5000)])
def test_near_dedup_of_a_chain_of_copies(spark, monkeypatch, block, size):
    """A group far larger than a block, whose members mostly don't link with each other."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", size)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(90):
        base = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            base[rnd.randrange(len(base))] = f"v{rnd.randrange(10**6)}"
        rows.append((i * 3 % 97, " ".join(base)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == plain_groups(rows, 85)


def test_near_dedup_of_a_group_whose_least_document_is_apart(spark, monkeypatch):
    """The star of a bucket links nothing: its other members still meet, over several classes of size."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    base = [f"w{i}" for i in range(400)]
    # the least document is alike to all, below the threshold; the others are so by steps of length
    rows = [(1, " ".join(base[:330]))] + [(10 + k, " ".join(base[70 - k :])) for k in range(0, 70, 2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    want = plain_groups(rows, 85)
    assert got == want and len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_finds_what_sql_finds(spark, middle, percent):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{middle}/documents.parquet'")
    want = con.execute(near_dedup.oracle_sql(percent)).fetchall()
    got = near_dedup.groups(shared.table(spark, middle, "documents"), percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_recall_at_the_threshold():
    """Pairs right above the threshold share a band."""
    rng = np.random.default_rng(7)
    for percent in (80, 85):
        count, rows = near_dedup.bands(percent / 100)
        alike, own = rng.integers(0, 1 << 62, (1500, 2 * percent), dtype=np.int64), rng.integers(0, 1 << 62, (1500, 2, 100 - percent), dtype=np.int64)
        keys = near_dedup.band_keys([np.sort(np.concatenate((s, o)).astype(np.uint64)) for s, pair in zip(alike, own) for o in pair], count, rows)
        assert (keys[0::2] == keys[1::2]).any(axis=1).all()
        apart = near_dedup.band_keys([np.sort(x.astype(np.uint64)) for x in rng.integers(0, 1 << 62, (400, 100), dtype=np.int64)], count, rows)
        assert not (apart[0::2] == apart[1::2]).any()


def test_intermediate_tables_go(spark, odd, tmp_path):
    import os

    with shared.workspace(spark) as at:
        folder = at.removeprefix("file://")
        near_dedup.groups(odd.filter("doc_id between 0 and 7"), 85).collect()
        left = sorted(x.rsplit("-", 1)[0] for x in os.listdir(folder))
        assert left == ["components"]
        near_dedup.keep_one(odd, 80).collect()
        packing.sequences(odd, BYTE, width=128).collect()
        token_counts.token_histogram(odd, BYTE).collect()
        left = sorted(x.rsplit("-", 1)[0] for x in os.listdir(folder))
        assert left == ["components", "components", "judged-rows", "kept-rows", "packing-sequences", "token-histogram"]
    assert not os.path.exists(folder)


def test_bayesian_bounds():
    least = near_dedup.least_matches(0.85)
    assert list(least) == sorted(least) and least[-1] > 0.7 * near_dedup.LONG_VALUES
    rng = np.random.default_rng(3)
    same = rng.random((4000, near_dedup.LONG_VALUES)) < 0.85
    values = np.concatenate([np.zeros((1, near_dedup.LONG_VALUES), dtype=np.uint8), (~same).astype(np.uint8)])
    kept, _ = near_dedup.survivors(values, np.zeros(4000, dtype=int), np.arange(1, 4001), 0.85)
    assert len(kept) == 4000
    assert (1 - 0.85 ** near_dedup.bands(0.85)[1]) ** near_dedup.bands(0.85)[0] <= near_dedup.BAND_MISS


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_keep_one_leaves_clashing_columns(spark):
    rows = [(1, "one two three four five six", "a"), (1, "one two three four five six", "b"), (2, "one two three four five six", "c"), (3, None, "d"), (None, "", "e")]
    kept = near_dedup.keep_one(spark.createDataFrame([(i, t, x, x) for i, t, x in rows], "doc_id long, text string, __row string, __row0 string"), 80)
    assert kept.columns == ["doc_id", "text", "__row", "__row0"]
    got = kept.collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, "one two three four five six"), (3, None), (None, "")} and all(r["__row"] == r["__row0"] in "abcde" for r in got)


# 8


def test_byte_bpe(odd, none):
    encoding = tokens.rank_file(RANKS, P.PATTERN)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(odd, RANKS, P.PATTERN).collect())
    want = Counter()
    for doc, text in rows_of(odd):
        ids = encoding.encode_ordinary(text)
        want[doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    assert byte_bpe.round_trip(none, RANKS, P.PATTERN).count() == 0
    coded = byte_bpe.encode_table(odd.filter("doc_id = 13"), RANKS, P.PATTERN)
    assert byte_bpe.decode_table(coded, RANKS, P.PATTERN).first().data.decode() == odd_texts()[13]
    mixed = coded.unionByName(coded.selectExpr("doc_id", "CAST(NULL AS array<int>) AS ids")).unionByName(coded.selectExpr("CAST(NULL AS long) AS doc_id", "array() AS ids"))
    assert sorted((r.doc_id or 0, None if r.data is None else len(r.data)) for r in byte_bpe.decode_table(mixed, RANKS, P.PATTERN).collect() if r.data is None or not r.data) == [(0, 0), (13, None)]


def test_long_texts_split_safely():
    encoding, rnd = tokens.rank_file(RANKS, P.PATTERN), random.Random(8)
    alphabet = list("ab c  \n\n\té'’.,12 \u3000\u00a0") + ["'s", "'ll", "\r\n"]
    for _ in range(300):
        text = "".join(rnd.choice(alphabet) for _ in range(200))
        parts = byte_bpe.split_long(text, most=16)
        assert "".join(parts) == text
        assert [i for p in parts for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


# 9


def test_token_files(spark, odd, none):
    t = plain_tokenizer(WORD)
    start, want = 0, []
    for doc, text in rows_of(odd):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    got = token_files.write_and_read(odd, WORD).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert token_files.write_and_read(none, WORD).count() == 0


def test_file_format(monkeypatch):
    import zstandard

    monkeypatch.setattr(token_files, "FRAME_BYTES", 400)
    out, docs = io.BytesIO(), {i: np.arange(i * 7, dtype=np.uint32) for i in range(40)}
    w = token_files.Writer(out)
    for i, ids in docs.items():
        w.add(i, ids)
    w.close()
    r = token_files.Reader(io.BytesIO(out.getvalue()))
    assert {d: ids.tolist() for d, ids in r.documents()} == {d: ids.tolist() for d, ids in docs.items()}
    assert [d for d, _ in r.documents({3, 17, 999})] == [3, 17]
    read, frame = [], r.frame
    monkeypatch.setattr(r, "frame", lambda k: (read.append(k), frame(k))[1])
    wanted = {3, 17, 39}
    assert [d for d, _ in r.documents(wanted)] == sorted(wanted)
    assert read == sorted({int(f) for d, f in zip(r.index["doc_id"], r.index["frame"]) if int(d) in wanted}) and len(read) < len(r.table)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert plain == b"".join(ids.astype("<u4").tobytes() for ids in docs.values())
    bad = bytearray(out.getvalue())
    bad[int(r.at[2]) + 12] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017, PT011
        list(token_files.Reader(io.BytesIO(bytes(bad))).documents())


# 10


def plain_judgement(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    rules = [(r.name, r.verdict) for r in url_filter.QUERY_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule, verdict = max(rules, key=lambda r: len(r[0]), default=(None, None))
    query = re.match(r"[^?#]*\??([^#]*)", rest)[1] if rest else ""
    kept = sorted(x for x in query.split("&") if x and not re.match(url_filter.TRACKING, x))
    canonical = re.sub(r"^www\.", "", host) + re.sub("/+$", "", path) + ("?" + "&".join(kept) if kept else "")
    return host, path, rule, verdict or ("block" if canonical in listed else "allow")


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Sub.Example.COM/en/7?x#y", "https://com/en/", "https://xcom/en/", "https://a.com/en/8", "http://example.net/de/8", "http://b.example.net/de/81?utm_source=f", "https://www.spam.example.org/fr/1/?b=2&a=1&ref=x#top", "https://spam.example.org/fr/1?a=1&b=2", "http://x.org?u=http://y", "http://x.org#a/b", "a://b://c/d", "http://É.org/es/", "http://x.org/\nes/"] + [f"https://h{i}.example.org/fr/{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(3, urls[11], "y", 2)], "page_id long, url string, host string, block int")
    listed = ["spam.example.org/fr/1?a=1&b=2", "h5.example.org/fr/5", "h7.example.org/fr/7", None, ""]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame([(x,) for x in listed], "canonical string"), url_filter.QUERY_RULES).collect()), key=str)
    want = sorted(((p.page_id, *plain_judgement(p.url, set(filter(None, listed)))) for p in pages.collect()), key=str)
    assert got == want
    assert url_filter.judge(pages, spark.createDataFrame([], "canonical string"), url_filter.QUERY_RULES).filter("by_list").count() == 0
    assert url_filter.judge(pages.filter("false"), spark.createDataFrame([("a",)], "canonical string"), []).count() == 0


def test_bloom_filter_passes_all_that_is_listed(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.org/x') AS canonical")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://h', id, '.org/x') AS url")
    got = url_filter.judge(pages, listed, [])
    assert got.filter("verdict = 'block'").count() == 3000
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_join_removes_what_the_filter_lets_through(spark):
    listed = spark.range(40_000).selectExpr("concat('h', id, '.org/x') AS canonical")
    pages = spark.range(40_000, 80_000).selectExpr("id AS page_id", "concat('http://www.h', id, '.org/x/?utm_source=f') AS url")
    got = url_filter.probe(pages, listed, [])
    possible = got.filter("possible").count()
    assert 0 < possible < 40_000 // 80  # about one in 250
    assert got.filter("by_list or verdict <> 'allow'").count() == 0


def test_the_querys_list_is_no_host_pattern(spark, middle):
    pages = shared.table(spark, middle, "pages")
    got = url_filter.judge(pages, url_filter.listed_of(pages), url_filter.QUERY_RULES).filter("rule is null")
    by_host = F.col("host").rlike(url_filter.LISTED_HOSTS)
    assert got.filter(F.col("by_list") & ~by_host).count() > 0 and got.filter(~F.col("by_list") & by_host).count() == 0


def test_native_plans_run_no_python(spark, small):
    plan = quality_rules.judge(shared.table(spark, small, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
