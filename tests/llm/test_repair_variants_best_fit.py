"""Conversation repair, spelling variants and best-fit packing against plain code, and on the rows that break careless ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from test_operators import SCHEMA, odd_texts, plain_tokenizer, rows_of

from strataloom.llm import best_fit, conversations, queries, shared, spelling

BYTE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    rows += [(8, rows[8][1]), (None, "no id at all"), (None, None), (-5, "negative id")]
    return spark.createDataFrame([(i, t, *["x", 1, 2, "y", "z", 3, 0.5, 4, "w", 5, 6, "k"]) for i, t in rows], SCHEMA).repartition(3)


# 11

TURNS = "conv_id long, turn long, role string, text string, step long, fault string, cost long, edit string, blank boolean, n int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 7, "f", 9, "e", True, 1) for r in rows], TURNS).repartition(3)


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """The least (cost, labels) of all ways, by trying every edit at every place with at most two insertions in a row."""
    faults = plain_faults(rows)
    best = [None]

    def go(i, cost, labels, made, inserts):
        if best[0] and cost > best[0][0]:
            return
        initials = "".join(r[:1] if r else " " for r, _ in made)
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best[0] = min([x for x in (best[0], (cost, labels, made)) if x], key=lambda x: x[:2])
        if inserts < 2:
            for role in ("user", "assistant"):
                go(i, cost + 3, labels + "I", [*made, (role, "")], inserts + 1)
        if i == len(rows):
            return
        _, role, text = rows[i]
        go(i + 1, cost + 4, labels + "D", made, 0)
        if faults[i] in (None, "truncated"):
            more = 3 if faults[i] else 0
            go(i + 1, cost + more, labels + "K", [*made, (role, text)], 0)
            for r in ("user", "assistant"):
                go(i + 1, cost + more + 3, labels + "R", [*made, (r, text)], 0)

    go(0, 0, "", [], 0)
    return faults, best[0]


def test_repair_is_the_cheapest(spark):
    rnd, rows = random.Random(4), []
    for conv in range(150):
        for turn in range(rnd.randrange(1, 6)):
            rows.append((conv, turn + rnd.randrange(2), rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rnd.choice(["a.", "b", " ", "", "c!\n", "d? ", "é"])))
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (None, 4, "assistant", "Ho.")]
    got = defaultdict(list)
    for r in sorted(conversations.repair(turns_of(spark, rows)).collect(), key=lambda r: r.step):
        got[r.conv_id].append(r)
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, (cost, labels, made) = plain_repair(own)
        assert sum(r.cost for r in got[conv]) == cost and "".join(r.edit for r in got[conv]) == labels, own
        assert [(r.role, r.text) for r in got[conv] if r.edit != "D"] == made
        assert [r.fault for r in got[conv] if r.edit != "I"] == faults and [r.step for r in got[conv]] == list(range(len(labels)))


def test_a_long_conversation_streams(spark, monkeypatch):
    """Paths agree soon, so edits leave while the conversation goes on; with the same result when they are asked more often."""
    rnd = random.Random(8)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(3000)]
    rows = [(c, i, rnd.choice(["user", "assistant"]) if rnd.random() < 0.05 else r, "" if rnd.random() < 0.03 else t) for c, i, r, t in rows]
    paths, most = conversations.Composition(), 0
    for _, _, role, text in rows:
        paths.read(conversations.Turn(role[0], not text, False))
        paths.settled()
        most = max(most, *(len(labels) for _, labels in paths.best.values()))
    assert most < 50
    one = [tuple(r) for r in conversations.repair(turns_of(spark, rows)).collect()]
    monkeypatch.setattr(conversations, "UNDECIDED", 10**9)
    assert sorted(one, key=lambda r: r[1]) == sorted((tuple(r) for r in conversations.repair(turns_of(spark, rows)).collect()), key=lambda r: r[1])


def test_audit_of_odd_rows(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3) for t, r, x in [(None, None, None), (0, "user", "One."), (0, "user", "One."), (5, "assistant", "Two"), (5, "tool", "")]]
    dropped = next(c for c in itertools.count(10) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    got = {r.conv_id: r for r in conversations.audit(turns_of(spark, rows)).collect()}
    assert set(got) == {None, 1, 2, 3, dropped}
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    for conv in (None, 1, 2, 3):
        own = []
        for c, t, r, x in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            r, x = " " if r is None else r, " " if x is None else x
            if kind:
                own += [(t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)] * (2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, (cost, labels, made) = plain_repair(own)
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        text = "\n".join(f"{r}:{x}" for r, x in made)
        want = (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, labels, hashlib.sha256(text.encode()).hexdigest())
        assert tuple(got[conv]) == want


def test_repair_of_nothing(spark):
    none = turns_of(spark, [(1, 1, "user", "x.")]).filter("false")
    assert conversations.repair(none).count() == 0 and conversations.audit(none).count() == 0


# 12


def plain_variants(rows, damage):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if damage and h % damage == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = sorted((edits - {w}) & words.keys(), key=lambda v: (-words[v], v))
    form = {w: v[0] for w, v in near.items() if v and words[v[0]] >= 10 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize(("shard", "wave"), [(1 << 20, 32 << 20), (2000, 20_000), (1, 1 << 12)])
def test_variants(spark, small, shard, wave):
    docs = shared.table(spark, small, "documents")
    if shard == 1:
        docs = docs.filter("doc_id < 20")  # a shard for each word
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = spelling.variants(docs, 31, shard_bytes=shard, wave_bytes=wave)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(rows, 31)
    assert len(want) > 20 and {tuple(r) for r in got.collect()} == want


def test_chains_ties_and_odd_words(spark):
    chain = {"abcdefghi": 2, "abcdefgh": 20, "abcdefghj": 20, "abcdefg": 200, "bbcdefg": 2, "çéàüöäÿ": 30, "çéàüöä÷ÿ": 3, "z" * 3000: 2, "z" * 2999: 20, "onceonly": 1, "short": 50}
    text = " ".join(" ".join([w] * n) for w, n in chain.items())
    rows = [(1, text), (2, None), (3, ""), (None, "Nullword nullword NULLWORD"), (1, "Abcdefg İstanbul")]
    docs = spark.createDataFrame([(i, t, *["x", 1, 2, "y", "z", 3, 0.5, 4, "w", 5, 6, "k"]) for i, t in rows], SCHEMA)
    got = {tuple(r) for r in spelling.variants(docs).collect()}
    assert got == plain_variants(rows, 0)
    roots = {w: (f, r) for w, f, r, *_ in got}
    assert roots["abcdefghi"] == ("abcdefgh", "abcdefg") and roots["abcdefg"] == (None, "abcdefg") and "onceonly" not in roots


def test_variants_of_odd_texts(odd, spark):
    assert {tuple(r) for r in spelling.variants(odd, 31).collect()} == plain_variants(rows_of(odd), 31)
    assert spelling.variants(odd.filter("false"), 31).count() == 0


def test_tries_hold_their_words():
    rnd = random.Random(3)
    words = sorted({bytes(rnd.choice(b"abc\xe9") for _ in range(rnd.randrange(1, 9))) for _ in range(300)})
    trie = spelling.Trie.unpacked(spelling.Trie.of(words, list(range(len(words)))).packed())
    spelled = {trie.spelling(int(x)).encode("latin-1"): int(trie.counts[k]) for k, x in enumerate(trie.ends)}
    assert spelled == {w: i for i, w in enumerate(words)}


# 13


def test_best_fit(odd, spark):
    packed = best_fit.pack(odd, BYTE, width=64)
    t = plain_tokenizer(BYTE)
    want = Counter()
    for doc, text in rows_of(odd):
        want[(doc, tuple([*t.encode(text, add_special_tokens=False).ids, 2]))] += 1
    seqs = packed.collect()
    assert all(len(s.ids) == 64 * 4 and s.ids[4 * s.n :] == bytes(4 * (64 - s.n)) for s in seqs)
    rows = best_fit.pieces_of(packed).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    docs = Counter()
    waiting = defaultdict(lambda: defaultdict(list))
    for r in rows:
        waiting[r.doc_id, r.doc_tokens][r.piece].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for (doc, n), pieces in waiting.items():
        assert sorted(pieces) == list(range(max(1, -(-n // 64))))
        assert all(len(ids) == 64 for k, own in pieces.items() if k for _, ids in own)
        copies = len(pieces[0])
        for start in {s for own in pieces.values() for s, _ in own}:
            assert sum(s == start for own in pieces.values() for s, _ in own) == copies
        if copies == 1:
            docs[doc, tuple(x for k in sorted(pieces) for x in pieces[k][0][1])] += 1
    assert docs == Counter({k: n for k, n in want.items() if (k[0], len(k[1])) in {x for x, p in waiting.items() if len(p[0]) == 1}})
    assert sum(r.length for r in rows) == sum(len(k[1]) * n for k, n in want.items())
    assert best_fit.pack(odd.filter("false"), BYTE).count() == 0


def test_open_bins_against_a_plain_list():
    rnd = random.Random(6)
    for width, most in ((10, 3), (64, 1), (100, 20)):
        bins, plain, closed, want = best_fit.OpenBins(width, most), [], [], []
        for item in range(2000):
            size = rnd.randrange(1, width + 1)
            closed += [sorted(i for i, _ in b) for b in bins.put(size, (item, size))]
            fits = [b for b in plain if sum(s for _, s in b) + size <= width]
            if fits:
                top = max(sum(s for _, s in b) for b in fits)
                b = [b for b in fits if sum(s for _, s in b) == top][-1]
                plain.remove(b)
            else:
                b = []
                if size < width and len(plain) == most:
                    top = max(sum(s for _, s in x) for x in plain)
                    full = [x for x in plain if sum(s for _, s in x) == top][-1]
                    plain.remove(full)
                    want.append(sorted(i for i, _ in full))
            b.append((item, size))
            plain.append(b)
            if sum(s for _, s in b) == width:
                plain.remove(b)
                want.append(sorted(i for i, _ in b))
            assert bins.count == len(plain) <= most
        assert closed == want


def test_best_fit_wastes_little(spark, middle):
    got = best_fit.pack(shared.table(spark, middle, "documents"), BYTE).agg({"n": "sum", "sequence_id": "count"}).first()
    assert got[1] <= 1.03 * -(-got[0] // 1024) if got[0] > got[1] else got[0] <= 1.03 * -(-got[1] // 1024)


def test_best_fit_query(spark, small):
    rows = queries.op13_best_fit(spark, small).collect()
    t, texts = plain_tokenizer(BYTE), {r.doc_id: r.text or "" for r in shared.table(spark, small, "documents").collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for doc, own in by.items():
        ids = np.array([*t.encode(texts[doc], add_special_tokens=False).ids, 2], dtype="<u4")
        own.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, a, n) for k, (a, n) in enumerate(best_fit.pieces_of_length(len(ids), 1024))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
