"""Operator 12, spelling variant grouping: Levenshtein automata against broadcast trie shards.

Distinct words with their counts are ordered and cut into ranges of bounded size; each becomes a compact trie, five bytes
a node and a count for each word. The shards are broadcast in waves of bounded size. In a task, a block of words meets
every shard: the intersection of each word's automaton of distance one with the trie is walked depth-first, for the whole
block with array operations. What ends in an accepting node is a near word; of each word's near words only their number
and the best form leave the task, so pairs never become rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm import shared
from strataloom.llm.conversations import CRC_SQL, crc_sql

#: Letters of a word: ASCII and Latin-1. One byte each once the ASCII ones are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A near word is a form if it occurs so many times as often.
FORM_FACTOR = 10
#: One run in so many loses a letter (the query's planted misspellings).
DAMAGE_EVERY = 31
#: Bytes of words in a shard; a trie of prefixes has at most so many nodes, five bytes each.
SHARD_BYTES = 1 << 20
#: Bytes of shards that are broadcast at once, and so held by the driver.
WAVE_BYTES = 32 << 20
#: Different words that a counting task holds before it hands them on.
HELD_WORDS = 200_000
#: Letters of the words that a task looks up.
TASK_LETTERS = 1 << 20
#: Letters of a block of words, and states that are walked together.
BLOCK_LETTERS = 1 << 18
BLOCK_STATES = 1 << 18


# counting


def counted_words(docs: DataFrame, damage_every: int = 0, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): maximal runs of letters of all texts, A-Z lower-cased, of at least ``least_length`` letters and
    ``least_count`` occurrences. With ``damage_every``, a run whose CRC-32 with its doc_id divides by it loses a letter
    first. Null texts have none; a null doc_id counts as empty text in that number."""
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")  # a shorter run stays too short, whatever it loses

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for piece in shared.slices(batch):
                for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    words = runs.findall(text.encode().lower().decode())  # of bytes, only A-Z are lower-cased
                    if not damage_every:
                        held.update(words)
                    else:
                        own = Counter(words)
                        before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                        for word, n in own.items():
                            h = zlib.crc32(word.encode(), before)
                            if h % damage_every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_length:
                                    continue
                            held[word] += n
                    if len(held) >= HELD_WORDS:
                        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    found = shared.text_of(docs, "doc_id").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# tries


class Trie:
    """A trie in level order: for each node its parent and letter, and for nodes that end a word its count.

    ``key`` holds parent and letter in one ascending number, so a child is found by binary search and a node's
    children lie together."""

    def __init__(self, parent: np.ndarray, letter: np.ndarray, ends: np.ndarray, counts: np.ndarray):
        self.parent, self.letter, self.ends, self.counts = parent, letter, ends, counts
        nodes = len(parent)
        self.key = (parent.astype(np.int64) << 8) | letter
        self.key[0] = -1
        self.first = np.searchsorted(parent[1:], np.arange(nodes + 1), side="left") + 1  # of each node's children
        self.word = np.full(nodes, -1, dtype=np.int64)
        self.word[ends] = np.arange(len(ends))

    @classmethod
    def of(cls, words: list[bytes], counts: list[int]) -> Trie:
        """Words must be distinct and ascending."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at = np.cumsum(size) - size
        parents, letters = [np.zeros(1, dtype=np.uint32)], [np.zeros(1, dtype=np.uint8)]
        end = np.zeros(len(words), dtype=np.int64)
        live, node, made, depth = np.flatnonzero(size > 0), np.zeros(int((size > 0).sum()), dtype=np.int64), 1, 0
        while len(live):
            letter = data[at[live] + depth]
            new = np.ones(len(live), dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
            parents.append(node[new].astype(np.uint32))
            letters.append(letter[new])
            node = made + np.cumsum(new) - 1
            made += int(new.sum())
            depth += 1
            ended = size[live] == depth
            end[live[ended]] = node[ended]
            live, node = live[~ended], node[~ended]
        order = np.argsort(end, kind="stable")
        return cls(np.concatenate(parents), np.concatenate(letters), end[order].astype(np.uint32), np.array(counts, dtype=np.int64)[order])

    def packed(self) -> bytes:
        head = np.array([len(self.parent), len(self.ends)], dtype="<i8").tobytes()
        return head + b"".join(a.astype(t).tobytes() for a, t in ((self.parent, "<u4"), (self.letter, "u1"), (self.ends, "<u4"), (self.counts, "<i8")))

    @classmethod
    def unpacked(cls, raw: bytes) -> Trie:
        nodes, words = np.frombuffer(raw, dtype="<i8", count=2).tolist()
        out, at = [], 16
        for t, n in (("<u4", nodes), ("u1", nodes), ("<u4", words), ("<i8", words)):
            out.append(np.frombuffer(raw, dtype=t, count=n, offset=at))
            at += n * np.dtype(t).itemsize
        return cls(*out)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The children by a letter, -1 for none."""
        key = (node << 8) | letter
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def spelling(self, node: int) -> str:
        out = []
        while node:
            out.append(int(self.letter[node]))
            node = int(self.parent[node])
        return bytes(reversed(out)).decode("latin-1")


class Block:
    """Words that are looked up together: their letters in one array, with a zero after each."""

    def __init__(self, words: list[bytes]):
        self.data = np.frombuffer(b"\x00".join(words) + b"\x00", dtype=np.uint8)
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.at = np.cumsum(self.size + 1) - self.size - 1


def accepted(trie: Trie, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(word of the block, node): all words of the trie at a distance of exactly one, each once.

    A state is (word, node, place in the word, changes made). States of one depth form an array; the newest array is
    taken first and split when it is large, so the walk goes depth-first and its memory stays bounded by depth.
    """
    n = len(block.size)
    out_w, out_x = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]

    def expand(w, x, i, changed):
        """States that follow, and accepted pairs."""
        here = block.data[block.at[w] + i].astype(np.int64)  # 0 at a word's end
        left = here > 0
        done = changed & ~left & (trie.word[x] >= 0)
        out_w.append(w[done])
        out_x.append(x[done])
        # the word's next letter
        to = trie.child(x, here)
        go = left & (to >= 0)
        states = [(w[go], to[go], i[go] + 1, changed[go])]
        fresh = ~changed
        w, x, i, here, left = w[fresh], x[fresh], i[fresh], here[fresh], left[fresh]
        # a letter of the word that the trie's word lacks: same node, next place
        states.append((w[left], x[left], i[left] + 1, np.ones(int(left.sum()), dtype=bool)))
        # any letter of the trie in place of the word's, or before it
        kids = trie.first[x + 1] - trie.first[x]
        src = np.repeat(np.arange(len(x)), kids)
        to = trie.first[x][src] + np.arange(len(src)) - np.repeat(np.cumsum(kids) - kids, kids)
        other = left[src] & (trie.letter[to] != here[src])
        yes = np.ones(len(src), dtype=bool)
        states.append((w[src][other], to[other], i[src][other] + 1, yes[other]))
        states.append((w[src], to, i[src], yes))
        return tuple(np.concatenate(c) for c in zip(*states, strict=True))

    stack = [(np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool))]
    while stack:
        states = stack.pop()
        if len(states[0]) > BLOCK_STATES:
            half = len(states[0]) // 2
            stack += [tuple(c[half:] for c in states), tuple(c[:half] for c in states)]
        elif len(states[0]):
            stack.append(expand(*states))
    w, x = np.concatenate(out_w), np.concatenate(out_x)
    # two edits may lead to the same word; one edit never leads back to the word itself
    pair = np.unique((w << 32) | trie.word[x])
    return pair >> 32, trie.ends[pair & 0xFFFFFFFF].astype(np.int64)


# shards and waves


def shards_of(words: DataFrame, letters: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(bytes, trie): ranges of the ordered words, each a packed trie of at most ``shard_bytes`` letters or one word.

    ``letters``: of all words together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0

        def made() -> pa.RecordBatch:
            raw = Trie.of(held, counts).packed()
            return pa.RecordBatch.from_arrays([pa.array([len(raw)]), pa.array([raw], pa.binary())], ["bytes", "trie"])

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                raw = word.encode("latin-1")
                if held and size + len(raw) > shard_bytes:
                    yield made()
                    held, counts, size = [], [], 0
                held.append(raw)
                counts.append(n)
                size += len(raw)
        if held:
            yield made()

    return words.repartitionByRange(max(1, -(-letters // shard_bytes)), "word").sortWithinPartitions("word").mapInArrow(run, "bytes long, trie binary")


def waves(shards: DataFrame, wave_bytes: int = WAVE_BYTES) -> Iterator[list[bytes]]:
    """The shards in runs of at most ``wave_bytes``, or one shard; one run at a time is with the driver."""
    run = F.floor(F.sum("bytes").over(Window.orderBy("partition", "place").rowsBetween(Window.unboundedPreceding, -1)) / wave_bytes)
    # a row of three numbers a shard meets in one place, 32 MB of them for a terabyte of words
    at = shards.select("partition", "place", F.coalesce(run, F.lit(0)).alias("wave"))
    for k in sorted(r[0] for r in at.select("wave").distinct().collect()):
        yield [bytes(r.trie) for r in shards.join(at.filter(F.col("wave") == k), ["partition", "place"]).select("trie").collect()]


def search(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """(word, n, near, best_n, best): of each word that has near words in these shards, how many, and the one that
    occurs most (ties: the first by code points)."""
    sent = words.sparkSession.sparkContext.broadcast(tries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: list[Trie] = []

        def found(words: list[str], counts: list[int]) -> pa.RecordBatch:
            block = Block([x.encode("latin-1") for x in words])
            near, best, form = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), [None] * len(words)
            for trie in shards:
                w, x = accepted(trie, block)
                if not len(w):
                    continue
                near += np.bincount(w, minlength=len(words))
                n = trie.counts[trie.word[x]]
                top = np.zeros(len(words), dtype=np.int64)
                np.maximum.at(top, w, n)
                hit = (n == top[w]) & (n >= best[w])
                for k, node, count in zip(w[hit].tolist(), x[hit].tolist(), n[hit].tolist(), strict=True):
                    spelled = trie.spelling(node)
                    if count > best[k] or form[k] is None or spelled < form[k]:
                        best[k], form[k] = count, spelled
            some = np.flatnonzero(near).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([words[k] for k in some], pa.string()), pa.array([counts[k] for k in some], pa.int64()), pa.array(near[some]), pa.array(best[some]), pa.array([form[k] for k in some], pa.string())],
                ["word", "n", "near", "best_n", "best"],
            )

        words_, counts_, letters = [], [], 0
        for batch in batches:
            shards = shards or [Trie.unpacked(raw) for raw in sent.value]
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                words_.append(word)
                counts_.append(n)
                letters += len(word)
                if letters >= BLOCK_LETTERS:
                    yield found(words_, counts_)
                    words_, counts_, letters = [], [], 0
        if words_:
            yield found(words_, counts_)

    return words.mapInArrow(run, "word string, n long, near long, best_n long, best string")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): of words with a form, where following forms ends. Each step multiplies the count, and doubling the
    steps follows any chain in a few rounds; every round is a join and a count of what still moves."""
    with shared.Tables() as t:
        known = t.store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
        while True:
            to = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
            stepped = t.store(known.join(to, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
            known = stepped.drop("moved")
            if stepped.filter("moved").isEmpty():
                return t.result(known, "spelling-roots")


def variants(docs: DataFrame, damage_every: int = 0, shard_bytes: int = SHARD_BYTES, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``counted_words``: its form, the near word that occurs
    most and at least FORM_FACTOR times as often, where forms lead to in the end, and the number of near words.

    docs needs ``doc_id`` and ``text``; other columns are ignored. Null texts have no words, repeated rows count each, a
    null doc_id only changes which runs are damaged. An empty table gives no rows. Ties between forms go to the first by
    code points. Words of any length are kept whole; a walk takes as many array steps as the longest word has letters.
    """
    with shared.Tables() as t:
        words = t.store(counted_words(docs, damage_every), "spelling-words")
        letters = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
        shards = shards_of(words, letters, shard_bytes).select("*", F.spark_partition_id().alias("partition"), F.monotonically_increasing_id().alias("place"))
        shards = t.store(shards, "spelling-shards")
        # a task walks a bounded number of words, however many words a file holds
        tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), letters // TASK_LETTERS)
        found = None
        for tries in waves(shards, wave_bytes):
            part = t.store(search(words.repartition(tasks), tries), "spelling-near")
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = words.filter("false").select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(0).cast("long").alias("best_n"), F.lit("").alias("best"))
        best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
        near = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("near").alias("n_near"), best.alias("top"))
        is_form = -F.col("top.less") >= FORM_FACTOR * F.col("n")
        near = t.store(near.select("word", "n_near", F.when(is_form, F.col("top.best")).alias("form"), F.when(is_form, -F.col("top.less")).alias("form_n")), "spelling-forms")
        roots = roots_of(near.filter(F.col("form").isNotNull()))
        out = words.join(near.join(roots, "word", "left"), "word", "left")
        columns = ["word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"]
        return t.result(out.select(*columns), "spelling-variants")


def oracle_sql(damage_every: int = DAMAGE_EVERY) -> str:
    """The same by deletion variants: words of one length that agree without the letter at the same place, and words that
    become another one without a letter."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    codes = "flatten(list_transform(string_split(key, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))"
    return f"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{upper}', '{lower}') AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, n, {crc_sql(codes)} AS h FROM own, crc),
spelled AS (SELECT CASE WHEN h % {damage_every} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
dels AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM dels a JOIN dels b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word FROM dels d JOIN words w ON d.v = w.word UNION SELECT w.word, d.word FROM dels d JOIN words w ON d.v = w.word),
best AS (SELECT near.word, count(*) AS n_near, min({{'less': -o.n, 'other': other}}) AS top FROM near JOIN words o ON o.word = other GROUP BY near.word),
formed AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= {FORM_FACTOR} * n THEN top.other END AS form,
  CASE WHEN -top.less >= {FORM_FACTOR} * n THEN -top.less END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS last FROM formed WHERE form IS NOT NULL UNION ALL SELECT chain.word, form FROM chain JOIN formed ON formed.word = last WHERE form IS NOT NULL),
ends AS (SELECT chain.word, last FROM chain JOIN formed ON formed.word = last WHERE form IS NULL)
SELECT word, form, coalesce(last, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)"""
