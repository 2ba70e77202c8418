"""Operator 4, toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is a fixed list of insults together with words, and beginnings of words, that labelled toxic texts have far
more often than others. It is learned without the texts whose features train the trees (by thirds), so that the trees
see how well a lexicon works on texts that it has not seen; their predictions for the left-out thirds calibrate.
Spark counts in how many texts each word stands; the driver gets the strongest words and a row of numbers for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import labelled, shared

#: Most labelled rows that the fit uses.
MOST_ROWS = 5_000
FOLDS = 3
THRESHOLD = 0.7
#: A word enters the lexicon if so many toxic texts have it, so many times as often as others.
LEAST_TEXTS = 3
LEAST_LOG_ODDS = 2.5
#: What toxic texts of the sample may hold of words and beginnings, each counted once a text, for so few texts to do;
#: with more, a word needs more texts. A third of this is then the most that the lexicon, hence the driver, can get.
LEXICON_COUNTS = 1_200_000
#: Bytes of the beginnings of words.
BEGINNINGS = (4, 5)
NEAR = 5

# Insults and words of address of four languages, lower case.
INSULTS = """
idiot idiots idiotic moron morons stupid dumb fool loser losers scum trash garbage pathetic worthless disgusting clown
imbecile jerk bastard freak pig rat vermin filth hate kill die ugly liar
idiote imbécile connard salaud crétin débile ordure minable dégoûtant abruti
dumm blöd trottel arschloch abschaum dreck ekelhaft versager schwachkopf
idiota estúpido imbécil tonto basura asqueroso inútil payaso escoria
""".split()
ADDRESS = "you your yours yourself ur u du dich dir dein deine ihr euch sie tu toi te ton ta vous votre usted ustedes tú ti tus vos".split()

_SEPARATE = bytes(b if chr(b).isalnum() or b >= 128 else 0x20 for b in range(256))
_NAMES = ("insults", "lexicon", "lexicon_kinds", "lexicon_weight", "lexicon_most", "beginnings", "beginning_kinds", "near_address", "address", "capitals", "exclaims", "questions", "signs", "obfuscated", "drawn_out", "words")
FEATURES = len(_NAMES)


def _short(hashes: np.ndarray) -> np.ndarray:
    """32 of the 64 bits: a lexicon has some hundred entries, and texts' hashes fill the driver's memory."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _hash_words(words: list[str]) -> np.ndarray:
    return np.unique(_short(shared.word_hashes(words)[0]))


_INSULTS, _ADDRESS = _hash_words(INSULTS), _hash_words(ADDRESS)


@dataclass
class Lexicon:
    """Hashes, sorted, and log odds: of words, and of beginnings of words."""

    words: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.uint32))
    odds: np.ndarray = field(default_factory=lambda: np.empty(0))
    beginnings: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.uint32))


def _is_in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), dtype=bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


@dataclass
class Words:
    """The words of a run of texts: hashes in order, where each text's begin, hashes of beginnings, and counts."""

    hashes: np.ndarray
    at: np.ndarray
    beginnings: list[np.ndarray]
    plain: np.ndarray  # features that need no lexicon


def read(texts: list[str]) -> Words:
    lowered = [t.lower() for t in texts]
    joined = [t.encode("utf-8", "replace").translate(_SEPARATE).decode("utf-8", "replace") for t in lowered]
    hashes, at = shared.word_hashes(joined, lower_ascii=False)
    hashes = _short(hashes)
    starts_only = [_short(shared.word_hashes([_cut(t, n) for t in joined], lower_ascii=False)[0]) for n in BEGINNINGS]
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    starts = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    count = lambda flag: np.add.reduceat(flag.astype(np.int64), starts)
    upper, lower, digit = (data >= 65) & (data <= 90), ((data >= 97) & (data <= 122)) | (data >= 128), (data >= 48) & (data <= 57)
    letter = upper | lower
    inside = np.zeros(len(data), dtype=bool)
    masks = digit | np.isin(data, np.frombuffer(b"@$*!#%+", dtype=np.uint8))
    inside[1:-1] = masks[1:-1] & letter[:-2] & letter[2:]
    drawn = np.zeros(len(data), dtype=bool)
    drawn[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 128)
    words = np.maximum(np.diff(at), 1)
    address = _is_in(hashes, _ADDRESS)
    per_text = lambda flag: np.array([flag[a:b].sum() for a, b in zip(at[:-1], at[1:], strict=True)])
    signs = np.isin(data, np.frombuffer(b".,;:'\"-()", dtype=np.uint8))
    plain = np.stack([per_text(_is_in(hashes, _INSULTS)) / words, per_text(address) / words, count(upper) / np.maximum(count(letter), 1), count(data == 33) / words, count(data == 63) / words, count(signs) / words, count(inside) / words, count(drawn) / words, np.log10(words)], axis=1)
    return Words(hashes, at, starts_only, plain)


def _cut(text: str, n: int) -> str:
    """Each word's first n bytes (a character cut in two stays damaged alike); the number of words stays."""
    return " ".join([w if len(w) < n else w.encode("utf-8", "replace")[:n].decode("utf-8", "replace") + "~" for w in text.split(" ") if w])


def features(words: Words, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES values for each text."""
    hit = _is_in(words.hashes, lexicon.words) | _is_in(words.hashes, _INSULTS)
    place = np.minimum(np.searchsorted(lexicon.words, words.hashes), max(len(lexicon.words) - 1, 0))
    odds = np.where(_is_in(words.hashes, lexicon.words), lexicon.odds[place] if len(lexicon.words) else 0.0, 0.0)
    begin = np.zeros(len(words.hashes), dtype=bool)
    for b in words.beginnings:
        begin |= _is_in(b, lexicon.beginnings)
    address = np.flatnonzero(_is_in(words.hashes, _ADDRESS))
    out = np.zeros((len(words.at) - 1, FEATURES))
    for k, (a, b) in enumerate(zip(words.at[:-1], words.at[1:], strict=True)):
        n, p = max(b - a, 1), words.plain[k]
        own = np.flatnonzero(hit[a:b]) + a
        starts = np.flatnonzero(begin[a:b]) + a
        near = 0.0
        if len(own):
            at = np.searchsorted(address, own)
            left = np.where(at > 0, own - address[np.maximum(at - 1, 0)], NEAR + 1) if len(address) else np.full(len(own), NEAR + 1)
            right = np.where(at < len(address), address[np.minimum(at, len(address) - 1)] - own, NEAR + 1) if len(address) else left
            near = float((np.minimum(np.abs(left), np.abs(right)) <= NEAR).mean())
        out[k] = (p[0], len(own) / n, len(np.unique(words.hashes[own])), odds[a:b].sum() / n, odds[a:b].max(initial=0), len(starts) / n, len(np.unique(words.hashes[starts])), near, *p[1:])
    return out


def learn_lexicon(counts: list, toxic: int, other: int, folds: list[int], least: int = LEAST_TEXTS) -> Lexicon:
    """From rows (kind, hash, a, b): in how many toxic and other texts a word stands, by folds; only ``folds`` count."""
    kind, hashes = (np.array([r[k] for r in counts], dtype=np.int64) for k in range(2))
    a, b = (np.array([[r[k][f] for f in folds] for r in counts], dtype=np.float64).reshape(len(counts), len(folds)).sum(axis=1) for k in (2, 3))
    odds = np.log((a + 0.5) / (max(toxic, 1) + 1)) - np.log((b + 0.5) / (max(other, 1) + 1))
    keep = (a >= least) & (odds >= LEAST_LOG_ODDS)

    def of(k: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(keep & (kind == k))
        own = own[np.argsort(hashes[own])]
        return hashes[own].astype(np.uint32), odds[own]

    words, strength = of(0)
    return Lexicon(words, strength, of(1)[0])


@dataclass
class Trees:
    """Trees of one depth in arrays: for each tree and inner node a feature and a bound, and the leaves' values."""

    base: float
    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, depth = np.full(len(x), self.base), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, b, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > b[node])
            out += leaf[node - (len(f))]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, penalty: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on binned features."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > bins:
            values = np.unique(np.quantile(values, np.arange(1, bins) / bins))
            cuts.append(values)
        else:
            cuts.append((values[1:] + values[:-1]) / 2)
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, all_f, all_b, all_l = np.full(len(y), base), [], [], []
    wide = bins + 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, f_, b_ = np.zeros(len(y), dtype=np.int64), np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for d in range(depth):
            first, n = (1 << d) - 1, 1 << d
            best, choice = np.full(n, 1e-9), [(0, np.inf)] * n
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = (node - first) * wide + binned[:, j]
                gs = np.cumsum(np.bincount(cell, weights=g, minlength=n * wide).reshape(n, wide), axis=1)
                hs = np.cumsum(np.bincount(cell, weights=h, minlength=n * wide).reshape(n, wide), axis=1)
                gl, hl, gt, ht = gs[:, : len(c)], hs[:, : len(c)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                k = gain.argmax(axis=1)
                for m in np.flatnonzero(gain[np.arange(n), k] > best):
                    best[m], choice[m] = gain[m, k[m]], (j, c[k[m]])
            f_[first : first + n], b_[first : first + n] = [c[0] for c in choice], [c[1] for c in choice]
            node = 2 * node + 1 + (x[np.arange(len(y)), f_[node]] > b_[node])
        of = node - inner
        leaf = -rate * np.bincount(of, weights=g, minlength=leaves) / (np.bincount(of, weights=h, minlength=leaves) + penalty)
        margin = margin + leaf[of]
        all_f.append(f_)
        all_b.append(b_)
        all_l.append(leaf)
    return Trees(base, np.array(all_f), np.array(all_b), np.array(all_l))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the increasing step function nearest to y, by pooling adjacent violators; linear between points.

    Equal margins are one point with their mean."""
    values, of, weights = np.unique(margin, return_inverse=True, return_counts=True)
    sums = np.bincount(of, weights=y, minlength=len(values))
    blocks: list[list[float]] = []  # weight, sum of y, sum of margins
    for m, w, v in zip(values.tolist(), weights.tolist(), sums.tolist(), strict=True):
        blocks.append([float(w), v, m * w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w_, s, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w_, blocks[-1][1] + s, blocks[-1][2] + t]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 2] / b[:, 0], (b[:, 1] + 0.02) / (b[:, 0] + 0.04)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    points: np.ndarray
    values: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        margin = self.trees.margin(features(read(texts), self.lexicon))
        if not len(self.points):
            return 1 / (1 + np.exp(-margin))
        return np.clip(np.interp(margin, self.points, self.values), 0, 1)


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, lexicon: Lexicon) -> Model:
    """x: features by lexica that were learned without a row's own fold; ``lexicon`` is that of all folds."""
    if not len(y) or y.min() == y.max():
        return Model(Lexicon(), boost(np.zeros((len(y), FEATURES)), y), np.empty(0), np.empty(0))
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            margin[fold == k] = boost(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(lexicon, boost(x, y), *isotonic(margin, y))


def least_texts(held: int) -> int:
    """How many toxic texts a word needs: of words that have so many, there are at most ``held`` / that number, so the
    lexicon has LEXICON_COUNTS / LEAST_TEXTS entries at most, however long the texts are."""
    return max(LEAST_TEXTS, -(-held * LEAST_TEXTS // LEXICON_COUNTS))


def _group(order: np.ndarray) -> int:
    """A number that texts which are mostly alike mostly share: the least hash of neighbouring words."""
    if len(order) < 2:
        return int(order[0]) if len(order) else 0
    return int(shared.mix(order[1:].astype(np.uint64) ^ (order[:-1].astype(np.uint64) << np.uint64(32))).min())


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, most: int = MOST_ROWS) -> Model:
    """Fits on ``labels.toxic`` of at most ``most`` documents outside the held-out fold, each whatever its length.

    The sample is stored. Texts of a group stay in one fold, and one text of a group counts for the lexicon.
    """
    spark = docs.sparkSession

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch):
                w = read(piece.column("text").to_pylist())
                spans = list(zip(w.at[:-1], w.at[1:], strict=True))
                own = np.array([_group(w.hashes[a:b]) for a, b in spans], dtype=np.uint64)
                held = [len(np.unique(w.hashes[a:b])) + len(np.unique(np.concatenate([x[a:b] for x in w.beginnings]))) for a, b in spans]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), pa.array(own.view(np.int64)), pa.array(held, pa.int64())], ["doc_id", "y", "group", "held"])

    with shared.Tables() as t:
        sample = t.store(labelled.sample(docs, labels, "toxic", modulus, remainder, most).select("doc_id", "text", "y"), "toxicity-sample")
        rows = sorted(sample.mapInArrow(groups, "doc_id long, y int, group long, held long").collect())  # four numbers a row of the sample
        ids, y, group, held = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
        if not len(y) or y.min() == y.max():
            return fit(np.zeros((len(y), FEATURES)), y.astype(np.float64), np.zeros(len(y)), Lexicon())
        fold = (shared.mix(group.view(np.uint64) + np.uint64(11)) % np.uint64(FOLDS)).astype(int)
        first = np.zeros(len(rows), dtype=bool)
        first[np.unique(group.view(np.uint64), return_index=True)[1]] = True
        least = least_texts(int(held[first & (y == 1)].sum()))
        place = spark.sparkContext.broadcast({int(i): (int(f), bool(o)) for i, f, o in zip(ids, fold, first, strict=True)})

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in shared.slices(batch):
                    w, own = read(piece.column("text").to_pylist()), piece.column("doc_id").to_pylist()
                    sets: list[tuple[int, int, np.ndarray]] = [(0, 0, np.empty(0, dtype=np.uint32))]
                    for doc, label, a, b in zip(own, piece.column("y").to_pylist(), w.at[:-1], w.at[1:], strict=True):
                        k, counts = place.value[doc]
                        if counts:
                            sets += [(0, 2 * k + label, np.unique(w.hashes[a:b])), (1, 2 * k + label, np.unique(np.concatenate([x[a:b] for x in w.beginnings])))]
                    kind, cell = (np.repeat(np.array([s[k] for s in sets], dtype=np.int32), [len(s[2]) for s in sets]) for k in range(2))
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([s[2] for s in sets]).astype(np.int64)), pa.array(cell)], ["kind", "hash", "cell"])

        totals = np.array([[int((first & (fold == f) & (y == v)).sum()) for f in range(FOLDS)] for v in (1, 0)])
        variants = [[f for f in range(FOLDS) if f != k] for k in range(FOLDS)] + [list(range(FOLDS))]
        count = lambda f, v: F.count_if(F.col("cell") == 2 * f + v)
        counted = sample.mapInArrow(words, "kind int, hash long, cell int").groupBy("kind", "hash").agg(F.array(*[count(f, 1) for f in range(FOLDS)]).alias("a"), F.array(*[count(f, 0) for f in range(FOLDS)]).alias("b"))

        def strength(folds: list[int]):
            a, b = (sum((F.col(c)[f] for f in folds), F.lit(0)) for c in "ab")
            toxic, other = (max(int(totals[v, folds].sum()), 1) + 1 for v in (0, 1))
            return F.when(a >= least, F.log((a + 0.5) / toxic) - F.log((b + 0.5) / other))

        best = F.greatest(*[strength(v) for v in variants])
        strong = counted.withColumn("best", best).filter(F.col("best") > LEAST_LOG_ODDS - 1e-6).orderBy(F.desc("best"), "hash", "kind").drop("best").toArrow()
        strong = list(zip(*[strong.column(c).to_pylist() for c in ("kind", "hash", "a", "b")], strict=True))
        lexica = [learn_lexicon(strong, int(totals[0, v].sum()), int(totals[1, v].sum()), v, least) for v in variants]
        sent = spark.sparkContext.broadcast(lexica)

        def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in shared.slices(batch):
                    w, own = read(piece.column("text").to_pylist()), piece.column("doc_id").to_pylist()
                    folds = np.array([place.value[doc][0] for doc in own])
                    x = np.zeros((len(own), FEATURES))
                    for k in np.unique(folds):
                        x[folds == k] = features(w, sent.value[k])[folds == k]
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

        found = sorted(sample.mapInArrow(dense, "doc_id long, x binary").collect())  # FEATURES numbers a row of the sample
        return fit(np.array([np.frombuffer(r.x) for r in found]).reshape(len(found), FEATURES), y.astype(np.float64), fold, lexica[-1])


def score(docs: DataFrame, model: Model, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null and empty texts get the score of a text without words. Repeated rows give repeated rows, an empty table
    none; a row without doc_id is scored and counts as held out. Extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sent.value.score(piece.column("text").to_pylist()))], ["doc_id", "score"])

    out = shared.text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", labelled.held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below THRESHOLD, with all their columns.

    Null and empty texts get the score of a text without words. Repeated rows share their fate, rows without doc_id are
    scored like others, an empty table stays empty."""
    return shared.keep_scored(docs, lambda texts, m: m.score(texts), model, lambda s: s < THRESHOLD)
