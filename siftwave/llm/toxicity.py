"""Toxicity (8): weak supervision.

Many voters look at each document: lexicon voters (a public word list cut into
groups), voters with the word stems of its language that were mined from two
thirds of the labelled rows, and pattern voters (insulting second person,
masked profanity, shouting, runs of marks).  How often each combination of votes
occurs in each language is counted over all documents.  A generative label model
is fitted to those counts by EM, language by language, as a voter that is silent
in one says nothing about another: accuracies of every voter under the hidden
label, and for voters whose votes stay correlated given the label (by their
conditional mutual information) one joint table per group, so that they aren't
counted twice.  Its posterior labels train a linear classifier over hashed words
and word stems, by gradients over all documents; the limit is calibrated on all
labelled rows of the last third.  The classifier scores every document, and those
over the limit are returned.  No count, model or limit comes from a sample.

Defined results: null and empty texts score as clean and are never returned;
repeated rows count as often as they are there, equal scores (to six digits) are
treated alike, null ids pass through; a document
of a language without labelled rows, or of none, is met by the stems of all; without labels only the
public lexicon and patterns vote; where no voter ever fires, nothing is toxic;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwave.llm.common import Words, cuts, discard, heads, mix, pack_lists, per_batch, raw_bytes, shingles, some, stored
from siftwave.llm.graph import components

_U = np.uint64

#: common English insults and profanity, by sense
LEXICON = [
    "idiot moron stupid dumb imbecile cretin dimwit fool foolish halfwit",
    "loser pathetic worthless useless failure coward weakling",
    "scum trash garbage filth vermin parasite pig rat",
    "clown joke buffoon jerk creep freak weirdo",
    "disgusting revolting vile repulsive gross sickening",
    "bastard bitch asshole dickhead wanker prick slut whore",
    "fuck fucking shit bullshit crap damn arse cunt",
]
_STEMS = (5, 8)  # bytes of a stem
KINDS = [f"stems_{n}" for n in _STEMS] + ["stems_word"]
_BLOCK = 1 << 20  # bytes of text that a task takes up at a time
_ONE = 1 << 20  # weight of a document that has no copies
_GRAIN = float(1 << 44)  # gradients are summed as integers, so in any order


def word_hash(words: list[str]) -> np.ndarray:
    return Words(pa.array(words, pa.string()), lower=True).hash


def stems(w: Words) -> np.ndarray:
    """(lengths x words) hashes of each word's first bytes, 0 for shorter words;
    the last row has the hashes of whole words."""
    out = np.zeros((len(_STEMS) + 1, len(w.hash)), np.uint64)
    if not len(w.hash):
        return out
    size = w.end - w.start
    for i, n in enumerate(_STEMS):
        at = w.start[size >= n]
        acc = np.zeros(len(at), np.uint64)
        for k in range(n):
            acc = acc * _U(257) + w.data[at + k].astype(np.uint64) + _U(1)
        out[i, size >= n] = mix(acc ^ _U(n))
    out[-1] = w.hash
    return out


class Voters:
    """``votes(...)`` gives a bit mask by row: bit j is set where voter j fires.
    ``mined`` has the stems of each kind by language; a row of a language that it
    doesn't have is met by all."""

    def __init__(self, mined: dict[str, list[np.ndarray]]):
        self.langs = sorted(mined)
        self.names = [f"lexicon_{i}" for i in range(len(LEXICON))] + KINDS + ["repeated", "second_person", "masked", "shouting", "marks", "dense"]
        self.words = [np.sort(word_hash(x.split())) for x in LEXICON]
        self.trusted = len(LEXICON) + len(KINDS)
        self.mined = []
        for k in range(len(KINDS)):
            value = np.concatenate([np.zeros(0, np.uint64), *[mined[x][k] for x in self.langs]])
            owner = np.repeat(np.arange(len(self.langs)), [len(mined[x][k]) for x in self.langs])
            order = np.lexsort((owner, value))
            self.mined.append((value[order], owner[order]))
        self.person = np.sort(word_hash(["you", "your", "du", "ihr", "tu", "vous", "eres"]))

    def index(self, lang: pa.Array) -> np.ndarray:
        """Of every row the place of its language, the number of languages where there is none."""
        return np.asarray(pc.fill_null(pc.index_in(lang, pa.array(self.langs, pa.string())), len(self.langs)))

    def _stems(self, hashes: np.ndarray, at: np.ndarray, kind: int) -> np.ndarray:
        value, owner = self.mined[kind]
        out = np.zeros(len(hashes), bool)
        first = np.searchsorted(value, hashes)
        for d in range(len(self.langs)):  # a stem may be of several languages
            k = np.minimum(first + d, max(len(value) - 1, 0))
            same = (value[k] == hashes) & (first + d < len(value)) if len(value) else out
            if not same.any():
                break
            out |= same & ((owner[k] == at) | (at == len(self.langs)))
        return out

    def votes(self, col: pa.Array, lang: np.ndarray, w: Words, s: np.ndarray) -> np.ndarray:
        rows = len(w.off) - 1
        out = np.zeros(rows, np.int64)
        hits = np.zeros(len(w.hash), bool)
        for j, table in enumerate(self.words):
            own = _isin(w.hash, table)
            hits |= own
            out |= (np.bincount(w.row[own], minlength=rows) > 0).astype(np.int64) << j
        j = len(self.words)
        stem_hits = np.zeros(len(w.hash), bool)
        for kind in range(len(KINDS)):
            own = self._stems(s[kind], lang[w.row], kind)
            stem_hits |= own
            out |= (np.bincount(w.row[own], minlength=rows) > 0).astype(np.int64) << j
            j += 1
        hits |= stem_hits
        near = np.zeros(len(w.hash), bool)
        person = _isin(w.hash, self.person)
        for d in (1, 2, 3):
            near[d:] |= person[:-d] & hits[d:] & (w.row[:-d] == w.row[d:]) if len(hits) > d else False
        raw, base = raw_bytes(col, lower=False)
        span = np.maximum(np.diff(base), 1)
        count = lambda mask: _per_row(mask, base)
        upper, lower = count((raw >= 65) & (raw <= 90)), count((raw >= 97) & (raw <= 122))
        bang = raw == 33
        two = bang.copy()
        two[1:] &= bang[:-1]
        two[:1] = False
        star = raw == 42
        letter = ((raw >= 97) & (raw <= 122)) | ((raw >= 65) & (raw <= 90))
        masked = np.zeros(len(raw), bool)
        if len(raw) > 4:  # f**k, s***t
            masked[2:-2] = letter[:-4] & star[1:-3] & star[2:-2] & (letter[3:-1] | letter[4:])
        extra = [
            np.bincount(w.row[stem_hits], minlength=rows) > 1,
            np.bincount(w.row[near], minlength=rows) > 0,
            count(masked) > 0,
            upper > 2 * lower,
            count(two) * 100 > span,
            np.bincount(w.row[hits], minlength=rows) * 40 > np.maximum(np.diff(w.first), 1),
        ]
        for mask in extra:
            out |= mask.astype(np.int64) << j
            j += 1
        return out


def _per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), off))


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(x):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


def _sketches(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key), four keys a text: near copies share one, by min-hashes of word trigrams."""
    sh, row, _ = shingles(Words(col), 3)
    if not len(sh):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = heads(row)[:-1]
    least = [np.minimum.reduceat(mix(sh * _U(2 * k + 3) + _U(k)), at) for k in range(8)]
    return np.tile(row[at], 4), np.concatenate([mix(least[k]) + least[k + 1] * _U(k + 1) for k in range(0, 8, 2)])


def _copies(rows: DataFrame) -> DataFrame:
    """Of (node, text, lang) the nodes of texts that have near copies in their language,
    and how many rows such a group has."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, key = _sketches(batch.column(1))
        lang = np.asarray(batch.column(2)).view(np.uint64)[row]
        return pa.RecordBatch.from_arrays([pa.array(mix(key ^ lang).view(np.int64)), batch.column(0).take(pa.array(row))], ["key", "node"])

    keys = rows.select("node", "text", F.xxhash64("lang").alias("lang")).mapInArrow(per_batch(run), "key bigint, node bigint")
    pairs = keys.select("node", F.lag("node").over(Window.partitionBy("key").orderBy("node")).alias("before")).where("before <> node")
    root = components(pairs, "before", "node").withColumnRenamed("id", "node")
    of = stored(rows.groupBy("node").count().join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    size = of.groupBy("root").agg(F.sum("count").alias("copies")).where("copies > 1")
    return of.join(size, "root").select("node", "copies")


def _summed(parts: list) -> list[np.ndarray]:
    """Of (lang, kind, stem, bad, good) the sums by the first three."""
    lang, kind, stem, bad, good = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((stem, kind, lang))
    at = heads(lang[order], kind[order], stem[order])[:-1] if len(order) else order
    return [*[x[order][at] for x in (lang, kind, stem)], *[np.add.reduceat(x[order], at) if len(at) else x for x in (bad, good)]]


def _counted(langs: list[str], most: int = 1 << 20):
    """Of (text, lang, bad, weight) the weight of toxic and of clean documents that have
    a stem, by language and kind; a task holds about ``most`` sums at once."""

    def block(batch: pa.RecordBatch):
        w = Words(batch.column(0))
        lang = np.asarray(pc.index_in(batch.column(1), pa.array(langs, pa.string())))
        bad, weight = np.asarray(batch.column(2)), np.asarray(batch.column(3))
        for kind, h in enumerate(stems(w)):
            order = np.lexsort((h, w.row))
            h, row = h[order], w.row[order]
            new = h != 0
            new[1:] &= (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
            yield lang[row], np.full(len(h), kind, np.int32), h, np.where(bad[row], weight[row], 0), np.where(bad[row], 0, weight[row])

    def out(parts: list) -> pa.RecordBatch:
        lang, kind, stem, bad, good = parts
        return pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(kind), pa.array(stem.view(np.int64)), pa.array(bad), pa.array(good)], ["lang", "kind", "stem", "bad", "good"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for a, b in cuts(batch.column(0), _BLOCK):
                held.append(_summed(list(block(batch.slice(a, b - a)))))
                rows += len(held[-1][0])
                if rows > most:
                    held = [_summed(held)]
                    rows = len(held[0][0])
                    if 2 * rows > most:
                        yield out(held[0])
                        held, rows = [], 0
        if held:
            yield out(_summed(held))

    return run


def mine(rows: DataFrame, most: int = 500, max_broadcast: int = 2_000_000) -> dict[str, list[np.ndarray]]:
    """Stem lexicons from all labelled rows (id, text, lang, toxic): by language and kind,
    the ``most`` stems of highest G-squared (over 18, so more than chance) of those
    30 times as common among toxic documents as among clean ones.  Near copies
    count as one document, or the words of one with many copies would pass; who has
    copies is broadcast up to ``max_broadcast`` rows (counted)."""
    rows = rows.where("text is not null and lang <> ''").withColumn("node", F.xxhash64("id", "lang", "text"))
    copies = stored(_copies(rows))
    rows = rows.join(F.broadcast(copies) if copies.count() <= max_broadcast else copies, "node", "left")
    rows = rows.select("text", "lang", (F.col("toxic") == 1).alias("bad"), F.greatest(F.round(F.lit(_ONE) / F.coalesce("copies", F.lit(1))), F.lit(1)).cast("bigint").alias("weight"))
    totals = rows.groupBy("lang").agg(F.sum(F.when(F.col("bad"), F.col("weight")).otherwise(0)).alias("n"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("weight"))).alias("m")).collect()
    langs = sorted(r["lang"] for r in totals)
    out = {x: [np.zeros(0, np.uint64) for _ in KINDS] for x in langs}
    if not langs:
        return out
    total = rows.sparkSession.createDataFrame([(langs.index(r["lang"]), max(r["n"] / _ONE, 1.0), max(r["m"] / _ONE, 1.0)) for r in totals], "lang int, n double, m double")
    found = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(_counted(langs), "lang int, kind int, stem bigint, bad bigint, good bigint").groupBy("lang", "kind", "stem")
    found = found.agg((F.sum("bad") / _ONE).alias("b"), (F.sum("good") / _ONE).alias("g")).join(F.broadcast(total), "lang").where("b / n > 30 * (g + 0.5) / m")
    term = lambda x, size: F.when(x > 0, x * F.log(x * (F.col("n") + F.col("m")) / (size * (F.col("b") + F.col("g"))))).otherwise(0.0)
    found = found.withColumn("g2", 2 * (term(F.col("b"), F.col("n")) + term(F.col("g"), F.col("m")))).where("g2 > 18")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("g2"), "stem"))).where(F.col("rank") <= most)
    got = best.select("lang", "kind", "stem").toPandas()
    for (lang, kind), part in got.groupby(["lang", "kind"]):
        out[langs[lang]][kind] = np.sort(part["stem"].to_numpy(np.int64).view(np.uint64))
    return out


class LabelModel:
    """Two classes; independent groups of voters, each with a joint table."""

    def __init__(self, masks: np.ndarray, counts: np.ndarray, n: int, prior: float = 0.1, trusted: np.ndarray | None = None, rounds: int = 60):
        bits = (masks[:, None] >> np.arange(n)) & 1
        self.groups = [[j] for j in range(n)]
        # start: a document is as toxic as the trusted voters firing on it say
        post = np.where(bits[:, trusted].any(axis=1), 0.9, 0.02) if trusted is not None else np.full(len(masks), prior)
        # a voter can't fire without cause: where no trusted one does, the label stays likely clean
        self.top = np.where(bits[:, trusted].any(axis=1), 1.0, 0.05) if trusted is not None else np.ones(len(masks))
        self.trusted = trusted
        post = self._em(bits, counts, post, rounds)
        merged = self._correlated(bits, counts, post)
        if merged != self.groups:
            self.groups = merged
            post = self._em(bits, counts, post, rounds)
        self.post = post

    def _cells(self, bits: np.ndarray, group: list[int]) -> np.ndarray:
        return (bits[:, group] << np.arange(len(group))).sum(axis=1)

    def _em(self, bits, counts, post, rounds):
        cells = [self._cells(bits, g) for g in self.groups]
        for _ in range(rounds):
            self.prior = np.clip((counts * post).sum() / max(counts.sum(), 1), 1e-4, 0.5)
            self.tables = []
            odds = np.full(len(post), np.log(self.prior / (1 - self.prior)))
            for g, c in zip(self.groups, cells):
                k = 1 << len(g)
                one = np.bincount(c, counts * post, k) + 0.1
                zero = np.bincount(c, counts * (1 - post), k) + 0.1
                ratio = np.log(one / one.sum()) - np.log(zero / zero.sum())
                self.tables.append(ratio)
                odds += ratio[c]
            new = np.minimum(1 / (1 + np.exp(-np.clip(odds, -30, 30))), self.top)
            if np.abs(new - post).max() < 1e-6:
                return new
            post = new
        return post

    def _correlated(self, bits, counts, post, least: float = 0.02, most: int = 4):
        """Voters joined where their conditional mutual information is high."""
        n = bits.shape[1]
        pairs = []
        for i in range(n):
            for j in range(i + 1, n):
                info = 0.0
                for weight in (counts * post, counts * (1 - post)):
                    p = np.bincount(bits[:, i] * 2 + bits[:, j], weight, 4).reshape(2, 2)
                    total = p.sum()
                    if total <= 0:
                        continue
                    q = p / total
                    e = q.sum(axis=1, keepdims=True) @ q.sum(axis=0, keepdims=True)
                    ok = q > 0
                    info += total / counts.sum() * float((q[ok] * np.log(q[ok] / e[ok])).sum())
                if info > least:
                    pairs.append((-info, i, j))
        of = {j: [j] for j in range(n)}
        for _, i, j in sorted(pairs):
            if of[i] is not of[j] and len(of[i]) + len(of[j]) <= most:
                both = sorted(of[i] + of[j])
                for v in both:
                    of[v] = both
        return [list(x) for x in dict.fromkeys(tuple(x) for x in of.values())]

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        bits = (masks[:, None] >> np.arange(sum(map(len, self.groups)))) & 1
        odds = np.full(len(masks), np.log(self.prior / (1 - self.prior)))
        for g, t in zip(self.groups, self.tables):
            odds += t[self._cells(bits, g)]
        top = np.where(bits[:, self.trusted].any(axis=1), 1.0, 0.05) if self.trusted is not None else 1.0
        return np.minimum(1 / (1 + np.exp(-np.clip(odds, -30, 30))), top)


class Linear:
    """Sparse logistic regression (L1, proximal AdaGrad); a document's features
    are the hashed words and stems it holds, each once, in ``dims`` slots."""

    def __init__(self, dims: int = 1 << 20):
        self.dims, self.weight, self.bias = dims, np.zeros(dims, np.float32), 0.0

    def slots(self, w: Words, s: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row, slot), each pair once; only slots of some weight unless ``every``."""
        rows, slots = [], []
        for h in s:
            slot = (h & _U(self.dims - 1)).view(np.int64)  # dims is a power of two
            keep = np.flatnonzero(h != 0) if every else np.flatnonzero((h != 0) & (self.weight[slot] != 0))
            rows.append(w.row[keep])
            slots.append(slot[keep])
        key = np.concatenate(rows) * self.dims + np.concatenate(slots)
        key.sort()
        key = key[heads(key)[:-1]] if len(key) else key
        return key // self.dims, key % self.dims

    def score(self, row, slot, rows: int) -> np.ndarray:
        """To six digits, so that tables of them stay small."""
        z = np.bincount(row, self.weight[slot], rows) + self.bias
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)


_FEATS = "key bigint, low binary, high binary"


def _packed(key: np.ndarray, row: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_FEATS``: the steps from slot to slot of each document in three bytes, which
    compress to less than half of the slots' own size."""
    off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(key)))])
    step = np.diff(slot, prepend=0)
    at = off[:-1][np.diff(off) > 0]
    step[at] = slot[at]
    return pa.RecordBatch.from_arrays([pa.array(key), pack_lists(step.astype(np.uint8), off), pack_lists((step >> 8).astype(np.uint16), off)], ["key", "low", "high"])


def _listed(batch: pa.RecordBatch, most: int = 1 << 17):
    """(key, off, slot) of rows of ``_FEATS``, row i's slots at ``off[i]:off[i + 1]``; about
    ``most`` slots at a time, which caches hold."""
    for a, b in cuts(batch.column(1), most):
        part = batch.slice(a, b - a)
        low, off = raw_bytes(part.column(1), lower=False)
        slot = raw_bytes(part.column(2), lower=False)[0].view(np.uint16).astype(np.int64)
        slot <<= 8
        slot |= low
        np.cumsum(slot, out=slot)
        if len(slot):
            slot -= np.repeat(np.where(off[:-1] > 0, slot[np.maximum(off[:-1] - 1, 0)], 0), np.diff(off))
        yield np.asarray(part.column(0)), off, slot


class Targets:
    """What documents of a key (language and votes) are fitted to, and their weight:
    toxic and other ones weigh the same in sum."""

    def __init__(self, key: np.ndarray, p: np.ndarray, count: np.ndarray):
        order = np.argsort(key)
        self.key, self.p = key[order], p[order]
        weight, toxic = np.abs(2 * self.p - 1) + 1e-3, self.p > 0.5
        total = [max((weight * count[order])[x].sum(), 1e-9) for x in (toxic, ~toxic)]
        weight = np.where(toxic, weight / total[0], weight / total[1])
        self.weight = weight / max((weight * count[order]).sum(), 1e-9)

    def of(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, key)


def _train(linear: Linear, feats: DataFrame, targets: Targets, rounds: int, small: int, rate: float = 0.3, l1: float = 1e-3) -> None:
    """Fits to all rows of ``feats``, each round a sum of gradients over all of them, made in
    as many tasks as there are cores.  The sums are of integers, so of one result however
    rows are spread; up to ``small`` slots (counted) the driver makes the same sums itself."""
    feats = feats.coalesce(feats.sparkSession.sparkContext.defaultParallelism)
    dims = linear.dims
    parts = lambda batches: (x for batch in batches for x in _listed(batch))

    def weigh(batches):
        out = np.zeros(dims)
        for key, off, slot in parts(batches):
            np.add.at(out, slot, np.repeat(np.rint(targets.weight[targets.of(key)] * _GRAIN), np.diff(off)))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at].astype(np.int64))], ["slot", "v"])

    # a slot of less weight than ``l1`` would stay at 0: no gradient of it outweighs that
    used = feats.mapInArrow(weigh, "slot bigint, v bigint").groupBy("slot").agg(F.sum("v").alias("v")).where(F.col("v") > int(l1 * _GRAIN)).select("slot").toPandas()
    used = np.sort(used["slot"].to_numpy(np.int64))
    w, g2, b2 = np.zeros(len(used)), np.full(len(used), 1e-6), 1e-6
    held = feats.toArrow().to_batches() if (feats.agg(F.sum(F.length("low"))).first()[0] or 0) <= small else None
    for _ in range(rounds):
        bias = linear.bias

        def gradient(batches, w=w, bias=bias):
            weight, out, total = np.zeros(dims), np.zeros(dims), 0.0
            weight[used] = w
            for key, off, slot in parts(batches):
                of = targets.of(key)
                z = np.add.reduceat(weight[slot], off[:-1]) + bias  # every row has slots
                err = np.rint((1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets.p[of]) * targets.weight[of] * _GRAIN)
                np.add.at(out, slot, np.repeat(err, np.diff(off)))
                total += err.sum()
            yield pa.RecordBatch.from_arrays([pa.array([np.append(out[used], total).tobytes()], pa.binary())], ["g"])

        sums = gradient(held) if held is not None else feats.mapInArrow(gradient, "g binary").toArrow().to_batches()
        g = sum((np.frombuffer(x, np.float64) for part in sums for x in part.column(0).to_pylist()), np.zeros(len(w) + 1)) / _GRAIN
        g2 += g[:-1] ** 2
        step = rate / np.sqrt(g2)
        w = w - step * g[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b2 += g[-1] ** 2
        linear.bias -= float(rate * g[-1] / np.sqrt(b2))
    linear.weight[used] = w


class Model:
    def __init__(self, voters, labels, linear, limit):
        self.voters, self.labels, self.linear, self.limit = voters, labels, linear, limit


def _slim(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))


def _known(slim: DataFrame, labels: DataFrame, id_col: str, max_broadcast: int) -> DataFrame:
    """(id, text, lang, toxic, held) of all rows that have a label: a third, by a hash of
    the text, is held back to calibrate the limit."""
    marks = labels.select(F.col(id_col).cast("bigint").alias("id"), "toxic").where("toxic is not null and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    marks = stored(marks)
    known = some(slim.where("text is not null"), marks, max_broadcast).select("id", "text", "lang", "toxic", (F.pmod(F.xxhash64("text"), F.lit(3)) == 2).alias("held"))
    # read again where that takes no shuffle
    return known if marks.count() <= max_broadcast else stored(known)


def fit(
    docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    precision: float = 0.95, rounds: int = 40, small: int = 4_000_000, max_broadcast: int = 2_000_000,
) -> Model:
    """From all rows.  The driver sums gradients itself up to ``small`` slots, and labels are
    broadcast up to ``max_broadcast`` (both counted), with the same result."""
    slim = _slim(docs, id_col, text_col, lang_col)
    known = _known(slim, labels, id_col, max_broadcast) if labels is not None else None
    voters = Voters(mine(known.where("not held"), max_broadcast=max_broadcast) if known is not None else {})
    n, trusted, linear = len(voters.names), np.arange(voters.trusted), Linear()

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, lang = Words(batch.column(0)), voters.index(batch.column(1))
        s = stems(w)
        return _packed(lang.astype(np.int64) << n | voters.votes(batch.column(0), lang, w, s), *linear.slots(w, s, every=True))

    feats = stored(slim.select("text", "lang").mapInArrow(per_batch(look, text=0), _FEATS))
    # at most 2^16 masks a language that has labelled rows; texts without words aren't fitted to
    seen = feats.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum((F.length("low") > 0).cast("bigint")).alias("texts")).toPandas()
    key, counts = seen["key"].to_numpy(np.int64), seen["n"].to_numpy(float)
    lang, masks = key >> n, key & ((1 << n) - 1)
    if not (masks != 0).any():
        return Model(voters, None, linear, 2.0)
    fires = (masks & ((1 << len(trusted)) - 1)) != 0
    label = {k: LabelModel(masks[lang == k], counts[lang == k], n, trusted=trusted) for k in np.unique(lang[fires]).tolist()}
    p = np.full(len(masks), 0.02)
    for k, model in label.items():
        p[lang == k] = model.posterior(masks[lang == k])
    targets = Targets(key, p, seen["texts"].to_numpy(float))
    texts = feats.where("length(low) > 0")
    _train(linear, texts, targets, rounds, small)

    scored = None
    if known is not None:
        def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
            w = Words(batch.column(0))
            score = linear.score(*linear.slots(w, stems(w)), batch.num_rows)
            return pa.RecordBatch.from_arrays([pa.array(np.rint(score * 1e6).astype(np.int32)), batch.column(1)], ["score", "bad"])

        held = known.select("text", (F.col("toxic") == 1).alias("bad"), "held")
        by = {(r["bad"], r["held"]): r["count"] for r in held.groupBy("bad", "held").count().collect()}
        rate = [sum(by.get((bad, x), 0) for x in (True, False)) / max(by.get((bad, True), 0), 1) for bad in (True, False)]
        if any(by.get((bad, True)) for bad in (True, False)):
            # at most a million scores
            scored = held.where("held").select("text", "bad").mapInArrow(per_batch(judged, text=0), "score int, bad boolean")
            scored = scored.groupBy("score").agg(F.sum(F.col("bad").cast("bigint")).alias("bad"), F.count(F.lit(1)).alias("n"))
            scored = scored.select("score", (F.col("bad") * rate[0]).alias("bad"), (F.col("bad") * rate[0] + (F.col("n") - F.col("bad")) * rate[1]).alias("n"))
    if scored is None:
        # without labels: where the posteriors reach the precision wanted
        def supposed(batches):
            for key, off, slot in (x for batch in batches for x in _listed(batch)):
                score = linear.score(np.repeat(np.arange(len(key)), np.diff(off)), slot, len(key))
                bad = np.rint(targets.p[targets.of(key)] * 1e6).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.rint(score * 1e6).astype(np.int32)), pa.array(bad)], ["score", "bad"])

        scored = texts.mapInArrow(supposed, "score int, bad bigint").groupBy("score").agg((F.sum("bad") / 1e6).alias("bad"), F.count(F.lit(1)).cast("double").alias("n"))
    got = scored.toPandas()
    discard(feats)
    return Model(voters, label, linear, _limit(got["score"].to_numpy(np.int64) / 1e6, got["bad"].to_numpy(float), got["n"].to_numpy(float), precision))


def _limit(score: np.ndarray, bad: np.ndarray, every: np.ndarray, precision: float) -> float:
    """The lowest limit, at least 0.5, over which ``precision`` is held, of distinct scores
    with the rows of each and the toxic ones among them: midway between the last score
    that holds it and the next, as few rows leave a wide gap there."""
    order = np.argsort(-score)
    right = np.cumsum(bad[order]) / np.maximum(np.cumsum(every[order]), 1e-12)
    good = np.flatnonzero(right >= precision)
    if not len(good):
        return 2.0
    last = score[order[good[-1]]]
    after = score[order[good[-1] + 1]] if good[-1] + 1 < len(order) else 0.0
    return float(max((last + after) / 2, 0.5))


def flag(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, score, voters) of the documents over the limit; ``voters`` names those that fired."""
    names = np.array(model.voters.names)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = Words(batch.column(1))
        s = stems(w)
        score = model.linear.score(*model.linear.slots(w, s), batch.num_rows)
        keep = np.flatnonzero((score >= model.limit) & (np.diff(w.first) > 0))
        if not len(keep):
            return None
        # only what is returned is voted on once more
        text, lang = (batch.column(k).take(pa.array(keep)) for k in (1, 2))
        w = Words(text)
        mask = model.voters.votes(text, model.voters.index(lang), w, stems(w))
        fired = [names[((m >> np.arange(len(names))) & 1).astype(bool)].tolist() for m in mask.tolist()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(score[keep]), pa.array(fired, pa.list_(pa.string()))], ["doc_id", "score", "voters"])

    return _slim(docs, id_col, text_col, lang_col).mapInArrow(per_batch(run), "doc_id bigint, score double, voters array<string>")
