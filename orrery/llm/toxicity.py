"""Toxicity by a weighted finite-state pattern grammar.

A clause becomes a string of symbols: insult and threat words with a weight, target,
negation and reported-speech words, gaps. Five weighted transducers read it, each a
factor on the weight of an insult or threat:

* insult: one that follows another at once weighs more;
* threat: a threat word alone weighs little ("kill the process"), one with its target
  after it ("I will kill you") or before it ("you will be killed") much;
* target: an insult with a target weighs more, before ("you idiot") or after it;
* negation: one close before lowers what follows;
* reported speech: it lowers insults and threats on either side of it in its clause.

Left to right all five are composed into one table, and right to left those that look
at what follows; a clause's score is the sum of weights times both outputs along it.

Weights of insult stems are learned: word prefixes (and whole words) of labelled
texts, kept where their share among toxic texts is significant. Clause scores give a
text four features, and a logistic curve fitted on other labelled texts calibrates
them. Labels are a bounded sample; scoring covers every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import arrow_map, slabs, text_buffers

U = np.uint64

# Seed words of each transducer, before any label is seen.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile fool vermin filth garbage subhuman bastard".split()
THREATS = "kill murder hurt shoot shot stab stabbed stabbing destroy strangle strangled burn lynch exterminate exterminated töten getötet umbringen umgebracht tuer tué matar".split()
TARGETS = "you your yours yourself u ur they them their he she his her du dich dein sie ihr tu te toi vous votre ils elle tú usted ustedes vosotros".split()
NEGATIONS = "not no never neither nor without cannot don isn aren wasn weren doesn didn won wouldn shouldn couldn ain don’t isn’t aren’t wasn’t weren’t doesn’t didn’t won’t wouldn’t shouldn’t couldn’t can’t ain’t dont isnt arent wasnt nicht kein keine nie niemals pas jamais aucun sin nunca ni".split()
REPORTS = "said says say told wrote writes quoted quote quotes claimed claims reported according sagte sagt schrieb laut dit disait selon écrit dijo dice escribió según".split()
#: Endings of seed insults and threats.
ENDINGS = ("", "s", "es", "d", "ed", "er", "ers", "ing")
SEED_WEIGHT = 3.0

NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, GAP = range(7)
#: Words between a negation and what it negates, at most.
NEGATION_REACH = 4


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) -> (next state, factor on the weight put out); others stay, factor 1."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, float]]

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 1.0))


INSULT_T = Transducer(2, {(0, INSULT): (1, 1.0), (1, INSULT): (1, 1.2), (1, GAP): (0, 1.0)})
THREAT_T = Transducer(2, {(0, TARGET): (1, 1.0), (1, THREAT): (1, 2.0)})
TARGET_T = Transducer(2, {(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.5)})
NEGATION_T = Transducer(2, {(0, NEGATION): (1, 1.0), (1, GAP): (0, 1.0), (1, INSULT): (0, 0.3), (1, THREAT): (0, 0.3)})
REPORT_T = Transducer(2, {(0, REPORT): (1, 1.0), (1, INSULT): (1, 0.6), (1, THREAT): (1, 0.6)})
#: The same from right to left: what stands after the word.
THREAT_BACK = Transducer(2, {(0, TARGET): (1, 1.0), (0, THREAT): (0, 0.3), (1, THREAT): (1, 1.5)})
TARGET_BACK = Transducer(2, {(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.2), (1, GAP): (0, 1.0)})
FORWARD = (INSULT_T, THREAT_T, TARGET_T, NEGATION_T, REPORT_T)
BACKWARD = (THREAT_BACK, TARGET_BACK, REPORT_T)


def compose(parts: tuple[Transducer, ...]) -> tuple[list[list[int]], list[list[float]]]:
    """Next-state and factor tables of the composition, from start state 0."""
    index, queue, nxt, out = {(0,) * len(parts): 0}, [(0,) * len(parts)], [], []
    for state in queue:
        row, factors = [], []
        for symbol in range(7):
            steps = [p.step(s, symbol) for p, s in zip(parts, state)]
            to = tuple(s for s, _ in steps)
            if to not in index:
                index[to] = len(index)
                queue.append(to)
            row.append(index[to])
            factors.append(float(np.prod([f for _, f in steps])))
        nxt.append(row)
        out.append(factors)
    return nxt, out


@lru_cache(maxsize=1)
def grammar():
    """Tables of both compositions."""
    return compose(FORWARD), compose(BACKWARD)


def read_clause(symbols: list[int], weights: list[float]) -> float:
    """Score of a clause: each insult's and threat's weight times the outputs of both readings."""
    (nxt, out), (back, back_out) = grammar()
    factor, state = [1.0] * len(symbols), 0
    for k in range(len(symbols) - 1, -1, -1):
        factor[k] = back_out[state][symbols[k]]
        state = back[state][symbols[k]]
    score, state = 0.0, 0
    for s, w, f in zip(symbols, weights, factor):
        if s == INSULT or s == THREAT:
            score += w * f * out[state][s]
        state = nxt[state][s]
    return score


_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_CLAUSE = np.zeros(256, bool)
_CLAUSE[list(b".!?;:|\n")] = True
PREFIXES = tuple(range(3, 13))
_WHOLE = U(0xA5A5A5A5A5A5A5A5)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8."""
    low = grams.LOWER[data]
    if len(data) > 1:
        lead = np.flatnonzero(data[:-1] == 0xC3)
        tail = data[lead + 1]
        up = lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)]
        low[up + 1] += 0x20
    return low


class _Scan:
    """Letter words of a run of texts: bounds, document, and prefix sums for hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.low, self.offs = fold(data), offs
        letter = _LETTER[self.low]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        before = np.concatenate([[False], letter[:-1]])
        after = np.concatenate([letter[1:], [False]])
        self.start = np.flatnonzero(letter & (~before | edge[:-1]))
        self.end = np.flatnonzero(letter & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.sums = grams.prefix_sums(self.low)
        self.edge = edge

    def whole(self) -> np.ndarray:
        return grams.slice_hashes(self.sums, self.start, self.end) ^ _WHOLE

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, hash) of the words of n bytes or more."""
        who = np.flatnonzero(self.end - self.start >= n)
        return who, grams.slice_hashes(self.sums, self.start[who], self.start[who] + n)


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(grams.slice_hashes(grams.prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0] ^ _WHOLE)


@dataclass
class Lexicon:
    """Hashes of words and prefixes in ascending order, with symbol and weight."""

    keys: np.ndarray
    symbols: np.ndarray
    weights: np.ndarray

    @staticmethod
    def build(learned: dict[int, float]) -> "Lexicon":
        table: dict[int, tuple[int, float]] = {}
        for symbol, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)):
            for w in words:
                for end in ENDINGS if symbol in (THREAT, INSULT) else ("",):
                    table[word_hash(w + end)] = (symbol, SEED_WEIGHT)
        for h, weight in learned.items():
            if table.get(h, (INSULT, 0.0))[0] == INSULT:
                table[h] = (INSULT, max(weight, table.get(h, (0, 0.0))[1]))
        keys = np.array(sorted(table), np.uint64)
        return Lexicon(keys, np.array([table[int(k)][0] for k in keys], np.int8), np.array([table[int(k)][1] for k in keys]))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, at, -1)


N_FEATURES = 4


def features(data: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """(documents, 4): log sum of clause scores, largest clause score, log matched clauses, matches per root of words."""
    out = np.zeros((len(offs) - 1, N_FEATURES))
    if not len(data):
        return out
    scan = _Scan(data, offs)
    n = len(scan.start)
    symbol, weight = np.zeros(n, np.int8), np.zeros(n)
    hit = lexicon.find(scan.whole())
    m = hit >= 0
    symbol[m], weight[m] = lexicon.symbols[hit[m]], lexicon.weights[hit[m]]
    for size in PREFIXES:
        who, h = scan.prefix(size)
        hit = lexicon.find(h)
        m = hit >= 0
        who, hit = who[m], hit[m]
        better = (symbol[who] == NONE) | ((symbol[who] == INSULT) & (lexicon.weights[hit] > weight[who]))
        symbol[who[better]], weight[who[better]] = INSULT, lexicon.weights[hit[better]]
    clause = np.cumsum(_CLAUSE[scan.low] | scan.edge[:-1])[scan.start] if n else np.zeros(0, np.int64)
    hot = np.unique(clause[(symbol == INSULT) | (symbol == THREAT)])
    words = np.bincount(scan.doc, minlength=len(offs) - 1)
    if not len(hot):
        return out
    take = np.flatnonzero((symbol != NONE) & np.isin(clause, hot))
    total: dict[int, float] = {}
    most: dict[int, float] = {}
    count: dict[int, int] = {}
    now, of, last = -1, -1, 0
    symbols: list[int] = []
    weights: list[float] = []

    def close() -> None:
        if of >= 0 and (score := read_clause(symbols, weights)) > 0:
            total[of] = total.get(of, 0.0) + score
            most[of] = max(most.get(of, 0.0), score)
            count[of] = count.get(of, 0) + 1

    for w, c, s, v, d in zip(take.tolist(), clause[take].tolist(), symbol[take].tolist(), weight[take].tolist(), scan.doc[take].tolist()):
        if c != now:
            close()
            now, of, symbols, weights = c, d, [], []
        elif w - last > NEGATION_REACH:
            symbols.append(GAP)
            weights.append(0.0)
        symbols.append(s)
        weights.append(v)
        last = w
    close()
    for d in total:
        out[d] = (np.log1p(total[d]), min(most[d], 10.0), np.log1p(count[d]), min(3.0, count[d] / np.sqrt(words[d] + 1)))
    return out


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.beta[1:] + self.beta[0]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with the intercept first) by Newton steps."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    a = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], 1)
    beta = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(beta))
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def _count_features(among: np.ndarray | None, slab: int):
    """Texts with each word or prefix, by label; among: only these hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            toxic = rows.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offs = text_buffers(rows.column(0))
            for lo, hi, part, at in slabs(data, offs, slab):
                scan = _Scan(part, at)
                keys, docs = [scan.whole()], [scan.doc]
                for size in PREFIXES:
                    who, h = scan.prefix(size)
                    keys.append(h)
                    docs.append(scan.doc[who])
                key, doc = np.concatenate(keys), np.concatenate(docs)
                if among is not None:
                    spot = np.searchsorted(among, key)
                    spot[spot == len(among)] = 0
                    m = among[spot] == key
                    key, doc = key[m], doc[m]
                if not len(key):
                    continue
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
                key, doc = key[new], doc[new]
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                tox = np.add.reduceat(toxic[lo:hi][doc], starts)
                every = np.diff(np.append(starts, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(key[starts].view(np.int64)), pa.array(tox), pa.array(every)], names=["key", "tox", "n"])

    return run


def _featurise(lexicon: Lexicon, slab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offs = text_buffers(rows.column(0))
            for lo, hi, part, at in slabs(data, offs, slab):
                x = features(part, at, lexicon)
                yield pa.RecordBatch.from_arrays([rows.column(1).slice(lo, hi - lo), *(pa.array(x[:, k]) for k in range(N_FEATURES))], names=["toxic", *(f"f{k}" for k in range(N_FEATURES))])

    return run


def learn(labelled: DataFrame, *, most_rows: int = 20_000, most_features: int = 5_000, few: int = 100, slab: int = 2 << 20) -> Model:
    """Fit on rows of text and toxic (0 or 1; other rows are left out).

    Of the rows, about ``most_rows`` are used, chosen by a hash of the text; a fifth
    of them calibrates and the rest teaches the lexicon. With fewer than ``few`` toxic
    rows all of them do both. Without both classes the seed words and a fixed curve
    remain. Repeated rows count as often as they stand; stems with equal weight are
    taken in the order of their hashes.
    """
    rows = labelled.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    bucket = F.pmod(F.xxhash64("text", F.lit("toxicity")), F.lit(1_000_000))
    rows = rows.withColumn("bucket", bucket)
    # persist() recomputes what a lost executor held; the rows are a bounded sample.
    total = rows.count()
    share = min(1.0, most_rows / max(1, total))
    rows = rows.where(F.col("bucket") < int(share * 1_000_000)).persist()
    sparse = rows.where("toxic = 1").count() < few
    teach = rows.where("true" if sparse else "bucket % 5 <> 0").select("text", "toxic")
    tune = rows.where("true" if sparse else "bucket % 5 = 0").select("text", "toxic")
    n_tox, n_all = teach.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    learned: dict[int, float] = {}
    if 0 < n_tox < n_all:
        counted = lambda df, among: arrow_map(df, _count_features(among, slab), "key long, tox long, n long").groupBy("key").agg(F.sum("tox").alias("tox"), F.sum("n").alias("n"))
        often = counted(teach.where("toxic = 1"), None).where("tox >= 4").orderBy(F.desc("tox"), "key").limit(10 * most_features).select("key").collect()
        among = np.sort(np.array([r["key"] for r in often], np.int64).view(np.uint64))
        if len(among):
            rate = n_tox / n_all
            for r in counted(teach, among).collect():
                tox, clean = r["tox"], r["n"] - r["tox"]
                expect = rate * r["n"]
                gain = 2 * (tox * np.log(tox / expect) + (clean * np.log(clean / (r["n"] - expect)) if clean else 0.0))
                if tox > 0.7 * r["n"] and gain >= 24:
                    weight = np.log((tox + 0.5) / (n_tox + 1)) - np.log((clean + 0.5) / (n_all - n_tox + 1))
                    if weight >= 1.5:
                        learned[r["key"] & ((1 << 64) - 1)] = float(min(weight, 8.0))
    learned = dict(sorted(learned.items(), key=lambda kv: (-kv[1], kv[0]))[:most_features])
    lexicon = Lexicon.build(learned)
    got = arrow_map(tune, _featurise(lexicon, slab), "toxic int, " + ", ".join(f"f{k} double" for k in range(N_FEATURES))).collect()
    rows.unpersist()
    y = np.array([r[0] for r in got], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([-3.0, 1.0, 0.3, 1.0, 1.0]))
    return Model(lexicon, *fit_logistic(np.array([r[1:] for r in got]), y))


def _score(model: Model, slab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offs = text_buffers(rows.column(1))
            for lo, hi, part, at in slabs(data, offs, slab):
                x = features(part, at, model.lexicon)
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(lo, hi - lo), pa.array(model.score(x)), pa.array(np.expm1(x[:, 2]).round().astype(np.int64))], names=["doc_id", "score", "n_clauses"])

    return run


def score_toxicity(docs: DataFrame, model: Model, slab: int = 2 << 20) -> DataFrame:
    """doc_id, score (0 to 1) and n_clauses (clauses that match) of every row's whole text.

    A null or empty text gets the score of a text without a match. Repeated rows and
    null ids are scored like others; other columns are not read. Nothing is shuffled.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(base, _score(model, slab), "doc_id long, score double, n_clauses long")


def held_out(doc_id):
    """The fold that labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity_report(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000) -> DataFrame:
    """Learn on labelled rows that aren't held out, score every document.

    Returns doc_id, held_out, score, predicted (1 if score >= 0.5), n_clauses.
    """
    # A label that stands on several rows counts once; contradicting ones count as toxic.
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > most_rows:  # few enough to broadcast: the sample's bound, by a hash of the id
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
    model = learn(labelled, most_rows=most_rows)
    scored = score_toxicity(docs, model)
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")
