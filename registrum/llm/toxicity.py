"""Toxicity by weak supervision.

Lexicon and pattern voters read each whole text; a voter votes toxic or abstains. Besides fixed word lists there is a
lexicon of words and word beginnings that the labelled rows show to go with toxic texts (equal texts counted once),
for languages and insults that the lists lack. A generative label model explains
all documents' votes by a hidden class: it estimates each voter's rates under either class by expectation
maximisation and finds pairs of voters that stay correlated within a class. Voters that such pairs connect are modelled
jointly (texts of one language set off one kind of voters, and the silence of the others tells nothing), their joint
rates drawn towards those of independent voters where few texts are seen, and all is estimated again.
Known labels enter as one more, noisy voter, only from rows outside the held-out third; how far they are to be trusted is
estimated too. Posteriors, not the raw labels, train a linear classifier over lexicon words, votes and densities, whose
probability is the score: those of the labelled rows and of a sample of the unlabelled ones that are not held out. The
classifier sees each labelled row through the lexicon learnt from the other half of them.

What reaches the driver is bounded: vote patterns (at most 3 * 2**VOTERS rows), small features of about MAX_TRAIN labelled and
MAX_UNLABELLED other rows, picked by hash, and the entries learnt from those labelled rows. The votes of all
documents are counted.

Null and empty texts get the score of a text without votes. Null ids count as not held out and have no label; of
several labels of one id the greatest counts. Repeated rows are scored alike. Without labels the model
goes by the votes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, narrow, prepare

#: Insults by kind, in English, French, German and Spanish.
LEXICON = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid stupidity dumb imbecile imbeciles fool fools dimwit halfwit brainless imbécile imbéciles crétin crétins débile abruti abrutis stupide dummkopf trottel depp blöd dumm hohlkopf schwachkopf idiota idiotas imbécil estúpido estúpida tonto tonta cretino",
    "worth": "worthless useless loser losers trash garbage rubbish ordure minable raté déchet inutile wertlos nutzlos versager müll abfall  inútil basura perdedor perdedora fracasado",
    "contempt": "scum scumbag filth filthy vermin disgusting repulsive revolting vile despicable loathsome ugly racaille raclure dégoûtant répugnant immonde abschaum widerlich ekelhaft dreckig abscheulich escoria asqueroso asquerosa repugnante despreciable",
    "ridicule": "clown clowns pathetic ridiculous laughable coward cowards pathétique ridicule guignol lâche erbärmlich lächerlich witzfigur feigling patético patética ridículo payaso payasos cobarde",
    "hostile": "hate damn bastard bastards jerk creep freak liar liars salaud connard menteur arschloch mistkerl lügner verrecke bastardo canalla mentiroso maldito muérete odio",
}
WORDS = [w for group in LEXICON.values() for w in group.split()]
_INDEX = {w.encode(): i for i, w in enumerate(WORDS)}
_KIND = np.array([k for k, group in enumerate(LEXICON.values()) for _ in group.split()])
_POINTERS = frozenset("you your this that these those such a an the is are he she they du ihr dieser diese tu vous ce cette tú este esta".encode().split())
#: The patterns' names, after the lexicon's kinds.
PATTERNS = ("several", "dense", "pointed", "cluster", "disguised", "stretched", "shouted", "learnt", "learnt_several", "learnt_strong")
VOTERS = len(LEXICON) + len(PATTERNS)
#: Labelled and other rows that the classifier is fitted on, about.
MAX_TRAIN, MAX_UNLABELLED = 20_000, 10_000
#: P(label 0 or 1 | class 0 or 1) as first assumed, and so many labels' worth of that assumption.
LABEL_TRUST, TRUST_WEIGHT = np.array([[0.99, 0.01], [0.03, 0.97]]), 200
#: Voters are modelled jointly from this correlation within a class; texts' worth of independence in their joint rates.
CORRELATED, SMOOTH = 0.15, 2.0
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_LEET = bytes(dict(zip(b"013457@$!", b"oieastasi", strict=True)).get(c, c if c >= 128 or chr(c).isalpha() else 32) for c in range(256))
FEATURES = len(WORDS) + VOTERS + 6
#: What an entry of a learnt lexicon needs: labelled texts, and standard errors above the base rate.
LEAST_TEXTS, LEAST_Z = 4, 4.0
_BEGINNINGS = (4, 5, 6, 7)
#: Log odds from which a learnt word counts as strong.
STRONG = 4.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _squeeze(word: bytes) -> bytes:
    out = bytearray()
    for c in word:
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out)


_SQUEEZED = {_squeeze(w): i for w, i in _INDEX.items() if len(w) > 3}


def read(text: str | None, learnt: dict[bytes, float]) -> tuple[int, list[int], float, float, int, float, int]:
    """Votes as bits, distinct lexicon words, lexicon hits for each 100 words, the logarithm of the hits, the number of
    distinct words of the learnt lexicon, the sum of their log odds, and how many of them are strong."""
    raw = (text or "").lower().encode("utf-8", "replace")
    words = raw.translate(_PLAIN).split()
    at = [i for i, w in enumerate(words) if w in _INDEX]
    hits = [_INDEX[words[i]] for i in at]
    found = set(hits)
    votes = 0
    for i in found:
        votes |= 1 << int(_KIND[i])
    n = len(words)
    base = len(LEXICON)
    dense = 100 * len(hits) / n if n else 0.0
    checks = [
        len(found) >= 3,
        dense >= 1,
        any(i and words[i - 1] in _POINTERS for i in at),
        any(b - a <= 25 for a, b in zip(at, at[1:], strict=False)),
    ]
    disguised = stretched = False
    if any(c in raw for c in b"013457@$!"):
        rest = [w for w in raw.split() if not w.isalpha()]
        for w in rest:
            plain, leet = w.translate(_PLAIN).split(), w.strip(b"!?.,;:#*$%&|").translate(_LEET).split()
            if leet != plain:
                more = [_INDEX[x] for x in leet if x in _INDEX and x not in plain]
                disguised = disguised or bool(more)
                found |= set(more)
    for w in {w for w in words if len(w) > 5 and any(w[i] == w[i + 1] == w[i + 2] for i in range(len(w) - 2))} if b"aaa" in raw or _tripled(raw) else ():
        i = _SQUEEZED.get(_squeeze(w))
        if i is not None:
            stretched = True
            found.add(i)
    several, odds, strong = 0, 0.0, 0
    if learnt:
        for w in set(words):
            weight = weigh(w, learnt)
            if weight is not None:
                several += 1
                odds += weight
                strong += weight >= STRONG
    shouted = bool(hits) and any(WORDS[i].upper() in (text or "") for i in set(hits))
    for k, yes in enumerate([*checks, disguised, stretched, shouted, strong >= 1, strong >= 2, odds >= 8]):
        votes |= int(bool(yes)) << (base + k)
    return votes, sorted(found), dense, float(np.log1p(len(hits))), several, odds, strong


def parts(word: bytes) -> list[bytes]:
    """A word's entries in a learnt lexicon: the word, and its beginnings, longest first."""
    return [b"=" + word, *(word[:k] for k in reversed(_BEGINNINGS) if len(word) > k)]


def weigh(word: bytes, learnt: dict[bytes, float]) -> float | None:
    if len(word) < 3:
        return None
    whole = learnt.get(b"=" + word)
    if whole is not None:
        return whole
    for k in reversed(_BEGINNINGS):
        if len(word) > k and (found := learnt.get(word[:k])) is not None:
            return found
    return None


def learn(sample: DataFrame) -> dict[bytes, float]:
    """sample: text, label. Log odds of the words and beginnings that go with label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set((text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split())
                entries = list({e for w in words if len(w) >= 3 for e in parts(w)})
                yield pa.RecordBatch.from_arrays([pa.array(entries, pa.binary()), pa.array([label] * len(entries), pa.int32())], ["entry", "label"])

    once = sample.groupBy("text").agg(F.max("label").alias("label"))
    total, toxic = once.agg(F.count("*"), F.sum("label")).first()
    if not total or not toxic:
        return {}
    base = toxic / total
    counted = once.mapInArrow(run, "entry binary, label int").groupBy("entry").agg(F.count("*").alias("n"), F.sum("label").alias("t"))
    z = (F.col("t") - base * F.col("n")) / F.sqrt(F.col("n") * base * (1 - base) + 1)
    kept = counted.withColumn("z", z).where((F.col("n") >= LEAST_TEXTS) & (F.col("z") >= LEAST_Z) & (F.col("t") > 0.3 * F.col("n")))
    rows = kept.collect()  # from about MAX_TRAIN texts, few of whose words pass
    prior = base / (1 - base)
    return {bytes(r["entry"]): float(np.log((r["t"] + prior) / (r["n"] - r["t"] + 1) / prior)) for r in rows}


def _tripled(raw: bytes) -> bool:
    b = np.frombuffer(raw, np.uint8)
    return len(b) > 2 and bool(((b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & (b[2:] >= 97)).any())


# ---------------------------------------------------------------- label model


def _state(patterns: np.ndarray, voters: tuple[int, ...]) -> np.ndarray:
    """These voters' votes alone, as bits in their order."""
    return sum(((patterns >> v) & 1) << k for k, v in enumerate(voters))


@dataclass
class LabelModel:
    """Class prior, factors over groups of voters, and what the labels are worth."""

    prior: float
    factors: list[tuple[tuple[int, ...], np.ndarray]]  # voters, P(their joint votes | class)
    label: np.ndarray  # P(label | class)

    def log_odds(self, patterns: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for voters, table in self.factors:
            state = _state(patterns, voters)
            out += np.log(table[1, state]) - np.log(table[0, state])
        if labels is not None:
            known = labels >= 0
            out[known] += np.log(self.label[1, labels[known]]) - np.log(self.label[0, labels[known]])
        return out

    def posterior(self, patterns: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(patterns, labels), -30, 30)))


def fit_label_model(patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 40) -> tuple[LabelModel, list[tuple[int, int, float]]]:
    """Patterns (bits), labels (0, 1, or -1 where unknown) and how many documents have them; the model and its
    correlated pairs."""
    counts = counts.astype(float)
    bits = ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    votes, known = bits.sum(1), labels >= 0
    start = np.where(known, np.where(labels == 1, 0.95, 0.02), np.where(votes >= 2, 0.8, np.where(votes == 1, 0.3, 0.02)))

    def maximise(q: np.ndarray, groups: list[tuple[int, ...]]) -> LabelModel:
        weight = np.stack([(1 - q) * counts, q * counts])
        rate = np.stack([(w @ bits + 0.05) / (w.sum() + 0.5) for w in weight])
        factors = []
        for voters in groups:
            state, states = _state(patterns, voters), np.arange(1 << len(voters))
            on = ((states[:, None] >> np.arange(len(voters))) & 1).astype(bool)
            alone = [np.where(on, r[list(voters)], 1 - r[list(voters)]).prod(1) for r in rate]
            table = np.stack([np.bincount(state, w, len(states)) + SMOOTH * p for w, p in zip(weight, alone, strict=True)])
            factors.append((voters, table / table.sum(1, keepdims=True)))
        seen = np.stack([[w[known & (labels == k)].sum() for k in (0, 1)] for w in weight]) + TRUST_WEIGHT * LABEL_TRUST * [[0.9], [0.1]]
        return LabelModel(float(np.clip(weight[1].sum() / max(counts.sum(), 1), 1e-4, 0.9)), factors, seen / seen.sum(1, keepdims=True))

    def estimate(q: np.ndarray, groups: list[tuple[int, ...]]) -> tuple[LabelModel, np.ndarray]:
        for _ in range(rounds):
            model = maximise(q, groups)
            q = model.posterior(patterns, labels)
        return model, q

    model, q = estimate(start, [(v,) for v in range(VOTERS)])
    pairs = []
    for a in range(VOTERS):
        for b in range(a):
            found = 0.0
            for w in ((1 - q) * counts, q * counts):
                total = max(w.sum(), 1e-9)
                ma, mb, mab = (w @ bits[:, a]) / total, (w @ bits[:, b]) / total, (w @ (bits[:, a] * bits[:, b])) / total
                spread = np.sqrt(ma * (1 - ma) * mb * (1 - mb))
                found = max(found, abs(mab - ma * mb) / spread if spread > 1e-6 else 0.0)
            if found >= CORRELATED:
                pairs.append((b, a, float(found)))
    group = {v: {v} for v in range(VOTERS)}
    for a, b, _ in pairs:
        group[a] |= group[b]
        for v in group[a]:
            group[v] = group[a]
    model, _ = estimate(q, sorted({tuple(sorted(g)) for g in group.values()}))
    return model, sorted(pairs, key=lambda p: -p[2])


# ---------------------------------------------------------------- classifier


def features(rows: list[tuple]) -> np.ndarray:
    """rows: what read() returns."""
    votes, words = np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]
    out = np.zeros((len(votes), FEATURES), np.float32)
    for i, ws in enumerate(words):
        out[i, ws] = 1
    out[:, len(WORDS) : len(WORDS) + VOTERS] = (votes[:, None] >> np.arange(VOTERS)) & 1
    for k, values in enumerate(([min(r[2], 5) for r in rows], [r[3] for r in rows], [min(len(ws), 6) for ws in words], [min(r[4], 10) for r in rows], [min(r[5], 30) for r in rows], [min(r[6], 8) for r in rows])):
        out[:, k - 6] = values
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Weights and bias of a logistic regression on soft labels, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(float)
    n = max(len(x), 1)
    step = 1 / (0.25 * np.linalg.norm(x.T @ x / n, 2) + ridge / n + 1e-9)
    w, last = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge / n)
    penalty[-1] = 0
    for k in range(rounds):
        at = w + k / (k + 3) * (w - last)
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        last, w = w, at - step * (x.T @ (p - y) / n + penalty * at)
    return w


@dataclass
class ToxicityModel:
    weights: np.ndarray
    labels: LabelModel
    correlated: list[tuple[int, int, float]]
    learnt: dict[bytes, float]

    def score(self, rows: list[tuple]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(rows) @ self.weights[:-1] + self.weights[-1], -30, 30)))


_FEATS = "doc_id long, votes int, words array<int>, dense double, hits double, several int, odds double, strong int"
_COLUMNS = ("votes", "words", "dense", "hits", "several", "odds", "strong")
_KINDS = (pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.int32())


def extract(docs: DataFrame, learnt: dict[bytes, float]) -> DataFrame:
    """What read() finds in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(t, learnt) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)]], ["doc_id", *_COLUMNS])

    return narrow(docs, "doc_id", "text").mapInArrow(run, _FEATS)


def train(docs: DataFrame, labels: DataFrame) -> tuple[ToxicityModel, DataFrame]:
    """The model from docs (doc_id, text) and labels (doc_id, toxic), and what it reads in each document."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = cut(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")))
    share = min(1.0, MAX_TRAIN / max(known.count(), 1))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = cut(narrow(docs, "doc_id", "text").where(picked).join(known.where(picked), "doc_id").withColumn("fold", F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(2))))
    learnt = learn(sample)
    halves = [learn(sample.where(f"fold = {1 - k}")) for k in (0, 1)]  # of the other half
    seen = [cut(extract(sample.where(f"fold = {k}"), halves[k]).join(known, "doc_id")) for k in (0, 1)]
    feats = cut(extract(docs, learnt))
    # training rows vote through the other half's lexicon, all others through the whole one
    others = feats.join(seen[0].select("doc_id").unionByName(seen[1].select("doc_id")), "doc_id", "left_anti").withColumn("label", F.lit(-1))
    labelled = seen[0].unionByName(seen[1])
    table = others.select("votes", "label").unionByName(labelled.select("votes", "label")).groupBy("votes", "label").count().collect()
    patterns, given, counts = (np.array([r[c] for r in table], np.int64) for c in ("votes", "label", "count"))
    model, pairs = fit_label_model(patterns, given, counts)
    share = min(1.0, MAX_UNLABELLED / max(int(counts.sum()), 1))
    more = others.where(~held_out(F.col("doc_id")) & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))))
    rows = sorted(labelled.unionByName(more.select(labelled.columns)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["label"], r["votes"], r["words"], r["dense"]))
    y = model.posterior(np.array([r["votes"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64))
    weights = fit_linear(features([tuple(r[c] for c in _COLUMNS) for r in rows]), y)
    return ToxicityModel(weights, model, pairs, learnt), feats


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, votes for each row of docs."""
    prepare(docs.sparkSession)
    model, feats = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in _COLUMNS], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(rows), pa.float64()), batch.column("votes")], ["doc_id", "score", "votes"])

    scored = feats.mapInArrow(run, "doc_id long, score double, votes int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "votes")


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """docs without those that score at least the limit; columns and texts stay as they are."""
    prepare(docs.sparkSession)
    model, _ = train(docs, labels)
    inner = [f"c{i}" if c != "text" else "text" for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(t, model.learnt) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(model.score(found) < limit, pa.bool_()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, kinds).toDF(*docs.columns)
