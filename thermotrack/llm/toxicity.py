"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or."""

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermotrack.llm.common import packed, saved, unpacked
from thermotrack.llm.hashing import REMEMBERED, released
from thermotrack.llm.labels import is_held_out, learned_labels

SAMPLE_DOCS = 3000  # of either label at most
SAMPLE_BYTES = 24 << 20  # of text in all at most
BLOCK_BYTES = 4 << 20  # of the sample's text that comes to the driver at a time
BLOCK_FEATURES = 1 << 19  # of the sample that are worked on at a time
LEAST_DOCS = 4  # a word or prefix counts if so many sampled documents have it
PREFIXES = (3, 4, 5)  # beginnings of a word that count beside the word itself
ROUNDS = 160
PENALTY = 2e-5  # on the size of each weight
THRESHOLD = 0.3
SENTENCE_THRESHOLD = 0.5

_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")


@dataclass
class ToxicityModel:
    """A weight for the hash of each word and beginning of a word, and the weight of any sentence."""

    bias: float = -10.0
    weights: dict[int, float] = field(default_factory=dict)


class _Weights(dict):
    """Weight of each word, remembered up to a number of words; ends of sentences weigh infinity."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model, self.features = model, _Features()
        self._ends()

    def _ends(self):
        for end in _ENDS:
            self[end] = np.inf

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
            self._ends()
        self[word] = value = sum(self.model.weights.get(f, 0.0) for f in self.features[word])
        return value


class _Features(dict):
    """Hashes of a word and of its beginnings (0 for one as long as the word)."""

    def __missing__(self, word: str) -> tuple:
        if len(self) >= REMEMBERED:
            self.clear()
        own = xxhash.xxh32_intdigest(word)
        self[word] = value = (own, *(xxhash.xxh32_intdigest(f"{word[:n]}-") if len(word) > n else 0 for n in PREFIXES))
        return value


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _softplus(z):
    return np.logaddexp(0.0, z)


def sentence_sums(tokens: list, weights) -> np.ndarray:
    """Sum of the weights of the different words of each sentence that has words."""
    values = np.fromiter(map(weights.__getitem__, tokens), float, len(tokens))
    ends = np.isinf(values)
    number = np.cumsum(ends)
    has_words = np.bincount(number[~ends]) > 0
    sums = np.zeros(len(has_words))
    weighty = np.flatnonzero((values != 0) & ~ends).tolist()
    for sentence, word in {(number[i], tokens[i]) for i in weighty}:
        sums[sentence] += weights[word]
    return sums[has_words]


def noisy_or(sums: np.ndarray, bias: float) -> float:
    """1 - product of (1 - sigmoid): some sentence is toxic."""
    return float(-np.expm1(-_softplus(sums + bias).sum())) if len(sums) else 0.0


def toxic_spans(text: str, weights, bias: float, threshold: float = SENTENCE_THRESHOLD):
    """begin, end (code points) and score of the sentences that score at least threshold."""
    out, begin, end, words = [], None, 0, set()
    for match in (*_TOKEN.finditer(text.lower()), None):
        if match is None or match.group() in _ENDS:
            if begin is not None:
                score = float(_sigmoid(sum(weights[w] for w in words) + bias))
                if score >= threshold:
                    out.append({"begin": begin, "end": end, "score": score})
            begin, words = None, set()
        else:
            begin = match.start() if begin is None else begin
            end = match.end()
            words.add(match.group())
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS,
                 sample_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Learn word weights from labels of documents: which sentences are toxic is never told.

    The model is fitted on a bounded sample: of the labelled documents that aren't held out, the first
    sample_docs of either label in the order of a hash of the id, and of those, by turns from both
    labels, each one whose text still fits into sample_bytes together. Texts are whole. The sampled
    labels are weighed to the shares of all learned labels. Word hashes of the sample are
    saved and read by the driver in blocks; words in fewer than LEAST_DOCS documents are left out. Without a document of either label
    the model scores 0; documents of both labels from which nothing can be learned are an error.
    """
    learned = saved(learned_labels(labels, "toxic"))
    totals = {r[0]: r[1] for r in learned.groupBy("label").count().collect()}
    if len(totals) < 2:
        return ToxicityModel()
    chosen = None
    for label in (0, 1):
        part = learned.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
        chosen = part if chosen is None else chosen.union(part)
    chosen = saved(chosen)  # at most 2 * sample_docs rows
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    known = rows.select("id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).groupBy(
        "id", "label").agg(F.max("size").alias("size")).select("id", "label", "size", F.xxhash64("id").alias("h")).collect()
    by_label = [sorted((r for r in known if r["label"] == y), key=lambda r: (r["h"], r["id"])) for y in (0, 1)]
    if not all(by_label):
        return ToxicityModel()
    used, size = [], 0
    for n in range(max(map(len, by_label))):
        for r in (part[n] for part in by_label if n < len(part)):
            if size + r["size"] <= sample_bytes:
                used.append(r)
                size += r["size"]
    wanted = chosen.sparkSession.createDataFrame([(r["id"], n) for n, r in enumerate(used)], "id bigint, place int")
    features = saved(rows.join(F.broadcast(wanted), "id").mapInArrow(
        _hashed, "place int, label int, words binary, sizes binary").repartition(max(1, size // BLOCK_BYTES), "place"))
    model = _trained(features, totals)
    if not model.weights:
        raise ValueError(f"no toxicity model: nothing learned from {len(used)} of {len(known)} labelled documents "
                         f"({size} bytes of text, at most {sample_bytes})")
    return model


@released
def _hashed(batches):
    """place, label, features of the different words of each sentence, number of words of each sentence."""
    features = _Features()
    for batch in batches:
        words, sizes = [], []
        for text in batch.column("text").to_pylist():
            codes, counts, sentence = [], [], set()
            for token in (*_TOKEN.findall((text or "").lower()), "."):
                if token not in _ENDS:
                    sentence.add(token)
                elif sentence:
                    counts.append(len(sentence))
                    codes += [features[w] for w in sorted(sentence)]
                    sentence = set()
            words.append(np.array(codes, np.uint32).tobytes())
            sizes.append(np.array(counts, np.int32).tobytes())
        yield pa.record_batch([batch.column("place"), batch.column("label"), pa.array(words, pa.binary()),
                               pa.array(sizes, pa.binary())], names=["place", "label", "words", "sizes"])


def _vocabulary(features: DataFrame) -> np.ndarray:
    """Sorted features that LEAST_DOCS documents have. The documents come a block at a time."""
    known, counts, waiting, held = np.empty(0, np.uint32), np.empty(0, np.int64), [], 0

    def merged():
        values, inverse = np.unique(np.concatenate([known, *waiting]), return_inverse=True)
        weights = np.concatenate([counts, np.ones(held, np.int64)])
        return values, np.bincount(inverse, weights=weights).astype(np.int64)

    for r in features.select("words").toLocalIterator():
        waiting.append(np.unique(np.frombuffer(r["words"], np.uint32)))
        held += len(waiting[-1])
        if held > BLOCK_FEATURES:
            known, counts = merged()
            waiting, held = [], 0
    known, counts = merged()
    return known[(counts >= LEAST_DOCS) & (known != 0)]


def _blocks(features: DataFrame, vocabulary: np.ndarray):
    """Documents in the order of their places, in blocks of some BLOCK_FEATURES known features: labels, places of
    the features in the vocabulary, features of each sentence, sentences of each document."""
    docs = []
    for r in features.toLocalIterator():
        sizes = np.frombuffer(r["sizes"], np.int32)
        if not len(sizes):
            continue
        words = np.frombuffer(r["words"], np.uint32)
        place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1).astype(np.int32)
        known = vocabulary[place] == words
        sentence = np.repeat(np.arange(len(sizes)), sizes * (1 + len(PREFIXES)))[known]
        counts = np.bincount(sentence, minlength=len(sizes)).astype(np.int32)
        docs.append((r["place"], r["label"], place[known], counts))
    docs.sort(key=lambda d: (d[0], d[2].tobytes()), reverse=True)
    block, held = [], 0
    while docs:
        d = docs.pop()
        block.append(d)
        held += len(d[2])
        if held > BLOCK_FEATURES:
            yield _joined(block)
            block, held = [], 0
    if block:
        yield _joined(block)


def _joined(block):
    return (np.array([d[1] for d in block], float), np.concatenate([d[2] for d in block]),
            np.concatenate([d[3] for d in block]), np.array([len(d[3]) for d in block]))


def _trained(features: DataFrame, totals) -> ToxicityModel:
    """Proximal gradient steps with Adam's scaling on the likelihood of the document labels. The driver holds
    4 bytes for each known feature of the sample; the steps go over blocks of documents and sum their gradients."""
    vocabulary = _vocabulary(features)
    blocks = list(_blocks(features, vocabulary)) if len(vocabulary) else []
    labels = np.concatenate([b[0] for b in blocks]) if blocks else np.empty(0)
    if len(set(labels.tolist())) < 2:
        return ToxicityModel()
    share = np.array([totals[0], totals[1]], float) / sum(totals.values())
    own = np.array([(labels == y).mean() for y in (0, 1)])
    importance = share / own / len(labels)
    weights, bias = np.zeros(len(vocabulary)), -6.0
    m, v = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    for t in range(1, ROUNDS + 1):
        gradient = sum(block_gradient(b, weights, bias, importance) for b in blocks)
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        scale = 0.2 / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        step = scale * m / (1 - 0.9**t)
        bias -= step[-1]
        weights = weights - step[:-1]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - PENALTY * np.minimum(scale[:-1], 1e4), 0.0)
    chosen = np.flatnonzero(weights)
    return ToxicityModel(float(bias), dict(zip(vocabulary[chosen].tolist(), weights[chosen].tolist(), strict=True)))


def block_gradient(block, weights: np.ndarray, bias: float, importance: np.ndarray) -> np.ndarray:
    """Gradient by each weight and, last, the bias, of the documents' negative log-likelihood under the noisy-or,
    each document weighed by importance[label]."""
    labels, place, counts, sentences = block
    sentence = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    owner = np.repeat(np.arange(len(labels), dtype=np.int32), sentences)
    z = np.bincount(sentence, weights=weights[place], minlength=len(counts)) + bias
    d = np.bincount(owner, weights=_softplus(z), minlength=len(labels))
    pull = np.where(labels == 1, -np.exp(-d) / np.maximum(-np.expm1(-d), 1e-12), 1.0) * importance[labels.astype(int)]
    at_sentence = _sigmoid(z) * pull[owner]
    return np.append(np.bincount(place, weights=at_sentence[sentence], minlength=len(weights)), at_sentence.sum())


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Columns of docs, and toxicity (0 to 1), is_toxic (score >= threshold), toxic_spans.

    The score of a document is the noisy-or of its sentences (cut at . ! ? and line ends), from its
    whole text. toxic_spans locate the sentences that offend, for documents at or over the
    threshold: begin, end in code points, score. Texts without words, null ones too, score 0.
    """
    whole = packed(docs)
    at = [c.lower() for c in docs.columns].index(text.lower())  # texts travel once, within their rows

    @released
    def run(batches):
        weights = _Weights(model)
        for batch in batches:
            scores, spans = [], []
            for value in batch.column("row").field(at):
                t = value.as_py() or ""
                score = noisy_or(sentence_sums(_TOKEN.findall(t.lower()), weights), model.bias)
                scores.append(score)
                spans.append(toxic_spans(t, weights, model.bias) if score >= threshold else [])
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.record_batch([batch.column("row"), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                                  names=["row", "toxicity", "toxic_spans"])

    kind = whole.schema["row"].dataType.simpleString()
    found = whole.mapInArrow(run, f"row {kind}, toxicity double, toxic_spans array<struct<begin:int,end:int,score:double>>")
    return unpacked(found, toxicity=F.col("toxicity"), is_toxic=F.col("toxicity") >= threshold,
                    toxic_spans=F.col("toxic_spans"))


def toxicity_of(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labels and score all documents: score_toxicity's columns, and held_out."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels), threshold)
    return scored.withColumn("held_out", is_held_out(F.col("doc_id")))
