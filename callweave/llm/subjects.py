"""Problem 8: the subject areas of each document, by a distributed latent Dirichlet topic model.

The model is latent Dirichlet allocation in which all words of a sentence share their topic, fitted by variational EM:
every document has topic proportions, every sentence a posterior over topics, every topic a word distribution of its
own in each script (so a topic can be bilingual, and what language a text is in says nothing about its topic). Words
are pairs of neighbouring syllables in Hangul, spaces ignored, and whole words in Latin script, hashed to a fixed
vocabulary. Each pass is one job over all documents: workers return expected counts, summed by blocks of the
vocabulary, so the driver sees a table of fixed size (topics x vocabulary) whatever the corpus.

The topics start from a bounded sample of labelled documents (``max_labelled``): words that are specific to a
subject's documents seed a topic, all other words seed background topics; a labelled document may use only its
subjects' topics and the background. Fitted topics are then mapped to subjects through their top terms, each term
voting for the subjects in whose labelled documents it is specific; a topic whose top terms favour no subject is
background. A document has each subject to whose topics at least ``share`` of its sentences belong.

What is no sentence: pieces with fewer than three words, and a heading (a first line of at most four words that ends
in a number). Markup is taken out, entities are decoded.

Nulls: null or empty texts and null ids give no row. Repeated documents give repeated rows. Without labels there is
no seed, hence no subject and no row. Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import durable, shared_dir

BITS = 16  # of the vocabulary; its lower half is Hangul, its upper half Latin
BLOCK = 1 << 11
SIGMAS = 1.0
# a Hangul predicate's end: a syllable that closes in ss, n or ps, and "da"
_CLOSED = "".join(chr(c) for c in range(0xAC00, 0xD7A4) if (c - 0xAC00) % 28 in (4, 18, 20))
_ENDS = r"[.!?。]+(?!\d)|[\n\r\u2028\u2029]+"
_SPLIT = re.compile(_ENDS)
_SPLIT_MARKUP = re.compile(_ENDS + r"|<(?:br|/?p|/?li|/?div|/?h\d)\b[^<>]*>", re.I)
_PREDICATE = re.compile(rf"(?<=[{_CLOSED}]다)\s+")
_CAPITAL = re.compile(r"(?<!\s)\s+(?=([A-Z][a-z]*)\b)")
_TAG = re.compile(r"<[^<>]*>")
_LATIN, _HANGUL = re.compile(r"[a-z]{2,}"), re.compile(r"[가-힣]+")
_HEADING = re.compile(r"^\W*(?:\w+\s+){1,3}\d+\W*$")
_INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")


def unwrapped(text: str) -> str:
    """The text without the breaks of a layout that wraps at a fixed width, be it inside words: such breaks follow
    lines of exactly that width, and nearly all lines have it."""
    lines = text.split("\n")
    width = max(map(len, lines))
    full = sum(len(x) == width for x in lines)
    if full < 3 or full < 0.8 * (len(lines) - 1):
        return text
    return "".join(x if len(x) == width else x + "\n" for x in lines)


def mine_openers(docs: DataFrame, text: str, support: float = 0.0002, least: int = 5, share: float = 0.2) -> frozenset[str]:
    """Words that, capitalised, begin a sentence even where its layout lost the marks: those that stand after an end mark
    in at least ``share`` of all places where they are capitalised, which names inside sentences do not. One count over
    all texts; words with less than ``support`` of all such beginnings are left out, so at most ``1 / support`` arrive."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?:[.!?][\"')]*\s+)?\b[A-Z][a-z]*(?= [a-z])"), F.lit(0))
    w = docs.where(F.col(text).rlike("[A-Z]")).select(F.explode(found).alias("m"))
    w = w.groupBy(F.regexp_extract("m", r"[A-Z][a-z]*$", 0).alias("w")).agg(F.count_if(F.col("m").rlike(r"^[.!?]")).alias("s"), F.count(F.lit(1)).alias("n"))
    w = w.where((F.col("s") >= least) & (F.col("s") >= share * F.col("n"))).checkpoint()
    total = w.agg(F.sum("s")).first()[0] or 0
    return frozenset(r["w"] for r in w.where(F.col("s") >= support * total).collect())


def _opened(text: str, openers: frozenset[str]) -> list[str]:
    """The text cut before each word that opens a sentence."""
    cuts = [m for m in _CAPITAL.finditer(text) if m[1] in openers]
    if not cuts:
        return [text]
    edges = [0, *(m.end() for m in cuts)]
    return [text[a:b].strip() for a, b in zip(edges, [*(m.start() for m in cuts), len(text)])]


def sentences(text: str, openers: frozenset[str] = frozenset()) -> list[str]:
    """The sentences of a text, folded; headings and markup left out. ``openers``: see :func:`mine_openers`."""
    if "\n" in text:
        text = unwrapped(text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _INVISIBLE.search(text):
            text = _INVISIBLE.sub("", text)
    out = []
    for s in (_SPLIT_MARKUP if "<" in text else _SPLIT).split(text):
        if not s or s.isspace():
            continue
        if "<" in s:
            s = _TAG.sub(" ", s)
        if "다 " in s:
            out += [x.casefold() for x in _PREDICATE.split(s) if x]
        elif openers and not s.isupper():
            out += [x.casefold() for x in _opened(s, openers) if x]
        else:
            out.append(s.casefold())
    return out[1:] if len(out) > 1 and _HEADING.match(out[0]) else out


def words(sentence: str) -> list[str]:
    ko = "".join(_HANGUL.findall(sentence))
    return [ko[i : i + 2] for i in range(len(ko) - 1)] + _LATIN.findall(sentence)


def word_id(word: str, bits: int = BITS) -> int:
    half = 1 << (bits - 1)
    return (zlib.crc32(word.encode()) & (half - 1)) + (half if word[0] <= "z" else 0)


def bags(docs: DataFrame, doc_id: str, text: str, bits: int = BITS, openers: frozenset[str] = frozenset()) -> DataFrame:
    """``doc``, the word ids of all its sentences (``w``) and the sentences' lengths (``n``), as packed integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        hangul: dict[str, list[int]] = {}  # by sentence: without their numbers many are alike

        def ids(ws: list[str]) -> list[int]:
            if len(known) > 1 << 20:
                known.clear()
            out = []
            for x in ws:
                h = known.get(x)
                if h is None:
                    h = known[x] = word_id(x, bits)
                out.append(h)
            return out

        for b in batches:
            rows = []
            for d, t in zip(b["d"], b["t"]):
                w: list[int] = []
                n: list[int] = []
                for s in sentences(t, openers):
                    ko = "".join(_HANGUL.findall(s))
                    own = hangul.get(ko)
                    if own is None:
                        own = ids([ko[i : i + 2] for i in range(len(ko) - 1)])
                        if len(hangul) < 30_000 and len(own) < 100:
                            hangul[ko] = own
                    latin = ids(_LATIN.findall(s))
                    if len(own) + len(latin) >= 3:
                        w += own
                        w += latin
                        n.append(len(own) + len(latin))
                if n:
                    rows.append((d, np.array(w, dtype=np.uint16 if bits <= 16 else np.uint32).tobytes(), np.array(n, dtype=np.uint32).tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "w", "n"])

    src = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
    return src.mapInPandas(run, "doc bigint, w binary, n binary")


class Batch:
    """Some documents side by side."""

    def __init__(self, docs: list[int], w: list[bytes], n: list[bytes], bits: int):
        kind = np.uint16 if bits <= 16 else np.uint32
        self.docs = np.array(docs)
        each = [np.frombuffer(x, dtype=np.uint32) for x in n]
        self.w = np.concatenate([np.frombuffer(x, dtype=kind) for x in w]).astype(np.int64)
        self.n = np.concatenate(each).astype(np.int64)  # words a sentence
        self.size = np.array([len(x) for x in each])  # sentences a document
        self.at = np.cumsum(self.n) - self.n
        self.first = np.cumsum(self.size) - self.size
        self.doc_of = np.repeat(np.arange(len(docs)), self.size)


def batches_of(frames: Iterator[pd.DataFrame], bits: int, max_words: int = 400_000) -> Iterator[Batch]:
    d: list[int] = []
    w: list[bytes] = []
    n: list[bytes] = []
    held = 0
    for f in frames:
        for a, b, c in zip(f["doc"], f["w"], f["n"]):
            d.append(a)
            w.append(b)
            n.append(c)
            held += len(b) // (2 if bits <= 16 else 4)
            if held >= max_words:
                yield Batch(d, w, n, bits)
                d, w, n, held = [], [], [], 0
    if d:
        yield Batch(d, w, n, bits)


def log_topics(counts: np.ndarray) -> np.ndarray:
    """Log word distributions, one for each topic and script."""
    k, v = counts.shape
    halves = counts.reshape(k, 2, v // 2)
    return np.log(halves / halves.sum(axis=2, keepdims=True)).reshape(k, v).astype(np.float32)


def posterior(b: Batch, logs: np.ndarray, allowed: np.ndarray, alpha: float, rounds: int = 10) -> np.ndarray:
    """Topics x sentences. ``allowed``: topics x documents."""
    score = np.add.reduceat(logs[:, b.w], b.at, axis=1)
    score -= score.max(axis=0)
    like = np.exp(score) + 1e-30
    theta = allowed / allowed.sum(axis=0)
    for r in range(rounds + 1):
        post = like * theta[:, b.doc_of]
        post /= post.sum(axis=0)
        if r < rounds:
            theta = (np.add.reduceat(post, b.first, axis=1) + alpha) * allowed
            theta /= theta.sum(axis=0)
    return post


def _summed(rows: DataFrame, shape: tuple[int, int], ways: int = 64) -> np.ndarray:
    """The sum of the tables that workers sent in blocks of columns, in two levels: first in ``ways`` parts a block, each
    of what some tasks sent, taken in as it comes, then over the parts, of which there are ``ways`` however many tasks."""

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for x in f["v"]:
                t = np.frombuffer(x, dtype=np.float64)
                total = t.copy() if total is None else total + t
        yield pd.DataFrame({"block": [key[0]], "part": [0], "v": [total.tobytes()]})

    out = np.zeros(shape)
    kind = "block int, part int, v binary"
    parts = rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(ways)).cast("int"))
    some = parts.groupBy("block", "part").applyInPandas(add, kind) if rows.rdd.getNumPartitions() > ways else parts.select("block", "part", "v")
    for r in some.groupBy("block").applyInPandas(add, kind).collect():
        out[:, r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["v"], dtype=np.float64).reshape(shape[0], -1)
    return out


def _blocks(table: np.ndarray) -> pd.DataFrame:
    cuts = range(0, table.shape[1], BLOCK)
    return pd.DataFrame({"block": [c // BLOCK for c in cuts], "v": [table[:, c : c + BLOCK].astype(np.float64).tobytes() for c in cuts]})


@dataclass
class Model:
    """Expected counts (topics x vocabulary), the subject of each topic (-1: background) and what it was seeded by."""

    subjects: list[str]
    counts: np.ndarray
    subject_of: list[int]
    specific: np.ndarray
    bits: int = BITS

    def top_terms(self, topic: int, n: int = 40) -> np.ndarray:
        """The words that set the topic most apart: high in it against all topics together."""
        logs = log_topics(self.counts + 0.01)
        p = np.exp(logs)
        return np.argsort(-(p[topic] * (logs[topic] - np.log(p.mean(axis=0)))), kind="stable")[:n]


def fit(bag: DataFrame, labels: dict[int, list[int]], subjects: list[str], background: int = 3, passes: int = 2, alpha: float = 0.1, eta: float = 0.01, bits: int = BITS) -> Model:
    """``bag``: a stored table of :func:`bags`. ``labels``: subjects of the sampled labelled documents."""
    sc = bag.sparkSession.sparkContext
    s, v = len(subjects), 1 << bits
    known = sc.broadcast(labels)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lab = known.value
        out = np.zeros((s + 3, v))  # documents with a word by subject; in all; its occurrences; documents, in column 0
        kept = (f[f["doc"].isin(lab.keys())] for f in frames)
        for b in batches_of(kept, bits):
            key = np.unique(b.doc_of[np.repeat(np.arange(len(b.n)), b.n)] * v + b.w)
            doc, word = key // v, key % v
            has = np.zeros((s, len(b.docs)), dtype=bool)
            for i, d in enumerate(b.docs):
                has[lab[d], i] = True
            for k in range(s):
                out[k] += np.bincount(word[has[k][doc]], minlength=v)
            out[s] += np.bincount(word, minlength=v)
            out[s + 1] += np.bincount(b.w, minlength=v)
            out[s + 2, 0] += len(b.docs)
            out[s + 2, 1 : s + 1] += has.sum(axis=1)
        if out.any():
            yield _blocks(out)

    got = _summed(bag.mapInPandas(count, "block int, v binary"), (s + 3, v))
    total, with_subject = max(got[s + 2, 0], 1), got[s + 2, 1 : s + 1]
    base = np.clip(with_subject / total, 1e-9, 1 - 1e-9)[:, None]
    # how far a word's documents are the subject's, above chance: the lower end of what their number allows
    rate = (got[:s] + 2 * base) / (got[s] + 2)
    specific = np.clip((rate - SIGMAS * np.sqrt(rate * (1 - rate) / (got[s] + 2)) - base) / (1 - base), 0, 1)
    specific[:, got[s] < 2] = 0
    specific /= np.maximum(specific.sum(axis=0), 1)
    rest = 1 - specific.sum(axis=0)
    rng = np.random.default_rng(7)
    seed = np.vstack([specific * got[s + 1] + 0.5 * base * rest * got[s + 1], rest**2 * got[s + 1] / background * rng.gamma(20, 1 / 20, (background, v))])
    counts = seed + eta
    for _ in range(passes):
        shared = sc.broadcast(log_topics(counts))

        def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            logs, lab = shared.value, known.value
            k = len(logs)
            out = np.zeros((k, v))
            for b in batches_of(frames, bits):
                allowed = np.ones((k, len(b.docs)), dtype=np.float32)
                for i, d in enumerate(b.docs):
                    if d in lab:
                        allowed[:s, i] = 0
                        allowed[lab[d], i] = 1
                post = posterior(b, logs, allowed, alpha)
                of = np.repeat(np.arange(len(b.n)), b.n)
                for t in range(k):
                    out[t] += np.bincount(b.w, post[t][of], minlength=v)
            if out.any():
                yield _blocks(out)

        counts = _summed(bag.mapInPandas(expect, "block int, v binary"), counts.shape) + eta
    model = Model(subjects, counts, [-1] * len(counts), specific, bits)
    model.subject_of = [_vote(model, t) for t in range(len(counts))]
    return model


def _vote(m: Model, topic: int, least: float = 0.08) -> int:
    """The subject that a topic's top terms favour, or -1."""
    votes = m.specific[:, m.top_terms(topic)].mean(axis=1)
    return int(votes.argmax()) if votes.max() >= least else -1


def assign(bag: DataFrame, model: Model, share: float = 0.22, alpha: float = 0.1) -> DataFrame:
    """``doc, subject, share`` for every subject of every document. The topics of one subject are added up."""
    shared = bag.sparkSession.sparkContext.broadcast((log_topics(model.counts), model.subject_of, model.subjects, model.bits))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs, subject_of, names, bits = shared.value
        mapping = np.zeros((len(names), len(logs)), dtype=np.float32)
        for t, k in enumerate(subject_of):
            if k >= 0:
                mapping[k, t] = 1
        for b in batches_of(frames, bits):
            post = mapping @ posterior(b, logs, np.ones((len(logs), len(b.docs)), dtype=np.float32), alpha)
            part = np.add.reduceat(post, b.first, axis=1) / b.size
            k, i = np.nonzero(part >= share)
            if len(i):
                yield pd.DataFrame({"doc": b.docs[i], "subject": [names[x] for x in k], "share": part[k, i].astype(float)})

    return bag.mapInPandas(run, "doc bigint, subject string, share double")


def closed_set(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The distinct values of a dimension, in order; more than ``most`` are refused, as each is a topic of the model."""
    names = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} values of {column}: set `most` for a larger model")
    return names


def label_sample(labels: DataFrame, doc_id: str, subject: str, subjects: list[str], max_labelled: int) -> dict[int, list[int]]:
    """Subjects of at most ``max_labelled`` labelled documents, those with the least hashes."""
    rows = (
        labels.where(F.col(doc_id).isNotNull() & F.col(subject).isin(subjects))
        .groupBy(F.col(doc_id).cast("bigint").alias("d"))
        .agg(F.sort_array(F.collect_set(subject)).alias("s"))
        .orderBy(F.xxhash64("d"), "d")
        .limit(max_labelled)
        .collect()
    )
    index = {x: i for i, x in enumerate(subjects)}
    return {r["d"]: [index[x] for x in r["s"]] for r in rows}


def topic_model(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, subjects: list[str], max_labelled: int = 20_000, **options) -> tuple[DataFrame, Model | None]:
    """The stored bags of all documents and the model fitted on them; no model without labels."""
    shared_dir(docs.sparkSession)
    bag = durable(bags(docs, doc_id, text, options.get("bits", BITS), mine_openers(docs, text)), "bags")
    known = label_sample(labels, doc_id, "subject", subjects, max_labelled)
    return bag, fit(bag, known, subjects, **options) if known else None
