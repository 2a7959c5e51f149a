"""Languages of documents and of their parts.

Model: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in
numpy on sentences of a bounded sample of labelled documents. Labels are noisy, so after a first training the
sentences that the model firmly contradicts are dropped and training starts anew. A held-out part sets the
temperature and the confidence below which a sentence is left without a language.

Since the softmax is linear in the average, a trained model is one table of scores by subword bucket; it is
broadcast (its size is fixed) and all documents are read whole, in batches, on the executors.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The languages, and names and codes of each; region codes after them are ignored.
LANGUAGES = ("pt", "en", "es", "fr", "de", "it")
NAMES = {
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "en": ("en", "eng", "english", "inglês", "ingles", "inglés"),
    "es": ("es", "spa", "spanish", "español", "espanol", "espanhol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "it": ("it", "ita", "italian", "italiano"),
}
NO_LANGUAGE = ("", "und", "unknown", "n/a", "na", "none", "null", "mul", "zxx", "mis", "xx", "?", "??", "-", "other")

#: Documents a language and sentences a document that the model is trained on at most.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES = 500, 4
#: Words that a sentence has at least.
LEAST_WORDS = 4
#: Gradient steps that a training takes at least, however small its sample.
LEAST_STEPS = 300
BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4, 5)

PARAGRAPHS = re.compile(r"\n(?:[ \t]*\n)+")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_HEADING = re.compile(r"^\s*#[# ]")
_LOG = re.compile(r"^\s*(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|\$\w+|at \S+\()")
_MARKS = re.compile(r"^(?:\s*(?:[-*+>•]|\d+[.)])(?=\s|\w))+\s*")
_ENDS = re.compile(r"(?<=[.?!…])[)\]\"'»]*\s+")
_NO_WORDS = re.compile(r"`[^`]*`|\S*(?:://|[/\\_$@#=<>{}]|->|\d)\S*")
_LETTERS = re.compile(rb"[^a-z]+")


def label_language(label: Column) -> Column:
    """The language that a label names ('pt' ...; 'other' for any other); NULL if it is missing or names none."""
    x = F.lower(F.trim(label))
    head = F.regexp_extract(x, r"^([^\W\d_]+)", 1)
    known = F.coalesce(*(F.when(head.isin(*names), F.lit(code)) for code, names in NAMES.items()))
    return F.when(x.isNotNull() & ~x.isin(*NO_LANGUAGE), F.coalesce(known, F.when(F.regexp_extract(x, r"[^\W\d_]{2}", 0) != "", F.lit("other"))))


def sentences(text: str) -> list[tuple[int, bytes]]:
    """(paragraph, plain words between blanks) of each sentence: code, logs, headings, paths, links and numbers left out."""
    out, fenced = [], False
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    for no, paragraph in enumerate(PARAGRAPHS.split(text.strip(" \t\n"))):
        for line in paragraph.split("\n"):
            if _FENCE.match(line):
                fenced = not fenced
                continue
            if fenced or _HEADING.match(line) or _LOG.match(line):
                continue
            for part in _ENDS.split(_MARKS.sub("", line)):
                plain = unicodedata.normalize("NFKD", _NO_WORDS.sub(" ", part).lower()).encode("ascii", "ignore")
                words = [w for w in _LETTERS.split(plain) if w]
                if len(words) >= LEAST_WORDS:
                    out.append((no, b" " + b" ".join(words) + b" "))
    return out


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subword buckets of all texts laid end to end (a row per order of n-gram), where each text starts, and its number of subwords.

    Bucket 0 stands for "no subword" where an n-gram would reach beyond its text.
    """
    length = np.array([len(t) for t in texts])
    ends = np.cumsum(length)
    starts = ends - length
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    room = np.repeat(ends, length) - np.arange(len(raw))
    padded = np.concatenate([raw, np.zeros(max(ORDERS), dtype=np.uint32)])
    ids, h = np.zeros((len(ORDERS), len(raw)), dtype=np.int32), np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h * np.uint32(0x01000193) + padded[n - 1 : n - 1 + len(raw)] + np.uint32(1)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            ids[ORDERS.index(n)] = np.where(room >= n, 1 + (mixed >> np.uint32(8)) % np.uint32(BUCKETS - 1), 0)
    total = sum(np.maximum(length - n + 1, 0) for n in ORDERS)
    return ids, starts, np.maximum(total, 1)


@dataclass(frozen=True)
class Model:
    """Scores by bucket and language, bias, inverse temperature and the least confidence of an answer."""

    table: np.ndarray
    bias: np.ndarray
    scale: float
    least: float

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        out = [np.zeros((0, len(self.bias)))]
        for i in range(0, len(texts), 4000):
            part = texts[i : i + 4000]
            ids, starts, total = buckets(part)
            sums = sum(np.add.reduceat(self.table[row], starts, axis=0) for row in ids)
            out.append(_softmax((sums / total[:, None] + self.bias) * self.scale))
        return np.concatenate(out)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(texts: list[bytes], y: np.ndarray, classes: int, epochs: int, seed: int, rate: float = 6.0, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times output weights, and the bias, after ``epochs`` (more for small samples) of gradient steps with falling rate."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    emb[0] = 0
    out, bias = np.zeros((DIM, classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    ids, starts, total = buckets(texts)
    flat = [ids[:, s : s + len(t)].ravel() for s, t in zip(starts, texts)]
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(texts)))
    steps, at = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(texts), batch):
            pick = order[i : i + batch]
            lens = np.array([len(flat[j]) for j in pick])
            cat = np.concatenate([flat[j] for j in pick])
            mean = np.add.reduceat(emb[cat], np.cumsum(lens) - lens, axis=0) / total[pick, None]
            p = _softmax(mean @ out + bias)
            p[np.arange(len(pick)), y[pick]] -= 1
            step = rate * (1 - at / steps) / len(pick)
            back = np.repeat((p @ out.T / total[pick, None]).astype(np.float32), lens, axis=0)
            out -= (step * (mean.T @ p)).astype(np.float32)
            bias -= (step * p.sum(axis=0)).astype(np.float32)
            where = np.argsort(cat, kind="stable")
            cells, first = np.unique(cat[where], return_index=True)
            emb[cells] -= step * len(pick) * np.add.reduceat(back[where], first, axis=0)
            emb[0] = 0
            at += 1
    return emb @ out, bias


def train(texts: list[bytes], labels: list[int], epochs: int = 4, seed: int = 7) -> Model:
    """A model from sentences and noisy labels. Without sentences the model answers nothing (every confidence is below its bound)."""
    k = len(LANGUAGES)
    if not texts:
        return Model(np.zeros((BUCKETS, k), dtype=np.float32), np.zeros(k, dtype=np.float32), 1.0, 2.0)
    y = np.array(labels)
    table, bias = _fit(texts, y, k, max(2, epochs // 2), seed)
    p = Model(table, bias, 1.0, 0.0).probabilities(texts)
    keep = np.flatnonzero((p.argmax(axis=1) == y) | (p.max(axis=1) < 0.6))
    if len(keep) < k:
        keep = np.arange(len(texts))
    order = np.random.default_rng(seed).permutation(keep)
    held, rest = order[: len(order) // 5], order[len(order) // 5 :]
    table, bias = _fit([texts[i] for i in rest], y[rest], k, epochs, seed + 1)
    scale, least = 1.0, 0.5
    if len(held):
        raw = np.log(np.maximum(Model(table, bias, 1.0, 0.0).probabilities([texts[i] for i in held]), 1e-30))
        loss = lambda s: -np.log(np.maximum(_softmax(raw * s)[np.arange(len(held)), y[held]], 1e-30)).mean()
        scale = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
        q = _softmax(raw * scale)
        top, right = q.max(axis=1), q.argmax(axis=1) == y[held]
        # the smallest bound at which at most 0.2 per cent of the answers given are wrong
        by = np.argsort(-top)
        wrong = np.cumsum(~right[by]) <= 0.002 * np.arange(1, len(by) + 1)
        least = max(0.4, float(top[by][np.flatnonzero(wrong)[-1]])) if wrong.any() else 0.9
    return Model(table, bias, float(scale), min(least, 0.9))


def fit(documents: DataFrame, most_documents: int = SAMPLE_DOCUMENTS, most_sentences: int = SAMPLE_SENTENCES) -> Model:
    """Train on at most ``most_documents`` labelled documents a language (those first in the order of a hash) and ``most_sentences`` of each."""
    named = documents.where("text is not null and doc_id is not null").select("doc_id", "text", label_language(F.col("lang")).alias("label")).where(F.col("label").isin(*LANGUAGES))
    # a bound on the hash first: what then is ranked is a few times the sample, however many documents there are
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(2**31))
    bounds = {r.label: int(2**31 * min(1.0, 2 * most_documents / r.n)) for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not bounds:
        return train([], [])
    bound = F.coalesce(*(F.when(F.col("label") == k, F.lit(v)) for k, v in bounds.items()))
    rank = F.row_number().over(W.partitionBy("label").orderBy(draw, "doc_id"))
    sample = named.where(draw < bound).withColumn("rank", rank).where(F.col("rank") <= most_documents)

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, label in zip(pdf["doc_id"], pdf["text"], pdf["label"]):
                found = list(dict.fromkeys(s for _, s in sentences(text)))
                start = doc % max(1, len(found))
                rows += [(label, s) for s in (found[start:] + found[:start])[:most_sentences]]
            yield pd.DataFrame(rows, columns=["label", "sentence"])

    rows = sorted((r.label, bytes(r.sentence)) for r in sample.mapInPandas(cut_out, "label string, sentence binary").collect())
    return train([s for _, s in rows], [LANGUAGES.index(x) for x, _ in rows])


def segments(documents: DataFrame, model: Model, sure: float = 0.9) -> DataFrame:
    """One row per document, paragraph and language: doc_id, para_no, lang, n_sentences, confidence (mean).

    A sentence gets the most probable language if its confidence reaches the model's bound; where that is not
    the main language of its document, ``sure`` must be reached, else it counts to the main language. Documents
    with NULL or empty text, or without a sentence, have no rows. Texts are read whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m, docs, at, texts = shared.value, [], [], []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                for no, s in sentences(text):
                    docs.append(doc)
                    at.append(no)
                    texts.append(s)
            if not texts:
                continue
            p = m.probabilities(texts)
            f = pd.DataFrame({"doc_id": docs, "para_no": at, "lang": p.argmax(axis=1), "confidence": p.max(axis=1)})
            f = f[f["confidence"] >= m.least]
            if f.empty:
                continue
            weight = f.groupby(["doc_id", "lang"], sort=True)["confidence"].sum().reset_index().sort_values(["doc_id", "confidence", "lang"], ascending=[True, False, True])
            main = weight.drop_duplicates("doc_id").set_index("doc_id")["lang"]
            own = f["doc_id"].map(main)
            f["lang"] = np.where((f["lang"] == own) | (f["confidence"] >= sure), f["lang"], own)
            g = f.groupby(["doc_id", "para_no", "lang"]).agg(n_sentences=("confidence", "size"), confidence=("confidence", "mean")).reset_index()
            g["lang"] = [LANGUAGES[i] for i in g["lang"]]
            yield g

    rows = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    return rows.mapInPandas(classify, "doc_id bigint, para_no bigint, lang string, n_sentences bigint, confidence double")


def languages(segs: DataFrame) -> DataFrame:
    """One row per document with a sentence: doc_id, lang (the most sentences), confidence, share, n_languages.

    ``share`` is the part of the sentences in that language; ties go to the first language by name.
    """
    by = segs.groupBy("doc_id", "lang").agg(F.sum("n_sentences").alias("n"), F.sum(F.col("n_sentences") * F.col("confidence")).alias("c"))
    best = F.max(F.struct("n", F.col("c").alias("c"), "lang"))
    out = by.groupBy("doc_id").agg(best.alias("b"), F.sum("n").alias("all"), F.count("*").alias("n_languages"))
    return out.select("doc_id", F.col("b.lang").alias("lang"), (F.col("b.c") / F.col("b.n")).alias("confidence"), (F.col("b.n") / F.col("all")).alias("share"), "n_languages")


def relabel(documents: DataFrame, segs: DataFrame) -> DataFrame:
    """doc_id, label, named (the language that the label names), lang, confidence, share, n_languages and why the label is wrong.

    ``problem``: 'missing', 'wrong', 'mixed' or NULL. Documents without a sentence keep a row with NULL language.
    """
    docs = documents.where("doc_id is not null").select("doc_id", F.col("lang").alias("label"), label_language(F.col("lang")).alias("named"))
    problem = F.when(F.col("lang").isNull(), None).when(F.col("named").isNull(), "missing").when(F.col("n_languages") > 1, "mixed").when(F.col("named") != F.col("lang"), "wrong")
    return docs.join(languages(segs), "doc_id", "left").withColumn("problem", problem)
