"""Document languages with a linear-chain conditional random field over words.

Features of a word are its affixes, its hashed character n-grams, its scripts and the lexicons it is in; the model has a
weight for each feature and language and one for each transition between languages. It is fitted on a bounded sample:
about ``SAMPLE`` documents of at most ``SAMPLE_CHARS`` characters, drawn by the hash of doc_id at a rate for each
delivered label, of which at most ``PER_LANGUAGE`` sentences of at most ``TRAIN_WORDS`` words a language are used, whose
language the lexicons settle. It starts from weights that say what lexicons and scripts say (with fewer than
``LEAST_SENTENCES`` sentences those stay as they are); sentences are strung together with switches, so that transitions
are learned from code-switched text. A fitted model is used by all queries of a session, and by later ones where the
setting ``spark.reqloom.langid.model`` names a file for it.

Everything else covers all documents and whole texts: forward-backward over whole sentences gives every word its language
distribution. Words add up to sentences and documents; runs of words of one language are passages, also inside a
sentence.

Defined results: null and blank texts, and texts without any word, have no language (null) and are no cases. A document is
mixed when at least two languages hold two or more full sentences each (a full sentence ends in its mark and has at
least ``WORDS`` words); headings, lists of names and foreign terms are not full sentences of another language. Passages
are reported of every document with passages (``RUN`` words or more) in two languages or more; they cover its words.
Running text without a single frequent word of the language found is in none of LANGS: its language is ``other``. Ties
go to the language that comes first in LANGS.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqloom.llm.languages import LANGS, OF_WORD, is_cyrillic, is_han, is_kana, language_of_label
from reqloom.sources.tables import table

SAMPLE, SAMPLE_CHARS, PER_LANGUAGE, TRAIN_WORDS, LEAST_SENTENCES = 4000, 4000, 500, 60, 100
WORDS, SURE, RUN = 3, 0.6, 4
OTHER, OTHER_WORDS = "other", 15
L = len(LANGS)
BUCKETS = 1 << 15
MODEL = "spark.reqloom.langid.model"

_CJK = "぀-ヿㇰ-ㇿ㐀-鿿豈-﫿ｦ-ﾟ\U00020000-\U0002ffff"
_TOKEN = re.compile(rf"[^\W\d_{_CJK}]+(?:['’][^\W\d_{_CJK}]+)?|[{_CJK}]{{1,2}}|[.!?]+(?=[\"'”»)\]]*(?:\s+[^\sa-zß-ÿа-яё0-9]|\s*\Z|\s*\n))|[。！？]|\n")
END, BREAK, SKIP = 0, 1, 2


def word_features(word: str) -> list[int]:
    """Hashed features of a word."""
    w = word.lower()
    f = ["b"]
    c = w[0]
    if is_kana(c) or is_han(c):
        f += ["kana" if any(is_kana(x) for x in w) else "han", *("c" + x for x in w), "w" + w]
    else:
        f.append("cyr" if is_cyrillic(c) else "lat")
        f += [f"x{lang}" for lang in OF_WORD.get(w, ())] * 2
        if len(w) <= 4:
            f.append("w" + w)
        f += ["p" + w[:k] for k in (1, 2, 3)] + ["s" + w[-k:] for k in (1, 2, 3, 4)]
        p = f"^{w}$"
        f += ["g" + p[i : i + 3] for i in range(len(p) - 2)]
        f += ["d" + x for x in w if x > "\x7f"]
    return [zlib.crc32(x.encode()) & (BUCKETS - 1) for x in f]


class Words:
    """Known word forms and their emission rows; grows as new forms come."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.index: dict[str, int] = {"\n": BREAK}
        self.weights = weights
        self.rows = np.ones((1024, L), dtype=np.float32)
        self.n = 3
        self.features: list[list[int]] = [[], [], []]
        self._flags: tuple[np.ndarray, np.ndarray] | None = None

    def ids(self, tokens: list[str]) -> np.ndarray:
        new = [t for t in set(tokens) if t not in self.index]
        fresh = []
        for t in new:
            if t[0] in ".!?。！？":
                self.index[t] = END
            elif len(t) > 1 and t.isupper() and not is_han(t[0]) and not is_kana(t[0]):
                self.index[t] = SKIP
            elif len(t) == 1 and t.isascii() and t.lower() not in OF_WORD:
                self.index[t] = SKIP
            else:
                self.index[t] = self.n + len(fresh)
                fresh.append(word_features(t))
        if fresh:
            if self.weights is None:
                self.features += fresh
            else:
                self._grow(fresh)
            self.n += len(fresh)
        return np.fromiter(map(self.index.__getitem__, tokens), dtype=np.int32, count=len(tokens))

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each form: of which languages it is a frequent word, and whether it is a lower-case word in Latin letters."""
        if self._flags is None or len(self._flags[0]) < self.n:
            old = self._flags
            f, latin = np.zeros((self.n, L), dtype=bool), np.zeros(self.n, dtype=bool)
            begin = 3
            if old is not None:
                begin = len(old[0])
                f[:begin], latin[:begin] = old
            for w, i in self.index.items():
                if i >= begin:
                    for x in OF_WORD.get(w.lower(), ()):
                        f[i, LANGS.index(x)] = True
                    latin[i] = w.islower() and w < "\u0250"
            self._flags = f, latin
        return self._flags

    def _grow(self, fresh: list[list[int]]) -> None:
        need = self.n + len(fresh)
        if need > len(self.rows):
            self.rows = np.vstack([self.rows, np.ones((max(need, 2 * len(self.rows)) - len(self.rows), L), dtype=np.float32)])
        e = emissions(fresh, self.weights)
        e -= e.max(axis=1, keepdims=True)
        self.rows[self.n : need] = np.exp(e)


def emissions(features: list[list[int]], weights: np.ndarray) -> np.ndarray:
    counts = np.array([len(f) for f in features])
    flat = np.fromiter((x for f in features for x in f), dtype=np.int64, count=counts.sum())
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.add.reduceat(weights[flat], starts, axis=0) / np.sqrt(counts)[:, None].astype(weights.dtype)


def chains(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens to words and sentences: (word ids, sentence of each word, document of each sentence, whether it is full,
    its words). Every mark, line break and document border ends a sentence."""
    n = len(ids)
    cut = (ids == END) | (ids == BREAK)
    border = np.zeros(n, dtype=bool)
    border[1:] = doc[1:] != doc[:-1]
    sentence = np.cumsum(np.concatenate([[0], cut[:-1]]) + border) if n else np.empty(0, dtype=np.int64)
    total = int(sentence[-1]) + 1 if n else 0
    of_doc = np.zeros(total, dtype=np.int64)
    of_doc[sentence] = doc
    full = np.zeros(total, dtype=bool)
    full[sentence[ids == END]] = True
    words = ids > SKIP
    ids, sentence = ids[words], sentence[words]
    return ids, sentence, of_doc, full, np.bincount(sentence, minlength=total)


def forward_backward(ids: np.ndarray, lengths: np.ndarray, rows: np.ndarray, trans: np.ndarray, grad: bool = False):
    """Chains laid one after the other. Returns the distribution of each word; with `grad` also the expected transitions."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    size = lengths[order]
    each = np.zeros((len(ids), L), dtype=np.float32)
    moves = np.zeros((L, L)) if grad else None
    for lo in range(0, len(order), 4096):
        st, sz = starts[lo : lo + 4096], size[lo : lo + 4096]
        longest = int(sz[0]) if len(sz) else 0
        if not longest:
            continue
        active = np.searchsorted(-sz, -np.arange(longest), side="left")  # chains longer than t
        alpha, emit = [], []
        for t in range(longest):
            k = int(active[t])
            e = rows[ids[st[:k] + t]]
            a = e if t == 0 else (alpha[-1][:k] @ trans) * e
            a = a / a.sum(axis=1, keepdims=True)
            alpha.append(a)
            emit.append(e)
        beta = np.ones((0, L), dtype=np.float32)
        for t in range(longest - 1, -1, -1):
            k = int(active[t])
            b = np.ones((k, L), dtype=np.float32)
            if len(beta):
                ahead = emit[t + 1] * beta
                back = ahead @ trans.T
                b[: len(beta)] = back / back.sum(axis=1, keepdims=True)
                if grad:
                    joint_scale = np.einsum("ni,ij,nj->n", alpha[t][: len(beta)], trans, ahead)
                    moves += trans * ((alpha[t][: len(beta)] / joint_scale[:, None]).T @ ahead)
            beta = b
            p = alpha[t] * b
            p /= p.sum(axis=1, keepdims=True)
            each[st[:k] + t] = p
    return (each, moves) if grad else each


def sums_of(each: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Word distributions added up by sentence."""
    out = np.zeros((len(words), L), dtype=np.float64)
    some = np.flatnonzero(words)
    if len(some):
        out[some] = np.add.reduceat(each.astype(np.float64), np.concatenate([[0], np.cumsum(words[some])[:-1]]), axis=0)
    return out


def runs(each: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages of words laid one after the other: (first word, words, language, summed probability of it) of each.

    A run is a stretch of words of one document with one most probable language. Runs of fewer than RUN words, and runs whose
    language is not sure, belong to the passage before them (the first ones to the one after).
    """
    if not len(each):
        none = np.empty(0, dtype=np.int64)
        return none, none, none, np.empty(0)
    lang = each.argmax(axis=1)
    new = np.ones(len(lang), dtype=bool)
    new[1:] = (lang[1:] != lang[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(lang)))
    mean = np.add.reduceat(each.max(axis=1).astype(np.float64), at) / size
    own = (size >= RUN) & (mean >= SURE)
    of_doc = doc[at]
    # the owner of each run: the last own run of the document at or before it, else the first own one after it
    idx = np.arange(len(at))
    before = np.maximum.accumulate(np.where(own, idx, -1))
    after = np.minimum.accumulate(np.where(own, idx, len(at))[::-1])[::-1]
    ok = (before >= 0) & (of_doc[np.maximum(before, 0)] == of_doc)
    ok_after = (after < len(at)) & (of_doc[np.minimum(after, len(at) - 1)] == of_doc)
    owner = np.where(ok, before, np.where(ok_after, after, -1))
    # documents without any own run are one passage, in the language of most of their words
    mass = np.zeros((int(doc[-1]) + 1, L))
    np.add.at(mass, doc, each)
    run_lang = np.where(owner >= 0, lang[at][np.maximum(owner, 0)], mass.argmax(axis=1)[of_doc])
    joint = np.ones(len(at), dtype=bool)
    joint[1:] = (run_lang[1:] != run_lang[:-1]) | (of_doc[1:] != of_doc[:-1])
    k = np.cumsum(joint) - 1
    first = at[joint]
    count = np.bincount(k, weights=size).astype(np.int64)
    word_run = np.repeat(k, size)
    p = np.bincount(word_run, weights=each[np.arange(len(lang)), run_lang[joint][word_run]])
    return first, count, run_lang[joint], p


def train(texts: list[str], rounds: int = 60, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from raw texts: the lexicons settle sentences, the CRF learns from those."""
    vocab = Words()
    tokens, doc = [], []
    for i, t in enumerate(texts):
        x = _TOKEN.findall(t)
        tokens += x
        doc += [i] * len(x)
    ids, sentence, _, full, words = chains(vocab.ids(tokens), np.array(doc, dtype=np.int64))
    lex = np.zeros((vocab.n, L))
    for w, i in vocab.index.items():
        if i <= SKIP:
            continue
        if is_kana(w[0]) or is_kana(w[-1]):
            lex[i, LANGS.index("ja")] = 2
        elif is_han(w[0]):
            lex[i, LANGS.index("zh")] = 0.5
        elif is_cyrillic(w[0]):
            lex[i, LANGS.index("ru")] = 1
        else:
            for x in OF_WORD.get(w.lower(), ()):
                lex[i, LANGS.index(x)] = 1 / len(OF_WORD[w.lower()])
    votes = np.zeros((len(words), L))
    np.add.at(votes, sentence, lex[ids])
    top = np.sort(votes, axis=1)
    clear = full & (words >= 5) & (words <= TRAIN_WORDS) & (top[:, -1] >= 2) & (top[:, -1] >= 1.5 * top[:, -2])
    label = votes.argmax(axis=1)
    rng = np.random.default_rng(seed)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    by_lang = [rng.permutation(np.flatnonzero(clear & (label == k)))[:PER_LANGUAGE] for k in range(L)]
    use = np.concatenate(by_lang)
    weights = seed_weights().astype(np.float64)
    trans = np.eye(L) * 2
    if len(use) < LEAST_SENTENCES:
        return weights.astype(np.float32), np.exp(trans).astype(np.float32)
    # strings of three sentences, a third of the joints switching at random, the others within a language
    order = use.copy()
    swap = rng.random(len(order)) < 0.3
    order[swap] = rng.permutation(order[swap])
    words_of = [np.arange(first[s], first[s] + words[s]) for s in order]
    at = np.concatenate(words_of)
    target = np.repeat(label[order], [len(w) for w in words_of])
    lengths = np.array([sum(len(w) for w in words_of[i : i + 3]) for i in range(0, len(words_of), 3)])
    seq, forms = ids[at], None
    forms, seq = np.unique(seq, return_inverse=True)
    feats = [vocab.features[i] for i in forms]
    counts = np.array([len(f) for f in feats])
    flat = np.concatenate([np.array(f) for f in feats])
    scale = 1 / np.sqrt(counts)
    inner = np.ones(len(seq), dtype=bool)
    inner[np.cumsum(lengths)[:-1]] = False
    inner[0] = False
    seen_moves = np.zeros((L, L))
    pairs = np.flatnonzero(inner)
    np.add.at(seen_moves, (target[pairs - 1], target[pairs]), 1)
    gold = np.zeros((len(seq), L), dtype=np.float32)
    gold[np.arange(len(seq)), target] = 1
    m = [np.zeros_like(weights), np.zeros_like(trans)]
    v = [np.zeros_like(weights), np.zeros_like(trans)]
    owner = np.repeat(np.arange(len(feats)), counts)
    for step in range(1, rounds + 1):
        e = emissions(feats, weights)
        rows = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32)
        each, moves = forward_backward(seq, lengths, rows, np.exp(trans).astype(np.float32), grad=True)
        diff = gold - each
        per_form = np.stack([np.bincount(seq, weights=diff[:, k], minlength=len(forms)) for k in range(L)], axis=1)
        spread = (per_form * scale[:, None])[owner]
        g = np.stack([np.bincount(flat, weights=spread[:, k], minlength=BUCKETS) for k in range(L)], axis=1) / len(seq) - 1e-6 * weights
        gt = (seen_moves - moves) / len(seq) - 1e-4 * trans
        for i, (w, x, rate) in enumerate(((weights, g, 0.15), (trans, gt, 0.1))):
            m[i] = 0.9 * m[i] + 0.1 * x
            v[i] = 0.98 * v[i] + 0.02 * x * x
            w += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.98**step)) + 1e-7)
    return weights.astype(np.float32), np.exp(trans).astype(np.float32)


def seed_weights() -> np.ndarray:
    """What is known without any text: lexicons and scripts."""
    w = np.zeros((BUCKETS, L), dtype=np.float32)

    def put(feature: str, lang: str, value: float) -> None:
        w[zlib.crc32(feature.encode()) & (BUCKETS - 1), LANGS.index(lang)] += value

    for lang in LANGS:
        put(f"x{lang}", lang, 6.0)
    put("kana", "ja", 9.0), put("han", "zh", 5.0), put("han", "ja", 3.0), put("cyr", "ru", 9.0)
    return w


def sample_texts(spark: SparkSession, base: str) -> list[str]:
    """Texts of about SAMPLE documents, the same share for every delivered label: first the documents of each are counted,
    then each gives those whose hash lies below its rate. At most 2 * SAMPLE texts of SAMPLE_CHARS characters come back."""
    d = table(spark, base, "documents").where(F.length("text").between(40, SAMPLE_CHARS))
    code = F.lower(F.substring(F.trim(F.coalesce("lang", F.lit(""))), 1, 2))
    d = d.select("text", F.when(code.isin(LANGS), code).otherwise("").alias("code"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    counts = {r[0]: r[1] for r in d.groupBy("code").count().collect()}
    if not counts:
        return []
    share = SAMPLE / len(counts)
    low = F.lit(0)
    for c, n in counts.items():
        low = F.when(F.col("code") == c, int(min(1.0, share / n) * (1 << 30))).otherwise(low)
    rows = d.where(F.col("h") < low).select("h", "text").limit(2 * SAMPLE).collect()
    return [r[1] for r in sorted(rows)]


def fit(spark: SparkSession, base: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions, fitted on the sample."""
    return train(sample_texts(spark, base))


def save_model(spark: SparkSession, model: tuple[np.ndarray, np.ndarray], where: str) -> None:
    data = io.BytesIO()
    np.savez_compressed(data, weights=model[0], trans=model[1])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data.getvalue()))
    out.close()


def load_model(spark: SparkSession, where: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The model of a file, or None where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    with np.load(io.BytesIO(bytes(spark.read.format("binaryFile").load(where).select("content").first()[0]))) as z:
        return z["weights"], z["trans"]


def model_of(spark: SparkSession, base: str):
    """The broadcast model (1.5 MB): of this session, of the file that the setting names, or fitted now."""
    sc = spark.sparkContext
    known = sc.__dict__.setdefault("_reqloom_langid", {})
    where = spark.conf.get(MODEL, None)
    key = where or base
    if key not in known:
        model = load_model(spark, where) if where else None
        if model is None:
            model = fit(spark, base)
            if where:
                save_model(spark, model, where)
        known[key] = sc.broadcast(model)
    return known[key]


_PASSAGE = T.StructType([T.StructField("passage", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())])
_FIELDS = [T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("passages", T.ArrayType(_PASSAGE))]


class Labeller:
    """Languages of texts with a trained model; keeps the word forms it has seen (up to a bound)."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray) -> None:
        self.weights, self.trans = weights, trans
        self.vocab = Words(weights)

    def documents(self, texts: list[str | None]) -> tuple[list, list, list]:
        """(language, confidence, languages if mixed) of each text."""
        return self.label(texts, False)[:3]

    def passages(self, text: str) -> list[tuple[int, int, int, str, float]]:
        """(number, start, end, language, confidence) of each passage of a text in several languages; else none."""
        return self.label([text], True)[3][0]

    def label(self, texts: list[str | None], want_passages: bool) -> tuple[list, list, list, list]:
        if self.vocab.n > 400_000:
            self.vocab = Words(self.weights)
        tokens: list[str] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                x = _TOKEN.findall(t)
                if t.isupper():  # a text in capitals: its words are words, not abbreviations
                    x = [w.capitalize() for w in x]
                sizes[i] = len(x)
                tokens += x
        doc = np.repeat(np.arange(len(texts)), sizes)
        all_ids = self.vocab.ids(tokens)
        ids, sentence, of_doc, full, words = chains(all_ids, doc)
        each = forward_backward(ids, words[words > 0], self.vocab.rows, self.trans)
        sums = sums_of(each, words)
        mass = np.zeros((len(texts), L))
        np.add.at(mass, of_doc, sums * np.where(full & (words >= WORDS), 1.0, 0.5)[:, None])
        top = sums.argmax(axis=1) if len(sums) else np.empty(0, dtype=np.int64)
        sure = full & (words >= WORDS) & (sums.max(axis=1, initial=0) >= SURE * np.maximum(words, 1))
        held = np.zeros((len(texts), L), dtype=np.int64)
        np.add.at(held, (of_doc[sure], top[sure]), 1)
        total = mass.sum(axis=1)
        langs, sures, several = [], [], []
        best = mass.argmax(axis=1)
        for i in range(len(texts)):
            if total[i] <= 0:
                langs.append(None), sures.append(None), several.append([])
                continue
            k = int(best[i])
            langs.append(LANGS[k]), sures.append(float(mass[i, k] / total[i]))
            two = np.flatnonzero(held[i] >= 2)
            several.append([LANGS[j] for j in two] if len(two) > 1 else [])
        for i in self._unknown(all_ids, doc, best, langs):
            langs[i], several[i] = OTHER, []
        return langs, sures, several, self._passages(texts, all_ids, doc, each, langs) if want_passages else [[]] * len(texts)

    def _unknown(self, ids: np.ndarray, doc: np.ndarray, best: np.ndarray, langs: list) -> list[int]:
        """Documents of OTHER_WORDS different words or more in Latin letters, of which none is a frequent one of their language."""
        frequent, latin = self.vocab.frequent()
        known = np.zeros(len(langs), dtype=bool)
        hit = frequent[ids, best[doc]]
        known[doc[hit]] = True
        plain = latin[ids]
        some = np.bincount(doc[plain], minlength=len(langs)) >= OTHER_WORDS
        out = []
        for i in np.flatnonzero(~known & some):
            if langs[i] is not None and langs[i] not in ("zh", "ja", "ru") and len(np.unique(ids[(doc == i) & plain])) >= OTHER_WORDS:
                out.append(int(i))
        return out

    def _passages(self, texts: list, ids: np.ndarray, doc: np.ndarray, each: np.ndarray, langs: list) -> list[list[tuple]]:
        """Maximal runs of words in one language, with code-point offsets, of the documents that have several."""
        out: list[list[tuple]] = [[] for _ in texts]
        words = np.flatnonzero(ids > SKIP)
        first, count, lang, p = runs(each, doc[words])
        start_of = np.searchsorted(doc, np.arange(len(texts)))
        of_doc = doc[words[first]] if len(first) else np.empty(0, dtype=np.int64)
        for i in np.unique(of_doc):
            mine = np.flatnonzero(of_doc == i) if len(of_doc) < 4096 else np.arange(np.searchsorted(of_doc, i), np.searchsorted(of_doc, i, side="right"))
            if len(mine) < 2 or langs[i] == OTHER:
                continue
            spots = [m.span() for m in _TOKEN.finditer(texts[i])]
            for n, j in enumerate(mine):
                a = words[first[j]] - start_of[i]
                b = words[first[j] + count[j] - 1] - start_of[i]
                b += b + 1 < len(spots) and ids[start_of[i] + b + 1] == END  # with its full stop
                out[i].append((n + 1, spots[a][0], spots[b][1], LANGS[lang[j]], float(p[j] / count[j])))
        return out


def _document_column(model, want_passages: bool):
    fields = _FIELDS if want_passages else _FIELDS[:3]

    @F.pandas_udf(T.StructType(fields))
    def languages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(*model.value)
        for texts in batches:
            parts = [labeller.label(texts.iloc[i : i + 500].tolist(), want_passages) for i in range(0, len(texts), 500)]
            cols = [[x for p in parts for x in p[k]] for k in range(len(fields))]
            yield pd.DataFrame({f.name: pd.Series(c, dtype="float64" if f.name == "confidence" else object) for f, c in zip(fields, cols, strict=True)})

    return languages.asNondeterministic()  # else a filter on its result would run it once more


@F.pandas_udf(T.StringType())
def label_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict = {}
    for labels in batches:
        yield pd.Series([known[x] if x in known else known.setdefault(x, language_of_label(x)) for x in labels], dtype=object)


def labelled(spark: SparkSession, base: str, passages: bool = False) -> DataFrame:
    """Every document with its label's language, found language, confidence and languages if mixed; and its passages."""
    model = model_of(spark, base)
    return table(spark, base, "documents").select("doc_id", label_column("lang").alias("label"), _document_column(model, passages)("text").alias("r"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    d = labelled(spark, base).where(F.col("r.language").isNotNull() & (F.col("r.language") != OTHER))
    mixed = F.size("r.languages") > 1
    defect = F.when(mixed, "mixed").when(F.col("label").isNull(), "missing").when(F.col("label") != F.col("r.language"), "wrong")
    langs = F.when(mixed, F.col("r.languages")).otherwise(F.array("r.language"))
    found = d.select("doc_id", defect.alias("defect"), langs.alias("langs")).where(F.col("defect").isNotNull())
    return found.select("doc_id", "defect", F.explode("langs").alias("lang"))


def p9_documents(spark: SparkSession, base: str) -> DataFrame:
    """Language and confidence of every document."""
    return labelled(spark, base).select("doc_id", "label", "r.language", "r.confidence", F.array_join("r.languages", ",").alias("languages"))


def p9_passages(spark: SparkSession, base: str) -> DataFrame:
    """Language and confidence of every passage of the documents with passages in several languages."""
    return labelled(spark, base, True).select("doc_id", F.explode("r.passages").alias("p")).select("doc_id", "p.*")


def p9_labels(spark: SparkSession, base: str) -> DataFrame:
    """The language that each delivered label names, in whatever spelling."""
    return table(spark, base, "documents").select("doc_id", label_column("lang").alias("label"))
