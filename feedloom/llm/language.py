"""Language of texts by a bidirectional recurrent network over bytes, trained here."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.llm.common import map_arrow

#: Bounds of the training sample: languages, documents of each and of all, pieces of words
#: of each document; a piece has LONGEST characters at most.
LANGUAGES = 2048
DOCUMENTS = 300
ALL_DOCUMENTS = 20_000
SAMPLE_WORDS = 120
#: Bytes of a sequence: a word, or a piece of a longer one.
LONGEST = 24
HIDDEN = 16
BATCHES = 900
BATCH_WORDS = 256
#: Words whose labels a task remembers, and documents that it works on together.
REMEMBERED = 300_000
AT_ONCE = 400

#: Letters of ASCII are lowered, its other characters part words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]").search


def sequences(text: str) -> list[bytes]:
    """The words of a text as bytes, long ones in pieces."""
    words = text.encode().translate(_BYTES).split()
    if len(max(words, key=len, default=b"")) > LONGEST:
        words = [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]
    return words


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER(text)) or any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Gated recurrent units from both ends of a word and a softmax at every byte.

    ``p`` holds for each direction ``x`` (input weights of each byte for update, reset and
    state), ``u`` (recurrent weights of the gates), ``v`` (of the state); and ``o``, ``c``.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 0):
        self.languages, self.hidden = languages, hidden
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(hidden), s).astype(np.float32)
        self.p = {"o": draw(2 * hidden, len(languages)), "c": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(256, 3 * hidden), f"u{d}": draw(hidden, 2 * hidden), f"v{d}": draw(hidden, hidden)}

    def states(self, data: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States after each byte of words of one length (rows), in the order of the bytes."""
        n, steps = data.shape
        size = self.hidden
        x, u, v = (self.p[k + d] for k in "xuv")
        h = np.zeros((n, size), np.float32)
        out = np.empty((steps, n, size), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = x[data[:, t]]
            gates = _sigmoid(a[:, : 2 * size] + h @ u)
            z, r = gates[:, :size], gates[:, size:]
            g = np.tanh(a[:, 2 * size :] + (r * h) @ v)
            if trace is not None:
                trace.append((t, h, z, r, g))
            h = h + z * (g - h)
            out[t] = h
        return out

    def labels(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (byte, word, language)."""
        h = np.concatenate([self.states(data, "f"), self.states(data, "b")], axis=2)
        return _softmax(h @ self.p["o"] + self.p["c"])

    def gradients(self, data: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all bytes, by backpropagation through time."""
        size = self.hidden
        traces = {"f": [], "b": []}
        h = np.concatenate([self.states(data, d, traces[d]) for d in "fb"], axis=2)
        error = _softmax(h @ self.p["o"] + self.p["c"])
        error[:, np.arange(len(target)), target] -= 1
        error /= data.size
        grads = {"o": np.tensordot(h, error, ([0, 1], [0, 1])), "c": error.sum((0, 1))}
        back = error @ self.p["o"].T
        for k, d in enumerate("fb"):
            x, u, v = (np.zeros_like(self.p[n + d]) for n in "xuv")
            wu, wv = self.p["u" + d], self.p["v" + d]
            dh = np.zeros((len(data), size), np.float32)
            for t, before, z, r, g in reversed(traces[d]):
                dh = dh + back[t, :, k * size : (k + 1) * size]
                dg = dh * z * (1 - g * g)
                dz = dh * (g - before) * z * (1 - z)
                drh = dg @ wv.T
                dr = drh * before * r * (1 - r)
                gates = np.concatenate([dz, dr], axis=1)
                v += (r * before).T @ dg
                u += before.T @ gates
                np.add.at(x, data[:, t], np.concatenate([gates, dg], axis=1))
                dh = dh * (1 - z) + drh * r + gates @ wu.T
            grads |= {"x" + d: x, "u" + d: u, "v" + d: v}
        return grads

    def train(self, words: list[list[bytes]], batches: int, size: int, seed: int = 0) -> None:
        """Adam steps on words of one length at a time, as many of each language."""
        rng = np.random.default_rng(seed)
        pools: dict[int, list] = {}
        for lang, own in enumerate(words):
            for w in own:
                pools.setdefault(len(w), [[] for _ in words])[lang].append(w)
        shelves = []
        for steps, by_lang in sorted(pools.items()):
            arrays = [
                np.frombuffer(b"".join(ws), np.uint8).reshape(-1, steps) for ws in by_lang
            ]
            shelves.append((arrays, sum(map(len, by_lang))))
        if not shelves:
            return
        share = np.array([n for _, n in shelves], float)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, batches + 1):
            arrays = shelves[rng.choice(len(shelves), p=share / share.sum())][0]
            held = [k for k, a in enumerate(arrays) if len(a)]
            data, target = [], []
            for k in held:
                # as many words as the language has there, against its share of all words
                take = rng.integers(0, len(arrays[k]), max(1, size * len(arrays[k]) // sum(map(len, arrays))))
                data.append(arrays[k][take])
                target.append(np.full(len(take), k))
            rate = 0.02 * (1 - step / (batches + 1))
            for name, g in self.gradients(np.concatenate(data), np.concatenate(target)).items():
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.01 * (g * g - square[name])
                m = mean[name] / (1 - 0.9**step)
                s = square[name] / (1 - 0.99**step)
                self.p[name] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


class Labeller:
    """Pools the labels of documents; equal words are labelled once."""

    def __init__(self, network: Network):
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.sums = np.zeros((1024, len(self.network.languages)), np.float32)

    def learn(self, words: list[bytes]) -> None:
        """Label words: the sums over their bytes."""
        begin = len(self.place)
        if begin + len(words) > len(self.sums):
            more = np.zeros((2 * (begin + len(words)), self.sums.shape[1]), np.float32)
            more[:begin] = self.sums[:begin]
            self.sums = more
        words.sort(key=len)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for steps in np.unique(sizes):
            a, b = np.searchsorted(sizes, (steps, steps + 1))
            for k in range(a, b, 8192):
                own = words[k : min(b, k + 8192)]
                data = np.frombuffer(b"".join(own), np.uint8).reshape(-1, steps)
                self.sums[begin + k : begin + k + len(own)] = self.network.labels(data).sum(0)
        self.place.update(zip(words, range(begin, begin + len(words))))

    def pool(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities over the bytes of each text; zeros without words."""
        if len(self.place) > REMEMBERED:
            self.clear()
        cut = [sequences(t) for t in texts]
        get = self.place.get
        found = [list(map(get, words)) for words in cut]
        holes = [
            (words, at, [i for i, p in enumerate(at) if p is None]) for words, at in zip(cut, found) if None in at
        ]
        if holes:
            self.learn(list({words[i] for words, _, empty in holes for i in empty}))
            for words, at, empty in holes:
                for i in empty:
                    at[i] = self.place[words[i]]
        out = np.zeros((len(texts), self.sums.shape[1]))
        for k, at in enumerate(found):
            if at:
                total = self.sums[at].sum(0, dtype=np.float64)
                out[k] = total / total.sum()
        return out


def train(
    df: DataFrame, learn_from: Column, text: str = "text", lang: str = "lang", id: str = "doc_id"
) -> Network | None:
    """A network for the languages of the documents that meet ``learn_from`` and have one.

    Of the LANGUAGES most frequent languages DOCUMENTS documents each (fewer where that were
    more than ALL_DOCUMENTS), by a hash of the id, give up to SAMPLE_WORDS words each, evenly
    over the whole text; a word longer than LONGEST counts as several. That bounds the bytes
    that come to the driver, also from texts without white space. Documents without a text
    or a language teach nothing. None without labelled documents.
    """
    known = df.filter(learn_from & F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(id).alias("h"))
    rows = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not rows:
        return None
    languages = sorted(r["lang"] for r in rows)
    each = max(1, min(DOCUMENTS, ALL_DOCUMENTS // len(rows)))
    # enough hashes to hold so many of each, so that few rows are sorted
    shares = [(r["lang"], int(min(1.0, (2 * each + 50) / r["count"]) * (1 << 30))) for r in rows]
    shares = df.sparkSession.createDataFrame(shares, "lang string, share long")  # LANGUAGES rows at most
    known = known.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share"))
    known = known.withColumn("w", F.regexp_extract_all("t", F.lit(rf"\S{{1,{LONGEST}}}"), F.lit(0)))
    step = F.greatest(F.lit(1), F.ceil(F.size("w") / SAMPLE_WORDS).cast("int"))
    known = known.withColumn("step", step)
    known = known.select("lang", "h", F.filter("w", lambda w, i: i % F.col("step") == 0).alias("w"))
    order = Window.partitionBy("lang").orderBy("h", F.xxhash64("w"))
    few = known.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each)
    sample = sorted((r["lang"], r["k"], r["w"]) for r in few.select("lang", "k", "w").collect())
    own: dict[str, list[bytes]] = {name: [] for name in languages}
    for name, _, found in sample:
        own[name] += sequences(" ".join(found))
    network = Network(languages)
    if len(languages) > 1:
        network.train([own[name] for name in languages], BATCHES, BATCH_WORDS)
    return network


def predict(
    df: DataFrame, network: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Kept columns, ``lang_pred`` and ``score`` for every whole text, row by row.

    A document's probabilities are the mean of those at all bytes of its words; the largest
    is the score, ties to the language first in order. NULL texts and texts without a letter
    are ``und`` with score 0, as is every text without a network. Repeated rows get equal
    results; a kept column named as an output gives way.
    """

    def rows(batches: Iterator[list]):
        labeller = Labeller(network) if network is not None else None
        for texts, first in ((t.slice(k, AT_ONCE), k) for (t,) in batches for k in range(0, len(t), AT_ONCE)):
            texts = [t or "" for t in texts.to_pylist()]
            at = list(range(first, first + len(texts)))
            if labeller is None:
                yield [["und"] * len(texts), [0.0] * len(texts)], at
                continue
            pooled = labeller.pool(texts)
            best, score = pooled.argmax(1).tolist(), pooled.max(1).tolist()
            sure = [s > 0 and has_letter(t) for t, s in zip(texts, score)]
            names = [network.languages[b] if ok else "und" for b, ok in zip(best, sure)]
            yield [names, [min(1.0, s) if ok else 0.0 for s, ok in zip(score, sure)]], at

    return map_arrow(df, [text], list(keep), "lang_pred string, score double", rows)


def identify(df: DataFrame, learn_from: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Train on the documents that meet ``learn_from`` and predict all."""
    return predict(df, train(df, learn_from, text), text, keep)


def keep_known(df: DataFrame, learn_from: Column, min_score: float = 0.3, text: str = "text") -> DataFrame:
    """The documents, with their own columns, whose language is told: not ``und``, and with a
    score of ``min_score`` at least."""
    held = df.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    found = predict(held, train(df, learn_from, text), text, ("__row",))
    found = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return found.select(*[F.col("__row").getField(c).alias(c) for c in df.columns])
