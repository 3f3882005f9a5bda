"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into stretches of STEPS. Two gated recurrent layers run over every
stretch, one from each end; at each byte their states give a probability for each language,
and a document's probabilities are the mean over all of its bytes. The network is trained here,
in numpy, by backpropagation through time, on a sample of bounded size; then every whole
text is read by tasks that each hold a copy of the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pairlens.llm.common import free_name, pieces

STEPS = 48
UNITS = 8
#: Training sample: documents of a language, stretches of a document. Nothing else is learned from.
DOCUMENTS_A_LANGUAGE = 400
STRETCHES_A_DOCUMENT = 6
ROUNDS = 240
BATCH = 256
#: Stretches a task holds states of at a time; bounds its memory, whatever a text's length.
STRETCHES_AT_ONCE = 2048
UNKNOWN = "und"
#: Steps of the score in which labelled rows are counted, to find from where on a language can be told.
SCORE_STEPS = 1000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Layer:
    """A gated recurrent layer: r and z gates, and a candidate that sees the reset state."""

    def __init__(self, rng: np.random.Generator, units: int):
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.weights = {"w": draw(256, 3 * units), "u": draw(units, 3 * units), "c": np.zeros(units, np.float32)}

    def forward(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each of the rows of `data` (steps, stretches)."""
        w, u, c = (self.weights[k] for k in "wuc")
        n = u.shape[0]
        h, states, kept = np.zeros((data.shape[1], n), np.float32), np.empty((*data.shape, n), np.float32), []
        for t, x in enumerate(data):
            a, b = w[x], h @ u
            gates = _sigmoid(a[:, :2 * n] + b[:, :2 * n])
            r, z = gates[:, :n], gates[:, n:]
            inner = b[:, 2 * n:] + c
            cand = np.tanh(a[:, 2 * n:] + r * inner)
            if keep:
                kept.append((x, h, r, z, inner, cand))
            h = cand + z * (h - cand)
            states[t] = h
        return states, kept

    def backward(self, kept: list, grads: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weights from those of the states."""
        out = {k: np.zeros_like(v) for k, v in self.weights.items()}
        u = self.weights["u"]
        n, d = u.shape[0], np.zeros_like(grads[0])
        for t in range(len(kept) - 1, -1, -1):
            x, h, r, z, inner, cand = kept[t]
            d = d + grads[t]
            d_cand = d * (1 - z) * (1 - cand * cand)
            d_r, d_z = d_cand * inner * r * (1 - r), d * (h - cand) * z * (1 - z)
            d_a = np.concatenate([d_r, d_z, d_cand], axis=1)
            d_b = np.concatenate([d_r, d_z, d_cand * r], axis=1)
            np.add.at(out["w"], x, d_a)
            out["u"] += h.T @ d_b
            out["c"] += d_b[:, 2 * n:].sum(axis=0)
            d = d * z + d_b @ u.T
        return out


@dataclass
class Network:
    languages: list[str]
    ahead: Layer
    back: Layer
    top: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, languages: list[str], units: int = UNITS, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        top = {"v": rng.normal(0, 0.3, (2 * units, len(languages))).astype(np.float32),
               "b": np.zeros(len(languages), np.float32)}
        return cls(languages, Layer(rng, units), Layer(rng, units), top)

    def _states(self, data: np.ndarray, keep: bool = False):
        fore, kept_fore = self.ahead.forward(data, keep)
        rear, kept_rear = self.back.forward(data[::-1], keep)
        return np.concatenate([fore, rear[::-1]], axis=2), kept_fore, kept_rear

    def position_probabilities(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """(stretches, languages) for each step of bytes of (steps, stretches)."""
        fore, rear = self.ahead.forward(data)[0], self.back.forward(data[::-1])[0][::-1]
        n, ones = fore.shape[2], np.ones((len(self.languages), 1), np.float32)
        v_fore, v_rear = self.top["v"][:n], self.top["v"][n:]
        for f, r in zip(fore, rear):
            e = f @ v_fore
            e += r @ v_rear
            e += self.top["b"]
            np.exp(np.clip(e, -40, 40, out=e), out=e)
            e /= e @ ones
            yield e

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the probabilities over all bytes of each text; zeros for an empty text."""
        sums = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, np.ndarray]] = []
        count = 0
        for i, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            for at in range(0, len(data), STEPS * STRETCHES_AT_ONCE):
                part = data[at:at + STEPS * STRETCHES_AT_ONCE]
                held.append((i, part))
                count += -(-len(part) // STEPS)
                if count >= STRETCHES_AT_ONCE:
                    self._add(held, sums)
                    held, count = [], 0
        if held:
            self._add(held, sums)
        return sums / np.maximum(1, [len(t) for t in texts])[:, None]

    def _add(self, held: list[tuple[int, np.ndarray]], sums: np.ndarray) -> None:
        rows = np.array([-(-len(p) // STEPS) for _, p in held])
        data = np.zeros((rows.sum(), STEPS), np.uint8)
        length = np.full(len(data), STEPS)
        flat, first = data.reshape(-1), np.concatenate([[0], rows.cumsum()[:-1]])
        for (_, part), row, n in zip(held, first, rows):
            flat[row * STEPS:row * STEPS + len(part)] = part
            length[row + n - 1] = len(part) - (n - 1) * STEPS
        for at in range(0, len(data), STRETCHES_AT_ONCE):
            cut = slice(at, at + STRETCHES_AT_ONCE)
            pooled = np.zeros((len(data[cut]), len(self.languages)), np.float32)
            short = length[cut] < STEPS
            for t, p in enumerate(self.position_probabilities(np.ascontiguousarray(data[cut].T))):
                p[short & (length[cut] <= t)] = 0
                pooled += p
            np.add.at(sums, np.repeat([i for i, _ in held], rows)[cut], pooled)

    def train(self, data: np.ndarray, true: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, seed: int = 0) -> Network:
        """Adam on the cross-entropy of every byte: `data` and `true` (stretches, steps), `label` (stretches)."""
        rng = np.random.default_rng(seed)
        every = {("ahead", k): v for k, v in self.ahead.weights.items()} | {("back", k): v for k, v in self.back.weights.items()}
        every |= {("top", k): v for k, v in self.top.items()}
        mean, square = ({k: np.zeros_like(v) for k, v in every.items()} for _ in range(2))
        # Languages count alike, however many stretches each has.
        share = 1 / np.bincount(label, minlength=len(self.languages))[label]
        share /= share.sum()
        for step in range(1, rounds + 1):
            take = rng.choice(len(data), min(BATCH, len(data)), p=share)
            x, m, y = np.ascontiguousarray(data[take].T), true[take].T[:, :, None], label[take]
            states, kept_fore, kept_rear = self._states(x, keep=True)
            logits = states @ self.top["v"] + self.top["b"]
            e = np.exp(logits - logits.max(axis=2, keepdims=True))
            d = e / e.sum(axis=2, keepdims=True)
            d[:, np.arange(len(y)), y] -= 1
            d *= m / max(1, m.sum())
            n = self.ahead.weights["u"].shape[0]
            d_states = d @ self.top["v"].T
            grads = {("top", "v"): np.einsum("tbs,tbl->sl", states, d), ("top", "b"): d.sum(axis=(0, 1))}
            grads |= {("ahead", k): g for k, g in self.ahead.backward(kept_fore, d_states[:, :, :n]).items()}
            grads |= {("back", k): g for k, g in self.back.backward(kept_rear, d_states[::-1, :, n:]).items()}
            rate = 0.02 * min(1.0, 2 * (1 - step / (rounds + 1)))
            for k, g in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                every[k] -= (rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text is 1 modulo 3, or there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    documents: int = DOCUMENTS_A_LANGUAGE) -> list:
    """Stretches of at most `documents` documents of each language: `(lang, pick, stretches)`.

    Ids are dealt over `documents` slots by hash; the least hash of a slot is taken.
    """
    text = F.col(text_col)
    learn = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & has_letter(text))
    pick = F.xxhash64(F.col(id_col))
    rows = learn.select(F.col(lang_col).cast("string").alias("lang"), pick.alias("pick"), text.cast("binary").alias("data"))
    slots = rows.groupBy("lang", F.pmod("pick", F.lit(documents)).alias("slot")).agg(F.min("pick").alias("pick"))
    room = F.greatest(F.octet_length("data") - STEPS + 1, F.lit(1))
    at = lambda i: (F.pmod(F.xxhash64("pick", i), room) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(1), F.lit(STRETCHES_A_DOCUMENT)), lambda i: F.substring(F.col("data"), at(i), F.lit(STEPS)))
    # Cut before the join: what meets is bounded by the sample's slots for each row's id.
    picked = rows.select("lang", "pick", cut.alias("stretches")).join(slots.select("lang", "pick"), ["lang", "pick"])
    return sorted(picked.groupBy("lang", "pick").agg(F.min("stretches").alias("stretches")).collect(), key=lambda r: (r.lang, r.pick))


def fit(sample: list, rounds: int = ROUNDS, seed: int = 0) -> Network:
    """A network trained on the rows of `training_sample`; without rows it knows no language."""
    languages = sorted({r.lang for r in sample})
    network = Network.new(languages, seed=seed)
    if not sample:
        return network
    parts = [(bytes(s), languages.index(r.lang)) for r in sample for s in r.stretches]
    data, true = np.zeros((len(parts), STEPS), np.uint8), np.zeros((len(parts), STEPS), np.float32)
    for row, (part, _) in enumerate(parts):
        data[row, :len(part)] = np.frombuffer(part, np.uint8)
        true[row, :len(part)] = 1
    return network.train(data, true, np.array([label for _, label in parts]), rounds, seed)


def predict(text: Column, network: Network, once: bool = False) -> Column:
    """`(lang_pred, score)`: the likeliest language and its probability; `und` and 0 without a letter or a language.

    With `once` Spark is told not to repeat the column where it is read several times, as by a filter and a result.
    """
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in pieces(batches):
            p = network.document_probabilities(list(texts))
            best = p.argmax(axis=1)
            yield pd.DataFrame({"lang_pred": [network.languages[b] for b in best],
                                "score": np.clip(p[np.arange(len(p)), best], 0, 1)})

    predicted.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not network.languages:
        return nothing
    network_udf = F.pandas_udf(predicted, "lang_pred string, score double")
    guess = (network_udf.asNondeterministic() if once else network_udf)(F.coalesce(text, F.lit("")).cast("binary"))
    return F.when(has_letter(text), guess).otherwise(nothing)


def identify(docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of every row of `docs`, learning from its labelled rows if no network is given.

    Null texts and texts without a letter are `und` with score 0, as all texts are if no row
    can be learned from. Ids that repeat are rows of their own; a null id is held out. Only
    the text is read for a prediction.
    """
    network = network or fit(training_sample(docs, id_col, text_col, lang_col))
    guessed = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                          predict(F.col(text_col), network).alias("p"))
    return guessed.select("doc_id", "held_out", "p.lang_pred", "p.score")


def least_score(named: DataFrame, right: Column, score: Column, steps: int = SCORE_STEPS) -> float:
    """The score below which more rows of `named` are called wrong than right, by the widest margin; 0 if there is none.

    All rows are counted, by score in `steps` steps; of equal margins the lowest score is taken.
    """
    step = F.least(F.floor(score * steps), F.lit(steps - 1)).alias("step")
    margin = F.sum(F.when(right, -1).otherwise(1)).alias("margin")
    best = total = least = 0
    for r in sorted(named.groupBy(step).agg(margin).collect()):
        total += r.margin
        if total > best:
            best, least = total, r.step + 1
    return least / steps


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      min_score: float | None = None, names: tuple[str, str] | None = None) -> DataFrame:
    """The rows of `docs` in a language that can be told, with all their columns.

    With `min_score` a language is told from that score on. Without, the score is calibrated on every labelled row that may be
    learned from: where less certain rows are called wrong more often than right, their language cannot be told
    (`least_score`). Labelled texts are read once more for that; nothing is stored.
    `names` adds the language and its score under these names, lengthened where they are taken.

    Where no row can be learned from (no labels, or all of them on rows that are held out), no
    language can be told from another: every row with a letter stays, whatever `min_score` is.
    """
    network = fit(training_sample(docs, id_col, text_col, lang_col))
    p = free_name(docs, "_language")
    named = docs.withColumn(p, predict(F.col(text_col), network, once=True))
    label, guess = F.col(lang_col).cast("string"), F.col(p)["lang_pred"]
    if not network.languages:
        told = has_letter(F.col(text_col))
    else:
        if min_score is None:
            known = docs.filter(~held_out(F.col(id_col)) & label.isNotNull() & has_letter(F.col(text_col))).select(
                label.alias("label"), predict(F.col(text_col), network).alias("p")).select("label", "p.*")
            min_score = least_score(known, F.col("label") == F.col("lang_pred"), F.col("score"))
        told = (guess != UNKNOWN) & (F.col(p)["score"] >= min_score)
    kept = named.filter(told)
    shown = [] if names is None else [F.col(p)[f].alias(free_name(docs, n)) for f, n in zip(("lang_pred", "score"), names)]
    return kept.select(*docs.columns, *shown)
