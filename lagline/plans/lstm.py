"""A sequence classifier on encoded histories: projection, one LSTM layer, and a head on the last real step, in NumPy.

Training is one process's work: the train rows come to the driver as arrays, at most `most_rows` of them (an
error beyond). Scoring is distributed: the fitted weights are broadcast, and tasks score batches of rows.

Sequences are padded at the end and carried through unchanged there. Gradients are written out by hand, and held
against differences in the tests.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encoders import MAX_LEVELS
from .experiment import ExperimentError, predict_batches

#: Sizes, regularisation, and rows of a batch.
HIDDEN, EMBEDDED, DROPOUT, DECAY, BATCH, CLIP = 64, 8, 0.2, 1e-4, 1024, 1.0


@dataclass(frozen=True)
class Settings:
    rate: float = 1e-3
    epochs: int = 8
    patience: int | None = 2  # epochs without a better validation AP; None trains all epochs and keeps the last
    root_weight: bool = False  # positives weigh the root of negatives / positives, not the ratio
    warm_up: bool = False  # the rate rises over the first epoch, and falls as a cosine after it
    norm: bool = False  # a layer norm after the projection


#: The two studies' settings.
PRESETS = {"sqrt_weight_slow": Settings(3e-4, 15, 4, True, True), "fixed15": Settings(epochs=15, patience=None)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def average_precision(y: np.ndarray, score: np.ndarray) -> float:
    """The step sum of precision over recall; tied scores make one step."""
    order = np.argsort(-score, kind="stable")
    y, s = y[order].astype(float), score[order]
    last = np.append(s[1:] != s[:-1], True)
    hits = np.cumsum(y)[last]
    called = np.flatnonzero(last) + 1
    return float((np.diff(hits, prepend=0.0) * hits / called).sum() / max(hits[-1], 1e-12)) if len(y) else 0.0


@dataclass
class Network:
    """Weights by name, and what a step forward leaves for the step back."""

    numbers: int  # inputs that are numbers
    texts: int  # inputs that are codes, below `levels`
    levels: int = MAX_LEVELS + 1
    hidden: int = HIDDEN
    norm: bool = False
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def drawn(self, rng: np.random.Generator, dtype=np.float32) -> Network:
        h, width = self.hidden, self.numbers + EMBEDDED * self.texts
        even = lambda n, *shape: rng.uniform(-1 / math.sqrt(n), 1 / math.sqrt(n), shape).astype(dtype)
        self.w = {"levels": rng.standard_normal((self.texts, self.levels, EMBEDDED)).astype(dtype), "in": even(width, width, h), "in_bias": even(width, h)}
        self.w |= {"x": even(h, h, 4 * h), "h": even(h, h, 4 * h), "bias": even(h, 4 * h), "out": even(h, h), "out_bias": even(h, 1)}
        if self.norm:
            self.w |= {"gain": np.ones(h, dtype), "shift": np.zeros(h, dtype)}
        return self

    def forward(self, x: np.ndarray, codes: np.ndarray, lengths: np.ndarray, drop: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
        """Logits of sequences x (rows, steps, numbers) and codes (rows, steps, texts); drop scales the last states."""
        w, (rows, steps) = self.w, x.shape[:2]
        parts = [x] + [w["levels"][k][codes[:, :, k]] for k in range(self.texts)]
        every = np.concatenate(parts, axis=2)
        flat = every @ w["in"] + w["in_bias"]
        keep = {"every": every, "codes": codes, "drop": drop}
        if self.norm:
            spread = np.sqrt(flat.var(axis=2, keepdims=True) + 1e-5)
            keep["unit"], keep["spread"] = (flat - flat.mean(axis=2, keepdims=True)) / spread, spread
            flat = keep["unit"] * w["gain"] + w["shift"]
        keep["event"] = event = np.maximum(flat, 0)
        real = (np.arange(steps)[None, :] < lengths[:, None])[:, :, None]
        h = c = np.zeros((rows, self.hidden), x.dtype)
        keep["steps"] = []
        for t in range(steps):
            i, f, g, o = np.split(event[:, t] @ w["x"] + h @ w["h"] + w["bias"], 4, axis=1)
            i, f, g, o = sigmoid(i), sigmoid(f), np.tanh(g), sigmoid(o)
            cell = f * c + i * g
            top = np.tanh(cell)
            keep["steps"].append((h, c, i, f, g, o, top, real[:, t]))
            h, c = np.where(real[:, t], o * top, h), np.where(real[:, t], cell, c)
        keep["last"] = last = h if drop is None else h * drop
        return last @ w["out"] + w["out_bias"][0], keep

    def backward(self, slope: np.ndarray, keep: dict) -> dict[str, np.ndarray]:
        """Gradients of all weights from those of the logits."""
        w, out = self.w, {}
        out["out"], out["out_bias"] = keep["last"].T @ slope, np.array([slope.sum()], slope.dtype)
        dh = slope[:, None] * w["out"][None, :]
        dh = dh if keep["drop"] is None else dh * keep["drop"]
        dc, devent = np.zeros_like(dh), np.zeros_like(keep["event"])
        for name in ("x", "h", "bias"):
            out[name] = np.zeros_like(w[name])
        for t in range(len(keep["steps"]) - 1, -1, -1):
            h, c, i, f, g, o, top, real = keep["steps"][t]
            here, cell = np.where(real, dh, 0), np.where(real, dc, 0)
            cell = cell + here * o * (1 - top * top)
            gates = np.concatenate((cell * g * i * (1 - i), cell * c * f * (1 - f), cell * i * (1 - g * g), here * top * o * (1 - o)), axis=1)
            out["x"] += keep["event"][:, t].T @ gates
            out["h"] += h.T @ gates
            out["bias"] += gates.sum(axis=0)
            devent[:, t] = gates @ w["x"].T
            dh, dc = np.where(real, 0, dh) + gates @ w["h"].T, np.where(real, 0, dc) + cell * f
        flat = devent * (keep["event"] > 0)
        if self.norm:
            out["gain"], out["shift"] = (flat * keep["unit"]).sum(axis=(0, 1)), flat.sum(axis=(0, 1))
            unit = flat * w["gain"]
            flat = (unit - unit.mean(axis=2, keepdims=True) - keep["unit"] * (unit * keep["unit"]).mean(axis=2, keepdims=True)) / keep["spread"]
        out["in"] = np.tensordot(keep["every"], flat, axes=([0, 1], [0, 1]))
        out["in_bias"] = flat.sum(axis=(0, 1))
        below = flat @ w["in"].T
        out["levels"] = np.zeros_like(w["levels"])
        for k in range(self.texts):
            a = self.numbers + EMBEDDED * k
            np.add.at(out["levels"][k], keep["codes"][:, :, k], below[:, :, a : a + EMBEDDED])
        return out


def weighted_loss(logit: np.ndarray, y: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
    """Mean cross-entropy with a weight on positives, and its slope by the logits."""
    p = sigmoid(logit)
    scale = np.where(y == 1, weight, 1.0).astype(logit.dtype)
    loss = scale * np.logaddexp(0, np.where(y == 1, -logit, logit))
    return float(loss.mean()), scale * (p - y) / len(y)


class Steps:
    """Adam with decoupled decay, on gradients clipped by their common length."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.n = w, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))

    def take(self, slopes: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        length = math.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
        scale = min(1.0, CLIP / (length + 1e-6))
        for k, g in slopes.items():
            g = g * scale
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            m, s = self.mean[k] / (1 - 0.9**self.n), self.square[k] / (1 - 0.999**self.n)
            self.w[k] -= (rate * (m / (np.sqrt(s) + 1e-8) + DECAY * self.w[k])).astype(self.w[k].dtype)


def fields_of(df: DataFrame, column: str) -> tuple[list[str], list[str]]:
    """Names of the numbers and of the codes in a table's sequences."""
    names = df.schema[column].dataType.elementType.names
    return [n for n in names if n.startswith(("z_", "missing_"))], [n for n in names if n.startswith("code_")]


def flattened(df: DataFrame, column: str) -> DataFrame:
    """df with __n, __x and __c: a sequence's steps, its numbers and its codes, step by step."""
    numbers, codes = fields_of(df, column)
    put = lambda names, kind: F.flatten(F.transform(column, lambda r: F.array(*[r[n].cast(kind) for n in names]) if names else F.array().cast(f"array<{kind}>")))
    return df.withColumns({"__n": F.size(column), "__x": put(numbers, "float"), "__c": put(codes, "int")})


def arrays(pdf: pd.DataFrame, numbers: int, codes: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded numbers and codes, and the lengths, of flattened rows."""
    n = pdf["__n"].to_numpy(np.int64)
    x, c = np.zeros((len(pdf), length, numbers), np.float32), np.zeros((len(pdf), length, codes), np.int64)
    for k, (a, b) in enumerate(zip(pdf["__x"], pdf["__c"], strict=True)):
        x[k, : n[k]] = np.asarray(a, np.float32).reshape(n[k], numbers)
        c[k, : n[k]] = np.asarray(b, np.int64).reshape(n[k], codes)
    return x, c, n


def scores(net: Network, x: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probabilities, a batch at a time."""
    return np.concatenate([sigmoid(net.forward(x[a : a + BATCH], codes[a : a + BATCH], lengths[a : a + BATCH])[0]) for a in range(0, len(x), BATCH)] or [np.empty(0)])


def train(net: Network, data, y: np.ndarray, settings: Settings, rng: np.random.Generator, val=None) -> list[dict]:
    """Fits net in place and returns an entry per epoch; with patience, the weights of the best validation AP are kept. val is (data, labels)."""
    positives = int(y.sum())
    if not positives or positives == len(y):
        raise ExperimentError("training targets of both labels are needed")
    weight = (len(y) - positives) / positives
    weight = math.sqrt(weight) if settings.root_weight else weight
    per_epoch, steps, log, best = -(-len(y) // BATCH), Steps(net.w), [], None
    total = per_epoch * settings.epochs
    for epoch in range(1, settings.epochs + 1):
        loss = 0.0
        for ids in np.array_split(rng.permutation(len(y)), per_epoch):
            done = steps.n
            rate = settings.rate
            if settings.warm_up:
                rate *= (done + 1) / per_epoch if done < per_epoch else 0.5 * (1 + math.cos(math.pi * min(1.0, (done - per_epoch) / max(1, total - per_epoch))))
            drop = (rng.random((len(ids), net.hidden)) >= DROPOUT).astype(np.float32) / np.float32(1 - DROPOUT)
            logit, keep = net.forward(*(d[ids] for d in data), drop)
            part, slope = weighted_loss(logit, y[ids].astype(logit.dtype), weight)
            steps.take(net.backward(slope.astype(logit.dtype), keep), rate)
            loss += part * len(ids)
        entry = {"epoch": epoch, "train_loss": loss / len(y)}
        if val is not None:
            entry["val_ap"] = average_precision(val[1], scores(net, *val[0]))
        log.append(entry)
        if settings.patience is None or val is None:
            continue
        if best is None or entry["val_ap"] > best[0]:
            best = (entry["val_ap"], epoch, {k: v.copy() for k, v in net.w.items()})
        elif epoch - best[1] >= settings.patience:
            break
    if best is not None:
        net.w = best[2]
    return log


def sequence_model(val: DataFrame, settings: Settings = Settings(), column: str = "history", length: int = 10, fit_label: str = "y_fit", label: str = "y_true", most_rows: int = 5_000_000) -> Callable[[DataFrame, int], Callable[[DataFrame], DataFrame]]:
    """A `fit` for experiment.run_seeds: (train rows, seed) -> a function that adds `score`. val chooses the epoch."""
    numbers, codes = map(len, fields_of(val, column))

    def fetched(df: DataFrame, y: str):
        pdf = flattened(df, column).select("__n", "__x", "__c", F.col(y).cast("int").alias("__y")).limit(most_rows + 1).toPandas()
        if len(pdf) > most_rows:
            raise ExperimentError(f"more than {most_rows} rows to train on in one process: raise most_rows")
        return arrays(pdf, numbers, codes, length), pdf["__y"].to_numpy(np.int64)

    def fit(rows: DataFrame, seed: int) -> Callable[[DataFrame], DataFrame]:
        rng = np.random.default_rng(seed)
        net = Network(numbers, codes, norm=settings.norm).drawn(rng)
        data, y = fetched(rows, fit_label)
        log = train(net, data, y, settings, rng, fetched(val, label))
        sent = rows.sparkSession.sparkContext.broadcast(net)

        def score(df: DataFrame) -> DataFrame:
            one = lambda pdf: scores(sent.value, *arrays(pdf, numbers, codes, length))
            return predict_batches(flattened(df, column), ["__n", "__x", "__c"], one, BATCH).drop("__n", "__x", "__c")

        score.log = log
        return score

    return fit
