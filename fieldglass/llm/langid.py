"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

The network is trained here, in numpy, by backpropagation through time: every byte of a training window carries
its document's language. A text is read whole, in windows of at most `window` bytes with a fresh state each; every
position gets a distribution over languages, and a document's probabilities are the mean over its positions.

Null texts and texts without a letter are `und` with score 0. Of equally likely languages the first by name is named.
Repeated rows and extra columns pass, lang_pred and score take the place of columns of those names; an empty table
trains no network, and all is `und`. Rows are independent: no shuffle after training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan
from .common import bounded_sample, crc_mod, table


@dataclass(frozen=True)
class LangParams:
    """Training reads `train_rows` rows at most, whole; each step draws texts, and a window of `bptt` bytes anywhere in each."""

    train_rows: int = 2000
    window: int = 256
    hidden: int = 8
    bptt: int = 64
    batch: int = 192
    steps: int = 240
    rate: float = 0.02
    seed: int = 7


class BiGru:
    """Both directions side by side, features first: arrays are (direction, feature, sequence)."""

    def __init__(self, languages: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        c, h = len(languages), hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, 3 * h, 256)).astype(np.float32),
            "u": (rng.normal(0, 1, (2, 3 * h, h)) / np.sqrt(h)).astype(np.float32),
            "bn": np.zeros((2, h, 1), np.float32),
            "o": rng.normal(0, 0.3, (2, c, h)).astype(np.float32),
            "b": np.zeros((c, 1), np.float32),
        }

    def step(self, x: np.ndarray, state: np.ndarray, u: np.ndarray, bn: np.ndarray):
        h = self.hidden
        a = np.matmul(u, state)
        g = x[:, : 2 * h] + a[:, : 2 * h]
        g *= 0.5
        np.tanh(g, out=g)
        g += 1
        g *= 0.5
        r, z = g[:, :h], g[:, h:]
        un = a[:, 2 * h :]
        un += bn
        n = r * un
        n += x[:, 2 * h :]
        np.tanh(n, out=n)
        new = state - n
        new *= z
        new += n
        return new, r, z, n, un

    def train(self, texts: list[np.ndarray], labels: np.ndarray, params: LangParams) -> None:
        """texts: bytes, none empty. Adam on the mean cross-entropy of all positions, classes weighted alike."""
        rng = np.random.default_rng(params.seed + 1)
        p, h, c = self.p, self.hidden, len(self.languages)
        weight = len(labels) / (c * np.maximum(1, np.bincount(labels, minlength=c)))
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for it in range(params.steps):
            pick = rng.integers(0, len(labels), params.batch)
            places = rng.random(params.batch)
            windows = [np.resize(texts[k][int(f * max(1, len(texts[k]) - params.bptt + 1)) :][: params.bptt], params.bptt) for k, f in zip(pick, places, strict=True)]
            grads = self._gradients(np.stack(windows).T, labels[pick], weight[labels[pick]].astype(np.float32))
            rate = params.rate * min(1, 2 * (1 - it / params.steps))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g / max(1.0, norm)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                p[k] -= (rate * (m1[k] / (1 - 0.9 ** (it + 1))) / (np.sqrt(m2[k] / (1 - 0.99 ** (it + 1))) + 1e-8)).astype(np.float32)

    def _gradients(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """x: (time, batch) bytes. Forward through time, cross-entropy at each position, then backward through time."""
        p, h, (steps, batch) = self.p, self.hidden, x.shape
        both = np.stack([x, x[::-1]], axis=1)
        state = np.zeros((2, h, batch), np.float32)
        kept, states = [], [state]
        for t in range(steps):
            inp = np.stack([p["x"][d][:, both[t, d]] for d in range(2)])
            state, r, z, n, un = self.step(inp, state, p["u"], p["bn"])
            kept.append((r, z, n, un))
            states.append(state)
        hf = np.stack([s[0] for s in states[1:]])
        hb = np.stack([s[1] for s in states[1:]])[::-1]
        logits = np.matmul(p["o"][0], hf) + np.matmul(p["o"][1], hb) + p["b"]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        prob[:, label, np.arange(batch)] -= 1
        prob *= weight / (steps * batch)
        out = {k: np.zeros_like(v) for k, v in p.items()}
        out["b"] = prob.sum(axis=(0, 2))[:, None]
        out["o"][0] = np.einsum("tcb,thb->ch", prob, hf)
        out["o"][1] = np.einsum("tcb,thb->ch", prob, hb)
        down = np.stack([np.matmul(p["o"][0].T, prob), np.matmul(p["o"][1].T, prob)[::-1]], axis=1)
        dh = np.zeros((2, h, batch), np.float32)
        for t in range(steps - 1, -1, -1):
            r, z, n, un = kept[t]
            last = states[t]
            dh = dh + down[t]
            dz = dh * (last - n) * z * (1 - z)
            dn = dh * (1 - z) * (1 - n * n)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dr, dz, dn * r], axis=1)
            dx = np.concatenate([dr, dz, dn], axis=1)
            out["u"] += np.matmul(du, last.transpose(0, 2, 1))
            out["bn"] += (dn * r).sum(axis=2, keepdims=True)
            for d in range(2):
                hot = np.zeros((batch, 256), np.float32)
                hot[np.arange(batch), both[t, d]] = 1
                out["x"][d] += dx[d] @ hot
            dh = dh * z + np.matmul(p["u"].transpose(0, 2, 1), du)
        return out

    def label(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Summed probabilities (language, window) over the positions of windows sorted by falling length; with keep, also those of each position (position, language, window)."""
        p, h, c = self.p, self.hidden, len(self.languages)
        most, total = int(lengths[0]), len(lengths)
        at = np.arange(most)[:, None] + starts[None, :]
        read = data[np.minimum(at, len(data) - 1)].astype(np.intp)
        del at
        live = np.searchsorted(-lengths, -np.arange(most), "left")
        logits = np.empty((most, c, total), np.float32)
        sums, each = np.zeros((c, total), np.float32), np.zeros((most, c, total), np.float32) if keep else None
        for d, times in enumerate((range(most), range(most - 1, -1, -1))):
            # sigmoid(v) = (1 + tanh(v / 2)) / 2: the halves go into the weights, so that one tanh serves both gates
            x, u, bn = p["x"][d].copy(), p["u"][d].copy(), p["bn"][d] * np.float32(0.5)
            x[: 2 * h] *= 0.5
            u *= 0.5
            state = np.zeros((h, total), np.float32)
            for t in times:
                n = int(live[t])
                now = state[:, :n]
                inp = np.take(x, read[t, :n], axis=1, mode="clip")
                a = u @ now
                g = inp[: 2 * h]
                g += a[: 2 * h]
                np.tanh(g, out=g)
                g += 1
                un = a[2 * h :]
                un += bn
                un *= g[:h]
                un += inp[2 * h :]
                np.tanh(un, out=un)
                z = g[h:]
                z *= 0.5
                now -= un
                now *= z
                now += un
                if d == 0:
                    np.matmul(p["o"][0], now, out=logits[t, :, :n])
                    continue
                out = p["o"][1] @ now
                out += logits[t, :, :n]
                out += p["b"]
                out -= out.max(axis=0)
                np.exp(out, out=out)
                out /= out.sum(axis=0)
                sums[:, :n] += out
                if keep:
                    each[t, :, :n] = out
        return sums, each

    def pooled(self, data: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
        """For each row the mean distribution over all its bytes; rows without bytes get zeros."""
        rows, sizes = len(offsets) - 1, np.diff(offsets)
        parts = -(-sizes // window)
        row = np.repeat(np.arange(rows), parts)
        if not len(row):
            return np.zeros((rows, len(self.languages)))
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        lo, hi = nth * sizes[row] // parts[row], (nth + 1) * sizes[row] // parts[row]
        order = np.argsort(-(hi - lo), kind="stable")
        starts, lengths, row = (offsets[row] + lo)[order], (hi - lo)[order], row[order]
        # the positions of a block of windows hold 32 MB of probabilities at most
        block = max(1, 8_000_000 // (window * len(self.languages)))
        sums = np.zeros((len(self.languages), rows))
        for at in range(0, len(row), block):
            found, _ = self.label(data, starts[at : at + block], lengths[at : at + block])
            for k in range(len(self.languages)):
                sums[k] += np.bincount(row[at : at + block], weights=found[k], minlength=rows)
        return sums.T / np.maximum(1, sizes)[:, None]

    def positions(self, text: str, window: int) -> list[str]:
        """The label of every byte of a text."""
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = [i * len(data) // max(1, -(-len(data) // window)) for i in range(-(-len(data) // window) + 1)]
        spans = sorted(((b - a, a) for a, b in zip(cuts, cuts[1:], strict=False)), key=lambda x: (-x[0], x[1]))
        if not spans:
            return []
        _, prob = self.label(data, np.array([a for _, a in spans]), np.array([n for n, _ in spans]), keep=True)
        out = [""] * len(data)
        for k, (n, a) in enumerate(spans):
            for i, best in enumerate(prob[:n, :, k].argmax(axis=1)):
                out[a + i] = self.languages[best]
        return out


def train_language_model(labelled: DataFrame, params: LangParams = LangParams(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> BiGru | None:
    """A network from a bounded sample of rows with text and language; None without any."""
    rows = bounded_sample(labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(key, lang, text), key, params.train_rows, labelled)
    if not rows:
        return None
    languages = sorted({r[lang] for r in rows})
    model = BiGru(languages, params.hidden, params.seed)
    if len(languages) > 1:
        model.train([np.frombuffer(r[text].encode(), np.uint8) for r in rows], np.array([languages.index(r[lang]) for r in rows]), params)
    return model


def identify_language(docs: DataFrame, model: BiGru | None, params: LangParams = LangParams(), text: str = "text") -> DataFrame:
    """docs with lang_pred and score added in place of any columns of those names."""
    docs = docs.drop("lang_pred", "score")
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    schema = docs.schema
    keep = [f.name for f in schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytescan.buffers(batch.column(text))
            prob = [model.pooled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], params.window) for a, b in bytescan.slices(offsets, 1_000_000)]
            prob = np.concatenate(prob) if prob else np.zeros((0, len(model.languages)))
            best = prob.argmax(axis=1) if len(prob) else np.zeros(0, int)
            seen = np.asarray(batch.column("__letters"))
            named = np.where(seen, np.array(model.languages, object)[best], "und")
            score = np.where(seen, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(named, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    out = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, text, letters.alias("__letters")).mapInArrow(run, out)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_language_model(docs.filter(crc_mod("doc_id", 4) != 2))
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
