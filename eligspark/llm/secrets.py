"""Secret scan: exact base patterns plus a character convolutional network over other candidates.

Base findings are what three fixed patterns match.  They and every other candidate (a run of key-like
characters of at least 16 characters with letters and digits, or with several changes of
case) are judged with their surroundings by a small convolutional network written in numpy; base findings
stay whatever it says, and how many of them it accepts is reported beside them, so that its recall can be read from any
table.  The network is trained on labelled findings, its scores (the highest over a finding's windows, as in use) are
calibrated (Platt) on findings that it has not seen, and the decision threshold is the highest one that keeps the stated
recall on them.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "model")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
DIGIT, ALPHA, TURN = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"), re.compile(r"[a-z][A-Z]|[A-Z][a-z]")
LEFT, BODY, RIGHT = 16, 48, 8
WIDTH, CHANNELS, LETTERS, EMBED = 5, 24, 98, 8

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, n_base_accepted long"


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping for each kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans for the network to judge: outside base findings, with letters and digits or turns of case."""
    out = []
    starts = [f[0] for f in found]
    furthest = list(accumulate((f[2] for f in found), max))
    for m in CANDIDATE.finditer(text):
        body = m[0]
        if not ((DIGIT.search(body) and ALPHA.search(body)) or len(TURN.findall(body)) >= 4):
            continue
        a, b = m.span()
        before = bisect_left(starts, b)
        if not before or furthest[before - 1] <= a:
            out.append((a, b))
    return out


CODES = np.full(0x110000, 97, np.uint8)
CODES[32:127] = np.arange(1, 96)
CODES[:32] = 96


def windows(text: str, a: int, b: int) -> list[np.ndarray]:
    """Code windows that together cover the whole span [a, b) with the text around each piece."""
    out = []
    for at in range(a, max(a + 1, b - BODY // 2), BODY // 2):
        end = min(b, at + BODY)
        left, right = text[max(0, at - LEFT) : at], text[end : end + RIGHT]
        row = np.zeros((2, LEFT + BODY + RIGHT), np.uint8)
        for start, piece in ((LEFT - len(left), left), (LEFT, text[at:end]), (LEFT + end - at, right)):
            codes = CODES[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
            row[0, start : start + len(codes)] = codes
        row[1, LEFT : LEFT + end - at] = 1
        out.append(row)
        if end == b:
            break
    return out


@dataclass
class Network:
    """embedding -> convolution -> rectifier -> (maximum, mean) -> logistic output, with its calibration."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _columns(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        signal = np.concatenate([self.embed[x[:, 0]], x[:, 1, :, None].astype(np.float32)], axis=2)
        view = np.lib.stride_tricks.sliding_window_view(signal, WIDTH, axis=1)
        return signal, view.transpose(0, 1, 3, 2).reshape(len(x), view.shape[1], -1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(self._columns(x)[1] @ self.kernel + self.bias, 0)
        return np.concatenate([h.max(1), h.mean(1)], axis=1) @ self.out + self.out_bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        scores = [self.logits(x[k : k + 512]) for k in range(0, len(x), 512)]
        return 1 / (1 + np.exp(-(self.scale * np.concatenate(scores) + self.shift)))


def train(findings: list[list[np.ndarray]], y: np.ndarray, seed: int = 7, epochs: int = 10, rate: float = 4e-3, recall: float = 0.98) -> Network:
    """Fit on three quarters of the labelled findings (each one's windows; the first is fitted); calibrate and set the threshold on the rest."""
    x = np.stack([f[0] for f in findings])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    fit, held = order[: 3 * len(x) // 4], order[3 * len(x) // 4 :]
    size = WIDTH * (EMBED + 1)
    net = Network(
        rng.normal(0, 0.3, (LETTERS, EMBED)).astype(np.float32), rng.normal(0, (2 / size) ** 0.5, (size, CHANNELS)).astype(np.float32), np.zeros(CHANNELS, np.float32), rng.normal(0, 0.1, 2 * CHANNELS).astype(np.float32), 0.0
    )
    net.embed[0] = 0
    names = ("embed", "kernel", "bias", "out", "out_bias")
    first = {n: np.zeros_like(getattr(net, n), dtype=np.float32) for n in names}
    second = {n: np.zeros_like(getattr(net, n), dtype=np.float32) for n in names}
    t = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for k in range(0, len(fit), 128):
            rows = fit[k : k + 128]
            xb, yb, m = x[rows], y[rows], len(rows)
            signal, columns = net._columns(xb)
            pre = columns @ net.kernel + net.bias
            h = np.maximum(pre, 0)
            top = h.argmax(1)
            pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], axis=1)
            error = (1 / (1 + np.exp(-(pooled @ net.out + net.out_bias))) - yb) / m
            d_pooled = error[:, None] * net.out
            d_h = np.repeat(d_pooled[:, None, CHANNELS:] / h.shape[1], h.shape[1], axis=1)
            i, c = np.indices((m, CHANNELS))
            d_h[i, top, c] += d_pooled[:, :CHANNELS]
            d_h *= pre > 0
            flat = d_h.reshape(-1, CHANNELS)
            d_columns = (flat @ net.kernel.T).reshape(m, h.shape[1], WIDTH, EMBED + 1)
            d_signal = np.zeros_like(signal)
            for w in range(WIDTH):
                d_signal[:, w : w + h.shape[1]] += d_columns[:, :, w]
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, xb[:, 0].ravel(), d_signal[:, :, :EMBED].reshape(-1, EMBED))
            d_embed[0] = 0
            grads = {"embed": d_embed, "kernel": columns.reshape(-1, size).T @ flat, "bias": flat.sum(0), "out": pooled.T @ error, "out_bias": error.sum()}
            t += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                change = rate * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8)
                setattr(net, n, getattr(net, n) - change)
    calibrate(net, [findings[k] for k in held], y[held], recall)
    return net


def calibrate(net: Network, rows: list[list[np.ndarray]], y: np.ndarray, recall: float) -> None:
    """Platt's scaling on held-out findings, each by its highest window, then the highest threshold that keeps `recall` there."""
    x = np.stack([w for r in rows for w in r])
    starts = np.r_[0, np.cumsum([len(r) for r in rows])[:-1]]
    z = np.maximum.reduceat(np.concatenate([net.logits(x[k : k + 512]) for k in range(0, len(x), 512)]), starts)
    positive, negative = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - goal) * z).sum(), (p - goal).sum()])
        hessian = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    net.scale, net.shift = float(a), float(b)
    scores = np.sort(1 / (1 + np.exp(-(a * z[y == 1] + b))))
    net.threshold = float(scores[min(len(scores) - 1, int(np.floor((1 - recall) * len(scores))))])


def labelled_findings(n: int = 6000, seed: int = 11) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Labelled findings: (text, start, end) and 1 for secrets, 0 for look-alikes such as paths, dates, slugs and names.

    They are generated by rule from a seed, so that training needs no rows of the corpus and
    gives the same network everywhere.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    syllables = ["an", "the", "er", "in", "on", "re", "ti", "ou", "st", "ly", "ing", "ble", "és", "ión", "ge", "sch", "lle", "que"]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 5)))
    plain = lambda: re.sub(r"[^a-z]", "", word()) or "an"
    b62, b64, up = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits
    secret = [
        lambda: chars(b62, rng.integers(20, 49)),
        lambda: chars(b64, rng.integers(24, 60)) + pick(["", "=", "=="]),
        lambda: pick(["ghp_", "gho_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "npm_", "AIza"]) + chars(b62, rng.integers(20, 41)),
        lambda: ".".join("ey" + chars(b62 + "_-", rng.integers(12, 40)) for _ in range(3)),
        lambda: chars(up, rng.integers(24, 41)),
        lambda: "-".join(chars(b62, 8) for _ in range(4)),
        lambda: chars("0123456789abcdef", rng.integers(16, 65)),
        lambda: "AKIA" + chars(up, rng.integers(14, 21)),
        lambda: chars(string.digits, rng.integers(16, 20)),
        lambda: pick(WORDS) + pick([" = ", "=", ": ", '": "', "='"]) + chars(b62 + "_-", rng.integers(12, 33)),
    ]
    harmless = [
        lambda: "/".join(plain() for _ in range(rng.integers(3, 7))) + pick(["", ".html", ".tar.gz", "/v2", "/2024"]) + str(rng.integers(0, 99)),
        lambda: "-".join(plain() for _ in range(rng.integers(3, 7))) + "-" + str(rng.integers(1, 3000)),
        lambda: "_".join(plain() for _ in range(rng.integers(3, 6))) + "_" + str(rng.integers(1, 100)),
        lambda: "".join(plain().title() for _ in range(rng.integers(5, 9))) + pick(["", "2", "V3", "10"]),
        lambda: plain() + "".join(plain().title() for _ in range(rng.integers(5, 9))),
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}.{rng.integers(0, 60):02d}.00Z",
        lambda: plain() + "-" + ".".join(str(rng.integers(0, 30)) for _ in range(3)) + "-" + plain() + pick([".jar", ".whl", ".dll", "-py3"]),
        lambda: plain().upper() + "-" + str(rng.integers(100, 9999)) + "-" + plain().upper() + "-" + str(rng.integers(1, 99)),
        lambda: plain() * int(rng.integers(4, 9)) + str(rng.integers(1, 99)),
        lambda: "=" * int(rng.integers(8, 20)) + plain() + str(rng.integers(1, 9)) + "=" * int(rng.integers(4, 20)),
        lambda: plain() + "." + plain() + ".example.com/" + pick(["en", "fr", "de"]) + "/" + str(rng.integers(1, 99999)),
        lambda: "".join(plain() for _ in range(rng.integers(4, 9))) + str(rng.integers(0, 999)),
    ]
    leads = ["key: ", "auth=", "Bearer ", "credential ", "Authorization: ", "cookie ", "private_key = ", "access "]
    texts, labels = [], []
    for k in range(n):
        y = k % 2
        body = pick(secret)() if y else pick(harmless)()
        if len(body) < 16:
            body += plain() * 4
        lead = " ".join(word() for _ in range(3)) + " " + (pick(leads) if rng.random() < (0.4 if y else 0.15) else "")
        texts.append((lead + body + pick([" ", ". ", "\n", '" ', ", "]) + word(), len(lead), len(lead) + len(body)))
        labels.append(y)
    return texts, np.array(labels, np.float32)


@lru_cache(maxsize=4)
def trained_network(findings: int = 6000, seed: int = 11) -> Network:
    """The network of the labelled findings of a seed; made once in a process."""
    texts, labels = labelled_findings(findings, seed)
    return train([windows(*t) for t in texts], labels)


def highest(net: Network, rows: list[np.ndarray], owners: list[int], n: int) -> np.ndarray:
    """The highest probability of each of n findings over its windows."""
    out = np.zeros(n)
    for at in range(0, len(rows), 4096):
        np.maximum.at(out, owners[at : at + 4096], net.probabilities(np.stack(rows[at : at + 4096])))
    return out


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def scan_secrets(documents: DataFrame, network: Network | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `documents`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model, n_base_accepted.

    `spans` lists base findings and the network's further ones as kind:start:end in code
    points, by start and then kind.  Null and empty texts have no findings (the digest is that
    of the empty string); null ids stay null; repeated rows stay repeated; an empty table gives
    no rows; other columns are not read.  Long candidates are judged by overlapping windows
    that cover them whole; the highest score counts.  Very long texts are read whole; spans that tie in their
    start go by kind.  n_model: spans that the network adds; n_base_accepted: base findings that it accepts, too.
    """
    network = network or trained_network()
    shared = documents.sparkSession.sparkContext.broadcast(network)
    names = ("n_assign", "n_access", "n_hex")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_findings(t) for t in texts]
            found = [(k, f) for k, b in enumerate(base) for f in b]
            known = len(found)
            found += [(k, (a, 3, b)) for k, text in enumerate(texts) for a, b in candidates(text, base[k])]
            pieces = [(j, w) for j, (k, f) in enumerate(found) for w in windows(texts[k], f[0], f[2])]
            good = highest(net, [w for _, w in pieces], [j for j, _ in pieces], len(found)) >= net.threshold
            extra: list[set] = [set() for _ in texts]
            accepted = [0] * len(texts)
            for j in np.flatnonzero(good).tolist():
                k, f = found[j]
                if j < known:
                    accepted[k] += 1
                else:
                    extra[k].add(f)
            counts = {n: pa.array([sum(f[1] == k for f in b) for b in base], pa.int64()) for k, n in enumerate(names)}
            digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            everything = [joined([*b, *e]) for b, e in zip(base, extra)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts.values(), pa.array(digests, pa.string()), pa.array(everything, pa.string()), pa.array([len(e) for e in extra], pa.int64()), pa.array(accepted, pa.int64())], names=["doc_id", *names, "base_sha256", "spans", "n_model", "n_base_accepted"]
            )

    columns = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return columns.mapInArrow(run, SCHEMA)
