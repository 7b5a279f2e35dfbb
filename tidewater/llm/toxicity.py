"""Toxicity by a bidirectional gated recurrent network with attention pooling over characters and words.

A word is a run of letters, digits and characters beyond ASCII, in lower case; one of over ``LONGEST`` bytes is read as consecutive
pieces. Its input is a vector of the word plus the mean of the vectors of its runs of three and four bytes, edges marked, all hashed.
Windows of ``WINDOW`` words begin every ``STRIDE`` words, so neighbours share some; the last window ends with the text. Two gated
recurrent layers read a window from both ends, attention weighs their states, and a linear layer gives the window's margin. A
document's margin is that of its worst window, and a logistic curve fitted to rows kept apart turns it into a score.

Everything is trained here in numpy: gradients by hand, steps by Adam. What a word contributes to the gates is computed once for each
distinct word of a batch, so a window costs only its recurrences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import INVERSE, POWER, _BYTE, discard, mix, pieces, written

#: The most labelled rows that the model is fitted to, a quarter of them toxic at most, those of least hash, and the windows that training reads of each: most of them
#: hold the text's runs of largest log-count ratio between the classes, the rest are spread evenly.
MOST_ROWS, ROW_WINDOWS, EVEN = 12_000, 5, 1
WINDOW, STRIDE, LONGEST = 32, 24, 32
WORD_BITS, GRAM_BITS, GRAMS = 17, 17, (3, 4)
INPUT, HIDDEN, LOOK = 8, 8, 8
#: A word or run that fewer labelled rows have gets no vector.
LEAST_ROWS = 3
BATCH, STEPS, RATE, TABLE_RATE = (16, 40), 300, 1e-2, 0.3
#: Training ends once toxic rows were read so often, but not before LEAST_STEPS; few rows would else be learned by heart.
READINGS, LEAST_STEPS = 30, 80

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


# ---------------------------------------------------------------- words


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of UTF-8 bytes in lower case."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = np.concatenate(([False], _TERM[b], [False]))
    edge = np.flatnonzero(own[1:] != own[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if len(starts) and (ends - starts).max() > LONGEST:
        parts = -(-(ends - starts) // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * LONGEST
        ends = np.minimum(starts + LONGEST, np.repeat(ends, parts))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * POWER.first(len(b)), out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * INVERSE.at(starts) + (ends - starts).astype(np.uint64))


def spelled(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts): numbers of the byte runs of each word, one after the other, and how many each word has."""
    b = np.frombuffer(raw, np.uint8)
    size = (ends - starts) + 2
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first, size)
    inside = (at > 0) & (at < np.repeat(size, size) - 1)
    text = np.full(len(at), 1, np.uint64)  # a byte that no text has here marks both edges
    text[inside] = b[(np.repeat(starts, size) + at - 1)[inside]]
    left = np.repeat(first + size, size) - np.arange(len(at))
    word = np.repeat(np.arange(len(size)), size)
    grams, owner = [], []
    h = text.copy()
    for k in range(2, max(GRAMS) + 1):
        h[: len(h) - k + 1] = h[: len(h) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + text[k - 1 :]
        if k in GRAMS:
            fits = left >= k
            grams.append((mix(h[fits] + np.uint64(k)) >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
            owner.append(word[fits])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    return grams[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(size))


def window_starts(n: int) -> np.ndarray:
    """Where the windows of a text of n words begin; a short text is one window."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    at = np.arange(0, n - WINDOW, STRIDE)
    return np.append(at, n - WINDOW)


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def initial(seed: int = 12, dtype=np.float32) -> dict[str, np.ndarray]:
    """Weights before training; words and runs begin at zero, so what training never saw adds nothing."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(dtype)
    out = {"word": np.zeros((1 << WORD_BITS, INPUT), dtype), "gram": np.zeros((1 << GRAM_BITS, INPUT), dtype)}
    for side in "fb":
        out |= {f"w{side}": draw(INPUT, 3 * HIDDEN), f"u{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, dtype), f"d{side}": np.zeros(HIDDEN, dtype)}
    return out | {"look": draw(2 * HIDDEN, LOOK), "bias": np.zeros(LOOK, dtype), "weigh": draw(LOOK), "out": draw(2 * HIDDEN), "level": np.zeros(1, dtype)}


def _run(p: dict, side: str, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
    """States (time, window, HIDDEN) of one direction; ids (time, window) are rows of the words' part of the gates."""
    steps, n = ids.shape
    u, d = p[f"u{side}"], p[f"d{side}"]
    h = np.zeros((n, HIDDEN), u.dtype)
    out = np.empty((steps, n, HIDDEN), u.dtype)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        x, r = gates[ids[t]], h @ u
        zr = x[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN]
        np.negative(zr, out=zr)
        np.clip(zr, -30, 30, out=zr)
        np.exp(zr, out=zr)
        zr += 1.0
        np.reciprocal(zr, out=zr)
        z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
        inner = r[:, 2 * HIDDEN :] + d
        new = np.tanh(x[:, 2 * HIDDEN :] + reset * inner)
        after = new + z * (h - new)
        if mask is not None:
            after = np.where(mask[t][:, None], after, h)
        if keep is not None:
            keep.append((t, h, z, reset, inner, new))
        h = after
        out[t] = h
    return out


def forward(p: dict, gates: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray | None, tape: dict | None = None) -> np.ndarray:
    """The margin of each window; ids (time, window), mask likewise, or None where all windows are full."""
    kept = {"f": [], "b": []} if tape is not None else {"f": None, "b": None}
    h = np.concatenate([_run(p, s, gates[s], ids, mask, kept[s]) for s in "fb"], axis=2)
    look = np.tanh(h @ p["look"] + p["bias"])
    s = look @ p["weigh"]
    if mask is not None:
        s = np.where(mask, s, -1e4)
    a = np.exp(s - s.max(axis=0))
    if mask is not None:
        a = np.where(mask, a, 0)
    a = a / np.maximum(a.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", a, h)
    if tape is not None:
        tape |= {"kept": kept, "h": h, "look": look, "a": a, "pooled": pooled}
    return pooled @ p["out"] + p["level"][0]


def backward(p: dict, inputs: np.ndarray, ids: np.ndarray, mask: np.ndarray, tape: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """(gradients of the weights, gradients of the words' inputs) for ``slope``, the gradient of each window's margin."""
    g = {"out": tape["pooled"].T @ slope, "level": np.array([slope.sum()], slope.dtype)}
    h, a, look = tape["h"], tape["a"], tape["look"]
    pooled = slope[:, None] * p["out"]
    da = np.einsum("nh,tnh->tn", pooled, h)
    dh = a[:, :, None] * pooled
    ds = a * (da - (a * da).sum(axis=0))
    g["weigh"] = np.einsum("tn,tnk->k", ds, look)
    dl = ds[:, :, None] * p["weigh"] * (1 - look * look)
    g["look"], g["bias"] = np.einsum("tnh,tnk->hk", h, dl), dl.sum(axis=(0, 1))
    dh += dl @ p["look"].T
    words = np.zeros_like(inputs)
    for i, side in enumerate("fb"):
        u = p[f"u{side}"]
        back = np.zeros((ids.shape[1], HIDDEN), u.dtype)
        du, dd, dgates = np.zeros_like(u), np.zeros_like(p[f"d{side}"]), np.zeros((len(inputs), 3 * HIDDEN), u.dtype)
        dx = np.empty((*ids.shape, 3 * HIDDEN), u.dtype)
        for t, before, z, reset, inner, new in reversed(tape["kept"][side]):
            back = back + dh[t, :, i * HIDDEN : (i + 1) * HIDDEN]
            on = np.where(mask[t][:, None], back, 0)
            dz = on * (before - new) * z * (1 - z)
            dn = on * (1 - z) * (1 - new * new)
            dr = dn * inner * reset * (1 - reset)
            dinner = dn * reset
            dx[t, :, :HIDDEN], dx[t, :, HIDDEN : 2 * HIDDEN], dx[t, :, 2 * HIDDEN :] = dz, dr, dn
            r = np.concatenate((dz, dr, dinner), axis=1)
            du += before.T @ r
            dd += dinner.sum(axis=0)
            back = (back - on) + on * z + r @ u.T
        np.add.at(dgates, ids.ravel(), dx.reshape(-1, 3 * HIDDEN))
        g[f"u{side}"], g[f"d{side}"], g[f"c{side}"], g[f"w{side}"] = du, dd, dgates.sum(axis=0), inputs.T @ dgates
        words += dgates @ p[f"w{side}"].T
    return g, words


@dataclass
class Model:
    p: dict
    slope: float
    level: float

    def inputs(self, number: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return inputs(self.p, number, grams, counts)

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * margins + self.level)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """The margin of each text over all its windows."""
        out = np.empty(len(texts))
        for i, j in _runs(texts):
            out[i:j] = self._margins(texts[i:j])
        return out

    def _margins(self, texts: list[bytes]) -> np.ndarray:
        raw = b"\n".join(texts) + b"\n"
        begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
        starts, ends, h = words(raw)
        doc_first = np.searchsorted(starts, begin)
        sizes = np.diff(doc_first)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        number = (h[first] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        x = self.inputs(number, *spelled(raw, starts[first], ends[first]))
        gates = {s: x @ self.p[f"w{s}"] + self.p[f"c{s}"] for s in "fb"}
        out = np.full(len(texts), -np.inf)
        long = np.flatnonzero(sizes >= WINDOW)
        at = [window_starts(int(n)) for n in sizes[long]]
        if len(at):
            owner = np.repeat(long, [len(a) for a in at])
            place = np.concatenate(at) + doc_first[owner]
            for k in range(0, len(place), 4096):
                ids = which[place[k : k + 4096] + np.arange(WINDOW)[:, None]]
                np.maximum.at(out, owner[k : k + 4096], forward(self.p, gates, ids, None))
        short = np.flatnonzero(sizes < WINDOW)
        if len(short):
            gates = {s: np.vstack((g, np.zeros((1, 3 * HIDDEN), g.dtype))) for s, g in gates.items()}
            place = np.arange(WINDOW)[:, None]
            mask = place < sizes[short]
            ids = np.where(mask, np.append(which, len(first))[np.minimum(doc_first[short] + place, len(which))], len(first))
            out[short] = forward(self.p, gates, ids, mask)
        return out


def inputs(p: dict, number: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The input of each word: its own vector and the mean of its runs'."""
    out = p["word"][number]
    if len(grams):
        sums = np.zeros((len(number), INPUT), out.dtype)
        some = counts > 0
        sums[some] = np.add.reduceat(p["gram"][grams], (np.cumsum(counts) - counts)[some], axis=0)
        out = out + sums / np.maximum(counts, 1)[:, None].astype(out.dtype)
    return out


def _runs(texts: list[bytes], most: int = 1 << 20):
    """Bounds of runs of texts of about ``most`` bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


# ---------------------------------------------------------------- training


def _word_odds(raw: bytes, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The largest log-count ratio among each word's runs, 0 at least."""
    if not len(h):
        return np.zeros(0)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    grams, counts = spelled(raw, starts[first], ends[first])
    top = np.zeros(len(first))
    some = counts > 0
    if some.any():
        top[some] = np.maximum(0, np.maximum.reduceat(odds[grams], (np.cumsum(counts) - counts)[some]))
    return top[which]


def sample(raw: bytes, odds: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Lengths and words, joined by spaces, of at most ROW_WINDOWS windows of a text: those whose two largest ratios sum to most, and EVEN others."""
    starts, ends, h = words(raw)
    at = window_starts(len(starts))
    if len(at) > ROW_WINDOWS:
        per = _word_odds(raw, starts, ends, h, odds)
        two = np.sort(per[at[:, None] + np.arange(WINDOW)], axis=1)[:, -2:].sum(axis=1)
        even = np.linspace(0, len(at) - 1, EVEN + 2).round().astype(int)[1:-1]
        at = at[np.unique(np.concatenate((np.argsort(-two, kind="stable")[: ROW_WINDOWS - EVEN], even)))]
    cut = [(int(a), min(int(a) + WINDOW, len(starts))) for a in at]
    return [j - i for i, j in cut], [b" ".join(raw[starts[w] : ends[w]] for w in range(i, j)) for i, j in cut]


def log_ratios(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Of each run, from how many texts of each class have it."""
    return np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))


def _rows_of_grams(owned: np.ndarray, size: int, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many rows have each run; ``owned`` is row * size + word, sorted."""
    out, first = np.zeros(1 << GRAM_BITS, np.int64), np.cumsum(counts) - counts
    row, word = owned // size, owned % size
    for part in np.split(word, np.flatnonzero(np.diff(row)) + 1):
        n = counts[part]
        at = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.unique(grams[at])] += 1
    return out


def train(rows: list[tuple[list[int], bytes]], labels: np.ndarray, steps: int = STEPS, seed: int = 12) -> Model:
    """Fits to rows of (lengths of windows, their words). With one class alone, or no rows, the model gives that class's share everywhere."""
    bad = int((labels > 0).sum())
    p = initial(seed)
    if not 0 < bad < len(rows):
        share = (bad + 1.0) / (len(rows) + 2.0)
        return Model(p, 0.0, float(np.log(share / (1 - share))))
    raw = b"\n".join(text for _, text in rows) + b"\n"
    starts, ends, h = words(raw)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    number = (h[first] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    grams, counts = spelled(raw, starts[first], ends[first])
    gram_at = np.cumsum(counts) - counts
    lengths = [np.array(n) for n, _ in rows]
    offset = np.cumsum([0, *[int(n.sum()) for n in lengths]])
    # what few rows have is theirs, not their class's: it gets row 0 of its table, which stays at zero
    owned = np.unique(np.repeat(np.arange(len(rows)), np.diff(offset)) * len(first) + which)
    number[np.bincount(owned % len(first), minlength=len(first)) < LEAST_ROWS] = 0
    grams[_rows_of_grams(owned, len(first), grams, counts)[grams] < LEAST_ROWS] = 0
    apart = np.arange(len(rows)) % 8 == 7
    if len(set((labels[apart] > 0).tolist())) < 2 or len(set((labels[~apart] > 0).tolist())) < 2:
        apart[:] = False
    fit, tune = np.flatnonzero(~apart), np.flatnonzero(apart) if apart.any() else np.arange(len(rows))

    def batch(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct words, ids, mask, owner) of the windows of the rows."""
        n = np.concatenate([lengths[i] for i in chosen])
        owner = np.repeat(np.arange(len(chosen)), [len(lengths[i]) for i in chosen])
        begin = np.concatenate([offset[i] + np.cumsum(lengths[i]) - lengths[i] for i in chosen])
        place = np.arange(WINDOW)[:, None]
        mask = place < n
        flat = np.where(mask, which[np.minimum(begin + place, max(len(which) - 1, 0))] if len(which) else 0, -1)
        there, ids = np.unique(flat, return_inverse=True)
        return there, ids.reshape(flat.shape), mask, owner

    def spell(there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, runs, counts) of distinct words; -1 is no word."""
        real = there[there >= 0]
        c = counts[real]
        own = np.repeat(gram_at[real] - np.concatenate(([0], np.cumsum(c)))[: len(c)], c) + np.arange(c.sum())
        pad = len(there) - len(real)
        return np.concatenate((np.zeros(pad, np.int64), number[real])), grams[own], np.concatenate((np.zeros(pad, np.int64), c))

    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k not in ("word", "gram")}
    square = {k: np.full_like(p[k], 1e-10) for k in ("word", "gram")}
    rng, pools = np.random.default_rng(seed), [fit[labels[fit] > 0], fit[labels[fit] <= 0]]
    steps = min(steps, max(LEAST_STEPS, READINGS * len(pools[0]) // BATCH[0]))
    for step in range(1, steps + 1):
        # batches hold as many of each class always; the curve fitted afterwards brings the shares back
        chosen = np.concatenate([rng.choice(x, min(n, len(x)), replace=False) for x, n in zip(pools, BATCH)])
        y = (labels[chosen] > 0).astype(np.float32)
        there, ids, mask, owner = batch(chosen)
        num, gr, cn = spell(there)
        x = inputs(p, num, gr, cn)
        tape: dict = {}
        margin = forward(p, {s: x @ p[f"w{s}"] + p[f"c{s}"] for s in "fb"}, ids, mask, tape)
        worst = np.full(len(chosen), -np.inf, np.float32)
        np.maximum.at(worst, owner, margin)
        top = np.full(len(chosen), -1)
        hit = np.flatnonzero(margin >= worst[owner])
        top[owner[hit[::-1]]] = hit[::-1]
        slope = np.zeros(len(margin), np.float32)
        slope[top] = (_sigmoid(worst) - y) / len(chosen)
        g, gw = backward(p, x, ids, mask, tape, slope)
        gw[there < 0] = 0
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, rows_of, of in (("word", num, gw), ("gram", gr, np.repeat(gw / np.maximum(cn, 1)[:, None], cn, axis=0))):
            touched, where = np.unique(rows_of, return_inverse=True)  # tables move where the batch touches them alone
            d = np.zeros((len(touched), INPUT), np.float32)
            np.add.at(d, where, of.astype(np.float32))
            d[touched == 0] = 0
            square[k][touched] += d * d
            p[k][touched] -= (rate / RATE) * TABLE_RATE * d / np.sqrt(square[k][touched])
        for k, (m, s) in moment.items():
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] * g[k] - s)
            p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    model = Model(p, 1.0, 0.0)
    worst = np.full(len(tune), -np.inf)
    for k in range(0, len(tune), 256):
        there, ids, mask, owner = batch(tune[k : k + 256])
        x = inputs(p, *spell(there))
        np.maximum.at(worst[k : k + 256], owner, forward(p, {s: x @ p[f"w{s}"] + p[f"c{s}"] for s in "fb"}, ids, mask))
    model.slope, model.level = calibrated(worst, labels[tune] > 0)
    return model


def calibrated(m: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and level of the logistic curve of margins, with targets drawn in from 0 and 1 and a weak pull of the slope towards 1."""
    t = t.astype(float)
    smooth = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        q = _sigmoid(a * m + b)
        v = np.maximum(q * (1 - q), 1e-9)
        g = np.array([((q - smooth) * m).sum() + 0.1 * (a - 1), (q - smooth).sum()])
        h = np.array([[(v * m * m).sum() + 0.1, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


# ---------------------------------------------------------------- over Spark


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _lowered(column) -> list[bytes]:
    return pc.utf8_lower(pc.fill_null(column, "")).cast(pa.large_binary()).to_pylist()


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> Model:
    """Fits to at most ``most_rows`` labelled ids that have a document and are not held out; labels (doc_id, toxic) other than 0 and 1 are left out.

    Of an id with several labels the larger counts, of one with several texts the least; null texts are empty; equal texts are one row. Ids of least hash are
    taken, as many of each class at most, so ties do not matter. The driver holds ROW_WINDOWS windows of WINDOW words of LONGEST
    bytes of each row, 5 KB at most, and counts of 2 ** GRAM_BITS runs. Without labels or documents the model gives one half.
    """
    known = labels.filter("toxic in (0, 1)").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    have = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    known = known.join(have, "doc_id", "left_semi")
    order = [F.xxhash64(F.lit(12), "doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(most_rows // 4).unionByName(known.filter("toxic = 0").orderBy(*order).limit(most_rows - most_rows // 4))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min("text").alias("text"))
    rows = rows.groupBy(F.xxhash64("text").alias("th"), F.length("text").alias("n")).agg(F.min_by(F.struct("doc_id", "toxic", "text"), F.struct(-F.col("toxic"), F.col("doc_id"))).alias("r")).select("r.*")

    rows = written(rows, "labelled")

    def counted(batches):
        n, have = [0, 0], np.zeros((2, 1 << GRAM_BITS), np.int64)
        for batch in pieces(batches):
            for bad, raw in zip(batch.column(1).to_pylist(), _lowered(batch.column(2))):
                starts, ends, h = words(raw)
                n[bad] += 1
                if len(h):
                    first = np.unique(h, return_index=True)[1]
                    have[bad, np.unique(spelled(raw, starts[first], ends[first])[0])] += 1
        for bad in (0, 1):
            own = np.flatnonzero(have[bad])
            numbers, counts = np.append(own, -1), np.append(have[bad, own], n[bad])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), bad, np.int32)), pa.array(numbers.astype(np.int32)), pa.array(counts)], ["bad", "gram", "n"])

    have, n = np.zeros((2, 1 << GRAM_BITS)), [0, 0]
    for r in rows.mapInArrow(counted, "bad int, gram int, n long").groupBy("bad", "gram").agg(F.sum("n").alias("n")).collect():  # as many rows as runs have numbers
        if r["gram"] < 0:
            n[r["bad"]] = r["n"]
        else:
            have[r["bad"], r["gram"]] = r["n"]
    odds = log_ratios(have[1], have[0], n[1], n[0])

    def run(batches):
        for batch in pieces(batches):
            found = [sample(t, odds) for t in _lowered(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.list_(pa.int32())), pa.array([b" ".join(t) for _, t in found], pa.binary())], ["doc_id", "toxic", "n", "x"])

    got = sorted(rows.mapInArrow(run, "doc_id long, toxic int, n array<int>, x binary").collect(), key=lambda r: (zip_hash(r["doc_id"]), r["doc_id"]))
    discard(rows)
    return train([(list(r["n"]), bytes(r["x"])) for r in got], np.array([r["toxic"] for r in got]), steps)


def zip_hash(i: int) -> int:
    """A fixed order of rows that does not follow their ids."""
    return (i * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, held_out, score, predicted) of every row over all windows of its whole text.

    Null and empty texts, and texts without words, get the score of an empty window; rows that repeat are equal; a null id counts as
    not held out. The model, some three megabytes, is sent to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            m = shared.value
            s = m.scores(m.margins(_lowered(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.3).astype(np.int32))], ["did", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("did"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "did long, held_out boolean, score double, predicted int")
