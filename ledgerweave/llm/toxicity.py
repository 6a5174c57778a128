"""Toxicity of texts: a support vector machine on a subsequence string kernel.

Texts become sentences, sentences strings of symbols: 26 letters without case and accents, one
symbol for all that separates letters, one for other letters; separators between single letters are
left out, so that a word which is spaced out or dotted is the word. The kernel of two strings is the
product of their weighted subsequences of ``ORDER`` symbols, where up to one symbol may be left out
between two that count. Each one that is left out costs a factor, less for a separator than for a
letter; so a word with characters put in still shares most of its subsequences with the plain word.

Landmarks are beginnings of words of labelled toxic texts: those that tell the labels apart best,
and are unlike each other. A sentence's similarity to a landmark is that of its best window, as a
share of the landmark's with itself; shares below ``FLOOR`` count as 0, others to the power of
``POWER``, as in a polynomial kernel. Multiplied by the inverse
root of the landmarks' own kernel matrix (the Nyström map) these are the inputs of a linear support
vector machine. Labels are of whole texts: of a toxic text, the sentence with the highest margin
stands for it, and learning and choosing alternate. Landmarks that the machine counts on
are shown to it once more with a character put in at each place, as examples of label 1. A text's score follows from its
highest sentence by a logistic curve.

Windows that can't reach the floor are found beforehand from a sum over all landmarks, for
all positions at once, so that few are compared with each landmark.
"""

from __future__ import annotations

import io
from collections.abc import Iterable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.quality import training_rows
from ledgerweave.llm.text import chunks, mix, texts_of

ORDER = 4
STEPS = tuple(product((1, 2), repeat=ORDER - 1))  # from each symbol to the next that counts
SKIPPED_LETTER, SKIPPED_BREAK = 0.5, 0.9
FLOOR = 0.3
POWER = 2  # of similarities: a word that is like two landmarks by half is like neither
LANDMARKS = 32
SHORTEST, LONGEST = 5, 12  # symbols of a landmark, with the break before it
LEAST_SENTENCES = 3  # of toxic texts that have a landmark
LEAST_GAIN = 12.0  # logarithm of the likelihood ratio; chance hardly gives it among a million words
LEAST_LIFT = 4.0  # times as common in toxic texts
ALIKE = 0.5  # from this kernel cosine on, a landmark adds nothing to another
CLEAN = 2.0  # weight of clean texts beside toxic ones in the curve
RIDGE = 1e-4  # keeps the curve from growing steep without end
ROUNDS = 4  # of learning and choosing sentences
COST = 10.0
SHOWN = 1.0  # weight of landmarks with a character put in, all together, beside that of toxic texts
MAX_ROWS = 8_000
CHUNK = 1_000_000  # bytes of text at once

BREAK, OTHER, END, LAST = 0, 27, 28, 29  # symbols; letters are 1 to 26, LAST ends a text

# The plain letters of U+00C0 to U+00DF; those of the next 32 are the same.
_LATIN = "aaaaaaaceeeeiiiidnooooo ouuuuyts"


def _symbol_table() -> np.ndarray:
    table = np.full(256, BREAK, dtype=np.uint8)
    letters = np.arange(1, 27)
    table[97:123] = table[65:91] = letters
    table[0xC0:] = OTHER  # first byte of a letter that is not Latin
    plain = np.array([0 if c == " " else ord(c) - 96 for c in _LATIN * 2], dtype=np.uint8)
    table[0x80:0xC0] = plain  # second byte after 0xC3; dropped after all others
    return table


_SYMBOL = _symbol_table()
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 11, 12, 13, 32]] = True
_COST = np.full(32, SKIPPED_LETTER, dtype=np.float32)
_COST[BREAK], _COST[END], _COST[LAST] = SKIPPED_BREAK, 0, 0


def symbols(texts: list[bytes]) -> np.ndarray:
    """The symbols of some texts. Sentences end at line ends, and at blanks after a full stop, an
    exclamation or a question mark; runs of separators are one break, and there is one at both
    sides of each end."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    out = _SYMBOL[raw]
    out[raw == 10] = END
    after = np.flatnonzero(_BLANK[raw[1:]] & _STOP[raw[:-1]]) + 1
    out[after] = END
    out[np.cumsum(lengths + 1) - 1] = LAST
    lead = raw == 0xC3
    if raw.max(initial=0) >= 0x80:
        kept = ~lead
        second = (raw & 0xC0) == 0x80
        second[1:] &= ~lead[:-1]
        kept &= ~second
        out = out[kept]
    ends = out >= END
    wide = np.repeat(out, np.where(ends, 3, 1))
    at = np.flatnonzero(wide >= END)
    wide[at[0::3]] = BREAK
    wide[at[2::3]] = BREAK
    double = np.append(False, (wide[1:] == BREAK) & (wide[:-1] == BREAK))
    return _closed_up(np.append(np.uint8(BREAK), wide[~double]))  # a break before the first word


def _closed_up(s: np.ndarray) -> np.ndarray:
    """Without the breaks between single letters, so that a word that is spaced out is a word."""
    if len(s) < 5:
        return s
    letter = (s > BREAK) & (s < END)
    gap = s == BREAK
    # before, at and after a place: break or end, letter, BREAK, letter, break or end
    inner = letter[1:-3] & gap[2:-2] & letter[3:-1] & ~letter[:-4] & ~letter[4:]
    kept = np.ones(len(s), dtype=bool)
    kept[2:-2] = ~inner
    return s[kept]


def _codes(s: np.ndarray):
    """For each way to step the codes of the subsequences that begin at each position, and
    what the symbols left out cost. All have the length of ``s`` less the farthest step."""
    n = len(s) - 2 * (ORDER - 1)
    if n <= 0:
        return
    wide = s.astype(np.int32)
    pair = {o: (wide[:-o] << 5) | wide[o:] for o in (1, 2)}
    cost = _COST[s]
    for a, b, c in STEPS:
        code = (pair[a][:n] << 10) | pair[c][a + b : a + b + n]
        weight = np.float32(1)
        for begin, step in ((0, a), (a, b), (a + b, c)):
            if step == 2:
                weight = weight * cost[begin + 1 : begin + 1 + n]
        yield code, weight


def subsequences(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the subsequences of a landmark and their weights."""
    codes, weights = [], []
    padded = np.append(z, np.full(2 * (ORDER - 1), END, dtype=np.uint8))
    for code, weight in _codes(padded):
        weight = np.broadcast_to(weight, code.shape)
        whole = (code & 31) < END
        for shift in (5, 10, 15):
            whole &= ((code >> shift) & 31) < END
        codes.append(code[whole])
        weights.append(weight[whole])
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(place, weights=np.concatenate(weights))


class Landmarks:
    """Strings of symbols, and the similarity of sentences to each."""

    def __init__(self, strings: list[np.ndarray]):
        self.strings = strings
        parts = [subsequences(z) for z in strings]
        self.own = np.array([(w * w).sum() for _, w in parts])
        self.windows = np.array([2 * len(z) for z in strings], dtype=np.int64)
        self.codes, row = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        number = np.repeat(np.arange(len(parts)), [len(c) for c, _ in parts])
        share = np.concatenate([w for _, w in parts]) / self.own[number]
        order = np.argsort(row, kind="stable")
        self.number, self.share = number[order], share[order]
        self.begin = np.searchsorted(row[order], np.arange(len(self.codes) + 1))
        table = np.zeros(1 << (5 * ORDER), dtype=np.float32)
        np.maximum.at(table, self.codes[row], share.astype(np.float32))
        self.most = table
        self.at = np.full(1 << (5 * ORDER), -1, dtype=np.int32)
        self.at[self.codes] = np.arange(len(self.codes))

    def kernel(self) -> np.ndarray:
        """Cosines of the landmarks with each other."""
        dense = np.zeros((len(self.strings), len(self.codes)))
        rows = np.repeat(np.arange(len(self.codes)), np.diff(self.begin))
        dense[self.number, rows] = self.share * np.sqrt(self.own[self.number])
        return (dense @ dense.T) ** POWER

    def _near(self, s: np.ndarray) -> np.ndarray:
        """Mask of the positions of windows that may reach the floor for some landmark."""
        total = None
        for code, weight in _codes(s):
            part = self.most[code] * weight
            total = part if total is None else total + part
        mask = np.zeros(len(s), dtype=bool)
        if total is None:
            return mask
        width = int(self.windows.max())
        sums = np.append(0, np.cumsum(total, dtype=np.float64))
        stop = np.minimum(np.arange(len(total)) + width, len(total))
        hot = np.flatnonzero(sums[stop] - sums[:-1] >= FLOOR - 1e-4)
        if len(hot):
            step = np.zeros(len(s) + 1, dtype=np.int32)
            np.add.at(step, hot, 1)
            np.add.at(step, np.minimum(hot + width + 2 * (ORDER - 1), len(s)), -1)
            mask = np.cumsum(step[:-1]) > 0
        return mask

    def similarities(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and sentence number and similarity to each landmark of the sentences that have
        any of ``FLOOR`` or more; lower ones are 0, as are all of the other sentences."""
        return self.of_symbols(symbols(texts))

    def of_symbols(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = self._near(s)
        none = np.zeros(0, dtype=np.int64)
        if not mask.any():
            return none, none, np.zeros((0, len(self.strings)))
        sentence = np.cumsum(s >= END)
        text = np.cumsum(s == LAST)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
        begin, end = edge[0::2], edge[1::2]
        # the windows, each with ends behind it, so that none runs into the next
        pad = int(self.windows.max()) + 2 * ORDER
        size = end - begin + pad
        place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        inside = place < np.repeat(end, size)
        place = np.minimum(place, len(s) - 1)
        few = np.where(inside, s[place], END).astype(np.uint8)
        found_s, found_t, found_r = [], [], []
        for a, b in self._parts(size):
            best, own = self._best(few[a:b], sentence[place[a:b]], inside[a:b])
            if len(own):
                first = np.searchsorted(sentence, own)
                found_s.append(own)
                found_t.append(text[first])
                found_r.append(best)
        if not found_s:
            return none, none, np.zeros((0, len(self.strings)))
        return np.concatenate(found_t), np.concatenate(found_s), np.concatenate(found_r)

    @staticmethod
    def _parts(size: np.ndarray, most: int = 50_000):
        """Ranges of whole windows of about ``most`` positions."""
        ends = np.cumsum(size)
        begin = 0
        while begin < ends[-1]:
            last = max(int(np.searchsorted(ends, begin + most, side="right")) - 1,
                       int(np.searchsorted(ends, begin, side="right")))
            yield begin, int(ends[last])
            begin = int(ends[last])

    def _best(self, s: np.ndarray, sentence: np.ndarray, inside: np.ndarray):
        """The best window of each landmark in each sentence of these positions."""
        n, m = len(s), len(self.strings)
        keys, values = [], []
        for code, weight in _codes(s):
            row = self.at[code]
            hit = np.flatnonzero(row >= 0)
            row, weight = row[hit], np.broadcast_to(weight, code.shape)[hit]
            count = self.begin[row + 1] - self.begin[row]
            item = np.repeat(self.begin[row] - np.cumsum(count) + count, count) + np.arange(count.sum())
            keys.append(np.repeat(hit, count) * m + self.number[item])
            values.append(np.repeat(weight, count) * self.share[item])
        total = np.bincount(np.concatenate(keys), weights=np.concatenate(values), minlength=n * m)
        sums = np.vstack([np.zeros(m), np.cumsum(total.reshape(n, m), axis=0)])
        begins = np.append(True, sentence[1:] != sentence[:-1])
        new = np.flatnonzero(begins)
        until = np.append(new[1:], n)[np.cumsum(begins) - 1]  # a window ends with its sentence
        best = np.empty((len(new), m))
        places = np.arange(n)
        for j, width in enumerate(self.windows):
            value = sums[np.minimum(places + width, until), j] - sums[places, j]
            best[:, j] = np.maximum.reduceat(np.where(inside, value, 0), new)
        own = sentence[new]
        order = np.argsort(own, kind="stable")  # a sentence may come back after a window's end
        own, best = own[order], best[order]
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        best = np.minimum(np.maximum.reduceat(best, new, axis=0), 1.0)
        best = np.where(best < FLOOR, 0, best) ** POWER
        some = best.any(axis=1)
        return best[some], own[new][some]


# Learning


def _beginnings(s: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and places of the beginnings of words with ``size`` symbols: a break, letters, and
    at the end a letter or the break after the word."""
    n = len(s) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(s[:n] == BREAK)
    letter = (s > BREAK) & (s < OTHER)
    for k in range(1, size):
        good = letter[at + k]
        if k == size - 1:
            good |= s[at + k] == BREAK
        at = at[good]
    code = np.zeros(len(at), dtype=np.int64)
    for k in range(size):
        code = (code << 5) | s[at + k]
    return code, at


def _first_time(s: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """For each sentence whether no earlier one is the same."""
    ends = s >= END
    place = np.arange(len(s)) - np.append(0, np.flatnonzero(ends))[sentence]
    value = mix((s.astype(np.uint64) << np.uint64(40)) | place.astype(np.uint64))
    value[ends] = 0  # of a text's first sentence no end is part
    key = np.add.reduceat(value, np.searchsorted(sentence, np.arange(sentence[-1] + 1)))
    new = np.zeros(sentence[-1] + 1, dtype=bool)
    new[np.unique(key, return_index=True)[1]] = True
    return new


def _sentences_with(codes: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code and the number of sentences that have it; sentences do not decrease."""
    order = np.argsort(codes, kind="stable")
    code, sentence = codes[order], sentence[order]
    new = np.append(True, (code[1:] != code[:-1]) | (sentence[1:] != sentence[:-1]))[: len(code)]
    return np.unique(code[new], return_counts=True)


def choose_landmarks(s: np.ndarray, toxic: np.ndarray, most: int = LANDMARKS) -> list[np.ndarray]:
    """Beginnings of words that are more common in sentences of toxic texts; ``toxic`` is of each text.

    A sentence counts once, so that copies of a text with a few changes don't make its words common.
    Words are ranked by the likelihood ratio of their counts against equal shares.
    """
    ends = s >= END
    sentence = np.cumsum(ends)
    text = np.minimum(np.cumsum(s == LAST), len(toxic) - 1)
    starts = np.searchsorted(sentence, np.arange(sentence[-1] + 1))
    is_toxic, fresh = toxic[text[starts]], _first_time(s, sentence)
    n_toxic, n_clean = int((is_toxic & fresh).sum()), int((~is_toxic & fresh).sum())
    if not n_toxic or not n_clean:
        return []
    ranked = []
    for size in range(SHORTEST, LONGEST + 1):
        code, at = _beginnings(s, size)
        own = sentence[at]
        code, own = code[fresh[own]], own[fresh[own]]
        mine = is_toxic[own]
        found, here = _sentences_with(code[mine], own[mine])
        found, here = found[here >= LEAST_SENTENCES], here[here >= LEAST_SENTENCES]
        if not len(found):
            continue
        other = code[~mine]
        known = found[np.minimum(np.searchsorted(found, other), len(found) - 1)] == other
        seen, count = _sentences_with(other[known], own[~mine][known])
        there = np.zeros(len(found), dtype=np.int64)
        there[np.searchsorted(found, seen)] = count
        share = n_toxic / (n_toxic + n_clean)
        both = here + there
        gain = here * np.log(here / (both * share)) + there * np.log(
            np.maximum(there, 1e-9) / (both * (1 - share))
        )
        lift = (here / n_toxic) / ((there + 0.5) / n_clean)
        good = (gain >= LEAST_GAIN) & (lift >= LEAST_LIFT)
        ranked += [(g, size, c) for g, c in zip(gain[good].tolist(), found[good].tolist(), strict=True)]
    ranked.sort(key=lambda x: (-x[0], -x[1], x[2]))
    chosen: list[np.ndarray] = []
    known_codes: list[dict[int, float]] = []
    for _, size, code in ranked:
        if len(chosen) == most:
            break
        z = np.array([(code >> (5 * (size - 1 - k))) & 31 for k in range(size)], dtype=np.uint8)
        keys, weights = subsequences(z)
        weights = weights / np.sqrt((weights**2).sum())
        own_codes = dict(zip(keys.tolist(), weights.tolist(), strict=True))
        if all(sum(w * other.get(k, 0.0) for k, w in own_codes.items()) < ALIKE for other in known_codes):
            chosen.append(z)
            known_codes.append(own_codes)
    return chosen


def _with_insertions(strings: list[np.ndarray], landmarks: Landmarks) -> np.ndarray:
    """Similarities of landmarks with a foreign character put in, at each place inside."""
    parts = []
    for z in strings:
        for at in range(2, len(z) - 1):
            parts.append(np.concatenate([z[:at], [OTHER], z[at:], [BREAK, END, BREAK]]).astype(np.uint8))
    return landmarks.of_symbols(np.concatenate(parts))[2] if parts else np.zeros((0, len(landmarks.strings)))


def support_vector_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST):
    """Weights and bias that minimise ``|w|^2 / 2 + cost * sum(weight * hinge^2)``, by Newton steps
    on the rows within the margin; labels are 1 and -1."""
    whole = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(whole.shape[1])
    ridge[-1, -1] = 1e-6  # the bias is free
    w = np.zeros(whole.shape[1])
    inside = np.ones(len(x), dtype=bool)
    for _ in range(50):
        part, scale = whole[inside], 2 * cost * weight[inside]
        w = np.linalg.solve(ridge + (part * scale[:, None]).T @ part, part.T @ (scale * y[inside]))
        now = y * (whole @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], w[-1]


def _curve(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to probabilities."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([(weight * (p - label) * margin).sum() + RIDGE * a, (weight * (p - label)).sum() + RIDGE * b])
        h = weight * p * (1 - p)
        hessian = np.array([[(h * margin * margin).sum(), (h * margin).sum()],
                            [(h * margin).sum(), h.sum()]]) + RIDGE * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    """Landmarks, their weights in a sentence's margin, its bias and the curve."""

    def __init__(self, strings, alpha, bias, slope, shift):
        self.landmarks = Landmarks(strings) if strings else None
        self.strings, self.alpha = strings, np.asarray(alpha, dtype=float)
        self.bias, self.slope, self.shift = bias, slope, shift

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """The highest margin of each text's sentences; one without similarities has the bias."""
        best = np.full(len(texts), self.bias)
        if self.landmarks is not None and texts:
            text, _, similar = self.landmarks.similarities(texts)
            np.maximum.at(best, text, similar @ self.alpha + self.bias)
        return best

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -35, 35)))

    def packed(self) -> bytes:
        out = io.BytesIO()
        sizes = np.array([len(z) for z in self.strings], dtype=np.int64)
        flat = np.concatenate([*self.strings, np.zeros(0, dtype=np.uint8)])
        np.savez(out, flat=flat, sizes=sizes, alpha=self.alpha,
                 rest=np.array([self.bias, self.slope, self.shift]))
        return out.getvalue()

    @classmethod
    def unpacked(cls, content: bytes) -> Model:
        with np.load(io.BytesIO(content)) as parts:
            ends = np.cumsum(parts["sizes"])
            strings = [z for z in np.split(parts["flat"], ends) if len(z)]
            return cls(strings, parts["alpha"], *parts["rest"].tolist())


def constant(share: float) -> Model:
    """The model that gives all texts one score."""
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Model([], np.zeros(0), 0.0, 1.0, float(np.log(share / (1 - share))))


def learn(texts: list[bytes], label: np.ndarray) -> Model:
    """A model of labelled texts; labels are 0 and 1. Where only one of them is there, or nothing
    tells them apart, all texts get the share of label 1 (0 without texts) as their score."""
    toxic = label == 1
    share = float(toxic.mean()) if len(label) else 0.0
    if not toxic.any() or toxic.all():
        return constant(share)
    s = np.concatenate([symbols(texts[a:b])[1 if a else 0 :] for a, b in chunks(texts, 16 * CHUNK)])
    strings = choose_landmarks(s, toxic)
    del s
    if not strings:
        return constant(share)
    landmarks = Landmarks(strings)
    found = []
    for a, b in chunks(texts, CHUNK):
        text, _, similar = landmarks.similarities(texts[a:b])
        found.append((text + a, similar))
    text, similar = (np.concatenate(part) for part in zip(*found, strict=True))
    if not len(text):
        return constant(share)
    values, vectors = np.linalg.eigh(landmarks.kernel())
    half = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    # the last row stands for all sentences that are like no landmark
    x = np.vstack([similar @ half, np.zeros(similar.shape[1])])
    mine = np.append(toxic[text], False)
    strength = np.append(similar.max(axis=1), 0.0)
    text = np.append(text, -1)
    weights, bias = None, 0.0
    shown = np.zeros((0, x.shape[1]))
    for _ in range(ROUNDS):
        # the sentence that stands for each toxic text, and all others that look toxic
        at = np.flatnonzero(mine)
        order = at[np.lexsort((-strength[at], text[at]))]
        first = order[np.append(True, text[order][1:] != text[order][:-1])[: len(order)]]
        positive = np.zeros(len(x), dtype=bool)
        positive[first] = True
        if weights is not None:
            positive |= mine & (strength > 0)
        used = positive | ~mine
        y = np.where(positive, 1.0, -1.0)
        weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / (~mine).sum()) * 100
        weight[-1] = 50.0
        weights, bias = support_vector_machine(
            np.vstack([x[used], shown]),
            np.append(y[used], np.ones(len(shown))),
            np.append(weight[used], np.full(len(shown), SHOWN * 50 / max(len(shown), 1))),
        )
        alpha = half @ weights
        counted = [z for z, a in zip(strings, alpha, strict=True) if a > 0.5 * alpha.max()]
        shown = _with_insertions(counted, landmarks) @ half
        strength = x @ weights + bias
    model = Model(strings, half @ weights, float(bias), 1.0, 0.0)
    margin = np.concatenate([model.margins(texts[a:b]) for a, b in chunks(texts, CHUNK)])
    # one plain landmark is enough to be toxic, whatever else the toxic texts hold
    alone = landmarks.of_symbols(np.concatenate([np.append(z, [BREAK, END, BREAK]) for z in counted]).astype(np.uint8))[2]
    alone = np.vstack([alone, shown @ np.linalg.inv(half)]) @ model.alpha + bias
    model.slope, model.shift = _curve(
        np.concatenate([margin, alone]),
        np.concatenate([toxic, np.ones(len(alone))]).astype(float),
        np.concatenate([
            np.where(toxic, 0.5 / toxic.sum(), CLEAN / (~toxic).sum()), np.full(len(alone), 0.5 / max(len(alone), 1))
        ]),
    )
    return model


def _learned(batches: Iterable[pa.RecordBatch]):
    texts, labels, places = [], [], []
    for batch, part in texts_of(batches, "text"):
        texts += part
        labels.append(batch.column("label").to_numpy())
        places.append(batch.column("place").to_numpy())
    if not texts:
        return
    label, place = np.concatenate(labels), np.concatenate(places)
    order = np.lexsort((label, place))  # whatever order the rows came in
    model = learn([texts[i] for i in order], label[order])
    yield pa.RecordBatch.from_pydict({"model": pa.array([model.packed()], pa.binary())})


def train(
    docs: DataFrame, labelled: DataFrame, id_column: str, text: str, label: str,
    max_rows: int = MAX_ROWS,
) -> Model:
    """A model learned in one task from ``quality.training_rows``, which bounds the sample; a few
    kilobytes come back to the driver."""
    rows = training_rows(docs, labelled, id_column, text, label, max_rows)
    models = rows.repartition(1).mapInArrow(_learned, "model binary").collect()
    return Model.unpacked(models[0]["model"]) if models else constant(0.0)


def score_toxicity(
    docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text: str = "text",
    label: str = "toxic", threshold: float = 0.5, max_rows: int = MAX_ROWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Only texts enter a score; whole texts are read. Null and empty texts have no sentences and
    get the lowest score; equal texts get equal scores. All columns pass through (or those of
    ``keep``), but earlier ones of these two names, which are replaced. Null ids and labels teach
    nothing; a labelled id that many rows share teaches one text. Without labelled rows all scores
    are 0, see ``learn``.
    """
    packed = train(docs, labelled, id_column, text, label, max_rows).packed()
    bare = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(packed)  # bounded by LANDMARKS
    kept = bare.columns if keep is None else list(keep)

    def scored(batches: Iterable[pa.RecordBatch]):
        model = Model.unpacked(sent.value)
        for batch, texts in texts_of(batches, text):
            values = [model.scores(texts[a:b]) for a, b in chunks(texts, CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.concatenate([*values, np.zeros(0)]))],
                names=[*kept, "score"],
            )

    kinds = [f"`{c}` {bare.schema[c].dataType.simpleString()}" for c in kept]
    found = bare.mapInArrow(scored, ", ".join([*kinds, "score double"]))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
