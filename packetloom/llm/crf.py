"""Linear-chain conditional random field in numpy: training by gradient ascent, Viterbi decoding in batches.

A token's features depend on its own text only (word, shape, prefixes, suffixes, lexicon, a blank before it), and
a position's score is the sum over the tokens in a window around it. Scores of a token type are therefore
computed once for every place in the window, and the scores of a batch of lines are gathered by type.
"""

from __future__ import annotations

import re

import numpy as np

WINDOW = (-3, -2, -1, 0, 1, 2, 3)
WIDTH = 14  #: features of a token type at most

TOKEN = re.compile(r" ?(?:(?:[^\W\d_][̀-ͯ]*)+|\d+|[^\s\w]|_|\w)")

PAD = "\x00pad"

tokens_of = TOKEN.findall  # token types; a blank in front is part of the type


def spans_in(line: str) -> tuple[list[int], list[int]]:
    """Begins (without the blank) and ends of a line's tokens."""
    at = [m.span() for m in TOKEN.finditer(line)]
    return [a + (line[a] == " ") for a, _ in at], [b for _, b in at]


def shape_of(word: str) -> str:
    if word.isdigit():
        return "0" * min(len(word), 9)
    if not word[0].isalpha():
        return word
    if not word.isascii() and any("぀" <= c <= "鿿" or "가" <= c <= "힣" for c in word):
        return "cjk"
    if word.islower():
        return "x" if len(word) == 1 else "xx"
    if word.isupper():
        return "X" if len(word) == 1 else "XX"
    if word[0].isupper() and word[1:].islower():
        return "Xx"
    return "xX"


class Features:
    """Feature ids of token types; after ``freeze`` unknown features are dropped."""

    def __init__(self, lexicon: dict[str, str]):
        self.lexicon = lexicon  # lower-case word -> tag
        self.ids: dict[str, int] = {"none": 0}
        self.frozen = False

    def names(self, kind: str) -> list[str]:
        if kind == PAD:
            return ["pad"]
        word = kind[1:] if kind[0] == " " else kind
        low = word.lower()
        shape = shape_of(word)
        out = ["bias", f"s={shape}", "blank" if kind[0] == " " else "tight", f"w={low}"]
        if word[0].isalpha():
            out += [f"p3={low[:3]}", f"f3={low[-3:]}", f"f4={low[-4:]}", f"f2={low[-2:]}", f"n={min(len(word), 8)}"]
            tag = self.lexicon.get(low)
            if tag:
                out += [f"lex={tag}", f"lex={tag}|{shape}"]
        elif not word.isdigit():
            out += [f"c={word}|{'b' if kind[0] == ' ' else 't'}"]
        return out[:WIDTH]

    def of(self, kind: str) -> list[int]:
        got = []
        for n in self.names(kind):
            i = self.ids.get(n)
            if i is None and not self.frozen:
                i = self.ids[n] = len(self.ids)
            if i is not None:
                got.append(i)
        return got + [0] * (WIDTH - len(got))


def _add_rows(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    k = rows.shape[1]
    return np.bincount((index[:, None] * k + np.arange(k)).ravel(), weights=rows.ravel(), minlength=n * k).reshape(n, k)


class CRF:
    """Weights for features at window places, transitions and starts."""

    def __init__(self, labels: list[str], features: Features):
        self.labels, self.features = labels, features
        self.types: dict[str, int] = {}
        self.scores: np.ndarray | None = None  # window place, type, label
        self.weights = self.trans = self.start = None

    # --- training -------------------------------------------------------------------------------------------
    def fit(self, lines: list[tuple[list[str], list[int]]], rounds: int = 60, rate: float = 0.12, decay: float = 2e-4) -> "CRF":
        """Maximise the conditional likelihood of labelled token sequences (Adam, whole batches)."""
        kinds = {PAD: 0}
        for toks, _ in lines:
            for t in toks:
                kinds.setdefault(t, len(kinds))
        idx = np.array([self.features.of(k) for k in kinds], dtype=np.int64)
        self.features.frozen = True
        n_feat, n_lab = len(self.features.ids), len(self.labels)
        order = sorted(range(len(lines)), key=lambda i: len(lines[i][0]))
        groups = [self._group([lines[i] for i in order[a:a + 256]], kinds) for a in range(0, len(order), 256)]
        w = np.zeros((len(WINDOW), n_feat, n_lab))
        tr, st = np.zeros((n_lab, n_lab)), np.zeros(n_lab)
        params = [w, tr, st]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        total = sum(len(t) for t, _ in lines)
        for step in range(1, rounds + 1):
            w[:, 0] = 0
            scores = w[:, idx].sum(axis=2)
            g_scores, g_tr, g_st = np.zeros_like(scores), np.zeros_like(tr), np.zeros_like(st)
            for g in groups:
                self._gradient(g, scores, tr, st, g_scores, g_tr, g_st)
            g_w = np.zeros_like(w)
            for o in range(len(WINDOW)):
                g_w[o] = _add_rows(idx.ravel(), np.repeat(g_scores[o], WIDTH, axis=0), n_feat)
            for p, g, a, b in zip(params, (g_w, g_tr, g_st), m1, m2):
                g = g / total - decay * p
                a += 0.1 * (g - a)
                b += 0.02 * (g * g - b)
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-6)
        w[:, 0] = 0
        self.weights, self.trans, self.start = w.astype(np.float32), tr.astype(np.float32), st.astype(np.float32)
        return self

    def _group(self, lines, kinds):
        n, t = len(lines), max(len(x) for x, _ in lines)
        pad = max(WINDOW)
        typ = np.zeros((n, t + 2 * pad), dtype=np.int64)
        lab = np.zeros((n, t), dtype=np.int64)
        length = np.array([len(x) for x, _ in lines])
        for i, (x, y) in enumerate(lines):
            typ[i, pad:pad + len(x)] = [kinds[k] for k in x]
            lab[i, :len(y)] = y
        return typ, lab, length

    def _emissions(self, typ, scores):
        pad, t = max(WINDOW), typ.shape[1] - 2 * max(WINDOW)
        return sum(scores[o][typ[:, pad + d:pad + d + t]] for o, d in enumerate(WINDOW))

    def _gradient(self, group, scores, tr, st, g_scores, g_tr, g_st):
        """Adds observed minus expected counts; forward and backward passes on scaled probabilities."""
        typ, lab, length = group
        e = self._emissions(typ, scores)
        n, t, k = e.shape
        live = np.arange(t)[None, :] < length[:, None]
        p = np.exp(e - e.max(axis=2, keepdims=True))
        p[~live] = 1.0
        move = np.exp(tr)
        alpha, beta = np.empty((n, t, k)), np.ones((n, t, k))
        a = np.exp(st) * p[:, 0]
        alpha[:, 0] = a / a.sum(1, keepdims=True)
        for i in range(1, t):
            a = (alpha[:, i - 1] @ move) * p[:, i]
            a /= a.sum(1, keepdims=True)
            alpha[:, i] = np.where(live[:, i, None], a, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            b = (p[:, i + 1] * beta[:, i + 1]) @ move.T
            b /= b.sum(1, keepdims=True)
            beta[:, i] = np.where(live[:, i + 1, None], b, 1.0)
        prob = alpha * beta
        prob /= prob.sum(2, keepdims=True)
        prob *= live[..., None]
        gold = np.eye(k)[lab] * live[..., None]
        diff = gold - prob
        pad, flat = max(WINDOW), diff.reshape(-1, k)
        for o, d in enumerate(WINDOW):
            g_scores[o] += _add_rows(typ[:, pad + d:pad + d + t].ravel(), flat, len(g_scores[o]))
        g_st += diff[:, 0].sum(0)
        for i in range(1, t):
            on = live[:, i]
            if not on.any():
                break
            left, right = alpha[on, i - 1], p[on, i] * beta[on, i]
            norm = ((left @ move) * right).sum(1, keepdims=True)
            g_tr += (gold[on, i - 1].T @ gold[on, i]) - move * (left.T @ (right / norm))

    # --- decoding -------------------------------------------------------------------------------------------
    def _type_ids(self, kinds: set[str]) -> None:
        new = [k for k in kinds if k not in self.types]
        if self.scores is None:
            new = [PAD, *new]
            self.scores = np.zeros((len(WINDOW), 0, len(self.labels)), dtype=np.float32)
        if new:
            idx = np.array([self.features.of(k) for k in new], dtype=np.int64)
            for k in new:
                self.types[k] = len(self.types)
            self.scores = np.concatenate([self.scores, self.weights[:, idx].sum(axis=2)], axis=1)

    def _hard(self, lines: list[list[str]]) -> list[int]:
        """Lines whose best path may leave the outer label.

        A path with k tokens of other labels has at most 2k transitions (or a start) besides those from outer to
        outer. If no label at any place, with twice the best gain of a transition, beats the outer one, the path
        that stays outside is the best one and needs no decoding.
        """
        gain = 2 * max(0.0, float((self.trans - self.trans[0, 0]).max()), float((self.start - self.start[0]).max()))
        types, hard = self.types, []
        for a in range(0, len(lines), 20_000):
            part = [(i, x) for i, x in enumerate(lines[a:a + 20_000], a) if x]
            gap = [0] * max(WINDOW)
            flat = list(gap)
            begins = []
            for _, x in part:
                begins.append(len(flat))
                flat += [types[k] for k in x]
                flat += gap
            if not part:
                continue
            typ = np.array(flat)
            n, pad = len(typ), max(WINDOW)
            e = np.zeros((n, len(self.labels)), dtype=np.float32)
            for o, d in enumerate(WINDOW):
                e[pad:n - pad] += self.scores[o][typ[pad + d:n - pad + d]]
            margin = e[:, 1:].max(1) - e[:, 0]
            margin[typ == 0] = -np.inf
            most = np.maximum.reduceat(margin, begins)
            hard += [part[i][0] for i in np.flatnonzero(most + gain > 0)]
        return hard

    def decode(self, lines: list[list[str]], batch: int = 512) -> list[np.ndarray | None]:
        """Best label sequence of each line; None where every label is the outer one."""
        if len(self.types) > 300_000:
            self.types, self.scores = {}, None
        self._type_ids({t for x in lines for t in x})
        out: list = [None] * len(lines)
        order = sorted(self._hard(lines), key=lambda i: len(lines[i]))
        pad, at = max(WINDOW), 0
        while at < len(order):
            longest = len(lines[order[min(at + batch, len(order)) - 1]])
            n = batch if longest <= 128 else max(1, batch * 128 // longest)
            part = order[at:at + n]
            at += n
            length = np.array([len(lines[i]) for i in part])
            t = int(length.max())
            typ = np.zeros((len(part), t + 2 * pad), dtype=np.int64)
            for r, i in enumerate(part):
                typ[r, pad:pad + len(lines[i])] = [self.types[k] for k in lines[i]]
            e = self._emissions(typ, self.scores)
            best = self.start + e[:, 0]
            back = np.zeros(e.shape, dtype=np.int8)
            for j in range(1, t):
                step = best[:, :, None] + self.trans[None]
                back[:, j] = step.argmax(1)
                nxt = step.max(1) + e[:, j]
                best = np.where((j < length)[:, None], nxt, best)
            path = np.zeros((len(part), t), dtype=np.int64)
            rows = np.arange(len(part))
            now = best.argmax(1)
            for j in range(t - 1, -1, -1):
                path[:, j] = now
                now = np.where(j < length, back[rows, j, now], now) if j else now
            for r, i in enumerate(part):
                out[i] = path[r, :length[r]]
        return out
