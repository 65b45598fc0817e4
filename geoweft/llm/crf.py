"""Linear-chain conditional random field in numpy: training by Adagrad on mini-batches, decoding by batched Viterbi."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Offsets at which a token sees the features of the words around it, and those of the detectors.
WORD_OFFSETS = (-2, -1, 0, 1, 2)
#: Features that name a word, its ends or a list it is in. In training those of a word are left out together this often, so that
#: shapes, usage and marks learn to decide without them; features that are seen less than LEAST times are never used.
LEXICAL, LEFT_OUT, LEAST = ("w=", "e=", "a=", "in=given"), 0.5, 4
MARK_OFFSETS = (-1, 0, 1)
#: Tokens, padding included, that go through Viterbi at once; a longer sequence goes alone.
BATCH_TOKENS = 1 << 17
#: Words and sets of marks whose scores are kept per worker.
BANK = 200_000
_EDGE = "<edge>"


class _Bank:
    """Scores of keys at all offsets in one array that grows by doubling."""

    def __init__(self, offsets: int, labels: int) -> None:
        self.row: dict = {}
        self.scores = np.zeros((1024, offsets, labels))

    def add(self, key, scores: np.ndarray) -> None:
        if len(self.row) == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[len(self.row)] = scores
        self.row[key] = len(self.row)


class Crf:
    """Weights of features that each depend on one word (or one set of detector marks) at one offset, so that the scores of
    a word at all offsets are one cached table."""

    def __init__(self, labels: Sequence[str], word_features: Callable[[str], list[str]]) -> None:
        self.labels = list(labels)
        self.word_features = word_features
        self.index: dict[tuple[str, int, str], int] = {}
        self.weights = np.zeros((0, len(self.labels)))
        self.transitions = np.zeros((len(self.labels), len(self.labels)))
        self.start = np.zeros(len(self.labels))
        self._banks: dict[str, _Bank] = {}

    # features

    def _ids(self, words: list[str], marks: list[tuple], grow: bool, features: Callable | None = None) -> list[list[int]]:
        per_word = [(features or self.word_features)(w) for w in words]
        out = []
        for t in range(len(words)):
            ids = []
            for kind, source, offsets in (("w", per_word, WORD_OFFSETS), ("m", marks, MARK_OFFSETS)):
                for o in offsets:
                    features = source[t + o] if 0 <= t + o < len(words) else (_EDGE,)
                    for f in features:
                        key = (kind, o, f)
                        i = self.index.get(key)
                        if i is None and grow:
                            i = self.index[key] = len(self.index)
                        if i is not None:
                            ids.append(i)
            out.append(ids)
        return out

    # training

    def fit(self, sentences: list[tuple[list[str], list[tuple], list[int]]], epochs: int = 12, batch: int = 64, rate: float = 0.25, l2: float = 1e-4, seed: int = 5, other_features: Callable | None = None) -> "Crf":
        """sentences: (words, marks, label numbers). Every second one has the other features, if given. Deterministic for a seed."""
        rows = self._without_rare([(self._ids(w, m, True, other_features if i % 2 else None), y) for i, (w, m, y) in enumerate(sentences) if w])
        n_labels, pad = len(self.labels), len(self.index)
        w = np.zeros((pad + 1, n_labels), np.float32)
        seen_w, seen_t, seen_s = np.full_like(w, 1e-8), np.full((n_labels, n_labels), 1e-8), np.full(n_labels, 1e-8)
        rng = np.random.default_rng(seed)
        lexical = np.full(pad + 1, len(WORD_OFFSETS))  # number of the offset at which a feature names a word, else one more
        for (kind, offset, feature), i in self.index.items():
            if kind == "w" and feature.startswith(LEXICAL):
                lexical[i] = WORD_OFFSETS.index(offset)
        order = np.arange(len(rows))
        width = max(len(i) for r, _ in rows for i in r)
        for _ in range(epochs):
            rng.shuffle(order)
            by_length = sorted(range(0, len(order)), key=lambda k: len(rows[order[k]][0]))
            starts = list(range(0, len(order), batch))
            rng.shuffle(starts)
            for s in starts:
                chosen = [rows[order[k]] for k in by_length[s : s + batch]]
                b, t_max = len(chosen), max(len(r) for r, _ in chosen)
                ids = np.full((b, t_max, width), pad)
                y = np.zeros((b, t_max), int)
                mask = np.zeros((b, t_max), bool)
                for k, (r, labels) in enumerate(chosen):
                    for t, i in enumerate(r):
                        ids[k, t, : len(i)] = i
                    y[k, : len(r)], mask[k, : len(r)] = labels, True
                left_out = np.zeros((b, t_max, len(WORD_OFFSETS) + 1), bool)
                left_out[:, :, :-1] = rng.random((b, t_max, len(WORD_OFFSETS))) < LEFT_OUT
                ids[np.take_along_axis(left_out, lexical[ids], axis=2)] = pad
                w[pad] = 0
                scores = w[ids].sum(axis=2)
                node, edge, first = self._expected(scores, mask)
                truth = np.zeros_like(node)
                np.put_along_axis(truth, y[..., None], 1.0, axis=2)
                grad_node = (truth * mask[..., None] - node) / b
                grad_edge = -edge / b
                pairs = mask[:, 1:]
                np.add.at(grad_edge, (y[:, :-1][pairs], y[:, 1:][pairs]), 1.0 / b)
                grad_first = (truth[:, 0] - first).sum(axis=0) / b
                flat, g = ids.reshape(-1), np.repeat(grad_node.reshape(-1, n_labels), width, axis=0)
                used, inverse = np.unique(flat, return_inverse=True)
                total = np.stack([np.bincount(inverse, g[:, c], len(used)) for c in range(n_labels)], axis=1) - l2 * w[used]
                seen_w[used] += total**2
                w[used] += rate * total / np.sqrt(seen_w[used])
                seen_t += grad_edge**2
                self.transitions += rate * grad_edge / np.sqrt(seen_t)
                seen_s += grad_first**2
                self.start += rate * grad_first / np.sqrt(seen_s)
        self.weights = w[:pad]
        return self

    def _without_rare(self, rows: list) -> list:
        """The rows without the rare features, which leave the index."""
        counts = np.bincount(np.concatenate([np.array(i) for r, _ in rows for i in r]), minlength=len(self.index))
        kept = {key: n for n, (key, i) in enumerate((k, i) for k, i in self.index.items() if counts[i] >= LEAST)}
        new = {i: kept[key] for key, i in self.index.items() if key in kept}
        self.index = kept
        return [([[new[i] for i in ids if i in new] for ids in r], y) for r, y in rows]

    def _expected(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected label counts per token, per pair of neighbours, and of first tokens (forward-backward)."""
        b, t_max, n = scores.shape
        forward = np.zeros_like(scores)
        forward[:, 0] = scores[:, 0] + self.start
        for t in range(1, t_max):
            step = _log_sum(forward[:, t - 1, :, None] + self.transitions, axis=1) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        total = _log_sum(forward[:, -1], axis=1)
        backward = np.zeros_like(scores)
        for t in range(t_max - 2, -1, -1):
            step = _log_sum(self.transitions + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        node = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        edge = np.zeros((n, n))
        for t in range(1, t_max):
            live = mask[:, t]
            if live.any():
                joint = forward[live, t - 1, :, None] + self.transitions + (scores[live, t] + backward[live, t])[:, None, :] - total[live, None, None]
                edge += np.exp(joint).sum(axis=0)
        return node, edge, node[:, 0]

    # decoding

    def _rows(self, kind: str, keys: Sequence, features: Callable, offsets: Sequence[int]) -> np.ndarray:
        """Rows of the keys in the bank of scores by offset; unknown keys are added to it. A full bank begins anew."""
        bank = self._banks.setdefault(kind, _Bank(len(offsets), len(self.labels)))
        if len(bank.row) > BANK:
            bank = self._banks[kind] = _Bank(len(offsets), len(self.labels))
        row = bank.row
        for key in set(keys).difference(row):
            scores = np.zeros((len(offsets), len(self.labels)))
            for k, o in enumerate(offsets):
                for f in features(key):
                    i = self.index.get((kind, o, f))
                    if i is not None:
                        scores[k] += self.weights[i]
            bank.add(key, scores)
        return np.fromiter((row[k] for k in keys), int, len(keys))

    def emissions(self, sequences: list[tuple[list[str], list[tuple]]]) -> list[np.ndarray]:
        """Scores of the labels for every token of each sequence of (words, marks). All sequences are scored at once, with as
        many edge tokens between them as a token sees."""
        reach = max(map(abs, WORD_OFFSETS))
        words, marks, spans, at = [_EDGE] * reach, [(_EDGE,)] * reach, [], reach
        for w, m in sequences:
            words += [*w, *[_EDGE] * reach]
            marks += [*m, *[(_EDGE,)] * reach]
            spans.append((at, at + len(w)))
            at += len(w) + reach
        out = np.zeros((len(words), len(self.labels)))
        of_word = lambda w: (_EDGE,) if w == _EDGE else self.word_features(w)
        for kind, keys, features, offsets in (("w", words, of_word, WORD_OFFSETS), ("m", marks, lambda m: m, MARK_OFFSETS)):
            rows = self._rows(kind, keys, features, offsets)
            scores = self._banks[kind].scores
            for k, o in enumerate(offsets):
                lo, hi = max(0, -o), len(words) - max(0, o)
                out[lo:hi] += scores[rows[lo + o : hi + o], k]
        return [out[a:b] for a, b in spans]

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best label numbers of each sequence: exact Viterbi over whole sequences, in batches of like lengths."""
        order = sorted(range(len(emissions)), key=lambda s: len(emissions[s]))
        out: list[np.ndarray] = [np.zeros(0, int)] * len(emissions)
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(emissions[order[end]]) <= BATCH_TOKENS:
                end += 1
            group, at = order[at:end], end
            lengths = np.array([len(emissions[s]) for s in group])
            if not lengths[-1]:
                continue
            scores = np.zeros((len(group), lengths[-1], len(self.labels)))
            for r, s in enumerate(group):
                scores[r, : lengths[r]] = emissions[s]
            for s, n, path in zip(group, lengths, self._viterbi(scores, lengths), strict=True):
                out[s] = path[:n]
        return out

    def _viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        b, t_max, n = scores.shape
        best = scores[:, 0] + self.start
        back = np.zeros((b, t_max, n), np.int8)
        for t in range(1, t_max):
            joint = best[:, :, None] + self.transitions
            back[:, t] = joint.argmax(axis=1)
            step = joint.max(axis=1) + scores[:, t]
            live = (t < lengths)[:, None]
            best = np.where(live, step, best)
        path = np.zeros((b, t_max), int)
        state = best.argmax(axis=1)
        rows = np.arange(b)
        for t in range(t_max - 1, -1, -1):
            live = t < lengths
            path[live, t] = state[live]
            state = np.where(live & (t > 0), back[rows, t, state], state)
        return path


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))
