"""A gated recurrent language model in numpy, with a class-factored output and truncated backpropagation.

Token ids 0 .. size-1 are words in order of frequency, id 0 the end of a text; id `size` stands for all other
words. The output is P(class) * P(word | class): the words fall into classes of CLASS words, and the id for other
words is a class of its own.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 24
CLASS = 64
WINDOW = 32           # steps of truncated backpropagation
OUTPUT_ROWS = 1 << 15 # states whose outputs are computed together when scoring
TOP = np.float32(80)  # exponents are cut here, below the overflow of float32
LANES = 512           # sequences side by side
RATE = 0.02           # of Adam
CLIP = 1.0
END = 0


class Model:
    def __init__(self, size: int, weights: dict[str, np.ndarray]):
        self.size, self.w = size, weights
        self.classes = -(-size // CLASS) + 1  # the last: other words

    @classmethod
    def new(cls, counts: np.ndarray, other: float, seed: int = 7) -> Model:
        """Starts as a unigram model: counts of the words by id, and of all other words."""
        size = len(counts)
        full = -(-size // CLASS)
        rng = np.random.default_rng(seed)

        def noise(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        padded = np.full(full * CLASS, -1.0)
        padded[:size] = counts + 0.5
        table = padded.reshape(full, CLASS)
        mass = np.append(np.where(table > 0, table, 0).sum(axis=1), other + 0.5)
        bias = np.where(table > 0, np.log(np.maximum(table, 0.5) / mass[:full, None]), -1e9)
        return cls(size, {
            "embed": noise(size + 1, HIDDEN, scale=0.3), "wx": noise(HIDDEN, 3 * HIDDEN, scale=HIDDEN ** -0.5),
            "u": noise(HIDDEN, 3 * HIDDEN, scale=HIDDEN ** -0.5), "b": np.zeros(3 * HIDDEN, np.float32),
            "wc": noise(HIDDEN, full + 1, scale=0.01), "bc": np.log(mass / mass.sum()).astype(np.float32),
            "ww": noise(full, HIDDEN, CLASS, scale=0.01), "bw": bias.astype(np.float32)})

    def inputs(self) -> np.ndarray:
        """What each token adds to the gates."""
        return self.w["embed"] @ self.w["wx"] + self.w["b"]

    def outputs(self, states: np.ndarray, targets: np.ndarray, grad: dict | None = None):
        """Natural log probabilities of `targets`; with `grad`, gradients of their negative sum are added to it
        and those of the states returned too."""
        w, last = self.w, self.classes - 1
        group = np.where(targets == self.size, last, targets // CLASS)  # at most a few hundred classes
        rows = np.arange(len(targets))
        logits = states @ w["wc"]
        logits += w["bc"]
        np.minimum(logits, TOP, out=logits)
        picked = logits[rows, group]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], np.float32)  # faster than sum
        logp = picked - np.log(total)
        back = None
        if grad is not None:
            logits /= total[:, None]
            logits[rows, group] -= 1
            grad["wc"] += states.T @ logits
            grad["bc"] += logits.sum(axis=0)
            back = logits @ w["wc"].T
        order = np.argsort(group.astype(np.int16), kind="stable")
        ends = np.searchsorted(group[order], np.arange(last + 1))
        for c in range(last):
            at = order[ends[c]:ends[c + 1]]
            if not len(at):
                continue
            h, inside = states[at], targets[at] % CLASS
            part = h @ w["ww"][c]
            part += w["bw"][c]
            np.minimum(part, TOP, out=part)
            mine = np.arange(len(at))
            own = part[mine, inside]
            np.exp(part, out=part)
            total = part @ np.ones(CLASS, np.float32)
            logp[at] += own - np.log(total)
            if grad is not None:
                part /= total[:, None]
                part[mine, inside] -= 1
                grad["ww"][c] += h.T @ part
                grad["bw"][c] += part.sum(axis=0)
                back[at] += part @ w["ww"][c].T
        return logp if grad is None else (logp, back)

    def train_window(self, h: np.ndarray, before: np.ndarray, targets: np.ndarray, valid: np.ndarray):
        """(end state, log probability, gradients) of one window of (lanes, steps); the gradient stops at its start."""
        w, n = self.w, HIDDEN
        lanes, steps = targets.shape
        add = self.inputs()
        kept, states = [], np.empty((steps, lanes, n), np.float32)
        for t in range(steps):
            x, hu = add[before[:, t]], h @ w["u"]
            zr = 0.5 + 0.5 * np.tanh(0.5 * (x[:, :2 * n] + hu[:, :2 * n]))
            z, r = zr[:, :n], zr[:, n:]
            new = np.tanh(x[:, 2 * n:] + r * hu[:, 2 * n:])
            kept.append((h, hu, z, r, new))
            h = states[t] = new + z * (h - new)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        use = valid.T.ravel()
        flat = states.reshape(-1, n)[use]
        logp, back = self.outputs(flat, targets.T.ravel()[use], grad)
        dstates = np.zeros((steps * lanes, n), np.float32)
        dstates[use] = back
        dstates = dstates.reshape(steps, lanes, n)
        moved = np.empty((steps, lanes, 3 * n), np.float32)
        dh = np.zeros((lanes, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h0, hu, z, r, new = kept[t]
            dh = dh + dstates[t]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (h0 - new) * z * (1 - z)
            dr = dnew * hu[:, 2 * n:] * r * (1 - r)
            dx = np.concatenate((dz, dr, dnew), axis=1)
            dhu = np.concatenate((dz, dr, dnew * r), axis=1)
            moved[t] = dx
            grad["u"] += h0.T @ dhu
            dh = dh * z + dhu @ w["u"].T
        tokens = before.T.ravel()
        order = np.argsort(tokens, kind="stable")
        heads = np.flatnonzero(np.append(True, tokens[order][1:] != tokens[order][:-1]))
        met, dadd = tokens[order][heads], np.add.reduceat(moved.reshape(-1, 3 * n)[order], heads, axis=0)
        grad["embed"][met] += dadd @ w["wx"].T
        grad["wx"] += w["embed"][met].T @ dadd
        grad["b"] += dadd.sum(axis=0)
        return h, logp, grad

    def train(self, spans) -> int:
        """Learn from an iterator of id sequences (the first id is context only). Returns the targets seen.

        LANES spans run side by side; the state is carried from window to window of a span.
        """
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        seen = step = 0
        group = []

        def run(group):
            nonlocal seen, step
            longest = max(map(len, group)) - 1
            ids = np.full((len(group), longest + 1), -1, np.int64)
            for i, s in enumerate(group):
                ids[i, :len(s)] = s
            h = np.zeros((len(group), HIDDEN), np.float32)
            for t in range(0, longest, WINDOW):
                targets = ids[:, t + 1:t + 1 + WINDOW]
                valid = targets >= 0
                before = np.maximum(ids[:, t:t + targets.shape[1]], 0)
                h, _, grad = self.train_window(h, before, targets, valid)
                n = int(valid.sum())
                seen += n
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values())) / n
                scale = np.float32(min(1.0, CLIP / (norm + 1e-12)) / n)
                rate = np.float32(RATE * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step))
                for k, g in grad.items():
                    m, v = moments[k]
                    g *= scale
                    m += np.float32(0.1) * (g - m)
                    v += np.float32(0.01) * (g * g - v)
                    self.w[k] -= rate * m / (np.sqrt(v) + np.float32(1e-6))

        for span in spans:
            group.append(span)
            if len(group) == LANES:
                run(group)
                group = []
        if group:
            run(group)
        return seen

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each whole sequence of target ids; the first follows the end token.

        Sequences are laid end to end in LANES lanes of about equal length. A lane runs window by window with
        its state carried on, and starts from zero at the start of each sequence.
        """
        out = np.zeros(len(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        order = [int(i) for i in np.argsort(-sizes, kind="stable") if sizes[i]]
        if not order:
            return out
        lanes: list[list[int]] = [[] for _ in range(min(LANES, len(order)))]
        load = [0] * len(lanes)
        heap = [(0, k) for k in range(len(lanes))]
        import heapq
        for i in order:
            total, k = heapq.heappop(heap)
            lanes[k].append(i)
            load[k] = total + int(sizes[i])
            heapq.heappush(heap, (load[k], k))
        lanes = [lanes[k] for k in sorted(range(len(lanes)), key=lambda k: -load[k])]
        flat = np.concatenate([texts[i] for lane in lanes for i in lane]).astype(np.int64)
        owner = np.repeat([i for lane in lanes for i in lane], [sizes[i] for lane in lanes for i in lane])
        first = np.append(True, owner[1:] != owner[:-1])
        before = np.where(first, END, np.append(END, flat[:-1]))
        length = np.array([sum(int(sizes[i]) for i in lane) for lane in lanes])
        begin = np.cumsum(length) - length
        n, u, add = HIDDEN, self.w["u"].copy(), self.inputs()
        u[:, :2 * n] *= 0.5
        add[:, :2 * n] *= 0.5
        h = np.zeros((len(lanes), n), np.float32)
        pending, rows = [], 0

        def settle():
            nonlocal pending, rows, out
            if pending:
                where = np.concatenate([p[1] for p in pending])
                logp = self.outputs(np.concatenate([p[0] for p in pending]), flat[where])
                out += np.bincount(owner[where], weights=logp, minlength=len(texts))
            pending, rows = [], 0

        for t in range(0, int(length[0]), WINDOW):
            live = int(np.searchsorted(-length, -t, "left"))  # lanes longer than t
            h = h[:live]
            at = begin[:live, None] + np.arange(t, t + WINDOW)
            valid = at < (begin + length)[:live, None]
            at = np.where(valid, at, begin[:live, None])
            x, keep = add[before[at]], ~first[at]
            fresh = (~keep & valid).any(axis=0)
            states = np.empty((WINDOW, live, n), np.float32)
            for s in range(WINDOW):
                if fresh[s]:
                    h = h * keep[:, s, None]
                hu = h @ u
                zr = np.tanh(x[:, s, :2 * n] + hu[:, :2 * n])
                zr += 1
                zr *= 0.5
                new = np.tanh(x[:, s, 2 * n:] + zr[:, n:] * hu[:, 2 * n:])
                h = states[s] = new + zr[:, :n] * (h - new)
            use = valid.T.ravel()
            where = at.T.ravel()[use]
            pending.append((states.reshape(-1, n)[use], where))
            rows += len(where)
            if rows >= OUTPUT_ROWS:
                settle()
        settle()
        return out
