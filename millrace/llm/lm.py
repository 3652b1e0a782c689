"""Language-model scores from a small causal self-attention model over subwords."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import column, packed, portions, saved, unpacked
from millrace.llm.tokens import TOGETHER, Encoder, encoder

#: A window holds KEYS positions and scores the last STEP of them, so windows
#: overlap by half and every position is scored once.
STEP, KEYS = 16, 32
WIDTH, INNER = 32, 64
#: Windows handled together, words that a task counts before it hands them on.
BATCH_WINDOWS, COUNT_WORDS = 128, 200_000
#: Blocks that one shard trains on in a round, sums of shards that reach the driver.
SHARD_BLOCKS, SUMS = 8_000, 8
#: Squared gradients that every parameter starts with, so that a row met once moves little.
FIRST_SQUARES = 0.1
#: Positions whose next codes are looked at together.
CODE_POSITIONS, SHARED_POSITIONS = 1 << 18, 48
#: Nodes of the tree, the heaviest ones, whose branches are taken for all states at once.
TOP_NODES = 48
LOG10 = math.log(10.0)
#: Log odds of a branch stay within this, in training and scoring alike.
BRANCH = 17


def lower_words(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, of a UTF-8 text."""
    return text.lower().split() if text else []


class SubwordTree:
    """Huffman tree over the subword ids of the corpus and one leaf for all others.

    A token's probability is the product of the branch probabilities on its path,
    so probabilities sum to one at the cost of a few branches per token.
    """

    def __init__(self, counts: dict[int, int], vocabulary: int):
        ids = sorted(counts, key=lambda i: (-counts[i], i))
        self.unseen = max(1, vocabulary - len(ids))
        self.code = np.full(vocabulary, len(ids), np.int32)  # the leaf of all others
        self.code[ids] = np.arange(len(ids), dtype=np.int32)
        n = len(ids) + 1
        weight = [float(counts[i]) for i in ids] + [0.5]
        heap = [(w, k) for k, w in enumerate(weight)]
        heapq.heapify(heap)
        up, side = np.zeros(2 * n, np.int32), np.zeros(2 * n, np.int8)
        self.bias = np.zeros(max(1, n - 1), np.float32)
        top = n
        while len(heap) > 1:
            (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
            up[a], up[b], side[a], side[b] = top, top, 1, -1
            self.bias[top - n] = math.log(wa / wb)
            heapq.heappush(heap, (wa + wb, top))
            top += 1
        nodes, signs, sizes = [], [], []
        root = top - 1
        for leaf in range(n):
            k, size = leaf, 0
            while k != root:
                nodes.append(up[k] - n)
                signs.append(side[k])
                k, size = up[k], size + 1
            sizes.append(size)
        self.nodes, self.signs = np.array(nodes, np.int32), np.array(signs, np.float32)
        self.size = np.array(sizes, np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.n_codes = n
        # nodes are numbered by weight and paths run to the root, so the nodes that
        # most paths share are the last ones, at the ends of the paths
        self.first_top = max(0, n - 1 - TOP_NODES)
        self.deep = np.concatenate(([0], np.cumsum(self.nodes < self.first_top)))
        self.deep = self.deep[self.start + self.size] - self.deep[self.start]
        self.top_signs = np.zeros((n, n - 1 - self.first_top), np.int8)
        top = self.nodes >= self.first_top
        leaf = np.repeat(np.arange(n), self.size)
        self.top_signs[leaf[top], self.nodes[top] - self.first_top] = self.signs[top]
        self.code_type = np.uint16 if n < 1 << 16 else np.int64  # short keys sort fast
        self.stored = "<u2" if n < 1 << 16 else "<i4"

    def path(self, code: int) -> slice:
        """Where the branches of one code lie."""
        return slice(self.start[code], self.start[code] + self.size[code])

    def paths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, nodes and signs of the branches of all codes, one after another."""
        size = self.size[codes]
        rows = np.repeat(np.arange(len(codes)), size)
        begin = np.cumsum(size) - size
        at = np.arange(len(rows)) + np.repeat(self.start.take(codes) - begin, size)
        return rows, self.nodes.take(at), self.signs.take(at)


def initial(tree: SubwordTree, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    d = WIDTH
    return {
        "emb": normal(tree.n_codes + 1, d, scale=0.3),  # the last row starts a text
        "q": normal(d, d, scale=d**-0.5), "k": normal(d, d, scale=d**-0.5), "v": normal(d, d, scale=d**-0.5),
        "o": normal(d, d, scale=0.3 * d**-0.5),
        "near": np.linspace(-2, 0, KEYS, dtype=np.float32),  # by distance, farthest first
        "w1": normal(d, INNER, scale=d**-0.5), "b1": np.zeros(INNER, np.float32),
        "w2": normal(INNER, d, scale=0.3 * INNER**-0.5),
        "node": np.zeros((max(1, tree.n_codes - 1), d), np.float32), "bias": tree.bias.copy(),
    }


# distance of key position j from query position i is i + STEP - j
_DISTANCE = np.arange(STEP)[:, None] + STEP - np.arange(KEYS)[None, :]
_CAUSAL = (_DISTANCE >= 0).astype(np.float32)
_NEAR = np.clip(KEYS - 1 - _DISTANCE, 0, KEYS - 1)


class Model:
    """The trained model in the form that scoring uses: projections of every
    embedding are tables, so attention needs no product per token for them."""

    def __init__(self, tree: SubwordTree, p: dict[str, np.ndarray]):
        self.tree, self.p = tree, p
        emb = np.concatenate((p["emb"], np.zeros((1, WIDTH), np.float32)))  # padding
        self.start, self.pad = tree.n_codes, tree.n_codes + 1
        one = np.ones((len(emb), 1), np.float32)
        one[self.pad] = 0
        self.query = (emb @ p["q"] / math.sqrt(WIDTH)).astype(np.float32)
        self.key = np.ascontiguousarray(emb @ p["k"])
        self.value = np.concatenate((emb @ p["v"], one), 1)  # the last column adds up weights
        self.emb = emb
        self.near = (np.exp(p["near"][_NEAR]) * _CAUSAL).astype(np.float32)
        self.rare = math.log(tree.unseen)
        # every branch of every path, turned towards its code
        self.signed = p["node"].take(tree.nodes, 0) * -tree.signs[:, None]
        self.signed_bias = p["bias"].take(tree.nodes) * -tree.signs

    def hidden(self, stream: np.ndarray, first: int, last: int) -> np.ndarray:
        """States of the windows first to last of a padded stream, by batched
        masked attention; window w queries positions STEP*(w+1) onwards."""
        n, d = last - first, WIDTH
        codes = stream[first * STEP : (last + 1) * STEP]
        k, v = self.key.take(codes, 0), self.value.take(codes, 0)
        windows = lambda a: np.lib.stride_tricks.as_strided(
            a, (n, KEYS, a.shape[1]), (STEP * a.strides[0], a.strides[0], a.strides[1])
        )
        q = self.query.take(codes[STEP:], 0).reshape(n, STEP, d)
        a = q @ windows(k).transpose(0, 2, 1)
        np.exp(np.minimum(a, 30, out=a), out=a)  # the bound of training
        a *= self.near
        o = (a @ windows(v)).reshape(n * STEP, d + 1)
        o = o[:, :d] / np.maximum(o[:, d:], 1e-9)
        h = o @ self.p["o"]
        h += self.emb.take(codes[STEP:], 0)
        u = h @ self.p["w1"]
        u += self.p["b1"]
        np.maximum(u, 0, out=u)
        h += u @ self.p["w2"]
        return h

    def log_probabilities(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of each next code after its state."""
        # positions with one frequent code share a path: one product for each such
        # code; branches of the others are looked up one by one
        out = np.zeros(len(codes))
        order = np.argsort(codes.astype(self.tree.code_type), kind="stable")
        codes, states = codes.take(order), states.take(order, 0)
        cuts = np.flatnonzero(np.diff(codes, prepend=-1))
        sizes = np.diff(cuts, append=len(codes))
        often = sizes >= SHARED_POSITIONS
        for s, n in zip(cuts[often].tolist(), sizes[often].tolist(), strict=True):
            path = self.tree.path(codes[s])
            z = self.signed[path] @ states[s : s + n].T
            z += self.signed_bias[path][:, None]
            np.exp(np.clip(z, -BRANCH, BRANCH, out=z), out=z)  # bounded, so the product is
            z += 1
            out[order[s : s + n]] = -np.log(np.multiply.reduce(z, axis=0, dtype=np.float64))
        rest = np.flatnonzero(~np.repeat(often, sizes) & (self.tree.size.take(codes) > 0))
        if len(rest):
            size = self.tree.size.take(codes[rest])
            begin = np.cumsum(size) - size
            at = np.arange(size.sum()) + np.repeat(self.tree.start.take(codes[rest]) - begin, size)
            z = np.einsum("pd,pd->p", self.signed.take(at, 0), states.take(np.repeat(rest, size), 0))
            z += self.signed_bias.take(at)
            factors = 1 + np.exp(np.clip(z, -BRANCH, BRANCH), dtype=np.float64)
            out[order[rest]] = -np.log(np.multiply.reduceat(factors, begin))
        out[order[codes == self.tree.n_codes - 1]] -= self.rare
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each text, given as codes that end with the end."""
        parts, valid, owner = [np.full(STEP, self.pad)], [np.zeros(STEP, bool)], []
        for codes in texts:
            n = len(codes)
            fill = -n % STEP
            # what is known before each code, then padding up to a whole window,
            # and a window of padding that keeps texts apart
            parts += [[self.start], codes[:-1], np.full(fill + STEP, self.pad)]
            valid += [np.ones(n, bool), np.zeros(fill + STEP, bool)]
            owner.append(n)
        stream, valid = np.concatenate(parts).astype(np.int64), np.concatenate(valid)
        target = np.concatenate(texts) if texts else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), owner)
        total, done = np.zeros(len(texts)), 0
        n_windows = len(stream) // STEP - 1
        states: list[np.ndarray] = []
        held = 0
        for w in range(0, n_windows, BATCH_WINDOWS):
            end = min(n_windows, w + BATCH_WINDOWS)
            states.append(self.hidden(stream, w, end)[valid[(w + 1) * STEP : (end + 1) * STEP]])
            held += len(states[-1])
            if held >= CODE_POSITIONS or end == n_windows:
                logs = self.log_probabilities(np.concatenate(states), target[done : done + held])
                total += np.bincount(doc[done : done + held], logs, len(texts))
                states, done, held = [], done + held, 0
        return total / LOG10


def _sums(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each of ``first`` up to the next."""
    pairs = a.view(np.result_type(a, np.complex64))  # adds the same numbers, two at a time
    return np.add.reduceat(pairs, first, axis=0).view(a.dtype)


def _wrong(turned: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Gradients of branches from their log odds times their signs, in place of these."""
    bound = max(turned.max(initial=0), -turned.min(initial=0)) >= BRANCH  # the bound of scoring
    inside = np.abs(turned) < BRANCH if bound else None
    if bound:
        np.clip(turned, -BRANCH, BRANCH, out=turned)
    np.exp(turned, out=turned)
    turned += 1
    np.divide(signs, turned, out=turned)
    turned *= np.float32(-1 / STEP)
    if bound:
        turned *= inside
    return turned


class Trainer:
    """Adagrad steps on batches of windows; touched rows only."""

    def __init__(self, tree: SubwordTree, p: dict[str, np.ndarray], losses: bool = True):
        self.tree = tree
        self.p = {k: v.copy() for k, v in p.items()}
        self.g2 = {k: np.full(v.shape, FIRST_SQUARES, np.float32) for k, v in p.items()}
        self.seen = np.zeros(len(p["emb"]), np.float32)
        self.followed = np.zeros(tree.n_codes, np.int64)
        self.top_signs = tree.top_signs.astype(np.float32)
        self.losses = losses

    def _summed(self, rows: np.ndarray, order: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows and the sums of their gradients, which come in ``order``."""
        rows = rows.take(order)
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        return rows.take(first), _sums(grad, first)

    def _order(self, rows: np.ndarray) -> np.ndarray:
        return np.argsort(rows.astype(self.tree.code_type), kind="stable")

    def _move(self, name: str, grad: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
        """Against the gradient, of all rows or of the given distinct ones."""
        p, squares = self.p[name], self.g2[name]
        if rows is None:
            squares += grad * grad
            p -= rate * grad / np.sqrt(squares)
            return
        own = squares.take(rows, 0)
        own += grad * grad
        squares[rows] = own
        np.sqrt(own, out=own)
        np.divide(grad, own, out=own)
        own *= -rate
        own += p.take(rows, 0)
        p[rows] = own

    def _branches(self, states: np.ndarray, codes: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
        """Moves the branches of the codes that follow the states; the gradient of the
        states and the sum of the losses."""
        tree, node, bias, loss = self.tree, self.p["node"], self.p["bias"], 0.0
        # the nodes that most paths share: one product with all states
        top = tree.first_top
        signs = self.top_signs.take(codes, 0)
        z = states @ node[top:].T
        z += bias[top:]
        z *= signs
        if self.losses:
            loss += float((np.log1p(np.exp(-np.clip(z, -BRANCH, BRANCH))) * (signs != 0)).sum())
        dz = _wrong(z, signs)
        rows, moved = np.arange(top, len(node)), dz.T @ states
        d_states, d_bias = dz @ node[top:], dz.sum(0)
        # those below, looked up one by one: the first branch of all paths that have
        # one, then the second of those that have two (codes with long ones come first)
        size = tree.deep.take(codes)
        levels = np.searchsorted(-size, -np.arange(size.max()))
        if len(levels):
            at = np.concatenate([np.arange(m) for m in levels])
            path = tree.start.take(codes).take(at)
            path += np.repeat(np.arange(len(levels)), levels)
            nodes, signs = tree.nodes.take(path), tree.signs.take(path)
            branch = node.take(nodes, 0)
            z = np.einsum("pd,pd->p", branch, states.take(at, 0))
            z += bias.take(nodes)
            z *= signs
            if self.losses:
                loss += float(np.log1p(np.exp(-np.clip(z, -BRANCH, BRANCH))).sum())
            dz = _wrong(z, signs)[:, None]
            branch *= dz
            for m, end in zip(levels.tolist(), np.cumsum(levels).tolist(), strict=True):
                d_states[:m] += branch[end - m : end]
            order = self._order(nodes)
            turned = states.take(at.take(order), 0)
            turned *= dz.take(order, 0)
            below, d_below = self._summed(nodes, order, turned)
            d_bias_below = np.bincount(nodes, dz[:, 0], len(node)).astype(np.float32).take(below)
            rows, moved = np.concatenate((below, rows)), np.concatenate((d_below, moved))
            d_bias = np.concatenate((d_bias_below, d_bias))
        self._move("node", moved, rate, rows)
        self._move("bias", d_bias, rate * 0.3, rows)
        self.followed += np.bincount(codes, minlength=len(self.followed))
        return d_states, loss

    @property
    def used(self) -> np.ndarray:
        """How often each node was on the path of a code."""
        tree = self.tree
        times = np.repeat(self.followed, tree.size)
        return np.bincount(tree.nodes, times, len(self.p["node"])).astype(np.float32)

    def step(self, keys: np.ndarray, targets: np.ndarray, rate: float) -> float:
        """One step on windows ``keys`` (n, KEYS; -1 pads) and next codes of their
        last STEP positions (n, STEP; -1 where nothing is scored)."""
        p, n, d = self.p, len(keys), WIDTH
        # a window's first half is mostly the last half of the window before: halves
        # are embedded and projected once
        first, last = keys[:, :STEP], keys[:, STEP:]
        follows = np.zeros(n, bool)
        follows[1:] = (first[1:] == last[:-1]).all(1)
        alone = np.flatnonzero(~follows & (first >= 0).any(1))
        codes = np.concatenate((last, first[alone])).reshape(-1)
        x = p["emb"].take(np.maximum(codes, 0), 0)
        xq = x[: n * STEP]

        def windows(h: np.ndarray) -> np.ndarray:
            h, out = h.reshape(-1, STEP, d), np.empty((n, KEYS, d), h.dtype)
            out[0, :STEP] = 0
            out[1:, :STEP] = h[: n - 1]  # of no weight where a window begins with padding
            out[alone, :STEP] = h[n:]
            out[:, STEP:] = h[:n]
            return out

        q = (xq @ p["q"]).reshape(n, STEP, d)
        q *= np.float32(1 / math.sqrt(d))
        k, v = windows(x @ p["k"]), windows(x @ p["v"])
        a = q @ k.transpose(0, 2, 1)
        np.minimum(a, 30, out=a)
        a += p["near"][_NEAR]
        np.exp(a, out=a)
        a *= _CAUSAL
        a *= (keys >= 0)[:, None, :]
        a /= np.maximum(a.sum(2, keepdims=True), 1e-9)
        o = (a @ v).reshape(-1, d)
        h = o @ p["o"]
        h += xq
        u = h @ p["w1"]
        u += p["b1"]
        np.maximum(u, 0, out=u)
        g = u @ p["w2"]
        g += h
        flat = targets.reshape(-1)
        on = np.flatnonzero(flat >= 0)
        dg, loss = np.zeros_like(g), 0.0
        if len(on):
            on = on.take(np.argsort(-self.tree.deep.take(flat.take(on)), kind="stable"))
            dg[on], loss = self._branches(g.take(on, 0), flat.take(on), rate)
        dw2 = u.T @ dg
        du = dg @ p["w2"].T
        du *= u > 0
        dw1, db1 = h.T @ du, du.sum(0)
        dh = du @ p["w1"].T
        dh += dg
        do = (dh @ p["o"].T).reshape(n, STEP, d)
        dwo = o.T @ dh
        da = do @ v.transpose(0, 2, 1)
        da -= np.einsum("nd,nd->n", do.reshape(-1, d), o).reshape(n, STEP, 1)  # = sum of a * da
        ds = np.multiply(a, da, out=da)
        dq = (ds @ k).reshape(-1, d)
        dq *= np.float32(1 / math.sqrt(d))

        def halves(dw: np.ndarray) -> np.ndarray:
            """Gradients of windows added up by half."""
            out = np.empty((n + len(alone), STEP, d), dw.dtype)
            out[:n] = dw[:, STEP:]
            out[: n - 1] += dw[1:, :STEP] * follows[1:, None, None]
            out[n:] = dw[alone, :STEP]
            return out.reshape(-1, d)

        dv, dk = halves(a.transpose(0, 2, 1) @ do), halves(ds.transpose(0, 2, 1) @ q)
        dnear = np.bincount(_NEAR.reshape(-1), ds.sum(0).reshape(-1), KEYS).astype(np.float32)
        dx = dv @ p["v"].T
        dx += dk @ p["k"].T
        dh += dq @ p["q"].T
        dx[: n * STEP] += dh
        slow = rate * 0.3
        for name, grad in (
            ("q", xq.T @ dq), ("k", x.T @ dk), ("v", x.T @ dv), ("o", dwo), ("near", dnear), ("w1", dw1), ("b1", db1), ("w2", dw2)
        ):
            self._move(name, grad, slow)
        order = self._order(codes + 1)  # padding comes first, and has no gradient
        order = order[np.count_nonzero(codes < 0) :]
        if len(order):
            rows, grad = self._summed(codes, order, dx.take(order, 0))
            self._move("emb", grad, rate, rows)
        self.seen += np.bincount(keys.reshape(-1) + 1, minlength=len(self.seen) + 1)[1:]
        return loss / max(1, len(on))

    def block(self, codes: np.ndarray, start: bool) -> tuple[np.ndarray, np.ndarray]:
        """Windows and targets of a run of codes."""
        before = np.concatenate(([len(self.p["emb"]) - 1] if start else [-1], codes[:-1]))
        fill = -len(codes) % STEP
        stream = np.concatenate((np.full(STEP, -1), before, np.full(fill, -1))).astype(np.int64)
        target = np.concatenate((codes, np.full(fill, -1))).astype(np.int64)
        target[: 0 if start else 1] = -1
        halves = stream.reshape(-1, STEP)
        return np.concatenate((halves[:-1], halves[1:]), 1), target.reshape(-1, STEP)


def _pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def _unpack(blob: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = np.frombuffer(blob, "<f4", n, at).reshape(like[k].shape)
        at += 4 * n
    return out


def _weighted(p: dict[str, np.ndarray], seen: np.ndarray, used: np.ndarray) -> dict[str, np.ndarray]:
    """A shard's parameters times their weights: rows of tables weigh by how often
    the shard has met them."""
    weight = {"emb": seen[:, None], "node": used[:, None], "bias": used}
    return {k: v * weight.get(k, np.float32(1)) for k, v in p.items()}


def _averaged(parts: list[tuple[dict, np.ndarray, np.ndarray, int]], old: dict) -> dict[str, np.ndarray]:
    """Mean of the shards' parameters from sums of weighted parameters, of weights
    and of shards; rows nobody met stay."""
    seen, used = sum(s for _, s, _, _ in parts), sum(u for _, _, u, _ in parts)
    shards, out = sum(n for *_, n in parts), {}
    for name, before in old.items():
        total = sum(p[name].astype(np.float64) for p, *_ in parts)
        if name in ("emb", "node", "bias"):
            w = seen if name == "emb" else used
            w = w if total.ndim == 1 else w[:, None]
            out[name] = np.where(w > 0, total / np.maximum(w, 1e-9), before).astype(np.float32)
        else:
            out[name] = (total / shards).astype(np.float32)
    return out


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all rows; tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found.update(lower_words(text))
            if len(found) > COUNT_WORDS:
                yield out()
                found.clear()
        yield out()

    part = docs.select(column(text_col)).mapInArrow(count, "word binary, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def _word_encoder(vocabulary: str) -> Encoder:
    """The worker's encoder; all it is asked for here are words with a leading space."""
    enc = encoder(vocabulary)
    enc.quicken()
    return enc


def _led(words: pa.Array) -> pa.Array:
    """Words with a leading space."""
    space, nothing = (pa.scalar(x, pa.large_binary()) for x in (b" ", b""))
    return pc.binary_join_element_wise(space, words, nothing).cast(pa.large_string())


def _subword_counts(counts: DataFrame, vocabulary: str, end_id: int, ends: int) -> dict[int, int]:
    """Occurrences of each subword id in the corpus, from its word counts; one row
    per id of the vocabulary at most comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _word_encoder(vocabulary)
        total = np.zeros(enc.tokenizer.get_vocab_size(), np.int64)
        for batch in batches:
            ids, after = enc.joined_ids(_led(batch.column(0).cast(pa.large_binary())))
            weight = np.repeat(batch.column(1).to_numpy(), np.diff(after, prepend=0))
            np.add.at(total, ids, weight)
        own = np.flatnonzero(total)
        yield pa.record_batch([pa.array(own, pa.int64()), pa.array(total[own])], ["id", "n"])

    rows = counts.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    found = {r.id: int(r.n) for r in rows}
    if ends:
        found[end_id] = found.get(end_id, 0) + ends
    return found


def _coded(enc, tree: SubwordTree, texts: pa.Array) -> Iterator[tuple]:
    """Some texts at a time: words of all of them as a dictionary array and as a list,
    words of each text, codes of all words and where those of each word begin. Texts
    that are encoded together ask the tokenizer once for each distinct word."""
    texts = texts.cast(pa.binary())
    for rows in portions(texts, TOGETHER):
        words, sizes = [], []
        for text in texts[rows].to_pylist():
            own = lower_words(text)
            words += own
            sizes.append(len(own))
        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        ids, ends = enc.joined_ids(pa.DictionaryArray.from_arrays(coded.indices, _led(coded.dictionary)))
        yield coded, words, np.array(sizes, np.int64), tree.code.take(ids), np.append(0, ends)


def _sample(docs: DataFrame, text_col: str, vocabulary: str, tree: Broadcast, end_id: int, block: int, one_in: int):
    """Blocks of ``block`` words that the model trains on, as codes: all blocks of
    all texts, or one in ``one_in``, picked by the hash of their words. Copies of a
    block get keys of their own, so that they are dealt to all shards."""
    import xxhash

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kind, copies = _word_encoder(vocabulary), tree.value.stored, Counter()
        end = tree.value.code[[end_id]].astype(kind).tobytes()
        for batch in batches:
            for _, words, sizes, codes, begin in _coded(enc, tree.value, batch.column(0)):
                keys, starts, out, codes, first = [], [], [], codes.astype(kind), 0
                for size in sizes.tolist():
                    for at in range(0, max(1, size), block):
                        low, high = first + at, first + min(at + block, size)
                        h = xxhash.xxh64_intdigest(b" ".join(words[low:high]), at)
                        if h % one_in:
                            continue
                        if copies[h]:
                            keys.append(xxhash.xxh64_intdigest(h.to_bytes(8, "little"), copies[h]) >> 2)
                        else:
                            keys.append(h // one_in % (1 << 62))
                        copies[h] += 1
                        starts.append(at == 0)
                        out.append(codes[begin[low] : begin[high]].tobytes() + (end if at + block >= size else b""))
                    first += size
                yield pa.record_batch(
                    [pa.array(keys, pa.int64()), pa.array(starts, pa.bool_()), pa.array(out, pa.binary())],
                    ["key", "start", "codes"],
                )
            if len(copies) > COUNT_WORDS:
                copies.clear()

    return docs.select(column(text_col)).mapInArrow(cut, "key long, start boolean, codes binary")


def full_batches(
    windows: Iterator[tuple[np.ndarray, np.ndarray]], size: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and targets of all blocks, ``size`` windows at a time; only the last
    batch can be smaller."""
    keys, targets, n = [], [], 0
    for k, t in windows:
        keys.append(k)
        targets.append(t)
        n += len(k)
        if n >= size:
            k, t = np.concatenate(keys), np.concatenate(targets)
            rest = n % size
            for at in range(0, n - rest, size):
                yield k[at : at + size], t[at : at + size]
            keys, targets, n = [k[n - rest :]], [t[n - rest :]], rest
    if n:
        yield np.concatenate(keys), np.concatenate(targets)


def _trained(
    blocks: DataFrame, tree: Broadcast, params: dict, shards: int, batch_windows: int, rates: tuple[float, float]
) -> dict:
    """One pass: each shard of the blocks trains its own copy of the parameters,
    with a rate that falls evenly over the pass, and the copies are averaged. There
    are ``shards`` of them, and more where a shard would get over SHARD_BLOCKS
    blocks; SUMS sums of copies at most reach the driver."""
    shared = blocks.sparkSession.sparkContext.broadcast(params)
    width = np.dtype(tree.value.stored).itemsize
    n_windows = F.sum(F.ceil(F.octet_length("codes") / (width * STEP)))
    size = blocks.agg(n_windows.alias("n"), F.count(F.lit(1)).alias("blocks")).first()
    shards = max(shards, -(-size.blocks // SHARD_BLOCKS))
    planned = max(1.0, (size.n or 0) / shards / batch_windows)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, steps = Trainer(tree.value, shared.value, losses=False), 0

        def windows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for start, codes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    codes = np.frombuffer(codes, tree.value.stored).astype(np.int64)
                    if len(codes) > 1:
                        yield trainer.block(codes, start)

        for keys, targets in full_batches(windows(), batch_windows):
            rate = rates[0] + (rates[1] - rates[0]) * min(1.0, steps / planned)
            trainer.step(keys, targets, rate)
            steps += 1
        if steps:
            weighted = _weighted(trainer.p, trainer.seen, trainer.used)
            yield rows(weighted, trainer.seen, trainer.used, 1, TaskContext.get().partitionId())

    def rows(p, seen, used, n, shard) -> pa.RecordBatch:
        blobs = [_pack(p), seen.astype("<f4").tobytes(), used.astype("<f4").tobytes()]
        arrays = [pa.array([b], pa.binary()) for b in blobs]
        return pa.record_batch([*arrays, pa.array([n], pa.int64()), pa.array([shard], pa.int64())], names)

    def parted(row) -> tuple:
        p, seen, used, n = row
        return _unpack(p, shared.value), np.frombuffer(seen, "<f4"), np.frombuffer(used, "<f4"), n

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shard = None, 0
        for batch in batches:
            for *row, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, seen, used, n = parted(row)
                if total is None:
                    total = ({k: v.copy() for k, v in p.items()}, seen.copy(), used.copy(), n)
                    continue
                for k, v in p.items():
                    total[0][k][...] += v
                total = (total[0], total[1] + seen, total[2] + used, total[3] + n)
        if total:
            yield rows(*total, shard)

    names = ["p", "seen", "used", "n", "shard"]
    schema = "p binary, seen binary, used binary, n long, shard long"
    dealt = blocks.repartition(shards, "key").sortWithinPartitions("key", "codes")
    sums = dealt.mapInArrow(train, schema)
    if shards > SUMS:
        sums = sums.repartition(SUMS, "shard").sortWithinPartitions("shard").mapInArrow(add, schema)
    found = sums.collect()
    if not found:
        shared.unpersist()
        return params
    parts = [parted(r[:4]) for r in sorted(found, key=lambda r: r.shard)]
    shared.unpersist()
    return _averaged(parts, params)


def fit(
    docs: DataFrame,
    counts: DataFrame,
    n_docs: int,
    vocabulary: str,
    text_col: str = "text",
    end_id: int = 50256,
    one_in: int = 1,
    block_words: int = 96,
    rounds: int = 4,
    shards: int = 1,
    batch_windows: int = 32,
    rate: float = 0.35,
) -> Model:
    """Train on ``docs``, whose word counts are given.

    Subword counts of the whole corpus make the tree and its first biases. The
    weights are learnt from all blocks of all texts (from one in ``one_in``, where
    asked for), each read once. Shards of up to SHARD_BLOCKS blocks (``shards`` of
    them at least: averaging copies that each saw little learns less than one copy
    does) train in parallel and are averaged after each of ``rounds`` passes, each
    over its own part of the blocks; the learning rate falls from ``rate`` to a tenth
    over all passes.
    """
    enc = encoder(vocabulary)
    subwords = _subword_counts(counts, vocabulary, end_id, n_docs)
    tree = SubwordTree(subwords, enc.tokenizer.get_vocab_size())
    params = initial(tree)
    if len(subwords) > 1:
        shared = docs.sparkSession.sparkContext.broadcast(tree)
        blocks = saved(_sample(docs, text_col, vocabulary, shared, end_id, block_words, one_in), "blocks")
        for r in range(rounds):
            part = blocks.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r)
            rates = tuple(rate * (1 - 0.9 * x / rounds) for x in (r, r + 1))
            params = _trained(part, shared, params, shards, batch_windows, rates)
    return Model(tree, params)


def _scored(model: Broadcast, hot: Broadcast, vocabulary: str, end_id: int):
    @F.arrow_udf(
        "struct<n_tokens: bigint, known: bigint, base: double, score: double, "
        "rare: array<struct<word: binary, n: bigint>>>"
    )
    def run(texts: pa.Array) -> pa.Array:
        enc, table, tree = _word_encoder(vocabulary), hot.value, model.value.tree
        n_tokens, known, base, scores, held, size = [], [], [], [], [], 0
        rare_words, rare_counts, rare_sizes = [pa.array([], pa.large_binary())], [], [0]
        for coded, _, sizes, codes, begin in _coded(enc, tree, texts):
            names, word, n = coded.dictionary, coded.indices.to_numpy(), len(sizes)
            logs = np.array([table.get(w, math.nan) for w in names.to_pylist()])[word] if len(word) else np.empty(0)
            text, rare = np.repeat(np.arange(n), sizes), np.isnan(logs)
            n_tokens += (sizes + 1).tolist()
            known += (sizes - np.bincount(text[rare], minlength=n)).tolist()
            base += np.bincount(text, np.where(rare, 0, logs), n).tolist()
            pairs, times = np.unique(text[rare] * len(names) + word[rare], return_counts=True)
            rare_words.append(names.take(pa.array(pairs % max(1, len(names)))))
            rare_counts += times.tolist()
            rare_sizes += np.bincount(pairs // max(1, len(names)), minlength=n).tolist()
            ends = np.cumsum(sizes)
            for low, high in zip(begin[ends - sizes].tolist(), begin[ends].tolist(), strict=True):
                held.append(np.append(codes[low:high], tree.code[end_id]).astype(np.int64))
                size += len(held[-1])
                if size > CODE_POSITIONS:
                    scores.append(model.value.score(held))
                    held, size = [], 0
        scores.append(model.value.score(held))
        pairs = pa.StructArray.from_arrays(
            [pa.concat_arrays(rare_words).cast(pa.binary()), pa.array(rare_counts, pa.int64())], ["word", "n"]
        )
        columns = {
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "known": pa.array(known, pa.int64()),
            "base": pa.array(base, pa.float64()),
            "score": pa.array(np.concatenate(scores)),
            "rare": pa.ListArray.from_arrays(pa.array(np.cumsum(rare_sizes), pa.int32()), pairs),
        }
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return run


def score(
    docs: DataFrame,
    train: F.Column,
    vocabulary: str,
    text_col: str = "text",
    end_id: int = 50256,
    hot_words: int = 65_536,
    **options,
) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score to the columns.

    Learns from the rows where ``train`` holds (null counts as no). ``base_score``
    is the unigram log10 probability of the text's words and its end with 0.1
    added to every count; ``score`` is the attention model's log10 probability of
    the same words and end as subword ids. Whole texts are scored, each position
    once; input columns of these names are replaced.

    * Null and empty texts are just an end. Texts have no length limit.
    * Repeated rows count as often as they occur.
    * With no rows to learn from, counts are zero and all subwords equally likely.

    The ``hot_words`` most frequent words are looked up in a broadcast of fixed
    size while texts are scored; only the others are shuffled to their counts.
    """
    spark = docs.sparkSession
    learn = docs.filter(F.coalesce(train, F.lit(False)))
    counts = saved(word_counts(learn, text_col), "counts")
    n_docs = learn.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total.n) + n_docs, int(total.v) + (n_docs > 0)
    below = n + 0.1 * (v + 1)
    top = counts.orderBy(F.col("n").desc(), "word").limit(hot_words).collect()
    hot = {bytes(r.word): math.log10((r.n + 0.1) / below) for r in top}
    model = fit(learn, counts, n_docs, vocabulary, text_col, end_id, **options)
    context = spark.sparkContext
    run = _scored(context.broadcast(model), context.broadcast(hot), vocabulary, end_id)
    rows = saved(
        packed(docs)
        .withColumn("r", run(F.col("row").getField(text_col)))
        .withColumn("number", F.monotonically_increasing_id()),
        "scored",
    )
    rare = rows.select("number", F.explode("r.rare").alias("w")).select("number", "w.word", F.col("w.n").alias("times"))
    found = F.coalesce("n", F.lit(0))
    tail = (
        rare.join(counts, "word", "left")
        .groupBy("number")
        .agg(
            F.sum(F.col("times") * F.log10((found + 0.1) / F.lit(below))).alias("base"),
            F.sum(F.when(found > 0, F.col("times")).otherwise(0)).alias("known"),
        )
    )
    end = math.log10((n_docs + 0.1) / below)
    joined = rows.drop("base", "known").join(tail, "number", "left")
    return unpacked(
        joined,
        n_tokens=F.col("r.n_tokens"),
        n_known=(F.col("r.known") + F.coalesce("known", F.lit(0)) + F.lit(int(n_docs > 0))).cast("long"),
        train_tokens=F.lit(n).cast("long"),
        base_score=F.col("r.base") + F.coalesce("base", F.lit(0.0)) + F.lit(end),
        score=F.col("r.score"),
    )
