"""SentencePiece encoding and decoding with distinct sampled segmentations.

All ways to cut a text into vocabulary pieces form a lattice; a segmentation's
probability is in proportion to the product of its pieces' weights, (r + 2) ** -THETA
for a piece of merge rank r (characters outside the vocabulary are their bytes). The k
largest of independently Gumbel-perturbed log-probabilities are k distinct samples
without replacement. They are found by best-first (A*) search with exact bounds, never
by listing segmentations: a node of the search is a set of segmentations (a fixed
beginning, then a unit that must differ from given cuts, then anything); its bound is
the largest perturbed value within, drawn as a Gumbel truncated at its parent's. The
best node's winner is drawn, given out, and the rest of the node is split by the first
unit that differs. With kappa, the bound left after the kth sample, a sample of log-probability
phi has inclusion score 1 - exp(-exp(phi - kappa)), given as its logarithm.

No piece holds a blank or a line end after its beginning, so the lattice of a text
is a chain of unit lattices (a blank run with the characters after it); sums and best
cuts are kept per distinct unit.

Random numbers come from a generator seeded by the row's key alone: rows of equal key and
text get equal samples, whatever the partitioning.

Defined results: null and empty texts have one sample without pieces (log-probability and
log-inclusion 0); a text with fewer than k segmentations (of probability over
``LEAST_MASS``) gives them all, with log-inclusion 0;
a literal U+2581 is coded by its bytes, so decoding gives every text back exactly;
repeated rows give their samples each; other columns play no part; an empty table gives
an empty table.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THETA, SAMPLES, SEED = 2.0, 2, 20
#: Distinct units whose best cuts, sums and lattices a worker keeps; beyond, it starts anew.
CACHED_UNITS, CACHED_SUMS, CACHED_TABLES, CACHED_LATTICES = 250_000, 10_000, 8_000, 1_000
#: All cuts of units up to this length are listed, once.
SHORT = 7
#: Sets of less probability are passed over: rounding would rule them.
LEAST_MASS = 1e-12
#: The unit of a literal U+2581: no text holds a lone surrogate.
LITERAL = "\udfff"
#: Lattices of longer units are summed by logarithms.
LINEAR = 60
_PER_CHAR = 1000.0  # scales weights by length, which leaves all ratios as they are


class Unit:
    """Lattice of one unit: edges by start, and backward sums (logarithms)."""

    __slots__ = ("edges", "after")

    def __init__(self, edges, after):
        self.edges, self.after = edges, after


def log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))); for small x that is x, where the number itself would be 0."""
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 50.0))))


class Sampler:
    def __init__(self, model: str, theta: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.weights, self.ids, self.bytes_of, single = {}, {}, [], {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                single[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                continue
            self.bytes_of.append(b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace("▁", " ").encode())
            if self.bytes_of[-1]:
                self.ids[piece] = i.to_bytes(4, "little")
                self.weights[piece] = (2.0 - sp.get_score(i)) ** -theta * _PER_CHAR ** len(piece)
        for piece in list(self.weights):  # beginnings of pieces are kept with weight 0, so that walks can stop
            for n in range(1, len(piece)):
                self.weights.setdefault(piece[:n], 0.0)
        self.byte_ids, self.byte_weight = single, (2.0 + sp.get_piece_size()) ** -theta
        self.units, self.lattices, self.summed, self.tables = {}, {}, {}, {}
        self.cut = re.compile("▁+[^▁\n]*|[^▁\n]+|\n").findall

    def edges(self, unit: str) -> list[list[tuple[int, float, bytes]]]:
        """For every start the (end, weight, ids) of its edges."""
        out, size, weights = [], len(unit), self.weights
        for i in range(size):
            here = []
            for j in range(i + 1, size + 1):
                w = weights.get(unit[i:j])
                if w is None:
                    break
                if w:
                    here.append((j, w, self.ids[unit[i:j]]))
            if not here or here[0][0] != i + 1:
                here.insert(0, (i + 1, self.fallback(unit[i]), self.piece(unit[i])))
            out.append(here)
        return out

    def sums(self, unit: str) -> tuple[list[float], list[float], list[int]]:
        """Of every start: the sum over all cuts of what follows, the best cut's product, and where its first piece ends.

        Plain numbers; a unit over ``LINEAR`` characters would overflow them and is left to ``lattice``.
        """
        made = self.summed.get(unit)
        if made is not None:
            return made
        n, get, size = len(unit), self.weights.get, range
        after, top, step = [1.0] * (n + 1), [1.0] * (n + 1), [0] * n
        for i in size(n - 1, -1, -1):
            w = get(unit[i])
            known, w = w is not None, w or self.fallback(unit[i])
            total, high, end = w * after[i + 1], w * top[i + 1], i + 1
            if known:
                for j in size(i + 2, n + 1):
                    w = get(unit[i:j])
                    if w:
                        total += w * after[j]
                        w *= top[j]
                        if w > high:
                            high, end = w, j
                    elif w is None:
                        break
            after[i], top[i], step[i] = total, high, end
        return after, top, step

    def fallback(self, char: str) -> float:
        return self.byte_weight ** len(self.raw(char)) * _PER_CHAR

    @staticmethod
    def raw(char: str) -> bytes:
        return ("▁" if char == LITERAL else char).encode("utf-8", "surrogatepass")

    def piece(self, text: str) -> bytes:
        """Ids of an edge."""
        made = self.ids.get(text)
        return made if made is not None else b"".join([self.byte_ids[b].to_bytes(4, "little") for b in self.raw(text)])

    def solve(self, unit: str) -> tuple[bytes, float]:
        """Best cut of a unit and its probability."""
        n = len(unit)
        if n <= LINEAR:
            after, top, step = self.sums(unit)
            p, parts, i = top[0] / after[0], [], 0
            while i < n:
                parts.append(self.piece(unit[i:step[i]]))
                i = step[i]
            return b"".join(parts), min(1.0, p)
        lattice = self.lattice(unit)
        top, step = [0.0] * (n + 1), [None] * n
        for i in range(n - 1, -1, -1):
            top[i], step[i] = max(((w + top[j], (j, s)) for j, w, s in lattice.edges[i]), key=lambda x: x[0])
        parts, i = [], 0
        while i < n:
            i, s = step[i]
            parts.append(s)
        return b"".join(parts), min(1.0, math.exp(top[0] - lattice.after[0]))

    def unlike_best(self, unit: str, random) -> tuple[bytes, float] | None:
        """A cut drawn from all but the best one, by their probabilities, and its probability."""
        n = len(unit)
        if n <= SHORT:
            ids, p, sums = self.others(unit)
            if not ids or not sums[-1]:
                return None
            at = min(bisect_right(sums, random() * sums[-1]), len(ids) - 1)
            return ids[at], p[at]
        if n > LINEAR:
            return self.other(unit, [self.solve(unit)[0]], random)
        get, made = self.weights.get, self.sums(unit)
        if len(self.summed) > CACHED_SUMS:
            self.summed.clear()
        self.summed[unit] = made
        after, top, step = made
        i, on, product, parts = 0, True, 1.0, []
        while i < n:
            total = after[i] - top[i] if on else after[i]
            if total <= after[i] * 1e-15:
                return None
            u, chosen = random() * total, None
            for j in range(i + 1, n + 1):
                w = get(unit[i:j])
                if not w:
                    if j == i + 1:
                        last = w is None
                        w = self.fallback(unit[i])
                    elif w is None:
                        break
                    else:
                        continue
                else:
                    last = False
                m = w * after[j]
                if on and j == step[i]:
                    m -= w * top[j]
                    m = m if m > after[i] * 1e-15 else 0.0
                if m > 0.0:
                    chosen = (j, w)
                    if u < m:
                        break
                    u -= m
                if last:
                    break
            if chosen is None:
                return None
            j, w = chosen
            parts.append(self.piece(unit[i:j]))
            product *= w
            on = on and j == step[i]
            i = j
        return b"".join(parts), product / after[0]

    def number(self, unit: str) -> tuple[bytes, float]:
        """Best cut and its probability, kept."""
        self.units[unit] = made = self.solve(unit)
        return made

    def others(self, unit: str) -> tuple[list[bytes], list[float], list[float]]:
        """All cuts of a short unit but the best one: ids, probabilities, and their running sum."""
        made = self.tables.get(unit)
        if made is None:
            edges, cuts = self.edges(unit), []

            def walk(i, ids, w):
                if i == len(unit):
                    cuts.append((w, ids))
                    return
                for j, v, s in edges[i]:
                    walk(j, ids + s, w * v)

            walk(0, b"", 1.0)
            best, total = (self.units.get(unit) or self.number(unit))[0], sum(w for w, _ in cuts)
            cuts = sorted(((w / total, ids) for w, ids in cuts if ids != best), reverse=True)
            made = [c[1] for c in cuts], [c[0] for c in cuts], list(accumulate(c[0] for c in cuts))
            if len(self.tables) > CACHED_TABLES:
                self.tables.clear()
            self.tables[unit] = made
        return made

    def lattice(self, unit: str) -> Unit:
        made = self.lattices.get(unit)
        if made is None:
            edges = [[(j, math.log(w), s) for j, w, s in here] for here in self.edges(unit)]
            after = [0.0] * (len(unit) + 1)
            for i in range(len(unit) - 1, -1, -1):
                terms = [w + after[j] for j, w, _ in edges[i]]
                high = max(terms)
                after[i] = high + math.log(sum([math.exp(t - high) for t in terms]))
            if len(self.lattices) > CACHED_LATTICES:
                self.lattices.clear()
            self.lattices[unit] = made = Unit(edges, after)
        return made

    def other(self, unit: str, banned: list[bytes], random) -> tuple[bytes, float] | None:
        """A cut drawn from those not in ``banned``, by their probabilities, and its probability; None if no mass is left."""
        lattice = self.lattice(unit)
        edges, after = lattice.edges, lattice.after
        # what each banned cut still has ahead of it, by position
        ahead = []
        for cut in banned:
            path, i, at = [], 0, 0
            while i < len(unit):
                j, w, s = next((e for e in edges[i] if cut.startswith(e[2], at) and self._rest_fits(unit, e[0], cut, at + len(e[2]))))
                path.append((i, j, w, s))
                i, at = j, at + len(s)
            ahead.append(path)
        i, depth, log_p, parts = 0, 0, 0.0, []
        while i < len(unit):
            masses = []
            for j, w, s in edges[i]:
                m = math.exp(w + after[j] - after[i])
                for path in ahead:
                    if path[depth][3] == s and path[depth][1] == j:
                        m -= math.exp(sum(e[2] for e in path[depth:]) - after[i])
                masses.append(m if m > 1e-15 else 0.0)
            total = sum(masses)
            if total <= 0:
                return None
            u, k = random() * total, 0
            while k < len(masses) - 1 and (u >= masses[k] or not masses[k]):
                u -= masses[k]
                k += 1
            while not masses[k]:
                k -= 1
            j, w, s = edges[i][k]
            ahead = [path for path in ahead if path[depth][3] == s and path[depth][1] == j]
            log_p += w
            parts.append(s)
            i, depth = j, depth + 1
        return b"".join(parts), math.exp(log_p - after[0])

    def _rest_fits(self, unit, i, cut, at) -> bool:
        """The ids of a cut from ``at`` spell the unit from ``i``."""
        spelt = b"".join([self.bytes_of[int.from_bytes(cut[k:k + 4], "little")] for k in range(at, len(cut), 4)])
        return spelt == unit[i:].replace("▁", " ").replace(LITERAL, "▁").encode("utf-8", "surrogatepass")

    def units_of(self, text: str) -> list[str]:
        if "▁" in text:
            out = []
            for part in re.split("(▁)", text):
                out += [LITERAL] if part == "▁" else self.cut(part.replace(" ", "▁"))
            return self._first(out)
        return self.cut("▁" + text.replace(" ", "▁"))

    @staticmethod
    def _first(units: list[str]) -> list[str]:
        """The blank that stands before every text."""
        if units and units[0][0] not in ("\n", LITERAL):
            return ["▁" + units[0], *units[1:]]
        return ["▁", *units]

    def sample(self, text: str, key: str, k: int) -> list[tuple[bytes, float, float, float]]:
        """Up to k distinct samples (ids, log-probability, perturbed value, log-inclusion), largest perturbed value first."""
        if not text:
            return [(b"", 0.0, 0.0, 0.0)]
        if len(self.units) > CACHED_UNITS:
            self.units = {}
        units = self.units_of(text)
        known, number = self.units.get, self.number
        solved = [known(u) or number(u) for u in units]
        best, values = [x[0] for x in solved], np.array([x[1] for x in solved])
        with np.errstate(divide="ignore"):
            log_best, rest_best = np.log(values), np.where(values < 1 - LEAST_MASS, np.log1p(-np.minimum(values, 1 - 1e-16)), -np.inf)
        random = np.random.Generator(np.random.SFC64(xxhash.xxh64_intdigest(key, SEED)))
        size = len(units)
        found, heap, order = [], [(-float(random.gumbel()), 0, 0, [], None, None)], 0
        while heap and len(found) < k:
            minus, _, t, banned, cuts, logs = heapq.heappop(heap)
            bound = -minus
            new_cuts, new_logs, rest = best.copy(), log_best.copy(), rest_best.copy()
            free = t
            if cuts is not None:
                new_cuts[:t], new_logs[:t] = cuts[:t], logs[:t]
                drawn = self.other(units[t], banned, random.random)
                if drawn is None:
                    continue
                new_cuts[t], new_logs[t] = drawn[0], math.log(drawn[1])
                mass = 1.0 - drawn[1] - sum(self.probability(units[t], b) for b in banned)
                rest[t] = math.log(mass) if mass > LEAST_MASS else -np.inf
                free = t + 1
            draws = random.random(size - free)
            for i in (np.flatnonzero(draws >= values[free:]) + free).tolist():
                drawn = self.unlike_best(units[i], random.random) if rest_best[i] > -np.inf else None
                if drawn is not None:
                    new_cuts[i], new_logs[i] = drawn[0], math.log(drawn[1])
                    rest[i] = math.log1p(-drawn[1]) if drawn[1] < 1 - LEAST_MASS else -np.inf
            found.append((b"".join(new_cuts), float(new_logs.sum()), bound))
            before = np.concatenate([[0.0], np.cumsum(new_logs)[:-1]])
            location = (before + rest)[t:]
            with np.errstate(over="ignore"):
                bounds = location - np.log(np.exp(location - bound) - np.log(random.random(size - t)))
            bounds = np.where(np.isneginf(location), -np.inf, np.minimum(bounds, bound))
            need = min(k + 1 - len(found), len(bounds))
            top = np.argpartition(-bounds, need - 1)[:need] if need < len(bounds) else np.arange(len(bounds))
            for i in top.tolist():
                if bounds[i] > -np.inf:
                    order += 1
                    j = i + t
                    heapq.heappush(heap, (-float(bounds[i]), order, j, [new_cuts[j], *(banned if j == t else [])], new_cuts, new_logs))
        kappa = -heap[0][0] if heap else -math.inf
        return [(ids, p, g, log_inclusion(p - kappa) if heap else 0.0) for ids, p, g in found]

    def probability(self, unit: str, cut: bytes) -> float:
        lattice, i, at, log_p = self.lattice(unit), 0, 0, 0.0
        while i < len(unit):
            j, w, s = next((e for e in lattice.edges[i] if cut.startswith(e[2], at) and self._rest_fits(unit, e[0], cut, at + len(e[2]))))
            i, at, log_p = j, at + len(s), log_p + w
        return math.exp(log_p - lattice.after[0])

    def decode(self, ids: bytes) -> str:
        line = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (line[1:] if line[:1] == b" " else line).decode("utf-8", "surrogatepass")


def sampler(model: str, theta: float) -> Sampler:
    """One per worker process and model."""
    held = sys.__dict__.setdefault("_piece_samplers", {})
    if (model, theta) not in held:
        held[model, theta] = Sampler(model, theta)
    return held[model, theta]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", samples: int = SAMPLES, theta: float = THETA) -> DataFrame:
    """(id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids): sampled segmentations; ids are little-endian unsigned 32-bit."""
    def run(batches):
        tool = sampler(model, theta)
        for batch in batches:
            keys = batch.column(0).cast(pa.string()).to_pylist()
            rows, held = [], 0

            def out():
                return pa.record_batch([batch.column(0).take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.int32()), pa.array([len(r[2]) // 4 for r in rows], pa.int64()),
                                        *(pa.array([r[i] for r in rows], pa.float64()) for i in (3, 4, 5)), pa.array([r[2] for r in rows], pa.binary())],
                                       names=["id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids"])
            for i, value in enumerate(batch.column(1)):
                for n, (ids, *scores) in enumerate(tool.sample(value.as_py() or "", str(keys[i]), samples)):
                    rows.append((i, n, ids, *scores))
                    held += len(ids)
                if held > 2_000_000:
                    yield out()
                    rows, held = [], 0
            yield out()
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(
        run, f"id {kind}, sample int, n_pieces bigint, log_prob double, perturbed double, log_inclusion double, ids binary")


def decoded(pieces: DataFrame, model: str, theta: float = THETA) -> DataFrame:
    """``pieces`` (with binary ``ids``) with ``text`` in place of ``ids``."""
    at = pieces.columns.index("ids")
    names = [*pieces.columns[:at], "text", *pieces.columns[at + 1:]]

    def run(batches):
        tool = sampler(model, theta)
        for batch in batches:
            arrays = list(batch.columns)
            arrays[at] = pa.array([None if v is None else tool.decode(v) for v in batch.column(at).to_pylist()], pa.string())
            yield pa.record_batch(arrays, names=names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if i != at else "`text` string" for i, f in enumerate(pieces.schema.fields))
    return pieces.mapInArrow(run, schema)
