"""Encoding with a SentencePiece vocabulary by Gumbel top-k sampling without replacement, and decoding.

Segmentations of a text are the paths of its piece lattice, weighted by the product of piece weights. The perturbed A*
search of Gumbel top-k sampling runs backwards over the lattice: forward filtering gives each node the mass of its prefixes;
a sampled path with perturbed score G leaves, at each of its nodes, the other arcs as one frontier entry, whose greatest
perturbed score is a Gumbel variable at the log mass of those arcs, truncated at G. The best entry of the frontier is the
next sample. The samples of a text are distinct; a sample's inclusion score is log(1 - exp(-exp(log_prob - kappa))), where
kappa is the greatest perturbed score left when the last sample is out (0 if none is left).

No piece crosses a space that follows another character, nor a line break, so that the lattice of a text is the chain of the
lattices of its units (spaces and the word after them); each distinct unit's lattice is made once and kept by the worker in
tables of at most ``CACHED_BYTES``. When they are full, units that came up once only make room; a worker's memory hence
depends on neither the size of the task nor the number of its distinct units.

The given vocabulary has merge ranks in place of log probabilities: a piece of rank r weighs ``(r + 3) ** -alpha``, a byte
as much as the last rank. Text isn't normalised. A leading space is added as the vocabulary expects; characters without a
piece are spelled in bytes, so that decoding gives the exact text.

Cases: null text gives one sample without ids (null ids, log_prob 0); empty text one sample with no ids; texts with fewer
segmentations than asked for give as many as there are; rows repeating a key draw alike, a null key draws as 0 (the key is
``doc_id`` unless another column is given); a text longer than ``CHUNK`` is sampled by itself, in memory that grows with it;
further columns are ignored unless kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from netquill.llm.common import U64, mix64, range_hashes, text_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHED_BYTES = 48 << 20  # of lattice tables and their index that a worker keeps between chunks
BLOCK_CHARS = 1 << 16  # characters of new units whose lattices are made at once
CHUNK = 1 << 19  # bytes of text sampled at once


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other."""
    lengths = lengths.astype(np.int64)
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class Trie:
    """The pieces' prefixes as states of a trie, whose edges are an open-addressed table, so that all positions of a text are
    matched in step."""

    SLOT_BITS, STRIDE = 20, 0x9E3779B97F4A7C15

    def __init__(self, pieces: list[str]):
        edges: dict[int, int] = {}
        ends, self.longest = {}, max(map(len, pieces))
        for n, piece in enumerate(pieces):
            state = 0
            for c in piece:
                state = edges.setdefault(state << 21 | ord(c), len(edges) + 1)
            ends[state] = n
        if 2 * len(edges) > 1 << self.SLOT_BITS:
            raise ValueError("too many piece prefixes for the table of edges")
        self.key, self.next = np.full(1 << self.SLOT_BITS, -1, np.int64), np.zeros(1 << self.SLOT_BITS, np.int32)
        for slot, (key, state) in zip(self._slots(np.array(list(edges), np.int64)).tolist(), edges.items()):
            while self.key[slot] >= 0:
                slot = (slot + 1) % len(self.key)
            self.key[slot], self.next[slot] = key, state
        self.piece = np.full(len(edges) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(U64) * U64(self.STRIDE) >> U64(64 - self.SLOT_BITS)).astype(np.int64)

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states that follow, 0 where there is none."""
        keys = state.astype(np.int64) << 21 | codes
        slot = self._slots(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.next[slot], 0)
        other = np.flatnonzero((found != keys) & (found >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) % len(self.key)
            found = self.key[slot[other]]
            hit = found == keys[other]
            out[other[hit]] = self.next[slot[other[hit]]]
            other = other[~hit & (found >= 0)]
        return out

    def matches(self, codes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the positions where pieces of that length end, ascending, and the pieces; longest first."""
        at, state, out = np.arange(len(codes)), np.zeros(len(codes), np.int32), []
        for n in range(1, self.longest + 1):
            if len(at) and at[-1] + n > len(codes):
                inside = at + n <= len(codes)
                at, state = at[inside], state[inside]
            state = self.step(state, codes[at + n - 1])
            live = state > 0
            at, state = at[live], state[live]
            if not len(at):
                break
            piece = self.piece[state]
            hit = piece >= 0
            out.append((n, at[hit] + n - 1, piece[hit]))
        return out[::-1]


class Vocabulary:
    """Pieces with a space in place of the visible one, byte ids, and piece weights."""

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        last = max(-p.get_score(i) for i in range(len(p)) if p.get_score(i) > -1e6)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids = [0] * 256
        self.spelled = [b""] * len(p)
        for i in range(len(p)):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i)):
                text = piece.replace("▁", " ")
                if " " in text.lstrip(" ") or "\n" in text and text != "\n":
                    raise ValueError(f"piece {piece!r} crosses a unit boundary")
                self.pieces[text] = (i, (min(-p.get_score(i), last) + 3.0) ** -alpha)
                self.spelled[i] = text.encode()
        self.byte_weight = (last + 3.0) ** -alpha
        self.trie = Trie(list(self.pieces))
        self.piece_id = np.array([i for i, _ in self.pieces.values()], np.int32)
        self.piece_log = np.log([w for _, w in self.pieces.values()])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "pieces"}  # tasks match by the trie


def cut_units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with the space before each, and where units start and how long they are, and the first unit of
    each text; from the last unit of a text to its first."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    codes = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), np.uint32)
    heads = np.cumsum(sizes) - sizes
    line, space = codes == 10, codes == 32
    begins = line.copy()
    begins[heads[sizes > 0]] = True
    begins[1:] |= line[:-1] | space[1:] & ~space[:-1]
    starts = np.flatnonzero(begins)
    counts = np.bincount(np.searchsorted(heads, starts, "right") - 1, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(counts)))
    order = np.repeat(first[:-1] + first[1:] - 1, counts) - np.arange(len(starts))
    return codes, starts[order], np.diff(starts, append=len(codes))[order], first


class Lattices:
    """The lattices of distinct units: nodes are prefixes, arcs the pieces that end there, with their probabilities.

    A unit is found by a hash and compared by its characters. New units are joined by a separator that no piece holds, matched
    at once, and summed position by position; a unit's node 0 is the separator before it and the numbers of nodes are positions
    in all text joined so far.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.seed = vocabulary, 0
        self.byte_ids = np.array(vocabulary.byte_ids, np.int64)
        self.clear()

    KINDS = {
        "unit_hash": U64, "unit_node": np.int32, "unit_len": np.int32, "unit_uses": np.int32, "node_code": np.uint32, "node_arc": np.int32, "arc_len": np.int8, "arc_id": np.int32,
        "arc_log": np.float32, "arc_cum": np.float32,
    }

    def clear(self) -> None:
        self.rows = {k: np.zeros(1 << 14, kind) for k, kind in self.KINDS.items()}  # grown by halves
        self.tables = {k: v[: int(k == "node_arc")] for k, v in self.rows.items()}
        self._index()

    def _index(self) -> None:
        self.order = np.argsort(self.tables["unit_hash"])
        self.sorted = self.tables["unit_hash"][self.order]

    def _append(self, grown: dict[str, np.ndarray]) -> None:
        for k, new in grown.items():
            had, rows = len(self.tables[k]), self.rows[k]
            if had + len(new) > len(rows):
                self.rows[k] = rows = np.concatenate((rows[:had], np.zeros(had // 2 + len(new), rows.dtype)))
            rows[had : had + len(new)] = new
            self.tables[k] = rows[: had + len(new)]

    def compact(self) -> None:
        """Keeps the units that came up more than once, or none where these alone fill more than half of the room."""
        t = {k: v.copy() for k, v in self.tables.items()}
        kept = np.flatnonzero(t["unit_uses"] > 1)
        self.clear()
        width = t["unit_len"][kept].astype(np.int64) + 1
        nodes = _ranges(t["unit_node"][kept], width)
        arcs = t["node_arc"][nodes + 1] - t["node_arc"][nodes]
        of = _ranges(t["node_arc"][nodes], arcs)
        fresh = {"unit_node": np.cumsum(width) - width, "unit_uses": np.zeros(len(kept), np.int32), "node_arc": np.cumsum(arcs), "node_code": t["node_code"][nodes]}
        fresh |= {k: t[k][kept] for k in ("unit_hash", "unit_len")} | {k: t[k][of] for k in ("arc_len", "arc_id", "arc_log", "arc_cum")}
        if sum(len(v) * self.KINDS[k]().itemsize for k, v in fresh.items()) <= CACHED_BYTES // 2:
            self._append(fresh)
            self._index()

    def numbers(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The units' numbers, with lattices made for those not known yet."""
        if sum(v.nbytes for v in self.tables.values()) > CACHED_BYTES:
            self.compact()
        while True:
            hashes, back, inverse = np.unique(range_hashes(codes, starts, lengths, self.seed), return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.sorted, hashes), max(len(self.sorted) - 1, 0))
            known = self.sorted[at] == hashes if len(self.sorted) else np.zeros(len(hashes), bool)
            new = np.flatnonzero(~known)
            number = np.empty(len(hashes), np.int64)
            number[known] = self.order[at[known]]
            number[new] = len(self.order) + np.arange(len(new))
            blocks = np.cumsum(lengths[back[new]]) // BLOCK_CHARS
            for block in np.split(new, np.flatnonzero(np.diff(blocks)) + 1):
                self.add(codes, starts[back[block]], lengths[back[block]], hashes[block])
            if len(new):
                self._index()
            t, found = self.tables, number[inverse]
            if (t["unit_len"][found] == lengths).all() and (t["node_code"][_ranges(t["unit_node"][found] + 1, lengths)] == codes[_ranges(starts, lengths)]).all():
                break
            self.seed += 1  # two units of one hash: all start anew with another
            self.clear()
        t["unit_uses"][number] += np.bincount(inverse, minlength=len(number)).astype(np.int32)
        return found

    def add(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        """Lattices of units not known yet, numbered on in the order given."""
        heads = np.cumsum(lengths + 1) - lengths - 1
        codes = np.zeros(len(heads) and heads[-1] + lengths[-1] + 1, np.int64)  # 0 is the separator; it heads each unit
        codes[_ranges(heads + 1, lengths)] = text[_ranges(starts, lengths)]
        found = self.v.trie.matches(codes)
        arcs = np.zeros(len(codes), np.int64)
        for _, ends, _ in found:
            arcs[ends] += 1
        bare = np.ones(len(codes), bool)  # characters that are no pieces
        bare[heads] = False
        if found and found[-1][0] == 1:
            bare[found[-1][1]] = False
        bare = np.flatnonzero(bare)
        arcs[bare] += 1
        first = np.concatenate(([0], np.cumsum(arcs)))
        node = np.repeat(np.arange(len(codes)), arcs)
        length, ids, log = np.ones(len(node), np.int32), np.empty(len(node), np.int32), np.empty(len(node))
        free = first[:-1].copy()
        for n, ends, pieces in found:
            into = free[ends]
            length[into], ids[into], log[into] = n, self.v.piece_id[pieces], self.v.piece_log[pieces]
            free[ends] += 1
        code = codes[bare]
        width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        alone = self.byte_ids[np.minimum(code, 127)]  # a character of one byte is that byte's id
        ids[free[bare]], log[free[bare]] = np.where(width == 1, alone, -code - 1), width * math.log(self.v.byte_weight)
        place = node - np.repeat(heads, lengths + 1)[node]
        mass, score = np.zeros(len(codes)), np.empty(len(node))
        order = np.argsort(place, kind="stable")
        rounds = np.searchsorted(place[order], np.arange(1, (lengths.max() if len(lengths) else 0) + 2))
        for low, high in zip(rounds[:-1], rounds[1:]):
            own = order[low:high]
            at = node[own]
            score[own] = terms = log[own] + mass[at - length[own]]
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            top = np.maximum.reduceat(terms, starts)
            parts = np.exp(terms - np.repeat(top, np.diff(starts, append=len(at))))
            mass[at[starts]] = top + np.log(np.add.reduceat(parts, starts))
        score -= mass[node]
        running = np.concatenate(([0.0], np.cumsum(np.exp(score))))
        cum = running[1:] - running[first[node]]
        cum[first[1:][arcs > 0] - 1] = 2.0  # no uniform number passes a node's last arc
        t = self.tables
        nodes, before = len(t["node_arc"]) - 1, len(t["arc_id"])
        self._append({"unit_hash": hashes, "unit_node": heads + nodes, "unit_len": lengths, "unit_uses": np.zeros(len(heads), np.int32), "node_code": codes, "node_arc": first[1:] + before})
        self._append({"arc_len": length, "arc_id": ids, "arc_log": score, "arc_cum": cum})


def _uniform(keys: np.ndarray, stream: int, counter: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 for each key and counter."""
    x = mix64(keys + U64(stream * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) + counter.astype(U64) * U64(0xD1B54A32D192ED03))
    return ((x >> U64(12)).astype(np.float64) + 0.5) / (1 << 52)


def _walk(f: dict, unit: np.ndarray, base: np.ndarray, keys: np.ndarray, occ: np.ndarray, pos: np.ndarray, stream: int):
    """Sampled paths of the occurrences ``occ`` backwards from ``pos``: occurrence, position and arc of every step, in tree order."""
    at_occ, at_pos, at_arc = [], [], []
    live = pos > 0
    occ, pos = occ[live], pos[live]
    while len(occ):
        node = f["unit_node"][unit[occ]] + pos
        arc = f["node_arc"][node]
        draw = _uniform(keys[occ], stream, base[occ] + pos)
        behind = np.flatnonzero(draw >= f["arc_cum"][arc])
        while len(behind):
            arc[behind] += 1
            behind = behind[draw[behind] >= f["arc_cum"][arc[behind]]]
        at_occ.append(occ)
        at_pos.append(pos)
        at_arc.append(arc)
        pos = pos - f["arc_len"][arc]
        live = pos > 0
        occ, pos = occ[live], pos[live]
    if not at_occ:
        return (np.zeros(0, np.int64),) * 3
    o, p, a = (np.concatenate(x) for x in (at_occ, at_pos, at_arc))
    order = np.argsort(o, kind="stable")
    return o[order], p[order], a[order]


def _frontier(f: dict, unit, base, keys, occ, pos, arc, before: np.ndarray, bound: np.ndarray, stream: int) -> np.ndarray:
    """The greatest perturbed score among the other arcs of each step, truncated at ``bound``."""
    node = f["unit_node"][unit[occ]] + pos
    out = np.full(len(node), -np.inf)
    open_ = np.flatnonzero(f["node_arc"][node + 1] - f["node_arc"][node] > 1)
    occ, bound = occ[open_], np.broadcast_to(bound, len(node))[open_]
    place = before[open_] + np.log1p(-np.minimum(np.exp(f["arc_log"][arc[open_]].astype(np.float64)), 1 - 1e-16))
    noise = np.log(-np.log(_uniform(keys[occ], stream, base[occ] + pos[open_])))
    out[open_] = place - np.logaddexp(place - bound, noise)
    return out


class Samples:
    """Samples in flat arrays: ``doc`` and ``turn`` of each, its ids from ``first[i]`` to ``first[i + 1]``, and its scores."""

    __slots__ = ("doc", "turn", "first", "ids", "log_prob", "perturbed", "log_inclusion")

    def __init__(self, **columns):
        for k, v in columns.items():
            setattr(self, k, v)


def sample_chunk(lattices: Lattices, texts: list[str | None], keys: np.ndarray, samples: int) -> Samples:
    """The samples of each text in the order found.

    A path is a range of the pool of steps (occurrence of a unit, position, arc, log mass before it, frontier score beside it),
    from the end of the text to its beginning; each turn appends the paths it finds.
    """
    n = len(texts)
    codes, starts, lengths, first = cut_units(texts)
    unit = lattices.numbers(codes, starts, lengths)
    counts, f = np.diff(first), lattices.tables
    past = np.zeros(len(unit) + 1, np.int64)
    np.cumsum(lengths, out=past[1:])
    doc = np.repeat(np.arange(n), counts)
    base = past[first[1:]][doc] - past[1:] if len(unit) else unit  # characters of the text before the unit
    own = keys[doc]
    occ, pos, arc = _walk(f, unit, base, own, np.arange(len(unit)), lengths, 1)
    step = np.searchsorted(occ, first)
    sums = np.zeros(len(arc) + 1)
    np.cumsum(f["arc_log"][arc], out=sums[1:], dtype=np.float64)
    root = -np.log(-np.log(_uniform(keys, 0, np.zeros(len(keys)))))
    before = sums[:-1] - np.repeat(sums[step[:-1]], np.diff(step))
    rest = _frontier(f, unit, base, own, occ, pos, arc, before, np.repeat(root, np.diff(step)), 2)
    pool = [occ, pos, arc, before, rest]
    start, size = np.full((samples, n), -1, np.int64), np.zeros((samples, n), np.int64)
    log_prob, score = np.zeros((samples, n)), np.zeros((samples, n))
    top, place = np.full((samples, n), -np.inf), np.zeros((samples, n), np.int64)  # best frontier entry of each path
    gone: dict[int, set[int]] = {}  # arcs that a step has given to other paths

    def enter(turn: int, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, logs: np.ndarray, scores: np.ndarray) -> None:
        start[turn, docs], size[turn, docs], log_prob[turn, docs], score[turn, docs] = starts, sizes, logs, scores
        refresh(turn, docs)

    def refresh(turn: int, docs: np.ndarray) -> None:
        docs = docs[size[turn, docs] > 0]
        if not len(docs):
            return
        sizes = size[turn, docs]
        at = _ranges(start[turn, docs], sizes)
        values = pool[4][at]
        edges = np.cumsum(sizes) - sizes
        high = np.maximum.reduceat(values, edges)
        hit = np.flatnonzero(values == np.repeat(high, sizes))
        top[turn, docs], place[turn, docs] = high, at[hit[np.searchsorted(hit, edges)]]

    enter(0, np.arange(n), step[:-1], np.diff(step), np.diff(sums[step]), root)
    for turn in range(1, samples):
        from_ = top[:turn].argmax(axis=0)
        live = np.flatnonzero(top[from_, np.arange(n)] > -np.inf)
        if not len(live):
            break
        from_ = from_[live]
        i = place[from_, live]
        bound = top[from_, live]
        o, at = pool[0][i], pool[1][i]
        node = f["unit_node"][unit[o]] + at
        where = base[o] + at
        draw, again = (_uniform(keys[live], 16 * turn + stream, where) for stream in (3, 6))
        pick, left = np.empty(len(live), np.int64), np.full(len(live), -np.inf)
        for j, (step_, low, high) in enumerate(zip(i.tolist(), f["node_arc"][node].tolist(), f["node_arc"][node + 1].tolist())):
            taken = gone.setdefault(step_, set()) | {int(pool[2][step_])}
            open_ = [a for a in range(low, high) if a not in taken]
            mass = np.cumsum(np.exp(f["arc_log"][open_].astype(np.float64)))
            p = min(int(np.searchsorted(mass, draw[j] * mass[-1], side="right")), len(open_) - 1)
            pick[j] = open_[p]
            gone[step_] = taken
            if len(open_) > 1:  # what the node still has
                other = sum(math.exp(f["arc_log"][x]) for q, x in enumerate(open_) if q != p)
                left[j] = pool[3][i[j]] + math.log(max(other, 1e-300))
        pool[4][i] = -np.inf
        some = left > -np.inf
        left[some] -= np.logaddexp(left[some] - bound[some], np.log(-np.log(again[some])))
        ahead = first[live + 1] - o  # units still to walk, that of the step included
        fresh = _ranges(o, ahead)
        begin = lengths[fresh].copy()
        begin[np.cumsum(ahead) - ahead] = at - f["arc_len"][pick]
        occ, pos, arc = _walk(f, unit, base, own, fresh, begin, 16 * turn + 4)
        cut = np.searchsorted(occ, first[live]), np.searchsorted(occ, first[live + 1])
        more = cut[1] - cut[0]
        sums = np.zeros(len(arc) + 1)
        np.cumsum(f["arc_log"][arc], out=sums[1:], dtype=np.float64)
        chosen = pool[3][i] + f["arc_log"][pick].astype(np.float64)
        before = np.repeat(chosen - sums[cut[0]], more) + sums[:-1]
        rest = _frontier(f, unit, base, own, occ, pos, arc, before, np.repeat(bound, more), 16 * turn + 5)
        head = i - start[from_, live] + 1
        sizes = head + more
        starts = len(pool[0]) + np.cumsum(sizes) - sizes
        from_pool, from_walk = _ranges(start[from_, live], head), np.arange(len(occ))
        into_pool, into_walk = _ranges(starts - len(pool[0]), head), _ranges(starts - len(pool[0]) + head, more)
        for c, new in enumerate((occ, pos, arc, before, rest)):
            grown = np.full(sizes.sum(), -np.inf) if c == 4 else np.empty(sizes.sum(), pool[c].dtype)
            if c < 4:
                grown[into_pool] = pool[c][from_pool]
            grown[into_walk] = new[from_walk]
            pool[c] = np.concatenate((pool[c], grown))
        branch = starts + head - 1
        pool[2][branch], pool[4][branch] = pick, left
        for old, new in zip(i.tolist(), branch.tolist()):
            gone[new] = set(gone[old])
        enter(turn, live, starts, sizes, chosen + sums[cut[1]] - sums[cut[0]], bound)
        for earlier in range(turn):
            refresh(earlier, live[from_ == earlier])
    kappa = top.max(axis=0)
    docs, turns = np.nonzero(start.T >= 0)
    starts, sizes, logs = start[turns, docs], size[turns, docs], log_prob[turns, docs]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        inclusion = np.log(np.maximum(-np.expm1(-np.exp(np.minimum(logs - kappa[docs], 50.0))), 1e-300))
    backwards = np.repeat(starts + sizes - 1 + np.cumsum(sizes) - sizes, sizes) - np.arange(sizes.sum())
    return Samples(
        doc=docs, turn=turns + 1, first=np.concatenate(([0], np.cumsum(sizes))), ids=f["arc_id"][pool[2][backwards]], log_prob=logs, perturbed=score[turns, docs],
        log_inclusion=np.where(kappa[docs] > -np.inf, inclusion, 0.0),
    )


def spelled(found: Samples, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids with negative entries, characters without a piece, replaced by the ids of their bytes."""
    bare = found.ids < 0
    if not bare.any():
        return found.first, found.ids
    code = -found.ids[bare].astype(np.int64) - 1
    width = np.ones(len(found.ids), np.int64)
    width[bare] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    ids = np.repeat(found.ids, width)
    ids[np.repeat(bare, width)] = byte_ids[np.frombuffer("".join(map(chr, code.tolist())).encode(), np.uint8)]
    return np.concatenate(([0], np.cumsum(width)))[found.first], ids


class Speller:
    """The bytes of all ids, joined, to decode many texts at once."""

    def __init__(self, table: list[bytes]):
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.width = np.array([len(x) for x in table], np.int64)
        self.start = np.cumsum(self.width) - self.width

    def __call__(self, first: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, that were encoded into ``ids``; text i has those from ``first[i]`` to ``first[i + 1]``."""
        width = self.width[ids]
        joined = self.bytes[_ranges(self.start[ids], width)].tobytes()
        ends = np.concatenate(([0], np.cumsum(width)))[first].tolist()
        return [joined[a + 1 : b] for a, b in zip(ends[:-1], ends[1:])]  # without the leading space


def encode(
    docs: DataFrame, samples: int = 2, alpha: float = 1.0, seed: int = 7, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",), verify: bool = False, key: Column | None = None
) -> DataFrame:
    """The ``keep`` columns, ``sample`` (from 1), ``ids``, ``log_prob``, ``perturbed`` and ``log_inclusion``: a row per text and sample.

    ``key`` (a long; ``doc_id`` by default) seeds a row's draws; ``verify`` adds ``exact``: whether the ids decode to the text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(model, alpha))  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary.value)
        byte_ids, speller = np.array(vocabulary.value.byte_ids, np.int32), Speller(vocabulary.value.spelled)
        for batch, raw in text_chunks(batches, limit=CHUNK):
            null = batch.column(batch.schema.get_field_index("text")).is_null().to_numpy(zero_copy_only=False)
            row_keys = batch.column(batch.schema.get_field_index("__key")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = sample_chunk(lattices, [t.decode() for t in raw], mix64(row_keys.view(U64) + U64(seed)), samples)
            first, ids = spelled(found, byte_ids)
            rows = pa.array(found.doc)
            listed = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=pa.array(null[found.doc]))
            exact = [pa.array([x == raw[d] for x, d in zip(speller(first, ids), found.doc.tolist())], pa.bool_())] if verify else []
            scores = (pa.array(x) for x in (found.log_prob, found.perturbed, found.log_inclusion))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)).take(rows) for c in keep), pa.array(found.turn.astype(np.int32)), listed, *scores, *exact],
                names=[*keep, "sample", "ids", "log_prob", "perturbed", "log_inclusion", *["exact"] * verify],
            )

    given = docs.select(*dict.fromkeys((*keep, "text")), (docs["doc_id"] if key is None else key).cast("long").alias("__key"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return given.mapInArrow(run, ", ".join([*kinds, "sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double", *["exact boolean"] * verify]))


def decode(encoded: DataFrame, model: str = MODEL, column: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in place of them: the exact text that was encoded (null for null)."""
    table = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model, 1.0).spelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(table.value)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            listed = batch.column(at)
            first = np.concatenate(([0], np.cumsum(listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            texts = speller(first, listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            null = listed.is_null().to_pylist()
            made = pa.array([None if gone else t.decode() for gone, t in zip(null, texts)], pa.string())
            yield pa.RecordBatch.from_arrays([made if i == at else batch.column(i) for i in range(batch.num_columns)], names=[into if i == at else n for i, n in enumerate(batch.schema.names)])

    kinds = [f"`{into}` string" if f.name == column else f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema]
    return encoded.mapInArrow(run, ", ".join(kinds))
