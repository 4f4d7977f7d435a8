"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

The lattice of a text has a node at every place and an arc for every vocabulary piece that stands there; a
character without a piece of its own is spelled by byte pieces.  A piece's weight follows its rank by a Zipf
law (the vocabulary's own scores are merge ranks), raised to the power ``alpha``.  Backward sums over the
lattice give each arc its probability given its start, so a segmentation's probability is the product along
its path.

Perturbed A-star search: the open regions of a text are "this path up to a place, then none of the arcs taken
there so far".  A region's priority is the Gumbel value of the best segmentation inside, drawn from its mass and
cut off at its parent's value; the search takes the best region, draws that segmentation, and splits the rest.
What comes out, in order, are the k segmentations of the largest perturbed log-probability: a sample without
replacement.  All draws are hashes of the row key, so a row's result depends on nothing else.

A space becomes U+2581 with one more in front of the text; a U+2581 of the text itself is spelled in bytes, so
every text decodes to itself.  Null counts as empty; an empty text has one segmentation, without pieces; a
text with fewer than k segmentations gives all of them, each with inclusion score 1.  Rows that share a key and
a text get equal samples; a null key counts as 0; texts are encoded whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import docs_of, map_slices, mix, table, texts

SAMPLES, ALPHA, SEED = 4, 0.3, 7
_SPACE = b"\xe2\x96\x81"
#: Bytes that no UTF-8 text has stand for the bytes of a literal U+2581.
_LITERAL = b"\xf8\xf9\xfa"
#: More than a uniform draw of 53 bits can add to a region's log mass.
_MOST = 38.0
_ALL = 2**64 - 1


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id (None: not for text) and the first byte piece's id."""

    pieces: tuple[bytes | None, ...]
    byte_base: int

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        """Read a SentencePiece model with byte fallback; the public 32k model by default."""
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: list[bytes | None] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            special = sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
            # a piece with a space mark after a letter would tie neighbouring words together; public vocabularies have none
            pieces.append(None if special or "▁" in piece.lstrip("▁") else piece.encode())
        base = next(i for i in range(sp.get_piece_size()) if sp.is_byte(i))
        return cls(tuple(pieces), base)


class Trie:
    """Byte trie of the vocabulary in arrays, weights and spellings of the pieces."""

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for i, piece in enumerate(vocabulary.pieces):
            if piece is None:
                continue
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = i
        inner = [n for n, c in enumerate(children) if c]
        row = np.full(len(children), len(inner), np.int32)
        row[inner] = np.arange(len(inner))
        self.next = np.full((len(inner) + 1, 256), -1, np.int32)
        for n in inner:
            for b, m in children[n].items():
                self.next[row[n], b] = m
        # where a node's 256 followers stand
        self.next, row = self.next.ravel(), row.astype(np.int64) * 256
        self.row, self.ends, self.base = row, np.array(ends, np.int32), vocabulary.byte_base
        n = len(vocabulary.pieces)
        rank = np.full(n, n, float)
        normal = [i for i, p in enumerate(vocabulary.pieces) if p is not None]
        rank[normal] = np.arange(len(normal))
        weight = -np.log(rank + 2.7)
        self.weight = alpha * (weight - np.log(np.exp(weight[normal]).sum()))
        spelled = [p or b"" for p in vocabulary.pieces]
        spelled[self.base : self.base + 256] = [bytes([b]) for b in range(256)]
        # decoding: the space mark becomes a space; bytes of a literal mark are byte pieces and stay
        spelled = [p.replace(_SPACE, b" ") for p in spelled]
        self.spell = np.array(spelled, object)


@lru_cache(maxsize=2)
def _trie(vocabulary: Vocabulary, alpha: float) -> Trie:
    return Trie(vocabulary, alpha)


class Lattice:
    """Lattices of distinct units: arcs in order of their start, with conditional probabilities.

    A node is a place in a unit.  Nodes are numbered by their distance from the unit's end, longer units first
    within a distance, so that backward sums run over whole stretches of arcs; nodes below ``n_units`` are ends.
    """

    def __init__(self, units: list[bytes], trie: Trie):
        size = np.array([len(u) for u in units], np.int64)
        self.n_units = len(units)
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(units), np.int64)
        rank[order] = np.arange(len(units))
        longest = int(size.max())
        # base[r]: the first node at distance r
        base = np.concatenate([[0], np.cumsum(np.cumsum(np.bincount(size, minlength=longest + 1)[::-1])[::-1])])
        self.first_node = base[size] + rank
        # the extra byte at a unit's end matches nothing
        text = np.frombuffer(b"\xff".join(units) + b"\xff", np.uint8)
        end = np.repeat(np.cumsum(size + 1) - 1, size + 1)
        places = np.arange(len(text))
        node_of = (base[end - places] + np.repeat(rank, size + 1)).astype(np.int32)
        place = np.flatnonzero(((text & 0xC0) != 0x80) & (text < 0xF8))
        batches = []
        node, start = np.zeros(len(place), np.int32), place
        single = np.zeros(len(text), bool)
        width = _WIDTH[text]
        depth = 0
        while len(start):
            node = trie.next[trie.row[node] + text[start + depth]]
            keep = np.flatnonzero(node >= 0)
            node, start, depth = node[keep], start[keep], depth + 1
            piece = trie.ends[node]
            done = np.flatnonzero(piece >= 0)
            whole = start[done]
            batches.append((node_of[whole], node_of[whole + depth], piece[done]))
            if depth <= 4:
                single[whole[width[whole] == depth]] = True
        # spelled out: all bytes of a character without a piece, bytes of no character, and those of a literal mark
        lead = np.zeros(len(text), np.int64)
        lead[place] = place
        lead = np.maximum.accumulate(lead)
        raw = np.flatnonzero((~single[lead] | (places - lead >= width[lead]) | (text >= 0xF8)) & (places < end))
        value = np.where(text[raw] >= 0xF8, np.array([0xE2, 0x96, 0x81])[np.clip(text[raw].astype(int) - 0xF8, 0, 2)], text[raw])
        batches.append((node_of[raw], node_of[raw + 1], (trie.base + value).astype(np.int32)))
        # arcs in order of their start: each batch has a start once at most, so counting places them
        held = np.zeros(len(text), np.int32)
        for own, _, _ in batches:
            held[own] += 1
        self.first_arc = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
        self.last_arc = self.first_arc[1:] - np.int32(1)
        n, filled = int(self.first_arc[-1]), self.first_arc[:-1].copy()
        self.stop, self.piece = np.empty(n, np.int32), np.empty(n, np.int32)
        for own, to, piece in batches:
            slot = filled[own]
            self.stop[slot], self.piece[slot] = to, piece
            filled[own] = slot + 1
        # backward sums, all units at once by distance from their end
        beta = np.full(len(text), -np.inf)
        beta[: self.n_units] = 0
        self.logp = trie.weight[self.piece]
        for r in range(1, longest + 1):
            low, high = int(base[r]), int(base[r + 1])
            nodes = np.flatnonzero(held[low:high]) + low
            a, b = int(self.first_arc[low]), int(self.first_arc[high])
            if a == b:
                continue
            value, new, counts = self.logp[a:b] + beta[self.stop[a:b]], self.first_arc[nodes] - a, held[nodes]
            top = np.maximum.reduceat(value, new)
            beta[nodes] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), new))
            self.logp[a:b] = value - np.repeat(beta[nodes], counts)
        sums = np.concatenate([[0.0], np.cumsum(np.exp(self.logp))])
        # probability of a node's arcs before each: 0 for the first one
        self.before = sums[:-1] - np.repeat(sums[self.first_arc[:-1]], held)

    def node(self, arc: int) -> int:
        """The node that an arc starts from."""
        return int(np.searchsorted(self.first_arc, np.int32(arc), side="right")) - 1

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path from each node to its unit's end: the arcs in order, and the number of arcs of each walk."""
        count = np.zeros(len(nodes), np.int32)
        live = np.flatnonzero(nodes >= self.n_units).astype(np.int32)
        at, seed = nodes[live], seeds[live]
        steps = []
        while len(live):
            z = seed + np.uint64(len(steps) * 0xD1342543DE82EF95 & _ALL)
            z ^= seed >> np.uint64(32)
            z ^= z >> np.uint64(29)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z >>= np.uint64(11)
            u = z.view(np.int64) * 2.0**-53
            # from the last arc down: longer pieces, which stand last, are drawn most
            arc = self.last_arc[at]
            more = np.flatnonzero(u < self.before[arc])
            while len(more):
                arc[more] -= 1
                more = more[u[more] < self.before[arc[more]]]
            steps.append((live, arc))
            at = self.stop[arc]
            on = at >= self.n_units
            count[live[np.flatnonzero(~on)]] = len(steps)
            on = np.flatnonzero(on)
            live, at, seed = live[on], at[on], seed[on]
        offset = np.concatenate([[0], np.cumsum(count)])
        arcs = np.empty(offset[-1], np.int32)
        for k, (who, arc) in enumerate(steps):
            arcs[offset[who] + k] = arc
        return arcs, count


#: Bytes of the character that a byte begins.
_WIDTH = np.array([1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], np.int8)


def _mix(z: int) -> int:
    """``mix`` of one number."""
    z = (z + 0x9E3779B97F4A7C15) & _ALL
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _ALL
    return z ^ (z >> 31)


def _uniform(z: int) -> float:
    return ((z >> 11) + 0.5) * 2.0**-53


def _gumbel(u: float) -> float:
    return -math.log(-math.log(u))


def _below(limit: float, free: float) -> float:
    """A Gumbel value cut off at ``limit``, from one that isn't."""
    low, high = (limit, free) if limit < free else (free, limit)
    return low - math.log1p(math.exp(low - high))


class _Search:
    """The open regions of one text."""

    def __init__(self, key: int, lattice: Lattice | None):
        self.key, self.lattice, self.paths, self.regions, self.draws = key, lattice, [], [], 0
        self.top = _gumbel(_uniform(_mix(key ^ 1)))

    def add(self, arcs: np.ndarray, opened: int, value: float) -> None:
        """A drawn path, with regions from its place ``opened`` on, each below ``value``."""
        self.paths.append((arcs, value))
        n, m, lattice = len(arcs), min(len(arcs), opened + 192), self.lattice
        while n > opened:
            near = arcs[:m]
            ahead = np.cumsum(lattice.logp[near])
            ahead[1:] = ahead[:-1]
            ahead[0] = 0
            # mass of all other arcs at an arc's start; what rounding leaves of none counts as none
            others = -np.expm1(lattice.logp[near[opened:]])
            at = np.flatnonzero(others > 1e-12)
            best = -np.inf
            if len(at):
                mass, at = np.log(others[at]), at + opened
                mass += ahead[at]
                salt = np.uint64(_mix(self.key ^ len(self.paths) << 48))
                z = mix((at.astype(np.uint64) << np.uint64(20)) ^ salt)
                u = ((z >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
                g = -np.logaddexp(-value, np.log(-np.log(u)) - mass)
                k = int(g.argmax())
                best = float(g[k])
            # what lies further on has less mass than the last place here, and a draw adds less than _MOST
            if m == n or best > ahead[-1] + _MOST:
                if best > -np.inf:
                    self.regions.append([best, k, g, at, ahead, arcs, {}])
                return
            m = min(n, 4 * m)

    def best(self) -> float:
        return max((r[0] for r in self.regions), default=-math.inf)

    def take(self) -> tuple[np.ndarray, int, float]:
        """Split the best region: the new path up to and with its new arc, the place after it, and its value."""
        region = max(self.regions, key=lambda r: r[0])
        value, k, g, at, ahead, arcs, taken = region
        place, lattice = int(at[k]), self.lattice
        node = lattice.node(arcs[place])
        gone = taken.setdefault(place, [int(arcs[place])])
        free = [a for a in range(int(lattice.first_arc[node]), int(lattice.first_arc[node + 1])) if a not in gone and lattice.logp[a] > -np.inf]
        p = [math.exp(lattice.logp[a]) for a in free]
        self.draws += 1
        salt = _mix(self.key ^ self.draws * 0xA0761D6478BD642F & _ALL)
        u, pick = _uniform(salt) * sum(p), len(free) - 1
        for i, x in enumerate(p):
            u -= x
            if u < 0:
                pick = i
                break
        gone.append(free[pick])
        left = sum(x for i, x in enumerate(p) if i != pick)
        g[k] = _below(value, float(ahead[place]) + math.log(left) + _gumbel(_uniform(_mix(salt)))) if left > 0 else -np.inf
        region[1] = int(g.argmax())
        region[0] = float(g[region[1]])
        return np.append(arcs[:place], np.int32(free[pick])), place + 1, value


def units(rows: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct units, the unit at each place of all texts, and where each text's units start.

    A unit is a run of space marks and the word after it, or a line feed, or what follows one: no piece reaches beyond it.
    """
    marked = [(b" " + _SPACE + t.replace(_SPACE, _LITERAL).replace(b" ", b" " + _SPACE)).replace(_SPACE + b" ", _SPACE).replace(b"\n", b" \n ") if t else b"" for t in rows]
    lists = pc.split_pattern(pa.array(marked, pa.large_binary()), pattern=" ")
    full = pc.greater(pc.binary_length(lists.flatten()), 0)
    starts = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int64)
    coded = lists.flatten().filter(full).dictionary_encode()
    _, where, data = coded.dictionary.buffers()
    cuts, held = np.frombuffer(where, np.int64)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes() if data is not None else b""
    return [held[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts


def sample(rows: list[bytes], keys: np.ndarray, trie: Trie, k: int) -> tuple[Lattice | None, list[_Search]]:
    """Up to k distinct segmentations of each text, as paths of arcs, best perturbed value first."""
    names, occurrence, begins = units(rows)
    lattice = Lattice(names, trie) if names else None
    searches = [_Search(int(key), lattice) for key in keys]
    own = np.arange(len(occurrence)) - np.repeat(begins[:-1], np.diff(begins))
    todo = [(d, int(begins[d]), None, 0, s.top) for d, s in enumerate(searches)]
    for s in range(k):
        if lattice is not None and todo:
            # walk on from where each text's new path stands: the rest of a unit, then all later units
            lengths = np.array([begins[t[0] + 1] - t[1] for t in todo])
            firsts = np.concatenate([[0], np.cumsum(lengths)])
            where = np.arange(firsts[-1]) + np.repeat(np.array([t[1] for t in todo]) - firsts[:-1], lengths)
            unit = occurrence[where]
            nodes = lattice.first_node[unit]
            for first, length, (_, _, head, _, _) in zip(firsts.tolist(), lengths.tolist(), todo, strict=False):
                if head is not None and length:
                    nodes[first] = lattice.stop[head[-1]]
            with np.errstate(over="ignore"):
                seed = mix(np.array([searches[t[0]].key for t in todo], np.uint64) + np.uint64(s * 2 + 11))
                seeds = mix(np.repeat(seed, lengths) + own[where].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            arcs, count = lattice.walk(nodes, seeds)
            cuts = np.concatenate([[0], np.cumsum(count)])[firsts].tolist()
        for i, (d, _, head, opened, value) in enumerate(todo):
            tail = arcs[cuts[i] : cuts[i + 1]] if lattice is not None else np.zeros(0, np.int32)
            searches[d].add(tail if head is None else np.concatenate([head, tail]), opened, value)
        todo = []
        if s + 1 < k:
            for d, search in enumerate(searches):
                if search.best() > -math.inf:
                    head, opened, value = search.take()
                    # the new arc lies in the unit after all those that the arcs before it close
                    todo.append((d, int(begins[d]) + int((lattice.stop[head[:-1]] < lattice.n_units).sum()), head, opened, value))
    return lattice, searches


def decode(ids: np.ndarray, trie: Trie) -> bytes:
    """The text of a sequence of piece ids."""
    return b"".join(trie.spell[ids].tolist())[1:]


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, with_ids: bool = False, slice_bytes: int = 3_000_000) -> DataFrame:
    """Rows (doc_id, rank, n_pieces, log_prob, perturbed, log_inclusion, ids_sha256, round_trip[, ids]) for docs (doc_id, text).

    ``perturbed`` is the Gumbel-perturbed log-probability.  ``log_inclusion`` is the logarithm of the probability
    that the segmentation is among those above the next perturbed value.  ``ids_sha256`` is of the ids as
    little-endian 32-bit integers; ``round_trip`` says that they decode to the text.  ``slice_bytes`` of text share
    one lattice: more make fewer distinct units a word, and take some 100 bytes of memory each.
    """
    vocabulary = vocabulary or Vocabulary.load()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        trie = _trie(vocabulary, alpha)
        rows = texts(part.column("text"))
        ids = part.column("doc_id").to_pylist()
        keys = mix(np.array([(x or 0) & (2**64 - 1) for x in ids], np.uint64) ^ mix(seed))
        lattice, searches = sample(rows, keys, trie, k)
        out: dict[str, list] = {c: [] for c in ("doc_id", "rank", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_sha256", "round_trip", *["ids"] * with_ids)}
        for doc, text, search in zip(ids, rows, searches, strict=True):
            cut = search.best() if len(search.paths) == k else -np.inf
            for rank, (arcs, value) in enumerate(search.paths, 1):
                pieces = lattice.piece[arcs] if lattice is not None else np.zeros(0, np.int32)
                logp = float(lattice.logp[arcs].sum()) if len(arcs) else 0.0
                x = min(logp - cut, 700.0)
                out["doc_id"].append(doc)
                out["rank"].append(rank)
                out["n_pieces"].append(len(arcs))
                out["log_prob"].append(logp)
                out["perturbed"].append(value)
                out["log_inclusion"].append(x if x < -30 else float(np.log(-np.expm1(-np.exp(x)))))
                out["ids_sha256"].append(hashlib.sha256(pieces.astype("<i4").tobytes()).hexdigest())
                out["round_trip"].append(decode(pieces, trie) == text)
                if with_ids:
                    out["ids"].append(pieces)
        kinds = {"doc_id": pa.int64(), "rank": pa.int32(), "n_pieces": pa.int64(), "log_prob": pa.float64(), "perturbed": pa.float64(), "log_inclusion": pa.float64(), "ids_sha256": pa.string(), "round_trip": pa.bool_(), "ids": pa.list_(pa.int32())}
        return pa.record_batch({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return map_slices(docs, run, "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids, most=slice_bytes)


def decoded(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, rank and text of rows (doc_id, rank, ids)."""
    vocabulary = vocabulary or Vocabulary.load()

    def run(batches):
        trie = _trie(vocabulary, ALPHA)
        for batch in batches:
            spelled = [decode(np.array(x or [], np.int64), trie).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "rank": batch.column("rank"), "text": pa.array(spelled, pa.string())})

    return encoded.select("doc_id", "rank", "ids").mapInArrow(run, "doc_id long, rank int, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(docs_of(table(spark, sf_dir, "documents")))
