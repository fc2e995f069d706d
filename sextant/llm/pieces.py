"""N-best SentencePiece segmentation.

A text is written with a mark before every word in place of spaces, and cut
into pieces of a fixed vocabulary so that the sum of the pieces' scores is
greatest.  Pieces never reach over a mark, so the lattice of a text is the
chain of the lattices of its words.  All different words of a batch get their
Viterbi scores at once in numpy, forward and backward; these give each word's
best segmentation and how much its second best costs.  The n best
segmentations of a text can only differ from the best in the n - 1 words where
that costs least; a backward A* search over the lattice of those words, with
the forward Viterbi scores as exact heuristics, finds them in order.

Characters that no piece covers are written as their UTF-8 bytes, so decoding
gives back every text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sextant.functions.tables import spread

from .arrow import map_batches
from .hashing import mix
from .staging import load

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Scores at or below this mark pieces that a model never uses.
UNUSED = -1e8
#: An unknown character scores this much less than the least piece.
PENALTY = 10.0
#: Words of more characters go through the lattice one by one.
LONG = 48
#: Words remembered from one batch of texts to the next.
REMEMBERED = 100_000
#: Texts encoded together.
TEXTS = 512


@dataclass
class Vocabulary:
    """Pieces and scores of a model; what is derived from them is built in each task."""

    pieces: list[str]
    scores: list[float]
    first_byte: int
    usable: list[bool]
    ids: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.usable[i] and self.scores[i] > UNUSED and MARK not in p[1:]}
        least = min(self.scores[i] for i in self.ids.values())
        self.unknown = least - PENALTY
        if MARK in self.pieces and MARK not in self.ids:
            # A mark alone can always be written, even if the model only wants it merged.
            self.ids[MARK] = self.pieces.index(MARK)
            self.scores[self.ids[MARK]] = least
        self.longest = max(map(len, self.ids))
        self.score = np.array([*self.scores, self.unknown])
        self.byte_range = range(self.first_byte, self.first_byte + 256)
        # All pieces and their beginnings in an open hash table.
        prefixes = {p[:n]: -1 for p in self.ids for n in range(1, len(p) + 1)} | self.ids
        size = 1 << (8 * len(prefixes)).bit_length()
        self.keys, self.values, self.low = np.zeros(size, np.uint64), np.full(size, -2, np.int32), np.uint64(size - 1)
        for p, i in prefixes.items():
            h = np.uint64(0)
            for c in p:
                h = np.uint64((int(h) * 0x9E3779B97F4A7C15 + ord(c) + 1) % (1 << 64))
            h = mix(np.array([h]))[0] | np.uint64(1)
            at = int(h & self.low)
            while self.keys[at]:
                at = (at + 1) % size
            self.keys[at], self.values[at] = h, i

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1: only begins pieces, -2: doesn't."""
        h = mix(hashes) | np.uint64(1)
        at = (h & self.low).astype(np.int64)
        out = np.full(len(h), -2, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            key = self.keys[at[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[(key != 0) & ~hit]
            at[todo] = (at[todo] + 1) & int(self.low)
        return out


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a SentencePiece model file on the driver; a vocabulary is of bounded size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
    first = next(i for i in range(n) if model.is_byte(i))
    return Vocabulary([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], first, plain)


class Lattice:
    """The lattice of one word with its forward Viterbi scores; its edges are numbers in flat lists, by end and start."""

    def __init__(self, word: str, vocabulary: Vocabulary):
        n = len(word)
        self.word, self.size = word, n
        ends, self.starts, self.pieces, self.scores = self._few(word, vocabulary) if n <= LONG else self._many(word, vocabulary)
        self.ends = ends
        self.first = [bisect_left(ends, at) for at in range(n + 2)]  # of the edges into each place
        forward, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for edge, (start, end, score) in enumerate(zip(self.starts, self.ends, self.scores, strict=True)):
            if forward[start] + score > forward[end]:
                forward[end], back[end] = forward[start] + score, edge
        self.forward, self.back = forward, back

    @staticmethod
    def _few(word: str, vocabulary: Vocabulary) -> tuple:
        """Ends, starts, pieces and scores of the edges, piece by piece."""
        ids, n, edges = vocabulary.ids, len(word), []
        for i in range(n):
            # A mark that stands in the text is no word's beginning.
            plain, known = i == 0 or word[i] != MARK, False
            for end in range(i + 1, min(n, i + vocabulary.longest) + 1) if plain else ():
                piece = ids.get(word[i:end])
                if piece is not None:
                    edges.append((end, i, piece, vocabulary.scores[piece]))
                    known = known or end == i + 1
            if not known:
                edges.append((i + 1, i, -1, vocabulary.unknown))
        return tuple(zip(*sorted(edges), strict=True)) or ((), (), (), ())

    @staticmethod
    def _many(word: str, vocabulary: Vocabulary) -> tuple:
        """The same for long words, length by length; views give Python numbers but hold a few bytes an edge."""
        n = len(word)
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        alive = np.flatnonzero((np.arange(n) == 0) | (codes != ord(MARK)))
        h, known, found = np.zeros(len(alive), np.uint64), np.zeros(n, bool), []
        for length in range(1, min(n, vocabulary.longest) + 1):
            fits = alive + length <= n
            alive, h = alive[fits], h[fits]
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[alive + length - 1] + np.uint64(1)
            piece = vocabulary.find(h)
            hit = piece >= 0
            if length == 1:
                known[alive[hit]] = True
            found.append((alive[hit] + length, alive[hit], piece[hit]))
            alive, h = alive[piece > -2], h[piece > -2]
        rest = np.flatnonzero(~known)  # -1: unknown
        ends, starts, pieces = (np.concatenate(x) for x in zip(*found, (rest + 1, rest, np.full(len(rest), -1)), strict=True))
        order = np.lexsort((starts, ends))
        pieces = pieces[order]
        return *(memoryview(x.astype(np.int32)) for x in (ends[order], starts[order], pieces)), memoryview(vocabulary.score[pieces])

    def path(self) -> list[int]:
        """Edges of the best segmentation, in order."""
        out, at = [], self.size
        while at:
            out.append(self.back[at])
            at = self.starts[out[-1]]
        return out[::-1]

    def best(self) -> list[tuple[int, int]]:
        """(start, piece) of the best segmentation, in order."""
        return [(self.starts[e], self.pieces[e]) for e in self.path()]

    def second(self) -> float:
        """Score of the second best segmentation, -inf if there is one only."""
        backward, on, most = [-np.inf] * self.size + [0.0], set(self.path()), -np.inf
        for edge in range(len(self.ends) - 1, -1, -1):
            start, after = self.starts[edge], self.scores[edge] + backward[self.ends[edge]]
            backward[start] = max(backward[start], after)
            if edge not in on:
                most = max(most, self.forward[start] + after)
        return most


def n_best(lattices: list[Lattice], n: int) -> list[tuple[float, list[list[tuple[int, int]]]]]:
    """The n best segmentations of a chain of words, best first, as (score, (start, piece) of each word).

    Backward A*: a state is a place in the chain with the pieces behind it; its
    forward score is exactly what the rest can still gain.  So every state is
    the beginning of a segmentation of just its score, and states after the n
    first are never needed.  Of equal scores the latest state goes on, so ties
    cost one step a piece.
    """
    before = np.concatenate(([0.0], np.cumsum([x.forward[-1] for x in lattices]))).tolist()
    out: list = []
    tick = 0
    states: list = [(-before[-1], 0, 0.0, len(lattices) - 1, lattices[-1].size if lattices else 0, None)]
    while states and len(out) < n:
        f, _, behind, k, at, pieces = states.pop(0)
        while k >= 0 and at == 0:
            k -= 1
            at = lattices[k].size if k >= 0 else 0
        if k < 0:
            path: list[list[tuple[int, int]]] = [[] for _ in lattices]
            while pieces:
                word, start, piece, pieces = pieces
                path[word].append((start, piece))
            out.append((-f, path))
            continue
        lattice, room, base = lattices[k], n - len(out), behind + before[k]
        low, high = lattice.first[at], lattice.first[at + 1]
        worst = -states[-1][0] if len(states) >= room else -np.inf
        for edge, (start, score) in enumerate(zip(lattice.starts[low:high], lattice.scores[low:high], strict=True), low):
            tick -= 1
            total = base + score + lattice.forward[start]
            if total >= worst:
                insort(states, (-total, tick, behind + score, k, start, (k, start, lattice.pieces[edge], pieces)))
                del states[room:]
                worst = -states[-1][0] if len(states) >= room else -np.inf
    return out


def spelled(path: list[tuple[int, int]], word: str, vocabulary: Vocabulary) -> list[int]:
    """Piece numbers of a segmentation; unknown characters become bytes."""
    out: list[int] = []
    for start, piece in path:
        out += [piece] if piece >= 0 else [vocabulary.first_byte + b for b in word[start].encode("utf-8", "replace")]
    return out


def packed(ids: list[int]) -> bytes:
    """Piece numbers as 4 bytes each, least first."""
    return np.array(ids, "<i4").tobytes()


def viterbi(words: list[str], vocabulary: Vocabulary) -> tuple[list[bytes], np.ndarray, np.ndarray, dict[str, Lattice]]:
    """(packed piece numbers, score, cost of the second best) of each word, and the lattices of long words."""
    ids: list = [None] * len(words)
    best, cost = np.zeros(len(words)), np.full(len(words), np.inf)
    by_size: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_size.setdefault(len(w) if len(w) <= LONG and MARK not in w[1:] else 0, []).append(k)
    lattices = {}
    for k in by_size.pop(0, []):
        lattice = lattices[words[k]] = Lattice(words[k], vocabulary)
        best[k] = lattice.forward[-1]
        cost[k] = best[k] - lattice.second()
        ids[k] = packed(spelled(lattice.best(), words[k], vocabulary))
    for size, members in by_size.items():
        codes = np.frombuffer("".join(words[k] for k in members).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(members), size).astype(np.uint64)
        rows, n = np.arange(len(members)), len(members)
        forward, back, piece_at = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int64), np.zeros((size + 1, n), np.int32)
        forward[0] = 0
        edges = []
        for i in range(size):
            alive, h = rows, np.zeros(n, np.uint64)
            for end in range(i + 1, min(size, i + vocabulary.longest) + 1):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[alive, end - 1] + np.uint64(1)
                piece = vocabulary.find(h)
                if end == i + 1:
                    own, code = rows, codes[:, i].astype(np.int64)
                    number = np.where(piece >= 0, piece, np.where(code < 128, vocabulary.first_byte + code, -1))
                    score = vocabulary.score[np.maximum(piece, -1)]
                else:
                    own, number = alive[piece >= 0], piece[piece >= 0]
                    score = vocabulary.score[number]
                edges.append((i, end, own, score))
                total = forward[i, own] + score
                better = total > forward[end, own]
                at = own[better]
                forward[end, at], back[end, at], piece_at[end, at] = total[better], i, number[better]
                more = piece > -2
                alive, h = alive[more], h[more]
                if not len(alive):
                    break
        backward = np.full((size + 1, n), -np.inf)
        backward[size] = 0
        for i, end, own, score in reversed(edges):
            backward[i, own] = np.maximum(backward[i, own], score + backward[end, own])
        # The best path, from the end.
        goes, steps, at = np.zeros((size + 1, n), np.int64), [], np.full(n, size)
        while (some := np.flatnonzero(at)).size:
            start, piece = back[at[some], some], piece_at[at[some], some]
            goes[start, some] = at[some]
            steps.append((some, start, piece))
            at[some] = start
        second = np.full(n, -np.inf)
        for i, end, own, score in edges:
            off = goes[i, own] != end
            other = own[off]
            second[other] = np.maximum(second[other], forward[i, other] + score[off] + backward[end, other])
        best[members] = forward[size]
        cost[members] = forward[size] - second
        table = np.full((2, n, len(steps)), -2)
        for t, (some, start, piece) in enumerate(reversed(steps)):
            table[:, some, t] = start, piece
        used = table[1] != -2
        flat = table[1][used].astype("<i4").tobytes()
        bounds = 4 * np.concatenate(([0], np.cumsum(used.sum(1))))
        odd = (table[1] == -1).any(1)
        for k, a, b in zip(members, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            ids[k] = flat[a:b]
        for r in np.flatnonzero(odd):
            path = [(int(a), int(b)) for a, b in table[:, r, used[r]].T]
            ids[members[r]] = packed(spelled(path, words[members[r]], vocabulary))
    return ids, best, cost, lattices


def words_of(text: str) -> list[str]:
    return [MARK + w for w in text.split(" ")] if text else []


def spellings(vocabulary: Vocabulary) -> list[bytes]:
    """The bytes that each piece stands for."""
    return [bytes([i - vocabulary.first_byte]) if i in vocabulary.byte_range else p.replace(MARK, " ").encode() for i, p in enumerate(vocabulary.pieces)]


def decode(ids: list[int], spelling: list[bytes]) -> str:
    """The text of a sequence of piece numbers."""
    return b"".join([spelling[i] for i in ids]).decode("utf-8", "replace")[1:]


class Encoder:
    """Encodes batches of texts; remembers words from batch to batch."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.vocabulary, self.n = vocabulary, n
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.words: list[str] = []
        self.ids: list[bytes] = []
        self.best, self.cost = np.zeros(0), np.zeros(0)
        self.lattices: dict[int, Lattice] = {}

    def lattice(self, k: int) -> Lattice:
        if k not in self.lattices:
            self.lattices[k] = Lattice(self.words[k], self.vocabulary)
        return self.lattices[k]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, float, list[tuple[float, list[tuple[int, list[int]]]]]]]:
        """(packed piece numbers, score, alternatives) of each text; an alternative: score, (word, piece numbers) of what differs."""
        if len(self.index) > REMEMBERED:
            self.forget()
        index, split = self.index, [words_of(t) for t in texts]
        before = len(index)
        places = [[index.setdefault(w, len(index)) for w in ws] for ws in split]
        fresh = list(index)[before:]
        if fresh:
            ids, best, cost, long = viterbi(fresh, self.vocabulary)
            self.lattices |= {index[w]: lattice for w, lattice in long.items()}
            self.words += fresh
            self.ids += ids
            self.best, self.cost = np.concatenate((self.best, best)), np.concatenate((self.cost, cost))
        for place in places:
            at = np.array(place, np.int64)
            ids = b"".join([self.ids[k] for k in place])
            score = float(self.best[at].sum())
            yield ids, score, self.alternatives(at, score)

    def alternatives(self, at: np.ndarray, score: float) -> list[tuple[float, list[tuple[int, list[int]]]]]:
        cost = self.cost[at]
        few = np.sort(np.argsort(cost, kind="stable")[: self.n - 1])
        few = few[np.isfinite(cost[few])]
        if not len(few):
            return []
        chain = [self.lattice(int(at[p])) for p in few]
        (first, own), *rest = n_best(chain, self.n)
        out = []
        for total, path in rest:
            changes = [(int(few[k]), spelled(path[k], chain[k].word, self.vocabulary)) for k in range(len(chain)) if path[k] != own[k]]
            out.append((score + float(total - first), changes))
        return out


CHANGES = "array<struct<score:double,changes:array<struct<word:int,ids:array<int>>>>>"


def encode_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    n: int = 4,
    check: bool = False,
) -> DataFrame:
    """``doc_id, ids, score, ids_sha256, alternatives``: the n best segmentations of every text.

    With ``check`` also ``decoded_sha256``, of the text that ``ids`` decode to.

    ``ids`` is the best one; each alternative, in order, has its score and, for
    the words (by position) that it cuts otherwise, their piece numbers.  The
    scores are those of the model's pieces; its pieces that join marks are
    unused.  ``ids_sha256`` is of the numbers as 4 bytes, least first.  A null
    text counts as empty; an empty text has no pieces, score 0 and no
    alternatives.  Segmentations of equal scores come in the order of the search,
    which the text alone determines.  Repeated rows give repeated results; an
    empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))  # bounded: one vocabulary
    id_type = docs.schema[id_col].dataType
    change = pa.struct([("word", pa.int32()), ("ids", pa.list_(pa.int32()))])
    alternative = pa.struct([("score", pa.float64()), ("changes", pa.list_(change))])
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("ids_sha256", pa.string()), ("alternatives", pa.list_(alternative))])

    if check:
        schema = schema.append(pa.field("decoded_sha256", pa.string()))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, spelling = Encoder(shared.value, n), spellings(shared.value)
        for batch in rows:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                found = list(encoder.encode([t or "" for t in part.column(1).to_pylist()]))
                flat = np.frombuffer(b"".join([f[0] for f in found]), "<i4")
                bounds = np.cumsum([0, *[len(f[0]) // 4 for f in found]])
                columns = [
                    part.column(0).cast(schema[0].type),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([hashlib.sha256(f[0]).hexdigest() for f in found]),
                    pa.array([[{"score": s, "changes": [{"word": w, "ids": i} for w, i in c]} for s, c in f[2]] for f in found], schema[4].type),
                ]
                if check:
                    numbers = flat.tolist()
                    texts = [decode(numbers[a:b], spelling) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    more = ", decoded_sha256 string" if check else ""
    return map_batches(docs.select(id_col, text_col), run, f"doc_id {id_type.simpleString()}, ids array<int>, score double, ids_sha256 string, alternatives {CHANGES}{more}")


def decode_pieces(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of sequences of piece numbers.

    A null sequence counts as empty, which is the empty text; repeated rows give
    repeated results; an empty table gives an empty result; other columns are ignored.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    id_type = encoded.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = spellings(shared.value)
        for batch in rows:
            texts = [decode(ids or [], spelling) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow_id), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select(id_col, ids_col), run, f"doc_id {id_type.simpleString()}, text string")


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_pieces(load(spark, sf_dir, "documents"), check=True)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "score", "alternatives", "ids_sha256", "decoded_sha256")


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    decoded = decode_pieces(encode_pieces(spread(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")))
    return decoded.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_piece_encoding": op9_piece_encoding, "piece_round_trip": piece_round_trip}
ORACLE = {"piece_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, length(coalesce(text, '')) AS n_chars FROM documents"}
