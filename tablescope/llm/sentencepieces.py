"""SentencePiece encoding as a max-plus scan over chunks, and decoding.

A segmentation is a path through a lattice whose nodes are (place, last piece).
For a unigram model an edge weighs the score of its piece.  For a BPE model it
weighs 0 if the two neighbouring pieces stay apart when their letters alone are
merged, and minus infinity if not; exactly one path is left, the result of the
merges.  So one algorithm serves both: texts longer than a chunk are cut into
chunks; every chunk yields the matrix of best weights from the pieces that may
cross its left end to those that may cross its right end; the matrices are
combined by max-plus products, which are associative; with the states at its two
ends each chunk is traced back on its own.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from sentencepiece import sentencepiece_model_pb2

from tablescope.llm.text import col, extend, lists, tidy
from tablescope.session import checkpoint

CHUNK = 32_768  # characters
SPACE = "▁"
MEMORY = 200_000  # pairs that a worker remembers
SEGMENTS = 100_000  # short segments that a worker remembers, before those of the texts at hand
NODES = 100_000  # ends of beginnings, with the pieces that may stop there, that a worker remembers
SHORT = 64  # characters of a short segment
PART_BYTES = 2 << 20  # of texts whose segments are looked for together
ROWS = 256  # whose ids are decoded together
LOWEST = -np.inf
IDS = T.ArrayType(T.IntegerType(), False)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    """The vocabulary of a model file."""

    kind: int
    pieces: list[str]
    scores: list[float]
    types: list[int]
    prefix: bool
    ids: dict[str, int] = field(init=False)
    byte_ids: list[int] = field(init=False)

    def __post_init__(self):
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        by_name = {p: i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.byte_ids = [by_name[f"<0x{b:02X}>"] for b in range(256)]
        self.longest = max(map(len, self.ids))
        letters = {c for p in self.ids for c in p}
        if not letters <= self.ids.keys():
            raise ValueError("every letter of a piece must be a piece")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece may hold word marks at its start only")
        self.breaks = "\n" not in letters

    def state(self) -> tuple:
        """What a broadcast carries."""
        return self.kind, self.pieces, self.scores, self.types, self.prefix


def read_model(path: str) -> Model:
    """Read a unigram or BPE model with byte fallback and without text normalisation."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    if kind not in (UNIGRAM, BPE) or not plain or not proto.trainer_spec.byte_fallback:
        raise ValueError("only unigram and BPE models with byte fallback and identity normalisation are supported")
    if any(p.type == USER for p in proto.pieces):
        raise ValueError("user-defined pieces are not supported")
    pieces = proto.pieces
    return Model(kind, [p.piece for p in pieces], [p.score for p in pieces], [p.type for p in pieces], norm.add_dummy_prefix)


class Encoder:
    """Paths through the lattice of one model; remembers short segments and pairs of pieces."""

    def __init__(self, model: Model):
        self.model, self.ids, self.bpe = model, model.ids, model.kind == BPE
        self.score = {p: model.scores[i] for p, i in model.ids.items()}
        self.unknown = min(self.score.values()) - 10.0
        self.pairs: dict[str | None, dict[str, bool]] = {}
        self.n_pairs = 0
        self.known: dict[str, bytes] = {}
        self.code = {p: i.to_bytes(4, sys.byteorder) for p, i in self.ids.items()}
        self.histories: dict[str, tuple | None] = {}
        self.openings = {p[:i] for p in self.ids for i in range(1, len(p) + 1)} if self.bpe else set()
        self.moves: dict[str, tuple[str, tuple]] = {}
        # the places of the last short segment: its letters, what of a piece ends there, the last piece, what may follow, the ids so far
        self.letters, self.open, self.last, self.follows, self.so_far = "", [""], [None], [{}], [b""]
        self.segments = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if model.breaks else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """The pieces of a few letters: the best adjacent pair is merged first, of equal ones the leftmost."""
        return self.merge(list(text), 0)

    def merge(self, parts: list[str], border: int) -> list[str]:
        """``merged`` from single letters; empty as soon as the letters on the two sides of a border (not 0) merge."""
        score = self.score.get
        scores = [score(a + b, LOWEST) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == LOWEST:
                break
            i = scores.index(best)
            if i < border:
                border -= 1
                if i == border:
                    return []
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], LOWEST)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], LOWEST)
        return parts

    def history(self, piece: str) -> tuple | None:
        """How a piece comes about when its letters alone are merged: the score of each step and the outer parts before it.

        The last score stands for the end; nothing if the letters merge to something else.
        """
        score, parts = self.score.get, list(piece)
        steps, first, last = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            scores = [score(a + b, LOWEST) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == LOWEST:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            steps.append(best)
            first.append(parts[0])
            last.append(parts[-1])
        self.histories[piece] = found = ([*steps, LOWEST], first, last) if len(parts) == 1 else None
        return found

    def apart(self, before: str | None, piece: str) -> bool:
        """Whether the piece may follow ``before`` (nothing at a text's start).

        The steps of both go on as in ``merge``, the higher score first and of equal
        ones the left; they stay apart if no pair across the border comes first.
        """
        if self.n_pairs >= MEMORY:
            self.pairs.clear()
            self.n_pairs = 0
        histories = self.histories
        right = histories[piece] if piece in histories else self.history(piece)
        if before is None or before not in self.ids:
            found = right is not None
        else:
            left = histories[before] if before in histories else self.history(before)
            found = left is not None and right is not None and self.stay(left, right)
        self.pairs.setdefault(before, {})[piece] = found
        self.n_pairs += 1
        return found

    def stay(self, left: tuple, right: tuple) -> bool:
        (ahead, _, ends), (behind, starts, _), score = left, right, self.score.get
        i = j = 0
        while True:
            a, b, across = ahead[i], behind[j], score(ends[i] + starts[j], LOWEST)
            if across > a and across >= b:
                return False
            if a == b == LOWEST:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def merge_paths(self, text: str, start: int, before: str | None, limit: int):
        """``paths`` of a BPE model: one piece at most ends each place, so the first that fits is it."""
        n, ids, longest, pairs = len(text), self.ids, self.model.longest, self.pairs
        value: list[float | None] = [None] * (n + 1)
        last: list[str | None] = [None] * (n + 1)
        value[start], last[start] = 0.0, before
        for j in range(start + 1, min(n, limit + longest) + 1):
            for i in range(min(j, limit) - 1, max(start, j - longest) - 1, -1):
                if value[i] is None:
                    continue
                piece = text[i:j]
                if piece in ids:
                    known = pairs.get(last[i])
                    fits = None if known is None else known.get(piece)
                    if fits is None:
                        fits = self.apart(last[i], piece)
                    if not fits:
                        continue
                elif i + 1 < j:
                    continue
                value[j], last[j] = 0.0, piece
                break
        return value, last

    def move(self, letters: str) -> tuple[str, tuple]:
        """The longest end of the letters that begins a piece, and the pieces (with lengths and ids) that stop there."""
        if len(self.moves) >= NODES:
            self.moves.clear()
        end = letters
        while end and end not in self.openings:
            end = end[1:]
        stop = [end[-k:] for k in range(1, len(end) + 1) if end[-k:] in self.ids] or [letters[-1]]
        found = self.moves[letters] = (end, tuple((len(p), p, self.code.get(p) or self.packed(self.ids_of([p]))) for p in stop))
        return found

    def beginnings(self, text: str) -> bytes:
        """The ids, as bytes of 32 bits, of a short segment's pieces, as ``merge_paths`` finds them.

        The node at a place depends on the letters before it alone, so segments
        that begin alike share their nodes; only those after the letters that the
        segment before begins with are looked for.  Of the pieces that stop at a
        place one fits.
        """
        before, state, last, follows, ids = self.letters, self.open, self.last, self.follows, self.so_far
        moves, pairs = self.moves, self.pairs
        at, most = 0, min(len(before), len(text))
        while at < most and text[at] == before[at]:
            at += 1
        del state[at + 1 :], last[at + 1 :], follows[at + 1 :], ids[at + 1 :]
        end = state[at]
        for letter in text[at:]:
            end += letter
            end, stop = moves.get(end) or self.move(end)
            for k, piece, code in stop:
                fits = follows[-k].get(piece)
                if fits or (fits is None and self.apart(last[-k], piece)):
                    break
            state.append(end)
            last.append(piece)
            follows.append(pairs.get(piece) or pairs.setdefault(piece, {}))
            ids.append(ids[-k] + code)
        self.letters = text
        return ids[-1]

    def paths(self, text: str, start: int, before: str | None, limit: int | None = None):
        """Best weights and last pieces of all places reached from ``start``, a piece having ended there.

        No piece begins at ``limit`` or later, but the last ones may reach beyond it.
        """
        n, ids, longest = len(text), self.ids, self.model.longest
        limit = n if limit is None else limit
        if self.bpe:
            return self.merge_paths(text, start, before, limit)
        value: list[float | None] = [None] * (n + 1)
        last: list[str | None] = [None] * (n + 1)
        value[start], last[start] = 0.0, before
        for j in range(start + 1, min(n, limit + longest) + 1):
            best, piece = None, None
            for i in range(max(start, j - longest), min(j, limit)):
                p = text[i:j]
                if value[i] is None or (p not in ids and j - i > 1):
                    continue
                weight = value[i] + self.score.get(p, self.unknown)
                if best is None or weight > best:
                    best, piece = weight, p
            value[j], last[j] = best, piece
        return value, last

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:  # a letter outside the vocabulary is spelt in bytes
                out += [self.model.byte_ids[b] for b in p.encode()]
            else:
                out.append(i)
        return out

    def traced(self, last: list[str | None], start: int, end: int) -> list[int]:
        pieces = []
        while end > start:
            pieces.append(last[end])
            end -= len(last[end])
        return self.ids_of(pieces[::-1])

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, np.int32).tobytes()

    def look_for(self, text: str) -> bytes:
        """The ids of a stretch at whose ends every path has a node, as bytes of 32 bits."""
        if len(text) <= SHORT and self.bpe:
            return self.beginnings(text)
        return self.packed(self.traced(self.paths(text, 0, None)[1], 0, len(text)))

    def segment(self, text: str) -> list[int]:
        return np.frombuffer(self.look_for(text), np.int32).tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of normalised texts; word marks and line breaks are ends of segments.

        New segments are looked for in order, so that those that begin alike come together.
        """
        cut = [self.segments.findall(t) for t in texts]
        every = set().union(*cut)
        if len(self.known) >= SEGMENTS:
            self.known = {s: self.known[s] for s in every if s in self.known}
        ids = self.known
        new = sorted([s for s in every if s not in ids])
        for part in new:
            ids[part] = self.look_for(part)
        out = [np.frombuffer(b"".join(map(ids.__getitem__, parts)), np.int32) for parts in cut]
        for part in new:
            if len(part) > SHORT:
                del ids[part]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def normal(self, text: str) -> str:
        return (SPACE if self.model.prefix else "") + text.replace(" ", SPACE) if text else ""


def chunk_ends(text: str, size: int) -> list[int]:
    """Ends of chunks of about ``size`` characters, before a word mark where there is one in the last quarter."""
    ends = []
    at = 0
    while len(text) - at > size:
        cut = at + size
        mark = text.rfind(SPACE, at + size * 3 // 4, cut)
        while mark > at and text[mark - 1] == SPACE:
            mark -= 1
        if mark > at + size // 2:
            cut = mark
        ends.append(cut)
        at = cut
    return [*ends, len(text)]


class Chunk:
    """A chunk with the letters around it, which crossing pieces may hold.

    A state at an end is a piece that crosses it or stops there, and by how much
    it reaches beyond.  Where no piece can cross there is one state, (None, 0).
    """

    def __init__(self, encoder: Encoder, before: str, core: str, after: str):
        self.encoder, self.text = encoder, before + core + after
        self.left, self.right = len(before), len(before) + len(core)
        inside = range(self.left, self.right + 1)
        self.first = next((p for p in inside if self.free(p)), None)
        self.last = next((p for p in reversed(inside) if self.free(p)), None)

    def free(self, at: int) -> bool:
        """Whether no piece can cross this place."""
        if at in (0, len(self.text)):
            return True
        a, b = self.text[at - 1], self.text[at]
        return (b == SPACE and a != SPACE) or (self.encoder.model.breaks and "\n" in (a, b))

    def states(self, at: int) -> list[tuple[str | None, int]]:
        if self.free(at):
            return [(None, 0)]
        longest, found = self.encoder.model.longest, []
        for i in range(max(0, at - longest), at):
            for j in range(at, min(len(self.text), i + longest) + 1):
                piece = self.text[i:j]
                if piece in self.encoder.ids or j == i + 1:
                    found.append((piece, j - at))
        return found

    def weights(self, start: int, before: str | None, limit: int, exits: list) -> np.ndarray:
        """Best weights from a place to the states at ``limit``."""
        value, last = self.encoder.paths(self.text, start, before, limit)
        out = np.full(len(exits), LOWEST)
        for j, (piece, reach) in enumerate(exits):
            at = limit + reach
            if value[at] is not None and piece in (None, last[at]):
                out[j] = value[at]
        return out

    def entered(self, limit: int, exits: list) -> np.ndarray:
        """Weights from the entry states to the states at ``limit``."""
        rows = []
        for piece, reach in self.states(self.left):
            over = self.left + reach - limit
            if over >= 0:  # the entering piece reaches as far itself
                rows.append([0.0 if e in ((piece, over), (None, over)) else LOWEST for e in exits])
            else:
                rows.append(self.weights(self.left + reach, piece, limit, exits))
        return np.array(rows).reshape(-1, len(exits))

    def matrix(self) -> np.ndarray:
        """Weights from entry to exit states; what all paths have in common is left out."""
        exits = self.states(self.right)
        if self.first is None:
            return self.entered(self.right, exits)
        start = self.entered(self.first, [(None, 0)])
        if self.free(self.right):
            return start
        return start + self.weights(self.last, None, self.right, exits)[None, :]

    def trace(self, entry: int, exit: int) -> list[int]:
        """The ids of the pieces after the entering one, up to and with the one at the exit."""
        piece, reach = self.states(self.left)[entry]
        start, end = self.left + reach, self.right + self.states(self.right)[exit][1]
        if self.first is None:
            return self.between(start, piece, self.right, end)
        ids = self.between(start, piece, self.first, self.first)
        ids = ids + self.encoder.encode(self.text[self.first : self.last])
        return ids + self.between(self.last, None, self.right, end)

    def between(self, start: int, before: str | None, limit: int, end: int) -> list[int]:
        if start >= end:
            return []
        _, last = self.encoder.paths(self.text, start, before, limit)
        return self.encoder.traced(last, start, end)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All products of the first 1, 2, ... matrices, by pairing neighbours and then filling the gaps."""
    if len(matrices) < 2:
        return matrices
    halves = prefixes([times(a, b) for a, b in zip(matrices[::2], matrices[1::2])])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(halves[i // 2] if i % 2 else times(halves[i // 2 - 1], matrices[i]))
    return out


def best_path(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The entry and exit state of each chunk on the best path of a whole text."""
    ahead = prefixes(matrices)
    at, out = 0, []
    for k in range(len(matrices) - 1, -1, -1):
        weights = matrices[k][:, at] + (ahead[k - 1][0] if k else 0.0)
        entry = int(np.argmax(weights))
        out.append((entry, at))
        at = entry
    return out[::-1]


def ids_of_long_texts(model, texts: DataFrame, size: int) -> DataFrame:
    """``key, ids`` for texts of more than one chunk; ``texts`` has ``key`` (of the text) and ``text``."""

    def chunks(batches):
        encoder = Encoder(Model(*model.value))
        around = encoder.model.longest
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text")):
                whole, at, rows = encoder.normal(text.as_py()), 0, []
                for k, end in enumerate(chunk_ends(whole, size)):
                    rows.append((key.as_py(), k, whole[max(0, at - around) : at], whole[at:end], whole[end : end + around]))
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["key", "k", "before", "core", "after"])

    def matrices(batches):
        encoder = Encoder(Model(*model.value))
        for batch in batches:
            found = [Chunk(encoder, *x).matrix() for x in zip(*(batch.column(c).to_pylist() for c in ("before", "core", "after")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("k"), pa.array([len(m) for m in found]), pa.array([m.tobytes() for m in found], pa.binary())],
                names=["key", "k", "entries", "weights"],
            )

    def states(batches):
        for batch in batches:
            for key, parts in zip(batch.column("key").to_pylist(), batch.column("parts").to_pylist()):
                found = best_path([np.frombuffer(p["weights"]).reshape(p["entries"], -1) for p in parts])
                entry, exit = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(found)), *(pa.array(x, pa.int64()) for x in (range(len(found)), entry, exit))],
                    names=["key", "k", "entry", "exit"],
                )

    def traces(batches):
        encoder = Encoder(Model(*model.value))
        for batch in batches:
            found = []
            for *around, entry, exit in zip(*(batch.column(c).to_pylist() for c in ("before", "core", "after", "entry", "exit"))):
                found.append(Chunk(encoder, *around).trace(entry, exit))
            ids = lists(np.concatenate([np.array(x, np.int32) for x in found] or [[]]), [len(x) for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), ids], names=["key", "k", "ids"])

    cut = texts.mapInArrow(tidy(chunks), "key string, k bigint, before string, core string, after string")
    cut = checkpoint(cut.dropDuplicates(["key", "k"]))  # deals the chunks out and leaves one of equal texts
    weighed = cut.mapInArrow(tidy(matrices), "key string, k bigint, entries bigint, weights binary")
    parts = weighed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "entries", "weights"))).alias("parts"))
    ends = parts.mapInArrow(tidy(states), "key string, k bigint, entry bigint, exit bigint")
    found = cut.join(ends, ["key", "k"]).mapInArrow(tidy(traces), "key string, k bigint, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("k", "ids")))
    return found.groupBy("key").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, model_file: str, text: str = "text", size: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with ``ids``, the pieces of the whole text.

    The ids equal those of the SentencePiece library for the model.  Texts of up
    to ``size`` characters are one chunk and stay where they are; the chunks of
    longer ones are dealt out to all tasks.  The model file is read once by the
    driver and sent to the tasks.

    A null or empty text has no ids.  Repeated rows stay, and equal long texts
    are encoded once.  An empty table gives no rows.  An input column ``ids`` is
    replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_file).state())

    def make():
        encoder = Encoder(Model(*model.value))

        def work(texts):
            found = encoder.encode_all([encoder.normal(t or "") for t in texts.to_pylist()])
            return [lists(np.concatenate(found) if found else [], [len(x) for x in found], pa.int32())]

        return work

    fields = [T.StructField("ids", IDS)]
    length = F.coalesce(F.char_length(col(text)), F.lit(0))
    short = extend(docs.where(length <= size), text, fields, make, keep, limit=PART_BYTES)
    kept = [c for c in docs.columns if c.lower() != "ids" and (keep is None or c in keep)]
    long = docs.where(length > size).select(*[col(c) for c in kept], col(text).alias("__llm_text"))
    key = F.sha2(F.col("__llm_text").cast("binary"), 256).alias("key")
    found = ids_of_long_texts(model, long.select(key, F.col("__llm_text").alias("text")), size)
    found = found.withColumnRenamed("key", "__llm_key")
    long = long.select(*[col(c) for c in kept], key.alias("__llm_key")).join(found, "__llm_key").drop("__llm_key")
    return short.unionByName(long)


def decode(df: DataFrame, model_file: str, ids: str = "ids", into: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` (columns ``keep``, all by default) with the text of their ids.

    A null list gives a null, an empty one an empty text.  The unknown piece, and
    an id outside the vocabulary, reads as U+2047 between blanks; bytes that are
    no UTF-8 read as U+FFFD.  A text that holds U+2581 itself comes back with
    blanks there, as in the library.  An input column named ``into`` is replaced.
    """
    model = df.sparkSession.sparkContext.broadcast(read_model(model_file).state())
    kept = [c for c in df.columns if c.lower() != into.lower() and (keep is None or c in keep)]
    source = df.select(*[col(c) for c in kept], col(ids).cast("array<int>").alias("__llm_ids"))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(into, T.StringType())])

    def run(batches):
        m = Model(*model.value)
        spelt = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[1:-1], 16)]), UNKNOWN: lambda p: " ⁇ ".encode()}
        table = np.array([spelt.get(t, lambda p: b"")(p) for p, t in zip(m.pieces, m.types)] + [" ⁇ ".encode()], object)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            lists_ = batch.columns[-1]
            out: list[str | None] = []
            for i in range(len(lists_)):
                x = lists_[i]
                if not x.is_valid:
                    out.append(None)
                    continue
                at = x.values.to_numpy(zero_copy_only=False)
                at = np.where((at >= 0) & (at < len(m.pieces)), at, len(m.pieces))
                text = b"".join(table[at].tolist()).decode("utf-8", "replace")
                out.append(text[1:] if m.prefix and text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=schema.fieldNames())

    return source.mapInArrow(tidy(run), schema)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the ids in decimal, joined by blanks."""
    return F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").cast("binary"), 256)
