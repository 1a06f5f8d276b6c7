"""SentencePiece encoding and decoding (6): a weighted finite-state transducer.

The normaliser (blanks to U+2581, one put before the text), the pieces and the
byte fallback are compiled into one transducer from characters to piece ids.
A text is composed with it, and the shortest path in the tropical semiring is
its encoding.  For a unigram model an arc's weight is the negative score.  For
a BPE model arcs weigh nothing, and the state also remembers the last piece: a
piece may follow another (weight 0) only where merging the two pieces'
characters by score gives just these two, else the weight is infinite; the
merges at the pieces' touching edges tell.  That leaves exactly one path of finite weight, the one that merging gives,
to each place of a text; so the search goes on from one place at a time, by the longest arc first, and takes back what
leads nowhere.

A composed text splits where no piece can cross: before a run of U+2581 and
between characters that no piece has side by side.  The parts' paths are
independent, and a worker remembers those of recent parts.

Defined results: null and empty texts have no ids; U+2581 in a text decodes to
a blank, every other text decodes to itself; repeated rows are encoded each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.catalog import register
from jobsift.llm.common import by_value, documents, whole_text
from jobsift.llm.word_ids import worker_memory

SPACE = "▁"
MAX_PARTS = 300_000
MAX_PAIRS = 500_000
INFINITE = float("inf")


class Remembered(dict):
    """What ``make`` gives for each short string, at most MAX_PARTS of them at a time."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str) -> bytes:
        made = self.make(text)
        if len(text) <= 64:
            if len(self) >= MAX_PARTS:
                self.clear()
            self[text] = made
        return made


class PieceTransducer:
    """The compiled transducer of a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules, kinds = proto.normalizer_spec, model.ModelProto.SentencePiece
        if rules.precompiled_charsmap or not rules.escape_whitespaces or rules.remove_extra_whitespaces:
            raise ValueError("only the identity normaliser that keeps white space is compiled")
        self.merges = proto.trainer_spec.model_type == 2
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        for i, p in enumerate(proto.pieces):
            self.bytes_of.append(b"")
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.pieces[p.piece] = (i, p.score)
                self.bytes_of[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == kinds.UNKNOWN:
                self.unknown = i
                self.bytes_of[i] = " ⁇ ".encode()
        self.strings = {i: s for s, (i, _) in self.pieces.items()}
        if any(SPACE in s.lstrip(SPACE) for s in self.pieces):
            raise ValueError("a piece crosses words")
        self.arcs: dict = {}  # a trie: character -> [id of the piece that ends here or -1, next characters]
        for s, (i, _) in self.pieces.items():
            node: list = [-1, self.arcs]
            for c in s:
                node = node[1].setdefault(c, [-1, {}])
            node[0] = i
        self.beside = {pair for s in self.pieces for pair in zip(s, s[1:])}
        self.follows: dict[tuple[int, int], bool] = {}
        self.grown: dict[int, tuple | None] = {}
        self.parts = Remembered(self.part)
        self.words = Remembered(lambda word: self.part(SPACE + word))
        self.cuts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def merged(self, text: str) -> list[str]:
        """What merging by score, the leftmost of equals first, makes of the characters."""
        parts = list(text)
        while True:
            best, at = -INFINITE, -1
            for k in range(len(parts) - 1):
                score = self.pieces.get(parts[k] + parts[k + 1], (0, -INFINITE))[1]
                if score > best:
                    best, at = score, k
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def spines(self, piece: int) -> tuple | None:
        """How merging builds a piece: the strings at its left and at its right edge, from the character up, with their scores.

        None if merging its characters gives something else.  The last item
        tells whether every merge scores at most as high as those before it,
        so that the edges grow in the order of the scores.
        """
        parts: list[tuple] = [(c, None, None) for c in self.strings[piece]]
        falling = True
        while len(parts) > 1:
            scores = [self.pieces.get(a[0] + b[0], (0, -INFINITE))[1] for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -INFINITE:
                return None
            k = scores.index(best)
            falling &= all(len(x[0]) == 1 or self.pieces[x[0]][1] > best for x in parts[k:k + 2])
            parts[k:k + 2] = [(parts[k][0] + parts[k + 1][0], parts[k], parts[k + 1])]
        edges = []
        for side in (1, 2):
            node, edge = parts[0], []
            while node is not None:
                edge.append((node[0], self.pieces.get(node[0], (0, -INFINITE))[1]))
                node = node[side]
            edges.append(edge[::-1])
        return edges[0], edges[1], falling

    def meets(self, last: int, piece: int) -> bool:
        """Whether no merge joins the right edge of one piece with the left edge of the next, as both grow."""
        for x in (last, piece):
            if x not in self.grown:
                self.grown[x] = self.spines(x)
        a, b = self.grown[last], self.grown[piece]
        if a is None or b is None:
            return False
        if not (a[2] and b[2]):
            return self.merged(self.strings[last] + self.strings[piece]) == [self.strings[last], self.strings[piece]]
        left, right, i, j = a[1], b[0], 0, 0
        while True:
            across = self.pieces.get(left[i][0] + right[j][0], (0, -INFINITE))[1]
            up_left = left[i + 1][1] if i + 1 < len(left) else -INFINITE
            up_right = right[j + 1][1] if j + 1 < len(right) else -INFINITE
            if across > up_left and across >= up_right:
                return False
            if up_left == up_right == -INFINITE:
                return True
            if up_left >= up_right:
                i += 1
            else:
                j += 1

    def may_follow(self, last: int, piece: int) -> bool:
        """Whether the transition from the state of ``last`` (-1: none, or bytes) by ``piece`` has finite weight."""
        known = self.follows.get((last, piece))
        if known is None:
            if len(self.follows) >= MAX_PAIRS:
                self.follows.clear()
            known = self.merged(self.strings[piece]) == [self.strings[piece]] if last < 0 else self.meets(last, piece)
            self.follows[last, piece] = known
        return known

    def only_path(self, text: str) -> list[int]:
        """Ids on the one path of finite weight of a part, where arcs weigh nothing."""
        n, arcs, follows = len(text), self.arcs, self.follows
        dead = bytearray(n + 1)
        trail: list[tuple] = []  # (place, last piece, ids up to here, arcs still to try)
        ids: list[int] = []
        i, last = 0, -1
        while i < n:
            options, next_, j = [], arcs, i
            while j < n and (node := next_.get(text[j])) is not None:
                j += 1
                next_ = node[1]
                if node[0] >= 0:
                    options.append((node[0], j))
            if not options or options[0][1] > i + 1:  # no piece of this character alone: its bytes
                options.insert(0, (-1, i + 1))
            while True:
                while options:
                    piece, j = options.pop()
                    if dead[j]:
                        continue
                    if piece < 0 or (self.may_follow(last, piece) if (known := follows.get((last, piece))) is None else known):
                        break
                else:  # nothing leads on: back to the place before
                    dead[i] = 1
                    if not trail:
                        raise AssertionError(f"no path for {text!r}")
                    i, last, size, options = trail.pop()
                    del ids[size:]
                    continue
                trail.append((i, last, len(ids), options))
                if piece < 0:
                    ids.extend([self.byte_ids.get(b, self.unknown) for b in text[i].encode()] if self.byte_ids else [self.unknown])
                else:
                    ids.append(piece)
                i, last = j, piece
                break
        return ids

    def path(self, text: str) -> list[int]:
        """Ids on the shortest path of a part."""
        if self.merges:
            return self.only_path(text)
        n, arcs = len(text), self.arcs
        weight, back = [0.0] + [INFINITE] * n, [((), -1)] * (n + 1)  # (ids of the arc, from)
        for i in range(n):
            w, next_, j, alone = weight[i], arcs, i, False
            while j < n and (node := next_.get(text[j])) is not None:
                piece, next_ = node
                j += 1
                if piece >= 0:
                    alone |= j == i + 1
                    to = w - self.pieces[self.strings[piece]][1]
                    if to < weight[j]:
                        weight[j], back[j] = to, ((piece,), i)
            if not alone:  # no piece of this character alone: its bytes
                ids = tuple(self.byte_ids.get(b, self.unknown) for b in text[i].encode()) if self.byte_ids else (self.unknown,)
                if w + 1e6 < weight[i + 1]:
                    weight[i + 1], back[i + 1] = w + 1e6, (ids, i)
        out, j = [], n
        while j:
            out.append(back[j][0])
            j = back[j][1]
        return [i for ids in reversed(out) for i in ids]

    def part(self, text: str) -> bytes:
        """Ids of a part as 32-bit little-endian bytes."""
        cut = [k for k, pair in enumerate(zip(text, text[1:]), 1) if pair not in self.beside]
        if not cut:
            return np.array(self.path(text), "<i4").tobytes()
        return b"".join([self.parts[text[a:b]] for a, b in zip([0, *cut], [*cut, len(text)], strict=True)])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as 32-bit little-endian bytes."""
        if not text:
            return b""
        if self.prefix and "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text:
            found = map(self.words.__getitem__, text.split(" "))  # one blank before each word: the common case
        else:
            found = map(self.parts.__getitem__, self.cuts.findall(self.prefix + text.replace(" ", SPACE)))
        return b"".join(found)

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def transducer(path: str) -> PieceTransducer:
    memory = worker_memory("sentencepiece")
    if ("pieces", path) not in memory:
        memory["pieces", path] = PieceTransducer(path)
    return memory["pieces", path]


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the ids of the whole text; ``decode_pieces`` is the way back."""
    path = model or default_model()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = [t.encode(x) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                yield pa.record_batch({
                    "doc_id": part.column(0),
                    "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        rows, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the text that ids stand for (null ids: empty)."""
    path = model or default_model()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array([t.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


@register("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir)).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


by_value(__name__)
