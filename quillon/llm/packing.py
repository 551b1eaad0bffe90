"""Sum-of-squares online packing of tokenised documents into windows of fixed length.

Each task packs its own rows in their order. A document longer than a window fills whole windows of its own; what is
left is one item. The item goes to the fill level, or to a new window, that leaves the sum of squared counts of
partially filled windows smallest. The counts are a level array. When a task's rows end, the fullest of the windows
that are still open leave as they are, as long as all their padding is within a share of the task's ids; the pieces of
the others are cut and joined, so that a task that has few rows leaves little padding too.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: doc_id, start, ids of the piece, doc_tokens
Piece = tuple[int, int, np.ndarray, int]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class LevelPacker:
    """Open windows by fill level. ``place`` returns (window, offset) for an item shorter than a window."""

    #: Open windows beyond which those of the commonest level are cut and joined, so that memory stays bounded. Of sizes
    #: that never fit together (all over half a window) no placement could close them.
    MOST_OPEN = 8192

    def __init__(self, size: int, first: int = 0) -> None:
        self.size, self.next = size, first
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: dict[int, list[int]] = defaultdict(list)
        self.held: dict[int, list[Piece]] = {}
        self.open = 0

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def level(self, n: int) -> int:
        """The fill level that an item of n tokens goes to; 0 is a new window. Of equals the fullest."""
        to = 2 * self.counts[n : self.size + 1] + 1
        to[-1] = 0  # a full window is no longer partially filled
        cost = to - 2 * self.counts[: self.size - n + 1] + 1
        cost[0] -= 1  # an empty window was not partially filled before
        cost[1:][self.counts[1 : self.size - n + 1] == 0] = np.iinfo(np.int64).max
        return self.size - n - int(np.argmin(cost[::-1]))

    def place(self, piece: Piece) -> tuple[int, int]:
        n = len(piece[2])
        at = self.level(n)
        if at:
            window = self.windows[at].pop()
            self.counts[at] -= 1
            self.open -= 1
        else:
            window = self.new()
        held = self.held.pop(window, [])
        if at + n < self.size:
            self.windows[at + n].append(window)
            self.counts[at + n] += 1
            self.open += 1
            self.held[window] = [*held, piece]
        return window, at

    def take(self, window: int) -> list[Piece]:
        """What an open window holds; it is open no more."""
        level = self.fill(window)
        self.windows[level].remove(window)
        self.counts[level] -= 1
        self.open -= 1
        return self.held.pop(window)

    def fill(self, window: int) -> int:
        return sum(len(p[2]) for p in self.held[window])


def pack(documents: Iterator[tuple[int, np.ndarray]], size: int, first: int = 0, padding: float = 0.02) -> Iterator[tuple[int, int, np.ndarray, int, int, int]]:
    """Pieces (doc_id, start, ids, doc_tokens, sequence_id, offset) of documents (doc_id, ids).

    Pieces of a window come out once the window is full, or at the end, when it can no longer change. The windows left
    as they are then have ``padding`` of all ids at most; beside them there is one padded window.
    """
    packer = LevelPacker(size, first)
    rows: dict[int, list[tuple[Piece, int]]] = defaultdict(list)
    seen = 0

    def joined(windows: list[int]) -> Iterator[tuple[int, int, np.ndarray, int, int, int]]:
        pieces = [p for w in windows for p in packer.take(w)]
        for w in windows:
            del rows[w]
        window, at = packer.new(), 0
        for doc, start, ids, total in pieces:
            while len(ids):
                if at == size:
                    window, at = packer.new(), 0
                part = ids[: size - at]
                yield doc, start, part, total, window, at
                start, ids, at = start + len(part), ids[len(part) :], at + len(part)

    for doc, ids in documents:
        total, whole = len(ids), len(ids) // size * size
        seen += total
        for at in range(0, whole, size):
            yield doc, at, ids[at : at + size], total, packer.new(), 0
        if total > whole:
            piece = (doc, whole, ids[whole:], total)
            window, at = packer.place(piece)
            rows[window].append((piece, at))
            if window not in packer.held:
                for p, offset in rows.pop(window):
                    yield *p, window, offset
        if packer.open > packer.MOST_OPEN:
            yield from joined(list(packer.windows[int(np.argmax(packer.counts))]))
    spare, left = padding * seen, []
    for window in sorted(packer.held, key=lambda w: (-packer.fill(w), w)):
        spare -= size - packer.fill(window)
        if spare < 0:
            left.append(window)
            continue
        for p, offset in rows.pop(window):
            yield *p, window, offset
    if left:
        yield from joined(left)


class WordTokenizer:
    """Ids of the tokenizers library. It is asked once for each part of a word that its splitter would make.

    Only for a tokenizer that folds case, drops white space, splits as PART does and marks the end of a part; ``check``
    says whether a file is one. Plain Latin words are split here into parts, and new parts go to the library together;
    the ids that end a part tell them apart. Other words go to the library whole.
    """

    #: How the tokenizer splits; on plain words, where this class and the library agree.
    PART = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
    PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    WORDS, PARTS = 400_000, 500_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        if not self.check(["It's 12 o'clock: don't SAY \u00c9t\u00e9--x_y! a  b", "\u65e5\u672c <|x|> 9's", ""]):
            raise ValueError(f"{path} does not hold a tokenizer that this class can stand for")

    def _learn_parts(self, fresh: list[str]) -> None:
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("the tokenizer does not split words as PART does")
            raw, last = ids.tobytes(), 0
            for p, end in zip(part, cuts.tolist(), strict=True):
                self.parts[p] = raw[4 * last : 4 * end]
                last = end

    def _learn(self, fresh: list[bytes]) -> None:
        split, other = {}, []
        for w in fresh:
            if w.isalpha():  # ASCII letters only: one part
                split[w] = [w.lower().decode()]
                continue
            text = w.decode()
            if self.PLAIN.fullmatch(text) and "<|" not in text:
                split[w] = self.PART.findall(text.lower())
            else:
                other.append(w)
        if len(self.parts) > self.PARTS:
            self.parts.clear()
        parts = self.parts
        self._learn_parts(list({p for ps in split.values() for p in ps if p not in parts}))
        for w, ps in split.items():
            self.words[w] = b"".join(map(parts.__getitem__, ps)) if len(ps) > 1 else parts[ps[0]]
        for w, e in zip(other, self.library.encode_batch([w.decode() for w in other], add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        split = [(t or "").encode().split() for t in texts]
        words = self.words
        if len(words) > self.WORDS:
            words.clear()
        self._learn(list({w for ws in split for w in ws if w not in words}))
        last = np.array([end], "<u4").tobytes()
        return [np.frombuffer(b"".join(map(words.__getitem__, ws)) + last, "<u4") for ws in split]

    def check(self, sample: list[str]) -> bool:
        got = self.library.encode_batch(sample, add_special_tokens=False)
        return all(a.tolist()[:-1] == b.ids for a, b in zip(self.ids(sample, 1), got, strict=True))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _word_tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, tokenize: Callable[[list[str | None], int], list[np.ndarray]] | None = None, padding: float = 0.02) -> DataFrame:
    """Pieces of all documents in windows of ``size``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one id, ``end_id``; texts of any length are read whole, and fill as many windows as they
    need. Repeated rows are packed each time, and rows with a null id too. Of levels with equal sums the fullest is taken.
    ``padding`` is the share of the ids that open windows may leave as padding at the end of a task. ``with_ids`` adds
    ids array<int>. ``tokenize`` replaces the word tokenizer, for files of another kind than it knows (which it refuses).
    There is no shuffle: every task numbers its windows from its own start, so a task that runs again makes the same
    rows. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenize or _word_tokenizer(tokenizer_path).ids
        first = TaskContext.get().partitionId() << 36

        def documents() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield from zip(part.column(0).to_pylist(), ids_of(part.column(1).to_pylist(), end_id), strict=True)

        def batch_of(rows: list) -> pa.RecordBatch:
            doc, start, ids, total, window, offset = zip(*rows, strict=True)
            cols = [doc, start, [len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids], total, window, offset]
            arrays = [pa.array(c, pa.int64()) for c in cols]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        rows: list = []
        for row in pack(documents(), size, first, padding):
            rows.append(row)
            if len(rows) == 2000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
