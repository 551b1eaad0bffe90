"""Offset-preserving encoding and decoding with a SentencePiece BPE model.

The model file is read directly. Normalisation takes, at each place, the longest prefix that the compiled character
map knows and records for every normalised byte the source byte it came from, so each piece is projected back to a
span of original bytes. Merging works on stretches that no piece of the vocabulary can cross, and remembers short ones.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class CharacterMap:
    """The compiled map of a normaliser: a double array over UTF-8 bytes and a pool of replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size])
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes consumed at ``at`` by the longest known prefix, and what replaces them."""
        if not self.units:
            return None
        best, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.pool[best[1] : self.pool.index(b"\0", best[1])]


class Codec:
    #: Stretches up to this many characters are remembered, up to so many of them.
    MEMO_CHARS, MEMO = 48, 600_000

    def __init__(self, model: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        normalizer = b""
        for field, value in _fields(model):
            if field == 1:
                got = dict(_fields(value))
                self.pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
            elif field == 3:
                normalizer = value
        spec = dict(_fields(normalizer))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if any(kind == USER_DEFINED for *_, kind in self.pieces) or not self.escape:
            raise ValueError("models with user-defined symbols or without escaped white space are not supported")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, UNUSED)}
        self.unknown = next(i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.rank = {p: -self.pieces[i][1] for p, i in self.ids.items()}
        self.cut = self._cuts()
        self.shown = [str(i) for i in range(len(self.pieces))]
        self.plain = [p.replace(SPACE, " ") for p, _, _ in self.pieces]
        self.memo: dict[str, tuple[int, str, str, bytes]] = {}

    def _cuts(self) -> re.Pattern[str]:
        """Matches the stretches of a normalised text that no merge can cross, one after the other, leaving nothing."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile(r"(?s).+")
        end = "" if any("\n" in p for p in self.ids) else "\n"
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        joined = {b for a, b in pairs if re.match(r"\w", a)}  # these follow a word character in some piece
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not re.match(r"\w", c) and c not in joined)
        word = rf"{SPACE}+\w+(?=[{SPACE}{end}{marks}]|\Z)|"
        return re.compile(f"{word}{SPACE}+[^{SPACE}{end}]*" + f"|{end}+" * bool(end) + f"|[^{SPACE}{end}]+")

    # normalisation ------------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """Normalised text; source[i]: the original byte at which its byte i begins (None: the identity, shifted)."""
        if not text:
            return "", []
        if not self.map.units and not self.squeeze:
            return (SPACE if self.dummy else "") + text.replace(" ", SPACE), None
        data, out, source = text.encode(), bytearray(), []
        mark = SPACE.encode()

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        i, spaced = 0, self.squeeze
        if self.squeeze:
            while i < len(data):
                n, piece = self._step(data, i)
                if piece != b" ":
                    break
                i += n
            if i == len(data):
                return "", []
        if self.dummy:
            put(mark, i)
        spaced = self.squeeze
        while i < len(data):
            n, piece = self._step(data, i)
            if spaced:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", mark), i)
                spaced = self.squeeze and piece.endswith(b" ")
            i += n
        if self.squeeze:
            while out.endswith(mark):
                del out[-3:], source[-3:]
        source.append(len(data))
        return out.decode(errors="replace"), source

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(data, at)
        if found:
            return found
        first = data[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return n, data[at : at + n]

    # encoding -----------------------------------------------------------------------------------------------------

    def _merge(self, chunk: str) -> list[str]:
        """Merge neighbours, the best score first and the leftmost of equals."""
        parts: list[str] = list(chunk)
        if len(parts) <= 64:
            rank, none = self.rank, float("inf")
            costs = [rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            while costs and (low := min(costs)) < none:
                i = costs.index(low)
                parts[i] += parts.pop(i + 1)
                del costs[i]
                if i < len(costs):
                    costs[i] = rank.get(parts[i] + parts[i + 1], none)
                if i:
                    costs[i - 1] = rank.get(parts[i - 1] + parts[i], none)
            return parts
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ids, pieces, heap = self.ids, self.pieces, []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := ids.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-pieces[i][1], a, b, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not parts[a] or not parts[b] or after[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p]

    def _ids(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids of a stretch, and the normalised bytes of each."""
        parts = self._merge(chunk)
        ids = list(map(self.ids.get, parts))
        if None not in ids:
            return ids, [len(p.encode()) for p in parts]
        ids, sizes = [], []
        for piece in parts:
            i, raw = self.ids.get(piece), piece.encode()
            if i is None and self.bytes:
                ids += [self.bytes[b] for b in raw]
                sizes += [1] * len(raw)
            else:
                ids.append(self.unknown if i is None else i)
                sizes.append(len(raw))
        return ids, sizes

    def _digested(self, chunk: str) -> tuple[int, str, str, bytes]:
        """Number of ids of a stretch, the ids as text, their decoded text, and the normalised bytes of each id, as
        little-endian unsigned 32-bit numbers; a space mark counts as the one byte that it stands for."""
        parts = self._merge(chunk)
        ids = list(map(self.ids.get, parts))
        if None in ids:
            ids, sizes = self._ids(chunk)
            return len(ids), ",".join(map(str, ids)), self._plain(ids), np.array(self._marked(chunk, sizes), "<u4").tobytes()
        sizes = [len(p.encode()) - 2 * p.count(SPACE) for p in parts]
        return len(ids), ",".join(map(self.shown.__getitem__, ids)), "".join(map(self.plain.__getitem__, ids)), np.array(sizes, "<u4").tobytes()

    @staticmethod
    def _marked(chunk: str, sizes: list[int]) -> list[int]:
        """Sizes of consecutive pieces of a stretch's bytes, a space mark counting one where it begins."""
        weight = [w for c in chunk for w in ((1, 0, 0) if c == SPACE else (1,) * len(c.encode()))]
        out, at = [], 0
        for n in sizes:
            out.append(sum(weight[at : at + n]))
            at += n
        return out

    def chunks(self, norm: str) -> list[tuple[int, str, str, bytes]]:
        memo = self.memo
        if len(memo) > self.MEMO:
            memo.clear()
        found = self.cut.findall(norm)
        for c in {c for c in found if c not in memo}:
            if len(c) <= self.MEMO_CHARS:
                memo[c] = self._digested(c)
        if len(norm) > self.MEMO_CHARS and any(len(c) > self.MEMO_CHARS for c in found):
            return [memo[c] if c in memo else self._digested(c) for c in found]
        return list(map(memo.__getitem__, found))

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.cut.findall(self.normalise(text or "")[0]) for i in self._ids(c)[0]]

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """Each id with the original bytes [begin, end) that it stands for; the spans follow each other without a gap."""
        text = text or ""
        norm, source = self.normalise(text)
        out, at, size = [], 0, len(text.encode())
        if source is None:  # a space became three bytes
            source, shift = ([0] * 3 if self.dummy else []), 0
            for ch in text:
                n = len(ch.encode())
                source += [shift] * 3 if ch == " " else range(shift, shift + n)
                shift += n
            source.append(size)
        for c in self.cut.findall(norm):
            for i, n in zip(*self._ids(c), strict=True):
                out.append((i, source[at], source[at + n]))
                at += n
        return out

    # decoding -----------------------------------------------------------------------------------------------------

    def _plain(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(self._utf8(bytes(run)))
                run.clear()
            piece, _, kind = self.pieces[i]
            out.append("" if kind == CONTROL else " ⁇ " if kind == UNKNOWN else piece.replace(SPACE, " "))
        if run:
            out.append(self._utf8(bytes(run)))
        return "".join(out)

    @staticmethod
    def _utf8(run: bytes) -> str:
        """Each byte that begins no whole character becomes one replacement character."""
        try:
            return run.decode()
        except UnicodeDecodeError:
            out, i = [], 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[i : i + n].decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; the space mark of the prefix goes where a plain piece brings it first."""
        text = self._plain(ids)
        first = next((i for i in ids if self.pieces[i][2] != CONTROL), self.unknown)
        return text[1:] if self.dummy and self.pieces[first][0].startswith(SPACE) else text

    def digests(self, text: str | None) -> tuple[int, str, str, str]:
        """Number of ids, and SHA-256 of the ids joined by commas, of the text that they decode to, and of the ends of
        all ids in the original bytes, as little-endian unsigned 64-bit numbers."""
        text = text or ""
        norm, source = self.normalise(text)
        got = self.chunks(norm)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        if source is None and SPACE not in text:
            # Each normalised character is one of the text; the prefix's mark is none.
            ends = np.cumsum(np.frombuffer(b"".join([c[3] for c in got]), "<u4"), dtype="<u8") - np.uint64(self.dummy and bool(got))
        else:
            ends = np.array([end for _, _, end in self.spans(text)], "<u8")
        return sum([c[0] for c in got]), sha(",".join([c[1] for c in got]).encode()), sha("".join([c[2] for c in got])[self.dummy and bool(got) :].encode()), sha(ends.tobytes())


def load(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    """One codec, with its memo, for each worker process; the tokenizer's file is installed on every machine."""
    if path not in _CODECS:
        _CODECS[path] = load(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode whole texts: doc_id, ids array<int>, begins and ends array<long> (original bytes), decoded string.

    With ``digests`` the columns are doc_id, n_tokens, ids_sha256, decoded_sha256 and ends_sha256 (of the ends of all
    pieces in the original bytes, little-endian unsigned 64-bit numbers; a piece begins where the one before ends), so
    that long lists need not leave the worker. Texts of any length are read whole; null texts count as empty and have no
    ids. Rows are independent: there is no shuffle, repeated rows and null ids give a result each, other columns are
    ignored, whatever their names, and an empty table gives an empty result.
    """

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [codec.spans(t) for t in part.column(1).to_pylist()]
                ids = [[x[0] for x in r] for r in rows]
                cols = [part.column(0), pa.array(ids, pa.list_(pa.int32())), *(pa.array([[x[k] for x in r] for r in rows], pa.list_(pa.int64())) for k in (1, 2))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([codec.decode(r) for r in ids], pa.string())], ["doc_id", "ids", "begins", "ends", "decoded"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for batch in batches:
            rows = [codec.digests(t) for t in batch.column(1).to_pylist()]
            n, *shas = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in shas)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256"])

    source = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    if digests:
        return source.mapInArrow(digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string")
    return source.mapInArrow(plain, "doc_id long, ids array<int>, begins array<long>, ends array<long>, decoded string")
