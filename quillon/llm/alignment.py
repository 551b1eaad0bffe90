"""Alignment of the tokens that two tokenizers make of one text, by the bytes that they stand for.

Tokens of B are held in a static index of intervals: their begins in order and the furthest end so far, so two bisections
for each token of A find all that it overlaps. Gaps between bytes that no token of either side spans are borders of groups.

Most texts are made of stretches that recur: both tokenizers treat a space before something else, after anything but a
space, as a border that no token crosses. A stretch is aligned once and then looked up. A task writes its documents in
blocks: each document as a list of stretches, each stretch as a list of linked pairs of ids. Counts over the corpus are
then grouped sums over the pairs of blocks, not of documents, and go back to each block by one join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import sentencepiece_codec
from .scratch import table

SPACE = "▁"
#: A space that follows anything but a space, and precedes anything but white space, begins a stretch.
CUT = re.compile(r" (?<=[^ ] )(?=\S)")
#: Characters of the texts of a block; a longer text is a block of its own.
BLOCK = 8_000_000
#: Texts that are cut and encoded together.
TOGETHER = 128
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class IntervalIndex:
    """Static index over intervals [begin, end) in order of begin: which of them overlap others."""

    def __init__(self, begins: np.ndarray, ends: np.ndarray) -> None:
        self.begins, self.ends = begins, ends
        self.reach = np.maximum.accumulate(ends) if len(ends) else ends

    def between(self, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch, by bisection: where the first interval that reaches into it stands, and the first one that
        begins behind it. Where the intervals don't overlap each other, all between the two overlap the stretch."""
        return np.searchsorted(self.reach, begins, "right"), np.searchsorted(self.begins, ends, "left")

    def overlapping(self, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (stretch, interval) that overlap, in order."""
        low, high = self.between(begins, ends)
        n = np.maximum(high - low, 0)
        of = np.repeat(np.arange(len(n)), n)
        found = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[of]
        real = self.ends[found] > begins[of]
        return of[real], found[real]


class Alignment:
    """Groups and links of tokens given by the numbers of their bytes, whose sums are the same on both sides."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.ends_a, self.ends_b = np.cumsum(a), np.cumsum(b)
        index = IntervalIndex(self.ends_b - b, self.ends_b)
        self.link_a, self.link_b = index.overlapping(self.ends_a - a, self.ends_a)
        first, last = (np.zeros(len(a), np.int64) for _ in range(2))
        first[self.link_a[::-1]], last[self.link_a] = self.link_b[::-1], self.link_b
        # A group begins where no token of B spans the gap before a token of A.
        new = np.r_[True, first[1:] > last[:-1]][: len(a)]
        self.group_a = np.cumsum(new) - 1
        self.ends = self.ends_a[np.r_[np.flatnonzero(new)[1:], len(a)] - 1] if len(a) else self.ends_a
        self.group_b = np.searchsorted(self.ends, self.ends_b, "left")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others for the
    characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Two tokenizers and what they make of stretches. The first: a byte-level BPE of the tokenizers library; the second:
    a SentencePiece model."""

    #: Stretches, and characters of them, that are remembered between two blocks.
    MEMO, MEMO_CHARS = 300_000, 6_000_000

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core of its own
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_alphabet()
        self.bytes_a = {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in byte for c in t)}
        self.bytes_b = [self._piece(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.cuts = self._cuts(spec, b_path)
        self.sizes_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.forget()

    @staticmethod
    def _piece(piece: str, is_byte: bool) -> bytes:
        return bytes([int(BYTE_PIECE.fullmatch(piece)[1], 16)]) if is_byte else piece.replace(SPACE, " ").encode()

    @staticmethod
    def _cuts(spec: dict, b_path: str) -> bool:
        """Whether neither tokenizer has tokens across a border of stretches, nor rules that look across."""
        pre = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        codec = sentencepiece_codec.load(b_path)
        return plain and codec.dummy and not codec.squeeze and not codec.map.units and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in codec.ids)

    def stretches(self, text: str) -> list[str]:
        """The stretches of a space and the text, each without the space that it begins with."""
        return [x for x in CUT.split(text)] if self.cuts else [text]

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and of B of a space and a text; none where those of one side don't stand for its bytes."""
        a, b, whole = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text), f" {text}".encode()
        if b"".join([self.bytes_a.get(i, b"") for i in a]) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def aligned(self, a: np.ndarray, b: np.ndarray) -> Alignment:
        return Alignment(self.sizes_a[a], self.sizes_b[b])

    def learn(self, parts: set[str]) -> None:
        """Align stretches that are not yet known: those that stand between borders again when a space joins them
        together, the others one by one."""
        new = sorted(p for p in parts if p not in self.number)
        plain = [p for p in new if not p[:1].isspace() and p[-1:] not in ("", " ")] if self.cuts else []
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            if not self._learn(some):
                for p in some:
                    self._learn([p])
        if len(plain) < len(new):
            for p in sorted(set(new).difference(plain)):
                self._learn([p])

    def _learn(self, parts: list[str]) -> bool:
        """Align stretches as one text; False if there are several and they have to be taken one by one."""
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        found = self.encoded(" ".join(parts))
        if found is None:
            if len(parts) == 1:
                self.bad.add(len(self.texts))
                self._keep(parts[0], "", np.zeros(0, np.int64), (0, 0, 0))
            return len(parts) == 1
        a, b = found
        own = self.aligned(a, b)
        if not np.isin(ends, own.ends).all():
            return False
        # Each token, group and link belongs to the part that it ends in.
        pairs = a[own.link_a] << 32 | b[own.link_b]
        n_a, n_b, n_groups = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (own.ends_a, own.ends_b, own.ends))
        at_links = np.searchsorted(own.ends_a[own.link_a], ends, "right").tolist()
        # Tokens by group, A's before B's, and what stands behind each: a comma within a side, else the mark of the next.
        group, side = np.concatenate([own.group_a, own.group_b]), np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))
        group, side = group[order], side[order]
        marks = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
        shown = [x + m for x, m in zip(map(str, np.concatenate([a, b])[order].tolist()), [*map(",|;".__getitem__, marks.tolist()), ""], strict=True)]
        at_tokens, low, link = np.cumsum(n_a + n_b).tolist(), 0, 0
        sizes = list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), strict=True))
        for p, high, links, size in zip(parts, at_tokens, at_links, sizes, strict=True):
            text = "".join(shown[low:high])
            self._keep(p, text[:-1] if text.endswith(";") else text, pairs[link:links], size)
            low, link = high, links
        return True

    def _keep(self, part: str, text: str, links: np.ndarray, sizes: tuple[int, int, int]) -> None:
        self.number[part] = len(self.texts)
        self.texts.append(text)
        self.links.append(links)
        self.sizes.append((*sizes, len(links)))
        self.held += len(part)

    def full(self) -> bool:
        return len(self.texts) > self.MEMO or self.held > self.MEMO_CHARS

    def forget(self) -> None:
        """Of known stretches: their numbers, groups as text, linked pairs, and tokens of A, of B, groups, links."""
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.links: list[np.ndarray] = []
        self.sizes: list[tuple[int, int, int, int]] = []
        self.bad: set[int] = set()
        self.held = 0


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process; the tokenizers' files are installed on every machine."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


GROUP = "struct<a_from: int, a_to: int, b_from: int, b_to: int, begin: long, end: long>"
WHOLE = f"doc_id long, a array<int>, b array<int>, groups array<{GROUP}>, links array<struct<a: int, b: int>>"


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the ids of both sides, groups, links.

    A group is a range of tokens of each side (from, to) and their bytes [begin, end) in a space and the text; a link is
    a pair of places, in a and in b, of tokens that share bytes. Texts that are null or empty, or whose bytes the tokens
    of one side do not give back, have empty lists. Texts of any length are read whole; rows are independent: repeated
    rows and null ids give a result each, other columns are ignored, and an empty table gives an empty result.
    """

    schema = to_arrow_schema(StructType.fromDDL(WHOLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                rows = []
                texts = part.column(1).to_pylist()
                for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    row = {"doc_id": doc, "a": [], "b": [], "groups": [], "links": []}
                    if text and (found := own.encoded(text)) is not None:
                        a, b = found
                        x = own.aligned(a, b)
                        row |= {"a": a.tolist(), "b": b.tolist(), "links": [{"a": i, "b": j} for i, j in zip(x.link_a.tolist(), x.link_b.tolist(), strict=True)]}
                        to_a, to_b = (np.searchsorted(ends, x.ends, "right").tolist() for ends in (x.ends_a, x.ends_b))
                        to = x.ends.tolist()
                        names = ("a_from", "a_to", "b_from", "b_to", "begin", "end")
                        row["groups"] = [dict(zip(names, g, strict=True)) for g in zip([0, *to_a[:-1]], to_a, [0, *to_b[:-1]], to_b, [0, *to[:-1]], to, strict=True)]
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, WHOLE)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Block:
    """Documents as lists of numbered stretches."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.parts: list[np.ndarray] = []
        self.shas: list[str] = []
        self.chars = 0

    def add(self, own: Aligner, doc: int | None, parts: list[str] | None, chars: int) -> None:
        at = list(map(own.number.__getitem__, parts)) if parts else []
        if own.bad and not own.bad.isdisjoint(at):
            at = []
        self.ids.append(doc)
        self.parts.append(np.array(at, np.int32))
        self.shas.append(hashlib.sha256(";".join(map(own.texts.__getitem__, at)).encode()).hexdigest() if at else "")
        self.chars += chars

    def row(self, own: Aligner, number: int) -> pa.RecordBatch:
        """The block with numbers of its own: parts of documents, links of parts, and the distinct pairs with how many
        links of the block hold each."""
        used, parts = np.unique(np.concatenate(self.parts), return_inverse=True)
        doc_parts = np.array([len(p) for p in self.parts], np.int64)
        sizes_of = np.array(own.sizes, np.int64).reshape(-1, 4)[used]
        links = [own.links[i] for i in used.tolist()]
        sizes = np.array([len(x) for x in links], np.int32)
        pairs, of = np.unique(np.concatenate([*links, np.zeros(0, np.int64)]), return_inverse=True)
        times = np.bincount(parts, minlength=len(used)) if len(used) else np.zeros(0, np.int64)
        counts = np.bincount(of, np.repeat(times, sizes), len(pairs)).astype(np.int64)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        cols = {
            "block": pa.array([number], pa.int64()),
            "doc_ids": one(self.ids, pa.int64()),
            **{name: one(_sums(sizes_of[parts, k], doc_parts), pa.int64()) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "shas": one(self.shas, pa.string()),
            **{name: pa.array([np.asarray(x, np.int32).tobytes()], pa.binary()) for name, x in (("doc_parts", doc_parts), ("parts", parts), ("part_links", sizes), ("links", of))},
            "pairs": one(pairs, pa.int64()),
            "counts": one(counts, pa.int64()),
        }
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


BLOCKS = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, doc_parts binary, parts binary, part_links binary, links binary, pairs array<long>, counts array<long>"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """BLOCKS of the rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, number = _aligner(a_path, b_path), Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = part.column(1).to_pylist()
                # A space mark in a text is no space, so the bytes of its pieces are not those of the text.
                cut = [own.stretches(t) if t and SPACE not in t else None for t in texts]
                own.learn({x for parts in cut if parts for x in parts})
                for doc, text, parts in zip(part.column(0).to_pylist(), texts, cut, strict=True):
                    block.add(own, doc, parts, len(text or ""))
                if block.chars >= BLOCK or own.full():
                    yield block.row(own, number)
                    block, number = Block(), number + 1
                    if own.full():
                        own.forget()
        if block.ids:
            yield block.row(own, number)

    return docs.mapInArrow(run, BLOCKS)


def _counted(blocks: pa.Table, known: pa.Table) -> pa.Table:
    """DIGEST of the documents of one block: ``known`` has pos (of a pair in the block), count, best."""
    order = np.argsort(known.column("pos").to_numpy())
    count, best = known.column("count").to_numpy()[order], known.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    row = blocks.slice(0, 1)
    numbers = lambda c: np.frombuffer(row.column(c)[0].as_py(), np.int32)
    links, part_links, parts, doc_parts = (numbers(c) for c in ("links", "part_links", "parts", "doc_parts"))
    of_docs = lambda values: _sums(_sums(values[links], part_links)[parts], doc_parts) if len(links) else np.zeros(len(doc_parts), np.int64)
    flat = lambda c: row.column(c).combine_chunks().flatten()
    cols = [flat("doc_ids"), *(flat(c) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(of_docs(best), pa.int64()), pa.array(of_docs(count), pa.int64()), flat("shas")]
    return pa.table(cols, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    What ``align_documents`` gives, in figures: groups_sha256 is of the ids of the groups as text (`a1,a2|b1;a3|b2`), '' of
    texts without tokens, whose figures are zero. count_sum adds, over the links of a text, how many links of the whole
    corpus hold the same pair of ids, n_best counts those whose pair is the most frequent of its B id (all, of equals).
    Texts of any length are read whole, a long one in a block of its own; null ids, repeated rows, other columns and
    empty tables as in ``align_documents``; repeated rows count each time.
    """
    source = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    blocks = table(aligned_blocks(source, a_path, b_path), "aligned", large_rows=True)
    held = blocks.select(F.col("block").alias("home"), F.posexplode(F.arrays_zip("pairs", "counts")).alias("pos", "x")).select("home", "pos", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = table(held.groupBy("pair").agg(F.sum("n").alias("count")), "pairs").withColumn("b", F.expr("pair & 4294967295"))
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    known = totals.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = held.select("home", "pos", "pair").join(known.hint("merge"), "pair").select("home", "pos", "count", "best")
    return blocks.drop("pairs", "counts").groupBy("block").cogroup(back.groupBy("home")).applyInArrow(_counted, DIGEST)
