"""Packing of token sequences into fixed windows: bounded-space online best fit.

Each input partition keeps at most `open_windows` windows. A piece goes into the open window that it leaves fullest
(best fit); when none fits, a new window is opened or, with all in use, the fullest is emitted: if its gap is at least
`min_cut` tokens the arriving piece is cut to fill it, else the gap becomes padding. Documents of a window or more give
whole windows first. At the end of a partition its open windows are merged, by cutting, into full ones and at most one
partial one; those of `fan_in` partitions are then merged the same way by one small task.

Ids: bpe finds the words and keeps what it has met; the tokenizers library's model merges the others.

Memory: open windows only (open_windows x window tokens), whatever the document count. The first pass is written to the
shared folder, so the two passes agree even if executors are lost in between.

Rows: a null text is an empty one, and its only token is the end token; a null id stays null; repeated rows are packed once each; of
equally full windows the one that was opened first is taken; texts of any length are cut into windows; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.bpe import default_vocabulary, load_library
from evigraph.llm.common import arrow_stage, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places pieces (doc id, start, ids as bytes, document's tokens); `out` gets (sequence, [pieces]) of finished windows."""

    def __init__(self, first_sequence: int, window: int, open_windows: int, min_cut: int):
        self.next, self.window, self.most, self.min_cut = first_sequence, window, open_windows, min_cut
        self.open: list[list] = []  # [free tokens, pieces]
        self.out: list[tuple[int, list]] = []

    def emit(self, pieces: list) -> None:
        self.out.append((self.next, pieces))
        self.next += 1

    def put(self, window: list, piece: tuple) -> None:
        window[1].append(piece)
        window[0] -= len(piece[2]) // 4
        if not window[0]:
            self.open.remove(window)
            self.emit(window[1])

    def add(self, doc, ids: bytes) -> None:
        total, start, step = len(ids) // 4, 0, self.window
        while total - start >= step:
            self.emit([(doc, start, ids[4 * start : 4 * (start + step)], total)])
            start += step
        if start < total:
            self.place((doc, start, ids[4 * start :], total))

    def place(self, piece: tuple) -> None:
        while True:
            size = len(piece[2]) // 4
            fitting = [w for w in self.open if w[0] >= size]
            if fitting:
                return self.put(min(fitting, key=lambda w: w[0]), piece)
            if len(self.open) < self.most:
                self.open.append([self.window, []])
                return self.put(self.open[-1], piece)
            fullest = min(self.open, key=lambda w: w[0])
            if fullest[0] < self.min_cut:
                self.open.remove(fullest)
                self.emit(fullest[1])
            else:
                piece = self.cut_into(fullest, piece)

    def cut_into(self, window: list, piece: tuple) -> tuple:
        """Fills the window with the piece's beginning; returns the rest."""
        doc, start, ids, total = piece
        free = window[0]
        self.put(window, (doc, start, ids[: 4 * free], total))
        return doc, start + free, ids[4 * free :], total

    def merge(self, pieces: list[tuple]) -> list[tuple]:
        """Cuts pieces into full windows; returns those of the last, partial one."""
        last = [self.window, []]
        self.open = [last]
        for piece in pieces:
            while len(piece[2]) // 4 > last[0]:
                piece = self.cut_into(last, piece)
                last = [self.window, []]
                self.open = [last]
            self.put(last, piece)
            if not last[0]:
                last = [self.window, []]
                self.open = [last]
        return last[1]

    def leftovers(self) -> list[tuple]:
        """Closes the fullest windows with a gap too small to cut for, merges the others."""
        for w in [w for w in self.open if w[0] < self.min_cut]:
            self.open.remove(w)
            self.emit(w[1])
        return self.merge([p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]])


def _rows(windows: list[tuple[int, list]]):
    for sequence, pieces in windows:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset
            offset += len(ids) // 4


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, open_windows: int = 32, min_cut: int = 16, end_id: int = 2, fan_in: int = 256) -> DataFrame:
    """One row per piece: PIECES. sequence_id is unique over the table; sequences of merged leftovers have ids from 2**62 on."""
    end = np.array([end_id], "<u4").tobytes()

    def first(batches):
        part = TaskContext.get().partitionId()
        packer = Packer(part << 32, window, open_windows, min_cut)
        encode = load_library(vocabulary).encode
        for b in batches:
            for doc, text in zip(b["k"], b["t"], strict=True):
                packer.add(doc, encode(text) + end)
                for row in _rows(packer.out):
                    yield *row, None, None
                packer.out.clear()
        rest = packer.leftovers()
        for row in _rows(packer.out):
            yield *row, None, None
        for doc, start, ids, total in rest:
            yield doc, start, len(ids) // 4, None, total, None, None, part // fan_in, ids

    source = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    placed = written(arrow_stage(source, PIECES + ", part long, ids binary", first), "packing")

    def second(key, pdf):
        import pandas as pd

        packer = Packer((1 << 62) + (int(key[0]) << 32), window, 1, min_cut)
        pdf = pdf.sort_values(["doc_id", "start"], kind="stable")
        rest = packer.merge([(None if pd.isna(d) else int(d), int(s), i, int(n)) for d, s, i, n in zip(pdf.doc_id, pdf.start, pdf.ids, pdf.doc_tokens, strict=True)])
        if rest:
            packer.emit(rest)
        names = [f.split()[0] for f in PIECES.split(", ")]
        return pd.DataFrame(list(_rows(packer.out)), columns=names).astype({"doc_id": "Int64"})

    merged = placed.where("part is not null").groupBy("part").applyInPandas(second, PIECES)
    return placed.where("part is null").drop("part", "ids").unionByName(merged)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
