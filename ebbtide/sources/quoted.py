"""Records of delimited text whose quoted cells hold line breaks, read in as many pieces as the file has.

A line ends a record where the number of quotes up to it is even. Each piece of a file counts its quotes and, for both ways it may begin
(inside quotes or not), the lines that would end a record: a few numbers a piece. Summed along the file they say how every piece begins. A second
pass cuts the records; only a record that crosses the end of a piece leaves fragments, which are put together by their file and first piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines_of(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """value and where it stands: file and the first byte of its piece. Lines of a piece follow each other in one partition."""
    return spark.read.option("encoding", encoding).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The parts of a batch that belong to one piece each, in order."""
    files, pieces = batch.column("file").to_pylist(), batch.column("piece").to_pylist()
    start = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or (files[i], pieces[i]) != (files[start], pieces[start]):
            yield files[start], pieces[start], batch.slice(start, i - start)
            start = i


def _parity(lines: pa.RecordBatch, before: int) -> np.ndarray:
    """Whether each line ends inside quotes, if the text before it does (1) or doesn't (0)."""
    quotes = np.asarray(pc.count_substring(pc.fill_null(lines.column("value"), ""), '"'), dtype=np.int64)
    return (np.cumsum(quotes) + before) & 1


def pieces_of(lines: DataFrame) -> DataFrame:
    """file, piece, odd (its quotes), lines, and ends: lines that end a record if the piece begins outside quotes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for file, piece, part in _runs(batch):
                now = held.setdefault((file, piece), [0, 0, 0])
                odd = _parity(part, now[0])
                now[0], now[1], now[2] = int(odd[-1]), now[1] + len(odd), now[2] + int((odd == 0).sum())
        if held:
            yield pa.RecordBatch.from_pydict({"file": [k[0] for k in held], "piece": pa.array([k[1] for k in held], pa.int64()), "odd": pa.array([v[0] for v in held.values()], pa.int32()),
                                              "lines": pa.array([v[1] for v in held.values()], pa.int64()), "ends": pa.array([v[2] for v in held.values()], pa.int64())})

    return lines.mapInArrow(run, "file string, piece long, odd int, lines long, ends long")


def begins(pieces: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """For each piece: does it begin inside quotes, and the piece in which the record began that is open there. One row a piece reaches the driver."""
    out, file, inside, opened = {}, None, 0, 0
    for r in sorted(pieces.collect(), key=lambda r: (r["file"], r["piece"])):
        if r["file"] != file:
            file, inside, opened = r["file"], 0, r["piece"]
        out[r["file"], r["piece"]] = (inside, opened)
        ended = r["ends"] if not inside else r["lines"] - r["ends"]
        inside ^= r["odd"]
        if inside and ended or not out[r["file"], r["piece"]][0]:
            opened = r["piece"]
    return out


def records(lines: DataFrame, known: dict[tuple[str, int], tuple[int, int]] | None = None) -> DataFrame:
    """file, first (is it the file's first record) and record: the text of every record, line breaks inside quotes as one line feed each.

    Blank lines outside quotes are no records. A file that ends inside quotes gives its last record as far as it goes. Memory: one record,
    in its task; pieces are read twice and only fragments are moved.
    """
    table = known if known is not None else begins(pieces_of(lines))
    first_piece: dict[str, int] = {}
    for file, piece in table:
        first_piece[file] = min(piece, first_piece.get(file, piece))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []   # file, group (null: whole), piece, first, text
        at, odd, crossing, fresh, open_lines = None, 0, False, False, []

        def close() -> None:
            """What a piece leaves open, or began with, is a fragment."""
            if at is not None and open_lines:
                rows.append((at[0], table[at][1] if crossing else at[1], at[1], fresh, "\n".join(open_lines)))

        for batch in batches:
            for file, piece, part in _runs(batch):
                if (file, piece) != at:
                    close()
                    at = (file, piece)
                    odd, open_lines, fresh = table[at][0], [], piece == first_piece[file]
                    crossing = odd == 1
                for value, now in zip(part.column("value").to_pylist(), _parity(part, odd).tolist(), strict=True):
                    value = value or ""
                    if now == 0 and not open_lines and not crossing:
                        if value.strip():
                            rows.append((file, None, piece, fresh, value))
                            fresh = False
                        odd = 0
                        continue
                    open_lines.append(value)
                    odd = now
                    if now == 0:
                        rows.append((file, table[at][1] if crossing else None, piece, fresh, "\n".join(open_lines)))
                        open_lines, crossing, fresh = [], False, False
            if rows:
                yield _batch(rows)
                rows.clear()
        close()
        if rows:
            yield _batch(rows)

    cut = lines.mapInArrow(run, "file string, grp long, piece long, first boolean, record string")
    whole = cut.filter("grp IS NULL").select("file", "first", "record")
    parts = (cut.filter("grp IS NOT NULL").groupBy("file", "grp").agg(F.sort_array(F.collect_list(F.struct("piece", "first", "record"))).alias("p"))
             .select("file", F.exists("p", lambda x: x["first"]).alias("first"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))
    return whole.unionByName(parts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, group, piece, first, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"file": list(file), "grp": pa.array(group, pa.int64()), "piece": pa.array(piece, pa.int64()), "first": pa.array(first, pa.bool_()), "record": pa.array(text, pa.string())})
