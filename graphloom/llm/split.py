"""Cutting oversized texts at natural boundaries, with a fixed overlap between neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes of files whose pieces should keep declarations together.
CODE_SUFFIXES = ("py", "pyi", "ts", "tsx", "js", "jsx", "mjs", "cjs", "rs", "go", "java", "kt", "c", "h", "cc", "cpp", "cs", "rb", "php", "sh", "css", "tf", "graphql", "gql", "sql", "env", "yaml", "yml", "toml", "json", "bicep")
#: A run of blanks, or a mark that may end a line where a text has no blanks.
_STOP = re.compile(r"\s+|[;})\]>,](?=\S)|[。！？，、；]")
_SENTENCE = frozenset(".!?:。！？")
_CLOSERS = "\"')]»”’*_`"


def boundaries(text: str, code: bool, base: int = 0, lo: int = 0, hi: int | None = None) -> tuple[list[int], list[int]]:
    """Positions after which ``text`` may be cut, ascending, and how natural each is.

    5: before a heading (prose) or an unindented line after a blank one (code). 4: after a blank line. 3: after a line.
    2: after a sentence. 1: after a blank or a mark. Only positions p with lo < p <= hi are given, plus ``base``; what
    lies outside is context, so ranges that overlap by a halo yield together what the whole text yields.
    """
    hi = len(text) if hi is None else hi
    at, rank = [], []
    for m in _STOP.finditer(text):
        run, p = m.group(), m.end()
        if run[0].isspace():
            nl = max(run.rfind("\n"), run.rfind("\r"))
            if nl >= 0:
                lines = run.count("\n") or run.count("\r")
                p = m.start() + nl + 1
                r = 4 if lines > 1 else 3
                if code:
                    r = 5 if lines > 1 and p == m.end() else r
                elif text.startswith("#", p):
                    r = 5
            else:
                k = m.start() - 1
                while k >= 0 and text[k] in _CLOSERS:
                    k -= 1
                r = 2 if not code and k >= 0 and text[k] in _SENTENCE else 1
        else:
            r = 2 if run in "。！？" else 1
        if lo < p <= hi:
            at.append(p + base)
            rank.append(r)
    return at, rank


def next_cut(at: np.ndarray, rank: np.ndarray, start: int, limit: int, overlap: int) -> int:
    """Where the piece from ``start`` ends: the last of the most natural boundaries in its latter half, else its limit."""
    least, most = start + max(overlap, limit // 2), start + limit
    a, b = np.searchsorted(at, least, "right"), np.searchsorted(at, most, "right")
    if a == b:
        return most
    r = rank[a:b]
    return int(at[a + len(r) - 1 - int(np.argmax(r[::-1]))])


class Stitcher:
    """Turns boundary tables, fed range by range in order, into pieces; holds no more than the boundaries of one piece.

    Offsets need no sums over all ranges, as each table gives them from the beginning of the text.
    """

    def __init__(self, n: int, limit: int, overlap: int):
        self.n, self.limit, self.overlap = n, limit, max(0, min(overlap, limit - 1))
        self.start, self.at, self.rank = 0, np.zeros(0, np.int64), np.zeros(0, np.int8)

    def feed(self, at: Sequence[int], rank: Sequence[int], known: int) -> list[tuple[int, int]]:
        """The pieces that are certain once all boundaries up to ``known`` are."""
        a, k = np.append(self.at, np.asarray(at, np.int64)), np.append(self.rank, np.asarray(rank, np.int8))
        out = []
        while self.n - self.start > self.limit and known >= self.start + self.limit:
            end = next_cut(a, k, self.start, self.limit, self.overlap)
            out.append((self.start, end))
            self.start = end - self.overlap
        i = int(np.searchsorted(a, self.start))
        self.at, self.rank = a[i:], k[i:]
        return out

    def close(self) -> list[tuple[int, int]]:
        return [*self.feed((), (), self.n), (self.start, self.n)]


def open_context(before: str, after: str) -> tuple[int, int]:
    """How much of what lies before and after a range its boundaries depend on.

    That is the run of blanks that a border cuts, the closing marks and the letter before it, and the letter behind it.
    """
    k = len(before.rstrip())
    while k and before[k - 1] in _CLOSERS:
        k -= 1
    return len(before) - max(0, k - 1), min(len(after), len(after) - len(after.lstrip()) + 1)


def range_tables(text: str, code: bool, size: int, halo: int = 256) -> Iterator[tuple[int, list[int], list[int]]]:
    """(end, boundaries, ranks) of the ranges of a text, each found from the range and its halo alone.

    Halos grow until they hold the whole run of blanks that a border cuts, so ranges of any size give the same.
    """
    n = len(text)
    size = max(size, n // 1024)
    for lo in range(0, n, size):
        hi = min(lo + size, n)
        left = right = halo
        while True:
            back, ahead = open_context(text[max(0, lo - left) : lo], text[hi : hi + right])
            if back >= left < lo:
                left *= 8
            elif ahead >= right < n - hi:
                right *= 8
            else:
                break
        base = max(0, lo - left)
        at, rank = boundaries(text[base : hi + right], code, base, lo - base, hi - base)
        yield hi, at, rank


def cuts(text: str, code: bool, limit: int, overlap: int, size: int = 8192) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text, in code points; one piece if it is within the limit."""
    stitch = Stitcher(len(text), limit, overlap)
    if len(text) <= limit:
        return stitch.close()
    return [x for end, at, rank in range_tables(text, code, size) for x in stitch.feed(at, rank, end)] + stitch.close()


def is_code(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1).isin(*CODE_SUFFIXES), F.lit(False))


def kind_key(kind: Column) -> Column:
    return F.lower(F.regexp_replace(kind, r"\s+", ""))


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of ``chunks`` whose text is longer than the max_chars of their kind, with both limits, ``code`` and ``n``.

    ``limits`` has a row a kind, is a table of settings, and is broadcast after a check that it has at most 10,000 rows.
    Where a kind is set twice the smaller limit holds. A null kind or one without a limit has none; limits under 1 are
    none either. Letter case and blanks of a kind do not matter.
    """
    lim = (
        limits.filter("max_chars >= 1 AND kind IS NOT NULL")
        .groupBy(kind_key(F.col("kind")).alias("__k"))
        .agg(F.min("max_chars").cast("int").alias("__max"), F.max(F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0))).cast("int").alias("__overlap"))
    )
    if lim.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 kinds: not a table of limits")
    own = chunks.select("id", "chunk_text", "source_path", kind_key(F.col("kind")).alias("__k"))
    j = own.join(F.broadcast(lim), "__k").withColumn("__n", F.char_length("chunk_text"))
    return j.filter("__n > __max").withColumn("__code", is_code(F.col("source_path")))


def split_oversized(chunks: DataFrame, limits: DataFrame, range_chars: int = 8192) -> DataFrame:
    """(id, piece_no, start, end_, piece_text) of every oversized text.

    Every text goes the same way: boundaries are found range by range, with halos, and stitched in order, without a
    shuffle, as a text that is a value of a row lies in one task anyway. Pieces are numbered from 0; none is over the limit
    of its kind; each repeats the last overlap_chars of the one before (fewer where the limit leaves no room); start and
    end_ count code points of the text as stored. Repeated rows count once. Texts within their limit, null and empty
    texts give no row. Extra columns are left out.
    """
    big = oversized(chunks, limits)
    key = big.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, text, code, limit, overlap in f.itertuples(index=False):
                p = cuts(text, code, limit, overlap, range_chars)
                for at in range(0, len(p), 4096):
                    part = p[at : at + 4096]
                    yield pd.DataFrame({"id": i, "piece_no": range(at, at + len(part)), "start": [a for a, _ in part], "end_": [b for _, b in part], "piece_text": [text[a:b] for a, b in part]})

    cut = big.select("id", "chunk_text", "__code", "__max", "__overlap").mapInPandas(run, f"id {key}, piece_no int, start int, end_ int, piece_text string")
    return cut.dropDuplicates(["id", "piece_no", "start", "end_", "piece_text"])


def oversized_ids(chunks: DataFrame, limits: DataFrame, range_chars: int = 8192) -> DataFrame:
    """(id) of every text that :func:`split_oversized` cuts, once."""
    big = oversized(chunks, limits)
    key = big.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": [i for i, text, code, limit, overlap in f.itertuples(index=False) if len(cuts(text, code, limit, overlap, range_chars)) > 1]})

    return big.select("id", "chunk_text", "__code", "__max", "__overlap").mapInPandas(run, f"id {key}").distinct()


def piece_report(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(id, n_chars, within, covering, overlapping) of the pieces of each oversized text, for texts of one id alike.

    ``within``: none is over the limit. ``covering``: they begin at 0, end at n_chars and leave nothing out.
    ``overlapping``: each repeats exactly what the limits ask for, and its text is that of its place.
    """
    big = oversized(chunks, limits).select("id", "__max", "__overlap", "__n").groupBy("id").agg(F.max(F.struct("__n", "__max", "__overlap")).alias("o")).select("id", "o.*")
    w = Window.partitionBy("id").orderBy("piece_no")
    p = split_oversized(chunks, limits).select("id", "piece_no", "start", "end_", F.char_length("piece_text").alias("len"), F.lag("end_").over(w).alias("last")).join(big, "id")
    back = F.least("__overlap", F.col("__max") - 1)
    return p.groupBy("id").agg(
        F.max("__n").cast("long").alias("n_chars"),
        (F.max(F.col("end_") - F.col("start")) <= F.max("__max")).alias("within"),
        ((F.min("start") == 0) & (F.max("end_") == F.max("__n")) & F.bool_and(F.coalesce(F.col("start") <= F.col("last"), F.lit(True)))).alias("covering"),
        F.bool_and((F.col("len") == F.col("end_") - F.col("start")) & F.coalesce(F.col("last") - F.col("start") == back, F.lit(True))).alias("overlapping"),
    )


def split_files(spark: SparkSession, paths: Iterable[str], limit: int, overlap: int, range_bytes: int = 64 << 20, halo: int = 4096) -> DataFrame:
    """(path, start, end_): pieces of UTF-8 files in bytes, for files too large to load.

    ``paths`` may be local or of any file system that Arrow opens by its address (hdfs://, s3://, file://). Workers read
    byte ranges with their halos and never a whole file; a halo grows over the run of blanks that a border cuts. The
    boundary tables of a file are stitched in order in one task, which holds the boundaries of one piece. Limits count
    bytes here; where a file has no boundary within a limit, the cut may fall inside a code point.
    """

    def opened(path: str):
        files, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return files.open_input_file(name)

    def sized(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                with opened(path) as fh:
                    n = fh.size()
                yield pd.DataFrame({"path": path, "n": n, "r": range(max(1, -(-n // range_bytes)))})

    names = spark.createDataFrame([(x,) for x in paths], "path string").distinct()
    ranges = names.mapInPandas(sized, "path string, n long, r long").repartition("path", "r")

    def read(fh, a: int, b: int) -> str:
        # Latin-1 keeps offsets equal to bytes; what it takes for blanks are parts of letters
        return fh.read_at(max(0, b - a), a).decode("latin-1").translate({0x85: "x", 0xA0: "x"})

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, n, r in f.itertuples(index=False):
                lo, hi = r * range_bytes, min(n, (r + 1) * range_bytes)
                with opened(path) as fh:
                    left = right = halo
                    while True:
                        back, ahead = open_context(read(fh, max(0, lo - left), lo), read(fh, hi, min(n, hi + right)))
                        if back >= left < lo:
                            left *= 8
                        elif ahead >= right < n - hi:
                            right *= 8
                        else:
                            break
                    base = max(0, lo - left)
                    a, k = boundaries(read(fh, base, min(n, hi + right)), path.rsplit(".", 1)[-1].lower() in CODE_SUFFIXES, base, lo - base, hi - base)
                yield pd.DataFrame({"path": [path], "n": [n], "r": [r], "at": [a], "rank": [k]})

    tables = ranges.mapInPandas(find, "path string, n long, r long, at array<long>, rank array<int>").repartition("path").sortWithinPartitions("path", "r")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, stitch = None, None
        for f in frames:
            out = []
            for p, n, r, a, k in f.itertuples(index=False):
                if p != path:
                    out += [(path, *x) for x in stitch.close()] if stitch else []
                    path, stitch = p, Stitcher(n, limit, overlap)
                out += [(p, *x) for x in stitch.feed(a, k, min(n, (r + 1) * range_bytes))]
            yield pd.DataFrame(out, columns=["path", "start", "end_"])
        if stitch:
            yield pd.DataFrame([(path, *x) for x in stitch.close()], columns=["path", "start", "end_"])

    return tables.mapInPandas(walk, "path string, start long, end_ long")
