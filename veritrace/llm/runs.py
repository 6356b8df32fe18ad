"""Maximal periodic runs of words.

A run is a stretch of consecutive words with smallest period ``q`` that is at
least ``max(least, times * q)`` words long and that no neighbouring word
extends. Runs are found by suffix trees: Ukkonen's tree of the words and of
their reversal, each with an Euler tour, whose least depth between two leaves is
their longest common extension, looked up in constant time. By the runs theorem
every run has a Lyndon root that is the longest Lyndon word at its start, in the
order of the words or in the opposite one. So there are at most two candidates
per word; each is extended to both sides by one lookup, and what is long enough
is a run.

Every window of ``WINDOW`` words of a run occurs again in it, ``q`` words before or
after, so a run lies within one maximal stretch of windows that occur more than once in the document.
Trees are built of those stretches only. Which windows repeat is told by
hashes, where a collision can only make a stretch longer; the trees compare
words themselves. Rows are worked on one by one, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrace.llm import words
from veritrace.llm.base import table, text_or_empty

LEAST, TIMES = 24, 3
RUNS = "array<struct<start:long,length:long,period:long>>"


class SuffixTree:
    """Ukkonen's tree of a list of positive numbers, online and linear, closed by the symbol 0."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        self.size = n = len(text)
        start, end, link = [0], [0], [0]
        children: list[dict[int, int] | None] = [{}]
        node = edge = length = rest = 0
        for i, symbol in enumerate(text):
            rest += 1
            unlinked = 0
            while rest:
                if not length:
                    edge = i
                head = text[edge]
                child = children[node].get(head)
                if child is None:
                    children[node][head] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    children.append(None)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    span = end[child] - start[child]
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[start[child] + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    split = len(start)
                    children[node][head] = split
                    start += [start[child], i]
                    end += [start[child] + length, n]
                    link += [0, 0]
                    start[child] += length
                    children += [{symbol: split + 1, text[start[child]]: child}, None]
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self._children = children
        self._spans = [b - a for a, b in zip(start, end)]

    def tour(self, opposite: bool = False) -> tuple[list[int], list[int], list[int]]:
        """Depths along the Euler tour, and the leaves (where their suffix starts) with their places
        on it. Children come in the order of their symbols, or the opposite one; the closing 0 is least in both."""
        children, spans, n = self._children, self._spans, self.size

        def ordered(v: int) -> Iterator[int]:
            own = children[v]
            return iter([own[s] for s in sorted(own, key=(lambda s: -s if s else -n * n - (1 << 62)) if opposite else None)])

        depths, leaves, places = [0], [], []
        stack = [(0, ordered(0))]
        while stack:
            depth, left = stack[-1]
            for child in left:
                below = depth + spans[child]
                depths.append(below)
                if children[child] is None:
                    leaves.append(n - below)
                    places.append(len(depths) - 1)
                    depths.append(depth)
                    continue
                stack.append((below, ordered(child)))
                break
            else:
                stack.pop()
                if stack:
                    depths.append(stack[-1][0])
        return depths, leaves, places


class Extension:
    """Longest common extensions of pairs of places, in constant time each."""

    def __init__(self, tree: SuffixTree):
        depths, leaves, places = tree.tour()
        self.rank = np.empty(tree.size, dtype=np.int64)
        self.rank[leaves] = np.arange(tree.size)
        # Between two leaves the tour is as low as their lowest common ancestor; only the
        # least depth between neighbouring leaves is kept for the table of minima.
        low = np.minimum.reduceat(np.array(depths, dtype=np.int32), places)[:-1] if tree.size > 1 else np.zeros(0, dtype=np.int32)
        self.minima = [low]
        step = 1
        while 2 * step <= len(low):
            held = self.minima[-1]
            self.minima.append(np.minimum(held[: len(held) - step], held[step:]))
            step *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        out = np.zeros(len(i), dtype=np.int64)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            own = self.minima[k]
            out[at] = np.minimum(own[a[at]], own[b[at] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each suffix the next one that is smaller: where the longest Lyndon word at its start ends."""
    out, stack = np.empty(len(rank), dtype=np.int64), []
    for i in range(len(rank) - 1, -1, -1):
        own = rank[i]
        while stack and rank[stack[-1]] > own:
            stack.pop()
        out[i] = stack[-1] if stack else len(rank)
        stack.append(i)
    return out


def find_runs(symbols: list[int], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs of positive numbers, by start, then period.
    ``times`` is at least 2."""
    n = len(symbols)
    if n < max(least, times):
        return np.zeros((0, 3), dtype=np.int64)
    tree = SuffixTree(symbols)
    ahead, behind = Extension(tree), Extension(SuffixTree(symbols[::-1]))
    opposite = np.empty(tree.size, dtype=np.int64)
    opposite[tree.tour(opposite=True)[1]] = np.arange(tree.size)
    i = np.tile(np.arange(n), 2)
    p = np.concatenate([_next_smaller(r.tolist())[:n] for r in (ahead.rank, opposite)]) - i
    fits = p * times <= n
    i, p = i[fits], p[fits]
    # The closing symbol is in no extension, so a place at the end extends by nothing.
    right = ahead(i, i + p)
    left = np.zeros(len(i), dtype=np.int64)
    inner = i > 0
    left[inner] = behind(n - i[inner], n - i[inner] - p[inner])
    start, length = i - left, left + p + right
    long = length >= np.maximum(least, times * p)
    found = np.unique(np.column_stack([start, p, length])[long], axis=0)
    return found[:, [0, 2, 1]]


def _stretches(h: np.ndarray, counts: np.ndarray, window: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, first word, end word) of the stretches in which each window repeats."""
    at, row, place = words.window_places(counts, window)
    if not len(at):
        return
    key = words.mix(words.join_hashes(h, window)[at] + words.mix(row.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at) + 1, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    first = again[:-1].copy()
    first[1:] &= ~again[:-2] | (row[1:] != row[:-1])
    begins = np.flatnonzero(first)
    stops = again[:-1].copy()
    stops[:-1] &= ~again[1:-1] | (row[1:] != row[:-1])
    ends = np.flatnonzero(stops)
    long = ends - begins + window >= least
    for a, b in zip(begins[long], ends[long]):
        yield int(row[a]), int(place[a]), int(place[b]) + window


def _found(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    window = max(1, least // times)
    hasher = words.Hasher(41)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
        texts = batch["text"]
        for at, _, buf, offsets in words.pieces(texts):
            starts, ends, counts = words.spans(buf, offsets)
            first = np.concatenate([[0], np.cumsum(counts)])
            for row, a, b in _stretches(hasher.words(buf, starts, ends), counts, window, least):
                own = slice(first[row] + a, first[row] + b)
                known: dict[bytes, int] = {}
                symbols = [known.setdefault(bytes(buf[s:e]), len(known) + 1) for s, e in zip(starts[own], ends[own])]
                runs[at + row] += [(a + s, n, p) for s, n, p in find_runs(symbols, least, times).tolist()]
        collapsed = []
        for text, own in zip(texts.to_pylist(), runs):
            tokens = (text or "").encode().split()
            if own:
                gone = np.zeros(len(tokens) + 1, dtype=np.int64)
                for s, n, p in own:
                    gone[s + p] += 1
                    gone[s + n] -= 1
                tokens = [t for t, g in zip(tokens, np.cumsum(gone)) if not g]
            collapsed.append(b" ".join(tokens).decode())
        told = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], kind)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], told, pa.array(collapsed, pa.string())], names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, runs (start, length, period; by
    start, then period) and collapsed (the words outside repeated periods, joined by one space).

    ``times`` is 3 or more, and ``least`` at least twice that. Words are compared as they are. Null and empty texts
    have no words and no runs. Repeated rows and ids, and null ids, are each a row of their own. A text of
    any length is handled whole, in memory in proportion to it. An empty table gives no rows. Other columns are not read.
    """
    if times < 3 or least < 2 * times:
        raise ValueError("times must be 3 or more, and least at least twice that")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(lambda it: _found(it, least, times), f"doc_id long, runs {RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """The result columns: the number of runs, the one of greatest length per period, and digests."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda best, r: F.when(better(best, r), r).otherwise(best)).alias("best")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, lines.alias("lines"), "collapsed")
    return told.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.encode(F.concat(F.array_join("lines", "\n"), F.when(F.size("lines") > 0, "\n").otherwise("")), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def planted(doc_id: Column, text: Column) -> Column:
    """The text of the query: every tenth id repeats a stretch of its words to the end. Null ids do not."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    own = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        spot = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(w, (1 + spot(i)).cast("int"))), " ")

    # The words are the variable of a lambda, so they are taken out of the text once.
    return F.when((h % 10 == 0) & (F.size(own) > 0), F.transform(F.array(own), repeated)[0]).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    return digest(periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))


SQL = r"""
WITH c AS (
    SELECT doc_id, coalesce(text, '') AS text,
           xor(4294967295, list_reduce(list_concat([4294967295], flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(doc_id AS VARCHAR), '')])),
               lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END)) AS h
    FROM documents
), w AS (
    SELECT doc_id, h, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM c
), g AS (
    SELECT doc_id, h, ws, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM w
), s AS (
    SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
        THEN [ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END] FOR i IN range(n)] ELSE ws END AS ws
    FROM g
), k AS (
    SELECT doc_id, i, array_to_string(ws[i + 1:i + 8], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(len(ws) - 7)) AS i FROM s WHERE len(ws) >= 24)
), e AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.t = y.t AND y.i > x.i
), island AS (
    SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS d FROM e) GROUP BY doc_id, q, d
), r AS (
    SELECT doc_id, start, length, min(q) AS period FROM island WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), kept AS (
    SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS t
    FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM s) x LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY x.doc_id
), best AS (
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1
), told AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id
)
SELECT s.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM s LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
