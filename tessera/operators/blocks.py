"""Postings in blocks: chunks of equal content are one column of a block, a task scores all queries against one block.

Pairs of a query and a chunk never travel. A block is made of the token lists of its contents (rows of equal path and
text) and holds its postings by term; a task keeps one block, the terms of the queries stream past it, and out come all
pairs of a query (:func:`pairs`) or only those that can be among its best (:func:`best`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BUILT = "block int, terms array<string>, df array<bigint>, starts array<int>, docs array<int>, tf array<int>, weighted_tf array<int>, lengths array<int>, ord_starts array<int>, ords array<bigint>"
SCORED = "qtext string, chunk_ord array<bigint>, bm25 array<double>, cosine array<double>"
#: Pairs that are handed over at once, about.
BATCH = 500_000


def size(chunks: int) -> int:
    """Chunks a block is meant to hold: enough blocks for many tasks, but each query meets every block."""
    return min(max(chunks // 12, 4096), 32768)


def _flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The elements of all rows and the number of them in each row."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the ranges that begin at ``starts`` and hold ``counts`` elements, one after the other."""
    return np.repeat(starts - _starts(counts)[:-1], counts) + np.arange(int(counts.sum()))


def build(repeat: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``block, ords, t, p`` (chunks of a content, tokens of path and text, tokens of the path) into one row of ``BUILT`` for each block."""

    def counted(rows: pa.RecordBatch) -> dict:
        """Postings of some rows, by the places of their own terms."""
        (body, n), (path, m), (ords, k) = (_flat(rows.column(c)) for c in ("t", "p", "ords"))
        coded = pa.concat_arrays([body, path]).dictionary_encode()
        term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), m)])
        key, place = np.unique(term * len(n) + doc, return_inverse=True)
        inside = np.arange(len(place)) < len(body)
        sums = [np.bincount(place, weights=w, minlength=len(key)).astype(np.int32) for w in (inside, np.where(inside, 1, repeat))]
        return {"terms": coded.dictionary, "term": key // len(n), "doc": (key % len(n)).astype(np.int32), "tf": sums[0], "weighted": sums[1], "n": n, "k": k, "ords": ords.to_numpy(zero_copy_only=False)}

    def joined(b: int, parts: list[dict]) -> pa.RecordBatch:
        terms = pc.unique(pa.chunked_array([p["terms"] for p in parts], pa.string())).cast(pa.string())
        every = lambda name: np.concatenate([p[name] for p in parts])
        term = np.concatenate([pc.index_in(p["terms"], value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64)[p["term"]] for p in parts])
        before = _starts(np.array([len(p["n"]) for p in parts]))
        docs = np.concatenate([p["doc"] + np.int32(x) for p, x in zip(parts, before)])
        k, line = every("k"), np.argsort(term, kind="stable")
        df = np.bincount(term, weights=k[docs], minlength=len(terms))
        lists = {
            "df": df.astype(np.int64), "starts": _starts(np.bincount(term, minlength=len(terms))).astype(np.int32), "docs": docs[line], "tf": every("tf")[line], "weighted_tf": every("weighted")[line],
            "lengths": every("n").astype(np.int32), "ord_starts": _starts(k).astype(np.int32), "ords": every("ords").astype(np.int64),
        }
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), listed(terms), *map(listed, lists.values())], names=["block", "terms", *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[dict]] = {}
        for batch in batches:
            for b in pc.unique(batch.column("block")).to_pylist():
                parts.setdefault(b, []).append(counted(batch.filter(pc.equal(batch.column("block"), b))))
        for b in sorted(parts):
            yield joined(b, parts.pop(b))

    return run


class Block:
    """A block made ready for scores: ``a`` and ``b`` are the parts of BM25 and cosine that don't depend on the query."""

    def __init__(self, row: pa.RecordBatch, k1: float, b: float) -> None:
        get = lambda name: row.column(name).flatten().to_numpy(zero_copy_only=False)
        self.terms, self.docs, self.ords = row.column("terms").flatten(), get("docs"), get("ords")
        self.starts, self.ord_starts = get("starts").astype(np.int64), get("ord_starts").astype(np.int64)
        tf, length = get("tf").astype(np.float64), get("lengths").astype(np.float64)
        self.n, mean = len(length), row.column("mean")[0].as_py() or 1.0
        self.a = tf * (k1 + 1) / (tf + (k1 * (1 - b + b * length / mean))[self.docs])
        weight = get("weighted_tf") * np.repeat(get("idf_tfidf"), np.diff(self.starts))
        norm = np.sqrt(np.bincount(self.docs, weights=weight * weight, minlength=self.n))
        self.b = get("weighted_tf") / norm[self.docs]

    def scores(self, terms: np.ndarray, qa: np.ndarray, qb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BM25 and cosine of all contents with a query of ``terms`` (places in this block)."""
        counts = self.starts[terms + 1] - self.starts[terms]
        at = _places(self.starts[terms], counts)
        docs = self.docs[at]
        return np.bincount(docs, np.repeat(qa, counts) * self.a[at], self.n), np.bincount(docs, np.repeat(qb, counts) * self.b[at], self.n)

    def chunks(self, contents: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of ``contents``, of each the first ``most``, and how many of each."""
        counts = self.ord_starts[contents + 1] - self.ord_starts[contents]
        counts = counts if most is None else np.minimum(counts, most)
        return self.ords[_places(self.ord_starts[contents], counts)], counts

    def pairs(self, bm25: np.ndarray, cosine: np.ndarray, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = np.flatnonzero(cosine)
        ords, counts = self.chunks(found)
        x, y = bm25[found], cosine[found]
        x, y = (x, y) if digits is None else (np.round(x, digits), np.round(y, digits))
        return ords, np.repeat(x, counts), np.repeat(y, counts)

    def best(self, bm25: np.ndarray, cosine: np.ndarray, top: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunks that are among the ``top`` by one of the two rounded scores, ties to the earlier chunk."""
        found = np.flatnonzero(cosine)
        x, y, keep = bm25[found], cosine[found], []
        for s in (x, y):
            # Rounding never turns scores round, so that what is less by more than a unit stays behind.
            near = np.arange(len(s)) if len(s) <= top else np.flatnonzero(s >= np.partition(s, len(s) - top)[len(s) - top] - 2 * 10.0**-digits)
            ords, counts = self.chunks(found[near], top)
            first = np.lexsort((ords, -np.repeat(np.round(s[near], digits), counts)))[:top]
            keep.append((ords[first], np.repeat(near, counts)[first]))
        ords, where = np.unique(np.concatenate([keep[0][0], keep[1][0]]), return_index=True)
        of = np.concatenate([keep[0][1], keep[1][1]])[where]
        return ords, np.round(x[of], digits), np.round(y[of], digits)


def score(k1: float, b: float, digits: int | None, top: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a block's row (``qtext`` null) and queries (``qtext, terms, qa, qb``) behind it: ``SCORED``, one row of each query with
    a common term; all its pairs, or those that are among the ``top`` of the block by either score."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array(_starts(np.array([len(r[1]) for r in rows])), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), *[pa.ListArray.from_arrays(at, pa.array(np.concatenate([r[i] for r in rows]), kind)) for i, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()))]],
            names=["qtext", "chunk_ord", "bm25", "cosine"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, held = None, [], 0
        for batch in batches:
            own = pc.is_null(batch.column("qtext"))
            if pc.any(own).as_py():
                block = Block(batch.filter(own), k1, b)
                batch = batch.filter(pc.invert(own))
            if block is None or not len(batch):
                continue
            terms, n = _flat(batch.column("terms"))
            place = pc.fill_null(pc.index_in(terms, value_set=block.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            qa, qb = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("qa", "qb"))
            ends = _starts(n)
            for i, name in enumerate(batch.column("qtext").to_pylist()):
                mine = slice(ends[i], ends[i + 1])
                known = place[mine] >= 0
                if not known.any():
                    continue
                bm25, cosine = block.scores(place[mine][known], qa[mine][known], qb[mine][known])
                out = block.pairs(bm25, cosine, digits) if top is None else block.best(bm25, cosine, top, digits)
                rows.append((name, *out))
                held += len(out[0])
                if held >= BATCH:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    return run
