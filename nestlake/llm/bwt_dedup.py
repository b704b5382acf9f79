"""Suffix-array deduplication: remove every string of LENGTH bytes that an earlier document has.

Method: column-wise construction of the Burrows-Wheeler transform of a collection. Each
round inserts one more symbol of every string: the rank of the symbol in the transform so
far is the place of the next longer suffix, and its common prefix with its neighbours
follows from a range minimum over the old ones. The columns (transform, common prefixes,
string numbers) are read and written front to back once a round; large ones are kept in
temporary files that vanish with the task. Runs of common prefixes of at least LENGTH
then hold the suffixes that begin alike, and the smallest document of a run decides.

Whole documents would need as many rounds as the longest has bytes, each over all text.
So the collection is cut first, without losing a string: every LENGTH-byte window belongs
to its minimizer (the smallest hash of its GRAM-byte strings), windows in a row with one
minimizer make a piece, and equal windows meet in the bucket of their minimizer. Pieces
are shorter than 2 * LENGTH, so a bucket takes fewer rounds than that.

 1. documents are dealt to packs; a pack reports its minimizers (40 bits, counts)
 2. a minimizer that only one document of the corpus has cannot repeat: its pieces stay home
 3. packs send each different piece once, with its first document; later documents of the
    same pack have the whole piece removed at once
 4. buckets build the transform of the pieces that share a window hash with a different
    piece (equal pieces are one string already) and return spans to the packs, which
    merge and cut

A minimizer in more than HOT documents sends single windows by their own hash, so a
passage that a third of all documents share is spread over buckets, and each window
arrives at most once from a pack. The texts are shuffled once; that exchange is reused.

Defined results: null counts as empty; texts under LENGTH bytes lose nothing; very long texts
are cut in blocks; rows that repeat a doc_id (ties) do not count as earlier than each other;
a row without doc_id is earlier and later than nothing and loses nothing; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 50, 20
WIDTH = LENGTH - GRAM + 1
#: Documents and bytes in a pack about; documents from which a minimizer is hot.
PACK_DOCS, PACK_BYTES, HOT = 1000, 6 << 20, 2000
#: Packs that one task of an exchange takes about, and whose pieces a bucket holds at large sizes.
TASK_PACKS = 4
#: Buckets that a small table is cut into, as far as it has packs, so that tasks are even.
LEAST_BUCKETS = 64
#: Window starts whose hashes are held at once.
BLOCK = 1 << 17
#: Bytes of a column from which it is kept in a temporary file between rounds.
IN_MEMORY = 1 << 20

U = np.uint64
CODES = np.random.Generator(np.random.PCG64(19991231)).integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- the transform


class Column:
    """An array that is written and read front to back, in a temporary file when it is large."""

    def __init__(self, data: np.ndarray):
        self.put(data)

    def put(self, data: np.ndarray) -> None:
        self.kind, self.size, self.data, self.file = data.dtype, len(data), data, None
        if data.nbytes > IN_MEMORY:
            self.file = tempfile.TemporaryFile()
            data.tofile(self.file)
            self.data = None

    def get(self) -> np.ndarray:
        if self.file is None:
            return self.data
        self.file.seek(0)
        return np.fromfile(self.file, self.kind, self.size)


def _merge(old: np.ndarray, stays: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``new`` at places ``at``, the old values in order at the places that are true in ``stays``."""
    out = np.empty(len(stays), old.dtype)
    out[stays] = old
    out[at] = new
    return out


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi], both ends included, for each pair."""
    if not len(lo):
        return np.zeros(0, values.dtype)
    padded = np.concatenate([values, np.full(1, 255, values.dtype)])
    return np.minimum.reduceat(padded, np.stack([lo, hi + 1], 1).ravel())[::2]


def transform(strings: list[bytes], cap: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, common prefixes with the row before (up to ``cap``), string and length of each suffix.

    Rows are all suffixes in order, the empty ones first. Symbol 0 stands for a string's
    beginning, others for their rank among the bytes that occur, plus one.
    """
    n = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(lengths)
    used = np.unique(data)
    code = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
    code[used] = np.arange(1, len(used) + 1)
    text = code[data]

    def before(which: np.ndarray, length: int) -> np.ndarray:
        """Symbol in front of the suffix of that length."""
        has = lengths[which] > length
        return np.where(has, text[np.where(has, ends[which] - length - 1, 0)], 0).astype(text.dtype) if len(text) else np.zeros(len(which), np.uint8)

    every = np.arange(n)
    symbols, prefixes = Column(before(every, 0)), Column(np.zeros(n, np.uint8))
    place, active = every.copy(), every[lengths > 0]
    longest = int(lengths.max(initial=0))
    for length in range(1, longest + 1):
        b, lcp = symbols.get(), prefixes.get()
        order = np.argsort(b, kind="stable")
        rank = np.empty(len(b), np.int32)
        rank[order] = np.arange(len(b), dtype=np.int32)
        row = place[active]
        t = rank[row].astype(np.int64)
        by = np.argsort(t)
        active, row, t = active[by], row[by], t[by]
        begun = int(np.count_nonzero(lengths < length))  # strings whose first symbol is in already
        at = t - begun + n
        mine = b[row]
        up = order[t - 1]
        linked = (t > 0) & (b[up] == mine)
        new = np.zeros(len(row), np.uint8)
        new[linked] = np.minimum(_range_min(lcp, up[linked] + 1, row[linked]).astype(np.int64) + 1, cap)
        down = order[np.minimum(t + 1, len(b) - 1)]
        moved = (t + 1 < len(b)) & (b[down] == mine) & (np.append(t[1:], -1) != t + 1)  # an old row comes next
        nxt = np.minimum(_range_min(lcp, row[moved] + 1, down[moved]).astype(np.int64) + 1, cap)
        stays = np.ones(len(b) + len(at), bool)
        stays[at] = False
        lcp = _merge(lcp, stays, at, new)
        lcp[at[moved] + 1] = nxt
        symbols.put(_merge(b, stays, at, before(active, length)))
        prefixes.put(lcp)
        place[active] = at
        active = active[lengths[active] > length]
    # Which suffix a row is follows from the transform alone: walk from each empty suffix to longer ones.
    b = symbols.get()
    ahead = np.empty(len(b), np.int64)
    ahead[np.argsort(b, kind="stable")] = np.arange(len(b)) + n - np.count_nonzero(b == 0)
    owner, size = np.empty(len(b), np.int64), np.zeros(len(b), np.int64)
    owner[:n] = every
    row, active = every, every[lengths > 0]
    for length in range(1, longest + 1):
        row = ahead[row[lengths[owner[row]] >= length]]
        active = active[lengths[active] >= length]
        owner[row], size[row] = active, length
    return b, prefixes.get(), owner, size


def sharing(strings: list[bytes]) -> np.ndarray:
    """True where a string has a window whose hash another string has too: the others need no transform."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    count = np.maximum(0, lengths - LENGTH + 1)
    owner = np.repeat(np.arange(len(strings)), count)
    if len(owner) < 2:
        return np.zeros(len(strings), bool)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.repeat(first, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        window = gram_hashes(np.frombuffer(b"".join(strings), np.uint8), LENGTH)[at]
    order = np.argsort(window, kind="stable")
    window, owner = window[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    several = np.minimum.reduceat(owner, heads) < np.maximum.reduceat(owner, heads)
    out = np.zeros(len(strings), bool)
    out[owner[np.repeat(several, np.diff(np.append(heads, len(owner))))]] = True
    return out


def first_documents(strings: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every string (in order): the smallest of ``docs`` among strings that hold it.

    Returns the values and where each string's begin. Strings must differ.
    """
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    count = np.maximum(0, lengths - LENGTH + 1)
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.repeat(docs, count)
    picked = np.flatnonzero(sharing(strings))
    if not len(picked):
        return out, begin
    _, lcp, owner, size = transform([strings[i] for i in picked.tolist()])
    owner = picked[owner]
    heads = np.flatnonzero(lcp < LENGTH)
    low = np.minimum.reduceat(docs[owner], heads)
    each = np.repeat(low, np.diff(np.append(heads, len(lcp))))
    whole = size >= LENGTH
    out[begin[owner[whole]] + lengths[owner[whole]] - size[whole]] = each[whole]
    return out, begin


# ---------------------------------------------------------------- cutting texts into pieces


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k bytes, from hashes of powers of two."""
    done, held, step, part = 0, None, 1, CODES[data]
    while k >> done:
        if k >> done & 1:
            if held is None:
                held, have = part, step
            else:
                m = len(data) - have - step + 1
                held, have = held[:m] * U(pow(BASE, step, 2**64)) + part[have : have + m], have + step
        done += 1
        if k >> done:
            m = len(part) - step
            part, step = part[:m] * U(pow(BASE, step, 2**64)) + part[step : step + m], step * 2
    x = (held ^ (held >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, x
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Bytes of texts laid end to end, and for each its place there, number of windows, row and offset.

    Long texts come in overlapping parts, so that a block has a bounded size.
    """
    held, size = [], 0
    parts = ((r, a, t[a : a + BLOCK + LENGTH - 1]) for r, t in enumerate(texts) for a in range(0, max(0, len(t) - LENGTH + 1), BLOCK))

    def whole():
        count = np.fromiter((len(t) - LENGTH + 1 for _, _, t in held), np.int64, len(held))
        first = np.concatenate([[0], np.cumsum(count + LENGTH - 1)[:-1]])
        row, start = (np.fromiter((x[k] for x in held), np.int64, len(held)) for k in (0, 1))
        return np.frombuffer(b"".join(t for _, _, t in held), np.uint8), first, count, row, start

    for part in parts:
        held.append(part)
        size += len(part[2])
        if size >= BLOCK:
            yield whole()
            held, size = [], 0
    if held:
        yield whole()


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Minimizer, row, first window and number of windows of each piece; the block's bytes and the piece's place there.

    Rows never decrease.
    """
    for data, first, windows, row, start in blocks(texts):
        low = sliding_min(gram_hashes(data, GRAM), WIDTH)
        edge = np.flatnonzero(low[1:] != low[:-1]) + 1
        edge = np.union1d(edge, first)
        part = np.searchsorted(first, edge, "right") - 1
        last = first[part] + windows[part]
        inside = edge < last  # behind it windows would reach into the next text
        end = np.minimum(np.append(edge[1:], len(low)), last)[inside]
        edge, part = edge[inside], part[inside]
        count = end - edge
        cuts = -(-count // WIDTH)  # periodic text: cut what is too long
        if cuts.max(initial=1) > 1:
            nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            edge, part, end = np.repeat(edge, cuts) + nth * WIDTH, np.repeat(part, cuts), np.repeat(end, cuts)
            count = np.minimum(WIDTH, end - edge)
        yield low[edge], row[part], start[part] + edge - first[part], count, data, edge


def rows_of(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """doc_ids and texts of a pack, in one order every time."""
    docs = table.column("doc_id").to_pylist()
    texts = [t or b"" for t in table.column("text").cast(pa.large_binary()).to_pylist()]
    order = sorted(range(len(docs)), key=lambda i: (docs[i], texts[i]))
    return [docs[i] for i in order], [texts[i] for i in order]


def reported(found: list[tuple[np.ndarray, ...]], docs: list[int], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From ``runs``: bucket and low 40 bits of each different minimizer as one sorted key, number of
    documents that have it, and each run's place among the keys."""
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    low, row = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    doc = np.unique(np.array(docs, np.int64), return_inverse=True)[1][row]
    bucket, rest = bucket_of(low, n_buckets)
    key = bucket.astype(np.uint64) << U(40) | rest
    order = np.argsort(key, kind="stable")  # documents of one key stay in their order
    key, doc = key[order], doc[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    other = first | np.concatenate([[True], doc[1:] != doc[:-1]])
    heads = np.flatnonzero(first)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(first) - 1
    return key[heads], np.minimum(255, np.add.reduceat(other.astype(np.int64), heads)).astype(np.uint8), place


def bucket_of(low: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((low >> U(32)) % U(n_buckets)).astype(np.int64), low & U((1 << 40) - 1)


def five(values: np.ndarray) -> bytes:
    """Numbers below 2^40 in five bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_five(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


# ---------------------------------------------------------------- the steps on Spark


def report_minimizers(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        pack = table.column("pack")[0].as_py()
        docs, texts = rows_of(table)
        with np.errstate(over="ignore"):
            key, count, _ = reported(list(runs(texts)), docs, n_buckets)
        bucket, rest = (key >> U(40)).astype(np.int64), key & U((1 << 40) - 1)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(bucket))
        rows = [(int(bucket[a]), pack, five(rest[a:b]), count[a:b].tobytes()) for a, b in zip(cut.tolist(), ends.tolist(), strict=False)]
        return _table(rows, [("bucket", pa.int64()), ("pack", pa.int64()), ("low", pa.binary()), ("count", pa.binary())])

    return run


def _table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def judge_minimizers(table: pa.Table) -> pa.Table:
    """0: in one document only; 1: in several; 2: hot. Answers keep the order of the questions."""
    order = np.argsort(np.array(table.column("pack").to_pylist(), np.int64), kind="stable")
    packs, lows, counts = (table.column(c).to_pylist() for c in ("pack", "low", "count"))
    low = np.concatenate([from_five(x) for x in lows])
    count = np.concatenate([np.frombuffer(x, np.uint8) for x in counts]).astype(np.int64)
    _, which = np.unique(low, return_inverse=True)
    total = np.bincount(which, weights=count)[which]
    flag = np.where(total > HOT, 2, np.where(total > 1, 1, 0)).astype(np.uint8)
    cut = np.concatenate([[0], np.cumsum([len(x) for x in counts])])
    bucket = table.column("bucket")[0].as_py()
    rows = [(packs[i], bucket, zlib.compress(flag[cut[i] : cut[i + 1]].tobytes(), 1)) for i in order.tolist()]
    return _table(rows, [("pack", pa.int64()), ("bucket", pa.int64()), ("flags", pa.binary())])


PIECES = [("bucket", pa.int64()), ("pack", pa.int64()), ("strings", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary()), ("seen", pa.binary())]


def send_pieces(n_buckets: int, n_judges: int):
    def run(texts_table: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts_table.num_rows or not answers.num_rows:
            return _table([], PIECES)
        pack = texts_table.column("pack")[0].as_py()
        docs, texts = rows_of(texts_table)
        with np.errstate(over="ignore"):
            found = list(runs(texts))
            _, _, place = reported(found, docs, n_judges)
            told = dict(zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist(), strict=True))
            flags = np.frombuffer(b"".join(zlib.decompress(told[b]) for b in sorted(told)), np.uint8)[place]
            out: dict[bytes, list] = {}  # piece -> [bucket, first doc, places of that doc]
            gone: list[tuple[int, int, int]] = []  # row, start, end of what a later document of the pack has
            done = 0
            for low, row, start, count, data, at in found:
                flag = flags[done : done + len(low)]
                done += len(low)
                picked = flag == 1
                hot = np.flatnonzero(flag == 2)
                own = np.zeros(0, np.uint64)
                if len(hot):  # single windows, by their own hash
                    own = gram_hashes(data, LENGTH)
                lows = (low % U(n_buckets)).astype(np.int64)
                raw = data.tobytes()
                todo = [(raw[a : a + c + LENGTH - 1], k, i, s) for a, c, k, i, s in zip(*(x[picked].tolist() for x in (at, count, lows, row, start)), strict=True)]
                for a, c, i, s in zip(*(x[hot].tolist() for x in (at, count, row, start)), strict=True):
                    todo += [(raw[a + j : a + j + LENGTH], int(own[a + j]) % n_buckets, i, s + j) for j in range(c)]
                for piece, k, i, s in todo:
                    doc, held = docs[i], out.get(piece)
                    if held is None:
                        out[piece] = [k, doc, [(i, s)]]
                    elif held[1] == doc:
                        held[2].append((i, s))
                    elif held[1] < doc:
                        gone.append((i, s, s + len(piece)))
                    else:
                        gone += [(j, u, u + len(piece)) for j, u in held[2]]
                        held[1:] = doc, [(i, s)]
        groups: dict[int, list] = {}
        for piece, (k, doc, places) in out.items():
            groups.setdefault(k, []).append((piece, doc, places))
        rows = []
        for k, members in groups.items():
            members.sort()
            seen = np.array([(n, i, s) for n, (_, _, places) in enumerate(members) for i, s in places], np.uint32)
            rows.append(
                (
                    k, pack, zlib.compress(b"".join(p for p, _, _ in members), 1), bytes(len(p) for p, _, _ in members),
                    np.array([d for _, d, _ in members], np.int64).tobytes(), zlib.compress(np.ascontiguousarray(seen.T).tobytes(), 1),
                )
            )
        if gone:  # passes through a bucket of its own
            rows.append((n_buckets + pack, pack, b"", b"", b"", zlib.compress(merged(np.array(gone, np.int64)).astype(np.uint32).T.tobytes(), 1)))
        return _table(rows, PIECES)

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans (row, start, end) from overlapping or touching ones."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    row, start, end = spans.T
    # Ends of earlier rows lie below every start of later ones once rows are laid end to end.
    shift = row * (end.max() + 1)
    reach = np.maximum.accumulate(shift + end)
    head = np.flatnonzero(np.concatenate([[True], (shift + start)[1:] > reach[:-1]]))
    last = np.append(head[1:], len(spans)) - 1
    return np.stack([row[head], start[head], reach[last] - shift[head]], 1)


def match_pieces(n_buckets: int):
    fields = [("pack", pa.int64()), ("spans", pa.binary())]

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= n_buckets:
            return _table([(p, s) for p, s in zip(table.column("pack").to_pylist(), table.column("seen").to_pylist(), strict=True)], fields)
        number: dict[bytes, int] = {}
        first: list[int] = []
        places = []
        for pack, strings, sizes, docs, seen in zip(*(table.column(c).to_pylist() for c in ("pack", "strings", "sizes", "docs", "seen")), strict=True):
            data, at, which = zlib.decompress(strings), 0, []
            docs = np.frombuffer(docs, np.int64)
            for size, doc in zip(sizes, docs.tolist(), strict=True):
                k = number.setdefault(data[at : at + size], len(first))
                at += size
                which.append(k)
                if k == len(first):
                    first.append(doc)
                elif doc < first[k]:
                    first[k] = doc
            places.append((pack, np.array(which), docs, np.frombuffer(zlib.decompress(seen), np.uint32).reshape(3, -1).astype(np.int64)))
        strings, earliest = list(number), np.array(first, np.int64)
        low, begin = first_documents(strings, earliest)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        smallest = np.minimum.reduceat(low, begin[:-1])
        rows = []
        for pack, which, docs, (n, row, start) in places:
            k, doc = which[n], docs[n]
            whole = earliest[k] < doc  # another document has all of it
            spans = [np.stack([row, start, start + lengths[k]], 1)[whole]]
            for j in np.flatnonzero(~whole & (smallest[k] < doc)).tolist():
                hit = np.flatnonzero(low[begin[k[j]] : begin[k[j] + 1]] < doc[j])
                spans.append(np.stack([np.full(len(hit), row[j]), start[j] + hit, start[j] + hit + LENGTH], 1))
            found = merged(np.concatenate(spans))
            if len(found):
                rows.append((pack, zlib.compress(np.ascontiguousarray(found.astype(np.uint32).T).tobytes(), 1)))
        return _table(rows, fields)

    return run


RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]


def cut_texts(texts_table: pa.Table, found: pa.Table) -> pa.Table:
    docs, texts = rows_of(texts_table) if texts_table.num_rows else ([], [])
    spans = [np.frombuffer(zlib.decompress(s), np.uint32).reshape(3, -1).T for s in found.column("spans").to_pylist()]
    spans = merged(np.concatenate(spans).astype(np.int64)) if spans else np.zeros((0, 3), np.int64)
    lo = np.searchsorted(spans[:, 0], np.arange(len(docs) + 1))
    rows = []
    for i, (doc, text) in enumerate(zip(docs, texts, strict=True)):
        own = spans[lo[i] : lo[i + 1], 1:].tolist()
        ends, starts = [0, *(b for _, b in own)], [*(a for a, _ in own), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))
        rows.append((doc, len(text), len(text) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept))
    return _table(rows, RESULT)


def deduplicated(df: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (keep_bytes) the remaining bytes."""
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = rows.filter("doc_id is not null")
    common.arrow_rows(spark)
    count, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    packs = max(common.parts_for(count, PACK_DOCS, 1), common.parts_for(size, PACK_BYTES))
    parts = common.parts_for(packs, TASK_PACKS, common.shuffle_parts(spark))
    # Every pack sends a row to every bucket: these rows grow with the square of the packs, so buckets are as few as their tasks allow.
    n_buckets = n_judges = max(parts, min(packs, LEAST_BUCKETS))
    # One exchange: the three steps below read the same shuffle files.
    packed = docs.withColumn("pack", F.pmod(F.xxhash64("doc_id"), F.lit(packs))).repartition(parts, "pack")
    asked = packed.groupBy("pack").applyInArrow(report_minimizers(n_judges), "bucket long, pack long, low binary, count binary")
    told = asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(judge_minimizers, "pack long, bucket long, flags binary")
    sent = packed.groupBy("pack").cogroup(told.repartition(parts, "pack").groupBy("pack")).applyInArrow(
        send_pieces(n_buckets, n_judges), "bucket long, pack long, strings binary, sizes binary, docs binary, seen binary"
    )
    found = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(match_pieces(n_buckets), "pack long, spans binary")

    def last(texts_table: pa.Table, spans: pa.Table) -> pa.Table:
        out = cut_texts(texts_table, spans)
        return out if keep_bytes else out.drop_columns(["kept"])

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = packed.groupBy("pack").cogroup(found.repartition(parts, "pack").groupBy("pack")).applyInArrow(last, kind + (", kept binary" if keep_bytes else ""))
    text, none = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    whole = [F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256")]
    nameless = rows.filter("doc_id is null").select("doc_id", *whole, *([F.encode(text, "UTF-8").alias("kept")] if keep_bytes else []))
    return out.unionByName(nameless)


def op8_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents"), keep_bytes=False)


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS s FROM d WHERE length(h) >= 100)),
f AS (SELECT g, min(doc_id) AS first FROM k GROUP BY g),
hit AS (SELECT k.doc_id, k.s, k.s > coalesce(lag(k.s) OVER (PARTITION BY k.doc_id ORDER BY k.s) + 50, -1) AS new FROM k JOIN f USING (g) WHERE f.first < k.doc_id),
span AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM hit) GROUP BY doc_id, n),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS held FROM span),
kept AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * held + 1, 2 * (a - held)), '' ORDER BY a) || substr(max(h), 2 * max(b) + 1) AS rest FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
