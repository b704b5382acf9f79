"""Near-duplicate detection by minhash with tensored banding.

Two collections of SIDE blocks of DEPTH minhashes each are computed. A table key joins a
block of the first with a block of the second, so SIDE * SIDE tables of 2 * DEPTH minhashes
come from 2 * SIDE * DEPTH minhash functions instead of SIDE^2 * 2 * DEPTH: a square root.
Two sets meet in some table iff they share a block in both collections; at similarity s that
fails with probability 2 * (1 - s^DEPTH)^SIDE (5e-5 at 0.8, 8e-7 at 0.85), and sets of
similarity 0.3 or less, as texts of one language have, meet in 2 % of the cases or fewer.

Steps:

 1. texts with one sequence of words are folded (128 bits of a cryptographic hash)
 2. blocks that one document alone has cannot match and are dropped before keys are formed
 3. each pack of documents keeps one leader for a key and sends only leaders on, so a key
    that a third of all rows share arrives once from each pack; leaders and followers are
    candidate pairs, confirmed on the full shingle sets
 4. components follow by large-star and small-star rounds
 5. leaders may hide two followers from each other. A follower at SURE or more of its leader
    has all its partners in the leader's family: they are described by their edits against
    the leader, which gives the similarity of two followers exactly (see ``families``); links
    that need no shared edit follow from the best document of a family, others from the edits
    themselves (``meeting``), in families over GROUP_DOCS after a prefix filter on them. The other followers of a key are compared with each other (see
    ``settled_groups``): by MATCHES of HASHES minhashes in groups up to GROUP_DOCS, which a pair
    at 0.8 misses with probability 2e-8, then on the full sets; larger groups elect new leaders
    until they are small.

No bucket is capped, and no group of documents that resemble its leader is expanded into pairs.

Defined results: null and empty texts and texts without words have an empty set and are
linked with nothing; a text with fewer words than a shingle is one shingle; very long texts
are hashed whole, in windows; of a component the smallest doc_id stays, so ties and repeated
rows end under one id; rows that share a doc_id are one document; a row without doc_id is
reported with its own number of shingles and no component, and stays; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PERCENT = 80
SIDE, DEPTH = 20, 4
HASHES = 2 * SIDE * DEPTH
#: Similarity in percent from which a follower counts as kin of its leader.
KIN = 40
#: Similarity in percent from which a leader's family holds every partner of a follower:
#: by the triangle inequality of Jaccard distances a partner is then kin of the leader.
SURE = 100 + KIN - PERCENT
#: Equal minhashes (of their low bytes) that two followers need before their sets are compared.
MATCHES = 100
#: Documents up to which what is left of a key, or a family, is compared in one task.
GROUP_DOCS = 1_000
#: Documents whose keys are folded together before they are sent on.
PACK_DOCS = 5_000
#: Followers that one task compares with a copy of their leader.
GROUP = 32
#: Edits of a family that are counted at once.
COLUMNS = 2_048
#: Documents of an edit that are listed together.
LISTED = 4_000
#: Bytes over which word hashes are computed at once.
WINDOW = 1 << 20

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
MULTIPLIERS = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER = _powers(BASE, WINDOW)
INVERSE = _powers(pow(BASE, -1, 2**64), WINDOW)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hash(word: np.ndarray) -> int:
    """Sum of byte codes times powers of BASE; for words that cross a window."""
    total = 0
    for at in range(0, len(word), WINDOW):
        part = word[at : at + WINDOW]
        total += int((BYTE_CODE[part] * POWER[: len(part)]).sum(dtype=np.uint64)) * pow(BASE, at, 2**64)
    return total & (2**64 - 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every word of texts laid end to end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    hashes = np.zeros(len(starts), np.uint64)
    crossing = starts // WINDOW != (ends - 1) // WINDOW
    for w in range(0, len(data), WINDOW):
        part = data[w : w + WINDOW]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[FOLD[part]] * POWER[: len(part)], dtype=np.uint64)])
        lo, hi = np.searchsorted(starts, [w, w + WINDOW])
        inside = lo + np.flatnonzero(~crossing[lo:hi])
        hashes[inside] = (total[ends[inside] - w] - total[starts[inside] - w]) * INVERSE[starts[inside] - w]
    for i in np.flatnonzero(crossing):
        hashes[i] = word_hash(FOLD[data[starts[i] : ends[i]]])
    return mix(hashes), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow column of strings."""
    raw = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.combine_chunks()
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    # Empty texts share their offset with a neighbour; only real starts part words.
    hashes, doc = word_hashes(data, offsets)
    at = np.searchsorted(doc, np.arange(len(raw) + 1))
    joined = hashes[: max(0, len(hashes) - words + 1)].copy()
    for k in range(1, words):
        joined = joined * U(0xD6E8FEB86659FD93) + hashes[k : k + len(joined)]
    joined = mix(joined + U(words))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            whole = U(0)
            for h in hashes[a:b]:
                whole = whole * U(0xA0761D6478BD642F) + h
            out.append(mix(np.array([whole + U(1000 + b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a set, by the upper half of its hashes; long sets are taken in slices."""
    low, s = np.full(HASHES, 2**32 - 1, np.uint32), (s >> U(32)).astype(np.uint32)
    for at in range(0, len(s), 1 << 12):
        np.minimum(low, (s[None, at : at + (1 << 12)] * MULTIPLIERS[:, None]).min(1), out=low)
    return low


def block_codes(low: np.ndarray) -> np.ndarray:
    """40 bits for each of the 2 * SIDE blocks of n x HASHES minima."""
    parts = low.reshape(len(low), 2 * SIDE, DEPTH).astype(np.uint64)
    code = np.zeros(parts.shape[:2], np.uint64)
    for k in range(DEPTH):
        code = mix(code * U(0x9FB21C651E98DF25) + parts[:, :, k] + U(1))
    return code >> U(24)


def signatures(df: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, words (128 bits of the sequence), blocks (2 * SIDE x 40 bits), low (HASHES x 8 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                sets = shingle_sets(batch.column(1), words)
                sigs = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, HASHES), np.uint32)
                blocks, low = block_codes(sigs), mix(sigs.astype(np.uint64)).astype(np.uint8)
            raw = batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
            same = [hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest() for t in raw]
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(map(five, blocks), pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_shingles", "words", "blocks", "low"])
        common.release_memory()

    return df.mapInArrow(run, "doc_id long, n_shingles long, words binary, blocks binary, low binary")


def five(values: np.ndarray) -> bytes:
    """Numbers below 2^40 in five bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def bucketed(x: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low 40 bits of a hash in one number: hashes that collide only add candidates."""
    return ((x >> U(40)).astype(np.int64) % buckets) << 40 | (x & U(LOW)).astype(np.int64)


def pack_blocks(table: pa.Table, buckets: int) -> np.ndarray:
    """n x 2 * SIDE keys of the blocks of a pack's documents, in the order of its rows."""
    codes = from_five(b"".join(table.column("blocks").to_pylist())).reshape(-1, 2 * SIDE)
    return bucketed(mix(codes + np.arange(1, 2 * SIDE + 1, dtype=np.uint64) * U(0xA24BAED4963EE407)), buckets)


BLOCKS = [("bucket", pa.int64()), ("pack", pa.int64()), ("key", pa.binary()), ("several", pa.binary())]
SHARED = [("pack", pa.int64()), ("bucket", pa.int64()), ("shared", pa.binary())]


def _table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _kind(fields: list[tuple]) -> str:
    names = {pa.int64(): "long", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{n} {names.get(t, 'binary')}" for n, t in fields)


def report_blocks(buckets: int):
    """For each bucket the different blocks of a pack, and whether several documents of the pack have one."""

    def run(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            key, count = np.unique(pack_blocks(table, buckets), return_counts=True)
        pack, cut = table.column("pack")[0].as_py(), np.searchsorted(key, np.arange(buckets + 1) << 40)
        rows = []
        for k in np.flatnonzero(np.diff(cut)).tolist():
            at = slice(cut[k], cut[k + 1])
            rows.append((k, pack, five(key[at] & LOW), np.packbits(count[at] > 1).tobytes()))
        return _table(rows, BLOCKS)

    return run


def shared_blocks(table: pa.Table) -> pa.Table:
    """Tells each pack which of its blocks any other document has, in the order of its question."""
    bucket, packs, keys, several = (table.column(n).to_pylist() for n, _ in BLOCKS)
    keys = [from_five(x) for x in keys]
    many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)) for k, b in zip(keys, several, strict=True)])
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(which, weights=1 + many)[which] > 1
    cut = np.concatenate([[0], np.cumsum(list(map(len, keys)))]).tolist()
    return _table([(p, bucket[0], np.packbits(shared[a:b]).tobytes()) for p, a, b in zip(packs, cut[:-1], cut[1:], strict=True)], SHARED)


def shared_keys(table: pa.Table, answers: pa.Table, block_buckets: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every table in which a document of the pack may meet another."""
    blocks = pack_blocks(table, block_buckets)
    known = np.unique(blocks)
    told = dict(zip(answers.column("bucket").to_pylist(), answers.column("shared").to_pylist(), strict=True))
    cut = np.searchsorted(known, np.arange(block_buckets + 1) << 40)
    flags = [np.unpackbits(np.frombuffer(told[k], np.uint8), count=cut[k + 1] - cut[k]) for k in np.flatnonzero(np.diff(cut)).tolist()]
    on = np.concatenate(flags).astype(bool)[np.searchsorted(known, blocks.ravel())].reshape(blocks.shape)
    row, i, j = np.nonzero(on[:, :SIDE, None] & on[:, None, SIDE:])
    codes = from_five(b"".join(table.column("blocks").to_pylist())).reshape(-1, 2 * SIDE)
    x = codes[row, i] * U(0xC2B2AE3D27D4EB4F) + codes[row, SIDE + j] * U(0x9E6C63D0876A9A47) + (i * SIDE + j).astype(np.uint64) * U(0x165667B19E3779F9)
    return row, bucketed(mix(x), buckets)


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together; the upper ones are mostly zeros and compress away."""
    return np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


LOW = (1 << 40) - 1
LED = [("bucket", pa.int64()), *((n, pa.binary()) for n in ("key", "doc", "size", "leader", "leader_size"))]
KEYED = [*((n, pa.int64()) for n in ("leader", "leader_size", "doc", "size")), ("keys", pa.list_(pa.int64()))]
EDGES = [("follower", pa.bool_()), *KEYED]


def lead_pack(docs: np.ndarray, sizes: np.ndarray, key: np.ndarray, buckets: int) -> list[tuple]:
    """For each bucket the leader of each of its keys; in rows of their own those who follow a leader."""
    if not len(key):
        return []
    spread = buckets + int(docs.min()) % (1 << 20)
    order = np.lexsort((docs, key))
    key, docs, sizes = key[order], docs[order], sizes[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    heads = np.flatnonzero(first)
    leader = heads[np.cumsum(first) - 1]
    cut = np.searchsorted(key[heads], np.arange(buckets + 1) << 40)
    rows = []
    for k in np.flatnonzero(np.diff(cut)).tolist():
        at = heads[cut[k] : cut[k + 1]]
        rows.append((k, five(key[at] & LOW), planes(docs[at]), planes(sizes[at]), b"", b""))
    rest = np.flatnonzero(~first & (docs != docs[leader]))  # a repeated row says nothing new
    rest = rest[np.lexsort((docs[rest], docs[leader[rest]]))]
    for at in np.array_split(rest, len(rest) // 100_000 + 1) if len(rest) else ():
        rows.append((spread, *map(planes, (key[at], docs[at], sizes[at], docs[leader[at]], sizes[leader[at]]))))
    return rows


def led(block_buckets: int, buckets: int):
    """Folds the keys of a pack before anything is shuffled."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _table([], LED)
        with np.errstate(over="ignore"):
            row, key = shared_keys(table, answers, block_buckets, buckets)
        docs, sizes = (table.column(n).to_numpy() for n in ("doc_id", "n_shingles"))
        out = _table(lead_pack(docs[row], sizes[row], key, buckets), LED)
        common.release_memory()
        return out

    return run


def gathered(leader: np.ndarray, leader_size: np.ndarray, doc: np.ndarray, size: np.ndarray, key: np.ndarray) -> list[pa.Array]:
    """Columns of KEYED: one row for a leader and a document, with all keys that tie them."""
    order = np.lexsort((key, doc, leader))
    leader, leader_size, doc, size, key = (np.ascontiguousarray(c[order], np.int64) for c in (leader, leader_size, doc, size, key))
    first = np.flatnonzero(np.concatenate([[True], (leader[1:] != leader[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
    keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(key))
    return [*(pa.array(c[first]) for c in (leader, leader_size, doc, size)), keys]


def follow(buckets: int):
    """In a bucket leaders of a key follow the first of them; followers only pass."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        key, doc, size, leader, leader_size = (table.column(n).to_pylist() for n, _ in LED[1:])
        doc, size = (np.concatenate([from_planes(x) for x in c]) for c in (doc, size))
        if bucket >= buckets:
            key, leader, leader_size = (np.concatenate([from_planes(x) for x in c]) for c in (key, leader, leader_size))
            cols = gathered(leader, leader_size, doc, size, key)
        else:
            key = from_five(b"".join(key)).view(np.int64)
            order = np.lexsort((doc, key))
            key, doc, size = key[order], doc[order], size[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            rest = np.flatnonzero(doc != doc[lead])
            # A row for each key here: how many of a pair meet in a bucket depends on the number of buckets.
            cols = [*(pa.array(np.ascontiguousarray(c, np.int64)) for c in (doc[lead[rest]], size[lead[rest]], doc[rest], size[rest]))]
            cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rest) + 1), pa.int32()), pa.array(key[rest] | bucket << 40)))
        return pa.table([pa.array([bucket >= buckets] * len(cols[0]), pa.bool_()), *cols], names=[n for n, _ in EDGES])

    return run


def flat(table: pa.Table) -> tuple[np.ndarray, ...]:
    """leader, leader_size, doc, size and key of a table with KEYED, one element for each key."""
    keys = table.column("keys").combine_chunks()
    n = pa.compute.list_value_length(keys).to_numpy(zero_copy_only=False)
    return *(np.repeat(table.column(c).to_numpy(), n) for c in ("leader", "leader_size", "doc", "size")), keys.flatten().to_numpy(zero_copy_only=False)


def follow_on(below: pa.Table, above: pa.Table) -> pa.Table:
    """A follower of its pack's leader follows whom that leader follows under the same key.

    below: followers of a pack; above: leaders of that pack under theirs. A pack has one leader for a key.
    """
    leader, leader_size, doc, size, key = flat(below)
    top, top_size, _, _, known = flat(above)
    order = np.argsort(known)
    top, top_size, known = top[order], top_size[order], known[order]
    at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
    if len(known):
        led_on = known[at] == key
        leader, leader_size = np.where(led_on, top[at], leader), np.where(led_on, top_size[at], leader_size)
    return pa.table(gathered(leader, leader_size, doc, size, key), names=[n for n, _ in KEYED])


def candidate_edges(reps: DataFrame) -> DataFrame:
    """leader, leader_size, doc, size, keys: every document of a shared key under the key's first one."""
    spark = reps.sparkSession
    n, count = common.shuffle_parts(spark), reps.count()
    packs, spread = common.parts_for(count, PACK_DOCS), max(n, common.parts_for(count, 50_000))
    block_buckets, buckets = spread, 4 * spread
    pack = lambda c: F.pmod(F.xxhash64(c), F.lit(packs)).alias("pack")
    with common.scratch(spark) as keep:
        rows = reps.select(pack("doc_id"), "doc_id", "n_shingles", "blocks").groupBy("pack")
        asked = rows.applyInArrow(report_blocks(block_buckets), _kind(BLOCKS))
        told = common.settle(asked.groupBy("bucket").applyInArrow(shared_blocks, _kind(SHARED)), "near-shared")
        keys = rows.cogroup(told.groupBy("pack")).applyInArrow(led(block_buckets, buckets), _kind(LED))
        edges = common.settle(keys.groupBy("bucket").applyInArrow(follow(buckets), _kind(EDGES)), "near-edges")
        heads = edges.filter("not follower").drop("follower")
        above, below = heads.select("*", pack("doc")), edges.filter("follower").drop("follower").select("*", pack("leader"))
        below = below.groupBy("pack").cogroup(above.groupBy("pack")).applyInArrow(follow_on, _kind(KEYED))
        whole = heads.unionByName(below).groupBy("leader", "leader_size", "doc", "size").agg(F.flatten(F.collect_list("keys")).alias("keys"))
        return keep(whole, "near-keyed")


def fits(a: str, b: str, percent: int = PERCENT):
    """Sizes alone allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def compare_sorted(words: int, edits: bool):
    """Rows sorted by (a, salt, role): the leader's set first, then its followers.

    Gives a, b, na, nb, both for each follower, or with ``edits`` the shingles that
    one of the two has alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leads = None, []
        for batch in batches:
            with np.errstate(over="ignore"):
                sets = shingle_sets(batch.column(4), words)
            lead, salt, role, doc = (batch.column(i).to_pylist() for i in range(4))
            out, tokens = [], []
            for a, s, r, b, own in zip(lead, salt, role, doc, sets, strict=True):
                if key != (a, s):
                    key, leads = (a, s), []
                if r == 0:
                    leads.append(own)
                    continue
                for other in leads:
                    if edits:
                        diff = np.setxor1d(own, other, assume_unique=True).view(np.int64)
                        tokens.append(diff)
                        out.append((a, b, len(diff)))
                    else:
                        out.append((a, b, len(other), len(own), len(np.intersect1d(own, other, assume_unique=True))))
            if edits:
                a, b, n = (np.array(c, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))
                cols = [np.repeat(a, n), np.repeat(b, n), np.concatenate(tokens) if tokens else np.zeros(0, np.int64)]
                whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "token"])
                for at in range(0, len(whole), 100_000):
                    yield whole.slice(at, 100_000)
            else:
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "na", "nb", "both"])

    return run


def compared(pairs: DataFrame, texts: DataFrame, words: int, edits: bool = False) -> DataFrame:
    """What ``compare_sorted`` tells of the full sets of each pair. pairs: a, b, distinct."""
    spark = pairs.sparkSession
    common.arrow_rows(spark)
    order = ["a", "salt", "role", "doc_id"]
    kind = "a long, b long, token long" if edits else "a long, b long, na long, nb long, both long"
    with common.scratch(spark) as keep:
        pairs = common.settle(pairs, "near-asked")
        sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP)
        salts = F.ceil(F.coalesce("n", F.lit(1)) / GROUP)
        salted = pairs.join(common.settle(sizes, "near-sizes"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).alias("salt"))
        salted = common.settle(salted, "near-salted")
        followers = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("doc_id"))
        leaders = salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("doc_id"))
        met = followers.unionByName(leaders).join(texts.select("doc_id", "text"), "doc_id").select(*order, "text")
        met = met.repartition(common.shuffle_parts(spark), "a", "salt").sortWithinPartitions(*order)
        return keep(met.mapInArrow(compare_sorted(words, edits), kind).distinct(), "near-compared")


def similar(both, na, nb):
    """both / (na + nb - both) >= PERCENT / 100, in whole numbers."""
    return (100 + PERCENT) * both >= PERCENT * (na + nb)


def components(links: DataFrame) -> DataFrame:
    """doc_id, root: the smallest id of each linked document's component.

    Large-star and small-star rounds until the edges are stars around their minimum.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    with common.scratch(spark) as keep:
        edges = common.settle(edges, "near-edges")
        while True:
            n, ups = edges.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
            if n == ups and not edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count():
                return keep(edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root")), "near-roots")
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = common.settle(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "near-low")  # alone, so that Spark may split the join
            large = common.settle(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "near-large")
            low = common.settle(large.groupBy("u").agg(F.min("v").alias("m")), "near-low")
            small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
            edges = common.settle(small.filter("u != v").distinct(), "near-edges")


def families(stats: DataFrame, roots: DataFrame) -> DataFrame:
    """base, doc_id, n, worth, root: leaders with the followers they resemble, where components still differ.

    worth = (100 + PERCENT) * |doc and base| - PERCENT * |doc|. With E the shingles that a
    document and the base do not share, |x and y| = |x and base| + |y and base| - |base| +
    |Ex and Ey| exactly, so x and y are similar iff
    worth x + worth y + (100 + PERCENT) * |Ex and Ey| >= (100 + PERCENT) * |base|.
    """
    k = 100 + PERCENT
    worth = k * F.col("both") - PERCENT * F.col("n")
    near = stats.filter((100 + KIN) * F.col("both") >= KIN * (F.col("na") + F.col("nb")))
    rows = near.select(F.col("a").alias("base"), F.col("na").alias("size"), F.col("b").alias("doc_id"), F.col("nb").alias("n"), "both")
    own = near.select(F.col("a").alias("base"), F.col("na").alias("size"), F.col("a").alias("doc_id"), F.col("na").alias("n"), F.col("na").alias("both")).distinct()
    named = rows.unionByName(own).join(roots, "doc_id", "left").select("base", "size", "doc_id", "n", worth.alias("worth"), F.coalesce("root", "doc_id").alias("root"))
    named = common.settle(named, "near-named")
    open_ = named.groupBy("base").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("base")
    return common.settle(named.join(common.settle(open_, "near-open"), "base", "left_semi"), "near-families")


def certain(rows: DataFrame) -> DataFrame:
    """Links (a, b) that need no shared edit: with the document of the highest worth under the same base.

    If x and y are such a link, both are one with that document, so these links connect as much as all would.
    """
    best = common.settle(rows.groupBy("base").agg(F.max(F.struct("worth", "doc_id", "root")).alias("top")), "near-top")
    fit = rows.join(best, "base").filter(F.col("worth") + F.col("top.worth") >= (100 + PERCENT) * F.col("size")).filter("doc_id != top.doc_id and root != top.root")
    return common.settle(fit.select(F.col("top.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "near-certain")


def meeting(docs: np.ndarray, roots: np.ndarray, worth: np.ndarray, need: np.ndarray, goal: int, edits: list[np.ndarray]) -> np.ndarray:
    """Pairs (a, b) of a family, of different components, with worth a + worth b + (100 + PERCENT) * |Ea and Eb| >= goal.

    An edit that one component alone has, or a document with fewer other edits than it needs, is in no such pair.
    """
    none = np.zeros((0, 2), np.int64)
    token, own = np.concatenate([*edits, np.zeros(0, np.int64)]), np.repeat(np.arange(len(docs)), list(map(len, edits)))
    order = np.argsort(token, kind="stable")
    token, own = token[order], own[order]
    while True:
        if not len(token):
            return none
        heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        held = roots[own]
        several = np.minimum.reduceat(held, heads) < np.maximum.reduceat(held, heads)
        on = np.repeat(several, np.diff(np.append(heads, len(token))))
        able = np.bincount(own[on], minlength=len(docs)) >= need
        on &= able[own]
        if on.all():
            break
        token, own = token[on], own[on]
    left, row = np.unique(own, return_inverse=True)
    column = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]]))
    shared = np.zeros((len(left), len(left)), np.float32)
    cut = np.searchsorted(column, np.arange(0, column[-1] + 1 + COLUMNS, COLUMNS))
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        has = np.zeros((len(left), COLUMNS), np.float32)
        has[row[x:y], column[x:y] % COLUMNS] = 1
        shared += has @ has.T
    w, r = worth[left], roots[left]
    enough = w[:, None] + w[None, :] + (100 + PERCENT) * shared.astype(np.int64) >= goal
    i, j = np.nonzero(enough & (r[:, None] != r[None, :]) & (docs[left][:, None] < docs[left][None, :]))
    return np.stack([docs[left][i], docs[left][j]], 1) if len(i) else none


def met_in_families(able: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Pairs (a, b) of ``meeting`` for each base of able, whose whole family meets in one task: no edit is sent on."""
    spark = able.sparkSession
    common.arrow_rows(spark)
    order = ["base", "role", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leads, members, edits = None, [], [], {}

        def done() -> Iterator[pa.RecordBatch]:
            if members:
                docs, roots, worth, need, size = np.array(members, np.int64).T
                found = meeting(docs, roots, worth, need, (100 + PERCENT) * int(size[0]), [edits[d] for d in docs.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], ["a", "b"])

        for batch in batches:
            with np.errstate(over="ignore"):
                sets = shingle_sets(batch.column(7), words)
            for base, role, doc, *told, own in zip(*(batch.column(i).to_pylist() for i in range(7)), sets, strict=True):
                if base != key:
                    yield from done()
                    key, leads, members, edits = base, [], [], {}
                if role == 0:
                    leads.append(own)
                    continue
                members.append((doc, *told))
                for other in leads:  # rows that share a doc_id are one document
                    diff = np.setxor1d(own, other, assume_unique=True).view(np.int64)
                    edits[doc] = np.union1d(edits[doc], diff) if doc in edits else diff
        yield from done()
        common.release_memory()

    none = F.lit(0).cast("long")
    followers = able.select("base", F.lit(1).alias("role"), "doc_id", "root", "worth", "need", "size")
    leaders = able.select("base").distinct().select("base", F.lit(0).alias("role"), F.col("base").alias("doc_id"), *[none.alias(c) for c in ("root", "worth", "need", "size")])
    met = followers.unionByName(leaders).join(texts.select("doc_id", "text"), "doc_id").select(*order, "root", "worth", "need", "size", "text")
    met = met.repartition(common.shuffle_parts(spark), "base").sortWithinPartitions(*order)
    return met.mapInArrow(run, "a long, b long").distinct()


def sharing_edits(rows: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Pairs (a, b) of one base and different components that share enough edits to be similar, or in large families for a prefix filter to keep them.

    A family of up to GROUP_DOCS documents is compared in one task (see ``meeting``). In others
    a pair needs t = ceil((K * |base| - worth x - worth y) / K) shared edits, so a document with
    fewer edits than it needs for the best document of another component is out. Edits are
    ordered by frequency under their base, rarest first; x can only share t of them if
    it shares one of its first |Ex| - t + 1, and enough must be left behind it.
    """
    k = 100 + PERCENT
    best = common.settle(rows.groupBy("base", "root").agg(F.max("worth").alias("worth")), "near-best")
    first = common.settle(best.groupBy("base").agg(F.max(F.struct("worth", "root")).alias("one")), "near-first")
    others = common.settle(best.join(first, "base").filter("root != one.root").select("base", "worth"), "near-others")  # a join that Spark may split
    second = others.groupBy("base").agg(F.max("worth").alias("other"))
    top = common.settle(first.join(second, "base").select("base", F.col("one.worth").alias("one"), F.col("one.root").alias("one_root"), "other"), "near-tops")
    shared = (F.col("worth") + PERCENT * F.col("n")) / k
    able = (
        rows.join(top, "base").filter("base != doc_id")
        .withColumn("need", F.greatest(F.lit(1), F.ceil((k * F.col("size") - F.col("worth") - F.when(F.col("root") == F.col("one_root"), F.col("other")).otherwise(F.col("one"))) / k)).cast("long"))
        .withColumn("edits", F.col("n") + F.col("size") - 2 * shared.cast("long"))
        .filter("need <= edits").select("base", "doc_id", "size", "root", "worth", "need", "edits")
    )
    able = common.settle(able, "near-able")
    members = common.settle(able.groupBy("base").agg(F.count(F.lit(1)).alias("n")), "near-members")
    large = common.settle(members.filter(F.col("n") > GROUP_DOCS).select("base"), "near-large")
    met = met_in_families(able.join(large, "base", "left_anti"), texts, words)
    largest = members.agg(F.max("n")).first()[0] or 1
    if largest <= GROUP_DOCS:
        return common.settle(met, "near-pairs")
    able = common.settle(able.join(large, "base", "left_semi"), "near-able")
    edits = compared(able.select(F.col("base").alias("a"), F.col("doc_id").alias("b")), texts, words, edits=True).withColumnRenamed("a", "base").withColumnRenamed("b", "doc_id")
    # Documents of an edit come in lists of bounded length, whatever the family's size, and only lists are counted together.
    lists = edits.groupBy("base", "token", F.pmod(F.xxhash64("doc_id"), F.lit(-(-largest // LISTED))).alias("salt")).agg(F.collect_list("doc_id").alias("docs"))
    counted = lists.withColumn("times", F.sum(F.size("docs")).over(Window.partitionBy("base", "token"))).filter("times > 1")
    # Edits that one document has alone order first and match nothing: only their number counts.
    listed = counted.select("base", F.explode("docs").alias("doc_id"), "times", "token").groupBy("base", "doc_id").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("held"))
    wide = (
        common.settle(able.join(common.settle(listed, "near-listed"), ["base", "doc_id"]), "near-wide")
        .withColumn("alone", F.col("edits") - F.size("held"))
        .withColumn("reach", F.least(F.size("held").cast("long"), F.col("edits") - F.col("need") + 1 - F.col("alone")))
        .filter("reach > 0")
    )
    heads = wide.select("base", "size", "doc_id", "root", "worth", F.size("held").alias("total"), F.posexplode(F.slice("held", 1, F.col("reach").cast("int"))).alias("at", "x"))
    heads = common.settle(heads.select("base", "size", "doc_id", "root", "worth", F.col("x.token").alias("token"), (F.col("total") - F.col("at")).alias("left")), "near-heads")
    other = heads.select("base", "token", F.col("doc_id").alias("y"), F.col("root").alias("y_root"), F.col("worth").alias("y_worth"), F.col("left").alias("y_left"))
    enough = F.col("worth") + F.col("y_worth") + k * F.least("left", "y_left") >= k * F.col("size")
    found = heads.join(common.settle(other, "near-others"), ["base", "token"]).filter((F.col("root") != F.col("y_root")) & (F.col("doc_id") < F.col("y")) & enough)
    return common.settle(met.unionByName(found.select(F.col("doc_id").alias("a"), F.col("y").alias("b"))).distinct(), "near-pairs")


def open_groups(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, doc, size, root, n of the keys whose documents (key, doc, size) still differ in component; of equal groups one."""
    named = members.distinct().join(roots.withColumnRenamed("doc_id", "doc"), "doc", "left").select("key", "doc", "size", F.coalesce("root", "doc").alias("root"))
    named = common.settle(named, "near-members")
    sets = [F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")]
    groups = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), *sets).filter("lo < hi")
    groups = common.settle(groups.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "near-groups")
    return common.settle(named.join(groups, "key"), "near-open")


TRIED = [("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]


def centred(key: int, docs: np.ndarray, sizes: np.ndarray, roots: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Pairs (key, centre, document) to compare in a group, by their minhashes; (key, centre, centre) names a centre.

    Each document joins the first centre that it seems SURE of, or becomes one. A centre that
    others joined is compared with all that may be kin of it, one alone with all that may be similar.
    """
    n = len(docs)
    equal = np.concatenate([(low[at : at + 64, None, :] == low[None, :, :]).sum(2, dtype=np.uint8) for at in range(0, n, 64)])
    joined, centres = np.zeros(n, np.int64), []
    for i in range(n):
        near = [c for c in centres if equal[c, i] >= HASHES * (SURE + 10) // 100]
        if near:
            joined[near[0]] += 1
        else:
            centres.append(i)
    out = []
    for c in centres:
        fit = lambda percent, c=c: 100 * np.minimum(sizes, sizes[c]) >= percent * np.maximum(sizes, sizes[c])
        if joined[c]:
            hit = (equal[c] >= HASHES * (KIN - 15) // 100) & fit(KIN)
        else:
            hit = (equal[c] >= MATCHES) & fit(PERCENT) & (roots != roots[c])
        hit[c] = True
        to = np.flatnonzero(hit)
        out.append(np.stack([np.full(len(to), key), np.full(len(to), docs[c]), docs[to]], 1))
    return np.concatenate(out)


def centres_of(groups: DataFrame, lows: DataFrame) -> DataFrame:
    """``centred`` for each key of groups (key, doc, size, root), in one pass over rows sorted by key."""
    spark = groups.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(cols: tuple) -> Iterator[pa.RecordBatch]:
            key = cols[0]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])).tolist()
            found = [centred(int(key[x]), *(c[x:y] for c in cols[1:])) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            rows = np.concatenate(found)
            for at in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[at : at + 100_000, k])) for k in range(3)], [n for n, _ in TRIED])

        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(k).to_numpy() for k in range(4)]
            held.append((*cols, np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, HASHES)))
            key = cols[0]
            if key[0] != key[-1] or held[0][0][0] != key[-1]:  # all but the last group are whole
                whole = tuple(np.concatenate([h[k] for h in held]) for k in range(5))
                last = int(np.searchsorted(whole[0], whole[0][-1]))
                yield from done(tuple(c[:last] for c in whole))
                held = [tuple(c[last:] for c in whole)]
        if held:
            yield from done(tuple(np.concatenate([h[k] for h in held]) for k in range(5)))
        common.release_memory()

    common.arrow_rows(spark, 10_000)
    rows = groups.join(lows, "doc").select("key", "doc", "size", "root", "low")
    return rows.repartition(common.shuffle_parts(spark), "key").sortWithinPartitions("key", "doc").mapInArrow(run, _kind(TRIED))


def sure(stats: DataFrame) -> DataFrame:
    return stats.filter((100 + SURE) * F.col("both") >= SURE * (F.col("na") + F.col("nb"))).select("a", "b")


def linking(stats: DataFrame) -> DataFrame:
    return stats.filter(similar(F.col("both"), F.col("na"), F.col("nb"))).select("a", "b")


def settled_groups(stats: DataFrame, links: DataFrame, roots: DataFrame, keyed: DataFrame, lows: DataFrame, texts: DataFrame, words: int):
    """stats, links and roots with those of all documents that no leader of their key answers for.

    A document at SURE or more of a leader is done: all its partners are kin of that leader.
    The others of the key find centres among themselves (``centred``), or in a large group
    new leaders, twice as many in each round. Either is compared with all that are left, so it
    is done too. Two similar documents of a key are thus compared or kin of one leader in
    the round where the first of them is done.
    """
    answered = sure(stats).select(F.col("a").alias("leader"), F.col("b").alias("doc"))
    loose = keyed.select("leader", "doc").distinct().join(answered, ["leader", "doc"], "left_anti")
    loose = common.settle(loose, "near-loose")
    if not loose.limit(1).count():
        return stats, links, roots
    rest = open_groups(keyed.join(loose, ["leader", "doc"]).select(F.explode("keys").alias("key"), "doc", "size"), roots)
    count = 1
    while rest.limit(1).count():
        few = centres_of(rest.filter(F.col("n") <= GROUP_DOCS).select("key", "doc", "size", "root"), lows)
        many = rest.filter(F.col("n") > GROUP_DOCS).select("key", "doc", "size")
        heads = many.groupBy("key", F.pmod(F.xxhash64("doc"), F.lit(count)).alias("salt")).agg(F.min(F.struct("doc", "size")).alias("head"))
        heads = heads.select("key", F.col("head.doc").alias("a"), F.col("head.size").alias("a_size"))
        led_by = many.join(heads, "key").filter(fits("size", "a_size", KIN)).select("key", "a", F.col("doc").alias("b"))
        tried = common.settle(few.unionByName(led_by), "near-tried")
        fresh = tried.filter("a != b").select("a", "b").distinct().join(stats.select("a", "b"), ["a", "b"], "left_anti")
        found = compared(fresh, texts, words)
        stats = common.settle(stats.unionByName(found), "near-stats")
        more = linking(found)
        if more.limit(1).count():
            links = common.settle(links.unionByName(more), "near-links")
            roots = components(links)
        # Of a key those are done that lead it or are at SURE of one of its leaders.
        done = tried.filter("a != b").join(sure(stats), ["a", "b"]).select("key", F.col("b").alias("doc")).unionByName(tried.select("key", F.col("a").alias("doc"))).distinct()
        rest = open_groups(rest.select("key", "doc", "size").join(done, ["key", "doc"], "left_anti"), roots)
        count *= 2
    return stats, links, roots


def linked(keyed: DataFrame, lows: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """doc_id, root of every document that is linked with another."""
    # Followers that cannot be similar to their leader may still be kin of it.
    pairs = keyed.filter(fits("size", "leader_size", KIN)).select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    stats = compared(pairs, texts, words)
    links = common.settle(linking(stats), "near-links")
    stats, links, roots = settled_groups(stats, links, components(links), keyed, lows, texts, words)
    more = certain(families(stats, roots))
    if more.limit(1).count():
        links = links.unionByName(more)
        roots = components(links)
    rows = families(stats, roots)
    if rows.limit(1).count():
        found = compared(sharing_edits(rows, texts, words), texts, words)
        more = common.settle(linking(found), "near-links")
        if more.limit(1).count():
            roots = components(links.unionByName(more))
    return roots


def report(df: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``df``."""
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common.arrow_rows(spark)
    with common.scratch(spark) as keep:
        rows = common.settle(signatures(docs, words), "near-sigs")
        named_rows = rows.filter("doc_id is not null")
        classes = named_rows.filter("n_shingles > 0").groupBy("words").agg(F.min("doc_id").alias("rep"))
        classes = common.settle(classes, "near-classes")
        reps = named_rows.join(classes.select(F.col("rep").alias("doc_id"), "words"), ["doc_id", "words"]).dropDuplicates(["doc_id", "words"])
        reps = common.settle(reps.select("doc_id", "n_shingles", "blocks", "low"), "near-reps")
        keyed = candidate_edges(reps)
        # Texts of all that shares a key: cut from the source once, by a sorted join at every size.
        held = keyed.select(F.explode(F.array("leader", "doc")).alias("doc_id")).distinct()
        held = common.settle(held, "near-held")
        texts = common.settle(docs.join(held.hint("merge"), "doc_id", "left_semi"), "near-texts")
        lows = reps.select(F.col("doc_id").alias("doc"), "low").join(held.select(F.col("doc_id").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"])
        roots = linked(keyed, common.settle(lows, "near-lows"), texts, words)
        named = rows.join(classes, "words", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
        named = named.join(roots.withColumnRenamed("doc_id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("root", "rep"))
        return keep(named.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "near-report")


def deduplicate(df: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``df`` whose document stays, all columns unchanged."""
    gone = report(df, words).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti").select(*df.columns)


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), words=2)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) > 1 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS held FROM w),
g AS (SELECT doc_id, unnest(held) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 80 * (len(a.held) + len(b.held) - c)),
pairs AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x, y FROM pairs UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON pairs.x = reach.y)
SELECT doc_id, len(held)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM s LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) ON x = doc_id
"""
