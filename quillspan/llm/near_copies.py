"""Problem 4: records that share most of their wording.

Method: prefix join with parity sketches. The word shingles of a record are
put in one order for all records, rarest first; how often each occurs is
counted over all records. Two records with the similarity share a shingle among
the first of each, so records are joined on every shingle of those prefixes:
no pair is lost, whatever its shingles have in common with others. A shingle
that only one record has takes a place of its prefix and is sent nowhere. Of
the pairs so met, those are dropped that cannot have the similarity if the
shingle is the rarest they share: what follows it is too short, or the parity
sketches of what follows differ in too many bits. The candidates are checked
against a 256-bit parity sketch of the whole record, whose Hamming distance
never exceeds the symmetric difference, and what remains is verified on the
full shingle sets.

A record travels as the 64-bit hash of its shingle set, so equal sets are one
record wherever they stand, and a text that a third of all rows repeat is
compared once. The sets are written once, four bytes a shingle, and read again where
they are needed. Postings are made, joined and checked in rounds, each for a
range of shingles, and what a round shuffled is freed before the next begins,
so that the disk holds the postings and candidates of one round only.

The work grows with the pairs of records that share a shingle of their
prefixes, so with the square of the records where a fixed share of them holds
the same ones.
"""

from __future__ import annotations

import functools
import gc
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.core.components import connected_components
from quillspan.core.workspace import Stored, stored

KEYS_A_BUCKET = 1_000_000
MOST_ROUNDS, RECORDS_A_ROUND = 4, 5_000
COUNTS_A_BUCKET = 8_000_000
LEAST_TABLE_BITS, MOST_TABLE_BITS = 16, 27
LONG_RUN = 20_000
PAIRS_AT_ONCE = 2_000_000
LETTERS_AT_ONCE = 200_000
SHINGLES_AT_ONCE = 4_000_000
SHINGLES_A_SORT = 1 << 17
CANDIDATES_A_SET = 12
WIDE_SPARE = 16
FINE_BITS = 1024
WORDS = 4  # a power of two
HOT = ["key", "size", "place", *(f"r{i}" for i in range(WORDS))]
RECORDS = "id bigint, num bigint, size int, sketch binary, shingles binary"
_LETTERS: list = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base and of its inverse, modulo 2^64, at least n of each."""
    if len(_LETTERS) < 2:
        known = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        _LETTERS[:] = [known, _mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(97)), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    if len(_LETTERS[2]) < n:
        base = 0x9E3779B97F4A7C15
        for i, b in ((2, base), (3, pow(base, -1, 1 << 64))):
            _LETTERS[i] = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, b, np.uint64))])
    return _LETTERS[2], _LETTERS[3]


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word in order, words of each text). A word is a run of letters or digits, lower case; a hash of it sums code points times powers of a base."""
    lower = [t.lower() if t else "" for t in texts]
    joined = "\n".join(lower)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = _powers(len(cp) + 1)
    inside = np.zeros(len(cp) + 2, bool)
    inside[1:-1] = _LETTERS[0][cp]
    start = np.flatnonzero(inside[1:] & ~inside[:-1])
    end = np.flatnonzero(inside[:-1] & ~inside[1:])
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(_LETTERS[1][cp] * up[: len(cp)], out=total[1:])
    h = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    # Letters of a text, counted after lower(), which may lengthen it.
    ends = np.cumsum([len(t) + 1 for t in lower], dtype=np.int64) - 1
    return h, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: list, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, shingle, words of each record): the distinct shingles, sorted by both.

    A shingle is a 32-bit hash of ``words`` consecutive words.
    """
    parts, at = [(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= LETTERS_AT_ONCE):
            size += len(texts[end] or "")
            end += 1
        own, sh, many = _shingles(*word_hashes(texts[at:end]), words)
        parts.append((own + at, sh, many))
        at = end
    own, sh, many = (np.concatenate(p) for p in zip(*parts))
    return own, sh, many


def _shingles(flat: np.ndarray, many: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingle_sets`` of the words ``flat``, ``many`` of each text."""
    if len(flat) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), many
    h = np.zeros(len(flat) - words + 1, np.uint64)
    for i in range(words):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[i : len(flat) - words + 1 + i])
    own = np.repeat(np.arange(len(many)), many)
    whole = own[: len(h)] == own[words - 1 :]
    key = (own[: len(h)][whole].astype(np.uint64) << np.uint64(32)) | (h[whole] >> np.uint64(32))
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32), many


def _sets_of(batches, words: int, min_words: int):
    """Yields (ids, nums, place of each id's set, record, shingle, size) of bounded pieces of the texts; the sets of a piece are distinct."""
    for b in batches:
        texts = b.column(1).to_pylist()
        ids = b.column(0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            end, letters = at, 0
            while end < len(texts) and (end == at or letters + len(texts[end]) <= 8 * SHINGLES_AT_ONCE):
                letters += len(texts[end])
                end += 1
            own, sh, many = shingle_sets(texts[at:end], words)
            begin = np.searchsorted(own, np.arange(end - at + 1))
            good = np.flatnonzero((many >= min_words) & (np.diff(begin) > 0))
            raw = sh.tobytes()
            num = np.fromiter((xxhash.xxh64_intdigest(raw[4 * begin[i] : 4 * begin[i + 1]]) for i in good), np.uint64, len(good)).view(np.int64)
            nums, first, back = np.unique(num, return_index=True, return_inverse=True)
            keep = good[first]
            size = np.diff(begin)[keep]
            take = np.repeat(begin[keep], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            yield ids[at:end][good], nums, back, np.repeat(np.arange(len(keep)), size), sh[take], size
            at = end


def _grouped(pieces, bound: int):
    """Pieces of ``_sets_of`` put together until they have about ``bound`` shingles: (nums, record, shingle, size)."""
    held, total = [], 0
    for _, nums, _, own, sh, size in pieces:
        held.append((nums, own, sh, size))
        total += len(sh)
        if total >= bound:
            yield _together(held)
            held, total = [], 0
    if held:
        yield _together(held)


def _together(held: list) -> tuple[np.ndarray, ...]:
    shift = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
    return np.concatenate([h[0] for h in held]), np.concatenate([h[1] + s for h, s in zip(held, shift)]), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])


def parity_sketch(own: np.ndarray, shingles: np.ndarray, n: int, bits: int = 256) -> np.ndarray:
    """``bits`` (a power of two, 8 at least) a record, from (record, shingle) sorted by record: each shingle flips one. Two sketches differ in at most as many bits as their sets differ in shingles."""
    bit = (_mix(shingles.astype(np.uint64) + np.uint64(11)) >> np.uint64(64 - int(math.log2(bits)))).astype(np.int64)
    out, step = np.zeros((n, bits // 8), np.uint8), max(1, SHINGLES_A_SORT // bits)
    begin = np.searchsorted(own, np.arange(0, n + step, step))
    for a, x, y in zip(range(0, n, step), begin, begin[1:]):
        some = min(step, n - a)
        flips = np.bincount((own[x:y] - a) * bits + bit[x:y], minlength=some * bits).reshape(some, bits) & 1
        out[a : a + some] = np.packbits(flips.astype(np.uint8), axis=1)
    return out


def prefixes(own: np.ndarray, shingles: np.ndarray, size: np.ndarray, level: np.ndarray, similarity: float, low: int = 0, high: int = 1 << 32) -> tuple[np.ndarray, ...]:
    """(record, shingle, place, rest) of the postings of shingles from ``low`` to below ``high``, from (record, shingle) sorted by record.

    ``level`` is how common each shingle is, 0 if only one record has it. Two
    sets with the similarity share a shingle among the first ``size -
    ceil(similarity * size) + 1`` of each. ``place`` is the shingle's place in the order; ``rest`` is
    the parity sketch of all after it, ``WORDS`` columns of 64 bits, whose
    exclusive or is a sketch of 64 bits. A
    shingle that one record has alone has no partner and is left out. At most
    2^24 records at a time. Records are sorted in pieces of about
    ``SHINGLES_A_SORT`` shingles, which stay in a processor's cache.
    """
    ends = np.cumsum(size)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64))]
    at = 0
    while at < len(size):
        a = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, a + SHINGLES_A_SORT, side="right")))
        piece = slice(a, int(ends[end - 1]))
        key = (own[piece].astype(np.uint64) << np.uint64(40)) | (level[piece].astype(np.uint64) << np.uint64(32)) | shingles[piece]
        key.sort()
        many = size[at:end]
        stop = ends[at:end] - a
        # The places to send: the first of each record, of shingles in the range that others have too.
        first = np.clip((many - np.ceil(similarity * many - 1e-9)).astype(np.int64) + 1, 0, many)
        head = np.repeat(np.arange(end - at), first)
        place = np.arange(len(head)) - np.repeat(np.cumsum(first) - first, first)
        here = place + (stop - many)[head]
        sh = key[here] & np.uint64(0xFFFFFFFF)
        use = np.flatnonzero((sh >= low) & (sh < high) & (key[here] & np.uint64(0xFF << 32) > 0))
        head, place, here = head[use], place[use], here[use]
        last = stop[head] - 1
        h = _mix((key & np.uint64(0xFFFFFFFF)) + np.uint64(47))
        bit, word = np.uint64(1) << (h >> np.uint64(58)), h & np.uint64(WORDS - 1)
        rest = np.zeros((len(use), WORDS), np.uint64)
        for i in range(WORDS):
            parity = np.bitwise_xor.accumulate(np.where(word == i, bit, np.uint64(0)))
            rest[:, i] = parity[last] ^ parity[here]
        out.append((head + at, sh[use].astype(np.uint32), place, rest))
        at = end
    record, sh, place, rest = (np.concatenate(x) for x in zip(*out))
    return record, sh, place, rest


def _is_wide(size, place, similarity: float):
    """Whether a posting carries all words of the sketch: partners like it may differ in more shingles than 64 bits can tell."""
    return 2 * (size - place) - 4 * similarity / (1 + similarity) * size > WIDE_SPARE


def posting_pairs(shingle: np.ndarray, size: np.ndarray, place: np.ndarray, rest: np.ndarray, similarity: float):
    """Yields (x, y), places in the arrays, of the postings of one shingle whose sets can have the similarity if it is the rarest they share.

    Sorted by (shingle, size). The shingle and what follows it must hold the
    overlap, which bounds the sizes of its partners, and the two rests differ
    in no more shingles than the overlap leaves over.
    """
    share = similarity / (1 + similarity)
    limit = np.floor((size - place) / share + 1e-6).astype(np.int64) - size
    most = np.minimum(limit, np.floor(size / similarity + 1e-6).astype(np.int64))
    wide = _is_wide(size, place, similarity)
    narrow = np.where(wide, np.bitwise_xor.reduce(rest, axis=1), rest[:, 0])
    at = (shingle.astype(np.uint64) << np.uint64(32)) | size.astype(np.uint64)
    first = np.flatnonzero(most >= size)
    many = np.searchsorted(at, (shingle[first].astype(np.uint64) << np.uint64(32)) | most[first].astype(np.uint64), side="right") - first - 1
    first, many = first[many > 0], many[many > 0]
    total = np.cumsum(many)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_AT_ONCE)))
        m = many[a:b]
        x = np.repeat(first[a:b], m)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
        ok = limit[y] >= size[x]
        x, y = x[ok], y[ok]
        both = size[x] + size[y]
        spare = both - place[x] - place[y] - 2 * np.ceil(share * both - 1e-9).astype(np.int64)
        ok = np.bitwise_count(narrow[x] ^ narrow[y]) <= spare
        x, y, spare = x[ok], y[ok], spare[ok]
        ok = ~(wide[x] & wide[y])
        test = np.flatnonzero(~ok)
        ok[test] = np.bitwise_count(rest[x[test]] ^ rest[y[test]]).sum(1) <= spare[test]
        yield x[ok], y[ok]
        a = b


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes; those of small numbers compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _loaded(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, shingle, size) from a binary column of sets."""
    o = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    sh = np.frombuffer(column.buffers()[2], np.uint8)[o[0] : o[-1]].view(np.uint32)
    size = np.diff(o) // 4
    return np.repeat(np.arange(len(column)), size), sh, size


def _sketches(column) -> np.ndarray:
    """A row of bytes for each value of a binary column, all of one length and none NULL."""
    if not len(column):
        return np.zeros((0, 1), np.uint8)
    o = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[o[0] : o[-1]].reshape(len(column), -1)


def _records(texts: DataFrame, words: int, min_words: int) -> DataFrame:
    """(id, num) of every usable text, with size, sketch and sorted shingles where its set is new to the piece."""

    def rows(batches):
        for ids, nums, back, own, sh, size in _sets_of(batches, words, min_words):
            sketch = parity_sketch(own, sh, len(nums))
            _, first = np.unique(back, return_index=True)
            fresh = np.zeros(len(ids), bool)
            fresh[first] = True
            end = np.cumsum(size)
            columns = [[f(j) if new else None for j, new in zip(back, fresh)] for f in (lambda j: sketch[j].tobytes(), lambda j: sh[end[j] - size[j] : end[j]].tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nums[back], pa.int64()), pa.array(size[back].astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], ["id", "num", "size", "sketch", "shingles"])

    return texts.mapInArrow(rows, RECORDS)


def _kept(batches):
    """Pieces as of ``_sets_of``, of bounded size, from batches (num, shingles)."""
    for b in batches:
        nums, at = b.column(0).to_numpy(), 0
        ends = np.cumsum(np.diff(np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset :][: b.num_rows + 1]) // 4) if b.num_rows else []
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SHINGLES_AT_ONCE, side="right")))
            yield None, nums[at:end], None, *_loaded(b.column(1).slice(at, end - at))
            at = end


def _freed(spark) -> None:
    """Has Spark delete the shuffles that nothing refers to any more; it does so only when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _levels(sets: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(table, bits): a level for every slot of shingles, 0 where no shingle of the slot is in two records.

    Slots are ranges of shingles; a slot's level is 8 log2 of the records that
    have the most common shingle of it, counted exactly by a shuffle. The table
    grows with the records up to 2^27 bytes. Beyond, slots are shared by
    more shingles and the order is less exactly rarest first, which costs time
    and loses nothing: any order that is one for all records will do.
    """
    bits = min(MOST_TABLE_BITS, max(LEAST_TABLE_BITS, math.ceil(math.log2(32 * max(n, 1)))))
    ranges = 1 << min(bits, max(4, math.ceil(math.log2(max(1, n * 100 / COUNTS_A_BUCKET)))))
    width = 1 << (bits - int(math.log2(ranges)))

    def cut(batches):
        for _, _, sh, _ in _grouped(_kept(batches), SHINGLES_AT_ONCE):
            keys, counts = np.unique(sh, return_counts=True)
            edge = np.searchsorted(keys, (np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges))
            some = np.flatnonzero(np.diff(edge))
            parts = [(keys[edge[i] : edge[i + 1]], counts[edge[i] : edge[i + 1]]) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([_planes(np.diff(x, prepend=np.uint32(0))) for x, _ in parts], pa.binary()), pa.array([_planes(y) for _, y in parts], pa.binary())], ["at", "keys", "counts"])

    def merged(t):
        keys = np.concatenate([np.cumsum(_from_planes(k.as_py()), dtype=np.uint32) for c in t["keys"].chunks for k in c])
        counts = np.concatenate([_from_planes(k.as_py()) for c in t["counts"].chunks for k in c])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        total = np.add.reduceat(counts, begin)
        keys, total = keys[begin][total > 1], total[total > 1]
        level = np.zeros(width, np.uint8)
        np.maximum.at(level, (keys >> np.uint32(32 - bits)).astype(np.int64) - t["at"][0].as_py() * width, np.minimum(255, np.ceil(8 * np.log2(total))).astype(np.uint8))
        return pa.table({"at": t["at"][:1], "level": pa.array([level.tobytes()], pa.binary())})

    pieces = sets.mapInArrow(cut, "at int, keys binary, counts binary").repartition(ranges, "at")
    table = np.zeros(1 << bits, np.uint8)
    for r in pieces.groupBy("at").applyInArrow(merged, "at int, level binary").collect():
        table[r["at"] * width : (r["at"] + 1) * width] = np.frombuffer(r["level"], np.uint8)
    return table, bits


def _candidates(sets: DataFrame, n: int, rounds: int, similarity: float):
    """Yields pairs (a, b) of sets that may have the similarity; none that has it is missing from all.

    Postings travel packed by bucket, a range of shingles, in rounds; those of a round are gone when the next begins. Pairs are held
    until there are ``CANDIDATES_A_SET`` for each set, or members of long runs among them, and are gone when the next are asked for.
    """
    spark = sets.sparkSession
    level, bits = _levels(sets, n)
    known = spark.sparkContext.broadcast(level)
    each = max(12, math.ceil(n * 50 / KEYS_A_BUCKET / rounds))  # buckets
    held, total = [], 0
    for i in range(rounds):
        _freed(spark)
        held.append(Stored(_met(sets, known, bits, i * each, (i + 1) * each, rounds * each, similarity), "candidates"))
        rows, pairs = held[-1].df.agg(F.count(F.lit(1)), F.count("b")).first()
        total += pairs
        if i == rounds - 1 or rows > pairs or total >= CANDIDATES_A_SET * n:
            _freed(spark)
            yield _paired(functools.reduce(DataFrame.unionByName, (x.df for x in held)), similarity)
            for x in held:
                x.drop()
            held, total = [], 0
    known.unpersist()


def _met(sets: DataFrame, known, bits: int, low: int, high: int, buckets: int, similarity: float) -> DataFrame:
    """Pairs (a, b) that meet at a shingle of the buckets from ``low`` to below ``high``, and beside them the members (a, key and so on) of long runs."""

    def postings(batches):
        for num, own, sh, size in _grouped(_kept(batches), SHINGLES_AT_ONCE):
            at, key, place, rest = prefixes(own, sh, size.astype(np.int64), known.value[sh >> np.uint32(32 - bits)], similarity, *(-(-(x << 32) // buckets) for x in (low, high)))
            order = (key.astype(np.uint64) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
            order.sort()
            order = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
            key, place, rest, at = key[order], place[order], rest[order], at[order]
            bucket = (key.astype(np.int64) * buckets) >> 32
            many = size[at].astype(np.int64)
            wide = _is_wide(many, place, similarity)
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(key) else np.zeros(0, int)
            cuts = list(zip(begin, np.r_[begin[1:], len(key)]))
            # A set's number travels once a bucket, and each posting says which it is.
            own = [np.unique(at[x:y], return_inverse=True) for x, y in cuts]
            packed = [[_planes(np.diff(key[x:y], prepend=np.uint32(0))) for x, y in cuts], [num[u].tobytes() for u, _ in own], [_planes(i) for _, i in own], [_planes(many[x:y]) for x, y in cuts], [_planes(place[x:y]) for x, y in cuts]]
            short = np.bitwise_xor.reduce(rest, axis=1)
            packed += [[short[x:y][~wide[x:y]].tobytes() for x, y in cuts], [rest[x:y][wide[x:y]].tobytes() for x, y in cuts]]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int32)), *(pa.array(p, pa.binary()) for p in packed)], ["bucket", "keys", "nums", "which", "sizes", "places", "rests", "wides"])

    def pairs(table):
        key, own, nums, size, place, rest = [], [], [], [], [], []
        for r in table.select(["keys", "nums", "which", "sizes", "places", "rests", "wides"]).to_pylist():
            key.append(np.cumsum(_from_planes(r["keys"]), dtype=np.uint32))
            own.append(_from_planes(r["which"]).astype(np.int64) + sum(map(len, nums)))
            nums.append(np.frombuffer(r["nums"], np.int64))
            size.append(_from_planes(r["sizes"]).astype(np.int64))
            place.append(_from_planes(r["places"]).astype(np.int64))
            full = np.zeros((len(key[-1]), WORDS), np.uint64)
            wide = _is_wide(size[-1], place[-1], similarity)
            full[~wide, 0] = np.frombuffer(r["rests"], np.uint64)
            full[wide] = np.frombuffer(r["wides"], np.uint64).reshape(-1, WORDS)
            rest.append(full)
        key, own, nums, size, place, rest = (np.concatenate(c) for c in (key, own, nums, size, place, rest))
        names, first, rank = np.unique(nums, return_index=True, return_inverse=True)
        # Equal sets of several tasks are one posting.
        keep = np.flatnonzero(first[rank[own]] == own)
        order = keep[np.argsort((key[keep].astype(np.uint64) << np.uint64(32)) | size[keep].astype(np.uint64))]
        key, num, size, place, rest = key[order], rank[own[order]], size[order], place[order], rest[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        run = np.diff(np.r_[begin, len(key)])
        run = np.repeat(run, run)
        hot = run > LONG_RUN
        short = (run > 1) & ~hot
        ids, many, at = num[short], size[short], place[short]
        met = [np.zeros(0, np.uint64)]
        for x, y in posting_pairs(key[short], many, at, rest[short], similarity):
            met.append((np.minimum(ids[x], ids[y]).astype(np.uint64) << np.uint64(32)) | np.maximum(ids[x], ids[y]).astype(np.uint64))
        met = np.concatenate(met)
        met.sort()
        met = met[np.r_[True, met[1:] != met[:-1]]] if len(met) else met
        met = names[(met >> np.uint64(32)).astype(np.int64)], names[(met & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        none = pa.nulls(len(met[0]), pa.int64())
        long = [names[num[hot]], key[hot].astype(np.int64), size[hot], place[hot], *rest[hot].view(np.int64).T]
        columns = [pa.chunked_array([none, pa.array(np.ascontiguousarray(c))]) for c in long[1:]]
        columns = [pa.chunked_array([pa.array(met[0]), pa.array(long[0])]), pa.chunked_array([pa.array(met[1]), pa.nulls(len(long[0]), pa.int64())]), *columns]
        return pa.Table.from_arrays(columns, ["a", "b", *HOT])

    packed = sets.mapInArrow(postings, "bucket int, keys binary, nums binary, which binary, sizes binary, places binary, rests binary, wides binary").repartition(high - low, "bucket")
    return packed.groupBy("bucket").applyInArrow(pairs, "a bigint, b bigint, " + ", ".join(f"{c} bigint" for c in HOT))


def _paired(found: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``_met``, those of long runs included."""
    share = similarity / (1 + similarity)
    short = found.where("b is not null").select("a", "b")
    # The members of a long run are joined by Spark, which sorts, spills and splits them; the conditions are those of posting_pairs.
    hot = found.where("b is null").select("a", *HOT)
    x, y = hot.select(F.col("key"), *(F.col(c).alias(f"{c}_x") for c in ("a", *HOT[1:]))), hot.select(F.col("key"), *(F.col(c).alias(f"{c}_y") for c in ("a", *HOT[1:])))
    both = F.col("size_x") + F.col("size_y")
    need = F.ceil(both * share - 1e-9)
    spare = both - F.col("place_x") - F.col("place_y") - 2 * need
    wide = {e: _is_wide(F.col(f"size_{e}"), F.col(f"place_{e}"), similarity) for e in "xy"}
    words = {e: [F.col(f"r{i}_{e}") for i in range(WORDS)] for e in "xy"}
    narrow = {e: F.when(wide[e], functools.reduce(lambda u, v: u.bitwiseXOR(v), words[e])).otherwise(words[e][0]) for e in "xy"}
    apart = [F.bit_count(u.bitwiseXOR(v)) for u, v in zip(words["x"], words["y"])]
    fit = (F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) >= need) & (F.least("size_x", "size_y") >= F.greatest("size_x", "size_y") * similarity - 1e-6)
    long = x.join(y, "key").where("a_x < a_y").where(fit & (F.bit_count(narrow["x"].bitwiseXOR(narrow["y"])) <= spare) & (~(wide["x"] & wide["y"]) | (functools.reduce(lambda u, v: u + v, apart) <= spare))).select(F.col("a_x").alias("a"), F.col("a_y").alias("b"))
    # By one end, as the next join wants them, and each pair once.
    return short.unionByName(long).repartition("a").dropDuplicates(["a", "b"])


def _summed(df: DataFrame, kind: str, table: int, block: int) -> np.ndarray:
    """A table of ``table`` bytes, the union of the blocks (at, part) of all tasks; merged in two steps, so that no task reads one block of every task."""
    out = np.zeros(table, np.uint8)

    def join(t):
        x = np.frombuffer(t["part"][0].as_py(), np.uint8).copy()
        for p in t["part"].to_pylist()[1:]:
            x |= np.frombuffer(p, np.uint8)
        return pa.table({"at": t["at"][:1], "part": [x.tobytes()]})

    some = df.withColumn("g", F.spark_partition_id() % 32)
    first = some.groupBy("at", "g").applyInArrow(lambda t: join(t), kind)
    for r in first.groupBy("at").applyInArrow(join, kind).collect():
        out[r["at"] : r["at"] + block] = np.frombuffer(r["part"], np.uint8)
    return out


def _verified(records: DataFrame, sets: DataFrame, candidates, rounds: int, similarity: float) -> DataFrame:
    """Candidates (a, b), several tables of them, whose sets have at least the similarity, with it."""
    spark = records.sparkSession
    spare = (1 - similarity) / (1 + similarity)
    narrow = records.where("sketch is not null").select("num", "size", "sketch").dropDuplicates(["num"])

    def near(batches):
        for b in batches:
            x, y = _sketches(b.column(3)), _sketches(b.column(5))
            sa, sb = b.column(2).to_numpy().astype(np.int64), b.column(4).to_numpy().astype(np.int64)
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            ok = (apart <= spare * (sa + sb) + 1e-9) & (np.minimum(sa, sb) >= similarity * np.maximum(sa, sb) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    def sketched(pairs: DataFrame, sets: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
        """The pairs whose sketches (num, size, sketch) allow the similarity; ``firsts`` has those of ``a``, if not ``sets``."""
        left = (sets if firsts is None else firsts).select(F.col("num").alias("a"), F.col("size").alias("sa"), F.col("sketch").alias("ka"))
        right = sets.select(F.col("num").alias("b"), F.col("size").alias("sb"), F.col("sketch").alias("kb"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ka", "sb", "kb").mapInArrow(near, "a bigint, b bigint")

    met = [Stored(sketched(some, narrow), "close") for some in candidates]
    pairs = met[0].df
    if len(met) > 1:
        pairs = stored(functools.reduce(DataFrame.unionByName, (m.df for m in met)).dropDuplicates(["a", "b"]), "close")
        for m in met:
            m.drop()
    _freed(spark)
    # Only sets that some pair needs are shuffled: the others fail a membership filter of at most 16 MB; where it is full, the joins alone drop them.
    nodes = pairs.select(F.col("a").alias("num")).union(pairs.select(F.col("b").alias("num")))
    bits = min(27, max(16, math.ceil(math.log2(16 * max(1, pairs.count())))))
    block = 1 << 14

    def slot(num):
        return (_mix(num.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def mark(batches):
        m = np.zeros(1 << bits, bool)
        for b in batches:
            m[slot(b.column(0).to_numpy())] = True
        m = np.packbits(m)
        for a in range(0, len(m), block):
            if m[a : a + block].any():
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([m[a : a + block].tobytes()])], ["at", "part"])

    kind, fine = "at bigint, part binary", "num bigint, size int, sketch binary, shingles binary"
    member = spark.sparkContext.broadcast(_summed(nodes.mapInArrow(mark, kind), kind, (1 << bits) // 8, block))

    def needed(batches):
        m = member.value
        for b in batches:
            s = slot(b.column(0).to_numpy())
            b = b.filter(pa.array(((m[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1).astype(bool)))
            if b.num_rows:
                own, sh, size = _loaded(b.column(1))
                k = parity_sketch(own, sh, len(size), FINE_BITS)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int32)), pa.array([r.tobytes() for r in k], pa.binary()), b.column(1)], ["num", "size", "sketch", "shingles"])

    def jaccard(batches):
        for b in batches:
            (_, x, many), (_, y, most) = _loaded(b.column(2)), _loaded(b.column(3))
            ends = zip(np.cumsum(many).tolist(), many.tolist(), np.cumsum(most).tolist(), most.tolist())
            keep, sim = [], []
            for i, (u, n, v, m) in enumerate(ends):
                z = np.concatenate((x[u - n : u], y[v - m : v]))
                z.sort()
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                j = both / (n + m - both)
                if j >= similarity - 1e-12:
                    keep.append(i)
                    sim.append(j)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())), pa.array(sim, pa.float64())], ["a", "b", "similarity"])

    full = stored(sets.mapInArrow(needed, fine).dropDuplicates(["num"]), "needed")  # written, so that AQE can split the joins at a hub
    # Few of the sets have many such pairs: a finer sketch of them goes before the sets themselves, and the pairs of one part of the sets before those of the next.
    out = []
    for i in range(rounds):
        _freed(spark)
        own = F.pmod(F.xxhash64("num"), F.lit(rounds)) == i
        some, mine = pairs.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == i), full.where(own)
        closer = Stored(sketched(some, full, mine), "closer")
        _freed(spark)
        left, right = mine.select(F.col("num").alias("a"), F.col("shingles").alias("x")), full.select(F.col("num").alias("b"), F.col("shingles").alias("y"))
        out.append(stored(closer.df.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(jaccard, "a bigint, b bigint, similarity double"), "links"))
        closer.drop()
    return functools.reduce(DataFrame.unionByName, out)


def _linked(chunks: DataFrame, id_col: str, text_col: str, stock: DataFrame | None, shingle_words: int, similarity: float, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(members (id, num), links (a, b, similarity) between nums)."""
    texts = chunks.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    if stock is not None:
        texts = texts.join(stock.select(F.col("text").alias("stock_text")).where("stock_text is not null"), F.col("text") == F.col("stock_text"), "left_anti")
    least = max(min_words, shingle_words)
    records = Stored(_records(texts, shingle_words, least), "records").df
    sets = records.where("shingles is not null").select("num", "shingles")
    n = sets.count()
    rounds = min(MOST_ROUNDS, max(1, math.ceil(n / RECORDS_A_ROUND)))
    links = _verified(records, sets, _candidates(sets, n, rounds, similarity), rounds, similarity)
    _freed(links.sparkSession)
    return records.where("id is not null").select("id", "num").distinct(), links


def near_copies(
    chunks: DataFrame,
    stock: DataFrame | None = None,
    id_col: str = "id",
    text_col: str = "text",
    shingle_words: int = 5,
    similarity: float = 0.8,
    min_words: int = 20,
) -> DataFrame:
    """All pairs of records whose shingle sets have the Jaccard similarity (above 0): (chunk_id_a, chunk_id_b), a < b.

    Words are runs of letters or digits, lower case; texts with fewer than
    ``min_words`` words, NULL, empty and blank texts, NULL ids, and texts equal
    to a stock text have no pairs. Repeated deliveries of an id count once;
    records with equal sets are pairs, however many there are. Texts of any
    length are used whole. Extra columns are ignored; an empty table gives no
    rows. The result has a row per pair by definition, so m equal texts give m
    (m - 1) / 2; use ``near_copy_groups`` where a class per record is enough.
    """
    members, links = _linked(chunks, id_col, text_col, stock, shingle_words, similarity, min_words)
    a = members.select(F.col("num").alias("a"), F.col("id").alias("ia"))
    b = members.select(F.col("num").alias("b"), F.col("id").alias("ib"))
    across = links.join(a, "a").join(b, "b").select("ia", "ib")
    shared = members.groupBy("num").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("num")
    copies = members.join(shared, "num", "left_semi")
    within = copies.select("num", F.col("id").alias("ia")).join(copies.select("num", F.col("id").alias("ib")), "num").where("ia < ib").select("ia", "ib")
    pairs = across.unionByName(within).where("ia <> ib")
    return pairs.select(F.least("ia", "ib").alias("chunk_id_a"), F.greatest("ia", "ib").alias("chunk_id_b")).distinct()


def near_copy_groups(
    chunks: DataFrame,
    stock: DataFrame | None = None,
    id_col: str = "id",
    text_col: str = "text",
    shingle_words: int = 5,
    similarity: float = 0.8,
    min_words: int = 20,
) -> DataFrame:
    """One row per record that has a near copy: (group_id, chunk_id, links).

    ``links`` counts the different texts (distinct shingle sets) the record's
    text is linked to; groups are the components of links and of
    equal sets, named by their smallest id. Exact copies are never expanded
    into pairs. Inputs are treated as in ``near_copies``.
    """
    members, links = _linked(chunks, id_col, text_col, stock, shingle_words, similarity, min_words)
    first = members.groupBy("num").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    rep = first.select("num", "rep")
    a, b = rep.select(F.col("num").alias("a"), F.col("rep").alias("src")), rep.select(F.col("num").alias("b"), F.col("rep").alias("dst"))
    edges = links.join(a, "a").join(b, "b").select("src", "dst")
    copies = members.join(first.where("n > 1").select("num", "rep"), "num").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    groups = connected_components(edges.unionByName(copies))
    sized = groups.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("component")
    ends = links.where("similarity < 1").select(F.col("a").alias("num")).unionByName(links.where("similarity < 1").select(F.col("b").alias("num")))
    per = ends.groupBy("num").agg(F.count(F.lit(1)).alias("links"))
    linked = members.join(per, "num", "left").groupBy("id").agg(F.max(F.coalesce("links", F.lit(0))).alias("links"))
    return groups.join(sized, "component", "left_semi").join(linked, groups["node"] == linked["id"]).select(F.col("component").alias("group_id"), F.col("node").alias("chunk_id"), F.col("links").cast("bigint").alias("links"))
