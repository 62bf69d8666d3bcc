"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has 64 bits. Two fingerprints within `max_bits` of each other are linked. The bits are cut into m
consecutive segments laid on a ring; if the whole distance is at most t, some segment starts a chain whose first l
segments differ in at most l * t / m bits, for every l up to m. The budgets that round down to zero make an equality key
of several whole segments; the further ones prune the pairs of a bucket before the full Hamming check.

Equal fingerprints are one node. A bucket emits a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Names, mixed, partitions, piece_keys, settled, slices, trim, with_heavy, words
from .components import components, forest

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANES = np.uint64(0x0101010101010101)


def _shingle_hashes(data: np.ndarray, at: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of texts end to end, and how many lie before each text's start."""
    import xxhash

    data = _LOWER[data]
    starts, ends, first = words(data, at)
    sizes = ends - starts
    to = np.concatenate([[0], np.cumsum(sizes + 1)])  # in the buffer of words with one space after each
    buffer = np.full(to[-1], 0x20, np.uint8)
    total = int(sizes.sum())
    within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    buffer[np.repeat(to[:-1], sizes) + within] = data[np.repeat(starts, sizes) + within]
    count = np.diff(first)
    many = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    before = np.concatenate([[0], np.cumsum(many)])
    begin = np.repeat(first[:-1], many) + np.arange(before[-1]) - np.repeat(before[:-1], many)
    end = np.minimum(begin + width, np.repeat(first[1:], many))
    flat, digest = buffer.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], seed) for a, b in zip(to[begin].tolist(), (to[end] - 1).tolist())), np.uint64, int(before[-1]))
    return hashes, before


def fingerprints(data: np.ndarray, at: np.ndarray, width: int, seed: int = 42) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set if it is set in over half of the text's shingle hashes."""
    hashes, before = _shingle_hashes(data, at, width, seed)
    many = np.diff(before)
    out = np.zeros(len(many), np.uint64)
    if not len(hashes):
        return out
    pieces = -(-many // 255)  # eight byte counters in a word hold 255 each
    of = np.repeat(np.arange(len(many)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = before[of] + nth * 255
    ones = np.zeros((len(many), 64), np.int64)
    heads = np.flatnonzero(nth == 0)
    for k in range(8):
        counted = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts).view(np.uint8).reshape(-1, 8)
        ones[of[heads], k::8] = np.add.reduceat(counted.astype(np.int64), heads, axis=0)
    bits = (2 * ones > many[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def ring(max_bits: int, segments: int) -> tuple[list[tuple[int, int]], int]:
    """(start, end) bit of each segment, and how many leading segments of a chain must be equal."""
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    equal = max(n for n in range(segments + 1) if n * max_bits // segments == 0)
    if not equal:
        raise ValueError("more segments than differing bits are needed")
    return list(zip(edges, edges[1:])), equal


def _masks(max_bits: int, segments: int) -> np.ndarray:
    """[start, l]: the bits of l + 1 segments of the ring from a start on."""
    cut, _ = ring(max_bits, segments)
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in cut]
    return np.array([[sum(own[(i + j) % segments] for j in range(n + 1)) for n in range(segments)] for i in range(segments)], np.uint64)


def _close(prints: np.ndarray, start: np.ndarray, key: np.ndarray, max_bits: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs among rows sorted by key, found in the buckets of equal keys."""
    masks, (_, equal) = _masks(max_bits, segments), ring(max_bits, segments)
    left, right, step, alive = [], [], 1, np.arange(len(key))
    while len(alive):
        alive = alive[alive + step < len(key)]
        alive = alive[key[alive + step] == key[alive]]
        i = alive
        x = prints[i] ^ prints[i + step]
        for n in range(equal, segments):  # the chain's budgets, then the whole distance
            fits = np.bitwise_count(x & masks[start[i], n]) <= (n + 1) * max_bits // segments
            i, x = i[fits], x[fits]
        left.append(i)
        right.append(i + step)
        step += 1
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


def _close_in_bulk(prints: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of at most two bits among distinct fingerprints, by shared one-bit neighbours: linear in their number."""
    bits = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    left, right = [], []
    for k in range(passes):
        near, owner = [], []
        for bit in bits:
            v = prints ^ bit
            mine = np.flatnonzero(v % np.uint64(passes) == k) if passes > 1 else np.arange(len(v))
            near.append(v[mine])
            owner.append(mine)
        near, owner = np.concatenate(near), np.concatenate(owner)
        order = np.argsort(near, kind="stable")
        near, owner = near[order], owner[order]
        same = np.flatnonzero(near[1:] == near[:-1])
        left.append(owner[same])
        right.append(owner[same + 1])
    return np.concatenate(left), np.concatenate(right)


def _boxes(prints: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """A row for each fingerprint and each of its pigeonring keys: the columns of `prints`, start, key."""
    cut, equal = ring(max_bits, segments)
    keys = []
    for i in range(segments):
        key = F.lit(i).cast("long")
        for a, b in (cut[(i + j) % segments] for j in range(equal)):
            key = F.shiftleft(key, b - a).bitwiseOR(F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        keys.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
    return prints.select(*prints.columns, F.explode(F.array(*keys)).alias("box")).select(*prints.columns, "box.start", "box.key")


BULK = 2048


def _bucket_links(batches: Iterator[pa.RecordBatch], max_bits: int, segments: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket key -> links (a, b) of fingerprints; a bucket is looked at once it is whole."""
    held: list[pa.RecordBatch] = []

    def links(table: pa.Table) -> pa.RecordBatch:
        key, prints, start = (table.column(c).to_numpy() for c in ("key", "print", "start"))
        node, prints = prints, prints.view(np.uint64)
        cut = np.flatnonzero(np.diff(key)) + 1
        sizes = np.diff(np.concatenate([[0], cut, [len(key)]]))
        large = np.repeat(sizes > BULK, sizes) if max_bits <= 2 else np.zeros(len(key), bool)
        small = np.flatnonzero(~large)
        a, b = _close(prints[small], start[small], key[small], max_bits, segments)
        found = [(small[a], small[b])]
        for k in np.flatnonzero(sizes > BULK) if max_bits <= 2 else ():
            lo = int(sizes[:k].sum())
            x, y = _close_in_bulk(prints[lo : lo + sizes[k]], 1 + int(sizes[k]) // 50_000)
            found.append((lo + x, lo + y))
        a, b = (np.concatenate(z) for z in zip(*found))
        # within a bucket the same fingerprint pair links once: a forest of each bucket is enough
        label = forest(len(key), a, b)
        rest = np.flatnonzero(label != np.arange(len(key)))
        return pa.record_batch({"a": pa.array(node[rest], pa.int64()), "b": pa.array(node[label[rest]], pa.int64())})

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < 200_000 or held[0].column("key")[0] == batch.column("key")[-1]:
            continue
        table = pa.Table.from_batches(held)
        key = table.column("key").to_numpy()
        whole = int(np.searchsorted(key, key[-1]))
        yield links(table.slice(0, whole))
        held = table.slice(whole).combine_chunks().to_batches()
    if held:
        yield links(pa.Table.from_batches(held))


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, segments: int = 5) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links lead to.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z lowered. A text of fewer than `width` words is one shingle;
    a null or blank text has fingerprint zero and links like any other. Rows with a null id get their fingerprint and the
    component of that fingerprint (null if no row with an id has it or a linked one). Repeated rows each come back; other
    columns are not read. An empty table gives an empty result. `segments` sets the equality key: about
    64 * (ceil(segments / max_bits) - 1) / segments bits; more segments suit more distinct fingerprints.
    """
    spark = df.sparkSession

    def prints(batches):
        for batch, data, at in slices(batches, "text"):
            yield pa.record_batch({"id": batch.column("id").cast(pa.int64()), "print": pa.array(fingerprints(data, at, width).view(np.int64))})

    docs = settled(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(prints, "id long, print long"))
    nodes = settled(docs.groupBy("print").agg(F.min("id").alias("node"), F.count("*").alias("n")))
    boxes = _boxes(nodes.select("print"), max_bits, segments)
    dealt = boxes.repartition(partitions(spark), "key").sortWithinPartitions("key", "print")
    links = dealt.mapInArrow(lambda x: _bucket_links(x, max_bits, segments), "a long, b long")
    label = nodes.join(components(links).withColumnRenamed("node", "print"), "print", "left").select("print", "n", "node", F.coalesce("component", "print").alias("component"))
    least = label.groupBy("component").agg(F.min("node").alias("component_id"))
    named = label.join(least, "component").select("print", "n", "component_id")
    out = with_heavy(docs, named, "print", "n")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _digests(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each text: a digest of its lowered words."""
    import xxhash

    low, cut = _LOWER[data].tobytes(), at.tolist()
    return [xxhash.xxh3_128_digest(b" ".join(low[a:b].split())) for a, b in zip(cut, cut[1:])]


def _sets(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The 64-bit hashes of the distinct shingles of each text, ascending; a text of fewer words is one shingle."""
    data = _LOWER[data]
    starts, ends, first = words(data, at)
    count = np.diff(first)
    many = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    before = np.concatenate([[0], np.cumsum(many)])
    begin = np.repeat(first[:-1], many) + np.arange(before[-1]) - np.repeat(before[:-1], many)
    hashes = Names(mixed(piece_keys(data, starts, ends)), width)(begin, np.minimum(begin + width, np.repeat(first[1:], many)))
    text = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes = hashes[new]
    cuts = np.searchsorted(text[new], np.arange(len(many) + 1)).tolist()
    return [hashes[a:b] for a, b in zip(cuts, cuts[1:])]


def sketch(text: bytes, width: int) -> bytes:
    """The hashes of all distinct shingles of a text, ascending."""
    return _sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), width)[0].astype("<u8").tobytes()


def resemblance(a: bytes, b: bytes) -> float:
    """The Jaccard similarity of two shingle sets."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) + len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def parity(own: np.ndarray, each: int = 1) -> bytes:
    """A bit for each value of the low bits of a set's hashes: whether an odd number of them has it. There are at least
    `each` times as many bits as hashes, and a power of two, so that bits fold."""
    bits = each * max(64, 1 << max(len(own) - 1, 0).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def within(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """How much two sets may differ in at most, given the sum of their sizes."""
    return sizes * (1 - similarity) / (1 + similarity) + 1e-9


SAMPLE = 8000  # texts whose shingles tell which ones are common
COMMON = 200_000  # shingles known as common at most
MOST_BROADCAST = 1_000_000  # ids


def _lead(own: np.ndarray, similarity: float, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first: sets of the similarity share one of these whatever the order is, as
    long as it is the same for all."""
    many = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, ranks[at], 0)
        own = own[np.argsort(rank, kind="stable")]
    return own[:many]


def _whole(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables that hold each key's rows together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < most or held[0].column("key")[0] == batch.column("key")[-1]:
            continue
        table = pa.Table.from_batches(held)
        key = table.column("key").to_numpy()
        whole = int(np.searchsorted(key, key[-1]))
        yield table.slice(0, whole)
        held = table.slice(whole).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)
    trim()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, without the keys that one row has."""
    for table in _whole(batches):
        key = table.column("key").to_numpy()
        same = key[1:] == key[:-1]
        alone = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        yield from table.filter(pa.array(~alone)).combine_chunks().to_batches()


def _next(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, size, node) -> each with the next of its key in another component, if their sizes allow the
    similarity: no more pairs than rows."""
    for table in _whole(batches):
        key, node, size, comp = (table.column(c).to_numpy() for c in ("key", "node", "size", "component"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])
        heads = np.append(np.flatnonzero(new), len(key))
        after = heads[np.cumsum(new)]
        i = np.flatnonzero(after < len(key))
        j = after[i]
        fits = (key[i] == key[j]) & (size[j] * similarity <= size[i] + 1e-9)
        i, j = i[fits], j[fits]
        yield pa.record_batch({"a": pa.array(np.maximum(node[i], node[j])), "b": pa.array(np.minimum(node[i], node[j]))})


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, without the keys whose rows are all of one component."""
    for table in _whole(batches):
        key, comp = table.column("key").to_numpy(), table.column("component").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(comp, cut) < np.maximum.reduceat(comp, cut)
        yield from table.filter(pa.array(np.repeat(several, np.diff(np.append(cut, len(key)))))).combine_chunks().to_batches()


def _distances(parities: list[bytes]):
    """Hamming distances of pairs (i, j) among parities, the longer of a pair folded to the shorter."""
    sizes = np.array([len(x) for x in parities], np.int64)
    at = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(parities), np.uint8)

    def distance(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        shape = sizes[i] << 32 | sizes[j]
        for kind in np.unique(shape).tolist():
            here = np.flatnonzero(shape == kind)
            many = max(1, (1 << 18) // (kind & 0xFFFFFFFF))
            for lo in range(0, len(here), many):
                mine = here[lo : lo + many]
                x, y = (flat[at[k[mine]][:, None] + np.arange(n)] for k, n in ((i, kind >> 32), (j, kind & 0xFFFFFFFF)))
                while x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                while y.shape[1] > x.shape[1]:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                out[mine] = np.bitwise_count(x ^ y).sum(1)
        return out

    return distance


def _nearest(batches: Iterator[pa.RecordBatch], max_bits: int, segments: int) -> Iterator[pa.RecordBatch]:
    """Rows of `_boxes` sorted by (key, print, node) -> each with the nearest fingerprint of its bucket that is within
    `max_bits` and in another component, and how many bits are equal: no more pairs than rows."""
    masks, (_, equal) = _masks(max_bits, segments), ring(max_bits, segments)
    for table in _whole(batches):
        key, prints, start, node, comp = (table.column(c).to_numpy() for c in ("key", "print", "start", "node", "component"))
        prints, none = prints.view(np.uint64), np.iinfo(np.int64).max
        best, alive, step = np.full(len(key), none), np.arange(len(key)), 1
        while len(alive):
            alive = alive[alive + step < len(key)]
            alive = alive[key[alive + step] == key[alive]]
            i = alive[comp[alive] != comp[alive + step]]
            x = prints[i] ^ prints[i + step]
            for n in range(equal, segments):
                fits = np.bitwise_count(x & masks[start[i], n]) <= (n + 1) * max_bits // segments
                i, x = i[fits], x[fits]
            apart = np.bitwise_count(x).astype(np.int64) << 32
            best[i] = np.minimum(best[i], apart | (i + step))
            best[i + step] = np.minimum(best[i + step], apart | i)
            step += 1
        i = np.flatnonzero(best < none)
        j = best[i] & 0xFFFFFFFF
        yield pa.record_batch({"a": pa.array(np.maximum(node[i], node[j])), "b": pa.array(np.minimum(node[i], node[j])), "n": pa.array(64 - (best[i] >> 32))})


def _likely(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, size, node), without those that no other of the key and another component is like by their sizes
    and parities."""
    for table in _whole(batches, 20_000):
        key, size, comp = (table.column(c).to_numpy() for c in ("key", "size", "component"))
        distance, size = _distances(table.column("parity").to_pylist()), size.astype(np.int64)
        stays, alive, step = np.zeros(len(key), bool), np.arange(len(key)), 1
        while len(alive):
            alive = alive[alive + step < len(key)]
            alive = alive[(key[alive + step] == key[alive]) & (size[alive + step] * similarity <= size[alive] + 1e-9)]
            i = alive[(comp[alive] != comp[alive + step]) & ~(stays[alive] & stays[alive + step])]
            i = i[distance(i, i + step) <= within(size[i] + size[i + step], similarity)]
            stays[i] = stays[i + step] = True
            step += 1
        yield from table.drop_columns("parity").filter(pa.array(stays)).combine_chunks().to_batches()


def _known(node: np.ndarray, tried: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of nodes, and the tried pairs among them (larger, smaller) as one number each, ascending."""
    names, at = np.unique(node, return_inverse=True)
    _, first = np.unique(at, return_index=True)
    out = [np.zeros(0, np.int64)]
    for k in first.tolist():
        if tried[k]:
            other = np.array(tried[k], np.int64)
            spot = np.minimum(np.searchsorted(names, other), len(names) - 1)
            out.append(at[k] * len(names) + spot[names[spot] == other])
    return at, np.unique(np.concatenate(out))


def _across(batches: Iterator[pa.RecordBatch], similarity: float, most: int = 2) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, size, node) -> pairs (a, b) of a key whose components differ, whose sizes and parities allow the
    similarity and that are not among `tried`: the best `most` of each row. A row that has more gives (its node, null) too:
    of each pair left out, both ends do. So there are at most `most` + 1 rows for each, and none is lost."""
    none = np.iinfo(np.int64).max
    for table in _whole(batches, 20_000):
        key, node, size, comp = (table.column(c).to_numpy() for c in ("key", "node", "size", "component"))
        number, known = _known(node, table.column("tried").to_pylist() if "tried" in table.column_names else [None] * len(node))
        size, names = size.astype(np.int64), int(number.max()) + 1
        distance = _distances(table.column("parity").to_pylist())
        best, many = np.full((most, len(key)), none), np.zeros(len(key), np.int64)
        alive, step = np.arange(len(key)), 1
        while len(alive):
            alive = alive[alive + step < len(key)]
            alive = alive[(key[alive + step] == key[alive]) & (size[alive + step] * similarity <= size[alive] + 1e-9)]
            i = alive[comp[alive] != comp[alive + step]]
            apart, both = distance(i, i + step), size[i] + size[i + step]
            fits = apart <= within(both, similarity)
            i, apart, both = i[fits], apart[fits], both[fits]
            if len(i) and len(known):
                pair = np.where(node[i] > node[i + step], number[i] * names + number[i + step], number[i + step] * names + number[i])
                new = known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] != pair
                i, apart, both = i[new], apart[new], both[new]
            if len(i):
                rank = (apart * (1 << 20) // np.maximum(both, 1)) << 32
                for own, other in ((i, i + step), (i + step, i)):
                    many[own] += 1
                    value = rank | other
                    for slot in best:
                        value, slot[own] = np.maximum(value, slot[own]), np.minimum(value, slot[own])
            step += 1
        i = np.tile(np.arange(len(key)), most)[(best < none).ravel()]
        j = best.ravel()[(best < none).ravel()] & 0xFFFFFFFF
        _, once = np.unique(np.maximum(number[i], number[j]) * names + np.minimum(number[i], number[j]), return_index=True)
        i, j, more = i[once], j[once], np.unique(node[many > most])
        b = pa.concat_arrays([pa.array(np.minimum(node[i], node[j]), pa.int64()), pa.nulls(len(more), pa.int64())])
        yield pa.record_batch({"a": pa.array(np.concatenate([np.maximum(node[i], node[j]), more])), "b": b})


FINE = 4  # bits a shingle, of the parities of those whose coarse ones are near
ROUNDS = 2  # of links between neighbours of a key, after those of fingerprints and before all candidates
PRINT_WIDTH, PRINT_BITS, PRINT_SEGMENTS = 3, 3, 7  # fingerprints that make the first candidates


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row: doc_id, component_id: the smallest id of its group of near-duplicates.

    Texts are alike if the Jaccard similarity of their distinct shingles of `width` words is `similarity` or more.

    First each text is a candidate of the nearest SimHash fingerprint in each of its pigeonring buckets. What fingerprints
    do not reveal follows exactly: texts that are alike share one of the first |x| - ceil(similarity * |x|) + 1 shingles of each in any order that is the same for all
    texts: these shingles are the keys of the candidates. The order puts shingles that a sample of the rows has more often
    last, so that buckets are small; the result does not depend on it. In a few rounds each text of a bucket is a candidate
    of the next one in size that is in another component, and keeps on either side the one with which it shares the most
    keys: links of these join most groups. Then come all candidates that are not in one component yet, the nearest few of
    each text at a time, until none is left.

    A pair is dropped if the parities of the two sets differ in more bits than sets of the similarity can; all others are
    checked on all shingles of both texts before they count. Texts of the same lowered words are one; so are blank and
    null texts. Rows that share an id with other texts are linked by any of these. Rows with a null id are left out. Repeated rows each come back; other columns are not read; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")

    def measure(batches):
        for batch, data, at in slices(batches, "text"):
            yield pa.record_batch({"id": batch.column("id"), "digest": pa.array(_digests(data, at), pa.binary())})

    docs = settled(rows.mapInArrow(measure, "id long, digest binary"))

    def each(batches):
        for _, data, at in slices(batches, "text"):
            yield pa.record_batch({"key": pa.array(np.concatenate(_sets(data, at, width)).view(np.int64))})

    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 + docs.count() // SAMPLE)) == 0)
    often = some.mapInArrow(each, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    common, ranks = often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(common)
    common, ranks = common[order], ranks[order]

    def features(batches):
        for batch, data, at in slices(batches, "text"):
            sets = _sets(data, at, width)
            cells = {
                "id": batch.column("id"),
                "digest": pa.array(_digests(data, at), pa.binary()),
                "size": pa.array([len(x) for x in sets], pa.int32()),
                "parity": pa.array([parity(x) for x in sets], pa.binary()),
                "fine": pa.array([parity(x, FINE) for x in sets], pa.binary()),
                "print": pa.array(fingerprints(data, at, PRINT_WIDTH).view(np.int64)),
                "keys": pa.array([_lead(x, similarity, common, ranks).view(np.int64) for x in sets], pa.list_(pa.int64())),
            }
            yield pa.record_batch(cells)

    measured = rows.mapInArrow(features, "id long, digest binary, size int, parity binary, fine binary, print long, keys array<long>")
    least = F.min_by(F.struct("size", "parity", "fine", "print", "keys"), F.col("id"))
    nodes = settled(measured.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("n"), least.alias("f")).select("digest", "node", "n", "f.*"))

    def dealt(keys: DataFrame) -> DataFrame:
        return keys.repartition(partitions(spark), "key").sortWithinPartitions("key", "size", "node")

    first = nodes.select("node", F.explode("keys").alias("key"), "size")
    met = settled(dealt(first).mapInArrow(_met, "node long, key long, size int"))

    def draw(batches):
        for batch, data, at in slices(batches, "text"):
            yield pa.record_batch({"id": batch.column("id"), "sketch": pa.array([x.tobytes() for x in _sets(data, at, width)], pa.binary())})

    def close(batches):
        for batch in batches:
            sizes = batch.column("m").to_numpy().astype(np.int64) + batch.column("n").to_numpy()
            n = batch.num_rows
            gap = _distances(batch.column("x").to_pylist() + batch.column("y").to_pylist())(np.arange(n), np.arange(n, 2 * n))
            yield batch.select(["a", "b"]).filter(pa.array(gap <= within(sizes, similarity)))

    def alike(batches):
        for batch in batches:
            ok = [resemblance(x.as_py(), y.as_py()) >= similarity for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def ends(pairs: DataFrame, table: DataFrame, node: str, of_a: tuple[str, ...], of_b: tuple[str, ...]) -> DataFrame:
        other = [c for c in table.columns if c != node]
        for end, names in (("a", of_a), ("b", of_b)):
            pairs = pairs.join(table.select(F.col(node).alias(end), *[F.col(c).alias(n) for c, n in zip(other, names)]), end)
        return pairs

    def checked(near: DataFrame) -> DataFrame:
        ids = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
        side = F.broadcast(ids) if 2 * near.count() <= MOST_BROADCAST else ids
        drawn = settled(rows.join(side, "id", "left_semi").mapInArrow(draw, "id long, sketch binary").distinct())
        return settled(ends(near, drawn, "id", ("x",), ("y",)).select("a", "b", "x", "y").mapInArrow(alike, "a long, b long").distinct())

    def placed(table: DataFrame, comp: DataFrame | None) -> DataFrame:
        if comp is None:
            return table.withColumn("component", F.col("node"))
        return table.join(comp, "node", "left").select(*table.columns, F.coalesce("component", "node").alias("component"))

    def near_prints(comp: DataFrame | None) -> DataFrame:
        boxes = _boxes(placed(nodes.select("node", "print"), comp), PRINT_BITS, PRINT_SEGMENTS)
        dealt = boxes.repartition(partitions(spark), "key").sortWithinPartitions("key", "print", "node")
        return dealt.mapInArrow(lambda x: _nearest(x, PRINT_BITS, PRINT_SEGMENTS), "a long, b long, n long").groupBy("a", "b").agg(F.max("n").alias("n"))

    def near_keys(comp: DataFrame | None) -> DataFrame:
        return dealt(placed(met, comp)).mapInArrow(lambda x: _next(x, similarity), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n"))

    links = comp = tried = None
    marks = nodes.select("node", "size", "parity")
    for neighbours in (near_prints, *[near_keys] * ROUNDS):
        near = neighbours(comp)
        near = settled(near if tried is None else near.join(tried, ["a", "b"], "left_anti"))
        best = [near.groupBy(own).agg(F.max(F.struct("n", other)).alias("m")).select(own, f"m.{other}").select("a", "b") for own, other in (("a", "b"), ("b", "a"))]
        chosen = settled(best[0].union(best[1]).distinct())
        found = checked(settled(ends(chosen, marks, "node", ("m", "x"), ("n", "y")).select("a", "b", "m", "x", "n", "y").mapInArrow(close, "a long, b long")))
        tried = chosen if tried is None else tried.union(chosen)
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        comp = components(links)
    rows_left, most = met, 2
    while True:
        several = settled(dealt(placed(rows_left, comp)).mapInArrow(_mixed, "node long, key long, size int, component long"))
        if several.isEmpty():
            break
        coarse = dealt(several.join(nodes.select("node", "parity"), "node").select("node", "key", "size", "component", "parity"))
        several = settled(coarse.mapInArrow(lambda x: _likely(x, similarity), "node long, key long, size int, component long"))
        before = tried.groupBy("a").agg(F.collect_list("b").alias("tried")).withColumnRenamed("a", "node")
        full = several.join(nodes.select("node", F.col("fine").alias("parity")), "node").join(before, "node", "left").select("node", "key", "size", "component", "parity", "tried")
        out = settled(dealt(full).mapInArrow(lambda x, most=most: _across(x, similarity, most), "a long, b long").distinct())
        rest, more = out.where("b is not null"), out.where("b is null").select(F.col("a").alias("node"))
        if rest.isEmpty():
            break
        found, tried = checked(rest), tried.union(rest)
        links = found if links is None else links.union(found)
        comp = components(links)
        if more.isEmpty():
            break
        rows_left, most = several.join(more, "node", "left_semi").select("node", "key", "size"), 4 * most
    if comp is None:
        comp = nodes.select("node", F.col("node").alias("component")).limit(0)
    named = nodes.select("digest", "n", "node").join(comp, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component_id"))
    return with_heavy(docs, named, "digest", "n").select(F.col("id").alias("doc_id"), "component_id")
