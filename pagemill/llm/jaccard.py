"""Documents linked by the Jaccard similarity of their word shingles: a grouped prefix join.

1. *Sets.* Every document gives its number of shingles and a 128-bit digest of the set;
   documents with one set are a class, and one of them stands for it. It also gives 4,096 bits that tell which shingles
   the set may have; they stay where they are written until a pair or an open list asks for them. In the same pass shingles are
   counted in a sketch of fixed size, which orders them all: rare ones first. The order is only
   a matter of speed, any order gives the same links.
2. *Groups.* The prefix of a set are its first ``n - ceil(0.75 n) + 1`` shingles; two sets that reach the threshold share one of
   them. Sets with one prefix and one size are a group. A task deals the prefix of a group once, with half of the bits of each
   shingle (others that look the same only make a list longer), and its members, a row for each set, go another way.
3. *Filter.* A list holds the groups with one shingle in their prefix. A short list gives its pairs of groups that pass the tests of size and
   position. In a long list (near copies, mostly) groups meet only a few others: stars of some 256
   around a common group, then stars of those.
4. *Expand and verify.* A pair of groups becomes the pair of their first members; the members of a group meet the first one, again in
   stars. What their bits can't share is left out, then both texts of each pair are brought together, compressed (less than half
   as long as sets of 64-bit numbers), and their sets compared. Bits are sent folded, some two for each shingle of the set.
5. *The rest.* Lists, now expanded to all members of their groups, are gone through once more: members in one component need
   no further link. Members of lists that are in several components come together, once for each component that is the largest one of such a list.
   There those outside it meet all members in other components that share a list with them: first with their bits, then those
   that may link at all with their compressed texts, and the sets themselves are compared. A link joins two components at once, what is joined is not compared again, and a task gives only the links that join: fewer than it
   has members. So no link between components is lost, and near copies that don't link cost comparisons, but no rows.

Rows: null, empty and wordless texts have no shingles, link with nothing and are their own component.
Repeated rows, and rows that share an id, are one node of the graph; each row has the count of its
own text. Rows with a null id are returned without a component. Other columns may have any name.
Empty tables give empty tables. A list of one shingle (20 bytes for each group with it in its prefix, and 70 for each member) is held by one task; the
rare-first order keeps what many different documents share out of the lists. Members that come together in step 5 are dealt in parts, and a task has two of
them: of m members some 45 times the root of m.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Scratch, components, fresh, hot_join
from pagemill.llm.shingles import mixed, shingles

#: Counters of the sketch, and how many are in a row; longest list all of whose pairs are tried;
#: documents for one head of a star; entries of a bucket and entries a task gathers before it hands them on.
_CELLS, _ROW = 1 << 20, 1 << 12
_SHORT, _FAN = 6, 256
_BUCKET, _FLUSH = 1_000_000, 1_000_000
#: Bits of a set, and of its shortest form; sets or groups that a task remembers; shingles of sets that it holds at once to compare them.
_BITS, _FOLDED, _SEEN, _HELD = 4096, 256, 100_000, 4_000_000
#: Members of which all pairs may be compared by one task; more are dealt in parts.
_PART = 512


def _prefix(n):
    """Shingles to look at, of n; links need 75 in 100."""
    return n - (75 * n + 99) // 100 + 1


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_CELLS, np.uint32)
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("bits", pa.binary())])
    for batch in batches:
        ids, ns, sigs, bits = batch.column(0), [], [], []
        for text in batch.column(1):
            x = shingles(text.as_py())
            ns.append(len(x))
            sigs.append(xxhash.xxh3_128_digest(x.tobytes()))
            bits.append(_bits(x).tobytes() if len(x) else None)
            # A document has a shingle once, but two of its shingles may share a counter.
            np.add.at(counts, (x & np.uint64(_CELLS - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(ns), pa.int32()), ids, pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bits, pa.binary())], schema=schema)
    rows = counts.reshape(-1, _ROW)
    used = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array([1] * len(used), pa.int32()), pa.array(used), pa.array([0] * len(used), pa.int64()), pa.array([rows[i].tobytes() for i in used], pa.binary()), pa.nulls(len(used), pa.binary())],
        schema=schema,
    )


def _sum_rows(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_ROW, np.uint64)
    for b in batches:
        for data in b.column("data"):
            total += np.frombuffer(data.as_py(), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["id", "data"])


def _bits(x: np.ndarray) -> np.ndarray:
    out = np.zeros(_BITS, np.uint8)
    out[(x >> np.uint64(52)).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of bits with ``size`` of them: places that are a multiple of it apart become one."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, size // 64), axis=1)


def _short(each: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """The ``bits`` of rows, folded to the next power of two that gives ``each`` shingle so many, if that is fewer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for n, x in zip(batch.column("n").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            size = min(_BITS, max(_FOLDED, 1 << (each * n - 1).bit_length()))
            out.append(_folded(np.frombuffer(x, np.uint64)[None], size).tobytes())
        return batch.set_column(batch.schema.names.index("bits"), "bits", pa.array(out, pa.binary()))

    return run


class _Bits:
    """Bits of rows that have more or fewer of them; two rows are compared in the form of the shorter one."""

    def __init__(self, data: list[bytes]):
        self.size = np.array([8 * len(x) for x in data], np.int64)
        self._rows, self._at = {}, {}
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == size)
            self._rows[size] = np.frombuffer(b"".join(data[i] for i in own), np.uint64).reshape(len(own), -1)
            at = self._at[size] = np.zeros(len(data), np.int64)
            at[own] = np.arange(len(own))

    def take(self, places: np.ndarray, size: int) -> np.ndarray:
        out = np.empty((len(places), size // 64), np.uint64)
        for own, rows in self._rows.items():
            if own >= size and len(i := np.flatnonzero(self.size[places] == own)):
                out[i] = _folded(rows[self._at[own][places[i]]], size)
        return out


def _differ(x: _Bits, i: np.ndarray, y: _Bits, j: np.ndarray) -> np.ndarray:
    """In how many bits rows ``i`` of x differ from rows ``j`` of y."""
    size, out = np.minimum(x.size[i], y.size[j]), np.zeros(len(i), np.int64)
    for s in np.unique(size).tolist():
        own = np.flatnonzero(size == s)
        out[own] = np.bitwise_count(x.take(i[own], s) ^ y.take(j[own], s)).sum(axis=1, dtype=np.int64)
    return out


def _most(n1, n2, differ):
    """How many shingles two sets may share at most, if so many of their bits differ: each such bit is a shingle of one set alone."""
    return (n1 + n2 - differ) // 2


_DEALT = pa.schema([("bucket", pa.int64()), ("data", pa.binary()), ("g", pa.int64()), ("sig", pa.binary()), ("n", pa.int64())])
_DEALT_SQL = "bucket long, data binary, g long, sig binary, n long"


def _deal_prefixes(order: np.ndarray, buckets: int):
    """Entries of groups by bucket: packed shingles, groups, set sizes, positions and how many odd shingles
    the group has, which are much rarer than those in the middle of its prefix. And a row for each set: its group, digest and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, groups, parts, members, size = set(), set(), [], [], 0

        def flush():
            if parts:
                token, g, n, pos, odd = (np.concatenate(c) for c in zip(*parts, strict=True))
                b = (mixed(token) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(b, kind="stable")
                cuts = np.flatnonzero(np.diff(b[by])) + 1
                token, pos = token >> np.uint64(32), np.minimum(pos, 65535)  # an earlier position only makes its test weaker
                packed = [_pack(token[i], g[i], n[i], pos[i], odd[i]) for i in np.split(by, cuts)]
                firsts, k = b[by][np.concatenate(([0], cuts))], len(cuts) + 1
                yield pa.RecordBatch.from_arrays([pa.array(firsts), pa.array(packed, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], schema=_DEALT)
            if members:
                g, sig, n = zip(*members)
                yield pa.RecordBatch.from_arrays([pa.array([x % buckets for x in g], pa.int64()), pa.nulls(len(g), pa.binary()), pa.array(g, pa.int64()), pa.array(sig, pa.binary()), pa.array(n, pa.int64())], schema=_DEALT)
            parts.clear()
            members.clear()

        for batch in batches:
            for text in batch.column("text"):
                x = shingles(text.as_py())
                digest = xxhash.xxh3_128_digest(x.tobytes())
                if len(x) == 0 or digest in seen:
                    continue  # an equal set of this task has been dealt
                rank = order[(x & np.uint64(_CELLS - 1)).astype(np.int64)]
                n, k = len(x), _prefix(len(x))
                # x ascends, so equal ranks keep the order of the shingles themselves.
                first = np.argsort(rank, kind="stable")[:k]
                prefix = x[first]
                g = xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=n) - (1 << 63)
                members.append((g, digest, n))
                seen.add(digest)
                if g not in groups:
                    groups.add(g)
                    odd = min(65535, int((rank[first] < rank[first[k // 2]] / 2).sum()))
                    parts.append((prefix, np.full(k, g, np.int64), np.full(k, n, np.uint32), np.arange(k, dtype=np.uint32), np.full(k, odd, np.uint16)))
                    size += k
                if len(seen) > _SEEN:
                    seen.clear()
                    groups.clear()
                if size >= _FLUSH or len(members) > 20_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


_KINDS = (np.uint32, np.int64, np.uint32, np.uint16, np.uint16)


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(c.astype(k, copy=False).tobytes() for c, k in zip(columns, _KINDS, strict=True))


def _unpack(data: bytes, kinds=_KINDS) -> list[np.ndarray]:
    n, out, at = len(data) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _possible(n1, p1, n2, p2):
    """The tests of size and position; sound at the first shingle that two sets share."""
    n1, n2, p1, p2 = (x.astype(np.int64) for x in (n1, n2, p1, p2))
    left = 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * np.minimum(n1, n2) >= 75 * np.maximum(n1, n2)) & (175 * left >= 75 * (n1 + n2))


def _central(docs: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Places of documents, those with the fewest odd shingles first: in a group of near copies these
    are nearest to all others. The order is the same in every list."""
    return np.lexsort((mixed(docs.astype(np.uint64)), odd))


def _stars(docs: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``docs`` that join all of them: each with one of the most central, one for some
    256, and these with the first of them."""
    order = _central(docs, odd)
    heads = 1 << max(0, int(np.ceil(np.log2(len(docs) / _FAN))))
    rest = order[heads:]
    own = order[(mixed(docs[rest].astype(np.uint64)) & np.uint64(heads - 1)).astype(np.int64)]
    return np.concatenate((np.full(heads - 1, order[0]), own)), np.concatenate((order[1:heads], rest))


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    keep = lo != hi
    pairs = np.unique(np.stack([lo[keep], hi[keep]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


_FOUND = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("data", pa.binary()), ("sig", pa.binary())])
_FOUND_SQL = "kind int, bucket long, a long, b long, data binary, sig binary"


def _found(kind: int, bucket: int, n: int, a=None, b=None, data=None, sig=None) -> pa.RecordBatch:
    given = zip((a, b, data, sig), _FOUND.types[2:])
    cols = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, bucket, np.int64))]
    return pa.RecordBatch.from_arrays(cols + [pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in given], schema=_FOUND)


def _first_round(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups of a bucket (kind 0), its long lists as they are (1), the groups in these (2) and the members that came along (3)."""
    bucket, parts = key[0].as_py(), []
    for batch in batches:
        own = batch.filter(pc.is_valid(batch.column("g")))
        if len(own):
            yield _found(3, bucket, len(own), own.column("g"), own.column("n"), sig=own.column("sig"))
        parts += [_unpack(x.as_py()) for x in batch.filter(pc.is_null(batch.column("g"))).column("data")]
    if not parts:
        return
    token, doc, n, pos, odd = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    by = np.lexsort((pos, doc, token))
    # Several tasks may have dealt a group, and two of its shingles may look the same: the first position counts.
    by = by[np.concatenate(([True], (token[by][1:] != token[by][:-1]) | (doc[by][1:] != doc[by][:-1])))]
    token, doc, n, pos, odd = (x[by] for x in (token, doc, n, pos, odd))
    by = np.arange(len(token))
    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    lengths = np.diff(np.append(starts, len(token)))
    run = np.repeat(lengths, lengths)
    short = by[(run > 1) & (run <= _SHORT)]
    t = token[(run > 1) & (run <= _SHORT)]
    a_all, b_all = [], []
    for d in range(1, _SHORT):
        i = np.flatnonzero(t[d:] == t[:-d]) if d < len(t) else ()
        if not len(i):
            break
        x, y = short[i], short[i + d]
        ok = _possible(n[x], pos[x], n[y], pos[y])
        a_all.append(doc[x[ok]])
        b_all.append(doc[y[ok]])
    long_docs, parent = [], {}

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = i = parent.get(up, up)
        return i

    waiting = []

    def lists() -> pa.RecordBatch:
        """Whole lists, one after the other."""
        i = np.concatenate(waiting)
        waiting.clear()
        return _found(1, bucket, 1, data=[token[i].tobytes() + doc[i].tobytes()])

    long_ = np.flatnonzero(lengths > _SHORT)
    for i in long_[np.argsort(-lengths[long_], kind="stable")]:
        own = by[starts[i] : starts[i] + lengths[i]]
        # Most lists of a group of near copies hold what earlier lists have joined already; of
        # documents that are joined the most central one stands for all.
        order = _central(doc[own], odd[own])
        first = order[np.unique([root(d) for d in doc[own[order]].tolist()], return_index=True)[1]]
        if len(first) > 1:
            x, y = _stars(doc[own[first]], odd[own[first]])
            x, y = own[first[x]], own[first[y]]
            ok = _possible(n[x], pos[x], n[y], pos[y])
            x, y = doc[x[ok]], doc[y[ok]]
            a_all.append(x)
            b_all.append(y)
            for c, d in zip(x.tolist(), y.tolist(), strict=True):
                parent[root(d)] = root(c)
        long_docs.append(doc[own])
        waiting.append(own)
        if sum(map(len, waiting)) > 50_000:
            yield lists()
    if waiting:
        yield lists()
    if long_docs:
        ids = np.unique(np.concatenate(long_docs))
        yield _found(2, bucket, len(ids), ids)
    if a_all:
        a, b = _unique_pairs(np.concatenate(a_all), np.concatenate(b_all))
        yield _found(0, bucket, len(a), a, b)


def _mixed_lists(lists: pa.Table, g: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """The lists of a cell that are in several components: places of their members, whose groups ``g`` ascend, the largest component and the token."""
    single = lists.filter(pc.is_null(lists["data"]))  # the list of a group: a row for each group in it
    packed = [_unpack(x, (np.uint32, np.int64)) for x in lists["data"].drop_null().to_pylist()]
    for token, own in [*packed, (single["token"].to_numpy(), single["g"].to_numpy())]:
        starts = np.flatnonzero(np.diff(token, prepend=token[:1] + 1))
        for first, one in zip(starts.tolist(), np.split(own, starts[1:])) if len(own) else ():
            lo, hi = np.searchsorted(g, one), np.searchsorted(g, one, "right")
            ends = np.cumsum(hi - lo)
            at = np.repeat(hi - ends, hi - lo) + np.arange(ends[-1])
            names, counts = np.unique(comp[at], return_counts=True)
            if len(names) > 1:
                yield at, names[counts.argmax()], int(token[first])


def _unsettled(key, lists, members):
    """The members of the lists of a cell that are in several components, by the largest component of a list, with short names of the lists. Two lists
    with one name are one list, which costs time only."""
    members = members.sort_by([("g", "ascending"), ("rep", "ascending")])
    rep, comp = (members[c].to_numpy() for c in ("rep", "component"))
    cell, parts = xxhash.xxh3_64_intdigest(key[0].as_py()), [(np.empty(0, np.int64),) * 4]
    for at, main, token in _mixed_lists(lists, members["g"].to_numpy(), comp):
        name = xxhash.xxh3_64_intdigest((token % (1 << 64)).to_bytes(8), seed=cell) & 0xFFFFFFFF
        parts.append((np.full(len(at), main, np.int64), rep[at], comp[at], np.full(len(at), name, np.int64)))
    main, node, component, name = (np.concatenate(c) for c in zip(*parts, strict=True))
    by = np.lexsort((node, main))
    main, node, component, name = (x[by] for x in (main, node, component, name))
    starts = np.flatnonzero(np.concatenate(([True], (main[1:] != main[:-1]) | (node[1:] != node[:-1])))) if len(by) else by
    names = [x.astype(np.uint32).tobytes() for x in np.split(name, starts[1:])] if len(by) else []
    return pa.table({"main": main[starts], "rep": node[starts], "component": component[starts], "lists": pa.array(names, pa.binary())})


def _candidates(lists: pa.Table, members: pa.Table, comp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each member outside the largest component of a list, places of the members of its lists that are in other components and may link by
    their bits, the likeliest first. Groups ascend in ``members``, with components ``comp``, which may change in between."""
    if len(comp) == 0 or comp.min() == comp.max():
        return
    g, rep, n = (members[c].to_numpy() for c in ("g", "rep", "n"))
    part = members["part"].to_numpy() if "part" in members.column_names else None  # pairs within a part are another task's
    bits, mixed_lists, lists_of = _Bits(members["bits"].to_pylist()), [], {}
    for at, main, _ in _mixed_lists(lists, g, comp):
        for i in at[comp[at] != main].tolist():
            lists_of.setdefault(i, []).append(len(mixed_lists))
        mixed_lists.append(at)
    there = np.zeros(len(g), bool)
    for i, own in lists_of.items():
        there[:] = False
        for x in own:
            there[mixed_lists[x]] = True
        there &= (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= 75 * np.maximum(n, n[i]))
        if part is not None:
            there &= part != part[i]
        other = np.flatnonzero(there)
        share = _most(n[i], n[other], _differ(bits, np.full(len(other), i), bits, other))
        ok = 175 * share >= 75 * (n[i] + n[other])
        other, share = other[ok], share[ok]
        yield i, other[np.lexsort((rep[other], -share))]


def _between(check: Callable[[int, int], bool] | None):
    """Pairs of members of the lists of a cell that are in different components and whose bits allow the threshold. With a ``check`` of two
    places, members in the order of their groups, only pairs that pass it and join two components which no pair before has joined."""

    def run(key, lists, members):
        members = members.sort_by([("g", "ascending"), ("rep", "ascending")])
        rep, comp = members["rep"].to_numpy(), members["component"].to_numpy().copy()
        a_all, b_all = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, other in _candidates(lists, members, comp):
            if check is not None:
                links = []
                for j in other.tolist():
                    if comp[j] != comp[i] and check(i, j):
                        comp[comp == comp[j]] = comp[i]
                        links.append(j)
                other = np.array(links, np.int64)
            a_all.append(np.full(len(other), rep[i]))
            b_all.append(rep[other])
        a, b = _unique_pairs(np.concatenate(a_all), np.concatenate(b_all))
        return pa.table({"a": a, "b": b})

    return run


class _Sets:
    """The sets of compressed texts; those that don't fit in what a task holds are made again."""

    def __init__(self, data: list[bytes]):
        self._data, self._known, self._held = data, {}, 0

    def __getitem__(self, i: int) -> np.ndarray:
        x = self._known.get(i)
        if x is None:
            x = _set(self._data[i])
            if self._held + len(x) <= _HELD:
                self._known[i] = x
                self._held += len(x)
        return x


def _together(key, members: pa.Table, row: np.ndarray, n: np.ndarray, bits: list[bytes]) -> tuple[pa.Table, pa.Table]:
    """Lists and members, sets number by number, of members that came together: ``row`` tells where each set comes from."""
    names = [np.unique(np.frombuffer(b"".join(x), np.uint32)) for x in members["lists"].to_pylist()]
    token, at = np.concatenate([names[r] for r in row]).astype(np.int64), np.repeat(np.arange(len(row)), [len(names[r]) for r in row])
    by = np.argsort(token, kind="stable")
    rows = {"g": np.arange(len(row)), "n": n, "bits": pa.array(bits, pa.binary())}
    rows |= {c: members[c].to_numpy()[row] for c in ("rep", "component")}
    if key[1].as_py() != key[2].as_py():
        rows["part"] = members["part"].to_numpy()[row]
    return pa.table({"token": token[by], "g": at[by], "data": pa.nulls(len(by), pa.binary())}), pa.table(rows)


def _hopeful(key, members):
    """Those of the members that came together, a row for each set, that any other may link to by its bits."""
    lists, rows = _together(key, members, np.arange(len(members)), members["n"].to_numpy(), members["bits"].to_pylist())
    hit = np.zeros(len(rows), bool)
    for i, other in _candidates(lists, rows, rows["component"].to_numpy()):
        if len(other):
            hit[i] = hit[other] = True
    return members.select(["main", "rep"]).filter(pa.array(hit))


def _joining(key, members):
    """The links that join components, of members that came together: a row for each id, with its texts and the names of its lists."""
    texts = members["x"].to_pylist()
    row = np.repeat(np.arange(len(members)), [len(x) for x in texts])  # an id may have several texts
    sets = _Sets([x for own in texts for x in own])
    n, bits = [], []
    for place in range(len(row)):
        x = sets[place]
        n.append(len(x))
        bits.append(_bits(x).tobytes())
    lists, rows = _together(key, members, row, np.array(n, np.int64), bits)
    last = [None, None]

    def check(i: int, j: int) -> bool:
        if last[0] != i:
            last[:] = i, sets[i]
        return _linked(last[1], sets[j])

    return _between(check)(key, lists, rows)


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bits allow the threshold."""
    for batch in batches:
        x, y = (_Bits(batch.column(c).to_pylist()) for c in ("x", "y"))
        n, at = (batch.column("n").to_numpy(), batch.column("m").to_numpy()), np.arange(len(batch))
        share = _most(*n, _differ(x, at, y, at))
        yield batch.select(["a", "b"]).filter(pa.array(175 * share >= 75 * (n[0] + n[1])))


def _set(data) -> np.ndarray:
    return shingles(zlib.decompress(data).decode("utf-8", "surrogatepass"))


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= 75 * (len(x) + len(y) - common)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok, last = [], None
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = _set(x.as_buffer()), y.as_buffer()
            if last is None or last[0] != y:  # pairs with one text come one after the other
                last = y, _set(y)
            ok.append(_linked(x, last[1]))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _taken(ids: DataFrame):
    """A filter of bits for every task, eight for each of ``ids`` but 2^27 (16 MB) at most, and the place of an ``id`` in it."""
    bits = min(1 << 27, max(1 << 15, 1 << (8 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    number = place + 1  # the functions below count from one
    maps = ids.groupBy(F.bitmap_bucket_number(number).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    taken = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():  # 16 MB at most, in one job rather than one for each partition
        taken[(r.row - 1) * 4096 : r.row * 4096] = np.frombuffer(r.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(taken), place


def _hits(shared, batch: pa.RecordBatch) -> np.ndarray:
    place = batch.column("place").to_numpy()
    return np.flatnonzero(shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)


def _rows(shared, change: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """Rows whose place in the filter is taken, as ``change`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != "place"]
            yield change(batch.select(names).take(pa.array(_hits(shared, batch))))

    return run


def _among(df: DataFrame, key: str, ids: DataFrame, scratch: Scratch, change: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda batch: batch) -> DataFrame:
    """``df`` without most of the rows whose ``key`` is not in ``ids`` (of one column): a join drops them anyway, after a shuffle of all.
    The rows that stay are as ``change`` gives them."""
    ids = scratch.keep(ids.toDF("id").distinct())
    shared, place = _taken(ids)
    rows = df.withColumnRenamed(key, "id").withColumn("place", place).withColumnRenamed("id", key)
    return scratch.keep(rows.mapInArrow(_rows(shared, change), df.schema))


def _texts(shared):
    """Texts of the documents whose place in the filter is taken, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _hits(shared, batch)
            data = [zlib.compress(t.as_py().encode("utf-8", "surrogatepass"), 1) for t in batch.column("text").take(pa.array(hit))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(hit)), pa.array(data, pa.binary())], ["id", "x"])

    return run


def _verified(rows: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs whose sets reach the threshold.

    A filter of bits goes to every task, so that texts outside the pairs are left where they are; the join with the pairs is
    exact whatever it lets through.
    """
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    shared, place = _taken(ids)
    texts = rows.withColumn("place", place).mapInArrow(_texts(shared), "id long, x binary")
    texts = scratch.keep(texts.join(ids, "id", "left_semi"))
    both = pairs.join(texts.withColumnRenamed("id", "a"), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("x").alias("y")), "b").select("a", "b", "x", "y")
    links = scratch.keep(both.mapInArrow(_compare, "a long, b long"))
    scratch.drop(texts, ids)
    return links


def _joined(rows: DataFrame, bits_of: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """Links that join what is still apart of the members that came together. First their bits tell which of them may have a link at all; only
    those send texts."""
    bits = _among(bits_of, "id", members.select("rep"), scratch).distinct()  # rows may come again
    likely = _dealt(members, bits.withColumnRenamed("id", "rep")).applyInArrow(_hopeful, "main long, rep long")
    likely = scratch.keep(likely.distinct())
    members = scratch.keep(members.join(likely, ["main", "rep"], "left_semi"))
    ids = scratch.keep(likely.select(F.col("rep").alias("id")).distinct())
    shared, place = _taken(ids)
    texts = rows.withColumn("place", place).mapInArrow(_texts(shared), "id long, x binary").join(ids, "id", "left_semi")
    texts = texts.groupBy("id").agg(F.collect_set("x").alias("x"))
    return _dealt(members, texts.withColumnRenamed("id", "rep")).applyInArrow(_joining, "a long, b long")


def _dealt(members: DataFrame, more: DataFrame):
    """Members with what else ``more`` has of them, by largest component; many of them are dealt in parts, and any two parts meet in one task."""
    parts = members.groupBy("main").agg(F.ceil(F.sqrt(F.count("*") / _PART)).cast("int").alias("parts"))
    dealt = members.join(parts, "main").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.join(more, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).groupBy("main", "low", "high")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles and component_id, the smallest id reachable by links."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    described = scratch.keep(rows.mapInArrow(_describe, "kind int, id long, n long, data binary, bits binary"), "kind")
    members = described.filter("kind = 0").select("id", "n", F.col("data").alias("sig"))

    # The sketch has a fixed size, so it may come to the driver and go to every task.
    sketch = described.filter("kind = 1").groupBy("id").applyInArrow(_sum_rows, "id long, data binary")
    counts = np.zeros((_CELLS // _ROW, _ROW), np.uint64)
    for r in sketch.collect():  # in one job; an iterator takes one for each partition
        counts[r.id] = np.frombuffer(r.data, np.uint64)
    order = np.unique(counts.ravel(), return_inverse=True)[1].astype(np.uint32)
    entries = members.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    buckets = max(8, int(entries // _BUCKET))

    # An id may have several rows; a set is a class, and an id with several sets joins their classes.
    node = members.filter("n > 0 AND id IS NOT NULL")
    bits_of = described.filter("kind = 0 AND n > 0 AND id IS NOT NULL").select("id", "n", "bits")
    classes = scratch.keep(node.groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("rows")))
    named = scratch.keep(hot_join(node.select("id", "sig"), classes, "sig", "rows").select("id", "rep").distinct())
    again = named.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")

    shared = spark.sparkContext.broadcast(order)
    valid = rows.filter("id IS NOT NULL AND text IS NOT NULL")
    dealt = valid.select("text").mapInArrow(_dealer(shared, buckets), _DEALT_SQL)
    found = scratch.keep(dealt.groupBy("bucket").applyInArrow(_first_round, _FOUND_SQL), "kind")

    # One member for each set; a set that several tasks have dealt comes as often.
    sets = found.filter("kind = 3").select("sig", F.col("a").alias("g"))
    sets = sets.groupBy("sig").agg(F.first("g").alias("g"))
    sets = scratch.keep(sets.join(classes.select("sig", "rep"), "sig").select("rep", "g"))
    groups = scratch.keep(sets.groupBy("g").agg(F.min("rep").alias("head"), F.count("*").alias("size")))

    def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()

    met = scratch.keep(ordered(found.filter("kind = 0"), "a", "b"))
    one = groups.select(F.col("g").alias("a"), F.col("head").alias("x"), F.col("size").alias("p"))
    two = groups.select(F.col("g").alias("b"), F.col("head").alias("y"), F.col("size").alias("q"))
    met = scratch.keep(met.join(one, "a").join(two, "b"))
    # Members of a group meet one of them for some 256, and these the first.
    stars = sets.select("rep", "g").join(groups.filter("size > 1"), "g")
    stars = stars.withColumn("cell", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / _FAN)))
    centre = stars.groupBy("g", "cell").agg(F.min("rep").alias("centre"), F.min("head").alias("head"))
    stars = stars.join(centre.select("g", "cell", "centre"), ["g", "cell"])
    pairs = ordered(met, "x", "y").unionByName(ordered(stars, "rep", "centre")).unionByName(ordered(centre, "centre", "head"))
    pairs = scratch.keep(pairs.distinct())

    def tested(pairs: DataFrame) -> DataFrame:
        """The links among pairs: first the bits, then what they leave."""
        own = _among(bits_of, "id", pairs.select(F.explode(F.array("a", "b"))), scratch, _short(2))
        once = own.distinct()  # rows may come again
        x = once.select(F.col("id").alias("a"), "n", F.col("bits").alias("x"))
        y = once.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
        likely = pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_may_link, "a long, b long")
        # A representative of several sets has a row of bits for each.
        likely = scratch.keep(likely.distinct())
        scratch.drop(own)
        return _verified(valid, likely, scratch)

    links = tested(pairs).unionByName(again)
    comps = scratch.keep(components(links, scratch))
    # What is gone through again: the long lists, and each group of several members with the groups that it met in short ones.
    owner = (F.col("p") > F.col("q")) | ((F.col("p") == F.col("q")) & (F.col("a") < F.col("b")))
    several = met.filter("p > 1 OR q > 1").select(F.when(owner, F.col("a")).otherwise(F.col("b")).alias("t"), F.when(owner, F.col("b")).otherwise(F.col("a")).alias("g"))
    own = groups.filter("size > 1").select(F.col("g").alias("t"), "g")
    several = scratch.keep(several.unionByName(own).distinct().select(F.concat(F.lit("g"), F.col("t")).alias("cell"), F.col("t").alias("token"), "g"))
    cell = F.concat(F.lit("b"), F.col("bucket")).alias("cell")
    none = F.lit(None)
    lists = found.filter("kind = 1").select(cell, none.cast("long").alias("token"), none.cast("long").alias("g"), "data")
    lists = lists.unionByName(several.select("cell", "token", "g", none.cast("binary").alias("data")))
    inside = found.filter("kind = 2").select(cell, F.col("a").alias("g")).unionByName(several.select("cell", "g"))
    place = inside.join(sets.select("g", "rep"), "g").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    place = place.select("cell", "g", "rep", F.coalesce("component", "rep").alias("component"))
    open_ = lists.groupBy("cell").cogroup(place.groupBy("cell")).applyInArrow(_unsettled, "main long, rep long, component long, lists binary")
    open_ = scratch.keep(open_.groupBy("main", "rep", "component").agg(F.collect_list("lists").alias("lists")))
    more = scratch.keep(_joined(valid, bits_of, open_, scratch))
    if not more.isEmpty():
        comps = scratch.keep(components(links.unionByName(more), scratch))
    scratch.drop(found)
    classes = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("sig", "rows", F.coalesce("component", "rep").alias("component"))
    linked_rows = hot_join(node, classes, "sig", "rows").select("id", "n", "component")
    alone = members.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    out = linked_rows.unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _dealer(shared, buckets: int):
    def run(batches):
        yield from _deal_prefixes(shared.value, buckets)(batches)

    return run


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that are linked to one with a smaller id; of rows with one id, one stays.
    Rows without an id stay."""
    groups, (i, n, c) = linked(docs, key, text), fresh(docs, "id", "n", "c")
    ids = groups.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(i)).agg(F.count("*").alias(n), F.min("component_id").alias(c))
    out = docs.join(ids.filter(F.col(c) != F.col(i)).select(i), docs[key] == F.col(i), "left_anti")
    repeated = ids.filter((F.col(n) > 1) & (F.col(c) == F.col(i))).select(i)
    if repeated.isEmpty():
        return out
    single = out.join(repeated, out[key] == F.col(i), "left_anti")
    several = out.join(repeated, out[key] == F.col(i), "left_semi").dropDuplicates([key])
    return single.unionByName(several)
