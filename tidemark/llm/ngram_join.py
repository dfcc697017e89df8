"""N-gram Jaccard join: which documents' sets of word shingles have a Jaccard similarity of at least a threshold.

Documents with the same set are one class, and a class stands for its copies from the first step on. The document-by-shingle incidence matrix is
multiplied with its transpose block by block; overlap counts are summed up per pair and pairs below the overlap that their two sizes
ask for are discarded. Which rows meet in a block comes from the same bound: sets of similarity t and sizes a, b differ in
D = floor((1 - t) / (1 + t) (a + b)) members at most.

1. The shingles are dealt by hash into m segments, m a quarter larger than D at least. Sets that differ in D members agree in m - D whole
   segments, so they share one of the first D + 1 non-empty segments in any common order. A class posts its key under these. A
   segment holds several shingles from all over a document: passages that many documents share seldom fill one, and
   documents meet hardly ever unless they are alike. m and D depend on the size; sizes are grouped so that linked ones lie in one group or two adjacent
   ones, and a class posts for both. (Sets with too few non-empty segments post a common mark besides. In groups whose m is less than 3 D that isn't
   needed, as the chance of so many empty segments is under 1e-9 per document, like that of a clash of 64-bit hashes.)
2. Of each posting list the smallest key is the leader, and the list becomes links (leader, member): as many rows as members, not as pairs.
   Lists that are long already within one task's documents aren't gathered in a task, but led by an aggregation and a join.
3. All members of a leader are one group, so every pair of every posting list is covered. First only sizes and parities are compared: a class's parity is a bit
   for about each of its members, hashed there, that says whether an odd number of members fell on it. Two sets differ in no fewer members than their parities differ
   in bits, so pairs whose parities or sizes are more than D apart are no links. Groups fall apart into what the other pairs connect, and
   the sets of classes left alone never travel. (Groups of more than one block skip this.)
4. A group is cut into blocks of bounded size, and the leader's set goes to each; every block is multiplied with itself: frequent shingles densely, rare ones sparsely. A block returns a spanning forest of its
   links, not the links, and, if its group has more blocks, the members that no link of the block connects to the leader. Only these are multiplied with the
   group's other blocks: all others are one component already. A group of copies so costs rows in proportion to its members.
5. Connected components of the links, brought back to all documents of the classes.

Shingles are compared by 64-bit hashes, sets by a 64-bit key (n sets of different texts hold a false match with a chance of n^2 / 2^65). Defined cases: A-Z count as a-z; words are runs of other characters
than space and U+0009 to U+000D; a document of fewer words than a shingle has its whole sequence as its only one; without words (or text) its set is empty
and it is linked with nothing; ``join`` keeps repeated rows and ids; a row without a doc_id is linked with nothing; other columns are ignored by
``join`` and kept, whatever their names, by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch, storage
from .components import components
from .text import U64, mix, shingles, words

WORDS = 5
PERCENT = 80
#: Members of a posting list within one batch from which on it is dealt by document.
LONG = 16
#: Documents and shingles of a block of the product.
ROWS = 1024
MEMBERS = 3_000_000
#: Postings that a task sorts, about.
POSTINGS = 16_000_000
#: Parts that a long posting list is dealt into.
SALTS = 16
_DENSE = 16
_SUM, _SEGMENT, _WEAK = U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3), U64(0x1D8E4E27C47D124F)
_COLUMNS = 4096


def _keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set of sorted values."""
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values ^ U64(0xA0761D6478BD642F)), dtype=U64)])
    return mix((sums[at[1:]] - sums[at[:-1]]) ^ (np.diff(at).astype(U64) * U64(0xE7037ED1A0B428DB))).view(np.int64)


def _blob_rows(bucket: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, a blob of each column) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = tuple(c[order] for c in columns)
    for b in np.flatnonzero(np.diff(cuts)):
        yield (int(b), *(c[cuts[b] : cuts[b + 1]].tobytes() for c in columns))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _first_of_each(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the nonempty sets of a batch, the first of each key."""
    keep = np.zeros(len(keys), bool)
    keep[np.unique(keys, return_index=True)[1]] = True
    return keep & (sizes > 0)


def parities(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bit for each remainder of a set's values, 1 if an odd number of them has it, of as many remainders as the least power of two that is no smaller than the set, 64 at least."""
    sizes = np.diff(at)
    width = np.int64(1) << np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(width)])
    place = np.repeat(begin[:-1], sizes) + (values & np.repeat(width - 1, sizes).astype(U64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=begin[-1]) & 1).astype(np.uint8), bitorder="little")
    return [packed[a:b].tobytes() for a, b in zip((begin[:-1] >> 3).tolist(), (begin[1:] >> 3).tolist())]


def may_link(size: np.ndarray, parity: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of sets that sizes and parities don't prove to be no links."""
    words = np.array([len(p) >> 3 for p in parity])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for w in np.unique(words):
        own = np.flatnonzero(words == w)
        # The wider parities fold to this width, as remainders do.
        other = np.flatnonzero((words >= w) & (size * percent <= size[own].max() * 100))
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(parity[i], U64).reshape(-1, w), axis=0) for i in other])
        for i in own:
            at = np.flatnonzero((other > i) | (words[other] > w))
            apart = np.bitwise_count(folded[at] ^ np.frombuffer(parity[i], U64)).sum(axis=1, dtype=np.int64)
            apart = np.maximum(apart, np.abs(size[other[at]] - size[i]))
            b = other[at[apart * (100 + percent) <= (100 - percent) * (size[other[at]] + size[i])]]
            found.append((np.full(len(b), i), b))
    return tuple(np.concatenate(x) for x in zip(*found))


def _sets(column, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, bounds and keys of the first document of each set in a column, by blocks of documents."""
    for w in words(column):
        values, at = shingles(w, k)
        sizes, keys = np.diff(at), _keys(values, at)
        keep = _first_of_each(keys, sizes)
        yield values[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]), keys[keep]


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)


def _codes(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 further bits of each signature."""
    return (_bucket(values, buckets).astype(np.int64) << 32) | (values & U64(0xFFFFFFFF)).astype(np.int64)


def _bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> 32).astype(np.int32)


def size_groups(percent: int, largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each group, and the D and m of links whose smaller set is in it. A set's partners of at least its size are in its group or the next."""
    first, differ = [], []
    n = 1
    while n <= largest:
        last = max(n, n * 100 // percent)
        first.append(n)
        differ.append((100 - percent) * (last + last * 100 // percent) // (100 + percent))
        n = last + 1
    d = np.array(differ)
    return np.array(first), d, d + np.maximum(12, d // 4)


def signatures(values: np.ndarray, at: np.ndarray, groups: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What each set is posted under: signatures and the places of their sets, in order of the sets."""
    first, differ, segments = groups
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    mixed, placed = mix(values ^ _SUM), mix(values ^ _SEGMENT) >> U64(32)
    found, owner = [], []
    for step in (0, 1):
        group = np.searchsorted(first, sizes, side="right") - 1 - step
        valid = (group >= 0) & (sizes > 0)
        group = np.maximum(group, 0)
        segment = placed * segments[group][doc].astype(U64) >> U64(32)
        code = (doc.astype(U64) << U64(40)) | segment
        order = np.argsort(code, kind="stable")
        code = code[order]
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        sums = np.add.reduceat(mixed[order], begin) if len(begin) else np.zeros(0, U64)
        own = (code[begin] >> U64(40)).astype(np.int64)
        tag = ((code[begin] & U64((1 << 40) - 1)) << U64(8)) + group[own].astype(U64)
        signature = mix(sums + mix(tag))
        order = np.lexsort((signature, own))
        signature, own = signature[order], own[order]
        filled = np.bincount(own, minlength=len(sizes))
        place = np.arange(len(own)) - (np.cumsum(filled) - filled)[own]
        take = (place <= differ[group][own]) & valid[own]
        weak = np.flatnonzero(valid & (filled <= 2 * differ[group]) & (segments[group] >= 3 * differ[group]) & (differ[group] > 0))
        found += [signature[take], mix(_WEAK + group[weak].astype(U64))]
        owner += [own[take], weak]
    signature, own = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return signature[order], own[order]


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(owner))).astype(np.uint32)


def _long(token: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that occur long times at least, in order, and the places where they do."""
    order = np.argsort(token)
    ordered = token[order]
    begin, size = _runs(ordered)
    out = np.zeros(len(token), bool)
    out[order[np.repeat(size >= long, size)]] = True
    return ordered[begin[size >= long]], out


def _stars(texts: DataFrame, k: int, percent: int, long: int, buckets: int) -> DataFrame:
    """leader and member of each posting list."""
    groups = size_groups(percent)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows: bucket, codes of signatures, and the keys they are posted for, with the length of each key's run; or codes of long
        lists (no keys); or, dealt by document, whole tokens of long lists (no codes)."""
        for batch in batches:
            parts = []
            for values, at, own in _sets(batch.column(0), k):
                signature, place = signatures(values, at, groups)
                parts.append((_codes(signature, buckets), own[place]))
            if not parts:
                continue
            token, key = (np.concatenate(x) for x in zip(*parts))
            parts.clear()  # or everything is there twice
            marked, is_long = _long(token, long)
            rows = [(b, codes, None, None, None) for b, codes in _blob_rows(_bucket_of(marked), buckets, marked.astype(np.uint32))]
            rows += [(b, None, t, o, None) for b, t, o in _blob_rows(_bucket(mix(key[is_long].view(U64)), buckets), buckets, token[is_long], key[is_long])]
            token, key = token[~is_long], key[~is_long]
            bucket = _bucket_of(token)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                s = order[cuts[b] : cuts[b + 1]]
                begin, length = _runs(key[s])
                rows.append((int(b), token[s].astype(np.uint32).tobytes(), None, key[s][begin].tobytes(), length.tobytes()))
            yield _batch(rows, posted)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, tokens, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for bucket, codes, whole, own, runs in zip(*(c.to_pylist() for c in batch.columns)):
                if codes is None:
                    t, o = np.frombuffer(whole, np.int64), np.frombuffer(own, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.nulls(len(t), pa.int64()), pa.array(o)], ["token", "leader", "member"])
                    continue
                token = (bucket << 32) | np.frombuffer(codes, np.uint32).astype(np.int64)
                if own is None:
                    marked.append(token)
                else:
                    tokens.append(token)
                    keys.append(np.repeat(np.frombuffer(own, np.int64), np.frombuffer(runs, np.uint32)))
        t, o, long_ones = np.concatenate(tokens), np.concatenate(keys), np.unique(np.concatenate(marked))
        order = np.lexsort((o, t))
        t, o = t[order], o[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
        t, o = t[new], o[new]
        is_long = np.isin(t, long_ones)
        yield pa.RecordBatch.from_arrays([pa.array(t[is_long]), pa.nulls(int(is_long.sum()), pa.int64()), pa.array(o[is_long])], ["token", "leader", "member"])
        t, o = t[~is_long], o[~is_long]
        first, size = _runs(t)
        leader, keep = np.repeat(o[first], size), np.repeat(size > 1, size)
        if keep.any():
            pair = np.unique(np.stack([leader[keep], o[keep]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.nulls(pair.shape[1], pa.int64()), pa.array(pair[0]), pa.array(pair[1])], ["token", "leader", "member"])

    posted = pa.schema([("bucket", pa.int32()), ("codes", pa.binary()), ("tokens", pa.binary()), ("keys", pa.binary()), ("runs", pa.binary())])
    blobs = texts.mapInArrow(post, "bucket int, codes binary, tokens binary, keys binary, runs binary").repartitionById(buckets, "bucket")
    found = storage.keep(blobs.mapInArrow(lists, "token long, leader long, member long"), "lists")
    open_lists = found.where("token is not null").select("token", "member")
    leaders = open_lists.groupBy("token").agg(F.min("member").alias("leader"), F.max("member").alias("last")).where("leader < last")
    salted = open_lists.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)))
    rest = salted.join(leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), ["token", "salt"]).select("leader", "member")
    return found.where("token is null").select("leader", "member").unionByName(rest).distinct()


def _product(values: np.ndarray, doc: np.ndarray, n: int, m: int) -> np.ndarray:
    """Overlap counts of documents 0..n with documents 0..n (m = 0), or of 0..n with n..n+m."""
    order = np.lexsort((doc, values))
    values, doc = values[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    count = np.diff(np.append(first, len(values)))
    column = np.repeat(np.arange(len(first)), count)
    width = m or n
    out = np.zeros((n, width), np.float32)
    dense = np.flatnonzero(count >= _DENSE)
    place = np.full(len(first), -1)
    place[dense] = np.arange(len(dense))
    at = place[column]
    for lo in range(0, len(dense), _COLUMNS):
        take = (at >= lo) & (at < lo + _COLUMNS)
        block = np.zeros((n + m, min(_COLUMNS, len(dense) - lo)), np.float32)
        block[doc[take], at[take] - lo] = 1
        out += block[:n] @ (block[n:] if m else block).T
    sparse = (at < 0) & (count[column] > 1)
    column, doc = column[sparse], doc[sparse]
    for step in range(1, _DENSE):
        same = column[step:] == column[:-step]
        if not same.any():
            break
        a, b = doc[:-step][same], doc[step:][same]  # a < b
        if m:
            across = (a < n) & (b >= n)
            a, b = a[across], b[across] - n
        out += np.bincount(a * width + b, minlength=n * width).reshape(n, width).astype(np.float32)
        if not m:
            out += np.bincount(b * width + a, minlength=n * width).reshape(n, width).astype(np.float32)
    return out


def block_links(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and for each the least place of a key that links of the block connect it to: links within the block (side all 0), or between its two sides."""
    order = np.argsort(side, kind="stable")
    keys, sets = keys[order], [sets[i] for i in order]
    n, m = int((side == 0).sum()), int((side == 1).sum())
    size = np.array([len(s) for s in sets], np.int64)
    counts = _product(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), n, m)
    left, right = size[:n], size[n:] if m else size
    shared = counts.astype(np.int64)
    linked = 100 * shared >= percent * (left[:, None] + right[None, :] - shared)
    a, b = np.nonzero(linked)
    b = b + n * bool(m)
    keep = keys[a] != keys[b]
    a, b = a[keep], b[keep]
    return keys, _labels(a, b, len(keys))


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place that links a, b connect each of n places to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def _forest(keys: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return list(zip(keys[moved].tolist(), keys[label[moved]].tolist()))


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys, sides and sets of a block's members, each once."""
    keys, side = table["member"].to_numpy(), table["side"].to_numpy().astype(np.int64)
    _, first = np.unique(np.stack([keys, side]), axis=1, return_index=True)
    blobs = table["members"].take(pa.array(first)).to_pylist()
    return keys[first], side[first], [np.frombuffer(b, U64) for b in blobs]


def _blocks(rows: int, members: int) -> Column:
    return F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("n") / members)).cast("int")


def _near(stars: DataFrame, named: DataFrame, percent: int, rows: int, members: int) -> DataFrame:
    """leader and member again, of smaller groups: those that pairs which may be links connect. The other groups' members are left out."""
    sized = stars.join(named.select(F.col("class_key").alias("member"), "n", "parity"), "member")
    large = storage.keep(sized.groupBy("leader").agg(_blocks(rows, members).alias("blocks")).where("blocks > 1").select("leader"), "large")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of whole groups; batches are ordered by leader."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            leader = batch.column(0).to_numpy()
            if not len(leader):
                continue
            # All but the last group of the batch are whole.
            cut = int(np.searchsorted(leader, leader[-1]))
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            elif held and held[-1].column(0)[-1].as_py() != leader[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pa.Table.from_batches(held)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            leader, member, n = (table[c].to_numpy() for c in ("leader", "member", "n"))
            begin, size = _runs(leader)
            out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
            for lo, rows in zip(begin.tolist(), size.tolist()):
                order = lo + np.argsort(member[lo : lo + rows])
                keys = member[order]
                label = _labels(*may_link(n[order], table["parity"].take(pa.array(order)).to_pylist(), percent), rows)
                take = np.bincount(label, minlength=rows)[label] > 1
                out.append((keys[label[take]], keys[take]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["leader", "member"])

    small = sized.select("leader", "member", "n", "parity").join(storage.few(large), "leader", "left_anti")
    parts = small.repartition("leader").sortWithinPartitions("leader").mapInArrow(split, "leader long, member long")
    return storage.keep(parts.unionByName(stars.join(storage.few(large), "leader", "left_semi").select("leader", "member")).distinct(), "near")


def _links(stars: DataFrame, named: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, rows: int, members: int) -> DataFrame:
    """Links a, b that connect what is connected within each leader's group."""
    sized = stars.join(named.select(F.col("class_key").alias("member"), "n", "doc_id"), "member")
    blocks = _blocks(rows, members)
    # Groups of more than one block: one in some hundreds of members at most.
    large = storage.keep(sized.groupBy("leader").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    dealt = sized.join(storage.few(large), "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = dealt.withColumn("block", F.explode(F.when(F.col("member") == F.col("leader"), every).otherwise(F.array("own"))))
    with_sets = lambda df, docs: df.join(sets(docs).withColumnRenamed("class_key", "member"), ["member", "doc_id"])
    first = first.select("leader", "block", F.lit(0).alias("side"), F.col("blocks"), "member", "doc_id")
    first = with_sets(first, named)

    def within(table: pa.Table) -> pa.Table:
        leader, blocks = table["leader"][0].as_py(), table["blocks"][0].as_py()
        keys, side, own = _distinct(table)
        links, apart = [], np.zeros(0, np.int64)
        if len(keys) > 1:
            keys, label = block_links(keys, own, side, percent)
            links = _forest(keys, label)
            apart = keys[label != label[np.flatnonzero(keys == leader)[0]]] if blocks > 1 else apart
        a, b = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
        n = len(apart)
        return pa.table({"leader": pa.array([None] * len(a) + [leader] * n, pa.int64()), "a": np.concatenate([a, apart]), "b": pa.array([*b.tolist(), *[None] * n], pa.int64())})

    found = storage.keep(first.groupBy("leader", "block").applyInArrow(within, "leader long, a long, b long"), "pairs")
    links = found.where("leader is null").select("a", "b")
    apart = found.where("leader is not null").select("leader", F.col("a").alias("member"))
    if apart.isEmpty():
        return links
    # Blocks of members apart, against all blocks of their group.
    apart = apart.join(named.select(F.col("class_key").alias("member"), "n", "doc_id"), "member")
    parts = storage.keep(apart.groupBy("leader").agg(blocks.alias("parts")), "apart")
    small = storage.few(parts)
    one = apart.join(small, "leader").join(storage.few(large), "leader").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    one = one.withColumn("block", F.explode(every)).select("leader", "part", "block", F.lit(0).alias("side"), "member", "doc_id")
    two = dealt.join(small, "leader").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    two = two.select("leader", "part", F.col("own").alias("block"), F.lit(1).alias("side"), "member", "doc_id")

    def across(table: pa.Table) -> pa.Table:
        keys, side, own = _distinct(table)
        links = _forest(*block_links(keys, own, side, percent)) if 0 < side.sum() < len(side) else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    met = storage.keep(one.unionByName(two), "met")
    more = with_sets(met, met).groupBy("leader", "part", "block").applyInArrow(across, "a long, b long")
    return links.unionByName(storage.keep(more, "pairs"))


def join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, long: int = LONG, rows: int = ROWS, members: int = MEMBERS, bits: int | None = None) -> DataFrame:
    """doc_id, n_shingles, class_key (the key of its set) and component_id of every document."""
    if not 1 <= percent <= 99:
        raise ValueError("percent is 1 to 99; equal sets share a class_key")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, parity = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for w in words(batch.column(1)):
                values, at = shingles(w, k)
                n.append(np.diff(at))
                keys.append(_keys(values, at))
                parity += parities(values, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(np.concatenate(keys)), pa.array(parity, pa.binary())], ["doc_id", "n_shingles", "class_key", "parity"])

    written = storage.keep(docs.mapInArrow(describe, "doc_id long, n_shingles long, class_key long, parity binary"), "classes")
    described = written.drop("parity")
    texts = docs.where("doc_id is not null").select("text")
    # A set is posted under a share of its members that follows from percent.
    posted = (described.agg(F.sum("n_shingles")).first()[0] or 0) * 4 * (100 - percent) / (100 + percent)
    buckets = max(storage.partitions(spark), int(posted / POSTINGS))
    stars = storage.keep(_stars(texts, k, percent, long, buckets), "stars")

    candidates = stars.select(F.col("member").alias("class_key")).distinct()
    usable = described.where("doc_id is not null AND n_shingles > 0")
    classes = storage.keep(usable.groupBy("class_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count("*").alias("rows")), "named")
    named = classes.drop("rows").join(candidates, "class_key", "left_semi")
    named = storage.keep(written.select("class_key", "doc_id", "parity").join(named, ["class_key", "doc_id"]).dropDuplicates(["class_key", "doc_id"]), "candidates")
    near = _near(stars, named, percent, rows, members)
    named = storage.keep(named.drop("parity").join(near.select(F.col("member").alias("class_key")).distinct(), "class_key", "left_semi"), "members")

    def sets(those: DataFrame) -> DataFrame:
        """doc_id, class_key and members of documents, among them all of those, each of which stands for a class."""
        wanted = sketch.bloom(those.select("doc_id"), bits or sketch.fitting(those.count()))

        def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.asarray(batch.column(0))
                take = np.flatnonzero(wanted.test(ids.view(U64)))
                out = []
                for w in words(batch.column(1).take(pa.array(take))):
                    values, at = shingles(w, k)
                    for i, key in enumerate(_keys(values, at).tolist()):
                        out.append((int(ids[take[w.lo + i]]), key, values[at[i] : at[i + 1]].tobytes()))
                yield _batch(out, pa.schema([("doc_id", pa.int64()), ("class_key", pa.int64()), ("members", pa.binary())]))

        return docs.where("doc_id is not null").mapInArrow(incidence, "doc_id long, class_key long, members binary")

    links = _links(near, named, sets, percent, rows, members)
    found = components(links)

    # The smallest id of each component, for its classes and then for all documents of them.
    nodes = storage.keep(found.withColumnRenamed("node", "class_key"), "nodes")
    smallest = nodes.join(classes, "class_key").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("nodes"))
    linked = storage.hot_join(nodes, storage.keep(smallest, "smallest"), "component", "nodes").select("class_key", "component_id")
    labels = classes.join(linked, "class_key", "left").select("class_key", F.coalesce("component_id", "doc_id").alias("component_id"), "doc_id", "rows")
    labels = storage.keep(labels.where("rows > 1 OR component_id <> doc_id").drop("doc_id"), "labels")
    out = storage.hot_join(described, labels, "class_key", "rows")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "class_key", F.when(F.col("n_shingles") > 0, own).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of linked ones: that with the smallest doc_id, and one row of it. Rows without an id stay."""
    found = storage.keep(join(docs, **options), "components")
    own, repeated = storage.unused(docs.columns, "id", "repeated")
    kept = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg((F.count("*") > 1).alias(repeated))
    one = docs.join(kept, F.col("doc_id").cast("long") == F.col(own))
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = one.where(~F.col(repeated)).select(*names)
    if not kept.where(repeated).isEmpty():
        out = out.unionByName(one.where(repeated).dropDuplicates([own]).select(*names))
    if not found.where("doc_id is null").isEmpty():
        out = out.unionByName(docs.where("doc_id is null"))
    return out
