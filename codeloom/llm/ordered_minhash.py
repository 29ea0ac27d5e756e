"""Near-duplicates by order min-hash.

A text's shingles of ``SHINGLE`` words carry their occurrence number. Each of ``SKETCHES``
hash functions picks the ``PICKED`` shingles with the least values and keeps them in text
order, so texts that share a sketch share shingles in the same order. As scattered changes
break most shingles, the least shingle of each of ``LOOSE`` of these functions is a key by
itself too. Texts of one key and one length class are candidates; a banded alignment of
their whole word sequences confirms them when the edit distance is at most a fifth of the
longer one (similarity 0.8).

Equal texts are one node from the start and are never paired. In a bucket, texts are first
aligned with the bucket's least one, which links a group of any size with one pair a
member. Every text is first aligned with the least of all its buckets' least texts; of the
other pairs, only those whose ends are still in different components follow. These pairs of
a bucket grow with its texts, not with their square, and no bucket is capped.

A bucket that then still holds several components is mixed: its texts share a common line or
passage, or there are several groups. There, all pairs of different components are compared, in
blocks of ``BLOCK_TEXTS`` texts that meet each other block of their bucket: first by counts of
hashed words, which tell how many edits a pair takes at least, then, if these may be few enough,
by alignment. So no pair of a bucket is lost. Small buckets cost no more than their texts; in
a bucket of n texts the comparisons grow with the square of n (some ten nanoseconds each), the
rows that are dealt out with n * n / ``BLOCK_TEXTS``, and no task holds more than two blocks.
Texts that share several mixed buckets are compared in the first of them only.

Keys are a random choice, so a link can be missed. Two texts that share four fifths of their
shingles share a key but for 1 in a billion pairs. With one word in five substituted at
random places they share a fifth of their shingles, and 94 of 100 such pairs a key. Texts of
less than some 30 words may have no shingle left then, and are missed.

A class is a connected component of confirmed links; its id is its least document id.

Defined cases: null and empty texts, and texts without words, form a class with equal texts
only; a text of fewer than ``SHINGLE`` words is one shingle; rows that agree in id and text
are one document; null ids sort last and name a class only if it has no other; an empty
table gives an empty table. Sketches are kept in blocks, so a long text needs no more
memory than its word hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import HOT, hot_join, packed, small_batches, split_words
from codeloom.llm.components import components

SHINGLE = 5
SKETCHES = 16
PICKED = 2
#: The least shingle of so many of the hash functions is a key by itself.
LOOSE = 14
#: The lowest bits of a key are the number of its function.
SLOTS = 32
#: Texts of one partition.
TEXTS = 1 << 12
#: Words of a text are counted by so many values of their hash, up to 255 each.
BINS = 256
#: Texts of one block of a mixed bucket, on average.
BLOCK_TEXTS = 1 << 10
#: A text is copied for its alignments, so many times, if it has more than ``ALIGNED`` and over one in ``HOT`` of all.
COPIES, ALIGNED = 32, 256
#: Up to so many pairs are broadcast, to find their texts before these are shuffled: some megabytes.
FEW_PAIRS = 1 << 16
SIMILARITY = 0.8
BLOCK = 1 << 16

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(1, 2**63, SKETCHES, dtype=np.uint64)[:, None]
_ODD = _rng.integers(1, 2**62, SKETCHES, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash of every run of SHINGLE word hashes, told apart by its occurrence number."""
    n = max(len(words) - SHINGLE + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = out * _P + mixed(words[k : k + n])
    order = np.argsort(out, kind="stable")
    placed = out[order]
    new = np.r_[True, placed[1:] != placed[:-1]]
    if not new.all():
        starts = np.flatnonzero(new)
        nth = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        out[order] = mixed(placed + nth.astype(np.uint64) * _P)
    return out


def sketch(words: np.ndarray) -> np.ndarray:
    """One key for each sketch, then one for the least shingle alone of ``LOOSE`` of them."""
    marks = shingles(words)
    best_h = np.full((SKETCHES, PICKED), np.iinfo(np.uint64).max, np.uint64)
    best_at = np.zeros((SKETCHES, PICKED), np.int64)
    for start in range(0, len(marks), BLOCK):
        h = (marks[start : start + BLOCK] ^ _XOR) * _ODD
        h ^= h >> np.uint64(32)
        at = np.argpartition(h, PICKED - 1, axis=1)[:, :PICKED] if h.shape[1] > PICKED else np.broadcast_to(np.arange(h.shape[1]), (SKETCHES, h.shape[1]))
        all_h = np.concatenate([best_h, np.take_along_axis(h, at, 1)], 1)
        all_at = np.concatenate([best_at, at + start], 1)
        order = np.argsort(all_h, axis=1, kind="stable")[:, :PICKED]
        best_h, best_at = np.take_along_axis(all_h, order, 1), np.take_along_axis(all_at, order, 1)
    picked = marks[np.sort(best_at, axis=1)]
    key = np.arange(SKETCHES, dtype=np.uint64)
    for k in range(PICKED):
        key = mixed((key * _P) ^ picked[:, k])
    alone = mixed((np.arange(SKETCHES, SKETCHES + LOOSE, dtype=np.uint64) * _P) ^ marks[best_at[:LOOSE, 0]])
    return np.r_[key, alone] & np.uint64(2**64 - SLOTS) | np.arange(SKETCHES + LOOSE, dtype=np.uint64)


def within(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``: bit-parallel columns of a band of 2 * most + 1 rows."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    head, stop = 0, len(b)
    while head < stop and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < stop - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not b:
        return len(a)
    most = min(most, len(a))
    width = 2 * most + 1
    ones = (1 << width) - 1
    rows: dict = {}
    for k, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << k
    up, down, distance = ones >> most << most, 0, most
    corner = 1 << (width - 1)
    edge = corner >> 1
    for k, x in enumerate(b):
        same, shift = rows.get(x, 0), k - most
        same = (same >> shift if shift >= 0 else same << -shift) & ones
        diagonal = (((same & up) + up) ^ up | same | down) & ones
        right, left = (down | ~(diagonal | up)) & ones, diagonal & up
        if k < len(a) - most:
            distance += not diagonal & corner
        else:
            distance += bool(right & edge) - bool(left & edge)
            edge >>= 1
        up, down = (left | ~(diagonal >> 1 | right)) & ones, diagonal >> 1 & right
    return distance if distance <= most else None


def alike(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether whole texts agree; narrow bands are tried first."""
    x, y = a.encode("utf-8", "replace").split(), b.encode("utf-8", "replace").split()
    longer = max(len(x), len(y))
    most = int((1 - similarity) * longer + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    counts: dict = {}
    for w in x:
        counts[w] = counts.get(w, 0) + 1
    common = 0
    for w in y:
        if n := counts.get(w):
            counts[w] = n - 1
            common += 1
    if longer - common > most:  # the distance is at least this
        return False
    band = 16
    while band < most:
        if within(x, y, band) is not None:
            return True
        band *= 4
    return within(x, y, most) is not None


def node_key(text: Column) -> Column:
    """128 bits that stand for a text; null and empty texts share one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _hashed_words(texts: DataFrame, work: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """(node, n, ``name``): the number of words of each text that has any, and what ``work`` makes of their hashes."""
    words = texts.select("node", F.transform(split_words(F.col("text")), lambda w: F.xxhash64(w)).alias("words")).where(F.size("words") > 0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            flat, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum(column.value_lengths().to_numpy())
            found = [work(part).view(np.int64) for part in np.split(flat, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([b.column(0), column.value_lengths().cast(pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "n", name])

    return words.mapInArrow(each, f"node binary, n long, {name} array<long>")


def sketched(nodes: DataFrame) -> DataFrame:
    """(node, n, keys): each text once, with its number of words and its sketches."""
    return _hashed_words(nodes, sketch, "keys").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))


def binned(words: np.ndarray) -> np.ndarray:
    """How many words have each of ``BINS`` values of their hash: one byte each, eight in a number."""
    counts = np.bincount((words % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    return np.minimum(counts, 255).astype(np.uint8).view(np.uint64)


_EVEN, _LANES = np.uint64(0x00FF00FF00FF00FF), [np.uint64(16 * k) for k in range(4)]


def byte_sums(rows: np.ndarray) -> np.ndarray:
    """Sums of rows of ``BINS`` bytes, added up four at a time in lanes of 16 bits."""
    x = rows.view(np.uint64)
    lanes = ((x & _EVEN) + ((x >> np.uint64(8)) & _EVEN)).sum(1)
    return sum((lanes >> k) & np.uint64(0xFFFF) for k in _LANES).astype(np.int64)


def edits_at_least(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distances of a text and others, by rows of their ``binned`` words: an edit takes and adds one word at most."""
    return byte_sums(np.maximum(one, others)) - np.minimum(byte_sums(one[None]), byte_sums(others))


def _shared(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The rows, with the ``size`` of their key, whose key has several nodes; and their number."""
    short = F.xxhash64("node")  # most keys have one node; what finds them is kept narrow
    several = packed(rows.groupBy(key).agg(F.min(short).alias("low"), F.max(short).alias("high"), F.count("*").alias("size")).where("low < high").select(key, "size"))
    total = several.agg(F.sum("size")).first()[0] or 0
    return packed(hot_join(rows, several, key, "size", total)), total


def _with_buckets(rows: DataFrame, total: int, facts: list[Column], made: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows (key, node, n, step, ...), each once, with what is ``made`` of their two buckets as ``found``.

    A bucket is two neighbouring length classes of a key, as lengths that may agree are at most one class apart. ``made`` takes the number of
    a bucket's upper class and the ``facts`` and sizes of its classes; it runs once for each class of a key, of which there are some dozens at most.
    """
    each = rows.groupBy("key", "step").agg(F.count("*").alias("size"), *facts)
    keys = each.groupBy("key").agg(F.sum("size").alias("_size"), F.collect_list(F.struct(*[c for c in each.columns if c != "key"])).alias("classes"))
    bucket = lambda at: made(at, F.filter("classes", lambda c: c["step"].between(at - 1, at)))
    found = F.map_from_entries(F.transform("classes", lambda c: F.struct(c["step"], F.array(bucket(c["step"]), bucket(c["step"] + 1)))))
    return hot_join(rows, keys.select("key", "_size", found.alias("found")), "key", "_size", total).drop("_size").withColumn("found", F.col("found")[F.col("step")])


def _size(classes: Column) -> Column:
    return F.aggregate(classes, F.lit(0).cast("long"), lambda total, c: total + c["size"])


def _members(shared: DataFrame, total: int) -> DataFrame:
    """(key, node, n, step, firsts): the rows in buckets with several nodes, with the least nodes of these buckets."""
    rows = shared.select("key", "node", "n", F.floor(F.log("n") / float(np.log(1 / SIMILARITY))).alias("step"))
    first = lambda at, classes: F.when(_size(classes) > 1, F.array_min(F.transform(classes, lambda c: c["first"])))
    found = _with_buckets(rows, total, [F.min(F.struct("node", "n")).alias("first")], first)
    firsts = F.array_distinct(F.array_compact("found")).alias("firsts")
    return found.select("key", "node", "n", "step", firsts).where(F.size("firsts") > 0)


def _to_first(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of each bucket's least node with its others, where lengths allow them to agree."""
    near = f"first.node <> node and least(n, first.n) >= {SIMILARITY} * greatest(n, first.n)"
    return members.select("node", "n", F.explode("firsts").alias("first")).where(near).select(F.col("first.node").alias("u"), F.col("node").alias("v"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs, once each, whose ends are in different components."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    return pairs.distinct().join(of("u"), "u", "left").join(of("v"), "v", "left").where("coalesce(u_label, u) <> coalesce(v_label, v)").select("u", "v")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts agree. Both sides read one shuffle of the texts."""
    pairs = packed(pairs)
    if pairs.count() <= FEW_PAIRS:
        texts = texts.join(F.broadcast(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()), "node", "left_semi")
    sides = texts.join(pairs.select("u", F.col("v").alias("node")), "node").select("u", F.col("node").alias("v"), F.col("text").alias("b"))
    return _aligned(sides, pairs, texts.join(pairs.select(F.col("u").alias("node")).distinct(), "node"))


def _aligned(sides: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that agree, of ``sides``, which has the text of v as b, and the ``texts`` of all u. A text that very many pairs need as u is dealt out in copies."""
    busy = pairs.groupBy("u").count().where(F.col("count") > max(pairs.count() / HOT, ALIGNED))
    copied = [bytes(r.u) for r in busy.select("u").collect()]  # fewer than HOT
    salt = lambda u, v: F.when(F.col(u).isin(copied), v).otherwise(0) if copied else F.lit(0)
    salted = sides.withColumn("salt", salt("u", F.pmod(F.xxhash64("v"), F.lit(COPIES))).cast("long"))
    copies = texts.select(F.col("node").alias("u"), F.col("text").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), salt("node", COPIES - 1).cast("long"))).alias("salt"))
    with_both = salted.join(copies, ["u", "salt"]).select("u", "v", "a", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return with_both.mapInArrow(work, "u binary, v binary")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, n, step, label, key, buckets): each text's buckets, as (at, size), of three texts or more that still hold several components; of two texts, one is the first."""
    rows = packed(members.select("key", "node", "n", "step").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    label = lambda end, classes, of: end(F.transform(classes, lambda c: c[of]))
    several = lambda classes: (label(F.array_min, classes, "low") < label(F.array_max, classes, "high")) & (_size(classes) > 2)
    mixed = lambda at, classes: F.when(several(classes), F.struct(at.alias("at"), _size(classes).alias("size")))
    found = _with_buckets(rows, rows.count(), [F.min("label").alias("low"), F.max("label").alias("high")], mixed)
    return packed(found.select("node", "n", "step", "label", "key", F.array_compact("found").alias("buckets")).where(F.size("buckets") > 0))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first columns, by which the batches are sorted."""
    held, last = [], None
    for b in batches:
        key = np.stack([b.column(k).to_numpy() for k in range(keys)])
        starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for start, stop in zip(starts, starts[1:]):
            if start == stop:
                continue
            now = tuple(key[:, start].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, stop - start))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _possible(mixed_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v), once each, of all texts of a bucket in different components that their word counts don't tell apart."""
    counted = _hashed_words(texts, binned, "counts").select("node", "counts")
    nodes = mixed_rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "step", "label")], F.collect_list("key").alias("keys"), F.collect_list(F.struct("key", "buckets")).alias("held"))
    met = nodes.join(counted, "node").withColumn("held", F.explode("held")).select("*", "held.key", F.explode("held.buckets").alias("bucket"))
    blocks = F.ceil(F.col("bucket.size") / BLOCK_TEXTS).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "bucket.at", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "n", "step", "node", "label", "counts", "keys")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 4):
            group = group.combine_chunks()
            key, top, i, j = (group[c][0].as_py() for c in ("key", "at", "i", "j"))
            own, n, step = (group[c].to_numpy() for c in ("own", "n", "step"))
            nodes = group["node"].to_pylist()
            _, label = np.unique(np.array(group["label"].to_pylist(), object), return_inverse=True)
            counts = pc.list_flatten(group["counts"]).to_numpy().view(np.uint8).reshape(len(n), BINS)
            keys = pc.list_flatten(group["keys"]).to_numpy()
            before = np.zeros((len(n), SLOTS), np.int64)
            before[np.repeat(np.arange(len(n)), pc.list_value_length(group["keys"]).to_numpy()), keys % SLOTS] = keys
            before = before[:, : key % SLOTS]
            us, vs = [], []
            for at in range(len(n)):
                if i == j:
                    where = np.arange(at + 1, len(n))
                elif own[at] == i:
                    where = np.flatnonzero(own == j)
                else:
                    continue
                longer = np.maximum(n[where], n[at])
                where = where[(label[where] != label[at]) & (np.minimum(n[where], n[at]) >= SIMILARITY * longer) & (np.maximum(step[where], step[at]) == top)]
                has = np.flatnonzero(before[at])  # a pair is compared in the first bucket it shares
                where = where[~(before[where][:, has] == before[at, has]).any(1)]
                if len(where):
                    most = ((1 - SIMILARITY) * np.maximum(n[where], n[at]) + 1e-9).astype(np.int64)
                    for k in where[edits_at_least(counts[at], counts[where]) <= most].tolist():
                        u, v = sorted((nodes[at], nodes[k]))
                        us.append(u)
                        vs.append(v)
                if len(us) >= BLOCK_TEXTS:
                    yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])
                    us, vs = [], []
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    return met.repartition("key", "at", "i", "j").sortWithinPartitions("key", "at", "i", "j").mapInArrow(work, "u binary, v binary")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links, which join whole components."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
    new = components(between).select(F.col("node").alias("label"), F.col("label").alias("new"))
    moved = labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    alone = new.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), F.col("new").alias("label"))
    return moved.union(alone)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, node, label, class_id, class_size): the class of each row's text."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).alias("id"), node_key(F.col(text)).alias("node"), F.col(text).alias("text"))
    keyed = packed(rows.select("id", "node"))
    nodes = packed(keyed.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    sketches = packed(sketched(rows.select("node", "text")), TEXTS)
    shared, total = _shared(sketches.select("node", "n", F.explode("keys").alias("key")), "key")
    members = packed(_members(shared, total))

    tried = packed(_to_first(members).groupBy("v").agg(F.min("u").alias("u")).select("u", "v"))
    marks = members.select("node", F.lit(None).cast("binary").alias("u"), F.lit(False).alias("is_u")).union(tried.select("v", "u", F.lit(False))).union(tried.select("u", F.lit(None), F.lit(True)))
    chosen = packed(marks.groupBy("node").agg(F.max("u").alias("u"), F.max("is_u").alias("is_u")))
    texts = packed(rows.groupBy("node").agg(F.first("text").alias("text")).join(chosen, "node"), TEXTS)

    sides = texts.where("u is not null").select("u", F.col("node").alias("v"), F.col("text").alias("b"))
    links = packed(_aligned(sides, tried, texts.where("is_u").select("node", "text")))
    texts = texts.select("node", "text")
    labels = packed(components(links))
    labels = packed(_joined(labels, packed(_confirmed(_apart(_to_first(members), labels), texts))))
    rest = _mixed(members, labels)
    if not rest.isEmpty():
        labels = _joined(labels, packed(_confirmed(_possible(rest, texts), texts)))

    named = packed(nodes.join(labels, "node", "left").select("node", "id", "copies", F.coalesce("label", "node").alias("label")))
    sizes = named.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("_nodes"))
    n_nodes, n_rows = named.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    facts = packed(hot_join(named.drop("id"), sizes, "label", "_nodes", n_nodes).drop("_nodes"))
    return hot_join(keyed, facts, "node", "copies", n_rows).select("id", "node", "label", "class_id", "class_size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each class with the least id, with its own columns."""
    found = classes(docs, doc_id, text)
    kept = found.where("id <=> class_id").groupBy("label").agg(F.min(F.struct("id", "node")).alias("k")).select("k.*")
    own = F.concat_ws("=", F.hex("node"), F.col("id").cast("string")).alias("own")  # one key, so that the rows are dealt out once; a null id leaves it shorter
    rows = docs.select(F.col(doc_id).alias("id"), node_key(F.col(text)).alias("node"), F.struct("*").alias("doc")).select(own, "doc")
    return rows.join(kept.select(own), "own", "left_semi").dropDuplicates(["own"]).select("doc.*")
