"""Near-duplicates by weighted MinHash: BagMinHash signatures, bands, and verified multiset overlap.

A text is the multiset of its five-word shingles. Each shingle owns Poisson processes, one for each interval of a
dyadic ladder of weights: [0, 1), [1, 2), [2, 4), [4, 8), ... A point of an interval falls into a register at a time;
a register keeps its earliest point among those below the shingle's weight. Two texts agree in a register with the
probability of their weighted Jaccard similarity, and a shingle that repeats a thousand times costs ten intervals.
Points come in order of time and stop as soon as they are later than every register's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import named, scope, small, stage, unstage, unused

WORDS = 5
#: Bands of registers: a pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^24 < 4e-6.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Similarity as a fraction, compared in whole numbers.
NUM, DEN = 4, 5
#: Fewer equal registers than this rule a pair out; at similarity 0.8 that has probability below 1e-5.
LEAST_EQUAL = 58
#: Rounds in which members meet leaders of their buckets, and leaders of another component that a member meets in a round.
ROUNDS, LEADERS = 4, 2
#: Another round follows while one pair in so many is a link.
LEAST_FOUND = 20
#: What leaders leave is compared in blocks of about so many members and so many shingles.
BLOCK, BLOCK_SHINGLES = 256, 60_000
#: Words of a batch of texts, and words whose hashes a task remembers.
BATCH, REMEMBERED = 120_000, 150_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of a word, remembered until REMEMBERED of them are."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """64-bit hashes of the five-word shingles in order; a shorter text is one shingle of all its words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(WORDS, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return _mix(out + np.uint64(n))


def bag_min_hash(bags: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """Signatures, one row of m 32-bit numbers for each bag (distinct shingle hashes, counts); none may be empty."""
    doc = np.repeat(np.arange(len(bags)), [len(x) for x, _ in bags])
    x, w = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]).astype(np.int64)
    # Element and interval: the first is [0, 1), interval j > 0 is [2^(j-1), 2^j), wanted where the weight goes beyond its start.
    parts = [(doc, x, np.zeros(len(x), np.int64), w)]
    for j in range(1, int(w.max()).bit_length() + 1):
        more = np.flatnonzero(w > 1 << (j - 1))
        parts.append((doc[more], x[more], np.full(len(more), j), w[more]))
    doc, x, j, w = (np.concatenate(p) for p in zip(*parts, strict=True))
    start, width = np.where(j > 0, 1 << np.maximum(j - 1, 0), 0), np.where(j > 0, 1 << np.maximum(j - 1, 0), 1)
    seed = _mix(x + j.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    inside = np.minimum((w - start) / width, 1.0)  # share of the interval that lies below the weight
    time, best, who = np.zeros(len(x)), np.full(len(bags) * m, np.inf), np.zeros(len(bags) * m, np.uint32)
    k = 0
    while len(doc):
        k += 1
        a = _mix(seed + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        b = _mix(a ^ np.uint64(0xA0761D6478BD642F))
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / width
        slot = doc * m + ((b >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        counts = inside >= 1.0
        if not counts.all():
            counts |= (b & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32 < inside
        at, t = slot[counts], time[counts]
        np.minimum.at(best, at, t)
        first = best[at] == t
        who[at[first]] = (_mix(a[counts][first] + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
        latest = best.reshape(-1, m).max(axis=1)
        left = time < latest[doc]
        doc, seed, width, inside, time = doc[left], seed[left], width[left], inside[left], time[left]
    return who.reshape(-1, m)


def signed(docs: DataFrame) -> DataFrame:
    """docs (id, text) -> id, key (digest of the words; null without words), size (shingles) and sig (registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def done(ids, keys, bags, sizes):
            real = [b for b in bags if b is not None]
            rows = iter(bag_min_hash(real).view(np.int32) if real else ())
            sig = [None if b is None else next(rows) for b in bags]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], names=["id", "key", "size", "sig"])

        for b in batches:
            ids, keys, bags, sizes, n = [], [], [], [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                ids.append(i)
                keys.append(hashlib.md5(b" ".join(words)).digest() if words else None)
                s = shingles(words, hashes)
                bags.append(np.unique(s, return_counts=True) if words else None)
                sizes.append(len(s))
                n += len(words)
                if n >= BATCH:
                    yield done(ids, keys, bags, sizes)
                    ids, keys, bags, sizes, n = [], [], [], [], 0
            if ids:
                yield done(ids, keys, bags, sizes)

    return docs.mapInArrow(run, "id long, key binary, size long, sig array<int>")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sums of the smaller and of the larger counts over all shingles of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose texts' multisets of shingles overlap by 0.8 or more. texts: id, text."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        bag = lambda t: np.unique(shingles(words_of(t), hashes), return_counts=True)
        last = kept = None
        for batch in batches:
            good = []
            for n in range(batch.num_rows):
                b, text = batch.column(1)[n].as_py(), batch.column(3)[n].as_py()
                if last != (b, text):
                    last, kept = (b, text), bag(text)
                both, all_ = overlap(bag(batch.column(2)[n].as_py()), kept)
                if DEN * both >= NUM * all_ and all_:
                    good.append(n)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that an id is connected to, for every id in links (a, b).

    Labels spread over the links and jump to their labels' labels until nothing changes; joins are on ids, and an id
    with very many links is a skewed key of a sort-merge join, which adaptive execution splits."""
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        spread = labels.join(near, "id").select("id", "root", F.least("root", "near").alias("to"))
        jumped = spread.join(labels.select(F.col("id").alias("to"), F.col("root").alias("far")), "to", "left").select("id", F.least("to", F.coalesce("far", "to")).alias("root"), (F.least("to", F.coalesce("far", "to")) < F.col("root")).alias("moved"))
        new = stage(jumped, "labels")
        unstage(labels)
        labels = new
        if not labels.filter("moved").limit(1).count():
            unstage(edges)
            return labels.select("id", "root")


def _leader_pairs(known: DataFrame, turn: int) -> DataFrame:
    """(a, b): each member with leaders of its buckets that it is not connected to, at most LEADERS for a member and a
    component, however many buckets they share.

    In the first turn the leader of a bucket is the member whose buckets are the fullest, as those of the text are that
    others were copied from, and a member meets the two leaders that it shares the most buckets with. Later on leaders
    are members of the bucket's largest component, by a hash that changes with the turn. known: bucket, rep, size, root,
    pop (members of all the buckets that rep is in)."""
    order = F.col("pop") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    leader = F.max(F.struct(order.alias("o"), (-F.col("rep")).alias("r"), "size")).alias("lead")
    groups = known.groupBy("bucket", "root").agg(F.count("*").alias("n"), leader)
    best = F.max(F.struct(F.col("lead") if turn == 0 else F.struct("n"), (-F.col("root")).alias("r"), F.col("lead").alias("x"))).alias("top")
    tops = groups.groupBy("bucket").agg(best, F.count("*").alias("roots")).filter("roots > 1").select("bucket", (-F.col("top.r")).alias("b_root"), (-F.col("top.x.r")).alias("b"), F.col("top.x.size").alias("b_size"))
    met = known.join(tops, "bucket").filter((F.col("root") != F.col("b_root")) & _near("size", "b_size"))
    counted = met.groupBy(F.col("rep").alias("a"), "b_root", "b").agg(F.count("*").alias("shared"))
    key = ["a"] if turn == 0 else ["a", "b_root"]
    ranked = counted.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("shared"), F.xxhash64("b", F.lit(turn)), "b")))
    return ranked.filter(F.col("at") <= LEADERS).select("a", "b")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures leave a similarity of 0.8 possible."""
    at = lambda c: classes.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"))
    equal = F.aggregate(F.zip_with("sig_a", "sig_b", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return pairs.join(at("a"), "a").join(at("b"), "b").filter(equal >= LEAST_EQUAL).select("a", "b")


def _connected(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (id, root) after links (a, b) have joined components: only roots that a link moves are worked on."""
    to = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    ends = links.join(to("a"), "a").join(to("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a <> b").distinct()
    moved = components(stage(ends, "ends")).select(F.col("id").alias("root"), F.col("root").alias("new"))
    return stage(roots.join(small(moved), "root", "left").select("id", F.coalesce("new", "root").alias("root")), "roots")


def _near(x: str, y: str):
    """Sizes that a similarity of 0.8 allows."""
    return DEN * F.least(x, y) >= NUM * F.greatest(x, y)


def bags_of(texts: DataFrame) -> DataFrame:
    """texts (id, text) -> rep, hashes and counts (bytes of 64- and 32-bit numbers) of a text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                bags = [np.unique(shingles(words_of(t.as_py()), hashes), return_counts=True) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x, _ in bags], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in bags], pa.binary())], names=["rep", "hashes", "counts"])

    return texts.select("id", "text").mapInArrow(run, "rep long, hashes binary, counts binary")


def block_links(rows: dict[str, np.ndarray | list], band: int) -> list[tuple[int, int]]:
    """Links (a, b) between the rows of a block: enough of them to connect all whose bags overlap by 0.8 or more.

    rows: other (whether a row is to be compared, or what is compared to), rep, root, size, bands (the buckets of rep),
    hashes, counts. Overlaps are exact: the bags of one side lie end to end, and the counts of one row of the other side
    are held against all of them at once. Rows that a link has connected, or that share an earlier band, whose bucket
    compares them, are not compared again."""
    other, rep, root, size, bands = (np.asarray(rows[c]) for c in ("other", "rep", "root", "size", "bands"))
    left, right = np.flatnonzero(other), np.flatnonzero(~other)
    if not len(left) or not len(right):
        return []
    hashes, counts = ([np.frombuffer(x, t) for x in rows[c]] for c, t in (("hashes", np.uint64), ("counts", np.int32)))
    label, out, codes = root.copy(), [], None
    for p in left:
        q = right[(label[right] != label[p]) & (DEN * np.minimum(size[right], size[p]) >= NUM * np.maximum(size[right], size[p])) & (rep[right] != rep[p])]
        if band and len(q):
            q = q[(bands[q, :band] != bands[p, :band]).all(axis=1)]
        if not len(q):
            continue
        if codes is None:  # only blocks with something to compare are laid out
            lengths = np.array([len(hashes[r]) for r in right])
            laid, laid_counts = np.concatenate([hashes[r] for r in right]), np.concatenate([counts[r] for r in right])
            keys, codes = np.unique(laid, return_inverse=True)
            starts, place = np.cumsum(lengths) - lengths, {r: i for i, r in enumerate(right.tolist())}
            mark = np.zeros(len(keys), dtype=np.int32)
        at = np.minimum(np.searchsorted(keys, hashes[p]), len(keys) - 1)
        known = keys[at] == hashes[p]
        mark[at[known]] = counts[p][known]
        if len(q) * 8 < len(right):
            both = [int(np.minimum(mark[codes[starts[i] : starts[i] + lengths[i]]], laid_counts[starts[i] : starts[i] + lengths[i]]).sum()) for i in map(place.__getitem__, q.tolist())]
        else:
            both = np.add.reduceat(np.minimum(mark[codes], laid_counts), starts)[[place[r] for r in q.tolist()]]
        mark[at[known]] = 0
        both = np.asarray(both, dtype=np.int64)
        for r in q[DEN * both >= NUM * (size[q] + size[p] - both)]:
            if label[r] != label[p]:
                out.append((max(int(rep[p]), int(rep[r])), min(int(rep[p]), int(rep[r]))))
                label[label == label[r]] = label[p]
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each block (bucket, i, j) of sorted rows; a block may go on in the next batch."""
    rest: list[pa.RecordBatch] = []

    def links(table: pa.Table) -> pa.RecordBatch:
        rows = {c: table.column(c).to_numpy() for c in ("bucket", "i", "j", "band", "rep", "root", "size")} | {c: table.column(c).to_pylist() for c in ("hashes", "counts")}
        rows["other"], rows["bands"] = np.array(table.column("other").to_pylist()), table.column("bands").combine_chunks().values.to_numpy().reshape(-1, BANDS)
        cuts = np.flatnonzero((np.diff(rows["bucket"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)) + 1
        found = []
        for start, end in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
            found += block_links({c: rows[c][start:end] for c in ("other", "rep", "root", "size", "bands", "hashes", "counts")}, int(rows["band"][start]))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    key = lambda b, n: tuple(b.column(c)[n].as_py() for c in ("bucket", "i", "j"))
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            if rest and key(rest[-1], 0) != key(part, 0):
                yield links(pa.Table.from_batches(rest))
                rest = []
            last = [batch.column(c).slice(start, BLOCK).to_numpy() for c in ("bucket", "i", "j")]
            before = np.flatnonzero(np.any([k != k[-1] for k in last], axis=0))  # rows before the part's last block
            if len(before):
                yield links(pa.Table.from_batches([*rest, part.slice(0, int(before[-1]) + 1)]))
                rest = []
                part = part.slice(int(before[-1]) + 1)
            rest.append(part)
    if rest:
        yield links(pa.Table.from_batches(rest))


def _left_links(known: DataFrame, texts_of) -> DataFrame:
    """Links (a, b) between members of a bucket that nothing connects so far.

    The members outside a bucket's largest component are held against all its members, in blocks of both, so that a task
    holds two blocks at a time, and only links become rows. texts_of gives the texts of the ids in a column rep."""
    roots = known.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", (-F.col("root")).alias("r"), "size")).alias("top")
    mixed = roots.groupBy("bucket").agg(most, F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("total")).filter("roots > 1")
    cut = lambda n, total: F.ceil(F.greatest(n / BLOCK, total / BLOCK_SHINGLES))
    mixed = mixed.select("bucket", (-F.col("top.r")).alias("top"), cut(F.col("n"), F.col("total")).alias("all"), cut(F.col("n") - F.col("top.n"), F.col("total") - F.col("top.size")).alias("few"))
    members = stage(known.join(mixed, "bucket").select("bucket", "band", "rep", "root", "size", "bands", "all", "few", (F.col("root") != F.col("top")).alias("few_own")), "members")
    bags = stage(bags_of(texts_of(members.select("rep"))), "bags")
    block = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    held = members.select("*", F.lit(False).alias("other"), block(F.col("all"), 1).alias("i"), each(F.col("few")).alias("j"))
    asked = members.filter("few_own").select("*", F.lit(True).alias("other"), each(F.col("all")).alias("i"), block(F.col("few"), 2).alias("j"))
    rows = held.unionByName(asked).drop("all", "few", "few_own").join(bags, "rep")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_compared, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) of every row: class_id is the smallest id of the group of near-duplicates that the row is in.

    Texts with the same words (A-Z in lower case) are one class whatever their white space. Classes are linked where
    the multisets of their five-word shingles overlap by 0.8 or more, and links connect. A text of fewer than five
    words is one shingle; a text without words, or null, is a class by itself, and so is a row with a null id (its
    class_id is null). Rows that share an id share their group. All candidates of a band are examined: members of
    a bucket against leaders of its components, in turns, then whatever is not connected yet against all that it is not
    connected to.
    """
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    sigs = stage(signed(rows), "signatures")
    real = sigs.filter(F.col("id").isNotNull() & F.col("key").isNotNull())
    classes = stage(real.groupBy("key").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("sig").alias("sig")), "classes")
    members = stage(real.select("id", "key").distinct().join(classes.select("key", "rep"), "key").select("id", "rep"), "members")
    others = stage(sigs.filter(F.col("id").isNull() | F.col("key").isNull()).select("id"), "others")
    unstage(sigs)

    def bucket(n: int):
        return F.xxhash64(F.lit(n), F.slice("sig", ROWS * n + 1, ROWS))

    bands = F.array(*[bucket(n) for n in range(BANDS)])
    spread = classes.select("rep", "size", F.posexplode(bands).alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("full")).filter("full > 1")
    buckets = stage(spread.join(shared, "bucket"), "buckets")
    popular = stage(buckets.groupBy("rep").agg(F.sum("full").alias("pop")), "popular")
    texts_of = lambda ids: rows.join(small(stage(ids.toDF("id").distinct(), "involved")), "id", "left_semi")
    # An id with several texts is a member of several classes and connects them.
    twice = members.groupBy("id").count().filter("count > 1").select(F.col("id").alias("a"))
    joined = stage(members.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).join(twice, "a", "left_semi"), "joined")
    roots = stage(popular.select(F.col("rep").alias("id")).union(joined.select("a")).union(joined.select("b")).distinct().withColumn("root", F.col("id")), "roots")
    if joined.limit(1).count():
        roots = _connected(roots, joined)
    for turn in range(ROUNDS):
        known = buckets.join(roots.select(F.col("id").alias("rep"), "root").join(popular, "rep"), "rep")
        pairs = stage(_likely(_leader_pairs(known, turn), classes), "pairs")
        links = stage(verified(pairs, texts_of(pairs.select("a").union(pairs.select("b")))), "links") if pairs.limit(1).count() else pairs
        asked, found = pairs.count(), links.count()
        unstage(pairs)
        if found:
            roots = _connected(roots, links)
        if found * LEAST_FOUND < asked or not found:  # leaders find little any more
            break
    known = buckets.join(roots.select(F.col("id").alias("rep"), "root"), "rep").join(classes.select("rep", bands.alias("bands")), "rep")
    links = stage(_left_links(known, texts_of), "links")
    unstage(popular)
    if links.limit(1).count():
        roots = _connected(roots, links)
    unstage(buckets)
    grouped = members.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("class_id"))
    return grouped.groupBy("id").agg(F.min("class_id").alias("class_id")).unionByName(others.select("id", F.col("id").alias("class_id")))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest id, whatever other columns there are.

    Rows with a null id stay. Of several rows with the id that stays the least by all columns does."""
    other, row = unused("id", docs), unused("row", docs)
    with scope() as keep:
        found = near_duplicates(docs, id_col=id_col, text_col=text_col)
        dropped = keep(stage(found.filter("id <> class_id").select(F.col("id").alias(other)).distinct(), "dropped"))
    kept = docs.join(small(dropped), named(id_col) == named(other), "left_anti")
    again = stage(kept.filter(named(id_col).isNotNull()).groupBy(named(id_col).alias(other)).count().filter("count > 1").select(named(other)), "again")
    if not again.limit(1).count():
        return kept
    once = kept.join(small(again), named(id_col) == named(other), "left_anti")
    first = kept.join(small(again), named(id_col) == named(other), "left_semi").groupBy(named(id_col).alias(other)).agg(F.min(F.struct(*map(named, docs.columns))).alias(row))
    return once.unionByName(first.select(f"{row}.*"))


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    """Every document with the smallest id of its group of near-duplicates, and whether it is the one that stays."""
    with scope() as keep:
        found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        return keep(stage(found.select(F.col("id").alias("doc_id"), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("stays")), "groups"))
