"""Exact n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Two documents link when the Jaccard similarity of their sets of word shingles reaches a
ratio of whole numbers. The join is exact and goes in four steps.

1. *Counting.* Every document posts those of its shingle hashes that lie in the lowest
   ``SAMPLED`` part of the hash range (small documents, and those with so few there that a
   partner might have none of them, post all). Postings are dealt by hash range in packed
   blocks, with as many ranges as the bytes of the texts ask for, and each comes back with the number of documents that have it. Linked
   documents can differ in few shingles, so a document whose rarest postings, as many as may
   differ and one more, are all its own has no partner. The rest of those rarest postings
   that it shares are its keys: linked documents share at least one.
2. *Candidate groups.* Documents are connected through shared keys. Keys are the rarest
   shingles, so a passage that many documents quote connects nobody by itself.
3. *Tiles.* Sets that are equal are joined under their smallest id, and the sets of a group
   meet in tiles: one tile if the group is small, else a tile for every two blocks of
   neighbouring size bands. Tiles are decided on ids and sizes; then the texts are read again
   and the arrays go straight to their tiles. Up to ``BROADCAST_SETS`` those ids are broadcast,
   so other texts stay where they are; beyond it texts and ids are shuffled. A tile
   bounds the overlap of two sets from above by the bits that their bitmaps share, and only
   intersects the sorted arrays of pairs which that bound lets through.
4. *Components.* Tiles give spanning links, which are joined over the whole corpus.

Defined cases: words are maximal runs without ASCII blanks, lower-cased in A-Z only; a
document with fewer words than a shingle is one shingle; one without words, or with a null
text, has none and links with nothing. Rows that repeat an id are taken as copies of one
document if their texts are equal, and are linked as one node if not; null ids are returned
with themselves. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import components, shuffle_parts, slices, stored, whole_text

SAMPLED = 0.25
POSTS_ALL = 128
BATCH_BYTES = 8 << 20
HASHED_BYTES = 1 << 20  # bytes hashed at once, or one text: about 40 bytes of arrays for each
RANGE_BYTES = 64 << 20  # text whose postings make one hash range on average
TILE = 1500
BITS_PER_SHINGLE = 4
BROADCAST_SETS = 1_000_000  # rows of 64 bytes
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 2**64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n - 1``, modulo 2**64."""
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of every text."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode()
        if held and size + len(data) > HASHED_BYTES:
            out += _hashed_sets(held, n)
            held, size = [], 0
        held.append(data)
        size += len(data)
    return out + _hashed_sets(held, n)


def _hashed_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sets of texts whose words are hashed together.

    A word's polynomial hash is a difference of running sums, divided by the power of
    ``ODD`` at its start. So it depends on the bytes of the word alone, not on the texts
    beside it.
    """
    buffer = b" ".join(texts) + b" "
    data = np.frombuffer(buffer.lower(), np.uint8)
    blank = BLANKS[data]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    terms = data.astype(np.uint64) + np.uint64(1)
    terms *= powers(ODD, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    del terms
    own_scale = powers(INVERSE, len(data))[starts]
    words = mixed((sums[ends] - sums[starts]) * own_scale + (ends - starts).astype(np.uint64))
    del sums
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = words[a:b]
        if not len(own):
            out.append(np.zeros(0, np.uint64))
            continue
        width = min(n, len(own))
        h = np.zeros(len(own) - width + 1, np.uint64)
        for i in range(width):
            h = (h + own[i : len(own) - width + 1 + i]) * ODD + np.uint64(i + 1)
        out.append(np.unique(mixed(h + np.uint64(width))))
    return out


def may_differ(size: int, num: int, den: int) -> int:
    """The most shingles of a set of ``size`` that a linked set can lack."""
    return size - ceil(num * size / den)


def posts_all(shingles: np.ndarray, num: int, den: int) -> bool:
    """Whether a document posts all of its shingles: if it is small, or if it could lack all of
    its sampled ones in a linked document. Two linked documents that share no sampled shingle
    are both of this sort, so they meet by the others."""
    sampled = int(np.searchsorted(shingles, np.uint64(int(SAMPLED * 2.0**64))))
    return len(shingles) <= POSTS_ALL or sampled <= may_differ(len(shingles), num, den)


def posted(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes that a document posts, 40 bits each; collisions only make keys less rare."""
    if not posts_all(shingles, num, den):
        shingles = shingles[: int(np.searchsorted(shingles, np.uint64(int(SAMPLED * 2.0**64))))]
    return np.unique(shingles >> np.uint64(24))


def ranges(shingles: np.ndarray, posts: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """``(role, length)`` of the postings from which keys are taken.

    Two documents that post all meet by all their postings (role 0), any other pair by those
    in the sampled range (role 1). A document whose partners may be of either sort takes both.
    """
    found = []
    if posts_all(shingles, num, den):
        found.append((0, len(posts)))
    if len(shingles) * den > POSTS_ALL * num:
        found.append((1, int(np.searchsorted(posts, np.uint64(int(SAMPLED * 2.0**40))))))
    return found


def _posting_blocks(docs: DataFrame, n: int, num: int, den: int, parts: int) -> DataFrame:
    """``part, docs, spare, local, hashes``: postings of a batch of documents, by hash range.

    ``spare`` is twice (the number of rarest postings that make keys, less the number of
    postings), plus the role. A document of two roles posts twice, which counts it twice:
    its postings look less rare, to all alike.
    Copies within a batch are posted once, by the smallest id. Document ids must not be null.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            ids = batch.column("doc_id").to_numpy()
            first: dict[bytes, int] = {}
            texts = batch.column("text").to_pylist()
            owners, spares, posts = [], [], []
            sets = shingle_sets(texts, n)
            for i in np.argsort(ids, kind="stable").tolist():
                s = sets[i]
                if not len(s):
                    continue
                if first.setdefault(s.tobytes(), i) != i:
                    continue
                p = posted(s, num, den)
                for role, complete in ranges(s, p, num, den):
                    owners.append(ids[i])
                    spares.append(2 * (may_differ(len(s), num, den) + 1 - complete) + role)
                    posts.append(p[:complete])
            out: list[list] = [[] for _ in range(5)]
            if owners:
                owner = np.array(owners, "<i8")
                spare = np.array(spares, "<i4")
                counts = np.fromiter(map(len, posts), np.int64, len(posts))
                flat, doc = np.concatenate(posts), np.repeat(np.arange(len(posts)), counts)
                part = (mixed(flat) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((doc, part))
                part, flat, doc = part[order], flat[order], doc[order]
                cuts = np.searchsorted(part, np.arange(parts + 1))
                for j in range(parts):
                    a, b = cuts[j], cuts[j + 1]
                    if a == b:
                        continue
                    used, local = np.unique(doc[a:b], return_inverse=True)
                    out[0].append(j)
                    out[1].append(owner[used].tobytes())
                    out[2].append(spare[used].tobytes())
                    out[3].append(local.astype("<u4").tobytes())
                    out[4].append((flat[a:b]).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])],
                names=["part", "docs", "spare", "local", "hashes"],
            )

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(post, "part int, docs binary, spare binary, local binary, hashes binary")


def _shared_postings(group: pd.DataFrame) -> pd.DataFrame:
    """Postings that at least two documents have, with their counts."""
    owners, spares, local, offset = [], [], [], 0
    for row in group.itertuples(index=False):
        ids = np.frombuffer(row.docs, "<i8")
        owners.append(ids)
        spares.append(np.frombuffer(row.spare, "<i4"))
        local.append(np.frombuffer(row.local, "<u4").astype(np.int64) + offset)
        offset += len(ids)
    owner, spare, doc = np.concatenate(owners), np.concatenate(spares), np.concatenate(local)
    hashes = np.concatenate([np.frombuffer(h, "<u8") for h in group["hashes"]])
    found, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    keep = counts[place] > 1
    doc = doc[keep]
    return pd.DataFrame(
        {
            "doc_id": owner[doc],
            "spare": spare[doc],
            "hash": found[place[keep]].astype(np.int64),
            "n": counts[place[keep]],
        }
    )


def keys(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``doc_id, hash``: the shared rarest postings of documents that may have a partner."""
    total = docs.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0
    parts = max(shuffle_parts(docs.sparkSession), -(-total // RANGE_BYTES))
    blocks = _posting_blocks(docs, n, num, den, parts)
    shared = blocks.groupBy("part").applyInPandas(
        _shared_postings, "doc_id long, spare int, hash long, n long"
    )
    # A document lists all its shared postings, at most as many as its own shingles.
    listed = shared.groupBy("doc_id", "spare").agg(
        F.array_sort(F.collect_list(F.struct("n", "hash"))).alias("found")
    )
    wanted = F.expr("spare div 2 - if(spare < 0 AND spare % 2 <> 0, 1, 0)").cast("int") + F.size("found")
    chosen = listed.where(wanted > 0).select(
        "doc_id", F.explode(F.slice("found", F.lit(1), wanted)).alias("k")
    )
    return chosen.select("doc_id", F.col("k.hash").alias("hash"))


def links_of(sizes: np.ndarray, sets: list[np.ndarray], ids: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links of the sets of a tile, by search over the sets not yet reached."""
    n = len(ids)
    order = np.argsort(sizes, kind="stable")
    sizes, ids, sets = sizes[order], ids[order], [sets[i] for i in order]
    bits = 64 * max(1, ceil(BITS_PER_SHINGLE * int(sizes.max()) / 64)) if n else 64
    bitmap = np.zeros((n, bits // 8), np.uint8)
    for i, s in enumerate(sets):
        at = np.unique(s % np.uint64(bits)).astype(np.int64)
        np.bitwise_or.at(bitmap[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
    bitmap = bitmap.view(np.uint64)
    free = np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)
    # Shingles beyond the bits of a set share a bit with another one of the set.
    hidden = sizes - free
    left, out = np.arange(n), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            low, high = ceil(num * int(sizes[x]) / den), den * int(sizes[x]) // num
            a, b = np.searchsorted(sizes[left], [low, high + 1])
            near = left[a:b]
            if not len(near):
                continue
            common = np.bitwise_count(bitmap[near] & bitmap[x]).sum(axis=1, dtype=np.int64)
            most = np.minimum(common + np.minimum(hidden[near], hidden[x]), np.minimum(sizes[near], sizes[x]))
            possible = den * most >= num * (sizes[near] + sizes[x] - most)
            hit = []
            for y in near[possible].tolist():
                if len(sets[x]) <= len(sets[y]):
                    place, whole = np.searchsorted(sets[y], sets[x]), sets[y]
                    both = int((whole[np.minimum(place, len(whole) - 1)] == sets[x]).sum())
                else:
                    place, whole = np.searchsorted(sets[x], sets[y]), sets[x]
                    both = int((whole[np.minimum(place, len(whole) - 1)] == sets[y]).sum())
                if den * both >= num * (int(sizes[x]) + int(sizes[y]) - both):
                    hit.append(y)
                    out.append((int(ids[x]), int(ids[y])))
            if hit:
                left = np.setdiff1d(left, hit, assume_unique=True)
                queue += hit
    return out


def linked(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document."""
    keyed = stored(keys(docs, n, num, den), "shingle-keys")
    least = keyed.groupBy("hash").agg(F.min("doc_id").alias("b"), F.count("*").alias("c")).where("c > 1")
    edges = keyed.join(least, "hash").select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    groups = components(edges, "shingle-groups").withColumnRenamed("component", "grp")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sizes and digests of all sets: copies of a set are joined by their digest."""
        for batch in slices(batches, "text", BATCH_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist(), n)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sized = stored(texts.mapInArrow(shingle, "doc_id long, n_shingles long, digest binary"), "shingle-sizes")
    copies = (
        sized.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"))
    )

    # Only smallest ids of equal sets go on; a copy's keys are those of its set.
    member = sized.join(copies, "digest").select("doc_id", "rep")
    grouped = stored(
        groups.join(member, groups.node == member.doc_id).groupBy("rep").agg(F.min("grp").alias("grp")).select("rep", "grp"),
        "shingle-reps",
    )
    # A set whose copies were posted in several batches may lie in several groups.
    crossing = groups.join(member, groups.node == member.doc_id).join(
        grouped.withColumnRenamed("grp", "low"), "rep"
    )
    crossing = crossing.where("grp <> low").select(F.col("grp").alias("a"), F.col("low").alias("b"))
    merged = components(crossing, "shingle-merged").withColumnRenamed("component", "top")
    placed = grouped.join(merged, grouped.grp == merged.node, "left").select(
        F.col("rep"), F.coalesce("top", "grp").alias("grp")
    )
    placed = stored(placed, "shingle-placed")

    # Bands: a set links only within its own size band and the next ones.
    sizes = sized.where("digest IS NOT NULL").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"))
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(den / num)) + 1e-9).cast("long")
    banded = stored(placed.join(sizes.distinct(), "rep").withColumn("band", band), "shingle-bands")
    many = banded.groupBy("grp").agg(F.count("*").alias("m"))
    per_band = banded.groupBy("grp", "band").agg(F.count("*").alias("mb"))
    blocks = per_band.join(many, "grp").withColumn(
        "blocks", F.when(F.col("m") <= TILE, 0).otherwise(F.ceil(F.col("mb") / (TILE // 2)))
    )
    below = blocks.select("grp", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    above = blocks.select("grp", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    counted = blocks.join(below, ["grp", "band"], "left").join(above, ["grp", "band"], "left").where("m > 1")
    block = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(0)
    located = banded.join(counted, ["grp", "band"]).withColumn("block", block)
    place = ["grp", "band", "block", "blocks", "above", "below"]
    located = stored(located.select("rep", "size", *place), "shingle-tiles")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the size that the tiles were decided on; rows of one id may differ in size."""
        for batch in slices(batches, "text", BATCH_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist(), n)
            own = pa.array([s.tobytes() for s in sets], pa.binary())
            fits = pa.array([len(s) == size for s, size in zip(sets, batch.column("size").to_pylist(), strict=True)])
            names = ["rep", "size", *place]
            found = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), own], names=[*names, "shingles"])
            yield found.filter(fits)

    few = located.count() <= BROADCAST_SETS
    met = texts.join(F.broadcast(located) if few else located, texts.doc_id == located.rep)
    schema = ", ".join(f"{c} long" for c in ("rep", "size", *place))
    sets = met.select("rep", "size", *place, "text").mapInArrow(arrays, f"{schema}, shingles binary")
    tiles = F.expr(
        """CASE WHEN blocks = 0 THEN array('') ELSE concat(
             transform(sequence(0, blocks - 1), j -> concat(band, ':', least(j, block), '-', band, ':', greatest(j, block))),
             CASE WHEN above > 0 THEN transform(sequence(0, above - 1), j -> concat(band, ':', block, '-', band + 1, ':', j))
                  ELSE array() END,
             CASE WHEN below > 0 THEN transform(sequence(0, below - 1), j -> concat(band - 1, ':', j, '-', band, ':', block))
                  ELSE array() END) END"""
    )
    dealt = sets.select("grp", F.explode(tiles).alias("tile"), "rep", "size", "shingles")

    def join_tile(rows: pd.DataFrame) -> pd.DataFrame:
        found = links_of(
            rows["size"].to_numpy(np.int64),
            [np.frombuffer(s, np.uint64) for s in rows["shingles"]],
            rows["rep"].to_numpy(np.int64),
            num,
            den,
        )
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    links = dealt.groupBy("grp", "tile").applyInPandas(join_tile, "a long, b long")
    joined = components(links, "shingle-links")
    named = copies.join(joined, copies.rep == joined.node, "left").select(
        F.col("digest").alias("set_digest"), F.least("rep", F.coalesce("component", "rep")).alias("top")
    )
    out = sized.join(named, sized.digest == named.set_digest, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("top", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component, with all columns."""
    found = linked(docs, n, num, den).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.select(F.col("doc_id").alias("_kept_id"))
    return docs.join(kept, docs.doc_id.eqNullSafe(F.col("_kept_id")), "left_semi").select(docs.columns)
