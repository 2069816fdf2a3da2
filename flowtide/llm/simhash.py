"""Near duplicates by SimHash fingerprints, and by shingle similarity where bits are too coarse."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowtide.llm.common import small_batches, text_rows, unused
from flowtide.llm.components import components
from flowtide.plans.lookup import BROADCAST_BYTES
from flowtide.plans.materialise import materialise, stored_bytes

SEED = 42
#: Members of a block that are compared pair by pair; larger blocks are linked another, exact way.
PAIRS_UP_TO = 32


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; A-Z lower-cased, words at ASCII white space.

    Fewer words give one hash of them all, no word gives none.
    """
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    starts = np.cumsum(sizes) - sizes
    ends = (starts + sizes - 1)[words - 1 :].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits as a signed number: a bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        some = hashes[at : at + 65_536].astype("<u8", copy=False)
        ones += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of whole texts.  A null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column("text").cast(pa.binary())]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(found, pa.int64())})

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _masks(max_bits: int) -> list[int]:
    """Masks of the blocks: two of ``max_bits + 2`` parts, at least two of which a close pair shares."""
    parts = max_bits + 2
    bounds = [64 * i // parts for i in range(parts + 1)]
    ones = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:])]
    return [x | y for x, y in combinations(ones, 2)]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def fingerprint_links(fps: DataFrame, max_bits: int = 2, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints of a written table ``fp``.

    Fingerprints are cut into ``max_bits + 2`` parts.  Two that differ in at most ``max_bits`` bits
    agree in two parts at least, so they meet in a block keyed by those; pairs in a block are
    verified by Hamming distance.

    A block above ``pairs_up_to`` members emits no pairs.  Its members name all values within
    ``max_bits / 2`` bits outside the shared parts, and whoever names the same value is linked to the
    smallest of them: such links are close pairs too, and every close pair of the block names a common
    value, so components come out the same.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    if not max_bits:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    masks = _masks(max_bits)
    block = F.explode(F.array(*[
        F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("k")) for i, mask in enumerate(masks)
    ]))
    blocks = fps.select("fp", block.alias("block")).select("fp", "block.m", "block.k")
    large = materialise(
        blocks.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > pairs_up_to).select("m", "k"), "large_blocks"
    )
    small = blocks.join(large, ["m", "k"], "left_anti")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = (
        small.withColumnRenamed("fp", "a")
        .join(small.withColumnRenamed("fp", "b"), ["m", "k"])
        .where((F.col("a") < F.col("b")) & close)
        .select("a", "b")
    )

    def near(i: int) -> list[int]:
        free = [1 << p for p in range(64) if not masks[i] >> p & 1]
        return [_signed(sum(c)) for r in range(max_bits // 2 + 1) for c in combinations(free, r)]

    flips = F.element_at(F.array(*[F.array(*[F.lit(x).cast("bigint") for x in near(i)]) for i in range(len(masks))]), F.col("m") + 1)
    named = (
        blocks.join(large, ["m", "k"], "left_semi")
        .select("fp", "m", F.explode(flips).alias("flip"))
        .select("fp", "m", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    )
    # Grouped by a value and a mask: the members of one block that are near to it.
    smallest = named.groupBy("m", "value").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("members"))
    stars = smallest.select(F.explode("members").alias("a"), "b").where(F.col("a") != F.col("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text", pairs_up_to: int = PAIRS_UP_TO
) -> DataFrame:
    """Per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints that differ in at most ``max_bits`` bits are linked; ``component_id`` is the smallest
    doc_id reachable over links, a document's own included.  Equal fingerprints are one node
    of the graph, so copies are never paired.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows come each; a
    null doc_id counts for no minimum (a component of nulls alone has a null component_id); an
    empty table gives no rows; other columns are ignored.
    """
    rows = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = components(fingerprint_links(fps, max_bits, pairs_up_to))
    return rows.join(_component_ids(fps, roots, "fp"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _component_ids(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``node, root, component_id`` of a written table ``node, first``: the least ``first`` of its component.

    Tables are written between aggregates and joins, so that a component with very many nodes can be split.
    """
    rooted = materialise(
        nodes.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node)), "rooted"
    )
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    return materialise(rooted.join(least, "root").select(node, "root", "component_id"), "component_ids")


BANDS, ROWS_PER_BAND = 20, 5
#: Members of a band's block that are compared pair by pair: at most half as many pairs to each, whatever a group's size.
BAND_PAIRS_UP_TO = 10
#: Most members, and most shingles of them together, in a slice of a large block; two slices are compared in one task.
SLICE_MEMBERS, SLICE_SHINGLES = 1_000, 2_000_000
#: Shingles to a cell of an outline, on average; fewer than this many cells are never used.
CELL_SHINGLES, LEAST_CELLS = 2, 16
SKETCH = "doc_id long, text_hash long, cls binary, bands array<long>, size long, outline binary, fp long"


def _outline(hashes: np.ndarray) -> np.ndarray:
    """How many distinct shingles fall into each of a power of two of cells, by the low bits; 255 stands for 255 or more.

    The sum of the smaller counts of two outlines is at least what the sets have in common, so it rules pairs out
    without loss at a sixteenth of the bytes of a set.
    """
    cells = max(LEAST_CELLS, 1 << max(len(hashes) // CELL_SHINGLES - 1, 0).bit_length())
    found = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.minimum(found, 255).astype(np.uint8)


def _folded(outlines: np.ndarray, cells: int) -> np.ndarray:
    """Rows of outlines in fewer cells."""
    if outlines.shape[1] == cells:
        return outlines
    wide = outlines.reshape(len(outlines), -1, cells)
    # A full cell stays full: its count is not known.
    sums = np.where((wide == 255).any(1), 255, wide.sum(1, dtype=np.int64))
    return np.minimum(sums, 255).astype(np.uint8)


def _may_share(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """At least what each row's set has in common with the same row of ``right`` (or its only one), full cells aside."""
    least = np.minimum(left, right)
    found = least.sum(1, dtype=np.int64)
    return np.where((least == 255).any(1), np.iinfo(np.int64).max >> 1, found)


def _possible(sizes: np.ndarray, size: int, shared: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes with at most ``shared`` in common can be similar enough."""
    both = np.minimum(shared, np.minimum(sizes, size))
    return both >= similarity * (sizes + size - both)


def _sketcher(words: int, bands: int, rows: int, print_words: int | None):
    """Class (hash of the word sequence), band keys of minimum hashes over distinct shingles, their number and outline, fingerprint."""
    draw = np.random.RandomState(SEED)
    factor = draw.randint(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = draw.randint(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sketch(text: bytes) -> tuple[bytes, list[int], int, bytes, int | None]:
        hashes = np.unique(shingle_hashes(text, words))
        cls = xxhash.xxh3_128_digest(b" ".join(text.lower().split()))
        outline, fp = _outline(hashes).tobytes(), fingerprint(shingle_hashes(text, print_words)) if print_words else None
        if not len(hashes):
            return cls, [], 0, outline, fp
        least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(hashes), 2_000):
                least = np.minimum(least, (hashes[at : at + 2_000, None] * factor + shift).min(0))
        keys = [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(least.reshape(bands, rows))]
        return cls, keys, len(hashes), outline, fp

    return sketch


def _lookup(table: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``table`` marked for a broadcast if it, or the written table it is a part of, is small; joined by a shuffle otherwise."""
    return F.broadcast(table) if stored_bytes(table if stored is None else stored) <= BROADCAST_BYTES else table


def similar_groups(
    docs: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    pairs_up_to: int = BAND_PAIRS_UP_TO,
    print_words: int = 3,
    max_bits: int | None = None,
) -> DataFrame:
    """Per document: ``doc_id, text_hash, root, component_id`` (smallest doc_id) by Jaccard similarity of word shingles.

    With ``max_bits``, documents are also linked as ``near_duplicates`` links them, by fingerprints of ``print_words`` words.

    At a similarity of 0.8 two 64-bit fingerprints differ in about ten bits and up to sixteen; blocks
    that such pairs surely share would be four bits wide.  So for similarity the blocks are bands of
    minimum hashes (a pair at 0.8 shares one of 20 bands of 5 with probability 0.9996), and each pair is
    verified on its whole shingle sets, unless the sets' sizes and outlines (``_outline``) already rule it out.
    Texts with the same words in the same order are one node (``cls``).

    A block above ``pairs_up_to`` members emits no pairs: each member is compared with the smallest one first, and
    ``_across`` compares all members that are then still in different components, in slices.
    """
    rows = materialise(_sketches(docs, words, None if max_bits is None else print_words, id_col, text_col), "sketches")
    nodes = materialise(
        rows.groupBy("cls").agg(
            F.min("doc_id").alias("first"),
            F.min(F.struct("doc_id", "text_hash")).alias("own"),
            *[F.first(c).alias(c) for c in ("bands", "size", "outline", "fp")],
        ),
        "classes",
    )
    blocks = materialise(nodes.select("cls", F.posexplode("bands").alias("band", "key")), "bands")
    sizes = blocks.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("head"))
    sizes = materialise(sizes.where("n > 1"), "band_sizes")
    large = sizes.where(F.col("n") > pairs_up_to).select("band", "key", "head")
    small = blocks.join(_lookup(sizes.where(F.col("n") <= pairs_up_to).select("band", "key"), sizes), ["band", "key"], "left_semi")
    small = materialise(small, "small_blocks")
    pairs = small.withColumnRenamed("cls", "a").join(small.withColumnRenamed("cls", "b"), ["band", "key"]).where("a < b").select("a", "b")
    again = not large.isEmpty()
    if again:
        heads = blocks.join(_lookup(large, sizes), ["band", "key"]).where("cls != head")
        pairs = pairs.unionByName(heads.select(F.col("head").alias("a"), F.col("cls").alias("b")))
    pairs = materialise(_open_pairs(pairs.distinct(), nodes, similarity), "pairs")
    links = materialise(_verified(pairs, _sets(docs, nodes, pairs, words, id_col, text_col), similarity), "links")
    if max_bits is not None:
        links = links.unionByName(_print_links(nodes, max_bits))
    roots = components(links)
    if again:
        members = blocks.join(_lookup(large.select("band", "key"), sizes), ["band", "key"], "left_semi")
        rooted = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        more = _across(docs, nodes, materialise(rooted, "rooted_blocks"), words, similarity, id_col, text_col)
        if more is not None:
            roots = components(links.unionByName(more))
    return rows.join(_component_ids(nodes.select("cls", "first"), roots, "cls"), "cls").select("doc_id", "text_hash", "root", "component_id")


def _print_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Links ``a, b`` of each class to the least one whose fingerprint is in the same component of ``fingerprint_links``."""
    fps = materialise(nodes.select("fp").distinct(), "fps")
    roots = components(fingerprint_links(fps, max_bits)).withColumnRenamed("node", "fp")
    rooted = nodes.select("cls", "fp").join(roots, "fp", "left").select("cls", F.coalesce("root", "fp").alias("print"))
    rooted = materialise(rooted, "rooted_prints")
    least = materialise(rooted.groupBy("print").agg(F.min("cls").alias("b")), "least_prints")
    return materialise(rooted.join(least, "print").where("cls != b").select(F.col("cls").alias("a"), "b"), "print_links")


def _across(
    docs: DataFrame, nodes: DataFrame, members: DataFrame, words: int, similarity: float, id_col: str, text_col: str
) -> DataFrame | None:
    """Links between members of one block that are in different components, ``members`` being ``band, key, cls, root``.

    Every such pair is compared on whole shingle sets unless links found in the same task already join it.  The
    members of a block's largest component (``main``) and the rest are cut into slices by hash, and each two slices
    of which one is of the rest meet in a task.  They meet by their outlines first, and only members that these leave a
    partner there bring their whole sets.  Blocks of the same members count once.  None if no block has two components.
    """
    counts = materialise(
        members.groupBy("band", "key", "root").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sum"),
            F.bit_xor(F.xxhash64("cls", F.lit(SEED))).alias("xor"),
        ),
        "block_roots",
    )
    blocks = counts.groupBy("band", "key").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"),
        F.count(F.lit(1)).alias("roots"),
        F.sum("n").alias("n"),
        F.sum("sum").alias("sum"),
        F.bit_xor("xor").alias("xor"),
    )
    once = blocks.where("roots > 1").groupBy("n", "sum", "xor").agg(F.min(F.struct("band", "key", "main")).alias("b"))
    open_blocks = materialise(once.select("b.band", "b.key", "b.main"), "open_blocks")
    if open_blocks.isEmpty():
        return None
    inside = members.join(open_blocks, ["band", "key"]).withColumn("rest", F.col("root") != F.col("main"))
    inside = inside.join(nodes.select("cls", "size"), "cls")
    inside = materialise(inside.select("band", "key", "cls", "root", "rest", "size"), "open_members")
    slices = lambda rest: F.greatest(
        F.ceil(F.count(F.when(F.col("rest") == rest, 1)) / SLICE_MEMBERS),
        F.ceil(F.coalesce(F.sum(F.when(F.col("rest") == rest, F.col("size"))), F.lit(0)) / SLICE_SHINGLES),
    ).cast("int")
    cuts = materialise(inside.groupBy("band", "key").agg(slices(False).alias("of_main"), slices(True).alias("of_rest")), "slices")
    dealt = inside.join(cuts, ["band", "key"])
    dealt = dealt.withColumn(
        "slice",
        F.when(F.col("rest"), F.col("of_main") + F.pmod(F.xxhash64("cls"), F.col("of_rest"))).otherwise(F.pmod(F.xxhash64("cls"), F.col("of_main"))).cast("int"),
    )
    others = F.sequence(F.when(F.col("rest"), F.lit(0)).otherwise(F.col("of_main")), F.col("of_main") + F.col("of_rest") - 1)
    dealt = dealt.withColumn("other", F.explode(others)).select(
        "band", "key", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "cls", "root"
    )

    def partnered(table: pa.Table) -> pa.Table:
        at = table["slice"].to_numpy()
        keep = _partnered(
            [np.frombuffer(x.as_buffer(), np.uint8) for x in table["outline"]],
            table["size"].to_numpy(),
            np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)[1],
            np.flatnonzero(at == table["i"][0].as_py()),
            np.flatnonzero(at == table["j"][0].as_py()),
            similarity,
        )
        return table.select(["band", "key", "i", "j", "slice", "cls", "root"]).filter(pa.array(keep))

    outlined = dealt.join(nodes.select("cls", "size", "outline"), "cls").groupBy("band", "key", "i", "j")
    dealt = materialise(
        outlined.applyInArrow(partnered, "band int, key long, i int, j int, slice int, cls binary, root binary"), "partnered"
    )
    sets = _sets(docs, nodes, dealt.select(F.col("cls").alias("a"), F.col("cls").alias("b")), words, id_col, text_col)

    def compared(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        names, roots, at = table["cls"].to_pylist(), table["root"].to_pylist(), table["slice"].to_pylist()
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["set"]]
        links = _cross_links(found, roots, [k for k, x in enumerate(at) if x == i], [k for k, x in enumerate(at) if x == j], similarity)
        return pa.table({"a": pa.array([names[x] for x, _ in links], pa.binary()), "b": pa.array([names[y] for _, y in links], pa.binary())})

    whole = dealt.join(sets, "cls").groupBy("band", "key", "i", "j")
    return materialise(whole.applyInArrow(compared, "a binary, b binary"), "links_across")


def _partnered(
    outlines: list[np.ndarray], sizes: np.ndarray, roots: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float
) -> np.ndarray:
    """For each member, whether another, one of ``left`` and one of ``right``, may be similar and has another root."""
    keep = np.zeros(len(outlines), bool)
    cells = np.array([len(o) for o in outlines])
    # Members of as many cells in one matrix; ``rows`` holds it folded to what its partners have.
    for wide in np.unique(cells[left]):
        some = left[cells[left] == wide]
        rows = {wide: np.stack([outlines[x] for x in some])}
        near = np.flatnonzero((similarity * sizes[right] <= sizes[some].max()) & (sizes[right] >= similarity * sizes[some].min()))
        for y in right[near]:
            narrow = min(wide, cells[y])
            if narrow not in rows:
                rows[narrow] = _folded(rows[wide], narrow)
            other = np.flatnonzero((roots[some] != roots[y]) & (np.minimum(sizes[some], sizes[y]) >= similarity * np.maximum(sizes[some], sizes[y])))
            if not len(other) or (keep[y] and keep[some[other]].all()):
                continue
            shared = _may_share(rows[narrow][other], _folded(outlines[y][None, :], narrow))
            hit = some[other[_possible(sizes[some[other]], sizes[y], shared, similarity)]]
            keep[hit] = True
            keep[y] |= len(hit) > 0
    return keep


def _cross_links(sets: list[np.ndarray], roots: list[bytes], left: list[int], right: list[int], similarity: float) -> list[tuple[int, int]]:
    """Places of similar sets, one of ``left`` and one of ``right``, that join components not joined before."""
    parent = {r: r for r in roots}

    def find(r: bytes) -> bytes:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    # The places of ``left`` that hold each shingle, in a row.
    sizes = np.array([len(sets[x]) for x in left], np.int64)
    shingles = np.concatenate([sets[x] for x in left]) if left else np.zeros(0, np.uint64)
    order = np.argsort(shingles, kind="stable")
    holders = np.repeat(np.arange(len(left)), sizes)[order]
    shingles, starts, counts = np.unique(shingles[order], return_index=True, return_counts=True)
    links = []
    for y in right:
        own = find(roots[y])
        if not len(shingles) or all(find(roots[x]) == own for x in left):
            continue
        at = np.minimum(np.searchsorted(shingles, sets[y]), len(shingles) - 1)
        at = at[shingles[at] == sets[y]]
        n = counts[at]
        # The stretches start, start + 1, ... of all shingles in common, one after the other.
        held = holders[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        both = np.bincount(held, minlength=len(left))
        for k in np.flatnonzero(both >= similarity * (sizes + len(sets[y]) - both)):
            a, b = find(roots[left[k]]), find(roots[y])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((left[k], y))
    return links


def _sketches(docs: DataFrame, words: int, print_words: int | None, id_col: str, text_col: str) -> DataFrame:
    sketch = _sketcher(words, BANDS, ROWS_PER_BAND, print_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "text_hash": batch.column("text_hash"),
                "cls": pa.array([f[0] for f in found], pa.binary()),
                "bands": pa.array([f[1] for f in found], pa.list_(pa.int64())),
                "size": pa.array([f[2] for f in found], pa.int64()),
                "outline": pa.array([f[3] for f in found], pa.binary()),
                "fp": pa.array([f[4] for f in found], pa.int64()),
            })

    return text_rows(docs, id_col, text_col, text_hash=F.xxhash64(f"`{text_col}`")).mapInArrow(run, SKETCH)


def _sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``cls, set`` of the classes in ``pairs``, as a written table; only texts that stand in a pair are shuffled."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.record_batch({"cls": batch.column("cls"), "set": pa.array(sets, pa.binary())})

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    owners = materialise(nodes.join(wanted, "cls").select("cls", "own.doc_id", "own.text_hash"), "owners")
    rows = text_rows(docs, id_col, text_col, text_hash=F.xxhash64(f"`{text_col}`"))
    same = rows["doc_id"].eqNullSafe(owners["doc_id"]) & (rows["text_hash"] == owners["text_hash"])
    # Repeated rows would give a class its set twice.
    sets = rows.join(_lookup(owners), same).select("cls", "text").mapInArrow(hashed, "cls binary, set binary").dropDuplicates(["cls"])
    return materialise(sets, "sets")


def _open_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of classes that sizes and outlines do not rule out."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(batch["m"].to_numpy(), batch["n"].to_numpy(), batch["x"], batch["y"]):
                x, y = (np.frombuffer(o.as_buffer(), np.uint8)[None, :] for o in (x, y))
                cells = min(x.shape[1], y.shape[1])
                shared = _may_share(_folded(x, cells), _folded(y, cells))
                keep.append(bool(_possible(np.array([m]), n, shared, similarity)[0]))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda cls, size, outline: nodes.select(F.col("cls").alias(cls), F.col("size").alias(size), F.col("outline").alias(outline))
    # Sizes first: pairs of very different ones carry no outline.
    sized = pairs.join(nodes.select(F.col("cls").alias("a"), F.col("size").alias("m")), "a")
    sized = sized.join(nodes.select(F.col("cls").alias("b"), F.col("size").alias("n")), "b")
    sized = materialise(sized.where(F.least("m", "n") >= F.lit(similarity) * F.greatest("m", "n")).select("a", "b"), "sized_pairs")
    both = sized.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")
    return both.mapInArrow(open_, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of classes whose shingle sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    half = materialise(pairs.join(sets.withColumnRenamed("cls", "a").withColumnRenamed("set", "set_a"), "a"), "half_pairs")
    return half.join(sets.withColumnRenamed("cls", "b").withColumnRenamed("set", "set_b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(
        similar, "a binary, b binary"
    )


def one_of_each(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", print_words: int = 3, max_bits: int = 2
) -> DataFrame:
    """The documents without near copies: of each group the one with the smallest doc_id stays, all columns kept.

    Groups are those of SimHash fingerprints within ``max_bits`` bits and of similar shingle sets together: two
    documents of a group are joined by links of either kind.

    Null and empty texts are one group; repeated rows are copies of each other; a group of null
    doc_ids keeps one row; texts count whole, whatever their length; an empty table gives no rows; columns may have any name.
    """
    with small_batches(docs.sparkSession):
        groups = materialise(similar_groups(docs, words, similarity, id_col, text_col, print_words=print_words, max_bits=max_bits), "groups")
    chosen = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("own"))
    chosen = chosen.select(F.col("own.doc_id").alias("_doc"), F.col("own.text_hash").alias("_hash"))
    repeated = groups.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    doc, text_hash, copies = unused(docs, "_doc", "_hash", "_n")
    keep = materialise(
        chosen.alias("c")
        .join(repeated.alias("r"), F.col("c._doc").eqNullSafe(F.col("r._doc")) & (F.col("c._hash") == F.col("r._hash")))
        .select(F.col("c._doc").alias(doc), F.col("c._hash").alias(text_hash), F.col("_n").alias(copies)),
        "kept",
    )
    rows = docs.join(
        _lookup(keep), F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(doc)) & (F.xxhash64(f"`{text_col}`") == F.col(text_hash))
    )
    if not keep.where(F.col(copies) > 1).isEmpty():
        rows = rows.where(F.col(copies) == 1).unionByName(rows.where(F.col(copies) > 1).dropDuplicates([doc, text_hash]))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
